"""Citations in answers, as Column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# What brackets count as citations for the validator and for the reader's view.
CITED = r"\[([A-Za-z0-9_-]+(?:\s*,\s*[A-Za-z0-9_-]+)*)\]"
LINKED = r"\[([A-Za-z0-9_]+(?:\s*,\s*[A-Za-z0-9_]+)*)\]"
BOLD_BRACKET = r"\*\*\s*(\[[^\]]+\])\s*\*\*"


def _ids(answer: Column, pattern: str) -> Column:
    return F.flatten(F.transform(F.regexp_extract_all(answer, F.lit(pattern), F.lit(1)), lambda g: F.transform(F.split(g, ","), lambda t: F.trim(t))))


def cited_ids(answer: Column) -> Column:
    """Distinct cited ids in order: two characters or more, with a digit."""
    return F.array_distinct(F.filter(_ids(answer, CITED), lambda t: (F.length(t) >= 2) & t.rlike("[0-9]")))


def invalid_ids(answer: Column, seen: Column) -> Column:
    """Cited ids that were never retrieved, sorted."""
    return F.array_sort(F.array_except(cited_ids(answer), seen))


def citation_valid(answer: Column, seen: Column) -> Column:
    return (F.coalesce(F.length(answer), F.lit(0)) > 0) & (F.size(invalid_ids(answer, seen)) == 0)


def gold_cited(answer: Column, gold: Column) -> Column:
    return F.arrays_overlap(cited_ids(answer), gold)


def strip_bold_brackets(answer: Column) -> Column:
    return F.regexp_replace(answer, BOLD_BRACKET, "$1")


def linked_groups(answer: Column, known: Column | None = None) -> Column:
    """The id lists of brackets that link: those whose every id is known, if a list is given."""
    groups = F.transform(F.regexp_extract_all(strip_bold_brackets(answer), F.lit(LINKED), F.lit(1)), lambda g: F.filter(F.transform(F.split(g, ","), lambda t: F.trim(t)), lambda t: t != ""))
    return groups if known is None else F.filter(groups, lambda ids: F.size(F.array_except(ids, known)) == 0)


def segments(answer: Column, known: Column | None = None) -> Column:
    """Text and citation parts in order: type, text (null in a citation), numbers (by first appearance; null in a text)."""
    clean = strip_bold_brackets(answer)
    pieces = F.split(clean, LINKED, -1)
    brackets = F.regexp_extract_all(clean, F.lit(LINKED), F.lit(0))
    order = F.array_distinct(F.flatten(linked_groups(answer, known)))
    text_part = lambda t: F.struct(F.lit("text").alias("type"), t.alias("text"), F.lit(None).cast("array<int>").alias("numbers"))

    def part(bracket: Column) -> Column:
        ids = F.filter(F.transform(F.split(F.regexp_replace(bracket, r"^\[|\]$", ""), ","), lambda t: F.trim(t)), lambda t: t != "")
        links = F.lit(True) if known is None else F.size(F.array_except(ids, known)) == 0
        cite = F.struct(F.lit("citation").alias("type"), F.lit(None).cast("string").alias("text"), F.transform(ids, lambda i: F.array_position(order, i).cast("int")).alias("numbers"))
        return F.when(links, cite).otherwise(text_part(bracket))

    # pieces and brackets alternate; neighbouring texts become one
    flat = F.concat(F.array(text_part(pieces[0])), F.flatten(F.transform(brackets, lambda b, i: F.array(part(b), text_part(F.get(pieces, i + 1))))))

    def step(out: Column, x: Column) -> Column:
        last = F.element_at(out, -1)
        join = (F.size(out) > 0) & (x["type"] == "text") & (F.get(out, F.size(out) - 1)["type"] == "text")
        longer = F.concat(F.slice(out, F.lit(1), F.size(out) - 1), F.array(text_part(F.concat(last["text"], x["text"]))))
        return F.when((x["type"] == "text") & (F.length(x["text"]) == 0), out).when(join, longer).otherwise(F.concat(out, F.array(x)))

    empty = F.array().cast("array<struct<type:string,text:string,numbers:array<int>>>")
    return F.aggregate(flat, empty, step)


def numbers(answer: Column, known: Column | None = None) -> Column:
    """Array of (doc_id, number, count): ids numbered by first appearance with the times that they are cited."""
    ids = F.flatten(linked_groups(answer, known))
    return F.transform(F.array_distinct(ids), lambda d, i: F.struct(d.alias("doc_id"), (i + 1).cast("int").alias("number"), F.size(F.filter(ids, lambda x: x == d)).alias("count")))
