"""Small scalar functions: formats, dates, JSON, maps and display."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def rounded_ms(ms: Column) -> Column:
    """One decimal, half to even."""
    return F.bround(ms, 1)


def iso_date_in(date: Column, query: Column) -> Column:
    """Whether a date is written year-month-day and its year stands in the query."""
    return date.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$") & query.contains(F.substring(date, 1, 4))


def stamp(ts: Column) -> Column:
    """A timestamp for file names, in UTC, to the microsecond."""
    return F.concat(F.date_format(ts, "yyyyMMdd'T'HHmmssSSSSSS"), F.lit("Z"))


def shown_rank(rank: Column) -> Column:
    return F.coalesce(rank.cast("string"), F.lit(">50"))


def shown_delta(delta: Column, comparable: Column) -> Column:
    """A signed number, or N/A where runs don't compare."""
    return F.when(comparable, F.format_string("%+d", delta.cast("long"))).otherwise(F.lit("N/A"))


def value_factors(document: Column, court: Column, landmark: Column) -> Column:
    """Product of the factors of the three boosts; a boost that is missing, zero or negative is neutral."""
    factor = lambda v, f: F.when(v > 0, f).otherwise(F.lit(1.0))
    return factor(document, F.sqrt(0.2 * document)) * factor(court, 0.01 * court) * factor(landmark, F.log10(2 + 1.2 * landmark))


def usage(tokens: Column) -> Column:
    """Map of prompt_tokens / completion_tokens to input / output, only of the keys that are there."""
    kept = F.map_filter(tokens, lambda k, v: k.isin("prompt_tokens", "completion_tokens"))
    return F.transform_keys(kept, lambda k, v: F.when(k == "prompt_tokens", "input").otherwise("output"))


def maps_equal(a: Column, b: Column) -> Column:
    return F.array_sort(F.map_entries(a)) == F.array_sort(F.map_entries(b))


def merged_maps(a: Column, b: Column) -> Column:
    """b wins where both have a key."""
    return F.map_concat(F.map_filter(a, lambda k, v: ~F.map_contains_key(b, k)), b)
