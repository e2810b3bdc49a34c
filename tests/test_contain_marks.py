"""Passages in documents, and marks of words, against plain loops."""

import random
import re

import pytest
from pyspark.sql import functions as F

from docketlake.functions import marks
from docketlake.functions import text as T
from docketlake.operators import contain


def test_passages_against_a_plain_loop(spark):
    rng = random.Random(5)
    texts = ["".join(rng.choices("ab é", k=rng.randint(0, 300))) for _ in range(120)] + [None, "", "x" * 5000, "ab" * 3000]
    docs = [(i, t) for i, t in enumerate(texts)] + [(7, texts[7]), (None, texts[8])]
    passages = []
    for n in (1, 2, 3, 4, 5, 7, 8, 9, 15, 16, 17, 31, 40, 64, 100, 250):
        for _ in range(4):
            t = rng.choice([t for t in texts if t and len(t) >= n])
            at = rng.randrange(len(t) - n + 1)
            passages.append(t[at : at + n])
    passages = [(f"p{i}", 0, p) for i, p in enumerate([*passages, None, "", "zz", "x" * 5001, "x" * 4999, "é" * 3])]
    got = contain.containing(spark.createDataFrame(docs, "d long, body string").repartition(3), spark.createDataFrame(passages, "q string, hash int, t string"), "d", "body", "t")
    want = {(q, 0, d) for q, _, p in passages for d, t in docs if p and t and p in t}
    rows = [tuple(r) for r in got.select("q", "hash", "d").collect()]
    assert set(rows) == want and len(rows) == len(want) and len(want) > 200
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert contain.containing(spark.createDataFrame(docs, "d long, body string").limit(0), spark.createDataFrame(passages, "q string, hash int, t string").limit(0), "d", "body", "t").count() == 0


def plain_marks(text, terms):
    """A pattern for the row, with the same notion of bounds and case."""
    if text is None or not terms or not text:
        return text
    folded = "".join(marks.FOLDS[ord(c)] for c in text)
    pattern = "|".join(re.escape("".join(marks.FOLDS[ord(c)] for c in t)) for t in terms)
    word = "[A-Za-z0-9_]"
    bound = f"(?:(?<={word})(?!{word})|(?<!{word})(?={word}))"
    out, at = [], 0
    for m in re.finditer(f"{bound}(?:{pattern}){bound}", folded):
        out += [(text[at : m.start()], False), (text[m.start() : m.end()], True)]
        at = m.end()
    if not out:
        return text
    return "".join(f"<mark>{p}</mark>" if p.lower() in terms else p for p in [x for x, _ in out] + [text[at:]])


def test_marks_against_a_pattern(spark):
    rng = random.Random(6)
    words = ["tax", "Taxes", "été", "ÉTÉ", "straße", "STRASSE", "ab1", "a_b", "re", "retax", "tax-free", "ſtax", "Ωmega", "ωMEGA", "\U00010400x", "the", "and"]
    rows = [(i, rng.choice(["", " ", "-"]).join(rng.choices(words, k=rng.randint(0, 12))), " ".join(rng.choices(words, k=rng.randint(0, 5)))) for i in range(600)]
    rows += [(i + 600, rows[0][1], q) for i, (_, _, q) in enumerate(rows[:60])] + [(900, None, "tax"), (901, "tax", None), (902, "tax taxes retax", "tax taxes"), (903, "taxététax", "tax été"), (904, "TAX_tax tax", "tax")]
    df = spark.createDataFrame(rows, "i int, t string, q string").withColumn("terms", T.query_terms(F.col("q")))
    got = {r.i: (r.m, r.t, r.terms) for r in df.select("i", "t", "terms", marks.highlighted(F.col("t"), F.col("q")).alias("m")).collect()}
    assert len(got) == len(rows) and sum("<mark>" in (m or "") for m, _, _ in got.values()) > 150
    for m, t, terms in got.values():
        assert m == plain_marks(t, terms)
    assert got[902][0] == "<mark>tax</mark> <mark>taxes</mark> retax" and got[904][0] == "TAX_tax <mark>tax</mark>" and got[903][0] == "<mark>tax</mark><mark>été</mark><mark>tax</mark>"


@pytest.mark.parametrize(("text", "shown"), [("Tax and taxes", "<mark>Tax</mark> and taxes"), ("", ""), ("the and", "the and")])
def test_marks_as_the_column_function(spark, text, shown):
    df = spark.createDataFrame([(text, "tax and")], "t string, q string")
    assert df.select(marks.highlighted(F.col("t"), F.col("q"))).first()[0] == shown == df.select(T.highlighted(F.col("t"), F.col("q"))).first()[0]
