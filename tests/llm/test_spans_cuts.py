"""Repeated passages are found wherever they start."""

import random

import pytest

from docketlake.llm import spans

EDGE = spans.MOST // 2


def vocabulary(rng, n):
    return ["".join(rng.choices("abcdefghijklmnop", k=6)) for _ in range(n)]


def left(rows, out, passages):
    """Of each row's passage, the words that stay."""
    texts = {r.doc_id: set(r.text.split()) for r in out}
    return [sum(w in texts[i] for w in passages[i]) for i in rows]


@pytest.mark.parametrize("length", [39, 60, 120])
def test_passages_without_punctuation(spark, length):
    rng = random.Random(length)
    passage = vocabulary(rng, length)
    rows = [(i, " ".join(vocabulary(rng, i) + passage + vocabulary(rng, 40))) for i in range(60)]
    out = spans.without_repeats(spark.createDataFrame(rows, "doc_id long, text string"), stretch=0).collect()
    kept = left(range(60), out, dict.fromkeys(range(60), passage))
    assert kept[0] == length and max(kept[1:]) <= 2 * EDGE
    own = {r.doc_id: len(r.text.split()) for r in out}
    assert all(own[i] == i + 40 + k for i, k in enumerate(kept)), "words of their own stay"


def test_passages_from_mid_sentence(spark):
    rng = random.Random(3)
    prose = []
    for w in vocabulary(rng, 4000):
        prose.append(w + (rng.choice([".", ".", "?", ","]) if rng.random() < 0.08 else ""))
    rows, passages = [(0, " ".join(prose))], {}
    for i in range(1, 200):
        at, length = rng.randrange(3900), rng.randint(39, 79)
        passages[i] = prose[at : at + length]
        rows.append((i, " ".join(vocabulary(rng, rng.randint(0, 30)) + passages[i] + vocabulary(rng, rng.randint(0, 30)))))
    out = spans.without_repeats(spark.createDataFrame(rows, "doc_id long, text string"), stretch=0).collect()
    assert max(left(passages, out, passages)) <= 2 * EDGE
    assert {r.doc_id: r.text for r in out}[0] == rows[0][1]


def test_passages_of_over_fifty_words_go_and_short_ones_stay(spark):
    rng = random.Random(9)
    long, short = vocabulary(rng, 51), vocabulary(rng, 26)
    rows = [(i, " ".join(vocabulary(rng, i) + (long if i % 2 else short) + vocabulary(rng, 40))) for i in range(80)]
    out = {r.doc_id: r for r in spans.without_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(out[i].removed_units > 0 for i in range(3, 80, 2)) and out[1].removed_units == 0
    assert all(out[i].text == rows[i][1] for i in range(0, 80, 2))


def test_names_with_dots_clashes_and_very_long_texts(spark):
    rng = random.Random(10)
    long = " ".join(rng.choice(["alpha", "beta", "gamma", "delta"]) + str(rng.randint(0, 10**6)) for _ in range(200_000))
    rows = [(1, long, 5, "m"), (2, "own words " + long, 5, "m"), (3, None, 5, "m"), (4, "", 5, "m"), (5, " \n ", 5, "m")]
    df = spark.createDataFrame(rows, "`doc.id` long, `te.xt` string, removed_units int, mark string")
    out = spans.without_repeats(df, key="doc.id", text="te.xt")
    got = {r["doc.id"]: r for r in out.collect()}
    assert out.columns == ["doc.id", "te.xt", "mark", "removed_units"]
    assert got[1]["te.xt"] == long and len(got[2]["te.xt"].split()) <= 14 and got[3]["te.xt"] is None and got[4]["te.xt"] == "" and got[5]["te.xt"] == " \n "
