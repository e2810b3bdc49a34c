"""Repeated sentences go whatever their number of words, from two sentences and fifteen words on; others stay."""

import random

import pytest

from docketlake.llm import spans


def sentence(rng, n):
    return " ".join("".join(rng.choices("abcdefghijklmnop", k=6)) for _ in range(n)) + "."


@pytest.mark.parametrize(("sentences", "length", "goes"), [(2, 8, True), (3, 8, True), (2, 12, True), (3, 9, True), (2, 30, True), (2, 7, False), (1, 40, False), (3, 4, False)])
def test_repeated_sentences(spark, sentences, length, goes):
    rng = random.Random(sentences * 100 + length)
    shared = " ".join(sentence(rng, length) for _ in range(sentences))
    rows, own = [], {}
    for i in range(12):
        own[i] = " ".join(sentence(rng, rng.randint(3, 20)) for _ in range(3)), " ".join(sentence(rng, rng.randint(3, 20)) for _ in range(3))
        rows.append((i, f"{own[i][0]} {shared} {own[i][1]}"))
    out = {r.doc_id: r.text for r in spans.without_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert out[0] == rows[0][1]
    if sentences == 1:  # one sentence is no run, though a long one is cut where its words say
        assert all(own[i][0] in out[i] and own[i][1] in out[i] for i in range(12))
    else:
        assert all(out[i] == (f"{own[i][0]} {own[i][1]}" if goes else rows[i][1]) for i in range(1, 12))


def test_clean_documents_stay(spark):
    rng = random.Random(1)
    words = ["".join(rng.choices("abcd", k=2)) for _ in range(16)]  # few words, short sentences
    rows = [(i, " ".join(" ".join(rng.choices(words, k=rng.randint(2, 14))) + rng.choice([".", "?", ""]) for _ in range(30))) for i in range(400)]
    out = {r.doc_id: r.text for r in spans.without_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert sum(out[i] == t for i, t in rows) >= 0.99 * len(rows)
