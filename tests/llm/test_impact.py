"""Ranked lexical search: equal to scoring every document; odd input; the search ends early."""

import math
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from docketlake.llm import impact

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOW = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def terms(text):
    return TERM.findall((text or "").translate(LOW))


def plain(docs, items, k):
    held = [(d, terms(t)) for d, t in docs]
    held = [(d, t) for d, t in held if t]
    n, all_terms = len(held), sum(len(t) for _, t in held)
    out = []
    for item, query in items:
        scores = []
        for d, t in held:
            score = 0
            for q in terms(query):
                df, tf = sum(q in set(x) for _, x in held), t.count(q)
                if tf:
                    m = 100 - 25 + (25 * len(t) * n) // all_terms
                    score += math.floor(1000 * math.log((2 * n + 2) / (2 * df + 1))) * ((1000000000 * tf) // (1000 * tf + 12 * m))
            if score > 0:
                scores.append((-score, d is None, d or 0))
        out += [(item, i, None if none else d, -s) for i, (s, none, d) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out, key=repr)


def got(spark, docs, items, **options):
    d, i = spark.createDataFrame(docs, "doc_id long, text string").repartition(3), spark.createDataFrame(items, "item_id long, text string")
    return sorted((tuple(r) for r in impact.search(d, i, **options).select("item_id", "rank", "doc_id", "score").collect()), key=repr)


def texts(seed, n, vocabulary=60, longest=80):
    rng = random.Random(seed)
    words = [rng.choice(["Ab", "zé", "x9", "Ünd", "qq"]) + str(int(rng.paretovariate(0.6)) % vocabulary) for _ in range(vocabulary)]
    return [rng.choice([" ", "-", "\n", "\x00"]).join(rng.choices(words, weights=[1 / (i + 1) for i in range(vocabulary)], k=rng.randint(0, longest))) for _ in range(n)]


@pytest.mark.parametrize("options", [{}, {"postings": 300, "batch_items": 4}, {"batch_terms": 30, "postings": 40}])
def test_against_every_score(spark, options):
    docs = [(7 * i % 211, t) for i, t in enumerate(texts(1, 210))] + [(500 + i, texts(1, 210)[3]) for i in range(30)]
    items = list(enumerate(texts(2, 14, longest=25)))
    assert got(spark, docs, items, k=5, **options) == plain(docs, items, 5)


def test_odd_rows(spark):
    docs = [(1, None), (2, ""), (3, " \n-;"), (4, "Straße ÉTÉ été"), (4, "Straße ÉTÉ été"), (None, "Straße"), (5, "a " * 5000 + "STRASSE straße"), (6, "été"), (None, None)]
    items = [(1, "été"), (1, "été été STRASSE"), (2, None), (3, ""), (None, "straße"), (4, "nowhere")]
    assert got(spark, docs, items, k=3) == plain(docs, items, 3)
    assert got(spark, [], items) == [] and got(spark, docs, []) == []
    named = spark.createDataFrame([(1, "one", 2), (2, "two", 3)], "`d.k` long, `t x` string, n int")
    out = impact.search(named, spark.createDataFrame([(9, "two")], "`rank.of` long, codes string"), key="d.k", text="t x", item="rank.of", query="codes")
    assert out.columns == ["rank.of", "rank", "d.k", "score"] and [(r[0], r[1], r[2]) for r in out.collect()] == [(9, 1, 2)]


def test_ends_early():
    """With a high floor few postings are read, and what is returned is whole."""
    rng = np.random.default_rng(3)
    n, size = 2000, 40
    each = rng.integers(1, 30, n)
    codes = np.concatenate([np.sort(rng.choice(size, e, replace=False)) for e in each])
    held = impact.Slice(pa.array(range(n)), each * 3, codes, rng.integers(1, 9, len(codes)), each, n, int(each.sum() * 3))
    factors = (100_000 * 0.5 ** np.arange(size)).astype(np.int64) + 1  # few terms decide
    whole = np.zeros(n, np.int64)
    np.add.at(whole, np.repeat(np.arange(n), each), factors[held.codes] * held.impacts)
    floor = int(np.sort(whole)[-3])
    docs, scores = held.best(np.arange(size), factors, 20, floor, np.zeros(size, np.int64))
    want = np.flatnonzero(whole >= floor)
    assert set(want) <= set(docs) and (scores == whole[docs]).all() and len(docs) < n / 20
