"""Spelling variants: equal to comparing all pairs; partitions parted again; odd input."""

import random
import re
import zlib
from collections import Counter

import pytest

from docketlake.llm import spelling

LOW = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def near(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain_words(docs, spoil=199):
    words = Counter()
    for key, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOW)
            h = zlib.crc32(f"{'' if key is None else key}:{run}".encode())
            if spoil and h % spoil == 0:
                i = h % len(run)
                run = run[:i] + run[i + 1 :]
            if len(run) >= 6:
                words[run] += 1
    return {w: n for w, n in words.items() if n >= 5}


def plain(words):
    others = {w: [v for v in words if v != w and near(v, w)] for w in words}
    best = {w: min(o, key=lambda v: (-words[v], v.encode()), default=None) for w, o in others.items()}
    form = {w: b if b is not None and words[b] >= 5 * words[w] else None for w, b in best.items()}
    out = []
    for w in words:
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, words[w], len(others[w]), words[form[w]] if form[w] else None))
    return sorted(out, key=repr)


def rows(df):
    return sorted((tuple(r) for r in df.select("word", "form", "root", "n", "n_near", "form_n").collect()), key=repr)


def texts(seed, n):
    rng = random.Random(seed)
    stems = ["".join(rng.choices("abeéÿ", k=rng.randint(5, 9))) for _ in range(40)] + ["straße×", "ÀÀÀÀÀÀÀ", "Ünderground"]
    out = []
    for i in range(n):
        picked = []
        for w in rng.choices(stems, weights=[1 / (j + 1) for j in range(len(stems))], k=rng.randint(0, 60)):
            k = rng.random()
            at = rng.randrange(len(w))
            picked.append(w if k < 0.8 else w[:at] + w[at + 1 :] if k < 0.87 else w[:at] + rng.choice("ab") + w[at:] if k < 0.94 else w[:at] + "b" + w[at + 1 :])
        out.append((i * 3, rng.choice([" ", ", ", "1", "Āā", "\n"]).join(picked)))
    return out


@pytest.mark.parametrize("most", [4096, 3])
def test_against_all_pairs(spark, most):
    docs = texts(1, 150) + [(7, "Longword longwore" * 20), (None, "Longword longword " * 9)]
    for spoil in (199, 3):
        want = plain(plain_words(docs, spoil))
        assert len(want) > 60 and any(r[1] for r in want)
        df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
        assert rows(spelling.grouped(df, spoil=spoil, most=most)) == want


@pytest.mark.parametrize("most", [1, 10, 4096])
def test_each_pair_once(spark, most):
    rng = random.Random(4)
    words = list({"".join(rng.choices("ab", k=rng.randint(1, 8))) for _ in range(250)} | {"x" * 40 + c for c in "abcdefghij"} | {c + "y" * 40 for c in "abcdefghij"} | {"á", "\U0001f600", "\U0001f601"})
    df = spark.createDataFrame([(w, i) for i, w in enumerate(words)], "word string, n long")
    got = [tuple(r) for r in spelling.near_pairs(df, most).select("word", "other").collect()]
    assert len(got) == len(set(got)) and set(got) == {(a, b) for a in words for b in words if a != b and near(a, b)}
    kept = spelling.partitions(df, most).collect()
    assert all(len(r.held) <= most or r.high - r.low <= 1 for r in kept)


def test_chain_of_forms(spark):
    words = {"aaaaaaa": 5, "aaaaaab": 30, "aaaaabb": 200, "aaaabbb": 1000, "zzzzzz": 7, "zzzzzzy": 20, "zzzzzy": 100, "zzzzzx": 100}
    assert rows(spelling.variants(spark.createDataFrame(list(words.items()), "word string, n long"))) == plain(words)
    with pytest.raises(ValueError):
        spelling.variants(spark.createDataFrame([], "word string, n long"), ratio=1)


def test_odd_rows(spark):
    docs = [(1, None), (2, ""), (3, "12 34 ;;"), (None, None), (4, "lengthy " * 3000 + "x" * 5000 + " " + "é" * 9), (5, "lenghty " * 5), (5, "lenghty " * 5), (None, "lengthy")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert rows(spelling.grouped(df, spoil=0)) == plain(plain_words(docs, 0))
    assert rows(spelling.grouped(spark.createDataFrame([], "doc_id long, text string"))) == []
    named = df.selectExpr("doc_id AS `my.id`", "text AS `my.text`", "1 AS word", "2 AS n")
    assert rows(spelling.grouped(named, "my.id", "my.text", spoil=0)) == plain(plain_words(docs, 0))
