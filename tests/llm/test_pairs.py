"""Near duplicates, lines, spans and recordings against brute force."""

import random
import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from docketlake.llm import audio, jaccard, lines, spans
from docketlake.llm._common import word_hashes
from docketlake.llm.op4 import played

SCHEMA = "doc_id long, text string, grams string, rep string"


def words(rng, n):
    return [rng.choice("alpha beta gamma delta epsilon zeta eta theta iota kappa lamda mu".split()) + str(rng.randint(0, 40)) for _ in range(n)]


def corpus(copies=300):
    rng = random.Random(11)
    rows = [(1, None), (2, ""), (3, " "), (4, "one two"), (5, "One  two"), (6, "one two three")]
    base = words(rng, 120)
    for i in range(copies):
        w = list(base)
        for _ in range(rng.randint(0, 4)):
            w[rng.randrange(len(w))] = f"x{rng.randint(0, 999)}"
        rows.append((100 + i, " ".join(w)))
    for i in range(60):
        w = words(rng, rng.randint(5, 80))
        rows += [(1000 + 3 * i, " ".join(w)), (1001 + 3 * i, " ".join(w[1:])), (1002 + 3 * i, " ".join(w))]
    return [*rows, (1002, rows[-1][1]), (None, "one two")]


def shingles(text):
    w = (text or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


@pytest.mark.parametrize(("small", "block"), [(64, 256), (10, 32)])
def test_join_equals_all_pairs(spark, small, block):
    rows = [r for r in corpus() if r[0] is not None]
    df = spark.createDataFrame([(i, t, "g", "r") for i, t in [*rows, (None, "one two")]], SCHEMA)
    got = jaccard.join(df, small_bucket=small, block=block).collect()
    assert len(got) == len(rows) + 1
    sets = [shingles(t) for _, t in rows]
    links = [0] * len(rows)
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if a and b and len(a & b) >= 0.8 * len(a | b) - 1e-9:
                links[i] += 1
                links[j] += 1
                p, q = root(i), root(j)
                parent[max(p, q)] = min(p, q)
    least = defaultdict(lambda: 10**9)
    for i in range(len(rows)):
        least[root(i)] = min(least[root(i)], rows[i][0])
    want = sorted((rows[i][0], least[root(i)], links[i]) for i in range(len(rows)))
    assert sorted((r.doc_id, r.class_id, r.n_links) for r in got if r.doc_id is not None) == want


def test_one_of_each_group_stays(spark):
    df = spark.createDataFrame([(i, t, "g", "r") for i, t in corpus(20)], SCHEMA)
    kept = [r.doc_id for r in jaccard.one_per_group(df).collect()]
    assert {1, 2, 3, 4, 6, 100}.issubset(kept) and 5 not in kept and None in kept and kept.count(1002) == 0
    assert jaccard.one_per_group(df).columns == df.columns
    assert jaccard.join(df.limit(0)).count() == 0


def test_prefixes_shorten_until_the_recall():
    k = jaccard.prefix_depth()
    assert 1 - (1 - 0.8**k) ** jaccard.TREES >= jaccard.RECALL > 1 - (1 - 0.8 ** (k + 1)) ** jaccard.TREES
    with pytest.raises(ValueError):
        jaccard.prefix_depth(trees=1, recall=0.999)


def test_lines_equal_brute_force(spark):
    rng = random.Random(2)
    rows = []
    for i in range(300):
        part = [f"own {i} {k}" for k in range(3)] + [f" common {min(rng.randint(0, 60), rng.randint(0, 60))}\r" for _ in range(4)] + [""]
        rng.shuffle(part)
        rows.append((i, f"s{rng.randint(0, 14)}" if i % 9 else None, "\n".join(part)))
    rows += [(900, "s1", None), (901, "s1", ""), (902, None, "common 1"), (3, rows[3][1], rows[3][2])]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string")
    sites = defaultdict(set)
    for _, s, t in rows:
        if s is not None:
            for x in (t or "").split("\n"):
                sites[x.strip()].add(s)
    gone = {x for x, s in sites.items() if x and len(s) >= 10}
    assert 5 < len(gone) < 55
    want = sorted(((i, s, None if t is None else "\n".join(x for x in t.split("\n") if x.strip() not in gone)) for i, s, t in rows), key=repr)
    out = lines.without_boilerplate(df)
    assert sorted(((r.doc_id, r.source, r.text) for r in out.collect()), key=repr) == want
    plan = out._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
    assert lines.without_boilerplate(df.limit(0)).count() == 0


def plain_units(text):
    """(units, their words in lower case, whether each begins a sentence), word by word."""
    cut, words, starts = [], [], []
    for m in re.finditer(r"[^ \t\n\x0b\x0c\r]+", text):
        starts.append(m.start())
        words.append(m[0].lower())
    ends = [bool(re.search(r"[.!?][\"')\]]*$", w)) or "\n" in text[s + len(w) : t] for w, s, t in zip(words, starts, [*starts[1:], len(text)])]
    pair = spans.mix64(word_hashes(pa.array([" ".join(words)]))[0][:-1] * np.uint64(0x9E3779B97F4A7C15) + word_hashes(pa.array([" ".join(words)]))[0][1:]) if len(words) > 1 else []
    at, heads = 0, set()
    while at < len(words):
        stop = next((k + 1 for k in range(at, len(words)) if ends[k]), len(words))
        cut.append(at)
        heads.add(at)
        for s in range(at, stop - 12):
            cut.append(max(range(s, s + 12), key=lambda k: (-int(pair[k]), k)) + 1)
        at = stop
    cut = sorted(set(cut))
    if not cut:
        return ([text], [()], [True]) if text else ([], [], [])
    marks = [0, *(starts[c] for c in cut[1:]), len(text)]
    return [text[a:b] for a, b in zip(marks, marks[1:])], [tuple(words[a:b]) for a, b in zip(cut, [*cut[1:], len(words)])], [c in heads for c in cut]


@pytest.mark.parametrize("stretch", [0, spans.STRETCH])
def test_spans_equal_brute_force(spark, stretch):
    rng = random.Random(4)
    sentence = lambda: " ".join(words(rng, rng.randint(1, 40))) + rng.choice([".", "!", ", and so on.", "?\n"])
    shared = [" ".join(sentence() for _ in range(4)) for _ in range(5)]
    rows = []
    for i in range(60):
        parts = [sentence() for _ in range(rng.randint(0, 6))]
        if i % 3 == 0:
            parts.insert(rng.randint(0, len(parts)), shared[i % 5])
        if i % 20 == 0:
            parts += [shared[0], "Between.", shared[0]]
        rows.append((i if i % 13 else None, " ".join(parts)))
    rows += [(70, None), (71, ""), (72, "x" * 3000), (3, rows[3][1])]
    df = spark.createDataFrame([(i, t, "m") for i, t in rows], "doc_id long, text string, mark string")
    key = lambda i: spans.NO_KEY if i is None else i
    first, found = {}, []

    def shortest(counts):
        own = set()
        for a in range(len(counts)):
            own |= {next(((a, b) for b in range(a + 2, len(counts) + 1) if sum(counts[a:b]) >= spans.WORDS), None)}
            own |= {next(((b, a + 1) for b in range(a - 1, -1, -1) if sum(counts[b : a + 1]) >= spans.WORDS), None)}
        return own - {None}

    for i, t in rows:
        parts, keys, heads = plain_units(t or "")
        assert "".join(parts) == (t or "")
        begins = [*(n for n, h in enumerate(heads) if h), len(parts)]
        sentences = [sum(keys[x:y], ()) for x, y in zip(begins, begins[1:])]
        own = [(begins[a], begins[b], True, tuple(sentences[a:b])) for a, b in shortest([len(x) for x in sentences])]
        long = [not (heads[n] and (n + 1 == len(heads) or heads[n + 1])) for n in range(len(heads))]
        own += [(a, b, False, tuple(keys[a:b])) for a, b in shortest([len(k) for k in keys]) if any(long[a:b])]
        own.sort(key=lambda x: (x[0], x[1], not x[2]))
        found.append((i, t, parts, keys, own))
        for _, _, sure, k in own:
            first[sure, k] = min(first.get((sure, k), spans.NO_KEY), key(i))
    want = []
    for i, t, parts, keys, own in found:
        bad, sure_bad, seen = set(), set(), set()
        for a, b, sure, k in own:
            if first[sure, k] != key(i) or (sure, k) in seen:
                bad |= set(range(a, b))
                sure_bad |= set(range(a, b)) if sure else set()
            seen.add((sure, k))
        for n in sorted(bad):  # stretches that are too short stay, but for sentences
            if n - 1 not in bad:
                end = next(m for m in range(n, len(parts) + 1) if m not in bad)
                if sum(len(keys[m]) for m in range(n, end)) < stretch:
                    bad -= set(range(n, end))
        bad |= sure_bad
        want.append((i, None if t is None else "".join(p for n, p in enumerate(parts) if n not in bad), len(bad)))
    out = spans.without_repeats(df, stretch=stretch)
    assert sorted(((r.doc_id, r.text, r.removed_units) for r in out.collect()), key=repr) == sorted(want, key=repr)
    assert any(w[2] for w in want) and out.columns == ["doc_id", "text", "mark", "removed_units"]
    assert spans.without_repeats(df.limit(0)).count() == 0


def tone(seed, seconds):
    rng = np.random.default_rng(seed)
    notes = rng.integers(0, 12, int(seconds * 8))
    time = np.arange(audio.RATE // 8) / audio.RATE
    return np.concatenate([np.sin(2 * np.pi * 261.6 * 2 ** (n / 12) * time) for n in notes]) * 8000


def test_recordings_align(spark):
    a, b = tone(1, 12), tone(2, 12)
    rng = np.random.default_rng(0)
    late = np.concatenate([np.zeros(audio.HOP * 20), a[: audio.HOP * 100]]) + rng.normal(0, 100, audio.HOP * 120)
    pcm = lambda x: x.astype("<i2").tobytes()
    rows = [(1, pcm(a)), (2, pcm(late)), (3, pcm(b)), (4, pcm(a)), (5, b""), (6, None), (7, pcm(a[:200])), (None, pcm(a))]
    prints = audio.fingerprints(spark.createDataFrame(rows, "doc_id long, media binary"), "doc_id", "media")
    out = audio.align(prints, F.col("id") == 1).collect()
    classes = {r.doc_id: r.class_id for r in out if r.query_class is None}
    assert classes == {1: 1, 2: 2, 3: 3, 4: 1, 5: 5, 6: 5, 7: 7}
    matches = [r for r in out if r.query_class is not None]
    assert [(r.query_class, r.doc_id, r.offset) for r in matches] == [(1, 2, 20)] and matches[0].length >= 60
    assert audio.align(prints.limit(0), F.col("id") == 1).count() == 0


def test_search_equals_all_pairs_at_their_best_offsets():
    import pyarrow as pa

    rng = random.Random(8)
    base = words(rng, 400)
    texts = [" ".join(base), " ".join(base[100:] + words(rng, 50)), " ".join(words(rng, 300)), "short", None, " ".join(base[:200] + ["x"] + base[200:])]
    prints = audio.fingerprint_all(played(pa.array(texts)))
    assert all((audio.fingerprint(played(pa.array([t]))[0]) == p).all() for t, p in zip(texts, prints, strict=True))
    block = audio.QueryBlock(list(range(len(prints))), prints)
    for i, p in enumerate(prints):
        got = {m[0]: m for m in block.matches(p)}
        for q, other in enumerate(prints):
            best = max((((p[max(0, o) : len(other) + o] == other[max(0, -o) : len(p) - o]).sum(), -o) for o in range(-len(other) + 1, len(p))), default=(0, 0))
            if best[0] > 40 and min(len(p), len(other)) >= audio.LEAST:
                assert q in got
        if len(p) >= audio.LEAST:
            assert got[i][1] == 0 and got[i][4] == 0.0


def test_longest_stretch():
    rng = np.random.default_rng(5)
    for _ in range(200):
        e = rng.integers(0, 9, rng.integers(0, 40))
        best = max(((b - a) for a in range(len(e)) for b in range(a + 1, len(e) + 1) if e[a:b].mean() / 32 <= 0.12), default=0)
        got = audio.stretch(e, 1)
        assert (got[1] if got else 0) == best
