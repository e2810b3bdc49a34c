"""Tiles of large buckets and regions: two rows each, so that rows go with the blocks of a group and not with its members times its blocks."""

import random

import pytest

from docketlake.llm import jaccard


@pytest.mark.parametrize("trees", [32, 48])
def test_a_tile_is_two_rows_and_no_link_is_lost(spark, monkeypatch, trees):
    rng = random.Random(5)
    base = [f"w{i}" for i in range(120)]
    texts = []
    for i in range(150):
        words = list(base)
        words[rng.randrange(120)] = f"x{i}"
        texts.append(" ".join(words))
    texts += [" ".join(rng.choices(base, k=40)) for _ in range(40)] + [texts[0]]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    needed, tile = jaccard._needed, jaccard._tile

    def two_of(table):
        if table.num_rows > 2:
            raise AssertionError(f"{table.num_rows} rows in a tile")
        return table

    monkeypatch.setattr(jaccard, "_needed", lambda table: needed(two_of(table)))
    monkeypatch.setattr(jaccard, "_tile", lambda threshold: lambda table: tile(threshold)(two_of(table)))
    got = {r.doc_id: (r.class_id, r.n_links) for r in jaccard.join(df, trees=trees, block=16).collect()}

    grams = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (t.split() for t in texts)]
    links = {i: {j for j in range(len(texts)) if j != i and len(grams[i] & grams[j]) >= 0.8 * len(grams[i] | grams[j])} for i in range(len(texts))}
    assert {i: n for i, (_, n) in got.items()} == {i: len(links[i]) for i in links}
    assert sum(map(len, links.values())) > 150 * 100
    parent = list(range(len(texts)))
    for _ in texts:
        parent = [min([parent[i], *(parent[j] for j in links[i])]) for i in range(len(texts))]
    assert {i: c for i, (c, _) in got.items()} == dict(enumerate(parent))
