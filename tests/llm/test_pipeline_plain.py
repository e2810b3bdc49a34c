"""The pipeline and the classifier against plain versions on a small table."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from tokenizers import Tokenizer

import corpus_pipeline
from docketlake.llm import op8, quality
from docketlake.llm.op3 import vocabulary


def write(spark, folder, rows, labels):
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")


def table():
    rng = random.Random(12)
    word = lambda: "".join(rng.choice("abcdeiou") for _ in range(rng.randint(2, 8)))
    rows = []
    for i in range(240):
        text = " ".join(word() for _ in range(rng.randint(20, 60))).capitalize() + "."
        if i % 5 == 4:
            text = " ".join(f"{w.upper()}!!" for w in text.split())
        elif i % 8 == 3 and i % 5 != 2:
            text = rows[i - 3][1].replace("\nShared menu", "") + (" end" if i % 16 == 3 else "")
        if i % 7 < 3:
            text += "\nShared menu"
        rows.append((i, text, "en", f"site{i % 12}" if i % 50 else None, len(text)))
    rows += [(900, "", "en", "site1", 0), (901, None, "en", None, None)]
    return rows, [(i, int(i % 5 != 4), 0) for i in range(240)]


def plain_model(rows, labels):
    good = {i for i, y, _ in labels if y == 1}
    learnt = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 5]
    x = np.array([np.append(np.rint(quality.features(pa.array([r[1]], pa.string()))[0].astype(float) * quality.GRID), quality.GRID) for r in learnt]) / quality.GRID
    p = x[[r[0] in good for r in learnt]]
    s = x.T @ x / len(x) + (quality.RIDGE + quality.RIDGE_OF_ONE / len(p)) * np.eye(x.shape[1])
    direction = np.linalg.solve(s, p.mean(0))
    prior = min(0.99, 1 / (p.mean(0) @ direction))
    return direction, prior, x, p


def test_the_classifier_equals_a_plain_fit(spark, tmp_path):
    rows, labels = table()
    write(spark, tmp_path, rows, labels)
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    model = op8.fitted(docs, str(tmp_path))
    direction, prior, x, p = plain_model(rows, labels)
    assert abs(model.prior - prior) < 1e-9
    closed = 2 * prior * direction
    closed[-1] -= 1
    one = np.eye(len(closed))[-1]
    risk = lambda w: prior * ((p @ w - 1) ** 2).mean() / 4 + max(0, ((x @ w + 1) ** 2).mean() / 4 - prior * ((p @ w + 1) ** 2).mean() / 4)
    assert risk(model.weights) <= risk(closed) + 1e-9 and risk(model.weights) < risk(one)
    for r in quality.score(docs, model).collect():
        margin = quality.features(pa.array([r.text], pa.string()))[0].astype(float) @ model.weights[:-1] + model.weights[-1]
        assert abs(r.score - 1 / (1 + np.exp(-quality.STEEP * margin / 2))) < 1e-9
    scores = {r.doc_id: r.score for r in quality.score(docs, model).collect()}
    held = [(scores[i] >= op8.THRESHOLD) == bool(y) for i, y, _ in labels if zlib.crc32(str(i).encode()) % 5 == 0]
    assert np.mean(held) > 0.95


def shingles(text):
    w = text.lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def test_the_pipeline_equals_a_plain_one(spark, tmp_path):
    rows, labels = table()
    write(spark, tmp_path, rows, labels)
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet").select(*corpus_pipeline.COLUMNS)
    model = op8.fitted(docs.select("doc_id", "text"), str(tmp_path))
    kept = [r for r in rows if model.score(quality.features(pa.array([r[1]], pa.string())))[0] >= op8.THRESHOLD]
    sites = defaultdict(set)
    for _, text, _, source, _ in kept:
        for line in (text or "").split("\n"):
            if source is not None and line.strip():
                sites[line.strip()].add(source)
    assert len(sites["Shared menu"]) >= 10
    lean = [(i, None if t is None else "\n".join(x for x in t.split("\n") if len(sites[x.strip()]) < 10), s) for i, t, _, s, _ in kept]
    sets, root = [shingles(t or "") for _, t, _ in lean], list(range(len(lean)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for i in range(len(lean)):
        for j in range(i):
            if sets[i] and sets[j] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) - 1e-9:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    single = {lean[k][0]: lean[k] for k in range(len(lean)) if find(k) == k}
    assert len(single) < len(lean) < len(rows)

    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    copies = Counter(r.doc_id for r in out)
    assert set(copies) <= set(single) and max(copies.values()) <= 2
    library = Tokenizer.from_file(vocabulary())
    for r in out:
        ids = library.encode(single[r.doc_id][1] or "", add_special_tokens=False).ids
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
    # words of each source come near their targets
    size, taken, largest = Counter(), Counter(), Counter()
    for i, t, s in single.values():
        n = len((t or "").split())
        size[s] += n
        taken[s] += n * copies[i]
        largest[s] = max(largest[s], n)
    order = sorted(s for s in size if s is not None) + [None]
    weight, capped = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}, set()
    while True:
        free = [s for s in order if s not in capped]
        level = (1.5 * sum(size.values()) - sum(2 * size[s] for s in capped)) / sum(weight[s] for s in free) if free else 0
        above = {s for s in free if weight[s] * level > 2 * size[s]}
        if not above:
            break
        capped |= above
    for s in order:
        target = 2 * size[s] if s in capped else weight[s] * level
        assert abs(taken[s] - target) <= largest[s]
