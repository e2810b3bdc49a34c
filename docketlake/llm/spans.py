"""Substring dedup by sliding runs of consecutive sentences.

A text falls into sentences, ended by . ! ? or a line break. From each sentence the shortest run of at least ``least`` sentences and ``words`` words that
starts there is hashed, and the shortest that ends there. A run that stands in several documents is repeated; the document with the
least key holds the first, and within a document the first place does. Sentences under any run that is not the first are covered, and go.

A passage may also stand elsewhere from the middle of a sentence on, or without any marks. So a sentence of more than half of ``most`` words is cut into
pieces at places that its words choose, of every that many neighbouring places the one where the hash of the words at both sides is
least: copies are cut alike wherever they start. Runs with such pieces are hashed too. As pieces are no sentences, units under them go only in a
stretch of covered units of at least ``stretch`` words, which a passage of over 50 words is sure to have, but for 12 words at most at
each end. A text with neither is left alone.

Documents are scanned once for their runs, which are kept as (hash, key), and a second time to rewrite those that hold a repeated
run; only their texts are shuffled. A bounded bitmap chooses them before the exact join.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import bitmap, checkpoint, free_name, map_batches, marked, mix64, named, slices, word_hashes

LEAST, WORDS, MOST = 2, 15, 25
#: Words of a stretch with pieces of sentences that goes: those of over 50 that whole units are sure to hold.
STRETCH = 27
#: Sets runs with pieces apart from runs of sentences.
PIECES = np.uint64(0x94D049BB133111EB)
#: The key that stands for null: such rows are one last document.
NO_KEY = (1 << 63) - 1
#: Windows that are compared at a time.
CHUNK = 1 << 16

SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
CLOSERS = np.zeros(256, bool)
CLOSERS[[ord(c) for c in "\"')]"]] = True
ENDS = np.zeros(256, bool)
ENDS[[ord(c) for c in ".!?"]] = True


@dataclass
class Units:
    """The units of some texts, one after another: sentences, or pieces of long ones."""

    bounds: np.ndarray  # byte of the text where a unit begins; the end of the last unit of a text is the text's
    counts: np.ndarray  # words of a unit
    hashes: np.ndarray
    first: np.ndarray  # number of the first unit of each text, and of the one after the last text
    whole: np.ndarray  # whether a unit begins a sentence

    def pieces(self, i: int, text: bytes) -> list[bytes]:
        at = [*self.bounds[self.first[i] : self.first[i + 1]].tolist(), len(text)]
        return [text[a:b] for a, b in zip(at, at[1:])]


def places(hashes: np.ndarray, sentence: np.ndarray, window: int) -> np.ndarray:
    """Numbers of the words before which sentences are cut: of each ``window`` neighbouring places of a sentence that of the least hash, the last of equal ones."""
    if len(hashes) <= window:
        return np.zeros(0, np.int64)
    pair = mix64(hashes[:-1] * np.uint64(0x9E3779B97F4A7C15) + hashes[1:])
    starts = np.flatnonzero(sentence[:-window] == sentence[window:])
    view = np.lib.stride_tricks.sliding_window_view(pair, window)
    found = [starts[at : at + CHUNK] + window - np.argmin(view[starts[at : at + CHUNK], ::-1], axis=1) for at in range(0, len(starts), CHUNK)]
    return np.unique(np.concatenate([np.zeros(0, np.int64), *found]))


def units(texts: pa.Array, most: int = MOST) -> Units:
    """Units of each text, null being empty; joined, a text's units are the text. Case and spacing don't enter the hashes."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    n = len(texts)
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + n + 1]
    data = texts.buffers()[2]
    raw = np.frombuffer(data, dtype=np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    heads = offsets - offsets[0]
    space = SPACE[raw]
    before = np.ones(len(raw), bool)
    before[1:] = space[:-1]
    before[heads[:-1][heads[:-1] < len(raw)]] = True
    starts = np.flatnonzero(~space & before)
    after = np.ones(len(raw), bool)
    after[:-1] = before[1:] | space[1:]
    ends = np.flatnonzero(~space & after) + 1  # of the words
    hashes, per_text = word_hashes(texts)
    text = np.repeat(np.arange(n), per_text)
    # a word ends a sentence by its last mark, closing ones aside, or by a line break that follows
    last = ends - 1
    while len(inner := np.flatnonzero(CLOSERS[raw[last]] & (last > starts))):
        last[inner] -= 1
    breaks = np.concatenate([[0], np.cumsum(raw == 10)])
    following = np.append(starts[1:], len(raw)) if len(starts) else starts
    stop = ENDS[raw[last]] | (breaks[following] > breaks[ends])
    new = np.ones(len(starts), bool)
    new[1:] = stop[:-1] | (text[1:] != text[:-1])
    sentence = np.cumsum(new)
    begins = new.copy()
    new[places(hashes, sentence, max(1, most // 2))] = True
    at = np.flatnonzero(new)
    # a text without words is one unit of none
    bare = np.flatnonzero((per_text == 0) & (np.diff(heads) > 0))
    owner = np.concatenate([text[at], bare])
    counts = np.concatenate([np.diff(np.append(at, len(starts))), np.zeros(len(bare), np.int64)])
    begin = np.concatenate([starts[at] - heads[text[at]], np.zeros(len(bare), np.int64)]).astype(np.int64)
    place = np.arange(len(starts)) - np.repeat(at, np.diff(np.append(at, len(starts))))
    terms = mix64(hashes + place.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))
    own = np.concatenate([np.add.reduceat(terms, at) if len(at) else np.zeros(0, np.uint64), np.zeros(len(bare), np.uint64)])
    whole = np.concatenate([begins[at], np.ones(len(bare), bool)])
    order = np.argsort(owner, kind="stable")
    owner, counts, begin, own, whole = owner[order], counts[order], begin[order], own[order], whole[order]
    first = np.searchsorted(owner, np.arange(n + 1))
    begin[first[:-1][np.diff(first) > 0]] = 0  # space before the first word belongs to the first unit
    return Units(begin, counts, own, first, whole)


def _shortest(counts: np.ndarray, first: np.ndarray, least: int, words: int) -> np.ndarray:
    """(first unit, end unit) of the shortest runs from each unit and to each unit of their texts, each once and in order."""
    n = len(counts)
    if not n:
        return np.zeros((0, 2), np.int64)
    owner = np.repeat(np.arange(len(first) - 1), np.diff(first))
    low, high = first[owner], first[owner + 1]
    total = np.concatenate([[0], np.cumsum(counts)])
    unit = np.arange(n)
    stop = np.maximum(np.searchsorted(total, total[:-1] + words), unit + least)
    begin = np.minimum(np.searchsorted(total, total[1:] - words, side="right") - 1, unit + 1 - least)
    pairs = np.concatenate([np.column_stack([unit, stop])[stop <= high], np.column_stack([begin, unit + 1])[begin >= low]])
    pairs = pairs[np.lexsort((pairs[:, 1], pairs[:, 0]))]
    return pairs[np.concatenate([[True], (pairs[1:] != pairs[:-1]).any(axis=1)])] if len(pairs) else pairs


def _hashed(hashes: np.ndarray, pairs: np.ndarray) -> np.ndarray:
    """A polynomial in the units' hashes, from prefix sums; an odd factor has an inverse modulo 2**64."""
    n, factor, inverse = len(hashes), 0x9E3779B97F4A7C15, pow(0x9E3779B97F4A7C15, -1, 1 << 64)
    up = np.cumprod(np.full(n, factor, np.uint64), dtype=np.uint64)
    down = np.cumprod(np.full(n, inverse, np.uint64), dtype=np.uint64)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix64(hashes) * up, dtype=np.uint64)])
    a, b = pairs[:, 0], pairs[:, 1]
    return mix64((sums[b] - sums[a]) * down[a] + (b - a).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def runs(held: Units, least: int = LEAST, words: int = WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, first unit, end unit, whether it is one of sentences) of each run of each text, in the order of places.

    Runs of sentences come first in their place; runs of units are only those that have a piece of a sentence.
    """
    none = np.zeros(0, np.int64)
    if not len(held.counts):
        return none.astype(np.uint64), none, none, none.astype(bool)
    heads = np.flatnonzero(held.whole)
    number = np.cumsum(held.whole) - 1  # of each unit's sentence
    inside = np.arange(len(number)) - heads[number]
    # the hash of a sentence: its units' in their order, which is the unit's own where it is one
    folded = np.add.reduceat(np.where(inside > 0, mix64(held.hashes + inside.astype(np.uint64) * PIECES), held.hashes), heads)
    first = np.searchsorted(heads, held.first)
    of_sentences = _shortest(np.add.reduceat(held.counts, heads), first, least, words)
    ends = np.append(heads, len(held.counts))
    of_units = _shortest(held.counts, held.first, least, words)
    pieces = np.diff(np.append(heads, len(held.counts)))[number] > 1
    have = np.concatenate([[0], np.cumsum(pieces)])
    of_units = of_units[have[of_units[:, 1]] > have[of_units[:, 0]]]
    h = np.concatenate([_hashed(folded, of_sentences), mix64(_hashed(held.hashes, of_units) ^ PIECES)])
    a = np.concatenate([ends[of_sentences[:, 0]], of_units[:, 0]])
    b = np.concatenate([ends[of_sentences[:, 1]], of_units[:, 1]])
    sure = np.arange(len(h)) < len(of_sentences)
    order = np.lexsort((~sure, b, a))
    return h[order], a[order], b[order], sure[order]


def _scan(docs: DataFrame, options: tuple[int, int, int]) -> DataFrame:
    """h, doc, again: each distinct run of each row of docs (doc, text); and one row with ``again`` where a row repeats a run within itself."""
    least, words, most = options

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            held = units(batch.column(1), most)
            h, a, _, _ = runs(held, least, words)
            row = np.searchsorted(held.first, a, side="right") - 1
            order = np.lexsort((h, row))
            h, row = h[order], row[order]
            same = np.concatenate([[False], (h[1:] == h[:-1]) & (row[1:] == row[:-1])]) if len(h) else np.zeros(0, bool)
            twice = np.unique(row[same])
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            h, ids = np.concatenate([h[~same], np.zeros(len(twice), np.uint64)]), np.concatenate([ids[row[~same]], ids[twice]])
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(ids), pa.array(np.arange(len(h)) >= len(h) - len(twice))], names=["h", "doc", "again"])

    return docs.mapInArrow(run, "h long, doc long, again boolean")


def _covered(a: np.ndarray, b: np.ndarray, sure: np.ndarray, counts: np.ndarray, stretch: int) -> np.ndarray:
    """Which units go: those under the runs of sentences, and those under any of the runs in stretches of at least ``stretch`` words."""

    def under(some: np.ndarray) -> np.ndarray:
        depth = np.zeros(len(counts) + 1, np.int64)
        np.add.at(depth, a[some], 1)
        np.add.at(depth, b[some], -1)
        return np.cumsum(depth)[:-1] > 0

    every = under(np.ones(len(a), bool))
    edge = np.flatnonzero(np.diff(np.concatenate([[0], every.astype(np.int8), [0]])))
    total = np.concatenate([[0], np.cumsum(counts)])
    for first, last in zip(edge[::2], edge[1::2]):
        if total[last] - total[first] < stretch:
            every[first:last] = False
    return every | under(sure)


def _rewrite(options: tuple[int, int, int], stretch: int, columns: list[str], text: str, removed: str):
    least, words, most = options

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text):
            column = batch.column(columns.index(text))
            held = units(column, most)
            h, a, b, sure = runs(held, least, words)
            row = np.searchsorted(a, held.first)  # of each text, the first of its runs
            texts, gone = [], []
            for i, (old, hits) in enumerate(zip(column.to_pylist(), batch.column(batch.num_columns - 1).to_pylist(), strict=True)):
                mine = slice(row[i], row[i + 1])
                bad = np.ones(row[i + 1] - row[i], bool)
                bad[np.unique(h[mine], return_index=True)[1]] = False
                if hits:
                    bad |= np.isin(h[mine].view(np.int64), np.array(hits, np.int64))
                low = held.first[i]
                covered = _covered(a[mine][bad] - low, b[mine][bad] - low, sure[mine][bad], held.counts[low : held.first[i + 1]], stretch) if bad.any() else bad[:0]
                if covered.any():
                    pieces = held.pieces(i, old.encode())
                    old = b"".join(p for p, c in zip(pieces, covered, strict=True) if not c).decode()
                texts.append(old)
                gone.append(int(covered.sum()))
            arrays = [pa.array(texts, pa.string()) if c == text else batch.column(k) for k, c in enumerate(columns)]
            yield pa.RecordBatch.from_arrays([*arrays, pa.array(gone, pa.int64())], names=[*columns, removed])

    return run


def without_repeats(df: DataFrame, key: str = "doc_id", text: str = "text", least: int = LEAST, words: int = WORDS, most: int = MOST, removed: str = "removed_units", stretch: int = STRETCH) -> DataFrame:
    """df with ``text`` rewritten without the sentences under repeated runs that are not the first, and the long stretches under runs with pieces of sentences; ``removed_units`` counts what has gone: sentences, and the pieces of long ones.

    Rows stay one to one; a text may become empty, a null text stays null. A document is its integer key: rows with
    equal keys are one document, so they don't take text from each other; rows with a null key are one document after all
    others, which loses what another document holds and keeps what only such rows repeat. A column that is named like ``removed`` is
    replaced; names may hold dots.
    """
    options = (least, words, most)
    doc = F.coalesce(named(key).cast("long"), F.lit(NO_KEY))
    slim = df.select(doc.alias("doc"), named(text).cast("string").alias("text"))
    scanned = checkpoint(_scan(slim, options))
    every = scanned.where("NOT again").select("h", "doc")
    first = every.groupBy("h").agg(F.min("doc").alias("first"), F.max("doc").alias("last")).where("first <> last").select("h", "first")
    hits = every.join(first, "h").where("doc <> first").groupBy("doc").agg(F.collect_set("h").alias("hits"))  # as many as a document has runs at most
    touched = checkpoint(hits.join(scanned.where("again").select("doc").distinct(), "doc", "full"))
    which = df.sparkSession.sparkContext.broadcast(bitmap(touched.select(F.xxhash64("doc").alias("m")), "m"))

    columns = [c for c in df.columns if c != removed]
    source = df.select(*map(named, columns)).withColumn(text, named(text).cast("string"))
    mark, hit, number = free_name(source, "mark"), free_name(source, "hits_"), free_name(source, "doc_")
    tagged = source.withColumn(mark, F.xxhash64(doc))

    @F.pandas_udf("boolean")
    def perhaps(marks: pd.Series) -> pd.Series:
        return pd.Series(marked(which.value, marks.to_numpy()))

    kept = [named(c) for c in columns]
    held = tagged.where(perhaps(F.col(mark))).withColumn(number, doc)
    held = held.join(touched.select(F.col("doc").alias(number), F.col("hits").alias(hit)), number, "left").select(*kept, hit)
    out = T.StructType([*source.schema.fields, T.StructField(removed, T.LongType())])
    held = map_batches(held, _rewrite(options, stretch, columns, text, removed), out)
    free = tagged.where(~perhaps(F.col(mark))).select(*kept, F.lit(0).cast("long").alias(removed))
    return held.unionByName(free)
