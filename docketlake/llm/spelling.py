"""Spelling variants: words at distance one, by a self-join of a prefix-partitioned vocabulary trie with active-node sets.

* Two words are near if one inserted, deleted or replaced code point makes one of the other. Where the shorter of the two has m code points, the edit
  lies, read from the left, at the first place where they differ; before it the words agree, and after it they agree too.
* So the places of the edit are dealt to windows: a word, as one of length m or of m + 1, goes to the partition of those words that agree
  with it before the window and after it. There are two windows at first, that is tries parted by the first half and by the last half of the words. A
  partition that holds more than ``most`` words is parted again by the halves of its window, until it does not or the window is
  one place wide, when the alphabet bounds it. No partition is cut short.
* A partition's task builds the trie of what stands in the window, and hands down from each node to its children the active nodes,
  those at distance one or less. A terminal with an active terminal at distance one is a pair, which is given by the window of its edit alone.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import checkpoint, few_rows, named, slices
from ._tokens import byte_runs
from .components import dealt_join, heavy

#: A document in this many loses a letter of a word, so that there are variants to find; 0: none does.
SPOIL = 199
LEAST_LENGTH, LEAST_COUNT, RATIO = 6, 5, 5
#: Words of a partition from which it is parted again.
MOST = 4096
#: Text bytes of a slice; larger than elsewhere, as the words of a slice are counted together.
SLICE = 8 << 20


def _member(raw: np.ndarray) -> np.ndarray:
    """ASCII letters, and U+00C0 to U+00FF, which are all the characters that begin with the byte C3."""
    low = raw | 32
    out = (low >= 97) & (low <= 122) & (raw < 128) | (raw == 0xC3)
    out[1:] |= raw[:-1] == 0xC3
    return out


def _code_points(words: pa.Array) -> np.ndarray:
    return pc.utf8_length(words.cast(pa.large_string())).to_numpy(zero_copy_only=False)


def _crc_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(0xEDB88320), table >> 1).astype(np.uint32)
    return table


_CRC = _crc_table()


def crc_after(prefixes: np.ndarray, lengths: np.ndarray, own: np.ndarray) -> np.ndarray:
    """crc32 of prefix + word from crc32 of each prefix, and length in bytes and crc32 of each word: the prefix is moved on by so many zero bytes."""
    out = np.empty(len(prefixes), np.uint32)
    order = np.argsort(lengths, kind="stable")
    moved, done = prefixes[order].astype(np.uint32), 0
    bounds = lengths[order]
    for length in np.unique(bounds).tolist():
        at = int(np.searchsorted(bounds, length))
        for _ in range(length - done):  # all words at least so long, one byte further
            moved[at:] = (moved[at:] >> np.uint32(8)) ^ _CRC[moved[at:] & np.uint32(0xFF)]
        done = length
    out[order] = moved
    return out ^ own.astype(np.uint32)


def _spoilt(spoil: int, least: int):
    """word, n: how often each word of at least ``least`` code points stands in a slice, after one in ``spoil`` pairs of document and word has lost a letter."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", SLICE):
            runs, counts = byte_runs(batch.column(1), _member)
            parents = np.repeat(np.arange(len(counts)), counts)
            long = np.flatnonzero(pc.binary_length(runs).to_numpy(zero_copy_only=False) >= least)
            coded = runs.take(pa.array(long)).dictionary_encode()
            enough = _code_points(coded.dictionary) >= least
            codes = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
            keep = enough[codes] if len(codes) else np.zeros(0, bool)
            pairs, times = np.unique(parents[long][keep] * max(1, len(enough)) + codes[keep], return_counts=True)
            rows, codes = pairs // max(1, len(enough)), pairs % max(1, len(enough))
            total, odd = np.zeros(len(enough), np.int64), []
            if spoil:
                names = coded.dictionary.to_pylist()
                heads = np.array([zlib.crc32(f"{'' if i is None else i}:".encode()) for i in batch.column(0).to_pylist()], np.uint32)
                own = np.array([zlib.crc32(w) for w in names], np.uint32)
                lengths = pc.binary_length(coded.dictionary).to_numpy(zero_copy_only=False).astype(np.int64)
                h = crc_after(heads[rows], lengths[codes], own[codes])
                hit = h % np.uint32(spoil) == 0
                for c, n, value in zip(codes[hit].tolist(), times[hit].tolist(), h[hit].tolist(), strict=True):
                    word = names[c].decode()
                    if len(word) > least:
                        place = value % len(word)
                        odd.append((word[:place] + word[place + 1 :], n))
                codes, times = codes[~hit], times[~hit]
            np.add.at(total, codes, times)
            some = np.flatnonzero(total)
            words = pa.concat_arrays([coded.dictionary.take(pa.array(some)).cast(pa.large_string()), pa.array([w for w, _ in odd], pa.large_string())])
            yield pa.RecordBatch.from_arrays([words.cast(pa.string()), pa.array(np.concatenate([total[some], np.array([n for _, n in odd], np.int64)]))], names=["word", "n"])

    return run


def vocabulary(docs: DataFrame, key: str = "doc_id", text: str = "text", spoil: int = SPOIL, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT) -> DataFrame:
    """word, n: the words of at least ``least_length`` code points that occur ``least_count`` times or more."""
    slim = docs.select(named(key).cast("long").alias("id"), named(text).cast("string").alias("text"))
    return slim.mapInArrow(_spoilt(spoil, least_length), "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)


class Trie:
    """A trie of distinct strings; a node is a number, with its children by letter and the string that ends there, or -1."""

    def __init__(self, strings: list[str]):
        self.children: list[dict[str, int]] = [{}]
        self.ends: list[int] = [-1]
        for i, s in enumerate(strings):
            node = 0
            for c in s:
                down = self.children[node].get(c)
                if down is None:
                    down = self.children[node][c] = len(self.children)
                    self.children.append({})
                    self.ends.append(-1)
                node = down
            self.ends[node] = i

    def near_pairs(self) -> Iterator[tuple[int, int]]:
        """Pairs of strings at distance one, each once.

        At distance 0 of a node is the node alone. Its child's active nodes are: the child's children and the node, an insertion
        and a deletion; the child's siblings, a replacement; and, with one edit spent, the same letter's child of each active node.
        """
        children, ends = self.children, self.ends
        stack = [(0, set(children[0].values()))]  # a node and the active nodes at distance one
        while stack:
            node, active = stack.pop()
            own = ends[node]
            if own >= 0:
                for a in active:
                    if ends[a] > own:
                        yield own, ends[a]
            down = children[node]
            siblings = set(down.values())
            for c, child in down.items():
                new = {b for a in active if (b := children[a].get(c)) is not None}
                new |= siblings
                new.update(children[child].values())
                new.add(node)
                new.discard(child)
                stack.append((child, new))


def _parted(rows: DataFrame) -> DataFrame:
    """word, n, m, low, high, part: rows (word, n, m, low, high) with the partition of the words that agree before place ``low`` and after ``high``."""
    after = F.col("high") + F.length("word") - F.col("m")
    before = F.substring(F.col("word"), F.lit(1), F.col("low"))
    behind = F.substring(F.col("word"), after + 1, F.length("word"))
    return rows.withColumn("part", F.xxhash64("m", "low", "high", before, F.lit("/"), behind))


def _halves(rows: DataFrame) -> DataFrame:
    middle = F.floor((F.col("low") + F.col("high")) / 2).cast("int")
    windows = F.array(F.struct(F.col("low").alias("low"), middle.alias("high")), F.struct(middle.alias("low"), F.col("high").alias("high")))
    return rows.select("word", "n", "m", F.explode(windows).alias("w")).select("word", "n", "m", "w.low", "w.high")


def partitions(words: DataFrame, most: int = MOST) -> DataFrame:
    """part, m, low, high, held: the partitions of words (word, n) with more than one word, one of them of m code points; held is a list of (word, n).

    A partition with more than ``most`` words has a window of one place.
    """
    length = F.length("word")
    as_shorter = words.select("word", "n", length.alias("m"), F.lit(0).alias("low"), length.alias("high"))
    as_longer = words.where(length > 1).select("word", "n", (length - 1).alias("m"), F.lit(0).alias("low"), (length - 1).alias("high"))
    rows = _parted(_halves(as_shorter.unionByName(as_longer)))
    done = None
    while True:
        wide = few_rows(checkpoint(rows.where("high - low > 1").groupBy("part").agg(F.count("*").alias("_n")).where(F.col("_n") > most).select("part", F.lit(True).alias("_wide"))))
        if wide.isEmpty():
            done = rows if done is None else done.unionByName(rows)
            break
        marked = rows.join(wide, "part", "left")
        small = marked.where("_wide IS NULL").drop("_wide")
        done = small if done is None else done.unionByName(small)
        rows = checkpoint(_parted(_halves(marked.where("_wide").drop("_wide", "part"))))
    return done.groupBy("part", "m", "low", "high").agg(F.collect_list(F.struct("word", "n")).alias("held"), F.min(F.length("word")).alias("_least")).where((F.size("held") > 1) & (F.col("_least") == F.col("m"))).drop("_least")


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """word, other, other_n: the near pairs of each partition whose edit lies in its window, both ways."""
    for batch in batches:
        out: list[tuple[str, str, int]] = []
        for r in batch.to_pylist():
            m, low, high = r["m"], r["low"], r["high"]
            by_middle: dict[tuple[str, str], dict[str, tuple[str, int]]] = {}
            for h in r["held"]:  # the hash of a partition may stand for several, which are told apart here
                w = h["word"]
                after = high + len(w) - m
                by_middle.setdefault((w[:low], w[after:]), {})[w[low:after]] = (w, h["n"])
            for own in by_middle.values():
                middles = list(own)
                for i, j in Trie(middles).near_pairs() if len(middles) > 1 else ():
                    a, b = middles[i], middles[j]
                    shorter = min(len(a), len(b))
                    if shorter == high - low:
                        first = next((k for k in range(shorter) if a[k] != b[k]), shorter)
                        if low + first < high or high == m:  # an edit right behind the window is the next one's
                            (v, n), (w, k) = own[a], own[b]
                            out += [(v, w, k), (w, v, n)]
        yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.string()), pa.array([o[1] for o in out], pa.string()), pa.array([o[2] for o in out], pa.int64())], names=["word", "other", "other_n"])


def near_pairs(words: DataFrame, most: int = MOST) -> DataFrame:
    """word, other, other_n: each pair of words (word, n) at distance one, both ways."""
    return partitions(words, most).select("m", "low", "high", "held").mapInArrow(_pairs, "word string, other string, other_n long")


def _roots(forms: DataFrame) -> DataFrame:
    """word, root of forms (word, form): a form's count grows at each step, so chains are short; each round doubles what has been followed."""
    state = checkpoint(forms.select("word", F.col("form").alias("root")))
    while True:
        further = state.select(F.col("word").alias("root"), F.col("root").alias("far"))
        new = dealt_join(state, further, "root", "word", few_rows(heavy(state, "root")), "left")
        new = checkpoint(new.select("word", F.coalesce("far", "root").alias("root"), F.col("far").isNotNull().alias("moved")))
        state = new.select("word", "root")
        if new.where("moved").isEmpty():
            return state


def variants(words: DataFrame, ratio: int = RATIO, most: int = MOST) -> DataFrame:
    """word, form, root, n, n_near, form_n: one row for each of words (word, n; words distinct and not null).

    ``form`` is the near word of largest n, of equal ones the least in code-point order, if its n is ``ratio`` (2 at least) times the word's
    or more; ``root`` is what forms lead to in the end, the word itself if it has none. No words, no rows.
    """
    if ratio < 2:
        raise ValueError("the ratio must be 2 at least, so that forms lead upwards")
    words = checkpoint(words.select("word", "n"))
    near = near_pairs(words, most).groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("k"), F.col("other").alias("form"))).alias("best"))
    joined = words.join(near, "word", "left").withColumn("form_n", -F.col("best.k"))
    fits = F.col("form_n") >= ratio * F.col("n")
    own = checkpoint(joined.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(fits, F.col("best.form")).alias("form"), F.when(fits, F.col("form_n")).alias("form_n")))
    roots = _roots(own.where(F.col("form").isNotNull()).select("word", "form"))
    return own.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def grouped(docs: DataFrame, key: str = "doc_id", text: str = "text", spoil: int = SPOIL, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT, ratio: int = RATIO, most: int = MOST) -> DataFrame:
    """The variants of the words of docs: runs of ASCII letters and U+00C0 to U+00FF, of which only A-Z are lower-cased.

    Of one pair of document and word in ``spoil``, by the crc32 of key and word, the word loses a letter everywhere in the document. Null and
    empty texts have no words; a null key counts as empty in the crc32. Rows that repeat a key count each.
    """
    return variants(vocabulary(docs, key, text, spoil, least_length, least_count), ratio, most)
