"""Quality classifier learned from trusted positives and unlabelled text.

Features are computed over whole texts: the frequencies of pairs of neighbouring character
classes, and shares such as that of distinct words in bins. A linear margin f minimises the
non-negative unbiased risk  pi R+(f) + max(0, R-u(f) - pi R-p(f))  with the squared loss,
where pi is the class prior. With that loss all three parts are quadratic forms in the moments of the
features, so one distributed pass over all unlabelled texts and the trusted positives gathers what the fit needs: two
matrices whose size depends on the number of features only. Features are whole numbers there, so sums are exact and
do not depend on the order of rows or on which task is run again.

The prior is estimated from positives and unlabelled text alone: the share of the positives' density that fits best
into the unlabelled one by the Pearson divergence, 1 / (h' S^-1 h) with the positives' mean h and the unlabelled second moments S. Labels
other than positives are used nowhere; scores follow from the margin, whose (f + 1) / 2 estimates the probability.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import checkpoint, free_name, map_batches, named, slices, word_hashes

#: Largest number of trusted positives that training uses; all unlabelled texts count.
MAX_POSITIVES = 20_000
#: Whole numbers that a feature of 1 becomes in the moments; tasks whose moments are added at a time.
GRID, FAN = 1024, 32
#: Weight of the ridge, and what is added to it for one positive; the more there are, the less.
RIDGE, RIDGE_OF_ONE = 1e-4, 0.1
#: Steepness of scores around a probability of a half: with it a probability of 0.3 has the score 0.3.
STEEP = float(np.log(0.7 / 0.3) / 0.2)
#: Bytes of a text that are counted at a time.
WINDOW = 1 << 20

# Punctuation marks that make one class each.
MARKS = (".", ",;", "!?", "'\"", "-_", ":", "/\\", "()[]", "{}", "<>", "=+*|", "#$%&@^~`")


def _classes() -> np.ndarray:
    """The class of each byte: non-ASCII, lower, upper, digit, space, newline, other control, and groups of marks."""
    out = np.full(256, 6, dtype=np.uint8)
    out[128:] = 0
    for k, (first, last) in enumerate((("a", "z"), ("A", "Z"), ("0", "9"), (" ", " "), ("\n", "\n")), 1):
        out[ord(first) : ord(last) + 1] = k
    for k, group in enumerate(MARKS, 7):
        out[[ord(c) for c in group]] = k
    return out


CLASS = _classes()
KINDS = int(CLASS.max()) + 1
PAIRS = KINDS * KINDS
#: Bins of each share, and the shares: distinct words, the commonest word, words per text (log), letters per word, lines per word,
#: words that repeat the word before, distinct pairs of neighbours.
BINS, SHARES = 16, 7
WIDTH = PAIRS + BINS * SHARES


def _pair_counts(raw: np.ndarray) -> np.ndarray:
    """Numbers of pairs of neighbouring classes in one text, a window at a time."""
    out = np.zeros(PAIRS, np.int64)
    for at in range(0, len(raw) - 1, WINDOW):
        k = CLASS[raw[at : at + WINDOW + 1]].astype(np.uint16)
        out += np.bincount(k[:-1] * np.uint16(KINDS) + k[1:], minlength=PAIRS)
    return out


def features(texts: pa.Array) -> np.ndarray:
    """A float32 row of WIDTH features for each text; null counts as empty."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    n = len(texts)
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + n + 1]
    out = np.zeros((n, WIDTH), dtype=np.float32)
    data = texts.buffers()[2]
    raw = np.frombuffer(data, dtype=np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    bounds = offsets - offsets[0]
    words, counts = word_hashes(texts, lower=False)
    word_ends = np.cumsum(counts)
    for i in range(n):
        text = raw[bounds[i] : bounds[i + 1]]
        if len(text) > 1:
            out[i, :PAIRS] = np.sqrt(_pair_counts(text) / (len(text) - 1))
        w = words[word_ends[i] - counts[i] : word_ends[i]]
        shares = np.zeros(SHARES)
        if len(w):
            _, times = np.unique(w, return_counts=True)
            shares[0] = len(times) / len(w)
            shares[1] = times.max() / len(w)
            shares[2] = np.log2(len(w) + 1) / 20
            shares[3] = min(1.0, len(text) / len(w) / 20)
            shares[4] = min(1.0, np.count_nonzero(text == 10) / len(w))
            shares[6] = 1.0
            if len(w) > 1:
                shares[5] = np.count_nonzero(w[1:] == w[:-1]) / (len(w) - 1)
                shares[6] = len(np.unique(w[1:] * np.uint64(3) + w[:-1])) / (len(w) - 1)
        bins = np.minimum((shares * BINS).astype(np.int64), BINS - 1)
        out[i, PAIRS + np.arange(SHARES) * BINS + bins] = 0.5
    return out


@dataclass(frozen=True)
class Model:
    """A linear margin (the last weight is the bias) and the class prior."""

    weights: np.ndarray
    prior: float

    def score(self, x: np.ndarray) -> np.ndarray:
        margin = x.astype(np.float64) @ self.weights[:-1] + self.weights[-1]
        return 1.0 / (1.0 + np.exp(-np.clip(STEEP * margin / 2, -60, 60)))


NEUTRAL = Model(np.zeros(WIDTH + 1), 0.5)


def moments(x: np.ndarray) -> np.ndarray:
    """Sums of products of all pairs of features, on the grid, with a constant one last."""
    whole = np.append(np.rint(x.astype(np.float64) * GRID), np.full((len(x), 1), float(GRID)), axis=1)
    return (whole.T @ whole).astype(np.int64)  # below 2 ** 53, so exact


def gathered(rows: DataFrame, text: str, positive: str, unlabelled: str) -> dict[int, np.ndarray]:
    """role (0: unlabelled, 1: positive) -> summed moments of the rows whose flags are set; roles without rows have none.

    Each task adds up its own rows. The tasks' sums are then added FAN at a time, round by round, so no task holds more than FAN of them
    and the driver gets one for each role.
    """
    width = WIDTH + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in slices(batches, "text"):
            x = features(batch.column(0))
            for role in (0, 1):
                mine = batch.column(role + 1).to_numpy(zero_copy_only=False).astype(bool)
                if mine.any():
                    sums[role] = sums.get(role, 0) + moments(x[mine])
        for role, total in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([role], pa.int32()), pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([total.tobytes()], pa.binary())], names=["role", "part", "sums"])

    def add(table: pa.Table) -> pa.Table:
        total = np.zeros(width * width, np.int64)
        for packed in table.column("sums"):
            total += np.frombuffer(packed.as_buffer(), np.int64)
        return pa.table({"role": table.column("role").slice(0, 1), "part": pa.array([table.column("part")[0].as_py() // FAN], pa.int64()), "sums": pa.array([total.tobytes()], pa.binary())})

    schema = "role int, part long, sums binary"
    parts = checkpoint(rows.select(named(text).cast("string").alias("text"), F.col(unlabelled).alias("unlabelled"), F.col(positive).alias("positive")).mapInArrow(run, schema))
    most = parts.agg(F.max("part").alias("m")).first().m
    while most:
        parts = checkpoint(parts.groupBy("role", F.floor(F.col("part") / FAN).alias("slot")).applyInArrow(add, schema))
        most //= FAN
    table = parts.toArrow()
    return {role: np.frombuffer(packed, np.int64).reshape(width, width) for role, packed in zip(table.column("role").to_pylist(), table.column("sums").to_pylist(), strict=True)}


def nn_pu(unlabelled: np.ndarray, positive: np.ndarray, prior: float | None = None, ridge: float = RIDGE, steps: int = 500) -> tuple[np.ndarray, float]:
    """(weights with the bias last, prior) of least non-negative risk; arguments are mean second moments with a constant one as last feature.

    The unbiased risk has its least value in closed form. If the part that stands for the negatives is below 0 there, that
    solution fits the positives too closely; steps then go up that part where it is negative and down the whole
    risk elsewhere, and the best weights by the non-negative risk are kept.
    """
    width = len(unlabelled)
    held = unlabelled + ridge * np.eye(width)
    direction = np.linalg.solve(held, positive[:, -1])
    if prior is None:
        prior = float(np.clip(1.0 / max(positive[:, -1] @ direction, 1e-9), 0.01, 0.99))
    one = np.eye(width)[-1]
    w = 2 * prior * direction - one

    def parts(v: np.ndarray) -> tuple[float, float, np.ndarray, np.ndarray]:
        of = lambda m, sign: ((v - sign * one) @ m @ (v - sign * one) / 4, m @ (v - sign * one) / 2)
        (good, up), (wrong, down), (rest, all_) = of(positive, 1), of(positive, -1), of(unlabelled, -1)
        return prior * good, rest - prior * wrong, prior * up, all_ - prior * down

    best, least = w, np.inf
    for step in range(steps):
        good, negative, of_good, of_negative = parts(w)
        if good + max(0.0, negative) < least:
            best, least = w, good + max(0.0, negative)
        if step == 0 and negative >= 0:
            break
        move = -of_negative if negative < 0 else of_good + of_negative
        w = w - 0.5 / (1 + step / 20) * np.linalg.solve(held, move)
    return best, prior


def train(
    docs: DataFrame,
    labels: DataFrame,
    allowed: Callable[[Column], Column] | None = None,
    key: str = "doc_id",
    text: str = "text",
    label: str = "quality",
    max_positives: int = MAX_POSITIVES,
) -> Model:
    """Fit on all texts as unlabelled ones and on the positives: those of the smallest hashes of the key, ``max_positives`` at most.

    ``allowed`` maps the key to a condition; only rows that meet it are learned from. Rows with a
    null key or label are left out; a key labelled twice counts once, with its largest label, and of several rows of a
    positive key each counts. With no positives, or no texts, all scores are 0.5.
    """
    meets = (lambda c: F.lit(True)) if allowed is None else allowed
    slim = docs.select(named(key).alias("_k"), named(text).alias("_t")).where(F.col("_k").isNotNull())
    known = labels.select(named(key).alias("_k"), named(label).cast("int").alias("_y")).where(F.col("_k").isNotNull() & F.col("_y").isin(0, 1)).groupBy("_k").agg(F.max("_y").alias("_y"))
    positives = known.where(meets(F.col("_k")) & (F.col("_y") == 1)).orderBy(F.xxhash64(F.col("_k").cast("string"), F.lit("sample")), F.col("_k")).limit(max_positives).select("_k", F.lit(True).alias("_p"))
    positives = checkpoint(positives)
    if positives.isEmpty():
        return NEUTRAL
    # at most max_positives keys: safe to broadcast
    rows = slim.where(meets(F.col("_k"))).join(F.broadcast(positives), "_k", "left").select("_t", F.coalesce("_p", F.lit(False)).alias("_p"), F.lit(True).alias("_u"))
    sums = gathered(rows, "_t", "_p", "_u")
    if len(sums) < 2:
        return NEUTRAL
    # the corner of the moments holds the number of rows, times the square of the grid
    weights, prior = nn_pu(*(sums[role] / sums[role][-1, -1] for role in (0, 1)), ridge=RIDGE + RIDGE_OF_ONE * GRID**2 / sums[1][-1, -1])
    return Model(weights, prior)


def score(df: DataFrame, model: Model, text: str = "text", name: str = "score") -> DataFrame:
    """Append the probability of label 1 of each whole text; null and empty texts get one too. One pass, no shuffle.

    A column of that name is replaced; all others stay, whatever their names.
    """
    kept = [c for c in df.columns if c != name]
    source = df.select(*map(named, kept))
    work = free_name(source, "quality_text")
    schema = T.StructType([*source.schema.fields, T.StructField(name, T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, work):
            scores = model.score(features(batch.column(batch.num_columns - 1)))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(scores, pa.float64())], names=[*kept, name])

    return map_batches(df.select(*map(named, kept), named(text).cast("string").alias(work)), run, schema)
