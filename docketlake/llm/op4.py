"""Query op4: recordings of documents, fingerprinted and searched.

The tables hold no audio, so each whole text is played: a word is a chord of three of twelve pitches chosen by its
hash, for a sixty-fourth of a second. Copies and near copies of texts become recordings that align.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import audio
from ._common import documents, word_hashes

#: Samples of a word, and the chords: three different pitch classes of the octave above the middle one.
LENGTH = 32


def _chords() -> np.ndarray:
    time = np.arange(LENGTH) / audio.RATE
    tones = np.array([np.sin(2 * np.pi * 523.2511 * 2 ** (k / 12) * time) for k in range(12)], np.float32)
    triples = [(i, j, k) for i in range(12) for j in range(i) for k in range(j)]
    return np.array([tones[list(t)].sum(0) / 4 for t in triples], np.float32)


CHORDS = _chords()


def played(texts: pa.Array) -> list[np.ndarray]:
    """Samples of whole texts; null is empty."""
    words, counts = word_hashes(texts)
    sound = CHORDS[(words % np.uint64(len(CHORDS))).astype(np.int64)].reshape(-1)
    return np.split(sound, np.cumsum(counts)[:-1] * LENGTH)


def op4_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    prints = audio.fingerprints(documents(spark, sf_dir), "doc_id", "text", decode=played)
    return audio.align(prints, F.col("id") % 100 == 0)
