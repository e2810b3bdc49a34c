"""The search of recordings against all offsets, and the input end."""

import io
import wave

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from docketlake.llm import audio


def song(seed, words, rate=audio.RATE):
    """Chords of three notes, sixteen to the second."""
    rng = np.random.default_rng(seed)
    time = np.arange(rate // 16) / rate
    return np.concatenate([sum(np.sin(2 * np.pi * 261.6 * 2 ** (n / 12) * time) for n in rng.choice(12, 3, replace=False)) for _ in range(words)]) * 4000


def library():
    rng = np.random.default_rng(4)
    out = {}
    for i in range(40):
        base = song(i, 120 + 4 * i)
        out[100 * i] = base
        cut = int(rng.integers(10, len(base) // audio.HOP // 2)) * audio.HOP
        out[100 * i + 1] = base[cut:] + rng.normal(0, 200, len(base) - cut)
        out[100 * i + 2] = np.concatenate([song(500 + i, 30), base[: len(base) // 2]])
    out[5000] = np.tile(song(900, 3), 400)  # one sound again and again
    out[5001] = np.tile(song(900, 3), 380)
    return out


def best(a, b):
    top = None
    for offset in range(audio.LEAST - len(a), len(b) - audio.LEAST + 1):
        low, high = max(0, -offset), min(len(a), len(b) - offset)
        got = audio.stretch(np.bitwise_count(a[low:high] ^ b[low + offset : high + offset]))
        if got and (top is None or got[1] > top[1]):
            top = (offset, got[1])
    return top


def test_recall_against_all_offsets(spark):
    sounds = library()
    pcm = {k: np.clip(v, -32767, 32767).astype("<i2").tobytes() for k, v in sounds.items()}
    df = spark.createDataFrame(list(pcm.items()), "doc_id long, media binary")
    prints = audio.fingerprints(df, "doc_id", "media")
    held = {r.id: np.frombuffer(r.fp, "<u4") for r in prints.collect()}
    rows = audio.align(prints, F.col("id") % 100 == 0).collect()
    found = {(r.query_class, r.doc_id): r for r in rows if r.query_class is not None}
    small = audio.align(prints, F.col("id") % 100 == 0, block=500, tile=700, salt=2).where("query_class IS NOT NULL").collect()
    assert sorted(map(tuple, small)) == sorted(map(tuple, found.values()))
    want, hits = 0, 0
    for q in sorted(k for k in held if k % 100 == 0)[::3]:
        for c in held:
            if c != q and (top := best(held[q], held[c])) and top[1] >= 2 * audio.LEAST:
                want += 1
                hits += (q, c) in found and found[q, c].length >= 0.9 * top[1]
    assert want > 25 and hits >= 0.95 * want
    assert (5000, 5001) in found


def test_wav_files_of_other_rates(spark):
    base, x = song(7, 200), song(7, 200, 4 * audio.RATE)
    file = io.BytesIO()
    with wave.open(file, "wb") as f:
        f.setnchannels(2)
        f.setsampwidth(2)
        f.setframerate(audio.RATE * 4)
        f.writeframes(np.repeat(np.clip(x, -32767, 32767).astype("<i2"), 2).tobytes())
    got = audio.wav(pa.array([file.getvalue(), None, b"no sound"], pa.binary()))
    assert len(got[1]) == len(got[2]) == 0
    a, b = audio.fingerprint_all([(base / 32768).astype(np.float32), got[0]])
    n = min(len(a), len(b))
    assert np.bitwise_count(a[:n] ^ b[:n]).mean() / 32 < 0.1
    raw = np.clip(x, -32767, 32767).astype("<i2").tobytes()
    c = audio.fingerprint(audio.pcm16(pa.array([raw], pa.binary()), audio.RATE * 4)[0])
    assert np.bitwise_count(a[: len(c)] ^ c[: len(a)]).mean() / 32 < 0.1


def test_odd_rows_and_names(spark):
    df = spark.createDataFrame([(0, b""), (100, None), (None, b"12"), (200, b"1")], "`doc.id` long, `me.dia` binary")
    prints = audio.fingerprints(df, "doc.id", "me.dia")
    assert sorted((r.doc_id, r.class_id) for r in audio.align(prints, F.col("id") % 100 == 0).collect()) == [(0, 0), (100, 0), (200, 0)]


def test_votes_are_counted_some_at_a_time(monkeypatch):
    rng = np.random.default_rng(3)
    a = rng.integers(0, 2**32, 300, dtype=np.uint64).astype(np.uint32)
    b = np.concatenate([rng.integers(0, 2**32, 40, dtype=np.uint64).astype(np.uint32), a[50:], a[50:120]])
    whole = audio.QueryBlock([1, 2], [a, np.tile(a[:20], 30)]).offsets(b)
    monkeypatch.setattr(audio, "VOTES", 7)
    assert audio.QueryBlock([1, 2], [a, np.tile(a[:20], 30)]).offsets(b) == whole and whole[0] == -10
