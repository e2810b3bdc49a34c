"""Columns of any name, very long texts and full caches: op1, op2, op3; the shared folder."""

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from docketlake.llm import _common, bpe, mixing, token_counts
from docketlake.llm.op1 import vocabulary as pieces
from docketlake.llm.op3 import vocabulary


def odd(spark, rows):
    return spark.createDataFrame([(i, t, "s", 1, 2) for i, t in rows], "`doc.id` long, `te.xt` string, `so.urce` string, `__m_key` int, counted_text int")


def test_token_counts(spark):
    long = "ab" * 300_000
    out = token_counts.with_counts(odd(spark, [(1, "a b"), (2, None), (3, long)]), pieces(), text="te.xt")
    rows = {r["doc.id"]: r for r in out.collect()}
    assert out.columns[:2] == ["doc.id", "te.xt"] and rows[1].n_pretokens == 2 and rows[3].n_pretokens == 1 and rows[3].n_tokens > 1000 and rows[1].counted_text == 2


def test_a_full_trie_counts_alike():
    scores = token_counts.scores_of(pieces())
    words = [f"word{i}x{'y' * (i % 50)}" for i in range(300)] + ["z" * 400]
    text = " ".join(words).encode()
    small = token_counts.PrefixTrie(scores, long=100, symbols=2000)
    assert small.count_text(text) == token_counts.PrefixTrie(scores).count_text(text)
    assert b"z" * 400 not in small.ends and small.symbols < 2000 + 100 * 100


def test_encoding(spark):
    out = bpe.encode_decode(odd(spark, [(1, "a b"), (2, None)]), vocabulary(), text="te.xt", ids="ids.of")
    assert out.columns[-2:] == ["ids.of", "decoded"] and sorted(r["ids.of"] is not None for r in out.collect()) == [True, True]


def test_a_full_cache_encodes_alike():
    texts = [" ".join(f"w{i}{k}" for k in range(40)).encode() for i in range(50)]
    codec, library = bpe.Codec(vocabulary(), cache_bytes=500), Tokenizer.from_file(vocabulary())
    for t in texts:
        assert np.frombuffer(codec.encode([t])[0], "<u4").tolist() == library.encode(t.decode(), add_special_tokens=False).ids
        assert len(codec.cache) <= 80


def test_a_very_long_text_is_encoded(spark):
    text = "lorem ipsum " * 200_000 + "x" * 100_000
    ids = bpe.encode_decode(spark.createDataFrame([(text,)], "text string"), vocabulary()).first().ids
    assert np.frombuffer(ids, "<u4").tolist() == Tokenizer.from_file(vocabulary()).encode(text, add_special_tokens=False).ids


def test_mixing(spark):
    df = odd(spark, [(i, "a b c") for i in range(20)]).withColumn("si.ze", F.lit(3))
    out = mixing.mix(df, spark.createDataFrame([("s", 90.0)], "`so.urce` string, target double").toDF("so.urce", "target"), source="so.urce", size="si.ze", key="doc.id")
    assert sum(r.taken for r in out.collect()) == 90 and {r["__m_key"] for r in out.collect()} == {1}


def test_no_private_folder_on_a_cluster(spark, monkeypatch):
    class Context:
        master = "spark://somewhere:7077"

        def getConf(self):
            return {}

    class Session:
        sparkContext = Context()

    with pytest.raises(ValueError):
        _common.shared_folder(Session())
