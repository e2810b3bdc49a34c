"""Query op3: encode every whole text of documents and decode it again."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe
from ._common import documents


def vocabulary() -> str:
    """Path of the tokenizer file; DOCKETLAKE_BPE names another."""
    import public_tokenizers

    return os.environ.get("DOCKETLAKE_BPE") or public_tokenizers.path("word_bpe_49k.json")


def digests(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of each text."""
    out = bpe.encode_decode(docs.select("doc_id", "text"), path)
    return out.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op3_bpe_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(documents(spark, sf_dir), vocabulary())
