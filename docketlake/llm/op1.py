"""Query op1: token counts of every whole text of documents under a unigram model."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

from . import token_counts
from ._common import documents


def vocabulary() -> str:
    """Path of the pieces' file; DOCKETLAKE_PIECES names another."""
    import public_tokenizers

    return os.environ.get("DOCKETLAKE_PIECES") or public_tokenizers.path("piece_bpe_32k.model")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.with_counts(documents(spark, sf_dir).select("doc_id", "text"), vocabulary()).select("doc_id", "n_pretokens", "n_tokens")
