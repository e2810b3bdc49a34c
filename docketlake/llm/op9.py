"""Query op9: documents with their personal numbers replaced by pseudonyms."""

from __future__ import annotations

import functools
import os
import secrets

from pyspark.sql import DataFrame, SparkSession

from . import pii
from ._common import documents


@functools.cache
def _own_key() -> str:
    """A key that nobody knows, for the life of this driver: its pseudonyms are linked within the application and cannot be inverted."""
    return secrets.token_hex(32)


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DOCKETLAKE_PII_KEY holds the secret key of pseudonyms that are to agree between applications; there is no default one."""
    docs = documents(spark, sf_dir).select("doc_id", "text")
    return pii.pseudonymised(docs, os.environ.get("DOCKETLAKE_PII_KEY") or _own_key()).select("doc_id", "n_pii", "text")
