"""From raw documents to training tokens: five stages, each over all that the one before kept.

Each stage is a function (spark, docs, sf_dir) -> DataFrame. All but the last return the columns of documents.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docketlake.llm import bpe, jaccard, lines, op2, op3, op8, quality
from docketlake.llm._common import documents, shared_folder
from docketlake.shipping import ship

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a quality score under the threshold go. The model learns from the labels of documents that may be learned from."""
    ship(spark)
    model = op8.fitted(docs.select("doc_id", "text"), sf_dir)
    return quality.score(docs, model, name="_score").where(F.col("_score") >= op8.THRESHOLD).select(*docs.columns)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that stand in many sources go from every document; n_chars follows."""
    ship(spark)
    out = lines.without_boilerplate(docs, removed="_removed")
    return out.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the least doc_id stays."""
    ship(spark)
    return jaccard.one_per_group(docs).select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in the number of copies that brings the sources to their targets: none, one or two."""
    ship(spark)
    return op2.mixed(docs).select(*docs.columns, F.explode(F.array_repeat(F.lit(0), F.col("copies").cast("int"))).alias("_copy")).select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document (binary, little-endian unsigned 32-bit), their number, and digests of ids and decoding."""
    ship(spark)
    out = bpe.encode_decode(docs.select("doc_id", "lang", "source", "text"), op3.vocabulary())
    return out.select("doc_id", "lang", "source", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), "ids", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("quality classifier", keep_quality),
    ("line dedup", drop_lines),
    ("n-gram Jaccard join", drop_near_copies),
    ("mixing sources to target weights", mix_sources),
    ("BPE encoding and decoding", encode),
]

#: The learned classifier and the balancing have no SQL.
ORACLE_SQL = None


def _dropped(spark: SparkSession, path: str) -> None:
    """Delete a folder wherever it lies."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; between stages the rows are written as Parquet in the shared folder of spark.checkpoint.dir and read again.

    What a stage has read is deleted when its own rows are written, but for the input of the last one, which the result still reads.
    """
    base, before = shared_folder(spark).rstrip("/"), None
    docs = documents(spark, sf_dir).select(*COLUMNS)
    for number, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if number < len(STAGES) - 1:
            path = f"{base}/pipeline_{uuid.uuid4().hex}_{number}"
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
            if before:
                _dropped(spark, before)
            before = path
    return docs
