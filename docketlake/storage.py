"""Where intermediate tables lie: in the folder that spark.checkpoint.dir names, which driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names; unset, a temporary one on a local master, and an error on a cluster."""
    context = spark.sparkContext
    folder = context.getConf().get("spark.checkpoint.dir") or getattr(context, "_docketlake_folder", None)
    if folder:
        return folder
    if not context.master.startswith("local") or context.master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir is not set: on a cluster it must name a folder that driver and executors share")
    context._docketlake_folder = tempfile.mkdtemp(prefix="checkpoint_")
    return context._docketlake_folder


def new_folder(spark: SparkSession, name: str) -> str:
    """A path under the shared folder that nothing has used."""
    return f"{shared_folder(spark).rstrip('/')}/{name}_{uuid.uuid4().hex}"


def kept(df: DataFrame) -> DataFrame:
    """df written once in the shared folder and read from there: what was asked of a model, or is used several times, is not made again when an executor is lost."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()
