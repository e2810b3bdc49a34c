"""Sends the package to the executors, so that its Python functions run wherever the job does."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession


#: Rows of an Arrow batch.
BATCH = 1000


def ship(spark: SparkSession) -> None:
    """Add a zip of this package to the session's files, once per application, and make Arrow batches smaller unless they were set; executors fetch the zip from the driver."""
    context = spark.sparkContext
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":  # the default; texts are long, so batches have fewer rows
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH))
    if getattr(context, "_docketlake_shipped", False):
        return
    here = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(tempfile.mkdtemp(prefix="docketlake_"), "docketlake_package.zip")
    with zipfile.ZipFile(path, "w") as packed:
        for folder, _, names in os.walk(here):
            for name in sorted(names):
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    packed.write(full, os.path.relpath(full, os.path.dirname(here)))
    context.addPyFile(path)
    context._docketlake_shipped = True
