"""Shared pieces of the training-data operators: durable tables and column lists."""

from __future__ import annotations

import atexit
import gc
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terralane.operators.checkpoints import shared_folder

DOCUMENT_COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and every executor see.

    It comes from ``spark.checkpoint.dir``; where that is unset (tests, one machine) a
    folder under the warehouse takes its place, and on a cluster it is an error.
    """
    return f"{shared_folder(spark)}/terralane-{spark.sparkContext.applicationId}"


def _drop(spark: SparkSession, path: str) -> None:
    """Delete a folder of an application that ends; a stopped JVM leaves it behind."""
    if spark.sparkContext._jsc is None:
        return
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


_registered: set[str] = set()


def materialize(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back.

    This cuts the lineage: a lost executor costs only the tasks that it ran, as all
    later stages read files which no executor owns. The folder goes when the
    application ends.
    """
    spark = df.sparkSession
    root = shared_dir(spark)
    if root not in _registered:
        _registered.add(root)
        atexit.register(_drop, spark, root)
    path = f"{root}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", codec).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release_shuffles(spark: SparkSession) -> None:
    """Let Spark drop shuffle files of finished jobs now.

    It does so once the driver's garbage is collected, which may not happen for half an
    hour; operators that work in rounds ask for it between them. Plans are let go in turns:
    first Python's handles, then what they held in the JVM.
    """
    for _ in range(3):
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.1)


#: Rows of one Arrow batch, where the session doesn't say: a few MB of usual texts.
BATCH_ROWS = 1000
_BATCH_KEY = "spark.sql.execution.arrow.maxRecordsPerBatch"


def small_batches(spark: SparkSession) -> None:
    """Keep Python workers small: fewer rows a batch than Spark's 10,000.

    Two workers and a JVM share an executor's memory, and workers live on from stage to
    stage. A session that sets its own number keeps it.
    """
    if int(spark.conf.get(_BATCH_KEY)) == 10_000:
        spark.conf.set(_BATCH_KEY, str(BATCH_ROWS))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def utf8(col):
    """The text, or an empty one for null."""
    return F.coalesce(col, F.lit(""))
