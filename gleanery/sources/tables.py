"""Landed tables by name."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


#: Bytes that Spark hands to Python at once, unless the session asks for another number: a payload that is parsed takes some twenty times its own size.
BATCH_BYTES = 2 << 20


def bounded(spark: SparkSession) -> SparkSession:
    """The session with batches of payloads that stay small when parsed, whatever the rows' size."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(name) == "67108864b":
        spark.conf.set(name, f"{BATCH_BYTES}b")
    return spark


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return bounded(spark).read.parquet(f"{folder}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Narrow rows dealt over as many tasks as the session shuffles to. A file of few bytes is one partition, however much work its rows are."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


#: Temporary folders of this process, by application; they go with it.
_folders: dict[str, str] = {}


def shared(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, else the warehouse; on a local master without it, a temporary one."""
    context = spark.sparkContext
    if found := spark.conf.get("spark.checkpoint.dir", None):
        return found
    if not context.master.startswith("local"):
        return f"{spark.conf.get('spark.sql.warehouse.dir')}/_gleanery"
    if context.applicationId not in _folders:
        folder = tempfile.mkdtemp(prefix="gleanery-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        _folders[context.applicationId] = f"file://{folder}"
    return _folders[context.applicationId]


def cut(df: DataFrame) -> DataFrame:
    """df with its lineage cut by a checkpoint in the shared folder. A session that names no folder for them gets one."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared(df.sparkSession))
    return df.checkpoint()


def scratch(spark: SparkSession) -> str:
    """A new folder under the shared one."""
    return f"{shared(spark)}/gleanery-{uuid.uuid4().hex}"
