"""Written intermediate tables and other small helpers that the operators share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


#: Rows that Spark hands to Python at once, unless the session asks for another number. Texts are long, so the usual 10,000 fill a worker.
BATCH_ROWS = 1000


def sized(spark: SparkSession) -> SparkSession:
    """The session with batches of texts that fit beside a worker's own tables."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(name, "10000") == "10000":
        spark.conf.set(name, BATCH_ROWS)
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return sized(spark).read.parquet(f"{sf_dir}/{name}.parquet")


#: Folders of our own, one for each application on a local master that names none; they go when Python ends.
_folders: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or one of our own where it is unset.

    Unset on a local master a temporary folder serves; on a cluster the warehouse does. The setting is a
    core one, which a running session refuses, so it is only read.
    """
    context = spark.sparkContext
    if found := spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir():
        return found
    if not context.master.startswith("local"):
        return f"{spark.conf.get('spark.sql.warehouse.dir')}/_gleanery"
    if context.applicationId not in _folders:
        folder = tempfile.mkdtemp(prefix="gleanery-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        _folders[context.applicationId] = f"file://{folder}"
    return _folders[context.applicationId]


#: Tables written inside temporary(), innermost last.
_scopes: list[list[DataFrame]] = []


@contextmanager
def temporary() -> Iterator[None]:
    """Drops all tables that are written inside, but for those given to kept()."""
    _scopes.append([])
    try:
        yield
    finally:
        for table_ in _scopes.pop():
            dropped(table_)


def kept(df: DataFrame) -> DataFrame:
    """A written table that outlives temporary()."""
    if _scopes:
        _scopes[-1] = [t for t in _scopes[-1] if t is not df]
    return df


def written(df: DataFrame) -> DataFrame:
    """df as a table in the shared folder, read back: its lineage ends there and lost executors don't matter."""
    spark = sized(df.sparkSession)
    path = f"{shared_dir(spark)}/gleanery-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._gleanery_path = path
    if _scopes:
        _scopes[-1].append(out)
    return out


def dropped(df: DataFrame) -> None:
    """Delete what written() wrote, once nothing reads it any more."""
    jvm, conf = df.sparkSession._jvm, df.sparkSession._jsc.hadoopConfiguration()
    path = jvm.org.apache.hadoop.fs.Path(df._gleanery_path)
    path.getFileSystem(conf).delete(path, True)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """df by keys over as many tasks as the session shuffles to. Few bytes can mean much work, so small partitions aren't put together."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)
