"""A table that a stream upserts: buckets of rows by key, and a manifest written last.

A batch rewrites only the buckets it touches, into a folder of its own, then writes its manifest, which
says where every bucket lies now. A batch whose manifest is there is done: replayed, it changes
nothing. One that died before is written anew; its half-written folder is in no manifest.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Buckets of a table. A manifest has an entry for each.
BUCKETS = 64


def _files(spark: SparkSession, folder: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), path


def manifest(spark: SparkSession, folder: str, before: int | None = None) -> tuple[int, dict[str, str]]:
    """The newest batch that is done (before a given one), -1 if none is, and the folder of each bucket after it."""
    files, path = _files(spark, f"{folder}/manifests")
    if not files.exists(path):
        return -1, {}
    done = sorted(int(s.getPath().getName().removesuffix(".json")) for s in files.listStatus(path) if s.getPath().getName().endswith(".json"))
    done = [n for n in done if before is None or n < before]
    if not done:
        return -1, {}
    stream = files.open(spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/manifests/{done[-1]:020}.json"))
    try:
        return done[-1], json.loads(bytes(stream.readAllBytes()).decode())
    finally:
        stream.close()


def _publish(spark: SparkSession, folder: str, batch: int, buckets: dict[str, str]) -> None:
    """Write a manifest under another name and rename it, which takes effect at once."""
    path = spark._jvm.org.apache.hadoop.fs.Path
    files, _ = _files(spark, folder)
    temporary = path(f"{folder}/manifests/_{uuid.uuid4().hex}")
    out = files.create(temporary)
    try:
        out.write(bytearray(json.dumps(buckets, sort_keys=True).encode()))
    finally:
        out.close()
    files.rename(temporary, path(f"{folder}/manifests/{batch:020}.json"))


def current(spark: SparkSession, folder: str, schema: T.StructType, before: int | None = None, only: list[str] | None = None) -> DataFrame:
    """The table as the newest manifest has it; only: of these buckets."""
    _, buckets = manifest(spark, folder, before)
    paths = [p for b, p in sorted(buckets.items()) if only is None or b in only]
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def upserting(folder: str, schema: T.StructType, keys: list[str], order: list[str], buckets: int = BUCKETS) -> Callable[[DataFrame, int], None]:
    """A function for foreachBatch: of each key's rows the last in order stays, new ones after those there."""
    own: Column = F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")

    def run(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        if manifest(spark, folder, number + 1)[0] == number:
            return
        names, row = schema.fieldNames(), F.struct(*[c for c in schema.fieldNames() if c not in keys])
        new = batch.select(*names).groupBy(*keys).agg(F.max_by(row, F.struct(*order)).alias("_row")).select(*keys, "_row.*", own.alias("_bucket")).persist()
        try:
            touched = [str(r._bucket) for r in new.select("_bucket").distinct().collect()]  # at most as many as there are buckets
            if touched:
                kept = current(spark, folder, schema, number, touched).join(new.select(*keys), keys, "left_anti")
                target = f"{folder}/data/{number:020}-{uuid.uuid4().hex}"
                whole = kept.withColumn("_bucket", own).select(*names, "_bucket").unionByName(new.select(*names, "_bucket"))
                whole.repartition(len(touched), "_bucket").write.partitionBy("_bucket").parquet(target)
            there = manifest(spark, folder, number)[1]
            _publish(spark, folder, number, there | {b: f"{target}/_bucket={b}" for b in touched})
        finally:
            new.unpersist()

    return run
