"""Connected components of links, by alternating large and small stars.

Each round first contracts the links inside every task to a forest, then stars shorten
the paths between tasks. Rounds are written to the shared folder, which cuts the lineage.
Only counts reach the driver.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanery.llm.store import dropped, written

SCHEMA = "x long, y long"


def roots(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes other than the smallest of their component, and that smallest node."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    i, j = at[: len(a)], at[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[i], label[j])
        new = label.copy()
        for side in (i, j):
            np.minimum.at(new, side, low)
            np.minimum.at(new, label[side], low)
        while True:
            next_ = new[new]
            if (next_ == new).all():
                break
            new = next_
        if (new == label).all():
            break
        label = new
    rest = label != np.arange(len(nodes))
    return nodes[rest], nodes[label[rest]]


def _contracted(batches):
    """The links of a task as a forest of stars; batches fold into it one after the other, so memory follows the nodes."""
    x, y = np.empty(0, np.int64), np.empty(0, np.int64)
    for batch in batches:
        a, b = (np.asarray(batch.column(i)) for i in (0, 1))
        x, y = roots(np.concatenate([x, a]), np.concatenate([y, b]))
    for i in range(0, len(x), 100_000):
        yield pa.RecordBatch.from_arrays([pa.array(x[i : i + 100_000]), pa.array(y[i : i + 100_000])], names=["x", "y"])


def components(links: DataFrame) -> DataFrame:
    """From links (x, y) to (node, component): the smallest node reachable, for every node that has a link."""
    edges = written(links.select(F.col(links.columns[0]).cast("long").alias("x"), F.col(links.columns[1]).cast("long").alias("y")).where("x <> y").mapInArrow(_contracted, SCHEMA))
    while True:
        ends = edges.select(F.col("x").alias("n"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(edges.select(F.col("y"), F.lit(0), F.lit(1)))
        seen = ends.groupBy("n").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
        if seen.where("up > 1 or (up > 0 and down > 0)").isEmpty():
            found = edges.select(F.col("x").alias("node"), F.col("y").alias("component")).union(edges.select("y", "y").distinct())
            found._gleanery_path = edges._gleanery_path  # for dropped()
            return found
        both = edges.union(edges.select("y", "x")).toDF("u", "v")
        large = both.join(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "u").where("v > u").select(F.col("v").alias("x"), F.col("m").alias("y")).distinct()
        small = large.join(large.groupBy("x").agg(F.min("y").alias("m")), "x")
        stars = small.select("x", F.col("m").alias("y")).union(small.select(F.col("y").alias("x"), F.col("m").alias("y")).where("x <> y")).distinct()
        before, edges = edges, written(stars.mapInArrow(_contracted, SCHEMA))
        dropped(before)
