"""Tables written to the shared folder, hot-group splitting and connected components."""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lontar.session import shared_dir


class Scratch:
    """Tables in the shared folder. A table cuts the lineage and survives the loss of executors."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/lontar-{uuid.uuid4().hex}"

    def write(self, df: DataFrame, partition_by: list[str] | None = None) -> DataFrame:
        path = f"{self.root}/{uuid.uuid4().hex}"
        writer = df.write
        if partition_by:
            writer = writer.partitionBy(*partition_by)
        writer.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._lontar_path = path
        return out

    def drop(self, df: DataFrame) -> None:
        """Delete a table that nothing reads any more."""
        path = getattr(df, "_lontar_path", None)
        if path:
            jvm = self.spark._jvm
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(where, True)


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores behind it until ``df`` has no such column; Spark ignores case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def split_hot(df: DataFrame, key: str, item: str, most: int, scratch: Scratch) -> DataFrame:
    """Add ``part_i``, ``part_j``, ``own``: a group of up to ``most`` rows stays whole as (0, 0).

    A larger group is cut into k = ceil(rows / most) chunks by the hash of ``item`` and each row goes to
    every pair of chunks that holds its own, so that any two rows of the group meet in some (part_i, part_j)
    and no part holds much over 2 x ``most`` rows. A row of such a group is copied k times, so what moves grows with the
    square of the group over ``most``: callers compare all of a group only where nothing less tells them apart. ``own`` is a row's own chunk. ``item`` must tell the rows of a group apart.
    """
    hot = df.groupBy(key).count().where(F.col("count") > most).select(key, F.ceil(F.col("count") / F.lit(most)).cast("int").alias("_k"))
    hot = scratch.write(hot)  # as a table it is broadcast if small, and else Spark can split the hot side of the join
    own = F.pmod(F.xxhash64(item), F.col("_k")).cast("int")
    return (
        df.join(hot, key, "left")
        .withColumn("_own", F.when(F.col("_k").isNull(), F.lit(0)).otherwise(own))
        .withColumn("_other", F.explode(F.when(F.col("_k").isNull(), F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.col("_k") - 1))))
        .withColumn("part_i", F.least("_own", "_other"))
        .withColumn("part_j", F.greatest("_own", "_other"))
        .withColumnRenamed("_own", "own")
        .drop("_k", "_other")
    )


def local_components(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest index reachable from each of 0..n-1 over the undirected edges (a, b)."""
    label = np.arange(n)
    while len(a):
        before = label.copy()
        low = np.minimum(label[a], label[b])
        np.minimum.at(label, a, low)
        np.minimum.at(label, b, low)
        np.minimum.at(label, before[a], low)
        np.minimum.at(label, before[b], low)
        label = label[label]
        if np.array_equal(before, label):
            break
    return label


def spanning(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges (node, smallest node of its component) that join what the edges (a, b) join."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    root = nodes[local_components(len(nodes), at[: len(a)], at[len(a) :])]
    keep = nodes != root
    return nodes[keep], root[keep]


def connected_components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, component) for each node of ``edges`` (a, b: long) that isn't the smallest of its component.

    Alternates large-star and small-star steps, each a minimum per node and a join, so that a hub is
    pre-aggregated before its rows move and no component is gathered in one task. A step's edges are
    written to the shared folder; the loop ends when a step changes nothing.
    """
    e = scratch.write(edges.select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).where("hi <> lo").distinct())
    seen = None
    while True:
        sums = e.agg(F.count("*").alias("n"), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)")).alias("s"), F.countDistinct("hi").alias("h")).first()
        state = (sums["n"], sums["s"])
        if not sums["n"] or state == seen:
            break
        seen = state
        # Minima are written before they are joined: Spark splits a hub's rows only in a join of two plain shuffles.
        low = scratch.write(e.groupBy(F.col("hi").alias("_u")).agg(F.min("lo").alias("_m")))
        large = e.join(low, F.col("lo") == F.col("_u"), "left").select("hi", F.coalesce("_m", "lo").alias("lo"))
        large = scratch.write(large.distinct())
        scratch.drop(low)
        low = scratch.write(large.groupBy(F.col("hi").alias("_u")).agg(F.min("lo").alias("_m")))
        joined = large.join(low, F.col("hi") == F.col("_u"))
        small = joined.select(F.col("lo").alias("hi"), F.col("_m").alias("lo")).where("hi <> lo").unionByName(low.select(F.col("_u").alias("hi"), F.col("_m").alias("lo")))
        after = scratch.write(small.distinct())
        scratch.drop(e)
        scratch.drop(large)
        scratch.drop(low)
        e = after
    return e.select(F.col("hi").alias("node"), F.col("lo").alias("component"))
