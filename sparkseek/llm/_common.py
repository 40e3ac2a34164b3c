"""Helpers that the training-data operators share: lineage cuts, prefix sums, connected components.

Everything here is DataFrame code. A *cut* writes a table to the folder that the session names in
``spark.checkpoint.dir`` and reads it back, so a lost executor never forces a long lineage to run again
and values that depend on partition order (partition ids, ranks) are fixed once.
"""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkseek.session import ship

#: White space of the word contracts, as a Java and RE2 class.
WORD = r"[^\x20\x09-\x0D]+"

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lower_ascii(col: Column) -> Column:
    """Lower-case A-Z only."""
    return F.translate(col, _UPPER, _LOWER)


def word_count(col: Column) -> Column:
    """Number of words ``[^\\x20\\x09-\\x0D]+``; null counts as no text."""
    return F.coalesce(F.regexp_count(col, F.lit(WORD)), F.lit(0)).cast("long")


def shared_dir(spark: SparkSession) -> str:
    """The shared folder that the session names; there is no other, since executors see no folder of the driver's machine."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sparkseek.scratch", None)
    if not at:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        at = "file://" + tempfile.mkdtemp(prefix="sparkseek-")  # one process on one machine, as in tests
        spark.conf.set("spark.sparkseek.scratch", at)
    return at.rstrip("/")


def cut(df: DataFrame, *partition_by: str) -> DataFrame:
    """Write ``df`` to the shared folder and return the written table."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/sparkseek/{uuid.uuid4().hex}"
    writer = df.write.option("compression", "zstd")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._sparkseek_path = path
    return out


def drop(df: DataFrame | None) -> None:
    """Delete a table that :func:`cut` wrote and that nothing reads any more."""
    path = getattr(df, "_sparkseek_path", None)
    if path:
        jvm = df.sparkSession._jvm
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(at, True)


def map_arrow(df: DataFrame, run: Callable, schema: T.StructType) -> DataFrame:
    """``df.mapInArrow`` with this package sent to the workers first."""
    ship(df.sparkSession)
    return df.mapInArrow(run, schema)


def partitions(spark: SparkSession, rows: int, each: int = 250_000) -> int:
    """Shuffle partitions for a slim table: the session's number, more where rows demand it."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // each))


def hash_limit(n: int, distinct: int) -> int:
    """A signed 64-bit value that about ``1.1 n + 1000`` of so many distinct hashes do not exceed."""
    share = (1.1 * n + 1000) / max(distinct, 1)
    return 2**63 - 1 if share >= 1 else int(-(2**63) + 2**64 * share)


def hash_sample(df: DataFrame, key: Column, n: int) -> DataFrame:
    """One row of each of the at most ``n`` smallest values of ``key``, a 64-bit hash that is never null; ``_hash`` holds it.

    Rows that repeat share a hash and count once, so no number of repeats fills or empties the sample. A filter on the
    hash, set by an estimate of the distinct ones, leaves about ``n`` of them, so the final top-n moves few rows from any
    task, however many tasks there are.
    """
    rows = df.withColumn("_hash", key)
    distinct = rows.agg(F.approx_count_distinct("_hash", 0.02)).first()[0]
    return rows.filter(F.col("_hash") <= hash_limit(n, distinct)).dropDuplicates(["_hash"]).orderBy("_hash").limit(n)


def prefix_sum(df: DataFrame, order: list[Column], value: str, out: str, rows: int) -> DataFrame:
    """Add ``out``: the running sum of ``value`` (inclusive) in the global order ``order``.

    A range partitioning fixes the global order, is cut, and each range gets the total of the ranges before it;
    no task holds more than its range. Only one row per range meets in one task.
    """
    spark = df.sparkSession
    ranged = cut(df.repartitionByRange(partitions(spark, rows), *order).withColumn("_range", F.spark_partition_id()))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        ranged.groupBy("_range")
        .agg(F.sum(value).alias("_total"))
        .select("_range", F.coalesce(F.sum("_total").over(before), F.lit(0)).alias("_start"))
    )
    inside = Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return (
        ranged.join(F.broadcast(starts), "_range")  # one row a range, a number this function sets
        .withColumn(out, F.col("_start") + F.sum(value).over(inside))
        .drop("_range", "_start")
    )


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Components of an undirected graph: ``edges(a, b)`` -> ``(node, component)``, component the smallest node.

    Alternating large-star and small-star steps until the edge set is a fixed point (a star around each
    component's smallest node). Every round shuffles (node, neighbour) longs only and is cut. In a star step a
    node's neighbours are never gathered: the smallest comes from a pre-aggregated minimum, joined back on the
    node; the minima of hubs are broadcast, so a hub with a third of all edges stays where its edges are. Nodes
    without an edge are not returned.
    """
    both = edges.filter("a is not null and b is not null and a <> b")
    star = cut(both.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    last, count = None, star.count()
    for _ in range(max_rounds):
        hubs = 2 * count > HUB  # with fewer edges no node can be one
        large = _star(star.select("u", "v").union(star.select(F.col("v"), F.col("u"))), "large", hubs)
        small = _star(large, "small", hubs)
        new = cut(small)
        state = new.agg(F.count("*"), F.sum(F.hash("u", "v").cast("long"))).first()
        drop(star)
        star = new
        if tuple(state) == last:
            break
        last, count = tuple(state), state[0]
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    members = star.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return members.union(star.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


#: Neighbours from which on a node is a hub; there are at most (edges / HUB) hubs, and this many are broadcast at most.
HUB, HUBS = 50_000, 100_000


def _star(pairs: DataFrame, kind: str, hubs: bool) -> DataFrame:
    """One star step on (u, v): large links larger neighbours, small links smaller ones, to the least of u and its neighbours.
    ``hubs``: whether a node may have over ``HUB`` neighbours."""
    if kind == "small":  # each edge seen from its larger end only
        pairs = pairs.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = pairs.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count("*").alias("n"))
    joined = None
    if hubs:
        least = cut(least)
        hot, rest = least.filter(F.col("n") > HUB).select("u", "m"), least.filter(F.col("n") <= HUB).select("u", "m")
        if 0 < hot.count() <= HUBS:
            joined = pairs.join(F.broadcast(hot), "u").union(pairs.join(F.broadcast(hot), "u", "left_anti").join(rest, "u"))
    joined = pairs.join(least.select("u", "m"), "u") if joined is None else joined
    if kind == "large":
        moved = joined.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        moved = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).union(joined.select("u", F.col("m").alias("v")))
    return moved.filter("u <> v").distinct()
