"""Shared helpers: the shared scratch folder, lineage cuts and connected components."""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_OWN_FOLDER: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Where a local session has none (as in tests) a temporary folder is made once; on a cluster that
    would be another folder on every machine, so it is an error there.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    app = spark.sparkContext.applicationId
    if app not in _OWN_FOLDER:
        _OWN_FOLDER[app] = "file://" + tempfile.mkdtemp(prefix="spark-shared-")
    return _OWN_FOLDER[app]


_SCRATCH = threading.local()


def fresh_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    for paths in getattr(_SCRATCH, "open", ())[-1:]:
        paths.append(path)
    return path


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables written inside are deleted at its end. What goes on must be written inside to a path from outside."""
    stack = _SCRATCH.__dict__.setdefault("open", [])
    stack.append([])
    try:
        yield
    finally:
        for path in stack.pop():
            discard(spark, path)


def cut(df: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends here and survives lost executors."""
    spark = df.sparkSession
    path = path or fresh_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, path: str) -> None:
    """Delete a table that :func:`cut` wrote and nothing reads any more."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def tasks_for(spark: SparkSession, units: int, each: int = 1) -> int:
    """A number of partitions for ``units`` pieces of work of which a task takes about ``each``. Given to
    repartition as a number it stands: adaptive execution merges partitions by the size of their rows, which
    says nothing where small rows stand for large work."""
    return max(1, min(units, max(spark.sparkContext.defaultParallelism, -(-units // each))))


def fresh_name(df: DataFrame, name: str) -> str:
    """``name`` with as many underscores before it as make it differ from all columns of ``df``."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name = "_" + name
    return name


def small_batches(batches, rows: int = 1024):
    """The same rows in batches of at most ``rows``, so that what a task makes of a batch stays small."""
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)


def _both_ways(e: DataFrame) -> DataFrame:
    return e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))


def _lowest(edges: DataFrame) -> DataFrame:
    return edges.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))


def _with_low(edges: DataFrame, low: DataFrame, hub: int | None) -> DataFrame:
    """``edges(u, v)`` with the m of their u in ``low(u, m, n)``. Nodes with more than ``hub`` edges are joined by a
    broadcast, so that none of them is the key of one task; there are at most edges / hub of these. None: no node has so many."""
    if hub is None:
        return edges.join(low.select("u", "m"), "u")
    hubs = F.broadcast(low.where(F.col("n") > hub).select("u", F.col("m").alias("hub_m")))
    told = edges.join(hubs, "u", "left")
    hot = told.where("hub_m is not null").select("u", "v", F.col("hub_m").alias("m"))
    return hot.unionByName(told.where("hub_m is null").select("u", "v").join(low.select("u", "m"), "u"))


def connected_components(edges: DataFrame, name: str = "components", max_rounds: int = 60) -> DataFrame:
    """Components of an undirected graph given as ``edges(u long, v long)``.

    Returns (node, root) for every node that has an edge to another node; root is the smallest
    node of its component. Rounds of large-star and small-star joins, each written to the shared
    folder; the tables of the round before are deleted then. A node's neighbours are only ever aggregated
    with ``min``, combined before the shuffle, and a hub's edges are joined where they are, so it does not
    gather its list in one task. Self loops and nulls are ignored. Empty input gives an empty result.

    A table between the two stars, and hubs only where there are any, keep each plan small: the driver holds a plan anew
    for every stage of it that ends.
    """
    spark = edges.sparkSession
    e = (
        edges.where("u is not null and v is not null and u <> v")
        .select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        .distinct()
    )
    path = fresh_path(spark, name)
    e = cut(e, name, path)

    def shape(df):
        """Number of edges, a hash of all, most edges of a node (those that a large star leaves a node are no more)."""
        nodes = _both_ways(df).groupBy("u").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("h"))
        ends, h, most = nodes.agg(F.sum("n"), F.bit_xor("h"), F.max("n")).first()
        return (ends or 0) // 2, h, most

    before = shape(e)
    if before[0] == 0:
        return e.select(F.col("u").alias("node"), F.col("v").alias("root"))
    for _ in range(max_rounds):
        hub = max(1000, before[0] // 10_000)  # so at most 20 000 rows are broadcast
        hub = hub if before[2] > hub else None
        both = _both_ways(e)
        low = _lowest(both).select("u", F.least("u", "m").alias("m"), "n")
        large = _with_low(both, low, hub).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        between = fresh_path(spark, f"{name}-large")
        large = cut(large, name, between)
        low = _lowest(large)
        small = _with_low(large, low, hub).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        last, path = path, fresh_path(spark, name)
        e = cut(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct(), name, path)
        discard(spark, last)
        discard(spark, between)
        after = shape(e)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    )
