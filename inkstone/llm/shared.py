"""Session helpers: the folder all executors share, tables written there, and connected components."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

HUB_EDGES, HUBS = 1000, 100_000
#: So many edges at most (3.2 MB) are made stars by the driver; more take the rounds below.
DRIVER_EDGES = 200_000


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder of ``spark.checkpoint.dir``.

    Where it is unset, a temporary folder stands in for it in a local session only; on a
    cluster a folder of the driver's would not be the executors', so that is an error.
    """
    context = spark.sparkContext
    if (own := context._jsc.sc().getCheckpointDir()).isEmpty():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="checkpoint-"))
        own = context._jsc.sc().getCheckpointDir()
    return own.get()


def cut(df: DataFrame) -> DataFrame:
    """The rows written to the shared checkpoint folder, their lineage cut."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def folder(spark: SparkSession, kind: str) -> str:
    """A new folder's name under the shared one; what is written there goes when the driver ends, if not before."""
    path = f"{checkpoint_dir(spark)}/{kind}-{uuid.uuid4().hex}"
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(place)
    return path


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder that nothing reads any more."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def written(df: DataFrame, path: str) -> DataFrame:
    """The rows as a table of the shared folder: lineage and size estimates begin anew, as checkpoints' estimates don't."""
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _beside(edges: DataFrame, end: str, least: DataFrame) -> DataFrame:
    """The edges with ``low`` of the node at one end, or null.

    Nodes of more than ``HUB_EDGES`` edges there, the ``HUBS`` largest at most, are broadcast
    to the edges, so the shuffled join of the others meets no hot key.
    """
    most = edges.groupBy(F.col(end).alias("hub")).count().where(F.col("count") > HUB_EDGES).orderBy(F.desc("count"), "hub").limit(HUBS)
    hubs = F.broadcast(most.join(least, F.col("hub") == F.col("node"), "left").select("hub", F.col("low").alias("hub_low")))
    met = edges.join(hubs, F.col(end) == F.col("hub"), "left")
    others = met.where("hub is null").select("hi", "lo").join(least, F.col(end) == F.col("node"), "left").select("hi", "lo", "low")
    return others.unionByName(met.where("hub is not null").select("hi", "lo", F.col("hub_low").alias("low")))


def of_groups(rows: DataFrame, groups: DataFrame, key: str) -> DataFrame:
    """The rows with the columns of their group's row, which tells in ``size`` how many rows the group has.

    Groups of more than ``HUB_EDGES`` rows, the ``HUBS`` largest at most, are broadcast to the
    rows, so the shuffled join of the others meets no hot key.
    """
    hubs = F.broadcast(groups.where(F.col("size") > HUB_EDGES).orderBy(F.desc("size"), key).limit(HUBS))
    names = F.broadcast(hubs.select(key))
    return rows.join(hubs, key).unionByName(rows.join(names, key, "left_anti").join(groups.join(names, key, "left_anti"), key)).drop("size")


def _star(edges: DataFrame) -> DataFrame:
    """One round over edges (hi, lo), hi > lo: the large star, then the small star.

    The large star hands each edge's upper end to the least node below its lower end; the
    small star ties all that lie below a node to the least of them. Both keep what is
    connected connected.
    """
    least = edges.groupBy(F.col("hi").alias("node")).agg(F.min("lo").alias("low"))
    large = _beside(edges, "lo", least).select("hi", F.coalesce("low", "lo").alias("lo")).distinct()
    below = large.groupBy(F.col("hi").alias("node")).agg(F.min("lo").alias("low"))
    tied = _beside(large, "hi", below).where("lo > low").select(F.col("lo").alias("hi"), F.col("low").alias("lo"))
    return below.select(F.col("node").alias("hi"), F.col("low").alias("lo")).unionByName(tied).distinct()


def _settled(edges: DataFrame) -> bool:
    """Whether each upper end has one edge and is no lower end: the components are stars around their least nodes."""
    ends = edges.select(F.col("hi").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(edges.select(F.col("lo").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    return ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up > 1 or up + down > 1").isEmpty()


def stars(hi: np.ndarray, lo: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The edges as stars: each node but the least of its component, and that least one.

    Roots hook to the least root beside them and trees are flattened, so the number of
    roots halves every two turns at least.
    """
    nodes, at = np.unique(np.concatenate([hi, lo]), return_inverse=True)
    a, b = at[: len(hi)], at[len(hi) :]
    root = np.arange(len(nodes))
    while len(a):
        low = np.minimum(root[a], root[b])
        np.minimum.at(root, np.maximum(root[a], root[b]), low)
        while (root[root] != root).any():
            root = root[root]
        apart = root[a] != root[b]
        a, b = a[apart], b[apart]
    upper = root != np.arange(len(nodes))
    return nodes[upper], nodes[root[upper]]


def components(edges: DataFrame, rounds: list | None = None) -> DataFrame:
    """(node, component): the smallest node that each node of the edges (a, b) can reach.

    Alternating large and small stars rewrite the edges until they are stars, which takes
    about log(nodes) rounds whatever the order of the ids along a path; there is no limit to
    the rounds. A round's edges are a table of the shared folder, and the round before goes
    once it is written. As soon as ``DRIVER_EDGES`` edges or fewer are left, the driver makes
    them stars: a round is a dozen stages, which a cluster of many partitions feels in its
    driver. Nodes whose only edges are loops are not listed. ``rounds`` collects the numbers
    of edges.
    """
    spark = edges.sparkSession
    a, b = F.col("a").cast("bigint"), F.col("b").cast("bigint")
    base = folder(spark, "components")
    now = written(edges.where("a <> b").select(F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo")).distinct(), f"{base}/0")
    turn, number = 0, now.count()
    while number > DRIVER_EDGES and not _settled(now):
        turn += 1
        now = written(_star(now), f"{base}/{turn}")
        remove(spark, f"{base}/{turn - 1}")
        number = now.count()
        if rounds is not None:
            rounds.append(number)
    if 0 < number <= DRIVER_EDGES:
        left = now.toArrow()
        hi, lo = stars(left.column("hi").to_numpy(), left.column("lo").to_numpy())
        now = written(spark.createDataFrame(pa.table({"hi": hi, "lo": lo})), f"{base}/{turn + 1}")
        remove(spark, f"{base}/{turn}")
    return now.select(F.col("hi").alias("node"), F.col("lo").alias("component")).unionByName(now.select(F.col("lo").alias("node"), F.col("lo").alias("component")).distinct())
