"""Shared plumbing of the corpus operators: scratch tables, checked broadcasts, components."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

#: A side is broadcast only when its counted rows, at the width of its columns, are below this bound.
BROADCAST_BYTES = 32_000_000
#: Bytes of an Arrow batch that goes to a Python worker.
BATCH_BYTES = 1 << 22
_bases: set[str] = set()


def scratch_root(spark: SparkSession) -> str:
    """The shared folder that the cluster names; one of this machine only where none is set and all of Spark runs on it."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    own = getattr(scratch_root, "own", None)
    if own is None:
        own = scratch_root.own = tempfile.mkdtemp(prefix="docloom-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
    return f"file://{own}"


def delete(path: str) -> None:
    """Removes a path of any store that Spark reads."""
    spark = SparkSession.getActiveSession()
    if spark is not None:
        jvm = spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


@atexit.register
def _sweep() -> None:
    """At the end of the driver, whatever results were still read from goes."""
    for base in _bases:
        delete(base)


def bounded_batches(spark: SparkSession) -> None:
    """Arrow batches of the session hold BATCH_BYTES at most, unless it names a bound of its own.

    A batch is held by the executor and twice by its Python worker, for each task; by rows alone it has 10,000 texts of any size.
    """
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if key not in spark.conf.getAll:
        spark.conf.set(key, str(BATCH_BYTES))


class Scratch:
    """Tables written in the shared folder; they cut lineage and survive lost executors."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.base = f"{scratch_root(spark)}/docloom-{name}-{uuid.uuid4().hex}"
        self.n = 0
        _bases.add(self.base)

    def save(self, df: DataFrame, name: str = "t") -> DataFrame:
        self.n += 1
        path = f"{self.base}/{self.n:03d}-{name}"
        df.write.option("compression", "zstd").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._docloom_path = path
        return out

    def drop(self, df: DataFrame | None) -> None:
        """Removes one saved table that no later step reads."""
        path = getattr(df, "_docloom_path", None)
        if path:
            delete(path)


def small(df: DataFrame, rows: int | None = None) -> DataFrame:
    """A broadcast hint when the counted rows are below the bound, else the frame as it is.

    For columns of numbers only; where there are arrays, `rows` counts their elements as well.
    """
    n = df.count() if rows is None else rows
    return F.broadcast(df) if n * (16 + 8 * len(df.columns)) <= BROADCAST_BYTES else df


def pick(docs: DataFrame, *names: str) -> DataFrame:
    """Only the named columns, so that extra columns with clashing names cannot interfere."""
    return docs.select(*[F.col(f"`{n}`") for n in names])


def connected_components(links: DataFrame, scratch: Scratch, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): the smallest node reachable over `links`; only nodes with links appear.

    Large-star and small-star passes until nothing changes. Each pass takes minima by partial
    aggregation and joins them back by node, so a hub with many links is a splittable join key.
    """
    edges = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct()
    edges = scratch.save(edges, "edges")
    mark = None
    while True:
        # large star: every larger neighbour of u is linked to the least node around u
        both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        # nodes with no smaller neighbour of their own keep the link to their least neighbour
        large = scratch.save(large.where("u <> v").distinct(), "large")
        # small star: u and its smaller neighbours are linked to the least of them
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small_ = (
            large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
            .union(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        )
        seen = Observation()
        after = scratch.save(small_.observe(seen, F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")), "edges")
        scratch.drop(large)
        scratch.drop(edges)
        edges, before, mark = after, mark, (seen.get["n"], seen.get["x"])
        if mark == before or not mark[0]:
            break
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)
