"""Helpers that several operators share: scratch tables, connected components, word splitting."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Java regex of what separates words.
SPACE_RE = "[\\x20\\x09-\\x0D]+"
#: The same characters, one by one.
SPACE_CHARS = " \t\n\x0b\x0c\r"
_CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def words(text: Column) -> Column:
    """Array of the words of a text; no words for null, empty or blank texts."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE_RE), lambda w: w != "")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once for a row, however often the body's own lambdas read it."""
    return F.transform(F.array(value), body)[0]


def settled(df: DataFrame, condition: Column) -> DataFrame:
    """Rows that meet a condition on computed columns, which are not computed anew below the filter.

    Catalyst would push the condition through the projections and put the columns' expressions into each other, inside
    lambdas too; it leaves a filter above a projection with a numbering.
    """
    return df.withColumn("_qw_row", F.monotonically_increasing_id()).where(condition & (F.col("_qw_row") >= 0)).drop("_qw_row")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; a fresh local one where it is unset in local mode (tests)."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="quirework-")
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


class Scratch:
    """Tables that cut lineage, written once as Parquet under the shared folder.

    A lost executor costs only the stage that runs: what was written stays readable for all others.
    Tables that a lazily evaluated result still reads are left in place; others are dropped early.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        self.tables: dict[str, str] = {}

    def path(self, tag: str) -> str:
        return f"{self.root}/{tag}"

    @contextmanager
    def _cleaned(self) -> Iterator[None]:
        before = self.spark.conf.get(_CLEAN_UP, None)
        self.spark.conf.set(_CLEAN_UP, "true")
        try:
            yield
        finally:
            self.spark.conf.set(_CLEAN_UP, before) if before is not None else self.spark.conf.unset(_CLEAN_UP)

    def save(self, df: DataFrame, tag: str) -> DataFrame:
        """Writes a table and reads it back. What was shuffled for it goes at once, not when garbage happens to be collected."""
        with self._cleaned():
            df.write.mode("overwrite").parquet(self.path(tag))
        return self.spark.read.schema(df.schema).parquet(self.path(tag))

    def save_by(self, df: DataFrame, tag: str, *keys: str) -> DataFrame:
        """Like save, but bucketed by keys, so that later joins on them move only their other side.

        Rows that an aggregate by the same keys has just dealt out are not shuffled again.
        """
        n = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        self.tables[tag] = name = f"qw_{uuid.uuid4().hex}"
        with self._cleaned():
            df.write.bucketBy(n, *keys).option("path", self.path(tag)).saveAsTable(name)
        return self.spark.table(name)

    def drop(self, tag: str) -> None:
        if name := self.tables.pop(tag, None):
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.path(tag))
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def _large_star(edges: DataFrame) -> DataFrame:
    """Each node hands the smallest member of its neighbourhood to its larger neighbours."""
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Each node links its smaller neighbours, and itself, to the smallest of them. Needs a > b in every row."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    moved = edges.join(least, "a").where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.union(least.select("a", F.col("m").alias("b"))).distinct()


def connected_components(edges: DataFrame, scratch: Scratch, tag: str = "cc", max_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of ``edges(a, b)``; the component is its smallest node.

    Alternating large-star and small-star rounds (Kiveris et al. 2014), each written to the shared folder.
    Only a count and a checksum of a round reach the driver. Hot nodes meet in joins that AQE can split and in
    minima that are combined before the shuffle; no neighbourhood is ever gathered in one row.
    """
    def mark(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first())

    now = scratch.save(edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), f"{tag}0")
    seen = mark(now)
    for k in range(1, max_rounds + 1):
        if not seen[0]:
            break
        now = scratch.save(_small_star(_large_star(now)), f"{tag}{k}")
        scratch.drop(f"{tag}{k - 1}")
        seen, before = mark(now), seen
        if seen == before:
            break
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = now.select(F.col("b").alias("node")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(roots.select("node", F.col("node").alias("component")))
