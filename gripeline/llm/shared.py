"""What the corpus operators share: the shared folder, lineage cuts, word rules, connected components."""

from __future__ import annotations

import math
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Translation tables for the six ASCII white-space characters and for A-Z, on UTF-8 bytes.
LOWER_ASCII = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
SPACES = "\t\n\x0b\x0c\r"


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir. Where that is unset, a local one is set for a local master, and any other is refused:
    executors of a cluster would each write to a disk of their own."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        found = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="checkpoints-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


class Cuts:
    """Lineage cuts: tables written to the shared folder and read back.

    Each cut is one Parquet table, so a lost executor costs no more than the stages after it. ``drop`` deletes tables that
    no later step reads. A frame that an operator returns may read the last of them; ``clean`` deletes all that are left.
    """

    roots: list[str] = []

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
        self.n = 0
        Cuts.roots.append(self.root)

    @classmethod
    def clean(cls, spark: SparkSession) -> None:
        """Deletes what is left of all cuts made so far by this driver; frames made by operators cannot be read any more after it."""
        while cls.roots:
            path = spark._jvm.org.apache.hadoop.fs.Path(cls.roots.pop())
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)

    def cut(self, df: DataFrame) -> DataFrame:
        self.n += 1
        path = f"{self.root}/{self.n}"
        schema = df.schema
        df.write.parquet(path)
        out = self.spark.read.schema(schema).parquet(path)
        out._cut_path = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        jvm = self.spark._jvm
        for t in tables:
            path = jvm.org.apache.hadoop.fs.Path(t._cut_path)
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def partitions(spark: SparkSession, n_bytes: float, each: int = 16 << 20) -> int:
    """So many partitions that each holds about ``each`` bytes, and at least as many as the session asks for."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(n_bytes / each))


def about_bytes(df: DataFrame, column: str) -> int:
    """The size of a frame's files as the optimizer knows it; where it knows none (a frame of computed rows), the bytes of a column."""
    known = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if known < int(str(df.sparkSession._jsparkSession.sessionState().conf().defaultSizeInBytes())) >> 10:
        return known
    return df.agg(F.sum(F.octet_length(F.col(column).cast("string")))).first()[0] or 0


def small_batches(spark: SparkSession, size: str = "4m") -> None:
    """Asks for Arrow batches of few bytes for the rest of the session, whatever the length of a row; a smaller wish stays."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key, None) in (None, "67108864b", "67108864", "64MB", "64m", str(2**31 - 1)):
        spark.conf.set(key, size)


def parts(batches, column: str, size: int):
    """The rows of Arrow batches again, in slices of about ``size`` bytes of one string or binary column."""
    for b in batches:
        first, n = 0, 0
        for i, x in enumerate(b.column(column)):
            n += 0 if not x.is_valid else x.as_buffer().size
            if n >= size:
                yield b.slice(first, i + 1 - first)
                first, n = i + 1, 0
        if first < b.num_rows:
            yield b.slice(first)


def words(text: Column) -> Column:
    """The words ``[^\\x20\\x09-\\x0D]+`` of a text; none for null."""
    return F.array_remove(F.split(F.translate(F.coalesce(text, F.lit("")), SPACES, " " * len(SPACES)), " "), "")


def connected_components(edges: DataFrame, cuts: Cuts) -> DataFrame:
    """(node, component): the smallest node reachable over ``edges`` (a, b: long), for each node with an edge.

    Minimum labels travel over the edges and then jump along the labels they have (pointer jumping), until a round changes
    nothing. The joins are plain equi-joins of two written tables, so that adaptive execution can split a node that has very
    many edges; the minimum is pre-aggregated before its shuffle. Only the number of changes reaches the driver.
    """
    both = cuts.cut(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a != b").distinct())
    labels = cuts.cut(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("label")))
    while True:
        own = labels.select(F.col("node").alias("a"), "label")
        sent = both.join(labels.select(F.col("node").alias("b"), "label"), "b").select("a", "label")
        lowest = cuts.cut(sent.unionByName(own).groupBy(F.col("a").alias("node")).agg(F.min("label").alias("label")))
        jump = lowest.select(F.col("node").alias("label"), F.col("label").alias("jumped"))
        new = cuts.cut(
            lowest.join(jump, "label", "left").join(labels.select("node", F.col("label").alias("old")), "node")
            .select("node", F.least(F.coalesce("jumped", "label"), F.col("label")).alias("label"), "old")
        )
        changed = new.where("label != old").limit(1).count()
        cuts.drop(lowest, labels)
        labels = new
        if not changed:
            cuts.drop(both)
            return labels.select("node", F.col("label").alias("component"))
