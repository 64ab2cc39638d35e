"""The folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared(spark: SparkSession) -> str:
    """What spark.checkpoint.dir names. Where it is unset, a local folder is set for a local master, and any other is refused."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="checkpoints-")
        spark.conf.set("spark.checkpoint.dir", found)
        spark.sparkContext.setCheckpointDir(found)
    return found


def cut(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read back: what follows neither plans nor computes it again."""
    shared(df.sparkSession)
    return df.checkpoint()


class Tables:
    """Cuts for loops: tables written to the shared folder, read back, and deleted when no later step reads them.

    A frame that an operator returns may read some of them; ``clean`` deletes all that are left.
    """

    roots: list[str] = []

    def __init__(self, spark: SparkSession, label: str):
        self.spark, self.n = spark, 0
        self.root = f"{shared(spark)}/{label}-{uuid.uuid4().hex}"
        Tables.roots.append(self.root)

    @classmethod
    def clean(cls, spark: SparkSession) -> None:
        """Deletes what is left of all cuts made so far by this driver; frames that read them cannot be read any more."""
        while cls.roots:
            path = spark._jvm.org.apache.hadoop.fs.Path(cls.roots.pop())
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)

    def cut(self, df: DataFrame) -> DataFrame:
        self.n += 1
        path, schema = f"{self.root}/{self.n}", df.schema
        df.write.parquet(path)
        out = self.spark.read.schema(schema).parquet(path)
        out._cut_path = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        for t in tables:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(t._cut_path)
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
