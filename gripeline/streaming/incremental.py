"""Runs of the build on batches: slices of a table, or micro-batches of a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..config import DEFAULT, Config
from ..plans.build import Result, run
from ..plans.graph import Store
from ..sources.taxonomy import Pack
from ..sources.threads import batch_slice


def run_slice(a: DataFrame, b: DataFrame, store: Store, batch: int, stamp: str, size: int = 50_000, pack: Pack | None = None, cfg: Config = DEFAULT) -> Result:
    """The batch-th slice against the same graph. A batch that the graph's runs hold already is not run again."""
    run_id = f"batch_{batch:05d}"
    if store.read().runs.where(F.col("run_id") == run_id).limit(1).count():
        return Result({"run_id": run_id, "skipped": True}, store.version())
    part = batch_slice(a, batch, size)
    return run(part, b.join(part.select("conversation_id"), "conversation_id", "left_semi"), store, run_id, stamp, pack, cfg=cfg)


def run_stream(source: DataFrame, b: DataFrame, store: Store, checkpoint: str, pack: Pack | None = None, cfg: Config = DEFAULT) -> StreamingQuery:
    """Each micro-batch of tagged conversations is one run; a batch replayed after a failure is recognised by its id."""

    def one(batch: DataFrame, number: int) -> None:
        run_id = f"stream_{number:08d}"
        if batch.isEmpty() or store.read().runs.where(F.col("run_id") == run_id).limit(1).count():
            return
        run(batch, b.join(batch.select("conversation_id"), "conversation_id", "left_semi"), store, run_id, run_id, pack, cfg=cfg)

    return source.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_stream(spark: SparkSession, path: str, schema) -> DataFrame:
    return spark.readStream.schema(schema).parquet(path)
