"""Pages as a stream: decisions of each page as it arrives, and online leaf clusters. There is no event time here."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from linkloom.operators.cluster import assign_online
from linkloom.operators.decisions import state_action
from linkloom.sources.tables import SCHEMAS, write_table


def read_pages(spark: SparkSession, path: str, fmt: str = "parquet", files: int = 100) -> DataFrame:
    return spark.readStream.schema(SCHEMAS["pages"]).option("maxFilesPerTrigger", files).format(fmt).load(path)


def stream_decisions(pages: DataFrame, out: str, checkpoint: str, available: bool = True) -> StreamingQuery:
    """Writes the decisions of every micro-batch under out/batch=<id>; a batch that runs again replaces its own."""

    def write(batch: DataFrame, batch_id: int) -> None:
        write_table(state_action(batch)[0], f"{out}/batch={batch_id}")

    q = pages.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (q.trigger(availableNow=True) if available else q).start()


def stream_clusters(leaves: DataFrame, edges: Callable[[DataFrame], DataFrame], out: str, checkpoint: str) -> StreamingQuery:
    """Assigns arriving leaves (id, seq) to clusters, newest first; edges gives the similar pairs of a batch with all.
    Each batch reads the table of the one before it and writes the next, so a rerun gives the same."""

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        known = spark.read.parquet(f"{out}/batch={batch_id - 1}") if batch_id else spark.createDataFrame([], "id string, cluster long")
        write_table(assign_online(known, batch, edges(batch)), f"{out}/batch={batch_id}")

    return leaves.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
