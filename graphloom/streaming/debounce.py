"""Change events: trailing-edge debounce as session windows, in batches and streams."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from graphloom.operators.snapshots import Workspaces

#: Suffixes that are watched.
WATCHED = r"\.(py|c|h|cpp|cc|cxx|hpp|hh|hxx)$"


def debounced(events: DataFrame, key: str, gap: str, ts: str = "ts", watermark: str | None = None) -> DataFrame:
    """(key, started, last, changes): one row per burst of events of a key; a burst ends when nothing comes for ``gap``.

    The same plan serves batches and streams; on a stream give a watermark of at
    least the greatest disorder. Session windows hold one state row per open
    burst, whatever the number of its events.
    """
    source = events.withWatermark(ts, watermark) if watermark else events
    return (
        source.filter(F.col(ts).isNotNull())
        .groupBy(F.session_window(ts, gap).alias("w"), F.col(key))
        .agg(F.count(F.lit(1)).alias("changes"), F.max(ts).alias("last"))
        .select(key, F.col("w.start").alias("started"), "last", "changes")
    )


def last_state(events: DataFrame, key: str, kind: str, ts: str = "ts", order: str = "event_id") -> DataFrame:
    """Last event of each key: whether it exists now or is deleted."""
    return events.groupBy(key).agg(F.max_by(kind, F.struct(ts, order)).alias(kind), F.max(ts).alias(ts))


def watch_folder(spark: SparkSession, folder: str, schema: str, handler: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Apply ``handler`` to each micro-batch of change events (JSON lines) that appear in a folder."""
    stream = spark.readStream.schema(schema).json(folder).filter(F.col("path").rlike(WATCHED))
    return stream.writeStream.foreachBatch(handler).option("checkpointLocation", checkpoint).start()


def watch_workspace(
    spark: SparkSession, workspaces: Workspaces, workspace: str, nodes: DataFrame, folder: str, schema: str, handler: Callable[[DataFrame, int], None], checkpoint: str
) -> StreamingQuery:
    """``watch_folder`` for a registered workspace with a stored graph; ValueError without one of them."""
    if not workspaces.registered(workspace):
        raise ValueError(f"workspace isn't registered: {workspace}")
    if nodes.isEmpty():
        raise ValueError("the graph is empty: index the workspace first")
    return watch_folder(spark, folder, schema, handler, checkpoint)
