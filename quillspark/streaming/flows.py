"""Streaming twins of batch operators, and query-log telemetry."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.lexicon import ZH_MANUAL, LexiconProfile
from ..operators import hygiene, split
from ..sources import scratch


def chunk_stream(pages: DataFrame, lex: LexiconProfile = ZH_MANUAL, size: int = split.CHUNK_SIZE, overlap: int = split.OVERLAP) -> DataFrame:
    """Fixed chunks of a stream of pages with their hygiene flags; there is
    no state, so it appends."""
    chunks = split.fixed(pages, size, overlap).withColumns({"chapter": F.lit(None).cast("string"), "section": F.lit(None).cast("string")})
    return hygiene.flagged(chunks, lex)


def windowed_counts(events: DataFrame, window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Events and their sum by type and tumbling window, with a watermark;
    works on a stream and on a table."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", window).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("events"), F.sum("value").alias("total")).select(F.col("w.start").alias("window_start"), "event_type", "events", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    """Sessions of each user: events no more than `gap` apart."""
    return events.withWatermark("ts", late).groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count(F.lit(1)).alias("events")).select("user_id", F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "events")


def once(events: DataFrame, key: str = "event_id", late: str = "2 hours") -> DataFrame:
    """Each event once, though it be sent again while the watermark waits."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark([key])


def run_available(stream: DataFrame, path: str, checkpoint: str) -> dict[str, int]:
    """Run a stream over all that its source has, appending to Parquet in
    `path`; run again with the same checkpoint, it goes on with what is new.
    Returns the rows read, the rows that came after the watermark and were
    dropped, and the batches."""
    q = stream.writeStream.format("parquet").outputMode("append").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    if q.exception() is not None:
        raise q.exception()
    steps = q.recentProgress
    return {"rows": sum(p["numInputRows"] for p in steps), "late": sum(o["numRowsDroppedByWatermark"] for p in steps for o in p["stateOperators"]), "batches": len(steps)}


def streamed(spark: SparkSession, table: str, schema, made) -> DataFrame:
    """The rows that a stream over a table's files appends, `made` being the
    stream's transformation; its folders are new ones under the shared folder."""
    root = f"{scratch.shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    flow = made(spark.readStream.schema(schema).parquet(table))
    run_available(flow, f"{root}/rows", f"{root}/checkpoint")
    return spark.read.schema(flow.schema).parquet(f"{root}/rows")
