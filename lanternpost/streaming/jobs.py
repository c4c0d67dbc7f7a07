"""Post scoring and the audit log as Structured Streaming jobs.

Scoring and log are stateless per row; review counts keep event-time state.  A checkpoint replaces
resuming by row number.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ..operators.replies import audit_records
from ..operators.tagging import with_crisis, with_intent
from ..sources.sinks import append_log


def file_stream(spark: SparkSession, folder: str, schema: T.StructType, *, fmt: str = "json", files: str = "*") -> DataFrame:
    """Files arriving in ``folder`` whose names match ``files``."""
    return spark.readStream.schema(schema).format(fmt).option("pathGlobFilter", files).load(folder)


def scored_posts(posts: DataFrame, post: str = "post", concern: str | None = None) -> DataFrame:
    """Intent, crisis level and flag per post; the same columns on a batch or a stream."""
    return with_crisis(with_intent(posts, post), post, concern)


def start_scoring(posts: DataFrame, out: str, checkpoint: str, *, once: bool = True, **scoring) -> StreamingQuery:
    """Score a stream of posts into a parquet sink; the sink's log makes a replay harmless."""
    writer = (
        scored_posts(posts, **scoring)
        .writeStream.format("parquet")
        .outputMode("append")
        .option("path", out)
        .option("checkpointLocation", checkpoint)
    )
    return (writer.trigger(availableNow=True) if once else writer).start()


def start_audit_log(
    interactions: DataFrame, out: str, checkpoint: str, *, once: bool = True, **columns
) -> StreamingQuery:
    """Append audit records under bucket and day.

    Each micro-batch is one committed batch of the log, so a batch that runs twice after a
    failure is stored once.
    """
    records = audit_records(interactions, **columns)

    def store(batch: DataFrame, batch_id: int) -> None:
        append_log(batch, out, f"stream-{batch_id}")

    writer = records.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def review_counts(records: DataFrame, *, at: str = "timestamp", key: str = "post_hash", late: str = "12 hours", every: str = "1 hour") -> DataFrame:
    """Records and those to review per window and bucket, each key once, on a stream or a batch.

    On a stream a key that comes again within ``late`` of event time is dropped, and a window is given
    out once, when the watermark has passed its end; rows older than the watermark are dropped and
    counted by the stream's progress.  State holds the keys and open windows of that time only.
    """
    if records.isStreaming:
        kept = records.withWatermark(at, late).dropDuplicatesWithinWatermark([key])
    else:
        kept = records.dropDuplicates([key])
    counted = kept.groupBy(F.window(at, every).alias("w"), "bucket").agg(
        F.count(F.lit(1)).alias("n"), F.count_if("requires_review").alias("to_review")
    )
    return counted.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "bucket", "n", "to_review")


def start_review_counts(records: DataFrame, out: str, checkpoint: str, *, once: bool = True, **options) -> StreamingQuery:
    """Closed windows of :func:`review_counts` into a parquet sink, whose log makes a replay harmless."""
    writer = (
        review_counts(records, **options)
        .writeStream.format("parquet")
        .outputMode("append")
        .option("path", out)
        .option("checkpointLocation", checkpoint)
    )
    return (writer.trigger(availableNow=True) if once else writer).start()


def stream_counters(query: StreamingQuery) -> dict[str, int]:
    """Rows read by a stream in the batches it still reports, and rows its operators dropped as late."""
    batches = query.recentProgress
    return {
        "rows_in": sum(b.numInputRows for b in batches),
        "rows_late": sum(op.numRowsDroppedByWatermark for b in batches for op in b.stateOperators),
    }
