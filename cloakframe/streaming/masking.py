"""Masking as a stream: documents are masked on their own, so no state is kept between batches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from cloakframe.operators.policy import Config
from cloakframe.plans import pipeline


def mask_stream(docs: DataFrame, out: str, checkpoint: str, cfg: Config = Config(), available_now: bool = True) -> StreamingQuery:  # noqa: B008
    """Masks each micro-batch of ``doc_id, text`` by the batch pipeline and appends ``doc_id, masked, n_masked`` as Parquet.

    A batch that is replayed after a failure overwrites its own folder, so each
    document arrives once.
    """

    def each(batch: DataFrame, batch_id: int) -> None:
        rows = batch.select("doc_id", "text").where("text is not null").dropDuplicates(["doc_id"])
        pipeline.masked(pipeline.found(rows, None, cfg)).write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    writer = docs.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def label_counts(spans: DataFrame, late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """Spans by label in tumbling windows of ``seen_at``; rows later than the watermark are left out."""
    timed = spans.where("seen_at is not null").withWatermark("seen_at", late)
    return timed.groupBy(F.window("seen_at", width).alias("w"), "label").agg(F.count("*").alias("n_spans")).select(F.col("w.start").alias("since"), "label", "n_spans")


def sessions(events: DataFrame, key: str = "doc_id", gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """Bursts of detector output for each document, by session windows."""
    timed = events.where("seen_at is not null").withWatermark("seen_at", late)
    return timed.groupBy(F.session_window("seen_at", gap).alias("w"), key).agg(F.count("*").alias("n_spans")).select(key, F.col("w.start").alias("since"), F.col("w.end").alias("until"), "n_spans")
