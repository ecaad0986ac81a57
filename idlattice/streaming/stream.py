"""Documents as a stream: stateless stages, an audit row for each document of a batch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..plans.pipeline import process_verification
from ..operators.classify import classify
from ..sources.audit import append_audit
from ..sources.sinks import audit_rows


def distinct_documents(docs: DataFrame, hash_column: str = "document_hash", delay: str = "1 hour", time: str = "arrived") -> DataFrame:
    """Drops repeats of a content hash within a delay; off by default, as repeats are logged."""
    return docs.withWatermark(time, delay).dropDuplicatesWithinWatermark([hash_column])


def verify_stream(docs: DataFrame, audit_path: str, checkpoint: str, as_of: str, available_now: bool = True) -> StreamingQuery:
    """Verifies documents as they arrive and appends to the audit table.

    docs: a streaming DataFrame with doc_id, ocr_raw_text, ocr_confidence, word_map,
    exif_tags, image_path and document_hash. A batch that is run again after a failure
    is logged once; the query's id, which its checkpoint keeps, tells streams apart.
    """

    def batch(rows: DataFrame, number: int) -> None:
        rows = rows.persist()
        try:
            done = process_verification(classify(rows), as_of)
            append_audit(audit_rows(done.scores, done.fields, rows, stamp=f"{as_of} 00:00:00"), audit_path, number, rows.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId") or checkpoint)
        finally:
            rows.unpersist()

    writer = docs.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def verdict_counts(audit: DataFrame, time: str = "arrived", window: str = "1 hour", delay: str = "2 hours") -> DataFrame:
    """Verdicts in windows of time, late rows within the delay included."""
    return audit.withWatermark(time, delay).groupBy(F.window(time, window), "verdict").agg(F.count("*").alias("n"))
