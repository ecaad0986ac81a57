from pyspark.sql import functions as F

from idlattice.plans import corpus
from idlattice.sources import readers
from idlattice.streaming import stream

from .conftest import TINY


def test_stream_writes_what_a_batch_would(spark, tmp_path):
    docs = corpus.documents(spark, TINY).where("kind = 'PAN' and k < 60").withColumns({"image_path": F.lit("p"), "document_hash": F.col("number")})
    docs.select("doc_id", "ocr_raw_text", "ocr_confidence", "word_map", "exif_tags", "image_path", "document_hash").write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(spark.read.parquet(str(tmp_path / "in")).schema).parquet(str(tmp_path / "in"))
    query = stream.verify_stream(source, str(tmp_path / "audit"), str(tmp_path / "state"), corpus.AS_OF)
    assert query.awaitTermination(240)
    rows = readers.audit(spark, str(tmp_path / "audit")).collect()
    assert len(rows) == 12 and {r.document_type for r in rows} == {"PAN"} and all(r.verdict for r in rows)


def test_repeats_within_the_delay_and_counts_by_window(spark, tmp_path):
    """A content hash that comes again within the delay is dropped; verdicts are counted by hour."""
    rows = [("a", "2026-01-01 00:00:00", "Genuine"), ("a", "2026-01-01 00:10:00", "Genuine"), ("b", "2026-01-01 00:20:00", "Genuine"), ("c", "2026-01-01 01:30:00", "Suspicious")]
    spark.createDataFrame(rows, "document_hash string, t string, verdict string").selectExpr("document_hash", "cast(t as timestamp) arrived", "verdict").coalesce(1).write.parquet(str(tmp_path / "in"))
    source = lambda: spark.readStream.schema("document_hash string, arrived timestamp, verdict string").parquet(str(tmp_path / "in"))
    for name, df, mode in (("once", stream.distinct_documents(source()), "append"), ("hours", stream.verdict_counts(source()), "complete")):
        query = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        assert query.awaitTermination(120)
    assert sorted(r.document_hash for r in spark.table("once").collect()) == ["a", "b", "c"]
    assert sorted((r.verdict, r.n) for r in spark.table("hours").collect()) == [("Genuine", 3), ("Suspicious", 1)]
