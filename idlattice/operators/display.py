"""What a person sees of a document: its text, whether a field can be shown on the picture, and what failed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import clean_and_normalize, display_name
from .candidates import NOT_FOUND
from .layout import box_text
from .scoring import attribution

#: Fields compared as words; in the others look-alike digits are resolved.
WORD_FIELDS = ["name", "father_name", "nationality", "sex", "gender", "mrz_line1", "mrz_line2"]
UNAVAILABLE = "Highlight unavailable for this field."


def with_highlights(fields: DataFrame, docs: DataFrame) -> DataFrame:
    """Adds highlight_status: empty if the words inside a field's box say its value, else UNAVAILABLE.

    Fields that weren't found have none to show. docs: doc_id, word_map.
    """
    met = fields.join(docs.select("doc_id", F.col("word_map").alias("_words")), "doc_id", "left")
    inside = box_text(F.col("_words"), F.col("box"))
    same = lambda numeric: clean_and_normalize(F.col("value"), numeric) == clean_and_normalize(inside, numeric)
    shown = F.when(F.col("field_name").isin(WORD_FIELDS), same(False)).otherwise(same(True))
    status = F.when(F.col("value") == NOT_FOUND, "").when(F.col("box").isNull() | ~F.coalesce(shown, F.lit(False)), UNAVAILABLE).otherwise("")
    return met.withColumn("highlight_status", status).drop("_words")


def ocr_display(docs: DataFrame, fields: DataFrame) -> DataFrame:
    """(doc_id, display): type, confidence and the fields found, a line each.

    docs: doc_id, document_type, classification_confidence; fields: with field_seq, status and highlight_status.
    """
    note = F.concat(F.when(F.col("highlight_status") == UNAVAILABLE, " [Highlight unavailable]").otherwise(""), F.when(F.col("status") == "low_confidence", " [Low Confidence]").otherwise(""))
    line = F.concat(F.lit("  "), display_name(F.col("field_name")), F.lit(": "), F.col("value"), note)
    listed = fields.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.when((F.col("value") != NOT_FOUND) & (F.col("value") != ""), F.struct("field_seq", line.alias("line"))))).alias("rows"))
    kind = F.coalesce("document_type", F.lit("UNKNOWN"))
    head = F.array(F.concat(F.lit("CLASSIFIED DOCUMENT: "), kind))
    sure = F.when(kind != "UNKNOWN", F.array(F.format_string("CLASSIFICATION CONFIDENCE: %.1f%%", F.col("classification_confidence") * 100))).otherwise(F.array().cast("array<string>"))
    none = F.lit("  (No fields extracted successfully yet)")
    rows = F.when(F.col("rows").isNull(), F.array(none)).otherwise(F.concat(F.array(F.lit("EXTRACTED DETAILS:")), F.when(F.size("rows") == 0, F.array(none)).otherwise(F.transform("rows", lambda x: x["line"]))))
    return docs.join(listed, "doc_id", "left").select("doc_id", F.array_join(F.concat(head, sure, F.array(F.lit("=" * 45)), rows), "\n").alias("display"))


def failed_rules(validations: DataFrame, signals: DataFrame) -> DataFrame:
    """(doc_id, n, title, points, detail): failed validations, then signals, as they are listed."""
    rules = validations.where("status = 'FAIL'").select(
        "doc_id", F.col("seq").alias("n"), F.concat(F.lit("Rule Failure: "), display_name(F.col("field_name"))).alias("title"), attribution(F.col("status"), F.col("field_name")).alias("points"),
        F.concat(F.lit("Expected: "), F.coalesce("expected", F.lit("None")), F.lit(" | Actual: "), F.coalesce("actual", F.lit("None"))).alias("detail"),
    )
    last = F.lit(1_000_000)
    return rules.unionByName(signals.select("doc_id", (last + F.col("seq")).cast(validations.schema["seq"].dataType).alias("n"), display_name(F.col("name")).alias("title"), F.col("score").alias("points"), F.col("description").alias("detail")))
