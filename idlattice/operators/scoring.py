"""Rule-based scores and verdicts, and what each finding adds to the risk."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scores import to_score, verdict
from .validate import is_checksum

#: Thresholds used unless trained ones are given.
THRESHOLDS = {"ocr_threshold": 0.60, "classification_threshold": 0.70, "extraction_threshold": 0.50, "authenticity_genuine": 0.75, "authenticity_suspicious": 0.40, "fraud_suspicious": 0.60, "fraud_genuine": 0.25}


def ocr_score(f: str = "") -> Column:
    """0 to 1 from the features of words, of the document's own confidence without words."""
    c = lambda name: F.col(name)
    quality = 0.4 * c("valid_words_ratio") + 0.3 * c("alphanumeric_ratio") + 0.3 * c("dictionary_match_ratio")
    base = 0.75 * (0.5 * c("ocr_mean_conf") + 0.5 * c("ocr_median_conf")) + 0.25 * quality
    lowered = F.greatest(F.lit(0.0), base - 0.15 * c("ocr_pct_low_conf"))
    blurred = F.greatest(F.lit(0.0), lowered - 0.20 * (400 - c("blur_score")) / 400)
    return F.when(c("word_count") == 0, c("raw_ocr")).when((c("blur_score") > 0) & (c("blur_score") < 400), blurred).otherwise(lowered)


def signal_points(name: Column, score: Column) -> Column:
    layout = F.contains(name, F.lit("layout_anomaly")) | F.contains(name, F.lit("overlapping"))
    return F.when(name == "editing_software_detected", 30).when(name == "timestamp_mismatch", 15).when(layout, 25).otherwise(score)


def attribution(status: Column, name: Column) -> Column:
    """Points of one validation result, shown by itself; the sum counts failed check digits once."""
    return F.when(status == "FAIL", F.when(is_checksum(name), 40).otherwise(20)).when(status == "WARN", 10).otherwise(0)


def fraud_points(validations: DataFrame, signals: DataFrame) -> DataFrame:
    """doc_id and points: other failures 20 each, failed check digits 40 once, warnings 10 each, signals."""
    digits = is_checksum(F.col("field_name"))
    rules = validations.groupBy("doc_id").agg(
        F.sum(F.when((F.col("status") == "FAIL") & ~digits, 20).when(F.col("status") == "WARN", 10).otherwise(0)).alias("p"),
        F.max(F.when((F.col("status") == "FAIL") & digits, 40).otherwise(0)).alias("c"),
    )
    marks = signals.groupBy("doc_id").agg(F.sum(signal_points(F.col("name"), F.col("score"))).alias("s"))
    return rules.join(marks, "doc_id", "full").select("doc_id", (F.coalesce("p", F.lit(0)) + F.coalesce("c", F.lit(0)) + F.coalesce("s", F.lit(0))).cast("int").alias("points"))


def scores(docs: DataFrame, features: DataFrame, fields: DataFrame, validations: DataFrame, signals: DataFrame, thresholds: dict[str, float] = THRESHOLDS) -> DataFrame:
    """One row per document: ocr_confidence, classification_confidence, extraction_reliability,
    fraud_risk_score, authenticity_score (0 to 100) and final_decision.

    docs: doc_id, document_type, classification_confidence, ocr_confidence. The raw OCR
    confidence, which sets the penalty, stays apart from the score made of it.
    """
    extracted = fields.groupBy("doc_id").agg((1 - F.avg((F.col("value") == "NOT_FOUND").cast("double"))).alias("extracted"))
    base = docs.select("doc_id", "document_type", "classification_confidence", F.col("ocr_confidence").alias("raw_ocr"))
    joined = base.join(features, "doc_id").join(extracted, "doc_id", "left").join(fraud_points(validations, signals), "doc_id", "left")
    penalty = F.when(F.col("raw_ocr") < 0.60, ((0.60 - F.col("raw_ocr")) * 50).cast("int")).otherwise(0)
    risk = F.least(F.lit(100), F.greatest(F.lit(0), F.coalesce("points", F.lit(0)) + penalty))
    made = joined.select(
        "doc_id", "document_type", to_score(ocr_score()).alias("ocr_confidence"),
        F.when(F.col("document_type") == "UNKNOWN", 0).otherwise(to_score(F.col("classification_confidence"))).alias("classification_confidence"),
        to_score(F.coalesce("extracted", F.lit(0.0))).alias("extraction_reliability"), risk.alias("fraud_risk_score"),
    )
    authentic = F.when(F.col("ocr_confidence") < 50, ((100 - F.col("fraud_risk_score")) * 0.5).cast("int")).otherwise(100 - F.col("fraud_risk_score"))
    percent = lambda name: round(thresholds[name] * 100)
    out = made.withColumn("authenticity_score", authentic)
    return out.withColumn("final_decision", verdict(F.col("authenticity_score"), F.col("fraud_risk_score"), percent("authenticity_genuine"), percent("authenticity_suspicious"), percent("fraud_suspicious"), percent("fraud_genuine")))
