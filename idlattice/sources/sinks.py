"""JSON, HTML and audit outputs."""

from __future__ import annotations

import logging

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import display_name
from .audit import append_audit

log = logging.getLogger(__name__)
GREEN, AMBER, RED = "#28a745", "#ffc107", "#dc3545"


def status_colour(status: Column) -> Column:
    return F.when(status == "PASS", GREEN).when(status == "WARN", AMBER).otherwise(RED)


def risk_colour(risk: Column) -> Column:
    return F.when(risk < 25, GREEN).when(risk < 50, AMBER).otherwise(RED)


def authenticity_colour(score: Column) -> Column:
    return F.when(score >= 75, GREEN).when(score < 40, RED).otherwise(AMBER)


def field_map(fields: DataFrame) -> DataFrame:
    """doc_id and a map of values by field name."""
    return fields.groupBy("doc_id").agg(F.map_from_entries(F.transform(F.array_sort(F.collect_list(F.struct("field_seq", "field_name", "value"))), lambda x: F.struct(x["field_name"], x["value"]))).alias("values"))


def audit_rows(scores: DataFrame, fields: DataFrame, docs: DataFrame, stamp: str) -> DataFrame:
    """Rows for the audit table, without ids, which append_audit gives. docs: doc_id, image_path and document_hash."""
    kept = F.to_json(F.coalesce("values", F.create_map().cast("map<string,string>")))
    joined = scores.join(field_map(fields), "doc_id", "left").join(docs.select("doc_id", "image_path", "document_hash"), "doc_id", "left")
    return joined.select(
        F.lit(stamp).alias("timestamp"), F.coalesce("document_hash", F.lit("UNKNOWN")).alias("document_hash"),
        F.coalesce("image_path", F.lit("")).alias("file_path"), "document_type", F.col("fraud_risk_score").alias("risk_score"), F.col("final_decision").alias("verdict"), kept.alias("extracted_fields"), F.lit("1.0.0").alias("pipeline_version"),
    )


def statistics(audit: DataFrame) -> DataFrame:
    """Counts by verdict: legacy_* compares with PASS and WARN, which no verdict is; the others with the verdicts."""
    v = F.col("verdict")
    return audit.agg(
        F.count("*").alias("total"),
        F.count_if(v == "Genuine").alias("genuine"), F.count_if(v == "Needs Manual Review").alias("review"), F.count_if(v == "Suspicious").alias("suspicious"),
        F.count_if(v == "PASS").alias("legacy_pass"), F.count_if(v == "WARN").alias("legacy_warn"), F.count_if(~v.isin("PASS", "WARN")).alias("legacy_fail"),
    )


def report_json(docs: DataFrame, fields: DataFrame, validations: DataFrame, signals: DataFrame, scores: DataFrame) -> DataFrame:
    """doc_id and json: the export of each document."""
    f = fields.groupBy("doc_id").agg(F.map_from_entries(F.transform(F.array_sort(F.collect_list(F.struct("field_seq", "field_name", F.struct("value", "raw_text", "confidence", F.col("box").alias("bounding_box")).alias("f")))), lambda x: F.struct(x["field_name"], x["f"]))).alias("extracted_fields"))
    listed = lambda t, name, *cols: t.groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("seq", *cols))), lambda x: F.struct(*[x[c].alias(c) for c in cols])).alias(name))
    v = listed(validations, "validation_results", "status", "field_name", "expected", "actual")
    s = listed(signals, "fraud_signals", "name", "score", "description", "source")
    joined = scores.join(docs.select("doc_id", "image_path", "ocr_raw_text"), "doc_id").join(f, "doc_id", "left").join(v, "doc_id", "left").join(s, "doc_id", "left")
    keys = ["image_path", "document_type", "classification_confidence", "ocr_confidence", "extraction_reliability", "fraud_risk_score", "authenticity_score", "final_decision", "ocr_raw_text", "extracted_fields", "validation_results", "fraud_signals"]
    return joined.select("doc_id", F.to_json(F.struct(*keys)).alias("json"))


def escaped(t: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        t = F.replace(t, F.lit(a), F.lit(b))
    return t


def report_html(fields: DataFrame, validations: DataFrame, scores: DataFrame, signals: DataFrame | None = None) -> DataFrame:
    """doc_id and html: a page with the verdict, the fields, the validations and, if there are any, the signals of each document."""
    cell = lambda c: F.concat(F.lit("<td>"), escaped(F.coalesce(c, F.lit(""))), F.lit("</td>"))
    rows = lambda t, order, *cells: t.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, F.concat(F.lit("<tr>"), *cells, F.lit("</tr>")).alias("row")))), lambda x: x["row"]), "").alias("rows"))
    f = rows(fields, "field_seq", cell(display_name(F.col("field_name"))), cell(F.col("value")), cell(F.format_string("%.0f%%", F.col("confidence") * 100))).withColumnRenamed("rows", "f")
    badge = F.concat(F.lit("<td style='color:"), status_colour(F.col("status")), F.lit("'>"), F.col("status"), F.lit("</td>"))
    v = rows(validations, "seq", cell(F.col("field_name")), badge, cell(F.col("actual"))).withColumnRenamed("rows", "v")
    number = lambda c, colour: F.concat(F.lit("<b style='color:"), colour, F.lit("'>"), F.col(c).cast("string"), F.lit("/100</b>"))
    joined = scores.join(f, "doc_id", "left").join(v, "doc_id", "left")
    marked = F.lit("")
    if signals is not None:
        points = F.concat(F.lit(f"<td style='color:{RED}'>+"), F.col("score").cast("string"), F.lit("</td>"))
        joined = joined.join(rows(signals, "seq", cell(F.col("name")), cell(F.col("description")), cell(F.col("source")), points).withColumnRenamed("rows", "s"), "doc_id", "left")
        marked = F.coalesce(F.concat(F.lit("<table>"), F.col("s"), F.lit("</table>")), F.lit(""))
    page = F.concat(
        F.lit("<!DOCTYPE html><html><body><h1>"), escaped(F.col("final_decision")), F.lit("</h1><p>Risk "), number("fraud_risk_score", risk_colour(F.col("fraud_risk_score"))), F.lit(" Authenticity "),
        number("authenticity_score", authenticity_colour(F.col("authenticity_score"))), F.lit("</p><table>"), F.coalesce("f", F.lit("")), F.lit("</table><table>"), F.coalesce("v", F.lit("")), F.lit("</table>"), marked, F.lit("</body></html>"),
    )
    return joined.select("doc_id", page.alias("html"))


def export_all(outputs: dict[str, tuple[DataFrame, str]]) -> dict[str, str]:
    """Writes each named output (a DataFrame and a folder); a failure is logged and the rest still written. Returns the errors."""
    errors = {}
    for name, (df, path) in outputs.items():
        try:
            append_audit(df, path) if name == "audit" else df.write.mode("overwrite").text(path)
        except Exception as e:  # one sink's failure must not stop the others
            log.exception("output %s failed", name)
            errors[name] = str(e)
    return errors
