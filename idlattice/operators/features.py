"""The 44 numbers that describe a processed document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.bind import let
from ..functions.scores import ratio
from ..functions.text import text_or_empty
from .classify import TYPES, by_format, by_keywords, by_layout
from .layout import WORDS, mean, total
from .validate import summary

SHORT = {"AADHAAR": "aadhaar", "PAN": "pan", "PASSPORT": "passport", "DRIVING_LICENCE": "dl"}
# The features' names, in the order of the vector.
NAMES = (
    "ocr_mean_conf ocr_min_conf ocr_max_conf ocr_std_conf ocr_pct_low_conf ocr_median_conf word_count char_count avg_word_len valid_words_ratio alphanumeric_ratio "
    "dictionary_match_ratio text_density kw_score_aadhaar kw_score_pan kw_score_passport kw_score_dl rg_score_aadhaar rg_score_pan rg_score_passport rg_score_dl "
    "ly_score_aadhaar ly_score_pan ly_score_passport ly_score_dl blur_score noise_score edge_density bbox_height_std bbox_width_std bbox_area_ratio validation_fails "
    "validation_warns checksum_failed missing_fields_count field_extraction_success_rate overlapping_fields_count layout_anomaly_count exif_editor_detected "
    "exif_timestamp_mismatch regex_match_aadhaar regex_match_pan regex_match_passport regex_match_dl"
).split()
# Words that identity documents use.
DICTIONARY = (
    "aadhaar adhar uidai unique identification authority india government sarkar income tax permanent account number pan father passport republic nationality birth "
    "surname name driving licence license transport vehicle lmv mcwg husband dob address gender male female"
).split()
COUNTS = {
    "regex_match_aadhaar": r"\b[0-9]{4}\s+[0-9]{4}\s+[0-9]{4}\b",
    "regex_match_pan": r"\b[A-Z]{5}[0-9]{4}[A-Z]\b",
    "regex_match_passport": r"\b[A-Z][0-9]{7}\b",
    "regex_match_dl": r"\b[A-Z]{2}[0-9]{2}\s*[0-9]{11}\b|\b[A-Z]{2}-[0-9]{2}-[0-9]{11}\b",
}


def deviation(values: Column) -> Column:
    """Population standard deviation of an array, 0 for none."""
    return let(values, lambda v: let(mean(v, 0.0), lambda m: F.sqrt(mean(F.transform(v, lambda x: (x - m) * (x - m)), 0.0))))


def median(values: Column) -> Column:
    return let(F.array_sort(values), lambda v: (F.get(v, ((F.size(v) - 1) / 2).cast("int")) + F.get(v, (F.size(v) / 2).cast("int"))) / 2)


def text_features(docs: DataFrame) -> DataFrame:
    """doc_id and the features of words, text, boxes and classifiers. docs: ocr_raw_text, ocr_confidence, word_map, and img_w, img_h if known."""
    words, text = F.coalesce(F.col("word_map"), F.array().cast(WORDS)), text_or_empty(F.col("ocr_raw_text"))
    base = docs.withColumns({"words": words, "text": text, "confs": F.transform(words, lambda w: F.coalesce(w["conf"], F.lit(0.0)))})
    confs, n, own = F.col("confs"), F.size("words"), F.col("ocr_confidence").cast("double")
    some = n > 0
    area = F.coalesce(F.col("img_w").cast("double") * F.col("img_h"), F.lit(1e6)) if {"img_w", "img_h"} <= {*docs.columns} else F.lit(1e6)
    count = lambda test: F.size(F.filter("words", test)).cast("double")
    zero = lambda c: F.coalesce(c, F.lit(0))
    written = F.filter("words", lambda w: w["text"] != "")
    out = {
        "ocr_mean_conf": F.when(some, mean(confs)).otherwise(own),
        "ocr_min_conf": F.when(some, F.array_min(confs)).otherwise(own),
        "ocr_max_conf": F.when(some, F.array_max(confs)).otherwise(own),
        "ocr_std_conf": deviation(confs),
        "ocr_pct_low_conf": F.when(some, F.size(F.filter(confs, lambda c: c < 0.6)) / n).otherwise((own < 0.6).cast("double")),
        "ocr_median_conf": F.when(some, median(confs)).otherwise(own),
        "word_count": n.cast("double"),
        "char_count": F.length("text").cast("double"),
        "avg_word_len": mean(F.transform(written, lambda w: F.length(w["text"])), 0.0),
        "valid_words_ratio": ratio(count(lambda w: w["text"].rlike("[a-zA-Z0-9]")), n),
        "alphanumeric_ratio": ratio(F.length(F.regexp_replace("text", r"[^\p{L}\p{N}]", "")), F.length("text")),
        "dictionary_match_ratio": ratio(count(lambda w: F.regexp_replace(F.lower(w["text"]), r"(?U)[^\w]", "").isin(DICTIONARY)), n),
        "text_density": F.length("text") / area,
        "bbox_height_std": deviation(F.transform("words", lambda w: zero(w["height"]))),
        "bbox_width_std": deviation(F.transform("words", lambda w: zero(w["width"]))),
        "bbox_area_ratio": total(F.transform("words", lambda w: zero(w["width"]) * zero(w["height"]))) / area,
    }
    parts = {"kw": by_keywords(F.col("ocr_raw_text")), "rg": by_format(F.col("ocr_raw_text"), F.col("words")), "ly": by_layout(F.col("ocr_raw_text"), F.col("words"))}
    base = base.withColumns(parts)
    for p in parts:
        out |= {f"{p}_score_{SHORT[kind]}": F.when(F.col(f"{p}.document_type") == kind, F.col(f"{p}.score")).otherwise(0.0) for kind in TYPES}
    out |= {name: F.regexp_count("text", F.lit(pattern)).cast("double") for name, pattern in COUNTS.items()}
    return base.select("doc_id", *[c.alias(name) for name, c in out.items()])


def field_features(fields: DataFrame) -> DataFrame:
    """Missing fields and the share of found ones of each document."""
    found = (F.col("value") != "NOT_FOUND") & (F.trim("value") != "")
    return fields.groupBy("doc_id").agg(F.count_if(~F.coalesce(found, F.lit(False))).cast("double").alias("missing_fields_count"), F.avg(F.coalesce(found, F.lit(False)).cast("double")).alias("field_extraction_success_rate"))


def signal_features(signals: DataFrame) -> DataFrame:
    has = lambda test: F.max(test.cast("int")).cast("double")
    name = F.col("name")
    return signals.groupBy("doc_id").agg(
        F.count_if(F.contains(name, F.lit("overlapping"))).cast("double").alias("overlapping_fields_count"),
        F.count_if(F.contains(name, F.lit("layout_anomaly"))).cast("double").alias("layout_anomaly_count"),
        has(name == "editing_software_detected").alias("exif_editor_detected"),
        has(name == "timestamp_mismatch").alias("exif_timestamp_mismatch"),
    )


def features(docs: DataFrame, fields: DataFrame | None = None, validations: DataFrame | None = None, signals: DataFrame | None = None, pixels: DataFrame | None = None) -> DataFrame:
    """doc_id and NAMES, all double. What isn't known yet counts as 0, as for images without pixels.

    All inputs are keyed by doc_id, so their joins share one partitioning.
    """
    out = text_features(docs)
    parts = [
        None if fields is None else field_features(fields),
        None if validations is None else summary(validations),
        None if signals is None else signal_features(signals),
        None if pixels is None else pixels.select("doc_id", "blur_score", "noise_score", "edge_density"),
    ]
    for p in parts:
        if p is not None:
            out = out.join(p, "doc_id", "left")
    return out.select("doc_id", *[(F.coalesce(F.col(c).cast("double"), F.lit(0.0)) if c in out.columns else F.lit(0.0)).alias(c) for c in NAMES])
