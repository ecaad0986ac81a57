"""The two entries of the engine: classification with extraction, and verification."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import models
from ..operators.classify import classify
from ..operators.extract import extract
from ..operators.features import features
from ..operators.fraud import signals
from ..operators.merge import with_overrides
from ..operators.scoring import THRESHOLDS, scores
from ..operators.validate import validate
from .storage import stored


@dataclass
class Verified:
    fields: DataFrame
    validations: DataFrame
    signals: DataFrame
    features: DataFrame
    scores: DataFrame
    rejected: DataFrame


def process_classification(docs: DataFrame, as_of: str) -> tuple[DataFrame, DataFrame]:
    """Classified documents and their fields. docs: doc_id, ocr_raw_text, ocr_confidence, word_map, exif_tags."""
    typed = classify(docs)
    return typed, extract(typed, as_of)


def process_verification(typed: DataFrame, as_of: str, overrides: DataFrame | None = None, thresholds: dict[str, float] = THRESHOLDS, model_path: str | None = None) -> Verified:
    """Fields, findings and verdicts of documents with a known type; the others are rejected.

    Classified documents, fields and findings are each written once and read back; all are
    keyed by doc_id. model_path: a folder of trained models; without one, or if they
    can't be loaded, rules give the scores.
    """
    if overrides is not None:
        typed = with_overrides(typed, overrides)
    typed = stored(typed, "typed")
    known = typed.where(F.col("document_type") != "UNKNOWN")
    fields = stored(extract(known, as_of), "fields")
    checked = stored(validate(fields, as_of), "validations")
    marks = stored(signals(known, fields), "signals")
    numbers = features(known, fields, checked, marks)
    return Verified(fields, checked, marks, numbers, models.trained_or_ruled(typed.sparkSession, model_path, numbers, scores(known, numbers, fields, checked, marks, thresholds)), typed.where(F.col("document_type") == "UNKNOWN"))
