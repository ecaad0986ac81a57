"""Scores, bands and verdicts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def sigmoid(x: Column, center: float = 0.6, temperature: float = 0.3) -> Column:
    return 1 / (1 + F.exp(-(x - center) / temperature))


def to_score(x: Column) -> Column:
    """0 to 1 as 0 to 100, half to even."""
    return F.bround(F.least(F.greatest(F.coalesce(x, F.lit(0.0)), F.lit(0.0)), F.lit(1.0)) * 100).cast("int")


def ratio(a: Column, b: Column) -> Column:
    """a / b, 0 for no b."""
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def verdict(authenticity: Column, fraud: Column, genuine: int = 75, fake: int = 40, risky: int = 60, safe: int = 25) -> Column:
    return (
        F.when((authenticity >= genuine) & (fraud <= safe), F.lit("Genuine"))
        .when((authenticity < fake) | (fraud >= risky), F.lit("Suspicious"))
        .otherwise(F.lit("Needs Manual Review"))
    )


def risk_tier(risk: Column) -> Column:
    return F.when(risk <= 20, F.lit("LOW")).when(risk <= 50, F.lit("MEDIUM")).when(risk <= 75, F.lit("HIGH")).otherwise(F.lit("CRITICAL"))


def confidence_band(percent: Column) -> Column:
    return F.when(percent >= 80, F.lit("high")).when(percent >= 60, F.lit("medium")).otherwise(F.lit("low"))
