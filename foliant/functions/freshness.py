"""Decay of documents by age. `now` is a parameter everywhere, in epoch milliseconds."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

DAY = 86_400_000
# Half-lives and review intervals in days; null means never. Penalties in points.
HALF_LIFE = {"regulation": 730, "contract": 730, "manual": 365, "report": 1095, "minutes": None, "slide": 540, "sheet": 540, "other": 540}
REVIEW = {"regulation": 365, "contract": 365, "manual": 180}
OVERDUE, OVERDUE_DAYS, NO_OWNER, SUPERSEDED, LOW_CONFIDENCE = 30.0, 180, 15.0, 20.0, 5.0
HEALTHY, FAIR, TRUSTED = 80, 50, 0.6


def _lookup(table: dict[str, int | None], key: Column, default: Column) -> Column:
    c = default
    for k, v in table.items():
        c = F.when(key == k, F.lit(v).cast("double")).otherwise(c)
    return c


def days_between(a: Column, b: Column) -> Column:
    return F.greatest(F.lit(0), F.floor((b - a) / DAY)).cast("long")


def review_due(doc_type: Column, interval: Column, reviewed: Column, effective: Column, created: Column) -> Column:
    """When a review is due: the interval of the document or of its type after the last review, effect or creation; null for none."""
    every = F.coalesce(interval.cast("double"), _lookup(REVIEW, doc_type, F.lit(None).cast("double")))
    return (F.coalesce(reviewed, effective, created) + every * DAY).cast("long")


def freshness(doc_type: Column, age_days: Column, overdue_days: Column, has_owner: Column, superseded: Column, low_confidence: Column) -> Column:
    """0 to 100: half-life decay less penalties. overdue_days null: not overdue."""
    half = _lookup(HALF_LIFE, F.coalesce(doc_type, F.lit("other")), F.lit(float(HALF_LIFE["other"])))
    score = F.when(half.isNull(), F.lit(100.0)).otherwise(F.lit(100.0) * F.pow(F.lit(0.5), age_days / half))
    score = score - F.when(overdue_days.isNotNull(), F.lit(OVERDUE) * F.least(F.lit(1.0), overdue_days / OVERDUE_DAYS)).otherwise(0.0)
    score = score - F.when(has_owner, 0.0).otherwise(NO_OWNER) - F.when(superseded, SUPERSEDED).otherwise(0.0) - F.when(low_confidence, LOW_CONFIDENCE).otherwise(0.0)
    return F.greatest(F.lit(0.0), F.least(F.lit(100.0), score))


def band(score: Column) -> Column:
    return F.when(score >= HEALTHY, "healthy").when(score >= FAIR, "review").otherwise("action")
