"""Rounding, clamping and display numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def round_half_up(value: Column, digits: int) -> Column:
    """Round with halves toward plus infinity."""
    scale = float(10**digits)
    return F.floor(value.cast("double") * scale + 0.5) / F.lit(scale)


def clamp_confidence(value: Column) -> Column:
    """NaN becomes 0; the rest is held within 0 and 1; null stays null."""
    v = value.cast("double")
    return F.when(F.isnan(v), 0.0).when(v.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), v)))


def importance_percent(score: Column) -> Column:
    """Whole percent, 100 at most; 0 for null, NaN, infinite or non-positive scores."""
    v = F.coalesce(score.cast("double"), F.lit(0.0))
    bad = F.isnan(v) | (v <= 0) | (v == float("inf"))
    return F.when(bad, 0).otherwise(F.least(F.lit(100), F.floor(F.least(v, F.lit(2.0)) * 100 + 0.5))).cast("int")


def symbol_size(importance: Column, links: Column, most_links: Column) -> Column:
    """Drawing size of a node from its importance and its share of the largest link count."""
    share = F.sqrt(F.coalesce(F.try_divide(links.cast("double"), most_links), F.lit(0.0)))
    return F.lit(12.0) + F.lit(32.0) * F.greatest(F.coalesce(importance, F.lit(0.0)), share)


def answer_confidence(entries: Column) -> Column:
    """Confidence of an answer that cites `entries` entries."""
    return F.when(entries <= 0, 0.3).otherwise(F.least(F.lit(0.95), F.lit(0.5) + F.lit(0.05) * entries))
