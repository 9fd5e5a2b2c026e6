"""Row rejection, verdicts and rule tables."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def drop_reason(id_: Column, target: Column, present: Column) -> Column:
    """Why a row is rejected, the first reason that holds, or kept."""
    bad = F.coalesce(F.trim(id_), F.lit("")).isin("", "nan")
    empty = target.isNull() | (F.regexp_replace(target, r"^\s+|\s+$", "") == "")
    return F.when(bad, "bad_id").when(empty, "empty_target").when(~F.coalesce(present, F.lit(False)), "missing_image").otherwise("kept")


def verdict(value: Column, above: list[tuple[float, str]], otherwise: str) -> Column:
    out = None
    for limit, name in above:
        out = F.when(value > limit, name) if out is None else out.when(value > limit, name)
    return out.otherwise(otherwise)


def multipliers(contrast: Column, tears: Column, stains: Column, paper: Column, texture: Column) -> list[Column]:
    """Augmentation multipliers by condition; a missing metric counts as 0."""
    rule = lambda c, limit, hit: F.when(F.coalesce(c, F.lit(0)) > limit, hit).otherwise(1.0)
    return [
        rule(contrast, 44, 0.0).alias("p_brightness"),
        rule(contrast, 44, 0.0).alias("p_contrast"),
        rule(tears, 7, 1.5).alias("p_elastic"),
        rule(stains, 28, 0.0).alias("p_color"),
        rule(paper, 19, 0.5).alias("hue_sat"),
        rule(texture, 18, 0.0).alias("p_degradation"),
    ]


def condition_class(score: Column) -> Column:
    return F.when(score < 19, "good").when(score < 37, "fair").when(score <= 42, "poor").otherwise("bad")
