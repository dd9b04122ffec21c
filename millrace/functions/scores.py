"""Scores, bands, limits and factors as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def banded(value: Column, bands: list[tuple[float, str]], rest: str) -> Column:
    """The name of the first limit that a value reaches, else `rest`; null has no band but the rest."""
    out = None
    for least, name in bands:
        hit = value >= least
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.otherwise(rest)


def bucketed(value: Column, high: float = 0.7, medium: float = 0.4) -> Column:
    """high, medium or low by the magnitude, beyond the limits."""
    v = F.abs(value)
    return F.when(v > high, "high").when(v > medium, "medium").otherwise("low")


def batch_size(free: Column, usable: float, fixed: float, each: float, most: int = 64) -> Column:
    """How many samples fit into the usable part of free memory beside a fixed amount; 1 to `most`."""
    return F.greatest(F.least(F.floor((free * usable - fixed) / each), F.lit(most)), F.lit(1)).cast("long")


def clip_factor(norm: Column, limit: float) -> Column:
    """What a gradient of that norm is multiplied with so that it does not exceed the limit."""
    return F.when(norm > limit, limit / norm).otherwise(F.lit(1.0))


def of_largest(value: Column, key: str) -> Column:
    """A value divided by the largest magnitude of its key."""
    return value / F.max(F.abs(value)).over(W.partitionBy(key))


def focal_loss(prob: Column, label: Column, alpha: float = 0.25, gamma: float = 2.0) -> Column:
    p = F.greatest(F.lit(1e-6), F.least(F.lit(1 - 1e-6), prob))
    return F.when(label == 1, -alpha * F.pow(1 - p, gamma) * F.log(p)).otherwise(-(1 - alpha) * F.pow(p, gamma) * F.log(1 - p))


def path_confidence(length: Column) -> Column:
    """1 for a path of no step, less for each more."""
    return F.least(1 / (1 + 0.1 * length), F.lit(1.0))


def plausibility(a: Column, b: Column, same_syntax: Column) -> Column:
    """0.4 by edit distance, 0.3 by common words (split at single spaces), 0.3 if both parse alike."""
    x, y = F.array_distinct(F.split(a, " ")), F.array_distinct(F.split(b, " "))
    near = 1 - F.levenshtein(a, b) / F.greatest(F.lit(1), F.length(a), F.length(b))
    common = F.size(F.array_intersect(x, y)) / F.greatest(F.lit(1), F.size(F.array_union(x, y)))
    return 0.4 * near + 0.3 * common + F.when(same_syntax, 0.3).otherwise(0.0)


def exposure(parts: list[tuple[Column, float]]) -> Column:
    """A weighted sum of parts between 0 and 1, kept between 0 and 1; a missing part counts nothing."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), sum((F.coalesce(c, F.lit(0.0)) * w for c, w in parts), F.lit(0.0))))


def fused(a: Column, b: Column, c: Column, uncertainty: Column) -> Column:
    """Mean of three probabilities, moving to that of the first two as the third gets uncertain."""
    return (1 - uncertainty) * (a + b + c) / 3 + uncertainty * (a + b) / 2


def percent_of(part: str, whole: str) -> Column:
    return F.round(100.0 * F.col(part) / F.col(whole), 4)


def fallback(*values: Column, truthy: bool) -> Column:
    """The first value that is there; with truthy the first that is neither null nor 0."""
    return F.coalesce(*((F.nullif(v, F.lit(0.0)) if truthy else v) for v in values[:-1]), values[-1])


def capped_rate(value: Column, scale: float, least: float, floor: float, cap: float) -> Column:
    """value / scale, at most `cap`; `floor` where the value is below `least`."""
    return F.when(value < least, F.lit(floor)).otherwise(F.least(value / scale, F.lit(cap)))


def vector_checks(df: DataFrame, key: str, vector: str) -> DataFrame:
    """(key, norm, var, nans) over all numbers of a key's vectors."""
    x = df.select(key, F.explode(vector).alias("f")).select(key, F.col("f").cast("double").alias("x"))
    return x.groupBy(key).agg(F.round(F.sqrt(F.sum(F.col("x") * F.col("x"))), 4).alias("norm"), F.round(F.var_pop("x"), 6).alias("var"), F.count_if(F.isnan("x")).alias("nans"))


def centred_slice(n: Column, size: int) -> tuple[Column, Column]:
    """(start, end) of `size` places around the middle of n, moved inward at the ends."""
    end = F.least(n, F.greatest(F.lit(0), F.floor(n / 2) - size // 2) + size)
    start = F.greatest(F.lit(0), end - size)
    return start, F.least(n, start + size)
