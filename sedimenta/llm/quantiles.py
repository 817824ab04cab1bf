"""Percentiles of very large numeric columns from mergeable sketches.

The sketch is the randomized compactor hierarchy known as KLL: each level sorts
its values and passes every other one, from a random start, to the level above.
Spark ships it as an aggregate, so sketches are built map-side inside the JVM,
merged level by level over the shuffle, and kept in tables as binary values.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Compactor size.  At 400 the rank error of one query is below 0.7 % with 99 % confidence (single-sided, published KLL bounds).
K = 400


def rank_error(k: int = K) -> float:
    """Rank error at 99 % confidence of a sketch of size ``k`` (the published fit)."""
    return 2.296 / k**0.9723


def sketch(df: DataFrame, keys: Sequence[str], value: str, *, k: int = K, counts: Mapping[str, Column] | None = None) -> DataFrame:
    """(keys, sketch, n_values, n_null, min_value, max_value) per group, and further ``counts`` if given.

    Nulls and NaN are counted but not sketched; a group without values keeps a
    null sketch.  A null key is a group of its own.  Repeated rows count as
    often as they come; reduce them first where they are copies.  A hot group
    costs one partial sketch per task.
    """
    ok = F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double"))
    v = F.when(ok, F.col(value).cast("double"))
    return df.groupBy(*keys).agg(
        F.when(F.count(v) > 0, F.kll_sketch_agg_double(v, F.lit(k))).alias("sketch"),
        F.count(v).alias("n_values"), (F.count(F.lit(1)) - F.count(v)).alias("n_null"),
        F.min(v).alias("min_value"), F.max(v).alias("max_value"), *[c.alias(name) for name, c in (counts or {}).items()],
    )


def merge(sketches: DataFrame, keys: Sequence[str], *, k: int = K) -> DataFrame:
    """Combine sketches of separate partitions, days or coarser groups.

    Counts add up, so a row that two loads both hold counts twice: make loads
    disjoint, by the load that a row's key belongs to, before they are sketched.
    """
    return sketches.groupBy(*keys).agg(
        F.when(F.count("sketch") > 0, F.kll_merge_agg_double("sketch", F.lit(k))).alias("sketch"),
        F.sum("n_values").alias("n_values"), F.sum("n_null").alias("n_null"),
        F.min("min_value").alias("min_value"), F.max("max_value").alias("max_value"),
    )


def percentile(q: float) -> Column:
    """The value of rank ``q``; the ends are exact."""
    if q <= 0:
        return F.col("min_value")
    if q >= 1:
        return F.col("max_value")
    return F.when(F.col("sketch").isNotNull(), F.kll_sketch_get_quantile_double("sketch", F.lit(float(q))))


def percentiles(sketches: DataFrame, keys: Sequence[str], ranks: dict[str, float], *counts: str) -> DataFrame:
    return sketches.select(*keys, "n_values", "n_null", *counts, *[percentile(q).alias(name) for name, q in ranks.items()])
