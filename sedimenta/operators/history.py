"""History of changing attributes: gaps and islands over all observations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_BLOCK, _HASH, _NEW, _ISLAND = "__block", "__hash", "__new", "__island"


def latest_observation(df: DataFrame, keys: Sequence[str], values: Sequence[str], by: Sequence[str]) -> DataFrame:
    """One row per ``keys``: the ``values`` of the row greatest in ``by``.

    A combining aggregate, so a hot key is reduced before it is shuffled.  Ties
    in ``by`` go to the greatest values, so the result never depends on order.
    """
    best = F.max(F.struct(*by, *[F.col(v).alias(f"__v{i}") for i, v in enumerate(values)])).alias("__b")
    return df.groupBy(*keys).agg(best).select(*keys, *[F.col(f"__b.__v{i}").alias(v) for i, v in enumerate(values)])


def versions(
    observations: DataFrame,
    keys: Sequence[str],
    at: str,
    attributes: Sequence[str],
    *,
    block: Column | None = None,
) -> DataFrame:
    """Versions (keys, attributes, valid_from, valid_to, version_no).

    A version begins at the first observation of a key and wherever the hash of
    ``attributes`` differs from that of the observation before; it holds until
    the next one begins (``valid_to``, null for the current one).

    ``observations`` must hold one row per (keys, ``at``), see
    ``latest_observation``.  Rows with a null key or null ``at`` are left out.
    Nulls in attributes are values of their own.  Repeated rows must have been
    reduced; an empty table gives an empty history; other columns are ignored.

    ``block`` cuts the time line (for example into weeks).  Islands are first
    found within (keys, block); then only one summary row per block is compared
    along the key, so a key that holds a third of all rows is never sorted by a
    single task.
    """
    keys, attributes = list(keys), list(attributes)
    ready = F.col(at).isNotNull()
    for k in keys:
        ready &= F.col(k).isNotNull()
    # attributes of equal hash are compared as well: a collision cannot hide a change
    obs = observations.where(ready).select(
        *keys, F.col(at).alias("__at"), F.struct(*attributes).alias("__attr"), F.xxhash64(*attributes).alias(_HASH),
        (block if block is not None else F.lit(0)).alias(_BLOCK),
    )
    inner = Window.partitionBy(*keys, _BLOCK).orderBy("__at")
    same = F.lag(_HASH).over(inner).eqNullSafe(F.col(_HASH)) & F.lag("__attr").over(inner).eqNullSafe(F.col("__attr"))
    marked = obs.withColumn(_NEW, (~same).cast("int"))
    islands = (
        marked.withColumn(_ISLAND, F.sum(_NEW).over(inner.rowsBetween(Window.unboundedPreceding, 0)))
        .groupBy(*keys, _BLOCK, _ISLAND)
        .agg(F.min("__at").alias("__from"), F.first("__attr").alias("__attr"))
    )
    # one row per block: does its first island continue the last of the block before?
    edges = islands.groupBy(*keys, _BLOCK).agg(
        F.min_by("__attr", _ISLAND).alias("__head"), F.max_by("__attr", _ISLAND).alias("__tail"),
        F.min("__from").alias("__head_from"), F.min(F.when(F.col(_ISLAND) == 2, F.col("__from"))).alias("__second_from"),
        F.max(_ISLAND).alias("__islands"),
    )
    along = Window.partitionBy(*keys).orderBy(_BLOCK)
    joined = F.lag("__islands").over(along).isNotNull() & F.lag("__tail").over(along).eqNullSafe(F.col("__head"))
    edges = edges.withColumn("__joined", joined)
    starts = F.when(F.col("__joined"), F.col("__second_from")).otherwise(F.col("__head_from"))
    own = F.col("__islands") - F.col("__joined").cast("int")
    edges = edges.select(
        *keys, _BLOCK, "__joined", "__islands",
        F.min(starts).over(along.rowsBetween(1, Window.unboundedFollowing)).alias("__next"),
        F.coalesce(F.sum(own).over(along.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"),
    )
    out = islands.join(edges, [*keys, _BLOCK]).where(~(F.col("__joined") & (F.col(_ISLAND) == 1)))
    following = F.lead("__from").over(Window.partitionBy(*keys, _BLOCK).orderBy(_ISLAND))
    return out.select(
        *keys,
        *[F.col("__attr")[a].alias(a) for a in attributes],
        F.col("__from").alias("valid_from"),
        F.coalesce(following, F.col("__next")).alias("valid_to"),
        (F.col("__before") + F.col(_ISLAND) - F.col("__joined").cast("int")).cast("bigint").alias("version_no"),
    )
