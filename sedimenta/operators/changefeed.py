"""Applying a feed of inserts, updates and deletes as a signed multiset.

Each distinct change adds its own image once (+1) and takes away the image that
stood before it (-1).  Along one key the sum telescopes: whatever order the
rows arrive in and however often they are repeated, exactly the last image
keeps a positive multiplicity.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

UPSERT, DELETE = 1, 0
_OP, _ID, _SALT, _MULT = "__op", "__image", "__salt", "__mult"


def _signed_survivors(events: DataFrame, part: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """Sum +1 after-images and -1 before-images per ``part``; keep what stays positive.

    ``events`` holds distinct images.  All three steps (lag, signed rows, sum)
    share one hash partitioning on ``part``.
    """
    rest = [c for c in events.columns if c not in part]
    chain = events.select(*part, F.struct(*rest).alias("after"), F.lag(F.struct(*rest)).over(Window.partitionBy(*part).orderBy(*order)).alias("before"))
    plus = F.struct(F.lit(1).alias("m"), F.col("after").alias("i"))
    minus = F.struct(F.lit(-1).alias("m"), F.col("before").alias("i"))
    signed = chain.select(*part, F.explode(F.array(plus, minus)).alias("s")).where("s.i IS NOT NULL").select(*part, "s.i.*", F.col("s.m").alias(_MULT))
    return signed.groupBy(*part, *rest).agg(F.sum(_MULT).alias(_MULT)).where(f"{_MULT} > 0").select(*part, *rest)


def apply_changes(
    changes: DataFrame,
    key: str,
    order: Sequence[Column],
    image: Sequence[str],
    *,
    base: DataFrame | None = None,
    deletes: DataFrame | None = None,
    sequence: str,
    salts: int | None = None,
) -> DataFrame:
    """Current state of a table: columns ``key`` and ``image`` of the live rows.

    * ``changes`` - after-images (inserts and updates), any order, any repeats.
      ``base`` - rows already applied, same columns; they take part with their
      own version, so a stale replay cannot replace them.
    * ``deletes`` - columns ``key`` and ``sequence``.  A delete removes a key
      if it is strictly later than the newest image of the key.
    * ``sequence`` - the column that orders changes against deletes; ``order``
      - ascending order of the changes among equal ``sequence`` (last wins), as
      columns over ``image``.

    Nulls: rows without key are no records and come out nowhere; a delete
    without ``sequence`` orders after nothing and is ignored; an image without
    ``sequence`` is older than any that has one.  Rows that agree in key and
    whole image are one change.  Ties in ``order`` are broken by the image
    itself.  Empty inputs give an empty result.  Extra columns play no part.

    Skew: rows are first reduced within (key, salt), where the salt is a hash
    of the image, so a key holding a third of all rows is spread over
    ``salts`` tasks (by default as many as the session's shuffle partitions) and leaves at most one image per salt for the second sum.
    """
    image = list(dict.fromkeys([sequence, *image]))
    feed = changes.select(key, *image)
    if base is not None:
        feed = feed.unionByName(base.select(key, *image))
    feed = feed.where(F.col(key).isNotNull()).withColumn(_OP, F.lit(UPSERT))
    if deletes is not None:
        gone = deletes.select(key, sequence).where(F.col(key).isNotNull() & F.col(sequence).isNotNull()).withColumn(_OP, F.lit(DELETE))
        feed = feed.unionByName(gone, allowMissingColumns=True)
    cols = [key, *image, _OP]
    # equal sequence: the delete sorts first, the record stays
    ranks = [F.col(sequence).asc_nulls_first(), F.col(_OP).asc(), *order, *[F.col(c).asc_nulls_first() for c in image]]
    salts = salts or int(feed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # the distinct combines repeats before they are shuffled
    distinct = feed.distinct().withColumn(_SALT, F.pmod(F.xxhash64(*image, _OP), F.lit(salts)))
    local = _signed_survivors(distinct, [key, _SALT], ranks).drop(_SALT)
    live = _signed_survivors(local, [key], ranks)
    return live.where(F.col(_OP) == UPSERT).select(key, *image)
