"""Items that appear together, counted by stripes.

Per item an associative array of its neighbours is built where the records lie;
the arrays travel by (item, segment of neighbours) and are merged key by key on
arrival, so neither a frequent item nor its whole array ever sits in one task.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Entries that one task keeps before it hands its partial stripes on; bounds memory, not the result.
STRIPE_ENTRIES = 200_000
_PARTIAL = "item_a string, segment int, stripe map<string,bigint>"


def normalised(items: Column) -> Column:
    """Distinct trimmed lower-case items in order; null and empty ones do not count."""
    clean = F.transform(items, lambda x: F.lower(F.trim(x)))
    return F.array_sort(F.array_distinct(F.filter(clean, lambda x: x.isNotNull() & (x != ""))))


def _stripes(segments: int):
    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[str, Counter] = defaultdict(Counter)
        entries = 0

        def flush() -> pa.RecordBatch:
            rows: dict[tuple, list] = defaultdict(list)
            for a, stripe in kept.items():
                for b, n in stripe.items():
                    # crc-like stable segment: the same neighbour always falls into the same segment
                    rows[a, sum(b.encode()) % segments].append((b, n))
            return pa.RecordBatch.from_arrays(
                [pa.array([a for a, _ in rows], pa.string()), pa.array([s for _, s in rows], pa.int32()), pa.array(list(rows.values()), pa.map_(pa.string(), pa.int64()))],
                names=["item_a", "segment", "stripe"],
            )

        for batch in batches:
            for a, near in zip(batch.column("item_a").to_pylist(), batch.column("near").to_pylist(), strict=True):
                stripe = kept[a]
                entries -= len(stripe)
                stripe.update(near)
                entries += len(stripe)
                if entries > STRIPE_ENTRIES:
                    yield flush()
                    kept.clear()
                    entries = 0
        if kept:
            yield flush()

    return partial


def _merged(min_count: int):
    """Adds up the stripes of each (item_a, segment); rows come sorted by these, so one segment of one item is held at a time."""

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at: tuple | None = None
        total: Counter = Counter()
        out: list[tuple[str, str, int]] = []

        def flush() -> pa.RecordBatch:
            a, b, n = zip(*out, strict=True)
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(a, pa.string()), pa.array(b, pa.string()), pa.array(n, pa.int64())], names=["item_a", "item_b", "n_ab"])

        for batch in batches:
            for a, segment, stripe in zip(*(batch.column(c).to_pylist() for c in ("item_a", "segment", "stripe")), strict=True):
                if (a, segment) != at:
                    out += [(at[0], b, n) for b, n in total.items() if n >= min_count] if at else []
                    at, total = (a, segment), Counter()
                    if len(out) > STRIPE_ENTRIES:
                        yield flush()
                for b, n in stripe:
                    total[b] += n
        out += [(at[0], b, n) for b, n in total.items() if n >= min_count] if at else []
        if out:
            yield flush()

    return merge


def _g2(k11: Column, a: Column, b: Column, n: Column) -> Column:
    """Log-likelihood ratio of a 2x2 table with marginals a, b and total n."""

    def h(*cells: Column) -> Column:
        return sum((F.when(c > 0, c * F.log(c)).otherwise(0.0) for c in cells), F.lit(0.0))

    k12, k21, k22 = a - k11, b - k11, n - a - b + k11
    return F.greatest(F.lit(0.0), 2 * (h(k11, k12, k21, k22) + h(n) - h(a, n - a) - h(b, n - b)))


def cooccurrence(records: DataFrame, record: str, items: str, *, min_count: int = 1, min_lift: float = 0.0, segments: int = 16) -> DataFrame:
    """Pairs (item_a < item_b) with n_a, n_b, n_ab, n, lift and the log-likelihood ratio ``llr``.

    Counts are of distinct values of ``record``: a record carries an item if any
    of its rows has it, and a pair if one single row has both.  ``items`` is an
    array column, compared after trimming and lower-casing; nulls, empty items,
    null arrays and rows without record id do not count; repeats within a row
    count once.  An empty table gives no pairs.

    ``min_count`` and ``min_lift`` are applied exactly, and used before pairing:
    an item in fewer than ``min_count`` records, or in more than n / ``min_lift``
    of them, cannot be in such a pair (lift <= n / max(n_a, n_b)).
    """
    rows = records.where(F.col(record).isNotNull()).select(F.col(record).alias("r"), normalised(F.col(items)).alias("items")).where(F.size("items") > 0).distinct()
    carried = rows.select("r", F.explode("items").alias("item")).distinct()
    n_item = carried.groupBy("item").agg(F.count(F.lit(1)).alias("n_item"))
    n = rows.agg(F.count_distinct("r")).scalar()
    usable = n_item.where(F.col("n_item") >= min_count).withColumn("n", n).where(F.col("n_item") * min_lift <= F.col("n"))
    # rows reduced to usable items, so that rare neighbours fill no stripe
    token = rows.where(F.size("items") > 1).select("r", F.xxhash64("items").alias("v"), F.explode("items").alias("item"))
    kept = token.join(usable.select("item"), "item", "left_semi").groupBy("r", "v").agg(F.array_sort(F.collect_set("item")).alias("items")).where(F.size("items") > 1)
    # neighbours of an item in one record, over all rows of the record
    near = (
        kept.select("r", "items", F.explode(F.slice("items", 1, F.size("items") - 1)).alias("item_a"))
        .select("r", "item_a", F.filter("items", lambda x: x > F.col("item_a")).alias("near"))
        .groupBy("r", "item_a").agg(F.array_distinct(F.flatten(F.collect_set("near"))).alias("near"))
    )
    stripes = near.select("item_a", "near").mapInArrow(_stripes(segments), _PARTIAL)
    # stripes travel by item and segment and are merged key by key there
    pairs = stripes.repartition("item_a", "segment").sortWithinPartitions("item_a", "segment").mapInArrow(_merged(min_count), "item_a string, item_b string, n_ab bigint")
    a = usable.select(F.col("item").alias("item_a"), F.col("n_item").alias("n_a"), "n")
    b = usable.select(F.col("item").alias("item_b"), F.col("n_item").alias("n_b"))
    lift = F.col("n_ab") * F.col("n") / (F.col("n_a") * F.col("n_b"))
    out = pairs.join(a, "item_a").join(b, "item_b").withColumn("lift", lift).where(F.col("lift") >= min_lift)
    counts = [F.col(c).cast("double") for c in ("n_ab", "n_a", "n_b", "n")]
    return out.select("item_a", "item_b", "n_a", "n_b", "n_ab", "n", "lift", _g2(*counts).alias("llr"))
