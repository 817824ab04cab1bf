"""Mixing sources to target weights.

Token weights are raked to the source, language and topic marginals by
iterative proportional fitting over the cells of the three; a cell's weight is
the mean number of copies of its documents, capped by the source's
``max_repeats``; documents are then taken by these calibrated probabilities
with systematic sampling, so each cell comes out within one document of its
weight.
"""

from __future__ import annotations

import base64
import math
from collections import defaultdict
from collections.abc import Mapping
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the split pattern of the byte-level vocabularies of 50k entries.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
REST = "(other)"
#: Rows of one cell that a sampling bucket holds about; a larger cell is cut into more buckets.
BUCKET_ROWS = 50_000


@lru_cache(maxsize=4)
def _encoding(path: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("mixture", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})


def token_count(text: Column, tokenizer: str = TOKENIZER) -> Column:
    """Tokens of a text in a public vocabulary; a null text has none."""

    def count(texts: pd.Series) -> pd.Series:
        enc = _encoding(tokenizer)
        return pd.Series([len(enc.encode_ordinary(t)) if t else 0 for t in texts], dtype="int64")

    return F.pandas_udf(count, "bigint")(text)


def rake(cells: Mapping[tuple, float], margins: list[Mapping], caps: Mapping[tuple, float], *, rounds: int = 200, tolerance: float = 1e-6) -> dict[tuple, float]:
    """Weight per cell so that weight x tokens meets every margin, as far as the caps allow.

    ``margins[i]`` maps values of the i-th coordinate to their token totals;
    values it lacks are free.  Margins are applied in reverse order, so the
    first one (the source) is met exactly wherever caps allow.  A capped cell
    keeps its cap and the others of its margin make up for it.
    """
    keys = list(cells)
    size, cap = np.array([cells[k] for k in keys]), np.array([caps[k] for k in keys])
    weight = np.ones(len(keys))
    sides = []
    for i in reversed(range(len(margins))):
        values = {v: n for n, v in enumerate(margins[i])}
        at = np.array([values.get(k[i], -1) for k in keys], dtype=int)
        if (at >= 0).any():
            sides.append((at, np.array(list(margins[i].values()), dtype=float)))
    for _ in range(rounds):
        worst = 0.0
        for at, want in sides:
            bound = at >= 0
            held = np.zeros(len(keys), dtype=bool)
            while True:
                free = bound & ~held
                have = np.bincount(at[free], weights=(weight * size)[free], minlength=len(want))
                fixed = np.bincount(at[held], weights=(cap * size)[held], minlength=len(want))
                factor = np.where(have > 0, np.maximum(0.0, want - fixed) / np.where(have > 0, have, 1.0), 1.0)
                scaled = weight * factor[at]
                over = free & (scaled > cap * (1 + 1e-12))
                worst = max(worst, float(np.abs(factor[at[free]] - 1).max(initial=0.0)))
                if not over.any():
                    break
                weight[over] = cap[over]
                held |= over
            weight[free] = scaled[free]
        if worst < tolerance:
            break
    return dict(zip(keys, weight.tolist(), strict=True))


def shares_of(docs: DataFrame, column: str, tokens: str = "tokens") -> dict[str, float]:
    """Token shares of the values of a column over the whole corpus, as a margin to keep; nulls are "(none)".

    For columns of settings such as languages, of which there are few.
    """
    rows = docs.where(F.col(tokens) > 0).groupBy(F.coalesce(F.col(column), F.lit("(none)")).alias("v")).agg(F.sum(tokens).alias("t")).collect()
    whole = sum(r["t"] for r in rows)
    return {r["v"]: r["t"] / whole for r in rows}


def _coordinate(column: str | None, share: Mapping[str, float] | None) -> Column:
    """A value with a share of its own, or one name for all others: without a share of their own they all get one factor, so this folding is exact."""
    if not column or not share:
        return F.lit(REST)
    value = F.coalesce(F.col(column), F.lit("(none)"))
    return F.when(value.isin(list(share)), value).otherwise(F.lit(REST))


def mixture(
    docs: DataFrame,
    targets: DataFrame,
    *,
    doc_id: str = "doc_id",
    source: str = "source",
    language: str | None = "lang",
    topic: str | None = None,
    tokens: str = "tokens",
    total: float | None = None,
    language_share: Mapping[str, float] | None = None,
    topic_share: Mapping[str, float] | None = None,
    seed: int = 0,
) -> DataFrame:
    """(doc_id, source, tokens, copies): the documents of the mixture.

    ``docs`` has token counts; ``targets`` holds source, target_share,
    max_repeats (one row per source; a table of settings).  ``total`` is the
    size in tokens; by default the largest at which every source that has
    documents can reach its share, shares taken among those sources.  Languages
    and topics with a share in ``language_share`` and ``topic_share`` are raked
    to it (relative to the whole, if the shares add up to less than one; "(none)"
    stands for null); all others are free.

    Documents of sources without target (or without source), with null id or
    without tokens are not taken; a target without documents is missing in the
    result and shows in ``reached_shares``.  A repeated row of a document is
    another document.

    What goes to the driver is one row per source and language and topic with a
    share: as many as the settings have, whatever the corpus holds.  Systematic
    sampling runs in buckets of one cell and class of size, as many as its rows
    need, with prefix sums of bucket totals, so a source that holds a third of
    all rows is spread over them.
    """
    wanted = {r["source"]: (float(r["target_share"]), int(r["max_repeats"])) for r in targets.select("source", "target_share", "max_repeats").where("source IS NOT NULL AND target_share > 0 AND max_repeats > 0").distinct().collect()}
    base = docs.where(F.col(source).isin(list(wanted)) & F.col(doc_id).isNotNull() & (F.col(tokens) > 0)).select(
        F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), _coordinate(language, language_share).alias("language"), _coordinate(topic, topic_share).alias("topic"),
        F.col(tokens).alias("tokens"), F.xxhash64(doc_id, F.lit(seed)).alias("h"),
    )
    cell = ["source", "language", "topic"]
    rows = base.groupBy(*cell).agg(F.sum("tokens").alias("t"), F.count(F.lit(1)).alias("n")).collect()
    cells = {(r["source"], r["language"], r["topic"]): float(r["t"]) for r in rows}
    weights = cell_weights(cells, wanted, total, language_share, topic_share)
    spread = {(r["source"], r["language"], r["topic"]): math.ceil(r["n"] / BUCKET_ROWS) for r in rows}
    table = docs.sparkSession.createDataFrame([(*c, w, spread[c]) for c, w in weights.items()] or [("", "", "", 0.0, 1)], "source string, language string, topic string, weight double, buckets int")
    part = base.join(F.broadcast(table), cell).where("weight > 0")  # as many rows as the settings have cells
    # buckets in order of size, so that what is taken has the sizes of the cell; a class of size is spread over several
    part = part.withColumn("bucket", F.floor(F.log2("tokens") * 4) * F.col("buckets") + F.pmod("h", F.col("buckets")))
    # expected copies so far, in order of size; a document is taken as often as whole numbers are passed
    per_bucket = part.groupBy(*cell, "bucket").agg(F.sum("weight").alias("w"))
    before = Window.partitionBy(*cell).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_bucket.select(*cell, "bucket", F.coalesce(F.sum("w").over(before), F.lit(0.0)).alias("offset"))  # cells x buckets
    inside = Window.partitionBy(*cell, "bucket").orderBy("tokens", "h", "doc_id")
    start = F.pmod(F.xxhash64(*cell, F.lit(seed)), F.lit(1_000_000)) / 1_000_000.0
    placed = part.join(offsets, [*cell, "bucket"]).withColumn("upto", F.col("offset") + F.col("weight") * F.row_number().over(inside) + start)
    copies = F.floor(F.col("upto") + 1e-9) - F.floor(F.col("upto") - F.col("weight") + 1e-9)
    return placed.select("doc_id", "source", "tokens", copies.cast("int").alias("copies")).where("copies > 0")


def cell_weights(cells: Mapping[tuple, float], wanted: Mapping[str, tuple[float, int]], total: float | None, language_share: Mapping | None = None, topic_share: Mapping | None = None) -> dict[tuple, float]:
    """Copies per document of each cell, from token totals per cell and (share, cap) per source."""
    size: dict[str, float] = defaultdict(float)
    for (s, _, _), t in cells.items():
        size[s] += t
    among = sum(wanted[s][0] for s in size)
    if not among:
        return {}
    share = {s: wanted[s][0] / among for s in size}
    most = min(wanted[s][1] * size[s] / share[s] for s in size)
    total = most if total is None else total
    by_source = {s: min(share[s] * total, wanted[s][1] * size[s]) for s in size}

    whole = sum(by_source.values())

    def margin(given: Mapping | None) -> dict:
        norm = max(1.0, sum((given or {}).values()))
        return {v: x / norm * whole for v, x in (given or {}).items()}

    caps = {c: float(wanted[c[0]][1]) for c in cells}
    return rake(cells, [by_source, margin(language_share), margin(topic_share)], caps)


def reached_shares(taken: DataFrame, targets: DataFrame) -> DataFrame:
    """(source, target_share, share, tokens, documents, copies, max_copies) of every target, reached or not."""
    per = taken.groupBy("source").agg(
        F.sum(F.col("tokens") * F.col("copies")).alias("tokens"), F.count(F.lit(1)).alias("documents"), F.sum("copies").alias("copies"), F.max("copies").alias("max_copies"),
    )
    whole = per.agg(F.sum("tokens")).scalar()
    return (
        targets.select("source", "target_share").join(per, "source", "left").withColumn("all_tokens", whole)
        .select(
            "source", "target_share", F.coalesce(F.col("tokens") / F.col("all_tokens"), F.lit(0.0)).alias("share"),
            *[F.coalesce(c, F.lit(0)).alias(c) for c in ("tokens", "documents", "copies", "max_copies")],
        )
    )
