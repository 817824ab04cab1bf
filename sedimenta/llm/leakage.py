"""Evaluation texts leaking into training text: a prefix-filtered set join.

An item leaks into a document if ``window`` consecutive words agree.  Every
window of an item is a set of word shingles that must be contained whole, so by
the prefix filter one shingle of the window, the rarest in the corpus, is
enough to find all candidates.  Its position fixes where the window must lie in
the document (positional bound), the document's length where it may end (length
bound), and the words at that place are compared exactly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sedimenta.session import cut

SHINGLE = 5
#: Distinct item shingles (8 bytes each) that may be broadcast; more are joined by shuffle.
BROADCAST_ROWS = 500_000
#: Parts that the occurrences of one shingle are spread over where they are joined by shuffle.
SALTS = 16


def words(text: Column) -> Column:
    """Lower-case runs of letters or digits, tags dropped first."""
    plain = F.regexp_replace(text, r"</?[A-Za-z][^<>]*>", " ")
    return F.regexp_extract_all(F.lower(plain), F.lit(r"[\p{L}\p{Nd}]+"), F.lit(0))


def _shingles(tokens: Column, size: int) -> Column:
    """Positions and hashes of all runs of ``size`` words."""

    def of(w: Column) -> Column:
        last = F.size(w) - size
        at = F.when(last >= 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))
        return F.transform(at, lambda i: F.struct(i.alias("at"), F.xxhash64(F.slice(w, i + 1, size)).alias("h")))

    return F.element_at(F.transform(F.array(tokens), of), 1)  # the words are split once, not once for each position


def _at(tokens: Column, starts: Column, size: int) -> Column:
    """The runs of ``size`` words at given places, as far as the text reaches."""
    split = F.transform(F.array(tokens), lambda w: F.transform(F.filter(starts, lambda i: i + size <= F.size(w)), lambda i: F.struct(i.alias("start"), F.slice(w, i + 1, size).alias("win"))))
    return F.element_at(split, 1)  # the words are split once, not once for each place


def leaks(docs: DataFrame, items: DataFrame, *, doc_id: str = "doc_id", doc_text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = 10, size: int = SHINGLE) -> DataFrame:
    """(doc_id, item_id, matches, first_word): matching windows of each leaked item.

    Null ids or texts, and texts of fewer than ``window`` words, are never
    reported.  Repeated documents are reported once; items that share a passage
    all are, and so are all texts of a repeated ``item_id``.  Whole texts are
    read, however long: a document becomes rows of (position, shingle hash)
    without its words, of which only those that some item knows are kept, and
    its words are looked at again only where a window may lie.  ``items`` are
    held against all documents in one pass.
    """
    if size > window:
        raise ValueError("a shingle cannot be longer than the window")
    it = items.where(F.col(item_id).isNotNull()).select(F.col(item_id).alias("item_id"), words(F.col(item_text)).alias("w")).where(F.size("w") >= window)
    starts = F.sequence(F.lit(0), F.size("w") - window)
    of_items = cut(it.select("item_id", F.explode(F.transform(starts, lambda i: F.slice("w", i + 1, window))).alias("win")).distinct())
    # every window once, whichever items it is from
    known = cut(of_items.select("win").distinct().select("win", F.explode(_shingles(F.col("win"), size)).alias("s")).select("win", F.col("s.at").alias("off"), F.col("s.h").alias("h")))
    vocabulary = known.select("h").distinct()
    few = vocabulary.count() <= BROADCAST_ROWS
    # all occurrences of item shingles in the corpus
    # a repeated doc_id may come with another text; its hash is taken before the explosion, so that no text rides along
    texts = docs.where(F.col(doc_id).isNotNull() & F.col(doc_text).isNotNull()).select(F.col(doc_id).alias("doc_id"), F.xxhash64(doc_text).alias("v"), F.col(doc_text).alias("text"))
    hits = (
        texts.select("doc_id", "v", F.explode(_shingles(words(F.col("text")), size)).alias("s"))
        .select("doc_id", "v", F.col("s.at").alias("at"), F.col("s.h").alias("h"))
        .join(F.broadcast(vocabulary) if few else vocabulary, "h", "left_semi")
    )
    hits = cut(hits)
    rarity = hits.groupBy("h").agg(F.count(F.lit(1)).alias("df"))
    ordered = Window.partitionBy("win").orderBy(F.col("df"), "h", "off")
    # a shingle that the corpus lacks rules its window out at once
    ranked = known.join(rarity, "h", "left").withColumn("df", F.coalesce("df", F.lit(0))).withColumn("rank", F.row_number().over(ordered))
    prefix = ranked.where("rank = 1 AND df > 0").select("h", "off").distinct()
    if few:
        found = hits.join(F.broadcast(prefix), "h")  # at most ``size`` rows for each of the few shingles
    else:
        salted = prefix.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        found = hits.withColumn("salt", F.pmod(F.xxhash64("doc_id", "at"), F.lit(SALTS)).cast("int")).join(salted, ["h", "salt"])
    places = found.select("doc_id", "v", (F.col("at") - F.col("off")).alias("start")).where("start >= 0").groupBy("doc_id", "v").agg(F.collect_set("start").alias("starts"))  # at most one per word
    w = words(F.col("text"))
    there = texts.join(places, ["doc_id", "v"]).select("doc_id", F.explode(_at(w, F.col("starts"), window)).alias("x")).select("doc_id", "x.*")
    return there.join(of_items, "win").groupBy("doc_id", "item_id").agg(F.count_distinct("start").alias("matches"), F.min("start").alias("first_word"))
