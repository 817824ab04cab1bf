"""Queries of the training-data operators over the test tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sedimenta.llm.cooccurrence import cooccurrence
from sedimenta.llm.leakage import leaks
from sedimenta.llm.markup import analysed
from sedimenta.llm.mixture import mixture, reached_shares, shares_of, token_count
from sedimenta.llm.pii import linked, mentions, redacted
from sedimenta.llm.quantiles import merge, percentiles, rank_error, sketch
from sedimenta.llm.residue import residue
from sedimenta.session import cut, scan


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = cooccurrence(scan(spark, sf_dir, "questions"), "question_id", "tags", min_count=5, min_lift=2.3)
    return pairs.select(F.col("item_a").alias("tag_a"), F.col("item_b").alias("tag_b"))


def p4_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pairs with their counts and significance."""
    return cooccurrence(scan(spark, sf_dir, "questions"), "question_id", "tags").withColumnsRenamed({"item_a": "tag_a", "item_b": "tag_b"}).withColumns({"lift": F.round("lift", 9), "llr": F.round("llr", 6)})


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    posts = scan(spark, sf_dir, "questions").where("_record_hash IS NOT NULL").select(
        F.col("_record_hash").alias("record_hash"), analysed(F.col("title"))["markup"].alias("title"), analysed(F.col("body"))["markup"].alias("body")
    )
    kinds = posts.select("record_hash", F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).alias("kinds")) for c in ("title", "body")])).alias("x"))
    return kinds.select("record_hash", "x.field", F.explode("x.kinds").alias("markup")).distinct()


def p5_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles and bodies as clean text."""
    posts = scan(spark, sf_dir, "questions")
    return posts.select(F.col("_record_hash").alias("record_hash"), analysed(F.col("title"))["clean"].alias("title"), analysed(F.col("body"))["clean"].alias("body"))


def _bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = [scan(spark, sf_dir, t).select(F.lit(kind).alias("post_type"), F.col("_record_hash").alias("record_hash"), "body") for t, kind in (("questions", "question"), ("answers", "answer"))]
    return parts[0].unionByName(parts[1]).where("body IS NOT NULL AND record_hash IS NOT NULL")


def _mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mentions(_bodies(spark, sf_dir), ["post_type", "record_hash"], "body", "test-salt")


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every mention with a pseudonym, but for dates of birth, which are a type beside the five."""
    return _mentions(spark, sf_dir).where("pii_type <> 'birth_date'").select("post_type", "record_hash", "pii_type", "mention")


def p6_linked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """In how many posts each value occurs, by its pseudonym."""
    return linked(_mentions(spark, sf_dir), ["post_type", "record_hash"])


def p6_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The bodies with typed placeholders."""
    return _bodies(spark, sf_dir).select("post_type", "record_hash", redacted(F.col("body"), "test-salt")["text"].alias("body"))


RANKS = {"p25": 0.25, "median": 0.5, "p75": 0.75, "p90": 0.9, "p99": 0.99}


def _hours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each question once, however often it was exported; hours that are not positive are no waiting times, they count as missing and are told as ``negative``."""
    fact = scan(spark, sf_dir, "fact_question").select("question_id", "created_date_key", "owner_user_key", "hours_to_first_answer").distinct()
    return fact.select(F.floor(F.col("created_date_key") / 100).cast("int").alias("month"), "owner_user_key", F.when(F.col("hours_to_first_answer") > 0, F.col("hours_to_first_answer")).alias("hours"), (F.col("hours_to_first_answer") <= 0).alias("negative"))


def p7_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Percentiles per month and per owner: ``grain`` tells which of the two a row is for."""
    hours = _hours(spark, sf_dir).withColumn("month", F.col("month").cast("string"))
    counts = {"n_not_positive": F.count_if("negative")}
    parts = [percentiles(sketch(hours, [k], "hours", counts=counts), [k], RANKS, *counts).select(F.lit(g).alias("grain"), F.col(k).alias("group_key"), "n_values", "n_null", *counts, *RANKS) for g, k in (("month", "month"), ("owner", "owner_user_key"))]
    return parts[0].unionByName(parts[1])


def p7_merged_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Percentiles per year out of the sketches of its months: what separate loads keep can be combined."""
    months = sketch(_hours(spark, sf_dir), ["month"], "hours").withColumn("year", F.floor(F.col("month") / 100).cast("int"))
    return percentiles(merge(months, ["year"]), ["year"], RANKS)


def p7_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per month whether the exact ranks of the percentiles lie within the stated error."""
    hours = _hours(spark, sf_dir).select("month", "hours")
    got = percentiles(sketch(hours, ["month"], "hours"), ["month"], RANKS).where("n_values > 0").withColumnRenamed("month", "m")
    # one pass over the values: how many lie at or below, and below, each percentile of their month
    at = [F.count(F.when(F.col("hours") <= F.col(n), 1)).alias(f"le_{n}") for n in RANKS] + [F.count(F.when(F.col("hours") < F.col(n), 1)).alias(f"lt_{n}") for n in RANKS]
    ranks = hours.where("hours IS NOT NULL").join(got, F.equal_null("month", "m")).select("month", "hours", *RANKS).groupBy("month").agg(F.count(F.lit(1)).alias("n"), *at)
    slack = rank_error() + 1 / F.col("n")  # the step from one value to the next
    good = [(F.col(f"lt_{n}") / F.col("n") <= q + slack) & (F.col(f"le_{n}") / F.col("n") >= q - slack) for n, q in RANKS.items()]
    return ranks.select("month", "n", *[g.alias(f"{n}_within") for n, g in zip(RANKS, good, strict=True)])


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(scan(spark, sf_dir, "documents"), scan(spark, sf_dir, "eval_items")).select("doc_id", "item_id")


def _sized(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with their tokens, counted once."""
    return cut(scan(spark, sf_dir, "documents").select("doc_id", "source", "lang", "post_type", token_count(F.col("text")).alias("tokens")))


def p9_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources by their targets, while languages and kinds of post keep the shares they have in the corpus."""
    docs = _sized(spark, sf_dir)
    return mixture(docs, scan(spark, sf_dir, "mix_targets"), topic="post_type", language_share=shares_of(docs, "lang"), topic_share=shares_of(docs, "post_type"))


def p9_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shares really reached, per target source."""
    return reached_shares(p9_mixture(spark, sf_dir), scan(spark, sf_dir, "mix_targets"))


def p9_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether each source with documents has its share within two in a hundred, and no document is taken too often."""
    targets = scan(spark, sf_dir, "mix_targets")
    reached = reached_shares(p9_mixture(spark, sf_dir), targets).where("documents > 0").join(targets.select("source", "max_repeats"), "source")
    among = reached.agg(F.sum("target_share")).scalar()
    return reached.select("source", (F.abs(F.col("share") - F.col("target_share") / among) < 0.02).alias("share_met"), (F.col("max_copies") <= F.col("max_repeats")).alias("repeats_met"))


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return residue(scan(spark, sf_dir, "documents")).where("is_residue").select("doc_id")


def p10_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents without residue."""
    docs = scan(spark, sf_dir, "documents")
    return docs.join(residue(docs).where("is_residue").select("doc_id"), "doc_id", "left_anti")


_P4 = """
WITH rows_ AS (SELECT DISTINCT question_id, list_sort(list_distinct([lower(trim(x)) FOR x IN tags IF x IS NOT NULL AND trim(x) <> ''])) AS items
  FROM questions WHERE question_id IS NOT NULL),
carried AS (SELECT DISTINCT question_id, unnest(items) AS item FROM rows_),
n_item AS (SELECT item, count(*) AS k FROM carried GROUP BY 1),
n_all AS (SELECT count(DISTINCT question_id) AS n FROM carried),
a AS (SELECT question_id, items, unnest(items) AS tag_a FROM rows_),
ab AS (SELECT DISTINCT question_id, tag_a, tag_b FROM (SELECT question_id, tag_a, unnest(items) AS tag_b FROM a) WHERE tag_a < tag_b),
pairs AS (SELECT tag_a, tag_b, count(*) AS n_ab FROM ab GROUP BY 1, 2),
full_ AS (SELECT p.tag_a, p.tag_b, x.k AS n_a, y.k AS n_b, p.n_ab, n, p.n_ab * n::DOUBLE / (x.k * y.k) AS lift
  FROM pairs p JOIN n_item x ON x.item = tag_a JOIN n_item y ON y.item = tag_b CROSS JOIN n_all)
"""
_H = "CASE WHEN {0} > 0 THEN {0} * ln({0}::DOUBLE) ELSE 0 END"
_LLR = "2 * (" + " + ".join(_H.format(f"({c})") for c in ("n_ab", "n_a - n_ab", "n_b - n_ab", "n - n_a - n_b + n_ab", "n")) + " - " + " - ".join(_H.format(f"({c})") for c in ("n_a", "n - n_a", "n_b", "n - n_b")) + ")"

_P8_WORDS = r"regexp_extract_all(lower(regexp_replace(text, '</?[A-Za-z][^<>]*>', ' ', 'g')), '[\p{L}\p{Nd}]+')"

_HOURS = """SELECT DISTINCT question_id, created_date_key, owner_user_key, hours_to_first_answer FROM fact_question"""

ORACLES = {
    "p7_check": f"""SELECT CAST(floor(created_date_key / 100) AS INTEGER) AS month, count(*) AS n, {", ".join(f"true AS {n}_within" for n in RANKS)}
  FROM ({_HOURS}) WHERE hours_to_first_answer > 0 GROUP BY 1""",
    "p9_check": "SELECT source, true AS share_met, true AS repeats_met FROM mix_targets WHERE target_share > 0 AND max_repeats > 0 AND source IN (SELECT source FROM documents WHERE length(text) > 0)",
    "p4_found": _P4 + "SELECT tag_a, tag_b FROM full_ WHERE n_ab >= 5 AND lift >= 2.3",
    "p4_pairs": _P4 + f"SELECT tag_a, tag_b, n_a, n_b, n_ab, n, round(lift, 9) AS lift, round(greatest(0, {_LLR}), 6) AS llr FROM full_",
    "p8_found": f"""
WITH d AS (SELECT doc_id, {_P8_WORDS} AS w FROM documents),
i AS (SELECT item_id, {_P8_WORDS} AS w FROM eval_items),
dw AS (SELECT doc_id, array_to_string(w[s:s + 9], ' ') AS win FROM (SELECT doc_id, w, unnest(range(1, len(w) - 8)) AS s FROM d)),
iw AS (SELECT DISTINCT item_id, array_to_string(w[s:s + 9], ' ') AS win FROM (SELECT item_id, w, unnest(range(1, len(w) - 8)) AS s FROM i))
SELECT DISTINCT doc_id, item_id FROM dw JOIN iw USING (win)""",
}

QUERIES = {
    "p4_found": p4_found, "p4_pairs": p4_pairs,
    "p7_percentiles": p7_percentiles, "p7_merged_percentiles": p7_merged_percentiles, "p7_check": p7_check,
    "p5_found": p5_found, "p5_clean": p5_clean, "p6_found": p6_found, "p6_redacted": p6_redacted, "p6_linked": p6_linked, "p8_found": p8_found, "p9_mixture": p9_mixture, "p9_shares": p9_shares, "p9_check": p9_check, "p10_found": p10_found, "p10_clean": p10_clean,
}
