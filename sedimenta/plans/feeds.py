"""Queries on change feeds and attribute histories of the Q&A tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sedimenta.operators.changefeed import apply_changes
from sedimenta.operators.history import latest_observation, versions
from sedimenta.session import scan

#: Length of a block of the time line; (key, second) is unique, so a block holds at most this many rows of a key.
BLOCK_SECONDS = 28 * 86_400


def live_questions(spark: SparkSession, sf_dir: str, *extra: str) -> DataFrame:
    """Live questions with their current record; ``extra`` columns come along."""
    feed = scan(spark, sf_dir, "questions")
    deletes = scan(spark, sf_dir, "deleted_questions").where("is_deleted").select("question_id", F.timestamp_seconds("detected_at").alias("_extracted_at"))
    order = [F.col("last_activity_date").asc_nulls_first(), F.col("_record_hash").desc_nulls_first()]
    return apply_changes(
        feed, "question_id", order, ["_extracted_at", "last_activity_date", "_record_hash", *extra], deletes=deletes, sequence="_extracted_at",
    )


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return live_questions(spark, sf_dir).select("question_id", F.col("_record_hash").alias("record_hash"))


def p1_live_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The live table's own columns, not only its keys."""
    return live_questions(spark, sf_dir, "score", "view_count", "is_answered").select("question_id", "score", "view_count", "is_answered", "_extracted_at")


def question_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    shots = scan(spark, sf_dir, "question_snapshots").where("question_id IS NOT NULL AND snapshot_at IS NOT NULL AND score IS NOT NULL AND view_count IS NOT NULL")
    one = latest_observation(shots, ["question_id", "snapshot_at"], ["score", "view_count"], ["_extracted_at"])
    return versions(one, ["question_id"], "snapshot_at", ["score", "view_count"], block=F.floor(F.col("snapshot_at") / BLOCK_SECONDS))


def owner_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    seen = [scan(spark, sf_dir, t).select(F.col("owner.user_id").alias("user_id"), F.unix_seconds("_extracted_at").alias("at"), F.col("owner.reputation").alias("reputation"), "_extracted_at") for t in ("questions", "answers")]
    both = seen[0].unionByName(seen[1]).where("user_id IS NOT NULL AND reputation IS NOT NULL AND at IS NOT NULL")
    one = latest_observation(both, ["user_id", "at"], ["reputation"], ["_extracted_at"])
    return versions(one, ["user_id"], "at", ["reputation"], block=F.floor(F.col("at") / BLOCK_SECONDS))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = question_versions(spark, sf_dir).select(F.lit("question").alias("entity"), F.col("question_id").alias("entity_id"), "valid_from")
    o = owner_versions(spark, sf_dir).select(F.lit("owner").alias("entity"), F.col("user_id").alias("entity_id"), "valid_from")
    return q.unionByName(o)


def p2_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Versions of questions with their whole period of validity."""
    return question_versions(spark, sf_dir)


def p2_owner_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Versions of owners with their whole period of validity."""
    return owner_versions(spark, sf_dir)


P1_CURRENT = """
WITH ranked AS (
  SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY _extracted_at DESC NULLS LAST,
         last_activity_date DESC NULLS LAST, _record_hash ASC) AS rn
  FROM questions WHERE question_id IS NOT NULL),
live AS (
  SELECT r.* FROM ranked r WHERE rn = 1 AND NOT EXISTS (
    SELECT 1 FROM deleted_questions d WHERE d.question_id = r.question_id AND d.is_deleted
      AND d.detected_at * 1000000 > epoch_us(r._extracted_at)))
"""

P2_QUESTION = """
shots AS (
  SELECT question_id, snapshot_at, score, view_count FROM (
    SELECT *, row_number() OVER (PARTITION BY question_id, snapshot_at ORDER BY _extracted_at DESC, score DESC, view_count DESC) AS rn
    FROM question_snapshots WHERE score IS NOT NULL AND view_count IS NOT NULL AND question_id IS NOT NULL AND snapshot_at IS NOT NULL) WHERE rn = 1),
shot_marks AS (
  SELECT *, lag(score) OVER w AS s0, lag(view_count) OVER w AS v0 FROM shots WINDOW w AS (PARTITION BY question_id ORDER BY snapshot_at)),
question_starts AS (SELECT * FROM shot_marks WHERE s0 IS NULL OR s0 <> score OR v0 <> view_count)
"""

P2_OWNER = """
seen AS (
  SELECT owner.user_id AS user_id, epoch_us(_extracted_at) // 1000000 AS seen_at, max(owner.reputation) AS reputation
  FROM (SELECT owner, _extracted_at FROM questions UNION ALL SELECT owner, _extracted_at FROM answers)
  WHERE owner.user_id IS NOT NULL AND owner.reputation IS NOT NULL AND _extracted_at IS NOT NULL GROUP BY 1, 2),
marks AS (SELECT *, lag(reputation) OVER (PARTITION BY user_id ORDER BY seen_at) AS r0 FROM seen)
"""

ORACLES = {
    "p2_owner_history": "WITH " + P2_OWNER + """
SELECT user_id, reputation, seen_at AS valid_from, lead(seen_at) OVER w AS valid_to, row_number() OVER w AS version_no
FROM marks WHERE r0 IS NULL OR r0 <> reputation WINDOW w AS (PARTITION BY user_id ORDER BY seen_at)""",
    "p1_found": P1_CURRENT + "SELECT question_id, _record_hash AS record_hash FROM live",
    "p1_live_scores": P1_CURRENT + "SELECT question_id, score, view_count, is_answered, _extracted_at FROM live",
    "p2_found": "WITH " + P2_QUESTION + "," + P2_OWNER + """
SELECT 'question' AS entity, question_id AS entity_id, snapshot_at AS valid_from FROM question_starts
UNION ALL SELECT 'owner', user_id, seen_at FROM marks WHERE r0 IS NULL OR r0 <> reputation""",
    "p2_history": "WITH " + P2_QUESTION + """
SELECT question_id, score, view_count, snapshot_at AS valid_from, lead(snapshot_at) OVER w AS valid_to, row_number() OVER w AS version_no
FROM question_starts WINDOW w AS (PARTITION BY question_id ORDER BY snapshot_at)""",
}

QUERIES = {"p1_found": p1_found, "p1_live_scores": p1_live_scores, "p2_found": p2_found, "p2_history": p2_history, "p2_owner_history": p2_owner_history}
