"""Queries of the layered Q&A tables over the test data, with their SQL."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sedimenta.contracts import CONTRACTS
from sedimenta.ingest import classified, seen_paths
from sedimenta.operators.merge import applied, merge, s, t, update_only
from sedimenta.operators.select import dead_letters, judged, split_by_rules
from sedimenta.plans import gold, silver
from sedimenta.plans.settings import SALT, TAG_CATEGORIES, TRACKED
from sedimenta.session import cut, scan


def _raw(spark: SparkSession, d: str, *tables: str) -> list[DataFrame]:
    return [scan(spark, d, x) for x in tables]


def soft_deleted(rows: DataFrame, tombs: DataFrame) -> DataFrame:
    """Rows whose question was detected as deleted after they were extracted are marked."""
    late = ~t("is_deleted") & (t("source_extracted_at") < s("deleted_detected_at"))
    return applied(merge(rows, tombs, update_only(["question_id"], {"is_deleted": F.lit(True), "deleted_detected_at": s("deleted_detected_at")}, late)))


_ASKED = ["question_id", "created_at", "title", "score", "view_count", "answer_count", "is_closed", "closed_reason_code", "owner_user_key", "is_deleted"]
_REPLIED = ["answer_id", "question_id", "created_at", "owner_user_key", "score", "is_accepted", "is_deleted"]


def _clean(spark: SparkSession, d: str, with_answers: bool = True) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Live questions, answers and tags; the first two feed several branches and are computed once."""
    rq, ra, rd = _raw(spark, d, "questions", "answers", "deleted_questions")
    tombs = silver.tombstones(rd)
    q, _ = split_by_rules(silver.questions(rq, SALT, TRACKED), silver.rules("questions"))
    a, _ = split_by_rules(silver.answers(ra, SALT), silver.rules("answers"))
    q = cut(soft_deleted(q, tombs).where("created_at IS NOT NULL AND NOT is_deleted").select(*_ASKED))
    q, a, tags = gold.alive(q, soft_deleted(a, tombs), silver.question_tags(rq, TRACKED))
    return q, cut(a.select(*_REPLIED)) if with_answers else a, tags


def _gold(f: Callable[[DataFrame, DataFrame, DataFrame], DataFrame], *, with_answers: bool = True) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, d: f(*_clean(spark, d, with_answers))


def silver_questions(spark: SparkSession, d: str) -> DataFrame:
    q = silver.questions(*_raw(spark, d, "questions"), SALT, TRACKED)
    return q.drop("record_hash").withColumns({"tags": F.array_join("tags", ","), "tracked_tags": F.array_join(F.array_sort("tracked_tags"), ",")})


def silver_titles(spark: SparkSession, d: str) -> DataFrame:
    """Decoded titles and their lengths."""
    return silver.questions(*_raw(spark, d, "questions"), SALT, TRACKED).select("question_id", "title", "title_length")


def silver_answers(spark: SparkSession, d: str) -> DataFrame:
    return silver.answers(*_raw(spark, d, "answers"), SALT).drop("record_hash")


def silver_tags(spark: SparkSession, d: str) -> DataFrame:
    return silver.question_tags(*_raw(spark, d, "questions"), TRACKED)


def silver_users(spark: SparkSession, d: str) -> DataFrame:
    return silver.users(*_raw(spark, d, "questions", "answers"), SALT)


def silver_snapshots(spark: SparkSession, d: str) -> DataFrame:
    return silver.snapshots(*_raw(spark, d, "question_snapshots"))


def silver_post_text(spark: SparkSession, d: str) -> DataFrame:
    return silver.post_text(*_raw(spark, d, "questions", "answers")).select("post_type", "post_id", F.sha2("title_masked", 256).alias("title_sha"), F.sha2("body_masked", 256).alias("body_sha"), "masked_token_count")


def dq_counts(spark: SparkSession, d: str) -> DataFrame:
    rq, ra = _raw(spark, d, "questions", "answers")
    q = judged(silver.questions(rq, SALT, TRACKED), silver.rules("questions")).select(F.lit("questions").alias("entity"), "_failed_rule")
    a = judged(silver.answers(ra, SALT), silver.rules("answers")).select(F.lit("answers").alias("entity"), "_failed_rule")
    return q.unionByName(a).groupBy("entity", F.coalesce("_failed_rule", F.lit("")).alias("failed_rule")).agg(F.count(F.lit(1)).alias("n"))


def apply_snapshots(spark: SparkSession, d: str) -> DataFrame:
    """Newer metrics of snapshots override those of the record."""
    rq, rs = _raw(spark, d, "questions", "question_snapshots")
    q = silver.questions(rq, SALT, TRACKED).select("question_id", "score", "view_count", "answer_count", "metrics_as_of")
    last = silver.snapshots(rs).groupBy("question_id").agg(F.max(F.struct("snapshot_at", "score", "view_count", "answer_count")).alias("x")).select("question_id", "x.*")
    spec = update_only(["question_id"], {c: s(c) for c in ("score", "view_count", "answer_count")} | {"metrics_as_of": s("snapshot_at")}, s("snapshot_at") > t("metrics_as_of"))
    return merge(q, last, spec).withColumnRenamed("_action", "action")


def soft_deletes(spark: SparkSession, d: str) -> DataFrame:
    rq, rd = _raw(spark, d, "questions", "deleted_questions")
    return soft_deleted(silver.questions(rq, SALT, TRACKED).select("question_id", "source_extracted_at", "is_deleted", "deleted_detected_at"), silver.tombstones(rd))


def silver_dead_letters(spark: SparkSession, d: str) -> DataFrame:
    """Rows that fail a rule, as they are set aside."""
    rq, ra = _raw(spark, d, "questions", "answers")
    parts = []
    for rows, entity, key in ((silver.questions(rq, SALT, TRACKED), "questions", "question_id"), (silver.answers(ra, SALT), "answers", "answer_id")):
        _, bad = split_by_rules(rows, silver.rules(entity))
        parts.append(dead_letters(bad, entity, key, "source_batch_id").select("entity", "record_key", "failed_rule", "source_batch_id"))
    return parts[0].unionByName(parts[1])


def _lines(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    raw = scan(spark, d, "quarantine_records")
    return {e: classified(raw.where(F.col("entity") == e).select(F.col("raw_record").alias("value"), F.col("_source_file").alias("file_path")).where(F.length(F.trim("value")) > 0), c) for e, c in CONTRACTS.items()}


def bronze_reasons(spark: SparkSession, d: str) -> DataFrame:
    """Raw lines by entity and the reason to reject them."""
    parts = [x.groupBy(F.lit(e).alias("entity"), F.coalesce("reason", F.lit("")).alias("reason")).agg(F.count(F.lit(1)).alias("n")) for e, x in _lines(spark, d).items()]
    return reduce(DataFrame.unionByName, parts)


def bronze_drift(spark: SparkSession, d: str) -> DataFrame:
    """How many lines show each top-level field outside the contract."""
    quoted = F.col("path").startswith('["')
    name = F.when(quoted, F.get_json_object(F.col("path"), "$[0]")).otherwise(F.col("path")).alias("path")
    parts = [seen_paths(x.where("check.is_json"), "check.unexpected", "value").where(quoted | ~F.contains("path", F.lit("."))).select(F.lit(e).alias("entity"), name, "n") for e, x in _lines(spark, d).items()]
    return reduce(DataFrame.unionByName, parts)


QUERIES = {
    "silver_dead_letters": silver_dead_letters, "bronze_reasons": bronze_reasons, "bronze_drift": bronze_drift,
    "silver_questions": silver_questions, "silver_titles": silver_titles, "silver_answers": silver_answers, "silver_question_tags": silver_tags,
    "silver_users": silver_users, "silver_snapshots": silver_snapshots, "silver_post_text": silver_post_text, "silver_dq_counts": dq_counts,
    "silver_apply_snapshots": apply_snapshots, "silver_soft_deletes": soft_deletes,
    "gold_dim_date": _gold(lambda q, a, tags: gold.dim_date(q, a)),
    "gold_dim_tag": _gold(lambda q, a, tags: gold.dim_tag(tags, TRACKED, TAG_CATEGORIES), with_answers=False),
    "gold_dim_user": lambda spark, d: gold.dim_user(silver_users(spark, d), *_clean(spark, d)[:2]),
    "gold_fact_question": _gold(lambda q, a, tags: gold.fact_question(gold.base(q, a))),
    "gold_fact_answer": _gold(lambda q, a, tags: gold.fact_answer(q, a)),
    "gold_bridge_question_tag": _gold(lambda q, a, tags: gold.bridge(tags, TRACKED), with_answers=False),
    "gold_agg_tag_month": _gold(lambda q, a, tags: gold.agg_tag_month(gold.base(q, a), a, tags, TRACKED, TAG_CATEGORIES)),
    "gold_agg_tag_pairs": _gold(lambda q, a, tags: gold.agg_tag_pairs(tags, TRACKED, TAG_CATEGORIES), with_answers=False),
    "gold_agg_user_cohort": _gold(lambda q, a, tags: gold.agg_user_cohort(q, a)),
}

_LIST = "[" + ", ".join(f"'{x}'" for x in TRACKED) + "]"
_CATEGORY = "(VALUES " + ", ".join(f"('{k}', '{v}')" for k, v in TAG_CATEGORIES.items()) + ") AS cat(tag, category)"
_KEY = f"CASE WHEN owner.user_id IS NOT NULL THEN sha256('{SALT}:' || owner.user_id) END"
_RANK = "row_number() OVER (PARTITION BY {} ORDER BY _extracted_at DESC NULLS LAST, last_activity_date DESC NULLS LAST, _record_hash) AS rn"


def _occurs(mark: str) -> str:
    return f"coalesce(len(string_split(body, '{mark}')) - 1, 0)::INT"


_SHAPE = f"length(body)::INT AS body_length, {_occurs('<pre')} AS code_block_count, {_occurs('<code')} AS inline_code_count, {_occurs('<a ')} AS link_count, {_occurs('<img')} AS image_count"
_OWNER = f"{_KEY} AS owner_user_key, owner.user_type AS owner_user_type, owner.reputation AS owner_reputation"
_SLUG = "trim(lower(regexp_replace(trim(closed_reason), '[^A-Za-z0-9]+', '_', 'g')), '_')"


# Character references of the test titles; the ampersand comes last, so nothing is decoded twice.
_REFERENCES = {"&#x27;": "''", "&#39;": "''", "&quot;": '"', "&lt;": "<", "&gt;": ">", "&hellip;": "…", "&mdash;": "—", "&amp;": "&"}


def _decoded(c: str) -> str:
    for name, char in _REFERENCES.items():
        c = f"replace({c}, '{name}', '{char}')"
    return c


def _ts(c: str) -> str:
    return f"make_timestamptz({c} * 1000000)"


_CTE = f"""
WITH rq AS (SELECT * FROM (SELECT *, {_RANK.format('question_id')} FROM questions WHERE question_id IS NOT NULL) WHERE rn = 1),
ra AS (SELECT * FROM (SELECT *, {_RANK.format('answer_id')} FROM answers WHERE answer_id IS NOT NULL) WHERE rn = 1),
tomb AS (SELECT question_id, {_ts('min(detected_at)')} AS deleted_detected_at FROM deleted_questions WHERE is_deleted AND question_id IS NOT NULL GROUP BY 1),
sq AS (SELECT rq.question_id, {_ts('creation_date')} AS created_at, {_ts('last_activity_date')} AS last_activity_at, {_ts('last_edit_date')} AS last_edit_at,
  {_ts('closed_date')} AS closed_at, closed_reason, {_SLUG} AS closed_reason_code, closed_date IS NOT NULL AS is_closed, score, view_count, answer_count,
  is_answered AS is_answered_api, coalesce(answer_count, 0) > 0 AS has_any_answer, accepted_answer_id, accepted_answer_id IS NOT NULL AS has_accepted_answer,
  bounty_amount, coalesce(tags, []) AS tags, {_OWNER}, {_SHAPE}, migrated_from IS NOT NULL AS is_migrated, content_license, link AS question_url,
  _batch_id AS source_batch_id, _extracted_at AS source_extracted_at, {_decoded("title")} AS title, length({_decoded("title")})::INT AS title_length, false AS is_deleted,
  NULL::TIMESTAMPTZ AS deleted_detected_at, _extracted_at AS metrics_as_of FROM rq),
sa AS (SELECT answer_id, question_id, {_ts('creation_date')} AS created_at, {_ts('last_activity_date')} AS last_activity_at, {_ts('last_edit_date')} AS last_edit_at,
  score, is_accepted, {_OWNER}, {_SHAPE}, content_license, _batch_id AS source_batch_id, _extracted_at AS source_extracted_at, false AS is_deleted, NULL::TIMESTAMPTZ AS deleted_detected_at FROM ra),
tags_ AS (SELECT question_id, tag, any_value(_batch_id) AS source_batch_id FROM (SELECT question_id, unnest(tags) AS tag, _batch_id FROM rq) WHERE tag IS NOT NULL GROUP BY 1, 2),
q AS (SELECT sq.* FROM sq LEFT JOIN tomb ON tomb.question_id = sq.question_id AND source_extracted_at < tomb.deleted_detected_at
  WHERE created_at IS NOT NULL AND (last_activity_at IS NULL OR last_activity_at >= created_at) AND trim(coalesce(title, '')) <> '' AND tomb.question_id IS NULL),
a AS (SELECT sa.* FROM sa LEFT JOIN tomb ON tomb.question_id = sa.question_id AND source_extracted_at < tomb.deleted_detected_at
  WHERE sa.question_id IS NOT NULL AND created_at IS NOT NULL AND (last_activity_at IS NULL OR last_activity_at >= created_at) AND tomb.question_id IS NULL
  AND sa.question_id IN (SELECT question_id FROM q)),
tg AS (SELECT * FROM tags_ WHERE question_id IN (SELECT question_id FROM q)),
firsts AS (SELECT question_id, min(created_at) AS f, min(created_at) FILTER (is_accepted) AS acc FROM a GROUP BY 1),
base AS (SELECT q.* EXCLUDE (has_any_answer, has_accepted_answer), (epoch_us(f) - epoch_us(created_at)) / 1000000 / 3600.0 AS hours_to_first_answer,
  (epoch_us(acc) - epoch_us(created_at)) / 1000000 / 3600.0 AS hours_to_accepted_answer, f IS NOT NULL AS has_any_answer, acc IS NOT NULL AS has_accepted_answer,
  coalesce((epoch_us(f) - epoch_us(created_at)) / 1000000 / 3600.0 <= 24, false) AS answered_within_24h,
  strftime(created_at, '%Y%m%d')::INT AS created_date_key, date_trunc('month', created_at)::DATE AS month_start FROM q LEFT JOIN firsts USING (question_id)),
posts AS (SELECT owner_user_key AS user_key, created_at FROM q WHERE owner_user_key IS NOT NULL UNION ALL SELECT owner_user_key, created_at FROM a WHERE owner_user_key IS NOT NULL)
"""
_SNAP = f"""snaps AS (SELECT question_id, {_ts('snapshot_at')} AS snapshot_at, {_ts('snapshot_at')}::DATE AS snapshot_date, score, view_count, answer_count, is_answered AS is_answered_api,
  {_ts('closed_date')} AS closed_at, _batch_id AS source_batch_id FROM (SELECT *, row_number() OVER (PARTITION BY question_id, snapshot_at ORDER BY _extracted_at DESC NULLS LAST, _record_hash) AS rn
  FROM question_snapshots WHERE question_id IS NOT NULL AND snapshot_at IS NOT NULL) WHERE rn = 1)"""


def _masked(c: str) -> str:
    from sedimenta.functions.columns import MASKS

    for pattern, token in MASKS:
        c = f"regexp_replace({c}, '{pattern.replace(chr(39), chr(39) * 2)}', '{token.replace('$1', chr(92) + '1').replace('$2', chr(92) + '2')}', 'g')"
    return c


_TOKENS = r"coalesce(len(regexp_extract_all({}, '\[(EMAIL|IP|SECRET|CONNECTION)\]')), 0)"
_TEXT_RANK = "row_number() OVER (PARTITION BY {} ORDER BY _extracted_at DESC NULLS LAST, _record_hash) AS rn"

ORACLES = {
    "silver_questions": _CTE + f"SELECT * REPLACE (array_to_string(tags, ',') AS tags), array_to_string(list_sort(list_distinct([x FOR x IN tags IF x IN {_LIST}])), ',') AS tracked_tags FROM sq",
    "silver_titles": _CTE + "SELECT question_id, title, title_length FROM sq",
    "silver_answers": _CTE + "SELECT * FROM sa",
    "silver_dead_letters": _CTE + """
SELECT * FROM (SELECT 'questions' AS entity, question_id::VARCHAR AS record_key, CASE WHEN created_at IS NULL THEN 'created_at_not_null' WHEN last_activity_at < created_at THEN 'activity_not_before_creation'
  WHEN trim(coalesce(title, '')) = '' THEN 'title_not_blank' END AS failed_rule, source_batch_id FROM sq
UNION ALL SELECT 'answers', answer_id::VARCHAR, CASE WHEN question_id IS NULL THEN 'question_id_not_null' WHEN created_at IS NULL THEN 'created_at_not_null'
  WHEN last_activity_at < created_at THEN 'activity_not_before_creation' END, source_batch_id FROM sa) WHERE failed_rule IS NOT NULL""",
    "bronze_reasons": "SELECT entity, coalesce(reason, '') AS reason, count(*) AS n FROM quarantine_records WHERE length(trim(raw_record)) > 0 GROUP BY ALL",
    "bronze_drift": "SELECT entity, path, count(*) AS n FROM (SELECT entity, unnest(json_keys(raw_record)) AS path FROM quarantine_records WHERE json_valid(raw_record) AND NOT regexp_matches(raw_record, ',\\s*\\}\\s*$') AND json_type(raw_record) = 'OBJECT') WHERE CASE entity "
    + " ".join(f"WHEN '{e}' THEN path NOT IN ({', '.join(repr(k) for k in c.tree)})" for e, c in CONTRACTS.items()) + " END GROUP BY ALL",
    "silver_question_tags": _CTE + f"SELECT question_id, tag, source_batch_id, tag IN {_LIST} AS is_tracked_tag FROM tags_",
    "silver_users": f"""
WITH o AS (SELECT owner, creation_date, _extracted_at FROM questions UNION ALL SELECT owner, creation_date, _extracted_at FROM answers),
r AS (SELECT owner, _extracted_at, row_number() OVER (PARTITION BY owner.user_id ORDER BY _extracted_at DESC NULLS LAST, owner.reputation DESC NULLS LAST, owner.user_type DESC NULLS LAST, owner.accept_rate DESC NULLS LAST) AS rn FROM o WHERE owner.user_id IS NOT NULL),
s AS (SELECT owner.user_id AS id, {_ts('min(creation_date)')} AS first_seen_at, {_ts('max(creation_date)')} AS last_seen_at FROM o WHERE owner.user_id IS NOT NULL GROUP BY 1)
SELECT sha256('{SALT}:' || s.id) AS user_key, r.owner.user_type AS user_type, r.owner.reputation AS reputation, r.owner.accept_rate AS accept_rate, first_seen_at, last_seen_at, _extracted_at AS source_extracted_at
FROM r JOIN s ON s.id = r.owner.user_id WHERE rn = 1""",
    "silver_snapshots": "WITH " + _SNAP + " SELECT * FROM snaps",
    "silver_post_text": f"""
WITH q AS (SELECT * FROM (SELECT *, {_TEXT_RANK.format('question_id')} FROM questions WHERE question_id IS NOT NULL) WHERE rn = 1),
a AS (SELECT * FROM (SELECT *, {_TEXT_RANK.format('answer_id')} FROM answers WHERE answer_id IS NOT NULL) WHERE rn = 1),
m AS (SELECT 'question' AS post_type, question_id AS post_id, {_masked(_decoded('title'))} AS tm, {_masked('body')} AS bm FROM q
  UNION ALL SELECT 'answer', answer_id, NULL, {_masked('body')} FROM a)
SELECT post_type, post_id, sha256(tm) AS title_sha, sha256(bm) AS body_sha, ({_TOKENS.format('tm')} + {_TOKENS.format('bm')})::INT AS masked_token_count FROM m""",
    "silver_dq_counts": _CTE + """
SELECT 'questions' AS entity, CASE WHEN created_at IS NULL THEN 'created_at_not_null' WHEN last_activity_at < created_at THEN 'activity_not_before_creation'
  WHEN trim(coalesce(title, '')) = '' THEN 'title_not_blank' ELSE '' END AS failed_rule, count(*) AS n FROM sq GROUP BY ALL
UNION ALL SELECT 'answers', CASE WHEN question_id IS NULL THEN 'question_id_not_null' WHEN created_at IS NULL THEN 'created_at_not_null'
  WHEN last_activity_at < created_at THEN 'activity_not_before_creation' ELSE '' END, count(*) FROM sa GROUP BY ALL""",
    "silver_apply_snapshots": _CTE + ", " + _SNAP + """,
last_ AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY snapshot_at DESC) AS rn FROM snaps) WHERE rn = 1)
SELECT sq.question_id, CASE WHEN newer THEN l.score ELSE sq.score END AS score, CASE WHEN newer THEN l.view_count ELSE sq.view_count END AS view_count,
  CASE WHEN newer THEN l.answer_count ELSE sq.answer_count END AS answer_count, CASE WHEN newer THEN snapshot_at ELSE source_extracted_at END AS metrics_as_of,
  CASE WHEN newer THEN 'U' ELSE 'K' END AS action
FROM sq LEFT JOIN last_ l ON l.question_id = sq.question_id CROSS JOIN LATERAL (SELECT coalesce(l.snapshot_at > sq.source_extracted_at, false) AS newer)""",
    "silver_soft_deletes": _CTE + """
SELECT sq.question_id, source_extracted_at, tomb.question_id IS NOT NULL AS is_deleted, tomb.deleted_detected_at
FROM sq LEFT JOIN tomb ON tomb.question_id = sq.question_id AND source_extracted_at < tomb.deleted_detected_at""",
    "gold_dim_date": _CTE + """
, b AS (SELECT least(min(created_at)::DATE, DATE '2022-11-01') AS lo, greatest(max(created_at)::DATE, DATE '2022-11-30') AS hi FROM (SELECT created_at FROM q UNION ALL SELECT created_at FROM a)),
d AS (SELECT unnest(generate_series(lo, hi, INTERVAL 1 DAY))::DATE AS full_date FROM b)
SELECT strftime(full_date, '%Y%m%d')::INT AS date_key, full_date, year(full_date)::INT AS year, quarter(full_date)::INT AS quarter, month(full_date)::INT AS month, monthname(full_date) AS month_name,
  strftime(full_date, '%Y-%m') AS year_month, weekofyear(full_date)::INT AS week_of_year, day(full_date)::INT AS day_of_month, (dayofweek(full_date) + 1)::INT AS day_of_week, dayname(full_date) AS day_name,
  full_date >= DATE '2022-11-30' AS is_after_launch FROM d""",
    "gold_dim_tag": _CTE + f"SELECT tag, coalesce(category, 'Other') AS category, tag IN {_LIST} AS is_tracked FROM (SELECT tag FROM tg UNION SELECT unnest({_LIST})) x LEFT JOIN {_CATEGORY} USING (tag)",
    "gold_dim_user": _CTE + f""",
o AS (SELECT owner, creation_date, _extracted_at FROM questions UNION ALL SELECT owner, creation_date, _extracted_at FROM answers),
r AS (SELECT *, row_number() OVER (PARTITION BY owner.user_id ORDER BY _extracted_at DESC NULLS LAST, owner.reputation DESC NULLS LAST, owner.user_type DESC NULLS LAST, owner.accept_rate DESC NULLS LAST) AS rn FROM o WHERE owner.user_id IS NOT NULL),
s AS (SELECT owner.user_id AS id, {_ts('min(creation_date)')} AS first_seen_at FROM o WHERE owner.user_id IS NOT NULL GROUP BY 1),
fp AS (SELECT user_key, min(created_at) AS first_post_at FROM posts GROUP BY 1),
u AS (SELECT sha256('{SALT}:' || id) AS user_key, r.owner.user_type AS user_type, r.owner.reputation AS reputation, r.owner.accept_rate AS accept_rate, first_seen_at FROM r JOIN s ON s.id = r.owner.user_id WHERE rn = 1)
SELECT u.user_key, user_type, reputation, CASE WHEN reputation IS NULL THEN 'unknown' WHEN reputation < 100 THEN 'under 100' WHEN reputation < 1000 THEN '100 to 999' WHEN reputation < 10000 THEN '1,000 to 9,999' ELSE '10,000 or more' END AS reputation_band,
  accept_rate, first_seen_at, date_trunc('month', coalesce(first_post_at, first_seen_at))::DATE AS cohort_month FROM u LEFT JOIN fp USING (user_key)""",
    "gold_fact_question": _CTE + "SELECT question_id, title, created_date_key, owner_user_key, score, view_count, answer_count, has_any_answer, has_accepted_answer, is_closed, closed_reason_code, hours_to_first_answer, hours_to_accepted_answer, answered_within_24h FROM base",
    "gold_fact_answer": _CTE + """
SELECT answer_id, question_id, strftime(a.created_at, '%Y%m%d')::INT AS created_date_key, a.owner_user_key, a.score, is_accepted,
  row_number() OVER (PARTITION BY question_id ORDER BY a.created_at, answer_id) = 1 AS is_first_answer, (epoch_us(a.created_at) - epoch_us(q.created_at)) / 1000000 / 3600.0 AS hours_after_question
FROM a JOIN q USING (question_id)""",
    "gold_bridge_question_tag": _CTE + f"SELECT question_id, tag, tag IN {_LIST} AS is_tracked FROM tg",
    "gold_agg_tag_month": _CTE + f""",
mine AS (SELECT question_id, tag FROM tg WHERE tag IN {_LIST}),
per AS (SELECT question_id, count(*) AS k FROM a GROUP BY 1),
size_ AS (SELECT month_start, count(*) AS n FROM base WHERE question_id IN (SELECT question_id FROM mine) GROUP BY 1)
SELECT tag, month_start, strftime(month_start, '%Y-%m') AS year_month, category, count(*) AS questions, coalesce(sum(k), 0)::BIGINT AS answers, count(*) / any_value(n) * 100 AS share_of_tracked_questions,
  count(*) FILTER (NOT has_any_answer) / count(*) * 100 AS pct_unanswered, round(quantile_disc(hours_to_first_answer, 0.5), 4) AS median_hours_to_first_answer,
  round(quantile_disc(hours_to_first_answer, 0.9), 4) AS p90_hours_to_first_answer, count(*) FILTER (is_closed) / count(*) * 100 AS pct_closed, count(*) FILTER (answered_within_24h) / count(*) * 100 AS pct_answered_within_24h
FROM base JOIN mine USING (question_id) LEFT JOIN per USING (question_id) JOIN size_ USING (month_start) LEFT JOIN {_CATEGORY} USING (tag) GROUP BY tag, month_start, category""",
    "gold_agg_tag_pairs": _CTE + f""",
mine AS (SELECT question_id, tag FROM tg WHERE tag IN {_LIST})
SELECT x.tag AS tag_a, y.tag AS tag_b, ca.category AS category_a, cb.category AS category_b, count(*) AS question_count FROM mine x JOIN mine y ON x.question_id = y.question_id AND x.tag < y.tag
JOIN {_CATEGORY.replace('AS cat', 'AS ca')} ON ca.tag = x.tag JOIN {_CATEGORY.replace('AS cat', 'AS cb')} ON cb.tag = y.tag GROUP BY 1, 2, 3, 4""",
    "gold_agg_user_cohort": _CTE + """,
m AS (SELECT DISTINCT user_key, date_trunc('month', created_at)::DATE AS m FROM posts),
u AS (SELECT user_key, min(m) AS cohort_month FROM m GROUP BY 1),
act AS (SELECT cohort_month, date_diff('month', cohort_month, m)::INT AS months_since, count(*) AS k FROM m JOIN u USING (user_key) GROUP BY 1, 2),
size_ AS (SELECT cohort_month, count(*) AS users_in_cohort FROM u GROUP BY 1),
grid AS (SELECT cohort_month, users_in_cohort, unnest(generate_series(0, date_diff('month', cohort_month, (SELECT max(m) FROM m))))::INT AS months_since FROM size_)
SELECT cohort_month, months_since, users_in_cohort, coalesce(k, 0) AS users_active, coalesce(k, 0) / users_in_cohort AS share_still_active FROM grid LEFT JOIN act USING (cohort_month, months_since)""",
}
