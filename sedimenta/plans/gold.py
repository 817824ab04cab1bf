"""Star schema out of cleansed tables: pure functions of DataFrames."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sedimenta.functions.columns import band, date_key, hours_between, month_of
from sedimenta.operators import marts
from sedimenta.operators.select import mark_first
from sedimenta.plans.settings import CALENDAR_FROM, CALENDAR_TO, MARKER


def alive(questions: DataFrame, answers: DataFrame, tags: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Questions with a creation time that are not deleted, and the answers and tags that belong to them."""
    q = questions.where("created_at IS NOT NULL AND NOT coalesce(is_deleted, false)")
    ids = q.select("question_id")
    return q, answers.where("NOT coalesce(is_deleted, false)").join(ids, "question_id", "left_semi"), tags.join(ids, "question_id", "left_semi")


def base(q: DataFrame, a: DataFrame) -> DataFrame:
    timed = marts.response_times(q.drop("has_any_answer", "has_accepted_answer"), a, "question_id", asked="created_at", replied="created_at", accepted="is_accepted")
    return timed.withColumns({"created_date_key": date_key(F.col("created_at")), "month_start": month_of(F.col("created_at"))})


def dim_date(q: DataFrame, a: DataFrame) -> DataFrame:
    days = q.select(F.to_date("created_at").alias("d")).union(a.select(F.to_date("created_at")))
    return marts.calendar(days.agg(F.min("d").alias("lo"), F.max("d").alias("hi")), low=CALENDAR_FROM, high=CALENDAR_TO, marker=MARKER, flag="is_after_launch")


def dim_tag(tags: DataFrame, tracked: Sequence[str], categories: Mapping[str, str]) -> DataFrame:
    return marts.members(tags, "tag", tracked, categories)


def _posts(q: DataFrame, a: DataFrame) -> DataFrame:
    return q.select(F.col("owner_user_key").alias("user_key"), "created_at").unionByName(a.select(F.col("owner_user_key").alias("user_key"), "created_at")).where("user_key IS NOT NULL")


def dim_user(users: DataFrame, q: DataFrame, a: DataFrame) -> DataFrame:
    first = _posts(q, a).groupBy("user_key").agg(F.min("created_at").alias("first_post_at"))
    return users.join(first, "user_key", "left").select(
        "user_key", "user_type", "reputation", band(F.col("reputation")).alias("reputation_band"), "accept_rate", "first_seen_at", month_of(F.coalesce("first_post_at", "first_seen_at")).alias("cohort_month")
    )


def fact_question(b: DataFrame) -> DataFrame:
    return b.select(
        "question_id", "created_date_key", "owner_user_key", "title", "score", "view_count", "answer_count", "has_any_answer", "has_accepted_answer", "is_closed",
        "closed_reason_code", "hours_to_first_answer", "hours_to_accepted_answer", "answered_within_24h",
    )


def fact_answer(q: DataFrame, a: DataFrame) -> DataFrame:
    flagged = mark_first(a, ["question_id"], ["created_at", "answer_id"], "is_first_answer")
    asked = q.select("question_id", F.col("created_at").alias("asked_at"))
    return flagged.join(asked, "question_id").select(
        "answer_id", "question_id", date_key(F.col("created_at")).alias("created_date_key"), "owner_user_key", "score", "is_accepted", "is_first_answer", hours_between(F.col("asked_at"), F.col("created_at")).alias("hours_after_question")
    )


def bridge(tags: DataFrame, tracked: Sequence[str]) -> DataFrame:
    return tags.select("question_id", "tag").distinct().withColumn("is_tracked", F.col("tag").isin(list(tracked)))


def agg_tag_month(b: DataFrame, a: DataFrame, tags: DataFrame, tracked: Sequence[str], categories: Mapping[str, str]) -> DataFrame:
    mine = tags.where(F.col("tag").isin(list(tracked)))
    out = marts.item_month(b, mine, "question_id", "tag", "month_start", counted=a)
    return out.join(marts.lookup(b.sparkSession, categories, "tag", "category"), "tag", "left")


def agg_tag_pairs(tags: DataFrame, tracked: Sequence[str], categories: Mapping[str, str]) -> DataFrame:
    spark = tags.sparkSession
    pairs = marts.item_pairs(tags.where(F.col("tag").isin(list(tracked))), "question_id", "tag")
    for side in ("a", "b"):
        pairs = pairs.join(marts.lookup(spark, categories, f"tag_{side}", f"category_{side}"), f"tag_{side}")
    return pairs.select("tag_a", "tag_b", "category_a", "category_b", "question_count")


def agg_user_cohort(q: DataFrame, a: DataFrame) -> DataFrame:
    return marts.cohort_retention(_posts(q, a), "user_key", "created_at")
