"""Star-schema and dashboard aggregates, by column names."""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sedimenta.functions.columns import date_key, hours_between, month_of

#: Percentiles have a rank error of one in so many values; smaller groups are exact.
ACCURACY = 100_000


def lookup(spark: SparkSession, values: Mapping[str, str], key: str, value: str) -> DataFrame:
    """A small dimension given as a mapping; as many rows as the mapping has, so it may be broadcast."""
    return F.broadcast(spark.createDataFrame(list(values.items()), f"{key} string, {value} string"))


def calendar(bounds: DataFrame, *, low: dt.date, high: dt.date, marker: dt.date, flag: str) -> DataFrame:
    """Every day between the bounds (one row: lo, hi), at least from ``low`` to ``high``.

    The bounds stay in the plan; nothing is fetched to build the calendar.
    """
    days = bounds.select(F.explode(F.sequence(F.least(F.coalesce("lo", F.lit(low)), F.lit(low)), F.greatest(F.coalesce("hi", F.lit(high)), F.lit(high)), F.expr("INTERVAL 1 DAY"))).alias("full_date"))
    d = F.col("full_date")
    return days.select(
        date_key(d).alias("date_key"), d, F.year(d).alias("year"), F.quarter(d).alias("quarter"), F.month(d).alias("month"), F.date_format(d, "MMMM").alias("month_name"),
        F.date_format(d, "yyyy-MM").alias("year_month"), F.weekofyear(d).alias("week_of_year"), F.dayofmonth(d).alias("day_of_month"),
        F.dayofweek(d).alias("day_of_week"), F.date_format(d, "EEEE").alias("day_name"), (d >= F.lit(marker)).alias(flag),
    )


def response_times(asks: DataFrame, replies: DataFrame, key: str, *, asked: str, replied: str, accepted: str) -> DataFrame:
    """Asks with the hours to their first and first accepted reply; one pass over the replies."""
    firsts = replies.groupBy(key).agg(F.min(replied).alias("__first"), F.min(F.when(F.col(accepted), F.col(replied))).alias("__accepted"))
    first, took = F.col("__first"), F.col("hours_to_first_answer")
    return (
        asks.join(firsts, key, "left")
        .withColumns({"hours_to_first_answer": hours_between(F.col(asked), first), "hours_to_accepted_answer": hours_between(F.col(asked), F.col("__accepted"))})
        .withColumns({"has_any_answer": first.isNotNull(), "has_accepted_answer": F.col("__accepted").isNotNull(), "answered_within_24h": took.isNotNull() & (took <= 24)})
        .drop("__first", "__accepted")
    )


def percent(part: Column, whole: Column) -> Column:
    return (part / whole * 100).cast("double")


def item_month(facts: DataFrame, items: DataFrame, key: str, item: str, month: str, *, counted: DataFrame, exact: bool = False) -> DataFrame:
    """Per item and month: facts, counted rows, share of the month, response-time percentiles and percentages.

    ``facts`` has one row per key, ``items`` distinct (key, item), ``counted``
    rows per key (replies), counted in the month of their fact.  Replies are
    counted per key before the items fan out.  A month's size counts each fact
    at its smallest item only, so facts are read once and the total is a sum
    over the small result.  Percentiles come from
    combining summaries with a rank error of 1 / ACCURACY; ``exact`` ones keep
    all values of a group.
    """
    pairs = items.select(key, item).distinct()
    smallest = pairs.groupBy(key).agg(F.min(item).alias("__smallest"))
    per_key = counted.groupBy(key).agg(F.count(F.lit(1)).alias("__replies"))
    fanned = facts.join(smallest, key).join(per_key, key, "left").join(pairs, key)
    rank = (lambda q: F.expr(f"percentile_disc({q}) WITHIN GROUP (ORDER BY hours_to_first_answer)")) if exact else (lambda q: F.percentile_approx("hours_to_first_answer", q, ACCURACY))
    agg = fanned.groupBy(item, month).agg(
        F.count(F.lit(1)).alias("questions"), F.coalesce(F.sum("__replies"), F.lit(0)).alias("answers"), F.count_if(F.col(item) == F.col("__smallest")).alias("__heads"),
        F.count_if(~F.col("has_any_answer")).alias("__unanswered"), F.count_if("is_closed").alias("__closed"), F.count_if("answered_within_24h").alias("__soon"),
        F.round(rank(0.5), 4).alias("median_hours_to_first_answer"), F.round(rank(0.9), 4).alias("p90_hours_to_first_answer"),
    )
    n, size = F.col("questions"), F.sum("__heads").over(Window.partitionBy(month))
    return agg.select(
        item, month, F.date_format(month, "yyyy-MM").alias("year_month"), "questions", "answers",
        percent(n, size).alias("share_of_tracked_questions"), percent(F.col("__unanswered"), n).alias("pct_unanswered"),
        "median_hours_to_first_answer", "p90_hours_to_first_answer", percent(F.col("__closed"), n).alias("pct_closed"), percent(F.col("__soon"), n).alias("pct_answered_within_24h"),
    )


def item_pairs(items: DataFrame, key: str, item: str, *, per_key: int = 64) -> DataFrame:
    """(item_a < item_b, count) of keys that carry both, from one array of items per key.

    For tables whose keys carry few items by contract; keys with more than
    ``per_key`` items go through a self-join on the key instead, so no array
    grows without bound.
    """
    sized = items.select(key, item).distinct()
    n = sized.groupBy(key).agg(F.count(F.lit(1)).alias("__n"))
    small = sized.join(n.where(F.col("__n").between(2, per_key)), key, "left_semi").groupBy(key).agg(F.array_sort(F.collect_list(item)).alias("__items"))
    a = small.select("__items", F.posexplode("__items").alias("__at", f"{item}_a"))
    near = a.select(f"{item}_a", F.explode(F.slice("__items", F.col("__at") + 2, F.size("__items"))).alias(f"{item}_b"))
    large = sized.join(n.where(F.col("__n") > per_key), key, "left_semi")
    far = large.withColumnRenamed(item, f"{item}_a").join(large.withColumnRenamed(item, f"{item}_b"), key).where(F.col(f"{item}_a") < F.col(f"{item}_b")).drop(key)
    return near.unionByName(far).groupBy(f"{item}_a", f"{item}_b").agg(F.count(F.lit(1)).alias("question_count"))


def cohort_retention(posts: DataFrame, user: str, at: str) -> DataFrame:
    """Per cohort month and months since: users of the cohort, users active, share; every month up to the last is there."""
    months = posts.where(F.col(user).isNotNull() & F.col(at).isNotNull()).select(user, month_of(F.col(at)).alias("__m")).distinct()
    users = months.groupBy(user).agg(F.min("__m").alias("cohort_month"))
    since = F.months_between("__m", "cohort_month").cast("int")
    active = months.join(users, user).select("cohort_month", since.alias("months_since")).groupBy("cohort_month", "months_since").agg(F.count(F.lit(1)).alias("users_active"))
    latest = months.agg(F.max("__m")).scalar()
    grid = (
        users.groupBy("cohort_month").agg(F.count(F.lit(1)).alias("users_in_cohort")).withColumn("__last", latest)
        .select("cohort_month", "users_in_cohort", F.explode(F.sequence(F.lit(0), F.greatest(F.months_between("__last", "cohort_month").cast("int"), F.lit(0)))).alias("months_since"))
    )
    joined = grid.join(active, ["cohort_month", "months_since"], "left").withColumn("users_active", F.coalesce("users_active", F.lit(0)))
    return joined.select("cohort_month", "months_since", "users_in_cohort", "users_active", (F.col("users_active") / F.col("users_in_cohort")).alias("share_still_active"))


def members(observed: DataFrame, item: str, tracked: Sequence[str], categories: Mapping[str, str], default: str = "Other") -> DataFrame:
    """Item dimension: observed and tracked items, with category and flag."""
    spark = observed.sparkSession
    known = spark.createDataFrame([(x,) for x in tracked], f"{item} string")
    return (
        observed.select(item).union(known).distinct().join(lookup(spark, categories, item, "category"), item, "left")
        .select(item, F.coalesce("category", F.lit(default)).alias("category"), F.col(item).isin(list(tracked)).alias("is_tracked"))
    )


def pivoted(df: DataFrame, row: str, column: str, value: str, wanted: Sequence) -> DataFrame:
    """Matrix of a long table for the given column values."""
    out = df.groupBy(row).pivot(column, list(wanted)).agg(F.first(value))
    return out.select(row, *[F.col(f"`{v}`").alias(f"m{v}") for v in wanted])
