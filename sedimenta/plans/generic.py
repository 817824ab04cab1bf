"""The general operators over the order and event tables, with their SQL."""

from __future__ import annotations

import datetime as dt
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sedimenta.functions.columns import band, count_of, date_key, fingerprint_part, masked, MASK_TOKEN, month_of, pseudonym, row_hash, slug
from sedimenta.operators import marts
from sedimenta.operators import merge as m
from sedimenta.operators.merge import s, t
from sedimenta.operators.select import judged, mark_first, newest, orphans
from sedimenta.session import ensure_checkpoint_dir, scan
from sedimenta.sources.landing import key_presence, reconcile
from sedimenta.store import VersionedTable

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None) -> Callable[[Query], Query]:
    def keep(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return keep


@query("SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_orderdate >= TIMESTAMP '1996-01-01' AND o_orderdate < TIMESTAMP '1997-01-01' AND o_orderstatus IN ('F', 'O')")
def scan_project_filter(spark: SparkSession, d: str) -> DataFrame:
    o = scan(spark, d, "orders")
    return o.where((F.col("o_orderdate") >= F.lit(dt.datetime(1996, 1, 1))) & (F.col("o_orderdate") < F.lit(dt.datetime(1997, 1, 1))) & F.col("o_orderstatus").isin("F", "O")).select("o_orderkey", "o_custkey", "o_totalprice")


@query("SELECT user_id, event_type, event_id, ts, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1")
def latest_per_key(spark: SparkSession, d: str) -> DataFrame:
    return newest(scan(spark, d, "events"), ["user_id", "event_type"], [F.desc("ts"), F.desc("event_id")]).select("user_id", "event_type", "event_id", "ts", "value")


@query("SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) = 1 AS is_first FROM events")
def first_answer_flag(spark: SparkSession, d: str) -> DataFrame:
    return mark_first(scan(spark, d, "events").select("user_id", "event_id", "ts"), ["user_id"], ["ts", "event_id"], "is_first").select("user_id", "event_id", "is_first")


_TIMED = """
WITH f AS (SELECT l_orderkey, min(l_shipdate) AS f, min(l_shipdate) FILTER (l_returnflag = 'R') AS r FROM lineitem GROUP BY 1),
timed AS (SELECT o.*, (epoch_us(f) - epoch_us(o_orderdate)) / 1000000 / 3600.0 AS hours_to_first_answer, (epoch_us(r) - epoch_us(o_orderdate)) / 1000000 / 3600.0 AS hours_to_accepted_answer, f IS NOT NULL AS has_any_answer
FROM orders o LEFT JOIN f ON l_orderkey = o_orderkey)
"""


def _timed(spark: SparkSession, d: str) -> DataFrame:
    lines = scan(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_shipdate", (F.col("l_returnflag") == "R").alias("returned"))
    return marts.response_times(scan(spark, d, "orders"), lines, "o_orderkey", asked="o_orderdate", replied="l_shipdate", accepted="returned")


@query(_TIMED + "SELECT o_orderkey, hours_to_first_answer, hours_to_accepted_answer, has_any_answer FROM timed")
def first_event_hours(spark: SparkSession, d: str) -> DataFrame:
    return _timed(spark, d).select("o_orderkey", "hours_to_first_answer", "hours_to_accepted_answer", "has_any_answer")


@query(_TIMED + "SELECT o_orderpriority, date_trunc('month', o_orderdate)::DATE AS month_start, round(quantile_disc(hours_to_first_answer, 0.5), 4) AS median_hours, round(quantile_disc(hours_to_first_answer, 0.9), 4) AS p90_hours FROM timed GROUP BY 1, 2")
def median_p90_group_month(spark: SparkSession, d: str) -> DataFrame:
    ranks = {name: F.round(F.percentile_approx("hours_to_first_answer", q, marts.ACCURACY), 4).alias(name) for name, q in (("median_hours", 0.5), ("p90_hours", 0.9))}
    return _timed(spark, d).groupBy("o_orderpriority", month_of(F.col("o_orderdate")).alias("month_start")).agg(*ranks.values())


def _brands(spark: SparkSession, d: str) -> DataFrame:
    parts = scan(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("brand"))
    return scan(spark, d, "lineitem").select("l_partkey", F.col("l_orderkey").alias("o_orderkey")).join(parts, "l_partkey").select("o_orderkey", "brand").distinct()


_BRANDS = "bridge AS (SELECT DISTINCT l_orderkey AS o_orderkey, p_brand AS brand FROM lineitem JOIN part ON p_partkey = l_partkey)"


@query(_TIMED + f""", {_BRANDS}, b AS (SELECT *, date_trunc('month', o_orderdate)::DATE AS month_start FROM timed),
n AS (SELECT month_start, count(*) AS n FROM b WHERE o_orderkey IN (SELECT o_orderkey FROM bridge) GROUP BY 1), k AS (SELECT l_orderkey AS o_orderkey, count(*) AS k FROM lineitem GROUP BY 1)
SELECT brand, month_start, strftime(month_start, '%Y-%m') AS year_month, count(*) AS questions, coalesce(sum(k), 0)::BIGINT AS answers, count(*) / any_value(n) * 100 AS share_of_tracked_questions,
  count(*) FILTER (NOT has_any_answer) / count(*) * 100 AS pct_unanswered, round(quantile_disc(hours_to_first_answer, 0.5), 4) AS median_hours_to_first_answer, round(quantile_disc(hours_to_first_answer, 0.9), 4) AS p90_hours_to_first_answer,
  count(*) FILTER (o_orderstatus = 'F') / count(*) * 100 AS pct_closed, count(*) FILTER (coalesce(hours_to_first_answer <= 24, false)) / count(*) * 100 AS pct_answered_within_24h
FROM b JOIN bridge USING (o_orderkey) JOIN n USING (month_start) LEFT JOIN k USING (o_orderkey) GROUP BY 1, 2""")
def agg_group_month(spark: SparkSession, d: str) -> DataFrame:
    facts = _timed(spark, d).select("o_orderkey", month_of(F.col("o_orderdate")).alias("month_start"), "hours_to_first_answer", "has_any_answer", "answered_within_24h", (F.col("o_orderstatus") == "F").alias("is_closed"))
    lines = scan(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"))
    return marts.item_month(facts, _brands(spark, d), "o_orderkey", "brand", "month_start", counted=lines)


@query(f"WITH {_BRANDS} SELECT x.brand AS brand_a, y.brand AS brand_b, count(*) AS question_count FROM bridge x JOIN bridge y ON x.o_orderkey = y.o_orderkey AND x.brand < y.brand GROUP BY 1, 2")
def tag_pairs(spark: SparkSession, d: str) -> DataFrame:
    return marts.item_pairs(_brands(spark, d), "o_orderkey", "brand")


_COHORT = """
WITH m AS (SELECT DISTINCT o_custkey, date_trunc('month', o_orderdate)::DATE AS m FROM orders), u AS (SELECT o_custkey, min(m) AS cohort_month FROM m GROUP BY 1),
act AS (SELECT cohort_month, date_diff('month', cohort_month, m)::INT AS months_since, count(*) AS k FROM m JOIN u USING (o_custkey) GROUP BY 1, 2),
size_ AS (SELECT cohort_month, count(*) AS users_in_cohort FROM u GROUP BY 1),
grid AS (SELECT cohort_month, users_in_cohort, unnest(generate_series(0, date_diff('month', cohort_month, (SELECT max(m) FROM m))))::INT AS months_since FROM size_),
cohort AS (SELECT cohort_month, months_since, users_in_cohort, coalesce(k, 0) AS users_active, coalesce(k, 0) / users_in_cohort AS share_still_active FROM grid LEFT JOIN act USING (cohort_month, months_since))
"""


@query(_COHORT + "SELECT * FROM cohort")
def cohort_retention(spark: SparkSession, d: str) -> DataFrame:
    return marts.cohort_retention(scan(spark, d, "orders"), "o_custkey", "o_orderdate")


@query(_COHORT + "SELECT cohort_month, " + ", ".join(f"max(share_still_active) FILTER (months_since = {i}) AS m{i}" for i in range(7)) + " FROM cohort GROUP BY 1")
def pivot_matrix(spark: SparkSession, d: str) -> DataFrame:
    return marts.pivoted(cohort_retention(spark, d), "cohort_month", "months_since", "share_still_active", range(7))


@query("""WITH b AS (SELECT min(o_orderdate)::DATE AS lo, max(o_orderdate)::DATE AS hi FROM orders), d AS (SELECT unnest(generate_series(least(lo, DATE '1995-01-01'), greatest(hi, DATE '1995-01-31'), INTERVAL 1 DAY))::DATE AS full_date FROM b)
SELECT strftime(full_date, '%Y%m%d')::INT AS date_key, full_date, year(full_date)::INT AS year, quarter(full_date)::INT AS quarter, month(full_date)::INT AS month, monthname(full_date) AS month_name, strftime(full_date, '%Y-%m') AS year_month,
  weekofyear(full_date)::INT AS week_of_year, day(full_date)::INT AS day_of_month, (dayofweek(full_date) + 1)::INT AS day_of_week, dayname(full_date) AS day_name, full_date >= DATE '1998-01-01' AS is_late FROM d""")
def dim_date(spark: SparkSession, d: str) -> DataFrame:
    bounds = scan(spark, d, "orders").agg(F.min(F.to_date("o_orderdate")).alias("lo"), F.max(F.to_date("o_orderdate")).alias("hi"))
    return marts.calendar(bounds, low=dt.date(1995, 1, 1), high=dt.date(1995, 1, 31), marker=dt.date(1998, 1, 1), flag="is_late")


@query("SELECT brand, CASE brand WHEN 'Brand#1' THEN 'First' WHEN 'Brand#99' THEN 'None' ELSE 'Other' END AS category, brand IN ('Brand#1', 'Brand#99') AS is_tracked FROM (SELECT p_brand AS brand FROM part UNION SELECT unnest(['Brand#1', 'Brand#99']))")
def dim_bridge_distinct(spark: SparkSession, d: str) -> DataFrame:
    return marts.members(scan(spark, d, "part").select(F.col("p_brand").alias("brand")), "brand", ["Brand#1", "Brand#99"], {"Brand#1": "First", "Brand#99": "None"})


@query("SELECT c_custkey, CASE WHEN v IS NULL THEN 'unknown' WHEN v < 100 THEN 'under 100' WHEN v < 1000 THEN '100 to 999' WHEN v < 10000 THEN '1,000 to 9,999' ELSE '10,000 or more' END AS band FROM (SELECT c_custkey, CASE WHEN c_custkey % 7 <> 0 THEN c_acctbal END AS v FROM customer)")
def reputation_band(spark: SparkSession, d: str) -> DataFrame:
    v = F.when(F.col("c_custkey") % 7 != 0, F.col("c_acctbal"))  # some unknown values
    return scan(spark, d, "customer").select("c_custkey", band(v).alias("band"))


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)")
def semi_live(spark: SparkSession, d: str) -> DataFrame:
    return scan(spark, d, "orders").join(scan(spark, d, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("o_custkey")), "o_custkey", "left_semi").select("o_orderkey", "o_totalprice")


@query("SELECT o_orderkey, o_custkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)")
def anti_orphans(spark: SparkSession, d: str) -> DataFrame:
    return scan(spark, d, "orders").join(scan(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey")), "o_orderkey", "left_anti").select("o_orderkey", "o_custkey")


def _sql_masks(c: str) -> str:
    from sedimenta.functions.columns import MASKS

    for pattern, token in MASKS:
        c = f"regexp_replace({c}, '{pattern.replace(chr(39), chr(39) * 2)}', '{token.replace('$', chr(92))}', 'g')"
    return c


@query(f"SELECT doc_id, sha256(x) AS sha, len(regexp_extract_all(x, '\\[(EMAIL|IP|SECRET|CONNECTION)\\]'))::INT AS n_masked FROM (SELECT doc_id, {_sql_masks('text')} AS x FROM documents)")
def pii_mask(spark: SparkSession, d: str) -> DataFrame:
    return scan(spark, d, "documents").select("doc_id", masked(F.col("text")).alias("x")).select("doc_id", F.sha2("x", 256).alias("sha"), count_of(F.col("x"), MASK_TOKEN).alias("n_masked"))


@query("SELECT doc_id, (len(string_split(text, '<code')) - 1)::INT AS codes, (len(string_split(text, '<a ')) - 1)::INT AS links FROM documents")
def html_counts(spark: SparkSession, d: str) -> DataFrame:
    return scan(spark, d, "documents").select("doc_id", count_of(F.col("text"), "<code").alias("codes"), count_of(F.col("text"), "<a ").alias("links"))


@query("SELECT DISTINCT p_type, trim(lower(regexp_replace(trim(p_type), '[^A-Za-z0-9]+', '_', 'g')), '_') AS code FROM part")
def slugify(spark: SparkSession, d: str) -> DataFrame:
    return scan(spark, d, "part").select("p_type", slug(F.col("p_type")).alias("code")).distinct()


@query("SELECT event_id, (props->>'$.k')::INT AS k FROM events")
def json_extract(spark: SparkSession, d: str) -> DataFrame:
    return scan(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").try_cast("int").alias("k"))


@query("SELECT event_id, (props->>'$.k')::INT AS k, props->>'$.x' AS x FROM events")
def json_contract(spark: SparkSession, d: str) -> DataFrame:
    parsed = F.from_json("props", "k int, x string", {"mode": "PERMISSIVE"})
    return scan(spark, d, "events").select("event_id", parsed["k"].alias("k"), parsed["x"].alias("x"))


@query("SELECT c_custkey, CASE WHEN c_custkey % 5 <> 0 THEN sha256('pepper:' || c_custkey) END AS user_key FROM customer")
def pseudonymize(spark: SparkSession, d: str) -> DataFrame:
    return scan(spark, d, "customer").select("c_custkey", pseudonym(F.when(F.col("c_custkey") % 5 != 0, F.col("c_custkey")), "pepper").alias("user_key"))


@query("SELECT n_nationkey, sha256('{\"n_nationkey\":' || n_nationkey || ',\"n_name\":\"' || n_name || '\",\"n_regionkey\":' || n_regionkey || '}') AS record_hash FROM nation")
def record_hash(spark: SparkSession, d: str) -> DataFrame:
    """The hash by which merges tell whether a record changed."""
    return scan(spark, d, "nation").select("n_nationkey", row_hash(["n_nationkey", "n_name", "n_regionkey"]).alias("record_hash"))


@query("SELECT event_type, count(*) AS n, count(*) FILTER (value > 50) AS high FROM events GROUP BY 1 ORDER BY n DESC, event_type")
def audit_summary(spark: SparkSession, d: str) -> DataFrame:
    """Counts by status, the most frequent first."""
    return scan(spark, d, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("value") > 50).alias("high")).orderBy(F.desc("n"), "event_type")


@query("SELECT p_partkey, p_type FROM part WHERE regexp_matches(p_type, '^(S|M).*(L|M)$')")
def pattern_filter(spark: SparkSession, d: str) -> DataFrame:
    return scan(spark, d, "part").where(F.col("p_type").rlike("^(S|M).*(L|M)$")).select("p_partkey", "p_type")


@query("SELECT o_custkey AS k, o_orderdate AS at FROM orders UNION ALL SELECT l_suppkey, l_shipdate FROM lineitem")
def union_all(spark: SparkSession, d: str) -> DataFrame:
    return scan(spark, d, "orders").select(F.col("o_custkey").alias("k"), F.col("o_orderdate").alias("at")).unionByName(scan(spark, d, "lineitem").select(F.col("l_shipdate").alias("at"), F.col("l_suppkey").alias("k")))


@query("SELECT p_brand AS x FROM part UNION SELECT p_type FROM part")
def union_distinct(spark: SparkSession, d: str) -> DataFrame:
    p = scan(spark, d, "part")
    return p.select(F.col("p_brand").alias("x")).union(p.select("p_type")).distinct()


@query("SELECT count(*) AS both_ FROM (SELECT user_id FROM events WHERE event_type = 'purchase' INTERSECT SELECT user_id FROM events WHERE event_type = 'error')")
def intersect_overlap(spark: SparkSession, d: str) -> DataFrame:
    e = scan(spark, d, "events")
    return e.where("event_type = 'purchase'").select("user_id").intersect(e.where("event_type = 'error'").select("user_id")).agg(F.count(F.lit(1)).alias("both_"))


_RULES = {"price_positive": "o_totalprice > 1000", "status_known": "nullif(o_orderstatus, 'P') IN ('F', 'O')", "not_urgent": "o_orderpriority <> '1-URGENT'"}
_VERDICT = "CASE " + " ".join(f"WHEN NOT coalesce({c}, false) THEN '{n}'" for n, c in _RULES.items()) + " ELSE '' END"


@query(f"SELECT o_orderkey, {_VERDICT} AS failed_rule FROM orders")
def dq_split(spark: SparkSession, d: str) -> DataFrame:
    return judged(scan(spark, d, "orders"), {n: F.expr(c) for n, c in _RULES.items()}, "failed_rule").select("o_orderkey", F.coalesce("failed_rule", F.lit("")).alias("failed_rule"))


@query(f"SELECT failed_rule, count(*) AS n FROM (SELECT {_VERDICT} AS failed_rule FROM orders) GROUP BY 1")
def dq_counts(spark: SparkSession, d: str) -> DataFrame:
    return dq_split(spark, d).groupBy("failed_rule").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT event_type, ts::DATE AS day, count(*) AS n, count(*) FILTER (value > 50) AS high, round(sum(value), 4) AS total, min(ts) AS first_ts, max(ts) AS last_ts FROM events GROUP BY 1, 2")
def audit_rollup(spark: SparkSession, d: str) -> DataFrame:
    return scan(spark, d, "events").groupBy("event_type", F.to_date("ts").alias("day")).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("value") > 50).alias("high"), F.round(F.sum("value"), 4).alias("total"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts")
    )


@query("SELECT event_type, string_agg(DISTINCT CAST(year(ts) AS VARCHAR), ',' ORDER BY CAST(year(ts) AS VARCHAR)) AS years, quantile_disc(value, 0.5) AS median_value, count(DISTINCT user_id) AS users FROM events GROUP BY 1")
def bi_measures(spark: SparkSession, d: str) -> DataFrame:
    return scan(spark, d, "events").groupBy("event_type").agg(
        F.array_join(F.array_sort(F.collect_set(F.year("ts").cast("string"))), ",").alias("years"), F.percentile_approx("value", 0.5, marts.ACCURACY).alias("median_value"), F.count_distinct("user_id").alias("users")
    )


@query("SELECT p_brand, count(*) AS n, round(sum(l_extendedprice), 2) AS revenue FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1 ORDER BY revenue DESC, p_brand LIMIT 10")
def topk(spark: SparkSession, d: str) -> DataFrame:
    """The ten best brands: the limit is the report."""
    parts = scan(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), "p_brand")
    agg = scan(spark, d, "lineitem").join(parts, "l_partkey").groupBy("p_brand").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("l_extendedprice"), 2).alias("revenue"))
    return agg.orderBy(F.desc("revenue"), "p_brand").limit(10)


@query("SELECT date_trunc('month', o_orderdate)::DATE AS month_start, strftime(min(o_orderdate), '%Y%m%d')::INT AS first_key, count(*) AS n, count(*) / sum(count(*)) OVER () * 100 AS share FROM orders GROUP BY 1")
def ratio_to_total(spark: SparkSession, d: str) -> DataFrame:
    o = scan(spark, d, "orders")
    per = o.groupBy(month_of(F.col("o_orderdate")).alias("month_start")).agg(date_key(F.min("o_orderdate")).alias("first_key"), F.count(F.lit(1)).alias("n"))
    total = per.agg(F.sum("n")).scalar()
    return per.select("month_start", "first_key", "n", marts.percent(F.col("n"), total).alias("share"))


@query(None)
def fingerprint(spark: SparkSession, d: str) -> DataFrame:
    """Order-independent checksum of a table; its JSON form has no SQL twin, see its test."""
    o = scan(spark, d, "orders")
    return o.agg(F.sum(fingerprint_part(o.columns)).alias("checksum"), F.count(F.lit(1)).alias("n"))


@query("SELECT key, count(*) AS records, count(*) / (SELECT count(*) FROM events) AS share FROM (SELECT unnest(json_keys(props)) AS key FROM events) GROUP BY 1")
def key_profile(spark: SparkSession, d: str) -> DataFrame:
    """Share of the records in which each JSON key occurs."""
    return key_presence(scan(spark, d, "events").select(F.col("props").alias("value")))


@query("SELECT o_orderkey, true AS is_deleted, 1700000000::BIGINT AS detected_at FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)")
def reconcile_tombstones(spark: SparkSession, d: str) -> DataFrame:
    """Known keys that a full look does not find any more."""
    return reconcile(scan(spark, d, "orders"), scan(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey")), "o_orderkey", 1_700_000_000)


@query("SELECT p_brand, year(l_shipdate)::INT AS year, count(*) AS n FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1, 2")
def volume_estimate(spark: SparkSession, d: str) -> DataFrame:
    """Counts by tag and year, without fetching any row."""
    parts = scan(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), "p_brand")
    return scan(spark, d, "lineitem").select("l_partkey", F.year("l_shipdate").alias("year")).join(parts, "l_partkey").groupBy("p_brand", "year").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT 'lineitem.part' AS fk, count(*) AS orphans FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part) UNION ALL SELECT 'orders.customer', count(*) FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer) UNION ALL SELECT 'orders.lineitem', count(*) FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)")
def fk_orphans(spark: SparkSession, d: str) -> DataFrame:
    """Rows whose foreign key has no parent, per key."""
    pairs = (("lineitem", "l_partkey", "part", "p_partkey"), ("orders", "o_custkey", "customer", "c_custkey"), ("orders", "o_orderkey", "lineitem", "l_orderkey"))
    parts = [orphans(scan(spark, d, c), ck, scan(spark, d, p), pk).select(F.lit(f"{c}.{p}").alias("fk"), "orphans") for c, ck, p, pk in pairs]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


# --- merges: even events are the table, odd ones (and some later repeats of even ones) the source
_T = "t AS (SELECT event_id // 4 AS k, max(event_id) AS v, max(value) AS value, max(event_type) AS kind, min(ts) AS lo, max(ts) AS hi FROM events WHERE event_id % 2 = 0 GROUP BY 1)"
_S = "s AS (SELECT event_id // 6 AS k, max(event_id) AS v, max(value) AS value, max(event_type) AS kind, min(ts) AS lo, max(ts) AS hi FROM events WHERE event_id % 2 = 1 GROUP BY 1)"


def _sides(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    e = scan(spark, d, "events")

    def side(rest: int, width: int) -> DataFrame:
        aggs = (F.max("event_id").alias("v"), F.max("value").alias("value"), F.max("event_type").alias("kind"), F.min("ts").alias("lo"), F.max("ts").alias("hi"))
        return e.where(F.col("event_id") % 2 == rest).groupBy(F.floor(F.col("event_id") / width).alias("k")).agg(*aggs)

    return side(0, 4), side(1, 6)


_COLS = ["k", "v", "value", "kind", "lo", "hi"]


def _merge_sql(updates: dict[str, str], when: str, *, insert: bool = True, by_source: bool = False, delete: str = "false") -> str:
    """The full outer join that a merge means."""
    action = f"CASE WHEN t.k IS NOT NULL AND s.k IS NOT NULL THEN CASE WHEN {delete} THEN 'D' WHEN {when} THEN 'U' ELSE 'K' END WHEN t.k IS NOT NULL THEN '{'D' if by_source else 'K'}' ELSE 'I' END"
    cols = ", ".join(f"CASE a WHEN 'I' THEN s_{c} WHEN 'U' THEN {updates.get(c, f't_{c}')} ELSE t_{c} END AS {c}" for c in _COLS)
    both = ", ".join([f"t.{c} AS t_{c}" for c in _COLS] + [f"s.{c} AS s_{c}" for c in _COLS])
    return f"WITH {_T}, {_S}, j AS (SELECT {both}, {action} AS a FROM t {'FULL' if insert else 'LEFT'} JOIN s ON t.k = s.k) SELECT {cols}, a AS action FROM j"


def _merged(spark: SparkSession, d: str, spec: m.MergeSpec) -> DataFrame:
    return m.merge(*_sides(spark, d), spec).withColumnRenamed("_action", "action")


_ALL = {c: f"s_{c}" for c in _COLS if c != "k"}


@query(_merge_sql(_ALL, "s.v > t.v AND s.value <> t.value"))
def merge_newer(spark: SparkSession, d: str) -> DataFrame:
    return _merged(spark, d, m.newer_and_different(_COLS, ["k"], "v", "value"))


_GUARD = """
WITH {T}, {S}, j AS (SELECT t.k AS t_k, s.k AS s_k, t.v AS t_v, s.v AS s_v, t.kind AS t_kind, s.kind AS s_kind, t.value AS t_value, s.value AS s_value, t.v + 3 AS t_as_of, t.value > 60 AS t_gone,
  CASE WHEN t.value > 60 THEN t.v + t.v % 5 END AS t_gone_at FROM t FULL JOIN s ON t.k = s.k),
w AS (SELECT *, CASE WHEN t_k IS NULL THEN 'I' WHEN s_k IS NOT NULL AND s_v > t_v AND s_kind <> t_kind THEN 'U' ELSE 'K' END AS a, coalesce(t_gone AND s_v > t_gone_at, false) AS back FROM j)
SELECT coalesce(t_k, s_k) AS k, CASE a WHEN 'K' THEN t_v ELSE s_v END AS v, CASE a WHEN 'K' THEN t_kind ELSE s_kind END AS kind,
  CASE WHEN a = 'I' OR (a = 'U' AND s_v >= t_as_of) THEN s_value ELSE t_value END AS value, CASE a WHEN 'I' THEN s_v WHEN 'U' THEN greatest(s_v, t_as_of) ELSE t_as_of END AS as_of,
  CASE WHEN a = 'I' THEN false WHEN a = 'U' THEN t_gone AND NOT back ELSE t_gone END AS gone, CASE WHEN a = 'I' OR (a = 'U' AND back) THEN NULL ELSE t_gone_at END AS gone_at, a AS action FROM w
""".replace("{T}", _T).replace("{S}", _S)


@query(_GUARD)
def merge_guarded(spark: SparkSession, d: str) -> DataFrame:
    """Guarded columns only move forward, and a newer record revives a deleted one."""
    target, source = _sides(spark, d)
    gone = F.col("value") > 60
    target = target.select("k", "v", "kind", "value", (F.col("v") + 3).alias("as_of"), gone.alias("gone"), F.when(gone, F.col("v") + F.col("v") % 5).alias("gone_at"))
    source = source.select("k", "v", "kind", "value", F.col("v").alias("as_of"), F.lit(False).alias("gone"), F.lit(None).cast("bigint").alias("gone_at"))
    spec = m.newer_with_guard(target.columns, ["k"], "v", "kind", guarded=["value"], as_of="as_of", deleted="gone", deleted_at="gone_at")
    return m.merge(target, source, spec).withColumnRenamed("_action", "action")


# --- versioned tables, in a folder of their own beside the checkpoints
def _table(spark: SparkSession, like: DataFrame, keys: list[str], **kw) -> VersionedTable:
    return VersionedTable(spark, f"{ensure_checkpoint_dir(spark)}/tables/{uuid.uuid4().hex}", dict(like.dtypes), keys, **kw)


def _stored(spark: SparkSession, d: str) -> VersionedTable:
    target, source = _sides(spark, d)
    table = _table(spark, target, ["k"])
    table.overwrite(target)
    table.merge(source, m.newer_and_different(_COLS, ["k"], "v", "value"))
    table.compact(["v"])
    table.merge(source, m.newer_and_different(_COLS, ["k"], "v", "value"))  # changes nothing
    return table


_STORED = _merge_sql(_ALL, "s.v > t.v AND s.value <> t.value")


@query(f"SELECT * EXCLUDE (action) FROM ({_STORED})")
def store_merge(spark: SparkSession, d: str) -> DataFrame:
    """A table after a first load, a merge, a compaction and a replay of the merge."""
    return _stored(spark, d).read()


@query(f"SELECT 1 AS number, 'overwrite' AS operation, 0::BIGINT AS inserted, 0::BIGINT AS updated UNION ALL SELECT 2, 'merge', count(*) FILTER (action = 'I'), count(*) FILTER (action = 'U') FROM ({_STORED}) UNION ALL SELECT 3, 'compact by v', 0, 0")
def store_history(spark: SparkSession, d: str) -> DataFrame:
    """The versions of that table with what each changed."""
    rows = [(v.number, v.operation, v.metrics.get("inserted", 0), v.metrics.get("updated", 0)) for v in _stored(spark, d).history()]
    return spark.createDataFrame(rows, "number int, operation string, inserted bigint, updated bigint")


@query("SELECT event_id, user_id, event_type, CASE WHEN event_type = 'purchase' THEN value * 2 ELSE value END AS value FROM events WHERE event_type <> 'error'")
def store_replace_parts(spark: SparkSession, d: str) -> DataFrame:
    """A table in parts of which one is replaced and another taken out."""
    e = scan(spark, d, "events").select("event_id", "user_id", "event_type", "value")
    table = _table(spark, e, ["event_id"], part_by=["event_type"])
    table.overwrite(e)
    bought = table.read(parts=["purchase"])
    table.replace_parts(bought.withColumn("value", F.col("value") * 2), ["purchase", "error"])
    return table.read()


@query(_merge_sql({"kind": "s_kind"}, "s.value <= 90 AND s.kind IS DISTINCT FROM t.kind", delete="s.value > 90").replace("ELSE 'I' END AS a", "WHEN s.value <= 90 THEN 'I' END AS a").replace("FROM j", "FROM j WHERE a IS NOT NULL"))
def merge_bridge_sync(spark: SparkSession, d: str) -> DataFrame:
    target, source = _sides(spark, d)
    marked = source.withColumn("_change", F.when(F.col("value") > 90, "delete").otherwise("upsert"))
    return m.merge(target, marked, m.bridge_sync(["k"], "kind")).withColumnRenamed("_action", "action")


@query(_merge_sql({"v": "greatest(s_v, t_v)", "kind": "CASE WHEN s_v > t_v THEN s_kind ELSE t_kind END", "value": "CASE WHEN s_v > t_v THEN s_value ELSE t_value END", "lo": "least(s_lo, t_lo)", "hi": "greatest(s_hi, t_hi)"},
  "(s.v > t.v AND (s.kind IS DISTINCT FROM t.kind OR s.value IS DISTINCT FROM t.value)) OR s.lo < t.lo OR s.hi > t.hi"))
def merge_span(spark: SparkSession, d: str) -> DataFrame:
    return _merged(spark, d, m.span_and_profile(["k"], "v", profile=["kind", "value"], first="lo", last="hi"))


@query(_merge_sql({}, "false"))
def merge_insert_only(spark: SparkSession, d: str) -> DataFrame:
    return _merged(spark, d, m.insert_only(["k"]))


@query(_merge_sql({"value": "s_value"}, "s.v > t.v", insert=False))
def merge_update_only(spark: SparkSession, d: str) -> DataFrame:
    return _merged(spark, d, m.update_only(["k"], {"value": s("value")}, s("v") > t("v")))


@query(_merge_sql(_ALL, "s.value IS DISTINCT FROM t.value", by_source=True))
def merge_full_sync(spark: SparkSession, d: str) -> DataFrame:
    return _merged(spark, d, m.full_sync(_COLS, ["k"], "value"))


@query(_merge_sql(_ALL, "true"))
def merge_upsert(spark: SparkSession, d: str) -> DataFrame:
    return _merged(spark, d, m.upsert_always(_COLS, ["k"]))
