"""What the plans look like: pruned scans, filters at the scan, no cross joins, limits before the shuffle."""

import contextlib
import io

import pytest

from sedimenta.plans import catalogue


def plan(df):
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain("formatted")
    return out.getvalue()


def test_filters_and_columns_reach_the_scan(spark, sf):
    p = plan(catalogue.QUERIES["scan_project_filter"](spark, sf))
    assert "GreaterThanOrEqual(o_orderdate" in p and "In(o_orderstatus" in p and "o_orderpriority" not in p


def test_newest_is_limited_before_the_shuffle(spark, sf):
    p = plan(catalogue.QUERIES["latest_per_key"](spark, sf))
    assert p.index("WindowGroupLimit") >= 0 and "Partial" in p


def test_current_state_reads_only_what_it_needs(spark, sf):
    p = plan(catalogue.QUERIES["p1_found"](spark, sf))
    assert "body" not in p and p.count("Exchange") <= 2 * 3 + 1 and "EqualTo(is_deleted,true)" in p


@pytest.mark.parametrize("name", ["p1_found", "p2_found", "agg_group_month", "tag_pairs", "cohort_retention", "merge_full_sync", "ratio_to_total", "first_event_hours"])
def test_no_cross_join_and_no_python_in_the_hot_path(spark, sf, name):
    p = plan(catalogue.QUERIES[name](spark, sf))
    assert "CartesianProduct" not in p and "BroadcastNestedLoopJoin" not in p and "Python" not in p and "Pandas" not in p


def test_names_agree_and_every_oracle_has_its_query():
    assert set(catalogue.ORACLES) <= set(catalogue.QUERIES)
