"""Physical-plan checks: what the planner does with each registered query."""

from __future__ import annotations

import pytest

import __spark_entry__ as E
from ridgeline.plans.catalog import QUERIES

NAMES = sorted(QUERIES)
SLOW_PATHS = ("PythonUDF", "BatchEvalPython", "ArrowEvalPython", "FlatMapGroupsInPandas", "MapInPandas")
PAIR_JOINS = ("CartesianProduct", "BroadcastNestedLoopJoin")


def plan_text(spark, df) -> str:
    mode = spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    return df._jdf.queryExecution().explainString(mode)


@pytest.fixture(scope="module")
def plans(spark, sf_small):
    return {n: plan_text(spark, E.queries()[n](spark, sf_small)) for n in NAMES}


@pytest.mark.parametrize("name", NAMES)
def test_no_python_and_no_pairwise_join(plans, name):
    txt = plans[name]
    for op in SLOW_PATHS + PAIR_JOINS:
        assert op not in txt, f"{name} plans {op}"


@pytest.mark.parametrize("name", ["next_activities", "upcoming_with_host", "top_hosts", "area_counts"])
def test_top_n_is_take_ordered(plans, name):
    assert "TakeOrderedAndProject" in plans[name]


@pytest.mark.parametrize("name", ["member_roster", "recent_activities"])
def test_full_listings_are_range_partitioned_sorts(plans, name):
    txt = plans[name]
    assert "rangepartitioning" in txt and "TakeOrderedAndProject" not in txt and "Limit" not in txt


@pytest.mark.parametrize("name", ["month_filter", "activity_attendees", "top_hosts", "popular_activities",
                                  "monthly_trend", "annual_stats", "sql_param"])
def test_date_range_reaches_the_scan(plans, name):
    scan = [b for b in plans[name].split("\n\n") if "Scan parquet" in b and "orders.parquet" in b]
    assert scan, name
    assert any("GreaterThanOrEqual(o_orderdate" in b and "PushedFilters" in b for b in scan), name


def test_per_month_top3_uses_group_limit(plans):
    assert "WindowGroupLimit" in plans["briefing_context"]


def test_scans_are_pruned(plans):
    roster = plans["member_roster"]
    assert "ReadSchema: struct<c_custkey:bigint,c_nationkey:int,c_mktsegment:string>" in roster
    kpi = plans["member_kpi"]
    assert "l_extendedprice" not in kpi and "o_totalprice" not in kpi


def test_hot_keys_are_combined_before_shuffle(plans):
    # per-member / per-activity reductions run a partial aggregate map-side
    for name in ("member_summary", "member_kpi", "top_attendees", "upsert_rows", "label_to_key"):
        assert "partial_" in plans[name], name


def test_area_lookup_shuffles_once_and_broadcasts_the_dimension(plans):
    txt = plans["area_geo"].split("\n\n")[0]
    shuffles = txt.count("Exchange (") - txt.count("BroadcastExchange (")
    assert shuffles == 1 and "SortMergeJoin" not in txt
    assert "BroadcastHashJoin LeftOuter" in txt


def test_cluster_conf_sizes_partitions_from_the_largest_shuffle():
    from ridgeline.session import TARGET_PARTITION_BYTES, cluster_conf

    tb = 1024 ** 4
    c = cluster_conf(30 * tb)  # e.g. attendance ⋈ activities on 100 TB of input, pruned to join columns
    assert int(c["spark.sql.shuffle.partitions"]) == 30 * tb // TARGET_PARTITION_BYTES
    assert c["spark.sql.adaptive.skewJoin.enabled"] == "true"
    assert c["spark.sql.adaptive.coalescePartitions.parallelismFirst"] == "false"
    assert int(cluster_conf(1)["spark.sql.shuffle.partitions"]) == 200


def test_cluster_settings_are_accepted_and_keep_results(spark, sf_small):
    from oracle_check import compare, duck

    from ridgeline.session import cluster_conf

    conf = cluster_conf(64 * 1024 ** 3)  # 256 shuffle partitions, so that the run is short
    old = {k: spark.conf.get(k, None) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
            assert spark.conf.get(k) == v
        con = duck(sf_small)
        for name in ("member_summary", "first_attendance"):
            ok, msg = compare(spark, con, name, E.queries()[name], E.oracle_sql()[name], sf_small)
            assert ok, msg
    finally:
        for k, v in old.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


def test_day_partitioned_activities_prune_directories(spark, sf_small):
    from ridgeline.operators import filters
    from ridgeline.session import shared_dir
    from ridgeline.sources.tables import load_club, read_by_date, save_by_date

    a = load_club(spark, sf_small)["activities"]
    path = shared_dir(spark, "activities-by-day")
    save_by_date(a, path)
    stored = read_by_date(spark, path)
    got = filters.month_filter(stored, "2001-07")
    scan = [b for b in plan_text(spark, got).split("\n\n") if "Scan parquet" in b]
    assert any("PartitionFilters: [isnotnull(date" in b and "date#" in b and ">= 2001-07-01" in b for b in scan), scan
    exp = filters.month_filter(a, "2001-07")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, exp.collect()))
    assert stored.count() == a.count()


def test_month_partitioned_attendance_prunes_and_keeps_results(spark, sf_small):
    from collections import Counter

    from ridgeline.operators import aggs, joins, report
    from ridgeline.plans.summary import member_summary
    from ridgeline.session import shared_dir
    from ridgeline.sources.tables import load_club, read_attendance_by_month, save_attendance_by_month

    c = load_club(spark, sf_small)
    m, a, at = c["members"], c["activities"], c["attendance"]
    path = shared_dir(spark, "attendance-by-month")
    save_attendance_by_month(at, a, path)
    stored = read_attendance_by_month(spark, path)
    assert stored.count() == at.count()
    month = "2001-07"
    cases = {
        "attendees": lambda t: joins.activity_attendees(a, t, m, month),
        "by_year": lambda t: joins.birth_year_attendance(m, a, t, month),
        "top_attendees": lambda t: aggs.top_attendees(a, t, m, month),
        "popular": lambda t: aggs.popular_activities(a, t, month),
        "first": lambda t: aggs.first_attendance(a, t, m, "1995-06"),
        "first_later": lambda t: aggs.first_attendance(a, t, m, month),
        # operators over all attendance tolerate the extra partition column
        "summary": lambda t: member_summary(m, a, t, "2001-07-15"),
        "kpi": lambda t: aggs.member_kpi(m, a, t, "2001-07-15"),
        "digest": lambda t: report.activity_digest(a, t, m, month),
        "report": lambda t: report.report_lines(member_summary(m, a, t, "2001-07-15"), a, t, m, month),
    }
    for name, q in cases.items():
        got, exp = q(stored), q(at)
        assert Counter(map(tuple, got.collect())) == Counter(map(tuple, exp.collect())), name
        scan = [b for b in plan_text(spark, got).split("\n\n") if "Scan parquet" in b and "attendance-by-month" in b]
        if name in ("summary", "kpi", "report", "digest"):  # whole-table or checkpointed inputs: results only
            continue
        if name.startswith("first"):
            # first months from attendance alone (user_no only, months from the
            # directory names), then one pruned month joined with that month's activities
            full = [b for b in scan if "PartitionFilters" not in b]
            pruned = [b for b in scan if "PartitionFilters: [isnotnull(activity_month" in b]
            assert len(full) == 1 and "ReadSchema: struct<user_no:bigint>" in full[0], name
            assert len(pruned) == 1, name
            orders = [b for b in plan_text(spark, got).split("\n\n") if "orders.parquet" in b]
            assert orders and all("GreaterThanOrEqual(o_orderdate" in b for b in orders), name
            continue
        assert scan and all("PartitionFilters: [isnotnull(activity_month" in b and "2001-07" in b for b in scan), name


def test_report_never_shuffles_members_by_status(spark, sf_small):
    # status has a handful of values: a shuffle on it would put most members in one task
    import __spark_entry__ as E

    txt = plan_text(spark, E.queries()["report_lines"](spark, sf_small))
    assert not [b for b in txt.split("\n\n") if "Join" in b.split("\n")[0] and "Left keys [1]: [status" in b]


def test_nation_is_broadcast_by_the_planners_own_size_check(spark, sf_small):
    from ridgeline.sources import tables

    txt = plan_text(spark, tables.members(spark, sf_small))
    assert "BroadcastHashJoin" in txt and "hashpartitioning(c_nationkey" not in txt


def test_no_shuffle_join_on_a_low_cardinality_key(spark, sf_small):
    # no query shuffles a large side on a key with a handful of values
    import re

    offenders = []
    for name in NAMES:
        for block in plan_text(spark, E.queries()[name](spark, sf_small)).split("\n\n"):
            head = block.split("\n")[0]
            if "SortMergeJoin" in head or "ShuffledHashJoin" in head:
                keys = re.search(r"Left keys \[\d+\]: \[(.*)\]", block).group(1)
                if re.match(r"(c_nationkey|n_nationkey|status|_key|role|gender|area)#", keys):
                    offenders.append((name, keys))
    assert not offenders, offenders



ENTITY_SOURCE_COLUMNS = {
    "customer.parquet": {"c_custkey", "c_nationkey", "c_mktsegment"},
    "nation.parquet": {"n_nationkey", "n_name"},
    "orders.parquet": {"o_orderkey", "o_custkey", "o_orderdate"},
    "lineitem.parquet": {"l_orderkey", "l_partkey"},
}


@pytest.mark.parametrize("name", NAMES)
def test_every_scan_reads_only_derivation_columns(plans, name):
    import re

    for block in plans[name].split("\n\n"):
        if "Scan parquet" not in block:
            continue
        for table, allowed in ENTITY_SOURCE_COLUMNS.items():
            if table in block:
                schema = re.search(r"ReadSchema: struct<(.*)>", block).group(1)
                cols = {c.split(":")[0] for c in schema.split(",") if c}
                assert cols <= allowed, (name, table, cols - allowed)
