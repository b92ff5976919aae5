"""Hot keys: one activity holds a third of all attendance rows.

With broadcasts disabled (so the big joins shuffle, as they would at scale)
and skew thresholds lowered to fit the fixture, the executed adaptive plan
must split the hot join partition, and the results must equal a brute-force
pandas computation over the same rows.
"""

from __future__ import annotations

import datetime as dt

import pandas as pd
import pytest
from pyspark.sql import functions as F

from ridgeline.operators import aggs
from ridgeline.plans.summary import per_member_scores

AS_OF = dt.date(2001, 7, 15)
HOT_EVENT = 150  # dated 2001-05-31: inside the 90-day active window
N_ROWS = 30_000
N_EVENTS = 400
N_USERS = 1_000

SKEW_CONF = {
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "1k",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "2k",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
    "spark.sql.adaptive.coalescePartitions.enabled": "false",
    "spark.sql.shuffle.partitions": "8",
}


@pytest.fixture()
def skewed(spark):
    old = {k: spark.conf.get(k, None) for k in SKEW_CONF}
    for k, v in SKEW_CONF.items():
        spark.conf.set(k, v)
    acts = spark.range(N_EVENTS).select(
        F.col("id").alias("event_id"),
        F.date_add(F.lit(dt.date(2001, 1, 1)), (F.col("id") % 200).cast("int")).alias("date"),
        (1 + F.col("id") % 5).cast("int").alias("score"))
    at = spark.range(N_ROWS).select(
        F.when(F.col("id") % 3 == 0, F.lit(HOT_EVENT)).otherwise(F.col("id") % N_EVENTS).alias("event_id"),
        (F.col("id") % N_USERS).alias("user_no"))
    members = spark.range(N_USERS).select(
        F.col("id").alias("user_no"), F.concat(F.lit("m"), F.col("id").cast("string")).alias("name"))
    yield acts, at, members
    for k, v in old.items():
        if v is None:
            spark.conf.unset(k)
        else:
            spark.conf.set(k, v)


def final_plan(spark, df) -> str:
    mode = spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    return df._jdf.queryExecution().explainString(mode)


def joined_pd(acts, at) -> pd.DataFrame:
    return at.toPandas().merge(acts.toPandas(), on="event_id")


def test_fixture_is_hot(skewed):
    _, at, _ = skewed
    top = at.groupBy("event_id").count().orderBy(F.col("count").desc()).first()
    assert top.event_id == HOT_EVENT and top["count"] >= N_ROWS // 3


def test_member_scores_split_hot_activity(spark, skewed):
    acts, at, _ = skewed
    df = per_member_scores(acts, at, AS_OF)
    got = {r.user_no: (r._total, r.first_date) for r in df.collect()}
    assert "SortMergeJoin(skew=true)" in final_plan(spark, df)
    j = joined_pd(acts, at)
    j["date"] = pd.to_datetime(j["date"]).dt.date
    exp = j[j["date"] <= AS_OF].groupby("user_no")["score"].sum().to_dict()
    first = j.groupby("user_no")["date"].min().to_dict()
    assert {u: v[0] for u, v in got.items()} == exp
    assert {u: v[1] for u, v in got.items()} == first


def test_first_attendance_splits_hot_activity(spark, skewed):
    acts, at, members = skewed
    df = aggs.first_attendance(acts, at, members, "2001-01")
    got = sorted((r.user_no, r.first_date) for r in df.collect())
    assert "SortMergeJoin(skew=true)" in final_plan(spark, df)
    j = joined_pd(acts, at)
    j["date"] = pd.to_datetime(j["date"]).dt.date
    first = j.groupby("user_no")["date"].min()
    exp = sorted((u, d) for u, d in first.items() if d.year == 2001 and d.month == 1)
    assert got == exp


def test_kpi_semi_join_splits_hot_activity(spark, skewed):
    acts, at, members = skewed
    m = members.select("user_no", F.lit("member").alias("role"), F.lit(1).alias("point"))
    df = aggs.member_kpi(m, acts, at, AS_OF)
    r = df.collect()[0]
    assert "skew=true" in final_plan(spark, df)
    j = joined_pd(acts, at)
    j["date"] = pd.to_datetime(j["date"]).dt.date
    recent = j[j["date"] >= AS_OF - dt.timedelta(days=90)]
    assert r.total_members == N_USERS
    assert r.active_count == recent["user_no"].nunique()
    assert r.total_points == N_USERS + int(j["score"].sum())


def test_hot_member_is_split_in_the_member_join(spark, skewed):
    from ridgeline.operators import joins

    acts, _, members = skewed
    hot_user = 5
    at = spark.range(N_ROWS).select(
        (F.col("id") % N_EVENTS).alias("event_id"),
        F.when(F.col("id") % 3 == 0, F.lit(hot_user)).otherwise(F.col("id") % N_USERS).alias("user_no"))
    a = acts.select("event_id", "date", F.lit("t").alias("title"), F.lit(None).cast("string").alias("album_url"))
    m = members.select("user_no", "name", F.lit(1970).alias("birth_year"))
    df = joins.activity_attendees(a, at, m, "2001-03")
    got = df.count()
    df.collect()
    assert "skew=true" in final_plan(spark, df)
    j = joined_pd(acts, at)
    j["date"] = pd.to_datetime(j["date"]).dt.date
    assert got == int(((j["date"] >= dt.date(2001, 3, 1)) & (j["date"] < dt.date(2001, 4, 1))).sum())


def test_cascade_delete_anti_join_splits_hot_activity(spark, skewed):
    from ridgeline.operators import writes

    _, at, _ = skewed
    removed = spark.range(0, N_EVENTS, 7).select(F.col("id").alias("event_id"))  # the hot activity stays
    df = writes.cascade_delete(at, removed)
    got = df.count()
    df.collect()
    assert "skew=true" in final_plan(spark, df)
    a = at.toPandas()
    assert got == int((a["event_id"] % 7 != 0).sum())


def test_hot_host_is_split_in_the_host_lookup(spark, skewed):
    from ridgeline.operators import joins

    _, _, members = skewed
    hot_host = 9
    a = spark.range(N_ROWS).select(
        F.col("id").alias("event_id"),
        F.when(F.col("id") % 3 == 0, F.lit(hot_host)).otherwise(F.col("id") % N_USERS).alias("host"))
    m = members.select("user_no", "name", F.lit(1970).alias("birth_year"), F.lit("X").alias("area"),
                       F.lit("member").alias("role"))
    df = joins.event_host_label(a, m)
    got = df.filter(F.col("host_label").isNotNull()).count()
    df.collect()
    assert "skew=true" in final_plan(spark, df)  # left outer join: the hot left side is split
    assert got == N_ROWS
