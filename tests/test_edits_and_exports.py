"""Inputs that the fixtures' happy path does not show: exports, reloads, trims, grids, report bounds, orders."""

from __future__ import annotations

import datetime as dt

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from ridgeline.functions import expr as X
from ridgeline.functions import lookups as L
from ridgeline.operators import aggs, filters, joins, report, writes
from ridgeline.plans import inputs
from ridgeline.plans.catalog import QUERIES, WRITING
from ridgeline.plans.summary import member_summary
from ridgeline.sources import feeds, tables
from pyspark.sql import functions as F

M = "user_no bigint, name string, birth_year int, gender string, area string, role string, point int, description string, profile_image_url string, created_at date"
A = "event_id bigint, date date, title string, host bigint, score int, album_url string"


def test_rows_appended_to_a_table_are_seen(spark, sf_small, tmp_path):
    folder = tmp_path / "region.parquet"
    folder.mkdir()
    rows = pq.read_table(f"{sf_small}/region.parquet")
    pq.write_table(rows, folder / "a.parquet")
    n = tables.read_table(spark, str(tmp_path), "region").count()
    pq.write_table(rows, folder / "b.parquet")
    assert tables.read_table(spark, str(tmp_path), "region").count() == 2 * n


@pytest.mark.parametrize("name", [n for n in QUERIES if n not in WRITING])
def test_building_a_query_starts_no_job(spark, sf_small, name):
    sc = spark.sparkContext
    sc.setJobGroup(f"build-{name}", name)
    QUERIES[name](spark, sf_small)
    sc.setLocalProperty("spark.jobGroup.id", None)
    assert not sc.statusTracker().getJobIdsForGroup(f"build-{name}")


def test_declared_schemas_are_the_files_schemas(spark, sf_small):
    for name in tables.BASE_TABLES:
        assert tables.read_table(spark, sf_small, name).dtypes == spark.read.parquet(f"{sf_small}/{name}.parquet").dtypes


def test_entities_have_the_types_of_their_schemas(spark, sf_small):
    c = tables.load_club(spark, sf_small)
    for name, schema in (("members", tables.MEMBERS_SCHEMA), ("activities", tables.ACTIVITIES_SCHEMA), ("attendance", tables.ATTENDANCE_SCHEMA)):
        assert c[name].dtypes == [(f.name, f.dataType.simpleString()) for f in schema.fields]


def test_csv_gives_back_every_text(spark, tmp_path):
    texts = ["line1\nline2", "a\r\nb\rc", "\\N", "\\", "\\n", "\\\\n\n\\", "", " lead and trail ", '"q",;', "\\\"", None, "\t", "é　"]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "k bigint, t string, z string")
    path = str(tmp_path / "csv")
    feeds.export_csv(df.repartition(3), path, preferred=["z"])
    back = feeds.read_csv(spark, path, df.schema, preferred=["z"])
    assert sorted(map(tuple, back.collect())) == [(i, t, "x") for i, t in enumerate(texts)]


def test_trim_removes_what_a_full_strip_removes(spark):
    spaces = [chr(c) for c in range(0x3001) if chr(c).isspace()]
    rows = [(f"{s}남{s}",) for s in spaces] + [("남​",)]
    got = [r[0] for r in spark.createDataFrame(rows, "g string").select(X.norm_gender(F.col("g"))).collect()]
    assert got == ["M"] * len(spaces) + ["U"]


def members_of(spark, rows):
    return spark.createDataFrame([(k, n, y, "M", "A", "member", 0, None, None, dt.date(2000, 1, 1)) for k, n, y in rows], M)


def test_report_drops_untitled_groups_and_bounds_its_lines(spark):
    m = members_of(spark, [(k, "Kim", 1980) for k in range(1, 1001)] + [(2000, "Lee", 1990)])
    a = spark.createDataFrame([(1, dt.date(2001, 7, 1), "Peak", 1, 1, None), (2, dt.date(2001, 7, 2), None, 1, 1, None)], A)
    at = spark.createDataFrame([(1, k) for k in range(1, 1001)] + [(1, 2000), (2, 1)], "event_id bigint, user_no bigint")
    lines = report.report_lines(member_summary(m, a, at, "2001-07-15"), a, at, m, "2001-07").orderBy(*report.REPORT_ORDER).collect()
    assert all(r.line is not None and r.k1 is not None and len(r.line) < 1000 for r in lines)
    text = "".join(r.line for r in lines)
    assert "참석(1001명): " + "Kim, " * 1000 + "Lee  \n" in text and L.RPT_NO_ACTIVITY not in text and "None" not in text
    only_untitled = report.report_lines(member_summary(m, a, at, "2001-07-15"), a.filter("title IS NULL"), at, m, "2001-07").collect()
    assert L.RPT_NO_ACTIVITY not in "".join(r.line for r in only_untitled)
    none = report.report_lines(member_summary(m, a, at, "2001-07-15"), a, at, m, "2002-07").collect()
    assert L.RPT_NO_ACTIVITY in "".join(r.line for r in none)


def test_of_edits_with_one_id_the_last_position_wins(spark, sf_small):
    c = tables.load_club(spark, sf_small)
    base = spark.createDataFrame([(1, dt.date(2001, 7, 1), "a", 1, 1, None)], A)
    edited = spark.createDataFrame([("", dt.date(2001, 7, 3), "z first", 1, 1, "none", 1), ("", dt.date(2001, 7, 2), "a last", 1, 1, "none", 2)], A.replace("event_id bigint", "event_id string") + ", seq bigint")
    out, _ = writes.apply_grid_edits(base, c["attendance"], base.limit(0), edited)
    assert {(r.event_id, r.title) for r in out.collect()} == {("1", "a"), ("", "a last")}


def test_member_save_deletes_upserts_and_counts(spark):
    base = members_of(spark, [(1, "a", 1980), (2, "b", 1981), (3, "c", None)])
    visible = base.filter("user_no < 3")
    edited = members_of(spark, [(1, "a2", 1980), (9, "new", 1999)]).withColumn("seq", F.col("user_no"))
    assert {(r.user_no, r.name) for r in writes.save_members(base, visible, edited).collect()} == {(1, "a2"), (3, "c"), (9, "new")}
    assert tuple(writes.save_counts(visible, edited, "user_no").first()) == (2, 1)
    nothing = writes.save_counts(visible.limit(0), edited.limit(0), "user_no").first()
    assert tuple(nothing) == (0, 0)


def test_stated_orders(spark, sf_small):
    c = tables.load_club(spark, sf_small)
    m, a, at = c["members"], c["activities"], c["attendance"]
    key = lambda *v: tuple((x is None, x) if x is not None else (True, 0) for x in v)
    roster = [key(r.birth_year, r.name, r.user_no) for r in filters.full_roster(m).collect()]
    assert roster == sorted(roster) and len(roster) == m.count()
    facets = [(r.facet, r.value) for r in QUERIES["facet_values"](spark, sf_small).collect()]
    months = [v for f, v in facets if f == "month"]
    assert months == sorted(months, reverse=True) and [v for f, v in facets if f == "area"] == sorted(v for f, v in facets if f == "area")
    rows = [key(r.date, r.birth_year, r.name) for r in QUERIES["activity_attendees"](spark, sf_small).collect()]
    assert rows == sorted(rows)
    for name in ("inactivity_warnings", "score_table"):
        labels = [(r.member_label, r.user_no) for r in QUERIES[name](spark, sf_small).collect()]
        assert labels == sorted(labels)
    for df in (joins.birth_year_attendance(m, a, at, "2001-07"), aggs.birth_year_gender(m), aggs.birth_years(m)):
        years = [key(r.birth_year) for r in df.collect()]
        assert years == sorted(years)
    trend = [r.month for r in aggs.monthly_trend(a, dt.date(2001, 7, 15)).collect()]
    assert trend == sorted(trend)


def test_boards_name_a_missing_name_in_their_own_way(spark):
    m = members_of(spark, [(1, None, 1980)])
    a = spark.createDataFrame([(1, dt.date(2001, 7, 1), "Peak", 1, 1, None)], A)
    at = spark.createDataFrame([(1, 1)], "event_id bigint, user_no bigint")
    boards = {r.board: r.image_url for r in aggs.ranked_boards(a, at, m, "2001-07").collect()}
    assert "name=None&" in boards["hosts"] and "name=None&" in boards["attendees"]
    assert "name=Host&" in joins.upcoming_with_host(a, m, "2001-07-01").first().image_url


def test_next_briefing_needs_something_ahead(spark):
    a = spark.createDataFrame([(i, dt.date(2001, 7, i), f"t{i}", i, 1, None) for i in range(1, 6)], A)
    assert report.next_briefing(a, "2001-07-03").first().text.count("\n- ") == 3
    assert report.next_briefing(a, "2002-01-01").count() == 0


def test_edited_rows_have_positions_of_their_own(spark, sf_small):
    c = tables.load_club(spark, sf_small)
    for _, edited in (inputs.member_grid(c["members"]), inputs.activity_grid(c["activities"], "2001-07")):
        assert edited.count() == edited.select("seq").distinct().count()


def test_an_edit_of_one_month_touches_that_month_only(spark, sf_small, tmp_path):
    c = tables.load_club(spark, sf_small)
    path = str(tmp_path / "by-month")
    tables.save_attendance_by_month(c["attendance"], c["activities"], path)
    month = filters.month_filter(c["activities"], "1995-06")
    before = tables.read_attendance_by_month(spark, path)
    others = before.filter("activity_month IS DISTINCT FROM '1995-06'").count()
    batch = month.select("event_id").orderBy("event_id").limit(5)
    chosen = batch.select("event_id", F.lit(7).cast("long").alias("user_no"))
    want = writes.replace_attendance(before.filter("activity_month = '1995-06'").drop("activity_month"), batch, chosen).count()
    tables.rewrite_attendance_month(spark, path, "1995-06", lambda at: writes.replace_attendance(at, batch, chosen))
    after = tables.read_attendance_by_month(spark, path)
    assert after.filter("activity_month = '1995-06'").count() == want
    assert after.filter("activity_month = '1995-06' AND user_no = 7").count() >= 5
    assert after.filter("activity_month IS DISTINCT FROM '1995-06'").count() == others
    tables.rewrite_attendance_month(spark, path, "1995-06", lambda at: at.limit(0))
    assert tables.read_attendance_by_month(spark, path).count() == others
