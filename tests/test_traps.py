"""Semantic traps and properties (§5.2) on small literal frames."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from ridgeline.functions import lookups as L
from ridgeline.operators import aggs, filters, joins, report, writes
from ridgeline.plans.summary import member_summary
from ridgeline.sources import feeds
from ridgeline.sources.tables import ACTIVITIES_SCHEMA, ATTENDANCE_SCHEMA, MEMBERS_SCHEMA

D = dt.date
AS_OF = D(2001, 7, 15)


def mem(spark, rows):
    """rows: (user_no, name, birth_year, gender, area, role, point[, description, image, created_at])"""
    full = []
    for r in rows:
        r = tuple(r) + (None,) * (10 - len(r))
        created = r[9] if r[9] is not None else D(2000, 1, 1)
        full.append(r[:9] + (created,))
    return spark.createDataFrame(full, MEMBERS_SCHEMA)


def act(spark, rows):
    """rows: (event_id, date, title, host, score, album_url)"""
    return spark.createDataFrame([tuple(r) + (None,) * (6 - len(r)) for r in rows], ACTIVITIES_SCHEMA)


def att(spark, rows):
    return spark.createDataFrame(rows, ATTENDANCE_SCHEMA)


def rows(df, *order):
    return [tuple(r) for r in (df.orderBy(*order) if order else df).collect()]


# --- P / O -------------------------------------------------------------------

def test_null_role_dropped_but_null_status_kept(spark):
    m = mem(spark, [(1, "a", 1970, "M", "X", None, 1), (2, "b", 1970, "M", "X", "exmember", 1),
                    (3, "c", 1970, "M", "X", "member", 1)])
    assert [r.user_no for r in filters.current_members(m).collect()] == [3]
    s = spark.createDataFrame([(1, None), (2, "exmember"), (3, "active")], "user_no long, status string")
    assert sorted(r.user_no for r in filters.non_ex_summary(s).collect()) == [1, 3]


def test_roster_nulls_last(spark):
    m = mem(spark, [(1, "b", None, "M", "X", "member"), (2, "a", 1980, "M", "X", "member"),
                    (3, None, 1980, "M", "X", "member"), (4, "a", 1970, "M", "X", "member")])
    assert [r.user_no for r in filters.member_roster(m).collect()] == [4, 2, 3, 1]
    assert [r.user_no for r in filters.member_roster(m, 2).collect()] == [4, 2]


def test_facet_filter_empty_choice_and_null(spark):
    m = mem(spark, [(1, "a", 1970, "M", None, "member"), (2, "b", 1971, "M", "X", "staff")])
    assert filters.facet_filter(m, [], [], []).count() == 2
    assert [r.user_no for r in filters.facet_filter(m, areas=["X"]).collect()] == [2]
    assert filters.facet_filter(m, years=[1970], areas=["X"]).count() == 0


def test_text_search_folds_unicode_case(spark):
    t = spark.createDataFrame([(1, "ÉCOLE"), (2, "Σοφία"), (3, "x")], "k long, name string")
    assert sorted(r.k for r in filters.text_search(t, ["name"], "école|σΟΦ").collect()) == [1, 2]


def test_text_search_is_case_insensitive_regex_and_null_safe(spark):
    m = mem(spark, [(1, "Kim Minsu", 1970, "M", "X", "member", 1, None),
                    (2, "Lee", 1970, "M", "X", "member", 1, "lives in SEOUL"),
                    (3, "Park", 1970, "M", "X", "member", 1, None)])
    got = filters.text_search(m, ["name", "description"], "kim|seoul$")
    assert sorted(r.user_no for r in got.collect()) == [1, 2]
    assert filters.text_search(m, ["name"], "").count() == 3


def test_month_filter_whole_month_and_all(spark):
    a = act(spark, [(1, D(2001, 6, 30)), (2, D(2001, 7, 1)), (3, D(2001, 7, 31)), (4, D(2001, 8, 1))])
    assert sorted(r.event_id for r in filters.month_filter(a, "2001-07").collect()) == [2, 3]
    assert filters.month_filter(a, "all").count() == 4


def test_facet_values_distinct_non_null(spark):
    m = mem(spark, [(1, "a", 1970, "M", "X", None), (2, "b", 1970, "M", None, "staff")])
    got = rows(filters.facet_values(m, {"birth_year": F.col("birth_year"), "area": F.col("area"),
                                       "role": F.col("role")}), "facet", "value")
    assert got == [("area", "X"), ("birth_year", "1970"), ("role", "staff")]


def test_labels_blank_is_missing(spark):
    m = mem(spark, [(7, "", 1985, "M", "", "member", 1, None, ""),
                    (8, "Kim", None, "M", None, "member", 1, None, "http://img/8")])
    got = {r.user_no: (r.label, r.image_url) for r in filters.display_labels(m).collect()}
    assert got[7] == ("85/7/미상", L.AVATAR_URL_PREFIX + "Host" + L.AVATAR_URL_SUFFIX)
    assert got[8] == ("??/Kim/미상", "http://img/8")


def test_match_counts_one_pass(spark):
    m = mem(spark, [(1, "a", 1970, "M", "X", "member"), (2, "b", 1971, "M", "X", "staff")])
    r = filters.match_counts(m, F.col("birth_year") == 1970).collect()[0]
    assert (r.matched, r.total) == (1, 2)


# --- joins ---------------------------------------------------------------------

def test_upcoming_badges_and_host_fallbacks(spark):
    a = act(spark, [(1, D(2001, 7, 15), "A", 10), (2, D(2001, 7, 17), "B", 99), (3, D(2001, 7, 30), "C", None),
                    (4, D(2001, 8, 30), "D", 10), (5, D(2001, 7, 1), "old", 10)])
    m = mem(spark, [(10, "Host", 1975, "M", "", "member")])
    got = rows(joins.upcoming_with_host(a, m, AS_OF, 3), "date")
    assert [(r[0], r[4], r[5], r[6], r[7]) for r in got] == [
        (1, 0, "D-Day", True, "75/Host/미상"),
        (2, 2, "D-2", True, "??/99/미상"),
        (3, 15, "D-15", False, "??//미상"),
    ]


def test_birth_year_attendance_null_year_matches_null_year(spark):
    m = mem(spark, [(1, "a", None, "M", "X", "member"), (2, "b", 1955, "M", "X", "member"),
                    (3, "c", 1960, "M", "X", "member"), (4, "d", None, "M", "X", "exmember")])
    a = act(spark, [(100, D(2001, 7, 3)), (101, D(2001, 6, 3))])
    at = att(spark, [(100, 1), (100, 1), (100, 4), (100, 2), (101, 3)])
    got = {r.birth_year: (r.label, r.cnt, r.total) for r in
           joins.birth_year_attendance(m, a, at, "2001-07").collect()}
    # NULL year: members 1 and 4 (ex-member counted because the year exists), distinct
    assert got == {None: ("0년", 2, 3), 1955: ("55년", 1, 3), 1960: ("60년", 0, 3)}


def test_area_geo_first_contained_key_exact_wins(spark):
    dim = spark.createDataFrame([(0, "NATION_2", 1.0, 1.0), (1, "NATION_10", 2.0, 2.0),
                                 (2, "NATION_1", 3.0, 3.0), (3, "NATION_23", 4.0, 4.0)],
                                "ord int, area_key string, lat double, lon double")
    s = spark.createDataFrame([("NATION_21",), ("NATION_12",), ("NATION_23",), ("NATION_3",), ("",),
                               (None,), ("NATION_10",)], "area string")
    got = {r.area: (r["count"], r.lat) for r in joins.area_geo(s, dim, (9.0, 9.0)).collect()}
    assert got == {"NATION_21": (1, 1.0), "NATION_12": (1, 3.0), "NATION_23": (1, 4.0),
                   "NATION_3": (1, 9.0), "": (1, 9.0), "NATION_10": (1, 2.0)}


def test_area_geo_fixed_dimension_order(spark):
    from ridgeline.plans.catalog import geo_dimension
    s = spark.createDataFrame([("서울관악",), ("성남시 분당구",), ("관악구",), ("부산",)], "area string")
    got = {r.area: (r.lat, r.lon) for r in joins.area_geo(s, geo_dimension(spark)).collect()}
    assert got["서울관악"] == (37.4782, 126.9515)      # exact key beats the earlier '서울'
    assert got["성남시 분당구"] == (37.4200, 127.1265)  # '성남' is listed before '분당'
    assert got["관악구"] == (37.4782, 126.9515)
    assert got["부산"] == L.DEFAULT_COORD


def test_label_to_key_first_in_roster_order(spark):
    lab = spark.createDataFrame([("L", 5, 1980, "b"), ("L", 3, None, "a"), ("L", 9, 1980, "a"),
                                 ("M", 1, None, None)],
                                "label string, user_no long, birth_year int, name string")
    got = dict((r.label, r.user_no) for r in
               joins.label_to_key(lab, "label", "user_no", joins.roster_order()).collect())
    assert got == {"L": 9, "M": 1}


def test_event_label_resolves_to_first_in_newest_first_list(spark):
    from ridgeline.functions import expr as X

    a = act(spark, [(7, D(2001, 7, 1), "Hill"), (5, D(2001, 7, 1), "Hill"), (9, D(2001, 6, 1), "Hill"),
                    (3, None, "Hill"), (4, None, "Hill")])
    lab = a.withColumn("label", X.event_label(F.col("date"), F.col("title")))
    got = dict(rows(joins.label_to_key(lab, "label", "event_id", joins.newest_first_order())))
    assert got == {"2001-07-01 | Hill": 5, "2001-06-01 | Hill": 9, "None | Hill": 3}


def test_event_host_label_text_keys(spark):
    a = act(spark, [(1, D(2001, 1, 1), "A", 10), (2, D(2001, 1, 1), "B", 11), (3, D(2001, 1, 1), "C", None)])
    m = mem(spark, [(10, "Kim", 1980, "M", "X", "member"), (11, "Lee", 1980, "M", "X", "exmember")])
    got = dict((r.event_id, r.host_label) for r in joins.event_host_label(a, m).collect())
    assert got == {1: "1980/Kim/X", 2: None, 3: None}


# --- aggregations ------------------------------------------------------------------

def test_gender_normalisation_and_distribution(spark):
    m = mem(spark, [(1, "a", 1970, " male ", "X", "member"), (2, "b", 1970, "여성", "X", "member"),
                    (3, "c", 1971, "\tw\n", "X", "member"), (4, "d", None, None, "X", "member"),
                    (5, "e", 1971, "x", "X", "member"), (6, "f", 1971, "M", "X", "exmember")])
    g = {r.gender: (r.n, r.pct) for r in aggs.gender_distribution(m).collect()}
    assert g == {"M": (1, 20.0), "F": (2, 40.0), "U": (2, 40.0)}
    by = {r.birth_year: (r.m_count, r.f_count, r.u_count, r.total, r.size_ratio)
          for r in aggs.birth_year_gender(m).collect()}
    assert by == {1970: (1, 1, 0, 2, 1.0), 1971: (0, 1, 1, 2, 1.0)}
    # A2's total plus the NULL-year current members equals A3's total
    assert sum(v[3] for v in by.values()) + 1 == sum(v[0] for v in g.values())


def test_group_by_keeps_null_group(spark):
    m = mem(spark, [(1, "a", 1970, "M", None, None), (2, "b", 1970, "M", None, "staff")])
    assert dict((r.role, r.cnt) for r in aggs.role_counts(m).collect()) == {None: 1, "staff": 1}
    assert rows(aggs.area_counts(m, 10)) == [(None, 2)]


def test_annual_stats_ties_and_empty(spark):
    a = act(spark, [(1, D(2001, 5, 2)), (2, D(2001, 5, 3)), (3, D(2001, 6, 1)), (4, D(2001, 6, 2)),
                    (5, D(2001, 3, 1)), (6, D(2001, 7, 1)), (7, D(2001, 7, 20)), (8, D(2000, 7, 31))])
    r = aggs.annual_stats(a, AS_OF).collect()[0]
    assert (r.peak_month, r.peak_cnt, r.low_month, r.low_cnt, r.current_cnt) == ("2001-06", 2, "2001-03", 1, 1)
    assert r.avg_cnt == pytest.approx(6 / 4)
    e = aggs.annual_stats(a.filter("false"), AS_OF).collect()
    assert [(x.avg_cnt, x.peak_month, x.peak_cnt, x.low_month, x.current_cnt) for x in e] == [(0.0, None, 0, None, 0)]


def test_display_text_rounds_half_even_and_groups_thousands(spark):
    # monthly counts 1, 1, 1, 2 -> mean 1.25 -> '1.2' (Python's '{:.1f}'); 1, 2, 2, 2 -> '1.8'
    a = act(spark, [(1, D(2001, 3, 1)), (2, D(2001, 4, 1)), (3, D(2001, 5, 1)), (4, D(2001, 6, 1)), (5, D(2001, 6, 2))])
    assert aggs.annual_stats(a, AS_OF).collect()[0].avg_text == f"{1.25:.1f}" == "1.2"
    b = a.unionByName(act(spark, [(6, D(2001, 4, 2)), (7, D(2001, 5, 2))])).filter("event_id <> 1")
    b = b.unionByName(act(spark, [(8, D(2001, 3, 5))]))
    assert aggs.annual_stats(b, AS_OF).collect()[0].avg_text == f"{1.75:.1f}" == "1.8"
    m = spark.createDataFrame([(1, "member", 1234567)], "user_no long, role string, point int")
    at = spark.createDataFrame([], "event_id long, user_no long")
    assert aggs.member_kpi(m, a.select("event_id", "date", "score"), at, AS_OF).collect()[0].total_points_text \
        == f"{1234567:,}"


def test_monthly_trend_window_and_ratio(spark):
    a = act(spark, [(1, D(2001, 2, 28)), (2, D(2001, 3, 1)), (3, D(2001, 3, 2)), (4, D(2001, 7, 15)),
                    (5, D(2001, 7, 16))])
    got = rows(aggs.monthly_trend(a, AS_OF, 5), "month")
    assert got == [("2001-03", 2, 1.0), ("2001-07", 1, 0.5)]


def test_member_kpi(spark):
    m = mem(spark, [(1, "a", 1970, "M", "X", "member", 10), (2, "b", 1970, "M", "X", "exmember", 5),
                    (3, "c", 1970, "M", "X", None, 7)])
    a = act(spark, [(100, D(2001, 7, 1), "t", None, 3), (101, D(2001, 1, 1), "t", None, 4),
                    (102, D(2002, 1, 1), "t", None, None)])
    at = att(spark, [(100, 1), (100, 999), (101, 2), (102, 1), (555, 1)])
    r = aggs.member_kpi(m, a, at, AS_OF).collect()[0]
    # count: only role 'member'; points 10 + (3 + 3 + 4) incl. the orphan user 999; active: 1, 999
    assert (r.total_members, r.total_points, r.active_count) == (1, 20, 2)


def test_top_hosts_group_by_name_and_image(spark):
    m = mem(spark, [(1, "Kim", 1970, "M", "X", "member", 1, None, "i"), (5, "Kim", 1971, "M", "X", "member", 1, None, "i"),
                    (2, "Lee", 1970, "M", "X", "member", 1, None, None), (3, "Ann", 1970, "M", "X", "member")])
    a = act(spark, [(10, D(2001, 7, 1), "t", 1), (11, D(2001, 7, 2), "t", 5), (12, D(2001, 7, 3), "t", 2),
                    (13, D(2001, 7, 4), "t", 3), (14, D(2001, 6, 4), "t", 2), (15, D(2001, 7, 9), "t", 2)])
    got = rows(aggs.top_hosts(a, m, "2001-07", 3))
    assert got == [("Kim", "i", 2), ("Lee", None, 2), ("Ann", None, 1)]


def test_first_attendance_filter_on_aggregate(spark):
    m = mem(spark, [(1, "a", 1970, "M", "X", "member"), (2, "b", 1970, "M", "X", "member")])
    a = act(spark, [(10, D(2001, 6, 1)), (11, D(2001, 7, 2)), (12, D(2001, 7, 9))])
    at = att(spark, [(10, 1), (11, 1), (11, 2), (12, 2)])
    assert rows(aggs.first_attendance(a, at, m, "2001-07")) == [(2, "b", D(2001, 7, 2))]


def test_ranked_boards(spark):
    m = mem(spark, [(1, "Kim", 1970, "M", "X", "member", 1, None, "")])
    a = act(spark, [(10, D(2001, 7, 1), "Hill", 1, 2)])
    at = att(spark, [(10, 1), (10, 1)])
    got = rows(aggs.ranked_boards(a, at, m, "2001-07", 3), "board")
    assert got == [("activities", 1, "Hill", 2, None, "gold"),
                   ("attendees", 1, "Kim", 4, L.AVATAR_URL_PREFIX + "Kim" + L.AVATAR_URL_SUFFIX, "gold"),
                   ("hosts", 1, "Kim", 1, L.AVATAR_URL_PREFIX + "Kim" + L.AVATAR_URL_SUFFIX, "gold")]


# --- summary / report ------------------------------------------------------------------

def _club(spark):
    m = mem(spark, [
        (1, "Kim", 1975, "M", "Seoul", "member", 25, None, None, D(2000, 1, 1)),
        (2, "Lee", None, "F", None, "member", 0, None, None, D(2001, 7, 1)),     # new, never came
        (3, "Park", 1980, "F", "Busan", "staff", 0, None, None, D(2000, 1, 1)),  # never came -> warn
        (4, "Choi", 1982, "M", "Seoul", "member", 5, None, None, D(2000, 1, 1)),  # dormant
        (5, "Ex", 1960, "M", "Seoul", "exmember", 99, None, None, D(2000, 1, 1)),
    ])
    a = act(spark, [(10, D(2001, 7, 3), "Hill", 1, 5, "https://a/10/"),
                    (11, D(2001, 7, 10), "Hill", 1, 3, ""),
                    (12, D(2001, 1, 10), "Old", 4, 2, None)])
    at = att(spark, [(10, 1), (10, 4), (11, 1), (12, 4)])
    return m, a, at


def test_member_summary_statuses(spark):
    m, a, at = _club(spark)
    s = {r.user_no: (r.member_label, r.status, r.gained_score, r.current_point)
         for r in member_summary(m, a, at, AS_OF).collect()}
    assert s == {1: ("75/Kim/Seoul", "active", 8, 33), 2: ("??/Lee/미상", "new", 0, 0),
                 3: ("80/Park/Busan", "new_warn", 0, 0), 4: ("82/Choi/Seoul", "active", 5, 12),
                 5: ("60/Ex/Seoul", "exmember", 0, 99)}


def test_milestones_multiple_thresholds(spark):
    s = spark.createDataFrame([(1, "x", 120, 95), (2, "y", 30, 0), (3, "z", None, None)],
                              "user_no long, member_label string, current_point long, gained_score long")
    got = rows(report.milestones(s), "user_no", F.col("threshold").desc())
    assert [(r[0], r[3]) for r in got] == [(1, 100), (1, 50), (1, 30)]
    assert got[0][5] == "✨ x (120점) 💯 특별시상"


def test_report_text_matches_original_layout(spark, tmp_path):
    m, a, at = _club(spark)
    s = member_summary(m, a, at, AS_OF)
    lines = report.report_lines(s, a, at, m, "2001-07", rules="R", club="C")
    text = "".join(r.line for r in lines.orderBy("section", "part", "k1", "k2", "k3").collect())
    sp = "  "
    expected = (
        f"🔗 C 회칙 안내{sp}\nR{sp}\n\n⛰️ 2001-07 활동 요약 보고서{sp}\n────────────────{sp}\n\n"
        f"📅 [이달의 산행 기록]{sp}\n"
        f"📍 2001-07-03 | Hill{sp}\n└ 참석(2명): Kim, Choi{sp}\n└ 📸 사진첩: https://a/10/{sp}\n\n"
        f"📍 2001-07-10 | Hill{sp}\n└ 참석(1명): Kim{sp}\n\n"
        f"🏆 [이달의 시상 현황]{sp}\n✨ 75/Kim/Seoul (33점) 🎫 30점 돌파{sp}\n"
        f"✨ 82/Choi/Seoul (12점) 🎫 10점 돌파{sp}\n\n"
        f"🎉 [첫 참석을 반겨요]{sp}\n🎊 Kim님 (첫 참석 환영합니다!){sp}\n\n"
        f"🚨 [활동 관리 안내]{sp}\n"
        f"😴 장기 미참석(경고):{sp}\n없음{sp}\n"
        f"🌱 신입 미참석(경고):{sp}\n80/Park/Busan{sp}\n\n"
        f"🔢 [전체 회원 누적 점수 현황]{sp}\n| 회원명 | 이번달 점수 | 누적 점수 | 상태 |{sp}\n"
        f"| :--- | ---: | ---: | :---: |{sp}\n"
        f"| 75/Kim/Seoul | 8점 | 33점 | active |{sp}\n| 80/Park/Busan | 0점 | 0점 | new_warn |{sp}\n"
        f"| 82/Choi/Seoul | 5점 | 12점 | active |{sp}\n| ??/Lee/미상 | 0점 | 0점 | new |{sp}\n"
        f"\n────────────────{sp}\n건강하게 다음 산행에서 뵙겠습니다! ⛰️"
    )
    assert text == expected
    out = str(tmp_path / "report")
    report.write_report(lines, out)
    import glob

    import pyarrow.parquet as pq
    parts = sorted(glob.glob(out + "/part-*.parquet"))
    written = "".join(x for p in parts for x in pq.read_table(p, columns=["line"]).column("line").to_pylist())
    assert written == expected


def test_report_same_day_activities_follow_their_first_attendee(spark):
    m, _, _ = _club(spark)
    a = act(spark, [(20, D(2001, 7, 5), "Alpha", 1, 1, None), (21, D(2001, 7, 5), "Beta", 1, 1, None),
                    (22, D(2001, 7, 5), "Gamma", 1, 1, None)])
    # Alpha's first attendee is Choi (1982), Beta's is Kim (1975), Gamma's Park (1980):
    # rows sorted by (date, birth_year, name) meet Beta, then Gamma, then Alpha.
    at = att(spark, [(20, 4), (21, 1), (21, 4), (22, 3)])
    s = member_summary(m, a, at, AS_OF)
    text = "".join(r.line for r in report.report_lines(s, a, at, m, "2001-07")
                   .orderBy("section", "part", "k1", "k2", "k3").collect())
    assert text.index("| Beta") < text.index("| Gamma") < text.index("| Alpha")


def test_report_markup_keeps_emphasis(spark):
    m, a, at = _club(spark)
    s = member_summary(m, a, at, AS_OF)
    order = ("section", "part", "k1", "k2", "k3")
    marked = "".join(r.line for r in report.report_lines(s, a, at, m, "2001-07", plain=False)
                     .orderBy(*order).collect())
    plain = "".join(r.line for r in report.report_lines(s, a, at, m, "2001-07").orderBy(*order).collect())
    assert marked.startswith("🔗 **산악회 회칙 안내**") and "**" not in plain
    assert marked.replace("**", "") == plain


def test_report_empty_month(spark):
    m, a, at = _club(spark)
    s = member_summary(m, a, at, AS_OF)
    lines = report.report_lines(s, a, at, m, "1999-01", rules="R", club="C", plain=False)
    text = "".join(r.line for r in lines.orderBy("section", "part", "k1", "k2", "k3").collect())
    assert "📅 **[이달의 산행 기록]**  \n활동 내역 없음  \n\n🏆" in text
    assert "😴 **장기 미참석(경고)**:  \n없음  \n🌱 **신입 미참석(경고)**:  \n80/Park/Busan  \n\n" in text


def test_activity_digest_multiplicity_and_first_album(spark):
    m, a, at = _club(spark)
    at2 = at.unionByName(att(spark, [(10, 1)]))
    got = rows(report.activity_digest(a, at2, m, "2001-07"), "date", "name")
    assert got == [(D(2001, 7, 3), "Hill", 3, "https://a/10/", 1982, "Choi", 1),
                   (D(2001, 7, 3), "Hill", 3, "https://a/10/", 1975, "Kim", 2),
                   (D(2001, 7, 10), "Hill", 1, "", 1975, "Kim", 1)]


def test_briefing_first_three_per_month(spark):
    a = act(spark, [(i, D(2001, 7, 20 - i), f"T{i}", i) for i in range(1, 6)] + [(9, D(2001, 8, 1), "A", None)])
    got = dict((r.month, r.text) for r in report.briefing_context(a, 3).collect())
    assert got["2001-07"] == ("현재 날짜: 2001-07-01\n- 일정: T5 (2001-07-15), 담당: 5\n"
                              "- 일정: T4 (2001-07-16), 담당: 4\n- 일정: T3 (2001-07-17), 담당: 3\n")
    assert got["2001-08"] == "현재 날짜: 2001-08-01\n- 일정: A (2001-08-01), 담당: None\n"


# --- writes ---------------------------------------------------------------------------------

def _members_base(spark):
    return mem(spark, [(1, "a", 1970, "M", "X", "member"), (2, "b", 1970, "M", "X", "member"),
                       (3, "c", 1970, "M", "Y", "member")])


def test_removed_keys_and_delete_only_visible(spark):
    base = _members_base(spark)
    visible = base.filter("area = 'X'")
    edited = visible.filter("user_no = 1")
    assert rows(writes.removed_keys(visible, edited, "user_no")) == [("2",)]
    left = sorted(r.user_no for r in writes.delete_removed(base, visible, edited, "user_no").collect())
    assert left == [1, 3]  # 3 was never visible, so it is not deleted


def test_upsert_last_wins_and_idempotent(spark):
    base = _members_base(spark)
    e = (base.filter("user_no = 1").withColumn("name", F.lit("first")).withColumn("seq", F.lit(1))
         .unionByName(base.filter("user_no = 1").withColumn("name", F.lit("second")).withColumn("seq", F.lit(2)))
         .unionByName(base.filter("user_no = 3").withColumn("user_no", F.lit(4).cast("long")).withColumn("seq", F.lit(1))))
    once = writes.upsert_rows(base, e, "user_no", "seq")
    assert dict((r.user_no, r.name) for r in once.collect()) == {1: "second", 2: "b", 3: "c", 4: "c"}
    twice = writes.upsert_rows(once, e, "user_no", "seq")
    assert sorted(map(tuple, once.collect())) == sorted(map(tuple, twice.collect()))


def test_replace_attendance_per_event(spark):
    at = att(spark, [(10, 1), (10, 2), (11, 1), (12, 3)])
    batch = spark.createDataFrame([(10,), (11,)], "event_id long")
    sel = spark.createDataFrame([(10, 5), (10, 5), (99, 7)], "event_id long, user_no long")
    got = sorted(map(tuple, writes.replace_attendance(at, batch, sel).collect()))
    assert got == [(10, 5), (12, 3)]  # 11 cleared, 12 untouched, 99 not in batch


def test_extract_event_id_rules(spark):
    t = spark.createDataFrame([
        ("", "https://x/post/123/"), ("", " https://x/post/45 "), ("", "album77"), ("", "https://x/none"),
        (" 9 ", "https://x/post/1/"), (None, None), ("", "\thttps://x/8/\n"), ("", "a/12/b34"),
    ], "event_id string, album_url string")
    got = [r.event_id for r in writes.extract_event_id(t).collect()]
    assert got == ["123", "45", "77", "", "9", "", "8", "34"]


def test_apply_grid_edits_blank_id_loses_attendance(spark):
    a = act(spark, [(10, D(2001, 7, 1), "A", None, 1, "https://x/post/10/"), (11, D(2001, 7, 2), "B"),
                    (12, D(2001, 6, 2), "C")])
    at = att(spark, [(10, 1), (11, 1), (12, 1)])
    visible = a.filter("date >= '2001-07-01'").withColumn("event_id", F.col("event_id").cast("string"))
    edited = (visible.withColumn("event_id", F.when(F.col("event_id") == "10", "").otherwise(F.col("event_id")))
              .filter("title <> 'B'").withColumn("seq", F.lit(1)))
    acts, new_at = writes.apply_grid_edits(a, at, visible, edited)
    assert sorted(r.event_id for r in acts.collect()) == ["10", "12"]
    assert sorted(map(tuple, new_at.collect())) == [(12, 1)]  # 10's attendance lost (T15), 11 cascaded


def test_grid_ids_compare_untrimmed_but_repair_strips(spark):
    a = act(spark, [(9, D(2001, 7, 1), "A", None, 1, None), (10, D(2001, 7, 2), "B")])
    at = att(spark, [(9, 1), (10, 2)])
    visible = a.withColumn("event_id", F.col("event_id").cast("string"))
    edited = visible.withColumn("event_id", F.when(F.col("event_id") == "9", " 9 ").otherwise(F.col("event_id"))
                                ).withColumn("seq", F.lit(1))
    assert rows(writes.removed_keys(visible, edited, "event_id")) == [("9",)]
    acts, new_at = writes.apply_grid_edits(a, at, visible, edited)
    assert sorted(r.event_id for r in acts.collect()) == ["10", "9"]  # re-inserted under the stripped id
    assert sorted(map(tuple, new_at.collect())) == [(10, 2)]  # but its attendance went with the delete


# --- feeds -----------------------------------------------------------------------------------------

def test_forecast_rows_classes_and_truncation(spark):
    import json
    days = [f"2024-01-{d:02d}" for d in range(1, 9)]
    payload = json.dumps({"daily": {"time": days, "weather_code": [0, 2, 45, 56, 71, 96, 80, 1],
                                    "temperature_2m_max": [1.9, -3.7, 2, 3, 4, 5, 6, 7],
                                    "temperature_2m_min": [-0.5, -9.99, 0, 0, 0, 0, 0, 0]}})
    p = spark.createDataFrame([("seoul", "2024-01", payload)], "location string, month string, payload string")
    got = rows(feeds.forecast_rows(p), "pos")
    assert len(got) == 7
    assert [r[5] for r in got] == [L.SKY_CLEAR, L.SKY_CLOUDY, L.SKY_FOG, L.SKY_OTHER, L.SKY_SNOW, L.SKY_STORM,
                                   L.SKY_OTHER]
    assert got[0][2:5] == (0, "01/01", "월") and got[1][6:8] == (-3, -9)


def test_csv_round_trip_keeps_blank_and_null(spark, tmp_path):
    m = mem(spark, [(1, " a ", None, "M", "", None, 1, None, "")])
    path = str(tmp_path / "csv")
    feeds.export_csv(m, path, preferred=L.MEMBER_COLUMN_ORDER)
    back = feeds.read_csv(spark, path, MEMBERS_SCHEMA, preferred=L.MEMBER_COLUMN_ORDER)
    r = back.collect()[0]
    assert (r.name, r.birth_year, r.area, r.role, r.profile_image_url) == (" a ", None, "", None, "")
    assert spark.read.option("header", True).csv(path).columns[:3] == ["birth_year", "name", "area"]


def test_activity_csv_in_grid_order(spark, tmp_path):
    a = act(spark, [(7, D(2001, 7, 1), "Hill", None, 2, " https://a/7 ")])
    path = str(tmp_path / "acts")
    feeds.export_csv(a, path, preferred=L.ACTIVITY_COLUMN_ORDER)
    assert spark.read.option("header", True).csv(path).columns == \
        ["date", "title", "host", "event_id", "album_url", "score"]  # preferred present first, then the rest
    back = feeds.read_csv(spark, path, ACTIVITIES_SCHEMA, preferred=L.ACTIVITY_COLUMN_ORDER)
    assert [tuple(r) for r in back.collect()] == [(7, D(2001, 7, 1), "Hill", None, 2, " https://a/7 ")]


def test_json_rows_keep_nulls(spark):
    a = act(spark, [(1, D(2001, 7, 1), "A", None, 2, "")])
    assert feeds.json_rows(a).collect()[0].json == (
        '{"event_id":1,"date":"2001-07-01","title":"A","host":null,"score":2,"album_url":""}')


def test_ranks_beyond_the_medals_and_short_forecasts_give_null(spark):
    from ridgeline.sources import feeds

    a = act(spark, [(i, D(2001, 7, 1 + i), f"T{i}", 1, 1) for i in range(1, 6)])
    at = att(spark, [(i, 1) for i in range(1, 6)])
    m = mem(spark, [(1, "Kim", 1975, "M", "Seoul", "member", 0)])
    boards = aggs.ranked_boards(a, at, m, "2001-07", n=5).filter("board = 'activities'")
    assert [(r["rank"], r.medal) for r in boards.orderBy("rank").collect()][3:] == [(4, None), (5, None)]
    p = spark.createDataFrame([("x", "2001-07", '{"daily": {"time": ["2001-07-02", "2001-07-03"], '
                                '"weather_code": [0], "temperature_2m_max": [20.5], "temperature_2m_min": []}}')],
                              "location string, month string, payload string")
    got = [(r.pos, r.sky, r.t_max, r.t_min) for r in feeds.forecast_rows(p).orderBy("pos").collect()]
    assert got == [(0, L.SKY_CLEAR, 20, None), (1, L.SKY_OTHER, None, None)]  # a missing code: default class


def test_sql_param_binds_values(spark):
    a = act(spark, [(1, D(2001, 7, 1), "it's"), (2, D(2001, 8, 1), "x")])
    got = feeds.sql_param(spark, "SELECT event_id FROM rl_t WHERE title = ?", ["it's"], {"rl_t": a})
    assert [r.event_id for r in got.collect()] == [1]
