"""A1–A14 (aggregations) and N1 (ranked leaderboards)."""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import expr as X
from ..functions import lookups as L
from .filters import ACTIVITY_MONTH, current_members, month_attendance, month_filter


def _asof(as_of) -> _dt.date:
    return as_of if isinstance(as_of, _dt.date) else _dt.date.fromisoformat(str(as_of))


def _months_back(d: _dt.date, k: int) -> _dt.date:
    """First day of the month k months before d's month."""
    idx = d.year * 12 + (d.month - 1) - k
    return _dt.date(idx // 12, idx % 12 + 1, 1)


def member_kpi(m: DataFrame, a: DataFrame, at: DataFrame, as_of) -> DataFrame:
    """A1: current-member count, recently active members, total points (also as
    text with thousands separators, as the dashboard card shows it).

    * total points = Σ point of current members + Σ score over every
      attendance record joined to its activity (orphaned members included).
    * active = distinct attendees of activities dated on/after as_of - 90 days.

    Plan: attendance meets its activities once and is reduced per member to the
    sum of scores and the latest date (partial aggregation absorbs hot members).
    A member is active when the latest date is recent, so no distinct count and
    no second scan is needed. Both parts are unioned and reduced by one global
    aggregate.
    """
    asof = _asof(as_of)
    since = F.lit(asof - _dt.timedelta(days=L.ACTIVE_WINDOW_DAYS))
    per_user = (at.join(a.select("event_id", "date", "score"), "event_id")
                .groupBy("user_no").agg(F.sum("score").alias("_v"), F.max("date").alias("_last"))
                .select(F.lit(1).alias("_kind"), "_v", ((F.col("_last") >= since) & F.col("user_no").isNotNull()).alias("_active")))
    mem = current_members(m).select(F.lit(0).alias("_kind"), F.col("point").cast("long").alias("_v"), F.lit(False).alias("_active"))
    agg = mem.unionByName(per_user).agg(
        F.count_if(F.col("_kind") == 0).cast("bigint").alias("total_members"),
        F.count_if("_active").cast("bigint").alias("active_count"),
        F.coalesce(F.sum("_v"), F.lit(0)).cast("bigint").alias("total_points"))
    return agg.select("total_members", "active_count", "total_points",
                      F.format_number("total_points", 0).alias("total_points_text"))


def birth_year_gender(m: DataFrame) -> DataFrame:
    """A2: per birth year (NULL year dropped) counts of M / F / U, total, male %, size ratio.

    Conditional counts replace a pivot (one pass, no pivot-value discovery
    job). The size ratio divides by the largest total via a window over the
    per-year result, which is bounded by the number of distinct birth years.
    """
    g = X.norm_gender(F.col("gender"))
    cm = current_members(m).filter(F.col("birth_year").isNotNull()).select("birth_year", g.alias("g"))
    per = cm.groupBy("birth_year").agg(
        F.count_if(F.col("g") == "M").cast("bigint").alias("m_count"),
        F.count_if(F.col("g") == "F").cast("bigint").alias("f_count"),
        F.count_if(F.col("g") == "U").cast("bigint").alias("u_count"),
        F.count(F.lit(1)).cast("bigint").alias("total"),
    )
    mx = F.max("total").over(Window.partitionBy())
    return per.select(
        "birth_year", "m_count", "f_count", "u_count", "total",
        X.ratio(F.col("m_count") * 100, F.col("total")).alias("m_pct"),
        X.ratio(F.col("total"), mx).alias("size_ratio"),
    ).orderBy("birth_year")


def gender_distribution(m: DataFrame) -> DataFrame:
    """A3: M / F / U counts over all current members, %, and √n / √max(M, F)."""
    g = X.norm_gender(F.col("gender"))
    one = current_members(m).select(g.alias("g")).agg(
        F.count_if(F.col("g") == "M").cast("bigint").alias("M"),
        F.count_if(F.col("g") == "F").cast("bigint").alias("F"),
        F.count_if(F.col("g") == "U").cast("bigint").alias("U"),
        F.count(F.lit(1)).cast("bigint").alias("_total"),
    )
    rows = one.select(
        "_total", F.greatest("M", "F", F.lit(1)).alias("_mx"),
        F.expr("stack(3, 'M', M, 'F', F, 'U', U) AS (gender, n)"))
    return rows.select(
        "gender", "n",
        X.ratio(F.col("n") * 100, F.col("_total")).alias("pct"),
        F.round(F.sqrt(F.col("n")) / F.sqrt(F.col("_mx")), 6).alias("size_ratio"),
    )


def area_counts(m: DataFrame, n: int) -> DataFrame:
    """A4: members per area (NULL is a group), largest first, top n."""
    return (m.groupBy("area").agg(F.count(F.lit(1)).cast("bigint").alias("cnt"))
            .orderBy(F.col("cnt").desc(), F.col("area").asc_nulls_last())
            .limit(n))


def role_counts(m: DataFrame) -> DataFrame:
    """A5: members per role (NULL is a group)."""
    return m.groupBy("role").agg(F.count(F.lit(1)).cast("bigint").alias("cnt"))


def gender_raw_counts(m: DataFrame) -> DataFrame:
    """Members per raw gender text."""
    return m.groupBy("gender").agg(F.count(F.lit(1)).cast("bigint").alias("cnt"))


def _rows(weight: str | None) -> Column:
    """How many activities a group's rows stand for: one each, or (rows of a rollup) as many as `weight` says."""
    return (F.count(F.lit(1)) if weight is None else F.sum(weight)).cast("bigint")


def latest_months(a: DataFrame, n: int = 6, weight: str | None = None) -> DataFrame:
    """Activities per month, the newest n months that have rows.

    `a` may be a rollup (`rollup.read_rollup`) with its counts in `weight`; so it may for A8 and A9.
    """
    return (a.groupBy(X.month_text("date").alias("month"))
            .agg(_rows(weight).alias("cnt"))
            .orderBy(F.col("month").desc_nulls_last())
            .limit(n))


def monthly_trend(a: DataFrame, as_of, months: int = 5, weight: str | None = None) -> DataFrame:
    """Activities per month for the current and previous months-1 months, up to as_of.

    Empty months are absent. The window bounds are literals, so they reach
    the scan as pushed filters.
    """
    asof = _asof(as_of)
    lo = _months_back(asof, months - 1)
    per = (a.filter((F.col("date") >= F.lit(lo)) & (F.col("date") <= F.lit(asof)))
           .groupBy(X.month_text("date").alias("month"))
           .agg(_rows(weight).alias("count")))
    return per.select("month", "count",
                      X.ratio(F.col("count"), F.max("count").over(Window.partitionBy())).alias("ratio")).orderBy("month")


def annual_stats(a: DataFrame, as_of, weight: str | None = None) -> DataFrame:
    """12-month mean (also as one-decimal text), peak month (ties -> latest),
    low month (ties -> earliest), current month.

    Always one row: with no activities the counts are 0 and the months NULL.
    """
    asof = _asof(as_of)
    lo = _months_back(asof, 11)
    cur = X.month_of(asof)
    per = (a.filter((F.col("date") >= F.lit(lo)) & (F.col("date") <= F.lit(asof)))
           .groupBy(X.month_text("date").alias("month"))
           .agg(_rows(weight).alias("cnt")))
    agg = per.agg(
        F.avg("cnt").alias("_avg"),
        F.max(F.struct("cnt", "month")).alias("_peak"),
        F.min(F.struct("cnt", "month")).alias("_low"),
        F.sum(F.when(F.col("month") == cur, F.col("cnt")).otherwise(0)).alias("_cur"),
    )
    avg = F.coalesce(F.col("_avg"), F.lit(0.0))
    # One decimal, ties to even as Python's '{:.1f}': a mean of at most 12
    # integer counts ties only at x.25 / x.75, which are exact doubles.
    return agg.select(
        F.round(avg, 6).alias("avg_cnt"),
        F.format_string("%.1f", F.bround(avg, 1)).alias("avg_text"),
        F.col("_peak.month").alias("peak_month"),
        F.coalesce(F.col("_peak.cnt"), F.lit(0)).cast("bigint").alias("peak_cnt"),
        F.col("_low.month").alias("low_month"),
        F.coalesce(F.col("_low.cnt"), F.lit(0)).cast("bigint").alias("low_cnt"),
        F.coalesce(F.col("_cur"), F.lit(0)).cast("bigint").alias("current_cnt"),
    )


def top_hosts(a: DataFrame, m: DataFrame, month: str, n: int = 3) -> DataFrame:
    """A10: most activities hosted in the month, grouped by (name, image) — not by key.

    Hosted counts are combined per host key before the join (partial
    aggregation absorbs a very active host), then regrouped by display name.
    """
    per_host = (month_filter(a, month).groupBy("host")
                .agg(F.count(F.lit(1)).alias("_n")))
    j = per_host.join(m.select("user_no", "name", "profile_image_url"),
                      per_host["host"] == F.col("user_no"))
    g = j.groupBy("name", "profile_image_url").agg(F.sum("_n").cast("bigint").alias("cnt"))
    return (g.orderBy(F.col("cnt").desc(), F.col("name").asc_nulls_last(),
                      F.col("profile_image_url").asc_nulls_last())
            .limit(n))


def top_attendees(a: DataFrame, at: DataFrame, m: DataFrame, month: str, n: int = 3, prune: bool = False) -> DataFrame:
    """Highest Σ score of the month, grouped by (name, image). `prune`: see `joins.activity_attendees`."""
    acts = month_filter(a, month).select("event_id", "score")
    per_user = (month_attendance(at, month, acts if prune else None).join(acts, "event_id")
                .groupBy("user_no").agg(F.sum("score").alias("_s")))
    j = per_user.join(m.select("user_no", "name", "profile_image_url"), "user_no")
    g = j.groupBy("name", "profile_image_url").agg(F.sum("_s").cast("bigint").alias("score"))
    return (g.orderBy(F.col("score").desc_nulls_last(), F.col("name").asc_nulls_last(),
                      F.col("profile_image_url").asc_nulls_last())
            .limit(n))


def popular_activities(a: DataFrame, at: DataFrame, month: str, n: int = 3) -> DataFrame:
    """Titles of the month by number of attendance rows (not distinct people).

    Attendance is first counted per activity (partial aggregation combines a
    hot activity map-side, and the shuffle carries one row per activity and
    task instead of every record), so the join with the month's activities
    is one-to-one and cannot be skewed.
    """
    acts = month_filter(a, month).select("event_id", "title")
    per_event = month_attendance(at, month).groupBy("event_id").agg(F.count("user_no").alias("_n"))
    j = per_event.join(acts, "event_id")
    g = j.groupBy("title").agg(F.sum("_n").cast("bigint").alias("cnt"))
    return g.orderBy(F.col("cnt").desc(), F.col("title").asc_nulls_last()).limit(n)


def first_attendance(a: DataFrame, at: DataFrame, m: DataFrame, month: str) -> DataFrame:
    """Members whose first-ever attended activity falls in the month.

    The month test applies to the aggregate, so it stays above it; the
    earliest date is reduced per member before the member join.

    With month-partitioned attendance (`tables.save_attendance_by_month`) the
    big attendance ⋈ activities join is avoided: a member's first month is the
    smallest `activity_month` of their records (an aggregation over attendance
    alone, combined map-side), and only the members whose first month is
    `month` have that month's records (one month's files) joined with that
    month's activities for the exact first date.
    """
    if ACTIVITY_MONTH in at.columns:
        newcomers = (at.groupBy("user_no").agg(F.min(ACTIVITY_MONTH).alias("_m"))
                     .filter(F.col("_m") == F.lit(month)).select("user_no"))
        rows = month_attendance(at, month).join(newcomers, "user_no", "left_semi")
        first = (rows.join(month_filter(a, month).select("event_id", "date"), "event_id")
                 .groupBy("user_no").agg(F.min("date").alias("first_date")))
    else:
        first = (at.join(a.select("event_id", "date"), "event_id")
                 .groupBy("user_no").agg(F.min("date").alias("first_date")))
    j = first.join(m.select("user_no", "name"), "user_no")
    return j.filter(X.in_month(F.col("first_date"), month)).select("user_no", "name", "first_date")


def birth_years(m: DataFrame) -> DataFrame:
    """Distinct birth years of current members, NULL included and last."""
    return current_members(m).select("birth_year").distinct().orderBy(F.col("birth_year").asc_nulls_last())


def ranked_boards(a: DataFrame, at: DataFrame, m: DataFrame, month: str, n: int = 3) -> DataFrame:
    """The three leaderboards as one frame (board, rank, label, value, image_url, medal).

    Ranks are assigned after each board's top-n cut, so the window sees at
    most n rows per board.
    """
    hosts = top_hosts(a, m, month, n).select(
        F.lit("hosts").alias("board"), F.col("name").alias("label"), F.col("cnt").alias("value"),
        X.avatar_url(F.col("profile_image_url"), F.col("name"), L.BOARD_DEFAULT_NAME).alias("image_url"),
        F.col("profile_image_url").alias("_tie"))
    people = top_attendees(a, at, m, month, n).select(
        F.lit("attendees").alias("board"), F.col("name").alias("label"), F.col("score").alias("value"),
        X.avatar_url(F.col("profile_image_url"), F.col("name"), L.BOARD_DEFAULT_NAME).alias("image_url"),
        F.col("profile_image_url").alias("_tie"))
    events = popular_activities(a, at, month, n).select(
        F.lit("activities").alias("board"), F.col("title").alias("label"), F.col("cnt").alias("value"),
        F.lit(None).cast("string").alias("image_url"), F.lit(None).cast("string").alias("_tie"))
    u = hosts.unionByName(people).unionByName(events)
    w = Window.partitionBy("board").orderBy(F.col("value").desc_nulls_last(), F.col("label").asc_nulls_last(),
                                            F.col("_tie").asc_nulls_last())
    rank = F.row_number().over(w)
    medals = F.array(*[F.lit(x) for x in L.MEDALS])
    return u.select("board", rank.alias("rank"), "label", "value", "image_url",
                    F.try_element_at(medals, rank).alias("medal"))
