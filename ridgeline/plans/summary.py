"""The per-member attendance summary.

The original application reads a database view whose body is not available;
only its columns are known (label, status, this month's points, cumulative
points, area). This is our definition, kept in one place:

    att           = attendance ⋈ activities (scores and last date: date <= as_of)
    current_point = coalesce(point, 0) + coalesce(sum(score), 0)
    gained_score  = coalesce(sum(score) where date in month(as_of), 0)
    last_attended = max(date)
    first_date    = min(date) over the whole history (first-ever attendance)
    status        = 'exmember'     when role = 'exmember'
                    'new'          when never attended and created_at >= as_of - 30 days
                    'new_warn'     when never attended
                    'dormant_warn' when last_attended < as_of - 90 days
                    'active'       otherwise
    member_label  = yy(birth_year) / name / area

Plan: attendance is aggregated to one row per member *before* it meets the
members table (partial aggregation absorbs hot members and duplicate
records), so the final join is one-to-one on a unique key.
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import expr as X

NEW_MEMBER_DAYS = 30
DORMANT_DAYS = 90

SUMMARY_COLUMNS = [
    "user_no", "name", "birth_year", "area", "role", "member_label", "status",
    "gained_score", "current_point", "last_attended", "first_date",
]


def per_member_scores(a: DataFrame, at: DataFrame, as_of) -> DataFrame:
    """One pass over attendance ⋈ activities, reduced per member.

    Scores and the last date count only activities up to as_of; the first
    date is over the whole history (first-ever attendance).
    """
    asof = _dt.date.fromisoformat(str(as_of))
    att = at.join(a.select("event_id", "date", "score"), "event_id")
    upto = F.col("date") <= F.lit(asof)
    in_cur = upto & X.in_month(F.col("date"), X.month_of(asof))
    return att.groupBy("user_no").agg(
        F.sum(F.when(upto, F.col("score"))).alias("_total"),
        F.sum(F.when(in_cur, F.col("score"))).alias("_month"),
        F.max(F.when(upto, F.col("date"))).alias("last_attended"),
        F.min("date").alias("first_date"),
    )


def member_summary(m: DataFrame, a: DataFrame, at: DataFrame, as_of) -> DataFrame:
    return summary_of(m, per_member_scores(a, at, as_of), as_of)


def summary_of(m: DataFrame, scores: DataFrame, as_of) -> DataFrame:
    """The summary from figures per member (`per_member_scores`, or a state that `update_scores` keeps up to date)."""
    return summary_columns(m.join(scores, "user_no", "left"), as_of)


def summary_columns(j: DataFrame, as_of) -> DataFrame:
    """The summary from members that have met their figures."""
    asof = _dt.date.fromisoformat(str(as_of))
    last = F.col("last_attended")
    status = (
        F.when(F.col("role") == "exmember", F.lit("exmember"))
        .when(last.isNull() & (F.col("created_at") >= F.date_sub(F.lit(asof), NEW_MEMBER_DAYS)), F.lit("new"))
        .when(last.isNull(), F.lit("new_warn"))
        .when(last < F.date_sub(F.lit(asof), DORMANT_DAYS), F.lit("dormant_warn"))
        .otherwise(F.lit("active"))
    )
    return j.select(
        "user_no", "name", "birth_year", "area", "role",
        X.member_label(F.col("birth_year"), F.col("name"), F.col("area"),
                       fallback_name=F.col("user_no")).alias("member_label"),
        status.alias("status"),
        F.coalesce(F.col("_month"), F.lit(0)).cast("bigint").alias("gained_score"),
        (F.coalesce(F.col("point"), F.lit(0)) + F.coalesce(F.col("_total"), F.lit(0))).cast("bigint").alias("current_point"),
        last.alias("last_attended"),
        "first_date",
    )


def visits(a: DataFrame, at: DataFrame) -> DataFrame:
    """Attendance records with the date and score of their activity: the rows that the figures are made of."""
    return at.select("event_id", "user_no").join(a.select("event_id", "date", "score"), "event_id").select("user_no", "date", "score")


def score_state(a: DataFrame, at: DataFrame, as_of) -> DataFrame:
    """The figures per member as a state that can be stored and updated.

    Columns: those of `per_member_scores`, with sums of 0 instead of NULL, and
    `_n`, the member's records (a member without records has no row).
    """
    return _figures(visits(a, at), as_of)


def _figures(rows: DataFrame, as_of, sign: Column | None = None) -> DataFrame:
    asof = _dt.date.fromisoformat(str(as_of))
    one = F.lit(1) if sign is None else sign
    upto = F.col("date") <= F.lit(asof)
    in_cur = upto & X.in_month(F.col("date"), X.month_of(asof))
    score = one * F.coalesce(F.col("score"), F.lit(0))
    came = F.lit(True) if sign is None else one > 0
    figures = [
        F.sum(F.when(upto, score).otherwise(0)).cast("bigint").alias("_total"),
        F.sum(F.when(in_cur, score).otherwise(0)).cast("bigint").alias("_month"),
        F.max(F.when(upto & came, F.col("date"))).alias("last_attended"),
        F.min(F.when(came, F.col("date"))).alias("first_date"),
        F.sum(one).cast("bigint").alias("_n")]
    if sign is not None:
        figures += [F.max(F.when(upto & ~came, F.col("date"))).alias("_gone_last"), F.min(F.when(~came, F.col("date"))).alias("_gone_first")]
    return rows.groupBy("user_no").agg(*figures)


def update_scores(state: DataFrame, inserted: DataFrame, deleted: DataFrame, now: DataFrame, as_of) -> DataFrame:
    """The state after attendance changed, without going through all of it again.

    `inserted` and `deleted` are the visits that came and went (`visits` of the
    changed records; a changed activity's records are deleted as they were and
    inserted as they are), `now` all visits after the change. Both are multisets:
    a record that is there twice and goes once stays once.

    Sums and counts are merged by adding, and a new visit can only move the
    first and last date outwards. A deletion can move them inwards, but only if
    it takes a member's first or last date itself: for those members alone the
    dates are found again in `now`, by a semi-join before any grouping. Deletions
    are netted against insertions of the same member and date first, so that a
    replaced selection does not count as a deletion of those who stay.
    """
    signed = inserted.select("user_no", "date", "score", F.lit(1).alias("_sign")).unionByName(
        deleted.select("user_no", "date", "score", F.lit(-1).alias("_sign")))
    net = signed.groupBy("user_no", "date", "score").agg(F.sum("_sign").alias("_sign")).filter("_sign <> 0")
    # a date whose visits of one score went and of another came keeps its place among the dates
    change = _figures(net, as_of, F.col("_sign"))
    old, new = state.alias("s"), change.alias("c")
    both = old.join(new, F.col("s.user_no").eqNullSafe(F.col("c.user_no")), "full")
    add = lambda c: (F.coalesce(F.col(f"s.{c}"), F.lit(0)) + F.coalesce(F.col(f"c.{c}"), F.lit(0))).alias(c)
    again = (F.col("c._gone_last") >= F.col("s.last_attended")) | (F.col("c._gone_first") <= F.col("s.first_date"))
    merged = both.select(
        F.coalesce("s.user_no", "c.user_no").alias("user_no"), add("_total"), add("_month"),
        F.greatest("s.last_attended", "c.last_attended").alias("last_attended"),
        F.least("s.first_date", "c.first_date").alias("first_date"), add("_n"),
        F.coalesce(again, F.lit(False)).alias("_again")).filter("_n > 0")
    asof = _dt.date.fromisoformat(str(as_of))
    lost = merged.filter("_again").select(F.col("user_no").alias("_u"))
    dates = (now.join(lost, F.col("user_no").eqNullSafe(F.col("_u")), "left_semi").groupBy(F.col("user_no").alias("_u"))
             .agg(F.max(F.when(F.col("date") <= F.lit(asof), F.col("date"))).alias("_l"), F.min("date").alias("_f")))
    out = merged.join(dates, F.col("user_no").eqNullSafe(F.col("_u")), "left")
    return out.select("user_no", "_total", "_month", F.when(F.col("_again"), F.col("_l")).otherwise(F.col("last_attended")).alias("last_attended"),
                      F.when(F.col("_again"), F.col("_f")).otherwise(F.col("first_date")).alias("first_date"), "_n")
