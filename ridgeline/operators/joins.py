"""J1–J7. (J8, the per-member summary, is in plans/summary.py.)"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import expr as X
from ..functions import lookups as L
from .filters import current_members, month_attendance, month_filter, next_activities


def upcoming_with_host(a: DataFrame, m: DataFrame, as_of, n: int = 3) -> DataFrame:
    """Next n activities with their host's label, badge and urgency.

    The top-n cut happens first (at most n rows, a proven bound), so the
    members table is only semi-joined against those n host keys while it is
    scanned — it is never shuffled or broadcast for the sake of three rows.
    """
    top = next_activities(a, as_of, n)
    hosts = m.join(F.broadcast(top.select(F.col("host").alias("_host"))),
                   F.col("user_no") == F.col("_host"), "left_semi")
    hosts = hosts.select(
        F.col("user_no").alias("_uid"), F.col("name").alias("host_name"),
        "birth_year", "area", "profile_image_url")
    # a key is unique among members, so at most n host rows come back
    j = top.join(F.broadcast(hosts), top["host"] == F.col("_uid"), "left")
    days = F.datediff(F.col("date"), X.as_date(as_of))
    return j.select(
        "event_id", "date", "title", "host",
        days.alias("days_to_go"),
        F.when(days > 0, F.concat(F.lit(L.BADGE_PREFIX), days.cast("string")))
        .otherwise(F.lit(L.BADGE_TODAY)).alias("badge"),
        (days <= L.URGENT_DAYS).alias("urgent"),
        X.member_label(F.col("birth_year"), F.col("host_name"), F.col("area"),
                       fallback_name=F.col("host")).alias("host_label"),
        X.avatar_url(F.col("profile_image_url"), F.col("host_name")).alias("image_url"),
    )


def activity_attendees(a: DataFrame, at: DataFrame, m: DataFrame, month: str, prune: bool = False) -> DataFrame:
    """One row per attendance record of the month, with member details.

    Listed by `attendee_order`; consumers that only aggregate skip the sort.
    `prune`: drop other months' records by a bitmap before they are shuffled
    (for plain attendance with a month too large to broadcast).
    """
    acts = month_filter(a, month).select("event_id", "date", "title", "album_url")
    j = month_attendance(at, month, acts if prune else None).join(acts, "event_id").join(m.select("user_no", "birth_year", "name"), "user_no")
    return j.select("event_id", "user_no", "date", "title", "album_url", "birth_year", "name")


def attendee_order() -> list[Column]:
    """The report's order of attendance rows: date, birth year, name, NULLs last."""
    return [F.col(c).asc_nulls_last() for c in ("date", "birth_year", "name")]


def birth_year_attendance(m: DataFrame, a: DataFrame, at: DataFrame, month: str) -> DataFrame:
    """J3 (+A15): distinct attendees of the month per birth year of current members.

    NULL year matches NULL year; a year without attendees shows 0. The total
    column is a window over the per-year result, whose size is bounded by the
    number of distinct birth years, not by the data.

    Plan: a member has one birth year, so distinct attendees per year are the
    month's distinct attendees (deduplicated first, combined map-side) joined
    to their year. Instead of a null-safe join of the year list with the
    counts, both are unioned and grouped once by year — GROUP BY already
    keeps NULL as its own group — and only the current members' years are
    kept. One aggregation, no join of the two small sides.
    """
    acts = month_filter(a, month).select("event_id")
    users = month_attendance(at, month).join(acts, "event_id", "left_semi").select("user_no").distinct()
    attended = users.join(m.select("user_no", "birth_year"), "user_no").select(
        "birth_year", F.lit(False).alias("_listed"), F.lit(1).alias("_one"))
    listed = current_members(m).select("birth_year", F.lit(True).alias("_listed"), F.lit(0).alias("_one"))
    per_year = (listed.unionByName(attended)
                .groupBy("birth_year")
                .agg(F.max("_listed").alias("_listed"), F.sum("_one").cast("bigint").alias("cnt"))
                .filter(F.col("_listed")))
    return per_year.select(
        "birth_year",
        F.concat(X.yy(F.col("birth_year"), missing="0"), F.lit(L.YEAR_SUFFIX)).alias("label"),
        "cnt",
        F.sum("cnt").over(Window.partitionBy()).cast("bigint").alias("total"),
    ).orderBy(F.col("birth_year").asc_nulls_last())


def attending_members(m: DataFrame, at: DataFrame, batch: DataFrame) -> DataFrame:
    """Current members with any attendance record in a batch of activities."""
    hits = at.join(batch.select("event_id"), "event_id", "left_semi").select("user_no")
    return current_members(m).join(hits, "user_no", "left_semi").select(
        "user_no", "birth_year", "name", "area")


def area_geo(summary: DataFrame, geo_dim: DataFrame, default: tuple[float, float] = L.DEFAULT_COORD) -> DataFrame:
    """Members per area and its coordinates.

    Lookup rule: the exact key, else the first key (dimension order `ord`)
    contained in the area name, else `default`. Areas are counted first (one
    shuffle, partial aggregation map-side); then every substring (up to the
    longest key's length) of each distinct area is equi-joined with the
    dimension keys (an inline literal, whose size the planner knows), so the
    containment test is a plain hash join — no nested-loop or cartesian join. The winner per area is a `min_by` over the
    rows of that area, which are still partitioned by area after the count,
    so it needs no second shuffle and no join back.
    """
    counts = (summary.filter(F.col("area").isNotNull())
              .groupBy("area").agg(F.count(F.lit(1)).cast("bigint").alias("count")))
    # Substrings longer than the longest key cannot match: the bound is a
    # scalar subquery over the dimension, evaluated once.
    longest = geo_dim.select(F.max(F.length("area_key"))).scalar()
    subs = F.expr("array_distinct(flatten(transform(sequence(1, length(area)), "
                  "i -> transform(sequence(1, least(length(area) - i + 1, _longest)), "
                  "l -> substring(area, i, l)))))")
    cand = (counts.withColumn("_longest", longest)
            .select("area", "count",
                    F.explode_outer(F.when(F.length("area") > 0, subs)).alias("_key")))
    dim = geo_dim.select(F.col("area_key").alias("_key"), "ord", "lat", "lon")
    order = F.when(F.col("ord").isNotNull(),
                   F.struct((F.col("_key") != F.col("area")).alias("_inexact"), F.col("ord")))
    best = (cand.join(dim, "_key", "left")
            .groupBy("area", "count")
            .agg(F.min_by(F.struct("lat", "lon"), order).alias("_c")))
    return best.select(
        "area", "count",
        F.coalesce(F.col("_c.lat"), F.lit(float(default[0]))).alias("lat"),
        F.coalesce(F.col("_c.lon"), F.lit(float(default[1]))).alias("lon"),
    )


def event_host_label(a: DataFrame, m: DataFrame) -> DataFrame:
    """Each activity's host among current members, keys compared as text."""
    cm = current_members(m).select(
        F.col("user_no").cast("string").alias("_uid"),
        X.option_label(F.col("birth_year"), F.col("name"), F.col("area")).alias("host_label"))
    j = a.select("event_id", "host").join(cm, F.col("host").cast("string") == F.col("_uid"), "left")
    return j.select("event_id", "host", "host_label")


def label_to_key(labeled: DataFrame, label: str, key: str, order: Sequence[Column]) -> DataFrame:
    """Resolve each label to the first key in `order` (duplicates -> first).

    ``min_by`` over an order struct is a partial aggregate, so a label shared
    by very many rows is combined map-side before the shuffle.
    """
    order_struct = F.struct(*order, F.col(key))
    return labeled.groupBy(label).agg(F.min_by(F.col(key), order_struct).alias(key))


def newest_first_order() -> list[Column]:
    """Date descending with NULLs last (the activity list's order), as struct fields for min_by."""
    return [F.col("date").isNull().alias("_nd"), (-F.unix_date(F.col("date"))).alias("_d")]


def roster_order() -> list[Column]:
    """(birth_year, name) ascending with NULLs last, as struct fields for min_by."""
    return [F.col("birth_year").isNull().alias("_ny"), F.col("birth_year").alias("_y"),
            F.col("name").isNull().alias("_nn"), F.col("name").alias("_n")]
