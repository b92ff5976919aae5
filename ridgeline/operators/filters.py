"""P1–P10 (projections, filters, predicates) and O1–O3 (sorted listings and the next-n top-n)."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import expr as X


def current_members(m: DataFrame) -> DataFrame:
    """SQL ``role <> 'exmember'`` — a NULL role is dropped too."""
    return m.filter(F.col("role") != F.lit("exmember"))


def non_ex_summary(summary: DataFrame) -> DataFrame:
    """Null-safe inequality on status — a NULL status is kept."""
    return summary.filter(~F.col("status").eqNullSafe(F.lit("exmember")))


def facet_filter(m: DataFrame, years: Iterable | None = None, areas: Iterable | None = None,
                 roles: Iterable | None = None) -> DataFrame:
    """AND of optional multi-selects; an empty choice means no filter, NULL never matches."""
    cond = F.lit(True)
    for col, values in (("birth_year", years), ("area", areas), ("role", roles)):
        values = list(values or [])
        if values:
            cond = cond & F.coalesce(F.col(col).isin(values), F.lit(False))
    return m.filter(cond)


def text_search(t: DataFrame, cols: Iterable[str], pattern: str | None) -> DataFrame:
    """Case-insensitive regex over any of `cols`; NULL counts as no match."""
    if not pattern:
        return t
    return t.filter(search_predicate(cols, pattern))


def search_predicate(cols: Iterable[str], pattern: str) -> Column:
    cond = F.lit(False)
    for c in cols:
        cond = cond | X.regex_search(F.col(c), pattern)
    return cond


def month_filter(a: DataFrame, month: str | None, date_col: str = "date") -> DataFrame:
    """P5: rows whose date falls in the 'YYYY-MM' month; None / 'all' = no filter."""
    if not month or month == "all":
        return a
    return a.filter(X.in_month(date_col, month))


ACTIVITY_MONTH = "activity_month"


def month_attendance(at: DataFrame, month: str | None, acts: DataFrame | None = None) -> DataFrame:
    """Attendance records that can belong to the month's activities.

    Attendance stored with its activity's month (`tables.save_attendance_by_month`)
    has an `activity_month` partition column: filtering it prunes the scan to
    one month's files before any join. Of plain attendance, a bitmap of the keys of
    `acts` (the month's activities) drops nearly all other records at the scan;
    without `acts` it is returned as it is. The exact join follows in any case.
    """
    if month and month != "all" and ACTIVITY_MONTH in at.columns:
        return at.filter(F.col(ACTIVITY_MONTH) == F.lit(month))
    return at if acts is None else prune_by_keys(at, acts)


# Bits of a bitmap row, and rows of the id bitmap: 256 rows of 4 KB, whatever the ids.
_BITMAP_BITS = 32768
BITMAP_ROWS = 256


def id_bitmap(keys: DataFrame, key: str = "event_id") -> DataFrame:
    """(row, bits): the hashes of the keys as bits of a table of at most `BITMAP_ROWS` x 4 KB."""
    place = F.pmod(F.xxhash64(key), F.lit(BITMAP_ROWS * _BITMAP_BITS))
    return (keys.select(F.floor(place / _BITMAP_BITS).cast("int").alias("row"), (place % _BITMAP_BITS).alias("_bit"))
            .groupBy("row").agg(F.bitmap_construct_agg("_bit").alias("bits")))


def prune_by_keys(rows: DataFrame, keys: DataFrame, key: str = "event_id") -> DataFrame:
    """Rows whose key may be among `keys`: all that are, and few others.

    The bitmap (1 MB at most, so it is broadcast) is tested where the rows are
    scanned, before any exchange; the exact join follows. With many more keys
    than bits it lets most rows through and changes nothing else. Rows without
    a key go. The keys must have the same type on both sides.
    """
    place = F.pmod(F.xxhash64(key), F.lit(BITMAP_ROWS * _BITMAP_BITS))
    marked = rows.withColumns({"_row": F.floor(place / _BITMAP_BITS).cast("int"), "_bit": (place % _BITMAP_BITS).cast("int")})
    found = marked.filter(F.col(key).isNotNull()).join(
        F.broadcast(id_bitmap(keys, key).withColumnRenamed("row", "_row").withColumnRenamed("bits", "_bits")), "_row")
    # bitmap_construct_agg sets bit (p % 8) of byte (p / 8)
    byte = F.conv(F.hex(F.expr("substring(_bits, _bit div 8 + 1, 1)")), 16, 10).cast("int")
    return found.filter(F.getbit(byte, F.col("_bit") % 8) == 1).select(*rows.columns)


def facet_values(t: DataFrame, facets: Mapping[str, Column]) -> DataFrame:
    """Distinct non-NULL value of each facet, as (facet, value) text rows, sorted as
    the pick lists show them: by value, months newest first."""
    pairs = F.array(*[
        F.struct(F.lit(name).alias("facet"), c.cast("string").alias("value"))
        for name, c in facets.items()
    ])
    return (t.select(F.explode(pairs).alias("p"))
            .select("p.facet", "p.value")
            .filter(F.col("value").isNotNull())
            .distinct()
            .orderBy("facet", F.when(F.col("facet") == "month", F.col("value")).desc(), "value"))


def display_labels(m: DataFrame) -> DataFrame:
    """P8: 'yy/name/area' label and image URL with their fallbacks."""
    return m.select(
        "user_no",
        X.member_label(F.col("birth_year"), F.col("name"), F.col("area"),
                       fallback_name=F.col("user_no")).alias("label"),
        X.avatar_url(F.col("profile_image_url"), F.col("name")).alias("image_url"),
    )


def match_counts(t: DataFrame, predicate: Column) -> DataFrame:
    """(matched, total) in a single pass."""
    return t.agg(
        F.count_if(F.coalesce(predicate, F.lit(False))).cast("bigint").alias("matched"),
        F.count(F.lit(1)).cast("bigint").alias("total"),
    )


def non_null_sample(t: DataFrame, col: str, n: int, order_by: Iterable[str]) -> DataFrame:
    """P10: first n rows with a non-NULL `col`, in a stated order (a sampling operator)."""
    return t.filter(F.col(col).isNotNull()).orderBy(*[F.col(c).asc_nulls_last() for c in order_by]).limit(n)


def _first(df: DataFrame, n: int | None) -> DataFrame:
    return df if n is None else df.limit(n)


def member_roster(m: DataFrame, n: int | None = None) -> DataFrame:
    """O1: current members by birth year then name (NULLs last); all of them
    (a range-partitioned global sort) unless a page size `n` is given."""
    return _first(current_members(m)
                  .orderBy(F.col("birth_year").asc_nulls_last(), F.col("name").asc_nulls_last(),
                           F.col("user_no").asc()), n).select("user_no", "birth_year", "name", "area")


def full_roster(m: DataFrame) -> DataFrame:
    """O1, the member page's list: every member (ex-members and NULL roles too) with all
    columns, by birth year then name, NULLs last."""
    return m.orderBy(F.col("birth_year").asc_nulls_last(), F.col("name").asc_nulls_last(), F.col("user_no").asc())


def recent_activities(a: DataFrame, n: int | None = None) -> DataFrame:
    """O2: newest activities first (ties by id); all of them unless `n` is given."""
    return _first(a.orderBy(F.col("date").desc_nulls_last(), F.col("event_id").asc()), n)


def next_activities(a: DataFrame, as_of, n: int = 3) -> DataFrame:
    """O3: the next n activities on or after as_of."""
    return (a.filter(F.col("date") >= X.as_date(as_of))
            .orderBy(F.col("date").asc(), F.col("event_id").asc())
            .limit(n))
