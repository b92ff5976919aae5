"""Registered queries: name -> (spark, sf_dir) -> DataFrame.

Every query reads the driver's tables (through the derived entities), so its
work grows with them. Parameters are the fixed reference date and months of
the fixtures; no query filters rows to keep a check cheap.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import expr as X
from ..functions import lookups as L
from ..operators import aggs, filters, joins, report, rollup, trigrams, writes
from ..session import shared_dir
from ..sources import checked, feeds, tables, versions
from ..sources.tables import AS_OF, FIRST_MONTH, MONTH
from . import inputs
from .summary import member_summary, score_state, summary_of, update_scores, visits

Query = Callable[[SparkSession, str], DataFrame]

# Query parameters (shared with the oracle SQL).
FACET_YEARS = list(range(1960, 1970))
FACET_AREAS = ["NATION_1", "NATION_3", "NATION_7"]
FACET_ROLES = ["member", "staff"]
MEMBER_PATTERN = "member 1[0-9]7|household nation_2[0-9]"
TITLE_PATTERN = "route 3"
COUNT_PATTERN = "machinery|member [0-9]*5$"
RULES_LINK = "https://example.org/rules"
# (ord, area_key, lat, lon): keys chosen so that a short key listed first hides
# a longer one (NATION_2 inside NATION_21), an exact key beats an earlier
# contained one (NATION_23), and NATION_3 falls back to the default.
GEO_TEST_DIM = [(0, "NATION_2", 10.0, 20.0), (1, "NATION_10", 11.0, 21.0),
                (2, "NATION_1", 12.0, 22.0), (3, "NATION_23", 13.0, 23.0)]


def _club(spark: SparkSession, sf: str):
    c = tables.load_club(spark, sf)
    return c["members"], c["activities"], c["attendance"]


def _summary(spark: SparkSession, sf: str) -> DataFrame:
    m, a, at = _club(spark, sf)
    return member_summary(m, a, at, AS_OF)


def geo_dimension(spark: SparkSession, rows=None) -> DataFrame:
    """The fixed area lookup as an inline literal table: the planner knows its
    (tiny) size and broadcasts it instead of shuffling the area substrings."""
    rows = rows if rows is not None else [(i, k, la, lo) for i, (k, la, lo) in enumerate(L.AREA_COORDS)]
    entries = [F.struct(F.lit(o).cast("int").alias("ord"), F.lit(k).cast("string").alias("area_key"),
                        F.lit(la).cast("double").alias("lat"), F.lit(lo).cast("double").alias("lon"))
               for o, k, la, lo in rows]
    return spark.range(1).select(F.inline(F.array(*entries)))


# ---- sources ---------------------------------------------------------------

def q_load_tables(spark, sf):
    return tables.table_counts(tables.load_tables(spark, sf))


def q_sql_param(spark, sf):
    m, a, at = _club(spark, sf)
    first, nxt = X.month_bounds(MONTH)
    return feeds.sql_param(
        spark, "SELECT event_id, date, title FROM rl_activities WHERE date >= ? AND date < ?",
        args=[first, nxt], views={"rl_activities": a})


def q_export_csv(spark, sf):
    m, a, at = _club(spark, sf)
    path = shared_dir(spark, "export-members")
    feeds.export_csv(m, path, preferred=L.MEMBER_COLUMN_ORDER)
    return feeds.read_csv(spark, path, tables.MEMBERS_SCHEMA, preferred=L.MEMBER_COLUMN_ORDER)


def q_export_activities_csv(spark, sf):
    """S3 + P7 for the activity grid: the whole activities table as CSV in the
    grid's preferred column order, read back with the declared schema."""
    m, a, at = _club(spark, sf)
    path = shared_dir(spark, "export-activities")
    feeds.export_csv(a, path, preferred=L.ACTIVITY_COLUMN_ORDER)
    return feeds.read_csv(spark, path, tables.ACTIVITIES_SCHEMA, preferred=L.ACTIVITY_COLUMN_ORDER)


def q_conformed_members(spark, sf):
    """S1 with rejects: the rows of a raw member table that fit the schema."""
    m, a, at = _club(spark, sf)
    return checked.conform_checked(inputs.raw_members(m), tables.MEMBERS_SCHEMA)[0]


def q_member_rejects(spark, sf):
    """S1 with rejects: each value of the other rows that does not fit, beside the row's raw key and name."""
    m, a, at = _club(spark, sf)
    return checked.conform_checked(inputs.raw_members(m), tables.MEMBERS_SCHEMA)[1].select("user_no", "name", "column_name", "raw_value", "reason")


def q_restored_members(spark, sf):
    """S3 that proves itself: exported with figures of each file, checked, and read back."""
    m, a, at = _club(spark, sf)
    path = shared_dir(spark, "checked-members")
    checked.export_checked(m, path, preferred=L.MEMBER_COLUMN_ORDER)
    return checked.restore_checked(spark, path, tables.MEMBERS_SCHEMA, preferred=L.MEMBER_COLUMN_ORDER)


def q_export_check(spark, sf):
    """What the check of an export says: all rows found, and all files as they were written."""
    m, a, at = _club(spark, sf)
    path = shared_dir(spark, "checked-activities")
    checked.export_checked(a, path, preferred=L.ACTIVITY_COLUMN_ORDER)
    files = checked.check_export(spark, path, tables.ACTIVITIES_SCHEMA, preferred=L.ACTIVITY_COLUMN_ORDER)
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).alias(c)
    return files.agg(total("expected"), total("found"), F.coalesce(F.bool_and("ok"), F.lit(True)).alias("ok"))  # a table without rows: no file has any


def q_forecast_rows(spark, sf):
    ev = tables.read_table(spark, sf, "events")
    return feeds.forecast_rows(feeds.forecast_payloads(ev))


def q_json_rows(spark, sf):
    m, a, at = _club(spark, sf)
    return feeds.json_rows(a)


# ---- filters / sorts -------------------------------------------------------

def q_current_members(spark, sf):
    m, a, at = _club(spark, sf)
    return filters.current_members(m)


def q_non_ex_summary(spark, sf):
    return filters.non_ex_summary(_summary(spark, sf))


def q_facet_filter(spark, sf):
    m, a, at = _club(spark, sf)
    return filters.facet_filter(m, FACET_YEARS, FACET_AREAS, FACET_ROLES)


def q_text_search(spark, sf):
    m, a, at = _club(spark, sf)
    return filters.text_search(m, ["name", "description"], MEMBER_PATTERN)


def q_text_search_indexed(spark, sf):
    """P4 by trigram postings, which are stored first."""
    m, a, at = _club(spark, sf)
    cols, path = ["name", "description"], shared_dir(spark, "postings")
    trigrams.save_postings(m, "user_no", cols, path)
    return trigrams.search_indexed(m, spark.read.parquet(path), "user_no", cols, MEMBER_PATTERN)


def q_activity_search(spark, sf):
    m, a, at = _club(spark, sf)
    return filters.text_search(filters.month_filter(a, MONTH), ["title"], TITLE_PATTERN)


def q_month_filter(spark, sf):
    m, a, at = _club(spark, sf)
    return filters.month_filter(a, MONTH)


def q_facet_values(spark, sf):
    m, a, at = _club(spark, sf)
    mv = filters.facet_values(m, {"birth_year": F.col("birth_year"), "area": F.col("area"),
                                  "role": F.col("role")})
    av = filters.facet_values(a, {"month": X.month_text("date")})
    return mv.unionByName(av)


def q_display_labels(spark, sf):
    m, a, at = _club(spark, sf)
    return filters.display_labels(m)


def q_match_counts(spark, sf):
    m, a, at = _club(spark, sf)
    pred = (F.coalesce(F.col("area").isin(FACET_AREAS), F.lit(False))
            & filters.search_predicate(["name", "description"], COUNT_PATTERN))
    return filters.match_counts(m, pred)


def q_activity_match_counts(spark, sf):
    """P9 on the activity grid: shown (month and title search) of all activities, one pass."""
    m, a, at = _club(spark, sf)
    pred = X.in_month("date", MONTH) & filters.search_predicate(["title"], TITLE_PATTERN)
    return filters.match_counts(a, pred)


def q_non_null_sample(spark, sf):
    m, a, at = _club(spark, sf)
    return filters.non_null_sample(m, "description", 5, ["user_no"]).select("user_no", "description")


def q_member_roster(spark, sf):
    m, a, at = _club(spark, sf)
    return filters.member_roster(m)


def q_full_roster(spark, sf):
    m, a, at = _club(spark, sf)
    return filters.full_roster(m)


def q_recent_activities(spark, sf):
    m, a, at = _club(spark, sf)
    return filters.recent_activities(a)


def q_next_activities(spark, sf):
    m, a, at = _club(spark, sf)
    return filters.next_activities(a, AS_OF, 3)


# ---- joins -------------------------------------------------------------------

def q_upcoming_with_host(spark, sf):
    m, a, at = _club(spark, sf)
    return joins.upcoming_with_host(a, m, AS_OF, 3)


def q_activity_attendees(spark, sf):
    m, a, at = _club(spark, sf)
    return joins.activity_attendees(a, at, m, MONTH).drop("event_id", "user_no").orderBy(*joins.attendee_order())


def q_activity_attendees_pruned(spark, sf):
    """J2 on plain attendance, other months dropped by a bitmap before the exchange."""
    m, a, at = _club(spark, sf)
    return joins.activity_attendees(a, at, m, MONTH, prune=True).drop("event_id", "user_no").orderBy(*joins.attendee_order())


def q_birth_year_attendance(spark, sf):
    m, a, at = _club(spark, sf)
    return joins.birth_year_attendance(m, a, at, MONTH)


def q_attending_members(spark, sf):
    m, a, at = _club(spark, sf)
    return joins.attending_members(m, at, filters.month_filter(a, MONTH))


def q_area_geo(spark, sf):
    # The summary has exactly one row per member with the member's area, so
    # the member table gives the same counts without the summary's join.
    m, a, at = _club(spark, sf)
    return joins.area_geo(m, geo_dimension(spark, GEO_TEST_DIM))


def q_event_host_label(spark, sf):
    m, a, at = _club(spark, sf)
    return joins.event_host_label(a, m)


def q_label_to_key(spark, sf):
    m, a, at = _club(spark, sf)
    lab = filters.current_members(m).withColumn(
        "label", X.option_label(F.col("birth_year"), F.col("area")))
    return joins.label_to_key(lab, "label", "user_no", joins.roster_order())


def q_event_label_to_key(spark, sf):
    """J7 for activities: a 'date | title' label resolves to the first activity
    of the newest-first list (same-day namesakes: the smallest id)."""
    m, a, at = _club(spark, sf)
    lab = a.withColumn("label", X.event_label(F.col("date"), F.col("title")))
    return joins.label_to_key(lab, "label", "event_id", joins.newest_first_order())


def q_member_summary(spark, sf):
    return _summary(spark, sf)


# ---- aggregations --------------------------------------------------------------

def q_member_kpi(spark, sf):
    m, a, at = _club(spark, sf)
    return aggs.member_kpi(m, a, at, AS_OF)


def q_birth_year_gender(spark, sf):
    m, a, at = _club(spark, sf)
    return aggs.birth_year_gender(m)


def q_gender_distribution(spark, sf):
    m, a, at = _club(spark, sf)
    return aggs.gender_distribution(m)


def q_area_counts(spark, sf):
    m, a, at = _club(spark, sf)
    return aggs.area_counts(m, 10)


def q_area_counts_20(spark, sf):
    m, a, at = _club(spark, sf)
    return aggs.area_counts(m, 20)


def q_role_counts(spark, sf):
    m, a, at = _club(spark, sf)
    return aggs.role_counts(m)


def q_gender_raw_counts(spark, sf):
    m, a, at = _club(spark, sf)
    return aggs.gender_raw_counts(m)


def q_latest_months(spark, sf):
    m, a, at = _club(spark, sf)
    return aggs.latest_months(a, 6)


def q_monthly_trend(spark, sf):
    m, a, at = _club(spark, sf)
    return aggs.monthly_trend(a, AS_OF, 5)


def q_annual_stats(spark, sf):
    m, a, at = _club(spark, sf)
    return aggs.annual_stats(a, AS_OF)


def _rollup(spark: SparkSession, sf: str) -> DataFrame:
    """Activities counted per day in two batches, the second one late."""
    m, a, at = _club(spark, sf)
    path, late = shared_dir(spark, "rollup"), F.col("event_id") % 10 == 0
    rollup.add_batch(a.filter(~late), path, "first")
    rollup.add_batch(a.filter(late), path, "late")
    return rollup.read_rollup(spark, path)


def q_rollup_latest_months(spark, sf):
    return aggs.latest_months(_rollup(spark, sf), 6, weight="n")


def q_rollup_monthly_trend(spark, sf):
    return aggs.monthly_trend(_rollup(spark, sf), AS_OF, 5, weight="n")


def q_rollup_annual_stats(spark, sf):
    return aggs.annual_stats(_rollup(spark, sf), AS_OF, weight="n")


def q_top_hosts(spark, sf):
    m, a, at = _club(spark, sf)
    return aggs.top_hosts(a, m, MONTH, 3)


def q_top_attendees(spark, sf):
    m, a, at = _club(spark, sf)
    return aggs.top_attendees(a, at, m, MONTH, 3)


def q_top_attendees_pruned(spark, sf):
    m, a, at = _club(spark, sf)
    return aggs.top_attendees(a, at, m, MONTH, 3, prune=True)


def q_popular_activities(spark, sf):
    m, a, at = _club(spark, sf)
    return aggs.popular_activities(a, at, MONTH, 3)


def q_first_attendance(spark, sf):
    m, a, at = _club(spark, sf)
    return aggs.first_attendance(a, at, m, FIRST_MONTH)


def q_birth_years(spark, sf):
    m, a, at = _club(spark, sf)
    return aggs.birth_years(m)


def q_ranked_boards(spark, sf):
    m, a, at = _club(spark, sf)
    return aggs.ranked_boards(a, at, m, MONTH, 3)


# ---- writes ----------------------------------------------------------------------

def q_removed_keys(spark, sf):
    m, a, at = _club(spark, sf)
    visible, edited = inputs.member_grid(m)
    return writes.removed_keys(visible, edited, "user_no")


def q_delete_removed(spark, sf):
    m, a, at = _club(spark, sf)
    visible, edited = inputs.member_grid(m)
    return writes.delete_removed(m, visible, edited, "user_no")


def q_upsert_rows(spark, sf):
    m, a, at = _club(spark, sf)
    visible, edited = inputs.member_grid(m)
    return writes.upsert_rows(m, edited, "user_no", "seq")


def q_cascade_delete(spark, sf):
    m, a, at = _club(spark, sf)
    visible, edited = inputs.activity_grid(a, MONTH)
    return writes.cascade_delete(at, writes.removed_keys(visible, edited, "event_id"))


def q_replace_attendance(spark, sf):
    m, a, at = _club(spark, sf)
    batch, picked = inputs.attendance_selection(a, at, m, MONTH)
    return writes.replace_attendance(at, batch, _selections(m, picked))


def q_extract_event_id(spark, sf):
    m, a, at = _club(spark, sf)
    return writes.extract_event_id(inputs.blanked_activity_ids(a), "event_id", "album_url")


def q_extract_event_id_pages(spark, sf):
    pages = tables.read_table(spark, sf, "pages").select("page_id", F.lit("").alias("event_id"), "url")
    return writes.extract_event_id(pages, "event_id", "url")


def q_apply_grid_edits(spark, sf):
    m, a, at = _club(spark, sf)
    visible, edited = inputs.activity_grid(a, MONTH)
    return writes.apply_grid_edits(a, at, visible, edited)[0]


def q_apply_grid_edits_attendance(spark, sf):
    """W6's second result: the attendance after the save."""
    m, a, at = _club(spark, sf)
    visible, edited = inputs.activity_grid(a, MONTH)
    return writes.apply_grid_edits(a, at, visible, edited)[1]


def q_save_members(spark, sf):
    m, a, at = _club(spark, sf)
    return writes.save_members(m, *inputs.member_grid(m))


def q_save_counts(spark, sf):
    """What the two grids report after a save."""
    m, a, at = _club(spark, sf)
    members = writes.save_counts(*inputs.member_grid(m), "user_no").select(F.lit("members").alias("grid"), "saved", "deleted")
    acts = writes.save_counts(*inputs.activity_grid(a, MONTH), "event_id").select(F.lit("activities").alias("grid"), "saved", "deleted")
    return members.unionByName(acts)


# Saves on the versioned store: they write when they are called (as the exports do),
# to a fresh folder that is removed when the application ends.

def _store(spark: SparkSession, sf: str) -> versions.ClubStore:
    m, a, at = _club(spark, sf)
    store = versions.ClubStore(spark, shared_dir(spark, "club"))
    store.create(a, at)
    return store


def _grid_saved(spark: SparkSession, sf: str) -> versions.ClubStore:
    m, a, at = _club(spark, sf)
    store = _store(spark, sf)
    versions.save_activity_grid(store, store.latest(), *inputs.activity_grid(a, MONTH))
    return store


def q_grid_saved_activities(spark, sf):
    """W6 as one commit: the activities of the version after the save."""
    return _grid_saved(spark, sf).read("activities")


def q_grid_saved_attendance(spark, sf):
    """W6 as one commit: the attendance of the same version."""
    return _grid_saved(spark, sf).read("attendance").drop(filters.ACTIVITY_MONTH)


def q_month_cascade_delete(spark, sf):
    """W3 on the store: one month's folders read and written."""
    m, a, at = _club(spark, sf)
    store = _store(spark, sf)
    versions.delete_activities(store, store.latest(), MONTH, writes.removed_keys(*inputs.activity_grid(a, MONTH), "event_id"))
    return store.read("attendance").drop(filters.ACTIVITY_MONTH)


def _selections(m: DataFrame, picked: DataFrame) -> DataFrame:
    lab = filters.current_members(m).withColumn(
        "label", X.option_label(F.col("birth_year"), F.col("name"), F.col("area")))
    keys = joins.label_to_key(lab, "label", "user_no", joins.roster_order())
    return picked.join(keys, "label").select("event_id", "user_no")


def q_month_replace_attendance(spark, sf):
    """W4 on the store: one month's folders read and written."""
    m, a, at = _club(spark, sf)
    store = _store(spark, sf)
    batch, picked = inputs.attendance_selection(a, at, m, MONTH)
    versions.save_attendance(store, store.latest(), MONTH, batch, _selections(m, picked))
    return store.read("attendance").drop(filters.ACTIVITY_MONTH)


def q_summary_after_save(spark, sf):
    """J8 kept up to date: the figures per member before a W4 save, updated by what the save changed."""
    m, a, at = _club(spark, sf)
    batch, picked = inputs.attendance_selection(a, at, m, MONTH)
    chosen = _selections(m, picked)
    now = writes.replace_attendance(at, batch, chosen)
    state = score_state(a, at, AS_OF)
    changed = update_scores(state, visits(a, chosen.distinct()), visits(a, at.join(batch, "event_id", "left_semi")), visits(a, now), AS_OF)
    return summary_of(m, changed, AS_OF)


# ---- report ------------------------------------------------------------------------

def q_activity_digest(spark, sf):
    m, a, at = _club(spark, sf)
    return report.activity_digest(a, at, m, MONTH)


def q_activity_digest_pruned(spark, sf):
    m, a, at = _club(spark, sf)
    return report.activity_digest(a, at, m, MONTH, prune=True)


def q_milestones(spark, sf):
    return report.milestones(_summary(spark, sf))


def q_inactivity_warnings(spark, sf):
    return report.inactivity_warnings(_summary(spark, sf))


def q_score_table(spark, sf):
    return report.score_table(_summary(spark, sf))


def q_report_lines(spark, sf):
    m, a, at = _club(spark, sf)
    return report.monthly_report(m, a, at, AS_OF, MONTH, rules=RULES_LINK)


def q_report_markup(spark, sf):
    """R5, formatted output: the same report with its '**' emphasis kept."""
    m, a, at = _club(spark, sf)
    return report.monthly_report(m, a, at, AS_OF, MONTH, rules=RULES_LINK, plain=False)


def q_report_composed(spark, sf):
    """R5 as a lazy composition of the summary and the digest (no stage is stored)."""
    m, a, at = _club(spark, sf)
    return report.report_lines(member_summary(m, a, at, AS_OF), a, at, m, MONTH, rules=RULES_LINK)


def q_briefing_context(spark, sf):
    m, a, at = _club(spark, sf)
    return report.briefing_context(a, 3)


def q_next_briefing(spark, sf):
    m, a, at = _club(spark, sf)
    return report.next_briefing(a, AS_OF, 3)


# Queries that write when they are called: exports and saves.
WRITING = ("export_csv", "export_activities_csv", "grid_saved_activities", "grid_saved_attendance", "month_cascade_delete", "month_replace_attendance",
           "report_lines", "report_markup", "restored_members", "export_check", "text_search_indexed", "rollup_latest_months", "rollup_monthly_trend", "rollup_annual_stats")

QUERIES: dict[str, Query] = {
    # sources
    "load_tables": q_load_tables,
    "sql_param": q_sql_param,
    "export_csv": q_export_csv,
    "export_activities_csv": q_export_activities_csv,
    "conformed_members": q_conformed_members,
    "member_rejects": q_member_rejects,
    "restored_members": q_restored_members,
    "export_check": q_export_check,
    "forecast_rows": q_forecast_rows,
    "json_rows": q_json_rows,
    # filters and sorts
    "current_members": q_current_members,
    "non_ex_summary": q_non_ex_summary,
    "facet_filter": q_facet_filter,
    "text_search": q_text_search,
    "text_search_indexed": q_text_search_indexed,
    "activity_search": q_activity_search,
    "month_filter": q_month_filter,
    "facet_values": q_facet_values,
    "display_labels": q_display_labels,
    "match_counts": q_match_counts,
    "activity_match_counts": q_activity_match_counts,
    "non_null_sample": q_non_null_sample,
    "member_roster": q_member_roster,
    "full_roster": q_full_roster,
    "recent_activities": q_recent_activities,
    "next_activities": q_next_activities,
    # joins
    "upcoming_with_host": q_upcoming_with_host,
    "activity_attendees": q_activity_attendees,
    "activity_attendees_pruned": q_activity_attendees_pruned,
    "birth_year_attendance": q_birth_year_attendance,
    "attending_members": q_attending_members,
    "area_geo": q_area_geo,
    "event_host_label": q_event_host_label,
    "label_to_key": q_label_to_key,
    "event_label_to_key": q_event_label_to_key,
    "member_summary": q_member_summary,
    # aggregations
    "member_kpi": q_member_kpi,
    "birth_year_gender": q_birth_year_gender,
    "gender_distribution": q_gender_distribution,
    "area_counts": q_area_counts,
    "area_counts_20": q_area_counts_20,
    "role_counts": q_role_counts,
    "gender_raw_counts": q_gender_raw_counts,
    "latest_months": q_latest_months,
    "monthly_trend": q_monthly_trend,
    "annual_stats": q_annual_stats,
    "rollup_latest_months": q_rollup_latest_months,
    "rollup_monthly_trend": q_rollup_monthly_trend,
    "rollup_annual_stats": q_rollup_annual_stats,
    "top_hosts": q_top_hosts,
    "top_attendees": q_top_attendees,
    "top_attendees_pruned": q_top_attendees_pruned,
    "popular_activities": q_popular_activities,
    "first_attendance": q_first_attendance,
    "birth_years": q_birth_years,
    "ranked_boards": q_ranked_boards,
    # writes
    "removed_keys": q_removed_keys,
    "delete_removed": q_delete_removed,
    "upsert_rows": q_upsert_rows,
    "cascade_delete": q_cascade_delete,
    "replace_attendance": q_replace_attendance,
    "extract_event_id": q_extract_event_id,
    "extract_event_id_pages": q_extract_event_id_pages,
    "apply_grid_edits": q_apply_grid_edits,
    "apply_grid_edits_attendance": q_apply_grid_edits_attendance,
    "save_members": q_save_members,
    "save_counts": q_save_counts,
    "grid_saved_activities": q_grid_saved_activities,
    "grid_saved_attendance": q_grid_saved_attendance,
    "month_cascade_delete": q_month_cascade_delete,
    "month_replace_attendance": q_month_replace_attendance,
    "summary_after_save": q_summary_after_save,
    # report
    "activity_digest": q_activity_digest,
    "activity_digest_pruned": q_activity_digest_pruned,
    "milestones": q_milestones,
    "inactivity_warnings": q_inactivity_warnings,
    "score_table": q_score_table,
    "report_lines": q_report_lines,
    "report_markup": q_report_markup,
    "report_composed": q_report_composed,
    "briefing_context": q_briefing_context,
    "next_briefing": q_next_briefing,
}
