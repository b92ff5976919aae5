"""The monthly report and its parts.

Lists whose length grows with the data (attendees of one activity, members
with a warning) are never collected into one value: they are emitted as
ordered rows / text fragments, so no single task or group has to hold them.
The complete report is the concatenation of ``report_lines().line`` in
(section, part, k1, k2, k3) order; `write_report` stores it globally sorted.
"""

from __future__ import annotations

import datetime as _dt
import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import expr as X
from ..functions import lookups as L
from ..session import scratch_table
from .filters import next_activities, non_ex_summary
from .joins import activity_attendees

WARN_STATUSES = ("dormant_warn", "new_warn")
NAMES_PER_FRAGMENT = 100
_NL = "\n"


def fmt(template: str, **cols: Column) -> Column:
    """'{name}' placeholders -> concat of literal pieces and columns (NULL-free inputs)."""
    parts = []
    pos = 0
    for mt in re.finditer(r"\{(\w+)\}", template):
        if mt.start() > pos:
            parts.append(F.lit(template[pos:mt.start()]))
        parts.append(cols[mt.group(1)].cast("string"))
        pos = mt.end()
    if pos < len(template):
        parts.append(F.lit(template[pos:]))
    return F.concat(*parts) if len(parts) > 1 else parts[0]


def _name_order() -> list[Column]:
    return [F.col("birth_year").isNull().alias("_ny"), F.col("birth_year").alias("_y"),
            F.col("name").isNull().alias("_nn"), F.col("name").alias("_n")]


def activity_digest(a: DataFrame, at: DataFrame, m: DataFrame, month: str, prune: bool = False) -> DataFrame:
    """The month's attendance grouped by (date, title).

    One row per (date, title, birth_year, name) with its multiplicity `n`;
    `headcount` (all records of the group) and `album_url` (the URL of the
    group's first record in birth-year, name order) repeat on each row. The
    attendee list is these rows in (birth_year, name) order, NULLs last —
    built by two partial aggregations, never as one collected list. `prune`: see
    `joins.activity_attendees`.
    """
    grp, names = digest_parts(a, at, m, month, prune)
    return names.join(grp, ["date", "title"]).select(
        "date", "title", "headcount", "album_url", "birth_year", "name", "n")


GROUP_KEY_SEP = "\x01"


def name_key() -> Column:
    """Text key ordering attendees by (birth_year, name), NULLs last."""
    return F.concat(F.when(F.col("birth_year").isNull(), "1").otherwise("0"),
                    F.coalesce(_pad(F.col("birth_year"), 11), F.lit("")),
                    F.when(F.col("name").isNull(), "1").otherwise("0"),
                    F.coalesce(F.col("name"), F.lit("")))


def digest_parts(a: DataFrame, at: DataFrame, m: DataFrame, month: str, prune: bool = False) -> tuple[DataFrame, DataFrame]:
    """(per-group headcount / album URL / first and last name keys, per-group name multiplicities).

    The month's attendance is reduced once to (date, title, birth_year, name)
    counts — bounded by distinct attendees, not by records; group figures are
    derived from those counts (both plans share the exchange below them).
    Activities without a title make no group.
    """
    j = activity_attendees(a, at, m, month, prune).filter(F.col("title").isNotNull())
    names = j.groupBy("date", "title", "birth_year", "name").agg(
        F.count(F.lit(1)).cast("bigint").alias("n"),
        F.min_by("album_url", F.col("event_id")).alias("_album"))
    return _groups(names), names.drop("_album")


def _groups(names: DataFrame) -> DataFrame:
    """Headcount, album URL and first and last name keys of each group, from its name counts."""
    return names.groupBy("date", "title").agg(
        F.sum("n").cast("bigint").alias("headcount"),
        F.min_by("_album", F.struct(*_name_order())).alias("album_url"),
        F.min(name_key()).alias("_first"),
        F.max(name_key()).alias("_last"))


def milestones(summary: DataFrame) -> DataFrame:
    """R2: one row per member and crossed threshold: current >= t and current - gained < t."""
    curr = F.coalesce(F.col("current_point"), F.lit(0)).cast("bigint")
    gained = F.coalesce(F.col("gained_score"), F.lit(0)).cast("bigint")
    ths = F.array(*[F.struct(F.lit(t).alias("threshold"), F.lit(msg).alias("message"))
                    for t, msg in L.MILESTONES])
    s = summary.select("user_no", "member_label", curr.alias("current_point"), gained.alias("_g"),
                       F.explode(ths).alias("_t"))
    hit = s.filter((F.col("current_point") >= F.col("_t.threshold"))
                   & (F.col("current_point") - F.col("_g") < F.col("_t.threshold")))
    return hit.select(
        "user_no", "member_label", "current_point",
        F.col("_t.threshold").alias("threshold"), F.col("_t.message").alias("message"),
        fmt(L.RPT_AWARD_LINE, label=F.col("member_label"), points=F.col("current_point"),
            message=F.col("_t.message")).alias("line"),
    )


def inactivity_warnings(summary: DataFrame) -> DataFrame:
    """Members with a warning status, one row each, in label order."""
    return (summary.filter(F.col("status").isin(*WARN_STATUSES)).select("status", "user_no", "member_label")
            .orderBy("member_label", "user_no"))


def score_table(summary: DataFrame) -> DataFrame:
    """This month's and cumulative points of every non-ex member (NULL -> 0), in label order."""
    return non_ex_summary(summary).select(
        "user_no", "member_label",
        F.coalesce(F.col("gained_score"), F.lit(0)).cast("bigint").alias("gained_score"),
        F.coalesce(F.col("current_point"), F.lit(0)).cast("bigint").alias("current_point"),
        "status").orderBy("member_label", "user_no")


def _pad(c: Column, width: int = 20) -> Column:
    return F.lpad(c.cast("string"), width, "0")


def _frag(section: int, part: int, line: Column, k1: Column | None = None, k2: Column | None = None,
          k3: Column | None = None, when: Column | None = None) -> Column:
    empty = F.lit("")
    st = F.struct(F.lit(section).alias("section"), F.lit(part).alias("part"),
                  (k1 if k1 is not None else empty).alias("k1"),
                  (k2 if k2 is not None else empty).alias("k2"),
                  (k3 if k3 is not None else empty).alias("k3"),
                  line.alias("line"))
    return st if when is None else F.when(when, st)


def _explode(df: DataFrame, frags: list[Column]) -> DataFrame:
    """One output row per non-NULL fragment struct of each input row."""
    return (df.select(F.explode(F.array(*frags)).alias("_f"))
            .filter(F.col("_f").isNotNull()).select("_f.*"))


def report_lines(summary: DataFrame, a: DataFrame, at: DataFrame, m: DataFrame, month: str,
                 rules: str = "", club: str = "산악회", plain: bool = True) -> DataFrame:
    """The whole monthly text report as ordered fragments.

    Columns (section, part, k1, k2, k3, line); the text is the concatenation
    of `line` in that order. `plain` drops the '**' markup.

    Plan (lazy): every per-member fragment (milestones, first attendance,
    warnings, score table) comes from one pass over the summary, every
    per-activity fragment from one pass over the group table; the
    end-of-list and empty-section markers from one aggregate over the
    summary (its values enter the pass as scalars) and one over the groups.
    No value grows with the data: an attendee name that occurs very often is
    written in fragments of at most `NAMES_PER_FRAGMENT` names.
    """
    # records of activities without a title are activity all the same
    records = activity_attendees(a, at, m, month).agg(F.count(F.lit(1)).alias("_c"))
    return _fragments(summary, *digest_parts(a, at, m, month), records, month, rules, club, plain)


def attendance_facts(m: DataFrame, a: DataFrame, at: DataFrame, as_of, month: str) -> DataFrame:
    """Every member with all that the report needs, from one join of attendance and activities.

    Grouping sets reduce the joined records once: to a row per member (the
    summary's figures) and a row per member and activity group (date, title) of
    the month; records of other months make no groups. The result then meets the
    members once. `_group` is true for rows of a group; a member without any
    record has one row, without figures. Attendees that are no members go.
    """
    asof = _dt.date.fromisoformat(str(as_of))
    here, upto = X.in_month("date", month), F.col("date") <= F.lit(asof)
    in_cur = upto & X.in_month("date", X.month_of(asof))
    visits = (at.select("event_id", "user_no").join(a.select("event_id", "date", "score", "title", "album_url"), "event_id")
              .withColumns({"_here": F.coalesce(here, F.lit(False)), "_date": F.when(here, F.col("date")), "_title": F.when(here, F.col("title"))}))
    keys = ["user_no", "_here", "_date", "_title"]
    facts = visits.groupingSets([["user_no"], keys], *keys).agg(
        (F.grouping("_here") == 0).alias("_group"),
        F.sum(F.when(upto, F.col("score"))).alias("_total"), F.sum(F.when(in_cur, F.col("score"))).alias("_month"),
        F.max(F.when(upto, F.col("date"))).alias("last_attended"), F.min("date").alias("first_date"),
        F.count(F.lit(1)).alias("_n"), F.min_by("album_url", "event_id").alias("_album"), F.min("event_id").alias("_first_event"))
    return m.join(facts.filter("NOT _group OR _here").drop("_here"), "user_no", "left")


def monthly_report(m: DataFrame, a: DataFrame, at: DataFrame, as_of, month: str, rules: str = "", club: str = "산악회", plain: bool = True) -> DataFrame:
    """R5 in one pass: `report_lines` of the summary at `as_of`, from `attendance_facts`, which are stored once.

    The store is a folder of the session's shared storage, removed when the
    application ends; the report's parts read it and nothing else.
    """
    from ..plans.summary import summary_columns

    facts = scratch_table(attendance_facts(m, a, at, as_of, month), "report-facts")
    groups = facts.filter("_group").select(F.col("_date").alias("date"), F.col("_title").alias("title"), "birth_year", "name", "_n", "_album", "_first_event")
    names = groups.filter("title IS NOT NULL").groupBy("date", "title", "birth_year", "name").agg(
        F.sum("_n").alias("n"), F.min_by("_album", "_first_event").alias("_album"))
    names = scratch_table(names, "report-names")
    summary = summary_columns(facts.filter("NOT coalesce(_group, false)"), as_of)
    return _fragments(summary, _groups(names), names.drop("_album"), groups.agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("_c")), month, rules, club, plain)


def _fragments(summary: DataFrame, grp: DataFrame, names: DataFrame, records: DataFrame, month: str, rules: str, club: str, plain: bool) -> DataFrame:
    """The report's fragments from the summary, the groups and names of `digest_parts`, and the number of records `_c`."""
    spark = summary.sparkSession
    br = L.BR + _NL
    s = summary.select("user_no", F.col("name").alias("_name"), "member_label", "status",
                       "gained_score", "current_point", "first_date")
    out = []

    # constant lines
    head = (L.RPT_RULES_HEAD.format(club=club) + br + rules + br + _NL
            + L.RPT_TITLE.format(month=month) + br + L.RULE + br + _NL)
    consts = [(0, 0, head), (1, 0, L.RPT_ACTIVITY_HEAD + br), (2, 0, L.RPT_AWARD_HEAD + br),
              (3, 0, L.RPT_FIRST_HEAD + br), (4, 0, L.RPT_WARN_HEAD + br),
              (4, 1, L.RPT_WARN_DORMANT + "  " + _NL), (4, 4, L.RPT_WARN_NEW + "  " + _NL),
              (5, 0, L.RPT_SCORE_HEAD + br + L.RPT_SCORE_COLUMNS + br + L.RPT_SCORE_ALIGN + br),
              (6, 0, _NL + L.RULE + br + L.RPT_CLOSING)]
    out.append(_explode(spark.range(1), [_frag(sec, part, F.lit(t)) for sec, part, t in consts]))

    # 1. activities: per group, then per attendee name. Groups follow the
    # original's first-appearance order over rows sorted by (date, birth_year,
    # name): by date, then by the group's first attendee, then (a tie the
    # original leaves open) by title. "\x01" sorts below any name character.
    day = F.date_format("date", "yyyy-MM-dd")
    gkey = F.concat(day, F.lit("|"), F.col("_first"), F.lit(GROUP_KEY_SEP), F.col("title"))
    album = X.blank_to_null(F.col("album_url"))
    out.append(_explode(grp, [
        _frag(1, 1, fmt(L.RPT_ACTIVITY_LINE + br, date=day, title=F.col("title")), gkey, F.lit("0")),
        _frag(1, 1, fmt(L.RPT_ATTENDEES, n=F.col("headcount")), gkey, F.lit("1")),
        _frag(1, 1, F.concat(F.lit(L.RPT_ALBUM), F.col("album_url"), F.lit(br)), gkey, F.lit("2"),
              when=album.isNotNull()),
        _frag(1, 1, F.lit(_NL), gkey, F.lit("3")),
    ]))
    nm = F.coalesce(F.col("name"), F.lit("None"))
    nk = name_key()
    named = (names.join(grp.select("date", "title", "_first", "_last"), ["date", "title"])
             .withColumn("_chunk", F.explode(F.sequence(F.lit(0), F.floor((F.col("n") - 1) / NAMES_PER_FRAGMENT)))))
    left = F.col("n") - F.col("_chunk") * NAMES_PER_FRAGMENT  # names from this fragment on
    text = F.concat(F.repeat(F.concat(nm, F.lit(", ")), (F.least(left, F.lit(NAMES_PER_FRAGMENT)) - 1).cast("int")), nm,
                    F.when((nk == F.col("_last")) & (left <= NAMES_PER_FRAGMENT), F.lit(br)).otherwise(F.lit(", ")))
    part_key = F.concat(nk, F.lit(GROUP_KEY_SEP), _pad(F.col("_chunk"), 10))
    out.append(_explode(named, [_frag(1, 1, text, gkey, F.lit("1"), part_key)]))

    # 2.–5. per member: one pass over the summary
    label = F.col("member_label")
    upad = _pad(F.col("user_no"))
    wkey = F.concat(label, F.lit(GROUP_KEY_SEP), upad)
    curr = F.coalesce(F.col("current_point"), F.lit(0)).cast("bigint")
    gained = F.coalesce(F.col("gained_score"), F.lit(0)).cast("bigint")
    crossed = [(curr >= t) & (curr - gained < t) for t, _ in L.MILESTONES]
    first_in_month = X.in_month(F.col("first_date"), month)
    marks = s.agg(
        F.sum(sum(F.when(c, 1).otherwise(0) for c in crossed)).alias("_ms"),
        F.count_if(first_in_month).alias("_fa"),
        *[F.max(F.when(F.col("status") == status, wkey)).alias(f"_{status}") for status in WARN_STATUSES])
    frags = [
        _frag(2, 1, F.concat(fmt(L.RPT_AWARD_LINE, label=label, points=curr, message=F.lit(msg)), F.lit(br)),
              label, upad, F.lit(str(i)), when=cond)
        for i, ((t, msg), cond) in enumerate(zip(L.MILESTONES, crossed))
    ]
    frags.append(_frag(3, 1, F.concat(fmt(L.RPT_FIRST_LINE, name=F.coalesce(F.col("_name"), F.lit("None"))),
                                      F.lit(br)),
                       F.coalesce(F.col("_name"), F.lit("")), upad, when=first_in_month))
    for part, status, end in ((2, "dormant_warn", br), (5, "new_warn", br + _NL)):
        sep = F.when(wkey == marks.select(f"_{status}").scalar(), F.lit(end)).otherwise(F.lit(", "))
        frags.append(_frag(4, part, F.concat(label, sep), label, upad, when=F.col("status") == status))
    frags.append(_frag(5, 1, F.concat(fmt(L.RPT_SCORE_LINE, label=label, gained=gained, current=curr,
                                          status=F.coalesce(F.col("status"), F.lit("None"))), F.lit(br)),
                       label, upad, when=~F.col("status").eqNullSafe("exmember")))
    out.append(_explode(s, frags))

    # end-of-section markers
    out.append(_explode(marks, [
        _frag(2, 2, F.when(F.coalesce(F.col("_ms"), F.lit(0)) == 0, F.lit(L.RPT_NONE_APPLICABLE + br + _NL))
              .otherwise(F.lit(_NL))),
        _frag(3, 2, F.when(F.col("_fa") == 0, F.lit(L.RPT_NONE + br + _NL)).otherwise(F.lit(_NL))),
        _frag(4, 3, F.lit(L.RPT_NONE + br), when=F.col("_dormant_warn").isNull()),
        _frag(4, 6, F.lit(L.RPT_NONE + br + _NL), when=F.col("_new_warn").isNull()),
    ]))
    out.append(_explode(records, [_frag(1, 2, F.lit(L.RPT_NO_ACTIVITY + br + _NL), when=F.col("_c") == 0)]))

    res = out[0]
    for df in out[1:]:
        res = res.unionByName(df)
    if plain:
        res = res.withColumn("line", F.replace(F.col("line"), F.lit("**"), F.lit("")))
    return res


REPORT_ORDER = ("section", "part", "k1", "k2", "k3")


def write_report(lines: DataFrame, path: str) -> None:
    """Store the report as its fragment table, globally sorted.

    The sort is range partitioned (many tasks share it); part files in name
    order hold consecutive key ranges, so reading them in order and
    concatenating `line` reproduces the text without any single task or the
    driver holding the whole report.
    """
    (lines.orderBy(*REPORT_ORDER).write.mode("errorifexists").parquet(path))


def briefing_context(a: DataFrame, n: int = 3) -> DataFrame:
    """Per month, a briefing text for its first n activities (date, then id).

    The row_number filter is planned with a per-partition group limit before
    the shuffle, so a month with very many activities sends at most n rows
    per map task; the collected list then holds at most n entries.
    """
    month = X.month_text("date")
    w = Window.partitionBy("_m").orderBy(F.col("date").asc(), F.col("event_id").asc())
    top = (a.select("event_id", "date", "title", "host", month.alias("_m"))
           .withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= n))
    line = fmt(L.BRIEFING_LINE + _NL, title=F.coalesce(F.col("title"), F.lit("None")),
               date=F.date_format("date", "yyyy-MM-dd"),
               host=F.coalesce(F.col("host").cast("string"), F.lit("None")))
    g = top.groupBy("_m").agg(F.array_sort(F.collect_list(F.struct("_rn", line.alias("t")))).alias("_l"))
    head = fmt(L.BRIEFING_HEAD + _NL, date=F.concat(F.col("_m"), F.lit("-01")))
    return g.select(F.col("_m").alias("month"),
                    F.concat(head, F.array_join(F.transform("_l", lambda x: x["t"]), "")).alias("text"))


def next_briefing(a: DataFrame, as_of, n: int = 3) -> DataFrame:
    """R6, the original's own form: one text for the next n activities from `as_of`, dated `as_of`.

    No row if nothing is ahead. The collected list holds at most n entries.
    """
    top = next_activities(a, as_of, n)
    line = fmt(L.BRIEFING_LINE + _NL, title=F.coalesce(F.col("title"), F.lit("None")),
               date=F.date_format("date", "yyyy-MM-dd"),
               host=F.coalesce(F.col("host").cast("string"), F.lit("None")))
    lines = top.agg(F.array_sort(F.collect_list(F.struct("date", "event_id", line.alias("t")))).alias("_l")).filter(F.size("_l") > 0)
    head = fmt(L.BRIEFING_HEAD + _NL, date=F.date_format(X.as_date(as_of), "yyyy-MM-dd"))
    return lines.select(F.concat(head, F.array_join(F.transform("_l", lambda x: x["t"]), "")).alias("text"))
