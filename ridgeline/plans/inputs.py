"""Deterministic edit batches for the write, lookup and label queries.

Each recipe derives its input from the entities (so its size grows with the
data) by fixed rules; the oracle SQL applies the same rules.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import expr as X
from ..operators.filters import current_members, month_filter

VISIBLE_AREA = "NATION_3"
EDIT_SUFFIX = " (edited)"
SECOND_EDIT_SUFFIX = " (v2)"
NEW_KEY_OFFSET = 1_000_000
POSITION_STEP = 10**12


def member_grid(m: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(visible, edited) for the member grid.

    visible = members of one area; edited = visible without keys % 7 == 0,
    names suffixed where key % 5 == 0, plus new rows (key + 1,000,000) copied
    from keys % 6 == 0, and a second edit of keys % 10 == 0. `seq` is the
    row's position: all rows as shown, then the new ones, then the second edits.
    Each visible row makes its one to three rows in one pass.
    """
    visible = m.filter(F.col("area") == VISIBLE_AREA)
    k = F.col("user_no")
    name = F.when(k % 5 == 0, F.concat(F.col("name"), F.lit(EDIT_SUFFIX))).otherwise(F.col("name"))

    def variant(order: int, key, text):
        return F.struct(key.alias("user_no"), text.alias("name"), (k + order * POSITION_STEP).alias("seq"))

    variants = F.filter(F.array(
        variant(0, k, name), F.when(k % 6 == 0, variant(1, k + NEW_KEY_OFFSET, name)),
        F.when(k % 10 == 0, variant(2, k, F.concat(name, F.lit(SECOND_EDIT_SUFFIX))))), lambda v: v.isNotNull())
    edited = visible.filter(k % 7 != 0).withColumn("_v", F.explode(variants))
    return visible, edited.select(*[F.col(f"_v.{c}") if c in ("user_no", "name") else F.col(c) for c in m.columns], "_v.seq")


def activity_grid(a: DataFrame, month: str) -> tuple[DataFrame, DataFrame]:
    """(visible, edited) for the activity grid: keys are text, `seq` is the position.

    visible = activities of the month; edited = visible without keys % 9 == 0.
    The key is blanked where key % 6 == 2 (the album URL still carries it) and
    where key % 12 == 4 (the URL has no digits, so it cannot be repaired), and
    keys % 30 == 11 are given one of four new ids, which therefore collide.
    """
    visible = month_filter(a, month)
    k = F.col("event_id")
    new_id = (F.when((k % 6 == 2) | (k % 12 == 4), F.lit(""))
              .when(k % 30 == 11, F.concat(F.lit("900000000"), (k % 4).cast("string")))
              .otherwise(k.cast("string")))
    edited = visible.filter(k % 9 != 0).select(new_id.alias("event_id"), *[c for c in a.columns if c != "event_id"], k.alias("seq"))
    return visible.withColumn("event_id", k.cast("string")), edited


def attendance_selection(a: DataFrame, at: DataFrame, m: DataFrame, month: str) -> tuple[DataFrame, DataFrame]:
    """(batch, selections) for attendance replacement.

    batch = activities of the month; the selection of each is its current
    member attendees with key % 3 != 0, given as pick-list labels.
    """
    batch = month_filter(a, month).select("event_id")
    cm = current_members(m)
    picked = (at.join(batch, "event_id", "left_semi")
              .join(cm.select("user_no", "birth_year", "name", "area"), "user_no")
              .filter(F.col("user_no") % 3 != 0)
              .select("event_id",
                      X.option_label(F.col("birth_year"), F.col("name"), F.col("area")).alias("label"))
              .distinct())
    return batch, picked


def blanked_activity_ids(a: DataFrame) -> DataFrame:
    """Activities with the id as text, blanked for even keys."""
    k = F.col("event_id")
    return a.select(
        k.alias("orig_id"),
        F.when(k % 2 == 0, F.lit("")).otherwise(k.cast("string")).alias("event_id"),
        "album_url")


def raw_members(m: DataFrame) -> DataFrame:
    """Members as texts, as a hand-kept file would have them: some values do not fit their types."""
    k = F.col("user_no")
    wrong = {
        "user_no": F.when(k % 103 == 0, F.lit(None)).when(k % 101 == 0, F.concat(F.lit("k-"), k.cast("string"))),
        "birth_year": F.when(k % 53 == 0, F.lit("99999999999")).when(k % 19 == 0, F.lit("unknown")),
        "point": F.when(k % 61 == 0, F.lit("12 points")).when(k % 67 == 0, F.lit("")),
        "created_at": F.when(k % 47 == 0, F.lit("2001-13-40")),
    }
    return m.select(*[(F.when(wrong[c].isNotNull() | ((k % 103 == 0) & F.lit(c == "user_no")), wrong[c]).otherwise(F.col(c).cast("string"))
                       if c in wrong else F.col(c).cast("string")).alias(c) for c in m.columns])
