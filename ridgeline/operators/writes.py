"""Grid edits applied as set operations.

Parquet has no row-level MERGE, so each operator is a pure function
(base, changes) -> new base. Nothing is applied row by row and nothing goes
through the driver; the caller writes the returned frame to a new location
(`save_table`), which makes a save all-or-nothing at the directory level.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import expr as X


def _key_text(c: str) -> F.Column:
    """Keys are compared as text, exactly as the grid hands them back.

    No trimming here: only the id repair (W5) strips the id it writes, so an
    id edited to " 9 " no longer matches "9" and "9" counts as removed.
    """
    return F.col(c).cast("string")


def removed_keys(visible: DataFrame, edited: DataFrame, key: str) -> DataFrame:
    """Keys shown in the (filtered) grid that are missing after editing, as text."""
    shown = visible.select(_key_text(key).alias(key))
    kept = edited.select(_key_text(key).alias(key))
    return shown.join(kept, key, "left_anti").distinct()


def upsert_rows(base: DataFrame, edited: DataFrame, key: str, seq: str) -> DataFrame:
    """Insert-or-replace by key; among edits of one key the highest `seq` wins.

    The winner per key is a max over (seq, row) — a partial aggregate, so a
    key edited very many times is combined map-side. Base rows whose key is
    edited are removed with an anti join and the winners appended.
    """
    cols = [c for c in base.columns]
    latest = (edited.groupBy(key)
              .agg(F.max(F.struct(F.col(seq).alias("_s"),
                                  F.struct(*[F.col(c) for c in cols]).alias("_r"))).alias("_w"))
              .select("_w._r.*"))
    kept = base.join(latest.select(F.col(key).alias("_k")), F.col(key) == F.col("_k"), "left_anti")
    return kept.unionByName(latest)


def delete_removed(base: DataFrame, visible: DataFrame, edited: DataFrame, key: str) -> DataFrame:
    """Delete only keys that were visible under the filter and then removed."""
    gone = removed_keys(visible, edited, key).select(F.col(key).alias("_k"))
    return base.join(gone, _key_text(key) == F.col("_k"), "left_anti")


def cascade_delete(at: DataFrame, removed: DataFrame, key: str = "event_id") -> DataFrame:
    """Drop attendance of removed activities (members do not cascade).

    Keys match as text. Where attendance holds whole numbers, only a removed key
    that is a number as it would be written can match one, so the few removed
    keys become numbers and attendance keeps its own type in the join.
    """
    text = F.col(key).cast("string")
    if not isinstance(at.schema[key].dataType, T.IntegralType):
        return at.join(removed.select(text.alias("_k")), _key_text(key) == F.col("_k"), "left_anti")
    number = text.try_cast("bigint")
    gone = removed.filter(number.cast("string") == text).select(number.alias("_k"))
    return at.join(gone, F.col(key) == F.col("_k"), "left_anti")


def replace_attendance(at: DataFrame, batch: DataFrame, selections: DataFrame) -> DataFrame:
    """Per activity in the batch, delete all its records and insert the selection.

    An activity of the batch with no selection is cleared. Selections for
    activities outside the batch are ignored.
    """
    ids = batch.select("event_id")
    chosen = selections.join(ids, "event_id", "left_semi").select("event_id", "user_no").distinct()
    return at.join(ids, "event_id", "left_anti").unionByName(chosen)


def extract_event_id(t: DataFrame, id_col: str = "event_id", url_col: str = "album_url") -> DataFrame:
    """Repair blank ids from the album URL.

    A hand-given id wins. Otherwise the digits after the last '/' (an optional
    trailing '/' allowed), else the trailing digits of the URL, else ''.
    Digits are ASCII [0-9] so both regex engines agree.
    """
    eid = X.full_trim(F.coalesce(F.col(id_col).cast("string"), F.lit("")))
    url = X.full_trim(F.coalesce(F.col(url_col), F.lit("")))
    after_slash = F.regexp_extract(url, r"/([0-9]+)/?$", 1)
    trailing = F.regexp_extract(url, r"([0-9]+)$", 1)
    fixed = F.when((eid == "") & (url != ""),
                   F.coalesce(X.blank_to_null(after_slash), X.blank_to_null(trailing), F.lit(""))
                   ).otherwise(eid)
    return t.withColumn(id_col, fixed)


def apply_grid_edits(base: DataFrame, at: DataFrame, visible: DataFrame, edited: DataFrame,
                     key: str = "event_id", seq: str = "seq") -> tuple[DataFrame, DataFrame]:
    """A full save of the activity grid -> (new activities, new attendance).

    Order as in the original save: removed keys are found *before* ids are
    repaired (so blanking an id deletes that activity's attendance even when
    the repair restores the same id), then deletes with cascade, then id
    repair, then upsert. Keys become text, as the grid returns them.
    """
    gone = removed_keys(visible, edited, key)
    base_t = base.withColumn(key, _key_text(key))
    kept = base_t.join(gone.select(F.col(key).alias("_k")), F.col(key) == F.col("_k"), "left_anti")
    new_at = cascade_delete(at, gone, key)
    repaired = extract_event_id(edited, key)
    new_base = upsert_rows(kept, repaired.select(*kept.columns, seq), key, seq)
    return new_base, new_at


def save_members(base: DataFrame, visible: DataFrame, edited: DataFrame, key: str = "user_no",
                 seq: str = "seq") -> DataFrame:
    """W6 for the member grid: delete the removed members, then upsert.

    Unlike the activity grid nothing cascades and no id is repaired.
    """
    return upsert_rows(delete_removed(base, visible, edited, key), edited.select(*base.columns, seq), key, seq)


def save_counts(visible: DataFrame, edited: DataFrame, key: str) -> DataFrame:
    """What a save reports: (saved, deleted), the edited rows and the distinct keys removed."""
    saved = edited.agg(F.count(F.lit(1)).alias("saved"))
    deleted = removed_keys(visible, edited, key).agg(F.count(F.lit(1)).alias("deleted"))
    return saved.select("saved", deleted.scalar().alias("deleted"))


def save_table(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Write a new base to a fresh location (never in place)."""
    df.write.mode("errorifexists").format(fmt).save(path)
