"""A club store with versions: activities and attendance are saved together or not at all.

Both tables lie in folders by the activity's month. A version is one small file that
lists, for each table and month, the folders that hold it. A save writes new folders
for the months it changes, and then publishes the next version by one rename that
fails if that version exists:

* a save that stops halfway has published nothing, so readers stay on the old version;
* of two saves that started from the same version one wins, the other gets `Conflict`
  and can be made again from the newer version;
* a reader keeps its version while others save, since no folder is ever changed.

A month's rows are found through the list, so reading or saving one month opens that
month's folders and no others. Lists grow with the number of months, not of rows.

Activities keep their keys as text (as the grid hands them back); attendance lies under
its activity's month, records without an activity (or whose activity has no date)
under no month.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import expr as X
from ..operators import writes
from ..operators.filters import ACTIVITY_MONTH
from ..session import scratch_table
from .tables import ACTIVITIES_SCHEMA, ATTENDANCE_SCHEMA

SCHEMAS = {
    "activities": T.StructType([T.StructField("event_id", T.StringType()), *ACTIVITIES_SCHEMA.fields[1:]]),
    "attendance": T.StructType([*ATTENDANCE_SCHEMA.fields, T.StructField(ACTIVITY_MONTH, T.StringType())]),
}
NO_MONTH = "__HIVE_DEFAULT_PARTITION__"  # the folder name that Spark gives to a NULL partition value
_FOLDER = "_folder"


class Conflict(RuntimeError):
    """Another save has published a version since the one that this save started from."""


class ClubStore:
    """`path` must be on storage that driver and executors share, with a rename that takes effect at once (as on HDFS)."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        hadoop = spark._jvm.org.apache.hadoop.fs
        self._at = hadoop.Path
        self._fs = hadoop.Path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())
        self._context = hadoop.FileContext.getFileContext(hadoop.Path(self.path).toUri(), spark._jsc.hadoopConfiguration())
        self._plain_rename = spark._sc._gateway.new_array(spark._jvm.org.apache.hadoop.fs.Options.Rename, 0)

    # ---- versions

    def _names(self, folder: str) -> list[str]:
        at = self._at(f"{self.path}/{folder}")
        return sorted(s.getPath().getName() for s in self._fs.listStatus(at)) if self._fs.exists(at) else []

    def versions(self) -> list[int]:
        """The published versions, oldest first."""
        return [int(n) for n in self._names("versions") if n.isdigit()]

    def latest(self) -> int:
        return self.versions()[-1]

    def folders(self, version: int) -> list[dict]:
        """The list of a version: table, month (None: no month) and folder."""
        at = f"{self.path}/versions/{version:08d}"
        return [json.loads(r.value) for r in self.spark.read.text(at).collect()]  # one line for each table, month and save

    def _publish(self, version: int, entries: list[dict]) -> None:
        draft = f"{self.path}/drafts/{uuid.uuid4().hex}"
        lines = [(json.dumps(e),) for e in entries] or [(None,)]
        self.spark.createDataFrame(lines, "value string").filter("value IS NOT NULL").coalesce(1).write.text(draft)
        self._fs.mkdirs(self._at(f"{self.path}/versions"))
        try:  # a rename that does not replace: the one step that makes a version
            self._context.rename(self._at(draft), self._at(f"{self.path}/versions/{version:08d}"), self._plain_rename)
        except Exception as e:
            self._fs.delete(self._at(draft), True)
            if self._fs.exists(self._at(f"{self.path}/versions/{version:08d}")):
                raise Conflict(f"version {version} of {self.path} exists; save again from the newest version") from e
            raise

    # ---- reading

    def read(self, table: str, months: Iterable[str | None] | None = None, version: int | None = None) -> DataFrame:
        """A table of a version (default: the newest), whole or only some months of it."""
        version = self.latest() if version is None else version
        wanted = None if months is None else set(months)
        found = [e["folder"] for e in self.folders(version) if e["table"] == table and (wanted is None or e["month"] in wanted)]
        if not found:
            return self.spark.createDataFrame([], SCHEMAS[table])
        return self.spark.read.schema(SCHEMAS[table]).parquet(*[f"{self.path}/{f}" for f in found])

    # ---- saving

    def commit(self, base: int | None, replaced: Mapping[str, Iterable[str | None]], added: Mapping[str, DataFrame], spread: bool = False) -> int:
        """Publish the version after `base`: drop the months `replaced` of each table and add the rows `added`.

        Rows are laid under their month by the tables' rules; a month that is not
        replaced keeps its rows besides the added ones. `spread` deals the rows
        over all tasks by month and key, for saves of many months.
        """
        if base is not None and self.latest() != base:
            raise Conflict(f"version {self.latest()} of {self.path} is newer than {base}")
        save = f"data/{uuid.uuid4().hex}"
        entries = [e for e in (self.folders(base) if base is not None else []) if e["month"] not in set(replaced.get(e["table"], ()))]
        for table, rows in added.items():
            month = F.col(ACTIVITY_MONTH) if table == "attendance" else X.month_text("date")
            rows = rows.select(*SCHEMAS[table].fieldNames()).withColumn(_FOLDER, month)
            if spread:
                rows = rows.repartitionByRange(_FOLDER, *[c for c in ("event_id", "user_no") if c in rows.columns])
            rows.write.partitionBy(_FOLDER).parquet(f"{self.path}/{save}/{table}")
            names = [n.partition("=")[2] for n in self._names(f"{save}/{table}") if n.startswith(f"{_FOLDER}=")]
            entries += [{"table": table, "month": None if n == NO_MONTH else n, "folder": f"{save}/{table}/{_FOLDER}={n}"} for n in names]
        version = 0 if base is None else base + 1
        try:
            self._publish(version, entries)
        except Conflict:
            self._fs.delete(self._at(f"{self.path}/{save}"), True)
            raise
        return version

    def create(self, a: DataFrame, at: DataFrame) -> int:
        """Version 0 from plain activities and attendance."""
        months = a.select("event_id", X.month_text("date").alias(ACTIVITY_MONTH))
        return self.commit(None, {}, {"activities": a.withColumn("event_id", F.col("event_id").cast("string")),
                                      "attendance": at.select("event_id", "user_no").join(months, "event_id", "left")}, spread=True)

    def keep_newest(self, n: int = 2) -> None:
        """Forget all versions but the newest n, and delete the folders that only forgotten versions list."""
        versions = self.versions()
        old, new = versions[:-n], versions[-n:]
        used = {e["folder"] for v in new for e in self.folders(v)}
        gone = {e["folder"] for v in old for e in self.folders(v)} - used
        for v in old:
            self._fs.delete(self._at(f"{self.path}/versions/{v:08d}"), True)
        for folder in gone:
            self._fs.delete(self._at(f"{self.path}/{folder}"), True)


def _months_of(rows: DataFrame, column) -> set[str | None]:
    return {r[0] for r in rows.select(column).distinct().collect()}  # no more rows than the calendar has months


def save_activity_grid(store: ClubStore, version: int, visible: DataFrame, edited: DataFrame, seq: str = "seq") -> int:
    """Save the activity grid that was shown from `version`; activities and attendance change in one commit.

    The months that a save touches are those of the edited rows, and those in which
    activities with a removed or saved key lie: an edit may move an activity to
    another month, its attendance moves with it, and a key that a row is given may
    belong to an activity elsewhere. Records without an activity join a month when a
    saved key is theirs. All other months keep their folders.
    """
    gone = writes.removed_keys(visible, edited, "event_id")
    saved = scratch_table(writes.extract_event_id(edited, "event_id").select("event_id", "date"), "saved-keys")
    keys = gone.select("event_id").union(saved.select("event_id")).distinct()
    held = store.read("activities", version=version).select("event_id", "date").join(keys, "event_id", "left_semi")
    touched = _months_of(held.select("date").union(saved.select("date")), X.month_text("date"))
    strays = store.read("attendance", [None], version).select(F.col("event_id").cast("string").alias("event_id")).join(saved, "event_id", "left_semi")
    lists = touched | ({None} if strays.limit(1).count() else set())
    at = store.read("attendance", lists, version).select("event_id", "user_no")
    new_a, new_at = writes.apply_grid_edits(store.read("activities", touched, version), at, visible, edited, "event_id", seq)
    new_a = scratch_table(new_a, "saved-activities")
    months = new_a.select(F.col("event_id").alias("_k"), X.month_text("date").alias(ACTIVITY_MONTH))
    new_at = new_at.join(months, F.col("event_id").cast("string") == F.col("_k"), "left").drop("_k")
    return store.commit(version, {"activities": touched, "attendance": lists}, {"activities": new_a, "attendance": new_at})


def delete_activities(store: ClubStore, version: int, month: str, removed: DataFrame) -> int:
    """Remove activities of a month (keys as text in `event_id`) and their attendance; only that month is read or written."""
    gone = removed.select(F.col("event_id").cast("string").alias("event_id"))
    acts = store.read("activities", [month], version).join(gone, "event_id", "left_anti")
    return store.commit(version, {"activities": [month], "attendance": [month]},
                        {"activities": acts, "attendance": writes.cascade_delete(store.read("attendance", [month], version), gone)})


def save_attendance(store: ClubStore, version: int, month: str, batch: DataFrame, selections: DataFrame) -> int:
    """Replace the attendance of activities of one month (`batch`: event_id) by the selections (event_id, user_no).

    Activities of the batch that do not lie in the month are ignored. Only that month is read or written.
    """
    here = store.read("activities", [month], version).select(F.expr("try_cast(event_id AS bigint)").alias("event_id"))
    new = writes.replace_attendance(store.read("attendance", [month], version).select("event_id", "user_no"),
                                    batch.select("event_id").join(here, "event_id", "left_semi"), selections)
    return store.commit(version, {"attendance": [month]}, {"attendance": new.withColumn(ACTIVITY_MONTH, F.lit(month))})
