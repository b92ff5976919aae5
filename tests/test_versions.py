"""The versioned store, the summary kept up to date, and pruning by a key bitmap."""

from __future__ import annotations

import datetime as dt
import random

import pytest

from ridgeline.operators import filters, joins, writes
from ridgeline.plans import summary
from ridgeline.sources import versions
from pyspark.sql import functions as F

A = "event_id bigint, date date, title string, host bigint, score int, album_url string"
AT = "event_id bigint, user_no bigint"
EDIT = "event_id string, date date, title string, host bigint, score int, album_url string, seq bigint"


def day(month, d=1):
    return dt.date(2001, month, d)


def activity(k, date, title="Peak", score=1, url=None):
    return (k, date, title, 1, score, url)


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


@pytest.fixture
def store(spark, tmp_path):
    acts = [activity(1, day(6)), activity(2, day(7)), activity(3, day(7, 9)), activity(4, day(8)), activity(5, None)]
    at = [(1, 10), (1, 11), (2, 10), (2, 10), (3, 12), (4, 13), (5, 14), (99, 15), (None, 16)]
    s = versions.ClubStore(spark, str(tmp_path / "club"))
    s.create(spark.createDataFrame(acts, A), spark.createDataFrame(at, AT))
    return s


def months_of(store, version=None):
    """(event, user) -> month as laid out, and as the activities say."""
    laid = rows(store.read("attendance", version=version))
    dates = {r.event_id: r.date for r in store.read("activities", version=version).collect()}
    for event, _, month in laid:
        date = dates.get(str(event))
        assert month == (f"{date:%Y-%m}" if date else None), (event, month)
    return laid


def grid(spark, store, month, edits, drop=()):
    """The month as shown, and edited: `edits` replace rows by key or add new ones."""
    shown = store.read("activities", [month])
    kept = [(*r, i) for i, r in enumerate(shown.orderBy("event_id").collect()) if r.event_id not in {e[0] for e in edits} | set(drop)]
    return shown, spark.createDataFrame(kept + [(*e[1:], 100 + i) for i, e in enumerate(edits)], EDIT)


def test_a_store_gives_back_its_tables_and_reads_one_month(store):
    assert len(months_of(store)) == 9 and store.versions() == [0]
    july = store.read("attendance", ["2001-07"])
    assert rows(july.drop("activity_month")) == [(2, 10), (2, 10), (3, 12)]
    assert all("_folder=2001-07/" in f for f in july.inputFiles()) and july.inputFiles()
    assert store.read("attendance", ["1999-01"]).count() == 0
    assert rows(store.read("attendance", [None]).select("user_no")) == [(14,), (15,), (16,)]


def test_a_grid_save_changes_both_tables_in_one_version(spark, store):
    before = {(e["table"], e["month"]): e["folder"] for e in store.folders(0)}
    edits = [("2", "2", day(7), "Ridge", 1, 5, None), ("new", "", day(7, 30), "New", 2, 3, "https://x/post/99/")]
    visible, edited = grid(spark, store, "2001-07", edits, drop=["3"])
    want_a, want_at = (rows(x) for x in writes.apply_grid_edits(store.read("activities"), store.read("attendance").drop("activity_month"), visible, edited))
    assert versions.save_activity_grid(store, 0, visible, edited) == 1
    assert rows(store.read("activities")) == want_a and rows(store.read("attendance").drop("activity_month")) == want_at
    laid = months_of(store)
    assert (99, 15, "2001-07") in laid and not [x for x in laid if x[0] == 3]  # the stray record has found its activity; the cascade took 3
    after = {(e["table"], e["month"]): e["folder"] for e in store.folders(1)}
    assert {k for k in before if before[k] != after.get(k)} == {("activities", "2001-07"), ("attendance", "2001-07"), ("attendance", None)}
    assert rows(store.read("activities", version=0)) != want_a and len(months_of(store, 0)) == 9  # a reader of version 0 is not disturbed


def test_a_save_follows_rows_and_keys_into_other_months(spark, store):
    edits = [("2", "2", day(9), "Moved", 1, 1, None), ("3", "4", day(7, 9), "Takes the key of August", 1, 1, None)]
    visible, edited = grid(spark, store, "2001-07", edits)
    want_a, want_at = (rows(x) for x in writes.apply_grid_edits(store.read("activities"), store.read("attendance").drop("activity_month"), visible, edited))
    versions.save_activity_grid(store, 0, visible, edited)
    assert rows(store.read("activities")) == want_a and rows(store.read("attendance").drop("activity_month")) == want_at
    laid = months_of(store)
    assert laid.count((2, 10, "2001-09")) == 2 and (4, 13, "2001-07") in laid
    assert store.read("activities", ["2001-08"]).count() == 0
    assert {e["month"] for e in store.folders(1) if e["table"] == "activities"} == {"2001-06", "2001-07", "2001-09", None}


def test_a_save_that_stops_halfway_leaves_the_old_version(spark, store, monkeypatch):
    before = rows(store.read("activities")), rows(store.read("attendance"))

    def stop(*_):
        raise OSError("lost")

    with monkeypatch.context() as m:
        m.setattr(store, "_publish", stop)
        with pytest.raises(OSError):
            versions.save_activity_grid(store, 0, *grid(spark, store, "2001-07", [("2", "2", day(7), "x", 1, 1, None)]))
    assert store.versions() == [0] and (rows(store.read("activities")), rows(store.read("attendance"))) == before
    assert versions.save_activity_grid(store, 0, *grid(spark, store, "2001-07", [("2", "2", day(7), "x", 1, 1, None)])) == 1


def test_of_two_saves_from_one_version_one_wins(spark, store, monkeypatch):
    first, second = (spark.createDataFrame([(2, 77 + i)], AT) for i in range(2))
    batch = spark.createDataFrame([(2,)], "event_id bigint")
    other = versions.ClubStore(spark, store.path)
    monkeypatch.setattr(other, "latest", lambda: 0)  # it has looked before the first save was published
    versions.save_attendance(store, 0, "2001-07", batch, first)
    with pytest.raises(versions.Conflict):
        versions.save_attendance(other, 0, "2001-07", batch, second)
    monkeypatch.undo()
    with pytest.raises(versions.Conflict):
        versions.save_attendance(store, 0, "2001-07", batch, second)
    assert store.versions() == [0, 1] and rows(store.read("attendance", ["2001-07"]).select("event_id", "user_no")) == [(2, 77), (3, 12)]
    kept = {e["folder"].split("/")[1] for v in (0, 1) for e in store.folders(v)}
    assert set(store._names("data")) == kept  # what the losing save wrote is gone
    versions.save_attendance(store, 1, "2001-07", batch, second)
    assert (2, 78, "2001-07") in months_of(store)


def test_month_saves_read_and_write_one_month(spark, store):
    untouched = [e for e in store.folders(0) if e["month"] != "2001-07"]
    versions.delete_activities(store, 0, "2001-07", spark.createDataFrame([("2",), ("4",)], "event_id string"))
    assert [e for e in store.folders(1) if e["month"] != "2001-07"] == untouched
    assert rows(store.read("attendance", ["2001-07"]).select("event_id")) == [(3,)] and store.read("activities", ["2001-08"]).count() == 1
    batch = spark.createDataFrame([(3,), (4,), (5,)], "event_id bigint")  # 4 and 5 lie elsewhere
    versions.save_attendance(store, 1, "2001-07", batch, spark.createDataFrame([(4, 1), (3, 20), (3, 20)], AT))
    assert rows(store.read("attendance", ["2001-07"]).select("event_id", "user_no")) == [(3, 20)]
    assert (4, 13, "2001-08") in months_of(store)
    versions.save_attendance(store, 2, "2001-07", batch, spark.createDataFrame([], AT))
    assert store.read("attendance", ["2001-07"]).count() == 0 and len(months_of(store)) == 6


def test_old_versions_can_be_forgotten(spark, store):
    batch = spark.createDataFrame([(2,)], "event_id bigint")
    for i in range(3):
        versions.save_attendance(store, i, "2001-07", batch, spark.createDataFrame([(2, 70 + i)], AT))
    want = [months_of(store, v) for v in (2, 3)]
    n = len(list(store.read("attendance").inputFiles()))
    store.keep_newest(2)
    assert store.versions() == [2, 3] and [months_of(store, v) for v in (2, 3)] == want and len(list(store.read("attendance").inputFiles())) == n


# ---- the summary kept up to date

def random_club(seed):
    r = random.Random(seed)
    acts = [(k, r.choice([None, dt.date(2001, r.randrange(1, 13), r.randrange(1, 28))]) if r.random() < 0.1 else dt.date(2001, r.randrange(1, 10), r.randrange(1, 28)),
             "t", 1, r.choice([None, 1, 2, 3]), None) for k in range(25)]
    at = [(r.randrange(27), r.choice([None, *range(12)])) for _ in range(150)]
    return r, acts, at


@pytest.mark.parametrize("seed", range(6))
def test_updated_figures_equal_a_full_recompute(spark, seed):
    r, acts, at = random_club(seed)
    a, as_of = spark.createDataFrame(acts, A), "2001-07-15"
    state = summary.score_state(a, spark.createDataFrame(at, AT), as_of)
    for _ in range(2):  # a state that was updated is updated again
        gone = r.sample(at, 40)
        came = [(r.randrange(27), r.choice([None, *range(15)])) for _ in range(30)] + r.sample(gone, 15)  # some go and come back
        left = list(at)
        for x in gone:
            left.remove(x)
        at = left + came
        frame = lambda x: summary.visits(a, spark.createDataFrame(x, AT))  # noqa: E731, B023
        state = summary.update_scores(state, frame(came), frame(gone), frame(at), as_of)
        full = summary.score_state(a, spark.createDataFrame(at, AT), as_of)
        assert rows(state.select(full.columns)) == rows(full)


def test_a_changed_activity_is_a_visit_that_goes_and_one_that_comes(spark):
    old = spark.createDataFrame([activity(1, day(3), score=1), activity(2, day(5), score=2)], A)
    new = spark.createDataFrame([activity(1, day(6), score=5), activity(2, day(5), score=2)], A)
    at = spark.createDataFrame([(1, 10), (2, 10), (1, 11)], AT)
    hit = at.filter("event_id = 1")
    got = summary.update_scores(summary.score_state(old, at, "2001-07-15"), summary.visits(new, hit), summary.visits(old, hit), summary.visits(new, at), "2001-07-15")
    assert rows(got) == rows(summary.score_state(new, at, "2001-07-15")) == [(10, 7, 0, day(6), day(5), 2), (11, 5, 0, day(6), day(6), 1)]


def test_only_members_who_lost_an_outer_date_are_looked_up_again(spark):
    a = spark.createDataFrame([activity(k, day(k)) for k in range(1, 7)], A)
    at = spark.createDataFrame([(k, u) for k in range(1, 7) for u in (10, 11)], AT)
    nothing = summary.visits(a, spark.createDataFrame([], AT))
    gone = summary.visits(a, spark.createDataFrame([(3, 10)], AT))
    # `now` is empty: whoever is looked up again loses the dates, so nobody was
    kept = summary.update_scores(summary.score_state(a, at, "2001-07-15"), nothing, gone, nothing, "2001-07-15")
    assert all(r.first_date == day(1) and r.last_attended == day(6) for r in kept.collect())
    lost = summary.update_scores(summary.score_state(a, at, "2001-07-15"), nothing, summary.visits(a, spark.createDataFrame([(6, 10)], AT)), nothing, "2001-07-15")
    assert {r.user_no: r.last_attended for r in lost.collect()} == {10: None, 11: day(6)}


# ---- pruning by a bitmap of keys

@pytest.mark.parametrize("ids", [[], [5], [None, 7], list(range(0, 10**6, 997)), [-(2**60), 2**62, 0, 12]])
def test_pruning_keeps_all_records_of_the_keys_and_few_others(spark, ids):
    at = spark.range(0, 200000, 1, 4).select((F.col("id") * 5).alias("event_id"), F.col("id").alias("user_no")).union(
        spark.createDataFrame([(None, 1), (2**62, 2), (-(2**60), 3)], AT))
    keys = spark.createDataFrame([(i,) for i in ids], "event_id bigint")
    pruned = filters.prune_by_keys(at, keys)
    assert pruned.columns == at.columns
    assert rows(pruned.join(keys, "event_id", "left_semi")) == rows(at.join(keys, "event_id", "left_semi"))
    assert pruned.count() <= len(ids) + 200003 * (len(ids) / (filters.BITMAP_ROWS * 32768) * 2 + 0.0001)


def test_the_bitmap_is_tested_below_the_exchange_and_bounded(spark, monkeypatch):
    monkeypatch.setattr(filters, "BITMAP_ROWS", 2)  # far more keys than bits: nothing is dropped, nothing is wrong
    keys = spark.range(300000).select(F.col("id").alias("event_id"))
    at = spark.range(0, 400000).select(F.col("id").alias("event_id"), F.lit(1).alias("user_no"))
    assert filters.id_bitmap(keys).count() == 2
    assert filters.prune_by_keys(at, keys).join(keys, "event_id").count() == 300000


def test_pruned_plan_shuffles_after_the_bitmap(spark, sf_small):
    from ridgeline.sources import tables

    c = tables.load_club(spark, sf_small)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # a month too large to broadcast
    try:
        plan = joins.activity_attendees(c["activities"], c["attendance"], c["members"], "2001-07", prune=True)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    at = plan.index("Scan parquet", plan.index("bit_get" if "bit_get" in plan else "getbit"))
    assert "BroadcastHashJoin" in plan[:at] and "SortMergeJoin" in plan
