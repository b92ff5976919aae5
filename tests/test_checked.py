"""Rejects, checked exports, the day rollup and the trigram index, on inputs made to break them."""

from __future__ import annotations

import datetime as dt
import pathlib
import random
import re

import pytest

from ridgeline.operators import aggs, filters, rollup, trigrams
from ridgeline.plans.catalog import MEMBER_PATTERN
from ridgeline.sources import checked, tables
from pyspark.sql import types as T

SCHEMA = T.StructType([T.StructField("k", T.LongType(), False), T.StructField("n", T.IntegerType()), T.StructField("d", T.DateType()), T.StructField("t", T.StringType())])
RAW = "k string, n string, d string, t string, extra string"


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_every_raw_row_is_good_or_has_rejects(spark):
    raw = [("1", "5", "2001-07-01", "x", "e"), (" 2 ", None, None, None, None), ("3", "5.5", "2001-02-30", "x", "e"), (None, "1", None, "", None),
           ("x", "99999999999", "yesterday", "y", None), ("", "", "", "", ""), ("3", "5.5", "2001-02-30", "x", "e")]
    good, bad = checked.conform_checked(spark.createDataFrame(raw, RAW), SCHEMA)
    assert good.dtypes == [(f.name, f.dataType.simpleString()) for f in SCHEMA.fields]
    assert rows(good) == [(1, 5, dt.date(2001, 7, 1), "x"), (2, None, None, None)]
    assert rows(bad) == sorted([
        *2 * [("3", "5.5", "2001-02-30", "x", "e", "n", "5.5", "malformed"), ("3", "5.5", "2001-02-30", "x", "e", "d", "2001-02-30", "malformed")],
        (None, "1", None, "", None, "k", None, "missing"),
        ("x", "99999999999", "yesterday", "y", None, "k", "x", "malformed"), ("x", "99999999999", "yesterday", "y", None, "n", "99999999999", "malformed"),
        ("x", "99999999999", "yesterday", "y", None, "d", "yesterday", "malformed"),
        ("", "", "", "", "", "k", "", "malformed"), ("", "", "", "", "", "n", "", "malformed"), ("", "", "", "", "", "d", "", "malformed")], key=str)


def test_a_missing_column_is_null_or_a_reject(spark):
    good, bad = checked.conform_checked(spark.createDataFrame([("a",)], "t string"), SCHEMA)
    assert rows(good) == [] and rows(bad) == [("a", "k", None, "missing")]
    good, bad = checked.conform_checked(spark.createDataFrame([("7",)], "k string"), SCHEMA)
    assert rows(good) == [(7, None, None, None)] and rows(bad) == []


@pytest.fixture
def export(spark, tmp_path):
    df = spark.createDataFrame([(i, i % 7 or None, dt.date(2001, 1, 1 + i % 28), random.Random(i).choice(["a\nb", "\\N", "", None, 'q"'])) for i in range(200)], SCHEMA)
    path = str(tmp_path / "out")
    checked.export_checked(df.repartition(4), path, preferred=["t"])
    return df, path


def files(path):
    return sorted(p for p in pathlib.Path(path).glob("part-*.csv"))


def test_an_export_is_restored_as_it_was(spark, export, tmp_path):
    df, path = export
    assert rows(checked.restore_checked(spark, path, SCHEMA, preferred=["t"])) == rows(df)
    report = checked.check_export(spark, path, SCHEMA, preferred=["t"]).collect()
    assert len(report) == 4 and all(r.ok for r in report) and sum(r.expected for r in report) == 200
    empty = str(tmp_path / "empty")
    checked.export_checked(df.limit(0), empty)
    assert checked.restore_checked(spark, empty, SCHEMA).count() == 0


@pytest.mark.parametrize("harm", ["lost", "cut", "twice", "changed", "swapped rows stay", "foreign"])
def test_harm_to_any_file_is_found(spark, export, harm):
    df, path = export
    first, second = files(path)[:2]
    for p in pathlib.Path(path).glob(".*.crc"):
        p.unlink()
    lines = first.read_text().split("\n")
    if harm == "lost":
        first.unlink()
    elif harm == "cut":
        first.write_text("\n".join(lines[:-5]) + "\n")
    elif harm == "twice":
        (first.parent / "part-99999.csv").write_text(first.read_text())
    elif harm == "changed":
        first.write_text(re.sub(r",(\d+),", lambda m: f",{int(m[1]) + 1},", first.read_text(), count=1))
    elif harm == "swapped rows stay":  # another order of the same rows is the same table
        first.write_text("\n".join([lines[0], *reversed(lines[1:-1]), ""]))
        assert rows(checked.restore_checked(spark, path, SCHEMA, preferred=["t"])) == rows(df)
        return
    else:
        first.write_text(second.read_text())
    with pytest.raises(checked.BrokenExport, match=r"part-"):
        checked.restore_checked(spark, path, SCHEMA, preferred=["t"])


def test_an_export_that_loses_rows_while_it_is_written_is_refused(spark, tmp_path, monkeypatch):
    df = spark.range(50).selectExpr("id AS k", "1 AS n", "DATE '2001-01-01' AS d", "'x' AS t")
    plain = checked.export_csv

    def lossy(t, path, preferred=()):
        plain(t, path, preferred)
        part = max(files(path), key=lambda p: p.stat().st_size)
        part.write_text("\n".join(part.read_text().split("\n")[:-2]) + "\n")
        (part.parent / f".{part.name}.crc").unlink()

    monkeypatch.setattr(checked, "export_csv", lossy)
    with pytest.raises(checked.BrokenExport):
        checked.export_checked(df, str(tmp_path / "x"))
    assert not (tmp_path / "x" / "_files").exists()


# ---- rollup

A = "event_id bigint, date date"


def test_a_rollup_with_late_and_withdrawn_rows_equals_direct_counts(spark, tmp_path):
    r = random.Random(3)
    acts = [(i, None if r.random() < 0.02 else dt.date(2000, 1, 1) + dt.timedelta(days=r.randrange(600))) for i in range(3000)]
    path = str(tmp_path / "rollup")
    for name, part, sign in (("a", acts[:2000], 1), ("b", acts[2000:], 1), ("gone", acts[100:400], -1)):
        assert rollup.add_batch(spark.createDataFrame(part, A), path, name, sign)
    assert not rollup.add_batch(spark.createDataFrame(acts, A), path, "b")  # a batch that is tried again counts once
    rollup.compact(spark, path, str(tmp_path / "small"))
    left = spark.createDataFrame(acts[:100] + acts[400:], A)
    for where in (path, str(tmp_path / "small")):
        got = rollup.read_rollup(spark, where)
        assert got.count() <= 601
        for as_of in ("2001-07-15", "2001-03-01", "1990-01-01", "2000-02-29"):  # cut-offs within and before the days
            assert rows(aggs.monthly_trend(got, as_of, 5, weight="n")) == rows(aggs.monthly_trend(left, as_of, 5))
            assert rows(aggs.annual_stats(got, as_of, weight="n")) == rows(aggs.annual_stats(left, as_of))
        assert rows(aggs.latest_months(got, 30, weight="n")) == rows(aggs.latest_months(left, 30))
    everything = str(tmp_path / "none")
    rollup.add_batch(left, everything, "in")
    rollup.add_batch(left, everything, "out", sign=-1)
    assert rollup.read_rollup(spark, everything).count() == 0


def test_a_batch_that_stops_halfway_is_not_counted(spark, tmp_path):
    from pyspark.sql import functions as F

    path = str(tmp_path / "rollup")
    acts = spark.createDataFrame([(1, dt.date(2001, 1, 1))], A)
    rollup.add_batch(acts, path, "a")
    broken = acts.withColumn("date", F.when(F.raise_error(F.lit("lost")).isNull(), F.col("date")))
    with pytest.raises(Exception, match="lost"):
        rollup.add_batch(broken, path, "b")
    assert rows(rollup.read_rollup(spark, path)) == [(dt.date(2001, 1, 1), 1)]
    assert rollup.add_batch(acts, path, "b") and rows(rollup.read_rollup(spark, path)) == [(dt.date(2001, 1, 1), 2)]


# ---- trigram index

TEXTS = ["Member 127", "household NATION_23", "houſehold ſtudent", "KELVIN", "İSTANBUL", "ıstanbul", "ab", "", None, "a.b*c (x)", "aaaa", "xyz|abc", "Straße", "abcabc", "ab\ncd efg", "éclair", "naïve text"]
PATTERNS = [MEMBER_PATTERN, "household", "student", "kelvin", "istanbul", "abc", "a\\.b\\*c", "ab?c", "aa+a", "(abc){0,1}x?yz", "xyz\\|abc", "[hm]ember 1", "^member", "127$", "b\\ncd", "stra.e",
            "éclair", "na.ve text", "abc|zz", "abcabcd|household n", "", "a", "(?i)abc", "\\x61bc", "ab\\dc|member", "memb.*27", "memb{1}er", "membe{0}", "house(hold|boat) nation", "zzzz", "[[a]bc]d"]


@pytest.mark.parametrize("pattern", PATTERNS)
def test_indexed_search_finds_what_a_scan_finds(spark, tmp_path, pattern):
    t = spark.createDataFrame([(i, x, TEXTS[-1 - i]) for i, x in enumerate(TEXTS)] + [(0, "household twice", None)], "k bigint, a string, b string")
    path = str(tmp_path / "index")
    trigrams.save_postings(t, "k", ["a", "b"], path)
    got = trigrams.search_indexed(t, spark.read.parquet(path), "k", ["a", "b"], pattern)
    assert rows(got) == rows(filters.text_search(t, ["a", "b"], pattern)), pattern
    assert rows(trigrams.search_indexed(t, spark.read.parquet(path), "k", ["a"], pattern)) == rows(filters.text_search(t, ["a"], pattern))


def test_literal_parts():
    assert trigrams.literal_parts(MEMBER_PATTERN) == [["member 1"], ["household nation_2"]]
    assert trigrams.literal_parts("ab?cde+f") == [["cde"]] and trigrams.literal_parts("x(yes|no)abc") == [["abc"]]
    assert trigrams.literal_parts("a|bcd") == [[], ["bcd"]] and trigrams.literal_parts("abc\\x41def") is None
    assert trigrams.literal_parts("[]abc]def") is None and trigrams.literal_parts("[a[bc]]def") is None
    assert trigrams.literal_parts("[^\\]]abc{2,}def") == [["ab"][:0] + ["def"]]


def test_only_candidates_are_tested_by_the_regex(spark, tmp_path):
    t = spark.range(5000).selectExpr("id AS k", "concat('text number ', id) AS a")
    path = str(tmp_path / "index")
    trigrams.save_postings(t, "k", ["a"], path)
    plan = trigrams.search_indexed(t, spark.read.parquet(path), "k", ["a"], "number 4321")._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftSemi" in plan
    index = spark.read.parquet(path)
    assert index.filter("trigram = '432'").count() < 100
    assert [r.k for r in trigrams.search_indexed(t, index, "k", ["a"], "number 4321").collect()] == [4321]
    assert trigrams.search_indexed(t, index, "k", ["a"], "not there").count() == 0


def test_types_of_the_members_schema_are_restored(spark, sf_small, tmp_path):
    m = tables.members(spark, sf_small)
    checked.export_checked(m, str(tmp_path / "m"))
    assert rows(checked.restore_checked(spark, str(tmp_path / "m"), tables.MEMBERS_SCHEMA)) == rows(m)
