"""Removal of passages that repeat, by overlapping windows of three lines.

Every run of `LINES` consecutive lines is hashed (128 bits). Windows that occur
more than once in the corpus are found by one aggregation, which also gives the
first occurrence (by doc_id, row key, line). Later occurrences are removed: the
lines they cover are merged per document and the rest is put together again. An
occurrence that overlaps the first one within a document stays, so that the
first occurrence is never broken up.

Hot windows are combined before the shuffle; the join that returns to the
occurrences has one row per window on its other side, so a hot window's
occurrences can be split over tasks. Texts are read for the hashes and, by a
join on row keys, for the documents that lose lines.

Input cases: a null text stays null and has no lines; a text with fewer lines is
one window of all its lines, so a later copy of it loses them all and stays as
an empty text; windows without a word are ignored. Rows that agree in doc_id and
text are one occurrence and lose the same lines. Long texts are handled like
others. A null doc_id comes first. Other columns are kept by `drop_repeats` and
ignored otherwise.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C

LINES = 3


def line_windows(docs: DataFrame, lines: int = LINES) -> DataFrame:
    """doc_id, row key, line (of the first, from 0), size (in lines) and hash of each window that has a word."""
    split = docs.filter("text IS NOT NULL").select("doc_id", C.text_key().alias(C.KEY), F.split("text", "\n").alias("lines"))
    starts = F.sequence(F.lit(1), F.greatest(F.size("lines") - (lines - 1), F.lit(1)))
    window = F.array_join(F.slice("lines", F.col("line"), lines), "\n")
    return (split.select("doc_id", C.KEY, "lines", F.explode(starts).alias("line"))
            .select("doc_id", C.KEY, (F.col("line") - 1).alias("line"), F.least(F.size("lines"), F.lit(lines)).alias("size"), window.alias("window"))
            .filter(F.col("window").rlike(r"[^\x20\x09-\x0D]"))
            .select("doc_id", C.KEY, "line", "size", F.unhex(F.md5("window")).alias("hash")))


def repeated_lines(docs: DataFrame, lines: int = LINES) -> DataFrame:
    """doc_id, row key and the line numbers (sorted array `gone`) that later occurrences cover, where there are any."""
    found = line_windows(docs, lines)
    first = (found.groupBy("hash").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("doc_id", C.KEY, "line")).alias("first"))
             .filter("n > 1").select("hash", "first"))
    same_row = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col(C.KEY) == F.col(f"first.{C.KEY}"))
    later = found.join(first, "hash").filter(~same_row | (F.col("line") >= F.col("first.line") + lines))
    covered = later.select("doc_id", C.KEY, F.explode(F.sequence(F.col("line"), F.col("line") + F.col("size") - 1)).alias("line"))
    return covered.groupBy("doc_id", C.KEY).agg(F.array_sort(F.collect_set("line")).alias("gone"))  # lines of one text


def drop_repeats(docs: DataFrame, lines: int = LINES) -> DataFrame:
    """docs with later occurrences cut out of text, and n_lines and n_gone (in place of columns so named)."""
    gone = C.free_name(docs, "gone")
    joined = C.with_decisions(docs, repeated_lines(docs, lines).withColumnRenamed("gone", gone), "left")
    split = F.split("text", "\n")
    # the lines that go are looked up in a map, so that a text costs as much as it is long
    mapped = F.map_from_arrays(F.col(gone), F.transform(gone, lambda x: F.lit(True)))
    kept = F.filter(split, lambda _, i: ~F.map_contains_key(mapped, i))
    text = F.when(F.col(gone).isNull(), F.col("text")).otherwise(F.array_join(kept, "\n"))
    others = [c for c in docs.columns if c not in ("text", "n_lines", "n_gone")]
    return joined.select(*others, text.alias("text"), F.coalesce(F.size(split), F.lit(0)).cast("long").alias("n_lines"),
                         F.coalesce(F.size(gone), F.lit(0)).cast("long").alias("n_gone"))


def op3_line_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = drop_repeats(C.table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_gone", F.length("text").cast("long").alias("n_chars"), F.md5("text").alias("text_md5"))


OP3_SQL = r"""
WITH d AS (SELECT doc_id, text, string_split(text, chr(10)) AS lines FROM documents),
w AS (
  SELECT doc_id, i, least(len(lines), 3) AS size, array_to_string(lines[i + 1:i + 3], chr(10)) AS win
  FROM (SELECT doc_id, lines, unnest(range(0, greatest(len(lines) - 2, 1))) AS i FROM d WHERE text IS NOT NULL)
), v AS (SELECT * FROM w WHERE regexp_matches(win, '[^\x20\x09-\x0D]')),
r AS (
  SELECT doc_id, i, size, first_value(doc_id) OVER o AS d0, first_value(i) OVER o AS i0
  FROM v WINDOW o AS (PARTITION BY win ORDER BY doc_id NULLS FIRST, i)
), gone AS (
  SELECT doc_id, list(DISTINCT p) AS gone
  FROM (SELECT doc_id, unnest(range(i, i + size)) AS p FROM r WHERE doc_id IS DISTINCT FROM d0 OR i >= i0 + 3) GROUP BY doc_id
), t AS (
  SELECT d.doc_id, coalesce(len(lines), 0) AS n_lines, coalesce(len(gone), 0) AS n_gone,
    CASE WHEN gone IS NULL THEN text ELSE array_to_string(list_filter(lines, lambda x, k: NOT list_contains(gone, k - 1)), chr(10)) END AS text
  FROM d LEFT JOIN gone ON d.doc_id IS NOT DISTINCT FROM gone.doc_id
)
SELECT doc_id, CAST(n_lines AS BIGINT) AS n_lines, CAST(n_gone AS BIGINT) AS n_gone, CAST(length(text) AS BIGINT) AS n_chars, md5(text) AS text_md5 FROM t
"""
