"""Benchmark decontamination by a prefix-filtered containment join, in DataFrame operations.

Every window of `window` consecutive words of a benchmark item (the whole item
if it has fewer) is sought in the documents. The shingles of the join are single
words. A document that contains a window contains its rarest word, so with exact
containment the necessary prefix of a window is one word: words are counted over
all documents, and each window is filed under its rarest one with that word's
offset. Documents' words meet this list in one join; length and position bounds
and the comparison with the document's words at that place (exact, word by word)
stand in the join condition, so only true occurrences leave it.

Documents are never shuffled: both passes over them join their words with a
table derived from the benchmark, which is broadcast. Its size is checked: the
windows are dealt into blocks of `BLOCK_BYTES` of words on average, and each
block is joined by itself, so a larger benchmark means more passes, not a larger
broadcast. A window stands in it once, under a hash of its words, however many
items share it; which items have which window is a table of rows, which meets the
documents' distinct sets of windows by a shuffle join. What is shuffled besides are a
row per document and its occurrences.

Input cases: a null or empty text has no words, and a null or empty item no
windows. Rows that repeat get the same result. An item without id can hit words
but is not counted as an item. Items that repeat have the same windows; each
counts. Without a benchmark no document is hit. Other columns are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import scratch_table
from . import common as C

WINDOW = 13
BLOCK_BYTES = 16 << 20
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
END = "\u0000"  # no word holds it; it stands behind the last word of each document


def words(text: Column) -> Column:
    """The words of a text: runs of a-z, 0-9 and all characters beyond ASCII, after A-Z are lower-cased."""
    return F.array_remove(F.split(C.ascii_lower(F.coalesce(text, F.lit(""))), SEPARATORS), "")


def item_windows(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """(item_id, wid, win): the windows of each item, arrays of words, and a 128-bit hash of their words."""
    w = benchmark.select("item_id", words(F.col("text")).alias("words")).filter(F.size("words") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("words") - window + 1, F.lit(1)))
    return (w.select("item_id", "words", F.explode(starts).alias("at"))
            .select("item_id", F.slice("words", F.col("at"), window).alias("win"))
            .select("item_id", F.unhex(F.md5(F.array_join("win", " "))).alias("wid"), "win"))


def _filed(windows: DataFrame, docs: DataFrame) -> DataFrame:
    """(word, offset, len, win, wid): each window under the word of it that is rarest in the documents.

    `windows` (a block, so its words are few enough to be sent to all tasks) has each window once.
    """
    vocabulary = windows.select(F.explode("win").alias("word")).distinct()
    counts = (docs.select(F.explode(words(F.col("text"))).alias("word"))
              .join(F.broadcast(vocabulary), "word").groupBy("word").agg(F.count(F.lit(1)).alias("n")))
    spread = windows.select("wid", "win", F.posexplode("win").alias("offset", "word"))
    ranked = spread.join(F.broadcast(counts), "word", "left")
    # a window with a word that no document has occurs nowhere
    rarest = F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "word", "offset"))
    filed = ranked.groupBy("wid").agg(rarest.alias("r"), F.first("win").alias("win")).filter("r.n > 0")
    return filed.select("r.word", "r.offset", F.size("win").alias("len"), "win", "wid")


def occurrences(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, row key, n_words, start, len and wid of every window occurrence, and one row per document with len 0."""
    windows = item_windows(benchmark, window).groupBy("wid").agg(F.first("win").alias("win"))
    size = windows.agg(F.sum(F.octet_length(F.concat_ws(" ", "win")) + 32)).first()[0] or 0
    blocks = -(-size // block_bytes) or 1
    spaced = docs.select("doc_id", C.text_key().alias(C.KEY), words(F.col("text")).alias("words"))
    exploded = spaced.select("doc_id", C.KEY, "words", F.size("words").alias("n_words"),
                             F.posexplode(F.array_append("words", END)).alias("pos", "word"))
    end = (docs.sparkSession.range(1).select(F.lit(END).alias("word"), F.lit(0).alias("offset"), F.lit(0).alias("len"),
                                             F.array().cast("array<string>").alias("win"), F.lit(None).cast("binary").alias("wid")))
    found = []
    for b in range(blocks):
        part = windows if blocks == 1 else windows.filter(F.pmod(F.xxhash64("wid"), F.lit(blocks)) == b)
        filed = _filed(part, docs)
        filed = F.broadcast(filed.union(end) if b == 0 else filed).alias("f")
        start = F.col("pos") - F.col("offset")
        same = (start >= 0) & (start + F.col("len") <= F.col("n_words")) & (F.slice("words", F.greatest(start, F.lit(0)) + 1, F.col("len")) == F.col("win"))
        found.append(exploded.join(filed, (exploded["word"] == F.col("f.word")) & ((F.col("len") == 0) | same))
                     .select("doc_id", C.KEY, "n_words", start.alias("start"), "len", "wid"))
    return reduce(DataFrame.union, found)


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, row key, copies, n_words, n_hit and wids (the windows that occur, sorted) for each different (doc_id, text)."""
    order = W.partitionBy("doc_id", C.KEY).orderBy("start", "len").rowsBetween(W.unboundedPreceding, -1)
    end = F.col("start") + F.col("len")
    # a row with len 0 starts behind the last word and covers nothing
    new = F.greatest(end - F.greatest(F.col("start"), F.coalesce(F.max(end).over(order), F.lit(0))), F.lit(0))
    return (occurrences(docs, benchmark, window, block_bytes).withColumn("new", new)
            .groupBy("doc_id", C.KEY).agg(
                F.count_if(F.col("len") == 0).alias("copies"), F.max("n_words").cast("long").alias("n_words"), F.sum("new").cast("long").alias("n_hit"),
                F.array_sort(F.collect_set("wid")).alias("wids")))  # no more than a text has places


def with_items(found: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """`contamination` with items: the ids of the items whose windows occur, as sorted strings.

    Documents with the same windows have the same items, so each distinct set of
    windows is joined with the windows' items once, however many documents have it.
    """
    marked = found.withColumn("_set", F.when(F.size("wids") > 0, F.md5(F.array_join(F.transform("wids", F.hex), " "))))
    sets = marked.filter("_set IS NOT NULL").select("_set", "wids").dropDuplicates(["_set"]).select("_set", F.explode("wids").alias("wid"))
    of_window = item_windows(benchmark, window).filter("item_id IS NOT NULL").select("wid", F.col("item_id").cast("string").alias("item")).distinct()
    items = sets.join(of_window, "wid").groupBy("_set").agg(F.array_sort(F.collect_set("item")).alias("items"))
    none = F.array().cast("array<string>")
    # documents without a window stay out of the join: their null sets would meet in one task
    hit = marked.filter("_set IS NOT NULL").join(items, "_set", "left").withColumn("items", F.coalesce("items", none)).drop("_set", "wids")
    return hit.unionByName(marked.filter("_set IS NULL").withColumn("items", none).drop("_set", "wids"))


def is_contaminated() -> Column:
    return (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs that are not contaminated, with the columns of docs."""
    bad = contamination(docs, benchmark).filter(is_contaminated()).select("doc_id", C.KEY)
    return C.with_decisions(docs, bad, "left_anti")


def op6_prefix_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    benchmark = C.table(spark, sf_dir, "benchmark")
    found = with_items(scratch_table(contamination(C.table(spark, sf_dir, "documents"), benchmark), "contamination"), benchmark)
    rows = found.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    return rows.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                       F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), is_contaminated().alias("contaminated"))


OP6_SQL = r"""
WITH d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS words FROM documents
), b AS (
  SELECT item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS words FROM benchmark
), w AS (
  SELECT DISTINCT item_id, words[i0:i0 + 12] AS win
  FROM (SELECT item_id, words, unnest(range(1, greatest(len(words) - 12, 1) + 1)) AS i0 FROM b WHERE len(words) > 0)
), lens AS (SELECT DISTINCT len(win) AS n FROM w), g AS (
  SELECT doc_id, i0, n, words[i0:i0 + n - 1] AS win
  FROM (SELECT doc_id, words, n, unnest(range(1, len(words) - n + 2)) AS i0 FROM d, lens WHERE len(words) >= n)
), hit AS (SELECT doc_id, i0, n, item_id FROM g JOIN w USING (win)),
covered AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i0, i0 + n)) AS p FROM hit) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS ids
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS i FROM hit WHERE item_id IS NOT NULL) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(words) AS contaminated
FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN items USING (doc_id)
"""
