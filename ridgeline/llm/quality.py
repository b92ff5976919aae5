"""Quality rules with an isolation forest over rule statistics.

Each text gets rule statistics (words, symbols, repeated lines and windows,
capitals, ...). Texts that fail the base rules are rejected. For the others an
isolation forest judges: random splits over the statistics isolate unusual
documents after few splits, so a short mean path means an anomaly. Trees are
grown on a bounded sample of rows labelled good (about `MAX_TRAIN`, the rows
with the smallest id hashes); split points are drawn from the range that all labelled
rows span, so that regions without good rows are cut off early. The path
threshold is calibrated on all labelled rows: of the thresholds that keep at
least `KEEP_GOOD` of the good rows, the one that rejects most bad rows.

One pass over the texts writes the statistics (a row of numbers per document)
to the shared folder; training, calibration and scoring read that table.

Input cases: a null text has no words and fails the base rules; very long texts
are handled in one chunk each; rows that repeat are judged alike; without
labelled good rows the base rules decide alone, without bad ones nothing that
good rows span is rejected. Other columns of the inputs are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_table
from . import common as C
from . import textnp as T

MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
MAX_TRAIN = 20_000
TREES, SUBSAMPLE, DEPTH = 100, 256, 9
KEEP_GOOD = 0.995
SEED = 20

_SYMBOL = np.isin(np.arange(256), np.frombuffer(b"#*$%&|<>", np.uint8))
_UPPER = (np.arange(256) >= 65) & (np.arange(256) <= 90)
_ALNUM = np.isin(np.arange(256), np.frombuffer(b"0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ", np.uint8)) | (np.arange(256) >= 128)
_DIGIT = (np.arange(256) >= 48) & (np.arange(256) <= 57)
_LEAD = (np.arange(256) & 0xC0) != 0x80  # the first byte of a code point
_END = np.isin(np.arange(256), np.frombuffer(b"!?.:;,", np.uint8))

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_digits", "n_bare", "n_marks")
FEATURES = ("f_words", "f_word_len", "f_symbols", "f_dup_lines", "f_repeat", "f_upper", "f_digits", "f_bare", "f_marks", "f_line_words")


def chunk_counts(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """The counts of each row of a chunk; see op7's contract for the first five."""
    rows = len(offsets) - 1
    starts, ends, first = T.word_bounds(data, offsets)
    per_row = lambda mask: np.diff(T.running(mask)[offsets])
    in_word = ~T.SPACE[data]
    out = {"n_words": np.diff(first), "word_chars": per_row(in_word & _LEAD[data]), "n_symbols": per_row(_SYMBOL[data]),
           "n_upper": per_row(_UPPER[data]), "n_digits": per_row(_DIGIT[data]), "n_marks": per_row(_END[data])}
    alnum = T.running(_ALNUM[data])
    bare = T.running(alnum[ends] == alnum[starts])  # words without a letter or digit
    out["n_bare"] = np.diff(bare[first])
    lo, hi, row = T.line_bounds(data, offsets)
    inside = T.running(in_word)
    has_word = inside[hi] > inside[lo]
    lo, hi, row = lo[has_word], hi[has_word], row[has_word]
    out["n_lines"] = np.bincount(row, minlength=rows)
    _, different, _ = T.distinct(T.hash_spans(data, lo, hi), row)
    out["n_dup_lines"] = out["n_lines"] - np.bincount(different, minlength=rows)
    hashes, row, at = T.windows(T.hash_spans(data, starts, ends), first, 5)
    order = np.lexsort((hashes, row))
    h, r = hashes[order], row[order]
    same = (h[1:] == h[:-1]) & (r[1:] == r[:-1])
    again = np.zeros(len(h), bool)
    again[1:] |= same
    again[:-1] |= same
    step = np.zeros(len(starts) + 1, np.int64)
    np.add.at(step, at[order][again], 1)
    np.add.at(step, at[order][again] + 5, -1)
    covered = T.running(np.cumsum(step)[:-1] > 0)
    out["n_repeat_words"] = np.diff(covered[first])
    return out


def _count_batches(batches):
    for batch in batches:
        for lo, hi, data, offsets in T.chunks(batch.column("text")):
            counts = chunk_counts(data, offsets)
            part = batch.slice(lo, hi - lo)
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), part.column(C.KEY)] + [pa.array(counts[c], pa.int64()) for c in COUNTS],
                names=["doc_id", C.KEY, *COUNTS])


def statistics(docs: DataFrame) -> DataFrame:
    """doc_id, row key, the counts, base_failed and the forest's statistics, a row per document."""
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, {C.KEY} bigint, " + ", ".join(f"{c} bigint" for c in COUNTS)
    counts = scratch_table(C.keyed(docs).mapInArrow(_count_batches, schema), "quality-counts")
    n = F.greatest(F.col("n_words"), F.lit(1))
    chars = F.greatest(F.col("word_chars"), F.lit(1))
    return counts.withColumns({
        "base_failed": (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words")),
        "f_words": F.log1p(n.cast("double")), "f_word_len": F.log1p(F.col("word_chars") / n),
        "f_symbols": F.log1p(F.col("n_symbols") / n),
        "f_dup_lines": F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1)),
        "f_repeat": F.col("n_repeat_words") / n, "f_upper": F.col("n_upper") / chars, "f_digits": F.col("n_digits") / chars,
        "f_bare": F.col("n_bare") / n, "f_marks": F.log1p(F.col("n_marks") / n),
        "f_line_words": F.log1p(F.col("n_words") / F.greatest(F.col("n_lines"), F.lit(1)))})


def expected_path(n: np.ndarray) -> np.ndarray:
    """Mean path length of an unsuccessful search among n points."""
    n = np.asarray(n, float)
    return np.where(n > 2, 2 * (np.log(np.maximum(n, 2) - 1) + 0.5772156649) - 2 * (n - 1) / np.maximum(n, 1), (n == 2) * 1.0)


def grow_forest(good: np.ndarray, low: np.ndarray, high: np.ndarray, trees: int = TREES, seed: int = SEED) -> dict[str, np.ndarray]:
    """Trees as arrays: node i has the children 2i+1 and 2i+2; feature -1 is a leaf with its path length."""
    rng = np.random.default_rng(seed)
    nodes = 2 ** (DEPTH + 1) - 1
    feature = np.full((trees, nodes), -1, np.int16)
    cut, path = np.zeros((trees, nodes)), np.zeros((trees, nodes))
    usable = np.flatnonzero(high > low)
    for t in range(trees):
        sample = good[rng.choice(len(good), min(SUBSAMPLE, len(good)), replace=False)]
        todo = [(0, 0, sample, low.copy(), high.copy())]
        while todo:
            node, depth, rows, lo, hi = todo.pop()
            open_dims = usable[hi[usable] > lo[usable]] if len(usable) else usable
            if len(rows) <= 1 or depth == DEPTH or not len(open_dims):
                path[t, node] = depth + expected_path(len(rows))
                continue
            f = int(rng.choice(open_dims))
            at = rng.uniform(lo[f], hi[f])
            feature[t, node], cut[t, node] = f, at
            for child, part, bound, end in ((2 * node + 1, rows[rows[:, f] <= at], hi, at), (2 * node + 2, rows[rows[:, f] > at], lo, at)):
                box = [lo.copy(), hi.copy()]
                box[0 if bound is lo else 1][f] = end
                todo.append((child, depth + 1, part, *box))
    return {"feature": feature, "cut": cut, "path": path}


def path_length(forest: dict[str, np.ndarray], x: np.ndarray) -> np.ndarray:
    """Mean path length of each row of x over the trees."""
    total, rows = np.zeros(len(x)), np.arange(len(x))
    for feature, cut, path in zip(forest["feature"], forest["cut"], forest["path"], strict=True):
        node = np.zeros(len(x), np.int64)
        for _ in range(DEPTH):
            f = feature[node]
            node = np.where(f < 0, node, 2 * node + 1 + (x[rows, f] > cut[node]))
        total += path[node]
    return total / len(forest["feature"])


def calibrate(histogram: list[tuple[float, int, int]], keep_good: float = KEEP_GOOD) -> float:
    """The path threshold from (path, good rows, bad rows): rows below it are rejected.

    Among thresholds that keep `keep_good` of the good rows, the largest bad
    share goes; of equal ones, the smallest threshold.
    """
    best, threshold, lost, gone = -1, float("-inf"), 0, 0
    good_all = sum(g for _, g, _ in histogram)
    for path, good, bad in sorted(histogram):
        if gone > best:
            best, threshold = gone, path
        lost, gone = lost + good, gone + bad
        if lost > (1 - keep_good) * good_all:
            break
    return threshold


def fit(stats: DataFrame, labels: DataFrame) -> tuple[dict[str, np.ndarray], float] | None:
    """The forest and its threshold, or None without labelled good rows."""
    marks = labels.filter("quality IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("quality").alias("_quality"))
    rows = stats.filter(~F.col("base_failed")).join(marks, "doc_id")
    sample = C.hash_sample(rows.filter("_quality = 1"), MAX_TRAIN, "doc_id", C.KEY).select(*FEATURES).collect()  # about MAX_TRAIN rows
    if not sample:
        return None
    bounds = rows.agg(*[F.min(f) for f in FEATURES], *[F.max(f) for f in FEATURES]).first()
    low, high = np.array(bounds[:len(FEATURES)], float), np.array(bounds[len(FEATURES):], float)
    good = np.array(sample, float)
    forest = grow_forest(good[np.lexsort(good.T)], low, high)  # the same forest in whatever order the rows come
    scored = score(rows.select("_quality", *FEATURES), forest, ["_quality"])
    bins = (scored.groupBy(F.round("path_length", 2).alias("path"))
            .agg(F.count_if(F.col("_quality") == 1).alias("good"), F.count_if(F.col("_quality") != 1).alias("bad")).collect())
    return forest, calibrate([(r["path"], r["good"], r["bad"]) for r in bins])  # at most 100 bins per unit of path


def score(stats: DataFrame, forest: dict[str, np.ndarray], carry: list[str]) -> DataFrame:
    """The columns `carry` and path_length."""
    def run(batches):
        for batch in batches:
            x = np.stack([batch.column(f).to_numpy(zero_copy_only=False) for f in FEATURES], axis=1)
            yield pa.RecordBatch.from_arrays(
                [batch.column(c) for c in carry] + [pa.array(path_length(forest, x))], names=[*carry, "path_length"])

    schema = ", ".join(f"`{c}` {stats.schema[c].dataType.simpleString()}" for c in carry)
    return stats.select(*carry, *FEATURES).mapInArrow(run, schema + ", path_length double")


def quality_verdicts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, row key, counts, base_failed, path_length and kept of every document."""
    stats = statistics(docs)
    carry = ["doc_id", C.KEY, *COUNTS, "base_failed"]
    model = fit(stats, labels)
    if model is None:
        return stats.select(*carry, F.lit(None).cast("double").alias("path_length"), (~F.col("base_failed")).alias("kept"))
    forest, threshold = model
    return score(stats, forest, carry).withColumn(
        "kept", ~F.col("base_failed") & (F.round("path_length", 2) >= F.lit(threshold)))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs that the verdict keeps, with the columns of docs."""
    kept = quality_verdicts(docs, labels).filter("kept").select("doc_id", C.KEY).distinct()
    return C.with_decisions(docs, kept, "left_semi")


def op7_isolation_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    verdicts = quality_verdicts(C.table(spark, sf_dir, "documents"), C.table(spark, sf_dir, "labels"))
    return verdicts.select("doc_id", *COUNTS[:5], "base_failed", "kept", "path_length")
