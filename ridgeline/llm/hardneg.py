"""Hard negatives of anchor vectors, by slot-decomposed selection.

A row's score is its integer inner product with the anchor (components are
floor(scale * x)). An anchor's positives are its best other rows of the same
label. For a positive with score p, a hard negative is a row of another label
with low * p <= 100 * score <= high * p, and the best `k` of them are wanted, so
the windows of one anchor's positives overlap.

*Slots.* The windows' upper limits cut the score axis into disjoint slots, one
below each limit and above the next. A row falls into one slot at most, so one
pass serves all windows of an anchor. The best k of a slot are enough: a window
reaches from its upper limit down, and the best k below a limit are the best k of
the slots below it, merged in descending order; its lower limit then cuts that
list. Lists of k per slot merge by taking the best k again, so every task combines
its rows before anything is shuffled.

*Blocks.* Anchors (the query set) meet all rows in blocks: rows are dealt to
chunks and anchors to blocks by a hash of the whole row, and a task holds one
block of anchors while the rows of one chunk stream past it. Labels and scores
decide nothing about the dealing, so a label or vector that a third of the rows
have makes no task larger. Two passes are made, for positives and for negatives.

Input cases: rows with a null label, a null vector, or a null, NaN or infinite
component take no part. Rows that agree in id, label and vector count once (as
anchor, positive and negative); rows with one id and other contents are rows of
their own. A null id is never an anchor and comes last in ties. Vectors of
different lengths are filled up with zeros. A score beyond 64 bits counts as the
largest or smallest 64-bit number. A negative positive score has an empty window.
An anchor without positives or hard negatives has no rows in the result. Other
columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import scratch_table
from . import common as C

POSITIVES, NEGATIVES = 5, 3
LOW, HIGH = 50, 95  # percent of the positive's score
SCALE = 256
ANCHORS = 1 << 15  # anchors of a block, at most about
CHUNK, LEAST_CHUNK = 1 << 20, 1 << 10  # rows of a chunk: at most about; fewer only if there are fewer
TILE = 1 << 20  # products a task holds at once
PENDING = 1 << 20  # entries a task gathers before it cuts them to the best of each slot
LONG = (1 << 63) - 1


def finite_rows(rows: DataFrame, id_col: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """(row, id, label, vector): the distinct rows that take part; `row` is a hash of all three."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | F.abs(x).isin(float("inf")))
    return (rows.filter(F.col(label).isNotNull() & F.col(vector).isNotNull()).filter(~bad)
            .select(F.col(id_col).alias("id"), F.col(label).alias("label"), F.col(vector).alias("vector")).distinct()
            .select(F.xxhash64("id", "label", "vector").alias("row"), "id", "label", "vector"))


def matrix(vectors: pa.Array, scale: int) -> np.ndarray:
    """floor(scale * x) of a list column, as whole float64 numbers; short vectors are filled up with zeros."""
    if isinstance(vectors, pa.ChunkedArray):
        vectors = vectors.combine_chunks()
    values = np.floor(scale * vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64))
    size = np.diff(vectors.offsets.to_numpy())
    width = int(size.max(initial=0))
    if (size == width).all():
        return values.reshape(len(size), width)
    out = np.zeros((len(size), width))
    row = np.repeat(np.arange(len(size)), size)
    out[row, np.arange(len(values)) - np.repeat(np.cumsum(size) - size, size)] = values
    return out


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of all rows of a with all rows of b, exactly, as 64-bit integers."""
    width = min(a.shape[1], b.shape[1])  # beyond it one of them is zero
    a, b = a[:, :width], b[:, :width]
    if np.abs(a).max(initial=0) * np.abs(b).max(initial=0) * max(1, width) < 2.0 ** 53:
        return (a @ b.T).astype(np.int64)
    whole = np.vectorize(int, otypes=[object])
    return np.clip(whole(a) @ whole(b).T, -LONG - 1, LONG).astype(np.int64) if width else np.zeros((len(a), len(b)), np.int64)


def window_limits(found: str, slots: int, low: int, high: int) -> Column:
    """The upper limits of the positives `found` (best first), then the lower ones; each list is filled up to `slots` by its last.

    All negative scores have the empty window of -1.
    """
    def percent(score, by, up):  # in whole hundreds and a rest, which stays in 64 bits
        rest = F.pmod(score, F.lit(100))
        return F.call_function("div", score - rest, F.lit(100)) * by + F.call_function("div", rest * by + up, F.lit(100))

    def filled(by, up):
        each = F.transform(F.col(found), lambda x: percent(F.greatest(x["score"], F.lit(-1)), by, up))
        return F.concat(each, F.array_repeat(F.element_at(each, -1), slots - F.size(each)))

    return F.concat(filled(high, 0), filled(low, 99))


class Best:
    """The best k rows of each (anchor, slot), fed in any order. `least` has the score that a row must reach to be one of them."""

    def __init__(self, anchors: int, slots: int, k: int):
        self.slots, self.k, self.parts, self.size = slots, k, [], 0
        self.least = np.full(anchors * slots, -LONG - 1, np.int64)

    def add(self, anchor: np.ndarray, slot: np.ndarray, score: np.ndarray, ident: np.ndarray, known: np.ndarray) -> None:
        """ident: the rows' ids, valid where `known` is true (a null id comes last in ties)."""
        group = anchor * self.slots + slot
        able = score >= self.least[group]
        if able.any():
            self.parts.append((group[able], score[able], ~known[able], ident[able]))
            self.size += len(self.parts[-1][0])
            if self.size > PENDING:
                self.cut()

    def cut(self) -> tuple[np.ndarray, ...]:
        if not self.parts:
            return (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool), np.zeros(0, np.int64))
        group, score, unknown, ident = (np.concatenate(x) for x in zip(*self.parts, strict=True))
        order = np.lexsort((ident, unknown, ~score, group))  # ~score falls as the score rises, also at the ends of 64 bits
        group = group[order]
        rank = np.arange(len(group)) - np.searchsorted(group, group)
        order = order[rank < self.k]
        kept = (group[rank < self.k], score[order], unknown[order], ident[order])
        full = rank[rank < self.k] == self.k - 1
        self.least[kept[0][full]] = kept[1][full]
        self.parts, self.size = [kept], len(order)
        return kept


def cells(rows: DataFrame, anchors: DataFrame, n_rows: int, n_anchors: int) -> DataFrame:
    """(cell, row, id, label, vector, marks): each chunk of rows with each block of anchors.

    Anchors have `marks` (an array), rows have null. Within a partition the
    anchors of a cell come first. A chunk goes to every block and a block to
    every chunk; both counts follow from the tables' sizes alone.
    """
    wide = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    blocks = max(1, math.ceil(n_anchors / ANCHORS))
    chunks = max(1, math.ceil(n_rows / CHUNK), min(math.ceil(wide / blocks), n_rows // LEAST_CHUNK))

    def dealt(df: DataFrame, own: int, stride: int, other: int, other_stride: int, marks) -> DataFrame:
        met = df.select("row", "id", "label", "vector", marks.alias("marks"), F.explode(F.sequence(F.lit(0), F.lit(other - 1))).alias("other"))
        cell = F.pmod("row", F.lit(own)) * stride + F.col("other") * other_stride
        return met.select(cell.cast("int").alias("cell"), "row", "id", "label", "vector", "marks")

    none = F.lit(None).cast("array<bigint>")
    both = dealt(anchors, blocks, 1, chunks, blocks, F.col("marks")).unionByName(dealt(rows, chunks, blocks, blocks, 1, none))
    return both.repartition(chunks * blocks, "cell").sortWithinPartitions("cell", F.col("marks").isNull())


def best_rows(rows: DataFrame, anchors: DataFrame, n_rows: int, n_anchors: int, slots: int, k: int, same: bool, scale: int) -> DataFrame:
    """(anchor, slot, score, id) of the best k rows of each anchor's slots, per task; best of all after `merged`.

    same=True: rows of the anchor's label besides itself, all in slot 0.
    same=False: rows of other labels; slot j has the scores of up to marks[j]
    (and above marks[j + 1]), of at least marks[slots + j].
    """
    def entries(label, index, upper, lower, batch_label, batch_row, row_of, s):
        """(anchor, slot, column) of the products s that belong to a slot."""
        if same:
            at, col = np.nonzero((label[index][:, None] == batch_label) & (row_of[index][:, None] != batch_row))
            return index[at], np.zeros(len(at), np.int64), col
        at, col = np.nonzero((label[index][:, None] != batch_label) & (s <= upper[index, 0][:, None]) & (s >= lower[index, -1][:, None]))
        slot = (s[at, col][:, None] <= upper[index[at]]).sum(axis=1) - 1  # upper limits descend
        fits = s[at, col] >= lower[index[at], slot]
        return index[at][fits], slot[fits], col[fits]

    def finish(best: Best | None, row_of) -> Iterator[pa.RecordBatch]:
        if best is not None:
            group, score, unknown, ident = best.cut()
            if len(group):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(row_of[group // slots]), pa.array((group % slots).astype(np.int32)), pa.array(score), pa.array(ident, mask=unknown)],
                    names=["anchor", "slot", "score", "id"])

    def run(batches):
        cell, held, best = None, [], None
        row_of = vec = label = upper = lower = None
        for batch in batches:
            number = batch.column("cell").to_numpy()
            starts = np.flatnonzero(np.concatenate([[True], number[1:] != number[:-1]])) if len(number) else []
            for lo, hi in zip(starts, [*starts[1:], len(number)], strict=True):
                if number[lo] != cell:
                    yield from finish(best, row_of)
                    cell, held, best = number[lo], [], None
                part = batch.slice(lo, hi - lo)
                is_row = part.column("marks").is_null().to_numpy(zero_copy_only=False)
                split = int(np.searchsorted(is_row, True))
                if split:
                    held.append(part.slice(0, split))
                if split == len(part) or not held:
                    continue
                if best is None:
                    table = pa.Table.from_batches(held).combine_chunks()
                    row_of, label = table.column("row").to_numpy(), table.column("label").to_numpy()
                    vec, best = matrix(table.column("vector"), scale), Best(len(row_of), slots, k)
                    if not same:
                        marks = table.column("marks").combine_chunks().flatten().to_numpy().reshape(len(row_of), 2 * slots)
                        upper, lower = marks[:, :slots], marks[:, slots:]
                part = part.slice(split)
                there, its_label, its_row = matrix(part.column("vector"), scale), part.column("label").to_numpy(), part.column("row").to_numpy()
                known = part.column("id").is_valid().to_numpy(zero_copy_only=False)
                ident = part.column("id").fill_null(0).to_numpy()
                step = max(1, TILE // len(part))
                for a in range(0, len(row_of), step):
                    index = np.arange(a, min(a + step, len(row_of)))
                    s = products(vec[index], there)
                    who, slot, col = entries(label, index, upper, lower, its_label, its_row, row_of, s)
                    best.add(who, slot, s[who - a, col], ident[col], known[col])
        yield from finish(best, row_of)

    return cells(rows, anchors, n_rows, n_anchors).mapInArrow(run, "anchor bigint, slot int, score bigint, id bigint")


def merged(best: DataFrame, k: int) -> DataFrame:
    """anchor, found: an array of (score, id) in descending order with the best k of each slot."""
    order = Window.partitionBy("anchor", "slot").orderBy(F.desc("score"), F.asc_nulls_last("id"))
    kept = best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    # slots descend as their scores do, so the slots' lists follow one another; at most slots * k entries
    listed = kept.groupBy("anchor").agg(F.array_sort(F.collect_list(F.struct("slot", "rank", "score", "id"))).alias("found"))
    return listed.select("anchor", F.transform("found", lambda x: F.struct(x["score"].alias("score"), x["id"].alias("id"))).alias("found"))


def hard_negatives(rows: DataFrame, is_anchor: str, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH,
                   scale: int = SCALE, id_col: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    `is_anchor` is a SQL condition on `id` (the id column), `label` and `vector`.
    """
    base = scratch_table(finite_rows(rows, id_col, vector, label), "hard-negative-rows")
    anchors = base.filter(is_anchor)
    n_rows, n_anchors = base.count(), anchors.count()
    first = best_rows(base, anchors.withColumn("marks", F.array().cast("array<bigint>")), n_rows, n_anchors, 1, positives, True, scale)
    found = merged(first, positives)

    with_positives = scratch_table(
        anchors.join(found, anchors["row"] == found["anchor"]).drop("anchor").withColumnRenamed("found", "positives")
        .withColumn("marks", window_limits("positives", positives, low, high)), "hard-negative-anchors")
    second = best_rows(base, with_positives.drop("positives"), n_rows, n_anchors, positives, negatives, False, scale)
    spread = with_positives.select(F.col("row").alias("anchor"), F.col("id").alias("anchor_id"), "marks", F.posexplode("positives").alias("at", "positive"))
    upper, lower = F.col("marks")[F.col("at")], F.col("marks")[F.col("at") + positives]
    below = F.slice(F.filter("found", lambda x: x["score"] <= upper), 1, negatives)  # the best of the slots from this one down
    return (spread.join(merged(second, negatives), "anchor")
            .select("anchor_id", "positive", F.posexplode(F.filter(below, lambda x: x["score"] >= lower)).alias("rank", "negative"))
            .select("anchor_id", F.col("positive.id").alias("positive_id"), (F.col("rank") + 1).cast("int").alias("rank"),
                    F.col("negative.id").alias("negative_id"), F.col("positive.score").alias("positive_score"),
                    F.col("negative.score").alias("negative_score")))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = C.table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(rows.withColumn("label", label), "id % 50 = 0")


OP11_SQL = """
WITH e AS (
  SELECT DISTINCT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, embedding FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), v AS (
  SELECT row_number() OVER (ORDER BY vec_id, label, embedding) AS r, vec_id, label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS q FROM e
), s AS (
  SELECT a.r AS anchor, a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, CAST(list_inner_product(a.q, b.q) AS BIGINT) AS score
  FROM v a JOIN v b ON a.r <> b.r WHERE a.vec_id % 50 = 0
), p AS (
  SELECT * FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor ORDER BY score DESC, vec_id NULLS LAST) <= 5
), n AS (
  SELECT p.anchor_id, p.vec_id AS positive_id, n.vec_id AS negative_id, p.score AS positive_score, n.score AS negative_score,
    row_number() OVER (PARTITION BY p.anchor, p.vec_id, p.score ORDER BY n.score DESC, n.vec_id NULLS LAST) AS rank
  FROM p JOIN s n ON p.anchor = n.anchor AND NOT n.same AND 50 * p.score <= 100 * n.score AND 100 * n.score <= 95 * p.score
)
SELECT anchor_id, positive_id, CAST(rank AS INT) AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 3
"""
