"""Product codes of vectors: codebooks by Lloyd's rounds over cover trees.

Vectors become whole numbers, floor(scale * x), and are cut into equal consecutive
parts. Each part position has a codebook, which starts as that part of the rows with
the smallest ids. A round assigns every part to its nearest entry (squared Euclidean
distance, the lower index in ties) and moves each entry to the mean of its parts.

*Cover trees.* Rows are gathered into blocks where they lie. For each part position
a block holds a cover tree: a node covers the points of its subtree within its radius,
and its children cover them at half the radius and less. Points stand in the order of
a walk through the tree, so that a subtree is a range, and cumulative sums over that
order give the sum of any subtree by one subtraction. The trees are written once and
read in every round.

*Rounds.* A task walks its trees from the roots, level by level. Where one entry is
nearer to a node's centre than all others by more than twice the radius, the triangle
inequality gives it to the whole subtree, whose sum and count are added at once. Only
other nodes descend: the centre itself is compared exactly, and the children follow.
Tasks send sums and counts per entry, whose number the codebooks' size bounds; the
driver holds the codebooks and nothing else.

All results are whole numbers and do not depend on how rows lie in blocks.

Input cases: rows with a null vector, or with a null, NaN or infinite component, are
left out. Vectors of different lengths, or of a length that the parts do not divide,
are filled up with zeros. Rows that repeat are rows of their own. Null ids come last
when the codebooks start; equal ids stand in order of their vectors. With fewer rows
than entries the codebooks are smaller. Components so large that a squared distance
might leave 64 bits (beyond about 130,000 at 64 components) are held at that bound,
and an error sum beyond 64 bits at the largest number. An empty table has no rows in
the result. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_table
from . import common as C
from .hardneg import LONG, matrix

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
BLOCK = 2048  # rows of a block, whose trees a task builds at once

TREE = "struct<points: array<bigint>, place: array<int>, end: array<int>, parent: array<int>, radius: array<double>>"


def held(values: np.ndarray) -> np.ndarray:
    """Whole numbers held at a bound under which the squared distance of two rows stays below 2**62."""
    most = math.isqrt((1 << 62) // max(1, values.shape[1])) // 2
    return np.clip(values, -most, most).astype(np.int64)


def widened(values: np.ndarray, width: int) -> np.ndarray:
    return np.pad(values, ((0, 0), (0, width - values.shape[1])))


def squares(points: np.ndarray, others: np.ndarray) -> np.ndarray:
    """Squared distances of all points to all others, exactly."""
    most = max(int(np.abs(points).max(initial=0)), int(np.abs(others).max(initial=0)))
    if 4 * most * most * max(1, points.shape[1]) < 1 << 53:  # whole numbers that float64 holds
        a, b = points.astype(np.float64), others.astype(np.float64)
        return ((a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1) - 2 * (a @ b.T)).astype(np.int64)
    return np.stack([((points - o) ** 2).sum(axis=1) for o in others], axis=1)


def cover_tree(points: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(place, end, parent, radius) of the nodes in the order of a walk.

    place: the point of each node; end: where its subtree ends; parent: its
    parent's position (-1 for the root); radius: the largest distance from its
    point to the points of its subtree. Points equal to a node's point follow it
    as its children.
    """
    n = len(points)
    far_from = np.sqrt(squares(points, points))
    place, end, parent, radius = [], np.zeros(n, np.int32), np.zeros(n, np.int32), np.zeros(n)

    def node(centre: int, rest: np.ndarray, above: int) -> None:
        at = len(place)
        place.append(centre)
        parent[at] = above
        if len(rest):
            radius[at] = scale = far_from[centre, rest].max()
            while len(rest) and scale > 0:
                scale /= 2
                near = far_from[centre, rest] <= scale
                outer, rest = rest[~near], rest[near]
                while len(outer):
                    child, others = int(outer[0]), outer[1:]
                    covered = far_from[child, others] <= scale
                    node(child, others[covered], at)
                    outer = others[~covered]
                scale = far_from[centre, rest].max(initial=0)
            for equal in rest.tolist():
                end[len(place)] = len(place) + 1
                parent[len(place)] = at
                place.append(equal)
        end[at] = len(place)

    if n:
        node(0, np.arange(1, n), -1)
    return np.array(place, np.int32), end, parent, radius


class Tree:
    """A cover tree of one part position of a block, with points in the order of its walk."""

    def __init__(self, points: np.ndarray, end: np.ndarray, parent: np.ndarray, radius: np.ndarray):
        self.points, self.end, self.radius = points, end, radius
        self.sums = np.concatenate([np.zeros((1, points.shape[1]), np.int64), np.cumsum(points, axis=0)])
        self.children = np.argsort(parent, kind="stable")
        self.first = np.searchsorted(parent[self.children], np.arange(-1, len(parent) + 1))  # children of node i: first[i + 1]:first[i + 2]

    def assign(self, book: np.ndarray):
        """(start, end, entry) of ranges of points that together cover all of them once."""
        out, level = [], np.zeros(min(1, len(self.points)), np.int64)
        while len(level):
            d2 = squares(self.points[level], book)
            entry = d2.argmin(axis=1)  # the lower index in ties
            d, r = np.sqrt(d2), self.radius[level]
            reach = (d[np.arange(len(level)), entry] + 2 * r) * (1 + 1e-9) + 1e-9  # beyond it no other entry is as near to any point
            sure = (r == 0) | ((d <= reach[:, None]).sum(axis=1) == 1)
            out.append((level, np.where(sure, self.end[level], level + 1), entry))
            open_ = level[~sure]
            lo, hi = self.first[open_ + 1], self.first[open_ + 2]
            size = hi - lo
            level = self.children[np.repeat(hi - np.cumsum(size), size) + np.arange(size.sum())]
        return [np.concatenate(x) for x in zip(*out, strict=True)] if out else [np.zeros(0, np.int64)] * 3

    def entries(self, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The entry of each point, and the squared distance to it."""
        start, end, entry = self.assign(book)
        order = np.argsort(start)
        codes = np.repeat(entry[order], (end - start)[order])
        return codes, ((self.points - book[codes]) ** 2).sum(axis=1)


def tree_blocks(rows: DataFrame, width: int, parts: int, scale: int, block: int = BLOCK) -> DataFrame:
    """One row for each block: ids and labels of its rows, and a tree for each part position."""
    def blocks_of(batches):
        waiting: list[pa.RecordBatch] = []
        n = 0
        for batch in batches:
            waiting.append(batch)
            n += len(batch)
            if n >= block:
                table = pa.Table.from_batches(waiting)
                while table.num_rows >= block:
                    yield table.slice(0, block).combine_chunks()
                    table = table.slice(block)
                waiting, n = table.to_batches(), table.num_rows
        if n:
            yield pa.Table.from_batches(waiting).combine_chunks()

    def run(batches):
        for table in blocks_of(batches):
            values = held(widened(matrix(table.column("vector"), scale), width))
            trees = []
            for points in np.split(values, parts, axis=1):
                place, end, parent, radius = cover_tree(points)
                trees.append({"points": points[place].ravel(), "place": place, "end": end, "parent": parent, "radius": radius})
            size = pa.array([0, table.num_rows], pa.int32())
            one = [pa.ListArray.from_arrays(size, table.column(c).combine_chunks()) for c in ("id", "label")]
            yield pa.RecordBatch.from_arrays([*one, pa.array([trees], pa.list_(tree_type))], names=["ids", "labels", "trees"])

    tree_type = pa.struct([("points", pa.list_(pa.int64())), ("place", pa.list_(pa.int32())), ("end", pa.list_(pa.int32())),
                           ("parent", pa.list_(pa.int32())), ("radius", pa.list_(pa.float64()))])
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    return rows.mapInArrow(run, f"ids array<{kinds['id']}>, labels array<{kinds['label']}>, trees array<{TREE}>")


def read_trees(batch: pa.RecordBatch, i: int, wide: int) -> list[tuple[np.ndarray, Tree]]:
    """(place, tree) for each part position of the i-th block of a batch."""
    out = []
    for tree in batch.column("trees")[i].values:
        place, end, parent, radius = (tree[c].values.to_numpy(zero_copy_only=False) for c in ("place", "end", "parent", "radius"))
        out.append((place, Tree(tree["points"].values.to_numpy(zero_copy_only=False).reshape(len(place), wide), end, parent, radius)))
    return out


def lloyd_round(blocks: DataFrame, books: np.ndarray) -> np.ndarray:
    """The codebooks (part, entry, position) after one round over all rows."""
    def run(batches):
        total, count = np.zeros(books.shape, np.int64), np.zeros(books.shape[:2], np.int64)
        for batch in batches:
            for i in range(len(batch)):
                for part, (_, tree) in enumerate(read_trees(batch, i, books.shape[2])):
                    start, end, entry = tree.assign(books[part])
                    np.add.at(total[part], entry, tree.sums[end] - tree.sums[start])
                    np.add.at(count[part], entry, end - start)
        part, entry = np.nonzero(count)
        at = np.repeat(np.arange(len(part)), books.shape[2])
        place = np.tile(np.arange(books.shape[2]), len(part))
        yield pa.RecordBatch.from_pydict({"part": pa.array(part[at], pa.int32()), "entry": pa.array(entry[at], pa.int32()), "place": pa.array(place, pa.int32()),
                                          "total": pa.array(total[part[at], entry[at], place]), "n": pa.array(count[part[at], entry[at]])})

    found = (blocks.select("trees").mapInArrow(run, "part int, entry int, place int, total bigint, n bigint").groupBy("part", "entry", "place")
             .agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total"), F.sum("n").alias("n")).toArrow())  # no more rows than the codebooks have numbers
    out = books.copy()
    out[tuple(found.column(c).to_numpy() for c in ("part", "entry", "place"))] = [
        int(t) // n for t, n in zip(found.column("total").to_pylist(), found.column("n").to_pylist(), strict=True)]
    return out


def encode(blocks: DataFrame, books: np.ndarray) -> DataFrame:
    """id, label, codes (a byte for each part) and error of every row."""
    def run(batches):
        for batch in batches:
            for i in range(len(batch)):
                ids, labels = batch.column("ids")[i].values, batch.column("labels")[i].values
                codes, error = np.zeros((len(ids), len(books)), np.uint8), np.zeros(len(ids), np.int64)
                for part, (place, tree) in enumerate(read_trees(batch, i, books.shape[2])):
                    entry, d2 = tree.entries(books[part])
                    codes[place, part] = entry
                    error[place] += d2
                yield pa.RecordBatch.from_arrays([ids, labels, pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(error)],
                                                 names=["id", "label", "codes", "error"])

    kinds = {f.name: f.dataType.elementType.simpleString() for f in blocks.schema.fields if f.name in ("ids", "labels")}
    return blocks.mapInArrow(run, f"id {kinds['ids']}, label {kinds['labels']}, codes binary, error bigint")


def compress(rows: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE, block: int = BLOCK,
             id_col: str = "vec_id", vector: str = "embedding", label: str = "label") -> tuple[DataFrame, np.ndarray]:
    """(id, label, codes and error of every row that takes part; the codebooks as an array by part, entry and position)."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | F.abs(x).isin(float("inf")))
    kept = (rows.filter(F.col(vector).isNotNull()).filter(~bad)
            .select(F.col(id_col).alias("id"), F.col(label).alias("label"), F.col(vector).alias("vector")))
    wide = kept.agg(F.max(F.size("vector"))).first()[0] or 0
    width = max(1, -(-wide // parts)) * parts
    first = kept.orderBy(F.asc_nulls_last("id"), "vector").limit(entries).toArrow()  # `entries` rows
    first = first.select(["vector"]).combine_chunks()
    start = held(widened(matrix(first.column("vector"), scale), width)) if first.num_rows else np.zeros((0, width), np.int64)
    books = np.stack(np.split(start, parts, axis=1))
    blocks = scratch_table(tree_blocks(kept, width, parts, scale, block), "cover-trees")
    for _ in range(rounds if first.num_rows else 0):
        books = lloyd_round(blocks, books)
    return encode(blocks, books), books


def digest(books: np.ndarray) -> str:
    """SHA-256 of all numbers by part, entry and position, joined by commas."""
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def op12_cover_tree_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes, books = compress(C.table(spark, sf_dir, "embeddings"))
    codes = scratch_table(codes, "vector-codes")
    total = F.least(F.sum(F.col("error").cast("decimal(38,0)")), F.lit(LONG).cast("decimal(38,0)")).cast("bigint")
    by_label = codes.groupBy(F.col("label").alias("its")).agg(total.alias("label_error"))
    return (codes.join(by_label, F.col("label").eqNullSafe(F.col("its")))
            .select(F.col("id").alias("vec_id"), F.lower(F.hex("codes")).alias("code"), "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256")))


def _op12_sql() -> str:
    """One statement: the four rounds and the last assignment as a chain of common table expressions."""
    nearest = """SELECT r, part, argmin(entry, (d, entry)) AS entry, min(d) AS d FROM (
    SELECT p.r, p.part, b.entry, p.norm + b.norm - 2 * list_inner_product(p.x, b.x) AS d
    FROM p JOIN (SELECT *, list_inner_product(x, x) AS norm FROM {books}) b USING (part)) GROUP BY r, part"""
    steps = ["""e AS (
  SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) AS r, vec_id, label, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS q
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
)""", """p AS (
  SELECT *, list_inner_product(x, x) AS norm FROM (
    SELECT r, part, q[part * (len(q) // 4) + 1:(part + 1) * (len(q) // 4)] AS x FROM e CROSS JOIN (SELECT unnest(range(4)) AS part))
)""", "b0 AS (SELECT part, r - 1 AS entry, x FROM p WHERE r <= 256)"]
    for k in range(ROUNDS):
        steps.append(f"a{k} AS MATERIALIZED (\n  {nearest.format(books=f'b{k}')}\n)")
        steps.append(f"""m{k} AS (
  SELECT part, entry, list(v ORDER BY i) AS x FROM (
    SELECT part, entry, i, floor(sum(v) / count(*)) AS v FROM (SELECT p.part, a.entry, unnest(p.x) AS v, unnest(range(len(p.x))) AS i FROM p JOIN a{k} a USING (r, part))
    GROUP BY part, entry, i) GROUP BY part, entry
)""")
        steps.append(f"b{k + 1} AS MATERIALIZED (SELECT part, entry, coalesce(m.x, b.x) AS x FROM b{k} b LEFT JOIN m{k} m USING (part, entry))")
    return "WITH " + ", ".join(steps) + f""", f AS MATERIALIZED (
  {nearest.format(books=f'b{ROUNDS}')}
), c AS (
  SELECT r, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, CAST(sum(d) AS BIGINT) AS error FROM f GROUP BY r
)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
  (SELECT sha256(string_agg(list_aggregate(list_transform(x, lambda v: CAST(CAST(v AS BIGINT) AS VARCHAR)), 'string_agg', ','), ',' ORDER BY part, entry))
   FROM b{ROUNDS}) AS codebooks_sha256
FROM e JOIN c USING (r)"""


OP12_SQL = _op12_sql()
