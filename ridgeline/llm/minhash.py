"""Near-duplicate documents by MinHash bands and sequential Bayesian verification.

A document's set holds its distinct word shingles. Equal sets are one class from the
start, so copies are never paired; a class has a signature of `HASHES` MinHash values.

*Bands.* The signature is cut into bands; classes that agree in a band share a bucket.
A pair of similarity 0.8 misses all 32 bands of 4 values with probability 5e-8.
Buckets with the same members, which most bands of a group have, are kept once.

*Sequential verification.* A candidate pair compares its signatures batch by batch.
After each batch the matches so far give a posterior of the similarity (uniform prior,
so a Beta distribution); the pair is dropped as soon as the posterior probability that
it reaches the threshold is below `MISS`. Survivors are verified on their whole sets.

*Links without all pairs.* First every member of a bucket meets the bucket's first
member; that is one pair for each membership. Buckets whose members are all linked with
one hub have nothing left to find. In the others, members with different hubs are
compared as well, so no link that joins components is left out: a task that holds
a bucket runs the sequential test on its signatures and names the members that have a
plausible partner; another holds their sets, counts all their intersections as one
matrix product, and hands on a spanning forest of the links. Rows are named in
proportion to members, never to pairs.

*Large buckets.* Beyond `LIMIT` members, or `SHINGLES` shingles, a bucket is split
into blocks whose pairs are separate units of work. Beyond `RECUT` times that it is cut
anew on each of the other bands first: a linked pair shares one of them all but surely
(a miss of 7e-8), and unlike sets that share one band seldom share another.

Input cases: a null text, or one without words, has an empty set and stands alone; a
text with fewer words than a shingle is one shingle. Very long texts are hashed whole.
Rows that repeat are equal sets. A null doc_id takes part but is never the smallest id
(of a component without any id, the row with the smallest text hash is the one kept).
Other columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_table
from . import common as C
from . import textnp as T
from .components import components
from .paritysketch import chunk_sets, verified

SHINGLE, PERCENT = 4, 80
HASHES, ROWS, BATCH = 128, 4, 32  # values of a signature, of a band, and of a batch
MISS = 1e-6  # posterior probability of the threshold below which a pair is dropped
LIMIT, SHINGLES = 4096, 1 << 22  # members and shingles of a unit of work, at most about
RECUT = 16
COLUMNS = 1024  # shingles that a matrix product takes at once
SEEN = 1 << 20  # set hashes a task remembers, so that it signs equal sets once

_FACTORS = T.mix(np.arange(1, HASHES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def signatures(hashes: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
    """MinHash values (n x HASHES) of the rows 0 to n - 1, each of which has some of the hashes; rows must be sorted."""
    out = np.empty((n, HASHES), np.uint32)
    if n:
        at = np.searchsorted(rows, np.arange(n))
        for j, factor in enumerate(_FACTORS):
            x = hashes * factor
            out[:, j] = np.minimum.reduceat(((x ^ (x >> np.uint64(29))) * _FACTORS[j - 1]) >> np.uint64(32), at)
    return out


def band_keys(signed: np.ndarray) -> np.ndarray:
    """A 64-bit key for each band of each signature."""
    parts = signed.reshape(len(signed), HASHES // ROWS, ROWS).astype(np.uint64)
    key = np.broadcast_to(np.arange(1, HASHES // ROWS + 1, dtype=np.uint64), parts.shape[:2]).copy()
    for j in range(ROWS):
        key = T.mix(key * np.uint64(0x5851F42D4C957F2D) + parts[:, :, j])
    return key.view(np.int64)


def least_matches(n: int, percent: int, miss: float) -> int:
    """The fewest matches among n values with which the posterior still gives the threshold a probability of `miss`.

    After m matches of n the similarity is Beta(m + 1, n - m + 1) distributed; it
    reaches p with the probability that n + 1 throws of chance p succeed m times at most.
    """
    p, below = percent / 100, 0.0
    for m in range(n + 1):
        below += math.comb(n + 1, m) * p ** m * (1 - p) ** (n + 1 - m)
        if below >= miss:
            return m
    return n


def batch_bounds(percent: int, miss: float = MISS) -> list[int]:
    """The least matches after each batch."""
    return [least_matches(n, percent, miss) for n in range(BATCH, HASHES + 1, BATCH)]


def plausible(signed: np.ndarray, size: np.ndarray, u: np.ndarray, v: np.ndarray, percent: int, bounds: list[int]) -> np.ndarray:
    """Which of the pairs (u, v) of rows of `signed` may reach the threshold, by their sizes and the batches of their signatures."""
    alive = np.flatnonzero(100 * np.minimum(size[u], size[v]) >= percent * np.maximum(size[u], size[v]))
    matches = np.zeros(len(u), np.int64)
    for lo, least in zip(range(0, HASHES, BATCH), bounds, strict=True):
        matches[alive] += (signed[u[alive], lo:lo + BATCH] == signed[v[alive], lo:lo + BATCH]).sum(axis=1)
        alive = alive[matches[alive] >= least]
    return alive


def describe(docs: DataFrame, k: int = SHINGLE) -> DataFrame:
    """doc_id, row key, n (set size), class, and the signature where the task meets the class for the first time."""
    def run(batches):
        seen: set[int] = set()
        for batch in batches:
            for lo, hi, data, offsets in T.chunks(batch.column("text")):
                h, r, n, label = chunk_sets(data, offsets, k)
                fresh = np.zeros(len(n), bool)
                for i, c in enumerate(label.tolist()):
                    if n[i] and c not in seen:
                        fresh[i] = True
                        if len(seen) < SEEN:
                            seen.add(c)
                take = fresh[r]
                place = np.cumsum(fresh) - 1
                signed = signatures(h[take], place[r[take]], int(fresh.sum()))
                found = [signed[place[i]].tobytes() if fresh[i] else None for i in range(len(n))]
                part = batch.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column(C.KEY), pa.array(n, pa.int64()), pa.array(label), pa.array(found, pa.binary())],
                                                 names=["doc_id", C.KEY, "n", "class", "signature"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return C.keyed(docs).mapInArrow(run, f"doc_id {kind}, {C.KEY} bigint, n bigint, class bigint, signature binary")


def matrix(signed: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(signed.to_pylist()), np.uint32).reshape(-1, HASHES)


def band_members(info: DataFrame) -> DataFrame:
    """(key, class, n): each class with its size and the key of each of its bands."""
    def run(batches):
        for batch in batches:
            keys = band_keys(matrix(batch.column("signature")))
            at = np.repeat(np.arange(len(keys)), keys.shape[1])
            yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), batch.column("class").take(pa.array(at)), batch.column("n").take(pa.array(at))], names=["key", "class", "n"])

    return info.select("class", "n", "signature").mapInArrow(run, "key bigint, class bigint, n bigint")


def buckets(members: DataFrame) -> DataFrame:
    """unit, class, n, m, s (members and shingles in all) and hub (class and n of the first member).

    Buckets with one member, nearly all of them, are left out first, by their counts
    alone. Of buckets with equal members one is kept: they are compared by fixed-size
    aggregates, which combine before the shuffle.
    """
    shared = members.groupBy("key").agg(F.count(F.lit(1)).alias("m")).filter("m > 1").select("key")
    members = scratch_table(members.join(shared, "key", "left_semi"), "minhash-shared")
    counted = members.groupBy("key").agg(
        F.count(F.lit(1)).alias("m"), F.sum("n").alias("s"), F.min(F.struct("class", "n")).alias("hub"),
        F.bit_xor(F.xxhash64("class")).alias("mark"))
    units = counted.groupBy("m", "s", "hub", "mark").agg(F.min("key").alias("unit"))
    return members.join(units, members["key"] == units["unit"]).select("unit", "class", "n", "m", "s", "hub")


def survivors(pairs: DataFrame, info: DataFrame, percent: int) -> DataFrame:
    """The pairs (u, v) that sequential verification leaves."""
    def run(batches):
        for batch in batches:
            n, both = len(batch), matrix(pa.concat_arrays([batch.column("su"), batch.column("sv")]))
            size = np.concatenate([batch.column("nu").to_numpy(), batch.column("nv").to_numpy()])
            keep = pa.array(plausible(both, size, np.arange(n), np.arange(n, 2 * n), percent, bounds))
            yield pa.RecordBatch.from_arrays([batch.column(c).take(keep) for c in ("u", "v")], names=["u", "v"])

    bounds = batch_bounds(percent)
    side = lambda x: info.select(F.col("class").alias(x), F.col("n").alias(f"n{x}"), F.col("signature").alias(f"s{x}"))
    return pairs.join(side("u"), "u").join(side("v"), "v").select("u", "v", "nu", "nv", "su", "sv").mapInArrow(run, "u bigint, v bigint")


def class_sets(docs: DataFrame, wanted: DataFrame, k: int) -> DataFrame:
    """(class, set): the sorted shingle hashes of the classes in `wanted` (class, rep), from one document of each."""
    def run(batches):
        for batch in batches:
            for lo, hi, data, offsets in T.chunks(batch.column("text")):
                h, r, n, _ = chunk_sets(data, offsets, k)
                ends = pa.array(np.searchsorted(r, np.arange(len(n) + 1)), pa.int32())
                yield pa.RecordBatch.from_arrays([batch.column("class").slice(lo, hi - lo), pa.ListArray.from_arrays(ends, pa.array(h.view(np.int64)))],
                                                 names=["class", "set"])

    rep = wanted.select("class", F.col("rep")[C.KEY].alias(C.KEY), F.col("rep")["doc_id"].alias("its"))
    found = C.keyed(docs).join(rep, C.KEY).filter(F.col("doc_id").eqNullSafe(F.col("its"))).select("class", "text")
    return found.mapInArrow(run, "class bigint, set array<bigint>").dropDuplicates(["class"])


def split_large(large: DataFrame, bands: DataFrame, limit: int, shingles: int) -> DataFrame:
    """(unit, class) in place of the large buckets (unit, class, n, m, s): cut anew if very large, then pairs of blocks."""
    very = (F.col("m") > RECUT * limit) | (F.col("s") > RECUT * shingles)
    again = large.filter(very).select("unit", "class").join(bands, "class").filter("key <> unit")
    cut = buckets(again.select(F.xxhash64("unit", "key").alias("key"), "class", "n").distinct())
    both = large.filter(~very).select("unit", "class", "m", "s").union(cut.select("unit", "class", "m", "s"))
    blocks = F.ceil(F.greatest(F.col("m") / limit, F.col("s") / shingles)).cast("int")
    block = F.pmod(F.xxhash64("class"), F.col("blocks"))
    dealt = both.withColumn("blocks", blocks).withColumn("block", block).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return dealt.select(F.xxhash64("unit", F.least("block", "other"), F.greatest("block", "other")).alias("unit"), "class")


def open_members(units: DataFrame, percent: int) -> DataFrame:
    """(unit, class) of the members that have a plausible partner of another label in their unit (unit, class, label, n, signature)."""
    def run(table: pa.Table) -> pa.Table:
        label, size = table.column("label").to_numpy(), table.column("n").to_numpy()
        signed = matrix(table.column("signature").combine_chunks())
        names, count = np.unique(label, return_counts=True)
        most = label == names[count.argmax()]
        found = np.zeros(len(label), bool)
        for x in np.flatnonzero(~most).tolist():  # one side of each pair is outside the most frequent label
            others = np.flatnonzero((label != label[x]) & ((np.arange(len(label)) > x) | most))
            partners = others[plausible(signed, size, np.full(len(others), x), others, percent, bounds)]
            found[partners] = True
            found[x] |= len(partners) > 0
        return table.select(["unit", "class"]).filter(pa.array(found))

    bounds = batch_bounds(percent)
    return units.select("unit", "class", "label", "n", "signature").groupBy("unit").applyInArrow(run, "unit bigint, class bigint")


def common_shingles(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """How many values each two of the sets share; the sets (of distinct values) follow one another in `values`."""
    row = np.repeat(np.arange(len(sizes)), sizes)
    order = np.argsort(values, kind="stable")
    values, row = values[order], row[order]
    new = np.concatenate([[True], values[1:] != values[:-1]]) if len(values) else np.zeros(0, bool)
    column = np.cumsum(new) - 1
    shared = np.bincount(column)[column] > 1  # a shingle of one set adds to no pair
    row, column = row[shared], column[shared]
    column = np.unique(column, return_inverse=True)[1]
    out = np.zeros((len(sizes), len(sizes)), np.float32)  # counts below 2**24 are exact
    for lo in range(0, int(column.max(initial=-1)) + 1, COLUMNS):
        a, b = np.searchsorted(column, [lo, lo + COLUMNS])
        has = np.zeros((len(sizes), COLUMNS), np.float32)
        has[row[a:b], column[a:b] - lo] = 1
        used = np.unique(row[a:b])
        out[np.ix_(used, used)] += has[used] @ has[used].T
    return out


def forest(linked: np.ndarray) -> list[tuple[int, int]]:
    """A spanning forest of a symmetric boolean matrix."""
    left, out = np.ones(len(linked), bool), []
    for root in range(len(linked)):
        if left[root]:
            left[root], todo = False, [root]
            while todo:
                x = todo.pop()
                near = np.flatnonzero(linked[x] & left)
                left[near] = False
                out += [(x, y) for y in near.tolist()]
                todo += near.tolist()
    return out


def unit_links(units: DataFrame, percent: int) -> DataFrame:
    """A spanning forest (u, v) of the links within each unit (unit, class, set), by whole sets."""
    def run(table: pa.Table) -> pa.Table:
        sets = table.column("set").combine_chunks()
        size = np.diff(sets.offsets.to_numpy())
        common = common_shingles(sets.flatten().to_numpy(), size).astype(np.int64)
        pairs = forest(100 * common >= percent * (size[:, None] + size - common))
        cls = table.column("class").to_numpy()
        at = np.array(pairs, np.int64).reshape(-1, 2)
        return pa.table({"u": cls[at[:, 0]], "v": cls[at[:, 1]]})

    return units.select("unit", "class", "set").groupBy("unit").applyInArrow(run, "u bigint, v bigint")


def near_duplicates(docs: DataFrame, k: int = SHINGLE, percent: int = PERCENT, limit: int = LIMIT, shingles: int = SHINGLES) -> DataFrame:
    """doc_id, row key, n (set size) and component: the struct (doc_id, row key) of the smallest document reachable."""
    rows = scratch_table(describe(docs, k), "minhash-rows")
    info = scratch_table(rows.filter("n > 0").groupBy("class").agg(F.min(F.struct("doc_id", C.KEY)).alias("rep"), F.max("n").alias("n"), F.max("signature").alias("signature")),
                         "minhash-classes")
    bands = scratch_table(band_members(info), "minhash-bands")
    members = scratch_table(buckets(bands), "minhash-buckets")

    def sets_of(classes: DataFrame) -> DataFrame:
        return scratch_table(class_sets(docs, info.select("class", "rep").join(classes.distinct(), "class", "left_semi"), k), "minhash-sets")

    near = F.least("n", "hub.n") * 100 >= F.greatest("n", "hub.n") * percent
    pairs = members.filter((F.col("class") != F.col("hub.class")) & near).select(F.col("hub.class").alias("u"), F.col("class").alias("v")).distinct()
    pairs = scratch_table(survivors(scratch_table(pairs, "minhash-pairs"), info, percent), "minhash-candidates")
    links = scratch_table(verified(pairs, sets_of(pairs.select(F.col("u").alias("class")).union(pairs.select("v"))), percent), "minhash-links")
    # a class and the smallest hub that it is linked with, or that hub's: enough to see most buckets connected without finding components
    one = links.groupBy(F.col("v").alias("class")).agg(F.min("u").alias("hub"))
    further = one.select(F.col("class").alias("hub"), F.col("hub").alias("label"))
    labels = scratch_table(one.join(further, "hub", "left").select("class", F.coalesce("label", "hub").alias("label")), "minhash-labels")

    def unfinished(units: DataFrame) -> DataFrame:
        """The units whose members are not known to be connected, with each member's hub (or itself) as `label`."""
        labelled = units.join(labels, "class", "left").withColumn("label", F.coalesce("label", "class"))
        mixed = labelled.groupBy("unit").agg(F.min("label").alias("a"), F.max("label").alias("b")).filter("a <> b").select("unit")
        return labelled.join(mixed, "unit", "left_semi")

    open_ = scratch_table(unfinished(members.filter("m > 2")), "minhash-open")  # two members have met
    is_large = (F.col("m") > limit) | (F.col("s") > shingles)
    units = open_.filter(~is_large).select("unit", "class", "label")
    large = open_.filter(is_large).select("unit", "class", "n", "m", "s")
    if large.limit(1).count():
        units = units.union(unfinished(split_large(large, bands, limit, shingles)).select(units.columns))
    left = scratch_table(open_members(units.join(info.select("class", "n", "signature"), "class"), percent), "minhash-open-members")
    more = unit_links(left.join(sets_of(left.select("class")), "class"), percent)
    stars = components(links.union(more))
    plain = rows.select("doc_id", C.KEY, "n", "class")
    found = (plain.join(stars, plain["class"] == stars["u"], "left")
             .select("doc_id", C.KEY, "n", F.when(F.col("n") > 0, F.coalesce("v", "class")).alias("label")))
    least = found.filter("label IS NOT NULL").groupBy("label").agg(
        F.coalesce(F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", C.KEY))), F.min(F.struct("doc_id", C.KEY))).alias("component"))
    return (found.join(least, "label", "left")
            .select("doc_id", C.KEY, "n", F.coalesce("component", F.struct("doc_id", C.KEY)).alias("component")))


def op13_bayes_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(C.table(spark, sf_dir, "documents"))
    first = F.col("component.doc_id")
    kept = F.when(F.col("doc_id").isNotNull(), F.col("doc_id").eqNullSafe(first)).otherwise(first.isNull() & (F.col("component")[C.KEY] == F.col(C.KEY)))
    return found.select("doc_id", F.col("n").alias("n_shingles"), first.alias("component_id"), kept.alias("kept"))


OP13_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM documents
), s AS (
  SELECT DISTINCT doc_id, words[i:i + 3] AS shingle FROM (SELECT doc_id, words, unnest(range(1, greatest(len(words) - 3, 1) + 1)) AS i FROM d WHERE len(words) > 0)
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
pairs AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b USING (shingle) WHERE a.doc_id < b.doc_id GROUP BY ALL),
links AS (SELECT x, y FROM pairs JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= 80 * (a.n + b.n - c)),
both_ways AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reach AS (SELECT doc_id, doc_id AS r FROM d UNION SELECT reach.doc_id, y FROM reach JOIN both_ways ON x = r)
SELECT d.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, least_id AS component_id, d.doc_id = least_id AS kept
FROM d LEFT JOIN n USING (doc_id) JOIN (SELECT doc_id, min(r) AS least_id FROM reach GROUP BY doc_id) USING (doc_id)
"""
