"""Near-duplicate documents by a parity-sketch join.

A document's set holds its distinct word shingles (64-bit hashes). Two sets
link when 100 * |A and B| >= percent * |A or B|; then their symmetric
difference is at most d = |A| * (100 - percent) / percent.

*Sketches.* A set is hashed into a bit sketch: each shingle flips one bit, so a
bit is the parity of the shingles that fall on it, and two sketches differ in at
most as many bits as the sets differ in shingles (Hamming distance is a lower
bound of the symmetric difference). The sketch used for the join is very long
and sparse; it is cut into K parts, and the code of a part is the XOR of the
64-bit codes of its set bits. A second, short sketch with explicit bits filters
pairs by Hamming distance before verification.

*Pigeonhole per size band.* Bands are ranges of set sizes, each with its own K.
Linked sets differ in at most d parts, so any d + 1 of the K parts, chosen by
one order that all sets share, have one in common. The order takes parts with
many shingles first: such parts agree by chance or through one frequent passage
far less often than parts of a single shingle. A set also joins the band below
its own if a partner may be there.

*Buckets.* Sets with equal parts form buckets. Instead of all pairs, a bucket
proposes a spanning forest of the pairs that the short sketches allow; these
are verified on the whole sets, and the verified links give components. Then
every allowed pair of a bucket that is still in different components is
verified as well, so no link that matters is lost. Buckets beyond `BLOCK` sets
are split into blocks, and pairs of blocks are separate units of work.

Equal sets are one class from the start, so copies are never paired.

Input cases: a null text, or one without words, has an empty set and stands
alone; a text with fewer words than a shingle is one shingle. Very long texts
are hashed in one chunk each. Rows that repeat are equal sets. A null doc_id
takes part but is never the smallest id. Other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_table
from . import common as C
from . import textnp as T
from .components import components

SHINGLE, PERCENT = 5, 80
BAND = 3  # sizes of band b: BAND**b to BAND**(b+1) - 1
PART_TOKENS = 3.3  # mean shingles of a part in the largest set of a band
BLOCK = 2048
SEEN = 1 << 20  # set hashes a task remembers, so that it sends the parts of equal sets once
FILTER_BITS = 1 << 24


def difference(n: np.ndarray, percent: int) -> np.ndarray:
    """The largest symmetric difference of a linked pair with a set of n."""
    return n * (100 - percent) // percent


def parts_of_band(band: int, percent: int) -> int:
    largest = (BAND ** (band + 1) - 1) * 100 // percent
    return max(int(-(-largest // PART_TOKENS)), int(difference(largest, percent)) + 1)


def sketch_bits(band: int) -> int:
    return min(4096, max(128, 1 << int(2 * BAND ** (band + 1) - 1).bit_length()))


def bands(n: np.ndarray) -> np.ndarray:
    edges = BAND ** np.arange(40, dtype=np.float64)
    return np.searchsorted(edges, n, "right") - 1


def part_keys(hashes: np.ndarray, rows: np.ndarray, band: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """(key, row) of the first d + 1 parts of each set. hashes: by row; band: of each row, under which its parts are cut."""
    n = np.bincount(rows, minlength=len(band))
    k = np.array([parts_of_band(b, percent) for b in range(int(band.max()) + 1)], np.uint64)[np.maximum(band, 0)]
    need = difference(n, percent) + 1
    part = (T.mix(hashes ^ np.uint64(0x7B9D)) % k[rows]).astype(np.int64)
    order = np.lexsort((part, rows))
    r, p, code = rows[order], part[order], T.mix(hashes[order])
    new = np.ones(len(r), bool)
    new[1:] = (r[1:] != r[:-1]) | (p[1:] != p[:-1])
    at = np.flatnonzero(new)
    code, size, r, p = np.bitwise_xor.reduceat(code, at), np.diff(np.append(at, len(r))), r[at], p[at]
    order = np.lexsort((p, -size, r))
    rank = np.arange(len(r)) - np.searchsorted(r, r[order])
    take = order[rank < need[r[order]]]
    out_key, out_row, out_part = code[take], r[take], p[take]
    filled = np.bincount(r, minlength=len(n))
    for row in np.flatnonzero((n > 0) & (filled < need)):  # rare: empty parts come last in the order
        empty = np.setdiff1d(np.arange(int(k[row])), p[r == row])[:int(need[row] - filled[row])]
        out_key, out_row, out_part = (np.append(out_key, np.zeros(len(empty), np.uint64)),
                                      np.append(out_row, np.full(len(empty), row)), np.append(out_part, empty))
    return T.mix(out_key ^ T.mix((out_part * 64 + band[out_row]).astype(np.uint64))), out_row


def sketches(hashes: np.ndarray, rows: np.ndarray, band: np.ndarray) -> list[bytes]:
    """The short parity sketch of each row, of a length that its band decides."""
    bits = np.array([sketch_bits(int(b)) if b >= 0 else 0 for b in band], np.int64)
    start = np.concatenate([[0], np.cumsum(bits)])
    place = T.mix(hashes ^ np.uint64(0x51ED)).astype(np.int64) & (bits[rows] - 1)
    flat = np.packbits((np.bincount(start[rows] + place, minlength=start[-1]) & 1).astype(np.uint8), bitorder="little")
    return [flat[a // 8:b // 8].tobytes() for a, b in zip(start[:-1], start[1:], strict=True)]


def chunk_sets(data: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, row, size, class) of a chunk: distinct shingles in order of row and hash, and a hash of each set."""
    data = T.LOWER[data]
    starts, ends, first = T.word_bounds(data, offsets)
    h, r, _ = T.distinct(*T.shingles(T.hash_spans(data, starts, ends), first, k))
    n = np.bincount(r, minlength=len(offsets) - 1)
    label = np.zeros(len(n), np.uint64)
    if len(h):
        has, at = np.flatnonzero(n), np.cumsum(n[n > 0]) - n[n > 0]
        label[has] = T.mix(np.bitwise_xor.reduceat(T.mix(h), at) ^ T.mix(np.add.reduceat(h, at) + n[has].astype(np.uint64)))
    return h, r, n, label.view(np.int64)


def _offsets(rows: np.ndarray, n: int) -> pa.Array:
    return pa.array(np.searchsorted(rows, np.arange(n + 1)), pa.int32())


def describe(docs: DataFrame, k: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """doc_id, row key, n (set size), class, sketch and keys (of the set's parts) of each document."""
    def run(batches):
        seen: set[int] = set()
        for batch in batches:
            for lo, hi, data, offsets in T.chunks(batch.column("text")):
                h, r, n, label = chunk_sets(data, offsets, k)
                band = bands(n)
                keys = rows = np.zeros(0, np.int64)
                fresh = np.zeros(len(n), bool)
                for i, c in enumerate(label.tolist()):
                    if n[i] and c not in seen:
                        fresh[i] = True
                        if len(seen) < SEEN:
                            seen.add(c)
                low = fresh & (band > 0) & (n <= (BAND ** np.maximum(band, 0) - 1) * 100 // percent)
                found = [part_keys(h[m[r]], r[m[r]], np.where(m, b, -1), percent) for m, b in ((fresh, band), (low, band - 1)) if m.any()]
                if found:
                    keys, rows = (np.concatenate(x) for x in zip(*found, strict=True))
                    order = np.argsort(rows, kind="stable")
                    keys, rows = keys[order].view(np.int64), rows[order]
                part = batch.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column(C.KEY), pa.array(n, pa.int64()), pa.array(label), pa.array(sketches(h, r, band), pa.binary()),
                     pa.ListArray.from_arrays(_offsets(rows, len(n)), pa.array(keys))],
                    names=["doc_id", C.KEY, "n", "class", "sketch", "keys"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return C.keyed(docs).mapInArrow(run, f"doc_id {kind}, {C.KEY} bigint, n bigint, class bigint, sketch binary, keys array<bigint>")


def _runs(batches, by: str):
    """(columns by name, rows) of batches whose rows of one `by` value stand together, cut between values only."""
    kept = None
    for batch in batches:
        table = pa.Table.from_batches([batch]) if kept is None else pa.concat_tables([kept, pa.Table.from_batches([batch])])
        key = table.column(by).to_numpy()
        cut = int(np.searchsorted(key, key[-1])) if len(key) else 0
        if cut:
            yield table.slice(0, cut).combine_chunks()
        kept = table.slice(cut)
    if kept is not None and kept.num_rows:
        yield kept.combine_chunks()


def bucket_blocks(described: DataFrame) -> DataFrame:
    """Blocks of different classes that share a part: unit, bucket (0 if it has one block), block and members.

    A task reads its keys in order and holds one block of one bucket; equal
    member lists, which many buckets of a group have, stay once.
    """
    def run(batches):
        rows: list[tuple[int, int, int, np.ndarray]] = []
        seen: set[int] = set()

        def add(bucket: int, block: int, members: np.ndarray) -> None:
            unit = int.from_bytes(hashlib.blake2b(members.tobytes() + bucket.to_bytes(8, "little", signed=True), digest_size=8).digest(), "little", signed=True)
            if unit not in seen:
                if len(seen) < SEEN:
                    seen.add(unit)
                rows.append((unit, bucket, block, members))

        def flush():
            if rows:
                yield pa.RecordBatch.from_pydict({"unit": pa.array([x[0] for x in rows], pa.int64()), "bucket": pa.array([x[1] for x in rows], pa.int64()),
                                                  "block": pa.array([x[2] for x in rows], pa.int32()), "members": pa.array([x[3] for x in rows], pa.list_(pa.int64()))})
                rows.clear()

        held_key, held, block = None, np.zeros(0, np.int64), 0  # the bucket that is still open

        def close():
            if block or len(held) > 1:
                if block == 0:
                    add(0, 0, held)
                elif len(held):
                    add(held_key, block, held)

        for batch in batches:
            key, member = batch.column("key").to_numpy(), batch.column("class").to_numpy()
            if not len(key):
                continue
            at = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            ends = np.append(at[1:], len(key))
            many = (ends - at > 1) | (np.arange(len(at)) == 0) | (np.arange(len(at)) == len(at) - 1)
            for lo, hi in zip(at[many].tolist(), ends[many].tolist(), strict=True):
                if key[lo] != held_key:
                    close()
                    held_key, held, block = int(key[lo]), np.zeros(0, np.int64), 0
                run_members = np.unique(member[lo:hi])  # sorted by class within a key, so repeats stand together
                if len(held) and len(run_members) and held[-1] == run_members[0]:
                    run_members = run_members[1:]
                held = np.concatenate([held, run_members]) if len(held) else run_members
                while len(held) > BLOCK:
                    add(held_key, block, held[:BLOCK])
                    held, block = held[BLOCK:], block + 1
            if len(rows) > 5000:
                yield from flush()
        close()
        yield from flush()

    keys = described.select("class", F.explode("keys").alias("key"))
    blocks = (keys.repartition("key").sortWithinPartitions("key", "class")
              .mapInArrow(run, "unit bigint, bucket bigint, block int, members array<bigint>"))
    return blocks.dropDuplicates(["unit"])


def _matrix(found: list[bytes]) -> np.ndarray:
    """Sketches as rows of 64-bit words, folded to the shortest length among them (positions are taken modulo it)."""
    short = min(map(len, found))
    out = np.empty((len(found), short // 8), np.uint64)
    for i, s in enumerate(found):
        out[i] = np.bitwise_xor.reduce(np.frombuffer(s, np.uint64).reshape(-1, short // 8), axis=0)
    return out


def _allowed(x: int, others: np.ndarray, n: np.ndarray, m: np.ndarray, percent: int) -> np.ndarray:
    """Those of `others` that sizes and Hamming distance do not exclude as partners of x."""
    a, b = n[x], n[others]
    others = others[(np.minimum(a, b) * 100 >= percent * np.maximum(a, b))]
    far = np.bitwise_count(m[others] ^ m[x]).sum(axis=1, dtype=np.int64)
    return others[far * (100 + percent) <= (n[x] + n[others]) * (100 - percent)]


def propose(n: np.ndarray, found: list[bytes], label: np.ndarray, percent: int, all_pairs: bool) -> list[tuple[int, int]]:
    """Pairs (indices) to verify between different labels: all that are allowed, or a spanning forest of them."""
    m, out = _matrix(found), []
    if all_pairs:
        for x in range(len(n) - 1):
            rest = np.arange(x + 1, len(n))
            out += [(x, int(y)) for y in _allowed(x, rest[label[rest] != label[x]], n, m, percent)]
        return out
    left = np.ones(len(n), bool)
    for root in range(len(n)):
        if not left[root]:
            continue
        todo = np.flatnonzero(label == label[root]).tolist()
        left[todo] = False
        while todo:
            x = todo.pop()
            near = _allowed(x, np.flatnonzero(left), n, m, percent)
            for y in near[np.unique(label[near], return_index=True)[1]].tolist():
                out.append((x, y))
                joined = np.flatnonzero(label == label[y])
                left[joined] = False
                todo += joined.tolist()
    return out


def candidate_pairs(members: DataFrame, percent: int, all_pairs: bool) -> DataFrame:
    """Distinct pairs u < v proposed within the units of members (unit, class, n, sketch, label)."""
    def run(batches):
        for table in _runs(batches, "unit"):
            unit, cls, n, label = (table.column(c).to_numpy() for c in ("unit", "class", "n", "label"))
            found = table.column("sketch").to_pylist()
            at = np.flatnonzero(np.concatenate([[True], unit[1:] != unit[:-1]]))
            u, v = [], []
            for lo, hi in zip(at.tolist(), [*at[1:].tolist(), len(unit)], strict=True):
                for x, y in propose(n[lo:hi], found[lo:hi], label[lo:hi], percent, all_pairs):
                    a, b = cls[lo + x], cls[lo + y]
                    u.append(min(a, b))
                    v.append(max(a, b))
            yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])

    return (members.select("unit", "class", "n", "sketch", "label").repartition("unit").sortWithinPartitions("unit", "class")
            .mapInArrow(run, "u bigint, v bigint").distinct())


def class_sets(docs: DataFrame, info: DataFrame, k: int) -> DataFrame:
    """(class, set): the sorted shingle hashes of the classes in `info`, from one document of each.

    A bit filter of fixed size over the documents' keys, the only thing sent to
    all tasks, spares most other texts; the join with `info` is exact.
    """
    bit = F.pmod(F.col("rep")[C.KEY], F.lit(FILTER_BITS))
    words = (info.select(F.shiftright(bit, 6).cast("int").alias("w"), F.pmod(bit, F.lit(64)).cast("int").alias("b"))
             .groupBy("w").agg(F.bit_or(F.expr("shiftleft(1L, b)")).alias("bits")).toArrow())  # FILTER_BITS / 64 rows at most
    filled = np.zeros(FILTER_BITS // 64, np.uint64)
    filled[words.column("w").to_numpy()] = words.column("bits").to_numpy().view(np.uint64)

    def run(batches):
        for batch in batches:
            place = batch.column(C.KEY).to_numpy() % FILTER_BITS
            hit = (filled[place >> 6] >> (place & 63).astype(np.uint64)) & np.uint64(1) == 1
            batch = pa.Table.from_batches([batch]).filter(pa.array(hit)).combine_chunks()
            for part in batch.to_batches():
                for lo, hi, data, offsets in T.chunks(part.column("text")):
                    h, r, n, label = chunk_sets(data, offsets, k)
                    yield pa.RecordBatch.from_arrays(
                        [part.column(C.KEY).slice(lo, hi - lo), pa.array(label),
                         pa.ListArray.from_arrays(_offsets(r, len(n)), pa.array(h.view(np.int64)))], names=[C.KEY, "class", "set"])

    found = C.keyed(docs).mapInArrow(run, f"{C.KEY} bigint, class bigint, set array<bigint>")
    wanted = info.select("class", F.col("rep")[C.KEY].alias(C.KEY))
    return found.join(wanted, ["class", C.KEY], "left_semi").dropDuplicates(["class", C.KEY]).select("class", "set")


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs whose whole sets reach the similarity."""
    def run(batches):
        for batch in batches:
            offsets = [batch.column(c).offsets.to_numpy() for c in ("set_u", "set_v")]
            values = [batch.column(c).values.to_numpy().view(np.uint64) for c in ("set_u", "set_v")]
            keep = np.zeros(batch.num_rows, bool)
            for i in range(batch.num_rows):
                a, b = (v[o[i]:o[i + 1]] for o, v in zip(offsets, values, strict=True))
                at = np.searchsorted(b, a)
                common = int(np.count_nonzero(b[np.minimum(at, len(b) - 1)] == a))
                keep[i] = 100 * common >= percent * (len(a) + len(b) - common)
            yield pa.RecordBatch.from_arrays([batch.column(c).filter(pa.array(keep)) for c in ("u", "v")], names=["u", "v"])

    a = sets.select(F.col("class").alias("u"), F.col("set").alias("set_u"))
    b = sets.select(F.col("class").alias("v"), F.col("set").alias("set_v"))
    return pairs.join(a, "u").join(b, "v").select("u", "v", "set_u", "set_v").mapInArrow(run, "u bigint, v bigint")


def near_duplicates(docs: DataFrame, k: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """doc_id, row key, n (set size) and component: the struct (doc_id, row key) of the smallest document reachable."""
    rows = scratch_table(describe(docs, k, percent), "near-rows")
    blocks = scratch_table(bucket_blocks(rows), "near-blocks")
    members = blocks.select("unit", "bucket", "block", F.explode("members").alias("class"))
    info = scratch_table(
        rows.groupBy("class").agg(F.min(F.struct("doc_id", C.KEY)).alias("rep"), F.max("n").alias("n"), F.max("sketch").alias("sketch"))
        .join(members.select("class").distinct(), "class", "left_semi"), "near-classes")
    sets = scratch_table(class_sets(docs, info, k), "near-sets")
    facts = info.select("class", "n", "sketch")

    def links(units: DataFrame, stars: DataFrame | None, all_pairs: bool) -> DataFrame:
        label = F.col("class") if stars is None else F.coalesce("v", "class")
        labelled = units if stars is None else units.join(stars, units["class"] == stars["u"], "left")
        labelled = labelled.select("unit", "class", label.alias("label"))
        if stars is not None:  # units whose members are all connected have nothing left to propose
            open_units = labelled.groupBy("unit").agg(F.min("label").alias("a"), F.max("label").alias("b")).filter("a <> b").select("unit")
            labelled = labelled.join(open_units, "unit", "left_semi")
        return verified(candidate_pairs(labelled.join(facts, "class"), percent, all_pairs), sets, percent)

    stars = components(links(members.select("unit", "class"), None, False))
    split = members.groupBy("bucket").agg(F.max("block").alias("last")).filter("bucket <> 0 AND last > 0")
    pairs_of_blocks = (members.join(split, "bucket").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("last"))))
                       .filter("other <> block")
                       .select(F.xxhash64("bucket", F.least("block", "other"), F.greatest("block", "other")).alias("unit"), "class"))
    if split.limit(1).count():
        stars = components(stars.union(links(pairs_of_blocks, stars, False)))
    units = members.filter("bucket = 0").select("unit", "class").union(pairs_of_blocks)
    more = scratch_table(links(units, stars, True), "near-links")
    if more.limit(1).count():
        stars = components(stars.union(more))
    plain = rows.select("doc_id", C.KEY, "n", "class")
    labelled = (plain.join(stars, plain["class"] == stars["u"], "left")
                .select("doc_id", C.KEY, "n", F.when(F.col("n") > 0, F.coalesce("v", "class")).alias("label")))
    least = labelled.filter("label IS NOT NULL").groupBy("label").agg(
        F.coalesce(F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", C.KEY))), F.min(F.struct("doc_id", C.KEY))).alias("component"))
    return (labelled.join(least, "label", "left")
            .select("doc_id", C.KEY, "n", F.coalesce("component", F.struct("doc_id", C.KEY)).alias("component")))


def keep_one(docs: DataFrame, k: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """One row of docs for each component: that with the smallest doc_id."""
    found = near_duplicates(docs, k, percent)
    stay = found.filter((F.col("component.doc_id").eqNullSafe(F.col("doc_id"))) & (F.col(f"component.{C.KEY}") == F.col(C.KEY)))
    return C.with_decisions(docs, stay.select("doc_id", C.KEY).distinct(), "left_semi", once=True)


def op8_parity_sketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(C.table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.col("n").alias("n_shingles"), F.col("component.doc_id").alias("component_id"))


OP8_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM documents
), s AS (
  SELECT DISTINCT doc_id, words[i:i + 4] AS shingle FROM (SELECT doc_id, words, unnest(range(1, greatest(len(words) - 4, 1) + 1)) AS i FROM d WHERE len(words) > 0)
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
pairs AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b USING (shingle) WHERE a.doc_id < b.doc_id GROUP BY ALL),
links AS (SELECT x, y FROM pairs JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= 80 * (a.n + b.n - c)),
both_ways AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reach AS (SELECT doc_id, doc_id AS r FROM d UNION SELECT reach.doc_id, y FROM reach JOIN both_ways ON x = r)
SELECT d.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, least_id AS component_id
FROM d LEFT JOIN n USING (doc_id) JOIN (SELECT doc_id, min(r) AS least_id FROM reach GROUP BY doc_id) USING (doc_id)
"""
