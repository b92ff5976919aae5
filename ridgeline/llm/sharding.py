"""Sharding by fixed virtual slots.

Records are hashed into a fixed number of virtual slots (thousands), the bytes
of each slot are summed, and a small versioned table maps slots to shards.
Rebalancing or adding a shard edits that map: it moves slots and never rehashes
a record. All work on records is a scan, one aggregation to at most `n_slots`
rows and one window per virtual slot; the only thing on the driver is the map,
whose size is the fixed number of slots.

Input cases: a null text has size 1 (its record separator) and hash 0; a null
doc_id is hashed together with the text. Rows equal in doc_id and text share a
virtual slot and get consecutive positions. Empty tables give no rows. Other
columns of the input are ignored.
"""

from __future__ import annotations

import json
from bisect import bisect_left, insort

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import shared_dir
from . import common as C

N_SLOTS = 4096
MAP_SCHEMA = "array<struct<version:int,virtual_slot:int,shard:int>>"


def records(docs: DataFrame, n_slots: int = N_SLOTS) -> DataFrame:
    """doc_id, size (UTF-8 bytes and 1), text_crc32 and virtual slot of each record."""
    text = F.coalesce("text", F.lit(""))
    return docs.select(
        "doc_id",
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
        C.text_key().alias(C.KEY),
        F.pmod(C.text_key(), F.lit(n_slots)).cast("int").alias("virtual_slot"))


def slot_sizes(recs: DataFrame) -> DataFrame:
    """Bytes and records of each virtual slot that has any: at most n_slots rows."""
    return recs.groupBy("virtual_slot").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("records"))


def initial_map(n_slots: int, n_shards: int) -> list[int]:
    """Version 0: slots dealt out in turn. The list's index is the virtual slot."""
    return [s % n_shards for s in range(n_slots)]


def rebalance(shard_of: list[int], slot_bytes: list[int], n_shards: int) -> list[int]:
    """Edit a map so that the shards' bytes come close to equal.

    The fullest shard gives the emptiest one the slot, or exchanges the pair
    of slots, that comes nearest to closing half of the gap between them,
    until no such step makes the gap smaller. With a new shard (n_shards one
    larger than before) slots move into it in the same way.
    """
    out = list(shard_of)
    held: list[list[tuple[int, int]]] = [[] for _ in range(n_shards)]
    load = [0] * n_shards
    for slot, shard in enumerate(out):
        insort(held[shard], (slot_bytes[slot], slot))
        load[shard] += slot_bytes[slot]

    def nearest(shard: int, size: float) -> list[tuple[int, int]]:
        at = bisect_left(held[shard], (size, -1))
        return held[shard][max(0, at - 1):at + 1]

    while n_shards > 1:
        full, empty = max(range(n_shards), key=load.__getitem__), min(range(n_shards), key=load.__getitem__)
        gap = load[full] - load[empty]
        steps = [(abs(gap - 2 * b), (b, s), None) for b, s in nearest(full, gap / 2)]
        if not any(d < gap // 2 for d, _, _ in steps):  # no slot comes near: look for a pair
            steps += [(abs(gap - 2 * (b - o[0])), (b, s), o) for b, s in held[full] for o in nearest(empty, b - gap / 2)]
        left, give, take = min(steps, default=(gap, None, None), key=lambda x: (x[0], x[1], x[2] or (-1, -1)))
        if give is None or left >= gap:
            break
        for item, a, b in ((give, full, empty), (take, empty, full)):
            if item is not None:
                held[a].remove(item)
                insort(held[b], item)
                load[a] -= item[0]
                load[b] += item[0]
                out[item[1]] = b
    return out


def map_table(spark: SparkSession, versions: dict[int, list[int]]) -> DataFrame:
    """(version, virtual_slot, shard): every version of the map, kept side by side."""
    rows = [{"version": v, "virtual_slot": s, "shard": shard} for v, m in versions.items() for s, shard in enumerate(m)]
    return spark.range(1).select(F.inline(F.from_json(F.lit(json.dumps(rows)), MAP_SCHEMA)))


def save_map(slot_map: DataFrame, path: str) -> None:
    """Store the versions; a newer version is appended, older ones stay readable."""
    slot_map.coalesce(1).write.mode("append").parquet(path)


def load_map(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """(virtual_slot, shard) of one version, the newest by default."""
    m = spark.read.parquet(path)
    if version is None:
        version = m.agg(F.max("version")).first()[0]
    return m.filter(F.col("version") == version).select("virtual_slot", "shard")


def newest_map(spark: SparkSession, path: str, n_slots: int) -> tuple[int, list[int]] | None:
    """The newest version stored at path and its number, or None where no map is stored."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
        return None
    version = spark.read.parquet(path).agg(F.max("version")).first()[0]
    shard_of = {r["virtual_slot"]: r["shard"] for r in load_map(spark, path, version).collect()}  # n_slots rows
    if sorted(shard_of) != list(range(n_slots)):
        raise ValueError(f"the map at {path} does not have the slots 0 to {n_slots - 1}")
    return version, [shard_of[s] for s in range(n_slots)]


def assign_shards(docs: DataFrame, n_shards: int = 8, n_slots: int = N_SLOTS, path: str | None = None) -> DataFrame:
    """Every record with its shard under the rebalanced map and its position there.

    `slot` numbers the records of a shard from 0 without gaps: records before
    the virtual slot (from the slot counts) and the record's rank within it.
    The window's groups are virtual slots, so thousands share the work.
    `path`: the map's versions (0: initial, 1: rebalanced) are stored there. If
    it holds a map, the newest version is edited and stored as the next one;
    slots of shards that are no longer there are first dealt out in turn.
    """
    spark, recs = docs.sparkSession, records(docs, n_slots)
    sizes = {r["virtual_slot"]: r for r in slot_sizes(recs).collect()}  # at most n_slots rows
    stored = newest_map(spark, path, n_slots) if path else None
    version, first = stored or (0, initial_map(n_slots, n_shards))
    first = [shard if shard < n_shards else s % n_shards for s, shard in enumerate(first)]
    second = rebalance(first, [sizes[s]["bytes"] if s in sizes else 0 for s in range(n_slots)], n_shards)
    versions = map_table(spark, {version + 1: second} if stored else {version: first, version + 1: second})
    if path:
        save_map(versions, path)
        current = load_map(spark, path, version + 1)
    else:
        current = versions.filter("version = 1").select("virtual_slot", "shard")
    before, start = [0] * n_shards, []
    for s in range(n_slots):
        start.append({"virtual_slot": s, "start": before[second[s]]})
        before[second[s]] += sizes[s]["records"] if s in sizes else 0
    starts = spark.range(1).select(F.inline(F.from_json(F.lit(json.dumps(start)), "array<struct<virtual_slot:int,start:bigint>>")))
    slots = current.join(starts, "virtual_slot")  # n_slots rows
    rank = F.row_number().over(W.partitionBy("virtual_slot").orderBy("doc_id", C.KEY)) - 1
    return recs.withColumn("_rank", rank).join(F.broadcast(slots), "virtual_slot").select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
        (F.col("start") + F.col("_rank")).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"), "virtual_slot")


def op10_virtual_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assign_shards(C.table(spark, sf_dir, "documents"), path=shared_dir(spark, "slot-map"))
