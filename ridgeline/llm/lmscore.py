"""Language-model scores: prediction by partial matching (PPM) over bytes, and a unigram base score.

The model is a trie of byte contexts up to `ORDER` bytes long with the counts of
the bytes that follow (an end symbol closes each text). A byte's probability
comes from the longest context that has it; each shorter step costs the escape
probability of the context left (distinct symbols over symbols and occurrences),
and symbols seen in a longer context are excluded from the shorter one's counts.
Bytes never seen share the last escape evenly.

*Pretrained.* The trie grows with the corpus and is never in one place: its
counts are rows (gram: context and symbol, `ORDER` + 1 bytes in one number), made
in the tasks and added by one shuffle; shorter contexts are sums of these. The
most frequent grams (at most `FREQUENT_GRAMS`) are looked up in the tasks with
their log probabilities. The others, seen or not, are worked out once per
different gram (`gram_log10`) and joined as one row per text and gram. No key of
these joins has more than 256 rows of the trie. *Adaptive* (`score_adaptive`):
each text starts with an empty trie that learns as it codes.

The base score needs the count of every word of the corpus, which has no
bound either. The most frequent words (at most `FREQUENT`) are looked up in the tasks;
the others, which are rare and so no hot keys, meet the counts in a shuffle
join, as one row per text and word.

Input cases: a null or empty text has its end only. Very long texts are one
chunk each. A null doc_id is a training row. Rows that repeat count as often
as they occur and are scored alike. Without training rows all bytes are equally
likely and no word is known. Other columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import scratch_table
from . import common as C
from . import textnp as T

ORDER = 5  # at most 6: a context and its symbol are one number
END = 0xFF  # no UTF-8 text has this byte
SYMBOLS = 256
FREQUENT = 1 << 18
FREQUENT_GRAMS = 1 << 20
FLUSH = 1 << 20  # distinct words, and grams, that a training task holds before it sends them on
WORD, GRAM, TEXT = 0, 1, 2


class Trie:
    """The model with dictionaries, one text at a time; `order` bytes of context."""

    def __init__(self, order: int = ORDER) -> None:
        self.order, self.counts = order, {}

    @staticmethod
    def sequence(text: str | None) -> bytes:
        return (text or "").encode() + bytes([END])

    def contexts(self, seen: bytes):
        """From the longest to the empty one. A text begins after end symbols."""
        full = (bytes([END]) * self.order + seen)[-self.order:] if self.order else b""
        return [full[i:] for i in range(self.order + 1)]

    def observe(self, seen: bytes, symbol: int) -> None:
        for context in self.contexts(seen):
            node = self.counts.setdefault(context, {})
            node[symbol] = node.get(symbol, 0) + 1

    def log10(self, seen: bytes, symbol: int) -> float:
        excluded, total = frozenset(), 0.0
        for context in self.contexts(seen):
            node = self.counts.get(context, {})
            left = {s: n for s, n in node.items() if s not in excluded}
            if left:
                whole = sum(left.values()) + len(left)
                if symbol in left:
                    return total + math.log10(left[symbol] / whole)
                total += math.log10(len(left) / whole)
            excluded |= node.keys()
        return total - math.log10(SYMBOLS - len(excluded))

    def learn(self, text: str | None) -> None:
        s = self.sequence(text)
        for i, symbol in enumerate(s):
            self.observe(s[:i][-self.order:] if self.order else b"", symbol)

    def score(self, text: str | None, adapt: bool = False) -> float:
        s, total = self.sequence(text), 0.0
        for i, symbol in enumerate(s):
            seen = s[max(0, i - self.order):i]
            total += self.log10(seen, symbol)
            if adapt:
                self.observe(seen, symbol)
        return total


def _grams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(gram of each symbol, first symbol of each row) of the rows with their end symbols, as one run."""
    ends = offsets[1:] + np.arange(len(offsets) - 1)
    seq = np.full(len(data) + len(ends), END, np.int64)
    text = np.ones(len(seq), bool)
    text[ends] = False
    seq[text] = data
    first = np.concatenate([[0], ends[:-1] + 1]).astype(np.int64)
    inside = np.arange(len(seq)) - np.repeat(first, ends + 1 - first)
    code = seq.copy()
    for j in range(1, ORDER + 1):
        before = np.full(len(seq), END, np.int64)
        before[j:] = seq[:-j]
        before[inside < j] = END
        code |= before << 8 * j
    return code, first


def _merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    key, where = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
    return key, np.bincount(where, weights=np.concatenate([n for _, n in parts])).astype(np.int64)


def corpus_counts(docs: DataFrame) -> DataFrame:
    """(kind, key, n) over all of docs: words by hash, grams of `ORDER` + 1 bytes, and the number of texts."""
    def run(batches):
        held, size, texts = {WORD: [], GRAM: []}, {WORD: 0, GRAM: 0}, 0

        def send(kind: int):
            if held[kind]:
                key, n = _merged(held[kind])
                held[kind], size[kind] = [], 0
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(key), kind, np.int32)), pa.array(key.view(np.int64)), pa.array(n)], names=["kind", "key", "n"])

        def add(kind: int, keys: np.ndarray):
            held[kind].append(np.unique(keys, return_counts=True))
            size[kind] += len(held[kind][-1][0])
            if size[kind] > 2 * FLUSH:
                held[kind] = [_merged(held[kind])]
                size[kind] = len(held[kind][0][0])
                if size[kind] > FLUSH:
                    yield from send(kind)

        for batch in batches:
            texts += batch.num_rows
            for _, _, data, offsets in T.chunks(batch.column("text")):
                yield from add(GRAM, _grams(data, offsets)[0])
                low = T.LOWER[data]
                starts, ends, _ = T.word_bounds(low, offsets)
                yield from add(WORD, T.hash_spans(low, starts, ends))
        yield from send(WORD)
        yield from send(GRAM)
        if texts:
            yield pa.RecordBatch.from_arrays([pa.array([TEXT], pa.int32()), pa.array([0], pa.int64()), pa.array([texts], pa.int64())], names=["kind", "key", "n"])

    parts = docs.select("text").mapInArrow(run, "kind int, key bigint, n bigint")
    return parts.groupBy("kind", "key").agg(F.sum("n").alias("n"))


def gram_log10(grams: DataFrame, asked: DataFrame) -> DataFrame:
    """(key, p): log10 probabilities of the grams in `asked` (key) and of those in `grams` (key, n), stored.

    From the empty context to the longest, each gram takes from the one without
    its first byte: that one's count, its context's total and kinds, `p`, and
    `r`: the log probability without the symbols that its context has, for a
    symbol that it has not. A context has at most 256 grams, and a gram at
    most 256 that are one byte longer.
    """
    every = scratch_table(grams.select("key", "n").union(asked.select("key", F.lit(0).cast("long"))).groupBy("key").agg(F.sum("n").alias("n")), "lm-grams")
    n, total, kinds, left = (F.col(c) for c in ("n", "total", "kinds", "left"))
    below = None
    for k in range(ORDER + 1):
        mask = F.lit((1 << 8 * (k + 1)) - 1).cast("long")
        level = every if k == ORDER else every.groupBy(F.col("key").bitwiseAND(mask).alias("key")).agg(F.sum("n").alias("n"))
        context = W.partitionBy(F.shiftright("key", 8))
        seen = F.when(n > 0, 1).otherwise(0)
        if below is None:
            level = level.withColumns({"total": F.sum("n").over(context), "kinds": F.sum(seen).over(context)})
            r, unknown = -F.log10(F.greatest(F.lit(1), SYMBOLS - kinds)), F.lit(-math.log10(SYMBOLS))
        else:
            level = level.withColumn("suffix", F.col("key").bitwiseAND(F.lit((1 << 8 * k) - 1).cast("long"))).join(below, "suffix")
            level = level.withColumns({"total": F.sum("n").over(context), "kinds": F.sum(seen).over(context),
                                       "left": F.col("low_total") + F.col("low_kinds") - F.sum(seen * (F.col("low_n") + 1)).over(context)})
            escape = F.when(F.col("low_kinds") > kinds, F.log10(F.col("low_kinds") - kinds) - F.log10(left)).otherwise(0.0)
            r = F.when(F.col("low_n") > 0, F.log10("low_n") - F.log10(left)).otherwise(escape + F.col("low_r"))
            unknown = F.col("low_p")
        whole = F.log10(total + kinds)
        level = level.withColumn("r", r).withColumn(
            "p", F.when(n > 0, F.log10(n) - whole).when(kinds > 0, F.log10(kinds) - whole + F.col("r")).otherwise(unknown))
        below = level.select(F.col("key").alias("suffix"), *[F.col(c).alias(f"low_{c}") for c in ("n", "total", "kinds", "p", "r")])
    return scratch_table(level.select("key", "p"), "lm-gram-logs")


def score_adaptive(docs: DataFrame, order: int = ORDER) -> DataFrame:
    """doc_id, row key and score: each text coded by a trie of its own that starts empty."""
    def run(batches):
        for batch in batches:
            scores = [Trie(order).score(t, adapt=True) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column(C.KEY), pa.array(scores, pa.float64())], names=["doc_id", C.KEY, "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return C.keyed(docs).mapInArrow(run, f"doc_id {kind}, {C.KEY} bigint, score double")


def _frequent(rows: DataFrame, most: int, value: str) -> tuple[np.ndarray, np.ndarray]:
    """Keys (sorted) and values of the rows above the lowest class of `n` that leaves at most `most` of them."""
    level = F.floor(F.log2("n") * 8).cast("int")
    classes = sorted(((r["level"], r["count"]) for r in rows.groupBy(level.alias("level")).count().collect()), reverse=True)  # a few hundred
    total, lowest = 0, None
    for k, n in classes:
        if total + n > most:
            break
        total, lowest = total + n, k
    if lowest is None:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    found = rows.filter(level >= lowest).select("key", value).toArrow()  # at most `most` rows
    key, values = found.column("key").to_numpy(), found.column(value).to_numpy()
    order = np.argsort(key)
    return key[order], values[order]


def frequent_words(counts: DataFrame, most: int = FREQUENT) -> tuple[np.ndarray, np.ndarray]:
    """Hashes (sorted) and counts of the most frequent words."""
    key, n = _frequent(counts.filter(F.col("kind") == WORD), most, "n")
    order = np.argsort(key.view(np.uint64))
    return key.view(np.uint64)[order], n[order]


def frequent_grams(counts: DataFrame, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The most frequent grams (sorted) and their log10 probabilities."""
    context = W.partitionBy(F.shiftright("key", 8))  # at most 256 rows
    p = F.log10("n") - F.log10(F.sum("n").over(context) + F.count(F.lit(1)).over(context))
    return _frequent(counts.filter(F.col("kind") == GRAM).withColumn("p", p), most, "p")


def _look_up(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place in keys, whether it is there) of each wanted key."""
    at = np.minimum(np.searchsorted(keys, wanted), max(len(keys) - 1, 0))
    return at, keys[at] == wanted if len(keys) else np.zeros(len(wanted), bool)


def score_texts(docs: DataFrame, counts: DataFrame, carry: list[str]) -> DataFrame:
    """The columns `carry`, n_tokens, n_known, train_tokens, base_score and score of every row of docs.

    counts: the result of `corpus_counts`, stored.
    """
    totals = counts.filter(F.col("kind") != GRAM).agg(F.sum("n"), F.count(F.lit(1)), F.sum(F.when(F.col("kind") == TEXT, F.col("n")))).first()
    tokens, different, texts = (int(x or 0) for x in totals)
    shared = docs.sparkSession.sparkContext.broadcast((*frequent_grams(counts, FREQUENT_GRAMS), *frequent_words(counts)))
    of_end = math.log10(texts + 1)

    def run(batches):
        gram, gram_p, key, n = shared.value
        gain = np.log10(n + 1.0)
        for batch in batches:
            for lo, hi, data, offsets in T.chunks(batch.column("text")):
                codes, first = _grams(data, offsets)
                different, where = np.unique(codes, return_inverse=True)
                at, hit = _look_up(gram, different)
                value = np.zeros(len(different))
                value[hit] = gram_p[at[hit]]
                score = np.add.reduceat(value[where], first)
                far = np.flatnonzero(~hit[where])
                far_gram, far_row, far_n = T.distinct(codes[far], np.searchsorted(first, far, "right") - 1)
                far_cuts = pa.array(np.searchsorted(far_row, np.arange(hi - lo + 1)), pa.int32())
                low = T.LOWER[data]
                starts, ends, bounds = T.word_bounds(low, offsets)
                word = T.hash_spans(low, starts, ends)
                row = np.repeat(np.arange(hi - lo), np.diff(bounds))
                at, hit = _look_up(key, word)
                base = np.bincount(row[hit], weights=gain[at[hit]], minlength=hi - lo) + of_end
                known = np.bincount(row[hit], minlength=hi - lo) + (texts > 0)
                rare, rare_row, rare_n = T.distinct(word[~hit], row[~hit])
                cuts = pa.array(np.searchsorted(rare_row, np.arange(hi - lo + 1)), pa.int32())
                part = batch.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays(
                    [part.column(c) for c in carry] + [pa.array(np.diff(bounds) + 1, pa.int64()), pa.array(known, pa.int64()), pa.array(base), pa.array(score),
                     pa.ListArray.from_arrays(cuts, pa.array(rare.view(np.int64))), pa.ListArray.from_arrays(cuts, pa.array(rare_n, pa.int64())),
                     pa.ListArray.from_arrays(far_cuts, pa.array(far_gram)), pa.ListArray.from_arrays(far_cuts, pa.array(far_n, pa.int64()))],
                    names=[*carry, "n_tokens", "known", "base", "part_score", "rare", "rare_n", "far", "far_n"])

    kinds = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in carry)
    scored = docs.select(*carry, "text").mapInArrow(
        run, kinds + ", n_tokens bigint, known bigint, base double, part_score double, rare array<bigint>, rare_n array<bigint>, far array<bigint>, far_n array<bigint>")
    scored = scratch_table(scored.withColumn("_row", F.monotonically_increasing_id()), "lm-scored")

    def times(kind: int, key: str) -> DataFrame:
        return scored.select("_row", F.explode(F.arrays_zip(F.col(key).alias("key"), F.col(f"{key}_n").alias("times"))).alias("w")).select(
            "_row", F.lit(kind).alias("kind"), "w.key", "w.times")

    far = times(GRAM, "far")
    logs = gram_log10(counts.filter(F.col("kind") == GRAM), far.select("key").distinct())
    values = (counts.filter(F.col("kind") == WORD).select("kind", "key", F.log10(F.col("n") + 1).alias("value"))
              .union(logs.select(F.lit(GRAM), "key", "p")))
    is_word, product = F.col("kind") == WORD, F.col("times") * F.col("value")
    more = times(WORD, "rare").union(far).join(values, ["kind", "key"]).groupBy("_row").agg(
        F.sum(F.when(is_word, F.col("times"))).alias("more"), F.sum(F.when(is_word, product)).alias("gain"), F.sum(F.when(~is_word, product)).alias("far_score"))
    lost = math.log10(tokens + different + 1)
    return scored.select(*carry, "_row", "n_tokens", "known", "base", "part_score").join(more, "_row", "left").select(
        *carry, "n_tokens", (F.col("known") + F.coalesce("more", F.lit(0))).alias("n_known"), F.lit(tokens).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("gain", F.lit(0.0)) - F.col("n_tokens") * F.lit(lost)).alias("base_score"),
        (F.col("part_score") + F.coalesce("far_score", F.lit(0.0))).alias("score"))


def op5_ppm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = C.table(spark, sf_dir, "documents")
    held_out = F.coalesce(F.crc32(F.encode(F.col("doc_id").cast("string"), "UTF-8")) % 7 == 2, F.lit(False))
    docs = docs.select("doc_id", "text", held_out.alias("held_out"))
    counts = scratch_table(corpus_counts(docs.filter(~F.col("held_out"))), "lm-counts")
    return score_texts(docs, counts, ["doc_id", "held_out"])
