"""Language identification: multinomial naive Bayes over hashed character n-grams.

Training counts the hashed n-grams of each labelled text by language, in the
tasks; a shuffle adds the counts, and the model is a matrix of log
probabilities, languages by `BUCKETS`, whose size depends on neither the texts
nor their number. Scoring looks the n-grams of a batch up in that matrix
(sent once to each executor) and adds them per text; only the buckets that a
text has are touched.

All labelled rows train the model and all characters of every text count.

Input cases: a null text, and one without a letter, is `und` with score 0, as
is every text if nothing was learned. Rows with a null language don't train.
Very long texts are one chunk each. Rows that repeat count as often as they
occur and get equal predictions. The matrix has a column for each language, so
more than `LANGUAGES` different values of lang (a column that holds something else)
are refused with a ValueError before anything is counted. Other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C
from . import textnp as T

ORDERS = (1, 2, 3)
BUCKETS = 1 << 15
SMOOTHING = 0.5
LANGUAGES = 512  # a matrix of 128 MB
CHUNK_CHARS = 1 << 18


def _char_chunks(texts: pa.Array):
    """(first row, code points of lower-cased texts, offsets) of row ranges of bounded size."""
    rows, size, lo = [], 0, 0
    values = texts.to_pylist()
    for i, text in enumerate(values):
        rows.append((text or "").lower())
        size += len(rows[-1])
        if size >= CHUNK_CHARS or i == len(values) - 1:
            points = np.frombuffer("".join(rows).encode("utf-32-le", "replace"), np.uint32)
            yield lo, points, np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int64)
            rows, size, lo = [], 0, i + 1


def _grams(points: np.ndarray, offsets: np.ndarray):
    """(buckets, index of the first character) for each order; n-grams do not cross rows."""
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    code = T.mix(points.astype(np.uint64) + np.uint64(1))
    acc = np.zeros(len(points), np.uint64)
    for n in range(1, max(ORDERS) + 1):
        if len(points) < n:
            return
        acc = acc[:len(points) - n + 1] * np.uint64(0x9E3779B97F4A7C15) + code[n - 1:]
        if n in ORDERS:
            inside = row[:len(acc)] == row[n - 1:]
            at = np.flatnonzero(inside)
            yield (T.mix(acc[at] + np.uint64(n)) % np.uint64(BUCKETS)).astype(np.int64), at


def count_grams(docs: DataFrame) -> DataFrame:
    """(lang, bucket, n, rows): n-gram counts by language; bucket -1 counts the texts."""
    def run(batches):
        counts: dict[str, np.ndarray] = {}
        for batch in batches:
            langs = batch.column("lang").to_pylist()
            for lo, points, offsets in _char_chunks(batch.column("text")):
                of_row = np.array(langs[lo:lo + len(offsets) - 1], object)
                names, code = np.unique(of_row.astype(str), return_inverse=True)
                for i, name in enumerate(names.tolist()):
                    if name not in counts:
                        counts[name] = np.zeros(BUCKETS + 1, np.int64)
                    counts[name][BUCKETS] += int((code == i).sum())
                of_char = np.repeat(code, np.diff(offsets))
                for bucket, at in _grams(points, offsets):
                    both = np.bincount(of_char[at] * BUCKETS + bucket, minlength=len(names) * BUCKETS)
                    for i, name in enumerate(names.tolist()):
                        counts[name][:BUCKETS] += both[i * BUCKETS:(i + 1) * BUCKETS]
        for name, n in counts.items():
            used = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays(
                [pa.array([name] * len(used)), pa.array(np.where(used == BUCKETS, -1, used), pa.int32()), pa.array(n[used])], names=["lang", "bucket", "n"])

    parts = docs.select("text", "lang").filter("text IS NOT NULL AND lang IS NOT NULL").mapInArrow(run, "lang string, bucket int, n bigint")
    return parts.groupBy("lang", "bucket").agg(F.sum("n").alias("n"))


def train(docs: DataFrame) -> tuple[list[str], np.ndarray, np.ndarray]:
    """(languages, log priors, log probabilities [bucket, language]) from the columns text and lang."""
    n = docs.filter("text IS NOT NULL").agg(F.count_distinct("lang")).first()[0]
    if n > LANGUAGES:
        raise ValueError(f"lang has {n} different values; the model holds {LANGUAGES} languages at most")
    counts = count_grams(docs).toArrow()  # languages x BUCKETS rows at most, whatever the corpus
    langs = sorted(set(counts.column("lang").to_pylist()))
    where = {name: i for i, name in enumerate(langs)}
    lang = np.array([where[x] for x in counts.column("lang").to_pylist()], np.int64)
    bucket, n = counts.column("bucket").to_numpy(), counts.column("n").to_numpy().astype(float)
    texts, grams = np.zeros(len(langs)), np.full((BUCKETS, len(langs)), SMOOTHING)
    texts[lang[bucket < 0]] = n[bucket < 0]
    grams[bucket[bucket >= 0], lang[bucket >= 0]] += n[bucket >= 0]
    if not langs:
        return [], texts, grams
    return langs, np.log(texts / texts.sum()), np.log(grams / grams.sum(axis=0))


def has_letter(text: str | None) -> bool:
    return text is not None and any(map(str.isalpha, text))


def predict(docs: DataFrame, model: tuple[list[str], np.ndarray, np.ndarray], carry: list[str]) -> DataFrame:
    """The columns `carry`, lang_pred and score (posterior of the predicted language). Only text is looked at."""
    langs, prior, _ = model
    shared = docs.sparkSession.sparkContext.broadcast(model[2])

    def run(batches):
        table = np.ascontiguousarray(shared.value)
        for batch in batches:
            texts = batch.column("text")
            best, score = np.zeros(len(texts), np.int64), np.zeros(len(texts))
            for lo, points, offsets in _char_chunks(texts) if langs else ():
                total = np.tile(prior, (len(offsets) - 1, 1))
                for bucket, at in _grams(points, offsets):
                    first = np.searchsorted(at, offsets)
                    for j in range(len(langs)):
                        sums = np.concatenate([[0.0], np.cumsum(table[:, j][bucket])])
                        total[:, j] += sums[first[1:]] - sums[first[:-1]]
                total -= total.max(axis=1, keepdims=True)
                rows = slice(lo, lo + len(total))
                best[rows] = total.argmax(axis=1)
                score[rows] = 1 / np.exp(total).sum(axis=1)
            known = np.array([bool(langs) and has_letter(t) for t in texts.to_pylist()], bool)
            names = [langs[b] if k else "und" for b, k in zip(best.tolist(), known.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(c) for c in carry] + [pa.array(names, pa.string()), pa.array(np.where(known, score, 0.0))],
                names=[*carry, "lang_pred", "score"])

    kinds = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in carry)
    return docs.select(*carry, "text").mapInArrow(run, kinds + ", lang_pred string, score double")


def op2_ngram_bayes(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = C.table(spark, sf_dir, "documents")
    held_out = F.coalesce(F.crc32(F.encode(F.col("doc_id").cast("string"), "UTF-8")) % 5 == 0, F.lit(False))
    docs = docs.select("doc_id", "text", "lang", held_out.alias("held_out"))
    return predict(docs, train(docs.filter(~F.col("held_out"))), ["doc_id", "held_out"])
