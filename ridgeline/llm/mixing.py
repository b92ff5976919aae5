"""Mixing documents to target domain weights by soft membership, in DataFrame operations.

A classifier trained on the labelled table (multinomial naive Bayes over hashed
words and word endings) gives each document a posterior over domains. Document
rates between 0 and `max_rate` are then fitted so that the expected tokens of
each domain, sum of rate * tokens * posterior, match the targets: projected
gradient on least squares, weighted by the inverse of the domains' Gram matrix
(a step of 1 is then safe); step lengths are the ratio of the last change of the
rates to that of the gradient (Barzilai and Borwein). A rate depends on its
document only through the posterior and the gradients of the rounds, one number
per domain and round, so the rates are an expression: each round is one
aggregation over the table of posteriors, nothing per document is kept, and the
driver sees a few sums.

The model is fitted on a bounded sample of labelled rows (about `MAX_TRAIN`, those
with the smallest id hashes); its size is fixed by the number of buckets, so it
can be broadcast. All texts are classified whole, in one pass that never shuffles them.

Domains: quality 0 is junk, else toxic 1 is toxic, else clean. Input cases: a
null or empty text has 0 tokens, the prior as posterior and a rate like any
other. Labels with nulls are left out; a document with several labels takes the
worst. Without labels every rate is 1. Targets of domains that the labels lack
are shared out among the others. Rows that repeat are classified once and count
as often as they occur. Other columns are ignored.
"""

from __future__ import annotations

import json
import math
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_table
from . import common as C

DOMAINS = ("clean", "toxic", "junk")
TARGETS = {"clean": 0.90, "toxic": 0.02, "junk": 0.08}
WORD_BUCKETS, END_BUCKETS = 1 << 15, 1 << 10
LEAST_Z, LEAST_RATIO = 8.0, 2.0  # a bucket speaks for or against a domain from this deviation on
MAX_TRAIN = 10_000
ROUNDS, TOLERANCE = 60, 1e-4  # tolerance: of all target tokens
FIRST_STEP, LEAST_STEP, MOST_STEP = 1.5, 1.0, 100.0


def domain() -> Column:
    return F.when(F.col("quality") == 0, "junk").when(F.col("toxic") == 1, "toxic").otherwise("clean")


def word_rows(docs: DataFrame, *carry: str) -> DataFrame:
    """A row per word and an empty one per text: the columns `carry`, word bucket and bucket of the word's ending."""
    words = F.array_append(F.array_remove(F.split(F.coalesce("text", F.lit("")), r"[\x20\x09-\x0D]+"), ""), "")
    rows = docs.select(*carry, F.explode(words).alias("_word"))
    word = F.col("_word")
    return rows.select(*carry, F.when(word == "", -1).otherwise(F.pmod(F.xxhash64(word), F.lit(WORD_BUCKETS))).cast("int").alias("word"),
                       F.when(word == "", -1).otherwise(F.pmod(F.xxhash64(F.right(word, F.lit(2))), F.lit(END_BUCKETS))).cast("int").alias("end"))


def train(docs: DataFrame, labels: DataFrame) -> tuple[list[str], list[float], dict[str, dict[int, list[float]]]]:
    """(domains that occur, log priors, weights by 'word' and 'end': {bucket: [by domain]}).

    A weight is the log of a bucket's share of the domain's tokens over its
    share of all. Buckets count by themselves only if the documents that have
    them deviate clearly between domains; all others are one background
    bucket (-1), so that noise of rare words does not add up over long texts.
    """
    marks = labels.filter("doc_id IS NOT NULL AND quality IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg(
        F.min("quality").alias("quality"), F.max("toxic").alias("toxic"))
    sample = C.hash_sample(marks, MAX_TRAIN, "doc_id").select("doc_id", domain().alias("domain"))
    rows = word_rows(docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id"), "doc_id", "domain")  # about MAX_TRAIN rows of two columns
    both = F.explode(F.array(*[F.struct(F.lit(kind).alias("kind"), F.col(kind).alias("bucket")) for kind in ("word", "end")]))
    counts = (rows.groupBy("doc_id", "domain", "word", "end").agg(F.count(F.lit(1)).alias("n")).select("doc_id", "domain", "n", both.alias("f"))
              .groupBy("doc_id", "domain", "f.kind", "f.bucket").agg(F.sum("n").alias("n"))
              .groupBy("domain", "kind", "bucket").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("docs")).collect())  # domains x buckets rows at most
    known = [d for d in DOMAINS if any(r["domain"] == d for r in counts)]
    texts, weights = np.zeros(len(known)), {}
    for kind, size in (("word", WORD_BUCKETS), ("end", END_BUCKETS)):
        n, having = np.zeros((size, len(known))), np.zeros((size, len(known)))
        for r in counts:
            if r["kind"] == kind:
                k = known.index(r["domain"])
                if r["bucket"] < 0:
                    texts[k] = r["docs"]
                else:
                    n[r["bucket"], k], having[r["bucket"], k] = r["n"], r["docs"]
        expected = having.sum(axis=1, keepdims=True) * texts / max(1.0, texts.sum())
        far = (having - expected) ** 2 > LEAST_Z ** 2 * np.maximum(expected, 1e-9)
        clear = (far & (np.abs(np.log((having + 1) / (expected + 1))) > math.log(LEAST_RATIO))).any(axis=1)
        own = np.vstack([n[clear], n[~clear].sum(axis=0)]) + 1.0
        share = np.log(own / own.sum(axis=0)) - np.log(own.sum(axis=1, keepdims=True) / own.sum()) if len(known) else own
        weights[kind] = dict(zip([*np.flatnonzero(clear).tolist(), -1], share.tolist(), strict=True))
    return known, [math.log(x / texts.sum()) for x in texts], weights


def _weights(spark: SparkSession, kind: str, weights: dict[int, list[float]]) -> DataFrame:
    rows = [{kind: b, f"{kind}_w": w} for b, w in weights.items() if b >= 0]
    return spark.range(1).select(F.inline(F.from_json(F.lit(json.dumps(rows)), f"array<struct<{kind}:int,{kind}_w:array<double>>>")))


def posteriors(docs: DataFrame, labels: DataFrame) -> tuple[list[str], DataFrame]:
    """The domains, and doc_id, row key, copies, tokens and p (array by domain) of each different (doc_id, text), stored."""
    known, prior, weights = train(docs, labels)
    spark, size = docs.sparkSession, max(1, len(known))
    rows = word_rows(docs.select("doc_id", "text", C.text_key().alias(C.KEY)), "doc_id", C.KEY)
    if known:
        for kind in ("word", "end"):
            rows = rows.join(F.broadcast(_weights(spark, kind, weights[kind])), kind, "left")  # at most a fixed number of buckets
        score = [F.sum(F.when(F.col("word") >= 0, sum(F.coalesce(F.col(f"{kind}_w")[k], F.lit(weights[kind][-1][k])) for kind in ("word", "end")))
                       .otherwise(0.0)) for k in range(size)]
    else:
        prior, score = [0.0], [F.lit(0.0)]
    ends = F.count_if(F.col("word") == -1)
    sums = rows.groupBy("doc_id", C.KEY).agg(
        ends.alias("copies"), (F.count_if(F.col("word") >= 0) / ends).cast("long").alias("tokens"),
        *[(F.lit(prior[k]) + score[k] / ends).alias(f"s{k}") for k in range(size)])
    top = F.greatest(*[F.col(f"s{k}") for k in range(size)]) if size > 1 else F.col("s0")
    powers = [F.exp(F.col(f"s{k}") - top) for k in range(size)]
    total = sum(powers[1:], powers[0])
    return known or ["unlabelled"], scratch_table(
        sums.select("doc_id", C.KEY, "copies", "tokens", *[(x / total).alias(f"p{k}") for k, x in enumerate(powers)]), "mix-posteriors")


def moved(r: Column, step: list[float], max_rate: float) -> Column:
    """A rate after one more round, from the columns p0, p1, ..."""
    move = sum((F.col(f"p{k}") * F.lit(float(y)) for k, y in enumerate(step)), F.lit(0.0))
    return F.greatest(F.lit(0.0), F.least(F.lit(max_rate), r - move))


def rate(steps: list[list[float]], max_rate: float) -> Column:
    """The rate after the given rounds; every rate starts at 1."""
    return reduce(lambda r, step: moved(r, step, max_rate), steps, F.lit(1.0))


def most_likely(known: list[str]) -> Column:
    """The domain with the largest posterior, from the columns p0, p1, ..."""
    return F.array_max(F.array(*[F.struct(F.col(f"p{k}").alias("p"), F.lit(d).alias("d")) for k, d in enumerate(known)]))["d"]


def fit_rates(members: DataFrame, known: list[str], targets: dict[str, float], budget: float | None = None,
              hold: str | None = None, max_rate: float = 1e9) -> tuple[list[list[float]], dict[str, float]]:
    """The gradient steps and the token targets by domain.

    Targets are shares of `budget` tokens: by default as many as there are, or
    with `hold` so many that this domain's target is what it has now. Documents
    whose most likely domain is `hold` then keep rate 1, and the rates of the
    others are fitted to the targets of the other domains.
    """
    size = len(known)
    tokens = F.col("tokens") * F.col("copies")

    def sums(rows: DataFrame, r: Column, *more: Column) -> np.ndarray:
        cols = [F.sum(r * tokens * F.col(f"p{k}")) for k in range(size)]
        return np.array([x or 0.0 for x in rows.agg(*cols, *more).first()])

    r, free, rest, fitted = F.lit(1.0), members, np.zeros(size), np.ones(size)
    products = [F.sum(tokens * F.col(f"p{k}") * F.col(f"p{j}")) for k in range(size) for j in range(size)]
    first = sums(members, r, *products)
    expected, gram = first[:size], first[size:].reshape(size, size)
    share = np.array([max(0.0, targets.get(d, 0.0)) for d in known])
    if share.sum() == 0 or expected.sum() == 0:
        return [], dict(zip(known, expected.tolist(), strict=True))
    share = share / share.sum()
    if hold in known and share[known.index(hold)] > 0:
        budget = expected[known.index(hold)] / share[known.index(hold)]
        free = members.filter(most_likely(known) != hold)
        first, fitted[known.index(hold)] = sums(free, r, *products), 0.0
        rest, gram = expected - first[:size], first[size:].reshape(size, size) * np.outer(fitted, fitted)
    wanted = share * (expected.sum() if budget is None else budget)
    inverse, steps = np.linalg.pinv(gram, rcond=1e-9), []
    gap, step = (expected - wanted) * fitted, FIRST_STEP
    while len(steps) < ROUNDS and np.abs(gap).max() > TOLERANCE * wanted.sum():
        steps.append((step * (inverse @ gap)).tolist())
        last, r = r, moved(r, steps[-1], max_rate)
        found = sums(free, r, F.sum(tokens * (r - last) * (r - last)))
        change = (found[:size] + rest - wanted) * fitted - gap
        gap = gap + change
        if np.abs(change).max() <= TOLERANCE * wanted.sum() / 10:  # the bounds allow no more
            break
        curvature = change @ inverse @ change
        step = float(np.clip(found[size] / curvature, LEAST_STEP, MOST_STEP)) if curvature > 0 else FIRST_STEP
    return steps, dict(zip(known, wanted.tolist(), strict=True))


def mix(docs: DataFrame, labels: DataFrame, targets: dict[str, float], budget: float | None = None,
        hold: str | None = None, max_rate: float = 1e9) -> DataFrame:
    """doc_id, row key, copies (rows of this id and text), tokens, domain, posterior by domain, rate and draws.

    draws: how often the mixture takes each of these rows, the rate rounded
    down or up by a hash of the row, so that expectations hold.
    """
    known, members = posteriors(docs, labels)
    steps, _ = fit_rates(members, known, targets, budget, hold, max_rate)
    chance = F.pmod(F.xxhash64(F.lit("mix"), C.KEY), F.lit(1 << 30)) / F.lit(float(1 << 30))
    p = [F.col(f"p{k}") for k in range(len(known))]
    rates = rate(steps, max_rate)
    if hold in known and targets.get(hold, 0.0) > 0:
        rates = F.when(most_likely(known) == hold, min(1.0, max_rate)).otherwise(rates)
    return members.withColumn("rate", rates).select(
        "doc_id", C.KEY, "copies", "tokens", most_likely(known).alias("domain"),
        *[(p[known.index(d)] if d in known else F.lit(0.0)).alias(f"p_{d}") for d in DOMAINS],
        "rate", F.floor(F.col("rate") + chance).cast("int").alias("draws"))


def draw(docs: DataFrame, labels: DataFrame, targets: dict[str, float], hold: str | None = None, max_rate: float = 1e9) -> DataFrame:
    """The mixture: rows of docs as often as they are drawn, with the columns of docs."""
    times = C.free_name(docs, "draws")
    drawn = mix(docs, labels, targets, None, hold, max_rate).filter("draws > 0").select("doc_id", C.KEY, F.col("draws").alias(times))
    out = C.with_decisions(docs, drawn, "inner")
    return out.withColumn(times, F.explode(F.sequence(F.lit(1), F.col(times)))).select(*docs.columns)


def op1_soft_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix(C.table(spark, sf_dir, "documents"), C.table(spark, sf_dir, "labels"), TARGETS)
    rows = mixed.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    return rows.select("doc_id", "tokens", "domain", *[f"p_{d}" for d in DOMAINS], "rate", "draws")
