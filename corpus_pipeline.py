"""A training corpus from raw documents: five stages, each one operator of `ridgeline.llm`.

A stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as
Parquet and read again as the next stage's docs. All but the last return the
columns of documents.

1. quality: rows that the quality rules reject go.
2. near_duplicates: of each group of near copies the smallest doc_id stays.
3. decontaminate: rows contaminated with benchmark passages go.
4. mix: rows are drawn so that expected domain tokens match the target weights
   as far as no row is repeated; rows that are most likely clean all stay.
5. shard: the rows get shards and positions.

Input cases: the stages' operators define them; an empty table passes through
all stages as an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ridgeline.llm import common, decontaminate, mixing, paritysketch, quality, sharding
from ridgeline.session import scratch_table, shared_dir

#: Shares of tokens by domain; with rates of at most 1, domains above their share are thinned out.
TARGETS = {"clean": 0.95, "toxic": 0.02, "junk": 0.03}


def stage_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs, common.table(spark, sf_dir, "labels"))


def stage_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return paritysketch.keep_one(docs)


def stage_decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.drop_contaminated(docs, common.table(spark, sf_dir, "benchmark"))


def stage_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.draw(docs, common.table(spark, sf_dir, "labels"), TARGETS, hold="clean", max_rate=1.0)


def stage_shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return sharding.assign_shards(docs, path=shared_dir(spark, "slot-map"))


STAGES = [
    ("quality", stage_quality),
    ("near_duplicates", stage_near_duplicates),
    ("decontaminate", stage_decontaminate),
    ("mix", stage_mix),
    ("shard", stage_shard),
]

#: Forests and fitted rates have no SQL form; tests compare run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what each keeps is stored before the next begins."""
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = scratch_table(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)


QUERIES = {"pipeline": run}
QUERY_SQL: dict[str, str] = {} if ORACLE_SQL is None else {"pipeline": ORACLE_SQL}
