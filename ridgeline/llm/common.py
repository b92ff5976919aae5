"""Reading, row keys and decisions shared by the operators of this package."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Identifies a row besides its doc_id; rows equal in both have equal texts.
KEY = "_text_key"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def text_key(doc_id: str | Column = "doc_id", text: str | Column = "text") -> Column:
    """64-bit hash of id and text. Together with doc_id it names a row: rows that
    agree in both have the same text, so a result for one holds for the other."""
    return F.xxhash64(doc_id, text)


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, text and the row key; other columns (whatever their names) are left out."""
    return docs.select("doc_id", "text", text_key().alias(KEY))


def ascii_lower(c: Column) -> Column:
    """A-Z to a-z, every other character unchanged.

    `lower` changes other letters as well, so it serves only texts that are
    ASCII throughout; the rest goes through `translate`.
    """
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.when(F.octet_length(c) == F.length(c), F.lower(c)).otherwise(F.translate(c, upper, upper.lower()))


def hash_sample(rows: DataFrame, most: int, *by: str) -> DataFrame:
    """About `most` rows (all, if there are fewer), those with the smallest hashes of the columns `by`.

    The hash bound comes from the number of rows, so nothing is sorted and no
    task or driver gathers more than the sample.
    """
    n = rows.count()
    if n <= most:
        return rows
    return rows.filter(F.pmod(F.xxhash64(F.lit("sample"), *by), F.lit(1 << 40)) < int(most / n * (1 << 40)))


def free_name(docs: DataFrame, base: str) -> str:
    """`base`, or `base` with underscores in front, that no column of docs has."""
    while base in docs.columns:
        base = "_" + base
    return base


def with_decisions(docs: DataFrame, decisions: DataFrame, how: str, once: bool = False) -> DataFrame:
    """Join `docs` with decisions per (doc_id, KEY), one row per key at most.

    `how`: inner, left, left_semi or left_anti. A null doc_id matches a null
    doc_id. The columns of docs come first, then those of the decisions,
    whose names must be free (see `free_name`).
    `once`: of rows that agree in doc_id and text, one stays (no further
    shuffle after a shuffle join, which already brings them together).
    """
    ident, key = free_name(docs, "_ident"), free_name(docs, "_key")
    extra = [] if how in ("left_semi", "left_anti") else [c for c in decisions.columns if c not in ("doc_id", KEY)]
    name = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    left = docs.withColumns({ident: name("doc_id"), key: text_key()})
    right = decisions.select(name("doc_id").alias(ident), F.col(KEY).alias(key), *extra)
    out = left.join(right, [ident, key], how)
    if once:
        out = out.dropDuplicates([ident, key])
    return out.select(*docs.columns, *extra)
