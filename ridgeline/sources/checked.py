"""S1 and S3 with proof: texts that do not fit their types are set apart, and an export says what it holds.

*Rejects.* A raw table (all texts, as from a CSV file) is conformed to an entity's
schema with `try_cast`. A row whose values all fit is good; every other row is a
reject, listed with each column that does not fit and its raw text. No row is lost:
each is good or has rejects, never both.

*Checked exports.* An export writes, beside its files, their row counts and an
order-free checksum of their rows. Source and files are compared once when the export
is made, and the files again whenever it is restored, so that a lost, cut, added or
changed file is an error and not a smaller table.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .feeds import export_csv, read_csv

MISSING, MALFORMED = "missing", "malformed"


def _problems(schema: T.StructType) -> Column:
    """The array of (column_name, raw_value, reason) of a raw row."""
    def problem(f: T.StructField) -> Column:
        raw = F.col(f.name)
        reason = F.when(raw.isNotNull() & raw.try_cast(f.dataType).isNull(), F.lit(MALFORMED))
        if not f.nullable:
            reason = reason.when(raw.isNull(), F.lit(MISSING))
        return F.when(reason.isNotNull(), F.struct(F.lit(f.name).alias("column_name"), raw.alias("raw_value"), reason.alias("reason")))

    return F.filter(F.array(*[problem(f) for f in schema.fields]), lambda p: p.isNotNull())


def conform_checked(raw: DataFrame, schema: T.StructType) -> tuple[DataFrame, DataFrame]:
    """(good, rejects) of a raw table whose columns are texts.

    good: the schema's columns. rejects: all raw columns as they are, and for each
    problem of the row column_name, raw_value and reason ('malformed', or 'missing'
    for a NULL where the schema has none). Columns that raw lacks are NULL. A row
    with several problems has several rejects.
    """
    known = raw.select("*", *[F.lit(None).cast("string").alias(f.name) for f in schema.fields if f.name not in raw.columns])
    told = known.withColumn("_problems", _problems(schema))
    good = told.filter(F.size("_problems") == 0).select(*[F.col(f.name).try_cast(f.dataType).alias(f.name) for f in schema.fields])
    rejects = told.filter(F.size("_problems") > 0).select(*raw.columns, F.inline("_problems"))
    return good, rejects


class BrokenExport(RuntimeError):
    """The files of an export are not those that were written."""


def _row_hash(columns: Sequence[str]) -> Column:
    return F.xxhash64(*[F.col(c) for c in sorted(columns)], *[F.col(c).isNull() for c in sorted(columns)])


def _figures(columns: Sequence[str]) -> list[Column]:
    """Row count and checksum: neither depends on order, and both add up over files."""
    h = _row_hash(columns)
    return [F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(h.cast("decimal(38,0)")), F.lit(0).cast("decimal(38,0)")).alias("total"),
            F.coalesce(F.bit_xor(h), F.lit(0)).cast("bigint").alias("mixed")]


def _files(spark: SparkSession, path: str, schema: T.StructType, preferred: Sequence[str], drop: Sequence[str]) -> DataFrame:
    """(file, n, total, mixed) of the files as they are now; an empty file has no row."""
    columns = [c for c in schema.fieldNames() if c not in drop]
    rows = read_csv(spark, path, schema, preferred, drop, with_file="_file")
    return rows.groupBy(F.col("_file").alias("file")).agg(*_figures(columns))


def export_checked(t: DataFrame, path: str, preferred: Sequence[str] = (), drop: Sequence[str] = ()) -> None:
    """S3: `feeds.export_csv`, then the figures of its files in `path`/_files.

    The source's count and checksum are observed while it is written; if the files
    do not come to the same, the export is broken and no figures are stored.
    """
    spark = t.sparkSession
    schema = T.StructType([f for f in t.schema.fields if f.name not in drop])
    seen = Observation()
    export_csv(t.drop(*drop).observe(seen, *_figures(schema.fieldNames())), path, preferred)
    files = _files(spark, path, schema, preferred, ())
    now = files.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("total"), F.lit(0)).alias("total"), F.coalesce(F.bit_xor("mixed"), F.lit(0)).alias("mixed")).first()
    if (now.n, now.total, now.mixed) != tuple(seen.get[c] for c in ("n", "total", "mixed")):
        raise BrokenExport(f"{path}: the files hold {now.n} rows, the source {seen.get['n']}, or other rows")
    files.write.parquet(f"{path.rstrip('/')}/_files")  # readers of the export pass over names that begin with _


def check_export(spark: SparkSession, path: str, schema: T.StructType, preferred: Sequence[str] = (), drop: Sequence[str] = ()) -> DataFrame:
    """(file, expected, found, ok): each file that was written or is there, with its rows then and now."""
    then = spark.read.parquet(f"{path.rstrip('/')}/_files").alias("a")
    now = _files(spark, path, schema, preferred, drop).alias("b")
    both = then.join(now, "file", "full")
    same = F.col("a.n").eqNullSafe(F.col("b.n")) & F.col("a.total").eqNullSafe(F.col("b.total")) & F.col("a.mixed").eqNullSafe(F.col("b.mixed"))
    return both.select("file", F.coalesce("a.n", F.lit(0)).alias("expected"), F.coalesce("b.n", F.lit(0)).alias("found"), same.alias("ok"))


def restore_checked(spark: SparkSession, path: str, schema: T.StructType, preferred: Sequence[str] = (), drop: Sequence[str] = ()) -> DataFrame:
    """S3: the table that was exported, after its files have been checked."""
    bad = check_export(spark, path, schema, preferred, drop).filter("NOT ok").orderBy("file").limit(5).collect()  # a few names for the message
    if bad:
        raise BrokenExport(f"{path}: " + "; ".join(f"{r.file} has {r.found} rows, {r.expected} were written, or other rows" for r in bad))
    return read_csv(spark, path, schema, preferred, drop)
