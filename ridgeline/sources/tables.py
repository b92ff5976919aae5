"""Open the base tables and derive the three club entities.

The driver's Parquet tables are TPC-H shaped. ``members``, ``activities`` and
``attendance`` are derived from them by fixed rules (kept identical to the
SQL in FIXTURES.md, which the DuckDB oracle runs). Everything is lazy: column
pruning and date-range filters written downstream reach the Parquet scans.

For repeated runs two storage layouts are offered: activities partitioned by
day (`save_by_date`) and attendance with its activity's month as a partition
column (`save_attendance_by_month`); month filters then prune directories.
"""

from __future__ import annotations

import datetime as _dt
import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

BASE_TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem",
    "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)

# Reference date and months used by the registered queries.
AS_OF = _dt.date(2001, 7, 15)
MONTH = "2001-07"
FIRST_MONTH = "1995-06"

MEMBERS_SCHEMA = T.StructType([
    T.StructField("user_no", T.LongType(), False),
    T.StructField("name", T.StringType()),
    T.StructField("birth_year", T.IntegerType()),
    T.StructField("gender", T.StringType()),
    T.StructField("area", T.StringType()),
    T.StructField("role", T.StringType()),
    T.StructField("point", T.IntegerType()),
    T.StructField("description", T.StringType()),
    T.StructField("profile_image_url", T.StringType()),
    T.StructField("created_at", T.DateType()),
])
ACTIVITIES_SCHEMA = T.StructType([
    T.StructField("event_id", T.LongType(), False),
    T.StructField("date", T.DateType()),
    T.StructField("title", T.StringType()),
    T.StructField("host", T.LongType()),
    T.StructField("score", T.IntegerType()),
    T.StructField("album_url", T.StringType()),
])
ATTENDANCE_SCHEMA = T.StructType([
    T.StructField("event_id", T.LongType()),
    T.StructField("user_no", T.LongType()),
])


# Declared schemas of the base tables: reading one starts no job.
BASE_SCHEMAS = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
              "o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, "
                "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, "
                "l_shipdate timestamp_ntz",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
    "embeddings": "vec_id bigint, embedding array<float>, label int",
    "pages": "page_id bigint, url string, html string",
    "benchmark": "item_id bigint, text string",
    "labels": "doc_id bigint, quality int, toxic int",
    "conversations": "conv_id bigint, turn bigint, role string, text string",
}


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A base table with its declared schema. Files are listed anew on each call,
    so rows that are appended later are seen."""
    return spark.read.schema(BASE_SCHEMAS[name]).parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


# The derivations as SQL expressions, one per column and with the schema's types
# (FIXTURES.md has them as whole statements). Descriptions hold what a
# line-based export must not lose: every kind of line break, the escape
# character, the quote, and a text that looks like the NULL mark.
_MEMBER_COLUMNS = (
    "c_custkey AS user_no",
    "concat('Member ', CAST(c_custkey - CASE WHEN c_custkey % 7 = 4 THEN 4 ELSE 0 END AS STRING)) AS name",
    "CASE WHEN c_custkey % 29 <> 0 THEN CAST(1955 + c_custkey % 46 AS INT) END AS birth_year",
    "CASE c_custkey % 11 WHEN 0 THEN 'M' WHEN 1 THEN ' male ' WHEN 2 THEN '남\u3000' WHEN 3 THEN 'F' WHEN 4 THEN 'Woman' "
    "WHEN 5 THEN '\u00a0여성\u2009' WHEN 6 THEN 'w' WHEN 7 THEN 'Man' WHEN 8 THEN 'x' WHEN 9 THEN 'female' END AS gender",
    "CASE WHEN c_custkey % 17 <> 0 THEN n_name END AS area",
    "CASE WHEN c_custkey % 31 = 0 THEN NULL WHEN c_mktsegment = 'HOUSEHOLD' THEN 'exmember' WHEN c_mktsegment = 'MACHINERY' THEN 'staff' "
    "WHEN c_mktsegment = 'BUILDING' THEN 'admin' ELSE 'member' END AS role",
    "CASE WHEN c_custkey % 23 <> 0 THEN CAST(c_custkey % 120 AS INT) END AS point",
    "CASE WHEN c_custkey % 3 = 0 THEN NULL WHEN c_custkey % 10 = 1 THEN concat(char(92), 'N') ELSE concat(c_mktsegment, "
    "CASE WHEN c_custkey % 10 = 2 THEN concat(char(10), char(13), char(92), 'n', char(13), char(10), '\"', char(92), ',') ELSE ' ' END, "
    "n_name) END AS description",
    "CASE WHEN c_custkey % 4 = 0 THEN NULL WHEN c_custkey % 4 = 1 THEN '' ELSE concat('https://img.test/', CAST(c_custkey AS STRING)) END "
    "AS profile_image_url",
    f"date_sub(DATE '{AS_OF}', CAST(c_custkey % 2400 AS INT)) AS created_at",
)
_ACTIVITY_COLUMNS = (
    "o_orderkey AS event_id",
    "CAST(o_orderdate AS DATE) AS date",
    "CASE WHEN o_orderkey % 43 <> 0 THEN concat('Route ', CAST(o_orderkey % 40 AS STRING)) END AS title",
    "CASE WHEN o_orderkey % 37 <> 0 THEN o_custkey END AS host",
    "CASE WHEN o_orderkey % 41 <> 0 THEN CAST(1 + o_orderkey % 5 AS INT) END AS score",
    "CASE o_orderkey % 6 WHEN 0 THEN NULL WHEN 1 THEN '' WHEN 2 THEN concat('https://album.test/post/', CAST(o_orderkey AS STRING), '/') "
    "WHEN 3 THEN concat('album', CAST(o_orderkey AS STRING)) WHEN 4 THEN 'https://album.test/none' "
    "ELSE concat('\u2003https://album.test/post/', CAST(o_orderkey AS STRING), '\u00a0', char(9)) END AS album_url",
)
# Attendees with these keys are nobody's member key: members whose key is a
# multiple of 13 never came, and the records of strangers stay in the table.
STRANGER_OFFSET = 1_000_000_000
_ATTENDANCE_COLUMNS = (
    "l_orderkey AS event_id",
    f"CASE WHEN l_partkey % 13 = 0 THEN l_partkey + {STRANGER_OFFSET} ELSE l_partkey END AS user_no",
)


def members(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, n = read_table(spark, sf_dir, "customer"), read_table(spark, sf_dir, "nation")
    # nation's file is a few KB, which the planner sees and broadcasts by its
    # own size check
    return c.join(n, c["c_nationkey"] == n["n_nationkey"], "left").selectExpr(*_MEMBER_COLUMNS)


def activities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "orders").selectExpr(*_ACTIVITY_COLUMNS)


def attendance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "lineitem").selectExpr(*_ATTENDANCE_COLUMNS)


def load_club(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """The three entities by name (lazy plans), with the types of their schemas."""
    return {"members": members(spark, sf_dir), "activities": activities(spark, sf_dir), "attendance": attendance(spark, sf_dir)}


def load_tables(spark: SparkSession, sf_dir: str, register: bool = False) -> dict[str, DataFrame]:
    """Every base table plus the derived entities, optionally as temp views."""
    out = {name: read_table(spark, sf_dir, name) for name in BASE_TABLES}
    out.update(load_club(spark, sf_dir))
    if register:
        for name, df in out.items():
            df.createOrReplaceTempView(name)
    return out


def table_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """(table_name, n): the rows of each table, one pass each."""
    parts = [df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("table_name"), "n") for name, df in tables.items()]
    return reduce(DataFrame.unionByName, parts)


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Cast a frame (a table or user edits) to an entity schema by name.

    Missing columns become NULL; extra columns are kept after the schema's.
    """
    cols = []
    for f in schema.fields:
        if f.name in df.columns:
            cols.append(F.col(f.name).cast(f.dataType).alias(f.name))
        else:
            cols.append(F.lit(None).cast(f.dataType).alias(f.name))
    extra = [c for c in df.columns if c not in schema.fieldNames()]
    return df.select(*cols, *extra)


def save_table_once(df: DataFrame, path: str) -> bool:
    """Write `df` as Parquet to `path` unless it is there already; False if it was.

    The rows are written beside it and the folder is then renamed, so that a
    write that stops halfway leaves nothing at `path`.
    """
    spark = df.sparkSession
    hadoop = spark._jvm.org.apache.hadoop.fs
    target = hadoop.Path(path)
    files = target.getFileSystem(spark._jsc.hadoopConfiguration())
    if files.exists(target):
        return False
    draft = hadoop.Path(target.getParent(), f"_draft-{uuid.uuid4().hex}")
    df.write.parquet(draft.toString())
    context = hadoop.FileContext.getFileContext(target.toUri(), spark._jsc.hadoopConfiguration())
    try:
        context.rename(draft, target, spark._sc._gateway.new_array(hadoop.Options.Rename, 0))
    except Exception:
        files.delete(draft, True)
        if files.exists(target):  # another writer was faster
            return False
        raise
    return True


def save_by_date(df: DataFrame, path: str, date_col: str = "date", key: str = "event_id",
                 max_records_per_file: int = 5_000_000) -> None:
    """Store a dated entity partitioned by day, for repeated runs.

    Month and date-range predicates (the half-open ranges of `in_month`) then
    prune whole directories (`PartitionFilters`) before any file is opened.
    Rows are range partitioned on (date, key) rather than hashed on the date,
    so a day holding a large share of the rows is spread over many tasks and
    each task writes few days; `maxRecordsPerFile` bounds the file size.
    """
    (df.repartitionByRange(F.col(date_col), F.col(key))
     .write.mode("errorifexists")
     .option("maxRecordsPerFile", max_records_per_file)
     .partitionBy(date_col)
     .parquet(path))


def read_by_date(spark: SparkSession, path: str, schema: T.StructType = ACTIVITIES_SCHEMA) -> DataFrame:
    """Read a table written by `save_by_date`, in the entity's column order."""
    df = spark.read.parquet(path)
    return df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema.fields])


def save_attendance_by_month(at: DataFrame, a: DataFrame, path: str,
                             max_records_per_file: int = 5_000_000) -> None:
    """Store attendance once with its activity's month as a partition column.

    Month-scoped operators (`filters.month_attendance`) then read one month's
    files instead of shuffling all attendance to meet that month's activities.
    Records without an activity keep a NULL month. Rows are range partitioned
    on (month, event_id, user_no), so a busy month or a very large activity is
    spread over many writer tasks. The range keys are row values only (no row
    number), so a retried task after a lost executor reproduces exactly the
    same partitioning. Written once per refresh; grid saves apply to the plain
    table.
    """
    from ..operators.filters import ACTIVITY_MONTH

    months = a.select("event_id", F.date_format("date", "yyyy-MM").alias(ACTIVITY_MONTH))
    (at.join(months, "event_id", "left")
     .repartitionByRange(F.col(ACTIVITY_MONTH), F.col("event_id"), F.col("user_no"))
     .write.mode("errorifexists")
     .option("maxRecordsPerFile", max_records_per_file)
     .partitionBy(ACTIVITY_MONTH)
     .parquet(path))


def read_attendance_by_month(spark: SparkSession, path: str) -> DataFrame:
    """Read a table written by `save_attendance_by_month` (month kept as text)."""
    from ..operators.filters import ACTIVITY_MONTH

    schema = T.StructType(ATTENDANCE_SCHEMA.fields + [T.StructField(ACTIVITY_MONTH, T.StringType())])
    return spark.read.schema(schema).parquet(path)


def rewrite_attendance_month(spark: SparkSession, path: str, month: str,
                             change: Callable[[DataFrame], DataFrame]) -> None:
    """Save an edit of one month's attendance in a table written by `save_attendance_by_month`.

    `change` gets the month's records (event_id, user_no), for instance to
    apply `writes.cascade_delete` or `writes.replace_attendance`, and returns
    the new ones. Only this month's files are read and written; the result is
    computed completely before they are replaced.
    """
    from ..operators.filters import ACTIVITY_MONTH
    from ..session import scratch_table

    rows = read_attendance_by_month(spark, path).filter(F.col(ACTIVITY_MONTH) == F.lit(month))
    staged = scratch_table(conform(change(rows.drop(ACTIVITY_MONTH)), ATTENDANCE_SCHEMA), "attendance-month")
    staged.write.mode("overwrite").parquet(f"{path.rstrip('/')}/{ACTIVITY_MONTH}={month}")
