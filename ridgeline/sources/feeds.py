"""Parameterised SQL, CSV export, forecast JSON rows, JSON serialisation."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import expr as X


def sql_param(spark: SparkSession, text: str, args: Sequence | Mapping | None = None,
              views: Mapping[str, DataFrame] | None = None) -> DataFrame:
    """Run SQL text with bound parameters (`?` positional or `:name`).

    Values are bound by the parser, never spliced into the text.
    """
    for name, df in (views or {}).items():
        df.createOrReplaceTempView(name)
    return spark.sql(text, args=args)


def ordered_columns(columns: Sequence[str], preferred: Sequence[str], drop: Sequence[str] = ()) -> list[str]:
    """Preferred columns that exist, in that order, then the rest; helpers dropped."""
    cols = [c for c in columns if c not in drop]
    return [c for c in preferred if c in cols] + [c for c in cols if c not in preferred]


# NULL is written as \N. In texts the escape character and line breaks are
# written as \\, \n and \r, so that no text equals the mark, every record is
# one line (files stay splittable) and reading gives back the same text.
NULL_MARK = "\\N"
_CSV = {"header": True, "nullValue": NULL_MARK, "escape": '"', "ignoreLeadingWhiteSpace": False,
        "ignoreTrailingWhiteSpace": False}


def _escaped(c: Column) -> Column:
    for raw, mark in (("\\", "\\\\"), ("\n", "\\n"), ("\r", "\\r")):
        c = F.replace(c, F.lit(raw), F.lit(mark))
    return c


def _unescaped(c: Column) -> Column:
    def breaks(part: Column) -> Column:
        return F.replace(F.replace(part, F.lit("\\n"), F.lit("\n")), F.lit("\\r"), F.lit("\r"))

    return F.array_join(F.transform(F.split(c, r"\\\\"), breaks), "\\")


def export_csv(t: DataFrame, path: str, preferred: Sequence[str] = (), drop: Sequence[str] = ()) -> None:
    """S3: whole-table CSV backup with a header, written by every task in parallel."""
    cols = ordered_columns(t.columns, preferred, drop)
    texts = {f.name for f in t.schema.fields if isinstance(f.dataType, T.StringType)}
    (t.select(*[_escaped(F.col(c)).alias(c) if c in texts else F.col(c) for c in cols])
     .write.mode("errorifexists").options(**_CSV).csv(path))


def read_csv(spark: SparkSession, path: str, schema: T.StructType, preferred: Sequence[str] = (),
             drop: Sequence[str] = (), with_file: str | None = None) -> DataFrame:
    """Read an export back with its declared schema (no inference pass).

    `preferred` / `drop` must be those of the export: CSV columns are bound
    by position, so the schema is laid out in the file's column order; the
    result comes back in the schema's own order. `with_file` names a further
    column with the name of the row's file.
    """
    order = ordered_columns(schema.fieldNames(), preferred, drop)
    df = spark.read.schema(T.StructType([schema[c] for c in order])).options(**_CSV).csv(path)
    return df.select(*[_unescaped(F.col(c)).alias(c) if isinstance(schema[c].dataType, T.StringType) else F.col(c)
                       for c in schema.fieldNames() if c in order],
                     *([F.col("_metadata.file_name").alias(with_file)] if with_file else []))


FORECAST_SCHEMA = T.StructType([T.StructField("daily", T.StructType([
    T.StructField("time", T.ArrayType(T.StringType())),
    T.StructField("weather_code", T.ArrayType(T.IntegerType())),
    T.StructField("temperature_2m_max", T.ArrayType(T.DoubleType())),
    T.StructField("temperature_2m_min", T.ArrayType(T.DoubleType())),
]))])


def forecast_payloads(events: DataFrame) -> DataFrame:
    """Column-oriented forecast documents built from the driver's `events` table.

    One document per (event_type, calendar month): a day's weather code is the
    largest `props.k` of the day, its max/min temperatures the max/min
    `value`. A document holds at most 31 days, so the per-group list is
    bounded by the calendar.
    """
    d = events.select(
        F.col("event_type").alias("location"),
        F.to_date("ts").alias("day"),
        F.get_json_object("props", "$.k").try_cast("int").alias("k"),  # a malformed code is NULL
        "value")
    per_day = d.groupBy("location", "day").agg(
        F.max("k").alias("code"), F.max("value").alias("tmax"), F.min("value").alias("tmin"))
    per_month = per_day.groupBy("location", X.month_text("day").alias("month")).agg(
        F.array_sort(F.collect_list(F.struct("day", "code", "tmax", "tmin"))).alias("_d"))
    daily = F.struct(
        F.transform("_d", lambda x: F.date_format(x["day"], "yyyy-MM-dd")).alias("time"),
        F.transform("_d", lambda x: x["code"]).alias("weather_code"),
        F.transform("_d", lambda x: x["tmax"]).alias("temperature_2m_max"),
        F.transform("_d", lambda x: x["tmin"]).alias("temperature_2m_min"),
    )
    return per_month.select("location", "month", F.to_json(F.struct(daily.alias("daily"))).alias("payload"))


def forecast_rows(payloads: DataFrame, days: int = 7, keys: Sequence[str] = ("location", "month")) -> DataFrame:
    """Parse each payload and emit its first `days` days.

    Columns: pos, day ('MM/dd'), dow (Monday-first name), sky (icon class),
    t_max / t_min truncated to int.
    """
    p = payloads.select(*keys, F.from_json("payload", FORECAST_SCHEMA).alias("_p"))
    d = F.col("_p.daily")
    ex = p.select(*keys, d.alias("_d"),
                  F.posexplode(F.slice(d["time"], 1, days)).alias("pos", "_time"))
    day = F.to_date("_time")
    i = F.col("pos") + 1
    return ex.select(
        *keys, "pos",
        F.date_format(day, "MM/dd").alias("day"),
        X.weekday_name(day).alias("dow"),
        X.sky_class(F.try_element_at(F.col("_d.weather_code"), i)).alias("sky"),
        F.try_element_at(F.col("_d.temperature_2m_max"), i).cast("int").alias("t_max"),
        F.try_element_at(F.col("_d.temperature_2m_min"), i).cast("int").alias("t_min"),
    )


def json_rows(t: DataFrame) -> DataFrame:
    """One JSON document per row (NULL fields kept as null)."""
    return t.select(F.to_json(F.struct(*t.columns), {"ignoreNullFields": "false"}).alias("json"))
