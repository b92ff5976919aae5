"""Secret scans with multipart credential linking, in DataFrame operations.

Base patterns report a secret by themselves. Weak candidates (account
identifiers, short or unnamed secret values, endpoints) are common in clean
text, so one is reported only when complementary parts co-occur in its scope:
an interval join brings together parts of one document that stand at most
`SCOPE` code points apart, and a weak part needs a partner of another role, one
of the two being a secret. The join is on (row, interval bin), each weak part
looking into its own bin and the two next to it, and it is a semi join, so no
pairs are made however many parts a bin holds.

Spans are found with built-in functions: the matches of a pattern, and the
pieces of the text between them. A pattern's extraction runs only on texts in
which it occurs. One pass over the texts writes the lengths of matches and pieces
(in code points) of each row to the shared folder; positions are running sums of
those lengths, over one text's matches of one kind, so their cost grows with the
number of matches and not with its square.

Input cases: a null or empty text has no parts. Rows that repeat get equal
results, each its own. Long texts are scanned whole. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import scratch_table
from . import common as C

SCOPE = 300

# Fixed patterns. ASCII letters in either case where (?i) stands; a name begins where no ASCII letter, digit or _ precedes it.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{32,}"  # the runs of [0-9a-f]+ that have 32 characters
IDENT = r"""(?i)(?<![A-Za-z0-9_])(?:user(?:name)?|login|account|client_?id|access_?key_?id)["']?\x20*[:=]\x20*["']?[A-Za-z0-9@._+-]+"""
VALUE = r"""(?i)(?<![A-Za-z0-9_])(?:pwd|pass|key|auth|credentials?|private_?key|secret_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]{4,}"""
ENDPOINT = r"(?i)(?<![A-Za-z0-9_])(?:https?|ftp|jdbc:[a-z]+|postgres(?:ql)?|mysql|mongodb|redis|amqp)://[A-Za-z0-9._~:/?#@!$&()*+,;=%-]+"

#: (kind, role, pattern, least length, group measured; 0 is the match), in the order of the kinds.
KINDS = (("assign", "secret", ASSIGN, 8, 2), ("access", "identifier", ACCESS, 16, 0), ("hex", "secret", HEX, 32, 0),
         ("ident", "identifier", IDENT, 0, 0), ("value", "secret", VALUE, 0, 0), ("endpoint", "endpoint", ENDPOINT, 0, 0))
BASE = 3  # the first three kinds are reported by themselves
PART = "struct<start:int,ord:int,end:int,kind:string>"


def _steps(text: Column, ordinal: int) -> Column:
    """The matches of one kind, left to right without overlaps: the code points before each (since the last), in it, and in its measured group."""
    _, _, pattern, _, group = KINDS[ordinal]
    matches = F.regexp_extract_all(text, F.lit(pattern), 0)
    measured = F.transform(F.regexp_extract_all(text, F.lit(pattern), group), F.length)
    steps = F.transform(F.arrays_zip(F.split(text, pattern, -1).alias("before"), matches.alias("match"), measured.alias("measured")),
                        lambda x: F.struct(F.length(x["before"]).alias("gap"), F.length(x["match"]).alias("len"), x["measured"].alias("measured")))
    steps = F.slice(steps, F.lit(1), F.size(matches))  # the piece after the last match is left out
    none = F.array().cast("array<struct<gap:int,len:int,measured:int>>")
    return F.struct(F.lit(ordinal).alias("ord"), F.when(text.rlike(pattern), steps).otherwise(none).alias("steps"))


def find_parts(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(doc_id, row) of all rows and (row, kind, ord, role, weak, start, end) of all parts, as tables in the shared folder.

    A match of `assign` whose value is too short is not dropped but weak: a
    named secret that needs a partner.
    """
    text = F.coalesce("text", F.lit(""))
    kinds = F.filter(F.array(*[_steps(text, i) for i in range(len(KINDS))]), lambda k: F.size(k["steps"]) > 0)
    found = scratch_table(docs.select("doc_id", kinds.alias("kinds")).withColumn("row", F.monotonically_increasing_id()), "secret-matches")
    of = lambda i: F.element_at(F.array(*[F.lit(k[i]) for k in KINDS]), F.col("ord") + 1)
    each = (found.select("row", F.explode("kinds").alias("k")).select("row", "k.ord", F.posexplode("k.steps").alias("i", "step"))
            .select("row", "ord", "i", "step.*").repartition("row"))
    end = F.sum(F.col("gap") + F.col("len")).over(Window.partitionBy("row", "ord").orderBy("i")).cast("int")  # within one text
    parts = each.select("row", of(0).alias("kind"), "ord", of(1).alias("role"), ((F.col("ord") >= BASE) | (F.col("measured") < of(3))).alias("weak"),
                        (end - F.col("len")).alias("start"), end.alias("end")).filter("NOT (weak AND kind = 'access')")
    return found.select("doc_id", "row"), scratch_table(parts, "secret-parts")


def linked_weak(parts: DataFrame, scope: int = SCOPE) -> DataFrame:
    """The weak parts that have a complementary part at most `scope` code points away."""
    bins = lambda low, high: F.explode(F.sequence(low, high))
    first, last = F.floor(F.col("start") / scope), F.floor(F.col("end") / scope)
    # longer parts stand in every bin that they reach into
    near = parts.select(F.col("row").alias("other_row"), F.col("role").alias("other_role"), F.col("start").alias("other_start"),
                        F.col("end").alias("other_end"), bins(first, last).alias("other_bin"))
    weak = parts.filter("weak").withColumn("bin", bins(first - 1, last + 1))
    gap = F.greatest(F.col("start") - F.col("other_end"), F.col("other_start") - F.col("end"))
    complement = (F.col("role") != F.col("other_role")) & ((F.col("role") == "secret") | (F.col("other_role") == "secret"))
    same = (F.col("row") == F.col("other_row")) & (F.col("bin") == F.col("other_bin"))
    return weak.join(near, same & complement & (gap <= scope), "left_semi").select(parts.columns).distinct()


def scan(docs: DataFrame, scope: int = SCOPE) -> DataFrame:
    """doc_id, base (parts reported by themselves) and spans (those and the linked weak ones), by start and kind."""
    rows, parts = find_parts(docs)
    told = parts.filter("NOT weak").unionByName(linked_weak(parts, scope))
    place = F.struct("start", "ord", "end", "kind")
    per_row = told.groupBy("row").agg(F.array_sort(F.collect_list(F.when(~F.col("weak"), place))).alias("base"),
                                      F.array_sort(F.collect_list(place)).alias("spans"))  # parts of one text
    none = F.array().cast(f"array<{PART}>")
    return rows.join(per_row, "row", "left").select("doc_id", F.coalesce("base", none).alias("base"), F.coalesce("spans", none).alias("spans"))


def joined(parts: Column) -> Column:
    return F.concat_ws(",", F.transform(parts, lambda p: F.concat_ws(":", p["kind"], p["start"].cast("string"), p["end"].cast("string"))))


def op4_linked_credentials(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(C.table(spark, sf_dir, "documents"))
    count = lambda kind: F.size(F.filter("base", lambda p: p["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(joined(F.col("base")), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))
