"""P4 on large tables: a trigram posting table finds candidates, the regex decides.

The posting table has a row for each trigram of each searched text. A pattern's
literal parts (characters that every match must contain in a row) are cut into
trigrams; only rows that have all of a part's trigrams can match, so they alone are
read and tested by the regex. A pattern, or one of its alternatives, without a
literal part of three characters is answered by a scan.

Texts and literals are folded as the case-insensitive regex folds them. Only ASCII
literals are used, so folding has to be right for letters that fold to ASCII alone.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .filters import search_predicate

# The non-ASCII characters that a Unicode case-insensitive match treats as an ASCII letter.
FOLD_FROM, FOLD_TO = "ſKıİ", "skii"
# Escapes of one letter, which stand for a class of characters, a control character or a position.
SINGLE_ESCAPES = tuple("dDwWsShHvVRtnrfaebBAzZG")
RAREST = 4  # trigrams of an alternative that are looked up, the rarest of them


def folded(c: Column) -> Column:
    return F.lower(F.translate(c, FOLD_FROM, FOLD_TO))


def postings(t: DataFrame, key: str, cols: Iterable[str]) -> DataFrame:
    """(trigram, col, key), each once."""
    def of(col: str) -> DataFrame:
        text = folded(F.col(col))
        grams = F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(text) - 2), lambda i: F.substring(text, i, F.lit(3))))
        return t.filter(F.length(text) >= 3).select(F.explode(grams).alias("trigram"), F.lit(col).alias("col"), F.col(key).alias("key"))

    return reduce(DataFrame.unionByName, [of(c) for c in cols])


def save_postings(t: DataFrame, key: str, cols: Iterable[str], path: str) -> None:
    """Store the postings in order of trigram, so that a lookup opens the row groups of its trigrams only.

    Ranges go by trigram and key: a trigram that nearly all texts have is spread over many tasks.
    """
    postings(t, key, cols).repartitionByRange("trigram", "key").sortWithinPartitions("trigram", "col", "key").write.mode("errorifexists").parquet(path)


def literal_parts(pattern: str) -> list[list[str]] | None:
    """For each alternative of the pattern the ASCII texts that a match must contain, folded; None if that cannot be told.

    Only what is certain counts: a character that may be missing (before ?, * or
    {), and all within groups, classes and escapes, ends a part. Patterns with
    inline flags, look-arounds, nested classes or escapes of several characters
    are not taken apart.
    """
    if "(?" in pattern:
        return None
    alternatives, parts, run, i = [], [], "", 0

    def end() -> None:
        nonlocal run
        if len(run) >= 3:
            parts.append(run.lower())
        run = ""

    def closing(at: int, opening: str, close: str) -> int:
        depth = 0
        while at < len(pattern):
            if pattern[at] == "\\":
                at += 1
            elif opening == "(" and pattern[at] == "[":
                at = closing(at, "[", "]")
            elif pattern[at] == opening and (opening == "(" or depth == 0):
                depth += 1
            elif pattern[at] == close:
                depth -= 1
                if depth == 0:
                    return at
            at += 1
        return at

    while i < len(pattern):
        c = pattern[i]
        if c == "|":
            end()
            alternatives.append(parts)
            parts = []
        elif c in "?*{":
            run = run[:-1]
            end()
            if c == "{":
                i = closing(i, "{", "}")
        elif c in "([":
            end()
            to = closing(i, c, ")" if c == "(" else "]")
            if c == "[" and ("[" in pattern[i + 1:to] or pattern[i + 1:to] in ("", "^")):
                return None
            i = to
        elif c == "\\" and i + 1 < len(pattern) and pattern[i + 1].isascii() and not pattern[i + 1].isalnum():
            i += 1
            run += pattern[i]  # an escaped sign is that sign
        elif c == "+":
            end()
        elif c == "\\" and pattern[i + 1:i + 2] not in SINGLE_ESCAPES:
            return None
        elif c in "\\.^$)" or not c.isascii():
            end()
            i += c == "\\"
        else:
            run += c
        i += 1
    end()
    return alternatives + [parts]


def search_indexed(t: DataFrame, index: DataFrame, key: str, cols: Sequence[str], pattern: str) -> DataFrame:
    """The rows of t that `filters.text_search` finds, by way of the postings `index` of the same rows and columns."""
    found = literal_parts(pattern)
    matches = t.filter(search_predicate(cols, pattern)) if pattern else t
    if not pattern or found is None or not all(found):
        return matches
    alternatives = [sorted({part[i:i + 3] for part in parts for i in range(len(part) - 2)}) for parts in found]
    wanted = sorted({g for grams in alternatives for g in grams})
    counts = {r.trigram: r.n for r in index.filter(F.col("trigram").isin(wanted)).groupBy("trigram").agg(F.count(F.lit(1)).alias("n")).collect()}  # the pattern's trigrams
    if all(any(g not in counts for g in grams) for grams in alternatives):
        return matches.limit(0)
    chosen = [sorted(grams, key=lambda g: counts.get(g, 0))[:RAREST] for grams in alternatives if all(g in counts for g in grams)]
    hits = index.filter(F.col("col").isin(list(cols)) & F.col("trigram").isin(sorted({g for grams in chosen for g in grams})))
    all_of = [reduce(Column.__and__, [F.max(F.col("trigram") == g) for g in grams]) for grams in chosen]
    keys = hits.groupBy("key", "col").agg(reduce(Column.__or__, all_of).alias("may")).filter("may").select("key").distinct()
    return matches.join(keys, matches[key] == keys["key"], "left_semi")
