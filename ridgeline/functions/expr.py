"""Scalar column helpers. All are built-in Spark expressions (codegen, no UDF)."""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import lookups as L


def as_date(value) -> Column:
    """A literal DATE column from a date, 'YYYY-MM-DD' text or a Column."""
    if isinstance(value, Column):
        return value.cast("date")
    if isinstance(value, _dt.date):
        value = value.isoformat()
    return F.lit(str(value)).cast("date")


def month_bounds(month: str) -> tuple[_dt.date, _dt.date]:
    """'YYYY-MM' -> [first day, first day of the next month)."""
    year, mon = (int(p) for p in month.split("-"))
    first = _dt.date(year, mon, 1)
    nxt = _dt.date(year + (mon == 12), mon % 12 + 1, 1)
    return first, nxt


def in_month(date_col: Column | str, month: str) -> Column:
    """Half-open range test for a 'YYYY-MM' month.

    Written as a range rather than a formatted-text comparison so the
    predicate reaches the Parquet scan as a pushed filter.
    """
    first, nxt = month_bounds(month)
    c = F.col(date_col) if isinstance(date_col, str) else date_col
    return (c >= F.lit(first)) & (c < F.lit(nxt))


def month_of(as_of) -> str:
    d = as_of if isinstance(as_of, _dt.date) else _dt.date.fromisoformat(str(as_of))
    return f"{d.year:04d}-{d.month:02d}"


def month_text(date_col: Column | str) -> Column:
    c = F.col(date_col) if isinstance(date_col, str) else date_col
    return F.date_format(c, "yyyy-MM")


def full_trim(c: Column) -> Column:
    """Strip leading and trailing white space of every kind, Unicode's included.

    Most texts have none: the regex runs only where the first or last character is white space.
    """
    ends = F.concat(F.left(c, F.lit(1)), F.right(c, F.lit(1)))
    return F.when(ends.rlike(f"[{L.WHITE_SPACE}]"), F.regexp_replace(c, f"^[{L.WHITE_SPACE}]+|[{L.WHITE_SPACE}]+$", "")).otherwise(c)


def blank_to_null(c: Column) -> Column:
    """'' behaves like NULL (Python truthiness of a string)."""
    return F.when(c != F.lit(""), c)


def norm_gender(c: Column) -> Column:
    """Free-text gender -> 'M' / 'F' / 'U'. NULL becomes 'U'."""
    key = full_trim(F.upper(c))
    out = F.lit(L.GENDER_UNKNOWN)
    expr = None
    for spelling, cls in L.GENDER_MAP.items():
        cond = key == F.lit(spelling)
        expr = F.when(cond, F.lit(cls)) if expr is None else expr.when(cond, F.lit(cls))
    return expr.otherwise(out)


def yy(year: Column, missing: str = L.YEAR_UNKNOWN) -> Column:
    """Last two characters of the year as text; `missing` when NULL."""
    txt = year.cast("bigint").cast("string")
    return F.coalesce(F.substring(txt, -2, 2), F.lit(missing))


def member_label(birth_year: Column, name: Column, area: Column, fallback_name: Column | None = None) -> Column:
    """'yy/name/area' with '??' for no year and '미상' for no area."""
    nm = blank_to_null(name)
    if fallback_name is not None:
        nm = F.coalesce(nm, fallback_name.cast("string"))
    return F.concat_ws(
        "/",
        yy(birth_year),
        F.coalesce(nm, F.lit("")),
        F.coalesce(blank_to_null(area), F.lit(L.AREA_UNKNOWN)),
    )


def option_label(*cols: Column) -> Column:
    """Pick-list label 'a/b/c' built from the raw values; NULL shows as 'None'."""
    return F.concat_ws("/", *[F.coalesce(c.cast("string"), F.lit("None")) for c in cols])


def event_label(date: Column, title: Column) -> Column:
    """Activity pick-list label 'yyyy-MM-dd | title'; NULL shows as 'None'."""
    return F.concat(F.coalesce(F.date_format(date, "yyyy-MM-dd"), F.lit("None")), F.lit(L.EVENT_LABEL_SEP),
                    F.coalesce(title, F.lit("None")))


def avatar_url(image: Column, name: Column, default: str = L.AVATAR_DEFAULT_NAME) -> Column:
    """Image URL, or the generated-avatar URL when it is NULL or ''; `default` stands for a missing name."""
    fallback = F.concat(
        F.lit(L.AVATAR_URL_PREFIX),
        F.coalesce(blank_to_null(name), F.lit(default)),
        F.lit(L.AVATAR_URL_SUFFIX),
    )
    return F.coalesce(blank_to_null(image), fallback)


def sky_class(code: Column) -> Column:
    """Weather code -> icon, in the fixed test order."""
    return (
        F.when(code == 0, F.lit(L.SKY_CLEAR))
        .when(code.isin(*L.SKY_CLOUDY_CODES), F.lit(L.SKY_CLOUDY))
        .when(code.isin(*L.SKY_FOG_CODES), F.lit(L.SKY_FOG))
        .when(code.isin(*L.SKY_RAIN_CODES), F.lit(L.SKY_RAIN))
        .when(code.isin(*L.SKY_SNOW_CODES), F.lit(L.SKY_SNOW))
        .when(code >= L.SKY_STORM_MIN_CODE, F.lit(L.SKY_STORM))
        .otherwise(F.lit(L.SKY_OTHER))
    )


def weekday_name(d: Column) -> Column:
    """Monday=0 weekday -> fixed short name."""
    names = F.array(*[F.lit(n) for n in L.WEEKDAY_NAMES])
    return F.element_at(names, F.weekday(d) + 1)


def ratio(num: Column, den: Column) -> Column:
    """num/den as DOUBLE rounded to 6 places; 0 when den is 0."""
    return F.round(F.when(den > 0, num.cast("double") / den.cast("double")).otherwise(F.lit(0.0)), 6)


def regex_search(c: Column, pattern: str) -> Column:
    """Case-insensitive regex search; NULL counts as no match.

    `u` makes the case folding Unicode-aware (as Python's IGNORECASE and
    RE2's `(?i)`), not ASCII-only.
    """
    return F.coalesce(c.rlike("(?iu)" + pattern), F.lit(False))
