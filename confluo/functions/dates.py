"""Months: any date text as YYYY-MM."""

from __future__ import annotations

import datetime
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from confluo.functions.text import WS, let, strip

_EXPLICIT = (r"^(\d{4})$", r"^(\d{4})[-/](\d{1,2})$", r"^(\d{1,2})[-/](\d{4})$")


@lru_cache(maxsize=100_000)
def _loose(text: str) -> str | None:
    """What dateutil reads, with January 2000 for the parts that are not there."""
    from dateutil import parser

    try:
        d = parser.parse(text, default=datetime.datetime(2000, 1, 1))
    except (ValueError, OverflowError, TypeError):
        return None
    return f"{d.year:04d}-{d.month:02d}"


def _loose_udf(c: Column) -> Column:
    @arrow_udf("string")
    def run(col: pa.Array) -> pa.Array:
        return pa.array([x and _loose(x) for x in col.to_pylist()], pa.string())

    return run(c)


def month_of(year: Column, month: Column) -> Column:
    m = month.cast("int")
    return F.when(m.between(1, 12), F.concat(F.lpad(year, 4, "0"), F.lit("-"), F.lpad(m.cast("string"), 2, "0")))


def explicit_month(c: Column) -> Column:
    """The forms YYYY, YYYY-M, YYYY/M, M-YYYY, M/YYYY; null for a month beyond 12 and for any other form."""
    year, year_month, month_year = _EXPLICIT

    def read(t: Column) -> Column:
        return (
            F.when(t.rlike(year), F.concat(t, F.lit("-01")))
            .when(t.rlike(year_month), month_of(F.regexp_extract(t, year_month, 1), F.regexp_extract(t, year_month, 2)))
            .when(t.rlike(month_year), month_of(F.regexp_extract(t, month_year, 2), F.regexp_extract(t, month_year, 1)))
        )

    return let(strip(c), read)


def is_explicit(c: Column) -> Column:
    return strip(c).rlike("|".join(_EXPLICIT))


def normalize_date(c: Column) -> Column:
    """YYYY-MM or null. Only texts in none of the explicit forms reach Python."""
    t = strip(c)
    return F.when(is_explicit(t), explicit_month(t)).otherwise(_loose_udf(F.when(~is_explicit(t) & (t != ""), t)))


def normalize_dates(values: Column) -> Column:
    """normalize_date over an array of strings."""

    @arrow_udf("array<string>")
    def run(col: pa.Array) -> pa.Array:
        return pa.array([None if row is None else [x and _loose(x) for x in row] for row in col.to_pylist()], pa.list_(pa.string()))

    rest = run(F.transform(values, lambda x: F.when(~is_explicit(x) & (strip(x) != ""), strip(x))))
    return F.zip_with(values, rest, lambda x, y: F.when(is_explicit(x), explicit_month(x)).otherwise(y))


_RANGE = rf"(?iU){WS}+(?:-|–|—|to){WS}+"
_OPEN = r"(?iU)\b(present|current|now|ongoing|to date)\b"


def range_sides(c: Column) -> tuple[Column, Column]:
    """Texts of the start and the end of a range; the end is null where there is none or it is open."""
    t = strip(c)
    parts = F.split(t, _RANGE, 2)
    right = F.get(parts, F.lit(1))
    return strip(F.get(parts, F.lit(0))), F.when(~right.rlike(_OPEN), strip(right))


def year_of(c: Column) -> Column:
    """Year of a date text, where it lies in 1900 to 2100."""
    year = F.substring(normalize_date(c), 1, 4).cast("int")
    return F.when(year.between(1900, 2100), year)
