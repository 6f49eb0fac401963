"""Text keys. White space is Unicode's, with the four separators U+001C to U+001F."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

def let(value: Column, body) -> Column:
    """body(value) with the value computed once, however often the body uses it."""
    return F.get(F.transform(F.array(value), lambda v: body(v)), F.lit(0))


WS = r"[\s\x1C-\x1F]"


def strip(c: Column) -> Column:
    return F.regexp_replace(c, rf"(?U)^{WS}+|{WS}+$", "")


def blank_to_null(c: Column) -> Column:
    return F.when(c != "", c)


def collapse(c: Column) -> Column:
    return F.regexp_replace(c, rf"(?U){WS}+", " ")


def clean_text(c: Column) -> Column:
    """Trimmed, inner white space as one space, null where blank; case is kept."""
    return blank_to_null(collapse(strip(c)))


def email_key(c: Column) -> Column:
    return blank_to_null(F.lower(strip(c)))


def name_key(c: Column) -> Column:
    return blank_to_null(collapse(F.lower(strip(c))))


def profile_key(c: Column) -> Column:
    """Host and path of a profile link: no scheme, no leading www., no trailing slashes."""
    bare = F.regexp_replace(F.lower(strip(c)), r"^[a-z][a-z0-9+.\-]*://", "")
    return blank_to_null(F.rtrim(F.regexp_replace(bare, r"^www\.", ""), F.lit("/")))


def name_blocks(key: Column) -> Column:
    """Blocking keys of a name key: last token, sorted initials, first four letters."""
    tokens = F.split(key, " ")
    initials = F.array_join(F.array_sort(F.transform(tokens, lambda t: F.substring(t, 1, 1))), "")
    made = F.array(F.concat(F.lit("last:"), F.element_at(tokens, -1)), F.concat(F.lit("init:"), initials), F.concat(F.lit("pre:"), F.substring(F.replace(key, F.lit(" "), F.lit("")), 1, 4)))
    return F.when(key.isNotNull(), F.array_distinct(made)).otherwise(F.array().cast("array<string>"))


def initial_score(a: Column, b: Column) -> Column:
    """Agreement of given names under one surname: 1 equal or initial, 0.85 three letters shared, else 0. a, b: name keys."""
    ta, tb = F.split(a, " "), F.split(b, " ")
    fa, fb = F.rtrim(F.element_at(ta, 1), F.lit(".")), F.rtrim(F.element_at(tb, 1), F.lit("."))
    initial = ((F.length(fa) == 1) & F.startswith(fb, fa)) | ((F.length(fb) == 1) & F.startswith(fa, fb))
    prefix = (F.length(fa) >= 2) & (F.length(fb) >= 2) & (F.substring(fa, 1, 3) == F.substring(fb, 1, 3))
    score = F.when((fa == fb) | initial, 1.0).when(prefix, 0.85).otherwise(0.0)
    return F.coalesce(F.when(F.element_at(ta, -1) == F.element_at(tb, -1), score), F.lit(0.0))
