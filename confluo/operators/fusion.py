"""One canonical record from the records of a component."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from confluo.functions.company import company_key, normalize_company
from confluo.functions.dates import normalize_date, range_sides, year_of
from confluo.functions.lookup import clamp01, field_confidence, is_allowed_skill, method_reliability, normalize_country, normalize_skill
from confluo.functions.phone import normalize_phone
from confluo.functions.text import blank_to_null, clean_text, email_key, name_key, profile_key
from confluo.schema import CANONICAL_FIELDS, EDUCATION, EXPERIENCE, PROVENANCE, SKILL, tracked

SCALARS = {
    "full_name": "full_name", "headline": "headline", "years_experience": "years_experience", "location.city": "location.city", "location.region": "location.region",
    "location.country": "location.country", "links.linkedin": "links.linkedin", "links.github": "links.github", "links.portfolio": "links.portfolio",
}
LISTS = {"emails": "emails", "phones": "phones", "skills": "skills", "links.other": "links.other"}
ITEMS = {"experience": ("company", "title", "date_range", "summary"), "education": ("institution", "degree", "field", "year")}


def contributions(members: DataFrame) -> DataFrame:
    """``component, record_idx, ord, field, value, source, confidence, method``: every carrier of every record as a row, raw, as text."""

    def entry(field: str, ord_: Column, c: Column) -> Column:
        return F.struct(F.lit(field).alias("field"), ord_.alias("ord"), c["value"].cast("string").alias("value"), c["source"].alias("source"), c["confidence"].alias("confidence"), c["extraction_method"].alias("method"), c.isNull().alias("absent"))

    singles = F.array(*[entry(f, F.lit(0), F.col(p)) for f, p in SCALARS.items()])
    of_list = lambda f: lambda x, i: entry(f, i, x)
    of_item = lambda g, names: lambda x, i: F.array(*[entry(f"{g}.{n}", i, x[n]) for n in names])
    lists = [F.transform(p, of_list(f)) for f, p in LISTS.items()]
    items = [F.flatten(F.transform(g, of_item(g, names))) for g, names in ITEMS.items()]
    rows = members.select("component", "record_idx", F.inline(F.concat(singles, *lists, *items)))
    return rows.where("not absent").drop("absent")


def normalized(contrib: DataFrame) -> DataFrame:
    """Contributions to plain fields with canonical values; what has none is dropped."""
    v, f = F.col("value"), F.col("field")
    value = (
        F.when(f.isin("full_name", "headline", "location.city", "location.region"), clean_text(v))
        .when(f == "emails", email_key(v))
        .when(f == "phones", normalize_phone(v))
        .when(f == "location.country", normalize_country(v))
        .when(f.startswith("links."), profile_key(v))
        .when((f == "skills") & is_allowed_skill(v), normalize_skill(v))
        .when(f == "years_experience", v)
    )
    return contrib.where(f.isin(*SCALARS, *LISTS)).withColumn("value", blank_to_null(value)).where("value is not null")


def resolve_fields(values: DataFrame) -> DataFrame:
    """``component, field, best, all``: of each field the winning value, and all distinct values in order, as tracked values.

    Values rank by highest confidence, number of sources, reliability of the best method, and text. The carrier of a value is its most confident,
    most reliable contribution; the agreement in its confidence counts the sources of all values of the field.
    """
    rel = method_reliability(F.col("method"))
    values = values.withColumn("rel", rel)
    skill = F.col("field") == "skills"
    carrier = F.struct(F.when(skill, 0.0).otherwise(-F.col("confidence")).alias("c"), (-F.col("rel")).alias("r"), F.when(skill, "").otherwise(F.col("source")).alias("s"), "record_idx", "ord", "method", F.col("source").alias("source"))
    by_value = values.groupBy("component", "field", "value").agg(F.max("confidence").alias("conf"), F.max("rel").alias("best"), F.collect_set("source").alias("sources"), F.min(carrier).alias("primary"))
    row = F.struct((-F.col("conf")).alias("k1"), (-F.size("sources")).alias("k2"), (-F.col("best")).alias("k3"), F.col("value"), F.array_sort("sources").alias("sources"), F.col("primary.method").alias("method"), F.col("primary.source").alias("source"))
    by_field = by_value.groupBy("component", "field").agg(F.min(row).alias("w"), F.collect_list(row).alias("rows"), F.array_distinct(F.flatten(F.collect_list("sources"))).alias("supplying"))

    def made(x: Column) -> Column:
        return F.struct(x["value"].alias("value"), x["source"].alias("source"), field_confidence(x["sources"], F.col("supplying"), x["method"]).alias("confidence"), x["method"].alias("extraction_method"), x["sources"].alias("sources"))

    ordered = F.array_sort(F.transform("rows", made))
    return by_field.select("component", "field", made(F.col("w")).alias("best"), ordered.alias("all"))


def _tracked(c: Column, kind: str = "string") -> Column:
    return F.when(c.isNotNull(), F.struct(c["value"].alias("value"), c["source"].alias("source"), c["confidence"].alias("confidence"), c["extraction_method"].alias("extraction_method"))).cast(tracked(kind))


def _list(c: Column) -> Column:
    return F.coalesce(F.transform(c, lambda x: _tracked(x)), F.array().cast(f"array<{tracked()}>"))


def canonical_fields(resolved: DataFrame) -> DataFrame:
    """One row for each component with its plain fields."""
    one = lambda f: F.max(F.when(F.col("field") == f, F.col("best")))
    many = lambda f: F.max(F.when(F.col("field") == f, F.col("all")))
    wide = resolved.groupBy("component").agg(*[one(f).alias(f.replace(".", "_")) for f in SCALARS], *[many(f).alias(f.replace(".", "_")) for f in LISTS])
    skill = lambda x: F.struct(x["value"].alias("name"), x["confidence"].alias("confidence"), x["sources"].alias("sources"))
    return wide.select(
        "component",
        _tracked(F.col("full_name")).alias("full_name"),
        _list(F.col("emails")).alias("emails"),
        _list(F.col("phones")).alias("phones"),
        F.struct(*[_tracked(F.col(f"location_{x}")).alias(x) for x in ("city", "region", "country")]).alias("location"),
        F.struct(*[_tracked(F.col(f"links_{x}")).alias(x) for x in ("linkedin", "github", "portfolio")], _list(F.col("links_other")).alias("other")).alias("links"),
        _tracked(F.col("headline")).alias("headline"),
        _tracked(F.col("years_experience"), "double").alias("years_experience"),
        F.coalesce(F.transform("skills", skill), F.array()).cast(f"array<{SKILL}>").alias("skills"),
    )


def experience_timeline(members: DataFrame) -> DataFrame:
    """``component, experience``: jobs of one company as one item; it ends only if all of them do."""
    rows = members.select("component", "record_idx", F.posexplode("experience").alias("item", "e"))
    start, end = range_sides(F.col("e.date_range.value"))
    rows = rows.select(
        "component", "record_idx", "item",
        clean_text(F.col("e.company.value")).alias("raw_company"),
        clean_text(F.col("e.title.value")).alias("title"),
        clean_text(F.col("e.summary.value")).alias("summary"),
        F.coalesce("e.title.confidence", F.lit(0.0)).alias("title_conf"),
        method_reliability(F.coalesce("e.title.extraction_method", F.lit("free-text"))).alias("title_rel"),
        normalize_date(start).alias("start"), normalize_date(end).alias("end"),
    ).withColumn("company", blank_to_null(normalize_company(F.col("raw_company"))))
    rows = rows.where("company is not null or title is not null or start is not null or end is not null or summary is not null")
    group = F.when(F.col("company").isNotNull(), company_key(F.col("company"))).otherwise(F.concat(F.lit("__none__:"), F.coalesce("title", F.lit(""))))
    rank = F.struct("title_conf", "title_rel", F.length(F.coalesce("title", F.lit(""))), -F.col("record_idx"), -F.col("item"))
    items = rows.withColumn("group", group).groupBy("component", "group").agg(
        F.max_by(F.struct("raw_company", "company", "title"), rank).alias("b"),
        F.min("start").alias("start"),
        F.when(F.count("end") == F.count("*"), F.max("end")).alias("end"),
        F.array_join(F.array_sort(F.collect_set("summary")), " | ").alias("summary"),
    )
    shown = F.coalesce(blank_to_null(normalize_company(F.coalesce("b.raw_company", "b.company"))), F.col("b.company"))
    item = F.struct(shown.alias("company"), F.col("b.title").alias("title"), "start", "end", blank_to_null(F.col("summary")).alias("summary")).cast(EXPERIENCE)
    return items.groupBy("component").agg(F.transform(F.array_sort(F.collect_list(F.struct("group", item.alias("item")))), lambda x: x["item"]).alias("experience"))


def education_items(members: DataFrame) -> DataFrame:
    """``component, education``: each study once, whatever its case, in the order of records."""
    rows = members.select("component", "record_idx", F.posexplode("education").alias("item", "e"))
    rows = rows.select("component", "record_idx", "item", *[clean_text(F.col(f"e.{c}.value")).alias(c) for c in ("institution", "degree", "field")], year_of(F.col("e.year.value")).alias("end_year"))
    rows = rows.where("institution is not null or degree is not null or field is not null or end_year is not null")
    item = F.struct("institution", "degree", "field", "end_year").cast(EDUCATION)
    first = rows.groupBy("component", F.lower("institution").alias("k1"), F.lower("degree").alias("k2"), F.lower("field").alias("k3"), F.col("end_year").alias("k4")).agg(F.min(F.struct("record_idx", "item", item.alias("value"))).alias("f"))
    return first.groupBy("component").agg(F.transform(F.array_sort(F.collect_list("f")), lambda x: x["value"]).alias("education"))


def provenance(contrib: DataFrame) -> DataFrame:
    """``component, provenance``: who gave what and how, each once, in order; dropped values count too."""
    entry = F.struct("field", "source", "method").cast(PROVENANCE)
    return contrib.groupBy("component").agg(F.array_sort(F.collect_set(entry)).alias("provenance"))


def candidate_ids(members: DataFrame) -> DataFrame:
    """``component, candidate_id``: a hash of the smallest e-mail, else phone, else name, else of the sources. Records give their own smallest values, so no row for each value is made."""
    least = lambda values, key: F.array_min(F.transform(values, lambda x: key(x)))
    rows = members.select("component", "source", least(F.col("emails.value"), email_key).alias("mail"), least(F.col("phones.value"), normalize_phone).alias("phone"), name_key(F.col("full_name.value")).alias("name"))
    keys = rows.groupBy("component").agg(F.min("mail").alias("mail"), F.min("phone").alias("phone"), F.min("name").alias("name"), F.array_join(F.array_sort(F.collect_set("source")), "|").alias("sources"))
    seed = F.coalesce(F.concat(F.lit("email:"), "mail"), F.concat(F.lit("phone:"), "phone"), F.concat(F.lit("name:"), "name"), F.concat(F.lit("source:"), "sources"))
    made = F.struct(F.concat(F.lit("cand_"), F.substring(F.sha2(seed, 256), 1, 16)).alias("value"), F.lit("merger").alias("source"), F.lit(1.0).alias("confidence"), F.lit("derived").alias("extraction_method"))
    return keys.select("component", made.cast(tracked()).alias("candidate_id"))


def overall_confidence() -> Column:
    """Mean confidence of the name, first e-mail, first phone and country that are there; 0 without any."""
    there = F.array_compact(F.array("full_name.confidence", F.get("emails", F.lit(0))["confidence"], F.get("phones", F.lit(0))["confidence"], "location.country.confidence"))
    return F.when(F.size(there) == 0, 0.0).otherwise(clamp01(F.aggregate(there, F.lit(0.0), lambda a, x: a + x) / F.size(there)))


def fuse(members: DataFrame) -> DataFrame:
    """Canonical records of ``component`` and partial records, with ``component``."""
    contrib = contributions(members)
    out = candidate_ids(members)
    for part in (canonical_fields(resolve_fields(normalized(contrib))), experience_timeline(members), education_items(members), provenance(contrib)):
        out = out.join(part, "component", "left")
    out = out.withColumn("overall_confidence", overall_confidence())
    return out.select(*[_filled(c, k).alias(c) for c, k in CANONICAL_FIELDS.items()], "component")


def _filled(name: str, kind: str) -> Column:
    """Components without any contribution have empty collections and no scalars."""
    c = F.col(name).cast(kind)
    if kind.startswith("array"):
        return F.coalesce(c, F.array().cast(kind))
    if name in ("location", "links"):
        parts = [F.col(f"{name}.{x}").alias(x) for x in ({"location": ("city", "region", "country"), "links": ("linkedin", "github", "portfolio")}[name])]
        if name == "links":
            parts.append(F.coalesce("links.other", F.array().cast(f"array<{tracked()}>")).alias("other"))
        return F.struct(*parts).cast(kind)
    return c
