"""Registered queries of the consolidation engine over the driver's tables, and the same in SQL.

The tables hold no people, so recruiter rows are derived from ``customer`` by arithmetic on its key, alike in both engines: a number of
persons that grows with the table, each with records that differ in spelling, contact data, profiles and source.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from confluo.functions import company as company_fn
from confluo.functions import dates, lookup, text
from confluo.functions.phone import normalize_phone, phone_key
from confluo.functions.similarity import similarity
from confluo.operators import fusion, linkage
from confluo.operators.components import connected_components
from confluo.plans.merge import merge
from confluo.plans.projection import load_config, project
from confluo.plans.validation import canonical_errors, projection_errors
from confluo.schema import PARTIAL_EDUCATION, PARTIAL_EXPERIENCE, S, carrier, complete
from confluo.sources.recruiter_csv import from_rows
from confluo.sources.resume import EMAIL, parse_resumes
from confluo.storage import materialize, spread

FIRST = ["Anouk", "Bastien", "Corin", "Delphi", "Edda", "Fenno", "Gisla", "Harun", "Ilka", "Jorun", "Kasimir", "Leonie", "Mirela", "Nuno", "Odile", "Pavel", "Quirin", "Runa", "Selma", "Tarek", "Ulla", "Vigdis", "Wanda"]
LAST_A = ["Brand", "Fels", "Grau", "Holm", "Kest", "Lind", "Moor", "Nord", "Quist", "Rehn", "Stol"]
LAST_B = ["ma", "son", "el", "ora", "ski", "wick", "ton", "berg", "ides", "ova", "nen", "ard", "ez"]
FIRM_A = ["Alder", "Birken", "Corvid", "Dunlin", "Elver", "Ferro", "Gannet", "Heron", "Ibex", "Jackdaw", "Kestrel", "Lapwing", "Merlin", "Nuthatch", "Osprey", "Plover", "Quill", "Rook", "Siskin"]
FIRM_B = ["Systems", "Labs", "Foods", "Media", "Energy", "Motors", "Health", "Retail", "Cloud", "Games", "Works"]
ENDING = ["Inc", "LLC", "Corp", "Corporation", "Ltd", "", "Co."]
TITLE = ["Engineer", "Senior Engineer", "Data Scientist", "Product Manager", "QA Lead", "Staff Engineer", "Analyst", "Designer", "Recruiter"]
SKILL = ["py", "JS", "Golang", "k8s", "Docker", "PostgreSQL", "Ninjutsu", "React.js", "c++", "rust "]
DOMAIN = ["example.com", "mail.test", "work.io"]
SOURCE = ["recruiter_csv", "resume", "github_api", "recruiter_notes"]
METHOD = ["structured", "regex", "free-text"]
CITY = ["Turku", "Porto", "Graz"]
COUNTRY = [" India", "GERMANY", "United States", "Atlantis"]


def _people_sql(duck: bool) -> str:
    def pick(values: list[str], index: str) -> str:
        quoted = ", ".join(f"'{v}'" for v in values)
        return f"([{quoted}])[CAST({index} AS INTEGER) + 1]" if duck else f"element_at(array({quoted}), CAST({index} AS INT) + 1)"

    text_type, table = ("VARCHAR", "customer") if duck else ("STRING", "{customer}")
    return f"""
SELECT k, p,
  CASE k % 10 WHEN 3 THEN concat('  ', substr(f, 1, 1), '. ', l) WHEN 4 THEN concat(upper(f), ' ', upper(l)) WHEN 5 THEN concat(f, '  ', l, ' ') WHEN 6 THEN ' ' ELSE concat(f, ' ', l) END AS name,
  CASE WHEN k % 5 = 0 THEN '' WHEN k % 7 = 0 THEN concat(upper(f), '.', l, '@', {pick(DOMAIN, "p % 3")}) ELSE concat(lower(f), '.', lower(l), CAST(p AS {text_type}), '@', {pick(DOMAIN, "k % 3")}) END AS email,
  CASE k % 6 WHEN 0 THEN 'call me' WHEN 1 THEN concat('+91 98', lpad(CAST(p * 9973 % 100000000 AS {text_type}), 8, '0')) WHEN 2 THEN concat('98', lpad(CAST(p * 9973 % 100000000 AS {text_type}), 8, '0'))
    WHEN 3 THEN concat('(555) 321-', lpad(CAST(p % 10000 AS {text_type}), 4, '0')) WHEN 4 THEN '' ELSE concat('+1 415 555 ', lpad(CAST(p % 10000 AS {text_type}), 4, '0')) END AS phone,
  CASE WHEN k % 11 = 0 THEN ' ' ELSE concat({pick(FIRM_A, "p % 19")}, ' ', {pick(FIRM_B, "p % 11")}, ' ', {pick(ENDING, "k % 7")}) END AS current_company,
  CASE WHEN k % 13 = 0 THEN '' ELSE {pick(TITLE, "k % 9")} END AS title,
  {pick(SKILL, "k % 10")} AS skill, {pick(SOURCE, "k % 4")} AS source, {pick(METHOD, "k % 3")} AS method, round((50 + k % 7 * 5) / 100.0, 2) AS conf,
  CASE k % 5 WHEN 0 THEN concat('Jan ', CAST(2010 + k % 9 AS {text_type}), ' - Present') WHEN 1 THEN concat(CAST(2008 + k % 9 AS {text_type}), '-03 to ', CAST(2018 + k % 5 AS {text_type}), '/7') ELSE concat(CAST(2005 + k % 9 AS {text_type}), ' - ', CAST(2015 + k % 5 AS {text_type})) END AS dates,
  CASE WHEN k % 9 = 0 THEN concat('https://github.com/', lower(f), CAST(p AS {text_type}), '/') ELSE '' END AS github, CASE WHEN k % 8 = 3 THEN concat(' www.LinkedIn.com/in/', lower(f), CAST(p AS {text_type})) ELSE '' END AS linkedin,
  CASE WHEN k % 16 = 5 THEN concat('http://www.', l, '.dev//') ELSE '' END AS portfolio,
  CASE WHEN k % 4 = 1 THEN concat(' ', {pick(CITY, "k % 3")}) ELSE ' ' END AS city, CASE WHEN k % 6 = 2 THEN 'North  Shore' ELSE '' END AS region, {pick(COUNTRY, "k % 4")} AS country
FROM (SELECT k, p, {pick(FIRST, "p % 23")} AS f, concat({pick(LAST_A, "p * 7 % 11")}, {pick(LAST_B, "p * 5 % 13")}) AS l
  FROM (SELECT c_custkey AS k, c_custkey % (SELECT 61 + CAST(floor(count(*) / 25) AS BIGINT) FROM {table}) AS p FROM {table}))"""


def people(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey")
    return spark.sql(_people_sql(False), customer=spread(keys, "c_custkey"))


def partials(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recruiter rows as partial records."""
    return from_rows(people(spark, sf_dir), F.col("k"))


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Partial records of several sources and methods, with the number ``p`` of their person."""
    rows = people(spark, sf_dir)
    tracked = lambda c: F.when(F.trim(c) != "", F.struct(c.alias("value"), F.col("source").alias("source"), F.col("conf").cast("double").alias("confidence"), F.col("method").alias("extraction_method"))).cast(S)
    item = F.struct(tracked(F.col("current_company")).alias("company"), tracked(F.col("title")).alias("title"), tracked(F.col("dates")).alias("date_range"), F.lit(None).cast(S).alias("summary"))
    study = F.struct(tracked(F.concat(F.lit("State University "), (F.col("p") % 3).cast("string"))).alias("institution"), F.lit(None).cast(S).alias("degree"), F.lit(None).cast(S).alias("field"), tracked((F.lit(2000) + F.col("k") % 2).cast("string")).alias("year"))
    columns = {
        "record_idx": F.col("k"),
        "source": F.col("source"),
        "full_name": tracked(F.col("name")),
        "emails": F.array_compact(F.array(tracked(F.col("email")))),
        "phones": F.array_compact(F.array(tracked(F.col("phone")))),
        "location": F.struct(*[tracked(F.col(c)).alias(c) for c in ("city", "region", "country")]),
        "links": F.struct(*[tracked(F.col(c)).alias(c) for c in ("linkedin", "github", "portfolio")], F.array().cast(f"array<{S}>").alias("other")),
        "skills": F.array(tracked(F.col("skill"))),
        "experience": F.array(item).cast(f"array<{PARTIAL_EXPERIENCE}>"),
        "education": F.array(study).cast(f"array<{PARTIAL_EDUCATION}>"),
    }
    return rows.select("p", *complete(columns))


def members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records with the person's smallest key as the component: input of the fusion queries."""
    rows = records(spark, sf_dir)
    first = rows.groupBy("p").agg(F.min("record_idx").alias("component"))
    return spread(materialize(rows.join(first, "p").drop("p")), "record_idx")


def _contrib(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fusion.contributions(members(spark, sf_dir))


def _resolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fusion.resolve_fields(fusion.normalized(_contrib(spark, sf_dir)))


def scan_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = lambda c: F.get(c, F.lit(0))["value"]
    job = F.get("experience", F.lit(0))
    return partials(spark, sf_dir).select("record_idx", F.col("full_name.value").alias("name"), first("emails").alias("email"), first("phones").alias("phone"), job["company"]["value"].alias("company"), job["title"]["value"].alias("title"), F.size("experience").alias("n_jobs"))


def email_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = F.regexp_extract_all("text", F.lit(EMAIL), 0)
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.array_join(found, "|").alias("emails"), F.size(found).cast("long").alias("n"))


def link_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", text.profile_key(F.col("url")).alias("link"), text.profile_key(F.concat(F.lit(" HTTPS://www.Host.org/"), F.col("page_id").cast("string"), F.lit("//"))).alias("made"))


def company_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col("current_company")
    return people(spark, sf_dir).select("k", company_fn.company_key(c).alias("company_key"), company_fn.normalize_company(c).alias("company"))


def country_skill_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    nations = spark.read.parquet(f"{sf_dir}/nation.parquet")
    countries = nations.select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("key"), lookup.normalize_country(F.concat(F.lit(" "), F.lower("n_name"))).alias("found"), F.lit(None).cast("boolean").alias("allowed"))
    skills = people(spark, sf_dir).select(F.concat(F.lit("c"), F.col("k").cast("string")).alias("key"), lookup.normalize_skill(F.col("skill")).alias("found"), lookup.is_allowed_skill(F.col("skill")).alias("allowed"))
    return countries.unionByName(skills)


_DATE_FORMS = """CASE o_orderkey % 6 WHEN 0 THEN {y} WHEN 1 THEN concat({y}, '-', {m}) WHEN 2 THEN concat(' ', {y}, '/', {m}, ' ') WHEN 3 THEN concat({m}, '/', {y}) WHEN 4 THEN concat({m}, '-', {y}) ELSE concat({y}, '-13') END"""


def date_explicit(spark: SparkSession, sf_dir: str) -> DataFrame:
    form = _DATE_FORMS.format(y="CAST(year(o_orderdate) AS STRING)", m="CAST(month(o_orderdate) AS STRING)")
    return spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", dates.normalize_date(F.expr(form)).alias("month"))


def phones(spark: SparkSession, sf_dir: str) -> DataFrame:
    return people(spark, sf_dir).select("k", normalize_phone(F.col("phone")).alias("e164"), phone_key(F.col("phone")).alias("phone_key"))


def name_block_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return people(spark, sf_dir).select("k", F.explode(text.name_blocks(text.name_key(F.col("name")))).alias("block"))


def _keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linkage.record_keys(records(spark, sf_dir))


def _plain_sigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each record by itself, to see all pairs."""
    return _keys(spark, sf_dir).withColumn("lo", F.col("idx")).withColumn("hi", F.col("idx"))


def name_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linkage.block_pairs(_keys(spark, sf_dir), linkage.name_block_keys())


def composite_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linkage.block_pairs(_keys(spark, sf_dir), linkage.composite_blocks())


def strong_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linkage.strong_edges(materialize(_keys(spark, sf_dir)))


def components_strong(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components over shared e-mails and shared phones, the latter to make chains."""
    keys = materialize(_keys(spark, sf_dir))
    both = keys.select("idx", F.explode(F.concat("emails", "phones")).alias("x"))
    stars = both.join(both.groupBy("x").agg(F.min("idx").alias("src")).hint("merge"), "x").select("src", F.col("idx").alias("dst"))
    found = connected_components(stars)
    return keys.select("idx").join(found.hint("merge"), F.col("idx") == F.col("node"), "left").select("idx", F.coalesce("component", "idx").alias("component"))


def pair_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pairs that a rule may link, with all parts of their score."""
    sigs = materialize(linkage.with_blocks(_plain_sigs(spark, sf_dir).drop("idx")))
    similar, hopeful = linkage.similar_pairs(sigs), linkage.hopeful_pairs(sigs, "l.name = r.name")
    by_score = linkage.scored_pairs(hopeful).where("by_score and score >= 0.58 and not (by_name and name >= 0.9)")
    return linkage.scored_pairs(similar).unionByName(by_score)


def name_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of one person, and those of a person and the next."""
    rows = people(spark, sf_dir).select("p", text.name_key(F.col("name")).alias("x")).distinct()
    others = rows.select(F.explode(F.array(F.col("p"), F.col("p") - 1)).alias("p"), F.col("x").alias("y"))
    return rows.join(others, "p").where("x < y").select("p", "x", "y", similarity(F.col("x"), F.col("y")).alias("ratio"))


def scalar_ladder(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _resolved(spark, sf_dir).where("field = 'full_name'")
    return rows.select("component", *[F.col(f"best.{c}").alias(c) for c in ("value", "source", "confidence", "extraction_method")])


def value_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _resolved(spark, sf_dir).where("field in ('emails', 'phones')").select("component", "field", F.explode("all").alias("x"))
    return rows.select("component", "field", *[F.col(f"x.{c}").alias(c) for c in ("value", "source", "confidence", "extraction_method")])


def skills_agg(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fusion.canonical_fields(_resolved(spark, sf_dir)).select("component", F.explode("skills").alias("s"))
    return rows.select("component", F.col("s.name").alias("name"), F.col("s.confidence").alias("confidence"), F.array_join("s.sources", "|").alias("sources"))


def experience_timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fusion.experience_timeline(members(spark, sf_dir)).select("component", F.explode("experience").alias("e"))
    return rows.select("component", "e.company", "e.title", "e.start", "e.end")


def education_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fusion.education_items(members(spark, sf_dir)).select("component", F.posexplode("education").alias("pos", "e"))
    return rows.select("component", "pos", "e.institution", "e.end_year")


def provenance_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fusion.provenance(_contrib(spark, sf_dir)).select("component", F.posexplode("provenance").alias("pos", "x"))
    return rows.select("component", "pos", "x.field", "x.source", "x.method")


def candidate_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fusion.candidate_ids(members(spark, sf_dir)).select("component", F.col("candidate_id.value").alias("candidate_id"))


def overall_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fusion.fuse(members(spark, sf_dir)).select("component", "overall_confidence")


def project_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    config = load_config({"fields": [{"path": "name", "from": "full_name"}, {"path": "contact.email", "from": "emails[0]"}, {"path": "contact.last", "from": "emails[-1]"}, {"path": "skills", "from": "skills[].name", "normalize": "canonical"}, {"path": "gone", "from": "no.such[0].path"}]})
    fused = fusion.fuse(members(spark, sf_dir))
    out = project(fused, config)
    return out.select("name", F.col("contact.email").alias("email"), F.col("contact.last").alias("last_email"), F.array_join("skills", "|").alias("skills"), "gone")


def validate_required(spark: SparkSession, sf_dir: str) -> DataFrame:
    config = load_config({"fields": [{"path": "full_name", "required": True, "type": "string"}, {"path": "mail", "from": "emails[0]", "required": True}, {"path": "skills", "type": "string"}]})
    return projection_errors(fusion.fuse(members(spark, sf_dir)), config).select("component", F.array_join("errors", "; ").alias("errors"))


def validate_canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Canonical records, five of six with a value that breaks a rule."""
    good = fusion.fuse(members(spark, sf_dir))
    made = lambda v: F.struct(F.lit(v).alias("value"), F.lit("resume").alias("source"), F.lit(0.5).alias("confidence"), F.lit("regex").alias("extraction_method")).cast(S)
    job = F.struct(F.lit("Alder").alias("company"), F.lit(None).cast("string").alias("title"), F.lit("2019").alias("start"), F.lit(None).cast("string").alias("end"), F.lit(None).cast("string").alias("summary"))
    study = F.struct(F.lit("School").alias("institution"), F.lit(None).cast("string").alias("degree"), F.lit(None).cast("string").alias("field"), F.lit(1800).alias("end_year"))
    bad = {"phones": F.array(made("12345")), "location": F.col("location").withField("country", made("Germany")), "experience": F.concat("experience", F.array(job)), "education": F.concat("education", F.array(study)), "overall_confidence": F.lit(1.5)}
    rows = good.withColumns({c: F.when(F.col("component") % 6 == i, v).otherwise(F.col(c)) for i, (c, v) in enumerate(bad.items(), 1)})
    return canonical_errors(rows).select("component", F.array_join("errors", "; ").alias("errors"))


def resumes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Resume texts of the people that have a name."""
    body = F.concat_ws("\n", F.trim("name"), F.lit("Builder of things"), F.concat(F.lit("Email: "), F.col("email"), F.lit(" | Phone: "), F.col("phone"), F.lit(" | https://github.com/user"), F.col("p").cast("string"), F.lit("/")), F.lit(""), F.lit("Skills"), F.concat(F.lit("Tools: "), F.col("skill"), F.lit(", Go | SQL;")), F.lit("EXPERIENCE"), F.concat(F.trim("current_company"), F.lit(" - "), F.col("title")), F.col("dates"), F.lit("  Did this"), F.lit("and that."), F.lit("Education"), F.lit("B.S. Design, State University, 2016"))
    return people(spark, sf_dir).where("trim(name) <> '' and trim(current_company) <> '' and title <> ''").select(F.col("k").alias("record_idx"), body.alias("text"))


def resume_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    job, study = F.get("experience", F.lit(0)), F.get("education", F.lit(0))
    value = lambda c: F.get(c, F.lit(0))["value"]
    return parse_resumes(resumes(spark, sf_dir)).select(
        "record_idx", F.col("full_name.value").alias("name"), F.col("headline.value").alias("headline"), value("emails").alias("email"), F.col("links.github.value").alias("github"),
        F.array_join(F.transform("skills", lambda s: s["value"]), "|").alias("skills"), job["company"]["value"].alias("company"), job["title"]["value"].alias("title"), job["date_range"]["value"].alias("dates"),
        job["summary"]["value"].alias("summary"), study["degree"]["value"].alias("degree"), study["field"]["value"].alias("field"), study["institution"]["value"].alias("institution"), study["year"]["value"].alias("year"),
    )


def clusters_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linkage.cluster(records(spark, sf_dir).drop("p"))


def location_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fusion.canonical_fields(_resolved(spark, sf_dir))
    shown = [F.col(f"{group}.{c}.{x}").alias(f"{c}{suffix}") for group, names in (("location", ("city", "region", "country")), ("links", ("linkedin", "github", "portfolio"))) for c in names for x, suffix in (("value", ""), ("confidence", "_confidence"))]
    return rows.select("component", *shown)


def merge_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merge(records(spark, sf_dir).drop("p")).select(
        "component", F.col("candidate_id.value").alias("candidate_id"), F.col("full_name.value").alias("full_name"), F.size("emails").alias("n_emails"), F.size("phones").alias("n_phones"), F.size("experience").alias("n_jobs"), F.size("education").alias("n_studies"),
        F.array_join(F.transform("skills", lambda x: x["name"]), "|").alias("skills"), F.col("location.country.value").alias("country"), F.col("links.github.value").alias("github"), "overall_confidence",
    )


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merge_full(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        scan_clean, email_extract, link_keys, company_names, country_skill_lookup, date_explicit, phones, name_block_keys, name_pairs, composite_pairs, strong_edges, components_strong, pair_scores, name_similarity,
        scalar_ladder, value_list, skills_agg, experience_timeline, education_dedupe, provenance_ledger, candidate_id, overall_confidence, project_paths, validate_required, validate_canonical, resume_parse, location_links, clusters_full, merge_full,
    )
}

_PEOPLE = _people_sql(True)
_NAME = "nullif(regexp_replace(lower(trim(name)), '\\s+', ' ', 'g'), '')"
_DIGITS = "regexp_replace(phone, '\\D', '', 'g')"
_E164 = f"CASE WHEN phone LIKE '+91%' THEN '+' || {_DIGITS} WHEN phone LIKE '98%' THEN '+91' || phone WHEN phone LIKE '+1%' THEN '+' || {_DIGITS} END"
link = lambda c: "nullif(rtrim(regexp_replace(regexp_replace(lower(trim(" + c + ")), '^[a-z][a-z0-9+.\\-]*://', ''), '^www\\.', ''), '/'), '')"
_KEYS = f"""keys AS (
  SELECT *, {_NAME} AS nk, nullif(lower(trim(email)), '') AS ek, {_E164} AS e164,
    coalesce({_E164}, CASE WHEN length({_DIGITS}) >= 10 THEN right({_DIGITS}, 10) WHEN length({_DIGITS}) >= 7 THEN {_DIGITS} END) AS pk,
    nullif(lower(trim(regexp_replace(trim(current_company), '(?i)(?:[,.\\s]+|\\b)(?:incorporated|corporation|corp|inc|llc|ltd|limited|co|company)\\.?\\s*$', ''), ' ,.')), '') AS ck,
    {link('github')} AS gk, {link('linkedin')} AS lk, nullif(lower(trim(title)), '') AS tk
  FROM people)"""
_BLOCKS = """blocks AS (
  SELECT DISTINCT k, unnest(['last:' || string_split(nk, ' ')[-1], 'init:' || list_aggregate(list_sort(list_transform(string_split(nk, ' '), lambda t: t[1])), 'string_agg', ''), 'pre:' || substr(replace(nk, ' ', ''), 1, 4)]) AS block
  FROM keys WHERE nk IS NOT NULL)"""
_TRUST = "CASE {s} WHEN 'recruiter_csv' THEN 0.80::DOUBLE WHEN 'resume' THEN 0.60::DOUBLE WHEN 'github_api' THEN 0.70::DOUBLE ELSE 0.50::DOUBLE END"
_REL = "CASE {m} WHEN 'structured' THEN 1.0::DOUBLE WHEN 'regex' THEN 0.8::DOUBLE ELSE 0.5::DOUBLE END"
_T, _R = _TRUST.format(s="source"), _REL.format(m="method")
def _with(components: str = "SELECT k AS record_idx, min(k) OVER (PARTITION BY p) AS component FROM keys", before: str = "") -> str:
    """People, keys, what comes before, and ``comp``: the records with their component."""
    return f"WITH RECURSIVE people AS ({_PEOPLE}), {_KEYS}, {before} member AS ({components}), comp AS (SELECT keys.*, component, conf::DOUBLE AS cf, {_T} AS trust, {_R} AS rel FROM keys JOIN member ON record_idx = k)"


_WITH = _with()
_CONF = "least(1.0::DOUBLE, 0.5::DOUBLE * trust + 0.3::DOUBLE * (n_w::DOUBLE / n_s) + 0.2::DOUBLE * rel)"


def _values(field: str, value: str, cond: str = "TRUE") -> str:
    """One row for each component and value: its rank, carrier, mean trust over sorted sources, and numbers of sources."""
    return f"""
v_{field} AS (SELECT component, {value} AS value, source, cf, method, rel, trust, k FROM comp WHERE {value} IS NOT NULL AND {cond}),
s_{field} AS (SELECT component, count(DISTINCT source) AS n_s FROM v_{field} GROUP BY component),
d_{field} AS (SELECT component, value, sum(trust ORDER BY source) / count(*) AS trust, count(*) AS n_w, string_agg(source, '|' ORDER BY source) AS sources FROM (SELECT DISTINCT component, value, source, trust FROM v_{field}) GROUP BY component, value),
c_{field} AS (SELECT *, row_number() OVER (PARTITION BY component, value ORDER BY cf DESC, rel DESC, source, k) AS r, max(cf) OVER (PARTITION BY component, value) AS mc, max(rel) OVER (PARTITION BY component, value) AS mr FROM v_{field}),
g_{field} AS (
  SELECT c.component, c.value, c.source, c.method AS extraction_method, c.mc, c.mr, d.n_w, d.sources, least(1.0::DOUBLE, 0.5::DOUBLE * d.trust + 0.3::DOUBLE * (d.n_w::DOUBLE / s.n_s) + 0.2::DOUBLE * c.rel) AS confidence,
    least(1.0::DOUBLE, 0.5::DOUBLE * d.trust + 0.3::DOUBLE * (d.n_w::DOUBLE / s.n_s) + 0.2::DOUBLE * c.mr) AS skill_confidence
  FROM c_{field} c JOIN d_{field} d ON c.component = d.component AND c.value = d.value JOIN s_{field} s ON c.component = s.component WHERE c.r = 1)"""


_CLEAN_NAME = "nullif(regexp_replace(trim(name), '\\s+', ' ', 'g'), '')"
_NAMES = _values("name", _CLEAN_NAME)
_BEST_NAME = "best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY component ORDER BY mc DESC, n_w DESC, mr DESC, value) AS w FROM g_name) WHERE w = 1)"
_SKILL_NAME = "CASE skill WHEN 'py' THEN 'Python' WHEN 'JS' THEN 'JavaScript' WHEN 'Golang' THEN 'Go' WHEN 'k8s' THEN 'Kubernetes' WHEN 'React.js' THEN 'React' WHEN 'c++' THEN 'C#' WHEN 'rust ' THEN 'Rust' ELSE skill END"
_COMPANY = """CASE WHEN core = '' THEN cleaned WHEN regexp_matches(low, '\\b(corp|co|corporation|company)\\b') THEN core || ' Corporation' WHEN regexp_matches(low, '\\binc\\b') THEN core || ' Inc'
  WHEN regexp_matches(low, '\\bllc\\b') THEN core || ' LLC' WHEN regexp_matches(low, '\\b(ltd|limited)\\b') THEN core || ' Ltd' ELSE core END"""
_COMPANIES = """named AS (SELECT *, regexp_replace(trim(current_company), '\\s+', ' ', 'g') AS cleaned, lower(cleaned) AS low,
  trim(regexp_replace(cleaned, '(?i)(?:[,.\\s]+|\\b)(?:incorporated|corporation|corp|inc|llc|ltd|limited|co|company)\\.?\\s*$', ''), ' ,.') AS core FROM comp)"""
_ID = "'cand_' || substr(sha256(coalesce('email:' || min(ek), 'phone:' || min(e164), 'name:' || min(nk), 'source:' || string_agg(DISTINCT source, '|' ORDER BY source))), 1, 16)"

_COMPOSITE = """cb AS (
  SELECT k, 'last:' || string_split(nk, ' ')[-1] AS block FROM keys WHERE nk IS NOT NULL UNION SELECT k, 'init:' || nk[1] || string_split(nk, ' ')[-1] FROM keys WHERE nk IS NOT NULL
  UNION SELECT k, 'phone:' || pk FROM keys WHERE pk IS NOT NULL UNION SELECT k, 'co:' || ck FROM keys WHERE ck IS NOT NULL
  UNION SELECT k, 'email:' || string_split(string_split(ek, '@')[1], '.')[1] || '@' || string_split(ek, '@')[2] FROM keys WHERE ek IS NOT NULL)"""
_STRONG = """x AS (SELECT k, 'e:' || ek AS v FROM keys WHERE ek IS NOT NULL UNION SELECT k, 'p:' || gk FROM keys WHERE gk IS NOT NULL UNION SELECT k, 'p:' || lk FROM keys WHERE lk IS NOT NULL),
strong AS (SELECT DISTINCT src, k AS dst FROM x JOIN (SELECT v, min(k) AS src FROM x GROUP BY v) USING (v) WHERE k <> src)"""


def _ratios(asked: str) -> str:
    """``ratios``: twice the matched characters of x and y over their lengths, by longest common blocks, leftmost in x and then in y, and what is left and right of them."""
    return f"""asked AS ({asked}),
blk(x, y, al, ah, bl, bh, size) AS (
  SELECT x, y, 0::BIGINT, length(x)::BIGINT, 0::BIGINT, length(y)::BIGINT, 0::BIGINT FROM asked
  UNION ALL
  SELECT x, y, CASE side WHEN 0 THEN al ELSE m.k - m.i END, CASE side WHEN 0 THEN -m.i ELSE ah END, CASE side WHEN 0 THEN bl ELSE m.k - m.j END, CASE side WHEN 0 THEN -m.j ELSE bh END, CASE side WHEN 0 THEN m.k ELSE 0 END
  FROM (
    SELECT x, y, al, ah, bl, bh, max({{'k': k, 'i': -i, 'j': -j}}) AS m FROM (
      SELECT x, y, al, ah, bl, bh, i, j, unnest(range(1, least(ah - i, bh - j) + 1)) AS k FROM (
        SELECT *, unnest(range(bl, bh)) AS j FROM (SELECT x, y, al, ah, bl, bh, unnest(range(al, ah)) AS i FROM blk))
      WHERE x[i + 1] = y[j + 1])
    WHERE substr(x, i + 1, k) = substr(y, j + 1, k) GROUP BY x, y, al, ah, bl, bh), (VALUES (0), (1)) AS s(side)),
ratios AS (SELECT x, y, 2.0::DOUBLE * sum(size)::DOUBLE / (length(x) + length(y))::DOUBLE AS r FROM blk GROUP BY x, y)"""


_LEADS = "(starts_with(r1, r2) OR starts_with(r2, r1))"
_SCORED = f"""{_BLOCKS}, {_COMPOSITE},
cand AS (SELECT a, b, bool_or(n) AS by_name, bool_or(NOT n) AS by_score FROM (SELECT DISTINCT l.k AS a, r.k AS b, TRUE AS n FROM blocks l JOIN blocks r ON l.block = r.block AND l.k < r.k UNION ALL SELECT DISTINCT l.k, r.k, FALSE FROM cb l JOIN cb r ON l.block = r.block AND l.k < r.k) GROUP BY a, b),
j AS (
  SELECT a, b, by_name, by_score, l.nk AS n1, r.nk AS n2, l.ek AS e1, r.ek AS e2, l.pk AS p1, r.pk AS p2, l.ck AS c1, r.ck AS c2, l.tk AS t1, r.tk AS t2, (l.source = 'resume') <> (r.source = 'resume') AS res,
    string_split(l.ek, '@')[1] AS l1, string_split(r.ek, '@')[1] AS l2, string_split(l.ek, '@')[2] AS d1, string_split(r.ek, '@')[2] AS d2, string_split(string_split(l1, '.')[1], '+')[1] AS r1, string_split(string_split(l2, '.')[1], '+')[1] AS r2,
    list_filter([l.gk, l.lk], lambda v: v IS NOT NULL) AS q1, list_filter([r.gk, r.lk], lambda v: v IS NOT NULL) AS q2,
    string_split(l.nk, ' ')[-1] = string_split(r.nk, ' ')[-1] AS same, rtrim(string_split(l.nk, ' ')[1], '.') AS f1, rtrim(string_split(r.nk, ' ')[1], '.') AS f2
  FROM cand JOIN keys l ON a = l.k JOIN keys r ON b = r.k),
{_ratios(f"SELECT n1 AS x, n2 AS y FROM j WHERE n1 <> n2 UNION SELECT c1, c2 FROM j WHERE c1 <> c2 UNION SELECT t1, t2 FROM j WHERE t1 <> t2 UNION SELECT l1, l2 FROM j WHERE e1 <> e2 AND (d1 <> d2 OR NOT {_LEADS})")},
parts AS (
  SELECT j.*, CASE WHEN n1 = n2 THEN 1.0::DOUBLE ELSE coalesce(rn.r, 0.0::DOUBLE) END AS name,
    CASE WHEN coalesce(same, FALSE) THEN CASE WHEN f1 = f2 OR (length(f1) = 1 AND starts_with(f2, f1)) OR (length(f2) = 1 AND starts_with(f1, f2)) THEN 1.0::DOUBLE WHEN length(f1) >= 2 AND length(f2) >= 2 AND substr(f1, 1, 3) = substr(f2, 1, 3) THEN 0.85::DOUBLE ELSE 0.0::DOUBLE END ELSE 0.0::DOUBLE END AS initial,
    CASE WHEN e1 IS NULL OR e2 IS NULL THEN 0.0::DOUBLE WHEN e1 = e2 THEN 1.0::DOUBLE WHEN d1 = d2 THEN CASE WHEN r1 = r2 THEN 0.9::DOUBLE WHEN {_LEADS} THEN 0.75::DOUBLE ELSE rl.r * 0.6::DOUBLE END WHEN rl.r >= 0.85 THEN 0.35::DOUBLE WHEN {_LEADS} THEN 0.45::DOUBLE ELSE 0.0::DOUBLE END AS email,
    CASE WHEN coalesce(p1 = p2, FALSE) THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS phone, CASE WHEN coalesce(c1 = c2 OR rc.r >= 0.92, FALSE) THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS company,
    CASE WHEN t1 = t2 THEN 1.0::DOUBLE WHEN rt.r >= 0.85 THEN rt.r ELSE 0.0::DOUBLE END AS title, CASE WHEN res THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS resume, list_has_any(q1, q2) AS profile,
    coalesce(e1 <> e2, FALSE) OR (len(q1) > 0 AND len(q2) > 0 AND NOT list_has_any(q1, q2)) AS conflict
  FROM j LEFT JOIN ratios rn ON n1 = rn.x AND n2 = rn.y LEFT JOIN ratios rl ON l1 = rl.x AND l2 = rl.y LEFT JOIN ratios rc ON c1 = rc.x AND c2 = rc.y LEFT JOIN ratios rt ON t1 = rt.x AND t2 = rt.y),
scored AS (
  SELECT *, least(1.0::DOUBLE, 0.22::DOUBLE * name + 0.18::DOUBLE * initial + 0.12::DOUBLE * email + 0.22::DOUBLE * phone + 0.14::DOUBLE * company + 0.07::DOUBLE * title + 0.05::DOUBLE * resume) AS score,
    phone > 0 OR email >= 0.75 OR profile OR (company >= 1 AND initial >= 0.85) OR (resume >= 1 AND (phone > 0 OR company >= 1 OR email >= 0.45)) AS corroborated
  FROM parts)"""
_CLUSTERS = f"""{_STRONG}, {_SCORED},
edge AS (SELECT src, dst FROM strong UNION SELECT a, b FROM scored WHERE (by_name AND name >= 0.9 AND NOT conflict) OR (by_score AND score >= 0.58 AND (NOT conflict OR (score >= 0.72 AND corroborated)))),
way AS (SELECT src AS a, dst AS b FROM edge UNION SELECT dst, src FROM edge),
reach AS (SELECT a, b FROM way UNION SELECT r.a, w.b FROM reach r JOIN way w ON r.b = w.a),
cluster AS (SELECT k AS record_idx, least(k, coalesce(min(b), k)) AS component FROM keys LEFT JOIN reach ON k = a GROUP BY k),"""
_MERGED = _with("SELECT * FROM cluster", _CLUSTERS)


def _best(field: str) -> str:
    return f"b_{field} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY component ORDER BY mc DESC, n_w DESC, mr DESC, value) AS w FROM g_{field}) WHERE w = 1)"


_PLACES = {
    "city": "nullif(regexp_replace(trim(city), '\\s+', ' ', 'g'), '')", "region": "nullif(regexp_replace(trim(region), '\\s+', ' ', 'g'), '')",
    "country": "CASE lower(trim(country)) WHEN 'india' THEN 'IN' WHEN 'germany' THEN 'DE' WHEN 'united states' THEN 'US' END",
    "linkedin": "lk", "github": "gk", "portfolio": link("portfolio"),
}

ORACLE_SQL: dict[str, str] = {
    "scan_clean": f"WITH people AS ({_PEOPLE}) SELECT k AS record_idx, nullif(trim(name), '') AS name, nullif(trim(email), '') AS email, nullif(trim(phone), '') AS phone, nullif(trim(current_company), '') AS company, nullif(trim(title), '') AS title, CASE WHEN trim(current_company) <> '' OR trim(title) <> '' THEN 1 ELSE 0 END AS n_jobs FROM people",
    "email_extract": f"SELECT doc_id, array_to_string(regexp_extract_all(text, '{EMAIL}'), '|') AS emails, len(regexp_extract_all(text, '{EMAIL}')) AS n FROM documents",
    "link_keys": "SELECT page_id, nullif(rtrim(regexp_replace(regexp_replace(lower(trim(url)), '^[a-z][a-z0-9+.\\-]*://', ''), '^www\\.', ''), '/'), '') AS link, 'host.org/' || CAST(page_id AS VARCHAR) AS made FROM pages",
    "company_names": f"{_WITH}, {_COMPANIES} SELECT k, lower(core) AS company_key, {_COMPANY} AS company FROM named",
    "country_skill_lookup": f"""WITH people AS ({_PEOPLE})
SELECT 'n' || n_nationkey AS key, CASE lower(n_name) WHEN 'united states' THEN 'US' WHEN 'india' THEN 'IN' WHEN 'united kingdom' THEN 'GB' WHEN 'canada' THEN 'CA' WHEN 'germany' THEN 'DE' WHEN 'france' THEN 'FR' WHEN 'australia' THEN 'AU' END AS found, NULL::BOOLEAN AS allowed FROM nation
UNION ALL SELECT 'c' || k, {_SKILL_NAME}, skill <> 'Ninjutsu' FROM people""",
    "date_explicit": "SELECT o_orderkey, CASE o_orderkey % 6 WHEN 0 THEN CAST(year(o_orderdate) AS VARCHAR) || '-01' WHEN 5 THEN NULL ELSE strftime(o_orderdate, '%Y-%m') END AS month FROM orders",
    "phones": f"{_WITH} SELECT k, e164, pk AS phone_key FROM comp",
    "name_block_keys": f"{_WITH}, {_BLOCKS} SELECT k, block FROM blocks",
    "name_pairs": f"{_WITH}, {_BLOCKS} SELECT DISTINCT l.k AS a, r.k AS b FROM blocks l JOIN blocks r ON l.block = r.block AND l.k < r.k",
    "composite_pairs": f"{_WITH}, {_COMPOSITE} SELECT DISTINCT l.k AS a, r.k AS b FROM cb l JOIN cb r ON l.block = r.block AND l.k < r.k",
    "strong_edges": f"{_WITH}, {_STRONG} SELECT src, dst FROM strong",
    "components_strong": f"""WITH RECURSIVE people AS ({_PEOPLE}), {_KEYS}, x AS (SELECT k, ek AS v FROM keys WHERE ek IS NOT NULL UNION SELECT k, pk FROM keys WHERE pk IS NOT NULL),
star AS (SELECT x.k, s.src FROM x JOIN (SELECT v, min(k) AS src FROM x GROUP BY v) s USING (v)), edge AS (SELECT k AS a, src AS b FROM star UNION SELECT src, k FROM star),
reach AS (SELECT a, b FROM edge UNION SELECT r.a, e.b FROM reach r JOIN edge e ON r.b = e.a)
SELECT keys.k AS idx, least(keys.k, coalesce(min(b), keys.k)) AS component FROM keys LEFT JOIN reach ON keys.k = reach.a GROUP BY keys.k""",
    "pair_scores": f"{_WITH}, {_SCORED} SELECT a, b, by_name, by_score, conflict, corroborated, score, name, initial, email, phone, company, title, resume FROM scored WHERE (by_name AND name >= 0.9) OR (by_score AND score >= 0.58)",
    "name_similarity": f"{_WITH}, n AS (SELECT DISTINCT p, nk AS x FROM keys), s AS (SELECT l.p, l.x, r.x AS y FROM n l JOIN n r ON (r.p = l.p OR r.p = l.p + 1) AND l.x < r.x), {_ratios('SELECT DISTINCT x, y FROM s')} SELECT p, s.x, s.y, r AS ratio FROM s JOIN ratios ON s.x = ratios.x AND s.y = ratios.y",
    "clusters_full": f"{_MERGED} SELECT record_idx, component FROM member",
    "location_links": f"{_WITH}, {', '.join(f'{_values(c, v)}, {_best(c)}' for c, v in _PLACES.items())} SELECT component, "
    + ", ".join(f"b_{c}.value AS {c}, b_{c}.confidence AS {c}_confidence" for c in _PLACES)
    + " FROM (SELECT DISTINCT component FROM comp WHERE nk IS NOT NULL OR ek IS NOT NULL OR e164 IS NOT NULL OR skill <> 'Ninjutsu') "
    + " ".join(f"LEFT JOIN b_{c} USING (component)" for c in _PLACES),
    "merge_full": f"""{_MERGED}, {_NAMES}, {_BEST_NAME}, {_values("mail", "ek")}, {_values("phone", "e164")}, {_values("country", _PLACES["country"])}, {_best("country")}, {_values("github", "gk")}, {_best("github")}, {_COMPANIES},
jobs AS (SELECT component, count(DISTINCT CASE WHEN coalesce({_COMPANY}, '') = '' THEN '__none__:' || coalesce(nullif(trim(title), ''), '') ELSE lower(core) END) AS n FROM named GROUP BY component),
c AS (SELECT component, 1 AS o, confidence FROM best UNION ALL SELECT component, 2, arg_min(confidence, value) FROM g_mail GROUP BY component UNION ALL SELECT component, 3, arg_min(confidence, value) FROM g_phone GROUP BY component UNION ALL SELECT component, 4, confidence FROM b_country),
m AS (SELECT component, {_ID} AS candidate_id, count(DISTINCT ek) AS n_emails, count(DISTINCT e164) AS n_phones, count(DISTINCT concat(p % 3, '/', k % 2)) AS n_studies, coalesce(string_agg(DISTINCT {_SKILL_NAME}, '|' ORDER BY {_SKILL_NAME}) FILTER (WHERE skill <> 'Ninjutsu'), '') AS skills FROM comp GROUP BY component)
SELECT m.component, candidate_id, best.value AS full_name, CAST(n_emails AS INTEGER) AS n_emails, CAST(n_phones AS INTEGER) AS n_phones, CAST(jobs.n AS INTEGER) AS n_jobs, CAST(n_studies AS INTEGER) AS n_studies, skills, b_country.value AS country, b_github.value AS github,
  coalesce((SELECT sum(confidence ORDER BY o) / count(confidence) FROM c WHERE c.component = m.component), 0.0::DOUBLE) AS overall_confidence
FROM m JOIN jobs ON jobs.component = m.component LEFT JOIN best ON best.component = m.component LEFT JOIN b_country ON b_country.component = m.component LEFT JOIN b_github ON b_github.component = m.component""",
    "scalar_ladder": f"{_WITH}, {_NAMES}, {_BEST_NAME} SELECT component, value, source, confidence, extraction_method FROM best",
    "value_list": f"{_WITH}, {_values('mail', 'ek')}, {_values('phone', 'e164')} SELECT component, 'emails' AS field, value, source, confidence, extraction_method FROM g_mail UNION ALL SELECT component, 'phones', value, source, confidence, extraction_method FROM g_phone",
    "skills_agg": f"""{_WITH}, {_values("skill", _SKILL_NAME, "skill <> 'Ninjutsu'")} SELECT component, value AS name, skill_confidence AS confidence, sources FROM g_skill""",
    "experience_timeline": f"""{_WITH}, {_COMPANIES}, e AS (
  SELECT component, k, nullif({_COMPANY}, '') AS company, nullif(trim(title), '') AS title, CASE WHEN trim(title) <> '' THEN cf ELSE 0.0 END AS tc, CASE WHEN trim(title) <> '' THEN rel ELSE 0.5 END AS tr,
    CASE k % 5 WHEN 1 THEN substr(dates, 1, 7) WHEN 0 THEN substr(dates, 5, 4) || '-01' ELSE substr(dates, 1, 4) || '-01' END AS s, CASE k % 5 WHEN 0 THEN NULL WHEN 1 THEN substr(dates, 12, 4) || '-07' ELSE substr(dates, 8, 4) || '-01' END AS f, lower(core) AS ckey FROM named),
g AS (SELECT *, CASE WHEN company IS NULL THEN '__none__:' || coalesce(title, '') ELSE ckey END AS gk FROM e),
r AS (SELECT *, row_number() OVER (PARTITION BY component, gk ORDER BY tc DESC, tr DESC, length(coalesce(title, '')) DESC, k) AS w FROM g)
SELECT component, max(company) FILTER (WHERE w = 1) AS company, max(title) FILTER (WHERE w = 1) AS title, min(s) AS start, CASE WHEN count(f) = count(*) THEN max(f) END AS "end" FROM r GROUP BY component, gk""",
    "education_dedupe": f"""{_WITH}, d AS (SELECT component, 'State University ' || p % 3 AS institution, 2000 + k % 2 AS y, min(k) AS first FROM comp GROUP BY ALL)
SELECT component, CAST(row_number() OVER (PARTITION BY component ORDER BY first) - 1 AS INTEGER) AS pos, institution, CAST(y AS INTEGER) AS end_year FROM d""",
    "provenance_ledger": f"""{_WITH}, f AS (
  SELECT component, 'full_name' AS field, source, method FROM comp WHERE trim(name) <> '' UNION SELECT component, 'emails', source, method FROM comp WHERE trim(email) <> '' UNION SELECT component, 'phones', source, method FROM comp WHERE trim(phone) <> ''
  UNION SELECT component, 'skills', source, method FROM comp UNION SELECT component, 'experience.company', source, method FROM comp WHERE trim(current_company) <> '' UNION SELECT component, 'experience.title', source, method FROM comp WHERE trim(title) <> ''
  UNION SELECT component, 'experience.date_range', source, method FROM comp UNION SELECT component, 'education.institution', source, method FROM comp UNION SELECT component, 'education.year', source, method FROM comp
  UNION SELECT component, 'location.country', source, method FROM comp UNION SELECT component, 'location.city', source, method FROM comp WHERE trim(city) <> '' UNION SELECT component, 'location.region', source, method FROM comp WHERE trim(region) <> ''
  UNION SELECT component, 'links.github', source, method FROM comp WHERE github <> '' UNION SELECT component, 'links.linkedin', source, method FROM comp WHERE linkedin <> '' UNION SELECT component, 'links.portfolio', source, method FROM comp WHERE portfolio <> '')
SELECT component, CAST(row_number() OVER (PARTITION BY component ORDER BY field, source, method) - 1 AS INTEGER) AS pos, field, source, method FROM f""",
    "candidate_id": f"{_WITH} SELECT component, {_ID} AS candidate_id FROM comp GROUP BY component",
    "overall_confidence": f"""{_WITH}, {_NAMES}, {_BEST_NAME}, {_values("mail", "ek")}, {_values("phone", "e164")}, {_values("country", _PLACES["country"])}, {_best("country")},
c AS (SELECT component, 1 AS o, confidence FROM best UNION ALL SELECT component, 2, arg_min(confidence, value) FROM g_mail GROUP BY component UNION ALL SELECT component, 3, arg_min(confidence, value) FROM g_phone GROUP BY component UNION ALL SELECT component, 4, confidence FROM b_country)
SELECT a.component, coalesce(sum(confidence ORDER BY o) / count(confidence), 0.0::DOUBLE) AS overall_confidence FROM (SELECT DISTINCT component FROM comp) a LEFT JOIN c ON a.component = c.component GROUP BY a.component""",
    "project_paths": f"""{_WITH}, {_NAMES}, {_BEST_NAME}, m AS (SELECT component, min(ek) AS email, max(ek) AS last_email, coalesce(string_agg(DISTINCT {_SKILL_NAME}, '|' ORDER BY {_SKILL_NAME}) FILTER (WHERE skill <> 'Ninjutsu'), '') AS skills FROM comp GROUP BY component)
SELECT best.value AS name, email, last_email, skills, NULL::VARCHAR AS gone FROM m LEFT JOIN best ON m.component = best.component""",
    "validate_required": f"""{_WITH} SELECT component, concat_ws('; ', CASE WHEN max(nk) IS NULL THEN 'required field ''full_name'' is missing or null' END, CASE WHEN max(ek) IS NULL THEN 'required field ''mail'' is missing or null' END, 'field ''skills'': expected string, got list') AS errors FROM comp GROUP BY component""",
    "validate_canonical": f"{_WITH} SELECT DISTINCT component, CASE component % 6 WHEN 1 THEN 'phones: not E.164' WHEN 2 THEN 'location.country: not ISO 3166 alpha-2' WHEN 3 THEN 'experience: not YYYY-MM' WHEN 4 THEN 'education.end_year: not in 1900..2100' WHEN 5 THEN 'overall_confidence: not in 0..1' ELSE '' END AS errors FROM comp",
    "resume_parse": f"""WITH people AS ({_PEOPLE}) SELECT k AS record_idx, trim(name) AS name, 'Builder of things' AS headline, nullif(email, '') AS email, 'https://github.com/user' || p AS github,
  concat('Tools: ', trim(skill), '|Go|SQL') AS skills, nullif(trim(current_company), '') AS company, nullif(title, '') AS title, dates, 'Did this and that.' AS summary, 'B.S.' AS degree, 'Desig' AS field, 'State University' AS institution, '2016' AS year
FROM people WHERE trim(name) <> '' AND trim(current_company) <> '' AND title <> ''""",
}
