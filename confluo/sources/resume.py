"""Plain-text resumes: one partial record per document, by line-level queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from confluo.functions.text import WS, blank_to_null, strip
from confluo.schema import PARTIAL_EDUCATION, PARTIAL_EXPERIENCE, S, carrier, complete

SOURCE = "resume"
REGEX, FREE = ("regex", 0.75), ("free-text", 0.5)
#: Section headings in capitals (fixed values).
SECTIONS = {
    "SUMMARY": "summary", "SKILLS": "skills", "TECHNOLOGIES": "skills", "TECHNICAL SKILLS": "skills", "TOOLS": "skills", "FRAMEWORKS": "skills",
    "EXPERIENCE": "experience", "WORK EXPERIENCE": "experience", "EMPLOYMENT": "experience", "EDUCATION": "education", "ACADEMIC BACKGROUND": "education",
}
#: Patterns of the text format (fixed values).
EMAIL = r"[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}"
PHONE = r"(?U)(?:\+?\d{1,3}[\s.\-]?)?(?:\(?\d{2,4}\)?[\s.\-]?)?\d{3}[\s.\-]?\d{4}\b"
PHONE_INLINE = r"(?U)(?<!\w)(?:\+?\d{1,3}[\s.\-]?)?\(?\d{3}\)?[\s.\-]?\d{3}[\s.\-]?\d{4}(?!\w)"
PHONE_LABEL = r"(?iU)(?:Phone|Mobile|Tel|Cell(?:phone)?)\s*:?\s*([^|\n]+)"
NAME_LABEL = r"(?idU)Name\s*:?\s*(.+)"
PLACE_LABEL = r"(?iU)(?:Location|Address|Based in)\s*:?\s*([^|\n]+)"
PLACE_INLINE = r"(?U)\b([A-Za-z .\-]+,\s*[A-Za-z .\-]+(?:,\s*[A-Za-z .\-]+)?)\b"
GITHUB = r"(?i)(?:https?://)?(?:www\.)?github\.com/[A-Za-z0-9_\-]+/?"
LINKEDIN = r"(?i)(?:https?://)?(?:www\.)?linkedin\.com/in/[A-Za-z0-9_\-]+/?"
YEAR = r"(?U)\b(19|20)\d{2}\b"
DEGREE = r"(?iU)^(B\.?S\.?c?|M\.?S\.?c?|B\.?A\.?|M\.?A\.?|Ph\.?\s*D\.?|B\.?Eng|M\.?Eng|B\.?Tech|M\.?Tech|MBA)\b\.?"
LINES = r"\r\n|[\n\r\x0B\x0C\x1C-\x1E\x85  ]"


def _found(c: Column, pattern: str, group: int = 0) -> Column:
    return blank_to_null(F.regexp_extract(c, pattern, group))


def _value(c: Column, how: tuple[str, float]) -> Column:
    return carrier(c, SOURCE, how[1], how[0])


def section_lines(docs: DataFrame) -> DataFrame:
    """``record_idx, pos, line, section``: the lines of ``record_idx, text`` without the headings, each with the section it is in."""
    lines = docs.select("record_idx", F.posexplode(F.split("text", LINES)).alias("pos", "line"))
    heading = F.try_element_at(F.create_map(*[F.lit(x) for kv in SECTIONS.items() for x in kv]), F.upper(strip(F.col("line"))))
    w = Window.partitionBy("record_idx").orderBy("pos")
    marked = lines.withColumn("heading", heading).withColumn("section", F.coalesce(F.last("heading", True).over(w), F.lit("header")))
    return marked.where("heading is null").select("record_idx", "pos", "line", strip(F.col("line")).alias("text"), "section")


def _is_label(text: Column) -> Column:
    return F.endswith(text, F.lit(":")) & (F.size(F.split(text, rf"(?U){WS}+")) <= 3)


def header_fields(lines: DataFrame) -> DataFrame:
    """First lines that can be a name, a headline, a phone number or a place."""
    head = lines.where("section = 'header'")
    contact = F.contains("line", F.lit("@")) | F.col("line").rlike(PHONE_LABEL)
    plain = F.regexp_replace("line", EMAIL, " ")
    phone = strip(F.coalesce(_found(plain, PHONE_INLINE), _found(plain, PHONE)))
    place = F.when((F.col("pos") < 6) & ~contact, _found(F.col("line"), PLACE_INLINE, 1))
    name_pos = F.min(F.when(~contact & (F.col("text") != ""), F.col("pos"))).over(Window.partitionBy("record_idx"))
    head = head.select("record_idx", "pos", "text", phone.alias("phone"), place.alias("place"), (contact | F.col("line").rlike(GITHUB)).alias("linked"), name_pos.alias("name_pos"))
    first = lambda c, when: F.min_by(c, F.when(when, F.col("pos")))
    return head.groupBy("record_idx").agg(
        F.max(F.when(F.col("pos") == F.col("name_pos"), F.col("text"))).alias("first_name_line"),
        first("text", (F.col("pos") > F.col("name_pos")) & (F.col("text") != "") & ~F.col("linked")).alias("headline"),
        first("phone", F.col("phone").isNotNull()).alias("header_phone"),
        first("place", F.col("place").isNotNull()).alias("header_place"),
    )


def skill_tokens(lines: DataFrame) -> DataFrame:
    rows = lines.where((F.col("section") == "skills") & (F.col("text") != "") & ~_is_label(F.col("text")))
    tokens = F.filter(F.transform(F.split("text", r"[,;|/]"), lambda x: F.btrim(x, F.lit(" •-\t"))), lambda x: (x != "") & ~F.endswith(x, F.lit(":")))
    return rows.groupBy("record_idx").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("pos", tokens.alias("t")))), lambda x: x["t"])).alias("skills"))


def experience_items(lines: DataFrame) -> DataFrame:
    """Entries open at "company - title" lines without a year; a line with a year dates its entry, the last one counts; the rest is summary."""
    rows = lines.where((F.col("section") == "experience") & (F.col("text") != ""))
    dated = F.col("text").rlike(YEAR)
    opens = ~dated & F.contains("text", F.lit(" - "))
    rows = rows.withColumn("dated", dated).withColumn("opens", opens)
    rows = rows.withColumn("entry", F.sum(F.col("opens").cast("int")).over(Window.partitionBy("record_idx").orderBy("pos")))
    parts = F.split("title_line", " - ", 2)
    items = rows.groupBy("record_idx", "entry").agg(
        F.max(F.when(F.col("opens"), F.col("text"))).alias("title_line"),
        F.max_by("text", F.when(F.col("dated"), F.col("pos"))).alias("date_range"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when(~F.col("dated") & ~F.col("opens"), F.struct("pos", "text")))), lambda x: x["text"]), " ").alias("summary"),
    )
    item = F.struct(
        _value(blank_to_null(strip(parts[0])), FREE).alias("company"),
        _value(blank_to_null(strip(F.get(parts, F.lit(1)))), FREE).alias("title"),
        _value(F.col("date_range"), FREE).alias("date_range"),
        _value(blank_to_null(strip(F.col("summary"))), FREE).alias("summary"),
    )
    return items.groupBy("record_idx").agg(F.transform(F.array_sort(F.collect_list(F.struct("entry", item.alias("item")))), lambda x: x["item"]).alias("experience"))


def education_items(lines: DataFrame) -> DataFrame:
    """Blocks end at blank lines, labels and lines that begin with a degree; a block reads degree and field, institution, year."""
    rows = lines.where("section = 'education'")
    gap = (F.col("text") == "") | _is_label(F.col("text"))
    rows = rows.withColumn("gap", gap).withColumn("block", F.sum((F.col("gap") | F.col("text").rlike(DEGREE)).cast("int")).over(Window.partitionBy("record_idx").orderBy("pos")))
    blocks = rows.where("not gap").groupBy("record_idx", "block").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "text"))), lambda x: x["text"]), " ").alias("line"))
    parts = F.filter(F.transform(F.split("line", ","), strip), lambda x: (x != "") & ~x.rlike(r"(?U)^\b(19|20)\d{2}\b$"))
    blocks = blocks.withColumn("parts", parts).withColumn("study", F.get("parts", F.lit(0)))
    degree = F.regexp_extract("study", DEGREE, 0)
    rest = F.btrim(F.substr("study", F.length(degree) + 1), F.lit(" ,in"))
    item = F.struct(
        _value(F.when(F.size("parts") >= 2, F.array_join(F.slice("parts", F.lit(2), F.size("parts")), ", ")), FREE).alias("institution"),
        _value(F.when(degree != "", strip(degree)), FREE).alias("degree"),
        _value(F.when(degree != "", blank_to_null(rest)).otherwise(F.col("study")), FREE).alias("field"),
        _value(_found(F.col("line"), YEAR), FREE).alias("year"),
    )
    return blocks.groupBy("record_idx").agg(F.transform(F.array_sort(F.collect_list(F.struct("block", item.alias("item")))), lambda x: x["item"]).alias("education"))


def parse_resumes(docs: DataFrame) -> DataFrame:
    """Partial records of ``record_idx, text``, one for each row; null, empty and unreadable texts give empty records."""
    docs = docs.select(F.col("record_idx").cast("long").alias("record_idx"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    lines = section_lines(docs)
    rows = docs
    for part in (header_fields(lines), skill_tokens(lines), experience_items(lines), education_items(lines)):
        rows = rows.join(part, "record_idx", "left")
    text = F.col("text")
    labelled = blank_to_null(strip(F.regexp_extract(text, NAME_LABEL, 1)))
    segment = strip(F.regexp_extract(text, PHONE_LABEL, 1))
    phone = F.coalesce(F.when(segment != "", strip(F.coalesce(_found(segment, PHONE), _found(segment, PHONE_INLINE)))), F.col("header_phone"))
    place = strip(F.coalesce(blank_to_null(strip(F.regexp_extract(text, PLACE_LABEL, 1))), F.col("header_place")))
    places = F.filter(F.transform(F.split(place, ","), strip), lambda x: x != "")
    link = lambda pattern: _value(F.rtrim(_found(text, pattern), F.lit("/")), REGEX)
    none = F.lit(None).cast(S)
    return rows.select(
        *complete(
            {
                "record_idx": F.col("record_idx"),
                "source": F.lit(SOURCE),
                "full_name": F.coalesce(_value(labelled, REGEX), _value(F.col("first_name_line"), FREE)),
                "headline": F.when(labelled.isNull(), _value(F.col("headline"), FREE)),
                "emails": F.transform(F.regexp_extract_all(text, F.lit(EMAIL), 0), lambda x: _value(x, REGEX)),
                "phones": F.array_compact(F.array(_value(blank_to_null(phone), REGEX))),
                "links": F.struct(link(LINKEDIN).alias("linkedin"), link(GITHUB).alias("github"), none.alias("portfolio"), F.array().cast(f"array<{S}>").alias("other")),
                "location": F.struct(_value(F.get(places, F.lit(0)), REGEX).alias("city"), _value(F.get(places, F.lit(1)), REGEX).alias("region"), _value(F.get(places, F.lit(2)), REGEX).alias("country")),
                "skills": F.transform(F.coalesce("skills", F.array().cast("array<string>")), lambda x: _value(x, REGEX)),
                "experience": F.coalesce("experience", F.array().cast(f"array<{PARTIAL_EXPERIENCE}>")),
                "education": F.coalesce("education", F.array().cast(f"array<{PARTIAL_EDUCATION}>")),
            }
        )
    )


def read_resumes(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Partial records of text files, one for each, numbered in the order of their paths."""
    files = spark.read.text(paths, wholetext=True).select(F.col("value").alias("text"), F.col("_metadata.file_path").alias("path"))
    # a range sort and a running count: no single task sees all files' texts
    order = files.select("path").distinct().orderBy("path")
    numbered = order.select("path", F.monotonically_increasing_id().alias("record_idx"))
    return parse_resumes(files.join(numbered, "path").select("record_idx", "text"))


def load_text(path_or_text: str) -> str:
    """The text itself, or that of the file it names (one line of at most 260 characters); unreadable files are empty."""
    from pathlib import Path

    if "\n" not in path_or_text and len(path_or_text) <= 260:
        try:
            if Path(path_or_text).is_file():
                return Path(path_or_text).read_text(encoding="utf-8", errors="replace")
        except OSError:
            return path_or_text
    return path_or_text
