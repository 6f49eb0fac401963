import json

import pytest
from pyspark.sql import functions as F

from confluo.operators.components import connected_components
from confluo.operators.fusion import candidate_ids
from confluo.operators import linkage
from confluo.operators.linkage import block_pairs, cluster, name_block_keys, record_keys
from confluo.plans.cli import main
from confluo.plans.merge import merge
from confluo.plans.projection import ConfigError, ProjectionError, load_config, parse_path, project_rows
from confluo.plans.validation import ProjectedValidationError, assert_valid_projected, canonical_errors, projection_errors, validate_projected
from confluo.sources.combine import combine
from confluo.sources.recruiter_csv import empty_partials, from_rows, read_csv
from confluo.sources.resume import parse_resumes
from confluo.storage import materialize, spread

CSV = """title,email,name,phone,current_company
Lead Chemist,runa.holmberg@mail.test,Runa Holmberg,+91 98123 45678,Alder Corp
Chemist,RUNA.holmberg@mail.test ,Runa Holmberg,98123-45678,Alder Corporation
Chemist,,R. Holmberg,9812345678,Alder Corporation
Pilot,tarek.moor@mail.test,Tarek Moor,call me,Heron
Navigator,t.moor9@mail.test,Tarek Moor,,Heron
"""
RESUME = "Runa Holmberg\nHead of Glazes, Kilns\nMail: runa.holmberg@mail.test or call +91 981 234 5678, https://github.com/runah/\n\nSKILLS\nk8s, py; Glassblowing\nEXPERIENCE\nAlder Corporation - Head of Glazes\nFeb 2020 - Apr 2022\n  Fired pots.\n\nIbex LLC - Potter\n2015 - 2017\nEDUCATION\nM.S. Ceramics, Porto Academy, Annex, 2014\n"
SAID = ("Alder Corporation", "Head of Glazes", "Feb 2020 - Apr 2022"), ("Ibex LLC", "Potter", "2015 - 2017")


@pytest.fixture(scope="session")
def sample(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("in")
    (folder / "a.csv").write_text("﻿" + CSV, encoding="utf-8")
    (folder / "r.txt").write_text(RESUME, encoding="utf-8")
    return folder


@pytest.fixture(scope="session")
def canonical(spark, sample):
    parts = combine(spark, [read_csv(spark, str(sample / "a.csv")), parse_resumes(spark.createDataFrame([(0, RESUME)], "record_idx long, text string"))])
    return materialize(merge(materialize(parts)))


def test_resume(spark):
    r = parse_resumes(spark.createDataFrame([(0, RESUME), (1, None), (2, "")], "record_idx long, text string")).orderBy("record_idx").collect()
    assert r[0].full_name.value == "Runa Holmberg" and r[0].headline.value == "Head of Glazes, Kilns"
    assert [p.value for p in r[0].phones] == ["+91 981 234 5678"] and r[0].links.github.value == "https://github.com/runah"
    assert [s.value for s in r[0].skills] == ["k8s", "py", "Glassblowing"]
    assert tuple((e.company.value, e.title.value, e.date_range.value) for e in r[0].experience) == SAID
    study = r[0].education[0]
    assert (study.degree.value, study.field.value, study.institution.value, study.year.value) == ("M.S.", "Ceramics", "Porto Academy, Annex", "2014")
    assert r[1].full_name is None and r[1].skills == [] and r[2].emails == []


def test_resume_many_parts(spark):
    school = ", ".join(f"part{i}" for i in range(1500))
    r = parse_resumes(spark.createDataFrame([(0, f"Ann Lee\nEDUCATION\nB.S. Art, {school}, 2001\n")], "record_idx long, text string")).first()
    assert r.education[0].institution.value == school


def test_csv(spark, sample, tmp_path):
    assert [r.full_name.value for r in read_csv(spark, str(sample / "a.csv")).orderBy("record_idx").collect()] == ["Runa Holmberg", "Runa Holmberg", "R. Holmberg", "Tarek Moor", "Tarek Moor"]
    (tmp_path / "empty.csv").write_text("")
    assert read_csv(spark, str(tmp_path / "empty.csv")).count() == 0
    assert read_csv(spark, str(tmp_path / "none.csv")).count() == 0


def test_csv_headers(spark, tmp_path):
    """Names with numbers are columns of their own; of repeated names the last one counts."""
    (tmp_path / "n.csv").write_text("\ufeffphone,phone2,email,name,name,title1\n8492948175,call me,a@b.c,First,Last,x\n1,2\n", encoding="utf-8")
    r = read_csv(spark, str(tmp_path / "n.csv")).orderBy("record_idx").collect()
    assert [p.value for p in r[0].phones] == ["8492948175"] and r[0].full_name.value == "Last" and r[0].experience == []
    assert [p.value for p in r[1].phones] == ["1"] and r[1].full_name is None


def test_merge(canonical):
    rows = canonical.orderBy("component").collect()
    assert len(rows) == 3
    runa = rows[0]
    assert [e.value for e in runa.emails] == ["runa.holmberg@mail.test"] and [p.value for p in runa.phones] == ["+919812345678"]
    assert [s.name for s in runa.skills] == ["Kubernetes", "Python"]
    assert (runa.experience[0].company, runa.experience[0].title, runa.experience[0].start, runa.experience[0].end) == ("Alder Corporation", "Lead Chemist", "2020-02", None)
    assert runa.candidate_id.value.startswith("cand_") and len(runa.candidate_id.value) == 21
    assert [p for p in runa.provenance] == sorted(runa.provenance)
    assert all(0 <= r.overall_confidence <= 1 for r in rows)


def test_merge_of_shuffled_records(spark, sample, canonical):
    """Records in another order give the same people; only the order of jobs and studies may differ."""
    parts = combine(spark, [read_csv(spark, str(sample / "a.csv")), parse_resumes(spark.createDataFrame([(0, RESUME)], "record_idx long, text string"))])
    turned = merge(materialize(parts.withColumn("record_idx", 100 - F.col("record_idx"))))
    plain = lambda df: sorted(json.dumps([sorted(v, key=str) if k in ("experience", "education") else v for k, v in r.asDict(True).items() if k != "component"], default=str) for r in df.collect())
    assert plain(turned) == plain(canonical)


def test_cluster_bounds(spark):
    """Five names, sixty records each with e-mails of their own: none are joined, and pairs stay within their blocks."""
    names = ["Ilka Stolma", "Nuno Grauski", "Odile Felsova", "Pavel Mooren", "Wanda Quistel"]
    rows = spark.createDataFrame([(i, names[i % 5], f"user{i}@host{i}.test") for i in range(300)], "i long, name string, email string")
    found = cluster(materialize(from_rows(rows, F.col("i")))).select("component").distinct().count()
    assert found == 300
    pairs = block_pairs(record_keys(from_rows(rows, F.col("i"))).withColumn("lo", F.col("idx")).withColumn("hi", F.col("idx")), name_block_keys()).count()
    assert pairs == 5 * 60 * 59 // 2
    shared = rows.where("i < 200").withColumn("email", F.concat(F.lit("team"), (F.col("i") % 4).cast("string"), F.lit("@x.test"))).withColumn("name", F.element_at(F.array(*[F.lit(n) for n in names]), (F.col("i") % 4).cast("int") + 1))
    assert cluster(materialize(from_rows(shared, F.col("i")))).select("component").distinct().count() == 4


def test_block_pairs(spark, monkeypatch):
    """All pairs of blocks that overlap in many ways, each once, also where blocks take many lists and deals; no keys travel with the pairs."""
    monkeypatch.setattr(linkage, "_LIST", 5)
    monkeypatch.setattr(linkage, "_LISTS", 2)
    data = [(i, ["a"] * (i % 4 > 0) + [f"b{i % 3}"] * (i % 5 > 0) + [f"c{i % 7}", f"d{i % 11}"]) for i in range(90)]
    got = block_pairs(spark.createDataFrame(data, "idx long, ks array<string>"), F.col("ks"))
    assert got.columns == ["a", "b"]
    want = sorted((i, j) for i, x in data for j, y in data if i < j and set(x) & set(y))
    assert sorted(tuple(r) for r in got.collect()) == want


def test_cluster_edges_of_one_name(spark):
    """2,000 records of one name are linked by a few edges each, not by two million pairs; conflicts count as they would pair by pair."""
    rows = spark.range(2000).selectExpr("id AS i", "'Ilka Stolma' AS name", "CASE WHEN id % 10 > 0 THEN concat('u', id, '@h', id, '.test') END AS email")
    sigs = materialize(linkage.signatures(record_keys(from_rows(rows, F.col("i")))))
    assert linkage.name_edges(sigs, linkage.similar_names(sigs)).count() < 3 * 2000
    assert cluster(materialize(from_rows(rows, F.col("i")))).select("component").distinct().count() == 1


def test_name_edges(spark):
    """The same components as all pairs of similar names that are not in conflict, for random records; the ratio of two names depends on their order."""
    import random
    from difflib import SequenceMatcher

    rng = random.Random(5)
    names = ["ann marie stolm", "ann marei stolm", "anne marie stolm", "ann mari stolmo", "nuno grauski"]
    for _ in range(2):
        data = [(i, False, rng.choice(names), [f"m{rng.randrange(9)}"] * (rng.random() < 0.7), [f"p{rng.randrange(9)}"] * (rng.random() < 0.7)) for i in rng.sample(range(100), 14)]
        sigs = spark.createDataFrame([(*r, [], [], [], r[0], r[0]) for r in data], "idx long, resume boolean, name string, emails array<string>, profiles array<string>, phones array<string>, companies array<string>, titles array<string>, lo long, hi long")
        strong = linkage.strong_edges(sigs)
        got = dict(connected_components(strong.unionByName(linkage.name_edges(sigs.drop("idx"), linkage.similar_names(sigs)))).collect())
        root = {r[0]: r[0] for r in data}
        for a in data:
            for b in data:
                apart = any(a[k] and b[k] and a[k] != b[k] for k in (3, 4))
                alike = a[2] == b[2] or SequenceMatcher(None, a[2], b[2]).ratio() >= 0.9
                if a[0] < b[0] and (alike and not apart or a[3] and a[3] == b[3] or a[4] and a[4] == b[4]):
                    x, y = root[a[0]], root[b[0]]
                    root = {k: min(x, y) if v in (x, y) else v for k, v in root.items()}
        assert {k: got.get(k, k) for k in root} == root


def test_merge_of_nothing(spark):
    assert merge(empty_partials(spark)).count() == 0


def test_conflict_keeps_apart(spark):
    rows = spark.createDataFrame([(0, "John Smith", "a@x.org"), (1, "John Smith", "b@y.org"), (2, "John Smith", None)], "i long, name string, email string")
    got = dict(cluster(materialize(from_rows(rows, F.col("i")))).select("record_idx", "component").collect())
    assert got == {0: 0, 1: 0, 2: 0}  # the third record has no e-mail and joins both
    got = dict(cluster(materialize(from_rows(rows.where("i < 2"), F.col("i")))).select("record_idx", "component").collect())
    assert got == {0: 0, 1: 1}


def test_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (7, 7), (None, 3)], "src long, dst long")
    got = dict(connected_components(edges).collect())
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100}


def test_components_stay_out_of_the_driver(spark, monkeypatch):
    """No join of a round may become a broadcast, however small its minima look."""
    from confluo.operators import components

    plans = []
    monkeypatch.setattr(components, "materialize", lambda df: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or materialize(df))
    connected_components(spark.createDataFrame([(0, 1), (1, 2)], "src long, dst long")).count()
    assert len(plans) > 1 and all(p.count("strategy=merge") == p.count("Join ") > 0 for p in plans[1:])


def test_rows_of_a_task(spark):
    """Candidate ids make no row for each value, and what a task fuses does not grow with the files that hold it."""
    members = empty_partials(spark).withColumn("component", F.lit(0).cast("long"))
    assert "Generate" not in candidate_ids(members)._jdf.queryExecution().optimizedPlan().toString()
    assert spread(spark.range(0, 20_000, 1, 1), "id").rdd.getNumPartitions() == 5


def test_paths():
    assert parse_path("skills[].name") == ["skills", None, "name"]
    assert parse_path("emails[-1]") == ["emails", -1] and parse_path("..a[0][]x.b c.[2]") == ["a", 0, None, "b", 2] and parse_path("a[1.5]") == ["a"] and parse_path("") == []
    with pytest.raises(ProjectionError):
        parse_path("a[x]")


def test_projection(canonical):
    config = load_config({"fields": [{"path": "name", "from": "full_name"}, {"path": "c.mail", "from": "emails[0]"}, {"path": "skills", "from": "skills[].name", "normalize": "canonical"}, {"path": "phone", "from": "phones[5]"}], "include_confidence": True, "on_missing": "omit"})
    rows = [r for _, r in project_rows(canonical, config)]
    assert all("phone" not in r and list(r)[0] == "name" for r in rows)
    assert {r["c"]["mail"]["value"] for r in rows} == {"runa.holmberg@mail.test", "tarek.moor@mail.test", "t.moor9@mail.test"}
    with pytest.raises(ProjectionError):
        list(project_rows(canonical, load_config({"fields": [{"path": "phones[5]", "required": True}]})))
    with pytest.raises(ConfigError):
        load_config({"fields": [], "oops": 1})


def test_validation(canonical):
    config = load_config({"fields": [{"path": "full_name", "type": "array", "required": True}, {"path": "headline", "required": True}]})
    assert validate_projected({"full_name": "x", "headline": None}, config) == ["field 'full_name': expected array, got str", "required field 'headline' is missing or null"]
    with pytest.raises(ProjectedValidationError):
        assert_valid_projected({}, config)
    got = sorted(projection_errors(canonical, config).select(F.size("errors")).collect())
    assert [r[0] for r in got] == [1, 2, 2]
    assert canonical_errors(canonical).where(F.size("errors") > 0).count() == 0


def test_cli(spark, sample, tmp_path, capsys):
    assert main([], spark) == 2
    assert main(["--csv", str(tmp_path / "no.csv")], spark) == 1
    (tmp_path / "bad.json").write_text("{")
    assert main(["--csv", str(sample / "a.csv"), "--config", str(tmp_path / "bad.json")], spark) == 1
    out = tmp_path / "out.json"
    assert main(["--csv", str(sample / "a.csv"), "--resume", str(tmp_path / "no.txt"), "--out", str(out)], spark) == 0
    assert len(json.loads(out.read_text())) == 3
    lines = tmp_path / "lines"
    assert main(["--csv", str(sample / "a.csv"), "--lines", str(lines)], spark) == 0
    key = lambda x: json.dumps(x, sort_keys=True)
    assert sorted((json.loads(r.value) for r in spark.read.text(str(lines)).collect()), key=key) == sorted(json.loads(out.read_text()), key=key)
    strict = tmp_path / "strict.json"
    strict.write_text('{"fields": [{"path": "phones[5]", "required": true}]}')
    assert main(["--csv", str(sample / "a.csv"), "--config", str(strict), "--lines", str(tmp_path / "none")], spark) == 1
