"""The stages, run one after the other over small tables, against brute force."""

import random

import corpus_pipeline
from pyspark.sql import functions as F

from confluo.llm.sentencepiece_lattice import decode, default_model
from tests.llm import helpers as h


COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def write(spark, path, rows, items, labels):
    spark.createDataFrame(rows, COLUMNS).repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")


def test_pipeline(spark, tmp_path):
    """All stages after the classifier against brute force: prose with copies, null, empty, blank and long texts, repeated rows."""
    docs = h.documents(seed=4)
    r = random.Random(9)
    bad = {1000 + i: " ".join(f"BUY{r.randint(0, 99)}!!!" for _ in range(40)) for i in range(40)}
    items = [(1, " ".join(docs[11].split()[1:20])), (2, "nowhere to be found at all in any of these texts"), (None, None)]
    rows = [(i, t, "en", f"s{i % 3}", None if t is None else len(t)) for i, t in (docs | bad).items()]
    write(spark, tmp_path, rows + [x for x in rows if x[0] in (1, 2, 201)], items, [(i, int(i < 1000), 0) for i in (*docs, *bad) if i % 5])
    kept = {x.doc_id: x.text for x in corpus_pipeline.quality(spark, spark.read.parquet(f"{tmp_path}/documents.parquet"), str(tmp_path)).collect()}
    assert not set(kept) & set(bad) and {i for i in docs if i < 100} <= set(kept)
    got = corpus_pipeline.run(spark, str(tmp_path)).select("doc_id", "n_tokens", decode(F.col("ids"), default_model(spark)).alias("text")).collect()

    key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate(h.ASCII_LOWER)
    holders = {}
    for i, t in kept.items():
        for k in {key(x) for x in (t or "").split("\n")}:
            holders.setdefault(k, []).append(i)
    drop = {k: max(v) for k, v in holders.items() if len(k) >= 20 and len(v) >= 3}
    kept = {i: "\n".join(x for x in (t or "").split("\n") if drop.get(key(x), i) == i) for i, t in kept.items()}
    sets = {i: {tuple(w[j : j + 5]) for j in range(max(len(w) - 4, 1))} if (w := t.translate(h.ASCII_LOWER).split()) else set() for i, t in kept.items()}
    group = h.components(kept, lambda a, b: bool(sets[a] | sets[b]) and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.8)
    kept = {i: t for i, t in kept.items() if group[i] == i}
    hit = h.decontaminate(kept, items)
    want = {i: t for i, t in kept.items() if not hit[i][1]}
    assert {x.doc_id: x.text for x in got} == want and all(x.n_tokens == 0 for x in got if not x.text)
    assert len(got) == len(want) + len({1, 2, 201} & set(want))
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "lines", "near_copies", "decontaminate", "pieces"]


def test_pipeline_of_nothing(spark, tmp_path):
    write(spark, tmp_path, [], [], [])
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_near_copies_by_fingerprint(spark):
    """Texts whose fingerprints are within 3 bits go, copies and chains included, whatever part of their five-word shingles they share; repeats, and texts without words, stay."""
    r = random.Random(5)
    docs = {}
    for g in range(8):
        passage = " ".join(f"g{g}p{x}" for x in range(20))
        for k in range(5):  # a common passage a hundred times, and as many words again that differ as keep the sets far apart
            docs[10 * g + k] = " ".join([*(f"g{g}k{k}w{r.randint(0, 999)}" for _ in range(60)), *[passage] * 100])
        docs[10 * g + 5] = docs[10 * g + 3]
    docs |= {100: "", 101: None, 102: "one", 103: "two words"}
    fp, _ = h.simhash(docs)
    sets = {i: {tuple(w[j : j + 5]) for j in range(max(len(w) - 4, 1))} if (w := (t or "").split()) else set() for i, t in docs.items()}
    alike = lambda a, b: len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])
    near = lambda a, b: bool(sets[a] and sets[b]) and ((fp[a] ^ fp[b]).bit_count() <= 3 or alike(a, b))
    assert any(near(a, b) and not alike(a, b) for a in docs for b in docs)
    group = h.components(docs, near)
    rows = [(i, t, "en", "s", None if t is None else len(t)) for i, t in docs.items()]
    for more in ([], [x for x in rows if x[0] in (0, 3, 102)]):
        got = corpus_pipeline.near_copies(spark, spark.createDataFrame(rows + more, COLUMNS).repartition(3), "").collect()
        want = [i for i in [*docs, *(x[0] for x in more)] if group[i] == i]
        assert sorted(x.doc_id for x in got) == sorted(want)
