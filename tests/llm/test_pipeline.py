"""The pipeline's stages on a small corpus with planted rows, against plain versions of each."""

import random

import pytest

import corpus_pipeline
from galefold.llm import decontamination, quality, secrets, simhash
from galefold.llm.common import saved


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rng = random.Random(12)
    word = lambda: rng.choice(["ka", "re", "tho", "min", "sel", "var"]) + rng.choice(["do", "ra", "lin", "", "mo"]) + rng.choice(["s", "", "ne", "t"])
    item = " ".join(f"q{rng.randrange(10**6)}" for _ in range(30))
    rows, truth = [], {}
    for k in range(240):
        text = " ".join(word() + f"{k % 7}{rng.randrange(50)}"[: rng.randrange(3)] for _ in range(rng.randint(60, 150)))
        kind = {0: "junk", 1: "leak", 2: "secret"}.get(k % 12, "clean")
        if kind == "junk":
            text = " ".join(w + rng.choice(["###", "%%%", "$$$"]) for w in text.split())
        elif kind == "leak":
            text = text[:100] + " " + item + " " + text[100:]
        elif kind == "secret":
            text += f' token = "{rng.getrandbits(160):040x}" 4785380592391139 a.19@mail5.example.com'
        rows.append((k, text, "en", "src", len(text)))
        truth[k] = kind
    for k in range(240, 270):  # exact and near copies of clean rows
        own = rows[(k - 240) * 8 % 240 + 3 if truth[(k - 240) * 8 % 240 + 3] == "clean" else 3][1].split()
        if k % 2:
            own[len(own) // 2] = "changed"
        rows.append((k, " ".join(own), "en", "src", 1))
        truth[k] = "copy"
    folder = tmp_path_factory.mktemp("sf")
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(d, 0 if t == "junk" else 1, 0) for d, t in truth.items()], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return f"file://{folder}", truth


def test_stages(spark, corpus):
    folder, truth = corpus
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, left = docs.columns, [docs]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = saved(stage(spark, docs, folder), name)
        assert docs.columns == columns
        left.append(docs)
    ids = [{r.doc_id for r in d.collect()} for d in left]
    kinds = lambda gone: {truth[d] for d in gone}
    assert kinds(ids[0] - ids[1]) == {"junk"} and len(ids[0] - ids[1]) >= 18
    assert kinds(ids[1] - ids[2]) == {"copy"} and len(ids[1] - ids[2]) == 30
    assert kinds(ids[2] - ids[3]) == {"leak"} and {d for d, t in truth.items() if t == "leak"} <= ids[2] - ids[3]
    assert ids[3] == ids[4]
    for r in left[4].collect():
        assert 'token = "[SECRET]"' in r.text if truth[r.doc_id] == "secret" else "[SECRET]" not in r.text
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, folder)
    assert {r.doc_id for r in packed.select("doc_id").collect()} == ids[4]
    assert {r.doc_id for r in corpus_pipeline.run(spark, folder).select("doc_id").collect()} == ids[4]


def test_stages_on_odd_rows(spark, corpus, messy, nothing):
    folder, _ = corpus
    for docs in (messy, nothing):
        columns = docs.columns
        for name, stage in corpus_pipeline.STAGES[:-1]:
            docs = saved(stage(spark, docs, folder), name)
            assert docs.columns == columns
        corpus_pipeline.STAGES[-1][1](spark, docs, folder).count()


def test_filters_leave_what_their_operators_pass(spark, corpus):
    folder, _ = corpus
    docs, labels, items = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels", "benchmark"))
    passed = {r.doc_id for r in quality.quality_scores(docs, labels).where("predicted = 1").collect()}
    assert {r.doc_id for r in quality.keep_good(docs, labels).collect()} == passed
    found = {r.doc_id for r in decontamination.overlaps(docs, items).collect()}
    assert {r.doc_id for r in decontamination.clean(docs, items).collect()} == {r.doc_id for r in docs.collect()} - found


def test_sides_that_spark_sizes_too_low_are_not_broadcast(spark, corpus, monkeypatch):
    """Joins of exploded codes, of tiles and of items' repeated texts sort both sides, however small their files are; what is exploded elsewhere is a table first."""
    folder, _ = corpus
    docs, plans = spark.read.parquet(f"{folder}/documents.parquet"), {}

    def noted(df, label):
        plans.setdefault(label, df._jdf.queryExecution().executedPlan().toString())
        return saved(df, label)

    for module in (simhash, quality, decontamination, secrets):
        monkeypatch.setattr(module, "saved", noted)
    quality.keep_good(docs, spark.read.parquet(f"{folder}/labels.parquet"))
    simhash.keep_one(docs)
    decontamination.clean(docs, spark.read.parquet(f"{folder}/benchmark.parquet"))
    secrets.redact(docs)
    for label in ("learnt", "groups", "found", "members", "shingles", "links", "go", "overlaps"):
        assert "SortMergeJoin" in plans[label] and "BroadcastHashJoin" not in plans[label], label
    assert "Generate explode" not in plans["pairs"] + plans["covered"]
