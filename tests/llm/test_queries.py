"""The registered queries on the smallest tables, against SQL where there is some; the pipeline stage by stage."""

import random

import duckdb
import pytest

import corpus_pipeline
from mosaicore.llm import common, decontaminate, toxicity
from mosaicore.llm.queries import ORACLE_SQL, QUERIES
from tests.conftest import SF


@pytest.fixture(scope="session")
def tables():
    con = duckdb.connect()
    for t in ("documents", "benchmark", "conversations", "labels", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_against_sql(spark, tables, name):
    got = QUERIES[name](spark, SF)
    want = tables.sql(ORACLE_SQL[name])
    names = sorted(got.columns)
    assert sorted(want.columns) == names
    rows = lambda columns, found: sorted(tuple(str(dict(zip(columns, r))[n]) for n in names) for r in found)
    assert rows(got.columns, got.collect()) == rows(want.columns, want.fetchall())


def test_every_operator_has_a_query():
    assert [int(n[2:].split("_")[0]) for n in QUERIES] == list(range(1, 11))


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    seen = [docs.count()]
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, SF)
        if k < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == docs.columns and out.dtypes == docs.dtypes
        before, docs = docs, corpus_pipeline.written(out, name)
        seen.append(docs.count())
        if name == "toxicity":
            model = toxicity.fit(before, spark.read.parquet(f"{SF}/labels.parquet"))
            assert {r.doc_id for r in toxicity.score(before, model).where("score < 0.5").collect()} == {r.doc_id for r in docs.collect()}
        if name == "decontamination":
            bad = decontaminate.contamination(docs, spark.read.parquet(f"{SF}/benchmark.parquet")).where("contaminated").count()
            assert bad == 0
    assert seen[0] > seen[1] > seen[2] >= seen[3] == seen[4]
    assert {r.doc_id for r in docs.select("doc_id").distinct().collect()} == {r.doc_id for r in before.select("doc_id").collect()}
    assert corpus_pipeline.ORACLE_SQL is None


def test_pipeline_keeps_odd_columns(spark, odd_docs):
    docs = odd_docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = corpus_pipeline.written(stage(spark, docs, SF), name)
        assert out.columns == odd_docs.columns
        docs = out
    assert corpus_pipeline.STAGES[-1][1](spark, docs, SF).count() > 0


def test_stages_drop_planted_copies_and_passages(spark):
    rng = random.Random(21)
    words = ["".join(rng.choice("abcdefghiklmnoprstuv") for _ in range(rng.randrange(2, 9))) for _ in range(400)]
    prose = lambda n: " ".join(rng.choice(words) for _ in range(n))
    items = {r.item_id: r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()}
    clean = [prose(rng.randrange(60, 400)) for _ in range(40)]
    near = []
    for text in clean[:20]:  # one word in forty is another one
        own = text.split()
        for k in range(0, len(own), 40):
            own[k] = rng.choice(words)
        near.append(" ".join(own))
    leaked = [f"{prose(2500)} {text} {prose(2500)}" for text in list(items.values())[:20]]
    texts = clean + near + clean[:10] + leaked
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    stages = dict(corpus_pipeline.STAGES)
    once = stages["near_duplicates"](spark, docs, SF)
    left = {r.doc_id for r in once.collect()}
    assert left >= set(range(40)) and len(left & set(range(40, 60))) <= 2 and not left & set(range(60, 70))
    kept = {r.doc_id for r in stages["decontamination"](spark, docs, SF).collect()}
    assert kept == set(range(70))


def test_a_run_leaves_its_result_alone(spark, monkeypatch):
    stages = [("first", lambda spark, docs, sf_dir: common.written(docs.limit(9), "between").where("doc_id is not null")), ("last", lambda spark, docs, sf_dir: docs.select("doc_id"))]
    monkeypatch.setattr(corpus_pipeline, "STAGES", stages)
    before = set(common.tables_since())
    assert corpus_pipeline.run(spark, SF).count() == 9
    made = set(common.tables_since()) - before
    assert len(made) == 1 and "stage-last" in made.pop()
