"""The pipeline's stages against brute force on the stages' own inputs."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as pipeline
from tests.llm.test_dedup import brute_components
from tests.llm.test_packing import check
from tests.llm.test_passages import brute_passages

DIR = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def outputs(spark, tmp_path_factory):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    out = [docs]
    for k, (_, stage) in enumerate(pipeline.STAGES):
        path = str(tmp_path_factory.mktemp("stages") / str(k))
        stage(spark, docs, DIR).write.parquet(path)
        docs = spark.read.parquet(path)
        out.append(docs)
    return out


def test_filters_keep_columns_and_clean_rows(spark, outputs):
    labels = {r.doc_id: r for r in spark.read.parquet(f"{DIR}/labels.parquet").collect()}
    before, tox, good = outputs[:3]
    assert before.columns == tox.columns == good.columns
    kept, ids = {r.doc_id for r in tox.collect()}, {r.doc_id for r in good.collect()}
    clean = [i for i, r in labels.items() if not r.toxic]
    assert sum(i in kept for i in clean) / len(clean) > 0.98
    assert ids <= kept
    fine = [i for i, r in labels.items() if i in kept and r.quality]
    assert sum(i in ids for i in fine) / len(fine) > 0.97


def test_near_dedup_stage(outputs):
    before, after = ([(r.doc_id, r.text) for r in outputs[k].collect()] for k in (2, 3))
    want = {i for i, (_, root) in brute_components(before, 5).items() if i == root}
    assert {i for i, _ in after} == want and dict(after).items() <= dict(before).items()


def test_substring_stage(outputs):
    before = [(r.doc_id, r.text) for r in outputs[3].collect()]
    after = {r.doc_id: (r.text, r.n_chars) for r in outputs[4].collect()}
    assert {i: t.lower().split() for i, (t, _) in after.items()} == brute_passages(before)
    assert all(n == len(t) for t, n in after.values())


def test_packing_stage(outputs):
    assert check(outputs[5].collect(), {r.doc_id: r.text for r in outputs[4].collect()}) < 0.02


def test_odd_rows(spark, tmp_path):
    labels = str(tmp_path / "labels.parquet")
    spark.read.parquet(f"{DIR}/labels.parquet").write.parquet(labels)
    fine = spark.read.parquet(f"{DIR}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars")
    odd = spark.createDataFrame([(None, None, None, None, None), (-5, "", "en", "s", 0), (-6, None, "en", "s", None)], fine.schema)
    docs = fine.union(odd).union(fine.limit(3)).withColumn("kept", F.lit("mine"))
    for _, stage in pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns
    assert docs.join(pipeline.near_dedup(spark, docs, str(tmp_path)), "doc_id", "left_semi").where("doc_id < 0").count() == 2
    got = pipeline.near_dedup(spark, docs, str(tmp_path)).groupBy("doc_id").count().where("count > 1").count()
    assert got == 0


def test_empty_table_and_very_long_text(spark, tmp_path):
    """No rows give no rows; a text of 20,000 words goes through every stage whole."""
    spark.read.parquet(f"{DIR}/labels.parquet").write.parquet(str(tmp_path / "labels.parquet"))
    fine = spark.read.parquet(f"{DIR}/documents.parquet")
    empty = fine.limit(0)
    for _, stage in pipeline.STAGES:
        assert stage(spark, empty, str(tmp_path)).count() == 0
    words = " ".join(r.text for r in fine.where("lang = 'en'").orderBy("doc_id").limit(400).collect() if r.text).split()
    long = " ".join(f"{w}" if k % 7 else f"{w}{k}" for k, w in enumerate((words * (1 + 20_000 // len(words)))[:20_000]))
    docs = fine.limit(20).union(spark.createDataFrame([(10**9, long, "en", "s", len(long))], "doc_id long, text string, lang string, source string, n_chars long").selectExpr(*(f"cast({f.name} as {f.dataType.simpleString()}) {f.name}" for f in fine.schema)))
    docs = docs.withColumn("start", F.lit("mine")).withColumn("score", F.lit("mine")).withColumn("component_id", F.lit("mine"))
    kept = docs
    for name, stage in pipeline.STAGES[:-1]:
        kept = stage(spark, kept, str(tmp_path))
        assert kept.columns == docs.columns, name
        assert {(r.start, r.score, r.component_id) for r in kept.collect()} == {("mine", "mine", "mine")}
    assert kept.where(f"doc_id = {10**9}").first().text == long
    pieces = pipeline.packing(spark, kept, str(tmp_path)).where(f"doc_id = {10**9}").collect()
    assert sum(r.length for r in pieces) == pieces[0].doc_tokens > 20_000
