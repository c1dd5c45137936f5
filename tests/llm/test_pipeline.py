"""The pipeline on a small corpus: each stage's decisions, and the queries' columns."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from wickwork.llm import mixing, near_dedup, quality, queries, sql

SF = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    sizes = []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, SF)
        if k < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        path = str(tmp_path / name)
        out.write.parquet(path)
        docs, before = spark.read.parquet(path), docs
        sizes.append(docs.count())
        if name == "quality":
            assert docs.count() < before.count()
        if name == "near_dedup":
            classes, _ = near_dedup.near_duplicates(before.select("doc_id", "text"))
            assert docs.count() == classes.select("class_id").distinct().count()
        if name == "mixing":
            budget = before.select(mixing.word_count("text").alias("n")).groupBy().sum("n").first()[0]
            taken = docs.select(mixing.word_count("text").alias("n")).groupBy().sum("n").first()[0]
            assert 0.9 * budget <= taken <= budget
    assert sizes[0] >= 0.97 * 200 and sizes[-1] == sizes[-2]


def test_run(spark):
    assert corpus_pipeline.run(spark, SF).count() > 0


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_query_runs(spark, name):
    assert queries.queries()[name](spark, SF).count() > 0


@pytest.mark.parametrize("name", sorted(sql.oracle_sql()))
def test_twins(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = con.sql(sql.oracle_sql()[name])
    got = queries.queries()[name](spark, SF).select(*want.columns)
    key = lambda r: tuple("~" if x is None else str(x) for x in r)
    assert sorted(key(tuple(r)) for r in got.collect()) == sorted(map(key, want.fetchall()))


def test_stages_take_nulls_repeats_and_empty_tables(spark, tmp_path):
    """Awkward rows and an empty table pass every stage."""
    schema = "doc_id long, text string, lang string, source string, n_chars long, _extra string, lang_pred string, bucket string"
    rng = random.Random(1)
    made = [" ".join("".join(rng.choices("abcdefghij", k=6)) for _ in range(60)) for _ in range(31)]
    text = made[30]
    rows = [(k, made[k], "en", "a", 5, "x", "y", "z") for k in range(30)]
    rows += [(30, None, None, None, None, None, None, None), (None, text, None, None, None, None, None, None), (None, text, None, None, None, None, None, None), (31, "", "en", "b", 0, "", "", ""), (32, text, None, "b", 1, "", "", "")]
    spark.createDataFrame([(k, k % 2, 0) for k in range(20)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    for name, given in (("some", rows), ("none", [])):
        docs = spark.createDataFrame(given, schema)
        for stage, run in corpus_pipeline.STAGES:
            path = str(tmp_path / f"{name}-{stage}")
            run(spark, docs, str(tmp_path)).write.parquet(path)
            docs = spark.read.parquet(path)
        assert (docs.count() > 0) == bool(given)


def test_one_of_each_and_kept_documents_move_no_text(spark, monkeypatch):
    """The rows that stay are picked where they are, and quality stores no text."""
    docs, columns = spark.read.parquet(f"{SF}/documents.parquet"), []
    labels = docs.select("doc_id", F.lit(1).alias("quality"))
    store = quality.stored
    monkeypatch.setattr(quality, "stored", lambda df, *more: columns.append(df.columns) or store(df, *more))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for kept in (near_dedup.one_of_each(docs), quality.kept_documents(docs, labels)):
            plan = kept._jdf.queryExecution().executedPlan().toString()
            assert "SortMergeJoin" not in plan and "ShuffledHashJoin" not in plan
        want = quality.judge(docs, labels, keep_text=False).where("kept").select("doc_id")
        assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == sorted(r["doc_id"] for r in want.collect())
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert columns and all("text" not in x for x in columns)
