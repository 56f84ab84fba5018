"""The pipeline's stages, and every registered query of the subpackage."""

import os

import duckdb
import pytest

from scriptorium.llm import quality, queries

SF = "/root/testdata/sf0.001"


def test_stages_work_on_all_that_is_kept(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality classifier", "exact dedup", "n-gram Jaccard join", "mixing sources", "packing"]
    sizes = []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF).cache()
        assert docs.columns == spark.read.parquet(f"{SF}/documents.parquet").columns
        sizes.append(docs.count())
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    scored = quality.score_documents(spark.read.parquet(f"{SF}/documents.parquet"), labels)
    assert sizes[0] == scored.where("predicted = 1").count() and sizes[0] >= sizes[1] >= sizes[2] > 0
    plan = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert plan.where("start = 0").count() == sizes[3]


@pytest.mark.parametrize("n", range(5))
def test_stages_take_odd_empty_and_clashing_tables(spark, n):
    import corpus_pipeline
    from tests.llm.test_ops import ODD, empty, odd

    name, stage = corpus_pipeline.STAGES[n]
    assert stage(spark, empty(spark), SF).count() == 0
    for clash in (False, True):
        docs = odd(spark, clash)
        out = stage(spark, docs, SF)
        got = [r.asDict() for r in out.collect()]
        if n < 4:
            assert out.columns == docs.columns and {(r["doc_id"], r["text"]) for r in got} <= {r[:2] for r in ODD}
        if name == "exact dedup":
            assert len(got) == 10 - 1
        if name == "packing":
            assert sum(r["start"] == 0 for r in got) == len(ODD)


@pytest.mark.parametrize("name", list(queries.ORACLE_SQL))
def test_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "embeddings", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = queries.QUERIES[name](spark, SF)
    out = con.execute(queries.ORACLE_SQL[name])
    names = [c[0] for c in out.description]
    assert sorted(names) == sorted(df.columns)
    key = lambda r: tuple(map(str, r))
    assert sorted((tuple(r) for r in df.select(*names).collect()), key=key) == sorted(out.fetchall(), key=key)


def test_every_operator_is_registered():
    assert {f"op{n}" for n in range(1, 11)} == {q.split("_")[0] for q in queries.QUERIES if q != "pipeline"}
    assert os.path.exists(SF)
