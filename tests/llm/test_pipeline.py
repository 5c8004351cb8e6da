"""The pipeline's stages on the smallest documents."""

import duckdb

import corpus_pipeline as cp
from blockloom.llm import decontaminate, registry, secrets

SF = "/root/testdata/sf0.001"


def db():
    c = duckdb.connect()
    for t in ("documents", "benchmark", "pages"):
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def test_sql_twins(spark):
    for name, sql in registry.oracle_sql().items():
        rel = db().sql(sql)
        got = registry.queries()[name](spark, SF).select(*rel.columns).collect()
        assert sorted(map(str, map(tuple, got))) == sorted(map(str, rel.fetchall())), name


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, n = docs.columns, docs.count()
    for name, stage in cp.STAGES[:-1]:
        path = cp.workdir(spark, name)
        before = docs
        stage(spark, docs, SF).write.parquet(path)
        docs = spark.read.parquet(path)
        assert docs.columns == columns and docs.dtypes == before.dtypes
        assert 0.5 * n < docs.count() <= before.count()
    assert decontaminate.decontaminate(docs, spark.read.parquet(f"{SF}/benchmark.parquet")).where("n_hit > 0 and size(items) > 0").count() == 0
    assert secrets.scan(docs).where("n_assign + n_access + n_hex > 0").count() == 0
    assert all(r.n_chars == len(r.text) for r in docs.collect())


def test_run(spark):
    out = cp.run(spark, SF)
    assert {"shard", "epoch", "words", "position"} <= set(out.columns)
    assert out.count() > 0 and out.where("words <= 0 or text is null").count() == 0
