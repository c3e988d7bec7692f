"""The pipeline's stages against what they promise."""

import duckdb

import corpus_pipeline
from regionspark.llm import queries

SF = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = {r.doc_id: r.text for r in docs.collect()}
        stage(spark, docs, SF).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        rows = docs.collect()
        if k < 4:
            assert docs.columns == columns
            after = {r.doc_id: r.text for r in rows}
            assert after.keys() <= before.keys()
            assert len(after) == len(rows)
        if k == 1:
            assert len(set(after.values())) == len(after)
            assert set(after.values()) == set(before.values())
        if k == 3:
            assert after.keys() == before.keys()
            assert all(r.n_chars == len(r.text) for r in rows)
        if k == 4:
            assert {r.doc_id for r in rows} == before.keys()
    assert corpus_pipeline.ORACLE_SQL is None


def test_run_and_registered_queries(spark):
    assert corpus_pipeline.run(spark, SF).count() > 0
    names = sorted(queries.queries())
    assert names == sorted([*(n for n in names if n.startswith("op")), "pipeline"])
    assert sorted(int(n[2:].split("_")[0]) for n in names if n.startswith("op")) == list(range(1, 11))


def test_oracle(spark):
    connection = duckdb.connect()
    connection.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{SF}/documents.parquet')")
    for name, sql in queries.oracle_sql().items():
        got = queries.queries()[name](spark, SF)
        result = connection.execute(sql)
        order = [[c[0] for c in result.description].index(c) for c in got.columns]
        assert sorted(map(tuple, got.collect())) == sorted(tuple(r[i] for i in order) for r in result.fetchall())
