import os

import duckdb
import pytest

import __spark_entry__
import corpus_pipeline

HERE = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(HERE), reason="no test tables")


@pytest.mark.parametrize("name", [n for n in __spark_entry__.oracle_sql() if n.startswith("op")])
def test_sql(spark, name):
    con = duckdb.connect()
    for x in os.listdir(HERE):
        con.execute(f"CREATE VIEW {x.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{HERE}/{x}')")
    key = lambda df: sorted(map(tuple, df[sorted(df.columns)].astype(object).values.tolist()), key=repr)
    assert key(__spark_entry__.queries()[name](spark, HERE).toPandas()) == key(con.execute(__spark_entry__.oracle_sql()[name]).df())


def test_one_query_for_each_operator():
    names = list(__spark_entry__.queries())
    assert all(sum(n.startswith(f"op{i}_") for n in names) == 1 for i in range(1, 11)) and "pipeline" in names


def test_pipeline_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{HERE}/documents.parquet")
    columns, n = docs.columns, docs.count()
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, HERE)
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        if k < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == columns and 0 < docs.count() <= n
            n = docs.count()
    assert docs.agg({"doc_id": "approx_count_distinct"}).first() and docs.filter("start = 0").count() == n
