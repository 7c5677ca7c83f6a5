import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from bandrisk.llm.queries import ORACLE, QUERIES
from bandrisk.llm.text import words
from tests.llm.data import clashing, documents, odd_rows

SF_DIR = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", list(QUERIES))
def test_query_runs_over_its_table(spark, name):
    rows = QUERIES[name](spark, SF_DIR).count()
    table = "pages" if name.startswith(("op1_", "op4_")) else "documents"
    if name.startswith(("op1_", "op3_", "op4_", "op5_", "op6_", "op7_", "op10_", "op12_")):
        assert rows == spark.read.parquet(f"{SF_DIR}/{table}.parquet").count()
    else:
        assert rows > 0


@pytest.mark.parametrize("name", list(ORACLE))
def test_query_against_its_sql(spark, name):
    import duckdb

    connection = duckdb.connect()
    for table in ("documents", "benchmark", "pages", "conversations"):
        connection.execute(f"create view {table} as select * from '{SF_DIR}/{table}.parquet'")
    result = connection.execute(ORACLE[name])
    names = [d[0] for d in result.description]
    expected = sorted(result.fetchall(), key=repr)
    assert sorted((tuple(r) for r in QUERIES[name](spark, SF_DIR).select(*names).collect()), key=repr) == expected


def test_pipeline_stages(spark, tmp_path):
    spark.createDataFrame([(1, "one two three four five")], "item_id long, text string").write.parquet(
        str(tmp_path / "benchmark.parquet")
    )
    docs = clashing(documents(spark, odd_rows()))
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    columns = docs.columns
    seen = []
    for number, (_, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, str(tmp_path))
        docs.write.parquet(str(tmp_path / f"stage{number}"))
        docs = spark.read.parquet(str(tmp_path / f"stage{number}"))
        seen.append(docs.count())
        if number < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == columns
    assert seen[0] == len([r for r in odd_rows() if any(c.isalpha() for c in r[1] or "")])
    assert seen[1] == seen[0] - 4 and seen[2] == seen[1] and seen[3] == seen[2] - 1 and seen[4] >= seen[3]
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == seen[4]


def test_white_space(spark):
    df = spark.createDataFrame([("a\x0bb\x1cc\u00a0d\n e ",), (None,), ("",)], "text string").select(words(F.col("text")))
    assert [r[0] for r in df.collect()] == [["a", "b\x1cc\u00a0d", "e"], [], []]
