"""The registered queries on the smallest tables: SQL where there is some, and the pipeline's stages."""

import pytest

from tabularium.llm import queries
from tests.test_catalogue import same


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_sql(spark, sf_dir, name):
    same(queries.QUERIES[name](spark, sf_dir), queries.ORACLES[name], sf_dir)


def test_pipeline_stages(spark, sf_dir):
    import corpus_pipeline as pipeline

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, n = docs.columns, docs.count()
    for name, stage in pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf_dir)
        path = pipeline.new_folder(spark, name)
        out.write.parquet(path)
        docs = spark.read.parquet(path)
        assert docs.columns == columns and 0.5 * n < docs.count() <= n
        n = docs.count()
    last = pipeline.STAGES[-1][1](spark, docs, sf_dir)
    assert last.count() == n


def test_pipeline_of_odd_rows(spark, tmp_path):
    import corpus_pipeline as pipeline

    schema = "doc_id long, text string, lang string, source string, n_chars long"
    rows = [(1, None, None, None, None), (2, "", "en", "s", 0), (3, "plain words in a row", "en", None, 1), (3, "plain words in a row", "en", None, 1), (None, "no id here", None, "s", 2)]
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, None)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert sorted(str(x.doc_id) for x in pipeline.run(spark, str(tmp_path)).collect()) == ["3", "None"]


def test_pipeline_of_nothing(spark, tmp_path):
    import corpus_pipeline as pipeline

    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert pipeline.run(spark, str(tmp_path)).count() == 0
