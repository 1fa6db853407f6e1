import corpus_pipeline
from cases import empty
from compare import connect, same

from pairloom.llm import queries


def test_stages_keep_columns_and_take_effect(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    counts = [docs.count()]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, sf_dir)
        if k + 1 < len(corpus_pipeline.STAGES):
            assert out.columns == docs.columns
        out.write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        counts.append(docs.count())
    assert counts[0] > counts[1] > counts[2] >= counts[3] == counts[4] > 0
    redacted = spark.read.parquet(str(tmp_path / "3"))
    assert redacted.where("text like '%[EMAIL]%'").count() > 0 and redacted.where("text rlike '@mail[0-9]'").count() == 0


def test_stages_on_an_empty_table(spark, sf_dir):
    docs = empty(spark).select("doc_id", "text", "lang", "source", "n_chars")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf_dir)
    assert docs.count() == 0


def test_queries_equal_their_sql(spark, sf_dir):
    con = connect(sf_dir)
    for name, sql in queries.SQL.items():
        same(queries.QUERIES[name](spark, sf_dir).toPandas(), con.sql(sql).df())
