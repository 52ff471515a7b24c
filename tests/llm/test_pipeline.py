"""Each stage of the pipeline against its operator's counterpart, on what the stage before it kept."""

import duckdb
import pytest

import corpus_pipeline
from oeuvre.llm import oracle, quality, templates

from .test_sql import lines

FOLDER = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    docs, out = spark.read.parquet(f"{FOLDER}/documents.parquet"), [f"{FOLDER}/documents.parquet"]
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path_factory.mktemp("stage") / name.replace(" ", "_"))
        stage(spark, docs, FOLDER).write.parquet(path)
        docs = spark.read.parquet(path)
        out.append(f"{path}/*.parquet")
    return out


def ids(path):
    return sorted(r[0] for r in duckdb.sql(f"SELECT doc_id FROM '{path}'").fetchall())


def on(path, sql):
    connection = duckdb.connect()
    connection.execute(f"CREATE VIEW documents AS SELECT * FROM '{path}'")
    connection.execute(f"CREATE VIEW labels AS SELECT * FROM '{FOLDER}/labels.parquet'")
    result = connection.execute(sql)
    return [c[0] for c in result.description], result.fetchall()


def test_columns(spark, stages):
    first = spark.read.parquet(stages[0]).columns
    assert all(spark.read.parquet(p.removesuffix("/*.parquet")).columns == first for p in stages[1:-1])


def test_quality(spark, stages):
    docs, labels = spark.read.parquet(stages[0]), spark.read.parquet(f"{FOLDER}/labels.parquet")
    good = quality.classify(docs, labels).where("predicted = 1")
    assert ids(stages[1]) == sorted(r["doc_id"] for r in good.collect())


def test_one_of_each(stages):
    _, rows = on(stages[1], oracle.JACCARD)
    assert ids(stages[2]) == sorted(r[0] for r in rows if r[0] == r[2])


def test_decontaminated(spark, stages):
    docs, items = spark.read.parquet(stages[2].removesuffix("/*.parquet")), spark.read.parquet(f"{FOLDER}/benchmark.parquet")
    found = {r["doc_id"] for r in templates.leaks(docs, items).collect()}
    texts = [r["text"] for r in items.collect()]
    exact = {r["doc_id"] for r in docs.collect() if any(t in r["text"] for t in texts)}
    assert exact <= found and ids(stages[3]) == sorted(set(ids(stages[2])) - found)


def test_without_secrets(stages):
    names, rows = on(stages[3], oracle.SECRETS)
    assert ids(stages[4]) == sorted(r[0] for r in rows if r[names.index("spans")] == "")


def test_mixed(spark, stages):
    names, rows = on(stages[4], oracle.MIXING)
    df = spark.read.parquet(stages[5].removesuffix("/*.parquet"))
    assert lines(df.columns, df.collect()) == lines(names, [r for r in rows if r[names.index("taken")] > 0])


def test_run_gives_the_last_stage(spark, stages):
    assert sorted(r["doc_id"] for r in corpus_pipeline.run(spark, FOLDER).collect()) == ids(stages[5])
