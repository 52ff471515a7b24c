"""File formats read back what was written."""

import pytest
from conftest import rows

from oeuvre.functions.columns import key_or
from oeuvre.operators.relations import in_order
from oeuvre.sources import files, records, schemas


def lines(tmp_path, name, *text):
    path = tmp_path / name
    path.write_text("\n".join(text) + "\n", encoding="utf-8")
    return str(path)


def test_semicolon(spark, tmp_path):
    path = lines(tmp_path, "o.csv", "SDG_label;fos_id", "SDG_2;5", '"SDG;3";6')
    assert rows(files.delimited(spark, path, files.SEMICOLON, schemas.ONTOLOGY)) == [("SDG;3", 6), ("SDG_2", 5)]


def test_all_text(spark, tmp_path):
    path = lines(tmp_path, "t.csv", "a,b", "007,NA", ",x")
    assert rows(files.delimited(spark, path)) == [("007", "NA"), (None, "x")]


def test_null_token(spark, tmp_path):
    path = lines(tmp_path, "t.csv", "a,b", "NA,x", "NAM,NA")
    assert rows(files.delimited(spark, path, files.NULL_TOKEN)) == [("NAM", None), (None, "x")]


def test_european(spark, tmp_path):
    path = lines(tmp_path, "e.csv", "name;share;n", "Österreich;1.234,5;7", "x;n/a;8")
    found = files.european(spark, path, ["share"])
    assert rows(found, "name", "share", "n") == [("x", None, "8"), ("Österreich", 1234.5, "7")]


def test_tabs_without_header(spark, tmp_path):
    path = lines(tmp_path, "p.txt", '1\t2\t3\t1\tA "B" C\tInst', "1\t\t\t2\t\t")
    found = files.tabs(spark, path, schemas.AUTHORS)
    assert rows(found) == [(1, 2, 3, 1, 'A "B" C', "Inst"), (1, None, None, 2, None, None)]


def test_corpus_names():
    names = [part.split()[0] for part in schemas.CORPUS.split(", ")]
    assert len(names) == 25 and names[0] == "paperid" and names[7] == "year" and names[21] == "journal"
    assert names[-1] == "unknown16"


def test_catalog_table(spark):
    spark.sql("CREATE DATABASE IF NOT EXISTS store")
    spark.range(3).write.mode("overwrite").saveAsTable("store.papers")
    assert files.catalog_table(spark, "papers", "store").count() == 3
    assert files.catalog_table(spark, "store.papers").count() == 3


def test_parquet_reads_named_columns(spark, tmp_path):
    path = str(tmp_path / "p")
    spark.range(5).selectExpr("id AS a", "id AS b", "id AS c").write.parquet(path)
    plan = files.parquet(spark, path, "b")._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<b:bigint>" in plan


def test_quoted_sink(spark, tmp_path):
    df = spark.createDataFrame([(1, 'say "hi", you', None), (2, "line\\", "")], "id int, t string, e string")
    path = str(tmp_path / "q")
    files.write_quoted(df, path)
    files.write_quoted(df, path)
    text = spark.read.text(path).collect()
    assert sum(r.value == '"id","t","e"' for r in text) >= 1
    found = files.delimited(spark, path, files.QUOTED, "id int, t string, e string")
    assert rows(found) == [(1, 'say "hi", you', None), (2, "line\\", None)]


def test_report_sink(spark, tmp_path):
    path = str(tmp_path / "r")
    files.write_report(spark.range(2), path)
    assert rows(files.delimited(spark, path, schema="id bigint")) == [(0,), (1,)]


def test_institution_records(spark, tmp_path):
    path = lines(
        tmp_path, "i.json",
        '{"id":"I1","ids":{"mag":"5","ror":"r"},"country_code":"AT","geo":{"city":"Graz"},"counts_by_year":[{"year":2000,"works_count":3}]}',
        '{"id":"I2","ids":{"ror":"r"},"country_code":"NA","display_name_acronyms":["A","B"]}',
        '{"id":"I3"}',
    )
    found = files.records(spark, path, schemas.INSTITUTION)
    codes = spark.createDataFrame([("AT", "AUT"), ("NA", "NAM")], "Alpha2 string, Alpha3 string")
    imported = records.import_institutions(found, codes)
    assert rows(imported, "id", "affiliationid", "country_code", "Alpha3", "geo.city") == [
        ("I1", "5", "AT", "AUT", "Graz"), ("I2", "", "NA", "NAM", None), ("I3", "", None, None, None)
    ]
    assert rows(found.select("id", key_or("ids", "mag", "none").alias("m"))) == [("I1", "5"), ("I2", "none"), ("I3", "none")]
    assert found.filter("id = 'I1'").first().counts_by_year[0].works_count == 3
    assert in_order(found.select("type", "id"), ["id", "ror", "type"]).columns == ["id", "type"]


def test_count_records(spark):
    data = [(2000, [("true", 1), ("false", 3)]), (2001, [("true", 5)]), (2002, [])]
    years = spark.createDataFrame(data, schemas.OPEN_COUNTS)
    assert rows(records.count_record_share(years)) == [(2000, "true", 1, 0.25), (2001, "true", 5, 1.0)]


@pytest.mark.parametrize("name", [n for n in dir(schemas) if n.isupper() and isinstance(getattr(schemas, n), str)])
def test_schemas_parse(spark, name):
    assert spark.createDataFrame([], getattr(schemas, name)).columns


def test_header_is_read_by_name(spark, tmp_path):
    path = lines(tmp_path, "j.csv", "year,mean citations,extra,journalid", "2010,5.0,x,7", "none,2.5,y,8")
    found = files.delimited(spark, path, schema=schemas.JOURNALS, renames={"mean citations": "mean_citations", "other": "z"})
    assert found.columns == ["journalid", "year", "mean_citations"]
    assert rows(found) == [(7, 2010, 5.0), (8, None, 2.5)]
    with pytest.raises(ValueError, match="mean_citations"):
        files.delimited(spark, path, schema=schemas.JOURNALS)
