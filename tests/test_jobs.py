"""The jobs from catalogue and files to the finished tables."""

import pytest
from conftest import rows
from pyspark.sql import functions as F

from oeuvre.catalogue import queries as catalogue
from oeuvre.catalogue.tables import Tables
from oeuvre.operators import shares
from oeuvre.plans import jobs
from oeuvre.sources import files, schemas

YEARS = (1996, 2000)


@pytest.fixture(scope="module")
def tables(spark):
    return Tables(spark, "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def enriched(spark, tables, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("jobs"))
    spark.sql("CREATE DATABASE IF NOT EXISTS scholar")
    store = {
        "papers": tables.papers.drop("is_oa", "citations_norm"),
        "paperfieldsofstudy": tables.scores,
        "fieldsofstudy": tables.fields,
        "paperauthoraffiliations": tables.authors,
        "conferenceinstances": tables.conferences,
    }
    for name, df in store.items():
        df.write.mode("overwrite").saveAsTable(f"scholar.{name}")
    tables.ontology.write.options(**files.SEMICOLON).csv(f"{root}/ontology")
    tables.open_access.write.parquet(f"{root}/open_access")
    files.write_report(tables.funders, f"{root}/funders")
    files.write_report(tables.journal_averages, f"{root}/journals")
    found = jobs.select_sample(spark, jobs.SampleJob("scholar", f"{root}/ontology", f"{root}/out", years=YEARS))
    job = jobs.EnrichJob("scholar", f"{root}/out", f"{root}/open_access", f"{root}/funders", f"{root}/journals")
    return root, found, jobs.enrich_sample(spark, job)


def test_select_sample(spark, tables, enriched):
    root, found, _ = enriched
    assert rows(found["sdg_labels"]) == rows(catalogue.sample_labels(tables))
    assert rows(found["sdg_papers"], "paperid", "fosid_aggregated") == rows(catalogue.field_list(tables))
    assert rows(found["sdg_author_paper_affil"]) == rows(catalogue.sample_authors(tables))
    written = files.delimited(spark, f"{root}/out/sdg_labels.csv", files.QUOTED, "paperid bigint, SDG_label string")
    assert rows(written) == rows(found["sdg_labels"])


def test_enrich_sample(tables, enriched):
    _, found, collated = enriched
    papers = found["sdg_papers"].select("paperid")
    wanted = catalogue.collated_papers(tables).join(papers, "paperid", "left_semi")
    got = collated.withColumn("citations_norm", F.round("citations_norm", 6))
    assert rows(got, *wanted.columns) == rows(wanted)
    assert collated.count() == collated.distinct().count()


def test_report(spark, tables, enriched, tmp_path):
    _, found, collated = enriched
    inputs = jobs.Inputs(
        papers=tables.papers,
        labels=tables.labels,
        authors=tables.authors,
        corpus=tables.papers,
        corpus_authors=tables.authors,
        affiliations=tables.affiliations,
        extra_countries=tables.second_source.select("affiliationid", F.col("Alpha3").alias("country")),
        countries=tables.countries,
        incomes=tables.incomes,
        ranking=tables.ranking,
        ranking_key=tables.ranking_key,
        indicators=tables.indicators,
        people=tables.people,
    )
    report = jobs.report(inputs, str(tmp_path), (1995, 2000), (1996, 1999), 1999, catalogue.SEGMENTS, 10.0)
    assert len(report) == 22
    for name, df in report.items():
        assert df.count() >= 0, name
    wanted = catalogue.yoy_growth(tables)
    growth = report["growth"].withColumns({c: F.round(c, 6) for c in ("prop", "prop_change")})
    assert rows(growth) == rows(wanted)
    regions = report["region_specialisation"].withColumn("specialisation", F.round("specialisation", 6))
    keys = ["SDG_label", "year", "sub_continent", "specialisation"]
    assert rows(spark.read.parquet(f"{tmp_path}/report/label_counts")) == rows(report["label_counts"])
    assert report["sample_size"].first()[0] == tables.papers.filter("year <= 2000").join(tables.labels, "paperid", "left_semi").count()
    assert rows(regions.filter("year <= 2000"), *keys) == rows(catalogue.specialisation(tables).filter("year <= 2000"), *keys)


def test_complete_countries(spark, tables, tmp_path):
    authors = tables.authors.selectExpr("*", "'' AS originalauthor", "'' AS originalaffiliation")
    authors.write.options(**files.TABS).csv(f"{tmp_path}/authors")
    places = tables.affiliations.selectExpr(
        "affiliationid", "rank", "'' AS normalizedname", "displayname", "'' AS gridid", "'' AS officialpage",
        "'' AS wikipage", "1 AS papercount", "1 AS citationcount", "0.0D AS latitude", "0.0D AS longitude",
        "'' AS createddate", "country",
    )
    places.write.options(**files.NULL_TOKEN).csv(f"{tmp_path}/places")
    nation = tables.raw("nation")
    nation.selectExpr("concat('A', n_nationkey) AS Alpha2", "n_name AS Alpha3").write.options(**files.HEADER).csv(f"{tmp_path}/codes")
    tables.second_source.join(nation.selectExpr("n_name AS Alpha3", "concat('A', n_nationkey) AS a2"), "Alpha3", "left").selectExpr(
        "concat('I', affiliationid) AS id", "map('mag', CAST(affiliationid AS STRING)) AS ids", "a2 AS country_code"
    ).write.json(f"{tmp_path}/records")
    (tmp_path / "records" / "none.json").write_text('{"id":"X","ids":{"ror":"r"},"country_code":"A1"}\n')
    job = jobs.CountryJob(*(f"{tmp_path}/{name}" for name in ("authors", "places", "records", "codes", "out")))
    found = jobs.complete_countries(spark, job)
    assert found["coverage"].first()[0] == pytest.approx(catalogue.country_coverage(tables).first()[0], abs=1e-6)
    assert rows(found["gap_file"], "affiliationid", "country") == rows(catalogue.gap_file(tables), "affiliationid", "country")
    assert found["agreement"].first()[0] == pytest.approx(catalogue.agreement(tables).first()[0], abs=1e-6)
    assert rows(found["disagreements"], "affiliationid") == rows(catalogue.disagreements(tables), "affiliationid")
    written = files.delimited(spark, f"{tmp_path}/out/additional_country_information.csv")
    assert written.count() == found["gap_file"].count()


def test_report_from_files(spark, tables, enriched, tmp_path):
    root, _, _ = enriched
    blank = {c.split()[0]: "CAST(NULL AS STRING)" for c in schemas.CORPUS.split(", ")}
    corpus = tables.papers.selectExpr(*[f"{c} AS {c}" if c in ("paperid", "year") else f"{e} AS {c}" for c, e in blank.items()])
    corpus.write.options(**files.TABS).csv(f"{tmp_path}/corpus")
    tables.authors.selectExpr("*", "'' AS a", "'' AS b").write.options(**files.TABS).csv(f"{tmp_path}/authors")
    tables.affiliations.selectExpr(
        "country", "affiliationid", "rank", "'' AS normalizedname", "displayname", "'' AS gridid", "'' AS officialpage",
        "'' AS wikipage", "1 AS papercount", "1 AS citationcount", "0.0D AS latitude", "0.0D AS longitude", "'' AS createddate",
    ).write.options(**files.NULL_TOKEN).csv(f"{tmp_path}/places")
    tables.second_source.selectExpr("affiliationid", "Alpha3 AS country").write.parquet(f"{tmp_path}/extra")
    raw = {v: k for k, v in schemas.COUNTRY_HEADER.items()}
    countries = tables.countries.withColumnsRenamed(raw).withColumn("Global Code", F.lit(1))
    countries.select("Global Code", *reversed(raw.values())).write.options(**files.SEMICOLON).csv(f"{tmp_path}/countries")
    raw = {v: k for k, v in schemas.INCOME_HEADER.items()}
    tables.incomes.select(*raw).withColumnsRenamed(raw).write.options(**files.HEADER).csv(f"{tmp_path}/incomes")
    tables.ranking.select(*reversed(tables.ranking.columns)).write.options(**files.HEADER).csv(f"{tmp_path}/ranking")
    tables.ranking_key.write.options(**files.SEMICOLON).csv(f"{tmp_path}/key")
    tables.indicators.write.options(**files.HEADER).csv(f"{tmp_path}/indicators")
    names = ("corpus", "authors", "places", "extra", "countries", "incomes", "ranking", "key", "indicators")
    inputs = jobs.read_inputs(spark, jobs.Paths(f"{root}/out", *(f"{tmp_path}/{n}" for n in names)))
    report = jobs.report(inputs, f"{tmp_path}/tables", (1996, 2000), (1996, 1999), 1999, catalogue.SEGMENTS, 0.0)
    assert "gender" not in report
    counts = shares.count_by(catalogue.sample_labels(tables).join(tables.papers, "paperid"), "SDG_label", "year")
    got = report["growth"].select("SDG_label", "year", "n")
    assert {r[:2] for r in rows(got)} == {r[:2] for r in rows(counts, "SDG_label", "year", "n")}
    assert report["region_specialisation"].count() > 0 and report["bin_shares"].count() > 0
    whole = catalogue.region_baseline(tables).filter("year BETWEEN 1996 AND 2000")
    mine = report["region_specialisation"].select("year", "sub_continent", "nn").distinct()
    assert set(rows(mine)) <= set(rows(whole, "year", "sub_continent", "nn"))
