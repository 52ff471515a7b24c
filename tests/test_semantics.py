"""Nulls, ties, duplicates and other cases the driver's tables do not have."""

import pytest
from conftest import rows
from pyspark.sql import functions as F

from oeuvre.functions import columns as fn
from oeuvre.operators import (
    authorship, coverage, enrich, gender, growth, open_access, prestige, quantiles, relations, sample, shares,
)

FAILURE = Exception


def make(spark, schema, *data):
    return spark.createDataFrame(list(data), schema)


# Authors ---------------------------------------------------------------------


def test_author_groups(spark):
    df = make(
        spark, "paperid bigint, authorsequencenumber int",
        (1, 1), (2, 1), (2, 2), (2, None), (3, 1), (3, 2), (3, 3), (3, 3), (4, None), (5, 2), (6, None), (6, 1),
    )
    assert rows(authorship.author_groups(df)) == sorted([
        (1, 1, "single", "first_author"),
        (2, 1, "double", "first_author"), (2, 2, "double", "last_author"), (2, None, "double", "middle_author"),
        (3, 1, "multi", "first_author"), (3, 2, "multi", "middle_author"),
        (3, 3, "multi", "last_author"), (3, 3, "multi", "last_author"),
        (4, None, "multi", "middle_author"),
        (5, 2, "double", "last_author"),
        (6, None, "single", "first_author"), (6, 1, "single", "first_author"),
    ], key=lambda r: (r[0], r[1] is None, r[1] or 0))


def test_papers_without_authors_have_no_role(spark):
    papers = make(spark, "paperid bigint, SDG_label string, year int", (1, "a", 2000), (9, "a", 2000))
    authors = make(spark, "paperid bigint, authorid bigint, affiliationid bigint, authorsequencenumber int", (1, 5, 7, 1))
    places = make(spark, "affiliationid bigint, country string", (7, "AUT"))
    found = authorship.papers_with_roles(papers, authors, places)
    assert rows(found, "paperid", "country", "paper_author_cat", "author_position") == [
        (1, "AUT", "single", "first_author"), (9, None, None, None),
    ]
    counts = authorship.country_counts(papers, authors, places, "year", "author_position")
    assert rows(counts, "country", "author_position", "n") == [("AUT", "first_author", 1), (None, None, 1)]


def test_fractional_weights(spark):
    df = make(spark, "paperid bigint, authorid bigint, affiliationid bigint", (1, 1, 1), (1, 1, 2), (1, None, 3), (1, None, 4), (2, 1, 1))
    found = authorship.fractional_weight(df)
    assert rows(found, "paperid", "authorid", "frac_value") == [(1, 1, 0.5)] * 2 + [(1, None, 0.5)] * 2 + [(2, 1, 1.0)]


def test_fractional_productivity(spark):
    papers = make(
        spark, "paperid bigint, SDG_label string, year int, is_oa boolean, citations_norm double",
        (1, "a", 2000, True, 2.0), (1, "b", 2000, True, 2.0), (2, "a", 2000, None, None),
    )
    authors = make(spark, "paperid bigint, authorid bigint, affiliationid bigint", (1, 1, 7), (2, 1, 7))
    found = authorship.fractional_productivity(papers, authors)
    assert rows(found) == [(7, 2000, "a", 1.5, 0.5, 1.0), (7, 2000, "b", 0.5, 0.5, 1.0)]
    found = authorship.fractional_productivity(papers, authors, weight_over="affiliations")
    assert rows(found) == [(7, 2000, "a", 2.0, 1.0, 2.0), (7, 2000, "b", 1.0, 1.0, 2.0)]
    with pytest.raises(ValueError):
        authorship.fractional_productivity(papers, authors, weight_over="other")


def test_sequence_weight(spark):
    df = make(spark, "paperid bigint, authorsequencenumber int", (1, 1), (1, 4), (2, None))
    assert rows(authorship.sequence_weight(df)) == [(1, 1, 0.25), (1, 4, 0.25), (2, None, None)]


def test_gender_leaves_out_the_unknown(spark):
    papers = make(spark, "paperid bigint, SDG_label string, year int", (1, "a", 2000), (2, "a", 2030))
    authors = make(
        spark, "paperid bigint, authorid bigint, authorsequencenumber int",
        (1, 1, 1), (1, 2, 2), (1, 3, 3), (1, 4, 4), (1, None, 5), (2, 1, 1),
    )
    people = make(spark, "authorid bigint, gender string", (1, "female"), (2, "male"), (3, "unknown"), (4, None))
    found = gender.gender_share(papers, authors, people, "SDG_label", before=2020)
    assert rows(found) == [("a", "female", 1, 0.5), ("a", "male", 1, 0.5)]


# Shares and growth -----------------------------------------------------------


def test_count_keeps_null_groups(spark):
    df = make(spark, "k string", ("a",), (None,), (None,))
    assert rows(shares.count_by(df, "k")) == [("a", 1), (None, 2)]
    assert rows(shares.row_count(df)) == [(3,)]


def test_shares_add_up(spark):
    df = make(spark, "g string, c string, n bigint", ("x", "a", 1), ("x", "b", 3), ("y", "a", 0), (None, "a", 5))
    found = shares.share_of_total(df, "n", "g", total="sum")
    assert rows(found) == [("x", "a", 1, 4, 0.25), ("x", "b", 3, 4, 0.75), ("y", "a", 0, 0, None), (None, "a", 5, 5, 1.0)]


def test_specialisation_without_baseline(spark):
    label = make(spark, "year int, g string, nn bigint, share double", (2000, "a", 1, 0.5), (2001, "a", 1, 0.5))
    whole = make(spark, "year int, g string, nn bigint, share double", (2000, "a", 9, 0.25))
    assert rows(shares.specialisation(label, whole, ["year", "g"]), "year", "specialisation") == [(2000, 2.0), (2001, None)]


def test_strict_mean(spark):
    df = make(spark, "g string, v double", ("a", 1.0), ("a", 3.0), ("b", 1.0), ("b", None))
    assert rows(shares.mean_by(df, "v", "g")) == [("a", 2.0), ("b", None)]
    assert rows(shares.mean_by(df, "v", "g", skip_nulls=True)) == [("a", 2.0), ("b", 1.0)]


def test_group_shares_drop_incomplete_countries(spark):
    counts = make(spark, "country string, year int, n bigint", ("A", 1, 2), ("B", 1, 6), ("C", 1, 9), (None, 1, 9), ("D", 1, 9))
    places = make(spark, "country_code string, r string, other string", ("A", "x", "o"), ("B", "y", "o"), ("C", "y", None))
    found = shares.group_shares(counts, places, {"country": "country_code"}, "r", ["year"])
    assert rows(found) == [(1, "x", 2, 0.25), (1, "y", 6, 0.75)]


def test_proportions_of_nothing(spark):
    df = make(spark, "k string, b string, v double", ("a", "x", None), ("a", "y", 2.0))
    assert rows(shares.proportions(df, "b", "v", "k")) == [("a", "x", 0.0, 0.0), ("a", "y", 2.0, 1.0)]


def test_growth_uses_the_row_before(spark):
    df = make(spark, "g string, year int, v double", ("a", 2000, 2.0), ("a", 2003, 3.0), ("a", 2004, 0.0), ("a", 2005, 1.0))
    assert rows(growth.yearly_growth(df, "v", "g"), "year", "prop_change") == [
        (2000, 0.0), (2003, 0.5), (2004, -1.0), (2005, 0.0)
    ]


def test_compound_growth_needs_both_ends(spark):
    df = make(spark, "g string, year int, v double", ("a", 2000, 1.0), ("a", 2002, 4.0), ("b", 2002, 4.0), ("c", 2001, 1.0))
    assert rows(growth.compound_growth(df, {"v": "x"}, "g", 2000, 2002)) == [("a", 4.0, 1.0), ("b", None, None)]


# Relations -------------------------------------------------------------------


def test_left_join_rules(spark):
    left = make(spark, "k string, v int", ("a", 1), (None, 2), ("z", 3))
    right = make(spark, "code string, w int", ("a", 10), (None, 20), ("a", 11))
    assert rows(relations.left_join(left, right, {"k": "code"})) == [("a", 1, 10), ("a", 1, 11), ("z", 3, None), (None, 2, None)]
    matching = relations.left_join(left, right, {"k": "code"}, null_keys="match")
    assert rows(matching) == [("a", 1, 10), ("a", 1, 11), ("z", 3, None), (None, 2, 20)]
    with pytest.raises(FAILURE, match="more than one row"):
        relations.left_join(left, right, {"k": "code"}, unique=True).collect()
    with pytest.raises(ValueError):
        relations.left_join(left, right.withColumnRenamed("w", "v"), {"k": "code"})
    with pytest.raises(ValueError):
        relations.left_join(left, right, {"k": "code"}, null_keys="maybe")


def test_backfill(spark):
    df = make(spark, "id int, c string, n int", (1, "A", 1), (2, None, 2), (3, None, 3))
    other = make(spark, "id int, c string", (1, "X"), (2, "B"))
    assert rows(relations.backfill(df, other, "id", "c")) == [(1, "A", 1), (2, "B", 2), (3, None, 3)]


def test_not_in_keeps_null(spark):
    df = make(spark, "c string", ("a",), ("b",), (None,))
    assert rows(df.filter(relations.not_in("c", ["a"]))) == [("b",), (None,)]


def test_complete(spark):
    df = make(spark, "a int, b double", (1, 1.0), (2, None), (3, float("nan")), (None, 4.0))
    assert rows(relations.complete(df)) == [(1, 1.0)]
    assert rows(relations.complete(df, ["a"]), "a") == [(1,), (2,), (3,)]


def test_sorted_report_puts_nulls_last(spark):
    df = make(spark, "a string, n int", (None, 1), ("b", 1), ("a", 1), ("a", 2))
    assert [tuple(r) for r in relations.sorted_report(df, "a", "-n").collect()] == [("a", 2), ("a", 1), ("b", 1), (None, 1)]


def test_uncovered_is_unmatched_or_null(spark):
    ids = make(spark, "id int", (1,), (2,), (3,), (None,))
    source = make(spark, "id int, c string", (1, "A"), (2, None))
    assert rows(relations.uncovered(ids, source, "id", "c"), "id") == [(2,), (3,), (None,)]


# Quantiles -------------------------------------------------------------------


def test_bins_are_closed_on_the_right(spark):
    df = make(spark, "g int, v double", *[(1, float(v)) for v in range(11)], (1, None))
    found = rows(quantiles.quantile_bins(df.withColumn("b", F.col("v")), "b", "g"), "v", "b")
    assert found == [
        (0.0, "p[0,20]"), (1.0, "p[0,20]"), (2.0, "p[0,20]"), (3.0, "p(20,40]"), (4.0, "p(20,40]"), (5.0, "p(40,60]"),
        (6.0, "p(40,60]"), (7.0, "p(60,80]"), (8.0, "p(60,80]"), (9.0, "p(80,100]"), (10.0, "p(80,100]"), (None, None),
    ]


def test_tied_breaks(spark):
    df = make(spark, "g int, v double", (1, 1.0), (1, 1.0), (1, 1.0), (1, 2.0))
    found = rows(quantiles.quantile_bins(df, "v", "g", quantiles.QUARTILES))
    assert found == [(1, "p(75,100]")] + [(1, "p[0,25]")] * 3
    with pytest.raises(FAILURE, match="not unique"):
        quantiles.quantile_bins(df, "v", "g", quantiles.QUARTILES, strict=True).collect()


def test_box_stats(spark):
    logs = [0.0, 1.0, 1.1, 1.2, 1.3, 1.4, 9.0]
    df = make(spark, "g int, v double", *[(1, 10**v) for v in logs], (1, 0.0), (1, -3.0), (1, None), (2, 0.0))
    one, two = quantiles.box_stats_log10(df, "v", "g").orderBy("g").collect()
    assert (one.n, one.removed, one.outliers) == (7, 3, 2)
    assert (one.q1, one.median, one.q3, one.lower, one.upper) == pytest.approx((1.05, 1.2, 1.35, 1.0, 1.4))
    assert (two.n, two.removed, two.q1, two.outliers) == (0, 1, None, 0)


def test_score_profile(spark):
    df = spark.range(1, 101).select(F.col("id").cast("double").alias("score"))
    found = quantiles.score_profile(df, accuracy=10_000)
    assert rows(found) == [(0.1, 10.0), (0.25, 25.0), (0.5, 50.0), (0.75, 75.0), (0.9, 90.0)]


# Functions -------------------------------------------------------------------


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


@pytest.mark.parametrize("text,value", [("1.234,5", 1234.5), ("7", 7.0), ("-0,25", -0.25), ("n/a", None), ("", None)])
def test_european_number(spark, text, value):
    assert one(spark, fn.european_number(F.lit(text))) == value


@pytest.mark.parametrize("text,value", [("2015-2018", 2018), ("2018", 2018), ("2015-", None), ("soon", None), (None, None)])
def test_last_year(spark, text, value):
    assert one(spark, fn.last_year(F.lit(text).cast("string"))) == value


@pytest.mark.parametrize("value,text", [(0.5, "0.5"), (1.0, "1"), (0.0, "0"), (-0.004, "0"), (0.456, "0.46"), (None, "NA"), (10.0, "10")])
def test_rounded_text(spark, value, text):
    assert one(spark, fn.rounded_text(F.lit(value).cast("double"))) == text


def test_small_functions(spark):
    assert one(spark, fn.ratio(F.lit(1), F.lit(0))) is None
    assert one(spark, fn.number(F.lit("x"))) is None
    assert str(one(spark, fn.year_date(F.lit("2006")))) == "2006-01-01"
    assert one(spark, fn.year_date(F.lit("20x6"))) is None
    assert [one(spark, fn.rank_in(F.lit(v), fn.LABEL_ORDER)) for v in ("SDG_13", "SDG_2", "x")] == [3, 1, None]
    ids = F.create_map(F.lit("a"), F.lit("1"))
    assert (one(spark, fn.key_or(ids, "a", "")), one(spark, fn.key_or(ids, "mag", ""))) == ("1", "")
    empty = make(spark, "v double, b boolean", (None, None))
    assert rows(empty.agg(fn.total("v"), fn.share_true("b"))) == [(0.0, None)]


def test_correlation(spark):
    nan = float("nan")
    df = make(
        spark, "g string, x double, y double",
        ("a", 1.0, 1.0), ("a", 2.0, 3.0), ("a", 3.0, 2.0), ("a", None, 9.0), ("a", 9.0, nan),
        ("b", 1.0, 1.0), ("b", 1.0, 2.0), ("c", 1.0, 1.0), ("d", None, 1.0),
    )
    assert rows(prestige.pairwise_correlation(df, "x", "y", "g")) == [
        ("a", 0.5, "r = 0.5"), ("b", None, "r = NA"), ("c", None, "r = NA"), ("d", None, "r = NA")
    ]


# Sample, enrichment, prestige ------------------------------------------------


def test_topic_sample(spark):
    ontology = make(spark, "SDG_label string, fos_id bigint", ("SDG_2", 1), ("SDG_3", 1), ("SDG_3", 2), ("SDG_9", 3), ("SDG_2", 4))
    fields = make(spark, "fieldofstudyid bigint, level int", (1, 3), (2, 0), (3, 1), (4, 4))
    scores = make(
        spark, "paperid bigint, fieldofstudyid bigint, score double",
        (1, 1, 0.497), (1, 2, 0.9), (2, 1, 0.4969), (3, 3, 0.9), (4, 4, 0.9), (5, 2, 0.9), (6, 2, 0.9), (7, 2, 0.9), (8, 2, 0.9),
    )
    papers = make(
        spark, "paperid bigint, year int, journalid bigint, conferenceinstanceid bigint, doi string, extra int",
        (1, 2006, 1, None, "d1", 1), (1, 2006, 1, None, "d1", 2), (2, 2006, 1, 1, "d2", 0), (5, 2005, 1, None, "d5", 0),
        (6, 2020, None, 7, "d6", 0), (7, 2010, None, None, "d7", 0), (8, 2010, 1, 1, "", 0),
    )
    matches = sample.topic_matches(sample.topic_fields(ontology, fields), scores)
    found = sample.topic_sample(matches, papers)
    assert rows(found, "paperid", "SDG_label", "doi") == [(1, "SDG_2", "d1"), (1, "SDG_3", "d1"), (6, "SDG_3", "d6")]
    assert rows(sample.sample_papers(found, matches), "paperid", "fosid_aggregated") == [(1, "1, 1, 2"), (6, "2")]
    authors = make(spark, "paperid bigint, authorid bigint", (1, 5), (9, 9))
    assert rows(sample.sample_authors(found, authors)) == [(1, 5), (6, None)]


def test_oa_provider_class(spark):
    schema = """doi string, is_oa boolean, oa_status string, has_repository_copy boolean,
        oa_locations array<struct<is_best: boolean, host_type: string>>"""
    both = [(True, "publisher"), (False, "repository")]
    df = make(
        spark, schema,
        ("a", True, "s", True, both), ("b", True, "s", False, both), ("c", True, "s", None, both),
        ("d", True, "s", True, [(True, "repository")]), ("e", False, "s", False, []), ("f", None, "s", False, []),
        ("g", True, "s", True, [(None, "publisher")]), ("h", True, "s", True, [(True, None)]), ("i", False, "s", False, None),
        ("j", True, "s", True, [(True, "publisher"), (True, "publisher"), (True, "repository")]), ("a", True, "s", True, both),
    )
    assert rows(enrich.oa_provider_class(df), "doi", "provider_cat") == [
        ("a", "Journal & Repository"), ("b", "Journal only"), ("c", "Journal only"), ("d", "Repository only"),
        ("e", "Not OA"), ("h", None), ("i", "Not OA"), ("j", "Journal & Repository"), ("j", "Repository only"),
    ]


def test_enrichment_does_not_multiply(spark):
    papers = make(spark, "paperid bigint, doi string", (1, "a"), (2, "b"), (3, None))
    funders = make(spark, "doi string, funder string", ("a", "x"), ("a", "y"), (None, "z"))
    assert rows(enrich.with_funding(papers, funders)) == [(1, "a", True), (2, "b", False), (3, None, False)]
    assert rows(enrich.funders_in_sample(funders, papers)) == [("a", "x", 1), ("a", "y", 1)]


def test_conference_wins_over_journal(spark):
    papers = make(
        spark, "paperid bigint, year int, journalid bigint, conferenceinstanceid bigint, citationcount bigint",
        (1, 2000, 1, 1, 6), (2, 2000, 1, None, 6), (3, 2000, None, None, 6), (4, 2000, 1, 2, 6), (5, 2001, 1, None, 6), (6, 2000, 1, 9, 6),
    )
    journals = make(spark, "journalid bigint, year int, mean_citations double", (1, 2000, 2.0))
    conferences = make(spark, "conferenceinstanceid bigint, citationcount bigint, papercount bigint", (1, 9, 3), (2, 9, 0))
    found = enrich.normalised_citations(papers, journals, conferences)
    assert rows(found, "paperid", "citations_norm") == [(1, 2.0), (2, 3.0), (3, None), (4, None), (5, None), (6, None)]


def test_prestige_match(spark):
    ranking = make(
        spark,
        "University string, Country string, Period string, Field string, Frac_counting int, P_top10 string, PP_top10 string, impact_P string",
        ("U1", "X", "2015-2018", "All sciences", 1, "7", "0.5", "n/a"), ("U1", "X", "2015-2018", "All sciences", 0, "9", "9", "9"),
        ("U1", "X", "2015-2018", "Other", 1, "9", "9", "9"), ("U2", "X", "unknown", "All sciences", 1, "1", "1", "1"),
    )
    key = make(spark, "affiliationid bigint, University string", (1, "U1"), (2, "U1"), (1, "U2"))
    output = make(spark, "affiliationid bigint, year int, n_frac_papers double", (1, 2018, 1.0), (1, 2017, 1.0), (3, 2018, 1.0), (None, 2018, 1.0))
    found = prestige.match_prestige(output, key, prestige.clean_ranking(ranking))
    assert rows(found, "affiliationid", "year", "University", "P_top10", "impact_P") == [
        (1, 2017, "U1", None, None), (1, 2017, "U2", None, None), (1, 2018, "U1", 7.0, None), (1, 2018, "U2", None, None),
        (3, 2018, None, None, None), (None, 2018, None, None, None),
    ]


def test_inclusion_labels(spark):
    schema = "SDG_label string, year int, University string, n_frac_papers double, n_frac_oa_papers double, n_frac_citations double"
    df = make(spark, schema, ("a", 2018, "U", 1.0, 2.0, 3.0), ("a", 2018, None, 4.0, 5.0, 6.0), ("a", 2017, "U", 7.0, 8.0, 9.0))
    raw = rows(prestige.inclusion_rows(df, 2018), "in_ranking", "indicator", "value")
    assert ("matched", "n_frac_oa_papers", 2.0) in raw and len(raw) == 6
    merged = rows(prestige.inclusion_rows(df, 2018, merge_labels=True), "in_ranking", "indicator", "value")
    assert [v for k, i, v in merged if k == "unmatched" and i == prestige.PUBLICATIONS_TEXT] == [4.0, 5.0]


def test_open_access_by_country(spark):
    papers = make(spark, "paperid bigint, is_oa boolean, year int", (1, True, 2016), (2, False, 2016), (3, None, 2016), (4, True, 2010), (5, True, 2016))
    authors = make(
        spark, "paperid bigint, affiliationid bigint, authorsequencenumber int", (1, 7, 1), (1, 8, 2), (2, 7, 1), (3, 7, 1), (4, 7, 1)
    )
    places = make(spark, "affiliationid bigint, country string", (7, "A"), (8, "B"))
    found = open_access.open_by_country(papers, authors, places, (2015, 2018))
    assert rows(found, "country", "is_oa", "sum_frac_oa", "prop_oa", "sum_frac_total") == [
        ("A", False, 1.0, 0.666666667, 1.5), ("A", True, 0.5, 0.333333333, 1.5), ("B", True, 0.5, 1.0, 0.5),
        (None, True, None, None, None),
    ]


def test_pair_indicator(spark):
    found = make(
        spark, "country string, is_oa boolean, sum_frac_oa double, prop_oa double, sum_frac_total double",
        ("A", True, 6.0, 0.6, 10.0), ("A", False, 4.0, 0.4, 10.0), ("B", True, 1.0, 1.0, 1.0), ("C", True, 9.0, 1.0, 9.0),
    )
    values = make(
        spark, "country_name string, country_code string, indicator_code string, indicator_name string, year int, value double",
        ("a", "A", "G", "g", 2015, 1.0), ("a", "A", "G", "g", 2016, None), ("a", "A", "G", "g", 2018, 3.0), ("a", "A", "G", "g", 2019, 99.0),
        ("b", "B", "G", "g", 2015, 5.0), ("c", "C", "G", "g", 2015, None), ("a", "A", "H", "h", 2015, 1.0),
    )
    paired = open_access.pair_indicator(found, values, ["G"], (2015, 2018), least=2.0)
    assert rows(paired, "country", "G", "prop_oa") == [("A", 2.0, 0.6)]


def test_coverage_and_agreement(spark):
    authors = make(spark, "paperid bigint, affiliationid bigint", (1, 1), (2, 1), (3, 2), (4, 3), (5, None))
    places = make(spark, "affiliationid bigint, displayname string, country string", (1, "one", "AUT"), (2, "two", None), (4, "four", "X"))
    source = make(
        spark, "affiliationid bigint, country_code string, Alpha3 string", (1, "DE", "DEU"), (2, "NA", "NAM"), (4, "XX", "X")
    )
    seen = coverage.seen_affiliations(authors, places)
    assert rows(coverage.coverage(seen, "country")) == [(0.25,)]
    missing = coverage.missing_ids(authors, places)
    assert rows(missing) == [(2,), (3,), (None,)]
    assert rows(coverage.gap_coverage(missing, source)) == [(round(1 / 3, 9),)]
    assert rows(coverage.agreement(seen, source)) == [(0.0,)]
    assert rows(coverage.disagreements(seen, source), "affiliationid", "country", "Alpha3") == [(1, "AUT", "DEU")]
    assert rows(coverage.gap_file(seen, source), "affiliationid", "country") == [(2, "NAM"), (3, None), (None, None)]



def test_share_of_all_cells(spark):
    df = make(spark, "g string, n double", ("a", 1.0), ("b", 3.0), (None, 4.0))
    found = shares.share_of_total(df, "n", [], total="all")
    assert rows(found, "g", "share", "all") == rows(make(spark, "g string, s double, t double", ("a", 0.125, 8.0), ("b", 0.375, 8.0), (None, 0.5, 8.0)))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "NestedLoop" not in plan and "Cartesian" not in plan


def test_quantiles_of_a_whole_table(spark):
    df = make(spark, "v double", *[(float(k),) for k in range(101)], (None,))
    found = quantiles.exact_quantiles(df, "v", [], [0.1, 0.5])
    assert found.columns == ["quantiles"] and found.first()[0] == [10.0, 50.0]
    assert quantiles.exact_quantiles(df, "v", [], [0.1, 0.5], hot_rows=5, accuracy=10).first()[0] == [10.0, 50.0]


def test_repeated_keys_fail_even_if_only_left_columns_are_used(spark):
    left = make(spark, "k int, v int", (1, 1), (2, 2))
    right = make(spark, "k int, w int", (1, 1), (1, 2), (2, 3))
    with pytest.raises(FAILURE, match="more than one row"):
        relations.left_join(left, right, "k", unique=True).select("k", "v").collect()
