"""Rules that hold for any input."""

import numpy as np
import pytest
from conftest import rows
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from oeuvre.catalogue import queries as catalogue
from oeuvre.catalogue.tables import Tables
from oeuvre.operators import authorship, prestige, quantiles, shares
from oeuvre.operators.relations import left_join

FEW = settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
VALUES = st.floats(-1e6, 1e6).map(lambda v: round(v, 3))


@pytest.fixture(scope="module")
def tables(spark):
    return Tables(spark, "/root/testdata/sf0.001")


@FEW
@given(st.lists(st.tuples(st.sampled_from("abc"), VALUES), min_size=1, max_size=60))
def test_quantiles_match_numpy(spark, data):
    probs = [0.0, 0.2, 0.5, 0.9, 1.0]
    df = spark.createDataFrame(data, "g string, v double")
    for hot_rows in (0, 10**9):
        for r in quantiles.exact_quantiles(df, "v", "g", probs, hot_rows=hot_rows, accuracy=20).collect():
            wanted = np.quantile([v for g, v in data if g == r.g], probs)
            assert r.quantiles == pytest.approx(list(wanted), rel=1e-9, abs=1e-9)


@FEW
@given(st.lists(st.tuples(st.integers(1, 4), st.one_of(st.none(), st.integers(1, 3)), st.integers(1, 3)), min_size=1, max_size=40))
def test_weights_of_an_author_sum_to_one(spark, data):
    df = spark.createDataFrame(data, "paperid bigint, authorid bigint, affiliationid bigint")
    for hot_rows in (2, 10**9):
        sums = authorship.fractional_weight(df, hot_rows=hot_rows).groupBy("paperid", "authorid").agg(F.sum("frac_value").alias("w"))
        assert all(r.w == pytest.approx(1) for r in sums.collect())


def test_shares_sum_to_one(tables):
    for name, within in (("region_share", ["SDG_label", "year"]), ("income_baseline", ["year"]), ("quintile_share", ["SDG_label", "year"])):
        found = catalogue.QUERIES[name](tables)
        value = "share" if "share" in found.columns else "prop"
        assert all(r.s == pytest.approx(1, abs=1e-5) for r in found.groupBy(*within).agg(F.sum(value).alias("s")).collect())


def test_bins_follow_the_values(tables):
    matched = catalogue.matched(tables).filter(F.col("P_top10").isNotNull()).withColumn("value", F.col("P_top10"))
    binned = prestige.prestige_bins(matched)
    ends = binned.groupBy("Period", "P_top10").agg(F.min("value").alias("low"), F.max("value").alias("high")).collect()
    order = {label: i for i, label in enumerate(quantiles.QUINTILES)}
    for period in {r.Period for r in ends}:
        steps = sorted((r for r in ends if r.Period == period), key=lambda r: order[r.P_top10])
        assert all(a.high <= b.low for a, b in zip(steps, steps[1:]))


def test_joins_on_unique_keys_keep_the_rows(tables):
    joined = left_join(tables.authors, tables.affiliations, "affiliationid", unique=True)
    assert joined.count() == tables.authors.count()
    assert rows(joined, *tables.authors.columns) == rows(tables.authors)


def test_country_counts_keep_every_authorship(tables):
    total = authorship.country_counts(tables.labelled, tables.authors, tables.affiliations, "year").agg(F.sum("n")).first()[0]
    assert total == tables.labelled.join(tables.authors, "paperid", "left").count()


def test_growth_of_a_constant_share_is_zero(spark):
    counts = spark.createDataFrame([("a", y, 10 * y) for y in range(1, 6)], "SDG_label string, year int, n bigint")
    base = spark.createDataFrame([(y, 100 * y) for y in range(1, 6)], "year int, overall_n bigint")
    assert {r.prop for r in shares.share_of_baseline(counts, base, "year").collect()} == {0.1}
