"""Heavy groups take another route and give the same rows."""

import random

import numpy as np
import pytest
from conftest import rows
from pyspark.sql import functions as F

from oeuvre.catalogue.tables import Tables
from oeuvre.operators import authorship, enrich, gender, open_access, quantiles, sample
from oeuvre.operators.skew import heavy_groups, lookup_join, over_groups, split_join

NEVER = 10**9


@pytest.fixture(scope="module")
def skewed(spark):
    """A third of all rows on one key, a third without a key, copies among them."""
    draw = random.Random(7)
    data = [(1, "a", draw.randrange(5)) for _ in range(400)] + [(None, "b", draw.randrange(5)) for _ in range(400)]
    data += [(draw.randrange(2, 150), "c", draw.randrange(5)) for _ in range(400)]
    return spark.createDataFrame(data, "k bigint, s string, v int").repartition(6)


@pytest.mark.parametrize("hot_rows", [0, 3, 300, NEVER])
def test_over_groups(skewed, hot_rows):
    values = {"n": F.count("*"), "top": F.max("v")}
    skewed.createOrReplaceTempView("skewed")
    wanted = skewed.sparkSession.sql(
        "SELECT *, count(*) OVER (PARTITION BY k, s) AS n, max(v) OVER (PARTITION BY k, s) AS top FROM skewed"
    )
    assert rows(over_groups(skewed, ["k", "s"], values, hot_rows)) == rows(wanted)


@pytest.mark.parametrize("hot_rows", [0, 3, 300, NEVER])
@pytest.mark.parametrize("how", ["inner", "left"])
def test_split_join(spark, skewed, how, hot_rows):
    lookup = spark.createDataFrame([(k, f"x{k}") for k in range(1, 100)] + [(5, "again"), (None, "n")], "k bigint, x string")
    assert rows(split_join(skewed, lookup, "k", how, hot_rows)) == rows(skewed.join(lookup, "k", how).select("k", "s", "v", "x"))


@pytest.mark.parametrize("hot_rows", [None, 0, 3, 300, NEVER])
def test_lookup_join(spark, skewed, hot_rows):
    lookup = spark.createDataFrame([(k, f"x{k}", k % 3 or None) for k in range(1, 100)], "k bigint, x string, y int")
    lookup = lookup.unionByName(spark.createDataFrame([(7, "again", None)], lookup.schema))
    wanted = skewed.join(lookup, "k", "left").select("k", "s", "v", "x", "y")
    assert rows(lookup_join(skewed, lookup, "k", hot_rows)) == rows(wanted)


def test_heavy_groups_are_few(skewed):
    assert rows(heavy_groups(skewed, "k", 100)) == [(1,), (None,)]


@pytest.mark.parametrize("hot_rows", [0, 20, NEVER])
@pytest.mark.parametrize("accuracy", [10, 100_000])
def test_exact_quantiles(spark, hot_rows, accuracy):
    """Both routes interpolate exactly, however rough the cuts are."""
    draw = np.random.default_rng(3)
    groups = {"a": draw.lognormal(size=900), "b": draw.integers(0, 4, 500).astype(float), "c": draw.normal(size=7), "d": [2.5], None: draw.random(80)}
    data = [(g, float(v)) for g, values in groups.items() for v in values]
    df = spark.createDataFrame(data + [("a", None), ("c", float("nan")), ("e", None)], "g string, v double")
    probs = [0.0, 0.1, 0.25, 0.5, 0.8, 1.0]
    found = quantiles.exact_quantiles(df, "v", "g", probs, hot_rows=hot_rows, accuracy=accuracy).collect()
    assert {r.g for r in found} == set(groups)
    for r in found:
        assert r.quantiles == pytest.approx(list(np.quantile(groups[r.g], probs)), abs=1e-12)


@pytest.mark.parametrize("hot_rows", [0, 20])
def test_bins_and_boxes(spark, hot_rows):
    draw = random.Random(5)
    data = [(draw.choice(["a", "a", "a", "b", None]), draw.random() * 9 - 1, float(draw.randrange(40))) for _ in range(500)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(data)], "id int, g string, v double, w double")
    bins = lambda hot: rows(quantiles.quantile_bins(df, ["v", "w"], "g", hot_rows=hot))
    boxes = lambda hot: rows(quantiles.box_stats_log10(df, "v", "g", hot_rows=hot))
    assert bins(hot_rows) == bins(NEVER)
    assert boxes(hot_rows) == boxes(NEVER)


ROUTES = {
    "author_groups": lambda t, h: authorship.author_groups(t.authors, hot_rows=h),
    "fractional_weight": lambda t, h: authorship.fractional_weight(t.authors, hot_rows=h),
    "sequence_weight": lambda t, h: authorship.sequence_weight(t.authors, hot_rows=h),
    "papers_with_roles": lambda t, h: authorship.papers_with_roles(
        t.labelled.select("paperid", "SDG_label", "year"), t.authors, t.affiliations, hot_rows=h
    ),
    "country_counts": lambda t, h: authorship.country_counts(
        t.labelled, t.authors, t.affiliations, "year", "author_position", hot_rows=h
    ),
    "institutions": lambda t, h: authorship.institutions_by_output(t.labelled, t.authors, t.affiliations, hot_rows=h),
    "productivity": lambda t, h: authorship.fractional_productivity(t.labelled, t.authors, hot_rows=h),
    "productivity_by_label": lambda t, h: authorship.fractional_productivity(
        t.labelled, t.authors, weight_over="affiliations", hot_rows=h
    ),
    "corpus": lambda t, h: authorship.fractional_corpus(t.papers, t.authors, hot_rows=h),
    "gender": lambda t, h: gender.gender_share(t.labelled, t.authors, t.people, "SDG_label", "author_position", hot_rows=h),
    "open_by_country": lambda t, h: open_access.open_by_country(
        t.labelled, t.authors, t.affiliations, (1996, 1999), "SDG_label", hot_rows=h
    ),
    "matches": lambda t, h: sample.topic_matches(sample.topic_fields(t.ontology, t.fields), t.scores, hot_rows=h),
    "sample_authors": lambda t, h: sample.sample_authors(t.labelled, t.authors, hot_rows=h),
    "profiles": lambda t, h: sample.threshold_profiles(t.scores, t.fields, accuracy=10_000, hot_rows=h),
    "collated": lambda t, h: enrich.collated_papers(
        t.papers.drop("is_oa", "citations_norm"), t.open_access, t.funders, t.journal_averages, t.conferences, hot_rows=h
    ),
    "funders_in_sample": lambda t, h: enrich.funders_in_sample(t.funders, t.papers, hot_rows=h),
}


class Skewed(Tables):
    """Two thirds of the authorships belong to one paper, and a third of the papers lack a DOI."""

    @property
    def authors(self):
        base = super().authors
        hot = base.filter("affiliationid < 7").withColumn("paperid", F.lit(3).cast("bigint"))
        return base.unionByName(hot).unionByName(hot)

    @property
    def papers(self):
        return super().papers.withColumn("doi", F.when(F.col("paperid") % 3 > 0, F.col("doi")).otherwise(""))


@pytest.mark.parametrize("name", ROUTES)
def test_analytics_take_both_routes(spark, name):
    tables = Skewed(spark, "/root/testdata/sf0.001")
    plain = [tuple(r) for r in rows(ROUTES[name](tables, NEVER))]
    split = [tuple(r) for r in rows(ROUTES[name](tables, 20))]
    assert len(plain) == len(split) > 0
    for a, b in zip(plain, split):
        for x, y in zip(a, b):
            assert x == pytest.approx(y, rel=1e-9) if isinstance(x, float) else x == y


@pytest.mark.parametrize("hot_rows", [2, 1000, None])
@pytest.mark.parametrize("left, right", [("int", "bigint"), ("bigint", "string"), ("string", "int"), ("decimal(12,0)", "bigint")])
def test_lookup_join_of_different_key_types(spark, hot_rows, left, right):
    df = spark.range(40).selectExpr(f"CAST(nullif(id % 8, 7) AS {left}) AS k", "id")
    lookup = spark.range(6).selectExpr(f"CAST(id AS {right}) AS k", "id * 10 AS v")
    found = lookup_join(df, lookup, "k", hot_rows=hot_rows)
    wanted = df.alias("a").join(lookup.alias("b"), F.expr("a.k = b.k"), "left").selectExpr("a.id", "b.v")
    assert rows(found, "id", "v") == rows(wanted) and found.filter("v IS NOT NULL").count() == 30


def test_gender_aggregates_hold_no_row_for_each_author(spark):
    papers = spark.createDataFrame([(1, 2000, "a"), (2, 2000, "b"), (3, 2000, "b")], "paperid long, year int, SDG_label string")
    authors = [(1, 10, 1), (1, 11, 2), (1, None, 3), (2, 10, 1), (2, 12, 2), (4, 10, 1)]
    authors = spark.createDataFrame(authors, "paperid long, authorid long, authorsequencenumber int")
    people = [(10, "female"), (11, "male"), (11, "female"), (12, "unknown"), (None, "male")]
    people = spark.createDataFrame(people, "authorid long, gender string")
    keys = ["SDG_label", "year", "author_position"]
    for k, expected in (
        (keys[:2], [("a", 2000, "female", 2, 2 / 3), ("a", 2000, "male", 1, 1 / 3), ("b", 2000, "female", 1, 1.0)]),
        (
            keys,
            [
                ("a", 2000, "first_author", "female", 1, 1.0),
                ("a", 2000, "middle_author", "female", 1, 0.5),
                ("a", 2000, "middle_author", "male", 1, 0.5),
                ("b", 2000, "first_author", "female", 1, 1.0),
            ],
        ),
    ):
        found = gender.gender_share(papers, authors, people, *k)
        got = sorted(tuple(r) for r in found.collect())
        assert [r[:-1] for r in got] == [r[:-1] for r in expected]
        assert all(abs(r[-1] - e[-1]) < 1e-9 for r, e in zip(got, expected, strict=True))
        plan = found._jdf.queryExecution().optimizedPlan().toString()
        grouped = [line.split("Aggregate [")[1].split("]")[0] for line in plan.splitlines() if "Aggregate [" in line]
        assert grouped and not [g for g in grouped if "authorid" in g and "SDG_label" in g]
