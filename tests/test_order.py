"""Positions of rows against a sort in memory; one country per affiliation."""

import pytest

from oeuvre.operators import authorship, coverage, order, relations

from conftest import rows


@pytest.mark.parametrize("parts", [1, 7])
def test_positions(spark, parts):
    given = [(None if i % 11 == 0 else "hot" if i % 3 else f"g{i % 5}", (i * 37) % 50 if i % 13 else None) for i in range(400)]
    df = spark.createDataFrame(given, "g string, v int").repartition(5)
    found = order.positions(df, ["-v"], parts=parts).collect()
    assert sorted(r["position"] for r in found) == list(range(400))
    values = [r["v"] for r in sorted(found, key=lambda r: r["position"])]
    assert values == sorted((v for _, v in given), key=lambda v: (v is None, -(v or 0)))
    found = order.positions(df, ["v"], by="g", parts=parts).collect()
    for g in {g for g, _ in given}:
        own = sorted((r["position"], r["v"]) for r in found if r["g"] == g and r["v"] is not None)
        assert [v for _, v in own] == sorted(v for h, v in given if h == g and v is not None)
        assert sorted(r["position"] for r in found if r["g"] == g) == list(range(sum(h == g for h, _ in given)))
    assert order.positions(df.limit(0), ["v"], parts=parts).collect() == []


def test_one_country_per_affiliation(spark):
    seen = spark.createDataFrame([(1, None), (2, None), (3, "AUT")], "affiliationid long, country string")
    source = spark.createDataFrame([(1, "DE", "DEU"), (1, "AT", "AUT"), (2, "XK", None)], "affiliationid long, country_code string, Alpha3 string")
    gaps = coverage.gap_file(seen, source)
    assert rows(gaps, "affiliationid", "country") == [(1, "AUT"), (2, None)]
    missing = seen.where("country IS NULL").select("affiliationid")
    assert rows(coverage.gap_coverage(missing, source)) == [(0.5,)]
    assert rows(relations.backfill(seen, gaps, "affiliationid", "country"), "affiliationid", "country") == [(1, "AUT"), (2, None), (3, "AUT")]


def test_weights_of_a_heavy_group_without_a_paper(spark):
    """Rows without a paper leave the window once they are many; the weights stay."""
    given = [(None, i % 7) for i in range(70)] + [(1, 1), (1, 1), (1, 2), (None, None)]
    df = spark.createDataFrame(given, "paperid long, authorid long")
    whole = rows(authorship.fractional_weight(df))
    assert rows(authorship.fractional_weight(df, hot_rows=5)) == whole
    assert whole.count((None, 3, 0.1)) == 10 and whole.count((1, 1, 0.5)) == 2
