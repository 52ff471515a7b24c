"""Published counts put through the operators give the published ratios."""

import pytest

from oeuvre.operators import growth, shares

YEARS = range(2006, 2020)

# Published counts by label and year, and of all papers by year.
LABEL_COUNTS = {
    "SDG_13": [11258, 12901, 14244, 15545, 16984, 18628, 20321, 22141, 22648, 23321, 24949, 25589, 24588, 27682],
    "SDG_2": [24977, 27316, 29413, 32931, 34739, 36484, 39228, 43000, 45127, 46797, 49951, 51667, 50716, 55343],
    "SDG_3": [
        380225, 396301, 426540, 473404, 483003, 514579, 556193, 595463, 621774, 651563, 675667, 695826, 649447, 718300
    ],
}
ALL_COUNTS = [
    6564191, 6993059, 7571971, 8138440, 8814818, 9451352, 10121515, 10831002, 11108741, 11414670, 11458368,
    11028696, 11236467, 11371390,
]

# Published authorships of SDG_13 and of all papers by income group and year.
LABEL_INCOMES = {
    "High income": [
        26576, 29810, 32870, 36644, 40889, 45779, 51064, 56252, 57331, 61977, 67594, 67423, 65967, 74904
    ],
    "Upper middle income": [
        3382, 3874, 4687, 5697, 6750, 8838, 9689, 12329, 13964, 16225, 18762, 21313, 25491, 31852
    ],
    "Lower middle income": [756, 809, 1042, 1218, 1407, 1934, 1887, 2320, 2705, 2862, 3504, 3425, 3893, 4729],
    "Low income": [3, 20, 26, 32, 24, 42, 27, 70, 63, 62, 76, 103, 141, 195],
}
ALL_INCOMES = {
    "High income": [
        4171566, 4470446, 4747244, 5132972, 5502948, 6008587, 6791195, 7187052, 7654978, 8025720, 8212762, 8342244,
        8477235, 9157466,
    ],
    "Upper middle income": [
        782675, 944652, 1130787, 1325994, 1513831, 1771764, 1921518, 2162441, 2447933, 2639326, 2817711, 3111696,
        3450928, 4008001,
    ],
    "Lower middle income": [
        121312, 147375, 162934, 189493, 221282, 265016, 323495, 386557, 464884, 526396, 607993, 648162, 700176, 797507
    ],
    "Low income": [2543, 3212, 3704, 4438, 5385, 6593, 7994, 9457, 11872, 13671, 15389, 16673, 19269, 22926],
}


@pytest.fixture(scope="module")
def trend(spark):
    counts = [(g, y, n) for g, series in LABEL_COUNTS.items() for y, n in zip(YEARS, series)]
    sample = spark.createDataFrame(counts, "SDG_label string, year int, n bigint")
    corpus = spark.createDataFrame(list(zip(YEARS, ALL_COUNTS)), "year int, overall_n bigint")
    return shares.share_of_baseline(sample, corpus, "year")


def test_totals(trend):
    totals = {r.SDG_label: r.n for r in shares.sum_by(trend, "n", "SDG_label").collect()}
    assert totals == {"SDG_2": 567689, "SDG_13": 280799, "SDG_3": 7838285}
    assert sum(totals.values()) == 8686773


def test_yearly_growth(trend):
    found = {(r.SDG_label, r.year): r for r in growth.yearly_growth(trend, "prop", "SDG_label").collect()}
    wanted = {
        ("SDG_13", 2006): 0.0, ("SDG_13", 2007): 0.0756628, ("SDG_13", 2019): 0.1124756, ("SDG_2", 2010): -0.0260420,
        ("SDG_3", 2010): -0.0580112, ("SDG_3", 2018): -0.0839115,
    }
    for key, change in wanted.items():
        assert found[key].prop_change == pytest.approx(change, abs=1e-7)
    assert found["SDG_3", 2006].prop == pytest.approx(0.0579241, abs=1e-7)


def test_compound_growth(trend):
    found = growth.compound_growth(trend, {"overall_n": "overall", "n": "individual"}, "SDG_label", 2006, 2019)
    wanted = {
        "SDG_13": (2.458874, 0.0716590), "SDG_2": (2.215759, 0.0631111), "SDG_3": (1.889145, 0.0501496),
    }
    for r in found.collect():
        assert (r.individual_growth_factor, r.individual_growth_rate) == pytest.approx(wanted[r.SDG_label], abs=1e-6)
        assert (r.overall_growth_factor, r.overall_growth_rate) == pytest.approx((1.732337, 0.043173), abs=1e-6)


def test_specialisation(spark):
    def table(groups, columns):
        data = [(y, g, n) for g, series in groups.items() for y, n in zip(YEARS, series)]
        return spark.createDataFrame(data, columns)

    label = shares.share_of_total(table(LABEL_INCOMES, "year int, income_group string, nn bigint"), "nn", "year")
    whole = shares.share_of_total(table(ALL_INCOMES, "year int, income_group string, nn bigint"), "nn", "year")
    ratios = shares.specialisation(label, whole, ["year", "income_group"])
    found = {(r.income_group, r.year): r for r in ratios.collect()}
    wanted = {
        "High income": (1.0532043, 1.0753431, 1.0835830),
        "Upper middle income": (0.7143553, 0.6613383, 0.6486616),
        "Lower middle income": (1.0302441, 0.8852392, 1.0008293),
        "Low income": (0.1950280, 1.0041310, 1.0985160),
    }
    for group, values in wanted.items():
        assert [found[group, y].specialisation for y in (2006, 2007, 2008)] == pytest.approx(values, rel=1e-6)
    assert found["High income", 2006].share_sdg == pytest.approx(0.8651887, rel=1e-6)
    for year in YEARS:
        cells = [found[g, year] for g in wanted]
        assert sum(c.specialisation * c.share for c in cells) == pytest.approx(1)
    means = {r.income_group: r.m for r in shares.mean_by(ratios, "specialisation", "income_group", name="m").collect()}
    rounded = {"High income": 1.07, "Low income": 0.810, "Lower middle income": 0.860, "Upper middle income": 0.783}
    assert means == pytest.approx(rounded, rel=5e-3)
