"""What the plans look like: pruned scans, pushed filters, shuffles that are shared."""

import pytest
from pyspark.sql import functions as F

from oeuvre.catalogue import queries as catalogue
from oeuvre.catalogue.tables import Tables
from oeuvre.operators import authorship, sample
from oeuvre.operators.skew import lookup_join

FOLDER = "/root/testdata/sf0.001"
ROOMY = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1"}


@pytest.fixture
def no_small_tables(spark):
    """Plans as for tables too large to broadcast."""
    for key, value in ROOMY.items():
        spark.conf.set(key, value)
    yield
    for key in ROOMY:
        spark.conf.unset(key)


def planned(df):
    return df._jdf.queryExecution().executedPlan().toString()


def final(df):
    df.collect()
    return planned(df).split("+- == Initial Plan ==")[0]


def test_filters_and_columns_reach_the_scan(spark):
    t = Tables(spark, FOLDER)
    plan = planned(sample.topic_matches(sample.topic_fields(t.ontology, t.fields), t.scores))
    assert "ReadSchema: struct<l_orderkey:bigint,l_partkey:bigint,l_discount:double>" in plan
    plan = planned(catalogue.region_baseline(t))
    assert "ReadSchema: struct<o_orderkey:bigint,o_orderdate:timestamp_ntz>" in plan
    assert "ReadSchema: struct<l_orderkey:bigint,l_suppkey:bigint>" in plan


def test_sample_filters_are_pushed_down(spark, tmp_path):
    spark.createDataFrame([], "paperid bigint, fieldofstudyid bigint, score double, rest string").write.parquet(f"{tmp_path}/s")
    Tables(spark, FOLDER).papers.write.parquet(f"{tmp_path}/p")
    topics = spark.createDataFrame([], "fieldofstudyid bigint, SDG_label string")
    plan = planned(sample.topic_matches(topics, spark.read.parquet(f"{tmp_path}/s")))
    assert "GreaterThanOrEqual(score,0.497)" in plan
    assert "ReadSchema: struct<paperid:bigint,fieldofstudyid:bigint,score:double>" in plan
    spark.conf.set("spark.sql.maxMetadataStringLength", "1000")
    plan = planned(sample.eligible_papers(spark.read.parquet(f"{tmp_path}/p")))
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    for pushed in ("GreaterThanOrEqual(year,2006)", "LessThanOrEqual(year,2020)", "Not(EqualTo(doi,))"):
        assert pushed in plan
    assert "Or(IsNotNull(journalid),IsNotNull(conferenceinstanceid))" in plan


def test_bucketed_tables_need_no_shuffle_by_paper(spark, no_small_tables):
    t = Tables(spark, FOLDER)
    spark.sql("CREATE DATABASE IF NOT EXISTS buckets")
    for name, df in (("papers", t.papers), ("authors", t.authors)):
        df.write.mode("overwrite").bucketBy(4, "paperid").saveAsTable(f"buckets.{name}")
    found = authorship.fractional_corpus(spark.table("buckets.papers"), spark.table("buckets.authors"))
    assert "hashpartitioning(paperid" not in final(found)


def test_heavy_branch_vanishes(spark, no_small_tables):
    """Without heavy papers the split leaves one scan for counting and one for the join."""
    t = Tables(spark, FOLDER)
    rows = authorship.fractional_corpus(t.papers, t.authors)
    plan = final(rows)
    assert "Union" not in plan
    assert plan.count("l_suppkey") > 0 and plan.count("FileScan parquet [l_orderkey") == 1


def test_window_and_join_share_a_shuffle_and_a_sort(spark, no_small_tables):
    """The last place of a paper and the join on the paper take one shuffle of the author rows."""
    t = Tables(spark, FOLDER)
    light, _ = authorship._sides(t.papers.select("paperid", "year"), t.authors, 10**9, last=True)
    plan = final(light)
    assert plan.index("SortMergeJoin") < plan.index("Window")
    assert plan.count("Exchange hashpartitioning") == 2 and plan.count(" Sort [") == 2


def test_count_by_author_reuses_the_shuffle_of_the_join(spark, no_small_tables):
    t = Tables(spark, FOLDER)
    plan = final(authorship.fractional_rows(t.papers.select("paperid", "year"), t.authors))
    assert "Exchange" not in plan[plan.index("Window") : plan.index("SortMergeJoin")]


def test_heavy_rows_are_not_shuffled(spark, no_small_tables):
    t = Tables(spark, FOLDER)
    _, rest = authorship._sides(t.papers.select("paperid", "year"), t.authors, 3)
    plan = final(rest)
    assert plan.count("BroadcastHashJoin") >= 2 and "SortMergeJoin" not in plan


@pytest.mark.parametrize("hot_rows", [100, None])
def test_rows_without_a_match_are_spread(spark, no_small_tables, hot_rows):
    """Rows with a null or heavy key do not meet in one partition."""
    key = "CASE WHEN id % 3 = 0 THEN NULL WHEN id % 3 = 1 THEN 7 ELSE id END"
    rows = spark.range(9000).selectExpr("id", f"CAST({key} AS BIGINT) AS k")
    lookup = spark.range(5000).selectExpr("id AS k", "id AS v")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        joined = lookup_join(rows, lookup, "k", hot_rows).withColumn("part", F.spark_partition_id())
        counts = joined.groupBy("part", "k").count().collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert sum(r["count"] for r in counts) == 9000
    assert max(r["count"] for r in counts if r.k is None) < 1500
    if hot_rows:
        assert max(r["count"] for r in counts if r.k == 7) < 1500


def test_prestige_bins_are_built_without_a_job(spark):
    tables = Tables(spark, FOLDER)
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("building", "no job may run")
    try:
        for name in ("quintile_share", "quintile_bins", "quintile_baseline", "quartile_bins", "ranked_boxstats"):
            catalogue.QUERIES[name](tables)
        assert not tracker.getJobIdsForGroup("building")
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
