"""The driver's tables in the shape of the library's inputs.

Orders play papers, line items their authorships and field scores, parts fields
of study and people, suppliers affiliations.  The driver's tables have no nulls,
so some are put in.  Every table is read whole and mapped row by row or by a
combined aggregate; nothing is gathered.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

from oeuvre.sources.files import parquet

# Stated, so that opening a table reads no file footers.
SCHEMAS = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": """o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double,
        o_orderdate timestamp_ntz, o_orderpriority string""",
    "lineitem": """l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double,
        l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string,
        l_shipdate timestamp_ntz""",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
}

LABEL = """CASE WHEN l_returnflag = 'A' AND l_linestatus = 'O' THEN 'SDG_2'
    WHEN l_returnflag = 'N' AND l_linestatus = 'F' THEN 'SDG_3'
    WHEN l_returnflag = 'R' AND l_linestatus = 'O' THEN 'SDG_13' END"""
TOPIC = "CASE p_type WHEN 'ECONOMY' THEN 'SDG_2' WHEN 'PROMO' THEN 'SDG_3' WHEN 'SMALL' THEN 'SDG_13' ELSE 'SDG_7' END"
INCOME = """CASE n_nationkey % 5 WHEN 0 THEN 'High income' WHEN 1 THEN 'Upper middle income'
    WHEN 2 THEN 'Lower middle income' WHEN 3 THEN 'Low income' END"""
GENDER = "CASE p_size % 3 WHEN 0 THEN 'female' WHEN 1 THEN 'male' ELSE 'unknown' END"


class Tables:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        self._read: dict[str, DataFrame] = {}

    def raw(self, name: str) -> DataFrame:
        if name not in self._read:
            self._read[name] = parquet(self.spark, f"{self.folder}/{name}.parquet", schema=SCHEMAS[name])
        return self._read[name]

    @cached_property
    def papers(self) -> DataFrame:
        return self.raw("orders").selectExpr(
            "o_orderkey AS paperid",
            "CASE WHEN o_orderkey % 13 = 0 THEN '' ELSE concat('10.1/', o_orderkey) END AS doi",
            "o_orderpriority AS doctype",
            "concat('Title ', o_orderkey) AS papertitle",
            "concat('Title ', o_orderkey) AS originaltitle",
            "CAST(NULL AS STRING) AS booktitle",
            "year(o_orderdate) AS year",
            "CAST(o_orderdate AS DATE) AS date",
            "concat('Publisher ', o_custkey % 7) AS publisher",
            "CASE WHEN o_orderkey % 2 = 0 THEN o_custkey END AS journalid",
            "CASE WHEN o_custkey % 5 = 0 THEN o_custkey END AS conferenceinstanceid",
            "o_custkey % 40 AS referencecount",
            "o_totalprice AS citationcount",
            "o_orderstatus AS originalvenue",
            "CAST(NULL AS BIGINT) AS familyid",
            "CASE WHEN o_orderkey % 19 <> 0 THEN o_orderstatus <> 'O' END AS is_oa",
            "CASE WHEN o_orderkey % 17 <> 0 THEN o_totalprice END AS citations_norm",
        )

    @cached_property
    def labels(self) -> DataFrame:
        rows = self.raw("lineitem").selectExpr("l_orderkey AS paperid", f"{LABEL} AS SDG_label")
        return rows.filter("SDG_label IS NOT NULL").distinct()

    @cached_property
    def labelled(self) -> DataFrame:
        """Papers of the sample, one row for each label."""
        return self.papers.join(self.labels, "paperid")

    @cached_property
    def authors(self) -> DataFrame:
        return self.raw("lineitem").selectExpr(
            "l_orderkey AS paperid",
            "CASE WHEN l_partkey % 97 <> 0 THEN l_partkey END AS authorid",
            "CASE WHEN l_suppkey % 17 <> 0 THEN l_suppkey END AS affiliationid",
            "l_linenumber AS authorsequencenumber",
        )

    @cached_property
    def scores(self) -> DataFrame:
        return self.raw("lineitem").selectExpr(
            "l_orderkey AS paperid", "l_partkey AS fieldofstudyid", "l_discount * 10 AS score"
        )

    @cached_property
    def fields(self) -> DataFrame:
        return self.raw("part").selectExpr("p_partkey AS fieldofstudyid", "p_name AS displayname", "p_size % 6 AS level")

    @cached_property
    def ontology(self) -> DataFrame:
        part = self.raw("part")
        first = part.selectExpr(f"{TOPIC} AS SDG_label", "p_partkey AS fos_id")
        second = part.filter("p_brand = 'Brand#1'").selectExpr("'SDG_3' AS SDG_label", "p_partkey AS fos_id")
        return first.unionByName(second)

    @cached_property
    def nations(self) -> DataFrame:
        region = self.raw("region").withColumnRenamed("r_regionkey", "n_regionkey")
        return self.raw("nation").join(region, "n_regionkey")

    @cached_property
    def affiliations(self) -> DataFrame:
        nation = self.raw("nation").selectExpr("n_nationkey AS s_nationkey", "n_name")
        return self.raw("supplier").join(nation, "s_nationkey").selectExpr(
            "s_suppkey AS affiliationid",
            "s_name AS displayname",
            "CAST(floor(s_acctbal / 100) AS INT) AS rank",
            "CASE WHEN s_suppkey % 11 <> 0 THEN n_name END AS country",
        )

    @cached_property
    def second_source(self) -> DataFrame:
        nation = self.raw("nation").selectExpr("n_nationkey AS s_nationkey", "n_name")
        return self.raw("supplier").join(nation, "s_nationkey").selectExpr(
            "s_suppkey AS affiliationid",
            "CASE WHEN s_suppkey % 33 <> 0 THEN concat('N', s_nationkey) END AS country_code",
            "CASE WHEN s_suppkey % 33 = 0 THEN NULL WHEN s_suppkey % 9 = 0 THEN 'NATION_0' ELSE n_name END AS Alpha3",
        )

    @cached_property
    def countries(self) -> DataFrame:
        return self.nations.selectExpr(
            "n_name AS country_code",
            "concat('Land ', n_nationkey) AS country_name",
            "r_name AS continent",
            "CASE WHEN n_nationkey <> 24 THEN r_name END AS sub_continent",
        )

    @cached_property
    def incomes(self) -> DataFrame:
        return self.nations.selectExpr(
            "n_name AS country_code",
            "r_name AS region",
            "concat('Land ', n_nationkey) AS short_name",
            f"{INCOME} AS income_group",
            "CASE WHEN n_nationkey % 8 <> 7 THEN concat('Coin ', n_nationkey) END AS currency_unit",
        )

    @cached_property
    def income_groups(self) -> DataFrame:
        return self.incomes.select("country_code", "region", "short_name", "income_group")

    @cached_property
    def open_access(self) -> DataFrame:
        """Up to three places for each paper, the second of which is the best one."""
        return self.raw("orders").selectExpr(
            "CASE WHEN o_orderkey % 13 = 0 THEN '' ELSE concat('10.1/', o_orderkey) END AS doi",
            "CASE WHEN o_orderkey % 19 <> 0 THEN o_orderstatus <> 'O' END AS is_oa",
            "o_orderpriority AS oa_status",
            "CASE WHEN o_custkey % 6 <> 0 THEN o_custkey % 2 = 0 END AS has_repository_copy",
            """transform(filter(array(0, 1, 2), i -> i < o_orderkey % 4), i -> named_struct(
                'is_best', i = 1 OR (i = 2 AND o_custkey % 10 = 0),
                'host_type', CASE (o_custkey + i) % 3 WHEN 0 THEN 'publisher' WHEN 1 THEN 'repository' END
            )) AS oa_locations""",
        ).filter("doi <> ''")

    @cached_property
    def funders(self) -> DataFrame:
        """One report for some papers and a second one for some of those."""
        return self.raw("orders").selectExpr(
            "concat('10.1/', o_orderkey) AS doi",
            """explode(CASE o_orderpriority WHEN '1-URGENT' THEN array('Funder A', 'Funder B')
                WHEN '2-HIGH' THEN array('Funder A') ELSE array() END) AS funder""",
        )

    @cached_property
    def journal_averages(self) -> DataFrame:
        rows = self.raw("orders").selectExpr("o_custkey AS journalid", "year(o_orderdate) AS year", "o_totalprice AS c")
        return rows.groupBy("journalid", "year").agg({"c": "avg"}).withColumnRenamed("avg(c)", "mean_citations")

    @cached_property
    def conferences(self) -> DataFrame:
        rows = self.raw("orders").selectExpr("o_custkey AS conferenceinstanceid", "o_totalprice")
        sums = rows.groupBy("conferenceinstanceid").agg({"o_totalprice": "sum", "*": "count"})
        return sums.selectExpr(
            "conferenceinstanceid",
            "`sum(o_totalprice)` AS citationcount",
            "CASE WHEN conferenceinstanceid % 50 = 0 THEN 0 ELSE `count(1)` END AS papercount",
        )

    @cached_property
    def ranking(self) -> DataFrame:
        """Sixty universities by year, with entries of another field and counting method."""
        rows = self.raw("lineitem").selectExpr(
            "l_suppkey % 60 AS u", "year(l_shipdate) AS y", "CAST(l_extendedprice > 50000 AS INT) AS top"
        )
        cells = rows.groupBy("u", "y").agg({"top": "sum", "*": "count"})
        cells = cells.withColumnsRenamed({"sum(top)": "top", "count(1)": "papers"})
        kinds = "inline(array(named_struct('Field', 'All sciences', 'Frac_counting', 1, 'bonus', 0), "
        kinds += "named_struct('Field', 'All sciences', 'Frac_counting', 0, 'bonus', 9), "
        kinds += "named_struct('Field', 'Other sciences', 'Frac_counting', 1, 'bonus', 7)))"
        return cells.selectExpr("*", kinds).selectExpr(
            "concat('U', u) AS University",
            "'Somewhere' AS Country",
            "concat(y - 3, '-', y) AS Period",
            "Field",
            "Frac_counting",
            "CASE WHEN u = 23 THEN 'n/a' ELSE CAST(top + bonus AS STRING) END AS P_top10",
            "CAST(top * 1000 DIV papers AS STRING) AS PP_top10",
            "CASE WHEN u % 7 <> 0 THEN CAST(papers AS STRING) ELSE '' END AS impact_P",
        )

    @cached_property
    def ranking_key(self) -> DataFrame:
        supplier = self.raw("supplier")
        first = supplier.filter("s_acctbal >= 0").selectExpr(
            "s_suppkey AS affiliationid", "concat('U', s_suppkey % 60) AS University"
        )
        second = supplier.filter("s_acctbal > 8000").selectExpr("s_suppkey AS affiliationid", "'U7' AS University")
        return first.unionByName(second)

    @cached_property
    def indicators(self) -> DataFrame:
        nation = self.raw("nation").selectExpr("n_nationkey AS c_nationkey", "n_name")
        return self.raw("customer").join(nation, "c_nationkey").selectExpr(
            "concat('Land ', c_nationkey) AS country_name",
            "n_name AS country_code",
            "c_mktsegment AS indicator_code",
            "concat('Indicator ', c_mktsegment) AS indicator_name",
            "CAST(1995 + c_custkey % 7 AS INT) AS year",
            "CASE WHEN c_custkey % 23 <> 0 THEN c_acctbal END AS value",
        )

    @cached_property
    def people(self) -> DataFrame:
        return self.raw("part").selectExpr("p_partkey AS authorid", f"{GENDER} AS gender")

    @cached_property
    def institution_texts(self) -> DataFrame:
        return self.raw("events").selectExpr(
            """concat('{"id":"I', event_id, '","ids":',
                CASE WHEN event_type = 'error' THEN '{}' ELSE replace(props, '"k"', '"mag"') END,
                ',"country_code":"N', user_id % 30, '","works_count":', user_id,
                ',"geo":{"city":"City ', user_id % 9, '"}}') AS record"""
        )

    @cached_property
    def country_codes(self) -> DataFrame:
        return self.raw("nation").selectExpr("concat('N', n_nationkey) AS Alpha2", "n_name AS Alpha3")

    @cached_property
    def open_counts(self) -> DataFrame:
        """Two count records for each day, as a list."""
        rows = self.raw("events").selectExpr("2000 + day(ts) AS year", "CAST(event_type = 'purchase' AS BIGINT) AS o")
        sums = rows.groupBy("year").agg({"o": "sum", "*": "count"})
        return sums.selectExpr(
            "year",
            """array(named_struct('key_display_name', 'true', 'count', `sum(o)`),
                named_struct('key_display_name', 'false', 'count', `count(1)` - `sum(o)`)) AS records""",
        )
