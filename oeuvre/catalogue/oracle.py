"""The queries once more, as plain SQL over the driver's tables.

``PARTS`` are named subqueries.  A query lists the ones it needs, and those they
need in turn are found by name.
"""

from __future__ import annotations

import re

PARTS: dict[str, str] = {}
QUERIES: dict[str, str] = {}

# Input tables ----------------------------------------------------------------

PARTS["papers"] = """
SELECT o_orderkey AS paperid,
    CASE WHEN o_orderkey % 13 = 0 THEN '' ELSE '10.1/' || o_orderkey END AS doi,
    o_orderpriority AS doctype, 'Title ' || o_orderkey AS papertitle,
    CAST(year(o_orderdate) AS INT) AS year, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS date,
    CASE WHEN o_orderkey % 2 = 0 THEN o_custkey END AS journalid,
    CASE WHEN o_custkey % 5 = 0 THEN o_custkey END AS conferenceinstanceid,
    o_totalprice AS citationcount,
    CASE WHEN o_orderkey % 19 <> 0 THEN o_orderstatus <> 'O' END AS is_oa,
    CASE WHEN o_orderkey % 17 <> 0 THEN o_totalprice END AS citations_norm
FROM orders"""
PARTS["paper_labels"] = """
SELECT DISTINCT l_orderkey AS paperid,
    CASE l_returnflag || l_linestatus WHEN 'AO' THEN 'SDG_2' WHEN 'NF' THEN 'SDG_3' ELSE 'SDG_13' END AS SDG_label
FROM lineitem WHERE l_returnflag || l_linestatus IN ('AO', 'NF', 'RO')"""
PARTS["labelled"] = "SELECT p.*, l.SDG_label FROM papers p JOIN paper_labels l USING (paperid)"
PARTS["authors"] = """
SELECT l_orderkey AS paperid, CASE WHEN l_partkey % 97 <> 0 THEN l_partkey END AS authorid,
    CASE WHEN l_suppkey % 17 <> 0 THEN l_suppkey END AS affiliationid, l_linenumber AS authorsequencenumber
FROM lineitem"""
PARTS["scores"] = "SELECT l_orderkey AS paperid, l_partkey AS fieldofstudyid, l_discount * 10 AS score FROM lineitem"
PARTS["fields"] = "SELECT p_partkey AS fieldofstudyid, p_size % 6 AS level FROM part"
PARTS["ontology"] = """
SELECT CASE p_type WHEN 'ECONOMY' THEN 'SDG_2' WHEN 'PROMO' THEN 'SDG_3' WHEN 'SMALL' THEN 'SDG_13' ELSE 'SDG_7' END
    AS SDG_label, p_partkey AS fos_id FROM part
UNION ALL SELECT 'SDG_3', p_partkey FROM part WHERE p_brand = 'Brand#1'"""
PARTS["affiliations"] = """
SELECT s_suppkey AS affiliationid, s_name AS displayname, CAST(floor(s_acctbal / 100) AS INT) AS rank,
    CASE WHEN s_suppkey % 11 <> 0 THEN n_name END AS country
FROM supplier JOIN nation ON s_nationkey = n_nationkey"""
PARTS["second_source"] = """
SELECT s_suppkey AS affiliationid, CASE WHEN s_suppkey % 33 <> 0 THEN 'N' || n_nationkey END AS country_code,
    CASE WHEN s_suppkey % 33 = 0 THEN NULL WHEN s_suppkey % 9 = 0 THEN 'NATION_0' ELSE n_name END AS Alpha3
FROM supplier JOIN nation ON s_nationkey = n_nationkey"""
PARTS["filled"] = """
SELECT a.affiliationid, a.displayname, a.rank, coalesce(a.country, s.Alpha3) AS country
FROM affiliations a LEFT JOIN second_source s USING (affiliationid)"""
PARTS["countries"] = """
SELECT n_name AS country_code, r_name AS continent, CASE WHEN n_nationkey <> 24 THEN r_name END AS sub_continent
FROM nation JOIN region ON n_regionkey = r_regionkey"""
PARTS["incomes"] = """
SELECT n_name AS country_code, r_name AS region, 'Land ' || n_nationkey AS short_name,
    CASE n_nationkey % 5 WHEN 0 THEN 'High income' WHEN 1 THEN 'Upper middle income'
        WHEN 2 THEN 'Lower middle income' WHEN 3 THEN 'Low income' END AS income_group,
    CASE WHEN n_nationkey % 8 <> 7 THEN 'Coin ' || n_nationkey END AS currency_unit
FROM nation JOIN region ON n_regionkey = r_regionkey"""
PARTS["open_access"] = """
SELECT '10.1/' || o_orderkey AS doi, CASE WHEN o_orderkey % 19 <> 0 THEN o_orderstatus <> 'O' END AS is_oa,
    o_orderpriority AS oa_status, CASE WHEN o_custkey % 6 <> 0 THEN o_custkey % 2 = 0 END AS has_repository_copy,
    o_orderkey, o_custkey
FROM orders WHERE o_orderkey % 13 <> 0"""
PARTS["places"] = """
SELECT o.*, i, (i = 1 OR (i = 2 AND o_custkey % 10 = 0)) AS is_best,
    CASE (o_custkey + i) % 3 WHEN 0 THEN 'publisher' WHEN 1 THEN 'repository' END AS host_type
FROM open_access o, (VALUES (0), (1), (2)) AS v(i) WHERE i < o_orderkey % 4"""
PARTS["provider"] = """
SELECT doi, is_oa, oa_status, has_repository_copy,
    CASE WHEN host_type = 'publisher' AND has_repository_copy THEN 'Journal & Repository'
        WHEN host_type = 'repository' THEN 'Repository only' WHEN host_type = 'publisher' THEN 'Journal only' END
        AS provider_cat
FROM (SELECT DISTINCT doi, is_oa, oa_status, has_repository_copy, host_type FROM places WHERE is_best) AS best
UNION ALL SELECT doi, is_oa, oa_status, has_repository_copy, 'Not OA' FROM open_access WHERE NOT is_oa"""
PARTS["funders"] = """
SELECT '10.1/' || o_orderkey AS doi, 'Funder A' AS funder FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH')
UNION ALL SELECT '10.1/' || o_orderkey, 'Funder B' FROM orders WHERE o_orderpriority = '1-URGENT'"""
PARTS["journals"] = """
SELECT o_custkey AS journalid, CAST(year(o_orderdate) AS INT) AS year, avg(o_totalprice) AS mean_citations
FROM orders GROUP BY ALL"""
PARTS["conferences"] = """
SELECT o_custkey AS conferenceinstanceid,
    sum(o_totalprice) / nullif(CASE WHEN o_custkey % 50 = 0 THEN 0 ELSE count(*) END, 0) AS mean_conf_citations
FROM orders GROUP BY o_custkey"""
PARTS["normalised"] = """
SELECT p.paperid, p.doi, p.year, p.journalid, p.conferenceinstanceid, j.mean_citations, c.mean_conf_citations,
    CASE WHEN p.conferenceinstanceid IS NOT NULL THEN p.citationcount / c.mean_conf_citations
        WHEN p.journalid IS NOT NULL THEN p.citationcount / j.mean_citations END AS citations_norm
FROM papers p LEFT JOIN journals j ON p.journalid = j.journalid AND p.year = j.year
LEFT JOIN conferences c ON p.conferenceinstanceid = c.conferenceinstanceid"""
PARTS["ranking"] = """
SELECT 'U' || u AS University, 'Somewhere' AS Country, (y - 3) || '-' || y AS Period,
    CASE WHEN u <> 23 THEN CAST(top AS DOUBLE) END AS P_top10,
    CAST(top * 1000 // papers AS DOUBLE) AS PP_top10,
    CASE WHEN u % 7 <> 0 THEN CAST(papers AS DOUBLE) END AS impact_P, CAST(y AS INT) AS last_year_of_period
FROM (SELECT l_suppkey % 60 AS u, year(l_shipdate) AS y, count(*) FILTER (WHERE l_extendedprice > 50000) AS top,
        count(*) AS papers FROM lineitem GROUP BY ALL) AS cells"""
PARTS["ranking_key"] = """
SELECT s_suppkey AS affiliationid, 'U' || (s_suppkey % 60) AS University FROM supplier WHERE s_acctbal >= 0
UNION ALL SELECT s_suppkey, 'U7' FROM supplier WHERE s_acctbal > 8000"""
PARTS["indicators"] = """
SELECT 'Land ' || c_nationkey AS country_name, n_name AS country_code, c_mktsegment AS indicator_code,
    'Indicator ' || c_mktsegment AS indicator_name, 1995 + c_custkey % 7 AS year,
    CASE WHEN c_custkey % 23 <> 0 THEN c_acctbal END AS value
FROM customer JOIN nation ON c_nationkey = n_nationkey"""
PARTS["people"] = """
SELECT p_partkey AS authorid, CASE p_size % 3 WHEN 0 THEN 'female' WHEN 1 THEN 'male' ELSE 'unknown' END AS gender
FROM part"""

# Steps shared by several queries ---------------------------------------------

PARTS["matches"] = """
SELECT s.paperid, s.fieldofstudyid, o.SDG_label
FROM ontology o JOIN fields f ON o.fos_id = f.fieldofstudyid JOIN scores s ON s.fieldofstudyid = f.fieldofstudyid
WHERE o.SDG_label IN ('SDG_2', 'SDG_3', 'SDG_13') AND f.level <= 3 AND s.score >= 0.497::DOUBLE"""
PARTS["sampled"] = """
SELECT DISTINCT p.paperid, m.SDG_label, p.doi, p.doctype, p.year, p.date, p.journalid, p.conferenceinstanceid
FROM matches m JOIN papers p USING (paperid)
WHERE p.year BETWEEN 1996 AND 2000 AND (p.journalid IS NOT NULL OR p.conferenceinstanceid IS NOT NULL) AND p.doi <> ''"""
PARTS["yearly"] = """
SELECT SDG_label, year, n, overall_n, n::DOUBLE / overall_n AS prop
FROM (SELECT SDG_label, year, count(*) AS n FROM labelled GROUP BY ALL) AS a
JOIN (SELECT year, count(*) AS overall_n FROM papers GROUP BY ALL) AS b USING (year) WHERE year BETWEEN 1995 AND 2000"""
PARTS["roles"] = """
SELECT *, CASE max(authorsequencenumber) OVER (PARTITION BY paperid)
        WHEN 1 THEN 'single' WHEN 2 THEN 'double' ELSE 'multi' END AS paper_author_cat,
    CASE WHEN max(authorsequencenumber) OVER (PARTITION BY paperid) = 1 THEN 'first_author'
        WHEN authorsequencenumber = 1 THEN 'first_author'
        WHEN authorsequencenumber = max(authorsequencenumber) OVER (PARTITION BY paperid) THEN 'last_author'
        ELSE 'middle_author' END AS author_position
FROM authors"""
PARTS["authored"] = """
SELECT p.paperid, p.SDG_label, p.year, r.authorid, r.affiliationid, r.authorsequencenumber, a.country,
    r.paper_author_cat, r.author_position
FROM labelled p LEFT JOIN roles r ON p.paperid = r.paperid
LEFT JOIN affiliations a ON r.affiliationid = a.affiliationid"""
PARTS["label_cells"] = "SELECT country, year, SDG_label, count(*) AS n FROM authored GROUP BY ALL"
PARTS["corpus_cells"] = """
SELECT f.country, p.year, count(*) AS n
FROM papers p LEFT JOIN authors a ON p.paperid = a.paperid LEFT JOIN filled f ON a.affiliationid = f.affiliationid
WHERE p.year BETWEEN 1995 AND 2000 GROUP BY ALL"""
for place, lookup, group, test in (
    ("region", "countries", "sub_continent", "sub_continent IS NOT NULL"),
    ("income", "incomes", "income_group", "income_group IS NOT NULL"),
):
    PARTS[f"{place}_label"] = f"""
    SELECT SDG_label, year, {group}, CAST(sum(n) AS BIGINT) AS nn,
        sum(n)::DOUBLE / sum(sum(n)) OVER (PARTITION BY SDG_label, year) AS share
    FROM label_cells JOIN {lookup} ON country = country_code WHERE {test} GROUP BY SDG_label, year, {group}"""
    PARTS[f"{place}_corpus"] = f"""
    SELECT year, {group}, CAST(sum(n) AS BIGINT) AS nn,
        sum(n)::DOUBLE / sum(sum(n)) OVER (PARTITION BY year) AS share
    FROM corpus_cells JOIN {lookup} ON country = country_code WHERE {test} GROUP BY year, {group}"""
    PARTS[f"{place}_ratio"] = f"""
    SELECT s.SDG_label, s.year, s.{group}, s.nn AS nn_sdg, s.share AS share_sdg, b.nn, b.share,
        s.share / b.share AS specialisation
    FROM {place}_label s LEFT JOIN {place}_corpus b ON s.year = b.year AND s.{group} = b.{group}"""
PARTS["weighted"] = """
SELECT p.SDG_label, p.year, p.is_oa, p.citations_norm, a.affiliationid,
    1.0::DOUBLE / count(*) OVER (PARTITION BY a.authorid, p.paperid) AS w,
    1.0::DOUBLE / count(*) OVER (PARTITION BY a.authorid, p.paperid, p.SDG_label) AS w_label
FROM labelled p LEFT JOIN authors a ON p.paperid = a.paperid"""
PARTS["output"] = """
SELECT affiliationid, year, SDG_label, sum(w) AS n_frac_papers,
    coalesce(sum(w) FILTER (WHERE is_oa), 0) AS n_frac_oa_papers,
    coalesce(sum(w * citations_norm), 0) AS n_frac_citations
FROM weighted GROUP BY ALL"""
PARTS["corpus_output"] = """
SELECT affiliationid, year, sum(w) AS n_frac_papers
FROM (SELECT p.year, a.affiliationid, 1.0::DOUBLE / count(*) OVER (PARTITION BY a.authorid, p.paperid) AS w
    FROM papers p LEFT JOIN authors a ON p.paperid = a.paperid) AS rows
WHERE affiliationid IS NOT NULL GROUP BY ALL"""
PARTS["matched"] = """
SELECT o.affiliationid, o.year, o.SDG_label, o.n_frac_papers, o.n_frac_oa_papers, o.n_frac_citations, k.University,
    r.Country, r.Period, r.P_top10, r.PP_top10, r.impact_P
FROM output o LEFT JOIN ranking_key k USING (affiliationid)
LEFT JOIN ranking r ON k.University = r.University AND o.year = r.last_year_of_period"""
PARTS["matched_corpus"] = """
SELECT o.year, o.n_frac_papers, r.Period, r.P_top10
FROM corpus_output o JOIN ranking_key k USING (affiliationid)
JOIN ranking r ON k.University = r.University AND o.year = r.last_year_of_period WHERE r.P_top10 IS NOT NULL"""


def bin_case(column: str, breaks: str) -> str:
    names = ["p[0,20]", "p(20,40]", "p(40,60]", "p(60,80]", "p(80,100]"]
    whens = " ".join(f"WHEN {column} <= {breaks}[{i + 2}] THEN '{name}'" for i, name in enumerate(names))
    return f"CASE {whens} END"


CUTS = "[0, 0.2, 0.4, 0.6, 0.8, 1]"
PARTS["breaks"] = f"""
SELECT Period, quantile_cont(P_top10, {CUTS}) AS b1, quantile_cont(PP_top10, {CUTS}) AS b2,
    quantile_cont(impact_P, {CUTS}) AS b3
FROM matched WHERE P_top10 IS NOT NULL GROUP BY Period"""
PARTS["binned"] = f"""
SELECT m.affiliationid, m.year, m.SDG_label, m.University, m.Period, m.n_frac_papers,
    {bin_case("m.P_top10", "b1")} AS P_top10, {bin_case("m.PP_top10", "b2")} AS PP_top10,
    {bin_case("m.impact_P", "b3")} AS impact_P
FROM matched m JOIN breaks USING (Period) WHERE m.P_top10 IS NOT NULL"""
PARTS["sample_bins"] = """
SELECT SDG_label, year, P_top10, sum(n_frac_papers) AS n,
    sum(n_frac_papers) / sum(sum(n_frac_papers)) OVER (PARTITION BY SDG_label, year) AS prop
FROM binned GROUP BY SDG_label, year, P_top10"""
PARTS["corpus_bins"] = f"""
SELECT year, P_top10, sum(n_frac_papers) AS n,
    sum(n_frac_papers) / sum(sum(n_frac_papers)) OVER (PARTITION BY year) AS prop
FROM (SELECT m.year, m.n_frac_papers, {bin_case("m.P_top10", "b")} AS P_top10
    FROM matched_corpus m JOIN (SELECT Period, quantile_cont(P_top10, {CUTS}) AS b FROM matched_corpus GROUP BY Period)
    USING (Period)) AS rows GROUP BY year, P_top10"""
PARTS["gendered"] = """
SELECT r.SDG_label, r.year, r.author_position, q.gender
FROM authored r JOIN people q ON r.authorid = q.authorid WHERE q.gender <> 'unknown' AND r.year < 2001"""
PARTS["open_rows"] = """
SELECT p.is_oa, p.SDG_label, f.country,
    1.0::DOUBLE / max(a.authorsequencenumber) OVER (PARTITION BY p.paperid) AS w
FROM labelled p LEFT JOIN authors a ON p.paperid = a.paperid LEFT JOIN affiliations f ON a.affiliationid = f.affiliationid
WHERE p.is_oa IS NOT NULL AND p.year BETWEEN 1996 AND 1999"""
PARTS["open_country"] = """
SELECT country, is_oa, sum(w) AS sum_frac_oa, sum(w) / sum(sum(w)) OVER (PARTITION BY country) AS prop_oa,
    sum(sum(w)) OVER (PARTITION BY country) AS sum_frac_total FROM open_rows GROUP BY country, is_oa"""
PARTS["open_country_label"] = """
SELECT country, SDG_label, is_oa, sum(w) AS sum_frac_oa,
    sum(w) / sum(sum(w)) OVER (PARTITION BY country, SDG_label) AS prop_oa,
    sum(sum(w)) OVER (PARTITION BY country, SDG_label) AS sum_frac_total
FROM open_rows GROUP BY country, SDG_label, is_oa"""
PARTS["means"] = """
SELECT country_name, country_code, indicator_code, indicator_name, avg(value) AS value
FROM indicators WHERE year BETWEEN 1996 AND 1999 GROUP BY ALL"""
PARTS["wide"] = """
SELECT country_code, country_name, max(value) FILTER (WHERE indicator_code = 'AUTOMOBILE') AS AUTOMOBILE,
    max(value) FILTER (WHERE indicator_code = 'BUILDING') AS BUILDING
FROM means WHERE indicator_code IN ('AUTOMOBILE', 'BUILDING') GROUP BY ALL"""
PARTS["proper"] = """
SELECT country_code, short_name, region, income_group FROM incomes WHERE currency_unit IS NOT NULL"""
PARTS["seen"] = """
SELECT i.affiliationid, a.displayname, a.rank, a.country
FROM (SELECT DISTINCT affiliationid FROM authors) AS i LEFT JOIN affiliations a USING (affiliationid)"""
PARTS["both_known"] = """
SELECT s.affiliationid, s.displayname, s.country, o.Alpha3
FROM seen s JOIN second_source o USING (affiliationid) WHERE s.country IS NOT NULL AND o.Alpha3 IS NOT NULL"""

# Queries ---------------------------------------------------------------------

QUERIES["topic_sample"] = "SELECT * FROM sampled"
QUERIES["field_list"] = """
SELECT s.paperid, string_agg(CAST(m.fieldofstudyid AS VARCHAR), ', ' ORDER BY m.fieldofstudyid) AS fosid_aggregated
FROM (SELECT DISTINCT paperid FROM sampled) AS s JOIN matches m USING (paperid) GROUP BY s.paperid"""
QUERIES["sample_labels"] = "SELECT DISTINCT paperid, SDG_label FROM sampled"
QUERIES["sample_authors"] = """
SELECT s.paperid, a.authorid, a.affiliationid, a.authorsequencenumber
FROM (SELECT DISTINCT paperid FROM sampled) AS s LEFT JOIN authors a USING (paperid)"""
QUERIES["score_profile"] = " UNION ALL ".join(
    f"SELECT {p}::DOUBLE AS prob, round(quantile_disc(score, {p}), 6) AS perc, '{scope}' AS scope FROM {rows}"
    for scope, rows in (("all", "scores"), ("upper", "scores JOIN fields USING (fieldofstudyid) WHERE level <= 3"))
    for p in (0.1, 0.25, 0.5, 0.75, 0.9)
)
QUERIES["score_quantiles"] = (
    "SELECT level, "
    + ", ".join(f"round(quantile_cont(score, {p}), 6) AS q{i}" for i, p in enumerate((0.1, 0.25, 0.5, 0.75, 0.9)))
    + " FROM scores JOIN fields USING (fieldofstudyid) GROUP BY level"
)
QUERIES["oa_provider"] = "SELECT * FROM provider"
QUERIES["oa_variants"] = """
SELECT p.paperid, p.doi, v.is_oa, v.oa_status, v.has_repository_copy, v.provider_cat
FROM papers p LEFT JOIN (SELECT DISTINCT * FROM provider) AS v USING (doi)"""
QUERIES["funded_flag"] = "SELECT paperid, doi, doi IN (SELECT doi FROM funders) AS is_funded FROM papers"
QUERIES["funders_in_sample"] = """
SELECT f.doi, f.funder, p.paperid FROM funders f JOIN (SELECT DISTINCT paperid, doi FROM labelled) AS p USING (doi)"""
QUERIES["norm_citations"] = """
SELECT paperid, year, journalid, conferenceinstanceid, round(mean_citations, 6) AS mean_citations,
    round(mean_conf_citations, 6) AS mean_conf_citations, round(citations_norm, 6) AS citations_norm FROM normalised"""
QUERIES["collated_papers"] = """
SELECT n.paperid, n.doi, v.is_oa, v.provider_cat, n.doi IN (SELECT doi FROM funders) AS is_funded,
    round(n.citations_norm, 6) AS citations_norm
FROM normalised n LEFT JOIN (SELECT DISTINCT * FROM provider) AS v USING (doi)"""

QUERIES["sample_size"] = "SELECT count(*) AS n FROM labelled"
QUERIES["label_counts"] = "SELECT SDG_label, count(*) AS n FROM labelled GROUP BY ALL"
QUERIES["label_counts_years"] = """
SELECT year, SDG_label, count(*) AS n FROM labelled WHERE year IN (1995, 2000) GROUP BY ALL"""
QUERIES["corpus_share"] = "SELECT SDG_label, year, n, overall_n, round(prop, 6) AS prop FROM yearly"
QUERIES["yoy_growth"] = """
SELECT SDG_label, year, n, overall_n, round(prop, 6) AS prop,
    round(coalesce(prop / lag(prop) OVER (PARTITION BY SDG_label ORDER BY year), 1) - 1, 6) AS prop_change FROM yearly"""
QUERIES["cagr"] = """
SELECT SDG_label, round(of, 6) AS overall_growth_factor, round(nf, 6) AS individual_growth_factor,
    round(pow(of, 0.2::DOUBLE) - 1, 6) AS overall_growth_rate, round(pow(nf, 0.2::DOUBLE) - 1, 6) AS individual_growth_rate
FROM (SELECT a.SDG_label, b.overall_n::DOUBLE / a.overall_n AS of, b.n::DOUBLE / a.n AS nf
    FROM yearly a JOIN yearly b ON a.SDG_label = b.SDG_label AND a.year = 1995 AND b.year = 2000) AS ends"""

QUERIES["author_roles"] = "SELECT * FROM roles"
QUERIES["papers_with_roles"] = "SELECT * FROM authored"
QUERIES["fractional_weights"] = """
SELECT *, round(1.0::DOUBLE / count(*) OVER (PARTITION BY authorid, paperid), 6) AS frac_value FROM authors"""
QUERIES["sequence_weights"] = """
SELECT *, round(1.0::DOUBLE / max(authorsequencenumber) OVER (PARTITION BY paperid), 6) AS frac_count FROM authors"""
QUERIES["country_position_counts"] = """
SELECT country, year, SDG_label, author_position, count(*) AS n FROM authored GROUP BY ALL"""
QUERIES["region_share"] = "SELECT SDG_label, year, sub_continent, nn, round(share, 6) AS share FROM region_label"
QUERIES["region_baseline"] = "SELECT year, sub_continent, nn, round(share, 6) AS share FROM region_corpus"
QUERIES["specialisation"] = """
SELECT SDG_label, year, sub_continent, nn_sdg, round(share_sdg, 6) AS share_sdg, nn, round(share, 6) AS share,
    round(specialisation, 6) AS specialisation FROM region_ratio"""
QUERIES["specialisation_main"] = """
SELECT SDG_label, year, sub_continent, round(specialisation, 6) AS specialisation,
    sub_continent IN ('AMERICA', 'EUROPE') AS highlight FROM region_ratio WHERE sub_continent <> 'AFRICA'"""
QUERIES["income_share"] = "SELECT SDG_label, year, income_group, nn, round(share, 6) AS share FROM income_label"
QUERIES["income_baseline"] = "SELECT year, income_group, nn, round(share, 6) AS share FROM income_corpus"
QUERIES["income_specialisation"] = """
SELECT SDG_label, year, income_group, nn_sdg, round(share_sdg, 6) AS share_sdg, nn, round(share, 6) AS share,
    round(specialisation, 6) AS specialisation FROM income_ratio"""
QUERIES["mean_specialisation"] = """
SELECT income_group, SDG_label,
    round(CASE WHEN count(*) = count(specialisation) THEN avg(specialisation) END, 6) AS mean_specialisation
FROM income_ratio GROUP BY ALL"""
QUERIES["institutions_by_output"] = """
SELECT p.SDG_label, f.displayname, f.rank, count(*) AS n
FROM labelled p LEFT JOIN authors a ON p.paperid = a.paperid LEFT JOIN affiliations f ON a.affiliationid = f.affiliationid
GROUP BY ALL"""

FRACTIONS = ", ".join(f"round({c}, 4) AS {c}" for c in ("n_frac_papers", "n_frac_oa_papers", "n_frac_citations"))
QUERIES["fractional_productivity"] = f"SELECT affiliationid, year, SDG_label, {FRACTIONS} FROM output"
QUERIES["fractional_productivity_by_label"] = """
SELECT affiliationid, year, SDG_label, round(sum(w_label), 4) AS n_frac_papers,
    round(coalesce(sum(w_label) FILTER (WHERE is_oa), 0), 4) AS n_frac_oa_papers,
    round(coalesce(sum(w_label * citations_norm), 0), 4) AS n_frac_citations
FROM weighted GROUP BY ALL"""
QUERIES["fractional_corpus"] = "SELECT affiliationid, year, round(n_frac_papers, 4) AS n_frac_papers FROM corpus_output"
QUERIES["clean_ranking"] = "SELECT * FROM ranking"
QUERIES["prestige_match"] = f"""
SELECT affiliationid, year, SDG_label, {FRACTIONS}, University, Country, Period, P_top10, PP_top10, impact_P
FROM matched"""
QUERIES["inclusion_rows"] = " UNION ALL ".join(
    f"""SELECT affiliationid, SDG_label, University,
    CASE WHEN University IS NULL THEN 'unmatched' ELSE 'matched' END AS in_ranking,
    '{text}' AS indicator, round({c}, 4) AS value FROM matched WHERE year = 1999"""
    for c, text in (
        ("n_frac_papers", "# of publications (fractional)"),
        ("n_frac_oa_papers", "# of publications (fractional)"),
        ("n_frac_citations", "# of citations (fractional)"),
    )
)
QUERIES["ranked_boxstats"] = """
WITH long AS (
    SELECT SDG_label, CASE WHEN University IS NULL THEN 'unmatched' ELSE 'matched' END AS in_ranking, indicator,
        CASE WHEN value > 0 THEN log10(value) END AS v
    FROM (UNPIVOT (SELECT SDG_label, University, n_frac_papers, n_frac_oa_papers, n_frac_citations FROM matched
        WHERE year = 1999) ON n_frac_papers, n_frac_oa_papers, n_frac_citations INTO NAME indicator VALUE value)),
boxes AS (
    SELECT SDG_label, in_ranking, indicator, quantile_cont(v, [0.25, 0.5, 0.75]) AS q FROM long GROUP BY ALL)
SELECT SDG_label, indicator, in_ranking, count(v) AS n, count(*) FILTER (WHERE v IS NULL) AS removed,
    round(max(q[1]), 6) AS q1, round(max(q[2]), 6) AS median, round(max(q[3]), 6) AS q3,
    round(min(v) FILTER (WHERE v >= q[1] - 1.5 * (q[3] - q[1])), 6) AS lower,
    round(max(v) FILTER (WHERE v <= q[3] + 1.5 * (q[3] - q[1])), 6) AS upper,
    count(*) FILTER (WHERE v < q[1] - 1.5 * (q[3] - q[1]) OR v > q[3] + 1.5 * (q[3] - q[1])) AS outliers
FROM long JOIN boxes USING (SDG_label, in_ranking, indicator) GROUP BY ALL"""
QUERIES["prestige_corr"] = """
SELECT SDG_label, round(cor, 6) AS cor,
    'r = ' || coalesce(regexp_replace(printf('%.2f', round(cor, 2) + 0.0), '\\.?0+$', ''), 'NA') AS label
FROM (SELECT SDG_label, regr_sxy(n_frac_papers, P_top10)
        / nullif(sqrt(regr_sxx(n_frac_papers, P_top10) * regr_syy(n_frac_papers, P_top10)), 0) AS cor
    FROM matched WHERE year = 1999 AND impact_P IS NOT NULL GROUP BY ALL) AS c"""
QUERIES["quintile_share"] = "SELECT SDG_label, year, P_top10, round(n, 4) AS n, round(prop, 6) AS prop FROM sample_bins"
QUERIES["quintile_bins"] = """
SELECT affiliationid, year, SDG_label, University, Period, P_top10, PP_top10, impact_P FROM binned"""
QUERIES["quintile_baseline"] = """
SELECT SDG_label, year, P_top10, round(n, 4) AS n, round(prop, 6) AS prop, 'sample' AS series FROM sample_bins
UNION ALL SELECT NULL, year, P_top10, round(n, 4), round(prop, 6), 'baseline' FROM corpus_bins"""
QUERIES["quartile_bins"] = """
WITH cells AS (
    SELECT p.year, a.affiliationid, count(*) AS n FROM papers p LEFT JOIN authors a ON p.paperid = a.paperid GROUP BY ALL),
cuts AS (SELECT year, quantile_cont(n::DOUBLE, [0.25, 0.5, 0.75]) AS b FROM cells GROUP BY year)
SELECT year, affiliationid, n, CASE WHEN n <= b[1] THEN 'p[0,25]' WHEN n <= b[2] THEN 'p(25,50]'
    WHEN n <= b[3] THEN 'p(50,75]' ELSE 'p(75,100]' END AS bin
FROM cells JOIN cuts USING (year)"""

QUERIES["gender_share"] = """
SELECT SDG_label, year, gender, count(*) AS n,
    round(count(*)::DOUBLE / sum(count(*)) OVER (PARTITION BY SDG_label, year), 6) AS prop
FROM gendered GROUP BY SDG_label, year, gender"""
QUERIES["gender_position_share"] = """
SELECT SDG_label, year, author_position, gender, count(*) AS n,
    round(count(*)::DOUBLE / sum(count(*)) OVER (PARTITION BY SDG_label, year, author_position), 6) AS prop
FROM gendered GROUP BY SDG_label, year, author_position, gender"""
QUERIES["oa_year_share"] = """
SELECT * FROM (SELECT SDG_label, year, is_oa, count(*) AS n,
    round(count(*)::DOUBLE / sum(count(*)) OVER (PARTITION BY SDG_label, year), 6) AS oa_share
    FROM labelled WHERE is_oa IS NOT NULL GROUP BY SDG_label, year, is_oa) AS s WHERE is_oa"""
SUMS = "round(sum_frac_oa, 4) AS sum_frac_oa, round(prop_oa, 6) AS prop_oa, round(sum_frac_total, 4) AS sum_frac_total"
PAIRED = f"""is_oa, {SUMS}, country_name, round(AUTOMOBILE, 6) AS AUTOMOBILE, round(BUILDING, 6) AS BUILDING,
    short_name, region, income_group"""
ECONOMY = """JOIN wide w ON country = w.country_code LEFT JOIN proper c ON country = c.country_code
WHERE AUTOMOBILE IS NOT NULL AND BUILDING IS NOT NULL AND is_oa AND round(sum_frac_total, 6) >= 10"""
QUERIES["oa_country"] = f"SELECT country, is_oa, {SUMS} FROM open_country"
QUERIES["oa_country_label"] = f"SELECT country, SDG_label, is_oa, {SUMS} FROM open_country_label"
QUERIES["indicator_means"] = """
SELECT country_name, country_code, indicator_code, indicator_name, round(value, 6) AS value FROM means"""
QUERIES["oa_indicator"] = f"SELECT country, {PAIRED} FROM open_country {ECONOMY}"
QUERIES["oa_indicator_label"] = f"SELECT country, SDG_label, {PAIRED} FROM open_country_label {ECONOMY}"
QUERIES["oa_prestige_corr"] = """
SELECT year, SDG_label, round(regr_sxy(y, x) / nullif(sqrt(regr_sxx(y, x) * regr_syy(y, x)), 0), 6) AS cor
FROM (SELECT year, SDG_label, n_frac_oa_papers / n_frac_papers AS x, P_top10 AS y FROM matched
    WHERE round(n_frac_papers, 6) > 20 AND P_top10 IS NOT NULL) AS rows GROUP BY ALL"""

QUERIES["country_coverage"] = "SELECT round(count(country) / count(*)::DOUBLE, 6) AS country_share FROM seen"
QUERIES["gap_coverage"] = """
SELECT round(count(o.country) / count(*)::DOUBLE, 6) AS country_share
FROM seen s LEFT JOIN (SELECT affiliationid, min(Alpha3) AS country FROM second_source GROUP BY ALL) o USING (affiliationid)
WHERE s.country IS NULL"""
QUERIES["agreement"] = """
SELECT round(count(*) FILTER (WHERE country = Alpha3) / count(*)::DOUBLE, 6) AS correct_countries FROM both_known"""
QUERIES["disagreements"] = "SELECT * FROM both_known WHERE country <> Alpha3"
QUERIES["missing_country_ids"] = "SELECT affiliationid FROM seen WHERE country IS NULL"
QUERIES["gap_file"] = """
SELECT s.affiliationid, s.displayname, s.rank, o.country
FROM seen s LEFT JOIN (SELECT affiliationid, min(Alpha3) AS country FROM second_source GROUP BY ALL) o USING (affiliationid)
WHERE s.country IS NULL"""
QUERIES["author_row_positions"] = """
SELECT paperid, authorid, affiliationid, authorsequencenumber,
    row_number() OVER (ORDER BY authorsequencenumber DESC NULLS LAST, paperid NULLS LAST, authorid NULLS LAST, affiliationid NULLS LAST) - 1
        AS position
FROM authors"""
QUERIES["backfill_country"] = "SELECT * FROM filled"
QUERIES["import_institutions"] = """
SELECT 'I' || event_id AS id,
    CASE WHEN event_type = 'error' THEN '' ELSE coalesce(json_extract_string(props, '$.k'), '') END AS affiliationid,
    'N' || (user_id % 30) AS country_code, n_name AS Alpha3, user_id AS works_count, 'City ' || (user_id % 9) AS city,
    CAST(NULL AS VARCHAR) AS type
FROM events LEFT JOIN nation ON user_id % 30 = n_nationkey"""
QUERIES["record_columns"] = """
SELECT 'I' || event_id AS id, 'N' || (user_id % 30) AS country_code, user_id AS works_count FROM events"""
QUERIES["count_record_share"] = """
SELECT year, 'true' AS is_oa, n AS count, round(n::DOUBLE / total, 6) AS prop
FROM (SELECT CAST(2000 + day(ts) AS INT) AS year, count(*) FILTER (WHERE event_type = 'purchase') AS n,
    count(*) AS total FROM events GROUP BY ALL) AS days"""

QUERIES["null_safe_join"] = """
SELECT country, count(*) AS n, CASE WHEN country IS NOT NULL THEN 1 END AS strict, 1 AS known
FROM authors LEFT JOIN affiliations USING (affiliationid) GROUP BY country"""
QUERIES["ordered_labels"] = """
SELECT SDG_label, year, count(*) AS n, CASE SDG_label WHEN 'SDG_2' THEN 1 WHEN 'SDG_3' THEN 2 ELSE 3 END AS place,
    CAST(make_date(year, 1, 1) AS VARCHAR) AS day FROM labelled GROUP BY SDG_label, year"""
QUERIES["ordered_incomes"] = """
SELECT country_code, income_group, CASE income_group WHEN 'High income' THEN 1 WHEN 'Upper middle income' THEN 2
    WHEN 'Lower middle income' THEN 3 WHEN 'Low income' THEN 4 END AS place FROM incomes"""
QUERIES["complete_incomes"] = "SELECT * FROM incomes WHERE income_group IS NOT NULL AND currency_unit IS NOT NULL"
QUERIES["european_numbers"] = """
SELECT o_orderkey AS paperid, translate(format('{:,.2f}', o_totalprice), ',.', '.,') AS price_text,
    round(o_totalprice, 2) AS price FROM orders"""
QUERIES["quoted_rows"] = """
SELECT '"' || paperid || '","' || doi || '","' || papertitle || '","' || year || '"' AS line,
    paperid, nullif(doi, '') AS doi, papertitle, year FROM papers"""
QUERIES["tab_rows"] = "SELECT * FROM authors"
QUERIES["null_tokens"] = """
SELECT affiliationid || ',' || coalesce(country, 'NA') || ',' || displayname AS line,
    affiliationid, country, displayname FROM affiliations"""


def needed(sql: str, found: dict[str, None]) -> dict[str, None]:
    """Names of the parts a query refers to, each after the ones it needs."""
    for name in PARTS:
        if name not in found and re.search(rf"\b{name}\b", sql):
            needed(PARTS[name], found)
            found[name] = None
    return found


def oracle_sql() -> dict[str, str]:
    def whole(sql: str) -> str:
        parts = [f"{name} AS ({PARTS[name]})" for name in needed(sql, {})]
        body = sql.strip()
        if body.startswith("WITH "):
            parts.append(body[5:])
            return "WITH " + ",\n".join(parts)
        return ("WITH " + ",\n".join(parts) + "\n" if parts else "") + body

    return {name: whole(sql) for name, sql in QUERIES.items()}
