"""Author roles, fractional counting and counts by country.

Author rows are the largest table and the only one with many rows per paper.
Papers of more than ``hot_rows`` author rows take the broadcast route; all others
are joined on the paper once, and the windows that follow reuse that shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from oeuvre.functions.columns import ratio, total
from oeuvre.operators.relations import left_join, sorted_report
from oeuvre.operators.shares import count_by
from oeuvre.operators.skew import HOT_ROWS, heavy_groups, over_groups, split_join

PAPER, AUTHOR, AFFILIATION, SEQUENCE = "paperid", "authorid", "affiliationid", "authorsequencenumber"


def author_category(last: str = "_last") -> Column:
    """Size of the author team, from the highest sequence number of the paper."""
    team = F.col(last)
    return F.when(team == 1, "single").when(team == 2, "double").otherwise("multi")


def author_position(sequence: str = SEQUENCE, last: str = "_last") -> Column:
    """Place of an author: sole and leading authors are first, the closing one is last.

    In a team of two the closing place is number 2, so both rules below agree on
    it.  A missing sequence number leaves the middle place.
    """
    place, team = F.col(sequence), F.col(last)
    return (
        F.when((team == 1) | (place == 1), "first_author")
        .when(place == team, "last_author")
        .otherwise("middle_author")
    )


def author_groups(
    rows: DataFrame, paper: str = PAPER, sequence: str = SEQUENCE, hot_rows: int = HOT_ROWS
) -> DataFrame:
    """Add ``paper_author_cat`` and ``author_position`` to author rows."""
    known = over_groups(rows, paper, {"_last": F.max(sequence)}, hot_rows)
    return _with_roles(known, sequence).drop("_last")


def _with_roles(rows: DataFrame, sequence: str = SEQUENCE) -> DataFrame:
    return rows.withColumns({"paper_author_cat": author_category(), "author_position": author_position(sequence)})


def fractional_weight(
    rows: DataFrame, author: str = AUTHOR, paper: str = PAPER, name: str = "frac_value", hot_rows: int = HOT_ROWS
) -> DataFrame:
    """Add one divided by the number of rows of the same author on the same paper.

    Rows are counted by paper to find heavy groups, as an author's rows on a paper
    are never more than the paper's.  Rows without a paper form a group, which may be heavy.
    """
    heavy = F.broadcast(heavy_groups(rows, paper, hot_rows).select(F.col(paper).alias("_heavy")))
    member = F.col(paper).eqNullSafe(F.col("_heavy"))
    size = F.count("*").over(Window.partitionBy(paper, author))
    light = rows.join(heavy, member, "left_anti").withColumn("_n", size)
    rest = over_groups(rows.join(heavy, member, "left_semi"), [paper, author], {"_n": F.count("*")}, hot_rows)
    counted = light.unionByName(rest)
    return counted.withColumn(name, ratio(F.lit(1), "_n")).drop("_n")


def sequence_weight(
    rows: DataFrame,
    paper: str = PAPER,
    sequence: str = SEQUENCE,
    name: str = "frac_count",
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Add one divided by the highest sequence number of the paper."""
    known = over_groups(rows, paper, {"_last": F.max(sequence)}, hot_rows)
    return known.withColumn(name, ratio(F.lit(1), "_last")).drop("_last")


def _sides(
    papers: DataFrame, authors: DataFrame, hot_rows: int, last: bool = False, count: DataFrame | None = None
) -> tuple[DataFrame, DataFrame]:
    """Papers with their author rows, in two parts with the same columns.

    The first part holds the papers of up to ``hot_rows`` author rows, including
    those with none, shuffled by paper.  The second holds the others.  ``last``
    adds the highest sequence number of the paper, found on the author rows alone
    in the order the join needs anyway; ``count`` names a cheaper table to count
    the author rows in.
    """
    heavy = heavy_groups(count if count is not None else authors, PAPER, hot_rows)
    heavy_rows = authors.join(F.broadcast(heavy), PAPER, "left_semi")
    few = papers.join(F.broadcast(heavy), PAPER, "left_semi")
    light_rows = authors.join(F.broadcast(heavy), PAPER, "left_anti")
    rest = heavy_rows.join(F.broadcast(few), PAPER)
    if last:
        light_rows = light_rows.withColumn("_last", F.max(SEQUENCE).over(Window.partitionBy(PAPER)))
        rest = rest.join(F.broadcast(heavy_rows.groupBy(PAPER).agg(F.max(SEQUENCE).alias("_last"))), PAPER)
    light = papers.join(F.broadcast(heavy), PAPER, "left_anti").join(light_rows, PAPER, "left")
    return light, rest.select(*light.columns)


def papers_with_authors(papers: DataFrame, authors: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Left join of papers and author rows."""
    light, rest = _sides(papers, authors, hot_rows)
    return light.unionByName(rest)


def with_last_place(
    papers: DataFrame, authors: DataFrame, hot_rows: int = HOT_ROWS, count: DataFrame | None = None
) -> DataFrame:
    """Left join of papers and author rows with the highest sequence number ``_last``."""
    light, rest = _sides(papers, authors, hot_rows, last=True, count=count)
    return light.unionByName(rest)


def role_rows(
    papers: DataFrame, authors: DataFrame, hot_rows: int = HOT_ROWS, count: DataFrame | None = None
) -> DataFrame:
    """Papers with author rows and roles; a paper without authors has no role."""
    rows = with_last_place(papers, authors.withColumn("_row", F.lit(1)), hot_rows, count)
    rows = _with_roles(rows)
    roles = {c: F.when(F.col("_row").isNotNull(), F.col(c)) for c in ("paper_author_cat", "author_position")}
    return rows.withColumns(roles).drop("_last", "_row")


def papers_with_roles(
    papers: DataFrame, authors: DataFrame, affiliations: DataFrame, hot_rows: int = HOT_ROWS
) -> DataFrame:
    """Papers with author rows, roles and the country of the affiliation.

    The country is looked up on the author table itself, before the papers come
    in, where a heavy or null affiliation stays in place.
    """
    places = affiliations.select(AFFILIATION, "country")
    placed = split_join(authors, places, AFFILIATION, "left", hot_rows)
    return role_rows(papers, placed, hot_rows, count=authors)


def by_country(cells: DataFrame, affiliations: DataFrame, value: str, *keys: str) -> DataFrame:
    """Sums by affiliation turned into sums by country, unknown country included."""
    placed = left_join(cells, affiliations.select(AFFILIATION, "country"), AFFILIATION)
    return placed.groupBy("country", *keys).agg(F.sum(value).alias(value))


def country_counts(
    papers: DataFrame, authors: DataFrame, affiliations: DataFrame, *keys: str, hot_rows: int = HOT_ROWS
) -> DataFrame:
    """Author rows by country and keys; ``author_position`` may be among the keys.

    Rows are counted by affiliation before the affiliation table is joined, so
    the null affiliation and the large ones arrive there as a few counted rows.
    """
    if "author_position" in keys:
        rows = role_rows(papers, authors.select(PAPER, AFFILIATION, SEQUENCE), hot_rows)
    else:
        rows = papers_with_authors(papers, authors.select(PAPER, AFFILIATION), hot_rows)
    return by_country(count_by(rows, AFFILIATION, *keys), affiliations, "n", *keys)


def institutions_by_output(
    papers: DataFrame, authors: DataFrame, affiliations: DataFrame, label: str = "SDG_label", hot_rows: int = HOT_ROWS
) -> DataFrame:
    """Author rows by label and institution, the most productive first."""
    rows = papers_with_authors(papers.select(PAPER, label), authors.select(PAPER, AFFILIATION), hot_rows)
    cells = count_by(rows, label, AFFILIATION)
    named = left_join(cells, affiliations.select(AFFILIATION, "displayname", "rank"), AFFILIATION)
    counts = named.groupBy(label, "displayname", "rank").agg(F.sum("n").alias("n"))
    return sorted_report(counts, label, "-n", "displayname")


def fractional_rows(
    papers: DataFrame,
    authors: DataFrame,
    weight_over: str = "label_rows",
    label: str = "SDG_label",
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Papers with author rows and fractional weights.

    ``label_rows`` divides an author's weight by all rows of the paper, copies of
    the paper under other labels included; ``affiliations`` divides it within
    each label, so that the weights of an author sum to one under each.
    """
    if weight_over not in ("label_rows", "affiliations"):
        raise ValueError(f"weight_over must be 'label_rows' or 'affiliations', not {weight_over!r}")
    keys = [PAPER, AUTHOR] + ([label] if weight_over == "affiliations" else [])
    light, rest = _sides(papers, authors.select(PAPER, AUTHOR, AFFILIATION), hot_rows)
    light = light.withColumn("_n", F.count("*").over(Window.partitionBy(*keys)))
    rest = over_groups(rest, keys, {"_n": F.count("*")}, hot_rows)
    return light.unionByName(rest).withColumn("frac_value", ratio(F.lit(1), "_n")).drop("_n")


def fractional_sums(rows: DataFrame, keys: Sequence[str], sums: dict[str, str | None]) -> DataFrame:
    """Weighted sums; ``sums`` maps a result to the column to weigh, or to None for the weight."""
    def weighed(column):
        return F.col("frac_value") if column is None else F.col("frac_value") * F.col(column).cast("double")

    return rows.groupBy(*keys).agg(*[total(weighed(c)).alias(name) for name, c in sums.items()])


def fractional_productivity(
    papers: DataFrame,
    authors: DataFrame,
    label: str = "SDG_label",
    open_access: str = "is_oa",
    citations: str = "citations_norm",
    weight_over: str = "label_rows",
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Papers, open papers and citations of an institution by year and label."""
    wanted = papers.select(PAPER, "year", label, open_access, citations)
    rows = fractional_rows(wanted, authors, weight_over, label, hot_rows)
    sums = {"n_frac_papers": None, "n_frac_oa_papers": open_access, "n_frac_citations": citations}
    return fractional_sums(rows, [AFFILIATION, "year", label], sums)


def fractional_corpus(papers: DataFrame, authors: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Papers of a known institution by year over the whole corpus."""
    rows = fractional_rows(papers.select(PAPER, "year"), authors, hot_rows=hot_rows)
    known = rows.filter(F.col(AFFILIATION).isNotNull())
    return fractional_sums(known, [AFFILIATION, "year"], {"n_frac_papers": None})
