"""Gender shares of authorships."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from oeuvre.operators.authorship import AUTHOR, PAPER, SEQUENCE, role_rows
from oeuvre.operators.shares import count_by, share_of_total
from oeuvre.operators.skew import HOT_ROWS, split_join


def gender_share(
    papers: DataFrame,
    authors: DataFrame,
    people: DataFrame,
    *keys: str,
    unknown: str = "unknown",
    before: int | None = None,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Authorships of known gender by keys, with the share ``prop`` of each gender.

    The gender is looked up on the author rows themselves, before the papers come
    in, where a heavy or null author stays in place.  What is counted then has a
    row for each cell of the report only, not for each author in it.
    """
    if before is not None:
        papers = papers.filter(F.col("year") < before)
    labels = [k for k in keys if k != "author_position"]
    known = people.filter(F.col("gender") != unknown).select(AUTHOR, "gender")
    placed = split_join(authors.select(PAPER, AUTHOR, SEQUENCE), known, AUTHOR, "left", hot_rows).drop(AUTHOR)
    rows = role_rows(papers.select(PAPER, *labels), placed, hot_rows, count=authors)
    counts = count_by(rows.filter(F.col("gender").isNotNull()), *keys, "gender")
    return share_of_total(counts, "n", keys, name="prop")
