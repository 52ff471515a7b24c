"""Selection of a topical sample of papers from scored fields of study."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from oeuvre.operators.authorship import PAPER, papers_with_authors
from oeuvre.operators.quantiles import PROFILE, score_profile
from oeuvre.operators.skew import HOT_ROWS, split_join

FIELD = "fieldofstudyid"

# The labels, limits and columns of the sample.
LABELS = ("SDG_2", "SDG_3", "SDG_13")
MAX_LEVEL = 3
MIN_SCORE = 0.497
YEARS = (2006, 2020)
SAMPLE_COLUMNS = (
    "paperid", "doi", "doctype", "papertitle", "originaltitle", "booktitle", "year", "date", "publisher",
    "journalid", "conferenceinstanceid", "referencecount", "citationcount", "originalvenue", "familyid",
)


def topic_fields(
    ontology: DataFrame, fields: DataFrame, labels: Sequence[str] = LABELS, max_level: int = MAX_LEVEL
) -> DataFrame:
    """Fields of study of the chosen labels that are not too deep in the hierarchy."""
    wanted = ontology.filter(F.col("SDG_label").isin(*labels)).select("SDG_label", F.col("fos_id").alias(FIELD))
    return wanted.join(fields.filter(F.col("level") <= max_level).select(FIELD, "level"), FIELD)


def topic_matches(
    topics: DataFrame, scores: DataFrame, min_score: float = MIN_SCORE, hot_rows: int = HOT_ROWS
) -> DataFrame:
    """Paper and field pairs of a topic that score high enough."""
    certain = scores.select(PAPER, FIELD, "score").filter(F.col("score") >= min_score)
    return split_join(certain, topics.select(FIELD, "SDG_label"), FIELD, "inner", hot_rows)


def eligible_papers(papers: DataFrame, years: tuple[int, int] = YEARS) -> DataFrame:
    """Papers of the period with a DOI that come from a journal or a conference."""
    venue = F.col("journalid").isNotNull() | F.col("conferenceinstanceid").isNotNull()
    rows = papers.filter(F.col("year").between(*years) & venue & (F.col("doi") != ""))
    return rows.select(*[c for c in SAMPLE_COLUMNS if c in papers.columns]).distinct()


def topic_sample(matches: DataFrame, papers: DataFrame, years: tuple[int, int] = YEARS) -> DataFrame:
    """One row for each paper and label of the sample.

    Matches shrink to paper and label before papers are joined, so a paper with
    very many fields is as many rows as it has labels.
    """
    labelled = matches.select(PAPER, "SDG_label").distinct()
    return eligible_papers(papers, years).join(labelled, PAPER)


def field_list(matches: DataFrame, name: str = "fosid_aggregated") -> DataFrame:
    """Matching fields of a paper as text, in order, once for each match.

    The text of a paper is one value by definition.  Equal pairs are counted
    before it is put together, so it has at most one entry for each topic field.
    """
    pairs = matches.groupBy(PAPER, FIELD).agg(F.count("*").cast("int").alias("_n"))
    entries = F.sort_array(F.collect_list(F.struct(FIELD, "_n")))
    texts = F.transform(entries, lambda e: F.array_repeat(e[FIELD].cast("string"), e["_n"]))
    return pairs.groupBy(PAPER).agg(F.array_join(F.flatten(texts), ", ").alias(name))


def sample_papers(sample: DataFrame, matches: DataFrame) -> DataFrame:
    """The sample without labels, with the list of matching fields."""
    papers = sample.drop("SDG_label").distinct()
    return papers.join(field_list(matches), PAPER, "left")


def sample_labels(sample: DataFrame) -> DataFrame:
    return sample.select(PAPER, "SDG_label").distinct()


def sample_authors(sample: DataFrame, authors: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Author rows of the sampled papers; a paper without any keeps one empty row."""
    return papers_with_authors(sample.select(PAPER).distinct(), authors, hot_rows)


def threshold_profiles(
    scores: DataFrame,
    fields: DataFrame,
    max_level: int = MAX_LEVEL,
    probs: Sequence[float] = PROFILE,
    accuracy: int = 100,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Score quantiles over all fields and over fields up to ``max_level``."""
    shallow = fields.filter(F.col("level") <= max_level).select(FIELD)
    chosen = split_join(scores.select(FIELD, "score"), shallow, FIELD, "inner", hot_rows)
    everything = score_profile(scores, "score", probs, accuracy).withColumn("scope", F.lit("all"))
    upper = score_profile(chosen, "score", probs, accuracy).withColumn("scope", F.lit("upper"))
    return everything.unionByName(upper)
