"""Quality classifier: a regularised quadratic discriminant over transformed document statistics.

Each class has a mean and a covariance that is shrunk towards the pooled one, and that towards a multiple of the identity.
The score is the posterior of the class of good documents, from the difference of the two log densities; their Cholesky
factors are computed once. Means and covariances come from sums over all labelled rows, so nothing is sampled.

Null and empty texts have all statistics 0 and get a score like any other. Whole texts count. Rows that repeat get equal
results. Labels that are null are left out; if a doc_id has several, the highest counts. With labels of one class only,
or none, the score is 0.5 for all. Other columns than doc_id, text, quality are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from oeuvre.llm import words as w
from oeuvre.llm.shared import BATCH, mapped, staged

ACCEPT = 0.7

#: How far a class covariance is shrunk to the pooled one, and that to the identity.
TO_POOLED = 0.3
TO_IDENTITY = 0.05

# Kinds of bytes.
OTHER, LOWER, UPPER, DIGIT, SPACE, LINE, STOP, MARK, SYMBOL = range(9)
KIND = np.zeros(256, np.int64)
KIND[97:123] = LOWER
KIND[128:] = LOWER
KIND[65:91] = UPPER
KIND[48:58] = DIGIT
KIND[w.SEPARATORS] = SPACE
KIND[10] = LINE
KIND[[ord(c) for c in ".?,;:"]] = STOP
KIND[[ord(c) for c in "!'\"()-"]] = MARK
KIND[[ord(c) for c in "#$%&*+/<=>@[\\]^_`{|}~"]] = SYMBOL

NAMES = ["words", "word_length", "upper", "digits", "stops", "marks", "symbols", "lines", "shouted", "odd_ends", "lone", "short", "repeated_words", "repeated_lines"]


def distinct(hashes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """How many different hashes each run has."""
    own = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    order = np.lexsort((hashes, own))
    h, own = hashes[order], own[order]
    new = np.concatenate([[True], (h[1:] != h[:-1]) | (own[1:] != own[:-1])])[: len(h)]
    return np.bincount(own[new], minlength=len(bounds) - 1)


def per(n: np.ndarray, of: np.ndarray, least: int = 0) -> np.ndarray:
    """A ratio; `least` more in the divisor keeps a few marks in a short text from weighing much."""
    return n / np.maximum(of + least, 1)


def statistics(piece: w.Piece) -> np.ndarray:
    """A row of transformed statistics for each document: logs of counts, square roots of shares."""
    rows, text = piece.rows, w.words(piece)
    own = np.repeat(np.arange(rows), np.diff(piece.bounds))
    kinds = KIND[piece.data]
    table = np.bincount(own * 9 + kinds, minlength=rows * 9).reshape(rows, 9)
    n, size = text.counts(), text.ends - text.starts
    in_doc = np.repeat(np.arange(rows), n)
    count = lambda flags: np.bincount(in_doc[flags], minlength=rows)
    ups = np.concatenate([[0], np.cumsum(kinds == UPPER)])
    shouted = (ups[text.ends] - ups[text.starts]) * 2 > size
    last = kinds[text.ends - 1]
    visible = table.sum(1) - table[:, SPACE] - table[:, LINE]
    letters = table[:, LOWER] + table[:, UPPER]

    breaks = np.flatnonzero(kinds == LINE)
    starts = np.union1d(piece.bounds[:-1][np.diff(piece.bounds) > 0], breaks + 1)
    starts = starts[starts < len(piece.data)]
    at = np.searchsorted(text.starts, starts)
    held = np.diff(np.append(at, len(text.hashes))) > 0
    at, starts = at[held], starts[held]
    lines = w.mixed(np.add.reduceat(text.hashes * w.powers(w.STEP, len(text.hashes)) * w.powers(w.BACK, len(text.hashes))[np.repeat(at, np.diff(np.append(at, len(text.hashes))))], at)) if len(at) else np.zeros(0, np.uint64)
    edges = np.searchsorted(starts, piece.bounds)
    n_lines = np.diff(edges)

    share = lambda a, b: np.sqrt(per(a, b, 8))
    return np.column_stack(
        [
            np.log1p(n),
            np.log1p(per(visible, n)),
            share(table[:, UPPER], letters),
            share(table[:, DIGIT], visible),
            share(table[:, STOP], visible),
            share(table[:, MARK], visible),
            share(table[:, SYMBOL], visible),
            share(table[:, LINE], n),
            share(count(shouted & (size > 1)), n),
            share(count((last == SYMBOL) | (last == MARK)), n),
            share(count((size == 1) & (last == SYMBOL)), n),
            share(count(size <= 3), n),
            share(n - distinct(text.hashes, text.bounds), n),
            np.sqrt(per(n_lines - distinct(lines, edges), n_lines, 40)),
        ]
    )


def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [statistics(piece) for piece in w.pieces(batch.column("text"))]
        x = np.concatenate(found) if found else np.zeros((0, len(NAMES)))
        ends = pa.array(np.arange(len(x) + 1) * len(NAMES), pa.int32())
        values = pa.ListArray.from_arrays(ends, pa.array(x.ravel()))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), values], ["doc_id", "x"])


def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each class 1, x and the outer product of x, summed over this task's rows."""
    d = len(NAMES)
    sums = np.zeros((2, 1 + d + d * d))
    for batch in batches:
        x = batch.column("x").flatten().to_numpy().reshape(-1, d)
        y = batch.column("quality").to_numpy(zero_copy_only=False)
        for k in (0, 1):
            own = x[y == k]
            sums[k] += np.concatenate([[len(own)], own.sum(0), (own.T @ own).ravel()])
    k, i = np.indices(sums.shape)
    yield pa.record_batch({"k": pa.array(k.ravel()), "i": pa.array(i.ravel()), "v": pa.array(sums.ravel())})


@dataclass
class Model:
    """Scale of the statistics; for each class its mean, inverse Cholesky factor and constant."""

    middle: np.ndarray
    scale: np.ndarray
    parts: list[tuple[np.ndarray, np.ndarray, float]] | None

    def scores(self, x: np.ndarray) -> np.ndarray:
        if self.parts is None:
            return np.full(len(x), 0.5)
        z = (x - self.middle) / self.scale
        bad, good = (c - 0.5 * np.square((z - mean) @ factor.T).sum(1) for mean, factor, c in self.parts)
        return 1 / (1 + np.exp(np.clip(bad - good, -700, 700)))


def fitted(sums: np.ndarray) -> Model:
    """The model of the class sums."""
    d = len(NAMES)
    n, total = sums[:, 0], sums.sum(0)
    if (n < 2).any():
        return Model(np.zeros(d), np.ones(d), None)
    middle = total[1 : 1 + d] / total[0]
    spread = np.sqrt(np.maximum(np.diag(total[1 + d :].reshape(d, d)) / total[0] - middle**2, 1e-12))
    means, covariances = [], []
    for k in (0, 1):
        mean = sums[k, 1 : 1 + d] / n[k]
        covariances.append((sums[k, 1 + d :].reshape(d, d) / n[k] - np.outer(mean, mean)) / np.outer(spread, spread))
        means.append((mean - middle) / spread)
    pooled = (n[0] * covariances[0] + n[1] * covariances[1]) / n.sum()
    pooled = (1 - TO_IDENTITY) * pooled + TO_IDENTITY * max(np.trace(pooled) / d, 1e-3) * np.eye(d)
    parts = []
    for k in (0, 1):
        factor = np.linalg.cholesky((1 - TO_POOLED) * covariances[k] + TO_POOLED * pooled)
        constant = np.log(n[k] / n.sum()) - np.log(np.diag(factor)).sum()
        parts.append((means[k], np.linalg.inv(factor), float(constant)))
    return Model(middle, spread, parts)


def remainder(modulus: int):
    return F.crc32(F.col("doc_id").cast("string")) % modulus


def fit(stats: DataFrame, labels: DataFrame) -> Model:
    """A model of the labelled rows: stats (doc_id, x), labels (doc_id, quality)."""
    marks = labels.where("doc_id IS NOT NULL AND quality IN (0, 1)").groupBy("doc_id").agg(F.max("quality").cast("int").alias("quality"))
    rows = mapped(stats.join(marks, "doc_id").select("x", "quality"), summed, "k long, i long, v double")
    sums = np.zeros((2, 1 + len(NAMES) + len(NAMES) ** 2))
    for row in rows.groupBy("k", "i").agg(F.sum("v").alias("v")).collect():  # a few hundred rows, whatever the data
        sums[row["k"], row["i"]] = row["v"]
    return fitted(sums)


def scored(stats: DataFrame, model: Model) -> DataFrame:
    """doc_id, score of each row of stats."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column("x").flatten().to_numpy().reshape(-1, len(NAMES))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(model.scores(x))], ["doc_id", "score"])

    kind = stats.schema["doc_id"].dataType.simpleString()
    return mapped(stats, task, f"doc_id {kind}, score double")


def stats_of(documents: DataFrame) -> DataFrame:
    kind = documents.schema["doc_id"].dataType.simpleString()
    return mapped(documents.select("doc_id", "text"), measured, f"doc_id {kind}, x array<double>")


def classify(documents: DataFrame, labels: DataFrame, modulus: int = 4, held: int = 2) -> DataFrame:
    """doc_id, held_out, score, predicted. Rows whose crc32(doc_id) mod `modulus` is `held` are never learned from."""
    stats = staged(stats_of(documents), "statistics")
    out = F.coalesce(remainder(modulus) == held, F.lit(False))
    model = fit(stats.where(~out), labels)
    return scored(stats, model).select("doc_id", out.alias("held_out"), "score", (F.col("score") >= ACCEPT).cast("int").alias("predicted"))


def accepted(documents: DataFrame, labels: DataFrame, modulus: int = 4, held: int = 2) -> DataFrame:
    """The documents with a score of `ACCEPT` or more, by a model of their labels."""
    stats = stats_of(documents.where(~F.coalesce(remainder(modulus) == held, F.lit(False))))
    # Written first: else a task measures and sums at once, with two Python workers that the executor keeps.
    model = fit(staged(stats, "statistics", BATCH), labels)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [model.scores(statistics(piece)) for piece in w.pieces(batch.column("text"))]
            yield batch.filter(pa.array(np.concatenate([np.zeros(0), *found]) >= ACCEPT))

    return mapped(documents, task, documents.schema)


def query(spark, sf_dir: str) -> DataFrame:
    return classify(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
