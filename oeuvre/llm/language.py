"""Language ID: sparse multinomial logistic regression on TF-IDF character n-grams, with calibrated scores.

Features are character n-grams of 1 to 3 letters of the lower-cased text, hashed to `BUCKETS`; anything but letters parts
words and counts as one blank. A weight is the share of the n-gram in the text by its inverse document frequency. Document
frequencies cover all documents that may be learned from. The weights are trained by follow-the-regularised-leader with an
elastic net on a sample of at most about `SAMPLE` documents, equally many of each language as far as there are; the
sample is a threshold on a hash of the id, so two runs agree. A fifth of it sets the temperature of the scores.

Null texts and texts without a letter are `und` with score 0, as are all if nothing can be learned. Null languages are not learned
from; neither are rows with a null doc_id. Rows that repeat get equal results. Only doc_id, text and lang are looked at.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from oeuvre.llm import words as w
from oeuvre.llm.shared import mapped, staged, vector_row, vector_sum

ORDERS = (1, 2, 3)
BUCKETS = 1 << 16
NONE = "und"

#: The bound of the training sample, in documents.
SAMPLE = 4000

# Training: rate and its offset, the elastic net, rounds over the sample, scale of the features.
ALPHA, BETA = 0.3, 1.0
L1, L2 = 0.02, 0.1
ROUNDS = 4
SCALE = 10.0

PIECE = 1 << 18

_letters: list[np.ndarray] = []


def letters() -> np.ndarray:
    """Which code points are letters; made once in a process."""
    if not _letters:
        _letters.append(np.array([chr(c).isalpha() for c in range(sys.maxunicode + 1)]))
    return _letters[0]


@dataclass
class Grams:
    """Some texts: for each order the bucket and text of every n-gram; how many each text has; which have letters."""

    buckets: list[np.ndarray]
    owners: list[np.ndarray]
    counts: np.ndarray
    worded: np.ndarray


def grams(texts: list[str]) -> Grams:
    own = ["\0" + (t or "").lower() + "\0" for t in texts]
    codes = np.frombuffer("".join(own).encode("utf-32-le", "replace"), np.uint32)
    doc = np.repeat(np.arange(len(own)), [len(t) for t in own])
    is_letter = letters()[codes]
    stays = is_letter.copy()
    stays[1:] |= is_letter[:-1] | (doc[1:] != doc[:-1])
    stays[:1] = True
    codes, doc = np.where(is_letter, codes, 0)[stays].astype(np.uint64), doc[stays]
    worded = np.bincount(doc[codes > 0], minlength=len(own)) > 0
    buckets, owners, h = [], [], np.zeros(len(codes), np.uint64)
    for n in range(1, max(ORDERS) + 1):
        m = max(0, len(codes) - n + 1)
        h = h[:m] * w.BASE + codes[n - 1 :] + np.uint64(n)
        inside = doc[:m] == doc[n - 1 :]
        if n in ORDERS:
            buckets.append((w.mixed(h[inside]) & np.uint64(BUCKETS - 1)).astype(np.int64))
            owners.append(doc[:m][inside])
    return Grams(buckets, owners, sum(np.bincount(o, minlength=len(own)) for o in owners), worded)


def texts_of(column: pa.Array) -> Iterator[list[str]]:
    """The texts of a batch in pieces of about `PIECE` characters."""
    some, size = [], 0
    for text in column.to_pylist():
        some.append(text)
        size += len(text or "")
        if size > PIECE:
            yield some
            some, size = [], 0
    if some:
        yield some


def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many of this task's documents have each bucket; last, how many documents there are."""
    total = np.zeros(BUCKETS + 1, np.int64)
    for batch in batches:
        for texts in texts_of(batch.column("text")):
            found = grams(texts)
            edges = [np.searchsorted(o, np.arange(len(texts) + 1)) for o in found.owners]
            for i in range(len(texts)):
                has = np.zeros(BUCKETS, bool)
                for b, e in zip(found.buckets, edges, strict=True):
                    has[b[e[i] : e[i + 1]]] = True
                total[:-1] += has
            total[-1] += len(texts)
    yield vector_row(total)


def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The buckets of each document and their counts."""
    for batch in batches:
        rows = []
        for texts in texts_of(batch.column("text")):
            found = grams(texts)
            edges = [np.searchsorted(o, np.arange(len(texts) + 1)) for o in found.owners]
            for i in range(len(texts)):
                rows.append(np.unique(np.concatenate([b[e[i] : e[i + 1]] for b, e in zip(found.buckets, edges, strict=True)]), return_counts=True))
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("lang"),
                batch.column("at"),
                pa.array([r[0].astype(np.int32) for r in rows], pa.list_(pa.int32())),
                pa.array([r[1].astype(np.int32) for r in rows], pa.list_(pa.int32())),
            ],
            ["lang", "at", "buckets", "counts"],
        )


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


def follow_the_leader(rows: list[tuple[np.ndarray, np.ndarray, int]], classes: int) -> np.ndarray:
    """Weights by bucket and class; the last row is the constant's. Rows: buckets, values, class."""
    z, n = np.zeros((BUCKETS + 1, classes)), np.zeros((BUCKETS + 1, classes))

    def weights(zi, ni):
        return np.where(np.abs(zi) > L1, -(zi - np.sign(zi) * L1) / ((BETA + np.sqrt(ni)) / ALPHA + L2), 0.0)

    turn = np.random.Generator(np.random.PCG64(7))
    for _ in range(ROUNDS):
        for k in turn.permutation(len(rows)):
            at, values, target = rows[k]
            zi, ni = z[at], n[at]
            wi = weights(zi, ni)
            off = softmax(values @ wi)
            off[target] -= 1
            g = np.outer(values, off)
            more = ni + g * g
            z[at] = zi + g - (np.sqrt(more) - np.sqrt(ni)) / ALPHA * wi
            n[at] = more
    return weights(z, n)


def temperature(logits: np.ndarray, targets: np.ndarray) -> float:
    """The divisor of the logits with the least log loss: a golden-section search over its logarithm."""
    if not len(targets):
        return 1.0

    def loss(t: float) -> float:
        return -np.log(softmax(logits / np.exp(t))[np.arange(len(targets)), targets] + 1e-12).mean()

    low, high, part = -3.0, 3.0, (5**0.5 - 1) / 2
    for _ in range(40):
        a, b = high - part * (high - low), low + part * (high - low)
        low, high = (low, b) if loss(a) < loss(b) else (a, high)
    return float(np.exp((low + high) / 2))


@dataclass
class Model:
    """Languages, and weights by bucket and language with document frequency, scale and temperature in them."""

    languages: list[str]
    weights: np.ndarray
    constant: np.ndarray

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        found = grams(texts)
        logits = np.zeros((len(texts), len(self.languages)))
        for b, o in zip(found.buckets, found.owners, strict=True):
            at = np.flatnonzero(np.concatenate([[True], o[1:] != o[:-1]])[: len(o)])
            if len(o):
                logits[o[at]] += np.add.reduceat(self.weights[b], at, axis=0)
        p = softmax(logits / np.maximum(found.counts, 1)[:, None] + self.constant)
        best = p.argmax(1)
        names = [self.languages[k] if ok else NONE for k, ok in zip(best, found.worded, strict=True)]
        return names, np.where(found.worded, p.max(1), 0.0)


def trained(rows: list[dict], frequency: np.ndarray) -> Model | None:
    """The model of a sample (lang, at, buckets, counts) and document frequencies."""
    languages = sorted({r["lang"] for r in rows})
    if not languages:
        return None
    rarity = np.log((1 + frequency[-1]) / (1 + frequency[:-1])) + 1
    rows = sorted(rows, key=lambda r: (r["at"], r["lang"]))
    known = []
    for r in rows:
        at, n = np.asarray(r["buckets"], np.int64), np.asarray(r["counts"], float)
        if len(at):
            known.append((np.append(at, BUCKETS), np.append(SCALE * n / n.sum() * rarity[at], 1.0), languages.index(r["lang"])))
    held, own = known[::5], [r for k, r in enumerate(known) if k % 5]
    weights = follow_the_leader(own or held, len(languages))
    logits = np.array([values @ weights[at] for at, values, _ in held]).reshape(-1, len(languages))
    warmth = temperature(logits, np.array([t for *_, t in held], int))
    scaled = weights[:-1] * (SCALE * rarity / warmth)[:, None]
    return Model(languages, scaled.astype(np.float32), weights[-1] / warmth)


def remainder(modulus: int):
    return F.crc32(F.col("doc_id").cast("string")) % modulus


def fit(documents: DataFrame, sample: int = SAMPLE) -> Model | None:
    """A model of documents (doc_id, text, lang) with a language."""
    known = documents.where("doc_id IS NOT NULL AND lang IS NOT NULL").select("doc_id", "text", "lang")
    frequency = vector_sum(mapped(known.select("text"), frequencies, "vector binary"), BUCKETS + 1)
    sizes = known.groupBy("lang").agg(F.count("*").alias("n"))
    sizes = sizes.withColumn("part", F.lit(sample) / F.count("*").over(Window.partitionBy()) / F.col("n")).select("lang", "part")
    at = F.xxhash64(F.lit("sample"), "doc_id", "text")
    chance = F.pmod(at, F.lit(1 << 40)) / F.lit(float(1 << 40))
    picks = known.join(sizes, "lang").where(chance < F.col("part"))
    picks = staged(picks.select(at.alias("pick")).distinct(), "sample")  # about `sample` rows at most
    some = known.withColumn("at", at).join(F.broadcast(picks), F.col("at") == F.col("pick"), "left_semi")
    some = some.groupBy("at").agg(F.min(F.struct("lang", "text")).alias("row")).select("row.lang", "at", "row.text")  # repeated rows once
    rows = mapped(some, counted, "lang string, at long, buckets array<int>, counts array<int>")
    return trained(rows.toArrow().to_pylist(), frequency)


def predicted(documents: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, lang_pred, score of each document."""
    own = documents.sparkSession.sparkContext.broadcast(model)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, scores = [], [np.zeros(0)]
            for texts in texts_of(batch.column("text")):
                found, own_scores = own.value.predict(texts) if own.value else ([NONE] * len(texts), np.zeros(len(texts)))
                names += found
                scores.append(own_scores)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(names, pa.string()), pa.array(np.concatenate(scores))], ["doc_id", "lang_pred", "score"])

    kind = documents.schema["doc_id"].dataType.simpleString()
    return mapped(documents.select("doc_id", "text"), task, f"doc_id {kind}, lang_pred string, score double")


def identify(documents: DataFrame, modulus: int = 5, held: int = 0) -> DataFrame:
    """doc_id, held_out, lang_pred, score. Rows whose crc32(doc_id) mod `modulus` is `held` are never learned from."""
    out = F.coalesce(remainder(modulus) == held, F.lit(False))
    return predicted(documents, fit(documents.where(~out))).select("doc_id", out.alias("held_out"), "lang_pred", "score")


def query(spark, sf_dir: str) -> DataFrame:
    return identify(spark.read.parquet(f"{sf_dir}/documents.parquet"))
