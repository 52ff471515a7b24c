"""Exact substring dedup: words inside long repeated passages are removed (difference-cover anchors).

Two equal windows of `width` words at places i and j share an offset below `PERIOD` at which both i + offset and
j + offset lie in the difference cover modulo `PERIOD`. So the shorter anchor windows are hashed at cover places only,
a quarter of all places, and a repeated window always holds a repeated anchor. Around repeated anchors the match
is then extended to every full window that holds one, and these are compared exactly.

Null and empty texts have no words. A row that occurs twice repeats all its windows. Texts shorter than `width` words
are kept whole. Other columns of the input are not looked at. Windows are compared by hashes of 64 bits.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from oeuvre.llm import words as w
from oeuvre.llm.shared import bit_map, in_map, mapped, signed, staged

WIDTH = 35

# A perfect difference set, every remainder modulo 21 is a difference of two members.
PERIOD = 21
COVER = [3, 6, 7, 12, 14]


def anchor_places(text: w.Words, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the anchors, and the word at which each begins."""
    size = width - PERIOD + 1
    cover = np.zeros(PERIOD, bool)
    cover[COVER] = True
    n = max(0, len(text.hashes) - size + 1)
    at = np.flatnonzero(cover[text.places()[:n] % PERIOD] & w.window_starts(text.bounds, size))
    return w.window_hashes(text.hashes, size)[at], at


def anchors(width: int):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [anchor_places(w.words(piece), width)[0] for piece in w.pieces(batch.column("text"))]
            values, counts = np.unique(np.concatenate([np.zeros(0, np.uint64), *found]), return_counts=True)
            yield pa.record_batch({"h": signed(values), "many": pa.array(counts > 1)})

    return task


def candidate_windows(piece: w.Piece, width: int, known: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, row and first place of the windows that hold an anchor that may be repeated."""
    text = w.words(piece)
    values, at = anchor_places(text, width)
    at = at[in_map(known, values)]
    inside = w.window_starts(text.bounds, width)
    if not len(at) or not len(inside):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    near = np.zeros(len(text.hashes) + 1, np.int64)
    np.add.at(near, np.maximum(at - PERIOD + 1, 0), 1)
    np.add.at(near, at + 1, -1)
    at = np.flatnonzero(inside & (np.cumsum(near)[: len(inside)] > 0))
    row = np.searchsorted(text.bounds, at, "right") - 1
    return w.window_hashes(text.hashes, width)[at], row + piece.first, at - text.bounds[row]


def windows(width: int, known):
    """Rows (kind, key, row, start, n, again). Kind 0: the first window of a hash in this batch. Kind 1: runs of later
    ones, which are repeated for sure. So a passage sends one row a batch to be counted, however common it is."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [candidate_windows(piece, width, known.value) for piece in w.pieces(batch.column("text"))]
            if not found:
                continue
            values, rows, places = (np.concatenate([f[k] for f in found]) for k in range(3))
            ids = batch.column("row").to_numpy(zero_copy_only=False)
            keys, first, counts = np.unique(values, return_index=True, return_counts=True)
            later = np.ones(len(values), bool)
            later[first] = False
            r, s = rows[later], places[later]
            begins = np.flatnonzero(np.concatenate([[True], (r[1:] != r[:-1]) | (s[1:] != s[:-1] + 1)])[: len(r)])
            runs = np.diff(np.append(begins, len(r)))
            r, s = r[begins], s[begins]
            own = w.mixed(ids[r].view(np.uint64) ^ s.astype(np.uint64))
            yield pa.record_batch(
                {
                    "kind": pa.array(np.repeat(np.array([0, 1], np.int8), [len(keys), len(r)])),
                    "key": signed(np.concatenate([keys, own])),
                    "row": pa.array(ids[np.concatenate([rows[first], r])]),
                    "start": pa.array(np.concatenate([places[first], s]).astype(np.int32)),
                    "n": pa.array(np.concatenate([np.ones(len(keys)), runs]).astype(np.int32)),
                    "again": pa.array(np.concatenate([counts > 1, np.ones(len(r), bool)])),
                }
            )

    return task


def digest(kept: bytes) -> str:
    return hashlib.sha256(kept).hexdigest()


SCHEMA = "doc_id {kind}, n_words long, n_removed long, kept_sha256 string, kept string"


def result(ids, counts, removed, kept: list[bytes], text: bool) -> pa.RecordBatch:
    return pa.record_batch(
        {
            "doc_id": ids,
            "n_words": pa.array(counts, pa.int64()),
            "n_removed": pa.array(removed, pa.int64()),
            "kept_sha256": pa.array([digest(k) for k in kept], pa.string()),
            "kept": pa.array(kept if text else [None] * len(kept), pa.binary()).cast(pa.string()),
        }
    )


def untouched(known, text: bool):
    """The result of rows without a repeated window."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            off = ~in_map(known.value, batch.column("row").to_numpy(zero_copy_only=False).view(np.uint64))
            own = batch.filter(pa.array(off))
            kept = [(t or b"").split() for t in own.column("text").cast(pa.binary()).to_pylist()]
            yield result(own.column("doc_id"), [len(k) for k in kept], [0] * len(kept), [b" ".join(k) for k in kept], text)

    return task


def touched(known):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(in_map(known.value, batch.column("row").to_numpy(zero_copy_only=False).view(np.uint64))))

    return task


def cut(width: int, text: bool):
    """The result of rows with their repeated windows."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, removed, kept = [], [], []
            runs = batch.column("runs")
            starts, ns = (runs.values.field(k).to_numpy(zero_copy_only=False) for k in ("start", "n"))
            at = runs.offsets.to_numpy()
            for i, raw in enumerate(batch.column("text").cast(pa.binary())):
                all_words = (raw.as_py() or b"").split()
                near = np.zeros(len(all_words) + 1, np.int64)
                if runs.is_valid()[i].as_py():
                    own = slice(at[i], at[i + 1])
                    np.add.at(near, starts[own], 1)
                    np.add.at(near, starts[own] + ns[own] + width - 1, -1)
                stays = np.cumsum(near)[:-1] == 0
                counts.append(len(all_words))
                removed.append(len(all_words) - int(stays.sum()))
                kept.append(b" ".join([x for x, ok in zip(all_words, stays.tolist(), strict=True) if ok]))
            yield result(batch.column("doc_id"), counts, removed, kept, text)

    return task


def remove_repeats(documents: DataFrame, width: int = WIDTH, text: bool = True) -> DataFrame:
    """Each document with the words left when repeated windows of `width` words are removed: doc_id, n_words,
    n_removed, kept_sha256 and, if `text`, kept. `width` must exceed `PERIOD`."""
    if width <= PERIOD:
        raise ValueError(f"width must be over {PERIOD}")
    spark = documents.sparkSession
    docs = documents.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("row"))
    found = mapped(docs.select("text"), anchors(width), "h long, many boolean")
    twice = staged(found.groupBy("h").agg((F.count("*") + F.max(F.col("many").cast("int"))).alias("n")).where("n > 1").select("h"), "anchors")
    known = spark.sparkContext.broadcast(bit_map(twice, twice.count()))
    held = mapped(docs.select("text", "row"), windows(width, known), "kind byte, key long, row long, start int, n int, again boolean")
    held = held.withColumn("times", F.count("*").over(Window.partitionBy("kind", "key"))).where("again or times > 1")
    runs = staged(held.groupBy("row").agg(F.collect_list(F.struct("start", "n")).alias("runs")), "runs")
    rows = spark.sparkContext.broadcast(bit_map(runs.select(F.col("row").alias("h")), runs.count()))
    schema = SCHEMA.format(kind=documents.schema["doc_id"].dataType.simpleString())
    part = mapped(docs, touched(rows), docs.schema).join(runs, "row", "left")
    return mapped(docs, untouched(rows, text), schema).unionByName(mapped(part, cut(width, text), schema))


def query(spark, sf_dir: str) -> DataFrame:
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return remove_repeats(documents, text=False).drop("kept")
