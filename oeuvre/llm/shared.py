"""Helpers of the operators in this package: cut lineage, keys of repeated rows, bit maps, hot keys."""

from __future__ import annotations

import os
import tempfile
import uuid
import zlib
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A bit map is sent to every task. Its size is this at most, whatever the data.
MAX_BITS = 28
RANGE = 20

#: Keys that hold more than this share of all rows, and more than `HOT_ROWS`, are joined by broadcast.
HOT_SHARE = 10_000
HOT_ROWS = 64

#: Bytes of an Arrow batch of texts, as far as rows allow. An executor holds a batch for each task twice, in the JVM and in the worker.
BATCH = 4 << 20
BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def on_workers(spark: SparkSession) -> None:
    """Lets local Python workers import this package from where it lies, as on a cluster --py-files does."""
    root = str(Path(__file__).resolve().parents[2])
    paths = spark.sparkContext.environment.get("PYTHONPATH", "")
    if spark.sparkContext.master.startswith("local") and root not in paths.split(os.pathsep):
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join([p for p in (paths, root) if p])


def mapped(df: DataFrame, task, schema) -> DataFrame:
    """`mapInArrow`, with this package at hand for the workers."""
    on_workers(df.sparkSession)
    return df.mapInArrow(task, schema)


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; in a local session without one, a folder of this machine."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="checkpoint-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def new_folder(spark: SparkSession, what: str) -> str:
    return os.path.join(shared_folder(spark), f"{what}-{uuid.uuid4().hex}")


@contextmanager
def arrow_batches(spark: SparkSession, size: int | None):
    """Jobs run inside make Arrow batches of at most about `size` bytes; None leaves them as the session has them."""
    before = spark.conf.get(BATCH_BYTES, None)
    if size is not None:
        spark.conf.set(BATCH_BYTES, size)
    try:
        yield
    finally:
        if size is not None:
            spark.conf.unset(BATCH_BYTES) if before is None else spark.conf.set(BATCH_BYTES, before)


def staged(df: DataFrame, what: str = "stage", batch: int | None = None) -> DataFrame:
    """The rows, written as Parquet to the shared folder and read again: a lost executor takes nothing with it. `batch`: bytes of
    the Arrow batches on the way."""
    folder = new_folder(df.sparkSession, what)
    with arrow_batches(df.sparkSession, batch):
        df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def packed(df: DataFrame, **keys: Column) -> DataFrame:
    """Keys and, as one column `doc`, the whole row: no column of the input can clash with a key."""
    return df.select(F.struct("*").alias("doc"), *[c.alias(k) for k, c in keys.items()])


def signed(h: np.ndarray) -> pa.Array:
    return pa.array(h.view(np.int64))


def bit_map(values: DataFrame, n: int) -> np.ndarray:
    """A set of the 64-bit hashes in column `h` as bits, with false hits only.

    `n` is their number or more. 16 bits a value, up to 2 ** MAX_BITS bits in all (32 MB): beyond that more values
    pass, and the exact step that follows has more to do. Each group below has 2 ** RANGE distinct bits at most.
    """
    bits = min(MAX_BITS, max(RANGE, int(16 * max(n, 1)).bit_length()))
    mask = (1 << bits) - 1

    def build(table: pa.Table) -> pa.Table:
        places = table.column("bit").to_numpy()
        part = np.zeros(1 << RANGE, np.uint8)
        part[places & ((1 << RANGE) - 1)] = 1
        return pa.table({"part": pa.array([int(places[0]) >> RANGE], pa.int64()), "bits": pa.array([np.packbits(part).tobytes()], pa.binary())})

    on_workers(values.sparkSession)
    found = (
        values.select(F.col("h").bitwiseAND(F.lit(mask)).alias("bit"))
        .distinct()
        .groupBy(F.shiftright("bit", RANGE).alias("part"))
        .applyInArrow(build, "part long, bits binary")
    )
    out = np.zeros(1 << bits >> 3, np.uint8)
    for row in found.toLocalIterator():
        own = np.frombuffer(row["bits"], np.uint8)
        out[row["part"] * len(own) : (row["part"] + 1) * len(own)] = own
    return out


def in_map(bits: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Which hashes may be in the set."""
    place = (h & np.uint64(len(bits) * 8 - 1)).astype(np.int64)
    return (bits[place >> 3] >> (7 - (place & 7)).astype(np.uint8)) & 1 == 1


def lookup(rows: DataFrame, found: DataFrame, key: str, spread: Column, total: int) -> DataFrame:
    """Left join of `rows` with `found` (one row a key, with column `n_key`: how many of `rows` have it).

    Keys with over total / HOT_SHARE rows are fewer than HOT_SHARE: they meet their rows by broadcast, which that
    number bounds. Their rows, and rows without a key, are then dealt out by `spread` and match nothing.
    """
    least = max(HOT_ROWS, total // HOT_SHARE)
    values = [c for c in found.columns if c not in (key, "n_key")]
    hot = found.where(F.col("n_key") > least).select(F.col(key).alias("_hot"), *[F.col(c).alias(f"_hot_{c}") for c in values])
    rest = found.where(F.col("n_key") <= least).select(F.col(key).alias("_rest"), F.lit(False).alias("_off"), *values)
    out = rows.join(F.broadcast(hot), rows[key] == F.col("_hot"), "left")
    off = F.col("_hot").isNotNull() | F.col(key).isNull()
    out = out.withColumn("_is_off", off).withColumn("_key", F.when(off, spread.cast(rows.schema[key].dataType)).otherwise(F.col(key)))
    out = out.join(rest, (F.col("_key") == F.col("_rest")) & (F.col("_is_off") == F.col("_off")), "left")
    both = [F.coalesce(F.col(f"_hot_{c}"), F.col(c)).alias(c) for c in values]
    return out.select(*rows.columns, *both)


def vector_row(values: np.ndarray) -> pa.RecordBatch:
    """One row with a vector of counts, for `vector_sum`; most of its bytes are zero, so it is packed."""
    return pa.record_batch({"vector": pa.array([zlib.compress(values.astype(np.int64).tobytes(), 1)], pa.binary())})


def _unpacked(raw: bytes) -> np.ndarray:
    return np.frombuffer(zlib.decompress(raw), np.int64)


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = None
    for batch in batches:
        for raw in batch.column("vector"):
            own = _unpacked(raw.as_py())
            total = own.copy() if total is None else np.add(total, own, out=total)
    if total is not None:
        yield vector_row(total)


def vector_sum(vectors: DataFrame, length: int, parts: int = 16) -> np.ndarray:
    """The sum of the vectors of all tasks. `parts` rows of fixed length come to the driver, one after another."""
    rows = mapped(vectors.select("vector").repartition(parts), _summed, "vector binary").toLocalIterator()
    total = np.zeros(length, np.int64)
    for row in rows:
        total += _unpacked(row["vector"])
    return total
