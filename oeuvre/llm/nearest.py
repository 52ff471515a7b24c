"""Nearest neighbours by inner product: a block matrix join of int8 tiles, with exact results.

Vectors are packed into blocks, and every block of queries meets every block of candidates of its length once: a tile. In a tile
both sides are rounded to int8 with a scale a vector, x = scale * int8 + rest. The integer products are exact, and by the norms of
the rests the true product lies within |x||rest y| + |rest x||rounded y| of them. A query's bar is the score of its k-th best so
far, or the k-th largest lower bound before it has k. Pairs whose upper bound reaches the bar are recomputed in double precision
from the original vectors and go to the query's heap of k. The sorted lists of `FAN` tiles at a time are then merged by a heap.

So no pair leaves its tile unless it is among the best k there, and no pair is lost. The product is the sum of the products of the
components in their order, in double precision. Of equal vectors only the k + 1 with the smallest ids can be among the k nearest
of any query, so only these are candidates: a vector that a third of the rows repeat does not survive a third of the time.

Vectors that are null, empty, zero or hold null or non-finite components take no part; vectors of different lengths do not meet.
Rows that repeat a vec_id are rows of their own: each is a query if its id asks, and a candidate for the others. Of equal scores
the smaller vec_id is nearer, and a null vec_id is the largest; it is a candidate, never a query. A product that overflows to no
number counts as minus infinity. Other columns than vec_id and embedding are not looked at.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from oeuvre.llm.shared import mapped, on_workers, staged

NEAREST = 20
EVERY = 20

# Sizes of the blocks: vectors at most, and bytes of them as doubles.
CANDIDATES, CANDIDATE_BYTES = 8192, 32 << 20
QUERIES, QUERY_BYTES = 2048, 16 << 20
STRIP = 1024
PAIRS = 1 << 16

#: Tiles whose lists one step merges.
FAN = 16

#: int8 products of so many components add up exactly in single precision.
EXACT = 1024


def rows_of(kind: np.dtype):
    """vec_id, asks, and the components of each vector that takes part, as bytes."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("embedding")
            flat = column.values.cast(pa.from_numpy_dtype(kind))
            bad = np.concatenate([[0], np.cumsum(~np.isfinite(flat.fill_null(np.nan).to_numpy(zero_copy_only=False)))])
            values = flat.fill_null(0.0).to_numpy(zero_copy_only=False) + kind.type(0)
            some = np.concatenate([[0], np.cumsum(values != 0)])
            at = column.offsets.to_numpy()
            fits = np.asarray(column.is_valid()) & (bad[at[1:]] == bad[at[:-1]]) & (some[at[1:]] > some[at[:-1]])
            own = np.flatnonzero(fits)
            raw = [values[at[i] : at[i + 1]].tobytes() for i in own]
            left = batch.take(pa.array(own, pa.int64()))
            yield pa.RecordBatch.from_arrays([left.column("vec_id"), left.column("asks"), pa.array(raw, pa.binary())], ["vec_id", "asks", "raw"])

    return task


def packed_block(key: tuple, table: pa.Table) -> pa.Table:
    """One row of a block: the numbers of its rows, their ids and all components."""
    order = table.sort_by("rid")
    one = {"dim": [key[0].as_py()], "block": [key[1].as_py()]}
    lists = {c: pa.array([order.column(c).to_pylist()], pa.list_(pa.int64())) for c in ("rid", "vec_id")}
    return pa.table(one | lists | {"raw": [b"".join(order.column("raw").to_pylist())]})


def blocks(rows: DataFrame) -> DataFrame:
    """Vectors (rid, vec_id, raw, dim, of) in `of` blocks of each length, one row a block."""
    block = F.pmod(F.xxhash64(F.lit("block"), "rid"), F.col("of")).alias("block")
    own = rows.select("dim", block, "rid", "vec_id", "raw")
    return staged(own.groupBy("dim", "block").applyInArrow(packed_block, "dim long, block long, rid array<long>, vec_id array<long>, raw binary"), "blocks")


def rounded(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """int8 components, scale, length of the vector and of the rest, of each row of x."""
    scale = np.maximum(np.abs(x).max(1) / 127, np.finfo(np.float64).tiny)
    own = np.clip(np.rint(x / scale[:, None]), -127, 127)
    rest = x - own * scale[:, None]
    return own.astype(np.int8), scale, np.sqrt(np.square(x).sum(1)), np.sqrt(np.square(rest).sum(1))


def int_products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The exact products of int8 rows. Up to `EXACT` components they fit single precision, whose matrix product is fast."""
    total = np.zeros((len(a), len(b)))
    for k in range(0, a.shape[1], EXACT):
        total += a[:, k : k + EXACT].astype(np.float32) @ b[:, k : k + EXACT].astype(np.float32).T
    return total


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The product of each row of a with that of b; both by component, summed in their order."""
    total = np.zeros(a.shape[1])
    for x, y in zip(a, b, strict=True):
        total += x * y
    return total


class Best:
    """The k best candidates of each query, as heaps whose first entry is the farthest."""

    def __init__(self, n: int, k: int):
        self.k, self.heaps = k, [[] for _ in range(n)]
        self.bar = np.full(n, -np.inf)

    def add(self, at: np.ndarray, score: np.ndarray, ids: np.ndarray, rids: np.ndarray) -> None:
        """Candidates of the queries `at`; of each query's only the k best of them go to its heap."""
        near = np.where(np.isnan(score), -np.inf, score)
        order = np.lexsort((rids, ids, -near, at))
        first = np.searchsorted(at[order], at[order])
        order = order[np.arange(len(order)) - first < self.k]
        for i, s, own, rid in zip(at[order].tolist(), near[order].tolist(), ids[order].tolist(), rids[order].tolist(), strict=True):
            heap = self.heaps[i]
            if len(heap) < self.k:
                heapq.heappush(heap, (s, -own, -rid))
            else:
                heapq.heappushpop(heap, (s, -own, -rid))
        for i in np.unique(at).tolist():
            if len(self.heaps[i]) == self.k:
                self.bar[i] = max(self.bar[i], self.heaps[i][0][0])


def strips(q: np.ndarray, q_rids: np.ndarray, c: np.ndarray, c_rids: np.ndarray, c_ids: np.ndarray, k: int) -> Best:
    """The k best of the candidates for each query."""
    best = Best(len(q), k)
    q8, q_scale, q_size, q_rest = rounded(q)
    by_query = np.ascontiguousarray(q.T)
    for first in range(0, len(c), STRIP):
        x, rids, ids = c[first : first + STRIP], c_rids[first : first + STRIP], c_ids[first : first + STRIP]
        x8, scale, size, rest = rounded(x)
        near = int_products(q8, x8) * q_scale[:, None] * scale
        off = q_size[:, None] * rest + q_rest[:, None] * (size + rest)
        off = off * (1 + 1e-6) + 1e-9 * q_size[:, None] * size
        near[np.isnan(near)], off[np.isnan(off)] = 0, np.inf
        place = np.minimum(np.searchsorted(rids, q_rids), len(rids) - 1)
        own = np.flatnonzero(rids[place] == q_rids)
        low = near - off
        low[own, place[own]] = -np.inf
        if len(x) > k:
            best.bar = np.maximum(best.bar, np.partition(low, len(x) - k, axis=1)[:, len(x) - k])
        high = near + off
        high[own, place[own]] = np.nan
        i, j = np.nonzero(high >= best.bar[:, None])
        by_candidate = np.ascontiguousarray(x.T)
        for at in range(0, len(i), PAIRS):
            a, b = i[at : at + PAIRS], j[at : at + PAIRS]
            best.add(a, products(by_query[:, a], by_candidate[:, b]), ids[b], rids[b])
    return best


LIST = "dim long, block long, tile long, rid long, vec_id long, scores array<double>, ids array<long>, rids array<long>"
FIELDS = pa.schema([("dim", pa.int64()), ("block", pa.int64()), ("tile", pa.int64()), ("rid", pa.int64()), ("vec_id", pa.int64()), ("scores", pa.list_(pa.float64())), ("ids", pa.list_(pa.int64())), ("rids", pa.list_(pa.int64()))])


def tile(k: int, kind: np.dtype):
    """The k nearest that a block of candidates holds for each query of a block."""

    def task(key: tuple, asked: pa.Table, held: pa.Table) -> pa.Table:
        if not asked.num_rows or not held.num_rows:
            return FIELDS.empty_table()
        dim = key[0].as_py()
        side = lambda t, c: t.column(c)[0].values
        q_rids, c_rids = side(asked, "rid").to_numpy(), side(held, "rid").to_numpy()
        q, c = (np.frombuffer(t.column("raw")[0].as_py(), kind).reshape(-1, dim).astype(np.float64) for t in (asked, held))
        ids = side(held, "vec_id")
        known = np.asarray(ids.is_valid())
        order = np.where(known, ids.fill_null(0).to_numpy(), np.iinfo(np.int64).max)
        with np.errstate(over="ignore", invalid="ignore"):
            best = strips(q, q_rids, c, c_rids, order, k)
        null = set(c_rids[~known].tolist())
        rows = []
        for rid, own, heap in zip(q_rids.tolist(), side(asked, "vec_id").to_pylist(), best.heaps, strict=True):
            found = sorted(heap, reverse=True)
            rids = [-x[2] for x in found]
            rows.append((rid, own, [x[0] for x in found], [None if r in null else -x[1] for x, r in zip(found, rids, strict=True)], rids))
        cols = list(zip(*rows, strict=True))
        n = len(rows)
        return pa.Table.from_arrays([pa.array(v, f.type) for v, f in zip([[dim] * n, [key[1].as_py()] * n, [key[2].as_py()] * n, *cols], FIELDS, strict=True)], schema=FIELDS)

    return task


def merged(k: int):
    """One list of the k best for each query, from the lists of several tiles."""

    def entries(row: dict) -> list[tuple]:
        each = zip(row["scores"], row["ids"], row["rids"], strict=True)
        return [(-s, own is None, own or 0, rid) for s, own, rid in each]

    def task(key: tuple, table: pa.Table) -> pa.Table:
        by: dict[int, list] = {}
        names: dict[int, int] = {}
        for row in table.to_pylist():
            by.setdefault(row["rid"], []).append(entries(row))
            names[row["rid"]] = row["vec_id"]
        rows = []
        for rid, lists in by.items():
            best = list(islice(heapq.merge(*lists), k))
            rows.append((rid, names[rid], [-x[0] for x in best], [None if x[1] else x[2] for x in best], [x[3] for x in best]))
        cols = list(zip(*rows, strict=True))
        n = len(rows)
        return pa.Table.from_arrays([pa.array(v, f.type) for v, f in zip([[key[0].as_py()] * n, [key[1].as_py()] * n, [key[2].as_py()] * n, *cols], FIELDS, strict=True)], schema=FIELDS)

    return task


def nearest(embeddings: DataFrame, asks: Column | None = None, k: int = NEAREST) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest other rows of each row that asks (default: vec_id divisible by `EVERY`).

    The sizes of the blocks, a row for each length of vectors, are sent to every task: with lengths 1, 2, 3 ... in it, a table
    of b bytes has fewer than the square root of b of them.
    """
    on_workers(embeddings.sparkSession)
    asks = F.pmod(F.col("vec_id").cast("long"), F.lit(EVERY)) == 0 if asks is None else asks
    given = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding", F.coalesce(asks, F.lit(False)).alias("asks"))
    kind = np.dtype(np.float32 if "float" in embeddings.schema["embedding"].dataType.simpleString() else np.float64)
    rows = mapped(given, rows_of(kind), "vec_id long, asks boolean, raw binary")
    rows = staged(rows.select(F.monotonically_increasing_id().alias("rid"), "vec_id", "asks", "raw", F.expr(f"octet_length(raw) div {kind.itemsize}").alias("dim")), "vectors")
    copies = Window.partitionBy(F.xxhash64("raw"), "raw").orderBy(F.col("vec_id").asc_nulls_last(), "rid")
    held = rows.withColumn("_nth", F.row_number().over(copies)).where(F.col("_nth") <= k + 1)
    held = staged(held.select("rid", "vec_id", "raw", "dim"), "held")
    asked = rows.where("asks")
    sizes = held.groupBy("dim").agg(F.count("*").alias("n")).join(asked.groupBy("dim").agg(F.count("*").alias("m")), "dim")
    per = lambda most, size: F.greatest(F.lit(1), F.least(F.lit(most), F.expr(f"{size} div (8 * dim)")))
    sizes = sizes.select("dim", F.ceil(F.col("n") / per(CANDIDATES, CANDIDATE_BYTES)).alias("tiles"), F.ceil(F.col("m") / per(QUERIES, QUERY_BYTES)).alias("of"))
    sizes = staged(sizes, "sizes")
    some = lambda df, of: df.join(F.broadcast(sizes.select("dim", F.col(of).alias("of"))), "dim")
    left, right = blocks(some(asked, "of")), blocks(some(held, "tiles"))
    both = F.broadcast(sizes)
    left = left.join(both, "dim").select("dim", "block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1)).alias("tile"), "rid", "vec_id", "raw")
    right = right.join(both, "dim").select("dim", F.explode(F.sequence(F.lit(0).cast("long"), F.col("of") - 1)).alias("block"), F.col("block").alias("tile"), "rid", "vec_id", "raw")
    keys = ["dim", "block", "tile"]
    lists = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(tile(k, kind), LIST)
    tiles = sizes.agg(F.max("tiles")).first()[0] or 1
    while tiles > 1:
        lists = lists.withColumn("tile", F.expr(f"tile div {FAN}"))
        lists = lists.groupBy(*keys).applyInArrow(merged(k), LIST)
        tiles = -(-tiles // FAN)
    each = lists.select(F.col("vec_id").alias("query_id"), F.posexplode(F.arrays_zip("ids", "scores")).alias("place", "x"))
    return each.select("query_id", (F.col("place") + 1).alias("rank"), F.col("x.ids").alias("vec_id"), F.col("x.scores").alias("score"))


def query(spark, sf_dir: str) -> DataFrame:
    return nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
