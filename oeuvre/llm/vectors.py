"""Embedding near-dedup with a robust-pruned flat graph.

Vectors of equal label are compared by cosine in double precision. Equal vectors are one node with a count, so a vector
that is common makes no pairs. Centroids of a bounded sample part the space; each node is in the shards (label, centroid) of its
`OVERLAP` nearest ones. In each shard a graph is built: the nearest nodes, pruned so that a neighbour is kept only if no kept one
is nearer to it. The adjacency lists of a node's shards are united. Every node then searches its shards greedily from the medoid,
and expands further as long as it meets nodes nearly in range. Pairs found are verified by the exact rule.

Shards of over `BLOCK` nodes are worked in blocks: a graph for each, searched by all nodes of the shard, so a task holds at most
two blocks and no node is left out. A bounded sample of `AUDIT` nodes is compared with all by brute force; below a recall of `RECALL`
the overlap is doubled, up to three times in all.

Vectors that are null, empty, zero or hold null or non-finite components, and those without a label, link with nothing; so do
vectors of different lengths with each other. Rows that repeat a vec_id are vectors of their own. A null vec_id is never the
smallest. Other columns than vec_id, embedding, label are not looked at.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from oeuvre.llm.graph import components
from oeuvre.llm.shared import lookup, mapped, on_workers, staged

LEAST = 0.98

OVERLAP, MOST_OVERLAP = 3, 12
SHARD = 500
BLOCK = 2000
CHUNK = 200
SAMPLE = 16384
CENTROIDS = 1024

# The graph: neighbours looked at, kept, and how much nearer a kept neighbour must be to prune another.
NEAR = 64
DEGREE = 24
SPREAD = 1.2

# The search: nodes always expanded, nodes expanded at once, how far below the range it goes on.
BEAM = 24
STEP = 16
SLACK = 0.04

AUDIT = 256
RECALL = 0.95

#: Below this recall with the largest overlap, all vectors of a label are compared.
ENOUGH = 0.9


def unit(values: np.ndarray) -> np.ndarray | None:
    """The vector at length 1 in double precision; none if it can't have a direction."""
    x = np.asarray(values, np.float64)
    most = np.abs(x).max(initial=0.0)
    if not np.isfinite(most) or most == 0:
        return None
    x = x / most + 0.0
    return x / np.sqrt(x @ x)


def nodes_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """vec_id and node (a hash of label and direction) and unit vector of each row; null if it links with nothing."""
    for batch in batches:
        column = batch.column("embedding")
        flat = column.values.cast(pa.float64())
        gaps = np.asarray(flat.is_null())
        values, at = flat.to_numpy(zero_copy_only=False), column.offsets.to_numpy()
        labels = batch.column("label").to_pylist()
        nodes, units = [], []
        for i, valid in enumerate(np.asarray(column.is_valid())):
            own = slice(at[i], at[i + 1])
            x = unit(values[own]) if valid and labels[i] is not None and not gaps[own].any() else None
            name = hashlib.blake2b(f"{labels[i]}".encode() + (values[own] + 0.0).tobytes(), digest_size=8).digest() if x is not None else None
            nodes.append(struct.unpack("<q", name)[0] if name else None)
            units.append(x.tobytes() if name else None)
        yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(nodes, pa.int64()), pa.array([str(x) for x in labels]), pa.array(units, pa.binary())], ["vec_id", "node", "label", "unit"])


def matrix(units: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(units), np.float64).reshape(len(units), -1)


def centred(x: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    """k directions by spherical k-means."""
    c = x[np.random.Generator(np.random.PCG64(3)).permutation(len(x))[:k]].copy()
    for _ in range(rounds):
        own = (x @ c.T).argmax(1)
        sums = np.zeros_like(c)
        np.add.at(sums, own, x)
        size = np.sqrt(np.square(sums).sum(1))
        c[size > 0] = sums[size > 0] / size[size > 0, None]
    return c


def centroids(nodes: DataFrame, total: int, most: int) -> dict[int, np.ndarray]:
    """Centroids by vector length, from at most about `SAMPLE` nodes; `most`: nodes of the largest label."""
    chance = F.pmod(F.xxhash64(F.lit("centroid"), "node"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    rows = nodes.where(chance < SAMPLE / max(total, 1)).select("node", "unit").toArrow().sort_by("node").column("unit").to_pylist()
    by: dict[int, list[bytes]] = {}
    for raw in rows:
        by.setdefault(len(raw), []).append(raw)
    k = min(CENTROIDS, -(-most // SHARD))
    return {size: centred(matrix(own), min(k, -(-len(own) // 4))) for size, own in by.items()}


def dealt(known, overlap: int):
    """(node, label, unit, shard) for each of the nearest centroids of each node."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, shards = [], []
            for i, raw in enumerate(batch.column("unit").to_pylist()):
                c = known.value.get(len(raw))
                best = np.argsort(-(c @ np.frombuffer(raw)), kind="stable")[:overlap] if c is not None else [0]
                at += [i] * len(best)
                shards += [f"{len(raw)}:{k}" for k in best]
            own = batch.take(pa.array(at, pa.int64()))
            yield pa.RecordBatch.from_arrays([*own.columns, pa.array(shards, pa.string())], [*own.schema.names, "shard"])

    return task


def pruned(x: np.ndarray) -> np.ndarray:
    """The adjacency lists of the rows of x, filled up with -1."""
    m = len(x)
    near = min(NEAR, m - 1)
    if near < 1:
        return np.full((m, 1), -1)
    kept = np.full((m, DEGREE), -1)
    for first in range(0, m, CHUNK):
        own = np.arange(first, min(first + CHUNK, m))
        sims = x[own] @ x.T
        sims[np.arange(len(own)), own] = -np.inf
        some = np.argpartition(-sims, near - 1, axis=1)[:, :near]
        far = 1 - np.take_along_axis(sims, some, 1)
        order = np.argsort(far, axis=1, kind="stable")
        some, far = np.take_along_axis(some, order, 1), np.take_along_axis(far, order, 1)
        left, rows = np.ones((len(own), near), bool), np.arange(len(own))
        for r in range(DEGREE):
            at = left.argmax(1)
            has = left[rows, at]
            if not has.any():
                break
            best = some[rows, at]
            kept[own[has], r] = best[has]
            between = 1 - np.matmul(x[some], x[best][:, :, None])[:, :, 0]
            left &= ~((SPREAD * between <= far) & has[:, None])
            left[rows, at] = False
    return kept


def build(table: pa.Table) -> pa.Table:
    """Edges (u, v) of the graph of one block of one shard, in both directions."""
    ids = table.column("node").to_numpy()
    adjacent = pruned(matrix(table.column("unit").to_pylist()))
    u, r = np.nonzero(adjacent >= 0)
    v = adjacent[u, r]
    return pa.table({"u": np.concatenate([ids[u], ids[v]]), "v": np.concatenate([ids[v], ids[u]])})


@dataclass
class Lists:
    """Adjacency lists one after another, and where each begins."""

    bounds: np.ndarray
    to: np.ndarray

    def of(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """How many neighbours each of some nodes has, and all of them."""
        n = self.bounds[at + 1] - self.bounds[at]
        before = np.cumsum(n) - n
        return n, self.to[np.repeat(self.bounds[at] - before, n) + np.arange(n.sum())]


def searched(x: np.ndarray, adjacent: Lists, q: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """`searched_some` for all queries, some at a time."""
    found = [searched_some(x, adjacent, q[k : k + CHUNK], own[k : k + CHUNK]) for k in range(0, len(q), CHUNK)]
    return np.concatenate([i + k * CHUNK for k, (i, _) in enumerate(found)]), np.concatenate([j for _, j in found])


def searched_some(x: np.ndarray, adjacent: Lists, q: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The (query, node) pairs in range that the greedy search of each query finds. It begins at the medoid and, for queries
    that are nodes themselves, at their own place (`own`, else -1)."""
    m, n = len(x), len(q)
    sims = np.full((n, m), -np.inf)
    done = np.zeros((n, m), bool)
    start = int((x @ x.mean(0)).argmax())
    sims[:, start] = q @ x[start]
    known = np.flatnonzero(own >= 0)
    sims[known, own[known]] = np.einsum("ij,ij->i", q[known], x[own[known]])
    active = np.arange(n)
    step, beam = min(STEP, m), min(BEAM, m)
    while len(active):
        seen = sims[active]
        bar = np.minimum(np.partition(seen, m - beam, axis=1)[:, m - beam], LEAST - SLACK)
        seen[done[active]] = -np.inf
        best = np.argpartition(seen, m - step, axis=1)[:, m - step :]
        value = np.take_along_axis(seen, best, 1)
        use = np.isfinite(value) & (value >= bar[:, None])
        k, j = np.nonzero(use)
        rows, at = active[k], best[k, j]
        done[rows, at] = True
        degrees, near = adjacent.of(at)
        new = np.zeros((n, m), bool)
        new[np.repeat(rows, degrees), near] = True
        new &= ~np.isfinite(sims)
        rows, to = np.nonzero(new)
        sims[rows, to] = np.einsum("ij,ij->i", q[rows], x[to])
        active = active[use.any(1)]
    return np.nonzero(sims >= LEAST - 1e-9)


def search(table: pa.Table) -> pa.Table:
    """Verified links (a, b), a < b, of the queries of one block with the nodes of another."""
    roles = table.column("role").to_numpy(zero_copy_only=False)
    own, asked = table.filter(pa.array(roles != 2)), table.filter(pa.array(roles != 1))
    none = pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64())})
    if not own.num_rows or not asked.num_rows:
        return none
    order = np.argsort(own.column("node").to_numpy())
    ids = own.column("node").to_numpy()[order]
    x = matrix(own.column("unit").to_pylist())[order]
    lists = [own.column("near")[int(i)].values for i in order]
    places = []
    for v in lists:
        v = v.to_numpy(zero_copy_only=False) if v is not None else np.zeros(0, np.int64)
        at = np.minimum(np.searchsorted(ids, v), len(ids) - 1)
        places.append(at[ids[at] == v])
    adjacent = Lists(np.concatenate([[0], np.cumsum([len(p) for p in places])]), np.concatenate(places))
    theirs = asked.column("node").to_numpy()
    q = matrix(asked.column("unit").to_pylist())
    own_at = np.minimum(np.searchsorted(ids, theirs), len(ids) - 1)
    i, j = searched(x, adjacent, q, np.where(ids[own_at] == theirs, own_at, -1))
    a, b = theirs[i], ids[j]
    exact = (np.einsum("ij,ij->i", q[i], x[j]) >= LEAST) & (a != b)
    a, b = a[exact], b[exact]
    pairs = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], 1), axis=0)
    return pa.table({"a": pairs[:, 0], "b": pairs[:, 1]})


def found_links(nodes: DataFrame, known, overlap: int) -> DataFrame:
    """Links between nodes (node, label, unit)."""
    own = mapped(nodes.select("node", "label", "unit"), dealt(known, overlap), "node long, label string, unit binary, shard string")
    own = staged(own, "shards")
    sizes = staged(own.groupBy("label", "shard").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks")), "sizes")
    own = own.join(sizes, ["label", "shard"]).withColumn("block", F.pmod(F.xxhash64(F.lit("block"), "node"), "blocks").cast("int"))
    edges = own.select("label", "shard", "block", "node", "unit").groupBy("label", "shard", "block").applyInArrow(build, "u long, v long")
    near = staged(edges.groupBy(F.col("u").alias("node")).agg(F.collect_set("v").alias("near")), "near")
    own = own.join(near, "node", "left").withColumn("all", F.sequence(F.lit(0), F.col("blocks") - 1))
    nothing = F.lit(None).cast("array<long>")
    as_node = own.select("label", "shard", "block", F.explode("all").alias("asking"), "node", "unit", "near", F.when(F.col("block") == F.col("asking"), 0).otherwise(1).alias("role"))
    as_query = own.select("label", "shard", F.explode("all").alias("block"), F.col("block").alias("asking"), "node", "unit", nothing.alias("near"), F.lit(2).alias("role"))
    parts = as_node.unionByName(as_query.where("block <> asking"))
    found = parts.select("label", "shard", "block", "asking", "node", "unit", "near", "role").groupBy("label", "shard", "block", "asking").applyInArrow(search, "a long, b long")
    return staged(found.distinct(), "links")


def recall(nodes: DataFrame, links: DataFrame, total: int) -> float:
    """The share of its true links that was found, as a mean over those of about `AUDIT` nodes that have any; brute force
    against all nodes."""
    chance = F.pmod(F.xxhash64(F.lit("audit"), "node"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    asked = nodes.where(chance < AUDIT / max(total, 1)).select("node", "label", "unit").toArrow().to_pylist()
    by: dict[tuple, list] = {}
    for row in asked:
        by.setdefault((row["label"], len(row["unit"])), []).append(row)
    sets = nodes.sparkSession.sparkContext.broadcast({k: (np.array([r["node"] for r in v]), matrix([r["unit"] for r in v])) for k, v in by.items()})

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = [], []
            for node, label, raw in zip(batch.column("node").to_pylist(), batch.column("label").to_pylist(), batch.column("unit").to_pylist(), strict=True):
                ids, x = sets.value.get((label, len(raw)), (np.zeros(0, np.int64), None))
                if len(ids):
                    hit = ids[(x @ np.frombuffer(raw) >= LEAST) & (ids != node)].tolist()
                    a += hit
                    b += [node] * len(hit)
            yield pa.record_batch({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    true = mapped(nodes.select("node", "label", "unit"), task, "a long, b long")
    true = true.select(F.col("b").alias("node"), F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    hits = true.join(links.withColumn("hit", F.lit(1)), ["a", "b"], "left").groupBy("node").agg((F.count("hit") / F.count("*")).alias("share"))
    mean = hits.agg(F.avg("share")).first()[0]
    return 1.0 if mean is None else mean


def compared(table: pa.Table) -> pa.Table:
    """All links between the nodes of two blocks of a label, or within one; `side` is 0 for the first."""
    first = table.column("side").to_numpy() == 0
    one, two = table.filter(pa.array(first)), table.filter(pa.array(~first))
    two = two if two.num_rows else one
    if not one.num_rows:
        return pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64())})
    x, y = matrix(one.column("unit").to_pylist()), matrix(two.column("unit").to_pylist())
    i, j = np.nonzero(x @ y.T >= LEAST - 1e-9)
    exact = np.einsum("ij,ij->i", x[i], y[j]) >= LEAST
    a, b = one.column("node").to_numpy()[i[exact]], two.column("node").to_numpy()[j[exact]]
    pairs = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], 1)[a != b], axis=0)
    return pa.table({"a": pairs[:, 0], "b": pairs[:, 1]})


def all_links(nodes: DataFrame) -> DataFrame:
    """The links of blocks of each label (and length) with blocks of the same, in full: the exact way, should the graph miss links."""
    size = F.octet_length("unit").alias("size")
    counts = nodes.groupBy("label", size).agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    own = nodes.select("node", "label", "unit", size).join(staged(counts, "sizes"), ["label", "size"])
    own = own.withColumn("block", F.pmod(F.xxhash64(F.lit("block"), "node"), "blocks").cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    own = own.select("label", "size", "node", "unit", "block", other)
    keys = [F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), (F.col("block") > F.col("other")).cast("int").alias("side")]
    parts = own.select("label", "size", *keys, "node", "unit")
    return staged(parts.groupBy("label", "size", "low", "high").applyInArrow(compared, "a long, b long").distinct(), "links")


def near_duplicates(embeddings: DataFrame) -> DataFrame:
    """vec_id, n_links, component_id, kept of each vector."""
    spark = embeddings.sparkSession
    on_workers(spark)
    kind = embeddings.schema["vec_id"].dataType.simpleString()
    rows = mapped(embeddings.select("vec_id", "embedding", "label"), nodes_of, f"vec_id {kind}, node long, label string, unit binary")
    rows = staged(rows, "vectors")
    nodes = rows.where("node IS NOT NULL").groupBy("node").agg(F.min("label").alias("label"), F.min("unit").alias("unit"), F.min("vec_id").alias("least_id"), F.count("*").alias("n_key"))
    nodes = staged(nodes, "nodes")
    total = nodes.count()
    most = nodes.groupBy("label").count().agg(F.max("count")).first()[0] or 0
    known = spark.sparkContext.broadcast(centroids(nodes, total, most))
    overlap = OVERLAP
    links = found_links(nodes, known, overlap)
    share = recall(nodes, links, total)
    while share < RECALL and overlap < MOST_OVERLAP:
        overlap *= 2
        links = found_links(nodes, known, overlap)
        share = recall(nodes, links, total)
    if share < ENOUGH:
        links = all_links(nodes)
    both = links.union(links.select("b", "a"))
    sizes = nodes.select(F.col("node").alias("b"), "n_key")
    degrees = both.join(sizes, "b").groupBy(F.col("a").alias("node")).agg(F.sum("n_key").alias("others"))
    roots = components(links)
    own = nodes.drop("unit", "label").join(degrees, "node", "left").join(roots, "node", "left")
    own = staged(own.select("node", "n_key", "least_id", (F.coalesce("others", F.lit(0)) + F.col("n_key") - 1).alias("n_links"), F.coalesce("root", "node").alias("root")), "degrees")
    least = staged(own.groupBy("root").agg(F.min("least_id").alias("component")), "least")
    found = staged(own.join(least, "root").where("n_links > 0").select("node", "n_key", "n_links", "component"), "found")
    out = lookup(rows.select("vec_id", "node"), found, "node", F.xxhash64("vec_id"), rows.count())
    component = F.coalesce("component", "vec_id").alias("component_id")
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component)
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def query(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
