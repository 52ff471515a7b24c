"""Documents linked by the Jaccard similarity of their word shingles (a sparse matrix product in column blocks).

Rows of the matrix are distinct shingle sets (copies are one row), columns are shingles. The product is not formed
whole. Columns are ordered, rare ones first, by a sketch of all shingle counts. The first block of a row is so long that
any linked pair overlaps in it, and a column's place in it limits the sizes of the partners it can be a first common column with. The
product of what is left gives overlap counts, and pairs whose count can't reach the bound that their sizes set are dropped.
The other columns are then counted for the pairs left, and the exact rule decides.

Groups of copies make no pairs of all with all. Each column first names a hub, the row that shares most; each row is compared with
the hub it has most columns in common with, and linked rows become one group. After that only columns that still
hold several groups are multiplied, between different groups. A row that meets a group by columns too late in its block for even
the group's smallest row is not multiplied with it. No link between groups is lost.

A text with fewer words than a shingle has one shingle, all its words. Null and empty texts have no shingle and link with
nothing. Rows with equal text share a component, whether or not their doc_id repeats; a null doc_id is never the
smallest. Other columns are not looked at. Shingles and sets are known by hashes of about 60 bits.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from oeuvre.llm import words as w
from oeuvre.llm.graph import components
from oeuvre.llm.shared import BATCH, bit_map, in_map, lookup, mapped, on_workers, packed, signed, staged, vector_row, vector_sum

SIZE = 5
PERCENT = 75

#: Counters of the sketch that orders columns. It only steers the order, so its errors cost time, never links.
SKETCH = 1 << 22
#: Sets that a task hands over at once.
ROWS = 500
#: A column counted in more than this part of all documents is dealt out in `SALTS` parts.
COMMON = 500
SALTS = 64
COMMON_BIT = 32
PLACE = 31
#: A row is compared with its first hub if they share at least this part of its first block.
SHARED = 0.2
#: How many common columns early in both blocks a pair has to have, where the sizes of its sets promise as many.
EARLY = 8


def shingles(batch: pa.RecordBatch, size: int) -> Iterator[tuple[int, np.ndarray]]:
    """The sorted distinct shingles of each document of a batch that has words."""
    for piece in w.pieces(batch.column("text")):
        text = w.words(piece, lower=True)
        hashes = w.window_hashes(text.hashes, size)
        for i in range(piece.rows):
            a, b = text.bounds[i], text.bounds[i + 1]
            if b - a >= size:
                yield piece.first + i, np.unique(hashes[a : b - size + 1])
            elif b > a:
                yield piece.first + i, w.window_hashes(text.hashes[a:b], int(b - a)) + np.uint64(b - a)


def name(values: np.ndarray) -> int:
    """One hash for a set."""
    sums = np.array([w.mixed(values).sum(), w.mixed(values ^ w.BASE).sum(), np.uint64(len(values))], np.uint64)
    return int(w.mixed((sums * w.powers(w.STEP, 4)[1:]).sum(keepdims=True)).view(np.int64)[0])


def profiles(size: int):
    """For each document its node (the name of its set; null without words) and size, then this task's sketch."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch = np.zeros(SKETCH, np.int32)
        for batch in batches:
            nodes, counts = [None] * batch.num_rows, np.zeros(batch.num_rows, np.int64)
            for i, values in shingles(batch, size):
                nodes[i], counts[i] = name(values), len(values)
                np.add.at(sketch, counters(values >> np.uint64(6)), 1)
            empty = pa.nulls(batch.num_rows, pa.binary())
            yield pa.record_batch({"row": batch.column("row"), "doc_id": batch.column("doc_id"), "node": pa.array(nodes, pa.int64()), "n": pa.array(counts), "vector": empty})
        one = pa.nulls(1, pa.int64())
        yield pa.record_batch({"row": one, "doc_id": one, "node": one, "n": one, "vector": vector_row(sketch).column(0)})

    return task


def counters(columns: np.ndarray) -> np.ndarray:
    """The counter of each column."""
    return (columns & np.uint64(SKETCH - 1)).astype(np.int64)


def ranks(counts: np.ndarray, documents: int) -> np.ndarray:
    """A byte for each counter: the rank of its columns (0, or more the more often they are counted than usual), and `COMMON_BIT`."""
    usual = 2 * counts.mean() + 8
    rank = np.zeros(len(counts), np.uint8)
    often = counts > usual
    rank[often] = np.minimum(np.log2(counts[often] / usual) + 1, 31)
    return rank | np.where(counts > counts.mean() + max(64, documents / COMMON), COMMON_BIT, 0).astype(np.uint8)


def block(n, percent: int = PERCENT):
    """How many first columns of a set of n hold one of any linked partner's first ones."""
    return n - -(-percent * n // 100) + 1


def first_columns(size: int, percent: int, known):
    """Entries (h, salt, node, info): the first columns of each set of a batch. `info` has the size of the set and, below it, the
    column's place in the set."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = known.value
        for batch in batches:
            seen, parts = set(), []
            for _, values in shingles(batch, size):
                node = name(values)
                if node in seen:
                    continue
                seen.add(node)
                k = block(len(values), percent)
                own = values >> np.uint64(6)
                rank = (kinds[counters(own)] & np.uint8(COMMON_BIT - 1)).astype(np.uint64) << np.uint64(58)
                first = np.sort(own | rank)[:k]
                parts.append((first, np.where(kinds[counters(first)] & np.uint8(COMMON_BIT), 1 + (node & (SALTS - 1)), 0), node, len(values)))
                if len(parts) == ROWS:
                    yield entries(parts)
                    parts = []
            if parts:
                yield entries(parts)

    return task


def entries(parts: list) -> pa.RecordBatch:
    times = [len(p[0]) for p in parts]
    return pa.record_batch(
        {
            "h": signed(np.concatenate([p[0] for p in parts])),
            "salt": pa.array(np.concatenate([p[1] for p in parts]).astype(np.int8)),
            "node": pa.array(np.repeat(np.array([p[2] for p in parts], np.int64), times)),
            "info": pa.array(np.concatenate([(p[3] << PLACE) + np.arange(k) for p, k in zip(parts, times, strict=True)])),
        }
    )


def wanted_sets(size: int, known):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch.filter(pa.array(in_map(known.value, batch.column("row").to_numpy(zero_copy_only=False).view(np.uint64))))
            rows, sets = own.column("row").to_pylist(), shingles(own, size)
            while found := list(islice(sets, ROWS)):
                yield pa.record_batch(
                    {
                        "row": pa.array([rows[i] for i, _ in found], pa.int64()),
                        "node": pa.array([name(v) for _, v in found], pa.int64()),
                        "columns": pa.array([v.view(np.int64) for _, v in found], pa.list_(pa.int64())),
                    }
                )

    return task


def sets_of(docs: DataFrame, nodes: DataFrame, wanted: DataFrame, size: int) -> DataFrame:
    """The sets of some nodes, read from one document of each."""
    rows = staged(nodes.join(wanted, "node", "left_semi").select("node", "row"), "wanted")
    known = docs.sparkSession.sparkContext.broadcast(bit_map(rows.select(F.col("row").alias("h")), rows.count()))
    found = mapped(docs.select("row", "text"), wanted_sets(size, known), "row long, node long, columns array<long>")
    return staged(found.join(rows, ["row", "node"], "left_semi").dropDuplicates(["node"]).select("node", "columns"), "sets", BATCH)


def linked(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that the whole sets link."""
    for side in ("a", "b"):
        own = sets.select(F.col("node").alias(side), F.col("columns").alias(f"c{side}"))
        pairs = pairs.join(own, side)
    both = F.size(F.array_intersect("ca", "cb"))
    return pairs.where((100 + percent) * both >= percent * (F.size("ca") + F.size("cb"))).select("a", "b")


def can_link(percent: int):
    return F.lit(100) * F.least("na", "nb") >= F.lit(percent) * F.greatest("na", "nb")


def with_hubs(own: DataFrame, percent: int) -> DataFrame:
    """For each row (h, node, n, shared, root) its best hub in another component: (a, b).

    A column's hub is the row with the largest part of its first block in columns that others have too: of a group of
    copies that is the original rather than a copy with words of its own.
    """
    first = F.max(F.struct("shared", -F.col("n"), "node", "n", "root")).alias("x")
    hub = own.groupBy("h").agg(first, F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high")
    hub = hub.select("h", F.col("x.node").alias("b"), F.col("x.n").alias("nb"), F.col("x.root").alias("rb"))
    pairs = own.join(hub, "h").select(F.col("node").alias("a"), "b", F.col("n").alias("na"), "nb", F.col("root").alias("ra"), "rb")
    pairs = pairs.where((F.col("ra") != F.col("rb")) & can_link(percent)).groupBy("a", "b").agg(F.count("*").alias("k"), F.first("na").alias("na"))
    pairs = pairs.where(F.col("k") >= F.col("na") * (SHARED * (100 - percent) / 100))
    return pairs.groupBy("a").agg(F.max(F.struct("k", "b")).alias("best")).select("a", F.col("best.b").alias("b"))


def least_overlap(a: str, b: str, percent: int):
    """How many columns sets of these sizes have to share."""
    return F.ceil(F.lit(percent) * (F.col(a).cast("long") + F.col(b)) / F.lit(100 + percent))


def many_early(a: str, b: str, percent: int):
    """How many of the first common columns of a linked pair of these sizes surely lie in both first blocks; `EARLY` at most."""
    longer = F.ceil(F.lit(percent) * F.greatest(a, b).cast("long") / F.lit(100))
    return F.least(F.lit(EARLY), least_overlap(a, b, percent) - longer + 1)


def product(own: DataFrame, percent: int) -> DataFrame:
    """All pairs (a, b) of different groups whose first blocks overlap enough for their sizes.

    The k-th common column of a linked pair has at most k - 1 columns more before it, in either set, than the pair may leave
    unshared, so the first `many_early` ones lie in both blocks below a limit: only columns below it name pairs, and of rows that are
    alone, without a group, only pairs with that many of them are looked at. A column that two texts have by chance is not enough.
    Pairs with a row of a group need one, the first. For the pairs named all columns of both first blocks are counted. The row whose block ends first has no more columns left than its block leaves, and after the
    last common column neither has more than its set has left.
    """
    need = least_overlap("na", "nb", percent)
    promised = F.when(F.col("alonea") & F.col("aloneb"), many_early("na", "nb", percent)).otherwise(1)
    def early(many):
        return can_link(percent) & (F.col("placea") < F.col("na") - need + many) & (F.col("placeb") < F.col("nb") - need + many)

    fields = [("node", ""), ("n", "n"), ("place", "place"), ("alone", "alone")]
    sides = {s: [F.col(c).alias(f"{to}{s}") for c, to in fields] for s in "ab"}
    cells = own.groupBy("h", "root").agg(F.min("n").alias("least"), F.count("*").alias("many"))
    cells = staged(cells, "cells")
    mixed = cells.groupBy("h").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high").select("h")
    cells = staged(cells.join(mixed, "h", "left_semi"), "cells")
    rows = staged(own.join(cells.drop("least"), ["h", "root"]), "entries")
    single, group = rows.where("many = 1").drop("many"), rows.where("many > 1").drop("many")
    pairs = single.select("h", *sides["a"]).join(single.select("h", *sides["b"]), "h").where((F.col("a") < F.col("b")) & early(promised))
    # Two groups meet once, a single row and a group by the row.
    large = cells.where("many > 1").select("h", F.col("root").alias("rootb"), "least")
    asked = rows.join(large, "h").where((F.col("root") != F.col("rootb")) & ((F.col("many") == 1) | (F.col("root") < F.col("rootb"))))
    asked = asked.where(F.col("place") <= F.col("n") - least_overlap("n", "least", percent)).select("h", "rootb", *sides["a"][:3])
    more = asked.join(group.select("h", F.col("root").alias("rootb"), *sides["b"][:3]), ["h", "rootb"]).where(early(F.lit(1)))
    more = more.select(F.least("a", "b"), F.greatest("a", "b"), F.lit(1)).distinct()
    met = pairs.select("a", "b", promised.alias("promised")).union(more).groupBy("a", "b").agg(F.count("*").alias("met"), F.first("promised").alias("promised"))
    found = staged(met.where("met >= promised").select("a", "b"), "found")
    ends = found.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    blocks = own.join(ends, "node", "left_semi").groupBy("node").agg(F.first("n").alias("n"), F.sort_array(F.collect_list(F.struct("place", "h"))).alias("block"))
    blocks, both = staged(blocks, "blocks"), found
    for side in "ab":
        own_block = [F.col("n").alias(f"n{side}"), F.col("block.h").alias(f"h{side}"), F.col("block.place").alias(f"places{side}")]
        both = both.join(blocks.select(F.col("node").alias(side), *own_block), side)
    # Blocks have one order, so the last common column is the same one for both.
    both = both.withColumn("common", F.array_intersect("ha", "hb")).withColumn("last", F.element_at("common", -1))
    placea, placeb = (F.element_at(f"places{s}", F.array_position(f"h{s}", F.col("last")).cast("int")) for s in "ab")
    after = F.greatest(*[F.ceil(F.col(n) * percent / 100) - 1 for n in ("na", "nb")])
    left = F.least(F.col("na") - placea - 1, F.col("nb") - placeb - 1, after)
    return both.where(F.size("common") + left >= need).select("a", "b")


def classes(documents: DataFrame, size: int = SIZE, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest doc_id reachable by links), row (a hash of id and text) of each document."""
    spark = documents.sparkSession
    kind = documents.schema["doc_id"].dataType.simpleString()
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("doc_id", "text").alias("row"))
    seen = staged(mapped(docs, profiles(size), "row long, doc_id long, node long, n long, vector binary"), "profiles", BATCH)
    rows = seen.where("vector IS NULL").drop("vector")
    total = rows.count()
    known = spark.sparkContext.broadcast(ranks(vector_sum(seen.where("vector IS NOT NULL"), SKETCH), total))
    nodes = rows.where("node is not null").groupBy("node").agg(F.min("row").alias("row"), F.min("doc_id").alias("least_id"), F.count("*").alias("n_key"))
    nodes = staged(nodes, "nodes")

    entries = mapped(docs.select("text"), first_columns(size, percent, known), "h long, salt byte, node long, info long")
    column = Window.partitionBy("h", "salt")
    live = entries.withColumn("several", (F.min("node").over(column) != F.max("node").over(column)) | (F.col("salt") > 0))
    live = staged(live.where("several").select("h", "node", F.shiftright("info", PLACE).alias("n"), F.col("info").bitwiseAND(F.lit((1 << PLACE) - 1)).alias("place")).distinct(), "live", BATCH)
    shared = live.groupBy("node").agg((F.count("*") / F.first("n")).alias("shared"))
    live = staged(live.join(shared, "node"), "live")

    links, found = None, None
    for step in (with_hubs, product):
        own = live.withColumn("root", F.col("node")).withColumn("alone", F.lit(True))
        if found is not None:
            own = staged(live.join(found, "node", "left").withColumn("alone", F.col("root").isNull()).withColumn("root", F.coalesce("root", "node")), "entries")
        pairs = staged(step(own, percent), "pairs")
        if not pairs.isEmpty():
            ends = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
            new = staged(linked(pairs, sets_of(docs, nodes, ends, size), percent), "links")
            links = new if links is None else links.union(new)
            found = components(links)

    known = nodes.select("node", "least_id", "n_key").withColumn("root", F.col("node"))
    if found is not None:
        known = nodes.join(found, "node", "left").select("node", "least_id", "n_key", F.coalesce("root", "node").alias("root"))
    size_of = known.groupBy("root").agg(F.min("least_id").alias("component"), F.sum("n_key").alias("many"))
    known = staged(known.join(staged(size_of.where("many > 1"), "least"), "root").select("node", "n_key", "component"), "known")
    out = lookup(rows.select("doc_id", "n", "node", "row"), known, "node", F.xxhash64("doc_id", "n"), total)
    named = F.coalesce("component", "doc_id").cast(kind).alias("component_id")
    return out.select(F.col("doc_id").cast(kind).alias("doc_id"), F.col("n").alias("n_shingles"), named, "row")


def one_of_each(documents: DataFrame, size: int = SIZE, percent: int = PERCENT) -> DataFrame:
    """The documents whose doc_id is that of their component, one of each. Of equal rows one stays; rows of different texts that
    share that doc_id all stay, as do those of a component without a doc_id."""
    found = staged(classes(documents, size, percent), "classes").withColumn("stays", F.col("doc_id").eqNullSafe(F.col("component_id")))
    stay = staged(found.where("stays").groupBy(F.col("row").alias("_row")).agg(F.count("*").alias("_times")), "stay")
    asked = found.where("not stays").select(F.col("row").alias("h")).union(stay.where("_times > 1").select("_row"))
    maps = [bit_map(rows, rows.count()) for rows in (asked, stay.select(F.col("_row").alias("h")))]
    docs = packed(documents, _row=F.xxhash64("doc_id", "text"))
    docs = docs.withColumn("_unsure", unsure(documents.sparkSession, maps)("_row"))
    out = docs.where("_unsure = 1").join(stay, "_row")
    once, more = out.where("_times = 1").select("doc"), out.where("_times > 1").dropDuplicates(["_row"]).select("doc")
    out = docs.where("_unsure = 0").select("doc").union(once)
    out = out if stay.where("_times > 1").isEmpty() else out.union(more)
    return out.select("doc.*")


def unsure(spark, maps: list[np.ndarray]):
    """0 for a row that surely stays once, null for one that surely goes, 1 for the few that `stay` has to be asked about. Only they
    are shuffled with their texts. `maps`: rows that go or come several times, and rows that stay."""
    on_workers(spark)
    known = spark.sparkContext.broadcast(maps)

    @F.arrow_udf("int")
    def place(row: pa.Array) -> pa.Array:
        asked, stay = (in_map(bits, row.to_numpy(zero_copy_only=False).view(np.uint64)) for bits in known.value)
        return pa.array(asked.astype(np.int32), mask=asked & ~stay)

    return place


def query(spark, sf_dir: str) -> DataFrame:
    return classes(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("row")
