"""Prefix trie of conversations, with subtree totals by parallel tree contraction.

A conversation is its turns in order (turn, null first; turns that tie by a digest of role and text). A null role or text is empty,
and rows without a conv_id belong to no conversation. Conversations are rebuilt: conversation c takes the first h(c) turns of
conversation c - c % 20 (all if it has fewer, none if it is absent), then its own turns after its first h(c); h is crc32(c) % 4.

*Nodes.* A turn is a 128-bit digest of role and text. A node, the sequence of the first d turns, is named by a digest of the digests:
within a segment of `SEGMENT` turns over all of them so far, and before it over the names of the segments, found the same way. So
a conversation of any length is named in parallel, a logarithmic number of levels, and no task holds more than a segment of it.

*Contraction.* Rounds alternate until no node is left. Compress: in each chain of nodes with one child, pointer jumping (join
rounds, the reach doubles) finds the first node below that isn't one, and the sums on the way; the chain becomes the weight
of one edge. Rake: leaves are finished, and their totals go to their parents in one aggregate. Every round removes all leaves
and unary nodes, so half of the nodes at least. Then the chains are re-expanded, last round first: the total of a node is the
sum of its part of the chain and the total of the node at its end.

Any node may have any number of children, members or ends, and any conversation any number of turns: places are counted by ranges,
totals by partial aggregates, and lookups of frequent keys are broadcast, fewer than `shared.HOT_SHARE`. The SHA-256 of a node's ends is
serial by definition: one task streams through the numbers, `CHUNK` a row, and holds one batch.

An empty table gives no nodes. Rows that repeat are turns of their own. Other columns than conv_id, turn, role, text are not
looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from oeuvre.llm.shared import lookup, mapped, staged
from oeuvre.operators.order import positions

# Conversations that share one to begin with, and how many turns at most, plus one.
FAMILY = 20
SHARED = 4

WORD = r"[^\x20\x09-\x0D]+"
SEGMENT = 64
ROOT = "root"

#: The ends of a node are put together by ranges of 2 ** CHUNK numbers.
CHUNK = 8


def digest(text: Column) -> Column:
    """128 bits of SHA-256, as text."""
    return F.substring(F.sha2(text.cast("binary"), 256), 1, 32)


def turns_of(conversations: DataFrame) -> DataFrame:
    """conv_id, place (from 0), t (digest), words of each turn."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    rows = conversations.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv_id"),
        "turn",
        digest(F.concat(F.length(role).cast("string"), F.lit(":"), role, text)).alias("t"),
        F.regexp_count(text, F.lit(WORD)).cast("long").alias("words"),
    )
    return positions(rows, [F.col("turn").asc_nulls_first(), "t"], "conv_id", "place").drop("turn")


def borrowed(conv_id: Column) -> Column:
    """How many turns a conversation takes from the first of its family, if that has them."""
    return F.pmod(F.crc32(conv_id.cast("string").cast("binary")), F.lit(SHARED))


def rebuilt(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The conversations (conv_id, n) and their turns after rebuilding (conv_id, pos, t, words)."""
    turns = staged(turns_of(conversations), "turns")
    convs = turns.groupBy("conv_id").agg(F.count("*").alias("n"))
    convs = convs.withColumn("h", borrowed(F.col("conv_id"))).withColumn("base", F.col("conv_id") - F.col("conv_id") % FAMILY)
    convs = staged(convs, "conversations")
    firsts = convs.where("conv_id = base").select("base", F.col("n").alias("base_n"))
    convs = convs.join(firsts, "base", "left")
    convs = staged(convs.withColumn("lent", F.least("h", F.coalesce("base_n", F.lit(0)))).drop("base_n"), "lent")

    # A turn keeps its place if all turns before it were replaced; few conversations got fewer than they gave up.
    others = F.col("conv_id") % FAMILY != 0
    h = borrowed(F.col("conv_id"))
    own = turns.where(~others | (F.col("place") >= h))
    less = convs.where("lent < h AND conv_id <> base").select("conv_id", (F.col("h") - F.col("lent")).alias("less"), F.col("n").alias("n_key"))
    own = lookup(own, less, "conv_id", F.xxhash64("conv_id", "place"), turns.count())
    own = own.select("conv_id", (F.col("place") - F.coalesce("less", F.lit(0))).alias("pos"), "t", "words")
    heads = turns.where((F.col("place") < SHARED - 1) & ~others).select(F.col("conv_id").alias("base"), F.col("place").alias("pos"), "t", "words")
    taken = convs.where("lent > 0 AND conv_id <> base").join(heads, "base").where("pos < lent")
    rows = own.unionByName(taken.select("conv_id", "pos", "t", "words"))
    return convs.select("conv_id", "n"), staged(rows, "rebuilt")


def named(rows: DataFrame, longest: int) -> DataFrame:
    """The rows (conv_id, pos, t) with `id`, the name of the sequence up to each, and `parent`, that of the one before."""
    rows = rows.withColumn("seg", F.expr(f"pos div {SEGMENT}"))
    order = Window.partitionBy("conv_id", "seg").orderBy("pos")
    upto = F.collect_list("t").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    rows = rows.withColumn("inner", digest(F.array_join(upto, "")))
    rows = rows.withColumn("inner_before", F.lag("inner").over(order))
    if longest <= SEGMENT:
        return rows.withColumn("id", F.col("inner")).withColumn("parent", F.coalesce("inner_before", F.lit(ROOT))).drop("seg", "inner", "inner_before")
    rows = staged(rows, "segments")
    ends = rows.where(F.col("pos") % SEGMENT == SEGMENT - 1).select("conv_id", F.col("seg").alias("pos"), F.col("inner").alias("t"))
    above = named(ends, -(-longest // SEGMENT))
    above = above.select("conv_id", (F.col("pos") + 1).alias("seg"), F.col("id").alias("before"), digest(F.concat("parent", "t")).alias("last"))
    rows = rows.join(above, ["conv_id", "seg"], "left")
    before = F.coalesce("before", F.lit(ROOT))
    earlier = F.when(F.col("inner_before").isNotNull(), digest(F.concat(before, F.col("inner_before")))).otherwise(F.coalesce("last", F.lit(ROOT)))
    rows = rows.withColumn("id", digest(F.concat(before, F.col("inner")))).withColumn("parent", earlier)
    return rows.drop("seg", "inner", "inner_before", "before", "last")


def jumped(chain: DataFrame, values: Sequence[str]) -> DataFrame:
    """Chains (id, next, done, sums) with `next` at the end of the chain: each round doubles the reach of the open ones."""
    chain = staged(chain, "chains")
    while not chain.where("NOT done").isEmpty():
        ahead = chain.select(F.col("id").alias("next"), F.col("next").alias("_next"), F.col("done").alias("_done"), *[F.col(v).alias(f"_{v}") for v in values])
        # Open pointers lead to different nodes, so this join is one to one.
        step = chain.where("NOT done").drop("done").join(ahead, "next")
        step = step.select("id", F.col("_next").alias("next"), F.col("_done").alias("done"), *[(F.col(v) + F.col(f"_{v}")).alias(v) for v in values])
        chain = staged(chain.where("done").unionByName(step), "chains")
    return chain


def totals(tree: DataFrame, values: Sequence[str]) -> DataFrame:
    """id and the sums of the values over each node's subtree, from (id, parent, values); the parent of a root is null."""
    extra = [f"e_{v}" for v in values]
    live = tree.select("id", "parent", *values, *[F.lit(0).cast("long").alias(e) for e in extra])
    live = staged(live, "live")
    logs, done = [], []
    while not live.isEmpty():
        below = live.where("parent IS NOT NULL").groupBy(F.col("parent").alias("id")).agg(F.count("*").alias("kids"), F.min("id").alias("only"))
        state = staged(live.join(below, "id", "left"), "state")
        unary = state.where("kids = 1 AND parent IS NOT NULL")
        child = state.select(F.col("id").alias("only"), (F.coalesce("kids", F.lit(0)) != 1).alias("done"), *[F.col(e).alias(f"c_{e}") for e in extra])
        chain = unary.select("id", "only", *values).join(child, "only")
        chain = chain.select("id", F.col("only").alias("next"), "done", *[(F.col(v) + F.col(f"c_{e}")).alias(v) for v, e in zip(values, extra, strict=True)])
        chain = jumped(chain, values)
        logs.append(chain)

        inner = unary.select(F.col("only").alias("id"))
        tops = unary.select("id", "parent", *extra).join(inner, "id", "left_anti").join(chain.select("id", "next", *[F.col(v).alias(f"s_{v}") for v in values]), "id")
        tops = tops.select(F.col("next").alias("id"), F.col("parent").alias("up"), *[(F.col(e) + F.col(f"s_{v}")).alias(f"n_{e}") for v, e in zip(values, extra, strict=True)])
        rest = state.where("kids IS NULL OR kids <> 1 OR parent IS NULL").join(tops, "id", "left")
        rest = rest.select("id", F.coalesce("up", "parent").alias("parent"), "kids", *values, *[F.coalesce(f"n_{e}", e).alias(e) for e in extra])
        rest = staged(rest, "compressed")

        leaves = rest.where("kids IS NULL")
        done.append(leaves.select("id", *values))
        sums = leaves.where("parent IS NOT NULL").groupBy(F.col("parent").alias("id")).agg(*[F.sum(F.col(v) + F.col(e)).alias(f"g_{v}") for v, e in zip(values, extra, strict=True)])
        left = rest.where("kids IS NOT NULL").join(sums, "id", "left")
        live = staged(left.select("id", "parent", *[(F.col(v) + F.coalesce(f"g_{v}", F.lit(0))).alias(v) for v in values], *extra), "live")

    known = tree.select("id", *values).limit(0)
    for chain, leaves in reversed(list(zip(logs, done, strict=True))):
        known = known.unionByName(leaves)
        sizes = chain.groupBy(F.col("next").alias("id")).agg(F.count("*").alias("n_key"))
        ends = known.join(sizes, "id").select(F.col("id").alias("next"), "n_key", *[F.col(v).alias(f"t_{v}") for v in values])
        grown = lookup(chain, staged(ends, "ends"), "next", F.xxhash64("id"), chain.count())
        known = staged(known.unionByName(grown.select("id", *[(F.col(v) + F.col(f"t_{v}")).alias(v) for v in values])), "known")
    return known


def streamed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """id and SHA-256 of its texts, comma-joined, from sorted rows (id, text)."""
    name, state, found = None, None, []
    for batch in batches:
        for own, text in zip(batch.column("id").to_pylist(), batch.column("text").to_pylist(), strict=True):
            if own == name:
                state.update(b"," + text.encode())
                continue
            if name is not None:
                found.append((name, state.hexdigest()))
            name, state = own, hashlib.sha256(text.encode())
        if found:
            yield pa.record_batch({"id": [x[0] for x in found], "ends": [x[1] for x in found]})
            found = []
    if name is not None:
        yield pa.record_batch({"id": [name], "ends": [state.hexdigest()]})


def end_digests(last: DataFrame) -> DataFrame:
    """id and the digest of the numbers of the conversations (id, conv_id) that end there."""
    numbers = F.transform(F.sort_array(F.collect_list("conv_id")), lambda x: x.cast("string"))
    parts = last.groupBy("id", F.shiftright("conv_id", CHUNK).alias("part")).agg(F.array_join(numbers, ",").alias("text"))
    parts = parts.repartition("id").sortWithinPartitions("id", "part").select("id", "text")
    return mapped(parts, streamed, "id string, ends string")


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256 of each node."""
    convs, rows = rebuilt(conversations)
    longest = rows.agg(F.max("pos")).first()[0]
    rows = staged(named(rows, 0 if longest is None else longest + 1), "named")
    nodes = rows.groupBy("id").agg(
        F.first("parent").alias("parent"), (F.first("pos") + 1).alias("depth"), F.count("*").alias("n_convs"), F.min("conv_id").alias("conv_id"), F.first("words").alias("words")
    )
    root = convs.agg(F.count("*").alias("n_convs"), F.min("conv_id").alias("conv_id")).where("n_convs > 0")
    root = root.select(F.lit(ROOT).alias("id"), F.lit(None).cast("string").alias("parent"), F.lit(0).cast("long").alias("depth"), "n_convs", "conv_id", F.lit(0).cast("long").alias("words"))
    nodes = staged(nodes.unionByName(root), "nodes")
    children = nodes.where("parent IS NOT NULL").groupBy(F.col("parent").alias("id")).agg(F.count("*").alias("n_children"))
    nodes = nodes.join(children, "id", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)))
    nodes = nodes.withColumn("n_leaves", (F.col("n_children") == 0).cast("long")).withColumn("saved_tokens", (F.col("n_convs") - 1) * F.col("words"))
    nodes = staged(nodes, "trie")
    sums = totals(nodes.select("id", "parent", "n_leaves", "saved_tokens"), ["n_leaves", "saved_tokens"])
    last = rows.groupBy("conv_id").agg(F.max_by("id", "pos").alias("id"))
    last = convs.select("conv_id").join(last, "conv_id", "left").select("conv_id", F.coalesce("id", F.lit(ROOT)).alias("id"))
    parents = nodes.where("n_children > 0").select(F.col("id").alias("parent"), F.col("conv_id").alias("parent_conv_id"), F.col("n_children").alias("n_key"))
    out = lookup(nodes.drop("n_leaves", "saved_tokens", "words"), parents, "parent", F.xxhash64("id"), nodes.count())
    out = out.join(sums, "id").join(end_digests(last), "id", "left")
    ends = F.coalesce("ends", F.sha2(F.lit("").cast("binary"), 256)).alias("ends_sha256")
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", ends)


def query(spark, sf_dir: str) -> DataFrame:
    return prefix_trie(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
