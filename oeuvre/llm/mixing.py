"""Mixing sources to target weights by Efraimidis-Spirakis sampling, in DataFrame operations only.

A document's key is -ln(u) / weight with u in (0, 1) from a hash of its id, so small keys go to documents of high
quality more often. Of a source's target, whole epochs are taken first: every document once or twice. For the rest the
documents of the source are sorted by key and taken up to the budget, the last one in part (its first words).

No source is sorted whole. Keys fall into `CELLS` cells, and those of the one cell that the budget ends in into as many
again. Sizes are summed by cell, and only the documents of the last cell, a sixteen millionth of the key's range, are
sorted. So a source may hold any part of the rows.

Null texts have size 0 and are never taken. A null source is a source. A null doc_id counts as the empty text in the key. Rows
with equal keys are taken in the order of doc_id and size; rows that repeat get results in any order, but of equal sum. Two runs
agree. Sources without words have target 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from oeuvre.llm.shared import staged

# Weights of the sources in order, repeating; part of all words that is mixed; most times of a source.
WEIGHTS = [3, 1, 2]
PART = 1.5
TIMES = 2

#: Weight of a document by its quality label; others weigh 1.
QUALITY = {1: 2.0, 0: 0.5}
SEED = "mix"
CELLS = 4096

WORD = r"[^\x20\x09-\x0D]+"


def size_of(text: Column) -> Column:
    """The number of words."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def place(doc_id: Column, weight: Column) -> Column:
    """1 - u ** (1 / weight): in [0, 1), in the order of the exponential key."""
    digits = F.substring(F.md5(F.concat(F.lit(f"{SEED}:"), F.coalesce(doc_id.cast("string"), F.lit("")))), 1, 13)
    u = (F.conv(digits, 16, 10).cast("double") + 0.5) / F.lit(float(1 << 52))
    return 1 - F.when(weight == 1, u).otherwise(F.pow(u, 1 / weight))


def targets(sizes: DataFrame, weights=WEIGHTS, part: float = PART, times: int = TIMES) -> DataFrame:
    """source, source_size, target from a row a source (source, source_size).

    A share above its cap frees words for the others, by weight. With sources in the order of cap / weight, one is capped
    if its cap is no more than its share of what those before it leave.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    turn = F.array(*[F.lit(float(x)) for x in weights])
    rows = sizes.withColumn("w", turn[(F.row_number().over(order) - 1) % len(weights)]).withColumn("cap", F.col("source_size") * float(times))
    before = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    gone = lambda c: F.coalesce(F.sum(c).over(before), F.lit(0.0))
    rows = rows.withColumn("all", F.sum("source_size").over(every) * float(part)).withColumn("all_w", F.sum("w").over(every))
    share = (F.col("all") - gone("cap")) / (F.col("all_w") - gone("w"))
    rows = rows.withColumn("capped", F.col("cap") / F.col("w") <= share)
    left = F.col("all") - F.sum(F.when(F.col("capped"), F.col("cap")).otherwise(0.0)).over(every)
    left_w = F.col("all_w") - F.sum(F.when(F.col("capped"), F.col("w")).otherwise(0.0)).over(every)
    return rows.select("source", "source_size", F.when(F.col("capped"), F.col("cap")).otherwise(left / left_w * F.col("w")).alias("target"))


def ends(sums: DataFrame, by: list[str], cell: str) -> DataFrame:
    """The first cell of each source whose running sum exceeds its budget, and the sum before it."""
    order = Window.partitionBy(*by).orderBy(cell)
    rows = sums.withColumn("upto", F.sum("n").over(order)).where(F.col("upto") > F.col("budget"))
    first = F.min(F.struct(cell, (F.col("upto") - F.col("n")).alias("before"))).alias("x")
    return rows.groupBy(*by).agg(first).select(*by, f"x.{cell}", "x.before")


def mix(documents: DataFrame, labels: DataFrame | None = None, weights=WEIGHTS, part: float = PART, times: int = TIMES) -> DataFrame:
    """doc_id, size, source_size, target, taken, source of every document."""
    docs = documents.select("doc_id", F.col("source").alias("source"), size_of(F.col("text")).alias("size"))
    weight = F.lit(1.0)
    if labels is not None:
        marks = staged(labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id").agg(F.max("quality").alias("quality")), "marks")
        docs = docs.join(marks, "doc_id", "left")
        for value, own in QUALITY.items():
            weight = F.when(F.col("quality") == value, F.lit(own)).otherwise(weight)
    docs = docs.withColumn("p", place(F.col("doc_id"), weight))
    fine = F.col("p") * CELLS
    docs = docs.withColumn("c1", F.floor(fine)).withColumn("c2", F.floor((fine - F.floor(fine)) * CELLS))
    docs = staged(docs.select("doc_id", "source", "size", "p", "c1", "c2"), "sizes")

    sources = staged(targets(docs.groupBy("source").agg(F.sum("size").alias("source_size")), weights, part, times), "targets")
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    sources = sources.withColumn("epochs", epochs).withColumn("budget", F.floor(F.col("target")) - F.col("epochs") * F.col("source_size"))
    sources = sources.withColumn("rank", F.xxhash64("source", F.col("source").isNull()))
    docs = docs.withColumn("rank", F.xxhash64("source", F.col("source").isNull()))
    budget = sources.select("rank", "budget").where("budget > 0")

    cells = docs.groupBy("rank", "c1").agg(F.sum("size").alias("n")).join(budget, "rank")
    coarse = staged(ends(cells, ["rank"], "c1"), "coarse")
    inner = docs.groupBy("rank", "c1", "c2").agg(F.sum("size").alias("n")).join(coarse, ["rank", "c1"]).join(budget, "rank")
    inner = inner.withColumn("budget", F.col("budget") - F.col("before")).drop("before")
    inner = ends(inner, ["rank"], "c2").withColumnRenamed("before", "more")
    last = coarse.join(inner, "rank").select("rank", F.col("c1").alias("e1"), F.col("c2").alias("e2"), (F.col("before") + F.col("more")).alias("gone"))
    plan = staged(sources.drop("source").join(last, "rank", "left"), "plan")

    rows = docs.join(plan, "rank")
    in_last = F.coalesce((F.col("c1") == F.col("e1")) & (F.col("c2") == F.col("e2")), F.lit(False))
    order = Window.partitionBy("rank").orderBy("p", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    room = F.col("budget") - F.col("gone") - F.coalesce(F.sum("size").over(order), F.lit(0))
    some = rows.where(in_last).withColumn("rest", F.greatest(F.lit(0), F.least("size", room)))
    whole = F.coalesce((F.col("c1") < F.col("e1")) | ((F.col("c1") == F.col("e1")) & (F.col("c2") < F.col("e2"))), F.lit(False))
    others = rows.where(~in_last).withColumn("rest", F.when(whole, F.col("size")).otherwise(0))
    taken = (F.col("epochs") * F.col("size") + F.col("rest")).cast("long").alias("taken")
    return others.unionByName(some).select("doc_id", "size", "source_size", "target", taken, "source")


def query(spark, sf_dir: str) -> DataFrame:
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return mix(documents, spark.read.parquet(f"{sf_dir}/labels.parquet"))
