"""Positions of rows in a sorted table, without bringing the table or a group into one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from oeuvre.operators.skew import every, names
from oeuvre.sources.staging import staged

# A row's mark is its partition, shifted, plus its place there.
SHIFT = 33


def sort_key(item: str | Column) -> Column:
    """A report's sort key: nulls last; ``-name`` sorts downwards; a column stands for itself."""
    if isinstance(item, Column):
        return item
    return F.col(item[1:]).desc_nulls_last() if item.startswith("-") else F.col(item).asc_nulls_last()


def positions(
    df: DataFrame,
    order: Sequence[str | Column],
    by: str | Sequence[str] = (),
    name: str = "position",
    parts: int | None = None,
) -> DataFrame:
    """The rows with their position, from 0, in the order of the table or of each group ``by``.

    The rows are cut into ranges of (group, order) and sorted within them.  A
    position is the place in the range plus the number of the group's rows in
    earlier ranges, which one count per range and group tells.  So neither a table
    nor a group meets in one task, whatever its size.

    Null keys form a group.  Rows that tie take positions next to each other, in
    the order of a hash of the row, so a run again gives the same; rows that are
    equal in every column can't be told apart.  An empty table gives an empty one.
    The rows are written to the shared folder twice while the plan is built.
    """
    by = names(by)
    parts = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    tie = F.xxhash64(*[F.to_json(F.struct(c)) if "map" in t else F.col(c) for c, t in df.dtypes])
    marked = staged(df.select("*", tie.alias("_tie"), F.monotonically_increasing_id().alias("_row")), "rows")
    keys = [*[F.col(k).asc_nulls_first() for k in by], *[sort_key(k) for k in order], F.col("_tie").asc(), F.col("_row").asc()]
    ranged = marked.repartitionByRange(parts, *keys).sortWithinPartitions(*keys)
    ranged = staged(ranged.withColumn("_mark", F.monotonically_increasing_id()).drop("_tie", "_row"), "ranges")
    ranged = ranged.withColumn("_part", F.shiftright("_mark", SHIFT))
    sizes = ranged.groupBy("_part", *by).agg(F.count("*").alias("_n"), F.min("_mark").alias("_first"))
    earlier = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum("_n").over(earlier), F.lit(0))
    ids = {k: f"_in_{k}" for k in ["_part", *by]}
    starts = sizes.select(*[F.col(k).alias(v) for k, v in ids.items()], (before - F.col("_first")).alias("_shift"))
    here = every([F.col(k).eqNullSafe(F.col(v)) for k, v in ids.items()])
    return ranged.join(starts, here).select(*df.columns, (F.col("_mark") + F.col("_shift")).alias(name))
