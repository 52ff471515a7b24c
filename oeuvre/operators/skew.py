"""Joins and group values that stay balanced when one key holds much of the data.

A group is *heavy* when it has more than ``hot_rows`` rows.  Counting the groups
is a partial aggregate, so finding them never gathers one; and ``n`` rows hold
fewer than ``n / hot_rows`` heavy groups, which is the bound on everything that
is broadcast here.  Where no group is heavy the broadcast is empty and adaptive
execution removes the heavy branch from the running plan.

The split decides only where rows are worked on.  No row is left out.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

HOT_ROWS = 1_000_000


def names(keys: str | Sequence[str]) -> list[str]:
    return [keys] if isinstance(keys, str) else list(keys)


def every(terms: Sequence[Column]) -> Column:
    return reduce(Column.__and__, terms)


def heavy_groups(
    df: DataFrame,
    keys: str | Sequence[str],
    hot_rows: int = HOT_ROWS,
    values: dict[str, Column] | None = None,
) -> DataFrame:
    """The groups of more than ``hot_rows`` rows with the aggregates in ``values``."""
    extra = [agg.alias(name) for name, agg in (values or {}).items()]
    counted = df.groupBy(*names(keys)).agg(F.count("*").alias("_rows"), *extra)
    return counted.filter(F.col("_rows") > hot_rows).drop("_rows")


def over_groups(
    df: DataFrame,
    keys: str | Sequence[str],
    values: dict[str, Column],
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Put aggregates of a row's group on the row; null keys form a group.

    Groups of up to ``hot_rows`` rows use a window.  Rows of heavy groups stay
    where they are and meet the finished aggregate through a broadcast.
    """
    keys = names(keys)
    heavy = heavy_groups(df, keys, hot_rows, values).withColumnsRenamed({k: f"_in_{k}" for k in keys})
    ids = heavy.drop(*values)
    member = every([F.col(k).eqNullSafe(F.col(f"_in_{k}")) for k in keys])
    window = Window.partitionBy(*keys)
    light = df.join(F.broadcast(ids), member, "left_anti")
    light = light.withColumns({name: agg.over(window) for name, agg in values.items()})
    rest = df.join(F.broadcast(heavy), member).drop(*ids.columns)
    return light.unionByName(rest)


def split_join(
    rows: DataFrame,
    lookup: DataFrame,
    on: str | Sequence[str],
    how: str = "inner",
    hot_rows: int = HOT_ROWS,
    count: DataFrame | None = None,
) -> DataFrame:
    """Join many ``rows`` per key with a ``lookup`` that has one or a few.

    Rows of heavy keys are not shuffled: they meet the lookup rows of those keys
    by broadcast, which are at most that few for each heavy key.  The others meet the lookup in an ordinary join.  With
    ``how="left"`` rows with a null key skip the shuffle too, for they match
    nothing.  ``count`` names a cheaper table to count the keys in.
    """
    keys = names(on)
    extra = [c for c in lookup.columns if c not in keys]
    known = every([F.col(k).isNotNull() for k in keys])
    heavy = heavy_groups((count if count is not None else rows).filter(known), keys, hot_rows)
    few = lookup.join(F.broadcast(heavy), keys, "left_semi")
    light = rows.filter(known).join(F.broadcast(heavy), keys, "left_anti").join(lookup, keys, how)
    if how == "inner":
        rest = rows.join(F.broadcast(few), keys)
    else:
        found = heavy.join(F.broadcast(few), keys, "left").withColumn("_heavy", F.lit(True))
        rest = rows.join(F.broadcast(found), keys, "left")
        rest = rest.filter(F.col("_heavy") | ~known).drop("_heavy")
    columns = rows.columns + extra
    return light.select(*columns).unionByName(rest.select(*columns))


def lookup_join(
    rows: DataFrame,
    lookup: DataFrame,
    on: str | Sequence[str],
    hot_rows: int | None = HOT_ROWS,
    count: DataFrame | None = None,
) -> DataFrame:
    """Left join of rows that differ from each other, in a single pass over them.

    Rows of heavy keys take their lookup rows from a broadcast.  Together with
    rows that have a null key they go through the shuffle without a key, by a hash
    of the whole row, which spreads them; the others go by their key.  Keys are
    compared as in any join, so those of different types meet where they are equal.
    That suits tables with an id, and chains of lookups, in which ``split_join``
    would evaluate its input once more for each step.  ``count`` names a cheaper
    table to count the keys in; ``hot_rows=None`` says that no key but null can
    be heavy.
    """
    keys = names(on)
    extra = [c for c in lookup.columns if c not in keys]
    known = every([F.col(k).isNotNull() for k in keys])
    payload = lookup.select(*keys, F.struct(F.lit(True).alias("_hit"), *extra).alias("_light"))
    if hot_rows is None:
        first, done, found = rows, ~known, F.col("_light")
    else:
        heavy = heavy_groups((count if count is not None else rows).filter(known), keys, hot_rows)
        few = payload.join(F.broadcast(heavy), keys, "left_semi").withColumnRenamed("_light", "_heavy")
        first = rows.join(F.broadcast(few), keys, "left")
        done, found = F.col("_heavy").isNotNull() | ~known, F.coalesce("_heavy", "_light")
    unhashable = (T.MapType, T.VariantType)
    hashable = [f.name for f in rows.schema.fields if not isinstance(f.dataType, unhashable)]
    token = F.when(done, F.xxhash64(*hashable)).otherwise(F.lit(0).cast("bigint"))
    first = first.withColumns({"_token": token, **{f"_to_{k}": F.when(~done, F.col(k)) for k in keys}})
    # Zero, but not to the optimizer, which would take a constant out of the join's keys.
    zero = F.xxhash64(*keys).bitwiseAND(F.lit(0))
    second = payload.withColumn("_token", zero).withColumnsRenamed({k: f"_to_{k}" for k in keys})
    joined = first.join(second, ["_token", *[f"_to_{k}" for k in keys]], "left")
    return joined.select(*rows.columns, *[found[c].alias(c) for c in extra])
