"""Relational helpers: joins with stated null rules, coverage selections, ordering."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from oeuvre.operators.skew import every, names


REPEATED = "_more_than_one"


def once_by(df: DataFrame, keys: str | Sequence[str]) -> DataFrame:
    """One row of ``df`` for each key, and whether there are more in ``REPEATED``."""
    keys = names(keys)
    rest = [c for c in df.columns if c not in keys]
    one = df.groupBy(*keys).agg(F.count("*").alias("_n"), F.first(F.struct(F.lit(1), *rest)).alias("_row"))
    return one.select(*keys, *[F.col("_row")[c].alias(c) for c in rest], (F.col("_n") > 1).alias(REPEATED))


def checked(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The rows of a join with ``once_by``, failing at run time on a repeated key.

    The check is a filter above the join, so it also runs where later steps use
    no column of the right side.
    """
    error = F.raise_error(F.lit(f"more than one row for a key of {', '.join(keys)}")).cast("boolean")
    return df.filter(F.when(F.col(REPEATED), error).otherwise(F.lit(True))).drop(REPEATED)


def unique_by(df: DataFrame, keys: str | Sequence[str]) -> DataFrame:
    """``df``, failing at run time if a key has more than one row."""
    return checked(once_by(df, keys), names(keys))


def left_join(
    df: DataFrame,
    other: DataFrame,
    on: str | Sequence[str] | dict[str, str],
    null_keys: str = "drop",
    unique: bool = False,
) -> DataFrame:
    """Left join on named keys; ``on`` maps left to right names where they differ.

    ``null_keys="match"`` lets a null key meet a null key, as joins of in-memory
    tables in R do; ``"drop"`` is SQL equality.  The right key columns are not
    returned.  Several matches give several rows unless ``unique`` asks to fail.
    """
    if null_keys not in ("drop", "match"):
        raise ValueError(f"null_keys must be 'drop' or 'match', not {null_keys!r}")
    pairs = on if isinstance(on, dict) else {k: k for k in names(on)}
    if unique:
        other = once_by(other, list(pairs.values()))
    clash = set(df.columns) & set(other.columns) - set(pairs.values())
    if clash:
        raise ValueError(f"columns on both sides that are not keys: {sorted(clash)}")
    marked = other.withColumnsRenamed({r: f"_key_{i}" for i, r in enumerate(pairs.values())})
    sides = [(F.col(left), F.col(f"_key_{i}")) for i, left in enumerate(pairs)]
    terms = [a.eqNullSafe(b) if null_keys == "match" else a == b for a, b in sides]
    joined = df.join(marked, every(terms), "left")
    if unique:
        joined = checked(joined, list(pairs.values()))
    return joined.drop(*[f"_key_{i}" for i in range(len(pairs))])


def backfill(df: DataFrame, other: DataFrame, on: str, column: str) -> DataFrame:
    """Fill nulls of ``column`` from a second source, which must have one row for each id."""
    spare = other.filter(F.col(on).isNotNull()).select(on, F.col(column).alias("_spare"))
    filled = left_join(df, spare, on, unique=True).withColumn(column, F.coalesce(column, "_spare"))
    return filled.select(*df.columns)


def not_in(column: str, values: Sequence) -> Column:
    """True for values outside the list, and for null."""
    return ~F.coalesce(F.col(column).isin(*values), F.lit(False))


def complete(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Rows without null (or NaN) in the given columns, or in any."""
    return df.na.drop("any", subset=list(columns) if columns else None)


def in_order(df: DataFrame, order: Sequence[str]) -> DataFrame:
    """The columns of ``order`` that exist, in that order."""
    return df.select(*[c for c in order if c in df.columns])


def sorted_report(df: DataFrame, *order: str | Column) -> DataFrame:
    """A finished table in report order, with nulls last; ``-name`` sorts downwards."""
    def key(item):
        if isinstance(item, Column):
            return item
        return F.col(item[1:]).desc_nulls_last() if item.startswith("-") else F.col(item).asc_nulls_last()
    return df.orderBy(*[key(item) for item in order])


def uncovered(ids: DataFrame, source: DataFrame, on: str, column: str) -> DataFrame:
    """Rows of ``ids`` whose ``column`` is null in the source or that it lacks."""
    return left_join(ids, source, on).filter(F.col(column).isNull())
