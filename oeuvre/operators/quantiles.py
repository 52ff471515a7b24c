"""Exact quantiles of any group size, quantile bins and box-plot statistics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from oeuvre.functions.columns import clean
from oeuvre.operators.skew import HOT_ROWS, every, names

# Names of the bins.
QUINTILES = ("p[0,20]", "p(20,40]", "p(40,60]", "p(60,80]", "p(80,100]")
QUARTILES = ("p[0,25]", "p(25,50]", "p(50,75]", "p(75,100]")

# Profile points of the score table.
PROFILE = (0.1, 0.25, 0.5, 0.75, 0.9)

ACCURACY = 100_000


def exact_quantiles(
    df: DataFrame,
    value: str,
    by: str | Sequence[str],
    probs: Sequence[float],
    name: str = "quantiles",
    hot_rows: int = HOT_ROWS,
    accuracy: int = ACCURACY,
) -> DataFrame:
    """Interpolated quantiles of each group, ignoring null and NaN, as an array.

    Equal values are counted together first.  A group of up to ``hot_rows``
    distinct values is one ``percentile`` aggregate.  A larger one is cut by an
    approximate quantile a little below and above each wanted point; counting
    the pieces tells which piece holds a wanted rank, and only those pieces are
    sorted, each of about ``4 / accuracy`` of the group.  The cuts steer the work
    and do not enter the result.
    """
    by = names(by)
    if not by:
        whole = exact_quantiles(df.withColumn("_whole", F.lit(1)), value, "_whole", probs, name, hot_rows, accuracy)
        return whole.drop("_whole")
    data = df.select(*by, clean(value).alias("_v")).filter(F.col("_v").isNotNull())
    counted = data.groupBy(*by, "_v").agg(F.count("*").alias("_copies"))
    sizes = counted.groupBy(*by).agg(F.count("*").alias("_distinct"), F.sum("_copies").alias("_n"))
    heavy = sizes.filter(F.col("_distinct") > hot_rows).drop("_distinct")
    heavy = heavy.withColumnsRenamed({k: f"_in_{k}" for k in by})
    ids = [f"_in_{k}" for k in by]
    member = every([F.col(k).eqNullSafe(F.col(f"_in_{k}")) for k in by])
    points = F.array(*[F.lit(float(p)) for p in probs])
    light = counted.join(F.broadcast(heavy.drop("_n")), member, "left_anti")
    light = light.groupBy(*by).agg(F.percentile("_v", points, F.col("_copies")).alias(name))

    step = 2.0 / accuracy
    around = sorted({min(max(p + d, 0.0), 1.0) for p in probs for d in (-step, step)})
    cuts = data.join(F.broadcast(heavy), member).groupBy(*ids, "_n").agg(
        F.percentile_approx("_v", around, accuracy).alias("_cuts")
    )
    pieces = counted.join(F.broadcast(cuts), member).withColumn(
        "_piece", F.size(F.filter("_cuts", lambda c: c < F.col("_v")))
    )
    before = F.sum("_copies").over(Window.partitionBy(*ids).orderBy("_piece")) - F.col("_copies")
    ranks = F.array_distinct(F.flatten(F.array(*[
        F.array(F.floor((F.col("_n") - 1) * p), F.ceil((F.col("_n") - 1) * p)) for p in probs
    ])))
    wanted = pieces.groupBy(*ids, "_n", "_piece").agg(F.sum("_copies").alias("_copies"))
    wanted = wanted.withColumn("_before", before).withColumn("_ranks", ranks)
    inside = F.filter("_ranks", lambda r: (r >= F.col("_before")) & (r < F.col("_before") + F.col("_copies")))
    wanted = wanted.select(*ids, "_n", "_piece", "_before", inside.alias("_ranks")).filter(F.size("_ranks") > 0)
    wanted = wanted.withColumnsRenamed({c: f"_at{c}" for c in [*ids, "_piece"]})
    here = every([F.col(c).eqNullSafe(F.col(f"_at{c}")) for c in [*ids, "_piece"]])
    chosen = pieces.drop("_n", "_cuts", *by).join(F.broadcast(wanted), here)
    end = F.col("_before") + F.sum("_copies").over(Window.partitionBy(*ids, "_piece").orderBy("_v"))
    found = chosen.withColumn("_end", end).withColumn("_start", F.col("_end") - F.col("_copies"))
    found = found.withColumn("_rank", F.explode("_ranks")).filter(
        (F.col("_rank") >= F.col("_start")) & (F.col("_rank") < F.col("_end"))
    )
    at = F.map_from_entries(F.collect_list(F.struct("_rank", "_v")))
    found = found.groupBy(*ids, "_n").agg(at.alias("_at"))

    def interpolated(p):
        place = (F.col("_n") - 1) * F.lit(float(p))
        low, high = F.floor(place), F.ceil(place)
        between = (high - place) * F.col("_at")[low] + (place - low) * F.col("_at")[high]
        return F.when(low == high, F.col("_at")[low]).otherwise(between)

    rest = found.select(
        *[F.col(f"_in_{k}").alias(k) for k in by], F.array(*[interpolated(p) for p in probs]).alias(name)
    )
    return light.unionByName(rest)


def attach_groups(
    df: DataFrame, groups: DataFrame, by: str | Sequence[str], hot_rows: int = HOT_ROWS
) -> DataFrame:
    """Put one row of group values on each row of the group; null keys meet."""
    by = names(by)
    heavy = df.groupBy(*by).agg(F.count("*").alias("_rows")).filter(F.col("_rows") > hot_rows).drop("_rows")
    heavy = heavy.withColumnsRenamed({k: f"_hot_{k}" for k in by})
    groups = groups.withColumnsRenamed({k: f"_in_{k}" for k in by})
    member = every([F.col(k).eqNullSafe(F.col(f"_in_{k}")) for k in by])
    hot = every([F.col(k).eqNullSafe(F.col(f"_hot_{k}")) for k in by])
    hot_group = every([F.col(f"_in_{k}").eqNullSafe(F.col(f"_hot_{k}")) for k in by])
    light = df.join(F.broadcast(heavy), hot, "left_anti").join(groups, member, "left")
    few = groups.join(F.broadcast(heavy), hot_group, "left_semi")
    rest = df.join(F.broadcast(heavy), hot, "left_semi").join(F.broadcast(few), member, "left")
    ids = [f"_in_{k}" for k in by]
    return light.drop(*ids).unionByName(rest.drop(*ids))


def bin_label(value: Column, breaks: Column, labels: Sequence[str], strict: bool = False) -> Column:
    """The lowest bin that a value fits, given the breaks between them as an array."""
    label = None
    for i, text in enumerate(labels):
        fits = value <= breaks[i + 1]
        label = F.when(fits, text) if label is None else label.when(fits, text)
    if strict:
        tied = F.size(F.array_distinct(breaks)) < F.size(breaks)
        label = F.when(tied, F.raise_error(F.lit("quantile breaks are not unique"))).otherwise(label)
    return label


def counted_breaks(cells: DataFrame, value: str, copies: str, by: str, bins: int, name: str = "_breaks") -> DataFrame:
    """Breaks of equal bins in each group, from its distinct values and how often each occurs."""
    points = F.array(*[F.lit(i / bins) for i in range(bins + 1)])
    known = cells.select(by, clean(value).alias("_v"), copies).filter(F.col("_v").isNotNull())
    counted = known.groupBy(by, "_v").agg(F.sum(copies).alias("_copies"))
    return counted.groupBy(by).agg(F.percentile("_v", points, F.col("_copies")).alias(name))


def quantile_bins(
    df: DataFrame,
    columns: str | Sequence[str],
    by: str | Sequence[str],
    labels: Sequence[str] = QUINTILES,
    strict: bool = False,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Replace columns by the label of their quantile bin within the group.

    The bins split the range into ``len(labels)`` equal parts of probability.
    They are closed on the right, and the first one on the left too.  A value on
    tied breaks takes the lowest bin it fits; ``strict`` fails on ties instead.
    ``df`` is read several times.
    """
    probs = [i / len(labels) for i in range(len(labels) + 1)]
    columns = names(columns)
    entries = F.explode(F.array(*[F.struct(F.lit(c).alias("name"), clean(c).alias("value")) for c in columns]))
    long = df.select(*names(by), entries.alias("_e")).select(*names(by), "_e.name", "_e.value")
    breaks = exact_quantiles(long, "value", [*names(by), "name"], probs, "_b", hot_rows)
    wide = breaks.groupBy(*names(by)).agg(
        *[F.first(F.when(F.col("name") == c, F.col("_b")), ignorenulls=True).alias(f"_breaks_{c}") for c in columns]
    )
    df = attach_groups(df, wide, by, hot_rows)
    for c in columns:
        label = bin_label(clean(c), F.col(f"_breaks_{c}"), labels, strict)
        df = df.withColumn(c, label).drop(f"_breaks_{c}")
    return df


def box_stats_log10(
    df: DataFrame, value: str, by: str | Sequence[str], hot_rows: int = HOT_ROWS
) -> DataFrame:
    """Box-plot statistics of log10 values by group.

    ``n`` values enter; ``removed`` are null or not positive.  The whiskers are
    the most extreme values within 1.5 times the quartile distance of the box,
    and ``outliers`` lie beyond.
    """
    by = names(by)
    df = df.select(*by, F.log10(F.when(clean(value) > 0, clean(value))).alias("_log"))
    boxes = exact_quantiles(df, "_log", by, [0.25, 0.5, 0.75], "_box", hot_rows)
    df = df.groupBy(*by, "_log").agg(F.count("*").alias("_copies"))
    q1, q3 = F.col("_box")[0], F.col("_box")[2]
    reach = 1.5 * (q3 - q1)
    fits = F.col("_log").between(q1 - reach, q3 + reach)
    placed = attach_groups(df, boxes, by, hot_rows)
    return placed.groupBy(*by).agg(
        F.sum(F.when(F.col("_log").isNotNull(), F.col("_copies")).otherwise(0)).alias("n"),
        F.sum(F.when(F.col("_log").isNull(), F.col("_copies")).otherwise(0)).alias("removed"),
        F.max(F.col("_box")[0]).alias("q1"),
        F.max(F.col("_box")[1]).alias("median"),
        F.max(F.col("_box")[2]).alias("q3"),
        F.min(F.when(fits, F.col("_log"))).alias("lower"),
        F.max(F.when(fits, F.col("_log"))).alias("upper"),
        F.sum(F.when(~fits, F.col("_copies")).otherwise(0)).alias("outliers"),
    )


def score_profile(
    scores: DataFrame, value: str = "score", probs: Sequence[float] = PROFILE, accuracy: int = 100
) -> DataFrame:
    """Approximate quantiles of a whole table, one row per probability."""
    found = scores.agg(F.percentile_approx(value, list(probs), accuracy).alias("perc"))
    pairs = F.arrays_zip(F.array(*[F.lit(float(p)) for p in probs]).alias("prob"), F.col("perc"))
    return found.select(F.inline(pairs))
