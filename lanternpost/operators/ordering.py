"""Global order without a single-task window.

A window without partition keys, or with a few hot ones, sends everything to one
task.  Here rows are first cut into value ranges, each range is ordered on its own,
and a small table of range totals supplies the offsets.  Range limits come from a
sample chosen by hash, so they are the same on every evaluation and a lost executor
cannot shift them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SAMPLES_PER_RANGE = 32


def range_count(df: DataFrame) -> int:
    """Number of ranges: two per shuffle partition of the session."""
    return 2 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def range_limits(df: DataFrame, key: str, ranges: int) -> DataFrame:
    """One row, one array: upper limits of all ranges but the last, from a hash-chosen sample.

    The sample has a fixed size; ``limit`` over an order is a bounded heap per task.
    """
    sample = df.select(key).where(F.col(key).isNotNull()).orderBy(F.xxhash64(key), key).limit(ranges * SAMPLES_PER_RANGE)
    keys = sample.agg(F.array_sort(F.collect_list(key)).alias("keys"))
    step = F.greatest((F.size("keys") / ranges).cast("int"), F.lit(1))
    picks = F.filter(F.sequence(step, F.size("keys"), step), lambda i: i < F.size("keys"))
    cut = F.array_distinct(F.transform(picks, lambda i: F.element_at("keys", i)))
    return keys.select(F.when(F.size("keys") > 1, cut).alias("limits"))


def with_range(df: DataFrame, key: str, name: str, ranges: int | None = None) -> DataFrame:
    """Add the number of the value range ``key`` falls in; equal keys share a range.

    The limits are searched by halving steps: the count of limits below the key grows
    by the largest power of two that still fits.
    """
    ranges = ranges or range_count(df)
    limits = F.col("__limits")
    steps = F.array(*[F.lit(1 << b) for b in reversed(range(ranges.bit_length()))])

    def further(below: Column, step: Column) -> Column:
        fits = F.try_element_at(limits, below + step) < F.col(key)
        return F.when(fits, below + step).otherwise(below)

    below = F.aggregate(steps, F.lit(0), further)
    return (
        df.withColumn("__limits", range_limits(df, key, ranges).scalar())
        .withColumn(name, F.coalesce(F.when(limits.isNotNull(), below), F.lit(0)))
        .drop("__limits")
    )


def with_row_number(df: DataFrame, key: str, name: str, within: list[str] | None = None, start: int = 1) -> DataFrame:
    """Consecutive numbers in ``key`` order, over the table or within each group.

    ``key`` must be unique inside a group; groups may be of any size.
    """
    within = within or []
    ranged = with_range(df, key, "__range")
    totals = ranged.groupBy(*within, "__range").agg(F.count(F.lit(1)).alias("__n"))
    earlier = Window.partitionBy(*within).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*within, "__range", F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__offset"))
    local = F.row_number().over(Window.partitionBy(*within, "__range").orderBy(key))
    return (
        ranged.withColumn("__local", local)
        .join(offsets, [*within, "__range"])
        .withColumn(name, F.col("__offset") + F.col("__local") + F.lit(start - 1))
        .drop("__range", "__local", "__offset")
    )


def with_running_sums(
    df: DataFrame, key: str, sums: dict[str, str], within: list[str], descending: bool = False
) -> DataFrame:
    """Running sums in ``key`` order within each group, for rows already unique per (group, key).

    ``sums`` maps a new column to the column it accumulates (the row itself included).
    """
    ranged = with_range(df, key, "__range")
    totals = ranged.groupBy(*within, "__range").agg(*[F.sum(v).alias(f"__t_{k}") for k, v in sums.items()])
    span, order = F.col("__range"), F.col(key)
    if descending:
        span, order = span.desc(), order.desc()
    earlier = Window.partitionBy(*within).orderBy(span).rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        *within, "__range", *[F.coalesce(F.sum(f"__t_{k}").over(earlier), F.lit(0)).alias(f"__o_{k}") for k in sums]
    )
    upto = Window.partitionBy(*within, "__range").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    local = ranged.select("*", *[F.sum(v).over(upto).alias(f"__l_{k}") for k, v in sums.items()])
    out = local.join(offsets, [*within, "__range"])
    kept = [F.col(c) for c in df.columns]
    return out.select(*kept, *[(F.col(f"__o_{k}") + F.col(f"__l_{k}")).alias(k) for k in sums])


def per_group(df: DataFrame, group: str, score: Column, tie: str, keep: int, name: str = "rank") -> DataFrame:
    """The ``keep`` best rows of each group, numbered; Spark prunes on both sides of the shuffle."""
    w = Window.partitionBy(group).orderBy(score, F.col(tie).asc())
    return df.withColumn(name, F.row_number().over(w)).where(F.col(name) <= keep)
