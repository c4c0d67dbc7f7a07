"""Reproducible splits and samples ordered by a hash of the row id.

A split needs the id hash at a given rank, not the rank of every row: a histogram of
hash prefixes finds the range that holds the cut, only that range is ordered, and
the cut value is then compared with each row.  The rows themselves are not shuffled.
"""

from __future__ import annotations

import math

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.storage import stored
from .ordering import with_row_number

PREFIX = 4


def id_hash(id_col: str, seed: int) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), F.col(id_col).cast("string")))


def _kept(size: str, share: float, name: str, counts: DataFrame) -> DataFrame:
    """Rows of each stratum that stay when ``share`` is held out, by largest remainder.

    Totals are scalars and the places of the remainders are numbered by ranges, so strata may be many.
    """
    counts = stored(counts, "strata")
    total = counts.agg(F.coalesce(F.sum(size), F.lit(0)).alias("n")).first()["n"]
    drawn = total - math.ceil(share * total)
    exact = F.col(size) / F.lit(max(total, 1)) * F.lit(drawn)
    parts = counts.withColumn("__floor", F.floor(exact)).withColumn("__order", F.struct((F.col("__floor") - exact).alias("rest"), "__stratum"))
    spare = drawn - (parts.agg(F.sum("__floor").alias("n")).first()["n"] or 0)
    placed = with_row_number(parts, "__order", "__place")
    return placed.withColumn(name, F.col("__floor") + (F.col("__place") <= spare).cast("int")).drop("__floor", "__order", "__place")


def _split(
    df: DataFrame, id_col: str, stratum: str | None, seed: int, name: str, cut_ranks: Callable[[DataFrame], DataFrame]
) -> DataFrame:
    """train/val/test along the id hash; ``cut_ranks`` adds the last ranks of train and val per stratum."""
    keyed = df.withColumn("__stratum", F.coalesce(F.col(stratum).cast("string"), F.lit("")) if stratum else F.lit("")).withColumn("__hash", id_hash(id_col, seed))
    keys = keyed.select("__stratum", "__hash", F.substring("__hash", 1, PREFIX).alias("__prefix"))
    histogram = stored(keys.groupBy("__stratum", "__prefix").agg(F.count(F.lit(1)).alias("__n")), "hash-histogram")
    sizes = histogram.groupBy("__stratum").agg(F.sum("__n").alias("__size"))
    cuts = cut_ranks(sizes).select("__stratum", F.posexplode(F.array("__train", "__val")).alias("__cut", "__rank"))

    earlier = Window.partitionBy("__stratum").orderBy("__prefix").rowsBetween(Window.unboundedPreceding, -1)
    placed = histogram.withColumn("__before", F.coalesce(F.sum("__n").over(earlier), F.lit(0)))
    inside_range = (F.col("__before") < F.col("__rank")) & (F.col("__rank") <= F.col("__before") + F.col("__n"))
    # At most two rows per stratum: the hash range each cut falls in, and its rank there.
    holding = stored(
        placed.join(cuts, "__stratum")
        .where(inside_range)
        .select("__stratum", "__prefix", "__cut", (F.col("__rank") - F.col("__before")).alias("__rank")),
        "hash-cuts",
    )
    ranges = holding.groupBy("__stratum", "__prefix").agg(
        F.max(F.when(F.col("__cut") == 0, F.col("__rank"))).alias("__r0"),
        F.max(F.when(F.col("__cut") == 1, F.col("__rank"))).alias("__r1"),
    )
    inside = keys.join(stored(ranges, "hash-ranges"), ["__stratum", "__prefix"])
    place = F.row_number().over(Window.partitionBy("__stratum", "__prefix").orderBy("__hash"))
    limits = (
        inside.withColumn("__place", place)
        .groupBy("__stratum")
        .agg(
            F.max(F.when(F.col("__place") == F.col("__r0"), F.col("__hash"))).alias("__h0"),
            F.max(F.when(F.col("__place") == F.col("__r1"), F.col("__hash"))).alias("__h1"),
        )
    )
    part = F.when(F.col("__hash") <= F.col("__h0"), "train").when(F.col("__hash") <= F.col("__h1"), "val").otherwise("test")
    cut_hashes = stored(limits, "hash-limits")
    return keyed.join(cut_hashes, "__stratum", "left").withColumn(name, part).select(*df.columns, name)


def three_way_split(
    df: DataFrame, id_col: str, *, stratum: str | None = None, seed: int = 42,
    held_out: float = 0.30, test_of_held_out: float = 0.50, name: str = "split",
) -> DataFrame:
    """Hold out a share, then split the held-out rows again; sizes are exact per stratum."""

    def ranks(sizes: DataFrame) -> DataFrame:
        first = _kept("__size", held_out, "__train", sizes).withColumn("__left", F.col("__size") - F.col("__train"))
        second = _kept("__left", test_of_held_out, "__more", first)
        return second.withColumn("__val", F.col("__train") + F.col("__more"))

    return _split(df, id_col, stratum, seed, name, ranks)


def two_step_split(
    df: DataFrame, id_col: str, *, stratum: str | None = None, seed: int = 42,
    test_size: float = 0.15, val_of_rest: float = 0.1765, name: str = "split",
) -> DataFrame:
    """Hold out test rows first, then validation rows out of the rest."""

    def ranks(sizes: DataFrame) -> DataFrame:
        rest = _kept("__size", test_size, "__val", sizes)
        return _kept("__val", val_of_rest, "__train", rest)

    return _split(df, id_col, stratum, seed, name, ranks)


def sample_rows(df: DataFrame, id_col: str, n: int, seed: int = 42) -> DataFrame:
    """``min(n, rows)`` rows, the same ones on every run."""
    return df.orderBy(id_hash(id_col, seed), id_col).limit(n)
