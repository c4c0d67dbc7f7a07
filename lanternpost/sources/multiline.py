"""CSV whose quoted fields hold newlines, read in parallel within a file.

A line belongs to a quoted field if an odd number of quotes stands before it in its file.  One cheap
pass adds up the quotes of each file range; prefix sums over the ranges say whether a range begins
inside a record.  The second pass folds lines to records as they stream by.  Only the pieces of
records that cross from one range into the next are shuffled.  Spark's own parser then reads each
record, so types, quotes and missing values are those of :func:`readers.read_csv`.

Lines end with a newline, with or without a carriage return before it.  Quotes inside fields are
doubled.  Files that cannot be split, such as gzip, are one range each.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .readers import missing_as_null
from .storage import stored

QUOTE = '"'
OWN = "file long, block long, seq long, part long, whole boolean, text string"


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, block, line, quotes): each line with the start of the file range it was read in."""
    raw = spark.read.option("lineSep", "\n").text(path)
    return raw.select(
        F.xxhash64("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.col("value").alias("line"),
        (F.length("value") - F.length(F.replace("value", F.lit(QUOTE)))).alias("quotes"),
    )


def _ranges(lines: DataFrame) -> DataFrame:
    """(file, block, inside): whether a quoted field is open where the range begins; one row per range."""
    totals = lines.groupBy("file", "block").agg(F.sum("quotes").alias("n"))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    return totals.select("file", "block", (F.coalesce(F.sum("n").over(before), F.lit(0)) % 2 == 1).alias("inside"))


def _folded(lines: DataFrame) -> DataFrame:
    """Records that begin and end in one range (``whole``), and the pieces of the others.

    ``seq`` numbers the records that begin in a range from 1; 0 are the lines before the first one.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, odd, seq, held = None, False, 0, []

        def row(whole: bool) -> tuple:
            return (*now, seq, 0, whole, "\n".join(held))

        for batch in batches:
            rows = []
            file, block, inside, quotes = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("file", "block", "inside", "quotes"))
            text = batch.column("line").to_pylist()
            for i, (key, count) in enumerate(zip(zip(file.tolist(), block.tolist()), quotes.tolist())):
                if key != now:
                    if held:
                        rows.append(row(False))
                    now, odd, seq, held = key, bool(inside[i]), 0, []
                if not odd and not held:
                    seq += 1
                odd ^= count % 2 == 1
                held.append(text[i])
                if not odd:
                    rows.append(row(seq > 0))
                    held = []
                elif not count and len(held) > 4096:  # a very long field goes on in pieces
                    held = ["\n".join(held)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*rows), KINDS)], names=NAMES)
        if held:
            yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row(False), KINDS)], names=NAMES)

    return lines.mapInArrow(run, OWN)


NAMES = ["file", "block", "seq", "part", "whole", "text"]
KINDS = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.string()]


def csv_records(spark: SparkSession, path: str) -> DataFrame:
    """(file, block, seq, text): one row per CSV record, the header of each file at block 0 and seq 1."""
    lines = _lines(spark, path)
    ranges = stored(_ranges(lines), "csv-ranges")
    # One row of a few bytes per file range; a shuffle would lose the order of the lines.
    folded = stored(_folded(lines.join(F.broadcast(ranges), ["file", "block"])), "csv-records")
    pieces = folded.where("NOT whole")
    # A piece without a record of its own in its range belongs to the last record of the range before that has one.
    opens = folded.groupBy("file", "block").agg(F.max("seq").alias("last")).where("last > 0")
    tails = pieces.where("seq > 0").select("file", "block", "seq", F.col("block").alias("at"), "text")
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    owners = ranges.join(opens, ["file", "block"], "left")
    owner = F.last(F.when(F.col("last").isNotNull(), F.struct(F.col("block").alias("block"), F.col("last").alias("seq"))), ignorenulls=True).over(before)
    owners = owners.select("file", F.col("block").alias("at"), owner.alias("owner"))
    heads = pieces.where("seq = 0").select("file", F.col("block").alias("at"), "text").join(owners, ["file", "at"])
    heads = heads.select("file", "owner.block", "owner.seq", "at", "text")
    joined = tails.unionByName(heads).groupBy("file", "block", "seq").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "text"))), lambda p: p["text"]), "\n").alias("text")
    )
    return folded.where("whole").select("file", "block", "seq", "text").unionByName(joined)


def read_csv_parallel(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The rows of :func:`readers.read_csv` with many tasks per file; columns are matched by header name.

    All files share the header of the first one.
    """
    header = spark.read.option("header", True).option("escape", QUOTE).csv(path).columns
    by_name = {f.name: f for f in schema.fields}
    lost = [n for n in by_name if n not in header]
    if lost:
        raise ValueError(f"the header has no {lost}")
    present = T.StructType([T.StructField(n, by_name[n].dataType if n in by_name else T.StringType()) for n in header])
    records = csv_records(spark, path).where("NOT (block = 0 AND seq = 1)")
    text = F.regexp_replace("text", "\r$", "")
    parsed = records.where(F.length(text) > 0).select(F.from_csv(text, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in present.fields), {"escape": QUOTE, "mode": "FAILFAST"}).alias("r"))
    return missing_as_null(parsed.select(*[F.col("r")[f.name].alias(f.name) for f in schema.fields]), schema)
