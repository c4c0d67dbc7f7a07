"""Line dedup over levelled sorted runs of line hashes.

Documents come in batches of falling ids, cut at a bounded sample of ids.  The keys of a batch are
anti-joined with the runs of the batches before: a key that no run holds is sighted for the first
time, so the largest document id with it is the largest of this batch.  The batch adds one run
sorted by key, with the holder of each first sighting and only a number of documents for each known
key.  When a level holds ``fan_in`` runs they are merged into one of the next level.  What is
dropped is read from the merged levels by key.

Null and empty texts are one empty line.  Repeated rows of one document count as one document.
A null document id counts as one document, smaller than any other.  Rows that share an id but
not a text are dealt with one by one.  An empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import storage
from .helpers import fresh_name

MIN_CHARS = 20
MIN_DOCS = 3
BATCHES = 4
FAN_IN = 2
#: Ids that the cuts between batches are taken from.
SAMPLE = 1000
SPACES = " \t\n\x0b\x0c\r"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
KEY = ["h1", "h2"]


def line_key(line: Column) -> Column:
    """Without white space at both ends, A-Z lower-cased.  ``lower`` is used where it can only touch A-Z."""
    bare = F.btrim(line, F.lit(SPACES))
    return F.when(F.octet_length(bare) == F.char_length(bare), F.lower(bare)).otherwise(F.translate(bare, UPPER, UPPER.lower()))


def split_lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def falling_batch(docs: DataFrame, id_: str, batches: int) -> Column:
    """Batch number of a document: 0 for the largest ids, null ids last.

    The cuts are evenly spaced among at most SAMPLE ids of least hash; they decide how even the
    batches are, not what is found.
    """
    doc = F.col(id_)
    chosen = docs.select(doc.alias("doc")).where(F.col("doc").isNotNull()).distinct().orderBy(F.xxhash64("doc")).limit(SAMPLE)
    ids = [r["doc"] for r in chosen.orderBy(F.desc("doc")).collect()]
    cuts = sorted({len(ids) * i // batches for i in range(1, batches)} - {0})
    below = [F.coalesce((doc < F.lit(ids[c])).cast("int"), F.lit(1)) for c in cuts]
    return sum(below, F.lit(0))


def line_table(docs: DataFrame, id_: str, text: str, batches: int) -> DataFrame:
    """(doc, row, batch, pos, h1, h2) of all lines with a key of at least MIN_CHARS characters."""
    keyed = F.filter(
        F.transform(split_lines(F.col(text)), lambda x, i: F.struct(i.alias("pos"), line_key(x).alias("key"))),
        lambda x: F.char_length(x["key"]) >= MIN_CHARS,
    )
    lines = docs.select(
        F.col(id_).alias("doc"),
        F.xxhash64(F.col(text)).alias("row"),
        falling_batch(docs, id_, batches).alias("batch"),
        F.explode(keyed).alias("line"),
    )
    key = F.col("line.key")
    return lines.select("doc", "row", "batch", F.col("line.pos").alias("pos"), F.xxhash64(key).alias("h1"), F.xxhash64(F.lit(1), key).alias("h2"))


class LineRuns:
    """Runs of line keys in a folder that all executors reach."""

    def __init__(self, spark: SparkSession, folder: str, fan_in: int = FAN_IN) -> None:
        self.spark, self.folder, self.fan_in = spark, folder, fan_in
        self.levels: list[list[str]] = []
        self.written = 0

    def _write(self, run: DataFrame, level: int) -> None:
        path = f"{self.folder}/level{level}-run{self.written}"
        self.written += 1
        run.sortWithinPartitions(*KEY).write.parquet(path)
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(path)
        if len(self.levels[level]) >= self.fan_in:
            paths, self.levels[level] = self.levels[level], []
            self._write(merged(self.spark.read.parquet(*paths)), level + 1)

    def rows(self) -> DataFrame | None:
        paths = [p for level in self.levels for p in level]
        return self.spark.read.parquet(*paths) if paths else None

    def add(self, lines: DataFrame) -> None:
        """Add the run of one batch of lines (doc, h1, h2); batches come with falling ids."""
        counted = lines.select("doc", *KEY).distinct().groupBy(*KEY).agg(F.count(F.lit(1)).alias("n_docs"), F.max("doc").alias("holder"))
        before = self.rows()
        if before is None:
            run = counted.withColumn("first", F.lit(True))
        else:
            known = before.where("first").select(*KEY)
            sighted = counted.join(known, KEY, "left_anti").withColumn("first", F.lit(True))
            again = counted.join(known, KEY, "left_semi")
            nobody = F.lit(None).cast(counted.schema["holder"].dataType)
            run = sighted.unionByName(again.withColumn("holder", nobody).withColumn("first", F.lit(False)))
        self._write(run, 0)

    def totals(self) -> DataFrame | None:
        """One row per key over all runs."""
        rows = self.rows()
        return None if rows is None else merged(rows)

    def decided(self, min_docs: int) -> DataFrame:
        """(h1, h2, holder) of the keys in ``min_docs`` documents; the holder is the first sighting's.

        Stored, so that joins with it have an exchange of their own and a hot key can be split.
        """
        return storage.stored(self.totals().where(F.col("n_docs") >= min_docs).select(*KEY, "holder"), "common-lines")


def merged(runs: DataFrame) -> DataFrame:
    """One row per key: documents are added up; only the row of the first sighting has a holder."""
    holder = F.max(F.when(F.col("first"), F.col("holder")))
    return runs.groupBy(*KEY).agg(F.sum("n_docs").alias("n_docs"), holder.alias("holder"), F.max("first").alias("first"))


def dedup_lines(docs: DataFrame, id_: str, text: str, into: str, *, batches: int = BATCHES, min_docs: int = MIN_DOCS) -> DataFrame:
    """All columns of ``docs`` and a struct ``into``: n_lines, n_dropped and the kept text.

    A key of at least MIN_CHARS characters found in ``min_docs`` documents loses all its lines
    except in the largest document id that holds it.
    """
    spark = docs.sparkSession
    folder = storage.shared_folder(spark, "lines")
    line_table(docs, id_, text, batches).write.partitionBy("batch").parquet(f"{folder}/lines")
    lines = spark.read.schema("doc {}, row long, pos int, h1 long, h2 long, batch int".format(docs.schema[id_].dataType.simpleString())).parquet(f"{folder}/lines")
    runs = LineRuns(spark, f"{folder}/runs")
    for batch in range(batches):
        runs.add(lines.where(F.col("batch") == batch))
    gone = lines.join(runs.decided(min_docs), KEY).where(~F.col("doc").eqNullSafe(F.col("holder")))
    doc, row, gone_at, parts = (fresh_name(docs, c) for c in ("line_doc", "line_row", "line_gone", "line_parts"))
    positions = gone.groupBy(F.col("doc").alias(doc), F.col("row").alias(row)).agg(F.collect_set("pos").alias(gone_at))
    joined = docs.join(positions, F.col(id_).eqNullSafe(F.col(doc)) & (F.xxhash64(F.col(text)) == F.col(row)), "left")
    drop, all_lines = F.col(gone_at), F.col(parts)
    kept = F.array_except(F.sequence(F.lit(0), F.size(all_lines) - 1), drop)
    rest = F.array_join(F.transform(kept, lambda i: F.get(all_lines, i)), "\n")
    return joined.withColumn(parts, split_lines(F.col(text))).select(
        *docs.columns,
        F.struct(
            F.size(all_lines).cast("long").alias("n_lines"),
            F.coalesce(F.size(drop), F.lit(0)).cast("long").alias("n_dropped"),
            F.when(drop.isNull(), F.coalesce(F.col(text), F.lit(""))).otherwise(rest).alias("text"),
        ).alias(into),
    )
