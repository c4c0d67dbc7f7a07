"""CSV, JSON lines and parquet readers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import lexicon as lx
from .storage import side_session

CORRUPT = "_corrupt_record"


def read_csv(spark: SparkSession, path: str, schema: T.StructType, *, multi_line: bool = True) -> DataFrame:
    """Header CSV with quoted fields that may hold newlines and doubled quotes.

    Missing markers become NULL.  A multi-line file is one task here; see
    :func:`multiline.read_csv_parallel` for large ones, or pass ``multi_line=False`` where fields
    hold no newlines.
    Columns are matched by header name; the schema's own order is returned.
    """
    raw = (
        spark.read.option("header", True)
        .option("multiLine", multi_line)
        .option("escape", '"')
        .option("enforceSchema", False)
        .schema(schema)
        .csv(path)
    )
    return missing_as_null(raw, schema)


def missing_as_null(rows: DataFrame, schema: T.StructType) -> DataFrame:
    """The columns of ``schema``, with NULL for the markers of a missing text."""
    return rows.select(
        *[
            F.when(~F.col(f.name).isin(lx.CSV_MISSING), F.col(f.name)).alias(f.name)
            if isinstance(f.dataType, T.StringType)
            else F.col(f.name)
            for f in schema.fields
        ]
    )


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """JSON lines; blank lines are skipped, a malformed line fails the read."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def read_jsonl_tolerant(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """JSON lines with the text of a malformed line in ``_corrupt_record``."""
    wide = T.StructType([*schema.fields, T.StructField(CORRUPT, T.StringType())])
    return spark.read.schema(wide).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", CORRUPT).json(path)


def usable_rows(df: DataFrame, required: str) -> tuple[Column, DataFrame]:
    """The skip condition of a tolerant read and the rows that pass it."""
    bad = F.col(CORRUPT).isNotNull() | (F.coalesce(F.col(required), F.lit("")) == "")
    return bad, df.where(~bad).drop(CORRUPT)


def keep_usable(spark: SparkSession, source: str, schema: T.StructType, required: str, path: str) -> dict[str, int]:
    """Write the usable rows of JSON lines as JSON lines; counts of lines come from the same pass."""
    df = read_jsonl_tolerant(side_session(spark), source, schema)
    bad, _ = usable_rows(df, required)
    seen = Observation()
    marked = df.withColumn("__bad", bad).observe(seen, F.count(F.lit(1)).alias("n_lines"), F.count_if("__bad").alias("n_skipped"))
    marked.where(~F.col("__bad")).drop("__bad", CORRUPT).write.json(path)
    return seen.get


def either_shape(df: DataFrame) -> DataFrame:
    """(post, reply, citations) from flat and from wrapped prediction records."""
    wrapped = F.col("rag_output").isNotNull()
    reply = F.when(wrapped, F.col("rag_output.reply")).otherwise(F.col("reply"))
    cited = F.when(wrapped, F.col("rag_output.citations")).otherwise(F.col("citations"))
    empty = F.array().cast(df.schema["citations"].dataType)
    return df.select("post", F.coalesce(reply, F.lit("")).alias("reply"), F.coalesce(cited, empty).alias("citations"))


def salvaged_json(text: Column, schema: T.StructType) -> Column:
    """The JSON object in noisy output: the whole text, else the block from the first brace to the
    last closing brace at a line end.

    NULL if neither is exactly one object.  The text is parsed inside brackets because a
    bare object with trailing words would still parse; the strict check comes first because
    a lenient parse of malformed text gives a struct of NULLs.
    """
    block = F.regexp_extract(text, r"(?smd)(\{.*\}\s*)$", 1)

    def only_object(c: Column) -> Column:
        listed = F.concat(F.lit("["), c, F.lit("]"))
        objects = F.from_json(listed, T.ArrayType(schema))
        return F.when(F.try_parse_json(listed).isNotNull() & (F.size(objects) == 1), F.element_at(objects, 1))

    return F.coalesce(only_object(text), only_object(block))


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")
