"""CSV records that cross file ranges, against the whole-file reader; the entry without optional libraries."""

import subprocess
import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lanternpost.operators import splits
from lanternpost.sources import multiline, readers, sinks

SCHEMA = T.StructType([T.StructField("Text", T.StringType()), T.StructField("k", T.LongType())])


@pytest.fixture
def small_ranges(spark):
    keep = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "300")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    yield
    for k, v in keep.items():
        spark.conf.set(k, v)


def rows(df):
    return sorted(((r["Text"] or "", r["k"]) for r in df.collect()), key=repr)


@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_one_file_in_many_tasks(spark, tmp_path, small_ranges, end):
    texts = ["plain", "two\nlines", 'a "quoted" word', 'ends with quote"', "\n\nblank lines\n", "comma, inside", "", "x" * 900, "many\n" * 200, '"', '""', "last, \"one\"\nof, all"]
    made = [(t + str(i) if t else t, i) for i, t in enumerate(texts * 12)]
    body = ["Text,k"] + ['"' + t.replace('"', '""') + f'",{k}' for t, k in made]
    (tmp_path / "a.csv").write_bytes((end.join(body) + end).encode())
    records = multiline.csv_records(spark, str(tmp_path / "a.csv"))
    assert records.select("block").distinct().count() > 20
    assert records.count() == len(body)
    got = rows(multiline.read_csv_parallel(spark, str(tmp_path / "a.csv"), SCHEMA))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "128m")
    assert got == rows(readers.read_csv(spark, str(tmp_path / "a.csv"), SCHEMA))
    assert len(got) == len(made)


def test_several_files_and_other_columns(spark, tmp_path, small_ranges):
    df = spark.range(300).select(F.lit("n").alias("other"), F.concat(F.lit('a "b"\n'), F.col("id").cast("string"), F.lit(",\n")).alias("Text"), F.col("id").alias("k"))
    sinks.write_csv(df.repartition(4), str(tmp_path / "out"))
    got = rows(multiline.read_csv_parallel(spark, str(tmp_path / "out"), SCHEMA))
    assert got == sorted(((f'a "b"\n{i},', i) for i in range(300)), key=repr)  # the writer trims fields


def test_missing_marks_header_only_and_lost_columns(spark, tmp_path):
    (tmp_path / "a.csv").write_text("k,Text\n1,NA\n2,\n3,x\n")
    (tmp_path / "same.csv").write_text("Text,k\nNA,1\n,2\nx,3\n")
    by_name = multiline.read_csv_parallel(spark, str(tmp_path / "a.csv"), SCHEMA)
    assert by_name.columns == ["Text", "k"]
    assert sorted(by_name.collect(), key=lambda r: r["k"]) == sorted(readers.read_csv(spark, str(tmp_path / "same.csv"), SCHEMA).collect(), key=lambda r: r["k"])
    (tmp_path / "b.csv").write_text("Text,k\n")
    assert multiline.read_csv_parallel(spark, str(tmp_path / "b.csv"), SCHEMA).count() == 0
    (tmp_path / "c.csv").write_text("Text\nx\n")
    with pytest.raises(ValueError):
        multiline.read_csv_parallel(spark, str(tmp_path / "c.csv"), SCHEMA)


def test_a_million_strata_without_a_window_over_all(spark, monkeypatch):
    df = spark.range(1_000_000).select("id", (F.col("id") % 999_983).cast("string").alias("s"))
    sizes = df.groupBy(F.col("s").alias("__stratum")).agg(F.count(F.lit(1)).alias("__size"))
    kept = splits._kept("__size", 0.3, "kept", sizes)
    assert kept.agg(F.sum("kept")).first()[0] == 700_000
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan.split("Scan")[0]


def test_entry_without_an_optional_library():
    code = (
        "import sys; sys.modules['sentencepiece'] = None\n"
        "import __spark_entry__ as e\n"
        "q = e.queries(); assert 'intent_tag_summary' in q and not [n for n in q if n.startswith('op')], q\n"
        "assert set(e.oracle_sql()) <= set(q)"
    )
    root = Path(__file__).resolve().parent.parent
    subprocess.run([sys.executable, "-c", code], cwd=root, check=True, timeout=120)
