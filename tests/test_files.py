"""Readers, writers, noisy input and streams."""

import json

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lanternpost.operators import replies, tagging
from lanternpost.sources import readers, schemas, sinks
from lanternpost.sources.storage import shared_folder, stored
from lanternpost.streaming import jobs


def text_schema(*names):
    return T.StructType([T.StructField(n, T.StringType()) for n in names])


def test_csv_quotes_newlines_and_missing(spark, tmp_path):
    f = tmp_path / "in.csv"
    f.write_text('Text,Tag\n"line one\nsaid ""hi"", ok","Seeking Help"\nNA,\nplain,"Mood Tracking, x"\n', encoding="utf-8")
    got = readers.read_csv(spark, str(f), text_schema("Text", "Tag")).collect()
    assert [tuple(r) for r in got] == [
        ('line one\nsaid "hi", ok', "Seeking Help"), (None, None), ("plain", "Mood Tracking, x"),
    ]
    table = tagging.post_table(readers.read_csv(spark, str(f), text_schema("Text", "Tag"))).collect()
    assert [r["TagsList"] for r in table] == [["Seeking Help"], ["Miscellaneous"], ["Mood Tracking"]]
    assert table[1]["Post"] == ""


def test_column_names(spark):
    with pytest.raises(ValueError, match="Post, Text"):
        tagging.post_table(spark.range(1).select(F.lit("x").alias("Tag")))
    df = spark.range(1).select(F.lit(1).alias("a"), F.lit(2).alias("b"))
    assert tagging.resolve_column(df, ["Text"], "first") == "a"
    assert tagging.resolve_column(df, ["Tags"], "last") == "b"


def test_csv_round_trip(spark, tmp_path):
    rows = [('a "b"\n c', ["x", "y"]), ("", []), ("back\\slash", ["z"])]
    df = spark.createDataFrame(rows, "Post string, Tags array<string>")
    sinks.write_csv(df, str(tmp_path / "out"))
    got = readers.read_csv(spark, str(tmp_path / "out"), text_schema("Post", "Tags")).collect()
    assert sorted((r["Post"] or "", r["Tags"] or "") for r in got) == sorted((p, ", ".join(t)) for p, t in rows)


def test_jsonl_blank_and_broken_lines(spark, tmp_path):
    f = tmp_path / "in.jsonl"
    lines = [json.dumps({"post": "p1", "concern": "low"}), "", '{"post": "cut', json.dumps({"intent": "x"}), json.dumps({"post": "‚Äö√Ñ√¥"})]
    f.write_text("\n".join(lines), encoding="utf-8")
    read = readers.read_jsonl_tolerant(spark, str(f), schemas.GOLD).cache()
    bad, good = readers.usable_rows(read, "post")
    assert read.count() == 4 and read.where(bad).count() == 2
    assert {r["post"] for r in good.collect()} == {"p1", "‚Äö√Ñ√¥"}


def test_two_record_shapes(spark, tmp_path):
    f = tmp_path / "in.jsonl"
    rows = [
        {"post": "a", "reply": "flat", "citations": [{"doc_id": "d", "text": "t"}]},
        {"post": "b", "rag_output": {"reply": "inner", "citations": []}, "reply": "outer"},
        {"post": "c", "rag_output": {"error": "x"}, "reply": "outer"},
        {"post": "d"},
    ]
    f.write_text("\n".join(json.dumps(r) for r in rows), encoding="utf-8")
    got = readers.either_shape(readers.read_jsonl(spark, str(f), schemas.ANY_PREDICTION)).orderBy("post").collect()
    assert [(r["reply"], len(r["citations"])) for r in got] == [("flat", 1), ("inner", 0), ("", 0), ("", 0)]


def test_json_salvage(column):
    lines = ['{"post": "p"}', 'WARN {x}\n{"post": "p"}', 'log\n{"post": "p"} \nbye', '{"post": "p"} bye', "none", None, '{"post": "p"}, {"post": "q"}']
    got = column(lines, lambda c: readers.salvaged_json(c, schemas.GOLD))
    assert [g and g["post"] for g in got] == ["p", None, "p", None, None, None, None]


def test_metrics_runs_stay(spark, tmp_path):
    df = spark.range(1).select(F.lit(0.5).alias("macro_f1"))
    for run in ("r1", "r2"):
        sinks.write_metrics(df, str(tmp_path / "m"), "base", run)
    read = spark.read.schema("macro_f1 double, run_id string").json(str(tmp_path / "m"))
    assert {r["run_id"] for r in read.collect()} == {"base_r1", "base_r2"}


def test_stored_table_is_read_back(spark):
    df = stored(spark.range(5).withColumn("v", F.array(F.lit(1.0))), "t")
    assert df.count() == 5 and "Scan" in df._jdf.queryExecution().executedPlan().toString()
    assert shared_folder(spark, "x") != shared_folder(spark, "x")


def test_stream_equals_batch_and_resumes(spark, tmp_path):
    inbox, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    schema = text_schema("post", "concern")

    def arrive(posts):
        spark.createDataFrame([(p, "high" if "!" in p else None) for p in posts], schema).write.mode("append").json(inbox)

    first, second = ["i want to die", "the quiet sky"], ["any advice please help!", "i feel hopeless"]
    for batch in (first, second, []):
        if batch:
            arrive(batch)
        jobs.start_scoring(jobs.file_stream(spark, inbox, schema, files="*.json"), out, state, concern="concern").awaitTermination()
    got = {tuple(r) for r in spark.read.parquet(out).collect()}
    whole = spark.createDataFrame([(p, "high" if "!" in p else None) for p in first + second], schema)
    assert got == {tuple(r) for r in jobs.scored_posts(whole, concern="concern").collect()} and len(got) == 4


def test_audit_log_batch_replay_is_stored_once(spark, tmp_path):
    inbox, out = str(tmp_path / "in"), str(tmp_path / "out")
    rows = [("2024-05-01 10:00:00", "p1", "r1", "immediate"), ("2024-05-02 10:00:00", "p2", "r2", "none")]
    schema = text_schema("at", "post", "reply", "level")
    spark.createDataFrame(rows, schema).write.json(inbox)
    columns = {"at": "ts", "post": "post", "reply": "reply", "level": "level", "concern": "concern", "snippets": F.lit(2)}
    for state in ("s1", "s2"):  # a lost checkpoint runs batch 0 again
        stream = jobs.file_stream(spark, inbox, schema, files="*.json")
        stream = stream.withColumn("ts", F.to_timestamp("at")).withColumn("concern", F.lit("low"))
        jobs.start_audit_log(stream, out, str(tmp_path / state), **columns).awaitTermination()
    log = sinks.read_log(spark, out).orderBy("day").collect()
    assert [(r["bucket"], r["day"], r["requires_review"], r["num_snippets"]) for r in log] == [
        ("high_risk", "20240501", True, 2), ("general", "20240502", False, 2),
    ]
    assert log[0]["post_length"] == 2 and len(log[0]["post_hash"]) == 32


def test_batch_log_appends(spark, tmp_path):
    df = spark.createDataFrame([("p", "r", "high", "low")], "post string, reply string, level string, concern string")
    df = df.withColumn("ts", F.to_timestamp(F.lit("2024-01-02 00:00:00")))
    records = replies.audit_records(df, at="ts", post="post", reply="reply", level="level", concern="concern", snippets=F.lit(0))
    out = str(tmp_path / "log")
    assert [sinks.append_log(records, out, batch) for batch in ("a", "a/1", "a")] == [True, True, False]
    assert [(r["bucket"], r["day"]) for r in sinks.read_log(spark, out).collect()] == [("high_risk", "20240102")] * 2


def test_list_literals_are_read_back(spark, tmp_path):
    df = spark.createDataFrame([("p", ["Mood Tracking", "Seeking Help"])], "Text string, Final_Tags array<string>")
    sinks.write_csv(df, str(tmp_path / "out"), list_literals=True)
    read = readers.read_csv(spark, str(tmp_path / "out"), text_schema("Text", "Final_Tags"))
    assert read.first()["Final_Tags"] == "['Mood Tracking', 'Seeking Help']"
    assert tagging.post_table(read).first()["TagsList"] == ["Mood Tracking", "Seeking Help"]


def test_knowledge_base_files_in_order(spark, tmp_path):
    from lanternpost.operators import knowledge

    rows = [(f"d{i:02d}", "A sentence of some length here. " * (i % 4 + 1) * 8) for i in reversed(range(20))]
    source = spark.createDataFrame(rows, "doc_id string, output string").repartition(4)
    chunks = knowledge.chunk_rows(source, intent_col=None, concern_col=None)
    sinks.write_knowledge_base(chunks, str(tmp_path / "c"), str(tmp_path / "m"), ordered=True)
    lines = [json.loads(x) for f in sorted((tmp_path / "c").glob("part-*")) for x in f.read_text().splitlines()]
    ids = [x["doc_id"] for x in lines]
    assert ids == sorted(ids) and len(ids) == chunks.count()
    meta = readers.read_jsonl(spark, str(tmp_path / "m"), schemas.KB_METADATA)
    assert {r["doc_id"] for r in meta.collect()} == set(ids)
