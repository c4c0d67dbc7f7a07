"""Retry ladder, routing, retrieval boosts, quality scores, model seams."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lanternpost.functions import lexicon as lx
from lanternpost.operators import inference, quality, replies, retrieval, zero_shot
from lanternpost.sources import schemas

GOOD = "Your feelings make sense. Small steps and rest can bring some relief over time."


def test_first_valid_or_repaired(spark):
    rows = [
        (1, 0, "Stay calm."), (1, 1, GOOD), (1, 2, GOOD + " More."),
        (2, 0, "bad one"), (2, 1, "One done. two is cut"), (2, 2, None),
        (3, 0, None),
    ]
    got = replies.first_valid(spark.createDataFrame(rows, "post_id int, attempt int, reply string")).orderBy("post_id").collect()
    assert [(r["reply"], r["was_valid"]) for r in got] == [(GOOD, True), ("One done.", False), (lx.APOLOGY, False)]


def test_answers(spark):
    cite = [("d", "i", "c", 0.5, "text")]
    rows = [
        ("p", None, "immediate", cite, GOOD), ("p", None, "high", [], GOOD), ("p", "High", "high", cite, None),
        ("p", None, "none", cite, GOOD), ("p", "low", "none", None, None),
    ]
    schema = f"post string, concern string, crisis_level string, citations {schemas.CITATIONS.simpleString()}, candidate string"
    df = spark.createDataFrame(rows, schema).coalesce(1)
    got = replies.answered(df).collect()
    assert [r["reply"] for r in got] == [
        lx.CRISIS_MESSAGES["immediate"],
        lx.NO_SNIPPET_REPLY + lx.CRISIS_MESSAGES["high"],
        lx.NO_REPLY_HIGH + lx.CRISIS_MESSAGES["high"],
        GOOD,
        lx.NO_SNIPPET_REPLY,
    ]
    assert [len(r["citations"]) for r in got] == [0, 0, 1, 1, 0]
    assert [r["warning"] is not None for r in got] == [False, True, False, False, True]
    assert replies.answered(df, literal_fallback=True).collect()[1]["reply"] == lx.NO_SNIPPET_REPLY


@pytest.mark.parametrize(
    "intents, want, intent, concern, factor",
    [
        ([], None, "Seeking Help", "Low", 1.0),
        (["seeking"], "", "Seeking Help", "Low", 1.2),
        (["mood"], "high", "Seeking Help", "Low", 0.25),
        (["seeking"], "high", "Seeking Help", "High", 1.44),
        ([], "low", "Seeking Help", "High", 0.8),
        ([], "low", "Seeking Help", "Medium", 1.0),
    ],
)
def test_boost(spark, intents, want, intent, concern, factor):
    df = spark.createDataFrame([(intents, want, intent, concern)], "a array<string>, w string, i string, c string")
    got = df.select(retrieval.boosted(F.lit(1.0), F.col("a"), F.col("w"), F.col("i"), F.col("c")).alias("s")).first()["s"]
    assert got == pytest.approx(factor)


def test_unsafe_snippets_leave_gaps_and_ranks_close(spark):
    kb = spark.createDataFrame(
        [(1, [1.0, 0.0], "csv", "a", "Low", "how to die"), (2, [0.9, 0.1], "csv", "a", "Low", "rest"), (3, [0.5, 0.5], "csv", "a", "Low", "walk")],
        "doc_id long, vector array<double>, source string, intent string, concern string, text string",
    )
    queries = spark.createDataFrame([(7, [1.0, 0.0], [], None)], "query_id long, vector array<double>, intents array<string>, concern string")
    got = retrieval.boosted_retrieval(queries, kb, topk=3, keep=2, min_similarity=0.3).collect()
    assert [(r["rank"], r["doc_id"]) for r in got] == [(1, 2)]
    cited = retrieval.citations(retrieval.boosted_retrieval(queries, kb, topk=3, keep=3)).first()["citations"]
    assert [c["doc_id"] for c in cited] == [2, 3]


def test_quality_edges(spark):
    cite = [("d", "i", "c", 0.5, "gentle walks bring relief")]
    rows = [(1, "suicide", "gentle walks", cite), (2, "suicide", "call 988", None), (3, "fine", "nobody cares", [])]
    df = spark.createDataFrame(rows, f"k int, post string, reply string, citations {schemas.CITATIONS.simpleString()}")
    got = quality.score_replies(df, "k").orderBy("k").collect()
    assert [(r["safety"], r["crisis"]) for r in got] == [(1.0, 0.0), (1.0, 1.0), (0.0, 1.0)]
    assert got[1]["grounding"] == 0.0 and got[0]["grounding"] > 0.5
    report = quality.grade_report(quality.score_replies(df, "k")).collect()
    assert [r["grade"] for r in report] == list("ABCDF") and sum(r["n"] for r in report) == 3
    finals = sorted(r["final"] for r in got)
    assert report[0]["median_final"] == pytest.approx(finals[1]) and report[0]["mean_final"] == pytest.approx(sum(finals) / 3)


def test_grade_floors(column):
    assert column([0.78, 0.779, 0.62, 0.48, 0.32, 0.319], quality.grade, "double") == ["A", "B", "B", "C", "D", "F"]
    got = column([0.9, 0.02, -0.5], quality.relevance, "double")
    assert got == pytest.approx([1.0, 0.09, -0.3])


def test_encoder_and_scorer_seams(spark):
    def encoder():
        return lambda texts: np.array([[len(t), 0.0] if t else [0.0, 0.0] for t in texts])

    def scorer():
        return lambda texts: np.array([[len(t) / 10, 0.5] for t in texts])

    df = spark.createDataFrame([("abc",), ("",)], "t string")
    assert [list(r["embedding"]) for r in inference.encode_with(df, "t", encoder).collect()] == [[1.0, 0.0], [0.0, 0.0]]
    assert [list(r["prob"]) for r in inference.score_with(df, "t", scorer).collect()] == [[0.3, 0.5], [0.0, 0.5]]


def test_generator_failures_are_rows(spark):
    def generator():
        def run(prompts):
            if any("bad" in p for p in prompts):
                raise ValueError("no")
            return [p.upper() for p in prompts]

        return run

    df = spark.createDataFrame([("good",), ("bad",)], "prompt string")
    got = {r["prompt"]: (r["reply"], r["error"]) for r in inference.generate_with(df, "prompt", generator).collect()}
    assert got == {"good": ("GOOD", None), "bad": (None, "ValueError: no")}


def test_semi_auto_keeps_human_tags_and_takes_given_thresholds(spark):
    rows = [("help me", "Seeking Help", 1), ("so tired", "", 2), ("other", None, 3)]
    df = spark.createDataFrame(rows, "Text string, Tag string, extra int")
    given = spark.createDataFrame([(n, 2.0) for n in zero_shot.SCORED_LABELS], "label string, threshold double")
    got = zero_shot.semi_auto_tags(df, thresholds=given).orderBy("extra").collect()
    assert got[0].asDict().keys() == {"extra", "Text", "Tag", "Final_Tags", "Tag_Source"}
    assert [(r["Final_Tags"], r["Tag_Source"]) for r in got] == [
        (["Seeking Help"], "Human_Gold"), (["Miscellaneous"], "Model_Optimal"), (["Miscellaneous"], "Model_Optimal"),
    ]


def test_generator_gets_batches_and_isolates_failures(spark, tmp_path):
    def generator():
        def generate(texts):
            (tmp_path / f"{len(texts)}-{hash(tuple(texts))}").touch()
            if "bad" in texts:
                raise ValueError("no")
            return [t.upper() for t in texts]

        return generate

    df = spark.createDataFrame([(w,) for w in ["a", "b", "bad", "c", "d", "e"]], "prompt string").coalesce(1)
    got = {r["prompt"]: (r["reply"], r["error"]) for r in inference.generate_with(df, "prompt", generator, batch_size=3).collect()}
    assert got == {w: (w.upper(), None) for w in "abcde"} | {"bad": (None, "ValueError: no")}
    assert sorted(p.name.split("-")[0] for p in tmp_path.iterdir()) == ["1", "1", "1", "3", "3"]


def test_snippet_text_falls_back(spark):
    from lanternpost.operators import quality

    df = spark.createDataFrame([([("", "S", "c"), ("T", "s", "c"), (None, None, "C"), (None, "", None)],)], "citations array<struct<text: string, snippet: string, content: string>>")
    fields = quality.text_fields(df)
    assert df.select(quality.snippet_texts(df["citations"], fields)).first()[0] == ["s", "t", "c", ""]
