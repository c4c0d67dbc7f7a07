"""Lexicon tables against plain substring tests."""

from pyspark.sql import functions as F

from lanternpost.functions import phrases
from lanternpost.operators import lexicons

POSTS = [(1, "she sells sea shells"), (1, "she sells sea shells"), (2, None), (3, ""), (None, "héllo wörld 🙂🙂"), (4, "a" * 50_000 + "seashell"), (5, "ab\x00cd she")]
WORDS = ["she", "shells", "sea", "sea shell", "hé", "🙂", "wörld 🙂", "aaa", "b\x00c", "", None, "she", "absent", "z"]


def frames(spark):
    posts = spark.createDataFrame(POSTS, "id long, text string").withColumn("phrase", F.lit("clash")).withColumn("found", F.lit(1))
    return posts, spark.createDataFrame([(w, "x") for w in WORDS], "word string, tag string")


def expected():
    return sorted(((i, w) for i, t in POSTS for w in set(WORDS) if t and w and w in t), key=repr)


def test_hits_equal_substring_tests(spark):
    posts, lexicon = frames(spark)
    for limit in (lexicons.PART_BYTES, 8):
        assert sorted(map(tuple, lexicons.lexicon_hits(posts, "id", "text", lexicon, "word", limit).collect()), key=repr) == expected()


def test_without_the_library(spark, monkeypatch):
    monkeypatch.setattr(phrases, "ahocorasick", None)
    posts, lexicon = frames(spark)
    assert sorted(map(tuple, lexicons.lexicon_hits(posts, "id", "text", lexicon, "word").collect()), key=repr) == expected()


def test_empty_sides(spark):
    posts, lexicon = frames(spark)
    assert lexicons.lexicon_hits(posts.limit(0), "id", "text", lexicon, "word").count() == 0
    assert lexicons.lexicon_hits(posts, "id", "text", lexicon.limit(0), "word").count() == 0
    none = lexicons.lexicon_hits(posts, "id", "text", lexicon, "word").limit(0)
    assert {r["n_posts"] for r in lexicons.lexicon_counts(none, "id", lexicon, "word", "tag").collect()} == {0}


def test_ten_thousand_phrases(spark):
    lexicon = spark.range(10_000).select(F.concat(F.lit("w"), "id", F.lit(" ")).alias("word"))
    posts = spark.range(300).select("id", F.concat(F.lit("say w"), F.col("id") * 37, F.lit(" and w"), F.col("id") * 41, F.lit(" .")).alias("text"))
    for limit in (lexicons.PART_BYTES, 30_000):
        got = {tuple(r) for r in lexicons.lexicon_hits(posts, "id", "text", lexicon, "word", limit).collect()}
        assert got == {(i, f"w{n} ") for i in range(300) for n in (i * 37, i * 41) if n < 10_000}


def test_few_texts_at_a_time_give_the_same_hits(spark, monkeypatch):
    monkeypatch.setattr(phrases, "TEXTS_STEP", 2)
    posts, lexicon = frames(spark)
    assert sorted(map(tuple, lexicons.lexicon_hits(posts.coalesce(1), "id", "text", lexicon, "word").collect()), key=repr) == expected()
