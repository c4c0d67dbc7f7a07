"""Expected values derived by hand from the rules."""

import re

import pytest
from pyspark.sql import functions as F

from lanternpost.functions import labels as lb
from lanternpost.functions import lexicon as lx
from lanternpost.functions import rules
from lanternpost.functions.text import _needed_literal
from lanternpost.operators import tagging

PHRASES = [
    ("i want to die", "Critical Risk", "high", "immediate"),
    ("planning to kill myself", "Critical Risk", "immediate", "immediate"),
    ("relapse after vodka", "Maladaptive Coping", "none", "high"),
    ("any advice please help", "Seeking Help", "none", "high"),
    ("started zoloft last week", "Progress Update", "none", "high"),
    ("journaling and meditation", "Positive Coping", "none", "high"),
    ("mood check-in", "Mood Tracking", "none", "high"),
    ("my landlord evicts us", "Cause of Distress", "none", "high"),
    ("so anxious and overwhelmed", "Mental Distress", "none", "high"),
    ("nothing special 💔", "Mental Distress", "none", "high"),
    ("my week was rough", "Mental Distress", "none", "high"),
    ("is it there, where?", "Seeking Help", "none", "high"),
    ("my feel is off", "Mood Tracking", "none", "high"),
    ("i feel hopeless", "Mood Tracking", "medium", "high"),
    ("the quiet sky", "Miscellaneous", "none", "high"),
    ("", "Miscellaneous", "none", "high"),
    (None, "Miscellaneous", "none", "high"),
    ("Is it there? Where?  \n", "Seeking Help", "none", "high"),
    ("I WANT TO DIE", "Critical Risk", "high", "immediate"),
    ("the éod list", "Miscellaneous", "none", "high"),
    ("an od note", "Critical Risk", "none", "high"),
    ("kill \n my self", "Critical Risk", "none", "high"),
    ("weights 3/4 of it", "Mood Tracking", "none", "high"),
]


def test_intent_and_crisis(spark):
    rows = spark.createDataFrame([(i, p[0]) for i, p in enumerate(PHRASES)], "i int, post string")
    plain = tagging.with_crisis(tagging.with_intent(rows, "post"), "post")
    worried = tagging.with_crisis(rows.withColumn("c", F.lit("HIGH")), "post", "c", level="worried", flag="w")
    got = plain.join(worried.drop("post"), "i").orderBy("i").collect()
    assert [(r["intent"], r["crisis_level"], r["worried"]) for r in got] == [p[1:] for p in PHRASES]
    assert all(r["is_crisis"] == (r["crisis_level"] in ("immediate", "high")) for r in got)


def test_mandatory_literals_occur_in_every_match():
    samples = {
        r"kill\s*my\s*self": ["killmyself", "kill my  self"],
        r"self[-\s]*harm": ["selfharm", "self-harm", "self - harm"],
        r"tips?\b": ["tip", "tips"],
        r"break ?up": ["breakup", "break up"],
        r"on[-\s]?site": ["onsite", "on-site"],
        r"breath(ing)? exercises?": ["breath exercise", "breathing exercises"],
        r"humou?r": ["humor", "humour"],
        r"sober \d+ (days|weeks|months)": ["sober 12 days"],
        r"how i[’']?m feeling": ["how im feeling", "how i'm feeling"],
        r"\b\d+/\d+\b": ["3/10"],
        r"\bbetter\s+dead\b.*\bhow\b": ["better dead, and how"],
        r"hobbies?": ["hobbie", "hobbies"],
    }
    for pattern, texts in samples.items():
        for text in texts:
            assert re.search(pattern, text)
            assert _needed_literal(pattern) in text
    assert _needed_literal(r"\b(hang|hanging|hanged)\s+(myself|yourself|themselves)") == ""


TAG_ROWS = [
    ("Mental Distress; Cause of Distress", ["Mental Distress", "Cause of Distress"], None, ["Cause of Distress", "Mental Distress"], "Low"),
    ("Causes of Distress", ["Cause of Distress"], None, ["Cause of Distress"], "Low"),
    ("critical risk., Seeking Help", ["Critical Risk", "Seeking Help"], None, ["Seeking Help"], "Medium"),
    ("['Mood Tracking', 'Seeking Help']", ["Miscellaneous"], ["Mood Tracking", "Seeking Help"], ["Miscellaneous"], "Low"),
    ("Progress Update. Cause of Distress", ["Miscellaneous"], None, ["Progress Update"], "Low"),
    ("Positive coping, positive Coping", ["Positive Coping"], None, ["Positive Coping"], "Low"),
    ("Critical Risk, Maladaptive Coping", ["Critical Risk", "Maladaptive Coping"], None, ["Critical Risk", "Maladaptive Coping"], "High"),
    ("misc", ["Miscellaneous"], None, ["Miscellaneous"], "Low"),
    ("", ["Miscellaneous"], None, [], "Low"),
    (None, ["Miscellaneous"], None, [], "Low"),
    ("['Mood Tracking', broken]", ["Miscellaneous"], ["Miscellaneous"], ["Miscellaneous"], "Low"),
    ('["Mood Tracking"]', ["Miscellaneous"], ["Mood Tracking"], ["Miscellaneous"], "Low"),
]


def test_tag_readers(column):
    raw = [r[0] for r in TAG_ROWS]
    assert column(raw, lb.tag_list) == [r[1] for r in TAG_ROWS]
    assert column(raw, lb.tag_list_literal) == [r[2] or r[1] for r in TAG_ROWS]
    assert column(raw, lb.human_tags) == [r[3] for r in TAG_ROWS]
    assert [c["level"] for c in column(raw, rules.concern_from_tags)] == [r[4] for r in TAG_ROWS]


def test_bracket_reader_accepts_unquoted_items(column):
    assert column(["[Mood Tracking, 'Seeking Help']"], lb.tag_list_bracket) == [["Mood Tracking", "Seeking Help"]]


def test_concern_reason_and_notes(column):
    got = column(
        ["Critical Risk, Seeking Help, Progress Update", "Seeking Help, Cause of Distress", "Mood Tracking", "x"],
        rules.concern_from_tags,
    )
    assert [tuple(g) for g in got] == [
        ("High", "Critical Risk", "with Progress Update; and Seeking Help"),
        ("Medium", "Seeking Help", "Cause Of Distress"),
        ("Low", "Mood Tracking", ""),
        ("Low", "No higher-severity tags", ""),
    ]


def test_concern_levels(column):
    raw = ["Low", "med", "HIGH.", "1", "Mid ", "2", "unknown", "", None]
    assert column(raw, lb.concern_kb) == ["Low", "Medium", "HIGH.", "Medium", "Mid", "High", "unknown", "", ""]
    assert column(raw, lb.concern_strict) == ["low", "medium", "high", None, "medium", None, None, None, None]


REPLIES = [
    ("Stay calm.", "too short"),
    ("you are heard and there are people ready to listen to you today.", "no capital"),
    ("Task: listen to the user and answer with care and kindness today.", "leakage"),
    ("Reaching out helps. My family felt better once they talked it over together.", "persona"),
    ("It makes sense. A therapist could listen to every worry you carry today.", "toxic"),
    ("Try - a - b - c - d - e - f - g and rest for a while each day.", "list format"),
    ("This reply is long enough but only one sentence", "too few sentences"),
    ("Your feelings make sense. Small steps and rest can bring some relief over time.", None),
    (None, "too short"),
]


def test_reply_rules(column):
    assert column([r[0] for r in REPLIES], rules.reject_reason) == [r[1] for r in REPLIES]


@pytest.mark.parametrize(
    "reply, expected",
    [
        ("All is well. ", lx.APOLOGY),  # not cut off, so it broke another rule
        ("One done. Two is cut", "One done."),
        ("Step 1. then", "Step 1."),
        ("First, rest. Next 2. then", "First, rest."),
        ("Say it Second,", "Say it."),
        ("no end here", lx.APOLOGY),
        ("", lx.APOLOGY),
        (None, lx.APOLOGY),
    ],
)
def test_repair(column, reply, expected):
    assert column([reply], rules.repaired) == [expected]


def test_unsafe_snippets(column):
    texts = ["hanging myself", "how to   kill", "pill and die", "pro-suicide", "a hangar", "better dead and show", None]
    assert column(texts, rules.unsafe_snippet) == [True, True, True, True, False, False, False]


def test_verbatim_window(column):
    base = "x" * 30 + "y" * 40
    copied = rules.copies_snippet
    assert column([base, base[:60], base[:61]], lambda c: copied(F.lit("A" + base), c)) == [True, False, True]


def test_every_pattern_agrees_with_python(spark):
    """Each pattern on its own, on texts that put its literal inside, at the edge of, and apart from words."""
    from lanternpost.functions.text import matches_any

    patterns = [p for _, ps in lx.INTENT_PATTERNS for p in ps if re.search(r"[\\()\[\]?*+|]", p)]
    patterns += lx.UNSAFE_SNIPPET_PATTERNS + lx.FIRST_PERSON + lx.QUESTION_WORDS + lx.FEEL_WORDS
    seeds = {_needed_literal(p) for p in patterns} - {""}
    seeds |= {"kill my self", "self - harm", "check in", "3/10", "status: ok", "anyone else?", "hanging myself", "i'm", "feeling"}
    texts = sorted({t for s in seeds for t in (s, f"x{s}", f"{s}x", f"a {s} b", f"é{s}", f"{s}é", f"{s}s", f"{s}ing.", f"({s})", f"1{s}_")})
    rows = spark.createDataFrame([(t,) for t in texts], "t string").coalesce(1)
    got = rows.select("t", F.array(*[matches_any(F.col("t"), [p]) for p in patterns]).alias("m")).collect()
    for r in got:
        want = [bool(re.search(p, r["t"])) for p in patterns]
        assert r["m"] == want, (r["t"], [p for p, a, b in zip(patterns, r["m"], want) if a != b])
