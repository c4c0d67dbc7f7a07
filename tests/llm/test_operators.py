"""Operators against brute force, round trips and held-out rows, on small planted tables."""

import hashlib
import math
import re

import numpy as np
import pytest
import sentencepiece
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lanternpost.llm import (
    chat_formatting,
    components,
    embedding_dedup,
    hamming,
    helpers,
    line_dedup,
    packing,
    quality_rules,
    simhash,
    substring_dedup,
    token_counts,
    unigram,
    url_filters,
)
from lanternpost.llm.queries import PIECE_MODEL, RULES, WORD_MODEL

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
ODD = [None, "", " \n\t ", "one", "Ünïcode ça\x0bva  l'été don't. <s> </s> ▁ x", "🙂" * 3, "a" * 3000, "\x00 nul\x1cbyte \x85 nel", "<|endoftext|> <|ENDOFTEXT|>,"]


def prose(rng, n):
    bank = ["the", "of", "and", "river", "stone", "light", "Garden", "walks,", "under.", "blue", "ß", "été"]
    return " ".join(bank[i] + str(j) if j % 3 else bank[i] for i, j in zip(rng.integers(0, len(bank), n), rng.integers(0, 40, n)))


@pytest.fixture(scope="module")
def texts():
    rng = np.random.default_rng(5)
    passage, line = prose(rng, 60), "The very same License line, every time"
    out = list(ODD)
    out += [prose(rng, int(n)) for n in rng.integers(5, 300, 20)]
    out += [prose(rng, 40) + " " + passage + "\n" + prose(rng, 30) for _ in range(6)]
    out += [f"{prose(rng, 12)}\n  {line.upper() if i % 2 else line} \n{prose(rng, 9)}\n" for i in range(5)]
    out += [out[12], out[12], out[14] + " tail", " ".join(["loop", "the", "loop"] * 40), prose(rng, 4000)]
    return out


@pytest.fixture(scope="module")
def docs(spark, texts):
    """Extra columns that clash with the names the operators use."""
    rows = [(i, t, "en", i, "x", "y", 1.0) for i, t in enumerate(texts)]
    rows += [(3, "one", "en", 0, "x", "y", 1.0), (7, "same id, other text", None, 0, None, "y", 1.0), (None, "no id", "xx", 0, "x", None, None)]
    schema = "doc_id long, text string, lang string, n_words long, doc string, row string, weight double"
    return spark.createDataFrame(rows, schema).repartition(5)


def rows_of(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)


def input_rows(docs):
    return [(r["doc_id"], r["text"] or "") for r in docs.collect()]


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_substrings_equal_brute_force(docs):
    given = [(i, WORDS.findall(t)) for i, t in input_rows(docs)]
    seen = {}
    for _, w in given:
        for k in range(len(w) - 34):
            key = tuple(w[k : k + 35])
            seen[key] = seen.get(key, 0) + 1
    want = []
    for i, w in given:
        gone = [False] * len(w)
        for k in range(len(w) - 34):
            if seen[tuple(w[k : k + 35])] > 1:
                gone[k : k + 35] = [True] * 35
        want.append((i, len(w), sum(gone), " ".join(x for x, g in zip(w, gone) if not g)))
    done = substring_dedup.dedup_substrings(docs, "doc_id", "text", "r")
    assert set(docs.columns) < set(done.columns)
    got = done.select("doc_id", "r.n_words", "r.n_removed", "r.text", "r.spans").collect()
    assert sorted([tuple(r)[:4] for r in got], key=repr) == sorted(want, key=repr)
    assert sum(w[2] for w in want) > 300
    for r in got:
        assert sum(s["end"] - s["start"] for s in r["spans"]) == r["n_removed"]
        assert all(a["end"] < b["start"] for a, b in zip(r["spans"], r["spans"][1:]))


def test_rows_of_hot_keys_are_dealt_to_many_tasks(spark):
    rows = spark.range(30_000).selectExpr("if(id % 3 = 0, -1, id % 4000) AS k", "id AS slice", "cast(null AS string) AS slices")
    counted = rows.groupBy("k").agg(F.count(F.lit(1)).alias("n")).where("k < 1000")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", False)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    got = helpers.rows_with_keys(rows, counted, ["k"])
    sizes = got.rdd.mapPartitions(lambda p: [sum(r["k"] == -1 for r in p)]).collect()
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert sum(sizes) == 10_000 and max(sizes) < 3_000
    assert sorted(r["slice"] for r in got.collect()) == [i for i in range(30_000) if i % 3 == 0 or i % 4000 < 1000]
    assert helpers.rows_with_keys(rows, counted.limit(0), ["k"]).count() == 0


def test_windows_inside_one_document(spark):
    rng = np.random.default_rng(1)
    part = prose(rng, 50)
    df = spark.createDataFrame([(1, f"{part} middle {part} end"), (2, prose(rng, 80))], "doc_id long, text string")
    got = {r["doc_id"]: r["r"] for r in substring_dedup.dedup_substrings(df, "doc_id", "text", "r").collect()}
    assert got[1]["text"] == "middle end" and got[2]["n_removed"] == 0


def test_lines_equal_brute_force(docs):
    given = input_rows(docs)

    def key(line):
        return "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(" \t\n\x0b\x0c\r"))

    holders = {}
    for i, t in given:
        for x in t.split("\n"):
            if len(key(x)) >= 20:
                holders.setdefault(key(x), set()).add(i)
    want = []
    for i, t in given:
        lines = t.split("\n")
        kept = []
        for x in lines:
            owners = holders.get(key(x), ())
            if len(owners) >= 3 and i != max((o for o in owners if o is not None), default=None):
                continue
            kept.append(x)
        want.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    for batches in (1, 5):
        done = line_dedup.dedup_lines(docs, "doc_id", "text", "r", batches=batches)
        assert rows_of(done.select("doc_id", "r.*"), "doc_id", "n_lines", "n_dropped", "text") == sorted(want, key=repr)
    assert sum(w[2] for w in want) >= 4


def test_runs_are_levelled(spark, tmp_path):
    runs = line_dedup.LineRuns(spark, str(tmp_path), fan_in=2)
    for k in reversed(range(5)):  # batches come with falling ids
        runs.add(spark.createDataFrame([(k, 1, 1), (k, k + 10, 2)], "doc long, h1 long, h2 long"))
    assert [len(level) for level in runs.levels] == [1, 0, 1]
    totals = {(r["h1"], r["n_docs"], r["holder"]) for r in runs.totals().collect()}
    assert totals == {(1, 5, 4)} | {(k + 10, 1, k) for k in range(5)}
    assert runs.rows().where("first").groupBy("h1", "h2").count().where("count > 1").count() == 0


def test_later_batches_do_not_move_a_line(spark, tmp_path):
    """The anti-join decides: a key that a run holds keeps the holder of its first sighting."""
    runs = line_dedup.LineRuns(spark, str(tmp_path), fan_in=3)
    for part in ([(9, 1, 1), (8, 1, 1), (8, 2, 2)], [(7, 1, 1), (7, 3, 3)], [(None, 1, 1), (None, 4, 4)]):
        runs.add(spark.createDataFrame(part, "doc long, h1 long, h2 long"))
    assert {tuple(r) for r in runs.decided(3).collect()} == {(1, 1, 9)}
    assert {tuple(r) for r in runs.decided(1).collect()} == {(1, 1, 9), (2, 2, 8), (3, 3, 7), (4, 4, None)}


def test_batches_fall_by_id(spark):
    for ids, kind in ([None, *range(40)], "long"), ([None, *map(str, range(40))], "string"), ([None, 5, 5], "long"), ([], "long"):
        df = spark.createDataFrame([(i,) for i in ids], f"doc_id {kind}")
        got = df.select("doc_id", line_dedup.falling_batch(df, "doc_id", 4).alias("b")).collect()
        assert [r["b"] for r in sorted((r for r in got if r["doc_id"] is not None), key=lambda r: r["doc_id"], reverse=True)] == sorted(r["b"] for r in got if r["doc_id"] is not None)
        assert all(r["b"] == max(x["b"] for x in got) for r in got if r["doc_id"] is None)


def quality_counts(text):
    words = WORDS.findall(text)
    lines = [x for x in text.split("\n") if WORDS.search(x)]
    windows = [tuple(words[k : k + 5]) for k in range(len(words) - 4)]
    covered = {j for k, w in enumerate(windows) if windows.count(w) > 1 for j in range(k, k + 5)} if len(words) < 1500 else None
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), covered and len(covered) or 0


def test_quality_counts_equal_brute_force(docs):
    m = quality_rules.measure(docs, "text", "m")
    got = rows_of(m.select("doc_id", "m.*"), "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    want = sorted([(i, *quality_counts(t)) for i, t in input_rows(docs)], key=repr)
    assert [g[:5] for g in got] == [w[:5] for w in want]
    assert [g for g in got if g[1] < 1500] == [w for w in want if w[1] < 1500]


def test_divergence_keeps_prose_and_refuses_junk(spark):
    rng = np.random.default_rng(3)
    rows = [(i, "en", " ".join(rng.choice("the of and to a in is that it river stone walks over green hills with light".split(), 120))) for i in range(60)]
    junk = [(100, "en", " ".join("".join(rng.choice(list("{}~^0193QXZ@"), 6)) for _ in range(120))), (101, "zz", "{}~^ " * 3 + " ".join("q" + str(i) for i in range(80)))]
    measured = quality_rules.measure(spark.createDataFrame(rows + junk, "doc_id long, lang string, text string"), "text", "m")
    refs = quality_rules.references(measured, "m", "lang")
    assert list(refs) == ["en"]
    kept = {r["doc_id"]: r["v"] for r in quality_rules.judge(measured, refs, "m", "lang", "v").collect()}
    assert not kept[100]["kept"] and not kept[100]["base_failed"] and kept[101]["kept"]
    assert sum(not kept[i]["base_failed"] and not kept[i]["kept"] for i in range(60)) == 0
    r = next(x for x in measured.collect() if x["doc_id"] == 100)["m"]
    p, q = np.array(r["chars"]) / sum(r["chars"]), np.array(refs["en"][0])
    mid = (p + q) / 2
    js = sum(x * math.log2(x / y) for v in (p, q) for x, y in zip(v, mid) if x) / 2
    assert kept[100]["char_distance"] == pytest.approx(math.sqrt(js))


def test_divergence_refuses_letter_junk_and_texts_without_common_words(spark):
    rng = np.random.default_rng(13)
    bank = "the of and to a in is that it river stone walks over green hills with light".split()
    clean = [(i, "en", " ".join(rng.choice(bank, 60 + 5 * i))) for i in range(60)]
    rare = [w for w in bank if w.encode() not in quality_rules.COMMON]
    plain = [(100 + i, "en", " ".join(f"{w}{'abcdefgh'[k]}" for w, k in zip(rng.choice(rare, n), rng.integers(0, 8, n)))) for i, n in enumerate((50, 90, 400))]
    letters = [(200 + i, "en", " ".join("".join(rng.choice(list("bcdfghjklmnpqrstvwxz"), 6)) for _ in range(n))) for i, n in enumerate((50, 90, 400))]
    marked = [(300 + i, "en", " ".join(x if k % 3 else "#$%|" for k, x in enumerate(rng.choice(bank, n)))) for i, n in enumerate((60, 200, 400))]
    measured = quality_rules.measure(spark.createDataFrame(clean + plain + letters + marked, "doc_id long, lang string, text string"), "text", "m")
    refs = quality_rules.references(measured.where("doc_id < 100"), "m", "lang")
    got = {r["doc_id"]: r["v"] for r in quality_rules.judge(measured, refs, "m", "lang", "v").collect()}
    assert not any(v["base_failed"] for v in got.values())
    assert [i for i, v in got.items() if v["kept"]] == list(range(60))


def brute_fingerprint(text, width):
    words = [w.encode().lower() for w in WORDS.findall(text)]
    grams = [b" ".join(words[k : k + width]) for k in range(len(words) - width + 1)] or ([b" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(n, linked):
    label = list(range(n))
    changed = True
    while changed:
        changed = False
        for a, b in linked:
            low = min(label[a], label[b])
            changed |= label[a] != low or label[b] != low
            label[a] = label[b] = low
    return label


def test_fingerprints_and_components(docs):
    given = input_rows(docs)
    fps = [brute_fingerprint(t, 3) for _, t in given]
    linked = [(a, b) for a in range(len(fps)) for b in range(a) if (fps[a] ^ fps[b]).bit_count() <= 2]
    label = brute_components(len(fps), linked)
    least = {}
    for (i, _), c in zip(given, label):
        if i is not None:
            least[c] = min(i, least.get(c, i))
    want = sorted(((i, f"{f:016x}", least.get(c)) for (i, _), f, c in zip(given, fps, label)), key=repr)
    got = simhash.linked_fingerprints(docs, "doc_id", "text", width=3, radius=2).select("doc", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("f"), "component_id")
    assert rows_of(got, "doc", "f", "component_id") == want


def group_of_each(n, pairs):
    parent = list(range(n))

    def root(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for x, y in pairs:
        x, y = sorted((root(x), root(y)))
        parent[y] = x
    return [root(x) for x in range(n)]


@pytest.fixture(scope="module")
def points():
    """Tight clusters, a dense ball of points that share most bits, and spread points."""
    rng = np.random.default_rng(9)
    bit = lambda n: np.uint64(1) << rng.integers(0, 64, n).astype(np.uint64)
    centres = rng.integers(0, 1 << 63, 40, dtype=np.uint64)
    close = [c ^ bit(60) for c in centres]
    dense = rng.integers(0, 1 << 12, 900, dtype=np.uint64) << np.uint64(20)
    return np.unique(np.concatenate([*close, dense, rng.integers(0, 1 << 63, 3000, dtype=np.uint64)]))


def test_trees_find_all_pairs(points, monkeypatch):
    monkeypatch.setattr(hamming, "BRUTE", 40)
    forest = hamming.Forest(len(points))
    hamming.search(points, np.arange(len(points)), np.zeros(0, np.int64), 2, forest)
    near = np.bitwise_count(points[:, None] ^ points[None, :]) <= 2
    a, b = np.nonzero(np.triu(near, 1))
    assert all(near[x, y] for x, y in forest.edges) and len(forest.edges) < len(points) < len(a)
    assert group_of_each(len(points), forest.edges) == group_of_each(len(points), zip(a.tolist(), b.tolist()))


@pytest.mark.parametrize("most, radius", [(8192, 2), (50, 2), (50, 1), (200, 3)])
def test_linked_points_equal_brute_force(spark, points, monkeypatch, most, radius):
    monkeypatch.setattr(simhash, "MOST_POINTS", most)
    df = spark.createDataFrame([(int(p),) for p in points.view(np.int64)], "fp long").repartition(5)
    edges = [(r["a"], r["b"]) for r in simhash.near_edges(df, radius).collect()]
    assert edges and len(edges) == len(set(edges))
    at = {int(p): i for i, p in enumerate(points.view(np.int64))}
    near = np.bitwise_count(points[:, None] ^ points[None, :]) <= radius
    assert all(near[at[a], at[b]] for a, b in edges)
    a, b = np.nonzero(np.triu(near, 1))
    assert group_of_each(len(points), [(at[x], at[y]) for x, y in edges]) == group_of_each(len(points), zip(a.tolist(), b.tolist()))


def test_groups_hold_three_rows_a_point_at_any_size(spark):
    for n in (2000, 10_000):
        df = spark.range(n).select(F.xxhash64("id").alias("fp"))
        rows, masks = simhash._finer(df.select(F.lit(0).cast("long").alias("group"), F.lit(0).alias("path"), "fp"), [(1 << 64) - 1], 3)
        assert rows.count() == 3 * n and len(masks) == 3


def test_masks_part_all_bits():
    for mask, parts in (((1 << 64) - 1, 3), (0b1011001, 4), (0, 3)):
        dealt = simhash.disjoint_masks(mask, parts)
        assert len(dealt) == parts and sum(dealt) == mask and all(a & b == 0 for i, a in enumerate(dealt) for b in dealt[:i])


def near_variant(text, radius=2):
    """Another text whose fingerprint is within the radius."""
    own = brute_fingerprint(text, 3)
    return next(t for t in (f"{text} tail{k}" for k in range(500)) if (brute_fingerprint(t, 3) ^ own).bit_count() <= radius)


def test_components_of_a_chain_and_a_star(spark):
    pairs = [(i, i + 1) for i in range(40)] + [(1000, 1000 + i) for i in range(1, 300)] + [(7, 7), (None, 3)]
    df = spark.createDataFrame(pairs, "a long, b long")
    got = {r["node"]: r["root"] for r in components.components(df, "a", "b").collect()}
    assert got == {i: 0 for i in range(1, 41)} | {1000 + i: 1000 for i in range(1, 300)}
    assert components.components(df.limit(0), "a", "b").count() == 0


def test_vectors_equal_brute_force(spark):
    rng = np.random.default_rng(2)
    centre = rng.standard_normal(16)
    rows = [(i, (centre + 0.02 * rng.standard_normal(16)).tolist()) for i in range(700)]
    rows += [(1000 + i, rng.standard_normal(16).tolist()) for i in range(300)]
    rows += [(2000 + i, [2.0] * 16) for i in range(30)]
    rows += [(3000, None), (3001, []), (3002, [0.0] * 16), (3003, [1.0] * 15 + [None]), (3004, [1.0] * 15 + [float("nan")]), (3005, [2.0] * 8), (None, [2.0] * 16)]
    good = [(i, np.array(v, float)) for i, v in rows if i is not None and i < 3000]
    x = np.stack([v / np.linalg.norm(v) for _, v in good])
    near = x @ x.T >= 0.9
    label = brute_components(len(good), list(zip(*np.nonzero(np.triu(near, 1)))))
    want = [(i, int(near[k].sum()) - 1, good[label[k]][0], good[label[k]][0] == i) for k, (i, _) in enumerate(good)]
    want += [(i, 0, i, True) for i in range(3000, 3006)] + [(None, 0, None, True)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("node", F.lit(1)).repartition(3)
    got = rows_of(embedding_dedup.linked_vectors(df, "vec_id", "embedding"), "vec_id", "n_links", "component_id", "kept")
    assert got == sorted(want, key=repr)


def test_recall_at_the_threshold():
    bits, tables = embedding_dedup.table_shape(50_000)
    rng = np.random.default_rng(4)
    a, b = rng.standard_normal((2, 2000, 64))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    b -= (b * a).sum(axis=1, keepdims=True) * a
    b /= np.linalg.norm(b, axis=1, keepdims=True)
    mate = 0.9 * a + math.sqrt(1 - 0.81) * b
    met = (embedding_dedup.signatures(a, bits, tables) == embedding_dedup.signatures(mate, bits, tables)).any(axis=1)
    assert met.mean() > 0.95


def test_token_counts_equal_the_library(docs):
    model = sentencepiece.SentencePieceProcessor(model_file=PIECE_MODEL)
    extra = ["a  b   c", " x ", "▁▁ y▁z", "{\r\n\t};\r", "foo" * 500, "    indented\n\n        code();", "9" * 50, "ﬁ ½ 漢字かな 한국", "    ", "a" * 9 + " " * 70]
    assert all(token_counts.merger(PIECE_MODEL).count(t) == len(model.encode(t)) for t in extra)
    counted = token_counts.count_tokens(docs, "text", "c", PIECE_MODEL).select("doc_id", "c.*")
    want = sorted(((i, len(t.encode()), len(model.encode(t))) for i, t in input_rows(docs)), key=repr)
    assert rows_of(counted, "doc_id", "n_bytes", "n_tokens") == want


def test_viterbi_equals_brute_force():
    own = unigram.unigram(PIECE_MODEL)
    texts = own.trie

    def best(unit):
        score = [0.0] + [None] * len(unit)
        for e in range(1, len(unit) + 1):
            for s in range(e):
                piece = unit[s:e]
                if score[s] is None:
                    continue
                found = next((v for end, v in texts.prefixes(piece, 0) if end == len(piece)), None)
                gain = own.score[found] if found is not None else own.unknown if len(piece.decode(errors="replace")) == 1 and piece.decode(errors="replace") != "\ufffd" else None
                if gain is not None and (score[e] is None or score[s] + gain > score[e]):
                    score[e] = score[s] + gain
        return score[-1]

    for word in ["the", "extraordinary", "été", "naïve,", "🙂x", "thothing"]:
        unit = ("▁" + word).encode()
        score, ids = own.viterbi(unit)
        assert score == best(unit)
        assert own.decode(np.array(ids)) == word.encode()


def test_pieces_round_trip(docs):
    encoded = unigram.encode(docs, "text", "e", PIECE_MODEL).select("doc_id", "text", "e.*")
    back = unigram.decode(encoded, "ids", "d", PIECE_MODEL).collect()
    assert len(back) == docs.count()
    assert all(r["d"]["text"] == (r["text"] or "") and r["n_pieces"] * 4 == len(r["ids"]) for r in back)


def test_packed_ids_equal_the_library(docs):
    tokenizer = Tokenizer.from_file(WORD_MODEL)
    want = {}
    for i, t in input_rows(docs):
        want.setdefault(i, []).append(tokenizer.encode(t, add_special_tokens=False).ids + [1])
    pieces = packing.pack(docs, "doc_id", "text", WORD_MODEL).collect()
    assert len({p["sequence_id"] for p in pieces}) == len(pieces)
    got = {}
    for p in sorted(pieces, key=lambda p: (repr(p["doc_id"]), p["sequence_id"])):
        ids = np.frombuffer(p["ids"], "<u4").tolist()
        assert len(ids) == p["length"] <= 2048 and p["length"] & (p["length"] - 1) == 0 and p["offset"] == 0
        if p["start"] == 0:
            got.setdefault(p["doc_id"], []).append([])
        assert len(got[p["doc_id"]][-1]) == p["start"]
        got[p["doc_id"]][-1] += ids
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items()}


def test_binary_lengths():
    for n in [1, 2, 3, 2047, 2048, 2049, 10_000]:
        sizes = packing.binary_lengths(n)
        assert sum(sizes) == n and sizes == sorted(sizes, reverse=True) and all(s & (s - 1) == 0 for s in sizes)
    assert len(set(packing.binary_lengths(2047))) == 11


def test_words_are_looked_up_once_and_ascii_ones_skip_the_steps_before_the_model(monkeypatch):
    monkeypatch.setattr(packing, "MEMO_BYTES", 3000)
    whole = packing.Tokenizer.from_file(WORD_MODEL)
    blocks = [
        [b"", b"A cat, a cat. the cat's", "Größe ß eauch%%% \u0130stanbul 16.155".encode(), b"x" * 300 + b" cat " + b"y" * 300 + b","],
        [b"cat <|endoftext|> Cat. <| CAT", b"  tab\tand\x0bline\n", "ﬁx é e\u0301 日本".encode()],
        [" ".join(f"w{i} word{i % 7} {'abcdefg'[i % 7] * i}" for i in range(60)).encode()],
    ]
    words, met = packing.WordIds(WORD_MODEL), []
    ids = words._ids
    monkeypatch.setattr(words, "_ids", lambda text: met.append(text) or ids(text))
    for block in blocks * 3:
        want = [np.array(whole.encode(t.decode(), add_special_tokens=False).ids, "<u4").tobytes() for t in block]
        assert words.encode(block) == want
    assert words.old and words.held < 3000 + 60 * 3 * 300
    assert not any("abab" in t or t == "cat" for t in met) and not any(t.startswith("cat ") for t in met)


def test_url_rules_and_parts(spark):
    urls = [None, "", "no scheme", "HTTP://WWW.Example.ORG/es/x?y", "http://example.org/en/12", "http://a.org", "x://b.com/fr/?a://c", "http://com/de/", "http://notexample.org/es/", "http://ÉA.com#f/", "ftp://h?q"]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").withColumn("host", F.lit("clash"))
    model = url_filters.train(url_filters.labelled_urls(spark))
    got = {r["page_id"]: r for r in url_filters.judge(df, "page_id", "url", RULES, model).collect()}
    assert [(got[i]["host"], got[i]["path"]) for i in range(len(urls))] == [
        ("", ""), ("", ""), ("", ""), ("www.example.org", "/es/x"), ("example.org", "/en/12"), ("a.org", ""), ("b.com", "/fr/"), ("com", "/de/"),
        ("notexample.org", "/es/"), ("Éa.com", ""), ("h", ""),
    ]
    assert [got[i]["rule"] for i in range(len(urls))] == [None, None, None, "example.org/es/", "example.org/en/1", None, "com/fr/", "com/de/", "org/", None, None]
    assert [got[i]["verdict"] for i in (0, 1, 2, 3, 4, 6, 7, 8)] == ["allow", "allow", "allow", "block", "block", "allow", "block", "allow"]


def test_joined_rules_equal_compiled_ones(spark):
    urls = [None, "", "no scheme", "HTTP://WWW.Example.ORG/es/x?y", "http://example.org/en/12", "http://a.org", "x://b.com/fr/?a://c", "http://com/de/", "http://notexample.org/es/", "http://ÉA.com#f/", "ftp://h?q", "ftp://h?q", "http://end.org./x", "http://a..com/fr/", "http:///fr/", "http://x.com/" + "é/" * 5000]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").withColumn("host", F.lit("clash")).withColumn("rule", F.lit(1))
    model = url_filters.train(url_filters.labelled_urls(spark))
    rules = [*RULES, url_filters.Rule("", "", "block"), url_filters.Rule("", "/x", "allow"), url_filters.Rule("b.com", "", "allow"), url_filters.Rule("com", "/é", "block"), url_filters.Rule("com", "/é", "allow"), url_filters.Rule("x.com", "/" + "é/" * 4000, "allow")]
    want = rows_of(url_filters.judge(df, "page_id", "url", rules, model), "page_id", "host", "path", "rule", "verdict")
    table = url_filters.rule_table(spark, rules)
    assert rows_of(url_filters.judge(df, "page_id", "url", table, model), "page_id", "host", "path", "rule", "verdict") == want
    assert {r[3] for r in want} >= {"example.org/es/", "org/", "com/fr/", "", None}
    gaps = spark.createDataFrame([(None, "/", "block"), ("org", None, "block"), ("org", "/", None)], "host string, path string, verdict string")
    assert {r["rule"] for r in url_filters.judge(df, "page_id", "url", gaps, model).collect()} == {None}


def test_ties_of_a_rule_table(spark):
    df = spark.createDataFrame([(1, "http://b.com/xy"), (2, "http://org/")], "page_id long, url string")
    table = spark.createDataFrame([("com", "/xy", "block"), ("b.com", "/", "allow"), ("org", "/", "allow"), ("org", "/", "block")], "host string, path string, verdict string")
    got = url_filters.judge(df, "page_id", "url", table, url_filters.train(url_filters.labelled_urls(spark))).orderBy("page_id").collect()
    assert [(r["rule"], r["verdict"]) for r in got] == [("b.com/", "allow"), ("org/", "block")]


def test_a_long_rule_table_is_joined(spark):
    """200,000 rules of one hot host and of many hosts; a url meets one rule for each suffix and length."""
    ids = spark.range(100_000)
    rules = ids.select(F.concat(F.lit("h"), "id", F.lit(".net")).alias("host"), F.lit("/").alias("path"), F.lit("block").alias("verdict")).unionByName(
        ids.select(F.lit("net").alias("host"), F.concat(F.lit("/p"), F.lpad(F.col("id").cast("string"), 6, "0")).alias("path"), F.lit("allow").alias("verdict"))
    )
    df = spark.range(2000).select(F.col("id").alias("page_id"), F.concat(F.lit("http://a.h"), F.col("id") * 50, F.lit(".net/p"), F.lpad(F.col("id").cast("string"), 6, "0")).alias("url"))
    got = url_filters.judge(df, "page_id", "url", rules, url_filters.train(url_filters.labelled_urls(spark)))
    own, shared = [f"h{i * 50}.net/" for i in range(2000)], [f"net/p{i:06d}" for i in range(2000)]
    want = [(i, a if len(a) >= len(b) else b, "block" if len(a) >= len(b) else "allow") for i, (a, b) in enumerate(zip(own, shared))]
    assert rows_of(got, "page_id", "rule", "verdict") == sorted(want, key=repr)


def test_url_model_on_held_out_urls(spark):
    bad = ["https://adult-video-chat.test/en/5", "http://cheap-viagra-pills.test/fr/2", "https://royal-casino.test/en/9.html", "http://poker-bets.test/es/1"]
    fine = ["https://thinking.test/en/5", "http://blog.station.test/fr/2", "https://m.history-books.test/en/9.html", "http://physics.test/es/1"]
    df = spark.createDataFrame(list(enumerate(bad + fine)), "page_id long, url string")
    got = url_filters.judge(df, "page_id", "url", [], url_filters.train(url_filters.labelled_urls(spark))).orderBy("page_id").collect()
    assert [r["verdict"] for r in got] == ["block"] * 4 + ["allow"] * 4


def fold_one_by_one(log):
    """(role, text) of the turns left, event after event."""
    turns = {}
    for seq, turn, kind, role, text in sorted((-(2**63) if s is None else s, -(2**63) if t is None else t, k or "", r or "", x or "") for s, t, k, r, x in log):
        if kind == "start":
            turns[turn] = [role, text]
        elif kind == "delta" and turn in turns:
            turns[turn][1] += text
        elif kind in ("edit", "regenerate"):
            turns = {t: v for t, v in turns.items() if t <= turn}
            if turn in turns:
                turns[turn][1] = text if kind == "edit" else ""
    return [tuple(turns[t]) for t in sorted(turns)]


def conversations_of(events):
    """Per conversation: its formatted text, its loss spans, and the starts of its pieces."""
    out = {}
    for r in sorted(chat_formatting.format_turns(events).collect(), key=lambda r: (r["turn"] is not None, r["turn"])):
        text, spans = out.setdefault(r["conv"], ["", []])
        assert r["start"] == len(text)
        out[r["conv"]][0] += r["piece"]
        if r["loss_start"] is not None:
            spans.append((r["loss_start"], r["loss_end"]))
    return out


def test_events_equal_a_fold_one_by_one(spark):
    rng = np.random.default_rng(51)
    kinds, bits = ["start", "delta", "delta", "edit", "regenerate", "note", None], [None, "", "a", "</s>", "<|im_end|>\n", "🙂", "z" * 5000]
    roles = ["user", "assistant", None, "a\\\nb"]

    def maybe(n):
        return None if rng.random() < 0.05 else int(rng.integers(0, n))

    rows = [
        (None if c == 0 else c, maybe(30), kinds[rng.integers(0, 7)], maybe(6), roles[rng.integers(0, 4)], bits[rng.integers(0, 7)])
        for c in range(40)
        for _ in range(int(rng.integers(1, 25)))
    ]
    rows += [(99, i, k, i // 4, "assistant", f"w{i} ") for i in range(2000) for k in [("start", "delta", "delta", "regenerate" if i % 40 == 3 else "delta")[i % 4]]]
    rows += [r for r in rows[:30]]
    events = spark.createDataFrame(rows, chat_formatting.EVENTS).withColumn("range", F.lit(1)).withColumn("start", F.lit("x"))
    got, read = conversations_of(events), {r["conv"]: r for r in chat_formatting.read_back(chat_formatting.format_turns(events)).collect()}
    logs = {}
    for conv, seq, kind, turn, role, text in rows:
        logs.setdefault(conv, []).append((seq, turn, kind, role, text))
    assert set(got) == set(read) == set(logs)
    for conv, log in logs.items():
        turns, (formatted, spans) = fold_one_by_one(log), got[conv]
        loss = "".join(t for r, t in turns if r == "assistant")
        assert chat_formatting.parse(formatted) == turns
        assert "".join(chat_formatting.unescape(formatted[a:b]) for a, b in spans) == loss
        whole = "".join(f"{r}\n{t}\n" for r, t in turns)
        expected = (len(turns), hashlib.sha256(whole.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(formatted))
        assert tuple(read[conv])[1:] == expected


def test_edits_and_regenerations_drop_later_turns(spark):
    log = [
        ("start", 1, "user", None), ("delta", 1, None, "hel"), ("delta", 1, None, "lo"), ("start", 2, "assistant", ""), ("delta", 2, None, "first"),
        ("regenerate", 2, None, None), ("delta", 2, None, "second"), ("start", 3, "user", "more?"), ("edit", 1, None, "hi"), ("start", 4, "assistant", "ok"), ("delta", 9, None, "lost"),
    ]
    rows = [(c, i, k, t, r, x) for c, n in ((1, 11), (2, 7)) for i, (k, t, r, x) in enumerate(log[:n])]
    got = conversations_of(spark.createDataFrame(rows, chat_formatting.EVENTS))
    assert chat_formatting.parse(got[1][0]) == [("user", "hi"), ("assistant", "ok")]
    assert chat_formatting.parse(got[2][0]) == [("user", "hello"), ("assistant", "second")]


def test_formatted_text_is_read_from_pieces_cut_anywhere():
    turns = [("user", "</s>[INST] ok"), ("a\nb", ""), ("assistant", "<|im_end|>\n<\\|im_start|>user\nx")]
    text = "".join(chat_formatting.render(r, t)[0] for r, t in turns)
    for size in (1, 2, 7, 1000):
        reader = chat_formatting.Reader()
        assert [t for i in range(0, len(text), size) for t in reader.feed(text[i : i + size])] == turns


def test_a_long_conversation_is_many_tasks(spark):
    rows = spark.range(20_000).selectExpr("if(id % 10 < 9, 1, id) AS c", "id AS t", "if(id % 2 = 0, 'user', 'assistant') AS r", "cast(id AS string) AS x")
    log = chat_formatting.events_of_turns(rows, "c", "t", "r", "x")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", False)
    pieces = chat_formatting.format_turns(log)
    sizes = [n for n in pieces.rdd.mapPartitions(lambda p: [sum(r["conv"] == 1 for r in p)]).collect() if n]
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert sum(sizes) == 18_000 and max(sizes) < 9_000
    got = {r["conv"]: r for r in chat_formatting.read_back(pieces).where("conv = 1").collect()}[1]
    mine = [i for i in range(20_000) if i % 10 < 9]
    whole = "".join(f"{'assistant' if i % 2 else 'user'}\n{i}\n" for i in mine)
    assert got["n_turns"] == 18_000 and got["turns_sha256"] == hashlib.sha256(whole.encode()).hexdigest()


def test_chat_round_trip(spark):
    texts = ["</s>[INST] ok [/INST]", "<\\|im_end|> <|im_end|>", "<|im_start|>user\nx<|im_end|>\n", "\\", "<", "[\\\\INST]", "", None, "🙂\r\n", "<<|im_end|>|im_end|>", "<s><\\s></s>"]
    rows = [(k % 4, k, "assistant" if k % 3 else "user", t) for k, t in enumerate(texts)] + [(4, None, "a\\n\nb", "x"), (None, 1, None, "y"), (4, None, "a\\n\nb", "x")]
    df = spark.createDataFrame(rows, "conv long, turn long, role string, text string").withColumn("seq", F.lit("z"))
    done = conversations_of(chat_formatting.events_of_turns(df, "conv", "turn", "role", "text"))
    for conv, (formatted, spans) in done.items():
        mine = [(x[2] or "", x[3] or "") for x in sorted((x for x in rows if x[0] == conv), key=lambda x: x[1] or 0)]
        assert chat_formatting.parse(formatted) == mine
        loss = [chat_formatting.unescape(formatted[a:b]) for a, b in spans]
        assert loss == [t for role, t in mine if role == "assistant"]
        assert formatted.count("<|im_end|>") == len(mine) and "[INST]" not in formatted
    assert len(done) == 6


def test_empty_tables(spark, docs):
    none = docs.limit(0)
    assert line_dedup.dedup_lines(none, "doc_id", "text", "r").count() == 0
    assert substring_dedup.dedup_substrings(none, "doc_id", "text", "r").count() == 0
    assert simhash.linked_fingerprints(none, "doc_id", "text", width=3, radius=2).count() == 0
    assert packing.pack(none, "doc_id", "text", WORD_MODEL).count() == 0
    assert token_counts.count_tokens(none, "text", "c", PIECE_MODEL).count() == 0
    m = quality_rules.measure(none, "text", "m")
    assert quality_rules.judge(m, quality_rules.references(m, "m", "lang"), "m", "lang", "v").count() == 0
    assert embedding_dedup.linked_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>"), "vec_id", "embedding").count() == 0
    assert chat_formatting.read_back(chat_formatting.format_turns(spark.createDataFrame([], chat_formatting.EVENTS))).count() == 0
    model = url_filters.train(url_filters.labelled_urls(spark))
    assert url_filters.judge(spark.createDataFrame([], "page_id long, url string"), "page_id", "url", RULES, model).count() == 0


def test_pipeline_on_planted_documents(spark, tmp_path):
    import corpus_pipeline

    rng = np.random.default_rng(6)
    bank = "the of and to a in is that it river stone walks over green hills with light".split()
    clean = [" ".join(f"{a}{b}" if b > 5 else a for a, b in zip(rng.choice(bank, 200), rng.integers(0, 30, 200))) for _ in range(40)]
    passage = " ".join(f"shared{i}" for i in rng.integers(0, 999, 60))
    rows = [(i, t, "en", "s", len(t)) for i, t in enumerate(clean)]
    rows += [(100, clean[2], "en", "s", 1), (101, near_variant(clean[3]), "en", "s", 1), (102, None, "en", "s", 0), (103, "short", None, None, None)]
    rows += [(200 + i, f"{clean[10 + i][:500]}x {passage} {clean[20 + i][:500]}x", "en", "s", 1) for i in range(3)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    left = docs
    for name, stage in corpus_pipeline.STAGES[:4]:
        left = stage(spark, left, str(tmp_path))
        assert left.columns == docs.columns
    texts = {r["doc_id"]: r["text"] for r in left.collect()}
    assert set(texts) == set(range(40)) | {200, 201, 202}
    assert not any("shared1 " in t and passage in t for t in texts.values())
    pieces = corpus_pipeline.run(spark, str(tmp_path))
    assert {r["doc_id"] for r in pieces.select("doc_id").distinct().collect()} == set(texts)


def test_one_row_of_each_group_without_ids_stays(spark):
    import corpus_pipeline

    rng = np.random.default_rng(41)
    near, lone, two = (prose(rng, 200) for _ in range(3))
    rows = [(1, near), (None, near_variant(near)), (None, lone), (None, near_variant(lone)), (7, two), (7, near_variant(two)), (7, prose(rng, 200))]
    left = corpus_pipeline.near_copies(spark, spark.createDataFrame(rows, "doc_id long, text string"), "").collect()
    assert sorted(r["doc_id"] or 0 for r in left) == [0, 1, 7, 7]
    assert next(r["text"] for r in left if r["doc_id"] is None).startswith(lone)


def test_a_thousand_rows_without_id(spark):
    rng = np.random.default_rng(42)
    texts = [prose(rng, 60) for _ in range(100)]
    rows = [(None, texts[i % 100]) for i in range(1000)]
    linked = simhash.linked_fingerprints(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id", "text", width=3, radius=2)
    assert linked.count() == 1000
    assert {r["component_id"] for r in linked.collect()} == {None}


def test_texts_of_one_id_with_equal_short_hashes(spark):
    passage = " ".join(f"p{i}" for i in range(40))
    numbers = spark.range(200_000).selectExpr("CAST(id AS string) AS n")
    long = numbers.selectExpr(f"concat(n, ' {passage}') AS text").selectExpr("text AS long", "hash(text) AS h")
    short = numbers.selectExpr("concat(n, ' short') AS text").selectExpr("text AS short", "hash(text) AS h")
    pair = long.join(short, "h").orderBy("long").first()
    df = spark.createDataFrame([(None, pair["long"]), (None, pair["short"]), (9, passage)], "doc_id long, text string")
    got = {r["text"]: r["r"]["n_removed"] for r in substring_dedup.dedup_substrings(df, "doc_id", "text", "r").collect()}
    assert got == {pair["long"]: 40, pair["short"]: 0, passage: 40}
