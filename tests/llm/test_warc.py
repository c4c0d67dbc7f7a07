"""WARC round trips: payloads, revisits, members, offsets, and broken or odd archives."""

import base64
import gzip
import hashlib
import random

import pytest

from lanternpost.llm import warc

SCHEMA = "page_id long, url string, html string, sha string, size string, kept string"


def pages(spark, rows, parts=3):
    return spark.createDataFrame([(*r, "x", "y", "z") for r in rows], SCHEMA).repartition(parts)


def archived(spark, tmp_path, rows, **kw):
    warc.write_archives(pages(spark, rows), "page_id", "url", "html", f"{tmp_path}/mono", **kw)
    manifest = warc.normalise(spark, f"{tmp_path}/mono", f"{tmp_path}/members")
    return manifest, warc.read_records(spark, f"{tmp_path}/members")


def digest(text):
    return base64.b32encode(hashlib.sha1((text or "").encode()).digest()).decode()


ODD = [None, "", "a", "\r\n\r\n", "WARC/1.1\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n", "\n" * 50, "no end\r", "Ünï ▁ 🙂\x00\x1f", "ends\n", "x" * 3_000_000]


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(4)
    out = [(i, f"https://a.example/{i}?q=é", t) for i, t in enumerate(ODD)]
    out += [(100 + i, None if i % 5 == 0 else f"http://h/{i}\r\nX: y", "".join(rng.choices("ab \r\n<>é", k=rng.randrange(400)))) for i in range(150)]
    out += [(1000 + i, "http://copy/", "one copied page") for i in range(300)] + [(None, "http://noid/", "one copied page"), (None, None, "only without id"), (None, None, "only without id")]
    return out + [(9000, "u", "twice"), (9000, "v", "twice"), (8999, "w", "twice")]


def test_rows_equal_brute_force(spark, tmp_path, rows):
    _, read = archived(spark, tmp_path, rows)
    kept = {}
    for i, _, t in rows:
        if i is not None:
            kept[t or ""] = max(kept.get(t or "", i), i)
    want = sorted(
        (str(i or 0) if i is not None else "", *((("response", None, t or "")) if i == kept.get(t or "") or t == "only without id" else ("revisit", str(kept[t or ""]), None)), digest(t), len((t or "").encode()))
        for i, _, t in rows
    )
    got = read.collect()
    assert sorted(map(repr, want)) == sorted(repr((r["record_id"], r["record_type"], r["refers_to"], None if r["payload"] is None else bytes(r["payload"]).decode(), r["payload_digest"], r["payload_bytes"])) for r in got)
    assert {r["target"] for r in got} >= {"https://a.example/0?q=é", "http://h/1  X: y", ""}


def test_every_record_is_one_member_at_its_offset(spark, tmp_path, rows):
    manifest, read = archived(spark, tmp_path, rows)
    listed = {r["archive"]: r for r in manifest.collect()}
    assert sum(r["n_records"] for r in listed.values()) == len(rows)
    mono = b"".join(sorted(gzip.decompress(p.read_bytes()) for p in (tmp_path / "mono").glob("*.gz")))
    whole = b"".join(sorted(gzip.decompress((tmp_path / "members" / name).read_bytes()) for name in listed))
    assert mono == whole
    for r in read.select("archive", "offset", "length").collect():
        data = (tmp_path / "members" / r["archive"]).read_bytes()[r["offset"] : r["offset"] + r["length"]]
        record = gzip.decompress(data)
        assert record.startswith(b"WARC/1.1\r\n") and record.endswith(b"\r\n\r\n")


def test_small_payloads_are_not_revisits(spark, tmp_path):
    _, read = archived(spark, tmp_path, [(1, "u", "abc"), (2, "u", "abc"), (3, "u", "abcd"), (4, "u", "abcd")], min_bytes=4)
    assert sorted((r["record_id"], r["record_type"]) for r in read.collect()) == [("1", "response"), ("2", "response"), ("3", "revisit"), ("4", "response")]


def test_files_of_a_lost_attempt_do_not_count(spark, tmp_path):
    _, read = archived(spark, tmp_path, [(i, "u", str(i)) for i in range(9)])
    orphan = warc.MemberWriter(f"{tmp_path}/members", "lost.gz")
    orphan.add(b"WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 0\r\n\r\n", b"x")
    orphan.close()
    assert warc.read_records(spark, f"{tmp_path}/members").count() == 9 == read.count()


def test_foreign_archives(spark, tmp_path):
    """Other record types, a plain file, many members, lower-case fields, no closing blank lines."""
    info = b"WARC/1.0\r\nWARC-Type: warcinfo\r\ncontent-length: 5\r\n\r\nab\ncd\r\n\r\n"
    page = b"WARC/1.0\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:uuid:1>\r\nContent-Length: 4\r\n\r\nbody"
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.warc").write_bytes(info + page)
    (tmp_path / "in" / "b.warc.gz").write_bytes(gzip.compress(info) + gzip.compress(page + b"\r\n\r\n"))
    (tmp_path / "in" / "empty.warc.gz").write_bytes(gzip.compress(b""))
    warc.normalise(spark, f"{tmp_path}/in", f"{tmp_path}/out")
    got = sorted((r["record_type"], bytes(r["payload"]), r["record_id"]) for r in warc.read_records(spark, f"{tmp_path}/out").collect())
    assert got == [("resource", b"body", "urn:uuid:1")] * 2 + [("warcinfo", b"ab\ncd", None)] * 2


@pytest.mark.parametrize("text", [b"WARC/1.0\r\nContent-Length: 9\r\n\r\nshort", b"WARC/1.0\r\nContent-Length: 1\r\n\r\nlong\r\n\r\n", b"hello\r\n\r\n", b"WARC/1.0\r\nContent-"])
def test_broken_archives_fail(text):
    fold = warc.RecordFold()
    with pytest.raises(ValueError):
        list(fold.records(text.split(b"\n")))
        list(fold.last())


def test_blocks_may_end_anywhere():
    record = b"WARC/1.0\r\nContent-Length: 7\r\n\r\na\nb\r\n\r\n\r\n\r\n"
    lines = (record * 3).split(b"\n")[:-1]
    for size in (1, 2, 3, 5, 100):
        fold, got = warc.RecordFold(), []
        for at in range(0, len(lines), size):
            got += [r for _, r in fold.records(lines[at : at + size])]
        assert got == [record] * 3 and not list(fold.last())


def test_empty_table(spark, tmp_path):
    manifest, read = archived(spark, tmp_path, [])
    assert manifest.count() == 0 and read.count() == 0
