import gzip
import hashlib
import io
import random

import pytest
from pyspark.sql import functions as F

from detlens.llm import warc as W


@pytest.fixture(scope="module")
def members():
    rng = random.Random(0)
    payloads = [bytes(rng.randrange(256) for _ in range(rng.randrange(0, 3000))) for _ in range(12)]
    return [(p, W.record(i, f"http://h/{i}", p, None, False)) for i, p in enumerate(payloads)]


def salvage(data):
    return list(W.salvage(W._Source(io.BytesIO(data), len(data))))


def ids(found):
    return [r["page_id"] for *_, r in found if r]


def test_reads_what_it_writes(members):
    found = salvage(b"".join(W.gzip_member(r) for _, r in members))
    assert ids(found) == list(range(12)) and not any(e for _, _, e, _ in found)
    assert [r["payload"] for *_, r in found] == [p for p, _ in members]


@pytest.mark.parametrize("form", ["members", "plain", "one member", "several records a member"])
def test_forms(members, form):
    raw = [r for _, r in members]
    data = {"members": b"".join(map(W.gzip_member, raw)), "plain": b"".join(raw), "one member": gzip.compress(b"".join(raw)),
            "several records a member": b"".join(gzip.compress(raw[i] + raw[i + 1]) for i in range(0, 12, 2))}[form]
    assert ids(salvage(data)) == list(range(12))


@pytest.mark.parametrize("plain", [False, True])
def test_damage_costs_only_the_damaged_records(members, plain):
    rng = random.Random(9)
    parts = [r if plain else W.gzip_member(r) for _, r in members]
    starts = [sum(map(len, parts[:i])) for i in range(13)]
    for _ in range(40):
        data, hurt = bytearray(b"".join(parts)), set()
        for _ in range(2):
            at = rng.randrange(len(data))
            data[at] ^= 1 + rng.randrange(255)
            hurt.add(max(i for i in range(12) if starts[i] <= at))
        found = salvage(bytes(data))
        kept = set(ids(found))
        assert set(range(12)) - hurt <= kept
        for offset, length, error, _ in found:  # gaps lie within damaged records
            if error:
                assert all(i in hurt for i in range(12) if starts[i] < offset + length and offset < starts[i + 1])


@pytest.mark.parametrize("plain", [False, True])
def test_missing_and_foreign_bytes(members, plain):
    parts = [r if plain else W.gzip_member(r) for _, r in members]
    junk = b"\x1f\x8b\x08 WARC/1.0 nonsense \x1f\x8b\x08\x00"
    data = junk + parts[0] + parts[1][: len(parts[1]) // 2] + parts[2] + junk * 3 + b"".join(parts[3:]) + parts[4][:-5]
    found = salvage(data)
    assert ids(found) == [0, 2, *range(3, 12)]
    gaps = [(o, n) for o, n, e, _ in found if e]
    assert gaps[0] == (0, len(junk)) and sum(n for _, n in gaps) == 4 * len(junk) + len(parts[1]) // 2 + len(parts[4]) - 5


def test_wrong_digest_is_quarantined(members):
    bad = members[3][1].replace(b"sha1:", b"sha1:A", 1)
    found = salvage(W.gzip_member(members[0][1]) + W.gzip_member(bad) + W.gzip_member(members[5][1]))
    assert ids(found) == [0, 5] and [e for _, _, e, _ in found if e] == ["payload digest"]
    assert salvage(b"") == []


PAGES = [(5, "http://a/\r\nX: y", "same"), (3, "http://b", "same"), (9, None, "same"), (1, "u", None), (2, "u", ""), (None, "v", "same"),
         (None, "v", "alone"), (7, "ü", "é" * 100_000), (8, "w", "once"), (8, "w", "once")]


def through(spark, tmp_path, rows, **kw):
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    manifest = W.write(pages, f"file://{tmp_path}/w", **kw)
    return W.read(manifest, manifest.count())


def test_pages_through_spark(spark, tmp_path):
    found = through(spark, tmp_path, PAGES, file_bytes=200)
    rows = found.collect()
    assert len(rows) == len(PAGES) and not any(r.error for r in rows)
    by = {r.page_id: r for r in rows if r.page_id is not None}
    assert (by[3].record_type, by[5].record_type, by[5].refers_to, by[9].refers_to) == ("response", "revisit", 3, 3)
    assert (by[1].record_type, by[2].record_type, by[2].refers_to, by[1].payload_bytes) == ("response", "revisit", 1, 0)
    assert by[5].payload_digest == by[3].payload_digest == W.digest(b"same") and by[5].payload_bytes == 4
    assert by[7].payload == ("é" * 100_000).encode() and by[7].url == "ü" and by[9].url is None
    assert [r.record_type for r in rows if r.page_id == 8] == ["response"] * 2
    assert sorted(r.record_type for r in rows if r.page_id is None) == ["response", "revisit"]
    assert len({r.path for r in rows}) > 3


def test_smaller_payloads_are_all_responses(spark, tmp_path):
    rows = through(spark, tmp_path, PAGES, min_bytes=5).collect()
    assert all(r.record_type == "response" for r in rows if r.payload_bytes < 5)


def test_damaged_file_through_spark(spark, tmp_path):
    found = through(spark, tmp_path, [(i, "u", f"p{i}" * 50) for i in range(30)])
    path = found.select("path").first().path.removeprefix("file://")
    data = bytearray(open(path, "rb").read())
    for k in range(20):  # a gzip header alone has bytes that don't matter
        data[len(data) // 2 + k] ^= 255
    open(path, "wb").write(bytes(data))
    rows = found.collect()
    assert len({r.page_id for r in rows if not r.error}) in (28, 29) and sum(r.length for r in rows if r.error) > 0


def test_empty_table(spark, tmp_path):
    assert through(spark, tmp_path, []).collect() == []


def test_query(spark, sf_dir):
    got = {r.page_id: r for r in W.op3_warc_salvage(spark, sf_dir).collect()}
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", F.coalesce("html", F.lit("")).alias("h")).collect()
    first = {}
    for p in sorted(pages):
        first.setdefault(p.h, p.page_id)
    for p in pages:
        r, raw = got[p.page_id], p.h.encode()
        assert (r.payload_bytes, r.payload_digest) == (len(raw), W.digest(raw)) and len(hashlib.sha1(raw).digest()) == 20
        assert (r.record_type, r.refers_to) == (("response", None) if first[p.h] == p.page_id else ("revisit", first[p.h]))


@pytest.mark.parametrize("plain", [False, True])
def test_long_url(plain):
    raw = [W.record(i, "data:" + "x" * n, b"payload", None, False) for i, n in enumerate((10, 65_000, 70_000, 600_000))]
    found = salvage(b"".join(raw if plain else map(W.gzip_member, raw)))
    assert ids(found) == [0, 1, 2, 3] and [len(r["url"]) for *_, r in found] == [15, 65_005, 70_005, 600_005]


def test_damage_inside_a_member_costs_only_the_damaged_records(members):
    raw = [r for _, r in members]
    raw[3] = raw[3].replace(b"sha1:", b"sha1:A", 1)
    raw[7] = raw[7].replace(b"Content-Length:", b"Content-Width:")
    found = salvage(gzip.compress(b"".join(raw[:6])) + gzip.compress(b"".join(raw[6:])))
    assert ids(found) == [0, 1, 2, 4, 5, 6, 8, 9, 10, 11]
    assert [e for _, _, e, _ in found if e] == ["payload digest", "no content length"]


def test_records_before_the_damage_of_a_member_are_kept(members):
    raw = [r for _, r in members]
    whole = gzip.compress(b"".join(raw))
    found = salvage(whole[: len(whole) * 2 // 3] + W.gzip_member(raw[11]))
    assert set(range(6)) <= set(ids(found)) and ids(found)[-1] == 11
    assert sum(bool(e) for _, _, e, _ in found) == 1
