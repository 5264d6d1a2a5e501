"""WARC archives and sharding."""

import gzip
import hashlib
import zlib
from pathlib import Path

import duckdb
import pytest

from drawlens.llm import sharding, warc
from drawlens.llm.queries import oracle_sql, queries

SF = "/root/testdata/sf0.001"
PAGES = "page_id bigint, url string, html string, capture string, n int"


def test_warc_round_trip(spark):
    long = "x" * 1200 + "é"
    rows = [(1, "http://a b/\r\n", long), (2, None, long), (2, None, long), (3, "u", None), (4, "u", ""), (5, "u", "short"), (6, "u", "short"), (7, "u", "WARC/1.1\r\n\r\n" * 300), (None, "u", long), (8, "u", "y" * 500_000)]
    frame = spark.createDataFrame([(*r, "c", 1) for r in rows], PAGES)
    got = warc.round_trip(frame).collect()
    digest = lambda t: hashlib.sha1((t or "").encode()).hexdigest()
    kinds = {1: ("revisit", 2), **{i: ("response", None) for i in (3, 4, 5, 6, 7, 8, None)}}
    assert len(got) == len(rows)
    assert sorted((r["page_id"] or 0, r["payload_bytes"], r["payload_digest"]) for r in got) == sorted((i or 0, len((t or "").encode()), digest(t)) for i, _, t in rows)
    assert all((r["record_type"], r["refers_to"]) == kinds[r["page_id"]] for r in got if r["page_id"] != 2)
    assert {(r["record_type"], r["refers_to"]) for r in got if r["page_id"] == 2} == {("response", None), ("revisit", 2)}
    assert warc.round_trip(frame.where("n < 0")).count() == 0


def test_archives_are_members_behind_a_warcinfo(spark):
    rows = [(i, f"http://h/{i}", f"<p>{i}</p>" * (1 + i % 50), "c", 1) for i in range(40)]
    path = warc.write_archives(spark.createDataFrame(rows, PAGES).coalesce(1), file_bytes=2000)
    files = [f for f in Path(path.removeprefix("file://")).iterdir() if f.name.endswith(".warc.gz")]
    assert len(files) > 3
    seen = 0
    for file in files:
        data, members = file.read_bytes(), []
        while data:
            one = zlib.decompressobj(31)
            members.append(one.decompress(data))
            data = one.unused_data
        members = [m for m in members if m]
        kinds = [m.split(b"\r\n")[1] for m in members]
        assert kinds[0] == b"WARC-Type: warcinfo" and kinds.count(b"WARC-Type: warcinfo") == 1
        assert all(len(list(warc.records(m))) == 1 and m.endswith(b"\r\n\r\n") for m in members)
        assert gzip.decompress(file.read_bytes()) == b"".join(members)
        seen += len(members) - 1
    assert seen == 3 * len(rows)
    whole = warc.assemble(warc.read_archives(spark, path, payloads=True)).collect()
    assert {(bytes(r["main"]["payload"]).decode(), r["request"]["uri"], r["metadata"]["fields"]) for r in whole} == {(h, u, f"page-id: {i}\r\n") for i, u, h, _, _ in rows}


def record(i):
    return f"WARC/1.0\r\nWARC-Type: metadata\r\nWARC-Record-ID: <{i}>\r\nContent-Length: 5\r\n\r\nab\r\ncd"[:-1].encode() + b"\r\n\r\n"


def test_warc_reads_gzip_members():
    data = b"".join(gzip.compress(record(i)) for i in range(300))
    for x in (data, gzip.compress(b"".join(map(record, range(300)))), b"".join(map(record, range(300)))):
        assert [(h["warc-record-id"], b) for h, b in warc.records(x)] == [(f"<{i}>", b"ab\r\nc") for i in range(300)]


def test_truncated_files_are_errors():
    for cut in (1, 6, 40):
        with pytest.raises(ValueError):
            list(warc.records((record(0) + record(1))[: -4 - cut]))


def test_members_end_with_a_zero_byte():
    big = bytes(range(256)) * (1 << 16)  # 16 MB: the length's last byte is 1
    for x in (b"", b"abc", big):
        assert warc.gzipped(x).endswith(b"\0") and gzip.decompress(warc.gzipped(x)) == x


def greedy(order, cap):
    n = held = 0
    for g in order:
        if n == 0 or held + g > cap:
            n, held = n + 1, 0
        held += g
    return n


@pytest.mark.parametrize("members", [sharding.MEMBERS, 2])
def test_sharding(docs, texts, members, monkeypatch):
    monkeypatch.setattr(sharding, "MEMBERS", members)
    every = docs.union(docs.where("doc_id = 2")).union(docs.where("doc_id = 2")).union(docs.where("doc_id = 2"))
    rows = sharding.shard_documents(every, shards=5).collect()
    size = {r["doc_id"]: r["size"] for r in rows}
    assert len(rows) == len(texts) + 3 and all(size[i] == len((t or "").encode()) + 1 for i, t in enumerate(texts))
    assert all(r["text_crc32"] == zlib.crc32((texts[r["doc_id"]] or "").encode()) for r in rows)
    by_shard: dict = {}
    for r in rows:
        by_shard.setdefault(r["shard"], []).append(r)
    assert all(sorted(x["slot"] for x in own) == list(range(len(own))) for own in by_shard.values())
    groups: dict = {}
    for r in rows:
        t = texts[r["doc_id"]]
        key = hashlib.sha256(b"\0null" if t is None else t.encode()).hexdigest()
        groups[key] = groups.get(key, 0) + r["size"]
    order = [groups[k] for k in sorted(groups)]
    best = next(c for c in range(max(order), sum(order) + 1) if greedy(order, c) <= 5)
    assert max(sum(r["size"] for r in own) for own in by_shard.values()) == best
    shard_of: dict = {}
    assert all(shard_of.setdefault(texts[r["doc_id"]], r["shard"]) == r["shard"] for r in rows)
    assert sharding.shard_documents(docs.where("doc_id < 0")).count() == 0


@pytest.mark.parametrize("shards, least", [(1, 1), (2, 1), (4, 1), (7, 1), (40, 1), (4, 10_000)])
def test_capacity_equals_trying_all(spark, shards, least):
    import random

    r = random.Random(shards)
    sizes = [r.randrange(1, r.choice([5, 300])) for _ in range(150)]
    ends = [sum(sizes[: i + 1]) for i in range(len(sizes))]
    cap, cuts = sharding.capacity(spark.createDataFrame(list(zip(ends, sizes, strict=True)), "end bigint, size bigint").cache(), shards, least)
    assert cap == next(c for c in range(max(sizes), sum(sizes) + 1) if greedy(sizes, c) <= shards)
    at, expected = 0, []
    for _ in range(shards):
        at = max([e for e in ends if e <= at + cap], default=0)
        expected.append(at)
    assert cuts == expected


@pytest.mark.skipif(not Path(SF).is_dir(), reason="no test data")
@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    cursor = con.execute(oracle_sql()[name])
    columns = [c[0] for c in cursor.description]
    got = queries()[name](spark, SF)
    assert sorted(got.columns) == sorted(columns)
    assert sorted(map(repr, (tuple(r[c] for c in columns) for r in got.collect()))) == sorted(map(repr, cursor.fetchall()))
