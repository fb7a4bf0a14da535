import base64
import hashlib
import random

import pytest
from pyspark.sql import functions as F

from prosegauge.llm import warc
from prosegauge.llm.common import new_path

SCHEMA = "page_id long, url string, html string, payload string"


def trap(rng):
    """A payload that holds whole records, bare magic and broken headers."""
    inner = warc.record_of(rng.randrange(99), "http://x", b"inner " * rng.randrange(9), None, "2000-01-01T00:00:00Z").decode()
    return rng.choice([inner, "WARC/1.1\r\n", "WARC/1.1\r\nContent-Length: 5\r\n\r\n", "\r\n\r\nWARC/1.1\r\nContent-Length: x\r\n\r\n"]) + "é" * rng.randrange(60)


def expected(rows, min_bytes=0):
    by = {}
    for i, _, h, _ in rows:
        by.setdefault(h or "", []).append(i)
    out = []
    for i, u, h, _ in rows:
        data = (h or "").encode()
        top = max((x for x in by[h or ""] if x is not None), default=None)
        response = top is None or i == top or len(data) < min_bytes
        out.append((i, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "response" if response else "revisit", None if response else top))
    return sorted(out, key=str)


@pytest.mark.parametrize("chunk", [37, 1000, 1 << 20])
def test_round_trip_with_magic_in_payloads(spark, chunk):
    rng = random.Random(chunk)
    rows = [(i, f"http://h/{i}", "".join(trap(rng) for _ in range(rng.randrange(4))), "x") for i in range(40)]
    rows += [(100 + i, "http://a b\r\n", rng.choice(["", "same", None, rows[0][2]]), None) for i in range(20)]
    rows += [(None, None, "same", "x"), (None, None, "only null", "x"), (119, "u", "same", "x"), (119, "u", "same", "x")]
    pages = spark.createDataFrame(rows, SCHEMA)
    path = new_path(spark, "warc-test")
    manifest = warc.write_archives(pages, path, archive_bytes=5000)
    assert manifest.count() > 1 and manifest.agg(F.sum("records")).first()[0] == len(rows)
    got = warc.read_archives(manifest, path, chunk_bytes=chunk).collect()
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got), key=str) == expected(rows)
    for r in got:
        if r.record_type == "response":
            assert len(r.payload) == r.payload_bytes


def test_headers_of_any_length(spark):
    rows = [(1, "http://h/" + "a b" * 1_000_000, "<p>x</p>", None), (2, "u", "WARC/1.1\r\n" * 3000, None), (3, None, "last", None)]
    pages = spark.createDataFrame(rows, SCHEMA).repartition(1)
    path = new_path(spark, "warc-test")
    got = warc.read_archives(warc.write_archives(pages, path), path, chunk_bytes=1 << 20).collect()
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got), key=str) == expected(rows)
    assert {len(r.url or "") for r in got} == {9 + 5_000_000, 1, 0}


def test_small_payloads_and_empty_tables(spark):
    rows = [(i, None, h, None) for i, h in enumerate(["a", "a", "long text", "long text"])]
    pages = spark.createDataFrame(rows, SCHEMA)
    got = warc.round_trip(spark, pages, min_bytes=3).collect()
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got), key=str) == expected(rows, 3)
    assert warc.round_trip(spark, pages.limit(0)).count() == 0


def test_broken_chain_is_an_error(spark, tmp_path):
    data = warc.record_of(1, None, b"abc", None, "2000-01-01T00:00:00Z")
    (tmp_path / "x.warc").write_bytes(data[:-9] + b"cut")
    manifest = spark.createDataFrame([("x.warc", len(data) - 6, 1)], warc.MANIFEST)
    with pytest.raises(ValueError):
        warc.read_archives(manifest, str(tmp_path), 64)
