"""WARC archives: writing, and reading by verified chains of record boundaries.

Writing: each task writes the records of its rows to archives of bounded size in the shared
folder; the manifest (one row per finished archive) names them, so the files of a task that was
lost are never read. Of records with equal payloads (SHA-256 and length) that with the largest id
is the response, the others are revisits without a block.

Reading: an archive is dealt out in chunks. A task looks for record magic in its chunk and emits,
for each candidate, the offset at which its successor would stand, followed until the chain leaves
the chunk. Pointer jumping over these links from the start of each file keeps only entry points
that the file's own chain reaches; magic inside payloads is never on the chain. Tasks then walk
the records of each chunk from its reached entry.
"""

from __future__ import annotations

import base64
import hashlib
import math
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import as_bytes, new_path, open_store, stored

MAGIC = b"WARC/1.1\r\n"
ID_PREFIX = "urn:page:"
SMALL_ROWS = 50_000
MANIFEST = "file string, bytes long, records long"
RECORDS = "page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, payload binary"


def payload_digest(payload: bytes) -> str:
    """Base32 SHA-1 in upper case."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_of(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, date: str) -> bytes:
    """One WARC record: a response with its payload, or a revisit of the page refers_to."""
    block = b"" if refers_to is not None else payload
    head = [f"WARC-Type: {'revisit' if refers_to is not None else 'response'}", f"WARC-Record-ID: <{ID_PREFIX}{'' if page_id is None else page_id}>", f"WARC-Date: {date}"]
    if url is not None:
        head.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url))
    head.append(f"WARC-Payload-Digest: sha1:{payload_digest(payload)}")
    if refers_to is not None:
        head += [f"WARC-Refers-To: <{ID_PREFIX}{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Payload-Length: {len(payload)}"]
    head += ["Content-Type: text/html; charset=utf-8", f"Content-Length: {len(block)}"]
    return MAGIC + "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def revisits(pages: DataFrame, id_col: str, html_col: str, min_bytes: int) -> DataFrame:
    """(rv_id, rv_key, rv_to) of the records that are revisits."""
    payload = F.coalesce(as_bytes(html_col), F.lit(b""))
    keyed = pages.select(F.col(id_col).alias("rv_id"), F.sha2(payload, 256).alias("rv_key"), F.length(payload).alias("n"))
    keyed = stored(keyed.where(F.col("n") >= min_bytes).select("rv_id", "rv_key"), "warc-keys")
    first = keyed.groupBy("rv_key").agg(F.max("rv_id").alias("rv_to"), F.count("*").alias("n")).where("n > 1 and rv_to is not null")
    return keyed.join(first, "rv_key").where("rv_id is null or rv_id < rv_to").select("rv_id", "rv_key", "rv_to").distinct()


def write_archives(
    pages: DataFrame,
    path: str,
    id_col: str = "page_id",
    url_col: str = "url",
    html_col: str = "html",
    min_bytes: int = 0,
    archive_bytes: int = 64 << 20,
    date: str = "2000-01-01T00:00:00Z",
) -> DataFrame:
    """Write a record per row of pages below path (any store pyarrow reads); the manifest.

    Null html is an empty payload, a null url leaves the target out. Rows that share the largest
    id of their payload are all responses; null ids are smaller than any other, and a payload of
    null ids only is stored in each. Payloads under min_bytes are always responses.
    """
    found = stored(revisits(pages, id_col, html_col, min_bytes), "warc-revisits")
    if found.limit(SMALL_ROWS + 1).count() <= SMALL_ROWS:
        found = F.broadcast(found)  # else both sides are shuffled
    rows = (
        pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.coalesce(as_bytes(html_col), F.lit(b"")).alias("html"))
        .join(found, F.col("id").eqNullSafe(F.col("rv_id")) & (F.sha2("html", 256) == F.col("rv_key")), "left")
        .select("id", "url", "html", "rv_to")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = open_store(path)
        store.create_dir(root, recursive=True)
        out = name = None
        size = records = 0
        done: list[tuple[str, int, int]] = []
        for batch in batches:
            columns = [batch.column(c) for c in ("id", "url", "html", "rv_to")]
            for k in range(batch.num_rows):  # one row at a time: payloads are not all copied at once
                i, u, h, r = (c[k].as_py() for c in columns)
                if out is None:
                    name = f"{uuid.uuid4().hex}.warc"
                    out = store.open_output_stream(f"{root}/{name}")
                data = record_of(i, u, h, r, date)
                out.write(data)
                size, records = size + len(data), records + 1
                if size >= archive_bytes:
                    out.close()
                    done.append((name, size, records))
                    out, size, records = None, 0, 0
        if out is not None:
            out.close()
            done.append((name, size, records))
        if done:
            files, sizes, counts = zip(*done, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(files), pa.array(sizes, pa.int64()), pa.array(counts, pa.int64())], ["file", "bytes", "records"])

    return stored(rows.mapInArrow(run, MANIFEST), "warc-manifest")


class _File:
    """Ranges of an archive; only what is asked for is read."""

    def __init__(self, store, name: str):
        self.f = store.open_input_file(name)

    def range(self, a: int, b: int) -> bytes:
        return self.f.read_at(max(0, b - a), a)

    def header(self, at: int, size: int) -> tuple[dict[str, str], int] | None:
        """Fields of the record header at an offset and the offset of its block; None if it is none.

        A header of any length is read, up to its blank line. It holds no magic but its own, since
        no field holds a line break; so magic in payloads is given up at the next one.
        """
        step, data, seen = 1024, bytearray(), 0
        while (end := data.find(b"\r\n\r\n", max(0, seen - 3))) < 0:
            if at + len(data) >= size or data.find(MAGIC, max(1, seen - len(MAGIC))) >= 0:
                return None
            seen = len(data)
            data += self.range(at + len(data), min(size, at + len(data) + step))
            step = min(4 * step, 4 << 20)
            if not data.startswith(MAGIC):
                return None
        if data.find(MAGIC, max(1, seen - len(MAGIC)), end) >= 0:
            return None
        lines = bytes(data[len(MAGIC) : end]).split(b"\r\n")
        fields = {k.decode("utf-8", "replace").strip().lower(): v.decode("utf-8", "replace").strip() for k, s, v in (x.partition(b":") for x in lines) if s}
        return (fields, at + end + 4) if re.fullmatch("[0-9]{1,18}", fields.get("content-length", "")) else None


def _chunks(manifest: DataFrame, chunk_bytes: int) -> DataFrame:
    return manifest.where("bytes > 0").select(
        "file", "bytes", F.explode(F.sequence(F.lit(0).cast("long"), F.col("bytes") - 1, F.lit(chunk_bytes).cast("long"))).alias("start")
    ).withColumn("end", F.least(F.col("start") + chunk_bytes, F.col("bytes")))


def candidates(manifest: DataFrame, path: str, chunk_bytes: int) -> DataFrame:
    """(file, offset, exit): magic at offset, and where its chain of successors leaves the chunk."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = open_store(path)
        for batch in batches:
            for x in batch.to_pylist():
                f = _File(store, f"{root}/{x['file']}")
                data = f.range(x["start"], min(x["bytes"], x["end"] + len(MAGIC) - 1))
                found: dict[int, int] = {}
                at = data.find(MAGIC)
                while at >= 0:
                    head = f.header(x["start"] + at, x["bytes"])
                    if head:
                        found[x["start"] + at] = head[1] + int(head[0]["content-length"]) + 4
                    at = data.find(MAGIC, at + 1)
                exits: dict[int, int] = {}
                for offset in sorted(found, reverse=True):  # successors first; a chain that ends in mid-chunk is dead
                    after = found[offset]
                    exits[offset] = after if after >= x["end"] else exits.get(after, -1)
                live = [(o, e) for o, e in exits.items() if 0 <= e <= x["bytes"]]
                if live:
                    offsets, ends = zip(*live, strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array([x["file"]] * len(live)), pa.array(offsets, pa.int64()), pa.array(ends, pa.int64())], ["file", "offset", "exit"])

    work = _dealt(_chunks(manifest, chunk_bytes), _tasks(manifest, chunk_bytes))
    return work.mapInArrow(run, "file string, offset long, exit long")


def _tasks(manifest: DataFrame, chunk_bytes: int) -> int:
    """One task a chunk, up to a number that a job can plan."""
    total = manifest.agg(F.sum("bytes")).first()[0] or 0
    return min(50_000, max(1, math.ceil(total / chunk_bytes)))


def _dealt(chunks: DataFrame, tasks: int) -> DataFrame:
    """Chunks over a stated number of tasks: their rows are few bytes, and would else be merged."""
    return chunks.repartition(tasks, "file", "start")


def reached_entries(links: DataFrame, chunks_per_file: int) -> DataFrame:
    """(file, offset): entry points of chunks on the chain from each file's start, by pointer jumping."""
    targets = links.select("file", F.col("exit").alias("offset")).distinct()
    starts = links.where("offset = 0").select("file", "offset")
    jump = stored(links.join(targets.unionByName(starts).distinct(), ["file", "offset"]).select("file", "offset", "exit"), "warc-jumps")
    reached = stored(starts, "warc-reached")
    for _ in range(max(1, math.ceil(math.log2(chunks_per_file + 1)))):  # each round doubles the steps of a jump
        ahead = reached.join(jump, ["file", "offset"]).select("file", F.col("exit").alias("offset"))
        reached = stored(reached.unionByName(ahead).distinct(), "warc-reached")
        after = jump.select("file", F.col("offset").alias("exit"), F.col("exit").alias("next"))
        jump = stored(jump.join(after, ["file", "exit"]).select("file", "offset", F.col("next").alias("exit")), "warc-jumps")
    return reached


def read_archives(manifest: DataFrame, path: str, chunk_bytes: int = 4 << 20, payloads: bool = True) -> DataFrame:
    """The records of the archives in a manifest: page_id, url, record_type, payload_bytes,
    payload_digest, refers_to and payload (null for revisits, and everywhere without payloads).

    Lengths and digests of responses are taken from the bytes read and held against the header;
    a difference, or a chain that does not reach the end of its file, raises an error. An empty
    manifest has no records.
    """
    spark = manifest.sparkSession
    most = manifest.agg(F.max("bytes")).first()[0]
    if most is None:
        return spark.createDataFrame([], RECORDS)
    reached = reached_entries(stored(candidates(manifest, path, chunk_bytes), "warc-links"), math.ceil(most / chunk_bytes))
    broken = manifest.where("bytes > 0").join(reached.select("file", F.col("offset").alias("bytes")), ["file", "bytes"], "left_anti")
    if bad := broken.limit(5).collect():
        raise ValueError(f"archives whose record chain does not reach their end: {[x.file for x in bad]}")
    entries = reached.withColumn("start", F.floor(F.col("offset") / chunk_bytes) * chunk_bytes)
    work = _chunks(manifest, chunk_bytes).join(entries, ["file", "start"]).where("offset < bytes")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = open_store(path)
        schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary())])

        def number(field: str | None) -> int | None:
            text = (field or "").strip("<>").removeprefix(ID_PREFIX)
            return int(text) if text else None

        for batch in batches:
            for x in batch.to_pylist():
                f, at, rows, held = _File(store, f"{root}/{x['file']}"), x["offset"], [], 0
                while at < x["end"]:
                    head, block = f.header(at, x["bytes"])
                    payload = f.range(block, block + int(head["content-length"]))
                    at = block + len(payload) + 4
                    digest = head.get("warc-payload-digest", "").removeprefix("sha1:")
                    if head["warc-type"] == "revisit":
                        n, payload = int(head["warc-payload-length"]), None
                    else:
                        n = len(payload)
                        if payload_digest(payload) != digest:
                            raise ValueError(f"{x['file']}: wrong digest at {at}")
                    rows.append((number(head.get("warc-record-id")), head.get("warc-target-uri"), head["warc-type"], n, digest, number(head.get("warc-refers-to")), payload if payloads else None))
                    held += n if payloads else 0
                    if len(rows) >= 2000 or held > 8 << 20:
                        yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r, strict=True)) for r in rows], schema)
                        rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r, strict=True)) for r in rows], schema)

    dealt = _dealt(work.select("file", "bytes", "start", "end", "offset"), _tasks(manifest, chunk_bytes))
    return dealt.mapInArrow(run, RECORDS)


def round_trip(spark: SparkSession, pages: DataFrame, **options) -> DataFrame:
    """Write pages to new archives in the shared folder and read their records back."""
    path = new_path(spark, "warc")
    return read_archives(write_archives(pages, path, **options), path, payloads=False)


#: DuckDB SQL for the query op10.
ORACLE = r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (
  SELECT page_id, strlen(html) AS payload_bytes, sha1(html) AS h,
         max(page_id) OVER (PARTITION BY html) AS m FROM p)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda i:
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[
      CAST((CAST('0x' || h[(i // 4) * 5 + 1 : (i // 4) * 5 + 5] AS BIGINT) >> (15 - 5 * (i % 4))) & 31 AS INTEGER) + 1]), '') AS payload_digest,
  CASE WHEN m IS NULL OR page_id = m THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN m IS NULL OR page_id = m THEN NULL ELSE m END AS refers_to
FROM d
"""
