"""Helpers shared by the training-data operators.

Intermediate tables go to the folder that the session names in ``spark.checkpoint.dir``;
every executor can read it again, so a lost executor costs a task and not the job.
"""

from __future__ import annotations

import os
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words of the contracts: runs of anything but space, tab, LF, VT, FF and CR.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; a local session without one is given one."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        context = spark.sparkContext
        found = context.getCheckpointDir()
        if not found:
            if not re.fullmatch(r"local(\[.*\])?", context.master):
                raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            context.setCheckpointDir(tempfile.mkdtemp(prefix="prosegauge-"))
            found = context.getCheckpointDir()
    return found.rstrip("/")


def open_store(uri: str) -> tuple[fs.FileSystem, str]:
    """The pyarrow file system of a path as Spark names it, and the path there."""
    scheme, sep, rest = uri.partition(":")
    if sep and scheme in ("s3a", "s3n"):
        uri = f"s3:{rest}"
    elif sep and scheme == "file" and not rest.startswith("//"):
        uri = f"file://{rest}"
    return fs.FileSystem.from_uri(uri)


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/prosegauge/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """The rows of df written once to the shared folder and read from there: cuts lineage."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_stored(spark: SparkSession, *frames: DataFrame) -> None:
    """Remove tables made by stored() that nothing reads any more."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for df in frames:
        for f in {os.path.dirname(x) for x in df.inputFiles()}:
            if "/prosegauge/" in f:
                path = jvm.org.apache.hadoop.fs.Path(f)
                path.getFileSystem(conf).delete(path, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def as_bytes(column: str) -> F.Column:
    """A string column as UTF-8 bytes; null stays null."""
    return F.col(column).cast("binary")


#: Bytes or characters of the longest word that a worker remembers.
MEMO_LENGTH = 64


class WordMemo(dict):
    """word -> value of make(word), kept for at most ``limit`` words of a worker, none of them long."""

    def __init__(self, make: Callable, limit: int = 400_000):
        super().__init__()
        self.make, self.limit = make, limit

    def __missing__(self, word):
        value = self.make(word)
        if len(word) > MEMO_LENGTH:
            return value
        if len(self) >= self.limit:
            self.clear()
        self[word] = value
        return value


_kept: list[Callable[[], None]] = []


def kept_by_worker(make: Callable) -> Callable:
    """make(key), its last value kept by a worker from task to task until forget_kept()."""
    kept = lru_cache(maxsize=1)(make)
    _kept.append(kept.cache_clear)
    return kept


def forget_kept() -> None:
    """Free what earlier tasks of this worker kept; tasks of other operators call it when they start."""
    for clear in _kept:
        clear()


def _column(column: pa.Array) -> np.ndarray:
    """Values as numpy has them; as objects where some are null, so that integers stay exact."""
    if column.null_count:
        return np.array(column.to_pylist(), dtype=object)
    return column.to_numpy(zero_copy_only=False)


def sorted_groups(
    batches: Iterator[pa.RecordBatch], keys: list[str]
) -> Iterator[tuple[tuple, dict[str, np.ndarray]]]:
    """Groups of rows that are next to each other with equal keys, over all batches of a task."""
    held: dict[str, list] = {}
    now: tuple | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = {n: _column(batch.column(n)) for n in batch.schema.names}
        change = np.zeros(batch.num_rows, dtype=bool)
        for k in keys:
            change[1:] |= columns[k][1:] != columns[k][:-1]
        cuts = [0, *np.flatnonzero(change).tolist(), batch.num_rows]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            key = tuple(columns[k][a].item() for k in keys)
            if key != now and held:
                yield now, {n: np.concatenate(v) for n, v in held.items()}
                held = {}
            now = key
            for n, v in columns.items():
                held.setdefault(n, []).append(v[a:b])
    if held:
        yield now, {n: np.concatenate(v) for n, v in held.items()}


def whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str], least: int = 100_000) -> Iterator[dict[str, np.ndarray]]:
    """Rows of a task in its order, in stretches of about ``least`` rows that hold whole groups.

    Groups are rows next to each other with equal keys; columns are without nulls.
    """
    held: list[dict[str, np.ndarray]] = []
    size = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append({n: _column(batch.column(n)) for n in batch.schema.names})
        size += batch.num_rows
        if size < least:
            continue
        rows = {n: np.concatenate([h[n] for h in held]) for n in held[0]}
        change = np.zeros(size - 1, dtype=bool)
        for k in keys:
            change |= rows[k][1:] != rows[k][:-1]
        cut = np.flatnonzero(change)
        at = int(cut[-1]) + 1 if len(cut) else 0
        if at:
            yield {n: v[:at] for n, v in rows.items()}
        held, size = [{n: v[at:] for n, v in rows.items()}], size - at
    if size:
        yield {n: np.concatenate([h[n] for h in held]) for n in held[0]}
