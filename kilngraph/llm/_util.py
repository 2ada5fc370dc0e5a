"""Small helpers shared by the training-data operators: scratch tables, text chunks, word boundaries, rolling hashes."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that a task handles at once with numpy; a longer text is one chunk of its own.
CHUNK_BYTES = 1 << 20
#: Files of an intermediate table for each core.
FILES = 4
#: Bytes of rows that Python gets in one batch; a longer row is a batch of its own.
BATCH_BYTES = 8 << 20

BASE = 0x9E3779B97F4A7C15
BASE_INVERSE = pow(BASE, -1, 1 << 64)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_dir(spark: SparkSession) -> str:
    """A new folder in the one all executors share, spark.checkpoint.dir.

    Where that is unset, as in tests, a folder of this machine will do in local mode; a cluster gets an error."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[[\w*, ]+\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        base = f"file://{tempfile.gettempdir()}/kiln-scratch"
    return f"{base.rstrip('/')}/kiln-{uuid.uuid4().hex}"


def materialize(df: DataFrame) -> DataFrame:
    """Write df to the shared folder and read it back: lineage ends there, and lost executors cost no recomputation.

    In at most FILES files a core, however many partitions it comes in."""
    spark = df.sparkSession
    path = scratch_dir(spark)
    df.coalesce(FILES * spark.sparkContext.defaultParallelism).write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def held(df: DataFrame) -> DataFrame:
    """df kept on the executors' disks from its first use on, so that several uses compute it once.

    Lineage stays: what a lost executor held is computed again.  spark.catalog.clearCache() frees it."""
    return df.persist(StorageLevel.DISK_ONLY)


def checkpointed(df: DataFrame) -> DataFrame:
    """df written by checkpoint() to the shared folder; its lineage ends there."""
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        context.setCheckpointDir(scratch_dir(df.sparkSession))
    return df.checkpoint()


def bounded(df: DataFrame) -> DataFrame:
    """df; its session hands Python at most BATCH_BYTES of rows at once from now on, unless it has a setting of its own."""
    conf, name = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    if conf.get(name) in ("67108864b", "67108864"):  # Spark's own
        conf.set(name, str(BATCH_BYTES))
    return df


def text_key(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[F.Column, F.Column]:
    """Two join keys that tell rows apart even if ids are null or repeat; rows that share both have equal texts."""
    return (
        F.coalesce(df[id_col].cast("long"), F.lit(-(2**63))),
        F.xxhash64(F.coalesce(df[text_col], F.lit(""))),
    )


def as_bytes(column: pa.Array | pa.ChunkedArray) -> list[bytes]:
    """UTF-8 bytes of a string column; null is empty."""
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return [x or b"" for x in column.cast(kind).to_pylist()]


def chunked(texts: list[bytes], limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges [a, b) of texts with about limit bytes together, one text at least."""
    start = size = 0
    for i, t in enumerate(texts):
        if i > start and size + len(t) > limit:
            yield start, i
            start, size = i, 0
        size += len(t) + 1
    if start < len(texts):
        yield start, len(texts)


def powers(n: int, base: int, cache: dict[int, np.ndarray] = {}) -> np.ndarray:  # noqa: B006
    """base ** 0 .. base ** (n - 1) modulo 2 ** 64, kept by the worker up to a few chunks' length."""
    have = cache.get(base)
    if have is None or len(have) < n:
        have = np.full(max(n, 2 * CHUNK_BYTES), base, np.uint64)
        have[0] = 1
        np.multiply.accumulate(have, out=have)
        if n <= 4 * CHUNK_BYTES:
            cache[base] = have
    return have[:n]


def prefix_hash(symbols: np.ndarray) -> np.ndarray:
    """P with P[j] - P[i] = the polynomial of symbols[i:j], shifted by i."""
    out = np.zeros(len(symbols) + 1, np.uint64)
    np.cumsum((symbols.astype(np.uint64) + np.uint64(1)) * powers(len(symbols), BASE), out=out[1:])
    return out


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of symbols[start:end]; equal strings have equal hashes."""
    h = (prefix[end] - prefix[start]) * powers(len(prefix), BASE_INVERSE)[start]
    return mix(h ^ ((end - start).astype(np.uint64) << np.uint64(48)))


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection on 64-bit words that spreads every bit."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def word_table(is_word: Iterable[int]) -> np.ndarray:
    """A byte table: word bytes with A-Z lower-cased, other bytes 0."""
    out = np.zeros(256, np.uint8)
    for b in is_word:
        out[b] = b + 32 if 0x41 <= b <= 0x5A else b
    return out


#: Words of ASCII letters, digits and everything beyond ASCII.
ALNUM = word_table([*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)])
#: Words of everything but the six ASCII white-space characters.
NONSPACE = word_table(b for b in range(256) if b not in (0x20, 9, 10, 11, 12, 13))


def words_of(joined: np.ndarray, kinds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(lower-cased bytes, word starts, word ends) of a byte array."""
    low = kinds[joined]
    mask = np.zeros(len(low) + 2, np.bool_)
    mask[1:-1] = low != 0
    edges = np.flatnonzero(mask[1:] != mask[:-1])
    return low, edges[::2], edges[1::2]


def join_texts(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The texts in one byte array, a line feed after each, and where each begins (and the end)."""
    at = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) + 1 for t in texts], out=at[1:])
    return np.frombuffer(b"\n".join([*texts, b""]), np.uint8), at
