"""Vector code compression: product quantization over integers, with results that no machine's rounding can change.

A part's nearest codebook entry is found by one float32 matrix product, whose rounding error has a proven bound: each
distance is an interval.  Entries whose interval overlaps the best one's are evaluated anew in 64-bit integers, and ties go
to the lower index.  Tasks give a row of sums for each part and entry they used, so a round shuffles parts x entries rows
a task, and the codebooks (parts x entries x width, a bounded number) are what the driver holds.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kilngraph.llm._util import bounded, materialize

PARTS = 16
ENTRIES = 64
ROUNDS = 2
SCALE = 256
#: Vectors that are compared at once.
ROWS = 4096
#: Largest integer component: squared distances of a vector then fit 64 bits.
LARGEST = 1 << 26
#: Rows of label sums that may be broadcast.
BROADCAST_ROWS = 100_000


def nearest(x: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index, squared distance) of each row's nearest entry, ties to the lower index; both int64.

    A float32 product screens: with d terms, each of which is rounded three times at most, the sum is off by less than
    (d + 2) u / (1 - (d + 2) u) times the sum of the terms' sizes, and that is at most the product of the norms."""
    d = x.shape[1]
    dot = (x.astype(np.float32) @ entries.astype(np.float32).T).astype(np.float64)
    norms = np.sqrt((entries.astype(np.float64) ** 2).sum(1))
    own = np.sqrt((x.astype(np.float64) ** 2).sum(1))
    u = 2.0**-24
    gamma = (d + 2) * u / (1 - (d + 2) * u)
    # what the norms, the sum below and tiny products add is covered by half as much again
    slack = 3.0 * gamma * own[:, None] * norms[None, :] + 2.0**-50 * norms**2 + 2.0**-100
    score = norms**2 - 2.0 * dot
    row, entry = np.nonzero(score - slack <= (score + slack).min(1)[:, None])
    exact = ((x[row] - entries[entry]) ** 2).sum(1)
    starts = np.flatnonzero(np.append(True, row[1:] != row[:-1])) if len(row) else row
    least = np.minimum.reduceat(exact, starts) if len(row) else exact
    first = np.flatnonzero(exact == least[row])
    first = first[np.append(True, row[first][1:] != row[first][:-1])] if len(first) else first
    return entry[first], exact[first]


def integers(vectors: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(which rows are kept, their integer components): rows of another width, with nulls or components that aren't finite are not."""
    sizes = vectors.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False)
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)  # nulls are nan
    begins = np.cumsum(np.maximum(sizes, 0)) - np.maximum(sizes, 0)
    rows = np.flatnonzero(sizes == width)
    x = flat[begins[rows][:, None] + np.arange(width)] if len(rows) else np.zeros((0, width))
    good = np.isfinite(x).all(1)
    x = np.floor(x[good] * SCALE)
    if len(x) and np.abs(x).max() > LARGEST:
        raise ValueError(f"a component is beyond {LARGEST // SCALE}")
    return rows[good], x.astype(np.int64)


def kept_vectors(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(vec_id, vector, label) of rows whose vector is neither null nor empty and holds finite numbers only."""
    fine = F.forall(vector_col, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    label = F.col("label") if "label" in vectors.columns else F.lit(None).cast("int").alias("label")
    vector = F.col(vector_col).cast("array<double>").alias("vector")
    return bounded(vectors).where(F.coalesce(fine, F.lit(False)) & (F.size(vector_col) > 0)).select(F.col(id_col).cast("long").alias("vec_id"), vector, label)


def first_codebooks(kept: DataFrame, parts: int, entries: int) -> np.ndarray | None:
    """(parts, entries, width of a part): the parts of the vectors with the smallest ids (null last, ties by the vector); None without vectors.

    All have the width of the very first."""
    rows = kept.orderBy(F.asc_nulls_last("vec_id"), "vector").limit(entries).select("vector").collect()  # entries rows
    if not rows:
        return None
    width = len(rows[0]["vector"])
    if width % parts:
        raise ValueError(f"vectors of {width} components can't be cut into {parts} equal parts")
    if any(len(r["vector"]) != width for r in rows):
        raise ValueError("the first vectors differ in width")
    _, x = integers(pa.array([r["vector"] for r in rows], pa.list_(pa.float64())), width)
    return x.reshape(len(x), parts, width // parts).transpose(1, 0, 2)


def coded(batch: pa.RecordBatch, books: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(rows, integers, indexes, squared distances) of the batch's vectors, ROWS at a time; the last three (rows, parts, ...)."""
    parts, _, width = books.shape
    for at in range(0, batch.num_rows, ROWS):
        piece = batch.slice(at, ROWS)
        rows, x = integers(piece.column("vector"), parts * width)
        if len(rows) != piece.num_rows:
            raise ValueError("vectors differ in width")
        cut = x.reshape(len(x), parts, width)
        found = [nearest(cut[:, p], books[p]) for p in range(parts)]
        yield rows + at, cut, np.stack([f[0] for f in found], 1), np.stack([f[1] for f in found], 1)


def next_codebooks(kept: DataFrame, books: np.ndarray) -> np.ndarray:
    """Each entry's parts' componentwise floor(sum / count); entries that no part is nearest to stay."""
    shared = kept.sparkSession.sparkContext.broadcast(books)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        total, count = np.zeros(own.shape, np.int64), np.zeros(own.shape[:2], np.int64)
        for batch in batches:
            for _, cut, index, _ in coded(batch, own):
                for p in range(len(own)):
                    np.add.at(total[p], index[:, p], cut[:, p])
                    count[p] += np.bincount(index[:, p], minlength=own.shape[1])
        part, entry = np.nonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(entry, pa.int32()), pa.array(count[part, entry]), pa.array(list(total[part, entry]), pa.list_(pa.int64()))], ["part", "entry", "n", "total"])

    width = books.shape[2]
    rows = kept.select("vector").mapInArrow(sums, "part int, entry int, n long, total array<long>")
    rows = rows.groupBy("part", "entry").agg(F.sum("n").alias("n"), *[F.sum(F.get("total", F.lit(i))).alias(f"t{i}") for i in range(width)]).collect()  # parts x entries
    out = books.copy()
    for r in rows:
        out[r["part"], r["entry"]] = [r[f"t{i}"] // r["n"] for i in range(width)]
    return out


def fit_codebooks(kept: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> np.ndarray | None:
    books = first_codebooks(kept, parts, entries)
    for _ in range(rounds if books is not None else 0):
        books = next_codebooks(kept, books)
    return books


def codebooks_digest(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def encode_vectors(kept: DataFrame, books: np.ndarray) -> DataFrame:
    """(vec_id, code, error, label): indexes in part order, two hex digits each, and the squared distances' sum."""
    shared = kept.sparkSession.sparkContext.broadcast(books)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, _, index, distance in coded(batch, shared.value):
                codes = [bytes(r).hex() for r in index.astype(np.uint8)]
                yield pa.RecordBatch.from_arrays([batch.column("vec_id").take(pa.array(rows)), pa.array(codes), pa.array(distance.sum(1)), batch.column("label").take(pa.array(rows))], ["vec_id", "code", "error", "label"])

    return kept.mapInArrow(encode, f"vec_id long, code string, error long, label {kept.schema['label'].dataType.simpleString()}")


def decoded(code: str, books: np.ndarray) -> np.ndarray:
    """The integer vector that a code stands for."""
    return np.concatenate([books[p, i] for p, i in enumerate(bytes.fromhex(code))])


def compress(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Per kept row of vectors: vec_id, code, error, label_error, codebooks_sha256.

    Rows whose vector is null, empty or holds nulls or numbers that aren't finite are dropped; rows that repeat count as often as they
    come; equal labels (null is one) share label_error.  ValueError where vectors differ in width, can't be cut into equal parts, or are beyond
    LARGEST.  Without vectors there are no rows."""
    if not 0 < entries <= 256:
        raise ValueError("an index has two hex digits")
    kept = kept_vectors(vectors, id_col, vector_col)
    books = fit_codebooks(kept, parts, entries, rounds)
    schema = "vec_id long, code string, error long, label_error long, codebooks_sha256 string"
    if books is None:
        return vectors.sparkSession.createDataFrame([], schema)
    found = materialize(encode_vectors(kept, books))
    sums = materialize(found.groupBy("label").agg(F.sum("error").alias("label_error")))
    sums = sums.withColumnRenamed("label", "_label")
    few = sums.limit(broadcast_rows + 1).count() <= broadcast_rows
    out = found.join(F.broadcast(sums) if few else sums, F.col("label").eqNullSafe(F.col("_label")))
    return out.select("vec_id", "code", "error", "label_error", F.lit(codebooks_digest(books)).alias("codebooks_sha256"))
