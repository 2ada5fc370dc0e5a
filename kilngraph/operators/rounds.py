"""Rounds of message passing over edges that are dealt once: only vectors and their partial sums move between rounds.

h: (id, z array<double>), all vectors of one width; edges: (src, dst, w), w being what a message is multiplied with."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kilngraph.functions import expressions as X

#: A source with more edges than this has them in several pieces.
HUB_EDGES = 1_000_000
SUMS = "id long, z array<double>"


@dataclass(frozen=True)
class Adjacency:
    """edges: (src, piece, dst, w), dealt and sorted by (src, piece), kept on the executors' disks; hubs: (src, pieces) of the
    sources with more than one piece."""

    edges: DataFrame
    hubs: DataFrame

    def free(self) -> None:
        self.edges.unpersist()
        self.hubs.unpersist()


def symmetric_weights(edges: DataFrame) -> DataFrame:
    """(src, dst, w) of (src, dst): 1 / sqrt(edges of src x edges of dst)."""
    out_, in_ = edges.groupBy("src").agg(F.count("*").alias("_a")), edges.groupBy("dst").agg(F.count("*").alias("_b"))
    return edges.join(out_, "src").join(in_, "dst").select("src", "dst", X.symmetric_norm(F.col("_a"), F.col("_b")).alias("w"))


def laid(edges: DataFrame, parts: int | None = None, hub_edges: int = HUB_EDGES) -> Adjacency:
    """The edges, each in the part of its source; a hub's in as many pieces as it takes, by target.  An edge with a null has no part.
    Runs a job: the edges are dealt when it returns.

    parts: how many (spark.sql.shuffle.partitions by default; fixed, so that rounds find the edges where they are)."""
    edges = edges.select("src", "dst", "w").dropna()
    parts = parts or int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    degrees = edges.groupBy("src").agg(F.count("*").alias("_n")).where(F.col("_n") > hub_edges)
    hubs = degrees.select("src", F.ceil(F.col("_n") / hub_edges).cast("int").alias("pieces")).persist(StorageLevel.DISK_ONLY)
    piece = F.pmod(F.xxhash64("dst"), F.coalesce("pieces", F.lit(1))).cast("int").alias("piece")
    dealt = edges.join(hubs, "src", "left").select("src", piece, "dst", "w").repartition(parts, "src", "piece").sortWithinPartitions("src", "piece")
    dealt = dealt.persist(StorageLevel.DISK_ONLY)
    dealt.count()  # Spark knows how kept rows lie only once they are there
    return Adjacency(dealt, hubs)


def batch_of(key: np.ndarray, x: np.ndarray) -> pa.RecordBatch:
    offsets = np.arange(0, x.size + 1, x.shape[1] or 1, dtype=np.int32)
    return pa.RecordBatch.from_arrays([pa.array(key, pa.int64()), pa.ListArray.from_arrays(offsets, pa.array(x.reshape(-1)))], ["id", "z"])


def by_key(key: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of equal neighbouring keys summed."""
    first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    return key[first], np.add.reduceat(x, first, axis=0)


def matrix(column: pa.Array, rows: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(rows, -1)


def weighed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of (dst, w, z) a sum for each target of a batch."""
    for b in batches:
        if b.num_rows:
            key = b.column("dst").to_numpy()
            order = np.argsort(key, kind="stable")
            x = matrix(b.column("z"), b.num_rows) * b.column("w").to_numpy()[:, None]
            yield batch_of(*by_key(key[order], x[order]))


def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of sums (id, z) in the order of ids one for each; a target's may go on over batches."""
    held = None
    for b in batches:
        if b.num_rows:
            key, x = b.column("id").to_numpy(), matrix(b.column("z"), b.num_rows)
            if held:
                key, x = np.concatenate([held[0], key]), np.vstack([held[1], x])
            key, x = by_key(key, x)
            if len(key) > 1:
                yield batch_of(key[:-1], x[:-1])
            held = key[-1:], x[-1:]
    if held:
        yield batch_of(*held)


def sums(h: DataFrame, adjacency: Adjacency) -> DataFrame:
    """(id, z) of every target that an edge reaches from a node of h: its messages' sum.

    The vectors go to the edges' parts, a hub's to each of its pieces; each batch of a part is summed by target before anything
    is shuffled, so a target with very many edges costs a row a batch.  Vectors that are null send nothing."""
    pieces = F.explode(F.sequence(F.lit(0), F.coalesce("pieces", F.lit(1)) - 1))
    vectors = h.where("id is not null and z is not null").select(F.col("id").alias("src"), "z").join(adjacency.hubs, "src", "left").select("src", pieces.alias("piece"), "z")
    partial = adjacency.edges.join(vectors, ["src", "piece"]).select(F.col("dst").cast("long").alias("dst"), F.col("w").cast("double").alias("w"), "z").mapInArrow(weighed, SUMS)
    return partial.repartition("id").sortWithinPartitions("id").mapInArrow(merged, SUMS)


@dataclass
class Rounds:
    """z: (id, z), the mean of all states; free() gives back what rounds have kept."""

    z: DataFrame
    kept: list = field(default_factory=list)

    def free(self) -> None:
        for one in self.kept:
            one.unpersist()


def light_layers(h: DataFrame, adjacency: Adjacency, layers: int, every: int = 3) -> Rounds:
    """The mean of h and of `layers` rounds of sums; a node that gets nothing in a round has zeros in it.

    A round's state is kept on the executors' disks, as the next one reads it twice; every few rounds it is checkpointed, where the
    session names a folder for that, so that a lost executor doesn't cost all rounds before."""
    state, kept = h.select("id", "z", F.col("z").alias("total")), []
    for i in range(1, layers + 1):
        got = sums(state.select("id", "z"), adjacency).withColumnRenamed("z", "_z")
        new = F.coalesce("_z", F.transform("total", lambda _: F.lit(0.0)))
        state = state.join(got, "id", "left").select("id", new.alias("z"), F.zip_with("total", new, lambda a, b: a + b).alias("total"))
        if i < layers:
            if i % every == 0 and h.sparkSession.sparkContext.getCheckpointDir():
                state = state.checkpoint()
            else:
                state = state.persist(StorageLevel.DISK_ONLY)
                kept.append(state)
    return Rounds(state.select("id", F.transform("total", lambda x: x / (layers + 1)).alias("z")), kept)
