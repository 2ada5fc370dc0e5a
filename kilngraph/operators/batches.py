"""Batches of links with sampled surroundings: one job for all batches, a batch is a part of every key.

Edges are numbered once in the order of relation, target and a seeded draw, so a target's edges are consecutive and shuffled.  To take k of a
target's d edges, [0, d) is cut into k parts and one place is drawn in each: k different edges, each as likely as any, and only what is taken is
joined.  A hub's edges are never gathered, however many batches ask for it.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kilngraph.functions import expressions as X
from kilngraph.operators import protocol, splits
from kilngraph.operators.graph import KnowledgeGraph, Relation
from kilngraph.operators.ids import surrogate_keys
from kilngraph.sources import tables as S

#: Links whose batches a task numbers, about.
TASK_LINKS = 250_000


@dataclass(frozen=True)
class Adjacency:
    """relations, named in rows and heads by their place; rows: (at, rel, src, dst), numbered; heads: (rel, dst, first, degree) of each target."""

    relations: tuple[Relation, ...]
    rows: DataFrame
    heads: DataFrame


@dataclass(frozen=True)
class Batches:
    """links: (batch, src, dst, src_local, dst_local); nodes: (batch, type, local, id), local from 0 in the order of id; edges: (batch, hop,
    relation, src_type, src, src_local, dst_type, dst, dst_local)."""

    links: DataFrame
    nodes: DataFrame
    edges: DataFrame


def settled(df: DataFrame) -> DataFrame:
    """df by checkpoint(), where the context has a folder for it, so that later plans begin here; else kept on disk."""
    return df.checkpoint() if df.sparkSession.sparkContext.getCheckpointDir() else df.persist(StorageLevel.DISK_ONLY)


def adjacency(relations: Mapping[Relation, DataFrame], seed: int = 42) -> Adjacency:
    names = tuple(relations)
    rows = [df.select(F.lit(i).cast("byte").alias("rel"), F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst")) for i, df in enumerate(relations.values())]
    drawn = reduce(DataFrame.unionByName, rows).distinct().withColumn("_draw", X.draw(seed, F.lit("order"), looked_up("rel", ["__".join(r) for r in names]), F.col("src"), F.col("dst"), below=2**40))
    laid = surrogate_keys(drawn, ["rel", "dst", "_draw", "src"], "at").drop("_draw")  # kept on disk there: every hop reads it
    return Adjacency(names, laid, laid.groupBy("rel", "dst").agg(F.min("at").alias("first"), F.count("*").alias("degree")))


def looked_up(column: str, values: Sequence) -> Column:
    """The value at the place that a column has."""
    return F.get(F.array(*[F.lit(v) for v in values]), F.col(column).cast("int"))


def kinds_of(edges: Adjacency, *more: str) -> list[str]:
    """Kinds of nodes; their places stand for them until the end."""
    return sorted({k for r in edges.relations for k in (r[0], r[2])} | set(more))


def spread(df: DataFrame, tasks: int, key: str) -> DataFrame:
    """df dealt to tasks by a key where Spark's own number of them would be too few."""
    return df.repartition(tasks, key) if tasks > int(df.sparkSession.conf.get("spark.sql.shuffle.partitions") or 1) else df


def picked(edges: Adjacency, frontier: DataFrame, kinds: Sequence[str], most: int, seed: int, tasks: int = 1) -> DataFrame:
    """(batch, rel, src, dst): of each relation's edges into a node (batch, kind, id) at most `most`."""
    heads = edges.heads.withColumn("kind", looked_up("rel", [kinds.index(r[2]) for r in edges.relations]).cast("byte"))
    asked = frontier.select("batch", "kind", F.col("id").alias("dst")).join(heads, ["kind", "dst"])
    asked = asked.withColumn("k", F.least(F.col("degree"), F.lit(most).cast("long"))).withColumn("j", F.explode(F.sequence(F.lit(0).cast("long"), F.col("k") - 1)))
    asked = asked.withColumns({"low": F.expr("(j * degree) div k"), "high": F.expr("((j + 1) * degree) div k")})
    name = looked_up("rel", ["__".join(r) for r in edges.relations])
    place = F.col("low") + X.draw(seed, F.lit("pick"), F.col("batch"), name, F.col("dst"), F.col("j"), below=F.col("high") - F.col("low"))
    places = asked.select("batch", (F.col("first") + place).alias("at"))
    return spread(places, tasks, "at").join(spread(edges.rows, tasks, "at"), "at").select("batch", "rel", "src", "dst")


def sampled(edges: Adjacency, frontier: DataFrame, most: int, seed: int) -> DataFrame:
    """(batch, relation, src_type, src, dst_type, dst): of each relation's edges into a node (batch, type, id) at most `most`."""
    kinds = kinds_of(edges)
    coded = frontier.select("batch", (F.array_position(F.array(*[F.lit(k) for k in kinds]), F.col("type")) - 1).cast("byte").alias("kind"), "id")
    return spelled(picked(edges, coded, kinds, most, seed), edges.relations).select("batch", "relation", "src_type", "src", "dst_type", "dst")


def spelled(rows: DataFrame, relations: Sequence[Relation]) -> DataFrame:
    """rows with the names that rel stands for."""
    return rows.withColumns({"relation": looked_up("rel", ["__".join(r) for r in relations]), "src_type": looked_up("rel", [r[0] for r in relations]), "dst_type": looked_up("rel", [r[2] for r in relations])})


def located(rows: Iterator[pa.RecordBatch], ends: np.ndarray, nodes: bool) -> Iterator[pa.RecordBatch]:
    """Of a task's rows (batch, hop, rel, src, dst), in the order of batches: they and the numbers of both ends among the batch's nodes of their
    kind, in the order of ids; or the nodes.  ends: the kinds of each rel's ends.  A batch is held at once, no more."""
    held: list[pa.RecordBatch] = []
    for part in rows:
        if not part.num_rows:
            continue
        batch = np.asarray(part.column(0))
        if held and batch[-1] == held[0].column(0)[0].as_py():
            held.append(part)
            continue
        cut = int(np.searchsorted(batch, batch[-1]))
        if held or cut:
            yield numbered(pa.Table.from_batches([*held, part.slice(0, cut)]), ends, nodes)
        held = [part.slice(cut)]
    if held:
        yield numbered(pa.Table.from_batches(held), ends, nodes)


def numbered(rows: pa.Table, ends: np.ndarray, nodes: bool) -> pa.RecordBatch:
    """located's result for whole batches; a null end is a node, but a row with one is left out."""
    batch, hop, rel = (np.asarray(rows.column(i).combine_chunks()) for i in range(3))
    both = [rows.column(i).combine_chunks() for i in (3, 4)]
    ids, none = np.concatenate([np.asarray(c.fill_null(0)) for c in both]), np.concatenate([np.asarray(c.is_null()) for c in both])
    kind, of = np.concatenate([ends[rel, 0], ends[rel, 1]]), np.concatenate([batch, batch])
    order = np.lexsort((ids, ~none, kind, of))
    ids_, none_, kind_, of_ = ids[order], none[order], kind[order], of[order]
    group = np.append(True, (of_[1:] != of_[:-1]) | (kind_[1:] != kind_[:-1]))
    new = group | np.append(True, (ids_[1:] != ids_[:-1]) | (none_[1:] != none_[:-1]))
    node = np.cumsum(new) - 1
    place = node - np.maximum.accumulate(np.where(group, node, 0))
    if nodes:
        return pa.RecordBatch.from_arrays([pa.array(of_[new]), pa.array(kind_[new]), pa.array(place[new]), pa.array(ids_[new], mask=none_[new])], ["batch", "kind", "local", "id"])
    local = np.empty(len(order), np.int64)
    local[order] = place
    n, keep = len(batch), ~(none[: len(batch)] | none[len(batch) :])
    columns = [batch, hop, rel, ids[:n], local[:n], ids[n:], local[n:]]
    return pa.RecordBatch.from_arrays([pa.array(c[keep]) for c in columns], ["batch", "hop", "rel", "src", "src_local", "dst", "dst_local"])


def link_batches(links: DataFrame, relation: Relation, edges: Adjacency, size: int = 1024, fanouts: Sequence[int] = (10, 5), seed: int = 42, shuffle: bool = True) -> Batches:
    """Batches of `size` links (src, dst) of a relation (the last may be smaller), in the order of a seeded draw or else of their ends, each with
    both ends' surroundings: hop by hop, the edges into nodes that are new to the batch, at most a fanout of each relation.

    edges should hold what a phase may see only: train's links, not those that are asked (see prepare)."""
    if size < 1 or min(fanouts, default=1) < 1:
        raise ValueError("a batch needs a size, and each hop a fanout, of 1 at least")
    drawn = links.select(F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst"))
    keys = ["src", "dst"]
    if shuffle:
        drawn, keys = drawn.withColumn("_draw", X.draw(seed, F.lit("batch"), F.col("src"), F.col("dst"), below=2**40)), ["_draw", *keys]
    kinds, known = kinds_of(edges, relation[0], relation[2]), (*edges.relations, relation)  # a link's rel is the last
    ends = np.array([[kinds.index(r[0]), kinds.index(r[2])] for r in known], np.int8)

    def rows(df: DataFrame, hop: int) -> DataFrame:
        return df.select(F.col("batch"), F.lit(hop).alias("hop"), F.col("rel").cast("byte").alias("rel"), "src", "dst")

    def reached(df: DataFrame, end: int) -> DataFrame:
        return df.select("batch", "hop", looked_up("rel", ends[:, end].tolist()).cast("byte").alias("kind"), F.col(("src", "dst")[end]).alias("id"))

    numbers = surrogate_keys(drawn, keys, "_at")  # kept on disk there
    tasks = -(-numbers.count() // TASK_LINKS)
    found = [rows(numbers.select(F.floor(F.col("_at") / size).alias("batch"), F.lit(len(known) - 1).alias("rel"), "src", "dst"), 0)]
    seen = reached(found[0], 0).unionByName(reached(found[0], 1))
    for hop, most in enumerate(fanouts, 1):
        first = spread(seen, tasks, "batch").groupBy("batch", "kind", "id").agg(F.min("hop").alias("hop"))
        got = rows(picked(edges, first.where(F.col("hop") == hop - 1), kinds, most, seed + hop, tasks), hop)
        found.append(got.persist(StorageLevel.DISK_ONLY))  # the next hop, links, nodes and edges read it
        seen = seen.unionByName(reached(found[-1], 0))
    # all that a batch has meets once; its nodes are bounded by size and fanouts
    whole = reduce(DataFrame.unionByName, found)
    laid = spread(whole.repartition("batch"), tasks, "batch").sortWithinPartitions("batch")
    full = laid.mapInArrow(lambda part: located(part, ends, False), "batch long, hop int, rel byte, src long, src_local long, dst long, dst_local long")
    nodes = laid.mapInArrow(lambda part: located(part, ends, True), "batch long, kind byte, local long, id long")
    around = spelled(full.where("hop > 0"), known).select("batch", "hop", "relation", "src_type", "src", "src_local", "dst_type", "dst", "dst_local")
    return Batches(full.where("hop = 0").select("batch", "src", "dst", "src_local", "dst_local"), nodes.select("batch", looked_up("kind", kinds).alias("type"), "local", "id"), around)


@dataclass(frozen=True)
class Prepared:
    """split: (src, dst, split); known: (phase, src, dst) that a phase's negatives avoid; graph: with train's links only; degrees: end -> (id, degree)
    in train; batches: train, val and test."""

    split: DataFrame
    metadata: Mapping[str, object]
    known: DataFrame
    graph: KnowledgeGraph
    degrees: Mapping[str, DataFrame]
    batches: Mapping[str, Batches]


def prepare(
    graph: KnowledgeGraph, relation: Relation, val: float = 0.1, test: float = 0.1, seed: int = 42, strategy: str = "stratified", bins: int = 8, cover: bool = True,
    size: int = 4096, fanouts: Sequence[int] = (10, 5), load_path: str | None = None, save_path: str | None = None,
) -> Prepared:
    """All that training and evaluation need of a graph: a relation's links split or a split artifact loaded and checked, the graph without the links of
    val and test (in either direction), what each phase knows, and batches of each phase.

    Train is shuffled by the seed, val and test draw their surroundings by the next seeds; all see train's links only.  ValueError for an
    unknown strategy, or an artifact of another graph."""
    if (strategy := strategy.strip().lower()) not in ("stratified", "random"):
        raise ValueError(f"the strategy is stratified or random, not {strategy}")
    links = graph.relations[relation]
    if load_path:
        split, metadata = S.load_split(links.sparkSession, load_path)
        protocol.assert_compatible(split, metadata, graph.nodes, links, relation)
        seed = int(metadata.get("seed", seed))  # type: ignore[call-overload]
    else:
        split, used = splits.split_edges(links.select("src", "dst"), val, test, bins, seed, strategy == "stratified", cover)
        split = settled(split.select("src", "dst", "split"))
        metadata = protocol.split_metadata(split, graph.nodes, relation, seed, val, test, used, bins, cover)
    if save_path:
        S.save_split(split, metadata, save_path)
    part = {p: split.where(F.col("split") == p).select("src", "dst") for p in ("train", "val", "test")}
    seen = graph.with_relation(relation, links.join(part["train"], ["src", "dst"], "left_semi").select(links.columns))
    edges = adjacency(seen.relations, seed)
    batches = {p: link_batches(df, relation, edges, size, fanouts, seed + k, p == "train") for k, (p, df) in enumerate(part.items())}
    degrees = {end: part["train"].groupBy(F.col(end).alias("id")).agg(F.count("*").alias("degree")) for end in ("src", "dst")}
    return Prepared(split, metadata, splits.known_by_phase(split), seen, degrees, batches)
