"""Vectors that follow their graph: the vectors of every layer are kept beside digests of nodes and of their incoming edges, and after a
change only what the change can reach is encoded anew.

relations: (source kind, name, target kind) -> (src, dst, attributes).  Vectors of a kind: (id, z array<double>), one row a node.
"""

from __future__ import annotations

import hashlib
import json
import re
import tempfile
from collections.abc import Callable, Mapping
from dataclasses import dataclass, field, fields, is_dataclass
from functools import reduce

import numpy as np
from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kilngraph.operators import layers as L
from kilngraph.operators import propagate
from kilngraph.operators.graph import Relation

Frames = Mapping[str, DataFrame]
PRINTS = ["own1", "own2", "n", "into1", "into2"]
STATE_SCHEMA = "id long, z array<double>, kind string, layer int"
PRINT_SCHEMA = "id long, own1 long, own2 long, n long, into1 decimal(38,0), into2 decimal(38,0), kind string"


@dataclass(frozen=True)
class Encoding:
    """How vectors come from a graph.  name tells encoders of other weights apart; inputs: kind -> (id, z) of its nodes;
    first(kind, inputs) -> (id, z); layer(i, h, relations, counted) -> kind -> (id, z), where a node's vector may depend on its own of h, on its
    incoming edges and on their sources' vectors of h only, and counted are the names of the relations that have edges."""

    name: str
    layers: int
    inputs: Frames
    first: Callable[[str, DataFrame], DataFrame]
    layer: Callable[[int, Frames, Mapping[Relation, DataFrame], frozenset[str]], Frames]


@dataclass(frozen=True)
class Cache:
    """states: kind -> vectors of each layer, the first ones first; prints: kind -> (id, digests of its input and of its incoming edges).
    free() gives back what is kept on the executors' disks; a cache that was refreshed from another one reads that one."""

    name: str
    counted: frozenset[str]
    states: Mapping[str, tuple[DataFrame, ...]]
    prints: Frames
    kept: list[DataFrame] = field(default_factory=list)

    @property
    def z(self) -> dict[str, DataFrame]:
        return {k: frames[-1] for k, frames in self.states.items()}

    def free(self) -> None:
        for df in self.kept:
            df.unpersist()


def digest_of(*things: object) -> str:
    """A SHA-256 of arrays, numbers, strings and of dataclasses, mappings and sequences of them."""
    out = hashlib.sha256()

    def add(x: object) -> None:
        if is_dataclass(x):
            x = {f.name: getattr(x, f.name) for f in fields(x)}
        if isinstance(x, np.ndarray):
            out.update(f"array {x.dtype} {x.shape};".encode() + np.ascontiguousarray(x).tobytes())
        elif isinstance(x, Mapping):
            out.update(f"mapping {len(x)};".encode())
            for key in sorted(x, key=str):
                add(str(key))
                add(x[key])
        elif isinstance(x, (list, tuple)):
            out.update(f"sequence {len(x)};".encode())
            for one in x:
                add(one)
        else:
            out.update(f"{type(x).__name__} {x!r};".encode())

    add(things)
    return out.hexdigest()


def attention_encoding(model: L.Model, inputs: Frames, attributes: Mapping[Relation, list[str]] | None = None, slice_rows: int = L.SLICE_ROWS) -> Encoding:
    """The layers of stored weights (see layers.encode).  inputs: a kind's features where the model projects them, else its learned rows."""

    def first(kind: str, rows: DataFrame) -> DataFrame:
        return L.initial(kind, model, rows, rows, rows)

    def layer(i: int, h: Frames, relations: Mapping[Relation, DataFrame], counted: frozenset[str]) -> Frames:
        L.check_graph(model, set(h), set(relations))
        return L.attention_conv(h, relations, model.layers[i], model.n_heads, attributes, True, slice_rows, counted)

    return Encoding(digest_of("attention", model, attributes or {}), len(model.layers), inputs, first, layer)


def mean_encoding(inputs: Frames, layers: int) -> Encoding:
    """Each layer is halfway between a node's vector and the mean over relations of its neighbours' means; nodes that no edge reaches keep theirs."""

    def layer(i: int, h: Frames, relations: Mapping[Relation, DataFrame], counted: frozenset[str]) -> Frames:
        means = propagate.relation_means(dict(h), dict(relations))
        half = F.zip_with("z", F.coalesce("_m", "z"), lambda a, b: (a + b) / 2)
        return {k: df.join(means[k].withColumnRenamed("z", "_m"), "id", "left").select("id", half.alias("z")) if k in means else df for k, df in h.items()}

    return Encoding(digest_of("mean", layers), layers, inputs, lambda kind, rows: rows.select("id", "z"), layer)


def prints_of(inputs: DataFrame, into: Mapping[Relation, DataFrame]) -> DataFrame:
    """(id, own1, own2, n, into1, into2) of a kind's nodes: two 64-bit hashes of the input, and of the incoming edges with all their attributes the
    number and the sums of two 64-bit hashes, which do not depend on the order of edges.  A hub's edges are summed before the shuffle."""
    own = [F.xxhash64(F.lit(k), "z").alias(f"own{k}") for k in (1, 2)]
    nodes = inputs.where("id is not null").select(F.col("id").cast("long").alias("id"), *own)
    rows = []
    for relation, edges in into.items():
        more = [F.col(f"`{c}`") for c in sorted(edges.columns) if c not in ("src", "dst")]
        facts = [F.lit("__".join(relation)), F.col("src").cast("long"), *more, *[c.isNull() for c in more]]  # a null leaves a hash as it is
        rows.append(edges.where("src is not null and dst is not null").select(F.col("dst").cast("long").alias("id"), *[F.xxhash64(F.lit(k), *facts).cast("decimal(20,0)").alias(f"h{k}") for k in (1, 2)]))
    zero = F.lit(0).cast("decimal(38,0)")
    if not rows:
        return nodes.select("id", "own1", "own2", F.lit(0).cast("long").alias("n"), zero.alias("into1"), zero.alias("into2"))
    sums = [F.sum(f"h{k}").cast("decimal(38,0)").alias(f"into{k}") for k in (1, 2)]
    edges = reduce(DataFrame.unionByName, rows).groupBy("id").agg(F.count("*").alias("n"), *sums)
    filled = [F.coalesce("n", F.lit(0).cast("long")).alias("n"), *[F.coalesce(f"into{k}", zero).alias(f"into{k}") for k in (1, 2)]]
    return nodes.join(edges, "id", "left").select("id", "own1", "own2", *filled)


def all_prints(encoding: Encoding, relations: Mapping[Relation, DataFrame]) -> dict[str, DataFrame]:
    return {k: prints_of(df, {r: e for r, e in relations.items() if r[2] == k}) for k, df in encoding.inputs.items()}


def with_edges(relations: Mapping[Relation, DataFrame]) -> frozenset[str]:
    return frozenset("__".join(r) for r, edges in relations.items() if edges.take(1))


def changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """(id, own, into): nodes whose input is another one, is new or has gone, and nodes whose incoming edges have changed."""
    a, b = (df.select("id", F.struct("own1", "own2").alias(f"{n}_own"), F.struct("n", "into1", "into2").alias(f"{n}_into")) for df, n in ((old, "a"), (new, "b")))
    differ = lambda c: ~F.col(f"a_{c}").eqNullSafe(F.col(f"b_{c}"))
    return a.join(b, "id", "full").select("id", differ("own").alias("own"), differ("into").alias("into")).where("own or into")


def stale(old: Frames, new: Frames, relations: Mapping[Relation, DataFrame], layers: int) -> dict[str, list[DataFrame]]:
    """kind -> for the first vectors and for each layer the nodes (id) whose vectors may have changed: those with another input, from the first layer
    on those with other incoming edges, and those that an edge reaches from a stale source of the layer before."""
    changed = {k: checkpointed(changes(old[k], new[k])) for k in new}
    out = {k: [df.where("own").select("id")] for k, df in changed.items()}
    for i in range(1, layers + 1):
        step = {}
        for k, df in changed.items():
            found = [out[k][i - 1], df.where("into").select("id")]
            for r, edges in relations.items():
                if r[2] == k:
                    found.append(edges.join(out[r[0]][i - 1].withColumnRenamed("id", "src"), "src", "left_semi").select(F.col("dst").cast("long").alias("id")))
            step[k] = checkpointed(reduce(DataFrame.unionByName, found).distinct())
        for k, df in step.items():
            out[k].append(df)
    return out


def checkpointed(df: DataFrame) -> DataFrame:
    """df written to the folder all executors share, spark.checkpoint.dir; its lineage ends there.  Where no folder is set, as in tests, one
    of this machine will do in local mode; a cluster gets an error."""
    spark = df.sparkSession
    if not spark.sparkContext.getCheckpointDir():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder:
            if not re.fullmatch(r"local(\[[\w*, ]+\])?", spark.sparkContext.master):
                raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
            folder = f"file://{tempfile.gettempdir()}/kiln-checkpoints"
        spark.sparkContext.setCheckpointDir(folder)
    return df.checkpoint()


def held(df: DataFrame, kept: list[DataFrame]) -> DataFrame:
    df = df.persist(StorageLevel.DISK_ONLY)
    kept.append(df)
    return df


def build(encoding: Encoding, relations: Mapping[Relation, DataFrame]) -> Cache:
    """Everything encoded from the start."""
    counted = with_edges(relations)
    h = {k: checkpointed(encoding.first(k, df)) for k, df in encoding.inputs.items()}
    states = {k: [df] for k, df in h.items()}
    for i in range(encoding.layers):
        h = {k: checkpointed(df) for k, df in encoding.layer(i, h, relations, counted).items()}
        for k, df in h.items():
            states[k].append(df)
    prints = {k: checkpointed(df) for k, df in all_prints(encoding, relations).items()}
    return Cache(encoding.name, counted, {k: tuple(v) for k, v in states.items()}, prints)


def refresh(cache: Cache, encoding: Encoding, relations: Mapping[Relation, DataFrame]) -> Cache:
    """The cache of the graph as it is now.  A layer is computed for its stale nodes alone, from their incoming edges and the kept vectors
    of the layer before; all other vectors are taken over.  Other weights, kinds, or relations that have got their first or lost their last edge
    (a layer's mean counts relations) build all anew."""
    counted = with_edges(relations)
    if (cache.name, cache.counted, set(cache.states)) != (encoding.name, counted, set(encoding.inputs)):
        return build(encoding, relations)
    kept: list[DataFrame] = []
    prints = {k: checkpointed(df) for k, df in all_prints(encoding, relations).items()}
    reach = stale(cache.prints, prints, relations, encoding.layers)
    states: dict[str, list[DataFrame]] = {k: [] for k in encoding.inputs}
    for i in range(encoding.layers + 1):
        asked = {k: frames[i] for k, frames in reach.items()}
        if i == 0:
            new = {k: encoding.first(k, df.join(asked[k], "id", "left_semi")) for k, df in encoding.inputs.items()}
        else:
            near = {r: held(edges.join(asked[r[2]].withColumnRenamed("id", "dst"), "dst", "left_semi"), kept) for r, edges in relations.items()}
            h = {}
            for k in encoding.inputs:
                ends = [asked[k], *[e.select(F.col("src").cast("long").alias("id")) for r, e in near.items() if r[0] == k]]
                h[k] = held(states[k][i - 1].join(reduce(DataFrame.unionByName, ends).distinct(), "id", "left_semi"), kept)
            new = {k: df.join(asked[k], "id", "left_semi") for k, df in encoding.layer(i - 1, h, near, counted).items()}
        for k, df in new.items():
            states[k].append(checkpointed(cache.states[k][i].join(asked[k], "id", "left_anti").unionByName(df.select("id", "z"))))
    return Cache(encoding.name, counted, {k: tuple(v) for k, v in states.items()}, prints, kept)


def save(cache: Cache, path: str) -> None:
    """Written to a new folder; the description comes last, so that a writing that was cut off is not a cache."""
    states = [df.select("id", "z", F.lit(k).alias("kind"), F.lit(i).alias("layer")) for k, frames in cache.states.items() for i, df in enumerate(frames)]
    reduce(DataFrame.unionByName, states).write.partitionBy("kind", "layer").parquet(f"{path}/states")
    reduce(DataFrame.unionByName, [df.select("id", *PRINTS, F.lit(k).alias("kind")) for k, df in cache.prints.items()]).write.partitionBy("kind").parquet(f"{path}/prints")
    about = {"type": "vectors", "version": 1, "name": cache.name, "counted": sorted(cache.counted), "layers": {k: len(v) for k, v in cache.states.items()}}
    spark = next(iter(cache.prints.values())).sparkSession
    spark.createDataFrame([(json.dumps(about),)], "value string").coalesce(1).write.text(f"{path}/about")


def load(spark: SparkSession, path: str) -> Cache:
    """ValueError if it is not a cache."""
    lines = [r[0] for r in spark.read.text(f"{path}/about").limit(2).collect()]
    about = json.loads(lines[0]) if lines else {}
    if about.get("type") != "vectors" or about.get("version") != 1:
        raise ValueError("not a cache of vectors of version 1")
    states, prints = spark.read.schema(STATE_SCHEMA).parquet(f"{path}/states"), spark.read.schema(PRINT_SCHEMA).parquet(f"{path}/prints")
    of = lambda k, i: states.where((F.col("kind") == k) & (F.col("layer") == i)).select("id", "z")
    frames = {k: tuple(of(k, i) for i in range(n)) for k, n in about["layers"].items()}
    return Cache(about["name"], frozenset(about["counted"]), frames, {k: prints.where(F.col("kind") == k).select("id", *PRINTS) for k in frames})
