"""Heterogeneous attention layers from stored weights: encode a typed graph, capture attention, score links by relation.

A layer never holds a target's edges together.  Messages of a batch are reduced to one partial a target: the largest logit of each head, the
sum of exponentials below it and the messages' weighted sum.  Partials merge in any order (the smaller maximum's sums are rescaled), so
a target's edges may lie in many tasks; targets with more than `slice_rows` edges are cut into slices for the joins as well.  Partials of all
relations and the nodes' own vectors meet in one shuffle by node, where the layer's output, residual, norm and GELU follow.

h: kind -> (id, z array<double>); relations: (source kind, name, target kind) -> (src, dst, attributes).
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Mapping
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kilngraph.functions import expressions as X
from kilngraph.operators.graph import Relation

#: Edges of a target beyond which it is cut into slices.
SLICE_ROWS = 200_000
#: Targets with slices whose list may be broadcast.
HOT_TARGETS = 100_000
VECTOR = "id long, z array<double>"
Linear = tuple[np.ndarray, np.ndarray]


# ---- weights ----------------------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Gate:
    """A vector for each edge that its message is multiplied with: rows of embeddings by the edge's codes and its numbers, side by side, through
    one or two linear maps (GELU between them) and a sigmoid.  clamp: codes beyond a table count as its nearest; else they are an error."""

    embeddings: tuple[np.ndarray, ...]
    linears: tuple[Linear, ...]
    clamp: bool = False

    @property
    def width(self) -> int:
        """Attributes of an edge: a code for each table, then numbers."""
        return len(self.embeddings) + self.linears[0][0].shape[1] - sum(e.shape[1] for e in self.embeddings)

    def of(self, attributes: np.ndarray) -> np.ndarray:
        if attributes.shape[1] != self.width:
            raise ValueError(f"a gate takes {self.width} attributes, edges have {attributes.shape[1]}")
        parts = []
        for k, rows in enumerate(self.embeddings):
            codes = np.clip(attributes[:, k], 0, len(rows) - 1) if self.clamp else attributes[:, k]
            if len(codes) and not (codes.min() >= 0 and codes.max() < len(rows)):
                raise ValueError(f"an edge's code is not within 0 to {len(rows) - 1}")
            parts.append(rows[codes.astype(np.int64)])
        x = np.concatenate([*parts, attributes[:, len(self.embeddings) :]], axis=1)
        for k, linear in enumerate(self.linears):
            x = affine(gelu(x) if k else x, linear)
        return 1.0 / (1.0 + np.exp(-x))


@dataclass(frozen=True)
class RelationWeights:
    src: Linear
    dst: Linear
    attention: np.ndarray  # heads x width of a head
    gate: Gate | None = None


@dataclass(frozen=True)
class LayerWeights:
    relations: Mapping[str, RelationWeights]
    out: Mapping[str, Linear]
    norm: Mapping[str, Linear]


@dataclass(frozen=True)
class Model:
    """layers; input: kind -> (linear, norm) where a kind has features; heads: relation -> matrix of the bilinear decoder."""

    width: int
    n_heads: int
    layers: tuple[LayerWeights, ...]
    input: Mapping[str, tuple[Linear, Linear]] = field(default_factory=dict)
    decoders: Mapping[str, np.ndarray] = field(default_factory=dict)

    def shape(self) -> dict[str, object]:
        """What a caller needs to know: widths, heads, layers, features of kinds, codes of gates."""
        gates = {r: [len(e) for e in w.gate.embeddings] for r, w in self.layers[0].relations.items() if w.gate}
        return {"width": self.width, "heads": self.n_heads, "layers": len(self.layers), "features": {k: v[0][0].shape[1] for k, v in self.input.items()}, "codes": gates}


def affine(x: np.ndarray, linear: Linear) -> np.ndarray:
    return x @ linear[0].T + linear[1]


_erf = np.frompyfunc(math.erf, 1, 1)


def gelu(x: np.ndarray) -> np.ndarray:
    """x times the normal distribution's share below x."""
    return 0.5 * x * (1.0 + _erf(x / math.sqrt(2.0)).astype(np.float64))


def layer_norm(x: np.ndarray, norm: Linear, least: float = 1e-5) -> np.ndarray:
    centred = x - x.mean(1, keepdims=True)
    return centred / np.sqrt((centred**2).mean(1, keepdims=True) + least) * norm[0] + norm[1]


# The names that weights have in a stored model.  {i} is a layer, {r} a relation's three parts joined by '__', {k} a kind of node.
NAMES = {
    "src": "convs.{i}.lin_src.{r}", "dst": "convs.{i}.lin_dst.{r}", "attention": "convs.{i}.attn_{r}", "out": "convs.{i}.lin_out.{k}", "norm": "norms.{i}.{k}",
    "coded gate": "convs.{i}.lin_edge_cat.{r}", "numbers gate": "convs.{i}.lin_edge_cont.{r}", "mixed gate": "convs.{i}.edge_gate_proj.{r}", "mixed codes": "convs.{i}.edge_cat_embs.{r}",
    "actions": "convs.{i}.action_type_emb.weight", "subjects": "convs.{i}.action_subject_emb.weight", "phenotype actions": "convs.{i}.pheno_action_emb.weight",
    "features": "node_proj.{k}", "rows": "node_emb.{k}.weight", "first decoder": "W_cd", "decoder": "rel_weights.{r}",
}
#: The relation of the first decoder, those with an action and a subject, those with a phenotype action, kinds beyond the core.
FIRST = ("chemical", "associated_with", "disease")
ACTIONS = frozenset({"chemical__affects__gene", "gene__rev_affects__chemical"})
EXTENDED = frozenset({"pathway", "go_term"})


def model_of(state: Mapping[str, np.ndarray]) -> Model:
    """The model that stored weights describe; ValueError where their shapes contradict each other or something is missing.

    Names may have a prefix (encoder., head.)."""
    state = {n.removeprefix("encoder.").removeprefix("head."): np.asarray(w, np.float64) for n, w in state.items()}
    own = [n.split(".attn_", 1) for n in state if ".attn_" in n]
    if not own:
        raise ValueError("the weights have no attention rows (convs.0.attn_...)")
    n_layers = 1 + max(int(a.split(".")[1]) for a, _ in own)
    relations = sorted({r for _, r in own})
    kinds = sorted({n.split(".")[2] for n in state if n.startswith("norms.")})
    n_heads, part = state[NAMES["attention"].format(i=0, r=relations[0])].shape[-2:]
    width = n_heads * part

    def get(name: str, *shape: int) -> np.ndarray:
        if name not in state:
            raise ValueError(f"the weights have no {name}")
        if len(shape) != state[name].ndim or any(a not in (0, b) for a, b in zip(shape, state[name].shape, strict=True)):
            raise ValueError(f"{name} has shape {state[name].shape}, not {shape}")
        return state[name]

    def linear(name: str, n_out: int, n_in: int = 0) -> Linear:
        return get(f"{name}.weight", n_out, n_in), get(f"{name}.bias", n_out)

    def gate(i: int, r: str) -> Gate | None:
        coded, numbers, mixed = (NAMES[f"{k} gate"].format(i=i, r=r) for k in ("coded", "numbers", "mixed"))
        if f"{coded}.0.weight" in state:
            tables = ("actions", "subjects") if r in ACTIONS else ("phenotype actions",)
            rows = tuple(get(NAMES[t].format(i=i), 0, 0) for t in tables)
            return Gate(rows, (linear(f"{coded}.0", width, sum(e.shape[1] for e in rows)),))
        if f"{numbers}.0.weight" in state:
            return Gate((), (linear(f"{numbers}.0", width), linear(f"{numbers}.2", width, width)))
        if f"{mixed}.0.weight" in state:
            stem, rows = NAMES["mixed codes"].format(i=i, r=r), []
            while f"{stem}.{len(rows)}.weight" in state:
                rows.append(get(f"{stem}.{len(rows)}.weight", 0, 0))
            return Gate(tuple(rows), (linear(f"{mixed}.0", width), linear(f"{mixed}.2", width, width)), clamp=True)
        return None

    layers = []
    for i in range(n_layers):
        found = {r: RelationWeights(linear(NAMES["src"].format(i=i, r=r), width, width), linear(NAMES["dst"].format(i=i, r=r), width, width), get(NAMES["attention"].format(i=i, r=r), 1, n_heads, part)[0], gate(i, r)) for r in relations}
        norm = {k: (get(NAMES["norm"].format(i=i, k=k) + ".weight", width), get(NAMES["norm"].format(i=i, k=k) + ".bias", width)) for k in kinds}
        layers.append(LayerWeights(found, {k: linear(NAMES["out"].format(i=i, k=k), width, width) for k in kinds}, norm))
    stems = {k: NAMES["features"].format(k=k) for k in kinds if NAMES["features"].format(k=k) + ".0.weight" in state}
    given = {k: (linear(f"{s}.0", width), (get(f"{s}.1.weight", width), get(f"{s}.1.bias", width))) for k, s in stems.items()}
    decoders = {n.removeprefix("rel_weights."): get(n, width, width) for n in state if n.startswith("rel_weights.")}
    if NAMES["first decoder"] in state:
        decoders["__".join(FIRST)] = get(NAMES["first decoder"], width, width)
    return Model(width, n_heads, tuple(layers), given, decoders)


def check_graph(model: Model, kinds: set[str], relations: set[Relation]) -> None:
    """ValueError, with the names, where a graph and a model don't go together."""
    known = set(model.layers[0].norm)
    if kinds & EXTENDED and not known & EXTENDED:
        raise ValueError(f"the weights are of the core graph, but the graph has {sorted(kinds & EXTENDED)}: leave these out or take weights of the extended graph")
    if known & EXTENDED and not kinds & EXTENDED:
        raise ValueError(f"the weights are of the extended graph, but the graph lacks {sorted(known & EXTENDED)}")
    if unknown := sorted(kinds - known):
        raise ValueError(f"the weights don't know nodes of {unknown}")
    if unknown := sorted({"__".join(r) for r in relations} - set(model.layers[0].relations)):
        raise ValueError(f"the weights don't know relations {unknown}")


# ---- one layer --------------------------------------------------------------------------------------------------------


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """Rows of an array column, all of one width, as a matrix."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False)
    if len(flat) != width * len(column):
        raise ValueError(f"vectors are not all of width {width}")
    return flat.reshape(len(column), width)


def lists(x: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(np.ascontiguousarray(x).ravel()))


def mapped(h: DataFrame, of, width: int) -> DataFrame:
    """(id, z) with z = of(matrix of z), batch by batch."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("id"), lists(of(matrix(batch.column("z"), width)))], ["id", "z"])

    return h.select(F.col("id").cast("long").alias("id"), "z").mapInArrow(each, VECTOR)


def initial(kind: str, model: Model, features: DataFrame | None, rows: DataFrame | None, nodes: DataFrame) -> DataFrame:
    """(id, z) of a kind's nodes (id): their features (id, z) through the model's projection, norm and GELU, or else their learned rows (id, z)."""
    if kind in model.input:
        if features is None:
            raise ValueError(f"nodes of {kind} need features")
        linear, norm = model.input[kind]
        return mapped(features.join(nodes.select("id"), "id", "left_semi"), lambda x: gelu(layer_norm(affine(x, linear), norm)), linear[0].shape[1])
    if rows is None:
        raise ValueError(f"the weights have neither a projection nor rows for nodes of {kind}")
    return rows.select("id", "z").join(nodes.select("id"), "id", "left_semi")


def edge_messages(h: Mapping[str, DataFrame], relation: Relation, edges: DataFrame, weights: RelationWeights, width: int, attributes: list[str], slice_rows: int) -> DataFrame:
    """(src, dst, attributes, zs, zt): edges with both ends' projected vectors.  A target with many edges is cut into slices, each with a copy
    of the target's vector, so that no task gets all of its edges."""
    source, _, target = relation
    a = mapped(h[source], lambda x: affine(x, weights.src), width).select(F.col("id").alias("src"), F.col("z").alias("zs"))
    b = mapped(h[target], lambda x: affine(x, weights.dst), width).select(F.col("id").alias("dst"), F.col("z").alias("zt"))
    attribute = F.array(*[F.col(f"`{c}`").cast("double") for c in attributes]) if attributes else F.array().cast("array<double>")
    rows = edges.select(F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst"), attribute.alias("attributes"))
    hot = rows.groupBy("dst").agg(F.count("*").alias("n")).where(F.col("n") > slice_rows).select("dst", F.ceil(F.col("n") / slice_rows).cast("int").alias("slices"))
    few = hot.limit(HOT_TARGETS + 1).count()
    if few:
        hot = F.broadcast(hot) if few <= HOT_TARGETS else hot
        rows = rows.join(hot, "dst", "left").withColumn("slice", F.pmod(F.xxhash64("src"), F.coalesce("slices", F.lit(1))).cast("int")).drop("slices")
        b = b.join(hot, "dst", "left").withColumn("slice", F.explode(F.sequence(F.lit(0), F.coalesce("slices", F.lit(1)) - 1))).drop("slices")
    return rows.join(a, "src").join(b, ["dst", "slice"] if few else ["dst"]).select("src", "dst", "attributes", "zs", "zt")


def logits_and_messages(batch: pa.RecordBatch, weights: RelationWeights, heads: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(edges x heads, edges x heads x width of a head)"""
    zs, zt = (matrix(batch.column(c), width).reshape(-1, heads, width // heads) for c in ("zs", "zt"))
    message = zs + zt
    if weights.gate is not None:
        message = message * weights.gate.of(matrix(batch.column("attributes"), weights.gate.width)).reshape(message.shape)
    return (zs * zt).sum(2) / math.sqrt(width // heads) + (message * weights.attention).sum(2), message


def merged(key: np.ndarray, most: np.ndarray, total: np.ndarray, vector: np.ndarray) -> tuple[np.ndarray, ...]:
    """(first row of each run of equal keys, and the run's maximum, sum and vector): partials of one softmax put together."""
    starts = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    top = np.maximum.reduceat(most, starts)
    run = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(key))))
    scale = np.exp(most - top[run])
    return starts, top, np.add.reduceat(total * scale, starts), np.add.reduceat(vector * scale[:, :, None], starts)


def partials(messages: DataFrame, number: int, weights: RelationWeights, heads: int, width: int) -> DataFrame:
    """(id, relation, p): of each batch one partial a target; p has the heads' maxima, sums and vectors, one after the other."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            logits, message = logits_and_messages(batch, weights, heads, width)
            dst = batch.column("dst").to_numpy()
            order = np.argsort(dst, kind="stable")
            starts, top, total, vector = merged(dst[order], logits[order], np.ones_like(logits), message[order])
            p = np.concatenate([top, total, vector.reshape(len(starts), -1)], axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(dst[order][starts]), pa.array(np.full(len(starts), number, np.int32)), lists(p)], ["id", "relation", "p"])

    return messages.mapInArrow(each, "id long, relation int, p array<double>")


def attention_conv(
    h: Mapping[str, DataFrame], relations: Mapping[Relation, DataFrame], layer: LayerWeights, heads: int, attributes: Mapping[Relation, list[str]] | None = None,
    finish: bool = False, slice_rows: int = SLICE_ROWS, counted: frozenset[str] | None = None,
) -> dict[str, DataFrame]:
    """h after one layer: of every node the mean over the relations that reach its kind (0 from those that don't reach the node itself), through the
    kind's output map.  Kinds that no relation reaches stay as they are.  finish: gelu(norm(result + h)), of all kinds.

    Relations without weights or without edges don't count.  counted: the names of the relations that have edges, where relations are a part of
    the graph."""
    attributes = attributes or {}
    width = next(iter(layer.out.values()))[0].shape[0]
    if width % heads:
        raise ValueError(f"a width of {width} can't be cut into {heads} heads")
    used = [r for r, edges in relations.items() if "__".join(r) in layer.relations and ("__".join(r) in counted if counted is not None else edges.take(1))]
    out: dict[str, DataFrame] = {}
    for kind, own in h.items():
        into = [r for r in used if r[2] == kind]
        if not into and not finish:
            out[kind] = own
            continue
        zeros = F.array_repeat(F.lit(0.0), 2 * heads)
        rows = [own.select(F.col("id").cast("long").alias("id"), F.lit(-1).alias("relation"), F.concat(zeros, F.col("z").cast("array<double>")).alias("p"))]
        for k, r in enumerate(into):
            weights = layer.relations["__".join(r)]
            asked = attributes.get(r, []) if weights.gate is not None else []
            if weights.gate is not None and not asked:  # edges that bring no attributes have no gate
                weights = RelationWeights(weights.src, weights.dst, weights.attention)
            rows.append(partials(edge_messages(h, r, relations[r], weights, width, asked, slice_rows), k, weights, heads, width))
        laid = reduce(DataFrame.unionByName, rows).repartition("id").sortWithinPartitions("id", "relation")
        out[kind] = laid.mapInArrow(finisher(len(into), heads, width, layer.out[kind], layer.norm.get(kind) if finish else None), VECTOR)
    return out


def finisher(n: int, heads: int, width: int, linear: Linear, norm: Linear | None):
    """A function of sorted batches (id, relation, p): the nodes' new vectors.  An id's rows may go on in the next batch."""

    def settle(ids: np.ndarray, relation: np.ndarray, p: np.ndarray) -> pa.RecordBatch:
        own = relation < 0
        nodes, h = ids[own], p[own, 2 * heads :]
        x = h
        if n:
            x = np.zeros_like(h)
            if not own.all():
                key, part = ids[~own] * n + relation[~own], p[~own]
                starts, _, total, vector = merged(key, part[:, :heads], part[:, heads : 2 * heads], part[:, 2 * heads :].reshape(len(part), heads, -1))
                np.add.at(x, np.searchsorted(nodes, ids[~own][starts]), (vector / total[:, :, None]).reshape(len(starts), -1))
            x = affine(x / n, linear)
        return pa.RecordBatch.from_arrays([pa.array(nodes), lists(x if norm is None else gelu(layer_norm(x + h, norm)))], ["id", "z"])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple[np.ndarray, ...] | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            new = (batch.column("id").to_numpy(), batch.column("relation").to_numpy(), matrix(batch.column("p"), 2 * heads + width))
            held = new if held is None else tuple(np.concatenate(x) for x in zip(held, new, strict=True))
            cut = int(np.searchsorted(held[0], held[0][-1]))
            if cut:
                yield settle(*(x[:cut] for x in held))
                held = tuple(x[cut:] for x in held)
        if held is not None:
            yield settle(*held)

    return each


def edge_attention(h: Mapping[str, DataFrame], relation: Relation, edges: DataFrame, layer: LayerWeights, heads: int, attributes: list[str] | None = None, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """(src, dst, alpha): each edge's share of its target's softmax, the mean over heads."""
    weights = layer.relations["__".join(relation)]
    width = weights.src[0].shape[0]
    if weights.gate is not None and not attributes:
        weights = RelationWeights(weights.src, weights.dst, weights.attention)
    messages = edge_messages(h, relation, edges, weights, width, (attributes or []) if weights.gate is not None else [], slice_rows)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            logits, _ = logits_and_messages(batch, weights, heads, width)
            yield pa.RecordBatch.from_arrays([batch.column("src"), batch.column("dst"), lists(logits)], ["src", "dst", "logits"])

    logits = messages.mapInArrow(each, "src long, dst long, logits array<double>")
    each_head = [F.get("logits", F.lit(k)) for k in range(heads)]
    most = logits.groupBy("dst").agg(*[F.max(c).alias(f"m{k}") for k, c in enumerate(each_head)])
    raised = logits.join(most, "dst").select("src", "dst", *[F.exp(c - F.col(f"m{k}")).alias(f"e{k}") for k, c in enumerate(each_head)])
    total = raised.groupBy("dst").agg(*[F.sum(f"e{k}").alias(f"s{k}") for k in range(heads)])
    alpha = reduce(lambda x, y: x + y, [F.col(f"e{k}") / F.col(f"s{k}") for k in range(heads)]) / heads
    return raised.join(total, "dst").select("src", "dst", alpha.alias("alpha"))


# ---- a whole model ----------------------------------------------------------------------------------------------------


def encode(
    model: Model, nodes: Mapping[str, DataFrame], relations: Mapping[Relation, DataFrame], features: Mapping[str, DataFrame] | None = None, rows: Mapping[str, DataFrame] | None = None,
    attributes: Mapping[Relation, list[str]] | None = None, keep=None, slice_rows: int = SLICE_ROWS,
) -> dict[str, DataFrame]:
    """kind -> (id, z) of all nodes after all layers.

    nodes: kind -> (id); features and rows: kind -> (id, z), see initial; attributes: the columns of a relation's edges that its gate takes, codes
    first.  keep: what is done with each layer's vectors, as several relations read them; by default checkpoint() where the context has a checkpoint
    folder, which cuts lineage, else they are kept on disk."""
    check_graph(model, set(nodes), set(relations))
    context = next(iter(nodes.values())).sparkSession.sparkContext
    keep = keep or ((lambda df: df.checkpoint()) if context.getCheckpointDir() else (lambda df: df.persist(StorageLevel.DISK_ONLY)))
    h = {k: keep(initial(k, model, (features or {}).get(k), (rows or {}).get(k), df)) for k, df in nodes.items()}
    for layer in model.layers:
        h = {k: keep(df) for k, df in attention_conv(h, relations, layer, model.n_heads, attributes, True, slice_rows).items()}
    return h


def score_links(model: Model, relation: Relation, z: Mapping[str, DataFrame], pairs: DataFrame) -> DataFrame:
    """pairs (src, dst, ...) with score = z_src' W z_dst and probability; KeyError for a relation without a decoder.  Pairs with an unknown end
    have nulls."""
    name = "__".join(relation)
    if name not in model.decoders:
        raise KeyError(f"the model has no decoder for {name}")
    w = model.decoders[name]
    a = mapped(z[relation[0]], lambda x: x @ w, model.width).select(F.col("id").alias("src"), F.col("z").alias("_a"))
    b = z[relation[2]].select(F.col("id").alias("dst"), F.col("z").alias("_b"))
    scored = pairs.join(a, "src", "left").join(b, "dst", "left").withColumn("score", X.dot(F.col("_a"), F.col("_b")))
    return scored.select(*pairs.columns, "score", X.sigmoid(F.col("score")).alias("probability"))


# ---- weights as tables ------------------------------------------------------------------------------------------------

#: Bytes of weights, but for nodes' rows, that the driver takes.
STATE_BYTES = 256 << 20


def weight_rows(spark, state: Mapping[str, np.ndarray]) -> DataFrame:
    """(name, shape, row, values): a row for each row of a weight (its first place; a vector is one row)."""
    rows = []
    for name, w in state.items():
        w = np.asarray(w, np.float64)
        flat = w.reshape(1, -1) if w.ndim < 2 else w.reshape(len(w), -1)
        rows += [(name, list(w.shape), k, r.tolist()) for k, r in enumerate(flat)]
    return spark.createDataFrame(rows, "name string, shape array<int>, row long, values array<double>")


def save_weights(weights: DataFrame, path: str) -> None:
    weights.write.mode("overwrite").partitionBy("name").parquet(path)


def is_node_row() -> F.Column:
    return F.col("name").rlike(r"(^|\.)node_emb\.")


def load_state(weights: DataFrame, limit: int = STATE_BYTES) -> dict[str, np.ndarray]:
    """All weights but nodes' rows, for model_of; ValueError where rows are missing, or where they are more than limit bytes."""
    small = weights.where(~is_node_row())
    size = small.agg(F.coalesce(F.sum(F.size("values")), F.lit(0)).alias("n")).first()["n"] * 8
    if size > limit:
        raise ValueError(f"{size} bytes of weights are more than {limit}")
    found: dict[str, dict[int, list[float]]] = {}
    shapes: dict[str, tuple[int, ...]] = {}
    for r in small.collect():
        found.setdefault(r["name"], {})[r["row"]] = r["values"]
        shapes[r["name"]] = tuple(r["shape"])
    out = {}
    for name, rows in found.items():
        flat = np.array([x for k in sorted(rows) for x in rows[k]])
        if len(flat) != math.prod(shapes[name]):
            raise ValueError(f"{name} lacks rows")
        out[name] = flat.reshape(shapes[name])
    return out


def node_rows(weights: DataFrame, kind: str) -> DataFrame:
    """(id, z): a kind's learned rows, which stay a table."""
    return weights.where(F.col("name").rlike(rf"(^|\.)node_emb\.{kind}\.weight$")).select(F.col("row").alias("id"), F.col("values").alias("z"))
