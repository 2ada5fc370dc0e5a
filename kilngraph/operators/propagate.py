"""Message passing as joins and aggregations.  h: (id, z array<double>); edges: (src, dst)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kilngraph.functions import expressions as X


def summed(vectors: DataFrame, key: str, z: str = "z") -> DataFrame:
    """(key, z): vectors summed place by place, with partial sums before the shuffle."""
    each = vectors.select(key, F.posexplode(z).alias("at", "x")).groupBy(key, "at").agg(F.sum("x").alias("x"))
    return each.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "x"))), lambda s: s["x"]).alias("z"))


def scaled(z: Column, by: Column) -> Column:
    return F.transform(z, lambda x: x * by)


def normalised_sum(h: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, z) of every target: its neighbours' vectors, each by 1 / sqrt(degree x degree), summed."""
    out_, in_ = edges.groupBy("src").agg(F.count("*").alias("d_src")), edges.groupBy("dst").agg(F.count("*").alias("d_dst"))
    weighed = edges.join(out_, "src").join(in_, "dst").select("src", "dst", X.symmetric_norm(F.col("d_src"), F.col("d_dst")).alias("w"))
    sent = weighed.join(h, weighed["src"] == h["id"]).select(F.col("dst"), scaled(F.col("z"), F.col("w")).alias("z"))
    return summed(sent, "dst").withColumnRenamed("dst", "id")


def neighbour_mean(h: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, z) of every target: the mean of its neighbours' vectors."""
    sent = edges.join(h, edges["src"] == h["id"]).select("dst", "z")
    total = summed(sent, "dst").join(sent.groupBy("dst").agg(F.count("*").alias("n")), "dst")
    return total.select(F.col("dst").alias("id"), scaled(F.col("z"), 1.0 / F.col("n")).alias("z"))


def edge_softmax(edges: DataFrame, logit: str, name: str = "alpha") -> DataFrame:
    """edges with the softmax of a logit over each target's edges; the maximum is taken off first.  Two aggregations with
    partial results and joins back, so a target with very many edges is never in one group."""
    most = edges.groupBy("dst").agg(F.max(logit).alias("_most"))
    raised = edges.join(most, "dst").withColumn("_e", F.exp(F.col(logit) - F.col("_most")))
    total = raised.groupBy("dst").agg(F.sum("_e").alias("_sum"))
    return raised.join(total, "dst").withColumn(name, F.col("_e") / F.col("_sum")).drop("_e", "_sum", "_most")


def attention(h_src: DataFrame, h_dst: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, z) of every target: one head of scaled dot-product attention over its incoming edges."""
    a, b = h_src.select(F.col("id").alias("src"), F.col("z").alias("_k")), h_dst.select(F.col("id").alias("dst"), F.col("z").alias("_q"))
    logits = edges.join(a, "src").join(b, "dst").select("src", "dst", "_k", (X.dot(F.col("_k"), F.col("_q")) / F.sqrt(F.size("_q").cast("double"))).alias("logit"))
    weighed = edge_softmax(logits, "logit")
    return summed(weighed.select("dst", scaled(F.col("_k"), F.col("alpha")).alias("z")), "dst").withColumnRenamed("dst", "id")


def relation_means(h: dict[str, DataFrame], relations: dict[tuple[str, str, str], DataFrame]) -> dict[str, DataFrame]:
    """Of every kind of node (id, z): the mean over the relations that reach a node of its neighbours' mean in each; nodes
    that no relation reaches are missing.  All kinds' vectors have one width."""
    out: dict[str, DataFrame] = {}
    for (a, _, b), edges in relations.items():
        got = neighbour_mean(h[a], edges)
        out[b] = got if b not in out else out[b].unionByName(got)
    return {b: mean_of(df) for b, df in out.items()}


def mean_of(rows: DataFrame) -> DataFrame:
    """(id, z): the mean of the rows (id, z) of an id."""
    total = summed(rows, "id").join(rows.groupBy("id").agg(F.count("*").alias("_n")), "id")
    return total.select("id", scaled(F.col("z"), 1.0 / F.col("_n")).alias("z"))


def projected(h: DataFrame, matrix: list[list[float]]) -> DataFrame:
    """(id, z W) for a small fixed matrix."""
    return h.select("id", X.times_matrix(F.col("z"), matrix).alias("z"))


def multi_head(h_src: DataFrame, h_dst: DataFrame, edges: DataFrame, heads: int, gate: Column | None = None) -> DataFrame:
    """(id, z) of every target: scaled dot-product attention over its incoming edges in each of the heads' equal slices of the
    vectors, the heads side by side.  gate: a column of edges that a message is multiplied with."""
    edges = edges.select("src", "dst", (F.lit(1.0) if gate is None else gate).alias("_gate"))
    both = edges.join(h_src.select(F.col("id").alias("src"), F.col("z").alias("_k")), "src").join(h_dst.select(F.col("id").alias("dst"), F.col("z").alias("_q")), "dst")
    width = (F.size("_k") / heads).cast("int")
    part = lambda c, i: F.slice(c, i * width + 1, width)
    each = both.select("src", "dst", "_gate", F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(heads - 1)), lambda i: F.struct(part(F.col("_k"), i).alias("k"), part(F.col("_q"), i).alias("q")))).alias("head", "p"))
    each = each.select("src", F.struct("dst", "head").alias("dst"), "_gate", F.col("p.k").alias("k"), (X.dot(F.col("p.k"), F.col("p.q")) / F.sqrt(F.size("p.k").cast("double"))).alias("logit"))
    weighed = edge_softmax(each, "logit").select("dst", scaled(F.col("k"), F.col("alpha") * F.col("_gate")).alias("z"))
    got = summed(weighed, "dst").select(F.col("dst.dst").alias("id"), F.struct(F.col("dst.head").alias("head"), "z").alias("p"))
    return got.groupBy("id").agg(F.flatten(F.transform(F.array_sort(F.collect_list("p")), lambda p: p["z"])).alias("z"))  # a row a head


def normalised(z: Column, least: float = 1e-5) -> Column:
    """A vector less its mean, by the root of its variance plus least."""
    mean = F.aggregate(z, F.lit(0.0), lambda s, x: s + x) / F.size(z)
    spread = F.aggregate(z, F.lit(0.0), lambda s, x: s + (x - mean) * (x - mean)) / F.size(z)
    return F.transform(z, lambda x: (x - mean) / F.sqrt(spread + F.lit(least)))


def gelu(z: Column) -> Column:
    """x times the normal distribution's share below x, by its usual tanh form, place by place."""
    return F.transform(z, lambda x: 0.5 * x * (1.0 + F.tanh(0.7978845608028654 * (x + 0.044715 * x * x * x))))


def residual_layer(h: DataFrame, messages: DataFrame) -> DataFrame:
    """(id, z): gelu of the normalised sum of h and what a node gets; nodes that get nothing stay as they are."""
    got = messages.withColumnRenamed("z", "_m")
    new = gelu(normalised(F.zip_with("z", "_m", lambda a, b: a + b)))
    return h.join(got, "id", "left").select("id", F.when(F.col("_m").isNull(), F.col("z")).otherwise(new).alias("z"))
