"""Link scores and rankings from vectors or degrees."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kilngraph.functions import expressions as X
from kilngraph.operators.ids import surrogate_keys

#: Queries and items that meet in one group, about, and pairs of them that a task scores at once.
QUERIES, ITEMS, CELLS = 4096, 16_384, 1 << 22
#: Scores are ranked as rounded: this far apart they may be equal.
ROUNDED = 1e-6


def ranked(scored: DataFrame, by: str, score: str, tie: str, k: int) -> DataFrame:
    """The k best rows of each key with their rank; k <= 0: all."""
    at = F.row_number().over(Window.partitionBy(by).orderBy(F.desc(score), tie)).cast("long")
    out = scored.withColumn("rank", at)
    return out if k <= 0 else out.where(F.col("rank") <= k)


def top_links(queries: DataFrame, items: DataFrame, matrix: Sequence[Sequence[float]] | None = None, known: DataFrame | None = None, k: int = 10, kin: str | None = None) -> DataFrame:
    """(query, item, score, probability, rank): the k items of highest bilinear score for each query; k <= 0: all.

    queries (query, z) meet all items (item, z): about ITEMS items and QUERIES queries, by their hashes, are a group of which a task keeps each
    query's best.  known (query, item): pairs to leave out; a query gets as many more candidates as it has known ones.  kin: a column of
    both; a query's pairs with items of its own value are left out too, and none of them becomes a row."""
    more = [F.col(kin).alias("_kin")] if kin else []  # a name of its own on each side, as cogroup() takes columns of one origin for one
    asked = queries.select(F.col("query").alias("query"), (F.col("z") if matrix is None else X.times_matrix(F.col("z"), matrix)).alias("z"), *more, F.lit(0).cast("long").alias("most"))
    if k > 0:
        asked = asked.withColumn("most", F.lit(k).cast("long"))
        if known is not None:
            extra = known.select("query", "item").distinct().groupBy("query").agg(F.count("*").alias("_known"))
            asked = asked.join(extra, "query", "left").withColumn("most", F.col("most") + F.coalesce("_known", F.lit(0))).drop("_known")
    rows, columns = max(1, -(-queries.count() // QUERIES)), max(1, -(-items.count() // ITEMS))
    place = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    dealt = [
        asked.select("*", place("query", rows).alias("_row"), each(columns).alias("_column")), items.select(F.col("item").alias("item"), F.col("z").alias("z"), *more, each(rows).alias("_row"), place("item", columns).alias("_column")),
    ]
    left, right = [df.repartition(rows * columns, "_row", "_column").groupBy("_row", "_column") for df in dealt]
    schema = T.StructType([asked.schema["query"], items.schema["item"], T.StructField("score", T.DoubleType())])
    scored = left.cogroup(right).applyInArrow(best_of, schema).withColumn("score", F.round("score", 6))
    if known is not None:
        scored = scored.join(known.select("query", "item"), ["query", "item"], "left_anti")
    best = ranked(scored, "query", "score", "item", k)
    return best.select("query", "item", "score", F.round(X.sigmoid(F.col("score")), 6).alias("probability"), "rank")


def by_width(column: pa.ListArray) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """width -> places of the vectors of that width without nulls, and their values, a row each."""
    flat = pc.list_flatten(column)
    size = np.asarray(pc.fill_null(pc.list_value_length(column), -1))
    if flat.null_count:
        size[np.asarray(pc.list_parent_indices(column))[np.asarray(pc.is_null(flat))]] = -1
    out = {}
    for width in np.unique(size[size >= 0]).tolist():
        at = np.flatnonzero(size == width)
        out[width] = at, np.asarray(pc.list_flatten(column.take(pa.array(at))), np.float64).reshape(len(at), width)
    return out


def best_of(queries: pa.Table, items: pa.Table) -> pa.Table:
    """(query, item, score) of all pairs that can be among each query's `most` best by rounded score and item, maybe some more; most = 0: all.

    A matrix product finds them, within its error; their scores are then added up in order, so they are the same wherever they are taken.
    Pairs of vectors of other widths, or with nulls, have no score and come last."""
    queries, items = queries.combine_chunks(), items.combine_chunks()
    items = items.take(pc.sort_indices(items, sort_keys=[("item", "ascending")], null_placement="at_start"))
    one = lambda t, c: pa.concat_arrays(t.column(c).chunks) if t.num_rows else pa.array([], t.schema.field(c).type)
    most = np.asarray(one(queries, "most"))
    own, other = np.full(queries.num_rows, -1), np.full(items.num_rows, -2)  # null is nobody's kin
    if "_kin" in queries.column_names and "_kin" in items.column_names:
        codes = pa.concat_arrays([one(queries, "_kin"), one(items, "_kin")]).dictionary_encode().indices
        both = np.asarray(pc.fill_null(codes, -1))
        own, other = both[: len(own)], np.where(both[len(own) :] < 0, -2, both[len(own) :])
    asked, offered = by_width(one(queries, "z")), by_width(one(items, "z"))
    pairs = []
    for width, (at, q) in asked.items():
        if width not in offered:
            continue
        place, z = offered[width]
        by_need = np.argsort(most[at], kind="stable")
        step = max(1, CELLS // len(place))
        for a in range(0, len(at), step):
            part = by_need[a : a + step]
            i, j, score = best_block(q[part], z, most[at[part]], own[at[part]], other[place])
            pairs.append((at[part][i], place[j], score))
    widths = np.full(len(own), -1)
    for width, (at, _) in asked.items():
        widths[at] = width
    for width in np.unique(widths).tolist():
        unlike = np.ones(len(other), bool)
        if width in offered and width >= 0:
            unlike[offered[width][0]] = False
        rest = np.flatnonzero(unlike)
        for i in np.flatnonzero(widths == width) if len(rest) else ():
            j = rest[other[rest] != own[i]]
            j = j[: most[i]] if most[i] else j
            pairs.append((np.full(len(j), i), j, None))
    i, j = (np.concatenate([np.zeros(0, np.int64), *[p[n] for p in pairs]]) for n in range(2))
    score = pa.concat_arrays([pa.array([], pa.float64()), *[pa.nulls(len(p[0]), pa.float64()) if p[2] is None else pa.array(p[2], pa.float64()) for p in pairs]])
    return pa.table({"query": one(queries, "query").take(pa.array(i)), "item": one(items, "item").take(pa.array(j)), "score": score})


def best_block(q: np.ndarray, z: np.ndarray, most: np.ndarray, own: np.ndarray, other: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of q, row of z, score) for best_of, of vectors of one width; most is ascending, z in the order of the items."""
    n, width, apart = len(z), q.shape[1], own[:, None] != other[None]
    with np.errstate(all="ignore"):
        reach = np.sqrt((q * q).sum(1)) * np.sqrt((z * z).sum(1)).max()
        plain = np.isfinite(reach).all() and reach.max() < 1e300
        if plain and 0 < most[0] and most[-1] < n:
            near = np.where(apart, q @ z.T, -np.inf)
            need = int(most[-1])
            wide = max(1, min(64, n // (4 * need)))
            tops = near[:, : n // wide * wide].reshape(len(q), -1, wide).max(2)
            least = np.partition(tops, tops.shape[1] - need, axis=1)[:, tops.shape[1] - need]
            apart &= near >= (least - ROUNDED * 1.01 - np.abs(np.maximum(least, -1e300)) * 1e-15 - 4 * (width + 2) * 2.0**-52 * reach)[:, None]
        i, j = np.nonzero(apart)
        score = np.zeros(len(i))
        qt, zt = np.ascontiguousarray(q.T), np.ascontiguousarray(z.T)
        for a, b in zip(qt, zt, strict=True):
            score += a[i] * b[j]
    if not len(i) or not most[0]:
        return i, j, score
    unknown = np.isnan(score)  # above all numbers, as in Spark's order
    value = np.where(unknown, np.inf, score)
    order = np.lexsort((j, -value, ~unknown, i))
    i, j, score, unknown, value = i[order], j[order], score[order], unknown[order], value[order]
    row = np.arange(len(i))
    first = np.append(True, i[1:] != i[:-1])
    begin, run = row[first][np.cumsum(first) - 1], first | np.append(True, (value[1:] != value[:-1]) | (unknown[1:] != unknown[:-1]))
    end = np.append(row[first][1:], len(i))[np.cumsum(first) - 1]
    last = value[np.minimum(begin + most[i], end) - 1]
    with np.errstate(invalid="ignore"):
        good = (value >= last - ROUNDED * 1.01 - np.abs(last) * 1e-15) | (value == last)
    keep = good & (row - row[run][np.cumsum(run) - 1] < most[i])
    return i[keep], j[keep], score[keep]


def score_pairs(pairs: DataFrame, left: DataFrame, right: DataFrame, known: DataFrame, matrix: Sequence[Sequence[float]] | None = None, threshold: float = 0.5) -> DataFrame:
    """pairs (a, b) with score, probability, label, known and error: null scores and what is wrong for unknown ids."""
    got = pairs.join(left.select(F.col("id").alias("a"), F.col("z").alias("_x")), "a", "left").join(right.select(F.col("id").alias("b"), F.col("z").alias("_y")), "b", "left")
    got = got.join(known.select(F.col("src").alias("a"), F.col("dst").alias("b")).distinct().withColumn("_known", F.lit(True)), ["a", "b"], "left")
    score = F.round(X.bilinear(F.col("_x"), matrix, F.col("_y")), 6)
    error = F.when(F.col("_x").isNull(), F.lit("unknown a")).when(F.col("_y").isNull(), F.lit("unknown b"))
    p = F.round(X.sigmoid(score), 6)
    return got.select("a", "b", score.alias("score"), p.alias("probability"), (p >= threshold).cast("int").alias("label"), F.coalesce("_known", F.lit(False)).alias("known"), error.alias("error"))


def popular_links(edges: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """(query, item, score, rank): the items of highest log1p(degree) + log1p(degree) that a query is not linked to.

    edges: (src item, dst query); queries: (query).  A query's own degree shifts all its scores alike, so of the items only
    the k + (its own links) most linked can matter: a query is joined with so many, by their place in the items' order."""
    items = edges.groupBy(F.col("src").alias("item")).agg(F.count("*").alias("d_item"))
    own = edges.join(queries.select(F.col("query").alias("dst")).distinct(), "dst", "left_semi")
    asked = queries.distinct().join(own.groupBy(F.col("dst").alias("query")).agg(F.count("*").alias("d_query")), "query", "left").fillna(0, ["d_query"])
    best = surrogate_keys(items.withColumn("_less", -F.col("d_item")), ["_less", "item"], "_place").drop("_less")
    asked = asked.withColumn("_place", F.explode(F.sequence(F.lit(0).cast("long"), F.col("d_query") + k - 1)))
    pairs = asked.join(best, "_place").drop("_place").join(own.select(F.col("dst").alias("query"), F.col("src").alias("item")), ["query", "item"], "left_anti")
    scored = pairs.withColumn("score", F.round(X.popularity(F.col("d_item"), F.col("d_query")), 6))
    return ranked(scored, "query", "d_item", "item", k).select("query", "item", "score", "rank")


def vector_stats(vectors: DataFrame) -> DataFrame:
    """(n, width, mean, std, least, most, mean_norm) of (id, z); std is the sample's."""
    each = vectors.select(F.explode("z").alias("x"))
    norms = vectors.agg(F.count("*").alias("n"), F.max(F.size("z")).cast("long").alias("width"), F.round(F.avg(F.sqrt(X.dot(F.col("z"), F.col("z")))), 6).alias("mean_norm"))
    values = each.agg(F.round(F.avg("x"), 6).alias("mean"), F.round(F.stddev_samp("x"), 6).alias("std"), F.round(F.min("x"), 6).alias("least"), F.round(F.max("x"), 6).alias("most"))
    return norms.join(values)  # one row each


def filtered(scored: DataFrame, which: str = "all") -> DataFrame:
    """Rows of scored (with known): all, the known or the novel ones."""
    if which not in ("all", "known", "novel"):
        raise ValueError(f"all, known or novel, not {which}")
    return scored if which == "all" else scored.where(F.col("known") if which == "known" else ~F.col("known"))


def queries_with_hits(top: DataFrame, known: DataFrame, low: int = 2, high: int = 3) -> DataFrame:
    """(query, hits): queries of whose best items low to high are known.  top: (query, item); known: (query, item)."""
    hits = top.join(known.select("query", "item").distinct(), ["query", "item"], "left_semi").groupBy("query").agg(F.count("*").alias("hits"))
    return hits.where(F.col("hits").between(low, high))


def labelled(df: DataFrame, key: str, names: DataFrame, name_key: str, name: str, kind: str, out: str) -> DataFrame:
    """df with the name that names has for a key, else kind:key.  Of several names the smallest counts."""
    one = names.groupBy(F.col(name_key).alias("_key")).agg(F.min(name).alias("_name"))
    return df.join(one, F.col(key) == F.col("_key"), "left").withColumn(out, X.display_name(kind, F.col(key), F.col("_name"))).drop("_key", "_name")


def by_priority(value: str, order: list[str], last: int = 9999) -> Column:
    """A value's place in a list of priorities; others come last."""
    out = F.lit(last)
    for i, v in reversed(list(enumerate(order))):
        out = F.when(F.col(value) == v, F.lit(i)).otherwise(out)
    return out
