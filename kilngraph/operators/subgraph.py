"""Focused subgraphs around chosen nodes."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def bridges(left: DataFrame, right: DataFrame, focus: DataFrame) -> DataFrame:
    """Edges (src, mid) of left whose src and mid are both linked to a focus node.

    left: (src, mid); right: (focus, mid); focus: (focus, src), the chosen nodes and their sources."""
    return left.join(focus, "src").join(right, ["focus", "mid"], "left_semi").select("focus", "src", "mid", *[c for c in left.columns if c not in ("src", "mid")])


def top_sources(edges: DataFrame, end: str, other: str, k: int) -> DataFrame:
    """Of each focus the k ends with the most different others: (focus, end, others, edges, rank)."""
    counts = edges.groupBy("focus", end).agg(F.count_distinct(other).alias("others"), F.count("*").alias("edges"))
    at = F.row_number().over(Window.partitionBy("focus").orderBy(F.desc("others"), F.desc("edges"), end)).cast("long")
    return counts.withColumn("rank", at).where(F.col("rank") <= k)


def labelled_actions(edges: DataFrame, keys: list[str], action: str, most: int = 2) -> DataFrame:
    """(keys, n, actions, label): distinct actions in order, and the first few as a label."""
    out = edges.groupBy(*keys).agg(F.count("*").alias("n"), F.array_sort(F.collect_set(action)).alias("_a"))  # codes: few a pair
    return out.select(*keys, "n", F.array_join("_a", ",").alias("actions"), F.array_join(F.slice("_a", 1, most), "/").alias("label"))


def chosen_or_ranked(nodes: DataFrame, id_col: str, rank_by: str, wanted: list[int] | None, k: int) -> DataFrame:
    """The wanted nodes (ValueError if one is missing), or the k with the largest rank_by."""
    if not wanted:
        return nodes.orderBy(F.desc(rank_by), id_col).limit(k)
    found = nodes.where(F.col(id_col).isin(wanted))
    if missing := set(wanted) - {r[0] for r in found.select(id_col).collect()}:
        raise ValueError(f"unknown ids: {sorted(missing)}")
    return found


def pick_focus(nodes: DataFrame, key: str, links: list[DataFrame], k: int, wanted: list | None = None, preferred: list | None = None) -> DataFrame:
    """The nodes to look at: the wanted ones (ValueError names those that are not there); else the first k of the preferred list, if
    as many are there; else the k with the most links, of those that have any in the first table.

    links: tables with one row a link and the node in a column named key.  Ties go to the smaller key."""
    if wanted:
        found = nodes.where(F.col(key).isin(wanted))
        if missing := sorted(set(wanted) - {r[0] for r in found.select(key).collect()}):  # as many as wanted
            raise ValueError(f"unknown ids: {missing}")
        return found
    if preferred:
        found = nodes.where(F.col(key).isin(preferred))
        if found.count() >= k:
            return found.orderBy(F.array_position(F.array(*map(F.lit, preferred)), F.col(key))).limit(k)
    degrees = [one.groupBy(key).agg(F.count("*").alias(f"_n{i}")) for i, one in enumerate(links)]
    ranked = nodes.join(degrees[0], key)
    for more in degrees[1:]:
        ranked = ranked.join(more, key, "left")
    total = sum((F.coalesce(f"_n{i}", F.lit(0)) for i in range(len(links))), F.lit(0))
    return ranked.orderBy(total.desc(), key).limit(k).select(*nodes.columns)


@dataclass(frozen=True)
class FocusGraph:
    """nodes: (type, id, focuses, first_focus), each node once; members: (focus, type, id); edges: (focus, relation, src_type, src,
    dst_type, dst, weight, label)."""

    nodes: DataFrame
    members: DataFrame
    edges: DataFrame


def best_of(rows: DataFrame, order: list, k: int) -> DataFrame:
    """The k first rows of each focus.  Spark keeps k of each before it shuffles, so a focus may have any number of rows."""
    at = F.row_number().over(Window.partitionBy("focus").orderBy(*order))
    return rows.withColumn("_at", at).where(F.col("_at") <= k).drop("_at")


def focus_graph(focus: DataFrame, sources: DataFrame, mids: DataFrame, bridge: DataFrame, kinds: tuple[str, str, str], relations: tuple[str, str, str], quotas: tuple[int, int, int]) -> FocusGraph:
    """The surroundings of all focus nodes at once: of each the sources that bridge to most of its mids, then the mids that most of
    these sources reach, then the heaviest bridges between the two.

    focus: (focus); sources: (focus, src); mids: (focus, mid); bridge: (src, mid, action), a row an interaction, whose number is an
    edge's weight and whose first two actions are its label.  kinds: of focus, source, mid; relations: source to focus, focus to
    mid, source to mid; quotas: sources, mids and bridges a focus.  Ties go to the smaller id.  A focus without a bridge
    is a node alone."""
    asked = focus.select("focus").distinct()
    near = sources.select("focus", "src").distinct().join(asked, "focus", "left_semi")
    ends = mids.select("focus", "mid").distinct()
    pairs = bridge.groupBy("src", "mid").agg(F.count("*").alias("n"), F.array_sort(F.collect_set("action")).alias("_a"))  # codes: few a pair
    pairs = pairs.select("src", "mid", "n", F.array_join(F.slice("_a", 1, 2), ", ").alias("label"))
    found = pairs.join(near, "src").join(ends, ["focus", "mid"], "left_semi")

    def ranked(rows: DataFrame, end: str, k: int) -> DataFrame:
        counts = rows.groupBy("focus", end).agg(F.count("*").alias("_others"), F.sum("n").alias("_n"))  # a row a pair
        return best_of(counts, [F.desc("_others"), F.desc("_n"), F.col(end)], k).select("focus", end)

    top = ranked(found, "src", quotas[0])
    held = found.join(top, ["focus", "src"], "left_semi")
    reached = ranked(held, "mid", quotas[1])
    between = best_of(held.join(reached, ["focus", "mid"], "left_semi"), [F.desc("n"), F.col("src"), F.col("mid")], quotas[2])

    member = lambda rows, kind, end: rows.select("focus", F.lit(kind).alias("type"), F.col(end).alias("id"))
    members = member(asked, kinds[0], "focus").unionByName(member(top, kinds[1], "src")).unionByName(member(reached, kinds[2], "mid"))
    nodes = members.groupBy("type", "id").agg(F.count("*").alias("focuses"), F.min("focus").alias("first_focus"))

    def edges(rows: DataFrame, name: str, a: tuple[str, str], b: tuple[str, str], weight=F.lit(1), label=F.lit("")) -> DataFrame:
        return rows.select(
            "focus", F.lit(name).alias("relation"), F.lit(a[0]).alias("src_type"), F.col(a[1]).alias("src"), F.lit(b[0]).alias("dst_type"), F.col(b[1]).alias("dst"),
            weight.cast("long").alias("weight"), label.alias("label"),
        )

    focal, source, mid = (kinds[0], "focus"), (kinds[1], "src"), (kinds[2], "mid")
    all_edges = edges(top, relations[0], source, focal).unionByName(edges(reached, relations[1], focal, mid))
    return FocusGraph(nodes, members, all_edges.unionByName(edges(between, relations[2], source, mid, F.col("n"), F.col("label"))))
