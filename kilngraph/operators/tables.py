"""Association tables to node and edge tables: entity resolution, picks with a total order, enrichment, hierarchies."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kilngraph.functions import expressions as X
from kilngraph.operators.ids import surrogate_keys

# Codes of the surveyed data model; anything else has the code that stands behind them.
ACTIONS, OTHER_ACTION = {"increases": 0, "decreases": 1, "affects": 2}, 2
ONTOLOGIES, OTHER_ONTOLOGY = {"Biological Process": 0, "Molecular Function": 1, "Cellular Component": 2}, 0
EVIDENCE, OTHER_EVIDENCE = {"marker/mechanism": 0, "therapeutic": 1}, 2

# ---- nodes ------------------------------------------------------------------------------------------------------------


def in_all(sources: list[tuple[DataFrame, str]], name: str = "key") -> DataFrame:
    """The distinct keys that every source has."""
    keys = [df.select(F.col(c).alias(name)).where(F.col(c).isNotNull()) for df, c in sources]
    return reduce(lambda a, b: a.join(b, name, "left_semi"), keys[1:], keys[0].distinct())


def core_entities(sources: list[tuple[DataFrame, str]], annotations: DataFrame | None, key: str, id_name: str) -> DataFrame:
    """Entities that every source has, numbered in the order of their key, with annotations where there are any."""
    nodes = surrogate_keys(in_all(sources, key), [key], id_name)
    return nodes if annotations is None else nodes.join(annotations, key, "left")


def first_by(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row of each key: the first in a total order of the rows."""
    rest = [c for c in df.columns if c not in keys]
    picked = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("row"))
    return picked.select(*keys, *[F.col(f"row.{c}").alias(c) for c in rest])


def multi_source(sources: list[tuple[DataFrame, str, str]], least: int = 2) -> DataFrame:
    """(key, name, n_sources): keys in at least so many sources.  sources: (frame, key, name) by priority of names; of
    several names in a source the smallest counts."""
    seen = None
    for i, (df, key, name) in enumerate(sources):
        one = df.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("key")).agg(F.min(name).alias(f"name_{i}")).withColumn(f"has_{i}", F.lit(True))
        seen = one if seen is None else seen.join(one, "key", "full")
    n = sum((F.coalesce(f"has_{i}", F.lit(False)).cast("long") for i in range(1, len(sources))), F.coalesce("has_0", F.lit(False)).cast("long"))
    return seen.select("key", F.coalesce(*[f"name_{i}" for i in range(len(sources))]).alias("name"), n.alias("n_sources")).where(F.col("n_sources") >= least)


def both_sides(left: list[DataFrame], right: list[DataFrame], key: str, described: DataFrame | None = None) -> DataFrame:
    """Keys that occur in any left and in any right table, with the attributes that described has (else null)."""
    a, b = (reduce(DataFrame.unionByName, [d.select(key).where(F.col(key).isNotNull()) for d in side]) for side in (left, right))
    keys = a.distinct().join(b, key, "left_semi")
    return keys if described is None else keys.join(described, key, "left")


# ---- edges ------------------------------------------------------------------------------------------------------------


def richest(df: DataFrame, keys: list[str], text: str, tie: list[str]) -> DataFrame:
    """Of each key the row with the richest interaction string (see poverty), ties by the smallest tie columns."""
    rest = [c for c in df.columns if c not in keys]
    best = F.min_by(F.struct(*rest), F.struct(X.poverty(F.col(text)), *tie))
    return df.groupBy(*keys).agg(best.alias("row")).select(*keys, *[F.col(f"row.{c}").alias(c) for c in rest])


def exploded_actions(df: DataFrame, text: str) -> DataFrame:
    """A row for each item of a piped interaction list, with action_type and action_subject around its '^'.

    A null or empty list gives no row; an item without '^' has no subject (null)."""
    rows = df.where(F.col(text) != "").withColumn("_item", F.explode(X.items(F.col(text))))
    return rows.withColumns({"action_type": X.pair(F.col("_item"), 0), "action_subject": X.pair(F.col("_item"), 1)}).drop("_item")


def evidence_edges(df: DataFrame, keys: list[str], evidence: str, papers: str, codes: dict[str, int] | None = None) -> DataFrame:
    """Per key the smallest evidence's code (null is 'unspecified') and the log of the largest paper count."""
    grouped = df.groupBy(*keys).agg(F.min(F.coalesce(F.col(evidence), F.lit("unspecified"))).alias("_e"), F.max(X.list_size(F.col(papers))).alias("_n"))
    return grouped.select(*keys, X.code(F.col("_e"), codes or EVIDENCE, OTHER_EVIDENCE).alias("evidence_type"), F.log1p(F.col("_n").cast("double")).alias("log_papers"))


def undirected(df: DataFrame, a: str, b: str) -> DataFrame:
    """Distinct unordered pairs without loops, the smaller first."""
    return df.where(F.col(a) != F.col(b)).select(F.least(a, b).alias(a), F.greatest(a, b).alias(b)).distinct()


def mirrored(df: DataFrame, a: str, b: str) -> DataFrame:
    return df.select(a, b).union(df.select(b, a))


def count_with_null(c: str) -> Column:
    """Distinct values, null counted as one."""
    return F.count_distinct(c) + F.max(F.col(c).isNull().cast("int"))


def enrichment_columns(p: str, hits: str, total: str, back_hits: str, back_total: str) -> dict[str, Column]:
    return {
        "neg_log_p": X.neg_log10(F.col(p)), "target_ratio": X.ratio(F.col(hits), F.col(total)),
        "fold_enrichment": X.fold_enrichment(F.col(hits), F.col(total), F.col(back_hits), F.col(back_total)),
    }


def enrichment_edges(df: DataFrame, keys: list[str], p: str, hits: str, total: str, back_hits: str, back_total: str) -> DataFrame:
    """One row a key, that of the smallest p (nulls last; ties: most hits, then smallest totals), with its statistics."""
    order = F.struct(F.col(p).isNull(), F.col(p), -F.coalesce(F.col(hits), F.lit(0)), F.col(total), F.col(back_hits), F.col(back_total))
    rest = [p, hits, total, back_hits, back_total]
    picked = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), order).alias("row")).select(*keys, "row.*")
    return picked.select(*keys, *[c.alias(n) for n, c in enrichment_columns(*rest).items()])


def least_action(df: DataFrame, keys: list[str], text: str, codes: dict[str, int] | None = None) -> DataFrame:
    """Per key the smallest action code of its strings."""
    return df.groupBy(*keys).agg(F.min(X.code(X.leading_action(F.col(text)), codes or ACTIONS, OTHER_ACTION)).alias("action_type"))


def grouped_logs(df: DataFrame, keys: list[str], first: str, counts: dict[str, str]) -> DataFrame:
    """Per key the smallest value of first, and log1p of the largest of each count (null counts as 0)."""
    return df.groupBy(*keys).agg(F.min(first).alias(first), *[F.log1p(F.coalesce(F.max(c), F.lit(0)).cast("double")).alias(name) for c, name in counts.items()])


def parents(df: DataFrame, code: str, parent: str, order: list[str], id_name: str = "id") -> DataFrame:
    """df numbered, with parent_id: that of the row whose code is the parent code; a null parent stays null, an unknown or
    blank one is -1.  Of rows that share a code the first counts."""
    nodes = surrogate_keys(df, order, id_name)
    known = nodes.where(F.col(code).isNotNull()).groupBy(F.col(code).alias("_code")).agg(F.min(id_name).alias("_parent"))
    found = nodes.join(known, F.col(parent) == F.col("_code"), "left")
    return found.withColumn("parent_id", F.when(F.col(parent).isNull(), F.lit(None).cast("long")).otherwise(F.coalesce("_parent", F.lit(-1).cast("long")))).drop("_code", "_parent")
