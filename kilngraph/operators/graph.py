"""A typed property graph as DataFrames: relations (src, dst, attributes), reverses, degrees, summaries, fingerprints."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kilngraph.functions import expressions as X

Relation = tuple[str, str, str]


@dataclass(frozen=True)
class KnowledgeGraph:
    """nodes: type -> (id, ...); relations: (source type, name, target type) -> (src, dst, ...)."""

    nodes: Mapping[str, DataFrame]
    relations: Mapping[Relation, DataFrame] = field(default_factory=dict)

    def __post_init__(self):
        for source, name, target in self.relations:
            if missing := {source, target} - set(self.nodes):
                raise ValueError(f"relation {name} needs nodes of {sorted(missing)}")

    def with_reverses(self, symmetric: frozenset[Relation] = frozenset()) -> KnowledgeGraph:
        """With rev_name for each relation, attributes copied; relations that hold both directions get none."""
        turned = {(t, f"rev_{n}", s): reverse(df) for (s, n, t), df in self.relations.items() if (s, n, t) not in symmetric}
        return replace(self, relations={**self.relations, **turned})

    def with_relation(self, relation: Relation, edges: DataFrame) -> KnowledgeGraph:
        """With a relation (and its reverse, if there is one) replaced, as for training on a part of the edges."""
        back = (relation[2], f"rev_{relation[1]}", relation[0])
        new = {relation: edges} | ({back: reverse(edges)} if back in self.relations else {})
        return replace(self, relations={**self.relations, **new})

    def summary(self) -> DataFrame:
        """(kind, name, n, attributes): rows of every node type and relation, and totals."""
        rows = [df.agg(F.count("*").alias("n")).select(F.lit("node").alias("kind"), F.lit(t).alias("name"), "n", F.lit(0).cast("long").alias("attributes")) for t, df in self.nodes.items()]
        rows += [df.agg(F.count("*").alias("n")).select(F.lit("edge").alias("kind"), F.lit("__".join(r)).alias("name"), "n", F.lit(len(df.columns) - 2).cast("long").alias("attributes")) for r, df in self.relations.items()]
        each = reduce(DataFrame.unionByName, rows)
        return each.unionByName(each.groupBy("kind").agg(F.lit("total").alias("name"), F.sum("n").alias("n"), F.sum("attributes").alias("attributes")))


def reverse(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), *[c for c in edges.columns if c not in ("src", "dst")])


def degrees(nodes: DataFrame, id_col: str, edges: DataFrame, end: str, name: str = "degree") -> DataFrame:
    """(id, degree) of every node, 0 where it has no edge."""
    counts = edges.groupBy(F.col(end).alias(id_col)).agg(F.count("*").alias(name))
    return nodes.select(id_col).join(counts, id_col, "left").fillna(0, [name])


def adjacency(edges: DataFrame, position: Column) -> DataFrame:
    """(src, dst, position, duplicates): the first position of each pair, and how many more it has."""
    return edges.groupBy("src", "dst").agg(F.min(position).alias("position"), (F.count("*") - 1).alias("duplicates"))


def fingerprint(edges: DataFrame) -> DataFrame:
    """(n, digest, mixed): an edge set's size, and the sum and the exclusive or of two 60-bit hashes of its rows, which do not
    depend on the order of rows."""
    first, second = (X.draw(f"edge {k}", F.col("src"), F.col("dst"), below=2**60) for k in (1, 2))
    total = F.coalesce(F.sum(first.cast("decimal(38,0)")), F.lit(0).cast("decimal(38,0)"))
    return edges.agg(F.count("*").alias("n"), total.cast("string").alias("digest"), F.coalesce(F.bit_xor(second), F.lit(0).cast("long")).alias("mixed"))


def same_edges(a: DataFrame, b: DataFrame) -> bool:
    """Whether two edge tables hold the same pairs equally often."""
    a, b = a.select("src", "dst"), b.select("src", "dst")
    return not a.exceptAll(b).take(1) and not b.exceptAll(a).take(1)
