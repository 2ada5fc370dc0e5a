"""Surrogate keys, vocabularies, identifier checks and counts over ordered ranges."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Ranges a running total is cut into, and rows of a range where there are more.
RANGES, RANGE_ROWS = 64, 4_000_000
#: Rows that are sampled for the borders of the ranges.
BORDER_SAMPLE = 10_000


def borders(df: DataFrame, key: str, ranges: int = RANGES) -> list:
    """Values of key that cut df into about equal ranges, from a bounded sample."""
    rows = df.select(key).where(F.col(key).isNotNull())
    total = rows.count()
    if not total:
        return []
    ranges = max(ranges, min(total // RANGE_ROWS, BORDER_SAMPLE // 10))
    if total > BORDER_SAMPLE:
        rows = rows.sample(fraction=min(1.0, BORDER_SAMPLE / total), seed=7)
    values = [r[0] for r in rows.orderBy(key).limit(2 * BORDER_SAMPLE).collect()]
    return sorted({values[len(values) * i // ranges] for i in range(1, ranges)}) if values else []


def range_of(key: str, cuts: list) -> Column:
    """The number of the range a value is in; null is first."""
    if not cuts:
        return F.lit(0)
    return F.when(F.col(key).isNull(), F.lit(-1)).otherwise(F.size(F.filter(F.array(*[F.lit(c) for c in cuts]), lambda c: c <= F.col(key))))


def surrogate_keys(df: DataFrame, keys: list[str], name: str = "id") -> DataFrame:
    """df with a whole number from 0 without gaps, in the order of the keys (a total order, nulls first).

    Spark deals the rows to ranges of all keys together (as many as spark.sql.shuffle.partitions), sorts each range, and a range
    starts where the ranges before it end: no task orders the whole table, and a frequent first key is cut as well.  The sorted
    ranges are kept on disk, as they are read twice."""
    laid = df.repartitionByRange(*[F.col(k).asc_nulls_first() for k in keys]).sortWithinPartitions(*[F.col(k).asc_nulls_first() for k in keys])
    laid = laid.withColumn("_place", F.monotonically_increasing_id()).withColumn("_range", F.shiftright("_place", 33)).persist(StorageLevel.DISK_ONLY)
    sizes = laid.groupBy("_range").agg(F.count("*").alias("_n"))
    starts = sizes.select("_range", (F.sum("_n").over(Window.orderBy("_range")) - F.col("_n")).alias("_start"))  # a row a range
    number = F.col("_start") + F.col("_place").bitwiseAND((1 << 33) - 1)
    return laid.join(F.broadcast(starts), "_range").select(number.cast("long").alias(name), *[F.col(f"`{c}`") for c in df.columns if c != name])


def vocabulary(df: DataFrame, column: str, name: str = "id") -> DataFrame:
    """(value, id) of a column's distinct values in order; null is a value and comes first."""
    return surrogate_keys(df.select(F.col(column).alias("value")).distinct(), ["value"], name)


def encode(df: DataFrame, column: str, vocab: DataFrame, name: str) -> DataFrame:
    """df with the vocabulary's id for a column's values, nulls included; unknown values get null."""
    words = vocab.select(F.col("value").alias("_value"), F.col("id").alias(name))
    return df.join(words, F.col(column).eqNullSafe(F.col("_value")), "left").drop("_value")


def natural_to_surrogate(edges: DataFrame, lookups: list[tuple[DataFrame, str, str]]) -> DataFrame:
    """edges with each lookup's id joined on its natural key, rows without one dropped.  lookups: (nodes, key, id)."""
    for nodes, key, id_ in lookups:
        edges = edges.join(nodes.select(key, id_), key)
    return edges


def id_report(nodes: DataFrame, id_col: str) -> DataFrame:
    """(n, least, most, kinds, nulls, valid): whether ids are 0 to n - 1, each once."""
    seen = nodes.agg(F.count("*").alias("n"), F.min(id_col).alias("least"), F.max(id_col).alias("most"), F.count_distinct(id_col).alias("kinds"), F.count_if(F.col(id_col).isNull()).alias("nulls"))
    fine = (F.col("nulls") == 0) & (F.col("kinds") == F.col("n")) & ((F.col("n") == 0) | ((F.col("least") == 0) & (F.col("most") == F.col("n") - 1)))
    return seen.withColumn("valid", fine)


def assert_ids(nodes: DataFrame, id_col: str) -> int:
    """The number of nodes; ValueError unless id_col is whole-numbered and 0 to n - 1."""
    if dict(nodes.dtypes)[id_col] not in ("tinyint", "smallint", "int", "bigint"):
        raise ValueError(f"{id_col} is not a whole number")
    seen = id_report(nodes, id_col).first()
    if not seen["valid"]:
        raise ValueError(f"{id_col} must be 0 to n - 1, each once: {seen.asDict()}")
    return seen["n"]


def running_totals(df: DataFrame, key: str, sums: list[str], descending: bool = False, ranges: int = RANGES) -> DataFrame:
    """df (one row a key) with before_x for x in sums: the sum of x over all smaller (descending: larger) keys.

    By ranges, as surrogate_keys."""
    part = df.withColumn("_range", range_of(key, borders(df, key, ranges)))
    total = part.groupBy("_range").agg(*[F.sum(s).alias(f"_t_{s}") for s in sums])
    way = (lambda c: F.col(c).desc()) if descending else (lambda c: F.col(c).asc())
    over = Window.orderBy(way("_range"))  # ranges rows at most
    total = total.select("_range", *[(F.sum(f"_t_{s}").over(over) - F.col(f"_t_{s}")).alias(f"_s_{s}") for s in sums])
    inner = Window.partitionBy("_range").orderBy(way(key)).rowsBetween(Window.unboundedPreceding, 0)
    out = part.withColumns({f"before_{s}": F.sum(s).over(inner) - F.col(s) for s in sums}).join(F.broadcast(total), "_range")
    return out.select(*df.columns, *[(F.col(f"before_{s}") + F.col(f"_s_{s}")).alias(f"before_{s}") for s in sums])
