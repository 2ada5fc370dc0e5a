"""The engine's relations over the driver's tables: parts, customers and suppliers stand for the three kinds of nodes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kilngraph.operators import tables as T


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lines_with_orders(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "lineitem").join(load(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))


def bought(spark: SparkSession, d: str) -> DataFrame:
    """part - customer"""
    return lines_with_orders(spark, d).where("l_returnflag = 'R'").select(F.col("l_partkey").alias("src"), F.col("o_custkey").alias("dst")).distinct()


def supplied(spark: SparkSession, d: str) -> DataFrame:
    """part - supplier, with an action's type and subject"""
    rows = load(spark, d, "lineitem").where("l_quantity >= 45")
    return rows.select(F.col("l_partkey").alias("src"), F.col("l_suppkey").alias("dst"), F.col("l_returnflag").alias("action"), F.col("l_linestatus").alias("subject")).distinct()


def urgent(spark: SparkSession, d: str) -> DataFrame:
    """customer - supplier"""
    rows = lines_with_orders(spark, d).where("o_orderpriority = '1-URGENT' and l_discount >= 0.08")
    return rows.select(F.col("o_custkey").alias("src"), F.col("l_suppkey").alias("dst")).distinct()


def partners(spark: SparkSession, d: str) -> DataFrame:
    """supplier - supplier, the smaller first"""
    big = load(spark, d, "lineitem").where("l_quantity >= 49").select("l_orderkey", "l_suppkey").distinct()
    pairs = big.join(big.withColumnRenamed("l_suppkey", "other"), "l_orderkey")
    return T.undirected(pairs.select(F.col("l_suppkey").alias("src"), F.col("other").alias("dst")), "src", "dst")


def scored_events(spark: SparkSession, d: str) -> DataFrame:
    """(event_id, user_id, y, score): score is the value's share of the largest, on six places."""
    e = load(spark, d, "events")
    most = e.agg(F.max("value").alias("most"))
    return e.join(F.broadcast(most)).select("event_id", "user_id", (F.col("event_type") == "purchase").cast("int").alias("y"), F.round(F.col("value") / F.col("most"), 6).alias("score"))  # one row


#: The same in SQL.
SQL = """
lo AS (SELECT * FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
bought AS (SELECT DISTINCT l_partkey AS src, o_custkey AS dst FROM lo WHERE l_returnflag = 'R'),
supplied AS (SELECT DISTINCT l_partkey AS src, l_suppkey AS dst, l_returnflag AS action, l_linestatus AS subject FROM lineitem WHERE l_quantity >= 45),
urgent AS (SELECT DISTINCT o_custkey AS src, l_suppkey AS dst FROM lo WHERE o_orderpriority = '1-URGENT' AND l_discount >= 0.08),
big AS (SELECT DISTINCT l_orderkey, l_suppkey FROM lineitem WHERE l_quantity >= 49),
partners AS (SELECT DISTINCT least(a.l_suppkey, b.l_suppkey) AS src, greatest(a.l_suppkey, b.l_suppkey) AS dst FROM big a JOIN big b USING (l_orderkey) WHERE a.l_suppkey <> b.l_suppkey),
scored AS (SELECT event_id, user_id, CAST(event_type = 'purchase' AS INT) AS y, round(value / (SELECT max(value) FROM events), 6) AS score FROM events)
"""
