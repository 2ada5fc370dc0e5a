"""Delimited and Parquet sources and sinks, optional tables, vector and vocabulary tables, metadata."""

from __future__ import annotations

import json
from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class TableSpec:
    """A delimited file: its columns in order as DDL types, the ones to keep with their new names, constant columns.

    header=False: the file has no header row.  comment: lines that begin with it are skipped."""

    columns: Mapping[str, str]
    keep: Mapping[str, str] = field(default_factory=dict)
    constants: Mapping[str, str] = field(default_factory=dict)
    sep: str = "\t"
    header: bool = True
    comment: str | None = None


def read_delimited(spark: SparkSession, path: str, spec: TableSpec) -> DataFrame:
    reader = spark.read.schema(", ".join(f"`{c}` {t}" for c, t in spec.columns.items())).option("sep", spec.sep).option("header", spec.header)
    if spec.comment:
        reader = reader.option("comment", spec.comment)
    keep = spec.keep or {c: c for c in spec.columns}
    df = reader.csv(path).select(*[F.col(f"`{a}`").alias(b) for a, b in keep.items()])
    return df.withColumns({c: F.lit(v) for c, v in spec.constants.items()}) if spec.constants else df


def read_all(spark: SparkSession, folder: str, specs: Mapping[str, tuple[str, TableSpec]]) -> dict[str, DataFrame]:
    """name -> lazy frame, for name -> (file, spec)"""
    return {name: read_delimited(spark, f"{folder}/{file}", spec) for name, (file, spec) in specs.items()}


def read_tables(spark: SparkSession, folder: str, required: list[str], optional: list[str] = ()) -> dict[str, DataFrame]:
    """Parquet tables by name; optional ones that are not there are left out, required ones raise."""
    out = {name: spark.read.parquet(f"{folder}/{name}.parquet") for name in required}
    for name in optional:
        try:
            out[name] = spark.read.parquet(f"{folder}/{name}.parquet")
        except AnalysisException:
            continue
    return out


def write_tables(tables: Mapping[str, DataFrame], folder: str, partition_by: Mapping[str, str] | None = None) -> None:
    for name, df in tables.items():
        writer = df.write.mode("overwrite")
        if partition_by and name in partition_by:
            writer = writer.partitionBy(partition_by[name])
        writer.parquet(f"{folder}/{name}.parquet")


def row_counts(tables: Mapping[str, DataFrame]) -> DataFrame:
    """(name, rows) of every table; Parquet answers from its footers."""
    out = None
    for name, df in tables.items():
        one = df.agg(F.count("*").alias("rows")).select(F.lit(name).alias("name"), "rows")
        out = one if out is None else out.unionByName(one)
    return out


def chunk(df: DataFrame, order: list[str], offset: int, limit: int) -> DataFrame:
    """Rows offset to offset + limit in the given order (a total one, or chunks may overlap)."""
    return df.orderBy(*order).offset(offset).limit(limit)


def file_starts(df: DataFrame) -> DataFrame:
    """(file, start, rows) of the Parquet files that df was read from, in the order of their paths: how many rows come before each.

    Only how many rows each file has is read, no column.  The window holds a row a file."""
    sizes = df.select(F.col("_metadata.file_path").alias("file")).groupBy("file").agg(F.count("*").alias("rows"))
    return sizes.select("file", (F.sum("rows").over(Window.orderBy("file")) - F.col("rows")).alias("start"), "rows")


def chunk_by_position(df: DataFrame, starts: DataFrame, offset: int, limit: int, position: str | None = None) -> DataFrame:
    """Rows offset to offset + limit of Parquet files, by file and place within the file: chunks are a partition of the table.

    df: as spark.read.parquet gives it (columns may be left out later); starts: its file_starts, kept by the caller where it cuts many
    chunks.  Nothing is sorted and nothing is shuffled: the driver gets the files that the chunk touches, the others are not
    opened.  position: a name under which each row's place in the table comes along."""
    if offset < 0 or limit < 0:
        raise ValueError("offset and limit must not be negative")
    end = offset + limit
    touched = starts.where((F.col("start") < end) & (F.col("start") + F.col("rows") > offset)).collect()  # a row a file of the chunk
    path, row = F.col("_metadata.file_path"), F.col("_metadata.row_index")
    inside = F.lit(False)
    for r in touched:
        inside |= (path == r["file"]) & row.between(max(offset - r["start"], 0), min(end - r["start"], r["rows"]) - 1)
    out = df.where(path.isin([r["file"] for r in touched])).where(inside)
    if position is None:
        return out.select(*df.columns)
    place = F.coalesce(*[F.when(path == r["file"], row + r["start"]) for r in touched]) if touched else F.lit(None).cast("long")
    return out.select(*df.columns, place.alias(position))


def positions(df: DataFrame, name: str = "position") -> DataFrame:
    """df, as spark.read.parquet gives it, with each row's place in the table by file and place within the file.

    A file's start is sent to all tasks (a row a file): a join by file would gather a file's rows in one task."""
    starts = file_starts(df).select(F.col("file").alias("_file"), F.col("start").alias("_start"))
    placed = df.select(*df.columns, F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_row"))
    return placed.join(F.broadcast(starts), "_file").select(*df.columns, (F.col("_start") + F.col("_row")).alias(name))


def write_csv(df: DataFrame, path: str) -> None:
    """A small result as one delimited file with a header."""
    df.coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("header", True).csv(path)


def save_vectors(df: DataFrame, path: str, id_col: str = "id", vector_col: str = "z") -> None:
    """An embedding cache: (id, array of doubles)."""
    df.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("z")).write.mode("overwrite").parquet(path)


def load_vectors(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("id long, z array<double>").parquet(path)


def save_split(edges: DataFrame, metadata: Mapping[str, object], path: str) -> None:
    """A split artifact: edges by split, and its metadata as JSON text, both in the same store."""
    edges.write.mode("overwrite").partitionBy("split").parquet(f"{path}/edges")
    spark = edges.sparkSession
    spark.createDataFrame([(json.dumps({"type": "edge_split", "version": 1, **metadata}),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/metadata")


def load_split(spark: SparkSession, path: str) -> tuple[DataFrame, dict[str, object]]:
    """ValueError if it is not a split artifact."""
    lines = [r[0] for r in spark.read.text(f"{path}/metadata").limit(2).collect()]
    metadata = json.loads(lines[0]) if lines else {}
    if metadata.get("type") != "edge_split" or metadata.get("version") != 1:
        raise ValueError("not a split artifact of version 1")
    edges = spark.read.parquet(f"{path}/edges")
    if not {"src", "dst", "split"} <= set(edges.columns):
        raise ValueError("a split artifact needs src, dst and split")
    return edges, metadata
