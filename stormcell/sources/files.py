"""Parquet/CSV/JSON sources and sinks, tagging, unions and profiles."""

from __future__ import annotations

from functools import reduce
from typing import Iterable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql import types as T


def _plain(path: Column) -> Column:
    """A file's path without scheme and authority, decoded."""
    return F.url_decode(F.regexp_replace(F.regexp_replace(path, "^[A-Za-z][A-Za-z0-9+.-]*:(//[^/]*)?", ""), r"\+", "%2B"))


def read_tagged(spark: SparkSession, paths: Sequence[str], tag_col: str, tags: Sequence) -> DataFrame:
    """S11 + S12: Parquet files or folders, one per part, read as one bag by one scan; every row is tagged with the tag of its
    part, found by its file's path (the file itself or the folder it lies in).  Columns that a part lacks are null."""
    import re
    known = {re.sub("^[A-Za-z][A-Za-z0-9+.-]*:(//[^/]*)?", "", p).rstrip("/"): t for p, t in zip(paths, tags)}
    if len(known) != len(paths):
        raise ValueError("parts repeat a path")
    by_path = F.create_map(*[F.lit(x) for pair in known.items() for x in pair])
    file = _plain(F.col("_metadata.file_path"))
    df = spark.read.option("mergeSchema", "true").parquet(*paths)
    found = F.coalesce(F.try_element_at(by_path, file), F.try_element_at(by_path, F.regexp_replace(file, "/[^/]*$", "")))
    return df.withColumn(tag_col, found)


def tag(df: DataFrame, tag_col: str, value) -> DataFrame:
    """Constant tag column."""
    return df.withColumn(tag_col, value if isinstance(value, Column) else F.lit(value))


def union_all(parts: Sequence[DataFrame]) -> DataFrame:
    """Bag union by column name (no sort: sort only where an ordered output is asked for)."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def select_columns(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Fixed column subset and order (pruned down to the scan)."""
    return df.select(*cols)


def drop_if_present(df: DataFrame, cols: Iterable[str]) -> DataFrame:
    """Drop columns, ignoring absent ones."""
    return df.drop(*[c for c in cols if c in df.columns])


def profile(df: DataFrame, ts: str = "ts") -> DataFrame:
    """Rows, columns, time range and total missing cells in one aggregate."""
    nulls = sum((F.col(c).isNull().cast("long") for c in df.columns), F.lit(0).cast("long"))
    return df.agg(F.count(F.lit(1)).alias("rows"), F.lit(len(df.columns)).alias("columns"),
                  F.min(ts).alias("first_ts"), F.max(ts).alias("last_ts"), F.sum(nulls).alias("missing"))


def write_parquet(df: DataFrame, path: str, mode: str = "overwrite", partition_by: Sequence[str] = ()) -> None:
    """Snappy Parquet (optionally partitioned, e.g. by split or cycle)."""
    w = df.write.mode(mode).option("compression", "snappy")
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)


def file_sizes(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """Bytes and megabytes per written file and in total (from file metadata, no data read)."""
    files = spark.read.format(fmt).load(path).select("_metadata.file_path", "_metadata.file_size").distinct()
    return files.agg(F.count(F.lit(1)).alias("files"), F.sum("file_size").alias("bytes"),
                     (F.sum("file_size") / F.lit(1024.0 * 1024.0)).alias("megabytes"))


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """CSV for batch scoring, with an explicit schema."""
    return spark.read.option("header", "true").schema(schema).csv(path)


def write_csv(df: DataFrame, path: str) -> None:
    """CSV sink with a header (importance tables)."""
    df.write.mode("overwrite").option("header", "true").csv(path)


def write_json(df: DataFrame, path: str) -> None:
    """JSON lines sink (metrics, configuration tables)."""
    df.write.mode("overwrite").json(path)


def inspect(df: DataFrame, keywords: Sequence[str] = (), samples: int = 3) -> dict:
    """Shape-free schema inspection: columns, types, columns matching keywords, a few sample rows."""
    cols = df.columns
    found = {k: [c for c in cols if k.lower() in c.lower()] for k in keywords}
    return {"columns": cols, "dtypes": dict(df.dtypes), "matches": found,
            "samples": [r.asDict() for r in df.limit(samples).collect()]}
