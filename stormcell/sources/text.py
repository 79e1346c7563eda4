"""Whitespace-delimited text ingest.

The raw archive format is fixed-width-ish text with runs of blanks between fields;
Spark's CSV reader does not collapse repeated separators, so lines are read as text,
split on ``\\s+`` and each field is ``try_cast`` — bad fields become NULL and the
line goes to a reject frame instead of failing the file.
"""

from __future__ import annotations

from typing import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

# Column layout of the raw hourly records and their missing-value sentinels
RAW_NAMES = ["Year", "Day", "Hour", "IMF_Magnitude", "IMF_Bz", "IMF_By", "IMF_Bx", "Proton_Temp", "Proton_Density",
             "Flow_Speed", "Flow_Pressure", "Kp_index", "Dst_index", "AE_index"]
SENTINELS = [999.9, 9999.9, 99999.9]
TIME_PARTS = ["Year", "Day", "Hour"]


NARROW_TYPES = {"Year": "smallint", "Day": "smallint", "Hour": "tinyint"}


def read_whitespace(spark: SparkSession, path: str, names: Sequence[str] = RAW_NAMES,
                    types: Mapping[str, str] | None = None) -> tuple[DataFrame, DataFrame]:
    """S1 + S7: (rows, rejects).  A line is rejected when it has too few fields or a field
    that does not parse; other lines in the same file go on."""
    d = parse_whitespace(spark, path, names, types)
    return d.where(~F.col("rejected")).select(*names), d.where("rejected").select("file", "line")


def parse_whitespace(spark: SparkSession, path: str, names: Sequence[str] = RAW_NAMES,
                     types: Mapping[str, str] | None = None) -> DataFrame:
    """Every line with its fields by name, its file, and whether it is rejected."""
    types = dict(types or {})
    lines = spark.read.text(path).withColumn("_file", F.input_file_name())
    parts = F.split(F.trim(F.col("value")), r"\s+")
    d = lines.withColumn("_parts", parts)
    cols = []
    bad = F.size("_parts") < len(names)
    for i, n in enumerate(names):
        raw = F.get("_parts", F.lit(i))
        typ = types.get(n, "double")
        val = F.expr(f"try_cast(get(_parts, {i}) AS {typ})")
        bad = bad | (raw.isNotNull() & val.isNull())
        cols.append(val.alias(n))
    return d.select(*cols, F.coalesce(bad, F.lit(True)).alias("rejected"), F.col("_file").alias("file"), F.col("value").alias("line"))


def null_sentinels(df: DataFrame, sentinels: Mapping[str, Sequence[float]] | Sequence[float] = SENTINELS,
                   cols: Sequence[str] | None = None) -> DataFrame:
    """S3: sentinel codes -> NULL, per column (compared as DOUBLE)."""
    if isinstance(sentinels, Mapping):
        spec = dict(sentinels)
    else:
        spec = {c: list(sentinels) for c in (cols or [c for c in df.columns if c not in TIME_PARTS])}
    return df.withColumns({c: F.when(~F.col(c).cast("double").isin([float(v) for v in vs]), F.col(c))
                           for c, vs in spec.items() if c in df.columns})


def drop_missing_time(df: DataFrame, parts: Sequence[str] = TIME_PARTS) -> DataFrame:
    """S4."""
    return df.dropna("any", subset=list(parts))


def narrow_time_parts(df: DataFrame) -> DataFrame:
    """Short year and day, byte hour."""
    return df.withColumns({"Year": F.col("Year").cast("short"), "Day": F.col("Day").cast("short"),
                           "Hour": F.col("Hour").cast("byte")})


def to_ts(year="Year", doy="Day", hour="Hour") -> Column:
    """Year + day of year + hour -> TIMESTAMP_NTZ; NULL when the day is outside the year."""
    y, d, h = F.col(year).cast("int"), F.col(doy).cast("int"), F.col(hour).cast("int")
    jan1 = F.make_timestamp_ntz(y, F.lit(1), F.lit(1), F.lit(0), F.lit(0), F.lit(0))
    days_in_year = F.when((F.pmod(y, F.lit(4)) == 0) & ((F.pmod(y, F.lit(100)) != 0) | (F.pmod(y, F.lit(400)) == 0)),
                          366).otherwise(365)
    ok = (d >= 1) & (d <= days_in_year) & (h >= 0) & (h <= 23)
    return F.when(ok, jan1 + F.make_dt_interval(d - 1, h))


def ingest_written(spark: SparkSession, path: str, out: str, names: Sequence[str] = RAW_NAMES) -> tuple[DataFrame, DataFrame, dict]:
    """S1-S7 with a report, in one pass over the text: rows and rejected lines are written side by side below ``out``, and the
    counts (lines, rejected lines, missing cells after the sentinels) are observed while they are written.
    Returns (rows, rejects, counts)."""
    from pyspark.sql import Observation
    # an observation marks its session for good (fitted models of that session can no longer be sent to tasks), so the pass
    # has a session of its own
    spec, seen = parse_whitespace(spark.newSession(), path, names, NARROW_TYPES), Observation("ingest")
    d = null_sentinels(spec, cols=[n for n in names if n not in TIME_PARTS])
    values = [n for n in names if n not in TIME_PARTS]
    cells = sum((F.when(~F.col("rejected") & F.col(n).isNull(), 1).otherwise(0) for n in values), F.lit(0))
    d = d.observe(seen, F.count(F.lit(1)).alias("lines"), F.sum(F.col("rejected").cast("long")).alias("rejects"),
                  F.sum(cells).alias("missing"))
    d.write.mode("overwrite").partitionBy("rejected").parquet(out)
    counts = {k: v or 0 for k, v in seen.get.items()}
    back = spark.read.schema(d.schema).parquet(out)
    rows = narrow_time_parts(drop_missing_time(back.where(~F.col("rejected")).select(*names))).withColumn("ts", to_ts())
    return rows, back.where("rejected").select("file", "line"), counts


def ingest(spark: SparkSession, path: str, names: Sequence[str] = RAW_NAMES) -> tuple[DataFrame, DataFrame]:
    """S1-S7 composed: parse, sentinels -> NULL, drop rows without time parts, narrow, timestamp."""
    rows, rejects = read_whitespace(spark, path, names, NARROW_TYPES)  # a part out of its type's range is a reject
    d = drop_missing_time(null_sentinels(rows))
    d = narrow_time_parts(d)
    return d.withColumn("ts", to_ts()), rejects
