"""Structured Streaming (X1-X3): the same operators on live data.

* X1 ``hourly_means``: event stream -> hourly means per type with a watermark (late-data limit).  ``run_updates`` writes
  every changed window of a batch under its epoch and ``latest`` merges them by key, so the hours that are still open
  when the input ends are there too, from the stream itself.
* X2 ``score_stream``: stateless rules (range flags, alert level, confidence) on a stream.
* X3 ``stream_lag_features``: per-key lag / rolling features across micro-batches.  Of each key the state holds its rows of
  the last ``lateness`` and the ``tail`` rows before them, one state for a bucket of keys; only buckets with new rows are
  touched, only keys with new rows are written.  A late row within the bound is put in its place, and the rows after it whose features change are emitted again.  A retried epoch overwrites
  its own output, so the sink is idempotent.
"""

from __future__ import annotations

import uuid
from typing import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupStateTimeout

from ..functions import alerts as AL
from ..operators.quality import RANGE_LIMITS, flag_ranges
from ..operators.series import Series
from ..session import ensure_checkpoint_dir

LAG_BUCKETS = 1024  # states of X3

EVENTS_SCHEMA = T.StructType([
    T.StructField("event_id", T.LongType()), T.StructField("ts", T.TimestampType()),
    T.StructField("user_id", T.LongType()), T.StructField("event_type", T.StringType()),
    T.StructField("value", T.DoubleType()), T.StructField("props", T.StringType())])


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared checkpoint folder (never machine-local on a cluster)."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{base}/stormcell-{name}-{uuid.uuid4().hex[:12]}"


def read_stream(spark: SparkSession, path: str, schema: T.StructType, glob: str | None = None,
                files_per_trigger: int | None = None) -> DataFrame:
    r = spark.readStream.format("parquet").schema(schema)
    if glob:
        r = r.option("pathGlobFilter", glob)
    if files_per_trigger:
        r = r.option("maxFilesPerTrigger", str(files_per_trigger))
    return r.load(path)


def hourly_means(events: DataFrame, delay: str = "2 hours", ts: str = "ts") -> DataFrame:
    """Per hour window and event type: mean value and count, late data limited by ``delay``."""
    return (events.withWatermark(ts, delay)
            .groupBy(F.window(ts, "1 hour").alias("w"), "event_type")
            .agg(F.avg("value").alias("mean_value"), F.count(F.lit(1)).alias("events"))
            .select(F.col("w.start").alias("hour"), "event_type", "mean_value", "events"))


def run_updates(df: DataFrame, out: str, checkpoint: str) -> None:
    """Run a streaming aggregate in update mode over everything available now: each batch's changed rows go to
    ``epoch=<n>`` below ``out`` (overwritten when a batch is retried)."""
    def batch(rows: DataFrame, epoch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{out}/epoch={epoch}")
    q = (df.writeStream.foreachBatch(batch).outputMode("update").option("checkpointLocation", checkpoint)
         .trigger(availableNow=True).start())
    q.awaitTermination()


def latest(updates: DataFrame, keys: Sequence[str], epoch: str = "epoch") -> DataFrame:
    """The last written row of each key (a partial aggregate, no sort)."""
    rest = [c for c in updates.columns if c not in keys and c != epoch]
    last = updates.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.col(epoch)).alias("_r"))
    return last.select(*keys, "_r.*")


def score_stream(scored: DataFrame, p: str, profile: str = "PRIMARY") -> DataFrame:
    """Stateless alert rules applied to a streaming (or static) frame."""
    t = AL.THRESHOLD_PROFILES[profile]
    return scored.withColumns({"alert_level": AL.alert_level(p), "decision": AL.decide(p, t),
                               "confidence": AL.confidence(p, t)})


def flag_stream(raw: DataFrame) -> DataFrame:
    """Range flags on a stream of raw measurements."""
    return flag_ranges(raw, RANGE_LIMITS)


def run_available(df: DataFrame, out: str, checkpoint: str, mode: str = "append") -> None:
    """Run a streaming frame over everything available now into Parquet, then stop."""
    q = (df.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint)
         .outputMode(mode).trigger(availableNow=True).start())
    q.awaitTermination()


def arrive(df: DataFrame, part: Column, path: str, number: int) -> None:
    """Write the rows of one arrival as files of a stream's input folder."""
    df.where(part == number).write.mode("append").parquet(path)


def _lag_state(s: Series, columns: Sequence[str], cols: Sequence[str], lags: Sequence[int], means: Sequence[int],
               lateness_ms: int, idle_ms: int, flagged: Sequence[str] = (), whole: Sequence[str] = ()):
    """The function of one bucket of keys and batch.  The state is the held rows of the bucket's keys as Arrow bytes; all keys are
    worked on at once, as arrays.  ``flagged`` columns have their nulls in ``_null_<c>``, ``_us`` is the event time in
    microseconds.  Made inside a function, so that it travels to the executors by value."""
    keys, order, columns, tail = list(s.keys), list(s.order), list(columns), max(max(lags, default=0), max(means, default=1) - 1)
    flagged, whole = list(flagged), list(whole)
    made = [*[f"{c}_lag_{n}" for c in cols for n in lags], *[f"{c}_mean_{n}" for c in cols for n in means]]
    kept = [*columns, *[f"_null_{c}" for c in flagged], "_us"]
    groups = [x for c in keys for x in ([f"_null_{c}", c] if c in flagged else [c])]
    ordered = [x for c in order for x in ([f"_null_{c}", c] if c in flagged else [c])]

    def load(state):
        import pyarrow as pa
        return pa.ipc.open_stream(state.get[0]).read_pandas() if state.exists else None

    def store(state, rows) -> None:
        import pyarrow as pa
        table = pa.Table.from_pandas(rows, preserve_index=False)
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, table.schema) as w:
            w.write_table(table)
        state.update((sink.getvalue().to_pybytes(),))

    def run(key, rows, state):
        import numpy as np
        import pandas as pd
        held, parts = load(state), [] if state.hasTimedOut else [r[kept].assign(_new=True) for r in rows]
        both = pd.concat([*([] if held is None else [held.assign(_new=False)]), *parts], ignore_index=True)
        both["_g"] = both.groupby(groups, sort=False, dropna=False).ngroup()
        both = both.sort_values(["_g", *ordered], kind="stable", ignore_index=True)
        g, fresh, us = both["_g"].to_numpy(), both["_new"].to_numpy(bool), both["_us"].to_numpy(np.int64)
        at = np.arange(len(g))
        starts = np.flatnonzero(np.r_[True, g[1:] != g[:-1]])
        sizes = np.diff(np.r_[starts, len(g)])
        place = at - np.repeat(starts, sizes)  # of a row among its key's
        changed = fresh.copy()
        for k in range(1, tail + 1):  # a new row changes the features of the rows up to ``tail`` after it
            changed[k:] |= fresh[:-k] & (place[k:] >= k)
        if changed.any():
            got, add = both.loc[changed, columns], {}
            mine, where = at[changed], place[changed]
            for c in cols:
                v = both[c].astype(float).to_numpy()
                v = np.where(both[f"_null_{c}"].to_numpy(bool), np.nan, v) if c in flagged else v
                back = lambda n: np.where(where >= n, v[np.maximum(mine - n, 0)], np.nan)
                for n in lags:
                    add[f"{c}_lag_{n}"] = back(n)
                for n in means:
                    total, number = np.zeros(len(mine)), np.zeros(len(mine))
                    for k in range(n):
                        x = back(k)
                        there = np.isfinite(x)
                        total, number = total + np.where(there, x, 0.0), number + there
                    add[f"{c}_mean_{n}"] = np.where(number > 0, total / np.maximum(number, 1), np.nan)
            for c in whole:
                null = both.loc[changed, f"_null_{c}"].to_numpy(bool)
                if null.any():
                    add[c] = got[c].astype("Int64").mask(null)
            yield got.assign(**add)[[*columns, *made]]
        # held: the last ``lateness`` of each key and ``tail`` rows before; the tail only of keys without rows for a while
        timed, now = us > np.iinfo(np.int64).min, state.getCurrentWatermarkMs() or 0
        newest = np.maximum.reduceat(us, starts)
        old = np.add.reduceat((timed & (us < np.repeat(np.maximum(newest, 0 - 2**62) - lateness_ms * 1000, sizes))).astype(np.int64), starts)
        due = newest // 1000 + idle_ms
        idle = due <= now
        first = np.maximum(old - tail, 0)
        first = np.where(idle, np.maximum(first, sizes - max(1, tail)), first)
        store(state, both.loc[place >= np.repeat(first, sizes), kept])
        wait = due[~idle & (sizes - first > max(1, tail))]
        if len(wait):
            state.setTimeoutTimestamp(int(wait.min()))
    return run


def stream_lag_features(stream: DataFrame, s: Series, cols: Sequence[str], lags: Sequence[int],
                        means: Sequence[int], out: str, state: str | None, checkpoint: str,
                        lateness: str = "2 hours", idle: str = "1 day", buckets: int = LAG_BUCKETS) -> None:
    """Lag and rolling-mean features per key across micro-batches, by one state per bucket of keys (a call and a state of Spark
    cost milliseconds, however few rows they hold; ``buckets`` is fixed for the life of a checkpoint).

    Rows are written under ``epoch=<n>`` below ``out``; ``latest`` by the row's identity gives the final features where late rows
    changed some.  ``lateness`` is the watermark's delay on the first order column: a row behind it is dropped by the stream.
    Once the watermark is ``idle`` past a key's newest row, a timer leaves it its last ``tail`` rows only.  The state lies
    in the stream's checkpoint (``state`` is not used any more) and survives restarts."""
    import pandas as pd
    columns = list(stream.columns)
    schema = T.StructType([*stream.schema.fields,
                           *[T.StructField(f"{c}_lag_{n}", T.DoubleType()) for c in cols for n in lags],
                           *[T.StructField(f"{c}_mean_{n}", T.DoubleType()) for c in cols for n in means]])
    ms = [int(pd.Timedelta(x).total_seconds() * 1000) for x in (lateness, idle)]
    whole = [f.name for f in stream.schema.fields if isinstance(f.dataType, T.IntegralType)]  # pandas has no nulls in them
    flagged = [c for c in columns if c in whole or c in s.keys]
    timed = stream.withColumn("_event_time", F.col(s.order[0]).cast("timestamp"))  # a TIMESTAMP_NTZ bears no watermark
    rows = timed.withColumns({"_us": F.coalesce(F.unix_micros("_event_time"), F.lit(-2**63)), "_bucket": F.pmod(F.xxhash64(*s.keys), F.lit(buckets)),
                              **{f"_null_{c}": F.col(c).isNull() for c in flagged}})
    rows = rows.withColumns({c: F.coalesce(F.col(c), F.lit(0).cast(stream.schema[c].dataType)) for c in whole})
    feats = rows.withWatermark("_event_time", lateness).groupBy("_bucket").applyInPandasWithState(
        _lag_state(s, columns, cols, lags, means, *ms, flagged, whole), schema, "held binary", "update", GroupStateTimeout.EventTimeTimeout)
    run_updates(feats, out, checkpoint)
