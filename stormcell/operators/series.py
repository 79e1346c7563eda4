"""Series layout: exact row positions, block/halo windows and carries for unbounded frames.

The reference works on *row positions* of one sorted series.  A Spark window
``partitionBy(keys).orderBy(ts)`` gives the same answer but pulls a whole key
(or, with no key, the whole table) into one task.  Here every series is cut
into fixed-size blocks of ``block_rows`` rows:

1. ``with_positions`` numbers the rows of each key in parallel: rows are
   counted per (key, coarse time bucket); a running sum over that small
   count table gives each bucket's offset; ``row_number`` inside the bucket
   adds the rest.  No task ever sees more than one bucket of one key.
2. ``window_apply`` (bounded frames: lag, lead, rolling) copies the last
   ``before`` rows of each block into the next block and the first ``after``
   rows into the previous one (several blocks when the reach exceeds a
   block), evaluates the windows per (key, block) and keeps only each
   block's own rows.  Exact for any frame reach.
3. ``with_neighbours`` (unbounded frames: last/next non-NULL value, used by
   interpolation and full forward/backward fill) summarises each block by
   its first and last non-NULL (position, value), carries those across
   blocks with one window over the small summary table, and joins the carry
   back.  Exact for gaps of any length.

``method='plain'`` evaluates the same builders with one window per key;
tests assert both layouts agree.  ``fitted`` takes it where no key has more
rows than a block.
"""

from __future__ import annotations

from dataclasses import dataclass, replace
from typing import Callable, Iterable, Mapping

from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql import types as T

from ..session import cut_lineage

POS = "_pos"
TASK_ROWS = 1 << 16  # rows of small series that are dealt to one task


def sql_window(keys: Iterable[str]) -> str:
    """``key_window(keys).orderBy(POS)`` as SQL text."""
    return f"(PARTITION BY {', '.join(f'`{k}`' for k in keys) or '0'} ORDER BY `{POS}`)"


@dataclass(frozen=True)
class Series:
    """How rows form series: ``keys`` separate series, ``order`` is a total order inside one."""

    keys: tuple[str, ...] = ()
    order: tuple[str, ...] = ("ts",)
    bucket: str = "day"          # date_trunc unit of order[0] (timestamps) used to number rows
    bucket_width: float = 1e6    # width of numeric buckets when order[0] is a number
    block_rows: int = 1 << 20    # rows per block for windowed work
    method: str = "blocked"      # "blocked" (scales) or "plain" (one window per key)

    def with_keys(self, *extra: str) -> "Series":
        return replace(self, keys=tuple(self.keys) + tuple(k for k in extra if k not in self.keys))


def fitted(df: DataFrame, s: Series) -> tuple[DataFrame, Series]:
    """The layout for a table of many series, and for what is made of it row by row: where the rows of every key fit into one
    block, one window per key holds no more rows than a block does, and the rows need no numbers, halos and carries made
    beforehand.  The rows are dealt by key once, ``TASK_ROWS`` a task or the rows of its largest key, so that a task's memory does
    not grow with the table.  Rows without a key or a time take no part, as in the numbering of blocks."""
    if s.method != "blocked" or not s.keys:
        return df, s
    facts = df.groupBy(*s.keys).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n").alias("most"), F.sum("n").alias("rows")).first()
    if (facts["most"] or 0) > s.block_rows:
        return df, s
    tasks = max(df.sparkSession.sparkContext.defaultParallelism, -(-(facts["rows"] or 0) // TASK_ROWS))
    return df.dropna(subset=[*s.keys, s.order[0]]).repartition(tasks, *s.keys), replace(s, method="plain")


def hourly_spine(df: DataFrame, keys: Iterable[str] = (), ts: str = "ts") -> DataFrame:
    """Every hour of a series from its first to its last: rows of missing hours hold the keys and the hour only, so that
    lags, rolling windows and fills, which count rows, count hours.  ``ts`` becomes the hour of the row; rows without a
    time are left out.  Hours are made per (key, day), so that one long series is dealt over tasks."""
    keys = list(keys)
    df = df.where(F.col(ts).isNotNull()).withColumn(ts, F.date_trunc("hour", ts))
    ends = df.groupBy(*keys).agg(F.min(ts).alias("_first"), F.max(ts).alias("_last")).where("_first is not null")
    days = ends.select(*keys, "_first", "_last", F.explode(F.sequence(
        F.date_trunc("day", "_first"), F.date_trunc("day", "_last"), F.expr("interval 1 day"))).alias("_day"))
    hours = days.repartition(*keys, "_day").select(*keys, F.explode(F.sequence(
        F.greatest("_first", "_day"), F.least("_last", F.col("_day") + F.expr("interval 23 hours")),
        F.expr("interval 1 hour"))).alias("_hour"))
    rows = df.withColumnsRenamed({k: f"_key_{k}" for k in keys})
    same = [F.col(k).eqNullSafe(F.col(f"_key_{k}")) for k in keys] + [F.col("_hour") == F.col(ts)]
    joined = hours.join(rows, same, "left").withColumn(ts, F.col("_hour"))
    return joined.select(*df.columns)


def as_series(keys: Iterable[str] = (), order: Iterable[str] = ("ts",), **kw) -> Series:
    if isinstance(keys, str):
        keys = (keys,)
    if isinstance(order, str):
        order = (order,)
    return Series(keys=tuple(keys), order=tuple(order), **kw)


def reuse(df: DataFrame) -> DataFrame:
    """Cut a frame that feeds several branches of one plan (a self-join of statistics back onto rows), so that its upstream
    runs once.  It is written to the session's checkpoint folder: nothing stays persisted after a query, a lost
    executor costs a read, and the plan above starts anew (short plans, small generated classes)."""
    return cut_lineage(df)


def key_window(keys: Iterable[str]):
    keys = list(keys)
    return Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))


def _bucket_expr(df: DataFrame, s: Series) -> Column:
    first = s.order[0]
    dt = df.schema[first].dataType
    if isinstance(dt, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return F.date_trunc(s.bucket, F.col(first))
    if isinstance(dt, T.NumericType):
        return F.floor(F.col(first) / F.lit(float(s.bucket_width)))
    raise TypeError(f"order column {first!r} is neither a time nor a number: rows of a key could not be numbered in parallel")


def _tie_break(df: DataFrame) -> Column:
    """Deterministic last sort key: a hash of the row's columns.  Rows that tie on the
    order columns still get the same positions when a lost partition is recomputed
    (rows equal in every column are interchangeable)."""
    cols = [F.col(f"`{f.name}`") for f in df.schema.fields if not isinstance(f.dataType, T.MapType)]
    return F.xxhash64(*cols)


def with_positions(df: DataFrame, s: Series, pos_col: str = POS) -> DataFrame:
    """Add the 0-based row position inside each key, in ``s.order`` (ties broken
    deterministically)."""
    order = [*s.order, _tie_break(df)]
    if s.method == "plain":
        w = key_window(s.keys).orderBy(*order)
        return df.withColumn(pos_col, F.row_number().over(w) - 1)
    tb = "_tb"
    # an input of one partition would satisfy every later partitionBy, so rows are dealt by bucket explicitly
    d = reuse(df.withColumn(tb, _bucket_expr(df, s)).repartition(*s.keys, tb))
    counts = d.groupBy(*s.keys, tb).agg(F.count(F.lit(1)).alias("_tb_n"))
    w_off = key_window(s.keys).orderBy(tb).rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*s.keys, tb, F.coalesce(F.sum("_tb_n").over(w_off), F.lit(0)).alias("_tb_off"))
    w_rn = Window.partitionBy(*s.keys, tb).orderBy(*order)
    d = d.withColumn("_tb_rn", F.row_number().over(w_rn))
    d = d.join(offsets, on=[*s.keys, tb], how="inner")
    return d.withColumn(pos_col, F.col("_tb_off") + F.col("_tb_rn") - 1).drop(tb, "_tb_rn", "_tb_off")


def ensure_positions(df: DataFrame, s: Series) -> DataFrame:
    return df if POS in df.columns else with_positions(df, s)


def _explode_blocks(dfp: DataFrame, s: Series, before: int, after: int) -> DataFrame:
    """Copy each row into every block whose frames can reach it: blocks
    floor((pos - after) / B) .. floor((pos + before) / B); ``_own`` marks its own block."""
    b = F.lit(int(s.block_rows))
    pos = F.col(POS)
    own = F.floor(pos / b)
    lo = F.greatest(F.floor((pos - F.lit(int(after))) / b), F.lit(0).cast("long"))
    hi = F.floor((pos + F.lit(int(before))) / b)
    return (dfp.withColumn("_blk", F.explode(F.sequence(lo, hi)))
            .withColumn("_own", F.col("_blk") == own))


def window_apply(df: DataFrame, s: Series, builder: Callable[[Window], Mapping[str, Column]],
                 before: int, after: int = 0, keep_pos: bool = False) -> DataFrame:
    """Evaluate bounded-frame window columns ``builder(w)`` over row position.

    ``w`` is ordered by position; frames may reach ``before`` rows back and
    ``after`` rows ahead.
    """
    if s.method == "plain" and POS not in df.columns and not keep_pos:  # the order of the positions, without making them
        return df.withColumns(dict(builder(key_window(s.keys).orderBy(*s.order, _tie_break(df)))))
    dfp = ensure_positions(df, s)
    if s.method == "plain":
        out = dfp.withColumns(dict(builder(key_window(s.keys).orderBy(POS))))
    else:
        ex = _explode_blocks(dfp, s, before, after)
        w = Window.partitionBy(*s.keys, "_blk").orderBy(POS)
        out = ex.withColumns(dict(builder(w))).filter(F.col("_own")).drop("_blk", "_own")
    return out if keep_pos else out.drop(POS)


def with_neighbours(df: DataFrame, s: Series, cols: Iterable[str], prev: bool = True, nxt: bool = True,
                    keep_pos: bool = True, prev_only: Iterable[str] = ()) -> DataFrame:
    """For every column c add ``_prev_c`` and/or ``_next_c``: struct(p, v) of the last
    non-NULL row strictly before / first non-NULL row strictly after, any distance away (columns of ``prev_only``: no next)."""
    cols = list(cols)
    ahead = [c for c in cols if nxt and c not in set(prev_only)]
    dfp = ensure_positions(df, s)
    pv = {c: F.when(F.col(c).isNotNull(), F.struct(F.col(POS).alias("p"), F.col(c).cast("double").alias("v")))
          for c in cols}

    def following(c, keys):  # a running frame, where an unbounded following one reads the rest of its partition for every row
        return F.expr(f"lead(CASE WHEN `{c}` IS NOT NULL THEN struct(`{POS}` AS p, CAST(`{c}` AS DOUBLE) AS v) END, 1) IGNORE NULLS "
                      f"OVER {sql_window(keys)}")
    if s.method == "plain":
        w = key_window(s.keys).orderBy(POS)
        new = {}
        for c in cols:
            if prev:
                new[f"_prev_{c}"] = F.last(pv[c], True).over(w.rowsBetween(Window.unboundedPreceding, -1))
            if c in ahead:
                new[f"_next_{c}"] = following(c, s.keys)
        out = dfp.withColumns(new)
        return out if keep_pos else out.drop(POS)

    b = int(s.block_rows)
    d = reuse(dfp.withColumn("_blk", F.floor(F.col(POS) / F.lit(b))))
    # 1. per block: last and first non-NULL (position, value) of every column
    aggs = []
    for c in cols:
        if prev:
            aggs.append(F.max_by(pv[c], F.when(F.col(c).isNotNull(), F.col(POS))).alias(f"_bl_{c}"))
        if c in ahead:
            aggs.append(F.min_by(pv[c], F.when(F.col(c).isNotNull(), F.col(POS))).alias(f"_bf_{c}"))
    summary = d.groupBy(*s.keys, "_blk").agg(*aggs)
    # 2. carry across blocks over the small summary table
    wb = key_window(s.keys).orderBy("_blk")
    carry = []
    for c in cols:
        if prev:
            carry.append(F.last(f"_bl_{c}", True).over(wb.rowsBetween(Window.unboundedPreceding, -1)).alias(f"_ci_{c}"))
        if c in ahead:
            carry.append(F.first(f"_bf_{c}", True).over(wb.rowsBetween(1, Window.unboundedFollowing)).alias(f"_co_{c}"))
    carry_df = summary.select(*s.keys, "_blk", *carry)
    # 3. inside each block, fall back to the carry
    w = Window.partitionBy(*s.keys, "_blk").orderBy(POS)
    d = d.join(carry_df, on=[*s.keys, "_blk"], how="inner")
    new = {}
    for c in cols:
        if prev:
            new[f"_prev_{c}"] = F.coalesce(
                F.last(pv[c], True).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.col(f"_ci_{c}"))
        if c in ahead:
            new[f"_next_{c}"] = F.coalesce(following(c, [*s.keys, "_blk"]), F.col(f"_co_{c}"))
    drop = [f"_ci_{c}" for c in cols if prev] + [f"_co_{c}" for c in cols if nxt] + ["_blk"]
    out = d.withColumns(new).drop(*drop)
    return out if keep_pos else out.drop(POS)
