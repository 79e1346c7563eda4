"""Running totals over an ordered column, and exact quantiles, both without a single-task window.

``running_totals`` expects at most one row per (keys, order value) — callers
pre-aggregate with ``groupBy(keys, value)`` first, so a hot value is one row.
Rows are range-partitioned by (keys, value); every task adds up its own sorted rows; one
row per (keys, partition) gives the partition's offset and is joined back.  The ranges only
decide parallelism, the answer is exact.

``exact_quantiles`` never ranks all rows: a mergeable sketch gives two bounds around each
wanted rank, one aggregate counts what lies below them, and only the values between are ranked.
"""

from __future__ import annotations

from functools import reduce
from typing import Iterable, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from ..session import cut_lineage
from .series import key_window

ACCURACY = 1000          # of the sketches: ranks are off by rows / ACCURACY at most
BROADCAST_ROWS = 100_000  # offset rows, and rows of statistics, that are sent to every task
BROADCAST_CELLS = 1_000_000  # values in these statistics


def sent(stats: DataFrame, rows: int, width: int = 1) -> DataFrame:
    """Statistics for a join with the rows they were made from: while they are few, they go to every task, so that the rows stay
    where they are.  Joined by a shuffle, all rows of a key would be sorted in one task."""
    return F.broadcast(stats) if rows <= BROADCAST_ROWS and rows * width <= BROADCAST_CELLS else stats


def attach_stats(df: DataFrame, stats: DataFrame, keys: Sequence[str] = (), width: int | None = None) -> DataFrame:
    """Add per-key statistics (``width`` values in a row, where these are arrays) to every row.

    With keys: an equi-join on the keys.  The statistics are made first and counted: few go to
    every task, more are joined by a shuffle.  Without keys the
    statistics are one row: it is collected (a handful of scalars) and added
    as literals, so no join is needed.
    """
    keys = list(keys)
    if keys:
        stats = cut_lineage(stats)
        return df.join(sent(stats, stats.count(), width or len(stats.columns)), on=keys, how="left")
    rows = stats.collect()
    if len(rows) != 1:
        raise ValueError(f"expected one row of statistics, got {len(rows)}")
    row = rows[0].asDict()
    fields = {f.name: f.dataType for f in stats.schema.fields}
    return df.withColumns({k: F.lit(v).cast(fields[k]) for k, v in row.items()})


def _local_totals(n_keys: int, sums: Sequence[int], schema: T.StructType):
    """Per task: for each sorted row the sum of the rows before it with the same key, and the task's number."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    names = schema.names

    def run(batches):
        from pyspark import TaskContext
        part = TaskContext.get().partitionId()
        last, carry = None, [0] * len(sums)
        for b in batches:
            if not b.num_rows:
                continue
            new = np.zeros(b.num_rows, bool)
            for k in range(n_keys):
                c = b.column(k)
                same = pc.equal(c.slice(1), c.slice(0, b.num_rows - 1))
                both_null = pc.and_(pc.is_null(c.slice(1)), pc.is_null(c.slice(0, b.num_rows - 1)))
                new[1:] |= ~np.asarray(pc.or_kleene(pc.fill_null(same, False), both_null))
            first = tuple(b.column(k)[0].as_py() for k in range(n_keys))
            new[0] = first != last
            run_of = np.cumsum(new) - 1 if new[0] else np.cumsum(new)
            at = np.flatnonzero(new)
            out = []
            for j, s in enumerate(sums):
                v = np.asarray(b.column(s), dtype=np.int64)
                before = np.cumsum(v) - v
                starts = before[at] if new[0] else np.r_[-carry[j], before[at]]
                before = before - starts[run_of]
                out.append(pa.array(before))
                carry[j] = int(before[-1] + v[-1])
            last = tuple(b.column(k)[b.num_rows - 1].as_py() for k in range(n_keys))
            yield pa.RecordBatch.from_arrays([*b.columns, *out, pa.array(np.full(b.num_rows, part, np.int64))], names=names)
    return run


def running_totals(df: DataFrame, keys: Sequence[str], order_col: str, sum_cols: Iterable[str],
                   n_buckets: int | None = None) -> DataFrame:
    """Add ``_before_<c>`` (sum of c over rows with a strictly smaller order value)
    and ``_total_<c>`` (sum over the key) for every long c in ``sum_cols``.

    The ranged rows are checkpointed: a range is a row's property from then on, also when a task is run again."""
    keys, sum_cols = list(keys), list(sum_cols)
    d = df.withColumns({c: F.coalesce(F.col(c), F.lit(0)).cast("long") for c in sum_cols})
    d = d.select(*keys, *[c for c in d.columns if c not in keys])
    by = [*keys, order_col]
    ranged = (d.repartitionByRange(n_buckets, *by) if n_buckets else d.repartitionByRange(*by)).sortWithinPartitions(*by)
    schema = T.StructType([*d.schema.fields, *[T.StructField(f"_in_{c}", T.LongType()) for c in sum_cols],
                           T.StructField("_part", T.LongType())])
    local = cut_lineage(ranged.mapInArrow(_local_totals(len(keys), [d.columns.index(c) for c in sum_cols], schema), schema))
    sums = local.groupBy(*keys, "_part").agg(*[F.sum(c).alias(f"_s_{c}") for c in sum_cols])
    ahead = key_window(keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = cut_lineage(sums.select(
        *[F.col(k).alias(f"_k_{k}") for k in keys], F.col("_part").alias("_p"),
        *[F.coalesce(F.sum(f"_s_{c}").over(ahead), F.lit(0)).alias(f"_o_{c}") for c in sum_cols],
        *[F.sum(f"_s_{c}").over(key_window(keys)).alias(f"_total_{c}") for c in sum_cols]))
    if offsets.count() <= BROADCAST_ROWS:
        offsets = F.broadcast(offsets)
    same = reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys], F.col("_part") == F.col("_p"))
    out = local.join(offsets, same).withColumns({f"_before_{c}": F.col(f"_o_{c}") + F.col(f"_in_{c}") for c in sum_cols})
    return out.select(*df.columns, *[f"_before_{c}" for c in sum_cols], *[f"_total_{c}" for c in sum_cols])


def exact_quantiles(df: DataFrame, cols: Sequence[str], probs: Sequence[float], keys: Sequence[str] = (),
                    n_buckets: int | None = None, accuracy: int = ACCURACY) -> DataFrame:
    """Exact, linearly interpolated quantiles (as ``percentile`` / numpy), distributed.

    Returns one row per key with columns ``<col>_q<i>`` for the i-th probability.  Three passes over the rows: bounds
    around each rank from sketches (partial aggregates), counts of the values below and between the bounds (one row per
    key, which also proves that the ranks lie between), and the values between, reduced to (value, count), so that a
    hot value is one row.  Only these are shuffled: a share of about ``4 / accuracy`` of the rows per quantile, none where
    both bounds are one value.  Where a sketch missed its rank, all values are ranked.
    """
    keys, cols, probs = list(keys), list(cols), [float(p) for p in probs]
    slots = [(j, i) for j in range(len(cols)) for i in range(len(probs))]
    names = [f"`{k}`" for k in keys]
    # expressions are SQL text: one call to the JVM each, however many columns there are
    d = df.selectExpr(*names, *[f"CAST(`{c}` AS DOUBLE) AS _c{j}" for j, c in enumerate(cols)])
    ends = ", ".join(f"{min(1.0, max(0.0, p + side * 2 / accuracy))!r}D" for side in (-1, 1) for p in probs)
    bounds = _aggregate(d, names, *[f"count(_c{j}) AS _t{j}" for j in range(len(cols))],
                        *[f"percentile_approx(_c{j}, array({ends}), {accuracy}) AS _b{j}" for j in range(len(cols))])
    # without keys the bounds are one row and become literals, with keys they are joined
    b = attach_stats(d, bounds, keys, len(keys) + len(cols) * (1 + 2 * len(probs))) if keys else _with_one_row(d, bounds)
    lo = {(j, i): f"_b{j}[{i}]" for j, i in slots}
    hi = {(j, i): f"_b{j}[{i + len(probs)}]" for j, i in slots}
    inside = {s: f"(_c{s[0]} >= {lo[s]} AND _c{s[0]} <= {hi[s]})" for s in slots}
    facts = ", ".join(f"struct({j} AS _j, {i} AS _i, {probs[i]!r}D AS _p, max(_t{j}) AS _t, max({lo[j, i]}) AS _a, max({hi[j, i]}) AS _z, "
                      f"count(CASE WHEN _c{j} < {lo[j, i]} THEN 1 END) AS _l, count(CASE WHEN {inside[j, i]} THEN 1 END) AS _m)"
                      for j, i in slots)
    below = cut_lineage(_aggregate(b, names, f"array({facts}) AS _x").selectExpr(*names, "inline(_x)"))
    rank = "(_t - 1) * _p"
    missed = f"_t > 0 AND NOT (_l <= floor({rank}) AND ceil({rank}) < _l + _m)"
    state = below.groupBy("_j", "_i").agg(F.expr(f"max({missed})").alias("missed"), F.expr("max(_a < _z)").alias("open"),
                                            F.count(F.lit(1)).alias("rows")).collect()
    if any(r["missed"] for r in state):
        inside, live = {(j, i): f"_c{j} IS NOT NULL" for j, i in slots}, slots
        below = below.withColumn("_l", F.lit(0).cast("long"))
    else:  # where both bounds are one value, that is the quantile
        inside = {s: f"({inside[s]} AND {lo[s]} < {hi[s]})" for s in slots}
        live = sorted((r["_j"], r["_i"]) for r in state if r["open"])
    found = below.selectExpr(*names, "_j", "_i", "_a AS _q")
    if live:
        cells = ", ".join(f"CASE WHEN {inside[j, i]} THEN struct({j} AS _j, {i} AS _i, _c{j} AS _v) END" for j, i in live)
        # The last part never holds.  With it the condition is no fact that Spark's planner carries on: it would write the others
        # anew for every set of renamed columns.
        some = " OR ".join([*(inside[s] for s in live), "spark_partition_id() < 0"])
        long = (b.where(some).selectExpr(*names, f"explode(array({cells})) AS _x")
                .where("_x IS NOT NULL").selectExpr(*names, "_x.*"))
        counts = _aggregate(long, [*names, "_j", "_i", "_v"], "count(1) AS _n")
        ranked = running_totals(counts, [*keys, "_j", "_i"], "_v", ["_n"], n_buckets)
        other = below.selectExpr(*[f"{k} AS `_k_{c}`" for k, c in zip(names, keys)], "_j AS _fj", "_i AS _fi", "_p", "_t", "_l")
        other = sent(other, sum(r["rows"] for r in state), len(other.columns))
        same = " AND ".join([*[f"{k} <=> `_k_{c}`" for k, c in zip(names, keys)], "_j = _fj", "_i = _fi"])
        start, stop = "_l + _before__n", "_l + _before__n + _n"
        picked = _aggregate(ranked.join(other, F.expr(same)), [*names, "_j", "_i"],
                            f"max(CASE WHEN {start} <= floor({rank}) AND floor({rank}) < {stop} THEN _v END) AS _lo",
                            f"max(CASE WHEN {start} <= ceil({rank}) AND ceil({rank}) < {stop} THEN _v END) AS _hi",
                            f"max({rank} - floor({rank})) AS _f")
        picked = picked.selectExpr(*names, "_j", "_i", "_lo + (_hi - _lo) * _f AS _q", "1 AS _r")
        found = _aggregate(found.withColumn("_r", F.lit(0)).unionByName(picked), [*names, "_j", "_i"], "max_by(_q, _r) AS _q")
    return _aggregate(found, names, *[f"max(CASE WHEN _j = {j} AND _i = {i} THEN _q END) AS `{cols[j]}_q{i}`" for j, i in slots])


def _aggregate(df: DataFrame, keys: Sequence[str], *exprs: str) -> DataFrame:
    return df.groupBy(*[F.expr(k) for k in keys]).agg(*[F.expr(e) for e in exprs])


def _with_one_row(d: DataFrame, stats: DataFrame) -> DataFrame:
    """The one row of statistics as literals on every row; arrays of doubles included."""
    row = stats.first()
    lit = {f.name: F.array(*[F.lit(float(x)) for x in row[f.name]]) if isinstance(f.dataType, T.ArrayType) and row[f.name]
           is not None else F.lit(row[f.name]).cast(f.dataType) for f in stats.schema.fields}
    return d.withColumns(lit)


def nth_value(df: DataFrame, col: str, p: float, n: int, accuracy: int = ACCURACY) -> tuple | None:
    """(value, rows below it) of the n-th smallest value (from 1) of a numeric column, about the share ``p`` of the rows:
    one pass for sketch bounds, one for the counts and one for the values between; None beyond the rows."""
    ends = [max(0.0, p - 2 / accuracy), min(1.0, p + 2 / accuracy)]
    bounds = df.agg(F.percentile_approx(col, ends, accuracy).alias("b")).first()["b"]
    if n < 1 or bounds is None:
        return None
    lo, hi = bounds
    c = df.agg(F.count(F.when(F.col(col) < lo, 1)).alias("below"), F.count(F.when(F.col(col) <= hi, 1)).alias("upto"),
               F.count(col).alias("rows")).first()
    if n > c["rows"]:
        return None
    below, near = c["below"], df.where(F.col(col).between(lo, hi))
    if not below < n <= c["upto"]:
        below, near = 0, df.where(F.col(col).isNotNull())
    ranked = running_totals(near.groupBy(col).agg(F.count(F.lit(1)).alias("_n")), [], col, ["_n"])
    at = ranked.where((F.col("_before__n") + below < n) & (F.col("_before__n") + F.col("_n") + below >= n)).first()
    return at[col], below + at["_before__n"]
