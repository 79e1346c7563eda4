"""Column helpers: NULL-safe clipping, NaN/inf handling, safe division, output normalisation.

All helpers return ``Column`` expressions, so they stay inside whole-stage codegen.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql import types as T

INF = float("inf")


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def nn_greatest(c, lo: float) -> Column:
    """max(c, lo) that keeps NULL (Spark's ``greatest`` skips NULLs)."""
    c = col(c)
    return F.when(c.isNotNull(), F.greatest(c, F.lit(float(lo))))


def nn_least(c, hi: float) -> Column:
    """min(c, hi) that keeps NULL."""
    c = col(c)
    return F.when(c.isNotNull(), F.least(c, F.lit(float(hi))))


def finite_or_null(c) -> Column:
    """NaN, +inf and -inf become NULL; everything else unchanged."""
    c = col(c)
    return F.when(~F.isnan(c) & (F.abs(c) != F.lit(INF)), c)


def safe_div(a, b) -> Column:
    """a / b, NULL when b is 0 or NULL (ANSI mode raises on plain division)."""
    return F.try_divide(col(a).cast("double"), col(b).cast("double"))


def zero_div(a, b) -> Column:
    """a / b, 0 when the divisor is 0 (the convention of the classification metrics)."""
    return F.coalesce(safe_div(a, b), F.lit(0.0))


# Rounding offset for comparable output: the boundary sits off the decimal grid, so
# values lying exactly on a .5 tie (frequent for means of rounded inputs) never
# straddle it because of last-bit differences in summation order.
ROUND_OFFSET = 0.4142135623730951
WIDE = 40  # doubles that ``normalize`` quantises one by one at most


def r6(c) -> Column:
    """Deterministic 1e-6 quantisation used for comparable output.

    floor(x * 1e6 + b) / 1e6 for |x| < 1e6, floor(x + b) below 1e15, else x (b = ROUND_OFFSET).
    Only IEEE operations, so every engine produces the same bits.
    """
    c = col(c).cast("double")
    return (
        F.when(F.abs(c) < 1e6, F.floor(c * 1e6 + ROUND_OFFSET) / 1e6)
        .when(F.abs(c) < 1e15, F.floor(c + ROUND_OFFSET).cast("double"))
        .otherwise(c)
    )


def _q(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def r6_sql(x: str) -> str:
    """SQL text of ``r6`` (one expression string: cheap to build for wide tables)."""
    b = repr(ROUND_OFFSET)
    x = f"CAST({x} AS DOUBLE)"
    return (f"CASE WHEN abs({x}) < 1e6D THEN floor({x} * 1e6D + {b}D) / 1e6D "
            f"WHEN abs({x}) < 1e15D THEN CAST(floor({x} + {b}D) AS DOUBLE) ELSE {x} END")


def normalize(df: DataFrame) -> DataFrame:
    """Comparable output: doubles quantised by ``r6``, integers and booleans as BIGINT,
    timestamps as 'yyyy-MM-dd HH:mm:ss' text.  Built as one ``selectExpr``; beyond ``WIDE`` doubles they are
    quantised as one array, so that the generated class of a wide table stays small enough to be compiled."""
    out = []
    real = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType, T.DecimalType))]
    wide = {c: i for i, c in enumerate(real)} if len(real) > WIDE else {}
    if wide:
        values = ", ".join(f"CAST({_q(c)} AS DOUBLE)" for c in real)
        df = df.selectExpr(*[_q(c) for c in df.columns if c not in wide], f"transform(array({values}), x -> {r6_sql('x')}) AS __real"
                           ).select(*[F.col("__real")[wide[c]].alias(c) if c in wide else F.col(_q(c)) for c in df.columns])
    for f in df.schema.fields:
        c, t = _q(f.name), f.dataType
        if f.name in wide:
            out.append(c)
        elif isinstance(t, (T.DoubleType, T.FloatType, T.DecimalType)):
            out.append(f"{r6_sql(c)} AS {c}")
        elif isinstance(t, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
            out.append(f"CAST({c} AS BIGINT) AS {c}")
        elif isinstance(t, T.BooleanType):
            out.append(f"CAST(CAST({c} AS INT) AS BIGINT) AS {c}")
        elif isinstance(t, (T.TimestampType, T.TimestampNTZType)):
            out.append(f"date_format({c}, 'yyyy-MM-dd HH:mm:ss') AS {c}")
        elif isinstance(t, T.DateType):
            out.append(f"date_format({c}, 'yyyy-MM-dd') AS {c}")
        else:
            out.append(c)
    return df.selectExpr(*out)


def finite_or_null_sql(name: str) -> str:
    c = _q(name)
    return f"CASE WHEN isnan({c}) OR abs({c}) = double('inf') THEN NULL ELSE {c} END AS {c}"


def numeric_columns(df: DataFrame, exclude=()) -> list[str]:
    num = (T.DoubleType, T.FloatType, T.DecimalType, T.ByteType, T.ShortType, T.IntegerType, T.LongType)
    return [f.name for f in df.schema.fields if isinstance(f.dataType, num) and f.name not in exclude]


def floating_columns(df: DataFrame, exclude=()) -> list[str]:
    return [f.name for f in df.schema.fields
            if isinstance(f.dataType, (T.DoubleType, T.FloatType)) and f.name not in exclude]
