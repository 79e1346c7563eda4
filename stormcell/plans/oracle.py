"""DuckDB SQL that computes the same results as the registered Spark queries.

Written as plain SQL over the driver's views (events, lineitem, ...): window
functions with IGNORE NULLS, conditional aggregates and joins.  Output columns
are normalised the same way as ``functions.columns.normalize``: doubles by
floor(x*1e6+b)/1e6 (|x| < 1e6) or floor(x+b) (< 1e15), integers as BIGINT,
timestamps as text.
"""

from __future__ import annotations

import math

from ..functions import physics as P
from ..functions.columns import ROUND_OFFSET
from ..operators import quality as Q
from ..operators import windows as W
from . import fixtures as FX


def num(x: float) -> str:
    """A DOUBLE literal with exactly the Python value."""
    return f"CAST({float(x)!r} AS DOUBLE)"


def r6(x: str) -> str:
    b = num(ROUND_OFFSET)
    return (f"(CASE WHEN abs({x}) < 1e6 THEN floor(({x}) * 1e6 + {b}) / 1e6 "
            f"WHEN abs({x}) < 1e15 THEN floor(({x}) + {b}) ELSE ({x}) END)")


def ts_text(x: str) -> str:
    return f"strftime({x}, '%Y-%m-%d %H:%M:%S')"


def norm(inner: str, spec: str) -> str:
    """Outer projection: spec is 'name:kind ...' with kind d(ouble) i(nteger) s(tring) t(imestamp)."""
    parts = []
    for item in spec.split():
        name, kind = item.split(":")
        q = f'"{name}"'
        if kind == "d":
            parts.append(f"{r6(f'CAST({q} AS DOUBLE)')} AS {q}")
        elif kind == "i":
            parts.append(f"CAST({q} AS BIGINT) AS {q}")
        elif kind == "t":
            parts.append(f"{ts_text(q)} AS {q}")
        else:
            parts.append(f"CAST({q} AS VARCHAR) AS {q}")
    return f"SELECT {', '.join(parts)} FROM ({inner}) AS _q"


def clip_lo(x: str, lo: float) -> str:
    return f"(CASE WHEN {x} IS NULL THEN NULL WHEN {x} < {num(lo)} THEN {num(lo)} ELSE {x} END)"


def rnd(x: str, digits: int) -> str:
    m = float(10 ** digits)
    return f"(floor(({x}) * {num(m)} + 0.5) / {num(m)})"


# ----------------------------------------------------------------------------- panel
def panel_ctes(keyed: bool = False) -> str:
    k = "user_id, " if keyed else ""
    types = FX.EVENT_TYPES
    cells = ", ".join(f"{rnd(f'avg(value) FILTER (WHERE event_type = {t!r})', 6)} AS {t}" for t in types)
    if keyed:
        base = ("SELECT c.*, date_diff('hour', b.h0, c.hour) AS n FROM p_cells c CROSS JOIN p_bounds b")
    else:
        base = ("SELECT s.hour, date_diff('hour', b.h0, s.hour) AS n, "
                + ", ".join(f"c.{t}" for t in types)
                + " FROM p_spine s CROSS JOIN p_bounds b LEFT JOIN p_cells c ON c.hour = s.hour")
    spike = f"(CASE WHEN n % {FX.SPIKE_MOD} = {FX.SPIKE_AT} THEN {num(FX.SPIKE_FACTOR)} ELSE {num(1.0)} END)"
    masked = ", ".join(
        f"CASE WHEN (n + {FX.MASK_STEP * j}) % {FX.MASK_MOD} < {g} THEN NULL ELSE {t} * {spike} END AS {t}"
        for t, (j, g) in FX.MASKS.items())
    plus1 = ", ".join(f"{t} + 1 AS {t}" for t in types)
    bz, by, bx = "(click - 50)", "(view - 50)", "(error - 50)"
    chan = (f"SELECT {k}hour AS ts, seq, year(hour) AS \"Year\", dayofyear(hour) AS \"Day\", hour(hour) AS \"Hour\", "
            f"sqrt({bx} * {bx} + {by} * {by} + {bz} * {bz}) AS IMF_Magnitude, "
            f"{bz} AS IMF_Bz, {by} AS IMF_By, {bx} AS IMF_Bx, "
            f"{num(1000)} + {num(1000)} * view AS Proton_Temp, "
            f"{num(0.1)} + signup / {num(5)} AS Proton_Density, "
            f"{num(200)} + {num(5)} * purchase AS Flow_Speed, "
            f"purchase / {num(10)} AS Flow_Pressure, "
            f"CAST(floor(click) AS DOUBLE) AS Kp_index, "
            f"{num(50)} - {num(2.5)} * error AS Dst_index, "
            f"{num(10)} * signup AS AE_index FROM p_rep")
    return f"""
p_cells AS (SELECT {k}date_trunc('hour', ts) AS hour, {cells} FROM events GROUP BY {k}date_trunc('hour', ts)),
p_bounds AS (SELECT min(date_trunc('hour', ts)) AS h0, max(date_trunc('hour', ts)) AS h1 FROM events),
p_spine AS (SELECT unnest(generate_series(h0, h1, INTERVAL 1 HOUR)) AS hour FROM p_bounds),
p_base AS ({base}),
p_masked AS (SELECT {k}hour, n, {masked} FROM p_base),
p_rep AS (SELECT *, 0 AS seq FROM p_masked UNION ALL BY NAME
          SELECT {k}hour, n, {plus1}, 1 AS seq FROM p_masked WHERE n % {FX.REPEAT_MOD} = 0),
panel AS ({chan})"""


RAW_COLS = ["IMF_Magnitude", "IMF_Bz", "IMF_By", "IMF_Bx", "Proton_Temp", "Proton_Density", "Flow_Speed",
            "Flow_Pressure", "Kp_index", "Dst_index", "AE_index"]


def flags_expr() -> str:
    parts = [f"(CASE WHEN {c} < {num(lo)} OR {c} > {num(hi)} THEN 1 ELSE 0 END)"
             for c, (lo, hi) in Q.RANGE_LIMITS.items()]
    return " + ".join(parts)


def clean_ctes(keyed: bool = False) -> str:
    """panel -> flags on raw -> interpolate 6 + ffill 2 -> ffill indices 1 -> drop >= 3 flags -> first per ts."""
    part = "PARTITION BY user_id " if keyed else ""
    k = "user_id, " if keyed else ""
    wprev = f"({part}ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    wnext = f"({part}ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)"
    nb = []
    for c in Q.INTERPOLATED:
        nb += [f"last_value(CASE WHEN {c} IS NOT NULL THEN pos END IGNORE NULLS) OVER {wprev} AS {c}__pp",
               f"last_value({c} IGNORE NULLS) OVER {wprev} AS {c}__pv",
               f"first_value(CASE WHEN {c} IS NOT NULL THEN pos END IGNORE NULLS) OVER {wnext} AS {c}__qp",
               f"first_value({c} IGNORE NULLS) OVER {wnext} AS {c}__qv"]
    fills = []
    for c in Q.INTERPOLATED:
        slope = f"({c}__qv - {c}__pv) / CAST({c}__qp - {c}__pp AS DOUBLE)"
        inside = f"{c}__pp IS NOT NULL AND {c}__qp IS NOT NULL"
        fills.append(
            f"CASE WHEN {c} IS NOT NULL THEN {c} "
            f"WHEN {inside} AND pos - {c}__pp <= {Q.INTERP_LIMIT} THEN {slope} * (pos - {c}__pp) + {c}__pv "
            f"WHEN {inside} AND pos - {c}__pp <= {Q.INTERP_LIMIT + Q.FFILL_AFTER_INTERP} "
            f"THEN {slope} * {Q.INTERP_LIMIT} + {c}__pv "
            f"WHEN {c}__pp IS NOT NULL AND {c}__qp IS NULL AND pos - {c}__pp <= {Q.FFILL_AFTER_INTERP} THEN {c}__pv "
            f"END AS {c}")
    idx = [f"coalesce({c}, lag({c}) OVER ({part}ORDER BY pos)) AS {c}" for c in Q.INDEX_CHANNELS]
    return f"""
c_flag AS (SELECT *, {flags_expr()} AS nflags, row_number() OVER ({part}ORDER BY ts, seq) - 1 AS pos FROM panel),
c_nb AS (SELECT *, {', '.join(nb)} FROM c_flag),
c_fill AS (SELECT {k}ts, seq, "Year", "Day", "Hour", nflags, pos, Flow_Pressure,
           {', '.join(fills)}, Dst_index, AE_index, Kp_index FROM c_nb),
c_idx AS (SELECT * REPLACE ({', '.join(idx)}) FROM c_fill),
c_kept AS (SELECT * FROM c_idx WHERE nflags < {Q.MULTI_FLAG_LIMIT}),
cleaned AS (SELECT * EXCLUDE (rk, nflags, pos) FROM
            (SELECT *, row_number() OVER (PARTITION BY {k}ts ORDER BY seq) AS rk FROM c_kept) WHERE rk = 1)"""


def feature_ctes(keyed: bool = False) -> str:
    part = "PARTITION BY user_id " if keyed else ""
    mu0 = num(P.MU0)
    deg = f"{num(180.0)} / pi()"
    clip_b = clip_lo("IMF_Magnitude", 0.1)
    sh = f"sin(IMF_Clock_Angle * pi() / {num(180.0)} / {num(2.0)})"
    two_pi = num(2 * math.pi)
    f1 = (f"SELECT *, atan2(IMF_By, IMF_Bz) * {deg} AS IMF_Clock_Angle, "
          f"CASE WHEN abs(IMF_Bx) / {clip_b} <= 1 THEN acos(abs(IMF_Bx) / {clip_b}) * {deg} END AS IMF_Cone_Angle, "
          f"CASE WHEN IMF_Bz IS NULL THEN NULL WHEN IMF_Bz < 0 THEN IMF_Bz ELSE {num(0)} END AS IMF_Bz_South, "
          f"CASE WHEN IMF_Bz IS NULL THEN NULL WHEN IMF_Bz > 0 THEN IMF_Bz ELSE {num(0)} END AS IMF_Bz_North, "
          f"sqrt(IMF_By * IMF_By + IMF_Bz * IMF_Bz) AS IMF_Bt_YZ FROM cleaned")
    rho = f"(Proton_Density * {num(1e6)} * {num(P.PROTON_MASS)})"
    va = f"(IMF_Magnitude * {num(1e-9)} / sqrt({mu0} * {rho}))"
    f2 = (f"SELECT *, IMF_Magnitude / (IMF_Bt_YZ + {num(0.1)}) AS IMF_Stability, "
          f"pow({clip_lo('Flow_Speed', 200)}, {num(4 / 3)}) * pow({clip_lo('IMF_Bt_YZ', 0.1)}, {num(2 / 3)}) "
          f"* pow({sh}, {num(8)}) AS Newell_Coupling, "
          f"Flow_Speed * {num(1000)} * pow(IMF_Bt_YZ * {num(1e-9)}, {num(2)}) * pow({sh}, {num(4)}) / {mu0} / {num(1e12)} "
          f"AS Epsilon_Parameter, "
          f"Flow_Speed * IMF_Bt_YZ * pow({sh}, {num(2)}) / {num(1000)} AS Merging_Electric_Field, "
          f"pow(Flow_Speed, {num(2)}) * Proton_Density AS Viscous_Function, "
          f"CASE WHEN Proton_Density > 0 THEN Flow_Speed * {num(1000)} / {clip_lo(va, 1e3)} "
          f"WHEN Proton_Density = 0 AND IMF_Magnitude <> 0 AND Flow_Speed IS NOT NULL THEN {num(0)} END AS Alfven_Mach, "
          f"Proton_Density * {num(1e6)} * {num(P.BOLTZMANN)} * Proton_Temp / "
          f"{clip_lo(f'pow(IMF_Magnitude * {num(1e-9)}, {num(2)}) / ({num(2.0)} * {mu0})', 1e-15)} AS Plasma_Beta, "
          f"atan2(IMF_By, IMF_Bx) * {deg} AS Flow_Deflection, "
          f"Proton_Density * Flow_Speed AS Density_Speed_Product, "
          f"sin({two_pi} * \"Hour\" / {num(24)}) AS Hour_Sin, cos({two_pi} * \"Hour\" / {num(24)}) AS Hour_Cos, "
          f"sin({two_pi} * \"Day\" / {num(365.25)}) AS Day_Sin, cos({two_pi} * \"Day\" / {num(365.25)}) AS Day_Cos, "
          f"sin({two_pi} * ((((\"Year\" - 1996) % 11) + 11) % 11 / {num(11)})) AS Solar_Cycle_Phase FROM f_1")
    over = lambda frame="": f"OVER ({part}ORDER BY ts{frame})"
    win = [f"Flow_Pressure - lag(Flow_Pressure) {over()} AS Pressure_Gradient"]
    win += [f"lag({c}, {n}) {over()} AS {c}_lag_{n}h" for c in W.LAG_COLUMNS for n in W.LAG_STEPS]
    for c in W.ROLLING_COLUMNS:
        for n in W.ROLLING_WINDOWS:
            fr = f" ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW"
            win.append(f"avg({c}) {over(fr)} AS {c}_mean_{n}h")
            win.append(f"stddev_samp({c}) {over(fr)} AS {c}_std_{n}h")
    win.append(f"Dst_index - lag(Dst_index) {over()} AS Dst_Rate")
    win.append(f"CAST(lead(CASE WHEN Dst_index < -50 THEN 1 ELSE 0 END, {W.LEAD_STEPS}) {over()} AS DOUBLE) "
               f"AS Storm_6h_Ahead")
    labels = ("CASE WHEN Dst_index < -50 THEN 1 ELSE 0 END AS Storm_Binary, "
              "CASE WHEN Dst_index >= -30 THEN 0 WHEN Dst_index >= -50 THEN 1 WHEN Dst_index >= -100 THEN 2 "
              "WHEN Dst_index >= -200 THEN 3 WHEN Dst_index < -200 THEN 4 ELSE 0 END AS Storm_Intensity, "
              "CASE WHEN Dst_Rate < -30 THEN 1 ELSE 0 END AS Storm_Onset")
    return f"""
f_1 AS ({f1}),
f_2 AS ({f2}),
f_3 AS (SELECT *, {', '.join(win)} FROM f_2),
features AS (SELECT * EXCLUDE ("Year", "Day", "Hour", seq), {labels} FROM f_3)"""


def with_ctes(*ctes: str) -> str:
    return "WITH " + ",".join(c.strip("\n") for c in ctes)
