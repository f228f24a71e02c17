"""Scalar numeric column helpers.

Rounding and fixed-point formatting follow the usual *exact* convention of
Python's ``round(x, d)`` and ``f"{x:.{d}f}"``: the decimal nearest to the exact
binary value of ``x``, ties to even.  Spark's ``round``/``format_string`` round
half-up on the shortest decimal text instead (``%.0f`` of 2.5 is 3), so the
scaled value is split with an error-free product (Veltkamp/Dekker) and the tie
is decided on the exact residual.  Everything is plain column arithmetic, so it
stays inside whole-stage codegen.
"""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_SPLIT = 134217729.0  # 2**27 + 1


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def clip(x, lo: float, hi: float) -> Column:
    """clip(x, lo, hi) that keeps NULL (``least``/``greatest`` would skip it)."""
    x = _c(x)
    return F.when(x < lo, F.lit(float(lo))).when(x > hi, F.lit(float(hi))).otherwise(x.cast("double"))


def scaled_round(x, digits: int) -> Column:
    """Integer-valued double k = round_half_even(exact(x) * 10**digits).

    p = fl(x * 10**d) rounds like the exact product except when p is exactly
    a half-integer while the exact product is not; the sign of the product's
    rounding error e (error-free split of x) then decides.
    """
    x = _c(x).cast("double")
    s = F.lit(float(10 ** digits))
    p = x * s
    c = x * F.lit(_SPLIT)
    hi = c - (c - x)
    e = (hi * s - p) + (x - hi) * s
    fl = F.floor(p).cast("double")
    return (F.when((p - fl == 0.5) & (e > 0), fl + 1.0)
            .when((p - fl == 0.5) & (e < 0), fl)
            .otherwise(F.rint(p)))


def round_exact(x, digits: int) -> Column:
    """Python ``round(x, digits)`` for doubles."""
    return scaled_round(x, digits) / F.lit(float(10 ** digits))


def format_fixed(x, digits: int) -> Column:
    """Python ``f"{x:.{digits}f}"``; NULL and NaN format as ``nan``, infinities as ``inf``."""
    raw = _c(x).cast("double")
    finite = F.abs(raw) < float("inf")  # NaN is larger than any number
    xc = F.when(finite, raw)
    k = F.abs(scaled_round(xc, digits)).cast("long")
    sign = F.when(xc < 0, F.lit("-")).otherwise(F.lit(""))
    if digits == 0:
        body = k.cast("string")
    else:
        m = 10 ** digits
        body = F.concat((k / m).cast("long").cast("string"), F.lit("."),
                        F.lpad((k % m).cast("string"), digits, "0"))
    return (F.when(raw == float("inf"), F.lit("inf")).when(raw == float("-inf"), F.lit("-inf"))
            .otherwise(F.coalesce(F.concat(sign, body), F.lit("nan"))))


def nan_to_null(x) -> Column:
    """NaN as NULL (double); ``x`` stands in the plan once, so nested rules stay small."""
    return F.nanvl(_c(x).cast("double"), F.lit(None).cast("double"))


def null_to_zero(x) -> Column:
    """NaN or NULL -> 0.0 (payload rule)."""
    x = _c(x).cast("double")
    return F.coalesce(F.nanvl(x, F.lit(0.0)), F.lit(0.0))


def format_thousands(x) -> Column:
    """Whole number with a comma every three digits; NULL stays NULL."""
    return F.format_number(_c(x).cast("long"), 0)


def parse_iso(x) -> Column:
    """ISO 8601 date or date and time, with or without zone, as a timestamp; NULL if it is none."""
    return _c(x).try_cast("timestamp")


def truncate_text(x, at: int = 30, keep: int = 28) -> Column:
    x = _c(x)
    return F.when(F.length(x) > at, F.concat(F.substring(x, 1, keep), F.lit("…"))).otherwise(x)


# --- the same rule as SQL text, for engines without these helpers -------------

def scaled_round_sql(x: str, digits: int) -> str:
    s = f"CAST({10 ** digits} AS DOUBLE)"
    xd = f"CAST({x} AS DOUBLE)"
    p = f"({xd} * {s})"
    c = f"({xd} * CAST(134217729 AS DOUBLE))"
    hi = f"({c} - ({c} - {xd}))"
    e = f"(({hi} * {s} - {p}) + ({xd} - {hi}) * {s})"
    fl = f"CAST(floor({p}) AS DOUBLE)"
    half = f"({p} - {fl} = 0.5)"
    even = f"(CASE WHEN {fl} - 2 * floor({fl} / 2) = 0 THEN {fl} ELSE {fl} + 1 END)"
    return (f"(CASE WHEN {half} AND {e} > 0 THEN {fl} + 1 WHEN {half} AND {e} < 0 THEN {fl} "
            f"WHEN {half} THEN {even} ELSE CAST(round({p}) AS DOUBLE) END)")


def round_exact_sql(x: str, digits: int) -> str:
    return f"({scaled_round_sql(x, digits)} / CAST({10 ** digits} AS DOUBLE))"


def format_fixed_sql(x: str, digits: int) -> str:
    k = f"CAST(abs({scaled_round_sql(x, digits)}) AS BIGINT)"
    sign = f"(CASE WHEN {x} < 0 THEN '-' ELSE '' END)"
    if digits == 0:
        body = f"CAST({k} AS VARCHAR)"
    else:
        m = 10 ** digits
        body = (f"CAST({k} // {m} AS VARCHAR) || '.' || lpad(CAST({k} % {m} AS VARCHAR), {digits}, '0')")
    return f"coalesce({sign} || {body}, 'nan')"
