"""Reference SQL for the correctness gate (runs in DuckDB on the same parquet).

The views are the ones the Spark side builds; the decision rules are written
out again as CASE expressions, with their thresholds and texts, independently of
the Spark column code and its configuration.
"""
from __future__ import annotations

from ..functions.numeric import format_fixed_sql, round_exact_sql

TELEMETRY = """SELECT user_id AS unit_id,
       CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS BIGINT) AS time_cycle,
       event_id, ts, event_type, value AS sensor_2
FROM events"""

TELEMETRY_WIDE = """SELECT l_suppkey AS unit_id,
       CAST(row_number() OVER (PARTITION BY l_suppkey
            ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey) AS BIGINT) AS time_cycle,
       l_discount AS op_setting_1, l_tax AS op_setting_2, CAST(100.0 AS DOUBLE) AS op_setting_3,
       l_quantity AS sensor_2, l_extendedprice AS sensor_3,
       l_extendedprice * (1 - l_discount) AS sensor_4,
       l_extendedprice * (1 - l_discount) * (1 + l_tax) AS sensor_11,
       l_quantity * l_discount AS sensor_15,
       l_extendedprice / l_quantity AS sensor_21
FROM lineitem"""

SCORED = """SELECT *, 0.1 - sensor_2 / 500.0 AS anomaly_score,
       CASE WHEN 0.1 - sensor_2 / 500.0 < 0 THEN -1 ELSE 1 END AS anomaly_flag,
       CAST(abs(RUL + (event_id % 11) - 5) AS DOUBLE) AS predicted_RUL,
       sensor_2 / 200.0 + CAST(event_id * 37 % 100 AS DOUBLE) / 100.0 AS reconstruction_error,
       CASE WHEN sensor_2 / 200.0 + CAST(event_id * 37 % 100 AS DOUBLE) / 100.0 > 1.0
            THEN 1 ELSE 0 END AS autoencoder_anomaly_flag,
       sensor_2 / 1000.0 AS latency_s
FROM (SELECT *, max(time_cycle) OVER (PARTITION BY unit_id) - time_cycle AS RUL FROM telemetry) r"""


def D(x) -> str:
    return f"CAST({x} AS DOUBLE)"


def clip_sql(x: str, lo, hi) -> str:
    return f"(CASE WHEN {x} < {D(lo)} THEN {D(lo)} WHEN {x} > {D(hi)} THEN {D(hi)} ELSE {D(x)} END)"


def action_sql(f="anomaly_flag", s="anomaly_score", r="predicted_RUL") -> str:
    return (f"(CASE WHEN {f} = -1 AND {r} <= 5 THEN 'CRITICAL: Immediate maintenance required' "
            f"WHEN {f} = -1 AND {r} <= 15 THEN 'HIGH RISK: Schedule urgent inspection' "
            f"WHEN {f} = -1 AND {s} < {D(-0.1)} THEN 'WARNING: Strong anomaly detected' "
            f"WHEN {f} = -1 THEN 'WARNING: Monitor this unit closely' "
            f"WHEN {r} <= 10 THEN 'CAUTION: Unit nearing failure threshold' "
            f"ELSE 'NORMAL: System operating normally' END)")


def raw_risk_sql(f="anomaly_flag", s="anomaly_score", r="predicted_RUL") -> str:
    rul_risk = f"({D(1.0)} - {clip_sql(r, 0, 80)} / {D(80)})"
    an = f"(CASE WHEN {f} = 1 THEN {D(0.0)} ELSE abs({clip_sql(s, -0.5, 0.0)}) / {D(0.5)} END)"
    return clip_sql(f"({D(0.6)} * {rul_risk} + {D(0.4)} * {an})", 0.0, 1.0)


def confidence_sql(f="anomaly_flag", s="anomaly_score", r="predicted_RUL") -> str:
    strong = f"({f} = -1 AND {s} < {D(-0.15)})"
    near = f"({r} <= 15)"
    return (f"(CASE WHEN {strong} AND {near} THEN 'HIGH' "
            f"WHEN NOT ({f} = -1) AND {r} > 80 THEN 'HIGH' "
            f"WHEN {strong} OR {near} THEN 'MEDIUM' ELSE 'LOW' END)")


def justification_sql(f="anomaly_flag", s="anomaly_score", r="predicted_RUL") -> str:
    cyc = f"{format_fixed_sql(r, 0)} || ' cycles)'"
    first = f"(CASE WHEN {f} = -1 THEN 'anomaly detected (score=' || {format_fixed_sql(s, 3)} || ')' ELSE 'no anomaly detected' END)"
    second = (f"(CASE WHEN {r} <= 5 THEN 'RUL critically low (' || {cyc} "
              f"WHEN {r} <= 15 THEN 'RUL below high-risk threshold (' || {cyc} "
              f"WHEN {r} <= 30 THEN 'RUL in caution zone (' || {cyc} "
              f"ELSE 'RUL acceptable (' || {cyc} END)")
    return f"({first} || '; ' || {second} || '.')"


DECIDED = (f"SELECT * EXCLUDE (_raw_risk), {round_exact_sql('_raw_risk', 4)} AS risk_score FROM ("
           f"SELECT *, {action_sql()} AS recommended_action, {raw_risk_sql()} AS _raw_risk, "
           f"{confidence_sql()} AS confidence, {justification_sql()} AS justification FROM scored) d")

VIEWS = {
    "telemetry": ([], TELEMETRY),
    "telemetry_wide": ([], TELEMETRY_WIDE),
    "scored": (["telemetry"], SCORED),
    "decided": (["scored"], DECIDED),
    "telemetry_ragged": (["telemetry"],
                         "SELECT * FROM telemetry WHERE unit_id % 5 <> 0 OR time_cycle <= 20"),
}


def with_views(body: str, *names: str) -> str:
    """Prefix ``body`` with the CTEs for ``names`` and their dependencies."""
    order: list = []

    def add(n):
        for dep in VIEWS[n][0]:
            add(dep)
        if n not in order:
            order.append(n)

    for n in names:
        add(n)
    ctes = ",\n".join(f"{n} AS ({VIEWS[n][1]})" for n in order)
    return f"WITH {ctes}\n{body}" if order else body


def alert_level_sql(a="recommended_action") -> str:
    words = "|".join(("HIGH RISK", "WARNING", "CAUTION"))
    return (f"(CASE WHEN contains({a}, 'CRITICAL') THEN 'critical' "
            f"WHEN regexp_matches({a}, '{words}') THEN 'warning' ELSE 'normal' END)")


def alert_value_sql(a="recommended_action") -> str:
    words = "|".join(("HIGH RISK", "WARNING", "CAUTION"))
    return (f"(CASE WHEN contains({a}, 'CRITICAL') THEN 100 "
            f"WHEN regexp_matches({a}, '{words}') THEN 60 ELSE 20 END)")


def risk_band_sql(r="risk_score") -> str:
    return (f"(CASE WHEN {r} >= 0.7 THEN 'critical' "
            f"WHEN {r} >= 0.4 THEN 'warning' ELSE 'low' END)")


def health_class_sql(h: str) -> str:
    return f"(CASE WHEN {h} >= 70 THEN 'good' WHEN {h} >= 40 THEN 'medium' ELSE 'bad' END)"


def agreement_sql(f="anomaly_flag", a="autoencoder_anomaly_flag") -> str:
    ae = f"coalesce({a} <> 0, false)"
    return (f"(CASE WHEN {f} = -1 AND {ae} THEN 'Both detect' WHEN {f} = -1 THEN 'IF only' "
            f"WHEN {ae} THEN 'AE only' ELSE 'Both normal' END)")


def state_sql(f="anomaly_flag", r="predicted_RUL") -> str:
    band = (f"(CASE WHEN {r} <= 5 THEN 0 WHEN {r} <= 15 THEN 1 "
            f"WHEN {r} <= 30 THEN 2 ELSE 3 END)")
    return f"(CASE WHEN {f} = -1 THEN 4 ELSE 0 END + {band})"


def action_index_sql(a="recommended_action") -> str:
    return (f"(CASE WHEN starts_with({a}, 'CRITICAL') THEN 3 WHEN starts_with({a}, 'HIGH RISK') THEN 2 "
            f"WHEN starts_with({a}, 'WARNING') OR starts_with({a}, 'CAUTION') THEN 1 ELSE 0 END)")


def reward_sql(nb: str, a: str, na: str) -> str:
    return (f"(CASE WHEN {nb} = 0 AND {a} <> 3 THEN -10 WHEN {nb} = 0 AND {a} = 3 THEN 10 "
            f"WHEN {nb} = 1 AND {a} IN (2, 3) THEN 5 WHEN {nb} >= 2 AND {a} = 3 THEN -5 "
            f"WHEN {nb} >= 2 AND {a} = 0 AND {na} = 1 THEN -3 ELSE 1 END)")
