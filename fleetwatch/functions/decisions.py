"""Decision rules as column expressions (first matching rule wins).

All rules are ``when`` chains over three inputs — the isolation-forest flag
(-1 anomaly, 1 normal), its decision score (more negative = more anomalous) and
a remaining-life estimate — so they run inside whole-stage codegen with no
Python per row.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import config as C
from .numeric import clip, format_fixed, nan_to_null, round_exact


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def recommended_action(flag, score, rul) -> Column:
    flag, score, rul = _c(flag), _c(score), _c(rul)
    anomalous = flag == -1
    return (F.when(anomalous & (rul <= C.RUL_CRITICAL), F.lit(C.ACTION_CRITICAL))
            .when(anomalous & (rul <= C.RUL_HIGH_RISK), F.lit(C.ACTION_HIGH_RISK))
            .when(anomalous & (score < C.SCORE_STRONG_WARNING), F.lit(C.ACTION_STRONG))
            .when(anomalous, F.lit(C.ACTION_MONITOR))
            .when(rul <= C.ACTION_CAUTION_RUL, F.lit(C.ACTION_CAUTION))
            .otherwise(F.lit(C.ACTION_NORMAL)))


def raw_risk(flag, score, rul) -> Column:
    """Unrounded risk in [0, 1]: 60 % remaining-life ramp + 40 % anomaly strength."""
    flag, score, rul = _c(flag), _c(score), _c(rul)
    rul_risk = F.lit(1.0) - clip(rul, 0, C.RUL_SAFE) / F.lit(float(C.RUL_SAFE))
    anomaly_risk = (F.when(flag == 1, F.lit(0.0))
                    .otherwise(F.abs(clip(score, C.RISK_SCORE_FLOOR, 0.0)) / F.lit(-C.RISK_SCORE_FLOOR)))
    risk = F.lit(C.RISK_RUL_WEIGHT) * rul_risk + F.lit(C.RISK_ANOMALY_WEIGHT) * anomaly_risk
    return clip(risk, 0.0, 1.0)


def risk_score(flag, score, rul) -> Column:
    return round_exact(raw_risk(flag, score, rul), 4)


def confidence(flag, score, rul) -> Column:
    flag, score, rul = _c(flag), _c(score), _c(rul)
    detected = flag == -1
    strong = detected & (score < C.SCORE_STRONG_ANOMALY)
    near = rul <= C.RUL_HIGH_RISK
    return (F.when(strong & near, F.lit("HIGH"))
            .when(~detected & (rul > C.RUL_SAFE), F.lit("HIGH"))
            .when(strong | near, F.lit("MEDIUM"))
            .otherwise(F.lit("LOW")))


def justification(flag, score, rul) -> Column:
    flag, score, rul = _c(flag), _c(score), _c(rul)
    first = (F.when(flag == -1, F.concat(F.lit("anomaly detected (score="), format_fixed(score, 3), F.lit(")")))
             .otherwise(F.lit("no anomaly detected")))
    cycles = F.concat(format_fixed(rul, 0), F.lit(" cycles)"))
    second = (F.when(rul <= C.RUL_CRITICAL, F.concat(F.lit("RUL critically low ("), cycles))
              .when(rul <= C.RUL_HIGH_RISK, F.concat(F.lit("RUL below high-risk threshold ("), cycles))
              .when(rul <= C.RUL_CAUTION, F.concat(F.lit("RUL in caution zone ("), cycles))
              .otherwise(F.concat(F.lit("RUL acceptable ("), cycles)))
    return F.concat(first, F.lit("; "), second, F.lit("."))


def with_decision(df: DataFrame, flag: str = "anomaly_flag", score: str = "anomaly_score",
                  rul: str = "predicted_RUL") -> DataFrame:
    """Enriched decision: action, rounded risk, confidence and justification.

    A NaN score or remaining life counts as unknown, like NULL: no threshold on it holds."""
    score, rul = nan_to_null(score), nan_to_null(rul)
    staged = df.withColumn("_raw_risk", raw_risk(flag, score, rul))
    return staged.withColumns({
        "recommended_action": recommended_action(flag, score, rul),
        "risk_score": round_exact("_raw_risk", 4),
        "confidence": confidence(flag, score, rul),
        "justification": justification(flag, score, rul),
    }).drop("_raw_risk")


# --- dashboard classifications -------------------------------------------------

def alert_level(action) -> Column:
    a = _c(action)
    return (F.when(a.contains("CRITICAL"), F.lit("critical"))
            .when(a.rlike("|".join(C.ALERT_WORDS)), F.lit("warning"))
            .otherwise(F.lit("normal")))


def alert_value(action) -> Column:
    a = _c(action)
    return (F.when(a.contains("CRITICAL"), F.lit(100))
            .when(a.rlike("|".join(C.ALERT_WORDS)), F.lit(60))
            .otherwise(F.lit(20)))


def is_critical(action) -> Column:
    return F.coalesce(_c(action).contains("CRITICAL"), F.lit(False))


def risk_band(risk) -> Column:
    r = _c(risk)
    return (F.when(r >= C.RISK_BAND_CRITICAL, F.lit("critical"))
            .when(r >= C.RISK_BAND_WARNING, F.lit("warning"))
            .otherwise(F.lit("low")))


def health_class(health) -> Column:
    h = _c(health)
    return (F.when(h >= C.HEALTH_GOOD, F.lit("good"))
            .when(h >= C.HEALTH_MEDIUM, F.lit("medium"))
            .otherwise(F.lit("bad")))


def flag_label(flag) -> Column:
    """1 -> Normal, -1 -> Anomaly, anything else NULL."""
    f = _c(flag)
    return F.when(f == 1, F.lit("Normal")).when(f == -1, F.lit("Anomaly"))


def ae_flag_label(flag) -> Column:
    f = _c(flag)
    return F.when(f == 0, F.lit("Normal")).when(f == 1, F.lit("Anomaly"))


def anomaly_indicator(flag) -> Column:
    """Isolation-forest flag recoded to 1 (anomaly) / 0."""
    return F.when(_c(flag) == -1, F.lit(1)).otherwise(F.lit(0))


def agreement(flag, ae_flag) -> Column:
    if_a = _c(flag) == -1
    ae_a = F.coalesce(_c(ae_flag) != 0, F.lit(False))
    return (F.when(if_a & ae_a, F.lit("Both detect"))
            .when(if_a, F.lit("IF only"))
            .when(ae_a, F.lit("AE only"))
            .otherwise(F.lit("Both normal")))
