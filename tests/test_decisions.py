"""Decision rules at their thresholds, with unknown inputs."""

from fleetwatch import config as C
from fleetwatch.functions import decisions as D


# flag, score, remaining life -> action, risk, confidence, sentence.
TABLE = [
    (1, 0.2, 100.0, "NORMAL: System operating normally", 0.0, "HIGH", "no anomaly detected; RUL acceptable (100 cycles)."),
    (1, 0.1, 81.0, "NORMAL: System operating normally", 0.0, "HIGH", "no anomaly detected; RUL acceptable (81 cycles)."),
    (1, 0.1, 80.0, "NORMAL: System operating normally", 0.0, "LOW", "no anomaly detected; RUL acceptable (80 cycles)."),
    (1, -0.7, 40.0, "NORMAL: System operating normally", 0.3, "LOW", "no anomaly detected; RUL acceptable (40 cycles)."),
    (1, 0.0, 30.0, "NORMAL: System operating normally", 0.375, "LOW", "no anomaly detected; RUL in caution zone (30 cycles)."),
    (1, 0.0, 15.0, "NORMAL: System operating normally", 0.4875, "MEDIUM", "no anomaly detected; RUL below high-risk threshold (15 cycles)."),
    (1, 0.0, 10.0, "CAUTION: Unit nearing failure threshold", 0.525, "MEDIUM", "no anomaly detected; RUL below high-risk threshold (10 cycles)."),
    (1, 0.0, 5.0, "CAUTION: Unit nearing failure threshold", 0.5625, "MEDIUM", "no anomaly detected; RUL critically low (5 cycles)."),
    (1, 0.0, 0.5, "CAUTION: Unit nearing failure threshold", 0.5962, "MEDIUM", "no anomaly detected; RUL critically low (0 cycles)."),
    (1, 0.0, -3.0, "CAUTION: Unit nearing failure threshold", 0.6, "MEDIUM", "no anomaly detected; RUL critically low (-3 cycles)."),
    (-1, -0.5, 3.0, "CRITICAL: Immediate maintenance required", 0.9775, "HIGH", "anomaly detected (score=-0.500); RUL critically low (3 cycles)."),
    (-1, -0.4, 3.0, "CRITICAL: Immediate maintenance required", 0.8975, "HIGH", "anomaly detected (score=-0.400); RUL critically low (3 cycles)."),
    (-1, -0.7, 0.0, "CRITICAL: Immediate maintenance required", 1.0, "HIGH", "anomaly detected (score=-0.700); RUL critically low (0 cycles)."),
    (-1, -0.0625, 2.5, "CRITICAL: Immediate maintenance required", 0.6312, "MEDIUM", "anomaly detected (score=-0.062); RUL critically low (2 cycles)."),
    (-1, -0.1, 5.0, "CRITICAL: Immediate maintenance required", 0.6425, "MEDIUM", "anomaly detected (score=-0.100); RUL critically low (5 cycles)."),
    (-1, -0.2, 10.0, "HIGH RISK: Schedule urgent inspection", 0.685, "HIGH", "anomaly detected (score=-0.200); RUL below high-risk threshold (10 cycles)."),
    (-1, -0.15, 15.0, "HIGH RISK: Schedule urgent inspection", 0.6075, "MEDIUM", "anomaly detected (score=-0.150); RUL below high-risk threshold (15 cycles)."),
    (-1, -0.182, 23.4, "WARNING: Strong anomaly detected", 0.5701, "MEDIUM", "anomaly detected (score=-0.182); RUL in caution zone (23 cycles)."),
    (-1, -0.12, 50.0, "WARNING: Strong anomaly detected", 0.321, "LOW", "anomaly detected (score=-0.120); RUL acceptable (50 cycles)."),
    (-1, -0.1, 90.0, "WARNING: Monitor this unit closely", 0.08, "LOW", "anomaly detected (score=-0.100); RUL acceptable (90 cycles)."),
    (-1, 0.3, 120.0, "WARNING: Monitor this unit closely", 0.0, "LOW", "anomaly detected (score=0.300); RUL acceptable (120 cycles)."),
]
NAN = float("nan")
UNKNOWN = [
    (1, 0.1, NAN, "NORMAL: System operating normally", None, "LOW", "no anomaly detected; RUL acceptable (nan cycles)."),
    (-1, -0.2, NAN, "WARNING: Strong anomaly detected", None, "MEDIUM", "anomaly detected (score=-0.200); RUL acceptable (nan cycles)."),
    (-1, NAN, 12.0, "HIGH RISK: Schedule urgent inspection", None, "MEDIUM", "anomaly detected (score=nan); RUL below high-risk threshold (12 cycles)."),
    (-1, NAN, NAN, "WARNING: Monitor this unit closely", None, "LOW", "anomaly detected (score=nan); RUL acceptable (nan cycles)."),
    (1, None, None, "NORMAL: System operating normally", None, "LOW", "no anomaly detected; RUL acceptable (nan cycles)."),
]


def _decide(spark, rows):
    df = spark.createDataFrame(rows, "anomaly_flag int, anomaly_score double, predicted_RUL double")
    return D.with_decision(df).collect()


def test_rules_against_the_table(spark):
    for rows in (TABLE, UNKNOWN):
        for want, r in zip(rows, _decide(spark, [x[:3] for x in rows]), strict=True):
            assert (r.recommended_action, r.risk_score, r.confidence, r.justification) == want[3:], want


def test_null_inputs_do_not_fail(spark):
    (r,) = _decide(spark, [(None, None, None)])
    assert r.recommended_action == C.ACTION_NORMAL
    assert r.confidence == "LOW"


def test_dashboard_classes(spark):
    df = spark.createDataFrame([(C.ACTION_CRITICAL, 0.75, 1, 0), (C.ACTION_CAUTION, 0.4, -1, 1),
                                (C.ACTION_NORMAL, 0.1, 1, 0), (None, 0.39, -1, 0)],
                               "a string, r double, f int, ae int")
    got = df.select(D.alert_level("a").alias("l"), D.alert_value("a").alias("v"), D.risk_band("r").alias("b"),
                    D.agreement("f", "ae").alias("g")).collect()
    assert [(x.l, x.v, x.b, x.g) for x in got] == [
        ("critical", 100, "critical", "Both normal"), ("warning", 60, "warning", "Both detect"),
        ("normal", 20, "low", "Both normal"), ("normal", 20, "low", "IF only")]
