"""Exact rounding / fixed-point formatting equal Python's on ties and random values."""
import random

from fleetwatch.functions.numeric import format_fixed, round_exact


def test_round_and_format_match_python(spark):
    rnd = random.Random(7)
    vals = [0.125, 2.5, 3.5, -0.0625, 0.0875, 1.0005, 2.675, -2.5, 1e-7, 12345.6785, 0.5, 1.5, -0.0004]
    vals += [rnd.uniform(-1000, 1000) for _ in range(300)] + [round(rnd.uniform(-5, 5), 4) for _ in range(300)]
    vals += [k / 10000 + 0.00005 for k in range(-200, 200)]
    df = spark.createDataFrame([(v,) for v in vals], "x double")
    cols = [round_exact("x", d).alias(f"r{d}") for d in (0, 2, 3, 4)]
    cols += [format_fixed("x", d).alias(f"f{d}") for d in (0, 3, 4)]
    for row in df.select("x", *cols).collect():
        x = row.x
        for d in (0, 2, 3, 4):
            assert row[f"r{d}"] == round(x, d), (x, d)
        for d in (0, 3, 4):
            assert row[f"f{d}"] == f"{x:.{d}f}", (x, d)


def test_thousands_and_iso(spark):
    from fleetwatch.functions.numeric import format_thousands, parse_iso
    df = spark.createDataFrame([(1234567, "2024-02-29T12:30:00Z"), (-999, "2024-02-29"), (None, "no time"), (0, None)], "n long, t string")
    got = df.select(format_thousands("n").alias("n"), parse_iso("t").cast("string").alias("t")).collect()
    assert [r.n for r in got] == ["1,234,567", "-999", None, "0"]
    assert [r.t for r in got] == ["2024-02-29 12:30:00", "2024-02-29 00:00:00", None, None]
