"""Skew-safe ordered operations inside a unit.

Telemetry is keyed by unit and ordered by cycle.  ``Window.partitionBy(unit)`` sends
every row of a unit to one task.  That is the cheapest plan (one exchange that numbering,
features and per-unit aggregates share) as long as the largest unit fits a task, which
one count per unit tells.  Where a unit has more than ``UNIT_ROWS`` rows:

* ``number_rows`` cuts crowded units into ranges of the order at approximate quantiles,
  numbers the rows in each (unit, range) and adds the counts of the ranges before it:
  a table of at most units + ranges rows.
* ``ordered_rows`` numbers the rows that way and cuts them into blocks of consecutive
  *positions* (not cycles, which may have gaps); the last ``halo`` rows of each block are
  copied into the next, so a row frame of ``halo + 1`` rows computed per block is exact.

Both give the same rows either way.
"""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..session import materialize

#: Rows of one unit that a single task orders.
UNIT_ROWS = 1_000_000
DEFAULT_BLOCK = 65_536
BLK = "_blk"
COPY = "_copy"
POS = "_pos"


def largest_unit(df: DataFrame, unit: str) -> int:
    """Rows of the unit with the most rows: a partial count that reads one column."""
    return df.groupBy(unit).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0


def number_rows(df: DataFrame, unit: str, order: list, cut, out: str = "time_cycle",
                total_out: str | None = None, limit: int | None = None) -> DataFrame:
    """Add ``out`` = row number (bigint, 1-based) of each row within ``unit`` in ``order``.

    ``total_out`` also adds the unit's row count (its last number).  ``cut`` is a numeric
    column that never falls along ``order``; crowded units are cut into ranges of it."""
    limit = limit or UNIT_ROWS
    largest = largest_unit(df, unit)
    if largest <= limit:
        w = Window.partitionBy(unit)
        cols = {out: F.row_number().over(w.orderBy(*order)).cast("long")}
        if total_out:
            cols[total_out] = F.count(F.lit(1)).over(w)
        return df.withColumns(cols)
    d = with_ranges(df, unit, cut, largest, limit)
    sizes = d.groupBy(unit, BLK).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(unit).orderBy(BLK).rowsBetween(Window.unboundedPreceding, -1)
    cols = [unit, BLK, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off")]
    if total_out:
        cols.append(F.sum("_n").over(Window.partitionBy(unit)).cast("long").alias(total_out))
    within = Window.partitionBy(unit, BLK).orderBy(*order)
    return (d.join(sizes.select(*cols), [unit, BLK])
            .withColumn(out, (F.row_number().over(within) + F.col("_off")).cast("long"))
            .drop(BLK, "_off"))


def with_ranges(df: DataFrame, unit: str, cut, largest: int, limit: int) -> DataFrame:
    """Add ``_blk``: the range of ``cut`` in which a row of a crowded unit lies, 0 elsewhere."""
    ranges = min(4096, 2 * -(-largest // limit))
    marks = [i / ranges for i in range(1, ranges)]
    keyed = df.withColumn("_cut", cut)
    crowded = (keyed.groupBy(unit).agg(F.count(F.lit(1)).alias("_n"), F.percentile_approx("_cut", marks, 10000).alias("_cuts"))
               .where(F.col("_n") > limit).select(unit, "_cuts"))
    crowded = materialize(crowded, "crowded-units")
    at = F.size(F.filter("_cuts", lambda c: c < F.col("_cut")))
    return (keyed.join(crowded, unit, "left").withColumn(BLK, F.when(F.col("_cuts").isNull(), 0).otherwise(at))
            .drop("_cuts", "_cut"))


def with_halo(df: DataFrame, unit: str, position: str, halo: int, block_size: int = DEFAULT_BLOCK) -> DataFrame:
    """Add block column ``_blk`` and copy flag ``_copy`` (1 = halo copy of a row), by blocks of
    ``position`` = 1, 2, ... without gaps.

    Window over ``Window.partitionBy(unit, "_blk")`` then drop rows with ``_copy = 1``.
    """
    if halo >= block_size:
        raise ValueError("halo must be smaller than the block size")
    pos = (F.col(position) - 1) % block_size
    copies = F.when(pos >= block_size - halo, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return (df.withColumn(COPY, F.explode(copies))
            .withColumn(BLK, F.floor((F.col(position) - 1) / block_size) + F.col(COPY)))


def ordered_rows(df: DataFrame, unit: str, cycle: str, halo: int, limit: int | None = None,
                 block_size: int = DEFAULT_BLOCK) -> tuple[DataFrame, WindowSpec, Callable[[DataFrame], DataFrame]]:
    """(frame, window, finish): row frames that look back at most ``halo`` rows are exact over
    ``window`` in ``frame``; ``finish`` gives the rows of ``df`` with the columns added."""
    if largest_unit(df, unit) <= (limit or UNIT_ROWS):
        return df, Window.partitionBy(unit).orderBy(cycle), lambda d: d
    numbered = number_rows(df, unit, [cycle], F.col(cycle).cast("double"), out=POS, limit=limit)
    blocks = with_halo(numbered, unit, POS, halo, block_size)
    return blocks, Window.partitionBy(unit, BLK).orderBy(POS), drop_halo


def drop_halo(df: DataFrame) -> DataFrame:
    return df.where(F.col(COPY) == 0).drop(COPY, BLK, POS)


def top_k_per_unit(df: DataFrame, unit: str, cycle: str, k: int, out: str = "rank_from_latest") -> DataFrame:
    """The ``k`` latest rows (largest ``cycle``) of every unit.

    ``row_number <= k`` lets Catalyst plan a partial WindowGroupLimit before the
    exchange, so each map task ships at most ``k`` rows per unit: a hot unit costs
    k x map-partitions rows in the final task, not its whole history.
    """
    w = Window.partitionBy(unit).orderBy(F.col(cycle).desc())
    return df.withColumn(out, F.row_number().over(w).cast("long")).where(F.col(out) <= k)
