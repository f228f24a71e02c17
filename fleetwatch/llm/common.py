"""What the operators' drivers share: reading tables, clash-free columns, sizes."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..session import ensure_checkpoint_dir, ship_package

ROWS_PER_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def prepare(spark: SparkSession) -> None:
    """Workers get the package; the shared folder is known."""
    ship_package(spark)
    ensure_checkpoint_dir(spark)
    # texts are long: Spark's default of 10,000 rows makes batches of tens of MB, several times
    # in each task; a setting of the caller's own stays
    if spark.conf.get(ROWS_PER_BATCH, "10000") == "10000":
        spark.conf.set(ROWS_PER_BATCH, "1000")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/pages.parquet")


def only(df: DataFrame, **columns: str) -> DataFrame:
    """Just the named columns under the operator's own names, so that other columns
    of the caller can have any name without clashing."""
    return df.select(*[df[_quoted(c)].alias(name) for name, c in columns.items()])


def _quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def fold(id_column: Column | str, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; a null id counts as the empty text."""
    c = F.col(id_column) if isinstance(id_column, str) else id_column
    return F.crc32(F.coalesce(c.cast("string"), F.lit("")).cast("binary")) % folds


def shuffle_parts(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))
