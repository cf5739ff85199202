"""Tables written: whole, appended, as text, or a part of another."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventframe.plans import formula
from eventframe.sources.tables import ENTRY, parquet

_MODES = {"RECREATE": "overwrite", "CREATE": "error", "NEW": "error", "UPDATE": "append"}


def new_folder(spark: SparkSession) -> str:
    """A folder that all workers reach: below the checkpoint folder, or a temporary one of a single machine."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all workers reach")
        root = "file://" + tempfile.mkdtemp(prefix="eventframe-")
    return f"{root.rstrip('/')}/tables-{uuid.uuid4().hex}"


def write(df: DataFrame, path: str, mode: str = "RECREATE", compression: str = "zstd", ordered: bool = False) -> DataFrame:
    """Write Parquet and read it again. ``UPDATE`` adds to what is there; a failure leaves that as it was."""
    out = df.orderBy(ENTRY) if ordered and ENTRY in df.columns else df
    out.drop(ENTRY, "__file").write.mode(_MODES.get(mode, mode)).option("compression", compression).parquet(path)
    return parquet(df.sparkSession, path)


def copy_where(df: DataFrame, path: str, selection: str = "", start: int = 0, stop: int | None = None) -> DataFrame:
    """Entries from ``start`` up to ``stop`` that pass a formula, as a table of their own; an empty span copies the schema."""
    out = df
    if ENTRY in df.columns and (start or stop is not None):
        out = out.where((F.col(ENTRY) >= start) & (F.lit(stop is None) | (F.col(ENTRY) < (stop or 0))))
    return write(formula.selected(out, selection) if selection else out, path)


def write_ascii(df: DataFrame, path: str, columns: list[str], separator: str = " ") -> None:
    """Rows as text."""
    df.select(F.concat_ws(separator, *[F.col(c).cast("string") for c in columns]).alias("value")).write.mode("overwrite").text(path)


def scan_to_file(df: DataFrame, expressions: str, file: str, cut: str = "", rows: int = 25) -> str:
    """A formatted scan, written on the driver."""
    text = formula.scan(df, expressions, cut, rows)
    with open(file, "w", encoding="utf-8") as out:
        out.write(text + "\n")
    return text


def partitioned(df: DataFrame, path: str, by: list[str]) -> None:
    """One folder per key, so that later reads skip the others."""
    df.repartition(*by).write.mode("overwrite").partitionBy(*by).parquet(path)


def bucketed(df: DataFrame, table: str, buckets: int, by: list[str]) -> None:
    """A table whose joins and groupings on ``by`` need no shuffle."""
    df.write.mode("overwrite").bucketBy(buckets, *by).sortBy(*by).saveAsTable(table)
