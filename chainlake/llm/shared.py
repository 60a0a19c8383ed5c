"""What the operators share: the work folder, written tables, word patterns."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chainlake.sources import work

#: A word is a run of characters other than these six; the same class as bytes.split().
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"
#: Tables of at most this many rows (one short row each) may be broadcast; larger ones are shuffled.
BROADCAST_ROWS = 50_000


def new_path(spark: SparkSession, name: str) -> str:
    """A place of its own in the folder that driver and executors share."""
    return f"{work.folder(spark)}/{uuid.uuid4().hex[:12]}-{name}"


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write df as a table in the work folder and read it back: later steps start from the files, also after executors are lost."""
    path = new_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small(df: DataFrame, rows: int) -> DataFrame:
    """Hint a broadcast only for a table whose counted rows are within the bound."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def literal_rows(spark: SparkSession, rows: tuple, names: tuple[str, ...]) -> DataFrame:
    """A small fixed table, as literals in the plan."""
    each = [F.struct(*(F.lit(v).alias(n) for v, n in zip(row, names))) for row in rows]
    return spark.range(1).select(F.inline(F.array(*each)))


def row_of(df: DataFrame) -> Column:
    """All columns as one struct `row`, so that no name of theirs meets one of ours."""
    return F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("row")


def word_count(text: Column) -> Column:
    """Number of words; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
