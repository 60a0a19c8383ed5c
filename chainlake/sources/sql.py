"""Ledgers from SQL: queries over tables and views, JDBC databases, catalog metadata."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chainlake.functions import cells as C
from chainlake.operators import rows as O


def sql_ledger(spark: SparkSession, query: str, order: list[str] | None = None, *, args: dict | None = None, size: int | None = None) -> DataFrame:
    """Rows of any SELECT as a ledger: a row_no column of the query is the number, else rows are numbered in the given order."""
    df = spark.sql(query, args=args or {})
    if "row_no" not in df.columns:
        if not order:
            raise ValueError("the query needs a row_no column, or an order to number its rows by")
        df = O.number_rows(df, order)
    check_types(df.drop("row_no"))
    return df if size is None else O.snapshot(df, size)


def jdbc_ledger(spark: SparkSession, url: str, query: str, *, row: str, low: int, high: int, partitions: int = 16, fetch: int = 10_000, properties: dict | None = None) -> DataFrame:
    """A ledger read from a database in parallel ranges of its row number; filters and columns are pushed into the database."""
    options = {"url": url, "dbtable": f"({query}) ledger", "partitionColumn": row, "lowerBound": low, "upperBound": high, "numPartitions": partitions, "fetchsize": fetch} | (properties or {})
    df = spark.read.format("jdbc").options(**options).load()
    check_types(df.drop(row))
    return df.withColumnRenamed(row, "row_no")


def save_commits(chain: DataFrame, url: str, table: str, mode: str = "append", properties: dict | None = None) -> None:
    """Chain rows into a database table (row_idx, src_hash, row_hash; hashes as hex, as databases differ in binary types)."""
    text = lambda c: F.lower(F.hex(c))
    rows = chain.select(F.col("row_no").alias("row_idx"), text("input_hash").alias("src_hash"), text("row_hash").alias("row_hash"))
    options = {"url": url, "dbtable": table, "createTableColumnTypes": "src_hash CHAR(64), row_hash CHAR(64)"} | (properties or {})
    rows.write.format("jdbc").options(**options).mode(mode).save()


def jdbc_commits(spark: SparkSession, url: str, table: str, ledger_id: str, *, high: int, low: int = 1, partitions: int = 16, properties: dict | None = None) -> DataFrame:
    """A chain kept in such a table, read in parallel ranges of its row number."""
    options = {"url": url, "dbtable": table, "partitionColumn": "row_idx", "lowerBound": low, "upperBound": high, "numPartitions": partitions} | (properties or {})
    rows = spark.read.format("jdbc").options(**options).load()
    return rows.select(F.lit(ledger_id).alias("ledger_id"), F.col("row_idx").alias("row_no"), F.unhex(F.trim("src_hash")).alias("input_hash"), F.unhex(F.trim("row_hash")).alias("row_hash"))


def check_types(df: DataFrame) -> None:
    """An error for columns that can't be cells (floats, arrays, structs, maps, intervals)."""
    for f in df.schema.fields:
        C.typed(F.col(f.name), f.dataType, f.name)


def check_query(text: str, parameters: int) -> str:
    """The text, if it has as many ? outside of quotes as asked for (1 in row queries, 0 in size queries)."""
    if (found := re.sub(r"'[^']*'|\"[^\"]*\"", "", text).count("?")) != parameters:
        raise ValueError(f"{found} parameters instead of {parameters}")
    return text


def point_query(spark: SparkSession, text: str, row_no: int) -> DataFrame:
    """A row query with one ? run for a row number."""
    quoted = re.split(r"('[^']*'|\"[^\"]*\")", check_query(text, 1))
    return spark.sql("".join(p if i % 2 else p.replace("?", ":row_no") for i, p in enumerate(quoted)), args={"row_no": row_no})


def preview(df: DataFrame, n: int = 10) -> DataFrame:
    return df.limit(n)


def tables(spark: SparkSession, pattern: str | None = None) -> DataFrame:
    """name, kind, temporary of the catalog's tables and views."""
    found = [(t.name, t.tableType, t.isTemporary) for t in spark.catalog.listTables() if pattern is None or re.search(pattern, t.name)]
    return spark.createDataFrame(found, "name string, kind string, temporary boolean")


def column_classes(df: DataFrame) -> list[tuple[str, str]]:
    """(column, class) for display: number, text, date, boolean, binary or other."""
    groups = {"number": ("tinyint", "smallint", "int", "bigint", "float", "double", "decimal"), "text": ("string", "char", "varchar"), "date": ("date", "timestamp", "timestamp_ntz"), "boolean": ("boolean",), "binary": ("binary",)}
    return [(c, next((g for g, names in groups.items() if k.partition("(")[0] in names), "other")) for c, k in df.dtypes]


def neighbours(keys: DataFrame, table: str, loaded: list[str] | None = None) -> DataFrame:
    """Of foreign keys (from_table, to_table): the tables that `table` refers to, and those that depend on it."""
    if loaded is not None:
        keys = keys.where(F.col("from_table").isin(*loaded) & F.col("to_table").isin(*loaded))
    out = keys.where(F.col("from_table") == table).select(F.col("to_table").alias("name"), F.lit("referred").alias("side"))
    return out.unionByName(keys.where(F.col("to_table") == table).select(F.col("from_table").alias("name"), F.lit("dependent").alias("side"))).distinct()
