"""Rows of a ledger: numbering, typed cells, hashes, salts, redaction, gaps, selection.

A source table is a DataFrame with row_no (from 1) and columns. Its long form has one row a cell:
row_no, idx, type, data, salt, hash; a redacted cell keeps its hash and nothing else.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chainlake.functions import cells as C
from chainlake.sources.work import written


def spread(table: DataFrame) -> DataFrame:
    """A table read from files, dealt out anew if it has fewer partitions than there are cores (one small file is one partition).
    Large tables have more and stay as they are, without a shuffle."""
    cores = table.sparkSession.sparkContext.defaultParallelism
    return table.repartition(cores) if table.rdd.getNumPartitions() < cores else table


def number_rows(df: DataFrame, order: list[str], name: str = "row_no", partitions: int | None = None) -> DataFrame:
    """Consecutive numbers from 1 in the order of the given columns, without gathering all rows in one task.

    Rows are range-partitioned by the order and numbered within their range; the ranges' sizes give each one's start. Rows
    that are equal in all of the order's columns get numbers in no fixed order.
    """
    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.repartitionByRange(n, *order).withColumn("_part", F.spark_partition_id())
    inside = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    # written once, as the ranges' bounds come from a sample that another run would draw anew
    placed = written(ranged.withColumn("_inside", inside), "ranges")
    sizes = placed.groupBy("_part").agg(F.count("*").alias("_n"))
    starts = sizes.select("_part", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    # one row a range
    return placed.join(F.broadcast(starts), "_part").withColumn(name, (F.col("_before") + F.col("_inside")).cast("long")).drop("_part", "_inside", "_before")


def number_by_key(df: DataFrame, key: str, name: str = "row_no") -> DataFrame:
    """Row numbers from a unique, gapless integer key that starts at any value: no sort and no shuffle of the rows."""
    low = df.agg(F.min(key).alias("_low"))
    return df.crossJoin(F.broadcast(low)).withColumn(name, (F.col(key) - F.col("_low") + 1).cast("long")).drop("_low")


def with_input_hash(df: DataFrame, columns: list[str], *, scheme: C.SaltScheme = C.NO_SALT, salt: str | None = None, name: str = "input_hash") -> DataFrame:
    """df with the hash of its row of cells: one projection, no shuffle."""
    hashes = [c["hash"] for c in C.cells_of(df, columns, scheme, salt)]
    return df.withColumn(name, C.row_hash(hashes))


def with_row_salt(df: DataFrame, seed: bytes | Column, row: str = "row_no", name: str = "row_salt") -> DataFrame:
    """df with its rows' salts, once a row; cells' salts come from it."""
    return df.withColumn(name, C.row_salt(F.lit(seed) if isinstance(seed, bytes) else seed, F.col(row)))


def long_cells(df: DataFrame, columns: list[str], *, row: str = "row_no", scheme: C.SaltScheme = C.NO_SALT, salt: str | None = None, keys: tuple[str, ...] = ()) -> DataFrame:
    """One row a cell: keys, row_no, idx, type, data, salt, hash."""
    cells = df.select(*keys, F.col(row).alias("row_no"), F.posexplode(F.array(*C.cells_of(df, columns, scheme, salt))).alias("idx", "cell"))
    return cells.select(*keys, "row_no", "idx", "cell.type", "cell.data", "cell.salt", "cell.hash")


def hash_of_cells(cells: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """keys, row_no, input_hash from the long form, also where cells are redacted."""
    gathered = cells.groupBy(*keys, "row_no").agg(F.array_sort(F.collect_list(F.struct("idx", "hash"))).alias("hs"))
    return gathered.select(*keys, "row_no", C.row_hash_of_array(F.col("hs.hash")).alias("input_hash"))


def redact(cells: DataFrame, which: Column) -> DataFrame:
    """The long form with the chosen cells redacted: hash only. Row hashes stay; redacting again changes nothing."""
    hide = F.coalesce(which, F.lit(False))
    out = cells.withColumn("_hide", hide)
    for name, value in (("type", F.lit(C.HASH).cast("tinyint")), ("data", F.lit(None).cast("binary")), ("salt", F.lit(None).cast("binary"))):
        out = out.withColumn(name, F.when(F.col("_hide"), value).otherwise(F.col(name)))
    return out.drop("_hide")


def rows_with_redactions(cells: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """Rows some cell of which has no data."""
    return cells.where(F.col("data").isNull()).select(*keys, "row_no").distinct()


def snapshot(df: DataFrame, size: int, row: str = "row_no") -> DataFrame:
    """The ledger as of a size: later rows are out of bounds."""
    return df.where(F.col(row) <= size)


def ledger_size(df: DataFrame, row: str = "row_no") -> DataFrame:
    """n_rows and size (the highest number; 0 for none)."""
    return df.agg(F.count("*").alias("n_rows"), F.coalesce(F.max(row), F.lit(0)).cast("long").alias("size"))


def with_gaps(hashes: DataFrame, size: int) -> DataFrame:
    """row_no, input_hash for 1..size: a number without a row hashes to the sentinel."""
    numbers = hashes.sparkSession.range(1, size + 1).withColumnRenamed("id", "row_no")
    return numbers.join(hashes, "row_no", "left").withColumn("input_hash", F.coalesce("input_hash", F.lit(C.SENTINEL)))


def pick(df: DataFrame, *, rows: list[int] | None = None, ranges: list[tuple[int, int]] = (), among: DataFrame | None = None, row: str = "row_no") -> DataFrame:
    """Rows by number: listed, in inclusive ranges, or in a table of numbers; any of them chooses. Filters reach the scan."""
    chosen = None
    if rows or ranges:
        test = F.col(row).isin(*rows) if rows else F.lit(False)
        for a, b in ranges:
            test = test | F.col(row).between(a, b)
        chosen = df.where(test)
    if among is not None:
        by_table = df.join(among.select(F.col(among.columns[0]).alias(row)).distinct(), row, "left_semi")
        chosen = by_table if chosen is None else chosen.unionByName(by_table).distinct()
    return df.limit(0) if chosen is None else chosen


def parse_selection(text: str) -> tuple[list[int], list[tuple[int, int]]]:
    """Numbers and dashed ranges, with commas or spaces between: "3, 7-9"."""
    rows, ranges = [], []
    for part in text.replace(",", " ").split():
        a, dash, b = part.partition("-")
        if dash:
            if int(a) > int(b):
                raise ValueError(f"the range {part} is empty")
            ranges.append((int(a), int(b)))
        else:
            rows.append(int(a))
    return rows, ranges


def oversize_to_hash(df: DataFrame, limit: int = 4096) -> DataFrame:
    """Strings and binaries of more than `limit` bytes are replaced by their SHA-256 (as a HASH cell's bytes)."""
    out = df
    for f in df.schema.fields:
        kind = f.dataType.simpleString()
        if kind in ("string", "binary"):
            data = F.encode(F.col(f.name), "UTF-8") if kind == "string" else F.col(f.name)
            out = out.withColumn(f.name, F.when(F.octet_length(data) > limit, C.sha256(data)).otherwise(data))
    return out


def prefix_find(commits: DataFrame, prefix: str, *, start: int = 1, end: int | None = None, limit: int = 8) -> DataFrame:
    """The first rows in [start, end] whose input hash (hex) starts with prefix."""
    found = commits.where(F.lower(F.hex("input_hash")).startswith(prefix.lower()) & (F.col("row_no") >= start))
    return (found.where(F.col("row_no") <= end) if end is not None else found).orderBy("row_no").limit(limit)


def as_json(cells: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """One JSON object a row: row, and cells with type, value (text; hex for binary) and, where redacted, hash."""
    names = F.array(*map(F.lit, C.TYPE_NAMES))
    hidden = F.col("data").isNull()
    value = F.when(F.col("type") == C.STRING, F.decode("data", "UTF-8")).when(F.col("type").isin(C.LONG, C.DATE), F.conv(F.hex("data"), 16, -10)).when(F.col("type") == C.BOOL, F.when(F.hex("data") == "01", "true").otherwise("false")).when(F.col("type") != C.NULL, F.lower(F.hex("data")))
    cell = F.struct(F.when(~hidden, F.element_at(names, F.col("type").cast("int") + 1)).alias("type"), F.when(~hidden, value).alias("value"), F.when(hidden, F.lower(F.hex("hash"))).alias("hash"), F.lower(F.hex("salt")).alias("salt"))
    gathered = cells.groupBy(*keys, "row_no").agg(F.array_sort(F.collect_list(F.struct("idx", cell.alias("cell")))).alias("cs"))
    return gathered.select(*keys, "row_no", F.to_json(F.struct(F.col("row_no").alias("row"), F.col("cs.cell").alias("cells"))).alias("json"))


def as_text(cells: DataFrame, separator: str = " ", hidden: str = "[X]") -> DataFrame:
    """One line a row: the values with a separator, redacted ones by a symbol."""
    value = F.when(F.col("data").isNull(), F.lit(hidden)).when(F.col("type") == C.STRING, F.decode("data", "UTF-8")).when(F.col("type").isin(C.LONG, C.DATE), F.conv(F.hex("data"), 16, -10)).when(F.col("type") == C.NULL, F.lit("")).otherwise(F.lower(F.hex("data")))
    gathered = cells.groupBy("row_no").agg(F.array_sort(F.collect_list(F.struct("idx", value.alias("v")))).alias("vs"))
    return gathered.select("row_no", F.array_join("vs.v", separator).alias("line"))
