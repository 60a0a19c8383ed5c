"""Text logs as ledgers: lines with offsets, grammar, row numbers, tokens, cells, an offset index.

A log is a DataFrame (ledger_id, content) of whole texts or bytes, or a folder read with read_log(). Lines end at line feeds, the
last one may lack it. Offsets count bytes. Row numbers go to the lines that are neither comments nor (if skipped) blank.

Whole files are split inside one row, so they must fit in a task; logs beyond that are read with read_lines(), which splits files in
parallel and gets offsets, line and row numbers from running sums by file and block.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chainlake.functions import cells as C

#: Blank lines hold nothing but these.
BLANK = r"^[ \f\t\r\n]*$"
DELIMITERS = " \t\n\r\f"
MAX_LINE_BYTES = 1 << 20


@dataclass(frozen=True)
class Grammar:
    """comment: lines that start with it are no rows, nor are those that comment_pattern (a regular expression) finds something in.
    skip_blank: neither are blank lines. delimiters: of tokens; others than the default replace it, so a line feed may then
    stay in the last token."""

    comment: str | None = None
    skip_blank: bool = True
    delimiters: str = DELIMITERS
    comment_pattern: str | None = None


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """ledger_id (the file), content of every file at path."""
    files = spark.read.format("binaryFile").load(path)
    return files.select(F.col("path").alias("ledger_id"), "content")


def lines(logs: DataFrame, keys: tuple[str, ...] = ("ledger_id",), max_bytes: int = MAX_LINE_BYTES) -> DataFrame:
    """keys, line_no (from 1), offset, size (bytes with the line feed), line. A line beyond max_bytes is an error."""
    content = F.col("content").cast("string") if dict(logs.dtypes)["content"] == "binary" else F.col("content")
    parts = F.split(content, "\n", -1)
    # what follows the last line feed is a line only if there is something
    kept = F.when(F.element_at(parts, -1) == "", F.slice(parts, F.lit(1), F.size(parts) - 1)).otherwise(parts)
    split = logs.select(*keys, kept.alias("_lines"), content.endswith("\n").alias("_ended"), F.size(kept).alias("_n"))
    out = split.select(*keys, "_ended", "_n", F.posexplode("_lines").alias("_pos", "line"))
    out = out.withColumn("size", F.octet_length("line").cast("long") + F.when((F.col("_pos") + 1 < F.col("_n")) | F.col("_ended"), 1).otherwise(0))
    before = Window.partitionBy(*keys).orderBy("_pos").rowsBetween(Window.unboundedPreceding, -1)
    out = out.withColumn("offset", F.coalesce(F.sum("size").over(before), F.lit(0)).cast("long"))
    out = out.withColumn("line", F.when(F.col("size") <= max_bytes, F.col("line")).otherwise(F.raise_error(F.concat(F.lit("a line is too long at byte "), F.col("offset")))))
    return out.select(*keys, (F.col("_pos") + 1).cast("long").alias("line_no"), "offset", "size", "line")


def read_lines(spark: SparkSession, path: str, grammar: Grammar | None = None, max_bytes: int = MAX_LINE_BYTES) -> DataFrame:
    """ledger_id (the file), line_no, offset, size, line of large files, as lines() has them, split in parallel; with a grammar also
    row_no, null for lines that are no rows.

    A block's lines are numbered within it, and sums by block, one row each, give where it starts.
    """
    text = spark.read.option("lineSep", "\n").text(path).select(
        F.col("_metadata.file_path").alias("ledger_id"), F.col("_metadata.file_size").alias("_all"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_at"), F.col("value").alias("line")
    )
    text = text.withColumn("size", F.octet_length("line").cast("long") + 1)
    text = text.withColumn("_row", (is_row(F.col("line"), grammar) if grammar else F.lit(False)).cast("long"))
    order = Window.partitionBy("ledger_id", "_block").orderBy("_at")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    inside = text.withColumn("_n", F.row_number().over(order)).withColumn("_bytes", zero(F.sum("size").over(before))).withColumn("_rows", F.sum("_row").over(order))
    blocks = text.groupBy(F.col("ledger_id").alias("_of"), F.col("_block").alias("_start")).agg(F.count("*").alias("n"), F.sum("size").alias("bytes"), F.sum("_row").alias("rows"))
    earlier = Window.partitionBy("_of").orderBy("_start").rowsBetween(Window.unboundedPreceding, -1)
    starts = blocks.select("_of", "_start", *(zero(F.sum(c).over(earlier)).alias(f"_{c}_before") for c in ("n", "bytes", "rows")))
    placed = inside.join(starts, (F.col("ledger_id") == F.col("_of")) & (F.col("_block") == F.col("_start")))
    offset = F.col("_bytes_before") + F.col("_bytes")
    # the file's last line may lack its line feed
    size = F.least(F.col("size"), F.col("_all") - offset)
    line = F.when(F.col("size") <= max_bytes, F.col("line")).otherwise(F.raise_error(F.concat(F.lit("a line is too long at byte "), offset)))
    row = [F.when(F.col("_row") == 1, F.col("_rows_before") + F.col("_rows")).alias("row_no")] if grammar else []
    return placed.select("ledger_id", (F.col("_n_before") + F.col("_n")).cast("long").alias("line_no"), offset.alias("offset"), size.alias("size"), line.alias("line"), *row)


def row_bytes(wanted: DataFrame, step: int = 1 << 20) -> DataFrame:
    """wanted (ledger_id: the file, row_no, offset, end_offset, as offset_index() has them) with `data`, the row's bytes, by range reads of
    the files: ranges near each other are read together."""

    def run(batches):
        import pyarrow as pa
        from pyarrow import fs

        held, file, start, window = None, None, 0, b""
        for batch in batches:
            made = []
            for path, a, b in zip(*(batch.column(n).to_pylist() for n in ("ledger_id", "offset", "end_offset"))):
                if path != held:
                    if file is not None:
                        file.close()
                    system, inner = fs.FileSystem.from_uri(path)
                    file, held, start, window = system.open_input_file(inner), path, 0, b""
                if a < start or b > start + len(window):
                    file.seek(a)
                    start, window = a, file.read(max(step, b - a))
                made.append(window[a - start : b - start])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(made, pa.binary())], [*batch.schema.names, "data"])
        if file is not None:
            file.close()

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in wanted.schema.fields)
    return wanted.repartitionByRange("ledger_id", "offset").sortWithinPartitions("ledger_id", "offset").mapInArrow(run, f"{kinds}, data binary")


def is_row(line: Column, grammar: Grammar) -> Column:
    test = F.lit(True)
    if grammar.comment:
        test = ~line.startswith(grammar.comment)
    if grammar.comment_pattern:
        test = test & ~line.rlike(grammar.comment_pattern)
    return test & ~line.rlike(BLANK) if grammar.skip_blank else test


def rows(found: DataFrame, grammar: Grammar = Grammar(), keys: tuple[str, ...] = ("ledger_id",), max_rows: int | None = None) -> DataFrame:
    """The lines that are rows, with row_no."""
    kept = found.where(is_row(F.col("line"), grammar))
    numbered = kept.withColumn("row_no", F.row_number().over(Window.partitionBy(*keys).orderBy("line_no")).cast("long"))
    return numbered if max_rows is None else numbered.where(F.col("row_no") <= max_rows)


def tokens(line: Column, grammar: Grammar = Grammar()) -> Column:
    """The line's tokens. Delimiters other than the default leave the line feed in."""
    text = line if grammar.delimiters == DELIMITERS else F.concat(line, F.lit("\n"))
    escaped = "".join("\\" + c if c in "\\]^-[&" else {"\n": r"\n", "\r": r"\r", "\t": r"\t", "\f": r"\f"}.get(c, c) for c in grammar.delimiters)
    return F.array_remove(F.split(text, f"[{escaped}]+", -1), "")


def token_cells(found: DataFrame, grammar: Grammar = Grammar(), keys: tuple[str, ...] = ("ledger_id",)) -> DataFrame:
    """keys, row_no, idx, type, data, salt, hash: a string cell for each token."""
    each = found.select(*keys, "row_no", F.posexplode(tokens(F.col("line"), grammar)).alias("idx", "token"))
    data = F.encode("token", "UTF-8")
    return each.select(*keys, "row_no", "idx", F.lit(C.STRING).cast("tinyint").alias("type"), data.alias("data"), F.lit(None).cast("binary").alias("salt"), C.cell_hash(F.lit(C.STRING), data).alias("hash"))


def with_input_hash(found: DataFrame, grammar: Grammar = Grammar(), seed: bytes | None = None) -> DataFrame:
    """found (row_no, line and more) with input_hash; a row without tokens hashes to the sentinel. With a seed all cells are salted. One
    projection."""
    each = found.withColumn("_t", tokens(F.col("line"), grammar))
    plain = lambda t: F.concat(C.type_byte(F.lit(C.STRING)), F.encode(t, "UTF-8"))
    if seed is None:
        hashes = F.transform("_t", lambda t: C.sha256(plain(t)))
    else:
        each = each.withColumn("_salt", C.row_salt(F.lit(seed), F.col("row_no")))
        own = lambda i: C.sha256(F.concat(C.long_bytes(i), F.col("_salt"), C.long_bytes(F.bitwise_not(i.cast("long")))))
        hashes = F.transform("_t", lambda t, i: C.sha256(F.concat(own(i), plain(t))))
    return each.withColumn("_h", hashes).withColumn("input_hash", C.row_hash_of_array(F.col("_h"))).drop("_t", "_salt", "_h")


def input_hashes(found: DataFrame, grammar: Grammar = Grammar(), keys: tuple[str, ...] = ("ledger_id",), seed: bytes | None = None) -> DataFrame:
    """keys, row_no, input_hash of with_input_hash()."""
    return with_input_hash(found.select(*keys, "row_no", "line"), grammar, seed).select(*keys, "row_no", "input_hash")


def hash_stats(found: DataFrame, grammar: Grammar = Grammar()) -> DataFrame:
    """n_rows and n_tokens that hashing takes."""
    return found.agg(F.count("*").alias("n_rows"), F.coalesce(F.sum(F.size(tokens(F.col("line"), grammar))), F.lit(0)).cast("long").alias("n_tokens"))


def offset_index(found: DataFrame, keys: tuple[str, ...] = ("ledger_id",)) -> DataFrame:
    """keys, row_no, offset, end_offset: where a row's bytes lie in its log. Sorted by row for pruning when written."""
    return found.select(*keys, "row_no", "offset", (F.col("offset") + F.col("size")).alias("end_offset"))


def journal(text: DataFrame, keys: tuple[str, ...] = ("ledger_id",)) -> DataFrame:
    """Rows of a journal: the first line is a title, blank lines are no rows, words are cells."""
    return rows(lines(text, keys).where("line_no > 1"), Grammar(), keys)
