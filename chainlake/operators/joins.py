"""Lookups between ledgers and along a ledger: references, nearest records, witnesses.

References (from_ledger, from_row, from_col, to_ledger, to_row, to_col) say that a cell equals a cell; columns -1 and -1: that whole
rows are equal; to_col -2: that a cell holds the row hash of a committed row. Checks are equi-joins on (ledger, row, cell).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chainlake.operators.ordered import carried

WHOLE_ROW, ROW_HASH = -1, -2


def check_references(refs: DataFrame, cells: DataFrame, commits: DataFrame | None = None) -> DataFrame:
    """refs with ok: the two sides are there, not redacted, and equal. cells: ledger_id, row_no, idx, data."""
    at = lambda side, ledger, row: cells.select(F.col("ledger_id").alias(ledger), F.col("row_no").alias(row), F.col("idx").alias(f"{side}_idx"), F.col("data").alias(f"{side}_data"))
    columns = refs.columns
    plain = refs.where((F.col("from_col") >= 0) & (F.col("to_col") >= 0))
    a, b = at("f", "from_ledger", "from_row"), at("t", "to_ledger", "to_row")
    joined = plain.join(a.withColumnRenamed("f_idx", "from_col"), ["from_ledger", "from_row", "from_col"], "left").join(b.withColumnRenamed("t_idx", "to_col"), ["to_ledger", "to_row", "to_col"], "left")
    out = joined.select(*columns, F.coalesce(F.col("f_data") == F.col("t_data"), F.lit(False)).alias("ok"))

    whole = refs.where((F.col("from_col") == WHOLE_ROW) & (F.col("to_col") == WHOLE_ROW))
    rows = cells.groupBy("ledger_id", "row_no").agg(F.array_sort(F.collect_list(F.struct("idx", "data"))).alias("ds"), F.max(F.col("data").isNull()).alias("hidden"))
    rows = rows.where("not hidden").select("ledger_id", "row_no", F.col("ds.data").alias("ds"))
    f = rows.select(F.col("ledger_id").alias("from_ledger"), F.col("row_no").alias("from_row"), F.col("ds").alias("f_ds"))
    t = rows.select(F.col("ledger_id").alias("to_ledger"), F.col("row_no").alias("to_row"), F.col("ds").alias("t_ds"))
    joined = whole.join(f, ["from_ledger", "from_row"], "left").join(t, ["to_ledger", "to_row"], "left")
    out = out.unionByName(joined.select(*columns, F.coalesce(F.col("f_ds") == F.col("t_ds"), F.lit(False)).alias("ok")))

    if commits is not None:
        held = refs.where((F.col("from_col") >= 0) & (F.col("to_col") == ROW_HASH))
        to = commits.select(F.col("ledger_id").alias("to_ledger"), F.col("row_no").alias("to_row"), F.col("row_hash").alias("t_hash"))
        joined = held.join(a.withColumnRenamed("f_idx", "from_col"), ["from_ledger", "from_row", "from_col"], "left").join(to, ["to_ledger", "to_row"], "left")
        out = out.unionByName(joined.select(*columns, F.coalesce(F.col("f_data") == F.col("t_hash"), F.lit(False)).alias("ok")))
    return out


def reduce_rows(cells: DataFrame, refs: DataFrame, keep: list[str]) -> DataFrame:
    """All rows of the ledgers to keep, and of others only those that a reference names on either side."""
    named = refs.select(F.col("from_ledger").alias("ledger_id"), F.col("from_row").alias("row_no")).unionByName(refs.select(F.col("to_ledger").alias("ledger_id"), F.col("to_row").alias("row_no"))).distinct()
    principal = F.col("ledger_id").isin(*keep) if keep else F.lit(False)
    return cells.where(principal).unionByName(cells.where(~principal).join(named, ["ledger_id", "row_no"], "left_semi"))


def rename_ledgers(df: DataFrame, names: dict[str, str], columns: tuple[str, ...] = ("ledger_id",)) -> DataFrame:
    """Ledger ids replaced, wherever they are named."""
    return df.replace(names, subset=list(columns)) if names else df


def _nearest(targets: DataFrame, records: DataFrame, on: str, keys: list[str], later: bool) -> DataFrame:
    """For each target the record with the least `on` >= its own (later), or the greatest <= its own."""
    value = F.struct(*(F.col(c) for c in records.columns if c not in keys)).alias("_rec")
    both = targets.select(*(F.col(c) for c in targets.columns), F.lit(None).cast(records.select(value).schema["_rec"].dataType).alias("_rec"), F.lit(1).alias("_t"))
    probe = [c if c in (*keys, on) else None for c in targets.columns]
    extra = records.select(*(F.col(c) if c else F.lit(None).cast(targets.schema[n].dataType).alias(n) for c, n in zip(probe, targets.columns)), value, F.lit(0).alias("_t"))
    # one order over both instead of a range join; a record at the target's own place counts in both directions
    out = carried(both.unionByName(extra), F.col("_rec"), on, then=("_t",), keys=tuple(keys), descending=later, name="_found").where("_t = 1")
    return out.select(*targets.columns, *(F.col(f"_found.{c}").alias(f"near_{c}") for c in records.columns if c not in keys))


def next_record(targets: DataFrame, records: DataFrame, on: str = "row_no", keys: list[str] | None = None) -> DataFrame:
    """targets with near_*: the first record at or after each (as a witness that covers it)."""
    return _nearest(targets, records, on, keys or [], True)


def previous_record(targets: DataFrame, records: DataFrame, on: str = "row_no", keys: list[str] | None = None) -> DataFrame:
    """targets with near_*: the last record at or before each (as a checkpoint to start from)."""
    return _nearest(targets, records, on, keys or [], False)


def with_epoch_seed(df: DataFrame, epochs: list[tuple[int, bytes]], row: str = "row_no", name: str = "seed") -> DataFrame:
    """df with the seed of its salt epoch: that with the greatest start at or before the row. Epochs are few and secret, and
    never leave the plan as a table: the choice is an expression."""
    ordered = sorted(epochs)
    if not ordered or ordered[0][0] != 1:
        raise ValueError("the first epoch must start at row 1")
    if len({len(s) for _, s in ordered}) > 1 or len({a for a, _ in ordered}) < len(ordered):
        raise ValueError("epochs need seeds of equal length and different starts")
    seed = F.lit(ordered[0][1])
    for start, s in ordered[1:]:
        seed = F.when(F.col(row) >= start, F.lit(s)).otherwise(seed)
    return df.withColumn(name, seed)


def notary_check(notarized: DataFrame, commits: DataFrame, blocks: DataFrame | None = None, block_millis: int = 1) -> DataFrame:
    """notarized (ledger_id, chain_id, row_no, utc, row_hash) with ok: the committed row has that hash and, with blocks
    (chain_id, block_no, input_hash), the time chain's block at utc took it in."""
    own = commits.select("ledger_id", "row_no", F.col("row_hash").alias("_own"))
    out = notarized.join(own, ["ledger_id", "row_no"], "left")
    ok = F.col("_own") == F.col("row_hash")
    if blocks is not None:
        out = out.withColumn("_block", F.floor(F.col("utc") / block_millis))
        taken = blocks.select("chain_id", F.col("block_no").alias("_block"), F.col("input_hash").alias("_cargo"))
        out = out.join(taken, ["chain_id", "_block"], "left")
        ok = ok & (F.col("_cargo") == F.col("row_hash"))
    return out.select(*notarized.columns, F.coalesce(ok, F.lit(False)).alias("ok"))


def notary_monotone(notarized: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Records that no record of the same or a higher row precedes in time or equals: earlier proofs of more rows win."""
    keys = keys or ["ledger_id", "chain_id"]
    best = notarized.groupBy(*keys, "row_no").agg(F.min("utc").alias("utc"))
    above = Window.partitionBy(*keys).orderBy(F.col("row_no").desc()).rowsBetween(Window.unboundedPreceding, -1)
    return best.withColumn("_above", F.min("utc").over(above)).where("_above is null or utc < _above").drop("_above")


def witness_rows(chain: DataFrame, exponent: int, include_last: bool = True, after: int = 0, limit: int | None = None) -> DataFrame:
    """Rows to witness: beyond `after`, those that 2 ** exponent divides (the first `limit` of each ledger, if asked), and the last one."""
    new = chain.where(F.col("row_no") > after).select("ledger_id", "row_no")
    tooth = new.where(F.col("row_no") % (1 << exponent) == 0)
    if limit is not None:
        # numbers have no gaps, so the limit is a number; at most one row of every step is left
        tooth = tooth.where(F.col("row_no") <= F.lit((after >> exponent) + limit) * (1 << exponent))
    if not include_last:
        return tooth
    return tooth.unionByName(new.groupBy("ledger_id").agg(F.max("row_no").alias("row_no"))).distinct()


def thin_witnesses(records: DataFrame, bucket_millis: int = 10_000, keys: list[str] | None = None) -> DataFrame:
    """Records (row_no, utc) whose time falls into another step of bucket_millis than the record before, by row."""
    step = lambda c: F.floor(c / bucket_millis)
    found = carried(records, F.col("utc"), "row_no", keys=tuple(keys or ()), own=False, name="_before")
    return found.where(F.col("_before").isNull() | (step(F.col("utc")) != step(F.col("_before")))).select(*records.columns)


def witness_zip(records: DataFrame, rows: DataFrame) -> DataFrame:
    """Records (position, utc, hash) with the rows (position, row_no, row_hash) at the same position; ok: the hashes are equal."""
    return records.join(rows, "position", "full").select("position", "row_no", "utc", F.coalesce(F.col("hash") == F.col("row_hash"), F.lit(False)).alias("ok"))


def containing(rows: DataFrame, among: DataFrame) -> DataFrame:
    return rows.join(among, ["row_no"], "left_semi")


def missing(rows: DataFrame, among: DataFrame) -> DataFrame:
    return rows.join(among, ["row_no"], "left_anti")
