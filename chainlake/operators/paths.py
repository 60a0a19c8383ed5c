"""Paths: small sets of linked chain rows, as DataFrames of (path_id, row_no, input_hash, row_hash, pointers).

pointers is the array of the hashes pointed to, by level. Paths are picked from a chain by a semi-join with the row numbers
that stitching gives; numbers come from arithmetic alone, on the driver for a list of targets, in expressions for columns.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chainlake.functions import cells as C
from chainlake.functions import merkle
from chainlake.functions import rownumbers as R
from chainlake.operators import chain as H
from chainlake.operators.ordered import carried


def path_of(chain: DataFrame, targets: list[int], path_id: str = "path") -> DataFrame:
    """The path through the targets (stitched) in a chain of one ledger."""
    spark = chain.sparkSession
    rows = [r for r in R.stitch(targets) if r > 0]
    wanted = spark.createDataFrame([(r,) for r in rows], "row_no long")
    # a path has a few rows for each target; the pointed-to rows are looked up, not the whole chain
    held = spark.createDataFrame([(r,) for r in R.coverage(rows) if r > 0], "row_no long")
    near = chain.join(F.broadcast(held), "row_no", "left_semi")
    targets_ = near.select("ledger_id", F.col("row_no").alias("points_to"), F.col("row_hash").alias("pointer"))
    own = near.join(F.broadcast(wanted), "row_no", "left_semi")
    joined = H.pointers(own).join(targets_, ["ledger_id", "points_to"], "left")
    value = F.when(F.col("points_to") == 0, F.lit(C.SENTINEL)).otherwise(F.col("pointer"))
    gathered = joined.groupBy("ledger_id", "row_no").agg(F.array_sort(F.collect_list(F.struct("level", value.alias("h")))).alias("hs"))
    return own.join(gathered, ["ledger_id", "row_no"]).select(F.lit(path_id).alias("path_id"), "row_no", "input_hash", "row_hash", F.col("hs.h").alias("pointers"))


def state_path(chain: DataFrame, path_id: str = "state") -> DataFrame:
    """The path from the first to the last row."""
    last = chain.agg(F.max("row_no")).first()[0] or 0
    return path_of(chain, [1, last] if last else [], path_id)


def skip_paths(pairs: DataFrame) -> DataFrame:
    """pairs with low, high: one row (low, high, step, row_no) a step of the skip path."""
    return pairs.select("low", "high", F.posexplode(R.skip_path_col(F.col("low"), F.col("high"))).alias("step", "row_no"))


def stitched(rows: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """The row numbers (per keys) of the path that the given numbers stitch to."""
    pairs = carried(rows.select(*keys, "row_no").distinct(), F.col("row_no"), "row_no", keys=keys, own=False, name="low")
    return pairs.select(*keys, F.explode(R.skip_path_col(F.coalesce("low", "row_no"), F.col("row_no"))).alias("row_no")).distinct()


def covered_numbers(rows: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """The given row numbers and all that they point to."""
    own = rows.where("row_no > 0").select(*keys, "row_no")
    return rows.select(*keys, "row_no").unionByName(own.select(*keys, F.explode(R.pointers_col(F.col("row_no"))).alias("row_no"))).distinct()


def reference_numbers(rows: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """Numbers that are pointed to but not given, without the sentinel."""
    return covered_numbers(rows, keys).where("row_no > 0").join(rows.select(*keys, "row_no"), [*keys, "row_no"], "left_anti")


def links(rows: DataFrame) -> DataFrame:
    """low, high pairs with their level (-1 equal, -2 not linked)."""
    return rows.withColumn("level", R.linked_col(F.col("low"), F.col("high")))


def known_hashes(paths: DataFrame) -> DataFrame:
    """path_id, row_no, row_hash of rows and of all rows that they point to: what a path knows."""
    own = paths.select("path_id", "row_no", "row_hash")
    level = paths.select("path_id", F.col("row_no").alias("of"), F.posexplode("pointers").alias("k", "row_hash"))
    pointed = level.select("path_id", (F.col("of") - F.call_function("shiftleft", F.lit(1).cast("long"), F.col("k"))).alias("row_no"), "row_hash")
    return own.unionByName(pointed.where("row_no > 0")).distinct()


def verify_paths(paths: DataFrame, scheme: str = "v05") -> DataFrame:
    """path_id, ok, rows, lo, hi: neighbours are linked, hashes follow from inputs and pointers, and no row has two hashes."""
    flat = F.unhex(F.array_join(F.transform("pointers", lambda h: F.hex(h)), ""))
    rows = paths
    if scheme == "v06":
        flat = F.when(F.size("pointers") == 1, flat).otherwise(merkle.root_col(F.col("pointers")))
    by_path = Window.partitionBy("path_id").orderBy("row_no")
    rows = rows.withColumn("before", F.lag("row_no").over(by_path))
    sound = (C.sha256(F.concat("input_hash", flat)) == F.col("row_hash")) & (F.size("pointers") == R.skip_count_col(F.col("row_no")))
    step = F.col("before").isNull() | (R.linked_col(F.col("before"), F.col("row_no")) >= 0)
    each = rows.groupBy("path_id").agg(F.min(F.coalesce(sound & step, F.lit(False))).alias("sound"), F.count("*").alias("rows"), F.min("row_no").alias("lo"), F.max("row_no").alias("hi"))
    clash = known_hashes(paths).groupBy("path_id", "row_no").agg(F.countDistinct("row_hash").alias("n")).groupBy("path_id").agg((F.max("n") > 1).alias("clash"))
    return each.join(clash, "path_id").select("path_id", (F.col("sound") & ~F.col("clash")).alias("ok"), "rows", "lo", "hi")


def compare(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: common_no (highest row that both know with one hash), conflict_no (lowest with two), fork_no (the row after
    common_no, if that is where they part)."""
    left = known_hashes(a).select("row_no", F.col("row_hash").alias("x"))
    right = known_hashes(b).select("row_no", F.col("row_hash").alias("y"))
    both = left.join(right, "row_no")
    same = F.col("x") == F.col("y")
    found = both.agg(F.coalesce(F.max(F.when(same, F.col("row_no"))), F.lit(0)).alias("common_no"), F.min(F.when(~same, F.col("row_no"))).alias("conflict_no"))
    return found.withColumn("fork_no", F.when(F.col("conflict_no") == F.col("common_no") + 1, F.col("conflict_no")))


def common_rows(a: DataFrame, b: DataFrame) -> DataFrame:
    """Row numbers that both paths cover, with equal hashes."""
    return known_hashes(a).select("row_no", "row_hash").intersect(known_hashes(b).select("row_no", "row_hash")).select("row_no")


def slice_path(path: DataFrame, *, head: int | None = None, tail: int | None = None) -> DataFrame:
    """The part below row `head`, or from row `tail` on."""
    out = path if head is None else path.where(F.col("row_no") < head)
    return out if tail is None else out.where(F.col("row_no") >= tail)


def merge(base: DataFrame, more: DataFrame, path_id: str = "merged") -> DataFrame:
    """The union of the rows of two paths that know a common row; an error if they conflict or don't meet."""
    found = compare(base, more).first()
    if found["conflict_no"] is not None:
        raise ValueError(f"the paths conflict at row {found['conflict_no']}")
    if not found["common_no"]:
        raise ValueError("the paths have no row in common")
    return base.unionByName(more).dropDuplicates(["row_no"]).withColumn("path_id", F.lit(path_id))


def add_row(path: DataFrame, row: DataFrame) -> DataFrame:
    """The path with one more row: above the highest it must link to it, below it must be known from above with the same hash."""
    given = row.first()
    hi = path.agg(F.max("row_no")).first()[0]
    if given["row_no"] > hi:
        level = R.linked(hi, given["row_no"])
        top = path.where(F.col("row_no") == hi).first()
        if level < 0 or given["pointers"][level] != top["row_hash"]:
            raise ValueError(f"row {given['row_no']} doesn't link to row {hi}")
    elif not known_hashes(path).where((F.col("row_no") == given["row_no"]) & (F.col("row_hash") == F.lit(bytes(given["row_hash"])))).limit(1).count():
        raise ValueError(f"row {given['row_no']} isn't known with that hash")
    same = path.select("path_id").limit(1)
    return path.unionByName(row.drop("path_id").crossJoin(F.broadcast(same)).select(*path.columns)).dropDuplicates(["row_no"])


def append_tail(path: DataFrame, tail: DataFrame) -> DataFrame:
    """The path up to and without the tail's lowest row, then the tail; the path must know that row with the tail's hash."""
    first = tail.orderBy("row_no").select("row_no", "row_hash").first()
    if first is None:
        return path
    known = known_hashes(path).where(F.col("row_no") == first["row_no"]).select("row_hash").distinct().collect()
    if [bytes(k["row_hash"]) for k in known] != [bytes(first["row_hash"])]:
        raise ValueError(f"the path doesn't know row {first['row_no']} with that hash")
    same = F.broadcast(path.select("path_id").limit(1))
    return path.where(F.col("row_no") < first["row_no"]).unionByName(tail.drop("path_id").crossJoin(same).select(*path.columns))


def compare_many(paths: DataFrame, path: DataFrame) -> DataFrame:
    """compare() of one path with many of one ledger, one row: the best common row over all of them and the lowest conflict. An error
    if one of them agrees with the path at or above the row at which another disagrees: they are of different ledgers."""
    many = known_hashes(paths).select("path_id", "row_no", F.col("row_hash").alias("x"))
    mine = known_hashes(path).select("row_no", F.col("row_hash").alias("y"))
    both = many.join(mine, "row_no")
    same = F.col("x") == F.col("y")
    found = both.agg(F.coalesce(F.max(F.when(same, F.col("row_no"))), F.lit(0)).alias("common_no"), F.min(F.when(~same, F.col("row_no"))).alias("conflict_no"))
    wrong = F.concat(F.lit("paths of different ledgers: row "), "common_no", F.lit(" agrees, row "), "conflict_no", F.lit(" doesn't"))
    common = F.when(F.col("common_no") >= F.col("conflict_no"), F.raise_error(wrong).cast("long")).otherwise(F.col("common_no"))
    found = found.withColumn("common_no", common)
    return found.withColumn("fork_no", F.when(F.col("conflict_no") == F.col("common_no") + 1, F.col("conflict_no")))


def authorities(paths: DataFrame) -> DataFrame:
    """path_id, hi of paths whose highest row no other path with a higher one knows."""
    tops = paths.groupBy("path_id").agg(F.max("row_no").alias("hi"))
    known = known_hashes(paths).join(tops.withColumnRenamed("hi", "top"), "path_id").select(F.col("row_no").alias("hi"), "top").groupBy("hi").agg(F.max("top").alias("best"))
    return tops.join(known, "hi", "left").where(F.coalesce("best", F.lit(0)) <= F.col("hi")).select("path_id", "hi")


def condensed(path: DataFrame) -> DataFrame:
    """path_id, row_no, input_hash, row_hash, level, level_hash, funnel, pointers: condensable rows keep of their pointers only the one to
    the row before in the path (the lowest row: to row - 1), with its proof against all; the others keep all (scheme v06)."""
    before = F.lag("row_no").over(Window.partitionBy("path_id").orderBy("row_no"))
    fewer = R.condensable_col(F.col("row_no"))
    rows = path.withColumn("before", F.coalesce(before, F.col("row_no") - 1)).withColumn("level", F.when(fewer, R.linked_col(F.col("before"), F.col("row_no"))))
    proof = merkle.funnel_col(F.col("pointers"), F.col("level"))
    return rows.select("path_id", "row_no", "input_hash", "row_hash", "level", F.when(fewer, F.get("pointers", F.col("level"))).alias("level_hash"), F.when(fewer, proof).alias("funnel"), F.when(~fewer, F.col("pointers")).alias("pointers"))


def verify_condensed(rows: DataFrame) -> DataFrame:
    """path_id, row_no, ok of condensed rows (scheme v06): hashes follow from inputs and pointers or proofs, and what a row says of the row
    before is that row's hash."""
    count = R.skip_count_col(F.col("row_no"))
    by_path = Window.partitionBy("path_id").orderBy("row_no")
    held = rows.withColumn("before", F.lag("row_no").over(by_path)).withColumn("hash_before", F.lag("row_hash").over(by_path))
    link = R.linked_col(F.coalesce("before", F.col("row_no") - 1), F.col("row_no"))
    full = F.when(F.size("pointers") == 1, F.get("pointers", F.lit(0))).otherwise(merkle.root_col(F.col("pointers")))
    few = merkle.root_from_col(F.col("level_hash"), F.col("level"), count, F.col("funnel"))
    above = F.when(R.condensable_col(F.col("row_no")), F.when(F.col("level") == link, few)).otherwise(F.when(F.size("pointers") == count, full))
    said = F.coalesce("level_hash", F.get("pointers", link))
    linked = F.col("before").isNull() | (said == F.col("hash_before"))
    ok = (C.sha256(F.concat("input_hash", above)) == F.col("row_hash")) & (link >= 0) & linked
    return held.select("path_id", "row_no", F.coalesce(ok, F.lit(False)).alias("ok"))


def covering(row: Column, no: int) -> Column:
    """Whether a row is, or points to, row no."""
    return R.linked_col(F.lit(no).cast("long"), row) >= -1
