"""The skip chain: folding, extending, verifying, comparing, trimming.

A chain table has ledger_id, row_no, input_hash, row_hash. Row r's hash covers its input hash and the hashes of the rows that
it points to (r - 1, r - 2, r - 4 ...). SCHEMES: "v05" hashes them as they follow each other, "v06" their Merkle root.

Folding is sequential within a ledger by definition; it streams over rows sorted by number and holds one hash a level, so a
ledger of any length takes constant memory, and it starts from the last committed frontier. All else (checking a chain
against its source, verifying every hash of it, finding the first conflict) is joins and grouped minima over all rows at once.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chainlake.functions import cells as C
from chainlake.functions import merkle
from chainlake.functions import rownumbers as R
from chainlake.sources import work

SCHEMES = ("v05", "v06")
CHAIN = "ledger_id string, row_no long, input_hash binary, row_hash binary"


def levels_hash(hashes: list[bytes], scheme: str) -> bytes:
    if scheme not in SCHEMES:
        raise ValueError(f"no scheme {scheme!r}")
    return b"".join(hashes) if scheme == "v05" or len(hashes) == 1 else merkle.root(hashes)


class Frontier:
    """What the next row's hash takes of all earlier rows: per level, the hash of the last row that its power of two divides."""

    def __init__(self, row_no: int = 0, hashes: tuple[bytes, ...] = (), scheme: str = "v05"):
        self.row_no, self.hashes, self.scheme = row_no, list(hashes), scheme

    def append(self, input_hash: bytes) -> bytes:
        self.row_no += 1
        count = R.skip_count(self.row_no)
        while len(self.hashes) < count:
            self.hashes.append(C.SENTINEL)
        made = hashlib.sha256(input_hash + levels_hash(self.hashes[:count], self.scheme)).digest()
        self.hashes[:count] = [made] * count
        return made


def fold(inputs: DataFrame, scheme: str = "v05", frontiers: DataFrame | None = None) -> DataFrame:
    """The chain rows of inputs (ledger_id, row_no, input_hash), which continue each ledger's frontier without a gap.

    frontiers: ledger_id, row_no, hashes (array, by level); a ledger without one starts at row 1.
    """
    none = F.lit(None).cast("array<binary>")
    rows = inputs.select(F.col("ledger_id").cast("string").alias("ledger_id"), F.col("row_no").cast("long").alias("row_no"), "input_hash", none.alias("hashes"))
    if frontiers is not None:
        start = frontiers.join(inputs.select("ledger_id").distinct(), "ledger_id", "left_semi")
        rows = rows.unionByName(start.select(F.col("ledger_id").cast("string").alias("ledger_id"), "row_no", F.lit(None).cast("binary").alias("input_hash"), "hashes"))

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        ledger, frontier, sha = None, None, hashlib.sha256
        for batch in batches:
            kept, made = [], []
            for at, (of, no, data, hashes) in enumerate(zip(*(c.to_pylist() for c in batch.columns))):
                if frontier is None or of != ledger:
                    ledger, frontier = of, Frontier(scheme=scheme)
                if hashes is not None:
                    frontier = Frontier(no, hashes, scheme)
                    continue
                if no != frontier.row_no + 1:
                    raise ValueError(f"ledger {of!r}: row {no} follows row {frontier.row_no}")
                if no & 1 and frontier.hashes:  # half of all rows point to the one before only
                    frontier.row_no = no
                    frontier.hashes[0] = sha(data + frontier.hashes[0]).digest()
                    made.append(frontier.hashes[0])
                else:
                    made.append(frontier.append(data))
                kept.append(at)
            if made:
                columns = batch.columns[:3] if len(kept) == batch.num_rows else batch.take(pa.array(kept)).columns[:3]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(made, pa.binary())], ["ledger_id", "row_no", "input_hash", "row_hash"])

    # a frontier comes before the rows that follow it
    return rows.repartition("ledger_id").sortWithinPartitions("ledger_id", "row_no").mapInArrow(run, CHAIN)


def sizes(chain: DataFrame) -> DataFrame:
    return chain.groupBy("ledger_id").agg(F.max("row_no").alias("size"))


def frontiers_at(chain: DataFrame, at: DataFrame | None = None) -> DataFrame:
    """ledger_id, row_no, hashes of each ledger's frontier at its end, or at the rows of `at` (ledger_id, row_no)."""
    ends = at if at is not None else sizes(chain).withColumnRenamed("size", "row_no")
    wanted = ends.where("row_no > 0").select("ledger_id", "row_no", F.posexplode(R.frontier_col(F.col("row_no"))).alias("level", "of"))
    hashes = chain.select("ledger_id", F.col("row_no").alias("of"), "row_hash")
    found = wanted.join(hashes, ["ledger_id", "of"])
    return found.groupBy("ledger_id", "row_no").agg(F.array_sort(F.collect_list(F.struct("level", "row_hash"))).alias("hs")).select("ledger_id", "row_no", F.col("hs.row_hash").alias("hashes"))


def extend(chain: DataFrame, inputs: DataFrame, scheme: str = "v05", max_rows: int | None = None, ends: DataFrame | None = None) -> DataFrame:
    """The chain rows to append for the inputs beyond each ledger's end, at most max_rows a ledger. ends: ends_of() a committed
    chain, which then isn't read."""
    known = frontiers_at(chain) if ends is None else ends
    size = known.select("ledger_id", F.col("row_no").alias("size"))
    new = inputs.join(size, "ledger_id", "left").withColumn("size", F.coalesce("size", F.lit(0))).where("row_no > size")
    if max_rows is not None:
        new = new.where(F.col("row_no") <= F.col("size") + max_rows)
    return fold(new.select("ledger_id", "row_no", "input_hash"), scheme, known.select("ledger_id", "row_no", "hashes"))


def pointers(rows: DataFrame) -> DataFrame:
    """ledger_id, row_no, level, points_to of every pointer."""
    return rows.select("ledger_id", "row_no", F.posexplode(R.pointers_col(F.col("row_no"))).alias("level", "points_to"))


def with_pointers(chain: DataFrame) -> DataFrame:
    """The chain's rows with their pointers' hashes by level (array); null where a row pointed to is missing."""
    targets = chain.select("ledger_id", F.col("row_no").alias("points_to"), F.col("row_hash").alias("pointer"))
    own = ["ledger_id", "row_no", "input_hash", "row_hash"]  # carried along, which spares a join back to the chain
    each = chain.select(*own, F.posexplode(R.pointers_col(F.col("row_no"))).alias("level", "points_to"))
    joined = each.join(targets, ["ledger_id", "points_to"], "left")
    value = F.when(F.col("points_to") == 0, F.lit(C.SENTINEL)).otherwise(F.col("pointer"))
    gathered = joined.groupBy(*own).agg(F.array_sort(F.collect_list(F.struct("level", value.alias("h")))).alias("hs"))
    whole = F.when(F.exists("hs", lambda x: x["h"].isNull()), F.lit(None)).otherwise(F.col("hs.h"))
    return gathered.select(*own, whole.alias("pointers"))


def verify(chain: DataFrame, scheme: str = "v05") -> DataFrame:
    """ledger_id, row_no, ok of every row: its hash follows from its input and its pointers. All rows at once, in expressions."""
    rows = with_pointers(chain)
    flat = F.unhex(F.array_join(F.transform("pointers", lambda h: F.hex(h)), ""))
    if scheme == "v06":
        flat = F.when(F.size("pointers") == 1, flat).otherwise(merkle.root_col(F.col("pointers")))
    elif scheme not in SCHEMES:
        raise ValueError(f"no scheme {scheme!r}")
    ok = F.coalesce(C.sha256(F.concat("input_hash", flat)) == F.col("row_hash"), F.lit(False))
    return rows.select("ledger_id", "row_no", ok.alias("ok"))


def conflicts(chain: DataFrame, inputs: DataFrame) -> DataFrame:
    """Committed rows whose source row's hash isn't the committed input hash."""
    source = inputs.select("ledger_id", "row_no", F.col("input_hash").alias("source_hash"))
    return chain.join(source, ["ledger_id", "row_no"]).where("source_hash <> input_hash").select("ledger_id", "row_no")


def first_conflict(chain: DataFrame, inputs: DataFrame) -> DataFrame:
    """ledger_id, row_no of each ledger's first conflicting row."""
    return conflicts(chain, inputs).groupBy("ledger_id").agg(F.min("row_no").alias("row_no"))


def drawn(rows: DataFrame, share: float, seed: str = "sample") -> DataFrame:
    """ledger_id, row_no of a random share of each ledger's rows 1 to its size, drawn with replacement: draw j takes the row that the hash
    of seed, ledger and j names, so draws need no state and come out the same again."""
    ends = sizes(rows)
    draw = F.explode(F.sequence(F.lit(0), F.floor(F.lit(share)).cast("int")))
    draws = rows.select("ledger_id", "row_no", draw.alias("round")).join(ends, "ledger_id").withColumn("j", F.col("row_no") + F.col("round") * F.col("size"))
    draws = draws.where(F.col("j") <= F.ceil(F.col("size") * F.lit(share)))
    hashed = F.sha2(F.concat_ws(":", F.lit(seed), "ledger_id", F.col("j").cast("string")).cast("binary"), 256)
    number = F.conv(F.substring(hashed, 1, 15), 16, 10).cast("long") % F.col("size") + 1
    return draws.select("ledger_id", number.alias("row_no")).distinct()


def sample_conflicts(chain: DataFrame, inputs: DataFrame, share: float, seed: str = "sample") -> DataFrame:
    """conflicts() among a random share of the rows, drawn with replacement; all of them from a share of 2 on."""
    return conflicts(chain if share >= 2 else chain.join(drawn(chain, share, seed), ["ledger_id", "row_no"], "left_semi"), inputs)


def sync_status(chain: DataFrame, inputs: DataFrame, max_lookback: int | None = None) -> DataFrame:
    """Per ledger: committed, available, state, fork_row (its first conflict, exact unless max_lookback bounds the search), valid_rows.

    COMPLETE: as many rows committed as there are. PENDING: more to commit. TRIMMED: fewer there than committed. FORKED: a
    committed row conflicts with its source.
    """
    found = conflicts(chain, inputs)
    ends = sizes(chain).withColumnRenamed("size", "committed").join(sizes(inputs).withColumnRenamed("size", "available"), "ledger_id", "full")
    ends = ends.select("ledger_id", *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("committed", "available")))
    if max_lookback is not None:
        found = found.join(ends, "ledger_id").where(F.col("row_no") > F.least("committed", "available") - max_lookback).select("ledger_id", "row_no")
    forks = found.groupBy("ledger_id").agg(F.min("row_no").alias("fork_row"))
    state = F.when(F.col("fork_row").isNotNull(), "FORKED").when(F.col("committed") > F.col("available"), "TRIMMED").when(F.col("committed") < F.col("available"), "PENDING").otherwise("COMPLETE")
    valid = F.when(F.col("fork_row").isNotNull(), F.col("fork_row") - 1).otherwise(F.least("committed", "available"))
    return ends.join(forks, "ledger_id", "left").select("ledger_id", "committed", "available", state.alias("state"), "fork_row", valid.alias("valid_rows"))


def trim(chain: DataFrame, to: DataFrame) -> DataFrame:
    """The chain without rows beyond `to` (ledger_id, size); ledgers that `to` doesn't name stay whole."""
    joined = chain.join(to.select("ledger_id", F.col("size").alias("_size")), "ledger_id", "left")
    return joined.where(F.col("_size").isNull() | (F.col("row_no") <= F.col("_size"))).drop("_size")


def check_append(chain: DataFrame, rows: DataFrame, known_sizes: DataFrame | None = None) -> DataFrame:
    """The rows to add. Rows that are there must be equal, and new ones must follow without a gap; else an error names how many don't."""
    old = chain.select("ledger_id", "row_no", F.col("input_hash").alias("_i"), F.col("row_hash").alias("_r"))
    known = rows.join(old, ["ledger_id", "row_no"])
    wrong = known.where("not (_i = input_hash and _r = row_hash)").count()
    if wrong:
        raise ValueError(f"{wrong} rows conflict with committed ones")
    new = rows.join(old, ["ledger_id", "row_no"], "left_anti")
    runs = new.groupBy("ledger_id").agg(F.min("row_no").alias("a"), F.max("row_no").alias("b"), F.countDistinct("row_no").alias("n"))
    gaps = runs.join(sizes(chain) if known_sizes is None else known_sizes, "ledger_id", "left").where("a <> coalesce(size, 0) + 1 or b - a + 1 <> n").count()
    if gaps:
        raise ValueError(f"rows of {gaps} ledgers leave a gap")
    return new


ENDS = "ledger_id string, row_no long, hashes array<binary>"


def committed(spark, path: str, low: int | None = None, high: int | None = None) -> DataFrame:
    """The chain table at path (none: empty), its rows from low to high; the bounds prune files and row groups."""
    if not work.exists(spark, path):
        return spark.createDataFrame([], CHAIN)
    chain = spark.read.schema(CHAIN).parquet(path)
    return chain if low is None else chain.where(F.col("row_no").between(low, high))


def ends_of(spark, path: str) -> DataFrame:
    """ledger_id, row_no, hashes: the frontier at each ledger's end of the chain table at path, from the small table that append()
    keeps beside it. If that lags behind (a writer was lost between the two), or isn't there, it is made from the chain."""
    chain = committed(spark, path)
    if work.exists(spark, f"{path}.ends"):
        ends = spark.read.schema(ENDS).parquet(f"{path}.ends")
        low = ends.agg(F.min("row_no")).first()[0] or 0
        size = ends.select("ledger_id", F.col("row_no").alias("size"))
        beyond = chain.where(F.col("row_no") > low).join(size, "ledger_id", "left").where("row_no > coalesce(size, 0)")
        if not beyond.limit(1).count() and (low > 1 or not chain.where("row_no = 1").join(size, "ledger_id", "left_anti").limit(1).count()):
            return ends
    return frontiers_at(chain)


def _new_ends(ends: DataFrame, new: DataFrame) -> DataFrame:
    """ends after new rows: levels whose row is new take its hash, the others keep what they had."""
    grown = sizes(new).withColumnRenamed("size", "row_no")
    wanted = grown.select("ledger_id", "row_no", F.posexplode(R.frontier_col(F.col("row_no"))).alias("level", "of"))
    hashes = new.select("ledger_id", F.col("row_no").alias("of"), "row_hash")
    before = ends.select("ledger_id", F.col("hashes").alias("had"))
    found = wanted.join(hashes, ["ledger_id", "of"], "left").join(before, "ledger_id", "left")
    value = F.coalesce("row_hash", F.get("had", F.col("level")))
    made = found.groupBy("ledger_id", "row_no").agg(F.array_sort(F.collect_list(F.struct("level", value.alias("h")))).alias("hs"))
    return made.select("ledger_id", "row_no", F.col("hs.h").alias("hashes")).unionByName(ends.join(grown.select("ledger_id"), "ledger_id", "left_anti"))


def append(path: str, rows: DataFrame) -> int:
    """Add rows to the chain table at path (made if absent); committing the same rows again adds nothing. Returns their number.

    Only the committed rows in the range of the new ones are read; ledgers' ends come from the table beside the chain.
    """
    spark = rows.sparkSession
    rows = work.written(rows.select("ledger_id", "row_no", "input_hash", "row_hash"), "to-commit")
    span = rows.agg(F.min("row_no").alias("low"), F.max("row_no").alias("high")).first()
    if span["low"] is None:
        return 0
    ends = work.written(ends_of(spark, path), "ends")
    chain = committed(spark, path, span["low"], span["high"])
    before = chain.count()
    new = work.written(check_append(chain, rows, ends.select("ledger_id", F.col("row_no").alias("size"))), "new-rows")
    n = new.count()
    if not n:
        return 0
    new.write.mode("append").parquet(path)
    after = committed(spark, path, span["low"], span["high"]).count()
    if after != before + n:
        raise RuntimeError(f"{path} was changed from outside: {after} rows from {span['low']} to {span['high']}, not {before + n}; trim it with rollback()")
    table = f"{path}.{spark.sparkContext.applicationId}.ends"
    _new_ends(ends, new).write.mode("overwrite").parquet(table)
    work.swap(spark, table, f"{path}.ends")
    return n


def rollback(path: str, to: DataFrame) -> None:
    """Trim the chain table at path, whole or not at all."""
    spark = to.sparkSession
    kept = trim(spark.read.schema(CHAIN).parquet(path), to)
    new = f"{path}.{spark.sparkContext.applicationId}.new"
    kept.write.mode("overwrite").parquet(new)
    work.swap(spark, new, path)
    work.remove(spark, f"{path}.ends")


def checkpoints(chain: DataFrame, exponent: int) -> DataFrame:
    """The frontiers at every row that 2 ** exponent divides: the block index from which later folds can start."""
    return frontiers_at(chain, chain.where(F.col("row_no") % (1 << exponent) == 0).select("ledger_id", "row_no"))


def check_checkpoints(saved: DataFrame, chain: DataFrame) -> DataFrame:
    """ledger_id, row_no, ok: whether each saved frontier is the chain's own."""
    own = frontiers_at(chain, saved.select("ledger_id", "row_no")).withColumnRenamed("hashes", "own")
    return saved.join(own, ["ledger_id", "row_no"], "left").select("ledger_id", "row_no", F.coalesce(F.col("own") == F.col("hashes"), F.lit(False)).alias("ok"))


def save_checkpoints(path: str, new: DataFrame, force: bool = False) -> int:
    """Add checkpoints (ledger_id, row_no, hashes) to the table at path; the number of those that weren't there. One that is there with
    other hashes is an error, or with force is replaced."""
    spark = new.sparkSession
    new = work.written(new.select("ledger_id", "row_no", "hashes"), "checkpoints")
    old = spark.read.schema(ENDS).parquet(path) if work.exists(spark, path) else spark.createDataFrame([], ENDS)
    had = old.select("ledger_id", "row_no", F.col("hashes").alias("had"))
    both = new.join(had, ["ledger_id", "row_no"], "left")
    wrong = both.where("had is not null and had <> hashes").count()
    if wrong and not force:
        raise ValueError(f"{wrong} checkpoints conflict with saved ones")
    added = both.where("had is null").count()
    if added or wrong:
        kept = old.join(new.select("ledger_id", "row_no"), ["ledger_id", "row_no"], "left_anti").unionByName(new)
        table = f"{path}.{spark.sparkContext.applicationId}.new"
        kept.write.mode("overwrite").parquet(table)
        work.swap(spark, table, path)
    return added
