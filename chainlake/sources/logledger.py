"""Logs that grow, as ledgers: parse, checkpoint, resume, replay with observers, seal.

A parsed log has ledger_id (the file), row_no, line_no, offset, end_offset, line and input_hash. A checkpoint remembers of a log's last committed
row where its line begins and ends, its input hash, and the chain's frontier, so that a later run reads only what follows. A
seal states how many rows a log has, under which grammar, and its last row's hash.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chainlake.operators import chain as H
from chainlake.sources import logs as L

CHECKPOINT = "ledger_id string, row_no long, line_no long, offset long, end_offset long, input_hash binary, hashes array<binary>"


def parsed(spark: SparkSession, path: str, grammar: L.Grammar = L.Grammar(), seed: bytes | None = None) -> DataFrame:
    """The rows of the logs at path, with their places and input hashes."""
    return _hashed(L.read_lines(spark, path, grammar).where("row_no is not null"), grammar, seed)


def _hashed(rows: DataFrame, grammar: L.Grammar, seed: bytes | None) -> DataFrame:
    places = rows.select("ledger_id", "row_no", "line_no", "offset", (F.col("offset") + F.col("size")).alias("end_offset"), "line")
    return L.with_input_hash(places, grammar, seed)


def checkpoint(rows: DataFrame, chain: DataFrame) -> DataFrame:
    """The checkpoint of each log at the end of its chain."""
    ends = H.frontiers_at(chain)
    last = rows.select("ledger_id", "row_no", "line_no", "offset", "end_offset", "input_hash")
    return ends.join(last, ["ledger_id", "row_no"]).select("ledger_id", "row_no", "line_no", "offset", "end_offset", "input_hash", "hashes")


def resumed(spark: SparkSession, path: str, saved: DataFrame, grammar: L.Grammar = L.Grammar(), seed: bytes | None = None) -> DataFrame:
    """The rows after each log's checkpoint, numbered on from it. The checkpoint's own row is read and hashed again first: an error if it
    isn't what was committed, or if the log has become shorter. A log without a checkpoint gives all its rows."""
    known = F.broadcast(saved.select(F.col("ledger_id").alias("_of"), F.col("row_no").alias("_row"), F.col("offset").alias("_offset"), F.col("end_offset").alias("_end"), F.col("input_hash").alias("_hash")))  # one row a log
    lines = L.read_lines(spark, path).join(known, F.col("ledger_id") == F.col("_of"), "left")
    # what lies before the checkpoint is neither tokenised nor hashed
    tail = lines.where(F.col("_offset").isNull() | (F.col("offset") >= F.col("_offset"))).where(L.is_row(F.col("line"), grammar))
    own = ["ledger_id", "_row", "_offset", "_end", "_hash"]
    numbered = L.rows(tail, grammar, ("ledger_id",)).withColumn("row_no", F.coalesce(F.col("_row") - 1, F.lit(0)) + F.col("row_no"))
    again = L.with_input_hash(numbered.select(*own, "row_no", "line_no", "offset", (F.col("offset") + F.col("size")).alias("end_offset"), "line"), grammar, seed)
    first = again.where("row_no = _row").select(F.col("ledger_id").alias("_log"), ((F.col("offset") == F.col("_offset")) & (F.col("end_offset") == F.col("_end")) & (F.col("input_hash") == F.col("_hash"))).alias("same"))
    wrong = known.join(first, F.col("_of") == F.col("_log"), "left").where("not coalesce(same, false)").limit(1).collect()
    if wrong:
        raise ValueError(f"log {wrong[0]['_of']!r} isn't what it was at row {wrong[0]['_row']}")
    return again.where("_row is null or row_no > _row").select("ledger_id", "row_no", "line_no", "offset", "end_offset", "line", "input_hash")


def extended(new: DataFrame, saved: DataFrame, scheme: str = "v05") -> DataFrame:
    """The chain rows of resumed() rows, from the checkpoints' frontiers."""
    return H.fold(new.select("ledger_id", "row_no", "input_hash"), scheme, saved.select("ledger_id", "row_no", "hashes"))


def replay(rows: DataFrame, observers: dict[str, Column], max_rows: int | None = None) -> DataFrame:
    """ledger_id and what each observer (an aggregate over the rows' columns) saw, in one pass over the rows, up to max_rows."""
    seen = rows if max_rows is None else rows.where(F.col("row_no") <= max_rows)
    return seen.groupBy("ledger_id").agg(*(c.alias(name) for name, c in observers.items()))


def rules_of(grammar: L.Grammar, scheme: str) -> str:
    return json.dumps({"comment": grammar.comment, "skip_blank": grammar.skip_blank, "delimiters": grammar.delimiters, "comment_pattern": grammar.comment_pattern, "scheme": scheme}, sort_keys=True)


def seal(chain: DataFrame, grammar: L.Grammar = L.Grammar(), scheme: str = "v05") -> DataFrame:
    """ledger_id, row_no, row_hash, rules: one row a log."""
    ends = H.sizes(chain).withColumnRenamed("size", "row_no")
    return chain.join(ends, ["ledger_id", "row_no"]).select("ledger_id", "row_no", "row_hash", F.lit(rules_of(grammar, scheme)).alias("rules"))


def check_seal(spark: SparkSession, path: str, seals: DataFrame, seed: bytes | None = None) -> DataFrame:
    """ledger_id, ok, more: whether the log, parsed and folded again by the seal's rules, has the sealed hash at the sealed row, and how many
    rows it has grown by since. All seals have the same rules."""
    rules = [json.loads(r["rules"]) for r in seals.select("rules").distinct().limit(2).collect()]
    if len(rules) != 1:
        raise ValueError("check seals of one set of rules at a time")
    grammar = L.Grammar(*(rules[0][k] for k in ("comment", "skip_blank", "delimiters", "comment_pattern")))
    rows = parsed(spark, path, grammar, seed)
    chain = H.fold(rows.select("ledger_id", "row_no", "input_hash"), rules[0]["scheme"])
    known = seals.select("ledger_id", F.col("row_no").alias("sealed"), F.col("row_hash").alias("sealed_hash"))
    joined = known.join(chain, "ledger_id", "left")
    same = F.max(((F.col("row_no") == F.col("sealed")) & (F.col("row_hash") == F.col("sealed_hash"))).cast("int")) == 1
    return joined.groupBy("ledger_id").agg(F.coalesce(same, F.lit(False)).alias("ok"), (F.coalesce(F.max("row_no"), F.lit(0)) - F.max("sealed")).alias("more"))
