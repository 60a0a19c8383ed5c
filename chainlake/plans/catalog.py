"""The registered queries of the ledger engine and their SQL.

Each runs over whole tables of the driver's data; measures of type double are cast to decimals before they become cells.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chainlake.functions import cells as C
from chainlake.functions import cells05 as OLD
from chainlake.functions import rownumbers as R
from chainlake.operators import chain as H
from chainlake.operators import joins as J
from chainlake.operators import paths as P
from chainlake.operators import query as Q
from chainlake.operators import rows as O
from chainlake.plans import morsel as M
from chainlake.plans.ledger import Ledger
from chainlake.plans.registry import Registry, Rights
from chainlake.sources import codecs as K
from chainlake.sources import logs as L
from chainlake.sources import sql as S

QUERIES: dict[str, Callable] = {}
SQL: dict[str, str] = {}
SEED = bytes(range(32))
SEED2 = bytes(range(32, 64))


def query(name: str, sql: str | None = None):
    def add(f: Callable) -> Callable:
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return add


def queries() -> dict[str, Callable]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)


def load(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def low_hex(column) -> F.Column:
    return F.lower(F.hex(column))


# SQL text that the oracles share. Blobs are joined by ||, as DuckDB's concat goes through text.
S_LONG = lambda x: f"unhex(printf('%016x', {x}))"
S_NULL = "unhex('000000000000')"
S_SENTINEL = "unhex(repeat('00', 32))"


def s_cell(code: int, data: str, value: str, salt: str = "") -> str:
    return f"CASE WHEN {value} IS NULL THEN unhex(sha256({salt}{S_NULL})) ELSE unhex(sha256({salt}unhex('{code:02x}') || {data})) END"


def s_string(x: str, salt: str = "") -> str:
    return s_cell(1, f"encode({x})", x, salt)


def s_long(x: str, salt: str = "") -> str:
    return s_cell(2, S_LONG(f"({x})::BIGINT"), x, salt)


def s_date(x: str, salt: str = "") -> str:
    return s_cell(5, S_LONG(f"(epoch_us({x}) // 1000)"), x, salt)


def s_decimal_parts(x: str, scale: int) -> dict[str, str]:
    u = f"(({x})::DECIMAL(38,{scale}) * {10**scale})::BIGINT"
    z = f"CASE WHEN {u} = 0 THEN 0 ELSE length(abs({u})::VARCHAR) - length(rtrim(abs({u})::VARCHAR, '0')) END"
    w = f"CASE WHEN {u} = 0 THEN 0 ELSE ({u} // (10::HUGEINT ** ({z}))::BIGINT) END"
    return {"u": u, "z": z, "w": w}


def s_decimal(x: str, scale: int = 4, salt: str = "") -> str:
    p = s_decimal_parts(x, scale)
    s = f"CASE WHEN {p['u']} = 0 THEN 0 ELSE {scale} - ({p['z']}) END"
    h = f"upper(printf('%016x', {p['w']}))"
    pos = f"ltrim({h}, '0')"
    even = f"CASE WHEN length({pos}) % 2 = 1 OR {pos} = '' THEN '0' || {pos} ELSE {pos} END"
    even = f"CASE WHEN {pos} = '' THEN '00' ELSE {even} END"
    body = f"CASE WHEN {p['w']} < 0 THEN regexp_replace({h}, '^(FF)+([89A-F])', '\\2') WHEN regexp_matches({even}, '^[89A-F]') THEN '00' || {even} ELSE {even} END"
    return s_cell(4, f"unhex(right(printf('%016x', ({s})::BIGINT), 2) || {body})", x, salt)


ORDER_COLUMNS = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"]
S_ORDER_ROW = "unhex(sha256(" + " || ".join([s_long("o_orderkey"), s_long("o_custkey"), s_string("o_orderstatus"), s_decimal("o_totalprice"), s_date("o_orderdate"), s_string("o_orderpriority")]) + "))"
S_ORDERS = "SELECT *, row_number() OVER (ORDER BY o_orderkey) AS row_no FROM orders"


def orders_ledger(spark: SparkSession, sf: str) -> DataFrame:
    orders = O.number_by_key(O.spread(load(spark, sf, "orders")), "o_orderkey")
    return orders.withColumn("o_totalprice", F.col("o_totalprice").cast("decimal(18,4)"))


# Rows ----------------------------------------------------------------------------------------------------------------


@query("row_numbering_orders", "SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate, o_orderkey) AS row_no FROM orders")
def row_numbering_orders(spark, sf):
    return O.number_rows(load(spark, sf, "orders").select("o_orderkey", "o_orderdate"), ["o_orderdate", "o_orderkey"]).select("o_orderkey", "row_no")


@query("row_input_hash_orders", f"SELECT row_no, lower(hex({S_ORDER_ROW})) AS input_hash FROM ({S_ORDERS})")
def row_input_hash_orders(spark, sf):
    return O.with_input_hash(orders_ledger(spark, sf), ORDER_COLUMNS).select("row_no", low_hex("input_hash").alias("input_hash"))


CELLS = [("p_partkey", s_long), ("p_name", s_string), ("p_brand", s_string), ("p_type", s_string), ("p_size", s_long), ("p_retailprice", s_decimal)]


@query("cell_hash_unsalted", " UNION ALL ".join(f"SELECT p_partkey AS row_no, {i} AS idx, lower(hex({f(c)})) AS hash FROM part" for i, (c, f) in enumerate(CELLS)))
def cell_hash_unsalted(spark, sf):
    part = load(spark, sf, "part").withColumn("p_retailprice", F.col("p_retailprice").cast("decimal(18,4)"))
    return O.long_cells(part, [c for c, _ in CELLS], row="p_partkey").select("row_no", "idx", low_hex("hash").alias("hash"))


def s_row_salt(seed: str, row: str) -> str:
    return f"unhex(sha256({S_LONG(row)} || {seed} || {S_LONG(f'(-{row} - 1)')}))"


def s_cell_salt(i: int) -> str:
    return f"unhex(sha256(unhex('{i:016x}') || salt || unhex('{(1 << 64) - 1 - i:016x}'))) || "


S_SEEDS = f"CASE WHEN o_orderkey + 1 >= 500 THEN unhex('{SEED2.hex()}') ELSE unhex('{SEED.hex()}') END"
S_SALTED = f"SELECT *, o_orderkey + 1 AS row_no, {s_row_salt(S_SEEDS, '(o_orderkey + 1)')} AS salt FROM orders"


@query(
    "row_salted_epochs_orders",
    f"""SELECT row_no, lower(hex(salt)) AS row_salt, lower(hex(unhex(sha256({s_long('o_orderkey')} || {s_long('o_custkey', s_cell_salt(1))}
        || {s_string('o_orderstatus', s_cell_salt(2))} || {s_decimal('o_totalprice', 4, s_cell_salt(3))} || {s_date('o_orderdate', s_cell_salt(4))}
        || {s_string('o_orderpriority', s_cell_salt(5))})))) AS input_hash FROM ({S_SALTED})""",
)
def row_salted_epochs_orders(spark, sf):
    seeded = J.with_epoch_seed(orders_ledger(spark, sf), [(1, SEED), (500, SEED2)])
    salted = O.with_row_salt(seeded, F.col("seed"))
    hashed = O.with_input_hash(salted, ORDER_COLUMNS, scheme=C.SaltScheme((0,), False), salt="row_salt")
    return hashed.select("row_no", low_hex("row_salt").alias("row_salt"), low_hex("input_hash").alias("input_hash"))


@query("row_hash_redacted", f"SELECT row_no, lower(hex({S_ORDER_ROW})) AS input_hash, true AS hidden FROM ({S_ORDERS})")
def row_hash_redacted(spark, sf):
    cells = O.long_cells(orders_ledger(spark, sf), ORDER_COLUMNS)
    hidden = O.redact(O.redact(cells, F.col("idx").isin(1, 3)), F.col("idx") == 3)
    has = O.rows_with_redactions(hidden).withColumn("hidden", F.lit(True))
    return O.hash_of_cells(hidden).join(has, "row_no", "left").select("row_no", low_hex("input_hash").alias("input_hash"), "hidden")


@query("ledger_size_orders", "SELECT count(*)::BIGINT AS n_rows, coalesce(max(o_orderkey + 1), 0)::BIGINT AS size FROM orders")
def ledger_size_orders(spark, sf):
    return O.ledger_size(orders_ledger(spark, sf))


@query(
    "rows_with_gaps",
    f"""SELECT i AS row_no, lower(hex(coalesce({s_long('c_custkey')}, {S_SENTINEL}))) AS input_hash
        FROM (SELECT unnest(range(1, (SELECT max(c_custkey) FROM customer) + 1)) AS i) LEFT JOIN (SELECT c_custkey, 1 AS there FROM customer WHERE c_acctbal > 0) ON c_custkey = i
        """.replace(f"coalesce({s_long('c_custkey')}, {S_SENTINEL})", f"CASE WHEN there IS NULL THEN {S_SENTINEL} ELSE {s_long('c_custkey')} END"),
)
def rows_with_gaps(spark, sf):
    customers = load(spark, sf, "customer")
    size = customers.agg(F.max("c_custkey")).first()[0] or 0
    hashed = O.with_input_hash(customers.where("c_acctbal > 0"), ["c_custkey"]).select(F.col("c_custkey").alias("row_no"), "input_hash")
    return O.with_gaps(hashed, size).select("row_no", low_hex("input_hash").alias("input_hash"))


@query("row_selection", f"SELECT row_no, o_custkey FROM ({S_ORDERS}) WHERE row_no IN (3, 7, 261) OR row_no BETWEEN 20 AND 40 OR row_no BETWEEN 900 AND 905")
def row_selection(spark, sf):
    rows, ranges = O.parse_selection("3, 7 20-40 261, 900-905")
    return O.pick(orders_ledger(spark, sf), rows=rows, ranges=ranges).select("row_no", "o_custkey")


@query("snapshot_membership", "SELECT o_orderkey + 1 AS row_no FROM orders WHERE o_orderkey + 1 <= 1000 AND o_orderkey + 1 IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 40)")
def snapshot_membership(spark, sf):
    among = load(spark, sf, "lineitem").where("l_quantity > 40").select(F.col("l_orderkey").alias("row_no"))
    return J.containing(O.snapshot(orders_ledger(spark, sf), 1000).select("row_no"), among)


@query("snapshot_missing", "SELECT o_orderkey + 1 AS row_no FROM orders WHERE o_orderkey + 1 NOT IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 40)")
def snapshot_missing(spark, sf):
    among = load(spark, sf, "lineitem").where("l_quantity > 40").select(F.col("l_orderkey").alias("row_no"))
    return J.missing(orders_ledger(spark, sf).select("row_no"), among)


@query("oversize_to_hash", "SELECT doc_id, CASE WHEN octet_length(encode(text)) > 4096 THEN sha256(text) ELSE NULL END AS hash, CASE WHEN octet_length(encode(text)) > 4096 THEN NULL ELSE text END AS text FROM documents")
def oversize_to_hash(spark, sf):
    out = O.oversize_to_hash(load(spark, sf, "documents").select("doc_id", "text")).withColumnRenamed("text", "held")
    docs = load(spark, sf, "documents").select("doc_id", F.octet_length("text").alias("n"))
    big = F.col("n") > 4096
    return out.join(docs, "doc_id").select("doc_id", F.when(big, low_hex("held")).alias("hash"), F.when(~big, F.decode("held", "UTF-8")).alias("text"))


@query("prefix_find_limit", f"SELECT row_no, lower(hex({S_ORDER_ROW})) AS input_hash FROM ({S_ORDERS}) WHERE lower(hex({S_ORDER_ROW})) LIKE 'a%' AND row_no >= 10 ORDER BY row_no LIMIT 8")
def prefix_find_limit(spark, sf):
    hashed = O.with_input_hash(orders_ledger(spark, sf), ORDER_COLUMNS)
    return O.prefix_find(hashed.select("row_no", "input_hash"), "A", start=10).select("row_no", low_hex("input_hash").alias("input_hash"))


CUSTOMER = ["c_custkey", "c_name", "c_nationkey"]


@query("rows_as_json", "SELECT c_custkey AS row_no, '{\"row\":' || c_custkey || ',\"cells\":[{\"type\":\"LONG\",\"value\":\"' || c_custkey || '\"},{\"hash\":\"' || lower(hex(" + s_string("c_name") + ")) || '\"},{\"type\":\"LONG\",\"value\":\"' || c_nationkey || '\"}]}' AS json FROM customer")
def rows_as_json(spark, sf):
    return O.as_json(O.redact(O.long_cells(load(spark, sf, "customer"), CUSTOMER, row="c_custkey"), F.col("idx") == 1))


@query("rows_as_text", "SELECT c_custkey AS row_no, c_custkey || ', ' || c_name || ', [X]' AS line FROM customer")
def rows_as_text(spark, sf):
    return O.as_text(O.redact(O.long_cells(load(spark, sf, "customer"), CUSTOMER, row="c_custkey"), F.col("idx") == 2), ", ")


# Chains --------------------------------------------------------------------------------------------------------------

NATION = ["n_nationkey", "n_name", "n_regionkey"]
S_NATION_ROW = "unhex(sha256(" + " || ".join([s_long("n_nationkey"), s_string("n_name"), s_long("n_regionkey")]) + "))"


def s_merkle(hashes: str) -> str:
    """The root of a list of at most 64 hashes: leaves after byte 0, inner nodes after byte 1, odd ones go up as they are."""
    layer = f"list_transform({hashes}, lambda x: unhex(sha256(unhex('00') || x)))"
    for i in range(6):
        pair = f"CASE WHEN 2 * k{i} <= len(l{i}) THEN unhex(sha256(unhex('01') || l{i}[2 * k{i} - 1] || l{i}[2 * k{i}])) ELSE l{i}[2 * k{i} - 1] END"
        layer = f"list_transform([{layer}], lambda l{i}: list_transform(range(1, (len(l{i}) + 1) // 2 + 1), lambda k{i}: {pair}))[1]"
    return f"{layer}[1]"


def s_chain(inputs: str, scheme: str = "v05") -> str:
    """WITH clause whose `fold` has r, i, h of the chain over inputs (r, i), row by row; row 0 is the sentinel."""
    pointers = "fold.f[1:1 + bit_count((input.r & -input.r) - 1)]"
    flat = f"list_reduce({pointers}, lambda a, b: a || b)"
    if scheme == "v06":
        flat = f"CASE WHEN input.r % 2 = 1 THEN fold.f[1] ELSE {s_merkle(pointers)} END"
    return f"""
WITH RECURSIVE input AS MATERIALIZED ({inputs}),
fold AS (
  SELECT 0::BIGINT AS r, list_transform(range(40), lambda k: {S_SENTINEL}) AS f, ''::BLOB AS i, {S_SENTINEL} AS h
  UNION ALL
  SELECT n.r, list_transform(range(40), lambda k: CASE WHEN n.r % (1::BIGINT << k) = 0 THEN n.h ELSE n.f[k + 1] END), n.i, n.h
  FROM (SELECT input.r, fold.f, input.i, unhex(sha256(input.i || {flat})) AS h FROM fold JOIN input ON input.r = fold.r + 1) n)
"""


S_INPUT = f"SELECT row_no AS r, {S_ORDER_ROW} AS i FROM ({S_ORDERS})"
S_CHAIN = s_chain(S_INPUT)
S_ROWS = "SELECT r AS row_no, lower(hex(i)) AS input_hash, lower(hex(h)) AS row_hash FROM fold WHERE r > 0"


def nation_inputs(spark, sf):
    nation = O.number_by_key(load(spark, sf, "nation"), "n_nationkey")
    return O.with_input_hash(nation, NATION).select(F.lit("nation").alias("ledger_id"), "row_no", "input_hash")


def order_inputs(spark, sf):
    return O.with_input_hash(orders_ledger(spark, sf), ORDER_COLUMNS).select(F.lit("orders").alias("ledger_id"), "row_no", "input_hash")


def order_chain(spark, sf, scheme="v05"):
    return H.work.written(H.fold(order_inputs(spark, sf), scheme), "orders-chain")


def hex_rows(chain):
    return chain.select("row_no", low_hex("input_hash").alias("input_hash"), low_hex("row_hash").alias("row_hash"))


@query("chain_fold_nation", f"{s_chain(f'SELECT row_number() OVER (ORDER BY n_nationkey) AS r, {S_NATION_ROW} AS i FROM nation')} {S_ROWS}")
def chain_fold_nation(spark, sf):
    return hex_rows(H.fold(nation_inputs(spark, sf)))


@query("chain_fold_orders", f"{S_CHAIN} {S_ROWS}")
def chain_fold_orders(spark, sf):
    return hex_rows(H.fold(order_inputs(spark, sf)))


@query("chain_fold_orders_v06", f"{s_chain(S_INPUT, 'v06')} {S_ROWS}")
def chain_fold_orders_v06(spark, sf):
    return hex_rows(H.fold(order_inputs(spark, sf), "v06"))


@query("chain_extend_orders", f"{S_CHAIN} {S_ROWS} AND r BETWEEN 1001 AND 1300")
def chain_extend_orders(spark, sf):
    """The 300 rows after the first 1000, from their frontier."""
    inputs = order_inputs(spark, sf)
    first = H.work.written(H.fold(inputs.where("row_no <= 1000")), "orders-1000")
    return hex_rows(H.extend(first, inputs, max_rows=300))


# Forged and missing rows: those that have a wrong hash, or point to a row that has or is gone, fail.
S_FORGED, S_GONE = "r % 500 = 17", "r % 700 = 300"
S_EACH = f"(SELECT row_no AS r FROM ({S_ORDERS}))"
S_POINTED = f"(SELECT r, r - (1::BIGINT << k) AS t FROM (SELECT r, unnest(range(bit_count((r & -r) - 1) + 1)) AS k FROM {S_EACH}))"


def s_wrong(of: str) -> str:
    return of.replace("r %", "t %")


@query("chain_verify_orders", f"SELECT r AS row_no, NOT ({S_FORGED}) AND NOT bool_or(t > 0 AND (({s_wrong(S_FORGED)}) OR ({s_wrong(S_GONE)}))) AS ok FROM {S_POINTED} WHERE NOT ({S_GONE}) GROUP BY r")
def chain_verify_orders(spark, sf):
    """Row hashes of some rows are forged, other rows are missing."""
    chain = order_chain(spark, sf).where("not row_no % 700 = 300")
    forged = F.when(F.expr("row_no % 500 = 17"), C.sha256("row_hash")).otherwise(F.col("row_hash"))
    return H.verify(chain.withColumn("row_hash", forged)).select("row_no", "ok")


@query("chain_verify_orders_v06", f"SELECT r AS row_no, NOT ({S_FORGED}) AND NOT bool_or(t > 0 AND ({s_wrong(S_GONE)})) AS ok FROM {S_POINTED} WHERE NOT ({S_GONE}) GROUP BY r")
def chain_verify_orders_v06(spark, sf):
    """Input hashes of some rows are forged, which their own hash shows; other rows are missing."""
    chain = order_chain(spark, sf, "v06").where("not row_no % 700 = 300")
    forged = F.when(F.expr("row_no % 500 = 17"), C.sha256("input_hash")).otherwise(F.col("input_hash"))
    return H.verify(chain.withColumn("input_hash", forged), "v06").select("row_no", "ok")


@query("chains_of_conversations", "SELECT conv_id::VARCHAR AS ledger_id, (count(*) - CASE WHEN conv_id % 4 = 0 THEN 1 ELSE 0 END)::BIGINT AS n, conv_id % 4 <> 0 AS ok FROM conversations GROUP BY conv_id HAVING conv_id % 4 <> 0 OR count(*) > 1")
def chains_of_conversations(spark, sf):
    """Some conversations lack their first row, which the second points to."""
    rows = load(spark, sf, "conversations").withColumn("row_no", F.row_number().over(Window.partitionBy("conv_id").orderBy("turn")).cast("long"))
    inputs = O.with_input_hash(rows, ["role", "text"]).select(F.col("conv_id").cast("string").alias("ledger_id"), "row_no", "input_hash")
    chain = H.work.written(H.fold(inputs), "conversations-chain")
    return H.verify(chain.where("not (ledger_id % 4 = 0 and row_no = 1)")).groupBy("ledger_id").agg(F.count("*").alias("n"), F.min("ok").alias("ok"))


S_POINTERS = f"SELECT row_no, unnest(range(bit_count((row_no & -row_no) - 1) + 1)) AS level FROM ({S_ORDERS})"


@query("pointer_self_join", f"SELECT row_no, level::INTEGER AS level, (row_no - (1::BIGINT << level))::BIGINT AS points_to FROM ({S_POINTERS})")
def pointer_self_join(spark, sf):
    return H.pointers(orders_ledger(spark, sf).select(F.lit("orders").alias("ledger_id"), "row_no")).select("row_no", "level", "points_to")


S_CHANGED = "o_orderkey % 1000 = 777 AND o_orderkey > 500"


def changed_orders(spark, sf):
    orders = orders_ledger(spark, sf).withColumn("o_custkey", F.when(F.expr(S_CHANGED), F.col("o_custkey") + 1).otherwise(F.col("o_custkey")))
    return O.with_input_hash(orders, ORDER_COLUMNS).select(F.lit("orders").alias("ledger_id"), "row_no", "input_hash")


@query("source_commit_conflicts", f"SELECT o_orderkey + 1 AS row_no FROM orders WHERE {S_CHANGED}")
def source_commit_conflicts(spark, sf):
    return H.conflicts(order_inputs(spark, sf), changed_orders(spark, sf)).select("row_no")


@query("first_conflict", f"SELECT min(o_orderkey + 1)::BIGINT AS row_no FROM orders WHERE {S_CHANGED} HAVING count(*) > 0")
def first_conflict(spark, sf):
    return H.first_conflict(order_inputs(spark, sf), changed_orders(spark, sf)).select("row_no")


@query("rollback_to_valid", f"SELECT o_orderkey + 1 AS row_no FROM orders WHERE o_orderkey + 1 < (SELECT min(o_orderkey + 1) FROM orders WHERE {S_CHANGED})")
def rollback_to_valid(spark, sf):
    own = order_inputs(spark, sf)
    valid = H.sync_status(own, changed_orders(spark, sf)).where("state = 'FORKED'").select("ledger_id", F.col("valid_rows").alias("size"))
    return H.trim(own, valid).select("row_no")


# Paths ---------------------------------------------------------------------------------------------------------------


S_SUPPLIED = "SELECT DISTINCT l_suppkey AS k, l_orderkey + 1 AS row_no FROM lineitem"


@query("coverage_of_rows", f"SELECT k, row_no FROM ({S_SUPPLIED}) UNION SELECT k, row_no - (1::BIGINT << level) FROM (SELECT k, row_no, unnest(range(bit_count((row_no & -row_no) - 1) + 1)) AS level FROM ({S_SUPPLIED}))")
def coverage_of_rows(spark, sf):
    rows = load(spark, sf, "lineitem").select(F.col("l_suppkey").alias("k"), (F.col("l_orderkey") + 1).alias("row_no")).distinct()
    return P.covered_numbers(rows, ("k",))


@query("ref_only_rows", f"SELECT * FROM (SELECT k, row_no - (1::BIGINT << level) AS row_no FROM (SELECT k, row_no, unnest(range(bit_count((row_no & -row_no) - 1) + 1)) AS level FROM ({S_SUPPLIED}))) WHERE row_no > 0 EXCEPT SELECT k, row_no FROM ({S_SUPPLIED})")
def ref_only_rows(spark, sf):
    rows = load(spark, sf, "lineitem").select(F.col("l_suppkey").alias("k"), (F.col("l_orderkey") + 1).alias("row_no")).distinct()
    return P.reference_numbers(rows, ("k",))


@query(
    "stitched_rows",
    f"""WITH RECURSIVE t AS ({S_SUPPLIED}),
    q AS (SELECT k, coalesce(lag(row_no) OVER (PARTITION BY k ORDER BY row_no), row_no) AS low, row_no FROM t),
    p AS (SELECT k, low, row_no FROM q UNION ALL SELECT k, low, row_no - least(row_no & -row_no, 1::BIGINT << (length(ltrim(bin(row_no - low), '0')) - 1)) FROM p WHERE row_no > low)
    SELECT DISTINCT k, row_no FROM p""",
)
def stitched_rows(spark, sf):
    rows = load(spark, sf, "lineitem").select(F.col("l_suppkey").alias("k"), (F.col("l_orderkey") + 1).alias("row_no"))
    return P.stitched(rows, ("k",))


@query("link_levels", "SELECT low, high, CASE WHEN high = low THEN -1 WHEN high > low AND bit_count(high - low) = 1 AND (high - low) <= (high & -high) THEN bit_count((high - low) - 1) ELSE -2 END::INTEGER AS level FROM (SELECT DISTINCT l_partkey + 1 AS low, l_orderkey + 1 AS high FROM lineitem)")
def link_levels(spark, sf):
    pairs = load(spark, sf, "lineitem").select((F.col("l_partkey") + 1).alias("low"), (F.col("l_orderkey") + 1).alias("high")).distinct()
    return P.links(pairs)


# Joins ---------------------------------------------------------------------------------------------------------------


@query("foreign_ref_check", "SELECT c_custkey AS from_row, c_nationkey::BIGINT AS to_row, EXISTS (SELECT 1 FROM nation WHERE n_nationkey = c_nationkey) AS ok FROM customer")
def foreign_ref_check(spark, sf):
    customer, nation = load(spark, sf, "customer"), load(spark, sf, "nation")
    cells = O.long_cells(customer.withColumn("ledger_id", F.lit("customer")), ["c_name", "c_nationkey"], row="c_custkey", keys=("ledger_id",))
    cells = cells.unionByName(O.long_cells(nation.withColumn("ledger_id", F.lit("nation")).withColumn("key", F.col("n_nationkey").cast("long")), ["n_nationkey", "n_name"], row="key", keys=("ledger_id",)))
    refs = customer.select(F.lit("customer").alias("from_ledger"), F.col("c_custkey").alias("from_row"), F.lit(1).alias("from_col"), F.lit("nation").alias("to_ledger"), F.col("c_nationkey").cast("long").alias("to_row"), F.lit(0).alias("to_col"))
    return J.check_references(refs, cells).select("from_row", "to_row", "ok")


@query("foreign_row_and_hash_refs", "SELECT n_nationkey::BIGINT AS from_row, c::INTEGER AS to_col, (c = -1 OR n_nationkey % 2 = 0) AS ok FROM nation, (VALUES (-1), (-2)) v(c)")
def foreign_row_and_hash_refs(spark, sf):
    nation = load(spark, sf, "nation").withColumn("key", F.col("n_nationkey").cast("long"))
    commits = O.with_input_hash(nation, ["n_name"]).select(F.lit("a").alias("ledger_id"), F.col("key").alias("row_no"), F.col("input_hash").alias("row_hash"))
    cells = O.long_cells(nation.withColumn("ledger_id", F.lit("a")), ["n_name", "n_regionkey"], row="key", keys=("ledger_id",))
    copies = cells.withColumn("ledger_id", F.lit("b"))
    held = commits.select(F.lit("h").alias("ledger_id"), "row_no", F.lit(0).alias("idx"), F.when(F.col("row_no") % 2 == 0, F.col("row_hash")).otherwise(F.lit(b"x")).alias("data"))
    every = cells.unionByName(copies).select("ledger_id", "row_no", "idx", "data").unionByName(held)
    ref = lambda f, fc, tc: nation.select(F.lit(f).alias("from_ledger"), F.col("key").alias("from_row"), F.lit(fc).alias("from_col"), F.lit("a").alias("to_ledger"), F.col("key").alias("to_row"), F.lit(tc).alias("to_col"))
    return J.check_references(ref("b", -1, -1).unionByName(ref("h", 0, -2)), every, commits).select("from_row", "to_col", "ok")


@query("reduce_semi_join", "SELECT 'orders' AS ledger_id, o_orderkey AS row_no FROM orders UNION ALL SELECT 'customer', c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders)")
def reduce_semi_join(spark, sf):
    orders, customer = load(spark, sf, "orders"), load(spark, sf, "customer")
    rows = orders.select(F.lit("orders").alias("ledger_id"), F.col("o_orderkey").alias("row_no")).unionByName(customer.select(F.lit("customer").alias("ledger_id"), F.col("c_custkey").alias("row_no")))
    refs = orders.select(F.lit("orders").alias("from_ledger"), F.col("o_orderkey").alias("from_row"), F.lit("customer").alias("to_ledger"), F.col("o_custkey").alias("to_row"))
    return J.reduce_rows(rows, refs, ["orders"])


S_WITNESS = "SELECT event_id + 1 AS row_no, epoch_us(ts) // 1000 AS utc FROM events WHERE event_type = 'purchase'"


def witnesses(spark, sf):
    events = load(spark, sf, "events")
    return events.where("event_type = 'purchase'").select((F.col("event_id") + 1).alias("row_no"), C.utc_millis(F.col("ts"), events.schema["ts"].dataType).alias("utc"))


@query("nearest_witness_asof", f"SELECT e.event_id + 1 AS row_no, (SELECT min(row_no) FROM ({S_WITNESS}) w WHERE w.row_no >= e.event_id + 1) AS near_row_no FROM events e")
def nearest_witness_asof(spark, sf):
    targets = load(spark, sf, "events").select((F.col("event_id") + 1).alias("row_no"))
    return J.next_record(targets, witnesses(spark, sf)).select("row_no", "near_row_no")


@query("nearest_checkpoint_asof", "SELECT l_orderkey AS row_no, l_linenumber, (l_orderkey // 64) * 64 AS near_row_no FROM lineitem")
def nearest_checkpoint_asof(spark, sf):
    targets = load(spark, sf, "lineitem").select(F.col("l_orderkey").alias("row_no"), "l_linenumber")
    saved = load(spark, sf, "orders").where("o_orderkey % 64 = 0").select(F.col("o_orderkey").alias("row_no"))
    return J.previous_record(targets, saved)


@query("witness_thinning", f"SELECT row_no, utc FROM (SELECT *, lag(utc) OVER (ORDER BY row_no) AS b FROM ({S_WITNESS})) WHERE b IS NULL OR floor(utc / 10000000) <> floor(b / 10000000)")
def witness_thinning(spark, sf):
    return J.thin_witnesses(witnesses(spark, sf), 10_000_000)


@query("witness_rows", "SELECT o_orderkey + 1 AS row_no FROM orders WHERE (o_orderkey + 1) % 64 = 0 UNION SELECT max(o_orderkey + 1) FROM orders")
def witness_rows(spark, sf):
    return J.witness_rows(orders_ledger(spark, sf).select(F.lit("orders").alias("ledger_id"), "row_no"), 6).select("row_no")


@query("notary_monotone", "SELECT u AS ledger_id, c AS chain_id, row_no, utc FROM (SELECT *, min(utc) OVER (PARTITION BY u, c ORDER BY row_no DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS above FROM (SELECT user_id AS u, event_type AS c, event_id % 50 AS row_no, min(epoch_us(ts) // 1000) AS utc FROM events GROUP BY ALL)) WHERE above IS NULL OR utc < above")
def notary_monotone(spark, sf):
    events = load(spark, sf, "events")
    records = events.select(F.col("user_id").alias("ledger_id"), F.col("event_type").alias("chain_id"), (F.col("event_id") % 50).alias("row_no"), C.utc_millis(F.col("ts"), events.schema["ts"].dataType).alias("utc"))
    return J.notary_monotone(records)


@query("notary_check", "SELECT event_id AS row_no, event_type <> 'click' AS ok FROM events")
def notary_check(spark, sf):
    events = load(spark, sf, "events")
    utc = C.utc_millis(F.col("ts"), events.schema["ts"].dataType)
    hashed = events.select(F.lit("e").alias("ledger_id"), F.col("event_id").alias("row_no"), utc.alias("utc"), C.sha256(C.long_bytes(F.col("event_id"))).alias("row_hash"), "event_type")
    claimed = hashed.withColumn("row_hash", F.when(F.col("event_type") == "click", F.lit(C.SENTINEL)).otherwise(F.col("row_hash"))).withColumn("chain_id", F.lit("t"))
    return J.notary_check(claimed.select("ledger_id", "chain_id", "row_no", "utc", "row_hash"), hashed.select("ledger_id", "row_no", "row_hash")).select("row_no", "ok")


# Queries and reports -------------------------------------------------------------------------------------------------

TREE = json.dumps({"predTree": {"op": "AND", "sub": [{"rowPredicate": {"leftFunc": {"funcRowCols": [{"idx": 0, "rcn": 3}]}, "op": ">", "rightNum": {"arg": "min"}}}, {"op": "OR", "sub": [{"rowPredicate": {"leftFunc": {"funcRowCols": [{"idx": 0, "rcn": 0}]}, "op": "<=", "rightNum": 1000}}, {"rowPredicate": {"leftNum": {"arg": "total"}, "op": "<", "rightFunc": {"funcRowCols": [{"idx": 0, "rcn": 5}, {"idx": 1, "rcn": 6}], "func": {"op": "*", "sub": [{"val": "arg"}, {"op": "-", "sub": [{"val": 1}, {"val": "arg"}]}]}}}}]}, {"rowPredicate": {"leftFunc": {"funcRowCols": [{"idx": 0, "rcn": 1}], "func": {"op": "/", "sub": [{"val": "arg"}, {"val": 3}]}}, "op": ">=", "rightFunc": {"funcRowCols": [{"idx": 0, "rcn": 2}]}}}]}})
LINE = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_extendedprice", "l_discount", "l_returnflag"]


@query("query_predicate_tree", "SELECT l_orderkey AS row_no, l_partkey, l_suppkey, l_extendedprice FROM lineitem WHERE l_suppkey > 5 AND (l_orderkey <= 1000 OR 40000 < l_extendedprice * (1 - l_discount)) AND l_orderkey // 3 >= l_partkey")
def query_predicate_tree(spark, sf):
    lines = load(spark, sf, "lineitem").withColumn("row_no", F.col("l_orderkey"))
    return Q.parse_query(TREE).select(lines, LINE, {"min": 5, "total": 40000}).select("row_no", "l_partkey", "l_suppkey", "l_extendedprice")


@query("query_inapplicable_is_false", "SELECT count(*)::BIGINT AS n FROM lineitem WHERE l_orderkey <= 500")
def query_inapplicable_is_false(spark, sf):
    lines = load(spark, sf, "lineitem").withColumn("row_no", F.col("l_orderkey"))
    text = Q.Compare(Q.RowFunc((7,)), ">=", 0)
    absent = Q.Compare(Q.RowFunc((99,)), "<", 0)
    small = Q.Compare(Q.RowFunc((0,)), "<=", Q.Param("hi", 500))
    return Q.Query(Q.Branch("OR", (text, absent, small))).select(lines, LINE).agg(F.count("*").alias("n"))


@query("report_sum_by_param", "SELECT (sum(trunc(l_extendedprice)::BIGINT) // 2)::BIGINT AS plain, (SELECT sum(l_linenumber * l_suppkey)::BIGINT + 7 FROM lineitem WHERE l_partkey = 17) AS product FROM lineitem WHERE l_partkey = 17")
def report_sum_by_param(spark, sf):
    lines = load(spark, sf, "lineitem").withColumn("row_no", F.col("l_orderkey"))
    chosen = Q.Query(Q.Compare(Q.RowFunc((2,)), "=", Q.Param("part"))).select(lines, LINE, {"part": 17})
    plain = Q.total(chosen, LINE, 5, result=Q.Apply("/", (Q.Slot(0), 2))).select(F.col("total").alias("plain"))
    product = Q.total(chosen, LINE, Q.RowFunc((4, 3), Q.Apply("*", (Q.Slot(0), Q.Slot(1)))), result=Q.Apply("+", (Q.Slot(0), 7))).select(F.col("total").alias("product"))
    return plain.crossJoin(F.broadcast(product))


@query("report_table", "SELECT r::INTEGER AS r, c::INTEGER AS c, CASE WHEN r = 0 AND c = 0 THEN 'first' WHEN r = 24 AND c = 1 THEN 'last' WHEN c = 0 THEN '#' || n_nationkey ELSE n_name || ', ' || n_regionkey END AS text FROM (SELECT *, row_number() OVER (ORDER BY n_nationkey) - 1 AS r FROM nation), (VALUES (0), (1)) v(c)")
def report_table(spark, sf):
    nation = load(spark, sf, "nation")
    cells = [Q.formatted("number", F.col("n_nationkey"), prefix="#"), F.concat_ws(", ", F.col("n_name"), F.col("n_regionkey").cast("string"))]
    return Q.report_table(nation, cells, order="n_nationkey", fixed={0: "first", -1: "last"})


@query("sql_source", "SELECT row_number() OVER (ORDER BY s_suppkey) AS row_no, lower(hex(unhex(sha256(" + s_long("s_suppkey") + " || " + s_string("n_name") + ")))) AS input_hash FROM supplier JOIN nation ON s_nationkey = n_nationkey")
def sql_source(spark, sf):
    for name in ("supplier", "nation"):
        load(spark, sf, name).createOrReplaceTempView(f"src_{name}")
    ledger = S.sql_ledger(spark, "SELECT s_suppkey, n_name FROM src_supplier JOIN src_nation ON s_nationkey = n_nationkey", ["s_suppkey"])
    return O.with_input_hash(ledger, ["s_suppkey", "n_name"]).select("row_no", low_hex("input_hash").alias("input_hash"))


@query("table_preview", "SELECT o_orderkey, o_custkey FROM orders ORDER BY o_orderkey LIMIT 10")
def table_preview(spark, sf):
    return S.preview(load(spark, sf, "orders").select("o_orderkey", "o_custkey").orderBy("o_orderkey"))


# Logs ----------------------------------------------------------------------------------------------------------------

S_LINES = """
WITH parts AS (SELECT page_id, string_split(html, chr(10)) AS p FROM pages),
kept AS (SELECT page_id, CASE WHEN p[-1] = '' THEN p[:len(p) - 1] ELSE p END AS k, p[-1] = '' AS ended FROM parts),
each AS (SELECT page_id, unnest(k) AS line, unnest(range(1, len(k) + 1)) AS line_no, len(k) AS n, ended FROM kept),
sized AS (SELECT *, strlen(line) + CASE WHEN line_no < n OR ended THEN 1 ELSE 0 END AS size FROM each),
lines AS (SELECT page_id, line_no, line, size::BIGINT AS size, coalesce(sum(size) OVER (PARTITION BY page_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS offset FROM sized),
rows AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY line_no) AS row_no FROM lines WHERE NOT starts_with(line, '<p') AND regexp_matches(line, '[^ \\f\\t\\r\\n]'))
"""
GRAMMAR = L.Grammar(comment="<p")


def page_lines(spark, sf):
    return L.lines(load(spark, sf, "pages").select("page_id", F.col("html").alias("content")), ("page_id",))


def page_rows(spark, sf):
    return L.rows(page_lines(spark, sf), GRAMMAR, ("page_id",))


@query("log_lines", f"{S_LINES} SELECT page_id, line_no, \"offset\", size FROM lines")
def log_lines(spark, sf):
    return page_lines(spark, sf).select("page_id", "line_no", "offset", "size")


@query("log_row_numbers", f"{S_LINES} SELECT page_id, row_no, line_no, line FROM rows")
def log_row_numbers(spark, sf):
    return page_rows(spark, sf).select("page_id", "row_no", "line_no", "line")


@query("log_tokenize", f"{S_LINES} SELECT page_id, row_no, unnest(range(len(t)))::INTEGER AS idx, unnest(t) AS token FROM (SELECT *, list_filter(regexp_split_to_array(line, '[ \\t\\n\\r\\f]+'), lambda x: x <> '') AS t FROM rows)")
def log_tokenize(spark, sf):
    return L.token_cells(page_rows(spark, sf), GRAMMAR, ("page_id",)).select("page_id", "row_no", "idx", F.decode("data", "UTF-8").alias("token"))


@query(
    "log_input_hash",
    f"""{S_LINES} SELECT page_id, row_no, lower(hex(CASE WHEN len(h) = 0 THEN {S_SENTINEL} WHEN len(h) = 1 THEN h[1] ELSE unhex(sha256(list_reduce(h, lambda a, b: a || b))) END)) AS input_hash
    FROM (SELECT *, list_transform(list_filter(regexp_split_to_array(line, '[ \\t\\n\\r\\f]+'), lambda x: x <> ''), lambda x: unhex(sha256(unhex('01') || encode(x)))) AS h FROM rows)""",
)
def log_input_hash(spark, sf):
    return L.input_hashes(page_rows(spark, sf), GRAMMAR, ("page_id",)).select("page_id", "row_no", low_hex("input_hash").alias("input_hash"))


@query("log_hash_stats", f"{S_LINES} SELECT count(*)::BIGINT AS n_rows, sum(len(list_filter(regexp_split_to_array(line, '[ \\t\\n\\r\\f]+'), lambda x: x <> '')))::BIGINT AS n_tokens FROM rows")
def log_hash_stats(spark, sf):
    return L.hash_stats(page_rows(spark, sf), GRAMMAR)


@query("log_offset_index", f"{S_LINES} SELECT page_id, row_no, \"offset\", \"offset\" + size AS end_offset FROM rows")
def log_offset_index(spark, sf):
    return L.offset_index(page_rows(spark, sf), ("page_id",))


@query("skip_counts_and_frontiers", f"SELECT row_no, (bit_count((row_no & -row_no) - 1) + 1)::INTEGER AS skips, list_transform(range(length(ltrim(bin(row_no), '0'))), lambda k: (row_no >> k) << k)::VARCHAR AS frontier FROM ({S_ORDERS})")
def skip_counts_and_frontiers(spark, sf):
    rows = orders_ledger(spark, sf).select("row_no")
    frontier = F.concat(F.lit("["), F.array_join(R.frontier_col(F.col("row_no")), ", "), F.lit("]"))
    return rows.select("row_no", R.skip_count_col(F.col("row_no")).alias("skips"), frontier.alias("frontier"))


# Older cells, round trips and the rest --------------------------------------------------------------------------------


@query("covered_row_lookup", f"SELECT row_no FROM ({S_ORDERS}) WHERE row_no = 768 OR (row_no > 768 AND bit_count(row_no - 768) = 1 AND row_no - 768 <= (row_no & -row_no))")
def covered_row_lookup(spark, sf):
    return orders_ledger(spark, sf).select("row_no").where(P.covering(F.col("row_no"), 768))


@query("source_pack_round_trip", f"SELECT n_nationkey::BIGINT + 1 AS row_no, lower(hex({S_NATION_ROW})) AS input_hash FROM nation")
def source_pack_round_trip(spark, sf):
    nation = O.number_by_key(load(spark, sf, "nation"), "n_nationkey")
    cells = O.redact(O.long_cells(nation, NATION), (F.col("idx") == 1) & (F.col("row_no") % 2 == 0))
    rows, scheme = K.read_source_pack(K.write_source_pack(K.rows_of(cells)))
    return spark.createDataFrame([(r.no, r.input_hash(scheme).hex()) for r in rows], "row_no long, input_hash string")


@query("json_round_trip", "SELECT c_custkey AS row_no, i::INTEGER AS idx, [c_custkey::VARCHAR, c_name, c_nationkey::VARCHAR][i + 1] AS value FROM customer, (VALUES (0), (1), (2)) v(i)")
def json_round_trip(spark, sf):
    return K.json_rows(O.as_json(O.long_cells(load(spark, sf, "customer"), CUSTOMER, row="c_custkey"))).select("row_no", "idx", "value")


@query("chain_listing", f"SELECT row_no, o_custkey FROM ({S_ORDERS}) ORDER BY row_no DESC LIMIT 10 OFFSET 5")
def chain_listing(spark, sf):
    return orders_ledger(spark, sf).select("row_no", "o_custkey").orderBy(F.desc("row_no")).offset(5).limit(10)


@query("epoch_seed_lookup", "SELECT o_orderkey + 1 AS row_no, CASE WHEN o_orderkey + 1 >= 500 THEN 2 ELSE 1 END AS epoch FROM orders")
def epoch_seed_lookup(spark, sf):
    seeded = J.with_epoch_seed(orders_ledger(spark, sf), [(1, SEED), (500, SEED2)])
    return seeded.select("row_no", F.when(F.col("seed") == F.lit(SEED2), 2).otherwise(1).alias("epoch"))


@query("rename_ledgers", "SELECT CASE r_name WHEN 'ASIA' THEN 'EAST' ELSE r_name END AS ledger_id, r_regionkey FROM region")
def rename_ledgers(spark, sf):
    return J.rename_ledgers(load(spark, sf, "region").select(F.col("r_name").alias("ledger_id"), "r_regionkey"), {"ASIA": "EAST"})


@query("witness_zip", "SELECT event_id AS position, event_id + 1 AS row_no, epoch_us(ts) // 1000 AS utc, event_type <> 'click' AS ok FROM events")
def witness_zip(spark, sf):
    events = load(spark, sf, "events")
    own = C.sha256(C.long_bytes(F.col("event_id")))
    records = events.select(F.col("event_id").alias("position"), C.utc_millis(F.col("ts"), events.schema["ts"].dataType).alias("utc"), F.when(F.col("event_type") == "click", F.lit(C.SENTINEL)).otherwise(own).alias("hash"))
    return J.witness_zip(records, events.select(F.col("event_id").alias("position"), (F.col("event_id") + 1).alias("row_no"), own.alias("row_hash")))

# Chains with faults, checkpoints, commits -----------------------------------------------------------------------------


@query("chain_frontier_orders", f"{S_CHAIN} SELECT n AS row_no, k::INTEGER AS level, (SELECT lower(hex(h)) FROM fold WHERE r = (n >> k) << k) AS hash FROM (SELECT n, unnest(range(length(ltrim(bin(n), '0')))) AS k FROM (SELECT max(r) AS n FROM fold))")
def chain_frontier_orders(spark, sf):
    return H.frontiers_at(order_chain(spark, sf)).select("row_no", F.posexplode("hashes").alias("level", "h")).select("row_no", "level", low_hex("h").alias("hash"))


@query("checkpoint_validation", "SELECT i * 1024 AS row_no, i % 3 <> 0 AS ok FROM (SELECT unnest(range(1, (SELECT count(*) FROM orders) // 1024 + 1)) AS i)")
def checkpoint_validation(spark, sf):
    """Every third checkpoint has a wrong hash."""
    chain = order_chain(spark, sf)
    saved = H.work.written(H.checkpoints(chain, 10), "checkpoints")
    wrong = F.when(F.expr("row_no div 1024 % 3 = 0"), F.transform("hashes", lambda h, i: F.when(i == 0, C.sha256(h)).otherwise(h))).otherwise(F.col("hashes"))
    return H.check_checkpoints(saved.withColumn("hashes", wrong), chain).select("row_no", "ok")


@query("checkpoint_save", "SELECT n // 512 AS first, 0::BIGINT AS again, n // 256 - n // 512 AS more, true AS refused, n // 256 AS saved FROM (SELECT count(*) AS n FROM orders)")
def checkpoint_save(spark, sf):
    """Saved twice, then with others between, then with a forged one, which is refused."""
    chain, path = order_chain(spark, sf), f"{H.work.folder(spark)}/checkpoints-{H.work.uuid.uuid4().hex}"
    wide, narrow = (H.work.written(H.checkpoints(chain, e), "checkpoints") for e in (9, 8))
    first, again, more = H.save_checkpoints(path, wide), H.save_checkpoints(path, wide), H.save_checkpoints(path, narrow)
    try:
        H.save_checkpoints(path, narrow.withColumn("hashes", F.reverse("hashes")))
        refused = False
    except ValueError:
        refused = True
    saved = spark.read.schema(H.ENDS).parquet(path)
    return saved.agg(F.count("*").alias("saved")).select(F.lit(first).cast("long").alias("first"), F.lit(again).cast("long").alias("again"), F.lit(more).cast("long").alias("more"), F.lit(refused).alias("refused"), "saved")


@query(
    "sync_status",
    f"""WITH s AS (SELECT count(*)::BIGINT AS n, min(CASE WHEN {S_CHANGED} THEN o_orderkey + 1 END)::BIGINT AS f FROM orders)
    SELECT 'complete' AS ledger_id, n AS committed, n AS available, 'COMPLETE' AS state, NULL::BIGINT AS fork_row, n AS valid_rows FROM s
    UNION ALL SELECT 'forked', n, n, 'FORKED', f, f - 1 FROM s
    UNION ALL SELECT 'pending', 100, n, 'PENDING', NULL, 100 FROM s
    UNION ALL SELECT 'trimmed', n, 100, 'TRIMMED', NULL, 100 FROM s""",
)
def sync_status(spark, sf):
    own, changed = (H.work.written(i(spark, sf), "inputs") for i in (order_inputs, changed_orders))
    named = lambda df, name: df.withColumn("ledger_id", F.lit(name))
    few = own.where("row_no <= 100")
    committed = named(own, "complete").unionByName(named(own, "forked")).unionByName(named(few, "pending")).unionByName(named(own, "trimmed"))
    source = named(own, "complete").unionByName(named(changed, "forked")).unionByName(named(own, "pending")).unionByName(named(few, "trimmed"))
    return H.sync_status(committed, source)


S_DRAWN = "SELECT DISTINCT ('0x' || substr(sha256('sample:orders:' || j), 1, 15))::BIGINT % n + 1 AS row_no FROM (SELECT unnest(range(1, ceil(n * 0.5)::BIGINT + 1)) AS j, n FROM (SELECT count(*) AS n FROM orders))"


@query("sampled_conflicts", f"SELECT o_orderkey + 1 AS row_no FROM orders WHERE {S_CHANGED} AND o_orderkey + 1 IN ({S_DRAWN})")
def sampled_conflicts(spark, sf):
    """Among half as many draws as there are rows."""
    return H.sample_conflicts(order_inputs(spark, sf), changed_orders(spark, sf), 0.5).select("row_no")


@query("commit_twice", f"{S_CHAIN} {S_ROWS}")
def commit_twice(spark, sf):
    path = f"{H.work.folder(spark)}/commits-{H.work.uuid.uuid4().hex}"
    chain = order_chain(spark, sf)
    for part in (chain.where("row_no <= 1200"), chain, chain):
        H.append(path, part)
    return hex_rows(H.committed(spark, path))


@query("incremental_sync", f"{S_CHAIN} {S_ROWS}")
def incremental_sync(spark, sf):
    """A third of the rows a step until the source and the chain are even."""
    inputs = H.work.written(order_inputs(spark, sf), "orders-inputs")
    path, step = f"{H.work.folder(spark)}/sync-{H.work.uuid.uuid4().hex}", inputs.count() // 3 + 1
    while H.append(path, H.extend(H.committed(spark, path), inputs, max_rows=step, ends=H.ends_of(spark, path))):
        pass
    return hex_rows(H.committed(spark, path))


# Paths through the chain of orders ------------------------------------------------------------------------------------


def s_stitch(name: str, targets: str) -> str:
    """CTEs: {name} has the rows of the path through targets (SQL with a column row_no), {name}_known all that it covers, without 0."""
    return f"""{name}_pairs AS (SELECT coalesce(lag(row_no) OVER (ORDER BY row_no), row_no) AS low, row_no FROM (SELECT DISTINCT row_no FROM ({targets}))),
{name}_walk AS (SELECT low, row_no FROM {name}_pairs UNION ALL SELECT low, row_no - least(row_no & -row_no, 1::BIGINT << (length(ltrim(bin(row_no - low), '0')) - 1)) FROM {name}_walk WHERE row_no > low),
{name} AS (SELECT DISTINCT row_no FROM {name}_walk),
{name}_known AS (SELECT row_no FROM {name} UNION SELECT row_no - (1::BIGINT << k) FROM (SELECT row_no, unnest(range(bit_count((row_no & -row_no) - 1) + 1)) AS k FROM {name}) WHERE row_no > (1::BIGINT << k))"""


S_SIZE = "size AS (SELECT max(o_orderkey + 1) AS n FROM orders)"
S_LINKED = "(b IS NULL OR (bit_count(row_no - b) = 1 AND row_no - b <= (row_no & -row_no)))"
targets = lambda *t: " UNION ALL ".join(f"SELECT {x}::BIGINT AS row_no FROM size" for x in t)


@query(
    "skip_paths_to_end",
    """WITH RECURSIVE n AS (SELECT max(o_orderkey + 1) AS hi FROM orders),
    p AS (SELECT o_orderkey + 1 AS low, hi AS high, hi AS row_no FROM orders, n
          UNION ALL SELECT low, high, row_no - least(row_no & -row_no, 1::BIGINT << (length(ltrim(bin(row_no - low), '0')) - 1)) FROM p WHERE row_no > low)
    SELECT low, high, (count(*) OVER (PARTITION BY low, high) - row_number() OVER (PARTITION BY low, high ORDER BY row_no DESC))::INTEGER AS step, row_no FROM p""",
)
def skip_paths_to_end(spark, sf):
    orders = orders_ledger(spark, sf).select("row_no")
    hi = orders.agg(F.max("row_no").alias("high"))
    return P.skip_paths(orders.select(F.col("row_no").alias("low")).crossJoin(F.broadcast(hi)))


def size_of(chain) -> int:
    return chain.agg(F.max("row_no")).first()[0] or 0


@query("state_path_orders", f"WITH RECURSIVE {S_SIZE}, {s_stitch('p', targets('1', 'n'))} SELECT v.id AS path_id, v.ok, count(*)::BIGINT AS rows, 1::BIGINT AS lo, max(row_no) AS hi FROM p, (VALUES ('whole', true), ('forged', false), ('gap', false)) v(id, ok) WHERE id <> 'gap' OR row_no <> 4 GROUP BY ALL")
def state_path_orders(spark, sf):
    """The path from first to last row as it is, with a forged input, and without row 4."""
    whole = H.work.written(P.state_path(order_chain(spark, sf), "whole"), "state-path")
    forged = whole.withColumn("input_hash", F.when(F.col("row_no") == 1024, C.sha256("input_hash")).otherwise(F.col("input_hash"))).withColumn("path_id", F.lit("forged"))
    gap = whole.where("row_no <> 4").withColumn("path_id", F.lit("gap"))
    return P.verify_paths(whole.unionByName(forged).unionByName(gap)).select("path_id", "ok", "rows", "lo", "hi")


FORK = 1000


def forked_chain(spark, sf):
    """The chain of orders whose inputs differ from row FORK on."""
    inputs = order_inputs(spark, sf)
    other = F.when(F.col("row_no") >= FORK, C.sha256("input_hash")).otherwise(F.col("input_hash"))
    return H.work.written(H.fold(inputs.withColumn("input_hash", other)), "forked")


S_COMPARED = f"common_no, conflict_no, CASE WHEN conflict_no = common_no + 1 THEN conflict_no END AS fork_no FROM (SELECT coalesce(max(row_no) FILTER (row_no < {FORK}), 0) AS common_no, min(row_no) FILTER (row_no >= {FORK}) AS conflict_no"


@query(
    "path_compare_fork",
    f"WITH RECURSIVE {S_SIZE}, {s_stitch('p', targets('1', str(FORK), 'n'))}, {s_stitch('q', targets('1', 'n'))} SELECT 'near' AS id, {S_COMPARED} FROM p_known) UNION ALL SELECT 'far', {S_COMPARED} FROM q_known)",
)
def path_compare_fork(spark, sf):
    """Paths through the fork, and paths that pass it by."""
    one, two = order_chain(spark, sf), forked_chain(spark, sf)
    n = size_of(one)
    near = P.compare(P.path_of(one, [1, FORK, n]), P.path_of(two, [1, FORK, n])).withColumn("id", F.lit("near"))
    return near.unionByName(P.compare(P.path_of(one, [1, n]), P.path_of(two, [1, n])).withColumn("id", F.lit("far")))


@query(
    "multi_path_compare",
    f"""WITH RECURSIVE {S_SIZE}, {s_stitch('a', targets('1', '900'))}, {s_stitch('b', targets('1', '1100'))}, {s_stitch('p', targets('1', str(FORK), 'n'))},
    met AS (SELECT row_no FROM p_known WHERE row_no IN (SELECT row_no FROM a_known UNION SELECT row_no FROM b_known))
    SELECT {S_COMPARED} FROM met)""",
)
def multi_path_compare(spark, sf):
    """Two paths of the chain against one of the forked chain."""
    one = order_chain(spark, sf)
    many = P.path_of(one, [1, 900], "a").unionByName(P.path_of(one, [1, 1100], "b"))
    return P.compare_many(many, P.path_of(forked_chain(spark, sf), [1, FORK, size_of(one)]))


@query(
    "path_merge",
    f"""WITH RECURSIVE {S_SIZE}, {s_stitch('a', targets('1', '18', '20'))}, {s_stitch('b', targets('16', 'n'))}, m AS (SELECT row_no FROM a UNION SELECT row_no FROM b)
    SELECT row_no, (SELECT bool_and{S_LINKED} FROM (SELECT row_no, lag(row_no) OVER (ORDER BY row_no) AS b FROM m)) AS ok FROM m""",
)
def path_merge(spark, sf):
    chain = order_chain(spark, sf)
    merged = H.work.written(P.merge(P.path_of(chain, [1, 18, 20]), P.path_of(chain, [16, size_of(chain)])), "merged")
    return merged.select("row_no").crossJoin(F.broadcast(P.verify_paths(merged).select("ok")))


@query("path_append_tail", f"WITH RECURSIVE {S_SIZE}, {s_stitch('a', targets('1', '1025'))}, {s_stitch('b', targets('1024', 'n'))} SELECT row_no FROM a WHERE row_no < 1024 UNION SELECT row_no FROM b")
def path_append_tail(spark, sf):
    chain = order_chain(spark, sf)
    joined = H.work.written(P.append_tail(P.path_of(chain, [1, 1025]), P.path_of(chain, [1024, size_of(chain)])), "joined")
    return joined.select("row_no").crossJoin(F.broadcast(P.verify_paths(joined).where("ok").select("path_id"))).select("row_no")


@query(
    "path_authorities",
    f"""WITH RECURSIVE {S_SIZE}, {s_stitch('a', targets('1', 'n - 1'))}, {s_stitch('b', targets('1', 'n'))}, {s_stitch('c', targets('1', 'n - 5'))},
    known AS (SELECT 'a' AS id, row_no FROM a_known UNION ALL SELECT 'b', row_no FROM b_known UNION ALL SELECT 'c', row_no FROM c_known),
    tops AS (SELECT id, max(row_no) AS hi FROM known GROUP BY id)
    SELECT id AS path_id, hi FROM tops t WHERE NOT EXISTS (SELECT 1 FROM known k JOIN tops o ON o.id = k.id WHERE k.row_no = t.hi AND o.hi > t.hi)""",
)
def path_authorities(spark, sf):
    chain = order_chain(spark, sf)
    n = size_of(chain)
    return P.authorities(P.path_of(chain, [1, n - 1], "a").unionByName(P.path_of(chain, [1, n], "b")).unionByName(P.path_of(chain, [1, n - 5], "c")))


@query("path_intersect", f"WITH RECURSIVE {S_SIZE}, {s_stitch('a', targets('7', '1200'))}, {s_stitch('b', targets('4', 'n'))} SELECT row_no FROM a_known INTERSECT SELECT row_no FROM b_known")
def path_intersect(spark, sf):
    chain = order_chain(spark, sf)
    return P.common_rows(P.path_of(chain, [7, 1200]), P.path_of(chain, [4, size_of(chain)]))


@query("highest_common_row", f"WITH RECURSIVE {S_SIZE}, {s_stitch('a', targets('1', '1000'))}, {s_stitch('b', targets('17', 'n'))} SELECT coalesce(max(row_no), 0) AS common_no, NULL::BIGINT AS conflict_no, NULL::BIGINT AS fork_no FROM (SELECT row_no FROM a_known INTERSECT SELECT row_no FROM b_known)")
def highest_common_row(spark, sf):
    chain = order_chain(spark, sf)
    return P.compare(P.path_of(chain, [1, 1000]), P.path_of(chain, [17, size_of(chain)]))


S_SKIPS = "bit_count((row_no & -row_no) - 1) + 1"
#: Layers of the tree over a row's pointers in which the node above the pointer to row b has a sibling.
S_FUNNEL = f"list_sum(list_transform(range(6), lambda k: CASE WHEN ceil(({S_SKIPS}) / (1 << k)) > 1 AND xor((bit_count(row_no - b - 1) >> k)::BIGINT, 1) < ceil(({S_SKIPS}) / (1 << k)) THEN 1 ELSE 0 END))"


@query(
    "condensed_path",
    f"""WITH RECURSIVE {S_SIZE}, {s_stitch('p', targets('1', '1000', 'n'))}
    SELECT row_no, few, CASE WHEN few THEN {S_FUNNEL}::INTEGER END AS proof, row_no <> 512 AND coalesce(b, 0) <> 512 AS ok
    FROM (SELECT row_no, coalesce(lag(row_no) OVER (ORDER BY row_no), row_no - 1) AS b, ({S_SKIPS}) > 3 AND row_no <> 8 AS few FROM p)""",
)
def condensed_path(spark, sf):
    """Row 512 has a forged hash, which it shows itself and so does the row after it."""
    rows = H.work.written(P.condensed(P.path_of(order_chain(spark, sf, "v06"), [1, 1000, orders_ledger(spark, sf).count()])), "condensed")
    forged = rows.withColumn("row_hash", F.when(F.col("row_no") == 512, C.sha256("row_hash")).otherwise(F.col("row_hash")))
    shape = rows.select("row_no", F.col("funnel").isNotNull().alias("few"), F.when(F.col("funnel").isNotNull(), F.size("funnel")).alias("proof"))
    return shape.join(P.verify_condensed(forged).select("row_no", "ok"), "row_no")


def packed_rows(spark, rows):
    return spark.createDataFrame([(r, i.hex(), h.hex()) for r, i, h, _ in rows], "row_no long, input_hash string, row_hash string")


S_PACKED = "SELECT r AS row_no, lower(hex(i)) AS input_hash, lower(hex(h)) AS row_hash FROM fold JOIN p ON r = p.row_no"


@query("path_pack_round_trip", f"{S_CHAIN}, {S_SIZE}, {s_stitch('p', targets('3', '1000', 'n'))} {S_PACKED}")
def path_pack_round_trip(spark, sf):
    """Through JSON and back, too."""
    chain = order_chain(spark, sf)
    pack = K.write_path_pack(P.path_of(chain, [3, 1000, size_of(chain)]))
    return packed_rows(spark, K.read_path_pack(K.path_pack_of_json(K.path_pack_json(pack))))


@query("condensed_pack_round_trip", f"{s_chain(S_INPUT, 'v06')}, {S_SIZE}, {s_stitch('p', targets('16', '1000', 'n'))} {S_PACKED}")
def condensed_pack_round_trip(spark, sf):
    chain = order_chain(spark, sf, "v06")
    return packed_rows(spark, K.read_path_pack(K.write_path_pack(P.path_of(chain, [16, 1000, size_of(chain)]), condensed=True), "v06"))


# Ledgers, morsels, catalogs -------------------------------------------------------------------------------------------


def order_ledger(spark, sf, source=None):
    path = f"{H.work.folder(spark)}/ledger-{H.work.uuid.uuid4().hex}"
    return Ledger(spark, path, source or (lambda: orders_ledger(spark, sf)), ORDER_COLUMNS, "orders")


def changed_source(spark, sf):
    return lambda: orders_ledger(spark, sf).withColumn("o_custkey", F.when(F.expr(S_CHANGED), F.col("o_custkey") + 1).otherwise(F.col("o_custkey")))


@query(
    "ledger_status",
    f"""WITH s AS (SELECT count(*)::BIGINT AS n, min(CASE WHEN {S_CHANGED} THEN o_orderkey + 1 END)::BIGINT AS f FROM orders)
    SELECT 1 AS step, 1000::BIGINT AS committed, n AS available, 'PENDING' AS state, NULL::BIGINT AS fork_row, 1000::BIGINT AS valid_rows, 768::BIGINT AS witnessed FROM s
    UNION ALL SELECT 2, n, n, 'FORKED', f, f - 1, 768 FROM s UNION ALL SELECT 3, f - 1, n, 'PENDING', NULL, f - 1, 768 FROM s""",
)
def ledger_status(spark, sf):
    """Committed in part and witnessed; then whole, while the source changes; then rolled back to what is valid."""
    ledger = order_ledger(spark, sf)
    ledger.update(1000)
    ledger.witness(ledger.to_witness(8, include_last=False).select(F.lit("t").alias("chain_id"), "row_no", (F.col("row_no") * 10).alias("utc"), "row_hash"))
    steps = [H.work.written(ledger.status(), "status")]
    ledger.update()
    ledger.source = changed_source(spark, sf)
    steps.append(H.work.written(ledger.status(), "status"))
    ledger.rollback()
    steps.append(H.work.written(ledger.status(), "status"))
    named = [s.select(F.lit(i).alias("step"), "committed", "available", "state", "fork_row", "valid_rows", "witnessed") for i, s in enumerate(steps, 1)]
    return named[0].unionByName(named[1]).unionByName(named[2])


@query("ledger_validate", f"SELECT o_orderkey + 1 AS row_no FROM orders WHERE {S_CHANGED}")
def ledger_validate(spark, sf):
    ledger = order_ledger(spark, sf)
    ledger.update()
    ledger.source = changed_source(spark, sf)
    return ledger.validate()


MORSEL = [5, 77, 1000]


def order_morsel(spark, sf):
    ledger = order_ledger(spark, sf)
    ledger.update()
    return ledger.morsel(MORSEL, redact=[3], note="three orders")


@query("morsel_verify", f"WITH RECURSIVE {S_SIZE} SELECT 'path' AS what, 'state' AS item, true AS ok UNION ALL SELECT 'row', i::VARCHAR, i <> 77 FROM (VALUES (5), (77), (1000)) v(i)")
def morsel_verify(spark, sf):
    """A cell of row 77 is forged."""
    held = order_morsel(spark, sf)
    forged = F.when((F.col("row_no") == 77) & (F.col("idx") == 2), C.sha256("hash")).otherwise(F.col("hash"))
    return M.verify(held | {"cells": held["cells"].withColumn("hash", forged)})


@query(
    "morsel_summary",
    f"""WITH RECURSIVE {S_SIZE}, {s_stitch('p', targets('1', *map(str, MORSEL), 'n'))}
    SELECT 1::BIGINT AS paths, count(*)::BIGINT AS rows, min(row_no) AS lo, max(row_no) AS hi, (SELECT count(*) FROM p_known)::BIGINT AS known, 3::BIGINT AS entries, 3::BIGINT AS redacted,
           0::BIGINT AS witnesses, NULL::BIGINT AS first_utc, NULL::BIGINT AS last_utc, 0::BIGINT AS refs FROM p""",
)
def morsel_summary(spark, sf):
    return M.summary(order_morsel(spark, sf))


KEYS = (("orders", "customer"), ("lineitem", "orders"), ("customer", "nation"), ("supplier", "nation"), ("nation", "region"))


@query("key_neighbours", f"WITH k(f, t) AS (VALUES {', '.join(map(str, KEYS))}) SELECT t AS name, 'referred' AS side FROM k WHERE f = 'orders' UNION SELECT f, 'dependent' FROM k WHERE t = 'orders'")
def key_neighbours(spark, sf):
    return S.neighbours(spark.createDataFrame(list(KEYS), "from_table string, to_table string"), "orders")


@query(
    "chain_registry",
    """WITH c AS (SELECT r_regionkey + 1 AS chain_id, r_name AS name, r_regionkey % 3 = 1 AS deleted FROM region)
    SELECT chain_id::BIGINT AS chain_id, CASE WHEN chain_id = 1 THEN 'first' ELSE name END AS name, chain_id % 2 = 1 AS defined, CASE WHEN chain_id % 2 = 1 THEN 0 ELSE 2 END::BIGINT AS epochs FROM c WHERE NOT deleted""",
)
def chain_registry(spark, sf):
    """A chain for each region; some are defined, others have salt epochs, some are deleted."""
    registry = Registry(spark, f"{H.work.folder(spark)}/registry-{H.work.uuid.uuid4().hex}", Rights(delete=True))
    for r in load(spark, sf, "region").orderBy("r_regionkey").collect():  # a catalog has few chains
        chain = registry.create(r["r_name"], uri=f"u:{r['r_regionkey']}")
        if chain % 2:
            registry.define(chain, "SELECT max(k) FROM t", "SELECT * FROM t WHERE k = ?")
        else:
            registry.add_epoch(chain, 1, SEED)
            registry.add_epoch(chain, 500, SEED2)
        if r["r_regionkey"] % 3 == 1:
            registry.delete(chain)
    registry.update(1, name="first")
    return registry.states()


@query("log_chains", f"{S_LINES} SELECT page_id::VARCHAR AS ledger_id, count(*)::BIGINT AS n, page_id % 5 <> 0 OR count(*) < 3 AS ok FROM rows GROUP BY page_id")
def log_chains(spark, sf):
    """Of some pages, the hash of row 3 is forged."""
    inputs = L.input_hashes(page_rows(spark, sf), GRAMMAR, ("page_id",)).select(F.col("page_id").cast("string").alias("ledger_id"), "row_no", "input_hash")
    chain = H.work.written(H.fold(inputs), "page-chains")
    forged = F.when(F.expr("ledger_id % 5 = 0 and row_no = 3"), C.sha256("row_hash")).otherwise(F.col("row_hash"))
    return H.verify(chain.withColumn("row_hash", forged)).groupBy("ledger_id").agg(F.count("*").alias("n"), F.min("ok").alias("ok"))


OLD_COLUMNS = ["c_custkey", "c_name", "c_nationkey"]


def s_old(x: str, data: str, column: int, salted: bool) -> str:
    plain = f"CASE WHEN {x} IS NULL THEN {S_SENTINEL} ELSE unhex(sha256({data})) END"
    salt = f"unhex(sha256(unhex('{SEED.hex()}') || {S_LONG('c_custkey')} || unhex('{column:016x}')))"
    return f"unhex(sha256({salt} || {plain}))" if salted else plain


S_OLD = [("c_custkey", S_LONG("c_custkey::BIGINT")), ("c_name", "unhex(printf('%08x', octet_length(encode(c_name)))) || encode(c_name)"), ("c_nationkey", S_LONG("c_nationkey::BIGINT"))]
S_OLD_ROW = lambda salted: "lower(hex(unhex(sha256(" + " || ".join(s_old(x, d, i, salted) for i, (x, d) in enumerate(S_OLD, 1)) + "))))"


@query("older_row_hash", f"SELECT c_custkey AS row_no, {S_OLD_ROW(False)} AS plain, {S_OLD_ROW(True)} AS salted FROM customer")
def older_row_hash(spark, sf):
    customer = load(spark, sf, "customer").withColumn("row_no", F.col("c_custkey").cast("long"))
    plain = OLD.with_input_hash(customer, OLD_COLUMNS, name="plain")
    return OLD.with_input_hash(plain, OLD_COLUMNS, seed=SEED, name="salted").select("row_no", low_hex("plain").alias("plain"), low_hex("salted").alias("salted"))
