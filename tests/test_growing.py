"""Logs that grow, large logs, checkpoints, morsels, ledgers and databases."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from chainlake.functions import cells as C
from chainlake.functions import merkle
from chainlake.functions import rownumbers as R
from chainlake.operators import chain as H
from chainlake.operators import ordered
from chainlake.operators import paths as P
from chainlake.plans import morsel as M
from chainlake.plans.ledger import Ledger
from chainlake.plans.registry import Registry, Rights
from chainlake.sources import codecs, logledger, logs, sql

sha = lambda b: hashlib.sha256(b).digest()


def chain_of(spark, n, scheme="v05", seed=0, name="a"):
    rng = random.Random(seed)
    df = spark.createDataFrame([(name, r, rng.randbytes(32)) for r in range(1, n + 1)], "ledger_id string, row_no long, input_hash binary")
    return df, H.work.written(H.fold(df, scheme), "chain")


# Large logs -----------------------------------------------------------------------------------------------------------


def log_text(n, seed=1):
    rng = random.Random(seed)
    return "".join(rng.choice(["", "# note", "é row", f"row {i} of many words", "\ttab\r"]) + "\n" for i in range(n))


def test_large_logs_are_split_and_numbered(spark, tmp_path):
    texts = {"a.log": log_text(4000), "b.log": log_text(900, 2) + "no line feed at the end", "c.log": "", "d.log": "one\n"}
    for name, text in texts.items():
        (tmp_path / name).write_bytes(text.encode())
    grammar = logs.Grammar(comment="#")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "3000")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        found = logs.read_lines(spark, str(tmp_path), grammar)
        assert found.select("ledger_id").rdd.getNumPartitions() > 10
        got = [(r.ledger_id.rpartition("/")[2], r.line_no, r.offset, r.size, r.line, r.row_no) for r in found.collect()]
        index = H.work.written(logs.offset_index(found.where("row_no is not null")), "index")
        data = {(r.ledger_id.rpartition("/")[2], r.row_no): bytes(r.data) for r in logs.row_bytes(index.where("row_no % 7 = 3")).collect()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    want, rows = [], {}
    for name, text in texts.items():
        at, row = 0, 0
        for k, line in enumerate(text.encode().splitlines(keepends=True) if "\r" not in text else text.encode().split(b"\n")):
            raw = line if line.endswith(b"\n") else line + (b"\n" if at + len(line) < len(text.encode()) else b"")
            if not raw:
                continue
            plain = raw.removesuffix(b"\n").decode()
            is_row = not plain.startswith("#") and plain.strip(" \f\t\r\n") != ""
            row += is_row
            want.append((name, k + 1, at, len(raw), plain, row if is_row else None))
            if is_row:
                rows[name, row] = raw
            at += len(raw)
    assert sorted(got) == sorted(want)
    assert data == {k: v for k, v in rows.items() if k[1] % 7 == 3}


def test_logs_resume_where_they_ended(spark, tmp_path):
    grammar, path = logs.Grammar(comment="#"), tmp_path / "x.log"
    first, more = log_text(300), log_text(200, 5)
    path.write_text(first)
    rows = H.work.written(logledger.parsed(spark, str(tmp_path), grammar), "rows")
    chain = H.work.written(H.fold(rows.select("ledger_id", "row_no", "input_hash")), "chain")
    saved = H.work.written(logledger.checkpoint(rows, chain), "saved")
    seals = H.work.written(logledger.seal(chain, grammar), "seals")
    assert logledger.resumed(spark, str(tmp_path), saved, grammar).count() == 0
    path.write_text(first + more)
    (tmp_path / "new.log").write_text("a new log\n")
    new = H.work.written(logledger.resumed(spark, str(tmp_path), saved, grammar), "new")
    added = logledger.extended(new, saved)
    whole = H.fold(logledger.parsed(spark, str(tmp_path), grammar).select("ledger_id", "row_no", "input_hash"))
    key = lambda df: sorted((r.ledger_id, r.row_no, bytes(r.row_hash)) for r in df.collect())
    assert key(chain.unionByName(added)) == key(whole)
    checked = {r.ledger_id.rpartition("/")[2]: (r.ok, r.more) for r in logledger.check_seal(spark, str(tmp_path), seals).collect()}
    assert checked == {"x.log": (True, whole.where("ledger_id like '%x.log'").count() - chain.count())}
    seen = logledger.replay(logledger.parsed(spark, str(tmp_path), grammar), {"words": F.sum(F.size(logs.tokens(F.col("line")))), "last": F.max("row_no")}, max_rows=10)
    assert {r.last for r in seen.collect()} == {10, 1}
    # another last row, and a log cut off
    at = saved.first()
    path.write_bytes(path.read_bytes()[: at.offset] + b"changed\n")
    with pytest.raises(ValueError, match="isn't what it was"):
        logledger.resumed(spark, str(tmp_path), saved, grammar)
    assert not logledger.check_seal(spark, str(tmp_path), seals).first().ok
    path.write_bytes(first.encode()[: at.offset - 5])
    with pytest.raises(ValueError, match="isn't what it was"):
        logledger.resumed(spark, str(tmp_path), saved, grammar)


# Chains ---------------------------------------------------------------------------------------------------------------


def test_ends_are_kept_beside_the_chain(spark, tmp_path):
    df, chain = chain_of(spark, 90)
    path = f"file://{tmp_path}/rows"
    assert H.append(path, chain.where("row_no <= 40")) == 40
    kept = H.ends_of(spark, path)
    assert "ends" in str(kept.inputFiles()) and kept.first().row_no == 40
    more = H.extend(H.committed(spark, path), df, max_rows=30, ends=kept)
    assert H.append(path, more) == 30
    assert [tuple(map(bytes, r.hashes)) for r in H.ends_of(spark, path).collect()] == [tuple(map(bytes, r.hashes)) for r in H.frontiers_at(chain.where("row_no <= 70")).collect()]
    # a writer was lost after the rows and before the ends
    chain.where("row_no between 71 and 80").write.mode("append").parquet(path)
    assert H.ends_of(spark, path).first().row_no == 80
    assert H.append(path, chain) == 10 and H.verify(H.committed(spark, path)).where("not ok").count() == 0
    H.rollback(path, spark.createDataFrame([("a", 7)], "ledger_id string, size long"))
    assert H.ends_of(spark, path).first().row_no == 7
    _, other = chain_of(spark, 5, seed=3, name="b")
    assert H.append(path, other) == 5 and {r.ledger_id: r.row_no for r in H.ends_of(spark, path).collect()} == {"a": 7, "b": 5}


def test_checkpoints_are_saved_once(spark, tmp_path):
    _, chain = chain_of(spark, 40)
    path, saved = f"file://{tmp_path}/points", H.work.written(H.checkpoints(chain, 3), "points")
    assert H.save_checkpoints(path, saved) == 5 and H.save_checkpoints(path, saved) == 0
    wrong = saved.withColumn("hashes", F.reverse("hashes"))
    with pytest.raises(ValueError, match="conflict"):
        H.save_checkpoints(path, wrong.where("row_no = 24"))
    assert H.save_checkpoints(path, wrong.where("row_no = 24"), force=True) == 0
    assert H.check_checkpoints(spark.read.parquet(path), chain).where("not ok").first().row_no == 24


def test_draws_are_spread_and_repeatable(spark):
    rows = spark.range(1, 2001).select(F.lit("l").alias("ledger_id"), F.col("id").alias("row_no"))
    some, again = (sorted(r.row_no for r in H.drawn(rows, 0.5).collect()) for _ in range(2))
    assert some == again and 700 < len(some) < 880 and min(some) >= 1 and max(some) <= 2000
    assert 1500 < H.drawn(rows, 1.9).count() < 1850 and some != sorted(r.row_no for r in H.drawn(rows, 0.5, "other").collect())


def test_values_are_carried_over_ranges(spark):
    rng = random.Random(4)
    rows = [(rng.choice("xy"), rng.randrange(500), i, rng.choice([None, None, i])) for i in range(800)]
    df = spark.createDataFrame(rows, "k string, at long, id long, v long").repartition(5)
    for own in (True, False):
        for descending in (True, False):
            got = {r.id: r._carried for r in ordered.carried(df, F.col("v"), "at", then=("id",), keys=("k",), own=own, descending=descending).collect()}
            want, last = {}, {}
            for k, at, i, v in sorted(rows, key=lambda r: (-r[1] if descending else r[1], r[2])):
                before = last.get(k)
                last[k] = v if v is not None else before
                want[i] = last[k] if own else before
            assert got == want


# Paths, packs and morsels ---------------------------------------------------------------------------------------------


def test_condensing_numbers():
    assert [r for r in range(1, 70) if R.condensable(r)] == [16, 24, 32, 40, 48, 56, 64]
    path = R.stitch([1, 100])
    assert R.stitch_compress(path) == [1, 100]
    for seed in range(200):
        rng = random.Random(seed)
        path = R.stitch(rng.sample(range(1, 2000), rng.randrange(1, 9)))
        short = R.stitch_compress(path)
        assert R.stitch(short) == path and all(R.stitch([r for r in short if r != x]) != path for x in short)
    assert R.funnel_hashes([1, 2, 4, 8, 16]) == len(merkle.funnel([bytes(32)] * 5, 3))
    with pytest.raises(ValueError):
        R.funnel_hashes([1, 2, 16, 17, 40])


def test_proofs_in_expressions(spark):
    rng = random.Random(2)
    rows = [(n, k, [rng.randbytes(32) for _ in range(n)]) for n in (1, 2, 3, 4, 5, 7, 8, 13, 33) for k in range(n)]
    df = spark.createDataFrame(rows, "n int, k int, leaves array<binary>")
    proof = merkle.funnel_col(F.col("leaves"), F.col("k"))
    found = df.withColumn("proof", proof).withColumn("root", merkle.root_from_col(F.get("leaves", F.col("k")), F.col("k"), F.col("n"), F.col("proof"))).withColumn("long", merkle.root_from_col(F.get("leaves", F.col("k")), F.col("k"), F.col("n"), F.concat("proof", F.array(F.lit(b"x")))))
    for r in found.collect():
        leaves = [bytes(x) for x in r.leaves]
        assert [bytes(x) for x in r.proof] == merkle.funnel(leaves, r.k) and bytes(r.root) == merkle.root(leaves) and r.long is None


def test_condensed_packs(spark):
    _, chain = chain_of(spark, 1027, "v06")
    for targets in ([1, 1027], [4, 8, 12, 16, 1000], [64, 65], [8], [16], [48, 1024]):
        path = H.work.written(P.path_of(chain, targets), "path")
        full, small = codecs.write_path_pack(path), codecs.write_path_pack(path, condensed=True)
        assert len(small) <= len(full)
        want = [(r.row_no, bytes(r.input_hash), bytes(r.row_hash)) for r in path.orderBy("row_no").collect()]
        for pack in (full, small, codecs.path_pack_of_json(codecs.path_pack_json(small))):
            assert [r[:3] for r in codecs.read_path_pack(pack, "v06")] == want
        held = P.condensed(path)
        assert P.verify_condensed(held).where("not ok").count() == 0
        assert {r.row_no for r in held.where("funnel is not null").collect()} == {n for n, _, _ in want if R.condensable(n)}
    with pytest.raises(ValueError):
        codecs.read_path_pack(small, "v05")
    with pytest.raises(ValueError):
        codecs.read_path_pack(small + bytes(32), "v06")
    wrong = held.withColumn("level_hash", F.when(F.col("row_no") == 1024, F.lit(b"x" * 32)).otherwise(F.col("level_hash")))
    assert [r.row_no for r in P.verify_condensed(wrong).where("not ok").collect()] == [1024]


def test_schemes_and_epochs_as_json():
    for scheme in (C.NO_SALT, C.SALT_ALL, C.SaltScheme((0, 3)), C.SaltScheme((2,), False)):
        again = codecs.salt_scheme_of_json(codecs.salt_scheme_json(scheme))
        assert all(again.salted(i) == scheme.salted(i) for i in range(9))
    epochs = [(1, b"a" * 32), (70, b"b" * 32)]
    assert codecs.epochs_of_json(codecs.epochs_json(epochs[::-1])) == epochs
    for bad in ('[]', '[{"start_row": 2, "seed": "00"}]', '[{"start_row": 1, "seed": "00"}, {"start_row": 1, "seed": "01"}]'):
        with pytest.raises(ValueError):
            codecs.epochs_of_json(bad)


def test_many_paths(spark):
    df, chain = chain_of(spark, 300)
    many = P.path_of(chain, [1, 200], "x").unionByName(P.path_of(chain, [1, 290], "y"))
    assert P.compare_many(many, P.path_of(chain, [1, 300])).first().conflict_no is None
    other = H.work.written(H.fold(df.withColumn("input_hash", F.when(F.col("row_no") >= 100, C.sha256("input_hash")).otherwise(F.col("input_hash")))), "other")
    found = P.compare_many(many, P.path_of(other, [1, 100, 300])).first()
    assert found.common_no < 100 <= found.conflict_no
    mixed = P.path_of(chain, [1, 200], "x").unionByName(P.path_of(other, [1, 290], "y"))
    with pytest.raises(Exception, match="different ledgers"):
        P.compare_many(mixed, P.path_of(chain, [1, 300])).collect()
    joined = P.append_tail(P.path_of(chain, [1, 129]), P.path_of(chain, [128, 300]))
    assert P.verify_paths(joined).first().ok
    with pytest.raises(ValueError):
        P.append_tail(P.path_of(chain, [1, 129]), P.path_of(other, [128, 300]))


def ledger_of(spark, tmp_path, n=60):
    held = {"rows": [(i, f"name {i}", i * i) for i in range(1, n + 1)]}
    source = lambda: spark.createDataFrame(held["rows"], "row_no long, s string, n long")
    return held, Ledger(spark, f"file://{tmp_path}/ledger", source, ["s", "n"])


def test_ledger_verbs(spark, tmp_path):
    held, ledger = ledger_of(spark, tmp_path)
    assert ledger.update(20) == 20 and ledger.status().first().state == "PENDING"
    due = ledger.to_witness(3).select(F.lit("t").alias("chain_id"), "row_no", F.col("row_no").alias("utc"), "row_hash")
    assert ledger.witness(due) == 3 and ledger.witness(due) == 0
    with pytest.raises(ValueError):
        ledger.witness(due.withColumn("row_hash", F.lit(bytes(32))))
    assert [r.row_no for r in ledger.history().collect()] == [8, 16, 20]
    assert ledger.update() == 40 and ledger.status().first().state == "COMPLETE" and sorted(r.row_no for r in ledger.to_witness(4).collect()) == [32, 48, 60]
    assert ledger.check_ends().where("not ok").count() == 0 and ledger.validate().count() == 0
    assert ledger.list_rows(ranges=[(3, 4)], separator="|").orderBy("row_no").collect()[0].line == "name 3|9"
    held["rows"][17] = (18, "forged", 1)
    assert [r.row_no for r in ledger.validate().collect()] == [18] and ledger.validate(2.5).count() == 1
    assert ledger.rollback() == 17 and ledger.status().first().valid_rows == 17
    assert [r.row_no for r in ledger.history().collect()] == [8, 16] and ledger.update() == 43


def test_morsels(spark, tmp_path):
    _, ledger = ledger_of(spark, tmp_path)
    ledger.update()
    ledger.witness(ledger.to_witness(4).select(F.lit("t").alias("chain_id"), "row_no", F.col("row_no").alias("utc"), "row_hash"))
    one, two = ledger.morsel([5, 33], redact=[1], note="n"), ledger.morsel([33, 40])
    for held in (one, two):
        assert M.verify(held).where("not ok").count() == 0
    M.write(f"file://{tmp_path}/m", one)
    back = M.read(spark, f"file://{tmp_path}/m")
    seen = M.summary(back).first()
    assert (seen.paths, seen.lo, seen.hi, seen.entries, seen.redacted) == (1, 1, 60, 2, 2) and seen.rows == len(R.stitch([1, 5, 33, 60])) and seen.witnesses > 0
    both = M.merge(back, two)
    assert M.verify(both).where("not ok").count() == 0
    seen = M.summary(both).first()
    assert (seen.paths, seen.entries, seen.redacted) == (2, 3, 1)  # row 33 is shown by the second
    small = M.part(both, [33])
    assert M.verify(small).where("not ok").count() == 0 and M.summary(small).first().entries == 1
    kinds = {r.kind for r in M.dump(both).collect()}
    assert kinds == {"row", "hash", "entry", "witness"}
    _, foreign = ledger_of(spark, tmp_path / "other", 61)
    foreign.source = lambda: spark.createDataFrame([(i, "x", i) for i in range(1, 61)], "row_no long, s string, n long")
    foreign.update()
    with pytest.raises(ValueError, match="conflict"):
        M.merge(one, foreign.morsel([5]))
    forged = one | {"cells": one["cells"].withColumn("hash", C.sha256("hash"))}
    assert M.verify(forged).where("not ok").count() == 2


def test_rights(spark, tmp_path):
    _, chain = chain_of(spark, 9)
    reg = Registry(spark, f"file://{tmp_path}/reg", Rights(commit=True, rollback=False))
    a = reg.create("one")
    assert reg.commit(a, chain) == 9 and reg.committed(a).count() == 9
    with pytest.raises(PermissionError):
        reg.rollback(a, spark.createDataFrame([("a", 3)], "ledger_id string, size long"))
    with pytest.raises(PermissionError):
        Registry(spark, reg.path, Rights(commit=False)).commit(a, chain)
    Registry(spark, reg.path, Rights(rollback=True)).rollback(a, spark.createDataFrame([("a", 3)], "ledger_id string, size long"))
    assert reg.committed(a).count() == 3


def test_databases(spark, tmp_path):
    """The database that Spark brings along, through JDBC: a source ledger, and a chain kept in a table."""
    url = f"jdbc:derby:{tmp_path}/db;create=true"
    rows = [(i, f"name {i}", i * 3) for i in range(1, 201)]
    spark.createDataFrame(rows, "row_no long, s string, n long").write.format("jdbc").options(url=url, dbtable="src", createTableColumnTypes="s VARCHAR(40)").save()
    ledger = sql.jdbc_ledger(spark, url, "SELECT * FROM src", row="row_no", low=1, high=200, partitions=4)
    assert ledger.rdd.getNumPartitions() == 4 and sorted(map(tuple, ledger.collect())) == rows
    inputs = Ledger(spark, "", lambda: ledger, ["s", "n"]).inputs()
    chain = H.work.written(H.fold(inputs), "chain")
    sql.save_commits(chain, url, "commits")
    back = sql.jdbc_commits(spark, url, "commits", "ledger", high=200, partitions=3)
    key = lambda df: sorted((r.ledger_id, r.row_no, bytes(r.input_hash), bytes(r.row_hash)) for r in df.collect())
    assert key(back) == key(chain)
