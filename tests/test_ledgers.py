import hashlib
import json
import random

import pytest
from pyspark.sql import functions as F

from chainlake.functions import cells as C
from chainlake.functions import merkle
from chainlake.functions import rownumbers as R
from chainlake.operators import chain as H
from chainlake.operators import joins as J
from chainlake.operators import paths as P
from chainlake.operators import query as Q
from chainlake.operators import rows as O
from chainlake.plans.registry import Registry, Rights
from chainlake.sources import codecs, logs, sql

sha = lambda b: hashlib.sha256(b).digest()


def plain_chain(inputs, scheme="v05"):
    out = [bytes(32)]
    for r, i in enumerate(inputs, 1):
        pointers = [out[r - (1 << k)] for k in range(R.skip_count(r))]
        above = b"".join(pointers) if scheme == "v05" or len(pointers) == 1 else merkle.root(pointers)
        out.append(sha(i + above))
    return out


def inputs_of(spark, sizes, seed=0):
    rng = random.Random(seed)
    rows = {name: [rng.randbytes(32) for _ in range(n)] for name, n in sizes.items()}
    df = spark.createDataFrame([(k, r, h) for k, hs in rows.items() for r, h in enumerate(hs, 1)], "ledger_id string, row_no long, input_hash binary")
    return rows, df


@pytest.mark.parametrize("scheme", H.SCHEMES)
def test_fold_extend_and_verify(spark, scheme):
    rows, df = inputs_of(spark, {"a": 1, "b": 2, "c": 1027})
    whole = {(r.ledger_id, r.row_no): bytes(r.row_hash) for r in H.fold(df.orderBy(F.rand(1)), scheme).collect()}
    assert whole == {(k, i): h for k, hs in rows.items() for i, h in enumerate(plain_chain(hs, scheme)) if i}
    part = H.work.written(H.fold(df.where("row_no <= 600"), scheme), "part")
    more = H.work.written(H.extend(part, df, scheme), "more")
    assert {(r.ledger_id, r.row_no): bytes(r.row_hash) for r in part.unionByName(more).collect()} == whole
    assert H.extend(part, df, scheme, max_rows=5).count() == 5
    chain = part.unionByName(more)
    assert H.verify(chain, scheme).where("not ok").count() == 0
    forged = chain.withColumn("input_hash", F.when((F.col("ledger_id") == "c") & (F.col("row_no") == 700), F.lit(bytes(32))).otherwise(F.col("input_hash")))
    assert [(r.ledger_id, r.row_no) for r in H.verify(forged, scheme).where("not ok").collect()] == [("c", 700)]
    hole = H.verify(chain.where("not (ledger_id = 'c' and row_no = 512)"), scheme).where("not ok")
    assert {r.row_no for r in hole.collect()} == {r for r in range(1, 1028) if 512 in R.pointers(r)}


def test_out_of_sequence_rows_are_refused(spark):
    _, df = inputs_of(spark, {"a": 5})
    with pytest.raises(Exception, match="follows row"):
        H.fold(df.where("row_no <> 3")).collect()


def test_commit_conflict_gap_and_rollback(spark, tmp_path):
    _, df = inputs_of(spark, {"a": 20, "b": 7})
    chain, path = H.work.written(H.fold(df), "chain"), f"file://{tmp_path}/commits"
    assert H.append(path, chain.where("row_no <= 4")) == 8
    assert H.append(path, chain.where("row_no <= 9")) == 8
    assert H.append(path, chain.where("row_no <= 9")) == 0
    with pytest.raises(ValueError, match="conflict"):
        H.append(path, chain.where("row_no = 3").withColumn("row_hash", F.lit(bytes(32))))
    with pytest.raises(ValueError, match="gap"):
        H.append(path, chain.where("row_no = 15"))
    H.rollback(path, spark.createDataFrame([("a", 5)], "ledger_id string, size long"))
    assert {r.ledger_id: r.size for r in H.sizes(spark.read.parquet(path)).collect()} == {"a": 5, "b": 7}
    assert H.append(path, chain) == 15


def test_status_and_checkpoints(spark):
    _, df = inputs_of(spark, {"same": 9, "fork": 40, "more": 30, "less": 8})
    chain = H.work.written(H.fold(df), "chain")
    source = df.where("not (ledger_id = 'less' and row_no > 5)")
    source = source.withColumn("input_hash", F.when((F.col("ledger_id") == "fork") & F.col("row_no").isin(7, 33), F.lit(bytes(32))).otherwise(F.col("input_hash")))
    found = {r.ledger_id: (r.state, r.fork_row, r.valid_rows) for r in H.sync_status(chain.where("not (ledger_id = 'more' and row_no > 10)"), source).collect()}
    assert found == {"same": ("COMPLETE", None, 9), "fork": ("FORKED", 7, 6), "more": ("PENDING", None, 10), "less": ("TRIMMED", None, 5)}
    assert H.sync_status(chain, source, max_lookback=10).where("ledger_id = 'fork'").first().fork_row == 33
    saved = H.work.written(H.checkpoints(chain, 2), "checkpoints")
    assert {(r.ledger_id, r.row_no) for r in saved.collect()} == {(k, r) for k, n in (("same", 9), ("fork", 40), ("more", 30), ("less", 8)) for r in range(4, n + 1, 4)}
    assert H.check_checkpoints(saved, chain).where("not ok").count() == 0
    wrong = saved.withColumn("hashes", F.when(F.col("row_no") == 8, F.array(F.lit(bytes(32)))).otherwise(F.col("hashes")))
    assert {r.row_no for r in H.check_checkpoints(wrong, chain).where("not ok").collect()} == {8}
    # a fold can start from any checkpoint
    rest = H.fold(df.where("ledger_id = 'fork' and row_no > 32"), "v05", saved.where("ledger_id = 'fork' and row_no = 32"))
    assert rest.join(chain, ["ledger_id", "row_no", "row_hash"]).count() == 8


def test_paths(spark):
    _, df = inputs_of(spark, {"a": 300})
    for scheme in H.SCHEMES:
        chain = H.work.written(H.fold(df, scheme), "chain")
        path = P.path_of(chain, [5, 100, 299])
        assert [r.row_no for r in path.orderBy("row_no").collect()] == R.stitch([5, 100, 299])
        assert P.verify_paths(path, scheme).first().ok
        broken = path.withColumn("input_hash", F.when(F.col("row_no") == 100, F.lit(bytes(32))).otherwise(F.col("input_hash")))
        assert not P.verify_paths(broken, scheme).first().ok
        assert not P.verify_paths(path.where("row_no <> 100 and row_no <> 96"), scheme).first().ok
        pack = codecs.write_path_pack(path)
        again = codecs.read_path_pack(pack, scheme)
        assert [(r[0], r[1], r[2]) for r in again] == [(r.row_no, bytes(r.input_hash), bytes(r.row_hash)) for r in path.orderBy("row_no").collect()]
        with pytest.raises(ValueError):
            codecs.read_path_pack(pack[:-1], scheme)
    condensed = P.condensed(path)
    assert P.verify_condensed(condensed).where("not ok").count() == 0
    forged = condensed.withColumn("level_hash", F.when(F.col("row_no") == 100, F.lit(b"x" * 32)).otherwise(F.col("level_hash")))
    assert [r.row_no for r in P.verify_condensed(forged).where("not ok").collect()] == [100]
    other = H.work.written(H.fold(df.withColumn("input_hash", F.when(F.col("row_no") > 130, C.sha256("input_hash")).otherwise(F.col("input_hash"))), "v06"), "chain")
    found = P.compare(path, P.path_of(other, [5, 100, 299])).first()
    assert found.common_no == 128 and found.conflict_no > 130 and found.fork_no is None
    with pytest.raises(ValueError, match="conflict"):
        P.merge(path, P.path_of(other, [5, 299]))
    assert P.merge(P.path_of(chain, [5, 64]), P.path_of(chain, [64, 299])).count() == len(R.stitch([5, 64, 299]))
    row = P.path_of(chain, [300]).where("row_no = 300")
    assert P.add_row(P.path_of(chain, [1, 299]), row).agg(F.max("row_no")).first()[0] == 300
    with pytest.raises(ValueError):
        P.add_row(P.path_of(chain, [1, 257]), row)
    with pytest.raises(ValueError):
        P.add_row(P.path_of(chain, [1, 299]), P.path_of(other, [200]).where("row_no = 200"))
    assert [r.row_no for r in P.slice_path(path, head=100, tail=64).orderBy("row_no").collect()] == [r for r in R.stitch([5, 100, 299]) if 64 <= r < 100]
    assert {r.row_no for r in P.common_rows(P.path_of(chain, [5, 9]), P.path_of(chain, [8, 12])).collect()} == set(R.coverage(R.stitch([5, 9]))) & set(R.coverage(R.stitch([8, 12]))) - {0}


def test_source_packs(spark):
    rng = random.Random(3)
    for scheme in (C.NO_SALT, C.SALT_ALL, C.SaltScheme((0, 2)), C.SaltScheme((1,), False)):
        for even in (True, False):
            rows = []
            for no in sorted(rng.sample(range(1, 500), 12)):
                salt = rng.choice([None, rng.randbytes(32)]) if scheme is not C.NO_SALT else None
                cells = []
                for i in range(4 if even else rng.randrange(0, 6)):
                    kind = rng.randrange(0, 9)
                    data = {C.NULL: bytes(5), C.LONG: rng.randbytes(8), C.DATE: rng.randbytes(8), C.BOOL: b"\1", C.HASH: rng.randbytes(32)}.get(kind, rng.randbytes(rng.randrange(1, 300)))
                    own = rng.randbytes(32) if scheme.salted(i) and salt is None else None
                    cells.append(codecs.Cell(C.HASH, None, None, rng.randbytes(32)) if rng.random() < 0.2 else codecs.Cell(kind, data, own))
                rows.append(codecs.Row(no, tuple(cells), salt))
            got, kind = codecs.read_source_pack(codecs.write_source_pack(rows, scheme))
            assert got == rows and all(kind.salted(i) == scheme.salted(i) for i in range(8))
    with pytest.raises(ValueError):
        codecs.read_source_pack(codecs.write_source_pack(rows, scheme)[:-3])


def test_redacted_rows_keep_their_hash(spark):
    df = spark.createDataFrame([(1, "a", 5), (2, None, 6), (3, "c", None)], "row_no long, s string, n long").withColumn("salt", C.row_salt(F.lit(b"k" * 32), F.col("row_no")))
    cells = O.long_cells(df, ["s", "n"], scheme=C.SALT_ALL, salt="salt")
    want = {r.row_no: bytes(r.input_hash) for r in O.with_input_hash(df, ["s", "n"], scheme=C.SALT_ALL, salt="salt").collect()}
    hidden = O.redact(cells, F.col("idx") == 1)
    assert {r.row_no: bytes(r.input_hash) for r in O.hash_of_cells(hidden).collect()} == want
    assert hidden.where("idx = 1 and (data is not null or salt is not null)").count() == 0 and O.rows_with_redactions(cells).count() == 0
    packed = codecs.rows_of(hidden)
    rows, scheme = codecs.read_source_pack(codecs.write_source_pack(packed, C.SALT_ALL))
    assert {r.no: r.input_hash(scheme) for r in rows} == want
    parsed = codecs.json_rows(O.as_json(hidden)).where("idx = 0").orderBy("row_no").collect()
    assert [(r.row_no, r.type, r.value) for r in parsed] == [(1, "STRING", "a"), (2, "NULL", None), (3, "STRING", "c")]


def test_row_numbering_is_gapless(spark):
    df = spark.range(5000).select((F.col("id") * 7919 % 5000).alias("k"))
    got = O.number_rows(df, ["k"], partitions=7).orderBy("row_no").collect()
    assert [(r.k, r.row_no) for r in got] == [(i, i + 1) for i in range(5000)]


def test_references_and_nearest_records(spark):
    targets = spark.createDataFrame([(1,), (5,), (9,), (12,)], "row_no long")
    records = spark.createDataFrame([(5, 50), (8, 80), (10, 100)], "row_no long, utc long")
    later = {r.row_no: r.near_utc for r in J.next_record(targets, records).collect()}
    earlier = {r.row_no: r.near_row_no for r in J.previous_record(targets, records).collect()}
    assert later == {1: 50, 5: 50, 9: 100, 12: None} and earlier == {1: None, 5: 5, 9: 8, 12: 10}
    notarized = spark.createDataFrame([("l", "c", r, u) for r, u in [(1, 10), (2, 9), (3, 30), (4, 30), (5, 40), (5, 35), (6, 50)]], "ledger_id string, chain_id string, row_no long, utc long")
    assert [(r.row_no, r.utc) for r in J.notary_monotone(notarized).orderBy("row_no").collect()] == [(2, 9), (4, 30), (5, 35), (6, 50)]
    with pytest.raises(ValueError):
        J.with_epoch_seed(targets, [(2, b"a")])
    seeds = J.with_epoch_seed(targets, [(9, b"b"), (1, b"a")]).collect()
    assert [bytes(r.seed) for r in sorted(seeds)] == [b"a", b"a", b"b", b"b"]


def test_queries(spark):
    df = spark.createDataFrame([(1, 7, 2.5, "x"), (2, None, 4.0, "y"), (3, -7, None, "z")], "row_no long, n long, d double, s string")
    cells = ["n", "d", "s"]
    ids = lambda q, **a: [r.row_no for r in q.select(df, cells, a).orderBy("row_no").collect()]
    whole = Q.Query(Q.Compare(Q.RowFunc((1,), Q.Apply("/", (Q.Slot(0), 2))), "=", Q.Param("x")))
    assert ids(whole, x=3) == [1] and ids(whole, x=-3) == [3]
    assert ids(Q.Query(Q.Compare(5, ">", Q.RowFunc((2,))))) == [1, 2]
    assert ids(Q.Query(Q.Compare(Q.RowFunc((3,)), ">", 0))) == [] and ids(Q.Query(Q.Compare(Q.RowFunc((9,)), "<=", 0))) == []
    assert ids(Q.Query(Q.Compare(Q.RowFunc((0,)), ">=", Q.Param("lo", 2)))) == [2, 3]
    for bad in (lambda: Q.Query(Q.Branch("AND", (Q.Compare(Q.RowFunc((1,)), "<", Q.Param("a")), Q.Compare(Q.RowFunc((1,)), ">", Q.Param("a"))))), lambda: Q.Compare(1, "=", 2), lambda: Q.Compare(Q.RowFunc((1,)), "<>", 2), lambda: Q.Branch("AND", (1,)), lambda: Q.Apply("-", (1, 2, 3))):
        with pytest.raises(ValueError):
            bad()
    with pytest.raises(ValueError):
        ids(whole)
    bound = Q.bind(Q.Apply("-", (Q.Slot(0), Q.Apply("*", (Q.Slot(1), Q.Slot(2))))), {1: 2})
    assert Q.slots(bound) == 2 and ids(Q.Query(Q.Compare(Q.RowFunc((2, 1), bound), "<", 0))) == [1]
    spec = {"objRefs": {"inputs": {"p": {"type": "number", "default": 7}}}, "query": {"predTree": {"rowPredicate": {"leftFunc": {"funcRowCols": [{"idx": 0, "rcn": 1}], "func": {"args": [{"idx": 1, "val": 1}], "func": {"op": "*", "sub": [{"val": "arg"}, {"val": "arg"}]}}}, "op": "=", "rightNum": {"arg": "p"}}}}}
    assert ids(Q.parse_query(json.dumps(spec))) == [1] and ids(Q.parse_query(Q.query_json(Q.parse_query(json.dumps(spec))))) == [1]
    tree = Q.Query(Q.Branch("OR", (Q.Compare(Q.RowFunc((2, 1), bound), "<", Q.Param("hi", 0)), Q.Branch("AND", (Q.Compare(3, "=", Q.RowFunc((0,))), Q.Compare(Q.RowFunc((1,)), "<", 0))))))
    again = Q.parse_query(Q.query_json(tree))
    assert again.params == tree.params and ids(again) == ids(tree) == [1, 3]
    shown = spark.range(1).select(Q.formatted("number", F.lit(1234.5), pattern="#,##0.00"), Q.formatted("number", F.lit(0.25), pattern="0.###"), Q.formatted("date", F.lit(0), pattern="yyyy-MM-dd", prefix="<", postfix=">")).first()
    assert tuple(shown) == ("1,234.50", "0.25", "<1970-01-01>")
    assert Q.total(df, cells, 2).first().total == 6 and Q.total(df, cells, 2, truncate=False).first().total == 6.5
    assert Q.total(df, cells, 3).first().total is None and Q.total(df.where("d is null"), cells, 2).first().total is None


LOG = "# title\n\nfirst line here\n  \n#note\nsecond\tline\n# x\r\nthird"


def test_logs(spark, tmp_path):
    (tmp_path / "a.log").write_bytes(LOG.encode())
    found = logs.lines(logs.read_log(spark, str(tmp_path))).orderBy("line_no").collect()
    split = LOG.split("\n")
    assert [r.line for r in found] == split and found[-1].offset + found[-1].size == len(LOG)
    assert all(LOG.encode()[r.offset : r.offset + r.size].rstrip(b"\n").decode() == r.line for r in found)
    texts = spark.createDataFrame([("a", LOG)], "ledger_id string, content string")
    count = lambda **g: logs.rows(logs.lines(texts), logs.Grammar(**g)).count()
    assert (count(skip_blank=False), count(), count(comment="#"), count(comment="# ")) == (8, 6, 3, 4)
    assert count(comment_pattern="^#|line") == 1
    rows = logs.rows(logs.lines(texts), logs.Grammar(comment="#"))
    tokens = logs.token_cells(rows).orderBy("row_no", "idx").collect()
    assert [(r.row_no, bytes(r.data).decode()) for r in tokens] == [(1, "first"), (1, "line"), (1, "here"), (2, "second"), (2, "line"), (3, "third")]
    other = logs.token_cells(rows, logs.Grammar(comment="#", delimiters=" ")).where("row_no = 2").collect()
    assert [bytes(r.data) for r in other] == [b"second\tline\n"]
    cell = lambda t: sha(b"\1" + t)
    hashes = {r.row_no: bytes(r.input_hash) for r in logs.input_hashes(rows).collect()}
    assert hashes == {1: sha(cell(b"first") + cell(b"line") + cell(b"here")), 2: sha(cell(b"second") + cell(b"line")), 3: cell(b"third")}
    with pytest.raises(Exception, match="too long"):
        logs.lines(texts, max_bytes=5).collect()
    assert logs.journal(texts).count() == 5


def test_sql_sources(spark):
    spark.createDataFrame([(3, "c"), (1, "a"), (2, "b")], "id long, s string").createOrReplaceTempView("t_src")
    ledger = sql.sql_ledger(spark, "SELECT id, s FROM t_src WHERE id >= :lo", ["id"], args={"lo": 2})
    assert sorted(map(tuple, ledger.select("id", "s", "row_no").collect())) == [(2, "b", 1), (3, "c", 2)]
    assert sql.point_query(spark, "SELECT s, '?' q FROM t_src WHERE id = ?", 2).first() == ("b", "?")
    with pytest.raises(ValueError):
        sql.check_query("SELECT 1", 1)
    with pytest.raises(TypeError):
        sql.sql_ledger(spark, "SELECT 1L row_no, 1.5D x")
    assert sql.tables(spark, "^t_src$").count() == 1
    keys = spark.createDataFrame([("a", "b"), ("c", "a")], "from_table string, to_table string")
    assert {(r.name, r.side) for r in sql.neighbours(keys, "a").collect()} == {("b", "referred"), ("c", "dependent")}
    assert dict(sql.column_classes(ledger)) == {"id": "number", "s": "text", "row_no": "number"}


def test_registry(spark, tmp_path):
    reg = Registry(spark, f"file://{tmp_path}/reg", Rights(delete=True))
    a, b = reg.create("one", uri="u:1"), reg.create("two")
    with pytest.raises(ValueError):
        reg.create("one")
    reg.update(b, description="d", name="second")
    assert [(r.chain_id, r.name, r.description) for r in reg.chains().collect()] == [(a, "one", ""), (b, "second", "d")]
    reg.define(a, "SELECT max(n) FROM t", "SELECT * FROM t WHERE n = ?", (0, 2))
    with pytest.raises(ValueError):
        reg.define(a, "SELECT 1", "SELECT ?")
    with pytest.raises(ValueError):
        reg.define(b, "SELECT ?", "SELECT ?")
    reg.add_epoch(a, 1)
    reg.add_epoch(a, 50)
    with pytest.raises(ValueError):
        reg.add_epoch(a, 50)
    assert [e[0] for e in reg.epochs(a)] == [1, 50]
    assert [(r.name, r.defined, r.epochs) for r in reg.states().orderBy("chain_id").collect()] == [("one", True, 2), ("second", False, 0)]
    reg.delete(a)
    assert reg.find(chain_id=a).count() == 0 and reg.table("chains").count() == 2
    with pytest.raises(PermissionError):
        Registry(spark, reg.path, Rights(write=False)).create("x")
    with pytest.raises(PermissionError):
        Registry(spark, reg.path).delete(b)


def test_archives(spark, tmp_path):
    _, df = inputs_of(spark, {"a": 9})
    chain = H.work.written(H.fold(df), "chain")
    codecs.write_archive(f"file://{tmp_path}/arc", commits=chain)
    back = codecs.read_archive(spark, f"file://{tmp_path}/arc")
    assert list(back) == ["commits"] and H.verify(back["commits"]).where("not ok").count() == 0
    (tmp_path / "p.pack").write_bytes(codecs.write_path_pack(P.state_path(chain)))
    packs = codecs.read_packs(spark, str(tmp_path / "p.pack"))
    assert P.verify_paths(packs).first().ok
