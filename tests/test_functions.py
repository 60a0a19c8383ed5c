import hashlib
from datetime import date, datetime, timezone
from decimal import Decimal

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from chainlake.functions import cells as C
from chainlake.functions import merkle
from chainlake.functions import rownumbers as R

sha = lambda b: hashlib.sha256(b).digest()


def test_cell_bytes(spark):
    values = [0, 1, -1, 127, 128, -128, -129, 255, 32768, -32768, -32769, 10**12, -(10**13)]
    decimals = [Decimal(v) / Decimal(10**s) for v in values for s in (0, 1, 4)] + [Decimal("100"), Decimal("1234567.89"), Decimal("-99999999999.9999"), Decimal("0.0001"), Decimal("99999999999999.9999"), None]
    df = spark.createDataFrame([(d, d) for d in decimals], "d decimal(18,4), w decimal(30,4)")
    out = df.select("d", C.typed(F.col("d"), df.schema["d"].dataType)[1].alias("x"), C.typed(F.col("w"), df.schema["w"].dataType)[1].alias("y")).collect()
    for r in out:
        want = C.NULL_BYTES if r.d is None else C.big_decimal(str(r.d))
        assert bytes(r.x) == want and bytes(r.y) == want
    assert C.big_decimal("1.50") == b"\x01\x0f" and C.big_decimal("100") == b"\xfe\x01" and C.big_decimal("0.00") == b"\0\0" and C.big_decimal("-1") == b"\0\xff"


@given(st.integers(-(10**40), 10**40))
def test_big_integers(n):
    data = C.big_integer(n)
    assert int.from_bytes(data, "big", signed=True) == n
    assert len(data) == 1 or int.from_bytes(data[1:], "big", signed=True) != n


def test_cells_against_hashlib(spark):
    rows = [(1, "é", True, date(2024, 1, 2), datetime(1969, 12, 31, 23, 59, 59, 999000), b"\1" * 32, b"ab"), (2, None, None, None, None, None, None)]
    df = spark.createDataFrame(rows, "row_no long, s string, b boolean, d date, t timestamp_ntz, h binary, x binary")
    names = ["row_no", "s", "b", "d", "t", "h", "x"]
    be = lambda n: n.to_bytes(8, "big", signed=True)
    millis = int(datetime(2024, 1, 2, tzinfo=timezone.utc).timestamp() * 1000)
    want = [(2, be(1)), (1, "é".encode()), (6, b"\1"), (5, be(millis)), (5, be(-1)), (8, b"\1" * 32), (7, b"ab")]
    seed = b"s" * 32
    salted = df.withColumn("salt", C.row_salt(F.lit(seed), F.col("row_no")))
    for scheme in (C.NO_SALT, C.SALT_ALL, C.SaltScheme((1, 3)), C.SaltScheme((0,), False)):
        for r in salted.select("row_no", F.array(*C.cells_of(salted, names, scheme, "salt")).alias("cs")).collect():
            row_salt = sha(be(r.row_no) + seed + be(~r.row_no))
            for i, c in enumerate(r.cs):
                code, data = want[i] if r.row_no == 1 else ((2, be(2)) if i == 0 else (0, bytes(5)))
                salt = sha(be(i) + row_salt + be(~i)) if scheme.salted(i) else b""
                assert (c.type, bytes(c.data), bytes(c.hash)) == (code, data, sha(salt + bytes([code]) + data))
                assert bytes(c.salt or b"") == salt


@pytest.mark.parametrize("kind", ["float", "double", "array<int>", "map<string,int>", "struct<a:int>"])
def test_what_is_no_cell(spark, kind):
    df = spark.createDataFrame([], f"x {kind}")
    with pytest.raises(TypeError):
        C.typed(F.col("x"), df.schema["x"].dataType, "x")


def test_row_hashes(spark):
    hs = [sha(bytes([i])) for i in range(3)]
    df = spark.createDataFrame([(hs,), (hs[:1],), ([],)], "hs array<binary>")
    got = [bytes(r[0]) for r in df.select(C.row_hash_of_array(F.col("hs"))).collect()]
    assert got == [sha(b"".join(hs)), hs[0], bytes(32)]


def test_skip_counts_and_known_stitches():
    assert [R.skip_count(r) for r in range(1, 18)] == [1, 2, 1, 3, 1, 2, 1, 4, 1, 2, 1, 3, 1, 2, 1, 5, 1]
    assert R.coverage([16]) == [0, 8, 12, 14, 15, 16]
    assert len(R.skip_path(1, 1230)) == 16
    with pytest.raises(ValueError):
        R.skip_count(0)


@given(st.integers(0, 5000), st.integers(0, 5000))
def test_skip_paths(a, b):
    low, high = min(a, b), max(a, b)
    path = R.skip_path(low, high)
    assert path[0] == low and path[-1] == high
    assert all(R.linked(x, y) >= 0 for x, y in zip(path, path[1:]))
    # shortest: breadth first over pointers
    layer, steps = {high}, 0
    while low not in layer:
        layer, steps = {p for r in layer if r for p in R.pointers(r) if p >= low}, steps + 1
    assert steps == len(path) - 1


@given(st.lists(st.integers(1, 3000), min_size=1, max_size=8))
def test_stitching(rows):
    whole = R.stitch(rows)
    assert set(rows) <= set(whole) and all(R.linked(a, b) >= 0 for a, b in zip(whole, whole[1:]))
    short = R.stitch_compress(whole)
    assert set(short) <= set(whole) and R.stitch(short) == whole
    assert R.stitch_within(rows, whole) is not None
    assert set(R.reference_only(whole)).isdisjoint(whole)


def test_stitch_within_known_rows():
    assert R.stitch_within([256, 513], [256, 512, 513]) == [256, 512, 513]
    assert R.stitch_within([500, 512], [500, 504, 512]) == [500, 504, 512]
    assert R.stitch_within([500, 512], [500, 512]) is None
    assert R.stitch_within([1, 4], [1, 3, 4, 2]) == [1, 2, 4]


def test_expressions_equal_functions(spark):
    rows = [1, 2, 3, 7, 8, 12, 1023, 1024, 1025, 1230, 2**40, 2**40 + 6, 2**62]
    df = spark.createDataFrame([(a, b) for a in rows for b in rows], "low long, high long")
    one = df.select("high", R.skip_count_col(F.col("high")).alias("n"), R.pointers_col(F.col("high")).alias("p"), R.frontier_col(F.col("high")).alias("f")).distinct()
    for r in one.collect():
        assert (r.n, r.p, r.f) == (R.skip_count(r.high), R.pointers(r.high), R.frontier_rows(r.high))
    for r in df.select("low", "high", R.linked_col(F.col("low"), F.col("high")).alias("k")).collect():
        assert r.k == R.linked(r.low, r.high)
    for r in df.where("low <= high").select("low", "high", R.skip_path_col(F.col("low"), F.col("high")).alias("p")).collect():
        assert r.p == R.skip_path(r.low, r.high)


def test_merkle(spark):
    def recursive(xs):
        if len(xs) == 1:
            return sha(b"\0" + xs[0])
        k = 1 << (len(xs) - 1).bit_length() - 1
        return sha(b"\1" + recursive(xs[:k]) + recursive(xs[k:]))

    lists = [[sha(bytes([i, n])) for i in range(n)] for n in (*range(1, 18), 33, 63, 64)]
    for xs in lists:
        assert merkle.root(xs) == recursive(xs)
        for i, x in enumerate(xs):
            proof = merkle.funnel(xs, i)
            assert merkle.root_from(x, i, len(xs), proof) == recursive(xs)
            assert len(proof) == len(xs) - 1 if len(xs) < 3 else len(proof) <= 6
    df = spark.createDataFrame([(xs,) for xs in lists], "hs array<binary>").withColumn("root", merkle.root_col(F.col("hs")))
    assert all(bytes(r.root) == recursive([bytes(h) for h in r.hs]) for r in df.collect())


@given(st.integers(1, 1 << 20))
def test_funnel_lengths(row):
    leaves = [bytes([i]) for i in range(R.skip_count(row))]
    assert all(R.funnel_length(row, k) == len(merkle.funnel(leaves, k)) for k in range(len(leaves)))


def test_older_cells(spark):
    import struct

    from chainlake.functions import cells05 as OLD

    df = spark.createDataFrame([(1, "é", 2.5, b"xy", -3), (2, None, None, None, None)], "row_no long, s string, d double, b binary, n int")
    names, seed = ["s", "d", "b", "n"], b"z" * 32
    for r in OLD.with_input_hash(OLD.with_input_hash(df, names), names, seed=seed, name="salted").collect():
        own = [sha(struct.pack(">i", len(x)) + x) for x in ("é".encode(), b"xy")]
        plain = [own[0], sha(struct.pack(">d", 2.5)), own[1], sha(struct.pack(">q", -3))] if r.row_no == 1 else [bytes(32)] * 4
        salted = [sha(sha(seed + struct.pack(">qq", r.row_no, i)) + h) for i, h in enumerate(plain, 1)]
        assert bytes(r.input_hash) == sha(b"".join(plain)) and bytes(r.salted) == sha(b"".join(salted))
    one = OLD.with_input_hash(df.select("row_no", "n"), ["n"]).where("row_no = 1").first()
    assert bytes(one.input_hash) == sha(sha(struct.pack(">q", -3)))
