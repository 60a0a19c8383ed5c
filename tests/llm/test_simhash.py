import random
import re

import pytest
import xxhash

from chainlake.llm import simhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_fingerprint(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = WORD.findall(low)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or [" ".join(words)]
    hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(fps, distance=4):
    root = {f: f for f in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    fps = sorted(root)
    for i, a in enumerate(fps):
        for b in fps[i + 1 :]:
            if (a ^ b).bit_count() <= distance:
                root[find(a)] = find(b)
    return {f: find(f) for f in fps}


def expected(rows):
    prints = [(i, plain_fingerprint(t)) for i, t in rows]
    roots = plain_components({f for _, f in prints})
    least = {}
    for i, f in prints:
        if i is not None:
            least[roots[f]] = min(least.get(roots[f], i), i)
    return sorted((str(i), f"{f:016x}", least.get(roots[f])) for i, f in prints)


def got(spark, rows, **options):
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, fp string")
    found = simhash.near_duplicates(docs, **options).collect()
    return sorted((str(r.doc_id), f"{r.fp & (1 << 64) - 1:016x}", r.component_id) for r in found)


def texts(n, seed):
    rng = random.Random(seed)
    out = []
    for g in range(n):
        words = [f"w{rng.randrange(500)}" for _ in range(rng.randrange(3, 400))]
        for _ in range(rng.randrange(1, 5)):
            copy = words[:]
            for _ in range(rng.randrange(0, 3)):
                copy[rng.randrange(len(copy))] = f"v{rng.randrange(500)}"
            out.append(" ".join(copy))
    return list(enumerate(out))


def test_against_brute_force(spark):
    rows = texts(60, 1)
    assert got(spark, rows) == expected(rows)


def test_crowded_keys_are_divided_and_lose_no_link(spark):
    rows = texts(60, 2)
    assert got(spark, rows, crowd=1) == expected(rows)


def test_documents(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert got(spark, rows) == expected(rows)


def test_defined_cases(spark):
    rows = [(5, None), (3, ""), (None, " \n"), (1, "One two"), (1, "one TWO"), (2, "ÀB c"), (7, "a b c d e\x1ff"), (None, "lone words here that no other text has")]
    assert got(spark, rows) == expected(rows)
    assert got(spark, []) == []


@pytest.mark.parametrize("bits", [0, 1, 2, 3, 4])
def test_every_pair_at_up_to_four_bits_shares_a_key(spark, bits):
    rng = random.Random(bits)
    pairs = []
    for _ in range(40):
        a = rng.getrandbits(64)
        b = a
        for bit in rng.sample(range(64), bits):
            b ^= 1 << bit
        pairs.append((a, b))
    signed = lambda x: x - (x >> 63 << 64)
    fps = spark.createDataFrame([(signed(x),) for p in pairs for x in set(p)], "fp long").distinct()
    for crowd in (1, 1000):
        found = {(r.a, r.b) for r in simhash.links_between(fps, crowd=crowd).collect()}
        assert found == ({tuple(sorted(map(signed, p))) for p in pairs} if bits else set())
