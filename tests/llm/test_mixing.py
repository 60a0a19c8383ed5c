import hashlib
import random
import re
from collections import defaultdict

from chainlake.llm import mixing

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def targets(sizes, budget):
    """By raising the level until the budget is met: sizes in order of sources."""
    weights = [(5, 2, 1)[i % 3] for i in range(len(sizes))]
    lo, hi = 0.0, 4.0 * sum(sizes) + 1
    for _ in range(200):
        level = (lo + hi) / 2
        if sum(min(2 * s, level * w) for s, w in zip(sizes, weights)) < budget:
            lo = level
        else:
            hi = level
    return [min(2 * s, hi * w) for s, w in zip(sizes, weights)]


def got(spark, rows):
    docs = spark.createDataFrame([(*r, 7.0) for r in rows], "doc_id long, text string, source string, target double").repartition(3)
    return mixing.mix_sources(docs).collect()


def check(rows, found):
    size = lambda t: len(WORD.findall(t or ""))
    names = sorted({r[2] for r in rows if r[2] is not None}) + [None] * any(r[2] is None for r in rows)
    sizes = [sum(size(r[1]) for r in rows if r[2] == s) for s in names]
    want = dict(zip(names, targets(sizes, 1.5 * sum(sizes))))
    taken, longest = defaultdict(int), max([size(r[1]) for r in rows], default=0)
    for r in found:
        assert abs(r.target - want[r.source]) <= 1e-6 * max(1, want[r.source])
        assert r.taken in (0, r.size, 2 * r.size) and r.source_size == sizes[names.index(r.source)]
        taken[r.source] += r.taken
    assert sorted((str(r.doc_id), r.size) for r in found) == sorted((str(r[0]), size(r[1])) for r in rows)
    for s in names:
        assert abs(taken[s] - want[s]) <= 2 * longest
    assert abs(sum(taken.values()) - 1.5 * sum(sizes)) <= longest


def test_targets_and_taken(spark):
    rng = random.Random(1)
    rows = [(i, "w " * rng.randrange(0, 60), rng.choice(["a", "a", "a", "b", "ü", "Z", "c", None])) for i in range(900)]
    found = got(spark, rows)
    check(rows, found)
    assert sorted(map(str, found)) == sorted(map(str, got(spark, rows)))


def test_the_order_is_the_hash_order(spark):
    rows = [(i, "w " * (1 + i % 7), "a") for i in range(300)]
    found = sorted(got(spark, rows), key=lambda r: hashlib.md5(f"mix:{r.doc_id}".encode()).hexdigest())
    shares = [r.taken // r.size for r in found]
    assert shares == sorted(shares, reverse=True) and set(shares) == {1, 2}


def test_defined_cases(spark):
    for rows in ([], [(1, None, None)], [(1, "", "a"), (2, "x y", "a")], [(None, "x y z", "a"), (None, "x y z", "a"), (3, "x y z", "a"), (3, "x", None)], [(1, "w " * 30000, "a"), (2, "w", "b")]):
        check(rows, got(spark, rows))


def test_hash_ranges_and_rows_agree(spark, monkeypatch):
    rng = random.Random(2)
    rows = [(i, "w " * rng.randrange(0, 30), rng.choice("ab")) for i in range(400)]
    whole = sorted(map(str, got(spark, rows)))
    monkeypatch.setattr(mixing, "RANGE_ROWS", 10)
    assert sorted(map(str, got(spark, rows))) == whole
