import random
import re

from chainlake.llm import lines

PIECE = re.compile(r"([^\x20\x09-\x0D]+)([\x20\x09-\x0D]*)")


def plain(rows, run):
    """rows: distinct (doc_id, text) in order. The text left of each, whether all its words went, runs and words removed."""
    seen, out = set(), {}
    for i, text in rows:
        if text is None:
            out[i] = (None, False, 0, 0)
            continue
        pieces = PIECE.findall(text)
        words, gone = [w for w, _ in pieces], set()
        for k in range(len(words) - run + 1):
            window = tuple(words[k : k + run])
            if window in seen:
                gone |= set(range(k, k + run))
            seen.add(window)
        left, n_runs, k = [re.match(r"[\x20\x09-\x0D]*", text)[0]], 0, 0
        while k < len(words):
            if k in gone:
                n_runs += 1
                while k in gone:
                    k += 1
                continue
            end = k + 1
            while end in gone:
                end += 1
            space = pieces[k][1] if end == k + 1 or "\n" in pieces[k][1] else pieces[end - 1][1]
            left.append(words[k] + space)
            k += 1
        out[i] = ("".join(left), 0 < len(words) == len(gone), n_runs, len(gone))
    return out


def got(spark, rows, run, gram=4):
    docs = spark.createDataFrame([(i, t, "h", 3, "x", 4.5) for i, t in rows], "doc_id long, text string, key string, runs int, row string, `f.g` double").repartition(3)
    found = lines.drop_repeated_runs(docs, run, gram)
    assert found.columns == ["row", "n_runs", "n_removed", "emptied"]
    assert found.select("row.*").columns == docs.columns
    return [(r.row.doc_id, r.row.text, r.emptied, r.n_runs, r.n_removed) for r in found.collect()]


def test_many_documents_with_runs(spark, monkeypatch):
    """The joins beyond each of the bounds of a broadcast give the same."""
    rows = made(60, 9)
    want = plain(rows, 10)
    for bounds in ((0, 10**6), (0, 0)):
        monkeypatch.setattr(lines, "BROADCAST_ROWS", bounds[0])
        monkeypatch.setattr(lines, "KEYS", bounds[1])
        assert {(i, *want[i]) for i in want} == set(got(spark, rows, 10))


def made(n, seed):
    """Texts with passages that begin and end anywhere in a line, and words that recur often."""
    rng = random.Random(seed)
    passages = [[f"p{rng.randrange(30)}" for _ in range(rng.randrange(5, 60))] for _ in range(9)]
    passages += [["same"] * 90, ["one"] * 14, ["x", "y", "z"] * 5]
    rows = []
    for i in range(n):
        words = []
        for _ in range(rng.randrange(0, 9)):
            part = rng.choice(passages) if rng.random() < 0.5 else [f"w{rng.randrange(9999)}" for _ in range(rng.randrange(0, 30))]
            a = rng.randrange(0, 6)
            words += part[a : len(part) - rng.randrange(0, 6)]
        rows.append((i, rng.choice(["", " ", "\n "]) + "".join(w + rng.choice([" ", " ", " ", "\n", " \n\t", "  "]) for w in words)))
    return rows


def test_against_brute_force(spark):
    rows = made(150, 1)
    for run, gram in ((10, 4), (20, 16), (7, 7), (5, 1)):
        want = plain(rows, run)
        assert {(i, *want[i]) for i in want} == set(got(spark, rows, run, gram))
        assert sum(n for _, _, _, n in want.values()) > 500


def test_defined_cases(spark):
    long = "\n".join(f"line {k} with five words" for k in range(30))
    rows = [(1, long), (2, None), (3, ""), (4, long + "\nnew"), (5, "x\n" + long.replace("line", " line")), (6, "only these"), (6, "only these"), (7, ("again and again it is said\n" * 4000)), (8, " \n"), (None, "before " + long + " after")]
    want = plain(rows[:6] + rows[7:], 50)
    found = got(spark, rows, 50, 16)
    assert {(i, *want[i]) for i in want} == set(found) and len(found) == len(rows)
    assert want[4][0] == "new" and want[None][0] == "before after" and want[5][0] == "x\n " and want[7][3] == 23994
    assert got(spark, [], 50) == []


def test_runs_are_aligned(spark):
    """Parts that stand in several earlier documents, but never one after another, are no run."""
    part = lambda x, n: " ".join(f"{x}{k}" for k in range(n))
    rows = [(1, part("a", 30) + " x"), (2, part("b", 30) + " y"), (3, part("a", 30) + " " + part("b", 30)), (4, "z " + part("a", 30) + " " + part("b", 25))]
    found = {r[0]: r for r in got(spark, rows, 50, 16)}
    assert found[3][1] == rows[2][1] and found[3][4] == 0
    assert found[4][1] == "z" and found[4][4] == 55


def test_words_are_hashed_alike_wherever_they_stand(monkeypatch):
    hashes = lines.Hashes(5, 2)
    words = ["a", "b", "ab", "é", "a" * 3000, "日本", "x\x00y"]
    of = {w: int(hashes.of(w.encode())[0]) for w in words}
    assert len(set(of.values())) == len(words)
    rng = random.Random(1)
    text = [rng.choice(words) for _ in range(500)]
    raw = "".join(w + rng.choice([" ", "\n", "\t \x0b", "\r\n"]) for w in text).encode()
    for part in (1 << 20, 4000, 10):
        monkeypatch.setattr(lines, "PART", part)
        assert hashes.of(raw).tolist() == [of[w] for w in text] and len(hashes.of(b" \n ")) == 0


def test_equal_windows_have_equal_fingerprints(spark):
    rows = made(80, 5)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    of = {}
    for r in lines.segments(docs, 10, 4).collect():
        words = [w for w, _ in PIECE.findall(dict(rows)[r.doc_id])]
        for k in range(r.a, r.b + 1):
            assert of.setdefault(tuple(words[k : k + 10]), r.f) == r.f
    assert len(of) == len({tuple(w[k : k + 10]) for _, t in rows for w in [[x for x, _ in PIECE.findall(t)]] for k in range(len(w) - 9)})


def test_segments_are_native_and_cover_each_window_once(spark):
    """No Python on the executors, and the windows of a text fall into segments without gaps; a text of one word makes one a place."""
    rows = [*made(40, 7), (900, "one " * 70), (901, " \n\t" * 60), (902, "\x0b".join(f"w{k % 13}" for k in range(120)) + "\r")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for run, gram in ((50, 16), (10, 4), (7, 7)):
        of = {}
        for r in sorted(lines.segments(docs, run, gram).collect(), key=lambda r: (r.doc_id, r.a)):
            assert r.a == of.get(r.doc_id, -1) + 1 and r.b >= r.a
            of[r.doc_id] = r.b
        assert of == {i: len(w) - run for i, w in ((i, PIECE.findall(t)) for i, t in rows) if len(w) >= run}
    plans = []
    kept, lines.cut = lines.cut, lambda df, name: plans.append(df._jdf.queryExecution().executedPlan().toString()) or kept(df, name)
    try:
        lines.repeated_runs(docs)
    finally:
        lines.cut = kept
    assert len(plans) > 5 and not [p for p in plans if "Arrow" in p or "Python" in p]
