import math
import random
import re
from collections import Counter

import numpy as np

from chainlake.llm import quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_base(text):
    words = WORD.findall(text or "")
    seen = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    covered = {j for i in range(len(words) - 2) if seen[tuple(words[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    n = len(words)
    stats = (n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered))
    return (*stats, n < 50 or 100 * len(covered) > 50 * n)


def vector(b):
    return [math.floor(math.sqrt(x / b[0]) * 1000 + 0.5) for x in (b[1], b[2], b[3], b[4])]


def plain_starts(x):
    lower = lambda a: np.sort(a, axis=0)[math.ceil(len(a) / 2) - 1]
    floors = np.diag(np.square(quality.FLOORS))
    median = lower(x)
    scale = np.sqrt((lower(abs(x - median)) * 1.4826) ** 2 + np.square(quality.FLOORS))
    z = (x - median) / scale
    norm = np.sqrt((z * z).sum(axis=1, keepdims=True))
    whole = lambda v: np.floor(v * 1000 + 0.5)
    cut, way = whole(np.clip(z, -2, 2)), whole(np.divide(z, norm, out=np.zeros_like(z), where=norm > 0))
    yield median, np.diag(scale**2)
    mean = x.mean(axis=0)
    yield mean, (x.T @ x) / len(x) - np.outer(mean, mean) + floors
    for v in (cut, way):
        yield median, (v.T @ v) / len(x) / 1e6 * np.outer(scale, scale) + floors


def plain_estimate(x):
    x = np.array(x, float)
    ends = []
    for k, (mean, cov) in enumerate(plain_starts(x)):
        last = None
        while True:
            step = np.floor(np.sqrt(distance(x, mean, cov)) * 64)
            core = x[step <= np.sort(step)[math.ceil(quality.H * len(x)) - 1]]
            now = core.mean(axis=0)
            new = ((core.T @ core) / len(core) - np.outer(now, now)) * quality.CONSISTENCY + np.diag(np.square(quality.FLOORS))
            det = np.linalg.det(new)
            if last is not None and not det < last * (1 - quality.LEAST_FALL):
                break
            mean, cov, last = now, new, det
        ends.append((last, k, mean, cov))
    return min(ends, key=lambda e: e[:2])[2:]


def distance(x, mean, cov):
    d = x - mean
    return np.einsum("ij,jk,ik->i", d, np.linalg.inv(cov), d)


def plain(rows, min_group, cutoff=quality.CUTOFF):
    base = [plain_base(r[1]) for r in rows]
    ok = [i for i, b in enumerate(base) if not b[5]]
    by = {}
    for i in ok:
        for g in ((rows[i][2], rows[i][3]), (rows[i][2],), ()):
            by.setdefault(g, []).append(vector(base[i]))
    kept = [False] * len(rows)
    for i in ok:
        g = next(g for g in ((rows[i][2], rows[i][3]), (rows[i][2],), ()) if g == () or len(by[g]) >= min_group)
        mean, cov = plain_estimate(by[g])
        kept[i] = bool(distance(np.array([vector(base[i])], float), mean, cov)[0] <= cutoff)
    return sorted((str(r[0]), *b, k) for r, b, k in zip(rows, base, kept))


def made(n, seed):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choices("abcdeéü", k=rng.randrange(2, 9))) for _ in range(400)]
    rows = []
    for i in range(n):
        words = rng.choices(vocabulary, k=rng.randrange(1, 300))
        kind = rng.randrange(9)
        if kind == 0:
            words = [w + rng.choice("#$%") * 2 for w in words]
        if kind == 1:
            words = words[:20] * 8
        text = "".join(w + rng.choice("      \n\t\x0b") for w in words)
        if kind == 2:
            text += "\nsame line\n" * 9
        rows.append((i, text, rng.choice(["en", "de", None]), rng.choice(["a", "a", "b", None])))
    return rows


def got(spark, rows, **options):
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, lang string, source string, n_words int")
    cols = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
    return sorted((str(r.doc_id), *(r[c] for c in cols)) for r in quality.judge_quality(docs, **options).collect())


def test_against_brute_force(spark):
    rows = made(400, 1)
    want = plain(rows, 40)
    assert got(spark, rows, min_group=40) == want
    assert {r[-1] for r in want if not r[-2]} == {True, False}


def test_defined_cases(spark):
    rows = made(60, 2) + [(None, None, None, None), (7, "", "en", "a"), (7, "", "en", "a"), (8, "x " * 40, None, "z"), (9, "long " + "word " * 20000, "en", "b")]
    assert got(spark, rows) == plain(rows, 100)
    assert got(spark, []) == []


def test_labelled_documents(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    judged = {r.doc_id: r for r in quality.judge_quality(docs).collect()}
    labels = spark.read.parquet(f"{sf}/labels.parquet").collect()
    clean = [judged[x.doc_id] for x in labels if x.quality == 1 and judged[x.doc_id].n_words >= 50]
    assert all(r.kept for r in clean)
    junk = [judged[x.doc_id] for x in labels if x.quality == 0]
    assert sum(not r.kept for r in junk) >= 0.9 * len(junk)
