import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

from chainlake.llm import packing, tokens

LIBRARY = Tokenizer.from_file(tokens.vocabulary_path())


def check(rows, got, length=packing.LENGTH):
    """Each id in one piece; crc of the library's ids; sequences gapless and full but the last."""
    want = sorted(np.array(LIBRARY.encode(t or "", add_special_tokens=False).ids + [1], "<u4").tobytes() for _, t, _ in rows)
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in got:
        assert zlib.crc32(r.ids) == r.ids_crc32 and len(r.ids) == 4 * r.length > 0
        by_doc[(str(r.doc_id), str(r.source))].append(r)
        by_sequence[r.sequence_id].append((r.offset, r.length, r.source))
    if len({i for i, _, _ in rows}) == len(rows):
        made = []
        for pieces in by_doc.values():
            pieces.sort(key=lambda r: r.start)
            assert [r.start for r in pieces] == [sum(x.length for x in pieces[:i]) for i in range(len(pieces))]
            assert {r.doc_tokens for r in pieces} == {sum(r.length for r in pieces)}
            made.append(b"".join(r.ids for r in pieces))
        assert sorted(made) == want
    assert sum(len(w) for w in want) == sum(4 * r.length for r in got)
    assert sorted(by_sequence) == list(range(len(by_sequence)))
    for k, pieces in by_sequence.items():
        pieces.sort()
        at = 0
        for offset, n, _ in pieces:
            assert offset == at
            at += n
        assert at == length or k == len(by_sequence) - 1 and at <= length
    return by_sequence


def run(spark, rows, **options):
    docs = spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, text string, source string, length int").repartition(5)
    return packing.pack(docs, **options).collect()


def made(n, seed):
    rng = random.Random(seed)
    return [(i, " ".join(rng.choices(["the", "of", "tion", "\n", "Überall", "<|endoftext|>", " x"], k=rng.randrange(0, 900))), rng.choice(["a", "a", "a", "b", "c", None])) for i in range(n)]


def served(sequences, upto):
    """Tokens by source in the first windows."""
    size = defaultdict(int)
    for k in sorted(sequences)[:upto]:
        for _, n, s in sequences[k]:
            size[s] += n
    return size


def longest(rows):
    return max(len(LIBRARY.encode(t or "", add_special_tokens=False).ids) + 1 for _, t, _ in rows)


@pytest.mark.parametrize("buckets", [packing.BUCKETS, 7, 10_000])
def test_pieces_and_proportions(spark, buckets):
    rows = made(200, 1)
    sequences = check(rows, run(spark, rows, buckets=buckets))
    size = served(sequences, None)
    total, most = sum(size.values()), longest(rows)
    for k in range(1, len(sequences)):
        now = served(sequences, k)
        for s in size:  # a document each of the deficits, and the round that the window cuts
            assert abs(now[s] - size[s] * packing.LENGTH * k / total) <= len(size) * most


def test_weights(spark):
    rows = made(200, 3)
    for weights, want in (({"a": 3, None: 2}, {"a": 3, "b": 1, "c": 1, None: 2}), ((5, 2, 1), {"a": 5, "b": 2, "c": 1, None: 5})):
        sequences = check(rows, run(spark, rows, weights=weights))
        size, most = served(sequences, None), longest(rows)
        k = 1
        # as long as all queues have documents
        while all(sum(served(sequences, k).values()) * w / sum(want.values()) + most < size[s] for s, w in want.items()):
            now = served(sequences, k)
            for s, w in want.items():
                assert abs(now[s] - packing.LENGTH * k * w / sum(want.values())) <= len(want) * most
            k += 1
        assert k > 3


def plain_order(rows, quantum):
    """rows: (key, source rank, tokens) in queue order. Keys in order of a deficit round-robin that keeps its deficits."""
    queues = {s: [r for r in rows if r[1] == s] for s in sorted({r[1] for r in rows})}
    deficit, out = dict.fromkeys(queues, 0), []
    while any(queues.values()):
        for s, queue in queues.items():
            deficit[s] += quantum[s]
            while queue and queue[0][2] <= deficit[s]:
                key, _, n = queue.pop(0)
                deficit[s] -= n
                out.append(key)
    return out


def test_the_order_is_a_deficit_round_robin(spark):
    rows = made(150, 7)
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").coalesce(1)
    pieces = packing.pack(docs, weights=(8, 4, 2, 2)).collect()
    order = sorted((r.sequence_id, r.offset, r.doc_id) for r in pieces if r.start == 0)
    tokens_of, rank = {r.doc_id: r.doc_tokens for r in pieces}, {"a": 0, "b": 1, "c": 2, None: 3}
    queue = [(i, rank[s], tokens_of[i]) for i, _, s in rows]
    assert [i for _, _, i in order] == plain_order(queue, {0: 1024, 1: 512, 2: 256, 3: 256})


@pytest.mark.parametrize("length", [64, 100])
def test_other_lengths(spark, length):
    rows = made(20, 4)
    check(rows, run(spark, rows, length=length), length)


def test_many_sources(spark):
    rows = [(i, "a few words here " * (i % 5), f"source {i % 6000:05d}") for i in range(7000)]
    sequences = check(rows, run(spark, rows, weights={"source 00001": 6000}))
    assert sum(n for _, n, s in sequences[0] if s == "source 00001") > 5


def test_defined_cases(spark):
    rows = [(1, None, None), (2, "", "a"), (None, "x y", "a"), (3, "w " * 30000, "b"), (4, "same", "b"), (4, "same", "b")]
    check(rows, run(spark, rows))
    check(rows, run(spark, rows, weights={"b": 0}))
    assert run(spark, []) == []


def test_ids_are_the_librarys_over_all_characters():
    """Every code point, and every piece of the vocabulary, alone and among others."""
    ids = packing.Ids(tokens.vocabulary_path())
    points = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    texts = ["".join(points[i : i + 512]) for i in range(0, len(points), 512)]
    texts += [" ".join(points[i : i + 512]) for i in range(0, 0x3000, 512)]
    texts += [f"x{c}1 {c}{c}\n" for c in points[:0x3000:7]]
    pieces = sorted(LIBRARY.get_vocab(), key=LIBRARY.get_vocab().get)
    decoded = [LIBRARY.decode([i], skip_special_tokens=False) for i in range(len(pieces))]
    texts += ["".join(decoded[i : i + 300]) for i in range(0, len(decoded), 300)] + [" ".join(decoded[i : i + 300]) for i in range(0, len(decoded), 300)]
    for text, want in zip(texts, LIBRARY.encode_batch(texts, add_special_tokens=False)):
        assert np.frombuffer(ids.of(text), ids.kind).tolist() == want.ids
