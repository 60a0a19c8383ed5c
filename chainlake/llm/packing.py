"""Operator 6: mixture-controlled packing by deficit round-robin.

Every source is a queue of its documents (ids of the whole text, then the end id). In each round a queue's deficit grows by its
quantum, its target share of one window (LENGTH tokens); it serves whole documents while the deficit lasts and carries the
rest on. What is served, round by round and within a round by source, forms one stream, cut every LENGTH tokens: each
window is full, and up to any place a queue has had its target share to within one document, however long. Documents are cut
only where a window ends; only the last window of all is padded. When a queue is empty, rounds go on with the others.

A deficit is the credit of all rounds less all that was served. So a document is served in the first round whose credit
reaches its end in its own queue: round = ceil(end / quantum), which any task finds for its rows alone. The deficits thus
carry over windows, tasks and partitions without a state that is handed on.

Scale: one pass makes the ids and writes them with their offset among their source's tokens of the same task; the sums by
(task, source) are few and give each task's start by a window function. Rounds are dealt into at most about BUCKETS stretches;
sums by stretch give where each begins in the stream. Ids (two bytes a token) are shuffled once, by stretch, sorted by
round, and streamed; a stretch has so many windows' tokens whatever the sources' sizes, so a hot source is spread. A lost
executor's pieces come again from the written ids, the same. Any number of sources is served.

Defined cases: a null or empty text is a document of the end id only; a null source is a source, the last; repeated rows
are documents of their own; null ids are kept; an empty table gives an empty result; other columns are ignored; a text
may be longer than a window, and no length is cut off; a weight below 1e-9 or none counts as that.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chainlake.llm.shared import cut, small, table
from chainlake.llm.tokens import PATTERN, PieceTable, byte_symbols, pieces, vocabulary_path

LENGTH = 2048
END = 1
#: Pieces whose ids a task remembers: some 200 bytes each, beside what other stages' workers hold.
IDS_HELD = 300_000
#: Stretches of rounds, about, and rounds that a stretch has at least.
BUCKETS = 32_768
LEAST_ROUNDS = 64
#: The query's target weights, repeating over the sources by code point, null last.
WEIGHTS = (5, 2, 1)


class Ids:
    """Token ids (uint16 or uint32 bytes) of whole texts, as the vocabulary's library gives them."""

    def __init__(self, path: str):
        import numpy as np
        import tiktoken

        spec = json.load(open(path, encoding="utf-8"))
        self.path, self.library = path, None
        size = 1 + max([*spec["model"]["vocab"].values(), *(t["id"] for t in spec["added_tokens"])])
        self.kind = np.uint16 if size <= 1 << 16 else np.uint32
        self.array = np.array
        self.marks = [t["content"] for t in spec["added_tokens"]]
        vocabulary, back = spec["model"]["vocab"], {s: bytes([b]) for b, s in enumerate(byte_symbols())}
        pairs = ("".join(m if isinstance(m, list) else m.split(" ")) for m in spec["model"]["merges"])
        in_order = [vocabulary[p] for p in pairs]
        self.fast = None
        if in_order == sorted(in_order) and spec["pre_tokenizer"] == {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True} and not spec["normalizer"]:
            # merges are in order of ids, so the faster library's merging by id is the same
            ranks = {b"".join(map(back.__getitem__, s)): i for s, i in vocabulary.items() if all(c in back for c in s)}
            self.fast = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.table = PieceTable(self.raw, IDS_HELD)

    def raw(self, text: str) -> bytes:
        if self.fast is None or any(m in text for m in self.marks):
            if self.library is None:  # most tasks don't need it
                from tokenizers import Tokenizer

                self.library = Tokenizer.from_file(self.path)
            ids = self.library.encode(text, add_special_tokens=False).ids
        else:
            ids = self.fast.encode_ordinary(text)
        return self.array(ids, self.kind).tobytes()

    def of(self, text: str | None) -> bytes:
        if not text:
            return b""
        parts = pieces(text)
        if parts is None:
            return self.raw(text)
        first = parts.pop(0)
        return self.raw(first) + b"".join(map(self.table.__getitem__, parts))


@lru_cache(maxsize=2)
def ids_of(path: str) -> Ids:
    return Ids(path)


def token_table(docs: DataFrame, path: str, end: int = END) -> DataFrame:
    """doc_id, source, task, before (tokens of this source earlier in the task), n, ids of every row, as a written table."""

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext

        ids, task, upto = ids_of(path), TaskContext.get().partitionId(), {}
        ids.table.renew()
        width = np.dtype(ids.kind).itemsize
        last = np.array([end], ids.kind).tobytes()
        for batch in batches:
            out = [ids.of(t.as_py()) + last for t in batch.column(2)]
            before, n = [], [len(b) // width for b in out]
            for s, k in zip(batch.column(1).to_pylist(), n):
                before.append(upto.get(s, 0))
                upto[s] = before[-1] + k
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([task] * len(n), pa.int64()), pa.array(before, pa.int64()), pa.array(n, pa.int64()), pa.array(out, pa.binary())], ["doc_id", "source", "task", "before", "n", "ids"])

    kind = dict(docs.dtypes)["doc_id"]
    chosen = docs.selectExpr("doc_id", "cast(source as string) source", "cast(text as string) text")
    return cut(chosen.mapInArrow(run, f"doc_id {kind}, source string, task long, before long, n long, ids binary"), "pack-ids")


def queues(sums: DataFrame, weights: dict[str | None, float] | tuple[float, ...] | None, length: int) -> DataFrame:
    """source, rank (by code point, null last), total, quantum (tokens a round) of each source; sums: source, n."""
    by_name = Window.orderBy(F.col("source").asc_nulls_last())  # one row a source
    sources = sums.groupBy("source").agg(F.sum("n").alias("total")).withColumn("rank", F.row_number().over(by_name))
    if weights is None:
        weight = F.col("total").cast("double")
    elif isinstance(weights, dict):
        weight = F.lit(1.0)
        for name, w in weights.items():
            weight = F.when(F.col("source").eqNullSafe(F.lit(name)), F.lit(float(w))).otherwise(weight)
    else:
        at = F.pmod(F.col("rank") - 1, F.lit(len(weights))) + 1
        weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), at.cast("int"))
    weighed = sources.withColumn("weight", F.greatest(weight, F.lit(1e-9)))
    quantum = F.lit(float(length)) * F.col("weight") / F.sum("weight").over(Window.partitionBy(F.lit(1)))
    return cut(weighed.select("source", "rank", "total", quantum.alias("quantum")), "pack-sources")


def _cut(batch, length: int, base: int, bucket):
    """The pieces of the documents (doc_id, source, bucket, start of the bucket, n, ids) in order; and where the stream is after them."""
    import zlib

    import numpy as np
    import pyarrow as pa

    of, first, n = (batch.column(i).to_numpy() for i in (2, 3, 4))
    upto = np.cumsum(n)
    fresh = np.ones(len(n), bool)
    fresh[1:] = of[1:] != of[:-1]
    fresh[0] = of[0] != bucket
    # tokens of the same bucket before each document, here and in earlier batches
    head = np.maximum.accumulate(np.where(fresh, np.arange(len(n)), -1))
    place = np.where(head >= 0, first + upto - n - np.where(head >= 0, (upto - n)[head], 0), base + upto - n)
    windows = (place + n - 1) // length - place // length + 1
    row = np.repeat(np.arange(len(n)), windows)
    window = np.arange(len(row)) - np.repeat(np.cumsum(windows) - windows, windows) + (place // length)[row]
    begin = np.maximum(place[row], window * length)
    size = np.minimum((place + n)[row], (window + 1) * length) - begin
    start = begin - place[row]
    held, wide, data, crcs = -1, None, [], []
    for r, s, m in zip(row.tolist(), start.tolist(), size.tolist()):
        if r != held:
            raw = batch.column(5)[r].as_buffer()
            wide, held = np.frombuffer(raw, np.uint16 if len(raw) == 2 * n[r] else np.uint32).astype("<u4"), r
        data.append(wide[s : s + m].tobytes())
        crcs.append(zlib.crc32(data[-1]))
    pick, names = pa.array(row), ["doc_id", "source", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"]
    pieces = [batch.column(0).take(pick), batch.column(1).take(pick), pa.array(start), pa.array(size), pa.array(crcs, pa.int64()), pa.array(n[row]), pa.array(window), pa.array(begin - window * length), pa.array(data, pa.binary())]
    return pa.RecordBatch.from_arrays(pieces, names), int(place[-1] + n[-1]), of[-1]


def pack(docs: DataFrame, *, vocabulary: str | None = None, length: int = LENGTH, weights: dict[str | None, float] | tuple[float, ...] | None = None, buckets: int = BUCKETS) -> DataFrame:
    """Pieces: doc_id, source, start, length, ids_crc32, doc_tokens, sequence_id, offset, ids (32-bit little-endian).

    weights: target proportions of the sources, by name (others weigh 1) or repeating over them in order; none: each source's
    share of all tokens, which empties all queues together.
    """
    ids = token_table(docs, vocabulary or vocabulary_path())
    sums = cut(ids.groupBy("task", "source").agg(F.sum("n").alias("n")), "pack-sums")
    sources = queues(sums, weights, length)
    n_sources = sources.count()
    rounds = sources.agg(F.max(F.ceil(F.col("total") / F.col("quantum")))).first()[0] or 1
    stretch = max(LEAST_ROUNDS if buckets == BUCKETS else 1, -(-rounds // buckets))
    earlier = Window.partitionBy("source").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select("task", "source", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base"))
    named = small(sources.select(F.col("source").alias("name"), "rank", "quantum"), n_sources)
    starts = starts.join(named, F.col("source").eqNullSafe(F.col("name")))
    starts = cut(starts.select(F.struct("task", "source").alias("of"), "rank", "quantum", "base"), "pack-starts")
    placed = ids.withColumn("key", F.struct("task", "source")).join(small(starts, starts.count()), F.col("key") == F.col("of"))
    placed = placed.withColumn("at", F.col("base") + F.col("before"))
    placed = placed.withColumn("round", F.ceil((F.col("at") + F.col("n")) / F.col("quantum")))
    placed = placed.withColumn("bucket", F.floor((F.col("round") - 1) / F.lit(stretch)))
    # one row a stretch
    sizes = placed.groupBy("bucket").agg(F.sum("n").alias("n"))
    first = F.coalesce(F.sum("n").over(Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = cut(sizes.select(F.col("bucket").alias("stretch"), first.alias("first")), "pack-stretches")
    placed = placed.join(small(sizes, sizes.count()), F.col("bucket") == F.col("stretch"))
    served = placed.select("doc_id", "source", "bucket", "first", "n", "ids", "round", "rank", "at").repartition("bucket").sortWithinPartitions("bucket", "round", "rank", "at")

    def run(batches: Iterator) -> Iterator:
        base, bucket = 0, None
        for batch in batches:
            if batch.num_rows:
                pieces, base, bucket = _cut(batch, length, base, bucket)
                yield pieces

    kind = dict(docs.dtypes)["doc_id"]
    return served.mapInArrow(run, f"doc_id {kind}, source string, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary")


def op6_mixture_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), weights=WEIGHTS).drop("ids")


QUERIES = {"op6_mixture_packing": op6_mixture_packing}
SQL: dict[str, str] = {}
