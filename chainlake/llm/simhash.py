"""Operator 7: near duplicates by SimHash and deletion-variant signatures.

Fingerprints: the text's A-Z are lower-cased, its words (runs of other than the six ASCII white-space characters) form
4-word shingles, repeats included, joined by one space; a text of fewer words is one shingle. A bit of the fingerprint is
1 if it is set in over half of the shingles' XXH64 values (UTF-8, seed 42). A text without words has fingerprint 0.

Links: two fingerprints link at DISTANCE (4) or fewer differing bits. 64 bits are cut into 3 segments, so one segment
differs by at most one bit. For each segment and each of its bits, a key holds the segment with that bit left out: 64 keys
a fingerprint. Fingerprints that link share a key; all that share one are compared by differing bits.

Scale: exact copies and equal fingerprints are merged first, so a group of copies of any size is one row. Keys are made,
shuffled and counted by Spark's own functions; those of one fingerprint go no further. Members of a key are compared in
blocks of numpy words, and only a forest of links leaves (at most one link a member), never all pairs. A key with more
than CROWD members is divided again in the same way by the rest of its bits, so that no task compares an unbounded group;
what is still large there is compared in blocks all the same. Nothing is capped or dropped. Components come from
alternating large-star and small-star steps, each written to the shared folder; the driver gets counts only.

Defined cases: null and empty texts have fingerprint 0 and link to each other; equal texts have equal fingerprints;
component_id ignores null ids (null if a component has no other); repeated rows are kept, with equal results; an empty
table gives an empty result; columns other than doc_id and text are ignored; texts have no length limit.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chainlake.llm.shared import cut, row_of, table

WORDS = 4
SEED = 42
DISTANCE = 4
#: (first bit, bits) of the three segments.
SEGMENTS = ((0, 22), (22, 21), (43, 21))
CROWD = 20_000
_BLOCK = 1 << 22


def fingerprint(text: str | None, words: int = WORDS) -> int:
    """The unsigned 64-bit fingerprint of a whole text."""
    import numpy as np
    from xxhash import xxh64_intdigest

    parts = (text or "").encode().lower().split()
    if not parts:
        return 0
    whole = b" ".join(parts)
    if len(parts) <= words:
        return xxh64_intdigest(whole, SEED)
    view, starts, at = memoryview(whole), [], 0
    for p in parts:
        starts.append(at)
        at += len(p) + 1
    ends = [s - 1 for s in starts[words:]]
    ends.append(len(whole))
    n = len(ends)
    hashes = np.fromiter((xxh64_intdigest(view[s:e], SEED) for s, e in zip(starts, ends)), np.uint64, n)
    ones = np.zeros(64, np.int64)
    for i in range(0, n, 1 << 16):  # bounded memory for very long texts
        ones += np.unpackbits(hashes[i : i + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """doc_id, text_hash, fp (the fingerprint as a signed long) of every row."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            fps = [fingerprint(t.as_py(), words) for t in batch.column(2)]
            signed = pa.array([f - (f >> 63 << 64) for f in fps], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), signed], ["doc_id", "text_hash", "fp"])

    kind = dict(docs.dtypes)["doc_id"]
    chosen = docs.selectExpr("doc_id", "xxhash64(text) text_hash", "cast(text as string) text")
    return chosen.mapInArrow(run, f"doc_id {kind}, text_hash long, fp long")


def _variants(fp: F.Column, segments) -> list[F.Column]:
    """A key for each segment and bit: the segment without that bit, and which of the 64 it is."""
    keys = []
    for first, bits in segments:
        for bit in range(first, first + bits):
            kept = ((1 << bits) - 1 << first) & ~(1 << bit)
            kept -= (kept >> 63) << 64
            # the kept bits move to the low end, the variant's number above them
            low = F.shiftrightunsigned(fp.bitwiseAND(F.lit(kept).cast("long")), first)
            keys.append(low.bitwiseOR(F.lit(bit << 32).cast("long")))
    return keys


def _thirds(taken: tuple[int, int]) -> list[tuple[int, int]]:
    """Three segments within what the segment `taken` leaves; a segment never crosses it."""
    spans = [(a, b) for a, b in ((0, taken[0]), (taken[0] + taken[1], 64)) if b > a]
    if len(spans) == 1:
        a, b = spans[0]
        third = (b - a + 2) // 3
        return [(x, min(third, b - x)) for x in range(a, b, third)]
    (a, b), (c, d) = spans
    wide, narrow = ((a, b), (c, d)) if b - a >= d - c else ((c, d), (a, b))
    half = (wide[1] - wide[0] + 1) // 2
    return [(wide[0], half), (wide[0] + half, wide[1] - wide[0] - half), (narrow[0], narrow[1] - narrow[0])]


def _forest(fps, distance: int):
    """Links among the distinct fingerprints of one key: each row that is reached, with what it was reached from."""
    import numpy as np

    fps = np.asarray(fps, np.int64).view(np.uint64)
    if len(fps) == 2:
        a, b = int(fps[0]), int(fps[1])
        return [(a, b)] if (a ^ b).bit_count() <= distance else []
    links, rest = [], fps
    while len(rest) > 1:
        todo, rest = [rest[0]], rest[1:]
        while todo and len(rest):
            node = todo.pop()
            near = np.empty(len(rest), bool)
            for i in range(0, len(rest), _BLOCK):
                near[i : i + _BLOCK] = np.bitwise_count(rest[i : i + _BLOCK] ^ node) <= distance
            if near.any():
                reached = rest[near]
                links += [(int(node), int(x)) for x in reached]
                todo += list(reached)
                rest = rest[~near]
    return links


def _compare(distance: int):
    """For rows (key, fp) in order of key: the links within each key."""

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        def rows(links):
            a = np.array([x[0] for x in links], np.uint64).view(np.int64)
            b = np.array([x[1] for x in links], np.uint64).view(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])

        held_key, held = None, []
        for batch in batches:
            if not batch.num_rows:
                continue
            columns = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            keys, fps = columns[:-1], columns[-1]
            new = np.zeros(len(fps) - 1, bool)
            for k in keys:
                new |= k[1:] != k[:-1]
            bounds = [0, *(np.flatnonzero(new) + 1).tolist(), len(fps)]
            links = []
            for lo, hi in zip(bounds, bounds[1:]):
                key = tuple(int(k[lo]) for k in keys)
                if key != held_key:
                    if held:
                        links += _forest(np.concatenate(held), distance)
                    held_key, held = key, []
                held.append(fps[lo:hi])
            if links:
                yield rows(links)
        if held and (links := _forest(np.concatenate(held), distance)):
            yield rows(links)

    return run


def links_between(fps: DataFrame, *, distance: int = DISTANCE, crowd: int = CROWD) -> DataFrame:
    """fps: distinct fp. Links a < b that connect whatever is connected at `distance` or fewer bits."""
    if distance > 5:
        raise ValueError("three segments find up to 5 differing bits")
    keyed = fps.select("fp", F.explode(F.array(*_variants(F.col("fp"), SEGMENTS))).alias("key"))
    shared = keyed.withColumn("members", F.count("*").over(Window.partitionBy("key"))).where("members > 1")
    shared = cut(shared, "shared-keys")  # read once for the small groups and once for the crowds
    pairs = shared.where(F.col("members") <= crowd).select("key", "fp").repartition("key").sortWithinPartitions("key").mapInArrow(_compare(distance), "a long, b long")
    near = cut(pairs.distinct(), "links-near")
    crowded = shared.where(F.col("members") > crowd).select("key", "fp")
    if not crowded.limit(1).count():
        return near
    variant = F.shiftright("key", 32)
    finer = F.lit(None).cast("array<bigint>")
    for segment in SEGMENTS:
        within = (variant >= segment[0]) & (variant < segment[0] + segment[1])
        finer = F.when(within, F.array(*_variants(F.col("fp"), _thirds(segment)))).otherwise(finer)
    again = crowded.select("key", F.explode(finer).alias("second"), "fp")
    shared_again = again.withColumn("members", F.count("*").over(Window.partitionBy("key", "second"))).where("members > 1")
    pairs = shared_again.select("key", "second", "fp").sortWithinPartitions("key", "second").mapInArrow(_compare(distance), "a long, b long")
    return near.unionByName(cut(pairs.distinct(), "links-far"))


def components(links: DataFrame) -> DataFrame:
    """links: a, b (long). node, root (the least node reachable) of every node with a link, by large-star and small-star."""
    edges = cut(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u > v").distinct(), "links-0")
    step, before = 0, None
    while True:
        step += 1
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        # large star: the larger neighbours of u point to the least around u
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v").distinct()
        # small star: u's smaller neighbours and u itself point to the least of them
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
        edges = cut(small.where("u > v").distinct(), f"links-{step}")
        seen = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.sum(F.col("v").cast("decimal(38,0)"))).first()
        if seen == before:
            break
        before = seen
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def near_duplicates(docs: DataFrame, *, distance: int = DISTANCE, crowd: int = CROWD, words: int = WORDS) -> DataFrame:
    """doc_id, text_hash, fp, root (the least fingerprint reachable), component_id (the least doc_id reachable) of every row."""
    prints = cut(fingerprints(docs, words), "fingerprints")
    distinct = cut(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct-fingerprints")
    found = components(links_between(distinct.select("fp"), distance=distance, crowd=crowd))
    rooted = distinct.join(found, distinct["fp"] == found["node"], "left").select("fp", F.coalesce("root", "fp").alias("root"), "least")
    ids = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = rooted.select("fp", "root").join(ids, "root").select(F.col("fp").alias("of"), "root", "component_id")
    return prints.join(named, prints["fp"] == named["of"]).select("doc_id", "text_hash", "fp", "root", "component_id")


def first_rows(docs: DataFrame, grouped: DataFrame) -> DataFrame:
    """grouped: doc_id, text_hash, root of every row of docs. Of each root the row with the least doc_id (null last; then by text hash), with all its columns, once."""
    order = F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "text_hash")
    stays = grouped.groupBy("root").agg(F.min(order).alias("stays")).select(F.struct("stays.doc_id", "stays.text_hash").alias("stays"))
    keyed = docs.select(row_of(docs)).select("row", F.struct("row.doc_id", F.xxhash64("row.text").alias("text_hash")).alias("key"))
    # a struct equals another with nulls in the same places
    kept = keyed.join(stays, F.col("key") == F.col("stays"), "left_semi")
    return kept.withColumn("again", F.row_number().over(Window.partitionBy("key").orderBy("key"))).where("again = 1").select("row.*")


def one_of_each_group(docs: DataFrame, **options) -> DataFrame:
    """The row of docs with the least doc_id (null last; then by text hash) of each component, with all its columns, once."""
    return first_rows(docs, near_duplicates(docs, **options))


def op7_simhash_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


QUERIES = {"op7_simhash_components": op7_simhash_components}
SQL: dict[str, str] = {}
