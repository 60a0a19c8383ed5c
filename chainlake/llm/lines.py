"""Operator 3: dedup of repeated runs by winnowing.

A run is RUN (50) words or more that stand in the same order at an earlier place (by doc_id, then word): of an earlier
document or of the same one. Runs are aligned, word for word, with one earlier place; white space and line breaks
between the words don't count. Every word in a run is deleted, the first occurrence stays.

Method: winnowing, over words instead of whole lines, as most repeated passages begin or end inside a line. Each window of
RUN words picks, of the words that have GRAM - 1 others after them in it, the one with the least hash (the first of equal
ones); those GRAM words are its fingerprint, so equal windows have equal ones. Windows in sequence that pick the same word are
one segment, and the words of its windows identify it. Segments are joined with their earliest equal: that extends a match
over all of its inner segments at once. Where a match begins or ends, segments of one fingerprint differ, and there,
from the anchor, it is extended window by window in both directions.

All of it is done by DataFrame functions. Sliding minima are taken by slices in generated code, at the places of an
exploded array; lambdas, which Spark interprets, only hash words and look through a segment's own words.

Scale: the texts are read once for the segments, one for some 10 words, with 64-bit hashes of the fingerprint and of the
content, and nothing else of the texts is shuffled for them. Earlier places come from grouped minima with partial sums, so a
passage in a third of all documents costs one row a task; joins on a hash have one row a key on one side, so Spark splits
skewed keys; no pair of documents is ever made. Only documents with a segment at a match's end are read again. Texts are
joined with the runs to delete at the end, by a broadcast if these are few; else the texts concerned are shuffled, told from
the others by their hashes up to KEYS documents.

What stays between kept words: the white space before a deleted run if it has a line break, else that after it.

Defined cases: null texts have no words and stay null; a text whose words all go keeps the white space around them; texts of
fewer than RUN words stay as they are; rows of equal doc_id and text are one document, and each gets its result; null ids
come last in order; among rows of one doc_id with several texts, the text's hash is the order; an empty table gives an empty
result; all columns are carried along as one struct, whatever their names; texts may be of any length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chainlake.llm.shared import BROADCAST_ROWS, SPACE, WORD, cut, row_of, table

RUN = 50
GRAM = 16
#: Documents up to which their hashes (8 bytes each) are broadcast, so that only the texts concerned are shuffled.
KEYS = 1_000_000
#: Bytes of a text that are hashed at a time.
PART = 1 << 20


class Hashes:
    """Rolling 64-bit hashes of words, and over them: sums of values by powers of an odd base, mixed. The operator no longer uses them; tests do."""

    def __init__(self, run: int, gram: int):
        import numpy as np
        from xxhash import xxh64_intdigest

        self.run, self.gram = run, gram
        self.base = 0x9E3779B97F4A7C15
        self.powers = self.inverses = np.ones(1, np.uint64)
        self.values = np.array([xxh64_intdigest(bytes([b])) for b in range(256)], np.uint64)
        self.blank = np.zeros(256, bool)
        self.blank[[0x20, *range(0x09, 0x0E)]] = True

    def _powers(self, n: int):
        import numpy as np

        if len(self.powers) <= n:
            both = (np.full(max(2 * n, 1 << 14), b, np.uint64) for b in (self.base, pow(self.base, -1, 1 << 64)))
            self.powers, self.inverses = (np.cumprod(np.concatenate([np.ones(1, np.uint64), x])) for x in both)
        return self.powers, self.inverses

    def of(self, text: bytes):
        """The words' hashes."""
        import numpy as np

        out = []
        while text:
            part = text
            if len(text) > PART:  # in parts that end after a word, if there is one
                cut = max(text.rfind(bytes([b]), 0, PART) for b in np.flatnonzero(self.blank).tolist())
                part = text[: cut + 1] if cut >= 0 else text
            text = text[len(part) :]
            data = np.frombuffer(part, np.uint8)
            powers, inverses = self._powers(len(data))
            edges = np.flatnonzero(np.diff(self.blank[data], prepend=True, append=True))
            upto = np.concatenate([np.zeros(1, np.uint64), np.cumsum(self.values[data] * powers[: len(data)])])
            out.append(_mixed((upto[edges[1::2]] - upto[edges[::2]]) * inverses[edges[::2]]))
        return np.concatenate(out) if out else np.empty(0, np.uint64)

    def rolling(self, hashes, size: int):
        """Hashes of `size` words from each place that has as many."""
        import numpy as np

        n = len(hashes)
        powers, inverses = self._powers(n)
        upto = np.concatenate([np.zeros(1, np.uint64), np.cumsum(hashes * powers[:n])])
        return _mixed((upto[size:] - upto[:-size]) * inverses[: n - size + 1])

    def windows(self, hashes):
        return self.rolling(hashes, self.run)

    def segments(self, hashes):
        """f, r, a, b, again of each segment of a text with at least one window."""
        import numpy as np

        windows = self.windows(hashes)
        least, size = self.rolling(hashes, self.gram), 1
        while size < self.run - self.gram + 1:
            step = min(size, self.run - self.gram + 1 - size)
            least = np.minimum(least[:-step], least[step:])
            size += step
        starts = np.concatenate([[0], np.flatnonzero(least[1:] != least[:-1]) + 1])
        ends = np.concatenate([starts[1:], [len(least)]]) - 1
        if (ends - starts >= self.run).any():
            # its first and last window hold all words of a segment only if they touch: longer ones (of words that recur) are cut
            starts = np.concatenate([np.arange(a, b + 1, self.run) for a, b in zip(starts.tolist(), ends.tolist())])
            ends = np.concatenate([starts[1:], [len(least)]]) - 1
        again = np.zeros(len(starts), bool)
        ordered = np.sort(windows)
        if (ordered[1:] == ordered[:-1]).any():
            order = np.argsort(windows, kind="stable")
            same = windows[order[1:]] == windows[order[:-1]]
            one, other = (np.searchsorted(starts, order[s][same], "right") - 1 for s in (slice(None, -1), slice(1, None)))
            again[one[one == other]] = True
        content = _mixed(windows[starts] + _mixed(windows[ends] ^ (ends - starts).astype(np.uint64)))
        return least[starts], content, starts, ends, again


def _mixed(x):
    """Every bit of the result depends on every bit of x."""
    import numpy as np

    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def _keyed(docs: DataFrame) -> DataFrame:
    text = F.col("text").cast("string")
    return docs.select("doc_id", F.xxhash64(text).alias("th"), text.alias("text"))


def _place(word: str) -> Column:
    return F.struct(F.col("doc_id").isNull().alias("null"), "doc_id", "th", F.col(word).alias("word"))


def _hashed(texts: DataFrame, *others: str) -> DataFrame:
    """doc_id, th, hs (the words' hashes, in order) and other columns."""
    blanks = F.lit(" \t\n\x0b\x0c\r")
    words = F.split(F.btrim("text", blanks), SPACE)
    # an empty text splits into one empty word; where this is used texts have a run of words
    return texts.select("doc_id", "th", F.transform(words, lambda w: F.xxhash64(w)).alias("hs"), *others)


def _part(start: Column, size: Column | int) -> Column:
    """Hashes of `size` words from a place that counts from 0."""
    return F.slice("hs", start + 1, F.lit(size) if isinstance(size, int) else size)


def segments(docs: DataFrame, run: int = RUN, gram: int = GRAM) -> DataFrame:
    """doc_id, th (hash of the text), f (fingerprint), r (hash of the content), a, b (first and last window) of every segment, as a written table."""
    places = run - gram + 1  # of a window's grams
    # fewer characters don't hold as many words
    long = _hashed(_keyed(docs).where(F.length("text") >= 2 * run - 1))
    # outer: else a filter that is inferred from the explosion would make the hashes twice
    each = long.select("doc_id", "th", "hs", F.posexplode_outer("hs").alias("a", "word")).where(F.col("a") <= F.size("hs") - run)
    if places > 1:
        # the window before has another least: its own first word, or none as small as this one's last
        gone, come = F.get("hs", F.col("a") - 1), F.get("hs", F.col("a") + (places - 1))
        inner = F.array_min(_part(F.col("a"), places - 1))
        each = each.where((F.col("a") == 0) | (inner >= F.when(gone <= come, gone).otherwise(come + 1)))
    # what follows works on the words of the windows that can have this least; its steps are apart, as a long method of generated code is never compiled
    found = each.select("doc_id", "th", "a", _part(F.col("a"), run + places - 1).alias("hs"), _part(F.col("a") + places, places).alias("then"), F.array_min(_part(F.col("a"), places)).alias("least"), (F.size("hs") - run - F.col("a")).alias("last"))
    smaller = F.array_position(F.transform("then", lambda x: x < F.col("least")), F.lit(True)).cast("int")
    found = found.select("doc_id", "th", "a", "hs", "least", "last", smaller.alias("smaller"))
    at = F.array_position(F.slice("hs", 1, places), F.col("least")).cast("int") - 1
    found = found.select("doc_id", "th", "a", "hs", "last", "smaller", at.alias("at"))
    # the windows that follow have the same least as long as they hold it and no smaller word comes
    n = F.least("at", "last", F.when(F.col("smaller") > 0, F.col("smaller") - 1))
    found = found.select("doc_id", "th", "a", "hs", "at", n.alias("n"))
    f, r = F.xxhash64(_part(F.col("at"), gram)), F.xxhash64(_part(F.lit(0), F.col("n") + run))
    return cut(found.select("doc_id", "th", f.alias("f"), r.alias("r"), "a", (F.col("a") + F.col("n")).alias("b")), "segments")


def _only(keyed: DataFrame, found: DataFrame, n: int) -> tuple[DataFrame, DataFrame | None]:
    """Of rows with th: those whose th some row of found has, and the others (none: not taken apart, as there are too many keys)."""
    if n > KEYS:
        return keyed, None
    keys = F.broadcast(found.select("th").distinct())
    return keyed.join(keys, "th", "left_semi"), keyed.join(keys, "th", "left_anti")


def _later_windows(docs: DataFrame, edges: DataFrame, run: int, gram: int) -> DataFrame:
    """doc_id, th, a, b of the windows in edges (doc_id, th, f, a, b) that an earlier window of the same fingerprint equals."""
    of_doc = cut(edges.groupBy("doc_id", "th").agg(F.collect_set(F.struct("f", "a", "b")).alias("edges")), "segment-edges")
    counted = of_doc.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.size("edges")), F.lit(0)).alias("edges")).first()
    texts, _ = _only(_keyed(docs), of_doc, counted["n"])
    held = of_doc.select(F.struct("doc_id", "th").alias("of"), "edges")
    held = F.broadcast(held) if counted["edges"] <= BROADCAST_ROWS else held
    texts = texts.withColumn("key", F.struct("doc_id", "th")).join(held, F.col("key") == F.col("of")).select("doc_id", "th", "text", "edges")

    each = _hashed(texts, "edges").select("doc_id", "th", "hs", F.inline("edges"))
    each = each.select("doc_id", "th", "hs", "f", F.explode(F.sequence("a", "b")).alias("a"))
    found = cut(each.select("doc_id", "th", "f", F.xxhash64(_part(F.col("a"), run)).alias("h"), "a"), "edge-windows")
    firsts = found.groupBy("f", "h").agg(F.min(_place("a")).alias("first"), F.count("*").alias("times")).where("times > 1").drop("times")
    later = found.join(firsts, ["f", "h"]).where(_place("a") > F.col("first"))
    return later.select("doc_id", "th", "a", F.col("a").alias("b"))


def repeated_runs(docs: DataFrame, run: int = RUN, gram: int = GRAM) -> DataFrame:
    """doc_id, th, runs (array of first and last word, from 0, apart from each other) of documents with words to delete."""
    if not 1 <= gram <= run:
        raise ValueError("a gram is a part of a run")
    every = segments(docs, run, gram)
    # a fingerprint of one segment anchors nothing
    # written, so that the join can split a fingerprint of many segments
    anchors = cut(every.groupBy("f").agg(F.count("*").alias("times")).where("times > 1").select("f"), "segment-anchors")
    hits = cut(every.join(anchors, "f"), "segment-hits")
    kinds = cut(hits.groupBy("f", "r").agg(F.min(_place("a")).alias("first"), F.count("*").alias("times")), "segment-kinds")
    # segments of one fingerprint that differ: a match may begin or end in them
    several = kinds.groupBy("f").agg(F.count("*").alias("kinds")).where("kinds > 1").select("f", F.lit(True).alias("edge"))
    matched = kinds.join(several, "f", "left").where("times > 1 or edge").select("f", "r", "first", "edge")
    matched = hits.join(matched, ["f", "r"]).withColumn("later", _place("a") > F.col("first")).where("later or edge")
    matched = cut(matched.select("doc_id", "th", "f", "a", "b", "later"), "segment-matches")
    whole = matched.where("later").select("doc_id", "th", "a", "b")
    found = whole.unionByName(_later_windows(docs, matched.where("not later"), run, gram))
    # windows to words; what touches becomes one run
    by_doc = found.groupBy("doc_id", "th").agg(F.sort_array(F.collect_set(F.struct(F.col("a").alias("a"), (F.col("b") + (run - 1)).alias("b")))).alias("parts"))

    def join(runs: Column, part: Column) -> Column:
        last = F.element_at(runs, -1)
        longer = F.concat(F.slice(runs, F.lit(1), F.size(runs) - 1), F.array(F.struct(last["a"].alias("a"), F.greatest(last["b"], part["b"]).alias("b"))))
        return F.when(F.size(runs) == 0, F.array(part)).when(part["a"] <= last["b"] + 1, longer).otherwise(F.concat(runs, F.array(part)))

    return by_doc.select("doc_id", "th", F.aggregate("parts", F.array().cast("array<struct<a:int,b:int>>"), join).alias("runs"))


def _without(text: Column, runs: Column) -> Column:
    """The text without the words of the runs (first and last word, ascending, apart)."""
    pieces = F.regexp_extract_all(text, F.lit(f"{WORD}[\\x20\\x09-\\x0D]*"), F.lit(0))
    space = lambda piece: F.coalesce(F.regexp_extract(piece, r"[\x20\x09-\x0D]+$", 0), F.lit(""))

    def build(pieces: Column) -> Column:
        after = lambda j: F.coalesce(F.get(runs, j)["b"] + 1, F.lit(0))

        def part(r: Column, j: Column) -> Column:
            start = F.when(j > 0, after(j - 1)).otherwise(F.lit(0))
            kept = F.array_join(F.slice(pieces, start + 1, r["a"] - start), "")
            before = space(kept)
            between = F.when(before.contains("\n"), before).otherwise(space(F.get(pieces, r["b"])))
            return F.when(r["a"] > start, F.concat(F.regexp_replace(kept, r"[\x20\x09-\x0D]+$", ""), between)).otherwise(F.lit(""))

        last = after(F.size(runs) - 1)
        tail = F.array_join(F.slice(pieces, last + 1, F.size(pieces) - last), "")
        return F.concat(F.array_join(F.transform(runs, part), ""), tail)

    lead = F.coalesce(F.regexp_extract(text, r"^[\x20\x09-\x0D]+", 0), F.lit(""))
    return F.concat(lead, F.transform(F.array(pieces), build)[0])


def drop_repeated_runs(docs: DataFrame, run: int = RUN, gram: int = GRAM) -> DataFrame:
    """row (a struct of all columns of docs, the text without its repeated runs), n_runs, n_removed (words), emptied (all of its words went) of every row."""
    found = cut(repeated_runs(docs, run, gram), "repeated-runs")
    counted = found.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.size("runs")), F.lit(0)).alias("runs")).first()
    text = F.col("row.text").cast("string")
    keyed = docs.select(row_of(docs)).select("row", F.xxhash64(text).alias("th"))
    held = found.select(F.struct("doc_id", "th").alias("of"), "runs")
    if counted["runs"] <= BROADCAST_ROWS:
        some, others, held = keyed, None, F.broadcast(held)
    else:
        some, others = _only(keyed, found, counted["n"])
    # structs with nulls in the same places are equal
    joined = some.withColumn("key", F.struct("row.doc_id", "th")).join(held, F.col("key") == F.col("of"), "left").select("row", "runs")
    if others is not None:
        joined = joined.unionByName(others.select("row", F.lit(None).cast(found.schema["runs"].dataType).alias("runs")))
    new = F.when(F.col("runs").isNotNull(), _without(text, F.col("runs"))).otherwise(text)
    removed = F.aggregate("runs", F.lit(0), lambda n, r: n + r["b"] - r["a"] + 1)
    some = F.col("runs").isNotNull()
    count = lambda c: F.when(some, c).otherwise(F.lit(0)).cast("long")
    made = joined.select(F.col("row").withField("text", new).alias("row"), count(F.size("runs")).alias("n_runs"), count(removed).alias("n_removed"))
    return made.withColumn("emptied", F.when(F.col("n_removed") > 0, ~F.col("row.text").rlike(WORD)).otherwise(F.lit(False)))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drop_repeated_runs(table(spark, sf_dir, "documents").select("doc_id", "text")).select("row.*", "n_runs", "n_removed", "emptied")


QUERIES = {"op3_line_dedup": op3_line_dedup}

SQL = {
    "op3_line_dedup": r"""
WITH d AS (
  SELECT doc_id, text, regexp_extract_all(text, '([^\x20\x09-\x0D]+)([\x20\x09-\x0D]*)', 1) AS w,
         regexp_extract_all(text, '([^\x20\x09-\x0D]+)([\x20\x09-\x0D]*)', 2) AS s
  FROM documents),
windows AS (SELECT doc_id, i, md5(array_to_string(w[i:i + 49], ' ')) AS h FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM d)),
later AS (SELECT doc_id, i, i + 49 AS j FROM (SELECT *, row_number() OVER (PARTITION BY h ORDER BY doc_id, i) AS k FROM windows) WHERE k > 1),
words AS (SELECT doc_id, unnest(w) AS word, unnest(s) AS space, unnest(range(1, len(w) + 1)) AS i, s, len(w) AS n FROM d),
marked AS (
  SELECT w.*, i <= coalesce(max(l.j) OVER (PARTITION BY w.doc_id ORDER BY w.i ROWS UNBOUNDED PRECEDING), 0) AS gone
  FROM words w LEFT JOIN later l USING (doc_id, i)),
kept AS (SELECT *, coalesce(lead(i) OVER (PARTITION BY doc_id ORDER BY i), n + 1) AS next FROM marked WHERE NOT gone),
texts AS (
  SELECT doc_id, string_agg(word || CASE WHEN next = i + 1 OR contains(space, chr(10)) THEN space ELSE s[next - 1] END, '' ORDER BY i) AS text
  FROM kept GROUP BY doc_id),
counts AS (
  SELECT doc_id, count(*) FILTER (WHERE gone AND NOT before) AS n_runs, count(*) FILTER (WHERE gone) AS n_removed
  FROM (SELECT doc_id, gone, coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY i), false) AS before FROM marked) GROUP BY doc_id)
SELECT d.doc_id, CASE WHEN d.text IS NOT NULL THEN regexp_extract(d.text, '^[\x20\x09-\x0D]*') || coalesce(t.text, '') END AS text,
       coalesce(n_runs, 0)::BIGINT AS n_runs, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_removed > 0 AND n_removed = len(w), false) AS emptied
FROM d LEFT JOIN texts t USING (doc_id) LEFT JOIN counts USING (doc_id)""",
}
