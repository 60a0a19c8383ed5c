"""Operator 1: mix sources to target weights by weighted fair queueing (DataFrame functions only).

Each source gets a target of words: its weight's part of the budget, at most `cap` times its size, the excess going to
the others by weight. Its documents, shuffled by a hash of their id, form a queue that is served `cap` times over. A
document's virtual finish time is the number of its source's words served up to its end, divided by the source's target.
All documents of all sources are ordered by finish time; the mix is what comes first, up to the budget.

Scale: running sums are taken in two levels (sums by hash range, then inside a range), so a source that holds a third of
all rows is spread over many tasks. The order by finish time is never sorted as a whole: sums of SLICES equal steps of
virtual time give the step where the budget ends, and only that step's rows are sorted. The driver gets two single rows.

Defined cases: a null text has size 0; a document without words is never taken and moves no clock; a null source is a
source of its own, the last; null ids and repeated rows are documents like others (among equal ids the larger comes
later); an empty table gives an empty result; columns other than doc_id, text and source are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chainlake.llm.shared import cut, row_of, small, table, word_count

#: Steps of virtual time up to 1 that are summed to find where the budget ends.
SLICES = 65_536
#: Rows of a source that share a hash range, about.
RANGE_ROWS = 4_096


def source_targets(per_source: DataFrame, weights: tuple[int, ...], share: float, cap: int) -> DataFrame:
    """per_source: source, source_size. Adds s (its place by code point, null last) and target, by water-filling.

    Window functions without a partition are over one row a source.
    """
    place, ratio = Window.orderBy(F.col("source").asc_nulls_last()), Window.orderBy("ratio", "s")
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.col("s") - 1, F.lit(len(weights))) + 1).cast("int"))
    ranked = (
        per_source.withColumn("s", F.row_number().over(place))
        .withColumn("weight", weight.cast("double"))
        .withColumn("most", (F.lit(cap) * F.col("source_size")).cast("double"))
        .withColumn("ratio", F.col("most") / F.col("weight"))
    )
    before = F.coalesce(F.sum("most").over(ratio.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    rest = F.sum("weight").over(ratio.rowsBetween(0, Window.unboundedFollowing))
    everything = Window.partitionBy(F.lit(1))
    level = (F.lit(share) * F.sum("source_size").over(everything) - before) / rest
    leveled = ranked.withColumn("level", level)
    # the first source that isn't full at its level ends the filling; levels fall from there on
    full = F.max(F.when(F.col("level") <= F.col("ratio"), F.col("level"))).over(everything)
    target = F.coalesce(F.least(F.col("most"), full * F.col("weight")), F.col("most"))
    return leveled.withColumn("target", target).select("source", "s", "source_size", "target", "n")


def mix_sources(docs: DataFrame, *, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, cap: int = 2, seed: str = "mix") -> DataFrame:
    """doc_id, text_hash, source, size, source_size, target, taken (words, repeats counted) of every row of docs."""
    key = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))).cast("binary"))
    sized = cut(docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "source", word_count(F.col("text")).alias("size"), key.alias("k")), "mix-sizes")
    sources = cut(source_targets(sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n")), weights, share, cap), "mix-sources")
    n_sources = sources.count()
    total = sources.agg(F.sum("source_size")).first()[0] or 0
    budget = share * total

    by_source = small(sources.withColumnRenamed("source", "of"), n_sources)
    hashed = F.conv(F.substring("k", 1, 8), 16, 10).cast("double") / F.lit(float(2**32))
    joined = (
        sized.join(by_source, sized["source"].eqNullSafe(by_source["of"]))
        .drop("of")
        .withColumn("range", F.floor(hashed * F.ceil(F.col("n") / F.lit(RANGE_ROWS))))
    )
    nonempty = joined.where("size > 0")
    ranges = nonempty.groupBy("s", "range").agg(F.sum("size").alias("words"))
    offsets = ranges.select("s", "range", F.coalesce(F.sum("words").over(Window.partitionBy("s").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("offset"))
    inside = Window.partitionBy("s", "range").orderBy("k", F.col("doc_id").asc_nulls_first(), "size").rowsBetween(Window.unboundedPreceding, 0)
    queued = cut(
        nonempty.join(offsets, ["s", "range"])
        .withColumn("served", F.col("offset") + F.sum("size").over(inside))
        .select("doc_id", "text_hash", "source", "size", "source_size", "target", "s", "served"),
        "mix-queue",
    )

    def finish(epoch) -> F.Column:
        return (epoch * F.col("source_size") + F.col("served")) / F.col("target")

    slices = F.floor(F.least(F.col("finish"), F.lit(float(cap + 1))) * F.lit(SLICES))
    served = queued.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(cap - 1)))).select("s", "size", finish(F.col("epoch")).alias("finish"))
    steps = served.groupBy(slices.alias("slice")).agg(F.sum("size").alias("words"))
    steps = steps.withColumn("upto", F.sum("words").over(Window.orderBy("slice")))
    edge = steps.where(F.col("upto") > F.lit(budget)).orderBy("slice").select("slice", (F.col("upto") - F.col("words")).alias("before")).first()
    if edge is None:
        taken = F.lit(cap)
    else:
        order = Window.orderBy("finish", "s").rowsBetween(Window.unboundedPreceding, 0)
        last = (
            served.where(slices == F.lit(edge["slice"]))
            .withColumn("upto", F.sum("size").over(order) + F.lit(edge["before"]))
            .where(F.col("upto") <= F.lit(budget))
            .agg(F.max(F.struct("finish", "s")).alias("m"))
            .first()["m"]
        )
        # no row of that step fits: all of the steps before it
        end = F.struct(F.lit(last["finish"]), F.lit(last["s"])) if last else F.struct(F.lit(edge["slice"] / SLICES), F.lit(0))
        taken = sum(((F.struct(finish(F.lit(e)), F.col("s")) <= end).cast("long") for e in range(cap)), F.lit(0))
    out = ["doc_id", "text_hash", "source", "size", "source_size", "target"]
    return queued.select(*out, (F.col("size") * taken).cast("long").alias("taken")).unionByName(
        joined.where("size = 0").select(*out, F.lit(0).cast("long").alias("taken"))
    )


def mixed_rows(docs: DataFrame, **options) -> DataFrame:
    """The rows of docs, with all their columns, as often as the mix takes them (rows of equal doc_id, text and source together)."""
    copies = F.sum(F.when(F.col("size") > 0, F.col("taken") / F.col("size")).otherwise(0)).cast("int").alias("copies")
    taken = mix_sources(docs, **options).groupBy("doc_id", "text_hash", "source").agg(copies).where("copies > 0")
    taken = taken.select(F.struct("doc_id", "text_hash", "source").alias("of"), "copies")
    keyed = docs.select(row_of(docs)).select("row", F.struct("row.doc_id", F.xxhash64("row.text").alias("text_hash"), "row.source").alias("key"))
    # a struct equals another with nulls in the same places
    joined = keyed.join(taken, F.col("key") == F.col("of"))
    once = joined.withColumn("again", F.row_number().over(Window.partitionBy("key").orderBy("key"))).where("again = 1")
    return once.select("row", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("row.*")


def op1_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents")).drop("text_hash")


QUERIES = {"op1_source_mixing": op1_source_mixing}

SQL = {
    "op1_source_mixing": r"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         md5('mix:' || coalesce(doc_id::VARCHAR, 'null')) AS k
  FROM documents),
ranked AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY encode(source) NULLS LAST) AS s
  FROM sized GROUP BY source),
weighed AS (
  SELECT *, CASE (s - 1) % 3 WHEN 0 THEN 5.0 WHEN 1 THEN 2.0 ELSE 1.0 END::DOUBLE AS weight, (2 * source_size)::DOUBLE AS most FROM ranked),
leveled AS (
  SELECT *, (1.5::DOUBLE * sum(source_size) OVER ()::DOUBLE
             - coalesce(sum(most) OVER (ORDER BY most / weight, s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
            / sum(weight) OVER (ORDER BY most / weight, s ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM weighed),
targets AS (
  SELECT source, s, source_size,
         coalesce(least(most, max(CASE WHEN level <= most / weight THEN level END) OVER () * weight), most) AS target
  FROM leveled),
queued AS (
  SELECT d.doc_id, d.size, t.s, t.source_size, t.target, d.source,
         sum(d.size) OVER (PARTITION BY t.s ORDER BY d.k, d.doc_id NULLS FIRST, d.size ROWS UNBOUNDED PRECEDING)::BIGINT AS served,
         row_number() OVER () AS u
  FROM sized d JOIN targets t ON d.source IS NOT DISTINCT FROM t.source),
copies AS (
  SELECT u, q.size, sum(q.size) OVER (ORDER BY (e * source_size + served) / target, s ROWS UNBOUNDED PRECEDING) AS upto
  FROM queued q, (VALUES (0), (1)) AS v(e) WHERE q.size > 0),
kept AS (SELECT u, sum(size)::BIGINT AS taken FROM copies WHERE upto <= 1.5::DOUBLE * (SELECT sum(size) FROM sized) GROUP BY u)
SELECT doc_id, source, size, source_size, target, coalesce(taken, 0)::BIGINT AS taken
FROM queued LEFT JOIN kept USING (u)""",
}
