"""Operator 9: quality rules by robust multivariate outliers (DataFrame functions only).

Base statistics of a whole text: n_words, word_chars (code points in words), n_symbols (characters of #*$%&|<>),
n_dup_lines (lines with a word that equal an earlier line), n_repeat_words (words in 3-word windows that occur at least
twice). Base rule: fewer than MIN_WORDS words, or more than half of the words repeated, fails.

Of the texts that pass, the vector (word length, symbols, repeated lines, repeated words: each a rate by words, as square
roots in thousandths) is held against a minimum-covariance-determinant estimate of its language and source. It has STARTS
(medians with median deviations; mean and covariance of all; of scores cut at 2; of directions). From each, concentration
steps (the H share with the smallest Mahalanobis distances gives the next mean and covariance) go on until the
determinant no longer falls, and the start that ends with the least determinant counts. A text is rejected if its squared
distance exceeds CUTOFF. Groups below MIN_GROUP texts use their language's estimate, and languages below it that of all
texts. FLOORS are the least standard deviations (the estimate is regularised by their squares), so that a statistic that
hardly varies in the core rejects no text for a trifle.

Scale: the statistics are made in one pass over the texts without a shuffle and written as a narrow table; every estimate
is a grouped sum over it, with partial sums before the shuffle, so a group that holds a third of all rows costs no more.
Sums are of integers (decimals), so results do not depend on the order of rows. The H share's limit comes from counts of
distances in steps of 1/64 up to FAR; medians from counts by value, first by BAND values together, then within the band. All
groups take their steps together; a step is one pass over the narrow table, of the groups and starts that still fall.

Defined cases: a null text has all statistics 0 and fails the base rule; null languages and sources are groups of their
own; repeated rows count each; null ids are kept; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chainlake.llm.shared import SPACE, WORD, cut, row_of, small, table

SYMBOLS = "#*$%&|<>"
BLANKS = " \t\n\x0b\x0c\r"
MIN_WORDS = 50
MIN_GROUP = 100
H = 0.75
STARTS = 4
#: Steps after which a start counts as it is; on the driver's tables all ended after 12 at most.
MOST_STEPS = 60
#: A determinant falls if it gets smaller by more than this part.
LEAST_FALL = 1e-9
#: Six standard deviations of one statistic.
CUTOFF = 36.0
BAND = 64
#: Thousandths of each statistic's unit: word length (square root), symbols, repeated lines, repeated words (square roots of rates).
#: CUTOFF floors off the centre are a mean word length of about 2 characters more or less, or rates of 0.36 a word.
FLOORS = (70.0, 100.0, 100.0, 100.0)
#: Makes the core's covariance that of all of a normal group: h / P(chi2 with p + 2 degrees <= its h quantile with p), for h = 0.75, p = 4.
CONSISTENCY = 1.49
#: Distances beyond this share one step.
FAR = 4096.0
DIMS = ("t1", "t2", "t3", "t4")
PAIRS = [(i, j) for i in range(4) for j in range(i + 1)]


def base_statistics(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash, lang, source, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed of every row."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    lines = F.filter(F.split(text, "\n", -1), lambda line: line.rlike(WORD))
    one = docs.select(
        "doc_id",
        F.xxhash64("text").alias("text_hash"),
        "lang",
        "source",
        F.array_remove(F.split(text, SPACE, -1), "").alias("w"),
        F.length(F.translate(text, BLANKS, "")).cast("long").alias("word_chars"),
        (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        lines.alias("lines"),
    )
    w = F.col("w")
    windows = F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.xxhash64(w[i], w[i + 1], w[i + 2]))
    two = one.select(
        "doc_id",
        "text_hash",
        "lang",
        "source",
        F.size(w).cast("long").alias("n_words"),
        "word_chars",
        "n_symbols",
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.when(F.size(w) >= 3, windows).otherwise(F.array().cast("array<bigint>")).alias("h"),
    )
    # only texts with a window that recurs are sorted: equal windows become neighbours, with their places
    order = F.sort_array(F.transform("h", lambda x, i: F.struct(x.alias("h"), i.alias("p"))))
    three = two.withColumn("s", F.when(F.size(F.array_distinct("h")) < F.size("h"), order)).drop("h")
    n = F.size("s")
    same = F.zip_with("s", F.slice("s", F.lit(2), n), lambda a, b: F.coalesce(a["h"] == b["h"], F.lit(False)))
    four = three.withColumn("same", same)
    marked = F.arrays_zip(F.col("s.p").alias("p"), F.col("same").alias("next"), F.concat(F.array(F.lit(False)), F.col("same")).alias("last"))
    places = F.sort_array(F.transform(F.filter(marked, lambda m: (m["next"] | m["last"]) & m["p"].isNotNull()), lambda m: m["p"]))
    five = four.withColumn("places", places).drop("s", "same")
    # each marked window covers three words, or up to the next marked one
    covered = F.aggregate(F.zip_with("places", F.slice("places", F.lit(2), F.size("places")), lambda a, b: F.coalesce(F.least(b - a, F.lit(3)), F.lit(3))), F.lit(0), lambda s, x: s + x)
    six = five.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long")).drop("places")
    return six.withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))


def _vector() -> list[Column]:
    rate = lambda c: F.col(c) / F.col("n_words")
    values = (F.sqrt(rate("word_chars")), F.sqrt(rate("n_symbols")), F.sqrt(rate("n_dup_lines")), F.sqrt(rate("n_repeat_words")))
    return [F.floor(v * 1000 + 0.5).cast("long").alias(d) for v, d in zip(values, DIMS)]


def _median(rows: DataFrame, values: list[Column], names: list[str]) -> DataFrame:
    """Lower medians by group g, from counts by value: of bands of values first, then of those in the median's band."""
    each = rows.select("g", F.posexplode(F.array(*values)).alias("d", "x")).groupBy("g", "d", "x").agg(F.count("*").alias("n"))
    each = cut(each.withColumn("band", F.floor(F.col("x") / F.lit(BAND))), "quality-counts")
    bands = each.groupBy("g", "d", "band").agg(F.sum("n").alias("n"))
    group = Window.partitionBy("g", "d")
    bands = bands.withColumn("upto", F.sum("n").over(group.orderBy("band"))).withColumn("all", F.sum("n").over(group))
    middle = bands.where(2 * F.col("upto") >= F.col("all")).groupBy("g", "d").agg(F.min(F.struct("band", (F.col("upto") - F.col("n")).alias("before"), "all")).alias("m"))
    middle = middle.select("g", "d", "m.*")
    inside = each.join(middle, ["g", "d", "band"]).withColumn("upto", F.col("before") + F.sum("n").over(group.orderBy("x")))
    found = inside.where(2 * F.col("upto") >= F.col("all")).groupBy("g", "d").agg(F.min("x").alias("x"))
    return found.groupBy("g").agg(*(F.max(F.when(F.col("d") == i, F.col("x"))).cast("double").alias(n) for i, n in enumerate(names)))


def _exact(value: Column) -> Column:
    """The sum of whole numbers, whatever the order of rows."""
    return F.sum(value.cast("decimal(20,0)")).cast("double")


def _floor(i: int, j: int) -> float:
    return FLOORS[i] ** 2 if i == j else 0.0


def _factor(estimates: DataFrame) -> DataFrame:
    """From means m0.. and covariances c00, c10.. the lower triangular l00, l10.. with l l' = c, and its determinant."""
    out = estimates
    for i in range(4):
        for j in range(i + 1):
            rest = F.col(f"c{i}{j}")
            for k in range(j):
                rest = rest - F.col(f"l{i}{k}") * F.col(f"l{j}{k}")
            out = out.withColumn(f"l{i}{j}", F.sqrt(rest) if i == j else rest / F.col(f"l{j}{j}"))
    determinant = reduce(lambda a, b: a * b, (F.col(f"l{i}{i}") * F.col(f"l{i}{i}") for i in range(4)))
    return out.select("g", "k", determinant.alias("det"), *(f"m{i}" for i in range(4)), *(f"l{i}{j}" for i, j in PAIRS))


def _distance(rows: DataFrame, factors: DataFrame, n_factors: int) -> DataFrame:
    """rows with k and d2, the squared Mahalanobis distance, by forward substitution, for each factor of their group."""
    out = rows.join(small(factors.drop("det"), n_factors), "g")
    for i in range(4):
        rest = F.col(DIMS[i]) - F.col(f"m{i}")
        for j in range(i):
            rest = rest - F.col(f"l{i}{j}") * F.col(f"y{j}")
        out = out.withColumn(f"y{i}", rest / F.col(f"l{i}{i}"))
    return out.withColumn("d2", reduce(lambda a, b: a + b, (F.col(f"y{i}") * F.col(f"y{i}") for i in range(4)))).drop(*(f"y{i}" for i in range(4)), *(f"m{i}" for i in range(4)), *(f"l{i}{j}" for i, j in PAIRS))


def _moments(n: Column, sums: list[Column], products: dict, factor: float) -> list[Column]:
    """Mean and covariance (by `factor`, with the floors) from sums and sums of products."""
    spread = lambda i, j: (products[i, j] / n - sums[i] / n * (sums[j] / n)) * factor + F.lit(_floor(i, j))
    return [*((sums[i] / n).alias(f"m{i}") for i in range(4)), *(spread(i, j).alias(f"c{i}{j}") for i, j in PAIRS)]


def _starts(rows: DataFrame, n_groups: int) -> DataFrame:
    """g, k, means and covariances of every group's starts."""
    center = cut(_median(rows, [F.col(d) for d in DIMS], [f"m{i}" for i in range(4)]), "quality-medians")
    off = rows.join(small(center, n_groups), "g")
    deviation = _median(off, [F.abs(F.col(DIMS[i]) - F.col(f"m{i}")).cast("long") for i in range(4)], [f"a{i}" for i in range(4)])
    squared = lambda i: F.col(f"a{i}") * 1.4826 * (F.col(f"a{i}") * 1.4826) + F.lit(_floor(i, i))
    center = cut(center.join(deviation, "g").select("g", *(f"m{i}" for i in range(4)), *(F.sqrt(squared(i)).alias(f"s{i}") for i in range(4))), "quality-centers")
    scored = rows.join(small(center, n_groups), "g")
    scored = scored.select("g", *DIMS, *(((F.col(DIMS[i]) - F.col(f"m{i}")) / F.col(f"s{i}")).alias(f"z{i}") for i in range(4)))
    norm = F.sqrt(reduce(lambda a, b: a + b, (F.col(f"z{i}") * F.col(f"z{i}") for i in range(4))))
    whole = lambda v: F.floor(v * 1000 + 0.5).cast("long")
    scored = scored.withColumn("norm", norm).select(
        "g",
        *DIMS,
        *(whole(F.greatest(F.least(F.col(f"z{i}"), F.lit(2.0)), F.lit(-2.0))).alias(f"w{i}") for i in range(4)),
        *(whole(F.when(F.col("norm") > 0, F.col(f"z{i}") / F.col("norm")).otherwise(0.0)).alias(f"u{i}") for i in range(4)),
    )
    sums = scored.groupBy("g").agg(
        F.count("*").cast("double").alias("n"),
        *(_exact(F.col(DIMS[i])).alias(f"e{i}") for i in range(4)),
        *(_exact(F.col(DIMS[i]) * F.col(DIMS[j])).alias(f"x{i}{j}") for i, j in PAIRS),
        *(_exact(F.col(f"{v}{i}") * F.col(f"{v}{j}")).alias(f"{v}{i}{j}") for v in "wu" for i, j in PAIRS),
    )
    both = cut(sums.join(center, "g"), "quality-sums")
    medians = [F.col(f"m{i}") for i in range(4)]
    scaled = lambda p: [*medians, *((F.col(f"{p}{i}{j}") / F.col("n") / 1e6 * F.col(f"s{i}") * F.col(f"s{j}") + F.lit(_floor(i, j))).alias(f"c{i}{j}") for i, j in PAIRS)]
    ways = [
        [*medians, *((F.col(f"s{i}") * F.col(f"s{i}") if i == j else F.lit(0.0)).alias(f"c{i}{j}") for i, j in PAIRS)],
        _moments(F.col("n"), [F.col(f"e{i}") for i in range(4)], {(i, j): F.col(f"x{i}{j}") for i, j in PAIRS}, 1.0),
        scaled("w"),
        scaled("u"),
    ]
    return reduce(DataFrame.unionByName, (both.select("g", F.lit(k).alias("k"), *way) for k, way in enumerate(ways)))


def _concentrated(rows: DataFrame, factors: DataFrame, n_factors: int) -> DataFrame:
    """g, k, mean and covariance of the H share of each group with the smallest distances."""
    far = _distance(rows, factors, n_factors).withColumn("step", F.floor(F.sqrt(F.least("d2", F.lit(FAR * FAR))) * 64))
    counts = far.groupBy("g", "k", "step").count()
    one = Window.partitionBy("g", "k")
    limits = counts.withColumn("upto", F.sum("count").over(one.orderBy("step"))).withColumn("n", F.sum("count").over(one))
    limits = limits.where(F.col("upto") >= F.lit(H) * F.col("n")).groupBy("g", "k").agg(F.min("step").alias("limit"))
    core = far.join(small(limits, n_factors), ["g", "k"]).where("step <= limit")
    sums = core.groupBy("g", "k").agg(
        F.count("*").cast("double").alias("n"),
        *(_exact(F.col(DIMS[i])).alias(f"s{i}") for i in range(4)),
        *(_exact(F.col(DIMS[i]) * F.col(DIMS[j])).alias(f"p{i}{j}") for i, j in PAIRS),
    )
    return sums.select("g", "k", *_moments(F.col("n"), [F.col(f"s{i}") for i in range(4)], {(i, j): F.col(f"p{i}{j}") for i, j in PAIRS}, CONSISTENCY))


def estimate(rows: DataFrame, n_groups: int, most_steps: int = MOST_STEPS) -> DataFrame:
    """rows: g, t1..t4. Of each group the factor with the least determinant: g, k (its start), det, means, factor."""
    going, n_going = cut(_factor(_starts(rows, n_groups)), "quality-starts"), STARTS * n_groups
    ended: list[DataFrame] = []
    for step in range(most_steps):
        before = going.select(F.col("g").alias("of"), F.col("k").alias("start"), F.col("det").alias("last"))
        new = _factor(_concentrated(rows, going, n_going))
        new = new.join(small(before, n_going), (F.col("g") == F.col("of")) & (F.col("k") == F.col("start"))).drop("of", "start")
        falls = F.lit(True) if step == 0 else F.col("det") < F.col("last") * F.lit(1 - LEAST_FALL)  # a start's own isn't that of a share
        new = cut(new.withColumn("falls", falls).drop("last"), f"quality-step-{step}")
        ended.append(going.join(small(new.where("not falls").select("g", "k"), n_going), ["g", "k"], "left_semi"))
        going = new.where("falls").drop("falls")
        n_going = going.count()
        if not n_going:
            break
    ended.append(going)
    columns = ["k", "det", *(f"m{i}" for i in range(4)), *(f"l{i}{j}" for i, j in PAIRS)]
    best = reduce(DataFrame.unionByName, ended).groupBy("g").agg(F.min(F.struct(F.col("det").alias("least"), F.col("k").alias("start"), F.struct(*columns).alias("all"))).alias("best"))
    return cut(best.select("g", "best.all.*"), "quality-estimates")


def judge_quality(docs: DataFrame, *, cutoff: float = CUTOFF, min_group: int = MIN_GROUP, most_steps: int = MOST_STEPS) -> DataFrame:
    """The base statistics of every row of docs, with d2 (null where the base rule fails) and kept."""
    base = cut(base_statistics(docs), "quality-statistics")
    narrow = F.to_json(F.struct("lang", "source"))
    wide = F.to_json(F.struct("lang"))
    passed = base.where("not base_failed").withColumns({"g1": narrow, "g2": wide})
    sizes = passed.groupBy("g1", "g2").count()
    level2 = sizes.groupBy("g2").agg(F.sum("count").alias("n2"))
    chosen = F.when(F.col("count") >= min_group, F.concat(F.lit("1"), "g1")).when(F.col("n2") >= min_group, F.concat(F.lit("2"), "g2")).otherwise("3")
    chosen = cut(sizes.join(level2, "g2").select("g1", chosen.alias("g")), "quality-groups")
    n_groups = chosen.count()
    id_columns = [c for c in base.columns if c not in ("lang", "source")]
    judged = passed.join(small(chosen, n_groups), "g1").select("g", *id_columns, "lang", "source", *_vector())

    # texts of small groups are judged by a wider group's estimate, which all of the wider group's texts take part in
    levels = [
        passed.withColumn("g", F.concat(F.lit("1"), "g1")),
        passed.withColumn("g", F.concat(F.lit("2"), "g2")),
        passed.withColumn("g", F.lit("3")),
    ]
    used = chosen.select("g").distinct()
    rows = cut(reduce(DataFrame.unionByName, levels).join(small(used, n_groups), "g", "left_semi").select("g", *_vector()), "quality-vectors")
    best = estimate(rows, n_groups, most_steps)
    done = _distance(judged, best, n_groups).select(*id_columns, "lang", "source", "d2", (F.col("d2") <= F.lit(cutoff)).alias("kept"))
    failed = base.where("base_failed").select(*id_columns, "lang", "source", F.lit(None).cast("double").alias("d2"), F.lit(False).alias("kept"))
    return done.unionByName(failed)


def keep_good(docs: DataFrame, **options) -> DataFrame:
    """The rows of docs, with all their columns, that judge_quality keeps."""
    good = judge_quality(docs, **options).where("kept").select(F.struct("doc_id", "text_hash").alias("good")).distinct()
    keyed = docs.select(row_of(docs)).select("row", F.struct("row.doc_id", F.xxhash64("row.text").alias("text_hash")).alias("key"))
    # a struct equals another with nulls in the same places
    return keyed.join(good, F.col("key") == F.col("good"), "left_semi").select("row.*")


def op9_quality_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = judge_quality(table(spark, sf_dir, "documents"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


QUERIES = {"op9_quality_outliers": op9_quality_outliers}
SQL: dict[str, str] = {}
