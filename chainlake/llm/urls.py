"""Operator 5: URL filters by a blocked Bloom filter and an exact hash join (DataFrame functions only).

Listed keys are canonical addresses (host and path, sorted query without tracking parameters, no fragment) and the host and
path of rules. A rule fits its host and all subdomains if the path starts with the rule's; the longest one that fits
decides. Without a rule, a listed address is blocked and everything else allowed.

Each distinct url gives its candidate keys: its canonical address, and for each suffix of its host the host of a rule. A
candidate whose bits are all set in its block of the Bloom filter goes on to the exact join, which removes false positives.
A rule's host that was found names the lengths of its rules' paths, and the url's path starts of these lengths are the
candidates of a second pass through the same filter and join.

Scale: a block is one 64-bit word for KEYS_A_BLOCK keys, so the filter grows with the list and probing is one join on the
block's number: a broadcast up to MAX_BLOCKS words (16 MB), beyond that a join that is dealt out by block, so neither
side is ever held whole. The exact join is a broadcast only for lists counted within the bound, else a plain join with one
row a key, whose skewed keys Spark splits. Urls are made distinct first (with partial sums), so a url on a third of all
pages costs one row a task. A url has no more candidates than labels (at most as many as the longest listed host) and
different lengths of path among the rules of its hosts. Of rules and list the driver gets counts only.

Defined cases: a null url or one without :// has empty host and path, no rule, and is allowed; an empty path fits only an
empty rule path; null entries of the list are ignored, repeated ones count once; of rules of equal host and path, block
wins; repeated rows are judged each; null ids are kept; empty tables give an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chainlake.llm.shared import cut, literal_rows, small, table

#: Blocks of a filter that is broadcast; larger ones are joined by block.
MAX_BLOCKS = 1 << 20
#: Keys for each 64-bit block, and bits set for each key.
KEYS_A_BLOCK = 4
BITS = 4
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
TRACKING = r"^(utm_[^=]*|ref|fbclid|gclid)(=|$)"
#: The query's rules: host, path, verdict.
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))


def _rest(url: Column) -> Column:
    """What follows the first ://, else null."""
    at = F.instr(url, "://")
    return F.when(at > 0, F.substr(url, at + 3, F.length(url)))


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(_rest(url), r"^([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def canonical(url: Column) -> Column:
    """Host without www., path without slashes at its end, sorted query without tracking parameters; null without ://."""
    query = F.regexp_extract(_rest(url), r"^[^?#]*\?([^#]*)", 1)
    kept = F.array_sort(F.filter(F.split(query, "&", -1), lambda p: (p != "") & ~p.rlike(TRACKING)))
    address = F.concat(F.regexp_replace(host_of(url), r"^www\.", ""), F.regexp_replace(path_of(url), r"/+$", ""))
    address = F.concat(address, F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise(F.lit("")))
    return F.when(F.instr(url, "://") > 0, address)


def _block(key: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(blocks))


def _mask(key: Column) -> Column:
    """BITS of a 64-bit word, from a hash of its own."""
    h, mask = F.xxhash64(F.lit("bits"), key), F.lit(0).cast("long")
    for i in range(BITS):
        bit = F.shiftrightunsigned(h, 6 * i).bitwiseAND(F.lit(63).cast("long")).cast("int")
        mask = mask.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), bit))
    return mask


def blocked_bloom(keys: DataFrame, n_keys: int) -> tuple[DataFrame, int]:
    """keys: key. The filter's words that are not zero (block, word), and its number of blocks, a power of two."""
    blocks = 64
    while blocks * KEYS_A_BLOCK < n_keys:
        blocks *= 2
    words = keys.select(_block(F.col("key"), blocks).alias("block"), _mask(F.col("key")).alias("bits"))
    return words.groupBy("block").agg(F.bit_or("bits").alias("word")), blocks


def filter_urls(pages: DataFrame, rules: DataFrame, listed: DataFrame, *, max_blocks: int = MAX_BLOCKS) -> DataFrame:
    """page_id, url, host, path, rule, verdict, listed (of its address) of every row of pages.

    rules: host, path, verdict (allow or block). listed: url, of any form.
    """
    named = rules.where("host is not null and path is not null").groupBy("host", "path").agg(F.max("verdict").alias("verdict"))
    none = lambda **kinds: [F.lit(None).cast(k).alias(c) for c, k in kinds.items()]
    by_rule = named.select(F.concat(F.lit("rule "), "host", "path").alias("key"), F.concat("host", "path").alias("rule"), "verdict", *none(chars="array<int>"))
    by_host = named.groupBy("host").agg(F.sort_array(F.collect_set(F.length("path"))).alias("chars")).select(F.concat(F.lit("host "), "host").alias("key"), *none(rule="string", verdict="string"), "chars")
    by_address = listed.where("url like '%://%'").select(F.concat(F.lit("page "), canonical(F.col("url"))).alias("key")).distinct().select("key", *none(rule="string", verdict="string", chars="array<int>"))
    keys = cut(by_rule.unionByName(by_host).unionByName(by_address), "url-keys")
    counted = keys.agg(F.count("*").alias("n"), F.max(F.when(F.col("chars").isNotNull(), F.size(F.split("key", r"\.")))).alias("labels")).first()
    n_keys, most_labels = counted["n"], counted["labels"] or 0
    words, blocks = blocked_bloom(keys.select("key"), n_keys)
    words = F.broadcast(words) if blocks <= max_blocks else cut(words, "url-filter")

    def hits(candidates: DataFrame) -> DataFrame:
        probed = candidates.withColumn("block", _block(F.col("key"), blocks)).join(words, "block")
        possible = probed.where(F.col("word").bitwiseAND(_mask(F.col("key"))) == _mask(F.col("key"))).select("url", "key")
        return possible.join(small(keys, n_keys), "key")

    urls = pages.select("url").where("url like '%://%'").distinct()
    labels = F.split("host", r"\.")
    own = urls.select("url", host_of(F.col("url")).alias("host"), F.concat(F.lit("page "), canonical(F.col("url"))).alias("address"))
    own = own.withColumn("labels", labels).withColumn("most", F.least(F.size("labels"), F.lit(most_labels)))
    suffixes = F.transform(F.sequence(F.lit(1), F.col("most")), lambda k: F.concat(F.lit("host "), F.array_join(F.slice("labels", -k, k), ".")))
    suffixes = F.when(F.col("most") > 0, suffixes).otherwise(F.array().cast("array<string>"))
    first = cut(hits(own.select("url", F.explode(F.concat(F.array("address"), suffixes)).alias("key"))), "url-hits")
    of_host = first.where("chars is not null").select("url", F.substr(F.col("key"), F.lit(6)).alias("suffix"), path_of(F.col("url")).alias("path"), F.explode("chars").alias("chars"))
    starts = of_host.where(F.length("path") >= F.col("chars")).select("url", F.concat(F.lit("rule "), "suffix", F.substr(F.col("path"), F.lit(1), F.col("chars"))).alias("key"))
    found = first.where("chars is null").unionByName(hits(starts))
    judged = found.groupBy("url").agg(
        F.max(F.when(F.col("rule").isNotNull(), F.struct(F.length("rule").alias("n"), "rule", "verdict"))).alias("best"),
        F.max(F.col("rule").isNull()).alias("listed"),
    )
    judged = judged.select(F.col("url").alias("of"), "best", "listed")
    url = F.col("url")
    out = pages.select("page_id", "url").join(judged, F.col("url") == F.col("of"), "left")
    by_method = F.when(F.col("listed"), "block").otherwise("allow")
    return out.select("page_id", "url", host_of(url).alias("host"), path_of(url).alias("path"), F.col("best.rule").alias("rule"), F.coalesce("best.verdict", by_method).alias("verdict"), F.coalesce("listed", F.lit(False)).alias("listed"))


def op5_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The list stands for one of promoted addresses: those that some page was reached at by a link with a utm_source."""
    pages = table(spark, sf_dir, "pages")
    rules = literal_rows(spark, RULES, ("host", "path", "verdict"))
    listed = pages.select("url").where(r"url rlike '[?&]utm_source='")
    return filter_urls(pages, rules, listed).select("page_id", "host", "path", "rule", "verdict", "listed")


QUERIES = {"op5_url_filters": op5_url_filters}

SQL = {
    "op5_url_filters": r"""
WITH p AS (
  SELECT page_id, url, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) END AS rest FROM pages),
s AS (
  SELECT *, coalesce(translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
         coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path,
         list_sort(list_filter(string_split(regexp_extract(rest, '^[^?#]*\?([^#]*)', 1), '&'),
                               lambda x: x <> '' AND NOT regexp_matches(x, '^(utm_[^=]*|ref|fbclid|gclid)(=|$)'))) AS kept
  FROM p),
c AS (
  SELECT *, regexp_replace(host, '^www\.', '') || regexp_replace(path, '/+$', '')
            || CASE WHEN len(kept) > 0 THEN '?' || array_to_string(kept, '&') ELSE '' END AS address
  FROM s),
l AS (SELECT DISTINCT address FROM c WHERE rest IS NOT NULL AND regexp_matches(url, '[?&]utm_source=')),
r(h, q, v) AS (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
j AS (
  SELECT page_id, url, host, path, address, rest,
         (SELECT max(struct_pack(n := length(h || q), rule := h || q, v := v)) FROM r
          WHERE (host = h OR ends_with(host, '.' || h)) AND starts_with(path, q)) AS best
  FROM c),
k AS (SELECT *, rest IS NOT NULL AND address IN (SELECT address FROM l) AS listed FROM j)
SELECT page_id, host, path, best.rule AS rule, coalesce(best.v, CASE WHEN listed THEN 'block' ELSE 'allow' END) AS verdict, listed
FROM k""",
}
