"""URL filters: rules and listed canonical URLs behind a blocked Bloom filter, confirmed by an exact hash join.

A rule fits its host and all subdomains where the path starts with the rule's; a listed canonical URL fits itself, and
one without a path its host and all subdomains. A (host, path) asks for one key per host suffix and rule path length, for its
canonical form, and for its host's suffixes. Keys pass the filter first: 256-bit blocks, of which a key touches one, with one bit in each of its
eight 32-bit words. Keys that pass are joined exactly with the list, which takes false positives out.

The filter is built by an aggregation over the list (one row a block). It is broadcast while it has at most
`broadcast_blocks` blocks, and joined by block beyond that. Each (host, path) is judged once however many pages have
it, so a hot URL weighs no more than another; verdicts are broadcast to the pages up to `broadcast_rows`, and joined
with adaptive skew splitting beyond.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm.common import materialise

BITS_PER_KEY = 16
BLOCK_BITS = 256
BROADCAST_BLOCKS = 65_536
BROADCAST_ROWS = 10_000

# The rules of the registered query, in their order.
RULES = [
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
]
# Listed hosts of the registered query, and hosts of which some pages are listed.
LISTED_HOSTS = [f"{name}.example.{top}" for name in ("ads-track", "casino-win", "cheap-pills", "free-bets") for top in ("com", "net", "org")]
PAGE_HOSTS = [f"{name}.example.{top}" for name in ("ththan", "therhe", "ththnd") for top in ("com", "net", "org")]
PAGE_FOLDERS = ["en", "fr", "es"]
PAGE_STEP, PAGE_END = 7, 60_000


def listed_urls(spark: SparkSession) -> DataFrame:
    """The canonical URLs that the registered query blocks: whole hosts, and every seventh page of some folders."""
    hosts = spark.createDataFrame([(u,) for u in LISTED_HOSTS], "url string")
    folders = spark.createDataFrame([(f"{h}/{f}/",) for h in PAGE_HOSTS for f in PAGE_FOLDERS], "folder string")
    numbered = folders.select("folder", F.explode(F.sequence(F.lit(0), F.lit(PAGE_END - 1), F.lit(PAGE_STEP))).alias("k"))
    return hosts.unionByName(numbered.select(F.concat("folder", F.col("k").cast("string")).alias("url")))


def parts(url: Column) -> tuple[Column, Column]:
    """Host and path of a URL; both empty without `://` or for null."""
    rest = F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1)
    host = F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    lower = F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.coalesce(lower, F.lit("")), F.coalesce(path, F.lit(""))


def canonical(host: Column, path: Column) -> Column:
    """A URL's canonical key: host without leading www. and trailing dot or port, path without trailing slashes."""
    bare = F.regexp_replace(F.regexp_replace(host, r"^www\.", ""), r"\.?(?::[0-9]*)?\z", "")
    return F.concat(bare, F.regexp_replace(path, r"/+\z", ""))


def rule_table(spark: SparkSession, rules: list[tuple[str, str, str]]) -> DataFrame:
    return spark.createDataFrame([(f"{host}{path}", host, path, verdict) for verdict, host, path in rules], "rule string, rule_host string, rule_path string, verdict string")


def bloom_blocks(keys: DataFrame, key: str, n_blocks: int) -> DataFrame:
    """A row a block that has bits: block, w0..w7."""
    h = F.xxhash64(key)
    touched = keys.select(_block(h, n_blocks).alias("block"), *[_bit(h, w).alias(f"w{w}") for w in range(8)])
    return touched.groupBy("block").agg(*[F.bit_or(f"w{w}").alias(f"w{w}") for w in range(8)])


def _block(h: Column, n_blocks: int) -> Column:
    return F.pmod(F.shiftrightunsigned(h, 32), F.lit(n_blocks)).cast("int")


def _bit(h: Column, word: int) -> Column:
    """The bit of one word: five bits of the hash, mixed with an odd salt of the word's own."""
    # The salts of the split block Bloom filter that Parquet's public format document gives.
    salts = [0x47B6137B, 0x44974D91, 0x8824AD5B, 0xA2B7289D, 0x705495C7, 0x2DF1424B, 0x9EFC4947, 0x5C6BFB31]
    mixed = F.shiftright((h.bitwiseAND(F.lit(0xFFFFFFF)) * F.lit(salts[word])).bitwiseAND(F.lit(0xFFFFFFFF)), 27)
    return F.call_function("shiftleft", F.lit(1).cast("long"), mixed.cast("int"))


def might_hold(asked: DataFrame, key: str, listed: DataFrame, listed_key: str, broadcast_blocks: int = BROADCAST_BLOCKS) -> DataFrame:
    """Rows of asked whose key passes the blocked Bloom filter of listed; no row that is listed is lost."""
    n = listed.count()
    n_blocks = max(1, -(-n * BITS_PER_KEY // BLOCK_BITS))
    blocks = bloom_blocks(listed, listed_key, n_blocks)
    blocks = F.broadcast(blocks) if n_blocks <= broadcast_blocks else blocks
    h = F.xxhash64(key)
    probe = asked.withColumn("__block", _block(h, n_blocks)).join(blocks.withColumnRenamed("block", "__block"), "__block")
    met = None
    for w in range(8):
        one = F.col(f"w{w}").bitwiseAND(_bit(h, w)) != 0
        met = one if met is None else met & one
    return probe.where(met).drop("__block", *[f"w{w}" for w in range(8)])


def _keys(lengths: list[int], rule_labels: int, listed_labels: int, host: Column, path: Column) -> Column:
    """Every key under which the list may hold a (host, path)."""

    def suffixes(h: Column, labels: int) -> Column:
        words = F.split(h, r"\.")
        depths = F.sequence(F.lit(1), F.least(F.lit(labels), F.size(words)))
        return F.transform(depths, lambda k: F.array_join(F.slice(words, -k, k), ".")) if labels else F.array().cast("array<string>")

    prefixes = F.array_compact(F.array(*[F.when(F.length(path) >= n, F.substring(path, 1, n)) for n in lengths])) if lengths else F.array().cast("array<string>")
    of_rules = F.flatten(F.transform(suffixes(host, rule_labels), lambda h: F.transform(prefixes, lambda p: F.concat(F.lit("r "), h, F.lit(" "), p))))
    of_hosts = F.transform(suffixes(canonical(host, F.lit("")), listed_labels), lambda h: F.concat(F.lit("u "), h))
    return F.array_distinct(F.concat(of_rules, of_hosts, F.array(F.concat(F.lit("u "), canonical(host, path)))))


def judge(pages: DataFrame, rules: DataFrame, listed: DataFrame, url_col: str = "url", broadcast_blocks: int = BROADCAST_BLOCKS, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """pages with host, path, rule, listed (the entry that fits, or null) and verdict (allow or block) added.

    rules: rule, rule_host, rule_path, verdict, the longest rule wins, equal lengths go to the smaller rule; listed:
    url (canonical; entries block, the longest is told), a rule that fits goes before it. Null urls and urls without `://`
    have empty host and path, and are allowed unless a rule or entry is empty too; very long urls are read whole. Null rules
    and entries are ignored, repeated ones count once. Repeated pages keep their rows, no pages give no rows; columns of
    those names in pages are replaced.
    """
    host, path = parts(pages[url_col].cast("string"))
    pages = pages.drop("host", "path", "rule", "listed", "verdict").withColumns({"host": host, "path": path})
    rules = rules.dropna(subset=["rule_host", "rule_path", "verdict"])
    listed = listed.where("url is not null")
    entry = lambda size, rule, verdict, from_list: F.struct((-size).alias("size"), rule.alias("rule"), verdict.alias("verdict"), F.lit(from_list).alias("listed")).alias("entry")
    entries = rules.select(F.concat(F.lit("r "), "rule_host", F.lit(" "), "rule_path").alias("key"), entry(F.length("rule"), F.col("rule"), F.col("verdict"), False))
    entries = entries.unionByName(listed.select(F.concat(F.lit("u "), "url").alias("key"), entry(F.length("url"), F.col("url"), F.lit("block"), True)))
    entries = entries.groupBy("key").agg(F.min("entry").alias("entry"))
    labels = lambda h: F.coalesce(F.max(F.size(F.split(h, r"\."))), F.lit(0))
    shape = rules.agg(F.collect_set(F.length("rule_path")).alias("lengths"), labels("rule_host").alias("labels")).first()
    of_hosts = listed.where(~F.contains("url", F.lit("/"))).agg(labels("url").alias("labels")).first()["labels"]
    keys = _keys(sorted(shape["lengths"]), shape["labels"], of_hosts, F.col("host"), F.col("path"))
    asked = pages.select("host", "path").distinct().select("host", "path", F.explode(keys).alias("key"))
    hits = might_hold(asked, "key", entries, "key", broadcast_blocks).join(entries, "key")
    best = lambda wanted: F.min(F.when(wanted, F.col("entry")))
    verdicts = hits.groupBy("host", "path").agg(best(~F.col("entry.listed")).alias("r"), best(F.col("entry.listed")).alias("u"))
    verdicts = materialise(verdicts.select("host", "path", F.col("r.rule").alias("rule"), F.col("u.rule").alias("listed"), F.coalesce("r.verdict", "u.verdict").alias("verdict")), "verdicts")
    size = verdicts.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.length("host") + F.length("path")), F.lit(0)).alias("chars")).first()
    if size["n"] <= broadcast_rows and size["chars"] <= 100 * broadcast_rows:
        verdicts = F.broadcast(verdicts)
    return pages.join(verdicts, ["host", "path"], "left").withColumn("verdict", F.coalesce("verdict", F.lit("allow")))
