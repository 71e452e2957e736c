"""URL filters with Spark expressions only: rules by host and path, then a list of canonical URLs.

A rule (action, host, path) fits a URL whose host is the rule's or a subdomain of it and whose path starts with the
rule's; the longest rule that fits decides. Where none fits, the list decides: it is a blocked Bloom filter first,
then an exact hash join. The filter has one row for each block of 256 bits; a URL's hash names a block and one bit in
each of its eight 32-bit words. The number of blocks follows the list up to MOST_BLOCKS, so what is broadcast is at most
that many rows of five numbers, however long the list; beyond it more URLs pass the filter, and none is lost. Only those
that pass are shuffled for the exact join. A canonical URL with more than one in HEAVY of these rows is one of HEAVY at
most: such rows meet a broadcast table of that bound, the others are dealt by their canonical URL.

Defined cases: a null URL or one without "://" has an empty host and path, no canonical form and fits no rule, so it is
allowed; an empty list blocks nothing; nulls and repeats in the list count for nothing; URLs of any length are taken
whole; every repeated row is judged; an empty table gives an empty table; other columns are kept, but those named host,
path, rule or verdict are replaced."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import written

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
ADDED = ("host", "path", "rule", "verdict")

#: Bits of the filter for each listed URL, the most blocks of 256 bits, and the share that makes a URL heavy.
BITS, MOST_BLOCKS, HEAVY = 16, 1 << 17, 1024

#: Parameters of a query that don't change the page.
TRACKING = r"^(utm_[^=]*|ref|gclid|fbclid)(=|\z)|^\z"


class Rule(NamedTuple):
    action: str
    host: str
    path: str

    @classmethod
    def of(cls, action: str, text: str) -> Rule:
        host, slash, path = text.partition("/")
        return cls(action, host, slash + path)

    def fits(self, host: Column, path: Column) -> Column:
        return ((host == self.host) | host.endswith(f".{self.host}")) & path.startswith(self.path)


def lower_ascii(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def after_scheme(url: Column) -> Column:
    """What follows the first "://"; empty without it."""
    at = F.instr(F.coalesce(url, F.lit("")), "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")


def host_of(url: Column) -> Column:
    return lower_ascii(F.regexp_extract(after_scheme(url), r"^[^/?#]*", 0))


def path_of(url: Column) -> Column:
    return F.regexp_extract(after_scheme(url), r"^[^/?#]*([^?#]*)", 1)


def canonical(url: Column) -> Column:
    """Host without user, "www.", default port and final dot, then the path without repeated and final slashes, then
    the query's parameters in order, those of TRACKING left out. Scheme and fragment don't count."""
    host = F.regexp_replace(F.regexp_replace(host_of(url), r"(?s)^.*@", ""), r"^www\.|\.?(:(80|443)?)?\z", "")
    path = F.regexp_replace(F.regexp_replace(path_of(url), "//+", "/"), r"/\z", "")
    asked = F.regexp_extract(after_scheme(url), r"^[^?#]*\?([^#]*)", 1)
    kept = F.array_join(F.array_sort(F.filter(F.split(asked, "&"), lambda p: ~p.rlike(TRACKING))), "&")
    return F.when(F.instr(url, "://") > 0, F.concat(host, path, F.when(kept == "", "").otherwise(F.concat(F.lit("?"), kept))))


def ruled(host: Column, path: Column, rules: list[Rule], said) -> Column:
    """said(rule) of the longest rule that fits, the longer host first among equals; null without one."""
    order = sorted(rules, key=lambda r: (-len(r.host + r.path), -len(r.host), r))
    out = F.lit(None).cast("string")
    for rule in reversed(order):
        out = F.when(rule.fits(host, path), F.lit(said(rule))).otherwise(out)
    return out


def place(key: Column, blocks: int) -> Column:
    return F.xxhash64(key).bitwiseAND(F.lit(blocks - 1))


def words(key: Column) -> list[Column]:
    """Four 64-bit masks: one bit in each of eight 32-bit words."""
    h = F.xxhash64(key, F.lit("bits"))
    bit = lambda i: F.call_function("shiftleft", F.lit(1).cast("long"), (F.shiftrightunsigned(h, 5 * i).bitwiseAND(F.lit(31)) + 32 * (i % 2)).cast("int"))
    return [bit(2 * j).bitwiseOR(bit(2 * j + 1)) for j in range(4)]


def bloom(listed: DataFrame, n: int, bits: int = BITS, most_blocks: int = MOST_BLOCKS) -> tuple[DataFrame, int]:
    """The filter of n keys (column key): block, w0 to w3, a row for each block with a key; and the number of blocks, a power of two."""
    blocks = 1
    while blocks < most_blocks and blocks * 256 < n * bits:
        blocks *= 2
    masks = listed.select(place(F.col("key"), blocks).alias("block"), *[w.alias(f"w{j}") for j, w in enumerate(words(F.col("key")))])
    return masks.groupBy("block").agg(*[F.bit_or(f"w{j}").alias(f"w{j}") for j in range(4)]), blocks


def passing(rows: DataFrame, found: DataFrame, blocks: int) -> DataFrame:
    """rows (row, key) with passes: whether the filter may hold the key. The filter is broadcast: MOST_BLOCKS rows at most."""
    asked = rows.select("*", place(F.col("key"), blocks).alias("block"), *[w.alias(f"m{j}") for j, w in enumerate(words(F.col("key")))])
    hit = F.lit(True)
    for j in range(4):
        hit = hit & (F.col(f"w{j}").bitwiseAND(F.col(f"m{j}")) == F.col(f"m{j}"))
    return asked.join(F.broadcast(found), "block", "left").select(*rows.columns, (F.col("key").isNotNull() & F.coalesce(hit, F.lit(False))).alias("passes"))


def confirmed(rows: DataFrame, listed: DataFrame, heavy: int = HEAVY) -> DataFrame:
    """rows with listed: whether the key is one of the list's, by a hash join. Keys with more than one in heavy of the
    rows, fewer than heavy of them, meet a broadcast table."""
    often = rows.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") * heavy > rows.count()).select("key")
    known = listed.select("key", F.lit(True).alias("listed"))
    most = often.join(known, "key", "left").select("key", F.coalesce("listed", F.lit(False)).alias("heavy"))
    marked = rows.join(F.broadcast(most), "key", "left")
    hot = marked.where("heavy is not null").select(*rows.columns, F.col("heavy").alias("listed"))
    cold = marked.where("heavy is null").select(rows.columns).join(known.hint("shuffle_hash"), "key", "left")
    return hot.unionByName(cold.select(*rows.columns, F.coalesce("listed", F.lit(False)).alias("listed")))


def filter_urls(pages: DataFrame, spark: SparkSession, listed: DataFrame, rules: list[Rule], url: str = "url", heavy: int = HEAVY, most_blocks: int = MOST_BLOCKS) -> DataFrame:
    """pages with host, path, rule (the text of the rule that decides, else null) and verdict: the rule's action,
    else block for a URL whose canonical form is that of a URL in the list (column url), else allow."""
    keys = written(listed.select(canonical(F.col("url")).alias("key")).where("key is not null").distinct(), spark, "listed-urls")
    found, blocks = bloom(keys, keys.count(), most_blocks=most_blocks)
    split = pages.select(F.struct(*[f"`{c}`" for c in pages.columns]).alias("row"), host_of(F.col(f"`{url}`")).alias("host"), path_of(F.col(f"`{url}`")).alias("path"))
    at = (F.col("host"), F.col("path"))
    judged = split.select(
        "*", ruled(*at, rules, lambda r: r.host + r.path).alias("rule"), ruled(*at, rules, lambda r: r.action).alias("ruled"),
    ).withColumn("key", F.when(F.col("rule").isNull(), canonical(F.col(f"row.`{url}`"))))
    asked = passing(judged, found, blocks)
    sure = asked.where("not passes").select("row", "host", "path", "rule", F.coalesce("ruled", F.lit("allow")).alias("verdict"))
    maybe = written(asked.where("passes").select("row", "host", "path", "rule", "key"), spark, "possible-urls")
    checked = confirmed(maybe, keys, heavy).select("row", "host", "path", "rule", F.when(F.col("listed"), "block").otherwise("allow").alias("verdict"))
    kept = [F.col(f"row.`{c}`").alias(c) for c in pages.columns if c not in ADDED]
    return sure.unionByName(checked).select(*kept, *ADDED)
