"""URL filter: a blocked Bloom filter of listed canonical URLs, then an exact hash join.

A list entry is a canonical `host/path` string. It covers its host and all subdomains, for paths
that start with its path. Every URL is expanded into the entries that could cover it (host suffix
times path prefix of a listed length); the Bloom filter lets few of these through, and the join on
the entry itself removes the false positives. The longest covering entry decides.

Edge cases: a null URL, or one without `://`, has empty host and path and is covered by nothing; an
empty list covers nothing; repeated list entries count once, block before allow; of covering entries of
equal length the greater string decides; a URL of any length is judged whole, and has as many
candidates as its host has labels times the listed path lengths; an empty table of pages gives no rows; repeated rows
are judged alike; extra columns pass through, and those named like a result column are replaced by it.
"""

from __future__ import annotations

import string

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Odd multipliers, one for each 32-bit word of a block.
SALTS = [0x47B6137B, 0x44974D91, 0x8824AD5B, 0xA2B7289D, 0x705495C7, 0x2DF1424B, 0x9EFC4947, 0x5C6BFB31]
BITS_PER_KEY = 16
#: Bits of a hash that choose the bit within a word; their product with a salt stays below 2**63.
LOW = 0x7FFFFFFF


def host_of(url: Column) -> Column:
    """Between the first `://` and the next `/`, `?`, `#` or the end, A-Z lower-cased; else empty."""
    at = F.locate("://", url)
    host = F.regexp_extract(F.substring(url, at + 3, F.length(url)), r"^[^/?#]*", 0)
    return F.coalesce(F.when(at > 0, F.translate(host, string.ascii_uppercase, string.ascii_lowercase)), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host, up to `?`, `#` or the end; empty if there is no host part."""
    at = F.locate("://", url)
    path = F.regexp_extract(F.substring(url, at + 3, F.length(url)), r"^[^/?#]*([^?#]*)", 1)
    return F.coalesce(F.when(at > 0, path), F.lit(""))


def _block(blocks: int) -> Column:
    return F.expr(f"pmod(shiftrightunsigned(h, 32), {blocks}L)")


def _masks() -> list[Column]:
    """The bit that the hash in column h sets in each word of its block."""
    return [F.expr(f"shiftleft(1L, cast(shiftrightunsigned(((h & {LOW}L) * {s}L) & 4294967295L, 27) AS int))") for s in SALTS]


def bloom_blocks(keys: DataFrame, key: str, blocks: int) -> DataFrame:
    """One row per block that holds a key: block, w0 .. w7."""
    hashed = keys.select(F.xxhash64(key).alias("h"))
    marked = hashed.select(_block(blocks).alias("block"), *[m.alias(f"w{i}") for i, m in enumerate(_masks())])
    return marked.groupBy("block").agg(*[F.bit_or(f"w{i}").alias(f"w{i}") for i in range(8)])


def _tester(table: np.ndarray):
    """Array of key hashes -> positions of those that may be listed."""
    salts = np.array(SALTS, np.uint64)

    def test(hashes: pd.Series) -> pd.Series:
        sizes = hashes.map(len).to_numpy()
        if not sizes.sum():
            return pd.Series([[]] * len(hashes))
        h = np.concatenate([np.asarray(x, np.int64) for x in hashes]).view(np.uint64)
        with np.errstate(over="ignore"):
            bit = (((h & np.uint64(LOW))[:, None] * salts) & np.uint64(0xFFFFFFFF)) >> np.uint64(27)
        word = table[((h >> np.uint64(32)) % np.uint64(len(table))).astype(np.int64)]
        hit = (((word >> bit) & np.uint64(1)) == 1).all(axis=1)
        return pd.Series([np.flatnonzero(x).tolist() for x in np.split(hit, np.cumsum(sizes)[:-1])])

    return F.pandas_udf(test, "array<int>")


def filter_urls(pages: DataFrame, listed: DataFrame, url: str = "url", max_filter_bytes: int = 64 << 20) -> DataFrame:
    """Add host, path, rule and verdict to every row of `pages`.

    `listed` has entry (canonical `host/path`) and action (`block` or `allow`) and may have any size:
    a filter of up to `max_filter_bytes` is sent to every task; a larger one stays a table that is
    joined by block. rule is the longest entry that covers the URL, verdict its action. A URL without
    such an entry passes the filter, so its verdict is `allow`.
    """
    spark = pages.sparkSession
    at = F.locate("/", F.col("entry"))
    listed = (
        listed.where(F.col("entry").isNotNull() & (F.locate("/", "entry") > 0))
        .groupBy("entry").agg(F.max("action").alias("action"))
        .withColumn("path_chars", F.length("entry") - at + 1)
    )
    size = listed.agg(F.count(F.lit(1)).alias("n"), F.collect_set("path_chars").alias("lengths")).first()
    blocks = max(1, -(-size["n"] * BITS_PER_KEY // 256))
    lengths = F.array(*[F.lit(x) for x in sorted(size["lengths"])]).cast("array<int>")

    judged = pages.drop("host", "path", "rule", "verdict").withColumns({"host": host_of(F.col(url)), "path": path_of(F.col(url))})
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    prefixes = F.transform(F.filter(lengths, lambda k: k <= F.length("path")), lambda k: F.substring(F.col("path"), F.lit(1), k))
    keys = F.flatten(F.transform(suffixes, lambda s: F.transform(prefixes, lambda p: F.concat(s, p))))
    asked = judged.where(F.length("host") > 0).select("host", "path").distinct().withColumn("keys", keys)

    table = bloom_blocks(listed, "entry", blocks)
    if blocks * 64 <= max_filter_bytes:
        filled = np.zeros((blocks, 8), np.uint64)
        made = table.toArrow()  # at most `blocks` rows, within max_filter_bytes
        filled[made["block"].to_numpy()] = np.stack([made[f"w{i}"].to_numpy() for i in range(8)], axis=1).view(np.uint64)
        test = _tester(filled)
        passed = test(F.transform("keys", lambda k: F.xxhash64(k)))
        possible = asked.withColumn("at", F.explode(passed)).select("host", "path", F.get("keys", F.col("at")).alias("entry"))
    else:
        one = asked.select("host", "path", F.explode("keys").alias("entry")).withColumn("h", F.xxhash64("entry"))
        fits = [(F.col(f"w{i}").bitwiseAND(m) != 0) for i, m in enumerate(_masks())]
        held = one.withColumn("block", _block(blocks)).join(table, "block")
        for fit in fits:
            held = held.where(fit)
        possible = held.select("host", "path", "entry")
    exact = (
        possible.join(listed, "entry")
        .groupBy("host", "path")
        .agg(F.max(F.struct(F.length("entry").alias("chars"), "entry", "action")).alias("best"))
        .select("host", "path", F.col("best.entry").alias("rule"), F.col("best.action").alias("verdict"))
    )
    return judged.join(exact, ["host", "path"], "left").withColumn("verdict", F.coalesce("verdict", F.lit("allow")))


RULES = [("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow")]


def op1_url_filter(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    listed = spark.createDataFrame(RULES, "entry string, action string")
    return filter_urls(pages, listed).select("page_id", "host", "path", "rule", "verdict")


ORACLE = """
WITH r(entry, rhost, rpath, action) AS (VALUES ('net/', 'net', '/', 'block'), ('example.net/en/', 'example.net', '/en/', 'allow'),
  ('example.com/de/', 'example.com', '/de/', 'block'), ('org/fr/', 'org', '/fr/', 'allow')),
cut AS (SELECT page_id, url, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
parts AS (SELECT page_id, url, translate(regexp_extract(rest, '^[^/?#]*', 0), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM cut),
fit AS (SELECT p.page_id, p.host, p.path, r.entry, r.action, row_number() OVER (PARTITION BY p.page_id, p.url ORDER BY length(r.entry) DESC NULLS LAST, r.entry) AS k
  FROM parts p LEFT JOIN r ON (p.host = r.rhost OR ends_with(p.host, '.' || r.rhost)) AND starts_with(p.path, r.rpath))
SELECT page_id, host, path, entry AS rule, coalesce(action, 'allow') AS verdict FROM fit WHERE k = 1
"""
