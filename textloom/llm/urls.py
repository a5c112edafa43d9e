"""URL filters, native: a blocked Bloom filter of listed canonical URLs before an exact hash join.

Canonical: host without leading www., then path without trailing slashes; no scheme, query or fragment. The filter is made of
blocks of 512 bits, one for every 16 listed URLs up to BLOCKS of them (16 MB: the bound that lets it be broadcast; about 4 million
URLs at full strength); an URL sets eight bits of one block. URLs that pass are joined exactly, which removes false positives; a
longer list makes the filter pass more rows and changes no verdict. Two branches read id and URL once each: rows that the filter
clears never meet a shuffle.

Null URLs and those without :// have empty host and path, and are never listed. Every row gives a row, so equal rows and repeated
ids give equal ones; of rules that fit equally long the one given last counts; an empty table or list is no special case; other
columns, whatever their names, are not read; an URL of any length is judged whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize

#: (verdict, host, path), the longest that fits wins.
RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/")]
BLOCKS, LEAST, PER_BLOCK = 1 << 18, 1 << 6, 16
WORDS = 8
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def parts(url: Column) -> tuple[Column, Column]:
    url = F.coalesce(url, F.lit(""))
    pattern = r"://([^/?#]*)([^?#]*)"
    return F.translate(F.regexp_extract(url, pattern, 1), _UPPER, _LOWER), F.regexp_extract(url, pattern, 2)


def canonical(host: Column, path: Column) -> Column:
    return F.when(host != "", F.concat(F.regexp_replace(host, r"^www\.", ""), F.regexp_replace(path, "/+$", "")))


def _rule(host: Column, path: Column, rules) -> tuple[Column, Column]:
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for said, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):  # the longest is tested first
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        name, verdict = F.when(fits, h + p).otherwise(name), F.when(fits, said).otherwise(verdict)
    return name, verdict


def blocks_for(n: int) -> int:
    """A power of two of blocks for a list of n URLs."""
    return min(BLOCKS, max(LEAST, 1 << (n // PER_BLOCK).bit_length()))


def _place(canon: Column, blocks: int) -> tuple[Column, list[Column]]:
    """Block number, and the word masks: one bit in each of the eight words of a block."""
    h = F.xxhash64(canon)
    bits = F.xxhash64(canon, F.lit("bits"))
    return F.pmod(h, F.lit(blocks)).cast("int"), [F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(bits, 6 * k).bitwiseAND(F.lit(63)).cast("int")) for k in range(WORDS)]


def bloom(listed: DataFrame, blocks: int) -> DataFrame:
    """block, w0..w7 of the filter of column canon."""
    block, masks = _place(F.col("canon"), blocks)
    return listed.select(block.alias("block"), *(m.alias(f"w{k}") for k, m in enumerate(masks))).groupBy("block").agg(*(F.bit_or(f"w{k}").alias(f"w{k}") for k in range(WORDS)))


def judge(pages: DataFrame, listed: DataFrame, rules=RULES) -> DataFrame:
    """page_id, host, path, rule, verdict, listed for every row of pages. listed: column canon of canonical URLs to block; it is written once, distinct, and counted."""
    exact = materialize(listed.where("canon is not null").select("canon").distinct())
    blocks = blocks_for(exact.count())
    host, path = parts(F.col("url"))
    rows = pages.select("page_id", "url").select("page_id", host.alias("host"), path.alias("path"))
    name, said = _rule(F.col("host"), F.col("path"), rules)
    rows = rows.select("page_id", "host", "path", name.alias("rule"), said.alias("said"), canonical(F.col("host"), F.col("path")).alias("canon"))
    block, masks = _place(F.col("canon"), blocks)
    filt = bloom(exact, blocks)  # BLOCKS rows at most
    tested = rows.withColumn("block", block).join(F.broadcast(filt), "block", "left")
    passes = F.lit(True)
    for k, m in enumerate(masks):
        passes = passes & (F.col(f"w{k}").bitwiseAND(m) != 0)
    tested = tested.withColumn("maybe", F.coalesce(passes, F.lit(False)) & F.col("canon").isNotNull())
    exact = exact.withColumn("listed", F.lit(True))
    hits = tested.where("maybe").select("page_id", "host", "path", "rule", "said", "canon").join(exact, "canon", "left").select("page_id", "host", "path", "rule", "said", F.coalesce("listed", F.lit(False)).alias("listed"))
    clear = tested.where("not maybe").select("page_id", "host", "path", "rule", "said", F.lit(False).alias("listed"))
    verdict = F.coalesce("said", F.when(F.col("listed"), "block").otherwise("allow"))
    return hits.union(clear).select("page_id", "host", "path", "rule", verdict.alias("verdict"), "listed")


def every_twentieth(pages: DataFrame) -> DataFrame:
    """A list for the query, as the tables hold none: the canonical URLs of pages whose id is divisible by 20."""
    host, path = parts(F.col("url"))
    return pages.where("page_id % 20 = 0").select(canonical(host, path).alias("canon"))


SQL = r"""
with p as (select page_id, coalesce(url, '') as u from pages),
q as (select page_id, translate(regexp_extract(u, '://([^/?#]*)([^?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
             regexp_extract(u, '://([^/?#]*)([^?#]*)', 2) as path from p),
r as (select *, case when host <> '' then regexp_replace(host, '^www\.', '') || regexp_replace(path, '/+$', '') end as canon,
  case when (host = 'www.example.com' or ends_with(host, '.www.example.com')) and starts_with(path, '/en/') then 'www.example.com/en/'
       when (host = 'example.com' or ends_with(host, '.example.com')) and starts_with(path, '/en/') then 'example.com/en/'
       when (host = 'net' or ends_with(host, '.net')) and starts_with(path, '/es/') then 'net/es/'
       when (host = 'net' or ends_with(host, '.net')) and starts_with(path, '/fr/') then 'net/fr/'
       when (host = 'com' or ends_with(host, '.com')) and starts_with(path, '/') then 'com/' end as rule from q),
l as (select distinct canon from r where page_id % 20 = 0 and canon is not null)
select page_id, host, path, rule,
  case when rule in ('www.example.com/en/', 'com/') then 'allow' when rule is not null then 'block' when l.canon is not null then 'block' else 'allow' end as verdict,
  l.canon is not null as listed
from r left join l on r.canon = l.canon
"""
