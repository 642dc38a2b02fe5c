"""URL filter: host and path rules, and a list of canonical URLs.

A blocked Bloom filter of the listed URLs lets a page's URL through if it may be
listed; an exact hash join with the list removes the false positives. Each URL
sets its bits within one block of 512, so a look takes one cache line. The
filter has a size bound; a list beyond it only lets more URLs through to the
join, which decides.
"""

from __future__ import annotations

import string
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from trunkwatch.llm.common import stored, table
from trunkwatch.sources.tables import named

#: The rules of the query, a host and a path with what they say.
RULES = {"net/": "block", "example.net/en/": "allow", "example.com/de/": "block", "org/fr/": "allow"}
#: Words in a host's name that put its URLs on the query's list.
LISTED_WORDS = ("ads", "adult", "bets", "casino", "pills", "poker", "porn", "spam")
#: Parameters that do not tell a page.
TRACKING = r"^(utm_[^=]*|ref|fbclid|gclid)(=|$)"

_LISTED_HOST = rf"(^|[.-])({'|'.join(LISTED_WORDS)})([.-]|$)"
_PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"
_QUERY = r"(?s)^.*?://[^?#]*\?([^#]*)"

#: Bits for each listed URL, bits set in its block, and blocks at most (16 MB).
BITS_PER_URL, HASHES, MOST_BLOCKS = 12, 6, 1 << 18


def host(url: Column) -> Column:
    """From the first ``://`` up to the path, A-Z lower-cased; empty without one."""
    found = F.regexp_extract(F.coalesce(url, F.lit("")), _PARTS, 1)
    return F.translate(found, string.ascii_uppercase, string.ascii_lowercase)


def path(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), _PARTS, 2)


def canonical(url: Column) -> Column:
    """Host and path without what does not tell a page, and the telling parameters in order.

    Scheme, ``www.`` and ``m.``, default ports, fragments, ``index``, ``.html``,
    closing slashes and tracking parameters do not tell. A URL without a host
    is empty.
    """
    own_host = F.regexp_replace(F.regexp_replace(host(url), r"^(www|m)\.", ""), ":(80|443)$", "")
    own_path = F.regexp_replace(path(url), r"(/index)?([.]html?)?/*$", "")
    parameters = F.split(F.regexp_extract(F.coalesce(url, F.lit("")), _QUERY, 1), "&")
    telling = F.array_sort(F.filter(parameters, lambda x: (x != "") & ~x.rlike(TRACKING)))
    query = F.when(F.size(telling) > 0, F.concat(F.lit("?"), F.array_join(telling, "&"))).otherwise(F.lit(""))
    return F.when(own_host == "", F.lit("")).otherwise(F.concat(own_host, own_path, query))


def rule_of(own_host: Column, own_path: Column, rules: dict[str, str]) -> Column:
    """The longest rule that fits a host and path, else null.

    A rule fits its host and all its subdomains where the path starts with the
    rule's. Of rules of one length that fit, the first by name counts.
    """
    found = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (len(r), [-ord(c) for c in r])):
        of_host, slash, rest = rule.partition("/")
        fits = (own_host == of_host) | own_host.endswith("." + of_host)
        found = F.when(fits & own_path.startswith(slash + rest), F.lit(rule)).otherwise(found)
    return found


def _bits(hashed: np.ndarray, blocks: int) -> tuple[np.ndarray, np.ndarray]:
    """(block, bits within it) of each hash."""
    h = hashed.view(np.uint64)
    block = ((h >> np.uint64(32)) % np.uint64(blocks)).astype(np.int64)
    step = h * np.uint64(0x9E3779B97F4A7C15)
    return block, np.stack([(step >> np.uint64(9 * i)) & np.uint64(511) for i in range(1, HASHES + 1)], axis=1)


def bloom_filter(listed: DataFrame, key: str = "canonical") -> np.ndarray:
    """The blocks (8 words each) of the distinct URLs of ``listed``, ored together in Spark."""
    n = listed.count()
    blocks = int(min(MOST_BLOCKS, max(1, -(-n * BITS_PER_URL // 512))))

    def bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            block, bit = _bits(batch.column(0).to_numpy(), blocks)
            words = np.zeros((len(block), 8), np.uint64)
            for b in bit.T:
                words[np.arange(len(block)), b >> np.uint64(6)] |= np.uint64(1) << (b & np.uint64(63))
            yield pa.RecordBatch.from_arrays([pa.array(block), *(pa.array(w.view(np.int64)) for w in words.T.copy())],
                                             names=["block", *(f"w{i}" for i in range(8))])

    words = [f"w{i}" for i in range(8)]
    rows = listed.select(F.xxhash64(key)).mapInArrow(bits, "block long, " + ", ".join(f"{w} long" for w in words))
    found = np.zeros((blocks, 8), np.uint64)
    for row in rows.groupBy("block").agg(*[F.bit_or(w).alias(w) for w in words]).toLocalIterator():
        found[row[0]] = np.array(row[1:], np.int64).view(np.uint64)
    return found


def may_be_listed(filter_blocks: np.ndarray, hashed: np.ndarray) -> np.ndarray:
    block, bit = _bits(np.ascontiguousarray(hashed), len(filter_blocks))
    hit = np.ones(len(block), bool)
    for b in bit.T:
        hit &= (filter_blocks[block, b >> np.uint64(6)] >> (b & np.uint64(63))) & np.uint64(1) == 1
    return hit


def judge(pages: DataFrame, listed: DataFrame, rules: dict[str, str], page_id: str = "page_id",
          url: str = "url") -> DataFrame:
    """``page_id, host, path, rule, verdict, canonical, listed`` for every row.

    The longest rule that fits decides; without one, URLs whose canonical form
    is in ``listed`` (a column ``canonical``) are blocked, others allowed. A null
    URL, or one without ``://``, has an empty host and path and is allowed. Rows
    that repeat are judged alike; an empty table gives no rows; an empty list
    blocks nothing. Other columns are not read.
    """
    known = stored(listed.where("canonical <> ''").select("canonical").distinct(), "listed-urls")
    blocks = bloom_filter(known)
    own = named(url).cast("string")
    parts = pages.select(named(page_id).cast("long").alias("page_id"), host(own).alias("host"),
                         path(own).alias("path"), canonical(own).alias("canonical"))
    ruled = parts.select("page_id", "host", "path", rule_of(F.col("host"), F.col("path"), rules).alias("rule"),
                         "canonical", F.xxhash64("canonical").alias("hashed"))

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hit = may_be_listed(blocks, batch.column("hashed").to_numpy())
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(hit)], names=[*batch.schema.names[:5], "may_be"])

    kinds = "page_id long, host string, path string, rule string, canonical string, may_be boolean"
    looked = stored(ruled.mapInArrow(look, kinds), "looked-up-urls")
    hits = looked.where("may_be").join(known.withColumn("listed", F.lit(True)).hint("shuffle_hash"), "canonical", "left")
    both = looked.where("not may_be").withColumn("listed", F.lit(False)).unionByName(
        hits.withColumn("listed", F.coalesce("listed", F.lit(False))))
    said = F.lit(None).cast("string")
    for rule, verdict in rules.items():
        said = F.when(F.col("rule") == rule, F.lit(verdict)).otherwise(said)
    own_verdict = F.when(F.col("listed"), F.lit("block")).otherwise(F.lit("allow"))
    return both.select("page_id", "host", "path", "rule", F.coalesce(said, own_verdict).alias("verdict"),
                       "canonical", "listed")


def listed_by_host(pages: DataFrame, url: str = "url") -> DataFrame:
    """``canonical`` URLs of the pages on hosts whose name has a listed word."""
    own = named(url).cast("string")
    return pages.where(host(own).rlike(_LISTED_HOST)).select(canonical(own).alias("canonical"))


def listed_by_digest(pages: DataFrame, url: str = "url") -> DataFrame:
    """``canonical`` URLs of pages, those one in sixteen whose MD5 begins with the digit 0.

    Stands for a list of single URLs: nothing but the whole canonical URL tells
    whether it is on it, its host may have others that are not.
    """
    every = pages.select(canonical(named(url).cast("string")).alias("canonical"))
    return every.where(F.md5(F.col("canonical").cast("binary")) < "1")


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's rules over all ``pages``; the list is that of :func:`listed_by_digest`."""
    pages = table(spark, sf_dir, "pages")
    return judge(pages, listed_by_digest(pages), RULES)


OP6_SQL = rf"""
WITH parts AS (
    SELECT page_id, coalesce(url, '') AS u,
           translate(regexp_extract(coalesce(url, ''), '{_PARTS}', 1),
                     '{string.ascii_uppercase}', '{string.ascii_lowercase}') AS host,
           regexp_extract(coalesce(url, ''), '{_PARTS}', 2) AS path
    FROM pages),
telling AS (
    SELECT *, list_sort([x FOR x IN string_split(regexp_extract(u, '{_QUERY}', 1), '&')
                         IF x <> '' AND NOT regexp_matches(x, '{TRACKING}')]) AS q
    FROM parts),
named AS (
    SELECT page_id, host, path, CASE WHEN host = '' THEN '' ELSE
               regexp_replace(regexp_replace(host, '^(www|m)\.', ''), ':(80|443)$', '')
               || regexp_replace(path, '(/index)?([.]html?)?/*$', '')
               || CASE WHEN len(q) > 0 THEN '?' || array_to_string(q, '&') ELSE '' END END AS canonical,
           CASE WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/de/') THEN 'example.com/de/'
                WHEN (host = 'example.net' OR ends_with(host, '.example.net')) AND starts_with(path, '/en/') THEN 'example.net/en/'
                WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/fr/') THEN 'org/fr/'
                WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/') THEN 'net/' END AS rule
    FROM telling),
listed AS (SELECT DISTINCT canonical FROM named WHERE canonical <> '' AND md5(canonical) < '1')
SELECT n.page_id, n.host, n.path, n.rule,
       CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow'
            WHEN l.canonical IS NOT NULL THEN 'block' ELSE 'allow' END AS verdict,
       n.canonical, l.canonical IS NOT NULL AS listed
FROM named n LEFT JOIN listed l ON n.canonical = l.canonical
"""
