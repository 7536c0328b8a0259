"""URL filter (operator 3): rules, a blocked Bloom filter and an exact hash join.

Everything here is DataFrame code. A list of canonical URLs is turned into a Bloom filter
of 256-bit blocks: a key picks one block and sets one bit in each of its four 64-bit
words. Pages probe the filter first; only possible hits reach the hash join with the list
itself, which removes the false positives. The list is canonicalised and written once, to the
shared scratch folder; pages are read once for those that miss the filter and once for those that
may be listed, so that nothing but possible hits is ever shuffled.

The filter has BITS_PER_KEY bits for each listed URL. It is broadcast while its size, known
from the list's count, is at most BROADCAST_BYTES (about 30 million URLs); beyond that the probe
is a hash join on the block number, which shuffles the pages and which Spark can split where it is
skewed. The exact join is a hash join as well: of a broadcast list, if its bytes, which
are summed, are at most LIST_BYTES, else of shuffled keys.

Rules (host, path) come before the list: a rule fits its host and all subdomains when the
path starts with the rule's; of the rules that fit, the longest text wins, of equally long ones the
first. Rules are a parameter of at most a few hundred entries, held in the plan.

Defined results: a null URL, or one without ``://``, has an empty host and path and fits
no rule; its canonical form is empty, which no list holds. A very long URL is treated whole. A null
page_id is passed on. Repeated rows are judged alike, one row each. A null or repeated list entry
counts once or not at all. Empty pages or an empty list give an empty result or no blocks. Other
columns are not read.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from callgrid.llm.common import Scratch

BITS_PER_KEY = 16
BLOCK_BITS = 256
#: A broadcast block takes about BLOCK_BYTES.
BLOCK_BYTES = 80
BROADCAST_BYTES = 160 << 20
LIST_BYTES = 8 << 20

#: Fixed values of the contract: verdict, host, path.
RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased."""
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(rest, _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def canonical(url: Column) -> Column:
    """host/path without ``www.`` or a default port, ``.html`` and closing slashes; the
    query without ``utm_*`` and ``ref`` parameters; no fragment. Empty if no ``://``."""
    host = F.regexp_replace(F.regexp_replace(host_of(url), r"^www\.", ""), r":(80|443)\z", "")
    path = F.regexp_replace(F.regexp_replace(path_of(url), r"\.html\z", ""), r"/+\z", "")
    query = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*[^?#]*\?([^#]*)", 1)
    query = F.regexp_replace(F.regexp_replace(query, r"(^|&)(utm_[^&=]*|ref)(=[^&]*)?", ""), r"^&+", "")
    return F.when(F.instr(url, "://") > 0, F.concat(host, path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""))).otherwise("")


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits; null where none does."""
    rule = verdict = F.lit(None).cast("string")
    # a later one replaces an earlier one, so of equally long rules the first comes last
    for kind, h, p in sorted(reversed(rules), key=lambda r: len(r[1] + r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule, verdict = F.when(fits, F.lit(h + p)).otherwise(rule), F.when(fits, F.lit(kind)).otherwise(verdict)
    return rule, verdict


def _bits(key: Column) -> list[Column]:
    """Four masks, each with the one bit that the key sets in that word of its block."""
    h = F.xxhash64(key, F.lit(2))
    return [F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(h, 6 * k).bitwiseAND(F.lit(63)).cast("int")) for k in range(4)]


def _block(key: Column, n_blocks: int) -> Column:
    return F.pmod(F.xxhash64(key, F.lit(1)), F.lit(n_blocks).cast("long"))


def bloom_blocks(keys: DataFrame, n_blocks: int) -> DataFrame:
    """Blocks that hold a bit: (block, w0, w1, w2, w3); keys has one column, key."""
    rows = keys.select(_block(F.col("key"), n_blocks).alias("block"), *(b.alias(f"b{k}") for k, b in enumerate(_bits(F.col("key")))))
    return rows.groupBy("block").agg(*(F.bit_or(f"b{k}").alias(f"w{k}") for k in range(4)))


def listed(pages: DataFrame, keys: DataFrame) -> DataFrame:
    """pages with a boolean column `listed`: its `key` is one of keys' (column key)."""
    keys = Scratch(pages.sparkSession).keep(keys.where(F.col("key").isNotNull() & (F.col("key") != "")).distinct(), "keys")
    n_keys, size = keys.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("key")), F.lit(0))).first()
    n_blocks = max(1, -(-n_keys * BITS_PER_KEY // BLOCK_BITS))
    small = min(n_keys, n_blocks) * BLOCK_BYTES <= BROADCAST_BYTES
    blocks = bloom_blocks(keys, n_blocks)
    blocks = F.broadcast(blocks) if small else blocks.hint("shuffle_hash")
    probed = pages.withColumn("_block", _block(F.col("key"), n_blocks)).join(blocks.withColumnRenamed("block", "_block"), "_block", "left")
    hit = reduce(lambda a, b: a & b, [F.col(f"w{k}").bitwiseAND(m) != 0 for k, m in enumerate(_bits(F.col("key")))])
    probed = probed.withColumn("_maybe", F.coalesce(hit, F.lit(False)) & (F.col("key") != ""))
    # pages that miss the filter carry a null key, which joins with nothing and moves nowhere
    probed = probed.withColumn("_probe", F.when(F.col("_maybe"), F.col("key")))
    sure = probed.where("not _maybe").select(*pages.columns, F.lit(False).alias("listed"))
    exact = keys.select(F.col("key").alias("_probe"), F.lit(True).alias("_found"))
    exact = F.broadcast(exact) if size + 64 * n_keys <= LIST_BYTES else exact.hint("shuffle_hash")
    maybe = probed.where("_maybe").join(exact, "_probe", "left")
    return sure.unionByName(maybe.select(*pages.columns, F.coalesce("_found", F.lit(False)).alias("listed")))


def judge_urls(pages: DataFrame, block_list: DataFrame, rules=RULES, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """page_id, host, path, rule, verdict, listed for each row of pages.

    block_list has a column `url`; a page whose canonical URL is listed is blocked unless
    a rule fits it. All others are allowed.
    """
    url = F.col("url")
    p = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"))
    p = p.select("page_id", host_of(url).alias("host"), path_of(url).alias("path"), canonical(url).alias("key"))
    keys = block_list.select(canonical(F.col("url")).alias("key"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    return listed(p, keys).select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, F.when(F.col("listed"), "block").otherwise("allow")).alias("verdict"), "listed")


#: Hosts whose pages make up the block list of the query (words that mark such hosts).
BAD_WORDS = ("casino", "pills", "bets", "spam", "ads-")


def block_list(pages: DataFrame) -> DataFrame:
    """The query's list: the URLs of pages on hosts that hold one of BAD_WORDS."""
    return pages.where(host_of(F.col("url")).rlike("|".join(BAD_WORDS))).select("url")


_CASES = "".join(f" WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN '{{{i}}}'" for i, (_, h, p) in sorted(enumerate(RULES), key=lambda r: -len(r[1][1] + r[1][2])))
#: DuckDB, with a plain semi-join for the list.
ORACLE = rf"""
WITH u AS (SELECT page_id, coalesce(url, '') AS url FROM pages),
h AS (SELECT page_id, url, translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), '{_UPPER}', '{_LOWER}') AS host,
  regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path,
  regexp_replace(regexp_replace(regexp_extract(url, '(?s)^.*?://[^/?#]*[^?#]*\?([^#]*)', 1), '(^|&)(utm_[^&=]*|ref)(=[^&]*)?', '', 'g'), '^&+', '') AS q FROM u),
k AS (SELECT *, CASE WHEN contains(url, '://') THEN regexp_replace(regexp_replace(host, '^www\.', ''), ':(80|443)$', '')
  || regexp_replace(regexp_replace(path, '\.html$', ''), '/+$', '') || CASE WHEN q <> '' THEN '?' || q ELSE '' END ELSE '' END AS key FROM h),
l AS (SELECT DISTINCT key FROM k WHERE regexp_matches(host, '{"|".join(BAD_WORDS)}') AND key <> ''),
r AS (SELECT page_id, host, path, CASE{_CASES.format(*(h + p for _, h, p in RULES))} END AS rule,
  CASE{_CASES.format(*(v for v, _, _ in RULES))} END AS v, key IN (SELECT key FROM l) AS listed FROM k)
SELECT page_id, host, path, rule, coalesce(v, CASE WHEN listed THEN 'block' ELSE 'allow' END) AS verdict, listed FROM r
"""
