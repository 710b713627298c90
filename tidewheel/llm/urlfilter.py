"""URL verdicts: longest host/path rule first, then a list of canonical URLs behind a blocked Bloom filter.

Built-in functions only. The filter is a table of 256-bit blocks (eight lanes of 32 bits, one
bit set in each lane by each listed URL). Its number of blocks follows the list up to
``max_blocks``, so the broadcast has a fixed bound (40 bytes a block); a longer list only raises
the share of false possible hits, which an exact join removes. URLs that the filter rules
out never enter that join.

Defined results: null, or a url without ``://``, has an empty host and path, fits no rule and is
never listed; repeated rows are judged alike; the list may repeat URLs and hold nulls. An empty
table gives an empty result, an empty list blocks nothing; very long urls are read whole; other
columns of the input are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

A_Z, a_z = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BITS_PER_URL = 16
#: verdict by host and path prefix
RULES = {"org/": "allow", "example.org/es/": "block", "example.org/en/1": "block", "com/fr/": "allow", "com/de/": "block"}


def host(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(url, "://([^/?#]*)", 1), A_Z, a_z), F.lit(""))


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, "://[^/?#]*([^?#]*)", 1), F.lit(""))


def canonical(host: Column, path: Column) -> Column:
    """Host without ``www.`` and default port, path without closing slashes; null without a host."""
    h = F.regexp_replace(F.regexp_replace(host, "^www[.]", ""), ":(80|443)$", "")
    return F.when(host != "", F.concat(h, F.regexp_replace(path, "/+$", "")))


def rule(host: Column, path: Column, rules: dict[str, str]) -> Column:
    """The longest rule that fits, or null."""
    found = F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: (len(r), r)):  # the last `when` added is tried first
        h, _, p = r.partition("/")
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(f"/{p}")
        found = F.when(fits, F.lit(r)).otherwise(found)
    return found


def _masks(url: Column) -> list[Column]:
    """Four 64-bit words of a block: two 32-bit lanes in each, one bit a lane."""
    h = F.xxhash64(url, F.lit(1))
    bit = [F.shiftrightunsigned(h, 5 * i).bitwiseAND(F.lit(31)).cast("int") for i in range(8)]
    one = F.lit(1).cast("long")
    return [F.call_function("shiftleft", one, bit[2 * i]).bitwiseOR(F.call_function("shiftleft", one, bit[2 * i + 1] + 32)) for i in range(4)]


def _block(url: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(url), F.lit(blocks)).cast("int")


def bloom(listed: DataFrame, url: str, blocks: int) -> DataFrame:
    """(block, w0..w3): at most ``blocks`` rows."""
    u = F.col(url)
    rows = listed.select(_block(u, blocks).alias("block"), *[m.alias(f"w{i}") for i, m in enumerate(_masks(u))])
    return rows.groupBy("block").agg(*[F.bit_or(f"w{i}").alias(f"w{i}") for i in range(4)])


def url_verdicts(pages: DataFrame, listed: DataFrame, *, id_col: str = "page_id", url_col: str = "url", listed_col: str = "url", rules: dict[str, str] = RULES, max_blocks: int = 1 << 16) -> DataFrame:
    """One row per page: id, host, path, rule, verdict, canonical_url, possible_hit, listed.

    ``listed``: urls whose canonical form is blocked unless a rule decides.
    """

    def parts(df: DataFrame, *cols: Column) -> DataFrame:
        df = df.select(*cols, host(F.col("__url")).alias("host"), path(F.col("__url")).alias("path"))
        return df.withColumn("canonical_url", canonical(F.col("host"), F.col("path")))

    bad = parts(listed.select(F.col(listed_col).cast("string").alias("__url"))).select("canonical_url").filter("canonical_url is not null").distinct()
    bad = written(bad, "listed")
    blocks = max(1, min(max_blocks, -(-bad.count() * BITS_PER_URL // 256)))
    rows = parts(pages.select(F.col(id_col).alias("__id"), F.col(url_col).cast("string").alias("__url")), F.col("__id"))
    rows = rows.withColumn("rule", rule(F.col("host"), F.col("path"), rules))
    filt = F.broadcast(bloom(bad, "canonical_url", blocks))  # at most max_blocks rows of 40 bytes
    u = F.col("canonical_url")
    probed = rows.withColumn("block", _block(u, blocks)).join(filt, "block", "left")
    hit = F.lit(True)
    for i, m in enumerate(_masks(u)):
        hit = hit & (F.col(f"w{i}").bitwiseAND(m) == m)
    probed = probed.withColumn("possible_hit", F.coalesce(hit, F.lit(False))).drop("block", "w0", "w1", "w2", "w3")
    maybe = probed.filter("possible_hit").join(bad.withColumn("listed", F.lit(True)), "canonical_url", "left")
    clear = probed.filter("not possible_hit").withColumn("listed", F.lit(False))
    done = maybe.unionByName(clear).withColumn("listed", F.coalesce("listed", F.lit(False)))
    decided = F.lit(None).cast("string")
    for r, v in rules.items():
        decided = F.when(F.col("rule") == r, F.lit(v)).otherwise(decided)
    verdict = F.coalesce(decided, F.when(F.col("listed"), "block").otherwise("allow"))
    return done.select(F.col("__id").alias(id_col), "host", "path", "rule", verdict.alias("verdict"), "canonical_url", "possible_hit", "listed")
