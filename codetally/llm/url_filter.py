"""URL verdicts from host and path rules and a large list of URLs behind a Bloom filter."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codetally.llm.storage import stage

CAPITALS, SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# Query parameters that do not change the page.
TRACKING = r"^(utm_[a-z]+|ref|fbclid|gclid)(=|$)"

# A block has eight words of 32 bits; a URL sets one bit in each word.
BLOCK_WORDS = 8
# About 12 bits for each URL, one false hit in some hundreds.
URLS_PER_BLOCK = 21
# Bound of the broadcast: 2^20 blocks of 32 bytes. A longer list shares these
# blocks, lets more rows through to the exact join, and gives the same verdicts.
MAX_BLOCKS = 1 << 20
# Odd multipliers, one for each word of a block.
SALTS = [2 * (0x9E3779B1 * (i + 1) % (1 << 30)) + 1 for i in range(BLOCK_WORDS)]


@dataclass(frozen=True)
class Rule:
    """Allows or blocks a host with all subdomains, below a path that starts with ``/``."""

    host: str
    path: str
    verdict: str

    @property
    def text(self) -> str:
        return self.host + self.path


def host_of(url: Column) -> Column:
    """What stands after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased."""
    host = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(host, CAPITALS, SMALL)


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def canonical_url(url: Column) -> Column:
    """Host without ``www.``, path without slashes at its end, query without tracking, sorted.

    Null for a URL without a host.
    """
    query = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^?#]*\?([^#]*)", 1)
    kept = F.array_sort(
        F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.rlike(TRACKING))
    )
    host = F.regexp_replace(host_of(url), r"^www\.", "")
    path = F.regexp_replace(path_of(url), r"/+$", "")
    tail = F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise("")
    return F.when(host != "", F.concat(host, path, tail))


def _bits(url_hash: str, i: int) -> str:
    """SQL for the bit that a URL sets in word ``i`` of its block."""
    return f"shiftleft(1, cast(shiftrightunsigned(({url_hash} & 4294967295L) * {SALTS[i]}L, 27) & 31 as int))"


def bloom_blocks(listed: DataFrame) -> tuple[DataFrame, int]:
    """``block, w0 .. w7`` of a blocked Bloom filter over ``canonical``, and the number of blocks."""
    n_blocks, urls = 1, listed.count()
    while n_blocks < MAX_BLOCKS and n_blocks * URLS_PER_BLOCK < urls:
        n_blocks *= 2
    hashed = listed.select(F.xxhash64("canonical").alias("h"))
    blocks = (
        hashed.withColumn("block", _block(n_blocks))
        .groupBy("block")
        .agg(*(F.expr(f"bit_or({_bits('h', i)})").alias(f"w{i}") for i in range(BLOCK_WORDS)))
    )
    return blocks, n_blocks


def _block(n_blocks: int) -> Column:
    return F.expr(f"cast(shiftrightunsigned(h, 40) % {n_blocks} as int)")


def judge_urls(
    pages: DataFrame, listed: DataFrame, rules: list[Rule], url_col: str = "url", listed_col: str = "url"
) -> DataFrame:
    """``pages`` with ``host, path, canonical, rule, verdict``.

    The longest rule that fits gives ``rule`` and ``verdict``. Where none fits, a
    URL whose canonical form is that of a listed URL is blocked, any other is
    allowed. A URL that is null or has no ``://`` has an empty host and path, fits no
    rule and is allowed. Repeated pages are judged each; repeated and null listed
    URLs change nothing, and an empty list or table is valid. Columns of ``pages``
    with the names of the new ones are replaced.

    Rows without a rule probe the Bloom filter of the list, which is broadcast and
    of bounded size: beyond ``MAX_BLOCKS * URLS_PER_BLOCK`` listed URLs it passes more
    and more rows to the join, and all in the end, but never a wrong one. Only possible hits are shuffled to the exact join with the
    list; it is a join of many rows to one, so AQE can split a URL that very many
    pages have.
    """
    exact = stage(
        listed.select(canonical_url(F.col(listed_col)).alias("canonical")).where("canonical IS NOT NULL").distinct(),
        "listed-urls",
    )
    blocks, n_blocks = bloom_blocks(exact)
    new = ["host", "path", "canonical", "rule", "verdict"]
    other = [c for c in pages.columns if c not in new]
    url = F.col(url_col)
    parsed = pages.select(
        F.struct(F.lit(0).alias("_"), *(F.col(c) for c in other)).alias("row__"), host_of(url).alias("host"), path_of(url).alias("path"),
        canonical_url(url).alias("canonical"),
    )
    rule = verdict = F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: (len(r.text), r.text)):
        fits = ((F.col("host") == r.host) | F.col("host").endswith("." + r.host)) & F.col("path").startswith(r.path)
        rule, verdict = F.when(fits, r.text).otherwise(rule), F.when(fits, r.verdict).otherwise(verdict)
    ruled = parsed.withColumn("rule", rule).withColumn("verdict", verdict)
    hashed = ruled.withColumn("h", F.xxhash64("canonical"))
    probed = hashed.withColumn("block", F.when(F.expr("rule IS NULL AND canonical IS NOT NULL"), _block(n_blocks)))
    found = probed.join(F.broadcast(blocks), "block", "left")
    maybe = F.coalesce(
        F.expr(" AND ".join(f"(w{i} & {_bits('h', i)}) <> 0" for i in range(BLOCK_WORDS))), F.lit(False)
    )
    marked = found.withColumn("maybe", maybe).select("row__", *new, "maybe")
    clear = marked.where("NOT maybe").drop("maybe")
    hits = marked.where("maybe").drop("maybe", "verdict").join(
        exact.withColumn("listed", F.lit(True)), "canonical", "left"
    )
    hits = hits.withColumn("verdict", F.when(F.col("listed"), F.lit("block"))).select("row__", *new)
    judged = clear.unionByName(hits).withColumn("verdict", F.coalesce("verdict", F.lit("allow")))
    return judged.select(*(F.col("row__")[c].alias(c) for c in other), *new)
