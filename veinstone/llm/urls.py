"""URL filter: a blocked Bloom filter passes possible hits to an exact hash join."""

from __future__ import annotations

import json
import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BITS_PER_RULE = 16
MAX_BLOCKS = 1 << 16


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url; both empty for null and for urls without ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, url.substr(at + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    return (F.translate(host, string.ascii_uppercase, string.ascii_lowercase),
            F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1))


def _block(key: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(blocks))


def _mask(key: Column) -> Column:
    """Six bits of one 64-bit block."""
    h = F.xxhash64(key, F.lit(1))
    bits = [F.shiftright(h, 6 * i).bitwiseAND(F.lit(63)).cast("int") for i in range(6)]
    mask = F.lit(0).cast("long")
    for bit in bits:
        mask = mask.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), bit))
    return mask


def bloom_blocks(keys: DataFrame, n_keys: int) -> list[int]:
    """The filter's 64-bit words over column ``key``: at most ``MAX_BLOCKS`` (512 KiB) at any input.

    Beyond 260,000 keys the filter lets more false hits pass; the join after it removes them all.
    """
    blocks = 1
    while blocks * 64 < n_keys * BITS_PER_RULE and blocks < MAX_BLOCKS:
        blocks *= 2
    words = [0] * blocks
    key = F.col("key")
    filled = keys.groupBy(_block(key, blocks).alias("block")).agg(F.bit_or(_mask(key)).alias("word"))
    for row in filled.collect():
        words[row.block] = row.word
    return words


def judge_urls(pages: DataFrame, rules: DataFrame, key: str = "page_id", url: str = "url") -> DataFrame:
    """Per row of ``pages``: key, host, path, rule, verdict.

    ``rules``: host, path, verdict (allow or block). A rule fits its host and all subdomains when the
    url's path starts with the rule's path. The longest rule (host and path together) wins, then the
    longer host; of equal rules block wins. Urls that no rule fits get null and ``allow``: the filter
    lists what is not wanted. Null urls and urls without ``://`` have empty host and path. Rules with
    null host or path and empty rule tables fit nothing. Other columns of ``pages`` are not read.

    The names that can fit a url (its host's suffixes with as many labels as some rule has, with the
    path's prefixes as long as some rule's path) are tested against the filter inside the scan; only
    names that pass reach the join, which is exact.
    """
    known = rules.filter("host IS NOT NULL AND path IS NOT NULL").select(
        F.concat("host", "path").alias("key"), "host", "path", "verdict")
    shape = known.select(
        F.size(F.split("host", r"\.")).alias("labels"), F.length("path").alias("length"))
    labels = sorted(r.labels for r in shape.select("labels").distinct().collect())
    lengths = sorted(r.length for r in shape.select("length").distinct().collect())
    words = bloom_blocks(known, known.count())

    host, path = host_and_path(F.col(url))
    rows = pages.select(F.col(key).alias("_key"), host.alias("_host"), path.alias("_path"),
                        F.monotonically_increasing_id().alias("_row"))
    n_labels = F.size(F.split("_host", r"\."))
    names = [F.when((n_labels >= k) & (F.length("_path") >= n),
                    F.concat(F.substring_index("_host", ".", -k), F.substring("_path", 1, n)))
             for k in labels for n in lengths]
    names = F.array_compact(F.array(*names)) if names else F.array().cast("array<string>")
    bloom = F.from_json(F.lit(json.dumps(words)), "array<bigint>")

    def possible(name: Column) -> Column:
        mask = _mask(name)
        word = F.get(bloom, _block(name, len(words)).cast("int"))
        return word.bitwiseAND(mask) == mask

    hits = rows.select("*", F.explode_outer(F.filter(names, possible)).alias("_name"))
    exact = known.select(
        F.col("key").alias("_name"),
        F.struct(F.length("key").alias("n"), F.length("host").alias("h"), F.col("key").alias("rule"),
                 "verdict").alias("found"))
    best = (hits.join(exact, "_name", "left")
            .groupBy("_row", "_key", "_host", "_path").agg(F.max("found").alias("found")))
    return best.select(
        F.col("_key").alias(key), F.col("_host").alias("host"), F.col("_path").alias("path"),
        F.col("found.rule").alias("rule"), F.coalesce("found.verdict", F.lit("allow")).alias("verdict"))
