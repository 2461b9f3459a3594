"""URL rules behind a blocked Bloom filter."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, broadcast_if_small, columns, materialize

#: Odd multipliers of the eight words of a block (any odd numbers would do).
SALTS = tuple(2 * 0x1E3779B9 * k + 0x2545F491 | 1 for k in range(1, 9))
KEYS_PER_BLOCK = 32


def host_of(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z lower-cased; empty for null or no ://."""
    rest = F.substring(url, F.instr(url, "://") + 3, F.length(url))
    return F.when(F.coalesce(F.instr(url, "://"), F.lit(0)) > 0, ascii_lower(F.regexp_extract(rest, r"^[^/?#]*", 0))).otherwise("")


def path_of(url: Column) -> Column:
    """After the host up to ?, # or the end; empty for null or no ://."""
    rest = F.substring(url, F.instr(url, "://") + 3, F.length(url))
    return F.when(F.coalesce(F.instr(url, "://"), F.lit(0)) > 0, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)).otherwise("")


def _word(key: Column, k: int) -> Column:
    """The one bit that a key sets in word k of its block."""
    h = F.xxhash64(key, F.lit(SALTS[k]))
    return F.call_function("shiftleft", F.lit(1).cast("long"), (F.pmod(h, F.lit(64))).cast("int"))


def _block(key: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(blocks)).cast("long")


def build_filter(keys: DataFrame, max_blocks: int = 131_072) -> tuple[DataFrame, int]:
    """(block, w0..w7) of the keys' column key, and the number of blocks.

    A block is 512 bits, each key sets one bit in each of its eight words. The number of blocks follows the number of
    keys up to max_blocks (10 MB in all, the bound that lets it be broadcast); past it only the share of false hits
    grows, which the exact join takes out.
    """
    blocks = max(1, min(max_blocks, keys.count() // KEYS_PER_BLOCK + 1))
    words = [F.bit_or(_word(F.col("key"), k)).alias(f"w{k}") for k in range(8)]
    return keys.groupBy(_block(F.col("key"), blocks).alias("block")).agg(*words), blocks


def judge_urls(pages: DataFrame, rules: DataFrame, default: str = "allow", max_broadcast_rules: int = 100_000) -> DataFrame:
    """Adds host, path, rule and verdict to every row of pages (column url).

    rules: host, path, verdict. A rule fits its host and all subdomains if the path starts with the rule's; the longest
    host + path wins, then the longer host. Rules with a null are left out; of rules that share host and path, block
    wins. No rule: rule is null, verdict the default. The host suffixes of each different host and path, each with the
    path's beginnings of the lengths that occur in the rules, are its canonical keys; those that pass the Bloom filter
    meet the rules in an exact join. Only urls, each once, are exploded and shuffled; pages then take the verdicts of the
    urls that have one. Rows with a null url, repeated rows and other columns, whatever their names, stay as they are,
    but columns of the new names give way. An empty rule table: all rows get the default.
    """
    pages = pages.drop("host", "path", "rule", "verdict")
    listed = rules.where("host is not null and path is not null and verdict is not null").groupBy(F.concat("host", "path").alias("rule"), F.length("host").alias("host_len")).agg(F.max("verdict").alias("verdict"))
    lengths = sorted(r[0] for r in listed.select(F.length("rule") - F.col("host_len")).distinct().collect())  # bounded by the longest path
    bloom, blocks = build_filter(listed.select(F.col("rule").alias("key")).distinct())
    page = pages.withColumns({"host": host_of(F.col("url")), "path": path_of(F.col("url"))})
    labels = F.split("host", r"\.")
    n = F.size(labels)
    suffixes = F.transform(F.sequence(F.lit(1), n), lambda i: F.array_join(F.slice(labels, i, n - i + 1), "."))
    begins = F.filter(F.array(*map(F.lit, lengths)) if lengths else F.array().cast("array<int>"), lambda x: x <= F.length("path"))
    keys = F.flatten(F.transform(suffixes, lambda s: F.transform(begins, lambda x: F.struct(F.concat(s, F.substring(F.col("path"), F.lit(1), x)).alias("key"), F.length(s).alias("len")))))
    probe = page.select("host", "path").distinct().select("host", "path", F.explode(keys).alias("c")).select("host", "path", "c.key", "c.len", _block(F.col("c.key"), blocks).alias("b"))
    hit = F.lit(True)
    for k in range(8):
        hit &= F.col(f"w{k}").bitwiseAND(_word(F.col("key"), k)) != 0
    passed = probe.join(F.broadcast(bloom), F.col("b") == F.col("block")).where(hit).select("host", "path", "key", "len")
    exact = passed.join(broadcast_if_small(listed, max_broadcast_rules), (F.col("key") == F.col("rule")) & (F.col("len") == F.col("host_len")))
    found = F.struct(F.length("rule").alias("n"), "host_len", "rule", "verdict")
    best = materialize(exact.groupBy("host", "path").agg(F.max(found).alias("best")).select("host", "path", "best.rule", "best.verdict"), "judged")
    judged = page.join(broadcast_if_small(best, max_broadcast_rules), ["host", "path"], "left")
    return judged.select(*columns(pages), "host", "path", "rule", F.coalesce("verdict", F.lit(default)).alias("verdict"))
