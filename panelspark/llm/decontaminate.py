"""Benchmark decontamination by winnowing; DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER, UPPER, broadcast_if_small, materialize

#: A window has WINDOW words; fingerprints are the least hashes of the GRAM-word grams of a window.
WINDOW, GRAM = 13, 8
#: Benchmark windows that one pass over the documents holds in memory: about 100 bytes each.
BLOCK_WINDOWS = 100_000
#: Documents with hits whose items may be broadcast.
HIT_DOCS = 50_000
#: What is no word, before A-Z are lower-cased (which makes them word characters).
GAPS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    """Runs of digits, letters (A-Z lower-cased) and characters past ASCII; null has none."""
    found = F.array_remove(F.split(F.coalesce(text, F.lit("")), GAPS), "")
    return F.transform(found, lambda w: F.when(w.rlike("[A-Z]"), F.translate(w, UPPER, LOWER)).otherwise(w))


def _pairs(a: str, gap: int, f) -> Column:
    """f of elements i and i + gap."""
    n = F.size(a) - gap
    return F.when(n > 0, F.zip_with(F.slice(a, F.lit(1), n), F.slice(a, F.lit(gap + 1), n), f)).otherwise(F.array().cast("array<bigint>"))


def with_minima(df: DataFrame) -> DataFrame:
    """Adds from column words: _h1 and _h2, the hashes of words and of word pairs, and _min, for each window its least GRAM hash.

    Both sides hash alike, so every window that two texts share has one fingerprint in both.
    """
    df = df.withColumn("_h1", F.transform("words", lambda w: F.xxhash64(w)))
    for a, b, gap in (("_h1", "_h2", 1), ("_h2", "_h4", 2), ("_h4", "_h8", 4)):
        df = df.withColumn(b, _pairs(a, gap, lambda x, y: F.xxhash64(x, y)))
    for a, b, gap in (("_h8", "_m2", 1), ("_m2", "_m4", 2), ("_m4", "_min", 2)):  # WINDOW - GRAM + 1 = 6 grams
        df = df.withColumn(b, _pairs(a, gap, lambda x, y: F.least(x, y)))
    return df.drop("_h4", "_h8", "_m2", "_m4")


def with_winnowed(df: DataFrame) -> DataFrame:
    """Adds _won from _min: the windows' minima, each kept once for as long as it stays the minimum: array of (at, until,
    gram), windows from 0. The starts are a column of their own, so that no element computes them anew."""
    m = F.col("_min")
    new = F.filter(F.sequence(F.lit(0), F.size(m) - 1), lambda i: (i == 0) | (F.get(m, i) != F.get(m, i - 1)))
    df = df.withColumn("_from", F.when(F.size(m) > 0, new).otherwise(F.array().cast("array<int>")))
    starts = F.col("_from")
    until = F.concat(F.slice(starts, 2, F.size(starts)), F.array(F.size(m)))
    won = F.zip_with(starts, F.slice(until, F.lit(1), F.size(starts)), lambda i, j: F.struct(i.alias("at"), (j - 1).alias("until"), F.get(m, i).alias("gram")))
    return df.withColumn("_won", won).drop("_from")


def _places(hashes: str) -> Column:
    """As winnowed, for windows that are one word or one pair of words."""
    return F.transform(hashes, lambda h, i: F.struct(i.alias("at"), i.alias("until"), h.alias("gram")))


def _benchmark_windows(benchmark: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(kind, anchor, length, window), each window's text once with its fingerprint; and (window, item), the items it occurs in.

    An item of fewer than WINDOW words is one window; its anchor is the hash of its first two words or only word.
    """
    b = with_minima(benchmark.select(F.col("item_id").cast("string").alias("item"), words(F.col("text")).alias("words")).where(F.size("words") > 0))
    n = F.size("words")
    part = lambda kind, anchor, at, length: F.struct(F.lit(kind).alias("kind"), anchor.alias("anchor"), length.alias("length"), F.array_join(F.slice("words", at + 1, length), " ").alias("window"))
    long = F.transform("_min", lambda m, i: part(0, m, i, F.lit(WINDOW)))
    short = F.array(F.when(n == 1, part(1, F.element_at("_h1", 1), F.lit(0), n)).otherwise(part(2, F.try_element_at("_h2", F.lit(1)), F.lit(0), n)))
    each = b.select("item", F.explode(F.when(n >= WINDOW, long).otherwise(short)).alias("w")).select("item", "w.*")
    each = materialize(each.distinct(), "benchmark_windows")
    return each.select("kind", "anchor", "length", "window").distinct(), each.where("item is not null").select("window", "item")


def _bounded(df: DataFrame, small: bool) -> DataFrame:
    return F.broadcast(df) if small else df


def _hits(docs: DataFrame, places: Column, windows: DataFrame, small: bool, whole: bool) -> DataFrame:
    """The columns of docs but its arrays, and for each document window that is in windows (one kind): at, length, window.

    whole: each document also gives a row without a window. A document's winnowed fingerprints are joined, not its
    windows; a fingerprint that the benchmark has is then extended to the windows that it is the minimum of, and these are
    cut out and compared as texts. small: windows are few enough to be broadcast.
    """
    rest = [c for c in docs.columns if c not in ("words", "_h1", "_h2", "_min", "_won")]
    anchors = windows.groupBy("anchor").agg(F.collect_set("length").alias("lengths"))
    none = F.lit(None).cast("struct<at:int,until:int,gram:bigint>")
    place = F.concat(places, F.array(none)) if whole else places
    found = docs.select(*rest, "words", F.explode(place).alias("p")).join(_bounded(anchors, small), F.col("p.gram") == F.col("anchor"), "left" if whole else "inner")
    found = found.where("anchor is not null or p is null").select(*rest, "words", F.explode_outer(F.sequence("p.at", "p.until")).alias("at"), "lengths")
    found = found.select(*rest, "words", "at", F.explode_outer("lengths").alias("_n")).where(F.col("_n").isNull() | (F.col("at") + F.col("_n") <= F.size("words")))
    text = F.when(F.col("_n").isNotNull(), F.array_join(F.slice("words", F.col("at") + 1, F.col("_n")), " "))
    exact = _bounded(windows.select("length", "window"), small)
    found = found.select(*rest, "at", "_n", text.alias("_text")).join(exact, (F.col("_text") == F.col("window")) & (F.col("_n") == F.col("length")), "left")
    return found.where("_n is null or length is not null").select(*rest, F.when(F.col("length").isNotNull(), F.col("at")).alias("at"), "length", "window")


def decontaminate(docs: DataFrame, benchmark: DataFrame, keep: tuple[str, ...] = ("doc_id",), hit_share: int = 20) -> DataFrame:
    """One row per document (column text): the columns keep, n_words, n_hit, items (sorted), contaminated.

    A document word inside any occurrence of a benchmark window is hit; contaminated: n_hit > 0 and hit_share * n_hit
    >= n_words. Null texts have no words; items without words have no window; the windows of an item with a null item_id
    hit like any other's, but it is not among the items; repeated rows of either table count each as given. An empty
    benchmark hits nothing.

    Rows are told apart by their columns keep and 128 bits of hashes of the text, never by a place that a second read may
    change; equal rows are counted and come back as often. The benchmark is taken in blocks of about BLOCK_WINDOWS
    windows, which bounds what is broadcast; a block that exceeds twice that (one fingerprint that very many windows have)
    is joined without a broadcast. Each block passes over the documents once.
    """
    windows, items = _benchmark_windows(benchmark)
    kinds = {0: 0} | {r[0]: r[1] for r in windows.groupBy("kind").count().collect()}
    named = [f"_k{i}" for i in range(len(keep))]
    d = docs.select(*[F.col(c).alias(n) for c, n in zip(keep, named, strict=True)], F.xxhash64("text").alias("_a"), F.xxhash64("text", F.lit(1)).alias("_b"), words(F.col("text")).alias("words"))
    d = with_winnowed(with_minima(d.withColumn("n_words", F.size("words").cast("long"))))
    places = {0: F.col("_won"), 1: _places("_h1"), 2: _places("_h2")}
    out = None
    for kind, count in sorted(kinds.items()):
        blocks = max(1, -(-count // BLOCK_WINDOWS))
        of_kind = windows.where(F.col("kind") == kind).withColumn("_block", F.pmod(F.xxhash64("anchor"), F.lit(blocks)))
        sizes = {r[0]: r[1] for r in of_kind.groupBy("_block").count().collect()}
        for k in range(blocks):
            found = _hits(d, places[kind], of_kind.where(F.col("_block") == k), sizes.get(k, 0) <= 2 * BLOCK_WINDOWS, whole=out is None)
            out = found if out is None else out.unionByName(found)
    row = [*named, "_a", "_b", "n_words"]
    place = F.struct("at", "length")
    grouped = out.groupBy(*row).agg(
        F.count(F.when(F.col("at").isNull(), 1)).alias("_rows"), F.collect_set(F.when(F.col("at").isNotNull(), place)).alias("_at"), F.collect_set("window").alias("_windows"),
    )
    grouped = materialize(grouped, "hits")
    some = grouped.where(F.size("_windows") > 0).select(*row, F.explode("_windows").alias("window")).join(items, "window").groupBy(*row).agg(F.collect_set("item").alias("items"))
    same = None
    for c in row:
        same = F.col(f"g.{c}").eqNullSafe(F.col(f"i.{c}")) if same is None else same & F.col(f"g.{c}").eqNullSafe(F.col(f"i.{c}"))
    joined = grouped.alias("g").join(broadcast_if_small(materialize(some, "items"), HIT_DOCS).alias("i"), same, "left")
    out = joined.select(*[F.col(f"g.{n}").alias(n) for n in row], "g._rows", "g._at", F.array_sort(F.coalesce("i.items", F.array().cast("array<string>"))).alias("items"))
    hit = F.size(F.array_distinct(F.flatten(F.transform("_at", lambda p: F.sequence(p["at"], p["at"] + p["length"] - 1))))).cast("long")
    out = out.withColumn("n_hit", hit).withColumn("contaminated", (F.col("n_hit") > 0) & (hit_share * F.col("n_hit") >= F.col("n_words")))
    out = out.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_rows").cast("int"))))
    return out.select(*[F.col(n).alias(c) for c, n in zip(keep, named, strict=True)], "n_words", "items", "n_hit", "contaminated")
