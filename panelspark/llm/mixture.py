"""Mixing sources to target weights: budgets fitted by subset sums over counts of documents by exact length."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import broadcast_if_small, materialize

#: Weights of the sources in their order, repeating; the share of all words that the mix has; the most times a text is taken.
WEIGHTS, SHARE, REPEATS = (5, 2, 1), 1.5, 2
#: Words that the knapsack's table spans; what lies above is spent before by equal shares of all lengths, then by the longest.
SPAN = 1 << 18
#: Documents of one source and length that one window orders.
ORDERED = 20_000
#: Rows of a table of sources or of lengths that may be broadcast.
SMALL = 200_000


def sized(docs: DataFrame, size: str | None = None) -> DataFrame:
    """(doc_id, source, size) of docs; a document's size is its number of words, or the column size (null: 0)."""
    words = F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")) if size is None else F.greatest(F.col(size), F.lit(0))
    return docs.select("doc_id", F.col("source").cast("string").alias("source"), F.coalesce(words, F.lit(0)).cast("long").alias("size"))


def ranked_sources(totals: DataFrame) -> DataFrame:
    """totals with place, the number of sources before each by code point, null last.

    Sorted by ranges; only the ranges' row counts meet, so no task holds all sources.
    """
    one = totals.repartitionByRange(F.col("source").isNull(), "source").sortWithinPartitions(F.col("source").isNull(), "source")
    dealt = materialize(one.withColumn("part", F.spark_partition_id()), "sources")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    first = dealt.groupBy("part").count().select("part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("first"))
    within = Window.partitionBy("part").orderBy(F.col("source").isNull(), "source")
    return dealt.join(F.broadcast(first), "part").withColumn("place", F.col("first") + F.row_number().over(within) - 1).drop("part", "first")


def with_targets(totals: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, repeats: float = REPEATS) -> DataFrame:
    """totals (source, source_size) with target, how many words the mix is to take of each source.

    The sources, by code point and null last, weigh weights in turn and divide share times all sizes by weight. A target
    ends at repeats times its source's size; what it leaves is divided among the others by weight, until none is above.
    Each round looks at sums over sources alone.
    """
    kept = materialize(ranked_sources(totals).withColumn("weight", F.element_at(F.array(*map(F.lit, map(float, weights))), (F.col("place") % len(weights) + 1).cast("int"))).withColumn("most", repeats * F.col("source_size")), "targets")
    budget = share * (kept.agg(F.sum("source_size")).first()[0] or 0)
    level, capped = None, F.lit(False)
    while True:
        row = kept.agg(F.sum(F.when(capped, F.col("most"))), F.sum(F.when(~capped, F.col("weight"))), F.count(F.when(capped, 1))).first()
        if not row[1]:
            break
        if level is not None and row[2] == n_capped:
            break
        level, n_capped = (budget - (row[0] or 0.0)) / row[1], row[2]
        capped = F.col("weight") * level > F.col("most")
    target = F.col("most") if level is None else F.least(F.col("weight") * level, F.col("most"))
    return kept.select("source", "source_size", target.cast("double").alias("target"))


def subset_sums(lengths: Sequence[int], counts: Sequence[int], wanted: int) -> list[int]:
    """How many of each length to take, counts at most, so that the words sum up nearest to wanted (a tie: fewer words).

    Bounded knapsack by dynamic programming: first[s] is the length with which the sum s was first reached, a bit set
    tells which sums are. A length's copies go in by powers of two. It ends once wanted itself is reached; sums span
    wanted and the longest length.
    """
    take = [0] * len(lengths)
    if wanted <= 0 or not len(lengths):
        return take
    top = wanted + max(lengths)
    first, full, reached = np.full(top + 1, -1, np.int32), (1 << (top + 1)) - 1, 1
    for k, (n, c) in enumerate(zip(lengths, counts, strict=True)):
        if n <= 0 or n > top:
            continue
        left, size, now = min(c, top // n), 1, reached
        while left > 0:
            step = min(size, left)
            now |= (now << (n * step)) & full
            left, size = left - step, size * 2
        new = now & ~reached
        if new:
            bits = np.unpackbits(np.frombuffer(new.to_bytes(top // 8 + 1, "little"), np.uint8), bitorder="little")[: top + 1]
            first[np.flatnonzero(bits)] = k
        reached = now
        if reached >> wanted & 1:
            break
    sums = np.concatenate([[0], np.flatnonzero(first >= 0)])
    s = int(sums[np.lexsort([sums, np.abs(sums - wanted)])[0]])
    while s:
        k = int(first[s])
        # the fewest copies that leave a sum which earlier lengths reach
        while s and first[s] >= k:
            s -= lengths[k]
            take[k] += 1
    return take


def fit_budget(lengths: np.ndarray, counts: np.ndarray, budget: int, span: int = SPAN) -> np.ndarray:
    """How many documents of each length (ascending) to take, each once at most, so that their words come nearest to budget.

    Every length gives the same share first, rounded down, so the mix keeps the lengths' proportions; of what is left over
    span, the longest lengths that fit give one more each time around; the rest is filled by subset_sums.
    """
    whole = int(lengths @ counts)
    if budget >= whole:
        return counts.copy()
    if budget <= 0:
        return np.zeros_like(counts)
    room = max(0, budget - span // 2)
    take = (counts.astype(object) * room // whole).astype(np.int64)
    left, longest = budget - int(lengths @ take), int(lengths[-1])
    while left > span:
        free = np.flatnonzero((take < counts) & (lengths > 0))[::-1]
        steps = np.cumsum(lengths[free])
        some = free[: int(np.searchsorted(steps, left - longest, "right"))]
        if not len(some):
            break
        take[some] += 1
        left -= int(lengths[some].sum())
    free = np.flatnonzero((take < counts) & (lengths > 0))
    short = free[lengths[free] <= 2 * max(left, 1)]  # a longer one is farther off than none
    # the longest first: few copies reach far, and the short ones close the gap
    short = short[::-1]
    more = subset_sums(lengths[short].tolist(), (counts - take)[short].tolist(), left)
    take[short] += np.array(more, np.int64)
    return take


def mix(docs: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, repeats: int = REPEATS, seed: int = 0, size: str | None = None) -> DataFrame:
    """doc_id, source, size, source_size, target and taken for each row of docs (doc_id, text, source).

    target is the source's (with_targets). Of each source every document is taken as often as the target holds the whole
    source, and some once more: documents are counted by exact size, fit_budget() says how many of each size, and the
    first so many by a seeded hash of id and size are chosen. taken is a document's size times the times it is in
    the mix, repeats at most. A source's words come as near to its (rounded) target as a choice of documents taken once more
    allows, if the rest is within SPAN; with many documents that is the target itself.

    A null source is a source, the last; a null text has size 0; repeated rows and null ids are documents of their own,
    and rows of one id, source and size can stand for each other. Other columns are left out.

    A task fits one source, whose rows are one for each of its sizes; documents of one source and size are ordered by the
    hash in windows of about ORDERED rows. The same rows give the same mix.
    """
    rows = materialize(sized(docs, size).withColumns({"order": F.xxhash64("doc_id", "size", F.lit(seed)), "row": F.monotonically_increasing_id()}), "sizes")
    lengths = materialize(rows.groupBy("source", "size").agg(F.count(F.lit(1)).alias("n")), "lengths")
    targets = with_targets(lengths.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size")), weights, share, repeats)
    whole = F.when(F.col("source_size") > 0, F.least(F.floor(F.col("target") / F.col("source_size")), F.lit(repeats))).otherwise(0).cast("long")
    rest = F.when(F.col("whole") < repeats, F.round(F.col("target") - F.col("whole") * F.col("source_size"))).otherwise(0).cast("long")
    budgets = broadcast_if_small(materialize(targets.withColumn("whole", whole).withColumn("rest", rest), "budgets"), SMALL)

    def fit(t: pd.DataFrame) -> pd.DataFrame:
        t = t.sort_values("size")
        return t[["source", "size", "n", "source_size", "target", "whole"]].assign(more=fit_budget(t["size"].to_numpy(np.int64), t["n"].to_numpy(np.int64), int(t["rest"].iloc[0])))

    counted = lengths.join(budgets, lengths["source"].eqNullSafe(budgets["source"])).select(lengths["source"], "size", "n", "source_size", "target", "whole", "rest")
    schema = "source string, size long, n long, source_size long, target double, whole long, more long"
    kinds = broadcast_if_small(materialize(counted.groupBy("source").applyInPandas(fit, schema), "kinds"), SMALL)
    # documents of one kind are dealt in buckets by the hash; each bucket takes the places after those before it
    same_kind = lambda a, b: a["source"].eqNullSafe(b["source"]) & (a["size"] == b["size"])
    kept = ["source_size", "target", "whole", "more"]
    bucket = F.pmod(F.xxhash64("order"), F.ceil(F.col("n") / ORDERED).cast("long")).alias("bucket")
    dealt = rows.join(kinds, same_kind(rows, kinds)).select("doc_id", rows["source"], rows["size"], "order", "row", bucket, *kept)
    counts = dealt.groupBy("source", "size", "bucket").agg(F.count(F.lit(1)).alias("m"))
    before = Window.partitionBy("source", "size").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)  # a row for ORDERED documents
    first = broadcast_if_small(materialize(counts.select("source", "size", "bucket", F.coalesce(F.sum("m").over(before), F.lit(0)).alias("first")), "buckets"), SMALL)
    placed = dealt.join(first, same_kind(dealt, first) & (dealt["bucket"] == first["bucket"])).select("doc_id", dealt["source"], dealt["size"], "order", "row", dealt["bucket"], *kept, "first")
    place = F.col("first") + F.row_number().over(Window.partitionBy("source", "size", "bucket").orderBy("order", "doc_id", "row"))
    return placed.withColumn("taken", F.col("size") * (F.col("whole") + (place <= F.col("more")).cast("long"))).select("doc_id", "source", "size", "source_size", "target", "taken")
