"""Periodic runs of words: suffix classes united by decreasing common prefix, as Kruskal's algorithm unites trees."""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A run has so many words at least, and repeats its period so many times.
MIN_LENGTH, MIN_EXPONENT = 6, 4
#: Words that one pass of the suffix sort takes together; a longer text is a pass of its own.
PASS_WORDS = 400_000
RUNS = "n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"


def least_prefix(min_length: int, min_exponent: int) -> int:
    """The shortest common prefix of two places a period apart that a run of the wanted length can have at its start."""
    longest = -(-min_length // min_exponent)  # from there on the exponent decides, and the prefix grows with the period
    return max(1, min(max(min_length, min_exponent * q) - q for q in range(1, longest + 1)))


def common_prefixes(codes: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(p, q, lcp): neighbours in suffix order whose suffixes share at least so many words, and how many they share.

    Prefix doubling: ranks of 1, 2, 4, ... words; only places whose words so far stand elsewhere too are sorted on. The
    ranks of all steps are kept (4 bytes a word and step), for they give the common prefixes, from the longest step down.
    """
    n = len(codes)
    order = np.argsort(codes, kind="stable").astype(np.int32)
    live, ranks, k = order, [], 1
    rank = np.full(n + 1, -1, np.int32)
    key = codes[order]
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if n else np.empty(0, np.int64)
    size = np.diff(np.append(first, n))
    rank[order] = np.repeat(first, size)
    at = np.flatnonzero(np.repeat(size, size) > 1)  # places in suffix order that aren't settled
    live = order[at]
    ranks.append(rank)
    while len(live):
        rank = ranks[-1].copy()
        key = rank[live].astype(np.int64) * (n + 1) + ranks[-1][np.minimum(live.astype(np.int64) + k, n)] + 1
        by = np.argsort(key, kind="stable")
        live, key = live[by], key[by]
        order[at] = live  # classes are contiguous and keep their places
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        size = np.diff(np.append(first, len(live)))
        rank[live] = np.repeat(at[first], size)
        ranks.append(rank)
        more = np.repeat(size, size) > 1
        at, live, k = at[more], live[more], 2 * k
    level = min(len(ranks) - 1, least.bit_length() - 1)
    near = np.flatnonzero(ranks[level][order[1:]] == ranks[level][order[:-1]])
    p, q = order[near].astype(np.int64), order[near + 1].astype(np.int64)
    lcp = np.zeros(len(p), np.int64)
    for step in range(len(ranks) - 1, -1, -1):
        lcp += (ranks[step][p + lcp] == ranks[step][q + lcp]).astype(np.int64) << step
    far = lcp >= least
    return p[far], q[far], lcp[far]


def _seeds(p: np.ndarray, q: np.ndarray, lcp: np.ndarray, times: int) -> list[tuple[int, int, int]]:
    """(period, end, place): places that become neighbours in a class of suffixes, a distance apart that fits into the
    words they share times over.

    Links are taken by decreasing lcp. A class is an ordered list of places; where classes unite the smaller ones move
    into the largest and take its name, so a place moves a logarithm of times. All classes of one lcp unite before
    neighbours are looked at: no place between the two shares so many words, so their distance is a smallest period.
    """
    places, ends = np.unique(np.concatenate([p, q]), return_inverse=True)
    at = places.tolist()
    index = dict(zip(at, range(len(at)), strict=True))
    owner = list(range(len(at)))  # by place: the name of its class
    members: dict[int, list[int]] = {}
    by = np.argsort(-lcp, kind="stable")
    left, right, shared = ends[: len(p)][by].tolist(), ends[len(p) :][by].tolist(), lcp[by].tolist()
    out, k, total = [], 0, len(shared)
    while k < total:
        level, link, root_of = shared[k], {}, {}
        while k < total and shared[k] == level:
            a, b = owner[left[k]], owner[right[k]]
            while a in link:
                a = link[a]
            while b in link:
                b = link[b]
            k += 1
            if a == b:
                continue
            if len(members.get(a, (0,))) < len(members.get(b, (0,))):
                a, b = b, a
            link[b] = a
        for b in link:
            a = b
            while a in link:
                a = link[a]
            root_of.setdefault(a, []).append(b)
        for a, others in root_of.items():
            base = members.get(a) or [at[a]]
            moved = [x for b in others for x in (members.pop(b, None) or (at[b],))]
            if len(moved) > 1:
                moved.sort()
            if 16 * len(moved) > len(base):
                base = sorted(base + moved)  # linear: sorted parts
            else:
                for x in moved:
                    if x > base[-1]:
                        base.append(x)
                    else:
                        insort(base, x)
            members[a] = base
            for x in moved:
                i = bisect_left(base, x)
                mine = owner[index[x]]
                if i and (x - base[i - 1]) * times <= level and owner[index[base[i - 1]]] != mine:
                    out.append((x - base[i - 1], x + level, base[i - 1]))
                # a neighbour above that moves too sees this one below it
                if i + 1 < len(base) and (base[i + 1] - x) * times <= level and owner[index[base[i + 1]]] == a:
                    out.append((base[i + 1] - x, base[i + 1] + level, x))
            for x in moved:
                owner[index[x]] = a
    return out


def find_runs(codes: np.ndarray, min_length: int = MIN_LENGTH, min_exponent: int = MIN_EXPONENT) -> np.ndarray:
    """Rows (start, length, period), by start and period, of the runs of codes: longest stretches of a smallest period."""
    p, q, lcp = common_prefixes(codes, least_prefix(min_length, min_exponent))
    found = _seeds(p, q, lcp, min_exponent - 1) if len(p) else []
    if not found:
        return np.empty((0, 3), np.int64)
    period, end, start = np.array(found, np.int64).T
    by = np.lexsort([start, period, end])  # the first place of each run; its other places have shared words that end there too
    period, end, start = period[by], end[by], start[by]
    first = np.concatenate([[True], (period[1:] != period[:-1]) | (end[1:] != end[:-1])])
    rows = np.stack([start, end - start, period], 1)[first]
    rows = rows[rows[:, 1] >= np.maximum(min_length, min_exponent * rows[:, 2])]
    return rows[np.lexsort([rows[:, 2], rows[:, 0]])]


def _described(words: list[bytes], runs: np.ndarray) -> tuple[dict, bytes]:
    """The columns of RUNS and the text without repeats, for one text's words and runs."""
    if not len(runs):
        text = b" ".join(words)
        return {"n_runs": 0, "start": None, "length": None, "period": None, "exponent_milli": None, "runs_sha256": sha256(b"").hexdigest(), "collapsed_sha256": sha256(text).hexdigest()}, text
    best = runs[np.lexsort([runs[:, 2], runs[:, 0], -runs[:, 1]])[0]].tolist()
    change = np.zeros(len(words) + 1, np.int64)
    np.add.at(change, runs[:, 0] + runs[:, 2], 1)
    np.add.at(change, runs[:, 0] + runs[:, 1], -1)
    keep = np.flatnonzero(np.cumsum(change[:-1]) == 0)
    text = b" ".join([words[k] for k in keep.tolist()])
    listed = "".join(f"{s},{n},{q}\n" for s, n, q in runs.tolist())
    return {"n_runs": len(runs), "start": best[0], "length": best[1], "period": best[2], "exponent_milli": 1000 * best[1] // best[2], "runs_sha256": sha256(listed.encode()).hexdigest(), "collapsed_sha256": sha256(text).hexdigest()}, text


def _passes(texts: list[str | None]) -> Iterator[list[list[bytes]]]:
    """The words of the texts, some texts together."""
    some, n = [], 0
    for t in texts:
        words = (t or "").encode().split()  # by ASCII white space: 0x20, 0x09 to 0x0D
        if some and n + len(words) > PASS_WORDS:
            yield some
            some, n = [], 0
        some.append(words)
        n += len(words)
    yield some


def periodic_runs(docs: DataFrame, min_length: int = MIN_LENGTH, min_exponent: int = MIN_EXPONENT, with_runs: bool = False, with_text: bool = False) -> DataFrame:
    """doc_id and RUNS, a row for each row of docs (doc_id, text); also runs array<struct<start,length,period>> and collapsed.

    Words are what ASCII white space parts, numbered from 0. A run is a stretch of min_length words or more whose smallest
    period q (words q apart are equal) fits into it min_exponent times (2 or more), and that no neighbouring word extends.
    start, length and period tell of the longest (ties: the first, then the smallest period; null without a run),
    exponent_milli is 1000 x length / period, rounded down. runs_sha256 digests the lines "start,length,period" of all,
    by start and period. collapsed is the text without the words that any run has after its first period, joined by one
    blank. A null text has no words. Repeated rows and null ids are rows like any other; other columns are left out.

    A document is judged alone, so nothing is shuffled; a task holds the words of PASS_WORDS words' worth of texts, or one
    longer text (about 150 bytes a word).
    """
    if min_exponent < 2:
        raise ValueError("a run repeats its period twice at least")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, len(b), 256):
                part = b.slice(lo, 256)
                rows: list[dict] = []
                for some in _passes(part.column(1).to_pylist()):
                    codes, starts = [], [0]
                    for words in some:
                        known: dict[bytes, int] = {}
                        base = starts[-1]
                        codes += [known.setdefault(w, base + len(known)) for w in words]
                        codes.append(base + len(words))  # a word of no text: runs and prefixes end here
                        starts.append(len(codes))
                    runs = find_runs(np.array(codes, np.int64), min_length, min_exponent)
                    cut = np.searchsorted(runs[:, 0], starts)
                    for k, words in enumerate(some):
                        mine = runs[cut[k] : cut[k + 1]] - [starts[k], 0, 0]
                        row, text = _described(words, mine)
                        if with_runs:
                            row["runs"] = [{"start": s, "length": n, "period": q} for s, n, q in mine.tolist()]
                        if with_text:
                            row["collapsed"] = text.decode()
                        rows.append(row)
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array([r[c] for r in rows], t) for c, t in types.items())], ["doc_id", *types])

    long, text = pa.int64(), pa.string()
    types = {"n_runs": long, "start": long, "length": long, "period": long, "exponent_milli": long, "runs_sha256": text, "collapsed_sha256": text}
    schema = f"doc_id long, {RUNS}"
    if with_runs:
        types["runs"] = pa.list_(pa.struct([("start", long), ("length", long), ("period", long)]))
        schema += ", runs array<struct<start:long,length:long,period:long>>"
    if with_text:
        types["collapsed"] = text
        schema += ", collapsed string"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)


def with_planted_tails(docs: DataFrame) -> DataFrame:
    """(doc_id, text) of docs; of a tenth of the documents, by crc32 of the id, all words from some place on repeat a period.

    With h the crc32, g = h // 10 and n words, it begins at word g % n; its period is 1 + (n - g % n) // (3 + g % 8) words.
    """
    h = F.crc32(F.col("doc_id").cast("long").cast("string").cast("binary"))
    words = F.regexp_extract_all("text", F.lit(r"([^\x20\x09-\x0D]+)"), 1)
    some = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", h.alias("_h")).withColumn("_w", F.when(F.col("_h") % 10 == 0, words))
    g, n = F.floor(F.col("_h") / 10).cast("long"), F.size("_w").cast("long")
    a = (g % n).cast("int")
    period = F.expr("1 + (size(_w) - _a) div (3 + _g % 8)").cast("int")
    placed = some.withColumns({"_g": g, "_a": F.when(n > 0, a)}).withColumn("_p", F.when(F.col("_a").isNotNull(), period))
    head, cycle = F.slice("_w", F.lit(1), F.col("_a")), F.slice("_w", F.col("_a") + 1, F.col("_p"))
    tail = F.slice(F.flatten(F.array_repeat(cycle, (F.size("_w") / F.col("_p")).cast("int") + 1)), F.lit(1), F.size("_w") - F.col("_a"))
    return placed.select("doc_id", F.when(F.col("_p").isNotNull(), F.array_join(F.concat(head, tail), " ")).otherwise(F.col("text")).alias("text"))
