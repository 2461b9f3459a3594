"""SimHash near-duplicates: fingerprints, and all pairs within a few bits by a generalised pigeonhole."""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import broadcast_if_small, materialize
from .components import connected_components

BITS = 64
#: What comparing a pair costs, a probe being 1.
PAIR = 0.002
#: Up to so many differing bits, a second key keeps the runs short.
SECOND_KEY = 3
#: Probes that a fingerprint may make of one group of bits.
MOST_PROBES = 4096
#: A row is kept under its value, probes another, or (at threshold 0) both.
KEPT, PROBE, BOTH = 0, 1, 2
#: Rows of one value of a group of bits that one task compares; more are dealt in pieces of half as many.
RUN = 8192
_xxh64 = partial(xxhash.xxh64_intdigest, seed=42)


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def fingerprint(text: str | None, shingle: int = 3, distinct: bool = False) -> int:
    """Words are runs without ASCII white space, A-Z lower-cased; a bit is 1 if set in over half the shingles' hashes.

    distinct: each shingle counts once, however often it is repeated.
    """
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = zip(*(words[k:] for k in range(shingle)), strict=False) if len(words) > shingle else [tuple(words)]
    h = np.fromiter(map(_xxh64, map(b" ".join, set(shingles) if distinct else shingles)), np.uint64)
    ones = np.zeros(BITS, np.int64)
    for k in range(0, len(h), 1 << 16):
        ones += np.unpackbits(h[k : k + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(h), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, shingle: int = 3, distinct: bool = False) -> DataFrame:
    """(doc_id, fp): fp is the fingerprint as a signed long. Null text or no words: 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = [_signed(fingerprint(t.as_py(), shingle, distinct)) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps, pa.int64())], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, fp long")


def bit_counts(classes: DataFrame) -> tuple[int, np.ndarray]:
    """The number of fingerprints, and in how many each two bits are both 1; from all rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both, n = np.zeros((BITS, BITS)), 0
        for b in batches:
            x = np.unpackbits(b.column(0).to_numpy().view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float32)
            for k in range(0, len(x), 1 << 16):
                both += x[k : k + (1 << 16)].T @ x[k : k + (1 << 16)]
            n += len(x)
        cells = np.append(both.ravel(), n).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(cells), dtype=np.int32)), pa.array(cells)], ["cell", "n"])

    rows = classes.select("fp").mapInArrow(run, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect()
    cells = np.zeros(BITS * BITS + 1)
    for cell, n in rows:
        cells[cell] = n
    return int(cells[-1]), cells[:-1].reshape(BITS, BITS)


def group_bits(n: int, both: np.ndarray, parts: int) -> list[list[int]]:
    """Parts of nearly equal size; each takes the free bit that agrees most with the rest, then those that correlate most with it."""
    p = np.diag(both) / max(n, 1)
    sd = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    corr = np.abs((both / max(n, 1) - np.outer(p, p)) / np.outer(sd, sd))
    free, out = list(range(BITS)), []
    for k in range(parts):
        size = len(free) // (parts - k)
        part = [max(free, key=lambda b: (corr[b, free].sum(), -b))]
        free.remove(part[0])
        while len(part) < size:
            part.append(max(free, key=lambda b: (corr[b, part].sum(), -b)))
            free.remove(part[-1])
        out.append(sorted(part))
    return out


def allocate(costs: list[list[float]], distance: int) -> list[int] | None:
    """Thresholds, -1 and up, that sum to distance - parts + 1 at the least total cost; costs[i][t + 1] is part i's at t.
    None if the costs' thresholds don't reach that sum.

    Two fingerprints within distance agree within its threshold on some part, for else they would differ in at least
    sum(t + 1) = distance + 1 bits.
    """
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for part in costs:
        step: dict[int, tuple[float, list[int]]] = {}
        for spent, (cost, chosen) in best.items():
            for t1, c in enumerate(part):
                if spent + t1 <= distance + 1 and (spent + t1 not in step or cost + c < step[spent + t1][0]):
                    step[spent + t1] = (cost + c, [*chosen, t1 - 1])
        best = step
    return best[distance + 1][1] if distance + 1 in best else None


def _mask(bits: list[int]) -> int:
    return _signed(sum(1 << b for b in bits))


def plan_parts(classes: DataFrame, distance: int, choices: tuple[int, ...]) -> tuple[list[list[int]], list[int]]:
    """Bit groups and their thresholds, for the number of groups (of choices) that costs least.

    Costs: probes, and candidate pairs at PAIR of a probe: pairs that share a group's value (counted over all rows),
    times how many more a model of independent bits lets in at each threshold.
    """
    n, both = bit_counts(classes)
    p = np.diag(both) / max(n, 1)
    differ = np.clip(2 * p * (1 - p), 1e-6, 1)
    options = {m: group_bits(n, both, m) for m in choices}
    keys = F.explode(F.array(*[F.struct(F.lit(m).alias("m"), F.lit(i).alias("part"), F.col("fp").bitwiseAND(_mask(g)).alias("key")) for m, groups in options.items() for i, g in enumerate(groups)])).alias("k")
    same = classes.select(keys).groupBy("k.m", "k.part", "k.key").agg(F.count(F.lit(1)).alias("c")).groupBy("m", "part").agg(F.sum(F.col("c").cast("double") * F.col("c")).alias("s"))
    equal = {(r["m"], r["part"]): r["s"] for r in same.collect()}
    best = None
    for m, groups in options.items():
        costs = []
        for i, g in enumerate(groups):
            dist = np.array([1.0])
            for b in g:
                dist = np.convolve(dist, [1 - differ[b], differ[b]])
            within = np.cumsum(dist)
            probes = np.cumsum([comb(len(g), d) for d in range(min(distance, len(g)) + 1)])
            costs.append([0.0] + [PAIR * equal.get((m, i), 0.0) * within[t] / max(within[0], 1e-300) + max(n, 1) * float(k) for t, k in enumerate(probes) if k <= MOST_PROBES])
        chosen = allocate(costs, distance)
        if chosen is None:
            continue
        total = sum(c[t + 1] for c, t in zip(costs, chosen, strict=True))
        if best is None or total < best[0]:
            best = (total, groups, chosen)
    if best is None:
        raise ValueError(f"no choice of {choices} groups reaches distance {distance} within {MOST_PROBES} probes")
    return best[1], best[2]


def _run_links(fp: np.ndarray, rep: np.ndarray, a: np.ndarray, b: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect what the pairs of a run (rows a, kept under the value, against rows b, that probe it) connect.

    The pairs are counted in blocks; each row links to the least label it meets, until no label falls.
    """
    label = rep.copy()
    most = np.iinfo(np.int64).max
    rows = max(1, (1 << 22) // max(1, len(b)))
    while True:
        old = label.copy()
        for lo in range(0, len(a), rows):
            part = a[lo : lo + rows]
            near = np.bitwise_count(fp[part][:, None] ^ fp[b][None, :]) <= distance
            if not near.any():
                continue
            label[part] = np.minimum(label[part], np.where(near, label[b][None, :], most).min(1))
            label[b] = np.minimum(label[b], np.where(near, label[part][:, None], most).min(0))
        if (label == old).all():
            break
    moved = label != rep
    return label[moved], rep[moved]


def _linked(us: list[np.ndarray], vs: list[np.ndarray]) -> pa.RecordBatch:
    none = [np.empty(0, np.int64)]
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(us or none)), pa.array(np.concatenate(vs or none))], ["u", "v"])


def _whole_runs(rows: DataFrame, distance: int) -> DataFrame:
    """Links of the runs (rows of one part and key) of RUN rows at most: many runs in a task, each held whole."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []

        def flush(cols: list[np.ndarray], last: bool) -> tuple[pa.RecordBatch, list[np.ndarray]]:
            part, key, fp, rep, role = cols
            cut = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (part[1:] != part[:-1])]))
            ends = np.append(cut[1:], len(key))
            runs = np.flatnonzero((ends - cut)[: None if last else -1] > 1)
            us, vs = [], []
            for s, e in zip(cut[runs], ends[runs], strict=True):
                u, v = _run_links(fp[s:e], rep[s:e], np.flatnonzero(role[s:e] != PROBE), np.flatnonzero(role[s:e] != KEPT), distance)
                us.append(u)
                vs.append(v)
            return _linked(us, vs), [c[cut[-1] :] for c in cols]

        n = 0
        for b in batches:
            cols = [b.column(0).to_numpy(), b.column(1).to_numpy(), b.column(2).to_numpy().view(np.uint64), b.column(3).to_numpy(), b.column(4).to_numpy()]
            held.append(cols)
            n += len(cols[0])
            if n > 200_000:
                out, rest = flush([np.concatenate(c) for c in zip(*held, strict=True)], False)
                yield out
                held, n = [rest], 0
        if held and sum(len(h[0]) for h in held):
            yield flush([np.concatenate(c) for c in zip(*held, strict=True)], True)[0]

    return rows.select("part", "key", "fp", "rep", "role").repartition("part", "key").sortWithinPartitions("part", "key").mapInArrow(run, "u long, v long")


def _split_runs(rows: DataFrame, distance: int) -> DataFrame:
    """Links of runs (with their number of pieces) that are too long for a task: salted into pieces of about RUN / 2 rows, and
    every two pieces meet in a task of their own, which gives a link a row at most."""
    piece = F.pmod(F.xxhash64("rep", "fp"), F.col("pieces")).cast("int")
    dealt = rows.withColumn("own", piece).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)))
    dealt = dealt.select("part", "key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "fp", "rep", "role")

    def run(t: pa.Table) -> pa.Table:
        i, j, own = t.column("i")[0].as_py(), t.column("j")[0].as_py(), t.column("own").to_numpy()
        fp, rep, role = t.column("fp").to_numpy().view(np.uint64), t.column("rep").to_numpy(), t.column("role").to_numpy()
        us, vs = [], []
        for x, y in {(i, j), (j, i)}:
            u, v = _run_links(fp, rep, np.flatnonzero((own == x) & (role != PROBE)), np.flatnonzero((own == y) & (role != KEPT)), distance)
            us.append(u)
            vs.append(v)
        return pa.Table.from_batches([_linked(us, vs)])

    return dealt.groupBy("part", "key", "i", "j").applyInArrow(run, "u long, v long")


def linking_forest(classes: DataFrame, distance: int, choices: tuple[int, ...] = (3, 4, 5, 6)) -> DataFrame:
    """(u, v) links that connect classes (fp, rep) as all pairs within distance do, without listing all pairs.

    A pair must agree within the threshold on some group of bits: each fingerprint is kept under its value of each group,
    and probes the values within the group's threshold. Up to a distance of SECOND_KEY a pair must also agree fully on one
    of distance + 1 cuts of the other bits, which is then part of the key. Rows of one value meet in one task, sorted,
    where the bits are counted in blocks; it gives a link a row at most, so a large group of copies doesn't multiply. A
    value of more than RUN rows is dealt in pieces, of which every two meet in a task: its work grows with the square of
    the different fingerprints that share the value, its memory does not. Fewer than two classes give no links.
    """
    classes = classes.where("rep is not null")
    if classes.limit(2).count() < 2:
        return classes.sparkSession.createDataFrame([], "u long, v long")
    groups, thresholds = plan_parts(classes, distance, choices)
    keys = []
    for i, (g, t) in enumerate(zip(groups, thresholds, strict=True)):
        if t < 0:
            continue
        others = [b for k, h in enumerate(groups) if k != i for b in h]
        cuts = [others[j :: distance + 1] for j in range(distance + 1)] if distance <= SECOND_KEY else [[]]
        flips = [_mask(list(c)) for d in range(t + 1) for c in combinations(g, d)]
        for j, cut in enumerate(cuts):
            place, key = F.lit(i * len(cuts) + j).alias("part"), F.col("fp").bitwiseAND(_mask(g + cut))
            keys.append(F.struct(place, key.alias("key"), F.lit(KEPT if t else BOTH).alias("role")))
            keys += [F.struct(place, key.bitwiseXOR(x).alias("key"), F.lit(PROBE).alias("role")) for x in flips if t]
    rows = classes.select("fp", "rep", F.explode(F.array(*keys)).alias("k")).select("k.part", "k.key", "fp", "rep", "k.role")
    long = rows.groupBy("part", "key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > RUN).select("part", "key", F.ceil(F.col("n") * 2 / RUN).cast("int").alias("pieces"))
    long = materialize(long, "long_runs")
    if not long.limit(1).count():
        return _whole_runs(rows, distance).distinct()
    few = broadcast_if_small(long, 100_000)
    return _whole_runs(rows.join(few, ["part", "key"], "left_anti"), distance).union(_split_runs(rows.join(few, ["part", "key"]), distance)).distinct()


def near_duplicates(docs: DataFrame, distance: int = 2, shingle: int = 3, distinct: bool = False) -> DataFrame:
    """(doc_id, fp, component_id), one row per row of docs (doc_id, text): the smallest doc_id reachable over links.

    Fingerprints link at distance or fewer differing bits; documents without words have fingerprint 0 and link like any
    other. Equal fingerprints are taken as one class from the start, so a group of copies, however large, is one row of
    the search. A row with a null doc_id
    gets its class's component, null if no document there has an id. Repeated rows stay; an empty table gives none;
    other columns are left out.
    """
    fps = materialize(fingerprints(docs, shingle, distinct), "fingerprints")
    classes = materialize(fps.groupBy("fp").agg(F.min("doc_id").alias("rep")), "classes")
    labels = connected_components(linking_forest(classes, distance, (3,) if distance <= SECOND_KEY else (3, 4, 5, 6)))
    named = materialize(classes.join(labels, F.col("rep") == F.col("node"), "left").select("fp", F.coalesce("component", "rep").alias("component_id")), "components")
    return fps.join(named, "fp").select("doc_id", "fp", "component_id")
