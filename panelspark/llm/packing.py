"""Packing of tokenized documents into sequences: a configuration program over the length histogram."""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from contextlib import suppress
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import broadcast_if_small, materialize

CAPACITY = 2048
#: Pieces of one length that one window numbers.
NUMBERED = 100_000
#: Rows of a table of first numbers that may be broadcast.
FIRSTS = 500_000
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


#: The word pattern of the byte-level vocabulary (a fixed value of the public tokenizer).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_values() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that the file shows as themselves
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in shown)}


class Encoder:
    """Token ids of texts by a byte-level BPE file of the tokenizers library.

    The same vocabulary in tiktoken gives the same ids several times faster; it takes the texts whose characters both
    libraries class alike (Latin and its punctuation, the bulk of a corpus), tokenizers takes all others. The string of a
    special token is that token, as tokenizers has it by default, or with special_as_text ordinary text.
    """

    def __init__(self, path: str, special_as_text: bool = False) -> None:
        import json
        import re

        import tiktoken
        from tokenizers import Tokenizer

        self.slow = Tokenizer.from_file(path)
        self.slow.encode_special_tokens = special_as_text
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        special = {t["content"] for t in spec.get("added_tokens", ())}
        byte = byte_values()
        ranks = {bytes(byte[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in special}
        self.fast = tiktoken.Encoding("byte_bpe", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        named = "" if special_as_text else "".join("|" + re.escape(x) for x in sorted(special))
        self.other = re.compile("[^\x00-\u024f\u2010-\u2027]" + named)

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit numbers."""
        if not self.other.search(text):
            with suppress(ValueError):  # its pattern gives up on very long runs of one kind of character
                return self.fast.encode_to_numpy(text, disallowed_special=()).astype("<u4", copy=False).tobytes()
        return np.array(self.slow.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = 0, with_ids: bool = False) -> DataFrame:
    """Rows of PIECES (and ids array<long> if asked for) for docs (doc_id, text): each document's ids, then end_id.

    A document longer than capacity is cut into pieces of capacity; its first piece may be shorter. A null text is
    empty: one piece, end_id alone. Null ids and repeated rows are packed like any other; other columns are left out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, end = Encoder(tokenizer), np.array([end_id], "<u4").tobytes()
        for b in batches:
            ids = b.column(0).to_pylist()
            for lo in range(0, len(ids), 256):
                rows: dict[str, list] = {k: [] for k in ("doc_id", "piece", "start", "length", "ids_crc32", "ids")}
                for doc, text in zip(ids[lo : lo + 256], b.column(1)[lo : lo + 256], strict=True):
                    raw = enc.encode(text.as_py() or "") + end
                    n = len(raw) // 4
                    cuts = list(range(n % capacity or capacity, n + 1, capacity))
                    for k, (a, z) in enumerate(zip([0, *cuts[:-1]], cuts, strict=True)):
                        part = raw[4 * a : 4 * z]
                        for name, value in zip(rows, (doc, k, a, z - a, zlib.crc32(part), np.frombuffer(part, "<u4").tolist() if with_ids else None), strict=True):
                            rows[name].append(value)
                if not with_ids:
                    rows.pop("ids")
                types = {"piece": pa.int32(), "ids": pa.list_(pa.int64())}
                yield pa.RecordBatch.from_arrays([pa.array(v, types.get(k, pa.int64())) for k, v in rows.items()], list(rows))

    schema = PIECES + ", ids array<long>" * with_ids
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)


@dataclass
class Fractional:
    """A solution of the configuration program, spread over all configurations.

    A sequence of fill f is weighed by excess(f) and the weights of its lengths; reach[c] sums that over all sequences of
    exactly c tokens. cost sequences of that distribution, a whole number or not, hold covered pieces of each length; what
    they leave uncovered in sequences of one length each is counted in cost. No packing has fewer than bound sequences.
    """

    weight: np.ndarray
    reach: np.ndarray
    excess: np.ndarray
    covered: np.ndarray
    cost: float
    bound: float


def _spread(weight: np.ndarray, beta: float, volume: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """By a knapsack recursion that sums over all sequences instead of taking the best: reach, excess, the pieces of each
    length that sequences of so many tokens in all hold, and the number of those sequences."""
    size = len(weight)
    reach, back = np.zeros(size), np.zeros(size)  # back: reach from its end, so that the sum is one product
    reach[0] = back[-1] = 1
    with np.errstate(over="ignore", invalid="ignore"):  # the caller looks at whether the number is finite
        for c in range(1, size):
            reach[c] = back[size - 1 - c] = weight[1 : c + 1] @ back[size - c :]
    excess = np.exp(-beta * (1 - np.arange(size) / (size - 1)))
    pairs = np.convolve(reach, reach)[:size]
    covered = weight * np.correlate(np.append(excess, np.zeros(size - 1)), pairs, "valid")
    scale = volume / (covered @ np.arange(size))
    return reach, excess, covered * scale, float(reach @ excess) * scale


def _worth(lengths: np.ndarray, prices: np.ndarray, capacity: int) -> float:
    """The greatest total price that a sequence can hold: the knapsack by dynamic programming."""
    value = np.zeros(capacity + 1)
    for c in range(1, capacity + 1):
        k = int(np.searchsorted(lengths, c, "right"))
        value[c] = max(value[c - 1], float((value[c - lengths[:k]] + prices[:k]).max())) if k else 0.0
    return float(value[capacity])


def solve(histogram: dict[int, int], capacity: int = CAPACITY, sharpness: tuple[float, ...] = (60, 120, 250, 500, 1000), rounds: int = 60, gap: float = 1e-3) -> Fractional | None:
    """The configuration linear program: the least number of sequences, whole or not, that hold every piece.

    Multiplicative weights: each round multiplies a length's weight by how many of its pieces there are for each that the
    sequences now hold. All configurations take part, weighed by their lengths' weights, which a knapsack recursion over
    the fill sums exactly; so the solution is never limited to a list of columns. The sharper, the less room sequences
    leave. The weights' logarithms are prices; divided by the most that a sequence is worth at them (the knapsack by
    dynamic programming) they prove the bound. It ends once cost and bound are within gap, at the latest after the
    rounds of all steps of sharpness. None for an empty histogram.
    """
    need = np.zeros(capacity + 1)
    for n, count in histogram.items():
        need[n] = count
    lengths = np.flatnonzero(need)
    if not len(lengths):
        return None
    volume = float(need @ np.arange(capacity + 1))
    weight, rate = need * np.arange(capacity + 1) / volume, np.maximum(lengths / capacity, 0.3)
    bound, best, last = max(volume / capacity, float(need[capacity // 2 + 1 :].sum())), None, None
    for beta in sharpness:
        if last:  # the same prices at another sharpness
            weight[lengths] = np.exp(np.clip(np.log(np.maximum(weight[lengths], 1e-300)) * beta / last, -600, 600))
        last = beta
        for k in range(rounds + 1):
            reach, excess, covered, cost = _spread(weight, beta, volume)
            if not np.isfinite(cost) or k == rounds:
                break
            ratio = need[lengths] / np.maximum(covered[lengths], 1e-300)
            weight[lengths] *= np.clip(ratio, 1e-3, 1e3) ** rate
        if not np.isfinite(cost):
            break  # too sharp for doubles: the solution before stands
        cost += float((np.maximum(need - covered, 0)[lengths] / (capacity // lengths)).sum())
        prices = np.maximum(np.log(np.maximum(weight[lengths], 1e-300)) / beta + lengths / capacity, 0)
        if prices.any():
            bound = max(bound, float(prices @ need[lengths]) / _worth(lengths, prices, capacity))
        if best is None or cost < best.cost:
            best = Fractional(weight.copy(), reach, excess, covered, cost, bound)
        best.bound = bound
        if best.cost <= bound * (1 + gap):
            break
    return best


class _Draws:
    """Configurations drawn from a fractional solution, whose weights may be changed to lengths that are left."""

    def __init__(self, part: Fractional, capacity: int) -> None:
        self.rng, self.capacity = np.random.default_rng(17), capacity
        self.use(part.weight, part.reach, part.excess)

    def use(self, weight: np.ndarray, reach: np.ndarray, excess: np.ndarray) -> None:
        self.weight, self.reach = weight, reach
        self.fill = np.cumsum((reach * excess)[1:])
        self.steps: dict[int, np.ndarray] = {}

    def draw(self) -> dict[int, int]:
        config: dict[int, int] = {}
        room = 1 + int(np.searchsorted(self.fill, self.rng.random() * self.fill[-1], "right"))
        while room > 0:
            if room not in self.steps:
                self.steps[room] = np.cumsum(self.weight[1 : room + 1] * self.reach[room - 1 :: -1] if room else 0)
            sums = self.steps[room]
            n = 1 + min(int(np.searchsorted(sums, self.rng.random() * sums[-1], "right")), room - 1)
            config[n] = config.get(n, 0) + 1
            room -= n
        return config


def configurations(histogram: dict[int, int], capacity: int = CAPACITY, draws: int = 1500, phases: int = 14) -> list[tuple[dict[int, int], int]]:
    """(configuration, times): how many pieces of which lengths share a sequence, and how many sequences are so filled.

    solve()'s amounts are rounded by drawing configurations from them: each phase draws for half of the sequences that are
    left, takes a configuration a whole number of times as far as its pieces are left, and turns the weights to what is
    left. The remainder is packed by best fit decreasing on counts. All work is on at most capacity lengths and draws
    configurations a phase, whatever the number of documents.
    """
    left = np.zeros(capacity + 1, np.int64)
    for n, count in histogram.items():
        left[n] = count
    part = solve(histogram, capacity)
    out: list[tuple[dict[int, int], int]] = []
    if part is not None:
        source, at, beta = _Draws(part, capacity), np.arange(capacity + 1), -math.log(max(part.excess[0], 1e-300))
        whole = float(left @ at)
        for _ in range(phases):
            sequences = part.cost * float(left @ at) / whole
            count = min(draws, math.ceil(sequences / 2))
            times = max(1, int(sequences / 2 / max(count, 1)))
            taken = 0
            for _ in range(count):
                config = source.draw()
                n = min(times, min(int(left[k]) // t for k, t in config.items()))
                if n > 0:
                    out.append((config, n))
                    taken += n
                    for k, t in config.items():
                        left[k] -= t * n
            if not taken or sequences < 8:
                break
            weight = np.where(left > 0, source.weight, 0)
            for _ in range(4):
                reach, excess, covered, cost = _spread(weight, beta, float(left @ at))
                if not cost or not np.isfinite(cost):
                    break
                some = np.flatnonzero(left)
                weight[some] *= np.clip(left[some] / np.maximum(covered[some], 1e-300), 1e-3, 1e3) ** np.maximum(some / capacity, 0.3)
            reach, excess, covered, cost = _spread(weight, beta, float(left @ at)) if left.any() else (None, None, None, 0.0)
            if not cost or not np.isfinite(cost):
                break
            source.use(weight, reach, excess)
    groups: list[list] = []  # room, configuration, times
    for n in np.flatnonzero(left)[::-1]:
        count = int(left[n])
        while count:
            fits = [g for g in groups if g[0] >= n]
            if not fits:
                each = capacity // int(n)
                times = max(1, count // each)
                each = min(each, count)
                groups.append([capacity - each * int(n), {int(n): each}, times])
                count -= each * times
                continue
            g = min(fits, key=lambda x: x[0])
            times = min(g[2], count)
            if times < g[2]:
                groups.append([g[0], dict(g[1]), g[2] - times])
            g[2] = times
            g[0] -= int(n)
            g[1][int(n)] = g[1].get(int(n), 0) + 1
            count -= times
    return out + [(c, t) for _, c, t in groups]


def pack(parts: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Adds sequence_id and offset to rows with a length: places without gaps from 0 in as few sequences as found.

    Rows of one length are numbered in windows of about NUMBERED rows each, however many have that length, and take
    their places from a table of the configurations, which is as small as the histogram.
    """
    # the histogram has at most capacity rows
    histogram = {int(r[0]): int(r[1]) for r in parts.groupBy("length").count().collect()}
    plan = configurations(histogram, capacity)
    slots: dict[int, list[tuple[int, int, int, int]]] = {}
    used: dict[int, int] = {}
    sequence = 0
    for config, times in plan:
        offset = 0
        for n, k in sorted(config.items(), reverse=True):
            slots.setdefault(n, []).append((used.get(n, 0), k, sequence, offset))
            used[n] = used.get(n, 0) + k * times
            offset += n * k
        sequence += times
    table = {n: np.array(v, np.int64) for n, v in slots.items()}
    names = parts.columns
    key = [c for c in ("doc_id", "piece", "start", "ids_crc32") if c in names]
    salts = parts.sparkSession.createDataFrame([(n, -(-c // NUMBERED)) for n, c in histogram.items()], "length long, _salts long")  # capacity rows at most
    salted = parts.join(F.broadcast(salts), "length").withColumn("_salt", F.pmod(F.xxhash64(*key), F.col("_salts"))).drop("_salts")
    counts = salted.groupBy("length", "_salt").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("length").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    first = counts.select("length", "_salt", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_first"))
    within = F.row_number().over(Window.partitionBy("length", "_salt").orderBy(*key)) - 1
    # a row for NUMBERED pieces
    ranked = salted.withColumn("_rank", within).join(broadcast_if_small(first, FIRSTS), ["length", "_salt"]).withColumn("_rank", F.col("_rank") + F.col("_first")).select(*names, "_rank")
    schema = T.StructType([*parts.schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            length = b.column(names.index("length")).to_numpy()
            rank = b.column(len(names)).to_numpy()
            seq, off = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            for n in np.unique(length):
                at = length == n
                t = table[int(n)]
                row = t[np.searchsorted(t[:, 0], rank[at], "right") - 1]
                k = rank[at] - row[:, 0]
                seq[at], off[at] = row[:, 2] + k // row[:, 1], row[:, 3] + k % row[:, 1] * n
            yield pa.RecordBatch.from_arrays([*b.columns[: len(names)], pa.array(seq), pa.array(off)], schema.names)

    return ranked.mapInArrow(place, schema)


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """pieces() placed by pack(); the tokenized pieces are written once, for three passes read them."""
    return pack(materialize(pieces(docs, tokenizer, capacity, with_ids=with_ids), "pieces"), capacity)
