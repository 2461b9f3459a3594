"""Quality scores from compressed sizes under dictionaries of good and of bad text."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Labelled rows per class that a model may see.
ROWS_PER_CLASS = 1500
DICTIONARY_BYTES, LEVEL = 256 << 10, 3
#: Bytes of a text that a dictionary is trained on, and of each of the pieces that they are taken in.
SHARE, PIECE = 3000, 150


@dataclass
class Model:
    """Dictionaries of the two classes, and the weights of the calibration, one for each feature."""

    good: bytes
    bad: bytes
    weights: tuple[float, ...]


def held_out(doc_id: F.Column) -> F.Column:
    """Whether a row must not be learned from: crc32 of the id as text is divisible by 5, or the id is null."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(True))


def _pieces(text: bytes, share: int) -> bytes:
    """So many bytes of a text, in pieces spread evenly from its start to its end; a text of no more than that whole."""
    if len(text) <= share:
        return text
    n = max(2, share // PIECE)
    size = share // n
    return b"\n".join(text[(at := k * (len(text) - size) // (n - 1)) : at + size] for k in range(n))


def _dictionary(pieces: list[bytes]) -> bytes:
    """A zstandard dictionary trained on the texts' pieces, or the pieces themselves where they are too few to train on."""
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, pieces).as_bytes()
    except zstandard.ZstdError:
        return b"\n".join(pieces)[:DICTIONARY_BYTES] or b"\n"


class Sizer:
    """Compressed sizes of a text under the good dictionary and under the bad one."""

    def __init__(self, good: bytes, bad: bytes) -> None:
        self.coders = []
        for content in (good, bad):
            d = zstandard.ZstdCompressionDict(content)
            d.precompute_compress(level=LEVEL)
            self.coders.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False))

    def features(self, text: bytes) -> list[float]:
        """The normalised difference of the two sizes (their log ratio; higher: good), their mean as a share of the text,
        the length, and how both go with it: short texts hardly compress."""
        good, bad = (len(z.compress(text)) + 10 for z in self.coders)
        n = len(text) + 20
        size, diff, rate = math.log(n), math.log(bad / good), math.log((good + bad) / (2 * n))
        return [1.0, diff, diff * size, rate, rate * size, size]


def _fit_weights(x: np.ndarray, y: np.ndarray) -> tuple[float, ...]:
    """Logistic regression by Newton's method on standardised features (the first is 1), with a small ridge."""
    mean, sd = x.mean(0), x.std(0)
    mean[0], sd[sd == 0] = 0, 1
    x = (x - mean) / sd
    w = np.zeros(x.shape[1])
    if not len(y) or y.min() == y.max():
        w[0] = 0.0 if not len(y) else math.log(49) * (2 * y[0] - 1)
        return tuple(float(v) for v in w)
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (p - y) + 1e-2 * w
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 1e-2 * np.eye(x.shape[1]), grad)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    w = w / sd
    w[0] -= mean[1:] @ w[1:]
    return tuple(float(v) for v in w)


def _chosen(docs: DataFrame, known: DataFrame, rows_per_class: int) -> dict[int, list[tuple[int, int]]]:
    """By class, (doc_id, xxhash64 of text) of the labelled rows to learn from, rows_per_class at most; equal rows count once."""
    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("h")).join(known, "doc_id").distinct()
    return {q: [(r["doc_id"], r["h"]) for r in found.where(F.col("quality") == q).orderBy(F.xxhash64("doc_id"), "doc_id", "h").limit(rows_per_class).collect()] for q in (0, 1)}


def _of_rows(docs: DataFrame, keys: list[tuple[int, int]], make: Callable[[], Callable[[bytes], object]], kind: str) -> list:
    """What make()(text) gives for the whole text of each key, in the order of keys; computed in tasks, so texts stay there."""
    spark = docs.sparkSession
    if not keys:
        return []
    wanted = F.broadcast(spark.createDataFrame(keys, "doc_id long, h long"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = make()
        for b in batches:
            made = [f((t.as_py() or "").encode()) for t in b.column(2)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(made, pa.binary() if kind == "binary" else pa.list_(pa.float64()))], ["doc_id", "h", "made"])

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("h"), "text").join(wanted, ["doc_id", "h"]).select("doc_id", "h", "text")
    got = texts.mapInArrow(run, f"doc_id long, h long, made {kind}").dropDuplicates(["doc_id", "h"]).collect()
    made = {(r["doc_id"], r["h"]): r["made"] for r in got}
    return [made[k] for k in keys]


def fit(docs: DataFrame, labels: DataFrame, rows_per_class: int = ROWS_PER_CLASS) -> Model:
    """Learns from labelled rows that aren't held out, rows_per_class of each quality at most, those of least hash.

    Half of them (by turns) make the dictionaries, from pieces spread over each whole text; the others the calibration,
    on their whole texts, weighted as the labels' classes are. Only pieces and features reach the driver.
    labels: doc_id, quality; null ids, null qualities and all other columns are left out. Without labels of both
    kinds every score is 0.5, or near the only label.
    """
    known = labels.where("doc_id is not null and quality in (0, 1)").where(~held_out(F.col("doc_id"))).select("doc_id", F.col("quality").cast("int").alias("quality"))
    totals = {r[0]: r[1] for r in known.groupBy("quality").count().collect()}
    by = _chosen(docs, known, rows_per_class)
    halves = {q: (by[q][::2], by[q][1::2]) for q in by}
    content = {}
    for q, (half, _) in halves.items():
        content[q] = _dictionary([bytes(p) for p in _of_rows(docs, half, lambda: lambda t: _pieces(t, SHARE), "binary")])
    good, bad = content[1], content[0]
    rest = [(f, q) for q in (0, 1) for f in _of_rows(docs, halves[q][1], lambda: Sizer(good, bad).features, "array<double>")]
    if not rest:
        return Model(good, bad, (0.0,) * len(Sizer(good, bad).features(b"")))
    x, y = np.array([f for f, _ in rest]), np.array([q for _, q in rest], float)
    keep = np.array([max(totals.get(q, 1), 1) / max(len(by[q]), 1) for q in (0, 1)])
    times = np.maximum(1, np.round(keep / keep.min() * 4)).astype(int)[y.astype(int)]
    return Model(good, bad, _fit_weights(np.repeat(x, times, 0), np.repeat(y, times)))


def score(docs: DataFrame, model: Model, name: str = "score") -> DataFrame:
    """All columns of docs (column text) and the score, from 0 to 1, higher for better text; a null text counts as empty.

    A column that has the score's name already gives way to it.
    """
    docs = docs.drop(name)
    names = docs.columns
    at = names.index("text")
    schema = T.StructType([*docs.schema.fields, T.StructField(name, T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sizer, w = Sizer(model.good, model.bad), np.array(model.weights)
        for b in batches:
            f = np.array([sizer.features((t.as_py() or "").encode()) for t in b.column(at)], float).reshape(-1, len(w))
            p = 1 / (1 + np.exp(-np.clip(f @ w, -30, 30)))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(p, pa.float64())], [*names, name])

    return docs.toDF(*[f"_{k}" for k in range(len(names))]).mapInArrow(run, schema)  # plain names, for any that docs have
