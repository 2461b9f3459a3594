"""Near copies by the similarity of their sets of shingles: fingerprints and bands of least hashes find the candidates, the
sets decide."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import broadcast_if_small, materialize, scratch_area
from .components import connected_components
from .simhash import _signed, _xxh64, fingerprint, linking_forest

#: Texts of a candidate group that one task compares with each other, and those that every task of the group sees.
BLOCK, PIVOTS = 512, 16
#: Bands of a set, and the least hashes in each: at a similarity of 0.8 two sets share a band with a probability of 0.99.
BANDS, ROWS = 16, 6
#: Texts of a candidate group are compared up to so many different bits of 64; similar ones have 10 on average, others 32.
FAR_BITS = 24
_ODD, _MASK = (np.random.default_rng(11).integers(1, 1 << 63, (2, BANDS * ROWS), np.uint64) * np.uint64(2) + np.uint64(1))


def shingle_set(text: str | None, shingle: int) -> np.ndarray:
    """The sorted hashes of a text's shingles; one of all its words where it has no more than that; none without words."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.empty(0, np.uint64)
    parts = zip(*(words[k:] for k in range(shingle)), strict=False) if len(words) > shingle else [tuple(words)]
    return np.unique(np.fromiter(map(_xxh64, map(b" ".join, parts)), np.uint64))


def bands(s: np.ndarray) -> list[int]:
    """A hash of each band's least hashes of a shingle set; none of an empty set."""
    if not len(s):
        return []
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max)
    for lo in range(0, len(s), 4096):
        part = s[lo : lo + 4096, None] ^ _MASK
        np.minimum(least, (part * _ODD).min(0), out=least)
    return [_signed(xxhash.xxh64_intdigest(least[k * ROWS : (k + 1) * ROWS].tobytes(), seed=k)) for k in range(BANDS)]


def _similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Whether two sets share at least so many hundredths of their union."""
    if min(len(a), len(b)) * 100 < percent * max(len(a), len(b)):
        return False
    if len(a) > len(b):
        a, b = b, a
    both = int((b[np.minimum(np.searchsorted(b, a), len(b) - 1)] == a).sum()) if len(a) else 0
    return both * 100 >= percent * (len(a) + len(b) - both)


def _described(docs: DataFrame, bits_shingle: int, shingle: int) -> DataFrame:
    """(doc_id, h, fp, node, n, bands): the fingerprint, the hash of the shingle set, its size and its bands."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps, nodes, sizes, found = [], [], [], []
            for t in b.column(2):
                text = t.as_py()
                s = shingle_set(text, shingle)
                fps.append(_signed(fingerprint(text, bits_shingle, True)))
                nodes.append(_signed(xxhash.xxh64_intdigest(s.tobytes(), seed=7)))
                sizes.append(len(s))
                found.append(bands(s))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(fps, pa.int64()), pa.array(nodes, pa.int64()), pa.array(sizes, pa.int64()), pa.array(found, pa.list_(pa.int64()))], ["doc_id", "h", "fp", "node", "n", "bands"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("h"), "text").mapInArrow(run, "doc_id long, h long, fp long, node long, n long, bands array<long>")


def _with_sets(docs: DataFrame, members: DataFrame, shingle: int) -> DataFrame:
    """members (doc_id, h, ...) with items, the shingle set of the text of that id and hash; a repeated row of docs repeats it."""
    rest = [c for c in members.columns if c not in ("doc_id", "h")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, len(b), 256):  # a few at a time, for memory
                part = b.slice(lo, 256)
                items = [shingle_set(t.as_py(), shingle).view(np.int64) for t in part.column(0)]
                yield pa.RecordBatch.from_arrays([*part.columns[1:], pa.array(items, pa.list_(pa.int64()))], [*rest, "items"])

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("h"), "text")
    found = texts.join(broadcast_if_small(members, 500_000), ["doc_id", "h"]).select("text", *rest)
    return found.mapInArrow(run, ", ".join([*(f"{c} {members.schema[c].dataType.simpleString()}" for c in rest), "items array<long>"]))


def _unpacked(t: pa.Table) -> list[np.ndarray]:
    column = t.column("items").combine_chunks()
    flat, at = column.flatten().to_numpy().view(np.uint64), np.concatenate([[0], np.cumsum(pc.list_value_length(column).to_numpy())])
    return [flat[at[k] : at[k + 1]] for k in range(len(column))]


def _block_forest(t: pa.Table, distance: int, percent: int) -> pa.Table:
    """Links that connect what the similar pairs of a block connect; rows of one node are one text."""
    node, fp, sets = t.column("node").to_numpy(), t.column("fp").to_numpy().view(np.uint64), _unpacked(t)
    label = np.unique(node, return_inverse=True)[1]
    us, vs = [], []
    for i in np.argsort(-t.column("pivot").to_numpy(), kind="stable"):
        for j in np.flatnonzero((np.bitwise_count(fp ^ fp[i]) <= distance) & (label != label[i])):
            if label[i] != label[j] and _similar(sets[i], sets[j], percent):
                us.append(node[i])
                vs.append(node[j])
                label[label == label[j]] = label[i]
    return pa.table({"u": pa.array(us, pa.int64()), "v": pa.array(vs, pa.int64())})


def _near(fp: np.ndarray, n: np.ndarray, label: np.ndarray, a: np.ndarray, b: np.ndarray, distance: int, percent: int) -> np.ndarray:
    """Which pairs of rows a and b have different labels, and fingerprints and sizes that allow a link."""
    near = (label[a][:, None] != label[b][None, :]) & (np.bitwise_count(fp[a][:, None] ^ fp[b][None, :]) <= distance)
    return near & (np.minimum(n[a][:, None], n[b][None, :]) * 100 >= percent * np.maximum(n[a][:, None], n[b][None, :]))


def _across(members: DataFrame, docs: DataFrame, shingle: int, distance: int, percent: int) -> DataFrame:
    """(u, v) links between members (grp, node, doc_id, h, fp, n, label) of one group and different labels.

    The group is dealt in blocks, of which every two meet: first without texts, which leaves the members that have some
    partner in the other block, then these with their sets. No pair is listed; a task gives a link a member at most.
    """
    sizes = members.groupBy("grp").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"), F.countDistinct("label").alias("labels")).where("labels > 1").drop("labels")
    placed = materialize(members.join(broadcast_if_small(sizes, 100_000), "grp").withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")), "dealt")
    spread = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select("grp", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "node", "fp", "n", "label")

    def sides(t: pa.Table) -> tuple[np.ndarray, ...]:
        i, j, own = t.column("i")[0].as_py(), t.column("j")[0].as_py(), t.column("own").to_numpy()
        node, fp, n, label = (t.column(c).to_numpy() for c in ("node", "fp", "n", "label"))
        return np.flatnonzero(own == i), np.flatnonzero(own == j), node, fp.view(np.uint64), n, label

    def some(t: pa.Table) -> pa.Table:
        a, b, _, fp, n, label = sides(t)
        near = _near(fp, n, label, a, b, distance, percent)
        return t.take(np.unique(np.concatenate([a[near.any(1)], b[near.any(0)]])))

    kept = materialize(spread.groupBy("grp", "i", "j").applyInArrow(some, spread.schema), "partners")
    wanted = kept.select("node").distinct().join(placed.select("node", "doc_id", "h"), "node")
    sets = materialize(_with_sets(docs, wanted, shingle), "partner_sets")

    def forest(t: pa.Table) -> pa.Table:
        a, b, node, fp, n, label = sides(t)
        sets, us, vs, mine = _unpacked(t), [], [], label.copy()
        for i in a:
            for j in b[_near(fp, n, label, np.array([i]), b, distance, percent)[0]]:
                if mine[i] != mine[j] and _similar(sets[i], sets[j], percent):
                    us.append(node[i])
                    vs.append(node[j])
                    mine[mine == mine[j]] = mine[i]
        return pa.table({"u": pa.array(us, pa.int64()), "v": pa.array(vs, pa.int64())})

    return kept.join(sets, "node").groupBy("grp", "i", "j").applyInArrow(forest, "u long, v long")


def candidate_links(nodes: DataFrame, classes: DataFrame, distance: int) -> DataFrame:
    """(u, v) links that connect all candidates among nodes (node, fp, bands): nodes of one fingerprint, of fingerprints within
    distance bits (classes: fp, rep), and of one band. Each node links to the least of its class and of each of its bands."""
    same = nodes.join(classes, "fp").where("node <> rep").select(F.col("node").alias("u"), F.col("rep").alias("v"))
    banded = nodes.select("node", F.explode("bands").alias("band"))
    shared = banded.groupBy("band").agg(F.min("node").alias("rep"), F.max("node").alias("top")).where("rep < top").select("band", "rep")
    held = banded.join(shared, "band").where("node <> rep").select(F.col("node").alias("u"), F.col("rep").alias("v"))
    return linking_forest(classes, distance).select("u", "v").unionByName(same).unionByName(held).distinct()


def near_copies(docs: DataFrame, distance: int, bits_shingle: int, shingle: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, h, first_id, first_h), one row per row of docs (doc_id, text): its group's least doc_id and xxhash64 of text.

    Two texts link if their sets of shingle words share percent hundredths of their union or more, which is computed from
    the whole sets; equal sets are one node from the start. Groups are what links connect. Rows with a null doc_id are left
    out. Candidates are texts whose fingerprints (of sets of bits_shingle words) differ in distance bits at most, by the
    pigeonhole search, and texts whose sets share a band of least hashes, which finds those that lie near the threshold and
    differ in more bits; links reach from candidate to candidate.

    Candidate groups are what candidates connect. A group is compared in blocks of BLOCK texts, all of which also see
    PIVOTS texts of the group; a group of one block is settled then. In larger ones the texts that are still apart meet
    block by block, as far as their fingerprints (FAR_BITS) and sizes allow: that work grows with the square of such a group, its memory and
    what it lists do not.
    """
    spark = docs.sparkSession
    with scratch_area(spark, "near_copies") as put:
        rows = materialize(_described(docs.where("doc_id is not null"), bits_shingle, shingle), "described")
        nodes = put(rows.groupBy("node").agg(F.min(F.struct("doc_id", "h")).alias("o"), F.first("n").alias("n"), F.collect_set("fp").alias("fps"), F.first("bands").alias("bands")).select("node", "o.doc_id", "o.h", "n", F.array_min("fps").alias("fp"), "bands"), "nodes")
        classes = put(nodes.groupBy("fp").agg(F.min("node").alias("rep")), "classes")
        labels = connected_components(put(candidate_links(nodes, classes, distance), "candidates"))
        slim = nodes.select("node", "doc_id", "h", "n", "fp")
        placed = put(slim.join(labels, "node", "left").withColumn("grp", F.coalesce("component", "node")).drop("component"), "placed")
        sizes = placed.groupBy("grp").agg(F.count(F.lit(1)).alias("m")).where("m > 1")
        members = put(placed.join(sizes, "grp").withColumn("blocks", F.ceil(F.col("m") / BLOCK).cast("int")), "members")
        many = members.where("blocks > 1")
        # pivots: the least by hash of each group; a threshold keeps about PIVOTS of them without ordering the group
        pivot = (F.col("blocks") > 1) & (F.pmod(F.xxhash64("node", F.lit(3)), F.greatest(F.lit(1), (F.col("m") / PIVOTS).cast("long"))) == 0)
        own = F.array(F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
        dealt = members.select("doc_id", "h", "grp", "node", "fp", pivot.cast("int").alias("pivot"), F.when(pivot, F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(own).alias("at"))
        blocks = _with_sets(docs, dealt, shingle).withColumn("block", F.explode("at")).drop("at")
        inside = put(blocks.groupBy("grp", "block").applyInArrow(lambda t: _block_forest(t, FAR_BITS, percent), "u long, v long"), "inside")
        found = connected_components(inside)
        if many.limit(1).count():
            apart = many.join(found, "node", "left").select("grp", "node", "doc_id", "h", "fp", "n", F.coalesce("component", "node").alias("label"))
            across = put(_across(put(apart, "apart"), docs, shingle, FAR_BITS, percent), "across")
            if across.limit(1).count():
                found = connected_components(inside.union(across))
        named = put(nodes.join(found, "node", "left").select("node", "doc_id", "h", F.coalesce("component", "node").alias("component")), "named")
        first = named.groupBy("component").agg(F.min(F.struct("doc_id", "h")).alias("first"))
        of = materialize(named.join(first, "component").select("node", F.col("first.doc_id").alias("first_id"), F.col("first.h").alias("first_h")), "first")
    return rows.join(of, "node").select("doc_id", "h", "first_id", "first_h")
