"""Embedding near-duplicates: a neighbour graph by NN-descent, cut at a cosine threshold."""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import broadcast_if_small, materialize
from .components import connected_components

EDGE = "id long, nbr long, sim double"
#: Vectors of one order that start as candidates of each other, and vectors that one task compares with as many others.
FIRST, BLOCK = 16, 512
#: Angles within this of the threshold's count as neither inside nor outside of it.
SLACK = 1e-6


def _matrix(column: pa.Array) -> np.ndarray:
    """Unit vectors in double precision, of rows of one length; scaled first, so that no square over- or underflows."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    x = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _runs(*columns: np.ndarray) -> list[tuple[int, int]]:
    """Where the rows' values change, as spans."""
    n = len(columns[0])
    new = np.zeros(max(0, n - 1), bool)
    for c in columns:
        new |= c[1:] != c[:-1]
    cut = [0, *(np.flatnonzero(new) + 1).tolist(), n]
    return [(a, z) for a, z in zip(cut, cut[1:], strict=False) if z > a]


def usable(embedding: F.Column) -> F.Column:
    """Not null, without null or non-finite components, and not all zero."""
    ok = F.forall(embedding, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(embedding.isNotNull() & ok & F.exists(embedding, lambda x: x != 0), F.lit(False))


def _edges(ids: np.ndarray, sims: np.ndarray, take: np.ndarray) -> pa.RecordBatch:
    a, b = np.nonzero(take & (ids[:, None] != ids[None, :]))  # a block may hold a vector of two orders
    return pa.RecordBatch.from_arrays([pa.array(ids[a]), pa.array(ids[b]), pa.array(sims[a, b])], ["id", "nbr", "sim"])


def _signed(df: DataFrame, tables: int, seed: int) -> DataFrame:
    """df (vec, dim, ...) once for each of several orders t, with the signs of its products with random planes as bits."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes: dict[int, np.ndarray] = {}
        for batch in batches:
            dims = batch.column("dim").to_numpy()
            for a, z in _runs(dims):
                b = batch.slice(a, z - a)
                dim = int(dims[a])
                if dim not in planes:
                    planes[dim] = np.random.default_rng([seed, dim]).standard_normal((tables, dim, 24))
                x = _matrix(b.column("vec"))
                for t in range(tables):
                    bits = ((x @ planes[dim][t]) > 0).astype(np.int64) @ (1 << np.arange(24, dtype=np.int64))
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), t, np.int32)), pa.array(bits), *b.columns], ["t", "bits", *batch.schema.names])

    schema = ", ".join(f"{n} {df.schema[n].dataType.simpleString()}" for n in df.columns)
    return df.mapInArrow(sign, f"t int, bits long, {schema}")


def _first_lists(nodes: DataFrame, k: int, tables: int, seed: int) -> DataFrame:
    """Starting edges: in each of several random orders, a vector's k best among the FIRST around it. Few, whatever the number of vectors."""

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for a, z in _runs(batch.column("dim").to_numpy(), batch.column("t").to_numpy()):
                for lo in range(a, z, FIRST):
                    part = batch.slice(lo, min(FIRST, z - lo))
                    x, ids = _matrix(part.column("vec")), part.column("rep").to_numpy()
                    sims = x @ x.T
                    np.fill_diagonal(sims, -2)
                    take = sims > -2
                    if len(ids) > k + 1:
                        take &= sims >= np.partition(sims, len(ids) - k, axis=1)[:, len(ids) - k, None]
                    out.append(_edges(ids, sims, take))
            if out:
                yield from pa.Table.from_batches(out).combine_chunks().to_batches()

    order = ["t", "dim", "bits", "rep"]
    return _signed(nodes.select("rep", "vec", "dim"), tables, seed).repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(near, EDGE)


def _best(edges: DataFrame, k: int, most: int, threshold: float) -> DataFrame:
    """Each id's k best edges, and past those the edges that reach the threshold, most in all: a list that links fill grows."""
    rank = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("sim"), "nbr"))
    return edges.withColumn("rank", rank).where((F.col("rank") <= k) | ((F.col("sim") >= threshold) & (F.col("rank") <= most))).drop("rank")


def _local_join(graph: DataFrame, nodes: DataFrame, k: int, most: int, threshold: float) -> DataFrame:
    """Edges between neighbours of a common node that would enter a list: forward neighbours, and 2 k backward ones."""
    floors = graph.groupBy("id").agg(F.count(F.lit(1)).alias("listed"), F.min("sim").alias("low"), F.min(F.when(F.col("place") <= k, F.col("sim"))).alias("kth"))
    floor = F.when(F.col("listed") >= most, F.col("low")).when(F.col("listed") >= k, F.least("kth", F.lit(threshold))).otherwise(-2.0)
    member = nodes.join(floors, nodes.rep == floors.id, "left").select("rep", "vec", F.coalesce(floor, F.lit(-2.0)).alias("floor"))
    back = graph.select(F.col("nbr").alias("v"), F.col("id").alias("m"), "fresh").withColumn("r", F.row_number().over(Window.partitionBy("v").orderBy(F.desc("fresh"), F.xxhash64("m")))).where(F.col("r") <= 2 * k).drop("r")
    self_ = graph.select(F.col("id").alias("v"), F.col("id").alias("m"), F.lit(False).alias("fresh")).distinct()
    pairs = graph.select(F.col("id").alias("v"), F.col("nbr").alias("m"), "fresh").unionByName(back).unionByName(self_)
    pairs = pairs.groupBy("v", "m").agg(F.max("fresh").alias("fresh"))
    around = pairs.join(member, pairs.m == member.rep).groupBy("v").agg(F.collect_list(F.struct("m", "fresh", "floor", "vec")).alias("b"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[pa.RecordBatch] = []
            for row in batch.column(0):
                s = row.values
                fresh = s.field("fresh").to_numpy(zero_copy_only=False)
                if len(s) < 2 or not fresh.any():
                    continue
                ids, low, x = s.field("m").to_numpy(), s.field("floor").to_numpy(), _matrix(s.field("vec"))
                sims = x @ x.T
                take = (sims > low[:, None]) & (fresh[:, None] | fresh[None, :])
                np.fill_diagonal(take, False)
                out.append(_edges(ids, sims, take))
            if out:
                yield from pa.Table.from_batches(out).combine_chunks().to_batches()

    return around.select("b").mapInArrow(run, EDGE)


def neighbour_graph(nodes: DataFrame, threshold: float, k: int = 10, most: int = 40, tables: int = 4, rounds: int = 5, seed: int = 7, on_round: Callable[[int, DataFrame], None] | None = None) -> DataFrame:
    """(id, nbr, sim): each node's best neighbours, by NN-descent until hardly any list changes.

    A list that links fill grows from k to twice its length each round, up to most. on_round is given the graph of each
    round, from 0 for the starting lists.
    """
    place = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("sim"), "nbr")).alias("place")
    start = _first_lists(nodes, k, tables, seed).groupBy("id", "nbr").agg(F.max("sim").alias("sim"), F.lit(True).alias("fresh"))
    graph = materialize(_best(start, k, min(2 * k, most), threshold).select("*", place), "graph")
    if on_round:
        on_round(0, graph)
    total = graph.count()
    for r in range(rounds):
        length = min((2 * k) << (r + 1), most)
        more = _local_join(graph, nodes, k, length, threshold).withColumn("fresh", F.lit(True))
        both = graph.select("id", "nbr", "sim", F.lit(False).alias("fresh")).unionByName(more).groupBy("id", "nbr").agg(F.max("sim").alias("sim"), F.min("fresh").alias("fresh"))
        graph = materialize(_best(both, k, length, threshold).select("*", place), "graph")
        if on_round:
            on_round(r + 1, graph)
        if length == most and graph.where("fresh").count() <= 0.01 * max(total, 1):
            break
    return graph.select("id", "nbr", "sim")


def _blocks(members: DataFrame) -> DataFrame:
    """members (component, rep, vec, n, dim) with their block: up to BLOCK of one component that lie near each other in a random order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            name = np.empty(len(b), object)
            for a, z in _runs(b.column("component").to_numpy()):
                for lo in range(a, z, BLOCK):
                    name[lo : min(lo + BLOCK, z)] = uuid.uuid4().hex
            yield pa.RecordBatch.from_arrays([pa.array(name, pa.string()), *b.select(["component", "rep", "vec", "n"]).columns], ["block", "component", "rep", "vec", "n"])

    order = ["component", "bits", "rep"]
    signed = _signed(members.select("component", "rep", "vec", "n", "dim"), 1, 3).repartitionByRange(*order).sortWithinPartitions(*order)
    return signed.mapInArrow(run, f"block string, component long, rep long, vec {members.schema['vec'].dataType.simpleString()}, n long")


def _described(placed: DataFrame) -> DataFrame:
    """(block, component, centre, reach, total): the mean direction of each block, the widest angle to it, and its rows."""

    def run(t: pa.Table) -> pa.Table:
        x = _matrix(t.column("vec"))
        c = x.sum(0)
        c = c / (np.sqrt(c @ c) or 1.0)
        reach = float(np.arccos(np.clip((x @ c).min(), -1, 1)))
        return pa.table({"block": t.column("block")[:1], "component": t.column("component")[:1], "centre": pa.array([c], pa.list_(pa.float64())), "reach": pa.array([reach]), "total": pa.array([int(t.column("n").to_numpy().sum())])})

    return placed.groupBy("block").applyInArrow(run, "block string, component long, centre array<double>, reach double, total long")


def _block_pairs(blocks: DataFrame, threshold: float) -> DataFrame:
    """Pairs of blocks (i, j) by the angles of their centres: inside, where every two vectors link, or else those that may link."""
    i = blocks.select(*[F.col(c).alias(f"{c}_i") for c in blocks.columns])
    j = blocks.select(*[F.col(c).alias(f"{c}_j") for c in blocks.columns])
    dot = F.aggregate(F.zip_with("centre_i", "centre_j", lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)
    near = (F.size("centre_i") == F.size("centre_j")) & (F.col("angle") - F.col("reach_i") - F.col("reach_j") <= math.acos(threshold) + SLACK)
    pairs = i.join(j, F.col("block_i") <= F.col("block_j")).withColumn("angle", F.acos(F.greatest(F.least(dot, F.lit(1.0)), F.lit(-1.0)))).where(near)
    inside = F.col("angle") + F.col("reach_i") + F.col("reach_j") <= math.acos(threshold) - SLACK
    return pairs.select(F.col("block_i").alias("i"), F.col("block_j").alias("j"), F.col("component_i").alias("u"), F.col("component_j").alias("v"), F.col("total_i").alias("n_i"), F.col("total_j").alias("n_j"), inside.alias("inside"))


def _block_links(members: DataFrame, threshold: float) -> tuple[DataFrame, DataFrame]:
    """Of members (component, rep, vec, n, dim): (rep, links), exact numbers of linked vectors among all members, and (u, v),
    components that a link joins.

    Members are taken in blocks. Two blocks whose angles put all pairs inside the threshold are counted without comparing
    a vector, those too far apart are passed over, and only the others are compared, a pair of blocks in a task.
    """
    placed = materialize(_blocks(members), "placed")
    pairs = materialize(_block_pairs(materialize(_described(placed), "blocks"), threshold), "pairs")
    within = pairs.where("inside")
    ends = within.select(F.col("i").alias("block"), F.col("n_j").alias("links")).unionByName(within.where("i <> j").select(F.col("j").alias("block"), F.col("n_i").alias("links")))
    whole = placed.join(ends.groupBy("block").agg(F.sum("links").alias("links")), "block").join(within.where("i = j").select(F.col("i").alias("block"), F.lit(True).alias("self")), "block", "left")
    whole = whole.select("rep", (F.col("links") - F.when(F.col("self"), F.col("n")).otherwise(0)).alias("links"))
    ends = pairs.where("not inside").select("i", "j", F.explode(F.array_distinct(F.array("i", "j"))).alias("block"))
    spread = placed.join(ends, "block").select("i", "j", F.col("block").alias("own"), "component", "rep", "vec", "n")

    def run(t: pa.Table) -> pa.Table:
        i, j = t.column("i")[0].as_py(), t.column("j")[0].as_py()
        own, ids, n, component = t.column("own").to_numpy(), t.column("rep").to_numpy(), t.column("n").to_numpy(), t.column("component").to_numpy()
        x = _matrix(t.column("vec"))
        a, b = np.flatnonzero(own == i), np.flatnonzero(own == j)
        links = np.zeros(len(ids), np.int64)
        linked = (x[a] @ x[b].T >= threshold) & (ids[a][:, None] != ids[b][None, :])
        links[a] += linked @ n[b]
        if i != j:
            links[b] += n[a] @ linked
        joined = component[b[0]] if links.any() else component[a[0]]
        return pa.table({"rep": ids, "links": links, "u": np.full(len(ids), component[a[0]]), "v": np.full(len(ids), joined)})

    found = materialize(spread.groupBy("i", "j").applyInArrow(run, "rep long, links long, u long, v long"), "block_links")
    joined = found.select("u", "v").unionByName(within.select("u", "v")).where("u <> v").distinct()
    return whole.unionByName(found.select("rep", "links")).groupBy("rep").agg(F.sum("links").alias("links")), joined


def audit(nodes: DataFrame, links: DataFrame, threshold: float, queries: int = 300) -> float:
    """The share of the links of a bounded, hashed sample of nodes that links (rep, links) has, or its mean over the nodes
    that have links if that is less; exact ones by comparing with all rows."""
    asked = nodes.orderBy(F.xxhash64("rep", F.lit(5)), "rep").limit(queries).select("rep", "vec", "dim").orderBy("dim").toArrow()
    if not asked.num_rows:
        return 1.0
    dims, qid = asked.column("dim").to_numpy(), asked.column("rep").to_numpy()
    by_dim = {int(dims[a]): (qid[a:z], _matrix(asked.column("vec").slice(a, z - a))) for a, z in _runs(dims)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = {d: np.zeros(len(ids), np.int64) for d, (ids, _) in by_dim.items()}
        for b in batches:
            dims, ids, n = (b.column(c).to_numpy() for c in ("dim", "rep", "n"))
            for a, z in _runs(dims):
                if int(dims[a]) in by_dim:
                    qid, q = by_dim[int(dims[a])]
                    x = _matrix(b.column("vec").slice(a, z - a))
                    total[int(dims[a])] += ((q @ x.T >= threshold) & (qid[:, None] != ids[a:z][None, :])) @ n[a:z]
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([ids for ids, _ in by_dim.values()])), pa.array(np.concatenate(list(total.values())))], ["rep", "exact"])

    exact = nodes.select("rep", "vec", "dim", "n").mapInArrow(run, "rep long, exact long").groupBy("rep").agg(F.sum("exact").alias("exact"))
    have = F.least(F.coalesce("links", F.lit(0)), "exact")
    found, want, mean = exact.join(links, "rep", "left").agg(F.sum(have), F.sum("exact"), F.avg(F.when(F.col("exact") > 0, have / F.col("exact")))).first()
    return 1.0 if not want else min(found / want, mean)


def near_duplicates(vectors: DataFrame, threshold: float = 0.9, k: int = 10, most: int = 40, recall: float = 0.9, tries: int = 3, on_round: Callable[[int, DataFrame], None] | None = None) -> DataFrame:
    """(vec_id, n_links, component_id, kept), one row per row of vectors (vec_id, embedding).

    n_links: other vectors of cosine >= threshold found; component_id: the smallest vec_id reachable by them; kept:
    vec_id = component_id. Equal vectors are one node from the start. Vectors that are null, zero or hold null or
    non-finite components link with nothing (component: themselves), nor does a null vec_id (component null, kept false);
    vectors of different lengths don't link with each other. Rows that repeat a vec_id and vector are copies. Other
    columns are left out.

    A node whose list is full of links at its largest size (most) is saturated: the links inside its component and with
    the components of other saturated nodes are then counted exactly by blocks, and join those components. Recall is
    audited on a hashed sample, for all links and as the mean over the nodes that have some; below the wished value the
    graph is built again from more and other orders, and lists twice as long, and after so many tries that is an error.
    """
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
    good = rows.where(usable(F.col("embedding")) & F.col("vec_id").isNotNull())
    nodes = materialize(good.groupBy(F.col("embedding").alias("vec")).agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("n")).withColumn("dim", F.size("vec")), "nodes")
    for attempt in range(tries):
        longest = most << attempt
        graph = neighbour_graph(nodes, threshold, k << attempt, longest, tables=4 + 4 * attempt, seed=7 + attempt, on_round=on_round)
        links = materialize(graph.where(F.col("sim") >= threshold), "links")
        components = connected_components(links.select(F.col("id").alias("u"), F.col("nbr").alias("v")))
        full = links.groupBy("id").count().where(F.col("count") >= longest).select(F.col("id").alias("node"))
        dense = materialize(components.join(full, "node").select("component").distinct(), "dense")
        exact = None
        if dense.limit(1).count():
            members = components.join(broadcast_if_small(dense, 100_000), "component", "left_semi").join(nodes, F.col("node") == F.col("rep")).select("component", "rep", "vec", "n", "dim")
            exact, joined = _block_links(members, threshold)
            exact = materialize(exact, "exact")
            if joined.limit(1).count():
                merged = connected_components(joined).select(F.col("node").alias("component"), F.col("component").alias("merged"))
                components = materialize(components.join(merged, "component", "left").select("node", F.coalesce("merged", "component").alias("component")), "components")
        both = links.select("id", "nbr").union(links.select("nbr", "id")).distinct()
        counted = both.join(nodes.select(F.col("rep").alias("nbr"), "n"), "nbr").groupBy(F.col("id").alias("rep")).agg(F.sum("n").alias("links"))
        if exact is not None:
            counted = counted.join(exact.select("rep"), "rep", "left_anti").unionByName(exact)
        counted = materialize(counted, "counted")
        reached = audit(nodes, counted, threshold)
        if reached >= recall:
            break
    else:
        raise RuntimeError(f"{reached:.3f} of the links found in {tries} tries, {recall} wished")
    node = nodes.join(counted, "rep", "left").join(components, F.col("rep") == F.col("node"), "left")
    node = materialize(node.select(F.col("vec").alias("_vec"), (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("_links"), F.coalesce("component", "rep").alias("_component")), "classes")
    named = rows.join(node, (rows.embedding == node._vec) & rows.vec_id.isNotNull(), "left")
    return named.select("vec_id", F.coalesce("_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("_component", "vec_id").alias("component_id"), F.coalesce(F.col("vec_id") == F.coalesce("_component", "vec_id"), F.lit(False)).alias("kept"))
