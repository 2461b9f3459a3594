"""Connected components by hooking roots and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, scratch_area


def connected_components(edges: DataFrame, max_rounds: int = 64) -> DataFrame:
    """(u, v) links to (node, component): the smallest node that can be reached. Nodes without links have no row.

    Every round hooks each root to its least neighbour, if that is smaller, flattens the trees by taking the parent's
    parent until all are flat, and shrinks the links to those between different roots. A root that nothing joined has a
    smaller neighbour in the next round, so two rounds at least halve the roots of a component, whatever the order of
    its nodes; a flattening takes the logarithm of a tree's depth. The rounds' tables shrink alike, and are composed
    from the last to the first. Joins are between written tables, so adaptive execution can split a hot node.
    Null ends are left out; repeated links, self links and either direction do no harm.
    """
    spark = edges.sparkSession
    with scratch_area(spark, "components") as put:
        edges = edges.select("u", "v").where("u is not null and v is not null and u <> v")
        links = put(edges.union(edges.select("v", "u")).distinct(), "links")
        rounds: list[DataFrame] = []
        while links.limit(1).count():
            if len(rounds) == max_rounds:
                raise RuntimeError(f"components did not settle in {max_rounds} rounds")
            tree = put(links.groupBy(F.col("u").alias("node")).agg(F.least(F.min("v"), F.first("u")).alias("root"), F.lit(True).alias("moved")), "tree")
            while tree.where("moved").limit(1).count():
                up = tree.select(F.col("node").alias("root"), F.col("root").alias("above"))
                tree = put(tree.join(up, "root").select("node", F.col("above").alias("root"), (F.col("above") != F.col("root")).alias("moved")), "tree")
            rounds.append(tree.select("node", "root"))
            of = lambda end: rounds[-1].select(F.col("node").alias(end), F.col("root").alias(f"{end}_"))  # noqa: E731, B023
            links = put(links.join(of("u"), "u").join(of("v"), "v").where("u_ <> v_").select(F.col("u_").alias("u"), F.col("v_").alias("v")).distinct(), "links")
        if not rounds:
            return materialize(links.select(F.col("u").alias("node"), F.col("v").alias("component")), "components")
        whole = rounds[-1]
        for earlier in reversed(rounds[:-1]):
            later = whole.select(F.col("node").alias("root"), F.col("root").alias("final"))
            whole = put(earlier.join(later, "root", "left").select("node", F.coalesce("final", "root").alias("root")), "whole")
        return materialize(whole.select("node", F.col("root").alias("component")), "components")
