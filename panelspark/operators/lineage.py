"""Lineage over a run table: runs (run_id, upstream_ids, state, created_at, ...)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.storage import stored


def edges(runs: DataFrame) -> DataFrame:
    """(run_id, upstream_id), once each, without self loops; a null list is empty."""
    e = runs.select("run_id", F.explode(F.array_distinct("upstream_ids")).alias("upstream_id"))
    return e.where("upstream_id is not null and run_id <> upstream_id")


def nodes(runs: DataFrame) -> DataFrame:
    """(run_id, state, missing, provisional): the runs, and the upstream ids that no run has; provisional: not succeeded."""
    have = runs.select("run_id", "state", F.lit(False).alias("missing"))
    lost = edges(runs).select(F.col("upstream_id").alias("run_id")).distinct().join(runs.select("run_id"), "run_id", "left_anti")
    return have.unionByName(lost.select("run_id", F.lit("missing").alias("state"), F.lit(True).alias("missing"))).withColumn("provisional", F.col("state") != "succeeded")


def all_upstream(e: DataFrame, depth: int = 64) -> DataFrame:
    """(run_id, ancestor) pairs, cycle-safe. A run in a cycle reaches itself.

    Each round joins the pairs found so far with those exactly 2^k edges apart, which are few where the graph is narrow, so
    rounds grow with the logarithm of the depth and a chain's work with the number of its pairs.
    """
    reach = stored(e.select("run_id", F.col("upstream_id").alias("ancestor")).distinct(), "reach")
    power, before = reach, reach.count()

    def after(near: DataFrame, far: DataFrame) -> DataFrame:
        return near.join(far.select(F.col("run_id").alias("ancestor"), F.col("ancestor").alias("further")), "ancestor").select("run_id", F.col("further").alias("ancestor"))

    for _ in range(depth):
        reach = stored(reach.union(after(power, reach)).distinct(), "reach")
        if (now := reach.count()) == before:
            return reach
        power, before = stored(after(power, power).distinct(), "power"), now
    raise RuntimeError("the graph is deeper than 2 ** depth")


def direct_downstream(e: DataFrame) -> DataFrame:
    """(run_id, downstream): the runs that name it."""
    return e.groupBy(F.col("upstream_id").alias("run_id")).agg(F.sort_array(F.collect_set("run_id")).alias("downstream"))


def components(e: DataFrame, ids: DataFrame, rounds: int = 64) -> DataFrame:
    """(run_id, component): the least id that edges in either direction lead to; a run without edges is its own.

    A round hooks every run to its least neighbour, if that is less, and shortens the trees so made by pointer jumping until
    all hang from their roots; then roots take their runs' place and edges within a tree go. What is no root's least has a
    lesser neighbour in the next round, so two rounds at least halve the runs left, whatever the order of ids along a path.
    """
    links = stored(e.select(F.col("run_id").alias("u"), F.col("upstream_id").alias("v")).union(e.select("upstream_id", "run_id")).distinct(), "links")
    forests: list[DataFrame] = []
    while links.limit(1).count():
        if len(forests) == rounds:
            raise RuntimeError("components did not settle")
        tree = stored(links.groupBy(F.col("u").alias("run_id")).agg(F.least("run_id", F.min("v")).alias("root")), "tree")
        flat = False
        while not flat:
            up = tree.select(F.col("run_id").alias("root"), F.col("root").alias("next"))
            jumped = stored(tree.join(up, "root").select("run_id", F.col("next").alias("root"), (F.col("next") != F.col("root")).alias("moved")), "tree")
            flat = not jumped.where("moved").limit(1).count()
            tree = jumped.drop("moved")
        forests.append(tree)
        a, b = (tree.select(F.col("run_id").alias(end), F.col("root").alias(f"{end}_root")) for end in "uv")
        links = stored(links.join(a, "u").join(b, "v").where("u_root <> v_root").select(F.col("u_root").alias("u"), F.col("v_root").alias("v")).distinct(), "links")
    labels = ids.select("run_id").union(e.select("upstream_id")).union(e.select("run_id")).distinct().withColumn("component", F.col("run_id"))
    for tree in forests:
        labels = labels.join(tree.withColumnsRenamed({"run_id": "component", "root": "lower"}), "component", "left").select("run_id", F.coalesce("lower", "component").alias("component"))
    return stored(labels, "components")


def component_roots(labels: DataFrame, runs: DataFrame, e: DataFrame) -> DataFrame:
    """(component, root): its earliest run that names no other as upstream (ties: the least id); null in a component of cycles alone."""
    first = runs.join(e.select("run_id").distinct(), "run_id", "left_anti").select("run_id", "created_at")
    found = labels.join(first, "run_id").groupBy("component").agg(F.min_by("run_id", F.struct("created_at", "run_id")).alias("root"))
    return labels.select("component").distinct().join(found, "component", "left")


def relations(runs: DataFrame) -> DataFrame:
    """(run_id, direct_upstream, all_upstream, downstream, missing_upstream, provisional_upstream) counts of every run."""
    e = edges(runs)
    n = nodes(runs).select(F.col("run_id").alias("ancestor"), "missing", "provisional")
    up = all_upstream(e).where("run_id <> ancestor").join(n, "ancestor").groupBy("run_id").agg(F.count(F.lit(1)).alias("all_upstream"), F.count_if("missing").alias("missing_upstream"), F.count_if("provisional").alias("provisional_upstream"))
    direct = e.groupBy("run_id").agg(F.count(F.lit(1)).alias("direct_upstream"))
    down = e.groupBy(F.col("upstream_id").alias("run_id")).agg(F.count(F.lit(1)).alias("downstream"))
    j = runs.select("run_id").join(direct, "run_id", "left").join(up, "run_id", "left").join(down, "run_id", "left")
    return j.na.fill(0)


def latest_children(invocations: DataFrame) -> DataFrame:
    """The last record of each child of a run, with the number of attempts."""
    w = Window.partitionBy("run_id", "child_id")
    n = invocations.withColumns({"_n": F.row_number().over(w.orderBy(F.desc("started_at"), F.desc("attempt"))), "attempts": F.count(F.lit(1)).over(w)})
    return n.where("_n = 1").drop("_n")


def changed_inputs(recorded: DataFrame, current: DataFrame) -> DataFrame:
    """Recorded inputs (source_id, started_at, revision) whose run or revision is another now, or gone."""
    c = current.select("source_id", F.col("started_at").alias("now_started"), F.col("revision").alias("now_revision"))
    j = recorded.join(c, "source_id", "left")
    return j.where(~(F.col("started_at").eqNullSafe(F.col("now_started")) & F.col("revision").eqNullSafe(F.col("now_revision"))))


def filter_runs(runs: DataFrame, task_type: str | None = None, state: str | None = None, search: str | None = None) -> DataFrame:
    """By type, state, and text in id or type, upper or lower case."""
    if task_type:
        runs = runs.where(F.col("task_type") == task_type)
    if state:
        runs = runs.where(F.col("state") == state)
    if search:
        runs = runs.where(F.lower(F.col("run_id").cast("string")).contains(search.lower()) | F.lower("task_type").contains(search.lower()))
    return runs


def newest_first(runs: DataFrame) -> DataFrame:
    return runs.orderBy(F.desc_nulls_last("created_at"), F.desc("run_id"))


def group_counts(runs: DataFrame) -> DataFrame:
    """(task_type, total, running, succeeded, failed, active, newest): active types first, then the newest."""
    n = lambda s: F.count_if(F.col("state") == s).alias(s)
    g = runs.groupBy("task_type").agg(F.count(F.lit(1)).alias("total"), n("running"), n("succeeded"), n("failed"), F.max("created_at").alias("newest"))
    return g.withColumn("active", F.col("running") > 0).orderBy(F.desc("active"), F.desc("newest"), "task_type")


def progress(runs: DataFrame) -> DataFrame:
    """Adds seconds run, the first unfinished of the steps array<name, state, percentage> and its percentage."""
    open_ = F.filter("steps", lambda s: s["state"] != "succeeded")
    step = F.try_element_at(open_, F.lit(1))
    return runs.withColumns({"seconds": F.unix_timestamp("ended_at") - F.unix_timestamp("started_at"), "current_step": step["name"], "percentage": step["percentage"]})


def summary_text(error: Column, name: Column) -> tuple[Column, Column]:
    """An error's first 1000 characters, a name's first 256."""
    return F.left(error, F.lit(1000)), F.left(name, F.lit(256))
