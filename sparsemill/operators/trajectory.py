"""Trajectory graphs: slabs, forward candidates, pruned edges, principal tree, supernodes, branches."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .neighbors import future_top_k
from .sparse import ranked_within


@dataclass(frozen=True)
class Config:
    slab_rows: int = 64
    k: int = 4
    low: float = 0.01
    high: float = 0.12
    min_similarity: float = 0.0
    degree: int = 4
    gap_ratio: float = 1.75
    score_margin: float = 0.05
    chain_dt: float = 0.08
    parent_score: float = 0.0
    branch_mass: int = 1
    branch_ratio: float = 0.2


def ordered(records: DataFrame) -> DataFrame:
    """records with their place ``pos`` inside their embryo, by (time, cell); places come from range partitions."""
    return ranked_within(records, "embryo", [F.col("time")], "pos", "cell")


def slabs(records: DataFrame, rows: int) -> DataFrame:
    """(embryo, slab, n, begin, end): runs of ``rows`` records of one embryo and their time range."""
    return ordered(records).groupBy("embryo", F.floor(F.col("pos") / rows).alias("slab")).agg(F.count("*").alias("n"), F.min("time").alias("begin"), F.max("time").alias("end"))


def spans(records: DataFrame) -> DataFrame:
    return records.groupBy("embryo").agg(F.count("*").alias("n"), F.min("time").alias("begin"), F.max("time").alias("end"))


def assign_slabs(delta: DataFrame, slab_table: DataFrame, halo: float) -> DataFrame:
    """delta records with the first slab of their embryo whose time range, widened by ``halo``, holds them; null if none.

    Both sides meet in time buckets as wide as the mean slab with its halos, so a record meets the few slabs near it and not
    all of its embryo; a slab is in as many buckets as it touches, three on average at most.
    """
    s = slab_table.select("embryo", F.col("slab").alias("_s"), (F.col("begin") - halo).alias("_b"), (F.col("end") + halo).alias("_e"))
    width = max(s.agg(F.avg(F.col("_e") - F.col("_b"))).first()[0] or 0.0, 1e-9)
    at = lambda c: F.floor(F.col(c) / width).cast("long")
    s = s.withColumn("_t", F.explode(F.sequence(at("_b"), at("_e"))))
    held = delta.withColumn("_t", at("time")).join(s, ["embryo", "_t"]).where((F.col("time") >= F.col("_b")) & (F.col("time") <= F.col("_e"))).groupBy("cell").agg(F.min("_s").alias("slab"))
    return delta.join(held, "cell", "left")


def insert_plan(assigned: DataFrame) -> DataFrame:
    """(embryo, slab, n, cells): new records by slab; slab null: those that found none. Cells are listed up to a slab's size of new rows."""
    return assigned.groupBy("embryo", "slab").agg(F.count("*").alias("n"), F.array_sort(F.collect_list("cell")).alias("cells"))


def candidates(records: DataFrame, c: Config) -> DataFrame:
    """(src, dst, score, dt): for each record the k best of its future window; inner products of the vectors as they are.

    Windows are scanned in blocks from which k rows a record come out; ties of the score go to the earlier, then the lower cell.
    """
    top = future_top_k(records, records, c.k, c.low, c.high, same_embryo=True, embryo_breaks_ties=False)
    times = records.select(F.col("cell").alias("q_cell"), F.col("time").alias("_t"))
    top = top.where(F.col("sim") >= c.min_similarity).join(times, "q_cell")
    return top.select(F.col("q_cell").alias("src"), F.col("i_cell").alias("dst"), F.col("sim").alias("score"), F.round(F.col("i_time") - F.col("_t"), 6).alias("dt"))


def prune(edges: DataFrame, c: Config) -> DataFrame:
    """Edges of each source in order (score desc, dt, dst) that no kept edge dominates, ``degree`` at most.

    A kept edge dominates one that is gap_ratio times as far in time and score_margin worse. A source has k candidates, so
    the fold over its array is short.
    """
    e = edges.groupBy("src").agg(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("s"), "dt", "dst"))).alias("e"))
    fold = f"""aggregate(e, cast(array() as array<struct<s: double, dt: double, dst: bigint>>), (kept, x) ->
      if(size(kept) >= {c.degree} or exists(kept, y -> x.dt > y.dt * {c.gap_ratio}D and -x.s + {c.score_margin}D < -y.s), kept, concat(kept, array(x))))"""
    return e.select("src", F.explode(F.expr(fold)).alias("x")).select("src", F.col("x.dst").alias("dst"), (-F.col("x.s")).alias("score"), F.col("x.dt").alias("dt"))


def inbound(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("dst").alias("node"), F.col("src"), "score", "dt")


def principal_tree(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, parent, score, dt): the best inbound edge of each node, the lowest source on ties; roots have null parents."""
    w = Window.partitionBy("dst").orderBy(F.desc("score"), "src")
    best = edges.withColumn("_r", F.row_number().over(w)).where("_r = 1").select(F.col("dst").alias("node"), F.col("src").alias("parent"), "score", "dt")
    return nodes.select(F.col("cell").alias("node")).join(best, "node", "left")


def heads_by_jumping(links: DataFrame, node: str, up: str, cut, most_rounds: int = 40) -> DataFrame:
    """(node, head, steps): the end of the chain of ``up`` links from each node, by pointer jumping.

    Distances double each round, so a chain of length n takes log2 n rounds; ``cut`` checkpoints between rounds. Links go
    back in time, so there is no cycle.
    """
    state = cut(links.select(F.col(node).alias("node"), F.coalesce(up, node).alias("head"), F.when(F.col(up).isNotNull(), 1).otherwise(0).alias("steps")))
    for _ in range(most_rounds):
        far = state.select(F.col("node").alias("head"), F.col("head").alias("_h"), F.col("steps").alias("_s"))
        after = cut(state.join(far, "head").select("node", F.col("_h").alias("head"), (F.col("steps") + F.col("_s")).alias("steps"), (F.col("_h") != F.col("head")).alias("_moved")))
        moved = not after.where("_moved").isEmpty()
        state = after.drop("_moved")
        if not moved:
            return state
    raise ValueError(f"chains are longer than 2^{most_rounds} links, or there is a cycle")


def depths(tree: DataFrame, cut) -> DataFrame:
    """(node, root, depth)."""
    return heads_by_jumping(tree, "node", "parent", cut).select("node", F.col("head").alias("root"), F.col("steps").alias("depth"))


def supernodes(tree: DataFrame, records: DataFrame, c: Config, cut) -> DataFrame:
    """(node, supernode): chains in which every node is the only child of its parent, with score and dt within bounds.

    A supernode is named by the first node of its chain.
    """
    children = tree.where("parent is not null").groupBy("parent").agg(F.count("*").alias("_n"))
    t = tree.join(children, "parent", "left")
    joined = (F.col("_n") == 1) & (F.col("score") >= c.parent_score) & (F.col("dt") <= c.chain_dt)
    links = t.select("node", F.when(joined, F.col("parent")).alias("up"))
    return heads_by_jumping(links, "node", "up", cut).select("node", F.col("head").alias("supernode"))


def supernode_table(members: DataFrame, records: DataFrame) -> DataFrame:
    """(supernode, mass, begin, end, centroid): members, time span and mean vector."""
    m = members.join(records.select(F.col("cell").alias("node"), "time", "latent"), "node")
    size = m.groupBy("supernode").agg(F.count("*").alias("mass"), F.min("time").alias("begin"), F.max("time").alias("end"))
    mean = m.select("supernode", F.posexplode("latent").alias("d", "v")).groupBy("supernode", "d").agg(F.round(F.avg(F.col("v").cast("double")), 6).alias("v"))
    mean = mean.groupBy("supernode").agg(F.transform(F.array_sort(F.collect_list(F.struct("d", "v"))), lambda s: s["v"]).alias("centroid"))
    return size.join(mean, "supernode")


def supernode_edges(members: DataFrame, edges: DataFrame) -> DataFrame:
    """(src, dst, mass, score): edges between different supernodes, counted, with the best score."""
    a, b = members.select(F.col("node").alias("src"), F.col("supernode").alias("a")), members.select(F.col("node").alias("dst"), F.col("supernode").alias("b"))
    e = edges.join(a, "src").join(b, "dst").where("a <> b")
    return e.groupBy("a", "b").agg(F.count("*").alias("mass"), F.max("score").alias("score")).select(F.col("a").alias("src"), F.col("b").alias("dst"), "mass", "score")


def branches(dag: DataFrame, c: Config) -> DataFrame:
    """(supernode, first, second): two out-edges at least, the second with the least mass and its share of both."""
    w = Window.partitionBy("src").orderBy(F.desc("mass"), "dst")
    two = dag.withColumn("_r", F.row_number().over(w)).where("_r <= 2").groupBy(F.col("src").alias("supernode"))
    m = two.agg(F.max(F.when(F.col("_r") == 1, F.col("mass"))).alias("first"), F.max(F.when(F.col("_r") == 2, F.col("mass"))).alias("second"))
    return m.where((F.col("second") >= c.branch_mass) & (F.col("second") >= c.branch_ratio * (F.col("first") + F.col("second"))))


def paths(tree: DataFrame, wanted: DataFrame, cut, most_rounds: int = 40) -> DataFrame:
    """(start, node, step): the ancestors of the wanted nodes, from the node itself up to its root.

    By doubling: what is known up to 2^r steps is taken 2^r steps further up at once, so a depth d takes log2 d rounds.
    """
    out = cut(wanted.select(F.col("node").alias("start"), F.col("node"), F.lit(0).alias("step")))
    jump = cut(tree.where("parent is not null").select("node", F.col("parent").alias("_to")))
    for r in range(most_rounds):
        if jump.isEmpty():
            return out
        out = cut(out.unionAll(out.join(jump, "node").select("start", F.col("_to").alias("node"), (F.col("step") + (1 << r)).alias("step"))))
        jump = cut(jump.join(jump.select(F.col("node").alias("_to"), F.col("_to").alias("_far")), "_to").select("node", F.col("_far").alias("_to")))
    raise ValueError(f"paths are longer than 2^{most_rounds} steps, or there is a cycle")


def subtree(tree: DataFrame, root: int, cut) -> DataFrame:
    """(node, depth) of all descendants of a node, itself included: the nodes whose chain ends there once its own link is cut."""
    links = tree.select("node", F.when(F.col("node") != root, F.col("parent")).alias("parent"))
    return depths(links, cut).where(F.col("root") == root).select("node", "depth")
