"""Neighbour search and trajectory graphs (29-45, 85-87, 106-116)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.lineage import cut
from ..operators import neighbors, trajectory
from ..sources.tables import EXPRESSION, RECORDS, expression, records
from .catalog import query

C = trajectory.Config()
LOW, HIGH, K = 0.01, 0.12, 4
R = f"with recursive {RECORDS}"
UNIT = """u as (select cell, embryo, "time", shard, list_transform(latent, lambda v: v::double / l) as v from (select *, sqrt(list_inner_product(latent::double[], latent::double[])) as l from r))"""


def _pairs(same: bool) -> str:
    return f"""select q.cell as q_cell, i.cell as i_cell, i."time" as i_time, i.embryo as i_embryo, i.shard as i_shard, round(list_inner_product(q.v, i.v), 6) as sim
      from u q join u i on i."time" > q."time" + {LOW} and i."time" <= q."time" + {HIGH} and q.cell <> i.cell {'and (q.embryo < 0 or q.embryo = i.embryo)' if same else ''}"""


def _ranked(name: str, source: str, k: int = K) -> str:
    return f"{name} as (select q_cell, i_cell, sim, rank from (select *, row_number() over (partition by q_cell order by sim desc, i_time, i_embryo, i_cell, i_shard) as rank from ({source})) where rank <= {k})"


def _search(spark, d, policy):
    u = neighbors.normalized(records(spark, d))
    return neighbors.forward_neighbors(u, u, K, LOW, HIGH, policy).select("q_cell", "i_cell", "sim", "rank")


@query("q029_forward_neighbors", f"{R}, {UNIT}, {_ranked('t', _pairs(False))} select * from t")
def q029(spark, d):
    """The most similar records of the future window."""
    return _search(spark, d, "any")


@query("q030_same_embryo", f"{R}, {UNIT}, {_ranked('t', _pairs(True))} select * from t")
def q030(spark, d):
    """The same inside the query's embryo."""
    return _search(spark, d, "same_embryo_only")


@query("q031_same_embryo_first", f"""{R}, {UNIT}, {_ranked('s', _pairs(True))}, {_ranked('a', _pairs(False))},
  b as (select *, 0 as l from s union all select *, 1 from a where (q_cell, i_cell) not in (select (q_cell, i_cell) from s)),
  t as (select q_cell, i_cell, sim, row_number() over (partition by q_cell order by l, rank) as rank from b) select * from t where rank <= {K}""")
def q031(spark, d):
    """The embryo's own list, filled up from all embryos."""
    return _search(spark, d, "same_embryo_first")


@query("q033_list_search")
def q033(spark, d):
    """Approximate search in lists of consecutive times."""
    r = records(spark, d)
    return neighbors.list_search(r.where("cell % 50 = 0"), r, 10, 4096, 8).select("q_cell", "i_cell", "sim", "rank")


_SPARSE = f"""with {EXPRESSION}, n as (select cell_id, sqrt(sum(value * value)) as l from e group by 1), v as (select cell_id, gene_id, value / l as v from e join n using (cell_id)),
  p as (select q.cell_id as q_cell, i.cell_id as i_cell, round(sum(q.v * i.v), 6) as sim from v q join v i using (gene_id) where q.cell_id % 50 = 0 and q.cell_id <> i.cell_id group by all)"""


@query("q034_sparse_neighbors", f"{_SPARSE} select q_cell, i_cell, sim, rank from (select *, row_number() over (partition by q_cell order by sim desc, i_cell) as rank from p) where rank <= 10")
def q034(spark, d):
    """Nearest sparse rows of every fiftieth cell."""
    e = expression(spark, d, by="cell_id")
    return neighbors.sparse_neighbors(e, e.where("cell_id % 50 = 0"), 10).select("q_cell", "i_cell", "sim", "rank")


@query("q035_distances", f"{R}, {UNIT}, {_ranked('t', _pairs(True))} select q_cell, i_cell, round(greatest(2 - 2 * sim, 0), 6) as sqdist, round(sqrt(greatest(2 - 2 * sim, 0) + 1e-12), 6) as dist from t")
def q035(spark, d):
    """Distances of the neighbours found."""
    n = neighbors.distances(_search(spark, d, "same_embryo_only"))
    return n.select("q_cell", "i_cell", F.round("sqdist", 6).alias("sqdist"), F.round("dist", 6).alias("dist"))


@query("q036_by_cell", f'{R} select cell, embryo, "time" from r where cell % 50 = 0')
def q036(spark, d):
    """Query records looked up by cell."""
    r = records(spark, d)
    return neighbors.by_cell(r, r.where("cell % 50 = 0").select("cell")).select("cell", "embryo", "time")


@query("q037_routes", f"""{R}, q as (select cell // 256 as block, min("time") + {LOW} as lower, max("time") + {HIGH} as upper from r group by 1), i as (select shard, min("time") as t0, max("time") as t1 from r group by 1)
  select block, shard, t1 > lower and t0 <= upper as overlaps from q, i""")
def q037(spark, d):
    """Query blocks against index shards."""
    r = records(spark, d)
    return neighbors.routes(r, r, 256, LOW, HIGH)


@query("q038_shard_merge", f"{R}, {UNIT}, {_ranked('t', _pairs(False), 3)} select * from t")
def q038(spark, d):
    """Lists by shard parity, merged."""
    u = neighbors.normalized(records(spark, d))
    parts = [neighbors.future_top_k(u, u.where(F.col("cell") % 2 == p), 3, LOW, HIGH, same_embryo=False) for p in (0, 1)]
    return neighbors.merge_candidates(parts[0].unionByName(parts[1]), 3).select("q_cell", "i_cell", "sim", "rank")




def _sql_knn(score: str, order: str, unit: bool = False) -> str:
    vec = "select cell, v from u" if unit else "select cell, latent::double[] as v from r"
    return f"""{R}, {UNIT}, z as ({vec}), p as (select q.cell as q_cell, i.cell as i_cell, round({score}, 5) as score from z q join z i on q.cell <> i.cell where q.cell % 50 = 0)
      select q_cell, i_cell, score, rank from (select *, row_number() over (partition by q_cell order by score {order}, i_cell) as rank from p) where rank <= 15"""


def _knn(spark, d, metric):
    r = records(spark, d)
    return neighbors.exact_neighbors(r.where("cell % 50 = 0"), r, 15, metric).select("q_cell", "i_cell", "score", "rank")


for _name, _metric, _sql in (
    ("q039_knn_cosine", "cosine", _sql_knn("list_inner_product(q.v, i.v)", "desc", unit=True)),
    ("q041_knn_l2", "l2", _sql_knn("greatest(list_inner_product(q.v, q.v) + list_inner_product(i.v, i.v) - 2 * list_inner_product(q.v, i.v), 0)", "asc")),
    ("q041_knn_ip", "ip", _sql_knn("list_inner_product(q.v, i.v)", "desc")),
):
    query(_name, _sql)(lambda spark, d, m=_metric: _knn(spark, d, m))


@query("q042_unit_rows", f"{R}, {UNIT} select cell, list_transform(v, lambda x: round(x, 5)) as v from u")
def q042(spark, d):
    """Vectors of length one."""
    u = neighbors.normalized(records(spark, d))
    return u.select("cell", F.transform("latent", lambda x: F.round(x, 5)).alias("v"))


@query("q045_slab_assignment", f"""{R}, o as (select *, row_number() over (partition by embryo order by "time", cell) - 1 as pos from r where cell % 10 <> 0),
  s as (select embryo, pos // {C.slab_rows} as slab, min("time") as b, max("time") as e from o group by all)
  select cell, embryo, (select min(slab) from s where s.embryo = r.embryo and r."time" >= b - 0.05 and r."time" <= e + 0.05) as slab from r where cell % 10 = 0""")
def q045(spark, d):
    """New records with the first slab that takes them."""
    return _assigned(spark, d).select("cell", "embryo", "slab")


def _assigned(spark, d):
    r = records(spark, d)
    return trajectory.assign_slabs(r.where("cell % 10 = 0"), trajectory.slabs(r.where("cell % 10 <> 0"), C.slab_rows), 0.05)


@query("q085_record_order", f'{R} select cell, embryo, row_number() over (partition by embryo order by "time", cell) - 1 as pos from r')
def q085(spark, d):
    """Records in trajectory order."""
    return trajectory.ordered(records(spark, d)).select("cell", "embryo", "pos")


_SLABS = f"""{R}, o as (select *, row_number() over (partition by embryo order by "time", cell) - 1 as pos from r), s as (select embryo, pos // {C.slab_rows} as slab, count(*) as n, min("time") as "begin", max("time") as "end" from o group by all)"""


@query("q086_slabs", f"{_SLABS} select * from s")
def q086(spark, d):
    """Time slabs of every embryo."""
    return trajectory.slabs(records(spark, d), C.slab_rows)


@query("q086_spans", f'{R} select embryo, count(*) as n, min("time") as "begin", max("time") as "end" from r group by 1')
def q086b(spark, d):
    """Embryo spans."""
    return trajectory.spans(records(spark, d))


@query("q087_window_bounds", f"""{R}, t as (select cell, embryo, round("time", 6) as t from r)
  select a.cell, count(*) filter (where b.t <= round(a.t + {LOW}, 6)) as "begin", count(*) filter (where b.t <= round(a.t + {HIGH}, 6)) as "end" from t a join t b using (embryo) group by 1""")
def q087(spark, d):
    """Row ranges of the future windows."""
    return neighbors.window_bounds(records(spark, d), LOW, HIGH)


_EDGES = f"""{R}, cp as (select q.cell as src, i.cell as dst, round(list_inner_product(q.latent::double[], i.latent::double[]), 6) as score, round(i."time" - q."time", 6) as dt, i."time" as it
    from r q join r i on i."time" > q."time" + {LOW} and i."time" <= q."time" + {HIGH} and (q.embryo < 0 or q.embryo = i.embryo) and q.cell <> i.cell),
  cd as (select src, dst, score, dt from (select *, row_number() over (partition by src order by score desc, it, dst) as rn from cp where score >= 0) where rn <= {C.k}),
  so as (select *, row_number() over (partition by src order by score desc, dt, dst) as i from cd),
  fo as (
    select src, 0::bigint as i, [{{'score': 0.0::double, 'dt': 0.0::double, 'dst': 0::bigint}}][1:0] as kept from (select distinct src from so) union all
    select f.src, f.i + 1, case when len(kept) >= {C.degree} or len(list_filter(kept, lambda y: s.dt > y.dt * {C.gap_ratio}::double and s.score + {C.score_margin}::double < y.score)) > 0 then kept
      else list_append(kept, {{'score': s.score, 'dt': s.dt, 'dst': s.dst}}) end from fo f join so s on s.src = f.src and s.i = f.i + 1),
  ed as (select src, x.dst as dst, x.score as score, x.dt as dt from (select src, unnest(kept) as x from (select src, kept, row_number() over (partition by src order by i desc) as z from fo) where z = 1)),
  tr as (select r.cell as node, parent, score, dt from r left join (select dst as node, src as parent, score, dt from (select *, row_number() over (partition by dst order by score desc, src) as z from ed) where z = 1) using (node))""".replace("from r left join (select dst as node", "from r left join (select dst as cell").replace("where z = 1) using (node))", "where z = 1) using (cell))")


def _edges(spark, d):
    return trajectory.prune(trajectory.candidates(records(spark, d), C), C)


def _tree(spark, d, edges=None):
    return trajectory.principal_tree(records(spark, d), _edges(spark, d) if edges is None else edges)


@query("q106_candidates", f"{_EDGES} select * from cd")
def q106(spark, d):
    """Forward candidates by inner product."""
    return trajectory.candidates(records(spark, d), C)


@query("q107_pruned_edges", f"{_EDGES} select * from ed")
def q107(spark, d):
    """Edges that no better kept edge dominates."""
    return _edges(spark, d)


@query("q108_inbound", f"{_EDGES} select dst as node, src, score, dt from ed")
def q108(spark, d):
    """The graph by target."""
    return trajectory.inbound(_edges(spark, d))


@query("q109_principal_tree", f"{_EDGES} select * from tr")
def q109(spark, d):
    """The best inbound edge of every node."""
    return _tree(spark, d)


_DEPTH = f"{_EDGES}, dp as (select node, node as root, 0 as depth from tr where parent is null union all select t.node, root, depth + 1 from tr t join dp on t.parent = dp.node)"


@query("q110_depths", f"{_DEPTH} select * from dp")
def q110(spark, d):
    """Root and depth of every node."""
    return trajectory.depths(_tree(spark, d), cut)


_SUPER = f"""{_EDGES}, ln as (select t.node, case when c.n = 1 and t.score >= {C.parent_score} and t.dt <= {C.chain_dt} then t.parent end as up from tr t left join (select parent, count(*) as n from tr where parent is not null group by 1) c on c.parent = t.parent),
  sn as (select node, node as supernode from ln where up is null union all select l.node, supernode from ln l join sn on l.up = sn.node),
  dg as (select a.supernode as src, b.supernode as dst, count(*) as mass, max(score) as score from ed join sn a on a.node = ed.src join sn b on b.node = ed.dst where a.supernode <> b.supernode group by all)"""


def _super(spark, d):
    edges = cut(_edges(spark, d))
    return trajectory.supernodes(_tree(spark, d, edges), records(spark, d), C, cut), edges


@query("q111_supernodes", f"{_SUPER} select * from sn")
def q111(spark, d):
    """Chains merged to supernodes."""
    return _super(spark, d)[0]


@query("q111_supernode_table", f"""{_SUPER}, mm as (select supernode, "time", latent from sn join r on r.cell = sn.node),
  av as (select supernode, list(round(a, 6) order by i) as centroid from (select supernode, i, avg(x) as a from (select supernode, unnest(latent)::double as x, generate_subscripts(latent, 1) as i from mm) group by all) group by 1)
  select supernode, count(*) as mass, min("time") as "begin", max("time") as "end", any_value(centroid) as centroid from mm join av using (supernode) group by 1""")
def q111b(spark, d):
    """Mass, time span and mean vector of every supernode."""
    return trajectory.supernode_table(_super(spark, d)[0], records(spark, d))


@query("q112_supernode_edges", f"{_SUPER} select * from dg")
def q112(spark, d):
    """Edges between supernodes with mass and score."""
    return trajectory.supernode_edges(*_super(spark, d))


@query("q113_branches", f"""{_SUPER}, tw as (select src as supernode, max(mass) filter (where z = 1) as "first", max(mass) filter (where z = 2) as "second" from (select *, row_number() over (partition by src order by mass desc, dst) as z from dg) where z <= 2 group by 1)
  select * from tw where "second" >= {C.branch_mass} and "second" >= {C.branch_ratio} * ("first" + "second")""")
def q113(spark, d):
    """Supernodes where the trajectory branches."""
    return trajectory.branches(trajectory.supernode_edges(*_super(spark, d)), C)


@query("q114_insert_plan", f"""{R}, o as (select *, row_number() over (partition by embryo order by "time", cell) - 1 as pos from r where cell % 10 <> 0),
  s as (select embryo, pos // {C.slab_rows} as slab, min("time") as b, max("time") as e from o group by all),
  a as (select cell, embryo, (select min(slab) from s where s.embryo = r.embryo and r."time" >= b - 0.05 and r."time" <= e + 0.05) as slab from r where cell % 10 = 0)
  select embryo, slab, count(*) as n, list(cell order by cell) as cells from a group by all""")
def q114(spark, d):
    """New records by slab, and those without one."""
    return trajectory.insert_plan(_assigned(spark, d))


@query("q115_build", f"{_DEPTH}, xx as (select 1) select (select count(*) from r) as nodes, (select count(*) from ed) as edges, (select count(*) from tr where parent is null) as roots, (select max(depth) from dp) as deepest")
def q115(spark, d):
    """Counts of the whole build: nodes, edges, roots and the deepest node."""
    edges = cut(_edges(spark, d))
    tree = cut(_tree(spark, d, edges))
    n = tree.agg(F.count("*").alias("nodes"), F.count_if(F.col("parent").isNull()).alias("roots"))
    deep = trajectory.depths(tree, cut).agg(F.max("depth").alias("deepest"))
    return n.join(F.broadcast(edges.agg(F.count("*").alias("edges")))).join(F.broadcast(deep)).select("nodes", "edges", "roots", "deepest")


@query("q116_paths", f"{_EDGES}, pa as (select node as start, node, 0 as step from tr union all select start, t.parent, step + 1 from pa join tr t using (node) where t.parent is not null) select * from pa")
def q116(spark, d):
    """Ancestors of every node."""
    tree = cut(_tree(spark, d))
    return trajectory.paths(tree, tree, cut)


@query("q116_subtree", f"{_DEPTH}, st as (select root as node, 0 as depth from (select root, count(*) as n from dp group by 1 order by n desc, root limit 1) union all select t.node, depth + 1 from tr t join st on t.parent = st.node) select * from st")
def q116b(spark, d):
    """The largest tree from its root."""
    tree = cut(_tree(spark, d))
    root = trajectory.depths(tree, cut).groupBy("root").count().orderBy(F.desc("count"), "root").first()[0]
    return trajectory.subtree(tree, root, cut)
