"""Planning, validation, traces and the rest of the inventory (32, 40, 43, 47, 52, 120, 124, 129-131, 133, 136-137, 144-145)."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from ..functions.hashing import splitmix, sql_splitmix
from ..functions.lineage import cut
from ..operators import models, neighbors, packing, planning, sampling, support
from ..sources.tables import EXPRESSION, RECORDS, SUPPORT, cells, expression, features, records
from ..sources.tables import support as sets
from .catalog import query
from .graph_queries import HIGH, LOW, UNIT
from .packing_queries import _TILES as TILE_SQL
from .packing_queries import _tiles, groups, plan
from .qc_queries import GENE, NORMAL, QC, metrics
from .sampling_queries import CELL_IDS, SEED, _overlap, _sql_pairs, _sql_row_hash

R = f"with {RECORDS}, {UNIT}"
_ALL = f"""p as (select q.cell as q_cell, i.cell as i_cell, i."time" as i_time, i.embryo as i_embryo, abs(q."time" - i."time") as dt, round(list_inner_product(q.v, i.v), 1) as sim
  from u q join u i on i."time" > q."time" + {LOW} and i."time" <= q."time" + {HIGH} and q.cell <> i.cell)"""


@query("q032_tie_order", f"{R}, {_ALL} select q_cell, i_cell, rank from (select *, row_number() over (partition by q_cell order by sim desc, i_time, i_embryo, i_cell) as rank from p) where rank <= 5")
def q032(spark, d):
    """Neighbours whose similarities, rounded to a tenth, are mostly tied."""
    u = neighbors.normalized(records(spark, d)).withColumn("shard", F.lit(0))
    return neighbors.future_top_k(u, u, 5, LOW, HIGH, same_embryo=False, digits=1).select("q_cell", "i_cell", "rank")


@query("q040_projection_search")
def q040(spark, d):
    """Approximate neighbours of every fiftieth record by random projections."""
    from pyspark.ml.feature import BucketedRandomProjectionLSH
    from pyspark.ml.functions import array_to_vector

    r = records(spark, d)
    zero = spark.range(1).select(array_to_vector(F.array_repeat(F.lit(0.0), 64)).alias("v"))  # the projections depend on the seed and the length alone
    model = BucketedRandomProjectionLSH(inputCol="v", outputCol="h", bucketLength=0.5, numHashTables=3, seed=5).fit(zero)
    planes = np.array([list(v.toArray()) for v in model._java_obj.randUnitVectors()])
    near = neighbors.projection_neighbors(r.where("cell % 50 = 0"), r, 10, planes, 0.5, 0.9)
    return near.select("q_cell", "i_cell", F.round(-F.col("sim"), 5).alias("distance"), "rank")


@query("q043_merged_lists", f"""{R}, p as (select q.cell as q_cell, i.cell as i_cell, round(list_inner_product(q.v, i.v), 5) as score from u q join u i on q.cell <> i.cell where q.cell % 50 = 0)
  select q_cell, i_cell, score, rank from (select *, row_number() over (partition by q_cell order by score desc, i_cell) as rank from p) where rank <= 8""")
def q043(spark, d):
    """Lists over four parts of the index, merged."""
    r = records(spark, d)
    out = None
    for part in range(4):
        one = neighbors.exact_neighbors(r.where("cell % 50 = 0"), r.where(F.col("cell") % 4 == part), 8).drop("rank")
        out = one if out is None else out.unionByName(one)
    best = neighbors.merge_candidates(out.withColumnRenamed("score", "sim"), 8)
    return best.select("q_cell", "i_cell", F.col("sim").alias("score"), "rank")


@query("q047_bucket_pairs", _sql_pairs() + ", y as (select key, band, count(*) as n from x group by all) select band, count(*) as buckets, sum(n * (n - 1) // 2)::bigint as raw_pairs from y group by 1")
def q047(spark, d):
    """Buckets and raw pairs of every band."""
    p = support.Sketch(seed=SEED)
    m = support.bucket_members(support.band_keys(support.sketches(sets(spark, d), "gene_id", "cell_id", p), "gene_id", p), "gene_id", p)
    n = m.groupBy("key", "band").agg(F.count("*").alias("n"))
    return n.groupBy("band").agg(F.count("*").alias("buckets"), F.sum(F.floor(F.col("n") * (F.col("n") - 1) / 2)).alias("raw_pairs"))


@query("q052_fused_metrics", f"""{QC}, {NORMAL}, {GENE} select gene_id, round("sum", 6) as "sum", detected from w""")
def q052(spark, d):
    """Normalisation and gene sums in one pass over the joined rows."""
    m = metrics(spark, d).where("keep").select("cell_id", "total")
    v = F.log1p(F.col("value") * F.when(F.col("total") > 0, 10_000.0 / F.col("total")).otherwise(0.0))
    return expression(spark, d).join(m, "cell_id").groupBy("gene_id").agg(F.round(F.sum(v), 6).alias("sum"), F.count_if(v != 0).alias("detected"))


@query("q120_pair_losses", f"""{R}, p as (select i."time" - q."time" as dt, round(list_inner_product(q.v, i.v), 6) as sim from u q join u i on i."time" > q."time" + {LOW} and i."time" <= q."time" + {HIGH} and (q.embryo < 0 or q.embryo = i.embryo) and q.cell <> i.cell)
  select round(avg(greatest(2 - 2 * sim, 0)) filter (where dt <= 0.05), 6) as local, count(*) filter (where dt <= 0.05) as n_local,
    round(avg(greatest(1.0 - sqrt(greatest(2 - 2 * sim, 0) + 1e-12), 0)) filter (where dt >= 0.08), 6) as far, count(*) filter (where dt >= 0.08) as n_far from p""")
def q120(spark, d):
    """Losses of pairs near and far in time."""
    u = neighbors.normalized(records(spark, d))
    return models.window_pair_losses(u, LOW, HIGH, 0.05, 0.08, 1.0).withColumns({c: F.round(c, 6) for c in ("local", "far")})


@query("q129_greedy_blocks")
def q129(spark, d):
    """Features merged to blocks by exact gain."""
    gains = support.merge_gain(_overlap(spark, d)).select("gene_a", "gene_b", "gain")
    return planning.greedy_blocks(gains, sets(spark, d).select("gene_id").distinct(), 32)


@query("q129_optimized", f"with {SUPPORT} select count(distinct gene_id) as features, true as fits, true as cheaper, 1::bigint as blocks_of_a_feature from s")
def q129b(spark, d):
    """Blocks merged, then features moved and swapped, costed exactly on the way: that every feature is in one block, blocks fit
    the width, and the plan is cheaper than single features."""
    s = sets(spark, d)
    o = _overlap(spark, d)
    gains = o.select("gene_a", "gene_b", (F.col("intersection") * 10 - F.col("union")).alias("gain")).where("gain > 0")
    rows = s.select("cell_id", F.floor(F.col("cell_id") / 256).alias("row_group")).distinct()

    def cost(p):
        t = packing.tile_occupancy(s, p, rows)
        return float(packing.packing_cost(packing.occupancy_summary(t, 1, 1), 1).first()["total_bytes"])

    start = s.select("gene_id", F.col("gene_id").alias("block")).distinct()
    best, log = planning.optimize_blocks(s, start, gains, 32, cost, most_evaluations=8)
    size = best.groupBy("block").agg(F.count("*").alias("n"))
    once = best.groupBy("gene_id").agg(F.count("*").alias("n"))
    fits = size.agg((F.max("n") <= 32).alias("fits"))
    return best.agg(F.countDistinct("gene_id").alias("features")).join(F.broadcast(fits)).join(F.broadcast(once.agg(F.max("n").alias("blocks_of_a_feature")))).withColumn("cheaper", F.lit(any(ok for *_, ok in log)))


@query("q130_refinement")
def q130(spark, d):
    """Feature orders tried in turn, accepted on held-out bytes."""
    split = cut(sampling.held_out_split(expression(spark, d), "cell_id", SEED, 1, 4))
    held, g = split.where("held_out"), groups(spark, d)
    orders = [(f"modulus {m}", packing.width_plan(features(spark, d).select("gene_id"), 32, [F.col("gene_id") % m])) for m in (17, 5, 2, 1)]

    def cost(p):
        t = packing.tile_occupancy(held, p, g)
        return float(packing.packing_cost(packing.occupancy_summary(t, 1, 1), 1).first()["total_bytes"])

    start = packing.width_plan(features(spark, d).select("gene_id"), 32, [F.col("gene_id") % 101])
    return spark.createDataFrame(planning.refine(start, orders, cost)[1], "proposal string, cost double, accepted boolean")


@query("q130_alternating")
def q130b(spark, d):
    """Feature order and block width refined in turns on held-out bytes, until a pass changes nothing."""
    split = cut(sampling.held_out_split(expression(spark, d), "cell_id", SEED, 1, 4))
    held, g, of = split.where("held_out"), groups(spark, d), features(spark, d).select("gene_id")
    degree = cut(split.where("not held_out").groupBy("gene_id").agg(F.count("*").alias("n")))
    by_degree = of.join(degree, "gene_id", "left").select("gene_id", F.coalesce("n", F.lit(0)).alias("n"))
    made = {"modulus": lambda w: packing.width_plan(of, w, [F.col("gene_id") % 17]), "degree": lambda w: packing.width_plan(by_degree, w, [F.desc("n")])}
    cost = lambda p: float(packing.packing_cost(packing.occupancy_summary(packing.tile_occupancy(held, made[p[0]](p[1]), g), 1, 1), 1).first()["total_bytes"])
    moves = [("order", lambda p: ("degree" if p[0] == "modulus" else "modulus", p[1])), ("wider", lambda p: (p[0], min(64, p[1] * 2)))]
    best, log, reason = planning.alternate(("modulus", 32), moves, cost, most_passes=3)
    return spark.createDataFrame([(*entry, reason) for entry in log], "pass int, move string, cost double, accepted boolean, stopped string")


@query("q131_null_comparison")
def q131(spark, d):
    """Tile metrics against those of a random matrix of the same degrees."""
    real = sets(spark, d)
    null = sampling.degree_preserving_null(real, "gene_id", "cell_id", SEED)
    genes = real.select("gene_id").distinct()
    p = packing.width_plan(genes, 32, [F.col("gene_id")])
    g = real.select("cell_id", F.floor(F.col("cell_id") / 256).alias("row_group")).distinct()
    tiles = [packing.occupancy_summary(packing.tile_occupancy(x, p, g), 1, 1).select("occupied_tiles", "nnz", "padding", "row_block_references", "nnz_sq") for x in (real, null)]
    return planning.against_null(*tiles)


@query("q133_hardware_cost")
def q133(spark, d):
    """Measured-like times of tile shapes against a fitted model; the observations are bounded by windows."""
    t = _tiles(spark, d).groupBy("window").agg(
        F.countDistinct("tile").alias("tiles"), F.count("*").alias("tile_blocks"), F.sum(F.size("entries")).alias("entries"), F.sum("nnz").alias("nnz"), F.sum(F.bit_count("cell_mask")).alias("rows"),
    )
    bytes_ = 12 * F.col("tile_blocks") + 8 * F.col("entries") + 2 * F.col("nnz")
    t = t.withColumns({"bytes": bytes_, "block_width": F.lit(32), "index_bytes": F.lit(4), "alignment": F.lit(16), "transactions": bytes_ / 128})
    t = cut(t.withColumn("seconds", 1e-9 * (50 * F.col("tile_blocks") + 3 * F.col("nnz") + 1000)))
    model = planning.fit_cost_table(t, "seconds")
    return t.select("window", "seconds", planning.predicted_cost(model).alias("predicted"))


_WINDOWS = f"""{TILE_SQL}, s as (select "window", sum(nnz)::bigint as nnz, count(*) as tb, sum(entries)::bigint as en from wt group by 1),
  c as (select "window", 1 as id, 6 * nnz as bytes, 9.0::double * nnz + 500 as ns from s union all select "window", 2, 12 * tb + 8 * en + 2 * nnz, 3.0::double * nnz + 50 * tb + 1000 from s
    union all select "window", 3, 8 * en + 2 * nnz, 3.0::double * nnz + 20 * en from s)"""


@query("q133_selected", f"""{_WINDOWS} select "window", id, round(cost, 3) as cost from (select *, 0.5::double * bytes + ns as cost, row_number() over (partition by "window" order by 0.5::double * bytes + ns, id) as i from c) where i = 1""")
def q133b(spark, d):
    """Per window of cells the layout of least weighted bytes and time: rows (1), tiles (2) or records (3)."""
    s = _tiles(spark, d).groupBy("window").agg(F.sum("nnz").alias("nnz"), F.count("*").alias("tb"), F.sum(F.size("entries")).alias("en"))
    nnz, tb, en = F.col("nnz"), F.col("tb"), F.col("en")
    costs = [(1, 6 * nnz, 9.0 * nnz + 500), (2, 12 * tb + 8 * en + 2 * nnz, 3.0 * nnz + 50 * tb + 1000), (3, 8 * en + 2 * nnz, 3.0 * nnz + 20 * en)]
    each = F.explode(F.array(*(F.struct(F.lit(i).alias("id"), b.cast("long").alias("bytes"), t.cast("double").alias("nanoseconds")) for i, b, t in costs))).alias("c")
    return planning.select_plan(s.select("window", each).select("window", "c.*"), ["window"], byte_weight=0.5).withColumn("cost", F.round("cost", 3))


_CAND = f"""{TILE_SQL}, s as (select sum(nnz)::double as nnz, count(*)::double as tb, sum(entries)::double as en from wt),
  c as (select 1 as id, 'rows' as name, true as legal, 0.0::double as preparation, nnz * 6 as execution, nnz * 6 as bytes from s union all select 2, 'records', true, nnz * 10, en * 8 + nnz * 2, en * 8 + nnz * 2 from s
    union all select 3, 'tiles', true, nnz * 20, tb * 12 + en * 4 + nnz * 2, tb * 12 + en * 8 + nnz * 2 from s union all select 4, 'dense', false, 0, 1, 1 from s),
  kk as (select id, name, preparation / 100 + execution as cost, bytes from c where legal), m as (select *, row_number() over (order by cost, id) as place from kk)
  select id, name, round(cost, 3) as cost, place, row_number() over (order by (cost <= (select min(cost) from m where place <= 3) * 1.02::double) desc, bytes, id) = 1 as chosen from m where place <= 3"""


@query("q136_plan_choice", _CAND)
def q136(spark, d):
    """Legal layouts by amortised cost and the one chosen."""
    s = _tiles(spark, d).agg(F.sum("nnz").cast("double").alias("nnz"), F.count("*").cast("double").alias("tb"), F.sum(F.size("entries")).cast("double").alias("en"))
    nnz, tb, en = F.col("nnz"), F.col("tb"), F.col("en")
    c = lambda i, name, legal, prep, run, size: s.select(F.lit(i).alias("id"), F.lit(name).alias("name"), F.lit(legal).alias("legal"), prep.alias("preparation"), run.alias("execution"), size.alias("bytes"))
    zero, one = F.lit(0.0), F.lit(1.0)
    table = c(1, "rows", True, zero, nnz * 6, nnz * 6).unionAll(c(2, "records", True, nnz * 10, en * 8 + nnz * 2, en * 8 + nnz * 2))
    table = table.unionAll(c(3, "tiles", True, nnz * 20, tb * 12 + en * 4 + nnz * 2, tb * 12 + en * 8 + nnz * 2)).unionAll(c(4, "dense", False, zero, one, one))
    return planning.rank_candidates(table, 100, 3, 0.02).select("id", "name", F.round("cost", 3).alias("cost"), "place", "chosen")


@query("q137_objective", f"""{TILE_SQL}, s as (select sum(nnz)::double as nnz, 12 * count(*) + 8 * sum(entries) as meta, avg(nnz / bit_count(feature_union)) as reuse, avg(spread) as imbalance from wt)
  select round((meta + 2 * nnz) / 10 + 0.5 * imbalance * nnz + 0.25 * 1.5 * nnz - 0.125 * reuse * nnz - 0.0625 * nnz, 2) as score from s""")
def q137(spark, d):
    """Weighted cost of the tiles less their credits."""
    t = _tiles(spark, d)
    m = packing.tile_metrics(t).join(F.broadcast(packing.tile_statistics(t, plan(spark, d).groupBy("block").agg(F.count("*").alias("block_features")))))
    zero = F.lit(0.0)
    stats = {"metadata_bytes": F.col("metadata_bytes"), "value_bytes": F.col("value_bytes"), "partial_slots": zero, "row_imbalance": F.col("mean_imbalance"), "transpose_locality": F.lit(0.5), "cross_edges": zero, "outliers": zero, "feature_reuse": F.col("mean_reuse"), "module_overlap": zero, "module_activation": zero}
    weights = {"byte": 1.0, "imbalance": 0.5, "transpose": 0.25, "reuse": 0.125, "epilogue": 0.0625}
    score = planning.objective(F.col("nnz").cast("double"), weights, stats, 10.0, 64, 2.0, transpose=True, canonical=False, quantized=False, fused=True)
    return m.select(F.round(score, 2).alias("score"))


def _sql_trace(columns: int = 2000) -> str:
    """Entries tr ("row", "column") of the synthetic trace with as many rows as there are cells."""
    fold, part = 1 << 30, columns // 8
    u = sql_splitmix(f'(select row_number() over (order by cell_id) - 1 as "row" from {CELL_IDS})', "x", f'xor("row"::ubigint, {splitmix(SEED ^ 1)}::ubigint)')
    y = sql_splitmix('(select *, "row" * 65536 + j as at_key from tj)', "y", f"xor(at_key::ubigint, {splitmix(SEED ^ 2)}::ubigint)")
    return f"""with tu as (select "row", ((x >> 1) % {fold})::bigint as u from ({u})),
      td as (select *, case when u % 3 = 0 then least({columns}, floor(4 / sqrt((u + 1) / {fold}.0::double)))::int when u % 3 = 1 then 24 else 12 end as degree from tu),
      tj as (select "row", u % 3 as family, unnest(range(0, degree)) as j from td), ty as (select *, ((y >> 1) % {fold})::bigint as hit from ({y})),
      tr as (select distinct "row", case when family = 1 then ("row" // 32 * 24 + j) % {columns} when family = 2 then ("row" % 8 * {part} + hit % {part}) % {columns} else hit % {columns} end as "column" from ty)"""


@query("q144_synthetic_trace", f'{_sql_trace()} select "row", "column" from tr')
def q144(spark, d):
    """A synthetic support of as many rows as there are cells."""
    return planning.synthetic_trace(spark, cells(spark, d).count(), 2000, SEED)


@query("q144_trace_summary", f"""{_sql_trace()}, n as (select "row", count(*) as n from tr group by 1)
  select count(*) as rows, sum(n)::bigint as nnz, avg(n) as mean_degree, min(n) as least, max(n) as most, (select count(distinct "column") from tr) as columns from n""")
def q144b(spark, d):
    """Summary of that trace."""
    return planning.trace_summary(planning.synthetic_trace(spark, cells(spark, d).count(), 2000, SEED))


@query("q145_support_trace", f"with {EXPRESSION}, p as (select cell_id, row_number() over (order by cell_id) - 1 as position from (select cell_id from ({_sql_row_hash(CELL_IDS, 'cell_id')}) order by h, cell_id limit 200)) select position, list(distinct gene_id order by gene_id) as columns from e join p using (cell_id) group by 1")
def q145(spark, d):
    """Sorted columns of two hundred sampled rows."""
    p = sampling.lowest_hashes(cells(spark, d).select("cell_id"), "cell_id", SEED, 200)
    return planning.support_lists(expression(spark, d), p)
