"""Sparse algebra, order and output updates (18-20, 65, 84, 88-89, 95-102, 140-143)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import sparse
from ..sources.tables import EXPRESSION, cells, expression, features, table
from .catalog import query

E = f"with {EXPRESSION}"
SCALE = "sc as (select distinct cell_id, 1.0::double / (1 + cell_id % 7) as scale from cells)"
X = "x as (select gene_id, (gene_id % 11)::double as x from genes)"
B = "b as (select gene_id, k, ((gene_id * (k + 3)) % 13)::double as b from genes, (select unnest([0, 1, 2, 3]) as k))"


def scales(spark, d):
    return cells(spark, d).select("cell_id", (1.0 / (1 + F.col("cell_id") % 7)).alias("scale"))


def vector(spark, d):
    return features(spark, d).select("gene_id", (F.col("gene_id") % 11).cast("double").alias("x"))


def dense(spark, d):
    return features(spark, d).select("gene_id", F.explode(F.array(*(F.lit(k) for k in range(4)))).alias("k")).withColumn("b", ((F.col("gene_id") * (F.col("k") + 3)) % 13).cast("double"))


def gradient(spark, d):
    return expression(spark, d).select("cell_id", "gene_id", (((F.col("cell_id") + F.col("gene_id")) % 5) - 2).cast("double").alias("g"))


@query("q018_row_scale", f"{E}, {SCALE} select cell_id, gene_id, round(value * scale, 6) as value from e join sc using (cell_id)")
def q018(spark, d):
    """Entries scaled by their row."""
    return sparse.row_scale(expression(spark, d), scales(spark, d)).withColumn("value", F.round("value", 6))


@query("q019_row_scale_backward", f"{E}, {SCALE} select cell_id, round(sum(value * ((cell_id + gene_id) % 5 - 2)), 6) + 0.0 as d_scale, round(sum(((cell_id + gene_id) % 5 - 2) * scale), 5) + 0.0 as d_value_sum from e join sc using (cell_id) group by 1")
def q019(spark, d):
    """Gradients of the row scale."""
    d_values, d_scales = sparse.row_scale_backward(gradient(spark, d), expression(spark, d), scales(spark, d))
    return d_scales.join(d_values.groupBy("cell_id").agg((F.round(F.sum("d_value"), 5) + 0.0).alias("d_value_sum")), "cell_id").withColumn("d_scale", F.round("d_scale", 6) + 0.0)


@query("q020_gather_rows", f"{E}, w as (select sampled_position as pos, min(global_row) as cell_id from sampled_csr where global_row >= 0 group by 1) select pos, cell_id, gene_id, value from w join e using (cell_id)")
def q020(spark, d):
    """Rows in a requested order, repeats included."""
    w = table(spark, d, "sampled_csr").where("global_row >= 0").groupBy(F.col("sampled_position").alias("pos")).agg(F.min("global_row").alias("cell_id"))
    return sparse.gather_rows(expression(spark, d), w)


@query("q065_weighted_reduction", f"{E} select cell_id, sum(value * (1 + gene_id % 9)) as y from e group by 1")
def q065(spark, d):
    """Feature-weighted row reduction."""
    return sparse.feature_weighted_reduction(expression(spark, d), features(spark, d).select("gene_id", (1.0 + F.col("gene_id") % 9).alias("weight")))


@query("q084_append_rows", f"{E} select cell_id, gene_id, value from e union all select cell_id + (select max(cell_id) + 1 from cells), gene_id, value from e")
def q084(spark, d):
    """A matrix below itself."""
    n = cells(spark, d).agg(F.max("cell_id")).first()[0] + 1
    return sparse.append_rows(expression(spark, d), expression(spark, d), n, "cell_id")


@query("q088_nnz_buckets", f"""{E}, n as (select cell_id, count(*) as nnz from e group by 1), p as (select *, row_number() over (order by nnz, cell_id) - 1 as place, count(*) over () as n from n)
  select cell_id, nnz, place, (select max(b) from (select unnest(range(0, 16)) as b) where (b * n) // 16 <= place)::int as bucket from p""")
def q088(spark, d):
    """Rows by stored entries, in sixteen buckets of equal count."""
    n = expression(spark, d).groupBy("cell_id").agg(F.count("*").alias("nnz"))
    return sparse.nnz_buckets(n, n.count(), 16)


@query("q089_reordered", f"""{E}, n as (select cell_id, count(*) as nnz from e group by 1), p as (select cell_id, row_number() over (order by nnz, cell_id) - 1 as place from n) select place, cell_id, gene_id, value from e join p using (cell_id)""")
def q089(spark, d):
    """Entries by a row permutation."""
    n = expression(spark, d).groupBy("cell_id").agg(F.count("*").alias("nnz"))
    return sparse.reorder(expression(spark, d), sparse.ranked(n, [F.col("nnz")], "place", "cell_id"), "cell_id").select("place", "cell_id", "gene_id", "value")


@query("q095_compressed_rows", f"{E} select cell_id, list(gene_id order by gene_id) as indices, list(value order by gene_id) as data from e group by 1")
def q095(spark, d):
    """Coordinates to compressed rows."""
    return sparse.compress(expression(spark, d), "cell_id", "gene_id")


@query("q095_compressed_columns", f"{E} select gene_id, list(cell_id order by cell_id) as indices, list(value order by cell_id) as data from e group by 1")
def q095b(spark, d):
    """Coordinates to compressed columns."""
    return sparse.compress(expression(spark, d), "gene_id", "cell_id")


@query("q096_transposed", f"{E} select cell_id as gene_id, gene_id as cell_id, value from e")
def q096(spark, d):
    """The transposed matrix."""
    return sparse.transpose(expression(spark, d), "cell_id", "gene_id")


@query("q097_spmv", f"{E}, {X} select cell_id, sum(value * x) as y from e join x using (gene_id) group by 1")
def q097(spark, d):
    """Matrix times vector."""
    return sparse.spmv(expression(spark, d), vector(spark, d), "cell_id", "gene_id")


@query("q097_spmv_backward", f"{E}, {X} select gene_id, sum(value * (cell_id % 5)) as d_x, sum((cell_id % 5) * x) as d_value_sum from e join x using (gene_id) group by 1")
def q097b(spark, d):
    """Gradients of matrix times vector."""
    g = cells(spark, d).select("cell_id", (F.col("cell_id") % 5).cast("double").alias("g"))
    dv, dx = sparse.spmv_backward(expression(spark, d), vector(spark, d), g, "cell_id", "gene_id")
    return dx.join(dv.groupBy("gene_id").agg(F.sum("d_value").alias("d_value_sum")), "gene_id")


@query("q098_spmm", f"{E}, {B} select cell_id, k, sum(value * b) as c from e join b using (gene_id) group by all")
def q098(spark, d):
    """Sparse matrix times dense matrix."""
    return sparse.spmm(expression(spark, d), dense(spark, d), "cell_id", "gene_id")


@query("q099_spmm_backward", f"{E}, {B}, g as (select distinct cell_id, k, ((cell_id + k) % 3)::double as g from cells, (select unnest([0, 1, 2, 3]) as k)) select gene_id, k, sum(value * g) as d_b from e join g using (cell_id) group by all")
def q099(spark, d):
    """Gradient of the dense side."""
    return sparse.spmm_backward(expression(spark, d), dense(spark, d), _g(spark, d), "cell_id", "gene_id")[1]


@query("q099_spmm_backward_values", f"{E}, {B}, g as (select distinct cell_id, k, ((cell_id + k) % 3)::double as g from cells, (select unnest([0, 1, 2, 3]) as k)) select cell_id, gene_id, sum(b * g) as d_value from e join b using (gene_id) join g using (cell_id, k) group by all")
def q099b(spark, d):
    """Gradient of the sparse side."""
    return sparse.spmm_backward(expression(spark, d), dense(spark, d), _g(spark, d), "cell_id", "gene_id")[0]


def _g(spark, d):
    return cells(spark, d).select("cell_id", F.explode(F.array(*(F.lit(k) for k in range(4)))).alias("k")).withColumn("g", ((F.col("cell_id") + F.col("k")) % 3).cast("double"))


@query("q100_general_product", f"""{E}, {B}, ab as (select cell_id, k, sum(value * b) as ab from e join b using (gene_id) group by all),
  c0 as (select distinct cell_id, k, (cell_id % 4 - 2)::double as c from cells, (select unnest([0, 1, 2, 3]) as k))
  select cell_id, k, greatest(0.5 * coalesce(ab, 0) - 3.0 * coalesce(c, 0), 0) as c from ab full join c0 using (cell_id, k)""")
def q100(spark, d):
    """relu(alpha A B + beta C)."""
    c = cells(spark, d).select("cell_id", F.explode(F.array(*(F.lit(k) for k in range(4)))).alias("k"), (F.col("cell_id") % 4 - 2).cast("double").alias("c"))
    return sparse.spmm_general(expression(spark, d), dense(spark, d), "cell_id", "gene_id", 0.5, -3.0, c, lambda v: F.greatest(v, F.lit(0.0)))


@query("q101_trivial_products", "select * from (values (0, 3, 2, 1.0, 'no_output'), (3, 2, 0, 1.0, 'epilogue_only'), (3, 2, 2, 0.0, 'epilogue_only'), (3, 2, 2, 1.0, 'none')) t(n_rows, n_cols, n_inner, alpha, kind)")
def q101(spark, d):
    """Products that need no multiplication."""
    cases = [(0, 3, 2, 1.0), (3, 2, 0, 1.0), (3, 2, 2, 0.0), (3, 2, 2, 1.0)]
    return spark.createDataFrame([(*c, sparse.trivial_operation(*c, 0.0)) for c in cases], "n_rows int, n_cols int, n_inner int, alpha double, kind string")


@query("q102_tolerance", f"{E} select cell_id, gene_id, abs(value - value * (1 + (gene_id % 3) * 1e-3)) <= 1e-9 + 1.5e-3 * abs(value) as close from e")
def q102(spark, d):
    """Comparison within tolerances."""
    v = F.col("value")
    return expression(spark, d).select("cell_id", "gene_id", sparse.close(v * (1 + (F.col("gene_id") % 3) * 1e-3), v, 1e-9, 1.5e-3).alias("close"))


@query("q103_leader_sum", f"{E}, p as (select cell_id, gene_id % 4 as slot, sum(value) as part from e group by all) select cell_id, count(*) as slots, sum(part) as total from p group by 1")
def q103(spark, d):
    """Partial results by slot, added up at the leader."""
    parts = expression(spark, d).groupBy("cell_id", (F.col("gene_id") % 4).alias("slot")).agg(F.sum("value").alias("part"))
    return parts.groupBy("cell_id").agg(F.count("*").alias("slots"), F.sum("part").alias("total"))


@query("q104_packed_operand", f"""{B}, p as (select gene_id, row_number() over (order by gene_id % 10, gene_id) - 1 as place from genes) select place, k, b from b join p using (gene_id)""".replace("b as", "with b as", 1))
def q104(spark, d):
    """A dense operand with its rows in packed order."""
    place = sparse.ranked(features(spark, d).select("gene_id"), [F.col("gene_id") % 10], "place", "gene_id")
    return sparse.reorder(dense(spark, d), place, "gene_id").select("place", "k", "b")


@query("q104_block_candidates", f"""{E}, s as (select unnest([4, 8, 16, 32]) as size),
  t as (select size, cell_id // size as rb, gene_id // size as cb, count(*) as nnz from e, s group by all),
  w as (select size, rb, count(*) as width, sum(nnz) as nnz from t group by all)
  select size, sum(nnz)::bigint as nnz, sum(width)::bigint as occupied_blocks, max(width) as ell_width, max(width) * count(*) * size * size as padded_slots from w group by 1""")
def q104b(spark, d):
    """Padding of blocked layouts of several block sizes."""
    e = expression(spark, d).select(F.explode(F.array(*(F.lit(s) for s in (4, 8, 16, 32)))).alias("size"), "cell_id", "gene_id")
    t = e.groupBy("size", F.floor(F.col("cell_id") / F.col("size")).alias("rb"), F.floor(F.col("gene_id") / F.col("size")).alias("cb")).agg(F.count("*").alias("nnz"))
    w = t.groupBy("size", "rb").agg(F.count("*").alias("width"), F.sum("nnz").alias("nnz"))
    return w.groupBy("size").agg(F.sum("nnz").alias("nnz"), F.sum("width").alias("occupied_blocks"), F.max("width").alias("ell_width"), (F.max("width") * F.count("*") * F.col("size") * F.col("size")).alias("padded_slots"))


_UPDATE = f"""{E}, n as (select cell_id, sum(value) as value from e group by 1), o as (select distinct cell_id, 10.0::double as value from cells where cell_id % 2 = 0)"""


def _updates(spark, d):
    new = expression(spark, d).groupBy("cell_id").agg(F.sum("value").alias("value"))
    return new, cells(spark, d).where("cell_id % 2 = 0").select("cell_id", F.lit(10.0).alias("value"))


@query("q140_output_updates", f"""{_UPDATE} select 'overwrite' as effect, cell_id, value from n
  union all select 'accumulate', cell_id, coalesce(n.value, 0) + coalesce(o.value, 0) from n full join o using (cell_id)
  union all select 'affine', cell_id, 2 * coalesce(n.value, 0) + 0.5 * coalesce(o.value, 0) from n full join o using (cell_id)
  union all select 'partial', cell_id, coalesce(n.value, o.value) from n full join o using (cell_id)""")
def q140(spark, d):
    """What the destination holds after each kind of update."""
    new, old = _updates(spark, d)
    out = None
    for effect in ("overwrite", "accumulate", "affine", "partial"):
        one = sparse.update_output(new, old, ["cell_id"], effect, 2.0, 0.5).select(F.lit(effect).alias("effect"), "cell_id", "value")
        out = one if out is None else out.unionAll(one)
    return out


@query("q141_order_transform", "with p as (select gene_id, row_number() over (order by feature_id desc, gene_id) - 1 as place from genes) select gene_id, place, place = (select count(*) - 1 from genes) - (row_number() over (order by feature_id, gene_id) - 1) as mirrored from p join genes using (gene_id)")
def q141(spark, d):
    """A permutation, and whether it mirrors the canonical order."""
    f = features(spark, d).select("gene_id", "feature_id")
    there = sparse.ranked(f, [F.desc("feature_id")], "place", "gene_id").select("gene_id", "place")
    back = sparse.ranked(f, [F.col("feature_id")], "canonical", "gene_id").select("gene_id", "canonical")
    n = f.agg((F.count("*") - 1).alias("_last"))
    return there.join(back, "gene_id").join(F.broadcast(n)).select("gene_id", "place", (F.col("place") == F.col("_last") - F.col("canonical")).alias("mirrored"))


@query("q142_value_map", f"{E} select cell_id, gene_id, row_number() over (order by cell_id, gene_id) - 1 as logical, row_number() over (order by gene_id, cell_id) - 1 as projected from e")
def q142(spark, d):
    """Places of the stored values in row-major and in column-major order."""
    e = expression(spark, d).select("cell_id", "gene_id")
    a = sparse.ranked(e, [F.col("cell_id")], "logical", "gene_id")
    b = sparse.ranked(e, [F.col("gene_id")], "projected", "cell_id")
    return a.join(b, ["cell_id", "gene_id"])


@query("q143_binding_check", "select gene_id, case when group_mask is null then 'unbound' when gene_id % 3 < 1 then 'stale' else 'current' end as state from genes")
def q143(spark, d):
    """Value rows by whether their generation is that of the structure."""
    generation = F.when(F.col("group_mask").isNotNull(), F.col("gene_id") % 3)
    state = F.when(generation.isNull(), "unbound").when(generation < 1, "stale").otherwise("current")
    return features(spark, d).select("gene_id", state.alias("state"))
