"""Quantisation, losses and sequences (23-28, 105, 117-128)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import expressions as ex
from ..operators import models, sequence
from ..sources.tables import CELLS, EXPRESSION, cells, expression, features, table
from .catalog import query

E = f"with {EXPRESSION}"
META = "sm as (select e.*, coalesce(case when gene_id % 4 = 0 then null else (1 + gene_id % 4) / 8.0::double end, 1.0) as scale, case when cell_id % 3 = 0 then 0.0 else 0.25::double end as off from e)"


def _meta(spark, d):
    scale = features(spark, d).where("gene_id % 4 <> 0").select("gene_id", ((1 + F.col("gene_id") % 4) / 8.0).alias("scale"))
    offset = cells(spark, d).where("cell_id % 3 <> 0").select("cell_id", F.lit(0.25).alias("offset"))
    return models.scale_metadata(expression(spark, d), scale, offset)


_CODE = "least(greatest(sign((value - off) / scale) * floor(abs((value - off) / scale) + 0.5), 0), 15)::int"


@query("q023_codes", f"{E}, {META} select cell_id, gene_id, {_CODE} as code from sm")
def q023(spark, d):
    """Four-bit codes, halves away from zero."""
    return models.quantized(_meta(spark, d), 4).select("cell_id", "gene_id", "code")


@query("q024_restored", f"{E}, {META} select cell_id, gene_id, {_CODE} * scale + off as restored from sm")
def q024(spark, d):
    """Values restored from codes."""
    return models.quantized(_meta(spark, d), 4).select("cell_id", "gene_id", "restored")


@query("q025_scale_metadata", f"{E}, {META} select cell_id, gene_id, scale, off as \"offset\" from sm")
def q025(spark, d):
    """Column scales and row offsets with their defaults."""
    return _meta(spark, d).select("cell_id", "gene_id", "scale", "offset")


_SLOTS = f"{E}, {META}, cs as (select cell_id, row_number() over (partition by cell_id order by gene_id) - 1 as slot, {_CODE} as code from sm)"


def _slots(spark, d):
    from pyspark.sql import Window

    w = Window.partitionBy("cell_id").orderBy("gene_id")
    return models.quantized(_meta(spark, d), 4).select("cell_id", (F.row_number().over(w) - 1).alias("slot"), "code")


@query("q026_packed", f"{_SLOTS} select cell_id, slot // 2 as byte, sum(code << ((slot % 2) * 4)::int)::int as packed from cs group by all")
def q026(spark, d):
    """Codes two to a byte."""
    return models.pack_codes(_slots(spark, d), "cell_id", "slot", 4)


@query("q026_unpacked", f"{_SLOTS} select cell_id, slot, code from cs union all select cell_id, max(slot) + 1, 0 from cs group by 1 having max(slot) % 2 = 0")
def q026b(spark, d):
    """Codes of every slot of the packed bytes, padding included."""
    return models.unpack_codes(models.pack_codes(_slots(spark, d), "cell_id", "slot", 4), "cell_id", 4)


@query("q027_epilogues", f"{E}, z as (select cell_id, gene_id, (value - 5) / 4.0::double as x from e) select cell_id, gene_id, greatest(x, 0) as relu, round(0.5 * x * (1 + tanh(0.7978845608028654 * (x + 0.044715 * x * x * x))), 6) + 0.0 as gelu_tanh, round(x / (1 + exp(-x)), 6) + 0.0 as silu from z")
def q027(spark, d):
    """Activations behind a bias."""
    x = (F.col("value") - 5) / 4.0
    return expression(spark, d).select("cell_id", "gene_id", ex.relu(x).alias("relu"), (F.round(ex.gelu_tanh(x), 6) + 0.0).alias("gelu_tanh"), (F.round(ex.silu(x), 6) + 0.0).alias("silu"))


# the error function by the same rational fit; tests compare it with the exact one
@query("q027_gelu", f"""{E}, z as (select value, (value - 5) / 4.0::double as x from (select distinct value from e)), y as (select value, x, abs(x) / sqrt(2) as z, 1 / (1 + 0.3275911::double * abs(x) / sqrt(2)) as t from z),
  r as (select value, x, 1 - ((((1.061405429::double * t - 1.453152027::double) * t + 1.421413741::double) * t - 0.284496736::double) * t + 0.254829592::double) * t * exp(-z * z) as erf from y)
  select cell_id, gene_id, round(0.5::double * x * (1 + sign(x) * erf), 5) + 0.0 as gelu from e join r using (value)""")
def q027b(spark, d):
    """GELU with the error function."""
    return expression(spark, d).select("cell_id", "gene_id", (F.round(ex.gelu((F.col("value") - 5) / 4.0), 5) + 0.0).alias("gelu"))


_TOP, _FLOOR, _RW, _GW, _LEAST = 15.0, 1e-3, 1.0, 0.5, 4.0
_F = "f as (select gene_id, (gene_id % 7 - 3) / 4.0::double as log_scale, (gene_id % 5 - 2) / 8.0::double as off from genes), fs as (select *, case when log_scale > 20 then log_scale else ln(1 + exp(log_scale)) end + 1e-3::double as s from f)"


def _sql_entry(v: str) -> tuple[str, str, str]:
    rel = f"(({v} - off) / s)"
    code = f"round_even(least(greatest({rel}, 0), 15), 0)"
    err = f"(off + {code} * s - {v})"
    act = f"({rel} > 0 and {rel} < 15)"
    return f"{err} * {err}", f"2 * {err} * (case when {act} then 0 else 1 end)", f"2 * {err} * ({code} - case when {act} then {rel} else 0 end)"


_Z, _V = _sql_entry("0.0::double"), _sql_entry("value")


@query("q105_quantization_loss", f"""{E}, {_F}, n as (select (select count(distinct cell_id) from cells) as nr, (select count(*) from genes) as nf),
  c as (select gene_id, sum({_V[0]} - {_Z[0]}) as ce, sum({_V[1]} - {_Z[1]}) as co, sum({_V[2]} - {_Z[2]}) as cg from e join fs using (gene_id) group by 1),
  x as (select fs.*, nr, nf, coalesce(ce, 0) as ce, coalesce(co, 0) as co, coalesce(cg, 0) as cg, {_Z[0]} as ze, {_Z[1]} as zo, {_Z[2]} as zg, greatest(4.0 - s * 15, 0) as short from fs left join c using (gene_id), n)
  select gene_id, round(1e6 * (nr * ze + ce) / (nr * nf), 5) + 0.0 as reconstruction, round(1e3 * (off * off + short * short) / nf, 6) + 0.0 as "range",
    round(1e6 * ((nr * zg + cg) / (nr * nf) - short * 15 / nf) / (1 + exp(-log_scale)), 4) + 0.0 as grad_log_scale, round(1e6 * ((nr * zo + co) / (nr * nf) + off / nf), 4) + 0.0 as grad_offset from x""")
def q105(spark, d):
    """Loss and gradients of per-feature affine quantisation (in millionths and thousandths)."""
    f = features(spark, d).select("gene_id", ((F.col("gene_id") % 7 - 3) / 4.0).alias("log_scale"), ((F.col("gene_id") % 5 - 2) / 8.0).alias("offset"))
    out = models.affine_quantize_loss(expression(spark, d), f, cells(spark, d).count(), _TOP, _FLOOR, _RW, _GW, _LEAST)
    r = lambda c, by, n: (F.round(by * F.col(c), n) + 0.0).alias(c)
    return out.select("gene_id", r("reconstruction", 1e6, 5), r("range", 1e3, 6), r("grad_log_scale", 1e6, 4), r("grad_offset", 1e6, 4))


_W = "w as (select gene_id, k, (((gene_id * (k + 2)) % 17) - 8) / 200.0::double as w from genes, (select unnest([0, 1, 2, 3]) as k))"
_H = f"{E}, {_W}, z as (select cell_id, k, sum(value * w) as z from e join w using (gene_id) group by all), h as (select cell_id, k, (z + 0.1 * k) / (1 + exp(-(z + 0.1 * k))) as h from z)"
_Y = "y as (select cell_id, sum(h * ([0.5, -0.25, 0.125, 1.0]::double[])[k + 1]) + 0.2 as predicted from h group by 1)"
_EDGE = "ed as (select sampled_position, g.src, g.dst, 1.0::double + g.src % 3 as weight from (select sampled_position, global_row as src, lead(global_row) over (order by sampled_position, staged_at, global_row) as dst from (select distinct sampled_position, staged_at, global_row from sampled_csr where global_row >= 0)) g where dst is not null and dst <> src)"


def _hidden(spark, d):
    w = features(spark, d).select("gene_id", F.explode(F.array(*(F.lit(k) for k in range(4)))).alias("k")).withColumn("w", (((F.col("gene_id") * (F.col("k") + 2)) % 17) - 8) / 200.0)
    return models.encode(expression(spark, d), w, [0.0, 0.1, 0.2, 0.3])


def _predicted(hidden):
    return models.head(hidden, [0.5, -0.25, 0.125, 1.0], 0.2)


def _edge_table(spark, d):
    """Edges between cells sampled one after another, from any cell to its successor in the sampled rows."""
    from ..operators.sparse import ranked

    rows = table(spark, d, "sampled_csr").where("global_row >= 0").select("sampled_position", "staged_at", "global_row").distinct()
    rows = ranked(rows, [F.col("sampled_position"), F.col("staged_at")], "_at", "global_row")
    nxt = rows.select((F.col("_at") - 1).alias("_at"), F.col("global_row").alias("dst"))
    e = rows.join(nxt, "_at").where("global_row <> dst")
    return e.select(F.col("global_row").alias("src"), "dst", (1.0 + F.col("global_row") % 3).alias("weight"))


@query("q117_encoder", f"{_H} select cell_id, k, round(h, 6) + 0.0 as h from h")
def q117(spark, d):
    """Sparse encoder with SiLU."""
    return _hidden(spark, d).withColumn("h", F.round("h", 6) + 0.0)


_W2 = "w2 as (select k, j, (((k + 1) * (j + 3)) % 7 - 3) / 4.0::double as w from range(4) a(k), range(3) b(j))"
_H2 = f"{_H}, {_W2}, z2 as (select cell_id, j, sum(h * w) + 0.05::double * any_value(j) as z from h join w2 using (k) group by 1, 2), h2 as (select cell_id, j as k, z / (1 + exp(-z)) as h from z2)"


def _second(spark, d):
    w = spark.createDataFrame([(k, j, ((k + 1) * (j + 3) % 7 - 3) / 4.0) for k in range(4) for j in range(3)], "k int, j int, w double")
    return models.dense_layer(_hidden(spark, d), w, [0.0, 0.05, 0.1])


@query("q117_dense_layer", f"{_H2} select cell_id, k, round(h, 6) + 0.0 as h from h2")
def q117c(spark, d):
    """The second layer of the time regressor: dense with SiLU."""
    return _second(spark, d).withColumn("h", F.round("h", 6) + 0.0)


@query("q117_forward", f"{_H2} select cell_id, round(sum(h * ([0.5, -0.25, 0.125]::double[])[k + 1]) + 0.2::double, 6) + 0.0 as predicted from h2 group by 1")
def q117d(spark, d):
    """Times predicted by all three layers: sparse encoder, dense layer, read-out."""
    return models.head(_second(spark, d), [0.5, -0.25, 0.125], 0.2).withColumn("predicted", F.round("predicted", 6) + 0.0)


@query("q117_time_loss", f"""with {CELLS}, {_H.removeprefix('with ')}, {_Y}, t as (select cell_id, "time" / 10 as t from c where "time" is not null), df as (select abs(predicted - t) as a from y join t using (cell_id))
  select round(avg(case when a <= 0.15 then 0.5 * a * a else 0.15 * (a - 0.075) end), 8) as loss, count(*) as n from df""")
def q117b(spark, d):
    """Huber loss of predicted times."""
    target = cells(spark, d).where("time is not null").select("cell_id", (F.col("time") / 10).alias("target"))
    return models.huber_loss(_predicted(_hidden(spark, d)), target, 0.15).withColumn("loss", F.round("loss", 8))


@query("q118_mixed_hidden", f"{_H}, {_EDGE}, m as (select dst as cell_id, k, sum(weight * h) / sum(weight) as m from ed join h on h.cell_id = src group by all) select cell_id, k, round(h + 0.5 * coalesce(m, 0), 6) + 0.0 as h from h left join m using (cell_id, k)")
def q118(spark, d):
    """Hidden states mixed with those of graph neighbours."""
    return models.mix_neighbors(_hidden(spark, d), _edge_table(spark, d), 0.5).withColumn("h", F.round("h", 6) + 0.0)


@query("q118_edge_losses", f"""{_H}, {_Y}, {_EDGE}, x as (select weight, b.predicted - a.predicted as gap from ed join y a on a.cell_id = src join y b on b.cell_id = dst)
  select round(avg(weight * gap * gap), 6) as smoothness, round(avg(weight * greatest(0.05 - gap, 0) * greatest(0.05 - gap, 0)), 6) as "order", count(*) as n from x""")
def q118b(spark, d):
    """Smoothness and order losses over edges."""
    e = models.edge_losses(_predicted(_hidden(spark, d)), _edge_table(spark, d), 0.05)
    return e.withColumns({"smoothness": F.round("smoothness", 6), "order": F.round("order", 6)})


@query("q119_reconstruction_loss", f"""{E}, p as (select cell_id, gene_id, value * 0.75 + (gene_id % 3) * 0.5 as predicted from e where gene_id % 2 = 0)
  select round((select sum(0.1::double * predicted * predicted) from p) + (select sum(2.0::double * (coalesce(predicted, 0) - value) * (coalesce(predicted, 0) - value) - 0.1::double * coalesce(predicted, 0) * coalesce(predicted, 0)) from e left join p using (cell_id, gene_id)), 3) as loss""")
def q119(spark, d):
    """Weighted reconstruction loss of stored and absent entries."""
    p = expression(spark, d).where("gene_id % 2 = 0").select("cell_id", "gene_id", (F.col("value") * 0.75 + (F.col("gene_id") % 3) * 0.5).alias("predicted"))
    return models.reconstruction_loss(expression(spark, d), p, 2.0, 0.1).withColumn("loss", F.round("loss", 3))


_FACTORS = "f as (select gene_id, k, ((gene_id * (k + 3)) % 11 - 5) / 50.0::double as w from genes, range(4) t(k))"


@query("q119_factor_loss", f"""{_H}, {_FACTORS}, lv as (select cell_id, list(h order by k) as hv from h group by 1), fv as (select gene_id, list(w order by k) as wv from f group by 1),
  p as (select cell_id, gene_id, list_inner_product(hv, wv) as p from lv, fv)
  select round(sum(case when value is null then 0.1::double * p * p else 2.0::double * (p - value) * (p - value) end), 2) as loss from p left join e using (cell_id, gene_id)""")
def q119b(spark, d):
    """Reconstruction loss of a factor decoder over all cells and genes."""
    f = features(spark, d).select("gene_id", F.explode(F.array(*(F.lit(k) for k in range(4)))).alias("k")).withColumn("w", ((F.col("gene_id") * (F.col("k") + 3)) % 11 - 5) / 50.0)
    return models.factor_loss(expression(spark, d), _hidden(spark, d), f, 2.0, 0.1).withColumn("loss", F.round("loss", 2))


@query("q119_smoothness", f"{_H}, {_EDGE}, n as (select row_number() over () as i, src, dst, weight from ed), x as (select i, sum(weight * (a.h - b.h) * (a.h - b.h)) as d from n join h a on a.cell_id = src join h b on b.cell_id = dst and a.k = b.k group by 1) select round(0.5::double * avg(d), 6) as loss, count(*) as n from x")
def q119c(spark, d):
    """Smoothness of the latent rows over edges."""
    return models.latent_smoothness(_hidden(spark, d), _edge_table(spark, d), 0.5).withColumn("loss", F.round("loss", 6))


@query("q121_bucket_losses", f"""with {CELLS}, b as (select floor("time")::int - 6 as b, count(*) as n, avg(x) as mean, sqrt(greatest(avg(x * x) - avg(x) * avg(x), 0) + 1e-8) as std from (select "time", (cell_id % 97) / 97.0::double as x from c where "time" is not null) group by 1),
  r as (select 0.1 - (mean - lag(mean) over (order by b)) as p from b)
  select round(avg((mean - b / 7.0::double) * (mean - b / 7.0::double)), 8) as anchor, round(avg(case when n > 1 and std < 0.3 then 0.3 - std else 0 end), 8) as spread, (select round(coalesce(avg(p) filter (where p > 0), 0), 8) from r) as ranking from b""")
def q121(spark, d):
    """Anchor, spread and ranking losses over time buckets."""
    c = cells(spark, d).where("time is not null").select((F.floor("time") - 6).cast("int").alias("b"), ((F.col("cell_id") % 97) / 97.0).alias("x"))
    return models.bucket_losses(c, "b", "x", 8, 0.3, 0.1).select(*(F.round(c_, 8).alias(c_) for c_ in ("anchor", "spread", "ranking")))


@query("q122_future_target", f"{E}, {_EDGE}, q as (select src as query, dst as neighbor, sum(weight) as weight from ed group by all) select query, gene_id, sum(weight * value) as target from q join e on e.cell_id = neighbor group by all")
def q122(spark, d):
    """Weighted values of later neighbours."""
    n = _edge_table(spark, d).groupBy(F.col("src").alias("query"), F.col("dst").alias("neighbor")).agg(F.sum("weight").alias("weight"))
    return models.future_target(n, expression(spark, d))


@query("q123_quantizer", f"{E}, {META} select round(avg(({_CODE} * scale + off - value) * ({_CODE} * scale + off - value)), 8) as error, max({_CODE}) as top_code from sm")
def q123(spark, d):
    """Error of the gene quantiser."""
    return models.quantized(_meta(spark, d), 4).agg(F.round(F.avg((F.col("restored") - F.col("value")) * (F.col("restored") - F.col("value"))), 8).alias("error"), F.max("code").alias("top_code"))


MOTIF = "TGAC"
_SEQ = "sq as (select distinct stable_id, regexp_extract(stable_id, '_([A-Z0-9]+)-', 1) as s from cells where stable_id is not null)"
_MISS = " + ".join(f"(substr(w, {i + 1}, 1) <> '{b}')::int" for i, b in enumerate(MOTIF))
_HITS = f"""{_SEQ}, wd as (select stable_id, position, substr(s, position + 1, 4) as w from (select stable_id, s, unnest(range(0, length(s) - 3))::int as position from sq where length(s) >= 4)),
  ht as (select stable_id, position, 0 as predicate_id, {_MISS} as mismatches from wd where not regexp_matches(w, '[^ACGT]') and {_MISS} <= 1)"""
_INTERVALS = "iv as (select * from (values (0, 4, 100, 0), (4, 9, 101, 0), (10, 14, 102, 0), (0, 16, 103, 1)) t(b, e, element, predicate_id)), eg as (select 100 + gene_id % 4 as element, gene_id as gene, (1 + gene_id % 3)::double as weight from genes where gene_id % 100 = 0)"


def _hits(spark, d):
    s = table(spark, d, "cells").where("stable_id is not null").select("stable_id", F.regexp_extract("stable_id", "_([A-Z0-9]+)-", 1).alias("s")).distinct()
    return sequence.motif_hits(s, "stable_id", "s", MOTIF, 1)


def _projection(spark, d):
    intervals = spark.createDataFrame([(0, 4, 100, 0), (4, 9, 101, 0), (10, 14, 102, 0), (0, 16, 103, 1)], "begin int, end int, element long, predicate_id int")
    links = features(spark, d).where("gene_id % 100 = 0").select((100 + F.col("gene_id") % 4).alias("element"), F.col("gene_id").alias("gene"), (1.0 + F.col("gene_id") % 3).alias("weight"))
    return intervals, links


@query("q028_motif_hits", f"with {_HITS} select * from ht")
def q028(spark, d):
    """Barcode positions where a motif fits with at most one mismatch."""
    return _hits(spark, d)


@query("q044_located_hits", f"with {_HITS}, {_INTERVALS} select stable_id, position, element from ht join iv using (predicate_id) where position >= b and position < e")
def q044(spark, d):
    """Hits in the interval that holds them."""
    from ..operators.neighbors import locate

    return locate(_hits(spark, d), _projection(spark, d)[0]).select("stable_id", "position", "element")


@query("q125_predicate_mask", f"with {_HITS} select position, count(*) as n from ht group by 1")
def q125(spark, d):
    """The materialised predicate, by position."""
    return _hits(spark, d).groupBy("position").agg(F.count("*").alias("n"))


@query("q126_gene_state", f"with {_HITS}, {_INTERVALS} select gene, sum(weight) as weight, count(*) as hits from ht join iv using (predicate_id) join eg using (element) where position >= b and position < e group by 1")
def q126(spark, d):
    """Hits accumulated over the genes that elements act on."""
    return sequence.gene_state(_hits(spark, d), *_projection(spark, d))


@query("q127_strategy", "select * from (values (0, 'fuse'), (1, 'fuse'), (2, 'materialize'), (9, 'materialize')) t(uses, strategy)")
def q127(spark, d):
    """Whether a mask is stored or fused."""
    return spark.createDataFrame([(n, sequence.strategy(n)) for n in (0, 1, 2, 9)], "uses int, strategy string")


@query("q128_projection", f"with {_INTERVALS} select (select count(*) from iv) * 16 + (select count(*) from eg) * 12 as bytes, true as valid")
def q128(spark, d):
    """A validated projection and its bytes."""
    intervals, links = _projection(spark, d)
    sequence.validate_intervals(intervals)
    return spark.createDataFrame([(sequence.projection_bytes(intervals.count(), links.count()), True)], "bytes long, valid boolean")
