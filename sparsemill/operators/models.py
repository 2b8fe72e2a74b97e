"""Quantisation and losses of the small models, as joins, expressions and sums.

The forward passes and losses are distributed; a model's few weights are trained on the driver from a bounded sample.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expressions import dequantize, huber, quantize_code, sigmoid, silu, softplus


def scale_metadata(entries: DataFrame, col_scale: DataFrame, row_offset: DataFrame, row: str = "cell_id", col: str = "gene_id") -> DataFrame:
    """entries with scale of the column (default 1) and offset of the row (default 0)."""
    out = entries.join(col_scale.select(col, F.col("scale").alias("_s")), col, "left").join(row_offset.select(row, F.col("offset").alias("_o")), row, "left")
    return out.withColumns({"scale": F.coalesce("_s", F.lit(1.0)), "offset": F.coalesce("_o", F.lit(0.0))}).drop("_s", "_o")


def quantized(entries: DataFrame, bits: int) -> DataFrame:
    """entries (value, scale, offset) with code and restored."""
    out = entries.withColumn("code", quantize_code(F.col("value"), F.col("scale"), F.col("offset"), bits))
    return out.withColumn("restored", dequantize(F.col("code"), F.col("scale"), F.col("offset")))


def pack_codes(codes: DataFrame, row: str, slot: str, bits: int) -> DataFrame:
    """(row, byte, packed): codes of 1, 2, 4 or 8 bits, the lowest slot in the lowest bits."""
    if bits not in (1, 2, 4, 8):
        raise ValueError(f"{bits} bits do not fill a byte")
    per = 8 // bits
    shifted = F.expr(f"shiftleft(cast(code as int), cast(pmod(`{slot}`, {per}) * {bits} as int))")
    return codes.groupBy(row, F.floor(F.col(slot) / per).alias("byte")).agg(F.bit_or(shifted).alias("packed"))


def unpack_codes(packed: DataFrame, row: str, bits: int) -> DataFrame:
    """(row, slot, code) of every slot of every byte."""
    per = 8 // bits
    out = packed.select(row, "byte", "packed", F.explode(F.array(*(F.lit(i) for i in range(per)))).alias("_i"))
    code = F.expr(f"shiftrightunsigned(packed, _i * {bits}) & {2**bits - 1}")
    return out.select(row, (F.col("byte") * per + F.col("_i")).alias("slot"), code.alias("code"))


def _entry(value: Column, scale: Column, offset: Column, top: float) -> tuple[Column, Column, Column]:
    relaxed = (value - offset) / scale
    code = F.rint(F.least(F.greatest(relaxed, F.lit(0.0)), F.lit(top)))  # halves to even
    error = offset + code * scale - value
    active = (relaxed > 0) & (relaxed < top)
    return error * error, 2 * error * F.when(active, 0.0).otherwise(1.0), 2 * error * (code - F.when(active, relaxed).otherwise(0.0))


def affine_quantize_loss(entries: DataFrame, features: DataFrame, rows: int, top: float, floor: float, reconstruction_weight: float, range_weight: float, least_range: float, col: str = "gene_id") -> DataFrame:
    """(col, reconstruction, range, grad_log_scale, grad_offset) of features (col, log_scale, offset).

    Every cell counts as zero first; each stored value then corrects its own share.
    """
    n = features.count()
    f = features.withColumn("_s", softplus(F.col("log_scale")) + floor)
    zero = _entry(F.lit(0.0), F.col("_s"), F.col("offset"), top)
    each = entries.join(f, col)
    own = _entry(F.col("value"), F.col("_s"), F.col("offset"), top)
    fix = each.groupBy(col).agg(*(F.sum(a - b).alias(c) for a, b, c in zip(own, zero, ("_e", "_o", "_g"))))
    out = f.join(fix, col, "left").na.fill(0.0, ["_e", "_o", "_g"])
    cells = float(rows) * n
    span = least_range - F.col("_s") * top
    short = F.when(span > 0, span).otherwise(0.0)
    grad_scale = (rows * zero[2] + F.col("_g")) / cells * reconstruction_weight - 2 * short * top / n * range_weight
    return out.select(
        col, ((rows * zero[0] + F.col("_e")) / cells).alias("reconstruction"), ((F.col("offset") * F.col("offset") + short * short) / n).alias("range"),
        (grad_scale * sigmoid(F.col("log_scale"))).alias("grad_log_scale"), ((rows * zero[1] + F.col("_o")) / cells * reconstruction_weight + 2 * F.col("offset") / n * range_weight).alias("grad_offset"),
    )


def encode(entries: DataFrame, weights: DataFrame, bias: list[float], row: str = "cell_id", col: str = "gene_id") -> DataFrame:
    """(row, k, h): SiLU of the sparse rows times weights (col, k, w) plus bias."""
    b = F.element_at(F.array(*(F.lit(float(x)) for x in bias)), F.col("k") + 1)
    return entries.join(weights, col).groupBy(row, "k").agg(F.sum(F.col("value") * F.col("w")).alias("_z")).select(row, "k", silu(F.col("_z") + b).alias("h"))


def dense_layer(hidden: DataFrame, weights: DataFrame, bias: list[float], row: str = "cell_id") -> DataFrame:
    """(row, k, h): SiLU of the rows (row, k, h) times weights (k, j, w) plus the bias of j, which becomes the new k."""
    b = F.element_at(F.array(*(F.lit(float(x)) for x in bias)), F.col("j") + 1)
    z = hidden.join(weights.select("k", "j", "w"), "k").groupBy(row, "j").agg(F.sum(F.col("h") * F.col("w")).alias("_z"))
    return z.select(row, F.col("j").alias("k"), silu(F.col("_z") + b).alias("h"))


def head(hidden: DataFrame, weights: list[float], bias: float, row: str = "cell_id") -> DataFrame:
    """(row, predicted): a linear read-out."""
    w = F.element_at(F.array(*(F.lit(float(x)) for x in weights)), F.col("k") + 1)
    return hidden.groupBy(row).agg((F.sum(F.col("h") * w) + bias).alias("predicted"))


def huber_loss(predicted: DataFrame, target: DataFrame, delta: float, row: str = "cell_id") -> DataFrame:
    """One row: mean loss and rows."""
    return predicted.join(target, row).agg(F.avg(huber(F.col("predicted") - F.col("target"), delta)).alias("loss"), F.count("*").alias("n"))


def mix_neighbors(hidden: DataFrame, edges: DataFrame, mix: float, row: str = "cell_id") -> DataFrame:
    """(row, k, h): h + mix * the weighted mean of the sources of its in-edges; edges (src, dst, weight)."""
    src = hidden.select(F.col(row).alias("src"), "k", F.col("h").alias("_h"))
    mean = edges.join(src, "src").groupBy(F.col("dst").alias(row), "k").agg((F.sum(F.col("weight") * F.col("_h")) / F.nullif(F.sum("weight"), F.lit(0.0))).alias("_m"))
    return hidden.join(mean, [row, "k"], "left").select(row, "k", (F.col("h") + mix * F.coalesce("_m", F.lit(0.0))).alias("h"))


def edge_losses(predicted: DataFrame, edges: DataFrame, margin: float, row: str = "cell_id") -> DataFrame:
    """One row: mean over edges of weight * difference squared, and of the squared shortfall of the order margin."""
    a, b = predicted.select(F.col(row).alias("src"), F.col("predicted").alias("_a")), predicted.select(F.col(row).alias("dst"), F.col("predicted").alias("_b"))
    e, gap = edges.join(a, "src").join(b, "dst"), F.col("_b") - F.col("_a")
    short = F.greatest(margin - gap, F.lit(0.0))
    return e.agg(F.avg(F.col("weight") * gap * gap).alias("smoothness"), F.avg(F.col("weight") * short * short).alias("order"), F.count("*").alias("n"))


def reconstruction_loss(entries: DataFrame, reconstruction: DataFrame, positive: float, baseline: float, row: str = "cell_id", col: str = "gene_id") -> DataFrame:
    """One row: baseline * prediction^2 everywhere, replaced by positive * (prediction - value)^2 where a value is stored.

    reconstruction (row, col, predicted) lists the predicted cells; others are 0.
    """
    every = reconstruction.agg(F.sum(baseline * F.col("predicted") * F.col("predicted")).alias("_z"))
    p = F.coalesce("predicted", F.lit(0.0))
    fix = entries.join(reconstruction, [row, col], "left").agg(F.sum(positive * (p - F.col("value")) * (p - F.col("value")) - baseline * p * p).alias("_c"))
    return every.join(F.broadcast(fix)).select((F.coalesce("_z", F.lit(0.0)) + F.coalesce("_c", F.lit(0.0))).alias("loss"))


def factor_loss(entries: DataFrame, latent: DataFrame, factors: DataFrame, positive: float, baseline: float, row: str = "cell_id", col: str = "gene_id") -> DataFrame:
    """One row: ``reconstruction_loss`` of the product of latent (row, k, h) and factors (col, k, w), which is never made.

    The sum of all squared predictions is that of latent' G latent over rows, where G holds the inner products of the
    factors, k by k numbers; predictions themselves are needed at stored entries only.
    """
    f = factors.select(col, "k", "w")
    gram = f.join(f.select(col, F.col("k").alias("_k"), F.col("w").alias("_w")), col).groupBy("k", "_k").agg(F.sum(F.col("w") * F.col("_w")).alias("_g"))
    other = latent.select(row, F.col("k").alias("_k"), F.col("h").alias("_h"))
    every = latent.select(row, "k", "h").join(gram, "k").join(other, [row, "_k"]).agg((baseline * F.sum(F.col("h") * F.col("_g") * F.col("_h"))).alias("_z"))
    vectors = lambda df, key, value: df.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("k", value))).alias(f"_{value}"))  # noqa: E731 - k numbers each
    e = entries.join(vectors(latent, row, "h"), row, "left").join(vectors(f, col, "w"), col, "left")
    terms = F.transform(F.coalesce(F.map_keys("_h"), F.array().cast("array<int>")), lambda k: F.try_element_at("_h", k) * F.coalesce(F.try_element_at("_w", k), F.lit(0.0)))
    p = F.coalesce(F.aggregate(terms, F.lit(0.0), lambda a, x: a + x), F.lit(0.0))
    fix = e.select("value", p.alias("p")).agg(F.sum(positive * (F.col("p") - F.col("value")) * (F.col("p") - F.col("value")) - baseline * F.col("p") * F.col("p")).alias("_c"))
    return every.join(F.broadcast(fix)).select((F.coalesce("_z", F.lit(0.0)) + F.coalesce("_c", F.lit(0.0))).alias("loss"))


def latent_smoothness(latent: DataFrame, edges: DataFrame, scale: float = 1.0, row: str = "cell_id") -> DataFrame:
    """One row: scale times the mean over edges (src, dst, weight) of weight * squared distance of the two latent rows (row, k, h)."""
    a, b = latent.select(F.col(row).alias("src"), "k", F.col("h").alias("_a")), latent.select(F.col(row).alias("dst"), "k", F.col("h").alias("_b"))
    e = edges.select("src", "dst", "weight").withColumn("_e", F.monotonically_increasing_id())
    d = e.join(a, "src").join(b, ["dst", "k"]).groupBy("_e").agg(F.sum(F.col("weight") * (F.col("_a") - F.col("_b")) * (F.col("_a") - F.col("_b"))).alias("_d"))
    return d.agg((scale * F.avg("_d")).alias("loss"), F.count("*").alias("n"))


def pair_losses(pairs: DataFrame, local_window: float, far_window: float, margin: float) -> DataFrame:
    """One row: mean squared distance of pairs near in time, mean hinge of those far apart; pairs (dt, sim)."""
    sq = F.greatest(2 - 2 * F.col("sim"), F.lit(0.0))
    far = F.greatest(margin - F.sqrt(sq + 1e-12), F.lit(0.0))
    near, apart = F.col("dt") <= local_window, F.col("dt") >= far_window
    return pairs.agg(F.avg(F.when(near, sq)).alias("local"), F.count_if(near).alias("n_local"), F.avg(F.when(apart, far)).alias("far"), F.count_if(apart).alias("n_far"))


def window_pair_losses(records: DataFrame, low: float, high: float, local_window: float, far_window: float, margin: float) -> DataFrame:
    """``pair_losses`` of every record and those of its future window: blocks of both are multiplied and summed where they meet, so
    that pairs are never rows."""
    from .neighbors import window_blocks

    def fold(q, i):
        import pyarrow as pa

        got = np.zeros(4)
        if q.num_rows and i.num_rows:
            (qc, qe, qt, qx), (ic, ie, it, ix) = (
                (t.column("cell").to_numpy(), t.column("embryo").to_numpy(), t.column("time").to_numpy(), t.column("latent").combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(t.num_rows, -1)) for t in (q, i)
            )
            for a in range(0, len(qc), 512):
                b = slice(a, a + 512)
                dt = it - qt[b][:, None]
                ok = (it > (qt[b] + low)[:, None]) & (it <= (qt[b] + high)[:, None]) & ((qe[b] < 0)[:, None] | (qe[b][:, None] == ie)) & (qc[b][:, None] != ic)
                sq = np.maximum(2 - 2 * np.round(qx[b] @ ix.T, 6), 0)
                near, apart = ok & (dt <= local_window), ok & (dt >= far_window)
                got += [sq[near].sum(), near.sum(), np.maximum(margin - np.sqrt(sq[apart] + 1e-12), 0).sum(), apart.sum()]
        return pa.table({"l": [got[0]], "n_l": [int(got[1])], "f": [got[2]], "n_f": [int(got[3])]})

    q, i, keys = window_blocks(records, records, low, high)
    s = q.groupBy(*keys).cogroup(i.groupBy(*keys)).applyInArrow(fold, "l double, n_l long, f double, n_f long").agg(*(F.sum(c).alias(c) for c in ("l", "n_l", "f", "n_f")))
    count = lambda c: F.coalesce(c, F.lit(0))
    return s.select((F.col("l") / F.nullif("n_l", F.lit(0))).alias("local"), count("n_l").alias("n_local"), (F.col("f") / F.nullif("n_f", F.lit(0))).alias("far"), count("n_f").alias("n_far"))


def bucket_losses(rows: DataFrame, bucket: str, value: str, buckets: int, least_std: float, margin: float, adjacent: bool = True) -> DataFrame:
    """One row: anchor, spread and ranking losses of bucket means.

    Buckets are few, so after one aggregation a single task orders them.
    """
    v = F.col(value)
    b = rows.groupBy(F.col(bucket).alias("b")).agg(F.count("*").alias("n"), F.avg(value).alias("mean"), F.greatest(F.avg(v * v) - F.avg(v) * F.avg(v), F.lit(0.0)).alias("var"))
    b = b.withColumn("std", F.sqrt(F.col("var") + 1e-8))
    anchor = F.col("b") / F.lit(float(buckets - 1)) if buckets > 1 else F.lit(0.5)
    spread = F.when((F.col("n") > 1) & (F.col("std") < least_std), least_std - F.col("std")).otherwise(0.0)
    one = b.agg(F.avg((F.col("mean") - anchor) * (F.col("mean") - anchor)).alias("anchor"), F.avg(spread).alias("spread"))
    if adjacent:
        p = b.withColumn("_p", margin - (F.col("mean") - F.lag("mean").over(Window.orderBy("b"))))
    else:
        o = b.select(F.col("b").alias("_b"), F.col("mean").alias("_m"))
        p = b.join(o, F.col("_b") > F.col("b")).withColumn("_p", margin - (F.col("_m") - F.col("mean")))
    rank = p.agg(F.coalesce(F.avg(F.when(F.col("_p") > 0, F.col("_p"))), F.lit(0.0)).alias("ranking"))
    return one.join(F.broadcast(rank))


def future_target(neighbors: DataFrame, entries: DataFrame, row: str = "cell_id", col: str = "gene_id") -> DataFrame:
    """(query, col, target): weighted sum of the neighbours' values; neighbors (query, neighbor, weight)."""
    n = neighbors.where((F.col("neighbor") >= 0) & (F.col("weight") != 0)).withColumnRenamed("neighbor", row)
    return n.join(entries, row).groupBy("query", col).agg(F.sum(F.col("weight") * F.col("value")).alias("target"))


def train_regressor(sample: np.ndarray, target: np.ndarray, rounds: int = 300, rate: float = 0.01, decay: float = 1e-4, delta: float = 0.15, seed: int = 3, hidden: int = 16) -> dict[str, np.ndarray]:
    """SiLU network of one hidden layer with Huber loss by AdamW, on a bounded dense sample held by the driver."""
    rng = np.random.default_rng(seed)
    w = {"w1": rng.normal(0, 1 / np.sqrt(sample.shape[1]), (sample.shape[1], hidden)), "b1": np.zeros(hidden), "w2": rng.normal(0, 1 / np.sqrt(hidden), hidden), "b2": np.array(float(target.mean()))}
    m, v = ({k: np.zeros_like(x) for k, x in w.items()} for _ in range(2))
    for step in range(1, rounds + 1):
        z = sample @ w["w1"] + w["b1"]
        s = 1 / (1 + np.exp(-z))
        h = z * s
        g = np.clip(h @ w["w2"] + w["b2"] - target, -delta, delta) / len(target)
        dz = np.outer(g, w["w2"]) * (s + z * s * (1 - s))
        grads = {"w1": sample.T @ dz, "b1": dz.sum(0), "w2": h.T @ g, "b2": g.sum()}
        for k in w:
            m[k], v[k] = 0.9 * m[k] + 0.1 * grads[k], 0.999 * v[k] + 0.001 * grads[k] ** 2
            w[k] = w[k] * (1 - rate * decay) - rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
    return w


def predict_regressor(w: dict[str, np.ndarray], x: np.ndarray) -> np.ndarray:
    z = x @ w["w1"] + w["b1"]
    return z / (1 + np.exp(-z)) @ w["w2"] + w["b2"]
