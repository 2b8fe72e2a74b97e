"""Sparse linear algebra over long tables: an absent row is a structural zero."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.lineage import cut


def row_scale(entries: DataFrame, scales: DataFrame, row: str = "cell_id", value: str = "value", scale: str = "scale") -> DataFrame:
    """value * scale of the entry's row; rows without a scale drop out."""
    return entries.join(scales.select(row, scale), row).withColumn(value, F.col(value) * F.col(scale)).drop(scale)


def row_scale_backward(grads: DataFrame, entries: DataFrame, scales: DataFrame, row: str = "cell_id", col: str = "gene_id") -> tuple[DataFrame, DataFrame]:
    """(d value = g * scale by entry, d scale = sum over the row of value * g); grads (row, col, g)."""
    d_values = grads.join(scales, row).select(row, col, (F.col("g") * F.col("scale")).alias("d_value"))
    d_scales = grads.join(entries, [row, col]).groupBy(row).agg(F.sum(F.col("value") * F.col("g")).alias("d_scale"))
    return d_values, d_scales


def gather_rows(entries: DataFrame, wanted: DataFrame, row: str = "cell_id") -> DataFrame:
    """entries of the wanted (pos, row), in the requested order by ``pos``; a row wanted twice comes twice."""
    return wanted.select("pos", row).join(entries, row)


def append_rows(top: DataFrame, bottom: DataFrame, n_top: int, row: str) -> DataFrame:
    """bottom below top, its row numbers shifted by the number of rows above."""
    return top.unionByName(bottom.withColumn(row, F.col(row) + n_top))


def transpose(entries: DataFrame, row: str, col: str) -> DataFrame:
    return entries.select(*(F.col(col if c == row else row if c == col else c).alias(c) for c in entries.columns))


def compress(entries: DataFrame, major: str, minor: str, value: str = "value") -> DataFrame:
    """(major, indices, data): the entries of each major index in the order of the minor one; duplicates stay.

    A major index is one row, so its entries must fit one: use the sparse form for unbounded ones.
    """
    e = F.sort_array(F.collect_list(F.struct(F.col(minor).alias("i"), F.col(value).alias("v"))))
    return entries.groupBy(major).agg(e.alias("e")).select(major, F.col("e.i").alias("indices"), F.col("e.v").alias("data"))


def spmv(entries: DataFrame, x: DataFrame, row: str, col: str, out: str = "y") -> DataFrame:
    """y[row] = sum value * x; x (col, x). Partial sums form before the shuffle."""
    return entries.join(x, col).groupBy(row).agg(F.sum(F.col("value") * F.col("x")).alias(out))


def spmv_backward(entries: DataFrame, x: DataFrame, g: DataFrame, row: str, col: str) -> tuple[DataFrame, DataFrame]:
    """(d value = g[row] x[col] by entry, d x = A' g); g (row, g)."""
    d_values = entries.join(g, row).join(x, col).select(row, col, (F.col("g") * F.col("x")).alias("d_value"))
    return d_values, entries.join(g, row).groupBy(col).agg(F.sum(F.col("value") * F.col("g")).alias("d_x"))


def spmm(entries: DataFrame, b: DataFrame, row: str, inner: str, out: str = "c") -> DataFrame:
    """C[row, k] = sum over inner of value * b; b (inner, k, b) is itself long, so either side may be sparse."""
    return entries.join(b, inner).groupBy(row, "k").agg(F.sum(F.col("value") * F.col("b")).alias(out))


def spmm_general(entries: DataFrame, b: DataFrame, row: str, inner: str, alpha: float = 1.0, beta: float = 0.0, c: DataFrame | None = None, epilogue=None, transpose_a: bool = False) -> DataFrame:
    """epilogue(alpha * A B + beta * C); with transpose_a, A' B. Where A B has no entry but C has, beta * C remains."""
    a = transpose(entries, row, inner) if transpose_a else entries
    out = spmm(a, b, row, inner, "_ab")
    if c is not None and beta:
        out = out.join(c.select(row, "k", F.col("c").alias("_c")), [row, "k"], "full")
        value = alpha * F.coalesce("_ab", F.lit(0.0)) + beta * F.coalesce("_c", F.lit(0.0))
    else:
        value = alpha * F.col("_ab")
    return out.select(row, "k", (epilogue(value) if epilogue else value).alias("c"))


def spmm_backward(entries: DataFrame, b: DataFrame, g: DataFrame, row: str, inner: str) -> tuple[DataFrame, DataFrame]:
    """(d value: dot of the row of g and the row of b by entry, d b = A' g); g (row, k, g)."""
    d_values = entries.select(row, inner).join(b, inner).join(g, [row, "k"]).groupBy(row, inner).agg(F.sum(F.col("b") * F.col("g")).alias("d_value"))
    return d_values, entries.join(g, row).groupBy(inner, "k").agg(F.sum(F.col("value") * F.col("g")).alias("d_b"))


def trivial_operation(rows: int, cols: int, inner: int, alpha: float, beta: float) -> str:
    """'no_output', 'epilogue_only' or 'none': what a product degenerates to."""
    if rows == 0 or cols == 0:
        return "no_output"
    if inner == 0 or alpha == 0.0:
        return "epilogue_only"
    return "none"


def feature_weighted_reduction(entries: DataFrame, weights: DataFrame, row: str = "cell_id", col: str = "gene_id") -> DataFrame:
    """y[row] = sum value * weight of the feature; features without weight count nothing."""
    return entries.join(weights, col).groupBy(row).agg(F.sum(F.col("value") * F.col("weight")).alias("y"))


def close(value: Column, reference: Column, abs_tol: float, rel_tol: float) -> Column:
    """|value - reference| <= abs_tol + rel_tol * |reference|; NaN is close to nothing."""
    ok = F.abs(value - reference) <= abs_tol + rel_tol * F.abs(reference)
    return F.when(F.isnan(value) | F.isnan(reference), F.lit(False)).otherwise(F.coalesce(ok, F.lit(False)))


def ranked(df: DataFrame, order: list, out: str, key: str) -> DataFrame:
    """df with ``out``, the place (from 0) of each row in a global order, without one task holding all rows.

    Rows are range-partitioned by the order and sorted there; each partition numbers its own, from the count of those
    before it. The numbered rows are checkpointed, since a second evaluation could draw other partition bounds. ``key``
    ends the order, so that it is total.
    """
    rows = df.repartitionByRange(*order, key).sortWithinPartitions(*order, key).withColumn("_rank_m", F.monotonically_increasing_id())
    rows = cut(rows)
    part, place = F.shiftright("_rank_m", 33), F.col("_rank_m").bitwiseAND(F.lit((1 << 33) - 1))  # the layout of that id
    counts = rows.groupBy(part.alias("_rank_p")).agg(F.count("*").alias("_rank_n"))  # one row a partition
    before = counts.select("_rank_p", (F.sum("_rank_n").over(Window.orderBy("_rank_p")) - F.col("_rank_n")).alias("_rank_before"))
    return rows.withColumn("_rank_p", part).join(F.broadcast(before), "_rank_p").withColumn(out, F.col("_rank_before") + place).drop("_rank_p", "_rank_m", "_rank_before")


def running_total(df: DataFrame, order: list, value: str, out: str, key: str) -> DataFrame:
    """df with ``out``, the sum of ``value`` up to and with each row in a global order; ``key`` ends the order.

    As in ``ranked`` each range partition sums its own rows, on top of the sum of those before it.
    """
    rows = df.repartitionByRange(*order, key).sortWithinPartitions(*order, key).withColumn("_sum_m", F.monotonically_increasing_id())
    rows = cut(rows).withColumn("_sum_p", F.shiftright("_sum_m", 33))
    sums = rows.groupBy("_sum_p").agg(F.sum(value).alias("_sum_n"))  # one row a partition
    before = sums.select("_sum_p", (F.sum("_sum_n").over(Window.orderBy("_sum_p")) - F.col("_sum_n")).alias("_sum_before"))
    own = rows.withColumn("_sum_own", F.sum(value).over(Window.partitionBy("_sum_p").orderBy("_sum_m")))
    return own.join(F.broadcast(before), "_sum_p").withColumn(out, F.col("_sum_before") + F.col("_sum_own")).drop("_sum_p", "_sum_m", "_sum_own", "_sum_before")


def ranked_within(df: DataFrame, group: str, order: list, out: str, key: str) -> DataFrame:
    """df with ``out``, the place (from 0) of each row within its group: global places, less the first one of the group, so that
    a group may hold any share of the rows. As many groups as there are come together in one small table by key."""
    rows = ranked(df, [F.col(group), *order], "_place", key)
    first = rows.groupBy(F.col(group).alias("_group")).agg(F.min("_place").alias("_first"))
    return rows.join(first, F.col(group).eqNullSafe(F.col("_group"))).withColumn(out, F.col("_place") - F.col("_first")).drop("_group", "_first", "_place")


def nnz_buckets(rows: DataFrame, n_rows: int, buckets: int, row: str = "cell_id", nnz: str = "nnz") -> DataFrame:
    """Rows by (nnz, row) in buckets of equal count: bucket b holds places floor(b n / B) to floor((b + 1) n / B)."""
    out = ranked(rows, [F.col(nnz)], "place", row)
    return out.withColumn("bucket", F.floor((F.col("place") * buckets + (buckets - 1)) / F.lit(n_rows)).cast("int")).withColumn(
        "bucket", F.when(F.floor(F.col("bucket") * n_rows / F.lit(buckets)) > F.col("place"), F.col("bucket") - 1).otherwise(F.col("bucket"))
    )


def reorder(rows: DataFrame, permutation: DataFrame, key: str) -> DataFrame:
    """rows with their place in a permutation (key, place); the inverse map is the same table read by place."""
    return rows.join(permutation.select(key, "place"), key)


def update_output(new: DataFrame, old: DataFrame, keys: list[str], effect: str, a: float = 1.0, b: float = 1.0) -> DataFrame:
    """The destination after an update: overwrite, accumulate, affine (a new + b old) or partial (new where present)."""
    n, o = F.col("_new"), F.col("_old")
    both = new.select(*keys, F.col("value").alias("_new")).join(old.select(*keys, F.col("value").alias("_old")), keys, "full")
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    value = {"overwrite": n, "accumulate": zero(n) + zero(o), "affine": a * zero(n) + b * zero(o), "partial": F.coalesce(n, o)}[effect]
    out = both.select(*keys, value.alias("value"))
    return out.where(F.col("value").isNotNull()) if effect == "overwrite" else out
