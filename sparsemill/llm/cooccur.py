"""Problem 5: items that appear together, how often, and how surprising that is.

Pair counts are exact. They are compared with the bipartite configuration model that honours, in the mean, how often
every item occurs and how many items every record has: item i is in record j with probability x_i y_j / (1 + x_i y_j).
The joint count of two items is then Poisson-binomial; its upper tail (saddlepoint approximation) gives the p-value, and
false discoveries are controlled over all pairs of items.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._work import chunk_pairs, cut

BASKET = 512  # larger records are counted by pairs of parts
HELD_PAIRS = 3_000_000
CLASSES = 512
P_BINS = 100  # per decade of the p-value


def baskets(records: DataFrame, record: str, items: str) -> tuple[DataFrame, DataFrame]:
    """(sets (r, x), flat (r, i)): the distinct non-null, non-negative items of every record, those of small records as
    one array, those of others as rows. Rows of one record are united, records that are null or without items left out.

    A record is small if all its rows together have BASKET items at most, repeats counted, so an array is never long.
    """
    kept = F.array_distinct(F.filter(items, lambda i: i >= 0))
    rows = records.where(F.col(record).isNotNull()).select(F.col(record).alias("r"), F.array_sort(kept.cast("array<long>")).alias("x")).where(F.size("x") > 0)
    large = cut(rows.groupBy("r").agg(F.sum(F.size("x")).alias("m")).where(F.col("m") > BASKET).select("r"))
    sets = rows.join(large, "r", "left_anti").groupBy("r").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_set("x")))).alias("x"))
    flat = rows.join(large, "r", "left_semi").select("r", F.explode("x").alias("i")).distinct()
    return cut(sets), cut(flat)


def _count_pairs(batches):
    """Rows of one or two item lists -> partial counts of their pairs (a < b)."""
    import pyarrow as pa

    held, n_held = [], 0

    def merged():
        a, b, n = (np.concatenate(x) for x in zip(*held))
        order = np.lexsort((b, a))
        a, b, n = a[order], b[order], n[order]
        head = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])]))
        return a[head], b[head], np.add.reduceat(n, head)

    def batch_of(a, b, n):
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(n)], ["a", "b", "n"])

    for batch in batches:
        for codes, universe in _pair_codes(batch):
            u, n = np.unique(codes, return_counts=True)
            held.append((universe[u // len(universe)], universe[u % len(universe)], n))
            n_held += len(u)
        if n_held > HELD_PAIRS:
            one = merged()
            if len(one[0]) > HELD_PAIRS // 2:
                yield batch_of(*one)
                held, n_held = [], 0
            else:
                held, n_held = [one], len(one[0])
    if held:
        yield batch_of(*merged())


def _pair_codes(batch):
    """Chunks of pair codes (place of a times universe size plus place of b) with the sorted items they refer to."""
    first = batch.column(0)
    flat = first.flatten().to_numpy(zero_copy_only=False)
    size = first.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    at = np.cumsum(size) - size
    second = batch.column(1)
    whole = np.asarray(second.is_null())
    universe, place = np.unique(flat, return_inverse=True)
    for k in np.unique(size[whole & (size > 1)]):
        rows = np.flatnonzero(whole & (size == k))
        i, j = np.triu_indices(int(k), 1)
        for c in range(0, len(rows), max(1, 4_000_000 // len(i))):
            m = np.sort(place[at[rows[c : c + max(1, 4_000_000 // len(i))], None] + np.arange(k)], axis=1).astype(np.int64)
            yield (m[:, i] * len(universe) + m[:, j]).ravel(), universe
    for r in np.flatnonzero(~whole):  # two parts of one large record
        a, b = flat[at[r] : at[r] + size[r]], second[int(r)].values.to_numpy(zero_copy_only=False)
        both = np.unique(np.concatenate([a, b]))
        x, y = np.searchsorted(both, a).astype(np.int64)[:, None], np.searchsorted(both, b).astype(np.int64)[None, :]
        yield (np.minimum(x, y) * len(both) + np.maximum(x, y)).ravel(), both


def pair_counts(records: DataFrame, record: str, items: str, min_count: int = 8, min_ratio: float = 3.0) -> tuple[DataFrame, DataFrame, DataFrame]:
    """((a, b, n_ab, n_a, n_b, n, ratio), item frequencies (i, n_i), record sizes (k, records)).

    All pairs of items a < b with n_ab >= min_count and n_ab * n >= min_ratio * n_a * n_b. Since n_ab is at most the
    smaller frequency, an item below min_count, or in more than n / min_ratio records, is in no such pair and is left
    out before pairs are counted, which loses none. Pairs are counted per task before the shuffle; a record of many items is
    taken in pairs of chunks of BASKET, each a group of its own. Null, empty and missing item lists hold no items; repeated
    items and rows count once.
    """
    sets, flat = baskets(records, record, items)
    each = sets.select("r", F.explode("x").alias("i")).unionAll(flat)
    freq = cut(each.groupBy("i").agg(F.count("*").alias("n_i")))
    of_record = sets.select("r", F.size("x").cast("long").alias("k")).unionAll(flat.groupBy("r").agg(F.count("*").alias("k")))
    sizes = cut(of_record.groupBy("k").agg(F.count("*").alias("records")))
    n = int(sizes.agg(F.sum("records")).first()[0] or 0)
    if min_count > 1 or min_ratio > 0:
        useful = freq.where((F.col("n_i") >= min_count) & (F.col("n_i") * F.lit(float(min_ratio)) <= n)).select("i")
        small = sets.select("r", F.explode("x").alias("i")).join(useful, "i", "left_semi").groupBy("r").agg(F.collect_list("i").alias("x"))
        flat = flat.join(useful, "i", "left_semi")
    else:
        small = sets
    chunks = flat.groupBy("r").agg(F.ceil(F.count("*") / BASKET).cast("int").alias("of"))
    parts = flat.join(chunks, "r").withColumn("c", F.pmod(F.xxhash64("i"), F.col("of")).cast("int")).groupBy("r", "c", "of").agg(F.collect_list("i").alias("x"))
    left, right = chunk_pairs(cut(parts), "r", "c", "of")
    both = left.join(right.withColumnRenamed("x", "y"), ["r", "lo", "hi"]).select("x", F.when(F.col("lo") < F.col("hi"), F.col("y")).alias("y"))
    counted = small.select("x", F.lit(None).cast("array<long>").alias("y")).unionAll(both).mapInArrow(_count_pairs, "a long, b long, n long")
    counted = counted.groupBy("a", "b").agg(F.sum("n").alias("n_ab")).where(F.col("n_ab") >= min_count)
    fa, fb = freq.select(F.col("i").alias("a"), F.col("n_i").alias("n_a")), freq.select(F.col("i").alias("b"), F.col("n_i").alias("n_b"))
    out = counted.join(fa, "a").join(fb, "b").withColumn("n", F.lit(n))
    out = out.where(F.col("n_ab") * F.col("n") >= F.lit(float(min_ratio)) * F.col("n_a") * F.col("n_b"))
    out = out.withColumn("ratio", F.col("n_ab") * F.col("n") / (F.col("n_a").cast("double") * F.col("n_b")))
    return out.select("a", "b", "n_ab", "n_a", "n_b", "n", "ratio"), freq, sizes


def _classes(values: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values with weights; beyond CLASSES of them, means over logarithmic bins."""
    if len(values) <= CLASSES:
        return values.astype(float), weight.astype(float)
    edge = np.geomspace(values.min(), values.max() * 1.000001, CLASSES + 1)
    b = np.searchsorted(edge, values, "right") - 1
    w = np.bincount(b, weight, CLASSES)
    m = np.bincount(b, weight * values, CLASSES)
    return m[w > 0] / w[w > 0], w[w > 0]


def fit_null(item_freq: np.ndarray, items: np.ndarray, size: np.ndarray, records: np.ndarray, rounds: int = 2000, tolerance: float = 1e-9) -> tuple[np.ndarray, np.ndarray]:
    """x by item frequency and y by record size of the configuration model (fixed-point iteration on the classes)."""
    total = max(1.0, float((item_freq * items).sum()))
    x, y = item_freq / np.sqrt(total), size / np.sqrt(total)
    for _ in range(rounds):
        nx = item_freq / np.maximum((records * y / (1 + x[:, None] * y)).sum(1), 1e-300)
        ny = size / np.maximum((items[:, None] * nx[:, None] / (1 + nx[:, None] * y)).sum(0), 1e-300)
        change = max(np.abs(nx / np.maximum(x, 1e-300) - 1).max(initial=0), np.abs(ny / np.maximum(y, 1e-300) - 1).max(initial=0))
        x, y = nx, ny
        if change < tolerance:
            break
    return x, y


def _scaled_erfc(z: np.ndarray) -> np.ndarray:
    """exp(z^2) erfc(z) for z >= 0, to a relative error of 1e-7 (Chebyshev fit; the coefficients are fixed values)."""
    coefficients = [-1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806, 0.27886807, -1.13520398, 1.48851587, -0.82215223, 0.17087277]
    t = 1 / (1 + 0.5 * z)
    return t * np.exp(np.polynomial.polynomial.polyval(t, coefficients))


def upper_tail(k: np.ndarray, q: np.ndarray, m: np.ndarray) -> np.ndarray:
    """log10 P(N >= k) for N the sum of m_c Bernoulli trials of probability q[row, c] (Lugannani-Rice, lattice form)."""
    k = k.astype(float)[:, None]
    q = np.clip(q, 1e-300, 1 - 1e-12)
    mean, most = (m * q).sum(1, keepdims=True), m.sum()
    t = np.log(np.clip(k, 0.5, most - 0.5) / np.maximum(mean, 1e-300))
    for _ in range(60):
        e = q * np.exp(np.clip(t, -700, 700))
        p = e / (1 - q + e)
        f, v = (m * p).sum(1, keepdims=True) - np.minimum(k, most - 0.5), (m * p * (1 - p)).sum(1, keepdims=True)
        step = np.clip(f / np.maximum(v, 1e-12), -2, 2)
        t = t - step
        if np.abs(step).max(initial=0) < 1e-10:
            break
    e = q * np.exp(np.clip(t, -700, 700))
    p = e / (1 - q + e)
    v = (m * p * (1 - p)).sum(1)
    logs = (m * np.log1p(q * np.expm1(np.clip(t, -700, 700)))).sum(1)
    t, k = t[:, 0], k[:, 0]
    w = np.sign(t) * np.sqrt(np.maximum(2 * (t * k - logs), 0))
    u = -np.expm1(-t) * np.sqrt(v)
    near = np.abs(t) < 1e-4
    w_, u_ = np.where(near, 1.0, w), np.where(near, 1.0, u)
    mills = np.sqrt(np.pi / 2) * _scaled_erfc(np.abs(w_) / np.sqrt(2))  # of |w|
    density = np.exp(-0.5 * w_**2) / np.sqrt(2 * np.pi)
    high = np.log(np.maximum(mills + 1 / u_ - 1 / w_, 1e-300)) - 0.5 * w_**2 - 0.5 * np.log(2 * np.pi)
    low = np.log(np.clip(1 - density * mills + density * (1 / u_ - 1 / w_), 1e-300, 1))
    out = np.where(w_ > 0, high, low)
    out = np.where(near, np.log(0.5 + 0.5 / np.sqrt(2 * np.pi * np.maximum(v, 1e-12))), out)
    out = np.where(k >= most, (m * np.log(q)).sum(1), np.minimum(out, 0))
    return np.where(k <= 0, 0.0, out) / np.log(10)


def surprise(pairs: DataFrame, freq: DataFrame, sizes: DataFrame, fdr: float = 0.05) -> DataFrame:
    """pairs with null_mean, log10_p, q_value and ``surprising`` (q_value <= fdr).

    The model is fitted on the driver over the distinct item frequencies and record sizes, at most CLASSES of each.
    q-values are those of Benjamini and Hochberg over all pairs of items, from the counts of p-values in bins of a
    hundredth of a decade (a q-value is at most 2.4 % too large). pairs must hold all that occur together (min_count=1,
    min_ratio=0): one that is missing takes no rank, which makes q-values too large; pairs that never meet have p-value 1.
    """
    by = freq.groupBy("n_i").agg(F.count("*").alias("items"))
    low, high = by.agg(F.min("n_i"), F.max("n_i")).first()
    spark = pairs.sparkSession
    if low is None:
        return pairs.select("*", *(F.lit(None).cast("double").alias(c) for c in ("null_mean", "log10_p", "q_value")), F.lit(False).alias("surprising"))
    # at most 4096 logarithmic bins of each come to the driver
    scale = 4095 / max(np.log(high / low), 1e-9) if high - low > 4095 else None
    b = F.col("n_i") if scale is None else F.floor(F.log(F.col("n_i") / low) * scale)
    rows = np.array([tuple(r) for r in by.groupBy(b.alias("b")).agg(F.sum(F.col("n_i") * F.col("items")) / F.sum("items"), F.sum("items")).select("`(sum((n_i * items)) / sum(items))`", "`sum(items)`").collect()], float)
    rec = np.array([tuple(r) for r in sizes.groupBy(F.when(F.col("k") <= 2048, F.col("k").cast("double")).otherwise(F.floor(F.log("k") * 256) + 4096).alias("b")).agg((F.sum(F.col("k") * F.col("records")) / F.sum("records")).alias("k"), F.sum("records").alias("m")).select("k", "m").collect()], float)
    kf, kn = _classes(*rows[np.argsort(rows[:, 0])].T)
    sf, sn = _classes(*rec[np.argsort(rec[:, 0])].T)
    x, y = fit_null(kf, kn, sf, sn)

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            n_ab, n_a, n_b = (batch.column(batch.schema.get_field_index(c)).to_numpy().astype(float) for c in ("n_ab", "n_a", "n_b"))
            for i in range(0, max(1, len(n_ab)), 20_000):
                s = slice(i, i + 20_000)
                pa_, pb = ((z := np.exp(np.interp(np.log(v[s]), np.log(kf), np.log(x)))[:, None] * y) / (1 + z) for v in (n_a, n_b))
                q = pa_ * pb
                part = batch.slice(i, 20_000)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array((q * sn).sum(1)), pa.array(upper_tail(n_ab[s], q, sn))], [*batch.schema.names, "null_mean", "log10_p"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pairs.schema)
    scored = cut(pairs.mapInArrow(run, f"{fields}, null_mean double, log10_p double").withColumn("_bin", F.least(F.floor(-F.col("log10_p") * P_BINS), F.lit(400 * P_BINS)).cast("int")))
    bins = sorted(((r["_bin"], r["count"]) for r in scored.groupBy("_bin").count().collect()), reverse=True)  # at most 40,001
    items = float(kn.sum())
    tests, seen, q_of = items * (items - 1) / 2, 0, []
    for at, count in bins:
        seen += count
        q_of.append([at, min(1.0, 10.0 ** (-at / P_BINS) * tests / seen)])
    for i in range(len(q_of) - 2, -1, -1):
        q_of[i][1] = min(q_of[i][1], q_of[i + 1][1])
    q = spark.createDataFrame([tuple(r) for r in q_of], "_bin int, q_value double")
    return scored.join(F.broadcast(q), "_bin").drop("_bin").withColumn("surprising", F.col("q_value") <= fdr)
