"""Problem 4: all pairs of set-valued records whose sets overlap above a threshold.

Every distinct set gets a code of one-bit minhashes. Two sets of similarity s agree in a bit with probability (1 + s) / 2,
so among ``segments`` pieces of ``width`` bits at least one is equal with the wanted recall, and the distance of the codes
stays within a radius that the same calibration gives. (A strict pigeonhole bound needs more pieces than the radius; where a
fifth of the bits may differ, such pieces would be too short to part anything, so their number follows the recall.) Pieces
are joined by equality; in the join a pair must also pass the size bound and the radius; what is left is verified on the
sets themselves. Equal sets are one class, whose members are expanded to pairs only where a result calls for it.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._work import chunk_pairs, cut

CLASS_CHUNK = 1000  # members of a class that meet in one group
CHECK_BITS = 192  # bits of the code that travel with a segment and are compared in the join


def calibrate(n_sets: int, threshold: float, recall: float) -> tuple[int, int, int]:
    """(width, segments, radius): segments of ``width`` bits for the number of sets, as many as the recall needs at the
    threshold, and the radius in CHECK_BITS that at most 1e-6 of such pairs exceed. About 32 sets share the value of a piece
    at any number of sets: fewer would take more pieces, which travel, and comparing costs less than travelling."""
    width = max(6, round(math.log2(max(2, n_sets))) - 5)
    agree = (1 + threshold) / 2
    segments = math.ceil(math.log(1 - recall) / math.log(1 - agree**width))
    p, tail, radius = 1 - agree, 0.0, CHECK_BITS
    while radius > 0 and tail + (x := math.exp(math.lgamma(CHECK_BITS + 1) - math.lgamma(radius + 1) - math.lgamma(CHECK_BITS - radius + 1) + radius * math.log(p) + (CHECK_BITS - radius) * math.log(agree))) < 1e-6:
        tail += x
        radius -= 1
    return width, segments, radius


def one_bit_minhashes(values: np.ndarray, ends: np.ndarray, bits: int, seed: int = 1) -> np.ndarray:
    """bool[sets, bits] for the sets values[ends[i] : ends[i + 1]] (none empty)."""
    x = values.astype(np.uint64)
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
        x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    low, high = x.astype(np.uint32), (x >> np.uint64(32)).astype(np.uint32)
    rng = np.random.default_rng(seed)
    out = np.empty((len(ends) - 1, bits), bool)
    a, b, c = (rng.integers(0, 2**32, bits, np.uint32) | np.uint32(1) for _ in range(3))
    with np.errstate(over="ignore"):
        for j in range(bits):
            h = (low + b[j]) * a[j] ^ high * c[j]
            h ^= h >> np.uint32(16)
            h *= np.uint32(0x7FEB352D)
            h ^= h >> np.uint32(15)
            out[:, j] = np.minimum.reduceat(h, ends[:-1]) & np.uint32(1)
    return out


def _coder(width: int, segments: int):
    def run(batches):
        import pyarrow as pa

        bits = max(CHECK_BITS, width * segments)
        for batch in batches:
            for i in range(0, batch.num_rows, 2000):
                part = batch.slice(i, 2000)
                sets = part.column(1)
                size = sets.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
                code = one_bit_minhashes(sets.flatten().to_numpy(), np.concatenate([[0], np.cumsum(size)]), bits)
                pieces = code[:, : width * segments].reshape(len(part), segments, width) @ (1 << np.arange(width, dtype=np.int64))
                words = np.packbits(code[:, :CHECK_BITS], axis=1).view(np.int64)
                keys = pa.ListArray.from_arrays(pa.array(np.arange(0, len(part) * segments + 1, segments, np.int32)), pa.array((pieces + (np.arange(segments) << width)).ravel()))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(size.astype(np.int32)), *(pa.array(np.ascontiguousarray(w)) for w in words.T), keys], ["s", "n", *(f"w{k}" for k in range(CHECK_BITS // 64)), "keys"])

    return run


def distinct_sets(rows: DataFrame, key: str, value: str) -> tuple[DataFrame, DataFrame]:
    """(members (k, s), sets (s, items)): the class of every record's set, and each distinct set once.

    The set of a record is its distinct non-null, non-negative values; null keys take no part, and records without
    values do not come out. Equal sets share a class, the smallest of their keys. Rows are reduced before each shuffle. A set is
    one array, so its members must fit a row (some ten millions do).
    """
    flat = rows.where(F.col(key).isNotNull() & (F.col(value) >= 0)).select(F.col(key).alias("k"), F.col(value).cast("long").alias("v")).distinct()
    sets = cut(flat.groupBy("k").agg(F.array_sort(F.collect_list("v")).alias("items")))
    # equal sets have equal size and equal digests of 128 bits
    digest = sets.select("k", F.size("items").alias("d0"), F.xxhash64("items").alias("d1"), F.xxhash64(F.lit("second"), "items").alias("d2"))
    classes = digest.groupBy("d0", "d1", "d2").agg(F.min("k").alias("s"))
    members = cut(digest.join(classes, ["d0", "d1", "d2"]).select("k", "s"))
    return members, sets.join(members.where("k = s").select(F.col("s").alias("k")), "k", "left_semi").withColumnRenamed("k", "s")


def similar_sets(sets: DataFrame, numerator: int, denominator: int, recall: float) -> DataFrame:
    """(a, b, common, total) of distinct sets a < b whose Jaccard similarity is at least numerator / denominator."""
    n_sets = sets.count()
    threshold = numerator / denominator
    width, segments, radius = calibrate(n_sets, threshold, recall)
    words = [f"w{k}" for k in range(CHECK_BITS // 64)]
    kind = sets.schema["s"].dataType.simpleString()
    codes = sets.select("s", "items").mapInArrow(_coder(width, segments), f"s {kind}, n int, {', '.join(f'{w} long' for w in words)}, keys array<long>")
    codes = cut(codes)
    probes = codes.select("s", "n", *words, F.explode("keys").alias("key"))
    one, two = probes.alias("x"), probes.alias("y")
    apart = sum((F.bit_count(F.col(f"x.{w}").bitwiseXOR(F.col(f"y.{w}"))) for w in words), F.lit(0))
    sizes = (F.col("x.n") * denominator >= F.col("y.n") * numerator) & (F.col("y.n") * denominator >= F.col("x.n") * numerator)
    near = one.join(two, (F.col("x.key") == F.col("y.key")) & (F.col("x.s") < F.col("y.s")) & sizes & (apart <= radius))
    pairs = near.select(F.col("x.s").alias("a"), F.col("y.s").alias("b")).distinct()
    a, b = sets.select(F.col("s").alias("a"), F.col("items").alias("_a")), sets.select(F.col("s").alias("b"), F.col("items").alias("_b"))
    both = pairs.join(a, "a").join(b, "b").withColumn("common", F.size(F.array_intersect("_a", "_b")))
    both = both.withColumn("total", F.size("_a") + F.size("_b") - F.col("common"))
    return both.where(F.col("common") * denominator >= F.col("total") * numerator).select("a", "b", "common", "total")


def similar_classes(rows: DataFrame, key: str, value: str, numerator: int = 3, denominator: int = 5, recall: float = 0.9995) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(members (k, s), pairs (a, b, common, total) of classes a < b, sets (s, n)): every record's class, the links between
    classes, and the size of their sets. All members of linked classes, and all of one class, are similar."""
    members, sets = distinct_sets(rows, key, value)
    sets = cut(sets)
    return members, cut(similar_sets(sets, numerator, denominator, recall)), sets.select("s", F.size("items").alias("n"))


def record_links(rows: DataFrame, key: str, value: str, numerator: int = 3, denominator: int = 5, recall: float = 0.9995) -> DataFrame:
    """(k, s, members, links): per record its class, how many records that has, and to how many others it is similar.

    Nothing is expanded: a class of many equal sets costs as many rows as it has members.
    """
    members, pairs, _ = similar_classes(rows, key, value, numerator, denominator, recall)
    size = members.groupBy("s").agg(F.count("*").alias("members"))
    both = pairs.select(F.col("a").alias("s"), F.col("b").alias("o")).unionAll(pairs.select(F.col("b").alias("s"), F.col("a").alias("o")))
    links = both.join(size.withColumnsRenamed({"s": "o", "members": "m"}), "o").groupBy("s").agg(F.sum("m").alias("links"))
    of_class = size.join(links, "s", "left").select("s", "members", (F.coalesce("links", F.lit(0)) + F.col("members") - 1).alias("links"))
    return members.join(of_class, "s").select("k", "s", "members", "links")


def similar_records(rows: DataFrame, key: str, value: str, numerator: int = 3, denominator: int = 5, recall: float = 0.9995) -> DataFrame:
    """(a, b, common, total): all pairs of records a < b with similarity of at least numerator / denominator.

    Distinct sets are joined once; records with equal sets are then expanded to the pairs the result calls for, large
    classes in chunks, so that no group holds more than the pairs of two of them.
    """
    members, near, size = similar_classes(rows, key, value, numerator, denominator, recall)
    chunks = members.groupBy("s").agg(F.ceil(F.count("*") / CLASS_CHUNK).cast("int").alias("of"), F.count("*").alias("m")).where("m > 1").drop("m")
    parts = members.join(chunks, "s").withColumn("c", F.pmod(F.xxhash64("k"), F.col("of")).cast("int"))
    x, y = chunk_pairs(parts, "s", "c", "of")
    same = x.withColumnRenamed("k", "x").join(y.withColumnRenamed("k", "y"), ["s", "lo", "hi"]).where("lo < hi or x < y").select("s", F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
    same = same.join(size, "s").select("a", "b", F.col("n").alias("common"), F.col("n").alias("total"))
    one, two = members.select(F.col("s").alias("a"), F.col("k").alias("ka")), members.select(F.col("s").alias("b"), F.col("k").alias("kb"))
    other = near.join(one, "a").join(two, "b").select(F.least("ka", "kb").alias("a"), F.greatest("ka", "kb").alias("b"), "common", "total")
    return same.unionAll(other)


def similar_across(left: DataFrame, right: DataFrame, key: str, value: str, numerator: int = 3, denominator: int = 5, recall: float = 0.9995) -> DataFrame:
    """(a, b, common, total): pairs of a record a of ``left`` and a record b of ``right`` above the similarity."""
    tag = lambda df, side: df.where(F.col(key).isNotNull()).select(F.struct(F.lit(side).alias("side"), F.col(key).alias("id")).alias("k"), F.col(value).alias("v"))
    pairs = similar_records(tag(left, 0).unionAll(tag(right, 1)), "k", "v", numerator, denominator, recall)
    return pairs.where("a.side = 0 and b.side = 1").select(F.col("a.id").alias("a"), F.col("b.id").alias("b"), "common", "total")
