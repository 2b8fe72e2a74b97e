"""Sets of features: bitsets, MinHash candidates, merge costs, candidate relations."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.lineage import cut
from ..functions.hashing import BAND_DOMAIN, BUCKET_DOMAIN, GAMMA, MASK, MINHASH_DOMAIN, SKETCH_STRIDE, mix_array, signed, splitmix, unsigned_mod, unsigned_order, with_splitmix


def bitset(sets: DataFrame, gene: str, position: str) -> DataFrame:
    """(gene, word, bits): members in words of 32; repeated members change nothing."""
    bit = F.expr(f"shiftleft(1L, cast(pmod(`{position}`, 32) as int))")
    return sets.groupBy(gene, F.floor(F.col(position) / 32).alias("word")).agg(F.bit_or(bit).alias("bits"))


def detected_counts(words: DataFrame, gene: str) -> DataFrame:
    return words.groupBy(gene).agg(F.sum(F.bit_count("bits").cast("long")).alias("detected"))


def support_size(cells: int, genes: int) -> dict[str, int]:
    words = -(-cells // 32)
    return {"words_per_gene": words, "bytes": 4 * words * genes}


def pair_overlap(sets: DataFrame, pairs: DataFrame, gene: str, member: str) -> DataFrame:
    """(gene_a, gene_b, intersection, union) of given pairs; pairs of disjoint sets have intersection 0."""
    size = sets.groupBy(gene).agg(F.count("*").alias("n"))
    a, b = sets.select(F.col(gene).alias("gene_a"), member), sets.select(F.col(gene).alias("gene_b"), member)
    hits = pairs.join(a, "gene_a").join(b, ["gene_b", member]).groupBy("gene_a", "gene_b").agg(F.count("*").alias("intersection"))
    na, nb = size.select(F.col(gene).alias("gene_a"), F.col("n").alias("size_a")), size.select(F.col(gene).alias("gene_b"), F.col("n").alias("size_b"))
    out = pairs.join(hits, ["gene_a", "gene_b"], "left").join(na, "gene_a").join(nb, "gene_b").withColumn("intersection", F.coalesce("intersection", F.lit(0)))
    return out.withColumn("union", F.col("size_a") + F.col("size_b") - F.col("intersection"))


@dataclass(frozen=True)
class Sketch:
    """Parameters of candidate discovery."""

    seed: int = 0
    bands: int = 16
    rows: int = 4
    most_in_bucket: int = 64

    @property
    def count(self) -> int:
        return self.bands * self.rows


LARGE_SET = 500_000  # members of a set that one task reduces


def sketches(sets: DataFrame, gene: str, member: str, p: Sketch) -> DataFrame:
    """(gene, sketch): per set one array of the least hash (unsigned) of every sketch.

    Members are sorted by gene, so a task reduces one set after the other and no row of a single sketch ever exists. A set of
    more than LARGE_SET members is shared out over tasks by a hash of the member, and the arrays of its parts are merged.
    """
    salts = np.array([splitmix(p.seed ^ MINHASH_DOMAIN ^ (j * SKETCH_STRIDE & MASK)) for j in range(p.count)], np.uint64)
    kind = sets.schema[gene].dataType.simpleString()

    def run(batches):
        gene_of, low = None, None  # of the set that the last batch ended in

        def rows(genes, arrays):
            flat = (np.concatenate(arrays) ^ np.uint64(1 << 63)).view(np.int64)
            return pa.RecordBatch.from_arrays([genes, pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, p.count, dtype=np.int32)), pa.array(flat))], ["g", "sketch"])

        for batch in batches:
            if not batch.num_rows:
                continue
            x = batch.column(1).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            of = np.asarray(batch.column(0).dictionary_encode().indices)
            head = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]]))
            least = np.stack([np.minimum.reduceat(mix_array(x ^ s), head) for s in salts], axis=1)  # runs of one gene
            genes = batch.column(0).take(pa.array(head))
            if gene_of is not None:
                if gene_of[0].equals(genes[0]):
                    least[0] = np.minimum(least[0], low)
                else:
                    yield rows(gene_of, [low])
            if len(head) > 1:
                yield rows(genes[:-1], list(least[:-1]))
            gene_of, low = genes[-1:], least[-1]
        if gene_of is not None:
            yield rows(gene_of, [low])

    named = sets.select(F.col(gene).alias("g"), F.col(member).cast("long").alias("_m"))
    large = cut(named.groupBy("g").agg(F.count("*").alias("_n")).where(F.col("_n") > LARGE_SET))
    if large.isEmpty():
        return named.repartition("g").sortWithinPartitions("g").mapInArrow(run, f"g {kind}, sketch array<long>").withColumnRenamed("g", gene)
    part = F.pmod(F.xxhash64("_m"), F.coalesce(F.ceil(F.col("_n") / LARGE_SET), F.lit(1)))
    shared = named.join(large, "g", "left").withColumn("_p", part).repartition("g", "_p").sortWithinPartitions("g", "_p").select("g", "_m")
    each = shared.mapInArrow(run, f"g {kind}, sketch array<long>").select("g", F.posexplode("sketch").alias("j", "v")).groupBy("g", "j").agg(F.min("v").alias("v"))
    return each.groupBy(F.col("g").alias(gene)).agg(F.transform(F.array_sort(F.collect_list(F.struct("j", "v"))), lambda s: s["v"]).alias("sketch"))


def minhash(sets: DataFrame, gene: str, member: str, p: Sketch) -> DataFrame:
    """(gene, sketch, value): for every sketch the least hash (unsigned) over the set."""
    return sketches(sets, gene, member, p).select(gene, F.posexplode("sketch").alias("sketch", "value")).withColumn("value", unsigned_order(F.col("value")))


def band_keys(sketched: DataFrame, gene: str, p: Sketch) -> DataFrame:
    """(gene, band, key): the sketches of each band of a set's array folded into one key."""
    kind = sketched.schema[gene].dataType.simpleString()
    starts = np.array([splitmix(p.seed ^ BAND_DOMAIN ^ b) for b in range(p.bands)], np.uint64)

    def run(batches):
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            v = batch.column(1).flatten().to_numpy(zero_copy_only=False).view(np.uint64).reshape(n, p.bands, p.rows) ^ np.uint64(1 << 63)
            key = np.tile(starts, (n, 1))
            for r in range(p.rows):
                key = mix_array(key ^ v[:, :, r] ^ np.uint64(r * GAMMA & MASK))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(np.repeat(np.arange(n), p.bands))), pa.array(np.tile(np.arange(p.bands, dtype=np.int32), n)), pa.array(key.view(np.int64).ravel())], ["g", "band", "key"])

    return sketched.select(gene, "sketch").mapInArrow(run, f"g {kind}, band int, key long").withColumnRenamed("g", gene)


def bucket_members(keys: DataFrame, gene: str, p: Sketch) -> DataFrame:
    """Members of every (key, band) bucket; of an oversized one a window of ``most_in_bucket`` from a hashed start, in a circle."""
    by = Window.partitionBy("key", "band")
    out = keys.withColumns({"_n": F.count("*").over(by), "_i": F.row_number().over(by.orderBy(gene)) - 1})
    salt = F.element_at(F.array(*(F.lit(signed(p.seed ^ BUCKET_DOMAIN ^ (b * SKETCH_STRIDE & MASK))) for b in range(p.bands))), F.col("band") + 1)
    out = with_splitmix(out, "_w", F.col("key").bitwiseXOR(salt))
    start = F.when(F.col("_n") > p.most_in_bucket, unsigned_mod(F.col("_w"), F.col("_n"))).otherwise(0)
    return out.where(F.pmod(F.col("_i") - start, F.col("_n")) < p.most_in_bucket).select(gene, "band", "key")


def candidate_pairs(sets: DataFrame, gene: str, member: str, p: Sketch = Sketch()) -> DataFrame:
    """(gene_a, gene_b), a < b: genes that share a bucket in some band."""
    m = bucket_members(band_keys(sketches(sets, gene, member, p), gene, p), gene, p)
    a, b = m.withColumnRenamed(gene, "gene_a"), m.withColumnRenamed(gene, "gene_b")
    return a.join(b, ["key", "band"]).where("gene_a < gene_b").select("gene_a", "gene_b").distinct()


def candidate_bound(genes: int, p: Sketch = Sketch()) -> int:
    """Most pairs all bands can give for a number of non-empty sets."""
    full, rest = divmod(genes, p.most_in_bucket)
    return p.bands * (full * p.most_in_bucket * (p.most_in_bucket - 1) // 2 + rest * (rest - 1) // 2)


@dataclass(frozen=True)
class MergePolicy:
    """Bytes of a block record (fixed values)."""

    block_metadata: int = 16
    feature_identifier: int = 4
    block_offset: int = 8
    active_row_offset: int = 4
    mask_word_bits: int = 32
    mask_word: int = 4
    value: int = 2
    metadata_alignment: int = 8
    payload_alignment: int = 8
    record_alignment: int = 16
    dense_values: bool = False


def _up(c: Column, to: int) -> Column:
    return F.floor((c + (to - 1)) / to) * to


def block_bytes(width: int, rows: Column, nnz: Column, p: MergePolicy = MergePolicy()) -> Column:
    """Bytes of a block of ``width`` features over its active rows."""
    meta = p.block_metadata + width * p.feature_identifier + p.block_offset
    words = -(-width // p.mask_word_bits)
    payload = (rows + 1) * p.active_row_offset + rows * (words * p.mask_word)
    values = (rows * width if p.dense_values else nnz) * p.value
    return _up(F.lit(-(-meta // p.metadata_alignment) * p.metadata_alignment) + _up(payload, p.payload_alignment) + values, p.record_alignment)


def merge_gain(overlap: DataFrame, p: MergePolicy = MergePolicy()) -> DataFrame:
    """overlap (size_a, size_b, intersection, union) with the bytes apart, merged, and the gain of merging."""
    a, b = block_bytes(1, F.col("size_a"), F.col("size_a"), p), block_bytes(1, F.col("size_b"), F.col("size_b"), p)
    merged = block_bytes(2, F.col("union"), F.col("size_a") + F.col("size_b"), p)
    return overlap.withColumns({"separate_bytes": a + b, "merged_bytes": merged}).withColumn("gain", F.col("separate_bytes") - F.col("merged_bytes"))


def normalize_candidates(relations: DataFrame, best_first: list) -> DataFrame:
    """Relations (a, b, num, den, ...) as unordered pairs without self edges, the best of each pair by num / den.

    Ratios are compared without rounding where the products fit a DECIMAL(38); ties go by ``best_first``.
    """
    r = relations.where("a <> b").withColumns({"_a": F.least("a", "b"), "_b": F.greatest("a", "b")}).drop("a", "b").withColumnsRenamed({"_a": "a", "_b": "b"})
    ratio = (F.col("num").cast("decimal(38,18)") / F.col("den").cast("decimal(19,0)")).desc()
    return r.withColumn("_i", F.row_number().over(Window.partitionBy("a", "b").orderBy(ratio, *best_first))).where("_i = 1").drop("_i")
