"""Motif predicates on sequences, and their projection to elements and genes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .neighbors import locate


def mismatches(window: Column, motif: str) -> Column:
    """Mismatches of a window of the motif's length; null if it has another length or a base other than A, C, G, T."""
    n = sum((F.when(F.substring(window, i + 1, 1) != b, 1).otherwise(0) for i, b in enumerate(motif)), F.lit(0))
    return F.when((F.length(window) == len(motif)) & ~F.rlike(window, F.lit("[^ACGT]")), n)


def motif_hits(sequences: DataFrame, key: str, sequence: str, motif: str, most: int, predicate_id: int = 0, begin: int = 0, end: int | None = None) -> DataFrame:
    """(key, position, predicate_id, mismatches): anchors in [begin, end) where the motif fits with at most ``most`` mismatches."""
    if not 0 < len(motif) <= 32:
        raise ValueError("a motif has 1 to 32 bases")
    last = F.length(sequence) - len(motif)
    s = sequences.where(last >= begin).select(key, F.col(sequence).alias("_s"), F.explode(F.sequence(F.lit(begin), last if end is None else F.least(last, F.lit(end - 1)))).alias("position"))
    s = s.select(key, "position", F.lit(predicate_id).alias("predicate_id"), mismatches(F.expr(f"substring(_s, position + 1, {len(motif)})"), motif).alias("mismatches"))
    return s.where(F.col("mismatches") <= most)


def gene_state(hits: DataFrame, intervals: DataFrame, element_gene: DataFrame) -> DataFrame:
    """(gene, weight, hits): hits in the interval of an element, summed over the genes it acts on."""
    located = locate(hits, intervals)
    return located.join(element_gene, "element").groupBy("gene").agg(F.sum("weight").alias("weight"), F.count("*").alias("hits"))


def strategy(expected_uses: int) -> str:
    """A mask used more than once is worth storing, else it is fused into its use."""
    return "materialize" if expected_uses > 1 else "fuse"


def validate_intervals(intervals: DataFrame) -> None:
    """Raise unless the intervals of each predicate are non-empty and do not overlap."""
    from pyspark.sql import Window

    w = Window.partitionBy("predicate_id").orderBy("begin", "end")
    bad = intervals.withColumn("_e", F.lag("end").over(w)).where((F.col("begin") >= F.col("end")) | (F.col("begin") < F.col("_e"))).limit(1).collect()
    if bad:
        raise ValueError(f"interval [{bad[0]['begin']}, {bad[0]['end']}) is empty or overlaps another")


def projection_bytes(intervals: int, links: int) -> int:
    """Bytes of the arrays: begin, end, element and predicate of an interval, element, gene and weight of a link."""
    return intervals * 4 * 4 + links * 3 * 4
