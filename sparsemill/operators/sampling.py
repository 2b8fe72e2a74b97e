"""Deterministic samples: hash ranges, lowest hashes, strata, splits, bootstraps, minibatches."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.lineage import cut
from ..functions.hashing import signed, splitmix, unsigned_decimal, unsigned_order, with_id_hash, with_row_hash, with_splitmix

MOST_EXACT = 65_536
BOOT_DOMAIN = 0x626F6F745F647231  # fixed value: separates bootstrap draws from other hashes


def hash_range(rows: DataFrame, row: str, seed: int, begin: tuple[int, int], end: tuple[int, int]) -> DataFrame:
    """Rows (with ``hash``) whose hash lies in [n1 / d1, n2 / d2) of 2^64; the end 1/1 includes all."""
    for n, d in (begin, end):
        if not (0 <= n <= d < 1 << 32 and d > 0):
            raise ValueError(f"{n}/{d} is no fraction of 32 bits")
    out = with_row_hash(rows, "hash", F.col(row), seed)
    at = lambda q, up: -(-q[0] * (1 << 64) // q[1]) if up else q[0]
    low, high = at(begin, True), at(end, True)  # hash * d >= n * 2^64 is hash >= ceil(n * 2^64 / d)
    h = unsigned_order(F.col("hash"))
    keep = h >= F.lit(signed(low ^ (1 << 63))) if low < 1 << 64 else F.lit(False)
    if end[0] < end[1]:
        keep = keep & (h < F.lit(signed(high ^ (1 << 63))))
    return out.where(keep)


def lowest_hashes(rows: DataFrame, row: str, seed: int, n: int, stable_id: str | None = None) -> DataFrame:
    """The n rows of lowest (hash, id, row), clamped to what there is, with their ``position`` in row order.

    With ``stable_id`` that column was hashed before (column ``hash``); else the row number is.
    """
    if n > MOST_EXACT:
        raise ValueError(f"an exact sample has {MOST_EXACT} rows at most")
    h = rows if stable_id else with_row_hash(rows, "hash", F.col(row), seed)
    order = [unsigned_order(F.col("hash")), *([F.col(stable_id)] if stable_id else []), F.col(row)]
    top = h.orderBy(*order).limit(n)  # each task keeps n rows, and MOST_EXACT bounds them
    return top.withColumn("position", F.row_number().over(Window.orderBy(row)) - 1)


def file_sample(rows: DataFrame, row: str, stable_id: str, seed: int, n: int) -> DataFrame:
    """The n rows of lowest hash with ``position`` and ``key``: by stable identifiers ('id') if every row has one, else by row
    numbers ('row'). An identifier is hashed by its bytes, so the sample outlives renumbered rows."""
    named = rows.select(row, stable_id)
    if named.where(F.col(stable_id).isNull() | (F.col(stable_id) == "")).isEmpty():
        return lowest_hashes(with_id_hash(named, "hash", stable_id, seed), row, seed, n, stable_id).withColumn("key", F.lit("id"))
    return lowest_hashes(named, row, seed, n).withColumn("key", F.lit("row"))


def density_strata(rows: DataFrame, nnz: str, strata: int) -> DataFrame:
    """(nnz, n, stratum): every distinct nnz with its rows and its density stratum, strata as equal in rows as can be.

    Cut i lies between two distinct values, where the rows below it come closest to i shares of all, the lower place on
    ties; every stratum keeps one value at least. The table has as many rows as there are distinct nnz, never as many as
    ``rows``, so its windows are small.
    """
    by = rows.groupBy(F.col(nnz).alias("nnz")).agg(F.count("*").alias("n"))
    upto = Window.orderBy("nnz")
    all_ = Window.partitionBy()
    v = by.withColumns({"below": F.sum("n").over(upto), "place": F.row_number().over(upto), "total": F.sum("n").over(all_), "values": F.count("*").over(all_)})
    v = v.withColumn("of", F.least(F.lit(strata), "values"))
    # the nearest place of every cut, as if it were alone
    cuts = v.withColumn("cut", F.explode(F.sequence(F.lit(1), F.lit(max(1, strata - 1))))).where(F.col("cut") < F.col("of"))
    off = F.abs(F.col("below") * F.col("of") - F.col("cut") * F.col("total"))
    nearest = cuts.groupBy("cut", "of", "values").agg(F.min(F.struct(off, "place"))["place"].alias("at"))
    # a cut leaves a value to every stratum on either side of it: at least one more than the one before, and room for those after
    pushed = F.max(F.col("at") - F.col("cut")).over(Window.orderBy("cut"))
    ends = nearest.withColumn("end", F.least(F.greatest(pushed, F.lit(0)) + F.col("cut"), F.col("values") - F.col("of") + F.col("cut")))
    passed = F.aggregate(F.col("ends"), F.lit(0), lambda k, e: k + (F.col("place") > e).cast("int"))
    held = ends.agg(F.collect_list("end").alias("ends"))  # one row of at most ``strata`` numbers
    return v.join(F.broadcast(held)).select("nnz", "n", passed.alias("stratum"))


def density_allocation(strata: DataFrame, rows: int) -> DataFrame:
    """(stratum, size, sampled) from ``density_strata``: one row of every stratum, the rest in proportion to its other rows, by
    largest remainder, ties by stratum; never more than it has."""
    s = strata.groupBy("stratum").agg(F.sum("n").alias("size"), F.max("nnz").alias("upper"))
    all_ = Window.partitionBy()
    s = s.withColumns({"_k": F.count("*").over(all_), "_room": F.sum("size").over(all_) - F.count("*").over(all_)})
    rest = F.greatest(F.lit(rows) - F.col("_k"), F.lit(0))
    s = s.withColumn("_share", rest * (F.col("size") - 1)).withColumn("_whole", F.floor(F.col("_share") / F.greatest("_room", F.lit(1))))
    s = s.withColumn("_left", rest - F.sum("_whole").over(all_)).withColumn("_part", F.col("_share") - F.col("_whole") * F.greatest("_room", F.lit(1)))
    more = (F.row_number().over(Window.orderBy(F.desc("_part"), "stratum")) <= F.col("_left")).cast("long")
    return s.select("stratum", "upper", "size", F.least(1 + F.col("_whole") + more, "size").alias("sampled"))


def density_sample(rows: DataFrame, row: str, nnz: str, seed: int, strata: int, n: int) -> DataFrame:
    """(row, nnz, stratum, hash, weight): the lowest hashes of every density stratum; weight = rows of it / sampled ones.

    The quotas come to the driver, ``strata`` numbers, to bound what a task keeps of a stratum.
    """
    if rows.isEmpty():
        raise ValueError("density sampling needs rows")
    of = cut(density_strata(rows, nnz, strata))
    quota = density_allocation(of, n)
    got = quota.agg(F.sum("size"), F.max("sampled")).first()
    if not 0 < n <= got[0]:
        raise ValueError(f"{n} rows cannot be drawn")
    placed = rows.join(of.select(F.col("nnz").alias(nnz), "stratum"), nnz)
    out = with_row_hash(placed, "hash", F.col(row), seed)
    w = Window.partitionBy("stratum").orderBy(unsigned_order(F.col("hash")), row)
    out = out.withColumn("_i", F.row_number().over(w)).where(F.col("_i") <= got[1])
    return out.join(F.broadcast(quota), "stratum").where("_i <= sampled").withColumn("weight", F.col("size") / F.col("sampled")).drop("_i", "size", "sampled", "upper")


def same_sample(first: DataFrame, again: DataFrame) -> bool:
    """Whether a rerun gave the same rows."""
    return first.exceptAll(again).isEmpty() and again.exceptAll(first).isEmpty()


def labelled_sample(rows: DataFrame, row: str, label: str, seed: int, per_label: int, cap: int | None = None) -> DataFrame:
    """(row, label, position): at most ``per_label`` rows a label by hash; labels in order, rows sorted in them; at most ``cap``."""
    h = with_row_hash(rows.where(F.col(label).isNotNull()), "_h", F.col(row), seed)
    h = h.withColumn("_i", F.row_number().over(Window.partitionBy(label).orderBy(unsigned_order(F.col("_h")), row))).where(F.col("_i") <= per_label)
    taken = h.select(row, label)
    if cap is not None:
        taken = taken.orderBy(label, row).limit(cap)
    return taken.withColumn("position", F.row_number().over(Window.orderBy(label, row)) - 1)  # labels x per_label rows


def label_spans(sample: DataFrame, label: str) -> DataFrame:
    """(label, begin, end) of each label's rows in the sample."""
    return sample.groupBy(label).agg(F.min("position").alias("begin"), (F.max("position") + 1).alias("end"))


def held_out_split(rows: DataFrame, unit: str, seed: int, numerator: int, denominator: int) -> DataFrame:
    """rows with ``held_out``: whole units, those of lowest hash, as many as the share calls for, but one on each side.

    Ranks come from range partitions, so no task holds all units.
    """
    from .sparse import ranked

    units = with_row_hash(rows.select(F.col(unit).alias("_u")).distinct(), "_h", F.col("_u"), seed)
    n = units.count()
    if n < 2:
        raise ValueError("a split needs two units")
    held = min(max(1, n * numerator // denominator), n - 1)
    out = ranked(units.withColumn("_o", unsigned_order(F.col("_h"))), [F.col("_o")], "_i", "_u")
    return rows.join(out.select(F.col("_u").alias(unit), (F.col("_i") < held).alias("held_out")), unit)


def bootstrap(rows: DataFrame, unit: str, seed: int, replicate: int) -> DataFrame:
    """(unit, times): how often each unit is drawn in as many draws with replacement as there are units."""
    from .sparse import ranked

    units = ranked(rows.select(unit).distinct(), [F.col(unit)], "_i", unit)
    n = units.count()
    draws = with_splitmix(rows.sparkSession.range(n), "_h", F.col("id").bitwiseXOR(F.lit(signed(splitmix(seed ^ BOOT_DOMAIN ^ (replicate << 32))))))
    half = F.shiftrightunsigned("_h", 1)
    drawn = draws.select(F.pmod(half, F.lit(n)).alias("_i")).groupBy("_i").agg(F.count("*").alias("times"))
    return units.join(drawn, "_i").select(unit, "times")


def minibatches(rows: DataFrame, row: str, bucket, seed: int, per_bucket: int, epoch: int = 0) -> DataFrame:
    """rows with ``bucket`` and ``batch``: inside each bucket, hash order in runs of ``per_bucket``; another order every epoch.

    Places come from range partitions, less the first place of the bucket, so no task holds a whole bucket.
    """
    from .sparse import ranked_within

    h = with_row_hash(rows.withColumn("bucket", bucket), "_h", F.col(row), seed ^ (epoch << 32)).withColumn("_h", unsigned_order(F.col("_h")))
    return ranked_within(h, "bucket", [F.col("_h")], "_i", row).withColumn("batch", F.floor(F.col("_i") / per_bucket)).drop("_h", "_i")


def batch_with_replacement(rows: DataFrame, row: str, seed: int, draws: int) -> DataFrame:
    """(draw, row): uniform draws with replacement."""
    from .sparse import ranked

    ids = ranked(rows.select(row), [F.col(row)], "_i", row)
    n = ids.count()
    d = with_splitmix(rows.sparkSession.range(draws).withColumnRenamed("id", "draw"), "_h", F.col("draw").bitwiseXOR(F.lit(signed(splitmix(seed)))))
    return d.select("draw", F.pmod(F.shiftrightunsigned("_h", 1), F.lit(n)).alias("_i")).join(ids, "_i").select("draw", row)


def unit_position(h) -> "F.Column":
    """The hash as a share of 2^64."""
    return unsigned_decimal(h).cast("double") / float(1 << 64)


def degree_preserving_null(edges: DataFrame, left: str, right: str, seed: int, rounds: int = 4, block_edges: int = 100_000) -> DataFrame:
    """A random bipartite graph of the same degrees by double-edge swaps that make no edge twice; null ends take no part.

    In every round both kinds of nodes fall into groups by hash, anew each time, and the edges between two groups are one
    block. A swap of two edges of a block gives edges of that block, so whether one exists already is known within it, and
    blocks are independent of one another. There are as many groups as keep a block at about ``block_edges``, also where a node
    has very many edges, since those are spread over the groups of the other side. A round tries as many swaps as there
    are edges.
    """
    kinds = f"{left} {edges.schema[left].dataType.simpleString()}, {right} {edges.schema[right].dataType.simpleString()}"

    def swap_in(turn: int):
        def run(key, table):
            import pyarrow as pa

            rng = np.random.default_rng([seed & (2**63 - 1), turn, *(k.as_py() for k in key)])
            a, b = table.column(left).to_numpy(), table.column(right).to_numpy()
            order = np.lexsort((b, a))
            a, b = a[order].tolist(), b[order].tolist()
            have = set(zip(a, b))
            for i, j in rng.integers(0, len(a), (len(a), 2)).tolist():
                one, two = (a[i], b[j]), (a[j], b[i])
                if one in have or two in have:  # so it is too where both edges share an end
                    continue
                have.difference_update(((a[i], b[i]), (a[j], b[j])))
                have.update((one, two))
                b[i], b[j] = b[j], b[i]
            return pa.table([pa.array(a), pa.array(b)], names=[left, right])

        return run

    state = cut(edges.select(left, right).where(F.col(left).isNotNull() & F.col(right).isNotNull()).distinct())
    groups = max(1, int(np.ceil(np.sqrt(state.count() / block_edges))))
    for turn in range(rounds):
        group = lambda c: F.pmod(F.xxhash64(c, F.lit(seed), F.lit(turn)), F.lit(groups)).alias(f"_{c}")  # noqa: B023, E731
        state = cut(state.select(left, right, group(left), group(right)).groupBy(f"_{left}", f"_{right}").applyInArrow(swap_in(turn), kinds))
    return state
