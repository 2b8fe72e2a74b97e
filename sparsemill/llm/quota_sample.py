"""Problem 6: samples whose shares by category match given targets.

One pass over the distinct records keeps, of every group and category, an exact count and a mergeable reservoir: the records
of lowest hash, as many as a quota can be. Every task reduces its rows to that before anything else is done, and the reservoirs of
the tasks are merged by ranks over ranges of the hash, so that no task ever holds a hot category. The final counts then
give feasible quotas (at least the minimum, at most what is available, the rest by largest remainder), to which the
reservoirs are trimmed; what falls short is reported.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._work import cut
from .stable_sample import unit_hash

BUFFERED = 500_000  # rows that a task adds to its reservoirs at a time


def plain_name(c: Column) -> Column:
    """Lower case, runs of blanks, underscores and hyphens as one blank, none at the ends."""
    return F.btrim(F.regexp_replace(F.lower(c), r"[\s_\-]+", " "))


def available(records: DataFrame, group: str, category: str, record: str) -> DataFrame:
    """Distinct (_g, _c, _r) of the records; repeated deliveries are one."""
    return (
        records.where(F.col(record).isNotNull() & F.col(group).isNotNull() & F.col(category).isNotNull())
        .select(F.col(group).alias("_g"), plain_name(F.col(category)).alias("_c"), F.col(record).alias("_r"))
        .distinct()
    )


def _reservoir_task(most: int):
    """Rows (_g, _c, _r, _u) of a task -> per (_g, _c) a row with its count, and the ``most`` rows of lowest (_u, _r)."""

    def run(batches):
        import pyarrow as pa
        import pyarrow.compute as pc

        def reduced(tables):
            t = pa.concat_tables(tables).combine_chunks()
            code = np.zeros(t.num_rows, np.int64)
            for c in ("_g", "_c"):
                d = t.column(c).combine_chunks().dictionary_encode()
                code = code * (len(d.dictionary) + 1) + d.indices.to_numpy()
            order = pc.sort_indices(t.append_column("_k", pa.array(code)), [("_k", "ascending"), ("_u", "ascending"), ("_r", "ascending")]).to_numpy()
            k = code[order]
            head = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
            rank = np.arange(len(k)) - np.repeat(head, np.diff(np.append(head, len(k))))
            return t.take(pa.array(order[rank < most]))

        held, counts, buffered = [], [], 0
        for b in batches:
            if b.num_rows:
                t = pa.Table.from_batches([b])
                held.append(t)
                counts.append(t.group_by(["_g", "_c"], use_threads=False).aggregate([([], "count_all")]))
                buffered += b.num_rows
            if buffered >= BUFFERED:
                held, buffered = [reduced(held)], 0
                counts = [pa.concat_tables(counts).group_by(["_g", "_c"], use_threads=False).aggregate([("count_all", "sum")]).rename_columns(["_g", "_c", "count_all"])]
        if held:
            rows = reduced(held)
            n = pa.concat_tables(counts).group_by(["_g", "_c"], use_threads=False).aggregate([("count_all", "sum")])
            none = lambda m, c: pa.nulls(m, rows.schema.field(c).type)
            yield from rows.append_column("_n", pa.nulls(rows.num_rows, pa.int64())).select(["_g", "_c", "_r", "_u", "_n"]).to_batches()
            m = n.num_rows
            yield from pa.table([n.column("_g"), n.column("_c"), none(m, "_r"), none(m, "_u"), n.column("count_all_sum")], names=["_g", "_c", "_r", "_u", "_n"]).to_batches()

    return run


def reservoirs(records: DataFrame, targets: DataFrame, group: str, category: str, record: str, salt: str = "") -> DataFrame:
    """The state that report and sample are made from, one pass: rows (_g, _c, _n) with the number of records that a task saw,
    and rows (_g, _c, _r, _u) of its reservoirs. States of parts with different records are merged by union.

    A reservoir holds as many as the largest quota that the targets allow, whatever that is.
    """
    wish = F.coalesce(F.col("target_share") * F.col("requested_rows"), F.lit(0.0))
    # no quota is above its minimum, or one more than its wish
    most = targets.agg(F.max(F.greatest(F.coalesce(F.col("min_rows").cast("long"), F.lit(0)), F.floor(wish) + 1))).first()[0] or 0
    rows = available(records, group, category, record).withColumn("_u", unit_hash(F.col("_r"), salt))
    kind = rows.schema
    return cut(rows.mapInArrow(_reservoir_task(int(most)), f"_g {kind['_g'].dataType.simpleString()}, _c string, _r {kind['_r'].dataType.simpleString()}, _u double, _n long"))


def target_report(
    records: DataFrame, targets: DataFrame, group: str = "dataset_id", category: str = "stratum", record: str = "cell_id", state: DataFrame | None = None, fill: bool = False
) -> DataFrame:
    """Per row of ``targets``: available, needed, quota, short and met.

    ``targets`` (group, category, target_share, min_rows, requested_rows). needed is max(min_rows, share * requested),
    met says whether that many are available. Quotas are whole: the larger of min_rows and the whole part of
    share * requested, at most what is available; then one more to the largest remainders while the group is below its
    request. While it is above, the categories above their minimum give up in proportion, each the next whole number, so
    that the sum may end a few below the request; with ``fill`` each gives up the whole part and those of largest
    remainder one more, so that it ends on it. Null shares and minimums are 0. Records with null key, group or category
    are available nowhere. Target rows without records have available 0; groups of records without targets do not come
    out. ``state``: of ``reservoirs``, if it is at hand.
    """
    state = reservoirs(records, targets, group, category, record) if state is None else state
    t = targets.select(
        F.col(group).alias("_g"), F.col(category).alias("_name"), plain_name(F.col(category)).alias("_c"), F.coalesce(F.col("target_share").cast("double"), F.lit(0.0)).alias("target_share"),
        F.coalesce(F.col("min_rows").cast("long"), F.lit(0)).alias("min_rows"), F.coalesce(F.col("requested_rows").cast("long"), F.lit(0)).alias("requested_rows"),
    )
    counts = state.where("_n is not null").groupBy("_g", "_c").agg(F.sum("_n").alias("available"))
    r = t.join(counts, ["_g", "_c"], "left").withColumn("available", F.coalesce("available", F.lit(0)))
    wish = F.col("target_share") * F.col("requested_rows")
    r = r.withColumn("needed", F.greatest(F.col("min_rows").cast("double"), wish)).withColumn("met", F.col("available") >= F.col("needed"))
    # quotas: floors first, then remainders, ranked inside the group; a group has as many rows here as it has categories
    r = r.withColumn("_low", F.least(F.col("min_rows"), "available")).withColumn("_base", F.least(F.greatest("min_rows", F.floor(wish)), "available"))
    by = Window.partitionBy("_g")
    r = r.withColumn("_free", F.col("requested_rows") - F.sum("_base").over(by))
    room = (F.col("_base") < F.col("available")) & (F.col("target_share") > 0) & (F.floor(wish) < wish) & (F.col("_base") == F.floor(wish))
    rest = F.when(room, wish - F.floor(wish)).otherwise(-1.0)
    r = r.withColumn("_rest", rest).withColumn("_rank", F.row_number().over(by.orderBy(F.desc("_rest"), "_c")))
    up = ((F.col("_rest") > 0) & (F.col("_rank") <= F.col("_free"))).cast("long")
    spare = F.col("_base") - F.col("_low")
    over = F.greatest(-F.col("_free"), F.lit(0))
    if fill:
        part = spare * F.least(over, F.sum(spare).over(by)) / F.greatest(F.sum(spare).over(by), F.lit(1))
        r = r.withColumn("_part", part).withColumn("_over", F.least(over, F.sum(spare).over(by)))
        r = r.withColumn("_left", F.col("_over") - F.sum(F.floor("_part")).over(by))
        last = F.row_number().over(by.orderBy(F.desc(F.col("_part") - F.floor("_part")), "_c"))
        give = F.floor("_part") + (last <= F.col("_left")).cast("long")
    else:
        give = F.when(over > 0, F.least(spare, F.ceil(spare * over / F.greatest(F.sum(spare).over(by), F.lit(1))))).otherwise(0)
    r = r.withColumn("quota", F.col("_base") + up - give)
    r = r.withColumn("short", F.greatest(F.ceil("needed") - F.col("available"), F.lit(0)))
    return r.select(F.col("_g").alias(group), F.col("_name").alias(category), "target_share", "min_rows", "requested_rows", "available", "needed", "quota", "short", "met")


def quota_sample(records: DataFrame, targets: DataFrame, group: str = "dataset_id", category: str = "stratum", record: str = "cell_id", salt: str = "", fill: bool = False) -> DataFrame:
    """(group, category, record, unit_hash) of the sample: in every category its quota of records of lowest hash.

    A record with several categories in a group can be drawn for each. Ties of the hash are broken by the record.
    """
    state = reservoirs(records, targets, group, category, record, salt)
    report = target_report(records, targets, group, category, record, state, fill)
    quotas = report.select(F.col(group).alias("_g"), plain_name(F.col(category)).alias("_c"), F.col(category).alias("_name"), "quota")
    # ranges of the hash, ever narrower towards 0: 64 from each power of two to the next
    power = F.floor(F.log2(F.greatest("_u", F.lit(2.0**-52))))
    pool = state.where("_n is null").withColumn("_b", (power * 64 + F.floor((F.col("_u") / F.pow(F.lit(2.0), power) - 1) * 64)).cast("int"))
    upto = Window.partitionBy("_g", "_c").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    ranges = pool.groupBy("_g", "_c", "_b").agg(F.count("*").alias("_k")).withColumn("_below", F.coalesce(F.sum("_k").over(upto), F.lit(0)))
    ranges = ranges.join(quotas, ["_g", "_c"]).where("_below < quota").select("_g", "_c", "_b", "_below", "_name", "quota")
    ranked = pool.join(ranges, ["_g", "_c", "_b"]).withColumn("_i", F.col("_below") + F.row_number().over(Window.partitionBy("_g", "_c", "_b").orderBy("_u", "_r")))
    return ranked.where("_i <= quota").select(F.col("_g").alias(group), F.col("_name").alias(category), F.col("_r").alias(record), F.col("_u").alias("unit_hash"))
