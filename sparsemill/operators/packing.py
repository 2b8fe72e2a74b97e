"""Packing analytics: plans, tiles, block records, local orders, layout choices.

A plan is a table (gene_id, block, local, position); a matrix stays a long table, and every packed form is a grouping of it.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.hashing import signed, splitmix, splitmix_column, unsigned_order


def width_plan(features: DataFrame, width: int, order: list, key: str = "gene_id") -> DataFrame:
    """Features in an order, cut into blocks of ``width``: (gene_id, block, local, position)."""
    from .sparse import ranked

    p = ranked(features.select(key, *[c for c in features.columns if c != key]), order, "position", key)
    return p.select(key, F.floor(F.col("position") / width).alias("block"), F.pmod("position", F.lit(width)).alias("local"), "position")


def apply_plan(entries: DataFrame, plan: DataFrame, row: str = "cell_id", col: str = "gene_id", domain: str = "full") -> DataFrame:
    """(row, block, local, value, slot): entries keyed by (block, local), numbered in that order inside each row.

    A plan whose domain is a sample does not cover the matrix and is refused.
    """
    if domain != "full":
        raise ValueError("a plan over a sampled domain cannot be applied")
    e = entries.join(plan.select(col, "block", "local"), col).select(row, "block", "local", "value")
    return e.withColumn("slot", F.row_number().over(Window.partitionBy(row).orderBy("block", "local")) - 1)


def tile_occupancy(entries: DataFrame, plan: DataFrame, groups: DataFrame, row: str = "cell_id", col: str = "gene_id") -> DataFrame:
    """Per (row group, feature block) with entries: nnz, rows, slots, padding, density and participation.

    groups (row, row_group). Rows are counted by (tile, row) before (tile), so a hot tile is reduced on the way.
    """
    blocks = plan.groupBy("block").agg(F.count("*").alias("block_features"))
    sizes = groups.groupBy("row_group").agg(F.count("*").alias("group_rows"))
    e = entries.join(plan.select(col, "block"), col).join(groups, row).groupBy("row_group", "block", row).agg(F.count("*").alias("n"))
    t = e.groupBy("row_group", "block").agg(F.sum("n").alias("nnz"), F.count("*").alias("rows")).join(blocks, "block").join(sizes, "row_group")
    t = t.withColumn("slots", F.col("group_rows") * F.col("block_features"))
    return t.select("row_group", "block", "nnz", "rows", "slots", (F.col("slots") - F.col("nnz")).alias("padding"), (F.col("nnz") / F.col("slots")).alias("density"), (F.col("rows") / F.col("group_rows")).alias("participation"))


def distribution(c: str, name: str) -> list[Column]:
    return [F.count(c).alias(f"{name}_n"), F.min(c).alias(f"{name}_min"), F.max(c).alias(f"{name}_max"), F.sum(c).alias(f"{name}_sum"), F.sum(F.col(c) * F.col(c)).alias(f"{name}_sq")]


def merge_distributions(a: dict, b: dict) -> dict:
    """Of two distributions (n, min, max, sum, sq), that of both together; an empty one changes nothing."""
    if not a["n"] or not b["n"]:
        return dict(b if not a["n"] else a)
    return {"n": a["n"] + b["n"], "min": min(a["min"], b["min"]), "max": max(a["max"], b["max"]), "sum": a["sum"] + b["sum"], "sq": a["sq"] + b["sq"]}


def occupancy_summary(tiles: DataFrame, groups: int, blocks: int) -> DataFrame:
    """Totals over tiles and the distribution of entries per occupied tile."""
    return tiles.agg(
        F.count("*").alias("occupied_tiles"), F.sum("nnz").alias("nnz"), F.sum("slots").alias("dense_slots"), F.sum("padding").alias("padding"), F.sum("rows").alias("row_block_references"),
        F.min("nnz").alias("nnz_min"), F.max("nnz").alias("nnz_max"), F.sum(F.col("nnz") * F.col("nnz")).alias("nnz_sq"),
    ).withColumn("empty_tiles", F.lit(groups * blocks) - F.col("occupied_tiles"))


@dataclass(frozen=True)
class CostModel:
    value_bytes: int = 2
    index_bytes: int = 0
    tile_bytes: int = 16
    row_block_bytes: int = 4
    group_bytes: int = 8
    dense_values: bool = False
    byte_weight: float = 1.0
    tile_weight: float = 0.0
    row_block_weight: float = 0.0


def packing_cost(summary: DataFrame, groups: int, m: CostModel = CostModel()) -> DataFrame:
    """summary with total_bytes and the weighted score."""
    slots = F.col("dense_slots") if m.dense_values else F.col("nnz")
    total = slots * m.value_bytes + F.col("nnz") * m.index_bytes + F.col("occupied_tiles") * m.tile_bytes + F.col("row_block_references") * m.row_block_bytes + groups * m.group_bytes
    score = m.byte_weight * total + m.tile_weight * F.col("occupied_tiles") + m.row_block_weight * F.col("row_block_references")
    return summary.withColumn("total_bytes", total).withColumn("score", score.cast("double"))


def block_records(entries: DataFrame, plan: DataFrame, row: str = "cell_id", col: str = "gene_id") -> DataFrame:
    """(row, block, mask, values): one record a row and block, bit l for local feature l, values in bit order."""
    e = entries.join(plan.select(col, "block", "local"), col)
    packed = F.array_sort(F.collect_list(F.struct("local", "value")))  # as many as a block has features
    r = e.groupBy(row, "block").agg(F.bit_or(F.expr("shiftleft(1L, cast(local as int))")).alias("mask"), packed.alias("v"))
    return r.select(row, "block", "mask", F.col("v.value").alias("values"))


def decode_records(records: DataFrame, plan: DataFrame, width: int, row: str = "cell_id", col: str = "gene_id") -> DataFrame:
    """The entries of block records."""
    locals_ = F.filter(F.sequence(F.lit(0), F.lit(width - 1)), lambda b: F.bit_get(F.col("mask"), b) == 1)
    e = records.select(row, "block", F.explode(F.arrays_zip(locals_.alias("local"), F.col("values"))).alias("z")).select(row, "block", F.col("z")["local"].cast("long").alias("local"), F.col("z")["values"].alias("value"))
    return e.join(plan.select(col, "block", "local"), ["block", "local"]).select(row, col, "value")


def local_order(records: DataFrame, kind: str, window: int, seed: int, row: str = "cell_id") -> DataFrame:
    """(row, window, place): rows sorted inside windows of consecutive rows.

    kind: 'minhash' (four lanes of sixteen bits over the row's blocks), 'original', 'random', or 'nnz_desc'; keys are
    unsigned, then the number of blocks, then the row. Rows are numbered by ``row`` itself, from 0.
    """
    rows = records.groupBy(row).agg(F.collect_list("block").alias("blocks"), F.count("*").alias("active"), F.sum(F.size("values")).alias("nnz"))
    second = F.col("active")
    if kind == "minhash":
        lanes = [signed(splitmix(seed ^ (lane << 32))) for lane in range(4)]
        mix = splitmix_column()
        flat = records.select(row, F.col("block").cast("long").alias("b"))
        mins = flat.groupBy(row).agg(*(F.min(unsigned_order(mix(F.col("b").bitwiseXOR(F.lit(s))))).alias(f"m{i}") for i, s in enumerate(lanes)))
        top = [F.shiftrightunsigned(unsigned_order(F.col(f"m{i}")), 48) for i in range(4)]
        key = F.shiftleft(top[0], 48).bitwiseOR(F.shiftleft(top[1], 32)).bitwiseOR(F.shiftleft(top[2], 16)).bitwiseOR(top[3])
        rows = rows.join(mins.select(row, unsigned_order(key).alias("primary")), row)
    elif kind == "original":
        rows, second = rows.withColumn("primary", F.col(row)), F.lit(0)
    elif kind == "random":
        rows, second = rows.withColumn("primary", unsigned_order(splitmix_column()(F.col(row).bitwiseXOR(F.lit(signed(seed)))))), F.lit(0)
    elif kind == "nnz_desc":
        rows = rows.withColumn("primary", -F.col("nnz"))
    else:
        raise ValueError(kind)
    out = rows.withColumn("window", F.floor(F.col(row) / window))
    place = F.row_number().over(Window.partitionBy("window").orderBy("primary", second, row)) - 1
    return out.select(row, "window", "active", "nnz", place.alias("place"))


def order_metrics(order: DataFrame, records: DataFrame, width: int = 32, row: str = "cell_id") -> DataFrame:
    """Distinct blocks of every group of ``width`` ordered rows: groups, their sum, the most, and bytes at four each."""
    g = records.select(row, "block").join(order.select(row, "window", F.floor(F.col("place") / width).alias("g")), row)
    per = g.select("window", "g", "block").distinct().groupBy("window", "g").agg(F.count("*").alias("n"))
    return per.agg(F.count("*").alias("groups"), F.sum("n").alias("blocks"), F.max("n").alias("most"), (4 * F.sum("n")).alias("bytes"))


def coordinates(entries: DataFrame, plan: DataFrame, groups: DataFrame, group_rows: int, row: str = "cell_id", col: str = "gene_id") -> DataFrame:
    """Entries by permuted coordinates: the region (row_group, block) that holds them and their place in it."""
    e = entries.join(plan.select(col, "block", "local"), col).join(groups.select(row, "row_group"), row)
    return e.select("row_group", "block", (F.col(row) - F.col("row_group") * group_rows).alias("local_row"), "local", "value")


def from_coordinates(placed: DataFrame, plan: DataFrame, group_rows: int, row: str = "cell_id", col: str = "gene_id") -> DataFrame:
    """The entries of permuted coordinates: the inverse of ``coordinates``. A place without a feature is an error of the plan and
    drops out."""
    return placed.join(plan.select(col, "block", "local"), ["block", "local"]).select((F.col("row_group") * group_rows + F.col("local_row")).alias(row), col, "value")


def decode_tiles(tiles: DataFrame, order: DataFrame, plan: DataFrame, width: int, lanes: int = 32, row: str = "cell_id", col: str = "gene_id") -> DataFrame:
    """The entries of tiles that hold values: every lane's record, of the row that the order puts there."""
    e = tiles.select("window", "tile", "block", F.explode("entries").alias("e")).select("window", (F.col("tile") * lanes + F.col("e.lane")).alias("place"), "block", F.col("e.mask").alias("mask"), F.col("e.values").alias("values"))
    return decode_records(e.join(order.select(row, "window", "place"), ["window", "place"]).select(row, "block", "mask", "values"), plan, width, row, col)


def compare_entries(stored: DataFrame, decoded: DataFrame, keys: list[str]) -> DataFrame:
    """One row: entries that agree exactly, that differ in value, that are missing from ``decoded``, and that it has besides."""
    both = stored.select(*keys, F.col("value").alias("_s"), F.lit(1).alias("_a")).join(decoded.select(*keys, F.col("value").alias("_d"), F.lit(1).alias("_b")), keys, "full")
    return both.agg(
        F.count_if(F.col("_a").isNotNull() & F.col("_b").isNotNull() & F.col("_s").eqNullSafe(F.col("_d"))).alias("exact"), F.count_if(F.col("_a").isNotNull() & F.col("_b").isNotNull() & ~F.col("_s").eqNullSafe(F.col("_d"))).alias("differing"),
        F.count_if(F.col("_b").isNull()).alias("missing"), F.count_if(F.col("_a").isNull()).alias("added"),
    )


def warp_tiles(records: DataFrame, order: DataFrame, lanes: int = 32, row: str = "cell_id", values: bool = False) -> DataFrame:
    """(window, tile, block, cell_mask, entries, nnz): ordered rows in tiles of ``lanes`` by block; entries (lane, gene mask), with
    ``values`` also the values in bit order."""
    e = records.join(order.select(row, "window", F.floor(F.col("place") / lanes).alias("tile"), F.pmod("place", F.lit(lanes)).alias("lane")), row)
    packed = F.array_sort(F.collect_list(F.struct("lane", "mask", *(["values"] if values else []))))  # at most one a lane
    return e.groupBy("window", "tile", "block").agg(F.bit_or(F.expr("shiftleft(1L, cast(lane as int))")).alias("cell_mask"), packed.alias("entries"), F.sum(F.size("values")).alias("nnz"))


def tile_metrics(tiles: DataFrame, value_bytes: int = 2) -> DataFrame:
    """Counts and bytes: 12 a tile and block (id, mask, offset), 8 an entry (mask, offset), and the values."""
    return tiles.agg(
        F.countDistinct("window", "tile").alias("tiles"), F.count("*").alias("tile_blocks"), F.sum(F.size("entries")).alias("row_block_entries"), F.sum("nnz").alias("nnz"),
        (12 * F.count("*") + 8 * F.sum(F.size("entries"))).alias("metadata_bytes"), (value_bytes * F.sum("nnz")).alias("value_bytes"),
    )


def tile_statistics(tiles: DataFrame, blocks: DataFrame) -> DataFrame:
    """Means over tile blocks of occupancy, feature reuse and lane imbalance, and the number of dense fragments.

    blocks (block, block_features). A fragment is dense from sixteen slots and half of them filled.
    """
    lanes = F.transform("entries", lambda e: F.bit_count(e["mask"]))
    t = tiles.join(blocks, "block").withColumns({
        "rows": F.bit_count("cell_mask"), "union": F.bit_count(F.aggregate("entries", F.lit(0).cast("long"), lambda a, e: a.bitwiseOR(e["mask"]))),
        "spread": F.array_max(lanes) - F.array_min(lanes),
    })
    t = t.withColumn("capacity", F.col("rows") * F.col("block_features")).withColumn("occupancy", F.col("nnz") / F.col("capacity"))
    return t.agg(
        F.avg("occupancy").alias("mean_occupancy"), F.avg(F.col("nnz") / F.col("union")).alias("mean_reuse"), F.avg("spread").alias("mean_imbalance"),
        F.count_if((F.col("capacity") >= 16) & (F.col("occupancy") >= 0.5)).alias("dense_fragments"),
    )


def row_nnz_histogram(rows: DataFrame, nnz: str, edges: list[int]) -> DataFrame:
    """(bucket, rows): rows by the number of edges their count reaches."""
    bucket = sum(((F.col(nnz) >= e).cast("int") for e in edges), F.lit(0))
    return rows.groupBy(bucket.alias("bucket")).agg(F.count("*").alias("rows"))


def layout_metrics(entries: DataFrame, regions: DataFrame, slice_rows: int = 2, align: int = 1, value_bytes: int = 4, index_bytes: int = 4, output_columns: int = 1) -> DataFrame:
    """Slots, fill ratios and bytes of each region in four layouts.

    entries (region, local_row); regions (region, role, rows, features). Rows without entries count with width 0.
    """
    w = entries.groupBy("region", "local_row").agg(F.count("*").alias("width"))
    slices = w.groupBy("region", F.floor(F.col("local_row") / slice_rows).alias("s")).agg(F.max("width").alias("m")).join(regions, "region")
    tall = F.least(F.lit(slice_rows).cast("long"), F.col("rows") - F.col("s") * slice_rows)
    sliced = slices.groupBy("region").agg(F.sum(F.col("m") * tall).alias("sliced_slots"))
    m = w.groupBy("region").agg(F.sum("width").alias("nnz"), F.count("*").alias("_r"), F.min("width").alias("_min"), F.max("width").alias("max_width"), F.sum(F.col("width") * F.col("width")).alias("width_sq"))
    m = regions.join(m, "region", "left").join(sliced, "region", "left").na.fill(0, ["nnz", "_r", "_min", "max_width", "width_sq", "sliced_slots"])
    m = m.withColumn("min_width", F.when(F.col("_r") < F.col("rows"), 0).otherwise(F.col("_min"))).drop("_r", "_min")
    m = m.withColumn("blocked_slots", F.ceil(F.col("max_width") / align) * align * F.col("rows")).withColumn("dense_slots", F.col("rows") * F.col("features"))
    ratio = lambda c: F.when(F.col(c) > 0, F.col("nnz") / F.col(c)).otherwise(0.0)
    out = F.col("rows") * (output_columns * value_bytes)
    return m.withColumns({
        "blocked_fill": ratio("blocked_slots"), "sliced_fill": ratio("sliced_slots"), "dense_fill": ratio("dense_slots"),
        "csr_bytes": (F.col("nnz") + F.col("rows") + 1) * index_bytes + F.col("nnz") * value_bytes + out, "blocked_bytes": F.col("blocked_slots") * (index_bytes + value_bytes) + out,
        "sliced_bytes": F.col("sliced_slots") * (index_bytes + value_bytes) + out, "dense_bytes": F.col("dense_slots") * value_bytes + out,
    })


def select_layout(metrics: DataFrame) -> DataFrame:
    """metrics with the layout chosen: dense, then blocked, then sliced where each pays, else rows (thresholds are fixed values)."""
    structured = (F.col("role") != "residual") & (F.col("nnz") >= 16) & (F.col("rows") >= 2)
    limit = 0.95 * F.col("csr_bytes")
    choice = (
        F.when(~structured, "csr").when((F.col("dense_fill") >= 0.72) & (F.col("dense_bytes") <= F.col("csr_bytes")), "dense")
        .when((F.col("blocked_fill") >= 0.55) & (F.col("blocked_bytes") <= limit) & (F.col("blocked_bytes") <= F.col("sliced_bytes")), "blocked")
        .when((F.col("sliced_fill") >= 0.45) & (F.col("sliced_bytes") <= limit), "sliced").otherwise("csr")
    )
    return metrics.withColumn("layout", choice)


def static_plan(entries: DataFrame, modules: DataFrame, min_primary_rows: int, row: str = "cell_id", col: str = "gene_id") -> tuple[DataFrame, DataFrame]:
    """(rows with their group, regions): rows grouped by the set of modules they use.

    modules (gene_id, module), null for the residual. Regions: one a (group, module), conditional where the group has
    fewer than min_primary_rows rows, else primary, and one residual region over all rows.
    """
    used = entries.join(modules.where("module is not null"), col).select(row, "module").distinct()
    sig = used.groupBy(row).agg(F.array_join(F.transform(F.array_sort(F.collect_list("module")), lambda m: F.lpad(m.cast("string"), 6, "0")), ",").alias("signature"))
    groups = sig.groupBy("signature").agg(F.count("*").alias("rows"))
    regions = groups.select("signature", "rows", F.explode(F.split("signature", ",")).alias("module"))
    regions = regions.select("signature", F.col("module").cast("int").alias("module"), "rows", F.when(F.col("rows") < min_primary_rows, "conditional").otherwise("primary").alias("role"))
    residual = entries.select(row).distinct().agg(F.count("*").alias("rows")).select(F.lit("").alias("signature"), F.lit(None).cast("int").alias("module"), "rows", F.lit("residual").alias("role"))
    return sig, regions.unionAll(residual)


def route_mask(regions: DataFrame, scenario: str, microbatch: int = 0) -> Column:
    """Whether a region is active in a scenario; discarded ones never are."""
    role = F.col("role")
    active = {
        "all": F.lit(True), "alternating": (role != "residual") & (F.pmod("module", F.lit(2)) == microbatch % 2), "conditional": role == "conditional",
        "dense": F.col("layout") == "dense", "skip_residual": role != "residual",
    }[scenario]
    return F.coalesce((role != "discarded") & active, F.lit(False))


def metric_rates(m: DataFrame) -> DataFrame:
    """Bytes and slots per entry, compression, blocks per row and tile; null where the divisor is 0."""
    per = lambda a, b: F.col(a) / F.nullif(F.col(b), F.lit(0))
    return m.select(
        per("encoded_bytes", "nnz").alias("encoded_bytes_per_nnz"), per("metadata_bytes", "nnz").alias("metadata_bytes_per_nnz"), per("baseline_bytes", "encoded_bytes").alias("compression_ratio"),
        per("padding_slots", "nnz").alias("padding_per_nnz"), per("active_blocks", "rows").alias("active_blocks_per_row"), per("tile_blocks", "tiles").alias("tile_blocks_per_tile"),
    )
