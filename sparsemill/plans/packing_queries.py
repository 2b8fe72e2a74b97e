"""Packing analytics (21-22, 46, 61-64, 90-94, 132, 134-137)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.hashing import splitmix, sql_splitmix
from ..operators import packing
from ..sources.tables import EXPRESSION, cells, expression, features
from .catalog import query

WIDTH, GROUP, WINDOW, SEED = 32, 256, 1024, 9
PLAN = f"""p as (select gene_id, position // {WIDTH} as block, position % {WIDTH} as local, position
  from (select gene_id, row_number() over (order by gene_id % 17, gene_id) - 1 as position from genes))"""
GROUPS = f"gr as (select distinct cell_id, cell_id // {GROUP} as row_group from cells)"
TILES = f"""t as (
  select row_group, block, sum(n)::bigint as nnz, count(*) as n_rows, any_value(group_rows * block_features) as slots, any_value(group_rows) as group_rows
  from (select row_group, block, cell_id, count(*) as n from e join p using (gene_id) join gr using (cell_id) group by all)
  join (select row_group, count(*) as group_rows from gr group by 1) using (row_group) join (select block, count(*) as block_features from p group by 1) using (block) group by row_group, block)"""
RECORDS = "rec as (select cell_id, block, sum(1::bigint << local::int)::bigint as mask, list(value order by local) as vals, count(*) as n from e join p using (gene_id) group by 1, 2)"
BASE = f"with {EXPRESSION}, {PLAN}"


def plan(spark, d):
    return packing.width_plan(features(spark, d).select("gene_id"), WIDTH, [F.col("gene_id") % 17])


def groups(spark, d):
    return cells(spark, d).select("cell_id", F.floor(F.col("cell_id") / GROUP).alias("row_group"))


def records(spark, d):
    return packing.block_records(expression(spark, d), plan(spark, d))


@query("q046_applied_plan", f"{BASE} select cell_id, block, local, value, row_number() over (partition by cell_id order by block, local) - 1 as slot from e join p using (gene_id)")
def q046(spark, d):
    """Entries keyed by block and local feature."""
    return packing.apply_plan(expression(spark, d), plan(spark, d))


@query("q061_tile_occupancy", f"{BASE}, {GROUPS}, {TILES} select row_group, block, nnz, n_rows as rows, slots, slots - nnz as padding, round(nnz / slots, 12) as density, round(n_rows / group_rows, 12) as participation from t")
def q061(spark, d):
    """Occupancy of every tile of row group and feature block."""
    t = packing.tile_occupancy(expression(spark, d), plan(spark, d), groups(spark, d))
    return t.withColumns({"density": F.round("density", 12), "participation": F.round("participation", 12)})


_COST = f"""{BASE}, {GROUPS}, {TILES}, n as (select (select count(distinct row_group) from gr) as g, (select count(distinct block) from p) as b),
  u as (select count(*) as occupied_tiles, sum(nnz)::bigint as nnz, sum(slots)::bigint as dense_slots, sum(slots - nnz)::bigint as padding, sum(n_rows)::bigint as row_block_references,
    min(nnz) as nnz_min, max(nnz) as nnz_max, sum(nnz * nnz)::bigint as nnz_sq from t)"""


def _summary(spark, d):
    g, b = groups(spark, d).agg(F.countDistinct("row_group")).first()[0], plan(spark, d).agg(F.countDistinct("block")).first()[0]
    return packing.occupancy_summary(packing.tile_occupancy(expression(spark, d), plan(spark, d), groups(spark, d)), g, b), g


@query("q062_packing_cost", f"{_COST} select occupied_tiles, nnz, dense_slots, padding, row_block_references, nnz_min, nnz_max, nnz_sq, g * b - occupied_tiles as empty_tiles, nnz * 2 + occupied_tiles * 16 + row_block_references * 4 + g * 8 as total_bytes, (nnz * 2 + occupied_tiles * 16 + row_block_references * 4 + g * 8)::double as score from u, n")
def q062(spark, d):
    """Totals of a plan and its weighted bytes."""
    s, g = _summary(spark, d)
    return packing.packing_cost(s, g)


@query("q063_merged_distributions", f"{BASE}, {GROUPS}, {TILES} select count(*) as n, min(nnz) as min, max(nnz) as max, sum(nnz)::bigint as sum, sum(nnz * nnz)::bigint as sq from t")
def q063(spark, d):
    """Entries per tile: the distributions of four parts merged."""
    t = packing.tile_occupancy(expression(spark, d), plan(spark, d), groups(spark, d))
    parts = [{k: r[f"x_{k}"] for k in ("n", "min", "max", "sum", "sq")} for r in t.groupBy(F.pmod("block", F.lit(4)).alias("part")).agg(*packing.distribution("nnz", "x")).collect()]
    one = parts[0]
    for p in parts[1:]:
        one = packing.merge_distributions(one, p)
    return spark.createDataFrame([(one["n"], one["min"], one["max"], one["sum"], one["sq"])], "n long, min long, max long, sum long, sq long")


@query("q091_block_records", f"{BASE}, {RECORDS} select cell_id, block, mask, vals as values from rec")
def q091(spark, d):
    """One record a row and block: mask and compact values."""
    return records(spark, d)


@query("q091_decoded_records", f"with {EXPRESSION} select cell_id, gene_id, value from e")
def q091b(spark, d):
    """Records decoded to the entries they came from."""
    return packing.decode_records(records(spark, d), plan(spark, d), WIDTH)


def _sql_order(kind: str) -> str:
    if kind == "minhash":
        q = "(select cell_id, block from rec)"
        for lane in range(4):
            q = "(" + sql_splitmix(q, f"h{lane}", f"xor(block::ubigint, {splitmix(SEED ^ (lane << 32))}::ubigint)") + ")"
        keys = f"(select cell_id, ((min(h0) >> 48) << 48) | ((min(h1) >> 48) << 32) | ((min(h2) >> 48) << 16) | (min(h3) >> 48) as key from {q} group by 1)"
        order = "key, active, cell_id"
    elif kind == "random":
        keys = "(select cell_id, h as key from (" + sql_splitmix("(select distinct cell_id from rec)", "h", f"xor(cell_id::ubigint, {SEED}::ubigint)") + "))"
        order = "key, cell_id"
    else:
        keys = f"(select cell_id, {'-sum(n)' if kind == 'nnz_desc' else 'cell_id'} as key from rec group by 1)"
        order = "key, active, cell_id" if kind == "nnz_desc" else "key, cell_id"
    return f"""{BASE}, {RECORDS}, k as (select * from {keys} join (select cell_id, count(*) as active, sum(n)::bigint as nnz from rec group by 1) using (cell_id)),
      o as (select cell_id, cell_id // {WINDOW} as "window", active, nnz, row_number() over (partition by cell_id // {WINDOW} order by {order}) - 1 as place from k)"""


def _order(spark, d, kind):
    return packing.local_order(records(spark, d), kind, WINDOW, SEED)


for _kind in ("minhash", "original", "random", "nnz_desc"):
    query(f"q090_order_{_kind}", f'{_sql_order(_kind)} select cell_id, "window", active, nnz, place from o')(lambda spark, d, kind=_kind: _order(spark, d, kind))


@query("q064_order_metrics", f"""{_sql_order('minhash')}, x as (select "window", place // 32 as g, count(distinct block) as n from rec join o using (cell_id) group by all)
  select count(*) as groups, sum(n)::bigint as blocks, max(n) as most, (4 * sum(n))::bigint as bytes from x""")
def q064(spark, d):
    """Distinct blocks of groups of ordered rows."""
    return packing.order_metrics(_order(spark, d, "minhash"), records(spark, d))


_TILES = f"""{_sql_order('minhash')}, wt as (
  select "window", place // 32 as tile, block, sum(1::bigint << (place % 32)::int)::bigint as cell_mask, count(*) as entries, sum(n)::bigint as nnz, bit_or(mask) as feature_union,
    max(n) - min(n) as spread from rec join o using (cell_id) group by 1, 2, 3)"""


def _tiles(spark, d):
    return packing.warp_tiles(records(spark, d), _order(spark, d, "minhash"))


@query("q092_warp_tiles", f'{_TILES} select "window", tile, block, cell_mask, entries as n_entries, nnz from wt')
def q092(spark, d):
    """Tiles of thirty-two ordered rows by block."""
    return _tiles(spark, d).select("window", "tile", "block", "cell_mask", F.size("entries").cast("long").alias("n_entries"), "nnz")


@query("q092_tile_metrics", f"""{_TILES} select count(distinct ("window", tile)) as tiles, count(*) as tile_blocks, sum(entries)::bigint as row_block_entries, sum(nnz)::bigint as nnz,
  (12 * count(*) + 8 * sum(entries))::bigint as metadata_bytes, (2 * sum(nnz))::bigint as value_bytes from wt""")
def q092b(spark, d):
    """Counts and bytes of the tiles."""
    return packing.tile_metrics(_tiles(spark, d))


@query("q135_tile_statistics", f"""{_TILES}, b as (select block, count(*) as f from p group by 1)
  select round(avg(nnz / (bit_count(cell_mask) * f)), 9) as mean_occupancy, round(avg(nnz / bit_count(feature_union)), 9) as mean_reuse, round(avg(spread), 9) as mean_imbalance,
    count(*) filter (where bit_count(cell_mask) * f >= 16 and nnz / (bit_count(cell_mask) * f) >= 0.5) as dense_fragments from wt join b using (block)""")
def q135(spark, d):
    """Occupancy, reuse, imbalance and dense fragments of the tiles."""
    t = packing.tile_statistics(_tiles(spark, d), plan(spark, d).groupBy("block").agg(F.count("*").alias("block_features")))
    return t.withColumns({c: F.round(c, 9) for c in ("mean_occupancy", "mean_reuse", "mean_imbalance")})


@query("q135_row_histogram", f"with {EXPRESSION}, n as (select cell_id, count(*) as nnz from e group by 1) select (nnz >= 1)::int + (nnz >= 2)::int + (nnz >= 4)::int + (nnz >= 8)::int + (nnz >= 16)::int + (nnz >= 32)::int + (nnz >= 64)::int as bucket, count(*) as rows from n group by 1")
def q135b(spark, d):
    """Rows by stored entries in eight buckets."""
    return packing.row_nnz_histogram(expression(spark, d).groupBy("cell_id").agg(F.count("*").alias("nnz")), "nnz", [1, 2, 4, 8, 16, 32, 64])


@query("q093_coordinates", f"{BASE}, {GROUPS} select cell_id, gene_id, row_group, block, cell_id - row_group * {GROUP} as local_row, local from e join p using (gene_id) join gr using (cell_id)")
def q093(spark, d):
    """Permuted coordinates with the region that holds them."""
    e = expression(spark, d).join(plan(spark, d), "gene_id").join(groups(spark, d), "cell_id")
    return e.select("cell_id", "gene_id", "row_group", "block", (F.col("cell_id") - F.col("row_group") * GROUP).alias("local_row"), "local")


@query("q093_rebuilt", f"{BASE}, {GROUPS} select cell_id, gene_id, value from e join p using (gene_id) join gr using (cell_id)")
def q093b(spark, d):
    """The entries again from their permuted coordinates."""
    p = plan(spark, d)
    return packing.from_coordinates(packing.coordinates(expression(spark, d), p, groups(spark, d), GROUP), p, GROUP)


@query("q092_decoded", f"{BASE} select cell_id, gene_id, value from e join p using (gene_id)")
def q092c(spark, d):
    """The entries again from tiles that hold their values."""
    r = records(spark, d)
    o = packing.local_order(r, "minhash", WINDOW, SEED)
    return packing.decode_tiles(packing.warp_tiles(r, o, values=True), o, plan(spark, d), WIDTH)


@query("q131_record_check", f"{BASE} select count(*) filter (where gene_id % 10 <> 3) as exact, 0::bigint as differing, count(*) filter (where gene_id % 10 = 3) as missing, 0::bigint as added from e join p using (gene_id)")
def q131b(spark, d):
    """Block records decoded and compared entry by entry, with a tenth of the features withheld, which must come out missing."""
    p = plan(spark, d)
    back = packing.decode_records(records(spark, d), p.where("gene_id % 10 <> 3"), WIDTH)
    return packing.compare_entries(expression(spark, d).join(p.select("gene_id"), "gene_id", "left_semi"), back, ["cell_id", "gene_id"])


_REGIONS = f"""{BASE}, {GROUPS}, c0 as (select row_group * 100000 + block as region, cell_id - row_group * {GROUP} as local_row from e join p using (gene_id) join gr using (cell_id)),
  rg as (select row_group * 100000 + block as region, case when block % 7 = 6 then 'residual' else 'primary' end as role, n_rows, n_features
    from (select row_group, max(cell_id) - row_group * {GROUP} + 1 as n_rows from gr group by 1), (select block, count(*) as n_features from p group by 1)),
  w as (select region, local_row, count(*) as width from c0 group by all),
  sl as (select region, sum(m * least(2, n_rows - s * 2))::bigint as sliced_slots from (select region, local_row // 2 as s, max(width) as m from w group by all) join rg using (region) group by 1),
  m as (select region, role, n_rows, n_features, coalesce(sum(width), 0)::bigint as nnz, coalesce(max(width), 0) as max_width, case when count(width) < n_rows then 0 else min(width) end as min_width,
    coalesce(any_value(sliced_slots), 0) as sliced_slots from rg left join w using (region) left join sl using (region) group by 1, 2, 3, 4),
  y as (select *, max_width * n_rows as blocked_slots, n_rows * n_features as dense_slots, (nnz + n_rows + 1) * 4 + nnz * 4 + n_rows * 4 as csr_bytes, max_width * n_rows * 8 + n_rows * 4 as blocked_bytes,
    sliced_slots * 8 + n_rows * 4 as sliced_bytes, n_rows * n_features * 4 + n_rows * 4 as dense_bytes from m)"""


def _layouts(spark, d):
    e = expression(spark, d).join(plan(spark, d), "gene_id").join(groups(spark, d), "cell_id")
    entries = e.select((F.col("row_group") * 100000 + F.col("block")).alias("region"), (F.col("cell_id") - F.col("row_group") * GROUP).alias("local_row"))
    rows = groups(spark, d).groupBy("row_group").agg((F.max("cell_id") - F.first("row_group") * GROUP + 1).alias("rows"))
    blocks = plan(spark, d).groupBy("block").agg(F.count("*").alias("features"))
    role = F.when(F.pmod("block", F.lit(7)) == 6, "residual").otherwise("primary")
    regions = rows.crossJoin(blocks).select((F.col("row_group") * 100000 + F.col("block")).alias("region"), role.alias("role"), "rows", "features")  # the grid of regions itself
    return packing.select_layout(packing.layout_metrics(entries, regions))


@query("q134_layouts", f"""{_REGIONS} select region, role, nnz, min_width, max_width, blocked_slots, sliced_slots, dense_slots, csr_bytes, blocked_bytes, sliced_bytes, dense_bytes,
  case when role = 'residual' or nnz < 16 or n_rows < 2 then 'csr' when nnz / dense_slots >= 0.72 and dense_bytes <= csr_bytes then 'dense'
    when nnz / nullif(blocked_slots, 0) >= 0.55 and blocked_bytes <= 0.95::double * csr_bytes and blocked_bytes <= sliced_bytes then 'blocked'
    when nnz / nullif(sliced_slots, 0) >= 0.45 and sliced_bytes <= 0.95::double * csr_bytes then 'sliced' else 'csr' end as layout from y""")
def q134(spark, d):
    """Slots, bytes and the layout chosen for every region."""
    return _layouts(spark, d).select("region", "role", "nnz", "min_width", "max_width", "blocked_slots", "sliced_slots", "dense_slots", "csr_bytes", "blocked_bytes", "sliced_bytes", "dense_bytes", "layout")


_MODULES = "md as (select gene_id, case when gene_id % 5 = 0 then null else (gene_id % 3)::int end as module from genes)"
_STATIC = f"""with {EXPRESSION}, {_MODULES}, sg as (select cell_id, string_agg(lpad(module::varchar, 6, '0'), ',' order by module) as signature from (select distinct cell_id, module from e join md using (gene_id) where module is not null) group by 1),
  gg as (select signature, count(*) as n_rows from sg group by 1),
  rr as (select signature, unnest(string_split(signature, ','))::int as module, n_rows as rows, case when n_rows < 50 then 'conditional' else 'primary' end as role from gg
    union all select '', null, count(distinct cell_id), 'residual' from e)"""


def _static(spark, d):
    modules = features(spark, d).select("gene_id", F.when(F.col("gene_id") % 5 != 0, (F.col("gene_id") % 3).cast("int")).alias("module"))
    return packing.static_plan(expression(spark, d), modules, 50)


@query("q094_static_rows", f"{_STATIC} select * from sg")
def q094(spark, d):
    """Rows by the modules they use."""
    return _static(spark, d)[0]


@query("q094_static_regions", f"{_STATIC} select * from rr")
def q094b(spark, d):
    """Regions of the static plan with their roles."""
    return _static(spark, d)[1]


_ROUTES = {"all": "true", "alternating": "coalesce(role <> 'residual' and module % 2 = 1, false)", "conditional": "role = 'conditional'", "skip_residual": "role <> 'residual'"}


@query("q021_route_masks", _STATIC + " " + " union all ".join(f"select '{k}' as scenario, signature, module, {v} as active from rr" for k, v in _ROUTES.items()))
def q021(spark, d):
    """Active regions in each routing scenario."""
    regions, out = _static(spark, d)[1], None
    for s in _ROUTES:
        one = regions.select(F.lit(s).alias("scenario"), "signature", "module", packing.route_mask(regions, s, 1).alias("active"))
        out = one if out is None else out.unionAll(one)
    return out


_TAPE = "coalesce(role <> 'residual' and module % 2 = 1, false)"


@query("q022_route_replay", f"""{_STATIC}, ta as (select *, {_TAPE} as active from rr), ag as (select *, coalesce(role <> 'residual' and module % 2 = 0, false) as again from rr)
  select signature, module, active as recorded, again as replayed from ta join ag using (signature, module) where active <> again
  union all select null, null, count(*) > 0, bool_and(active = {_TAPE}) from ta""")
def q022(spark, d):
    """Regions in which a replay of the next microbatch differs from the recorded tape, and last whether a replay of the same
    one agrees with it throughout."""
    regions = _static(spark, d)[1]
    tape, same, other = (regions.select("signature", "module", packing.route_mask(regions, "alternating", m).alias("active")) for m in (1, 3, 2))
    differing = tape.join(other.withColumnRenamed("active", "replayed"), ["signature", "module"]).where("active <> replayed").select("signature", "module", F.col("active").alias("recorded"), "replayed")
    missing = tape.exceptAll(same).agg(F.count("*").alias("n"))
    whole = tape.agg((F.count("*") > 0).alias("recorded")).join(F.broadcast(missing)).select(F.lit(None).cast("string").alias("signature"), F.lit(None).cast("int").alias("module"), "recorded", (F.col("n") == 0).alias("replayed"))
    return differing.unionAll(whole)


@query("q132_metric_rates", f"""{_TILES}, m as (select (12 * count(*) + 8 * sum(entries))::bigint as metadata, sum(nnz)::bigint as nnz, count(*) as tb, count(distinct ("window", tile)) as tiles, sum(entries)::bigint as en, (select count(distinct cell_id) from e) as rows from wt)
  select round((metadata + 2 * nnz) / nnz, 6) as encoded_bytes_per_nnz, round(metadata / nnz, 6) as metadata_bytes_per_nnz, round((6 * nnz) / (metadata + 2 * nnz), 6) as compression_ratio, round(en / rows, 6) as active_blocks_per_row, round(tb / tiles, 6) as tile_blocks_per_tile from m""")
def q132(spark, d):
    """Rates of an encoded matrix."""
    rows = expression(spark, d).agg(F.countDistinct("cell_id").alias("rows"))
    m = packing.tile_metrics(_tiles(spark, d)).join(F.broadcast(rows)).withColumns({
        "encoded_bytes": F.col("metadata_bytes") + F.col("value_bytes"), "baseline_bytes": 6 * F.col("nnz"), "padding_slots": F.lit(0), "active_blocks": F.col("row_block_entries"),
    })
    return packing.metric_rates(m).drop("padding_per_nnz").select(*(F.round(c, 6).alias(c) for c in ("encoded_bytes_per_nnz", "metadata_bytes_per_nnz", "compression_ratio", "active_blocks_per_row", "tile_blocks_per_tile")))
