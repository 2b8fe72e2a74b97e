"""Sources, filters, metrics and normalisation (inventory numbers 1-20 and 48-56)."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.lineage import cut, shared_dir
from ..operators import qc
from ..sources import files
from ..sources.tables import CELLS, EXPRESSION, cells, expression, features, table
from .catalog import query
from .guards import StateError, stage_plan

FILTER = {"min_counts": 30.0, "min_features": 20, "max_fraction": 0.2}
GENES = {"min_sum": 5.0, "min_cells": 3.0, "min_variance": 0.01}
HAND = "group_mask"

MASKS = """g as (
  select gene_id, coalesce(group_mask, 0)
    | case when starts_with(feature_name, 'MT-') or starts_with(feature_id, 'MT-') or starts_with(feature_name, 'mt-') or starts_with(feature_id, 'mt-') then 1 else 0 end
    | case when regexp_matches(feature_name, '^(RPS|RPL|rps|rpl)') or regexp_matches(feature_id, '^(RPS|RPL|rps|rpl)') then 2 else 0 end
    | case when regexp_matches(feature_name, '^(HB|Hb|hb)') or regexp_matches(feature_id, '^(HB|Hb|hb)') then 4 else 0 end as mask
  from genes)"""
METRICS = """m as (
  select c.cell_id, coalesce(total, 0) as total, coalesce(max_value, 0) as max_value, coalesce(detected, 0) as detected,
    coalesce(g0, 0) as group_0, coalesce(g1, 0) as group_1, coalesce(g2, 0) as group_2, coalesce(g3, 0) as group_3
  from c left join (
    select cell_id, sum(value) as total, max(value) as max_value, count(*) as detected, sum(case when mask & 1 <> 0 then value else 0 end) as g0,
      sum(case when mask & 2 <> 0 then value else 0 end) as g1, sum(case when mask & 4 <> 0 then value else 0 end) as g2,
      sum(case when mask & 8 <> 0 then value else 0 end) as g3
    from e left join g using (gene_id) group by 1) using (cell_id))"""
KEPT = "k as (select *, total >= 30 and detected >= 20 and case when total > 0 then group_0 / total else 0 end <= 0.2 as keep from m)"
QC = f"with {EXPRESSION}, {CELLS}, {MASKS}, {METRICS}, {KEPT}"
NORMAL = """n as (select e.cell_id, gene_id, case when keep then ln(1 + value * (10000.0::double / total)) else value end as value from e join k using (cell_id))"""
GENE = """y as (
  select gene_id, sum(value) as "sum", sum(value * value) as sum_sq, count(*) filter (where value <> 0) as detected from n where cell_id in (select cell_id from k where keep) group by 1),
w as (
  select y.*, n_kept, "sum" >= 5 and detected >= 3 and greatest(sum_sq / n_kept - ("sum" / n_kept) * ("sum" / n_kept), 0) >= 0.01 as keep
  from y, (select count(*) as n_kept from k where keep))"""


def masks(spark: SparkSession, d: str) -> DataFrame:
    rules = [(qc.GROUPS[g], g, p, None, None, None, None) for g, p in qc.DEFAULT_RULES]
    return qc.group_masks(features(spark, d), rules, "feature_id", "feature_name", "feature_type", "modality", HAND)


def metrics(spark: SparkSession, d: str, e: DataFrame | None = None) -> DataFrame:
    m = qc.cell_metrics(expression(spark, d) if e is None else e, cells(spark, d), masks(spark, d), groups=4)
    return m.withColumn("keep", qc.keep_cell(**FILTER))


def normalized(spark: SparkSession, d: str) -> DataFrame:
    return qc.normalize(expression(spark, d), metrics(spark, d))


def gene_table(spark: SparkSession, d: str, e: DataFrame | None = None, m: DataFrame | None = None) -> DataFrame:
    m, e = metrics(spark, d) if m is None else m, expression(spark, d) if e is None else e
    g = qc.gene_metrics(qc.normalize(e, m, mark=True), m)
    n = m.where("keep").agg(F.count("*").alias("n_kept"))
    return g.join(F.broadcast(n)).withColumn("keep", qc.keep_gene(F.col("n_kept"), **GENES))


@query("q001_summary", f"with {EXPRESSION} select (select count(distinct cell_id) from cells) as n_rows, (select count(*) from genes) as n_cols, count(*) as nnz, 'long' as layout, 'raw_counts' as matrix_state from e")
def q001(spark, d):
    """Summary row of an opened data set."""
    return files.summary(expression(spark, d), cells(spark, d), features(spark, d))


@query("q002_shard_waves", "select lane as shard, count(*) as n_rows, (lane - 1) // 4 as wave from expr group by 1")
def q002(spark, d):
    """Shards with the upload wave of four each belongs to."""
    return files.shard_waves(table(spark, d, "expr"), "lane", per_wave=4, first=1)


@query("q003_csr_rows", """select sampled_position, staged_at, shard_index, generate_subscripts(column_indices, 1) - 1 as slot, unnest(column_indices) as gene_id from sampled_csr where column_indices is not null""")
def q003(spark, d):
    """Entries of the rows of an owned or sharded compressed matrix."""
    return files.csr_entries(table(spark, d, "sampled_csr"), ["sampled_position", "staged_at", "shard_index"], "column_indices", "gene_id")


@query("q004_labels", f"with {CELLS} select cell_id, label from c where label is not null")
def q004(spark, d):
    """A text label column; a missing or non-text column is an error."""
    return files.label_column(cells(spark, d), "cell_id", "label").where("label is not null")


@query("q005_stage_plans", """select * from (values ('h5ad', 'raw', false, 'ok', 'blocked_ell'), ('h5ad', 'X', false, 'not_raw_counts', null), ('h5ad', 'X', true, 'ok', 'blocked_ell'),
  ('mtx', 'counts', false, 'ok', 'blocked_ell'), ('mtx', 'normalized', false, 'not_raw_counts', null), ('loom', 'raw', true, 'unsupported_layout', null)) t(source_format, matrix, allow_processed, status, layout)""")
def q005(spark, d):
    """Stage plans of source kinds."""
    rows = []
    for case in (("h5ad", "raw", False), ("h5ad", "X", False), ("h5ad", "X", True), ("mtx", "counts", False), ("mtx", "normalized", False), ("loom", "raw", True)):
        try:
            rows.append((*case, "ok", stage_plan(*case)["layout"]))
        except StateError as e:
            rows.append((*case, e.code, None))
    return spark.createDataFrame(rows, "source_format string, matrix string, allow_processed boolean, status string, layout string")


_UNIT = "('0x' || substr(md5('7:' || cell_id), 1, 13))::bigint"


@query("q006_day_subset", rf"""with {CELLS} select cell_id, day, pos from (
  select cell_id, day, row_number() over (partition by day order by {_UNIT}, cell_id) as pos from c where day is not null) where pos <= 40""")
def q006(spark, d):
    """At most forty cells of every day label, by a seeded hash."""
    return files.labelled_subset(cells(spark, d), "cell_id", "day", most=40, seed=7).select("cell_id", "day", "pos")


@query("q006_day_order", rf"""with {CELLS} select day, n, row_number() over (order by coalesce(regexp_extract(day, '[0-9]+\.?[0-9]*')::double, 1e9), day) as pos
  from (select day, count(*) as n from c where day is not null group by 1)""".replace("coalesce(regexp_extract(day, '[0-9]+\\.?[0-9]*')::double, 1e9)", "coalesce(try_cast(regexp_extract(day, '[0-9]+\\.?[0-9]*') as double), 1e9)"))
def q006b(spark, d):
    """Day labels by their number."""
    return files.label_order(cells(spark, d), "day")


@query("q007_nested_subset", f"""with {CELLS} select cell_id, pos <= 100 as fast from (select cell_id, row_number() over (order by {_UNIT}, cell_id) as pos from c) where pos <= 400""")
def q007(spark, d):
    """Two nested samples of cells by hash rank."""
    return files.nested_subset(cells(spark, d), "cell_id", 100, 400, seed=7)


@query("q008_merged_records", """select gene_id, feature_id, feature_name, coalesce(o.modality, g.modality) as modality from genes g
  left join (select gene_id, case feature_type when 'gene' then 'rna' when 'peak' then 'atac' else 'protein' end as modality from genes where modality is null) o using (gene_id)""")
def q008(spark, d):
    """Catalogue records with the overrides of a second source."""
    base = features(spark, d).select("gene_id", "feature_id", "feature_name", "modality")
    of = F.when(F.col("feature_type") == "gene", "rna").when(F.col("feature_type") == "peak", "atac").otherwise("protein")
    return files.merge_records(base, features(spark, d).where("modality is null").select("gene_id", of.alias("modality")), "gene_id")


@query("q008_flattened", f"""with {CELLS}, k as (select dataset_id, count(distinct cell_id) as cells, bool_and(stable_id is not null) as complete, min(row_no) as lo, max(row_no) as hi from cells where dataset_id is not null group by 1),
  l as (select dataset_id, string_agg(distinct label, '|' order by label) as labels from cells join c using (cell_id) where dataset_id is not null and label is not null group by 1)
  select dataset_id, cells, case when complete then 'true' else 'false' end as complete, coalesce(labels, '') as labels, lo as rows_first, hi as rows_last from k left join l using (dataset_id)""")
def q008b(spark, d):
    """Catalogue records with a list, a truth value and a struct, one plain column a field."""
    raw, c = table(spark, d, "cells").where("dataset_id is not null"), cells(spark, d)
    k = raw.groupBy("dataset_id").agg(F.countDistinct("cell_id").alias("cells"), F.bool_and(F.col("stable_id").isNotNull()).alias("complete"), F.struct(F.min("row_no").alias("first"), F.max("row_no").alias("last")).alias("rows"))
    labels = raw.select("dataset_id", "cell_id").join(c.select("cell_id", "label"), "cell_id").groupBy("dataset_id").agg(F.array_sort(F.collect_set("label")).alias("labels"))
    return files.flatten_records(k.join(labels, "dataset_id", "left"))


@query("q009_published", f"{QC}, {NORMAL}, {GENE} select cell_id, gene_id, value from e where cell_id in (select cell_id from k where keep) and gene_id in (select gene_id from w where keep)")
def q009(spark, d):
    """The filtered raw matrix: kept cells by kept genes."""
    e = cut(expression(spark, d))  # summed once: metrics, normalisation and the result read it
    m = cut(metrics(spark, d, e))
    return files.filtered_matrix(e, m.where("keep"), gene_table(spark, d, e, m).where("keep"))


@query("q010_image_manifest", f"with {EXPRESSION} select 'expression' as part, count(*) as n_rows, bit_xor(('0x' || substr(md5(cell_id || ':' || gene_id || ':' || value::bigint), 1, 15))::bigint) as checksum from e")
def q010(spark, d):
    """Rows and checksum of a stored table."""
    return files.manifest(expression(spark, d).withColumn("value", F.col("value").cast("long")), "expression", ["cell_id", "gene_id", "value"])


@query("q010_reopened", f"""with {EXPRESSION} select 'expression' as part, count(*) as n_rows, bit_xor(('0x' || substr(md5(cell_id || ':' || gene_id || ':' || value::bigint), 1, 15))::bigint) as checksum from e
  union all select 'genes', count(*), bit_xor(('0x' || substr(md5(gene_id || ':' || coalesce(group_mask, 0)), 1, 15))::bigint) from genes""")
def q010b(spark, d):
    """A stored image of two tables, opened again after its version, rows and checksums have been verified."""
    tables = {"expression": expression(spark, d).withColumn("value", F.col("value").cast("long")), "genes": features(spark, d).select("gene_id", F.coalesce("group_mask", F.lit(0)).alias("mask"))}
    path = f"{shared_dir(spark).rstrip('/')}/image-{uuid.uuid4().hex}"
    files.write_image(path, tables, version=2)
    back = files.open_image(spark, path, version=2)
    parts = [files.manifest(back[name], name, tables[name].columns) for name in tables]
    return parts[0].unionAll(parts[1])


@query("q012_prefix_flag", "select gene_id, coalesce(starts_with(feature_name, 'MT-'), false) as mito from genes")
def q012(spark, d):
    """Features whose name begins with the mitochondrial prefix."""
    return features(spark, d).select("gene_id", qc.prefix_flag(F.col("feature_name")).alias("mito"))


@query("q013_group_masks", f"with {MASKS} select * from g")
def q013(spark, d):
    """Feature group bits by rules and by hand."""
    return masks(spark, d).select("gene_id", "mask")


@query("q014_default_rules", "select * from (values (0, 'mt', 'MT-'), (0, 'mt', 'mt-'), (1, 'ribo', 'RPS'), (1, 'ribo', 'RPL'), (1, 'ribo', 'rps'), (1, 'ribo', 'rpl'), (2, 'hb', 'HB'), (2, 'hb', 'Hb'), (2, 'hb', 'hb')) t(group_index, group_name, prefix)")
def q014(spark, d):
    """The default rules."""
    return qc.default_rules(spark).select("group_index", "group_name", "prefix")


@query("q015_kept_cells", f"{QC} select cell_id, total, detected, keep from k")
def q015(spark, d):
    """Cells with their keep flag."""
    return metrics(spark, d).select("cell_id", "total", "detected", "keep")


@query("q016_kept_genes", f"{QC}, {NORMAL}, {GENE} select gene_id, keep from w")
def q016(spark, d):
    """Genes with their keep flag."""
    return gene_table(spark, d).select("gene_id", "keep")


@query("q017_normalized", f"{QC}, {NORMAL} select cell_id, gene_id, round(value, 6) as value from n")
def q017(spark, d):
    """Log-normalised values."""
    return normalized(spark, d).withColumn("value", F.round("value", 6))


@query("q048_cell_metrics", f"""{QC} select m.*, round(case when total > 0 then 100 * group_0 / total else 0 end, 6) as pct_0, round(case when total > 0 then 100 * group_1 / total else 0 end, 6) as pct_1,
  round(case when total > 0 then 100 * group_2 / total else 0 end, 6) as pct_2, round(case when total > 0 then 100 * group_3 / total else 0 end, 6) as pct_3 from m""")
def q048(spark, d):
    """Totals, maxima, detected features and group shares of every cell."""
    return metrics(spark, d).drop("keep").withColumns({f"pct_{g}": F.round(f"pct_{g}", 6) for g in range(4)})


@query("q049_cell_metrics_plain", f"{QC} select cell_id, total, max_value, detected from m")
def q049(spark, d):
    """Cell metrics without groups."""
    return qc.cell_metrics(expression(spark, d), cells(spark, d))


@query("q050_gene_metrics", f"""{QC}, {NORMAL}, {GENE} select gene_id, round("sum", 6) as "sum", round(sum_sq, 6) as sum_sq, detected from w""")
def q050(spark, d):
    """Sums, squares and detections of normalised values over kept cells."""
    return gene_table(spark, d).select("gene_id", F.round("sum", 6).alias("sum"), F.round("sum_sq", 6).alias("sum_sq"), "detected")


@query("q051_active_rows", f"{QC} select count(*) filter (where keep) as active, count(*) as n_rows, count(*) filter (where keep and detected = 0) as active_empty from k")
def q051(spark, d):
    """Kept rows, empty ones among them."""
    return metrics(spark, d).agg(F.count_if("keep").alias("active"), F.count("*").alias("n_rows"), F.count_if(F.col("keep") & (F.col("detected") == 0)).alias("active_empty"))


@query("q053_part_metrics", f"""with {EXPRESSION} select part, round(sum(value), 3) as total, count(*) as nnz, max(value) as max_value from (select *, cell_id % 4 as part from e) group by 1""")
def q053(spark, d):
    """Metrics by part, to be added up over a fleet."""
    return expression(spark, d).groupBy((F.col("cell_id") % 4).alias("part")).agg(F.round(F.sum("value"), 3).alias("total"), F.count("*").alias("nnz"), F.max("value").alias("max_value"))


@query("q054_session_totals", f"""{QC}, {NORMAL}, {GENE} select (select count(*) from k where keep) as kept_cells, (select count(*) from w where keep) as kept_genes, (select round(sum("sum"), 3) from w) as gene_sum_checksum""")
def q054(spark, d):
    """Kept cells and genes and the checksum of the gene sums."""
    g = gene_table(spark, d).agg(F.count_if("keep").alias("kept_genes"), F.round(F.sum("sum"), 3).alias("gene_sum_checksum"))
    return metrics(spark, d).agg(F.count_if("keep").alias("kept_cells")).join(F.broadcast(g))


@query("q055_value_sum", f"with {EXPRESSION} select sum(value) as total, count(*) as nnz from e")
def q055(spark, d):
    """Sum of all stored values."""
    return expression(spark, d).agg(F.sum("value").alias("total"), F.count("*").alias("nnz"))


@query("q056_degrees", f"with {EXPRESSION} select 'cell' as axis, cell_id as id, count(*) as degree from e group by 2 union all select 'gene', gene_id, count(*) from e group by 2")
def q056(spark, d):
    """Entries by row and by column."""
    return files.degrees(expression(spark, d), {"cell": "cell_id", "gene": "gene_id"})
