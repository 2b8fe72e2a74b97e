"""The pN_ queries: every operator over its whole tables with production settings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._work import cut, table
from .bpe import encode_corpus
from .cooccur import pair_counts, surprise
from .knn_graph import greedy_search, neighbour_graph, similar_pairs
from .leakage import find_leaks
from .quota_sample import quota_sample, target_report
from .set_pairs import record_links, similar_records
from .split import split_oversized
from .stable_sample import poisson_sample, running_weights
from .terms import mark_terms, term_frequencies


def _marked_genes(spark: SparkSession, sf_dir: str) -> DataFrame:
    freq, n = term_frequencies(table(spark, sf_dir, "expr"))
    return mark_terms(freq, n, table(spark, sf_dir, "preprocess_options"))


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _marked_genes(spark, sf_dir).select("gene_id", F.explode("marks").alias("mark"))


def p1_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _marked_genes(spark, sf_dir).select("gene_id", "sum", "detected", "n", F.array_join("marks", ",").alias("marks"))


def p1_recursed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """p1_terms with a limit so low that partitions are parted again, hot terms by record."""
    freq, n = term_frequencies(table(spark, sf_dir, "expr"), limit_rows=10_000)
    return mark_terms(freq, n, table(spark, sf_dir, "preprocess_options")).select("gene_id", "sum", "detected", "n", F.array_join("marks", ",").alias("marks"))


_P1 = """
with m as (
  select distinct gene_id, cell_id, lane, expr_value from expr
  where gene_id is not null and cell_id >= 0 and expr_value is not null and isfinite(expr_value)),
c as (select gene_id, cell_id, sum(expr_value) as total from m group by all),
f as (select gene_id, sum(total) as "sum", count(*) filter (where total > 0) as detected from c group by all),
g as (
  select a.gene_id, coalesce(f."sum", 0) as "sum", coalesce(f.detected, 0) as detected
  from (select distinct gene_id from expr where gene_id is not null) a left join f on a.gene_id = f.gene_id),
k as (select count(distinct cell_id) as n from c where total > 0),
r as (
  select g.*, k.n, detected < min_detected_cells or "sum" < min_gene_sum as rare, detected > max_detected_share * n as common
  from g, k, preprocess_options)
"""


SAMPLE_RATE = 0.1


def _described() -> Column:
    """The share of a row's descriptions that are filled in."""
    filled = [F.length(F.btrim("stratum")) > 0, F.length(F.btrim("day_label")) > 0, F.col("embryo_id") >= 0, F.nanvl("developmental_time", F.lit(None)).isNotNull()]
    return sum((F.coalesce(c, F.lit(False)).cast("double") for c in filled), F.lit(1.0)) / 5


def p2_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tenth of the fully described cells; a row's weight is the share of its descriptions that are filled in."""
    return poisson_sample(running_weights(table(spark, sf_dir, "cells"), "stable_id", _described()), "stable_id", SAMPLE_RATE)


def p2_grown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """p2_sample by deliveries: the weights after the first one are written, read again, and go on with the later ones."""
    cells = table(spark, sf_dir, "cells")
    early = F.coalesce(F.col("delivery_no") <= 1, F.lit(True))
    state = cut(running_weights(cells.where(early), "stable_id", _described()))
    return poisson_sample(running_weights(cells.where(~early), "stable_id", _described(), state), "stable_id", SAMPLE_RATE)


_P2 = f"""
with w as (
  select stable_id, max((1.0::double + coalesce(length(trim(stratum)) > 0, false)::int + coalesce(length(trim(day_label)) > 0, false)::int
    + coalesce(embryo_id >= 0, false)::int + coalesce(not isnan(developmental_time), false)::int) / 5) as weight
  from cells where stable_id <> '' group by 1),
h as (select *, ('0x' || substr(md5(stable_id), 1, 13))::bigint::double / {16**13}.0::double as unit_hash, least(weight * {SAMPLE_RATE}::double, 1.0) as inclusion from w)
select stable_id, weight, unit_hash, inclusion from h where unit_hash < inclusion
"""


def _cell_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbour_graph(table(spark, sf_dir, "neighbor_index"), "cell_index", "latent", dim=64, k=10)


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = similar_pairs(_cell_graph(spark, sf_dir), table(spark, sf_dir, "neighbor_index"), "cell_index", "latent", least=0.9)
    return pairs.select(F.col("a").alias("cell_a"), F.col("b").alias("cell_b"))


# brute force over all pairs of vectors: for tables of some thousand cells
_P3 = """
with l as (
  select cell_index as c, any_value(latent)::double[] as x from neighbor_index
  where cell_index >= 0 and latent is not null and len(latent) = 64
    and len(list_filter(latent, lambda v: v is null or not isfinite(v))) = 0 and len(list_filter(latent, lambda v: v <> 0)) > 0
  group by 1),
v as (select c, x, sqrt(list_inner_product(x, x)) as n from l),
p as (select a.c as a, b.c as b, list_inner_product(a.x, b.x) / (a.n * b.n) as s from v a join v b on a.c <> b.c),
r as (select *, row_number() over (partition by a order by s desc, b) as i from p)
select distinct least(a, b) as cell_a, greatest(a, b) as cell_b from r where i <= 10 and s >= 0.9
"""


def p3_neighbors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 most similar other cells of every cell, with similarity and embryo (null where it is unknown)."""
    embryo = table(spark, sf_dir, "neighbor_index").where("embryo_id >= 0").groupBy(F.col("cell_index").alias("neighbor")).agg(F.min("embryo_id").alias("embryo_id"))
    edges = _cell_graph(spark, sf_dir).select(F.col("id").alias("cell_index"), F.posexplode(F.arrays_zip("nbrs", "sims")).alias("rank", "e"))
    edges = edges.select("cell_index", (F.col("rank") + 1).alias("rank"), F.col("e.nbrs").alias("neighbor"), F.round("e.sims", 3).alias("similarity"))
    return edges.join(embryo, "neighbor", "left").select("cell_index", "rank", "neighbor", "similarity", "embryo_id")


def p3_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Greedy search along the graph for every cell whose number is divisible by 50, against all cells."""
    rows = table(spark, sf_dir, "neighbor_index")
    found = greedy_search(_cell_graph(spark, sf_dir), rows, rows.where("cell_index % 50 = 0"), "cell_index", "latent")
    return found.withColumnRenamed("id", "cell_index")


def p4_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = similar_records(table(spark, sf_dir, "support"), "gene_id", "cell_id", numerator=3, denominator=5)
    return pairs.withColumnsRenamed({"a": "gene_a", "b": "gene_b"})


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p4_pairs(spark, sf_dir).select("gene_a", "gene_b")


def p4_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per gene its class of equal sets, the size of that, and the number of genes it is similar to."""
    return record_links(table(spark, sf_dir, "support"), "gene_id", "cell_id", numerator=3, denominator=5).withColumnsRenamed({"k": "gene_id", "s": "class_id"})


_P4 = """
with s as (select distinct gene_id as g, cell_id as c from support where gene_id is not null and cell_id >= 0),
n as (select g, count(*) as k from s group by 1),
i as (select a.g as gene_a, b.g as gene_b, count(*) as common from s a join s b on a.c = b.c and a.g < b.g group by all),
o as (
  select gene_a, gene_b, common::int as common, (x.k + y.k - common)::int as total from i join n x on x.g = gene_a join n y on y.g = gene_b
  where 5 * common >= 3 * (x.k + y.k - common))
"""


def _gene_pairs(spark: SparkSession, sf_dir: str, min_count: int = 8, min_ratio: float = 3.0) -> tuple[DataFrame, DataFrame, DataFrame]:
    return pair_counts(table(spark, sf_dir, "sampled_csr"), "sampled_position", "column_indices", min_count, min_ratio)


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pairs of genes that occur together 8 times and three times as often as expected, of all that are scored."""
    return p5_surprise(spark, sf_dir).where("n_ab >= 8 and n_ab * n >= 3 * n_a * n_b").select("gene_a", "gene_b")


def p5_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _gene_pairs(spark, sf_dir)[0].withColumnsRenamed({"a": "gene_a", "b": "gene_b"})


def p5_surprise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every pair of genes that occurs together, with counts and ratio; q-values rank all of them."""
    return surprise(*_gene_pairs(spark, sf_dir, min_count=1, min_ratio=0.0)).withColumnsRenamed({"a": "gene_a", "b": "gene_b"})


_P5 = """
with r as (
  select distinct sampled_position as p, g from (select sampled_position, unnest(column_indices) as g from sampled_csr) where g >= 0),
f as (select g, count(*) as n_g from r group by 1),
k as (select count(distinct p) as n from r),
c as (select a.g as gene_a, b.g as gene_b, count(*) as n_ab from r a join r b on a.p = b.p and a.g < b.g group by all having count(*) >= 8),
o as (
  select gene_a, gene_b, n_ab, fa.n_g as n_a, fb.n_g as n_b, n, (n_ab * n)::double / (fa.n_g::double * fb.n_g) as ratio
  from c join f fa on fa.g = gene_a join f fb on fb.g = gene_b, k where n_ab * n >= 3 * fa.n_g * fb.n_g)
"""


def p6_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return target_report(table(spark, sf_dir, "cells"), table(spark, sf_dir, "sample_targets"))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p6_report(spark, sf_dir).where("not met").select("dataset_id", "stratum")


def p6_filled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """p6_sample with quotas that end on the request exactly where categories must give up rows."""
    return quota_sample(table(spark, sf_dir, "cells"), table(spark, sf_dir, "sample_targets"), fill=True)


def p6_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quota_sample(table(spark, sf_dir, "cells"), table(spark, sf_dir, "sample_targets"))


_P6 = r"""
with a as (
  select distinct dataset_id, trim(regexp_replace(lower(stratum), '[\s_\-]+', ' ', 'g')) as stratum, cell_id
  from cells where stratum is not null and dataset_id is not null and cell_id is not null),
n as (select dataset_id, stratum, count(*) as available from a group by all),
b as (
  select t.dataset_id, t.stratum, target_share, min_rows, requested_rows, coalesce(available, 0) as available, target_share * requested_rows as wish
  from sample_targets t left join n on t.dataset_id = n.dataset_id and t.stratum = n.stratum),
c as (select *, greatest(min_rows::double, wish) as needed, least(min_rows, available) as low, least(greatest(min_rows, floor(wish)::bigint), available) as base from b),
d as (
  select *, requested_rows - sum(base) over (partition by dataset_id) as free,
    case when base < available and target_share > 0 and floor(wish) < wish and base = floor(wish)::bigint then wish - floor(wish) else -1.0::double end as rest from c),
e as (select *, row_number() over (partition by dataset_id order by rest desc, stratum) as rank, sum(base - low) over (partition by dataset_id) as spare from d),
r as (
  select *, (base + (case when rest > 0 and rank <= free then 1 else 0 end)
    - (case when free < 0 then least(base - low, ceil((base - low)::double * -free::double / greatest(spare, 1)::double)) else 0 end))::bigint as quota from e)
"""


def p7_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_corpus(table(spark, sf_dir, "documents"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p8_leaks(spark, sf_dir).where("exact_words >= 12").select("doc_id", "item_id")


def p8_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))


def p9_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split_oversized(table(spark, sf_dir, "documents"), table(spark, sf_dir, "split_limits"))


QUERIES = {f.__name__: f for f in (p1_found, p1_terms, p1_recursed, p2_sample, p2_grown, p3_found, p3_neighbors, p3_search, p4_found, p4_pairs, p4_links, p5_found, p5_counts, p5_surprise, p6_report, p6_found, p6_sample, p6_filled, p7_ids, p8_found, p8_leaks, p9_pieces)}
ORACLES: dict[str, str] = {
    "p1_found": _P1 + "select gene_id, 'rare' as mark from r where rare union all select gene_id, 'common' from r where common",
    **dict.fromkeys(("p1_terms", "p1_recursed"), _P1 + """select gene_id, "sum", detected, n, concat_ws(',', case when rare then 'rare' end, case when common then 'common' end) as marks from r"""),
    "p2_sample": _P2,
    "p2_grown": _P2,
    "p3_found": _P3,
    "p4_found": _P4 + "select gene_a, gene_b from o",
    "p4_pairs": _P4 + "select * from o",
    "p4_links": _P4 + """, e as (select g, list(c order by c) as x from s group by 1), m as (select g, min(g) over (partition by x) as class_id, count(*) over (partition by x) as members from e),
      l as (select g, count(*) as links from (select gene_a as g from o union all select gene_b from o) group by 1)
      select m.g as gene_id, class_id, members, coalesce(links, 0) as links from m left join l on l.g = m.g""",
    "p5_found": _P5 + "select gene_a, gene_b from o",
    "p5_counts": _P5 + "select * from o",
    "p6_report": _P6 + """select dataset_id, stratum, target_share, min_rows, requested_rows, available, needed, quota,
      greatest(ceil(needed)::bigint - available, 0) as short, available >= needed as met from r""",
    "p6_found": _P6 + "select dataset_id, stratum from r where available < needed",
    "p6_sample": _P6 + """, k as (
      select *, ('0x' || substr(md5(cell_id::varchar), 1, 13))::bigint::double / 4503599627370496.0::double as unit_hash from a)
      select dataset_id, stratum, cell_id, unit_hash from (
        select k.*, quota, row_number() over (partition by dataset_id, stratum order by unit_hash, cell_id) as i from k join r using (dataset_id, stratum))
      where i <= quota""",
    "p6_filled": _P6 + """, s as (
      select *, least(greatest(-free, 0), spare) as over, (base - low) * least(greatest(-free, 0), spare)::double / greatest(spare, 1) as part from r),
      t as (select *, over - sum(floor(part)) over (partition by dataset_id) as rest_rows, row_number() over (partition by dataset_id order by part - floor(part) desc, stratum) as last from s),
      q as (
        select dataset_id, stratum, (base + (case when rest > 0 and rank <= free then 1 else 0 end) - floor(part) - (case when last <= rest_rows then 1 else 0 end))::bigint as quota from t),
      k as (
      select *, ('0x' || substr(md5(cell_id::varchar), 1, 13))::bigint::double / 4503599627370496.0::double as unit_hash from a)
      select dataset_id, stratum, cell_id, unit_hash from (
        select k.*, quota, row_number() over (partition by dataset_id, stratum order by unit_hash, cell_id) as i from k join q using (dataset_id, stratum))
      where i <= quota""",
}
