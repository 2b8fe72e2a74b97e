"""Quality control: feature groups, cell and gene metrics, filters, normalisation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The default rules (group, name prefix).
GROUPS = {"mt": 0, "ribo": 1, "hb": 2}
DEFAULT_RULES = [("mt", "MT-"), ("mt", "mt-"), ("ribo", "RPS"), ("ribo", "RPL"), ("ribo", "rps"), ("ribo", "rpl"), ("hb", "HB"), ("hb", "Hb"), ("hb", "hb")]
RULE_SCHEMA = "group_index int, group_name string, prefix string, exact_id string, exact_name string, type string, modality string"
MOST_GROUPS = 32


def default_rules(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(GROUPS[g], g, p, None, None, None, None) for g, p in DEFAULT_RULES], RULE_SCHEMA)


def prefix_flag(name: Column, prefix: str = "MT-") -> Column:
    return F.coalesce(F.startswith(name, F.lit(prefix)), F.lit(False))


def group_masks(features: DataFrame, rules: list[tuple], id_: str, name: str, type_: str, modality: str, by_hand: str | None = None) -> DataFrame:
    """features with ``mask``: bit g is set by a rule of group g, or by hand.

    A rule (RULE_SCHEMA order) holds where type and modality equal its own, if it has any, and the name or id begins with
    its prefix, or the id or the name is its exact one, or it has none of the three. Rules are few (32 groups at most) and
    become one expression, so no join is needed.
    """
    def matches(r: tuple) -> Column:
        _, _, prefix, exact_id, exact_name, t, m = r
        ways = []
        if prefix is not None:
            ways += [F.startswith(name, F.lit(prefix)), F.startswith(id_, F.lit(prefix))]
        if exact_id is not None:
            ways.append(F.col(id_) == exact_id)
        if exact_name is not None:
            ways.append(F.col(name) == exact_name)
        hit = reduce(lambda a, b: a | b, (F.coalesce(w, F.lit(False)) for w in ways)) if ways else F.lit(True)
        for col, want in ((type_, t), (modality, m)):
            if want is not None:
                hit = hit & F.coalesce(F.col(col) == want, F.lit(False))
        return hit

    mask = F.lit(0).cast("long") if by_hand is None else F.coalesce(F.col(by_hand).cast("long"), F.lit(0))
    for r in rules:
        if not 0 <= r[0] < MOST_GROUPS:
            raise ValueError(f"group {r[0]} is outside 0..{MOST_GROUPS - 1}")
        mask = mask.bitwiseOR(F.when(matches(r), F.lit(1 << r[0])).otherwise(F.lit(0)))
    return features.withColumn("mask", mask)


def cell_metrics(expression: DataFrame, cells: DataFrame, masks: DataFrame | None = None, groups: int = 0) -> DataFrame:
    """(cell_id, total, max_value, detected, group_g, pct_g): of every row of ``cells``, also of those without entries.

    masks (gene_id, mask) joins by key, so its size decides the join; with ``groups`` 0 no group columns come out.
    """
    e = expression
    if groups:
        e = e.join(masks.select("gene_id", "mask"), "gene_id", "left")
    aggs = [F.sum("value").alias("total"), F.max("value").alias("max_value"), F.count_if(F.col("value") != 0).alias("detected")]
    aggs += [F.sum(F.when(F.coalesce(F.col("mask"), F.lit(0)).bitwiseAND(F.lit(1 << g)) != 0, F.col("value")).otherwise(0.0)).alias(f"group_{g}") for g in range(groups)]
    out = cells.select("cell_id").join(e.groupBy("cell_id").agg(*aggs), "cell_id", "left")
    out = out.select("cell_id", *(F.coalesce(c, F.lit(0.0)).alias(c) for c in ("total", "max_value")), F.coalesce("detected", F.lit(0)).alias("detected"), *(F.coalesce(f"group_{g}", F.lit(0.0)).alias(f"group_{g}") for g in range(groups)))
    return out.withColumns({f"pct_{g}": F.when(F.col("total") > 0, 100.0 * F.col(f"group_{g}") / F.col("total")).otherwise(0.0) for g in range(groups)})


def keep_cell(min_counts: float, min_features: int, max_fraction: float, group: int = 0) -> Column:
    """total >= min_counts, detected >= min_features, and the group's fraction at most max_fraction (0 of an empty cell)."""
    fraction = F.when(F.col("total") > 0, F.col(f"group_{group}") / F.col("total")).otherwise(0.0)
    return (F.col("total") >= min_counts) & (F.col("detected") >= min_features) & (fraction <= max_fraction)


def normalize(expression: DataFrame, metrics: DataFrame, target: float = 10_000.0, mark: bool = False) -> DataFrame:
    """(cell_id, gene_id, value): log1p(value * target / total) in kept cells; dropped cells stay as they are. ``mark`` adds keep.

    metrics: cell_id, total and keep.
    """
    scale = F.when(F.col("total") > 0, target / F.col("total")).otherwise(0.0)
    value = F.when(F.col("keep"), F.log1p(F.col("value") * scale)).otherwise(F.col("value"))
    return expression.join(metrics.select("cell_id", "total", "keep"), "cell_id").select("cell_id", "gene_id", value.alias("value"), *(["keep"] if mark else []))


def gene_metrics(normalized: DataFrame, metrics: DataFrame) -> DataFrame:
    """(gene_id, sum, sum_sq, detected) over kept cells; the join is spared where ``normalized`` still has their mark ``keep``."""
    kept = normalized.where("keep") if "keep" in normalized.columns else normalized.join(metrics.where("keep").select("cell_id"), "cell_id", "left_semi")
    return kept.groupBy("gene_id").agg(F.sum("value").alias("sum"), F.sum(F.col("value") * F.col("value")).alias("sum_sq"), F.count_if(F.col("value") != 0).alias("detected"))


def keep_gene(n: Column, min_sum: float, min_cells: float, min_variance: float) -> Column:
    """sum >= min_sum, detected >= min_cells and max(0, sum_sq / n - mean^2) >= min_variance; moments are 0 if n is 0."""
    mean = F.when(n > 0, F.col("sum") / n).otherwise(0.0)
    variance = F.greatest(F.when(n > 0, F.col("sum_sq") / n).otherwise(0.0) - mean * mean, F.lit(0.0))
    return (F.col("sum") >= min_sum) & (F.col("detected").cast("double") >= min_cells) & (variance >= min_variance)
