"""The concepts of the engine read from the test tables: expression, cells, features, records, sets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def expression(spark: SparkSession, sf_dir: str, by: str | None = None) -> DataFrame:
    """(cell_id, gene_id, value): measurements counted once, summed over lanes, structural zeros absent. by: the key to which rows
    are brought first, so that whatever is grouped by it needs this one shuffle."""
    e = table(spark, sf_dir, "expr").where("gene_id is not null and cell_id >= 0 and expr_value is not null and not isnan(expr_value) and abs(expr_value) < double('inf')")
    e = e.select("cell_id", "gene_id", "lane", "expr_value")
    return (e.repartition(by) if by else e).distinct().groupBy("cell_id", "gene_id").agg(F.sum("expr_value").alias("value")).where("value <> 0")


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(cell_id, label, day, time, embryo): one row a cell, the least of what its deliveries say."""
    plain = F.btrim(F.regexp_replace(F.lower("stratum"), r"[\s_\-]+", " "))
    c = table(spark, sf_dir, "cells").select(
        "cell_id", F.when(plain != "", plain).alias("label"), F.col("day_label").alias("day"), F.nanvl("developmental_time", F.lit(None)).alias("time"), F.when(F.col("embryo_id") >= 0, F.col("embryo_id")).alias("embryo")
    )
    return c.groupBy("cell_id").agg(*(F.min(x).alias(x) for x in ("label", "day", "time", "embryo")))


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "genes")


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(cell, embryo, time, latent): one valid vector a cell, unknown embryos as -1."""
    r = table(spark, sf_dir, "neighbor_index").where("cell_index >= 0 and latent is not null and size(latent) = 64")
    r = r.where("forall(latent, v -> v is not null and not isnan(v) and abs(v) < float('inf')) and exists(latent, v -> v <> 0)")
    r = r.where("developmental_time is not null and not isnan(developmental_time)")
    known = F.when(F.col("embryo_id") >= 0, F.col("embryo_id")).otherwise(-1)
    r = r.groupBy("cell_index").agg(F.min(F.struct(known.alias("embryo"), F.col("developmental_time").cast("double").alias("time"), F.col("shard_index").alias("shard"), F.col("latent"))).alias("r"))
    return r.select(F.col("cell_index").alias("cell"), "r.embryo", "r.time", "r.shard", "r.latent")


def support(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(gene_id, cell_id): the sets, each member once."""
    return table(spark, sf_dir, "support").where("gene_id is not null and cell_id >= 0").select("gene_id", "cell_id").distinct()


EXPRESSION = """e as (
  select cell_id, gene_id, sum(expr_value) as value
  from (select distinct cell_id, gene_id, lane, expr_value from expr where gene_id is not null and cell_id >= 0 and isfinite(expr_value))
  group by all having sum(expr_value) <> 0)"""
CELLS = r"""c as (
  select cell_id, min(label) as label, min(day_label) as day, min("time") as "time", min(embryo) as embryo
  from (
    select cell_id, day_label, nullif(trim(regexp_replace(lower(stratum), '[\s_\-]+', ' ', 'g')), '') as label,
      case when isnan(developmental_time) then null else developmental_time end as "time", case when embryo_id >= 0 then embryo_id end as embryo from cells)
  group by 1)"""
RECORDS = """r as (
  select cell_index as cell, (m).embryo as embryo, (m)."time" as "time", (m).shard as shard, (m).latent as latent
  from (
    select cell_index, min({'embryo': case when embryo_id >= 0 then embryo_id else -1 end, 'time': developmental_time::double, 'shard': shard_index, 'latent': latent}) as m
    from neighbor_index
    where cell_index >= 0 and latent is not null and len(latent) = 64 and developmental_time is not null and not isnan(developmental_time)
      and len(list_filter(latent, lambda v: v is null or not isfinite(v))) = 0 and len(list_filter(latent, lambda v: v <> 0)) > 0
    group by 1))"""
SUPPORT = "s as (select distinct gene_id, cell_id from support where gene_id is not null and cell_id >= 0)"
