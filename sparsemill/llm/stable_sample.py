"""Problem 2: a sample by identifier that stays as it is when records are added.

Consistent weighted Poisson sampling: an identifier is in the sample when its hash, as a number in [0, 1), is below
rate times the largest weight it ever had. The hash depends on the identifier alone and the running maximum never
falls, so neither reruns, order, partitioning nor repeated records change the sample, and additions only enlarge it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HASH_DIGITS = 13  # hex digits of the MD5 digest: 52 bits, exact in a DOUBLE


def unit_hash(key: Column, salt: str = "") -> Column:
    """A number in [0, 1) from the text of the key; the same in every engine that has MD5."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(salt), key.cast("string"))), 1, HASH_DIGITS), 16, 10).cast("long").cast("double") / F.lit(float(16**HASH_DIGITS))


def running_weights(records: DataFrame, key: str, weight: Column, state: DataFrame | None = None) -> DataFrame:
    """(key, weight): the largest weight of every identifier in ``state`` and ``records``.

    ``state`` is an earlier result. Null and empty keys take no part; a null, NaN or negative weight counts as 0; there is no
    upper bound. One aggregation with partial maxima, so a hot identifier is reduced before the shuffle.
    """
    w = F.greatest(F.coalesce(F.nanvl(weight.cast("double"), F.lit(0.0)), F.lit(0.0)), F.lit(0.0))
    rows = records.where(F.col(key).isNotNull() & (F.col(key).cast("string") != "")).select(F.col(key), w.alias("weight"))
    if state is not None:
        rows = rows.unionByName(state.select(key, "weight"))
    return rows.groupBy(key).agg(F.max("weight").alias("weight"))


def poisson_sample(weights: DataFrame, key: str, rate: float, salt: str = "") -> DataFrame:
    """(key, weight, unit_hash, inclusion) of the identifiers in the sample; inclusion: the probability rate * weight, at most 1."""
    u, p = unit_hash(F.col(key), salt), F.least(F.col("weight") * F.lit(float(rate)), F.lit(1.0))
    return weights.select(key, "weight", u.alias("unit_hash"), p.alias("inclusion")).where("unit_hash < inclusion")
