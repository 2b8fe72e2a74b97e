"""Column formulas: activations, quantisation codes, vector products."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def relu(x: Column) -> Column:
    return F.greatest(x, F.lit(0.0))


def gelu_tanh(x: Column) -> Column:
    return 0.5 * x * (1.0 + F.tanh(F.lit(math.sqrt(2 / math.pi)) * (x + 0.044715 * x * x * x)))


def erf(x: Column) -> Column:
    """The error function to an absolute error of 1.5e-7 (rational fit; the coefficients are fixed values)."""
    p, coefficients = 0.3275911, [0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429]
    t = 1.0 / (1.0 + p * F.abs(x))
    poly = F.lit(0.0)
    for c in reversed(coefficients):
        poly = (poly + c) * t
    return F.signum(x) * (1.0 - poly * F.exp(-x * x))


def gelu(x: Column) -> Column:
    return 0.5 * x * (1.0 + erf(x / math.sqrt(2)))


def sigmoid(x: Column) -> Column:
    return 1.0 / (1.0 + F.exp(-x))


def silu(x: Column) -> Column:
    return x * sigmoid(x)


def softplus(x: Column) -> Column:
    return F.when(x > 20.0, x).otherwise(F.log1p(F.exp(F.least(x, F.lit(20.0)))))


def huber(diff: Column, delta: float) -> Column:
    return F.when(F.abs(diff) <= delta, 0.5 * diff * diff).otherwise(delta * (F.abs(diff) - 0.5 * delta))


def quantize_code(v: Column, scale: Column, offset: Column, bits: int) -> Column:
    """Nearest code, halves away from zero, clamped to what the bits hold; 0 where the scale is 0."""
    q = (v - offset) / F.nullif(scale, F.lit(0.0))
    near = F.signum(q) * F.floor(F.abs(q) + 0.5)
    return F.coalesce(F.least(F.greatest(near, F.lit(0.0)), F.lit(float(2**bits - 1))), F.lit(0.0)).cast("int")


def dequantize(code: Column, scale: Column, offset: Column) -> Column:
    return code * scale + offset


def with_dot(df: DataFrame, out: str, left: str, right: str) -> DataFrame:
    """df with the inner product of two array columns of equal length, in double precision by Arrow batches."""
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            if not batch.num_rows:
                continue
            a, b = (batch.column(batch.schema.get_field_index(c)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(batch.num_rows, -1) for c in (left, right))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.einsum("ij,ij->i", a, b))], [*batch.schema.names, out])

    return df.mapInArrow(run, f"{fields}, `{out}` double")


def unit_vector(v: Column) -> Column:
    """v over its length; a zero vector stays zero."""
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x.cast("double") * x))
    return F.transform(v, lambda x: F.when(norm * norm > 1e-20, x / norm).otherwise(0.0))
