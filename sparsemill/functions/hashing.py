"""Wrapping 64-bit hashes on BIGINT bit patterns, with ANSI arithmetic left on."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The public SplitMix64 constants, the FNV-1a offset and prime, and the domain separators of the sampling
# and sketching hashes.
GAMMA = 0x9E3779B97F4A7C15
MULTIPLIERS = (0xBF58476D1CE4E5B9, 0x94D049BB133111EB)
FNV_OFFSET, FNV_PRIME = 14695981039346656037, 1099511628211
ROW_DOMAIN, CELL_DOMAIN = 0x726F775F69645F31, 0x63656C6C5F696431
SKETCH_STRIDE, MINHASH_DOMAIN = 0xD2B74407B1CE6E93, 0x4D494E4841534851
BAND_DOMAIN, BUCKET_DOMAIN = 0x4C53485F42414E44, 0x4255434B45545F31

MASK = (1 << 64) - 1


def signed(x: int) -> int:
    """The BIGINT with the bits of x."""
    x &= MASK
    return x - (1 << 64) if x >> 63 else x


def splitmix(x: int) -> int:
    """SplitMix64 of a Python integer, for constants known to the driver."""
    x = (x + GAMMA) & MASK
    x = ((x ^ (x >> 30)) * MULTIPLIERS[0]) & MASK
    x = ((x ^ (x >> 27)) * MULTIPLIERS[1]) & MASK
    return x ^ (x >> 31)


def with_splitmix(df: DataFrame, out: str, value: Column) -> DataFrame:
    """out = SplitMix64 of a BIGINT column; null stays null."""
    return df.withColumn(out, splitmix_column()(value))


def splitmix_column():
    """SplitMix64 as a function of a column.

    Wrapping products overflow under ANSI arithmetic, and sums of limbs are copied by every pushed-down filter until the
    plan no longer fits memory; a function on Arrow batches is opaque to that and needs a few array operations a batch.
    """

    @F.arrow_udf("long")
    def mix(x: pa.Array) -> pa.Array:
        h = mix_array(x.fill_null(0).to_numpy(zero_copy_only=False).view(np.uint64)).view(np.int64)
        return pa.array(h, mask=np.asarray(x.is_null()))

    return mix


def with_row_hash(df: DataFrame, out: str, row: Column, seed: int) -> DataFrame:
    """Hash of a global row number under a seed."""
    return with_splitmix(df, out, row.bitwiseXOR(F.lit(signed(splitmix(seed ^ ROW_DOMAIN)))))


def with_id_hash(df: DataFrame, out: str, col: str, seed: int) -> DataFrame:
    """out = hash of a stable identifier: FNV-1a over its UTF-8 bytes, folded with its length, under a seed.

    The fold is sequential in the bytes, so it runs over Arrow batches: one array step a byte position. Null gives null.
    """
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    at = df.columns.index(col)

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, _id_hashes(batch.column(at), seed)], [*batch.schema.names, out])

    return df.mapInArrow(run, f"{fields}, `{out}` long")


def mix_array(x: np.ndarray) -> np.ndarray:
    """SplitMix64 of unsigned numbers."""
    with np.errstate(over="ignore"):
        x = x + np.uint64(GAMMA)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(MULTIPLIERS[0])
        x = (x ^ (x >> np.uint64(27))) * np.uint64(MULTIPLIERS[1])
    return x ^ (x >> np.uint64(31))


def _id_hashes(column: pa.Array, seed: int) -> pa.Array:
    text = column.fill_null("").cast(pa.large_string())
    _, offsets, data = text.buffers()
    at = np.frombuffer(offsets, np.int64, len(text) + 1, 8 * text.offset)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    at, size = at[:-1], np.diff(at)
    fold = np.full(len(text), FNV_OFFSET, np.uint64)
    order = np.argsort(-size, kind="stable")  # those that have an i-th byte come first
    for i in range(int(size.max(initial=0))):
        rows = order[: np.searchsorted(-size[order], -i)]
        with np.errstate(over="ignore"):
            fold[rows] = (fold[rows] ^ raw[at[rows] + i]) * np.uint64(FNV_PRIME)
    fold ^= mix_array(size.astype(np.uint64) ^ np.uint64(CELL_DOMAIN))
    return pa.array(mix_array(fold ^ np.uint64(splitmix(seed ^ CELL_DOMAIN))).view(np.int64), mask=np.asarray(column.is_null()))


def unsigned_order(c: Column) -> Column:
    """A BIGINT whose signed order is the unsigned order of c."""
    return c.bitwiseXOR(F.lit(signed(1 << 63)))


def unsigned_mod(c: Column, n: Column) -> Column:
    """c modulo n with c read as unsigned."""
    half = F.shiftrightunsigned(c, 1)
    return F.pmod(F.pmod(half, n) * 2 + c.bitwiseAND(F.lit(1)), n)


def unsigned_decimal(c: Column) -> Column:
    """The unsigned value as DECIMAL(20, 0)."""
    d = c.cast("decimal(20,0)")
    return F.when(c < 0, d + F.lit(1 << 64).cast("decimal(20,0)")).otherwise(d).cast("decimal(20,0)")


# -- the same in SQL ----------------------------------------------------------------------------------------------------
def sql_signed(u: str) -> str:
    return f"(case when {u} >= 9223372036854775808 then ({u}::hugeint - 18446744073709551616)::bigint else {u}::bigint end)"


def sql_unsigned(s: str) -> str:
    return f"(case when {s} < 0 then ({s}::hugeint + 18446744073709551616)::ubigint else {s}::ubigint end)"


def sql_splitmix(source: str, out: str, value: str) -> str:
    """A query adding ``out`` (UBIGINT), SplitMix64 of the UBIGINT expression ``value``, to the rows of ``source``."""
    m = "18446744073709551616::uhugeint"
    q = f"select *, ((({value})::uhugeint + {GAMMA}) % {m})::ubigint as _z from ({source})"
    for shift, k in zip((30, 27), MULTIPLIERS):
        q = f"select * exclude (_z), ((xor(_z, _z >> {shift})::uhugeint * {k}::uhugeint) % {m})::ubigint as _z from ({q})"
    return f"select * exclude (_z), xor(_z, _z >> 31) as {out} from ({q})"
