"""Code-point tables and ragged-array helpers shared by the text operators."""

from __future__ import annotations

import unicodedata
from functools import lru_cache

import numpy as np

OTHER, LETTER, NUMBER, BLANK, SPACE = 0, 1, 2, 3, 4

# The code points with the Unicode property White_Space.
WHITE_SPACE = [0x09, 0x0A, 0x0B, 0x0C, 0x0D, 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]


@lru_cache(maxsize=1)
def classes() -> np.ndarray:
    """Per code point: letter, number, the plain blank, other white space, or anything else."""
    kind = {"L": LETTER, "N": NUMBER}
    out = np.fromiter((kind.get(unicodedata.category(chr(c))[0], OTHER) for c in range(0x110000)), np.uint8, 0x110000)
    out[WHITE_SPACE] = SPACE
    out[0x20] = BLANK
    return out


@lru_cache(maxsize=1)
def format_chars() -> np.ndarray:
    """True for the code points of category Cf."""
    return np.fromiter((unicodedata.category(chr(c)) == "Cf" for c in range(0x110000)), bool, 0x110000)


def spread(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Concatenation of first[i], first[i]+1, ... count[i] numbers each."""
    total = int(count.sum())
    ends = np.cumsum(count)
    return np.repeat(first - (ends - count), count) + np.arange(total, dtype=np.int64)


def utf8_parts(column) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of an Arrow string column and the offsets of its rows; null rows are empty."""
    import pyarrow as pa

    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    column = column.fill_null("").cast(pa.large_string())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64, len(column) + 1, 8 * column.offset)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]
