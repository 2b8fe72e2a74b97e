"""Problem 9: texts over a token limit, cut into overlapping pieces at natural boundaries.

Of every text the token ends, the byte offset of each and the kind of boundary there are computed over whole arrays.
Cut places then come from dynamic programming: over the places where a cut is allowed, the sum of the cut penalties and
of the squared deviations of the pieces from an even size is least, under the size limit and the overlap.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._text import utf8_parts
from .bpe import chunks, default_vocabulary, encoder

PARAGRAPH, LINE, SENTENCE, CLAUSE, WORD, TOKEN, BROKEN = range(7)
PENALTY = np.array([0.0, 0.3, 1.0, 3.0, 8.0, 40.0])
BALANCE = 4.0


def boundary_kinds(raw: np.ndarray, at: np.ndarray, pretoken: np.ndarray) -> np.ndarray:
    """Kind of a cut at each byte offset ``at`` (none at either end); ``pretoken``: a pretoken begins there."""
    kind = np.full(len(at), TOKEN, np.uint8)
    before, after = raw[at - 1], raw[np.minimum(at, len(raw) - 1)]
    kind[pretoken] = WORD
    white = (after == 32) | (after == 10) | (after == 13) | (after == 9)
    kind[pretoken & white & np.isin(before, np.frombuffer(b",;:", np.uint8))] = CLAUSE
    three = np.where(at >= 3, (raw[at - 3].astype(np.uint32) << 16) | (raw[at - 2].astype(np.uint32) << 8) | before, 0)
    full_stop = np.isin(three, [0xE38082, 0xEFBC81, 0xEFBC9F])  # fixed values: the ideographic full stop, ! and ? in UTF-8
    kind[pretoken & (white & np.isin(before, np.frombuffer(b".!?", np.uint8)) | full_stop)] = SENTENCE
    line = pretoken & ((before == 10) | (before == 13)) & (after != 10) & (after != 13)
    kind[line] = LINE
    two = np.where(at >= 2, raw[at - 2], 0)
    four = np.where(at >= 4, raw[at - 4], 0)
    kind[line & ((two == 10) | ((two == 13) & (four == 13)) | ((before == 13) & (two == 13)))] = PARAGRAPH
    kind[(after & 0xC0) == 0x80] = BROKEN
    return kind


def allowed_cuts(kind: np.ndarray, n: int, step: int) -> np.ndarray:
    """Token places for the search: sentence ends and better, and where these are over ``step`` apart also worse ones."""
    nodes = np.flatnonzero(kind <= SENTENCE) + 1
    for worst in (CLAUSE, WORD, TOKEN):
        edges = np.concatenate([[0], nodes, [n]])
        wide = np.flatnonzero(np.diff(edges) > step)
        if not len(wide):
            break
        more = np.flatnonzero(kind <= worst) + 1
        gap = np.searchsorted(edges, more, "right") - 1
        inside = np.isin(gap, wide) & (edges[np.minimum(gap, len(edges) - 1)] != more)
        nodes = np.union1d(nodes, more[inside])
    return nodes


def best_cuts(n: int, limit: int, overlap: int, kind: np.ndarray, safe: np.ndarray) -> list[tuple[int, int]]:
    """Pieces as token ranges (start, end). kind[t-1]: of the cut before token t; safe[t]: the last place at or before t
    that does not break a character. Consecutive pieces share exactly ``overlap`` tokens, or up to three more where the
    shared part would begin within a character."""
    stride = limit - overlap
    nodes = np.concatenate([[0], allowed_cuts(kind, n, max(1, stride // 4)), [n]])
    start = np.where(nodes > 0, safe[np.maximum(nodes - overlap, 0)], 0)
    start[nodes <= overlap] = 0
    m = len(nodes)
    pieces = max(1, int(np.ceil((n - overlap) / stride)))
    ideal = min(limit, (n + (pieces - 1) * overlap) / pieces)
    fee = np.concatenate([[0.0], PENALTY[kind[nodes[1:-1] - 1]], [0.0]])
    low = np.searchsorted(start, nodes - limit).tolist()  # the first cut from which a piece up to this one fits
    # cost to e over c is cost(c) + w (node(e) - start(c) - ideal)^2, of which only two terms depend on c
    w = BALANCE / ideal**2
    slope = 2 * w * (start + ideal)
    own = w * (start + ideal) ** 2
    upto = np.full(m, np.inf)
    upto[0] = own[0]
    back = [0] * m
    for e, (at, plus) in enumerate(zip(nodes.tolist(), (w * nodes.astype(float) ** 2 + fee + own).tolist())):
        a = low[e]
        if e and a < e:
            total = upto[a:e] - at * slope[a:e]
            k = int(total.argmin())
            upto[e], back[e] = total[k] + plus, a + k
    if not np.isfinite(upto[-1]):
        raise ValueError("a single character has more tokens than the limit allows")
    out, e = [], m - 1
    while e:
        out.append((int(start[back[e]]), int(nodes[e])))
        e = back[e]
    return out[::-1]


def split_oversized(
    docs: DataFrame, limits: DataFrame, id_col: str = "doc_id", text_col: str = "text", kind_col: str = "doc_kind", vocabulary: str | None = None
) -> DataFrame:
    """(id, piece, n_pieces, first_token, end_token, n_tokens, cut, piece_text) of every text above its limit.

    Tokens are counted in the encoding of the whole text; encoded alone a piece has as many or fewer. ``cut`` is the kind of
    boundary at the end of the piece, -1 at the end of the text.

    ``limits`` (kind, max_tokens, overlap_tokens) is a table of settings; the row ``other`` serves null and unknown
    kinds, and without it such texts are not cut. It is joined by key, so its size decides the join. Texts within their
    limit, null and empty ones give no rows. Repeated rows give repeated pieces; other columns are ignored.
    An overlap that is not below its limit is an error, and so are two different rows of a kind.
    """
    path = vocabulary or default_vocabulary()
    kind = docs.schema[id_col].dataType.simpleString()
    lim = limits.select(F.col(kind_col).alias("_kind"), F.col("max_tokens").cast("int").alias("_most"), F.col("overlap_tokens").cast("int").alias("_over")).distinct()
    if not lim.groupBy("_kind").count().where("count > 1 and _kind is not null").isEmpty():
        raise ValueError("a kind has different limits")
    named = docs.select(docs[id_col].alias("_id"), docs[text_col].cast("string").alias("_text"), docs[kind_col].alias("_key"))
    # a text of at most so many bytes has at most so many tokens
    rest = lim.where("_kind = 'other'").select(F.col("_most").alias("_rest_most"), F.col("_over").alias("_rest_over"))
    rows = (
        named.join(lim, named["_key"] == lim["_kind"], "left")
        .join(F.broadcast(rest), how="left")  # one row at most
        .select("_id", "_text", F.when(F.col("_kind").isNull(), F.col("_rest_most")).otherwise(F.col("_most")).alias("_m"), F.when(F.col("_kind").isNull(), F.col("_rest_over")).otherwise(F.col("_over")).alias("_o"))
        .where(F.octet_length("_text") > F.col("_m"))
    )

    def run(batches):
        import pyarrow as pa

        enc = encoder(path)
        for batch in batches:
            raw, offsets = utf8_parts(batch.column(1))
            most, over = batch.column(2).to_numpy(zero_copy_only=False), batch.column(3).to_numpy(zero_copy_only=False)
            for i, j in chunks(offsets):
                part = raw[offsets[i] : offsets[j]]
                flat, ends, mark = enc.encode(part, offsets[i : j + 1] - offsets[i])
                place = np.concatenate([[0], np.cumsum(enc.n_bytes[flat])])
                rows, texts = [], []
                for d in range(j - i):
                    a, b = ends[d], ends[d + 1]
                    n, limit, overlap = int(b - a), int(most[i + d]), int(over[i + d])
                    if n <= limit:
                        continue
                    if not 0 <= overlap < limit:
                        raise ValueError(f"overlap {overlap} does not fit the limit {limit}")
                    text = part[place[a] : place[b]]
                    at = place[a + 1 : b] - place[a]
                    kinds = boundary_kinds(text, at, mark[a + 1 : b])
                    broken = np.concatenate([[False], kinds == BROKEN, [False]])
                    safe = np.maximum.accumulate(np.where(broken, 0, np.arange(n + 1)))
                    pieces = best_cuts(n, limit, overlap, kinds, safe)
                    for k, (s, e) in enumerate(pieces):
                        rows.append((i + d, k, len(pieces), s, e, e - s, int(kinds[e - 1]) if e < n else -1))
                        texts.append(text[place[a + s] - place[a] : place[a + e] - place[a]].tobytes())
                if rows:
                    c = np.array(rows, np.int64).T
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).take(pa.array(c[0])), *(pa.array(x.astype(np.int32)) for x in c[1:]), pa.array(texts, pa.binary()).cast(pa.string())],
                        ["id", "piece", "n_pieces", "first_token", "end_token", "n_tokens", "cut", "piece_text"],
                    )

    out = rows.mapInArrow(run, f"id {kind}, piece int, n_pieces int, first_token int, end_token int, n_tokens int, cut int, piece_text string")
    return out.withColumnRenamed("id", id_col)
