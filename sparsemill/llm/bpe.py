"""Problem 7: token ids of every text under a byte-level BPE vocabulary.

Pretokens are found by class comparisons over whole arrays of code points. The distinct pretokens of a batch are
encoded in length buckets of padded matrices: in every round each row merges its leftmost pair of minimum rank, found
by a hashed pair lookup, and the matrix is compacted by the one column each row has lost; rows without a pair leave.
Results are kept per worker in a hashed cache of exact pretoken bytes, bounded by ``CACHE_WORDS``.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame

from ._text import BLANK, LETTER, OTHER, classes, spread, utf8_parts

NONE = np.int32(2**31 - 1)
CACHE_WORDS = 1_500_000
CHUNK_BYTES = 3_000_000
MATRIX_LIMIT = 2048
BUCKETS = [2, 3, 4, 5, 6, 7, 8, 10, 12, 14, 16, 20, 24, 32, 48, 64, 96, 128, 192, 256, 512, 1024, MATRIX_LIMIT]
_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


class HashedPairs:
    """Open-addressing map from a pair of token ids to the id (and rank) of the merged token."""

    def __init__(self, left: np.ndarray, right: np.ndarray, merged: np.ndarray):
        self.bits = max(8, int(np.ceil(np.log2(max(1, len(left)) * 4))))
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.vals = np.full(1 << self.bits, NONE, np.int32)
        key, value = (left.astype(np.int64) << 32) | right.astype(np.int64), merged.astype(np.int32)
        slot, self.probes = self._slot(key), 0
        while len(key):
            self.probes += 1
            free = np.flatnonzero(self.keys[slot] == -1)
            _, first = np.unique(slot[free], return_index=True)
            take = free[first]
            self.keys[slot[take]], self.vals[slot[take]] = key[take], value[take]
            rest = np.ones(len(key), bool)
            rest[take] = False
            key, value, slot = key[rest], value[rest], (slot[rest] + 1) & (len(self.keys) - 1)

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key.astype(np.uint64) * _M1) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = (left.astype(np.int64) << 32) | right.astype(np.int64)
        slot = self._slot(key)
        there = self.keys[slot]
        out = np.where(there == key, self.vals[slot], NONE)
        open_ = np.flatnonzero((there != key) & (there != -1))
        for _ in range(self.probes):
            if not len(open_):
                break
            slot_o = (slot[open_] + 1) & (len(self.keys) - 1)
            slot[open_] = slot_o
            there = self.keys[slot_o]
            hit = there == key[open_]
            out[open_[hit]] = self.vals[slot_o[hit]]
            open_ = open_[~hit & (there != -1)]
        return out


class Encoder:
    """A vocabulary of ranks with its pair table and the cache of encoded pretokens."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.byte_ids = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        found = [(ranks[t[:i]], ranks[t[i:]], r) for t, r in ranks.items() for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks]
        self.pairs = HashedPairs(*np.array(found, np.int64).reshape(-1, 3).T)
        self.n_bytes = np.zeros(max(ranks.values()) + 1, np.int32)
        for t, r in ranks.items():
            self.n_bytes[r] = len(t)
        self.reset()

    # -- cache of pretokens -------------------------------------------------------------------------------------
    def reset(self) -> None:
        self.n_words = 0
        self.bits = 17
        self.k1, self.k2 = np.zeros(1 << self.bits, np.uint64), np.zeros(1 << self.bits, np.uint64)
        self.word = np.full(1 << self.bits, -1, np.int32)
        self.long: dict[bytes, int] = {}
        self.flat, self.flat_n = np.zeros(1 << 18, np.int32), 0
        self.first, self.count = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int32)

    def _slots(self, k1: np.ndarray, k2: np.ndarray) -> np.ndarray:
        mixed = (k1 ^ (k2 * _M2)) * _M1
        return ((mixed ^ (mixed >> np.uint64(29))) * _M2 >> np.uint64(64 - self.bits)).astype(np.int64)

    def _find(self, k1: np.ndarray, k2: np.ndarray) -> np.ndarray:
        slot = self._slots(k1, k2)
        out = self.word[slot]
        open_ = np.flatnonzero((out != -1) & ((self.k1[slot] != k1) | (self.k2[slot] != k2)))
        while len(open_):
            s = (slot[open_] + 1) & (len(self.word) - 1)
            slot[open_] = s
            w = self.word[s]
            out[open_] = w
            open_ = open_[(w != -1) & ((self.k1[s] != k1[open_]) | (self.k2[s] != k2[open_]))]
        return out

    def _insert(self, k1: np.ndarray, k2: np.ndarray, word: np.ndarray) -> None:
        slot = self._slots(k1, k2)
        while len(slot):
            free = np.flatnonzero(self.word[slot] == -1)
            _, first = np.unique(slot[free], return_index=True)
            take = free[first]
            s = slot[take]
            self.k1[s], self.k2[s], self.word[s] = k1[take], k2[take], word[take]
            rest = np.ones(len(slot), bool)
            rest[take] = False
            k1, k2, word, slot = k1[rest], k2[rest], word[rest], (slot[rest] + 1) & (len(self.word) - 1)

    def _remember(self, ids: np.ndarray, count: np.ndarray) -> np.ndarray:
        n, need = len(count), self.flat_n + len(ids)
        while need > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        while self.n_words + n > len(self.first):
            self.first, self.count = np.concatenate([self.first, np.zeros_like(self.first)]), np.concatenate([self.count, np.zeros_like(self.count)])
        at = np.arange(self.n_words, self.n_words + n)
        self.flat[self.flat_n : need] = ids
        self.first[at] = self.flat_n + np.cumsum(count) - count
        self.count[at] = count
        self.flat_n, self.n_words = need, self.n_words + n
        return at.astype(np.int32)

    def _grow(self, more: int) -> None:
        if (self.n_words + more) * 2 <= len(self.word):
            return
        old = self.word != -1
        k1, k2, word = self.k1[old], self.k2[old], self.word[old]
        while (self.n_words + more) * 2 > 1 << self.bits:
            self.bits += 1
        self.k1, self.k2 = np.zeros(1 << self.bits, np.uint64), np.zeros(1 << self.bits, np.uint64)
        self.word = np.full(1 << self.bits, -1, np.int32)
        self._insert(k1, k2, word)

    # -- merging ------------------------------------------------------------------------------------------------
    def merge(self, raw: np.ndarray, start: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of the byte slices, flat in their order, and their counts."""
        ids = np.zeros(int(length.sum()), np.int32)  # room for one id a byte, compacted at the end
        room = np.cumsum(length) - length
        count = np.ones(len(length), np.int64)
        one = np.flatnonzero(length == 1)
        ids[room[one]] = self.byte_ids[raw[start[one]]]
        low = 1
        for high in BUCKETS:
            rows = np.flatnonzero((length > low) & (length <= high))
            low = high
            step = max(1, 2_000_000 // high)
            for b in range(0, len(rows), step):
                self._merge_rows(raw, start, length, rows[b : b + step], high, ids, room, count)
        for i in np.flatnonzero(length > MATRIX_LIMIT):
            out = self._merge_long(raw[start[i] : start[i] + length[i]])
            ids[room[i] : room[i] + len(out)] = out
            count[i] = len(out)
        return ids[spread(room, count)], count

    def _merge_rows(self, raw, start, length, rows, width, ids, room, count) -> None:
        cols = np.arange(width)
        inside = cols < length[rows, None]
        m = np.where(inside, self.byte_ids[raw[np.where(inside, start[rows, None] + cols, 0)]], -1).astype(np.int32)
        r = np.full((len(rows), width - 1), NONE, np.int32)
        pair = inside[:, 1:]
        r[pair] = self.pairs.find(m[:, :-1][pair], m[:, 1:][pair])
        left = length[rows].astype(np.int64)
        while True:
            n = len(rows)
            if r.shape[1]:
                at = r.argmin(1)
                best = r[np.arange(n), at]
                done = best == NONE
            else:
                done = np.ones(n, bool)
            if done.any():
                d = np.flatnonzero(done)
                count[rows[d]] = left[d]
                ids[spread(room[rows[d]], left[d])] = m[np.repeat(d, left[d]), spread(np.zeros(len(d), np.int64), left[d])]
                keep = np.flatnonzero(~done)
                if not len(keep):
                    return
                rows, m, r, left, at, best, n = rows[keep], m[keep], r[keep], left[keep], at[keep], best[keep], len(keep)
            i = np.arange(n)
            before = np.arange(m.shape[1] - 1) <= at[:, None]
            m = np.where(before, m[:, :-1], m[:, 1:])
            m[i, at] = best
            r = np.where(before[:, :-1], r[:, :-1], r[:, 1:])
            left = left - 1
            if r.shape[1]:
                a = np.flatnonzero(at > 0)
                r[a, at[a] - 1] = self.pairs.find(m[a, at[a] - 1], m[a, at[a]])
                a = np.flatnonzero(at < left - 1)
                r[a, at[a]] = self.pairs.find(m[a, at[a]], m[a, at[a] + 1])
                a = np.flatnonzero((at == left - 1) & (at < r.shape[1]))
                r[a, at[a]] = NONE

    def _merge_long(self, raw: np.ndarray) -> list[int]:
        """The same merges of one very long pretoken, with a queue of (rank, place) instead of a matrix."""
        ids = self.byte_ids[raw].tolist()
        n = len(ids)
        rank = self.pairs.find(np.array(ids[:-1]), np.array(ids[1:])).tolist()
        nxt, prv = list(range(1, n + 1)), list(range(-1, n - 1))
        queue = [(r, i) for i, r in enumerate(rank) if r != NONE]
        heapq.heapify(queue)
        rank.append(int(NONE))
        look = self._rank_of
        while queue:
            r, i = heapq.heappop(queue)
            if rank[i] != r or ids[i] < 0:
                continue
            j = nxt[i]
            ids[i], ids[j] = r, -1
            nxt[i] = k = nxt[j]
            rank[j] = int(NONE)
            rank[i] = int(NONE)
            if k < n:
                prv[k] = i
                rank[i] = look(ids[i], ids[k])
                if rank[i] != NONE:
                    heapq.heappush(queue, (rank[i], i))
            if (p := prv[i]) >= 0:
                rank[p] = look(ids[p], ids[i])
                if rank[p] != NONE:
                    heapq.heappush(queue, (rank[p], p))
        return [x for x in ids if x >= 0]

    def _rank_of(self, left: int, right: int) -> int:
        p, key = self.pairs, (left << 32) | right
        slot = ((key * int(_M1)) & 0xFFFFFFFFFFFFFFFF) >> (64 - p.bits)
        while (there := p.keys[slot]) != -1:
            if there == key:
                return int(p.vals[slot])
            slot = (slot + 1) & (len(p.keys) - 1)
        return int(NONE)

    # -- texts --------------------------------------------------------------------------------------------------
    def words(self, raw: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Cache places of the pretokens; unknown ones are encoded and remembered."""
        if self.n_words > CACHE_WORDS:
            self.reset()
        out = np.full(len(start), -1, np.int32)
        short = np.flatnonzero(length <= 15)
        padded = np.concatenate([raw, np.zeros(16, np.uint8)])
        eight = np.ndarray((len(raw) + 8,), "<u8", padded.data, strides=(1,))
        n, at = length[short].astype(np.uint64), start[short]
        mask = np.concatenate([(np.uint64(1) << (np.uint64(8) * np.arange(8, dtype=np.uint64))) - np.uint64(1), [np.uint64(2**64 - 1)]])
        k1 = eight[at] & mask[np.minimum(n, 8)]
        more = np.maximum(n, 8) - np.uint64(8)
        k2 = (eight[at + np.minimum(length[short], 8)] & mask[more]) | (n << np.uint64(56))
        got = self._find(k1, k2)
        new = np.flatnonzero(got == -1)
        if len(new):
            order = new[np.lexsort((k1[new], k2[new]))]
            a, b = k1[order], k2[order]
            head = np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])])
            first = order[head]
            word = self._remember(*self.merge(raw, at[first], length[short][first]))
            self._grow(len(first))
            self._insert(k1[first], k2[first], word)
            got[order] = word[np.cumsum(head) - 1]
        out[short] = got
        wide = np.flatnonzero(length > 15)
        if len(wide):
            data = raw.tobytes()
            seen = [data[s : s + n] for s, n in zip(start[wide].tolist(), length[wide].tolist())]
            fresh: dict[bytes, int] = {}
            for i, w in enumerate(seen):
                if w not in self.long and w not in fresh:
                    fresh[w] = i
            if fresh:
                rows = wide[np.fromiter(fresh.values(), np.int64, len(fresh))]
                self.long.update(zip(fresh, self._remember(*self.merge(raw, start[rows], length[rows])).tolist()))
            out[wide] = [self.long[w] for w in seen]
        return out

    def encode(self, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of UTF-8 texts one after another: flat token ids, offsets by text, and a mark at each pretoken's first token."""
        start, of_text = pretokens(raw, offsets)
        length = np.diff(np.append(start, len(raw)))
        word = self.words(raw, start, length)
        count = self.count[word].astype(np.int64)
        ends = np.concatenate([[0], np.cumsum(count)])
        flat = self.flat[spread(self.first[word], count)]
        mark = np.zeros(len(flat), bool)
        mark[ends[:-1]] = True
        return flat, ends[of_text], mark


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def pretokens(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte starts of the pretokens and, per text, the number of pretokens before it (one entry more than texts).

    The split is that of the vocabulary's public pattern: contractions, an optional blank before a run of letters, of
    numbers or of other characters, and white space, whose last character stays with what follows.
    """
    if not len(raw):
        return np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    place = None
    if raw.max() < 0x80:
        cp, kind = raw, classes()[:128][raw]
        doc = offsets[:-1][offsets[:-1] < offsets[1:]]
    else:
        cp = np.frombuffer(raw.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
        kind = classes()[cp]
        place = np.flatnonzero((raw & 0xC0) != 0x80)
        doc = np.searchsorted(place, offsets[:-1][offsets[:-1] < offsets[1:]])
    n = len(cp)
    first = np.zeros(n + 1, bool)
    first[doc] = True
    first[n] = True
    white = kind >= BLANK
    cut = np.zeros(n, bool)
    cut[1:] = (kind[1:] != kind[:-1]) & (kind[:-1] != BLANK) & ~(white[1:] & white[:-1])  # a run begins, or white space does
    tail = white.copy()  # the last of a white run, where a text goes on behind it
    tail[:-1] &= ~white[1:]
    tail &= ~first[1:]
    cut |= tail
    cut |= first[:n]
    quote = np.flatnonzero((cp == 39) & cut & np.concatenate([[True], (kind[:-1] != OTHER)]) | ((cp == 39) & first[:n]))
    quote = quote[(quote + 1 < n) & ~first[np.minimum(quote + 1, n)]]
    if len(quote):
        a = cp[quote + 1]
        two = quote[np.isin(a, [115, 116, 109, 100])]  # s t m d
        ok = (quote + 2 < n) & ~first[np.minimum(quote + 2, n)]
        b = cp[np.minimum(quote + 2, n - 1)]
        three = quote[ok & (((a == 114) & (b == 101)) | ((a == 118) & (b == 101)) | ((a == 108) & (b == 108)))]  # re ve ll
        cut[two + 1] = False
        cut[two[two + 2 < n] + 2] = True
        cut[three + 1] = False
        cut[three + 2] = False
        cut[three[three + 3 < n] + 3] = True
    start = np.flatnonzero(cut)
    if place is not None:
        start = place[start]
    return start, np.searchsorted(start, offsets)


def chunks(offsets: np.ndarray, most: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows whose texts hold about that many bytes together."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1)
        yield i, j
        i = j


def encode_corpus(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None) -> DataFrame:
    """(id, ids): the token ids of every text; empty and null texts give an empty list.

    One scan of the two columns, no shuffle. Rows keep their multiplicity; other columns are ignored, so their names
    cannot clash. ``vocabulary`` is the path of a file of byte-level ranks that every executor can read.
    """
    path = vocabulary or default_vocabulary()

    def run(batches):
        import pyarrow as pa

        enc = encoder(path)
        for batch in batches:
            raw, offsets = utf8_parts(batch.column(1))
            for i, j in chunks(offsets):
                flat, ends, _ = enc.encode(raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                ids = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(flat))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), ids], ["id", "ids"])

    kind = docs.schema[id_col].dataType.simpleString()
    out = docs.select(docs[id_col], docs[text_col].cast("string")).mapInArrow(run, f"id {kind}, ids array<int>")
    return out.withColumnRenamed("id", id_col)
