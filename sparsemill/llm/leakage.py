"""Problem 8: passages of held-out test items inside a corpus.

Both sides are normalised to words parted by single blanks. Every position of the corpus is hashed over q characters and
looked up among the q-grams of the items. Shared q-grams are counted in overlapping bands of diagonals; a region of the
least passage length that holds at least ``length - q + 1 - q * edits`` of them can hide a passage within the edit budget
(q-gram lemma), anything else cannot. Every retained region is verified by banded alignment, diagonal by diagonal: each
stretch of equal text in it is extended to both sides as far as every number of edits allows, which meets a passage
wherever in it the edits are. The longest run of equal words on one diagonal is measured exactly.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterable
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._text import LETTER, NUMBER, classes, format_chars, spread, utf8_parts
from ._work import cut
from .bpe import chunks

_ROOT = np.uint64(0x9E3779B97F4A7C15)
_ROOT_INVERSE = np.uint64(pow(int(_ROOT), -1, 1 << 64))
_MIX = np.uint64(0xD6E8FEB86659FD93)
BITMAP_BITS = 23
ITEM_BLOCK_BYTES = 8_000_000
HELD_HITS = 2_000_000
BLANK = 32


def plain(text: str) -> str:
    """NFKC, without format characters, in lower case."""
    text = text.replace("\x00", " ")  # the mark between texts below; no word character either
    if text.isascii():
        return text.lower()
    text = unicodedata.normalize("NFKC", text)
    cp = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    drop = format_chars()[cp]
    if drop.any():
        text = cp[~drop].tobytes().decode("utf-32-le")
    return text.lower()


def word_chars(texts: Iterable[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts as words, each followed by one blank, and the offsets of the texts."""
    joined = "\x00".join(texts) + "\x00"
    if joined.isascii():
        cp = np.frombuffer(joined.encode("ascii"), np.uint8)
        word = (classes()[:128][cp] == LETTER) | (classes()[:128][cp] == NUMBER)
    else:
        cp = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        kind = classes()[cp]
        word = (kind == LETTER) | (kind == NUMBER)
    keep = word.copy()
    keep[1:] |= word[:-1]
    out = np.where(word, cp, BLANK)[keep].astype(np.uint32)
    ends = np.flatnonzero(cp == 0)
    return out, np.concatenate([[0], np.cumsum(keep)[ends]])


def q_hashes(chars: np.ndarray, q: int) -> np.ndarray:
    """A 64-bit hash of the q characters from each position on."""
    n = len(chars) - q + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    power = _powers(len(chars))
    with np.errstate(over="ignore"):
        total = np.cumsum((chars.astype(np.uint64) + np.uint64(1)) * power[0][: len(chars)], dtype=np.uint64)
        part = total[q - 1 :].copy()
        part[1:] -= total[: n - 1]
        part *= power[1][:n]
        part ^= part >> np.uint64(32)
        part *= _MIX
    return part


_POWERS: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _POWERS or len(_POWERS[0]) < n:
        size = 1 << max(16, int(n - 1).bit_length())
        with np.errstate(over="ignore"):
            _POWERS[:] = [np.cumprod(np.concatenate([[np.uint64(1)], np.full(size - 1, x, np.uint64)]), dtype=np.uint64) for x in (_ROOT, _ROOT_INVERSE)]
    return _POWERS[0], _POWERS[1]


class Items:
    """The q-grams of one block of test items with their postings."""

    def __init__(self, ids: list, texts: list[str | None], q: int, min_words: int, edits: int):
        self.ids, self.q, self.edits = ids, q, edits
        self.chars, self.offsets = word_chars(plain(t or "") for t in texts)
        h = q_hashes(self.chars, q)
        item = np.searchsorted(self.offsets, np.arange(len(h)), "right") - 1
        inside = np.arange(len(h)) + q <= self.offsets[item + 1]
        h, item, pos = h[inside], item[inside], np.flatnonzero(inside)
        order = np.argsort(h, kind="stable")
        h, self.item, self.pos = h[order], item[order].astype(np.int64), (pos - self.offsets[item])[order]
        head = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])) if len(h) else np.zeros(0, np.int64)
        self.hash, self.first = h[head], head
        self.count = np.diff(np.append(head, len(h)))
        self.bitmap = np.zeros(1 << BITMAP_BITS, bool)
        self.bitmap[(self.hash >> np.uint64(64 - BITMAP_BITS)).astype(np.int64)] = True
        # least number of characters that min_words consecutive words of the item take, and the lemma's bound
        self.length = np.zeros(len(ids), np.int64)
        for k in range(len(ids)):
            c = self.chars[self.offsets[k] : self.offsets[k + 1]]
            gaps = np.flatnonzero(c == BLANK)
            if len(gaps) >= min_words:
                begins = np.concatenate([[0], gaps[:-1] + 1])
                self.length[k] = (gaps[min_words - 1 :] - begins[: len(gaps) - min_words + 1]).min()
        self.need = np.maximum(1, self.length - q + 1 - q * edits)

    def hits(self, chars: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Corpus positions and gram numbers of the shared q-grams."""
        h = q_hashes(chars, self.q)
        at = np.flatnonzero(self.bitmap[(h >> np.uint64(64 - BITMAP_BITS)).astype(np.int64)])
        if not len(at) or not len(self.hash):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        gram = np.minimum(np.searchsorted(self.hash, h[at]), len(self.hash) - 1)
        ok = self.hash[gram] == h[at]
        return at[ok], gram[ok]


def reach(a: np.ndarray, a_at: np.ndarray, a_room: np.ndarray, b: np.ndarray, b_at: np.ndarray, b_room: np.ndarray, step: int, edits: int, enough: np.ndarray) -> np.ndarray:
    """[row, e]: how many characters of a, from a_at on in direction ``step``, align with b from b_at on with at most e edits.

    Furthest-reaching rows of the band of diagonals within ``edits`` of the first, all stretches together; room: characters there
    are; no row goes further than ``enough``.
    """
    n, width = len(a_at), 2 * edits + 1
    shift = np.arange(-edits, edits + 1)  # characters of b ahead of a
    a_room = np.minimum(a_room, enough)
    out = np.zeros((n, edits + 1), np.int64)
    far = np.full((n, width), -1, np.int64)
    far[:, edits] = 0
    for e in range(1, edits + 1):
        was = np.pad(far, ((0, 0), (1, 1)), constant_values=-1)
        swap = np.where(was[:, 1:-1] >= 0, was[:, 1:-1] + 1, -1)
        skip = np.where(was[:, 2:] >= 0, was[:, 2:] + 1, -1)
        new = np.maximum(np.maximum(swap, skip), was[:, :-2])
        # beyond the end of either text a row cannot go; a character of a may still be given up there
        new = np.where(new >= 0, np.minimum(np.minimum(new, a_room[:, None]), b_room[:, None] - shift), -1)
        new = np.where(new + shift < 0, -1, new)
        row, lane = np.nonzero((new >= 0) & (new < a_room[:, None]))
        p = new[row, lane]
        while len(row):
            d = p + shift[lane]
            ok = (p < a_room[row]) & (d < b_room[row])
            row, lane, p, d = row[ok], lane[ok], p[ok], d[ok]
            same = a[a_at[row] + step * p] == b[b_at[row] + step * d]
            row, lane, p = row[same], lane[same], p[same] + 1
            new[row, lane] = p
        far = np.maximum(far, new)
        out[:, e] = far.max(1)
    return out


def exact_runs(items: Items, pair: np.ndarray, item: np.ndarray, d_at: np.ndarray, i_pos: np.ndarray, chars: np.ndarray, d_low: np.ndarray) -> tuple[np.ndarray, ...]:
    """(run of each hit; then per run its first and last hit, and the number of whole equal words in it).

    A run is a stretch of equal text as long as it can be: hits that follow one another on a diagonal.
    """
    q = items.q
    key = np.lexsort((d_at, d_at - i_pos, pair))
    p, dp, ip = pair[key], d_at[key], i_pos[key]
    head = np.concatenate([[True], (p[1:] != p[:-1]) | (dp[1:] != dp[:-1] + 1) | (ip[1:] != ip[:-1] + 1)])
    run = np.empty(len(key), np.int64)
    run[key] = np.cumsum(head) - 1
    first = np.flatnonzero(head)
    first, last = key[first], key[np.append(first[1:], len(key)) - 1]
    begin, end = d_at[first], d_at[last] + q  # the equal stretch in chars
    i_begin = items.offsets[item[first]] + i_pos[first]
    blanks = np.concatenate([[0], np.cumsum(chars == BLANK)])
    within = blanks[end] - blanks[begin]  # each ends a word in both texts
    opens = ((begin == d_low[first]) | (chars[np.maximum(begin - 1, 0)] == BLANK)) & ((i_pos[first] == 0) | (items.chars[np.maximum(i_begin - 1, 0)] == BLANK))
    return run, first, last, np.maximum(within - ~opens, 0)  # else the first blank ends a word that began before the stretch


def find_leaks(
    docs: DataFrame, tests: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
    q: int = 12, min_words: int = 12, edits: int = 2,
) -> DataFrame:
    """(id, item_id, shared, edits, exact_words): documents holding a passage of an item.

    A passage is at least ``min_words`` words of the item (in characters: the item's shortest such stretch) with at most
    ``edits`` character edits, wherever they are. ``shared``: q-grams in its best region; ``edits``: the fewest that align a
    passage; ``exact_words``: the longest run of consecutive words equal in both. A pair comes once. Every passage is found
    whose shortest stretch has (q + 1) * (edits + 1) - 1 characters or more (38 here); of a shorter one a stretch of q
    characters must be unedited. Null, empty and short items and texts find nothing; a repeated document row repeats its
    pairs.

    Items are searched for in blocks of ITEM_BLOCK_BYTES, each sent to the executors in one scan of the documents without a
    shuffle. If there are several blocks, what one finds is written before the next is read, so that the driver and the
    plan hold one block whatever the number of items.
    """
    kind, item_kind = docs.schema[id_col].dataType.simpleString(), tests.schema[item_col].dataType.simpleString()
    rows = docs.select(docs[id_col].alias("_id"), docs[text_col].cast("string").alias("_text")).where("length(_text) > 0")
    held = tests.select(tests[item_col].alias("i"), tests[item_text_col].cast("string").alias("t")).where("length(t) > 0")
    scanned = lambda block: rows.mapInArrow(_scanner(block, q, min_words, edits), f"id {kind}, item {item_kind}, shared int, edits int, exact_words int")
    blocks = _blocks(held)
    block, more = next(blocks, []), next(blocks, None)
    found = scanned(block) if more is None else cut(scanned(block))
    while more is not None:
        found, more = found.unionAll(cut(scanned(more))), next(blocks, None)
    return found.withColumnRenamed("id", id_col).withColumnRenamed("item", item_col)


def _blocks(held: DataFrame) -> Iterable[list[tuple]]:
    """The items in blocks of bounded size."""
    block, size = [], 0
    for r in held.toLocalIterator():
        block.append((r["i"], r["t"]))
        size += len(r["t"])
        if size > ITEM_BLOCK_BYTES:
            yield block
            block, size = [], 0
    if block:
        yield block


@lru_cache(maxsize=1)
def _items(block: tuple, q: int, min_words: int, edits: int) -> Items:
    return Items([i for i, _ in block], [t for _, t in block], q, min_words, edits)


def _scanner(block: list[tuple], q: int, min_words: int, edits: int):
    def run(batches):
        import pyarrow as pa

        items = _items(tuple(block), q, min_words, edits)
        names = pa.array(items.ids)
        for batch in batches:
            raw, offsets = utf8_parts(batch.column(1))
            for i, j in chunks(offsets):
                text = raw[offsets[i] : offsets[j]].tobytes()
                cuts = (offsets[i : j + 1] - offsets[i]).tolist()
                got = scan(items, [text[a:b].decode("utf-8") for a, b in zip(cuts, cuts[1:])])
                if len(got):
                    d, it, shared, ed, ex = got
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).take(pa.array(d + i)), names.take(pa.array(it)), *(pa.array(x.astype(np.int32)) for x in (shared, ed, ex))], ["id", "item", "shared", "edits", "exact_words"]
                    )

    return run


def scan(items: Items, texts: list[str]) -> tuple[np.ndarray, ...]:
    """(text number, item number, shared, edits, exact_words) of the verified pairs of these texts."""
    q, none = items.q, (np.zeros(0, np.int64),) * 5
    chars, d_off = word_chars(map(plain, texts))
    at, gram = items.hits(chars)
    doc = np.searchsorted(d_off, at, "right") - 1
    ok = at + q <= d_off[doc + 1]
    at, gram, doc = at[ok], gram[ok], doc[ok]
    if not len(at):
        return none
    count = items.count[gram]
    if count.sum() > HELD_HITS and len(texts) > 1:  # texts full of items: in two parts, so that memory stays bounded
        half = len(texts) // 2
        one, two = scan(items, texts[:half]), scan(items, texts[half:])
        return (np.concatenate([one[0], two[0] + half]), *(np.concatenate(x) for x in zip(one[1:], two[1:])))
    post = spread(items.first[gram], count)
    at, doc = np.repeat(at, count), np.repeat(doc, count)
    item, i_pos, d_pos = items.item[post], items.pos[post], at - d_off[doc]
    long = items.length[item] > 0
    at, doc, item, i_pos, d_pos = at[long], doc[long], item[long], i_pos[long], d_pos[long]
    if not len(at):
        return none
    # pairs that together have fewer shared q-grams than the bound are out at once
    pair = doc * len(items.ids) + item
    _, of, n = np.unique(pair, return_inverse=True, return_counts=True)
    ok = n[of] >= items.need[item]
    doc, item, i_pos, d_pos, pair = doc[ok], item[ok], i_pos[ok], d_pos[ok], pair[ok]
    if not len(doc):
        return none
    at = d_off[doc] + d_pos
    run, first, last, words = exact_runs(items, pair, item, at, i_pos, chars, d_off[doc])
    # bands of diagonals: each is 2 * step wide and shares half of it with the next, so that a shift by the edits fits one
    step = max(1, items.edits)
    band = (d_pos - i_pos) // step
    src = np.concatenate([np.arange(len(doc)), np.arange(len(doc))])
    band = np.concatenate([band, band - 1])
    order = np.lexsort((d_pos[src], band, pair[src]))
    src, band = src[order], band[order]
    p, x = pair[src], d_pos[src]
    head = np.concatenate([[True], (p[1:] != p[:-1]) | (band[1:] != band[:-1])])
    group = np.cumsum(head) - 1
    fresh = head | np.concatenate([[True], x[1:] != x[:-1]])  # each corpus position counts once in a band
    seen = np.cumsum(fresh)
    span = items.length[item[src]] - q + items.edits  # edits may stretch a passage
    key = group * np.int64(d_off[-1] + 1 + span.max()) + x
    stop = np.searchsorted(key, key + span, "right")
    shared = seen[stop - 1] - seen + 1
    held = np.flatnonzero(fresh & (shared >= items.need[item[src]]))
    if not len(held):
        return none
    # every run with a hit in a retained region is extended to both sides
    inside = np.cumsum(np.bincount(held, minlength=len(src) + 1) - np.bincount(stop[held], minlength=len(src) + 1))[:-1] > 0
    runs = np.unique(run[src[inside]])
    f, z = first[runs], last[runs]
    it, low, high = item[f], d_off[doc[f]], d_off[doc[f] + 1]
    i0, i1 = items.offsets[it] + i_pos[f], items.offsets[it] + i_pos[z] + q
    size, length = i1 - i0, items.length[it]
    enough = np.maximum(length - size, 0)
    left = reach(items.chars, i0 - 1, i0 - items.offsets[it], chars, at[f] - 1, at[f] - low, -1, items.edits, enough)
    right = reach(items.chars, i1, items.offsets[it + 1] - i1, chars, at[z] + q, high - at[z] - q, 1, items.edits, enough)
    fewest = np.full(len(runs), items.edits + 1)
    for e in range(items.edits, -1, -1):
        within = np.max([left[:, i] + right[:, e - i] for i in range(e + 1)], axis=0) + size >= length
        fewest[within] = e
    good = fewest <= items.edits
    # one row a pair: its fewest edits, its best region and its longest exact run
    u, of = np.unique(pair[f][good], return_inverse=True)
    if not len(u):
        return none
    fewest_of, best, most = np.full(len(u), items.edits), np.zeros(len(u), np.int64), np.zeros(len(u), np.int64)
    np.minimum.at(fewest_of, of, fewest[good])
    for values, keys, out in ((shared[held], p[held], best), (words, pair[first], most)):
        place = np.minimum(np.searchsorted(u, keys), len(u) - 1)
        hit = u[place] == keys
        np.maximum.at(out, place[hit], values[hit])
    return u // len(items.ids), u % len(items.ids), best, fewest_of, most
