"""Problem 3: the most similar vectors of every vector.

NN-descent: a light first graph is improved, round by round, by joining neighbours of neighbours until few entries change.
The first graph compares vectors within the leaves of a coarse partition whose centroids are fitted on a bounded sample: a
vector is a member of its nearest leaf and visits a few more. Crowded leaves are split by hash, which leaves a random start
within them. A round sends every vector to the blocks in which it is a neighbour, compares all pairs of neighbours of each
node there, and merges what improves a list; where a node lives decides only what has to travel, not what can meet. Queries
are answered by greedy search along the graph.

All vectors are scaled to unit length; similarity is the cosine.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._text import spread
from ._work import cut, drop, shuffle_parts

LISTS = "id long, home int, nbrs array<long>, sims array<float>, homes array<int>"
BORDER = 1e-4
_ODD = np.uint64(0x9E3779B97F4A7C15)
GRAPH = LISTS + ", fresh int"


# -- arrays -----------------------------------------------------------------------------------------------------------
def best_of(row: np.ndarray, col: np.ndarray, sim: np.ndarray, k: int) -> np.ndarray:
    """Places of the k most similar distinct col of each row, ordered by row, then similarity, then col."""
    order = np.lexsort((-sim, col, row))
    head = np.ones(len(order), bool)
    head[1:] = (row[order][1:] != row[order][:-1]) | (col[order][1:] != col[order][:-1])
    order = order[head]
    order = order[np.lexsort((col[order], -sim[order], row[order]))]
    r = row[order]
    head = np.flatnonzero(np.concatenate([[True], r[1:] != r[:-1]])) if len(r) else np.zeros(0, np.int64)
    rank = np.arange(len(r)) - np.repeat(head, np.diff(np.append(head, len(r))))
    return order[rank < k]


def _at_least(s: np.ndarray, k: int, axis: int) -> np.ndarray:
    """A bound that the k-th largest of s along the axis reaches: the k-th largest of maxima over sixteen each."""
    n = s.shape[axis]
    if n <= 16 * k:
        return np.partition(s, n - k, axis=axis).take(n - k, axis=axis) if n > k else np.full(s.shape[1 - axis], -2.0, np.float32)
    g = n // 16
    if axis:
        m = s[:, : 16 * g].reshape(len(s), 16, g).max(1)
        return np.partition(m, g - k, axis=1)[:, g - k]
    m = s[: 16 * g].reshape(16, g, s.shape[1]).max(0)
    return np.partition(m, g - k, axis=0)[g - k]


def _by_row(row: np.ndarray, n: int) -> np.ndarray:
    """A stable order by row."""
    return np.argsort(row.astype(np.uint16) if n <= 1 << 16 else row, kind="stable")


def _keep_best(row: np.ndarray, col: np.ndarray, sim: np.ndarray, n: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best entries of each row, ordered by row, similarity and col; (row, col) must be distinct."""
    order = _by_row(row, n)
    row, col, sim = row[order], col[order], sim[order]
    size = np.bincount(row, minlength=n)
    place = np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)
    m = np.full((n, max(k, int(size.max(initial=0)))), -3.0, np.float32)
    c = np.full(m.shape, np.iinfo(np.int64).max)
    m[row, place], c[row, place] = sim, col
    if m.shape[1] > k:
        top = np.argpartition(-m, k - 1, axis=1)[:, :k]
        bound = np.take_along_axis(m, top, 1).min(1)
        tied = np.flatnonzero(((m == bound[:, None]).sum(1) > 1) & (bound > -3))  # then the cols decide
        if len(tied):
            top[tied] = np.lexsort((c[tied], -m[tied]), axis=1)[:, :k]
        m, c = np.take_along_axis(m, top, 1), np.take_along_axis(c, top, 1)
    order = np.lexsort((c, -m), axis=1)
    m, c = np.take_along_axis(m, order, 1), np.take_along_axis(c, order, 1)
    at = np.flatnonzero(m.ravel() > -3)
    return at // m.shape[1], c.ravel()[at], m.ravel()[at]


def block_neighbours(x: np.ndarray, leaf: np.ndarray, probe: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, col, sim): for each vector of a block the k most similar among those it meets in the block's leaves.

    leaf: the vector's own leaf in this block or -1; probe[row, j]: leaves it visits, -1 for none. Within a leaf every
    visitor meets every member, and both get the other: the member here only if it does not visit the visitor's own leaf,
    where it would meet it again.
    """
    n = len(x)
    kth = np.full(n, -1.5, np.float32)
    rows, cols, sims = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.float32))
    flat = np.argsort(probe, axis=None, kind="stable")
    flat = flat[probe.ravel()[flat] >= 0]
    by, who = probe.ravel()[flat], flat // probe.shape[1]
    cuts = np.flatnonzero(np.concatenate([[True], by[1:] != by[:-1], [True]])) if len(by) else np.zeros(1, np.int64)
    place = np.full(n, -1)
    new: list[tuple] = []
    held = 0

    def settle():
        nonlocal rows, cols, sims, new, held
        rows, cols, sims = _keep_best(*(np.concatenate([a, *b]) for a, b in zip((rows, cols, sims), zip(*new))), n, k)
        size = np.bincount(rows, minlength=n)
        full = np.flatnonzero(size >= k)
        kth[full] = sims[np.cumsum(size)[full] - 1]
        new, held = [], 0

    for a, b in zip(cuts[:-1], cuts[1:]):
        members, visitors = np.flatnonzero(leaf == by[a]), who[a:b]
        if not len(members):
            continue
        y = x[members]
        place[members] = np.arange(len(members))
        for i in range(0, len(visitors), 2048):
            v = visitors[i : i + 2048]
            s = x[v] @ y.T
            own = np.flatnonzero(place[v] >= 0)
            s[own, place[v[own]]] = -2.0
            need = np.maximum(_at_least(s, k, 1), kth[v])
            at = np.flatnonzero((s >= need[:, None]).ravel())
            r, c = np.divmod(at, len(members))
            new.append((v[r], members[c], s.ravel()[at]))
            need = np.maximum(_at_least(s, k, 0), kth[members])
            at = np.flatnonzero((s >= need).ravel())
            r, c = np.divmod(at, len(members))
            r, c = v[r], members[c]
            once = (leaf[r] < 0) | (probe[c] != leaf[r][:, None]).all(1)
            new.append((c[once], r[once], s.ravel()[at[once]]))
            held += len(new[-1][0]) + len(new[-2][0])
        place[members] = -1
        if held > 40 * n:
            settle()
    if new:
        settle()
    return rows, cols, sims


# -- vectors ----------------------------------------------------------------------------------------------------------
def valid(vec: Column, id_: Column, dim: int) -> Column:
    """True for rows that take part, as far as the engine can tell; non-finite and zero vectors are found later."""
    return id_.isNotNull() & (id_ >= 0) & vec.isNotNull() & (F.size(vec) == dim)


def _unit(lists, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Unit rows of an Arrow list column without null rows and a mark of those that are finite and not zero."""
    flat = lists.flatten()
    x = flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
    with np.errstate(all="ignore"):
        top = np.abs(x).max(axis=1, keepdims=True, initial=0)
        ok = np.isfinite(x).all(1) & (top[:, 0] > 0)
        x = x / top
        x = x / np.sqrt((x * x).sum(1, keepdims=True))
    return x.astype(np.float32), ok


def fit_leaves(sample: np.ndarray, count: int, seed: int = 7, rounds: int = 8) -> np.ndarray:
    """Unit centroids of about ``count`` leaves by spherical k-means."""
    rng = np.random.default_rng(seed)
    count = max(1, min(count, len(sample)))
    c = sample[rng.choice(len(sample), count, replace=False)].copy()
    for _ in range(rounds):
        near = np.concatenate([(sample[i : i + 4096] @ c.T).argmax(1) for i in range(0, len(sample), 4096)])
        order = np.argsort(near, kind="stable")
        used, first = np.unique(near[order], return_index=True)
        total = np.add.reduceat(sample[order], first, axis=0)
        norm = np.linalg.norm(total, axis=1, keepdims=True)
        ok = norm[:, 0] > 1e-9
        c[used[ok]] = total[ok] / norm[ok]
    return c


class Layout:
    """Leaves and their blocks, with a bound on what meets in one block.

    A leaf with many members is split by a hash of the id: its members and visitors meet within a part, and its members
    visit one other part as well, so that links lead from every part to others and the rounds bring the rest together. A
    leaf with few members and many visitors (a crowd nearby) has its visitors split, and its members in every part.
    """

    def __init__(self, sample: np.ndarray, n: int, leaf_rows: int, block_leaves: int | tuple[int, int], probes: int):
        self.leaves = fit_leaves(sample, max(1, round(n / leaf_rows)))
        count = len(self.leaves)
        if isinstance(block_leaves, tuple):  # some two dozen blocks keep a small session busy; beyond, larger ones part less
            block_leaves = int(np.clip(count // 24, *block_leaves))
        near = np.concatenate([self._nearest(sample[i : i + 4096], probes) for i in range(0, len(sample), 4096)]) if len(sample) else np.zeros((0, 1), int)
        rows = n / max(1, len(sample))
        members = np.bincount(near[:, 0], minlength=count) * rows
        visits = np.bincount(near.ravel(), minlength=count) * rows
        self.parts = np.maximum(1, np.ceil(members / (4 * leaf_rows))).astype(np.int64)
        self.spread = self.parts == 1  # members in every part
        self.parts[self.spread] = np.maximum(1, np.ceil(visits / (4 * probes * leaf_rows))).astype(np.int64)[self.spread]
        hubs = fit_leaves(self.leaves, max(1, count // block_leaves), rounds=10)
        hub = (self.leaves @ hubs.T).argmax(1)
        self.block = np.zeros(count, np.int64)
        at, room, last = -1, 0.0, -1
        for leaf in np.argsort(hub, kind="stable"):  # neighbouring leaves share a block; a split leaf has its own ones
            if self.parts[leaf] > 1 or room <= 0 or hub[leaf] != last:
                at, room, last = at + 1, block_leaves * leaf_rows, hub[leaf]
            self.block[leaf] = at
            room -= members[leaf]
            if self.parts[leaf] > 1:
                at, room = at + int(self.parts[leaf]) - 1, 0

    def _nearest(self, x: np.ndarray, probes: int) -> np.ndarray:
        p = min(probes, len(self.leaves))
        s = x @ self.leaves.T
        top = np.argpartition(-s, p - 1, axis=1)[:, :p] if p < s.shape[1] else np.tile(np.arange(p), (len(s), 1))
        return np.take_along_axis(top, np.argsort(-np.take_along_axis(s, top, 1), axis=1, kind="stable"), 1)

    def places(self, ids: np.ndarray, x: np.ndarray, probes: int) -> tuple[np.ndarray, np.ndarray]:
        """(leaf, block) of the ``probes`` nearest leaves, nearest first, and of another part of the nearest (leaf -1: none)."""
        top = self._nearest(x, probes)
        with np.errstate(over="ignore"):
            h = (ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(24)
        parts = self.parts[top]
        part = (h[:, None] % parts.astype(np.uint64)).astype(np.int64)
        block = self.block[top] + part
        more = (parts[:, 0] > 1) & ~self.spread[top[:, 0]]
        step = 1 + ((h >> np.uint64(20)) % np.maximum(parts[:, 0] - 1, 1).astype(np.uint64)).astype(np.int64)
        other = np.where(more, self.block[top[:, 0]] + (part[:, 0] + step) % parts[:, 0], block[:, 0])
        return np.column_stack([top, np.where(more, top[:, 0], -1)]), np.column_stack([block, other])

    def copies(self, leaf: np.ndarray, home: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, block): the other blocks in which members of spread leaves take part."""
        n = np.where(self.spread[leaf], self.parts[leaf], 1)
        rows = np.flatnonzero(n > 1)
        row = np.repeat(rows, n[rows])
        block = spread(self.block[leaf[rows]], n[rows])
        other = block != home[row]
        return row[other], block[other]


def sample_vectors(vectors: DataFrame, dim: int, rows: int) -> np.ndarray:
    """Unit vectors of at most ``rows`` ids, those of lowest hash."""
    got = vectors.orderBy(F.xxhash64("id"), "id").limit(rows).select("vec").toArrow().column("vec").combine_chunks()
    if not len(got):
        return np.zeros((1, dim), np.float32)
    x, ok = _unit(got, dim)
    return x[ok] if ok.any() else np.zeros((1, dim), np.float32)  # one leaf then


# -- the graph --------------------------------------------------------------------------------------------------------
def _router(layout: Layout, dim: int, probes: int):
    def run(batches):
        import pyarrow as pa

        for batch in batches:
            if not batch.num_rows:
                continue
            x, ok = _unit(batch.column(1), dim)
            ids = batch.column(0).to_numpy()[ok]
            x = x[ok]
            if not len(x):
                continue
            leaf, block = layout.places(ids, x, probes)
            order = np.argsort(block, axis=1, kind="stable")
            block, leaf = np.take_along_axis(block, order, 1), np.take_along_axis(leaf, order, 1)
            home = block[order == 0]
            own = leaf[order == 0]
            head = np.ones(block.shape, bool)
            head[:, 1:] = block[:, 1:] != block[:, :-1]
            row, col = np.nonzero(head)
            stop = np.append(np.flatnonzero(head.ravel())[1:], head.size)
            ends = np.concatenate([[0], np.cumsum(stop - np.flatnonzero(head.ravel()))])
            vec = _to_bytes(x).take(pa.array(row))
            b = block[row, col]
            own_leaf = np.where(b == home[row], own[row], -1)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(b.astype(np.int32)), pa.array(ids[row]), pa.array(home[row].astype(np.int32)), pa.array(own_leaf.astype(np.int32)),
                    pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(leaf.ravel().astype(np.int32))), vec,
                ],
                ["block", "id", "home", "leaf", "probe", "vec"],
            )
            row, b = layout.copies(own, home)
            if len(row):
                vec = _to_bytes(x).take(pa.array(row))
                none = pa.ListArray.from_arrays(pa.array(np.zeros(len(row) + 1, np.int32)), pa.array(np.zeros(0, np.int32)))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(b.astype(np.int32)), pa.array(ids[row]), pa.array(home[row].astype(np.int32)), pa.array(own[row].astype(np.int32)), none, vec],
                    ["block", "id", "home", "leaf", "probe", "vec"],
                )

    return run


def _to_bytes(x: np.ndarray):
    """Unit rows as 16-bit fixed point of their largest component (a cosine changes by about 1e-5), an Arrow column."""
    import pyarrow as pa

    q = np.rint(x * (32767.0 / np.abs(x).max(axis=1, keepdims=True, initial=1e-30))).astype(np.int16)
    return pa.FixedSizeBinaryArray.from_buffers(pa.binary(2 * x.shape[1]), len(x), [None, pa.py_buffer(np.ascontiguousarray(q).tobytes())]).cast(pa.binary())


def _from_bytes(column, dim: int) -> np.ndarray:
    """Unit rows of such a column without nulls."""
    import pyarrow as pa

    if not len(column):
        return np.zeros((0, dim), np.float32)
    x = np.frombuffer(column.combine_chunks().cast(pa.binary(2 * dim)).buffers()[1], np.int16).reshape(-1, dim).astype(np.float32)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _lists(ids, home, rows, cols, sims, col_ids, col_homes):
    """Arrow columns (id, home, nbrs, sims, homes) from triples ordered by row."""
    import pyarrow as pa

    count = np.bincount(rows, minlength=len(ids))
    ends = pa.array(np.concatenate([[0], np.cumsum(count)]).astype(np.int32))
    part = [
        pa.array(ids), pa.array(home.astype(np.int32)), pa.ListArray.from_arrays(ends, pa.array(col_ids)), pa.ListArray.from_arrays(ends, pa.array(sims.astype(np.float32))),
        pa.ListArray.from_arrays(ends, pa.array(col_homes.astype(np.int32))),
    ]
    return pa.Table.from_arrays(part, ["id", "home", "nbrs", "sims", "homes"])


def _first_graph(dim: int, k: int):
    def run(table):
        import pyarrow as pa

        ids = table.column("id").to_numpy()
        _, once = np.unique(ids, return_index=True)  # copies of a cell have one vector
        table = table.take(pa.array(once))
        ids, home, leaf = (table.column(c).to_numpy() for c in ("id", "home", "leaf"))
        x = _from_bytes(table.column("vec"), dim)
        lists = table.column("probe").combine_chunks()
        size = lists.value_lengths().to_numpy().astype(np.int64)
        probe = np.full((len(ids), int(size.max(initial=1))), -1, np.int64)
        probe[np.repeat(np.arange(len(ids)), size), spread(np.zeros(len(ids), np.int64), size)] = lists.flatten().to_numpy()
        rows, cols, sims = block_neighbours(x, leaf, probe, k)
        vec = table.column("vec").combine_chunks().take(pa.array(np.arange(len(ids)), mask=leaf < 0))
        return _lists(ids, home, rows, cols, sims, ids[cols], home[cols]).append_column("vec", vec)

    return run


def _merge_lists(k: int):
    """One partition of partial lists -> one list an id with its vector, which one of its rows has; the partition, whose size
    is bounded, is held as a whole."""

    def run(batches):
        import pyarrow as pa

        held = [b for b in batches if b.num_rows]
        if not held:
            return
        t = pa.Table.from_batches(held).combine_chunks()
        ids, place = np.unique(t.column("id").to_numpy(), return_inverse=True)
        size = t.column("nbrs").combine_chunks().value_lengths().to_numpy().astype(np.int64)
        row = np.repeat(place, size)
        col, sim, homes = (t.column(c).combine_chunks().flatten().to_numpy() for c in ("nbrs", "sims", "homes"))
        keep = best_of(row, col, sim, k)
        home = np.zeros(len(ids), np.int32)
        home[place] = t.column("home").to_numpy()
        has = np.flatnonzero(np.asarray(t.column("vec").combine_chunks().is_valid()))
        at = np.zeros(len(ids), np.int64)
        at[place[has]] = has
        yield from _lists(ids, home, row[keep], col[keep], sim[keep], col[keep], homes[keep]).append_column("vec", t.column("vec").combine_chunks().take(pa.array(at))).to_batches()

    return run


def _improve_lists(k: int):
    """Rows with a list and ``more`` entries, none of which it has -> the best of both; ``fresh``: how many of more."""

    def run(batches):
        import pyarrow as pa

        for b in batches:
            n = b.num_rows
            if not n:
                continue
            lens, m_lens = (b.column(i).value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64) for i in (2, 5))
            more = b.column(5).flatten()
            row = np.concatenate([np.repeat(np.arange(n), lens), np.repeat(np.arange(n), m_lens)])
            col, sim, homes = (np.concatenate([b.column(i).flatten().to_numpy(), more.field(j).to_numpy()]) for i, j in ((2, 0), (3, 1), (4, 2)))
            keep = best_of(row, col, sim, k)
            fresh = np.bincount(row[keep], keep >= lens.sum(), n).astype(np.int32)
            yield from _lists(b.column(0), b.column(1).to_numpy(), row[keep], col[keep], sim[keep], col[keep], homes[keep]).append_column("fresh", pa.array(fresh)).to_batches()

    return run


def first_graph(vectors: DataFrame, n: int, dim: int, k: int, leaf_rows: int, block_leaves: int | tuple[int, int], probes: int, sample_rows: int, parts: int) -> DataFrame:
    """Lists within leaves, with the vectors."""
    layout = Layout(sample_vectors(vectors, dim, min(sample_rows, 16 * (n // leaf_rows + 1))), n, leaf_rows, block_leaves, probes)
    routed = vectors.mapInArrow(_router(layout, dim, probes), "block int, id long, home int, leaf int, probe array<int>, vec binary")
    lists = routed.repartition(parts, "block").groupBy("block").applyInArrow(_first_graph(dim, k), LISTS + ", vec binary")
    return cut(lists.repartition(parts, "id").mapInArrow(_merge_lists(k), LISTS + ", vec binary"), "id", parts)


def descent_round(graph: DataFrame, vectors: DataFrame, dim: int, k: int, reverse: int, hub_links: int, parts: int, turn: int) -> DataFrame:
    """One round of NN-descent over the lists of ``graph`` and ``vectors`` (id, vec), both in buckets of id: the improved graph.

    A node's neighbours are those of its list and ``reverse`` of the nodes that list it; a node that very many list draws
    those from ``hub_links`` of them. Both choices are by hash and made anew every ``turn``. The neighbours of a node are
    neighbours of neighbours of one another: each goes to the node's home block, where all pairs are compared. Lists and
    vectors stay where they are; links, vectors for other blocks and what improves a list travel.
    """
    links = graph.select(F.col("id").alias("src"), F.col("home").alias("src_home"), F.explode("nbrs").alias("id"))
    some = Window.partitionBy("id").orderBy(F.pmod(F.hash("id", "src", F.lit(turn)), F.lit(4096)), "src")  # twelve bits, since they travel
    links = links.withColumn("_n", F.row_number().over(some)).where(F.col("_n") <= hub_links)
    back = links.groupBy("id").agg(F.collect_list("src").alias("b_src"), F.collect_list("src_home").alias("b_home"))
    kth = F.when(F.size("nbrs") >= k, F.array_min("sims")).otherwise(F.lit(-2.0)).cast("float").alias("kth")
    sent = graph.select("id", "home", "nbrs", kth, "homes").join(back, "id", "left").join(vectors, "id").select("id", "home", "nbrs", "kth", "homes", "vec", "b_src", "b_home")
    posted = sent.mapInArrow(_poster, "block int, id long, home int, kth float, nodes array<long>, known array<long>, vec binary")
    better = posted.repartition(parts, "block").groupBy("block").applyInArrow(_local_join(dim, k, reverse, turn), "id long, nbr long, sim float, home int").repartition(parts, "id")
    more = better.groupBy("id", "nbr").agg(F.max("sim").alias("sim"), F.min("home").alias("home")).groupBy("id").agg(F.collect_list(F.struct("nbr", "sim", "home")).alias("more"))
    both = graph.select("id", "home", "nbrs", "sims", "homes").join(more, "id", "left")
    return cut(both.mapInArrow(_improve_lists(k), GRAPH), "id", parts)


def _poster(batches):
    """Each vector to the home blocks of its adjacent nodes, with the nodes it is adjacent to there (-1 - node: it lists the node)."""
    import pyarrow as pa

    for batch in batches:
        if not batch.num_rows:
            continue
        ids, home, kth = (batch.column(i).to_numpy() for i in (0, 1, 3))
        lens, b_len = (batch.column(i).value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64) for i in (2, 6))
        f_node, f_home, b_node, b_home = (batch.column(i).flatten().to_numpy() for i in (2, 4, 6, 7))
        # as a reverse neighbour it goes to those it lists; as a listed one, to those that list it
        row, block = np.concatenate([np.repeat(np.arange(len(ids)), n) for n in (lens, b_len)]), np.concatenate([f_home, b_home]).astype(np.int64)
        node = np.concatenate([-f_node - 1, b_node])
        order = np.argsort((row << 32) + block, kind="stable")
        row, node, block = row[order], node[order], block[order]
        head = np.flatnonzero(np.concatenate([[True], (row[1:] != row[:-1]) | (block[1:] != block[:-1])])) if len(row) else np.zeros(0, np.int64)
        ends = pa.array(np.append(head, len(row)).astype(np.int32))
        r = row[head]
        at = pa.array(r)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(block[head].astype(np.int32)), pa.array(ids[r]), pa.array(home[r]), pa.array(kth[r]),
                pa.ListArray.from_arrays(ends, pa.array(node)), batch.column(2).take(at), batch.column(5).take(at),
            ],
            ["block", "id", "home", "kth", "nodes", "known", "vec"],
        )


def _local_join(dim: int, k: int, reverse: int, turn: int):
    def run(table):
        import pyarrow as pa

        ids, home, kth = (table.column(c).to_numpy() for c in ("id", "home", "kth"))
        x = _from_bytes(table.column("vec"), dim)
        nodes = table.column("nodes").combine_chunks()
        size = nodes.value_lengths().to_numpy().astype(np.int64)
        who, node = np.repeat(np.arange(len(ids)), size), nodes.flatten().to_numpy()
        back = node < 0
        node = np.unique(np.where(back, -node - 1, node), return_inverse=True)[1]
        # an adjacency of node and vector comes once; listed ones are all kept, reverse ones by hash
        key = np.sort(((node * len(ids) + who) << 1) + back)
        key = key[np.concatenate([[True], key[1:] >> 1 != key[:-1] >> 1])] if len(key) else key
        back, (node, who) = (key & 1).astype(bool), np.divmod(key >> 1, len(ids))
        with np.errstate(over="ignore"):
            h = ((ids[who].astype(np.uint64) ^ (node.astype(np.uint64) + np.uint64(turn) * _ODD)) * _ODD) >> np.uint64(34)
        order = np.argsort(((node * 2 + back) << 30) + h.astype(np.int64))
        node, who, back = node[order], who[order], back[order]
        head = np.flatnonzero(np.concatenate([[True], (node[1:] != node[:-1]) | (back[1:] != back[:-1])])) if len(node) else np.zeros(0, np.int64)
        rank = np.arange(len(node)) - np.repeat(head, np.diff(np.append(head, len(node))))
        keep = ~back | (rank < reverse)
        who, node = who[keep], node[keep]
        head = np.flatnonzero(np.concatenate([[True], node[1:] != node[:-1]])) if len(node) else np.zeros(0, np.int64)
        count = np.diff(np.append(head, len(node)))
        out: list[tuple] = []
        for c in np.unique(count[count > 1]):
            rows = np.flatnonzero(count == c)
            i, j = np.triu_indices(int(c), 1)
            for b in range(0, len(rows), max(1, 400_000 // (c * c))):
                m = who[head[rows[b : b + max(1, 400_000 // (c * c))], None] + np.arange(c)]
                v = x[m]
                s = np.matmul(v, v.transpose(0, 2, 1))[:, i, j]
                p, q = m[:, i], m[:, j]
                for one, two in ((p, q), (q, p)):
                    g = s > kth[one] + 1e-6
                    out.append((one[g], two[g], s[g]))
        r, c, s = (np.concatenate(z) for z in zip(*out)) if out else (np.zeros(0, np.int64),) * 3
        _, first = np.unique(r * len(ids) + c, return_index=True)
        r, c, s = r[first], c[first], s[first]
        # those that the list has already
        known = table.column("known").combine_chunks()
        listed = np.flatnonzero(np.bincount(r, minlength=len(ids)))  # rows that got anything
        k_len = known.value_lengths().to_numpy().astype(np.int64)
        k_at = np.cumsum(k_len) - k_len
        k_id = known.flatten().to_numpy()[spread(k_at[listed], k_len[listed])]
        sorted_ids = np.argsort(ids)
        at = np.minimum(np.searchsorted(ids[sorted_ids], k_id), len(ids) - 1)
        here = sorted_ids[at] if len(ids) else at
        code = np.repeat(listed, k_len[listed]) * len(ids) + here
        new = ~np.isin(r * len(ids) + c, code[ids[here] == k_id])
        r, c, s = r[new], c[new], s[new]
        keep = best_of(r, c, s, k)
        r, c, s = r[keep], c[keep], s[keep]
        return pa.table([ids[r], ids[c], s.astype(np.float32), home[c]], names=["id", "nbr", "sim", "home"])

    return run


def neighbour_graph(
    rows: DataFrame, id_col: str, vec_col: str, dim: int = 64, k: int = 10, rounds: tuple[int, int] = (2, 30), probes: int = 8, leaf_rows: int = 1000, block_leaves: int | tuple[int, int] = (16, 64), reverse: int = 10,
    hub_links: int = 64, sample_rows: int = 131_072, settled: float = 0.005, history: list | None = None,
) -> DataFrame:
    """(id, nbrs, sims): the k most similar other ids of every valid vector, most similar first, ties by id.

    Rows with null or negative id, or whose vector is null, not of ``dim`` numbers, not finite throughout or all zero,
    take no part; rows of one id count as one. Rounds go on until less than the share ``settled`` of the entries changes
    (at least and at most ``rounds``; the most is far more than that takes); ``history`` receives that share of every round.
    Blocks hold ``block_leaves`` leaves of about ``leaf_rows`` vectors, the more the more leaves there are.
    Centroids are fitted on ``sample_rows`` vectors at most, 16 a leaf; every vector is indexed. Fewer than k others: a
    shorter list. Of more equally similar vectors than fit a list, those of lowest id among the ones met come.
    """
    vectors = rows.select(rows[id_col].cast("long").alias("id"), rows[vec_col].cast("array<float>").alias("vec"))
    vectors = vectors.where(valid(F.col("vec"), F.col("id"), dim) & ~F.exists("vec", lambda v: v.isNull()))
    n = vectors.count()
    parts = shuffle_parts(rows.sparkSession, 2 * n)
    first = first_graph(vectors, n, dim, k, leaf_rows, block_leaves, probes, sample_rows, parts)
    graph, packed = first.drop("vec"), first.select("id", "vec")
    for turn in range(rounds[1]):
        better = descent_round(graph, packed, dim, k, reverse, hub_links, parts, turn)
        if turn:
            drop(graph)
        graph = better
        fresh, entries = graph.agg(F.sum("fresh"), F.sum(F.size("nbrs"))).first()
        if history is not None:
            history.append((fresh or 0) / max(1, entries or 0))
        if turn + 1 >= rounds[0] and (fresh or 0) < settled * max(1, entries or 0):
            break
    if rounds[1]:
        drop(first)
    return graph.select("id", "nbrs", "sims")


def similar_pairs(graph: DataFrame, rows: DataFrame, id_col: str, vec_col: str, least: float, dim: int = 64) -> DataFrame:
    """(a, b), a < b, of the graph's entries with a similarity of at least ``least``, each pair once.

    The graph compares vectors in 16-bit fixed point, which moves a cosine by about 1e-5. Pairs within BORDER of the bound are
    few; they are decided on the stored numbers, in double precision. They are written first, so that their size decides the joins.
    """
    e = graph.select("id", F.explode(F.arrays_zip("nbrs", "sims")).alias("e")).where(F.col("e.sims") >= least - BORDER)
    e = cut(e.groupBy(F.least("id", "e.nbrs").alias("a"), F.greatest("id", "e.nbrs").alias("b")).agg(F.max("e.sims").alias("s")))
    sure, near = e.where(F.col("s") >= least + BORDER).select("a", "b"), cut(e.where(F.col("s") < least + BORDER).select("a", "b"))
    good = rows.where(valid(F.col(vec_col), F.col(id_col), dim)).select(F.col(id_col).cast("long").alias("i"), F.col(vec_col).cast("array<double>").alias("v"))
    good = good.where(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0))
    total = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, p: s + p)
    met = cut(near.join(good.withColumnsRenamed({"i": "a", "v": "x"}), "a")).join(good.withColumnsRenamed({"i": "b", "v": "y"}), "b")
    met = met.where(total("x", "y") / (F.sqrt(total("x", "x")) * F.sqrt(total("y", "y"))) >= least)
    return sure.unionAll(met.select("a", "b").distinct())


# -- queries ----------------------------------------------------------------------------------------------------------
def greedy_search(
    graph: DataFrame, rows: DataFrame, queries: DataFrame, id_col: str, vec_col: str, dim: int = 64, k: int = 10, beam: int = 48, expand: int = 16, entries: int = 8, probes: int = 4,
    leaf_rows: int = 1000, sample_rows: int = 131_072,
) -> DataFrame:
    """(id, nbrs, sims): for every valid query vector the k most similar ids of the graph, itself left out.

    Greedy search: a query holds the ``beam`` best nodes it has seen; in each step the ``expand`` best that were not yet
    followed are, by joins with the graph's links (k nodes that list a node at most, by hash, besides those it lists) and with the
    vectors, until none of them is left. It begins at ``entries`` nodes, those of lowest hash, of each of the ``probes``
    leaves nearest to it, so a crowd that few links lead to is reached as well. Centroids are fitted on ``sample_rows`` vectors at
    most; a leaf's entries come from all rows.
    """
    pick = lambda df: df.select(df[id_col].cast("long").alias("id"), df[vec_col].cast("array<float>").alias("vec")).where(
        valid(F.col("vec"), F.col("id"), dim) & ~F.exists("vec", lambda v: v.isNull())
    )
    unit = lambda df: df.mapInArrow(_packer(dim), "id long, vec binary").dropDuplicates(["id"])
    vectors, asked = cut(unit(pick(rows))), cut(unit(pick(queries)))
    n = vectors.count()
    leaves = fit_leaves(sample_vectors(pick(rows), dim, min(sample_rows, 16 * (n // leaf_rows + 1))), max(1, round(n / leaf_rows)))
    listed = graph.select("id", F.explode("nbrs").alias("to"))
    some = Window.partitionBy("id").orderBy(F.pmod(F.hash("id", "to"), F.lit(4096)), "to")
    listing = listed.select(F.col("to").alias("id"), F.col("id").alias("to")).withColumn("_n", F.row_number().over(some)).where(F.col("_n") <= k).drop("_n")
    links = cut(listed.unionAll(listing).distinct())
    near = lambda df, p: df.mapInArrow(_nearest_leaves(leaves, p, dim), "id long, leaf int")
    first = near(vectors, 1).withColumn("_n", F.row_number().over(Window.partitionBy("leaf").orderBy(F.xxhash64("id"), "id"))).where(F.col("_n") <= entries)
    start = near(asked, probes).withColumnRenamed("id", "q").join(first.select("leaf", "id"), "leaf").select("q", "id").distinct()
    asked = asked.withColumnsRenamed({"id": "q", "vec": "q_vec"})
    meet = lambda pairs: pairs.join(vectors, "id").groupBy("q").agg(F.collect_list(F.struct("id", "vec")).alias("new"))  # noqa: E731 - bounded by the parameters
    state = cut(asked.join(meet(start), "q").select("q", "q_vec", "new").mapInArrow(_beam(dim, beam), BEAM))
    open_nodes = F.slice(F.filter("beam", lambda b: ~b["done"]), 1, expand)
    while True:
        todo = cut(state.select("q", F.explode(F.transform(open_nodes, lambda b: b["id"])).alias("id")))
        if todo.isEmpty():
            break
        reached = meet(todo.join(links, "id").select("q", F.col("to").alias("id")).distinct())
        followed = state.withColumn("_f", F.transform(open_nodes, lambda b: b["id"]))
        marked = F.transform("beam", lambda b: F.struct(b["id"].alias("id"), b["sim"].alias("sim"), (b["done"] | F.array_contains("_f", b["id"])).alias("done")))
        after = cut(followed.withColumn("beam", marked).join(reached, "q", "left").select("q", "q_vec", "new", "beam").mapInArrow(_beam(dim, beam), BEAM))
        drop(state)
        drop(todo)
        state = after
    best = F.slice(F.filter("beam", lambda b: b["id"] != F.col("q")), 1, k)
    return state.select(F.col("q").alias("id"), F.transform(best, lambda b: b["id"]).alias("nbrs"), F.transform(best, lambda b: b["sim"]).alias("sims"))


def _nearest_leaves(leaves: np.ndarray, probes: int, dim: int):
    def run(batches):
        import pyarrow as pa

        p = min(probes, len(leaves))
        for batch in batches:
            if batch.num_rows:
                s = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.float32).reshape(-1, dim) @ leaves.T
                top = np.argpartition(-s, p - 1, axis=1)[:, :p]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(np.repeat(np.arange(len(top)), p))), pa.array(top.ravel().astype(np.int32))], ["id", "leaf"])

    return run


BEAM = "q long, q_vec binary, beam array<struct<id: long, sim: float, done: boolean>>"


def _packer(dim: int):
    def run(batches):
        import pyarrow as pa

        for batch in batches:
            if batch.num_rows:
                x, ok = _unit(batch.column(1), dim)
                yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(ok)), pa.array([v.tobytes() for v in x[ok]], pa.binary())], ["id", "vec"])

    return run


def _beam(dim: int, beam: int):
    """Rows (q, q_vec, new[, beam]) -> the best of the beam and the new nodes, most similar first."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            qv = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.float32).reshape(n, dim)
            new = batch.column(2)
            size = new.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            flat = new.flatten()
            ids, v = flat.field(0).to_numpy(), np.frombuffer(b"".join(flat.field(1).to_pylist()), np.float32).reshape(-1, dim)
            row = np.repeat(np.arange(n), size)
            sim = np.einsum("ij,ij->i", qv[row], v)
            done = np.zeros(len(ids), bool)
            if batch.num_columns > 3:
                old = batch.column(3)
                o_size, o = old.value_lengths().to_numpy().astype(np.int64), old.flatten()
                # old entries first: a node seen again keeps its mark
                row, ids = np.concatenate([np.repeat(np.arange(n), o_size), row]), np.concatenate([o.field(0).to_numpy(), ids])
                sim, done = np.concatenate([o.field(1).to_numpy(), sim]), np.concatenate([o.field(2).to_numpy(zero_copy_only=False), done])
            order = np.lexsort((~done, ids, row))
            head = np.ones(len(order), bool)
            head[1:] = (row[order][1:] != row[order][:-1]) | (ids[order][1:] != ids[order][:-1])
            order = order[head]
            keep = order[best_of(row[order], ids[order], sim[order], beam)]
            ends = np.concatenate([[0], np.cumsum(np.bincount(row[keep], minlength=n))]).astype(np.int32)
            kept = pa.StructArray.from_arrays([pa.array(ids[keep]), pa.array(sim[keep].astype(np.float32)), pa.array(done[keep])], ["id", "sim", "done"])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.ListArray.from_arrays(pa.array(ends), kept)], ["q", "q_vec", "beam"])

    return run
