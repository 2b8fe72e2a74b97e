"""The training-data operators against brute force, exact round trips and their stated edge cases."""

import collections
import itertools
import math
import os
import random
import unicodedata

import numpy as np
import pyarrow as pa
import pytest
import regex
import tiktoken
from pyspark.sql import functions as F

from sparsemill.llm import ORACLES, QUERIES, bpe, cooccur, knn_graph, leakage, quota_sample, set_pairs, split, stable_sample, terms

SF = "/root/testdata/sf0.001"
needs_tables = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@needs_tables
@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    from compare import assert_same, connect

    if name in ORACLES:
        assert_same(spark, connect(SF), SF, QUERIES[name], ORACLES[name])
    else:
        df = QUERIES[name](spark, SF)
        assert df.count() > 0 or name.endswith("_found")


# -- 1 ------------------------------------------------------------------------------------------------------------------
EXPR = "cell_id long, gene_id long, lane int, expr_value double, n string, part string"


def expr(spark, data):
    return spark.createDataFrame([(*r, "x", "y") for r in data], EXPR)


def brute_terms(data):
    seen = {(c, g, lane): v for c, g, lane, v in data if g is not None and c is not None and c >= 0 and v is not None and math.isfinite(v)}
    counts = collections.Counter()
    for (c, g, _), v in seen.items():
        counts[g, c] += v
    freq = {g: [0.0, 0] for _, g, _, _ in data if g is not None}
    for (g, c), v in counts.items():
        freq[g][0] += v
        freq[g][1] += v > 0
    return {g: tuple(x) for g, x in freq.items()}, len({c for (g, c), v in counts.items() if v > 0})


@pytest.mark.parametrize("limit", [2_000_000, 50])
def test_terms_equal_brute_force_at_every_depth(spark, limit):
    rng = random.Random(4)
    data = [(rng.choice([None, -1, *range(60)]), rng.choice([None, 7, 7, 7, *range(30)]), rng.randint(1, 4), 0.0) for _ in range(3000)]
    data = [(c, g, lane, random.Random(f"{c}{g}{lane}").choice([None, float("nan"), 0.0, 1.0, 2.0, 5.0, -3.0])) for c, g, lane, _ in data]
    freq, n = terms.term_frequencies(expr(spark, data).repartition(5), limit_rows=limit)
    want, want_n = brute_terms(data)
    assert {r.gene_id: (r.sum, r.detected) for r in freq.collect()} == want and n.first().n == want_n


def test_terms_of_nothing_and_marks(spark):
    freq, n = terms.term_frequencies(expr(spark, []))
    assert freq.count() == 0 and n.first().n == 0
    opt = spark.createDataFrame([(2.0, 3.0, 0.5)], "min_detected_cells double, min_gene_sum double, max_detected_share double")
    freq, n = terms.term_frequencies(expr(spark, [(1, 5, 1, 9.0), (2, 5, 1, 1.0), (3, 6, 1, 1.0), (None, 8, 1, 1.0)]))
    assert rows(terms.mark_terms(freq, n, opt).select("gene_id", "marks")) == [(5, ["common"]), (6, ["rare"]), (8, ["rare"])]
    with pytest.raises(ValueError):
        terms.mark_terms(freq, n, opt.unionAll(opt))


def test_repeats_are_dropped_while_spilling(spark):
    data = [(1, 5, 1, 2.0)] * 5000 + [(1, 5, 1, 3.0), (1, 5, None, 4.0), (2, 5, 1, 1.0)]
    freq, n = terms.term_frequencies(expr(spark, data).coalesce(2), limit_rows=3)
    assert rows(freq) == [(5, 8.0, 2)] and n.first().n == 2


# -- 2 ------------------------------------------------------------------------------------------------------------------
def test_stable_sample_only_grows(spark):
    rng = random.Random(1)
    data = [(f"id{rng.randint(0, 900)}", rng.choice([None, float("nan"), 0.2, 0.7, 1.0, 5.0]), d) for d in range(1, 5) for _ in range(600)] + [(None, 1.0, 1), ("", 1.0, 1)]
    df = spark.createDataFrame(data, "id string, w double, delivery int")
    last, state = set(), None
    for d in range(1, 5):
        whole = stable_sample.running_weights(df.where(F.col("delivery") <= d), "id", F.col("w"))
        state = stable_sample.running_weights(df.where(F.col("delivery") == d), "id", F.col("w"), state)
        assert rows(whole) == rows(state)  # step by step or at once
        got = {r.id for r in stable_sample.poisson_sample(whole.repartition(7), "id", 0.4).collect()}
        assert last <= got and None not in got and "" not in got
        last = got
    again = {r.id for r in stable_sample.poisson_sample(stable_sample.running_weights(df.unionAll(df).orderBy(F.rand(3)), "id", F.col("w")), "id", 0.4).collect()}
    assert again == last
    w = {r.id: r.weight for r in state.collect()}
    expected = sum(min(1, 0.4 * x) for x in w.values())
    assert abs(len(last) - expected) < 5 * math.sqrt(expected)
    assert stable_sample.running_weights(df.limit(0), "id", F.col("w")).count() == 0
    two = stable_sample.running_weights(spark.createDataFrame([("a", 1.0), ("b", 50.0)], "id string, w double"), "id", F.col("w"))
    assert rows(two) == [("a", 1.0), ("b", 50.0)]  # inclusion tells them apart as long as the rate allows


# -- 3 ------------------------------------------------------------------------------------------------------------------
def vectors(spark, x, extra=()):
    data = [(i, [float(v) for v in r], "e") for i, r in enumerate(x)] + list(extra)
    return spark.createDataFrame(data, "id long, vec array<float>, nbrs string")


def brute_neighbours(x, k):
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = u @ u.T
    np.fill_diagonal(s, -2)
    return np.argsort(-s, axis=1, kind="stable")[:, :k], s


@pytest.mark.parametrize("rounds", [(1, 1), (3, 30)])
def test_graph_recall_against_brute_force(spark, rounds):
    rng = np.random.default_rng(0)
    x = (rng.normal(size=(12, 16))[rng.integers(0, 12, 2000)] + 0.4 * rng.normal(size=(2000, 16))).astype(np.float32)
    g = knn_graph.neighbour_graph(vectors(spark, x), "id", "vec", dim=16, k=10, rounds=rounds, probes=3, leaf_rows=100, block_leaves=4).collect()
    want, s = brute_neighbours(x, 10)
    assert len(g) == 2000
    assert np.mean([len(set(r.nbrs) & set(want[r.id].tolist())) / 10 for r in g]) > 0.95
    assert all(r.id not in r.nbrs and len(set(r.nbrs)) == 10 for r in g)
    assert max(abs(v - s[r.id, n]) for r in g for n, v in zip(r.nbrs, r.sims)) < 1e-3


def test_a_round_improves_a_poor_graph(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(1500, 8)).astype(np.float32)
    want, _ = brute_neighbours(x, 10)
    found = []
    for rounds in ((0, 0), (1, 1), (2, 2)):
        g = knn_graph.neighbour_graph(vectors(spark, x), "id", "vec", dim=8, k=10, rounds=rounds, probes=2, leaf_rows=40, block_leaves=1, settled=-1.0).collect()
        found.append(np.mean([len(set(r.nbrs) & set(want[r.id].tolist())) / 10 for r in g]))
    assert found[0] < found[1] < found[2]


def test_rounds_join_what_a_hash_split_parted(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(6000, 8)).astype(np.float32)
    want, _ = brute_neighbours(x, 10)
    found = []
    for rounds in ((0, 0), (1, 30)):  # few sampled vectors: the leaves are far too large and are split
        history = []
        g = knn_graph.neighbour_graph(vectors(spark, x), "id", "vec", dim=8, k=10, rounds=rounds, probes=2, leaf_rows=60, block_leaves=4, sample_rows=16, history=history).collect()
        found.append(np.mean([len(set(r.nbrs) & set(want[r.id].tolist())) / 10 for r in g]))
    assert found[0] < 0.8 and found[1] > 0.95
    assert len(history) > 2 and history[0] > history[1] > history[-1] < 0.005  # it ends by itself


def test_pairs_at_the_border_are_decided_on_the_stored_numbers(spark):
    c = 0.9
    x = [[1.0, 0.0, 0.0], [c + 2e-6, float(np.sqrt(1 - (c + 2e-6) ** 2)), 0.0], [c - 2e-6, 0.0, float(np.sqrt(1 - (c - 2e-6) ** 2))]]
    df = vectors(spark, np.array(x) * [[1], [3], [5]], [(7, [float("nan")] * 3, "e")])
    g = knn_graph.neighbour_graph(df, "id", "vec", dim=3, k=2)
    assert rows(knn_graph.similar_pairs(g, df, "id", "vec", 0.9, dim=3)) == [(0, 1)]


def test_graph_of_one_hot_vector_and_dirt(spark):
    x = np.ones((3000, 4), np.float32)
    extra = [(5, [1.0, 1.0, 1.0, 1.0], "e"), (None, [1.0] * 4, "e"), (-1, [1.0] * 4, "e"), (9001, None, "e"), (9002, [1.0], "e"), (9003, [0.0] * 4, "e"), (9004, [float("nan"), 1.0, 1.0, 1.0], "e"), (9005, [float("inf"), 1.0, 1.0, 1.0], "e"), (9006, [None, 1.0, 1.0, 1.0], "e")]
    g = knn_graph.neighbour_graph(vectors(spark, x, extra), "id", "vec", dim=4, k=5, leaf_rows=50).collect()
    assert sorted(r.id for r in g) == list(range(3000)) and all(len(r.nbrs) == 5 and min(r.sims) > 0.999 for r in g)


def test_graph_of_few_vectors(spark):
    g = {r.id: r.nbrs for r in knn_graph.neighbour_graph(vectors(spark, np.eye(3, dtype=np.float32) + 0.1), "id", "vec", dim=3, k=10).collect()}
    assert sorted(map(len, g.values())) == [2, 2, 2]
    assert knn_graph.neighbour_graph(vectors(spark, []), "id", "vec", dim=3, k=10).count() == 0


def test_greedy_search_recall(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(1500, 8)).astype(np.float32)
    df = vectors(spark, x)
    graph = knn_graph.neighbour_graph(df, "id", "vec", dim=8, k=10, leaf_rows=200)
    got = knn_graph.greedy_search(graph, df, df.where("id % 50 = 0"), "id", "vec", dim=8).collect()
    want, _ = brute_neighbours(x, 10)
    assert len(got) == 30 and np.mean([len(set(r.nbrs) & set(want[r.id].tolist())) / 10 for r in got]) >= 0.9


# -- 4 ------------------------------------------------------------------------------------------------------------------
def brute_pairs(sets, num, den):
    out = set()
    for a, b in itertools.combinations(sorted(sets), 2):
        i = len(sets[a] & sets[b])
        if i * den >= num * len(sets[a] | sets[b]) and i:
            out.add((a, b, i, len(sets[a] | sets[b])))
    return out


def test_similar_sets_equal_brute_force(spark):
    rng = random.Random(2)
    sets = {}
    for base in range(60):
        s = set(rng.sample(range(5000), rng.randint(1, 60)))
        for copy in range(3):
            sets[base * 3 + copy] = (s - set(rng.sample(sorted(s), len(s) // rng.choice([3, 4, 8, 100])))) or s
    data = [(g, c, "z") for g, s in sets.items() for c in s] * 2 + [(None, 1, "z"), (500, None, "z"), (501, -1, "z"), (0, -1, "z")]
    df = spark.createDataFrame(data, "gene_id long, cell_id long, s string")
    got = {tuple(r) for r in set_pairs.similar_records(df, "gene_id", "cell_id").collect()}
    want = brute_pairs(sets, 3, 5)
    assert not got - want and len(want - got) <= 0.01 * len(want)
    assert set_pairs.similar_records(df.limit(0), "gene_id", "cell_id").count() == 0


def test_large_classes_are_expanded_whole(spark, monkeypatch):
    monkeypatch.setattr(set_pairs, "CLASS_CHUNK", 4)
    sets = {g: set(range(10)) for g in range(30)} | {g: set(range(8)) for g in range(30, 35)} | {90: {77}}
    df = spark.createDataFrame([(g, c, "z") for g, s in sets.items() for c in s], "gene_id long, cell_id long, s string")
    assert {tuple(r) for r in set_pairs.similar_records(df, "gene_id", "cell_id").collect()} == brute_pairs(sets, 3, 5)
    links = {r.k: (r.s, r.members, r.links) for r in set_pairs.record_links(df, "gene_id", "cell_id").collect()}
    assert links[3] == (0, 30, 34) and links[31] == (30, 5, 34) and links[90] == (90, 1, 0) and len(links) == 36


def test_similar_sets_across_tables(spark):
    one = spark.createDataFrame([(1, v) for v in range(10)] + [(2, v) for v in range(50, 60)], "k long, v long")
    two = spark.createDataFrame([(1, v) for v in range(1, 10)] + [(7, 99)], "k long, v long")
    assert rows(set_pairs.similar_across(one, two, "k", "v")) == [(1, 1, 9, 10)]


def test_calibration_holds():
    width, segments, radius = set_pairs.calibrate(60_000, 0.6, 0.999)
    assert 1 - (1 - 0.8**width) ** segments >= 0.999 and 38 < radius < 96
    a, b = np.arange(400), np.arange(100, 500)  # similarity 0.6
    code = set_pairs.one_bit_minhashes(np.concatenate([a, b]), np.array([0, 400, 800]), 4000)
    assert abs((code[0] == code[1]).mean() - 0.8) < 0.03


# -- 5 ------------------------------------------------------------------------------------------------------------------
def test_pair_counts_equal_brute_force(spark):
    rng = random.Random(3)
    recs = {p: {rng.randint(0, 60) for _ in range(rng.randint(0, 12))} for p in range(1500)}
    for p in range(0, 1500, 5):
        recs[p] |= {70, 71}
    recs[3] = set(range(100, 1800))  # larger than one basket
    data = [(p, [*s, *list(s)[:2], None, -1], "n") for p, s in recs.items()] + [(1, None, "n"), (None, [1, 2], "n"), (2, [], "n")]
    df = spark.createDataFrame(data, "r long, i array<long>, n string")
    got = {(x.a, x.b): (x.n_ab, x.n_a, x.n_b, x.n) for x in cooccur.pair_counts(df, "r", "i", 1, 0.0)[0].collect()}
    live = [s for s in recs.values() if s]
    one = collections.Counter(i for s in live for i in s)
    two = collections.Counter(p for s in live for p in itertools.combinations(sorted(s), 2))
    assert got == {p: (c, one[p[0]], one[p[1]], len(live)) for p, c in two.items()}
    pairs, freq, sizes = cooccur.pair_counts(df, "r", "i", 8, 3.0)
    assert {(x.a, x.b) for x in pairs.collect()} == {p for p, c in two.items() if c >= 8 and c * len(live) >= 3 * one[p[0]] * one[p[1]]}
    s = {(x.a, x.b): x for x in cooccur.surprise(pairs, freq, sizes).collect()}
    assert s[70, 71].surprising and s[70, 71].log10_p < -50
    empty = cooccur.pair_counts(df.limit(0), "r", "i")
    assert empty[0].count() == 0 and cooccur.surprise(*empty).count() == 0


@needs_tables
def test_surprise_ranks_every_pair_that_occurs(spark):
    flat = spark.read.parquet(f"{SF}/sampled_csr.parquet").select("sampled_position", F.explode("column_indices").alias("g")).where("g >= 0").distinct().collect()
    sets = collections.defaultdict(set)
    for p, g in flat:
        sets[p].add(g)
    one = collections.Counter(g for s in sets.values() for g in s)
    two = collections.Counter(p for s in sets.values() for p in itertools.combinations(sorted(s), 2))
    got = {(r.gene_a, r.gene_b): r for r in QUERIES["p5_surprise"](spark, SF).collect()}
    assert {p: (r.n_ab, r.n_a, r.n_b, r.n) for p, r in got.items()} == {p: (c, one[p[0]], one[p[1]], len(sets)) for p, c in two.items()}
    assert all(r.log10_p <= 0 and 0 <= r.q_value <= 1 for r in got.values())
    ranked, least, tests = sorted(got.values(), key=lambda r: r.log10_p), 1.0, len(one) * (len(one) - 1) / 2
    for i in range(len(ranked), 0, -1):
        least = min(least, 10 ** ranked[i - 1].log10_p * tests / i)
        assert least * (1 - 1e-9) <= ranked[i - 1].q_value <= least * 1.03


def test_null_model_meets_its_margins():
    item, items, size, records = np.array([2.0, 50, 400]), np.array([300.0, 40, 3]), np.array([1.0, 5, 20]), np.array([200.0, 300, 120])
    total = (size * records).sum()
    item = item * total / (item * items).sum()
    x, y = cooccur.fit_null(item, items, size, records)
    p = x[:, None] * y / (1 + x[:, None] * y)
    assert np.allclose((p * records).sum(1), item, rtol=1e-5) and np.allclose((items[:, None] * p).sum(0), size, rtol=1e-5)


@pytest.mark.parametrize("k", [1, 3, 8, 20, 60, 150])
def test_upper_tail_against_convolution(k):
    q, m = np.array([0.001, 0.02, 0.3]), np.array([400, 200, 100])
    exact = np.ones(1)
    for p, n in zip(q, m):
        for _ in range(n):
            exact = np.convolve(exact, [1 - p, p])
    want = math.log10(exact[k:].sum())
    got = cooccur.upper_tail(np.array([k]), q[None, :], m.astype(float))[0]
    assert abs(got - want) < 0.02 + 0.01 * abs(want)


# -- 6 ------------------------------------------------------------------------------------------------------------------
def test_quota_sample_meets_targets(spark):
    names = {"Heart Tube": 200, "lung_tip": 30, "tail": 3, "other": 50}
    cells = [(1, s, i + 1000 * j, "x") for j, (s, n) in enumerate(names.items()) for i in range(n)] * 2 + [(1, None, 5, "x"), (None, "tail", 6, "x"), (1, "tail", None, "x"), (1, " ", 7, "x")]
    df = spark.createDataFrame(cells, "dataset_id long, stratum string, cell_id long, quota string")
    t = spark.createDataFrame([(1, "heart tube", 0.5, 2, 60), (1, "lung tip", 0.35, 2, 60), (1, "tail", 0.1, 5, 60), (1, "ghost", 0.05, 1, 60), (2, "tail", 1.0, 1, 5)], "dataset_id long, stratum string, target_share double, min_rows long, requested_rows long")
    r = {(x.dataset_id, x.stratum): x for x in quota_sample.target_report(df, t).collect()}
    assert r[1, "heart tube"].available == 200 and r[1, "heart tube"].quota == 30 and r[1, "lung tip"].quota == 21
    assert not r[1, "tail"].met and r[1, "tail"].quota == 3 and r[1, "ghost"].available == 0 and r[2, "tail"].short == 5
    got = collections.Counter((x.stratum) for x in quota_sample.quota_sample(df, t).collect())
    assert got == {"heart tube": 30, "lung tip": 21, "tail": 3}
    assert rows(quota_sample.quota_sample(df.repartition(9), t)) == rows(quota_sample.quota_sample(df.unionAll(df), t))
    assert quota_sample.quota_sample(df.limit(0), t).count() == 0 and quota_sample.target_report(df, t.limit(0)).count() == 0


def test_quotas_that_fill_the_request(spark):
    names = ["a", "b", "c", "d", "e"]
    df = spark.createDataFrame([(1, n, i + 100 * j) for j, n in enumerate(names) for i in range(60)], "dataset_id long, stratum string, cell_id long")
    t = spark.createDataFrame([(1, n, 0.22, 1, 50) for n in names], "dataset_id long, stratum string, target_share double, min_rows long, requested_rows long")
    quotas = lambda fill: [r.quota for r in quota_sample.target_report(df, t, fill=fill).orderBy("stratum").collect()]
    assert sum(quotas(True)) == 50 and min(quotas(True)) >= 9 and sum(quotas(False)) <= 50
    assert quota_sample.quota_sample(df, t, fill=True).count() == 50


def test_reservoirs_of_any_size_and_their_union(spark, monkeypatch):
    monkeypatch.setattr(quota_sample, "BUFFERED", 700)
    df = spark.createDataFrame([(1, "x", i) for i in range(5000)] + [(1, "y", i) for i in range(40)], "dataset_id long, stratum string, cell_id long")
    t = spark.createDataFrame([(1, "x", 0.9, 0, 3000), (1, "y", 0.1, 0, 3000)], "dataset_id long, stratum string, target_share double, min_rows long, requested_rows long")
    got = quota_sample.quota_sample(df, t)
    u = {r.cell_id: r.u for r in df.where("stratum = 'x'").select("cell_id", stable_sample.unit_hash(F.col("cell_id")).alias("u")).collect()}
    assert {r.cell_id for r in got.where("stratum = 'x'").collect()} == set(sorted(u, key=lambda i: (u[i], i))[:2700]) and got.where("stratum = 'y'").count() == 40
    args = (t, "dataset_id", "stratum", "cell_id")
    parts = [quota_sample.reservoirs(df.where(F.col("cell_id") % 2 == i), *args) for i in (0, 1)]
    assert rows(quota_sample.target_report(df, t, state=parts[0].unionAll(parts[1]))) == rows(quota_sample.target_report(df, t))


def test_minimum_above_the_request_is_drawn_whole(spark):
    df = spark.createDataFrame([(1, "tail", i) for i in range(30)], "dataset_id long, stratum string, cell_id long")
    t = spark.createDataFrame([(1, "tail", 1.0, 20, 10)], "dataset_id long, stratum string, target_share double, min_rows long, requested_rows long")
    assert quota_sample.target_report(df, t).first().quota == quota_sample.quota_sample(df, t).count() == 20


# -- 7 ------------------------------------------------------------------------------------------------------------------
@pytest.fixture(scope="module")
def reference():
    import base64

    import public_tokenizers as p

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(bpe.default_vocabulary(), "rb"))}
    return tiktoken.Encoding("own", pat_str=p.PATTERN, mergeable_ranks=ranks, special_tokens={})


def texts():
    rng = random.Random(7)
    bits = ["'", "s", "t", "re", "ll", "'ve", "'S", "ſ", " ", "  ", "\n", "\r\n", "\t", "\x85", "\x1c", " ", "​", "　", "a", "B", "1", "٣", "²", "é", "é", "字", "😀", "!", "<|endoftext|>", "\x00"]
    return [None, "", " ", "\n\n\n", "a" * 3000, "ab" * 4000 + " x", "字" * 900, "0123456789" * 300, *("".join(rng.choices(bits, k=rng.randint(1, 40))) for _ in range(3000))]


def test_ids_equal_the_reference_encoder(spark, reference):
    data = list(enumerate(texts()))
    df = spark.createDataFrame(data, "doc_id long, text string").withColumn("ids", F.lit("clash"))
    got = {r.doc_id: list(r.ids) for r in bpe.encode_corpus(df).collect()}
    assert got == {i: reference.encode_ordinary(t or "") for i, t in data}
    assert bpe.encode_corpus(df.limit(0)).count() == 0 and bpe.encode_corpus(df.unionAll(df)).count() == 2 * len(data)


def test_cache_may_be_reset(reference, monkeypatch):
    monkeypatch.setattr(bpe, "CACHE_WORDS", 50)
    enc = bpe.Encoder(bpe.default_vocabulary())
    for t in texts()[9:200]:
        raw, off = bpe.utf8_parts(pa.array([t]))
        assert enc.encode(raw, off)[0].tolist() == reference.encode_ordinary(t)


# -- 8 ------------------------------------------------------------------------------------------------------------------
def words(t):
    t = "".join(c for c in unicodedata.normalize("NFKC", t or "") if unicodedata.category(c) != "Cf").lower()
    return regex.findall(r"[\p{L}\p{N}]+", t)


@pytest.mark.parametrize("held", [2_000_000, 30])
def test_leaks_equal_brute_force(spark, held):
    rng = random.Random(5)
    vocab = ["zeta", "Ωmega", "x", "ﬁn", "naïve", "42", "straße", "ki­wi", "b", "İz"] + [f"w{i}" for i in range(150)]
    items = [(i, " ".join(rng.choices(vocab, k=rng.randint(5, 40)))) for i in range(40)] + [(90, None), (91, ""), (92, "a b c d e f g h i j k l"), (93, "  ")]
    docs = [(0, None), (1, ""), (2, "\x00\x00"), (3, "A, b; c d e f g h i j\tk\n\nL!")]
    for d in range(4, 300):
        w = rng.choices(vocab, k=rng.randint(0, 120))
        if d % 3 == 0:
            src = (items[rng.randint(0, 39)][1]).split()
            n = rng.choice([10, 11, 12, 13, 30])
            at = rng.randint(0, max(0, len(src) - n))
            k = rng.randint(0, len(w))
            w[k:k] = src[at : at + n]
        docs.append((d, rng.choice([" ", ", ", "\n", " — "]).join(w).upper() if d % 2 else " ".join(w)))
    docs.append((999, " ".join(rng.choices(vocab, k=30_000)) + " " + items[7][1]))
    grams = {}
    for i, t in items:
        w = words(t)
        for k in range(len(w) - 11):
            grams.setdefault(tuple(w[k : k + 12]), set()).add(i)
    want = {(d, i) for d, t in docs for w in [words(t)] for k in range(len(w) - 11) for i in grams.get(tuple(w[k : k + 12]), ())}
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("item_id", F.lit("clash"))
    it = spark.createDataFrame(items, "item_id long, text string").withColumn("doc_id", F.lit("clash"))
    found = leakage.find_leaks(df, it).where("exact_words >= 12").collect()
    parts = leakage.Items([i for i, _ in items], [t for _, t in items], 12, 12, 2)
    leakage.HELD_HITS, before = held, leakage.HELD_HITS
    got = leakage.scan(parts, [t or "" for _, t in docs])
    leakage.HELD_HITS = before
    assert {(docs[d][0], parts.ids[i]) for d, i, e in zip(got[0], got[1], got[4]) if e >= 12} == want
    assert {(r.doc_id, r.item_id) for r in found} == want and len(found) == len(want) and (3, 92) in want
    assert leakage.find_leaks(df.limit(0), it).count() == 0 and leakage.find_leaks(df, it.limit(0)).count() == 0


def test_edited_passages_are_found(spark):
    text = "the quick brown fox jumps over the lazy dog while seven wizards quietly observe from afar tonight"
    docs = [(1, f"start {text.replace('lazy', 'lezy')} end"), (2, text.replace("jumps", "jmps").replace("wizards", "wizzards")), (3, "nothing of the kind here at all, only other words in some order and more of them")]
    got = {r.doc_id: r.edits for r in leakage.find_leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(1, text)], "item_id long, text string")).collect()}
    assert set(got) >= {1} and 3 not in got and all(e <= 2 for e in got.values())


def test_the_region_with_most_shared_grams_is_not_the_only_one_tried():
    item = [f"{c}{c}word{i}" for i, c in enumerate("abcdefghijklmnopqrstuvwxyz")]
    docs = []
    for n, typos, replaced in [(14, [1, 8, 13], 12), (21, [8, 11], 9), (24, [0, 9], 19), (25, [6, 7], 18)]:
        w = [t.replace("word", "wurd") if i in typos else t for i, t in enumerate(item)]
        w[replaced] = item[replaced][:2] + "zzzzz"
        docs.append("x " + " ".join(w[:n]) + " y")
    got = leakage.scan(leakage.Items([1], [" ".join(item)], 12, 12, 2), docs)
    assert got[0].tolist() == [0, 1, 2, 3] and got[3].max() <= 2


@pytest.mark.parametrize("edits", [0, 1, 2])
def test_passages_edited_anywhere_are_found(edits):
    rng = random.Random(edits)
    word = lambda: "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randint(2, 9)))
    items = [" ".join(word() for _ in range(rng.randint(12, 30))) for _ in range(30)]
    docs, of = [], []
    for n in range(600):
        i = n % len(items)
        w = items[i].split()
        at = rng.randint(0, len(w) - 12)
        t = list(" ".join(w[at : at + 12]))
        for e in range(edits):
            place = (n // 30 + e * rng.randint(0, 9)) * len(t) // 20 % len(t) if e == 0 else rng.randrange(len(t))
            kind = rng.choice("sid")
            t[place : place + (kind != "i")] = [rng.choice("abcxyz")] if kind != "d" else []
        docs.append(" ".join([word() for _ in range(rng.choice([0, 8]))] + ["".join(t)] + [word() for _ in range(rng.choice([0, 8]))]))
        of.append(i)
    got = leakage.scan(leakage.Items(list(range(30)), items, 12, 12, 2), docs)
    found = {(d, i): e for d, i, e in zip(got[0], got[1], got[3])}
    hit = [found.get((d, i)) for d, i in enumerate(of)]
    assert sum(h is not None for h in hit) / len(hit) >= (1.0 if edits == 0 else 0.99) and all(h <= edits for h in hit if h is not None)


def test_items_in_several_blocks(spark, monkeypatch):
    monkeypatch.setattr(leakage, "ITEM_BLOCK_BYTES", 60)
    t = [" ".join(f"{c}{i}" for i in range(14)) for c in "abc"]
    items = spark.createDataFrame(list(enumerate(t)), "item_id long, text string")
    assert rows(leakage.find_leaks(items.withColumnRenamed("item_id", "doc_id"), items).select("doc_id", "item_id")) == [(0, 0), (1, 1), (2, 2)]


# -- 9 ------------------------------------------------------------------------------------------------------------------
def test_pieces_fit_and_overlap(spark, reference):
    rng = random.Random(9)
    sent = lambda: " ".join(rng.choices(["alpha", "beta", "gamma,", "delta", "naïve", "字字", "😀"], k=rng.randint(3, 25))) + rng.choice([". ", "! ", ".\n", "\n\n"])
    docs = [(i, "".join(sent() for _ in range(rng.randint(1, 60))), rng.choice(["note", "log", None, "unknown"])) for i in range(60)]
    docs += [(100, None, "note"), (101, "", "note"), (102, "x" * 4000, "note"), (103, "😀" * 500, "log"), (104, "\n" * 3000, "note"), (105, "word " * 3000, None)]
    limits = {"note": (64, 8), "log": (40, 0), "other": (100, 20)}
    lim = spark.createDataFrame([(k, *v) for k, v in limits.items()], "doc_kind string, max_tokens int, overlap_tokens int")
    df = spark.createDataFrame(docs, "doc_id long, text string, doc_kind string").withColumn("piece", F.lit("clash"))
    got = collections.defaultdict(list)
    for r in split.split_oversized(df, lim).collect():
        got[r.doc_id].append(r)
    for i, t, kind in docs:
        most, over = limits.get(kind, limits["other"])
        n = len(reference.encode_ordinary(t or ""))
        assert (i in got) == (n > most)
        if n <= most:
            continue
        p = sorted(got[i], key=lambda r: r.piece)
        assert p[0].first_token == 0 and p[-1].end_token == n and [r.piece for r in p] == list(range(p[0].n_pieces))
        assert all(r.n_tokens <= most and len(reference.encode_ordinary(r.piece_text)) <= most for r in p)
        assert all(over <= a.end_token - b.first_token <= over + (3 if over else 0) for a, b in zip(p, p[1:]))
        if not over:
            assert "".join(r.piece_text for r in p) == t
    with pytest.raises(Exception, match="overlap"):
        split.split_oversized(df, spark.createDataFrame([("other", 8, 8)], lim.schema)).collect()
    assert split.split_oversized(df.limit(0), lim).count() == 0 and split.split_oversized(df, lim.limit(0)).count() == 0


def test_cuts_prefer_natural_places():
    kind = np.full(99, split.WORD, np.uint8)
    kind[[29, 59, 79]] = split.PARAGRAPH
    assert split.best_cuts(100, 40, 0, kind, np.arange(101)) == [(0, 30), (30, 60), (60, 80), (80, 100)] or split.best_cuts(100, 40, 0, kind, np.arange(101))[0] == (0, 30)
