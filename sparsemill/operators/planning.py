"""Choosing plans: greedy packing, refinement on held-out cost, cost models, candidate ranking, synthetic traces."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.lineage import cut

MOST_RELATIONS = 5_000_000
FEATURES = ["rows", "nnz", "bytes", "tiles", "tile_blocks", "entries", "block_width", "index_bytes", "alignment", "transactions"]


def greedy_blocks(relations: DataFrame, features: DataFrame, width: int, gene: str = "gene_id", most_relations: int = MOST_RELATIONS) -> DataFrame:
    """(gene, block, local): features merged along relations (gene_a, gene_b, gain) of positive gain, best first, up to ``width``.

    Each merge depends on those before it, so one task does them; more than ``most_relations`` is an error. Features without
    relations stay alone, and a block is named by its least feature.
    """
    if relations.count() > most_relations:
        raise ValueError(f"more than {most_relations} relations")

    def merge(batches):
        import pyarrow as pa

        rows = sorted((-g, a, b) for batch in batches for a, b, g in zip(*(c.to_pylist() for c in batch.columns)))
        block: dict[int, list[int]] = {}
        for _, a, b in rows:
            x, y = block.setdefault(a, [a]), block.setdefault(b, [b])
            if x is not y and len(x) + len(y) <= width:
                x.extend(y)
                for m in y:
                    block[m] = x
        named = [(m, min(x), sorted(x).index(m)) for m, x in block.items()]
        if named:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*named)], [gene, "block", "local"])

    good = relations.where("gain > 0").select("gene_a", "gene_b", "gain").coalesce(1).mapInArrow(merge, f"{gene} long, block long, local long")
    return features.select(gene).join(good, gene, "left").select(gene, F.coalesce("block", gene).alias("block"), F.coalesce("local", F.lit(0)).alias("local"))


def block_gains(entries: DataFrame, plan: DataFrame, relations: DataFrame, width: int, fan_out: int, row: str = "cell_id", col: str = "gene_id") -> dict[str, DataFrame]:
    """Proposals by kind with the row-and-block references that each would save, positive ones only.

    merge (a, b): two blocks that together fit the width share so many rows. move (g, a, b): rows in which g is alone in its
    block a, less the rows of g that block b does not have yet. swap (g, h, a, b): the sum of both moves, for blocks whose
    width bars a move. Blocks are nominated for a feature by its relations (gene_a, gene_b, gain), the ``fan_out`` strongest.
    """
    p = plan.select(F.col(col).alias("g"), "block")
    e = entries.select(F.col(row).alias("r"), F.col(col).alias("g")).distinct().join(p, "g")
    held = cut(e.groupBy("r", "block").agg(F.count("*").alias("n")))
    size = p.groupBy("block").agg(F.count("*").alias("size"))
    both = relations.select(F.col("gene_a").alias("g"), F.col("gene_b").alias("h"), "gain").unionAll(relations.select(F.col("gene_b").alias("g"), F.col("gene_a").alias("h"), "gain"))
    near = both.join(p.withColumnRenamed("block", "a"), "g").join(p.select(F.col("g").alias("h"), F.col("block").alias("b")), "h").where("a <> b").groupBy("g", "a", "b").agg(F.max("gain").alias("gain"))
    near = cut(near.withColumn("_i", F.row_number().over(Window.partitionBy("g").orderBy(F.desc("gain"), "b"))).where(F.col("_i") <= fan_out).select("g", "a", "b"))
    sizes = lambda df: df.join(size.withColumnsRenamed({"block": "a", "size": "na"}), "a").join(size.withColumnsRenamed({"block": "b", "size": "nb"}), "b")
    fits = sizes(near.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()).where(F.col("na") + F.col("nb") <= width).select("a", "b")
    one, two = held.select("r", F.col("block").alias("a")), held.select("r", F.col("block").alias("b"))
    merge = fits.join(one, "a").join(two, ["r", "b"]).groupBy("a", "b").agg(F.count("*").alias("saved"))
    alone = e.join(held, ["r", "block"]).groupBy("g").agg(F.count_if(F.col("n") == 1).alias("alone"), F.count("*").alias("degree"))
    met = near.join(e.select("g", "r"), "g").join(two, ["r", "b"]).groupBy("g", "a", "b").agg(F.count("*").alias("met"))
    moves = cut(sizes(near.join(met, ["g", "a", "b"], "left").join(alone, "g")).select("g", "a", "b", "nb", (F.col("alone") - F.col("degree") + F.coalesce("met", F.lit(0))).alias("saved")))
    back = moves.select(F.col("g").alias("h"), F.col("b").alias("a"), F.col("a").alias("b"), F.col("saved").alias("saved_back"))
    swap = moves.where(F.col("nb") >= width).join(back, ["a", "b"]).where("a < b").select("g", "h", "a", "b", (F.col("saved") + F.col("saved_back")).alias("saved"))
    return {"merge": merge, "move": moves.where(F.col("nb") < width).where("saved > 0").drop("nb"), "swap": swap.where("saved > 0")}


def optimize_blocks(
    entries: DataFrame, start: DataFrame, relations: DataFrame, width: int, cost: Callable[[DataFrame], float], fan_out: int = 8, shortlist: int = 1_000, first_batch: int = 64, most_evaluations: int = 40,
    row: str = "cell_id", col: str = "gene_id",
) -> tuple[DataFrame, list[tuple]]:
    """A plan (col, block) of lower exact cost than ``start``, and a log (phase, proposals, cost, accepted).

    Blocks are first merged, then features moved and swapped. Gains are counted in Spark over all rows; the ``shortlist`` best
    proposals come to the driver, of which those that touch no block twice are applied together, ``first_batch`` at most, and
    the plan is costed exactly. A batch that does not pay is halved; a single proposal that does not is not tried again.
    A phase ends when nothing is proposed or accepted, all when ``most_evaluations`` are used.
    """
    plan = cut(start.select(col, "block"))
    best, log = cost(plan), []
    evaluations = 1
    for phase, kinds in (("coarsen", ("merge",)), ("refine", ("move", "swap"))):
        barred: set[tuple] = set()
        most = first_batch
        while evaluations < most_evaluations:
            found = block_gains(entries, plan, relations, width, fan_out, row, col)
            rows = [(-r["saved"], kind, *(r[c] for c in found[kind].columns if c != "saved")) for kind in kinds for r in found[kind].orderBy(F.desc("saved"), *(c for c in found[kind].columns if c != "saved")).limit(shortlist).collect()]
            rows = sorted(r for r in rows if r[1:] not in barred)
            accepted = False
            while rows and evaluations < most_evaluations:
                batch, used = [], set()
                for r in rows:
                    if len(batch) < most and not used & set(r[-2:]):  # the two blocks end every proposal
                        batch.append(r)
                        used |= set(r[-2:])
                new = _with_moves(plan, batch, col)
                c = cost(new)
                evaluations, accepted = evaluations + 1, c < best
                log.append((phase, len(batch), c, accepted))
                if accepted:
                    plan, best, most = new, c, first_batch
                    break
                if len(batch) > 1:
                    most = len(batch) // 2
                else:
                    barred.add(batch[0][1:])
                    rows, most = [r for r in rows if r[1:] not in barred], first_batch
            if not accepted:
                break
    return plan, log


def _with_moves(plan: DataFrame, batch: list[tuple], col: str) -> DataFrame:
    """The plan after a batch of at most some dozens of proposals, none of which touches a block of another."""
    block, gene = F.col("block"), F.col(col)
    new = block
    for _, kind, *p in batch:
        if kind == "merge":
            new = F.when(block == p[1], F.lit(p[0])).otherwise(new)
        elif kind == "move":
            new = F.when(gene == p[0], F.lit(p[2])).otherwise(new)
        else:
            new = F.when(gene == p[0], F.lit(p[3])).when(gene == p[1], F.lit(p[2])).otherwise(new)
    return cut(plan.select(gene, new.alias("block")))


def alternate(start, moves: Sequence[tuple[str, Callable]], held_out_cost: Callable, least_gain: float = 0.0, most_passes: int = 8, most_evaluations: int = 64) -> tuple:
    """(best, log (pass, name, cost, accepted), reason) of taking turns: every move makes a proposal from the best so far, which
    is kept only if it lowers the cost on held-out rows by more than ``least_gain``.

    It stops when a whole pass changes nothing ('converged'), or at the most passes ('passes') or evaluations ('evaluations').
    """
    best, cost, log = start, held_out_cost(start), []
    for turn in range(most_passes):
        changed = False
        for name, move in moves:
            if len(log) + 1 >= most_evaluations:
                return best, log, "evaluations"
            new = move(best)
            c = held_out_cost(new)
            ok = cost - c > least_gain
            log.append((turn, name, c, ok))
            if ok:
                best, cost, changed = new, c, True
        if not changed:
            return best, log, "converged"
    return best, log, "passes"


def autotune(candidates: Sequence, measure: Callable[..., float], close_enough: float, most_trials: int | None = None) -> tuple:
    """(chosen, trials, reason): the fastest of the first ``most_trials`` candidates, but the first one, the baseline, unless
    another is faster by more than the share ``close_enough``."""
    if not candidates:
        raise ValueError("there is nothing to choose from")
    times = [measure(c) for c in candidates[: most_trials or None]]
    at = int(np.argmin(times))
    if at and times[at] < times[0] * (1 - close_enough):
        return candidates[at], times, "completed"
    return candidates[0], times, "close_enough"


def refine(start: DataFrame, proposals: Sequence[tuple[str, DataFrame]], held_out_cost: Callable[[DataFrame], float], least_gain: float = 0.0, most_rejections: int = 3) -> tuple[DataFrame, list[tuple]]:
    """The plan after trying the proposals in turn, and a log (name, cost, accepted); stops after so many rejections in a row.

    A proposal is taken only if it lowers the cost on held-out rows.
    """
    best, cost = start, held_out_cost(start)
    log, rejected = [("start", cost, True)], 0
    for name, plan in proposals:
        c = held_out_cost(plan)
        ok = cost - c > least_gain
        log.append((name, c, ok))
        best, cost, rejected = (plan, c, 0) if ok else (best, cost, rejected + 1)
        if rejected >= most_rejections:
            break
    return best, log


def against_null(real: DataFrame, null: DataFrame) -> DataFrame:
    """(metric, real, null, difference, no_greater) from two one-row tables of metrics."""
    long = lambda df, name: df.unpivot([], df.columns, "metric", name)
    double = lambda df: df.select(*(F.col(c).cast("double").alias(c) for c in df.columns))
    both = long(double(real), "real").join(long(double(null), "null"), "metric")
    return both.withColumns({"difference": F.abs(F.col("real") - F.col("null")), "no_greater": F.col("real") <= F.col("null")})


def shape_features(shapes: dict[str, np.ndarray]) -> np.ndarray:
    """Rows of thirteen features: one, logarithms of counts and bytes, and two ratios."""
    log = {k: np.log1p(np.asarray(shapes[k], float)) for k in FEATURES}
    ratios = [shapes["tile_blocks"] / shapes["tiles"], shapes["entries"] / shapes["tile_blocks"]]
    cols = [np.ones(len(log["rows"])), *(log[k] for k in FEATURES[:7]), *ratios, *(log[k] for k in FEATURES[7:])]
    return np.stack(cols, axis=1)


def fit_cost(x: np.ndarray, seconds: np.ndarray, ridge: float = 1e-3) -> dict[str, np.ndarray]:
    """Ridge regression of log time on standardised features; the constant one is not penalised."""
    mean, std = x.mean(0), x.std(0)
    mean[0], std = 0.0, np.where(std > 1e-12, std, 1.0)
    z, penalty = (x - mean) / std, ridge * np.eye(x.shape[1])
    penalty[0, 0] = 0.0
    return {"mean": mean, "std": std, "w": np.linalg.solve(z.T @ z + penalty, z.T @ np.log(seconds))}


def predict_cost(model: dict[str, np.ndarray], x: np.ndarray) -> np.ndarray:
    return np.exp((x - model["mean"]) / model["std"] @ model["w"])


def shape_columns() -> list[Column]:
    """The same thirteen features as columns of a table with the shapes."""
    log = {k: F.log1p(F.col(k).cast("double")) for k in FEATURES}
    ratios = [F.col("tile_blocks") / F.col("tiles"), F.col("entries") / F.col("tile_blocks")]
    return [F.lit(1.0), *(log[k] for k in FEATURES[:7]), *ratios, *(log[k] for k in FEATURES[7:])]


def fit_cost_table(observations: DataFrame, seconds: str, ridge: float = 1e-3) -> dict[str, np.ndarray]:
    """``fit_cost`` over a table of shapes and times of any size: one aggregation gives the sums of the normal equations."""
    x = shape_columns()
    names = [f"x{i}" for i in range(len(x))]
    t = observations.where(F.col(seconds) > 0).select(*(c.alias(n) for c, n in zip(x, names)), F.log(seconds).alias("y"))
    pairs = [(i, j) for i in range(len(x)) for j in range(i, len(x))]
    row = t.agg(F.count("*"), F.sum("y"), *(F.sum(n) for n in names), *(F.sum(F.col(n) * F.col("y")) for n in names), *(F.sum(F.col(names[i]) * F.col(names[j])) for i, j in pairs)).first()
    n, k = row[0], len(x)
    if not n:
        raise ValueError("there are no observations")
    total, by_y, square = np.array(row[2 : 2 + k]), np.array(row[2 + k : 2 + 2 * k]), np.zeros((k, k))
    for (i, j), v in zip(pairs, row[2 + 2 * k :]):
        square[i, j] = square[j, i] = v
    mean = total / n
    std = np.sqrt(np.maximum(np.diag(square) / n - mean**2, 0.0))
    mean[0], std = 0.0, np.where(std > 1e-6, std, 1.0)
    z = (square - np.outer(mean, total) - np.outer(total, mean) + n * np.outer(mean, mean)) / np.outer(std, std)
    penalty = ridge * np.eye(k)
    penalty[0, 0] = 0.0
    return {"mean": mean, "std": std, "w": np.linalg.solve(z + penalty, (by_y - mean * row[1]) / std)}


def predicted_cost(model: dict[str, np.ndarray]) -> Column:
    """The model's time of a row of shapes, as an expression."""
    terms = [(c - float(m)) * float(w / s) for c, m, s, w in zip(shape_columns(), model["mean"], model["std"], model["w"])]
    return F.exp(sum(terms[1:], terms[0]))


def select_plan(candidates: DataFrame, by: list[str], byte_weight: float) -> DataFrame:
    """Per group the candidate of least byte_weight * bytes + nanoseconds, the one of lowest id on ties; those without a finite
    cost are left out."""
    cost = F.lit(float(byte_weight)) * F.col("bytes") + F.col("nanoseconds")
    c = candidates.withColumn("cost", cost).where(F.col("cost").isNotNull() & ~F.isnan("cost") & (F.col("cost") < float("inf")))
    first = F.min(F.struct("cost", "id")).alias("b")
    return c.groupBy(*by).agg(first).select(*by, F.col("b.id").alias("id"), F.col("b.cost").alias("cost"))


def mape(predicted: np.ndarray, measured: np.ndarray) -> float:
    return float(np.mean(np.abs(predicted - measured) / measured))


def rank_candidates(candidates: DataFrame, reuse: int, shortlist: int, tolerance: float) -> DataFrame:
    """Legal candidates by amortised cost (preparation / reuse + execution), the shortlist with the one to run.

    Among those within ``tolerance`` of the least cost the one of fewest bytes wins, ties by id. Candidates are few.
    """
    cost = F.col("preparation") / float(reuse) + F.col("execution")
    c = candidates.where("legal").withColumn("cost", cost).withColumn("place", F.row_number().over(Window.orderBy("cost", "id"))).where(F.col("place") <= shortlist)
    near = (F.col("cost") <= F.min("cost").over(Window.partitionBy()) * (1 + tolerance)).cast("int")
    pick = F.row_number().over(Window.orderBy(F.desc("_near"), "bytes", "id")) == 1
    return c.withColumn("_near", near).withColumn("chosen", pick).drop("_near")


def objective(edges: Column, weights: dict[str, float], s: dict[str, Column], reuse: float, dense_width: int, value_bytes: float, transpose: bool, canonical: bool, quantized: bool, fused: bool) -> Column:
    """Weighted cost of a layout less its credits; absent weights are 0."""
    w = lambda k: weights.get(k, 0.0)
    cost = w("byte") * (s["metadata_bytes"] + s["value_bytes"]) / reuse
    cost = cost + w("partial") * s["partial_slots"] * dense_width * value_bytes + w("imbalance") * s["row_imbalance"] * edges
    if canonical:
        cost = cost + w("order") * edges
    if transpose:
        cost = cost + w("transpose") * (2 - s["transpose_locality"]) * edges
    cost = cost + w("communication") * s["cross_edges"]
    if quantized:
        cost = cost + w("quantization") * s["outliers"] * edges
    credit = w("reuse") * s["feature_reuse"] * edges + w("module") * s["module_overlap"] * s["module_activation"] * edges
    return cost - credit - (w("epilogue") * edges if fused else 0.0)


def synthetic_trace(spark, rows: int, columns: int, seed: int) -> DataFrame:
    """(row, column): deterministic supports of three hashed families: a long tail of degrees, dense fragments, modules."""
    from ..functions.hashing import signed, splitmix, splitmix_column

    mix = splitmix_column()
    salt = lambda i: F.lit(signed(splitmix(seed ^ i)))
    h = lambda c, i: F.pmod(F.shiftrightunsigned(mix(c.bitwiseXOR(salt(i))), 1), F.lit(1 << 30))
    r = spark.range(rows).withColumnRenamed("id", "row").withColumn("u", h(F.col("row"), 1))
    r = r.withColumn("family", F.pmod("u", F.lit(3)))
    degree = F.when(F.col("family") == 0, F.least(F.lit(columns), F.floor(4 / F.sqrt((F.col("u") + 1) / float(1 << 30))))).otherwise(F.when(F.col("family") == 1, F.lit(24)).otherwise(F.lit(12)))
    r = r.withColumn("degree", degree.cast("int")).withColumn("j", F.explode(F.sequence(F.lit(0), F.col("degree") - 1)))
    at = h(F.col("row") * 65536 + F.col("j"), 2)
    column = F.when(F.col("family") == 1, F.pmod(F.floor(F.col("row") / 32) * 24 + F.col("j"), F.lit(columns))).when(F.col("family") == 2, F.pmod(F.pmod("row", F.lit(8)) * (columns // 8) + F.pmod(at, F.lit(max(1, columns // 8))), F.lit(columns))).otherwise(F.pmod(at, F.lit(columns)))
    return r.select("row", column.cast("long").alias("column")).distinct()


def trace_summary(entries: DataFrame) -> DataFrame:
    """One row: rows, entries, mean, least and greatest degree, columns in use."""
    d = entries.groupBy("row").agg(F.count("*").alias("n"))
    used = entries.agg(F.countDistinct("column").alias("columns"))
    return d.agg(F.count("*").alias("rows"), F.sum("n").alias("nnz"), F.avg("n").alias("mean_degree"), F.min("n").alias("least"), F.max("n").alias("most")).join(F.broadcast(used))


def support_lists(entries: DataFrame, plan: DataFrame, row: str = "cell_id", col: str = "gene_id") -> DataFrame:
    """(position, columns): the sorted columns of each sampled row."""
    return entries.join(plan.select(row, "position"), row).groupBy("position").agg(F.array_sort(F.collect_set(col)).alias("columns"))


def arrow_batches(df: DataFrame, rows: int = 10_000):
    """Arrow tables of at most ``rows`` rows: what a tensor library reads. One partition at a time is on the driver, as the
    bytes of its batches; no row becomes a Python object."""
    import pyarrow as pa

    def packed(batches):
        for b in batches:
            for i in range(0, b.num_rows, rows):
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, b.schema) as w:
                    w.write_batch(b.slice(i, rows))
                yield pa.RecordBatch.from_arrays([pa.array([sink.getvalue().to_pybytes()], pa.binary())], ["batch"])

    for r in df.mapInArrow(packed, "batch binary").toLocalIterator():
        yield pa.ipc.open_stream(r["batch"]).read_all()
