"""Problem 1: total and record frequency of every distinct term, and marks for those too rare or too common.

Recursive radix spilling: the scan parts its rows by bits of the term's hash into compressed columnar blocks, written to
the shared folder; partitions above ``limit_rows`` are parted again by bits of the hash of term and record, level by
level, so that a hot term is spread too. The number of bits follows the number of rows, so that few levels are needed, and
rows that repeat one another are dropped when they are spilled. Each remaining partition is aggregated out of core by
DuckDB in one task, and the few rows a term has left are summed.
"""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._work import cut, shared_dir

LEVEL_BITS = 10  # of the 64-bit hash that a level may use
FLUSH_ROWS = 1_000_000
BLOCK = "part long, level int, n long, payload binary"


def _mix(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.uint64)
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
        x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def _pack(table) -> bytes:
    import pyarrow as pa

    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
        w.write_table(table)
    return sink.getvalue().to_pybytes()


def _unpack(payload: bytes):
    import pyarrow as pa

    return pa.ipc.open_stream(payload).read_all()


def _once(table):
    """The table without rows that repeat another one."""
    import pyarrow as pa

    cols = [c.to_numpy() for c in table.columns]
    h = np.zeros(table.num_rows, np.uint64)
    with np.errstate(over="ignore"):
        for c in cols:
            h = _mix(h * np.uint64(3) + (c.view(np.int64) if c.dtype == np.float64 else c).astype(np.uint64))
    order = np.argsort(h)
    same = np.ones(max(0, len(order) - 1), bool)
    for c in cols:
        v = c[order].view(np.int64)
        same &= v[1:] == v[:-1]
    if not same.any():
        return table
    return table.take(pa.array(np.sort(order[np.concatenate([[True], ~same])])))


def _parted(table, bits: int, level: int, part: int = 0):
    """Blocks of the table by the level's hash bits: (part, level, n, payload)."""
    import pyarrow as pa

    term = table.column("term").to_numpy()
    h = _mix(term)
    if level:
        with np.errstate(over="ignore"):
            h = _mix(h + np.uint64(0x9E3779B97F4A7C15) * table.column("rec").to_numpy().astype(np.uint64))
    radix = ((h >> np.uint64(64 - LEVEL_BITS * level - bits)) & np.uint64((1 << bits) - 1)).astype(np.uint16)
    order = np.argsort(radix, kind="stable")
    table, sizes = table.take(pa.array(order)), np.bincount(radix, minlength=1 << bits)
    ends = np.cumsum(sizes)
    own = np.flatnonzero(sizes)
    return pa.RecordBatch.from_arrays(
        [
            pa.array((part << LEVEL_BITS) + own.astype(np.int64)), pa.array(np.full(len(own), level, np.int32)), pa.array(sizes[own].astype(np.int64)),
            pa.array([_pack(table.slice(ends[r] - sizes[r], sizes[r])) for r in own], pa.binary()),
        ],
        ["part", "level", "n", "payload"],
    )


def _spill(bits: int):
    """Rows (term, rec, piece, val) -> blocks of level 0. Rows that do not count stay as their bare term (rec -1)."""

    def flush(held):
        import pyarrow as pa
        import pyarrow.compute as pc

        t = pa.Table.from_batches(held, held[0].schema)
        rec, val = t.column("rec"), t.column("val")
        ok = pc.and_(pc.and_(pc.is_valid(rec), pc.greater_equal(pc.fill_null(rec, -1), 0)), pc.is_finite(pc.fill_null(val, float("nan"))))
        bad = t.column("term").filter(pc.invert(ok)).unique()
        t = t.set_column(2, "piece", pc.fill_null(t.column("piece"), -1)).filter(ok)
        bare = pa.table({"term": bad, "rec": pa.array(np.full(len(bad), -1)), "piece": pa.array(np.zeros(len(bad), np.int64)), "val": pa.array(np.zeros(len(bad)))})
        return _parted(_once(pa.concat_tables([t, bare.cast(t.schema)]).combine_chunks()), bits, 0)

    def run(batches):
        held, rows = [], 0
        for b in batches:
            if b.num_rows:
                held.append(b)
                rows += b.num_rows
            if rows >= FLUSH_ROWS:
                yield flush(held)
                held, rows = [], 0
        if held:
            yield flush(held)

    return run


def _bits_for(n: int, limit_rows: int) -> int:
    """Bits by which n rows come into parts of about half the limit."""
    return min(LEVEL_BITS, max(1, (n // limit_rows).bit_length() + 1))


def _split_again(limit_rows: int):
    """Blocks with the rows of their whole partition -> blocks of the next level."""

    def run(batches):
        import pyarrow as pa

        for b in batches:
            for part, level, payload, total in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(3), b.column(4).to_pylist()):
                yield _parted(_unpack(payload.as_py()), _bits_for(total, limit_rows), level + 1, part)

    return run


def _aggregator(folder: str, memory_mb: int):
    def run(table):
        """One partition -> a row per term (sum, detected) and one with the records detected here."""
        import duckdb
        import pyarrow as pa

        con = duckdb.connect(config={"threads": 1, "memory_limit": f"{memory_mb}MB", "temp_directory": f"{folder}/{uuid.uuid4().hex}" if folder else ""})
        try:
            con.execute("create table t (term bigint, rec bigint, piece bigint, val double)")
            for payload in table.column("payload"):
                rows = _unpack(payload.as_py())  # noqa: F841 - named in the statement
                con.execute("insert into t select term, rec, piece, val from rows")
            con.execute(
                "create table c as select term, rec, sum(val) as total from (select term, rec, piece, max(val) as val from t group by term, rec, piece) group by term, rec"
            )
            terms = con.execute("select term, sum(total) filter (where rec >= 0) as s, count(*) filter (where rec >= 0 and total > 0) as d from c group by term").fetchnumpy()
            recs = con.execute("select distinct rec from c where rec >= 0 and total > 0").fetchnumpy()["rec"]
        finally:
            con.close()
        n = len(terms["term"])
        ids = pa.ListArray.from_arrays(pa.array(np.array([0] * (n + 1) + [len(recs)], np.int32)), pa.array(np.ma.filled(recs, 0).astype(np.int64)))
        return pa.table(
            {
                "term": pa.array([*np.ma.filled(terms["term"], 0).tolist(), None], pa.int64()),
                "s": pa.array([*np.ma.filled(terms["s"], 0.0).tolist(), None], pa.float64()),
                "d": pa.array([*np.ma.filled(terms["d"], 0).tolist(), None], pa.int64()),
                "recs": ids,
            }
        )

    return run


def term_frequencies(
    rows: DataFrame, term: str = "gene_id", record: str = "cell_id", piece: str = "lane", value: str = "expr_value", limit_rows: int = 2_000_000, memory_mb: int = 400
) -> tuple[DataFrame, DataFrame]:
    """(term, sum, detected) of every distinct term, and one row with n, the number of records in which any is detected.

    A measurement (record, term, piece) counts once, however often it is repeated (if its copies differ, the largest
    value); the count of a term in a record is the sum over pieces, and it is detected there if that is above 0. Rows
    with null term, null or negative record, or null or non-finite value do not count; a term with no other rows has
    sum and detected 0. Keys are whole numbers; a null piece is a piece of its own. Other columns are ignored. An empty table
    gives no terms and n = 0. A partition that DuckDB aggregates has ``limit_rows`` at most, so that ``memory_mb`` is enough for it
    in memory; where the shared folder is a mounted one DuckDB may spill there besides.
    """
    spark = rows.sparkSession
    cols = [rows[term].cast("long").alias("term"), rows[record].cast("long").alias("rec"), rows[piece].cast("long").alias("piece"), rows[value].cast("double").alias("val")]
    named = rows.where(rows[term].isNotNull()).select(*cols)
    blocks = cut(named.mapInArrow(_spill(max(6, _bits_for(rows.count(), limit_rows))), BLOCK))
    done = None
    for _ in range(64 // LEVEL_BITS - 1):
        big = cut(blocks.groupBy("part").agg(F.sum("n").alias("total")).where(F.col("total") > limit_rows))
        if big.isEmpty():
            break
        rest = blocks.join(big, "part", "left_anti")
        done = rest if done is None else done.unionAll(rest)
        blocks = cut(blocks.join(big, "part").select(*blocks.columns, "total").mapInArrow(_split_again(limit_rows), BLOCK))
    done = blocks if done is None else done.unionAll(blocks)
    at = shared_dir(spark)
    folder = at.removeprefix("file://") if at.startswith(("file://", "/")) else ""  # DuckDB spills only to a mounted folder
    out = cut(done.groupBy("level", "part").applyInArrow(_aggregator(folder, memory_mb), "term long, s double, d long, recs array<long>"))
    freq = out.where("term is not null").groupBy("term").agg(F.sum("s").alias("sum"), F.sum("d").alias("detected"))
    n = out.where("term is null").select(F.explode("recs").alias("rec")).distinct().agg(F.count("*").alias("n"))
    return freq.withColumnRenamed("term", term), n


def mark_terms(freq: DataFrame, n: DataFrame, options: DataFrame) -> DataFrame:
    """freq with ``marks``, an array of 'rare' and 'common'. ``n`` and ``options`` have one row each and are broadcast; other
    numbers of options are an error."""
    if len(options.limit(2).collect()) != 1:
        raise ValueError("options must have one row")
    opt = options.select(F.col("min_detected_cells").alias("_cells"), F.col("min_gene_sum").alias("_sum"), F.col("max_detected_share").alias("_share"))
    rare = (F.col("detected") < F.col("_cells")) | (F.col("sum") < F.col("_sum"))
    common = F.col("detected") > F.col("_share") * F.col("n")
    marks = F.array_compact(F.array(F.when(rare, F.lit("rare")), F.when(common, F.lit("common"))))
    return freq.join(F.broadcast(n)).join(F.broadcast(opt)).withColumn("marks", marks).drop("_cells", "_sum", "_share")
