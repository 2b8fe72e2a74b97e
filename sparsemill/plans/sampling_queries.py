"""Hashes, samples, sketches and set relations (57-60, 66-83)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.hashing import BAND_DOMAIN, BUCKET_DOMAIN, CELL_DOMAIN, FNV_OFFSET, FNV_PRIME, GAMMA, MASK, MINHASH_DOMAIN, ROW_DOMAIN, SKETCH_STRIDE, signed, splitmix, sql_signed, sql_splitmix, sql_unsigned, unsigned_order, with_id_hash, with_row_hash
from ..operators import sampling, sparse, support
from ..sources import files
from ..sources.tables import CELLS, EXPRESSION, SUPPORT, cells, expression, table
from ..sources.tables import support as sets
from .catalog import query

SEED = 42
_ROW_SALT = splitmix(SEED ^ ROW_DOMAIN)
CELL_IDS = "(select distinct cell_id from cells)"


def _sql_row_hash(source: str, row: str, seed: int = SEED) -> str:
    """Rows with ``h`` (UBIGINT)."""
    return sql_splitmix(source, "h", f"xor({row}::ubigint, {splitmix(seed ^ ROW_DOMAIN)}::ubigint)")


def _rows(spark, d):
    return cells(spark, d).select("cell_id")


def _nnz(spark, d):
    return expression(spark, d).groupBy("cell_id").agg(F.count("*").alias("nnz"))


@query("q068_row_hash", f"select cell_id, {sql_signed('h')} as hash from ({_sql_row_hash(CELL_IDS, 'cell_id')})")
def q068(spark, d):
    """Seeded hash of row numbers."""
    return with_row_hash(_rows(spark, d), "hash", F.col("cell_id"), SEED)


def _sql_id_hash(name: str | None = None) -> str:
    """Hashes of the stable identifiers; with a name as a table (stable_id, h) that a query may go on from."""
    m = "18446744073709551616::uhugeint"
    # the fold over the bytes of an identifier, by a recursive query over its positions
    fold = f"""with recursive i as (select distinct stable_id from cells where stable_id is not null), f as (
      select stable_id, 0 as k, {FNV_OFFSET}::ubigint as x from i union all
      select stable_id, k + 1, ((xor(x, ('0x' || substr(hex(stable_id::blob), 2 * k + 1, 2))::ubigint)::uhugeint * {FNV_PRIME}::uhugeint) % {m})::ubigint from f where k < octet_length(stable_id::blob))"""
    base = "(select stable_id, x, octet_length(stable_id::blob)::ubigint as n from f where k = octet_length(stable_id::blob))"
    first = sql_splitmix(base, "l", f"xor(n, {CELL_DOMAIN}::ubigint)")
    hashed = sql_splitmix(first, "h", f"xor(xor(x, l), {splitmix(SEED ^ CELL_DOMAIN)}::ubigint)")
    return f"{fold}, {name} as (select stable_id, h from ({hashed}))" if name else fold + " select stable_id, " + sql_signed("h") + " as hash from (" + hashed + ")"


@query("q068_id_hash", _sql_id_hash())
def q068b(spark, d):
    """Seeded hash of stable identifiers."""
    return with_id_hash(table(spark, d, "cells").where("stable_id is not null").select("stable_id").distinct(), "hash", "stable_id", SEED)


@query("q069_hash_range", f"select cell_id from ({_sql_row_hash(CELL_IDS, 'cell_id')}) where h::uhugeint * 8 >= 1::uhugeint * 18446744073709551616 and h::uhugeint * 3 < 1::uhugeint * 18446744073709551616")
def q069(spark, d):
    """Rows with hash in [1/8, 1/3)."""
    return sampling.hash_range(_rows(spark, d), "cell_id", SEED, (1, 8), (1, 3)).select("cell_id")


@query("q070_lowest_hashes", f"select cell_id, row_number() over (order by cell_id) - 1 as position from (select cell_id from ({_sql_row_hash(CELL_IDS, 'cell_id')}) order by h, cell_id limit 500)")
def q070(spark, d):
    """Five hundred rows of lowest hash, in row order."""
    return sampling.lowest_hashes(_rows(spark, d), "cell_id", SEED, 500).select("cell_id", "position")


_STRATA = f"""with {EXPRESSION}, z as (select cell_id, count(*) as nnz from e group by 1),
  v as (select nnz, n, sum(n) over (order by nnz) as below, row_number() over (order by nnz) as place, sum(n) over () as total, count(*) over () as vals from (select nnz, count(*) as n from z group by 1)),
  cu as (select cut, least(8, vals) as st, vals, (array_agg(place order by abs(below * least(8, vals) - cut * total), place))[1] as hit from v, range(1, 8) t(cut) where cut < least(8, vals) group by all),
  en as (select least(max(hit - cut) over (order by cut) + cut, vals - st + cut) as last from cu),
  ds as (select nnz, n, (select count(*) from en where last < place) as stratum from v),
  sz as (select stratum, max(nnz) as upper, sum(n)::bigint as size from ds group by 1),
  sh as (select *, greatest(least(400, sum(size) over ()) - count(*) over (), 0) as rest, sum(size) over () - count(*) over () as room from sz),
  wh as (select *, (rest * (size - 1)) // greatest(room, 1) as whole, (rest * (size - 1)) % greatest(room, 1) as part from sh),
  al as (select stratum, upper, size, (1 + whole + case when row_number() over (order by part desc, stratum) <= rest - sum(whole) over () then 1 else 0 end)::bigint as sampled from wh)"""


@query("q071_density_boundaries", f"{_STRATA} select stratum, upper from sz")
def q071(spark, d):
    """Upper ends of eight density strata."""
    return sampling.density_strata(_nnz(spark, d), "nnz", 8).groupBy("stratum").agg(F.max("nnz").alias("upper"))


@query("q073_density_sample", f"""{_STRATA}, hs as (select * from ({_sql_row_hash('(select cell_id, nnz from z)', 'cell_id')})),
  rk as (select cell_id, nnz, stratum, row_number() over (partition by stratum order by h, cell_id) as i from hs join ds using (nnz))
  select cell_id, nnz, stratum, size / sampled as weight from rk join al using (stratum) where i <= sampled""")
def q073(spark, d):
    """Four hundred rows (all, if there are fewer) over eight density strata, with weights."""
    n = _nnz(spark, d)
    return sampling.density_sample(n, "cell_id", "nnz", SEED, 8, min(400, n.count())).select("cell_id", "nnz", "stratum", "weight")


@query("q072_density_allocation", f"{_STRATA} select stratum, size, sampled from al")
def q072(spark, d):
    """Rows of every stratum, and how many of them are drawn."""
    n = _nnz(spark, d)
    return sampling.density_allocation(sampling.density_strata(n, "nnz", 8), min(400, n.count())).select("stratum", "size", "sampled")


@query("q074_reproduced", f"""select 'hash_range' as mode, cell_id, true as same from ({_sql_row_hash(CELL_IDS, 'cell_id')}) where h::uhugeint * 8 >= 1::uhugeint * 18446744073709551616 and h::uhugeint * 3 < 1::uhugeint * 18446744073709551616
  union all select 'lowest', cell_id, true from (select cell_id from ({_sql_row_hash(CELL_IDS, 'cell_id')}) order by h, cell_id limit 300)""")
def q074(spark, d):
    """The rows of reruns from the stored parameters on other partitions, and whether the first run had them, too."""
    out = None
    for mode, draw in (("hash_range", lambda r: sampling.hash_range(r, "cell_id", SEED, (1, 8), (1, 3))), ("lowest", lambda r: sampling.lowest_hashes(r, "cell_id", SEED, 300))):
        first, again = (draw(_rows(spark, d).repartition(n)).select("cell_id") for n in (1, 5))
        both = again.join(first.withColumn("_first", F.lit(True)), "cell_id", "full")
        one = both.select(F.lit(mode).alias("mode"), "cell_id", F.coalesce("_first", F.lit(False)).alias("same"))
        out = one if out is None else out.unionAll(one)
    return out


@query("q075_sample_key", "select count(*) as n_rows, count(stable_id) = count(*) as by_barcode from cells")
def q075(spark, d):
    """Whether barcodes are complete, so that samples go by them, or else by row."""
    return table(spark, d, "cells").agg(F.count("*").alias("n_rows"), (F.count("stable_id") == F.count("*")).alias("by_barcode"))


@query("q075_file_sample", f"""{_sql_id_hash('ih')}, b as (select cell_id, min(stable_id) as stable_id from cells where stable_id <> '' group by 1)
  select 'id' as key, cell_id, row_number() over (order by cell_id) - 1 as position from (select cell_id from b join ih using (stable_id) order by h, stable_id, cell_id limit 300)
  union all select 'row', cell_id, row_number() over (order by cell_id) - 1 from (select cell_id from ({_sql_row_hash(CELL_IDS, 'cell_id')}) order by h, cell_id limit 300)""")
def q075b(spark, d):
    """Three hundred cells by identifier, of those that have one, and by row, of all, of which some have none."""
    ids = table(spark, d, "cells").groupBy("cell_id").agg(F.min(F.nullif("stable_id", F.lit(""))).alias("stable_id"))
    without = _rows(spark, d).withColumn("stable_id", F.lit(None).cast("string"))
    parts = [sampling.file_sample(r, "cell_id", "stable_id", SEED, 300).select("key", "cell_id", "position") for r in (ids.where("stable_id is not null"), without)]
    return parts[0].unionAll(parts[1])


@query("q076_sampled_structure", f"with {EXPRESSION}, p as (select cell_id, row_number() over (order by cell_id) - 1 as position from (select cell_id from ({_sql_row_hash(CELL_IDS, 'cell_id')}) order by h, cell_id limit 500)) select position, gene_id from e join p using (cell_id)")
def q076(spark, d):
    """Columns of the sampled rows, values left out."""
    plan = sampling.lowest_hashes(_rows(spark, d), "cell_id", SEED, 500).select("cell_id", "position")
    return expression(spark, d).join(plan, "cell_id").select("position", "gene_id")


@query("q077_labelled_sample", f"""with {CELLS}, s as (select cell_id, label, row_number() over (partition by label order by h, cell_id) as i from ({_sql_row_hash("(select cell_id, label from c where label is not null)", 'cell_id')}))
  select cell_id, label, row_number() over (order by label, cell_id) - 1 as position from (select * from s where i <= 20 order by label, cell_id limit 200)""".replace("from (select *, ((", "from (select *, (("))
def q077(spark, d):
    """At most twenty rows a label and two hundred in all."""
    return sampling.labelled_sample(cells(spark, d), "cell_id", "label", SEED, 20, 200)


@query("q078_downsampled", f"""with {CELLS}, {EXPRESSION}, s as (select cell_id, label, row_number() over (partition by label order by h, cell_id) as i from ({_sql_row_hash("(select cell_id, label from c where label is not null)", 'cell_id')})),
  p as (select cell_id, label, row_number() over (order by label, cell_id) - 1 as position from s where i <= 20)
  select label, min(position) as "begin", max(position) + 1 as "end", coalesce(sum(n), 0)::bigint as nnz from p left join (select cell_id, count(*) as n from e group by 1) using (cell_id) group by 1""")
def q078(spark, d):
    """Label spans of a downsampled matrix and their stored entries."""
    s = sampling.labelled_sample(cells(spark, d), "cell_id", "label", SEED, 20)
    nnz = s.join(_nnz(spark, d), "cell_id", "left").groupBy("label").agg(F.coalesce(F.sum("nnz"), F.lit(0)).alias("nnz"))
    return sampling.label_spans(s, "label").join(nnz, "label")


_DATASETS = "(select distinct dataset_id from cells where dataset_id is not null)"


@query("q079_held_out", f"""with u as (select dataset_id, row_number() over (order by h, dataset_id) - 1 as i, count(*) over () as n from ({_sql_row_hash(_DATASETS, 'dataset_id')}))
  select dataset_id, i < least(greatest(1, n // 5), n - 1) as held_out, count(distinct cell_id) as n_cells from cells join u using (dataset_id) group by all""")
def q079(spark, d):
    """A fifth of the data sets held out whole."""
    c = table(spark, d, "cells").where("dataset_id is not null")
    return sampling.held_out_split(c, "dataset_id", SEED, 1, 5).groupBy("dataset_id", "held_out").agg(F.countDistinct("cell_id").alias("n_cells"))


_UNITS = f"u as (select cell_id, row_number() over (order by cell_id) - 1 as i, count(*) over () as n from {CELL_IDS})"


def _sql_draws(ids: str, key: int) -> str:
    """Draws (id, i): unit numbers by half of the hash of the draw's number."""
    return f"dr as (select id, ((h >> 1) % (select max(n) from u))::bigint as i from ({sql_splitmix(f'(select * from {ids})', 'h', f'xor(id::ubigint, {splitmix(key)}::ubigint)')}))"


@query("q080_bootstrap", f"with {_UNITS}, {_sql_draws('(select i as id from u)', SEED ^ sampling.BOOT_DOMAIN)} select cell_id, count(*) as times from dr join u using (i) group by 1")
def q080(spark, d):
    """Multiplicities of one bootstrap of the cells."""
    return sampling.bootstrap(_rows(spark, d), "cell_id", SEED, 0)


@query("q081_degree_null")
def q081(spark, d):
    """A random matrix of the same row and column degrees."""
    return sampling.degree_preserving_null(sets(spark, d), "gene_id", "cell_id", SEED)


@query("q081_null_degrees", f"with {SUPPORT} select 'gene' as axis, gene_id as id, count(*) as degree from s group by all union all select 'cell', cell_id, count(*) from s group by all")
def q081b(spark, d):
    """Row and column degrees of such a matrix, counted over its distinct entries."""
    return files.degrees(sampling.degree_preserving_null(sets(spark, d), "gene_id", "cell_id", SEED).distinct(), {"gene": "gene_id", "cell": "cell_id"})


@query("q082_minibatches", f"""with {CELLS}, t as (select cell_id, floor("time")::int as bucket from c where "time" is not null)
  select cell_id, bucket, (row_number() over (partition by bucket order by h, cell_id) - 1) // 32 as batch from ({_sql_row_hash('(select * from t)', 'cell_id')})""")
def q082(spark, d):
    """Batches of thirty-two inside time buckets."""
    c = cells(spark, d).where("time is not null").select("cell_id", "time")
    return sampling.minibatches(c, "cell_id", F.floor("time").cast("int"), SEED, 32).select("cell_id", "bucket", "batch")


@query("q082_uniform_batches", f"with {_UNITS}, {_sql_draws('(select range as id from range(1000))', SEED)} select id as draw, cell_id from dr join u using (i)")
def q082b(spark, d):
    """A thousand uniform draws with replacement."""
    return sampling.batch_with_replacement(_rows(spark, d), "cell_id", SEED, 1000)


@query("q057_bitset", f"with {SUPPORT} select gene_id, cell_id // 32 as word, bit_or(1::bigint << (cell_id % 32)::int) as bits from s group by all")
def q057(spark, d):
    """Sets as words of thirty-two bits."""
    return support.bitset(sets(spark, d), "gene_id", "cell_id")


@query("q057_detected", f"with {SUPPORT} select gene_id, count(*)::bigint as detected from s group by 1")
def q057b(spark, d):
    """Members counted from the words."""
    return support.detected_counts(support.bitset(sets(spark, d), "gene_id", "cell_id"), "gene_id")


@query("q058_support_size", f"with {SUPPORT}, n as (select max(cell_id) + 1 as cells, count(distinct gene_id) as genes from s) select (cells + 31) // 32 as words_per_gene, 4 * ((cells + 31) // 32) * genes as bytes from n")
def q058(spark, d):
    """Words and bytes of the bitset."""
    cells_, genes = sets(spark, d).agg(F.max("cell_id") + 1, F.countDistinct("gene_id")).first()
    size = support.support_size(cells_, genes)
    return spark.createDataFrame([(size["words_per_gene"], size["bytes"])], "words_per_gene long, bytes long")


_P = support.Sketch(seed=SEED)
_SALTS = ", ".join(f"({j}, {splitmix(SEED ^ MINHASH_DOMAIN ^ (j * SKETCH_STRIDE & MASK))}::ubigint)" for j in range(_P.count))
_BANDS = ", ".join(f"({b}, {splitmix(SEED ^ BAND_DOMAIN ^ b)}::ubigint, {(SEED ^ BUCKET_DOMAIN ^ (b * SKETCH_STRIDE & MASK))}::ubigint)" for b in range(_P.bands))


def _sql_pairs() -> str:
    hashed = sql_splitmix(f"(select gene_id, cell_id, j, salt from s, (values {_SALTS}) t(j, salt))", "h", "xor(cell_id::ubigint, salt)")
    keys = f"(select gene_id, band, st, bs, v0, v1, v2, v3, st as key from w join (values {_BANDS}) b(band, st, bs) using (band))"
    for r in range(4):
        keys = "(" + sql_splitmix(f"(select * from {keys})", f"k{r}", f"xor(xor({'key' if r == 0 else f'k{r - 1}'}, v{r}), {(r * GAMMA) & MASK}::ubigint)") + ")"
    window = sql_splitmix("(select gene_id, band, k3 as key, bs, count(*) over (partition by k3, band) as n, row_number() over (partition by k3, band order by gene_id) - 1 as i from kk)", "wh", "xor(key, bs)")
    return f"""with {SUPPORT}, m as (select gene_id, j, min(h) as v from ({hashed}) group by all),
      w as (select gene_id, j // 4 as band, max(case when j % 4 = 0 then v end) as v0, max(case when j % 4 = 1 then v end) as v1, max(case when j % 4 = 2 then v end) as v2, max(case when j % 4 = 3 then v end) as v3 from m group by all),
      kk as (select * from {keys}),
      x as (select gene_id, band, key from ({window}) where ((i - (case when n > 64 then (wh % n::ubigint)::bigint else 0 end)) % n + n) % n < 64),
      p as (select distinct a.gene_id as gene_a, b.gene_id as gene_b from x a join x b on a.key = b.key and a.band = b.band and a.gene_id < b.gene_id)"""


@query("q066_candidates", _sql_pairs() + " select * from p")
def q066(spark, d):
    """Candidate pairs by MinHash bands."""
    return support.candidate_pairs(sets(spark, d), "gene_id", "cell_id", _P)


@query("q067_candidate_bound", f"with {SUPPORT}, n as (select count(distinct gene_id) as g from s) select g as genes, 16 * ((g // 64) * 2016 + (g % 64) * (g % 64 - 1) // 2) as most_pairs from n")
def q067(spark, d):
    """Most pairs the bands can give."""
    g = sets(spark, d).agg(F.countDistinct("gene_id")).first()[0]
    return spark.createDataFrame([(g, support.candidate_bound(g, _P))], "genes long, most_pairs long")


_OVERLAP = """o as (
  select gene_a, gene_b, na.n as size_a, nb.n as size_b, coalesce(i.c, 0) as intersection, na.n + nb.n - coalesce(i.c, 0) as "union"
  from p join (select gene_id, count(*) as n from s group by 1) na on na.gene_id = gene_a join (select gene_id, count(*) as n from s group by 1) nb on nb.gene_id = gene_b
  left join (select gene_a, gene_b, count(*) as c from p join s a on a.gene_id = gene_a join s b on b.gene_id = gene_b and a.cell_id = b.cell_id group by all) i using (gene_a, gene_b))"""


def _overlap(spark, d):
    s = sets(spark, d)
    return support.pair_overlap(s, support.candidate_pairs(s, "gene_id", "cell_id", _P), "gene_id", "cell_id")


@query("q059_pair_overlap", f'{_sql_pairs()}, {_OVERLAP} select gene_a, gene_b, intersection, "union" from o')
def q059(spark, d):
    """Intersections and unions of candidate pairs."""
    return _overlap(spark, d).select("gene_a", "gene_b", "intersection", "union")


def _sql_bytes(width: int, rows: str, nnz: str) -> str:
    meta = -(-(16 + 4 * width + 8) // 8) * 8
    return f"(({meta} + (((({rows}) + 1) * 4 + ({rows}) * 4 + 7) // 8) * 8 + ({nnz}) * 2 + 15) // 16) * 16"


_GAIN = f"""{_sql_pairs()}, {_OVERLAP}, c as (select *, {_sql_bytes(1, 'size_a', 'size_a')} + {_sql_bytes(1, 'size_b', 'size_b')} as separate_bytes, {_sql_bytes(2, '"union"', 'size_a + size_b')} as merged_bytes from o)"""


@query("q060_merge_gain", f"{_GAIN} select gene_a, gene_b, separate_bytes, merged_bytes, separate_bytes - merged_bytes as gain from c")
def q060(spark, d):
    """Exact bytes saved by storing two features in one block."""
    return support.merge_gain(_overlap(spark, d)).select("gene_a", "gene_b", "separate_bytes", "merged_bytes", "gain")


@query("q083_normalized_candidates", f"{_GAIN} select gene_a as a, gene_b as b, intersection as num, \"union\" as den from c")
def q083(spark, d):
    """Relations listed both ways, with self edges, as distinct unordered pairs."""
    o = _overlap(spark, d).select(F.col("gene_a").alias("a"), F.col("gene_b").alias("b"), F.col("intersection").alias("num"), F.col("union").alias("den"))
    back = o.select(F.col("b").alias("a"), F.col("a").alias("b"), "num", (F.col("den") + 1).alias("den"))
    loops = o.select("a", F.col("a").alias("b"), F.lit(1).cast("long").alias("num"), F.lit(1).cast("long").alias("den"))
    return support.normalize_candidates(o.unionAll(back).unionAll(loops), [F.col("den")])
