"""Opening, subsetting and publishing data sets."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def summary(expression: DataFrame, cells: DataFrame, features: DataFrame, layout: str = "long", state: str = "raw_counts") -> DataFrame:
    """One row: rows, columns, stored entries, layout and matrix state."""
    rows, cols = cells.agg(F.count("*").alias("n_rows")), features.agg(F.count("*").alias("n_cols"))
    nnz = expression.agg(F.count("*").alias("nnz"))
    return rows.join(F.broadcast(cols)).join(F.broadcast(nnz)).withColumns({"layout": F.lit(layout), "matrix_state": F.lit(state)})


def shard_waves(entries: DataFrame, shard: str, per_wave: int, first: int = 0) -> DataFrame:
    """(shard, n_rows, wave): shards in waves of ``per_wave``."""
    return entries.groupBy(F.col(shard).alias("shard")).agg(F.count("*").alias("n_rows")).withColumn("wave", F.floor((F.col("shard") - first) / per_wave).cast("int"))


def csr_entries(rows: DataFrame, keys: list[str], indices: str, name: str) -> DataFrame:
    """(keys, slot, name): one row a stored entry of the rows' index arrays; null arrays hold none."""
    return rows.select(*keys, F.posexplode(indices).alias("slot", name))


def label_column(rows: DataFrame, key: str, label: str) -> DataFrame:
    """(key, label); an error if the column is missing or not text."""
    if label not in rows.columns:
        raise ValueError(f"there is no column {label}")
    if not isinstance(rows.schema[label].dataType, T.StringType):
        raise TypeError(f"{label} is not text")
    return rows.select(key, label)


def seeded(key: str, seed: int):
    """A number from the digest of seed and key, the same in every engine that has MD5."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string"))), 1, 13), 16, 10).cast("long")


def labelled_subset(rows: DataFrame, key: str, label: str, most: int, seed: int) -> DataFrame:
    """Rows with a label, at most ``most`` a label, and their place ``pos`` in its seeded order."""
    w = Window.partitionBy(label).orderBy(seeded(key, seed), key)
    return rows.where(F.col(label).isNotNull()).withColumn("pos", F.row_number().over(w)).where(F.col("pos") <= most)


def label_order(rows: DataFrame, label: str) -> DataFrame:
    """(label, n, pos): labels by the number in them, those without one last. As many rows as there are labels."""
    counts = rows.where(F.col(label).isNotNull()).groupBy(label).agg(F.count("*").alias("n"))
    number = F.coalesce(F.try_to_number(F.nullif(F.regexp_extract(label, r"[0-9]+\.?[0-9]*", 0), F.lit("")), F.lit("999999.999999")).cast("double"), F.lit(1e9))
    return counts.withColumn("pos", F.row_number().over(Window.orderBy(number, label)))


def nested_subset(rows: DataFrame, key: str, fast: int, representative: int, seed: int) -> DataFrame:
    """(key, fast): ``representative`` rows by hash rank, the first ``fast`` of them marked. The sort keeps only so many rows a task."""
    top = rows.select(key).withColumn("_h", seeded(key, seed)).orderBy("_h", key).limit(representative)
    return top.withColumn("fast", F.row_number().over(Window.orderBy("_h", key)) <= fast).drop("_h")


def merge_records(base: DataFrame, override: DataFrame, key: str) -> DataFrame:
    """base with the non-null fields of override, which has one row a key at most."""
    o = override.withColumnsRenamed({c: f"_{c}" for c in override.columns if c != key})
    cols = [F.coalesce(f"_{c}", c).alias(c) if c in override.columns and c != key else F.col(c) for c in base.columns]
    return base.join(o, key, "left").select(*cols)


def filtered_matrix(expression: DataFrame, cells: DataFrame, genes: DataFrame) -> DataFrame:
    """Entries of kept cells and kept genes."""
    return expression.join(cells.select("cell_id"), "cell_id", "left_semi").join(genes.select("gene_id"), "gene_id", "left_semi").select("cell_id", "gene_id", "value")


def publish(path: str, matrix: DataFrame, cell_metrics: DataFrame, gene_metrics: DataFrame) -> None:
    """Write the filtered raw matrix with all metrics; the state row marks it as filtered raw counts."""
    spark = matrix.sparkSession
    matrix.write.mode("errorifexists").parquet(f"{path}/matrix")
    cell_metrics.write.mode("errorifexists").parquet(f"{path}/cells")
    gene_metrics.write.mode("errorifexists").parquet(f"{path}/genes")
    spark.createDataFrame([("filtered_raw_counts", True)], "matrix_state string, preprocess_available boolean").write.mode("errorifexists").json(f"{path}/state")


def manifest(df: DataFrame, part: str, cols: list[str]) -> DataFrame:
    """(part, n_rows, checksum) that no order of rows changes."""
    digest = F.conv(F.substring(F.md5(F.concat_ws(":", *(F.col(c).cast("string") for c in cols))), 1, 15), 16, 10).cast("long")
    return df.agg(F.count("*").alias("n_rows"), F.bit_xor(digest).alias("checksum")).select(F.lit(part).alias("part"), "n_rows", "checksum")


def flatten_records(records: DataFrame, separator: str = "|") -> DataFrame:
    """records with one plain column a field: lists joined by ``separator`` (nulls in them left out), fields of structs named
    ``struct_field``, truth values as 'true' and 'false', and null as the empty text where a column is text. Columns come by name."""
    cols = {}
    for f in records.schema:
        fields = [(f"{f.name}_{g.name}", g.dataType, F.col(f.name)[g.name]) for g in f.dataType] if isinstance(f.dataType, T.StructType) else [(f.name, f.dataType, F.col(f.name))]
        for name, kind, c in fields:
            if name in cols:
                raise ValueError(f"two fields are named {name}")
            if isinstance(kind, T.ArrayType):
                c, kind = F.array_join(c.cast("array<string>"), separator), T.StringType()
            elif isinstance(kind, (T.StructType, T.MapType)):
                c, kind = F.to_json(c), T.StringType()
            elif isinstance(kind, T.BooleanType):
                c, kind = c.cast("string"), T.StringType()
            cols[name] = F.coalesce(c, F.lit("")) if isinstance(kind, T.StringType) else c
    return records.select(*(cols[n].alias(n) for n in sorted(cols)))


def write_catalog(records: DataFrame, path: str, kind: str = "tsv") -> None:
    """Text files of the records: 'tsv' flat, with a header and columns by name; 'json' one object a line, lists and structs kept."""
    if kind == "tsv":
        flatten_records(records).write.mode("errorifexists").option("sep", "\t").option("header", True).option("nullValue", "").option("emptyValue", "").csv(path)
    elif kind == "json":
        records.select(*sorted(records.columns)).write.mode("errorifexists").json(path)
    else:
        raise ValueError(kind)


class ImageError(ValueError):
    """A stored image that is not what its manifest says."""


def write_image(path: str, tables: dict[str, DataFrame], version: int) -> None:
    """Tables as Parquet under ``path`` with a manifest, written last: version, and name, columns, rows and checksum of each."""
    spark, rows = next(iter(tables.values())).sparkSession, []
    for name, df in tables.items():
        df.write.mode("errorifexists").parquet(f"{path}/{name}")
        m = manifest(spark.read.parquet(f"{path}/{name}"), name, df.columns).first()
        rows.append((version, name, df.schema.json(), m["n_rows"], m["checksum"]))
    spark.createDataFrame(rows, "version int, part string, columns string, n_rows long, checksum long").coalesce(1).write.mode("errorifexists").json(f"{path}/manifest")


def open_image(spark: SparkSession, path: str, version: int, parts: list[str] | None = None) -> dict[str, DataFrame]:
    """The tables of an image (or the named ones), once its version, their columns, rows and checksums have been verified.

    They are read with the columns that the manifest states, so a plan made for an earlier copy can be bound to this one.
    """
    stated = {r["part"]: r for r in spark.read.schema("version int, part string, columns string, n_rows long, checksum long").json(f"{path}/manifest").collect()}
    out = {}
    for name in parts or stated:
        if name not in stated:
            raise ImageError(f"there is no part {name}")
        s = stated[name]
        if s["version"] != version:
            raise ImageError(f"{name} has version {s['version']}, not {version}")
        df = spark.read.schema(T.StructType.fromJson(json.loads(s["columns"]))).parquet(f"{path}/{name}")
        m = manifest(df, name, df.columns).first()
        if (m["n_rows"], m["checksum"]) != (s["n_rows"], s["checksum"]):
            raise ImageError(f"{name} is not what was written")
        out[name] = df
    return out


def degrees(entries: DataFrame, axes: dict[str, str]) -> DataFrame:
    """(axis, id, degree) of each axis."""
    out = None
    for axis, col in axes.items():
        one = entries.groupBy(F.col(col).alias("id")).agg(F.count("*").alias("degree")).select(F.lit(axis).alias("axis"), "id", "degree")
        out = one if out is None else out.unionAll(one)
    return out


def read_matrix_market(spark: SparkSession, path: str) -> DataFrame:
    """(row, col, value) of a Matrix Market coordinate matrix, counted from 0; a pattern matrix has value 1.

    The matrix may lie in several text files, one of which has the banner, then comments and the line of sizes, and after it
    entries as the others do. Of a symmetric, skew-symmetric or Hermitian matrix the entries off the diagonal come twice, negated
    in the skew one. A missing banner, a dense or a complex matrix is an error.
    """
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("at"), F.monotonically_increasing_id().alias("i"))
    banners = lines.where(F.startswith(F.lower("value"), F.lit("%%matrixmarket"))).select("value", "file").limit(2).collect()
    if len(banners) != 1:
        raise ValueError("there must be one line with the Matrix Market banner")
    words = banners[0]["value"].lower().split()
    if len(words) != 5 or words[1:3] != ["matrix", "coordinate"] or words[3] == "complex":
        raise ValueError(f"cannot read {banners[0]['value']}")
    fields, pattern = F.split(F.btrim("value"), r"\s+"), words[3] == "pattern"
    body = lines.where(~F.startswith("value", F.lit("%")) & (F.btrim("value") != "")).select(fields.alias("f"), "file", "at", "i")
    # numbers of lines grow within a block of a file, and the sizes are in the first block of the file with the banner
    begin = body.where((F.col("file") == banners[0]["file"]) & (F.col("at") == 0))
    sizes = begin.agg(F.min("i")).first()[0]
    if sizes is None:
        raise ValueError("the line of sizes does not follow the banner")
    value = F.lit(1.0) if pattern else F.col("f")[2].cast("double")
    entries = body.where(F.col("i") != F.lit(sizes)).select((F.col("f")[0].cast("long") - 1).alias("row"), (F.col("f")[1].cast("long") - 1).alias("col"), value.alias("value"))
    if words[4] == "general":
        return entries
    other = entries.where("row <> col").select(F.col("col").alias("row"), F.col("row").alias("col"), (-F.col("value") if words[4] == "skew-symmetric" else F.col("value")).alias("value"))
    return entries.unionAll(other)


def write_matrix_market(entries: DataFrame, path: str, n_rows: int, n_cols: int) -> None:
    """Text files (row, col, value), counted from 1; the first one begins with the banner and the line of sizes."""
    nnz = entries.count()
    spark = entries.sparkSession
    head = spark.createDataFrame([("%%MatrixMarket matrix coordinate real general", 0), (f"{n_rows} {n_cols} {nnz}", 1)], "value string, k int")
    body = entries.select(F.format_string("%d %d %s", F.col("row") + 1, F.col("col") + 1, F.col("value").cast("string")).alias("value"), F.lit(2).alias("k"), "row", "col")
    head = head.withColumns({"row": F.lit(None).cast("long"), "col": F.lit(None).cast("long")})
    head.unionByName(body).repartitionByRange(max(1, int(spark.conf.get("spark.sql.shuffle.partitions"))), "k", "row", "col").sortWithinPartitions("k", "row", "col").select("value").write.mode("errorifexists").text(path)
