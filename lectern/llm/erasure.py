"""Cascading erasure: sorted Parquet files, victims found by joins that carry Spark's hidden file metadata, and a rewrite of the files hit.

Writing: rows are dealt into ranges of (crc32 of the key, all columns), sorted there and written once with their partition and place, so
that one more reading with the ranges' totals gives each row its global place, and this its file. Each file is then written by one task, in
order, streaming.

Erasing: the written tables are read again with `_metadata.file_path` and `_metadata.row_index`. Victim masters lead to clients, these to
clicks and sales, sales to their lines; each join carries only a key and the position. Positions are grouped by file into runs of
consecutive rows (a client's rows lie side by side, so a hot client is a run or a few). Only files with victims are read again: each
one's rows and runs meet in the task that writes it, where a row falls if the last run that began reaches over it. The files replace the
old ones by Spark's dynamic partition overwrite, so a file that lost no row is never touched, and emptied ones are removed.

Digests are taken from the final files, row by row in file order, with a running sha256 a file.

Defined results: null keys count as the empty string and never match in a join; a line whose sale is null or missing counts as one without client;
of a sale_id with several rows the smallest client counts. A master without clients' clicks has 0. Rows that are equal in all columns are interchangeable.
A null amount counts 0. An empty table gives no file and no row. Further columns are sorted and written along, whatever their names; long texts are
written whole.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .core import checkpointed, shared_folder, shuffle_parts

N_FILES = 250
DIVISOR = 200
#: The column whose cents are summed, for each table.
AMOUNTS = {"clients": "balance", "clicks": "value", "sales": "total", "sale_lines": "amount"}
_PLACE = 33  # bits of a row's place in its partition, as monotonically_increasing_id has them


def key_crc(key: Column) -> Column:
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary"))


def _path(spark: SparkSession, name: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(name)
    return where, where.getFileSystem(spark._jsc.hadoopConfiguration())


@dataclass
class Files:
    """A table of n rows as files of `each` consecutive rows, one folder a file, named by a column that the table lacks."""

    spark: SparkSession
    folder: str
    schema: T.StructType
    number: str
    n: int
    each: int

    @property
    def count(self) -> int:
        return -(-self.n // self.each)

    def rows_of(self, file_no: int) -> int:
        return min(self.each, self.n - file_no * self.each)

    def read(self, *cols: tuple[int, str]) -> DataFrame:
        """Columns by place under new names (all as c0, c1, ... if none is named), with file_no, path and row_index."""
        schema = T.StructType([*self.schema.fields, T.StructField(self.number, T.LongType())])
        df = self.spark.read.schema(schema).parquet(self.folder)
        hidden = df.metadataColumn("_metadata")
        chosen = cols or [(i, f"c{i}") for i in range(len(self.schema.names))]
        return df.select(*[_col(self.schema.names[i]).alias(n) for i, n in chosen], _col(self.number).alias("file_no"), hidden.getField("file_path").alias("path"), hidden.getField("row_index").alias("row_index"))

    def by_name(self, *names: str) -> DataFrame:
        return self.read(*[(self.schema.names.index(n), n) for n in names])

    def tasks(self, df: DataFrame) -> DataFrame:
        """Each file's rows in one task, in order."""
        parts = max(1, min(self.count, shuffle_parts(self.spark)))
        return df.repartitionById(parts, (F.col("file_no") % parts).cast("int")).sortWithinPartitions("file_no", "row_index")

    def write(self, df: DataFrame, mode: str) -> None:
        """df: c0, c1, ... and file_no, sorted by file_no within each task."""
        named = df.select(*[F.col(f"c{i}").alias(n) for i, n in enumerate(self.schema.names)], F.col("file_no").alias(self.number))
        options = {"partitionOverwriteMode": "dynamic", "mapreduce.fileoutputcommitter.marksuccessfuljobs": "false", "maxRecordsPerFile": "0"}
        named.write.mode(mode).options(**options).partitionBy(self.number).parquet(self.folder)


def _col(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def _free(names: list[str], name: str) -> str:
    taken = {n.lower() for n in names}
    while name in taken:
        name += "_"
    return name


def sorted_files(table: DataFrame, crc: DataFrame, folder: str, n_files: int = N_FILES) -> Files:
    """Write a table in the order of a checksum and then its columns. crc: the checksum and the table's columns as c0, c1, ..."""
    spark, names = table.sparkSession, table.columns
    own = [f"c{i}" for i in range(len(names))]
    order = ["crc", *own]
    stage = f"{folder}-sorted"
    ranged = crc.select(*order).repartitionByRange(shuffle_parts(spark), *order).sortWithinPartitions(*order)
    ranged.select(*own, F.monotonically_increasing_id().alias("at")).write.parquet(stage)
    placed = spark.read.schema(T.StructType([*[T.StructField(c, f.dataType) for c, f in zip(own, table.schema.fields)], T.StructField("at", T.LongType())])).parquet(stage)
    part = F.shiftright("at", _PLACE)
    totals = placed.groupBy(part.alias("part")).count().orderBy("part").collect()  # one row a shuffle partition
    n = sum(r["count"] for r in totals)
    files = Files(spark, folder, T.StructType([T.StructField(f.name, f.dataType) for f in table.schema.fields]), _free(names, "file_no"), n, 1 + n // n_files)
    where, fs = _path(spark, folder)
    fs.mkdirs(where)
    if n:
        before = np.r_[0, np.cumsum([r["count"] for r in totals])]
        starts = spark.createDataFrame([(r["part"], int(b)) for r, b in zip(totals, before)], "part long, before long")
        row = F.col("before") + F.col("at").bitwiseAND(F.lit((1 << _PLACE) - 1))
        rows = placed.withColumn("part", part).join(F.broadcast(starts), "part").select(*own, row.alias("row_index"))  # a row a shuffle partition is broadcast
        files.write(files.tasks(rows.withColumn("file_no", F.expr(f"row_index div {files.each}"))), "append")
    where, fs = _path(spark, stage)
    fs.delete(where, True)
    return files


def victim_masters(clients: DataFrame, clicks: DataFrame, divisor: int = DIVISOR) -> DataFrame:
    """Masters whose checksum is divisible, and the one whose clients have most clicks; column master_id."""
    masters = clients.select("master_id").dropna().distinct()
    clicked = clicks.select("client_id").dropna().groupBy("client_id").agg(F.count("*").alias("n"))
    n = clients.select("master_id", "client_id").dropna().distinct().join(clicked, "client_id").groupBy("master_id").agg(F.sum("n").alias("n"))
    most = masters.join(n, "master_id", "left").orderBy(F.coalesce("n", F.lit(0)).desc(), "master_id").limit(1).select("master_id")
    return masters.filter(key_crc(F.col("master_id")) % divisor == 0).union(most).distinct()


def positions(rows: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """file_no, path, row_index of the rows whose key is among keys."""
    return rows.join(keys, key, "left_semi").select("file_no", "path", "row_index")


def runs(victims: DataFrame) -> DataFrame:
    """Positions grouped by file into runs: file_no, path, first, last."""
    island = F.col("row_index") - F.row_number().over(Window.partitionBy("file_no", "path").orderBy("row_index"))
    return victims.withColumn("island", island).groupBy("file_no", "path", "island").agg(F.min("row_index").alias("first"), F.max("row_index").alias("last")).drop("island")


def rewrite(files: Files, erased: DataFrame) -> dict[int, int]:
    """Write the files that hold runs of `erased` anew without these rows; return the erased rows of each of them."""
    spark = files.spark
    hit = {r["file_no"]: r["n"] for r in erased.groupBy("file_no").agg(F.sum(F.col("last") - F.col("first") + 1).alias("n")).collect()}  # a row a file
    left = [k for k, n in hit.items() if n < files.rows_of(k)]
    if left:
        rows = files.read().filter(F.col("file_no").isin(left)).drop("path").withColumn("until", F.lit(None).cast("long"))
        marks = erased.filter(F.col("file_no").isin(left)).select("file_no", F.col("first").alias("row_index"), F.col("last").alias("until"))
        both = rows.unionByName(marks, allowMissingColumns=True)
        until = F.last("until", ignorenulls=True).over(Window.partitionBy("file_no").orderBy("row_index", F.desc_nulls_last("until")))
        kept = both.withColumn("to", until).filter(F.col("until").isNull() & (F.col("to").isNull() | (F.col("row_index") > F.col("to"))))
        files.write(kept.sortWithinPartitions("file_no", "row_index"), "overwrite")
    for k in sorted(set(hit) - set(left)):
        where, fs = _path(spark, f"{files.folder}/{files.number}={k}")
        fs.delete(where, True)
    return hit


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row a file from its rows in order; nothing but running values is kept."""
    now, path, sha, n, cents = None, None, None, 0, 0

    def told() -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"file_no": pa.array([now], pa.int64()), "path": pa.array([path]), "n_rows": pa.array([n], pa.int64()), "cents": pa.array([cents], pa.int64()), "ids_sha256": pa.array([sha.hexdigest()])})

    for batch in batches:
        no, amount, ids = batch.column("file_no").to_numpy(), batch.column("cents").to_numpy(), batch.column("id")
        cuts = [0, *(np.flatnonzero(no[1:] != no[:-1]) + 1).tolist(), len(no)] if len(no) else []
        for i, j in zip(cuts, cuts[1:]):
            if no[i] != now:
                if sha is not None:
                    yield told()
                now, path, sha, n, cents = int(no[i]), batch.column("path")[i].as_py(), hashlib.sha256(), 0, 0
            sha.update((("," if n else "") + ",".join(ids[i:j].to_pylist())).encode())
            n, cents = n + j - i, cents + int(amount[i:j].sum())
    if sha is not None:
        yield told()


def report(files: Files, name: str, amount: str, hit: dict[int, int]) -> DataFrame:
    """A row for each final file."""
    x = files.read((0, "id"), (files.schema.names.index(amount), "amount"))
    cents = F.coalesce(F.floor(F.col("amount") * 100 + 0.5), F.lit(0)).cast("long")
    rows = files.tasks(x.select("file_no", "row_index", "path", F.coalesce(F.col("id").cast("string"), F.lit("")).alias("id"), cents.alias("cents")))
    made = rows.drop("row_index").mapInArrow(_digests, "file_no long, path string, n_rows long, cents long, ids_sha256 string")
    erased = files.spark.createDataFrame(sorted(hit.items()), "file_no long, n_erased long")  # N_FILES rows at most
    n = F.coalesce("n_erased", F.lit(0)).cast("long")
    return made.join(F.broadcast(erased), "file_no", "left").select(
        "file_no", "n_rows", n.alias("n_erased"), "cents", (n > 0).alias("rewritten"), F.lit(name).alias("table_name"), "ids_sha256", F.lit(",".join(files.schema.names)).alias("columns"), "path"
    )


def erasure(spark: SparkSession, tables: dict[str, DataFrame], n_files: int = N_FILES, divisor: int = DIVISOR) -> DataFrame:
    """Write clients, clicks, sales and sale_lines as sorted files in a new shared folder, erase the victims there, and report the final files."""
    folder = f"{shared_folder(spark)}/erasure-{uuid.uuid4().hex}"
    # a row a sale, written so that Spark can split a hot sale of the join below
    buyers = checkpointed(tables["sales"].select("sale_id", "client_id").filter("sale_id is not null").groupBy("sale_id").agg(F.min("client_id").alias("buyer")))
    files = {}
    for name, table in tables.items():
        own = table.toDF(*[f"c{i}" for i in range(len(table.columns))])
        if name == "sale_lines":
            keyed = own.join(buyers.withColumnRenamed("sale_id", "sale"), F.col(f"c{table.columns.index('sale_id')}") == F.col("sale"), "left")
            own = keyed.withColumn("crc", key_crc(F.col("buyer")))
        else:
            own = own.withColumn("crc", key_crc(F.col(f"c{table.columns.index('client_id')}")))
        files[name] = sorted_files(table, own, f"{folder}/{name}", n_files)
    clients, clicks, sales = files["clients"].by_name("client_id", "master_id"), files["clicks"].by_name("client_id"), files["sales"].by_name("sale_id", "client_id")
    masters = checkpointed(victim_masters(clients, clicks, divisor))
    found = checkpointed(clients.join(masters, "master_id", "left_semi").select("client_id", "file_no", "path", "row_index"))
    gone = found.select("client_id").dropna()  # not made distinct, so that Spark can split a hot client of the joins below
    sold = checkpointed(sales.join(gone, "client_id", "left_semi").select("sale_id", "file_no", "path", "row_index"))
    victims = {
        "clients": found.select("file_no", "path", "row_index"),
        "clicks": positions(clicks, gone, "client_id"),
        "sales": sold.select("file_no", "path", "row_index"),
        "sale_lines": positions(files["sale_lines"].by_name("sale_id"), sold.select("sale_id"), "sale_id"),
    }
    erased = {name: checkpointed(runs(x)) for name, x in victims.items()}  # all before the first file changes
    hit = {name: rewrite(files[name], x) for name, x in erased.items()}
    return reduce(DataFrame.union, [report(files[name], name, AMOUNTS[name], hit[name]) for name in files])
