"""What the text operators share: reading, cutting lineage, folds and Arrow batches."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lagwise.session import ship

#: Rows turned into Python objects at a time, so that very long texts don't pile up in a worker.
SLICE = 256
#: Rows with a text that a worker gets at once: Spark's 10,000 documents are tens of megabytes, held on both sides.
TEXTS = 1000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ship(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir, or a folder of this machine where it is unset and all of Spark runs here (tests)."""
    there = spark.conf.get("spark.checkpoint.dir", None)
    if not there:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        there = "file://" + tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", there)
    return there


@contextmanager
def batches_of(spark: SparkSession, rows: int | None = TEXTS) -> Iterator[None]:
    """What runs meanwhile hands workers at most so many rows at once (None: as the session has it)."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    if rows and not 0 < int(before) <= rows:
        spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def written(df: DataFrame, rows: int | None = None) -> DataFrame:
    """df as a Parquet table in the shared folder: lineage ends there, and a lost executor costs no recomputation. rows: that workers get at once."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/lagwise/{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"
    with batches_of(spark, rows):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def fold(modulus: int, column: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo modulus; a null id counts as an empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % modulus


#: Bits of a filter of keys (8 MB, whatever the number of keys), and bits in each row of its table.
FILTER_BITS, _CELL = 1 << 26, 32768


def key_filter(keys: DataFrame, key: str, bits: int = FILTER_BITS) -> DataFrame:
    """A Bloom filter of the column key with two hashes, as a table of bitmaps (cell, bitmap): at most bits / 8 bytes in all."""
    at = F.explode(F.array(*_positions(F.col(key), bits))).alias("at")
    rows = keys.select(at).select(F.expr(f"at div {_CELL}").alias("cell"), (F.col("at") % _CELL).alias("at"))
    return rows.groupBy("cell").agg(F.bitmap_construct_agg("at").alias("bitmap"))


def _positions(key: Column, bits: int) -> list[Column]:
    return [F.pmod(F.xxhash64(F.lit(i), key), F.lit(bits)) for i in range(2)]


def among(df: DataFrame, keys: DataFrame, key: str, bits: int = FILTER_BITS) -> DataFrame:
    """The rows of df whose key is in keys, at any size alike: what the filter of the keys can rule out is never shuffled, the rest is joined."""
    cells, names, out = key_filter(keys, key, bits), df.columns, df
    for i, position in enumerate(_positions(F.col(key), bits)):
        at, cell, bitmap = (f"_{i}_{n}" for n in ("at", "cell", "bitmap"))
        side = cells.select(F.col("cell").alias(cell), F.col("bitmap").alias(bitmap))
        out = out.withColumn(at, position).join(F.broadcast(side), F.expr(f"{at} div {_CELL} = {cell}"))
        byte = F.conv(F.hex(F.substring(F.col(bitmap), F.expr(f"cast({at} % {_CELL} div 8 + 1 as int)"), F.lit(1))), 16, 10).cast("int")
        out = out.where(F.expr(f"1 << cast({at} % 8 as int)").bitwiseAND(byte) != 0).select(*names)
    return out.join(keys.select(key).distinct(), key, "left_semi").select(*names)


def without(df: DataFrame, keys: DataFrame, key: str, bits: int = FILTER_BITS) -> DataFrame:
    """The rows of df whose key isn't in keys (neither has null keys), at any size alike: what the filter of the keys rules out stays and is never shuffled,
    the rest is joined. df is read twice."""
    cells, names, seen = key_filter(keys, key, bits), df.columns, unused(df, "seen")
    at, cell, bitmap = (unused(df, f"{seen}_{n}") for n in ("at", "cell", "bitmap"))
    out = df.withColumn(seen, F.lit(True))
    for position in _positions(F.col(key), bits):
        side = cells.select(F.col("cell").alias(cell), F.col("bitmap").alias(bitmap))
        out = out.withColumn(at, position).join(F.broadcast(side), F.expr(f"{at} div {_CELL} = {cell}"), "left")
        byte = F.conv(F.hex(F.substring(F.col(bitmap), F.expr(f"cast({at} % {_CELL} div 8 + 1 as int)"), F.lit(1))), 16, 10).cast("int")
        here = F.coalesce(F.expr(f"1 << cast({at} % 8 as int)").bitwiseAND(byte) != 0, F.lit(False))
        out = out.withColumn(seen, F.col(seen) & here).select(*names, seen)
    stay = out.where(~F.col(seen)).select(*names)
    return stay.unionByName(out.where(seen).select(*names).join(keys.select(key).distinct(), key, "left_anti").select(*names))


def unused(df: DataFrame, name: str) -> str:
    """A column name like name that df doesn't have."""
    while name in df.columns:
        name = f"_{name}"
    return name


def slices(batches: Iterator[pa.RecordBatch], rows: int = SLICE) -> Iterator[dict[str, list]]:
    """The batches as Python lists by column, few rows at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            part = batch.slice(at, rows)
            yield {n: part.column(i).to_pylist() for i, n in enumerate(part.schema.names)}


def shuffle_parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
