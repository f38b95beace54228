"""Helpers shared by the corpus operators: checkpoints, bounded broadcasts, Arrow mapping."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.checkpoints import shared_folder

#: A word of the query contracts: a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def materialize(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint, so that later jobs neither recompute it nor depend on one executor."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def small(df: DataFrame, max_rows: int) -> DataFrame:
    """`df` with a broadcast hint if it has at most `max_rows` rows; as it is, for a shuffled join, if it has more.

    Counting runs `df`, so it should be cheap or materialised.
    """
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df


def maybe_in(df: DataFrame, key: str, keys: DataFrame, flag: str, most_bits: int = 30) -> DataFrame:
    """`df` with the boolean column `flag`: false only where `key` is surely not among the values of `keys`' column of that name.

    A power of two of 8 to 16 bits for each value, 2^most_bits at most, in bitmaps of 4 KB: 128 MB are broadcast at most,
    however many keys there are. Beyond 10^8 keys more rows are let through, none is lost. It keeps long rows that a join
    would not match out of its shuffle. Counting runs `keys`, so it should be materialised.
    """
    bits = max(15, min(most_bits, (8 * keys.count()).bit_length()))
    place = F.pmod(F.xxhash64(key), F.lit(1 << bits))
    bucket, bit = F.call_function("shiftright", place, F.lit(15)).cast("int"), place % (1 << 15)
    maps = keys.select(bucket.alias("_bucket"), bit.alias("_bit")).groupBy("_bucket").agg(F.bitmap_construct_agg("_bit").alias("_map"))
    met = df.withColumn("_of", bucket).withColumn("_bit", bit).join(F.broadcast(materialize(maps)), F.col("_of") == F.col("_bucket"), "left")
    byte = F.conv(F.hex(F.substring(F.col("_map"), (F.col("_bit") / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    found = F.call_function("shiftright", byte, (F.col("_bit") % 8).cast("int")).bitwiseAND(F.lit(1)) == 1
    return met.withColumn(flag, F.coalesce(found, F.lit(False))).drop("_of", "_bit", "_bucket", "_map")


def utf8(column: str | Column) -> Column:
    """A text column as UTF-8 bytes; null is empty."""
    column = F.col(column) if isinstance(column, str) else column
    return F.coalesce(column.cast("string"), F.lit("")).cast("binary")


def ascii_lower(column: str | Column) -> Column:
    """Lower-case A-Z and nothing else."""
    return F.translate(column, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def fresh(df: DataFrame, name: str) -> str:
    """`name`, with underscores before it while `df` has such a column (in any letter case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def with_results(
    df: DataFrame,
    inputs: list[Column],
    results: str,
    compute: Callable[[], Callable[[list[list]], list[list]]],
    keep: list[str] | None = None,
    batch_bytes: int = 4 << 20,
) -> DataFrame:
    """Append the columns of the DDL string `results`, computed in Arrow batches from the `inputs` columns.

    compute() is called once a task and gives a function from lists of input values to lists of
    result values; it sees at most about `batch_bytes` of its first input at a time, a longer row by itself.
    keep: the columns of `df` to hand on, all by default. Columns of `df` that have a result's name give way.
    """
    schema = T._parse_datatype_string(results)
    made = {f.name.lower() for f in schema.fields}
    # by place, as names may differ in their case alone
    places = [i for i, f in enumerate(df.schema.fields) if f.name.lower() not in made and (keep is None or f.name in keep)]
    handed = [df.schema.fields[i] for i in places]
    n, m = len(handed), len(inputs)
    whole = df.select("*", *inputs).toDF(*[f"c{i}" for i in range(len(df.columns))], *[f"i{i}" for i in range(m)])
    source = whole.select(*[F.col(f"c{p}").alias(f"k{i}") for i, p in enumerate(places)], *[f"i{i}" for i in range(m)])
    out = T.StructType([T.StructField(f"k{i}", f.dataType) for i, f in enumerate(handed)] + list(schema.fields))
    from pyspark.sql.pandas.types import to_arrow_schema

    kinds = [f.type for f in to_arrow_schema(schema)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        function = compute()
        for whole in batches:
            for batch in slices(whole, n, batch_bytes):
                rows = function([batch.column(n + i).to_pylist() for i in range(m)])
                columns = [pa.array(x, type=k) for x, k in zip(rows, kinds, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns[:n], *columns], names=[f"k{i}" for i in range(n)] + [f.name for f in schema.fields]
                )

    made_df = source.mapInArrow(run, out)
    return made_df.select(*[F.col(f"k{i}").alias(f.name) for i, f in enumerate(handed)], *[F.col(f"`{f.name}`") for f in schema.fields])


@contextmanager
def with_batches_of(spark: SparkSession, rows: int) -> Iterator[None]:
    """What is run inside hands at most `rows` rows to Python at once; the session's setting comes back after it."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    most = int(before)
    spark.conf.set(name, str(rows if most <= 0 else min(rows, most)))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def gathered(batches: Iterator[pa.RecordBatch], column: int, most: int) -> Iterator[pa.RecordBatch]:
    """Batches put together while their `column` holds at most `most` bytes."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        more = batch.column(column).nbytes
        if held and size + more > most:
            together, held, size = pa.Table.from_batches(held).combine_chunks().to_batches(), [], 0
            yield from together
            del together
        held.append(batch)
        size += more
        del batch
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


def pieces(batches: Iterator[pa.RecordBatch], column: int, most: int) -> Iterator[pa.RecordBatch]:
    """The slices of all batches; none is held while the next batch or what comes after a slice is made."""
    for batch in batches:
        cut = slices(batch, column, most)
        del batch
        yield from cut


def slices(batch: pa.RecordBatch, column: int, most: int) -> Iterator[pa.RecordBatch]:
    """`batch` in pieces whose `column` holds at most `most` bytes, or one row."""
    if batch.num_rows == 0:
        return
    if batch.column(column).nbytes <= most:
        yield batch
        return
    values = batch.column(column)
    texts = pa.types.is_binary(values.type) or pa.types.is_string(values.type) or pa.types.is_large_binary(values.type) or pa.types.is_large_string(values.type)
    # by offsets, as the values of a batch would be as many bytes again
    lengths = pc.fill_null(pc.binary_length(values), 8).to_pylist() if texts else [8] * len(values)
    start, size = 0, 0
    for i, length in enumerate(lengths):
        if i > start and size + length > most:
            yield batch.slice(start, i - start)
            start, size = i, 0
        size += length
    yield batch.slice(start)
