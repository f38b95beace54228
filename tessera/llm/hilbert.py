"""Sharding along a Hilbert curve.

Several metadata dimensions are quantised to a few bits each; a row's place on the Hilbert curve
through that grid is its sort key, and consecutive runs of the order become the shards. Rows that are
near in all dimensions are near on the curve, so each shard spans small ranges of every dimension and
readers can skip files by any of them.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from ..operators.ordered import numbered
from .common import materialize, small


def curve_index(points: np.ndarray, bits: int) -> np.ndarray:
    """Places on the Hilbert curve of integer points (rows x dimensions, each below 2^bits).

    Walks the grid's levels from coarse to fine and undoes the turn and mirroring of each
    subcube (J. Skilling, "Programming the Hilbert curve", 2004); dimensions * bits must be below 64.
    """
    x = points.astype(np.uint64).T.copy()
    dims = len(x)
    one = np.uint64(1)
    for level in range(bits - 1, 0, -1):
        bit = one << np.uint64(level)
        low = bit - one
        for d in range(dims):
            mirrored = (x[d] & bit) != 0
            swap = np.where(mirrored, np.uint64(0), (x[0] ^ x[d]) & low)
            x[0] ^= np.where(mirrored, low, swap)
            x[d] ^= swap
    for d in range(1, dims):
        x[d] ^= x[d - 1]
    turn = np.zeros(x.shape[1], np.uint64)
    for level in range(bits - 1, 0, -1):
        bit = one << np.uint64(level)
        turn ^= np.where((x[dims - 1] & bit) != 0, bit - one, np.uint64(0))
    x ^= turn
    index = np.zeros(x.shape[1], np.uint64)
    for level in range(bits - 1, -1, -1):
        for d in range(dims):
            index = (index << one) | ((x[d] >> np.uint64(level)) & one)
    return index.astype(np.int64)


def hilbert(bits: int, *dimensions: Column) -> Column:
    """The curve index of integer columns; values are clipped to [0, 2^bits), null counts as 0."""

    @pandas_udf("long")
    def index(*columns: pd.Series) -> pd.Series:
        points = np.stack([c.fillna(0).to_numpy(np.int64).clip(0, (1 << bits) - 1) for c in columns], axis=1)
        return pd.Series(curve_index(points, bits))

    return index(*dimensions)


def ranked(df: DataFrame, column: str, to: str, bits: int, most: int = 50_000, few: int = 20_000) -> DataFrame:
    """Append the rank of a value among the column's distinct ones, spread over 2^bits steps; null first."""
    values = materialize(df.select(F.col(column).alias("value")).distinct())
    codes = numbered(values, [F.col("value").asc_nulls_first()], few=few)
    code = F.expr(f"(place * {1 << bits}L) div {max(1, values.count())}L").cast("int")
    codes = small(materialize(codes.select("value", code.alias(to))), most)
    return df.join(codes, df[column].eqNullSafe(codes["value"]), "left").drop("value")


def hilbert_shards(
    docs: DataFrame,
    shards: int = 16,
    text: str = "text",
    doc_id: str = "doc_id",
    categories: tuple[str, ...] = ("source", "lang"),
    bits: int = 10,
    partitions: int | None = None,
    carry: bool = False,
    few: int = 20_000,
) -> DataFrame:
    """doc_id, size, text_crc32, the dimensions, curve, shard and slot of each row, under the law of rows.

    Dimensions: the categories' ranks, the size on a log scale and the id over its range, `bits` bits each. The
    order is (curve, hash of the id, id, size, checksum); shard s takes the places from ceil(s * n / shards),
    so counts differ by one at most, and slots count from 0 in each shard. A null text has size 1 (no
    bytes, plus 1) and checksum 0; null categories and ids are values that sort first. Equal rows may take each
    other's place, which no result shows. Fewer rows than shards leave shards empty.

    carry: hand on the categories (c0, c1..) and the row itself too, as a struct `row`.

    Places come from one range partitioning, whose sampled bounds follow the data, and the row counts of its parts; a table
    of up to `few` rows, or a category with as few values, is ordered in one task.
    """
    n_parts = partitions or max(shards, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    table = docs.select(
        F.col(f"`{doc_id}`").cast("long").alias("doc_id"),
        (F.coalesce(F.octet_length(F.col(f"`{text}`")), F.lit(0)).cast("long") + 1).alias("size"),
        F.crc32(F.coalesce(F.col(f"`{text}`"), F.lit("")).cast("binary")).alias("text_crc32"),
        *[F.col(f"`{c}`").cast("string").alias(f"c{i}") for i, c in enumerate(categories)],
        *([F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")] if carry else []),
    )
    handed = [*[f"c{i}" for i in range(len(categories))], "row"] if carry else []
    table = materialize(table)
    ends = table.agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"), F.count("*").alias("n")).first()
    first_id, last_id, total = ends["first"] or 0, ends["last"] or 0, ends["n"]
    for i in range(len(categories)):
        table = ranked(table, f"c{i}", f"d{i}", bits, few=few)
    steps = 1 << bits
    table = table.withColumn("d_size", F.least(F.lit(steps - 1), F.floor(F.log2("size") * F.lit(steps / 32))).cast("int"))
    table = table.withColumn("d_id", F.coalesce(F.floor((F.col("doc_id") - F.lit(first_id)) / F.lit(float(max(1, last_id - first_id))) * (steps - 1)), F.lit(0)).cast("int"))
    dimensions = [f"d{i}" for i in range(len(categories))] + ["d_size", "d_id"]
    table = table.withColumn("curve", hilbert(bits, *map(F.col, dimensions)))
    # the sorting samples its input first, so the curve is computed before
    table = materialize(table.withColumn("spread", F.xxhash64("doc_id")))
    order = [F.col(c).asc_nulls_first() for c in ("curve", "spread", "doc_id", "size", "text_crc32")]
    placed = numbered(table, order, "place", parts=n_parts, few=few)
    # integer arithmetic: place * shards stays far below 2^63
    placed = placed.withColumn("shard", F.expr(f"(place * {shards}L) div {max(1, total)}L").cast("int"))
    begin = F.expr(f"(shard * {total}L + {shards - 1}L) div {shards}L")
    return placed.withColumn("slot", F.col("place") - begin).select("doc_id", "size", "text_crc32", *dimensions, "curve", "shard", "slot", *handed)


def write_shards(docs: DataFrame, path: str, shards: int = 16, text: str = "text", doc_id: str = "doc_id", categories: tuple[str, ...] = ("source", "lang")) -> None:
    """Write the rows, with all their columns, to one set of Parquet files a shard, and to `path`/ranges each shard's least
    and greatest value (nulls aside) of every dimension: doc_id, size and the categories by place (c0, c1..)."""
    placed = hilbert_shards(docs, shards, text, doc_id, categories, carry=True)
    names = ["doc_id", "size", *[f"c{i}" for i in range(len(categories))]]
    parts = max(shards, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    files = placed.select("shard", "slot", *names, "row").repartitionByRange(parts, "shard", "slot").sortWithinPartitions("shard", "slot")
    files.write.partitionBy("shard").parquet(f"{path}/rows")
    docs.sparkSession.createDataFrame([], files.schema).write.parquet(f"{path}/columns")  # a table without rows has no files
    written = docs.sparkSession.read.schema(files.schema).parquet(f"{path}/rows")
    ends = [f(n).alias(f"{end}_{n}") for n in names for end, f in (("least", F.min), ("most", F.max))]
    written.groupBy("shard").agg(F.count("*").alias("n"), *ends).coalesce(1).write.parquet(f"{path}/ranges")


def read_shards(spark: SparkSession, path: str, **within: tuple) -> DataFrame:
    """The rows of write_shards() whose dimensions lie `within` (least, greatest), each by its name there; null is in no range.

    Only files of shards whose ranges meet all of these are read.
    """
    ranges = spark.read.parquet(f"{path}/ranges")
    for name, (low, high) in within.items():
        ranges = ranges.filter((F.col(f"most_{name}") >= F.lit(low)) & (F.col(f"least_{name}") <= F.lit(high)))
    met = [r.shard for r in ranges.select("shard").collect()]  # at most one each shard
    columns = spark.read.parquet(f"{path}/columns")
    rows = spark.read.schema(columns.schema).option("basePath", f"{path}/rows").parquet(*[f"{path}/rows/shard={s}" for s in met]) if met else columns
    for name, (low, high) in within.items():
        rows = rows.filter(F.col(name).between(F.lit(low), F.lit(high)))
    return rows.select("row.*")
