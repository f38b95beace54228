"""Places and running sums in a total order, without gathering the rows in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .checkpoints import shared_folder


def numbered(df: DataFrame, order: list[Column], to: str = "place", sums: dict[str, str] | None = None, parts: int | None = None, few: int = 20_000) -> DataFrame:
    """`df` with each row's place in the order, from 0, and for each column: name in `sums` the sum of it over the rows before.

    Rows are sorted in ranges, whose sampled bounds follow the data; a row's place is that in its range and the
    rows of the ranges before. Up to `few` rows are one window instead. Equal rows may take each other's place. `df` runs
    more than once, so it should be materialised.
    """
    sums = sums or {}
    before = (Window.unboundedPreceding, -1)
    if few and df.limit(few + 1).count() <= few:
        whole = Window.orderBy(*order)
        out = df.withColumn(to, F.row_number().over(whole).cast("long") - 1)
        return out.withColumns({name: F.coalesce(F.sum(c).over(whole.rowsBetween(*before)), F.lit(0)) for c, name in sums.items()})
    spark = df.sparkSession
    shared_folder(spark)
    ranges = df.repartitionByRange(parts or int(spark.conf.get("spark.sql.shuffle.partitions")), *order).sortWithinPartitions(*order)
    # the number's high bits are the range, its low 33 bits the place in it; the checkpoint fixes both
    ranges = ranges.withColumn("_m", F.monotonically_increasing_id()).checkpoint()
    ranges = ranges.withColumn("_range", F.call_function("shiftright", "_m", F.lit(33)))
    totals = ranges.groupBy("_range").agg(F.count("*").alias("_rows"), *[F.sum(c).alias(f"_sum_{name}") for c, name in sums.items()])
    run = Window.orderBy("_range").rowsBetween(*before)  # one row a range
    starts = totals.select("_range", *[F.coalesce(F.sum(c).over(run), F.lit(0)).alias(c) for c in totals.columns[1:]])
    if sums:
        inside = Window.partitionBy("_range").orderBy("_m").rowsBetween(*before)
        ranges = ranges.withColumns({name: F.coalesce(F.sum(c).over(inside), F.lit(0)) for c, name in sums.items()})
    met = ranges.join(F.broadcast(starts.checkpoint()), "_range")
    met = met.withColumn(to, F.col("_rows") + F.col("_m").bitwiseAND(F.lit((1 << 33) - 1)))
    met = met.withColumns({name: F.col(name) + F.col(f"_sum_{name}") for name in sums.values()})
    return met.select(*[F.col(f"`{c}`") for c in df.columns], to, *sums.values())
