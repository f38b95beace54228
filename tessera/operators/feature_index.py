"""The feature index on disk: built once, asked often, changed by adding to the buckets that a change meets.

Three tables by hash buckets: an entity's features, a feature's entities, and how many entities have a feature. Every change is a
commit of signed rows: +1 for what is new, -1 for what is gone; reading adds them up. A question reads only the buckets of its
anchors and of their features.
"""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import commits, retrieval
from .checkpoints import delete, settled

BUCKETS = 16
#: Files of a bucket, at least; the rows of one key lie in all of them.
SPREAD = 4
#: Rows of a file, about: a bucket has as many files as its rows ask for, so that a task's rows do not grow with the table.
FILE_ROWS = 1_000_000


def bucket(column: Column | str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(column), F.lit(buckets)).cast("int")


def _table(spark: SparkSession, state: list[dict], name: str, buckets: list[int]) -> DataFrame:
    """The signed rows of a table, in these buckets only: no other folder is listed or read."""
    schema = T.StructType.fromJson(json.loads(state[0]["schemas"])[name])
    paths = [f"{said['folder']}/{name}/bucket={b}" for said in state for b in sorted({*buckets} & {*said["touched"][name]})]
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def _net(rows: DataFrame, count: str, state: list[dict]) -> DataFrame:
    """Signed rows added up; those that are gone left out. The rows of a single commit are what they are."""
    keys = [c for c in rows.columns if c != count]
    if len(state) == 1:
        return rows.select(*keys, count)
    return rows.groupBy(*keys).agg(F.sum(count).alias(count)).filter(F.col(count) > 0)


def _buckets_of(rows: DataFrame, column: str, buckets: int) -> list[int]:
    """The buckets of a column's values: as many numbers as there are buckets, at most."""
    return [r.b for r in rows.select(bucket(column, buckets).alias("b")).distinct().collect()]


def update_index(spark: SparkSession, path: str, features: DataFrame, entities: DataFrame, buckets: int = BUCKETS, tries: int = 50, unique: bool = False) -> list[int]:
    """Store the features (entity_id, feature_id, axis, ...) of the given entities (entity_id) in place of those they had, if any.

    An entity without features counts too. unique: the features have an entity and feature in one row at most. Returns the buckets of postings that were added to. Two writers may race: the slower
    one takes what is stored then into account and writes anew.
    """
    given = settled(entities.select("entity_id").distinct())
    rows = features.join(given, "entity_id", "left_semi")
    rows = settled((rows if unique else rows.dropDuplicates(["entity_id", "feature_id"])).withColumn("sign", F.lit(1).cast("long")))
    for _ in range(tries):
        state = commits.committed(spark, path)
        buckets = state[0]["buckets"] if state else buckets
        changes, members = rows, given
        if state:
            mine = _buckets_of(given, "entity_id", buckets)
            old = _net(_table(spark, state, "entities", mine), "sign", state).join(given, "entity_id", "left_semi")
            changes = rows.unionByName(old.withColumn("sign", -F.col("sign")))
            keys = [c for c in changes.columns if c != "sign"]
            changes = changes.groupBy(*keys).agg(F.sum("sign").alias("sign")).filter("sign <> 0")
            members = given.join(_table(spark, state, "members", mine), "entity_id", "left_anti")
            changes = settled(changes)
        folder = commits.new_folder(path)
        made = {
            "members": (members, "entity_id"), "entities": (changes, "entity_id"), "postings": (changes, "feature_id"),
            "frequency": (settled(changes.groupBy("feature_id", "axis").agg(F.sum("sign").alias("df")).filter("df <> 0")), "feature_id"),
        }
        schemas, touched = {}, {}
        spread = max(SPREAD, -(-changes.count() // (FILE_ROWS * buckets)))
        for name, (table, key) in made.items():
            schemas[name] = table.schema.jsonValue()
            touched[name] = sorted(_buckets_of(table, key, buckets))
            # the rows of a frequent feature, or of an entity with very many, go to several files of their bucket
            other = {"postings": "entity_id", "entities": "feature_id"}.get(name)
            files = [F.pmod(F.xxhash64(other), F.lit(spread))] if other else []
            placed = table.withColumn("bucket", bucket(key, buckets)).repartition(buckets * spread if other else buckets, "bucket", *files)
            placed.sortWithinPartitions("bucket", key).write.partitionBy("bucket").parquet(f"{folder}/{name}")
        said = {"folder": folder, "buckets": buckets, "entities": members.count(), "schemas": json.dumps(schemas), "touched": touched}
        if commits.commit(spark, path, commits.next_number(state), said):
            return touched["postings"]
        delete(spark, folder)
    raise RuntimeError(f"{tries} times another writer was faster at {path}")


def build_index(spark: SparkSession, path: str, features: DataFrame, entities: DataFrame, buckets: int = BUCKETS, unique: bool = False) -> None:
    """Store an index where there is none (unique: as update_index() has it)."""
    if commits.committed(spark, path):
        raise ValueError(f"there is an index at {path}")
    update_index(spark, path, features, entities, buckets, unique=unique)


def near(spark: SparkSession, path: str, anchors: DataFrame, ceiling: float = retrieval.CEILING) -> tuple[DataFrame, DataFrame]:
    """What retrieval.pruned() gives of the anchors' (entity_id) features: the anchors' own rows, and all rows of those features."""
    state = commits.committed(spark, path)
    if not state:
        raise ValueError(f"there is no index at {path}")
    buckets, n = state[0]["buckets"], sum(s["entities"] for s in state)
    own = _net(_table(spark, state, "entities", _buckets_of(anchors, "entity_id", buckets)), "sign", state)
    own = own.join(anchors.select("entity_id").distinct(), "entity_id", "left_semi").drop("sign").persist()
    asked = own.select("feature_id").distinct()
    mine = _buckets_of(asked, "feature_id", buckets)
    frequency = _table(spark, state, "frequency", mine).join(asked, "feature_id", "left_semi")
    frequency = frequency.groupBy("feature_id").agg(F.sum("df").alias("df")).withColumn("n", F.lit(n).cast("long"))
    usable = retrieval.retrievable(frequency, ceiling).select("feature_id", "df", retrieval.information(F.col("df"), F.col("n")).alias("ic")).persist()
    usable.count()  # its size is known then, so that few anchors' features go to the postings and not these to them
    postings = _table(spark, state, "postings", mine).join(usable, "feature_id")
    keys = [c for c in postings.columns if c != "sign"]
    if len(state) > 1:
        postings = postings.groupBy(*keys).agg(F.sum("sign").alias("sign")).filter("sign > 0")
    return own.join(usable, "feature_id"), postings.select(*keys)


def neighbours(spark: SparkSession, path: str, anchors: DataFrame, limit: int = 25, least_axes: int = 1, ceiling: float = retrieval.CEILING) -> DataFrame:
    """retrieval.candidates() of the anchors (entity_id), from the stored index."""
    left, right = near(spark, path, anchors, ceiling)
    same = (F.col("a.feature_id") == F.col("b.feature_id")) & (F.col("a.entity_id") != F.col("b.entity_id"))
    met = left.alias("a").join(right.alias("b"), same)
    scores = met.groupBy(F.col("a.entity_id").alias("l"), F.col("b.entity_id").alias("r"), F.col("a.axis").alias("axis"))
    scores = scores.agg(F.sum("a.ic").cast(retrieval.IC).alias("ic"), F.count("*").alias("shared"))
    return retrieval.candidates(scores, limit, least_axes)
