"""An append-only store of artifacts, reviews and lineage: no version changes once it is written, and writers may race."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import commits
from .checkpoints import delete, settled

ARTIFACTS = "object_id string, version string, object_type string, status string, hash string, payload string"
REVIEWS = "review_id string, target_id string, status string, version string, payload string"
LINEAGE = "parent_id string, child_id string, relationship string, evidence_ids array<string>"


def append_new(spark: SparkSession, path: str, rows: DataFrame, schema: str, key: list[str], content: str | None, tries: int = 50) -> DataFrame:
    """Append the rows whose key the table at `path` does not have; (key, content, outcome) of all: INSERTED, UNCHANGED or CONFLICT.

    A key that is stored, or comes more than once, with another `content` is a conflict: of several new ones, the least content is
    taken. Without `content` a stored key is unchanged whatever it holds. The rows are written first and then committed; a writer
    who finds its number taken reads again what is stored and decides anew, so equal rows of two writers are stored once.
    """
    columns = spark.createDataFrame([], schema).columns
    value = F.col(content) if content else F.lit("")
    given = settled(rows.select(*columns).withColumn("_content", value).dropDuplicates([*key, "_content"]))
    order = Window.partitionBy(*key).orderBy("_content", *[c for c in columns if c not in key])
    first = settled(given.withColumn("_n", F.row_number().over(order)))
    for _ in range(tries):
        state = commits.committed(spark, path)
        stored = spark.read.schema(schema).parquet(*commits.folders(state)) if state else spark.createDataFrame([], schema)
        stored = stored.select(*key, (F.col(content) if content else F.lit("")).alias("_stored"))
        met = first.join(stored, key, "left")
        same = F.when(F.col("_stored") == F.col("_content"), "UNCHANGED").otherwise("CONFLICT")
        told = settled(met.withColumn("outcome", F.when(F.col("_stored").isNotNull(), same).when(F.col("_n") == 1, "INSERTED").otherwise("CONFLICT")))
        out = told.select(*key, F.col("_content").alias("content"), "outcome")
        fresh = told.filter("outcome = 'INSERTED'").select(*columns)
        if not fresh.limit(1).count():
            return out
        folder = commits.new_folder(path)
        fresh.write.parquet(folder)
        if commits.commit(spark, path, commits.next_number(state), {"folder": folder}):
            return out
        delete(spark, folder)
    raise RuntimeError(f"{tries} times another writer was faster at {path}")


def save_artifacts(spark: SparkSession, path: str, rows: DataFrame) -> DataFrame:
    """Store artifact versions: rows (object_id, version, object_type, status, payload); payloads are told apart by their hash."""
    hashed = rows.withColumn("hash", F.sha2(F.col("payload").cast("binary"), 256))
    return append_new(spark, path, hashed, ARTIFACTS, ["object_id", "version"], "hash")


def append_reviews(spark: SparkSession, path: str, rows: DataFrame) -> DataFrame:
    """Store reviews; a review_id that is stored already is a CONFLICT unless its payload is the same."""
    return append_new(spark, path, rows, REVIEWS, ["review_id"], "payload")


def add_lineage(spark: SparkSession, path: str, rows: DataFrame) -> DataFrame:
    """Store links between artifacts; one that is there already stays as it is."""
    return append_new(spark, path, rows, LINEAGE, ["parent_id", "child_id", "relationship"], None)


def load(spark: SparkSession, path: str, schema: str, **wanted: str) -> DataFrame:
    """Stored rows, those with the wanted values only."""
    rows = commits.read(spark, path, schema)
    for column, value in wanted.items():
        rows = rows.filter(F.col(column) == F.lit(value))
    return rows


def parents(lineage: DataFrame, of: DataFrame) -> DataFrame:
    """(child_id, parent_id, relationship): what the artifacts `of` (child_id) come from directly, each link once."""
    asked = of.select("child_id").distinct()
    return lineage.select("child_id", "parent_id", "relationship").distinct().join(asked, "child_id", "left_semi")


def ancestors(lineage: DataFrame, of: DataFrame) -> DataFrame:
    """(child_id, ancestor_id, steps): whatever the artifacts `of` (child_id) come from, by the fewest links, however many."""
    links = lineage.select(F.col("child_id").alias("at"), F.col("parent_id").alias("up")).distinct()
    found = settled(of.select("child_id", F.col("child_id").alias("ancestor_id"), F.lit(0).alias("steps")).distinct())
    edge, steps = found, 0
    while edge.limit(1).count():
        steps += 1
        onward = edge.join(links, F.col("ancestor_id") == F.col("at")).select("child_id", F.col("up").alias("ancestor_id")).distinct()
        edge = settled(onward.join(found, ["child_id", "ancestor_id"], "left_anti").withColumn("steps", F.lit(steps)))
        found = settled(found.unionByName(edge))
    return found.filter("steps > 0")
