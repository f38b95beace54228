"""Content-addressed storage, snapshots, projection, agreement and search."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def save_outcomes(writes: DataFrame) -> DataFrame:
    """writes (object_id, version, hash, ord) -> outcome: the first of a key is INSERTED, equal ones UNCHANGED, others CONFLICT."""
    order = Window.partitionBy("object_id", "version").orderBy("ord")
    first = F.first("hash").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    outcome = F.when(F.row_number().over(order) == 1, "INSERTED").when(F.col("hash") == first, "UNCHANGED").otherwise("CONFLICT")
    return writes.withColumn("outcome", outcome)


def insert_if_absent(existing: DataFrame, new: DataFrame) -> DataFrame:
    """The rows of `new` (object_id, version, hash) to append; a key stored with another hash raises."""
    key = ["object_id", "version"]
    stored = existing.select(*key, F.col("hash").alias("stored"))
    conflicts = new.join(stored, key).filter("hash <> stored")
    if conflicts.limit(1).count():
        raise ValueError("an artifact of the same id and version is stored with other content")
    return new.join(stored, key, "left_anti")


def snapshots(rows: DataFrame, request: str, order: str) -> DataFrame:
    """(request_key, first, copies): requests by the SHA-256 of their content."""
    return rows.groupBy(F.sha2(F.col(request), 256).alias("request_key")).agg(F.min(order).alias("first"), F.count("*").alias("copies"))


def fetch(requests: DataFrame, cache: DataFrame) -> DataFrame:
    """requests (url, post_json) -> body from the cache (request_key, body); a miss is a row with an error, as no network is asked."""
    key = F.sha2(F.concat_ws("\n", "url", "post_json"), 256)
    met = requests.withColumn("request_key", key).join(cache.select("request_key", "body"), "request_key", "left")
    return met.withColumn("error", F.when(F.col("body").isNull(), "not in the snapshot store"))


def last_nodes(nodes: DataFrame) -> DataFrame:
    """One node an id, the last one by ord."""
    order = Window.partitionBy("id").orderBy(F.desc("ord"))
    return nodes.withColumn("_n", F.row_number().over(order)).filter("_n = 1").drop("_n")


def dangling(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges (start_id, end_id) with an end that is no node; each edge once."""
    known = nodes.select("id").distinct()
    starts = known.select(F.col("id").alias("start_id"), F.lit(True).alias("_s"))
    ends = known.select(F.col("id").alias("end_id"), F.lit(True).alias("_e"))
    return edges.join(starts, "start_id", "left").join(ends, "end_id", "left").filter("_s is null or _e is null").drop("_s", "_e")


#: How strong a status is.
STRENGTH = {"INSUFFICIENT_EVIDENCE": 0, "CONTRADICTED": 0, "PARTIALLY_SUPPORTED": 1, "CONTEXT_DEPENDENT": 1, "SUPPORTED": 2}


def agreement(answers: DataFrame) -> DataFrame:
    """answers (engine, reviewer) -> one row: adjudicated, agreed, rate, and where the engine reads stronger or weaker. Blank reviews are skipped."""
    strength = F.create_map(*[F.lit(x) for kv in STRENGTH.items() for x in kv])
    e, r = strength[F.col("engine")], strength[F.col("reviewer")]
    rows = answers.filter(F.coalesce("reviewer", F.lit("")) != "")
    return rows.agg(
        F.count("*").alias("adjudicated"), F.count_if(F.col("engine") == F.col("reviewer")).alias("agreed"), F.round(F.count_if(F.col("engine") == F.col("reviewer")) / F.count("*"), 3).alias("rate"),
        F.count_if(e > r).alias("stronger"), F.count_if(e < r).alias("weaker"),
    )


def disagreements(answers: DataFrame) -> DataFrame:
    """answers (engine, reviewer, rule) -> (rule, n): how often reviewers disagree with what each rule gave, the rules that they never
    disagree with left out; blank reviews are skipped."""
    rows = answers.filter((F.coalesce("reviewer", F.lit("")) != "") & ~F.col("engine").eqNullSafe(F.col("reviewer")))
    return rows.groupBy("rule").agg(F.count("*").alias("n"))


def search(rows: DataFrame, name: str, key: str, query: str, limit: int = 12) -> DataFrame:
    """The best `limit` names for a query of 2 letters or more: exact, prefix, word prefix, inside; those without a case of their own first."""
    if len(query.strip()) < 2:
        return rows.limit(0).withColumn("place", F.lit(0))
    low, q = F.lower(name), query.strip().lower()
    match = F.when(low == q, 4).when(F.startswith(low, F.lit(q)), 3).when(F.contains(low, F.lit(" " + q)), 2).when(F.contains(low, F.lit(q)), 1)
    scored = rows.withColumn("_m", match).filter("_m is not null").withColumn("_s", F.col("_m") * 2 + F.when(F.col("has_case"), 0).otherwise(1))
    best = scored.orderBy(F.desc("_s"), low, key).limit(limit)  # a top-k, so that only `limit` rows are numbered
    return best.withColumn("place", F.row_number().over(Window.orderBy(F.desc("_s"), low, key))).drop("_m", "_s")


SCHEMA_VERSION = 1


def check_schema(stored: DataFrame) -> None:
    """stored (version): one row with this version; anything else raises."""
    versions = [r.version for r in stored.select("version").distinct().limit(2).collect()]
    if versions != [SCHEMA_VERSION]:
        raise ValueError(f"the store has schema {versions}, this is {SCHEMA_VERSION}")


def score(worksheet: DataFrame, key: DataFrame, responses: DataFrame) -> DataFrame:
    """worksheet (item_id, hash), key (item_id, engine, rule, hash), responses (item_id, hash, verdict) -> (item_id, engine, reviewer, rule).

    Blank verdicts are left out. A response to an item that is not on the worksheet, or to another text of it, raises.
    """
    given = responses.filter("coalesce(trim(verdict), '') <> ''").select("item_id", F.col("hash").alias("seen"), F.col("verdict").alias("reviewer"))
    met = given.join(worksheet.select("item_id", F.col("hash").alias("asked")), "item_id", "left").join(key.select("item_id", "engine", "rule", F.col("hash").alias("kept")), "item_id", "left")
    wrong = met.filter("asked is null or kept is null or seen <> asked or kept <> asked").limit(5).collect()
    if wrong:
        raise ValueError(f"responses to unknown or changed items: {', '.join(str(r.item_id) for r in wrong)}")
    return met.select("item_id", "engine", "reviewer", "rule")
