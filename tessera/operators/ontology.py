"""Ontology operators: canonical terms, ancestor closure, information content and similarity.

Tables: term (term_id, obsolete, replaced_by), isa (child, parent), alt (alt_id, term_id), annotation (entity_id, term_id).
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .checkpoints import settled
from .ordered import numbered

INFORMATIVE = 0.05


def canonical(ids: DataFrame, terms: DataFrame, alts: DataFrame, column: str = "term_id") -> DataFrame:
    """Add `canonical`: alternative ids become primary, obsolete ones their replacement if that exists, unknown ones null."""
    known = terms.select(F.col("term_id").alias("_t"), "obsolete", "replaced_by")
    exists = terms.select(F.col("term_id").alias("_r"))
    met = ids.join(alts.select(F.col("alt_id").alias("_a"), F.col("term_id").alias("_p")), F.col(column) == F.col("_a"), "left")
    met = met.withColumn("_id", F.coalesce("_p", column)).join(known, F.col("_id") == F.col("_t"), "left").join(exists, F.col("replaced_by") == F.col("_r"), "left")
    out = F.when(F.col("_t").isNull(), F.lit(None)).when(F.col("obsolete"), F.col("_r")).otherwise(F.col("_t"))
    return met.withColumn("canonical", out).drop("_a", "_p", "_id", "_t", "_r", "obsolete", "replaced_by")


def closure(terms: DataFrame, isa: DataFrame) -> DataFrame:
    """(term_id, ancestor), each term its own ancestor too; parents that are no terms vanish, cycles end.

    Each round doubles the paths' length: the closure is joined with itself until nothing new comes.
    """
    known = isa.join(terms.select(F.col("term_id").alias("parent")), "parent", "left_semi").join(terms.select(F.col("term_id").alias("child")), "child", "left_semi")
    pairs = terms.select("term_id", F.col("term_id").alias("ancestor")).unionAll(known.select("child", "parent")).distinct()
    pairs = settled(pairs)
    count, before = pairs.count(), -1
    while count != before:
        a, b = pairs.alias("a"), pairs.alias("b")
        pairs = settled(a.join(b, F.col("a.ancestor") == F.col("b.term_id")).select("a.term_id", "b.ancestor").distinct(), pairs)
        count, before = pairs.count(), count
    return pairs


def closure_information(annotations: DataFrame, closed: DataFrame) -> DataFrame:
    """(term_id, n, ic): entities annotated with the term or a descendant; -ln of their share, to 6 places."""
    total = annotations.select("entity_id").distinct().agg(F.count("*").alias("total"))
    # an entity's ancestors are one array, told apart in its row, so that no task holds a row for each
    above = closed.groupBy("term_id").agg(F.collect_list("ancestor").alias("above"))
    sets = annotations.select("entity_id", "term_id").join(above, "term_id").groupBy("entity_id").agg(F.array_distinct(F.flatten(F.collect_list("above"))).alias("all"))
    reach = sets.select(F.explode("all").alias("term_id"))
    counts = reach.groupBy("term_id").agg(F.count("*").alias("n")).crossJoin(F.broadcast(total))
    return counts.select("term_id", "n", F.round(-F.ln(F.col("n") / F.col("total")), 6).alias("ic"))


def _lineages(closed: DataFrame, information: DataFrame) -> DataFrame:
    """(term_id, above, own): a term's ancestors as (key, ancestor), and its own content in millionths.

    A key holds the content in its upper bits and the ancestor's place by id in the lower 32, so the greatest key that two terms have in
    common is that of their most informative common ancestor, the larger id on ties. An ancestor that no entity has counts 0.
    """
    units = F.coalesce(F.round(F.col("ic") * 1_000_000).cast("long"), F.lit(0).cast("long"))
    ids = numbered(settled(closed.select("ancestor").distinct()), [F.asc("ancestor")], "at")
    keys = ids.join(information.select(F.col("term_id").alias("ancestor"), "ic"), "ancestor", "left").select("ancestor", units.alias("units"), (F.shiftleft(units, 32) + F.col("at")).alias("key"))
    rows = closed.join(keys, "ancestor").groupBy("term_id")
    return settled(rows.agg(F.collect_list(F.struct("key", "ancestor")).alias("above"), F.max(F.when(F.col("ancestor") == F.col("term_id"), F.col("units"))).alias("own")))


def _keys(above: Column | str) -> Column:
    return F.transform(above, lambda x: x["key"])


def _units(one: Column, other: Column) -> Column:
    """The content, in millionths, of the best key that two arrays have in common."""
    return F.coalesce(F.shiftright(F.array_max(F.array_intersect(one, other)), 32), F.lit(0).cast("long"))


def mica(pairs: DataFrame, closed: DataFrame, information: DataFrame) -> DataFrame:
    """Pairs (a, b) of terms -> their most informative common ancestor (the larger id on ties) and its content.

    An ancestor that no entity has counts 0; pairs without one get null and 0. A pair meets its terms' ancestors as arrays, so there
    is no row for each of them.
    """
    lineages = _lineages(closed, information)
    met = pairs.select("a", "b").distinct().join(lineages.select(F.col("term_id").alias("b"), _keys("above").alias("theirs")), "b", "left")
    met = met.join(lineages.select(F.col("term_id").alias("a"), "above"), "a", "left").withColumn("best", F.array_max(F.array_intersect(_keys("above"), "theirs")))
    first = F.get(F.filter("above", lambda x: x["key"] == F.col("best")), 0)
    return met.select("a", "b", first["ancestor"].alias("mica"), F.coalesce(F.shiftright("best", 32) / 1_000_000, F.lit(0.0)).alias("ic"))


def best_match_average(pairs: DataFrame, annotations: DataFrame, closed: DataFrame, information: DataFrame) -> DataFrame:
    """Pairs (l, r) of entities -> the mean of the best similarities of each one's terms, averaged over both directions.

    A term's best similarity to an entity is the content of the most informative of its ancestors that any term of the
    entity has too, so terms meet an entity's ancestors, not all its terms. An ancestor that no entity has counts 0, as no
    common one does; an entity without terms gives 0. An entity is one row with the ancestors of all its terms, a pair one with both.
    """
    have = annotations.select("entity_id", "term_id").distinct().join(_lineages(closed, information), "term_id")
    sets = have.groupBy("entity_id").agg(F.collect_list(_keys("above")).alias("terms"))
    met = pairs.select("l", "r").join(sets.toDF("l", "x"), "l", "left").join(sets.toDF("r", "y"), "r", "left")
    # whole millionths, so that the order of their sums does not matter and one division rounds
    total = lambda one, other: F.aggregate(one, F.lit(0).cast("long"), lambda t, x: t + _units(x, F.flatten(other)))
    nx, ny = F.size("x").cast("long"), F.size("y").cast("long")
    mean = (total("x", "y") * ny + total("y", "x") * nx).cast("double") / (2_000_000 * nx * ny)
    return met.select("l", "r", F.when(F.col("x").isNotNull() & F.col("y").isNotNull(), mean).otherwise(0.0).alias("bma"))


def partition_by_ancestors(pairs: DataFrame, annotations: DataFrame, closed: DataFrame, information: DataFrame, related: int = 10) -> DataFrame:
    """partition_terms() with the similarities that mica() gives, without a row for each pair of terms: a pair of entities is one row with both sets."""
    least = -math.log(INFORMATIVE)
    have = annotations.select("entity_id", "term_id").distinct().join(_lineages(closed, information), "term_id", "left")
    term = F.struct(F.col("term_id").alias("term"), F.coalesce("own", F.lit(0).cast("long")).alias("own"), F.coalesce(_keys("above"), F.array().cast("array<bigint>")).alias("keys"))
    sets = have.groupBy("entity_id").agg(F.collect_list(term).alias("terms"))
    met = pairs.select("l", "r").join(sets.toDF("l", "x"), "l").join(sets.toDF("r", "y"), "r", "left")
    met = met.withColumn("y", F.coalesce("y", F.filter("x", lambda t: F.lit(False))))
    met = met.withColumns({"xs": F.transform("x", lambda t: t["term"]), "ys": F.transform("y", lambda t: t["term"])})
    met = met.withColumn("theirs", F.filter("y", lambda t: ~F.array_contains("xs", t["term"]))).withColumn("only", F.filter("x", lambda t: ~F.array_contains("ys", t["term"])))
    nearest = lambda t: F.array_min(F.transform("theirs", lambda u: F.struct((-_units(t["keys"], u["keys"])).alias("loss"), u["term"].alias("b"))))
    near = F.transform("only", lambda t: F.struct(nearest(t).alias("first"), t["term"].alias("a")))
    near = F.transform(near, lambda t: F.struct(t["first"]["loss"].alias("loss"), t["a"].alias("a"), t["first"]["b"].alias("b")))
    met = met.withColumn("best", F.slice(F.array_sort(F.filter(near, lambda t: -t["loss"] / 1_000_000 >= least)), 1, related))
    of = lambda t: F.get(F.filter("best", lambda z: z["a"] == t["term"]), 0)["b"]
    in_r = lambda t: F.coalesce(F.array_contains("ys", t["term"]), F.lit(False))
    part = lambda t: F.when(in_r(t) & (t["own"] / 1_000_000 >= least), "shared_informative").when(in_r(t), "shared_generic").when(of(t).isNotNull(), "related").otherwise("left_only")
    return met.select("l", "r", F.inline(F.transform("x", lambda t: F.struct(t["term"].alias("term_id"), part(t).alias("part"), of(t).alias("related_to")))))


def partition_terms(pairs: DataFrame, annotations: DataFrame, information: DataFrame, similarity: DataFrame, related: int = 10) -> DataFrame:
    """Pairs (l, r) -> terms of l in groups: shared_informative, shared_generic, related (with the best term of r), left_only.

    A term of l alone is related to the term of r alone with the best similarity (the smaller id on ties) that is
    informative; the best `related` of a pair are kept.
    """
    least = -math.log(INFORMATIVE)
    have = annotations.select("entity_id", "term_id").distinct()
    left = pairs.select("l", "r").join(have.select(F.col("entity_id").alias("l"), F.col("term_id").alias("a")), "l")
    right = have.select(F.col("entity_id").alias("r"), F.col("term_id").alias("b"))
    here = left.join(right.withColumnRenamed("b", "a").withColumn("in_r", F.lit(True)), ["r", "a"], "left")
    here = here.join(information.select(F.col("term_id").alias("a"), F.col("ic").alias("own")), "a", "left")
    only = here.filter("in_r is null").select("l", "r", "a")
    theirs = pairs.select("l", "r").join(right, "r").join(have.select(F.col("entity_id").alias("l"), F.col("term_id").alias("b"), F.lit(True).alias("in_l")), ["l", "b"], "left").filter("in_l is null").select("l", "r", "b")
    near = only.join(theirs, ["l", "r"]).join(similarity.select("a", "b", "ic"), ["a", "b"]).filter(F.col("ic") >= least)
    best = near.withColumn("n", F.row_number().over(Window.partitionBy("l", "r", "a").orderBy(F.desc("ic"), "b"))).filter("n = 1")
    best = best.withColumn("n", F.row_number().over(Window.partitionBy("l", "r").orderBy(F.desc("ic"), "a", "b"))).filter(F.col("n") <= related)
    grouped = here.join(best.select("l", "r", "a", "b"), ["l", "r", "a"], "left")
    group = F.when(F.col("in_r") & (F.coalesce("own", F.lit(0.0)) >= least), "shared_informative").when(F.col("in_r"), "shared_generic").when(F.col("b").isNotNull(), "related").otherwise("left_only")
    return grouped.select("l", "r", F.col("a").alias("term_id"), group.alias("part"), F.col("b").alias("related_to"))


def annotation_sets(raw: DataFrame, terms: DataFrame, alts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """raw (entity_id, term_id) -> the resolved annotations, each once, and the ids (entity_id, term_id) that the ontology does not know."""
    asked = raw.select("entity_id", "term_id", F.upper("term_id").alias("_upper"))
    found = canonical(asked, terms, alts, "_upper")
    good = found.filter("canonical is not null").select("entity_id", F.col("canonical").alias("term_id")).distinct()
    return good, found.filter("canonical is null").select("entity_id", "term_id").distinct()


def distinctive_terms(partition: DataFrame, information: DataFrame, most: int = 15) -> tuple[DataFrame, DataFrame]:
    """partition_terms() -> per pair the informative terms of l alone that nothing is related to, the `most` most informative ones
    (l, r, term_id, ic, place), and (l, r, unmatched): its terms alone less all distinctive ones."""
    alone = partition.filter(F.col("part").isin("left_only", "related"))
    scored = alone.join(information.select("term_id", "ic"), "term_id", "left").withColumn("telling", (F.col("part") == "left_only") & (F.coalesce("ic", F.lit(0.0)) >= -math.log(INFORMATIVE)))
    place = F.row_number().over(Window.partitionBy("l", "r").orderBy(F.desc("ic"), "term_id"))
    best = scored.filter("telling").withColumn("place", place).filter(F.col("place") <= most).select("l", "r", "term_id", "ic", "place")
    return best, scored.groupBy("l", "r").agg(F.count_if(~F.col("telling")).alias("unmatched"))
