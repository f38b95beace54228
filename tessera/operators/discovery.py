"""Features of documents, requirements of experiments, and the queries that look for who can meet them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import ASCII, or_group, terms_in


def fingerprints(annotations: DataFrame) -> DataFrame:
    """annotations (doc, ord, feature_id, label, feature_class, slot, evidence, path, modifier) -> one row a (doc, feature_id).

    The first label, class and slot by ord win; evidence is summed, paths and upper-case modifiers are united and sorted.
    """
    rows = annotations.filter("coalesce(feature_id, '') <> ''")
    first = [F.min_by(c, "ord").alias(c) for c in ("label", "feature_class", "slot")]
    united = [F.array_sort(F.collect_set("path")).alias("paths"), F.array_sort(F.collect_set(F.upper("modifier"))).alias("modifiers")]
    return rows.groupBy("doc", "feature_id").agg(*first, F.sum("evidence").alias("evidence"), *united)


def fingerprint_coverage(features: DataFrame, classes: list[str]) -> DataFrame:
    """Per document: features by class, those with an ontology id, and the classes that are missing."""
    counts = features.groupBy("doc", "feature_class").agg(F.count("*").alias("n"), F.count_if(F.contains("feature_id", F.lit(":"))).alias("grounded"))
    out = counts.groupBy("doc").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("feature_class", "n")))).alias("by_class"), F.sum("grounded").alias("grounded"))
    return out.withColumn("missing", F.array_except(F.array(*map(F.lit, classes)), F.map_keys("by_class")))


def scanned_terms(text: Column, terms: list[str], whole_words: bool = False) -> Column:
    """Terms in a text in any letter case; whole_words leaves out those inside other words."""
    if not whole_words:
        return terms_in(text, terms)
    import re

    hit = lambda t: F.rlike(text, F.lit("(?i)" + ASCII[0] + re.escape(t) + ASCII[1]))
    return F.array_compact(F.array(*[F.when(hit(t), F.lit(t)) for t in terms]))


def requirements(experiments: DataFrame, rules: list[tuple[str, str, list[str]]]) -> DataFrame:
    """experiments (experiment_id, text) x rules (category, requirement, keywords) -> the first rule of each category that applies."""
    low = F.lower("text")
    hits = [F.when(F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(low, w)), F.struct(F.lit(i).alias("ord"), F.lit(c).alias("category"), F.lit(r).alias("requirement"))) for i, (c, r, words) in enumerate(rules)]
    rows = experiments.select("experiment_id", F.explode(F.array_compact(F.array(*hits))).alias("h")).select("experiment_id", "h.*")
    first = Window.partitionBy("experiment_id", "category").orderBy("ord")
    return rows.withColumn("n", F.row_number().over(first)).filter("n = 1").select("experiment_id", "category", "requirement")


def search_queries(slots: DataFrame, templates: list[tuple[str, str, list[str]]]) -> DataFrame:
    """slots (id, slot, terms) x templates (category, text with {slot}, required slots) -> (id, category, query), or the slots that are missing.

    Each slot becomes an OR group of its terms, quoted where they have blanks or dashes.
    """
    filled = slots.withColumn("group", or_group(F.col("terms"))).groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("slot", "group"))).alias("have"))
    rows = []
    for category, text, needed in templates:
        query = F.lit(text)
        for slot in needed:
            query = F.replace(query, F.lit("{" + slot + "}"), F.coalesce(F.element_at("have", slot), F.lit("")))
        missing = F.array_except(F.array(*map(F.lit, needed)), F.map_keys("have"))
        rows.append(F.struct(F.lit(category).alias("category"), F.when(F.size(missing) == 0, query).alias("query"), missing.alias("missing")))
    return filled.select("id", F.explode(F.array(*rows)).alias("q")).select("id", "q.*")


def unite_queries(queries: DataFrame) -> DataFrame:
    """Each (source, query) once, at its first place (ord)."""
    first = Window.partitionBy("source", "query").orderBy("ord")
    return queries.withColumn("n", F.row_number().over(first)).filter("n = 1").drop("n")


def signals(candidates: DataFrame, expected: DataFrame) -> DataFrame:
    """candidates (category, query, ...) with model_match from expected (category, query, model_match); without one it counts as met."""
    return candidates.join(expected, ["category", "query"], "left").withColumn("model_match", F.coalesce("model_match", F.lit(True)))


def breadth(queries: DataFrame, most: int = 2000) -> DataFrame:
    """queries (hits, failed) -> state: a search that failed, was too broad, found nothing or found something are four things."""
    state = F.when(F.col("failed"), "FAILED").when(F.col("hits").isNull(), "NOT_STARTED").when(F.col("hits") > most, "TOO_BROAD").when(F.col("hits") == 0, "CHECKED_EMPTY").otherwise("CHECKED")
    return queries.withColumn("state", state)


def people(publications: DataFrame) -> DataFrame:
    """publications (pmid, year, authors, affiliations) -> first and last authors by slug with their papers and affiliations in order of (year descending, pmid)."""
    from ..functions.text import slug

    ends = F.array_distinct(F.filter(F.array(F.col("authors")[0], F.element_at("authors", -1)), lambda a: a.isNotNull()))
    rows = publications.filter(F.size("authors") > 0).select("pmid", "year", "affiliations", F.explode(ends).alias("name")).withColumn("person_id", slug(F.col("name")))
    entry = F.struct((-F.coalesce("year", F.lit(0))).alias("o"), "pmid", "name", "affiliations")
    grouped = rows.groupBy("person_id").agg(F.array_sort(F.collect_list(entry)).alias("e"))
    return grouped.select(
        "person_id", F.col("e")[0]["name"].alias("name"), F.array_distinct(F.transform("e", lambda x: x["pmid"])).alias("publications"), F.array_distinct(F.flatten(F.transform("e", lambda x: x["affiliations"]))).alias("affiliations")
    )


def fingerprint_summary(features: DataFrame, most: int = 20) -> tuple[DataFrame, DataFrame]:
    """features (doc, feature_id, feature_class) -> one row of totals (features, distinct, shared by more than one), and the `most` most common ones."""
    counts = features.groupBy("feature_id").agg(F.countDistinct("doc").alias("docs"), F.count("*").alias("n"))
    totals = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("features"), F.count("*").alias("distinct"), F.count_if(F.col("docs") > 1).alias("shared"))
    return totals, counts.select("feature_id", "docs").orderBy(F.desc("docs"), "feature_id").limit(most)


def located_sentences(sources: DataFrame, locators: DataFrame, around: int = 160) -> DataFrame:
    """sources (id, ord, location, text) x locators (id, locator, expected) -> (id, locator, span, location), null where nothing is found.

    A locator is a pattern in any letter case, its blanks any white space. The first source that it stands in counts, of the expected
    location if the id has any there; its first sentence that holds it is the span, else what stands `around` the place.
    """
    from ..functions.text import sentences

    rows = locators.join(sources, "id", "left").withColumn("_p", F.concat(F.lit("(?i)"), F.replace("locator", F.lit(" "), F.lit(r"\s+"))))
    expected = F.max(F.coalesce(F.col("location") == F.col("expected"), F.lit(False))).over(Window.partitionBy("id", "locator"))
    rows = rows.withColumn("_any", expected).filter(~F.col("_any") | (F.col("location") == F.col("expected")) | F.col("expected").isNull())
    place = F.regexp_instr("text", F.col("_p"))
    rows = rows.withColumn("_at", F.when(F.rlike("text", F.col("_p")), place))
    whole = F.filter(F.transform(sentences(F.col("text")), lambda x: F.trim(x)), lambda x: F.rlike(x, F.col("_p")))
    window = F.trim(F.substring(F.col("text"), F.greatest(F.col("_at") - around, F.lit(1)), F.least(F.col("_at") - 1, F.lit(around)) + F.length(F.regexp_substr("text", F.col("_p"))) + around))
    rows = rows.withColumn("span", F.when(F.col("_at").isNotNull(), F.coalesce(F.get(whole, F.lit(0)), window)))
    order = Window.partitionBy("id", "locator").orderBy(F.col("_at").isNull(), "ord")
    return rows.withColumn("_n", F.row_number().over(order)).filter("_n = 1").select("id", "locator", "span", F.when(F.col("span").isNotNull(), F.col("location")).alias("location"))
