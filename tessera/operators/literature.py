"""Publications about pairs of entities: search terms, queries, assessment of records, and references resolved to one form."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import ASCII, DIRECT_LINK, SECONDARY, UNICODE, marked

_NONE = "array<string>"


def _distinct(*parts: Column) -> Column:
    return F.array_distinct(F.array_compact(F.concat(*[F.coalesce(p, F.array().cast(_NONE)) for p in parts])))


def _name(column: str = "name") -> Column:
    return F.trim(F.replace(F.col(column), F.lit("_"), F.lit(" ")))


def entity_terms(entities: DataFrame, most: int = 10) -> DataFrame:
    """entities (id, name, genes: array of (symbol, aliases, acronyms)) -> also terms, confirming and acronyms.

    terms, to find papers by: the first three genes with three aliases each, and the name, `most` at most. confirming, to tell
    that a paper is about the entity: the genes, their names of several words that are no acronyms, and the name if it has
    several words. acronyms: the genes' short names, which collide with other words.
    """
    first = F.slice("genes", 1, 3)
    found = F.flatten(F.transform(first, lambda g: F.concat(F.array(g["symbol"]), F.slice(g["aliases"], 1, 3))))
    upper = lambda xs: F.transform(xs, lambda a: F.upper(a))
    strict = F.flatten(F.transform(first, lambda g: F.concat(F.array(g["symbol"]), F.filter(g["aliases"], lambda a: F.contains(a, F.lit(" ")) & ~F.array_contains(upper(g["acronyms"]), F.upper(a))))))
    name = _name()
    own = F.when(F.contains(name, F.lit(" ")), F.array(name)).otherwise(F.array().cast(_NONE))
    return entities.withColumns({
        "terms": F.slice(_distinct(found, F.array(name)), 1, most),
        "confirming": _distinct(strict, own),
        "acronyms": _distinct(F.flatten(F.transform("genes", lambda g: g["acronyms"]))),
    })


def co_mention_query(left: Column, right: Column) -> Column:
    """Whether any paper names both: (a[tiab] OR "b c"[tiab]) AND (...)."""
    one = lambda t: F.when(F.contains(t, F.lit(" ")), F.concat(F.lit('"'), t, F.lit('"[tiab]'))).otherwise(F.concat(t, F.lit("[tiab]")))
    group = lambda terms: F.concat(F.lit("("), F.array_join(F.transform(terms, one), " OR "), F.lit(")"))
    return F.concat(group(left), F.lit(" AND "), group(right))


def assess_records(records: DataFrame, boundary: tuple[str, str] = UNICODE) -> DataFrame:
    """Retrieved papers (title, abstract, left_terms, right_terms, left_acronyms, right_acronyms, ...) -> direct, primary, polarity, caveats.

    A side is confirmed by one of its terms in any letter case; or by an acronym, in its own case, if the other side is
    confirmed by a term. direct: both sides, and wording of a molecular link. primary: the title names no secondary publication.
    """
    text = F.concat_ws(" ", F.coalesce("title", F.lit("")), F.coalesce("abstract", F.lit("")))
    low = F.lower(text)
    sure = {s: F.exists(F.col(f"{s}_terms"), lambda t: F.contains(low, F.lower(t))) for s in ("left", "right")}
    short = {s: F.exists(F.col(f"{s}_acronyms"), lambda t: F.contains(text, t)) for s in ("left", "right")}
    rows = records.withColumns({"_l": sure["left"], "_r": sure["right"], "_la": short["left"], "_ra": short["right"]})
    by_context = (~F.col("_l") & F.col("_r") & F.col("_la")) | (~F.col("_r") & F.col("_l") & F.col("_ra"))
    rows = rows.withColumn("_both", (F.col("_l") & F.col("_r")) | by_context)
    direct = F.col("_both") & marked(text, DIRECT_LINK, boundary)
    primary = ~marked(F.coalesce("title", F.lit("")), SECONDARY, boundary)
    rows = rows.withColumns({"direct": direct, "primary": primary, "_context": by_context})
    caveats = F.array_compact(F.array(
        F.when(F.col("_context"), "ACRONYM_BY_CONTEXT"), F.when(~F.col("_both"), "NOT_CONFIRMED"),
        F.when(F.col("_both") & ~F.col("direct"), "CO_MENTION_ONLY"), F.when(~F.col("primary"), "SECONDARY_PUBLICATION"),
    ))
    polarity = F.when(F.col("direct"), "SUPPORTS").otherwise("QUALIFIES")
    return rows.withColumns({"polarity": polarity, "caveats": caveats}).drop("_l", "_r", "_la", "_ra", "_both", "_context")


def resolve_references(references: DataFrame, lookups: DataFrame) -> DataFrame:
    """references (reference, ...) x lookups (form: PMC or DOI, key, pmid) -> canonical (PMID:n or null), method, identity.

    A PMID is taken as it is; a PMC or DOI form needs a lookup, of which the first with a PMID (the least, should there be
    several) counts; other forms have no resolver. identity, which independence is counted by, falls back to the reference.
    """
    raw = F.trim("reference")
    pmid = F.regexp_extract(raw, r"^(?i:PMID:)\s*(\d+)$", 1)
    pmc = F.regexp_extract(raw, r"(?i:PMC)(\d+)", 1)
    bare = F.regexp_replace(raw, r"^(?i:DOI:)\s*", "")
    is_doi = F.rlike(bare, F.lit(r"^10\.\d{4,9}/\S+$"))
    rows = references.withColumn("_form", F.when(pmid != "", "PMID").when(pmc != "", "PMC").when(is_doi, "DOI"))
    rows = rows.withColumn("_key", F.when(F.col("_form") == "PMID", pmid).when(F.col("_form") == "PMC", pmc).when(F.col("_form") == "DOI", bare))
    known = lookups.filter("pmid is not null").groupBy(F.col("form").alias("_form"), F.col("key").alias("_key")).agg(F.min("pmid").alias("_pmid"))
    met = rows.join(known, ["_form", "_key"], "left")
    canonical = F.concat(F.lit("PMID:"), F.when(F.col("_form") == "PMID", F.col("_key")).otherwise(F.col("_pmid").cast("string")))
    method = F.when(F.col("_form") == "PMID", "direct").when(F.col("_form").isNull(), "no_resolver").when(F.col("_pmid").isNull(), "unresolved")
    method = method.when(F.col("_form") == "PMC", "ncbi_id_converter").otherwise("europe_pmc_doi")
    out = met.withColumns({"canonical": canonical, "method": method})
    return out.withColumn("identity", F.coalesce("canonical", raw)).drop("_form", "_key", "_pmid")


def grant_relevance(grants: DataFrame, subject: str, context: str) -> DataFrame:
    """grants (title, abstract, active) -> disposition: the subject as a whole word in its own case, a word of the context (a pattern), and activity."""
    text = F.concat_ws(" ", F.coalesce("title", F.lit("")), F.coalesce("abstract", F.lit("")))
    about, near = F.rlike(text, F.lit(ASCII[0] + subject + ASCII[1])), F.rlike(text, F.lit(f"(?i){context}"))
    out = F.when(about & near & F.col("active"), "QUALIFIES").when(about & near, "EXPIRED").when(about, "CONTEXT_MISMATCH").when(near, "SUBJECT_MISMATCH")
    return grants.withColumn("disposition", out.otherwise("RETRIEVED_BY_AMBIGUOUS_TOKEN"))


def relevant_trials(trials: DataFrame, terms: list[str]) -> DataFrame:
    """Trials with a condition that holds one of the terms, in any letter case."""
    return trials.filter(F.exists("conditions", lambda c: F.exists(F.array(*map(F.lit, terms)), lambda t: F.contains(F.lower(c), F.lower(t)))))


#: Statuses that leave a claim open.
OPEN = ("INSUFFICIENT_EVIDENCE", "CONTEXT_DEPENDENT", "CONTRADICTED", "PARTIALLY_SUPPORTED")


def open_claims(claims: DataFrame) -> DataFrame:
    return claims.filter(F.col("status").isin(*OPEN))


def merge_terms(existing: DataFrame, found: DataFrame) -> DataFrame:
    """existing, found (pair_id, term, ord) -> the existing terms and the new ones, told apart in any letter case, each at its first place.

    is_new marks what was added; a pair without new terms keeps its own.
    """
    have = existing.select("pair_id", F.lower("term").alias("_low")).distinct()
    first = Window.partitionBy("pair_id", "term").orderBy("ord")
    once = found.withColumn("_n", F.row_number().over(first)).filter("_n = 1").withColumn("_low", F.lower("term"))
    new = once.join(have, ["pair_id", "_low"], "left_anti").select("pair_id", "term", "ord", F.lit(True).alias("is_new"))
    return existing.select("pair_id", "term", "ord", F.lit(False).alias("is_new")).unionByName(new)


def capability_coverage(required: DataFrame, candidates: DataFrame) -> DataFrame:
    """required (requirement, category) x candidates (category, name, ord) -> the first candidate of the category, or MISSING."""
    first = candidates.groupBy("category").agg(F.min_by("name", "ord").alias("candidate"))
    met = required.join(first, "category", "left")
    return met.withColumn("status", F.when(F.col("candidate").isNull(), "MISSING").otherwise("CANDIDATE_IDENTIFIED"))


def first_target(teams: DataFrame, requirement: str) -> DataFrame:
    """teams (requirement, team, ord, current): the first current team of a requirement, if any."""
    return teams.filter((F.col("requirement") == F.lit(requirement)) & F.col("current")).orderBy("ord").limit(1)


def search_coverage(results: DataFrame) -> DataFrame:
    """results (tier, category, hits) -> (tier, note): its searches as sorted "category=hits"."""
    entry = F.concat("category", F.lit("="), F.col("hits").cast("string"))
    return results.groupBy("tier").agg(F.array_join(F.array_sort(F.collect_list(entry)), ", ").alias("note"))


def as_of(snapshots: DataFrame, column: str = "retrieved_at") -> DataFrame:
    return snapshots.agg(F.max(column).alias("as_of"))


def detector_counts(findings: DataFrame) -> DataFrame:
    return findings.groupBy("code").agg(F.count("*").alias("findings"))


def most_flagged(findings: DataFrame, key: str = "object_id", most: int = 15) -> DataFrame:
    """The `most` objects with most findings, the least key first on ties."""
    return findings.groupBy(key).agg(F.count("*").alias("findings")).orderBy(F.desc("findings"), key).limit(most)


def shuffled(rows: DataFrame, key: str, seed: int) -> DataFrame:
    """`rows` with their place in an order that a seed decides, the same on every run."""
    h = F.sha2(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")), 256)
    return rows.withColumn("shuffle_key", h).orderBy("shuffle_key", key)
