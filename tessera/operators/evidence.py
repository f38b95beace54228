"""Evidence rules: citation checks, the critic, synthesis of claims and edges, claim-fit findings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.cascade import first_match
from ..functions.text import span_found, titles_match
from .checkpoints import settled

LOSS = ("ABOLISHED", "DECREASED")
PARTIAL = ("PROCESSIVITY_DEFECT", "SUBSTRATE_SELECTIVE", "PARTIALLY_RETAINED")
RETAINED = ("UNCHANGED", "INCREASED")


def check_citations(rows: DataFrame) -> DataFrame:
    """Rows (identifier, title, resolved_title, span, source_text, full_text) -> also title_matches, located, status.

    An identifier that has no resolver is not checkable; then the title, then the span decide. Without its full text a
    span that can't be found is neither confirmed nor impugned.
    """
    text = rows.withColumn("title_matches", titles_match(F.col("title"), F.col("resolved_title")))
    text = text.withColumn("located", F.coalesce(span_found(F.col("span"), F.col("source_text")), F.lit(False)))
    status = first_match(
        [
            (F.col("identifier").isNull(), "NOT_CHECKABLE"),
            (F.col("resolved_title").isNull(), "UNRESOLVED"),
            (F.col("title_matches") == F.lit(False), "TITLE_MISMATCH"),
            (F.col("located"), "VERIFIED"),
            (F.col("full_text"), "SPAN_NOT_LOCATED"),
        ],
        ("UPSTREAM_ATTESTED",),
        ("status",),
    )
    return text.select("*", *status)


def review(pairs: DataFrame) -> DataFrame:
    """Claim x observation rows -> supports, directness, causal and the matches that lead to them.

    Columns: readout, effect, origin, disease, cell_types, variants, variant_class, citation (its status); of the claim
    readout_scope, expected_effect, disease_scope, cell_type_scope, variant_scope, scope_class.
    """
    def low(c: str) -> Column:
        return F.transform(c, lambda x: F.lower(x))

    df = pairs.withColumn(
        "fit0",
        first_match(
            [
                (~F.array_contains("readout_scope", F.col("readout")), "UNRELATED"),
                (F.array_contains("expected_effect", F.col("effect")), "SUPPORTS"),
                (F.col("effect").isin(*PARTIAL), "QUALIFIES"),
                (F.arrays_overlap("expected_effect", F.array(*map(F.lit, LOSS))) & F.col("effect").isin(*RETAINED), "REFUTES"),
            ],
            ("NEUTRAL",),
            ("fit0",),
        )[0],
    )
    df = df.withColumn("disease_match", F.array_contains("disease_scope", F.col("disease")))
    no_cells = (F.size("cell_type_scope") == 0) | (F.size("cell_types") == 0)
    df = df.withColumn("cell_type_match", F.when(no_cells, F.lit(None).cast("boolean")).otherwise(F.arrays_overlap(low("cell_types"), low("cell_type_scope"))))
    named = F.arrays_overlap("variants", "variant_scope")
    none = F.size("variants") == 0
    df = df.withColumn(
        "variant_match",
        F.when((F.size("variants") > 0) & (F.size("variant_scope") > 0) & named, True)
        .when(none & F.coalesce(F.col("variant_class") == F.col("scope_class"), F.lit(False)), True)
        .when(~none, False)
        .otherwise(F.lit(None).cast("boolean")),
    )
    decided = F.col("fit0").isin("SUPPORTS", "REFUTES")
    verified, attested = F.col("citation") == "VERIFIED", F.col("citation") == "UPSTREAM_ATTESTED"
    outside = ~F.col("disease_match") | F.col("cell_type_match").eqNullSafe(F.lit(False))
    df = df.withColumn("supports", F.when(~verified & ~attested, "NEUTRAL").when(decided & (outside | attested), "QUALIFIES").otherwise(F.col("fit0")))
    background = F.col("origin") == "BACKGROUND_CITATION"
    df = df.withColumn("paper_generated", (F.col("origin") == "PRIMARY_RESULT") & (verified | attested) & ~background)
    in_scope = F.col("disease_match") & F.col("variant_match").eqNullSafe(F.lit(True)) & ~F.col("cell_type_match").eqNullSafe(F.lit(False))
    direct = F.col("paper_generated") & in_scope & (F.col("supports") != "UNRELATED")
    df = df.withColumn("directness", F.when(background, "BACKGROUND_ONLY").when(direct, "DIRECT").otherwise("INDIRECT"))
    no_cause = (F.col("directness") == "BACKGROUND_ONLY") | F.col("supports").isin("NEUTRAL", "UNRELATED")
    cause = F.col("paper_generated") & ~none & in_scope & ~attested
    return df.withColumn("causal", F.when(no_cause, "NONE").when(cause, "CAUSAL").otherwise("ASSOCIATIONAL")).drop("fit0")


def synthesize_claims(reviews: DataFrame) -> DataFrame:
    """Reviews (claim_id, supports, directness, source) -> status and rule of each claim, by direct evidence only."""
    direct = F.col("directness") == "DIRECT"

    def n(kind: str) -> Column:
        return F.count_if(direct & (F.col("supports") == kind))

    counts = reviews.groupBy("claim_id").agg(
        F.count_if(direct).alias("direct"),
        n("SUPPORTS").alias("ds"),
        n("REFUTES").alias("dr"),
        n("QUALIFIES").alias("dq"),
        F.countDistinct(F.when(direct & (F.col("supports") == "REFUTES"), F.col("source"))).alias("refuters"),
    )
    ds, dr, dq = F.col("ds") > 0, F.col("dr") > 0, F.col("dq") > 0
    rules = [
        (F.col("direct") == 0, "INSUFFICIENT_EVIDENCE", "A1"),
        (ds & ~dr & ~dq, "SUPPORTED", "A2"),
        (ds, "CONTEXT_DEPENDENT", "A3"),
        (dr & ~dq & (F.col("refuters") >= 2), "CONTRADICTED", "A4"),
        (dr & dq, "CONTEXT_DEPENDENT", "A5"),
        (dr, "INSUFFICIENT_EVIDENCE", "A6"),
    ]
    return counts.select("*", *first_match(rules, ("PARTIALLY_SUPPORTED", "A7"), ("status", "rule")))


def synthesize_edges(claims: DataFrame) -> DataFrame:
    """Claims (edge_id, status) -> status and rule of each edge."""
    def n(*kinds: str) -> Column:
        return F.count_if(F.col("status").isin(*kinds))

    counts = claims.groupBy("edge_id").agg(
        F.count("*").alias("claims"),
        n("SUPPORTED").alias("supported"),
        n("CONTRADICTED", "CONTEXT_DEPENDENT", "PARTIALLY_SUPPORTED").alias("divergent"),
        n("CONTRADICTED").alias("contradicted"),
    )
    some = F.col("supported") > 0
    rules = [
        (some & (F.col("supported") == F.col("claims")), "SUPPORTED", "E1"),
        (some & (F.col("divergent") > 0), "CONTEXT_DEPENDENT", "E2"),
        (some, "PARTIALLY_SUPPORTED", "E3"),
        (F.col("contradicted") > 0, "CONTRADICTED", "E4"),
    ]
    return counts.select("*", *first_match(rules, ("INSUFFICIENT_EVIDENCE", "E5"), ("status", "rule")))


CHECKABLE = ("PMID", "PMCID", "DOI")
#: How often people have a phenotype.
HUMAN_FREQUENCIES = ("OBLIGATE", "VERY_FREQUENT", "FREQUENT", "OCCASIONAL", "VERY_RARE", "EXCLUDED")


def claim_fit(objects: DataFrame) -> DataFrame:
    """Objects with evidence -> one row (object_id, code, severity) a finding.

    Columns: object_id, is_mechanism, confidence, frequency, evidence: array of (reference, kind, supports, quote_role,
    evidence_source), kind one of PMID, PMCID, DOI, OTHER. A missing `supports` means SUPPORT.
    """
    def stance(e: Column) -> Column:
        return F.coalesce(e["supports"], F.lit("SUPPORT"))

    df = objects.withColumn("backing", F.filter("evidence", lambda e: stance(e) == "SUPPORT"))
    some = F.size("backing") > 0

    def all_have(field: str, value: str) -> Column:
        return some & F.forall("backing", lambda e: F.coalesce(e[field] == value, F.lit(False)))

    kinds = F.transform("evidence", lambda e: e["kind"])
    background = all_have("quote_role", "BACKGROUND")
    findings = [
        (background, "BACKGROUND_ONLY_SUPPORT", "HIGH"),
        (~background & all_have("quote_role", "REVIEW_SYNTHESIS") & F.col("is_mechanism"), "REVIEW_ONLY_SUPPORT", "MEDIUM"),
        (
            (F.col("confidence") == "ESTABLISHED") & F.exists("evidence", lambda e: F.coalesce(e["supports"].isin("REFUTE", "NO_EVIDENCE"), F.lit(False))),
            "CONFIDENCE_CONTRADICTS_EVIDENCE",
            "HIGH",
        ),
        (some & F.col("is_mechanism") & F.forall("backing", lambda e: ~e["kind"].isin(*CHECKABLE)), "UNVERIFIABLE_SOLE_SUPPORT", "MEDIUM"),
        (F.array_contains(kinds, "PMID") & F.array_contains(kinds, "PMCID"), "DUAL_FORM_CITATION", "LOW"),
        (F.upper("frequency").isin(*HUMAN_FREQUENCIES) & all_have("evidence_source", "MODEL_ORGANISM"), "HUMAN_FREQUENCY_MODEL_ONLY", "HIGH"),
    ]
    rows = F.array_compact(F.array(*[F.when(c, F.struct(F.lit(code).alias("code"), F.lit(level).alias("severity"))) for c, code, level in findings]))
    return df.select("object_id", F.explode(rows).alias("finding")).select("object_id", "finding.*")


def unsupported_direct_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """DIRECT edges (doc, source, target, link, n_evidence) without evidence on themselves or either end (doc, label, n_evidence)."""
    ends = nodes.select("doc", "label", (F.col("n_evidence") > 0).alias("has"))
    a = ends.select("doc", F.col("label").alias("source"), F.col("has").alias("from_has"))
    b = ends.select("doc", F.col("label").alias("target"), F.col("has").alias("to_has"))
    met = edges.filter("link = 'DIRECT' and n_evidence = 0").join(a, ["doc", "source"], "left").join(b, ["doc", "target"], "left")
    return met.filter(~F.coalesce("from_has", F.lit(False)) & ~F.coalesce("to_has", F.lit(False))).select("doc", "source", "target")


def located_spans(docs: DataFrame, spans: DataFrame, words: int = 4, few: int = 50_000) -> DataFrame:
    """docs (doc_id, hay) and a stated set of spans (item_id, span), in comparison form -> (item_id, doc_id) where a span stands.

    A span may begin and end inside a word, so its inner words stand whole in a text: candidates share the hash of the `words`
    after the first one, and are verified on the text. Spans with fewer inner words are held against all texts. Up to `few`
    spans, or candidates, are broadcast; more meet by a shuffle.
    """
    small = lambda df: F.broadcast(df) if df.limit(few + 1).count() <= few else df
    of = lambda parts, i: F.xxhash64(F.array_join(F.slice(parts, i, words), " "))
    split = spans.filter("span <> ''").withColumn("_words", F.split("span", " "))
    keyed = split.filter(F.size("_words") >= words + 2).select("item_id", of(F.col("_words"), F.lit(2)).alias("key"))
    short = split.filter(F.size("_words") < words + 2).select("item_id", "span")
    # a lambda over one element binds the words, so that a text is split once
    every = lambda parts: F.when(F.size(parts) >= words, F.transform(F.sequence(F.lit(1), F.size(parts) - words + 1), lambda i: of(parts, i)))
    grams = F.transform(F.array(F.split("hay", " ")), every)[0]
    met = docs.select("doc_id", F.explode(F.array_distinct(grams)).alias("key")).join(small(keyed), "key").select("item_id", "doc_id").distinct()
    met = settled(met)
    found = docs.join(small(met), "doc_id").join(small(spans), "item_id").filter(F.contains("hay", F.col("span"))).select("item_id", "doc_id")
    if short.limit(1).count():
        found = found.unionByName(docs.join(F.broadcast(short), F.contains("hay", F.col("span"))).select("item_id", "doc_id"))
    return found
