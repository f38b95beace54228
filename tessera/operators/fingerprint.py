"""Fingerprints of imported documents: every feature that a document asserts, with the parts that assert it and their evidence.

Annotations, phenotypes and genes come from the typed tables. What treatments, models and variants say in prose is searched for
all terms in one pass over each kept record.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import normalize_label
from . import corpus, discovery, ingest
from .checkpoints import settled

#: The classes of features, in the order in which missing ones are told.
CLASSES = ("genetic", "molecular", "cellular", "cell_tissue", "phenotype", "model_organism", "therapeutic", "mechanism")

#: What is looked for in prose: effects of variants, kinds of treatment, and the organisms that names stand for.
VARIANT_EFFECTS = (
    "loss_of_function", "loss of function", "gain_of_function", "gain of function", "dominant_negative", "dominant negative",
    "haploinsufficiency", "nonsense", "missense", "frameshift", "truncating", "deletion", "duplication", "splice",
)
TREATMENTS = (
    "gene therapy", "gene replacement", "gene addition", "antisense", "aso", "rnai", "sirna", "small molecule", "enzyme replacement",
    "substrate reduction", "chaperone", "protein stabilization", "transplant", "immunosuppress",
)
ORGANISMS = {
    "mus musculus": "Mus musculus", "mouse": "Mus musculus", "danio rerio": "Danio rerio", "zebrafish": "Danio rerio",
    "drosophila": "Drosophila melanogaster", "caenorhabditis": "Caenorhabditis elegans", "c. elegans": "Caenorhabditis elegans",
    "rattus": "Rattus norvegicus", "rat": "Rattus norvegicus", "saccharomyces": "Saccharomyces cerevisiae", "yeast": "Saccharomyces cerevisiae",
}
#: Which sections' prose tells of what.
READ_FOR = {"genetic": "variant_effect", "variants": "variant_effect", "treatments": "modality", "animal_models": "organism", "experimental_models": "organism"}
TERMS = {"variant_effect": {t: t for t in VARIANT_EFFECTS}, "modality": {t: t for t in TREATMENTS}, "organism": ORGANISMS}


def scanned_records(records: DataFrame, read_for: dict[str, str] = READ_FOR, terms: dict[str, dict[str, str]] = TERMS) -> DataFrame:
    """(doc, kind, term): what the records (doc, section, payload) of the sections in `read_for` say, each once a document.

    The text of a record is that of its top-level strings, numbers and truth values, one blank apart. A term is found wherever its
    letters stand, in any case, inside words too, and gives the name that `terms` has for it. All terms of all kinds are one
    Aho-Corasick automaton, so the time does not grow with their number.
    """

    def of(batch: pd.DataFrame) -> Iterator[tuple]:
        yield from zip(batch["doc"], batch["section"], map(json.loads, batch["payload"]), strict=True)

    return _said(records.filter(F.col("section").isin(*read_for)).select("doc", "section", "payload"), of, read_for, terms)


def scanned_documents(documents: DataFrame, read_for: dict[str, str] = READ_FOR, terms: dict[str, dict[str, str]] = TERMS) -> DataFrame:
    """scanned_records() of what preserved_records() keeps of documents (doc, source, body), straight from their text, written once for all who read it."""

    def of(batch: pd.DataFrame) -> Iterator[tuple]:
        for doc, source in zip(batch["doc"], batch["source"], strict=True):
            for section, _, raw in corpus.top_level(source):
                if section in read_for:
                    value = json.loads(raw)
                    yield doc, section, value if isinstance(value, dict) else {"value": value}

    return settled(_said(documents.filter("body is not null").select("doc", "source"), of, read_for, terms))


def _said(rows: DataFrame, records_of: Callable[[pd.DataFrame], Iterator[tuple]], read_for: dict[str, str], terms: dict[str, dict[str, str]]) -> DataFrame:
    """(doc, kind, term) of the records (doc, section, object) that records_of() makes of batches of `rows`."""
    kind = dict(rows.dtypes)["doc"]

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import ahocorasick

        automaton, named = ahocorasick.Automaton(), {}
        for what, own in terms.items():
            for term, name in own.items():
                named.setdefault(term, []).append((what, name))
        for term, names in named.items():
            automaton.add_word(term, names)
        automaton.make_automaton()
        for batch in batches:
            said = set()
            for doc, section, record in records_of(batch):
                values = [v for v in record.values() if isinstance(v, (str, int, float))]
                found = {x for _, names in automaton.iter(" ".join(map(str, values)).lower()) for x in names}
                said |= {(doc, what, name) for what, name in found if what == read_for[section]}
            yield pd.DataFrame(list(said), columns=["doc", "kind", "term"])

    return rows.mapInPandas(scan, f"doc {kind}, kind string, term string").distinct()


def evidence_counts(documents: DataFrame) -> DataFrame:
    """(doc, path, evidence): how many evidence items of each node, phenotype and edge are normalised; parts without any are left out."""
    items = corpus.imported_evidence(corpus.claim_evidence(corpus.claims(documents))).filter("relation is not null")
    owner = F.regexp_replace("path", r"\.evidence\[\d+\]$", "")
    return items.groupBy("doc", owner.alias("path")).agg(F.count("*").alias("evidence"))


def _or_text(term_id: Column, label: Column) -> Column:
    return F.coalesce(term_id, F.concat(F.lit("text:"), normalize_label(label)))


def asserted_features(documents: DataFrame, found: DataFrame) -> DataFrame:
    """(doc, ord, feature_id, label, feature_class, slot, evidence, path, modifier): each place where a document asserts a feature.

    found: scanned_records(). In the order in which a feature's first label, class and slot are taken: annotations by node, slot and
    place, phenotypes, genes, organisms, treatments. Something without an id has text: and its label in comparison form.
    """
    order = lambda *parts: F.struct(*[F.coalesce(p, F.lit(0)).cast("long") for p in parts], F.lit("").alias("name"))
    zero, none = F.lit(0), F.lit(None).cast("string")
    at = F.concat(F.lit("pathophysiology["), F.col("ord").cast("string"), F.lit("]"))
    slots = F.array_position(F.array(*[F.lit(s) for s in sorted(ingest.SLOT_CLASSES)]), F.col("slot"))
    notes = ingest.annotations(ingest.mechanism_nodes(documents.filter("body is not null")))
    label = F.coalesce("term_label", "term", "feature_id")
    parts = [notes.select("doc", order(F.lit(1), F.col("ord"), slots, F.col("place")).alias("o"), "feature_id", label.alias("label"), "feature_class", "slot", at.alias("path"), "modifier")]
    seen = corpus.phenotypes(documents)
    parts.append(seen.select("doc", order(F.lit(2), F.col("ord"), zero, zero), _or_text(F.col("hpo_id"), F.col("label")), "label", F.lit("phenotype"), F.lit("phenotypes"), "path", none))
    genes = corpus.genes(documents).filter("symbol is not null")
    parts.append(genes.select("doc", order(F.lit(3), F.col("ord"), zero, zero), _or_text(F.col("hgnc_id"), F.col("symbol")), "symbol", F.lit("genetic"), F.lit("genetic"), F.lit("genetic"), none))
    for i, what, feature_class, slot in ((4, "organism", "model_organism", "animal_models"), (5, "modality", "therapeutic", "treatments")):
        rows = found.filter(F.col("kind") == what)
        parts.append(rows.select("doc", order(F.lit(i), zero, zero, zero), F.concat(F.lit(what + ":"), "term"), "term", F.lit(feature_class), F.lit(slot), F.lit(slot), none))
    rows = parts[0]
    for more in parts[1:]:
        rows = rows.union(more)
    rows = rows.filter("feature_id <> 'text:'").join(evidence_counts(documents), ["doc", "path"], "left")
    return rows.select("doc", F.col("o").alias("ord"), "feature_id", "label", "feature_class", "slot", F.coalesce("evidence", F.lit(0)).alias("evidence"), "path", "modifier")


def document_features(documents: DataFrame) -> DataFrame:
    """discovery.fingerprints() of imported documents (doc, source, body): one row a feature of a document."""
    found = scanned_documents(documents)
    features = discovery.fingerprints(asserted_features(documents, found))
    return features.withColumn("label", F.left("label", F.lit(200)))


def diseases(documents: DataFrame) -> DataFrame:
    """(doc, name, mondo_id, description, category, aliases, parents, updated, warning): who a document is about.

    A term that is no MONDO id gives way to the first one among the mappings, with the warning MONDO_FROM_MAPPINGS.
    """
    rows = documents.filter("body is not null").select("doc", "body")
    own = ingest.descriptor_id(corpus.part("body", "$.disease_term"))
    mapped = F.transform(ingest.as_sequence(corpus.part("body", "$.mappings.mondo_mappings")), ingest.descriptor_id)
    is_mondo = lambda x: F.startswith(x, F.lit("MONDO:"))
    first = F.get(F.filter(mapped, is_mondo), F.lit(0))
    direct = F.when(is_mondo(own), own)
    text = lambda slot: corpus.field("body", f"$.{slot}")
    return rows.select(
        "doc", text("name").alias("name"), F.coalesce(direct, first).alias("mondo_id"), text("description").alias("description"), text("category").alias("category"),
        corpus.listed(corpus.part("body", "$.synonyms")).alias("aliases"), corpus.listed(corpus.part("body", "$.parents")).alias("parents"),
        F.coalesce(text("updated_date"), text("creation_date")).alias("updated"), F.when(direct.isNull() & first.isNotNull(), "MONDO_FROM_MAPPINGS").alias("warning"),
    )


def document_fingerprints(documents: DataFrame) -> DataFrame:
    """One row a document: its name and id, its phenotypes, genes, node labels, variant effects, treatments and organisms, each sorted, and
    what the features cover: counts by class, those with and without an id, nodes, edges, evidence, and classes that are missing."""
    found = scanned_documents(documents)
    features = discovery.fingerprints(asserted_features(documents, found))
    by_class = features.groupBy("doc", "feature_class").agg(F.count("*").alias("n"), F.count_if(F.contains("feature_id", F.lit(":"))).alias("grounded"))
    covered = by_class.groupBy("doc").agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("feature_class", "n")))).alias("by_class"), F.sum("grounded").alias("grounded"), F.sum(F.col("n") - F.col("grounded")).alias("free_text"),
    )
    united = lambda df, c, to: df.filter(F.col(c).isNotNull()).groupBy("doc").agg(F.array_sort(F.collect_set(c)).alias(to))
    claimed = corpus.claims(documents).groupBy("doc").agg(F.count_if(F.col("kind") != "edge").alias("nodes"), F.count_if(F.col("kind") == "edge").alias("edges"))
    loose = corpus.referenced_nodes(corpus.graph_edges(documents)).groupBy("doc").agg(F.count("*").alias("loose"))
    evidence = evidence_counts(documents).groupBy("doc").agg(F.sum("evidence").alias("evidence_items"))
    labels = corpus.graph_nodes(documents).select("doc", "label").unionAll(corpus.referenced_nodes(corpus.graph_edges(documents)).select("doc", "label"))
    out = diseases(documents).select("doc", "name", "mondo_id").join(covered, "doc", "left")
    for df, c, to in (
        (corpus.phenotypes(documents), "hpo_id", "phenotype_ids"), (corpus.genes(documents).filter("symbol is not null"), "hgnc_id", "gene_ids"), (labels, "label", "node_labels"),
        *[(found.filter(F.col("kind") == k), "term", to) for k, to in (("variant_effect", "variant_effects"), ("modality", "modalities"), ("organism", "organisms"))],
    ):
        out = out.join(united(df, c, to), "doc", "left").withColumn(to, F.coalesce(to, F.array().cast("array<string>")))
    out = out.join(claimed, "doc", "left").join(loose, "doc", "left").join(evidence, "doc", "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    held = F.coalesce(F.map_keys("by_class"), F.array().cast("array<string>"))
    return out.withColumns({
        "nodes": zero("nodes") + zero("loose"), "edges": zero("edges"), "evidence_items": zero("evidence_items"), "grounded": zero("grounded"), "free_text": zero("free_text"),
        "missing": F.array_except(F.array(*map(F.lit, CLASSES)), held),
    }).drop("loose")
