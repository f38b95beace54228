"""Imported documents, literature, projection and discovery over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text
from ..operators import corpus, discovery, fingerprint, graph, ingest, literature, ontology, projection
from ..operators.checkpoints import settled
from .bindings import ANNOTATIONS, TERMS, bind, query
from .retrieval import edges_of

# documents: an order with its lines as mechanism nodes, each leading to the line with the next number; ids with more colons,
# evidence that is no object or has no such DOI, and numbers that must stay as they are written

LINES = "select l_orderkey doc, l_linenumber line, min(l_quantity) q, min(l_suppkey) s from {lineitem} group by l_orderkey, l_linenumber"
ITEMS = """parse_json(case when x.q <= 25 then '[]' when x.s % 5 = 0 then to_json(array(concat('PMID:', x.s)))
  else to_json(array(named_struct('reference', concat(if(x.s % 5 = 1, 'doi:nope', 'PMID:'), x.s), 'supports', if(x.q > 40, 'REFUTE', 'SUPPORT'), 'snippet', if(x.q > 45, '', 'words')))) end)"""
GENE = "concat(case x.s % 3 when 0 then 'hgnc:' when 1 then 'chebi:a:' else 'reactome:R-' end, x.s)"
BODIES = f"""select doc, to_json(named_struct('name', cast(doc as string), 'pathophysiology', transform(array_sort(collect_list(struct(line, q, s))), x -> named_struct('name', concat('n', x.line),
  'biological_scale', case when x.q < 10 then 'Molecular level' when x.q < 20 then 'cell' end, 'genes', array(named_struct('preferred_term', concat('G', x.s), 'term', named_struct('id', {GENE}))),
  'evidence', {ITEMS}, 'downstream', array(named_struct('target', concat('n', x.line + 1), 'causal_link_type', 'DIRECT')))),
  'phenotypes', array(named_struct('name', 'n1', 'phenotype_term', named_struct('term', named_struct('id', concat('HP:', lpad(doc, 7, '0')))))))) json from ({LINES}) x group by doc"""
PLACED = f"t as (select *, row_number() over (partition by doc order by line) - 1 i from ({LINES}) x)"
#: A section as a document's text has it.
MEASURES = ', "measures": [1.0, {"é": 1e3, "b": ["x",  2]}]}'


def texts(spark, d):
    rows = bind(spark, d, BODIES)
    return rows.select("doc", F.concat(F.expr("left(json, length(json) - 1)"), F.lit(MEASURES)).alias("source"))


def bodies(spark, d):
    return parsed(texts(spark, d))


def parsed(rows):
    """Documents with their bodies, written once: every typed table reads them, and none makes their text and parses it again."""
    return settled(rows.withColumn("body", F.parse_json("source")))


@query(
    "nested_paths",
    f"""with {PLACED}, n as (select count(*) n, count(distinct doc) d, count(*) filter (q > 25) e, count(*) filter (q > 25 and s % 5 <> 0) o, count(*) filter (q < 20) b from t), p as (select unnest([
      ('name', d), ('pathophysiology', d), ('phenotypes', d), ('phenotypes[]', d), ('phenotypes[].name', d), ('phenotypes[].phenotype_term', d),
      ('phenotypes[].phenotype_term.term', d), ('phenotypes[].phenotype_term.term.id', d),
      ('measures', d), ('measures[]', 2 * d), ('measures[].é', d), ('measures[].b', d), ('measures[].b[]', 2 * d),
      ('pathophysiology[]', n), ('pathophysiology[].name', n), ('pathophysiology[].biological_scale', b), ('pathophysiology[].genes', n), ('pathophysiology[].genes[]', n),
      ('pathophysiology[].genes[].preferred_term', n), ('pathophysiology[].genes[].term', n), ('pathophysiology[].genes[].term.id', n),
      ('pathophysiology[].evidence', n), ('pathophysiology[].evidence[]', e), ('pathophysiology[].evidence[].reference', o),
      ('pathophysiology[].evidence[].supports', o), ('pathophysiology[].evidence[].snippet', o),
      ('pathophysiology[].downstream', n), ('pathophysiology[].downstream[]', n), ('pathophysiology[].downstream[].target', n),
      ('pathophysiology[].downstream[].causal_link_type', n)]) x from n) select x[1] path, cast(x[2] as bigint) n from p where x[2] > 0""",
)
def nested_paths(spark, d):
    return ingest.path_totals(bodies(spark, d))


@query(
    "imported_edges",
    f"""with {PLACED} select doc, 'pathophysiology[' || i || '].downstream[0]' path, 'n' || line source, 'n' || (line + 1) target,
      case when (doc, line + 1) not in (select (doc, line) from t) and line + 1 <> 1 then 'UNSPECIFIED' when q2 is null then 'PHENOTYPE' when q2 < 10 then 'MOLECULAR_EVENT'
        when q2 < 20 then 'CELLULAR_PROCESS' else 'UNSPECIFIED' end category, q2 is null and line + 1 <> 1 dangling
    from (select t.*, u.q q2 from t left join t u on u.doc = t.doc and u.line = t.line + 1) z""",
)
def imported_edges(spark, d):
    return corpus.graph_edges(bodies(spark, d)).select("doc", "path", "source", "target", "category", "dangling")


@query(
    "imported_claims",
    f"""with {PLACED} select doc, 'node' kind, 'pathophysiology[' || i || ']' path, cast(doc as varchar) subject, 'n' || line "object", 'n' || line || ' is represented in the mechanism for ' || doc || '.' "statement" from t
    union all select doc, 'edge', 'pathophysiology[' || i || '].downstream[0]', 'n' || line, 'n' || (line + 1), 'n' || line || ' contributes to n' || (line + 1) || '.' from t
    union all select distinct doc, 'phenotype', 'phenotypes[0]', cast(doc as varchar), 'n1', doc || ' is associated with phenotype n1.' from t""",
)
def imported_claims(spark, d):
    return corpus.claims(bodies(spark, d)).select("doc", "kind", "path", "subject", "object", "statement")


#: Each item's warning: what it is, what it lacks, or its reference.
WARNED = "case when s % 5 = 0 then 'EVIDENCE_NOT_AN_OBJECT' when q > 45 then 'EVIDENCE_WITHOUT_SNIPPET' when s % 5 = 1 then 'INVALID_REFERENCE_SYNTAX' end"


@query(
    "imported_evidence",
    f"""with {PLACED}, w as (select *, {WARNED} warning from t where q > 25)
    select doc, 'pathophysiology[' || i || '].evidence[0]' path, case when s % 5 <> 0 then case when s % 5 = 1 then 'doi:nope' else '' end || s end identifier,
      case when warning is null then case when q > 40 then 'REFUTES' else 'SUPPORTS' end end relation, warning from w""",
)
def imported_evidence(spark, d):
    items = corpus.claim_evidence(corpus.claims(bodies(spark, d)))
    return corpus.imported_evidence(items).select("doc", "path", "identifier", "relation", "warning")


@query(
    "import_warnings",
    f"""with {PLACED} select doc, 'DANGLING_EDGE_TARGET' code, 'pathophysiology[' || i || '].downstream[0].target' path from t
      where not exists (select 1 from t u where u.doc = t.doc and u.line = t.line + 1) and line <> 0
    union all select doc, 'PHENOTYPE_LABEL_SHADOWED', 'phenotypes[0].name' from t where line = 1
    union all select doc, {WARNED}, 'pathophysiology[' || i || '].evidence[0]' || case when s % 5 = 1 and q <= 45 then '.reference' else '' end from t where q > 25 and (s % 5 < 2 or q > 45)""",
)
def import_warnings(spark, d):
    return corpus.import_warnings(bodies(spark, d))


@query(
    "imported_annotations",
    f"""with {PLACED} select doc, 'n' || line label, case s % 3 when 0 then 'HGNC:' when 1 then 'CHEBI:a:' else 'reactome:R-' end || s feature_id, 'genetic' feature_class from t""",
)
def imported_annotations(spark, d):
    return ingest.annotations(ingest.mechanism_nodes(bodies(spark, d))).select("doc", "label", "feature_id", "feature_class")


@query(
    "kept_records",
    f"""with d as (select distinct doc from ({LINES}) x)
    select doc, 'measures[0]' path, '{{{{"value": 1.0}}}}' payload, sha256('{{{{"value": 1.0}}}}') "sha256", 'UNDECLARED_TOP_LEVEL_SECTION' warning from d
    union all select doc, 'measures[1]', '{{{{"é": 1e3, "b": ["x",  2]}}}}', sha256('{{{{"b": ["x", 2], "\\u00e9": 1000.0}}}}'), 'UNDECLARED_TOP_LEVEL_SECTION' from d""".replace("{{", "{").replace("}}", "}"),
)
def kept_records(spark, d):
    return corpus.preserved_records(bodies(spark, d), ("genetic",)).select("doc", "path", "payload", "sha256", "warning")


@query(
    "candidate_metrics",
    f"""with recursive {PLACED}, run as (select doc, line, line - row_number() over (partition by doc order by line) g from t), c as (select doc, max(n) longest from (select doc, g, count(*) n from run group by doc, g) x group by doc)
    select doc, count(*) nodes, count(*) edges, count(*) edges_without_evidence, count(*) filter (q > 40 and s % 5 <> 0) refute_or_no_evidence_items, cast(1 as bigint) phenotypes,
      count(*) filter (q > 25 and q <= 45 and s % 5 > 1) evidence_items, any_value(longest) longest_chain, true longest_exact from t join c using (doc) group by doc""",
)
def candidate_metrics(spark, d):
    found = corpus.candidate_metrics(bodies(spark, d))
    return found.select("doc", "nodes", "edges", "edges_without_evidence", "refute_or_no_evidence_items", "phenotypes", "evidence_items", "longest_chain", "longest_exact")


#: Prose that a document adds by its number.
PROSE = "case doc % 3 when 0 then 'Gene Therapy, then a Transplantation' when 1 then 'small molecules' else 'none' end"
KEPT = """concat(left(source, length(source) - 1), ', "treatments": [{{"name": "', PROSE, '"}}], "animal_models": ["a ', if(doc % 2 = 0, 'Mouse', 'zebrafish'), '"]}}')""".replace("{{", "{").replace("}}", "}")


@query(
    "document_features",
    f"""with {PLACED}, g as (select doc, case s % 3 when 0 then 'HGNC:' when 1 then 'CHEBI:a:' else 'reactome:R-' end || s feature_id, 'G' || s label, 'genetic' feature_class,
        cast(sum(case when q > 25 and q <= 45 and s % 5 > 1 then 1 else 0 end) as bigint) evidence, string_agg('pathophysiology[' || i || ']', ',' order by 'pathophysiology[' || i || ']') paths from t group by doc, s),
      d as (select distinct doc from t), p as (select doc, lower({PROSE}) prose from d)
    select * from g
    union all select doc, 'HP:' || lpad(cast(doc as varchar), 7, '0'), 'n1', 'phenotype', 0, 'phenotypes[0]' from d
    union all select doc, 'organism:' || case when doc % 2 = 0 then 'Mus musculus' else 'Danio rerio' end, case when doc % 2 = 0 then 'Mus musculus' else 'Danio rerio' end, 'model_organism', 0, 'animal_models' from d
    union all select doc, 'modality:' || m, m, 'therapeutic', 0, 'treatments' from p, (select unnest(['gene therapy', 'transplant', 'small molecule']) m) m where contains(prose, m)""",
)
def document_features(spark, d):
    docs = parsed(texts(spark, d).withColumn("source", F.expr(KEPT.replace("PROSE", PROSE))))
    found = fingerprint.document_features(docs)
    return found.select("doc", "feature_id", "label", "feature_class", "evidence", F.array_join("paths", ",").alias("paths"))


# features and people

NOTES = """select l_orderkey doc, l_linenumber * 1000000000000 + l_partkey * 1000000 + l_suppkey * 100 + cast(l_quantity as bigint) ord, concat('p:', l_partkey) feature_id, concat('label ', l_suppkey) label, l_returnflag feature_class, l_linestatus slot, cast(l_quantity as bigint) evidence,
  concat('path', l_linenumber) path, case when l_tax > 0.04 then lower(l_returnflag) end modifier from {lineitem}"""


@query(
    "fingerprint_features",
    f"""with n as ({NOTES}) select doc, feature_id, first(label order by ord) label, first(feature_class order by ord) feature_class, cast(sum(evidence) as bigint) evidence,
      (select string_agg(p, ',' order by p) from (select distinct path p from n m where m.doc = n.doc and m.feature_id = n.feature_id) x) paths, coalesce(string_agg(distinct upper(modifier), ',' order by upper(modifier)), '') modifiers from n group by doc, feature_id""",
)
def fingerprint_features(spark, d):
    found = discovery.fingerprints(bind(spark, d, NOTES))
    return found.select("doc", "feature_id", "label", "feature_class", "evidence", F.array_join("paths", ",").alias("paths"), F.array_join("modifiers", ",").alias("modifiers"))


@query(
    "fingerprint_coverage",
    f"""with n as (select distinct doc, feature_id, first(feature_class) over (partition by doc, feature_id order by ord) c from ({NOTES}) x), k as (select doc, c, count(*) n from n group by doc, c)
    select doc, string_agg(c || '=' || n, ',' order by c) by_class, cast(sum(n) as bigint) grounded, array_to_string(list_filter(['A', 'N', 'R'], lambda x: not list_contains(list(c), x)), ',') missing from k group by doc""",
)
def fingerprint_coverage(spark, d):
    found = discovery.fingerprint_coverage(discovery.fingerprints(bind(spark, d, NOTES)), ["A", "N", "R"])
    pairs = F.transform(F.map_entries("by_class"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string")))
    return found.select("doc", F.array_join(pairs, ",").alias("by_class"), "grounded", F.array_join("missing", ",").alias("missing"))


@query(
    "canonical_terms",
    f"""with t as ({TERMS}), a as (select entity_id, case when hash_ % 3 = 0 then 'ALT' || term_id when hash_ % 3 = 1 then term_id else 'X' || term_id end term_id from (select *, cast(substr(term_id, 2) as bigint) hash_ from ({ANNOTATIONS}) y) x)
    select entity_id, term_id, case when term_id like 'ALT%' then substr(term_id, 4) when term_id like 'S%' then term_id end canonical from a""",
)
def canonical_terms(spark, d):
    terms = bind(spark, d, TERMS)
    number = F.substring("term_id", 2, 20).cast("long") % 3
    asked = bind(spark, d, ANNOTATIONS).withColumn("term_id", F.when(number == 0, F.concat(F.lit("ALT"), "term_id")).when(number == 1, F.col("term_id")).otherwise(F.concat(F.lit("X"), "term_id")))
    alts = terms.select(F.concat(F.lit("ALT"), "term_id").alias("alt_id"), "term_id")
    return ontology.canonical(asked, terms, alts)


PAPERS = "select l_orderkey pmid, 1990 + l_orderkey % 30 as `year`, array_sort(collect_set(concat('Dr. ', s_name))) authors, array_sort(collect_set(concat('Lab ', s_nationkey))) affiliations from {lineitem} join {supplier} on s_suppkey = l_suppkey group by l_orderkey"
PAPERS_DUCK = """select l_orderkey pmid, 1990 + l_orderkey % 30 y, list_sort(list(distinct 'Dr. ' || s_name)) authors, list_sort(list(distinct 'Lab ' || s_nationkey)) affiliations from {lineitem} join {supplier} on s_suppkey = l_suppkey group by l_orderkey"""


@query(
    "people",
    f"""with p as ({PAPERS_DUCK}), e as (select distinct pmid, y, affiliations, unnest([authors[1], authors[len(authors)]]) author from p), k as (select *, trim(regexp_replace(lower(author), '[^a-z0-9]+', '-', 'g'), '-') person_id from e)
    select person_id, string_agg(pmid, ',' order by y desc, pmid) publications, (select string_agg(a, ',' order by a) from (select distinct unnest(affiliations) a from k j where j.person_id = k.person_id) z) affiliations from k group by person_id""",
)
def people(spark, d):
    found = discovery.people(bind(spark, d, PAPERS))
    return found.select("person_id", F.array_join(F.transform("publications", lambda p: p.cast("string")), ",").alias("publications"), F.array_join(F.array_sort("affiliations"), ",").alias("affiliations"))


RULES = [("license", "mit license", ["mit license"]), ("license", "any license", ["license", "licensed"]), ("secret", "a secret", ["password", "api_key", "secret"]), ("word", "the article", ["the "])]


@query(
    "requirements",
    """select doc_id experiment_id, 'license' category, case when contains(lower(text), 'mit license') then 'mit license' else 'any license' end requirement from {documents} where contains(lower(text), 'license')
    union all select doc_id, 'secret', 'a secret' from {documents} where contains(lower(text), 'password') or contains(lower(text), 'api_key') or contains(lower(text), 'secret') union all select doc_id, 'word', 'the article' from {documents} where contains(lower(text), 'the ')""",
)
def requirements(spark, d):
    return discovery.requirements(bind(spark, d, "select doc_id experiment_id, text from {documents}"), RULES)


@query("search_breadth", "select o_orderkey, case when o_orderstatus = 'P' then 'FAILED' when o_totalprice < 5000 then 'NOT_STARTED' when o_totalprice > 2000 * 40 then 'TOO_BROAD' when o_totalprice < 10000 then 'CHECKED_EMPTY' else 'CHECKED' end state from {orders}")
def search_breadth(spark, d):
    rows = bind(spark, d, "select o_orderkey, o_orderstatus = 'P' failed, case when o_totalprice < 5000 then null when o_totalprice < 10000 then 0 else cast(ceil(o_totalprice / 40) as bigint) end hits from {orders}")
    return discovery.breadth(rows).select("o_orderkey", "state")


@query("core_names", r"select p_partkey, trim(regexp_replace(regexp_replace(regexp_replace(lower(p_name || ' Type ' || p_size || 'a, early-onset ' || p_brand), '[^a-z0-9 ]+', ' ', 'g'), '\b(type|subtype|form|variant|autosomal|recessive|dominant|x[- ]?linked|early|late|infantile|juvenile|adult|onset|[0-9]+[a-z]?|[ivx]+)\b', ' ', 'g'), '\s+', ' ', 'g')) core from {part}")
def core_names(spark, d):
    name = F.concat("p_name", F.lit(" Type "), F.col("p_size").cast("string"), F.lit("a, early-onset "), "p_brand")
    return bind(spark, d, "select * from {part}").select("p_partkey", text.core_name(name).alias("core"))


# literature


@query(
    "publication_assessment",
    r"""with d as (select doc_id, left(text, 60) title, text abstract from {documents}), x as (select *, title || ' ' || abstract t from d),
    y as (select *, contains(lower(t), 'license') or contains(lower(t), 'token') l, contains(lower(t), 'secret') or contains(lower(t), 'password') r, contains(t, 'AKIA') la, contains(t, 'MIT') ra from x),
    z as (select *, (l and r) or (not l and r and la) or (not r and l and ra) b, (not l and r and la) or (not r and l and ra) c,
      regexp_matches(t, '(?i)\b(interact\w*|bind\w*|complex|co-?immunoprecipitat\w*|substrate|ubiquitinat\w*|phosphorylat\w*|stabilis\w*|stabiliz\w*|degrad\w*|regulat\w*|colocaliz\w*|co-?localis\w*|epistat\w*|modifier)\b') m,
      not regexp_matches(title, '(?i)\b(review|overview|perspective|commentary|editorial|meta-analysis)\b') as "primary" from y)
    select doc_id, b and m direct, "primary", case when b and m then 'SUPPORTS' else 'QUALIFIES' end polarity,
      concat_ws(',', case when c then 'ACRONYM_BY_CONTEXT' end, case when not b then 'NOT_CONFIRMED' end, case when b and not m then 'CO_MENTION_ONLY' end, case when not "primary" then 'SECONDARY_PUBLICATION' end) caveats from z where abstract is not null""",
)
def publication_assessment(spark, d):
    rows = bind(spark, d, "select doc_id, left(text, 60) title, text abstract, array('license', 'token') left_terms, array('secret', 'password') right_terms, array('AKIA') left_acronyms, array('MIT') right_acronyms from {documents} where text is not null")
    return literature.assess_records(rows, text.ASCII).select("doc_id", "direct", "primary", "polarity", F.array_join("caveats", ",").alias("caveats"))


CITED = """select event_id, case event_type when 'click' then concat('PMID:', event_id) when 'error' then concat('doi:10.1234/', user_id) when 'purchase' then concat('PMCID:PMC', user_id) else concat('ORPHA:', user_id) end reference from {events}"""
KNOWN = "select 'PMC' form, cast(c_custkey as string) `key`, c_custkey * 10 pmid from {customer} union all select 'DOI', concat('10.1234/', c_custkey), case when c_custkey % 2 = 0 then c_custkey * 100 end from {customer}"


@query(
    "resolved_references",
    f"""with c as ({CITED}), k as ({KNOWN.replace('`', chr(34))}), f as (select *, case when reference like 'doi%' then 'DOI' when reference like 'PMCID%' then 'PMC' end form, regexp_replace(reference, '^(doi:|PMCID:PMC)', '') as "key" from c)
    select event_id, case when reference like 'PMID%' then reference when pmid is not null then 'PMID:' || pmid end canonical, case when reference like 'PMID%' then 'direct' when f.form is null then 'no_resolver' when pmid is null then 'unresolved' when f.form = 'PMC' then 'ncbi_id_converter' else 'europe_pmc_doi' end method,
    case when reference like 'PMID%' then reference when pmid is not null then 'PMID:' || pmid else reference end identity_ from f left join k on k.form = f.form and k."key" = f."key" """,
)
def resolved_references(spark, d):
    return literature.resolve_references(bind(spark, d, CITED), bind(spark, d, KNOWN)).select("event_id", "canonical", "method", F.col("identity").alias("identity_"))


@query(
    "grant_relevance",
    r"""select doc_id, case when a and b and n_chars % 2 = 0 then 'QUALIFIES' when a and b then 'EXPIRED' when a then 'CONTEXT_MISMATCH' when b then 'SUBJECT_MISMATCH' else 'RETRIEVED_BY_AMBIGUOUS_TOKEN' end disposition
    from (select *, regexp_matches(source || ' ' || text, '\bMIT\b') a, regexp_matches(source || ' ' || text, '(?i)license|terms') b from {documents} where text is not null and source is not null) x""",
)
def grant_relevance(spark, d):
    rows = bind(spark, d, "select doc_id, source title, text abstract, n_chars % 2 = 0 active from {documents} where text is not null and source is not null")
    return literature.grant_relevance(rows, "MIT", "license|terms").select("doc_id", "disposition")


@query(
    "capability_coverage",
    """with c as (select p_brand category, l_suppkey name, row_number() over (partition by p_brand order by l_orderkey, l_linenumber, l_partkey, l_suppkey) n from {lineitem} join {part} on p_partkey = l_partkey where l_quantity > 30)
    select p_partkey requirement, name candidate, case when name is null then 'MISSING' else 'CANDIDATE_IDENTIFIED' end status from (select p_partkey, case when p_size > 45 then 'none' else p_brand end category from {part}) r left join c on c.category = r.category and n = 1""",
)
def capability_coverage(spark, d):
    candidates = bind(spark, d, "select p_brand category, l_suppkey name, struct(l_orderkey, l_linenumber, l_partkey, l_suppkey) ord from {lineitem} join {part} on p_partkey = l_partkey where l_quantity > 30")
    required = bind(spark, d, "select p_partkey requirement, case when p_size > 45 then 'none' else p_brand end category from {part}")
    return literature.capability_coverage(required, candidates).select("requirement", "candidate", "status")


@query("most_flagged", "select l_orderkey object_id, count(*) findings from {lineitem} group by l_orderkey order by findings desc, l_orderkey limit 15")
def most_flagged(spark, d):
    return literature.most_flagged(bind(spark, d, "select l_orderkey object_id, l_returnflag code from {lineitem}"))


# projection

ROLES = "select concat('c', l_orderkey) claim_id, concat('e', l_suppkey, '#', l_linenumber) evidence_id, case l_returnflag when 'A' then 'direct_supporting' when 'N' then 'indirect' else 'background_only' end evidence_role from {lineitem}"
CLAIMS = "select concat('c', o_orderkey) claim_id, concat('u', o_custkey) upstream_id, o_orderpriority rule_applied from {orders}"
UPSTREAM = "select concat('u', c_custkey) claim_id, c_name statement from {customer} where c_custkey % 10 <> 0"
SEEN = "select concat('e', s_suppkey) evidence_id, s_name source_identifier from {supplier}"


def projected(spark, d):
    return projection.project({"atomic": bind(spark, d, CLAIMS), "upstream": bind(spark, d, UPSTREAM), "observations": bind(spark, d, SEEN), "evidence_roles": bind(spark, d, ROLES)})


@query(
    "projection_nodes",
    f"""select claim_id id, 'Claim' as "label", '{{{{"kind":"CURATED","statement":"' || statement || '"}}}}' properties from ({UPSTREAM}) a union all select claim_id, 'Claim', '{{{{"kind":"EXTRACTED","rule_applied":"' || rule_applied || '"}}}}' from ({CLAIMS}) b
    union all select evidence_id, 'Evidence', '{{{{"source_identifier":"' || source_identifier || '"}}}}' from ({SEEN}) c""".replace("{{", "{").replace("}}", "}"),
)
def projection_nodes(spark, d):
    return projected(spark, d)[0]


EDGES_SQL = f"""select distinct claim_id start_id, split_part(evidence_id, '#', 1) end_id, 'STUDIES' as "type", '{{{{"evidence_role":"' || evidence_role || '"}}}}' properties from ({ROLES}) a
  union all select claim_id, upstream_id, 'GENERATED_FROM', '{{{{}}}}' from ({CLAIMS}) b""".replace("{{", "{").replace("}}", "}")


@query("projection_relationships", EDGES_SQL)
def projection_relationships(spark, d):
    return projected(spark, d)[1]


@query("projection_dangling", f"""select * from ({EDGES_SQL}) e where end_id not in (select claim_id from ({UPSTREAM}) u union all select evidence_id from ({SEEN}) s)""")
def projection_dangling(spark, d):
    nodes, edges = projected(spark, d)
    return projection.check(nodes, edges)


@query("louvain_communities")
def louvain_communities(spark, d):
    return graph.louvain(edges_of(spark, d))
