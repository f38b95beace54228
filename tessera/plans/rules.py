"""Rule cascades, text functions and the store over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import dates, ids, text
from ..operators import action, artifacts, compare, evidence, pairs, store, synthesis
from .bindings import PAIRS, bind, query

# evidence

#: One order is a claim, its lines are observations; fixed arrays are the claim's scopes.
REVIEWABLE = """select l_orderkey claim_id, l_linenumber line, l_suppkey source, l_partkey observed,
    case when l_quantity > 45 then 'other' else 'activity' end readout,
    case when l_quantity <= 12 then 'DECREASED' when l_quantity <= 20 then 'UNCHANGED' when l_quantity <= 28 then 'PARTIALLY_RETAINED' when l_quantity <= 32 then 'INCREASED' when l_quantity <= 40 then 'ABOLISHED' else 'UNCLEAR' end effect,
    case when l_returnflag = 'A' and l_quantity < 8 then 'BACKGROUND_CITATION' else 'PRIMARY_RESULT' end origin,
    case when l_tax > 0.07 then 'other disease' else 'disease' end disease,
    case when l_discount > 0.07 then 'Neuron' when l_discount > 0.02 then 'fibroblast' else null end cell,
    case when l_suppkey > 60 then 'v1' when l_suppkey > 40 then 'v9' else null end variant,
    case when l_suppkey > 20 then 'point' else 'truncating' end variant_class,
    case when l_linestatus = 'O' then 'VERIFIED' when l_returnflag = 'R' then 'SPAN_NOT_LOCATED' else 'UPSTREAM_ATTESTED' end citation
  from {lineitem}"""

REVIEWED = f"""rv as ({REVIEWABLE}),
  f0 as (select *, case when readout <> 'activity' then 'UNRELATED' when effect in ('DECREASED', 'ABOLISHED') then 'SUPPORTS' when effect = 'PARTIALLY_RETAINED' then 'QUALIFIES' when effect in ('UNCHANGED', 'INCREASED') then 'REFUTES' else 'NEUTRAL' end fit,
    disease = 'disease' disease_match, case when cell is not null then lower(cell) = 'neuron' end cell_type_match,
    case when variant = 'v1' then true when variant is null and variant_class = 'truncating' then true when variant is not null then false end variant_match, citation = 'UPSTREAM_ATTESTED' att from rv),
  f1 as (select *, case when citation not in ('VERIFIED', 'UPSTREAM_ATTESTED') then 'NEUTRAL' when fit in ('SUPPORTS', 'REFUTES') and (not disease_match or cell_type_match is false or att) then 'QUALIFIES' else fit end supports,
    origin = 'PRIMARY_RESULT' and citation in ('VERIFIED', 'UPSTREAM_ATTESTED') paper_generated from f0),
  f2 as (select *, case when origin = 'BACKGROUND_CITATION' then 'BACKGROUND_ONLY' when paper_generated and disease_match and variant_match is true and cell_type_match is not false and supports <> 'UNRELATED' then 'DIRECT' else 'INDIRECT' end directness from f1),
  reviews as (select *, case when directness = 'BACKGROUND_ONLY' or supports in ('NEUTRAL', 'UNRELATED') then 'NONE' when paper_generated and variant is not null and disease_match and variant_match is true and cell_type_match is not false and not att then 'CAUSAL' else 'ASSOCIATIONAL' end causal from f2)"""


def reviews(spark, d):
    rows = bind(spark, d, REVIEWABLE)
    listed = lambda c: F.when(F.col(c).isNull(), F.array().cast("array<string>")).otherwise(F.array(c))
    scopes = {"readout_scope": ["activity"], "expected_effect": ["DECREASED", "ABOLISHED"], "disease_scope": ["disease"], "cell_type_scope": ["neuron"], "variant_scope": ["v1", "v2"]}
    rows = rows.withColumns({k: F.array(*map(F.lit, v)) for k, v in scopes.items()}).withColumn("scope_class", F.lit("truncating"))
    return evidence.review(rows.withColumn("cell_types", listed("cell")).withColumn("variants", listed("variant")))


@query("evidence_critic", f"with {REVIEWED} select claim_id, line, source, observed, supports, directness, paper_generated, disease_match, cell_type_match, variant_match, causal from reviews")
def evidence_critic(spark, d):
    return reviews(spark, d).select("claim_id", "line", "source", "observed", "supports", "directness", "paper_generated", "disease_match", "cell_type_match", "variant_match", "causal")


CLAIMED = REVIEWED + """,
  cn as (select claim_id, count(*) filter (directness = 'DIRECT') direct, count(*) filter (directness = 'DIRECT' and supports = 'SUPPORTS') ds, count(*) filter (directness = 'DIRECT' and supports = 'REFUTES') dr,
    count(*) filter (directness = 'DIRECT' and supports = 'QUALIFIES') dq, count(distinct source) filter (directness = 'DIRECT' and supports = 'REFUTES') refuters from reviews group by claim_id),
  cl as (select claim_id, case when direct = 0 then 'A1' when ds > 0 and dr = 0 and dq = 0 then 'A2' when ds > 0 then 'A3' when dr > 0 and dq = 0 and refuters >= 2 then 'A4' when dr > 0 and dq > 0 then 'A5' when dr > 0 then 'A6' else 'A7' end rule from cn),
  claims as (select claim_id, rule, case rule when 'A1' then 'INSUFFICIENT_EVIDENCE' when 'A2' then 'SUPPORTED' when 'A3' then 'CONTEXT_DEPENDENT' when 'A4' then 'CONTRADICTED' when 'A5' then 'CONTEXT_DEPENDENT' when 'A6' then 'INSUFFICIENT_EVIDENCE' else 'PARTIALLY_SUPPORTED' end status from cl)"""


@query("atomic_synthesis", f"with {CLAIMED} select claim_id, status, rule from claims")
def atomic_synthesis(spark, d):
    return evidence.synthesize_claims(reviews(spark, d)).select("claim_id", "status", "rule")


EDGE_OF = "select o_orderkey claim_id, o_custkey edge_id from {orders}"


@query(
    "edge_synthesis",
    f"""with {CLAIMED}, ed as ({EDGE_OF}), s as (select edge_id, count(*) n, count(*) filter (status = 'SUPPORTED') s, count(*) filter (status in ('CONTRADICTED', 'CONTEXT_DEPENDENT', 'PARTIALLY_SUPPORTED')) v, count(*) filter (status = 'CONTRADICTED') c from claims join ed using (claim_id) group by edge_id)
    select edge_id, n claims, case when s = n then 'SUPPORTED' when s > 0 and v > 0 then 'CONTEXT_DEPENDENT' when s > 0 then 'PARTIALLY_SUPPORTED' when c > 0 then 'CONTRADICTED' else 'INSUFFICIENT_EVIDENCE' end status,
    case when s = n then 'E1' when s > 0 and v > 0 then 'E2' when s > 0 then 'E3' when c > 0 then 'E4' else 'E5' end rule from s""",
)
def edge_synthesis(spark, d):
    claims = evidence.synthesize_claims(reviews(spark, d)).join(bind(spark, d, EDGE_OF), "claim_id")
    return evidence.synthesize_edges(claims).select("edge_id", "claims", "status", "rule")


ITEMS = """select l_orderkey object_id, case when l_quantity < 20 then 'PMID' when l_quantity < 30 then 'PMCID' when l_quantity < 35 then 'DOI' else 'OTHER' end kind,
  case when l_tax < 0.02 then null when l_tax < 0.06 then 'SUPPORT' when l_tax < 0.07 then 'REFUTE' else 'NO_EVIDENCE' end supports,
  case l_returnflag when 'A' then 'BACKGROUND' when 'R' then 'REVIEW_SYNTHESIS' else null end quote_role, case l_linestatus when 'F' then 'MODEL_ORGANISM' else 'IN_VITRO' end evidence_source from {lineitem}"""
OBJECTS = "select o_orderkey object_id, o_orderstatus <> 'P' is_mechanism, case when o_orderpriority = '1-URGENT' then 'ESTABLISHED' end confidence, case when o_orderpriority = '5-LOW' then 'FREQUENT' end frequency from {orders}"


@query(
    "claim_fit_findings",
    f"""with it as ({ITEMS}), ob as ({OBJECTS}), a as (select object_id, count(*) filter (coalesce(supports, 'SUPPORT') = 'SUPPORT') b,
      count(*) filter (coalesce(supports, 'SUPPORT') = 'SUPPORT' and quote_role = 'BACKGROUND') bg, count(*) filter (coalesce(supports, 'SUPPORT') = 'SUPPORT' and quote_role = 'REVIEW_SYNTHESIS') rv,
      count(*) filter (coalesce(supports, 'SUPPORT') = 'SUPPORT' and kind = 'OTHER') ot, count(*) filter (coalesce(supports, 'SUPPORT') = 'SUPPORT' and evidence_source = 'MODEL_ORGANISM') mo,
      count(*) filter (supports in ('REFUTE', 'NO_EVIDENCE')) ag, bool_or(kind = 'PMID') and bool_or(kind = 'PMCID') dual from it group by object_id), j as (select * from a join ob using (object_id))
    select object_id, 'BACKGROUND_ONLY_SUPPORT' code, 'HIGH' severity from j where b > 0 and bg = b
    union all select object_id, 'REVIEW_ONLY_SUPPORT', 'MEDIUM' from j where b > 0 and rv = b and is_mechanism
    union all select object_id, 'CONFIDENCE_CONTRADICTS_EVIDENCE', 'HIGH' from j where confidence = 'ESTABLISHED' and ag > 0
    union all select object_id, 'UNVERIFIABLE_SOLE_SUPPORT', 'MEDIUM' from j where b > 0 and ot = b and is_mechanism
    union all select object_id, 'DUAL_FORM_CITATION', 'LOW' from j where dual
    union all select object_id, 'HUMAN_FREQUENCY_MODEL_ONLY', 'HIGH' from j where frequency is not null and b > 0 and mo = b""",
)
def claim_fit_findings(spark, d):
    items = bind(spark, d, ITEMS).groupBy("object_id").agg(F.collect_list(F.struct("kind", "supports", "quote_role", "evidence_source")).alias("evidence"))
    return evidence.claim_fit(bind(spark, d, OBJECTS).join(items, "object_id"))


@query(
    "direct_edges_unsupported",
    """with n as (select l_orderkey doc, l_linenumber label, max(case when l_discount >= 0.05 then 1 else 0 end) e from {lineitem} group by all),
    g as (select doc, label source, lead(label) over (partition by doc order by label) target, e from n)
    select g.doc, g.source, g.target from g join n a on a.doc = g.doc and a.label = g.source join n b on b.doc = g.doc and b.label = g.target where target is not null and a.e = 0 and b.e = 0""",
)
def direct_edges_unsupported(spark, d):
    nodes = bind(spark, d, "select l_orderkey doc, l_linenumber label, max(case when l_discount >= 0.05 then 1 else 0 end) n_evidence from {lineitem} group by l_orderkey, l_linenumber")
    edges = bind(spark, d, "select doc, source, target, 'DIRECT' link, 0 n_evidence from (select doc, label source, lead(label) over (partition by doc order by label) target from (select distinct l_orderkey doc, l_linenumber label from {lineitem}) x) y where target is not null")
    return evidence.unsupported_direct_edges(edges, nodes)


# text

FOLD = "trim(regexp_replace(lower({}), '[^a-z0-9]+', ' ', 'g'))"


@query(
    "span_location",
    f"""with b as (select item_id, {FOLD.format('text')} span from {{benchmark}}), d as (select doc_id, {FOLD.format('text')} hay from {{documents}})
    select item_id, doc_id from d, b where span <> '' and contains(hay, span)""",
)
def span_location(spark, d):
    # a stated set of quotations (the benchmark's) against all documents
    docs, spans = bind(spark, d, "select doc_id, text from {documents}"), bind(spark, d, "select item_id, text span from {benchmark}")
    folded = docs.select("doc_id", text.fold(F.col("text")).alias("hay"))
    spans = spans.select("item_id", text.fold(F.col("span")).alias("span"))
    return evidence.located_spans(folded, spans)


@query(
    "citation_status",
    f"""with x as (select doc_id, case when doc_id % 11 = 0 then null else doc_id end identifier, source title, case when doc_id % 7 = 0 then null when doc_id % 5 = 0 then 'other' else upper(source) end resolved_title,
      left(text, 40) span, case when doc_id % 3 = 0 then substr(text, 20) else text end source_text, doc_id % 2 = 0 full_text from {{documents}}),
    f as (select *, {FOLD.format('title')} a, {FOLD.format('resolved_title')} b, {FOLD.format('span')} s, {FOLD.format('source_text')} h from x)
    select doc_id, case when identifier is null then 'NOT_CHECKABLE' when resolved_title is null then 'UNRESOLVED' when not (a = b or (a <> '' and (contains(b, a) or contains(a, b)))) then 'TITLE_MISMATCH'
      when s <> '' and contains(h, s) then 'VERIFIED' when full_text then 'SPAN_NOT_LOCATED' else 'UPSTREAM_ATTESTED' end status from f""",
)
def citation_status(spark, d):
    rows = bind(
        spark, d,
        """select doc_id, case when doc_id % 11 = 0 then null else doc_id end identifier, source title, case when doc_id % 7 = 0 then null when doc_id % 5 = 0 then 'other' else upper(source) end resolved_title,
        left(text, 40) span, case when doc_id % 3 = 0 then substr(text, 20) else text end source_text, doc_id % 2 = 0 full_text from {documents}""",
    )
    return evidence.check_citations(rows).select("doc_id", "status")


@query("sentence_split")
def sentence_split(spark, d):
    rows = bind(spark, d, "select doc_id, text from {documents}")
    return rows.select("doc_id", F.posexplode(text.sentences(F.col("text"))).alias("place", "sentence"))


@query(
    "finding_role",
    r"""select doc_id, case when regexp_matches(text, '(?i)\b(previously|previous stud\w+|has been (shown|reported|demonstrated)|it is (known|well established)|others have|reported that|earlier work)\b') then 'BACKGROUND_STATEMENT'
      when regexp_matches(text, '(?i)\b(we (show|demonstrate|report|find|identify|establish)\w*|this (study|work|report) (demonstrat\w+|show\w+|establish\w+|identif\w+)|here we\b|our (data|results|findings) (show|demonstrate|indicate|establish))') then 'PRIMARY_EXPERIMENTAL_RESULT'
      else 'BACKGROUND_STATEMENT' end finding_role from {documents}""",
)
def finding_role(spark, d):
    return bind(spark, d, "select doc_id, text from {documents}").select("doc_id", text.finding_role(F.col("text"), text.ASCII).alias("finding_role"))


@query(
    "marker_flags",
    r"""select doc_id, regexp_matches(text, '(?i)\b(review|overview|perspective|commentary|editorial|meta-analysis)\b') secondary,
      regexp_matches(text, '(?i)\b(interact\w*|bind\w*|complex|co-?immunoprecipitat\w*|substrate|ubiquitinat\w*|phosphorylat\w*|stabilis\w*|stabiliz\w*|degrad\w*|regulat\w*|colocaliz\w*|co-?localis\w*|epistat\w*|modifier)\b') direct_link,
      regexp_matches(text, '(?i)\b(iPSC|induced pluripotent|cell line|knock-?in|knock-?out|knockout|mouse model|murine|zebrafish|organoid|patient-derived|plasmid|construct|antibod\w+|reporter|transgenic|isogenic|biobank|repository|registry)\b') asset from {documents}""",
)
def marker_flags(spark, d):
    rows = bind(spark, d, "select doc_id, text from {documents}")
    mark = lambda words: text.marked(F.col("text"), words, text.ASCII)
    return rows.select("doc_id", mark(text.SECONDARY).alias("secondary"), mark(text.DIRECT_LINK).alias("direct_link"), mark(text.ASSET).alias("asset"))


#: Fixed values, for the oracle, which does not take the operators' own.
STOPWORDS = """'DNA', 'RNA', 'PCR', 'WES', 'WGS', 'MRI', 'CSF', 'ELISA', 'SDS', 'PBS', 'THE', 'AND', 'FOR', 'WITH', 'NOT', 'WERE', 'WAS', 'HAS', 'CAN', 'MAY',
  'USA', 'UK', 'EU', 'NIH', 'PMID', 'DOI', 'ATP', 'GTP', 'CNS', 'IQ'"""


@query(
    "acronym_extract",
    r"""select doc_id, array_to_string(list_sort(list_filter(list_distinct(regexp_extract_all(text, '\b([A-Z][A-Z0-9]{2,7})\b', 1)), lambda x: not list_contains(["""
    + STOPWORDS
    + r"""], x))), ',') tokens from {documents}""",
)
def acronym_extract(spark, d):
    rows = bind(spark, d, "select doc_id, text from {documents}")
    return rows.select("doc_id", F.array_join(F.array_sort(text.factor_tokens(F.col("text"), text.ASCII)), ",").alias("tokens"))


@query(
    "contact_scrub",
    r"""select doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '(?is)[\s\x0B]*(electronic address|e-?mail)[\s\x0B]*:.*$', ''),
      '[\p{L}\p{N}_.+-]+@[\p{L}\p{N}_-]+\.[\p{L}\p{N}_.-]+', '[email removed]', 'g'), '^[\s\x0B]+|[\s\x0B]+$', '', 'g'), ';+$', ''), '[\s\x0B]+$', '') as text from {documents}""",
)
def contact_scrub(spark, d):
    return bind(spark, d, "select doc_id, text from {documents}").select("doc_id", text.scrub_contact(F.col("text")).alias("text"))


@query("html_strip", r"select page_id, trim(regexp_replace(regexp_replace(html, '<[^>]+>', ' ', 'g'), '[ \t\n\f\r\x0B]+', ' ', 'g')) text from {pages}")
def html_strip(spark, d):
    return bind(spark, d, "select page_id, html from {pages}").select("page_id", text.strip_tags(F.col("html"), False).alias("text"))


@query("html_text")
def html_text(spark, d):
    return bind(spark, d, "select page_id, html from {pages}").select("page_id", text.strip_tags(F.col("html")).alias("text"))


@query("label_normalise", f"select doc_id, {FOLD.format('text')} label from {{documents}}")
def label_normalise(spark, d):
    return bind(spark, d, "select doc_id, text from {documents}").select("doc_id", text.normalize_label(F.col("text")).alias("label"))


REFS = """select event_id, case event_type when 'click' then concat('PMID:', cast(event_id as string)) when 'error' then concat('DOI:10.1234/AB', cast(user_id as string)) when 'purchase' then concat('PMCID:PMC', cast(event_id as string)) when 'signup' then concat('PMC', cast(event_id as string)) else concat('https://doi.org/10.1234/', cast(user_id as string)) end reference from {events}"""


@query(
    "reference_forms",
    f"""with r as ({REFS}) select event_id, case left(reference, 4) when 'PMID' then 'PMID' when 'PMCI' then 'PMCID' when 'DOI:' then 'DOI' else 'OTHER' end kind,
    case left(reference, 4) when 'PMID' then substr(reference, 6) when 'PMCI' then substr(reference, 7) when 'DOI:' then lower(substr(reference, 5)) else reference end identifier from r""",
)
def reference_forms(spark, d):
    return bind(spark, d, REFS).select("event_id", *text.split_reference(F.col("reference")))


# comparison of pairs: an order and the customer's next

PAIR_ROWS = f"""select p.l, p.r, a.o_orderpriority core_a, b.o_orderpriority core_b, case when a.o_totalprice < 20000 then a.o_orderstatus end mondo_a, case when b.o_totalprice < 20000 then b.o_orderstatus end mondo_b, a.o_totalprice price_a, b.o_totalprice price_b
  from ({PAIRS}) p join {{orders}} a on a.o_orderkey = p.l join {{orders}} b on b.o_orderkey = p.r"""
SETS = """select l_orderkey k, array_sort(collect_set(l_returnflag)) genes, array_sort(collect_set(cast(floor(l_quantity / 10) as int))) phenotypes, array_sort(collect_set(case when l_quantity < 10 then 'nonsense' when l_quantity < 20 then 'duplication' when l_quantity < 25 then 'missense' end)) effects, count(*) n from {lineitem} group by l_orderkey"""
SETS_DUCK = SETS.replace("collect_set(", "list(distinct ").replace("array_sort(", "list_sort(").replace("as int", "as int")
JOINED = f"s as ({SETS_DUCK}), pr as ({PAIR_ROWS}), j as (select pr.*, x.genes ga, y.genes gb, x.phenotypes pa, y.phenotypes pb, list_filter(x.effects, lambda e: e is not null) ea, list_filter(y.effects, lambda e: e is not null) eb, x.n na, y.n nb from pr join s x on x.k = l join s y on y.k = r)"
IDENTIFIED = (
    JOINED
    + """, k as (select *, len(list_intersect(ga, gb)) sh, len(list_filter(ga, lambda e: not list_contains(gb, e))) oa, len(list_filter(gb, lambda e: not list_contains(ga, e))) ob, round(len(list_intersect(pa, pb)) / greatest(least(len(pa), len(pb)), 1), 3) ov from j),
  ident as (select *, case when mondo_a = mondo_b then 'SAME_DISEASE' when sh = 0 then 'DISTINCT_DISEASE' when oa = 0 and ob = 0 and ov >= 0.5 then 'ALLELIC_SPECTRUM' when oa = 0 and ob = 0 and core_a = core_b then 'PHENOTYPIC_SUBTYPE' when oa = 0 and ob = 0 then 'PARTIALLY_OVERLAPPING_ENTITY'
    when (oa = 0 or ob = 0) and ov >= 0.25 then 'PARTIALLY_OVERLAPPING_ENTITY' when ov >= 0.5 then 'PARTIALLY_OVERLAPPING_ENTITY' else 'DISTINCT_DISEASE' end relation from k)"""
)


def pair_rows(spark, d):
    sets = bind(spark, d, SETS)
    side = lambda s, k: sets.select(F.col("k").alias(k), F.col("genes").alias(f"genes_{s}"), F.col("phenotypes").alias(f"phenotypes_{s}"), F.col("effects").alias(f"effects_{s}"), F.col("n").alias(f"evidence_{s}"))
    return bind(spark, d, PAIR_ROWS).join(side("a", "l"), "l").join(side("b", "r"), "r")


@query("identity_relation", f"with {IDENTIFIED} select l, r, sh shared_genes, ov overlap, relation, relation = 'PARTIALLY_OVERLAPPING_ENTITY' needs_review from ident")
def identity_relation(spark, d):
    return compare.identity(pair_rows(spark, d)).select("l", "r", "shared_genes", "overlap", "relation", "needs_review")


@query(
    "variant_compatibility",
    f"""with {JOINED}, c as (select *, len(list_intersect(ga, gb)) sh, list_contains(ea, 'nonsense') la, list_contains(ea, 'duplication') xa, list_contains(eb, 'nonsense') lb, list_contains(eb, 'duplication') xb from j)
    select l, r, case when sh = 0 or len(ea) = 0 or len(eb) = 0 then 'NOT_ASSESSABLE' when (la and xb) or (xa and lb) then 'INCOMPATIBLE' when not (la or xa) or not (lb or xb) then 'UNDETERMINED' when la = lb and xa = xb then 'COMPATIBLE' else 'UNDETERMINED' end compatibility from c""",
)
def variant_compatibility(spark, d):
    rows = pair_rows(spark, d).withColumn("n_shared_genes", F.size(F.array_intersect("genes_a", "genes_b")))
    return compare.variant_compatibility(rows).select("l", "r", "compatibility")


@query("evidence_asymmetry", f"with {JOINED} select l, r, round(greatest(na, nb) / least(na, nb), 2) ratio, round(greatest(na, nb) / least(na, nb), 2) > 3 as \"asymmetric\" from j")
def evidence_asymmetry(spark, d):
    return compare.asymmetry(pair_rows(spark, d)).select("l", "r", "ratio", "asymmetric")


CLASSIFIED = (
    IDENTIFIED
    + """, q as (select *, case when price_a < 40000 then 1 else 0 end nr, na % 4 nd, least(na % 4, nb % 3) np, price_b > 60000 br, len(list_intersect(pa, pb)) > 2 an, case when ov >= 0.8 then 'STRONG' when ov > 0 then 'WEAK' else 'NONE' end ph, case when core_a = core_b then 'WEAK' else 'NONE' end ti from ident),
  rel as (select *, case when relation = 'SAME_DISEASE' then 'C1' when relation in ('ALLELIC_SPECTRUM', 'PHENOTYPIC_SUBTYPE') then 'C2' when nr > 0 and nd = 0 then 'C3' when np >= 2 and not br then 'C4' when np >= 2 then 'C5' when np = 1 then 'C6' when nd > 0 then 'C7'
    when not an and ph = 'STRONG' then 'C8' when not an and ti <> 'NONE' then 'C9' when not an then 'C10' else 'C11' end rule from q),
  cls as (select *, case rule when 'C1' then 'SAME_DISEASE_ENTITY' when 'C2' then 'SAME_ALLELIC_SPECTRUM' when 'C3' then 'CONTRADICTED' when 'C5' then 'SHARED_DOWNSTREAM_MECHANISM' when 'C8' then 'SHARED_PHENOTYPE_ONLY' when 'C9' then 'SHARED_TISSUE_CONTEXT' when 'C10' then 'RETRIEVAL_ARTIFACT' when 'C11' then 'SHARED_CELLULAR_PROCESS_NON_EQUIVALENT' else 'INSUFFICIENT_EVIDENCE' end class from rel)"""
)


def classified(spark, d):
    rows = compare.identity(pair_rows(spark, d)).withColumnRenamed("relation", "identity")
    met = F.size(F.array_intersect("phenotypes_a", "phenotypes_b"))
    rows = rows.withColumns(
        {
            "n_refuting": F.when(F.col("price_a") < 40000, 1).otherwise(0), "n_direct": F.col("evidence_a") % 4, "n_primary": F.least(F.col("evidence_a") % 4, F.col("evidence_b") % 3), "has_bridge": F.col("price_b") > 60000,
            "anchored": met > 2, "phenotype": F.when(F.col("overlap") >= 0.8, "STRONG").when(F.col("overlap") > 0, "WEAK").otherwise("NONE"), "tissue": F.when(F.col("core_a") == F.col("core_b"), "WEAK").otherwise("NONE"),
        }
    )
    return pairs.classify(rows)


@query("relationship_class", f"with {CLASSIFIED} select l, r, class relation, rule, rule = 'C5' actionable from cls")
def relationship_class(spark, d):
    return classified(spark, d).select("l", "r", "relation", "rule", "actionable")


@query(
    "retrieval_validity",
    f"""with {CLASSIFIED} select l, r, case when rule = 'C5' and sh > 1 then 'CORRECT' when rule = 'C5' and nd > 0 then 'INCORRECT_BUT_CONNECTION_REAL' when rule = 'C5' then 'PARTIALLY_CORRECT' when rule in ('C3', 'C8', 'C10') then 'INCORRECT_AND_CONNECTION_FALSE' when rule in ('C1', 'C2') then 'PARTIALLY_CORRECT' when rule in ('C4', 'C6', 'C7') then 'UNRESOLVED' else 'INCOMPLETE' end validity from cls""",
)
def retrieval_validity(spark, d):
    return pairs.retrieval_validity(classified(spark, d).withColumn("strong_anchor", F.col("shared_genes") > 1)).select("l", "r", "validity")


@query(
    "alternatives",
    f"""with {CLASSIFIED}, z as (select *, round(greatest(na, nb) / least(na, nb), 2) ratio from cls), pid as (select *, l pair_id from z)
    select pair_id, 'GENERIC_PHENOTYPE_OVERLAP' code from pid where ph <> 'NONE' and not an union all select pair_id, 'SHARED_TISSUE_DIFFERENT_BIOLOGY' from pid where ti <> 'NONE' and not an
    union all select pair_id, 'BROAD_ONTOLOGY_ANNOTATION' from pid where sh > 1 union all select pair_id, 'SAME_ENTITY_TWO_LABELS' from pid where relation in ('SAME_DISEASE', 'ALLELIC_SPECTRUM', 'PHENOTYPIC_SUBTYPE')
    union all select pair_id, 'OPPOSITE_DIRECTION' from pid where na = 7 union all select pair_id, 'HUB_GENE_EFFECT' from pid where nb * 6 > 33 union all select pair_id, 'CURATION_DEPTH_ARTIFACT' from pid where ratio > 3""",
)
def alternatives(spark, d):
    rows = compare.asymmetry(classified(spark, d)).withColumn("pair_id", F.col("l")).withColumn("process", F.when(F.col("shared_genes") > 1, "WEAK").otherwise("NONE"))
    return pairs.alternatives(rows.withColumn("conflicts", F.when(F.col("evidence_a") == 7, 1).otherwise(0)).withColumn("hub_df", F.col("evidence_b") * 6))


#: The vocabulary of bridges, spelled again, and words that the documents have.
VOCAB = [
    "chaperone-mediated autophagy", "chaperone-assisted degradation", "heat shock response", "heat-shock response", "unfolded protein response",
    "integrated stress response", "protein quality control", "proteostasis", "stress response", "chaperone", "co-chaperone", "aggresome",
    "protein aggregation", "misfolded protein", "autophagy", "mitophagy", "lysosomal degradation", "proteasomal degradation", "ubiquitin-proteasome",
    "substrate recognition", "substrate specificity", "E3 ligase activity", "ubiquitin ligase", "polyubiquitination", "monoubiquitination",
    "ubiquitination", "phosphorylation", "nuclear translocation", "transcriptional activation", "protein stability", "protein turnover",
    "protein-protein interaction", "complex formation", "glycogen metabolism", "calcium signaling", "oxidative stress", "mitochondrial dysfunction",
    "DNA damage response", "synaptic function",
]
OWN = ["license", "secret", "token", "tion"]
BRIDGE_ROWS = """select lang || source pair_id, doc_id evidence_id, case when doc_id % 2 = 0 then 'Proteostasis, not oxidative STRESS' else 'phosphorylation by CHIP' end statement, text, doc_id % 3 <> 0 direct from {documents}"""
RETRIEVED = """select distinct lang || source pair_id, case when doc_id % 5 = 0 then 'TION' when lang = 'en' then 'proteostasis' when lang = 'de' then 'License' else 'x' end feature from {documents}"""


@query(
    "bridge_terms",
    """with v as (select unnest(["""
    + ",".join(f"'{t}'" for t in VOCAB + OWN)
    + """]) term, unnest(range("""
    + str(len(VOCAB + OWN))
    + r""")) place), d as (select pair_id, statement || ' ' || text said from ("""
    + BRIDGE_ROWS
    + r""") r where direct), n as (select pair_id, count(*) n from d group by pair_id), q as (select distinct pair_id, lower(feature) feature from ("""
    + RETRIEVED
    + r""") z),
    t as (select pair_id, place, term, count(*) c from d, v where contains(lower(said), lower(term)) group by all),
    tk as (select t.*, exists (select 1 from q where q.pair_id = t.pair_id and q.feature = lower(term)) broad from t join n using (pair_id) where c >= least(n, 2)),
    ts as (select *, row_number() over (partition by pair_id, broad order by place) p, row_number() over (partition by pair_id order by place) p_all, count(*) filter (not broad) over (partition by pair_id) specific from tk),
    f0 as (select pair_id, unnest(list_distinct(regexp_extract_all(said, '\b([A-Z][A-Z0-9]{2,7})\b', 1))) term from d),
    f1 as (select pair_id, term, count(*) c from f0 where term not in ("""
    + STOPWORDS
    + """) group by all), f2 as (select *, row_number() over (partition by pair_id order by c desc, term) p from f1), fk as (select * from f2 join n using (pair_id) where p <= 4 and c >= least(n, 2)),
    a as (select pair_id, string_agg(term, ',' order by place) terms from ts where (specific > 0 and not broad and p <= 4) or (specific = 0 and p_all <= 2) group by pair_id),
    b as (select pair_id, string_agg(term, ',' order by p) factors from fk group by pair_id)
    select pair_id, n n_direct, coalesce(terms, '') terms, coalesce(factors, '') factors from n left join a using (pair_id) left join b using (pair_id) where terms is not null or factors is not null""",
)
def bridge_terms(spark, d):
    return pairs.bridges(bind(spark, d, BRIDGE_ROWS), bind(spark, d, RETRIEVED), [*pairs.VOCABULARY, *OWN])


@query(
    "refused_labels",
    r"""with l as (select doc_id id, left(text, 60) || case when doc_id % 7 = 0 then ' causes the same axis' when doc_id % 7 = 1 then ' Shared Mechanism' else ' and control' end "label", left(text, 40) t from {documents}),
    w as (select id, unnest(list_distinct(regexp_extract_all(lower("label"), '[a-z0-9]+'))) word, regexp_extract_all(lower(t), '[a-z0-9]+') own from l)
    select id, 'ADDS' problem, word from w where not list_contains(own, word) and word not in ('and', 'or', 'of', 'the', 'a', 'an', 'in', 'with', 'associated', 'related', 'biology', 'axis', 'pathway', 'process', 'node', 'machinery', 'system',
      'activity', 'function', 'control', 'quality')
    union all select id, 'CONCLUDES', c from l, (select unnest(['causes', 'caused', 'causing', 'drives', 'driven', 'leads to', 'results in', 'responsible for', 'equivalent', 'identical', 'same as', 'proves', 'proven', 'establishes', 'confirms',
      'demonstrates', 'shared mechanism', 'mechanistically equivalent']) c) x where contains(lower("label"), c)""",
)
def refused_labels(spark, d):
    label = """select doc_id id, left(text, 60) || case when doc_id % 7 = 0 then ' causes the same axis' when doc_id % 7 = 1 then ' Shared Mechanism' else ' and control' end label, array(left(text, 40)) terms from {documents}"""
    return synthesis.refused_labels(bind(spark, d, label))


RANKED = """select l_orderkey pair_id, concat('n', cast(l_orderkey as string)) name, l_orderkey ord, min(l_quantity) > 2 independent, case when max(l_quantity) > 20 then 'SHARED_DOWNSTREAM_MECHANISM' else 'RETRIEVAL_ARTIFACT' end relation,
  count(*) n_terms, cast(least(count(*), sum(case when l_returnflag = 'A' then 1 else 0 end)) as bigint) n_regulators, cast(sum(case when l_returnflag = 'N' and l_tax < 0.03 then 1 else 0 end) as bigint) n_generic, count(*) + 1 n_supporting, cast(sum(case when l_linestatus = 'O' then 1 else 0 end) as bigint) n_direct,
  cast(sum(case when l_discount > 0.08 then 1 else 0 end) as bigint) n_contradicting, cast(sum(case when l_tax > 0.01 then 1 else 0 end) as bigint) n_roles, cast(sum(case when l_tax > 0.05 then 1 else 0 end) as bigint) n_primary_roles, max(l_quantity) > 40 anchored, max(l_discount) > 0.05 assessable,
  case when min(l_returnflag) = 'A' then 'COMPATIBLE' when min(l_returnflag) = 'N' then 'UNKNOWN' else 'INCOMPATIBLE' end compatibility from {lineitem} group by l_orderkey"""


def _part(value: str, weight: float) -> str:
    return f"cast(round(cast(round({value}, 3) as decimal(9,3)) * cast({weight} as decimal(3,2)), 4) as decimal(9,4))"


@query(
    "weighted_ranking",
    f"""with x as ({RANKED}), y as (select *, case when not independent then 'NOT_INDEPENDENT' when relation = 'RETRIEVAL_ARTIFACT' then relation when n_terms = 0 then 'NO_BRIDGE' else '' end exclusion,
      {_part("least(1.0::double, (n_terms - n_regulators - n_generic) * 0.2::double + n_regulators * 0.25::double)", 0.30)} + {_part("least(1.0::double, n_direct::double / n_supporting)", 0.22)} + {_part("case when n_roles = 0 then 0.5::double else n_primary_roles::double / n_roles end", 0.18)}
      + {_part("case when anchored then 0.6::double else 0::double end + case when assessable then 0.4::double else 0::double end", 0.12)} + {_part("case when n_regulators > 0 then 1::double when n_terms > 0 then 0.5::double else 0::double end", 0.10)}
      + {_part("case compatibility when 'COMPATIBLE' then 1::double when 'INCOMPATIBLE' then 0::double else 0.5::double end", 0.05)} + {_part("least(n_supporting::double / 6, 1::double)", 0.03)}
      - {_part("case when n_contradicting = 0 then 0::double else least(n_contradicting::double / greatest(n_supporting, 1), 1::double) end", 0.20)} - {_part("case when n_terms = 0 then 1::double else n_generic::double / n_terms end", 0.15)} total from x)
    select pair_id, exclusion, case when exclusion = '' then cast(total as double) end total, row_number() over (order by exclusion <> '', case when exclusion = '' then -total end nulls first, case when exclusion = '' then name end nulls first, ord) place from y""",
)
def weighted_ranking(spark, d):
    return pairs.rank(bind(spark, d, RANKED)).select("pair_id", "exclusion", F.col("total").cast("double").alias("total"), "place")


# action

SIGNALS = """select l_suppkey subject_id, case when l_suppkey > 50 then 'researcher' else 'team' end subject_type, p_brand capability, case l_returnflag when 'A' then 'publication' when 'R' then 'active_grant' else 'web' end source_type,
  case when l_quantity < 15 then 'individual' when l_quantity < 30 then 'team' else 'institution' end scope, l_tax < 0.06 demonstrates, l_discount < 0.08 context_match, l_linestatus = 'O' model_match,
  case when l_tax > 0.005 then extract(year from l_shipdate) end as `year`, l_returnflag = 'R' active from {lineitem} join {part} on p_partkey = l_partkey"""
SIGNALS_DUCK = SIGNALS.replace("`", '"')


@query(
    "capability_status",
    f"""with s as ({SIGNALS_DUCK}), t as (select *, demonstrates and context_match and model_match and not (subject_type = 'researcher' and scope = 'institution') rel from s), u as (select *, rel and (active or "year" is null or "year" >= 1999 - 5) cur from t),
    a as (select subject_id, capability, count(*) n, count(*) filter (rel) r, count(*) filter (cur) c, count(distinct source_type) filter (cur) ct, count(*) filter (cur and source_type = 'active_grant') g, count(*) filter (rel and scope = 'individual') i, count(*) filter (rel and scope in ('lab', 'team')) tm, count(*) filter (rel and scope = 'institution') ins, count(*) filter (scope = 'institution') ai from u group by all)
    select subject_id, capability, r relevant, c as current, case when r > 0 and c = 0 then 'OUTDATED' when c >= 2 and ct >= 2 then 'VERIFIED' when g > 0 or c > 0 then 'SUPPORTED' when n > 0 then 'PLAUSIBLE' else 'UNVERIFIED' end status,
    case when r > 0 and i = r then 'DIRECT' when tm > 0 then 'TEAM_LEVEL' when r > 0 and ins = r then 'INSTITUTION_LEVEL' when r = 0 and ai = n then 'INSTITUTION_LEVEL' else 'INDIRECT' end directness from a""",
)
def capability_status(spark, d):
    return action.capability_claims(bind(spark, d, SIGNALS), 1999).select("subject_id", "capability", "relevant", "current", "status", "directness")


COLLAB = """select l_orderkey id, array_sort(collect_set(l_returnflag)) provided, array_sort(collect_set(case when l_quantity > 25 then l_linestatus end)) assets, case when max(l_tax) > 0.03 then 'x' end contact, collect_list(l_returnflag) teams from {lineitem} group by l_orderkey"""


@query(
    "collaboration_status",
    """with a as (select l_orderkey id, bool_or(l_returnflag = 'A') a, bool_or(l_returnflag = 'N') n, max(l_quantity) > 25 s, max(l_tax) > 0.03 c from {lineitem} group by 1)
    select id, case when not (a and n) then 'MISSING_CAPABILITY' when not s then 'MISSING_ASSET' when not c then 'CONTACT_UNVERIFIED' else 'READY_FOR_EXPERT_REVIEW' end status from a""",
)
def collaboration_status(spark, d):
    rows = bind(spark, d, COLLAB).withColumn("required", F.array(F.lit("A"), F.lit("N")))
    return action.collaboration_status(rows).select("id", "status")


@query(
    "topology",
    """with t as (select l_orderkey id, l_suppkey team, bool_or(l_returnflag = 'A') a, bool_or(l_returnflag = 'N') n from {lineitem} group by all)
    select id, case when bool_or(a and n) then 'ONE_LAB_EXECUTABLE' when bool_or(a) and bool_or(n) then 'MULTI_PARTY_EXECUTABLE' else 'MISSING_CAPABILITY' end topology from t group by id""",
)
def topology(spark, d):
    teams = bind(spark, d, "select l_orderkey id, l_suppkey team, collect_set(l_returnflag) has from {lineitem} group by l_orderkey, l_suppkey")
    rows = teams.groupBy("id").agg(F.collect_list("has").alias("teams")).withColumn("required", F.array(F.lit("A"), F.lit("N")))
    return action.topology(rows).select("id", "topology")


@query("recency_band", "select o_orderkey, case when 2000 - extract(year from o_orderdate) <= 3 then 'CURRENT' when 2000 - extract(year from o_orderdate) <= 8 then 'RECENT' else 'HISTORICAL' end band from {orders}")
def recency_band(spark, d):
    return bind(spark, d, "select o_orderkey, o_orderdate from {orders}").select("o_orderkey", dates.recency(F.year("o_orderdate"), 2000).alias("band"))


@query(
    "entity_resolution",
    """with p as (select c_custkey k, concat(c_mktsegment, cast(c_nationkey as string)) s, right(c_name, 1) g from {customer}), o as (select distinct o_custkey k, o_orderdate d from {orders})
    select a.k a, b.k b, case when exists (select 1 from o x join o y on x.d = y.d where x.k = a.k and y.k = b.k) then 'DISTINCT' else 'POSSIBLE_DUPLICATE' end resolution from p a join p b on a.s = b.s and a.g = b.g and a.k < b.k""",
)
def entity_resolution(spark, d):
    people = bind(spark, d, "select c_custkey person_id, concat(c_mktsegment, cast(c_nationkey as string)) surname, right(c_name, 1) given, coalesce(p, array()) publications from {customer} left join (select o_custkey k, collect_set(o_orderdate) p from {orders} group by o_custkey) x on k = c_custkey")
    return action.resolve_identities(people)


TEAMS = "select distinct l_orderkey team, concat('c', cast(l_suppkey as string)) capability from {lineitem}"


@query(
    "coordination_pairs",
    f"with t as ({TEAMS}), m as (select * from (select *, count(*) over (partition by team) n from t) x where n > 1) select a.team a, b.team b, string_agg(a.capability, ',' order by a.capability) shared from m a join m b on a.capability = b.capability and a.team < b.team group by 1, 2",
)
def coordination_pairs(spark, d):
    return action.coordination_pairs(bind(spark, d, TEAMS))


HITS = """select p_brand capability, cast(l_partkey as string) pmid, case when l_tax > 0.01 then cast(extract(year from l_shipdate) as int) end as `year`, l_orderkey * 100 + l_linenumber + l_quantity / 100 ord from {lineitem} join {part} on p_partkey = l_partkey"""


@query(
    "first_candidates",
    f"""with h as ({HITS.replace("`", '"')}), f as (select * from (select *, row_number() over (partition by capability, pmid order by ord, "year") n from h) x where n = 1)
    select capability, pmid, place from (select *, row_number() over (partition by capability order by coalesce("year", 0) desc, pmid) place from f) y where place <= 3""",
)
def first_candidates(spark, d):
    return action.first_candidates(bind(spark, d, HITS)).select("capability", "pmid", "place")


INTERVALS = "select p_partkey protein, case p_size % 3 when 0 then 'Domain' when 1 then 'Repeat' else 'Signal' end kind, p_size begin, p_size + 10 as `end` from {part}"
POINTS = "select distinct l_suppkey protein, cast(l_quantity as int) residue from {lineitem}"


@query("residue_interval_join", f"""with f as ({INTERVALS.replace('`', '"')}), p as ({POINTS}) select p.protein, residue, kind, begin, "end" from p join f on p.protein = f.protein and residue between begin and "end" where kind in ('Domain', 'Repeat')""")
def residue_interval_join(spark, d):
    return action.intervals_of(bind(spark, d, POINTS), bind(spark, d, INTERVALS))


@query(
    "potential_duplication",
    f"with {JOINED} select l, r, case when len(list_intersect(ga, gb)) > 0 and len(list_intersect(pa, pb)) > 0 and len(list_intersect(ea, eb)) > 0 then 'POTENTIAL DUPLICATION / COORDINATION OPPORTUNITY' else 'NO SPECIFIC OVERLAP IDENTIFIED' end overlap from j",
)
def potential_duplication(spark, d):
    rows = pair_rows(spark, d)
    for s in ("a", "b"):
        rows = rows.withColumnsRenamed({f"genes_{s}": f"disease_{s}", f"phenotypes_{s}": f"gene_{s}", f"effects_{s}": f"modality_{s}"})
    return action.potential_duplication(rows).select("l", "r", "overlap")


@query(
    "review_overlay",
    """with r as (select user_id object_id, event_id review_id, event_type, value, ts from {events}), a as (select *, row_number() over (partition by object_id order by ts desc, review_id desc) n from r where event_type = 'purchase'), o as (select distinct user_id object_id from {events})
    select object_id, coalesce(case when n = 1 then value end, 0) as value, n is not null is_reviewed from o left join (select * from a where n = 1) x using (object_id)""",
)
def review_overlay(spark, d):
    records = bind(spark, d, "select distinct user_id object_id, cast(0 as double) value from {events}")
    reviewed = bind(spark, d, "select user_id object_id, event_id review_id, case when event_type = 'purchase' then 'ACCEPT' else 'REJECT' end decision, value, ts created from {events}")
    return action.apply_reviews(records, reviewed)


# store, projection, agreement

@query("stable_ids")
def stable_ids(spark, d):
    rows = bind(spark, d, "select c_custkey, c_name, c_mktsegment from {customer}")
    return rows.select("c_custkey", ids.uuid5(F.col("c_mktsegment"), F.col("c_name")).alias("id"), ids.content_hash("c_name", "c_mktsegment") .alias("hash"))


ARTIFACTS = "select user_id object_id, event_type version, sha2(cast(round(value) as string), 256) hash, event_id ord from {events}"
ARTIFACTS_DUCK = "select user_id object_id, event_type as version, sha256(cast(round(value) as string)) hash, event_id ord from {events}"


@query(
    "artifact_conflicts",
    f"with a as ({ARTIFACTS_DUCK}), f as (select *, first_value(hash) over (partition by object_id, version order by ord) kept, row_number() over (partition by object_id, version order by ord) n from a) select object_id, version, ord, case when n = 1 then 'INSERTED' when hash = kept then 'UNCHANGED' else 'CONFLICT' end outcome from f",
)
def artifact_conflicts(spark, d):
    return store.save_outcomes(bind(spark, d, ARTIFACTS)).select("object_id", "version", "ord", "outcome")


@query("snapshot_dedup", "select sha256(text) request_key, min(doc_id) first_doc, count(*) copies from {documents} group by 1")
def snapshot_dedup(spark, d):
    return store.snapshots(bind(spark, d, "select doc_id, text from {documents}"), "text", "doc_id").withColumnsRenamed({"first": "first_doc"})


@query(
    "dedup_projection",
    """select id, kind, name from (select *, row_number() over (partition by id order by ord desc) n from (select c_nationkey id, 'Customer' kind, c_name as name, c_custkey ord from {customer} union all select s_nationkey, 'Supplier', s_name, s_suppkey + 1000000000 from {supplier}) x) y where n = 1""",
)
def dedup_projection(spark, d):
    rows = bind(spark, d, "select c_nationkey id, 'Customer' kind, c_name name, c_custkey ord from {customer} union all select s_nationkey, 'Supplier', s_name, s_suppkey + 1000000000 from {supplier}")
    return store.last_nodes(rows).select("id", "kind", "name")


@query("dangling_edges", "select l_orderkey s, l_partkey t from {lineitem} where l_orderkey not in (select o_orderkey from {orders} where o_orderstatus <> 'P') or l_partkey not in (select p_partkey from {part} where p_size > 5)")
def dangling_edges(spark, d):
    nodes = bind(spark, d, "select concat('o', cast(o_orderkey as string)) id from {orders} where o_orderstatus <> 'P' union all select concat('p', cast(p_partkey as string)) from {part} where p_size > 5")
    edges = bind(spark, d, "select l_orderkey s, l_partkey t, concat('o', cast(l_orderkey as string)) start_id, concat('p', cast(l_partkey as string)) end_id from {lineitem}")
    return store.dangling(edges, nodes).select("s", "t")


#: What each turn comes from: the one before it, by that one's role; and the turns of assistants.
LINEAGE = """select concat(b.conv_id, ':', b.turn) child_id, concat(a.conv_id, ':', a.turn) parent_id, a.role relationship from {conversations} b join {conversations} a on a.conv_id = b.conv_id and a.turn = b.turn - 1"""
ANSWERED = "select concat(conv_id, ':', turn) child_id from {conversations} where role = 'assistant'"


@query("lineage_one_hop", f"select distinct l.* from ({LINEAGE}) l where child_id in (select child_id from ({ANSWERED}) a)")
def lineage_one_hop(spark, d):
    return artifacts.parents(bind(spark, d, LINEAGE), bind(spark, d, ANSWERED))


@query(
    "lineage_ancestors",
    f"""with recursive l as ({LINEAGE}), a(child_id, ancestor_id, steps) as (select distinct child_id, child_id, 0 from ({ANSWERED}) x
      union select a.child_id, l.parent_id, a.steps + 1 from a join l on l.child_id = a.ancestor_id)
    select child_id, ancestor_id, min(steps) steps from a where steps > 0 group by child_id, ancestor_id""",
)
def lineage_ancestors(spark, d):
    return artifacts.ancestors(bind(spark, d, LINEAGE), bind(spark, d, ANSWERED))


ANSWERS = "select doc_id item_id, case quality when 1 then 'SUPPORTED' else 'INSUFFICIENT_EVIDENCE' end engine, case when toxic = 1 then 'CONTRADICTED' when doc_id % 3 = 0 then 'PARTIALLY_SUPPORTED' else 'SUPPORTED' end reviewer, concat('R', cast(doc_id % 4 as string)) rule from {labels}"
STRENGTH = "case {} when 'PARTIALLY_SUPPORTED' then 1 when 'SUPPORTED' then 2 else 0 end"


@query(
    "agreement_report",
    f"with a as ({ANSWERS}), s as (select *, {STRENGTH.format('engine')} e, {STRENGTH.format('reviewer')} r from a) select count(*) adjudicated, count(*) filter (engine = reviewer) agreed, round(count(*) filter (engine = reviewer) / count(*), 3) rate, count(*) filter (e > r) stronger, count(*) filter (e < r) weaker from s",
)
def agreement_report(spark, d):
    return store.agreement(bind(spark, d, ANSWERS))


@query("disagreements_by_rule", f"with a as ({ANSWERS}) select rule, count(*) n from a where engine <> reviewer group by rule")
def disagreements_by_rule(spark, d):
    return store.disagreements(bind(spark, d, ANSWERS))


NAMES = """select p_partkey, p_size > 25 has_case, case when p_partkey % 400 = 0 then 'Small' when p_partkey % 300 = 1 then concat('SMALL ', p_name) when p_partkey % 3 = 0 then concat('un', replace(p_name, ' ', '')) else concat('a ', p_name) end p_name from {part}"""


@query(
    "disease_search",
    f"""with s as (select *, case when lower(p_name) = 'small' then 4 when starts_with(lower(p_name), 'small') then 3 when contains(lower(p_name), ' small') then 2 when contains(lower(p_name), 'small') then 1 end m from ({NAMES}) x)
    select p_partkey, p_name, place from (select *, row_number() over (order by m * 2 + case when has_case then 0 else 1 end desc, lower(p_name), p_partkey) place from s where m is not null) x where place <= 12""",
)
def disease_search(spark, d):
    return store.search(bind(spark, d, NAMES), "p_name", "p_partkey", "small").select("p_partkey", "p_name", "place")


@query("path_audit", "select k path, count(*) n from (select unnest(json_keys(props)) k from {events}) x group by k")
def path_audit(spark, d):
    from ..operators import ingest

    return ingest.flat_paths(bind(spark, d, "select props from {events}"), "props")


@query("field_disposition", "select k path, case k when 'k' then 'normalized' else 'UNDECLARED' end disposition from (select distinct unnest(json_keys(props)) k from {events}) x")
def field_disposition(spark, d):
    from ..operators import ingest

    rules = spark.createDataFrame([("k", "exact", "normalized"), ("meta", "subtree", "preserved_unnormalized")], "rule_path string, kind string, disposition string")
    return ingest.resolve_paths(ingest.flat_paths(bind(spark, d, "select props from {events}"), "props"), rules)
