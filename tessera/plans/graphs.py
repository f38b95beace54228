"""Ontology and small graphs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import graph, ontology
from ..operators.checkpoints import settled
from .bindings import ANNOTATIONS, EDGES, ISA, PAIRS, TERMS, bind, query

CLOSED = f"""t as ({TERMS}), isa as ({ISA}), cl(term_id, ancestor) as (select term_id, term_id from t union select cl.term_id, isa.parent from cl join isa on isa.child = cl.ancestor)"""
INFO = CLOSED + f""", ann as ({ANNOTATIONS}), total as (select count(distinct entity_id) n from ann),
  info as (select ancestor term_id, count(distinct entity_id) n, round(-ln(count(distinct entity_id) / (select n from total)), 6) ic from ann join cl using (term_id) group by ancestor)"""
SIMILAR = INFO + """, sim as (select x.term_id a, y.term_id b, max(coalesce(ic, 0)) ic, max((coalesce(ic, 0), x.ancestor)) best
  from (select * from cl where term_id like 'S%') x join (select * from cl where term_id like 'S%') y on x.ancestor = y.ancestor left join info on info.term_id = x.ancestor group by 1, 2)"""


def tables(spark, d):
    terms = bind(spark, d, TERMS)
    closed = ontology.closure(terms, bind(spark, d, ISA))
    annotations = bind(spark, d, ANNOTATIONS)
    return terms, closed, annotations, ontology.closure_information(annotations, closed)


def term_pairs(spark, d, annotations):
    """Pairs of terms that meet in some pair of entities."""
    pairs = bind(spark, d, PAIRS)
    left, right = annotations.toDF("l", "a"), annotations.toDF("r", "b")
    return pairs.join(left, "l").join(right, "r").select("a", "b").distinct()


@query("ontology_closure", f"with recursive {CLOSED} select term_id, ancestor from cl")
def ontology_closure(spark, d):
    return ontology.closure(bind(spark, d, TERMS), bind(spark, d, ISA))


@query("closure_ic", f"with recursive {INFO} select term_id, n, ic from info")
def closure_ic(spark, d):
    return tables(spark, d)[3]


@query(
    "mica",
    f"with recursive {SIMILAR}, ps as ({PAIRS}), w as (select distinct x.term_id a, y.term_id b from ps join ann x on x.entity_id = l join ann y on y.entity_id = r) select a, b, best[2] mica, coalesce(best[1], 0) ic from w left join sim using (a, b)",
)
def mica(spark, d):
    _, closed, annotations, information = tables(spark, d)
    return ontology.mica(term_pairs(spark, d, annotations), closed, information)


BMA = f"""ps as ({PAIRS}), met as (select l, r, x.term_id a, y.term_id b, coalesce(ic, 0) ic from ps join ann x on x.entity_id = l join ann y on y.entity_id = r left join sim on a = x.term_id and b = y.term_id)"""


@query(
    "best_match_average",
    f"""with recursive {SIMILAR}, {BMA}, u as (select l, r, a, b, cast(round(ic * 1000000) as bigint) ic from met), x as (select l, r, sum(m) s, count(*) n from (select l, r, a, max(ic) m from u group by all) z group by l, r), y as (select l, r, sum(m) s, count(*) n from (select l, r, b, max(ic) m from u group by all) z group by l, r)
    select l, r, coalesce((x.s * y.n + y.s * x.n)::double / (2000000 * x.n * y.n), 0) bma from ps left join x using (l, r) left join y using (l, r)""",
)
def best_match_average(spark, d):
    _, closed, annotations, information = tables(spark, d)
    return ontology.best_match_average(bind(spark, d, PAIRS), annotations, closed, information)


@query(
    "phenotype_partition",
    f"""with recursive {SIMILAR}, ps as ({PAIRS}), have as (select distinct entity_id, term_id from ann),
    lf as (select l, r, h.term_id a, exists (select 1 from have g where g.entity_id = r and g.term_id = h.term_id) in_r from ps join have h on h.entity_id = l),
    rt as (select l, r, h.term_id b from ps join have h on h.entity_id = r where not exists (select 1 from have g where g.entity_id = l and g.term_id = h.term_id)),
    near as (select lf.l, lf.r, a, b, sim.ic, row_number() over (partition by lf.l, lf.r, a order by sim.ic desc, b) n from lf join rt on lf.l = rt.l and lf.r = rt.r join sim using (a, b) where not in_r and sim.ic >= -ln(0.05)),
    best as (select * from (select *, row_number() over (partition by l, r order by ic desc, a, b) m from near where n = 1) z where m <= 10)
    select lf.l, lf.r, lf.a term_id, case when in_r and coalesce(info.ic, 0) >= -ln(0.05) then 'shared_informative' when in_r then 'shared_generic' when best.b is not null then 'related' else 'left_only' end part, best.b related_to
    from lf left join info on info.term_id = lf.a left join best on best.l = lf.l and best.r = lf.r and best.a = lf.a""",
)
def phenotype_partition(spark, d):
    _, closed, annotations, information = tables(spark, d)
    return ontology.partition_by_ancestors(bind(spark, d, PAIRS), annotations, closed, information)


STARTS = "select distinct l_orderkey graph, l_linenumber node from {lineitem}"
REACH = f"e as ({EDGES}), rc(graph, node, cur) as (select graph, node, node from ({STARTS}) s union select rc.graph, rc.node, e.target from rc join e on e.graph = rc.graph and e.source = rc.cur), reach as (select graph, node, count(*) reach from rc group by graph, node)"


@query("downstream_reach", f"with recursive {REACH} select graph, node, reach from reach")
def downstream_reach(spark, d):
    return graph.downstream_reach(bind(spark, d, EDGES), bind(spark, d, STARTS))


@query(
    "longest_chain",
    f"with recursive e as ({EDGES}), p(graph, cur, n) as (select graph, target, 1 from e union select p.graph, e.target, p.n + 1 from p join e on e.graph = p.graph and e.source = p.cur) select graph, cast(max(n) as bigint) longest, true is_exact from p group by graph",
)
def longest_chain(spark, d):
    return graph.longest_chains(bind(spark, d, EDGES))


CLAIMS = """select l_orderkey graph, l_linenumber node, min(case l_returnflag when 'N' then 'SUPPORTED' when 'A' then 'PARTIALLY_SUPPORTED' else 'INSUFFICIENT_EVIDENCE' end) status from {lineitem} group by l_orderkey, l_linenumber"""


@query("structural_gaps", f"with recursive {REACH}, c as ({CLAIMS}) select graph, node, status, reach from c join reach using (graph, node) where status <> 'SUPPORTED' and reach >= 2")
def structural_gaps(spark, d):
    return graph.structural_gaps(graph.downstream_reach(bind(spark, d, EDGES), bind(spark, d, STARTS)), bind(spark, d, CLAIMS))


@query("settled_labels", f"with e as ({EDGES}) select distinct n node, true is_heaviest from (select graph * 10 + source n from e union all select graph * 10 + target from e) x")
def settled_labels(spark, d):
    """Whether each node of the settled labels has a heaviest one around it: the labels themselves hang on hashes, this does not."""
    edges = bind(spark, d, EDGES).select("graph", (F.col("graph") * 10 + F.col("source")).alias("a"), (F.col("graph") * 10 + F.col("target")).alias("b"), F.lit(1.0).alias("weight"))
    edges = settled(edges)
    return graph.heaviest_labels(graph.both_ways(edges), graph.settle_labels(edges, "graph")).select("node", "is_heaviest")
