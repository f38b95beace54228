"""The driver's tables in the roles that the operators need, as SQL that Spark and DuckDB both read.

Tables stand in braces. `bind` runs such a text over the Parquet tables; `plain` gives it to the oracle.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def bind(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    names = sorted(set(re.findall(r"\{(\w+)\}", text)))
    return spark.sql(text, **{n: spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in names})


def plain(text: str) -> str:
    return re.sub(r"\{(\w+)\}", r"\1", text)


def query(name: str, oracle: str | None = None) -> Callable[[Query], Query]:
    """Register a query; `oracle` is its SQL for DuckDB."""

    def add(f: Query) -> Query:
        QUERIES[name] = f
        if oracle is not None:
            ORACLES[name] = plain(oracle)
        return f

    return add


#: Entities are customers; their features what their orders hold, on axes of different breadth.
FEATURES = """select distinct entity_id, feature_id, axis from (
  select o.o_custkey entity_id, concat('part:', cast(l.l_partkey as string)) feature_id, 'gene' axis from {orders} o join {lineitem} l on l.l_orderkey = o.o_orderkey
  union all select o.o_custkey, concat('kind:', p.p_type, '|', p.p_brand, '|', cast(p.p_size as string)), 'process' from {orders} o join {lineitem} l on l.l_orderkey = o.o_orderkey join {part} p on p.p_partkey = l.l_partkey
  union all select o.o_custkey, concat('brand:', p.p_brand), 'cell' from {orders} o join {lineitem} l on l.l_orderkey = o.o_orderkey join {part} p on p.p_partkey = l.l_partkey
  union all select o.o_custkey, concat('supplier:', cast(l.l_suppkey as string)), 'function' from {orders} o join {lineitem} l on l.l_orderkey = o.o_orderkey
  union all select c_custkey, concat('segment:', c_mktsegment), 'phenotype' from {customer})"""
ENTITIES = "select c_custkey entity_id from {customer}"
#: Order lines of one task, about, where customers' features are made.
LINES = 250_000


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of FEATURES, each once: a line meets its order and its part once and goes to its customer's task as numbers and its kind.

    There are as many tasks as lines ask for, so that their memory does not grow with the tables.
    """
    lines = bind(spark, sf_dir, "select l_orderkey, l_partkey, l_suppkey from {lineitem}")
    tasks = max(spark.sparkContext.defaultParallelism, -(-lines.count() // LINES))
    orders = bind(spark, sf_dir, "select o_orderkey l_orderkey, o_custkey entity_id from {orders}")
    parts = bind(spark, sf_dir, "select p_partkey l_partkey, true known, concat('kind:', p_type, '|', p_brand, '|', cast(p_size as string)) kind, concat('brand:', p_brand) brand from {part}")
    sold = lines.join(orders, "l_orderkey").join(parts, "l_partkey", "left").select("entity_id", F.lit(True).alias("sold"), "l_partkey", "l_suppkey", "known", "kind", "brand")
    people = bind(spark, sf_dir, "select c_custkey entity_id, false sold, concat('segment:', c_mktsegment) segment from {customer}")
    feature = lambda x, axis: F.struct(x.alias("feature_id"), F.lit(axis).alias("axis"))
    of = [feature(F.concat(F.lit("part:"), F.col("l_partkey").cast("string")), "gene"), feature(F.concat(F.lit("supplier:"), F.col("l_suppkey").cast("string")), "function")]
    kinds = [feature(F.col("kind"), "process"), feature(F.col("brand"), "cell")]
    each = F.when(~F.col("sold"), F.array(feature(F.col("segment"), "phenotype"))).when(F.col("known"), F.array(*of, *kinds)).otherwise(F.array(*of))
    rows = sold.unionByName(people, allowMissingColumns=True).repartition(tasks, "entity_id")
    return rows.select("entity_id", F.inline(each)).distinct()

#: An ontology of suppliers under nations under regions; orders are annotated with their suppliers.
TERMS = """select concat('R', cast(r_regionkey as string)) term_id, false obsolete, cast(null as string) replaced_by from {region}
  union all select concat('N', cast(n_nationkey as string)), false, null from {nation}
  union all select concat('S', cast(s_suppkey as string)), false, null from {supplier}"""
ISA = """select concat('N', cast(n_nationkey as string)) child, concat('R', cast(n_regionkey as string)) parent from {nation}
  union all select concat('S', cast(s_suppkey as string)), concat('N', cast(s_nationkey as string)) from {supplier}"""
ANNOTATIONS = "select distinct l_orderkey entity_id, concat('S', cast(l_suppkey as string)) term_id from {lineitem}"
#: An order and the same customer's next one.
PAIRS = "select l, r from (select o_orderkey l, lead(o_orderkey) over (partition by o_custkey order by o_orderkey) r from {orders}) x where r is not null"

#: In an order, an edge from each line to the later ones that shipped no sooner.
EDGES = """select distinct a.l_orderkey graph, a.l_linenumber source, b.l_linenumber target from {lineitem} a join {lineitem} b
  on a.l_orderkey = b.l_orderkey and a.l_linenumber < b.l_linenumber and a.l_shipdate <= b.l_shipdate"""
