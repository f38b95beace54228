"""Ontologies in OBO text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

HPO = r"^HP:\d{7}$"


def read_obo(spark: SparkSession, path: str, id_pattern: str = HPO) -> DataFrame:
    """term_id, name, alt_ids, parents, obsolete, replaced_by of the [Term] stanzas whose id fits; files are read stanza by stanza."""
    stanzas = spark.read.option("lineSep", "\n\n").text(path).select(F.col("value").alias("stanza"))
    return terms_of(stanzas, id_pattern)


def terms_of(stanzas: DataFrame, id_pattern: str = HPO) -> DataFrame:
    s = F.col("stanza")
    one = lambda tag: F.regexp_extract(s, rf"(?m)^{tag}:[ \t]*([^!\n]*?)[ \t]*(?:!.*)?$", 1)
    many = lambda tag: F.regexp_extract_all(s, F.lit(rf"(?m)^{tag}:[ \t]*([^\s!]+)"), F.lit(1))
    terms = stanzas.filter(F.rlike(s, F.lit(r"(?m)^\[Term\]"))).select(
        one("id").alias("term_id"),
        F.regexp_extract(s, r"(?m)^name:[ \t]*(.*?)[ \t]*$", 1).alias("name"),
        F.filter(many("alt_id"), lambda x: F.rlike(x, F.lit(id_pattern))).alias("alt_ids"),
        F.filter(many("is_a"), lambda x: F.rlike(x, F.lit(id_pattern))).alias("parents"),
        (one("is_obsolete") == "true").alias("obsolete"),
        F.nullif(one("replaced_by"), F.lit("")).alias("replaced_by"),
    )
    return terms.filter(F.rlike("term_id", F.lit(id_pattern)))


def tables(terms: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The tables that the ontology operators take: term, isa and alt."""
    return (
        terms.select("term_id", "obsolete", "replaced_by"),
        terms.select(F.col("term_id").alias("child"), F.explode("parents").alias("parent")),
        terms.select(F.explode("alt_ids").alias("alt_id"), "term_id"),
    )


def term_id(text: Column) -> Column:
    """An id in capitals, trimmed."""
    return F.upper(F.trim(text))
