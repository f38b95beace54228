"""Projection of the tables to a labelled property graph with a closed vocabulary, and lineage."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import dangling, last_nodes

#: Labels of nodes and types of relationships.
LABELS = [
    "Claim", "Evidence", "KnowledgeGap", "Experiment", "RequiredCapability", "CapabilityClaim", "Laboratory", "Researcher", "ResearchAsset",
    "Organization", "Grant", "ClinicalStudy", "CollaborationOpportunity",
]
TYPES = [
    "REQUIRES", "HAS_CAPABILITY", "HAS_ASSET", "STUDIES", "FUNDED_FOR", "AUTHORED", "OPERATES", "MAY_ADDRESS", "MAY_REUSE", "GENERATED_FROM",
    "TESTS", "COULD_RESOLVE", "POSSIBLY_SAME_AS",
]

#: Tables that give nodes: (table, label, id, properties, and a property of one value).
NODE_TABLES = [
    ("upstream", "Claim", "claim_id", ["statement", "refinement_status"], ("kind", "CURATED")),
    ("atomic", "Claim", "claim_id", ["statement", "refinement_status", "rule_applied"], ("kind", "EXTRACTED")),
    ("observations", "Evidence", "evidence_id", ["source_identifier", "origin"], None),
    ("gaps", "KnowledgeGap", "gap_id", ["question", "gap_type", "status"], None),
    ("experiments", "Experiment", "experiment_id", ["question", "label", "human_review_required"], None),
    ("capabilities", "RequiredCapability", "capability_id", ["canonical_name", "capability_category", "human_review_status"], None),
    ("capability_claims", "CapabilityClaim", "claim_id", ["status", "directness", "recency", "human_review_status"], None),
    ("laboratories", "Laboratory", "lab_id", ["canonical_name", "institution", "official_url"], None),
    ("researchers", "Researcher", "researcher_id", ["canonical_name", "institution", "role"], None),
    ("assets", "ResearchAsset", "asset_id", ["canonical_name", "asset_type", "reuse_status", "availability"], None),
    ("organizations", "Organization", "organization_id", ["canonical_name", "organization_type"], None),
    ("grants", "Grant", "grant_id", ["title", "organization", "active", "project_end"], None),
    ("studies", "ClinicalStudy", "study_id", ["title", "overall_status"], None),
    ("collaborations", "CollaborationOpportunity", "collaboration_id", ["status", "missing_capability_count"], None),
]
#: Tables that give relationships: (table, type, start, end, properties).
EDGE_TABLES = [
    ("atomic", "GENERATED_FROM", "claim_id", "upstream_id", []),
    ("evidence_roles", "STUDIES", "claim_id", "evidence_id", ["evidence_role"]),
    ("gap_claims", "COULD_RESOLVE", "gap_id", "claim_id", []),
    ("experiments", "TESTS", "experiment_id", "gap_id", []),
    ("capabilities", "REQUIRES", "experiment_id", "capability_id", []),
    ("capability_claims", "HAS_CAPABILITY", "claim_id", "capability_id", ["status"]),
    ("capability_claims", "HAS_CAPABILITY", "subject_id", "claim_id", []),
    ("laboratories", "MAY_ADDRESS", "lab_id", "experiment_id", []),
    ("personnel", "AUTHORED", "researcher_id", "lab_id", ["basis"]),
    ("assets", "HAS_ASSET", "creator", "asset_id", []),
    ("assets", "MAY_REUSE", "experiment_id", "asset_id", ["reuse_status"]),
    ("organization_assets", "OPERATES", "organization_id", "asset_id", []),
    ("resolutions", "POSSIBLY_SAME_AS", "left_id", "right_id", ["status", "human_review_status"]),
    ("collaborations", "MAY_ADDRESS", "collaboration_id", "experiment_id", []),
    ("participants", "MAY_ADDRESS", "subject_id", "collaboration_id", ["proposed_role"]),
]


def project(tables: dict[str, DataFrame]) -> tuple[DataFrame, DataFrame]:
    """Nodes (id, label, properties) and relationships (start_id, end_id, type, properties) of the tables that are there.

    Properties are JSON in the order above, without nulls. Of an id's nodes that of the last table wins (in a table, by `ord` if
    it has one); relationships that are alike in all are one; one without a start or an end is none. "#..." after an id is cut off.
    """
    unknown = sorted(set(tables) - {t for t, *_ in NODE_TABLES + EDGE_TABLES})
    if unknown:
        raise ValueError(f"no such tables: {', '.join(unknown)}")

    def properties(df: DataFrame, names: list[str], fixed: tuple[str, str] | None = None) -> Column:
        own = [F.col(n).cast("string").alias(n) for n in names if n in df.columns]
        return F.to_json(F.struct(*([F.lit(fixed[1]).alias(fixed[0])] if fixed else []), *own)) if own or fixed else F.lit("{}")

    parts = []
    for i, (table, label, key, names, fixed) in enumerate(NODE_TABLES):
        if table in tables:
            df = tables[table]
            place = F.col("ord").cast("long") if "ord" in df.columns else F.lit(0).cast("long")
            parts.append(df.select(F.col(key).cast("string").alias("id"), F.lit(label).alias("label"), properties(df, names, fixed).alias("properties"), (F.lit(i) * F.lit(1 << 40) + place).alias("ord")))
    rows = []
    for table, kind, start, end, names in EDGE_TABLES:
        if table in tables:
            df = tables[table]
            ends = [F.substring_index(F.col(c).cast("string"), "#", 1).alias(n) for c, n in ((start, "start_id"), (end, "end_id"))]
            rows.append(df.filter(F.col(start).isNotNull() & F.col(end).isNotNull()).select(*ends, F.lit(kind).alias("type"), properties(df, names).alias("properties")))
    whole = last_nodes(reduce(DataFrame.unionByName, parts)).select("id", "label", "properties")
    return whole, reduce(DataFrame.unionByName, rows).distinct()


def nodes(parts: list[tuple[str, DataFrame]]) -> DataFrame:
    """(label, table with id, name, ord) pairs -> id, label, name; the last row of an id wins."""
    _known([label for label, _ in parts], LABELS)
    rows = [df.select(F.col("id").cast("string").alias("id"), F.lit(label).alias("label"), F.col("name").cast("string").alias("name"), F.col("ord").cast("long").alias("ord"), F.lit(i).alias("part")) for i, (label, df) in enumerate(parts)]
    whole = reduce(DataFrame.unionByName, rows).withColumn("ord", F.col("part") * F.lit(1 << 40) + F.col("ord"))
    return last_nodes(whole).select("id", "label", "name")


def relationships(parts: list[tuple[str, DataFrame]]) -> DataFrame:
    """(type, table with start_id, end_id and a role, if any) pairs -> distinct relationships; "#..." after an id is cut off."""
    _known([t for t, _ in parts], TYPES)
    rows = []
    for kind, df in parts:
        role = F.col("role") if "role" in df.columns else F.lit(None).cast("string")
        rows.append(df.select(F.substring_index(F.col("start_id").cast("string"), "#", 1).alias("start_id"), F.substring_index(F.col("end_id").cast("string"), "#", 1).alias("end_id"), F.lit(kind).alias("type"), role.alias("role")))
    return reduce(DataFrame.unionByName, rows).distinct()


def check(node_table: DataFrame, edge_table: DataFrame) -> DataFrame:
    """Relationships with an end that is no node."""
    return dangling(edge_table, node_table)


def _known(names: list[str], vocabulary: list[str]) -> None:
    unknown = sorted(set(names) - set(vocabulary))
    if unknown:
        raise ValueError(f"not in the closed vocabulary: {', '.join(unknown)}")


def lineage(claims: DataFrame, observations: DataFrame, reviews: DataFrame, gaps: DataFrame, experiments: DataFrame) -> DataFrame:
    """One row a claim: its observations, reviews, gaps and their experiments, as sorted arrays of ids."""
    def ids(df: DataFrame, key: str, value: str, name: str) -> DataFrame:
        return df.groupBy(key).agg(F.array_sort(F.collect_set(value)).alias(name))

    trials = gaps.join(experiments.select("gap_id", "experiment_id"), "gap_id")
    out = claims.select("claim_id")
    for part in (ids(observations, "claim_id", "observation_id", "observations"), ids(reviews, "claim_id", "review_id", "reviews"), ids(gaps, "claim_id", "gap_id", "gaps"), ids(trials, "claim_id", "experiment_id", "experiments")):
        out = out.join(part, "claim_id", "left")
    empty = F.array().cast("array<string>")
    return out.select("claim_id", *[F.coalesce(F.col(c).cast("array<string>"), empty).alias(c) for c in ("observations", "reviews", "gaps", "experiments")])
