"""Gaps and experiments as text from classified pairs and settled claims, with the guards that refuse the rest."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import axis_label, functional_node, label_problems
from .pairs import MECHANISTIC


def violations(df: DataFrame, key: str, rules: dict[str, Column]) -> DataFrame:
    """(key, reason): every rule that a row breaks, one row each; a condition that is null counts as broken. One pass over the rows."""
    broken = F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(True)), F.lit(reason)) for reason, c in rules.items()]))
    return df.select(key, F.explode(broken).alias("reason"))


def kept(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """The rows that break no rule."""
    return df.filter(~reduce(Column.__or__, [F.coalesce(c, F.lit(True)) for c in rules.values()]))


def pair_rules() -> dict[str, Column]:
    return {
        "only a mechanistic relationship raises a gap": ~F.col("relation").isin(*MECHANISTIC),
        "a gap needs evidence": F.col("n_evidence") == 0,
        "a gap needs a bridge": F.size("terms") + F.size("factors") == 0,
    }


def claim_rules() -> dict[str, Column]:
    return {"a settled claim has no gap": F.col("status").isin("SUPPORTED", "CONTRADICTED")}


def experiment_rules() -> dict[str, Column]:
    blank = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    needs = {f"an experiment needs its {c}": blank(c) for c in ("readout", "control", "support", "refutation")}
    return needs | {"support and refutation must differ": ~blank("support") & F.col("support").eqNullSafe(F.col("refutation"))}


def knowledge_gaps(pairs: DataFrame) -> DataFrame:
    """Mechanistic pairs (pair_id, name_a, name_b, relation, n_evidence, terms, factors) -> gap_id, question, axis.

    A pair of another class, without evidence or without a bridge raises no gap: violations() with pair_rules() lists those.
    """
    axis = axis_label(F.col("terms"), F.col("factors"))
    question = F.format_string("Do %s and %s disturb %s in the same way?", "name_a", "name_b", axis)
    node = functional_node(F.col("terms"), F.col("factors"))
    return kept(pairs, pair_rules()).select(F.concat(F.lit("gap:"), "pair_id").alias("gap_id"), "pair_id", question.alias("question"), axis.alias("axis"), node.alias("node"))


def claim_gaps(claims: DataFrame) -> DataFrame:
    """Claims (claim_id, statement, status) that are not settled -> gap_id, question."""
    question = F.format_string("What would settle: %s?", "statement")
    return kept(claims, claim_rules()).select(F.concat(F.lit("gap:"), "claim_id").alias("gap_id"), "claim_id", question.alias("question"), F.col("status"))


def experiments(gaps: DataFrame) -> DataFrame:
    """gaps (gap_id, axis, readout, control, support, refutation) -> proposals; each says what would refute it, with a control and a readout.

    Those that don't are left out: violations() with experiment_rules() lists them.
    """
    design = F.format_string("Measure %s against %s; %s supports, %s refutes %s.", "readout", "control", "support", "refutation", "axis")
    return kept(gaps, experiment_rules()).select(F.concat(F.lit("exp:"), "gap_id").alias("experiment_id"), "gap_id", design.alias("design"), F.lit(True).alias("human_review_required"))


def refused_labels(labels: DataFrame) -> DataFrame:
    """labels (id, label, terms) -> (id, problem, word) of those that say more than their terms; an accepted label gives no row."""
    return labels.select("id", F.explode(label_problems(F.col("label"), F.col("terms"))).alias("p")).select("id", "p.*")


def priorities(gaps: DataFrame, weights: dict[str, float]) -> DataFrame:
    """gaps with scored dimensions (0 to 1, null counts 0) -> priority, their weighted sum to 4 places."""
    total = sum((F.coalesce(F.col(c), F.lit(0.0)) * F.lit(w) for c, w in list(weights.items())[1:]), F.coalesce(F.col(next(iter(weights))), F.lit(0.0)) * F.lit(next(iter(weights.values()))))
    return gaps.withColumn("priority", F.round(total, 4))


def context_basis(observations: DataFrame) -> DataFrame:
    """observations (span, location, derivation) -> how a context field is known: STATED, DERIVED or NOT_STATED."""
    basis = F.when(F.col("span").isNotNull() & F.col("location").isNotNull(), "STATED").when(F.col("derivation").isNotNull(), "DERIVED").otherwise("NOT_STATED")
    return observations.withColumn("basis", basis)
