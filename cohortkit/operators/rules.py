"""Resolving ambiguous attributes: route rates, ordered rules, text labels."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from cohortkit.functions.expressions import contains_any, first_match, flag
from cohortkit.sources import lookups


@dataclass(frozen=True)
class RouteRules:
    """What decides a route when none is recorded, in order of trust."""

    enteral_parts: Sequence[str] = lookups.ENTERAL_NAME_PARTS
    parenteral_parts: Sequence[str] = lookups.PARENTERAL_NAME_PARTS
    enteral_concepts: Sequence[int] = lookups.ENTERAL_CONCEPTS
    parenteral_concepts: Sequence[int] = lookups.PARENTERAL_CONCEPTS
    dominant_rate: float = lookups.DOMINANT_RATE


def route_rates(exposures: DataFrame, routes: DataFrame) -> DataFrame:
    """Per drug, how often it is given enterally / parenterally when that is known.

    Counts per (drug, route) come first, so a drug holding much of the data is
    a handful of rows by the time it meets the route table.
    """
    counts = (exposures.groupBy("drug_concept_id", "route_concept_id")
              .agg(F.count(F.lit(1)).alias("n")))
    known = routes.where(F.col("is_enteral") | F.col("is_parenteral")).select(
        F.col("concept_id").alias("route_concept_id"), "is_enteral", "is_parenteral")
    n = F.sum("n")
    return (counts.join(known, "route_concept_id").groupBy("drug_concept_id").agg(
        n.alias("occurrence_count"),
        (F.sum(F.col("n") * flag(F.col("is_enteral"))) / n).alias("enteral_rate"),
        (F.sum(F.col("n") * flag(F.col("is_parenteral"))) / n).alias("parenteral_rate")))


def _decide(rules: Sequence[tuple[Column, bool, int]], name: str) -> list[Column]:
    """The value and the strategy number of the first rule that holds."""
    value = strategy = F
    for condition, outcome, number in rules:
        value = value.when(condition, F.lit(outcome))
        strategy = strategy.when(condition, F.lit(number))
    return [value.otherwise(F.lit(False)).alias(name),
            strategy.otherwise(F.lit(5)).alias(f"{name}_strategy")]


def rule_cascade(exposures: DataFrame, routes: DataFrame, rates: DataFrame,
                 rules: RouteRules = RouteRules(),
                 keep: Sequence[str] = ("person_id", "hospital_day", "drug_concept_id",
                                        "drug_concept_name")) -> DataFrame:
    """Decide enteral and parenteral for every exposure day, and say by which rule.

    ``keep`` names the columns that come along.

    Strategies: 1 recorded route, 2 the drug's dominant route, 3 its name, 4 a
    curated list, 5 undecided (False).  The two flags are decided independently,
    so a row can end up with both or neither.
    """
    direct = routes.select(F.col("concept_id").alias("route_concept_id"),
                           F.col("is_enteral").alias("_e"), F.col("is_parenteral").alias("_p"))
    usual = rates.select("drug_concept_id", "enteral_rate", "parenteral_rate")
    name, concept = F.col("drug_concept_name"), F.col("drug_concept_id")

    def chain(own: str, other: str, rate: str, parts, concepts):
        return [(F.col(own), True, 1), (F.col(other), False, 1),
                (F.col(rate) > rules.dominant_rate, True, 2),
                (contains_any(name, parts), True, 3),
                (concept.isin(list(concepts)), True, 4)]

    joined = (exposures.join(direct, "route_concept_id", "left")
              .join(usual, "drug_concept_id", "left"))
    return joined.select(
        *keep,
        *_decide(chain("_e", "_p", "enteral_rate", rules.enteral_parts,
                       rules.enteral_concepts), "is_enteral"),
        *_decide(chain("_p", "_e", "parenteral_rate", rules.parenteral_parts,
                       rules.parenteral_concepts), "is_parenteral"))


def unmapped_frequency(routed: DataFrame) -> DataFrame:
    """Drugs left without a route, most frequent first."""
    return (routed.where(~F.col("is_enteral") & ~F.col("is_parenteral"))
            .groupBy("drug_concept_id")
            .agg(F.max("drug_concept_name").alias("drug_concept_name"),
                 F.count(F.lit(1)).alias("occurrence_count"))
            .orderBy(F.desc("occurrence_count"), "drug_concept_id"))


def route_rates_named(rates: DataFrame, concept: DataFrame) -> DataFrame:
    """Route rates with the concept's name, most frequent first."""
    names = concept.select(F.col("concept_id").alias("drug_concept_id"), "concept_name")
    return (rates.join(names, "drug_concept_id", "left")
            .orderBy(F.desc("occurrence_count"), "drug_concept_id"))


def first_match_label(df: DataFrame, text: str = "drug_concept_name",
                      labels: Sequence[str] = lookups.DRUG_LABELS,
                      drops: Sequence[str] = lookups.DROP_LABELS,
                      name: str = "drug_name") -> DataFrame:
    """Add the first label contained in the text, the drop marker, or NULL."""
    return df.withColumn(name, first_match(F.col(text), labels, drops))


def labelled_person_day(exposures: DataFrame, labelled: DataFrame, id: str = "person_id",
                        concept: str = "drug_concept_id", label: str = "drug_name") -> DataFrame:
    """Distinct (person, day, label); dropped and unlabelled drugs are left out."""
    names = labelled.where(F.col(label) != lookups.DROP).select(concept, label)
    return exposures.join(names, concept).select(id, "hospital_day", label).distinct()


def label_counts_by_day(person_day: DataFrame, label: str = "drug_name") -> DataFrame:
    """Persons per day and label."""
    return (person_day.groupBy("hospital_day", label)
            .agg(F.count(F.lit(1)).cast("int").alias("c")))
