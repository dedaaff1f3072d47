"""Clinical-shaped views over the star-schema and event tables used for testing.

``timeline`` reads events as a person's record: the event type says which
clinical table a row belongs to, ``k`` in its properties is the concept, and the
part with that key supplies the concept's name and class.  ``encounters`` reads
orders as hospital stays, with covariates and outcomes taken from their lines.
Every row of the source tables takes part; attributes come from the data's own
columns.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, functions as F

from cohortkit.functions.expressions import flag, month_start
from cohortkit.operators.analysis import BEFORE, POST
from cohortkit.operators.rules import RouteRules
from cohortkit.sources import lookups

Tables = Callable[[str], DataFrame]

# route concepts an exposure is given, by the class of the drug's part
ORAL, INTRAVENOUS, TOPICAL, UNKNOWN = 4132161, 4171047, 4263689, 0
RULES = RouteRules(enteral_parts=("ring", "rod"), parenteral_parts=("gear", "bolt"),
                   enteral_concepts=tuple(range(0, 30)), parenteral_concepts=tuple(range(60, 80)))
LABELS = ("gizmo", "widget", "plate", "ring", "rod", "bolt")
DROPS = ("gear",)
CODESETS = {"antibiotic": 1, "extended": 2, "vasopressor": 3, "imv": 4, "ecmo": 5}

STEMS = ("OBESITY", "TOBACCOSMOKER", *(
    stem for steps in lookups.SCORE_COMPONENTS.values() for stem, _ in steps))


class Timeline:
    """Event tables around each person's first purchase."""

    def __init__(self, tables: Tables):
        self.tables = tables
        self.events = tables("events").select(
            "event_id", F.col("user_id").alias("person_id"), "ts",
            F.to_date("ts").alias("dt"), "event_type", "value",
            F.get_json_object("props", "$.k").cast("int").alias("k"))
        self.part = tables("part").select(
            F.col("p_partkey").cast("int").alias("concept_id"),
            F.col("p_name").alias("concept_name"), "p_type", "p_size", "p_brand")

    def facts(self) -> DataFrame:
        """One row per person with at least one purchase."""
        kind, dt, value = F.col("event_type"), F.col("dt"), F.col("value")
        of = lambda name, column: F.when(kind == name, column)
        stem_days = []
        for i, stem in enumerate(STEMS):
            hit = F.when((kind == "signup") & (F.floor(F.col("k") / 5) == i), dt)
            stem_days += [F.min(hit).alias(f"_lo_{stem}"), F.max(hit).alias(f"_hi_{stem}")]
        per = self.events.groupBy("person_id").agg(
            F.min(of("purchase", dt)).alias("index_start"),
            F.floor(F.max("value") / 12).cast("int").alias("_stay"),
            F.min(of("error", dt)).alias("first_positive"),
            F.min(of("signup", dt)).alias("first_diagnosis"),
            F.min_by("event_type", "ts").alias("_first"),
            F.max_by("event_type", "ts").alias("_last"),
            F.max("value").alias("_peak"), F.max(of("error", value)).alias("_error"),
            F.max(of("click", value)).alias("_click"), F.max(of("view", value)).alias("_view"),
            F.min_by(value, of("view", F.col("ts"))).alias("_view_first"),
            F.min(of("view", dt)).alias("_view_lo"),
            F.max_by(value, of("view", F.col("ts"))).alias("_view_last"),
            F.max(of("view", dt)).alias("_view_hi"), *stem_days)
        people = self.tables("customer").select(
            F.col("c_custkey").alias("person_id"), F.col("c_nationkey").alias("data_partner_id"),
            F.col("c_mktsegment").alias("race_ethnicity"),
            (F.floor((F.col("c_acctbal") + 1000) / 160) + 18).cast("int").alias("age"),
            F.substring("c_name", 14, 5).alias("postal_code"))
        start = F.col("index_start")
        indicators = [c for stem in STEMS for c in (
            flag(F.col(f"_lo_{stem}") < start).alias(stem + BEFORE),
            flag(F.col(f"_hi_{stem}") >= start).alias(stem + POST))]
        return (per.where(start.isNotNull()).join(people, "person_id", "left").select(
            "person_id", "data_partner_id", "age", "race_ethnicity", "postal_code",
            F.when(F.col("_last").isin("click", "view"), "MALE")
            .when(F.col("_last").isin("purchase", "error"), "FEMALE")
            .otherwise("No matching concept").alias("gender_concept_name"),
            (F.col("_click") / 10).alias("sdoh2"), "index_start",
            F.date_add("index_start", F.col("_stay")).alias("index_end"),
            "first_positive", "first_diagnosis",
            flag(F.col("_first") != "signup").alias("hospitalized"),
            flag(F.col("_peak") > 250).alias("died_in_hospital"),
            flag(F.col("_error") > 120).alias("ecmo_in_stay"),
            flag(F.col("_click") > 120).alias("imv_in_stay"),
            flag(F.col("_view") > 120).alias("antiviral_in_stay"),
            flag(F.col("_peak") > 180).alias("steroid_in_stay"),
            F.when(F.col("_view_lo") < start, F.col("_view_first")).alias("bmi_before"),
            F.when(F.col("_view_hi") >= start, F.col("_view_last")).alias("bmi_post"),
            *indicators))

    def cohort(self) -> DataFrame:
        return self.facts().where(F.col("hospitalized") == 1)

    def _kind(self, name: str) -> DataFrame:
        return self.events.where(F.col("event_type") == name)

    def drugs(self) -> DataFrame:
        """Purchases as drug exposures; small values have no end date or no route."""
        kinds, value = F.col("p_type"), F.col("value")
        route = (F.when(value < 20, UNKNOWN).when(kinds.isin("ECONOMY", "SMALL"), ORAL)
                 .when(kinds.isin("LARGE", "STANDARD"), INTRAVENOUS)
                 .when(kinds == "MEDIUM", F.when(value < 60, ORAL).otherwise(INTRAVENOUS))
                 .otherwise(TOPICAL))
        end = F.when(value >= 10, F.date_add("dt", F.floor(value / 30).cast("int")))
        return (self._kind("purchase")
                .join(self.part, F.col("k") == F.col("concept_id"), "left")
                .select("person_id", F.col("dt").alias("drug_exposure_start_date"),
                        end.alias("drug_exposure_end_date"), F.col("k").alias("drug_concept_id"),
                        F.col("concept_name").alias("drug_concept_name"),
                        route.alias("route_concept_id")))

    def conditions(self) -> DataFrame:
        return (self._kind("signup")
                .join(self.part, F.col("k") == F.col("concept_id"), "left")
                .select("event_id", "person_id", F.col("k").alias("condition_concept_id"),
                        F.col("concept_name").alias("condition_concept_name"),
                        F.col("dt").alias("condition_start_date")))

    def procedures(self) -> DataFrame:
        return self._kind("error").select("person_id", F.col("k").alias("procedure_concept_id"),
                                          F.col("dt").alias("procedure_date"))

    def observations(self) -> DataFrame:
        return self._kind("click").select("person_id", F.col("k").alias("observation_concept_id"),
                                          F.col("dt").alias("observation_date"))

    def measurements(self) -> DataFrame:
        return self._kind("view").select(
            F.col("event_id").alias("measurement_id"), "person_id",
            F.col("k").alias("measurement_concept_id"), "value",
            F.col("dt").alias("measurement_date"), F.col("ts").alias("measurement_datetime"))

    def concepts(self) -> DataFrame:
        return self.part.select("concept_id", "concept_name")

    def concept_set_members(self) -> DataFrame:
        """Sets by size and type of the part; some brands are superseded versions."""
        size, kind = F.col("p_size"), F.col("p_type")
        member = {"antibiotic": size <= 40, "extended": size.between(10, 25),
                  "vasopressor": size > 40, "imv": kind.isin("MEDIUM", "LARGE"),
                  "ecmo": kind == "PROMO"}
        tags = F.array_compact(F.array(*(
            F.when(cond, F.struct(F.lit(CODESETS[name]).alias("codeset_id"),
                                  F.lit(name).alias("concept_set_name")))
            for name, cond in member.items())))
        return self.part.select(
            "concept_id", (~F.col("p_brand").isin("Brand#1", "Brand#2"))
            .alias("is_most_recent_version"), F.explode(tags).alias("t")).select(
            "t.codeset_id", "t.concept_set_name", "concept_id", "is_most_recent_version")

    def _named(self, *nouns: str) -> DataFrame:
        hit = reduce(lambda a, b: a | b, [F.col("concept_name").endswith(n) for n in nouns])
        return self.part.where(hit).select("concept_id")

    def injuries(self) -> DataFrame:
        return self._named("gear", "bolt")

    def major_procedures(self) -> DataFrame:
        return self._named("plate", "ring")

    def late_infections(self) -> DataFrame:
        return self._named("widget")

    def labs(self) -> DataFrame:
        """Concept -> measure, by the type of the part."""
        kind = F.col("p_type")
        return self.part.select("concept_id", F.when(kind.isin("ECONOMY", "SMALL"), "pct")
                                .when(kind.isin("STANDARD", "LARGE"), "wbc")
                                .alias("measure_name")).where(F.col("measure_name").isNotNull())

    def states(self) -> DataFrame:
        region = self.tables("region").select(F.col("r_regionkey").alias("n_regionkey"),
                                              F.col("r_name").alias("region"))
        return self.tables("nation").join(region, "n_regionkey").select(
            F.col("n_name").alias("state"), F.col("n_name").alias("division"), "region")

    def zips(self) -> DataFrame:
        nation = self.tables("nation").select(F.col("n_nationkey").alias("c_nationkey"),
                                              F.col("n_name").alias("state"))
        return self.tables("customer").join(nation, "c_nationkey").select(
            F.substring("c_name", 14, 5).alias("postal_code"), "state")


def encounters(tables: Tables) -> DataFrame:
    """One row per order, shaped like the main analysis frame."""
    qty, returned, status = F.col("l_quantity"), F.col("l_returnflag"), F.col("l_linestatus")
    disc, tax, price = F.col("l_discount"), F.col("l_tax"), F.col("l_extendedprice")
    ever = lambda cond: F.max(flag(cond))
    day_bit = F.expr("shiftleft(1, l_linenumber - 1)")
    lines = tables("lineitem").groupBy(F.col("l_orderkey").alias("person_id")).agg(
        F.count(F.lit(1)).cast("int").alias("CCI"),
        F.avg(F.when(returned == "R", qty)).alias("wbc"),
        (F.max(F.when(status == "O", price)) / 2500).alias("bmi"),
        ever(price > 90000).alias("obesity"), ever(tax == 0).alias("smoker"),
        ever((returned == "R") & (status == "F")).alias("early_imv"),
        ever((returned == "A") & (qty > 45)).alias("early_ecmo"),
        ever((returned == "A") & (status == "O") & (disc >= 0.05)).alias("early_vasopressor_use"),
        ever((returned == "N") & (disc >= 0.09)).alias("early_trauma_flag"),
        ever(tax >= 0.08).alias("early_major_procedure"),
        ever(qty == 50).alias("long_imv"), ever(qty == 1).alias("late_cdad"),
        F.max(F.to_date("l_shipdate")).alias("_ship"),
        F.max(qty).cast("int").alias("total_length_of_stay"),
        F.sum(F.round(disc * 100).cast("int")).alias("_disc"),
        F.bit_or(day_bit).alias("_any"),
        F.bit_or(F.when(returned.isin("R", "A"), day_bit)).alias("_iv"))
    places = (tables("nation").join(tables("region"), F.col("n_regionkey") == F.col("r_regionkey"))
              .select(F.col("n_nationkey").alias("c_nationkey"), F.col("r_name").alias("region"),
                      F.col("n_name").alias("division")))
    people = tables("customer").join(places, "c_nationkey").select(
        F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("data_partner_id"),
        F.col("c_mktsegment").alias("race_ethnicity"), (F.col("c_acctbal") / 100).alias("sdoh2"),
        (F.floor((F.col("c_acctbal") + 1000) / 160) + 18).cast("int").alias("age"),
        "region", "division")
    joined = (tables("orders").withColumnRenamed("o_orderkey", "person_id")
              .join(lines, "person_id", "left").join(people, "o_custkey"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    days = {f"{kind}_days_to_day_{d}":
            F.bit_count(zero(mask).bitwiseAND(F.lit(2 ** (d + 1) - 1)))
            for kind, mask in (("any", "_any"), ("parenteral", "_iv")) for d in (4, 5, 6)}
    flags = ("obesity", "smoker", "early_imv", "early_ecmo", "early_vasopressor_use",
             "early_trauma_flag", "early_major_procedure", "long_imv", "late_cdad")
    base = joined.select(
        "person_id", "data_partner_id", "age", "race_ethnicity", "region", "division", "sdoh2",
        F.when(F.col("o_orderstatus") == "F", "FEMALE").when(F.col("o_orderstatus") == "O", "MALE")
        .otherwise("UNKNOWN_OTHER").alias("gender_concept_name"),
        F.to_date("o_orderdate").alias("index_start"),
        month_start(F.to_date("o_orderdate")).alias("reporting_period"),
        zero("CCI").alias("CCI"), "wbc", "bmi", *(zero(f).alias(f) for f in flags),
        zero("total_length_of_stay").alias("total_length_of_stay"),
        flag(F.col("_ship") > F.date_add(F.to_date("o_orderdate"), 1500))
        .alias("late_antibiotic_exposure"),
        F.when(F.col("o_orderpriority") == "1-URGENT", "high")
        .when(F.col("o_orderpriority") == "2-HIGH", "low").otherwise("not measured")
        .alias("pct_group"),
        flag(F.col("o_totalprice") < 100000 + 50000 * F.least(zero("CCI"), F.lit(6)))
        .alias("target"), zero("_disc").alias("_disc"),
        *(d.cast("int").alias(name) for name, d in days.items()))
    died = flag(F.col("_disc") > (6 - F.col("target")) * F.col("CCI"))
    return (base.withColumn("hospital_mortality", died)
            .withColumn("primary_outcome",
                        flag((F.col("long_imv") == 1) | (F.col("hospital_mortality") == 1)))
            .withColumn("exposure_days", F.col("parenteral_days_to_day_5"))
            .drop("_disc"))
