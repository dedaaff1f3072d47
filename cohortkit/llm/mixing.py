"""Mixing sources to target weights by fitting a subset of whole documents to each budget."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from cohortkit.llm.store import settle

#: Lengths up to the remaining budget are fitted exactly below so many words.
WINDOW = 1 << 14
#: Documents of one source and length that are ranked together, on average.
RANKED = 4096

PLAN_SCHEMA = "source string, size long, n long, whole long, extra long"


def token_length(text: Column) -> Column:
    """Number of words (runs without ASCII white space); 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def fit_subset(lengths: Sequence[int], counts: Sequence[int], budget: int) -> list[int]:
    """How many items of each length to take so that their sum is the largest up to ``budget``.

    Bounded knapsack by reachable sums, held as the bits of one number: an item length with a
    count is split into doubling chunks, each of which shifts the reachable sums once.
    """
    taken = [0] * len(lengths)
    mask, reached, steps = (1 << (budget + 1)) - 1, 1, []
    for i, (length, count) in enumerate(zip(lengths, counts)):
        count, chunk = min(count, budget // length), 1
        while count and not reached >> budget:
            use = min(chunk, count)
            new = (reached << (use * length)) & mask & ~reached
            reached |= new
            steps.append((i, use, new))
            count, chunk = count - use, chunk * 2
    at = reached.bit_length() - 1
    for i, use, new in reversed(steps):
        if new >> at & 1:
            taken[i] += use
            at -= use * lengths[i]
    return taken


def plan_source(lengths: np.ndarray, counts: np.ndarray, target: float, window: int = WINDOW) -> tuple[int, np.ndarray]:
    """(whole, extra): every document is taken ``whole`` times, and ``extra[i]`` documents of
    length ``lengths[i]`` once more, so that the words come as near below ``target`` as they can.

    Each length first gives its share of the rest, rounded down; the longest lengths then take
    one more each while the budget stays over half the window; what remains is fitted exactly.
    """
    total = int((lengths * counts).sum())
    if not total or target <= 0:
        return 0, np.zeros(len(lengths), np.int64)
    whole = int(target // total)
    budget = int(round(target - whole * total))
    extra = (counts * (budget / total)).astype(np.int64) * (lengths > 0)
    left = budget - int((lengths * extra).sum())
    order = np.argsort(-lengths)
    for i in order:
        room = min(int(counts[i] - extra[i]), max(0, left - window // 2) // max(1, int(lengths[i])))
        if room > 0 and lengths[i]:
            extra[i] += room
            left -= room * int(lengths[i])
    fits = [i for i in order if 0 < lengths[i] <= left and extra[i] < counts[i]]
    more = fit_subset([int(lengths[i]) for i in fits], [int(counts[i] - extra[i]) for i in fits], max(0, left))
    extra[fits] += np.array(more, np.int64)
    return whole, extra


def ranked_sources(sizes: DataFrame) -> DataFrame:
    """Number (source, source_size) rows from 0 by code point, null last, without a single task:
    ranges are numbered on their own and shifted by the sizes of those before (one number each)."""
    dealt = settle(sizes.repartitionByRange(F.asc_nulls_last("source"))
                       .withColumn("part", F.spark_partition_id()))
    before, shift = 0, F.lit(0)
    for part, n in sorted(tuple(r) for r in dealt.groupBy("part").count().collect()):
        shift = F.when(F.col("part") == part, F.lit(before)).otherwise(shift)
        before += n
    within = Window.partitionBy("part").orderBy(F.asc_nulls_last("source"))
    return dealt.select("source", "source_size", (F.row_number().over(within) - 1 + shift).alias("rank"))


def source_targets(sizes: DataFrame, weights: Sequence[float], share: float, cap: float) -> DataFrame:
    """(source, source_size, target): ``share`` of all sizes dealt by weight, no source over
    ``cap`` times its size; what lies above is dealt again to the others until none is above."""
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)),
                          (F.col("rank") % len(weights) + 1).cast("int"))
    ranked = settle(ranked_sources(sizes).select("source", "source_size", weight.alias("weight")))
    most = F.col("source_size") * cap
    total = (ranked.agg(F.sum("source_size")).first()[0] or 0) * share
    level, capped = 0.0, -1
    while True:
        # a source at its cap stays there: the level only rises
        full = most <= F.col("weight") * level
        n, used, open_weight = ranked.agg(
            F.coalesce(F.sum(F.when(full, 1)), F.lit(0)), F.coalesce(F.sum(F.when(full, most)), F.lit(0.0)),
            F.coalesce(F.sum(F.when(~full, F.col("weight"))), F.lit(0.0))).first()
        if n == capped or not open_weight:
            break
        level, capped = (total - used) / open_weight, n
    return ranked.select("source", "source_size", F.when(
        F.lit(not open_weight) | (most <= F.col("weight") * level), most)
        .otherwise(F.col("weight") * level).cast("double").alias("target"))


def mix(docs: DataFrame, weights: Sequence[float] = (3, 1, 2), share: float = 1.5, cap: float = 2.0,
        seed: int = 0) -> DataFrame:
    """Add (size, source_size, target, copies) to every row of ``docs``.

    Sources in code point order, null last, weigh ``weights``, repeated.  Whole documents are
    taken ``copies`` times so that each source's words reach its target as nearly as its lengths
    allow.  Counts by exact length (a histogram, never the documents) go to one task per source;
    which documents of a length are taken is decided by a seeded hash of id and text: reruns
    agree.  Rows that repeat exactly share their hash and are taken or left together.

    A null text has size 0; a null source is a source; ids may repeat or be null; columns named
    as the results are replaced.  An empty table gives none.
    """
    named = ["size", "source_size", "target", "copies"]
    rows = docs.drop(*named).withColumn("size", token_length(F.col("text"))).withColumn(
        "_h", F.xxhash64(F.lit(seed), "doc_id", "text"))
    narrow = settle(rows.select("source", "size", "_h"))
    targets = settle(source_targets(
        narrow.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, cap))

    def plan(pdf: pd.DataFrame) -> pd.DataFrame:
        whole, extra = plan_source(pdf["size"].to_numpy(), pdf["n"].to_numpy(), float(pdf["target"].iloc[0]))
        return pdf[["source", "size", "n"]].assign(whole=whole, extra=extra)

    lengths = narrow.groupBy("source", "size").agg(F.count("*").alias("n"))
    same = lengths["source"].eqNullSafe(targets["source"])
    plans = settle(lengths.join(targets, same).select(lengths["source"], "size", "n", "target")
                       .groupBy("source").applyInPandas(plan, PLAN_SCHEMA))

    # the hash below which documents of a length are taken: buckets of the hash range are
    # counted, and only the bucket in which the last one lies is ranked
    some = plans.filter("extra > 0 AND extra < n").select(
        F.col("source").alias("s"), F.col("size").alias("z"), "extra",
        F.ceil(F.col("n") / RANKED).cast("long").alias("buckets"))
    unit = F.shiftrightunsigned(F.col("_h"), 33).cast("double") / F.lit(float(1 << 31))
    placed = (narrow.join(some, narrow["source"].eqNullSafe(some["s"]) & (narrow["size"] == some["z"]))
              .select("s", "z", "extra", F.shiftrightunsigned(F.col("_h"), 1).alias("u"),
                      F.floor(unit * F.col("buckets")).alias("b")))
    by = Window.partitionBy("s", "z").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    edge = (placed.groupBy("s", "z", "b", "extra").agg(F.count("*").alias("in_b"))
            .withColumn("before", F.coalesce(F.sum("in_b").over(by), F.lit(0)))
            .filter("before < extra AND before + in_b >= extra")
            .select(F.col("s").alias("s2"), F.col("z").alias("z2"), F.col("b").alias("b2"), "before"))
    cuts = (placed.join(edge, placed["s"].eqNullSafe(edge["s2"]) & (placed["z"] == edge["z2"])
                        & (placed["b"] == edge["b2"]))
            .withColumn("r", F.row_number().over(Window.partitionBy("s", "z").orderBy("u")) + F.col("before"))
            .filter("r = extra").select("s", "z", F.col("u").alias("cut")))
    final = plans.join(cuts, plans["source"].eqNullSafe(cuts["s"]) & (plans["size"] == cuts["z"]), "left")
    final = settle(final.join(targets.withColumnRenamed("source", "t"), plans["source"].eqNullSafe(F.col("t")))
                       .select(plans["source"].alias("_s"), plans["size"].alias("_z"), "whole", "extra", "n",
                               "cut", "source_size", "target"))
    taken = F.col("whole") + F.when(F.col("extra") >= F.col("n"), F.lit(1)).when(
        F.shiftrightunsigned(F.col("_h"), 1) <= F.col("cut"), F.lit(1)).otherwise(F.lit(0))
    return (rows.join(final, rows["source"].eqNullSafe(final["_s"]) & (rows["size"] == final["_z"]))
            .select(*[c for c in docs.columns if c not in named], "size", "source_size", "target",
                    taken.cast("long").alias("copies")))
