"""Exact Jaccard self-join of shingle sets with adaptive multi-match prefixes."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from cohortkit.llm.components import components
from cohortkit.llm.store import discard, settle
from cohortkit.llm.text import chunks, distinct, lean, shingle_hashes

#: At most so many of the most frequent shingles are ordered by frequency.  Any order gives
#: the same links; this one keeps shared boilerplate out of the prefixes.
FREQUENT = 1 << 17
#: What checking a candidate costs against reading one posting.
CHECK_COST = 4
LEVELS = 3

SET_SCHEMA = "k1 long, k2 long, doc_id long, n long, s1 long, s2 long, tokens array<long>"


def row_key(*columns: str) -> list[Column]:
    """128 bits that name a row's content."""
    return [F.xxhash64(*columns).alias("k1"), F.xxhash64(F.lit(7), *reversed(columns)).alias("k2")]


def shingle_sets(texts: Iterable[str | None], size: int) -> Iterator[np.ndarray]:
    """Per text the distinct shingles of all of it as sorted 64-bit hashes."""
    for _, some in chunks(texts):
        yield from map(distinct, shingle_hashes(some, size))


def shingle_set(text: str | None, size: int) -> np.ndarray:
    return next(shingle_sets([text], size))


def repeated(found: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(values, counts) of what stands more than once in all arrays together; empties the list.

    Sorts in place: most shingles stand once, and unique values with their places would take
    several times the room."""
    values = np.concatenate(found) if found else np.zeros(0, np.uint64)
    found.clear()
    values.sort()
    same = values[1:] == values[:-1]
    first = np.flatnonzero(same & ~np.r_[False, same][:-1])
    last = np.flatnonzero(same & ~np.r_[same, False][1:])
    return values[first], last - first + 2


def frequent_shingles(docs: DataFrame, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, rank) of the shingles that repeat most within batches of documents, sorted by
    hash; the rank grows with the count.  Counted over all documents, kept to ``FREQUENT``."""
    @lean
    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            values, n = repeated(list(shingle_sets(batch["text"], size)))
            yield pd.DataFrame({"token": values.view(np.int64), "n": n.astype(np.int64)})

    top = (docs.select("text").mapInPandas(count, "token long, n long").groupBy("token")
           .agg(F.sum("n").alias("n")).filter("n >= 4").orderBy(F.desc("n"), "token").limit(FREQUENT).toPandas())
    hashes = top["token"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(hashes)
    return hashes[order], (len(hashes) - np.arange(len(hashes)))[order]


def document_sets(docs: DataFrame, size: int, num: int, den: int) -> DataFrame:
    """One row per document: content key, set size, set signature, and its longest prefix."""
    hashes, rank = frequent_shingles(docs, size)
    maybe = np.zeros(1 << 20, bool)
    maybe[(hashes & np.uint64((1 << 20) - 1)).astype(np.int64)] = True

    def prefix(found: np.ndarray) -> np.ndarray:
        n = len(found)
        length = min(n, n - -(-num * n // den) + LEVELS)
        sure = maybe[(found & np.uint64((1 << 20) - 1)).astype(np.int64)]
        if sure.any():
            at = np.minimum(np.searchsorted(hashes, found), len(hashes) - 1)
            sure &= hashes[at] == found
            often = np.flatnonzero(sure)
            often = often[np.argsort(rank[at[often]], kind="stable")]
            return np.r_[found[~sure][:length], found[often][:max(0, length - int((~sure).sum()))]]
        return found[:length]

    @lean
    def sets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            n, s1, s2, tokens = [], [], [], []
            for f in shingle_sets(batch["text"], size):
                # of a whole set only its size, sums and prefix are held
                with np.errstate(over="ignore"):
                    s1.append(int(f.sum(dtype=np.uint64).view(np.int64)))
                    s2.append(int(((f ^ (f >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)).sum(dtype=np.uint64)
                                  .view(np.int64)))
                n.append(len(f))
                tokens.append(prefix(f).view(np.int64).copy())
            yield pd.DataFrame({"k1": batch["k1"], "k2": batch["k2"], "doc_id": batch["doc_id"].astype("Int64"),
                                "n": n, "s1": s1, "s2": s2, "tokens": tokens})

    keyed = docs.select(*row_key("doc_id", "text"), "doc_id", "text")
    return settle(keyed.mapInPandas(sets, SET_SCHEMA).withColumn("uid", F.monotonically_increasing_id()))


def postings(reps: DataFrame, num: int, den: int) -> DataFrame:
    """(token, uid, n, layer, level): prefix tokens that two sets share, of each set's chosen level.

    Level l takes the standard prefix and l - 1 tokens more (``layer`` is the first level with a
    token), and then asks for l shared tokens.  A set can have at most (postings read) / l
    candidates, which with the postings themselves is its cost at level l; it takes the cheapest.
    """
    base = F.col("n") - F.ceil(F.col("n") * F.lit(num) / F.lit(den)).cast("long") + 1
    every = (reps.select("uid", "n", F.posexplode("tokens").alias("pos", "token"))
             .select("uid", "token", F.greatest(F.lit(1), F.col("pos") - base + 2).cast("byte").alias("layer")))
    df = settle(every.groupBy("token").agg(F.count("*").alias("df")).filter("df > 1"))
    shared = settle(every.join(df, "token").select("token", "uid", "layer", "df"))
    discard(df)
    reads = [F.sum(F.when(F.col("layer") <= l, F.col("df"))) for l in range(1, LEVELS + 1)]
    costs = [F.coalesce(r, F.lit(0)) * (1 + CHECK_COST / l) for l, r in enumerate(reads, 1)]
    chosen = (shared.groupBy("uid").agg(*[c.alias(f"c{l}") for l, c in enumerate(costs, 1)])
              .join(reps.select("uid", "n"), "uid"))
    level = F.lit(1)
    for l in range(2, LEVELS + 1):
        lower = F.col(f"c{l}") < F.least(*[F.col(f"c{m}") for m in range(1, LEVELS + 1) if m != l])
        level = F.when(lower & (F.ceil(F.col("n") * F.lit(num) / F.lit(den)) >= l), F.lit(l)).otherwise(level)
    levels = chosen.select("uid", "n", level.alias("level"))
    lists = settle(shared.join(levels, "uid").filter("layer <= level")
                   .select("token", "uid", "n", "layer", "level"))
    discard(shared)
    return lists


def with_texts(pairs: DataFrame, sets: DataFrame, docs: DataFrame, f: Callable, schema: str,
               block: int = 1024) -> DataFrame:
    """Apply ``f`` to (a, part, b, text) sorted by (a, part): a's own text first, with a null b, then the
    texts of its partners.  The partners of one a are dealt out to parts of about ``block`` by hash,
    and a's text goes to each.  A text goes from the documents, by content key, straight to the task
    that compares it; no pair copies both of its texts."""
    pairs = settle(pairs)
    parts = pairs.groupBy("a").agg(F.ceil(F.count("*") / block).cast("int").alias("parts"))
    seconds = pairs.join(parts, "a").select(
        "a", F.pmod(F.xxhash64("b"), F.col("parts")).cast("int").alias("part"), "b", F.col("b").alias("uid"))
    firsts = parts.select("a", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"),
                          F.lit(None).cast("long").alias("b"), F.col("a").alias("uid"))
    wanted = firsts.unionByName(seconds).join(sets.select("uid", "k1", "k2"), "uid").drop("uid")
    done = settle(docs.select(*row_key("doc_id", "text"), "text").join(wanted, ["k1", "k2"])
                  .select("a", "part", "b", "text").repartition("a", "part")
                  .sortWithinPartitions("a", "part", F.asc_nulls_first("b")).mapInPandas(f, schema))
    discard(pairs)
    return done


def verified(pairs: DataFrame, sets: DataFrame, docs: DataFrame, size: int, num: int, den: int) -> DataFrame:
    """Of the candidate pairs (a, b), those whose sets really are similar enough."""
    @lean
    def check(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, own = None, None
        for batch in batches:
            good = []
            for a, b, found in zip(batch["a"], batch["b"], shingle_sets(batch["text"], size)):
                if pd.isna(b):
                    now, own = a, found
                    continue
                both = len(np.intersect1d(own, found, assume_unique=True))
                if a == now and den * both >= num * (len(own) + len(found) - both):
                    good.append((a, int(b)))
            yield pd.DataFrame(good, columns=["a", "b"], dtype="int64")

    return with_texts(pairs, sets, docs, check, "a long, b long")


def differences(pairs: DataFrame, sets: DataFrame, docs: DataFrame, size: int) -> DataFrame:
    """(g, uid, n, gn, lost, added) for pairs (centre a, member b) that share over half of the
    larger set: which of the centre's sorted shingles a member lacks, and which it adds.  The
    centre is a member without differences.  This is all one needs to compare any two members."""
    @lean
    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, own = None, None
        for batch in batches:
            out = []
            for a, part, b, found in zip(batch["a"], batch["part"], batch["b"], shingle_sets(batch["text"], size)):
                if pd.isna(b):
                    if part == 0 and a != now:
                        out.append((a, a, len(found), len(found), np.zeros(0, np.int32), np.zeros(0, np.int64)))
                    now, own = a, found
                    continue
                at = np.minimum(np.searchsorted(found, own), len(found) - 1)
                lost = np.flatnonzero(found[at] != own)
                if a == now and 2 * (len(own) - len(lost)) >= max(len(own), len(found)):
                    added = np.setdiff1d(found, own, assume_unique=True)
                    out.append((a, int(b), len(found), len(own), lost.astype(np.int32), added.view(np.int64)))
            yield pd.DataFrame(out, columns=["g", "uid", "n", "gn", "lost", "added"])

    return with_texts(pairs, sets, docs, compare,
                      "g long, uid long, n long, gn long, lost array<int>, added array<long>")


def linked_in_group(rows: list[tuple], num: int, den: int) -> Iterator[tuple[int, int]]:
    """(uid, root) over the links among members (uid, n, gn, lost, added) of one group.

    |x & y| = |c| - |lost x| - |lost y| + |lost x & lost y| + |added x & added y|, for all
    pairs at once by products of 0/1 columns, a stretch of columns at a time.
    """
    m, gn = len(rows), rows[0][2]
    lost = [np.asarray(r[3], np.int64) for r in rows]
    added = [np.asarray(r[4], np.int64) for r in rows]
    names, code = np.unique(np.concatenate(added), return_inverse=True)
    column = np.concatenate([np.concatenate(lost), gn + code])
    row = np.concatenate([np.repeat(np.arange(m), [len(x) for x in lost]), np.repeat(np.arange(m), [len(x) for x in added])])
    often = np.bincount(column, minlength=gn + len(names)) > 1
    row, column = row[often[column]], (np.cumsum(often) - 1)[column[often[column]]]
    both = np.zeros((m, m), np.float32)
    for start in range(0, int(often.sum()), 4096):
        here = (column >= start) & (column < start + 4096)
        block = np.zeros((m, 4096), np.float32)
        block[row[here], column[here] - start] = 1
        both += block @ block.T
    n = np.array([r[1] for r in rows], np.int64)
    kept = gn - np.array([len(x) for x in lost], np.int64)
    both = kept[:, None] + kept[None, :] - gn + both.astype(np.int64)
    link = den * both >= num * (n[:, None] + n[None, :] - both)
    uid = np.array([r[0] for r in rows], np.int64)
    yield from zip(uid.tolist(), roots(link, uid).tolist())


def roots(link: np.ndarray, label: np.ndarray) -> np.ndarray:
    """The smallest label that each row of a symmetric link matrix reaches."""
    link = link | np.eye(len(link), dtype=bool)
    highest = np.iinfo(np.int64).max
    while True:
        least = np.where(link, label[None, :], highest).min(axis=1)
        if (least == label).all():
            return label
        label = least


def group_links(diffs: DataFrame, num: int, den: int, block: int = 1024) -> DataFrame:
    """(uid, root) of all links between members of one group, each pair compared once.

    A group over ``block`` members is dealt out by hash to blocks, and pairs of blocks go to
    tasks; what a task returns is a row per member, not per pair.
    """
    count = diffs.groupBy("g").agg(F.count("*").alias("m")).filter("m > 1")
    dealt = (diffs.join(count, "g").withColumn("blocks", F.ceil(F.col("m") / block).cast("int"))
             .withColumn("b", F.pmod(F.xxhash64("uid"), F.col("blocks")).cast("int"))
             .withColumn("o", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
             .withColumns({"i": F.least("b", "o"), "j": F.greatest("b", "o")}))

    @lean
    def link(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, held = None, []
        for batch in batches:
            out = []
            for g, i, j, *row in zip(*[batch[c] for c in ("g", "i", "j", "uid", "n", "gn", "lost", "added")]):
                if (g, i, j) != key:
                    if len(held) > 1:
                        out += linked_in_group(held, num, den)
                    key, held = (g, i, j), []
                held.append(row)
            yield pd.DataFrame(out, columns=["uid", "root"], dtype="int64")
        yield pd.DataFrame(list(linked_in_group(held, num, den)) if len(held) > 1 else [], columns=["uid", "root"], dtype="int64")

    return settle(dealt.repartition("g", "i", "j").sortWithinPartitions("g", "i", "j", "uid")
                      .select("g", "i", "j", "uid", "n", "gn", "lost", "added")
                      .mapInPandas(link, "uid long, root long").filter("uid <> root").distinct())


def across_groups(marked: DataFrame) -> DataFrame:
    """Postings of the tokens that several groups share; all but the largest group's are ``minor``."""
    marked = marked.withColumn("class", F.col("g"))
    per = marked.groupBy("token", "class").agg(F.count("*").alias("m"))
    major = per.groupBy("token").agg(F.max(F.struct("m", "class")).alias("c"), F.count("*").alias("classes"))
    return marked.join(major.filter("classes > 1"), "token").select(
        "token", "uid", "n", "layer", "level", "comp", "g", (F.col("class") != F.col("c.class")).alias("minor"))


def candidate_pairs(split: DataFrame, num: int, den: int) -> DataFrame:
    """(a, b), a < b, of different groups and components that share as many tokens as their level asks.

    Which of the two is ``minor`` changes from token to token, so pairs are counted by ordered ids."""
    small, large = F.least("na", "nb"), F.greatest("na", "nb")
    left = split.filter("minor").select("token", *[F.col(c).alias(c + "a") for c in ("uid", "n", "layer", "level", "comp", "g")])
    right = split.select("token", "minor", *[F.col(c).alias(c + "b") for c in ("uid", "n", "layer", "level", "comp", "g")])
    return (left.join(right, "token")
            .filter("compa <> compb AND ga <> gb AND (NOT minor OR uida < uidb)")
            .filter("greatest(layera, layerb) <= least(levela, levelb)")
            .filter(den * small >= num * large)
            .groupBy(F.least("uida", "uidb").alias("a"), F.greatest("uida", "uidb").alias("b"))
            .agg(F.count("*").alias("shared"), F.first(F.least("levela", "levelb")).alias("need"))
            .filter("shared >= need").select("a", "b"))


def near_sets(docs: DataFrame, size: int = 4, num: int = 85, den: int = 100) -> DataFrame:
    """(k1, k2, doc_id, n_shingles, component_id, kept) for every row of ``docs`` (doc_id, text).

    Two rows link when den * |intersection| >= num * |union| of their sets of ``size``-word
    shingles; ``component_id`` is the smallest doc_id over links; exactly one row per component
    is ``kept``.  (k1, k2) name the row's content (``row_key``).

    Rows with equal sets are one node.  Candidates come from shared prefix tokens.  As only
    components are asked for, no pair inside a component needs a check.  First every set joins
    the group of a centre (the first set of a posting list) with which it shares much; all
    pairs of a group are compared by their differences from its centre.  Then come the
    candidates between components and between groups, by the prefix rule; so a large group of
    near copies is never written out as pairs.

    Null or empty texts have no shingles and link with nothing; a text of fewer words is one
    shingle; ids may be null (a component of null ids only has a null id) or repeat; other
    columns are ignored; an empty table gives none.
    """
    whole = document_sets(docs, size, num, den)
    sets = settle(whole.drop("tokens"))
    full = sets.filter("n > 0")
    reps = settle(full.groupBy("s1", "s2", "n").agg(F.min("uid").alias("uid")))
    lists = postings(whole.join(reps.select("uid"), "uid", "left_semi"), num, den)
    discard(whole)
    centre = lists.groupBy("token").agg(F.min("uid").alias("a"))
    stars = (lists.join(centre, "token").filter("uid <> a").groupBy("uid", "a").agg(F.count("*").alias("shared"))
             .groupBy("uid").agg(F.max("shared").alias("most"), F.collect_list(F.struct("shared", "a")).alias("c"))
             .select(F.array_min(F.transform(F.filter("c", lambda x: 4 * x.shared >= F.col("most")),
                                             lambda x: x.a)).alias("a"), F.col("uid").alias("b")))
    diffs = differences(stars, sets, docs, size)
    grouped = group_links(diffs, num, den)
    labels = settle(components(grouped).toDF("uid", "root"))
    groups = diffs.filter("uid <> g").select("uid", "g")

    marked = (lists.join(labels, "uid", "left").join(groups, "uid", "left")
              .withColumns({"comp": F.coalesce("root", "uid"), "g": F.coalesce("g", "uid")}))
    split = settle(across_groups(marked))
    discard(lists, diffs)
    pairs = candidate_pairs(split, num, den)
    links = grouped.toDF("a", "b").unionByName(verified(pairs, sets, docs, size, num, den))
    discard(split)
    labels = settle(components(links).toDF("uid", "root"))
    alike = full.select("uid", "s1", "s2", "n", "doc_id").join(
        reps.select("s1", "s2", "n", F.col("uid").alias("rep")), ["s1", "s2", "n"])
    rooted = alike.join(labels.select(F.col("uid").alias("rep"), "root"), "rep", "left").select(
        "uid", "doc_id", F.coalesce("root", "rep").alias("root"))
    rooted = settle(rooted.unionByName(sets.filter("n = 0").select("uid", "doc_id", F.col("uid").alias("root"))))
    best = rooted.groupBy("root").agg(F.min("doc_id").alias("component_id"), F.min(F.struct(
        F.col("doc_id").isNull().alias("no"), "doc_id", "uid")).alias("first"))
    return (sets.select("uid", "k1", "k2", F.col("n").alias("n_shingles"))
            .join(rooted, "uid").join(best, "root")
            .select("k1", "k2", "doc_id", "n_shingles", "component_id",
                    (F.col("first.uid") == F.col("uid")).alias("kept")))
