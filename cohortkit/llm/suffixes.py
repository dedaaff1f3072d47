"""Removal of byte strings that start more than once, by suffix arrays of shards."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from cohortkit.llm.jaccard import row_key
from cohortkit.llm.store import discard, settle
from cohortkit.llm.text import lean, prefix_sums, quick_hashes, quiet, span_hashes

LENGTH = 200             # bytes of a string that must not start twice
ANCHOR = 100             # bytes hashed to choose a string's shard
SHARD = 2_000_000        # bytes of one suffix array, about
#: Anchors found so often deal their strings out one by one (see ``remove_repeats``).
HOT = 50_000
BREAK = 255              # parts the pieces of a shard; no byte of UTF-8


# ---- suffix arrays of one shard -------------------------------------------------------------

def _group(symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A stable order by symbol, the count of each, and every item's place in its group."""
    order = np.argsort(symbols, kind="stable")
    count = np.bincount(symbols, minlength=256)
    first = np.cumsum(count) - count
    return order, count, np.arange(len(symbols)) - first[symbols[order]]


def induce(text: np.ndarray, small: np.ndarray, lms: np.ndarray) -> np.ndarray:
    """All suffixes in order, from the leftmost-smaller ones in theirs.

    Buckets are scanned symbol by symbol; what a bucket holds by then puts its left neighbours
    at the next free places of their buckets, all at once.  Those that land in the bucket itself
    are the next wave."""
    n = len(text)
    count = np.bincount(text, minlength=256)
    end = np.cumsum(count)
    head = end - count
    small_count = np.bincount(text[small], minlength=256)
    found = np.full(n, -1, np.int64)
    order, seeds, place = _group(text[lms])
    sorted_lms = lms[order]
    found[(end - seeds)[text[sorted_lms]] + place] = sorted_lms
    used = np.flatnonzero(count)

    free = head.copy()

    def push_large(items: np.ndarray) -> None:
        left = items[items > 0] - 1
        left = left[~small[left]]
        if len(left):
            symbols = text[left]
            order, more, place = _group(symbols)
            left = left[order]
            found[free[text[left]] + place] = left
            np.add(free, more, out=free)

    push_large(np.array([n]))      # the end of the text is smaller than all
    for c in used:
        at = head[c]
        while at < free[c]:
            until = free[c]
            push_large(found[at:until])
            at = until
        push_large(found[end[c] - seeds[c]:end[c]])

    last = end.copy()

    def push_small(items: np.ndarray) -> None:
        left = items[items > 0] - 1
        left = left[small[left]]
        if len(left):
            symbols = text[left]
            order, more, place = _group(symbols)
            left = left[order]
            found[last[text[left]] - 1 - place] = left
            np.subtract(last, more, out=last)

    for c in used[::-1]:
        at = end[c]
        while at > last[c]:
            until = last[c]
            push_small(found[until:at][::-1])
            at = until
        push_small(found[head[c]:end[c] - small_count[c]][::-1])
    return found


def sort_names(names: np.ndarray) -> np.ndarray:
    """Suffixes of a string of names, in order: ranks of stretches are doubled, for those only
    that are not yet told apart.  (Names are too many to scan bucket by bucket.)"""
    n = len(names)
    order = np.argsort(names, kind="stable")
    rank = np.empty(n, np.int64)
    same = np.r_[False, names[order][1:] == names[order][:-1]]
    start = np.flatnonzero(~same)
    rank[order] = np.repeat(start, np.diff(np.r_[start, n]))
    step = 1
    while True:
        tied = same | np.r_[same[1:], False]
        if not tied.any():
            return order
        at = np.flatnonzero(tied)
        items = order[at]
        after = items + step
        second = np.where(after < n, rank[np.minimum(after, n - 1)] + 1, 0)
        first = rank[items]
        by = np.lexsort((second, first))
        items, first, second = items[by], first[by], second[by]
        order[at] = items
        same_here = np.r_[False, (first[1:] == first[:-1]) & (second[1:] == second[:-1])]
        same[at] = same_here
        start = np.flatnonzero(~same_here)
        rank[items] = np.repeat(at[start], np.diff(np.r_[start, len(items)]))
        step *= 2


def suffix_array(text: np.ndarray) -> np.ndarray:
    """The suffixes of ``text`` (uint8) in order, by induced sorting."""
    n = len(text)
    if n < 2:
        return np.arange(n)
    after = np.r_[text[1:].astype(np.int16), -1]
    turn = np.flatnonzero(text != after)
    small = np.repeat(text[turn] < after[turn], np.diff(np.r_[-1, turn]))
    lms = np.flatnonzero(small & np.r_[False, ~small[:-1]])
    if not len(lms):
        return induce(text, small, lms)
    # substrings between leftmost-smaller suffixes: sorted, named, and the names sorted
    is_lms = np.zeros(n, bool)
    is_lms[lms] = True
    first = induce(text, small, lms)
    first = first[is_lms[first]]
    stop = np.minimum(np.r_[lms[1:] + 1, n], n)
    number = np.zeros(n, np.int64)
    number[lms] = np.arange(len(lms))
    hashes = span_hashes(prefix_sums(text), lms, stop)[number[first]]
    sizes = (stop - lms)[number[first]]
    new = np.r_[True, (hashes[1:] != hashes[:-1]) | (sizes[1:] != sizes[:-1])]
    names = np.empty(len(lms), np.int64)
    names[number[first]] = np.cumsum(new) - 1
    order = first if new.all() else lms[sort_names(names)]
    return induce(text, small, order)


def repeated_starts(text: np.ndarray, length: int) -> np.ndarray:
    """Whether the ``length`` symbols from each place on also start elsewhere in ``text``.

    Common prefixes with the neighbour above, in text order: where the symbols before the two
    suffixes agree, the prefix is one shorter than that of the place before; only the others
    are compared."""
    n = len(text)
    sa = suffix_array(text)
    above = np.full(n, -1, np.int64)
    above[sa[1:]] = sa[:-1]
    here = np.arange(n)
    follows = (here > 0) & (above > 0) & (text[np.maximum(here, 1) - 1] == text[np.maximum(above, 1) - 1])
    own = np.flatnonzero(~follows & (above >= 0))
    sums = prefix_sums(text)

    def equal(i: np.ndarray, j: np.ndarray, size: int) -> np.ndarray:
        fits = np.maximum(i, j) + size <= n
        out = np.zeros(len(i), bool)
        i, j = i[fits], j[fits]
        out[fits] = span_hashes(sums, i, i + size) == span_hashes(sums, j, j + size)
        return out

    prefix = np.zeros(n, np.int64)      # of the compared places; short ones stay 0
    long = own[equal(own, above[own], length)]
    reach = np.full(len(long), length, np.int64)
    step = 1 << max(0, n.bit_length() - 1)
    while step:
        reach += step * equal(long + reach, above[long] + reach, step)
        step >>= 1
    prefix[long] = reach
    origin = np.maximum.accumulate(np.where(follows, 0, here))
    common = prefix[origin] - (here - origin)
    hit = np.flatnonzero(common >= length)
    out = np.zeros(n, bool)
    out[hit] = True
    out[above[hit]] = True
    return out


# ---- shards over a corpus -------------------------------------------------------------------

@quiet
def anchors(data: np.ndarray, length: int = LENGTH, size: int = ANCHOR) -> tuple[np.ndarray, ...]:
    """(first, count, hash, twice): every start of a ``length``-byte string, in runs of starts
    whose strings have the same least hash of ``size`` bytes.  Equal strings have the same.
    ``twice`` says that the stretch with that hash stands more than once in the run."""
    n = len(data)
    if n < length:
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(0, np.uint64), none > 0
    own = least = quick_hashes(data, size)
    width, done = length - size + 1, 1
    while 2 * done <= width:
        least = np.minimum(least[:-done], least[done:])
        done *= 2
    if done < width:
        least = np.minimum(least[:-(width - done)], least[width - done:])
    first = np.flatnonzero(np.r_[True, least[1:] != least[:-1]])
    count = np.diff(np.r_[first, len(least)])
    cover = count + width - 1
    begin = np.cumsum(cover) - cover
    at = np.arange(int(cover.sum())) + np.repeat(first - begin, cover)
    times = np.add.reduceat(own[at] == np.repeat(least[first], cover), begin, dtype=np.int64)
    return first, count, least[first], times > 1


def _bytes(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass")


def _starts(texts: DataFrame, length: int, hot: int) -> DataFrame:
    """(uid, first, last) runs of starts whose strings start elsewhere.

    Each text is cut to pieces: the starts that share an anchor, with the bytes their strings
    cover.  Equal pieces are one, and repeat whole; different ones of an anchor meet in a shard."""
    def pieces(with_bytes: bool):
        @lean
        def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                out = []
                for uid, text, where in zip(batch["uid"], batch["text"], batch["where"]):
                    data = _bytes(text)
                    for w in where:
                        h, lo, n = w["h"], w["lo"], w["n"]
                        for a, b in ([(lo, n)] if not w["hot"] else [(lo + i, 1) for i in range(n)]):
                            piece = data[a:a + b + length - 1]
                            sig = hashlib.blake2b(piece, digest_size=16).digest()
                            # a hot anchor's strings go one by one to shards of their own
                            key = int.from_bytes(sig[:8], "little", signed=True) if w["hot"] else h
                            out.append((key, sig, piece if with_bytes else None, uid, a))
                yield pd.DataFrame(out, columns=["h", "sig", "piece", "uid", "lo"])
        return texts.mapInPandas(cut, "h long, sig binary, piece binary, uid long, lo int")

    place = F.xxhash64("uid", "lo")
    distinct = (pieces(True).groupBy("h", "sig")
                .agg(F.first("piece").alias("piece"), F.min(place).alias("x"), F.max(place).alias("y"))
                .select("h", "sig", "piece", (F.col("x") != F.col("y")).alias("many")))

    def shard(rows: list[tuple]) -> list[tuple]:
        sizes = np.array([len(r[2]) for r in rows])
        text = np.frombuffer(bytes([BREAK]).join([r[2] for r in rows]), np.uint8)
        hit = repeated_starts(text, length) if len(rows) > 1 or sizes[0] > length else np.zeros(len(text), bool)
        out, at = [], 0
        for (h, sig, piece, many), size in zip(rows, sizes.tolist()):
            n = size - length + 1
            own = np.ones(n, bool) if many else hit[at:at + n]
            at += size + 1
            edge = np.flatnonzero(np.diff(np.r_[False, own, False].astype(np.int8)))
            out += [(h, sig, int(a), int(b)) for a, b in zip(edge[::2], edge[1::2])]
        return out

    @lean
    def sort(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, size, now = [], 0, None
        columns = ["h", "sig", "a", "b"]
        for batch in batches:
            out = []
            for row in zip(batch["h"], batch["sig"], batch["piece"], batch["many"]):
                if size >= SHARD and row[0] != now:
                    out += shard(held)
                    held, size = [], 0
                now = row[0]
                held.append(row)
                size += len(row[2])
            if out:
                yield pd.DataFrame(out, columns=columns)
        if held:
            yield pd.DataFrame(shard(held), columns=columns)

    runs = settle(distinct.repartition("h").sortWithinPartitions("h")
                  .mapInPandas(sort, "h long, sig binary, a int, b int"))
    owners = pieces(False).select("h", "sig", "uid", "lo")
    return owners.join(runs, ["h", "sig"]).select(
        "uid", (F.col("lo") + F.col("a")).alias("first"), (F.col("lo") + F.col("b")).alias("last"))


def remove_repeats(docs: DataFrame, length: int = LENGTH, hot: int = HOT) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) for every row of ``docs`` (doc_id, text).

    Every byte covered by a ``length``-byte string that also starts anywhere else, in the same or
    another document, is removed, judged on the input.  ``n_spans`` counts the removed runs; the
    digest is of what is left.

    Texts that occur twice are removed whole and stand for one in the rest.  Strings are dealt
    to shards by their anchor (least hash of a stretch): equal strings meet.  Anchors found once
    are dropped before any text moves; equal pieces become one before they meet, so shared
    passages cost one piece.  Anchors found over ``hot`` times send single strings, of which
    only equal ones meet, in place of pieces: no shard grows with one anchor.

    Null texts are empty; matches never cross documents; ids may be null or repeat; other
    columns are ignored; an empty table gives none.
    """
    @lean
    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for k1, k2, doc, text in zip(batch["k1"], batch["k2"], batch["doc_id"].astype("Int64"), batch["text"]):
                data = _bytes(text)
                lo, n, h, twice = anchors(np.frombuffer(data, np.uint8), length, min(ANCHOR, length // 2))
                out.append((k1, k2, doc, len(data), hashlib.sha256(data).hexdigest(), lo.astype(np.int32),
                            n.astype(np.int32), h.view(np.int64), twice))
            frame = pd.DataFrame(out, columns=["k1", "k2", "doc_id", "n_bytes", "sha", "lo", "n", "h", "twice"])
            yield frame.astype({"doc_id": "Int64"})

    rows = docs.select(*row_key("text"), "doc_id", "text")
    table = settle(rows.mapInPandas(scan, "k1 long, k2 long, doc_id long, n_bytes long, sha string, "
                                          "lo array<int>, n array<int>, h array<long>, twice array<boolean>")
                   .withColumn("uid", F.monotonically_increasing_id()))
    # one row stands for the copies of a text
    texts = settle(table.groupBy("k1", "k2").agg(F.count("*").alias("copies"), F.min("uid").alias("uid")))
    runs = (table.join(texts.select("uid"), "uid", "left_semi")
            .select("uid", F.explode(F.arrays_zip("lo", "n", "h", "twice")).alias("w")).select("uid", "w.lo", "w.n", "w.h", "w.twice"))
    shared = (runs.groupBy("h").agg(F.count("*").alias("m")).filter("m > 1")
              .select("h", (F.col("m") > hot).alias("hot")))
    found = runs.join(shared, "h", "left").filter(F.col("hot").isNotNull() | F.col("twice")).select(
        "uid", F.struct("lo", "n", "h", F.coalesce("hot", F.lit(False)).alias("hot")).alias("w"))
    found = settle(found.groupBy("uid").agg(F.collect_list("w").alias("where"))
                   .join(table.select("uid", "k1", "k2", "doc_id"), "uid"))
    near = settle(rows.withColumn("d", F.coalesce("doc_id", F.lit(0))).drop("doc_id").join(
        found.withColumn("d", F.coalesce("doc_id", F.lit(0))).drop("doc_id"), ["k1", "k2", "d"])
        .select("uid", "text", "where"))
    discard(found)
    spans = _starts(near, length, hot).groupBy("uid").agg(
        F.collect_set(F.struct("first", "last")).alias("spans"))

    @lean
    def strip(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for uid, text, spans in zip(batch["uid"], batch["text"], batch["spans"]):
                data = np.frombuffer(_bytes(text), np.uint8)
                change = np.zeros(len(data) + 1, np.int64)
                for s in spans:
                    change[s["first"]] += 1
                    change[s["last"] + length - 1] -= 1
                gone = np.cumsum(change[:-1]) > 0
                edges = int(np.diff(np.r_[0, gone.astype(np.int8)]).clip(0).sum())
                out.append((uid, int(gone.sum()), edges, hashlib.sha256(data[~gone].tobytes()).hexdigest()))
            yield pd.DataFrame(out, columns=["uid", "n_removed", "n_spans", "kept_sha256"])

    partly = (near.select("uid", "text").join(spans, "uid")
              .mapInPandas(strip, "uid long, n_removed long, n_spans long, kept_sha256 string"))
    done = texts.join(partly.dropDuplicates(["uid"]), "uid", "left").drop("uid")
    whole = (F.col("copies") > 1) & (F.col("n_bytes") >= length)
    return table.select("k1", "k2", "doc_id", "n_bytes", "sha").join(done, ["k1", "k2"]).select(
        "doc_id", "n_bytes",
        F.when(whole, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).alias("n_removed"),
        F.when(whole, F.lit(1)).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(whole, F.lit(hashlib.sha256(b"").hexdigest())).otherwise(F.coalesce("kept_sha256", "sha"))
        .alias("kept_sha256"))
