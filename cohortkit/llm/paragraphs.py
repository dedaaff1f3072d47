"""Repeated paragraphs inside documents, found by MinHash bands and verified exactly, and
repeated passages wherever they stand, found by winnowed anchors and widened word by word."""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from cohortkit.llm.components import components
from cohortkit.llm.jaccard import roots, row_key
from cohortkit.llm.store import discard, settle
from cohortkit.llm.text import (LOWER, SPACE, _bytes, chunks, distinct, lean, powers, prefix_sums, quiet, scramble,
                                span_hashes)

WORDS = 5                # words of a shingle
THRESHOLD = (4, 5)       # Jaccard similarity from which paragraphs are copies
RECALL = 0.99            # of pairs at the threshold, that share a band
LEAST_WORDS = 8          # shorter paragraphs are left alone
LEAST_RUN = 20           # words that adjacent copies must have together to be removed
ANCHOR = LEAST_RUN       # words of an anchor
WINDOW = 31              # anchors are the least of so many in a row: every passage of 50 words has one
WIDEN = ANCHOR + WINDOW - 1  # words that a match is widened by on each side of each of its anchors

_STOP = np.zeros(256, bool)
_STOP[list(b".!?")] = True


def tuned_bands(threshold: float, recall: float, most: int = 64) -> tuple[int, int]:
    """(bands, rows): the fewest keys for which a pair at the threshold shares a band with
    probability ``recall``; among equals the most rows, which collide least by chance."""
    best = (most, 1)
    for rows in range(1, 9):
        bands = math.ceil(math.log(1 - recall) / math.log(1 - threshold ** rows))
        if bands <= best[0]:
            best = (bands, rows)
    return best


BANDS, ROWS = tuned_bands(THRESHOLD[0] / THRESHOLD[1], RECALL)
HASHED = ["s1", "s2", *[f"b{i}" for i in range(BANDS)]]
#: An anchor's row has its place as idx, its run as words, its hash as s1, and nothing else.
UNIT_SCHEMA = "k1 long, k2 long, doc_id long, anchor boolean, idx int, words int, " + ", ".join(f"{c} long" for c in HASHED)


def _breaks(data: np.ndarray) -> np.ndarray:
    """Where words begin without white space: before and after each character of the scripts
    that are written without it (Chinese, Japanese and Hangul; Thai, Lao, Khmer, Burmese)."""
    n = len(data)
    after = np.r_[data[1:], np.zeros(min(n, 1), np.uint8)]
    three = (data >= 0xE3) & (data <= 0xED)
    three |= (data == 0xE0) & (after >= 0xB8) & (after <= 0xBB)
    three |= (data == 0xE1) & np.isin(after, [0x80, 0x81, 0x82, 0x9E, 0x9F])
    four = (data == 0xF0) & (after >= 0xA0) & (after <= 0xAF)
    out = three | four
    for lead, size in ((three, 3), (four, 4)):
        out[np.flatnonzero(lead[:max(0, n - size)]) + size] = True
    return out


def _least(x: np.ndarray, n: int, pick: np.ufunc = np.minimum) -> np.ndarray:
    """The least (or by ``pick``) of every n neighbours."""
    size = 1
    while 2 * size <= n:
        x, size = pick(x[:-size], x[size:]), 2 * size
    return pick(x[:len(x) - (n - size)], x[n - size:]) if n > size else x


class Paragraphs:
    """Whole texts cut to paragraphs: at line ends, and after every sentence whose last two
    words hash to an even number, if it has four words.  The cuts depend on the words around
    them only, so a passage is cut alike wherever it stands, also in the middle of a line.

    Texts are laid end to end with a line end between; no cut looks beyond its own text.  ``doc``
    is each paragraph's text, ``idx`` its number there.  A character of a script without spaces
    is a word.
    """

    @quiet
    def __init__(self, *texts: bytes):
        data = np.frombuffer(b"\n".join(texts), np.uint8)
        self.data = data
        self.sizes = [len(t) for t in texts]
        self.begin = np.cumsum([0, *[n + 1 for n in self.sizes[:-1]]])
        inside = ~SPACE[data] if len(data) else np.zeros(0, bool)
        begins = inside & ~np.r_[False, inside[:-1]] if len(data) else inside
        if len(data) and data.max() >= 0xE0:
            begins |= inside & _breaks(data)
        self.starts = np.flatnonzero(begins)
        self.ends = np.flatnonzero(inside & np.r_[(begins | ~inside)[1:], True]) + 1 if len(data) else self.starts
        n = len(self.starts)
        self.hashes = span_hashes(prefix_sums(LOWER[data]), self.starts, self.ends) if n else np.zeros(0, np.uint64)
        if n:
            # where each text's words begin, and their numbers from there
            edge = np.searchsorted(self.starts, [*self.begin, len(data)])
            doc = np.repeat(np.arange(len(texts)), np.diff(edge))
            at = np.arange(n) - np.repeat(edge[:-1], np.diff(edge))
            line = np.zeros(n + 1, bool)
            line[np.searchsorted(self.starts, np.flatnonzero(data == 10))] = True
            line[n] = True
            # what cuts inside lines is asked at stops only
            stop = _STOP[data[self.ends - 1]]
            stops = np.flatnonzero(stop)
            alone = np.ones(len(stops), bool)
            for k in (1, 2, 3):
                alone &= (at[stops] < k) | ~stop[stops - k]
            stops = stops[alone]
            before = np.where(at[stops] > 0, self.hashes[stops - 1], np.uint64(0))
            cut = line[1:]
            cut[stops[scramble(self.hashes[stops] + np.uint64(3) * before) & np.uint64(1) == 0]] = True
            last = np.flatnonzero(cut)
            self.first = np.r_[0, last[:-1] + 1]
            self.last = last
            self.doc = doc[last]
            self.word_doc, self.at = doc, at
        else:
            self.first = self.last = self.doc = self.word_doc = self.at = np.zeros(0, np.int64)
        self.idx = np.arange(len(self.doc)) - np.searchsorted(self.doc, self.doc)
        self.words = self.last - self.first + 1

    @quiet
    def shingles(self) -> np.ndarray:
        """One hash for each word that starts a shingle (paragraph borders are not regarded)."""
        h, n = self.hashes, len(self.hashes) - WORDS + 1
        total = np.zeros(max(0, n), np.uint64)
        for i in range(WORDS if n > 0 else 0):
            total = total * np.uint64(0x9E3779B97F4A7C15) + h[i:n + i]
        return scramble(total)

    def sets(self, which: np.ndarray) -> list[np.ndarray]:
        s = self.shingles()
        return [distinct(s[self.first[i]:self.last[i] - WORDS + 2]) for i in which]

    @quiet
    def signatures(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
        """Two hashes of the paragraphs' words, and a key for each band."""
        h, place = self.hashes, np.arange(len(self.hashes), dtype=np.uint64)
        cuts = np.c_[self.first[which], self.last[which] + 1].ravel()
        def sums(x: np.ndarray) -> np.ndarray:
            return np.add.reduceat(np.r_[x, np.uint64(0)], cuts)[::2]
        # a word's weight depends on its place in the paragraph
        offset = place - np.repeat(self.first, self.words).astype(np.uint64)
        s1 = scramble(sums(h * scramble(offset + np.uint64(11))))
        s2 = scramble(sums(scramble(h + np.uint64(77)) * scramble(offset + np.uint64(99))))
        s = np.r_[self.shingles(), np.zeros(WORDS, np.uint64)]
        cuts = np.c_[self.first[which], self.last[which] - WORDS + 2].ravel()
        keys = []
        for band in range(BANDS):
            key = np.full(len(which), band, np.uint64)
            for row in range(ROWS):
                salt = np.uint64((band * ROWS + row + 1) * 0xD1342543DE82EF95 & (1 << 64) - 1)
                key = scramble(key * np.uint64(31) + np.minimum.reduceat(scramble(s ^ salt), cuts)[::2])
            keys.append(key)
        return s1, s2, keys


    @quiet
    def anchors(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(word, run, hash) of the stretches of ``ANCHOR`` words that hash least among ``WINDOW``
        in a row.  A passage of ``WIDEN`` words or more has one that depends on its words only.

        Anchors of one hash at most ``WINDOW`` words apart, as in "a b a b ...", are a run, named
        by its first word; of one, the first anchor in every ``ANCHOR`` words stays, and the last.
        Two that stay are then at most ``WIDEN`` words apart, so widening by ``WIDEN`` closes the gap."""
        n = len(self.hashes) - ANCHOR + 1
        m = n - WINDOW + 1
        if m < 1:
            return (np.zeros(0, np.int64),) * 2 + (np.zeros(0, np.uint64),)
        up, down = powers(len(self.hashes))
        sums = np.r_[np.uint64(0), np.cumsum(self.hashes * up, dtype=np.uint64)]
        grams = scramble((sums[ANCHOR:] - sums[:-ANCHOR]) * down[:n])
        own = self.word_doc[:m] == self.word_doc[WIDEN - 1:]
        least = np.where(own, _least(grams, WINDOW), np.uint64(0))
        edge = np.zeros(WINDOW - 1, np.uint64)
        word = np.flatnonzero(_least(np.r_[edge, least, edge], WINDOW, np.maximum) == grams)
        order = np.lexsort((word, grams[word], self.word_doc[word]))
        word = word[order]
        h, doc = grams[word], self.word_doc[word]
        new = np.ones(len(word), bool)
        new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1]) | (np.diff(word) > WINDOW)
        first = np.flatnonzero(new)
        run = np.cumsum(new) - 1
        step = (word - word[first[run]]) // ANCHOR
        stay = new | np.r_[True, step[1:] != step[:-1]] | np.r_[new[1:], True]
        return word[stay], word[first[run]][stay], h[stay]

    def short(self, lo: int, hi: int) -> tuple[bytes, bytes]:
        """Four bytes of the hash of each word from lo to hi, backwards and forwards."""
        h = (self.hashes[lo:hi] >> np.uint64(32)).astype(np.uint32)
        return h[::-1].tobytes(), h.tobytes()

    def around(self, words: np.ndarray) -> Iterator[tuple[bytes, bytes]]:
        """Hashes of the words before each anchor (from the nearest on) and of those after it."""
        n = len(self.hashes)
        back, ahead = self.short(0, n)
        doc = self.word_doc[words]
        lo = np.maximum(np.searchsorted(self.word_doc, doc), words - WIDEN)
        hi = np.minimum(np.searchsorted(self.word_doc, doc, "right"), words + ANCHOR + WIDEN)
        for a, word, b in zip(lo.tolist(), words.tolist(), hi.tolist()):
            yield back[4 * (n - word):4 * (n - a)], ahead[4 * (word + ANCHOR):4 * b]


def unit_table(docs: DataFrame) -> DataFrame:
    """A row per paragraph of at least ``LEAST_WORDS`` words: its place, hashes and band keys; one per text, with
    idx -1 and the number of all its paragraphs as ``words``; and one per anchor.  Texts are cut once for all."""
    def rows(batch: pa.RecordBatch, own: np.ndarray, anchor: bool, **columns: np.ndarray) -> pa.RecordBatch:
        names = batch.select(["k1", "k2", "doc_id"]).take(pa.array(own))
        empty = pa.nulls(len(own), pa.int64())
        return pa.RecordBatch.from_arrays(
            [*names.columns, pa.array(np.full(len(own), anchor)),
             *(pa.array(columns[c].astype(np.int32)) for c in ("idx", "words")),
             *(pa.array(columns[c].view(np.int64)) if c in columns else empty for c in HASHED)],
            ["k1", "k2", "doc_id", "anchor", "idx", "words", *HASHED])

    @lean
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            count, units, anchors = np.zeros(len(batch), np.int64), [], []
            for start, texts in chunks(batch.column("text").cast(pa.large_binary()).to_pylist()):
                p = Paragraphs(*texts)
                count[start:start + len(texts)] = np.bincount(p.doc, minlength=len(texts))
                which = np.flatnonzero(p.words >= LEAST_WORDS)
                if len(which):
                    s1, s2, keys = p.signatures(which)
                    units.append((start + p.doc[which], p.idx[which], p.words[which], s1, s2, *keys))
                word, run, h = p.anchors()
                if len(word):
                    anchors.append((start + p.word_doc[word], p.at[word], p.at[run], h))
            none = np.zeros(len(batch), np.int64)
            yield rows(batch, np.arange(len(batch)), False, idx=none - 1, words=count, **{c: none for c in HASHED})
            for found, kind, names in ((units, False, HASHED), (anchors, True, HASHED[:1])):
                if found:
                    own, *columns = map(np.concatenate, zip(*found))
                    yield rows(batch, own, kind, **dict(zip(["idx", "words", *names], columns)))

    return settle(docs.select(*row_key("doc_id", "text"), F.col("doc_id").cast("long").alias("doc_id"), "text")
                  .mapInArrow(cut, UNIT_SCHEMA))


def alike(candidates: DataFrame, docs: DataFrame, block: int = 512) -> DataFrame:
    """(s1, r1) edges between different paragraphs (named by their first hash) that share a band
    key and are similar enough: (key, k1, k2, idx, s1) rows to verified links.

    The paragraphs' texts come back by content key.  All pairs under a key are compared exactly;
    a key with many paragraphs is dealt out in blocks and pairs of blocks."""
    num, den = THRESHOLD
    wanted = candidates.groupBy("k1", "k2").agg(F.collect_set("idx").alias("which"))

    @lean
    def sets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for start, some in chunks(batch["text"]):
                p = Paragraphs(*some)
                own = batch.iloc[start:start + len(some)]
                number = np.repeat(np.arange(len(some)), own["which"].map(len))
                which = np.concatenate(own["which"].to_numpy()).astype(np.int64)
                found = p.sets(np.searchsorted(p.doc, number) + which)
                yield own[["k1", "k2"]].iloc[number].reset_index(drop=True).assign(
                    idx=which.astype(np.int32), shingles=[s.view(np.int64) for s in found])

    texts = (docs.select(*row_key("doc_id", "text"), "text").join(wanted, ["k1", "k2"])
             .select("k1", "k2", "which", "text")
             .mapInPandas(sets, "k1 long, k2 long, idx int, shingles array<long>"))
    size = candidates.groupBy("key").agg(F.count("*").alias("m")).filter("m > 1")
    dealt = (candidates.join(texts, ["k1", "k2", "idx"]).join(size, "key")
             .withColumn("blocks", F.ceil(F.col("m") / block).cast("int"))
             .withColumn("b", F.pmod(F.xxhash64("s1"), F.col("blocks")).cast("int"))
             .withColumn("o", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
             .select("key", F.least("b", "o").alias("i"), F.greatest("b", "o").alias("j"), "s1", "shingles"))

    def linked(held: dict[int, np.ndarray]) -> list[tuple[int, int]]:
        if len(held) == 2:
            (a, x), (b, y) = held.items()
            n = len(x) + len(y)
            both = n - len(distinct(np.concatenate([x, y])))
            return [(max(a, b), min(a, b))] if den * both >= num * (n - both) else []
        ids, own = np.array(list(held), np.int64), list(held.values())
        names, code = np.unique(np.concatenate(own), return_inverse=True)
        row = np.repeat(np.arange(len(own)), [len(x) for x in own])
        both = np.zeros((len(own), len(own)), np.float32)
        for start in range(0, len(names), 4096):
            here = (code >= start) & (code < start + 4096)
            part = np.zeros((len(own), min(4096, len(names) - start)), np.float32)
            part[row[here], code[here] - start] = 1
            both += part @ part.T
        n = np.array([len(x) for x in own])
        root = roots(den * both >= num * (n[:, None] + n[None, :] - both), ids)
        return [(a, b) for a, b in zip(ids.tolist(), root.tolist()) if a != b]

    @lean
    def link(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, held = None, {}
        for batch in batches:
            out = []
            for key, i, j, s1, shingles in zip(*[batch[c] for c in ("key", "i", "j", "s1", "shingles")]):
                if (key, i, j) != now:
                    if len(held) > 1:
                        out += linked(held)
                    now, held = (key, i, j), {}
                held[s1] = np.asarray(shingles)
            yield pd.DataFrame(out, columns=["s1", "r1"], dtype="int64")
        yield pd.DataFrame(linked(held) if len(held) > 1 else [], columns=["s1", "r1"], dtype="int64")

    return settle(dealt.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
                      .mapInPandas(link, "s1 long, r1 long").distinct())


def repeated_paragraphs(docs: DataFrame, every: DataFrame) -> DataFrame:
    """(k1, k2, which, n): per row content, the paragraphs that copy one kept elsewhere (none: an
    empty list), and the number of all its paragraphs.

    Paragraphs with the same words are one; those that share a MinHash band are compared
    exactly; components over the links are the clusters, and of each the first paragraph by
    (doc_id, content, place) is kept.  Rows that repeat exactly count once.  ``every`` is the
    texts' ``unit_table``, used up here.
    """
    texts = every.filter("NOT anchor")
    units = texts.filter("idx >= 0")
    # keys under which different paragraphs meet
    small = F.hash("s1")
    banded = F.explode(F.array(*[f"b{i}" for i in range(BANDS)])).alias("key")
    keyed = units.select(banded, small.alias("h"))
    keys = settle(keyed.groupBy("key").agg(F.min("h").alias("x"), F.max("h").alias("y")).filter("x <> y").select("key"))
    # only key and paragraph travel by key; where a paragraph stands is looked up for those that met
    met = settle(units.select(banded, "s1").join(keys, "key", "left_semi").distinct())
    discard(keys)
    stands = (units.select("s1", "k1", "k2", "idx").join(met.select("s1").distinct(), "s1", "left_semi")
              .groupBy("s1").agg(F.min(F.struct("k1", "k2", "idx")).alias("u")))
    candidates = settle(met.join(stands, "s1").select("key", "s1", "u.*"))
    slim = settle(texts.select("k1", "k2", "doc_id", "idx", "words", "s1", "s2"))
    discard(met, every)
    units = slim.filter("idx >= 0")
    exact = units.groupBy("s1", "s2").agg(F.count("*").alias("m")).filter("m > 1").select("s1", "s2")
    near = settle(components(alike(candidates, docs)).toDF("s1", "root"))
    flagged = exact.select("s1").unionByName(near.select("s1")).distinct()
    members = (units.select("k1", "k2", "doc_id", "idx", "s1").join(flagged, "s1").join(near, "s1", "left")
               .withColumn("root", F.coalesce("root", "s1")))
    members = settle(members.drop("s1"))
    place = F.struct(F.col("doc_id").isNull().alias("no"), "doc_id", "k1", "k2", "idx")
    first = members.groupBy("root").agg(F.min(place).alias("kept"))
    copies = members.join(first, "root").filter(
        "NOT (k1 = kept.k1 AND k2 = kept.k2 AND idx = kept.idx)")
    counts = slim.filter("idx < 0").select("k1", "k2", F.lit(None).cast("int").alias("idx"), F.col("words").alias("n"))
    marked = copies.select("k1", "k2", "idx", F.lit(None).cast("int").alias("n")).unionByName(counts)
    found = settle(marked.groupBy("k1", "k2").agg(F.collect_set("idx").alias("which"), F.max("n").alias("n")))
    discard(slim, candidates, near, members)
    return found


def repeated_anchors(every: DataFrame) -> DataFrame:
    """(k1, k2, doc_id, pos, run, h) of a ``unit_table``'s anchors whose hash stands in several texts or runs."""
    anchors = every.filter("anchor").select("k1", "k2", "doc_id", F.col("idx").alias("pos"), F.col("words").alias("run"),
                                            F.col("s1").alias("h"))
    # few, so found on short rows before the places travel
    own = F.hash("k1", "k2", "run").alias("x")
    again = settle(anchors.select("h", own).groupBy("h").agg(F.min("x").alias("x"), F.max("x").alias("y"))
                   .filter("x <> y").select("h"))
    table = settle(anchors.join(again, "h", "left_semi"))
    discard(again)
    return table


def repeated_passages(docs: DataFrame, table: DataFrame | None = None) -> DataFrame:
    """(k1, k2, anchors): per row content, the anchors that copy one that stands earlier, by (doc_id,
    content, place), with the words around that earlier one.

    What travels is a hash per anchor, and ``WIDEN`` word hashes on each side of the earlier one,
    never a whole text.  A run does not copy itself.  Rows that repeat exactly count once.  ``table`` is
    the texts' ``repeated_anchors``, used up here."""
    if table is None:
        every = unit_table(docs)
        table = repeated_anchors(every)
        discard(every)
    place = F.struct(F.col("doc_id").isNull().alias("no"), "doc_id", "k1", "k2", "pos", "run")
    kept = settle(table.groupBy("h").agg(F.min(place).alias("a"))
                  .select("h", F.col("a.k1").alias("a1"), F.col("a.k2").alias("a2"), F.col("a.pos").alias("at"),
                          F.col("a.run").alias("own")))
    wanted = kept.groupBy(F.col("a1").alias("k1"), F.col("a2").alias("k2")).agg(F.collect_list(F.struct("at", "h")).alias("w"))

    @lean
    def around(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for start, texts in chunks(batch["text"]):
                p = Paragraphs(*texts)
                some = batch["w"].iloc[start:start + len(texts)]
                first = np.repeat(np.searchsorted(p.word_doc, np.arange(len(texts))), some.map(len))
                words = first + np.array([x["at"] for w in some for x in w], np.int64)
                rows = [(x["h"], *sides) for x, sides in zip((x for w in some for x in w), p.around(words))]
                yield pd.DataFrame(rows, columns=["h", "before", "after"])

    words = (docs.select(*row_key("doc_id", "text"), "text").join(wanted, ["k1", "k2"]).select("text", "w")
             .mapInPandas(around, "h long, before binary, after binary").dropDuplicates(["h"]))
    # stored, so that the texts' shuffle is gone before the copies travel, and Spark may split the join of a hot hash
    sources = settle(kept.join(words, "h"))
    discard(kept)
    copies = table.join(sources, "h").filter("k1 <> a1 OR k2 <> a2 OR run <> own")
    found = settle(copies.groupBy("k1", "k2").agg(F.collect_set(F.struct("pos", "before", "after")).alias("anchors")))
    discard(table, sources)
    return found


def widened(p: Paragraphs, doc: int, anchors: Iterable[dict]) -> np.ndarray:
    """Which words of a text are in copied passages: the anchors, and as many words to each side
    as are the same around the earlier one."""
    lo, hi = np.searchsorted(p.word_doc, [doc, doc + 1])
    n = int(hi - lo)
    back, ahead = p.short(lo, hi)
    gone = np.zeros(n, bool)

    def same(a: bytes, b: bytes) -> int:
        size = min(len(a), len(b))
        if a[:size] == b[:size]:
            return size // 4
        return int(np.argmax(np.frombuffer(a[:size], np.uint32) != np.frombuffer(b[:size], np.uint32)))

    for x in anchors:
        pos, end = x["pos"], x["pos"] + ANCHOR
        left = same(back[4 * (n - pos):4 * (n - max(0, pos - WIDEN))], x["before"])
        right = same(ahead[4 * end:4 * (end + WIDEN)], x["after"])
        gone[pos - left:end + right] = True
    return gone


def trimmed(p: Paragraphs, doc: int, which: np.ndarray, anchors: Iterable[dict] = ()) -> tuple[str | None, int, int]:
    """(what is left of a text without the paragraphs ``which`` and the passages at ``anchors``, how
    many paragraphs lost words, the words that went); no text if all of it stays.

    Copies next to each other (with only short paragraphs between) are removed from
    ``LEAST_RUN`` words on, with what stands between and the white space after them."""
    lo, hi = np.searchsorted(p.doc, [doc, doc + 1])
    words, begin, size = p.words[lo:hi], p.begin[doc], p.sizes[doc]
    copy = np.zeros(hi - lo, np.int8)
    copy[np.asarray(which, np.int64)] = 1
    idx = np.flatnonzero((words >= LEAST_WORDS) | (copy == 1))
    drop = np.zeros(hi - lo, bool)
    edges = np.flatnonzero(np.diff(np.r_[0, copy[idx], 0]))
    for a, b in zip(edges[::2], edges[1::2]):
        run = idx[a:b]
        if words[run].sum() >= LEAST_RUN:
            drop[run[0]:run[-1] + 1] = True
    gone = np.repeat(drop, words)
    if len(anchors):
        gone |= widened(p, doc, anchors)
    if not gone.any():
        return None, 0, 0
    first = p.first[lo]
    starts = np.r_[p.starts[first:first + len(gone)] - begin, size]
    keep = np.ones(size, bool)
    edges = np.flatnonzero(np.diff(np.r_[0, gone.astype(np.int8), 0]))
    for a, b in zip(edges[::2], edges[1::2]):
        keep[starts[a]:starts[b]] = False
    left = p.data[begin:begin + size][keep].tobytes().decode("utf-8", "surrogatepass")
    return left, int(np.logical_or.reduceat(gone, p.first[lo:hi] - first).sum()), int(gone.sum())


def without(texts: Iterable[str | None], found: Iterable[np.ndarray | None], passages: Iterable[np.ndarray | None],
            numbers: Iterable[int]) -> Iterator[tuple]:
    """(text, paragraphs, paragraphs that lost words, removed words) for texts, their copied
    paragraphs, the anchors of their copied passages and how many paragraphs they have.  Only texts
    with copies are cut again."""
    rows = [(t, *([] if x is None else x for x in (f, a)), int(n)) for t, f, a, n in zip(texts, found, passages, numbers)]
    again = [i for i, (_, which, anchors, _) in enumerate(rows) if len(which) or len(anchors)]
    out = [(text, n, 0, 0) for text, _, _, n in rows]
    for start, some in chunks(rows[i][0] for i in again):
        p = Paragraphs(*some)
        for doc, i in enumerate(again[start:start + len(some)]):
            text, which, anchors, n = rows[i]
            left, gone, words = trimmed(p, doc, which, anchors)
            out[i] = left if gone else text, n, gone, words
    yield from out


def drop_repeats(docs: DataFrame) -> DataFrame:
    """``docs`` with repeated paragraphs and passages cut from ``text``, and (n_paragraphs, n_removed,
    words_removed); columns of these names are replaced, others kept.

    Only runs of copies of at least ``LEAST_RUN`` words go; everything else stays byte for byte.
    ``n_removed`` counts the paragraphs that lost words.
    Null and empty texts have no paragraphs and stay; ids may be null or repeat; rows that
    repeat exactly get the same result; an empty table gives none.
    """
    names = ["n_paragraphs", "n_removed", "words_removed"]
    keep = [c for c in docs.columns if c not in names]
    every = unit_table(docs)
    anchors = repeated_anchors(every)
    found = repeated_paragraphs(docs, every).select(F.col("k1").alias("_k1"), F.col("k2").alias("_k2"), "which",
                                              F.col("n").alias("_n"))
    passages = repeated_passages(docs, anchors).select(F.col("k1").alias("_p1"), F.col("k2").alias("_p2"), "anchors")

    @F.pandas_udf("text string, n_paragraphs long, n_removed long, words_removed long")
    def cut(texts: pd.Series, which: pd.Series, anchors: pd.Series, n: pd.Series) -> pd.DataFrame:
        return pd.DataFrame(without(texts, which, anchors, n), columns=["text", *names])

    k1, k2 = row_key("doc_id", "text")
    rows = docs.select(*keep, k1.alias("_a"), k2.alias("_b"))
    joined = rows.join(found, (F.col("_a") == F.col("_k1")) & (F.col("_b") == F.col("_k2")), "left")
    joined = joined.join(passages, (F.col("_a") == F.col("_p1")) & (F.col("_b") == F.col("_p2")), "left")
    done = joined.select(*keep, cut(F.col("text"), F.col("which"), F.col("anchors"), F.col("_n")).alias("_p"))
    return done.select(*[F.col("_p.text").alias("text") if c == "text" else F.col(c) for c in keep],
                       *[F.col(f"_p.{n}").alias(n) for n in names])
