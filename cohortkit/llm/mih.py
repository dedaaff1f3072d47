"""Nearest neighbours by multi-index hashing over learned rotated binary codes."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from cohortkit.llm.vectors import usable
from cohortkit.session import checkpoint

#: Rows on which the rotation and the radius are learned, at most (a documented bound).
SAMPLE = 8192
PROBES = 256             # sample rows whose true neighbours set the radius
COVER = 0.98             # share of true neighbours that must lie within the radius
WORD = 16                # bits of a substring
ROTATIONS = 2            # learned rotations side by side: code bits per dimension
BLOCK, CHUNK = 8192, 512  # index rows and queries that meet in one task

_BITS = np.array([bin(i).count("1") for i in range(1 << 8)], np.uint8)
POPCOUNT = (_BITS[:, None] + _BITS[None, :]).ravel()  # of 16-bit numbers


@dataclass
class Codebook:
    mean: np.ndarray
    turn: np.ndarray       # dimensions x bits
    radius: int            # Hamming radius searched

    @property
    def words(self) -> int:
        return self.turn.shape[1] // WORD

    def codes(self, x: np.ndarray) -> np.ndarray:
        """rows x substrings, 16 bits each."""
        bits = ((x - self.mean) @ self.turn > 0).reshape(len(x), -1, WORD)
        return (bits @ (1 << np.arange(WORD))).astype(np.uint16)


def learn(x: np.ndarray, k: int, seed: int = 0) -> Codebook:
    """Rotations that bring vectors near the corners they are coded as (iterative quantisation),
    and the radius within which ``COVER`` of true neighbours in the sample lie."""
    rng = np.random.default_rng(seed)
    n, dim = x.shape
    mean = x.mean(axis=0)
    y = x - mean
    main = np.linalg.eigh(y.T @ y)[1]
    y = y @ main
    turns = []
    for _ in range(ROTATIONS):
        r = np.linalg.qr(rng.standard_normal((dim, dim)))[0]
        for _ in range(20):
            u, _, vt = np.linalg.svd(np.sign(y @ r).T @ y)
            r = (u @ vt).T
        turns.append(main @ r)
    turn = np.hstack(turns)
    more = -turn.shape[1] % WORD
    if more:
        turn = np.hstack([turn, np.linalg.qr(rng.standard_normal((max(dim, more), max(dim, more))))[0][:dim, :more]])
    book = Codebook(mean, turn, turn.shape[1])
    if n > k + 1:
        own = rng.permutation(n)[:PROBES]
        d = ((x[own] ** 2).sum(1)[:, None] + (x ** 2).sum(1)[None] - 2 * x[own] @ x.T)
        d[np.arange(len(own)), own] = np.inf
        near = np.argpartition(d, k, axis=1)[:, :k]
        codes = book.codes(x)
        apart = POPCOUNT[codes[own][:, None, :] ^ codes[near]].sum(axis=2, dtype=np.int64)
        book.radius = int(np.quantile(apart, COVER, method="higher"))
    return book


def within(book: Codebook, index: list[tuple[np.ndarray, np.ndarray]], query: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """Rows of a block whose code lies within the radius of a query's.

    If it does, some substring lies within radius / substrings: each substring's bucket table is
    probed for the values that near, and only rows found there are compared in full."""
    reach = book.radius // book.words
    found = np.zeros(len(codes), bool)
    for (values, inverse), q in zip(index, query):
        found |= (POPCOUNT[values ^ q] <= reach)[inverse]
    rows = np.flatnonzero(found)
    return rows[POPCOUNT[codes[rows] ^ query].sum(axis=1, dtype=np.int64) <= book.radius]


def nearest(rows: DataFrame, is_query: Column, k: int = 10, seed: int = 0) -> DataFrame:
    """(query_id, rank, vec_id, score): for each query row its ``k`` nearest other rows by
    Euclidean distance in double precision, ties to the smaller vec_id.

    Rotation and radius are learned on a bounded sample; every row is coded and indexed.  Blocks
    of index rows meet chunks of queries; each block returns at most ``k`` rows per query, read
    within the Hamming radius and reranked by the floats.  Where a block has fewer than ``k``
    rows in the radius, its nearest codes beyond it are read too, so no query stays short.

    Vectors that are null, empty, zero, or hold null or non-finite components take no part, nor
    do those of a length other than the most common; ids may repeat (a row is no neighbour of
    itself, but of its copies); other columns are ignored; an empty table gives none.
    """
    schema = "query_rid long, query_id long, vec_id long, score double"
    vector = F.col("embedding").cast("array<double>")
    known = checkpoint(rows.select("vec_id", vector.alias("v"), F.coalesce(is_query, F.lit(False)).alias("q"))
                       .filter(usable(F.col("v"))).withColumn("rid", F.monotonically_increasing_id()))
    lengths = known.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n"), F.sum(F.col("q").cast("int")).alias("q"))
    top = lengths.orderBy(F.desc("n"), "d").first()
    if top is None:
        return rows.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    known = known.filter(F.size("v") == top["d"])
    share = min(1.0, SAMPLE / top["n"])
    u = F.shiftrightunsigned(F.xxhash64(F.lit(seed), "v"), 11).cast("double") / float(1 << 53)
    sample = known.filter(u <= share).select("v").limit(2 * SAMPLE).toPandas()["v"]
    book = learn(np.stack(sample.to_numpy()) if len(sample) else np.zeros((1, top["d"])), k, seed)
    blocks, chunks = -(-top["n"] // BLOCK), max(1, -(-top["q"] // CHUNK))

    def spread(df: DataFrame, own: str, n: int, other: str, m: int) -> DataFrame:
        return (df.withColumn(own, F.pmod(F.xxhash64("rid"), F.lit(n)).cast("int"))
                .withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(m - 1)))))

    index = spread(known.select("rid", "vec_id", "v"), "block", blocks, "chunk", chunks)
    queries = spread(known.filter("q").select("rid", "vec_id", "v"), "chunk", chunks, "block", blocks)

    def search(held: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(held) and len(asked):
            x, q = np.stack(held["v"].to_numpy()), np.stack(asked["v"].to_numpy())
            codes, wanted = book.codes(x), book.codes(q)
            tables = [np.unique(codes[:, j], return_inverse=True) for j in range(book.words)]
            rid, ids = held["rid"].to_numpy(), held["vec_id"].astype("Int64").fillna(1 << 62).to_numpy(np.int64)
            for i, (own, qid) in enumerate(zip(asked["rid"], asked["vec_id"])):
                at = within(book, tables, wanted[i], codes)
                at = at[rid[at] != own]
                if len(at) < min(k, len(x)):
                    apart = POPCOUNT[codes ^ wanted[i]].sum(axis=1, dtype=np.int64)
                    at = np.argsort(apart, kind="stable")[:k + 1]
                    at = at[rid[at] != own]
                score = np.sqrt(((x[at] - q[i]) ** 2).sum(axis=1))
                best = np.lexsort((ids[at], score))[:k]
                out += [(own, qid, held["vec_id"].iloc[at[b]], score[b]) for b in best]
        return pd.DataFrame(out, columns=["query_rid", "query_id", "vec_id", "score"])

    found = (index.groupBy("block", "chunk").cogroup(queries.groupBy("block", "chunk"))
             .applyInPandas(search, schema))
    order = Window.partitionBy("query_rid").orderBy("score", F.asc_nulls_last("vec_id"))
    return (found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))
