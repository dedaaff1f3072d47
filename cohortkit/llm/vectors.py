"""Near-duplicate vectors by randomised-rotation binary codes with correction factors."""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from cohortkit.llm.components import components
from cohortkit.llm.jaccard import roots
from cohortkit.llm.text import lean
from cohortkit.session import checkpoint

#: A pair at the threshold meets in some bucket with this probability.
RECALL = 0.999
#: Standard errors of the estimate that its confidence bound spans.
WIDTH = 4.0
BLOCK = 1024


def usable(vector: Column) -> Column:
    """Neither null, empty or zero, nor with a null or non-finite component."""
    odd = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce((F.size(vector) > 0) & ~odd & F.exists(vector, lambda x: x != 0), F.lit(False))


@functools.lru_cache(maxsize=8)
def rotations(dim: int, columns: int, seed: int) -> np.ndarray:
    """Random rotations side by side, ``columns`` wide in all."""
    rng = np.random.default_rng([seed, dim])
    parts = [np.linalg.qr(rng.standard_normal((dim, dim)))[0] for _ in range(-(-columns // dim))]
    return np.hstack(parts)[:, :columns]


def buckets_for(n: int, threshold: float, recall: float = RECALL) -> tuple[int, int]:
    """(tables, bits): buckets of a few chance members each on any input, and as many tables as
    a pair at the threshold needs to share a bucket."""
    bits = max(4, math.ceil(math.log2(max(2, n))) - 4)
    same = (1 - math.acos(threshold) / math.pi) ** bits
    return math.ceil(math.log(1 - recall) / math.log(1 - same)), bits


def encode(vectors: np.ndarray, tables: int, bits: int, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(codes, factors, keys) of unit vectors.

    The code is the signs of a rotated vector; the factor, its inner product with the vector,
    makes estimates from it unbiased; the keys are signs under further rotations."""
    dim = vectors.shape[1]
    turned = vectors @ rotations(dim, dim + tables * bits, seed)
    own, rest = turned[:, :dim], turned[:, dim:] > 0
    factors = np.abs(own).sum(axis=1) / math.sqrt(dim)
    keys = rest.reshape(len(vectors), tables, bits) @ (1 << np.arange(bits, dtype=np.int64))
    return np.packbits(own > 0, axis=1), factors, keys


def candidate_pairs(vectors: np.ndarray, codes: np.ndarray, factors: np.ndarray, threshold: float,
                    seed: int) -> np.ndarray:
    """Which pairs the estimates cannot rule out: a row's code against the other's rotated vector,
    over its factor, plus a bound from what the code misses of its vector."""
    dim = vectors.shape[1]
    signs = np.unpackbits(codes, axis=1, count=dim).astype(np.float32) * 2 - 1
    turned = (vectors @ rotations(dim, dim, seed)).astype(np.float32)
    estimate = signs @ turned.T / (math.sqrt(dim) * factors[:, None])
    bound = WIDTH * np.sqrt(np.maximum(0, 1 - factors ** 2)) / factors / math.sqrt(max(1, dim - 1))
    return estimate + bound[:, None] >= threshold


def near_vectors(rows: DataFrame, threshold: float = 0.95, seed: int = 0) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row of ``rows`` (vec_id, embedding).

    Rows link if the cosine of their vectors, in double precision, is at least ``threshold``;
    none below it does.  Pairs are looked for among rows that share a bucket of one of the
    tables; estimates from the codes decide which of them are computed exactly.  A pair counts
    in the first table it shares.  A bucket is dealt out in blocks, and pairs of blocks, so a
    hot one is many tasks; they return a row per vector, never pairs.

    Vectors that are null, empty, zero, or hold a null or non-finite component link with
    nothing, nor do vectors of different lengths; ids may repeat (rows are told apart) or be
    null; other columns are ignored; an empty table gives none.
    """
    vector = F.col("embedding").cast("array<double>")
    known = checkpoint(rows.select("vec_id", vector.alias("v")).withColumn("ok", usable(F.col("v")))
                       .withColumn("rid", F.monotonically_increasing_id()))
    good = known.filter("ok")
    tables, bits = buckets_for(good.count(), threshold)

    @lean
    def code(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            parts = []
            for dim, some in batch.groupby(batch["v"].map(len)):
                v = np.stack(some["v"].to_numpy())
                v = v / np.abs(v).max(axis=1, keepdims=True)
                v /= np.linalg.norm(v, axis=1, keepdims=True)
                codes, factors, keys = encode(v, tables, bits, seed)
                parts.append(pd.DataFrame({"rid": some["rid"].to_numpy(), "dim": dim, "v": list(v),
                                           "code": [c.tobytes() for c in codes], "factor": factors, "keys": list(keys)}))
            yield pd.concat(parts) if parts else pd.DataFrame(columns=["rid", "dim", "v", "code", "factor", "keys"])

    coded = checkpoint(good.select("rid", "v").mapInPandas(
        code, "rid long, dim int, v array<double>, code binary, factor double, keys array<long>"))
    places = coded.select("rid", "dim", F.posexplode("keys").alias("t", "key"))
    size = places.groupBy("t", "key", "dim").agg(F.count("*").alias("m")).filter("m > 1")
    dealt = (places.join(size, ["t", "key", "dim"])
             .withColumn("blocks", F.ceil(F.col("m") / BLOCK).cast("int"))
             .withColumn("b", F.pmod(F.xxhash64("rid"), F.col("blocks")).cast("int"))
             .withColumn("o", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
             .select("rid", "t", "key", "b", F.least("b", "o").alias("i"), F.greatest("b", "o").alias("j")))

    def compare(held: list[tuple], t: int) -> list[tuple[int, int, int]]:
        rid, block = np.array([h[0] for h in held]), np.array([h[1] for h in held])
        v = np.stack([h[2] for h in held])
        keys = np.stack([h[5] for h in held])
        maybe = candidate_pairs(v, np.stack([np.frombuffer(h[3], np.uint8) for h in held]),
                                np.array([h[4] for h in held]), threshold, seed)
        maybe = np.triu(maybe | maybe.T, 1)
        if block.min() != block.max():
            maybe &= block[:, None] != block[None, :]
        a, b = np.nonzero(maybe)
        link = np.zeros(len(a), bool)
        for start in range(0, len(a), 1 << 16):
            x, y = a[start:start + (1 << 16)], b[start:start + (1 << 16)]
            first = (keys[x] == keys[y]).argmax(axis=1) == t
            link[start:start + (1 << 16)] = first & (np.einsum("ij,ij->i", v[x], v[y]) >= threshold)
        a, b = a[link], b[link]
        if not len(a):
            return []
        joined = np.zeros((len(rid), len(rid)), bool)
        joined[a, b] = joined[b, a] = True
        n = joined.sum(axis=1)
        root = roots(joined, rid)
        return [(r, c, o) for r, c, o in zip(rid.tolist(), n.tolist(), root.tolist()) if c]

    @lean
    def links(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, held = None, []
        columns = ["rid", "n", "root"]
        for batch in batches:
            out = []
            for place, *row in zip(zip(batch["t"], batch["key"], batch["dim"], batch["i"], batch["j"]), batch["rid"],
                                   batch["b"], batch["v"], batch["code"], batch["factor"], batch["keys"]):
                if place != now:
                    if len(held) > 1:
                        out += compare(held, now[0])
                    now, held = place, []
                held.append(row)
            yield pd.DataFrame(out, columns=columns, dtype="int64")
        yield pd.DataFrame(compare(held, now[0]) if len(held) > 1 else [], columns=columns, dtype="int64")

    key = ["t", "key", "dim", "i", "j"]
    found = checkpoint(dealt.join(coded, "rid").repartition(*key).sortWithinPartitions(*key)
                       .select(*key, "rid", "b", "v", "code", "factor", "keys")
                       .mapInPandas(links, "rid long, n long, root long")
                       .groupBy("rid", "root").agg(F.sum("n").alias("n")))
    counts = found.groupBy("rid").agg(F.sum("n").alias("n_links"))
    labels = components(found.select("rid", "root")).toDF("rid", "root")
    placed = (known.select("rid", "vec_id").join(counts, "rid", "left").join(labels, "rid", "left")
              .withColumn("root", F.coalesce("root", "rid")))
    least = placed.groupBy("root").agg(F.min("vec_id").alias("component_id"))
    return placed.join(least, "root").select(
        "vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), "component_id",
        F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)).alias("kept"))
