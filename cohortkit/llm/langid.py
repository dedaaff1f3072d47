"""Language identification by averaged hashed subword embeddings and a linear softmax."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame, functions as F

from cohortkit.llm.text import give_back, lean, quiet

UNKNOWN = "und"
LETTER = regex.compile(r"\p{L}")
#: Lengths of the subwords, in characters; a word's borders are part of them.
SUBWORDS = (1, 2, 3, 4)
PREDICTION = "lang_pred string, score double, rejected boolean"


@dataclass
class LanguageModel:
    labels: list[str]
    table: np.ndarray          # a row per hash bucket: embedding times output weights
    bias: np.ndarray
    temperature: float         # calibrates the probabilities
    threshold: float           # less certain predictions are rejected


@quiet
def subword_counts(text: str, buckets: int) -> np.ndarray:
    """How often each bucket's subwords occur in a whole text."""
    chars = np.frombuffer((" " + text.lower() + " ").encode("utf-32-le", "surrogatepass"), "<u4")
    space = chars <= 32
    chars = np.where(space, np.uint32(32), chars)[~(space & np.r_[False, space[:-1]])]
    total, code = np.zeros(buckets, np.int64), chars.copy()
    bits = buckets.bit_length() - 1
    for n in range(1, max(SUBWORDS) + 1):
        if n > 1:
            code = code[:-1] * np.uint32(0x01000193) + chars[n - 1:]
        if len(code) == 0:
            break
        if n in SUBWORDS:
            total += np.bincount((code ^ np.uint32(n)) * np.uint32(0x9E3779B1) >> np.uint32(32 - bits), minlength=buckets)
    return total


def _softmax(z: np.ndarray) -> np.ndarray:
    z = np.exp(z - z.max(axis=1, keepdims=True))
    return z / z.sum(axis=1, keepdims=True)


@dataclass
class SparseRows:
    """Subword counts of a sample: of row i, ``bucket`` and ``count`` from start[i] to start[i + 1]."""

    start: np.ndarray
    bucket: np.ndarray
    count: np.ndarray
    width: int

    def __len__(self) -> int:
        return len(self.start) - 1

    def averages(self, rows: np.ndarray) -> np.ndarray:
        """Some rows, dense, each adding up to 1."""
        x = np.zeros((len(rows), self.width), np.float32)
        for i, row in enumerate(rows):
            here = slice(self.start[row], self.start[row + 1])
            x[i, self.bucket[here]] = self.count[here]
        x /= np.maximum(x.sum(axis=1, keepdims=True), 1)
        return x


def train(sample: SparseRows, y: np.ndarray, labels: list[str], dim: int = 16, epochs: int = 6, rate: float = 0.5,
          risk: float = 0.05, least_steps: int = 600, seed: int = 0) -> LanguageModel:
    """Stochastic gradient descent over rows of subword counts; only a batch at a time is dense.

    A fifth of the rows are kept back: they set the temperature that makes the probabilities
    most likely, and the least threshold at which the accepted ones err at most at ``risk`` (the
    one with the fewest errors if none does).  A small sample is gone over more often.
    """
    rng = np.random.default_rng(seed)
    back = np.zeros(len(sample), bool)
    back[rng.permutation(len(sample))[:len(sample) // 5]] = True
    k = len(labels)
    embed = rng.uniform(-1, 1, (sample.width, dim)).astype(np.float32) / dim
    out, bias = np.zeros((dim, k), np.float32), np.zeros(k, np.float32)
    own = np.flatnonzero(~back)
    batches = max(1, -(-len(own) // 32))
    epochs = max(epochs, -(-least_steps // batches))
    steps = epochs * batches
    step = 0
    scale = np.float32(40.0)   # averages of many subwords are small
    for _ in range(epochs):
        for at in np.array_split(rng.permutation(own), batches):
            lr = np.float32(rate * (1 - step / steps))
            x = sample.averages(at)
            hidden = scale * (x @ embed)
            error = (_softmax(hidden @ out + bias) - np.eye(k, dtype=np.float32)[y[at]]) / max(1, len(at))
            to_embed = scale * (x.T @ (error @ out.T))
            out -= lr * (hidden.T @ error)
            bias -= lr * error.sum(axis=0)
            embed -= lr * to_embed
            step += 1
    table = (scale * embed @ out).astype(np.float32)
    temperature, threshold = 1.0, 0.0
    if back.any():
        kept = np.flatnonzero(back)
        parts = np.array_split(kept, -(-len(kept) // 64))
        z, truth = np.concatenate([sample.averages(at) @ table for at in parts]) + bias, y[back]
        fit = {t: -np.log(np.maximum(_softmax(z / t)[np.arange(len(z)), truth], 1e-12)).mean()
               for t in np.geomspace(0.1, 10, 41)}
        temperature = float(min(fit, key=fit.get))
        p = _softmax(z / temperature)
        score, wrong = p.max(axis=1), p.argmax(axis=1) != truth
        order = np.argsort(-score, kind="stable")
        errors = np.cumsum(wrong[order]) / np.arange(1, len(order) + 1)
        good = np.flatnonzero(errors <= max(risk, errors.min()))
        if good[-1] + 1 < len(order):
            threshold = float(score[order][good[-1]])
    return LanguageModel(labels, table, bias, temperature, threshold)


def fit_languages(docs: DataFrame, usable: Column, rows_per_label: int = 1000, most_rows: int = 6000,
                  buckets: int = 1 << 12, seed: int = 0) -> LanguageModel | None:
    """Learn from ``text`` and ``lang`` of the rows where ``usable`` holds; null without any.

    The fit uses a sample drawn by a hash of id and text: about ``rows_per_label`` rows of each
    label, at most ``most_rows`` in all (documented bounds; a row is at most ``buckets`` counts).
    Labels are counted over all rows.
    """
    spark = docs.sparkSession
    rows = docs.filter(usable & F.col("lang").isNotNull() & F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)))
    n = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    if not n:
        return None
    each = max(1, min(rows_per_label, most_rows // len(n)))
    share = spark.createDataFrame([(k, float(min(1.0, each / v))) for k, v in n.items()], "l string, share double")
    u = F.shiftrightunsigned(F.xxhash64(F.lit(seed), "doc_id", "text"), 11).cast("double") / float(1 << 53)

    @lean
    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [subword_counts(t, buckets) for t in batch["text"]]
            at = [np.flatnonzero(c) for c in found]
            yield pd.DataFrame({"h": batch["h"], "lang": batch["lang"],
                                "at": [a.astype(np.int32).tobytes() for a in at],
                                "n": [c[a].astype(np.int32).tobytes() for c, a in zip(found, at)]})

    drawn = (rows.select("text", "lang", u.alias("u"), F.xxhash64("text", "doc_id").alias("h"))
             .join(F.broadcast(share), F.col("lang") == F.col("l")).filter("u < share")
             .select("h", "text", "lang").mapInPandas(count, "h long, lang string, at binary, n binary")
             .limit(2 * most_rows))
    sample = drawn.toArrow().sort_by([("h", "ascending"), ("lang", "ascending")])
    langs = sample["lang"].to_pylist()
    labels = sorted(set(langs))
    if not labels:
        return None
    at = [np.frombuffer(x.as_buffer(), np.int32) for x in sample["at"]]
    n = [np.frombuffer(x.as_buffer(), np.int32) for x in sample["n"]]
    rows = SparseRows(np.cumsum([0, *map(len, at)]), np.concatenate(at), np.concatenate(n), buckets)
    del sample, at, n
    give_back()
    model = train(rows, np.array([labels.index(k) for k in langs]), labels, seed=seed)
    del rows
    give_back()
    return model


def predict(model: LanguageModel | None, texts: pd.Series) -> pd.DataFrame:
    out = []
    for text in texts:
        if model is None or not isinstance(text, str) or not LETTER.search(text):
            out.append((UNKNOWN, 0.0, True))
            continue
        counts = subword_counts(text, len(model.table))
        z = (counts @ model.table.astype(np.float64)) / max(1, counts.sum()) + model.bias
        p = _softmax(z[None] / model.temperature)[0]
        best = int(p.argmax())
        out.append((model.labels[best], float(p[best]), bool(p[best] < model.threshold)))
    return pd.DataFrame(out, columns=["lang_pred", "score", "rejected"])


def identify(docs: DataFrame, model: LanguageModel | None) -> DataFrame:
    """Add (lang_pred, score, rejected) from the whole text of every row; columns of these
    names are replaced, all others kept.

    ``score`` is the calibrated probability of the label.  A null text, one without a letter,
    and every text without a model is ``und`` with score 0 and rejected.  The model travels with
    the tasks: buckets times labels numbers, whatever the input.
    """
    names = ["lang_pred", "score", "rejected"]
    keep = [c for c in docs.columns if c not in names]

    @F.pandas_udf(PREDICTION)
    def guess(texts: pd.Series) -> pd.DataFrame:
        return predict(model, texts)

    return docs.select(*keep, guess(F.col("text")).alias("_p")).select(*keep, *[F.col("_p")[c].alias(c) for c in names])
