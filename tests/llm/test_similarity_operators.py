"""Joins, near copies and nearest neighbours against brute force, and the pipeline."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortkit.llm import components, jaccard, mih, paragraphs, text, vectors
from cohortkit.session import checkpoint

DOCS = "doc_id long, text string"


def closure(ids, links):
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for a, b in links:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return {i: find(i) for i in ids}


def test_components(spark):
    rng = random.Random(1)
    links = [(rng.randint(0, 300), rng.randint(0, 300)) for _ in range(180)] + [(400 + i, 401 + i) for i in range(30)]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(links + [(None, 3)], "u long, v long")).collect()}
    want = closure({x for e in links for x in e}, links)
    assert got == {k: v for k, v in want.items() if any(k in e and e[0] != e[1] for e in links)}
    assert components.components(spark.createDataFrame([], "u long, v long")).count() == 0


def corpus(rng):
    words = [f"w{i}" for i in range(400)]
    base = [[rng.choice(words) for _ in range(rng.randint(20, 120))] for _ in range(25)]
    boiler = [rng.choice(words) for _ in range(12)]
    rows = []
    for i in range(160):
        w = list(rng.choice(base))
        for _ in range(rng.choice([0, 0, 1, 2, 4])):
            w[rng.randrange(len(w))] = rng.choice(words)
        rows.append((i, " ".join(w + boiler if i % 3 == 0 else w).upper() if i % 5 == 0 else " ".join(w)))
    return rows + [(500, None), (501, ""), (502, " \n"), (503, "one two"), (504, "one  TWO"), (None, "one two"),
                   (7, rows[7][1]), (505, "a b c " * 2000)]


def test_jaccard_by_brute_force(spark):
    rows = corpus(random.Random(4))
    got = jaccard.near_sets(spark.createDataFrame(rows, DOCS).withColumn("kept", F.lit("clash"))).collect()
    sets = []
    for _, t in rows:
        w = (t or "").lower().split()
        sets.append(frozenset(tuple(w[j:j + 4]) for j in range(max(1, len(w) - 3))) if w else frozenset())
    links = [(i, j) for i in range(len(rows)) for j in range(i) if sets[i] and sets[j]
             and 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j])]
    roots = closure(range(len(rows)), links)
    least = {}
    for i, r in roots.items():
        if rows[i][0] is not None:
            least[r] = min(least.get(r, 1 << 60), rows[i][0])
    want = sorted(((rows[i][0], len(sets[i]), least.get(roots[i])) for i in range(len(rows))), key=repr)
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=repr) == want
    assert sum(r.kept for r in got) == len(set(roots.values()))
    assert jaccard.near_sets(spark.createDataFrame([], DOCS)).count() == 0


def test_patterned_texts_do_not_hash_alike(spark):
    """Two words built from the same two letters by the parity of bits: alike modulo any power of two, linked by none."""
    word = "".join("ab"[bin(i).count("1") % 2] for i in range(4096))
    other = word.translate(str.maketrans("ab", "ba"))
    docs = spark.createDataFrame([(1, word), (2, other), (3, word)], "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in jaccard.near_sets(docs).collect()}
    assert got == {1: 1, 2: 2, 3: 1}


def test_span_hashes_are_the_two_polynomials():
    rng = np.random.default_rng(3)
    data = rng.integers(0, 256, 700).astype(np.uint8)
    starts = rng.integers(0, 600, 200)
    ends = starts + rng.integers(0, 100, 200)
    whole = [sum((int(x) + 1) * pow(b, i, text.PRIME) for i, x in enumerate(data[s:e])) % text.PRIME
             for s, e in zip(starts, ends) for b in text.BASES]
    want = text.scramble(np.array([a << 31 | b for a, b in zip(whole[::2], whole[1::2])], np.uint64))
    assert (text.span_hashes(text.prefix_sums(data), starts, ends) == want).all()


def test_group_comparison_by_blocks():
    rng = np.random.default_rng(3)
    centre = np.arange(100)
    rows, sets = [], []
    for u in range(40):
        lost = np.sort(rng.choice(100, rng.integers(0, 9), replace=False))
        added = rng.choice(np.arange(1000, 1030), rng.integers(0, 9), replace=False)
        sets.append(set(np.delete(centre, lost)) | set(added))
        rows.append((u, len(sets[-1]), 100, lost, added))
    want = closure(range(40), [(i, j) for i in range(40) for j in range(i)
                               if 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j])])
    assert dict(jaccard.linked_in_group(rows, 85, 100)) == want


def test_shared_tokens_count_whichever_group_is_larger(spark):
    # token 10: group 1 is the smaller; token 11: group 4 is; sets 1 and 4 share both and need two
    held = {10: [(1, 1), (4, 4), (5, 4)], 11: [(1, 1), (2, 1), (4, 4)]}
    rows = [(t, u, 20, 1, 2, u, g) for t, some in held.items() for u, g in some]
    marked = spark.createDataFrame(rows, "token long, uid long, n long, layer int, level int, comp long, g long")
    assert [tuple(r) for r in jaccard.candidate_pairs(jaccard.across_groups(marked), 85, 100).collect()] == [(1, 4)]


def test_paragraph_bands_reach_their_recall():
    assert 1 - (1 - 0.8 ** paragraphs.ROWS) ** paragraphs.BANDS >= paragraphs.RECALL


def test_paragraphs(spark):
    rng = random.Random(6)
    word = lambda: "".join(rng.choices("abcdefgh", k=6))

    def prose(n):
        w = [word() for _ in range(n)]
        for i in range(6, n, 7):
            w[i] += "."
        w[-1] += "."
        return " ".join(w)
    passage = prose(90)
    near = passage.replace(passage.split()[40], "changed", 1)
    rows = [(i, prose(60) + (f" {passage} " if i in (2, 5) else "\n") + prose(60)) for i in range(12)]
    rows += [(20, near), (21, "short line"), (22, "short line"), (23, None), (24, ""), (None, prose(30)), (25, prose(30)), (25, "x " * 9000)]
    docs = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], DOCS + ", n_removed long")
    got = {(r.doc_id, i): r for i, r in enumerate(paragraphs.drop_repeats(docs).orderBy("doc_id").collect())}
    by = {k[0]: r for k, r in got.items()}
    assert by[5].n_removed > 0 and by[20].n_removed > 0 and by[5].words_removed >= 50
    changed = {r.doc_id for r in got.values() if r.n_removed}
    assert changed == {5, 20}
    assert all(r.text in dict.fromkeys(t for _, t in rows) for r in got.values() if not r.n_removed)
    assert paragraphs.drop_repeats(docs.limit(0)).count() == 0


@pytest.mark.parametrize("glue", [" ", ""])
def test_passages_without_stops(spark, glue):
    # 51 words (or characters of a script without spaces) inside lines without a stop
    rng = random.Random(9)
    word = (lambda: "".join(rng.choices("abcdefgh", k=6))) if glue else (lambda: chr(rng.randrange(0x4E00, 0x9F00)))
    some = lambda n: [word() for _ in range(n)]
    passages = [some(51) for _ in range(40)]
    ends = [(some(rng.randint(30, 90)), some(rng.randint(30, 90))) for _ in range(80)]
    rows = [(i, glue.join(a + passages[i % 40] + b)) for i, (a, b) in enumerate(ends)]
    rows += [(100, glue.join(some(1) * 3000)), (101, glue.join(some(2) * 3000))]
    got = {r.doc_id: r for r in paragraphs.drop_repeats(spark.createDataFrame(rows, DOCS)).collect()}
    assert all(got[i].text == t for i, t in rows if i < 40 or i >= 100)
    assert all(got[i].text == glue.join(a + b) and got[i].words_removed == 51 and got[i].n_removed == 1
               for i, (a, b) in enumerate(ends) if i >= 40)


@pytest.mark.parametrize("period", [1, 30, 31])
def test_periodic_passages_go_whole(spark, period):
    # a long passage that repeats itself, amid words of its own, goes from the later texts to its last word
    rng = random.Random(period)
    some = lambda n: ["".join(rng.choices("abcdefgh", k=7)) for _ in range(n)]
    passage = (some(period) * 3000)[:3000]
    ends = [(some(rng.randint(30, 200)), some(rng.randint(30, 200))) for _ in range(3)]
    rows = [(i, " ".join(a + passage + b)) for i, (a, b) in enumerate(ends)]
    got = {r.doc_id: r for r in paragraphs.drop_repeats(spark.createDataFrame(rows, DOCS)).collect()}
    assert got[0].text == rows[0][1]
    assert all(got[i].text.split() == ends[i][0] + ends[i][1] and got[i].words_removed == 3000 for i in (1, 2))


def test_passages_of_all_lengths_go_whole(spark):
    rng = random.Random(4)
    some = lambda n: ["".join(rng.choices("abcdefgh", k=7)) for _ in range(n)]
    passages = [some(n) for n in (50, 51, 77, 120, 500, 2000, 5000)]
    own = [[some(rng.randint(300, 900)) for _ in range(8)] for _ in range(4)]
    rows = [(i, " ".join(sum((a + b for a, b in zip(mine, passages + [[]])), []))) for i, mine in enumerate(own)]
    got = {r.doc_id: r for r in paragraphs.drop_repeats(spark.createDataFrame(rows, DOCS)).collect()}
    assert got[0].text == rows[0][1]
    assert all(got[i].text.split() == sum(own[i], []) for i in (1, 2, 3))


def embeddings(rng, n=400, dim=24):
    x = rng.standard_normal((n, dim))
    x[50:90] = x[50] + 0.05 * rng.standard_normal((40, dim))
    x[90:94] = x[90]
    rows = [(i, [float(np.float32(c)) for c in v]) for i, v in enumerate(x)]
    return rows + [(900, None), (901, [0.0] * dim), (902, [float("nan")] * dim), (903, [None] * dim), (904, []),
                   (905, [float("inf")] * dim), (None, rows[3][1]), (3, rows[3][1])]


def test_vectors_by_brute_force(spark, monkeypatch):
    monkeypatch.setattr(vectors, "BLOCK", 16)
    rows = embeddings(np.random.default_rng(2))
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("kept", F.lit("clash"))
    got = sorted((tuple(r) for r in vectors.near_vectors(df).collect()), key=repr)
    good = [i for i, (_, v) in enumerate(rows) if v and all(c is not None and np.isfinite(c) for c in v) and any(v)]
    u = {i: np.array(rows[i][1]) / np.linalg.norm(rows[i][1]) for i in good}
    links = [(i, j) for i in good for j in good if i != j and u[i] @ u[j] >= 0.95]
    roots = closure(range(len(rows)), links)
    least = {}
    for i, r in roots.items():
        if rows[i][0] is not None:
            least[r] = min(least.get(r, 1 << 60), rows[i][0])
    n = [sum(a == i for a, _ in links) for i in range(len(rows))]
    want = [(v, n[i], least.get(roots[i]), v is None or v == least.get(roots[i])) for i, (v, _) in enumerate(rows)]
    assert got == sorted(want, key=repr)
    assert vectors.near_vectors(df.limit(0)).count() == 0


def test_estimates_are_unbiased():
    rng = np.random.default_rng(0)
    x = rng.standard_normal((200, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    errors = []
    for seed in range(20):
        codes, factors, _ = vectors.encode(x, 2, 4, seed)
        signs = np.unpackbits(codes, axis=1, count=64) * 2.0 - 1
        estimate = signs @ (x @ vectors.rotations(64, 64, seed)).T / (8 * factors[:, None])
        errors.append((estimate - x @ x.T)[~np.eye(200, dtype=bool)].mean())
    assert abs(np.mean(errors)) < 0.002


@pytest.mark.parametrize("n", [6, 3000])
def test_nearest_recall(spark, monkeypatch, n):
    monkeypatch.setattr(mih, "BLOCK", 700)
    rng = np.random.default_rng(5)
    x = rng.standard_normal((n, 32)).astype(np.float32)
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(10_000, None), (20_000, [0.0] * 32), (100, x[1].tolist())]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("score", F.lit("clash"))
    got = mih.nearest(df, F.col("vec_id") % 100 == 0, 10).toPandas()
    hit = total = 0
    full = np.vstack([x, x[1:2]]).astype(float)
    ids = np.r_[np.arange(n), 100]
    for own in np.flatnonzero(ids % 100 == 0):
        d = np.sqrt(((full - full[own]) ** 2).sum(1))
        d[own] = np.inf
        best = np.lexsort((ids, d))[:min(10, n)]
        found = got[got.query_id == ids[own]]
        hit += len(set(ids[best]) & set(found.vec_id))
        total += len(set(ids[best]))
        assert len(found) >= min(10, n)
    assert hit >= 0.9 * total
    assert mih.nearest(df.limit(0), F.lit(True)).count() == 0


def test_pipeline(spark):
    import corpus_pipeline as P

    folder = "/root/testdata/sf0.001"
    docs = P.table(spark, folder, "documents")
    columns, rows = docs.columns, docs.count()
    for name, stage in P.STAGES:
        out = checkpoint(stage(spark, docs, folder))
        assert out.count() > 0, name
        if name != "best_fit_pack":
            assert out.columns == columns
        if name == "ngram_jaccard":
            w = [(r.doc_id, (r.text or "").lower().split()) for r in docs.collect()]
            sets = {i: {tuple(x[j:j + 5]) for j in range(max(1, len(x) - 4))} for i, x in w}
            roots = closure(list(sets), [(a, b) for a in sets for b in sets if a < b
                                         and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])])
            assert {r.doc_id for r in out.select("doc_id").collect()} == set(roots.values())
        docs = out
    assert docs.groupBy("sequence_id").agg(F.sum("length").alias("n")).filter("n > 2048").count() == 0
    assert 0 < docs.select("doc_id").distinct().count() <= rows
