"""Disk and memory that the operators for training data hold at once."""

import re
import tracemalloc

import numpy as np

from cohortkit.llm import jaccard, mixing, packing, paragraphs, store, text
from cohortkit.llm.queries import tokenizer_path


def test_copied_passages_do_not_travel_with_the_texts(spark, monkeypatch):
    passage = " ".join(f"w{i}" for i in range(120))
    docs = spark.createDataFrame([(i, f"own{i} {passage} end{i}") for i in range(6)], "doc_id long, text string")
    plans, settle = [], paragraphs.settle

    def stored(df):
        plans.append(df._jdf.queryExecution().optimizedPlan().toString())
        return settle(df)

    monkeypatch.setattr(paragraphs, "settle", stored)
    found = paragraphs.repeated_passages(docs)
    assert found.count() == 5
    last = plans[-1]
    # one join, of two stored tables, so that a hot hash can be split
    assert "collect_set(" in last and "MapInPandas" not in last
    assert len(re.findall(r"\bJoin ", last)) == 1


def test_repeated_shingles_in_little_memory():
    rng = np.random.default_rng(2)
    found = [np.unique(rng.integers(0, 1 << 62, 20_000, dtype=np.uint64)) for _ in range(50)]
    found += [found[3][:500].copy(), found[3][:200].copy(), np.zeros(0, np.uint64)]
    values, n = np.unique(np.concatenate(found), return_counts=True)
    values, n, size = values[n > 1], n[n > 1], sum(x.nbytes for x in found)
    tracemalloc.start()
    got, counts = jaccard.repeated(found)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert (got == values).all() and (counts == n).all() and set(counts) == {2, 3}
    assert peak < 1.6 * size
    assert len(jaccard.repeated([])[0]) == 0


def test_a_worker_forgets_the_tables_of_other_operators():
    packing.encoder(tokenizer_path())

    def of(module):
        def f(batches):
            yield from batches
        f.__module__ = module
        return text.lean(f)

    list(of(packing.__name__)(iter([1])))
    assert packing.encoder.cache_info().currsize == 1
    list(of(jaccard.__name__)(iter([1])))
    assert packing.encoder.cache_info().currsize == 0


def test_hashing_texts_of_all_sizes_takes_one_table():
    text._prime_powers.cache_clear()
    for n in (5, 70_000, 140_000, 300_000, 5, 140_000):
        sums = text.prefix_sums(np.full(n, 97, np.uint8))
        assert len(set(text.span_hashes(sums, np.array([0, 1]), np.array([4, 5])).tolist())) == 1
    assert text._prime_powers.cache_info().misses == 1


def test_only_texts_with_copies_are_cut_again(monkeypatch):
    body = "one two three four five six seven eight nine ten. " * 3
    cut, texts = [], [body, None, f"{body}\nother {body}", ""]
    whole = paragraphs.Paragraphs(*[paragraphs._bytes(t) for t in texts])
    n = np.bincount(whole.doc, minlength=4).tolist()

    class Counted(paragraphs.Paragraphs):
        def __init__(self, *some):
            cut.extend(some)
            super().__init__(*some)

    monkeypatch.setattr(paragraphs, "Paragraphs", Counted)
    none = np.zeros(0, np.int32)
    got = list(paragraphs.without(texts, [none, none, np.arange(n[2] - 1), none], [None] * 4, n))
    assert cut == [texts[2].encode()]
    assert [g[1] for g in got] == n and [g[0] for g in got][:2] == texts[:2] and got[3] == ("", 0, 0, 0)
    assert got[2][2] == n[2] - 1 and got[2][0] in texts[2]


def test_the_driver_gives_memory_back_in_the_mixture(spark, monkeypatch):
    assert store.lighten(spark)
    calls, lighten = [], store.lighten
    monkeypatch.setattr(store, "lighten", lambda s: calls.append(lighten(s)))
    docs = spark.createDataFrame([(i, "a b c", f"s{i % 2}") for i in range(9)], "doc_id long, text string, source string")
    assert mixing.mix(docs).count() == 9
    assert len(calls) >= 5 and all(calls)
