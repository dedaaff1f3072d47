"""Texts are hashed together, with the hashes they have alone."""

import numpy as np

from cohortkit.llm import jaccard, text


def test_shingles_of_texts_side_by_side_are_those_of_each_alone():
    texts = [None, "", " \n", "a", "\n\nA  b\tc\x0bd  e ", "x y z w", "x y z w v u", "\ud800 Ä 漢字 b c d", "q " * 70_000, "a b"]
    for size in (4, 5):
        got = list(jaccard.shingle_sets(texts, size))
        assert len(got) == len(texts)
        for t, found in zip(texts, got):
            words = [w for w in (t or "").encode("utf-8", "surrogatepass").lower().split()]
            k = min(size, len(words))
            spans = {b" ".join(words[i:i + k]) for i in range(len(words) - k + 1)} if words else set()
            data = [np.frombuffer(s, np.uint8) for s in spans]
            want = sorted(int(text.span_hashes(text.prefix_sums(d), np.array([0]), np.array([len(d)]))[0]) for d in data)
            assert found.tolist() == want


def test_sums_without_folding_give_the_same_hashes(monkeypatch):
    data = np.random.default_rng(5).integers(0, 256, 100_000).astype(np.uint8)
    starts, ends = np.array([0, 7, 50_000]), np.array([100_000, 99_999, 50_001])
    quick = text.span_hashes(text.prefix_sums(data), starts, ends)
    monkeypatch.setattr(text, "UNFOLDED", 0)
    assert (text.span_hashes(text.prefix_sums(data), starts, ends) == quick).all()
