"""Texts are cut once, for paragraphs and anchors."""

import numpy as np

from cohortkit.llm import paragraphs


def test_texts_are_cut_once_for_paragraphs_and_anchors(spark):
    body = " ".join(f"w{i}" for i in range(120)) + "."
    docs = spark.createDataFrame([(1, body), (2, f"other words. {body}"), (None, None)], "doc_id int, text string")
    every = paragraphs.unit_table(docs)
    stands = {r.doc_id: r.words for r in every.where("NOT anchor AND idx < 0").collect()}
    whole = paragraphs.Paragraphs(body.encode(), f"other words. {body}".encode(), b"")
    assert [stands[d] for d in (1, 2, None)] == np.bincount(whole.doc, minlength=3).tolist()
    word, run, h = whole.anchors()
    got = sorted((r.doc_id, r.idx, r.words, r.s1) for r in every.where("anchor").collect())
    assert got == sorted(zip((whole.word_doc[word] + 1).tolist(), whole.at[word].tolist(), whole.at[run].tolist(),
                             h.view(np.int64).tolist()))
    again = paragraphs.repeated_anchors(every)
    assert again.groupBy("h").count().where("count < 2").count() == 0 and again.count() > 0


def test_words_around_anchors_stop_at_the_ends_of_their_text():
    p = paragraphs.Paragraphs(b"a b c", b" ".join(b"x%d" % i for i in range(200)), b"d e")
    short = (p.hashes >> np.uint64(32)).astype(np.uint32)
    for word, (before, after) in zip((3, 63, 183), p.around(np.array([3, 63, 183]))):
        lo, hi = max(3, word - paragraphs.WIDEN), min(203, word + paragraphs.ANCHOR + paragraphs.WIDEN)
        assert before == short[lo:word][::-1].tobytes() and after == short[word + paragraphs.ANCHOR:hi].tobytes()
