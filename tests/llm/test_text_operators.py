"""Chat, URL, language, mixing, packing and byte operators against plain Python."""

import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortkit.llm import chat, langid, mixing, packing, suffixes, urls
from cohortkit.llm.queries import RULES, tokenizer_path

DOCS = "doc_id long, text string, lang string, source string"


def documents(spark, rows, schema=DOCS):
    return spark.createDataFrame(rows, schema)


def test_chat_round_trip(spark):
    rows = [(1, 0, "system", "[SYS]<s>"), (1, 1, "user", "a[\\INST]b<"), (1, 2, "user", "|[TURN]"),
            (1, 3, "assistant", "</s>[INST] ok [/INST]"), (1, 4, "assistant", None), (1, 5, "assistant", "é\n"),
            (2, 0, "to[ROLE]ol", "[TEXT]"), (2, 1, None, ""), (2, 1, None, ""), (2, None, "user", "first"),
            (None, 0, "user", "x"), (None, 0, "user", "x")]
    df = spark.createDataFrame([(*r, "clash") for r in rows],
                               "conv_id long, turn long, role string, text string, n_turns string")
    out = chat.format_chat(df)
    got = [(r.conv_id, [(t.role, t.text) for t in r.read], r.loss) for r in out.withColumn(
        "read", chat.parse_chat(F.col("formatted"))).withColumn(
        "loss", chat.loss_text(F.col("formatted"), F.col("loss_spans"))).collect()]
    want = defaultdict(list)
    for c, t, role, text in rows:
        want[c].append((t is not None, t or 0, role or "", text or ""))
    full = {c: [x[2:] for x in sorted(v)] for c, v in want.items() if c is not None}
    assert {c: v for c, v, _ in got if c is not None} == full
    assert all(loss == "".join(t for r, t in v if r == "assistant") for _, v, loss in got)
    assert [v for c, v, _ in got if c is None] == [[("user", "x")]] * 2
    assert chat.format_chat(df.limit(0)).count() == 0


def test_urls_rules_and_aliases(spark):
    link = '<link rel="canonical" href="{}">'
    rows = [(1, "http://A.example.com/en/x?y", None), (2, "http://www.example.com/en/x", ""),
            (3, "http://a.org/p", link.format("http://b.org/q")), (4, "http://b.org/q", link.format("http://z.net/es/1")),
            (5, "http://c.org/p", link.format("/q#top")), (6, "http://c.org/q", link.format("http://shop.com/")),
            (7, "http://c.org/r", '<meta http-equiv="refresh" content="0; url=http://z.net/fr/">' + link.format("q")),
            (8, "http://example.com", None), (9, None, None), (10, "nonsense", "<link rel=canonical href=>"),
            (None, "http://b.org/q#frag", None), (11, "http://netx/es/", None), (3, "http://a.org/p", "")]
    got = sorted(((r.page_id or 0, r.rule, r.verdict) for r in urls.filter_urls(
        spark.createDataFrame([(*r, "k") for r in rows], "page_id long, url string, html string, verdict string"),
        RULES).collect()), key=repr)
    assert got == sorted([
        (1, "example.com/en/", "block"), (2, "www.example.com/en/", "allow"), (3, None, "block"), (3, None, "block"),
        (4, None, "block"), (5, None, "allow"), (6, None, "allow"), (7, None, "allow"), (8, None, "allow"),
        (9, None, "allow"), (10, None, "allow"), (0, None, "block"), (11, None, "allow")], key=repr)
    empty = spark.createDataFrame([], "page_id long, url string, html string")
    assert urls.filter_urls(empty, RULES).count() == 0


def test_urls_links_of_all_forms(spark):
    link = '<link rel="canonical" href="{}">'
    bad = "http://z.net/es/1"
    rows = [(1, "http://a.org/d/e/p", link.format("../q")), (2, "http://a.org/d/q", link.format(bad)),
            (3, "http://b.org/p", link.format("?a=1&amp;b=2")), (4, "http://b.org/p?a=1&b=2", link.format(bad)),
            (5, "http://c.org/p", link.format("http://ok.org/") + link.format(bad)),
            (6, "http://d.org/x/p", link.format("./../../q")), (7, "http://d.org/q", link.format(bad)),
            (8, "http://e.org", link.format("./q")), (9, "http://e.org/q", link.format(bad)),
            (10, "http://f.org/d/p", link.format("q")), (11, "http://f.org/q", link.format(bad))]
    got = {r.page_id: r.verdict for r in urls.filter_urls(
        spark.createDataFrame(rows, "page_id long, url string, html string"), RULES).collect()}
    assert got == {i: "block" for i in range(1, 12)} | {10: "allow"}


def test_url_filter_runs_no_python(spark):
    pages = spark.createDataFrame([(1, "http://a.net/es/", "")], "page_id long, url string, html string").select("*")
    plan = urls.filter_urls(pages, RULES)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan


def test_language_held_out_accuracy(spark):
    random.seed(1)
    syllables = {"aa": ["ka", "lo", "mi"], "bb": ["stre", "und", "che"], "cc": ["éau", "que", "ou"]}
    text = lambda k: " ".join("".join(random.choices(syllables[k], k=3)) for _ in range(30))
    rows = [(i, text(k := "aabbcc"[2 * (i % 3):][:2]), k, None) for i in range(300)]
    docs = documents(spark, rows + [(900, None, "aa", None), (901, "12 34", "bb", None), (902, "", None, None)])
    model = langid.fit_languages(docs, F.col("doc_id") % 4 != 2)
    got = {r.doc_id: r for r in langid.identify(docs.withColumn("score", F.lit("clash")), model).collect()}
    assert sum(got[i].lang_pred == k for i, _, k, _ in rows) == 300
    assert all(0 <= r.score <= 1 for r in got.values())
    assert all(got[i].lang_pred == "und" and got[i].rejected for i in (900, 901, 902))
    assert langid.fit_languages(docs.limit(0), F.lit(True)) is None
    assert langid.identify(docs.limit(3), None).filter("lang_pred = 'und'").count() == 3


def test_rejection_is_calibrated():
    rng = np.random.default_rng(0)
    y = rng.integers(0, 2, 2000)
    counts = rng.poisson(3, (2000, 64))
    counts[np.arange(2000), y] += rng.integers(0, 12, 2000)      # some rows carry no sign of their label
    x = counts.astype(np.float32)
    row, bucket = np.nonzero(counts)
    sample = langid.SparseRows(np.searchsorted(row, np.arange(2001)), bucket, counts[row, bucket], 64)
    model = langid.train(sample, y, ["p", "q"], risk=0.05)
    z = x / x.sum(axis=1, keepdims=True) @ model.table + model.bias
    p = langid._softmax(z / model.temperature)
    sure = p.max(axis=1) >= model.threshold
    wrong = p.argmax(axis=1) != y
    assert 0 < sure.sum() < 2000 and wrong[sure].mean() < 0.75 * wrong.mean()


def test_subset_sum_is_the_best():
    rng = random.Random(5)
    for _ in range(200):
        lengths = rng.sample(range(1, 40), rng.randint(1, 5))
        counts = [rng.randint(0, 4) for _ in lengths]
        budget = rng.randint(0, 120)
        reachable = {0}
        for length, count in zip(lengths, counts):
            reachable = {s + k * length for s in reachable for k in range(count + 1)}
        taken = mixing.fit_subset(lengths, counts, budget)
        assert all(t <= c for t, c in zip(taken, counts))
        assert sum(t * n for t, n in zip(taken, lengths)) == max(s for s in reachable if s <= budget)


def test_mix_targets_and_reruns(spark):
    rng = random.Random(2)
    rows = [(i, " ".join("w" for _ in range(rng.randint(0, 30))) or None, None, s)
            for i, s in enumerate(["b", "a", None, "é"] * 100 + ["hot"] * 200)]
    rows += [(7, "x y z", None, "a")] * 3
    docs = documents(spark, rows).withColumn("target", F.lit("clash"))
    got = mixing.mix(docs).collect()
    assert len(got) == len(rows)
    sizes, targets, taken = defaultdict(int), {}, defaultdict(int)
    for r in got:
        assert r.size == len((r.text or "").split()) and 0 <= r.copies <= 2
        sizes[r.source] += r.size
        targets[r.source] = r.target
        taken[r.source] += r.size * r.copies
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    want, open_ = {}, set(order)
    left = 1.5 * sum(sizes.values())
    while True:
        level = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if weight[s] * level > 2 * sizes[s]}
        if not full:
            break
        want |= {s: 2.0 * sizes[s] for s in full}
        left -= sum(2 * sizes[s] for s in full)
        open_ -= full
    want |= {s: weight[s] * level for s in open_}
    assert all(math.isclose(want[s], targets[s]) for s in order)
    assert all(abs(taken[s] - targets[s]) <= 9 for s in order)
    key = lambda rows: sorted((r.doc_id, r.copies) for r in rows)
    assert key(got) == key(mixing.mix(docs.repartition(7)).collect())
    assert mixing.mix(docs.limit(0)).count() == 0


def test_packing_ids_and_places(spark):
    import tokenizers

    own = tokenizers.Tokenizer.from_file(tokenizer_path())
    rng = random.Random(3)
    rows = [(i, " ".join(rng.choices(["ab", "é<|endoftext|>", "x  y", "1234", "\n\n"], k=rng.choice([0, 3, 900])))) for i in range(40)]
    rows += [(None, None), (5, "again"), (5, "again")]
    got = packing.pack_documents(documents(spark, rows, "doc_id long, text string"), tokenizer_path(), 64).collect()
    want = Counter()
    for i, text in rows:
        ids = [*own.encode(text or "", add_special_tokens=False).ids, 0]
        first = len(ids) if len(ids) <= 64 else len(ids) % 64 or 64
        edges = [0, *range(first, len(ids) + 1, 64)]
        want.update((i, p, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes()))
                    for p, (a, b) in enumerate(zip(edges, edges[1:])))
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    bins = defaultdict(list)
    for r in got:
        bins[r.sequence_id].append((r.offset, r.length))
    for b in bins.values():
        b.sort()
        assert b[0][0] == 0 and all(x[0] + x[1] == y[0] for x, y in zip(b, b[1:])) and sum(b[-1]) <= 64
    assert len(bins) <= math.ceil(sum(r.length for r in got) / 64) + 1


@pytest.mark.parametrize("text", [" " * 2_000_000, "\n" * 1_000_000 + "a", "a" * 200_000, "a<|endoftext|> \n" * 9,
                                  "b" + "\u2003" * 20_000 + "<|endoftext|>"])
def test_ids_of_extreme_texts(text):
    import tokenizers

    own = tokenizers.Tokenizer.from_file(tokenizer_path())
    assert packing.encoder(tokenizer_path())(text) == own.encode(text, add_special_tokens=False).ids


def test_the_fullest_bin_closes_first():
    bins = packing.OpenBins(10, 2, 0)
    assert [bins.place(n) for n in (6, 7, 8, 4, 3)] == [(0, 0), (1, 0), (2, 0), (0, 6), (3, 0)]


def test_suffix_array_by_brute_force():
    rng = np.random.default_rng(1)
    for _ in range(200):
        text = rng.integers(0, int(rng.integers(1, 5)) + 1, int(rng.integers(1, 60))).astype(np.uint8)
        data, length = text.tobytes(), int(rng.integers(1, 6))
        assert suffixes.suffix_array(text).tolist() == sorted(range(len(data)), key=lambda i: data[i:])
        count = Counter(data[i:i + length] for i in range(len(data) - length + 1))
        assert suffixes.repeated_starts(text, length).tolist() == [
            i <= len(data) - length and count[data[i:i + length]] > 1 for i in range(len(data))]


@pytest.mark.parametrize("hot", [suffixes.HOT, 2])
def test_repeated_bytes_by_brute_force(spark, hot):
    rng = random.Random(8)
    word = lambda: "".join(rng.choices("abcdé", k=rng.randint(1, 9)))
    shared = [" ".join(word() for _ in range(12)) for _ in range(4)]
    rows = [(i, " ".join(rng.choice(shared) if rng.random() < .3 else word() for _ in range(rng.randint(0, 40)))) for i in range(60)]
    rows += [(100, "ab" * 90), (101, "z" * 50), (102, None), (None, ""), (103, rows[5][1]), (5, rows[5][1]), (104, "é" * 11)]
    length = 20
    got = sorted((tuple(r) for r in suffixes.remove_repeats(
        documents(spark, rows, "doc_id long, text string").withColumn("n_bytes", F.lit("clash")), length, hot).collect()), key=repr)
    data = [(i, (t or "").encode()) for i, t in rows]
    count = Counter(d[j:j + length] for _, d in data for j in range(len(d) - length + 1))
    want = []
    for i, d in data:
        gone = [False] * len(d)
        for j in range(len(d) - length + 1):
            if count[d[j:j + length]] > 1:
                gone[j:j + length] = [True] * length
        spans = sum(g and not (j and gone[j - 1]) for j, g in enumerate(gone))
        want.append((i, len(d), sum(gone), spans, hashlib.sha256(bytes(b for b, g in zip(d, gone) if not g)).hexdigest()))
    assert got == sorted(want, key=repr)
    empty = documents(spark, [], "doc_id long, text string")
    assert suffixes.remove_repeats(empty).count() == 0
