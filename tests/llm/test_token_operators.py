"""Byte-level BPE, conversation repair and token alignment against plain Python and the libraries."""

import hashlib
import heapq
import random
import zlib
from array import array
from collections import Counter, defaultdict
from itertools import product

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortkit.llm import align, bpe, packing, repair
from cohortkit.llm.queries import QUERIES, tokenizer_path

FOLDER = "/root/testdata/sf0.001"
RANKS = "byte_bpe_50k.tiktoken"
ODD = [None, "", " ", "a", "\x1c\x1d \x85  a", "'s 're x'LL", "Ünï " * 50, "漢字" * 70, "  \n\n  b\t", "a<|endoftext|>b",
       "▁a b", "<s> x </s>", "<0x41>", "a  b", "x" * 3000, "é" * 1500 + " " * 40, "\u0000�", "🙂🙂 ok"]


def documents(spark, rows):
    return spark.createDataFrame([(*r, "clash", 1) for r in rows],
                                 "doc_id long, text string, ids string, n_a int").repartition(3)


@pytest.fixture(scope="module")
def reference():
    tiktoken = pytest.importorskip("tiktoken")
    import public_tokenizers
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, special_tokens={},
                             mergeable_ranks=bpe.read_ranks(tokenizer_path(RANKS)))


def random_texts(n, seed=3):
    rng = random.Random(seed)
    chosen = lambda: rng.choice(["ab", "a \n", "aé漢 1", "'sdltrevm '", "\x1c\x1f\x85   a᠎​",
                                 "".join(map(chr, rng.sample(range(0xD7FF), 20)))])
    return ["".join(rng.choices(chosen(), k=rng.randint(0, 80))) for _ in range(n)]


def test_bpe_ids_are_those_of_the_library(reference):
    import public_tokenizers
    encoder = bpe.rank_encoder(tokenizer_path(RANKS), public_tokenizers.PATTERN)
    texts = random_texts(3000) + [x or "" for x in ODD]
    got = [list(array("I", x)) for x in encoder.ids(texts)]
    assert got == [reference.encode_ordinary(x) for x in texts]


def test_bpe_tree_agrees_with_the_forest_and_takes_long_pieces(reference):
    ranks = bpe.read_ranks(tokenizer_path(RANKS))
    pairs = bpe.PairRanks(ranks)
    rng = random.Random(5)
    pieces = [bytes(rng.choices(rng.choice([b"ab", b"\xc3\xa9\xe6", bytes(range(256))]), k=rng.randint(33, 64)))
              for _ in range(200)]
    pieces = [x for x in pieces if x not in ranks]
    assert [bpe.merge(x, ranks) for x in pieces] == [list(array("I", x)) for x in bpe.merge_together(pieces, pairs)]
    long = "".join(rng.choices("abcdeé", k=20_000))
    assert bpe.merge(long.encode(), ranks) == reference.encode_ordinary(long)
    assert bpe.merge(b"", ranks) == []


def test_bpe_memo_is_bounded_and_changes_nothing(monkeypatch):
    import public_tokenizers
    encoder = bpe.Encoder(bpe.read_ranks(tokenizer_path(RANKS)), public_tokenizers.PATTERN)
    texts = random_texts(300) + ["w" * 200]
    want = encoder.ids(texts)
    assert "w" * 200 not in encoder.known
    monkeypatch.setattr(bpe, "MEMO", 20)
    monkeypatch.setattr(bpe, "PIECES", 7)
    assert encoder.ids(texts) == want and len(encoder.known) <= 27


def test_bpe_operator_round_trip(spark, reference):
    import public_tokenizers
    rows = list(enumerate(ODD)) + [(3, "twice"), (3, "twice"), (None, "no id")]
    path = tokenizer_path(RANKS)
    encoded = bpe.encode_texts(documents(spark, rows), path, public_tokenizers.PATTERN)
    got = bpe.decode_ids(encoded, path).collect()
    key = lambda r: (r[0] is None, r[0] or 0, r[1] or "")
    assert sorted(((r.doc_id, bytes(r.bytes).decode()) for r in got), key=key) == sorted(
        ((i, x or "") for i, x in rows), key=key)
    by_text = {bytes(r.bytes).decode(): list(array("I", bytes(r.ids))) for r in got}
    assert all(by_text[x or ""] == reference.encode_ordinary(x or "") for _, x in rows)
    assert bpe.encode_texts(documents(spark, rows).limit(0), path, public_tokenizers.PATTERN).count() == 0


def test_op11_over_the_whole_table(spark, reference):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").collect()
    got = {r.doc_id: r for r in QUERIES["op11_byte_bpe"](spark, FOLDER).collect()}
    assert len(got) == len(docs)
    for d in docs:
        ids = reference.encode_ordinary(d.text or "")
        sha = hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert (got[d.doc_id].n_tokens, got[d.doc_id].ids_sha256) == (len(ids), sha)
        assert got[d.doc_id].decoded_sha256 == hashlib.sha256((d.text or "").encode()).hexdigest()


# --- conversation repair ------------------------------------------------------

def brute_edits(codes):
    """Uniform-cost search ordered by (cost, audit) over all edits."""
    heap, done = [(0, "", 0, "", "")], set()
    while heap:
        cost, audit, i, last, roles = heapq.heappop(heap)
        if (i, last) in done:
            continue
        if i == len(codes) and last in ("", "a"):
            return cost, audit, roles
        done.add((i, last))
        turn = "a" if last == "u" else "u"
        heapq.heappush(heap, (cost + 3, audit + "I", i, turn, roles + turn))
        if i < len(codes):
            c = codes[i]
            heapq.heappush(heap, (cost + 4, audit + "D", i + 1, last, roles + "-"))
            if c != "d":
                more = 3 * c.isupper()
                heapq.heappush(heap, (cost + 3 + more, audit + "R", i + 1, turn, roles + turn))
                if c.lower() == turn or (c.lower() == "s" and last == ""):
                    heapq.heappush(heap, (cost + more, audit + "K", i + 1, c.lower(), roles + c.lower()))


def every_sequence(codes):
    """(cost, audit) of the best of all edit sequences with at most one insert between rows."""
    best = None
    for edits in product("DKR", repeat=len(codes)):
        for inserts in product((0, 1), repeat=len(codes) + 1):
            cost, audit, last, good = 0, "", "", True
            for i in range(len(codes) + 1):
                if inserts[i]:
                    cost, audit, last = cost + 3, audit + "I", "a" if last == "u" else "u"
                if i == len(codes):
                    break
                c, e, turn = codes[i], edits[i], "a" if last == "u" else "u"
                audit += e
                if e == "D":
                    cost += 4
                    continue
                cost += 3 * c.isupper() + (3 if e == "R" else 0)
                now = turn if e == "R" else c.lower()
                if c == "d" or not (now == turn or now == "s" and last == ""):
                    good = False
                    break
                last = now
            if good and last in ("", "a") and (best is None or (cost, audit) < best):
                best = cost, audit
    return best


def test_cheapest_edits_are_proved_best():
    rng = random.Random(11)
    for codes in ["", "s", "S", "d", "u", "sua", "suaua", "ss", "xx", "aua", "UASX"] + [
            "".join(rng.choices("suaxSUAXd", k=rng.randint(1, 4))) for _ in range(150)]:
        assert repair.cheapest_edits(codes)[:2] == every_sequence(codes), codes
    for _ in range(1500):
        codes = "".join(rng.choices("suaxSUAXd", k=rng.randint(1, 40)))
        assert repair.cheapest_edits(codes) == brute_edits(codes), codes


def test_cheapest_edits_of_a_very_long_conversation():
    rng = random.Random(2)
    codes = "".join(rng.choices("suaxSUAXd", k=30_000))
    cost, audit, roles = repair.cheapest_edits(codes)
    assert (cost, audit, roles) == brute_edits_by_rows(codes)


def brute_edits_by_rows(codes):
    """Row by row, the best (cost, audit, roles) for each last role, audits compared whole."""
    def closed(best):
        for _ in range(2):
            for last, (c, a, r) in list(best.items()):
                turn = "a" if last == "u" else "u"
                best[turn] = min(best.get(turn, (9e9,)), (c + 3, a + "I", r + turn))
        return best
    best = closed({"": (0, "", "")})
    for code in codes:
        new = {}
        def offer(last, way):
            new[last] = min(new.get(last, (9e9,)), way)
        for last, (c, a, r) in best.items():
            offer(last, (c + 4, a + "D", r + "-"))
            if code != "d":
                turn, more = "a" if last == "u" else "u", 3 * code.isupper()
                offer(turn, (c + 3 + more, a + "R", r + turn))
                if code.lower() == turn or code.lower() == "s" and last == "":
                    offer(code.lower(), (c + more, a + "K", r + code.lower()))
        best = closed(new)
    return min(best[x] for x in ("", "a") if x in best)


def repaired_by_hand(rows):
    """The contract, conversation by conversation, for rows (conv, turn, role, text)."""
    convs = defaultdict(list)
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        kind = zlib.crc32(key.encode()) % 20
        convs[conv]
        if kind == 0:
            continue
        text = "" if kind == 1 else "".join(c for c in text if c not in ".!?") if kind == 2 else text
        convs[conv] += [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    out = {}
    for conv, found in convs.items():
        found.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        seen, faults, codes = set(), Counter(), ""
        for _, role, text in found:
            bare = text.rstrip(" \t\n\x0b\x0c\r")
            fault = ("blank" if not bare else "duplicate" if (role, text) in seen else
                     "truncated" if bare[-1] not in ".!?" else "")
            seen.add((role, text))
            faults[fault] += 1
            code = role[:1] if role[:1] in ("s", "u", "a") else "x"
            codes += "d" if fault in ("blank", "duplicate") else code.upper() if fault else code
        turns = {t for t, _, _ in found if t is not None}
        cost, audit, roles = brute_edits(codes)
        lines, i = [], 0
        for e, r in zip(audit, roles):
            if e == "I":
                lines.append({"u": "user:", "a": "assistant:"}[r])
                continue
            if e != "D":
                lines.append((found[i][1] if e == "K" else {"u": "user", "a": "assistant"}[r]) + ":" + found[i][2])
            i += 1
        out[conv] = (max(turns) - min(turns) + 1 - len(turns) if turns else 0, faults["blank"], faults["duplicate"],
                     faults["truncated"], sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au")
                                              for a, b in zip(found, found[1:])),
                     cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def compare_repair(spark, tmp_path, rows):
    folder = str(tmp_path / "sf")
    spark.createDataFrame([(*r, "clash", True) for r in rows], "conv_id long, turn long, role string, text string,"
                          " audit string, present boolean").write.parquet(f"{folder}/conversations.parquet")
    got = {r.conv_id: tuple(r)[1:] for r in QUERIES["op12_conversation_repair"](spark, folder).collect()}
    assert got == repaired_by_hand(rows)


def test_op12_odd_rows(spark, tmp_path):
    rng = random.Random(8)
    rows = [(c, rng.choice([None, *range(9)]), rng.choice(["system", "user", "assistant", "tool", None, "", "ü"]),
             rng.choice([None, "", " \t", "a.", "a", "b!  ", "c ", "?", "a.\x1c", "\x85"]))
            for c in range(300) for _ in range(rng.randint(1, 9))]
    rows += [(None, None, None, None), (None, 1, "user", "x."), (-1, 5, "system", "s.")] + rows[:40]
    rows += [(1000, i, rng.choice(["user", "assistant"]), f"t{i % 90}.") for i in range(700)]
    rows += [(1001, 2, "user", "long " * 200_000)]
    compare_repair(spark, tmp_path, rows)


def test_op12_over_the_whole_table(spark):
    rows = [(r.conv_id, r.turn, r.role, r.text)
            for r in spark.read.parquet(f"{FOLDER}/conversations.parquet").collect()]
    got = {r.conv_id: tuple(r[c] for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit",
                                           "repaired_sha256"))
           for r in QUERIES["op12_conversation_repair"](spark, FOLDER).collect()}
    assert got == repaired_by_hand(rows)


def test_repair_of_nothing(spark):
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert repair.repair(empty).count() == 0
    gone = repair.repair(spark.createDataFrame([(7, 1, "user", "x")], empty.schema), F.lit(False)).first()
    assert (gone.conv_id, gone.cost, gone.audit, gone.repaired, gone.gaps) == (7, 0, "", [], 0)


# --- token alignment ----------------------------------------------------------

@pytest.fixture(scope="module")
def tokenize():
    tokenizers = pytest.importorskip("tokenizers")
    sentencepiece = pytest.importorskip("sentencepiece")
    a = tokenizers.Tokenizer.from_file(tokenizer_path())
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path("piece_bpe_32k.model"))
    known = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte_of = {chr(x): x for x in known} | {chr(256 + i): x for i, x in enumerate(sorted(set(range(256)) - set(known)))}

    def run(text):
        if not text:
            return [], []
        left = [(i, bytes(byte_of[c] for c in a.id_to_token(i))) for i in a.encode(" " + text, add_special_tokens=False).ids]
        right = [(i, bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode())
                 for i in b.encode(text) for p in [b.id_to_piece(i)]]
        whole = (" " + text).encode()
        same = b"".join(x for _, x in left) == whole == b"".join(x for _, x in right)
        return (left, right) if same else ([], [])
    return run


def aligned_by_hand(tokenize, rows):
    parts, count = [], Counter()
    for doc, text in rows:
        left, right = tokenize(text)
        spans = []
        for side in (left, right):
            at, found = 0, []
            for i, raw in side:
                found.append((at, at + len(raw), i))
                at += len(raw)
            spans.append(found)
        links = [(x[2], y[2]) for x in spans[0] for y in spans[1] if x[0] < y[1] and y[0] < x[1]]
        cuts = sorted({x[1] for x in spans[0]} & {y[1] for y in spans[1]})
        groups, start = [], 0
        for c in cuts:
            groups.append("|".join(",".join(str(x[2]) for x in side if start <= x[0] < c) for side in spans))
            start = c
        count.update(set(links))
        parts.append((doc, len(left), len(right), len(cuts), links, ";".join(groups)))
    top = defaultdict(int)
    for (a, _), n in count.items():
        top[a] = max(top[a], n)
    return sorted(((doc, na, nb, nc, len(links), sum(count[x] == top[x[0]] for x in links),
                    sum(count[x] for x in links), hashlib.sha256(g.encode()).hexdigest() if g else "")
                   for doc, na, nb, nc, links, g in parts), key=repr)


COLUMNS = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


@pytest.mark.parametrize("stretch, block", [(512, 1 << 21), (3, 50)])
def test_alignment_by_brute_force(spark, tokenize, monkeypatch, stretch, block):
    monkeypatch.setattr(align, "STRETCH", stretch)
    rows = list(enumerate(ODD)) + [(100 + i, x) for i, x in enumerate(random_texts(150, 9))]
    rows += [(5, "twice told"), (5, "twice told"), (None, "no id")]
    a, b = align.models(tokenizer_path(), tokenizer_path("piece_bpe_32k.model"))
    x = align.align_texts([t for _, t in rows], a, b)
    texts = align.group_texts(x, 60_000)
    want = aligned_by_hand(tokenize, rows)
    assert sorted((hashlib.sha256(t.encode()).hexdigest() if t else "" for t in texts)) == sorted(w[-1] for w in want)
    if block > 50:
        got = align.alignment_scores(documents(spark, rows), tokenizer_path(), tokenizer_path("piece_bpe_32k.model"))
        assert sorted((tuple(r[c] for c in COLUMNS) for r in got.collect()), key=repr) == want
        assert align.alignment_scores(documents(spark, rows).limit(0), tokenizer_path(),
                                      tokenizer_path("piece_bpe_32k.model")).count() == 0


def test_align_gives_tokens_links_and_cuts(spark, tokenize):
    rows = [(1, "Hello wörld, token alignment"), (2, None), (3, "a  b")]
    got = {r.doc_id: r for r in align.align(documents(spark, rows), tokenizer_path(),
                                            tokenizer_path("piece_bpe_32k.model")).collect()}
    left, right = tokenize(rows[0][1])
    assert got[1].a == [i for i, _ in left] and got[1].b == [i for i, _ in right]
    assert got[1].cuts[-1] == len((" " + rows[0][1]).encode()) and got[1].links[0] == [0, 0]
    assert got[1].links[-1] == [len(left) - 1, len(right) - 1]
    assert got[2].a == got[2].links == [] and got[2].groups == ""


def test_op13_over_the_whole_table(spark, tokenize):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()]
    # brute force is quadratic in a text: the longest are compared by the sums alone
    got = {r.doc_id: r for r in QUERIES["op13_token_alignment"](spark, FOLDER).collect()}
    assert len(got) == len(rows)
    for doc, text in rows:
        left, right = tokenize(text)
        assert (got[doc].n_a, got[doc].n_b) == (len(left), len(right))
        ends = [set(np.cumsum([len(x) for _, x in side]).tolist()) for side in (left, right)]
        cuts = len(ends[0] & ends[1])
        assert got[doc].n_groups == cuts and got[doc].n_links == len(left) + len(right) - cuts


def test_blocks_keep_all_rows():
    import pandas as pd
    frames = [pd.DataFrame({"doc_id": range(5), "text": ["a" * n for n in (3, 0, 40, 1, 9)]}),
              pd.DataFrame({"doc_id": [], "text": []}), pd.DataFrame({"doc_id": [9, 10], "text": [None, "b"]})]
    got = list(align.blocks(iter(frames), 10))
    assert [int(i) for f in got for i in f["doc_id"]] == [0, 1, 2, 3, 4, 9, 10] and len(got) > 2


MIXED = ["हिन्दी में लिखा", "ภาษาไทย", "x=1; y_2->z", "don't we'll", "naïve e\u0301te\u0301", "漢字かな交じり文。", "  a\n\n\tb", "…—“q”",
         "3.14159", "العربية", "한국어 조사", "a▁b", "\u3000 x", "www.x-y.org/?q=1&r", "🙂🙂", "\x00\x01"]


def test_a_unit_is_tokenised_and_aligned_once(tokenize, monkeypatch):
    a, b = align.models(tokenizer_path(), tokenizer_path("piece_bpe_32k.model"))
    align.units.cache_clear()
    asked = []
    for name, model in (("a", a), ("b", b)):
        monkeypatch.setattr(model, "ids", lambda units, ids=model.ids: asked.extend(units) or ids(units))
    texts = ["some words, some other words.\n" * 300, "other words", "a▁b other", None]
    x = align.align_texts(texts, a, b)
    assert np.diff(x.a_start)[[1, 2, 3]].tolist() == [2, 0, 0] and x.a_start[1] > 2000
    assert sum(len("".join(u)) for u in asked) < 200
    n = len(asked)
    assert align.align_texts(texts[::-1], a, b).groups == x.groups[::-1] and len(asked) == n


def test_units_give_what_whole_texts_give(tokenize, monkeypatch):
    paths = tokenizer_path(), tokenizer_path("piece_bpe_32k.model")
    a, b = align.models(*paths)
    with monkeypatch.context() as m:
        m.setattr(align.PieceModel, "_open", lambda self, path: None)
        whole = align.PieceModel(paths[1])
    assert b.reach is not None and whole.reach is None
    rng = random.Random(11)
    texts = [rng.choice(["", " "]).join(rng.choices(MIXED, k=rng.randrange(1, 9))) for _ in range(400)] + random_texts(100, 5) + ODD
    want = align.align_texts(texts, a, whole)
    assert any(want.groups) and sum(map(len, align.units(a, b).codes.pieces)) > 0
    monkeypatch.setattr(align, "MEMO", 40)   # units are forgotten all the time
    align.units.cache_clear()
    start = 0
    for i in range(0, len(texts), 25):
        got = align.align_texts(texts[i:i + 25], a, b)
        assert got.groups == want.groups[i:i + 25]
        n = len(got.link_a)
        assert np.array_equal(got.link_a, want.link_a[start:start + n] - want.a_start[i])
        assert np.array_equal(got.link_b, want.link_b[start:start + n] - want.b_start[i])
        start += n
    known = align.units(a, b)
    assert any(len(x) > 1 for x in known.codes.pieces) and start == len(want.link_a)
    assert max(len(known.codes.pieces), int(known.chars.sum()) // 16) < 2000
    align.units.cache_clear()


def test_a_long_unit_is_not_remembered(tokenize, monkeypatch):
    monkeypatch.setattr(align, "MEMO", 1000)
    a, b = align.models(tokenizer_path(), tokenizer_path("piece_bpe_32k.model"))
    align.units.cache_clear()
    for text in ("x" * 50_000, "▁" * 50_000):
        x = align.align_texts([text, "short"], a, b)
        assert (x.a_start[1] > 0) == (text[0] == "x") and x.groups[1]
        align.align_texts(["short"], a, b)
        assert align.units(a, b).chars.sum() < 100
    align.units.cache_clear()
