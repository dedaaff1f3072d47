"""Alignment of two tokenizers' tokens over the same bytes, and how often their tokens meet.

Tokens of A and B that share a byte are linked.  A text is cut to units: pieces of A's pattern, those
between whose characters some token of B could reach taken together.  No token of either crosses from
one unit to the next, so tokens, links and cuts of a text are those of its units, in a row, and a
unit is tokenised and aligned once for all places where a Python worker meets it again.

Going through a unit, the pair (token of A, token of B) at the next byte changes as the token that
ends first, or both, give way; a place where both end is a cut.  All new units of a block do that
together, in stretches of the bytes they have in a row: one NumPy vector holds their pairs, each step
emits a link for each, marks the cuts, moves on, and drops the stretches that are done.  A long unit
is several stretches, since the pair at any byte can be looked up.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain, islice

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from cohortkit.llm.bpe import MEMO, MEMO_CHARS, PIECES, SIDE_BY_SIDE, merge, read_json_ranks
from cohortkit.llm.packing import RULE
from cohortkit.llm.store import settle
from cohortkit.llm.text import lean

#: Bytes of a stretch; characters of text that are aligned together.
STRETCH, BLOCK = 512, 1 << 21


class PieceModel:
    """Ids of a sentencepiece model and the bytes they stand for.

    A BPE model that takes texts as they are (no normalisation, a byte for every unknown character)
    never joins two neighbouring characters that stand side by side in none of its pieces:
    ``reach[x, y]`` says whether characters of classes x and y do in any.  For other models
    ``reach`` is None, and a text must be encoded whole.
    """

    def __init__(self, path: str):
        import sentencepiece

        self.model, self.reach, self.classes = sentencepiece.SentencePieceProcessor(model_file=path), None, {}
        self.bytes = [self._bytes(i) for i in range(self.model.get_piece_size())]
        self.lengths = np.array([len(x) for x in self.bytes], np.int64)
        self._open(path)

    def _bytes(self, i: int) -> bytes:
        piece = self.model.id_to_piece(i)
        if self.model.is_byte(i):
            return bytes([int(piece[3:-1], 16)])
        return piece.replace("▁", " ").encode("utf-8")

    def _open(self, path: str) -> None:
        """Read the model so that it adds no space of its own, if its texts may be cut."""
        try:
            import sentencepiece
            from sentencepiece import sentencepiece_model_pb2
        except ImportError:  # without protobuf
            return
        proto = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as f:
            proto.ParseFromString(f.read())
        how, rule = proto.trainer_spec, proto.normalizer_spec
        if (how.model_type != how.BPE or not how.byte_fallback or how.treat_whitespace_as_suffix
                or rule.precompiled_charsmap or rule.remove_extra_whitespaces or not rule.escape_whitespaces
                or not rule.add_dummy_prefix or sum(map(self.model.is_byte, range(len(self.bytes)))) != 256):
            return
        rule.add_dummy_prefix = False
        self.model = sentencepiece.SentencePieceProcessor(model_proto=proto.SerializeToString())
        pairs = {piece[i:i + 2] for k, x in enumerate(self.bytes) if not self.model.is_byte(k)
                 for piece in [x.decode("utf-8")] for i in range(len(piece) - 1)}
        # class 0: characters that stand beside none
        self.classes = {c: i for i, c in enumerate(sorted(set("".join(pairs))), 1)}
        self.reach = np.zeros((len(self.classes) + 1,) * 2, bool)
        for x, y in pairs:
            self.reach[self.classes[x], self.classes[y]] = True

    def ids(self, units: list[str]) -> list[list[int]]:
        """Ids of parts of a space and a text; where ``reach`` is None, of a space and a whole text."""
        if not units:
            return []
        return self.model.encode(units if self.reach is not None else [x[1:] for x in units], num_threads=1)


class ByteModel:
    """Ids of a byte-level BPE file and the bytes they stand for.

    The file's vocabulary is handed to ``tiktoken`` as ranks, a piece of the pattern at a time; long
    pieces are merged by ``bpe.merge``."""

    def __init__(self, path: str):
        import regex
        import tiktoken

        self.ranks, self.pattern = read_json_ranks(path), regex.compile(RULE)
        self.encode = tiktoken.Encoding("piece", pat_str=r"[\s\S]+", mergeable_ranks=self.ranks,
                                        special_tokens={}).encode_ordinary
        self.bytes = [b""] * (max(self.ranks.values()) + 1)
        for token, i in self.ranks.items():
            self.bytes[i] = token
        self.lengths = np.array([len(x) for x in self.bytes], np.int64)

    def pieces(self, text: str) -> Iterator[str]:
        if len(text) <= 1 << 20:
            return iter(self.pattern.findall(text))
        return (match[0] for match in self.pattern.finditer(text))

    def _piece(self, piece: str) -> list[int]:
        return merge(piece.encode("utf-8"), self.ranks) if len(piece) > SIDE_BY_SIDE else self.encode(piece)

    def ids(self, units: list[tuple[str, ...]]) -> list[list[int]]:
        """Ids of units, by their pieces."""
        return [self._piece(x[0]) if len(x) == 1 else [i for piece in x for i in self._piece(piece)] for x in units]


@functools.cache
def models(path_a: str, path_b: str) -> tuple[ByteModel, PieceModel]:
    """Kept for the life of a Python worker."""
    return ByteModel(path_a), PieceModel(path_b)


@dataclass
class Aligned:
    """Tokens, links, cuts and groups of a block of documents (or units), all in document order."""

    a: np.ndarray              # ids of A
    b: np.ndarray
    a_start: np.ndarray        # first token of each document, and one more
    b_start: np.ndarray
    link_a: np.ndarray         # places in a and b
    link_b: np.ndarray
    cut: np.ndarray            # whether both tokens of a link end there
    link_doc: np.ndarray
    groups: list[str]          # ``group_texts`` of each document


def lockstep(end_a: np.ndarray, end_b: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(places in A, places in B, cut) of all links, by byte ends that have the last end in common.

    ``starts`` are the bytes where stretches begin, ascending, 0 the first of them.
    """
    na, nb = len(end_a), len(end_b)
    a, b = np.searchsorted(end_a, starts, "right"), np.searchsorted(end_b, starts, "right")
    stop_a, stop_b = np.r_[a[1:], na], np.r_[b[1:], nb]
    # each link moves a + b on, so the sum is its place in the text's order
    at_a, cut = np.full(na + nb + 1, -1, np.int64), np.zeros(na + nb + 1, bool)
    live = (a != stop_a) | (b != stop_b)
    while live.any():
        if not live.all():
            a, b, stop_a, stop_b = a[live], b[live], stop_a[live], stop_b[live]
        here, byte_a, byte_b = a + b, end_a[a], end_b[b]
        at_a[here] = a
        cut[here] = byte_a == byte_b
        a = a + (byte_a <= byte_b)
        b = b + (byte_b <= byte_a)
        live = (a != stop_a) | (b != stop_b)
    place = np.flatnonzero(at_a >= 0)
    return at_a[place], place - at_a[place], cut[place]


def align_units(units: list[tuple[str, ...]], a: ByteModel, b: PieceModel) -> tuple[Aligned, np.ndarray]:
    """Links and cuts of units, and which of them both tokenizers give back.  The others have no tokens."""
    names = ["".join(x) for x in units]
    ids_a, ids_b = a.ids(units), b.ids(names)
    size_a, size_b = (np.fromiter(map(len, ids), np.int64, len(units)) for ids in (ids_a, ids_b))
    all_a, all_b = (np.fromiter(chain.from_iterable(ids), np.int64) for ids in (ids_a, ids_b))
    raw = [x.encode("utf-8") for x in names]
    ends = np.cumsum(np.fromiter(map(len, raw), np.int64, len(raw)))
    whole, good = b"".join(raw), np.ones(len(units), bool)
    for model, ids, size in ((a, all_a, size_a), (b, all_b, size_b)):
        at = np.r_[0, np.cumsum(model.lengths[ids])][np.r_[0, np.cumsum(size)]]
        found = b"".join(map(model.bytes.__getitem__, ids.tolist()))
        if found != whole or (at[1:] != ends).any():
            good &= [found[i:j] == x for i, j, x in zip(at.tolist(), at[1:].tolist(), raw)]
    all_a, all_b = all_a[np.repeat(good, size_a)], all_b[np.repeat(good, size_b)]
    a_start, b_start = np.r_[0, np.cumsum(size_a * good)], np.r_[0, np.cumsum(size_b * good)]
    end_a, end_b = np.cumsum(a.lengths[all_a]), np.cumsum(b.lengths[all_b])
    none = np.zeros(0, np.int64)
    link_a, link_b, cut = none, none, np.zeros(0, bool)
    if len(all_a):
        link_a, link_b, cut = lockstep(end_a, end_b, np.arange(0, end_a[-1], STRETCH))
    unit = np.repeat(np.arange(len(units)), np.diff(a_start))[link_a]
    made = Aligned(all_a, all_b, a_start, b_start, link_a, link_b, cut, unit, [])
    made.groups = group_texts(made, max(len(a.bytes), len(b.bytes)))
    return made, good


def _spread(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """start, start + 1, ... of each stretch, one after the other."""
    ends = np.cumsum(sizes)
    return np.repeat(starts - ends + sizes, sizes) + np.arange(ends[-1] if len(ends) else 0)


class Codes(dict):
    """Numbers pieces, or tuples of several pieces, in the order they are first asked for."""

    def __init__(self, pieces: list[tuple[str, ...]]):
        super().__init__((x[0] if len(x) == 1 else x, i) for i, x in enumerate(pieces))
        self.pieces = pieces

    def __missing__(self, x: str | tuple[str, ...]) -> int:
        self[x] = code = len(self.pieces)
        self.pieces.append((x,) if isinstance(x, str) else x)
        return code

    def of(self, names: list) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, names), np.int32, len(names))


class Units:
    """The units that a Python worker has met, aligned; the most used of them stay when there are many."""

    def __init__(self, a: ByteModel, b: PieceModel):
        self.a, self.b = a, b
        self._clear()

    def _clear(self) -> None:
        none = np.zeros(0, np.int32)
        self.codes = Codes([])
        self.groups: list[str] = []
        self.good, self.uses = np.zeros(0, bool), np.zeros(0, np.int64)
        self.first = self.last = self.chars = none                  # classes of outer characters, length
        # tokens and links of all units in a row, and where each unit's begin, and one more
        self.tokens_a = self.tokens_b = self.link_a = self.link_b = none
        self.cut = np.zeros(0, bool)
        self.at_a = self.at_b = self.at_link = np.zeros(1, np.int64)

    def _forget(self) -> None:
        """Keep the most used half of a full memory, long units apart."""
        if len(self.groups) <= MEMO and self.chars.sum(dtype=np.int64) <= 16 * MEMO:
            return
        order = np.argsort(-self.uses, kind="stable")
        order = order[self.chars[order] <= MEMO_CHARS][:MEMO // 2]
        kept = order[np.cumsum(self.chars[order], dtype=np.int64) <= 8 * MEMO]
        old = dict(vars(self))
        self._clear()
        self.codes = Codes([old["codes"].pieces[i] for i in kept.tolist()])
        self.groups = [old["groups"][i] for i in kept.tolist()]
        for name in ("good", "first", "last", "chars"):
            setattr(self, name, old[name][kept])
        self.uses = old["uses"][kept] // 2
        for at, names in (("at_a", ["tokens_a"]), ("at_b", ["tokens_b"]), ("at_link", ["link_a", "link_b", "cut"])):
            sizes = np.diff(old[at])[kept]
            place = _spread(old[at][kept], sizes)
            setattr(self, at, np.r_[0, np.cumsum(sizes)])
            for name in names:
                setattr(self, name, old[name][place])

    def _measure(self) -> None:
        """Classes and lengths of the units that have a code only."""
        find, new = self.b.classes.get, self.codes.pieces[len(self.chars):]
        self.first = np.r_[self.first, np.array([find(x[0][0], 0) for x in new], np.int32)]
        self.last = np.r_[self.last, np.array([find(x[-1][-1], 0) for x in new], np.int32)]
        self.chars = np.r_[self.chars, np.array([sum(map(len, x)) for x in new], np.int32)]

    def _align(self) -> None:
        """Align the units that have a code only."""
        n = len(self.groups)
        if n == len(self.codes.pieces):
            return
        made, good = align_units(self.codes.pieces[n:], self.a, self.b)
        self.groups += made.groups
        self.good = np.r_[self.good, good]
        self.uses = np.r_[self.uses, np.zeros(len(good), np.int64)]
        first_link = np.searchsorted(made.link_doc, np.arange(len(good) + 1))
        for at, start in (("at_a", made.a_start), ("at_b", made.b_start), ("at_link", first_link)):
            setattr(self, at, np.r_[getattr(self, at), getattr(self, at)[-1] + start[1:]])
        for name, values in (("tokens_a", made.a), ("tokens_b", made.b), ("cut", made.cut),
                             ("link_a", made.link_a - made.a_start[made.link_doc]),
                             ("link_b", made.link_b - made.b_start[made.link_doc])):
            held = getattr(self, name)
            setattr(self, name, np.concatenate([held, values.astype(held.dtype)]))

    def of(self, raw: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(text, code) of the units of texts, in order.  Codes hold until the next call."""
        self._forget()
        parts, counts = [], []
        for text in raw:
            found, n = self.a.pieces(text), 0
            while part := list(islice(found, PIECES)):
                parts.append(self.codes.of(part))
                n += len(part)
            counts.append(n)
        codes = np.concatenate(parts or [np.zeros(0, np.int32)])
        owner = np.repeat(np.arange(len(raw)), counts)
        self._measure()
        joined = owner[1:] == owner[:-1]
        if self.b.reach is not None:
            joined &= self.b.reach[self.last[codes[:-1]], self.first[codes[1:]]]
        if joined.any():
            begin = np.flatnonzero(np.r_[True, ~joined])
            end = np.r_[begin[1:], len(codes)]
            several = np.flatnonzero(end - begin > 1)
            names = [tuple(self.codes.pieces[c][0] for c in codes[i:j].tolist())
                     for i, j in zip(begin[several].tolist(), end[several].tolist())]
            codes, owner = codes[begin], owner[begin]
            codes[several] = self.codes.of(names)
            self._measure()
        self._align()
        self.uses += np.bincount(codes, minlength=len(self.uses))
        return owner, codes


@functools.cache
def units(a: ByteModel, b: PieceModel) -> Units:
    """Kept for the life of a Python worker."""
    return Units(a, b)


def align_texts(texts: list[str | None], a: ByteModel, b: PieceModel) -> Aligned:
    """Links and cuts of a block.  A text that the two tokenizers do not both give back has no tokens."""
    known = units(a, b)
    owner, codes = known.of([(" " + x) if x else "" for x in texts])
    # a unit that is not given back is one whose characters change, and so does its text
    lost = np.zeros(len(texts), bool)
    lost[owner[~known.good[codes]]] = True
    owner, codes = owner[~lost[owner]], codes[~lost[owner]]
    first = np.searchsorted(owner, np.arange(len(texts) + 1))

    def spread(at):
        sizes = np.diff(at)[codes]
        starts = np.r_[0, np.cumsum(sizes)]
        return _spread(at[codes], sizes), starts, sizes

    from_a, start_a, _ = spread(known.at_a)
    from_b, start_b, _ = spread(known.at_b)
    from_link, _, links = spread(known.at_link)
    groups = codes.tolist()
    return Aligned(
        known.tokens_a[from_a].astype(np.int64), known.tokens_b[from_b].astype(np.int64), start_a[first], start_b[first],
        known.link_a[from_link] + np.repeat(start_a[:-1], links), known.link_b[from_link] + np.repeat(start_b[:-1], links),
        known.cut[from_link], np.repeat(owner, links),
        [";".join(map(known.groups.__getitem__, groups[i:j])) for i, j in zip(first.tolist(), first[1:].tolist())])


@functools.cache
def _words(n: int) -> np.ndarray:
    """Decimal numbers, followed in turn by each of the four signs that may follow an id in a group text."""
    return np.array([f"{i}{sign}" for sign in (",", "|", ";", "") for i in range(n)], object)


def group_texts(x: Aligned, size: int) -> list[str]:
    """For each document ``a1,a2|b1;a3|b2,b3``: the ids of A and of B between cuts."""
    last = np.flatnonzero(x.cut)
    end_a, end_b = x.link_a[last], x.link_b[last]
    group_a = np.searchsorted(end_a, np.arange(len(x.a)))
    group_b = np.searchsorted(end_b, np.arange(len(x.b)))
    # ids of A stand after the groups before, those of B after their group's ids of A
    size_b, size_a = np.bincount(group_b, minlength=len(last)), np.bincount(group_a, minlength=len(last))
    before_b = np.cumsum(size_b) - size_b
    upto_a = np.cumsum(size_a)
    words, out = _words(size), np.empty(len(x.a) + len(x.b), object)
    sign_a = np.zeros(len(x.a), np.int64)
    sign_a[end_a] = 1
    sign_b = np.zeros(len(x.b), np.int64)
    sign_b[end_b] = 2
    final = x.b_start[1:][np.diff(x.b_start) > 0] - 1
    sign_b[final] = 3
    out[np.arange(len(x.a)) + before_b[group_a]] = words[x.a + size * sign_a]
    out[np.arange(len(x.b)) + upto_a[group_b]] = words[x.b + size * sign_b]
    edges = x.a_start + x.b_start
    return ["".join(out[i:j]) for i, j in zip(edges.tolist(), edges[1:].tolist())]


def blocks(batches: Iterator[pd.DataFrame], limit: int) -> Iterator[pd.DataFrame]:
    """The same rows in frames of about ``limit`` characters of text; a longer text is a frame of its own."""
    held, n = [], 0
    for batch in batches:
        lengths = n + np.cumsum([0 if pd.isna(t) else len(t) for t in batch["text"]], dtype=np.int64)
        cuts = np.flatnonzero(np.diff(np.r_[n // limit, lengths // limit])) if len(batch) else []
        at = 0
        for c in cuts:
            held.append(batch.iloc[at:c + 1])
            yield pd.concat(held, ignore_index=True)
            held, at = [], c + 1
        held.append(batch.iloc[at:])
        n = int(lengths[-1]) % limit if len(batch) else n
    if sum(map(len, held)):
        yield pd.concat(held, ignore_index=True)


def align(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """(doc_id, a, b, cuts, links, groups) for every whole text.

    ``a``, ``b``: ids, of a space and the text by the byte-level BPE file A, of the text by the
    sentencepiece model B (which adds the space).  ``cuts``: byte offsets where tokens of both end.
    ``links``: (place in a, place in b) of all tokens that share a byte, in order.  ``groups``: the
    ids between cuts as text.  Control words in a text are ordinary characters.

    A text that is null, empty, or not given back by either tokenizer (white space that B folds, for
    one) has empty arrays and an empty ``groups``.  A null doc_id stays null, repeated rows are
    aligned one by one, other columns are ignored, an empty table gives no rows.  A long text needs
    memory in proportion to its own length.
    """
    @lean
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        a, b = models(path_a, path_b)
        for part in blocks(batches, BLOCK):
            x = align_texts([None if pd.isna(t) else t for t in part["text"]], a, b)
            bounds = np.searchsorted(x.link_doc, np.arange(len(part) + 1))
            ends = np.cumsum(a.lengths[x.a])
            rows = []
            for i, text in enumerate(x.groups):
                s, e = bounds[i], bounds[i + 1]
                a0, b0 = x.a_start[i], x.b_start[i]
                cut = x.link_a[s:e][x.cut[s:e]]
                rows.append((x.a[a0:x.a_start[i + 1]], x.b[b0:x.b_start[i + 1]],
                             ends[cut] - (ends[a0 - 1] if a0 else 0),
                             np.stack([x.link_a[s:e] - a0, x.link_b[s:e] - b0], 1).tolist(), text))
            out = pd.DataFrame(rows, columns=["a", "b", "cuts", "links", "groups"])
            out.insert(0, "doc_id", part["doc_id"].astype("Int64"))
            yield out

    return docs.select("doc_id", "text").mapInPandas(
        run, "doc_id long, a array<int>, b array<int>, cuts array<long>, links array<array<int>>, groups string")


#: First, a row a document (its distinct pairs as places in its block's list, and how many links each
#: has) and a row a block (its distinct pairs, and how many documents hold each).
FIRST = ("block long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string,"
         " pair binary, n binary, pairs binary")


def _first(path_a: str, path_b: str):
    @lean
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        a, b = models(path_a, path_b)
        block = TaskContext.get().partitionId() << 32
        for part in blocks(batches, BLOCK):
            x = align_texts([None if pd.isna(t) else t for t in part["text"]], a, b)
            digests = [hashlib.sha256(t.encode()).hexdigest() if t else "" for t in x.groups]
            pairs, at = np.unique(x.a[x.link_a] << 32 | x.b[x.link_b], return_inverse=True)
            width = max(1, len(pairs))
            held, n = np.unique(x.link_doc * width + at, return_counts=True)
            place = (held % width).astype("<i4")
            cuts = np.searchsorted(held // width, np.arange(len(part) + 1)).tolist()
            n = n.astype("<i4")
            yield pd.DataFrame({
                "block": block, "doc_id": part["doc_id"].astype("Int64"), "n_a": np.diff(x.a_start),
                "n_b": np.diff(x.b_start), "n_groups": np.bincount(x.link_doc[x.cut], minlength=len(part)),
                "n_links": np.bincount(x.link_doc, minlength=len(part)), "groups_sha256": pd.Series(digests, dtype=object),
                "pair": [place[i:j].tobytes() for i, j in zip(cuts, cuts[1:])],
                "n": [n[i:j].tobytes() for i, j in zip(cuts, cuts[1:])], "pairs": None})
            if len(pairs):
                # as (pair, documents) in turn
                both = np.stack([pairs, np.bincount(place, minlength=width)], 1).astype("<i8")
                yield pd.DataFrame([{"block": block, "pairs": both.tobytes()}]).reindex(
                    columns=FIRST.replace(" long", "").replace(" string", "").replace(" binary", "").split(", ")
                ).astype(object)
            block += 1
    return run


def _unpack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for block, packed in zip(batch["block"], batch["pairs"]):
            both = np.frombuffer(packed, "<i8").reshape(-1, 2)
            for i in range(0, len(both), 1 << 16):
                yield pd.DataFrame({"block": block, "pair": both[i:i + (1 << 16), 0], "n": both[i:i + (1 << 16), 1]})


def _score(docs: pd.DataFrame, pairs: pd.DataFrame) -> pd.DataFrame:
    pairs = pairs.sort_values("pair")
    count, best = pairs["docs"].to_numpy(), pairs["best"].to_numpy()
    sums = []
    for place, n in zip(docs["pair"], docs["n"]):
        place, n = np.frombuffer(place, "<i4"), np.frombuffer(n, "<i4").astype(np.int64)
        sums.append((int(n[best[place]].sum()), int((n * count[place]).sum())) if len(place) else (0, 0))
    out = docs.drop(columns=["block", "pair", "n"])
    out["n_best"], out["count_sum"] = zip(*sums) if sums else ([], [])
    return out.astype({"doc_id": "Int64"})


def pair_counts(first: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(block, pair, n) of every block, and (pair, docs, best) over the corpus: how many documents hold
    the pair linked, and whether that is its A id's highest count."""
    each = first.filter("pairs IS NOT NULL").select("block", "pairs").mapInPandas(
        lean(_unpack), "block long, pair long, n long")
    total = each.groupBy("pair").agg(F.sum("n").alias("docs"))
    total = total.withColumn("a", F.shiftright("pair", 32))
    top = total.groupBy("a").agg(F.max("docs").alias("top"))
    return each, total.join(top, "a").select("pair", "docs", (F.col("docs") == F.col("top")).alias("best"))


def alignment_scores(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256), a row a document.

    An id pair's count is the number of documents of the whole table in which the two ids are linked.
    ``n_best`` counts the links whose pair has its A id's highest count, ``count_sum`` adds up the
    counts of all links.  Documents without tokens (see ``align``) have zeros and ''; a null doc_id
    stays null, every repeated row is a document; other columns are ignored.

    Texts are tokenised and aligned once.  A block of texts stores which pairs each document holds as
    places in the block's own list of pairs; only those lists are shuffled, to be summed over the
    corpus and joined back, and each block's documents then meet their list.
    """
    first = settle(docs.select("doc_id", "text").mapInPandas(_first(path_a, path_b), FIRST))
    each, total = pair_counts(first)
    lists = each.select("block", "pair").join(total, "pair")
    rows = first.filter("pairs IS NULL").drop("pairs")
    schema = ("doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string,"
              " n_best long, count_sum long")
    return rows.groupBy("block").cogroup(lists.groupBy("block")).applyInPandas(_score, schema)
