"""Byte-level BPE: whole texts to token ids and back.

A text is cut by a pattern; each cut piece is merged on its own.  A segment tree over the piece's
byte positions holds, at the place where a live token starts, the rank of that token joined with the
next one; its root is the leftmost lowest rank.  A merge changes three leaves (the joined token, the
token before it, and the place that starts no token any more), each in logarithmic time, so that a
piece of a million bytes costs a million short steps and not a million scans.  The many short pieces
of a batch have their trees side by side in one array and are merged together, a step at a time.
"""

from __future__ import annotations

import base64
import functools
import json
import sys
from array import array
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from cohortkit.llm.text import lean

NONE = 1 << 62
#: A worker remembers the ids of about so many pieces, none longer than MEMO_CHARS.
MEMO, MEMO_CHARS = 1 << 18, 64
#: So many pieces are looked up at a time.
PIECES = 1 << 16
#: Trees of up to SIDE_BY_SIDE places are merged together, in arrays of up to CELLS places.
SIDE_BY_SIDE, CELLS = 1 << 10, 1 << 19
LONG = 1 << 12


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes to rank, from a file of lines "base64 rank"; the rank is the token's id."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (x.split() for x in lines if x.strip())}


def read_json_ranks(path: str) -> dict[bytes, int]:
    """Token bytes to id, from a byte-level BPE file of the ``tokenizers`` library, control words left out.

    Such a file lists its tokens in the order of their ranks."""
    with open(path, encoding="utf-8") as f:
        loaded = json.load(f)
    # bytes that are not printable stand in the file as the characters from 256 on
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte_of = {chr(b): b for b in printable}
    byte_of |= {chr(256 + i): b for i, b in enumerate(sorted(set(range(256)) - set(printable)))}
    special = {t["content"] for t in loaded["added_tokens"]}
    return {bytes(byte_of[c] for c in token): i for token, i in loaded["model"]["vocab"].items()
            if token not in special}


class PairTree:
    """The leftmost lowest value over positions 0 to n - 1, under changes of single positions.

    A value is ``rank << shift | position``: the least of them is the leftmost lowest rank.
    """

    def __init__(self, values: list[int]):
        self.size = size = 1 << (len(values) - 1).bit_length()
        tree = [NONE] * size + values + [NONE] * (size - len(values))
        for i in range(size - 1, 0, -1):
            a, b = tree[2 * i], tree[2 * i + 1]
            tree[i] = a if a < b else b
        # eight bytes a node where it counts
        self.tree = array("q", tree) if size > LONG else tree

    def put(self, position: int, value: int) -> None:
        tree, i = self.tree, position + self.size
        tree[i] = value
        i >>= 1
        while i:
            a, b = tree[2 * i], tree[2 * i + 1]
            if b < a:
                a = b
            if tree[i] == a:
                return
            tree[i] = a
            i >>= 1


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one piece: while two neighbours make a token, join the leftmost pair of lowest rank.

    A piece that is a token is that token; an empty one has none.
    """
    whole = ranks.get(piece)
    if whole is not None:
        return [whole]
    n = len(piece)
    if not n:
        return []
    shift, find = n.bit_length(), ranks.get
    mask = (1 << shift) - 1

    def pair(start: int, end: int) -> int:
        rank = find(piece[start:end])
        return NONE if rank is None else rank << shift | start

    # where the token that starts here ends, and where the one before it starts
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    pairs = PairTree([pair(i, i + 2) for i in range(n - 1)] + [NONE])
    top, put = pairs.tree, pairs.put
    while (least := top[1]) != NONE:
        i = least & mask
        j = after[i]
        k = after[i] = after[j]
        put(j, NONE)
        if k < n:
            before[k] = i
            put(i, pair(i, after[k]))
        else:
            put(i, NONE)
        if i:
            put(before[i], pair(before[i], k))
    ids, i = [], 0
    while i < n:
        ids.append(ranks[piece[i:after[i]]])
        i = after[i]
    return ids


class PairRanks:
    """Ranks of neighbouring tokens, for arrays of token ids."""

    def __init__(self, ranks: dict[bytes, int]):
        joined = {(ranks[token[:i]] << 32 | ranks[token[i:]]): rank for token, rank in ranks.items()
                  for i in range(1, len(token)) if token[:i] in ranks and token[i:] in ranks}
        self.keys = np.fromiter(joined, np.int64, len(joined))
        order = np.argsort(self.keys)
        self.keys = np.r_[self.keys[order], np.int64(NONE)]
        self.found = np.r_[np.fromiter(joined.values(), np.int64, len(joined))[order], np.int64(-1)]
        self.of_byte = np.array([ranks.get(bytes([i]), -1) for i in range(256)], np.int64)

    def __call__(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each joined pair, -1 where the two make no token."""
        keys = left << 32 | right
        at = np.searchsorted(self.keys, keys)
        return np.where(self.keys[at] == keys, self.found[at], -1)


def merge_together(pieces: list[bytes], pairs: PairRanks) -> list[bytes]:
    """``merge`` for pieces that are no tokens and about equally long: row r of ``tree`` is the tree of
    piece r, and each step makes one merge in every piece that still has a pair.

    Returns each piece's ids as little-endian unsigned 32-bit numbers in a row."""
    n = np.array([len(x) for x in pieces], np.int64)
    size = 1 << int(n.max() - 1).bit_length()
    raw = np.zeros((len(pieces), size), np.uint8)
    raw[np.arange(size) < n[:, None]] = np.frombuffer(b"".join(pieces), np.uint8)
    ids = pairs.of_byte[raw]
    starts = np.arange(size) < n[:, None]
    none = np.int64(NONE)

    def values(left, right, place):
        rank = pairs(left, right)
        return np.where(rank < 0, none, rank * size + place)

    tree = np.full((len(pieces), 2 * size), none)
    r, c = np.nonzero(starts[:, 1:])
    tree[r, size + c] = values(ids[r, c], ids[r, c + 1], c)
    level = size >> 1
    while level:
        tree[:, level:2 * level] = np.minimum(tree[:, 2 * level:4 * level:2], tree[:, 2 * level + 1:4 * level:2])
        level >>= 1
    after = np.tile(np.arange(1, size + 1), (len(pieces), 1))
    before = after - 2
    rows = np.flatnonzero(tree[:, 1] != none)
    while len(rows):
        least = tree[rows, 1]
        i, token = least % size, least // size
        j = after[rows, i]
        k = after[rows, j]
        after[rows, i] = k
        ids[rows, i] = token
        starts[rows, j] = False
        tree[rows, size + j] = none
        inner = k < n[rows]
        tree[rows[~inner], size + i[~inner]] = none
        ri, ii, ki = rows[inner], i[inner], k[inner]
        before[ri, ki] = ii
        tree[ri, size + ii] = values(token[inner], ids[ri, ki], ii)
        later = i > 0
        rl, il = rows[later], i[later]
        p = before[rl, il]
        tree[rl, size + p] = values(ids[rl, p], token[later], p)
        changed = np.r_[rows, rows, rl]
        node = np.r_[j, i, p] + size
        while node[0] > 1:
            node >>= 1
            tree[changed, node] = np.minimum(tree[changed, 2 * node], tree[changed, 2 * node + 1])
        rows = rows[tree[rows, 1] != none]
    packed, ends = ids[starts].astype("<u4").tobytes(), (4 * np.cumsum(starts.sum(1))).tolist()
    return [packed[a:b] for a, b in zip([0, *ends], ends)]


class Encoder:
    """Ids of texts by ranks; what short pieces become is remembered, up to a bound."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import regex

        self.ranks, self.pairs, self.pattern = ranks, PairRanks(ranks), regex.compile(pattern)
        self.known: dict[str, bytes] = {}

    def _cut(self, text: str) -> Iterator[str]:
        if len(text) <= 1 << 20:
            return iter(self.pattern.findall(text))
        return (match[0] for match in self.pattern.finditer(text))

    def _learn(self, pieces: list[str]) -> None:
        groups: dict[int, list[tuple[str, bytes]]] = {}
        for piece in pieces:
            raw = piece.encode("utf-8")
            token = self.ranks.get(raw)
            if token is not None:
                self.known[piece] = token.to_bytes(4, "little")
            elif len(raw) > SIDE_BY_SIDE:
                self.known[piece] = np.array(merge(raw, self.ranks), "<u4").tobytes()
            else:
                groups.setdefault((len(raw) - 1).bit_length(), []).append((piece, raw))
        for width, group in groups.items():
            step = max(1, CELLS >> width)
            for at in range(0, len(group), step):
                part = group[at:at + step]
                for (piece, _), ids in zip(part, merge_together([raw for _, raw in part], self.pairs)):
                    self.known[piece] = ids

    def _look_up(self, pieces: list[str], owners: list[tuple[int, int]], out: list[list[bytes]]) -> None:
        if len(self.known) > MEMO:
            self.known.clear()
        new = {piece for piece in pieces if piece not in self.known}
        self._learn(list(new))
        ids, at = self.known.__getitem__, 0
        for i, n in owners:
            out[i].append(b"".join(map(ids, pieces[at:at + n])))
            at += n
        for piece in new:
            if len(piece) > MEMO_CHARS:
                del self.known[piece]

    def ids(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, as little-endian unsigned 32-bit numbers in a row."""
        out: list[list[bytes]] = [[] for _ in texts]
        pieces: list[str] = []
        owners: list[tuple[int, int]] = []
        for i, text in enumerate(texts):
            found = self._cut(text)
            while part := list(islice(found, PIECES - len(pieces))):
                pieces += part
                owners.append((i, len(part)))
                if len(pieces) == PIECES:
                    self._look_up(pieces, owners, out)
                    pieces, owners = [], []
        self._look_up(pieces, owners, out)
        return [b"".join(x) for x in out]


@functools.cache
def rank_encoder(path: str, pattern: str) -> Encoder:
    """Kept for the life of a Python worker."""
    return Encoder(read_json_ranks(path) if path.endswith(".json") else read_ranks(path), pattern)


def encode_texts(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """(doc_id, ids): the ids of every whole text, as little-endian unsigned 32-bit numbers in a row.

    A null or empty text has no ids; a null doc_id stays null; repeated rows are encoded one by
    one; other columns, whatever their names, are ignored; no rows give no rows.  A very long text
    is held by one task, together with a few numbers for each byte of its longest piece.
    """
    @lean
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = rank_encoder(path, pattern).ids
        for batch in batches:
            ids = encode(["" if pd.isna(text) else text for text in batch["text"]])
            yield pd.DataFrame({"doc_id": batch["doc_id"].astype("Int64"), "ids": ids})

    return docs.select("doc_id", "text").mapInPandas(run, "doc_id long, ids binary")


@functools.cache
def token_bytes(path: str) -> dict[int, bytes]:
    return {rank: token for token, rank in read_ranks(path).items()}


def decode_ids(encoded: DataFrame, path: str) -> DataFrame:
    """(doc_id, ids, bytes): what the ids of ``encode_texts`` stand for.

    Null ids give null bytes, no ids give no bytes, an id that the file does not hold is an error.
    """
    @lean
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        token = token_bytes(path).__getitem__
        for batch in batches:
            decoded = []
            for packed in batch["ids"]:
                ids = array("I", packed or b"")
                if sys.byteorder == "big":
                    ids.byteswap()
                decoded.append(None if packed is None else b"".join(map(token, ids)))
            yield batch.assign(doc_id=batch["doc_id"].astype("Int64"), bytes=decoded)

    return encoded.select("doc_id", "ids").mapInPandas(run, "doc_id long, ids binary, bytes binary")
