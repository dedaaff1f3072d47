"""Token counts and best-fit packing of documents into fixed-length sequences."""

from __future__ import annotations

import json
import re
import sys
import zlib
from array import array
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from cohortkit.llm.bpe import read_json_ranks
from cohortkit.llm.text import lean, worker_cache
from cohortkit.session import checkpoint

PIECE_SCHEMA = "doc_id long, piece int, start long, length long, ids_crc32 long"
PACKED_SCHEMA = PIECE_SCHEMA + ", sequence_id long, offset long"


# the pre-token rule of byte-level BPE files of this family (fixed value)
RULE = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


#: White space in a row that is left to ``tokenizers``: its pattern engine does not recurse.
LONG_SPACE = re.compile(r"\s{10000}")


@worker_cache
def encoder(path: str) -> Callable[[str], list[int]]:
    """Ids of a text by a byte-level BPE file of the ``tokenizers`` library, with its default reading of
    control words: their strings in a text are their ids.

    The file's vocabulary is handed to ``tiktoken`` as ranks: the ids are the same (the tests
    compare them) at four times the speed.  Kept in a Python worker while it packs; the library's own
    tokenizer, which takes several times the memory, is read where a text needs it.
    """
    import tiktoken

    with open(path, encoding="utf-8") as f:
        special = {t["content"]: t["id"] for t in json.load(f)["added_tokens"]}
    fast = tiktoken.Encoding("file", pat_str=RULE, mergeable_ranks=read_json_ranks(path), special_tokens=special)

    def encode(text: str) -> list[int]:
        if LONG_SPACE.search(text):
            return plain_tokenizer(path).encode(text, add_special_tokens=False).ids
        return fast.encode(text, allowed_special="all")

    return encode


@worker_cache
def plain_tokenizer(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def pieces(docs: DataFrame, path: str, size: int = 2048, end_id: int = 0) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): every document's ids and ``end_id``, cut to
    pieces of ``size`` ids if longer; the first piece takes what does not fill one.

    A null text reads as empty (one id); a null doc_id stays null; repeated rows are pieces of
    their own; other columns are ignored.
    """
    @lean
    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = encoder(path)
        for batch in batches:
            rows = []
            for doc, text in zip(batch["doc_id"], batch["text"]):
                ids = array("I", encode(text or ""))
                ids.append(end_id)
                if sys.byteorder == "big":
                    ids.byteswap()
                ids = ids.tobytes()
                n = len(ids) // 4
                first = n if n <= size else n % size or size
                edges = [0, *range(first, n + 1, size)]
                doc = None if pd.isna(doc) else int(doc)
                rows += [(doc, i, a, b - a, zlib.crc32(ids[4 * a:4 * b]))
                         for i, (a, b) in enumerate(zip(edges, edges[1:]))]
            out = pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids_crc32"])
            yield out.astype({"doc_id": "Int64", "piece": "int32"})

    return docs.select("doc_id", "text").mapInPandas(cut, PIECE_SCHEMA)


class OpenBins:
    """A fixed number of open bins in a bitset keyed by free space.

    An item goes to the bin with the least room that takes it.  When a new bin is needed and
    all are open, the fullest one closes.
    """

    def __init__(self, size: int, most: int, first_id: int):
        self.size, self.most, self.next_id, self.open = size, most, first_id, 0
        self.bits, self.at = 0, [[] for _ in range(size + 1)]

    def _take(self, free: int) -> int:
        stack = self.at[free]
        found = stack.pop()
        if not stack:
            self.bits ^= 1 << free
        return found

    def place(self, length: int) -> tuple[int, int]:
        """(bin, offset) for an item."""
        fit = self.bits >> length
        if fit:
            free = length + (fit & -fit).bit_length() - 1
            bin_id = self._take(free)
        else:
            if self.open == self.most:
                self._take((self.bits & -self.bits).bit_length() - 1)
                self.open -= 1
            free, bin_id = self.size, self.next_id
            self.next_id += 1
            self.open += 1
        left = free - length
        if left:
            self.at[left].append(bin_id)
            self.bits |= 1 << left
        else:
            self.open -= 1
        return bin_id, self.size - free


def pack(parts: DataFrame, size: int = 2048, open_bins: int = 1 << 14, group: int = 1 << 15) -> DataFrame:
    """Add (sequence_id, offset) to the rows of ``pieces``.

    Pieces are spread by hash over groups of about ``group`` pieces (their number is measured,
    so groups stay the same size on any input).  A group arrives longest first and is packed on
    line; a piece's place is known as it arrives, so a task holds only the open bins.  Each
    group ends with a few part-filled sequences, a vanishing share.  An empty table gives none.
    """
    groups = max(1, -(-parts.count() // group))
    spread = parts.withColumn("g", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32", "start"), F.lit(groups)))

    @lean
    def fill(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bins, now = None, None
        for batch in batches:
            placed = []
            for g, length in zip(batch["g"].tolist(), batch["length"].tolist()):
                if g != now:
                    bins, now = OpenBins(size, open_bins, g << 32), g
                placed.append(bins.place(length))
            batch = batch.drop(columns="g")
            batch["sequence_id"], batch["offset"] = zip(*placed) if placed else ([], [])
            yield batch.astype({"doc_id": "Int64"})

    return (spread.repartition(groups, "g")
            .sortWithinPartitions("g", F.desc("length"), "doc_id", "piece", "ids_crc32")
            .mapInPandas(fill, PACKED_SCHEMA))


def pack_documents(docs: DataFrame, path: str, size: int = 2048) -> DataFrame:
    """Tokenise, cut and pack all documents.  The pieces are stored once, without their ids."""
    return pack(checkpoint(pieces(docs, path, size)), size)
