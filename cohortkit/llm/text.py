"""Words, bytes and hashes of whole texts, in numpy."""

from __future__ import annotations

import ctypes
import functools
from collections.abc import Callable, Iterable, Iterator

import numpy as np

#: Odd, so that it has an inverse modulo 2**64.
BASE = 0x9E3779B97F4A7C15
#: Stretches of bytes are hashed modulo this prime, once for each base.
PRIME = (1 << 31) - 1
BASES = (1_294_871_537, 1_876_104_923)
#: So many powers of each are kept: one table serves all texts up to this size.
KEPT_POWERS = 1 << 19
#: Texts of fewer bytes need no folding before they are summed.
UNFOLDED = 1 << 24
_POWERS: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def quiet(f: Callable) -> Callable:
    """Whole-number overflow is meant."""
    @functools.wraps(f)
    def run(*args, **kwargs):
        with np.errstate(over="ignore"):
            return f(*args, **kwargs)
    return run


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of BASE and of its inverse, modulo 2**64."""
    if len(_POWERS[0]) < n:
        size = max(n, 2 * len(_POWERS[0]), 1 << 16)
        for i, base in enumerate((BASE, pow(BASE, -1, 1 << 64))):
            _POWERS[i] = np.cumprod(np.r_[np.uint64(1), np.full(size - 1, np.uint64(base))], dtype=np.uint64)
    return _POWERS[0][:n], _POWERS[1][:n]


@quiet
def scramble(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads their bits."""
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


@functools.lru_cache(maxsize=2)
def _prime_powers(size: int) -> tuple[tuple[np.ndarray, np.ndarray], ...]:
    """Per base, its first ``size`` (a power of 2) powers and those of its inverse, modulo PRIME."""
    out = []
    for base in BASES:
        pair = []
        for b in (base, pow(base, -1, PRIME)):
            table = np.ones(1, np.uint64)
            while len(table) < size:
                table = np.r_[table, table * np.uint64(pow(b, len(table), PRIME)) % np.uint64(PRIME)]
            pair.append(table)
        out.append(tuple(pair))
    return tuple(out)


def _fold(x: np.ndarray) -> np.ndarray:
    """A smaller number that is the same modulo PRIME; uses up ``x``."""
    high = x >> np.uint64(31)
    x &= np.uint64(PRIME)
    x += high
    return x


def prefix_sums(data: np.ndarray) -> np.ndarray:
    """Sums from which ``span_hashes`` hashes any stretch of ``data`` (bytes): one row for each base."""
    n = len(data)
    sums = np.zeros((len(BASES), n + 1), np.uint64)
    symbols = data.astype(np.uint64) + np.uint64(1)
    for row, (up, _) in zip(sums, _prime_powers(max(KEPT_POWERS, 1 << n.bit_length()))):
        terms = symbols * up[:n]
        # terms are under 2**39, so sums of a short text stay under 2**63; folded ones are under 2**32
        np.cumsum(terms if n < UNFOLDED else _fold(terms), out=row[1:])
    return sums


def span_hashes(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of data[start:end], the same wherever the stretch stands.

    Two polynomials modulo a prime, so that texts built from few patterns do not meet as they
    do modulo a power of two.  (Texts are under 2**30 bytes and a folded difference is under 1.5 * 2**32,
    so its product with a power stays under 2**64.)"""
    n = sums.shape[1] - 1
    whole = np.zeros(len(starts), np.uint64)
    for row, (_, down) in zip(sums, _prime_powers(max(KEPT_POWERS, 1 << n.bit_length()))):
        part = _fold(row[ends] - row[starts])
        part *= down[starts]
        part = _fold(_fold(part))
        part += (part + np.uint64(1)) >> np.uint64(31)   # PRIME itself is 0
        part &= np.uint64(PRIME)
        whole <<= np.uint64(31)
        whole |= part
    return scramble(whole)


@quiet
def quick_hashes(data: np.ndarray, size: int) -> np.ndarray:
    """A hash of every ``size`` bytes in a row, to route by: equal stretches have equal ones, and
    different ones may have."""
    n = len(data)
    up, down = powers(n + 1)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:n], out=sums[1:])
    return scramble((sums[size:] - sums[:n + 1 - size]) * down[:n + 1 - size])


#: Bytes of short texts that are looked at together (longer ones: alone, whole).
CHUNK = 1 << 17
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_PLAIN = np.where(SPACE, np.uint8(32), LOWER)


def distinct(x: np.ndarray) -> np.ndarray:
    """The sorted different values."""
    x = np.sort(x)
    new = np.ones(len(x), bool)
    np.not_equal(x[1:], x[:-1], out=new[1:])
    return x[new]


def _bytes(text: str | bytes | None) -> bytes:
    if isinstance(text, bytes):
        return text
    return (text if isinstance(text, str) else "").encode("utf-8", "surrogatepass")


def chunks(texts: Iterable[str | bytes | None]) -> Iterator[tuple[int, list[bytes]]]:
    """(number of the first, texts as bytes), neighbours together up to ``CHUNK`` bytes."""
    start, held, size = 0, [], 0
    for i, text in enumerate(texts):
        data = _bytes(text)
        if held and size + len(data) > CHUNK:
            yield start, held
            start, held, size = i, [], 0
        held.append(data)
        size += len(data)
    if held:
        yield start, held


def shingle_hashes(texts: list[bytes], n: int) -> list[np.ndarray]:
    """Per text a hash of every n words in a row; of all its words if they are fewer; none without words.

    Words are runs without ASCII white space, A-Z lower-cased; a shingle is its words with one space between."""
    data = _PLAIN[np.frombuffer(b"\n".join(texts), np.uint8)]
    begin = np.cumsum([0, *[len(t) + 1 for t in texts]])
    inside = data != 32
    # of each white space one byte stays, the one before a word
    stay = inside.copy()
    stay[:-1] |= inside[1:]
    place = np.cumsum(np.r_[0, stay])
    data, inside = data[stay], inside[stay]
    starts = np.flatnonzero(inside & ~np.r_[False, inside[:-1]])
    ends = np.flatnonzero(inside & ~np.r_[inside[1:], False]) + 1
    if not len(starts):
        return [starts.astype(np.uint64)] * len(texts)
    # where each text's words begin, and how many words each has
    edge = np.searchsorted(starts, place[np.minimum(begin, len(place) - 1)])
    edge[-1] = len(starts)
    words = np.diff(edge)
    last = np.repeat(edge[1:], words) - 1
    word = np.arange(len(starts))
    first = (word + n - 1 <= last) | (word == np.repeat(edge[:-1], words))
    at = np.flatnonzero(first)
    found = span_hashes(prefix_sums(data), starts[at], ends[np.minimum(at + n - 1, last[at])])
    cuts = np.r_[0, np.cumsum(first)][edge]
    return [found[i:j] for i, j in zip(cuts[:-1].tolist(), cuts[1:].tolist())]


def give_back() -> None:
    """Return unused memory of this process to the system."""
    import pyarrow

    pyarrow.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


_TABLES: list[Callable] = []


def worker_cache(f: Callable) -> Callable:
    """Keep results in a Python worker until it works for another module's operator."""
    cached = functools.cache(f)
    _TABLES.append(cached)
    return cached


def make_room(module: str) -> None:
    """Forget what was kept by ``worker_cache`` for operators of other modules."""
    idle = [f for f in _TABLES if f.__module__ != module and f.cache_info().currsize]
    for f in idle:
        f.cache_clear()
    if idle:
        give_back()


def lean(f: Callable) -> Callable:
    """For functions over a partition's batches: give memory back when the partition is done.

    Python workers are used again by later tasks and would keep the most they ever held."""
    @functools.wraps(f)
    def run(batches: Iterator) -> Iterator:
        make_room(f.__module__)
        yield from f(batches)
        give_back()
    return run
