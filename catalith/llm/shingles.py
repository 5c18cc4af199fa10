"""Word shingles of whole Arrow batches, hashed with vectorised byte arithmetic.

A-Z are lower-cased, words are maximal runs of bytes that are not white space,
a shingle is five consecutive words, and a text of one to four words is one
shingle as a whole.  Words are hashed eight bytes at a time, each through a
bijection that spreads every bit; words of over LONG bytes by xxHash.  No Python
object is made for a shorter word.  Shingles are 64-bit hashes of their words'.
Two different shingles share a hash with probability 2**-64 about, which is the
only inexactness of what is built on them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash

WIDTH = 5
_U = np.uint64
_rng = np.random.default_rng(20240501)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32  # A-Z count as a-z
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_PLACES = _rng.integers(0, 2**64, WIDTH, dtype=np.uint64) | _U(1)
_SEED = _U(0x51AF5B1D9C8E7F3B)
#: For n bytes of eight, the first n in the order of memory.
_MASKS = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)
#: Bytes that are hashed at once (a longer text is a piece of its own); bytes of a word from which on it is hashed by itself.
PIECE, LONG = 1 << 20, 64


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and where each text begins; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.fill_null("").cast(pa.large_string())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    return (np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)), at


def word_hashes(data: np.ndarray, at: np.ndarray, between: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray]:
    """Of texts ``data[at[i]:at[i + 1]]``: the hash of every word, and the text it is in; ``between`` tells which bytes are in no word."""
    base, n = int(at[0]), int(at[-1] - at[0])
    if not n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    piece = data[base : base + n]
    gap = np.ones(n + 2, bool)
    gap[1:-1] = between[piece]
    first = ~gap[1:-1] & gap[:-2]
    last = ~gap[1:-1] & gap[2:]
    edges = at[1:-1] - base
    inner = edges[(edges > 0) & (edges < n)]
    first[inner] = ~gap[1 + inner]
    last[inner - 1] = ~gap[inner]
    begin, size = np.flatnonzero(first), np.flatnonzero(last) + 1
    size -= begin
    low = np.zeros(n + 8, np.uint8)
    np.take(_LOWER, piece, out=low[:n])
    eights = np.ndarray(n + 1, "<u8", low, 0, (1,))  # the eight bytes from every place on
    hashes = mix(size.astype(np.uint64) + _SEED)
    hashes = mix(hashes ^ (eights[begin] & _MASKS[np.minimum(size, 8)]))
    rest = np.flatnonzero((size > 8) & (size <= LONG))
    for done in range(8, LONG, 8):
        if not len(rest):
            break
        hashes[rest] = mix(hashes[rest] ^ (eights[begin[rest] + done] & _MASKS[np.minimum(size[rest] - done, 8)]))
        rest = rest[size[rest] > done + 8]
    for k in np.flatnonzero(size > LONG).tolist():
        hashes[k] = xxhash.xxh3_64_intdigest(low[begin[k] : begin[k] + size[k]])
    return hashes, np.searchsorted(at - base, begin, side="right") - 1


def pieces(at: np.ndarray) -> Iterator[tuple[int, int]]:
    """Runs of texts of about PIECE bytes."""
    i, n = 0, len(at) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(at, at[i] + PIECE, side="right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def shingle_sets(column: pa.Array) -> Iterator[tuple[int, int, list[np.ndarray]]]:
    """For runs of texts: where the run begins and ends, and each text's sorted distinct shingle hashes."""
    data, at = text_bytes(column)
    none = np.zeros(0, np.uint64)
    for i, j in pieces(at):
        words, owner = word_hashes(data, at[i : j + 1])
        counts = np.bincount(owner, minlength=j - i) if len(owner) else np.zeros(j - i, np.int64)
        ends = np.cumsum(counts)
        rolled = none
        if len(words) >= WIDTH:
            m = len(words) - WIDTH + 1
            rolled = words[:m] * _PLACES[0]
            for k in range(1, WIDTH):
                rolled = rolled + words[k : m + k] * _PLACES[k]
            rolled = mix(rolled + _U(WIDTH))
        sets = []
        for n, e in zip(counts.tolist(), ends.tolist(), strict=True):
            if n >= WIDTH:
                s = np.sort(rolled[e - n : e - WIDTH + 1])
                if len(s) > 1:
                    new = np.empty(len(s), bool)
                    new[0] = True
                    np.not_equal(s[1:], s[:-1], out=new[1:])
                    if not new.all():
                        s = s[new]
                sets.append(s)
            elif n:
                h = (words[e - n : e] * _PLACES[:n]).sum(dtype=np.uint64) + _U(n)
                sets.append(mix(np.array([h], np.uint64)))
            else:
                sets.append(none)
        yield i, j, sets


def signature(s: np.ndarray) -> int:
    """A 64-bit signature of a sequence of hashes, as a signed number; of a sorted set, one of the set."""
    with np.errstate(over="ignore"):
        h = mix(np.array([mix(s + _U(len(s))).sum(dtype=np.uint64) ^ _U((len(s) * 0xD6E8FEB86659FD93) % 2**64)], np.uint64))
    return int(h.view(np.int64)[0])


def check(s: np.ndarray) -> int:
    """Another signature, of the order too, independent of the first."""
    return xxhash.xxh3_64_intdigest(s) - (1 << 63)
