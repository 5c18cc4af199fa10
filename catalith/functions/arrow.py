"""Functions without a built-in form, over Arrow batches: 32-bit mixing hashes, placement, inodes, deep merge."""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StringType

_MASK = np.uint64(0xFFFFFFFF)
#: Seeds of inode, user and group numbers (fixed values).
HIGH_SEED, LOW_SEED, USER_SEED, GROUP_SEED = 0x12345678, 0x9ABCDEF0, 0x55534552, 0x47525550


def _rotated(x: np.ndarray, r: int) -> np.ndarray:
    return ((x << np.uint64(r)) | (x >> np.uint64(32 - r))) & _MASK


def murmur3(keys: list[str], seed: int = 0) -> np.ndarray:
    """MurmurHash3 x86_32 (public domain) of the low bytes of UTF-16 units, for many keys of any lengths at once."""
    data = [bytes(k.encode("utf-16-le", "surrogatepass")[::2]) for k in keys]
    n = np.array([len(x) for x in data], np.uint64)
    width = int(n.max(initial=0)) // 4 * 4 + 4
    rows = np.frombuffer(b"".join(x.ljust(width, b"\0") for x in data), "<u4").reshape(len(data), -1).astype(np.uint64)
    h = np.full(len(data), seed, np.uint64)
    scrambled = lambda k: _rotated(k * np.uint64(0xCC9E2D51) & _MASK, 15) * np.uint64(0x1B873593) & _MASK
    for j in range(rows.shape[1]):
        full, tail = n >= 4 * (j + 1), (n > 4 * j) & (n < 4 * (j + 1))
        mixed = h ^ scrambled(rows[:, j])
        h = np.where(full, (_rotated(mixed, 13) * np.uint64(5) + np.uint64(0xE6546B64)) & _MASK, np.where(tail, mixed, h))
    h ^= n
    h = (h ^ (h >> np.uint64(16))) * np.uint64(0x85EBCA6B) & _MASK
    h = (h ^ (h >> np.uint64(13))) * np.uint64(0xC2B2AE35) & _MASK
    return h ^ (h >> np.uint64(16))


@F.arrow_udf(LongType())
def _murmur(text: pa.Array) -> pa.Array:
    return pa.array(murmur3(text.fill_null("").to_pylist()).astype(np.int64), mask=np.asarray(text.is_null()))


def murmur(text: Column) -> Column:
    return _murmur(text)


def _mixed(h: np.ndarray, k: np.ndarray) -> np.ndarray:
    """A hash with four more bytes, in place; wraps at 32 bits."""
    k *= np.uint32(0xCC9E2D51)
    k = (k << np.uint32(15)) | (k >> np.uint32(17))
    k *= np.uint32(0x1B873593)
    h ^= k
    return h


def _stepped(h: np.ndarray, k: np.ndarray) -> np.ndarray:
    h = _mixed(h, k)
    h = (h << np.uint32(13)) | (h >> np.uint32(19))
    h *= np.uint32(5)
    h += np.uint32(0xE6546B64)
    return h


def _finished(h: np.ndarray, n: np.ndarray) -> np.ndarray:
    h ^= n
    h ^= h >> np.uint32(16)
    h *= np.uint32(0x85EBCA6B)
    h ^= h >> np.uint32(13)
    h *= np.uint32(0xC2B2AE35)
    h ^= h >> np.uint32(16)
    return h


def _best(data: np.ndarray, at: np.ndarray, shards: list[int]) -> np.ndarray:
    """The shard of each beginning of a key, ``data[at[i]:at[i + 1]]``; the whole blocks of a beginning are hashed once for all shards."""
    n = np.diff(at)
    order = np.argsort(n, kind="stable")
    out = np.empty(len(n), np.int64)
    edges = np.flatnonzero(np.diff(n[order], prepend=-1))
    for a, b in zip(edges.tolist(), [*edges[1:].tolist(), len(n)], strict=True):
        for rows in (order[k : min(k + 4096, b)] for k in range(a, b, 4096)):
            size = int(n[rows[0]])
            whole, rest = size // 4, size % 4
            text = data[at[rows][:, None] + np.arange(size)]
            words = np.ascontiguousarray(text[:, : 4 * whole]).view("<u4")
            h = np.zeros(len(rows), np.uint32)
            for j in range(whole):
                h = _stepped(h, words[:, j].copy())
            last = np.zeros(len(rows), np.uint64)
            for j in range(rest):
                last |= text[:, 4 * whole + j].astype(np.uint64) << np.uint64(8 * j)
            best, top = np.full(len(rows), -1, np.int64), np.full(len(rows), -1, np.int64)
            for s in shards:
                digits = str(s).encode()
                tail, g = last, h.copy()
                for pos in range(0, len(digits), 4):
                    # At most three bytes wait, and four are added: seven, of one word.
                    part = digits[pos : pos + 4]
                    tail = tail | np.uint64(int.from_bytes(part, "little") << 8 * ((rest + pos) % 4))
                    if rest + min(pos + 4, len(digits)) - (rest + pos) // 4 * 4 >= 4:
                        g, tail = _stepped(g, (tail & _MASK).astype(np.uint32)), tail >> np.uint64(32)
                if (rest + len(digits)) % 4:
                    g = _mixed(g, tail.astype(np.uint32))
                g = _finished(g, np.uint32(size + len(digits))).astype(np.int64)
                better = g > top
                best[better], top[better] = s, g[better]
            out[rows] = best
    return out


def _begun(file: pa.Array, index: pa.Array, user: pa.Array) -> pa.Array:
    """The keys of chunks up to the number of the shard."""
    f, i, u = (x.cast(pa.large_string()) for x in (file, index, user))
    sep, shard, end = (pa.scalar(x, pa.large_string()) for x in (":", "shard", ""))
    return pc.binary_join_element_wise(f, i, shard, u, end, sep, null_handling="replace", null_replacement="None")


def _placed(begun: pa.Array, pool: int, full: frozenset[int]) -> np.ndarray:
    shards = [s for s in range(pool) if s not in full]
    # Keys are hashed by the low bytes of their UTF-16 units.
    if not pc.all(pc.string_is_ascii(begun), min_count=0).as_py():
        begun = pa.array([x.encode("utf-16-le", "surrogatepass")[::2] for x in begun.to_pylist()], pa.large_binary())
    at = np.frombuffer(begun.buffers()[1], np.int64, len(begun) + 1, 8 * begun.offset)
    data = np.frombuffer(begun.buffers()[2], np.uint8) if at[-1] else np.zeros(0, np.uint8)
    return _best(data, at, shards)


def placed(file: list[str], index: list[int], user: list[str], pool: int, full: frozenset[int] = frozenset()) -> np.ndarray:
    """The shard with the greatest hash for each chunk; ties go to the lowest; full ones are skipped; -1 if all are."""
    if not len(file):
        return np.zeros(0, np.int64)
    return _placed(_begun(pa.array(file, pa.string()), pa.array(index, pa.int64()), pa.array(user, pa.string())), pool, full)


def place(file: Column, index: Column, user: Column, pool: int = 32, full: frozenset[int] = frozenset()) -> Column:
    @F.arrow_udf(LongType())
    def run(f: pa.Array, i: pa.Array, u: pa.Array) -> pa.Array:
        return pa.array(_placed(_begun(f, i, u), pool, full) if len(f) else np.zeros(0, np.int64))

    return run(file, index, user)


def _seeded(ident: Column, combine) -> Column:
    @F.arrow_udf(LongType())
    def run(x: pa.Array) -> pa.Array:
        return pa.array(combine(x.fill_null("").to_pylist()), mask=np.asarray(x.is_null()))

    return run(ident)


def inodes(keys: list[str]) -> np.ndarray:
    """53 bits of two hashes: 21 high and 32 low."""
    high, low = murmur3(keys, HIGH_SEED).astype(np.int64), murmur3(keys, LOW_SEED).astype(np.int64)
    return ((high & 0x1FFFFF) << 32) | low


def inode(ident: Column) -> Column:
    """The inode of a file or folder, by its id."""
    return _seeded(ident, inodes)


def user_number(tenant: Column) -> Column:
    """The 32-bit number of a tenant as owner."""
    return _seeded(tenant, lambda keys: murmur3(keys, USER_SEED).astype(np.int64))


def group_number(tenant: Column) -> Column:
    """The 32-bit number of a tenant as group."""
    return _seeded(tenant, lambda keys: murmur3(keys, GROUP_SEED).astype(np.int64))


def peaks(data: bytes, n: int = 96) -> list[float]:
    """The mean distance from silence of each of n equal parts of unsigned 8-bit samples."""
    if not data:
        return [0.0] * n
    x = np.abs((np.frombuffer(data, np.uint8).astype(np.float64) - 128) / 128)
    edges = np.floor(np.arange(n + 1) * (len(x) / n)).astype(np.int64)
    sums = np.concatenate([[0.0], np.cumsum(x)])
    size = np.diff(edges)
    return np.where(size > 0, (sums[edges[1:]] - sums[edges[:-1]]) / np.maximum(size, 1), 0.0).tolist()


def waveform(data: Column, n: int = 96) -> Column:
    """The peaks of sound samples, as an array."""

    @F.arrow_udf(ArrayType(DoubleType()))
    def run(x: pa.Array) -> pa.Array:
        return pa.array([peaks(b or b"", n) for b in x.to_pylist()], pa.list_(pa.float64()))

    return run(data)


def merged(base, patch):
    """JSON merge: null deletes a key, objects merge, all else replaces; nulls inside a new object stay."""
    if not isinstance(base, dict) or not isinstance(patch, dict):
        return patch
    out = dict(base)
    for k, v in patch.items():
        if v is None:
            out.pop(k, None)
        else:
            out[k] = merged(out[k], v) if isinstance(out.get(k), dict) and isinstance(v, dict) else v
    return out


@F.arrow_udf(StringType())
def _deep_merge(base: pa.Array, patch: pa.Array) -> pa.Array:
    def one(b, p):
        try:
            b, p = json.loads(b) if b else {}, json.loads(p) if p else {}
        except ValueError:
            return None
        return json.dumps(merged(b, p), separators=(",", ":"), sort_keys=True)

    return pa.array([one(b, p) for b, p in zip(base.to_pylist(), patch.to_pylist(), strict=True)], pa.string())


def deep_merge(base: Column, patch: Column) -> Column:
    """JSON text, with keys sorted; null if either is no JSON."""
    return _deep_merge(base, patch)


#: Nesting, items of an array, characters of a key, and bytes at most (fixed values).
DEPTH, ITEMS, KEY, BYTES = 10, 1024, 1024, 64 << 10


def invalid_metadata(value, depth: int = 0) -> str | None:
    """What is wrong with decoded metadata, if anything: depth, array length, key length, numbers."""
    if depth > DEPTH:
        return "depth"
    if isinstance(value, float) and not np.isfinite(value):
        return "number"
    if isinstance(value, list):
        return "array" if len(value) > ITEMS else next((e for x in value if (e := invalid_metadata(x, depth + 1))), None)
    if isinstance(value, dict):
        return "key" if any(len(k) > KEY for k in value) else next((e for x in value.values() if (e := invalid_metadata(x, depth + 1))), None)
    return None


def _least_bytes(value) -> int:
    """Bytes that the compact text of a value has at least, as its strings are no shorter there."""
    if isinstance(value, str):
        return len(value) + 2
    if isinstance(value, dict):
        return sum(len(k) + 3 + _least_bytes(v) for k, v in value.items())
    return sum(map(_least_bytes, value)) if isinstance(value, list) else 1


def _too_large(text: str, value) -> bool:
    """Whether the compact text is beyond the limit; it is only made where neither bound tells.

    Only numbers grow when written again, ``1e5`` to ``100000.0``: eightfold at most.
    """
    if 8 * (len(text) if text.isascii() else len(text.encode("utf-8", "surrogatepass"))) <= BYTES:
        return False
    return _least_bytes(value) > BYTES or len(json.dumps(value, separators=(",", ":"), ensure_ascii=False).encode()) > BYTES


@F.arrow_udf(StringType())
def _metadata_error(text: pa.Array) -> pa.Array:
    def one(t):
        try:
            value = json.loads(t)
        except (ValueError, RecursionError):
            return "json"
        if not isinstance(value, dict):
            return "root"
        return invalid_metadata(value) or ("size" if _too_large(t, value) else None)

    return pa.array([None if t is None else one(t) for t in text.to_pylist()], pa.string())


def metadata_error(text: Column) -> Column:
    """What is wrong with metadata as JSON text: json, root (no object), depth, number, array, key or size; null for what is right."""
    return _metadata_error(text)
