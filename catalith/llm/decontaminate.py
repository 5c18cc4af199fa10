"""Benchmark decontamination by CGK embeddings and bit-sampling LSH.

A document leaks an item if some stretch of its words is within an edit
distance of a quarter of the item's words.  Words are runs of letters and digits
(any byte beyond ASCII counts as one), ASCII and Latin-1 letters in lower case.

1. A window of an item's size can be that near only if it keeps enough of the
   benchmark's word pairs: one edit destroys two.  Windows with too few are
   left out by prefix sums; no leak is lost by this.
2. CGK: a random walk reads a window's words and moves on or stays by a random
   bit for place and word, so that a small edit distance becomes a small Hamming
   distance of the walks' traces.  Traces of windows and items are hashed on
   sampled places; an item is a candidate if any of the repetitions agrees.  The
   repetitions are as many as edited copies of the items themselves, made by a
   seeded generator with as many edits as are allowed, need to reach the target
   recall.  Where MOST repetitions do not reach it, every window that the pair
   filter leaves is verified instead, so that nothing is lost.
3. Candidates are verified by the exact edit distance of the item to the best
   stretch around the window.

A text of fewer words than an item, but not by more than the allowed edits, has
no window of the item's size: if it keeps enough of the item's word pairs, the
item is verified against the whole text, without LSH.  Items of fewer than LEAST
words are leaked by exact copies only, found by hashes of all windows of their size.

The benchmark is held by every task in blocks of bounded size.  One block, the
usual case, is a projection of the documents in place, without a shuffle, so that
neither sources nor groups of copies make a hot task.  Of more blocks only one is
held at a time: each is run against all texts, the leaks of each text are stored
by the text's hash, and joined to the documents in the end.

Defined results: null and empty texts leak nothing; items without a word (null
and empty ones too) are leaked by none; repeated items each give their own result; an empty benchmark leaves every document clean; other columns
pass through, and a column already named like the output is replaced.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shingles
from .common import stored

#: Edits allowed as a share of an item's words; words of the shortest item that may be edited; bytes of items in a block.
EDITS, LEAST, BLOCK_BYTES = 0.25, 8, 1 << 20
#: LSH: sampled places of a trace, samples of one walk, target recall, edited copies that it is measured on, repetitions at most.
PLACES, SAMPLES, RECALL, COPIES, MOST = 7, 24, 0.995, 512, 480
LEAKS = "array<struct<item_id:long,distance:long,first_word:long,words:long>>"
_ARROW = pa.list_(pa.struct([("item_id", pa.int64()), ("distance", pa.int64()), ("first_word", pa.int64()), ("words", pa.int64())]))
_U = np.uint64
_BETWEEN = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])


def words(column: pa.Array):
    """For runs of texts: the run, its word hashes and the text of each word."""
    data, at = shingles.text_bytes(column)
    for i, j in shingles.pieces(at):
        piece = data[at[i] : at[j]].copy()
        if len(piece) > 1:  # Latin-1 capitals in UTF-8
            second = piece[1:]
            capital = (piece[:-1] == 0xC3) & (second >= 0x80) & (second <= 0x9E) & (second != 0x97)
            second[capital] += 0x20
        yield i, j, *shingles.word_hashes(piece, at[i : j + 1] - at[i], _BETWEEN)


def distances(items: tuple[np.ndarray, np.ndarray], stretches: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For rows of items and of stretches: the least edit distance of the item to a part of the stretch, and that part's begin and end."""
    (item, sizes), (stretch, lengths) = items, stretches
    n, m = stretch.shape
    at, each = np.arange(m + 1), np.arange(n)
    cost, begin = np.zeros((n, m + 1), np.int32), np.tile(at.astype(np.int32), (n, 1))
    out = np.zeros((3, n), np.int64)
    for k in range(1, item.shape[1] + 1):
        best, source = np.empty_like(cost), np.empty_like(begin)
        diagonal, above = cost[:, :-1] + (stretch != item[:, k - 1 : k]), cost[:, 1:] + 1
        best[:, 0], best[:, 1:] = k, np.minimum(diagonal, above)
        source[:, 0], source[:, 1:] = begin[:, 0], np.where(diagonal <= above, begin[:, :-1], begin[:, 1:])
        slope = best - at  # a run of insertions from the left costs one each
        least = np.minimum.accumulate(slope, axis=1)
        new = np.ones((n, m + 1), bool)
        new[:, 1:] = slope[:, 1:] < least[:, :-1]
        origin = np.maximum.accumulate(np.where(new, at, 0), axis=1)
        cost, begin = (least + at).astype(np.int32), np.take_along_axis(source, origin, axis=1)
        if len(done := np.flatnonzero(sizes == k)):
            end = np.argmin(np.where(at <= lengths[done, None], cost[done], 1 << 30), axis=1)
            out[:, done] = cost[done, end], begin[done, end], end
    return out[0], out[1], out[2]


class Embedding:
    """Walks over rows of words, each of its own length, zero beyond it."""

    def __init__(self, repetitions: int, seed: int):
        self.repetitions, self.seed = repetitions, seed
        self.places: dict[int, np.ndarray] = {}

    def sampled(self, size: int) -> np.ndarray:
        """Of traces of rows of a size: the places that each repetition looks at."""
        if size not in self.places:
            rng = np.random.default_rng([self.seed, size])
            self.places[size] = np.sort(np.argsort(rng.random((self.repetitions, 3 * size)), axis=1)[:, :PLACES], axis=1)
        return self.places[size]

    def trace(self, rows: np.ndarray, sizes: np.ndarray, r: int) -> np.ndarray:
        """The trace of walk ``r``: three symbols a word; 0 once the walk has left the row."""
        n, widest = rows.shape
        flat = np.concatenate([rows, np.zeros((n, 1), np.uint64)], axis=1).ravel()
        base = np.arange(n) * (widest + 1)
        place, end = base.copy(), base + sizes
        out = np.empty((3 * widest, n), np.uint64)
        for j in range(3 * widest):
            out[j] = symbol = flat[place]
            bit = shingles.mix(symbol + _U((self.seed + r * 0x9E3779B1 + j * 0x85EBCA77) % 2**64)) >> _U(63)
            place = np.minimum(place + bit.astype(np.int64), end)
        return out

    def keys(self, rows: np.ndarray, sizes: np.ndarray) -> Iterator[np.ndarray]:
        """For each repetition a key of each row: a hash of its size and a walk's trace at places sampled for that size.

        Each walk is sampled SAMPLES times.
        """
        widths, which = np.unique(sizes, return_inverse=True)
        each, sampled = np.arange(len(rows)), np.stack([self.sampled(int(w)) for w in widths], axis=1)
        for r in range(self.repetitions):
            if r % SAMPLES == 0:
                trace = self.trace(rows, sizes, r // SAMPLES)
            places = sampled[r]
            key = sizes.astype(np.uint64) * _U(1 << 20) + _U(r)
            for k in range(PLACES):
                key = shingles.mix(key * _U(0xD6E8FEB86659FD93) + trace[places[which, k], each])
            yield key


def _rows(items: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    sizes = np.array([len(x) for x in items], np.int64)
    rows = np.zeros((len(items), int(sizes.max())), np.uint64)
    for k, x in enumerate(items):
        rows[k, : len(x)] = x
    return rows, sizes


def edited(item: np.ndarray, edits: int, rng: np.random.Generator) -> np.ndarray:
    """A copy with so many random edits, as a window of the item's size."""
    row = item.tolist()
    for _ in range(edits):
        at, kind = int(rng.integers(len(row))), int(rng.integers(3))
        if kind == 0:
            row[at] = int(rng.integers(1, 2**63))
        elif kind == 1:
            row.insert(at, int(rng.integers(1, 2**63)))
        elif len(row) > 1:
            del row[at]
    row += [int(x) for x in rng.integers(1, 2**63, max(0, len(item) - len(row)))]
    return np.array(row[: len(item)], np.uint64)


def repetitions(items: list[np.ndarray], recall: float = RECALL, seed: int = 11, copies: int = COPIES, most: int = MOST) -> int | None:
    """The least number of repetitions by which the wanted share of edited copies has met its item; None if ``most`` are too few.

    Copies carry as many edits as are allowed; they are made of evenly spaced items.
    """
    rng, chosen = np.random.default_rng(seed), [items[k * len(items) // copies] for k in range(copies)]
    e, own = Embedding(most, seed), _rows(chosen)
    other = _rows([edited(x, int(EDITS * len(x)), rng) for x in chosen])
    met = np.zeros(copies, bool)
    for r, (x, y) in enumerate(zip(e.keys(*own), e.keys(*other), strict=True)):
        met |= x == y
        if met.mean() >= recall:
            return r + 1
    return None


class Index:
    """A block of the benchmark: its words and word pairs, and the LSH tables of its items by size."""

    def __init__(self, ids: list[int], texts: list[str | None], seed: int = 11):
        found: list[tuple[int, np.ndarray]] = []
        self.short: dict[int, dict[bytes, list[int]]] = {}
        for i, j, hashes, owner in words(pa.array(texts, pa.string())):
            for k in range(i, j):
                if len(item := hashes[owner == k - i]) >= LEAST:
                    found.append((ids[k], item))
                elif len(item):
                    self.short.setdefault(len(item), {}).setdefault(item.tobytes(), []).append(ids[k])
        self.short_keys = {n: np.unique(_hashed(np.stack([np.frombuffer(x, np.uint64) for x in of]))) for n, of in self.short.items()}
        self.items = found
        needed = repetitions([x for _, x in found], seed=seed) if found else 0
        self.exhaustive = needed is None
        self.embedding = Embedding(needed or 0, seed)
        # The benchmark's word pairs and, for each, the items that have it.
        pairs = [_pairs(x) for _, x in found]
        every = np.concatenate(pairs) if pairs else np.zeros(0, np.uint64)
        both = np.unique(np.stack([every, np.repeat(np.arange(len(found)), [len(x) for x in pairs]).astype(np.uint64)]), axis=1) if pairs else np.zeros((2, 0), np.uint64)
        self.pairs, begin = np.unique(both[0], return_index=True)
        self.begin, self.owners = np.append(begin, both.shape[1]), both[1].astype(np.int64)
        self.hit = np.zeros(1 << 20, bool)
        self.hit[(self.pairs >> _U(44)).astype(np.int64)] = True
        self.rows, self.sizes = _rows([x for _, x in found]) if found else (np.zeros((0, 0), np.uint64), np.zeros(0, np.int64))
        # The LSH tables as one: keys in order, and the items of each.
        keys = np.concatenate([np.zeros(0, np.uint64), *(self.embedding.keys(self.rows, self.sizes) if found else ())])
        order = np.argsort(keys, kind="stable")
        self.known, first = np.unique(keys[order], return_index=True)
        self.known_begin, self.known_items = np.append(first, len(keys)), order % max(1, len(found))
        self.repeated = np.array([len(x) - len(np.unique(x)) for x in pairs], np.int64)

    def shared(self, p: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The items' word pairs in texts, as (item, place), by item and place; ``p`` are the pairs of the texts."""
        maybe = np.flatnonzero(self.hit[(p >> _U(44)).astype(np.int64)] & (owner[1:] == owner[:-1]))
        at = np.minimum(np.searchsorted(self.pairs, p[maybe]), len(self.pairs) - 1)
        real = self.pairs[at] == p[maybe]
        maybe, at = maybe[real], at[real]
        often = self.begin[at + 1] - self.begin[at]
        place = np.repeat(maybe, often)
        item = self.owners[_ranges(self.begin[at], often)]
        order = np.argsort(item, kind="stable")
        return item[order], place[order]

    def whole(self, p: np.ndarray, owner: np.ndarray, item: np.ndarray, place: np.ndarray) -> np.ndarray:
        """Pairs (item, text): texts that are shorter than an item by no more than the allowed edits, and have enough of its word pairs."""
        text = owner[place]
        size, length = self.sizes[item], np.bincount(owner)[text]
        ok = (length < size) & (length >= size - (EDITS * size).astype(np.int64))
        if not ok.any():
            return np.zeros((2, 0), np.int64)
        # Each different pair of the item counts once, and repeated ones of the item count in full.
        different = np.unique(np.stack([item[ok], text[ok], p[place[ok]].view(np.int64)]), axis=1)
        (item, text), count = np.unique(different[:2], axis=1, return_counts=True)
        size = self.sizes[item]
        ok = count + self.repeated[item] >= np.maximum(1, size - 1 - 2 * (EDITS * size).astype(np.int64))
        return np.stack([item[ok], text[ok]])

    def windows(self, p: np.ndarray, owner: np.ndarray, item: np.ndarray, place: np.ndarray) -> np.ndarray:
        """Pairs (item, start) of windows of an item's size, inside one text, that have enough of its word pairs.

        Pairs are counted at every place, and each different one once; then repeated ones of the item count in full.
        """
        order = np.lexsort((place, p[place], item))
        item, place = item[order], place[order]
        size = self.sizes[item]
        # A pair at x is in the windows that start in [x - size + 2, x], and the first of its kind in those that start after the one before it.
        first = place - size + 2
        before = np.full(len(item), -1 << 40)
        before[1:] = np.where((item[1:] == item[:-1]) & (p[place[1:]] == p[place[:-1]]), place[:-1], -1 << 40)
        shift = int(self.sizes.max())
        key = lambda at: item * (len(owner) + 2 * shift) + at + shift
        keys = np.concatenate([key(first), key(np.maximum(first, before + 1)), key(place + 1)])
        zero, one = np.zeros(len(item), np.int64), np.ones(len(item), np.int64)
        order = np.argsort(keys, kind="stable")
        keys = keys[order]
        every = np.cumsum(np.concatenate([one, zero, -one])[order])
        different = np.cumsum(np.concatenate([zero, one, -one])[order])
        of, start = np.divmod(keys[:-1], len(owner) + 2 * shift)
        count = np.diff(keys)
        need = np.maximum(1, self.sizes[of] - 1 - 2 * (EDITS * self.sizes[of]).astype(np.int64))
        ok = (count > 0) & (every[:-1] >= need) & (different[:-1] + self.repeated[of] >= need)
        of, start, count = of[ok], start[ok] - shift, count[ok]
        item, start = np.repeat(of, count), _ranges(start, count)
        size = self.sizes[item]
        ok = (start >= 0) & (start + size <= len(owner))
        item, start, size = item[ok], start[ok], size[ok]
        ok = owner[start] == owner[start + size - 1]
        return np.stack([item[ok], start[ok]])

    def candidates(self, rows: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Pairs (item, window) that share a key of some repetition."""
        found, fresh, size = np.zeros(0, np.int64), [], 0
        for keys in self.embedding.keys(rows, sizes):
            at = np.minimum(np.searchsorted(self.known, keys), len(self.known) - 1)
            window = np.flatnonzero(self.known[at] == keys)
            begin = self.known_begin[at[window]]
            often = self.known_begin[at[window] + 1] - begin
            fresh.append(self.known_items[_ranges(begin, often)] * len(rows) + np.repeat(window, often))
            size += len(fresh[-1])
            if size > 1 << 20:
                found, fresh, size = np.unique(np.concatenate([found, *fresh])), [], 0
        found = np.unique(np.concatenate([found, *fresh]))
        return np.stack(np.divmod(found, len(rows)), axis=1)

    def copies(self, hashes: np.ndarray, owner: np.ndarray) -> Iterator[tuple[int, dict]]:
        """Exact copies of the items of fewer than LEAST words: the text and its leak, at the first place."""
        for n, of in self.short.items():
            if len(hashes) < n:
                continue
            view = np.lib.stride_tricks.sliding_window_view(hashes, n)
            known, keys = self.short_keys[n], _hashed(view)
            at = np.flatnonzero((owner[: len(view)] == owner[n - 1 :]) & (known[np.minimum(np.searchsorted(known, keys), len(known) - 1)] == keys))
            seen: set[tuple[int, bytes]] = set()
            for start in at.tolist():
                doc, row = int(owner[start]), view[start].tobytes()
                if row in of and (doc, row) not in seen:
                    seen.add((doc, row))
                    first = int(np.searchsorted(owner, doc))
                    for item_id in of[row]:
                        yield doc, {"item_id": item_id, "distance": 0, "first_word": start - first, "words": n}

    def search(self, column: pa.Array) -> list[list[dict]]:
        """The leaks of every text, one for each item: short items first, then by item."""
        out: list[list[dict]] = [[] for _ in range(len(column))]
        windows, stretches, places, direct = [], [], [], []
        for i, _, hashes, owner in words(column) if self.items or self.short else ():
            for doc, leak in self.copies(hashes, owner):
                out[i + doc].append(leak)
            if not self.items or len(hashes) < 2:
                continue
            p = _pairs(hashes)
            item, place = self.shared(p, owner)
            for k, doc in self.whole(p, owner, item, place).T.tolist():
                direct.append((k, len(stretches)))
                stretches.append(hashes[slice(*np.searchsorted(owner, [doc, doc + 1]))])
                places.append((i + doc, 0))
            item, start = self.windows(p, owner, item, place)
            several, which = np.unique(np.stack([self.sizes[item], start]), axis=1, return_inverse=True)
            if self.exhaustive:
                direct += zip(item.tolist(), (len(stretches) + which.ravel()).tolist(), strict=True)
            for size, start in several.T.tolist():
                doc, slack = int(owner[start]), int(EDITS * size)
                first = int(np.searchsorted(owner, doc))
                lo, hi = max(first, start - slack), min(int(np.searchsorted(owner, doc, side="right")), start + size + slack)
                windows.append((len(stretches), hashes[start : start + size]))
                stretches.append(hashes[lo:hi])
                places.append((i + doc, lo - first))
        found: dict[tuple[int, int], tuple] = {}
        pairs = np.array(direct, np.int64).reshape(-1, 2)
        if windows and not self.exhaustive:
            met = self.candidates(*_rows([x for _, x in windows]))
            met[:, 1] = np.array([w for w, _ in windows])[met[:, 1]]
            pairs = np.concatenate([pairs, met])
        for c in range(0, len(pairs), 1024):
            item, window = pairs[c : c + 1024].T
            best = distances((self.rows[item], self.sizes[item]), _rows([stretches[w] for w in window.tolist()]))
            for k, w, edits, a, b in zip(item.tolist(), window.tolist(), *(x.tolist() for x in best), strict=True):
                if edits <= int(EDITS * self.sizes[k]):
                    doc, at = places[w]
                    found[doc, k] = min(found.get((doc, k), (edits, at + a, b - a)), (edits, at + a, b - a))
        for (doc, k), (edits, at, n) in sorted(found.items()):
            out[doc].append({"item_id": self.items[k][0], "distance": edits, "first_word": at, "words": n})
        return out


def _ranges(begin: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The numbers of ``range(begin[i], begin[i] + count[i])`` for all i, joined."""
    return np.repeat(begin - np.cumsum(count) + count, count) + np.arange(int(count.sum()))


def _hashed(rows: np.ndarray) -> np.ndarray:
    key = np.zeros(len(rows), np.uint64)
    for k in range(rows.shape[1]):
        key = shingles.mix(key * _U(3) + rows[:, k])
    return key


def _pairs(hashes: np.ndarray) -> np.ndarray:
    return shingles.mix(hashes[:-1] * _U(3) + hashes[1:])


def search(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", out: str = "leaks") -> DataFrame:
    """``docs`` with ``out``: an array of (item_id, distance, first_word, words), never null."""
    spark = docs.sparkSession
    items = benchmark.select(F.col(item_id).cast("long").alias("i"), F.col(item_text).alias("t")).where("t is not null")
    size = items.agg(F.coalesce(F.sum(F.octet_length("t") + 64), F.lit(0))).first()[0]
    blocks = int(size) // BLOCK_BYTES + 1

    def index(k: int):
        block = items.where(F.pmod(F.xxhash64("t"), F.lit(blocks)) == k).orderBy("i", "t").toPandas()
        return spark.sparkContext.broadcast(Index([None if i != i else int(i) for i in block["i"]], block["t"].tolist()))

    if blocks == 1:
        return docs.withColumn(out, _searched(index(0))(F.col(text)))
    key, found = f"__{uuid.uuid4().hex}", None
    for k in range(blocks):
        held = index(k)
        hits = docs.select(F.sha2(text, 256).alias(key), _searched(held)(F.col(text)).alias("leaks")).where(F.size("leaks") > 0)
        hits = stored(hits.groupBy(key).agg(F.first("leaks").alias("leaks")), "leaks")
        found = hits if found is None else found.union(hits)
        held.destroy()
    leaks = found.groupBy(key).agg(F.flatten(F.collect_list("leaks")).alias(f"{key}_leaks"))
    rest = [c for c in docs.columns if c != out]
    joined = docs.withColumn(key, F.sha2(text, 256)).join(leaks, key, "left")
    return joined.withColumn(out, F.coalesce(f"{key}_leaks", F.array().cast(LEAKS))).select(*rest, out)


def _searched(index):
    @F.arrow_udf(LEAKS)
    def found(text: pa.Array) -> pa.Array:
        return pa.array(index.value.search(text), _ARROW)

    return found


def clean(docs: DataFrame, benchmark: DataFrame, text: str = "text", **names) -> DataFrame:
    """The rows of ``docs`` that leak no item, with their columns unchanged."""
    out = "__leaks"
    return search(docs, benchmark, text, out=out, **names).where(F.size(out) == 0).drop(out)
