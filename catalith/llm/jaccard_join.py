"""N-gram Jaccard join by grouped prefixes.

Two documents link when the Jaccard similarity of their sets of word shingles
is 0.75 or more.  The method:

1. Documents with the same set are one *class*; a class is named by a 64-bit
   signature of its set and size.  Names that two different sets share are found
   by a second signature, and all but one of these sets get another name.
2. Shingles have one global order: ordinary ones by hash, then the most frequent
   ones, the rarest first.  The order decides cost only, never the result, so the
   list of frequent shingles may be bounded.
3. Two sets that link share a shingle of their prefixes in that order.  Classes
   with the same prefix and size are one *group*, and only groups meet: each
   shingle of a group's prefix is a row, rows of one shingle are a *run*, and
   pairs in a run pass size, index-prefix and position filters.
4. Group pairs are expanded to their members, and members are verified by the
   exact intersection of their sets, after a bound from small sketches of them.

The result is connected components, so that not every pair of a large group of
copies has to be verified.  A first round verifies a sparse set of pairs (runs:
neighbours by size and two stars; groups: a star).  A second round verifies every
remaining candidate pair whose members are not connected by then.  No link
between components is lost: a candidate pair is either verified or connected.
In it a run of over BLOCK rows is cut into blocks, and each two blocks are a piece
of work of their own, so that a shingle of very many groups is spread over tasks.

Nothing is collected but the list of frequent shingles (``demoted`` at most) and
a Bloom filter of bounded size, which only saves shuffling.

Defined results: null and empty texts have no shingles and link with nothing;
rows with a null id are linked with nothing and get a null component; rows that
share an id are one document, and reach what either reaches; an empty table
gives an empty table; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shingles
from .common import stored
from .components import components

#: The similarity as a fraction (fixed values).
NUM, DEN = 3, 4
#: At most so many of the most frequent shingles come last in the order.
DEMOTED = 1 << 19
#: Bits of the Bloom filter at most, rows of a run that are held at once, and rows of a block of the second round.
BLOOM_BITS, RUN, BLOCK = 1 << 26, 1 << 17, 1024
_U = np.uint64


def _needed(n1, n2):
    """The least intersection of two sets of these sizes that link."""
    return -(-NUM * (n1 + n2) // (NUM + DEN))


def _prefix(n):
    """Shingles of a set that are compared with sets of any size."""
    return n - -(-NUM * n // DEN) + 1


def _index_prefix(n):
    """Shingles of a set that are compared with sets of its size or larger."""
    return n - _needed(n, n) + 1


def _frequent_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Shingles that two or more different sets of some four million shingles share."""
    held, size, seen = [], 0, set()

    def counted() -> pa.RecordBatch:
        value, count = np.unique(np.concatenate(held), return_counts=True) if held else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
        often = count > 1
        return pa.RecordBatch.from_arrays([pa.array(value[often].view(np.int64)), pa.array(count[often].astype(np.int64))], ["token", "count"])

    for b in batches:
        for _, _, sets in shingles.shingle_sets(b.column(0)):
            for s in sets:
                if len(s) and (name := (len(s), int(s[0]), int(s[-1]))) not in seen:
                    seen.add(name)
                    held.append(s)
                    size += len(s)
            if size > 1 << 22:
                yield counted()
                held, size, seen = [], 0, set()
    yield counted()


def _most_frequent(share: int):
    """Of a partition's shingles with their counts the ``share`` most frequent."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        token, count = np.zeros(0, np.int64), np.zeros(0, np.int64)

        def cut() -> None:
            nonlocal token, count
            best = np.lexsort((token, -count))[:share]
            token, count = token[best], count[best]

        for b in batches:
            token, count = np.concatenate([token, b.column(0).to_numpy()]), np.concatenate([count, b.column(1).to_numpy()])
            if len(token) > 4 * share:
                cut()
        cut()
        yield pa.RecordBatch.from_arrays([pa.array(token), pa.array(count)], ["token", "count"])

    return run


class Order:
    """The global order: ordinary shingles by hash, then the frequent ones in the order given."""

    def __init__(self, frequent: np.ndarray):
        by = np.argsort(frequent)
        self.values, self.ranks = frequent[by], by
        self.hit = np.zeros(1 << 22, bool)
        self.hit[(frequent >> _U(42)).astype(np.int64)] = True

    def prefix(self, s: np.ndarray) -> np.ndarray:
        n = len(s)
        if not n:
            return s
        p = int(_prefix(n))
        if not len(self.values):
            return s[:p]
        maybe = np.flatnonzero(self.hit[(s >> _U(42)).astype(np.int64)])
        if len(maybe):
            at = np.minimum(np.searchsorted(self.values, s[maybe]), len(self.values) - 1)
            real = self.values[at] == s[maybe]
            maybe, at = maybe[real], at[real]
        if not len(maybe):
            return s[:p]
        plain = np.ones(n, bool)
        plain[maybe] = False
        out = s[plain][:p]
        return out if len(out) == p else np.concatenate([out, s[maybe][np.argsort(self.ranks[at])][: p - len(out)]])


def _name(s: np.ndarray, shared: dict[int, dict[int, int]]) -> int:
    """The name of a set; ``shared`` has the other names of sets whose first signature is not theirs alone, by both signatures."""
    sig = shingles.signature(s)
    return shared[sig].get(shingles.check(s), sig) if sig in shared else sig


def _prefix_name(p: np.ndarray) -> bytes:
    """128 bits that name a prefix."""
    return np.array([shingles.signature(p), shingles.check(p)], np.int64).tobytes()


def _described(order: Order):
    """Per row: id, size, two signatures of the set, the name of the prefix, and the sketch: how many shingles begin with each byte, 255 for more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, sig, check, psig, sketch = [], [], [], [], []
            for _, _, sets in shingles.shingle_sets(b.column(1)):
                for s in sets:
                    n.append(len(s))
                    sketch.append(np.minimum(np.bincount((s >> _U(56)).astype(np.int64), minlength=256), 255).astype(np.uint8).tobytes())
                    sig.append(shingles.signature(s))
                    check.append(shingles.check(s))
                    psig.append(_prefix_name(order.prefix(s)))
            ints = [pa.array(c, pa.int64()) for c in (n, sig, check)]
            yield pa.RecordBatch.from_arrays([b.column(0), *ints, pa.array(psig, pa.binary()), pa.array(sketch, pa.binary())], ["doc_id", "n", "sig", "check", "psig", "sketch"])

    return run


def _prefixes(order: Order, shared: dict[int, dict[int, int]]):
    """Per set: size, name, the prefix's name, and the prefix as bytes; of equal sets of a batch one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: dict[int, tuple] = {}
            for _, _, sets in shingles.shingle_sets(b.column(0)):
                for s in sets:
                    if len(s) and (sig := _name(s, shared)) not in out:
                        p = order.prefix(s)
                        out[sig] = (len(s), sig, _prefix_name(p), p.tobytes())
            cols = list(zip(*out.values(), strict=True)) or [(), (), (), ()]
            types = (pa.int64(), pa.int64(), pa.binary(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], ["n", "sig", "psig", "prefix"])

    return run


def _prefix_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each shingle of a group's prefix: shingle, group, size << 32 | position."""
    for b in batches:
        gid, n, blobs = b.column(0).to_numpy(), b.column(1).to_numpy(), b.column(2)
        for i in range(0, len(gid), 2048):
            parts = [np.frombuffer(x, np.int64) for x in blobs.slice(i, 2048).to_pylist()]
            sizes = np.array([len(x) for x in parts], np.int64)
            if not sizes.sum():
                continue
            at = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(parts)), pa.array(np.repeat(gid[i : i + 2048], sizes)), pa.array(np.repeat(n[i : i + 2048] << 32, sizes) | at)], ["token", "gid", "meta"]
            )


def _passes(meta1: np.ndarray, meta2: np.ndarray) -> np.ndarray:
    """Whether a pair that shares a shingle can still link, judged by sizes and the shingle's positions (the first is not the larger set)."""
    n1, n2, p1, p2 = meta1 >> 32, meta2 >> 32, meta1 & 0xFFFFFFFF, meta2 & 0xFFFFFFFF
    return (DEN * n1 >= NUM * n2) & (p1 < _index_prefix(n1)) & (np.minimum(n1 - p1, n2 - p2) >= _needed(n1, n2))


def _runs(batches: Iterator[pa.RecordBatch], columns: int) -> Iterator[tuple[list[np.ndarray], np.ndarray, bool]]:
    """Rows sorted by their first column, as arrays that end where a run ends, with the index of each row's run's beginning, and whether the first run goes on from the part before.

    A run of over RUN rows is given in parts; each later part begins with the
    run's first row and the last row of the part before.
    """
    held: list[np.ndarray] | None = None
    continued = False
    for b in batches:
        cols = [b.column(k).to_numpy() for k in range(columns)]
        if not len(cols[0]):
            continue
        held = cols if held is None else [np.concatenate(x) for x in zip(held, cols, strict=True)]
        cut = int(np.flatnonzero(held[0] != held[0][-1])[-1]) + 1 if held[0][0] != held[0][-1] else 0
        if cut:
            yield *_begun([x[:cut] for x in held]), continued
            held, continued = [x[cut:] for x in held], False
        if len(held[0]) > RUN:
            yield *_begun(held), continued
            held, continued = [x[[0, -1]] for x in held], True
    if held is not None:
        yield *_begun(held), continued


def _begun(cols: list[np.ndarray]) -> tuple[list[np.ndarray], np.ndarray]:
    new = np.ones(len(cols[0]), bool)
    new[1:] = cols[0][1:] != cols[0][:-1]
    return cols, np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))


def _sparse_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of runs sorted by size: pairs of neighbours, of next but one, and of each with the first of about its size.

    For runs of over three rows these are not all pairs; their rows are given too (``meta`` not null).
    """
    for (token, gid, meta), begin, continued in _runs(batches, 3):
        i = np.arange(len(token))
        kind = np.floor(np.log(np.maximum(meta >> 32, 1)) / np.log(1.15)).astype(np.int64)
        new = begin == i
        new[1:] |= kind[1:] != kind[:-1]
        star = np.maximum.accumulate(np.where(new, i, 0))
        pairs = []
        for other in (i - 1, i - 2, star):
            ok = np.flatnonzero((other >= begin) & (other < i))
            ok = ok[_passes(meta[other[ok]], meta[ok])]
            pairs.append(np.stack([gid[other[ok]], gid[ok]]))
        a, b = np.concatenate(pairs, axis=1)
        if len(a):
            a, b = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)]), axis=1) if len(a) < 1 << 16 else (np.minimum(a, b), np.maximum(a, b))
        long = np.bincount(begin, minlength=len(i))[begin] > 3
        if continued:
            long |= begin == 0
        none = pa.nulls(len(a), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), none], ["a", "b", "meta"])
        yield pa.RecordBatch.from_arrays([pa.array(token[long]), pa.array(gid[long]), pa.array(meta[long])], ["a", "b", "meta"])


def _blocks(rows: DataFrame, block: int = BLOCK) -> DataFrame:
    """Rows (token, gid, meta, comp) of runs as ``token, x, y, side, gid, meta, comp``, a piece of work for each two blocks x <= y of a run.

    A run of n rows has n / block blocks, dealt by hash; each row is in as many
    pieces, and all rows of a piece of two different blocks know their side.
    """
    blocks = rows.groupBy("token").agg(F.ceil(F.count("*") / block).cast("int").alias("k"))
    each = rows.join(blocks, "token").withColumn("own", F.pmod(F.xxhash64("gid"), F.col("k")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("k") - 1)))
    return each.select("token", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"), (F.col("own") > F.col("other")).cast("int").alias("side"), "gid", "meta", "comp")


def _cross_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of pieces of runs (see _blocks), sorted by size: every passing pair of different components, of different sides in a piece of two blocks."""
    tail: list[np.ndarray] | None = None

    def of_piece(two, side, gid, meta, comp):
        n, out, size = meta >> 32, [], 0
        until = np.searchsorted(n, DEN * n // NUM, side="right")
        for i in range(len(gid)):
            j = np.arange(i + 1, until[i])
            j = j[(comp[j] != comp[i]) & ((side[j] != side[i]) | (not two))]
            j = j[_passes(np.full(len(j), meta[i]), meta[j])]
            if len(j):
                out.append(np.stack([np.full(len(j), gid[i]), gid[j]]))
                size += len(j)
            if size > 1 << 16:
                yield np.concatenate(out, axis=1)
                out, size = [], 0
        if out:
            yield np.concatenate(out, axis=1)

    def of_rows(cols):
        new = np.ones(len(cols[0]), bool)
        new[1:] = np.any([c[1:] != c[:-1] for c in cols[:3]], axis=0)
        edges = [*np.flatnonzero(new).tolist(), len(new)]
        for s, e in zip(edges, edges[1:], strict=False):
            for a, b in of_piece(cols[1][s] != cols[2][s], *(c[s:e] for c in cols[3:])):
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])

    for batch in batches:
        cols = [batch.column(k).to_numpy() for k in range(7)]
        if not len(cols[0]):
            continue
        cols = cols if tail is None else [np.concatenate(x) for x in zip(tail, cols, strict=True)]
        other = np.flatnonzero(np.any([c != c[-1] for c in cols[:3]], axis=0))
        cut = int(other[-1]) + 1 if len(other) else 0
        yield from of_rows([x[:cut] for x in cols])
        tail = [x[cut:] for x in cols]
    if tail is not None:
        yield from of_rows(tail)


def _bloom_words(bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            h = _bloom_at(b.column(0).to_numpy(), bits)
            word, bit = (h >> 6), np.left_shift(np.int64(1), h & 63)
            order = np.argsort(word, kind="stable")
            word, bit = word[order], bit[order]
            begin = np.flatnonzero(np.r_[True, word[1:] != word[:-1]]) if len(word) else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(word[begin]), pa.array(np.bitwise_or.reduceat(bit, begin) if len(word) else bit)], ["word", "bits"])

    return run


def _bloom_at(sig: np.ndarray, bits: int) -> np.ndarray:
    return (shingles.mix(sig.view(np.uint64) + _U(77)) >> _U(64 - bits.bit_length() + 1)).astype(np.int64)


def _set_rows(bitmap: np.ndarray, bits: int, shared: dict[int, dict[int, int]]):
    """The sets that the Bloom filter lets through, as bytes; of equal sets of a batch one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = {}
            for _, _, sets in shingles.shingle_sets(b.column(0)):
                sigs = np.array([_name(s, shared) for s in sets], np.int64)
                h = _bloom_at(sigs, bits)
                for k in np.flatnonzero((bitmap[h >> 6] >> (h & 63)) & 1).tolist():
                    if len(sets[k]):
                        out[int(sigs[k])] = sets[k]
            yield pa.RecordBatch.from_arrays([pa.array(list(out), pa.int64()), pa.array([s.tobytes() for s in out.values()], pa.binary())], ["sig", "tokens"])

    return run


def _sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs (a, b, sizes, sketches) whose sketches allow an intersection that links: it is at most the sum of the least counts."""
    for batch in batches:
        for i in range(0, batch.num_rows, 8192):
            part = batch.slice(i, 8192)
            n1, n2 = part.column(2).to_numpy(), part.column(3).to_numpy()
            x, y = (np.frombuffer(b"".join(part.column(k).to_pylist()), np.uint8).reshape(-1, 256) for k in (4, 5))
            least = np.minimum(x, y)
            ok = (least.sum(axis=1, dtype=np.int64) >= _needed(n1, n2)) | (least == 255).any(axis=1)
            yield part.select([0, 1]).filter(pa.array(ok))


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs (a, b, tokens of a, tokens of b) whose sets link."""
    for batch in batches:
        ok = np.zeros(batch.num_rows, bool)
        for k, (x, y) in enumerate(zip(batch.column(2), batch.column(3), strict=True)):
            x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
            both = np.sort(np.concatenate([x, y]), kind="stable")
            ok[k] = int((both[1:] == both[:-1]).sum()) >= _needed(len(x), len(y))
        yield batch.select([0, 1]).filter(pa.array(ok))


def _shared_names(rows: DataFrame) -> dict[int, dict[int, int]]:
    """New names of sets whose first signature another set has too.

    Among n sets n**2 / 2**65 such pairs are to be expected, three of 10**10
    sets: what reaches the driver is a handful at any size, and nothing usually.
    """
    double = rows.where("n > 0").groupBy("sig").agg(F.min("check").alias("lo"), F.max("check").alias("hi")).where("lo < hi")
    out: dict[int, dict[int, int]] = {}
    for sig, check in rows.join(double, "sig").where("check != lo").select("sig", "check").distinct().toLocalIterator():
        out.setdefault(sig, {})[check] = shingles.check(np.array([sig, check], np.int64))
    return out


def _renamed(rows: DataFrame, shared: dict[int, dict[int, int]]) -> DataFrame:
    for sig, names in shared.items():
        for check, name in names.items():
            rows = rows.withColumn("sig", F.when((F.col("sig") == sig) & (F.col("check") == check), F.lit(name)).otherwise(F.col("sig")))
    return rows


def _verify(docs: DataFrame, pairs: DataFrame, sketches: DataFrame, shared: dict[int, dict[int, int]]) -> DataFrame:
    """The pairs ``a, b`` of classes whose sets link; the sketches, a sixteenth of the sets or less, are compared first."""
    spark = docs.sparkSession
    near = lambda of: sketches.select(F.col("sig").alias(of), F.col("n").alias(f"n_{of}"), F.col("sketch").alias(f"s_{of}"))
    pairs = stored(pairs.join(near("b"), "b").join(near("a"), "a").select("a", "b", "n_a", "n_b", "s_a", "s_b").mapInArrow(_sketched, "a long, b long"), "near")
    ids = pairs.select(F.col("a").alias("sig")).union(pairs.select("b"))
    count = pairs.count()
    bits = min(BLOOM_BITS, max(1 << 16, 1 << (32 * count + 1).bit_length()))
    found = ids.mapInArrow(_bloom_words(bits), "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    bitmap = np.zeros(bits // 64, np.int64)
    bitmap[found["word"].to_numpy()] = found["bits"].to_numpy()
    held = spark.sparkContext.broadcast(bitmap)

    def set_rows(batches):
        return _set_rows(held.value, bits, shared)(batches)

    sets = docs.select("text").mapInArrow(set_rows, "sig long, tokens binary").groupBy("sig").agg(F.first("tokens").alias("tokens"))
    right = pairs.join(sets.select(F.col("sig").alias("b"), F.col("tokens").alias("tokens_b")), "b")
    both = right.join(sets.select(F.col("sig").alias("a"), F.col("tokens").alias("tokens_a")), "a").select("a", "b", "tokens_a", "tokens_b")
    return both.mapInArrow(_verified, "a long, b long")


def _paired(df: DataFrame) -> DataFrame:
    return df.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a != b").distinct()


def link(docs: DataFrame, id_column: str = "doc_id", text: str = "text", demoted: int = DEMOTED) -> DataFrame:
    """``doc_id, n_shingles, component_id`` for every row of ``docs``."""
    spark = docs.sparkSession
    docs = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text).alias("text"))
    texts = docs.select("text")

    # Shingles are dealt evenly by hash, so that each partition's share of the most frequent ones makes up the list, without a task that sees them all.
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    counts = texts.mapInArrow(_frequent_counts, "token long, count long").repartition(parts, "token").groupBy("token").agg(F.sum("count").alias("count"))
    top = counts.mapInArrow(_most_frequent(-(-demoted // parts)), "token long, count long").toArrow()
    token, count = top["token"].to_numpy(), top["count"].to_numpy()
    frequent = spark.sparkContext.broadcast(token[np.lexsort((token, -count))[:demoted]][::-1].copy().view(np.uint64))

    def described(batches):
        return _described(Order(frequent.value))(batches)

    rows = stored(docs.mapInArrow(described, "doc_id long, n long, sig long, check long, psig binary, sketch binary"), "sets")
    shared = _shared_names(rows)
    rows = _renamed(rows, shared)

    def prefixes(batches):
        return _prefixes(Order(frequent.value), shared)(batches)

    real = rows.where("n > 0 and doc_id is not null")
    classes = real.groupBy("sig").agg(F.min("doc_id").alias("least"), F.first("n").alias("n"), F.first("psig").alias("psig"))
    sketches = real.groupBy("sig").agg(F.first("n").alias("n"), F.first("sketch").alias("sketch"))
    groups = classes.groupBy("n", "psig").agg(F.min("sig").alias("gid"), F.count("*").alias("members"))
    # Members of groups of two and more, and links by a shared id.
    crowded = groups.where("members > 1").drop("members")
    members = stored(classes.join(crowded, ["n", "psig"]).select("gid", "sig", "n"), "members")
    several = real.groupBy("doc_id").agg(F.min("sig").alias("a"), F.max("sig").alias("z")).where("a < z")
    same_id = real.join(several, "doc_id").select("a", F.col("sig").alias("b"))

    named_texts = docs.where("doc_id is not null").select("text")  # as in classes: a head is a row of its group
    heads = named_texts.mapInArrow(prefixes, "n long, sig long, psig binary, prefix binary").groupBy("n", "psig").agg(F.min("sig").alias("gid"), F.min_by("prefix", "sig").alias("prefix"))
    tokens = heads.select("gid", "n", "prefix").mapInArrow(_prefix_rows, "token long, gid long, meta long")
    runs = tokens.repartition(F.col("token")).sortWithinPartitions("token", F.shiftrightunsigned("meta", 32), "gid")
    found = stored(runs.mapInArrow(_sparse_pairs, "a long, b long, meta long"), "runs")
    group_pairs = stored(_paired(found.where("meta is null")), "group_pairs")
    stars = members.where("gid != sig").select(F.col("gid").alias("a"), F.col("sig").alias("b"))
    # In a long run every group is also paired with the one that has most rows in long runs: of near copies of one text, that text.
    rows_of_runs = found.where("meta is not null").select(F.col("a").alias("token"), F.col("b").alias("gid"), F.shiftright("meta", 32).alias("n")).distinct()
    busy = rows_of_runs.groupBy("gid").agg(F.count("*").alias("runs"))
    weighed = stored(rows_of_runs.join(busy, "gid"), "weighed")
    chief = weighed.groupBy("token").agg(F.max(F.struct("runs", "gid", "n")).alias("top")).select("token", F.col("top.gid").alias("b"), F.col("top.n").alias("m"))
    chiefs = weighed.join(chief, "token").where(F.least("n", "m") * DEN >= F.greatest("n", "m") * NUM).select(F.col("gid").alias("a"), "b")
    first = stored(_paired(group_pairs.union(stars).union(chiefs)), "pairs")
    linked = stored(_verify(docs, first, sketches, shared).union(same_id), "links")

    comp = components(linked)
    named = lambda of: comp.select(F.col("vertex").alias(of), F.col("component").alias(f"c_{of}"))
    with_c = lambda df, of: df.join(named(of), of, "left").withColumn(f"c_{of}", F.coalesce(f"c_{of}", of))
    # Group pairs and groups whose members are not all connected.
    joined = stored(with_c(members, "sig"), "joined")
    split = joined.groupBy("gid").agg(F.min("c_sig").alias("lo"), F.max("c_sig").alias("hi"), F.first("n").alias("n"))
    apart = split.where("lo != hi").select("gid")
    inside = joined.join(apart, "gid").select(F.col("gid").alias("token"), F.col("sig").alias("gid"), F.shiftleft("n", 32).alias("meta"), F.col("c_sig").alias("comp"))
    side = lambda of: split.select(F.col("gid").alias(of), F.col("lo").alias(f"lo_{of}"), F.col("hi").alias(f"hi_{of}"))
    open_pairs = with_c(with_c(group_pairs, "a"), "b").join(side("a"), "a", "left").join(side("b"), "b", "left")
    lo, hi = (lambda of: F.coalesce(f"lo_{of}", f"c_{of}")), (lambda of: F.coalesce(f"hi_{of}", f"c_{of}"))
    open_pairs = open_pairs.where((F.least(lo("a"), lo("b")) != F.greatest(hi("a"), hi("b"))) & (F.col("lo_a").isNotNull() | F.col("lo_b").isNotNull())).select("a", "b")
    # Rows of long runs in which not all groups are connected.
    long = with_c(found.where("meta is not null").select(F.col("a").alias("token"), F.col("b").alias("gid"), "meta"), "gid")
    # A group that is not connected in itself differs from all others in its runs: its members decide.
    long = long.join(apart.withColumn("apart", F.lit(True)), "gid", "left").withColumn("c_gid", F.when(F.col("apart"), F.bitwise_not("gid")).otherwise(F.col("c_gid")))
    mixed = long.groupBy("token").agg(F.min("c_gid").alias("lo"), F.max("c_gid").alias("hi")).where("lo != hi").select("token")
    rest = long.join(mixed, "token").select("token", "gid", "meta", F.col("c_gid").alias("comp")).distinct()
    cross = lambda df: _blocks(df).repartition("token", "x", "y").sortWithinPartitions("token", "x", "y", F.shiftrightunsigned("meta", 32), "gid").mapInArrow(_cross_pairs, "a long, b long")
    more_groups = stored(_paired(cross(rest).union(open_pairs)), "more_groups")
    expand = lambda df, of: df.join(members.select(F.col("gid").alias(of), F.col("sig").alias(f"m_{of}")), of, "left").withColumn(f"m_{of}", F.coalesce(f"m_{of}", of))
    expanded = expand(expand(more_groups, "a"), "b").select(F.col("m_a").alias("a"), F.col("m_b").alias("b"))
    second = _paired(expanded.union(cross(inside)))
    second = with_c(with_c(second, "a"), "b").where("c_a != c_b").select("a", "b").join(first, ["a", "b"], "left_anti")
    second = stored(second, "second")
    if not second.isEmpty():
        comp = components(stored(_verify(docs, second, sketches, shared), "links").union(linked))

    least = with_c(classes.select("sig", "least"), "sig")
    ends = least.groupBy("c_sig").agg(F.min("least").alias("component_id"))
    places = least.join(ends, "c_sig").select("sig", "component_id")
    out = rows.join(places, "sig", "left")
    alone = F.col("doc_id").isNull() | (F.col("n") == 0)
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(alone, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))
