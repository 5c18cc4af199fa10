"""URL filter: gradient-boosted trees on lexical features, beside host and path rules.

Features of a URL: lengths, depth, digit ratio, entropy, parameter counts, and
statistics of its host's suffixes (smoothed shares of blocked URLs and how often
a suffix was seen).  In the fit a URL's statistics are those of the other FOLDS,
so that they do not tell its own label, and every second URL, by its hash, is
learnt from as if its suffixes had never been seen, so that the trees also know
what to do with an unseen suffix, which has the share of all.
Trees are grown by histogram gradients over all distinct labelled URLs, in passes
that send sums to the driver: their features are stored once, cut into bins at
exact quantiles, and each level of a tree is one pass.  Sums are exact, so that
neither partitions nor repeated URLs decide the trees.  The statistics of suffixes
are a table, joined by host.  Every URL is scored by vectorised walks over the trees.

URLs are blocked from the score on above which the labelled URLs have their own
share of blocked ones, counted over all of them.  ``held_out`` is the accuracy on
suffixes that were kept out as a whole from a fit of the other ones.

Defined results: null URLs and URLs without ``://`` have empty host and path and
are judged like any other; repeated rows each get their own result; with an empty
table, or labels of one kind only, every score is the share of blocked labels;
other columns are not read.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from .common import reduced, stored

#: The rules of the query: verdict, host, path (fixed values).
RULES = (("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/"))
#: Trees, their depth, bins, shrinkage and least rows of a leaf.
TREES, DEPTH, BINS, SHRINK, LEAF = 40, 4, 64, 0.2, 20
#: Features of a URL, and those of them that are of its text.
WIDTH, LEXICAL = 20, 14
#: After so many trees, what they add is stored with the rows.
STORED = 8
#: Prior weight of a suffix's share; folds of the statistics in the fit.
SMOOTH, FOLDS = 20.0, 5
_CAPITALS, _SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without ``://``."""
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1), _CAPITALS, _SMALL)


def path_of(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule whose host is the URL's or a parent of it and whose path begins the URL's, and its verdict."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        name, verdict = F.when(fits, h + p).otherwise(name), F.when(fits, kind).otherwise(verdict)
    return name, verdict


def _parts(url: str | None) -> tuple[str, str, str]:
    scheme, found, rest = (url or "").partition("://")
    if not found:
        return "", "", url or ""
    end = min((k for k in (rest.find(c) for c in "/?#") if k >= 0), default=len(rest))
    tail = rest[end:]
    cut = min((k for k in (tail.find(c) for c in "?#") if k >= 0), default=len(tail))
    return rest[:end].translate(str.maketrans(_CAPITALS, _SMALL)), tail[:cut], tail[cut:]


def _suffixes(host: str) -> tuple[str, ...]:
    """The last one, two and three labels of a host."""
    labels = host.split(".")
    return tuple(".".join(labels[-k:]) for k in (1, 2, 3))


def _single(x: np.ndarray) -> np.ndarray:
    """Numbers in single precision, none of them a negative zero."""
    return x.astype(np.float32).astype(np.float64) + 0.0


def lexical(urls: list[str | None]) -> np.ndarray:
    """The features of the text."""
    out = np.zeros((len(urls), LEXICAL))
    for k, url in enumerate(urls):
        host, path, rest = _parts(url)
        full = url or ""
        share = np.bincount(np.frombuffer(full.encode(), np.uint8)) / max(1, len(full.encode())) if full else np.zeros(1)
        share = share[share > 0]
        digits = lambda x: sum(c.isdigit() for c in x)
        out[k] = (
            len(full), len(host), len(path), len(rest), host.count("."), path.count("/"), max((len(x) for x in path.split("/")), default=0), digits(full) / max(1, len(full)),
            digits(host), -float((share * np.log2(share)).sum()) if len(share) else 0.0, rest.count("=") , rest.count("&"), host.count("-"), full.count("%"),
        )
    return _single(out)


def shares(blocked: np.ndarray, n: np.ndarray, base: float) -> np.ndarray:
    """The features of the suffixes: of blocked and all labelled URLs of each."""
    return _single(np.stack([(blocked + SMOOTH * base) / (n + SMOOTH), np.log1p(n)], axis=2).reshape(len(n), 2 * n.shape[1]))


def features(urls: list[str | None], counts: dict[str, tuple[float, float]], base: float) -> np.ndarray:
    """The feature matrix; ``counts`` has the blocked and all labelled URLs of each suffix."""
    seen = np.array([[counts.get(s, (0.0, 0.0)) for s in _suffixes(_parts(u)[0])] for u in urls], np.float64).reshape(len(urls), 3, 2)
    return np.concatenate([lexical(urls), shares(seen[:, :, 0], seen[:, :, 1], base)], axis=1)


@dataclass
class Trees:
    """Boosted trees of one depth: for each tree its split features and cuts, level by level, and its leaves."""

    base: float
    feature: np.ndarray
    cut: np.ndarray
    leaf: np.ndarray

    def score(self, x: np.ndarray) -> np.ndarray:
        margin, rows = np.full(len(x), self.base), np.arange(len(x))
        for f, c, leaf in zip(self.feature, self.cut, self.leaf, strict=True):
            node = np.zeros(len(x), np.int64)
            for _ in range(DEPTH):
                node = 2 * node + 1 + (x[rows, f[node]] > c[node])
            margin += leaf[node - (2**DEPTH - 1)]
        return 1 / (1 + np.exp(-margin))


def _ranks(n: int) -> np.ndarray:
    """The places of the cuts among ``n`` sorted numbers."""
    return np.arange(1, BINS) * (n - 1) // BINS


def _codes(x: np.ndarray, cuts: list[np.ndarray]) -> np.ndarray:
    """The bin of each number: how many cuts are less."""
    return np.stack([np.searchsorted(c, v, side="left") for c, v in zip(cuts, x.T, strict=True)], axis=1).astype(np.uint8)


def _walk(codes: np.ndarray, feature: np.ndarray, at: np.ndarray, depth: int = DEPTH) -> np.ndarray:
    """The node of each row in a level of a tree; rows with a bin over ``at`` go right."""
    node, rows = np.zeros(len(codes), np.int64), np.arange(len(codes))
    for _ in range(depth):
        node = 2 * node + 1 + (codes[rows, feature[node]] > at[node])
    return node - (2**depth - 1)


def _added(margin: np.ndarray, codes: np.ndarray, trees: list[tuple]) -> np.ndarray:
    for feature, at, leaf in trees:
        margin = margin + leaf[_walk(codes, feature, at)]
    return margin


def _grid(x: np.ndarray) -> np.ndarray:
    """Numbers as multiples of a power of two, so that their sums are exact."""
    return np.round(x * 2.0**26) / 2.0**26


def _sums(codes: np.ndarray, y: np.ndarray, margin: np.ndarray, feature: np.ndarray, at: np.ndarray, level: int) -> np.ndarray:
    """Gradients, curvatures and rows of each feature, node of the level, and bin."""
    p = 1 / (1 + np.exp(-margin))
    node, size = _walk(codes, feature, at, level) * BINS, 2**level * BINS
    return np.concatenate([np.bincount(node + codes[:, j], w, size) for w in (_grid(p - y), _grid(p * (1 - p)), None) for j in range(WIDTH)]).astype(np.float64)


def grow(cuts: list[np.ndarray], base: float, sums) -> tuple[Trees, list[tuple]]:
    """Trees by Newton steps of the logistic loss, and the same with bins for cuts; ``sums(trees, feature, at, level)`` gives the sums of all rows as ``_sums`` does."""
    inner, trees, grown = 2**DEPTH - 1, [], []
    for _ in range(TREES):
        feature, at, cut, leaves = np.zeros(inner, np.int64), np.full(inner, BINS), np.full(inner, np.inf), np.zeros((2, inner + 1))
        for level in range(DEPTH):
            first, width = 2**level - 1, 2**level
            g, h, n = sums(trees, feature, at, level).reshape(3, WIDTH, width, BINS).cumsum(axis=3)
            best, chosen = np.full(width, 1e-9), np.full((width, 2), -1)
            for j, c in enumerate(cuts):
                (gl, hl, nl), (gt, ht, nt) = (s[j][:, : len(c)] for s in (g, h, n)), (s[j][:, -1:] for s in (g, h, n))
                gain = gl**2 / (hl + 1) + (gt - gl) ** 2 / (ht - hl + 1) - gt**2 / (ht + 1)
                gain[(nl < LEAF) | (nt - nl < LEAF)] = -1
                if gain.shape[1]:
                    k = gain.argmax(axis=1)
                    better = gain[np.arange(width), k] > best
                    best[better], chosen[better] = gain[np.arange(width), k][better], np.stack([np.full(width, j), k], axis=1)[better]
            for node, (j, k) in enumerate(chosen.tolist()):
                if j >= 0:
                    feature[first + node], at[first + node], cut[first + node] = j, k, cuts[j][k]
                if level == DEPTH - 1:  # what is not split goes left
                    whole = [s[0, node, -1] for s in (g, h)]
                    left = [s[j, node, k] for s in (g, h)] if j >= 0 else whole
                    leaves[:, 2 * node], leaves[:, 2 * node + 1] = left, np.subtract(whole, left)
        leaf = -SHRINK * leaves[0] / (leaves[1] + 1)
        trees.append((feature, at, leaf))
        grown.append((feature, cut, leaf))
    return Trees(base, *(np.stack(t) for t in zip(*grown, strict=True))), trees


def _stump(y_mean: float) -> Trees:
    """No tree: the share of all."""
    share, inner = min(max(y_mean, 1e-6), 1 - 1e-6), 2**DEPTH - 1
    return Trees(float(np.log(share / (1 - share))), np.zeros((0, inner), np.int64), np.zeros((0, inner)), np.zeros((0, inner + 1)))


def fit(x: np.ndarray, y: np.ndarray) -> Trees:
    """Trees of one matrix."""
    stump = _stump(float(y.mean()) if len(y) else 0.0)
    if len(y) < 2 * LEAF or y.min() == y.max():
        return stump
    x = _single(x)
    cuts = [np.unique(np.sort(c)[_ranks(len(y))]) for c in x.T]
    codes, margin, done = _codes(x, cuts), np.full(len(y), stump.base), 0

    def sums(trees, feature, at, level):
        nonlocal margin, done
        margin, done = _added(margin, codes, trees[done:]), len(trees)
        return _sums(codes, y, margin, feature, at, level)

    return grow(cuts, stump.base, sums)[0]


@dataclass
class Model:
    """Suffix statistics and trees; URLs with a score of ``least`` or more are blocked."""

    counts: dict[str, tuple[float, float]]
    base: float
    trees: Trees
    least: float

    def score(self, urls: list[str | None]) -> np.ndarray:
        return self.trees.score(features(urls, self.counts, self.base)) if urls else np.zeros(0)


def _fold(text: str, n: int) -> int:
    return zlib.crc32(text.encode()) % n


def learn(urls: list[str | None], y: np.ndarray) -> Model:
    """A model of labelled URLs, on the driver; ``train`` makes the same of a table."""
    base = float(y.mean()) if len(y) else 0.0
    suffixes, fold = [_suffixes(_parts(u)[0]) for u in urls], np.array([_fold(u or "", 2 * FOLDS) for u in urls], np.int64)

    def counted(rows: np.ndarray) -> dict[str, tuple[float, float]]:
        counts: dict[str, tuple[float, float]] = {}
        for k in rows.tolist():
            for s in suffixes[k]:
                b, n = counts.get(s, (0.0, 0.0))
                counts[s] = (b + float(y[k]), n + 1)
        return counts

    counts, x = counted(np.arange(len(y))), np.zeros((len(y), WIDTH))
    for f in range(2 * FOLDS):  # odd ones see no suffix
        own = np.flatnonzero(fold == f)
        x[own] = features([urls[k] for k in own.tolist()], {} if f % 2 else counted(np.flatnonzero(fold // 2 != f // 2)), base)
    trees = fit(x, y)
    p = trees.score(features(urls, counts, base)) if len(y) else np.zeros(0)
    # As many labelled URLs reach the threshold as are blocked, about; equal scores are on one side.
    several, n = np.unique(p, return_counts=True)
    reach = n[::-1].cumsum()[::-1]
    least = float(several[np.argmin(np.abs(reach - y.sum()))]) if 0 < base < 1 else 0.5
    return Model(counts, base, trees, least)


@dataclass
class Trained:
    """As ``Model``, with the labelled URLs of each suffix and fold as a table (suffix, t0, ..: the blocked ones, then all)."""

    suffixes: DataFrame
    base: float
    trees: Trees
    least: float


def _with_counts(rows: DataFrame, suffixes: DataFrame) -> DataFrame:
    """Rows (host, ..) with ``seen``: for each of the host's suffixes the numbers of the table."""
    hosts = rows.select("host").distinct()
    for k in (1, 2, 3):
        own = suffixes.select(F.col("suffix").alias(f"s{k}"), F.array(*(f"t{i}" for i in range(2 * FOLDS))).alias(f"a{k}"))
        hosts = hosts.withColumn(f"s{k}", F.substring_index("host", ".", -k)).join(own, f"s{k}", "left")
    none = F.array(*[F.lit(0.0)] * (2 * FOLDS))
    seen = F.concat(*(F.coalesce(f"a{k}", none) for k in (1, 2, 3)))
    return rows.join(stored(hosts.select("host", seen.alias("seen")), "hosts"), "host", "left")


def _counts(seen: pa.Array) -> np.ndarray:
    """Rows, suffixes, blocked and all, folds."""
    return seen.flatten().to_numpy(zero_copy_only=False).reshape(len(seen), 3, 2, FOLDS)


def _matrix(column: pa.Array, kind) -> np.ndarray:
    """Rows of the features in the fit, then of the suffixes' as they are scored."""
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(len(column), 2 * WIDTH - LEXICAL)


def _bytes(x: np.ndarray) -> pa.Array:
    return pa.array([r.tobytes() for r in x], pa.binary())


def _cuts(table: DataFrame, n: int) -> list[np.ndarray]:
    """The numbers at the places of ``_ranks`` in each column, found byte by byte: a pass over the rows for each byte of their order."""
    most = BINS - 1
    prefix, rank = np.zeros((WIDTH, most), np.uint32), np.tile(_ranks(n), (WIDTH, 1))

    def ordered(b: pa.RecordBatch) -> np.ndarray:
        bits = np.ascontiguousarray(_matrix(b.column(0), np.float32)[:, :WIDTH].T).view(np.uint32)
        return bits ^ np.where(bits >> 31, np.uint32(0xFFFFFFFF), np.uint32(0x80000000))

    for shift in (24, 16, 8, 0):
        several = [np.unique(p) for p in prefix]

        def counted(b: pa.RecordBatch, shift=shift, several=several) -> np.ndarray:
            out = np.zeros((WIDTH, most, 256))
            for j, key in enumerate(ordered(b)):
                above = (key >> np.uint32(shift)) >> np.uint32(8)
                at = np.minimum(np.searchsorted(several[j], above), len(several[j]) - 1)
                here = several[j][at] == above
                out[j] = np.bincount(at[here] * 256 + ((key[here] >> np.uint32(shift)) & np.uint32(255)), minlength=most * 256).reshape(most, 256)
            return out.ravel()

        counts = reduced(table, counted).reshape(WIDTH, most, 256).cumsum(axis=2)
        for j in range(WIDTH):
            for k, at in enumerate(np.searchsorted(several[j], prefix[j]).tolist()):
                c = counts[j, at]
                digit = int(np.searchsorted(c, rank[j, k], side="right"))
                rank[j, k] -= int(c[digit - 1]) if digit else 0
                prefix[j, k] = (int(prefix[j, k]) << 8) | digit
    bits = np.where(prefix >> 31, prefix ^ np.uint32(0x80000000), ~prefix).astype(np.uint32)
    return [np.unique(c.astype(np.float64)) for c in bits.view(np.float32)]


def _least(table: DataFrame, trees: list[tuple], blocked: int, base: float) -> float:
    """The score that about as many rows (codes, y, margin) reach as are blocked: the last one that no fewer reach, or the next; equal scores are on one side."""

    def scores(b: pa.RecordBatch) -> np.ndarray:
        codes = _matrix(b.column(0), np.uint8)
        codes = np.concatenate([codes[:, :LEXICAL], codes[:, WIDTH:]], axis=1)
        return 1 / (1 + np.exp(-_added(np.full(len(codes), base), codes, trees)))

    prefix, rank = 0, blocked
    for shift in (48, 32, 16, 0):

        def counted(b: pa.RecordBatch, shift=shift, prefix=prefix) -> np.ndarray:
            key = scores(b).view(np.uint64)
            here = (key >> np.uint64(shift)) >> np.uint64(16) == np.uint64(prefix)
            return np.bincount(((key[here] >> np.uint64(shift)) & np.uint64(0xFFFF)).astype(np.int64), minlength=1 << 16).astype(np.float64)

        above = reduced(table, counted)[::-1].cumsum()
        k = int(np.searchsorted(above, rank, side="left"))
        rank -= int(above[k - 1]) if k else 0
        prefix = (prefix << 16) | (0xFFFF - k)
    last = float(np.array([prefix], np.uint64).view(np.float64)[0])

    def around(b: pa.RecordBatch) -> np.ndarray:
        p = scores(b)
        return np.array([(p >= last).sum(), (p > last).sum(), -p[p > last].min(initial=np.inf)])

    reach, over, after = reduced(table, around, lambda a, b: np.array([a[0] + b[0], a[1] + b[1], max(a[2], b[2])]))
    return last if over == 0 or reach - blocked <= blocked - over else -float(after)


def train(labelled: DataFrame, url: str = "url", blocked: str = "blocked") -> Trained:
    """A model from labelled URLs: ``blocked`` is 1 or 0; rows without a label are left out, and a URL with both labels counts with each."""
    rows = labelled.select(F.col(url).alias("u"), F.col(blocked).cast("double").alias("y")).where("y is not null").distinct()
    rows = stored(rows.select("u", "y", host_of(F.col("u")).alias("host"), (F.crc32(F.coalesce("u", F.lit(""))) % (2 * FOLDS)).cast("int").alias("fold")), "labelled")
    own = [F.when(F.floor(F.col("fold") / 2) == f, v).otherwise(0.0) for v in (F.col("y"), F.lit(1.0)) for f in range(FOLDS)]
    names = [f"t{i}" for i in range(2 * FOLDS)]
    hosts = rows.groupBy("host").agg(*(F.sum(c).alias(t) for c, t in zip(own, names, strict=True)))
    each = hosts.select(F.explode(F.array(*(F.substring_index("host", ".", -k) for k in (1, 2, 3)))).alias("suffix"), *names)
    suffixes = stored(each.groupBy("suffix").agg(*(F.sum(t).alias(t) for t in names)), "suffixes")
    n, several, total = rows.agg(F.count("*"), F.count_distinct("y"), F.coalesce(F.sum("y"), F.lit(0.0))).first()
    base = total / n if n else 0.0
    stump = _stump(base)
    if n < 2 * LEAF or several < 2:
        return Trained(suffixes, base, stump, 1 / (1 + float(np.exp(-stump.base))) if 0 < base < 1 else 0.5)

    def measured(batches):
        for b in batches:
            seen, fold = _counts(b.column(3)), b.column(2).to_numpy()
            every = seen.sum(axis=3)
            rest = every - seen[np.arange(len(fold)), :, :, fold // 2]
            rest[fold % 2 == 1] = 0  # odd ones see no suffix
            x = np.concatenate([lexical(b.column(0).to_pylist()), shares(rest[:, :, 0], rest[:, :, 1], base), shares(every[:, :, 0], every[:, :, 1], base)], axis=1)
            yield pa.RecordBatch.from_arrays([_bytes(x.astype(np.float32)), b.column(1)], ["x", "y"])

    table = stored(_with_counts(rows, suffixes).select("u", "y", "fold", "seen").mapInArrow(measured, "x binary, y double"), "features")
    cuts = _cuts(table, n)

    def coded(batches):
        for b in batches:
            codes = _codes(_matrix(b.column(0), np.float32).astype(np.float64), [*cuts, *cuts[LEXICAL:]])
            yield pa.RecordBatch.from_arrays([_bytes(codes), b.column(1), pa.array(np.full(len(codes), stump.base))], ["codes", "y", "margin"])

    table, done = stored(table.mapInArrow(coded, "codes binary, y double, margin double"), "codes"), 0

    def sums(trees, feature, at, level):
        nonlocal table, done
        if len(trees) - done == STORED:
            more = trees[done:]

            def added(batches):
                for b in batches:
                    margin = _added(b.column(2).to_numpy(), _matrix(b.column(0), np.uint8), more)
                    yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(margin)], ["codes", "y", "margin"])

            table, done = stored(table.mapInArrow(added, table.schema), "codes"), len(trees)
        more = trees[done:]

        def of(b: pa.RecordBatch) -> np.ndarray:
            codes = _matrix(b.column(0), np.uint8)
            return _sums(codes, b.column(1).to_numpy(), _added(b.column(2).to_numpy(), codes, more), feature, at, level)

        return reduced(table, of)

    grown, trees = grow(cuts, stump.base, sums)
    return Trained(suffixes, base, grown, _least(table, trees, int(total), stump.base))


def held_out(labelled: DataFrame, url: str = "url", blocked: str = "blocked") -> float:
    """The accuracy on a fifth of the suffixes, by their hash, that a fit of the other ones has not seen."""
    rows = labelled.select(F.col(url).alias("url"), F.col(blocked).cast("double").alias("y")).where("y is not null").distinct().withColumn("host", host_of(F.col("url")))
    out = F.crc32(F.substring_index("host", ".", -3)) % 5 == 0
    model = train(rows.where(~out), "url", "y")
    hit = ((F.col("score") >= model.least) == (F.col("y") == 1)).cast("double")
    return scored(rows.where(out), model).agg(F.avg(hit)).first()[0]


def scored(rows: DataFrame, model: Trained) -> DataFrame:
    """Rows (url, host, ..) with the score of every URL, 0 to 1: higher, blocked likelier.  What is broadcast are the trees."""
    held = rows.sparkSession.sparkContext.broadcast((model.trees, model.base))

    @F.arrow_udf(DoubleType())
    def score(urls: pa.Array, seen: pa.Array) -> pa.Array:
        trees, base = held.value
        every = _counts(seen).sum(axis=3)
        return pa.array(trees.score(np.concatenate([lexical(urls.to_pylist()), shares(every[:, :, 0], every[:, :, 1], base)], axis=1)), pa.float64())

    return _with_counts(rows, model.suffixes).withColumn("score", score("url", "seen")).drop("seen")


def judge(pages: DataFrame, id_column: str = "page_id", url: str = "url", rules=RULES) -> DataFrame:
    """Per row: id, host, path, rule, score and verdict; the URLs that a rule decides are the labelled ones."""
    rows = pages.select(F.col(id_column), F.col(url).alias("url"))
    rows = rows.withColumns({"host": host_of(F.col("url")), "path": path_of(F.col("url"))})
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    rows = rows.withColumns({"rule": rule, "ruled": verdict})
    model = train(rows.where("rule is not null").select("url", (F.col("ruled") == "block").cast("int").alias("blocked")))
    by_score = F.when(F.col("score") >= model.least, "block").otherwise("allow")
    return scored(rows, model).select(F.col(id_column), "host", "path", "rule", "score", F.coalesce("ruled", by_score).alias("verdict"))
