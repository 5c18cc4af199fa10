"""Quality scores by Bradley-Terry pairwise ranking.

A document's strength is a weighted sum of text features; the weights maximise
the likelihood of preference pairs (a document labelled good over one labelled
bad), that is, the logistic loss on feature differences.  The strengths are then
cut at the quantile that the bad share of the training labels gives, and scaled
so that the cut has the score ``cut_score``.

Features are made of whole texts by vectorised byte and word arithmetic; no
label, language, source or id is among them.  They are stored once; the fit sees
every labelled row that is not held out, and the loss of all pairs of them, in
passes that send sums to the driver.

Defined results: null and empty texts have the features of no words and get a
score like any; rows with a null id are never held out nor trained on; repeated
rows each get their own result; without labels of both kinds every score is
``cut_score``; an empty table gives an empty table; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from . import shingles
from .common import reduced, stored
from .quality_rules import STOP_FORMS

#: Weight of the penalty; the score at the cut; ranges of strength in the fit, and how many share their second moments.
RIDGE, CUT_SCORE, BINS, COARSE = 1e-3, 0.3, 512, 16

_CLASSES = np.zeros((11, 256))
for _row, _chars in enumerate(("abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", " \t", "\n", ".", ",;:", "|", "!?", "#*$%&<>")):
    for _c in _chars:
        _CLASSES[_row, ord(_c)] = 1
_CLASSES[10, 128:] = 1
_stops = pa.array(sorted(set(STOP_FORMS)))
_STOPS = np.unique(shingles.word_hashes(*shingles.text_bytes(_stops))[0])


def features(column: pa.Array) -> np.ndarray:
    """A row of features for every text."""
    data, at = shingles.text_bytes(column)
    out = []
    for i, j in shingles.pieces(at):
        piece, edges = data[at[i] : at[j]], at[i : j + 1] - at[i]
        shares = np.stack([np.diff(np.concatenate([[0], np.cumsum(c[piece])])[edges]) for c in _CLASSES], axis=1)
        size = np.maximum(np.diff(edges), 1)[:, None]
        words, owner = shingles.word_hashes(data, at[i : j + 1])
        n = np.bincount(owner, minlength=j - i)
        ends = np.cumsum(n)
        stops = np.bincount(owner, np.isin(words, _STOPS), minlength=j - i)
        m = max(0, len(words) - 2)
        triples = shingles.mix(words[:m] + shingles.mix(words[1 : m + 1] + shingles.mix(words[2:])))
        extra = np.zeros((j - i, 2))
        for k, (c, e) in enumerate(zip(n.tolist(), ends.tolist(), strict=True)):
            if c > 2:
                extra[k] = len(np.unique(words[e - c : e])) / c, 1 - len(np.unique(triples[e - c : e - 2])) / (c - 2)
        w = np.maximum(n, 1)
        shares = shares / size
        more = [np.log1p(n), np.minimum(n, 50) / 50, (size[:, 0] - n) / w, stops / w, extra[:, 0], extra[:, 1], np.minimum(1, 20 * shares[:, 7]), np.minimum(1, 20 * shares[:, 9]), np.minimum(1, 10 * shares[:, 8]), np.minimum(1, 10 * extra[:, 1])]
        out.append(np.concatenate([shares, np.stack(more, axis=1)], axis=1))
    return np.concatenate(out) if out else np.zeros((0, len(_CLASSES) + 10))


@F.arrow_udf(ArrayType(DoubleType()))
def _features(text: pa.Array) -> pa.Array:
    x = features(text)
    flat = pa.array(x.ravel(), pa.float64())
    return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), flat)


def _plain(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    flat = batch.column(0).flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(batch.num_rows, -1), batch.column(1).to_numpy(zero_copy_only=False)


def _strength(x: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """A weighted sum of each row, made alike in batches of any size."""
    out = np.zeros(len(x))
    for c, w in zip(x.T, weights.tolist(), strict=True):
        out += c * w
    return out


def _grid(x: np.ndarray, bits: int) -> np.ndarray:
    """Numbers as multiples of a power of two, so that their sums are exact."""
    return np.round(x * 2.0**bits) / 2.0**bits


class Ranking:
    """Weights of the features, and the scale of scores, from all rows of a table (x, y).

    The loss is that of all pairs of a good and a bad row.  It is read off sums of
    both kinds of rows in BINS ranges of strength, with each range's own mean: a
    pass over the rows for each step of Newton's method.
    """

    def __init__(self, fit: DataFrame, cut_score: float = CUT_SCORE):
        self.weights, self.slope, self.cut, self.at_cut = np.zeros(0), 0.0, 0.0, float(np.log(cut_score / (1 - cut_score)))

        def bounds(b):
            x, y = _plain(b)
            return np.concatenate([x.max(axis=0), -x.min(axis=0), [(y == 1).any(), (y == 0).any()]])

        most = reduced(fit, bounds, np.maximum)
        if most is None or not most[-2:].all():
            return
        k = (len(most) - 2) // 2
        high, low = most[:k], -most[k : 2 * k]
        wide = np.where(high > low, high - low, 1)

        def moments(b):
            x, y = _plain(b)
            t = (x - low) / wide
            return np.concatenate([_grid(t, 26).sum(axis=0), _grid(t * t, 26).sum(axis=0), [(y == 1).sum(), (y == 0).sum()]])

        sums = reduced(fit, moments)
        n_good, n_bad = sums[-2:]
        mean = sums[:k] / (n_good + n_bad)
        spread = np.sqrt(np.maximum(sums[k : 2 * k] / (n_good + n_bad) - mean**2, 0)) * wide
        mean = low + mean * wide
        scale = np.where(spread > 1e-9, 1 / np.maximum(spread, 1e-9), 0)
        w, tau = np.zeros(k), 1.0
        for _ in range(25):
            grad, bend, both = self._step(fit, mean, scale, w, tau, n_good, n_bad)
            step = np.linalg.solve(bend + RIDGE * np.eye(k), grad - RIDGE * w)
            w = w + step
            tau = max(float(np.sqrt(max(w @ both @ w, 0))), 1e-9)
            if np.abs(step).max() < 1e-6:
                break
        self.weights = weights = w * scale
        self.cut = cut = self._quantile(fit, n_bad / (n_good + n_bad), int(n_good + n_bad), low, high)
        at_cut, slopes = self.at_cut, np.geomspace(0.01, 100, 60)

        def losses(b):
            x, y = _plain(b)
            z = np.clip(at_cut + slopes[:, None] * (_strength(x, weights) - cut), -30, 30)
            return _grid(np.logaddexp(0, np.where(y == 1, -z, z)), 20).sum(axis=1)

        self.slope = float(slopes[np.argmin(reduced(fit, losses))])

    @staticmethod
    def _step(fit, mean, scale, w, tau, n_good, n_bad):
        """Gradient and curvature of the mean loss over all pairs, and the second moments of the rows."""
        k = len(w)

        def binned(b):
            x, y = _plain(b)
            x = _grid((x - mean) * scale, 12)
            at = np.clip(np.floor((_strength(x, w) / (16 * tau) + 0.5) * BINS), 0, BINS - 1).astype(np.int64)
            first = np.zeros((2, BINS, k + 1))
            second = np.zeros((2, BINS // COARSE, k, k))
            for kind in (0, 1):
                rows = y == kind
                first[kind] = np.stack([np.bincount(at[rows], c, BINS) for c in (np.ones(rows.sum()), *x[rows].T)], axis=1)
                coarse = at[rows] // COARSE
                for c in np.unique(coarse).tolist():
                    part = x[rows][coarse == c]
                    second[kind, c] = part.T @ part
            return np.concatenate([first.ravel(), second.ravel()])

        sums = reduced(fit, binned)
        first, second = sums[: 2 * BINS * (k + 1)].reshape(2, BINS, k + 1), sums[2 * BINS * (k + 1) :].reshape(2, -1, k, k)
        (nb, mb), (ng, mg) = ((f[:, 0], f[:, 1:]) for f in first)
        sb, sg = (m @ w / np.maximum(n, 1) for n, m in ((nb, mb), (ng, mg)))
        p = 1 / (1 + np.exp(np.clip(sg[:, None] - sb[None, :], -30, 30)))
        bend = p * (1 - p)
        pairs = n_good * n_bad
        grad = ((p @ nb) @ mg - (ng @ p) @ mb) / pairs
        cross = mg.T @ bend @ mb
        total = -(cross + cross.T)
        for n, weight, q in ((ng, bend @ nb, second[1]), (nb, ng @ bend, second[0])):
            share = (n * weight).reshape(-1, COARSE).sum(axis=1) / np.maximum(n.reshape(-1, COARSE).sum(axis=1), 1)
            total = total + np.tensordot(share, q, 1)
        return grad, total / pairs, second.sum(axis=(0, 1)) / (n_good + n_bad)

    def _quantile(self, fit, share, n, low, high):
        """The strength that a share of all rows does not exceed: ranges around it are counted, and narrowed."""
        weights, rank = self.weights, min(int(share * (n - 1)), n - 1)
        lo, hi = float(np.minimum(weights * low, weights * high).sum()) - 1e-6, float(np.maximum(weights * low, weights * high).sum()) + 1e-6
        for _ in range(8):
            edges = np.linspace(lo, hi, 4097)
            counts = reduced(fit, lambda b, edges=edges: np.bincount(np.searchsorted(edges, _strength(_plain(b)[0], weights), side="right"), minlength=len(edges) + 1).astype(np.float64))
            at = int(np.searchsorted(np.cumsum(counts), rank, side="right"))
            lo, hi = float(edges[max(at - 1, 0)]), float(edges[min(at, len(edges) - 1)])
            if hi - lo <= 1e-12 * max(1.0, abs(hi)):
                break
        return lo

    def score(self, x: np.ndarray) -> np.ndarray:
        if not len(self.weights):
            return np.full(len(x), 1 / (1 + np.exp(-self.at_cut)))
        return 1 / (1 + np.exp(-np.clip(self.at_cut + self.slope * (_strength(x, self.weights) - self.cut), -30, 30)))


def rank(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text: str = "text", label: str = "quality", cut_score: float = CUT_SCORE) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every row; rows whose ``crc32(doc_id) mod 5`` is 0 are held out of the fit."""
    spark = docs.sparkSession
    rest = F.crc32(F.col("doc_id").cast("string")) % 5
    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), _features(F.col(text)).alias("x"))
    rows = stored(rows.withColumn("held_out", F.coalesce(rest == 0, F.lit(False))), "features")
    known = labels.select(F.col(id_column).cast("long").alias("doc_id"), F.col(label).cast("int").alias("y")).where("y in (0, 1)")
    fit = stored(rows.where(~F.col("held_out")).join(known, "doc_id").select("x", "y"), "labelled")
    model = Ranking(fit, cut_score)
    held = spark.sparkContext.broadcast(model)

    @F.arrow_udf(DoubleType())
    def scored(x: pa.Array) -> pa.Array:
        flat = x.flatten().to_numpy()
        return pa.array(held.value.score(flat.reshape(len(x), -1)) if len(x) else np.zeros(0))

    out = rows.select("doc_id", "held_out", scored("x").alias("score"))
    return out.withColumn("predicted", (F.col("score") >= cut_score).cast("int"))
