"""Quality classifier: a generalised additive model with pairwise interactions, boosted feature by feature."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewheel.llm import kernels as K
from tidewheel.llm.sample import threshold

#: labelled documents used for fitting at most; those with the least hash of their id
SAMPLE = 20_000
BINS = 32
PAIR_BINS = 8
PAIRS = 6
ROUNDS = 150
RATE = 0.1

FEATURES = ["log_words", "word_length", "symbols", "dup_lines", "repeats", "distinct", "upper", "digits", "stops", "marks", "pipes", "lines", "wide", "longest"]


def features(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """documents x FEATURES, from whole texts; empty texts give zeros."""
    n = len(offsets) - 1
    c = K.text_counts(data, offsets)
    words = np.maximum(c["n_words"], 1)
    size = np.maximum(np.diff(offsets), 1)

    def share(chars: bytes, by) -> np.ndarray:
        t = np.zeros(256, bool)
        t[list(chars)] = True
        return K.counts_between(t[data], offsets) / by

    h, d = c["_words"], c["_doc"]
    packed = np.sort((d.astype(K.U64) << K.U64(54)) | (h >> K.U64(10)))
    new = np.concatenate([[True], packed[1:] != packed[:-1]]) if len(packed) else np.zeros(0, bool)
    distinct = np.bincount((packed[new] >> K.U64(54)).astype(np.int64), minlength=n)
    starts, ends, doc = K.spans(data, offsets)
    longest = np.zeros(n, np.int64)
    np.maximum.at(longest, doc, ends - starts)
    upper = bytes(range(65, 91))
    return np.stack(
        [
            np.log1p(c["n_words"]),
            c["word_chars"] / words,
            c["n_symbols"] / words,
            c["n_dup_lines"] / words,
            c["n_repeat_words"] / words,
            distinct / words,
            share(upper, size),
            share(b"0123456789", size),
            share(b".", words),
            share(b"!?", words),
            share(b"|", words),
            share(b"\n", words),
            share(bytes(range(128, 256)), size),
            np.log1p(longest),
        ],
        1,
    )


def shallow(bins: np.ndarray, grad: np.ndarray, hess: np.ndarray, n_bins: int, splits: int = 3) -> np.ndarray:
    """A small regression tree on one binned feature, as a table of leaf values by bin."""
    g, h = np.bincount(bins, grad, n_bins), np.bincount(bins, hess, n_bins)
    cuts = [0, n_bins]
    cg, ch = np.concatenate([[0], np.cumsum(g)]), np.concatenate([[0], np.cumsum(h)])
    value = lambda a, b: (cg[b] - cg[a]) ** 2 / (ch[b] - ch[a] + 1.0)
    for _ in range(splits):
        best = (1e-9, None)
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            if b - a > 1:
                m = np.arange(a + 1, b)
                ok = (ch[m] - ch[a] > 1.0) & (ch[b] - ch[m] > 1.0)
                gain = np.where(ok, value(a, m) + value(m, b) - value(a, b), -1)
                i = int(gain.argmax())
                if gain[i] > best[0]:
                    best = (float(gain[i]), int(m[i]))
        if best[1] is None:
            break
        cuts = sorted([*cuts, best[1]])
    out = np.zeros(n_bins)
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        out[a:b] = (cg[b] - cg[a]) / (ch[b] - ch[a] + 1.0)
    return out


def shallow_pair(cell: np.ndarray, grad: np.ndarray, hess: np.ndarray, side: int, splits: int = 3) -> np.ndarray:
    """A small regression tree on two binned features, as a table of leaf values by cell (side x side, flat).

    Leaves are rectangles of cells; each split cuts one of them along one of the
    features where that gains most.
    """

    def sums(values):
        out = np.zeros((side + 1, side + 1))
        out[1:, 1:] = np.bincount(cell, values, side * side).reshape(side, side).cumsum(0).cumsum(1)
        return out

    g, h = sums(grad), sums(hess)
    inside = lambda s, a, b, c, d: s[b, d] - s[a, d] - s[b, c] + s[a, c]
    worth = lambda a, b, c, d: inside(g, a, b, c, d) ** 2 / (inside(h, a, b, c, d) + 5.0)
    leaves = [(0, side, 0, side)]
    for _ in range(splits):
        best, cut = 1e-9, None
        for n, (a, b, c, d) in enumerate(leaves):
            own = worth(a, b, c, d)
            for m, one, two in ((np.arange(a + 1, b), *((a, None, c, d), (None, b, c, d))), (np.arange(c + 1, d), *((a, b, c, None), (a, b, None, d)))):
                if len(m):
                    left, right = (tuple(m if x is None else x for x in box) for box in (one, two))
                    ok = (inside(h, *left) > 1.0) & (inside(h, *right) > 1.0)
                    gain = np.where(ok, worth(*left) + worth(*right) - own, -1)
                    i = int(gain.argmax())
                    if gain[i] > best:
                        boxes = [tuple(int(m[i]) if x is None else x for x in box) for box in (one, two)]
                        best, cut = float(gain[i]), (n, boxes)
        if cut is None:
            break
        leaves[cut[0] : cut[0] + 1] = cut[1]
    out = np.zeros((side, side))
    for a, b, c, d in leaves:
        out[a:b, c:d] = inside(g, a, b, c, d) / (inside(h, a, b, c, d) + 5.0)
    return out.ravel()


class AdditiveModel:
    """Lookup tables by feature and by pair of features; a score is the sum of the bins' entries."""

    def __init__(self):
        self.edges: list[np.ndarray] = []
        self.tables: list[np.ndarray] = []
        self.pairs: list[tuple[int, int, np.ndarray]] = []
        self.coarse: list[np.ndarray] = []
        self.intercept = 0.0

    def binned(self, x: np.ndarray) -> list[np.ndarray]:
        return [np.searchsorted(e, x[:, i], "left") for i, e in enumerate(self.edges)]

    def fit(self, x: np.ndarray, y: np.ndarray) -> AdditiveModel:
        """Cycle through the features, each round fitting a shallow tree of one of them to what is left; then through pairs."""
        n, m = x.shape
        p = (y.sum() + 0.5) / (n + 1)
        self.intercept = float(np.log(p / (1 - p)))
        self.edges = [np.unique(np.quantile(x[:, i], np.arange(1, BINS) / BINS)) if n else np.zeros(0) for i in range(m)]
        self.tables = [np.zeros(len(e) + 1) for e in self.edges]
        if not n:
            return self
        bins, f = self.binned(x), np.full(n, self.intercept)

        def step(b, size, table):
            q = 1 / (1 + np.exp(-f))
            tree = RATE * shallow(b, y - q, q * (1 - q), size)
            table += tree
            np.add(f, tree[b], out=f)

        for _ in range(ROUNDS):
            for i in range(m):
                step(bins[i], len(self.tables[i]), self.tables[i])
        self.coarse = [np.minimum(np.arange(len(t)) * PAIR_BINS // len(t), PAIR_BINS - 1) for t in self.tables]
        small = [c[b] for c, b in zip(self.coarse, bins, strict=True)]
        q = 1 / (1 + np.exp(-f))
        g, h = y - q, q * (1 - q)
        gains = []
        for i in range(m):
            for j in range(i):
                cell = small[i] * PAIR_BINS + small[j]
                a, b = np.bincount(cell, g, PAIR_BINS**2), np.bincount(cell, h, PAIR_BINS**2)
                gains.append((float((a**2 / (b + 5.0)).sum()), i, j))
        for _, i, j in sorted(gains, reverse=True)[:PAIRS]:
            self.pairs.append((i, j, np.zeros(PAIR_BINS**2)))
        for _ in range(ROUNDS // 3):
            for i, j, table in self.pairs:
                cell = small[i] * PAIR_BINS + small[j]
                q = 1 / (1 + np.exp(-f))
                tree = RATE * shallow_pair(cell, y - q, q * (1 - q), PAIR_BINS)
                table += tree
                f += tree[cell]
        return self

    def score(self, x: np.ndarray) -> np.ndarray:
        bins = self.binned(x)
        f = np.full(len(x), self.intercept)
        for b, t in zip(bins, self.tables, strict=True):
            f += t[b]
        for i, j, t in self.pairs:
            f += t[self.coarse[i][bins[i]] * PAIR_BINS + self.coarse[j][bins[j]]]
        return 1 / (1 + np.exp(-f))


def fit_quality(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, label: str = "quality") -> AdditiveModel:
    """Fit on at most `sample` labelled documents, those with the least 64-bit hash of their id.

    docs: doc_id, text; labels: doc_id and `label` (0 or 1; null rows are left
    out, of several for one id the largest counts).  Rows of docs that share an id are
    one document, that with the least text; labels without a document are left out.
    Without any labels every score is one half.  Other columns are ignored.
    """
    seen = labels.where(f"{label} is not null and doc_id is not null").groupBy(F.col("doc_id").cast("bigint").alias("id")).agg(F.max(label).cast("double").alias("y"))
    picked = seen.withColumn("_h", F.xxhash64("id")).where(F.col("_h") <= threshold(seen.count(), sample)).orderBy("_h").limit(sample).select("id", "y")

    def rows(batches):
        for r, data, offsets in K.blocks(batches):
            x = features(data, offsets)
            yield pa.RecordBatch.from_arrays([r.column(1), r.column(2), pa.array(list(x), pa.list_(pa.float64()))], ["doc_id", "y", "x"])

    few = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).join(picked, F.col("doc_id") == F.col("id"))
    few = few.groupBy("doc_id", "y").agg(F.min("text").alias("text")).select("text", "doc_id", "y")
    got = few.mapInArrow(rows, "doc_id bigint, y double, x array<double>").toArrow()
    if not got.num_rows:
        return AdditiveModel().fit(np.zeros((0, len(FEATURES))), np.zeros(0))
    got = got.sort_by("doc_id")  # the same model whatever the order of the rows
    x = np.array(got.column("x").to_pylist())
    return AdditiveModel().fit(x, got.column("y").to_numpy())


def score_quality(docs: DataFrame, model: AdditiveModel, least: float = 0.3) -> DataFrame:
    """doc_id, score and predicted (score >= least) of each whole text; null and empty texts are scored as empty.

    Every row is scored by its text alone: repeated rows and null ids give a row
    each, other columns are ignored, an empty table gives no rows.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)  # a few tables: fixed

    def run(batches):
        for rows, data, offsets in K.blocks(batches):
            s = held.value.score(features(data, offsets))
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(s), pa.array((s >= least).astype(np.int32))], ["doc_id", "score", "predicted"])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id bigint, score double, predicted int")
