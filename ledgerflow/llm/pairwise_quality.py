"""Quality classifier by Bradley-Terry pairwise ranking (operator 6).

Every whole text becomes a short vector of features (repetition, letter case,
symbols, word shapes). Every labelled training document takes part in the fit: each
good document is preferred to each bad one, and a weight vector is learned by logistic
loss on the feature differences of all these pairs: w.x is then the document's
Bradley-Terry strength. A pair's loss depends on its two strengths alone, so each round
is two passes of Spark over the stored features: one counts the strengths of either
kind, one sums every document's pull, which is its loss against all counted opponents.
The threshold is a quantile of the training strengths, the share of bad labels among
all training documents; strengths are mapped to 0..1 by a logistic curve fitted on
them all and shifted so that the threshold lands on CUT. Sums are of whole steps, hence
exact, and don't depend on how Spark partitioned the rows.

Cases: null and empty texts have the vector of an empty text and get its score;
labels that are null or of documents that don't exist teach nothing; with only one
kind of label, or none, every score is 0.5; rows repeated with one doc_id each come
back; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerflow.llm.common import doc_columns, stored

PAIRS = 200_000     # preference pairs that ``fit`` draws from vectors in memory
ROUNDS = 25         # of the fit on all pairs, at most
L2 = 1e-4
CUT = 0.3           # scores from here on predict label 1
FOLDS, HELD_OUT = 5, 0
Z_STEP, W_STEP, PULL_STEP = 2.0 ** 12, 2.0 ** 20, 2.0 ** 20  # steps to one of what is summed
RAW_STEP, RAW_MOST = 2.0 ** 16, 4096.0  # of features, for their mean and deviation
BINS, BIN = 4096, 64                    # strengths are counted in bins, 64 to one

_SYMBOLS = re.compile(r"[^\w\s.,;:'\"()\-]")
_TOKENS = re.compile(r"[^\x20\x09-\x0D]+")


def features(text: str | None) -> list[float]:
    """Shares, so that long and short texts compare; log length besides."""
    text = text or ""
    words = _TOKENS.findall(text)
    n, chars = max(1, len(words)), max(1, len(text))
    lower = [w.lower() for w in words]
    distinct = len(set(lower))
    same_next = sum(map(str.__eq__, lower, lower[1:]))
    pairs = len(set(zip(lower, lower[1:])))
    lines = [x for x in text.split("\n") if x.strip()]
    letters = sum(map(len, re.findall(r"[^\W\d_]+", text)))
    upper = len(re.findall(r"[A-ZÀ-ÖØ-Þ]", text))
    symbols = len(_SYMBOLS.findall(text))
    odd_words = sum(1 for w in words if _SYMBOLS.search(w))
    shouted = sum(1 for w in words if len(w) > 1 and w.upper() == w and w.lower() != w)
    return [
        np.log1p(len(words)), distinct / n, same_next / n, pairs / max(1, n - 1), letters / chars,
        upper / max(1, letters), symbols / chars, odd_words / n, shouted / n, text.count("|") / n,
        text.count("!") / n, text.count(".") / n, text.count(",") / n, len(lines) / n,
        len(set(lines)) / max(1, len(lines)), letters / n, sum(1 for w in words if len(w) > 20) / n,
        sum(1 for w in words if len(w) == 1) / n, sum(1 for w in words if w.isdigit()) / n,
        text.count("http") / n, text.count("@") / n, text.count("{") / n,
        np.log1p(max(map(len, words), default=0)),
        sum(1 for w in words if w[:1].isupper()) / n,
        sum(1 for w in words if w[-1:] in ".,;:!?") / n,
    ]


def shaped(x: np.ndarray) -> np.ndarray:
    """Each feature with its square root: small shares of junk count as well."""
    return np.concatenate([x, np.sqrt(np.abs(x))], axis=1)


def steps(x: np.ndarray, mean: np.ndarray, scale: np.ndarray) -> np.ndarray:
    """Standardised features in whole steps."""
    return np.rint(np.clip((shaped(x) - mean) / scale, -8, 8) * Z_STEP)


@dataclass
class Ranker:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    slope: float
    threshold: float

    def strength(self, x: np.ndarray) -> np.ndarray:
        return steps(x, self.mean, self.scale) / Z_STEP @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        z = self.slope * (self.strength(x) - self.threshold) + np.log(CUT / (1 - CUT))
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def weighted_quantile(x: np.ndarray, weights: np.ndarray, q: float) -> float:
    """``np.quantile`` of values that stand for ``weights`` values each."""
    order = np.argsort(x, kind="stable")
    x, w = x[order], weights[order]
    middle = np.cumsum(w) - w / 2
    return float(np.interp(middle[0] + q * (middle[-1] - middle[0]), middle, x))


def fit(good: np.ndarray, bad: np.ndarray, pairs: int = PAIRS, epochs: int = 6, l2: float = 1e-4,
        counts: tuple[int, int] | None = None) -> Ranker:
    """For vectors in memory: weights by minibatch gradient descent (Adam) on drawn pairs;
    ``counts`` are the good and bad documents that ``good`` and ``bad`` are a sample of."""
    rng = np.random.default_rng(6)
    raw = shaped(np.concatenate([good, bad]))
    mean, scale = raw.mean(axis=0), raw.std(axis=0) + 1e-6
    z = np.clip((raw - mean) / scale, -8, 8)
    g, b = z[:len(good)], z[len(good):]
    w = np.zeros(z.shape[1])
    m, v, t = np.zeros_like(w), np.zeros_like(w), 0
    for _ in range(epochs):
        i, j = rng.integers(0, len(g), pairs), rng.integers(0, len(b), pairs)
        for at in range(0, pairs, 1024):
            d = g[i[at:at + 1024]] - b[j[at:at + 1024]]
            grad = -(d * (1 / (1 + np.exp(np.clip(d @ w, -40, 40))))[:, None]).mean(axis=0) + l2 * w
            t += 1
            m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad ** 2
            w -= 0.02 * (m / (1 - 0.9 ** t)) / (np.sqrt(v / (1 - 0.999 ** t)) + 1e-9)
    s = z @ w
    n_good, n_bad = counts or (len(good), len(bad))
    weights = np.concatenate([np.full(len(good), n_good / len(good)), np.full(len(bad), n_bad / len(bad))])
    threshold = weighted_quantile(s, weights, n_bad / (n_good + n_bad))
    # slope of the logistic curve through the threshold, by one-dimensional search
    y = np.concatenate([np.ones(len(good)), np.zeros(len(bad))])
    slopes = np.geomspace(0.05, 20, 60) / (s.std() + 1e-9)
    loss = [(weights * np.logaddexp(0, -(2 * y - 1) * (k * (s - threshold) + np.log(CUT / (1 - CUT))))).mean()
            for k in slopes]
    return Ranker(mean, scale, w, float(slopes[int(np.argmin(loss))]), threshold)


def remainder(doc_id, folds: int):
    """crc32 of the id's decimal text, modulo ``folds``."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(folds))


def featured(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, x) of every document, stored: the one pass over the texts."""
    @F.pandas_udf("array<double>")
    def x(texts: pd.Series) -> pd.Series:
        return pd.Series([features(t) for t in texts], dtype=object)

    return stored(doc_columns(docs, id_col, text_col).select("doc_id", x("text").alias("x")), "features")


def total(rows: DataFrame, summed: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> np.ndarray:
    """Sum over all (y, x) of what ``summed`` makes of a batch, in whole numbers; one
    vector a task reaches the driver."""
    def run(batches):
        acc = None
        for b in batches:
            y = b.column(0).to_numpy(zero_copy_only=False)
            x = b.column(1).flatten().to_numpy(zero_copy_only=False)
            if len(y):
                part = summed(y, x.reshape(len(y), -1)).astype(np.int64)
                acc = part if acc is None else acc + part
        if acc is not None:
            yield pa.RecordBatch.from_pydict({"v": pa.array([acc], pa.list_(pa.int64()))})

    parts = [np.array(r["v"], dtype=object) for r in rows.mapInArrow(run, "v array<long>").collect()]
    return sum(parts).astype(float)


def counted(w: np.ndarray, mean: np.ndarray, scale: np.ndarray, lowest: int, width: int):
    """Counts of bad and good strengths, by bins of ``width`` steps from ``lowest`` on;
    what lies outside is counted in the first or last bin."""
    def summed(y, x):
        s = steps(x, mean, scale) @ (w * W_STEP)
        at = np.clip((s - lowest) // width, 0, BINS - 1).astype(np.int64)
        return np.bincount(at + BINS * y, minlength=2 * BINS)

    return summed


def pulled(w: np.ndarray, mean: np.ndarray, scale: np.ndarray, lowest: int, width: int, pull: np.ndarray):
    """Sum of the vectors of bad, then good documents, each times the pull of its bin."""
    def summed(y, x):
        z = steps(x, mean, scale)
        at = np.clip((z @ (w * W_STEP) - lowest) // width, 0, BINS - 1).astype(np.int64)
        p = pull[at + BINS * y]
        return np.concatenate([(p * (y == k)) @ z for k in (0, 1)])

    return summed


def fit_all(rows: DataFrame, rounds: int = ROUNDS) -> Ranker | None:
    """Bradley-Terry weights from all pairs of a good and a bad one among (y, x), by
    quasi-Newton steps (BFGS); in the losses strengths are rounded to bins."""
    def first(y, x):
        raw = np.rint(np.clip(shaped(x), -RAW_MOST, RAW_MOST) * RAW_STEP)
        squares = np.rint(raw * raw / RAW_STEP)
        return np.concatenate([[(y == 0).sum(), (y == 1).sum()], raw.sum(axis=0), squares.sum(axis=0)])

    got = total(rows, first) if not rows.isEmpty() else np.zeros(2)
    n = got[:2]
    if not n.all():
        return None
    mean, square = got[2:].reshape(2, -1) / RAW_STEP / n.sum()
    scale = np.sqrt(np.maximum(square - mean ** 2, 0)) + 1e-6

    def second(y, x):
        z = steps(x, mean, scale)
        return np.concatenate([np.r_[z[y == k].sum(axis=0), (z[y == k].T @ z[y == k]).ravel()] for k in (0, 1)])

    moments = total(rows, second).reshape(2, -1) / n[:, None]
    dims = len(mean)
    m, mm = moments[:, :dims] / Z_STEP, moments[:, dims:].reshape(2, dims, dims) / Z_STEP ** 2
    # mean square of all differences / 4 bounds the curvature of the loss
    start = (mm.sum(axis=0) - np.outer(m[0], m[1]) - np.outer(m[1], m[0])) / 4 + L2 * np.eye(dims)
    inverse = np.linalg.inv(start)

    width = int(Z_STEP * W_STEP / BIN)
    lowest = -width * (BINS // 2)
    apart = np.arange(1 - BINS, BINS) / BIN     # of two bins
    lost = 1 / (1 + np.exp(np.clip(apart, -40, 40)))  # share of the pull that a lead leaves
    loss_of = np.logaddexp(0, -apart)

    def against(table, others):  # per bin, the mean of the table over all opponents
        return np.convolve(table, others, "valid") / others.sum()

    def look(w):
        """Counts by kind, the loss, and the pull of either kind's bins."""
        bad, good = total(rows, counted(w, mean, scale, lowest, width)).reshape(2, BINS)
        loss = good @ against(loss_of, bad) / n[1] + L2 / 2 * w @ w
        return (bad, good), loss, np.concatenate([against(lost[::-1], good), against(lost, bad)])

    def gradient(w, pull):
        whole = np.rint(pull * PULL_STEP)
        down, up = total(rows, pulled(w, mean, scale, lowest, width, whole)).reshape(2, -1) / (PULL_STEP * Z_STEP)
        return down / n[0] - up / n[1] + L2 * w

    w = np.zeros(dims)
    counts, loss, pull = look(w)
    g = gradient(w, pull)
    for _ in range(rounds):
        d = -inverse @ g
        if -(g @ d) < 1e-6:
            break
        share = 1.0
        while share > 0.05:
            new = np.rint((w + share * d) * W_STEP) / W_STEP
            new_counts, new_loss, new_pull = look(new)
            if new_loss < loss:
                break
            share /= 4
        else:
            break
        new_g = gradient(new, new_pull)
        s, y = new - w, new_g - g
        if s @ y > 1e-12:
            left = np.eye(dims) - np.outer(s, y) / (s @ y)
            inverse = left @ inverse @ left.T + np.outer(s, s) / (s @ y)
        done = loss - new_loss < 1e-5 * loss
        w, g, loss, counts, pull = new, new_g, new_loss, new_counts, new_pull
        if done:
            break

    bad, good = counts
    # the strength that as many have below it as labels are bad: its bin, cut into finer ones
    rank, low, wide, found = n[0], lowest, width, bad + good
    while True:
        upto = np.cumsum(found)
        at = int(np.searchsorted(upto, rank, side="right"))
        if wide == 1:
            break
        low, before = low + at * wide, upto[at] - found[at]
        below = rank - before
        finer = max(1, wide // (BINS - 2))
        inside = total(rows, counted(w, mean, scale, low - finer, finer)).reshape(2, BINS).sum(axis=0)
        # the first bin has all from below; ranks go on from there
        rank, low, wide, found = inside[0] + below, low - finer, finer, inside
    threshold = (low + at * wide) / (Z_STEP * W_STEP)
    # slope of the logistic curve through the threshold, by one-dimensional search
    s = (np.arange(BINS) + 0.5 - BINS // 2) / BIN
    both = bad + good
    spread = np.sqrt(np.average((s - np.average(s, weights=both)) ** 2, weights=both))
    slopes = np.geomspace(0.05, 20, 60) / (spread + 1e-9)
    loss = [sum(k @ np.logaddexp(0, sign * (slope * (s - threshold) + np.log(CUT / (1 - CUT))))
                for k, sign in ((bad, 1), (good, -1))) for slope in slopes]
    return Ranker(mean, scale, w, float(slopes[int(np.argmin(loss))]), float(threshold))


def train(docs: DataFrame, labels: DataFrame, rounds: int = ROUNDS, id_col: str = "doc_id",
          text_col: str = "text", label_col: str = "quality", x: DataFrame | None = None) -> Ranker | None:
    """Fit on all labelled documents outside the held-out fold; ``x`` are the documents
    as ``featured`` has stored them, if it has. Only sums reach the driver."""
    x = featured(docs, id_col, text_col) if x is None else x
    known = (labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("y"))
             .where("doc_id is not null and y is not null")
             .where(remainder(F.col("doc_id"), FOLDS) != HELD_OUT).dropDuplicates(["doc_id"]).where("y in (0, 1)"))
    return fit_all(stored(x.join(known, "doc_id").select("y", "x"), "labelled"), rounds)


def quality_scores(docs: DataFrame, model: Ranker | None, id_col: str = "doc_id",
                   text_col: str = "text", x: DataFrame | None = None) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every document; ``x`` as in ``train``."""
    @F.pandas_udf("double")
    def of_features(x: pd.Series) -> pd.Series:
        return scored(model, list(x))

    d = doc_columns(docs, id_col, text_col) if x is None else x
    score = score_udf(model)("text") if x is None else of_features("x")
    out = d.select("doc_id", F.coalesce(remainder(F.col("doc_id"), FOLDS) == HELD_OUT, F.lit(False)).alias("held_out"),
                   score.alias("score"))
    return out.withColumn("predicted", (F.col("score") >= CUT).cast("int"))


def scored(model: Ranker | None, x: list) -> pd.Series:
    if model is None or not len(x):
        return pd.Series(np.full(len(x), 0.5))
    return pd.Series(model.score(np.array(x)))


def score_udf(model: Ranker | None):
    """Column of texts -> column of scores."""
    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        return scored(model, texts if model is None else [features(t) for t in texts])

    return score


def held_out(doc_id: int) -> bool:
    return zlib.crc32(str(doc_id).encode()) % FOLDS == HELD_OUT
