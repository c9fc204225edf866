"""Language ID by averaged hashed subword embeddings (operator 8).

A text's subwords are the 2-, 3- and 4-byte runs of its lower-cased UTF-8 that
hold no ASCII white space, hashed into BUCKETS rows. The text's vector is the mean
of the rows' embeddings; a linear softmax names the language. Both are trained by
stochastic gradient descent in numpy on a bounded sample of training documents.
Prediction needs only embeddings times softmax weights, one small row per bucket.
Probabilities are tempered on a part of the sample kept aside, where a rejection
threshold is set as well: ``rejected`` marks predictions under it.

Cases: null texts and texts without a letter are 'und' with score 0; null lang
teaches nothing; with no training document everything is 'und'; rows repeated with
one doc_id each come back; an empty table gives an empty result; other columns are
ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerflow.llm.common import doc_columns
from ledgerflow.llm.pairwise_quality import remainder

SAMPLE = 1_000       # training documents of each language, at most
BUCKETS = 1 << 15
DIM = 12
SIZES = (2, 3, 4)    # bytes in a subword
EPOCHS = 4
FOLDS, HELD_OUT = 4, 2
REJECT_QUANTILE = 0.01
CHUNK = 1 << 16      # bytes hashed at once
_LETTER = regex.compile(r"\p{L}")


def subwords(text: str):
    """Bucket numbers of the whole text's subwords, in chunks."""
    data = np.frombuffer(f" {text.lower()} ".encode("utf-8", "surrogatepass"), np.uint8)
    blank = (data == 32) | ((data >= 9) & (data <= 13))
    data = np.where(blank, np.uint8(32), data).astype(np.uint32)
    for at in range(0, len(data), CHUNK):
        part, gap = data[at:at + CHUNK + max(SIZES) - 1], blank[at:at + CHUNK + max(SIZES) - 1]
        for n in SIZES:
            m = min(len(part) - n + 1, CHUNK)
            if m <= 0:
                continue
            h = np.full(m, np.uint32(n * 0x9E3779B1 & 0xFFFFFFFF), np.uint32)
            inner = np.zeros(m, bool)
            for j in range(n):  # a blank may stand at the ends, as the word's edge
                h = (h ^ part[j:j + m]) * np.uint32(0x85EBCA6B)
                h ^= h >> np.uint32(15)
                if 0 < j < n - 1 or n == 2:
                    inner |= gap[j:j + m]
            yield (h[~inner] >> np.uint32(3)) & np.uint32(BUCKETS - 1)


def bag(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(buckets, weights): the text's distinct subwords with their shares."""
    total = np.zeros(BUCKETS)
    for h in subwords(text):
        total += np.bincount(h, minlength=BUCKETS)
    at = np.flatnonzero(total)
    return at, total[at] / max(1, total.sum())


@dataclass
class LanguageModel:
    langs: list[str]
    table: np.ndarray   # BUCKETS x languages: embeddings times softmax weights
    bias: np.ndarray
    warmth: float = 1.0
    reject: float = 0.0

    def logits(self, text: str) -> np.ndarray:
        total, n = np.zeros(len(self.langs)), 0
        for h in subwords(text):
            total += self.table[h].sum(axis=0)
            n += len(h)
        return total / max(1, n) + self.bias

    def predict(self, text: str | None) -> tuple[str, float]:
        if text is None or not self.langs or not _LETTER.search(text):
            return "und", 0.0
        z = self.logits(text) * self.warmth
        p = np.exp(z - z.max())
        p /= p.sum()
        return self.langs[int(p.argmax())], float(p.max())


def fit(texts: list[str], langs: list[str], epochs: int = EPOCHS) -> LanguageModel:
    return fit_bags([bag(t) for t in texts], langs, epochs)


def fit_bags(bags: list[tuple[np.ndarray, np.ndarray]], langs: list[str], epochs: int = EPOCHS,
             rate: float = 0.5) -> LanguageModel:
    names = sorted(set(langs))
    rng = np.random.default_rng(8)
    e = rng.uniform(-1 / DIM, 1 / DIM, (BUCKETS, DIM))
    w, b = np.zeros((DIM, len(names))), np.zeros(len(names))
    y = np.array([names.index(x) for x in langs])
    aside = rng.random(len(y)) < 0.2 if len(y) >= 50 else np.zeros(len(y), bool)
    order = np.flatnonzero(~aside)
    steps, step = max(1, epochs * len(order)), 0
    for _ in range(epochs):
        for i in rng.permutation(order):
            at, share = bags[i]
            lr = rate * (1 - step / steps)
            step += 1
            x = share @ e[at]
            z = x @ w + b
            p = np.exp(z - z.max())
            p /= p.sum()
            p[y[i]] -= 1
            back = w @ p
            w -= lr * np.outer(x, p)
            b -= 0.05 * lr * p
            e[at] -= lr * len(at) ** 0.5 * share[:, None] * back
    model = LanguageModel(names, e @ w, b)
    check = np.flatnonzero(aside) if aside.any() else order
    if len(check):
        z = np.array([bags[i][1] @ model.table[bags[i][0]] + b for i in check])
        best = (np.inf, 1.0)
        for warmth in np.geomspace(0.25, 16, 40):
            s = z * warmth
            s -= s.max(axis=1, keepdims=True)
            lp = s - np.log(np.exp(s).sum(axis=1, keepdims=True))
            best = min(best, (-lp[np.arange(len(check)), y[check]].mean(), warmth))
        model.warmth = float(best[1])
        s = np.exp(z * model.warmth - (z * model.warmth).max(axis=1, keepdims=True))
        model.reject = float(np.quantile((s / s.sum(axis=1, keepdims=True)).max(axis=1), REJECT_QUANTILE))
    return model


def train(docs: DataFrame, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text",
          lang_col: str = "lang") -> LanguageModel:
    """Fit on at most ``sample`` whole texts of each of the languages, outside the
    held-out fold, taken by the hash of their ids."""
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"),
                    F.col(lang_col).cast("string").alias("lang"))
    d = d.where("doc_id is not null and text is not null and lang is not null").where(
        remainder(F.col("doc_id"), FOLDS) != HELD_OUT)
    # the sample of a language is its ids of least hash; those far above the hash that so
    # many are expected to stay under are left out before they are ranked
    spread = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 53)) / float(1 << 53)
    sizes = d.groupBy("lang").agg(F.count("*").alias("n"))
    near = d.select("doc_id", "lang", spread.alias("u")).join(F.broadcast(sizes), "lang").where(
        F.col("u") * F.col("n") <= sample + 6 * sample ** 0.5)
    place = F.row_number().over(Window.partitionBy("lang").orderBy("u", "doc_id"))
    ids = near.withColumn("place", place).where(F.col("place") <= sample).select("doc_id")

    def run(batches):
        for pdf in batches:
            keep = [(x, *bag(t)) for x, t in zip(pdf["lang"], pdf["text"]) if _LETTER.search(t)]
            yield pd.DataFrame([(x, at.astype(np.int32).tobytes(), share.astype(np.float32).tobytes())
                                for x, at, share in keep], columns=["lang", "at", "share"])

    # in one order, so that the fit doesn't depend on how Spark joined and partitioned
    rows = sorted(d.join(ids.distinct(), "doc_id").select("lang", "text").mapInPandas(
        run, "lang string, at binary, share binary").collect())
    return fit_bags([(np.frombuffer(r["at"], np.int32), np.frombuffer(r["share"], np.float32)) for r in rows],
                    [r["lang"] for r in rows])


def predict_columns(model: LanguageModel):
    """Column of texts -> struct(lang_pred, score, rejected)."""
    @F.pandas_udf("lang_pred string, score double, rejected boolean")
    def predict(texts: pd.Series) -> pd.DataFrame:
        out = [model.predict(t) for t in texts]
        return pd.DataFrame({"lang_pred": [x for x, _ in out], "score": [s for _, s in out],
                             "rejected": [x == "und" or s < model.reject for x, s in out]})

    return predict


def language_of(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, lang_pred, score, rejected) for every document."""
    d = doc_columns(docs, id_col, text_col)
    held = F.coalesce(remainder(F.col("doc_id"), FOLDS) == HELD_OUT, F.lit(False))
    return (d.select("doc_id", held.alias("held_out"), predict_columns(model)("text").alias("p"))
            .select("doc_id", "held_out", "p.lang_pred", "p.score", "p.rejected"))
