"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from gridloom.llm.common import clean, once

BUCKETS = 1 << 15  # hashed n-grams
ORDERS = (1, 2, 3)  # lengths in characters (code points) of lower-case text
CHUNK = 1 << 20  # n-grams of a text that are hashed at once
PER_LANGUAGE = 600  # training texts drawn for each language, about
EPOCHS = 3
_LETTER = re.compile(r"[^\W\d_]")


def fold(text: str) -> np.ndarray:
    """Code points of the lower-case text; every run of ASCII other than letters is one space.

    A space stands at either end.  Lower-case ASCII letters and all other characters stay.
    """
    x = np.frombuffer((" " + text.lower() + " ").encode("utf-32-le", "surrogatepass"), dtype="<u4")
    border = (x < 128) & ((x < 97) | (x > 122))
    x = np.where(border, np.uint32(32), x)
    return x[np.append(True, ~(border[1:] & border[:-1]))]


def gram_counts(text: str) -> np.ndarray:
    """How often an n-gram of the text falls into each bucket.

    An n-gram is read as a number of 21 bits a character, so different n-grams are different numbers;
    a long text is counted in chunks of n-grams.
    """
    x = fold(text).astype(np.uint64)
    longest = max(ORDERS)
    out = np.zeros(BUCKETS, dtype=np.int64)
    if len(x) < 3:
        return out
    for lo in range(0, len(x), CHUNK):
        part = x[lo : lo + CHUNK + longest - 1]
        code, starts = np.zeros(len(part), dtype=np.uint64), []
        for n in range(1, min(longest, len(part)) + 1):
            code = (code[: len(part) - n + 1] << np.uint64(21)) | part[n - 1 :]
            if n in ORDERS:
                starts.append(code[:CHUNK])
        mixed = np.concatenate(starts) * np.uint64(0x9E3779B97F4A7C15)
        out += np.bincount((mixed >> np.uint64(65 - BUCKETS.bit_length())).astype(np.int64), minlength=BUCKETS)
    return out


def weigh(counts: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sparse TF-IDF vector of unit length: sublinear term counts times ``idf``."""
    at = np.flatnonzero(counts)
    values = (1.0 + np.log(counts[at])) * idf[at]
    norm = np.sqrt((values * values).sum())
    return at, values / norm if norm else values


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


@dataclass
class LanguageModel:
    languages: list[str]
    weights: np.ndarray  # buckets x languages, mostly zero
    bias: np.ndarray
    idf: np.ndarray
    temperature: float = 1.0

    def logits(self, at: np.ndarray, values: np.ndarray) -> np.ndarray:
        return values @ self.weights[at] + self.bias

    def predict(self, text: str | None) -> tuple[str, float]:
        """Most likely language and its calibrated probability; ties go to the first in order."""
        if not isinstance(text, str) or not self.languages or not _LETTER.search(text):
            return "und", 0.0
        p = softmax(self.logits(*weigh(gram_counts(text), self.idf)) / self.temperature)
        k = int(p.argmax())
        return self.languages[k], float(p[k])


def train_ftrl(
    rows: list[tuple[np.ndarray, np.ndarray]], target: np.ndarray, classes: int,
    alpha: float = 0.5, beta: float = 1.0, l1: float = 0.02, l2: float = 0.01, epochs: int = EPOCHS,
) -> tuple[np.ndarray, np.ndarray]:
    """Follow-the-regularised-leader with per-coordinate rates and elastic-net penalties.

    ``z`` gathers gradients, ``n`` their squares; a weight is exactly zero while its ``z`` is within the
    lasso penalty, which keeps the model sparse.  The bias is not penalised.
    """
    z, n = np.zeros((BUCKETS + 1, classes)), np.zeros((BUCKETS + 1, classes))
    penalty = np.full(BUCKETS + 1, l1)
    penalty[-1] = 0.0

    def leader(at):
        zz, nn = z[at], n[at]
        lasso = penalty[at][:, None]
        w = -(zz - np.sign(zz) * lasso) / ((beta + np.sqrt(nn)) / alpha + l2)
        w[np.abs(zz) <= lasso] = 0.0
        return w

    for epoch in range(epochs):
        for k in np.random.default_rng(epoch).permutation(len(rows)):
            at, values = np.append(rows[k][0], BUCKETS), np.append(rows[k][1], 1.0)
            w = leader(at)
            p = softmax(values @ w)
            p[target[k]] -= 1.0
            g = values[:, None] * p
            g2 = g * g
            sigma = (np.sqrt(n[at] + g2) - np.sqrt(n[at])) / alpha
            z[at] += g - sigma * w
            n[at] += g2
    w = leader(np.arange(BUCKETS + 1))
    return w[:-1], w[-1]


def calibrate(logits: np.ndarray, target: np.ndarray) -> float:
    """Temperature of least negative log-likelihood, by golden-section search on its logarithm."""
    def loss(t):
        p = softmax(logits / np.exp(t))
        return -np.log(np.maximum(p[np.arange(len(target)), target], 1e-12)).mean()

    low, high, r = np.log(0.05), np.log(20.0), (np.sqrt(5) - 1) / 2
    for _ in range(40):
        a, b = high - r * (high - low), low + r * (high - low)
        low, high = (low, b) if loss(a) <= loss(b) else (a, high)
    return float(np.exp((low + high) / 2))


def held_out(id_col: str | Column) -> Column:
    """Every fourth document by the checksum of its id is never learned from."""
    c = F.col(id_col) if isinstance(id_col, str) else id_col
    return F.coalesce(F.crc32(c.cast("string")) % 4 == 2, F.lit(False))


def _document_frequency(texts: DataFrame) -> np.ndarray:
    def run(batches):
        total = np.zeros(BUCKETS, dtype=np.int64)
        for frame in batches:
            for t in clean(frame["text"]):
                total += gram_counts(t) > 0
        at = np.flatnonzero(total)
        yield pd.DataFrame({"bucket": at, "n": total[at]})

    counted = texts.select("text").mapInPandas(run, "bucket long, n long")
    out = np.zeros(BUCKETS, dtype=np.int64)
    for r in counted.groupBy("bucket").agg(F.sum("n").alias("n")).toLocalIterator():
        out[r.bucket] = r.n  # at most one row per bucket
    return out


def fit_language(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
    per_language: int = PER_LANGUAGE,
) -> LanguageModel:
    """Learn from the text and language of documents that are not held out.

    Document frequencies cover all of them.  The weights are fitted on a bounded sample, drawn by
    the hash of the text and about ``per_language`` rows for each language; one row in five of
    it is kept from training to fit the temperature.  NULL id, text or language is not learned
    from.  Without any row the model knows no language and predicts ``und``.
    """
    known = df.select(
        F.col(id_col).alias("id_"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")
    ).where(F.col("id_").isNotNull() & ~held_out("id_")).dropna(subset=["text", "lang"])
    known = known.where(F.col("lang") != "und")
    sizes = {r.lang: r.n for r in known.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not sizes:
        return LanguageModel([], np.zeros((BUCKETS, 0)), np.zeros(0), np.ones(BUCKETS))
    frequency = _document_frequency(known)
    idf = np.log((1.0 + sum(sizes.values())) / (1.0 + frequency)) + 1.0
    languages = sorted(sizes)
    scale = 1_000_003
    cut = F.lit(0)
    for lang, n in sizes.items():
        cut = F.when(F.col("lang") == lang, int(min(1.0, per_language / n) * scale)).otherwise(cut)
    drawn = known.where(F.pmod(F.xxhash64("text", "id_"), F.lit(scale)) < cut)

    def run(batches):
        for frame in batches:
            made = [weigh(gram_counts(t), idf) for t in clean(frame["text"])]
            yield pd.DataFrame({
                "id": frame["id_"].astype(str), "lang": frame["lang"],
                "at": [a.astype("int32") for a, _ in made],
                "v": [v.astype("float32") for _, v in made],
            })

    sample = drawn.mapInPandas(run, "id string, lang string, at array<int>, v array<float>").toPandas()
    sample = sample.sort_values(["id", "lang"], ignore_index=True)
    rows = [(np.asarray(a), np.asarray(v, dtype=float)) for a, v in zip(sample["at"], sample["v"])]
    target = np.array([languages.index(x) for x in sample["lang"]], dtype=int)
    spare = np.arange(len(rows)) % 5 == 4
    w, b = train_ftrl([r for r, s in zip(rows, spare) if not s], target[~spare], len(languages))
    model = LanguageModel(languages, w, b, idf)
    if spare.any():
        logits = np.stack([model.logits(*r) for r, s in zip(rows, spare) if s])
        model.temperature = calibrate(logits, target[spare])
    return model


def has_letter(text: str | Column) -> Column:
    """Whether a text is not NULL and has a letter: what ``predict_language`` can name a language of."""

    @F.pandas_udf("boolean")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([isinstance(t, str) and bool(_LETTER.search(t)) for t in texts], dtype=bool)

    return run(F.col(text) if isinstance(text, str) else text)


def predict_language(text: str | Column, model: LanguageModel) -> Column:
    """Struct ``(lang_pred, score)`` of every whole text; ``und``, 0 for NULL or without a letter.

    Only the text is read, so repeated rows get one result and other columns play no part.  Very long
    texts are read whole, in chunks of n-grams.
    """

    @F.pandas_udf("lang_pred string, score double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            yield pd.DataFrame([model.predict(t) for t in texts], columns=["lang_pred", "score"])

    return once(run)(F.col(text) if isinstance(text, str) else text)
