"""Document quality by positive-unlabelled learning."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.llm._common import sampled, spans, table, whole_batches
from tidewell.llm.langid import held_out

CHARS_AT_ONCE = 500_000
#: Character classes: the signs that have a class of their own; other signs, letters, digits and blanks share one each.
SIGNS = ".,;:!?'\"()|*#$%&@/-_<>=+"
OTHER, LOWER, UPPER, DIGIT, BLANK, BREAK, LETTER = range(7)
CLASSES = 7 + len(SIGNS)
WIDTH = CLASSES * CLASSES + 6


@lru_cache(1)
def _class_table() -> np.ndarray:
    """The class of every code point below 2**16; above, letters and signs alike are OTHER."""
    out = np.zeros(1 << 16, np.int64)
    for c in range(1 << 16):
        x = chr(c)
        out[c] = BREAK if x in "\n\r" else BLANK if x.isspace() else DIGIT if x.isdigit() else LOWER if x.islower() else UPPER if x.isupper() else LETTER if x.isalpha() else OTHER
    for i, x in enumerate(SIGNS):
        out[ord(x)] = 7 + i
    return out


def features(texts: list[str]) -> np.ndarray:
    """Per text: how often each class follows each class, then length, word length and repetition measures."""
    out = np.zeros((len(texts), WIDTH), np.float32)
    joined = "".join(texts)
    if not joined:
        return out
    code = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    kind = _class_table()[np.minimum(code, 0xFFFF)]
    sizes = np.array([len(t) for t in texts])
    text = np.repeat(np.arange(len(texts)), sizes)
    pair = kind[:-1] * CLASSES + kind[1:]
    same = text[:-1] == text[1:]
    counts = np.bincount((text[:-1] * CLASSES**2 + pair)[same], minlength=len(texts) * CLASSES**2).reshape(len(texts), -1)
    out[:, : CLASSES**2] = np.sqrt(counts / np.maximum(sizes - 1, 1)[:, None])
    for i, t in enumerate(texts):
        words, lines = t.split(), t.split("\n")
        if words:
            out[i, CLASSES**2 :] = (np.log1p(len(t)), np.log1p(len(words)), len(t) / len(words) / 10, len(set(words)) / len(words), len(set(lines)) / len(lines), np.log1p(len(words) / len(lines)))
    return out


def _feature_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        texts = pdf["text"].fillna("")
        for lo, hi in spans(texts.str.len().to_numpy(), CHARS_AT_ONCE):
            yield pdf.iloc[lo:hi].drop(columns="text").assign(x=[x.tobytes() for x in features(texts.iloc[lo:hi].to_list())])


@dataclass(frozen=True)
class Model:
    weights: np.ndarray
    bias: float
    mean: np.ndarray
    scale: np.ndarray
    prior: float

    def score(self, x: np.ndarray) -> np.ndarray:
        z = ((x - self.mean) / self.scale) @ self.weights + self.bias
        return 1 / (1 + np.exp(-np.clip(z.astype(np.float64), -40, 40)))


def nnpu(w: np.ndarray, b: float, p: np.ndarray, u: np.ndarray, prior: float, decay: float) -> tuple[float, float, np.ndarray]:
    """(bounded part, bracket, gradient to follow) of the non-negative risk of a logistic model on rows ``p`` and ``u``.

    With l the logistic loss: risk = prior E_p l(g) + max(0, bracket), bracket = E_u l(-g) - prior E_p l(-g), and a
    ridge on w. Where the bracket falls below zero its gradient is followed upward, as the non-negative estimator does,
    so the flexible part can't be driven below what a risk can be.
    """
    sig = lambda z: 1 / (1 + np.exp(-np.clip(z, -40, 40)))
    gp, gu = p @ w + b, u @ w + b
    bounded = prior * np.logaddexp(0, -gp).mean() + 0.5 * decay * (w**2).sum()
    bracket = np.logaddexp(0, gu).mean() - prior * np.logaddexp(0, gp).mean()
    up, down = sig(gp) / len(p), sig(gu) / len(u)
    if bracket >= 0:
        dp, du = prior * ((sig(gp) - 1) / len(p) - up), down
    else:
        dp, du = prior * up, -down
    return float(bounded), float(bracket), np.concatenate([p.T @ dp + u.T @ du + decay * w, [dp.sum() + du.sum()]])


def fit_nnpu(x: np.ndarray, positives: int, prior: float, steps: int = 400, rate: float = 0.03, decay: float = 1e-3) -> Model:
    """Logistic model with the least non-negative unbiased risk. ``x``: the positives' rows, then unlabelled ones, in
    single precision; it is standardised in place."""
    mean = x.mean(axis=0, dtype=np.float64)
    square = np.einsum("ij,ij->j", x, x, dtype=np.float64) / len(x)
    scale = np.sqrt(np.maximum(square - mean**2, 0)) + 1e-3
    x -= mean.astype(np.float32)
    x /= scale.astype(np.float32)
    p, u = x[:positives], x[positives:]
    w, b = np.zeros(p.shape[1], np.float32), np.float32(0)
    first, second = np.zeros(len(w) + 1), np.zeros(len(w) + 1)
    for t in range(1, steps + 1):
        grad = nnpu(w, b, p, u, prior, decay)[2]
        first, second = 0.9 * first + 0.1 * grad, 0.999 * second + 0.001 * grad**2
        step = rate * (first / (1 - 0.9**t)) / (np.sqrt(second / (1 - 0.999**t)) + 1e-8)
        w, b = (w - step[:-1]).astype(np.float32), np.float32(b - step[-1])
    return Model(w, float(b), mean, scale, prior)


def estimate_prior(positive: np.ndarray, unlabelled: np.ndarray, delta: float = 0.1, gamma: float = 0.01) -> float:
    """The share of positives among the unlabelled, from scores that the model was not fitted on; no negative is used.

    Above any score, the unlabelled share can be no less than prior x the positives' share. The ratio of both shares
    is thus a bound of the prior at every score, and tight where hardly a negative scores so high. The score with the
    least bound is taken, with the sampling error of both shares counted against scores that few positives reach.
    """
    cuts = np.unique(np.concatenate([positive, unlabelled]))
    above = lambda x: 1 - np.searchsorted(np.sort(x), cuts, "left") / len(x)
    p, u = above(positive), above(unlabelled)
    p, u = p[p > 0], u[p > 0]
    error = np.sqrt(np.log(4 / delta) / 2 / len(positive)) + np.sqrt(np.log(4 / delta) / 2 / len(unlabelled))
    return float((u / p)[np.argmin((u + (1 + gamma) * error) / p)])


def learn(docs: DataFrame, labels: DataFrame, sample: int = 4096) -> Model | None:
    """Fit on at most ``sample`` trusted positives and ``sample`` unlabelled texts (the first by a hash of doc_id).

    Only rows that are not held out (remainder 0 of 5) are used, and of the labels only those of quality 1. The class
    prior is estimated from a fit on every other row of the sample and the scores of the others, kept within 0.05 to
    0.95. None if there is no positive or no text at all.
    """
    own = lambda df: df.where(~held_out(5, 0) & F.col("doc_id").isNotNull())
    p = sampled(own(labels).where("quality = 1").select("doc_id"), ["doc_id"], sample).distinct().withColumn("positive", F.lit(True))
    u = sampled(own(docs).select("doc_id"), ["doc_id"], sample).distinct().withColumn("positive", F.lit(False))
    ids = F.broadcast(p.unionByName(u))  # 2 x sample rows at most
    texts = docs.select("doc_id", "text").join(ids, "doc_id").select("positive", F.xxhash64("doc_id", "text").alias("place"), "text")
    got = texts.mapInPandas(_feature_rows, "positive boolean, place long, x binary").toPandas()
    if got.empty or got["positive"].all() or not got["positive"].any():
        return None
    got = got.sort_values(["positive", "place"], ascending=[False, True], kind="stable")
    x, positives = np.frombuffer(bytearray().join(got["x"]), np.float32).reshape(len(got), WIDTH), int(got["positive"].sum())
    del got
    prior = 0.5
    if positives > 1 and len(x) - positives > 1:
        first = np.concatenate([x[:positives:2], x[positives::2]])
        half = fit_nnpu(first, (positives + 1) // 2, prior)
        prior = estimate_prior(half.score(x[1:positives:2]), half.score(x[positives + 1 :: 2]))
    return fit_nnpu(x, positives, float(np.clip(prior, 0.05, 0.95)))


def score(docs: DataFrame, model: Model | None, threshold: float = 0.3, keep_text: bool = False) -> DataFrame:
    """Each row of ``docs``, without its text unless it is to be kept, plus score and predicted (1 if score >= threshold).

    Null and empty texts get the score of a text without characters; without a model every text gets 0.5.
    Columns that a caller named score or predicted are replaced.
    """
    docs = docs.drop("score", "predicted")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for whole in batches:
            for pdf, texts in whole_batches(whole, whole["text"].fillna(""), CHARS_AT_ONCE):
                out = model.score(features(texts)) if model else np.full(len(pdf), 0.5)
                yield (pdf if keep_text else pdf.drop(columns="text")).assign(score=out, predicted=(out >= threshold).astype("int32"))

    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if keep_text or f.name != "text")
    return docs.mapInPandas(run, ", ".join(x for x in (kept, "score double, predicted int") if x))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    rows = docs.select("doc_id", held_out(5, 0).alias("held_out"), "text")
    return score(rows, learn(docs, table(spark, sf_dir, "labels")))


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the documents that are predicted to be of quality 1.

    Null and empty texts are judged as a text without characters; texts are read whole, however long; repeated rows
    share their verdict; no rows give none. A caller's columns keep their names and values, whatever they are called.
    """
    renamed = docs.toDF(*[c if c == "text" else f"d_{c}" for c in docs.columns])
    judged = score(renamed, learn(docs, table(spark, sf_dir, "labels")), keep_text=True)
    return judged.where("predicted = 1").select(*[F.col(c if c == "text" else f"d_{c}").alias(c) for c in docs.columns])
