"""Language identification of texts that may mix languages: expectation-maximisation over n-gram likelihoods."""

from __future__ import annotations

import sys
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.llm._common import spans, table, whole_batches

#: log2 of the number of trigram buckets. The model is one float a bucket and language, whatever the corpus.
BITS = 15
CHARS_AT_ONCE = 500_000


@lru_cache(1)
def _letters() -> np.ndarray:
    return np.array([chr(c).isalpha() for c in range(sys.maxunicode + 1)])


class Words:
    """The words (runs of letters) of some texts: trigram buckets of every letter, and where words and texts start."""

    def __init__(self, texts: list[str]) -> None:
        joined = " ".join(["", *texts, ""])
        code = np.frombuffer(joined.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
        letter = _letters()[code]
        code = np.where(letter, code, 0).astype(np.uint64)
        at = np.flatnonzero(letter)
        mixed = code[at - 1] * np.uint64(0x9E3779B97F4A7C15) + code[at] * np.uint64(0xC2B2AE3D27D4EB4F) + code[at + 1] * np.uint64(0x165667B19E3779F9)
        self.bucket = ((mixed ^ (mixed >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - BITS)).astype(np.int64)
        self.start = np.flatnonzero(~letter[at - 1])  # among the letters: the first of each word
        ends = np.cumsum([len(t.lower()) + 1 for t in texts])  # where each text's closing blank stands
        self.words = np.diff(np.searchsorted(at[self.start], np.concatenate([[0], ends]))) if len(texts) else np.zeros(0, int)
        self.text_of_letter = np.searchsorted(ends, at, side="right")


def _counts(batches: Iterator[pd.DataFrame], langs: list[str]) -> Iterator[pd.DataFrame]:
    total = np.zeros((len(langs), 1 << BITS), np.int64)
    number = {lang: i for i, lang in enumerate(langs)}
    for pdf in batches:
        for lo, hi in spans(pdf["text"].str.len().to_numpy(), CHARS_AT_ONCE):
            part = pdf.iloc[lo:hi]
            words = Words(part["text"].to_list())
            which = part["lang"].map(number).to_numpy()[words.text_of_letter]
            total += np.bincount((which << BITS) + words.bucket, minlength=total.size).reshape(total.shape)
    lang, bucket = np.nonzero(total)
    yield pd.DataFrame({"lang": np.array(langs, object)[lang], "bucket": bucket, "n": total[lang, bucket]})


def train(docs: DataFrame, most_langs: int = 1000) -> tuple[list[str], np.ndarray]:
    """Languages and log-probabilities (bucket x language) of hashed letter trigrams, over every given text.

    ``docs``: text, lang; rows with a null are left out. Counts are summed inside each task, so what is shuffled and
    what reaches the driver is at most one number a language and bucket, however large the corpus. More than
    ``most_langs`` languages are refused, which bounds the model's size.
    """
    docs = docs.where("text is not null and lang is not null").select("text", "lang")
    langs = sorted(r.lang for r in docs.select("lang").distinct().limit(most_langs + 1).collect())
    if len(langs) > most_langs:
        raise ValueError(f"more than {most_langs} languages")
    counts = np.zeros((1 << BITS, len(langs)))
    if langs:
        parts = docs.mapInPandas(lambda it: _counts(it, langs), "lang string, bucket long, n long")
        found = parts.groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
        counts[found["bucket"].to_numpy(int), found["lang"].map({x: i for i, x in enumerate(langs)}).to_numpy(int)] = found["n"]
    smooth = 0.1
    return langs, np.log((counts + smooth) / (counts.sum(axis=0) + smooth * (1 << BITS))).astype(np.float32)


class Mixture:
    """EM for the language proportions of many texts at once; a word belongs to one language."""

    def __init__(self, loglik: np.ndarray, words: np.ndarray, steps: int, penalty: float) -> None:
        self.peak = loglik.max(axis=1, keepdims=True)
        self.lik = np.exp(loglik - self.peak)  # word x language
        self.words, self.steps = words, steps
        self.penalty = penalty * np.log(words + 1.0)

    def fit(self, texts: np.ndarray, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Proportions and log-likelihood (less the peaks) of ``texts`` under the language sets ``chosen`` (0/1 rows)."""
        words = self.words[texts]
        ends = np.cumsum(self.words)
        rows = np.repeat(ends[texts] - words, words) + np.arange(words.sum()) - np.repeat(np.cumsum(words) - words, words)
        lik, starts = self.lik[rows], np.cumsum(words) - words
        share = chosen / chosen.sum(axis=1, keepdims=True)
        for _ in range(self.steps):
            joint = lik * np.repeat(share, words, axis=0)
            joint /= joint.sum(axis=1, keepdims=True) + 1e-300
            share = np.add.reduceat(joint, starts, axis=0) / words[:, None]
        mixed = (lik * np.repeat(share, words, axis=0)).sum(axis=1)
        return share, np.add.reduceat(np.log(mixed + 1e-300), starts)

    def select(self) -> np.ndarray:
        """Grow each text's language set while a further language raises its penalised likelihood."""
        n, langs = len(self.words), self.lik.shape[1]
        starts = np.cumsum(self.words) - self.words
        alone = np.add.reduceat(np.log(self.lik + 1e-300), starts, axis=0)
        chosen = np.zeros((n, langs))
        chosen[np.arange(n), alone.argmax(axis=1)] = 1
        share, score = chosen.copy(), alone.max(axis=1) - self.penalty
        # a further language can win at most what each word would gain by moving to it
        text = np.repeat(np.arange(n), self.words)
        active = np.arange(n)
        for size in range(2, langs + 1):
            held = (self.lik * share[text]).sum(axis=1)
            best, best_share, best_chosen = score.copy(), share.copy(), chosen.copy()
            for lang in range(langs):
                gain = np.add.reduceat(np.log(np.maximum(held, self.lik[:, lang]) + 1e-300) - np.log(held + 1e-300), starts)
                todo = active[(chosen[active, lang] == 0) & (gain[active] > self.penalty[active])]
                if not len(todo):
                    continue
                trial = chosen[todo].copy()
                trial[:, lang] = 1
                s, ll = self.fit(todo, trial)
                penalised = ll - size * self.penalty[todo]
                better = penalised > best[todo]
                best[todo[better]], best_share[todo[better]], best_chosen[todo[better]] = penalised[better], s[better], trial[better]
            active = np.flatnonzero(best > score)
            score, share, chosen = best, best_share, best_chosen
            if not len(active):
                break
        return share


def _predict(batches: Iterator[pd.DataFrame], langs: list[str], table: np.ndarray, steps: int, penalty: float, keep_text: bool) -> Iterator[pd.DataFrame]:
    for whole in batches:
        for pdf, texts in whole_batches(whole, whole["text"].fillna(""), CHARS_AT_ONCE):
            pred, score, mix = np.full(len(pdf), "und", object), np.zeros(len(pdf)), np.full(len(pdf), "", object)
            words = Words(texts)
            some = np.flatnonzero(words.words) if langs else np.zeros(0, int)
            if len(some):
                loglik = np.add.reduceat(table[words.bucket], words.start, axis=0).astype(np.float64)
                share = Mixture(loglik, words.words[some], steps, penalty).select()
                top = share.argmax(axis=1)
                pred[some], score[some] = np.array(langs, object)[top], share[np.arange(len(top)), top]
                mix[some] = [" ".join(f"{langs[j]}:{row[j]:.2f}" for j in np.flatnonzero(row)) for row in share]
            yield (pdf if keep_text else pdf.drop(columns="text")).assign(lang_pred=pred, score=np.clip(score, 0, 1), mixture=mix)


def identify(docs: DataFrame, model: tuple[list[str], np.ndarray], steps: int = 6, penalty: float = 2.0, keep_text: bool = False) -> DataFrame:
    """Each row of ``docs``, without its text unless it is to be kept, plus lang_pred, score (its proportion of the text) and mixture.

    Proportions come from EM over the words' trigram likelihoods; the set of languages grows from the best single
    one while the log-likelihood gains more than ``penalty`` x ln(words + 1) by a further one. A text that is null
    or has no letter, and any text under a model without languages, gets ``und`` and score 0. Whole texts are read;
    one very long text is worked on alone. Columns that a caller named lang_pred, score or mixture are replaced.
    """
    langs, table = model
    shared = docs.sparkSession.sparkContext.broadcast(table)  # buckets x languages, a size fixed by BITS and most_langs
    docs = docs.drop("lang_pred", "score", "mixture")
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if keep_text or f.name != "text")
    schema = ", ".join(x for x in (kept, "lang_pred string, score double, mixture string") if x)
    return docs.mapInPandas(lambda it: _predict(it, langs, shared.value, steps, penalty, keep_text), schema)


def held_out(of: int, remainder: int):
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(of)) == remainder, F.lit(False))


def learn(docs: DataFrame) -> tuple[list[str], np.ndarray]:
    """A model from the rows of ``docs`` that are not held out (remainder 2 of 4)."""
    return train(docs.where(~held_out(4, 2)).select("text", "lang"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    rows = docs.select("doc_id", held_out(4, 2).alias("held_out"), "text")
    return identify(rows, learn(docs))


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str, least: float = 0.5) -> DataFrame:
    """Keep the documents of which one language makes up at least ``least``.

    The texts pass the model once and carry its verdict along, so no row needs to be joined back. Texts that are null or
    have no letter go; texts are read whole, however long; repeated rows share their verdict; no rows give none. A
    caller's columns keep their names and values, whatever they are called.
    """
    renamed = docs.toDF(*[c if c == "text" else f"d_{c}" for c in docs.columns])
    judged = identify(renamed, learn(docs), keep_text=True)
    kept = judged.where((F.col("lang_pred") != "und") & (F.col("score") >= least))
    return kept.select(*[F.col(c if c == "text" else f"d_{c}").alias(c) for c in docs.columns])
