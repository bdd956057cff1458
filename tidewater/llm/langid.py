"""Language identification: a mixture of languages per document, fitted by expectation-maximisation."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.llm.common import Shipped, bound_batches, hash_share

SLOTS = 1 << 16
SAMPLE = 3000
UNKNOWN = "und"
_LETTERS = regex.compile(r"\p{L}[\p{L}\p{M}]*")


def letter_words(text: str | None) -> list[str]:
    """Runs of letters of a whole text, lower-cased."""
    return _LETTERS.findall(text.lower()) if text else []


def word_ngrams(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed letter trigrams of words with their ends marked: slots, and the number of words before each."""
    if not words:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    code = np.frombuffer((" " + " ".join(words) + " ").encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    middle = np.flatnonzero(code[1:-1] != 32) + 1
    mixed = (code[middle - 1] * np.uint64(0x9E3779B97F4A7C15)) ^ (code[middle] * np.uint64(0xC2B2AE3D27D4EB4F))
    mixed = (mixed ^ code[middle + 1]) * np.uint64(0x165667B19E3779F9)
    slots = (mixed >> np.uint64(40)).astype(np.int64) % SLOTS
    return slots, np.cumsum(code == 32)[middle] - 1


@dataclass
class LanguageModel:
    """Languages and, per n-gram slot, the log probability of each."""

    languages: list[str]
    logs: np.ndarray


def fit_languages(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE) -> LanguageModel:
    """Trigram profiles from about ``sample`` hash-picked distinct labelled texts of every language, whole texts.

    Copies of a text within a language count once, both for its size and in its profile. Rows with a null text or language teach nothing. Without any such row there are no languages.
    """
    bound_batches(docs.sparkSession)
    rows = docs.select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).filter("text is not null and lang is not null")
    sizes = rows.select("lang", F.xxhash64("text").alias("h")).distinct().groupBy("lang").agg(F.count("*").alias("size"))
    picked = rows.join(F.broadcast(sizes), "lang").filter(hash_share(sample, F.col("size"), "text")).select("text", "lang").distinct()

    def run(batches):
        held: dict[str, np.ndarray] = {}
        for batch in batches:
            for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                slots, _ = word_ngrams(letter_words(text))
                if lang not in held:
                    held[lang] = np.zeros(SLOTS, np.int64)
                held[lang] += np.bincount(slots, minlength=SLOTS)
        for lang, counts in held.items():
            full = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(full), pa.string()), pa.array(full.astype(np.int32)), pa.array(counts[full])],
                names=["lang", "slot", "n"],
            )

    counted = picked.mapInArrow(run, "lang string, slot int, n bigint").groupBy("lang", "slot").agg(F.sum("n").alias("n")).toPandas()
    languages = sorted(counted["lang"].unique())
    counts = np.zeros((SLOTS, len(languages)))
    for k, lang in enumerate(languages):
        own = counted[counted["lang"] == lang]
        counts[own["slot"], k] = own["n"]
    logs = np.log((counts + 0.1) / (counts + 0.1).sum(axis=0)) if languages else counts
    return LanguageModel(languages, logs.astype(np.float32))


def _expect(p: np.ndarray, n: np.ndarray, starts: np.ndarray, sizes: np.ndarray, share: np.ndarray, steps: int):
    """EM for the shares of the languages in every document, and the log likelihood reached."""
    total = np.add.reduceat(n, starts)
    for _ in range(steps):
        joint = p * np.repeat(share, sizes, axis=0)
        joint *= (n / np.maximum(joint.sum(axis=1), 1e-300))[:, None]
        share = np.add.reduceat(joint, starts, axis=0) / total[:, None]
    mixed = np.maximum((p * np.repeat(share, sizes, axis=0)).sum(axis=1), 1e-300)
    return share, np.add.reduceat(n * np.log(mixed), starts)


def mixtures(docs: list[list[str]], model: LanguageModel, steps: int = 6, penalty: float = 2.0) -> np.ndarray:
    """Language shares of documents given as words; see ``fit_mixtures``."""
    return fit_mixtures(docs, model, steps, penalty)[0]


def fit_mixtures(docs: list[list[str]], model: LanguageModel, steps: int = 6, penalty: float = 2.0) -> tuple[np.ndarray, np.ndarray]:
    """Language shares of documents given as words, zero outside the chosen set, and the known share of the words.

    Words are the units of a document and n-gram likelihoods their evidence. EM over all languages
    ranks them; the set grows from the best one in that order, with EM anew for every set, while
    the log likelihood gains more than ``penalty * log(words + 1)`` per language.

    The known share comes from a last mixture of two components, the chosen languages and a background
    in which every n-gram slot is equally likely: unlearned scripts and random letters fall to it.
    """
    k = len(model.languages)
    out = np.zeros((len(docs), k))
    full = [i for i, words in enumerate(docs) if words]
    known = np.zeros(len(docs))
    if not full or not k:
        return out, known
    number, names = pd.factorize(np.array([w for i in full for w in docs[i]], dtype=object))
    sizes = np.array([len(docs[i]) for i in full])
    key, n = np.unique(np.repeat(np.arange(len(full)), sizes) * len(names) + number, return_counts=True)
    owner, word = key // len(names), key % len(names)
    slots, at = word_ngrams(list(names))
    logs = np.column_stack([np.bincount(at, model.logs[slots, j], len(names)) for j in range(k)])
    top = logs.max(axis=1)
    evidence = np.exp(np.maximum(logs - top[:, None], -60))
    p, n = evidence[word], n.astype(float)
    sizes = np.bincount(owner, minlength=len(full))
    starts = np.cumsum(sizes) - sizes
    words = np.add.reduceat(n, starts)
    share, _ = _expect(p, n, starts, sizes, np.full((len(full), k), 1 / k), steps)
    order = np.argsort(-share, axis=1, kind="stable")
    alone = np.add.reduceat(n[:, None] * np.log(p), starts, axis=0)
    best = np.zeros((len(full), k))
    best[np.arange(len(full)), order[:, 0]] = 1
    reached = alone[np.arange(len(full)), order[:, 0]]
    open_ = np.arange(len(full))
    for m in range(2, k + 1):
        inside = np.zeros((len(open_), k), bool)
        np.put_along_axis(inside, order[open_, :m], True, axis=1)
        begin = np.where(inside, np.maximum(share[open_], 1e-3), 0)
        begin /= begin.sum(axis=1, keepdims=True)
        rows = np.isin(owner, open_) if len(open_) < len(full) else slice(None)
        own = sizes[open_]
        got, now = _expect(p[rows], n[rows], np.cumsum(own) - own, own, begin, steps)
        better = now - reached[open_] > penalty * np.log(words[open_] + 1)
        open_, got, now = open_[better], got[better], now[better]
        if not len(open_):
            break
        best[open_], reached[open_] = got, now
    out[full] = best
    spoken = np.log(np.maximum((p * np.repeat(best, sizes, axis=0)).sum(axis=1), 1e-300)) + top[word]
    noise = -np.log(SLOTS) * np.bincount(at, minlength=len(names))[word]
    against = np.exp(np.clip(np.column_stack([spoken - noise, noise - spoken]), -60, 0))
    known[full] = _expect(against, n, starts, sizes, np.full((len(full), 2), 0.5), 4 * steps)[0][:, 0]
    return out, known


def identify(docs: DataFrame, model: LanguageModel, text_col: str = "text") -> DataFrame:
    """Add ``_tw_language``: ``lang`` (largest share, first in order on a tie), ``score`` (its share), ``set`` and ``known``.

    ``known`` is the share of the words that the chosen languages explain better than equally likely
    n-grams do; the other fields name the nearest learned languages even where it is small. Whole texts are used. A null text, one without letters, or a model without languages gives ``und``,
    score and known 0 and an empty set. Repeated rows get equal results; all columns of ``docs`` stay.
    """
    bound_batches(docs.sparkSession)
    held = Shipped(docs.sparkSession, model)

    @F.pandas_udf("lang string, score double, set array<string>, known double")
    def predict(texts: pd.Series) -> pd.DataFrame:
        fit = held.value
        shares, known = fit_mixtures([letter_words(t) for t in texts], fit)
        if not fit.languages:
            shares = np.zeros((len(texts), 1))
        top, score = shares.argmax(axis=1), shares.max(axis=1)
        return pd.DataFrame({
            "lang": [fit.languages[t] if s > 0 else UNKNOWN for t, s in zip(top, score)],
            "score": np.minimum(score, 1.0),
            "set": [[fit.languages[j] for j in np.flatnonzero(row > 0)] for row in shares],
            "known": np.minimum(known, 1.0),
        })

    return docs.withColumn("_tw_language", predict(F.col(text_col)))


def select_identified(docs: DataFrame, model: LanguageModel, least: float = 0.5) -> DataFrame:
    """Documents in which learned languages explain at least ``least`` of the words; columns as they came.

    A text in several learned languages is kept; one without letters, in an unlearned language or of
    random letters is not.
    """
    found = identify(docs, model)
    return found.filter((F.col("_tw_language.lang") != UNKNOWN) & (F.col("_tw_language.known") >= least)).select(
        *[F.col(f"`{c}`") for c in docs.columns]
    )
