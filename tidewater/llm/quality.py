"""Quality classifier: ordinal cumulative-link regression on hashed text features."""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.llm.common import Shipped, bound_batches, hash_share

SLOTS = 1 << 17
SAMPLE = 8000
LEAST = 0.3
_EDGE = "".join(map(chr, range(33, 48))) + ":;<=>?@[\\]^_`{|}~"


def text_features(text: str | None, known: dict[str, tuple[int, ...]]) -> np.ndarray:
    """Distinct hashed features of a whole text: word cores, how words are written, and doc shape.

    ``known`` remembers the features of words met before.
    """
    words = text.split() if text else []
    found: set[int] = set()
    for word in set(words):
        slots = known.get(word)
        if slots is None:
            slots = known[word] = _word_features(word)
            if len(known) > 100_000:
                known.clear()
        found.update(slots)
    n = len(words)
    upper = sum(map(str.isupper, words))
    marks = sum(not w[-1].isalnum() and w[-1] not in ".,?!" for w in words)
    again = sum(a == b for a, b in zip(words, words[1:]))
    shape = (
        ("length", n.bit_length()), ("upper", _level(upper, n)), ("marks", _level(marks, n)), ("again", _level(again, n)),
        ("distinct", _level(len(set(words)), n)),
    )
    found.update(_slot(f"\t{name} {level}") for name, level in shape)
    return np.fromiter(found, np.int64, len(found))


def _word_features(word: str) -> tuple[int, ...]:
    core = word.strip(_EDGE)
    tail = word[len(word.rstrip(_EDGE)) :]
    out = [_slot(core.lower())] if core else []
    if tail not in ("", ".", ",", "?"):
        out.append(_slot("\ttail " + tail))
    if len(core) > 1 and core.isupper():
        out.append(_slot("\tupper"))
    return tuple(out)


def _slot(name: str) -> int:
    return zlib.crc32(name.encode("utf-8", "surrogatepass")) % SLOTS


def _level(part: int, whole: int) -> int:
    return int(10 * part / whole) if whole else -1


def _sigmoid(x):
    return 0.5 * (1 + np.tanh(0.5 * x))


@dataclass
class OrdinalModel:
    """P(grade >= k) = sigmoid(weights . features - thresholds[k - 1]), thresholds ascending."""

    weights: np.ndarray
    thresholds: np.ndarray

    def tails(self, scores: np.ndarray) -> np.ndarray:
        """P(grade >= 1), P(grade >= 2), ... per row."""
        return _sigmoid(np.asarray(scores)[:, None] - self.thresholds[None])


def fit_ordinal(rows: list[np.ndarray], grades: np.ndarray, n_grades: int, rounds: int = 40, rate: float = 0.5, lasso: float = 1e-4, least: int = 5) -> OrdinalModel:
    """Adagrad with a lasso penalty on the log likelihood of the grades; features in fewer than ``least`` rows stay at zero."""
    weights, thresholds = np.zeros(SLOTS), np.linspace(-1, 1, max(n_grades - 1, 1))
    if not len(rows):
        return OrdinalModel(weights, thresholds)
    seen = np.bincount(np.concatenate(rows), minlength=SLOTS) >= least
    rows = [r[seen[r]] for r in rows]
    square, square_t = np.full(SLOTS, 1e-8), np.full(len(thresholds), 1e-8)
    rng = np.random.default_rng(11)
    for _ in range(rounds):
        order = rng.permutation(len(rows))
        for part in np.array_split(order, max(1, len(rows) // 64)):
            flat, sizes = np.concatenate([rows[i] for i in part]), np.array([len(rows[i]) for i in part])
            owner = np.repeat(np.arange(len(part)), sizes)
            score = np.bincount(owner, weights[flat], len(part))
            y = grades[part]
            tail = np.column_stack([np.ones(len(part)), _sigmoid(score[:, None] - thresholds[None]), np.zeros(len(part))])
            at, above = tail[np.arange(len(part)), y], tail[np.arange(len(part)), y + 1]
            p = np.maximum(at - above, 1e-9)
            g = -(1 - at - above) / len(part)
            grad = np.bincount(flat, g[owner], SLOTS)
            grad_t = np.zeros(len(thresholds))
            low, high = y > 0, y < len(thresholds)
            np.add.at(grad_t, y[low] - 1, (at * (1 - at) / p)[low] / len(part))
            np.add.at(grad_t, y[high], -(above * (1 - above) / p)[high] / len(part))
            square += grad * grad
            square_t += grad_t * grad_t
            step = rate / np.sqrt(square)
            weights -= step * grad
            touched = np.flatnonzero(square > 1e-8)
            shrunk = np.abs(weights[touched]) - np.minimum(step[touched], 10.0) * lasso
            weights[touched] = np.sign(weights[touched]) * np.maximum(shrunk, 0)
            thresholds = np.sort(thresholds - rate * grad_t / np.sqrt(square_t))
    return OrdinalModel(weights, thresholds)


def graded(labels: DataFrame) -> DataFrame:
    """Ratings 0, 1, 2 from the label table: low quality, fair but toxic, good. Null flags count as 0.

    A document with several labels gets its lowest rating; labels without a document id are left out.
    """
    good, toxic = F.coalesce(F.col("quality"), F.lit(0)) > 0, F.coalesce(F.col("toxic"), F.lit(0)) > 0
    rating = F.when(~good, 0).when(toxic, 1).otherwise(2)
    return labels.filter("doc_id is not null").groupBy("doc_id").agg(F.min(rating).alias("grade"))


def fit_quality(docs: DataFrame, ratings: DataFrame, n_grades: int = 3, sample: int = SAMPLE) -> OrdinalModel:
    """Fit on a hash-picked sample of about ``sample`` rated documents, whole texts (a documented bound).

    No rated document gives a model that says 0.5 for every tail.
    """
    bound_batches(docs.sparkSession)
    chosen = ratings.filter(hash_share(sample, ratings.count(), "doc_id"))
    texts = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").filter("text is not null")

    def run(frames):
        known: dict = {}
        for frame in frames:
            slots = [text_features(t, known).astype(np.int32).tobytes() for t in frame["text"]]
            yield pd.DataFrame({"id": frame["doc_id"], "grade": frame["grade"], "slots": slots})

    got = texts.mapInPandas(run, "id bigint, grade int, slots binary").toPandas().sort_values(["id", "slots"])
    rows = [np.frombuffer(s, np.int32).astype(np.int64) for s in got["slots"]]
    model = fit_ordinal(rows, got["grade"].to_numpy(np.int64), n_grades)
    if not len(rows):
        model.thresholds[:] = 0
    return model


def score_quality(docs: DataFrame, model: OrdinalModel, text_col: str = "text") -> DataFrame:
    """Add ``_tw_quality``: ``expected_grade`` and ``tail``, the probability of the best grade.

    Whole texts are scored; a null or empty text has only the features of an empty text. Repeated
    rows get equal scores; all columns of ``docs`` stay.
    """
    bound_batches(docs.sparkSession)
    held = Shipped(docs.sparkSession, model)

    @F.pandas_udf("expected_grade double, tail double")
    def score(texts: pd.Series) -> pd.DataFrame:
        fit, known = held.value, _KNOWN
        total = np.array([fit.weights[text_features(t, known)].sum() for t in texts])
        tails = fit.tails(total)
        return pd.DataFrame({"expected_grade": tails.sum(axis=1), "tail": tails[:, -1]})

    return docs.withColumn("_tw_quality", score(F.col(text_col)))


_KNOWN: dict[str, tuple[int, ...]] = {}


def select_quality(docs: DataFrame, ratings: DataFrame, least: float = LEAST) -> DataFrame:
    """Documents whose probability of the best grade is at least ``least``; columns as they came."""
    scored = score_quality(docs, fit_quality(docs, ratings))
    return scored.filter(F.col("_tw_quality.tail") >= least).select(*[F.col(f"`{c}`") for c in docs.columns])
