"""Quality by positive-unlabelled learning: trusted positives against unlabelled text, with an estimated class prior.

Each text gives a few statistics of its words, marks and lines, in one pass over the texts; all that
follows works on these. The model is a logistic curve over piecewise linear functions of them, with
knots at quantiles of the unlabelled texts. It minimises the non-negative unbiased risk

    prior * loss(positives as 1) + max(0, loss(unlabelled as 0) - prior * loss(positives as 0)),

whose second part stands for the loss of the negatives, which no label marks: labels of 0 are not
learnt from. Where that part falls below zero the model overfits, and the step goes the other way.

The prior is estimated from positives and unlabelled texts that a first model was not fitted on: of
the shares of both that score above a threshold, the least ratio, with a margin for the number of
texts, bounds the share of positives among the unlabelled (positives and unlabelled texts of the
positive class score alike, so the ratio is the prior where no negative scores that high).

Fitted on at most `max_positive` trusted positives and `max_unlabelled` unlabelled texts, the first
by hash, so the fit takes the same memory at any size; statistics and scores cover all rows.

Defined results: a null text is the empty text; empty texts are scored as any other; null or repeated
ids are scored row by row; labels with null id or value are ignored, a document with conflicting
labels is no trusted positive; without trusted positives or unlabelled texts all scores are 0.5; an
empty table gives an empty result; other columns are not read. Texts are read whole.
"""

from __future__ import annotations

import re
import string
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basketry.llm.common import cut, text_or_empty

#: Trusted positives and unlabelled texts that the model is fitted on, at most.
MAX_POSITIVE, MAX_UNLABELLED = 8_000, 16_000
#: Inner knots of each statistic.
KNOTS = 7
#: Weight of the squares of the coefficients; steps of the descent and their size.
RIDGE, STEPS, RATE = 1e-4, 500, 0.05
#: The prior is read where at least this share of the positives lies above the threshold; the confidence of its margin; the prior of the first model.
LEAST_SHARE, CONFIDENCE, FIRST_PRIOR = 0.1, 0.1, 0.5
#: The prior is kept within these bounds, since the risk has no meaning without either class.
BOUNDS = (0.01, 0.99)
#: Words that make up a window; the window that is poorest in different words speaks for the text.
WINDOW = 40

DIGITS, SPACES, PUNCTUATION = (x.encode() for x in (string.digits, string.whitespace, string.punctuation))
MARKS = re.compile(r"[#*$%&|<>{}\\^~=_@]")
SENTENCE_END = re.compile(r"[.!?…。！？](?:\s|$)")
STATISTICS = (
    "log_words", "log_chars", "word_chars", "long_words", "distinct_words", "distinct_near", "least_distinct", "same_as_before", "repeated_triples",
    "upper_words", "title_words", "marked_words", "shouted_words", "mark_only_words", "digits", "letters", "spaces", "ascii_punctuation",
    "log_lines", "line_words", "equal_lines", "short_lines", "sentence_words", "end_marks", "most_common_word",
)


def _number_of(raw: bytes, marks: bytes) -> int:
    return len(raw) - len(raw.translate(None, marks))


def statistics_of(text: str) -> list[float]:
    """The numbers of STATISTICS for a text."""
    words = text.split()
    n, chars = len(words), len(text)
    if not n:
        return [0.0] * len(STATISTICS)
    counts = Counter(words)
    share = lambda holds: sum(c for w, c in counts.items() if holds(w)) / n
    triples = Counter(zip(words, words[1:], words[2:]))  # noqa: B905
    again = sum(c for c in triples.values() if c > 1)
    windows = [len(set(words[k : k + WINDOW])) / len(words[k : k + WINDOW]) for k in range(0, max(1, n - WINDOW // 2), WINDOW)]
    lines = [line for line in text.split("\n") if line.strip()]
    ends = len(SENTENCE_END.findall(text))
    raw = text.encode()
    digits, spaces, marks = (_number_of(raw, x) for x in (DIGITS, SPACES, PUNCTUATION))
    return [
        np.log1p(n), np.log1p(chars), sum(len(w) * c for w, c in counts.items()) / n, share(lambda w: len(w) > 14), len(counts) / n, sum(windows) / len(windows), min(windows),
        sum(a == b for a, b in zip(words, words[1:])) / n, again / max(1, n - 2),  # noqa: B905
        share(lambda w: len(w) > 1 and w.isupper()), share(str.istitle), share(MARKS.search), share(lambda w: w[-1] == "!"), share(lambda w: not any(map(str.isalnum, w))),
        digits / chars, (chars - digits - spaces - marks) / chars, spaces / chars, marks / chars,
        np.log1p(len(lines)), np.log1p(n / len(lines)), 1 - len(set(lines)) / len(lines), sum(len(x) < 30 for x in lines) / len(lines),
        np.log1p(n / max(1, ends)), ends / n, max(counts.values()) / n,
    ]


def _statistics(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From (id, text) to (id, x)."""
    for batch in batches:
        x = np.array([statistics_of(t) for t in batch.column(1).to_pylist()], np.float32).reshape(-1, len(STATISTICS))
        ends = pa.array(np.arange(len(x) + 1) * len(STATISTICS), pa.int32())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(ends, pa.array(x.ravel()))], names=["id", "x"])


def with_statistics(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and x (the statistics) of each row, written once; the texts are not read again."""
    kind = docs.schema[id_col].dataType.simpleString()
    return cut(docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text")).mapInArrow(_statistics, f"id {kind}, x array<float>"))


def sigmoid(t: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(t, -30, 30)))


@dataclass
class Basis:
    """Piecewise linear functions of standardised statistics."""

    centre: np.ndarray
    scale: np.ndarray
    knots: np.ndarray

    @staticmethod
    def fitted(x: np.ndarray) -> Basis:
        centre, scale = x.mean(axis=0), x.std(axis=0)
        scale = np.where(scale > 0, scale, 1.0)
        return Basis(centre, scale, np.quantile((x - centre) / scale, np.linspace(0, 1, KNOTS + 2)[1:-1], axis=0))

    def __call__(self, x: np.ndarray) -> np.ndarray:
        z = (x - self.centre) / self.scale
        return np.hstack([np.ones((len(x), 1)), z, *(np.maximum(z - k, 0) for k in self.knots)])


@dataclass
class Model:
    prior: float | None = None
    basis: Basis | None = None
    w: np.ndarray | None = None

    def scores(self, x: np.ndarray) -> np.ndarray:
        return np.full(len(x), 0.5) if self.w is None else sigmoid(self.basis(x) @ self.w)


def risk(w: np.ndarray, p: np.ndarray, u: np.ndarray, prior: float) -> tuple[float, float, np.ndarray, np.ndarray]:
    """The two parts of the risk under the logistic loss, positives and (estimated) negatives, and their gradients."""
    at_p, at_u = p @ w, u @ w
    up, uu = sigmoid(at_p), sigmoid(at_u)
    positive = prior * np.logaddexp(0, -at_p).mean()
    negative = np.logaddexp(0, at_u).mean() - prior * np.logaddexp(0, at_p).mean()
    return positive, negative, -prior * (p.T @ (1 - up)) / len(p), u.T @ uu / len(u) - prior * (p.T @ up) / len(p)


def minimised(p: np.ndarray, u: np.ndarray, prior: float, steps: int = STEPS) -> np.ndarray:
    """Coefficients of the least non-negative risk, by a descent with moments."""
    w, m, v = (np.zeros(p.shape[1]) for _ in range(3))
    for t in range(1, steps + 1):
        _, negative, of_p, of_n = risk(w, p, u, prior)
        g = of_p + of_n + RIDGE * w if negative >= 0 else -of_n
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w = w - RATE * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w


def prior_of(p: np.ndarray, u: np.ndarray) -> float:
    """The share of positives among the unlabelled by the scores of both: the ratio of the shares above the threshold whose bound is the least."""
    p, u = np.sort(p), np.sort(u)
    at = p[: max(1, int(len(p) * (1 - LEAST_SHARE)))]
    above_p, above_u = 1 - np.searchsorted(p, at) / len(p), 1 - np.searchsorted(u, at) / len(u)
    margin = np.sqrt(np.log(4 / CONFIDENCE) / 2) * (1 / np.sqrt(len(p)) + 1 / np.sqrt(len(u)))
    best = int(np.argmin((above_u + margin) / above_p))
    return float(np.clip(above_u[best] / above_p[best], *BOUNDS))


def estimated_prior(p: np.ndarray, u: np.ndarray) -> float:
    """Either half of both is scored by a model of the other half. Rows come in no order, so halves are every second row."""
    found = []
    for k in (0, 1):
        w = minimised(p[k::2], u[k::2], FIRST_PRIOR, STEPS // 2)
        found.append(prior_of(p[1 - k :: 2] @ w, u[1 - k :: 2] @ w))
    return sum(found) / 2


def fitted(positive: np.ndarray, unlabelled: np.ndarray) -> Model:
    """The model of statistics of trusted positives and of unlabelled texts."""
    if len(positive) < 2 or len(unlabelled) < 2:
        return Model()
    basis = Basis.fitted(unlabelled)
    p, u = basis(positive), basis(unlabelled)
    prior = estimated_prior(p, u)
    return Model(prior, basis, minimised(p, u, prior))


def _sample(rows: DataFrame, most: int) -> np.ndarray:
    """The statistics of at most `most` rows, the first by hash. rows: h, x."""
    n = rows.count()
    if n > 2 * most:
        # Rows far behind the last wanted one need not be sorted; h is uniform over 64 bits.
        rows = rows.where(F.col("h") < int(-(2**63) + 2**64 * min(1.0, 1.5 * (most + 100) / n)))
    found = rows.orderBy("h", "x").limit(most).select("x").toPandas()["x"]
    return np.array(found.tolist(), float).reshape(-1, len(STATISTICS))


def train(statistics: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", label_col: str = "quality", held_out: Column | None = None, max_positive: int = MAX_POSITIVE, max_unlabelled: int = MAX_UNLABELLED) -> Model:
    """statistics: of `with_statistics`. held_out: a condition on id; such rows are neither trusted nor taken as unlabelled."""
    marks = labels.select(F.col(id_col).alias("label_id"), F.col(label_col).alias("label")).dropna()
    trusted = marks.groupBy("label_id").agg(F.min("label").alias("label")).where("label = 1").select("label_id")
    rows = statistics.withColumn("h", F.xxhash64("id", "x"))
    if held_out is not None:
        rows = rows.where(~F.coalesce(held_out, F.lit(False)))
    positive = rows.join(trusted, F.col("id") == F.col("label_id"), "left_semi")
    return fitted(_sample(positive, max_positive), _sample(rows, max_unlabelled))


def scores(statistics: DataFrame, model: Model, name: str = "score") -> DataFrame:
    """id and score of each row of `with_statistics`."""
    kind = statistics.schema["id"].dataType.simpleString()

    def score(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column(1).flatten().to_numpy().astype(float).reshape(-1, len(STATISTICS))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.scores(x))], names=["id", name])

    return statistics.select("id", "x").mapInArrow(score, f"id {kind}, {name} double")
