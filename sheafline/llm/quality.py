"""Quality rules with line labels from a linear-chain conditional random field (operator 4).

Counts of the whole text come first and decide `base_failed`.  Then every line gets a label, content or boilerplate, from
the best path (Viterbi) of a linear-chain CRF over the text's lines; a document is kept if content lines hold at least
`SHARE` of its words.

The CRF is trained here, by maximum likelihood with forward-backward sums, on a sample of documents with a quality label
(at most `PER_LABEL` a label).  Its lines are labelled weakly: those of good documents are content and those of bad ones
that break a rule of thumb are boilerplate, and so are licence notices and the like in either.
"""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sheafline.llm.common import WORD_RE, map_rows
from sheafline.llm.linear import sample

PER_LABEL = 600
#: Of 0 content and 1 boilerplate.
CONTENT, BOILERPLATE = 0, 1
SHARE = 0.5
SYMBOLS = "#*$%&|<>"
#: What licence, copyright and navigation notices say.
NOTICES = (
    "license", "licence", "copyright", "©", "all rights reserved", "cookie", "terms of use", "terms of service", "privacy policy",
    "subscribe", "sign in", "log in", "click here",
)
WINDOW = 5
FEATURES = ("bias", "length", "symbols", "capitals", "digits", "marks", "sentence", "repeats", "seen", "notice", "pipes", "short")


def counts(text: str | None) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of a whole text; null has no words."""
    text = text or ""
    words = WORD_RE.findall(text)
    n = len(words)
    seen: set[str] = set()
    dup = 0
    for line in text.split("\n"):
        if line in seen:
            dup += 1
        elif WORD_RE.search(line):
            seen.add(line)
    repeat = 0
    if n > WINDOW:
        windows = list(zip(*(words[i:] for i in range(WINDOW))))
        if len(set(windows)) < len(windows):
            often = Counter(windows)
            until = 0  # words before this one are counted
            for i, w in enumerate(windows):
                if often[w] > 1:
                    repeat += i + WINDOW - max(i, until)
                    until = i + WINDOW
    return n, sum(map(len, words)), sum(map(text.count, SYMBOLS)), dup, repeat


def base_failed(n_words: int, n_repeat: int) -> bool:
    return n_words < 10 or 100 * n_repeat > 20 * n_words


def split_lines(text: str | None) -> tuple[list[str], list[list[str]]]:
    """A text's lines that have a word, and their words."""
    pairs = [(x, w) for x in (text or "").split("\n") if (w := WORD_RE.findall(x))]
    return [x for x, _ in pairs], [w for _, w in pairs]


def line_features(lines: list[str], words: list[list[str]]) -> np.ndarray:
    """(lines, FEATURES) of a text's lines that have a word."""
    rows = []
    seen: set[str] = set()
    for line, w in zip(lines, words):
        n, size = len(w), len(line)
        low = line.lower()
        rows.append(
            (
                1.0,
                min(math.log1p(n), 5.0) / 5,
                min(1.0, 4 * sum(map(line.count, SYMBOLS)) / size),
                sum(map(str.isupper, w)) / n,
                min(1.0, 4 * sum(map(line.count, "0123456789")) / size),
                min(1.0, 4 * (line.count("!") + line.count("?")) / size),
                w[-1][-1] in ".!?…\"'",
                1 - len(set(w)) / n if n > 8 else 0.0,
                line in seen,
                any(map(low.__contains__, NOTICES)),
                min(1.0, 2 * line.count("|") / n),
                n < 4,
            )
        )
        seen.add(line)
    return np.array(rows, dtype=float).reshape(len(rows), len(FEATURES))


def weak_labels(x: np.ndarray, good: bool) -> np.ndarray:
    """Labels of a text's lines from their features and the document's label."""
    col = FEATURES.index
    notice = x[:, col("notice")] > 0
    if good:
        return np.where(notice, BOILERPLATE, CONTENT)
    broken = (x[:, col("symbols")] > 0.2) | (x[:, col("capitals")] > 0.5) | (x[:, col("repeats")] > 0.5) | (x[:, col("pipes")] > 0.4) | (x[:, col("seen")] > 0)
    return np.where(notice | broken, BOILERPLATE, CONTENT)


@dataclass
class Model:
    """unary: (features, 2); step: (2, 2) from a label to the next."""

    unary: np.ndarray
    step: np.ndarray

    def labels(self, lines: list[str], words: list[list[str]]) -> list[int]:
        """The best path."""
        if not lines:
            return []
        score = (line_features(lines, words) @ self.unary).tolist()
        (s00, s01), (s10, s11) = self.step.tolist()
        a, b = score[0]
        back = []
        for u, v in score[1:]:
            from_a, from_b = a + s00 >= b + s10, a + s01 >= b + s11
            a, b = (a + s00 if from_a else b + s10) + u, (a + s01 if from_b else b + s11) + v
            back.append((0 if from_a else 1, 0 if from_b else 1))
        path = [0 if a >= b else 1]
        for step in reversed(back):
            path.append(step[path[-1]])
        return path[::-1]

    def content_share(self, text: str | None) -> float:
        """Share of the words that stand in content lines; 0 without words."""
        lines, words = split_lines(text)
        total = sum(map(len, words))
        return sum(len(w) for w, y in zip(words, self.labels(lines, words)) if y == CONTENT) / total if total else 0.0


def _log_likelihood(xs: np.ndarray, ys: np.ndarray, size: np.ndarray, unary: np.ndarray, step: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gradients of the mean log-likelihood a line, of sequences sorted by falling length and padded."""
    n, most, _ = xs.shape
    u = xs @ unary
    alpha, beta = np.zeros((n, most, 2)), np.zeros((n, most, 2))
    alpha[:, 0] = u[:, 0]
    live = [int((size > t).sum()) for t in range(most)]
    for t in range(1, most):
        k = live[t]
        alpha[:k, t] = np.logaddexp(alpha[:k, t - 1, :1] + step[0], alpha[:k, t - 1, 1:] + step[1]) + u[:k, t]
    for t in range(most - 2, -1, -1):
        k = live[t + 1]
        ahead = beta[:k, t + 1] + u[:k, t + 1]
        beta[:k, t] = np.logaddexp(ahead[:, :1] + step[:, 0], ahead[:, 1:] + step[:, 1])
    mask = np.arange(most) < size[:, None]
    z = np.logaddexp(*alpha[np.arange(n), size - 1].T)
    p = np.exp(alpha + beta - z[:, None, None]) * mask[..., None]
    truth = np.eye(2)[ys] * mask[..., None]
    g_unary = np.einsum("ntf,ntk->fk", xs, truth - p)
    g_step = np.zeros((2, 2))
    both = mask[:, 1:]
    for i in (0, 1):
        for j in (0, 1):
            expect = np.exp(alpha[:, :-1, i] + step[i, j] + u[:, 1:, j] + beta[:, 1:, j] - z[:, None])
            g_step[i, j] = (((ys[:, :-1] == i) & (ys[:, 1:] == j)) * both).sum() - np.where(both, expect, 0).sum()
    lines = mask.sum()
    return g_unary / lines, g_step / lines


def train(texts: list[str], good: list[int], steps: int = 150, rate: float = 0.1, most_lines: int = 64) -> Model:
    """A model of the given documents; longer texts are learnt from in runs of `most_lines` lines.  No rows: all is content."""
    runs = []
    for text, g in sorted(zip(texts, good)):
        lines, words = split_lines(text)
        x = line_features(lines, words)
        y = weak_labels(x, bool(g))
        runs += [(x[i : i + most_lines], y[i : i + most_lines]) for i in range(0, len(lines), most_lines)]
    unary, step = np.zeros((len(FEATURES), 2)), np.zeros((2, 2))
    if not runs:
        unary[0, CONTENT] = 1.0
        return Model(unary, step)
    runs.sort(key=lambda r: -len(r[0]))
    size = np.array([len(r[0]) for r in runs])
    xs, ys = np.zeros((len(runs), size[0], len(FEATURES))), np.zeros((len(runs), size[0]), dtype=np.int64)
    for i, (x, y) in enumerate(runs):
        xs[i, : len(x)], ys[i, : len(y)] = x, y
    state = [np.zeros_like(unary), np.zeros_like(step), np.zeros_like(unary), np.zeros_like(step)]
    for t in range(1, steps + 1):
        grads = _log_likelihood(xs, ys, size, unary, step)
        for i, (param, g) in enumerate(zip((unary, step), grads)):
            g = g - 1e-3 * param
            state[i] = 0.9 * state[i] + 0.1 * g
            state[2 + i] = 0.99 * state[2 + i] + 0.01 * g * g
            param += rate * (state[i] / (1 - 0.9**t)) / (np.sqrt(state[2 + i] / (1 - 0.99**t)) + 1e-6)
    return Model(unary, step)


def fit(df: DataFrame, labels: DataFrame, text: str = "text", label: str = "quality", doc_id: str = "doc_id", where: Column | None = None, per_label: int = PER_LABEL) -> Model:
    """A model of the documents that `where` admits and that have a label of 0 or 1; several labels of one id: the least."""
    marks = labels.where(F.col(label).isin(0, 1)).groupBy(F.col(doc_id).alias("__id")).agg(F.min(label).alias("__label"))
    docs = df.where(F.col(text).isNotNull() & (F.lit(True) if where is None else where)).select(F.col(doc_id).alias("__id"), F.col(text).alias("__text"))
    # ids first: the texts are then read for the sample alone, whose size is bounded
    got = sample(docs.select("__id").join(marks, "__id"), docs, "__label", per_label, "__id", "__text")
    return train([t for t, _ in got], [int(x) for _, x in got])


def judge(df: DataFrame, model: Model, text: str = "text", share: float = SHARE) -> DataFrame:
    """df with the counts of the whole text, base_failed, content_share and kept.

    A null or empty text has no words: it fails the base rules and is not kept.
    """

    def run(texts: list) -> list:
        base = [counts(t) for t in texts]
        failed = [base_failed(b[0], b[4]) for b in base]
        part = [model.content_share(t) for t in texts]
        return [*(pa.array(x, pa.int64()) for x in zip(*base)), failed, part, [not f and p >= share for f, p in zip(failed, part)]]

    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    fields = [*(T.StructField(n, T.LongType()) for n in names), T.StructField("base_failed", T.BooleanType()), T.StructField("content_share", T.DoubleType()), T.StructField("kept", T.BooleanType())]
    return map_rows(df, run, [text], fields)
