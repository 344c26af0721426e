"""Language identification by error-correcting output codes (operator 5).

Each language has a codeword; each bit of the codewords has a binary classifier over hashed character n-grams.  A text's
margins are compared with every codeword under the logistic loss, and the codeword of least loss names the language.
Where the runner-up's loss is within `MARGIN` of it, the text is flagged as ambiguous.

Trained on a sample of labelled rows of at most `PER_LABEL` documents a language; which rows may be learnt from is the
caller's choice.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sheafline.llm.linear import code_points, letters, logistic, sample
from sheafline.llm.common import map_rows

PER_LABEL = 250
#: Buckets of hashed n-grams of one, two and three characters.
BUCKETS = 1 << 13
MAX_N = 3
#: Length in characters of the slices of each document that are learnt from beside the whole text.
SLICE = 160
MARGIN = 1.0
UNKNOWN = "und"


def codewords(k: int) -> np.ndarray:
    """(k, bits) of -1 and 1.

    Up to five classes: all ways to part them in two, one of each complementary pair, so rows differ in over half of the
    bits.  More classes: 4 log2(k) + 8 balanced columns from a fixed generator, the best of 50 draws by least distance.
    """
    if k == 1:
        return np.ones((1, 1))
    if k <= 5:
        return np.array([[1 if (c >> r) & 1 else -1 for c in range(1, 1 << (k - 1))] for r in range(k - 1)] + [[-1] * ((1 << (k - 1)) - 1)], dtype=float)
    bits = int(np.ceil(4 * np.log2(k))) + 8
    best, most = None, -1
    for seed in range(50):
        rng = np.random.default_rng(seed)
        code = np.stack([rng.permutation(np.where(np.arange(k) < k // 2, 1.0, -1.0)) for _ in range(bits)], axis=1)
        apart = ((bits - code @ code.T) / 2 + np.eye(k) * bits).min()
        if apart > most:
            best, most = code, apart
    return best


def ngram_counts(texts: list[str]) -> np.ndarray:
    """(texts, BUCKETS) counts of hashed n-grams of lower-cased letters; all else is one word boundary."""
    chars, owner = code_points([t.lower() for t in texts])
    c = np.where(letters()[chars], chars, 0).astype(np.uint64)
    keep = np.concatenate(([True], (c[1:] != 0) | (c[:-1] != 0) | (owner[1:] != owner[:-1])))
    c, owner = c[keep], owner[keep]
    out = np.zeros(len(texts) * BUCKETS, dtype=np.int64)
    h = np.zeros(len(c), dtype=np.uint64)
    for n in range(1, MAX_N + 1):
        last = len(c) - n + 1
        if last <= 0:
            break
        h = h[:last] * np.uint64(0x9E3779B97F4A7C15) + c[n - 1 :] + np.uint64(1)
        slot = ((h * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(64 - 13)).astype(np.int64)
        whole = (owner[:last] == owner[n - 1 :]) & (c[:last] + c[n - 1 :] != 0)  # not across texts, not blank only
        out += np.bincount(owner[:last][whole] * BUCKETS + slot[whole], minlength=len(out))
    return out.reshape(len(texts), BUCKETS)


def _shares(counts: np.ndarray) -> np.ndarray:
    return counts / np.maximum(counts.sum(1, keepdims=True), 1)


@dataclass
class Model:
    """langs in order; code (langs, bits); weights (buckets, bits); bias (bits)."""

    langs: list[str]
    code: np.ndarray
    weights: np.ndarray
    bias: np.ndarray

    def losses(self, texts: list[str]) -> np.ndarray:
        """(texts, langs): each codeword's logistic loss under the texts' margins."""
        margin = _shares(ngram_counts(texts)).astype(np.float32) @ self.weights + self.bias
        return np.logaddexp(0, -margin[:, None, :] * self.code[None]).sum(2)

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, score and ambiguity of each text; `und`, 0 and True where no letter is."""
        texts = [t or "" for t in texts]
        lang, score, unsure = [UNKNOWN] * len(texts), np.zeros(len(texts)), np.ones(len(texts), dtype=bool)
        if not self.langs:
            return lang, score, unsure
        at = 0
        while at < len(texts):  # a million characters at a time
            to, size = at + 1, len(texts[at])
            while to < len(texts) and to - at < 128 and size + len(texts[to]) < 1_000_000:
                size += len(texts[to])
                to += 1
            loss = self.losses(texts[at:to])
            like = np.exp(loss.min(1, keepdims=True) - loss)
            best = loss.argmin(1)
            two = np.sort(loss, 1)[:, :2]
            for i in range(to - at):
                if has_letter(texts[at + i]):
                    lang[at + i] = self.langs[best[i]]
                    score[at + i] = like[i].max() / like[i].sum()
                    unsure[at + i] = len(self.langs) > 1 and two[i, 1] - two[i, 0] < MARGIN
            at = to
        return lang, score, unsure


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


def train(texts: list[str], langs: list[str]) -> Model:
    """A model of the given rows; without rows, one that answers `und` only."""
    pairs = sorted((lang, text) for text, lang in zip(texts, langs) if has_letter(text))
    names = sorted({lang for lang, _ in pairs})
    code = codewords(len(names)) if names else np.zeros((0, 0))
    if not names:
        return Model([], code, np.zeros((BUCKETS, 0), np.float32), np.zeros(0))
    samples, row = [], []
    for lang, text in pairs:
        cuts = [text] + [s for s in (text[:SLICE], text[len(text) // 2 :][:SLICE]) if len(s) < len(text) and has_letter(s)]
        samples += cuts
        row += [names.index(lang)] * len(cuts)
    row = np.array(row)
    x = np.concatenate([_shares(ngram_counts(samples[i : i + 64])).astype(np.float32) for i in range(0, len(samples), 64)])
    scale = 1 / np.sqrt(x.mean(0) + 1e-5)
    x *= scale
    each = 1 / np.bincount(row, minlength=len(names))[row]  # languages weigh the same
    w, b = logistic(x, (code[row] + 1) / 2, each, steps=120)
    return Model(names, code, (w * scale[:, None]).astype(np.float32), b)


def fit(df: DataFrame, text: str = "text", lang: str = "lang", doc_id: str = "doc_id", where: Column | None = None, per_label: int = PER_LABEL) -> Model:
    """A model of the rows that `where` admits and that have a language and a text."""
    rows = df.where(F.col(lang).isNotNull() & F.col(text).isNotNull() & (F.lit(True) if where is None else where))
    got = sample(rows, rows, lang, per_label, doc_id, text)
    return train([t for t, _ in got], [x for _, x in got])


def identify(df: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """df with lang_pred, score (share of the nearest codeword, 0 to 1) and ambiguous.

    A null text, or one without a letter, is `und` with score 0 and counts as ambiguous.  Every other text gets a learnt
    language, ambiguous or not.  An empty table gives an empty one.
    """

    def run(texts: list) -> list:
        lang, score, unsure = model.predict(texts)
        return [lang, pa.array(score), pa.array(unsure)]

    fields = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("ambiguous", T.BooleanType())]
    return map_rows(df, run, [text], fields)
