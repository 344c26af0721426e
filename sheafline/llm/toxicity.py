"""Toxicity by weak supervision (operator 1).

1. Voters.  Fixed lexicons of abuse, lexicons mined from folds of the labelled sample (words, and beginnings of words,
   that go with the label), and patterns (shouting, runs of marks, abuse addressed at someone).  A voter says toxic, says
   clean, or abstains.
2. Label model.  A generative model of the votes given the unseen class: each voter's accuracies are estimated by
   expectation maximisation, and the voters' correlations from what the classes leave unexplained; correlated voters share
   their weight.  It gives each sampled document a posterior.
3. Classifier.  Logistic regression on counts of the mined words and beginnings learns the posteriors and scores any text.

Training uses a sample of labelled rows of at most `PER_LABEL` documents of each label; everything is counted over whole
texts.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sheafline.llm.common import map_rows
from sheafline.llm.linear import code_points, letters, logistic, sample

PER_LABEL = 2000
FOLDS = 3
#: Mined terms must stand in so many toxic documents of the sample.
LEAST_DOCS = 4
TERMS = 2000
PREFIXES = range(3, 9)
#: Seed lexicons by kind; the mined lexicons carry what they lack, other languages included.
SEEDS = {
    "insult": "idiot moron loser clown stupid dumb fool imbecile cretin",
    "contempt": "worthless pathetic disgusting trash scum garbage vermin filth",
    "threat": "kill die hurt destroy beat",
    "profanity": "damn crap shit fuck bitch bastard asshole",
    "german": "arschloch idiot dumm wichser hurensohn drecksau",
    "french": "connard salaud merde imbécile putain débile",
    "spanish": "idiota imbécil mierda puta cabrón estúpido",
}
YOU = frozenset("you your you're ur du dich tu toi vous te usted ustedes".split())

_MULT, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def term_hash(term: str, prefix: bool) -> int:
    """64 bits of a lower-cased word, or of a beginning of words."""
    h = 0
    for c in term:
        h = (h * 0x9E3779B97F4A7C15 + ord(c) + 1) & 0xFFFFFFFFFFFFFFFF
    return ((h ^ (len(term) << 56)) * 0xD6E8FEB86659FD93 + prefix) & 0xFFFFFFFFFFFFFFFF


def terms_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, text number) of every word and of every beginning of 3 to 8 letters, and the words of each text.

    Words are runs of letters, lower-cased.
    """
    chars, owner = code_points([t.lower() for t in texts])
    is_letter = letters()[chars]
    edge = np.flatnonzero(np.diff(is_letter.astype(np.int8)))  # texts have NULs around: edges come in pairs
    start, end = edge[::2] + 1, edge[1::2] + 1
    who, length = owner[start], end - start
    c = chars.astype(np.uint64) + np.uint64(1)
    h = np.zeros(len(start), dtype=np.uint64)
    out_h, out_who = [], []
    live = np.arange(len(start))
    size = 0
    while len(live):  # one letter further in every word that is long enough
        size += 1
        h[live] = h[live] * _MULT + c[start[live] + size - 1]
        if size in PREFIXES:
            out_h.append((h[live] ^ np.uint64(size << 56)) * _MIX + np.uint64(1))
            out_who.append(who[live])
        live = live[length[live] > size]
        if size == 64:  # longer words are rare: what is left of them, one by one
            for i in live:
                x = int(h[i])
                for k in range(int(start[i]) + 64, int(end[i])):
                    x = (x * 0x9E3779B97F4A7C15 + int(c[k])) & 0xFFFFFFFFFFFFFFFF
                h[i] = x
            break
    out_h.append((h ^ (length.astype(np.uint64) << np.uint64(56))) * _MIX)
    out_who.append(who)
    return np.concatenate(out_h), np.concatenate(out_who), np.bincount(who, minlength=len(texts))


def count_terms(texts: list[str], known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(texts, known) counts of the known hashes, which are sorted, and words a text."""
    h, who, words = terms_of(texts)
    slot = np.searchsorted(known, h)
    slot[slot == len(known)] = 0
    hit = known[slot] == h if len(known) else np.zeros(len(h), dtype=bool)
    flat = np.bincount(who[hit] * max(1, len(known)) + slot[hit], minlength=len(texts) * max(1, len(known)))
    return flat.reshape(len(texts), -1)[:, : len(known)], words


def mine(texts: list[str], toxic: np.ndarray, most: int = TERMS) -> np.ndarray:
    """Hashes of the terms whose presence tells most of the label, sorted; at most `most` for each class."""
    pairs_h, pairs_y = [], []
    for at in range(0, len(texts), 64):
        h, who, _ = terms_of(texts[at : at + 64])
        both = np.unique(np.stack([who.astype(np.uint64), h]), axis=1)
        pairs_h.append(both[1])
        pairs_y.append(toxic[at + both[0].astype(np.int64)])
    if not pairs_h:
        return np.empty(0, np.uint64)
    h, y = np.concatenate(pairs_h), np.concatenate(pairs_y)
    known, inv = np.unique(h, return_inverse=True)
    pos, neg = np.bincount(inv, y, len(known)), np.bincount(inv, 1 - y, len(known))
    odds = np.log((pos + 0.5) / (toxic.sum() + 1)) - np.log((neg + 0.5) / ((1 - toxic).sum() + 1))
    tell = np.where((pos >= LEAST_DOCS) & (odds > 1), odds * np.sqrt(pos), 0)
    top = np.argsort(-tell, kind="stable")[:most]
    return np.sort(known[top[tell[top] > 0]])


def _patterns(text: str) -> tuple[bool, bool, bool]:
    """Shouting; runs of marks; someone is spoken to."""
    head = text.split()
    caps = sum(w.isupper() and len(w) > 1 for w in head)
    return caps > 0.3 * len(head) > 0, "!!" in text or "?!" in text, any(w.lower() in YOU for w in head)


def lexicon(texts: list[str], toxic: np.ndarray) -> tuple[np.ndarray, list[tuple[float, float]]]:
    """Mined terms, and for hits and share of hits the bounds that 80 % and 98 % of the clean texts keep to."""
    known = mine(texts, toxic)
    hits, share = [np.zeros(1)], [np.zeros(1)]
    for at in range(0, len(texts), 64):
        h, who, words = terms_of(texts[at : at + 64])
        n = np.bincount(who[np.isin(h, known)], minlength=len(words))
        clean = toxic[at : at + 64] == 0
        hits.append(n[clean])
        share.append((n / np.maximum(words, 1))[clean])
    return known, [tuple(np.quantile(np.concatenate(x), (0.8, 0.98))) for x in (hits, share)]


def votes(texts: list[str], lexicons: list[tuple[np.ndarray, list[tuple[float, float]]]]) -> np.ndarray:
    """(texts, voters) of 1 toxic, 0 clean, -1 abstains: two voters a mined lexicon, one a seed lexicon, three patterns."""
    seeds = [np.unique(np.array([term_hash(w, False) for w in words.split()], dtype=np.uint64)) for words in SEEDS.values()]
    out = []
    for at in range(0, len(texts), 64):
        part = texts[at : at + 64]
        h, who, words = terms_of(part)
        columns = []
        for known, bounds in lexicons:
            hits = np.bincount(who[np.isin(h, known)], minlength=len(part))
            share = hits / np.maximum(words, 1)
            for measure, (low, high) in ((hits, bounds[0]), (share, bounds[1])):
                columns.append(np.where(measure > high, 1, np.where(measure <= low, 0, -1)))
        abuse = np.zeros(len(part), dtype=np.int64)
        for known in seeds:
            hits = np.bincount(who[np.isin(h, known)], minlength=len(part))
            abuse += hits
            columns.append(np.where(hits > 0, 1, -1))
        shape = np.array([_patterns(t) for t in part])
        columns.append(np.where(shape[:, 0] & (abuse > 0), 1, -1))
        columns.append(np.where(shape[:, 1] & (abuse > 0), 1, -1))
        columns.append(np.where(shape[:, 2] & (abuse > 0), 1, np.where(abuse == 0, -1, 0)))
        out.append(np.stack(columns, axis=1))
    return np.concatenate(out) if out else np.zeros((0, 2 * len(lexicons) + len(SEEDS) + 3), dtype=np.int64)


@dataclass
class LabelModel:
    """prior of toxic; accuracy[y, v, s]: chance that voter v says s (clean, toxic, nothing) where the class is y."""

    prior: float
    accuracy: np.ndarray
    weight: np.ndarray
    correlation: np.ndarray

    def posterior(self, ballot: np.ndarray) -> np.ndarray:
        say = np.where(ballot < 0, 2, ballot)
        log = np.log(self.accuracy)
        at = np.arange(ballot.shape[1])
        gain = (log[1][at, say] - log[0][at, say]) @ self.weight + np.log(self.prior / (1 - self.prior))
        return 1 / (1 + np.exp(-np.clip(gain, -30, 30)))


def label_model(ballot: np.ndarray, start: np.ndarray, rounds: int = 30) -> LabelModel:
    """Fits the generative model from a first guess of the classes; no votes or voters give the guess's share."""
    n, k = ballot.shape
    say = np.where(ballot < 0, 2, ballot)
    one_hot = np.eye(3)[say]  # rows, voters, what is said
    q = start.astype(float)
    weight, corr = np.ones(k), np.eye(k)
    model = LabelModel(0.5, np.full((2, k, 3), 1 / 3), weight, corr)
    for _ in range(rounds):
        prior = float(np.clip(q.mean() if n else 0.5, 1e-3, 1 - 1e-3))
        acc = np.stack([((1 - q)[:, None, None] * one_hot).sum(0), (q[:, None, None] * one_hot).sum(0)]) + 0.5
        acc /= acc.sum(2, keepdims=True)
        # what is left of the votes once the class is known; voters that err together count as fewer
        signed = np.where(ballot < 0, 0, 2 * ballot - 1).astype(float)
        mean = acc[:, :, 1] - acc[:, :, 0]
        rest = signed - q[:, None] * mean[1] - (1 - q)[:, None] * mean[0]
        spread = np.sqrt((rest**2).mean(0)) + 1e-9 if n else np.ones(k)
        corr = (rest.T @ rest) / max(n, 1) / np.outer(spread, spread)
        np.fill_diagonal(corr, 1)
        # what chance alone makes of so many rows is no correlation
        beyond = (np.abs(corr) - 2 / np.sqrt(max(n, 1))).clip(0, 1)
        np.fill_diagonal(beyond, 1)
        weight = 1 / beyond.sum(1)
        model = LabelModel(prior, acc, weight, corr)
        new = model.posterior(ballot)
        if n == 0 or np.abs(new - q).max() < 1e-4:
            break
        q = new
    return model


@dataclass
class Model:
    """known: sorted term hashes; weights: one a term, then the density's; bias."""

    known: np.ndarray
    weights: np.ndarray
    bias: float

    def features(self, texts: list[str]) -> np.ndarray:
        n, words = count_terms(texts, self.known)
        return np.concatenate([np.log1p(n), np.log1p(100 * n.sum(1) / np.maximum(words, 1))[:, None]], axis=1)

    def score(self, texts: list[str | None]) -> np.ndarray:
        out = [np.zeros(0)]
        at = 0
        texts = [t or "" for t in texts]
        while at < len(texts):  # a few million characters at a time
            to, size = at + 1, len(texts[at])
            while to < len(texts) and to - at < 64 and size + len(texts[to]) < 2_000_000:
                size += len(texts[to])
                to += 1
            z = self.features(texts[at:to]) @ self.weights + self.bias
            out.append(1 / (1 + np.exp(-np.clip(z, -30, 30))))
            at = to
        return np.concatenate(out)


def train(texts: list[str], toxic: list[int]) -> Model:
    """A model of the given rows.  Without rows, or with one label only, every score is that label's share (0.5 of none)."""
    order = sorted(range(len(texts)), key=lambda i: (zlib.crc32(texts[i].encode("utf-8", "replace")), texts[i], toxic[i]))
    texts, y = [texts[i] for i in order], np.array([float(toxic[i]) for i in order])
    if len(texts) == 0 or y.min() == y.max():
        share = 0.5 if len(texts) == 0 else float(np.clip(y[0], 0.01, 0.99))
        return Model(np.empty(0, np.uint64), np.zeros(1), float(np.log(share / (1 - share))))
    fold = np.arange(len(texts)) % FOLDS
    # a lexicon mined from the other folds votes on a fold, so that no voter has seen the document it votes on
    lexicons = [lexicon([t for t, f in zip(texts, fold) if f != k], y[fold != k]) for k in range(FOLDS)]
    ballot = np.zeros((len(texts), 2 + len(SEEDS) + 3 + 1), dtype=np.int64)
    for k in range(FOLDS):
        ballot[fold == k, :-1] = votes([t for t, f in zip(texts, fold) if f == k], [lexicons[k]])
    ballot[:, -1] = y  # the given labels are one more voter, whose errors are estimated like the others'
    target = label_model(ballot, 0.9 * y + 0.05).posterior(ballot)
    known = np.union1d(mine(texts, y), np.array([term_hash(w, False) for words in SEEDS.values() for w in words.split()], dtype=np.uint64))
    model = Model(known, np.zeros(len(known) + 1), 0.0)
    x = np.concatenate([model.features(texts[i : i + 64]).astype(np.float32) for i in range(0, len(texts), 64)])
    w, b = logistic(x, target[:, None], l2=2e-4, steps=250, rate=0.03)
    return Model(known, w[:, 0], float(b[0]))


def fit(df: DataFrame, labels: DataFrame, text: str = "text", label: str = "toxic", doc_id: str = "doc_id", where: Column | None = None, per_label: int = PER_LABEL) -> Model:
    """A model of the documents that `where` admits and that have a label of 0 or 1; several labels of one id: the largest."""
    marks = labels.where(F.col(label).isin(0, 1)).groupBy(F.col(doc_id).alias("__id")).agg(F.max(label).alias("__label"))
    docs = df.where(F.col(text).isNotNull() & (F.lit(True) if where is None else where)).select(F.col(doc_id).alias("__id"), F.col(text).alias("__text"))
    # ids first: the texts are then read for the sample alone, whose size is bounded
    got = sample(docs.select("__id").join(marks, "__id"), docs, "__label", per_label, "__id", "__text")
    return train([t for t, _ in got], [int(x) for _, x in got])


def score(df: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """df with score (0 to 1, higher: toxic likelier) and predicted (1 where score is at least 0.5).

    Null and empty texts get the score of a text without any term.
    """

    def run(texts: list) -> list:
        got = model.score(texts)
        return [pa.array(got), pa.array((got >= 0.5).astype(np.int32))]

    return map_rows(df, run, [text], [T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])
