"""Small pieces shared by the trained operators: bounded samples, code-point arrays, logistic regression."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

#: Bytes of text that a sample may hold of each label.
MOST_BYTES = 64 << 20


def hash_limit(rows: int, of: int) -> int | None:
    """The signed 64-bit number below which `rows` of `of` evenly spread hashes are expected; None where all are wanted."""
    return None if rows >= of else ((rows << 64) // of) - (1 << 63)


def label_counts(df: DataFrame, label: str, doc_id: str, max_labels: int = 1000) -> dict:
    """About how many ids each label has.  The labels come to the driver, so more than max_labels of them is an error."""
    counts = df.groupBy(label).agg(F.approx_count_distinct(doc_id).alias("n")).orderBy(label).limit(max_labels + 1).collect()
    if len(counts) > max_labels:
        raise ValueError(f"more than {max_labels} labels")
    return {r[0]: r[1] for r in counts}


def bounded_ids(df: DataFrame, label: str, per_label: int, doc_id: str, counts: dict) -> DataFrame:
    """(doc_id, label): of each counted label the `per_label` ids with the least 64-bit hashes, each once, or all of fewer.

    About twice as many pass a limit on the hash first, so that what is ranked is bounded whatever the counts are.
    """
    keep, spread = F.lit(False), F.xxhash64(F.col(doc_id))
    for value, n in counts.items():
        limit = hash_limit(2 * per_label, n)
        keep = keep | ((F.col(label) == F.lit(value)) & (F.lit(True) if limit is None else spread < F.lit(limit)))
    near = df.select(doc_id, label).where(keep).distinct()
    rank = F.row_number().over(W.partitionBy(label).orderBy(F.xxhash64(F.col(doc_id)), F.col(doc_id)))
    return near.withColumn("__rank", rank).where(F.col("__rank") <= per_label).drop("__rank")


def sample(ids: DataFrame, docs: DataFrame, label: str, per_label: int, doc_id: str = "doc_id", text: str = "text", most_bytes: int = MOST_BYTES) -> list[tuple[str, object]]:
    """(text, label) of a bounded sample of the ids of `ids` (doc_id, label), to learn from, in a fixed order.

    docs: doc_id and text, and label where it is theirs.  At most `per_label` ids a label, the ones of least hash, and no
    more than `most_bytes` of texts a label, but for one that is longer alone; texts are whole.  An id that stands more than
    once gives one text.  Null ids, labels and texts are left out.  A label that has ids and gets no text is an error.
    """
    ids = ids.select(doc_id, label).where(F.col(doc_id).isNotNull() & F.col(label).isNotNull())
    counts = label_counts(ids, label, doc_id)
    chosen = bounded_ids(ids, label, per_label, doc_id, counts)
    on = [doc_id, label] if label in docs.columns else [doc_id]
    docs = docs.select(*on, text).where(F.col(text).isNotNull())
    # at most per_label rows for each of max_labels labels, whatever the tables hold
    met = docs.join(F.broadcast(chosen), on).groupBy(doc_id, label).agg(F.min_by(text, F.xxhash64(text)).alias(text))
    order = W.partitionBy(label).orderBy(F.xxhash64(F.col(doc_id)), F.col(doc_id))
    size = F.sum(F.octet_length(text).cast("long")).over(order)
    met = met.withColumns({"__size": size, "__rank": F.row_number().over(order)}).where((F.col("__size") <= most_bytes) | (F.col("__rank") == 1))
    rows = [(r[0], r[1]) for r in met.select(text, label).collect()]
    missing = set(counts) - {y for _, y in rows}
    if missing:
        raise ValueError(f"no row was sampled for {label} {sorted(missing)}")
    return sorted(rows, key=lambda r: (r[1], r[0]))


@lru_cache(1)
def letters() -> np.ndarray:
    """For each code point, whether it is a letter."""
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), dtype=bool, count=0x110000)


def code_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """All texts as one array of code points, each between two NULs of its own, and each code point's text number.

    Lone surrogates, which no text should hold, are passed on rather than stopping the job.
    """
    flat = "".join(f"\0{t}\0" for t in texts)
    chars = np.frombuffer(flat.encode("utf-32-le", "surrogatepass"), dtype="<u4")
    size = np.fromiter((len(t) + 2 for t in texts), dtype=np.int64, count=len(texts))
    return chars, np.repeat(np.arange(len(texts), dtype=np.int64), size)


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None, l2: float = 1e-4, steps: int = 300, rate: float = 0.05) -> tuple[np.ndarray, np.ndarray]:
    """Weights (features, outputs) and biases of independent logistic regressions on targets in 0..1, by Adam.

    Full batches from a zero start: the same rows in the same order give the same weights.
    """
    n, d = x.shape
    k = y.shape[1]
    w, b = np.zeros((d, k), x.dtype), np.zeros(k, x.dtype)
    y = y.astype(x.dtype)
    weight = np.full(n, 1 / n) if weight is None else weight / weight.sum()
    weight = weight.astype(x.dtype)
    m = [np.zeros_like(w), np.zeros_like(b)]
    v = [np.zeros_like(w), np.zeros_like(b)]
    for step in range(1, steps + 1):
        p = 1 / (1 + np.exp(-np.clip(x @ w + b, -30, 30)))
        err = (p - y) * weight[:, None]
        for i, (param, grad) in enumerate(((w, x.T @ err + l2 * w), (b, err.sum(0)))):
            m[i] = 0.9 * m[i] + 0.1 * grad
            v[i] = 0.999 * v[i] + 0.001 * grad**2
            param -= rate * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.999**step)) + 1e-8)
    return w, b
