"""Toxicity by a classifier chain.

Categories are predicted one after the other. Each has a linear model over the presence of words and of beginnings of words (by 64-bit
hash, so that they do not share a weight) and of shapes of words, and over the log odds that the models before it gave. Those odds are made out of
fold when the next model is trained, so it learns from predictions as good as it will meet.

The models are fitted on the driver, on ``fit_rows`` labelled documents at most, those whose ids have the least hashes. A model keeps
features found in ``least`` of them or more whose link with the category is clearly beyond chance; this bounds its size. Scores
read whole texts.

The last category decides whether a document goes, so every link of the chain takes part.

Null texts count as empty; of labels that repeat a document the least counts; documents with a null label do not train; a category
that is always or never true, as without labels, is predicted so; ties go with the greater or equal probability; rows that repeat
are scored each; an empty table gives an empty result. Other columns may have any name; one named like a result is replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import mixed, sliced, utf8
from .quality import rated, sigmoid
from .text_features import hashes

FIT_ROWS, FOLDS, LEAST = 6000, 5, 5
#: Lengths in bytes of the beginnings of words that are features.
PREFIXES = (4, 6, 8)
#: Categories in the order of the chain, from the columns of ``labels``. The last decides; it is given what the narrower ones before it predict.
CATEGORIES: dict[str, Column | str] = {"toxic_prose": "toxic * quality", "toxic_junk": "toxic * (1 - quality)", "toxic": "toxic"}

_LAST = f"p_{list(CATEGORIES)[-1]}"


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of the words, beginnings of words and shapes of words that a text has, each once."""
    h = hashes(data, offsets, PREFIXES)
    row = np.concatenate([h["row"]] * (2 + len(PREFIXES)))
    key = np.concatenate([h["word"], mixed(h["shape"] ^ np.uint64(0x5A5A5A5A5A5A5A5A)), *(mixed(h[f"first{k}"] + np.uint64(k)) for k in PREFIXES)])
    by = np.lexsort((key, row))
    row, key = row[by], key[by]
    new = np.r_[True, (row[1:] != row[:-1]) | (key[1:] != key[:-1])] if len(row) else np.zeros(0, bool)
    return row[new], key[new]


@dataclass(frozen=True)
class Linear:
    keys: np.ndarray  # ascending
    weights: np.ndarray
    chain: np.ndarray
    bias: float

    def odds(self, row: np.ndarray, key: np.ndarray, before: np.ndarray) -> np.ndarray:
        n = len(before)
        if len(self.keys) and len(key):
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            hit = self.keys[at] == key
            word = np.bincount(row[hit], self.weights[at[hit]], minlength=n)
        else:
            word = np.zeros(n)
        return np.clip(self.bias + word + before @ self.chain, -12, 12)


def fit(row: np.ndarray, key: np.ndarray, before: np.ndarray, y: np.ndarray, least: int = LEAST, steps: int = 500, ridge: float = 1e-3, rate: float = 0.2) -> Linear:
    n = len(y)
    share = y.mean() if n else 0.0
    none = np.zeros(0)
    if share in (0.0, 1.0):
        return Linear(none.astype(np.uint64), none, np.zeros(before.shape[1]), 12.0 if share else -12.0)
    keys, col, count = np.unique(key, return_inverse=True, return_counts=True)
    hits = np.bincount(col, y[row], minlength=len(keys))
    z = (hits - count * share) / np.sqrt(count * share * (1 - share) * np.maximum(1 - count / n, 1e-9) + 1e-12)
    keep = (count >= least) & (np.abs(z) >= 6)
    place = np.cumsum(keep) - 1
    use = keep[col]
    row, col, keys = row[use], place[col[use]], keys[keep]
    k, c = len(keys), before.shape[1]
    p = np.r_[np.zeros(k + c), np.log(share / (1 - share))]
    m, v = np.zeros_like(p), np.zeros_like(p)
    for t in range(1, steps + 1):
        e = sigmoid(np.bincount(row, p[col], minlength=n) + before @ p[k : k + c] + p[-1]) - y
        g = np.r_[np.bincount(col, e[row], minlength=k) / n, before.T @ e / n, e.mean()]
        g[: k + c] += ridge * p[: k + c] * (np.r_[np.full(k, 0.02), np.ones(c)])
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        p = p - rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return Linear(keys, p[:k], p[k : k + c], float(p[-1]))


def fit_chain(row: np.ndarray, key: np.ndarray, y: np.ndarray, folds: int = FOLDS) -> list[Linear]:
    """y: a column for each category, in order. Rows are dealt to the folds in turn."""
    n, k = y.shape
    fold = np.arange(n) % folds
    before = np.zeros((n, 0))
    models = []
    for j in range(k):
        models.append(fit(row, key, before, y[:, j]))
        odds = np.zeros(n)
        for f in range(folds):
            rest, own = fold != f, fold == f
            place = np.cumsum(rest) - 1
            part = rest[row]
            odds[own] = fit(place[row[part]], key[part], before[rest], y[rest, j]).odds(row, key, before)[own]
        before = np.column_stack([before, odds])
    return models


def fitted(docs: DataFrame, labels: DataFrame, categories: dict = CATEGORIES, fit_rows: int = FIT_ROWS) -> list[Linear]:
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "text"):
            row, key = features(*utf8(batch.column(0)))
            cuts = np.searchsorted(row, np.arange(len(batch) + 1)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.ListArray.from_arrays(cuts, pa.array(key.view(np.int64)))], ["y", "key"])

    marks = labels.select("doc_id", *(F.expr(e).cast("double").alias(f"y{i}") if isinstance(e, str) else e.cast("double").alias(f"y{i}") for i, e in enumerate(categories.values())))
    some = rated(docs, marks, fit_rows, *(f"y{i}" for i in range(len(categories))))
    got = some.select("text", F.array(*(f"y{i}" for i in range(len(categories)))).alias("y")).mapInArrow(each, "y array<double>, key array<long>").toArrow()
    if not len(got):
        return fit_chain(np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros((0, len(categories))))
    keys, y = got["key"].combine_chunks(), got["y"].combine_chunks().flatten().to_numpy().reshape(len(got), -1)
    size = keys.value_lengths().to_numpy()
    flat = keys.flatten().to_numpy().view(np.uint64)
    sums = np.bincount(np.repeat(np.arange(len(y)), size), (flat >> np.uint64(40)).astype(float), minlength=len(y))
    by = np.lexsort((sums, size, *y.T))  # the order of rows must not matter
    rank = np.empty(len(by), np.int64)
    rank[by] = np.arange(len(by))
    return fit_chain(np.repeat(rank, size), flat, y[by])


def scored(docs: DataFrame, models: list[Linear], categories: dict = CATEGORIES) -> DataFrame:
    """``docs`` with a probability p_<category> for each category."""
    more = [f"p_{c}" for c in categories]
    docs = docs.drop(*more)
    names = docs.columns
    send = docs.sparkSession.sparkContext.broadcast(models)  # bounded by fit_rows and ``least``

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "text"):
            row, key = features(*utf8(batch.column(names.index("text"))))
            before = np.zeros((len(batch), 0))
            for model in send.value:
                before = np.column_stack([before, model.odds(row, key, before)])
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(sigmoid(before[:, i])) for i in range(len(more)))], [*names, *more])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return docs.mapInArrow(each, schema + "".join(f", {c} double" for c in more))


def digest(docs: DataFrame, labels: DataFrame, most: float = 0.35) -> DataFrame:
    """What the query returns: (doc_id, p_<category>..., toxic)."""
    out = scored(docs.select("doc_id", "text"), fitted(docs, labels))
    return out.select("doc_id", *(F.round(f"p_{c}", 6).alias(f"p_{c}") for c in CATEGORIES), (F.col(_LAST) >= most).alias("toxic"))


def clean(docs: DataFrame, labels: DataFrame, most: float = 0.35) -> DataFrame:
    """The documents with a probability of the last category under ``most``, with their own columns."""
    names = docs.columns
    plain = docs.toDF(*(f"c{i}" if n != "text" else "text" for i, n in enumerate(names)))
    return scored(plain, fitted(docs, labels)).where(F.col(_LAST) < most).select(*plain.columns).toDF(*names)
