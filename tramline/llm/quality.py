"""Quality by ordinal regression on graded ratings: one cumulative-link model over hashed text.

P(grade <= k) = sigmoid(threshold_k - w.x): all grades share the weights w of hashed features; the thresholds are in order. It
gives an expected grade and the probability of a grade or better, by which documents are chosen.

The model is fitted on the driver, on ``fit_rows`` rated documents at most, those whose ids have the least hashes; this bound and the
``bits`` of the hashed features bound what reaches the driver and what is sent to the workers. Scores read whole texts.

Null texts count as empty; of ratings that repeat a document the least counts; null ratings and ratings without a document are
left out; with fewer than two grades each document gets the only grade (or null, and stays) for sure; a tail of just the bound stays; rows
that repeat, or have no id, are scored each; an empty table gives an empty result. Other columns may have any name; one named like a
result is replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mixed, sliced, utf8
from .text_features import hashes

BITS, FIT_ROWS = 16, 5000


def features(data: np.ndarray, offsets: np.ndarray, bits: int = BITS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, column, value): share of a text's words that have a hashed word, shape, pair of shapes, or repeat the word before."""
    h = hashes(data, offsets)
    row, n = h["row"], np.bincount(h["row"], minlength=len(offsets) - 1)
    pair = np.r_[False, row[1:] == row[:-1]][: len(row)]  # texts may hold no word at all
    two = mixed(h["shape"][1:] ^ (h["shape"][:-1] << np.uint64(1)))
    hashed = [(row, mixed(h["word"] + np.uint64(1))), (row, mixed(h["shape"] + np.uint64(2))), (row[pair], two[pair[1:]]), (row[h["again"]], np.full(int(h["again"].sum()), 7, np.uint64))]
    rows = np.concatenate([r for r, _ in hashed])
    cols = np.concatenate([(x >> np.uint64(64 - bits)).astype(np.int64) if i < 3 else np.zeros(len(x), np.int64) for i, (_, x) in enumerate(hashed)])
    key, count = np.unique(rows << bits | cols, return_counts=True)
    rows, cols = key >> bits, key & ((1 << bits) - 1)
    return rows, cols, (count / n[rows]).astype(np.float64)


@dataclass(frozen=True)
class Ordinal:
    grades: np.ndarray
    thresholds: np.ndarray
    weights: np.ndarray

    def chances(self, score: np.ndarray) -> np.ndarray:
        """P(grade) of each score, grades ascending."""
        below = np.column_stack([sigmoid(self.thresholds[None, :] - score[:, None]), np.ones(len(score))])
        return np.diff(below, axis=1, prepend=0.0)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(x / 2))


def fit(row: np.ndarray, col: np.ndarray, value: np.ndarray, grade: np.ndarray, size: int, steps: int = 300, ridge: float = 1e-4, rate: float = 0.3) -> Ordinal:
    """Maximum likelihood with a ridge, by Adam on all rows; thresholds are a first one and logarithms of the gaps."""
    grades, y = np.unique(grade, return_inverse=True)
    k, n = len(grades), len(grade)
    if k < 2:
        return Ordinal(grades, np.zeros(0), np.zeros(size))
    share = np.cumsum(np.bincount(y, minlength=k))[:-1] / n
    start = np.log(share / (1 - share))
    p = np.concatenate([np.zeros(size), start[:1], np.log(np.maximum(np.diff(start), 1e-3))])
    m, v = np.zeros_like(p), np.zeros_like(p)
    for t in range(1, steps + 1):
        w, cut = p[:size], np.cumsum(np.r_[p[size], np.exp(p[size + 1 :])])
        score = np.bincount(row, w[col] * value, minlength=n)
        edge = np.concatenate([np.full((n, 1), -np.inf), cut[None, :] - score[:, None], np.full((n, 1), np.inf)], axis=1)
        c = np.where(np.isinf(edge), edge > 0, sigmoid(np.where(np.isinf(edge), 0, edge)))
        d = np.where(np.isinf(edge), 0.0, c * (1 - c))
        each = np.arange(n)
        chance = np.maximum(c[each, y + 1] - c[each, y], 1e-12)
        up, down = d[each, y + 1] / chance, d[each, y] / chance
        by_cut = np.bincount(np.r_[y, np.maximum(y - 1, 0)], np.r_[-up, down] * np.r_[y < k - 1, y > 0], minlength=k)[: k - 1]
        tail = np.cumsum(by_cut[::-1])[::-1]
        g = np.concatenate([np.bincount(col, (up - down)[row] * value, minlength=size) / n + ridge * w, [tail[0] / n], tail[1:] * np.exp(p[size + 1 :]) / n])
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        p = p - rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return Ordinal(grades, np.cumsum(np.r_[p[size], np.exp(p[size + 1 :])]), p[:size])


def rated(docs: DataFrame, labels: DataFrame, rows: int, *columns: str) -> DataFrame:
    """(text, *columns) of at most ``rows`` labelled documents, by the least hashes of their ids."""
    known = labels.where("doc_id is not null").groupBy("doc_id").agg(*(F.min(c).alias(c) for c in columns))
    for c in columns:
        known = known.where(F.col(c).isNotNull())
    some = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(some), "doc_id").select("text", *columns)  # at most ``rows`` rows


def fitted(docs: DataFrame, labels: DataFrame, grade: str = "quality", fit_rows: int = FIT_ROWS, bits: int = BITS) -> Ordinal:
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "text"):
            row, col, value = features(*utf8(batch.column(0)), bits)
            cuts = np.searchsorted(row, np.arange(len(batch) + 1)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.ListArray.from_arrays(cuts, pa.array(col.astype(np.int32))), pa.ListArray.from_arrays(cuts, pa.array(value.astype(np.float32)))], ["grade", "col", "value"])

    got = rated(docs, labels, fit_rows, grade).select("text", F.col(grade).cast("double").alias("grade")).mapInArrow(each, "grade double, col array<int>, value array<float>").toArrow()
    size = got["col"].combine_chunks().value_lengths().to_numpy() if len(got) else np.zeros(0, np.int64)
    col, value = (got[c].combine_chunks().flatten().to_numpy() if len(got) else np.zeros(0) for c in ("col", "value"))
    by = np.lexsort((np.add.reduceat(value, np.r_[0, np.cumsum(size)[:-1]]) if len(value) and (size > 0).all() else size, got["grade"].to_numpy()))  # the order of rows must not matter
    rank = np.empty(len(by), np.int64)
    rank[by] = np.arange(len(by))
    return fit(np.repeat(rank, size), col.astype(np.int64), value.astype(np.float64), got["grade"].to_numpy()[by], 1 << bits)


def scored(docs: DataFrame, model: Ordinal, at_least: float | None = None, bits: int = BITS) -> DataFrame:
    """``docs`` with expected_grade and tail (chance of grade ``at_least`` or better, by default the best)."""
    docs = docs.drop("expected_grade", "tail")
    names = docs.columns
    send = docs.sparkSession.sparkContext.broadcast(model)  # 2^bits weights

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: Ordinal = send.value
        good = own.grades >= (own.grades.max() if at_least is None else at_least) if len(own.grades) else np.zeros(0, bool)
        for batch in sliced(batches, "text"):
            data, off = utf8(batch.column(names.index("text")))
            row, col, value = features(data, off, bits)
            chance = own.chances(np.bincount(row, own.weights[col] * value, minlength=len(batch)))
            mean, tail = (pa.array(chance @ own.grades), pa.array(chance @ good.astype(float))) if len(own.grades) else (pa.nulls(len(batch), pa.float64()),) * 2
            yield pa.RecordBatch.from_arrays([*batch.columns, mean, tail], [*names, "expected_grade", "tail"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return docs.mapInArrow(each, f"{schema}, expected_grade double, tail double")


def digest(docs: DataFrame, labels: DataFrame, keep: float = 0.5) -> DataFrame:
    """What the query returns: (doc_id, expected_grade, tail, kept)."""
    return scored(docs.select("doc_id", "text"), fitted(docs, labels)).select("doc_id", F.round("expected_grade", 6).alias("expected_grade"), F.round("tail", 6).alias("tail"), (F.coalesce("tail", F.lit(1.0)) >= keep).alias("kept"))


def selected(docs: DataFrame, labels: DataFrame, keep: float = 0.5) -> DataFrame:
    """The documents whose chance of the best grade is at least ``keep``, with their own columns."""
    names = docs.columns
    plain = docs.toDF(*(f"c{i}" if n != "text" else "text" for i, n in enumerate(names)))
    return scored(plain, fitted(docs, labels)).where(F.coalesce("tail", F.lit(1.0)) >= keep).drop("expected_grade", "tail").toDF(*names)
