"""Toxicity: a linear classifier of character n-grams that are scaled by naive Bayes log-count ratios."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mailloom.llm import kernels as K

#: Production parameters: lengths of n-grams in characters; the features are hashed into 2**HASH_BITS.
ORDERS, HASH_BITS = (3, 4, 5), 20
#: The classifier is fitted on this many labelled documents of each class at most.
MAX_TRAIN_ROWS = 1000
#: Probability from which on a document counts as toxic.
THRESHOLD = 0.6


@dataclass(frozen=True)
class Model:
    """Weights by hashed n-gram (with the log-count ratios multiplied in) and the intercept; without weights, nothing is toxic."""

    weights: np.ndarray | None
    bias: float = 0.0


def gram_ids(data: np.ndarray, off: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each order, the hashed n-grams of all rows and their offsets; n-grams don't cross rows."""
    cp, at = K.codepoints(data, off, pad=True)
    c = cp.astype(np.uint64) + np.uint64(1)
    out, g = [], c
    for n in range(2, max(ORDERS) + 1):
        g = g[:-1] * np.uint64(0x100000001B3) + c[n - 1 :] if len(g) else g
        if n in ORDERS:
            ids = ((g * np.uint64(0x9E3779B97F4A7C15) + np.uint64(n << 40)) >> np.uint64(64 - HASH_BITS)).astype(np.int32)
            out.append((ids, n))
    return [(ids, np.stack([at[:-1], np.maximum(at[:-1], at[1:] - (n - 1))])) for ids, n in out]


class Distinct:
    """Tells the distinct ids of a short list in time that grows with the list alone."""

    def __init__(self) -> None:
        self.last = np.zeros(1 << HASH_BITS, np.int32)
        self.count = np.arange(1 << 16, dtype=np.int32)

    def __call__(self, ids: np.ndarray) -> np.ndarray:
        if len(ids) > len(self.count):
            self.count = np.arange(2 * len(ids), dtype=np.int32)
        n = self.count[: len(ids)]
        self.last[ids] = n
        return ids[self.last[ids] == n]


def scores(data: np.ndarray, off: np.ndarray, model: Model, distinct: Distinct) -> np.ndarray:
    """The classifier's log-odds of each row: each n-gram of a row counts once, and so does an id that n-grams of two lengths share."""
    total = np.full(len(off) - 1, model.bias)
    live, ends = [], []
    for ids, at in gram_ids(data, off):
        some = np.flatnonzero(model.weights[ids] != 0)
        live.append(ids[some])
        ends.append(np.searchsorted(some, at))
    for r in range(len(off) - 1):
        own = [ids[at[0, r] : at[1, r]] for ids, at in zip(live, ends)]
        if any(map(len, own)):
            total[r] += model.weights[distinct(np.concatenate(own))].sum(dtype=np.float64)
    return total


def fit(texts: pa.Array, toxic: np.ndarray, rounds: int = 80, alpha: float = 1.0, ridge: float = 1e-3, least: int = 3, doubt: float = 2.0) -> Model:
    """Logistic regression on presences of n-grams times their log-count ratios; the classes weigh alike.

    A ratio is moved towards 0 by `doubt` times its standard error.  An n-gram that fewer than `least` documents have is left out.
    Without documents of both classes, a model that calls nothing toxic.
    """
    y = toxic.astype(np.float64)
    if not 0 < y.sum() < len(y):
        return Model(None)
    size = 1 << HASH_BITS
    seen = np.zeros((2, size), np.int32)
    for r, ids in _rows(texts):
        seen[int(y[r])][ids] += 1
    names = np.flatnonzero(seen.sum(0) >= least)
    at = np.full(size, -1, np.int32)
    at[names] = np.arange(len(names))
    cols = [found[found >= 0] for _, ids in _rows(texts) for found in (at[ids],)]
    col, ends = np.concatenate(cols), np.cumsum([len(c) for c in cols])
    del cols
    pos, neg = seen[1][names] + alpha, seen[0][names] + alpha
    ratio = np.log(pos / pos.sum()) - np.log(neg / neg.sum())
    # What chance may make of a ratio is taken off it.
    ratio = np.sign(ratio) * np.maximum(0, np.abs(ratio) - doubt * np.sqrt(1 / pos + 1 / neg))
    weight = np.where(y > 0, 0.5 / y.sum(), 0.5 / (len(y) - y.sum()))
    u, bias = np.zeros(len(names)), 0.0
    m, v = np.zeros(len(names) + 1), np.zeros(len(names) + 1)
    blocks = [(lo, min(lo + 100, len(y))) for lo in range(0, len(y), 100)]
    starts = ends - np.diff(ends, prepend=0)
    for t in range(1, rounds + 1):
        w, grad, gained = u * ratio, np.zeros(len(names)), 0.0
        for lo, hi in blocks:
            own, count = col[starts[lo] : ends[hi - 1]], ends[lo:hi] - starts[lo:hi]
            row = np.repeat(np.arange(hi - lo), count)
            z = np.bincount(row, w[own], hi - lo) + bias
            g = weight[lo:hi] * (1 / (1 + np.exp(-np.clip(z, -40, 40))) - y[lo:hi])
            grad += np.bincount(own, g[row], len(names))
            gained += g.sum()
        grad = np.r_[grad * ratio + ridge * u, gained]
        m = 0.9 * m + 0.1 * grad
        v = 0.99 * v + 0.01 * grad**2
        step = 0.02 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-10)
        u -= step[:-1]
        bias -= step[-1]
    out = np.zeros(size, np.float32)
    out[names] = u * ratio
    return Model(out, float(bias))


def _rows(texts: pa.Array) -> Iterator[tuple[int, np.ndarray]]:
    """Each row's number and distinct n-grams; orders hash apart, so an id that two of them share counts once."""
    distinct = Distinct()
    data, off = K.utf8(texts)
    for lo, hi in K.chunks(off):
        parts = gram_ids(data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo])
        for r in range(hi - lo):
            yield lo + r, distinct(np.concatenate([ids[at[0, r] : at[1, r]] for ids, at in parts]))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_rows: int = MAX_TRAIN_ROWS) -> Model:
    """Fit the classifier on labelled documents, max_rows of each class at most, chosen by a hash of their ids.

    labels has doc_id and toxic (0 or 1); rows with a null or another value are left out, and of several labels of a document the
    largest counts.  A document with a null text isn't used, and of several rows of one id the least text is.
    """
    given = labels.where("doc_id is not null and toxic in (0, 1)").groupBy(F.col("doc_id").alias("_id")).agg(F.max("toxic").alias("_toxic"))
    mixed = F.xxhash64("_id")
    few = None
    for c in (0, 1):
        part = given.where(F.col("_toxic") == c).orderBy(mixed, "_id").limit(max_rows)
        few = part if few is None else few.unionByName(part)
    rows = (
        docs.select(F.col(id_col).alias("_id"), F.lower(F.col(text_col)).alias("_text"))
        .where("_text is not null")
        .join(F.broadcast(few), "_id")  # 2 * max_rows rows at most
        .groupBy("_id")
        .agg(F.min("_text").alias("_text"), F.max("_toxic").alias("_toxic"))
        .toArrow()
        .sort_by([("_id", "ascending"), ("_text", "ascending")])
    )
    return fit(rows["_text"].combine_chunks() if rows.num_rows else pa.array([], pa.string()), rows["_toxic"].to_numpy())


def toxicity(text: Column, model: Model) -> Column:
    """Probability that a text is toxic.  Null for a null text; 0 for all texts if the model has no weights.  An empty text has no n-grams."""
    if model.weights is None:
        return F.when(text.isNotNull(), F.lit(0.0))
    shared = _broadcast(model)

    @F.arrow_udf("double")
    def run(column: pa.Array) -> pa.Array:
        data, off = K.utf8(column)
        distinct, out = Distinct(), [np.zeros(0)]
        for lo, hi in K.chunks(off):
            out.append(scores(data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo], shared.value, distinct))
        return pa.array(1 / (1 + np.exp(-np.clip(np.concatenate(out), -500, 500))), mask=column.is_null().to_numpy(zero_copy_only=False))

    return run(F.lower(text))


def _broadcast(model: Model):  # noqa: ANN202
    from pyspark.sql import SparkSession

    return SparkSession.active().sparkContext.broadcast(model)


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: doc_id, score (probability, null for a null text), toxic (false for a null text).

    An empty text has the score of the intercept.  Repeated rows are scored each, other columns are left out, and without labels of both
    classes all scores are 0.
    """
    model = train(docs, labels, id_col, text_col)
    found = docs.select(F.col(id_col).alias("doc_id"), toxicity(F.col(text_col), model).alias("score"))
    return found.select("doc_id", "score", F.coalesce(F.col("score") >= THRESHOLD, F.lit(False)).alias("toxic"))


def reject_toxic(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents, with all their columns, that aren't toxic; a null text stays."""
    model = train(docs, labels, id_col, text_col)
    return docs.where(F.coalesce(toxicity(F.col(text_col), model) < THRESHOLD, F.lit(True)))
