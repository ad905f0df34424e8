"""Training of the convolutional classifier in numpy: tasks train copies on their rows, which are averaged after each epoch."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mailloom.operators import metrics, model
from mailloom.sources.sinks import load_weights

#: Numbers of the weights in a row in which they travel.
_WIDE = 64


def gradients(ids: np.ndarray, labels: np.ndarray, w: dict[str, np.ndarray]) -> tuple[float, int, dict[str, np.ndarray]]:
    """Sum of the log losses, rows that are right, and the gradients of the mean loss by all weights but the ids' vectors, which stay."""
    x = w["ids"][ids]
    kept, tops = [], []
    for k in model.KERNELS:
        spans = np.lib.stride_tricks.sliding_window_view(x, k, axis=1).transpose(0, 1, 3, 2).reshape(len(x), x.shape[1] - k + 1, -1)
        y = spans @ w[f"conv{k}"]
        at = y.argmax(1)
        kept.append((k, spans, at))
        tops.append(np.take_along_axis(y, at[:, None], 1)[:, 0] + w[f"bias{k}"])
    c = np.maximum(np.concatenate(tops, 1), 0)
    h = np.maximum(c @ w["w1"] + w["b1"], 0)
    z = h @ w["w2"] + w["b2"]
    z = z - z.max(1, keepdims=True)
    p = np.exp(z) / np.exp(z).sum(1, keepdims=True)
    rows = np.arange(len(ids))
    loss, right = float(-np.log(np.maximum(p[rows, labels], 1e-12)).sum()), int((p.argmax(1) == labels).sum())
    dz = p.copy()
    dz[rows, labels] -= 1
    dz /= len(ids)
    g = {"w2": h.T @ dz, "b2": dz.sum(0)}
    dh = (dz @ w["w2"].T) * (h > 0)
    g |= {"w1": c.T @ dh, "b1": dh.sum(0)}
    dc = np.split((dh @ w["w1"].T) * (c > 0), len(model.KERNELS), axis=1)
    for (k, spans, at), d in zip(kept, dc):
        g[f"bias{k}"] = d.sum(0)
        g[f"conv{k}"] = np.einsum("bf,bfd->df", d, spans[rows[:, None], at])
    return loss, right, g


def _names(w: dict[str, np.ndarray]) -> list[str]:
    return sorted(k for k in w if k != "ids")


def _flat(w: dict[str, np.ndarray]) -> np.ndarray:
    x = np.concatenate([w[k].ravel() for k in _names(w)]).astype(np.float64)
    return np.r_[x, np.zeros(-len(x) % _WIDE)].reshape(-1, _WIDE)


def train(rows: DataFrame, weights: dict[str, np.ndarray], epochs: int = 15, batch: int = 1024, rate: float = 1e-3, drop: float = 0.1, held: DataFrame | None = None, slack: float = 1e-4, length: int = model.LENGTH, after: Callable[[dict, dict], None] | None = None) -> tuple[dict[str, np.ndarray], list[dict]]:
    """The weights of the best epoch (the last one without held-out rows), and a log: epoch, rate, loss, accuracy, and the held-out loss and cost.

    rows (and held) have ids (array of int) and label_id (0 or 1).  In each epoch a share `drop` of the ids, drawn anew, becomes 0; the
    rate falls along a cosine.  An epoch is the best if its held-out loss is lower than that of the best one before by more than `slack`.
    Rows with a null are left out; without rows the weights stay.  `after` is called with an epoch's line of the log and its weights.
    """
    spark, log, best, least = rows.sparkSession, [], weights, None
    good = rows.where("ids is not null and label_id in (0, 1)").select("ids", F.col("label_id").cast("int").alias("label_id"))
    for epoch in range(epochs):
        now = rate * 0.5 * (1 + math.cos(math.pi * epoch / epochs))
        shared = spark.sparkContext.broadcast(weights)  # the vocabulary times the vectors' length

        def run(batches: Iterator[pa.RecordBatch], shared=shared, now=now) -> Iterator[pa.RecordBatch]:  # noqa: ANN001
            w = dict(shared.value)
            m, v = ({k: np.zeros(w[k].shape) for k in _names(w)} for _ in range(2))
            steps, seen, losses, rights = 0, 0, 0.0, 0
            for part in batches:
                ids, labels = part.column(0).flatten().to_numpy().reshape(-1, length), part.column(1).to_numpy()
                for lo in range(0, len(ids), batch):
                    for k in range(lo, min(lo + batch, len(ids)), 64):
                        # Rows of a step are worked on 64 at a time; their gradients are added up.
                        piece = slice(k, min(k + 64, lo + batch))
                        loss, right, g = gradients(ids[piece], labels[piece], w)
                        share = len(ids[piece])
                        total = {n: x * share for n, x in g.items()} if k == lo else {n: total[n] + x * share for n, x in g.items()}
                        losses, rights = losses + loss, rights + right
                    n = len(ids[lo : lo + batch])
                    steps, seen = steps + 1, seen + n
                    for name in _names(w):
                        d = total[name] / n
                        m[name] = 0.9 * m[name] + 0.1 * d
                        v[name] = 0.999 * v[name] + 0.001 * d * d
                        w[name] = (w[name] - now * (m[name] / (1 - 0.9**steps)) / (np.sqrt(v[name] / (1 - 0.999**steps)) + 1e-8)).astype(np.float32)
            if seen:
                x = _flat(w) * seen
                place = np.arange(len(x) + 1)
                x = np.concatenate([x, [[losses, rights, seen] + [0.0] * (_WIDE - 3)]])
                yield pa.RecordBatch.from_arrays([pa.array(place), *(pa.array(x[:, k].copy()) for k in range(_WIDE))], ["place", *(f"v{k}" for k in range(_WIDE))])

        kinds = "place bigint, " + ", ".join(f"v{k} double" for k in range(_WIDE))
        fed = good.select(model.pad(model.masked(F.col("ids"), drop, epoch), length).alias("ids"), "label_id")
        found = fed.mapInArrow(run, kinds).groupBy("place").agg(*(F.sum(f"v{k}").alias(f"v{k}") for k in range(_WIDE))).toArrow().sort_by("place")
        if not found.num_rows:
            break
        x = np.stack([found[f"v{k}"].to_numpy() for k in range(_WIDE)], 1)
        losses, rights, seen = x[-1, :3].tolist()
        flat, at, weights = (x[:-1] / seen).ravel(), 0, dict(weights)
        for k in _names(weights):
            weights[k] = flat[at : at + weights[k].size].reshape(weights[k].shape).astype(np.float32)
            at += weights[k].size
        line = {"epoch": epoch, "rate": now, "loss": losses / seen, "accuracy": rights / seen}
        if held is None:
            best = weights
        else:
            line |= test(held, weights, length)
            if least is None or line["held_loss"] < least - slack:
                best, least = weights, line["held_loss"]
        log.append(line)
        if after:
            after(line, weights)
    return best, log


def grid(rows: DataFrame, held: DataFrame, weights: dict[str, np.ndarray], rates: list[float], drops: list[float], **parameters) -> tuple[dict[str, np.ndarray], list[dict]]:  # noqa: ANN003
    """The weights of the best of all pairs of a rate and a share of dropped ids, by the held-out loss, and a line for each: rate, drop and
    the log's line of its best epoch.  Further parameters are those of train()."""
    best, lines = weights, []
    for rate in rates:
        for drop in drops:
            found, log = train(rows, weights, rate=rate, drop=drop, held=held, **parameters)
            line = {"start": rate, "drop": drop, **min(log, key=lambda x: x["held_loss"])}
            if not lines or line["held_loss"] < min(x["held_loss"] for x in lines):
                best = found
            lines.append(line)
    return best, lines


def test(rows: DataFrame, weights: dict[str, np.ndarray], length: int = model.LENGTH) -> dict:
    """held_loss, held_accuracy and cost of labelled rows of ids."""
    numbered = rows.where("ids is not null and label_id in (0, 1)").select(F.monotonically_increasing_id().alias("at"), F.col("label_id"), "ids")
    scored = model.scores(numbered.select((F.col("at") * 2 + F.col("label_id")).alias("at"), "ids"), weights, "at", "ids", length)
    scored = scored.select((F.col("score") / 100).alias("p0"), (F.col("score") / 100).alias("score"), (F.col("idx") % 2).alias("label_id"))
    one = metrics.accuracy_loss(scored).crossJoin(metrics.spam_metrics(scored).select("cost")).first()
    return {"held_loss": one.loss, "held_accuracy": one.accuracy, "cost": one.cost}


def report(rows: DataFrame, smoke: DataFrame, paths: list[str], length: int = model.LENGTH) -> DataFrame:
    """A row for each saved model, in their order: path, held_loss, held_accuracy and cost over labelled rows, the mean score of a smoke
    corpus of spam, how many of its scores are over 80 and under 20, and the deviation of the layers' weights and the share near 0."""
    spark, lines = rows.sparkSession, []
    for path in paths:
        w = load_weights(spark, path)
        marked = model.scores(smoke.select(F.monotonically_increasing_id().alias("at"), "ids"), w, "at", "ids", length)
        one = marked.agg(F.avg("score").alias("mean"), F.count_if(F.col("score") > 80).alias("ok"), F.count_if(F.col("score") < 20).alias("bad")).first()
        flat = w["w1"].ravel()
        dead = int((w["w1"].max(0) < 0.1).sum())
        lines.append({"path": path, **test(rows, w, length), "mean": one.mean, "ok": one.ok, "bad": one.bad, "deviation": float(flat.std(ddof=1)), "near_zero": float((np.abs(flat) < 0.1 * flat.std(ddof=1)).mean()), "dead": dead})
    return spark.createDataFrame(lines, "path string, held_loss double, held_accuracy double, cost double, mean double, ok bigint, bad bigint, deviation double, near_zero double, dead bigint")
