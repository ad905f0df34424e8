"""A convolutional classifier of token ids in numpy, masking of ids, and neighbours among vectors."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyarrow.fs import FileSelector, FileSystem
from pyarrow.parquet import ParquetFile
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mailloom.session import shared_path

LENGTH, KERNELS, FILTERS, HIDDEN = 256, (2, 3, 4, 5), 128, 32


def pad(ids: Column, length: int = LENGTH) -> Column:
    """The first `length` ids, filled up with 0."""
    return F.slice(F.concat(ids, F.array_repeat(F.lit(0), length)), 1, length)


def masked(ids: Column, share: float, seed: int = 0) -> Column:
    """Ids of which a share, drawn by place and id, become 0."""
    return F.transform(ids, lambda x, i: F.when(F.pmod(F.xxhash64(x, i, F.lit(seed)), F.lit(1000)) < int(1000 * share), 0).otherwise(x))


def fresh(vocabulary: int, dims: int = 64, seed: int = 0) -> dict[str, np.ndarray]:
    """Untrained weights; the vector of id 0 is 0."""
    rng = np.random.default_rng(seed)
    w = {"ids": rng.standard_normal((vocabulary, dims)).astype(np.float32) * 0.5}
    w["ids"][0] = 0
    for k in KERNELS:
        w[f"conv{k}"] = (rng.standard_normal((k * dims, FILTERS)) / np.sqrt(k * dims)).astype(np.float32)
        w[f"bias{k}"] = np.zeros(FILTERS, np.float32)
    n = len(KERNELS) * FILTERS
    w |= {"w1": (rng.standard_normal((n, HIDDEN)) / np.sqrt(n)).astype(np.float32), "b1": np.zeros(HIDDEN, np.float32)}
    return w | {"w2": (rng.standard_normal((HIDDEN, 2)) / np.sqrt(HIDDEN)).astype(np.float32), "b2": np.zeros(2, np.float32)}


def logits(ids: np.ndarray, w: dict[str, np.ndarray]) -> np.ndarray:
    """Two logits for each row of ids: convolutions of several widths, their maxima over the row, and two layers."""
    x = w["ids"][ids]
    dims, tops = x.shape[2], []
    for k in KERNELS:
        # A place's part by each row of a kernel, moved to where the kernel begins, and added up.
        parts = (x.reshape(-1, dims) @ w[f"conv{k}"].reshape(k, dims, FILTERS).transpose(1, 0, 2).reshape(dims, -1)).reshape(len(x), x.shape[1], k, FILTERS)
        total = parts[:, : x.shape[1] - k + 1, 0]
        for j in range(1, k):
            total = total + parts[:, j : x.shape[1] - k + 1 + j, j]
        tops.append(total.max(1) + w[f"bias{k}"])
    h = np.maximum(np.maximum(np.concatenate(tops, 1), 0) @ w["w1"] + w["b1"], 0)
    return h @ w["w2"] + w["b2"]


def scores(rows: DataFrame, weights: dict[str, np.ndarray], id_col: str, ids_col: str, length: int = LENGTH) -> DataFrame:
    """idx and score: 100 times the normalised sigmoid of the first class; null ids count as none."""
    shared = rows.sparkSession.sparkContext.broadcast(weights)  # the vocabulary times the vectors' length

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(1).flatten().to_numpy().reshape(-1, length)
            out = [np.zeros(0)]
            for k in range(0, len(ids), 64):
                s = 1 / (1 + np.exp(-logits(ids[k : k + 64], shared.value).astype(np.float64)))
                out.append(100 * s[:, 0] / s.sum(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate(out))], ["idx", "score"])

    filled = pad(F.coalesce(F.col(ids_col), F.array().cast("array<int>")), length)
    return rows.select(F.col(id_col).cast("bigint").alias("idx"), filled.alias("ids")).mapInArrow(run, "idx bigint, score double")


def scorer(weights: dict[str, np.ndarray], tokenize: Callable[[Column], Column], length: int = LENGTH) -> Callable[[DataFrame, str, str], DataFrame]:
    """A function that scores the texts of a table: idx and score.  tokenize turns texts into ids and can be any column function."""
    return lambda rows, id_col, text_col: scores(rows.select(id_col, tokenize(F.col(text_col)).alias("_ids")), weights, id_col, "_ids", length)


#: Queries of a task, about, and vectors that they meet at once.
BLOCK, AT_ONCE = 16_384, 4096


def _unit(vectors: pa.Array, count: int) -> np.ndarray:
    m = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(count, -1)
    return m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-12)


def _best(rows: np.ndarray, r: np.ndarray, ids: np.ndarray, c: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
    """The k least of each row by r and id, in order."""
    order = np.lexsort((ids, r, rows))
    rows = rows[order]
    few = np.arange(len(rows)) - np.searchsorted(rows, rows) < k
    return rows[few], *(x[order[few]] for x in (r, ids, c))


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "vec_id", vec_col: str = "embedding", block: int = BLOCK) -> DataFrame:
    """query, rank, vec_id and cosine: the k most similar other vectors of each query (ties by id), exactly.

    The vectors are written once to the shared folder; each task holds a block of queries and what is nearest so far, and reads all vectors
    past them.  So queries move once and vectors never, however many there are; null vectors don't count.
    """
    spark = vectors.sparkSession
    place = shared_path(spark, "nearest")
    held, asked = (x.select(F.col(id_col).cast("bigint").alias("id"), F.col(vec_col).alias("vec")).where("vec is not null") for x in (vectors, queries))
    held.write.parquet(place)
    count = asked.count()
    tasks = max(1, -(-count // block), min(spark.sparkContext.defaultParallelism, count // 256))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = [b for b in batches if b.num_rows]
        if not own:
            return
        own = pa.Table.from_batches(own).combine_chunks()
        names, m = own["id"].to_numpy(), _unit(own["vec"].combine_chunks(), own.num_rows)
        none = np.zeros(0, np.int64)
        # Of each group of queries: rows, minus the rounded cosines, ids and cosines of the nearest so far.
        found = {lo: (none, np.zeros(0), none, np.zeros(0)) for lo in range(0, len(m), 256)}
        last = np.full(len(m), np.inf)
        system, root = FileSystem.from_uri(place)
        for path in sorted(f.path for f in system.get_file_info(FileSelector(root)) if f.path.endswith(".parquet")):
            with system.open_input_file(path) as file:
                for part in ParquetFile(file).iter_batches(AT_ONCE, columns=["id", "vec"]):
                    ids, units = part["id"].to_numpy(), _unit(part["vec"], part.num_rows)
                    for lo, before in found.items():
                        c = m[lo : lo + 256] @ units.T
                        r = -np.round(c, 9)
                        r[names[lo : lo + 256][:, None] == ids[None, :]] = np.inf
                        limit = last[lo : lo + 256]
                        if len(before[0]) < k * len(c) and len(ids) > k:
                            limit = np.fmin(limit, np.partition(r, k - 1, axis=1)[:, k - 1])
                        x, y = np.nonzero((r <= limit[:, None]) & np.isfinite(r))
                        if len(x):
                            best = _best(*map(np.concatenate, zip(before, (x, r[x, y], ids[y], c[x, y]))), k)
                            found[lo] = best
                            full = np.flatnonzero(np.bincount(best[0], minlength=len(c)) == k)
                            last[lo + full] = best[1][np.searchsorted(best[0], full, "right") - 1]
        for lo, (x, _, ids, c) in found.items():
            rank = np.arange(len(x)) - np.searchsorted(x, x) + 1
            yield pa.RecordBatch.from_arrays([pa.array(v) for v in (names[lo + x], rank.astype(np.int32), ids, c)], ["query", "rank", "vec_id", "cosine"])

    near = asked.repartition(tasks, "id").mapInArrow(run, "query bigint, rank int, vec_id bigint, cosine double")
    return near.withColumn("cosine", F.round("cosine", 6))
