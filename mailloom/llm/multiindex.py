"""Approximate nearest neighbours by an inverted multi-index: each half of the vectors is quantised by a codebook of its own."""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from mailloom.llm import store

#: Production parameters: neighbours of each vector; vectors in a cell (a pair of centroids) on average; centroids of a half at most
#: (which bounds what the driver and the tasks hold of the index); passes of k-means over all vectors.
NEIGHBOURS, CELL, MOST_CENTROIDS, ROUNDS = 10, 32, 1024, 5
#: The first traversal ends at this many candidates.  The second goes on till a cell's vectors, whose distances are spread about the
#: cell's own by chance, would have to lie MARGIN deviations below their mean to be nearer than the worst neighbour of the first.
START, MARGIN = 512, 3.0
#: Cells are searched in groups of about this many vectors; few groups are split by queries into TASKS parts.
GROUP, TASKS = 1 << 15, 32

_ROW = "group int, split int, kind int, key bigint, vec array<float>, cell int, lim double, worst double"


@dataclass(frozen=True)
class Index:
    """Centroids of the halves, vectors and group by cell (the first half's centroid times their number, plus the second's), the mean
    squared distance of a vector to its cell, the vectors' length and the number of groups and of splits."""

    one: np.ndarray
    two: np.ndarray
    count: np.ndarray
    group: np.ndarray
    spread: float
    dims: int
    groups: int
    splits: int


def matrix(column: pa.Array, dims: int) -> np.ndarray:
    """An Arrow column of lists of one length as a matrix."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float32, copy=False).reshape(len(column), dims)


def away(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Squared distances of rows to centroids."""
    x = x.astype(np.float64)
    d = (x * x).sum(1)[:, None] - 2 * x @ centroids.T + (centroids * centroids).sum(1)
    return np.maximum(d, 0.0)


def traverse(first: np.ndarray, second: np.ndarray) -> Iterator[tuple[float, int, int]]:
    """All pairs of centroids of the halves, by the sum of their distances; a heap holds the next pair of each begun row."""
    a, b = np.argsort(first, kind="stable"), np.argsort(second, kind="stable")
    x, y, a, b = first[a].tolist(), second[b].tolist(), a.tolist(), b.tolist()
    heap = [(x[0] + y[0], 0, 0)]
    while heap:
        s, i, j = heapq.heappop(heap)
        yield s, a[i], b[j]
        if j == 0 and i + 1 < len(x):
            heapq.heappush(heap, (x[i + 1] + y[0], i + 1, 0))
        if j + 1 < len(y):
            heapq.heappush(heap, (x[i] + y[j + 1], i, j + 1))


def along(centroids: np.ndarray) -> np.ndarray:
    """Centroids in order along the line on which they differ most, so that groups of neighbouring numbers lie close."""
    if len(centroids) < 2 or not centroids.shape[1]:
        return centroids
    c = centroids - centroids.mean(0)
    return centroids[np.argsort(c @ np.linalg.svd(c, full_matrices=False)[2][0], kind="stable")]


def _moved(points: DataFrame, one: np.ndarray, two: np.ndarray, dims: int, scale: float) -> list[np.ndarray]:
    """The centroids' next places: means over all vectors, summed as integers so that no order of the sums alters them."""
    half = dims // 2
    size = max(half, dims - half)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = [np.zeros((len(c), size), np.int64) for c in (one, two)]
        counts = [np.zeros(len(c), np.int64) for c in (one, two)]
        for batch in batches:
            v = matrix(batch.column(0), dims)
            for h, (x, c) in enumerate(((v[:, :half], one), (v[:, half:], two))):
                at = away(x, c).argmin(1)
                counts[h] += np.bincount(at, minlength=len(c))
                np.add.at(sums[h][:, : x.shape[1]], at, np.rint(x.astype(np.float64) * scale).astype(np.int64))
        for h in range(2):
            fields = [pa.array(np.full(len(counts[h]), h, np.int32)), pa.array(np.arange(len(counts[h]), dtype=np.int32)), pa.array(counts[h])]
            fields += [pa.array(sums[h][:, k].copy()) for k in range(size)]
            yield pa.RecordBatch.from_arrays(fields, ["half", "c", "n", *(f"s{k}" for k in range(size))])

    kinds = "half int, c int, n bigint, " + ", ".join(f"s{k} bigint" for k in range(size))
    each = points.select("vec").mapInArrow(run, kinds).groupBy("half", "c").agg(*(F.sum(x).alias(x) for x in ("n", *(f"s{k}" for k in range(size)))))
    found = each.toArrow()
    out = []
    for h, old in enumerate((one, two)):
        part = found.filter(pc.equal(found["half"], h))
        at, n = part["c"].to_numpy(), part["n"].to_numpy()
        new = old.copy()
        if old.shape[1] and len(at):
            sums = np.stack([part[f"s{k}"].to_numpy() for k in range(old.shape[1])], 1)
            new[at[n > 0]] = sums[n > 0] / scale / n[n > 0, None]
        out.append(new)
    return out


def build(points: DataFrame, dims: int, cell: int = CELL, most: int = MOST_CENTROIDS, rounds: int = ROUNDS) -> tuple[Index, DataFrame] | None:
    """The index of points (key bigint, vec array<float> of dims finite numbers), and its entries: key, vec, cell, group.

    The codebooks are fitted to all points, the centroids beginning at points that a hash of their keys picks.  None without points.
    """
    spark = points.sparkSession
    n, largest = points.agg(F.count("*"), F.max(F.array_max(F.transform("vec", F.abs)))).first()
    if not n:
        return None
    centroids = int(min(most, n, max(1, np.ceil(np.sqrt(n / cell)))))
    scale = float(2.0 ** np.floor(np.log2(2.0**62 / (max(largest, 1e-30) * n)))) if largest else 1.0
    half, start = dims // 2, []
    for h in range(2):
        rows = points.orderBy(F.xxhash64("key", F.lit(h)), "key").limit(centroids).toArrow()
        v = matrix(rows["vec"].combine_chunks(), dims).astype(np.float64)
        start.append(v[:, :half] if h == 0 else v[:, half:])
    one, two = start
    for _ in range(rounds):
        one, two = _moved(points, one, two, dims, min(scale, 2.0**40))
    one, two = along(one), along(two)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = matrix(batch.column(1), dims)
            a, b = away(v[:, :half], one), away(v[:, half:], two)
            i, j = a.argmin(1), b.argmin(1)
            own = a[np.arange(len(v)), i] + b[np.arange(len(v)), j]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array((i * len(two) + j).astype(np.int32)), pa.array(own)], ["key", "vec", "cell", "own"])

    entries = store.written(points.select("key", "vec").mapInArrow(assign, "key bigint, vec array<float>, cell int, own double"), "multiindex")
    cells = entries.groupBy("cell").agg(F.count("*").alias("n"), F.sum("own").alias("own")).toArrow()  # most * most rows at most
    count = np.zeros(len(one) * len(two), np.int64)
    count[cells["cell"].to_numpy()] = cells["n"].to_numpy()
    group = ((np.cumsum(count) - count) // GROUP).astype(np.int32)
    _, group = np.unique(group, return_inverse=True)
    groups = int(group.max()) + 1
    index = Index(one, two, count, group.astype(np.int32), float(cells["own"].to_numpy().sum() / n), dims, groups, max(1, -(-TASKS // groups)))
    shared = spark.sparkContext.broadcast(index.group)  # most * most numbers at most

    @F.arrow_udf("int")
    def grouped(column: pa.Array) -> pa.Array:
        return pa.array(shared.value[column.to_numpy()])

    return index, entries.select("key", "vec", "cell", grouped("cell").alias("group"))


def _limit(index: Index, worst: np.ndarray, margin: float) -> np.ndarray:
    """The largest sum of distances of cells that may have vectors nearer than some squared distances; -1 for none."""
    lean = margin * np.sqrt(index.spread / index.dims)
    inside = lean * lean - index.spread + worst
    return np.where(inside >= 0, (lean + np.sqrt(np.maximum(inside, 0))) ** 2, -1.0)


def _probe(shared, start: int, margin: float):  # noqa: ANN001, ANN202
    """Queries (key, vec, and lim and worst of the first traversal, or nulls) by the groups that they are sent to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index: Index = shared.value
        half = index.dims // 2
        width, count, group = len(index.two), index.count.tolist(), index.group.tolist()
        for batch in batches:
            v = matrix(batch.column(1), index.dims)
            a, b = away(v[:, :half], index.one), away(v[:, half:], index.two)
            again = batch.column(2).null_count == 0
            worst = batch.column(3).to_numpy(zero_copy_only=False).astype(np.float64)
            lims = np.maximum(batch.column(2).to_numpy(), _limit(index, worst, margin)).tolist() if again else [0.0] * len(v)
            row, to = [], []
            for r in range(len(v)):
                seen, groups, last = 0, set(), 0.0
                for s, i, j in traverse(a[r], b[r]):
                    if again and s > lims[r] * (1 + 1e-9) or len(groups) == index.groups and again:
                        break
                    n = count[i * width + j]
                    if n:
                        groups.add(group[i * width + j])
                        seen, last = seen + n, s
                        if not again and seen >= start:
                            break
                if not again:
                    lims[r] = last
                row += [r] * len(groups)
                to += sorted(groups)
            at = pa.array(row, pa.int32())
            key = batch.column(0).take(at)
            split = (np.array(key.to_numpy(), np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)).astype(np.int64) % index.splits
            none = pa.nulls(len(row), pa.int32())
            fields = [pa.array(to, pa.int32()), pa.array(split, pa.int32()), pa.array(np.ones(len(row), np.int32)), key, batch.column(1).take(at), none, pa.array(lims, pa.float64()).take(at), pa.array(worst, pa.float64()).take(at)]
            yield pa.RecordBatch.from_arrays(fields, ["group", "split", "kind", "key", "vec", "cell", "lim", "worst"])

    return run


class Bucket:
    """The entries of a group, by cell, that queries are compared with."""

    def __init__(self, index: Index, table: pa.Table) -> None:
        cell = table["cell"].to_numpy()
        order = np.argsort(cell, kind="stable")
        self.index, self.key = index, table["key"].to_numpy()[order]
        self.vec = matrix(table["vec"].combine_chunks(), index.dims)[order]
        self.square = (self.vec * self.vec).sum(1)
        self.cells, self.at = np.unique(cell[order], return_index=True)
        self.end = np.r_[self.at[1:], len(order)]

    def nearest(self, v: np.ndarray, lim: np.ndarray, worst: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """The k nearest entries (numbers, -1 for none) of each query's cells, and their squared distances; only those under worst."""
        half, width = self.index.dims // 2, len(self.index.two)
        best = np.full((len(v), k), np.inf, np.float32)
        who = np.full((len(v), k), -1, np.int64)
        top = (worst * (1 + 1e-5) + 1e-6).astype(np.float32)
        square = (v * v).sum(1)
        lim = lim * (1 + 1e-9)
        rows_of = self.cells // width
        some_one, first = np.unique(rows_of, return_index=True)
        some_two, second = np.unique(self.cells % width, return_inverse=True)
        a = np.ascontiguousarray(away(v[:, :half], self.index.one[some_one]).T)
        b = np.ascontiguousarray(away(v[:, half:], self.index.two[some_two]).T)
        least = b.min(0)
        for x, (c_lo, c_hi) in enumerate(zip(first, np.r_[first[1:], len(self.cells)])):
            left = lim - a[x]
            near = np.flatnonzero(least <= left)
            if not len(near):
                continue
            left = left[near]
            for c in range(c_lo, c_hi):
                rows = near[b[second[c]][near] <= left]
                if not len(rows):
                    continue
                lo, hi = self.at[c], self.end[c]
                d = square[rows, None] - 2 * (v[rows] @ self.vec[lo:hi].T) + self.square[lo:hi]
                some = d.min(1) <= top[rows]
                if not some.any():
                    continue
                rows, d = rows[some], d[some]
                both = np.concatenate([best[rows], d], 1)
                names = np.concatenate([who[rows], np.broadcast_to(np.arange(lo, hi), d.shape)], 1)
                pick = np.argpartition(both, k - 1, axis=1)[:, :k]
                best[rows] = np.take_along_axis(both, pick, 1)
                who[rows] = np.take_along_axis(names, pick, 1)
                top[rows] = np.minimum(top[rows], best[rows].max(1))
        gap = v[:, None, :].astype(np.float64) - self.vec[who]
        exact = np.where(np.isfinite(best), np.einsum("qkd,qkd->qk", gap, gap), np.inf)
        return np.where(np.isfinite(best), who, -1), exact


def _compare(shared, k: int):  # noqa: ANN001, ANN202
    """For streams of a group's entries and then its queries: key, lim, and the nearest entries (d, key) of each query."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index: Index = shared.value
        rows_at_once = max(1024, (1 << 21) // len(index.one))
        place, held, bucket = None, [], None
        waiting: list[pa.RecordBatch] = []

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal bucket
            if not waiting:
                return
            if bucket is None:
                bucket = Bucket(index, pa.Table.from_batches(held))
            part = pa.Table.from_batches(waiting).combine_chunks()
            waiting.clear()
            worst = part["worst"].to_numpy().astype(np.float64)
            who, d = bucket.nearest(matrix(part["vec"].combine_chunks(), index.dims), part["lim"].to_numpy(), np.where(np.isnan(worst), np.inf, worst), k)
            live = who >= 0
            ends = np.r_[0, np.cumsum(live.sum(1))].astype(np.int32)
            pairs = pa.StructArray.from_arrays([pa.array(d[live]), pa.array(bucket.key[who[live]])], ["d", "key"])
            lists = pa.ListArray.from_arrays(pa.array(ends), pairs)
            fields = [part["key"].combine_chunks(), part["lim"].combine_chunks(), lists]
            yield pa.RecordBatch.from_arrays(fields, ["key", "lim", "near"])

        for batch in batches:
            where = batch.column(0).to_numpy().astype(np.int64) << 32 | batch.column(1).to_numpy()
            kind = batch.column(2).to_numpy()
            cuts = np.flatnonzero(np.r_[True, (where[1:] != where[:-1]) | (kind[1:] != kind[:-1])])
            for lo, hi in zip(cuts, np.r_[cuts[1:], len(where)]):
                part = batch.slice(lo, hi - lo)
                if place != where[lo]:
                    yield from flush()
                    place, held, bucket = where[lo], [], None
                if kind[lo] == 0:
                    held.append(part)
                else:
                    waiting.append(part)
                    if sum(map(len, waiting)) >= rows_at_once:
                        yield from flush()
        yield from flush()

    return run


def _pass(entries: DataFrame, queries: DataFrame, index: Index, shared, k: int, start: int, margin: float) -> DataFrame:  # noqa: ANN001
    """key, lim and near (the nearest entries, at most k, by distance and key) of each query (key, vec, lim, worst)."""
    splits = F.explode(F.sequence(F.lit(0), F.lit(index.splits - 1)))
    none = [F.lit(None).cast("double").alias(x) for x in ("lim", "worst")]
    held = entries.select("group", splits.alias("split"), F.lit(0).alias("kind"), "key", "vec", "cell", *none)
    asked = queries.select("key", "vec", "lim", "worst").mapInArrow(_probe(shared, start, margin), _ROW)
    both = held.unionByName(asked).repartition("group", "split").sortWithinPartitions("group", "split", "kind")
    found = both.mapInArrow(_compare(shared, k), "key bigint, lim double, near array<struct<d: double, key: bigint>>")
    near = F.slice(F.array_sort(F.flatten(F.collect_list("near"))), 1, k)
    return found.groupBy("key").agg(F.max("lim").alias("lim"), near.alias("near"))


def search(index: Index, entries: DataFrame, k: int, start: int = START, margin: float = MARGIN) -> DataFrame:
    """key and near (array of structs d, a squared distance, and key, in this order): the k nearest entries of each, itself included.

    Pairs of centroids are traversed by their summed distance to the query till `start` candidates are seen; the distance of the k-th
    of them tells how far the traversal must go on (MARGIN), whose candidates are reranked by their exact distances.
    """
    shared = entries.sparkSession.sparkContext.broadcast(index)  # MOST_CENTROIDS ** 2 cells at most
    none = [F.lit(None).cast("double").alias(x) for x in ("lim", "worst")]
    first = _pass(entries, entries.select("key", "vec", *none), index, shared, k, max(start, 4 * k), margin)
    worst = F.when(F.size("near") == k, F.get("near", F.lit(k - 1))["d"]).otherwise(F.lit(float("inf")))
    known = store.written(first.select("key", "lim", worst.alias("worst")), "multiindex-first")
    again = entries.select("key", "vec").join(known, "key")
    return _pass(entries, again, index, shared, k, start, margin)


def numbered(rows: DataFrame) -> DataFrame:
    """The rows with a number of their own (row), as a written table, so that the numbers stay."""
    return store.written(rows.withColumn("row", F.monotonically_increasing_id()), "multiindex-rows")


def distinct_vectors(rows: DataFrame) -> DataFrame:
    """row, id, vec, rep (the row that stands for all rows with the same vector: the first by id and row) and copies (how many there are).

    Equal vectors are told by two 64-bit hashes.  Groups are aggregated before they are joined to their rows, so none is in one task.
    """
    keyed = rows.withColumn("_one", F.xxhash64("vec")).withColumn("_two", F.xxhash64(F.lit(1), "vec"))
    groups = keyed.groupBy("_one", "_two").agg(F.min(F.struct(F.col("id").isNull().alias("x"), "id", "row"))["row"].alias("rep"), F.count("*").alias("copies"))
    return store.written(keyed.join(groups, ["_one", "_two"]).drop("_one", "_two"), "multiindex-distinct")


def first_members(marked: DataFrame, most: int) -> DataFrame:
    """rep and members (structs of id and row): the first rows of each vector by id and row, `most` at most; large groups are cut in parts first."""
    order = [F.asc_nulls_last("id"), F.asc("row")]
    part = F.pmod(F.xxhash64("row"), F.lit(64)).alias("part")
    few = marked.select("rep", "id", "row", part).withColumn("n", F.row_number().over(W.partitionBy("rep", "part").orderBy(*order))).where(F.col("n") <= most)
    few = few.withColumn("n", F.row_number().over(W.partitionBy("rep").orderBy(*order))).where(F.col("n") <= most)
    return few.groupBy("rep").agg(F.collect_list(F.struct("id", "row")).alias("members"))


def usable(vectors: DataFrame) -> tuple[DataFrame, int]:
    """Those of some rows (id, vec) whose vector has no null, NaN or infinite number and is of the commonest length; that length.

    Of equally common lengths the least counts; 0 if no vector is usable.
    """
    good = vectors.where(F.col("vec").isNotNull() & (F.size("vec") > 0) & F.forall("vec", lambda x: F.coalesce(F.abs(x) < float("inf"), F.lit(False)) & ~F.isnan(x)))
    top = good.groupBy(F.size("vec").alias("n")).count().orderBy(F.desc("count"), "n").first()
    dims = top.n if top else 0
    return good.where(F.size("vec") == dims), dims


def neighbours(vectors: DataFrame, k: int = NEIGHBOURS, id_col: str = "vec_id", vec_col: str = "embedding", start: int = START, margin: float = MARGIN) -> DataFrame:
    """vec_id, rank (from 1), neighbour and distance: the k nearest vectors of every vector, by Euclidean distance, then by id.

    Approximate in what it finds, exact in the distances that it gives.  All rows are queries and entries.  Equal vectors are searched
    once, and then each of their rows has the others as neighbours at distance 0; a row isn't its own neighbour, but one that repeats its
    id is.  A row has fewer than k neighbours only if there aren't more.  Rows without a usable vector (see usable()) have no neighbours
    and are none.  A null id stays null.  Other columns are left out.
    """
    rows, dims = usable(vectors.select(F.col(id_col).cast("bigint").alias("id"), F.col(vec_col).cast("array<float>").alias("vec")))
    spark = vectors.sparkSession
    if not dims:
        return spark.createDataFrame([], "vec_id bigint, rank int, neighbour bigint, distance double")
    marked = distinct_vectors(numbered(rows))
    index, entries = build(marked.where("row = rep").select(F.col("rep").alias("key"), "vec"), dims)
    near = search(index, entries, k + 1, start, margin)
    least = first_members(marked, k + 1)
    pairs = near.select(F.col("key").alias("of"), F.explode("near").alias("n")).select("of", F.col("n.d").alias("d"), F.col("n.key").alias("rep"))
    each = pairs.join(least, "rep").select("of", F.explode(F.transform("members", lambda m: F.struct(F.col("d").alias("d"), m["id"].alias("id"), m["row"].alias("row")))).alias("c"))
    lists = each.groupBy("of").agg(F.slice(F.array_sort(F.collect_list("c")), 1, k + 1).alias("c"))
    own = marked.select(F.col("rep").alias("of"), "id", "row").join(lists, "of")
    others = F.slice(F.filter("c", lambda c: c["row"] != F.col("row")), 1, k)
    found = own.select(F.col("id").alias("vec_id"), F.posexplode(others).alias("rank", "c"))
    return found.select("vec_id", (F.col("rank") + 1).alias("rank"), F.col("c.id").alias("neighbour"), F.sqrt("c.d").alias("distance"))
