"""Packing: related documents, found in a nearest-neighbour graph, lie side by side in windows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from mailloom.llm import kernels as K
from mailloom.llm import multiindex, store

#: Production parameters: characters of a window, neighbours of a document in the graph, length of a document's vector.
WINDOW, NEIGHBOURS, DIMS = 8192, 5, 32
#: Links that one task settles; more are settled in distributed rounds first, with the same result.
SETTLED = 1 << 21
#: Rows of a block, about; larger ones are divided, by paths, and by rows where one vector has more copies than this.
BLOCK = 1 << 18

_ONE = 1 << 14


def raw_vectors(data: np.ndarray, off: np.ndarray, dims: int) -> np.ndarray:
    """The sum of random signs over the distinct words of each row, scaled to a length of about _ONE, in whole numbers; zeros without words."""
    h, row = K.distinct(*K.words(data, off))
    out = np.zeros((len(off) - 1, dims))
    if len(h):
        signs = np.unpackbits(K.mix64(h, 40).view(np.uint8).reshape(-1, 8), axis=1)[:, :dims]
        start = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
        out[row[start]] = 2.0 * np.add.reduceat(signs, start, axis=0, dtype=np.int32) - np.diff(np.r_[start, len(h)])[:, None]
    length = np.sqrt((out * out).sum(1))[:, None]
    return np.rint(_ONE * out / np.where(length == 0, 1, length)).astype(np.int32)


def vectors(docs: DataFrame, dims: int = DIMS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """row, id, n_chars and vec of each document, a written table.

    vec sums random signs over the distinct lower-cased words, less the mean over all documents, at length 1.  It is null for a text
    without words, and for all documents if they don't differ.
    """
    if dims > 64:
        raise ValueError("a vector has 64 numbers at most")

    @F.arrow_udf("array<int>")
    def raw(column: pa.Array) -> pa.Array:
        data, off = K.utf8(column)
        parts = [np.zeros((0, dims), np.int32)]
        parts += [raw_vectors(data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo], dims) for lo, hi in K.chunks(off)]
        v = np.concatenate(parts)
        return pa.ListArray.from_arrays(pa.array(np.arange(len(v) + 1, dtype=np.int32) * dims), pa.array(v.ravel()), mask=pa.array(~v.any(1)))

    size = F.coalesce(F.length(text_col), F.lit(0)).cast("bigint")
    rows = multiindex.numbered(docs.select(F.col(id_col).alias("id"), size.alias("n_chars"), raw(F.lower(F.col(text_col))).alias("raw")))
    sums = rows.where("raw is not null").agg(F.count("*"), *(F.sum(F.get("raw", F.lit(k))) for k in range(dims))).first()
    mean = [0.0 if not sums[0] else s / sums[0] for s in sums[1:]]
    moved = F.zip_with("raw", F.array(*map(F.lit, mean)), lambda a, b: a - b)
    length = F.sqrt(F.aggregate("moved", F.lit(0.0), lambda acc, x: acc + x * x))
    unit = F.when(F.col("length") > 1e-6 * _ONE, F.transform("moved", lambda x: (x / F.col("length")).cast("float")))
    return rows.withColumn("moved", moved).withColumn("length", length).select("row", "id", "n_chars", unit.alias("vec"))


def links(near: DataFrame) -> DataFrame:
    """d, u, v (u the lesser) of a graph (key, near: structs of a squared distance d and a key): each link once, with its least distance."""
    each = near.select("key", F.explode("near").alias("n")).select("key", F.col("n.key").alias("to"), F.col("n.d").alias("d")).where("key <> to")
    return each.groupBy(F.least("key", "to").alias("u"), F.greatest("key", "to").alias("v")).agg(F.min("d").alias("d")).select("d", "u", "v")


def ranked(graph: DataFrame) -> DataFrame:
    """g, d, u and v of links (d, u, v): g is the lesser of the degrees of a link's ends, which is what links are taken by first."""
    degree = graph.select(F.explode(F.array("u", "v")).alias("key")).groupBy("key").agg(F.count("*").alias("n"))
    both = graph.join(degree.toDF("u", "nu"), "u").join(degree.toDF("v", "nv"), "v")
    return both.select(F.least("nu", "nv").alias("g"), "d", "u", "v")


def settle(g: np.ndarray, d: np.ndarray, u: np.ndarray, v: np.ndarray, pu: np.ndarray, pv: np.ndarray, fu: np.ndarray, fv: np.ndarray) -> tuple[list[int], dict[int, int]]:
    """The links (their places) that join paths, taken by g, then d, u and v, and the path that each joined path becomes part of.

    A link counts if each of its ends is an end of a path, and those are two paths.  pu and pv are the ends' paths, fu and fv how many
    more links the ends may have.
    """
    order = np.lexsort((v, u, d, g))
    free: dict[int, int] = dict(zip(u.tolist(), fu.tolist())) | dict(zip(v.tolist(), fv.tolist()))
    root: dict[int, int] = {}

    def find(x: int) -> int:
        top = x
        while (up := root.get(top, top)) != top:
            top = up
        while (up := root.get(x, x)) != top and up != x:
            root[x] = top
            x = up
        return top

    taken = []
    for at, x, y, p, q in zip(order.tolist(), *(c[order].tolist() for c in (u, v, pu, pv))):
        if free[x] and free[y] and (p := find(p)) != (q := find(q)):
            root[max(p, q)] = min(p, q)
            free[x] -= 1
            free[y] -= 1
            taken.append(at)
    return taken, {x: find(x) for x in root}


def join_paths(graph: DataFrame, settled: int = SETTLED) -> tuple[DataFrame, list[DataFrame]]:
    """u and v of the links that make the paths of a graph (d, u, v), and tables of path and root, to be applied in turn.

    Low degrees come first: of the links that join ends of two paths, the one is taken that has an end of the least degree, then the
    shortest (then that of the least u, then v), again and again; so nodes with few links get a place beside a neighbour before their
    neighbours have none left.  All links of the graph count, wherever their ends are.  A path is named by its least node.  While there are
    more than `settled` links, a round takes those that are the first of both of their paths, which that order would take as well; one
    task then settles the rest.
    """
    live = store.written(ranked(graph).select("g", "d", "u", "v", F.col("u").alias("pu"), F.col("v").alias("pv"), F.lit(2).alias("fu"), F.lit(2).alias("fv")), "packing-links")
    found, moves = [], []
    while live.count() > settled:
        link = F.struct("g", "d", "u", "v", "pu", "pv").alias("link")
        best = live.select(F.explode(F.array("pu", "pv")).alias("path"), link).groupBy("path").agg(F.min("link").alias("link"))
        both = best.groupBy("link").agg(F.count("*").alias("n")).where("n = 2").select("link.*")
        both = store.written(both, "packing-taken")
        found.append(both.select("u", "v"))
        root = F.least("pu", "pv").alias("root")
        move = store.written(both.select(F.explode(F.array(F.struct(F.col("pu").alias("path"), root, F.col("u").alias("end")), F.struct(F.col("pv").alias("path"), root, F.col("v").alias("end")))).alias("m")).select("m.*"), "packing-moves")
        moves.append(move.where("path <> root").select("path", "root"))
        for p, f, x in (("pu", "fu", "u"), ("pv", "fv", "v")):
            joined = live.join(move, live[p] == move["path"], "left")
            others = [c for c in live.columns if c not in (p, f)]
            live = joined.select(*others, F.coalesce("root", p).alias(p), (F.col(f) - F.when(F.col("end") == F.col(x), 1).otherwise(0)).alias(f))
        live = store.written(live.where("fu > 0 and fv > 0 and pu <> pv"), "packing-links")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if held:
            table = pa.Table.from_batches(held)
            taken, root = settle(*(table[c].to_numpy() for c in ("g", "d", "u", "v", "pu", "pv", "fu", "fv")))
            u, v = table["u"].to_numpy(), table["v"].to_numpy()
            for kind, x, y in ((0, u[taken], v[taken]), (1, list(root), list(root.values()))):
                yield pa.RecordBatch.from_arrays([pa.array([kind] * len(x), pa.int32()), pa.array(x, pa.int64()), pa.array(y, pa.int64())], ["kind", "a", "b"])

    # At most `settled` links, in one task.
    rest = store.written(live.select("g", "d", "u", "v", "pu", "pv", "fu", "fv").coalesce(1).mapInArrow(run, "kind int, a bigint, b bigint"), "packing-settled")
    taken = rest.where("kind = 0").select(F.col("a").alias("u"), F.col("b").alias("v"))
    for one in found:
        taken = taken.unionByName(one)
    return taken, [*moves, rest.where("kind = 1").select(F.col("a").alias("path"), F.col("b").alias("root"))]


def far_steps(ways: DataFrame) -> DataFrame:
    """key, end and step: for each node of some paths (key, to: both directions of each link) and each end that isn't the node, the number of links to it.

    Each direction of a link knows the one that follows it and how many links that is on; a round doubles how far it sees.
    """
    one, two = ways.toDF("a", "b"), ways.toDF("x", "c")
    state = one.join(two, (F.col("b") == F.col("x")) & (F.col("a") != F.col("c")), "left").select("a", "b", F.col("x").alias("na"), F.col("c").alias("nb"), F.lit(1).cast("bigint").alias("n"), "b")
    state = store.written(state.toDF("a", "b", "na", "nb", "n", "end"), "packing-steps")
    while not state.where("na is not null").isEmpty():
        later = state.toDF("na", "nb", "la", "lb", "ln", "lend")
        state = state.join(later, ["na", "nb"], "left").select("a", "b", F.col("la").alias("na"), F.col("lb").alias("nb"), (F.col("n") + F.coalesce("ln", F.lit(0))).alias("n"), F.coalesce("lend", "end").alias("end"))
        state = store.written(state, "packing-steps")
    return state.select(F.col("a").alias("key"), "end", F.col("n").alias("step"))


def paths(graph: DataFrame, nodes: DataFrame, settled: int = SETTLED, long: int = BLOCK) -> DataFrame:
    """block, key, cell, path and step of all nodes (key, cell, group); graph has the links (d, u, v).

    A path lies in the block and at the cell of its least node, whose key names it.  Its steps are counted from the lesser of its two ends:
    in a task for all of a part of a block, but for paths of more than `long` nodes, whose steps are counted in rounds (far_steps()).
    """
    taken, moves = join_paths(graph, settled)
    named = nodes.select("key", F.col("key").alias("path"))
    for move in moves:
        named = named.join(move, "path", "left").select("key", F.coalesce("root", "path").alias("path"))
    named = store.written(named, "packing-named")
    sizes = named.groupBy("path").agg(F.count("*").alias("nodes"))
    both = taken.select(F.explode(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))).alias("w")).select(F.col("w.u").alias("key"), F.col("w.v").alias("to"))
    both = store.written(both, "packing-ways")
    first = nodes.select(F.col("key").alias("path"), "cell", F.col("group").alias("block"))
    placed = named.join(first.join(sizes, "path"), "path")
    ways = both.groupBy("key").agg(F.collect_list("to").alias("to"))
    parts = placed.groupBy("block").agg(F.ceil(F.count("*") / BLOCK).alias("parts"))
    whole = placed.where(F.col("nodes") <= long).join(ways, "key", "left").join(parts, "block")
    whole = whole.select("block", F.pmod(F.xxhash64("path"), "parts").alias("part"), "cell", "path", "key", F.coalesce("to", F.array().cast("array<bigint>")).alias("to"))

    def run(block: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches))
        keys = table["key"].to_pylist()
        to = dict(zip(keys, table["to"].to_pylist()))
        step: dict[int, int] = {}
        for start in sorted(k for k in keys if len(to[k]) < 2):
            at, n = start, 0
            while at is not None and at not in step:
                step[at], n = n, n + 1
                at = next((x for x in to[at] if x not in step), None)
        steps = pa.array([step[k] for k in keys], pa.int64())
        yield pa.RecordBatch.from_arrays([*(table[c].combine_chunks() for c in ("block", "key", "cell", "path")), steps], ["block", "key", "cell", "path", "step"])

    found = whole.groupBy("block", "part").applyInArrow(run, "block int, key bigint, cell int, path bigint, step bigint")
    far = sizes.where(F.col("nodes") > long)
    if far.isEmpty():
        return found
    apart = store.written(placed.where(F.col("nodes") > long), "packing-far")
    steps = far_steps(both.join(apart.select("key"), "key", "left_semi"))
    start = steps.join(apart.select("key", "path"), "key").groupBy("path").agg(F.min("end").alias("end"))
    counted = apart.join(start, "path").join(steps, ["key", "end"], "left").select("block", "key", "cell", "path", F.coalesce("step", F.lit(0)).alias("step"))
    return found.unionByName(counted)


def pack(docs: DataFrame, window: int = WINDOW, k: int = NEIGHBOURS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The pieces of windows: block, part, window, position, doc_id, begin, end, path.

    Each document's k nearest neighbours are searched among all documents (see vectors() and the inverted multi-index).  Greedy paths
    cover the whole graph, whichever blocks its links cross (see join_paths()); documents with equal vectors stand together, by id.  The
    paths that begin in neighbouring cells, 32,768 distinct vectors or so, make a block; a block of more than BLOCK rows has several parts,
    among which its paths (and the copies of a text that has more than BLOCK of them) are dealt by a hash.  The paths of a part follow each
    other by cell and are cut into windows of `window` characters, so that only the last one of a part is shorter.  A piece is characters begin to end (exclusive, from 0) of a document
    and lies at `position` in its window.  Every row of documents is packed, whole, once: a repeated row or id is packed again, a null
    id stays null, a text that is null or empty has one piece without characters, and texts without words come last, in block -1, by id.
    Other columns are left out.
    """
    rows = store.written(vectors(docs, id_col=id_col, text_col=text_col), "packing-vectors")
    marked = multiindex.distinct_vectors(rows.where("vec is not null"))
    built = multiindex.build(marked.where("row = rep").select(F.col("rep").alias("key"), "vec"), DIMS)
    none = F.lit(0).cast("bigint")
    bare = rows.where("vec is null").select(F.lit(-1).alias("block"), F.lit(0).alias("cell"), "id", "n_chars", "row", none.alias("path"), none.alias("step"), F.xxhash64("row").alias("part"))
    placed = bare
    if built:
        index, entries = built
        near = multiindex.search(index, entries, k + 1)
        walked = paths(links(near), entries.select("key", "cell", "group")).withColumnRenamed("key", "rep")
        part = F.when(F.col("copies") > BLOCK, F.xxhash64("row")).otherwise(F.xxhash64("path"))
        placed = marked.join(walked, "rep").select("block", "cell", "id", "n_chars", "row", "path", "step", part.alias("part")).unionByName(bare)
    placed = store.written(placed, "packing-placed")
    parts = placed.groupBy("block").agg(F.ceil(F.count("*") / BLOCK).alias("parts"))
    placed = placed.join(parts, "block").withColumn("part", F.pmod("part", "parts").cast("int"))
    order = W.partitionBy("block", "part").orderBy("cell", "path", "step", F.asc_nulls_last("id"), "row").rowsBetween(W.unboundedPreceding, W.currentRow)
    laid = placed.withColumn("stop", F.sum("n_chars").over(order)).withColumn("start", F.col("stop") - F.col("n_chars"))
    last = F.when(F.col("n_chars") > 0, F.col("stop") - 1).otherwise(F.col("start"))
    size = F.lit(window)
    cut = laid.withColumn("window", F.explode(F.sequence(F.floor(F.col("start") / size), F.floor(last / size))))
    lo, hi = F.greatest("start", F.col("window") * size), F.least("stop", (F.col("window") + 1) * size)
    return cut.select("block", "part", "window", (lo - F.col("window") * size).alias("position"), F.col("id").alias("doc_id"), (lo - F.col("start")).alias("begin"), (hi - F.col("start")).alias("end"), "path")
