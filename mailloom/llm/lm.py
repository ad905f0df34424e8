"""Language-model scoring: a causal self-attention model on subword ids, trained in numpy on all documents, scores overlapping windows.

Beside the model, whose size is fixed, stands a memory of all blocks of ids that occur more than once, which grows with the corpus.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mailloom.llm import kernels as K
from mailloom.llm import store
from mailloom.llm.tokenfile import VOCABULARY, encoding, ranks

#: Production parameters: ids that a window scores, and those of context before them (as many); width of the model and of its hidden layer;
#: classes of ids, of which the first SINGLES hold one id each.
STEP, CONTEXT, WIDTH, HIDDEN, CLASSES, SINGLES = 16, 16, 16, 32, 128, 96
#: Windows in a step of training, ids (about) that one copy of the model trains on, and rounds, over which each window of all distinct
#: texts trains the model once.  (What an id's class and its share of it rest on is counted over all ids of all documents.)
BATCH, SHARD, ROUNDS = 128, 1 << 21, 2
#: Share of a block's probability that is its share of the other blocks of the corpus.
MEMORY = 0.05
#: Parameters are averaged as multiples of this, in whole numbers, so that no order of the sums alters them.
_UNIT = 2.0**-24
#: Pieces whose ids a worker remembers; beyond that it begins anew.
REMEMBERED = 400_000

_SPAN = STEP + CONTEXT
_DENSE = ("place", "wqkv", "wo", "w1", "b1", "wc", "bc")


class Subwords:
    """Byte-level BPE ids of texts: the pieces of a text are runs of blanks, of word bytes and of others, the latter two with one blank before them."""

    def __init__(self, vocabulary: str = VOCABULARY, given: dict[bytes, int] | None = None) -> None:
        self.one = encoding(vocabulary, given)._encode_single_piece
        self.kind = np.where(K.word_bytes(), 1, 2).astype(np.int8)
        self.kind[[9, 10, 11, 12, 13, 32]] = 0
        self._forget()

    def _forget(self) -> None:
        self.known: dict[int, int] = {}
        self.flat, self.used, self.start, self.size = np.zeros(1 << 16, np.int32), 0, np.zeros(1 << 12, np.int64), np.zeros(1 << 12, np.int64)

    def _learn(self, key: int, piece: bytes) -> int:
        ids = self.one(piece)
        at, k = self.used, len(self.known)
        while at + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        if k == len(self.start):
            self.start, self.size = np.concatenate([self.start, self.start]), np.concatenate([self.size, self.size])
        self.flat[at : at + len(ids)] = ids
        self.used, self.start[k], self.size[k] = at + len(ids), at, len(ids)
        self.known[key] = k
        return k

    def __call__(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all rows and their offsets."""
        n, rows = len(data), len(off) - 1
        if n == 0:
            return np.zeros(0, np.int32), np.zeros(rows + 1, np.int64)
        if len(self.known) > REMEMBERED:
            self._forget()
        kind = self.kind[data]
        first = np.zeros(n + 1, bool)
        first[off] = True
        head = first[:n].copy()
        head[1:] |= kind[1:] != kind[:-1]
        joins = np.flatnonzero(head[1:] & ~first[1:n] & (kind[1:] != 0) & (data[:-1] == 32)) + 1
        head[joins] = False
        head[joins - 1] = True
        start = np.flatnonzero(head)
        end = np.r_[start[1:], n]
        up, down = K._powers(n)
        total = np.r_[np.uint64(0), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up, dtype=np.uint64)]
        h = K.mix64((total[end] - total[start]) * down[start], 9)
        keys, at, back = np.unique(h, return_index=True, return_inverse=True)
        slot = [self.known.get(k, -1) for k in keys.tolist()]
        for x in [x for x, s in enumerate(slot) if s < 0]:
            slot[x] = self._learn(int(keys[x]), data[start[at[x]] : end[at[x]]].tobytes())
        slot = np.array(slot, np.int64)[back]
        size = self.size[slot]
        stop = np.cumsum(size)
        ids = self.flat[np.repeat(self.start[slot] - (stop - size), size) + np.arange(stop[-1])]
        ends = np.r_[0, stop]
        return ids, ends[np.searchsorted(start, off)]


@dataclass
class Model:
    """Parameters by name; the class of each id and the logarithm of its share of its class."""

    p: dict[str, np.ndarray]
    kind: np.ndarray
    within: np.ndarray


def classes(counts: np.ndarray, most: int = CLASSES, single: int = SINGLES) -> tuple[np.ndarray, np.ndarray]:
    """Class and log share of each id: the most frequent ids are classes of their own, the rest (by frequency) fill classes of like weight."""
    order = np.lexsort((np.arange(len(counts)), -counts))
    weight = counts + 0.5
    kind = np.zeros(len(counts), np.int64)
    singles = min(single, len(counts))
    kind[order[:singles]] = np.arange(singles)
    rest = order[singles:]
    if len(rest):
        mass = np.cumsum(weight[rest]) - weight[rest]
        kind[rest] = singles + np.minimum((mass / (mass[-1] + 1) * (most - singles)).astype(np.int64), most - singles - 1)
    return kind, np.log(weight / np.bincount(kind, weight, most)[kind])


def fresh(counts: np.ndarray, most: int = CLASSES, single: int = SINGLES) -> Model:
    """An untrained model for ids that occur so often; it gives each class its share of the corpus."""
    kind, within = classes(counts, most, single)
    rng = np.random.default_rng(0)

    def draw(*shape: int, scale: float) -> np.ndarray:
        return (rng.standard_normal(shape) * scale).astype(np.float32)

    w = WIDTH**-0.5
    share = np.log(np.bincount(kind, counts + 0.5, most).clip(0.5))
    p = {"ids": draw(len(counts) + 1, WIDTH, scale=0.3), "place": np.zeros((STEP, _SPAN), np.float32)}
    p |= {"wqkv": draw(WIDTH, 3 * WIDTH, scale=w), "wo": draw(WIDTH, WIDTH, scale=w), "w1": draw(WIDTH, HIDDEN, scale=w), "b1": np.zeros(HIDDEN, np.float32), "wc": draw(HIDDEN, most, scale=0.1), "bc": (share - share.max()).astype(np.float32)}
    return Model(p, kind, within)


def blocks(ids: np.ndarray, off: np.ndarray, start_id: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Inputs and targets (-1 for none) in blocks of STEP, the row of each block and whether it is its row's first.

    A row's inputs are start_id and its ids but the last one; each of its ids is the target of one place.  Before a row's first block
    lies one of padding, without targets, so that a block and the one before it are the block's window; first marks the blocks that
    mustn't look into the one before: padding, and the one after it.
    """
    n = np.diff(off)
    m = -(-n // STEP)
    base = np.r_[0, np.cumsum(1 + m)]
    put = np.repeat((base[:-1] + 1) * STEP - off[:-1], n) + np.arange(len(ids))
    flat = np.full(base[-1] * STEP + 1, start_id, np.int64)
    goal = np.full(base[-1] * STEP, -1, np.int64)
    goal[put] = ids
    last = np.zeros(len(ids), bool)
    last[off[1:][n > 0] - 1] = True
    flat[put[~last] + 1] = ids[~last]
    first = np.zeros(base[-1] + 1, bool)
    first[base[:-1]] = first[base[:-1] + 1] = True
    return flat[:-1].reshape(-1, STEP), goal.reshape(-1, STEP), np.repeat(np.arange(len(n)), 1 + m), first[:-1]


_CAUSAL = np.where(np.arange(_SPAN)[None, :] <= np.arange(STEP)[:, None] + CONTEXT, 0.0, -1e9).astype(np.float32)


def forward(p: dict[str, np.ndarray], inputs: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, ...]:
    """Logits of classes by place, and what backward() needs; each block attends to itself (causally) and to the one before it.

    The first block given has none before it.
    """
    x = p["ids"].take(inputs.ravel(), 0)
    qkv = (x @ p["wqkv"]).reshape(len(inputs), STEP, 3 * WIDTH)
    kv = np.empty((len(inputs), _SPAN, 2 * WIDTH), np.float32)
    kv[:1, :CONTEXT] = 0
    kv[1:, :CONTEXT] = qkv[:-1, :, WIDTH:]
    kv[:, CONTEXT:] = qkv[:, :, WIDTH:]
    q, k, v = qkv[:, :, :WIDTH], kv[:, :, :WIDTH], kv[:, :, WIDTH:]
    a = q @ k.transpose(0, 2, 1)
    a += p["place"] + _CAUSAL
    a[first, :, :CONTEXT] = -1e9
    a[0, :, :CONTEXT] = -1e9
    _clip(a)
    np.exp(a, out=a)
    total = (a.reshape(-1, _SPAN) @ np.ones(_SPAN, a.dtype)).reshape(-1, STEP, 1)
    o = ((a @ v) / total).reshape(-1, WIDTH)
    y = o @ p["wo"]
    y += x
    u = y @ p["w1"]
    u += p["b1"]
    np.maximum(u, 0, out=u)
    z = u @ p["wc"]
    z += p["bc"]
    _clip(z)
    return z, x, q, k, v, a, total, o, y, u


def _clip(x: np.ndarray) -> None:
    """Bound logits by 60, so that no sum of exponentials overflows."""
    if x.max(initial=0) > 60:
        np.minimum(x, 60, out=x)


def backward(p: dict[str, np.ndarray], goal: np.ndarray, kept: tuple[np.ndarray, ...], weight: np.ndarray | None = None) -> dict[str, np.ndarray]:
    """Gradients of the mean loss (weighted, if weights by place are given) over the targets (classes by place, -1 for none); that of ids is by place.

    It works in the arrays that it is given.
    """
    z, x, q, k, v, a, total, o, y, u = kept
    n = len(a)
    live = np.flatnonzero(goal >= 0)
    share = (goal >= 0).astype(np.float64) if weight is None else weight * (goal >= 0)
    share = (share / max(1e-9, share.sum())).astype(np.float32)
    # The gradient of the logits is e times scale, which goes into narrower arrays instead.
    e = np.exp(z, out=z)
    sums = e @ np.ones(e.shape[1], e.dtype)
    e[live, goal[live]] -= sums[live]
    scale = share / sums
    g = {"wc": (u * scale[:, None]).T @ e, "bc": scale @ e}
    du = e @ p["wc"].T
    du *= scale[:, None] * (u > 0)
    g |= {"w1": y.T @ du, "b1": np.ones(len(du), du.dtype) @ du}
    dy = du @ p["w1"].T
    g["wo"] = o.T @ dy
    do = (dy @ p["wo"].T).reshape(n, STEP, WIDTH)
    a /= total
    ds = do @ v.transpose(0, 2, 1)
    ds -= np.einsum("bij,bij->bi", do, o.reshape(do.shape))[:, :, None]
    ds *= a
    g["place"] = ds.sum(0)
    dqkv = np.empty((n, STEP, 3 * WIDTH), ds.dtype)
    dqkv[:, :, :WIDTH] = ds @ k
    for at, d in ((WIDTH, ds.transpose(0, 2, 1) @ q), (2 * WIDTH, a.transpose(0, 2, 1) @ do)):
        dqkv[:, :, at : at + WIDTH] = d[:, CONTEXT:]
        dqkv[:-1, :, at : at + WIDTH] += d[1:, :CONTEXT]
    flat = dqkv.reshape(-1, 3 * WIDTH)
    dy += flat @ p["wqkv"].T
    return g | {"wqkv": x.T @ flat, "ids": dy}


class Trainer:
    """Adam for the dense parameters, and steps scaled by each id's past gradients for the ids."""

    def __init__(self, model: Model, rate: float) -> None:
        self.p, self.kind, self.rate, self.steps = {k: v.copy() for k, v in model.p.items()}, model.kind, rate, 0
        self.m = {k: np.zeros_like(self.p[k]) for k in _DENSE}
        self.v = {k: np.zeros_like(self.p[k]) for k in _DENSE}
        self.past = np.zeros(len(self.p["ids"]), np.float32)
        self.seen = np.zeros(len(self.p["ids"]), np.int64)
        self.targets = 0

    def step(self, inputs: np.ndarray, goal: np.ndarray, first: np.ndarray, copies: np.ndarray | None = None) -> None:
        """One step on some blocks, of which there are so many copies (1 each if not given)."""
        goal = goal.ravel()
        want = np.where(goal >= 0, self.kind[goal], -1)
        g = backward(self.p, want, forward(self.p, inputs, first), None if copies is None else np.repeat(copies, STEP))
        self.steps += 1
        self.targets += int((goal >= 0).sum())
        for k in _DENSE:
            self.m[k] = 0.9 * self.m[k] + 0.1 * g[k]
            self.v[k] = 0.99 * self.v[k] + 0.01 * g[k] * g[k]
            self.p[k] -= self.rate * (self.m[k] / (1 - 0.9**self.steps)) / (np.sqrt(self.v[k] / (1 - 0.99**self.steps)) + 1e-8)
        flat = inputs.ravel()
        order = np.argsort(flat.astype(np.uint16), kind="stable")  # a radix sort
        at = flat[order]
        start = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
        sums = np.add.reduceat(g["ids"][order], start, axis=0)
        which = at[start]
        self.past[which] += (sums * sums).mean(1)
        self.p["ids"][which] -= 3 * self.rate * sums / (np.sqrt(self.past[which])[:, None] + 1e-8)
        self.seen[which] += np.diff(np.r_[start, len(at)])


def token_table(docs: DataFrame, vocabulary: str = VOCABULARY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """row (a number of its own), doc_id and ids (little-endian uint16; null for a null text), a written table."""
    shared = docs.sparkSession.sparkContext.broadcast(ranks(vocabulary))

    @F.arrow_udf("binary")
    def run(column: pa.Array) -> pa.Array:
        if vocabulary not in _subwords:
            _subwords[vocabulary] = Subwords(vocabulary, shared.value)
        data, off = K.utf8(column)
        parts, size = [np.zeros(0, "<u2")], [np.zeros(1, np.int64)]
        for lo, hi in K.chunks(off):
            ids, at = _subwords[vocabulary](data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo])
            parts.append(ids.astype("<u2"))
            size.append(np.diff(at))
        ends = (2 * np.cumsum(np.concatenate(size))).astype(np.int64)
        valid = None if not column.null_count else column.is_valid().cast(pa.int8()).to_numpy()
        bits = None if valid is None else pa.py_buffer(np.packbits(valid, bitorder="little").tobytes())
        return pa.Array.from_buffers(pa.large_binary(), len(column), [bits, pa.py_buffer(ends.tobytes()), pa.py_buffer(np.concatenate(parts).tobytes())]).cast(pa.binary())

    coded = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("doc_id"), run(F.col(text_col)).alias("ids"))
    return store.written(coded, "lm-tokens")


_subwords: dict[str, Subwords] = {}


def _ids(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    data, off = K.utf8(column)
    return np.frombuffer(data.tobytes(), "<u2").astype(np.int64), off // 2


def id_counts(tokens: DataFrame, size: int) -> np.ndarray:
    """How often each id occurs in all documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for batch in batches:
            total += np.bincount(_ids(batch.column(0))[0], minlength=size)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["id", "n"])

    rows = tokens.select("ids").mapInArrow(run, "id bigint, n bigint").groupBy("id").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(size, np.int64)
    counts[rows["id"].to_numpy()] = rows["n"].to_numpy()
    return counts


def _flat(p: dict[str, np.ndarray]) -> np.ndarray:
    """The dense parameters as rows of WIDTH numbers."""
    x = np.concatenate([p[k].ravel() for k in _DENSE])
    return np.r_[x, np.zeros(-len(x) % WIDTH, np.float32)].reshape(-1, WIDTH)


def distinct_texts(tokens: DataFrame, shards: int) -> DataFrame:
    """shard, one, two (two hashes), ids and n: each text's ids once, of a task's copies, with the number of them, or later (without ids) of more of them.

    A text's hash alone says which shard it is in.  Copies are merged before they move, so that no shard gets the rows of a hot text.
    """
    keyed = tokens.where("ids is not null and octet_length(ids) > 0").select(F.xxhash64("ids").alias("one"), F.xxhash64(F.lit(1), "ids").alias("two"), "ids")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        more: dict[tuple[int, int], int] = {}
        for batch in batches:
            keys = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()))
            new = []
            for k, key in enumerate(keys):
                if key in more:
                    more[key] += 1
                else:
                    more[key] = 0
                    new.append(k)
            part = batch.take(pa.array(new, pa.int64()))
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(np.ones(len(part), np.int64))], ["one", "two", "ids", "n"])
        again = [(*key, n) for key, n in more.items() if n]
        if again:
            one, two, n = (pa.array(list(x), pa.int64()) for x in zip(*again))
            yield pa.RecordBatch.from_arrays([one, two, pa.nulls(len(again), pa.binary()), n], ["one", "two", "ids", "n"])

    return keyed.mapInArrow(run, "one bigint, two bigint, ids binary, n bigint").withColumn("shard", F.pmod("one", F.lit(shards)).cast("int"))


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """Shard, ids, offsets and numbers of copies of chunks of texts; what a chunk holds depends on the order of the rows alone."""
    place, key, held, copies, size = None, None, [], [], 0

    def chunk() -> tuple[int, np.ndarray, np.ndarray, np.ndarray]:
        ids = [np.frombuffer(x, "<u2") for x in held]
        return place, np.concatenate(ids).astype(np.int64), np.r_[0, np.cumsum([len(x) for x in ids])], np.array(copies, np.float64)

    for batch in batches:
        shard, one, two, ids, n = (c if k == 3 else c.to_pylist() for k, c in enumerate(batch.columns))
        for k in range(len(batch)):
            if (shard[k], one[k], two[k]) == key:
                copies[-1] += n[k]
                continue
            if held and (shard[k] != place or size >= 1 << 18):
                yield chunk()
                held, copies, size = [], [], 0
            place, key = shard[k], (shard[k], one[k], two[k])
            held.append(ids[k].as_py())
            copies.append(n[k])
            size += len(held[-1]) // 2
    if held:
        yield chunk()


def train(tokens: DataFrame, size: int, rounds: int = ROUNDS, rate: float = 0.02, shard: int = SHARD, most: int = CLASSES, single: int = SINGLES) -> Model:
    """Fit a model to the ids of all documents.

    Ids' classes are counted over all documents.  The distinct texts, each weighing as many as it has copies, are dealt by their hash to
    shards of about `shard` ids, and shards to rounds, so all windows train once.  In a round each shard trains a copy of the model, in
    order of the hashes; then the copies are averaged, each weighing as many ids as it has seen, in whole numbers.  So neither partitions
    nor the order of rows or sums alter the model.
    """
    spark = tokens.sparkSession
    counts = id_counts(tokens, size)
    model = fresh(counts, most, single)
    shards = max(1, int(np.ceil(counts.sum() / shard)))
    texts = distinct_texts(tokens, shards)
    for turn in range(min(rounds, shards)):
        shared = spark.sparkContext.broadcast(model)  # the vocabulary times WIDTH numbers

        def run(batches: Iterator[pa.RecordBatch], shared=shared, turn=turn) -> Iterator[pa.RecordBatch]:  # noqa: ANN001
            at, t = None, None

            def result() -> pa.RecordBatch:
                seen = np.flatnonzero(t.seen)
                dense = _flat(t.p)
                values = np.rint(np.concatenate([dense, t.p["ids"][seen]]).astype(np.float64) / _UNIT)
                weight = np.r_[np.full(len(dense), t.targets), t.seen[seen]]
                name = np.r_[-1 - np.arange(len(dense)), seen]
                columns = [pa.array(name), pa.array(weight), *(pa.array(values[:, k].astype(np.int64) * weight) for k in range(WIDTH))]
                return pa.RecordBatch.from_arrays(columns, ["name", "weight", *(f"v{k}" for k in range(WIDTH))])

            for place, ids, off, copies in _texts(batches):
                if place != at:
                    if t is not None:
                        yield result()
                    at, t = place, Trainer(shared.value, rate * 0.5**turn)
                inputs, goal, row, first = blocks(ids, off, size)
                weight = copies[row]
                for k in range(0, len(inputs), BATCH):
                    part = slice(k, k + BATCH)
                    t.step(inputs[part], goal[part], first[part], weight[part])
            if t is not None:
                yield result()

        kinds = "name bigint, weight bigint, " + ", ".join(f"v{k} bigint" for k in range(WIDTH))
        sums = [F.sum(F.col(c).cast("decimal(38,0)")).cast("double").alias(c) for c in ("weight", *(f"v{k}" for k in range(WIDTH)))]
        own = texts.where(F.col("shard") % rounds == turn).select(F.floor(F.col("shard") / rounds).cast("int").alias("to"), "shard", "one", "two", "ids", "n")
        own = own.repartitionById(-(-shards // rounds), F.col("to")).sortWithinPartitions("shard", "one", "two", F.col("ids").isNull(), "n")
        rows = own.select("shard", "one", "two", "ids", "n").mapInArrow(run, kinds).groupBy("name").agg(*sums).toArrow()
        if not rows.num_rows:
            continue
        name = rows["name"].to_numpy()
        mean = np.stack([rows[f"v{k}"].to_numpy() for k in range(WIDTH)], 1) / rows["weight"].to_numpy()[:, None] * _UNIT
        p = {k: v.copy() for k, v in model.p.items()}
        p["ids"][name[name >= 0]] = mean[name >= 0]
        dense = np.zeros_like(_flat(p))
        dense[-1 - name[name < 0]] = mean[name < 0]
        flat, at = dense.ravel(), 0
        for k in _DENSE:
            p[k] = flat[at : at + p[k].size].reshape(p[k].shape).copy()
            at += p[k].size
        model = Model(p, model.kind, model.within)
    return model


def block_log_probs(ids: np.ndarray, off: np.ndarray, model: Model, at_once: int = 256) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The row of each block of ids, its log-probability by the model, whether it is full, and a hash of its ids (of full ones).

    Every id is scored once, in the one window that has it among its last STEP places.
    """
    rows, logs, fulls, hashes = [], [], [], []
    mul = np.uint64(0x9E3779B97F4A7C15)
    for lo, hi in K.chunks(off, 1 << 18):
        inputs, goal, row, first = blocks(ids[off[lo] : off[hi]], off[lo : hi + 1] - off[lo], len(model.kind))
        log = np.zeros(len(row))
        for k in range(0, len(row), at_once):
            lead = max(0, k - 1)  # the first window's context
            part = slice(k, k + at_once)
            z = forward(model.p, inputs[lead : k + at_once], first[lead : k + at_once])[0][(k - lead) * STEP :]
            want = goal[part].ravel()
            live = np.flatnonzero(want >= 0)
            want = want[live]
            chosen = z[live, model.kind[want]].astype(np.float64) + model.within[want]
            np.exp(z, out=z)
            found = chosen - np.log((z @ np.ones(z.shape[1], z.dtype))[live])
            log[part] = np.bincount(live // STEP, found, len(goal[part]))
        real = goal[:, 0] >= 0
        h = np.zeros(len(goal), np.uint64)
        for k in range(STEP):
            h = K.mix64(h * mul + (goal[:, k] + 1).astype(np.uint64), 30)
        rows.append(lo + row[real])
        logs.append(log[real])
        fulls.append(goal[real, -1] >= 0)
        hashes.append(h[real].view(np.int64))
    if not rows:
        return np.zeros(0, np.int64), np.zeros(0), np.zeros(0, bool), np.zeros(0, np.int64)
    return tuple(map(np.concatenate, (rows, logs, fulls, hashes)))


def log_probs(ids: np.ndarray, off: np.ndarray, model: Model, at_once: int = 256) -> np.ndarray:
    """The log-probability of each row's ids by the model alone."""
    row, log, _, _ = block_log_probs(ids, off, model, at_once)
    return np.bincount(row, log, len(off) - 1) if len(row) else np.zeros(len(off) - 1)


def score_tokens(tokens: DataFrame, model: Model, memory: float = MEMORY) -> DataFrame:
    """doc_id, n_tokens, log_prob and perplexity of each row of a token table; see score()."""
    shared = tokens.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("struct<rest: double, log: array<double>, key: array<bigint>>")
    def run(column: pa.Array) -> pa.Array:
        ids, off = _ids(column)
        row, log, full, key = block_log_probs(ids, off, shared.value)
        rest = np.bincount(row[~full], log[~full], len(column)) if len(row) else np.zeros(len(column))
        ends = pa.array(np.r_[0, np.cumsum(np.bincount(row[full], minlength=len(column)))].astype(np.int32))
        lists = [pa.ListArray.from_arrays(ends, pa.array(x)) for x in (log[full], key[full])]
        return pa.StructArray.from_arrays([pa.array(rest), *lists], ["rest", "log", "key"], mask=column.is_null())

    n = (F.octet_length("ids") / 2).cast("bigint")
    found = tokens.select("row", "doc_id", n.alias("n_tokens"), run("ids").alias("f"))
    found = store.written(found.select("row", "doc_id", "n_tokens", "f.rest", "f.log", "f.key"), "lm-blocks")
    often = found.select(F.explode("key").alias("key")).groupBy("key").agg(F.count("*").alias("n"))
    often = store.written(often.where("n > 1"), "lm-memory")
    total = found.agg(F.coalesce(F.sum(F.size("key")), F.lit(0))).first()[0]
    each = found.select("row", F.explode(F.arrays_zip("log", "key")).alias("b")).select("row", "b.log", "b.key").join(often, "key")
    # log((1 - memory) p + memory q) - log((1 - memory) p), for the larger of the two apart.
    p, q = F.col("log") + float(np.log1p(-memory)), F.log(memory * (F.col("n") - 1) / max(1, total - 1))
    gain = F.greatest(p, q) - p + F.log1p(F.exp(-F.abs(p - q)))
    gains = each.groupBy("row").agg(F.sum(gain).alias("gain"))
    base = F.col("rest") + F.aggregate("log", F.lit(0.0), lambda acc, x: acc + x + float(np.log1p(-memory)))
    scored = found.select("row", "doc_id", "n_tokens", base.alias("base")).join(gains, "row", "left")
    scored = scored.select("doc_id", "n_tokens", (F.col("base") + F.coalesce("gain", F.lit(0.0))).alias("log_prob"))
    return scored.withColumn("perplexity", F.when(F.col("n_tokens") > 0, F.exp(-F.col("log_prob") / F.col("n_tokens"))))


def score(docs: DataFrame, vocabulary: str = VOCABULARY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: doc_id, n_tokens, log_prob (natural logarithm, summed over its ids) and perplexity (by id).

    The model is trained on the documents that it scores, all of them, and how they are partitioned doesn't alter the scores.  An id's
    probability is that of its class, by the attention model over up to CONTEXT + STEP - 1 ids before it, times its share of its class in
    the corpus; they sum to 1 over the vocabulary.  The probability of a full block of STEP ids (counted from the document's start) is
    that, but for a share MEMORY, which is the block's share of all other full blocks of the corpus; so what occurs elsewhere too is
    likelier, and a block that occurs once has no part in its own memory.  A null text has nulls, an empty one no ids, a log_prob of 0
    and a null perplexity; repeated rows are scored each.  Other columns are left out.
    """
    size = max(ranks(vocabulary).values()) + 1
    if size > 1 << 16:
        raise ValueError("a vocabulary of more than 65,536 ids isn't supported")
    tokens = token_table(docs, vocabulary, id_col, text_col)
    return score_tokens(tokens, train(tokens, size))
