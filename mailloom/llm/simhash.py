"""Near-duplicate removal: SimHash signatures, random bit-sampling tables, verified Hamming distances."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mailloom.llm import kernels as K
from mailloom.llm import store
from mailloom.llm.graph import components

#: Production parameters: bits of a signature, tables, bits sampled by a table, largest distance of near duplicates.
BITS, TABLES, SAMPLE, MAX_DISTANCE = 128, 32, 14, 20
#: A bucket of more signatures than this is split by additional bits, in so many ways that a pair at MAX_DISTANCE is apart in all of them
#: with a chance of MISSED at most; half of that where a part is split again.
BUCKET_CAP, MISSED = 256, 0.04
#: A task holds a bucket of this many signatures at most (about 100 MB); larger ones are split before, by additional bits too.
HELD = 1 << 22


def signatures(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Two uint64 for each row: the signs of the sums, over its distinct words, of the words' hash bits (+1 or -1; a sum of 0 gives 0).

    A row without words counts as one word.
    """
    rows = len(off) - 1
    h, row = K.distinct(*K.words(data, off))
    bare = np.flatnonzero(np.bincount(row, minlength=rows) == 0)
    if len(bare):
        extra = np.array([_raw_hash(data[off[r] : off[r + 1]]) for r in bare], np.uint64)
        row = np.r_[row, bare]
        order = np.argsort(row, kind="stable")
        h, row = np.r_[h, extra][order], row[order]
    out = np.zeros((rows, 2), np.uint64)
    start = np.searchsorted(row, np.arange(rows + 1))
    for half in range(2):
        bits = np.unpackbits(K.mix64(h, 20 + half).view(np.uint8).reshape(-1, 8), axis=1)
        sums = np.add.reduceat(bits, start[:-1], axis=0, dtype=np.int32)
        signs = 2 * sums > np.diff(start)[:, None]
        out[:, half] = np.packbits(signs, axis=1).view(np.uint64).ravel()
    return out


def _raw_hash(raw: np.ndarray) -> int:
    h = 0xCBF29CE484222325
    for b in raw.tolist():
        h = ((h ^ b) * 0x100000001B3) & 0xFFFFFFFFFFFFFFFF
    return h


def signature(text: Column) -> Column:
    """Struct of hi and lo (bigint), the 128-bit SimHash of a text's distinct lower-cased words; null for a null text.

    A word is a longest run of ASCII letters, digits and non-ASCII characters.  A text without words counts as one word.
    """

    @F.arrow_udf("struct<hi: bigint, lo: bigint>")
    def run(column: pa.Array) -> pa.Array:
        data, off = K.utf8(column)
        out = [np.zeros((0, 2), np.uint64)]
        for lo, hi in K.chunks(off):
            out.append(signatures(data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo]))
        both = np.concatenate(out).view(np.int64)
        return pa.StructArray.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], ["hi", "lo"], mask=column.is_null())

    return run(F.lower(text))


def coordinates(table: int) -> np.ndarray:
    """All bits in the order in which a table samples them."""
    return np.random.default_rng(1000 + table).permutation(BITS)


def mask(bits: np.ndarray) -> tuple[int, int]:
    """The two signed 64-bit masks of some bits."""
    out = [0, 0]
    for b in bits:
        out[b // 64] |= 1 << int(b % 64)
    return tuple(x - (1 << 64) if x >> 63 else x for x in out)


def distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b).sum(-1)


def near_pairs(sig: np.ndarray, group: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of rows of one group (groups lie together) whose signatures differ in limit bits at most."""
    n, left, right = len(sig), [], []
    live = np.arange(n)
    for k in range(1, n):
        live = live[live + k < n]
        live = live[group[live] == group[live + k]]
        if not len(live):
            break
        ok = live[distance(sig[live], sig[live + k]) <= limit]
        left.append(ok)
        right.append(ok + k)
    return (np.concatenate(left), np.concatenate(right)) if left else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def ways(rest: int, more: int, limit: int, missed: float) -> float:
    """In how many ways to split by `more` of the `rest` unsampled bits, so that rows that differ in `limit` of these stay together in one."""
    together = float(np.prod((rest - limit - np.arange(more)) / (rest - np.arange(more)))) if rest - limit >= more else 0.0
    return np.ceil(np.log(missed) / np.log1p(-together)) if 0 < together < 1 else 1.0 if together else np.inf


def star(sig: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Near pairs that connect a dense middle of some rows with itself and all rows near it; the rows that are then left to compare.

    The middle are rows within half of the limit of one row, so all near each other; a row beyond one and a half limits is near none of it.
    """
    bits = np.unpackbits(sig.view(np.uint8), axis=1)
    centre = np.packbits(2 * bits.sum(0, dtype=np.int64) > len(sig)).view(np.uint64)
    pivot = int(distance(sig, centre).argmin())
    away = distance(sig, sig[pivot])
    middle = away <= limit // 2
    if 4 * middle.sum() < len(sig):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.arange(len(sig))
    direct = np.flatnonzero((away <= limit) & (np.arange(len(sig)) != pivot))
    left, right = [direct], [np.full(len(direct), pivot)]
    inside = np.flatnonzero(middle)
    for x in np.flatnonzero((away > limit) & (away <= limit + limit // 2)):
        near = inside[distance(sig[inside], sig[x]) <= limit][:1]
        left.append(near)
        right.append(np.full(len(near), x))
    return np.concatenate(left), np.concatenate(right), np.flatnonzero(~middle)


def bucket_pairs(sig: np.ndarray, group: np.ndarray, table: int, depth: int = SAMPLE, limit: int = MAX_DISTANCE, cap: int = BUCKET_CAP, missed: float = MISSED, rest: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Near pairs of each group; of a group of over cap rows, links that connect what its near pairs connect.

    Such a group is split by additional bits, as are its parts, each time in as many ways as ways() tells, unless it takes fewer
    comparisons to compare all of its rows.  When all bits are sampled the rest of a group has equal signatures, whose pairs are a chain.
    """
    rest = coordinates(table)[SAMPLE:] if rest is None else rest
    size = np.bincount(group)
    big = size > cap
    small = ~big[group]
    at = np.flatnonzero(small)
    a, b = near_pairs(sig[at], group[at], limit)
    left, right = [at[a]], [at[b]]
    for g in np.flatnonzero(big):
        own = np.flatnonzero(group == g)
        if depth >= BITS:
            left.append(own[:-1])
            right.append(own[1:])
            continue
        a, b, others = star(sig[own], limit)
        left.append(own[a])
        right.append(own[b])
        own = own[others]
        if len(own) < 2:
            continue
        more = min(BITS - depth, max(1, int(np.ceil(np.log2(2 * len(own) / cap)))))
        n = ways(len(rest), more, limit, missed)
        if n * cap >= 2 * len(own):
            a, b = near_pairs(sig[own], np.zeros(len(own), np.int64), limit)
            a, b = local_links(np.arange(len(own)), a, b)
            left.append(own[a])
            right.append(own[b])
            continue
        for w in range(int(n)):
            bits = np.random.default_rng((7, table, depth, w)).permutation(rest)
            key = np.zeros(len(own), np.int64)
            for x in bits[:more]:
                key = key * 2 + ((sig[own, x // 64] >> np.uint64(x % 64)) & np.uint64(1)).astype(np.int64)
            order = np.argsort(key, kind="stable")
            _, part = np.unique(key[order], return_inverse=True)
            a, b = bucket_pairs(sig[own[order]], part, table, depth + more, limit, cap, missed / 2, bits[more:])
            a, b = local_links(np.arange(len(own)), order[a], order[b])
            left.append(own[a])
            right.append(own[b])
    return np.concatenate(left), np.concatenate(right)


def local_links(ids: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For pairs (rows a and b of ids), links of each member of a component to the component's least id."""
    x, y = ids[a], ids[b]
    nodes, at = np.unique(np.r_[x, y], return_inverse=True)
    p, q = at[: len(x)], at[len(x) :]
    least = np.arange(len(nodes))
    while True:
        low = np.minimum(least[p], least[q])
        now = least.copy()
        np.minimum.at(now, p, low)
        np.minimum.at(now, q, low)
        now = now[now]
        if (now == least).all():
            break
        least = now
    away = least != np.arange(len(nodes))
    return nodes[away], nodes[least[away]]


def spread(rows: DataFrame, depth: int, cap: int, limit: int, missed: float = MISSED) -> DataFrame:
    """Rows (id, hi, lo, t, w and b: a table, a way and the hash of these and of the sampled bits) whose buckets of more than `cap` are split.

    As in bucket_pairs(), such a bucket is split by additional bits in as many ways as ways() tells, again and again; here a row moves to
    the parts that it is in, so that no task gets a bucket of more than `cap` rows.  Buckets of that size are rare: counting them is all
    that it takes if there are none.
    """
    while depth < BITS:
        hot = store.written(rows.groupBy("b").agg(F.count("*").alias("n")).where(F.col("n") > cap), "simhash-hot")
        most = hot.agg(F.max("n")).first()[0]
        if most is None:
            return rows
        more = min(BITS - depth, max(1, int(np.ceil(np.log2(2 * most / cap)))))
        n = ways(BITS - depth, more, limit, missed)
        n = int(n) if np.isfinite(n) else 1
        large = store.written(rows.join(hot.select("b"), "b", "left_semi"), "simhash-large")
        found = []
        for r in large.select("t", "w").distinct().collect():  # as many as there are tables and ways
            used = _used(r["t"], r["w"])
            rest = [x for x in coordinates(r["t"]) if x not in used]
            for k in range(n):
                bits = np.random.default_rng((8, r["t"], depth, k)).permutation(rest)[:more]
                way = f"{r['w']}{'.' if r['w'] else ''}" + "-".join(map(str, sorted(bits.tolist())))
                found.append((r["t"], r["w"], way, *mask(np.r_[sorted(used), bits].astype(np.int64))))
        masks = F.broadcast(rows.sparkSession.createDataFrame(found, "t int, w string, way string, mhigh bigint, mlow bigint"))
        split = large.join(masks, ["t", "w"])
        split = split.select("id", "hi", "lo", "t", F.col("way").alias("w"), bucket_hash(F.col("way"), F.col("hi").bitwiseAND(F.col("mhigh")), F.col("lo").bitwiseAND(F.col("mlow"))).alias("b"))
        rows = store.written(rows.join(hot.select("b"), "b", "left_anti").select("id", "hi", "lo", "t", "w", "b").unionByName(split), "simhash-spread")
        depth, missed = depth + more, missed / 2
    return rows


def bucket_hash(way: Column, high: Column, low: Column) -> Column:
    """What stands for a bucket of a table (t); two that share a hash are compared with each other, which does no harm."""
    return F.xxhash64("t", way, high, low)


def _used(table: int, way: str) -> set[int]:
    """The bits by which the rows of a way of a table have been told apart."""
    return set(coordinates(table)[:SAMPLE].tolist()) | {int(x) for part in way.split(".") if part for x in part.split("-")}


def links(reps: DataFrame, tables: int = TABLES, limit: int = MAX_DISTANCE, cap: int = HELD) -> DataFrame:
    """src and dst (dst the lesser): pairs that connect the near duplicates among distinct signatures (id, hi, lo)."""
    masks = [mask(coordinates(t)[:SAMPLE]) for t in range(tables)]
    high, low = (F.col(c).bitwiseAND(F.get(F.array(*[F.lit(m[k]) for m in masks]), F.col("t"))) for k, c in enumerate(("hi", "lo")))
    rows = reps.select("id", "hi", "lo", F.explode(F.array(*map(F.lit, range(tables)))).alias("t"))
    rows = spread(rows.select("id", "hi", "lo", "t", F.lit("").alias("w"), bucket_hash(F.lit(""), high, low).alias("b")), SAMPLE, cap, limit)
    near = rows.select("id", "hi", "lo", "t", "b").repartition("b").sortWithinPartitions("b", "t", "id")

    def bucket(part: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Tables, signatures, and what tells buckets apart."""
        sig = np.stack([part["hi"].to_numpy(), part["lo"].to_numpy()], 1).view(np.uint64)
        return part["t"].to_numpy(), sig, np.stack([part["t"].to_numpy().astype(np.int64), part["b"].to_numpy()], 1)

    def run(batches):  # noqa: ANN001, ANN202
        def done(part: pa.Table) -> pa.RecordBatch:
            t, sig, key = bucket(part)
            ids = part["id"].to_numpy()
            group = np.cumsum(np.r_[False, (key[1:] != key[:-1]).any(1)])
            a, b = [], []
            size = np.bincount(group)
            plain = np.flatnonzero(((size > 1) & (size <= BUCKET_CAP))[group])
            x, y = near_pairs(sig[plain], group[plain], limit)
            a.append(plain[x])
            b.append(plain[y])
            for g in np.flatnonzero(size > BUCKET_CAP):
                own = np.flatnonzero(group == g)
                x, y = bucket_pairs(sig[own], np.zeros(len(own), np.int64), int(t[own[0]]), limit=limit)
                a.append(own[x])
                b.append(own[y])
            src, dst = local_links(ids, np.concatenate(a), np.concatenate(b))
            return pa.RecordBatch.from_arrays([pa.array(src), pa.array(dst)], ["src", "dst"])

        held: list[pa.Table] = []
        for batch in batches:
            part = pa.Table.from_batches([batch])
            _, _, key = bucket(part)
            last = (key == key[-1]).all(1)
            cut = len(part) - int(np.argmin(last[::-1])) if not last.all() else 0
            # Rows from cut on belong to the last bucket, which the next batch may continue.
            if held:
                before = bucket(held[0].slice(0, 1))
                if (key[0] != before[2][0]).any():
                    yield done(pa.concat_tables(held))
                    held = []
            if cut:
                yield done(pa.concat_tables([*held, part.slice(0, cut)]))
                held = []
            held.append(part.slice(cut))
        if held:
            yield done(pa.concat_tables(held))

    return near.mapInArrow(run, "src bigint, dst bigint").distinct()


def groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", limit: int = MAX_DISTANCE) -> DataFrame:
    """doc_id, group_id and kept for each distinct doc_id: near duplicates share the least doc_id of their group, which is kept.

    Near duplicates are documents whose signatures differ in `limit` bits at most, and those that a chain of such pairs connects.
    Equal signatures are always found; of the others those are found that agree in the sampled bits of one of the tables.  Documents
    with a null id aren't listed; a null text is alone in its group; empty texts are copies of each other.  Of several rows with one
    doc_id, the one with the least signature counts.
    """
    sigs = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("bigint").alias("doc_id"), signature(F.col(text_col)).alias("s"))
    sigs = store.written(sigs.select("doc_id", "s.hi", "s.lo"), "simhash")
    one = store.written(sigs.groupBy("doc_id").agg(F.min(F.struct("hi", "lo")).alias("s")).select("doc_id", "s.hi", "s.lo"), "simhash-one")
    reps = store.written(one.where("hi is not null").groupBy("hi", "lo").agg(F.min("doc_id").alias("id")), "simhash-reps")
    joined = components(store.written(links(reps, limit=limit), "simhash-links"))
    roots = reps.join(joined, reps["id"] == joined["node"], "left").select("hi", "lo", F.coalesce("root", "id").alias("group_id"))
    named = one.join(roots, ["hi", "lo"]).select("doc_id", "group_id")
    alone = one.where("hi is null").select("doc_id", F.col("doc_id").alias("group_id"))
    return named.unionByName(alone).select("doc_id", "group_id", (F.col("doc_id") == F.col("group_id")).alias("kept"))


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents, with all their columns, without those of a group other than the kept one.

    Documents with a null id stay.  Of rows that repeat an id, one stays: that of the least signature, which groups() used, then of the
    least text, then of the least hash of all columns that can be hashed.
    """
    found = store.written(groups(docs, id_col, text_col), "simhash-groups")
    gone = found.where("not kept").select(F.col("doc_id").alias("_gone"))
    left = docs.join(gone, docs[id_col] == gone["_gone"], "left_anti")
    again = docs.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("_again")).count().where("count > 1").select("_again")
    again = store.written(again, "simhash-again")
    if again.isEmpty():
        return left
    columns = [F.col(f"`{c}`") for c in docs.columns]
    plain = [F.col(f"`{f.name}`") for f in docs.schema if "map<" not in f.dataType.simpleString() and "variant" not in f.dataType.simpleString()]
    repeated = left.join(again, left[id_col] == again["_again"], "left_semi")
    keyed = repeated.select(F.col(id_col).alias("_again"), F.struct(signature(F.col(text_col)).alias("s"), F.col(text_col).alias("t"), F.xxhash64(*plain).alias("h")).alias("_order"), F.struct(*columns).alias("_row"))
    one = keyed.groupBy("_again").agg(F.min_by("_row", "_order").alias("_row")).select("_row.*")
    return left.join(again, left[id_col] == again["_again"], "left_anti").unionByName(one)
