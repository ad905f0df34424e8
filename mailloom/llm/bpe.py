"""Byte-level BPE by Spark's higher-order functions: ranked merges are folded over the bytes of words by a literal map of ranks."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mailloom.llm import store
from mailloom.llm.tokenfile import PATTERN, VOCABULARY, ranks

#: Of the distinct words that occur more than once, the most frequent ones, this many at most, are folded once and put into the plan, from
#: which documents look them up; all others are folded where they stand.  The ids are the same for any number of them.
HEAD_WORDS = 1 << 18
#: Words of more bytes are first cut between bytes that no piece has side by side, and folded by all places of a pair at once.
LONG = 64
#: Words of the head that a task folds, about.
FOLDED = 1 << 15

_NONE = 1 << 30
_SHIFTS = (0, 32)
_PLANE = 0x10000


def _slots(key: np.ndarray, size: int) -> list[np.ndarray]:
    """The two places of some 64-bit keys in a table."""
    return [(key.view(np.uint64) >> np.uint64(s)).astype(np.int64) & (size - 1) for s in _SHIFTS]


def place(keys: np.ndarray, size: int) -> np.ndarray:
    """Cuckoo hashing: for each slot the number of the key in it, or -1; keys for which there is no room are left out."""
    one, two = (x.tolist() for x in _slots(keys, size))
    at = [-1] * size
    for k in range(len(keys)):
        cur, slot = k, one[k]
        for _ in range(500):
            cur, at[slot] = at[slot], cur
            if cur < 0:
                break
            slot = two[cur] if slot == one[cur] else one[cur]
    return np.array(at)


def pair_ranks(vocabulary: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The ranks of pairs of ids whose pieces together are a piece, as a table of displaced rows, and which ids are calm.

    Arrays shift, owner and rank: the pair (a, b) has a rank if owner[shift[a] + b] is a, and then rank[shift[a] + b].  An id is calm if
    it is in no pair of a lower rank than its own, so that making it can't bring forth a pair that is due before its like.
    """
    rows: dict[int, dict[int, int]] = {}
    most = max(vocabulary.values()) + 1
    calm = np.ones(most, np.int32)
    for piece, i in vocabulary.items():
        for cut in range(1, len(piece)):
            a, b = vocabulary.get(piece[:cut]), vocabulary.get(piece[cut:])
            if a is not None and b is not None:
                rows.setdefault(a, {})[b] = i
                for x in (a, b):
                    if i < x:
                        calm[x] = 0
    size = most + 4 * sum(map(len, rows.values()))
    shift, owner, rank = np.zeros(most, np.int32), np.full(size, -1, np.int32), np.zeros(size, np.int32)
    rng = np.random.default_rng(0)
    for a, row in sorted(rows.items(), key=lambda x: (-len(x[1]), x[0])):
        b = np.fromiter(row, np.int64, len(row))
        while (owner[(d := int(rng.integers(size - most))) + b] >= 0).any():
            pass
        shift[a], owner[d + b], rank[d + b] = d, a, list(row.values())
    return shift, owner, rank, calm


def neighbour_bytes(vocabulary: dict[bytes, int]) -> np.ndarray:
    """For each byte times 256 plus a next byte, 1 if a piece has them side by side."""
    out = np.zeros(1 << 16, np.int32)
    for piece in vocabulary:
        for a, b in zip(piece, piece[1:]):
            out[a * 256 + b] = 1
    return out


def literals(spark: SparkSession, values: list[pa.Array]) -> list[Column]:
    """Literal arrays in Spark's compact form, made from Arrow arrays; wherever such a column is used, the plan shares the one array."""
    from pyspark.sql.classic.column import Column as Classic

    lists = [pa.LargeListArray.from_arrays(pa.array([0, len(v)], pa.int64()), v) if pa.types.is_list(v.type) or pa.types.is_string(v.type) else pa.ListArray.from_arrays(pa.array([0, len(v)], pa.int32()), v) for v in values]
    frame = spark.createDataFrame(pa.Table.from_arrays([x.cast(pa.list_(x.type.value_type)) for x in lists], [f"v{k}" for k in range(len(lists))]))
    row = frame._jdf.queryExecution().executedPlan().executeTake(1)[0]
    catalyst = spark._jvm.org.apache.spark.sql.catalyst.expressions
    kinds = frame._jdf.schema()
    wrap = spark._jvm.org.apache.spark.sql.classic.ExpressionUtils.column
    return [Classic(wrap(catalyst.Literal(row.getArray(k).copy(), kinds.apply(k).dataType()))) for k in range(len(lists))]


def _let(value: Column, use) -> Column:  # noqa: ANN001
    """use(value), with the value worked out once."""
    return F.transform(F.array(value), use)[0]


class Codec:
    """Encodes and decodes columns of a session by a vocabulary of at most 65,536 ranks."""

    def __init__(self, spark: SparkSession, vocabulary: str = VOCABULARY) -> None:
        self.spark, pieces = spark, ranks(vocabulary)
        most = max(pieces.values()) + 1
        if most > 65536:
            raise ValueError("ids of 65,536 and more aren't supported")
        by_id = [""] * most
        for piece, i in pieces.items():
            by_id[i] = piece.decode("latin-1")
        single = np.array([pieces[bytes([b])] for b in range(256)], np.int32)
        signs = [chr(_PLANE + k) for k in range(most)]
        numbers = [*pair_ranks(pieces), single, neighbour_bytes(pieces)]
        found = literals(spark, [*map(pa.array, numbers), pa.array(by_id), pa.array(signs)])
        self.shift, self.owner, self.ranks, self.calm, self.single, self.beside, self.pieces, self.signs = found
        self.head: tuple[Column, Column, int] | None = None

    def words(self, text: Column) -> Column:
        """The pieces that merges don't cross."""
        return F.regexp_extract_all(text, F.lit(f"(?U){PATTERN}"), F.lit(0))

    def _rank(self, a: Column, b: Column) -> Column:
        at = F.get(self.shift, a) + b
        return F.when(F.get(self.owner, at) == a, F.get(self.ranks, at)).otherwise(_NONE)

    def _pairs(self, s: Column) -> Column:
        return F.zip_with(s, F.slice(s, F.lit(2), F.size(s)), self._rank)

    def _first(self, s: Column, r: Column, m: Column) -> Column:
        """The ids with the first pair of rank m merged."""
        p = F.array_position(r, m).cast("int")
        return F.concat(F.slice(s, F.lit(1), p - 1), F.array(m), F.slice(s, p + 2, F.size(s)))

    def _one_by_one(self, start: Column) -> Column:
        def step(s: Column, _: Column) -> Column:
            return _let(self._pairs(s), lambda r: _let(F.array_min(r), lambda m: F.when(m == _NONE, s).otherwise(self._first(s, r, m))))

        return _let(start, lambda s: F.aggregate(F.slice(s, F.lit(2), F.size(s)), s, step))

    def _all_at_once(self, start: Column) -> Column:
        """The same; all pairs of the lowest rank are merged in one step where that comes to the same, so steps are as many as ranks, not as pairs."""

        def every(s: Column, r: Column, m: Column) -> Column:
            return F.filter(F.transform(s, lambda x, i: F.when(F.get(r, i) == m, m).when(F.get(r, i - 1) == m, -1).otherwise(x)), lambda x: x >= 0)

        def twins(s: Column, a: Column, m: Column) -> Column:
            """Runs of one id, of which pairs are merged from the left."""
            line = F.array_join(F.transform(s, lambda x: F.get(self.signs, x)), "")
            sign = F.get(self.signs, a)
            return F.transform(F.split(F.replace(line, F.concat(sign, sign), F.get(self.signs, m)), ""), lambda c: F.ascii(c) - _PLANE)

        def merged(s: Column, r: Column, m: Column) -> Column:
            crossed = F.exists(F.zip_with(r, F.slice(r, F.lit(2), F.size(r)), lambda x, y: (x == m) & (y == m)), lambda x: F.coalesce(x, F.lit(False)))
            a = F.get(s, F.array_position(r, m).cast("int") - 1)
            same = F.forall(F.zip_with(r, F.transform(s, lambda x, i: (x == a) & (F.get(s, i + 1) == a)), lambda x, y: (x != m) | y), lambda x: x)
            return F.when(F.get(self.calm, m) == 0, self._first(s, r, m)).when(~crossed, every(s, r, m)).when(same, twins(s, a, m)).otherwise(self._first(s, r, m))

        def state(s: Column, done: Column) -> Column:
            return F.struct(s.alias("s"), done.alias("done"))

        def step(acc: Column, _: Column) -> Column:
            def now(r: Column) -> Column:
                return _let(F.array_min(r), lambda m: F.when(m == _NONE, state(acc["s"], F.lit(True))).otherwise(state(merged(acc["s"], r, m), F.lit(False))))

            return F.when(acc["done"], acc).otherwise(_let(self._pairs(acc["s"]), now))

        return _let(start, lambda s: F.aggregate(F.slice(s, F.lit(2), F.size(s)), state(s, F.lit(False)), step, lambda acc: acc["s"]))

    def fold(self, word: Column) -> Column:
        """The ids of a word: of the pairs of neighbours that are pieces, the one of the lowest rank (then the first) is merged, again and again."""
        chars = F.transform(F.split(F.decode(F.encode(word, "UTF-8"), "ISO-8859-1"), ""), lambda c: F.ascii(c))

        def ids(b: Column) -> Column:
            return F.transform(b, lambda x: F.get(self.single, x))

        def part(b: Column) -> Column:
            return F.when(F.size(b) <= LONG, self._one_by_one(ids(b))).otherwise(self._all_at_once(ids(b)))

        def cut(b: Column) -> Column:
            place = F.transform(b, lambda x, i: i)
            ends = F.filter(place, lambda i: (i == F.size(b) - 1) | (F.get(self.beside, F.get(b, i) * 256 + F.get(b, i + 1)) == 0))
            start = lambda e, k: F.when(k == 0, 0).otherwise(F.get(e, k - 1) + 1)
            return _let(ends, lambda e: F.flatten(F.transform(e, lambda end, k: part(F.slice(b, start(e, k) + 1, end - start(e, k) + 1)))))

        return F.when(F.octet_length(word) <= LONG, self._one_by_one(ids(chars))).otherwise(_let(chars, cut))

    def with_head(self, head: pa.Table) -> Codec:
        """The same codec; it looks up the ids of some words (word, key, Spark's 64-bit hash of it, and ids), comparing the word itself."""
        size = 1 << max(4, (2 * len(head) - 1).bit_length())
        at = place(head["key"].to_numpy(), size)
        where = pa.array(at, mask=at < 0)
        names, lists = head["word"].combine_chunks().take(where).fill_null(""), head["ids"].combine_chunks().take(where).cast(pa.list_(pa.int32()))
        self.head = (*literals(self.spark, [names, lists]), size)
        return self

    def encode(self, text: Column) -> Column:
        """Ids (array of int) of a text; null for a null text, none for an empty one."""
        words = self.words(text)
        if self.head is None:
            return F.flatten(F.transform(words, self.fold))
        name, held, size = self.head

        def found(word: Column, key: Column) -> Column:
            one, two = (F.shiftrightunsigned(key, s).bitwiseAND(size - 1).cast("int") for s in _SHIFTS)
            known = F.when(F.get(name, one) == word, F.get(held, one)).when(F.get(name, two) == word, F.get(held, two))
            return known.otherwise(self.fold(word))

        return F.flatten(F.zip_with(words, F.transform(words, lambda w: F.xxhash64(w)), found))

    def decode_binary(self, ids: Column) -> Column:
        """The concatenated binary pieces of ids; each piece's bytes are held as the characters of the same numbers."""
        return F.encode(F.array_join(F.transform(ids, lambda i: F.get(self.pieces, i)), ""), "ISO-8859-1")

    def decode(self, ids: Column) -> Column:
        """The text of ids; parts that aren't UTF-8 stay as they are, to be told by is_valid_utf8()."""
        return self.decode_binary(ids).cast("string")


def head_words(docs: DataFrame, codec: Codec, text_col: str = "text", most: int = HEAD_WORDS) -> pa.Table:
    """word, key and ids of the most frequent words of all documents, each folded once.

    These are the words that occur twice at least and are in the highest classes of frequency (64 for each doubling) that hold `most`
    words at most together, so no order of ties matters.
    """
    words = docs.select(F.explode(codec.words(F.col(text_col))).alias("word")).groupBy("word").agg(F.count("*").alias("n")).where("n > 1")
    words = store.written(words, "bpe-words")
    level = F.floor(F.log2("n") * 64)
    levels = words.groupBy(level.alias("level")).agg(F.count("*").alias("words")).orderBy(F.desc("level")).toArrow()
    inside = int((np.cumsum(levels["words"].to_numpy()) <= most).sum()) if len(levels) else 0
    if not inside:
        return pa.table({"word": pa.array([], pa.string()), "key": pa.array([], pa.int64()), "ids": pa.array([], pa.list_(pa.int32()))})
    held = int(np.cumsum(levels["words"].to_numpy())[inside - 1])
    head = words.where(level >= levels["level"][inside - 1].as_py()).repartition(max(1, math.ceil(held / FOLDED)))
    return head.select("word", F.xxhash64("word").alias("key"), codec.fold(F.col("word")).alias("ids")).toArrow()


def encode_documents(docs: DataFrame, vocabulary: str = VOCABULARY, id_col: str = "doc_id", text_col: str = "text", most: int = HEAD_WORDS) -> DataFrame:
    """One row a document: doc_id, ids (array of int), n_tokens, and whether the ids decode to the very text.

    A null text has nulls, an empty one no ids; repeated rows are encoded each; other columns are left out.  Very long words are cut where
    no merge can cross (see LONG), so their time grows with their length, unless they have few such places and many different merges.
    """
    codec = Codec(docs.sparkSession, vocabulary)
    codec = codec.with_head(head_words(docs, codec, text_col, most))
    coded = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), codec.encode(F.col(text_col)).alias("ids"))
    size = F.when(F.col("ids").isNotNull(), F.size("ids")).cast("bigint")
    return coded.select("doc_id", "ids", size.alias("n_tokens"), (codec.decode(F.col("ids")) == F.col("text")).alias("exact"))
