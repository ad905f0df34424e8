"""Language identification by rank-order profiles of character n-grams."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mailloom.llm import kernels as K

#: Production parameters: n-grams of one to ORDER letters; ranks that a profile holds.
ORDER, RANKS = 3, 300
#: A text is rejected if its distance to the nearest profile is over this many per cent of the largest possible one.
REJECT_PERCENT = 75

_CP_BITS = 21


@dataclass(frozen=True)
class Profiles:
    """Languages in order of their names, n-grams in order, and the rank of each n-gram in each language (RANKS where it has none)."""

    langs: list[str]
    grams: np.ndarray
    ranks: np.ndarray


def gram_counts(data: np.ndarray, off: np.ndarray, group: np.ndarray, groups: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Group, n-gram and count, in order of group and n-gram; group has a number for each row.

    A text is its longest runs of letters, each with a blank before and after it; n-grams don't reach over such a blank, and a lone
    blank is none.  An n-gram is coded as its code points, 21 bits each, left-aligned, so that codes are in order of the strings.
    """
    cp, at = K.codepoints(data, off, pad=True)
    if len(cp) == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64)
    inside = K.letters()[np.minimum(cp, 0x10FFFF)]
    starts = np.zeros(len(cp), bool)
    starts[at[:-1]] = True
    keep = inside.copy()
    keep[1:] |= inside[:-1]
    keep |= starts
    cp = np.where(inside, cp, np.uint32(0x20))[keep]
    row = np.repeat(np.arange(len(off) - 1), np.diff(at))[keep]
    blank = cp == 0x20
    alphabet, code = np.unique(cp, return_inverse=True)
    bits = int(len(alphabet)).bit_length()
    code = (code + 1).astype(np.uint64)
    owner = group[row].astype(np.uint64) << np.uint64(ORDER * bits)
    keys = []
    for n in range(1, ORDER + 1):
        m = len(cp) - n + 1
        if m <= 0:
            break
        ok = row[:m] == row[n - 1 :]
        if n == 1:
            ok &= ~blank
        for k in range(1, n - 1):
            ok &= ~blank[k : k + m]
        if n == 2:
            ok &= ~(blank[:m] & blank[1:])
        g = owner[:m].copy()
        for k in range(n):
            g |= code[k : k + m] << np.uint64((ORDER - 1 - k) * bits)
        keys.append(g[ok])
    key = np.sort(np.concatenate(keys))
    if len(key) == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64)
    first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    count = np.diff(np.r_[first, len(key)])
    key = key[first]
    wide = np.r_[np.uint64(0), alphabet.astype(np.uint64)]
    gram = np.zeros(len(key), np.uint64)
    for k in range(ORDER):
        part = (key >> np.uint64((ORDER - 1 - k) * bits)) & np.uint64((1 << bits) - 1)
        gram |= wide[part.astype(np.int64)] << np.uint64((ORDER - 1 - k) * _CP_BITS)
    return (key >> np.uint64(ORDER * bits)).astype(np.int64), gram, count


def count_grams(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """lang, gram (a code) and n over all documents of a language; rows whose language or text is null are left out."""

    def run(batches):  # noqa: ANN001, ANN202
        for batch in batches:
            tally: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
            lang = batch.column(0).dictionary_encode()
            names = lang.dictionary.to_pylist()
            group = lang.indices.to_numpy(zero_copy_only=False).astype(np.int64)
            data, off = K.utf8(batch.column(1))
            for lo, hi in K.chunks(off):
                which, gram, n = gram_counts(data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo], group[lo:hi], len(names))
                for k in np.unique(which):
                    tally.setdefault(names[k], []).append((gram[which == k], n[which == k]))
            for name, parts in tally.items():
                grams, at = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
                sums = np.bincount(at, np.concatenate([p[1] for p in parts])).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(grams)), pa.array(grams.view(np.int64)), pa.array(sums)], ["lang", "gram", "n"])

    known = docs.select(F.col(lang_col).alias("lang"), F.lower(F.col(text_col)).alias("text")).where("lang is not null and text is not null")
    return known.mapInArrow(run, "lang string, gram bigint, n bigint").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def train(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> Profiles:
    """The profile of each language: its RANKS most frequent n-grams over all its documents, ties in order of the n-grams."""
    best = F.slice(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("n"), "gram"))), 1, RANKS)
    # A language has as many n-grams as it has letter combinations, whatever the number of documents.
    rows = sorted(count_grams(docs, text_col, lang_col).groupBy("lang").agg(best.alias("best")).collect())
    langs = [r.lang for r in rows]
    grams = np.unique(np.array([g.gram for r in rows for g in r.best], np.uint64))
    ranks = np.full((len(grams), len(langs)), RANKS, np.int64)
    for k, r in enumerate(rows):
        ranks[np.searchsorted(grams, np.array([g.gram for g in r.best], np.uint64)), k] = np.arange(len(r.best))
    return Profiles(langs, grams, ranks)


def distances(data: np.ndarray, off: np.ndarray, profiles: Profiles) -> tuple[np.ndarray, np.ndarray]:
    """How many n-grams of each row are ranked, and the sum of their out-of-place distances to each profile."""
    rows = len(off) - 1
    row, gram, count = gram_counts(data, off, np.arange(rows), rows)
    order = np.argsort((row.astype(np.uint64) << np.uint64(40)) | (np.uint64((1 << 40) - 1) - count.astype(np.uint64)), kind="stable")
    row, gram = row[order], gram[order]
    start = np.searchsorted(row, np.arange(rows))
    rank = np.arange(len(row)) - start[row]
    use = rank < RANKS
    row, gram, rank = row[use], gram[use], rank[use]
    at = np.minimum(np.searchsorted(profiles.grams, gram), len(profiles.grams) - 1)
    theirs = np.where((profiles.grams[at] == gram)[:, None], profiles.ranks[at], RANKS)
    away = np.where(theirs == RANKS, RANKS, np.abs(theirs - rank[:, None]))
    return np.bincount(row, minlength=rows), K.row_sums(away, row, rows)


def identify(text: Column, profiles: Profiles) -> Column:
    """Struct of detected (string), distance and n_grams (bigint) of a text.

    distance is the sum, over the text's RANKS most frequent n-grams (ties in order of the n-grams), of how far each one's rank is from
    its rank in the nearest profile, RANKS if it isn't in it.  Of equally near languages the first by name counts.  Without letters, or
    without any profile, detected and distance are null; a null text has null in all.
    """
    shared = SparkSession.active().sparkContext.broadcast(profiles)

    @F.arrow_udf("struct<detected: string, distance: bigint, n_grams: bigint>")
    def run(column: pa.Array) -> pa.Array:
        p = shared.value
        data, off = K.utf8(column)
        size, best, which = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for lo, hi in K.chunks(off) if p.langs else ():
            n, d = distances(data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo], p)
            size.append(n)
            which.append(d.argmin(1))
            best.append(d.min(1))
        if not p.langs:
            size, best, which = ([np.zeros(len(column), np.int64)] for _ in range(3))
        n = np.concatenate(size)
        names = np.array([*p.langs, None], object)[np.where(n == 0, len(p.langs), np.concatenate(which))]
        fields = [pa.array(names, pa.string()), pa.array(np.concatenate(best), mask=n == 0), pa.array(n)]
        return pa.StructArray.from_arrays(fields, ["detected", "distance", "n_grams"], mask=column.is_null())

    return run(F.lower(text))


def accepts(found: Column) -> Column:
    """Whether a text (by its struct of identify()) is in one of the languages: near enough to a profile; false without letters."""
    near = found["distance"] * 100 <= found["n_grams"] * (RANKS * REJECT_PERCENT)
    return F.coalesce(near, F.lit(False))


def classify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """One row a document: doc_id, detected, distance, n_grams, accepted; the profiles are those of the documents' own languages.

    A null text has nulls and isn't accepted, nor is one without letters; a row with a null language has no part in a profile and is
    identified like any other.  Repeated rows count and are listed each; other columns are left out.
    """
    profiles = train(docs, text_col, lang_col)
    found = docs.select(F.col(id_col).alias("doc_id"), identify(F.col(text_col), profiles).alias("f"))
    return found.select("doc_id", "f.detected", "f.distance", "f.n_grams", accepts(F.col("f")).alias("accepted"))


def reject_unknown(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The documents, with all their columns, that are in one of their languages; a text that is null or has no letters goes."""
    return docs.where(accepts(identify(F.col(text_col), train(docs, text_col, lang_col))))


#: DuckDB's SQL for classify() over the table or relation {docs}: all rows, whole texts.
SQL = f"""
WITH chars AS (
  SELECT doc_id AS d, lang AS l, row_number() OVER () AS r,
         string_split(' ' || trim(regexp_replace(lower(text), '[^\\pL]+', ' ', 'g'), ' ') || ' ', '') AS c, text IS NULL AS missing
  FROM {{docs}}),
grams AS (
  SELECT r, l, unnest(list_filter(c, lambda x: x <> ' ')) AS g FROM chars WHERE NOT missing
  UNION ALL
  SELECT r, l, unnest(list_filter(list_transform(range(1, len(c)), lambda i: c[i] || c[i + 1]), lambda x: x <> '  ')) FROM chars WHERE NOT missing
  UNION ALL
  SELECT r, l, unnest(list_transform(list_filter(range(1, len(c) - 1), lambda i: c[i + 1] <> ' '), lambda i: c[i] || c[i + 1] || c[i + 2])) FROM chars WHERE NOT missing),
own AS (
  SELECT r, g, row_number() OVER (PARTITION BY r ORDER BY n DESC, g) - 1 AS k FROM (SELECT r, g, count(*) AS n FROM grams GROUP BY r, g)
  QUALIFY k < {RANKS}),
profile AS (
  SELECT l, g, row_number() OVER (PARTITION BY l ORDER BY n DESC, g) - 1 AS k
  FROM (SELECT l, g, count(*) AS n FROM grams WHERE l IS NOT NULL GROUP BY l, g) QUALIFY k < {RANKS}),
langs AS (SELECT DISTINCT l FROM profile),
away AS (
  SELECT o.r, langs.l, CAST(sum(coalesce(abs(o.k - p.k), {RANKS})) AS BIGINT) AS distance, count(*) AS n_grams
  FROM own o CROSS JOIN langs LEFT JOIN profile p ON p.l = langs.l AND p.g = o.g GROUP BY o.r, langs.l),
best AS (SELECT * FROM away QUALIFY row_number() OVER (PARTITION BY r ORDER BY distance, l) = 1)
SELECT chars.d AS doc_id, best.l AS detected, best.distance,
       CASE WHEN chars.missing THEN NULL ELSE coalesce(best.n_grams, 0) END AS n_grams,
       coalesce(best.distance * 100 <= best.n_grams * {RANKS * REJECT_PERCENT}, false) AS accepted
FROM chars LEFT JOIN best USING (r)
"""
