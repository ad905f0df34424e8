"""Document fingerprints: one-permutation MinHash, densified and packed to a few bits a bin."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mailloom.llm import kernels as K

#: Production parameters: words in a shingle, bins (a power of two), bits kept of each bin (a divisor of 64).
WIDTH, BINS, BITS = 3, 256, 4


def probe_order(bins: int, tries: int) -> np.ndarray:
    """For each bin, the bins that it asks for a value while it is empty: the same universal hash for all documents."""
    at = np.arange(bins, dtype=np.uint64)[:, None] * np.uint64(1 << 20) + np.arange(1, tries + 1, dtype=np.uint64)
    return (K.mix64(at, 11) >> np.uint64(64 - bins.bit_length() + 1)).astype(np.int64)


def densify(low: np.ndarray, empty: np.ndarray) -> np.ndarray:
    """Fill the empty bins of each row by optimal densification; a row without any value keeps zeros."""
    rows, bins = low.shape
    todo_row, todo_bin = np.nonzero(empty & ~empty.all(1)[:, None])
    step, out = 0, low.copy()
    order = probe_order(bins, 64)
    while len(todo_row):
        if step == order.shape[1]:
            order = probe_order(bins, 2 * step)
        ask = order[todo_bin, step]
        found = ~empty[todo_row, ask]
        out[todo_row[found], todo_bin[found]] = low[todo_row[found], ask[found]]
        todo_row, todo_bin, step = todo_row[~found], todo_bin[~found], step + 1
    return out


def sketch(data: np.ndarray, off: np.ndarray, width: int, bins: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct-shingle-insensitive counts of shingles, and packed bins (int64) of each row."""
    rows = len(off) - 1
    h, row = K.shingles(*K.words(data, off), width)
    which = (h >> np.uint64(64 - bins.bit_length() + 1)).astype(np.int64) + row * bins
    least = np.full(rows * bins, np.uint64(0xFFFFFFFFFFFFFFFF))
    np.minimum.at(least, which, h << np.uint64(bins.bit_length() - 1))
    empty = np.ones(rows * bins, bool)
    empty[which] = False
    low = (K.mix64(least, 5) & np.uint64((1 << bits) - 1)).reshape(rows, bins)
    low[empty.reshape(rows, bins)] = 0
    full = densify(low, empty.reshape(rows, bins)).reshape(rows, bins * bits // 64, 64 // bits)
    packed = np.zeros(full.shape[:2], np.uint64)
    for k in range(64 // bits):
        packed |= full[:, :, k] << np.uint64(k * bits)
    return np.bincount(row, minlength=rows), packed.view(np.int64)


def fingerprint(text: Column | str, width: int = WIDTH, bins: int = BINS, bits: int = BITS) -> Column:
    """Struct of n_shingles (bigint) and fingerprint (array of bigint) of a text.

    Words are longest runs of ASCII letters, digits and non-ASCII characters of the lower-cased text; a shingle is `width` of them in a
    row, or all of them if there are fewer.  Each shingle is hashed once; the top bits choose its bin, which keeps its least hash.  An
    empty bin takes the value of the first filled one in a fixed pseudo-random order of its own.  Of each bin's least hash, `bits` bits
    are packed, low bins first.  A null text has null; a text without words has 0 shingles and a null fingerprint.  Repeated shingles
    count in n_shingles and don't alter the fingerprint.
    """
    if bins < 2 or bins & (bins - 1) or bits < 1 or 64 % bits or bins * bits % 64 or width < 1:
        raise ValueError("bins must be a power of two, bits a divisor of 64, and both together whole words of 64 bits")

    @F.arrow_udf("struct<n_shingles: bigint, fingerprint: array<bigint>>")
    def run(column: pa.Array) -> pa.Array:
        data, off = K.utf8(column)
        counts, packed = [np.zeros(0, np.int64)], [np.zeros((0, bins * bits // 64), np.int64)]
        for lo, hi in K.chunks(off):
            n, p = sketch(data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo], width, bins, bits)
            counts.append(n)
            packed.append(p)
        n, p = np.concatenate(counts), np.concatenate(packed)
        ends = np.arange(len(n) + 1, dtype=np.int32) * p.shape[1]
        lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(p.ravel()), mask=pa.array(n == 0))
        null = column.is_null()
        return pa.StructArray.from_arrays([pa.array(n), lists], ["n_shingles", "fingerprint"], mask=null)

    return run(F.lower(text))


def matching_bins(a: Column, b: Column, bits: int = BITS) -> Column:
    """How many bins of two fingerprints hold the same bits."""
    ones = sum(1 << k for k in range(0, 64, bits))
    ones -= (1 << 64) * (ones >> 63)

    def same(x: Column, y: Column) -> Column:
        d = x.bitwiseXOR(y)
        k = 1
        while k < bits:
            d = d.bitwiseOR(F.shiftrightunsigned(d, k))
            k *= 2
        return F.lit(64 // bits) - F.bit_count(d.bitwiseAND(F.lit(ones)))

    return F.aggregate(F.zip_with(a, b, same), F.lit(0), lambda acc, x: acc + x)


def similarity(a: Column, b: Column, bins: int = BINS, bits: int = BITS) -> Column:
    """Estimate of the Jaccard similarity of two documents' shingle sets, corrected for bits that agree by chance.

    With shingle sets that are small against the hash range, a share 2**-bits of the differing bins agrees by chance, which is taken
    out; an estimate below 0 becomes 0.  Null if either fingerprint is null.
    """
    chance = 2.0**-bits
    return F.greatest(F.lit(0.0), (matching_bins(a, b, bits) / F.lit(float(bins)) - chance) / (1 - chance))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: doc_id, n_shingles, fingerprint.  Repeated rows give repeated results; other columns are left out."""
    found = docs.select(F.col(id_col).alias("doc_id"), fingerprint(F.col(text_col)).alias("f"))
    return found.select("doc_id", "f.n_shingles", "f.fingerprint")
