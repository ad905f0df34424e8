"""Lookups of addresses in ranges, differences of token sequences, samples of lines."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mailloom.functions.arrow import in_pieces
from mailloom.functions.blocks import blocks
from mailloom.functions.tokens import split_lossless

#: Ranges are found by the blocks of this many addresses that they touch.
_BLOCK = 1 << 16


def ip_number(ip: Column) -> Column:
    """The number of a dotted address; null if it isn't one."""
    parts = F.split(ip, r"\.")
    number = F.aggregate(parts, F.lit(0).cast("bigint"), lambda acc, x: acc * 256 + x.try_cast("bigint"))
    small = F.forall(parts, lambda x: x.try_cast("int") < 256)
    return F.when(ip.rlike(r"^\d{1,3}(\.\d{1,3}){3}$") & small, number)


def in_ranges(rows: DataFrame, number: str, ranges: DataFrame) -> DataFrame:
    """The rows with the columns of the range (low to high, inclusive) that their number is in, or nulls.

    An equi-join on blocks of numbers, so neither side needs to be small; a range is repeated for each block that it touches.
    """
    blocks = F.sequence(F.floor(F.col("low") / _BLOCK), F.floor(F.col("high") / _BLOCK))
    by_block = ranges.withColumn("_block", F.explode(blocks))
    left = rows.withColumn("_b", F.floor(F.col(number) / _BLOCK))
    return left.join(by_block, (F.col("_b") == F.col("_block")) & F.col(number).between(F.col("low"), F.col("high")), "left").drop("_b", "_block")


def grey_address(header: Column) -> Column:
    """The address that a header of greylisting names: what follows its first ip=, up to a parenthesis; null if it names none."""
    return F.when(header.contains("ip="), F.split_part(F.substr(header, F.instr(header, F.lit("ip=")) + 3), F.lit(")"), F.lit(1)))


#: Names of countries that are shortened.
SHORT_NAMES = {"United States of America": "U.S.A.", "United Kingdom of Great Britain and Northern Ireland": "U.K."}


def grey_label(header: Column, continent: Column, country: Column, organisation: Column) -> Column:
    """How a list shows a header of greylisting: continent/country/organisation of its address, if that was found (a continent that isn't
    null), else the address, else the header's first word; ??? without a header."""
    short = country
    for long, brief in SHORT_NAMES.items():
        short = F.when(country == long, brief).otherwise(short)
    place = F.when(continent.isNotNull(), F.concat(continent, F.lit("/"), F.coalesce(short, F.lit("")), F.lit("/"), F.coalesce(organisation, F.lit(""))))
    return F.when(header.isNull(), "???").otherwise(F.coalesce(place, grey_address(header), F.split_part(F.trim(header), F.lit(" "), F.lit(1))))


def differences(before: Column, after: Column) -> Column:
    """The runs of tokens that two texts share or not: an array of op (equal, insert, delete), and text; null if either is."""
    kind = pa.list_(pa.struct([("op", pa.string()), ("text", pa.string())]))

    def one(a: str, b: str) -> list[dict[str, str]]:
        x, y = split_lossless(a), split_lossless(b)
        out, i, k = [], 0, 0
        for p, q, size in blocks(x, y):
            out += [{"op": o, "text": t} for o, t in (("delete", "".join(x[i:p])), ("insert", "".join(y[k:q]))) if t]
            i, k = p + size, q + size
            if size:
                out.append({"op": "equal", "text": "".join(x[p:i])})
        return out

    def run(a: list[str | None], b: list[str | None]) -> list[list[dict[str, str]] | None]:
        return [None if x is None or y is None else one(x, y) for x, y in zip(a, b)]

    return in_pieces(run, "array<struct<op: string, text: string>>", kind, before, after)


def mixed_lines(parts: list[DataFrame], share: float, least: int = 200, most: int = 10_000, text_col: str = "value", seed: int = 0) -> DataFrame:
    """A sample of the long lines of several sources, shuffled: each line of more than `least` bytes with a chance of `share`, cut to `most` characters."""
    rows = parts[0].select(text_col)
    for p in parts[1:]:
        rows = rows.unionByName(p.select(text_col))
    drawn = rows.where(F.octet_length(text_col) > least).sample(share, seed)
    return drawn.select(F.substring(text_col, 1, most).alias(text_col)).orderBy(F.rand(seed))
