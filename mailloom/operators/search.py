"""Search and selection over messages: a small language of predicates, flags, and the algebra of selections."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mailloom.functions import text as T

#: Bits of a message's flags.
SELECTED, DUP, READ, NEW, DELETED, EXTRA, LISTED = 1, 2, 4, 8, 32, 64, 128

_COMPARE = {"<": "__lt__", "<=": "__le__", "=": "__eq__", ">=": "__ge__", ">": "__gt__"}


def numbers(text: Column) -> dict[str, Column]:
    """The quantities of a text by the letters that name them."""
    line = F.coalesce(text, F.lit(""))
    return {"w": T.blank_count(line), "l": T.count_of(line, T.LATIN), "L": T.count_of(line, T.BEYOND_TEXT), "j": T.count_of(line, T.CJK)}


def vocabulary_count(text: Column, words: list[str]) -> Column:
    """How many of a text's words are in a vocabulary (the quantity v)."""
    return F.size(F.filter(T.words(F.lower(F.coalesce(text, F.lit("")))), lambda t: t.isin(words) if words else F.lit(False))).cast("bigint")


def group_size(pointer: Column, size: Column) -> Column:
    """The quantity h: minus the size of its group for a base, the size of the group for a duplicate."""
    return F.when(pointer < 0, pointer).otherwise(size)


def predicate(query: str, fields: dict[str, Column], quantities: dict[str, Column]) -> Column:
    """The condition of a query: FIELDS:value (any of the fields, named by letters, contains the value; capitals compare in lower case
    and turn the value so), LETTER, an operator of < <= = >= > and a whole number, or a value alone, which is looked for in the fields S and F.

    An empty query is true; nulls don't match.  Raises ValueError for an unknown letter or operator, or a missing value.
    """
    if not query:
        return F.lit(True)
    letters = re.match(r"[^\W\d_]*", query)[0]
    rest = query[len(letters) :]
    if letters and rest[:1] in ("<", "=", ">"):
        sign = re.match(r"[<=>]+", rest)[0]
        value = rest[len(sign) :].strip()
        if sign not in _COMPARE or letters not in quantities or not re.fullmatch(r"[+-]?\d+", value):
            raise ValueError(f"{query!r} isn't a comparison")
        return F.coalesce(getattr(quantities[letters], _COMPARE[sign])(F.lit(int(value))), F.lit(False))
    if letters and rest[:1] == ":":
        value = rest[1:]
        if letters == letters.upper():
            value = value.lower()
    else:
        letters, value = "SF", query.lower()
    out = F.lit(False)
    for c in letters:
        if c.lower() not in fields:
            raise ValueError(f"{c!r} in {query!r} is no field")
        column = fields[c.lower()]
        out = out | F.coalesce(F.contains(F.lower(column) if c.isupper() else column, F.lit(value)), F.lit(False))
    return out


def visible(flags: Column, pointer: Column | None = None, deleted: int = 0, duplicates: bool = False, selected: int = 0, extra: bool = False, attached: Column | None = None) -> Column:
    """Which messages a list shows.  deleted: 0 hides them, 1 shows all, 2 only them; duplicates: hide those with a base; selected: 0 all,
    1 only them, 2 all but them; extra: only those; attached: a column that must be true."""
    has = lambda bit: flags.bitwiseAND(F.lit(bit)) != 0
    out = F.lit(True)
    if deleted != 1:
        out = out & (has(DELETED) if deleted == 2 else ~has(DELETED))
    if duplicates and pointer is not None:
        out = out & (pointer < 0)
    if selected:
        out = out & (has(SELECTED) if selected == 1 else ~has(SELECTED))
    if extra:
        out = out & has(EXTRA)
    return out if attached is None else out & F.coalesce(attached, F.lit(False))


def combine(flags: Column, shown: Column, how: str, only_selected: bool = False) -> Column:
    """Flags after a selection of the shown rows: + adds them (or keeps only them, where only selected ones are listed), - takes them
    away, * turns them (or clears all)."""
    now = flags.bitwiseAND(F.lit(SELECTED)) != 0
    if how == "+":
        after = now & shown if only_selected else now | shown
    elif how == "-":
        after = now & ~shown
    elif how == "*":
        after = F.lit(False) if only_selected else now != shown
    else:
        raise ValueError(f"{how!r} is no operation")
    return F.when(after, flags.bitwiseOR(F.lit(SELECTED))).otherwise(flags.bitwiseAND(F.lit(~SELECTED)))


def toggled(flags: Column, bit: int) -> Column:
    """Flags with a bit turned."""
    return flags.bitwiseXOR(F.lit(bit))


def marked_deleted(flags: Column, shown: Column) -> Column:
    """Flags with the shown messages marked as deleted; the mailbox isn't touched."""
    return F.when(shown, flags.bitwiseOR(F.lit(DELETED))).otherwise(flags)


def any_set(flags: Column) -> Column:
    """Aggregate: whether any message has a flag."""
    return F.coalesce(F.bool_or(flags != 0), F.lit(False))


def sender(mode: int, addr: Column, name: Column) -> Column:
    """A sender as a list shows it: 0 the address, 1 the name, 2 both."""
    return (addr, name, F.concat(name, F.lit("  <"), addr, F.lit(">")))[mode]


def page(rows: DataFrame, start: int, count: int, order: str = "doc_id") -> DataFrame:
    """A page of a list."""
    return rows.orderBy(order).offset(start).limit(count)


def following(rows: DataFrame, after: int, order: str = "doc_id") -> DataFrame:
    """The next row after a place, or none."""
    return rows.where(F.col(order) > after).orderBy(order).limit(1)


def preceding(rows: DataFrame, before: int, order: str = "doc_id") -> DataFrame:
    """The last row before a place, or none."""
    return rows.where(F.col(order) < before).orderBy(F.desc(order)).limit(1)


def at_line(rows: DataFrame, number: int, order: str = "doc_id") -> DataFrame:
    """The row of a number, or none."""
    return rows.where(F.col(order) == number)
