"""Tokenizers and normalizers that need Python: lossless splits, the digit-hiding tokenizer, look-alike letters, display width."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

from mailloom.functions.text import INVISIBLE, SCRUB_OLD

#: Cyrillic letters that look like Latin ones.
LOOK_ALIKE = str.maketrans("ЅІЈАВЕКМНОРСТХаеорсухѕіј", "SIJABEKMHOPCTXaeopcyxsij")


def _numeric() -> Iterator[tuple[int, int]]:
    """The ranges of numeric characters."""
    first = None
    for c in range(0x110001):
        if c < 0x110000 and chr(c).isnumeric():
            first = c if first is None else first
        elif first is not None:
            yield first, c - 1
            first = None


#: A run of letters and digits, in which a digit keeps one following mark.
_WORDS = re.compile(rf"([^\W_]+(?:[:/.-](?<=[{''.join(f'{chr(a)}-{chr(b)}' for a, b in _numeric())}][:/.-])[^\W_]*)*)")


def split_lossless(text: str) -> list[str]:
    """Separators and words by turns, a separator first (empty if the text begins with a word); together they are the text."""
    out = _WORDS.split(text)
    return out if len(out) == 1 or out[-1] else out[:-1]


@lru_cache(1 << 16)
def plain(c: str) -> str:
    """The ASCII form of a character, if it has one."""
    if c < "\x80":
        return c
    c = {"×": "x", "Ø": "O", "ø": "o", "ß": "ss"}.get(c, c)
    found = unicodedata.normalize("NFKD", c).encode("ascii", "ignore").decode()
    return "" if found == "()" else found


def without_accents(text: str, table: dict[str, str] | None = None) -> str:
    """The text in ASCII: other characters by a table of look-alikes, if there is one, else by their ASCII forms; those without one go."""
    return "".join(c if c < "\x80" else plain(c) if table is None else table.get(c, "") for c in text)


def hide_digits(text: str, vocabulary: set[str] | None = None, table: dict[str, str] | None = None) -> list[str]:
    """Tokens of letters a to z, of digits (each as #) and of the marks ! ; and . once each; those of the vocabulary, if there is one."""
    for pattern, mark in SCRUB_OLD:
        text = re.sub(pattern, mark, text, flags=re.A)
    text = without_accents(text, table).lower()
    text = re.sub(r"([!;.])\1+", r"\1", text)
    text = re.sub(r"(?<=[a-z!;._-])(?=[0-9])|(?<=[0-9])(?=[a-z])", " ", text)
    text = re.sub(r"[0-9]", "#", text)
    text = re.sub(r"([!;.])", r" \1 ", text).replace("-", "").replace("_", "")
    found = re.findall(r"[a-z#]+|[!;.]", text)
    return [t for t in found if vocabulary is None or t in vocabulary]


def normalize(text: str, charmap: dict[str, str] | None = None, unmapped: str = "") -> str:
    """Look-alikes as Latin letters, compatibility forms composed, invisible characters gone, characters mapped (others become `unmapped`), white space collapsed."""
    text = unicodedata.normalize("NFKC", text.translate(LOOK_ALIKE))
    text = "".join("" if c in INVISIBLE else c if charmap is None or c.isspace() else charmap.get(c, unmapped) for c in text)
    return " ".join(text.split())


def join_pair(subject: str | None, body: str | None) -> str:
    """A subject and a body as the one text that is scored."""
    return f"{subject or ''}|\n{body or ''}"


def corpus_text(text: str, charmap: dict[str, str]) -> str:
    """A line of a corpus of vectors: as normalize(), but look-alikes are replaced only where a character from U+0400 on is in the text, and
    characters that aren't mapped become blanks."""
    if max(text, default="") < "\u0400":
        text = unicodedata.normalize("NFKC", text)
        return " ".join("".join("" if c in INVISIBLE else c if c.isspace() else charmap.get(c, " ") for c in text).split())
    return normalize(text, charmap, " ")


def char_width(c: str) -> int:
    """Columns that a character takes: 0 if invisible, 2 if wide, -1 for a control character."""
    if c in INVISIBLE:
        return 0
    if unicodedata.category(c) == "Cc":
        return -1
    return 2 if unicodedata.east_asian_width(c) in "WF" else 1


def fit_width(text: str) -> str:
    """The text for a terminal: invisible characters and pictures go, wide ones get a zero-width space, enclosed letters become plain."""
    out = []
    for c in text:
        n = ord(c)
        if c in INVISIBLE or n >= 0xE0000:
            continue
        if n >= 0x1100 and char_width(c) == 2:
            out.append(c + "\u200b")
        elif 0x1F000 <= n < 0x20000:
            k = (n - 0x1F110) & 31
            out.append(chr(65 + k) if 0x1F110 <= n < 0x1F190 and k < 26 else "")
        else:
            out.append(c)
    return "".join(out)
