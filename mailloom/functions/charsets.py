"""Character sets of mails: what their labels mean, and what stands for bytes that aren't of a text's set."""

from __future__ import annotations

import codecs
import re
from functools import lru_cache

#: ISO 8859's parts by the numbers and names that labels have for them.
_LATIN = {1: 1, 2: 2, 3: 3, 4: 4, 5: 9, 6: 10, 9: 15}
_REGISTERED = {100: 1, 101: 2, 109: 3, 110: 4, 126: 7, 127: 6, 138: 8, 144: 5, 148: 9, 157: 10}
_SCRIPTS = {"arabic": 6, "cyrillic": 5, "greek": 7, "greek8": 7, "hebrew": 8, "visual": 8, "asmo-708": 6, "elot-928": 7, "sun-eu-greek": 7, "ecma-114": 6, "ecma-118": 7, "tis-620": 11, "windows-874": 11, "dos-874": 11, "iso-88-2": 2}
#: Parts for which a Windows code page stands that has more characters.
_PAGES = {1: "cp1252", 9: "cp1254"}
_FAMILIES = (
    (re.compile(r"us-ascii|ascii|ansi.*|(?:cp|ibm)819|user-defined"), "cp1252"),
    (re.compile(r"(?:unicode-1-1-)?utf-?8"), "utf-8"),
    (re.compile(r"utf-16"), "utf-16-le"),
    (re.compile(r"(?:cs)?(?:cp|ibm)?-?866"), "cp866"),
    (re.compile(r"(?:cs)?koi8?(?:-?r)?"), "koi8-r"),
    (re.compile(r"(?:cs)?mac(?:-roman|intosh)?"), "mac-roman"),
    (re.compile(r"mac-(?:cyrillic|ukrainian)"), "mac-cyrillic"),
    (re.compile(r"mac-ce"), "mac-latin2"),
    (re.compile(r"chinese|(?:cs)?(?:iso58)?gb-?2312(?:-?80)?|iso-ir-58|gbk"), "gbk"),
    (re.compile(r"(?:cn-|cs)?big5(?:-hkscs)?"), "big5"),
    (re.compile(r"euc-jp|cseucpkdfmtjapanese"), "euc-jp"),
    (re.compile(r"(?:cs)?shift-?jis|ms-kanji|sjis|windows-31j"), "shift-jis"),
    (re.compile(r"korean|euc-kr|cseuckr|(?:cs)?ksc?-?c?-?5601(?:-?198[79])?|iso-ir-149|windows-949"), "euc-kr"),
    (re.compile(r"_?(?:cs)?iso-?2022-?jp(?:\$esc)?"), "iso-2022-jp"),
    (re.compile(r"(?:cs)?iso-?2022-?kr"), "iso-2022-kr"),
)
_PART = re.compile(r"(?:cs)?(?:iso-?)?8859-?(\d{1,2})(?:-?[ei])?(?::\d{4})?")
_NUMBERED = re.compile(r"(?:csiso)?(?:latin|l)(\d)")
_WINDOWS = re.compile(r"(?:cp|windows|win)-?(125\d)")


def _part(name: str) -> int | None:
    """The part of ISO 8859 that a label means."""
    if m := _PART.fullmatch(name):
        return int(m[1])
    if m := _NUMBERED.fullmatch(name):
        return _LATIN.get(int(m[1]))
    if m := re.fullmatch(r"iso-ir-(\d+)", name):
        return _REGISTERED.get(int(m[1]))
    return _SCRIPTS.get(name.removeprefix("csisolatin"))


@lru_cache(1 << 10)
def codec(label: str | None) -> str | None:
    """Python's name for a label, or None if it is unknown.

    Case, leading x- and the choice of - or _ don't matter.  Latin-1 and ASCII are read as the Windows page that contains them.
    """
    name = re.sub(r"^(?:x-)+", "", (label or "").strip().lower().replace("_", "-").lstrip("-"))
    if not name:
        return None
    part = _part(name)
    if part:
        name = _PAGES.get(part, f"iso8859-{part}")
    elif m := _WINDOWS.fullmatch(name):
        name = f"cp{m[1]}"
    else:
        name = next((to for pattern, to in _FAMILIES if pattern.fullmatch(name)), name)
    for one in (name, name.replace("cp-", "cp")):
        try:
            return codecs.lookup(one).name
        except (LookupError, ValueError):
            continue
    return None


def _page(byte: int) -> str:
    """What a byte of 0x80 to 0x9f is in the Western page, or, where that has nothing, in the Central European one."""
    for page in ("cp1252", "cp1250"):
        try:
            return bytes([byte]).decode(page)
        except UnicodeDecodeError:
            continue
    return ""


#: Characters that stand for others: bytes of Windows pages, blanks, hyphens without width, and Hungarian letters of the wrong set.
FIXES = {k: _page(k) for k in range(0x80, 0xA0)} | {0: " ", 0xA0: " ", 0xAD: "", 0xD5: "Ő", 0xDB: "Ű", 0xF5: "ő", 0xFB: "ű"}


def _mixed(error: UnicodeError) -> tuple[str, int]:
    """Replace bad bytes by what they are in Windows code pages, or in Latin-1."""
    bad = error.object[error.start : error.end]
    return "".join(FIXES.get(b, chr(b)) for b in bad), error.end


codecs.register_error("mailloom-mixed", _mixed)
