"""Readable text of HTML by a scanner over bytes: comments, quoted attributes, skipped blocks and hidden text."""

from __future__ import annotations

import re

_VOID = {"br", "area", "base", "meta", "col", "embed", "hr", "img", "input", "link", "param", "source", "track", "wbr"}
_SKIPPED = {"style", "script", "title", "svg", "annotation"}
_INLINE = {"span", "a", "b", "i", "u", "em", "strong", "abbr", "font"}
_HIDDEN = (b"display:none", b"font-size:0p", b"font-size:1p", b"max-height:0p", b"mso-hide:all", b"opacity:0")
#: The rest of a tag after "<": quotes count only behind an equals sign.
_REST = re.compile(rb"""(?:[^=>]|=[\x00-\x20]*(?:"[^"]*(?:"|\Z)|'[^']*(?:'|\Z)|(?=[^"'])|\Z))*(?:>|\Z)""", re.S)
_NEXT = re.compile(rb"<(?=[A-Za-z/!?])")
_NAME = re.compile(rb"[\x00-\x20]*(/?)[\x00-\x20/]*([a-z]*)")
_META = re.compile(rb"<meta[^>]*?charset=[\x00-\x20\"']*([-_0-9a-z]+)", re.I)
_LINE = b"<BR>"


def declared_charset(head: bytes, otherwise: str | None = None) -> str | None:
    """The character set that a meta tag declares."""
    found = _META.search(head)
    return found[1].decode().lower() if found else otherwise


def _kind(tag: bytes) -> tuple[int, str]:
    """-1 for an end tag, 0 for a void one, 1 for a start tag; and its name."""
    if tag[:1] in (b"!", b"?"):
        return 0, tag[:1].decode()
    slash, name = _NAME.match(tag).groups()
    name = name.decode()
    if name in _VOID:
        return 0, name
    return (-1 if slash else 0 if tag.endswith(b"/") else 1), name


def _block_end(data: bytes, at: int, name: str) -> int:
    """Where the end tag of a skipped block begins, past sections of CDATA; the end of the data if there is none."""
    look = re.compile(rb"</" + name.encode() + rb"|<!\[CDATA\[", re.I)
    while m := look.search(data, at):
        if m[0][:3] != b"<![":
            return m.start() if m.start() + 2 < len(data) else len(data)
        close = data.find(b"]]>", m.end())
        at = close if close > 0 else m.end()
    return len(data)


def html_text(data: bytes) -> bytes:
    """The text of HTML, a line for each break; data without "<" is returned as it is.

    Text right behind a tag that hides it is left out, but before any visible text, what isn't displayed is kept in brackets.
    """
    p = data.find(b"<")
    if p < 0:
        return data
    out, seen = [data[:p]], 0
    while p < len(data):
        close = data.find(b"-->", p) if data.startswith(b"<!--", p) else -1
        if close >= 0:
            end = _REST.match(data, close).end()
        else:
            end = _REST.match(data, p + 1).end()
        tag = data[p + 1 : end - 1].lower()
        kind, name = _kind(tag)
        if kind > 0 and name in _SKIPPED:
            p = _block_end(data, end, name)
            continue
        found = _NEXT.search(data, end)
        p = found.start() if found and found.start() + 2 < len(data) else len(data)
        text = data[end:p]
        if b"style" in tag:
            tag = tag.replace(b": ", b":")
            if any(h in tag for h in _HIDDEN):
                if b"signedadaptivecard" not in tag and b"display:none" in tag and not seen and len(text.strip()) >= 3:
                    out.append(b"[" + text + b"] ")
                continue
        if tag == b"div" or (kind >= 0 and name in ("p", "br", "tr")):
            out.append(_LINE)
        elif name not in _INLINE:
            out.append(b" ")
        out.append(text)
        seen += len(text.strip())
    flat = b" ".join(b"".join(out).split())
    return b"\n".join(line.strip() for line in flat.split(_LINE))
