"""Mail messages: headers, encoded words, the tree of parts, and the best text."""

from __future__ import annotations

import re
from binascii import Error as BadBase64
from binascii import a2b_base64, a2b_qp
from dataclasses import dataclass, field

from mailloom.functions.charsets import codec
from mailloom.functions.payload import TNEF_TYPES, decode_body, payload_text
from mailloom.functions.text import SPAM_SCORE, SPAM_TAGS

_ENCODED = re.compile(r"=\?([^?]*?)\?([qQbB])\?(.*?)\?=")
_PARAMETER = re.compile(rb""";[\x00-\x20]*([^;=]*)(?:=[\x00-\x20]*((?:"[^"]*(?:"|\Z)|'[^']*(?:'|\Z)|[^;"'])*))?""")


def decode_header(raw: str | bytes) -> str:
    """A header's text with its encoded words decoded; neighbours of one character set are joined before, and the blanks between them go."""
    text = raw.decode("utf-8", "mailloom-mixed") if isinstance(raw, bytes) else raw
    out: list[tuple[list[bytes], str | None]] = []
    pieces = _ENCODED.split(text)
    for k in range(0, len(pieces), 4):
        if pieces[k] and not pieces[k].isspace():
            out.append(([pieces[k].encode("utf-8", "surrogatepass")], None))
        if k + 3 < len(pieces):
            label, how, coded = pieces[k + 1].lower(), pieces[k + 2].lower(), pieces[k + 3]
            try:
                data = a2b_qp(coded.replace("==", "="), header=True) if how == "q" else a2b_base64(coded + "===")
            except (BadBase64, ValueError):
                continue
            if out and out[-1][1] == label:
                out[-1][0].append(data)
            else:
                out.append(([data], label))
    return "".join(b"".join(d).decode("utf-8" if c is None else codec(c) or "utf-8", "mailloom-mixed") for d, c in out)


_MARK = re.compile(r"[^<>\")\s]*@[-.a-zA-Z0-9]*")
_QUOTED = re.compile(r'"((?:[^"\\]|\\.)*)"\s*<([^>]*)>')


def split_address(header: str) -> tuple[str, str]:
    """Address and name of a header: "name" <address>, name <address>, or address (name); without an address, the whole is the name."""
    if quoted := _QUOTED.fullmatch(header):
        return quoted[2], quoted[1]
    start = header.find("<", header.rfind(">", 0, -1) + 1)
    if header.endswith(">") and start >= 0:
        return header[start + 1 : -1], header[:start].rstrip()
    if found := _MARK.search(header):
        rest = header[found.end() :].lstrip()
        remark = rest[: rest.rfind(")") + 1] if rest.startswith("(") else ""
        return found[0], remark or header[: found.start()]
    return "", header


def decode_address(header: str) -> tuple[str, str]:
    """Address and decoded name.  Where there is no address, as it was encoded along with the name, the decoded name is split again."""
    addr, raw = split_address(header.strip())
    name = decode_header(raw)
    if addr or "@" not in name:
        return addr, name
    return split_address(name.strip())


def untag(text: str) -> str:
    """The same as text.untag() of a string."""
    text = re.sub(SPAM_SCORE, "", text)
    for tag in SPAM_TAGS:
        text = text.replace(tag, "")
    return text


@dataclass
class Part:
    """A node of a message's tree; leaves have a payload."""

    headers: list[tuple[str, bytes]]
    kind: str
    charset: str | None
    encoding: str
    disposition: str | None
    name: str | None
    params: dict[str, str]
    start: int
    end: int
    payload: bytes | None = None
    parts: list[Part] = field(default_factory=list)


def parameters(value: bytes) -> tuple[str, dict[str, str]]:
    """The first word of a header's value, and its parameters by lower-cased name."""
    head = value.partition(b";")[0]
    found = {}
    for m in _PARAMETER.finditer(value, len(head)):
        if m[1].strip():
            raw = re.sub(rb"\"([^\"]*)\"?|'([^']*)'?", lambda x: x[1] if x[1] is not None else x[2], m[2] or b"")
            found[m[1].decode("latin-1").lower()] = raw.rstrip().decode("utf-8", "mailloom-mixed")
    return (head.split() or [b""])[0].decode("ascii", "ignore").lower(), found


def _headers(block: bytes) -> list[tuple[str, bytes]]:
    out: list[tuple[str, bytes]] = []
    for line in block.split(b"\n"):
        line = line.rstrip(b"\r")
        if line[:1] in (b" ", b"\t"):
            if out:
                out[-1] = (out[-1][0], out[-1][1] + line)
        elif not line:
            break
        else:
            name, _, value = line.partition(b":")
            out.append((name.decode("latin-1").lower(), value))
    return out


def parse(data: bytes, start: int = 0, end: int | None = None, depth: int = 0) -> Part:
    """The tree of a message's parts; nesting deeper than 50 isn't followed."""
    end = len(data) if end is None else end
    gap = re.compile(rb"\n\n|\r\n\r\n").search(data, start, end)
    body = gap.end() if gap else end
    headers = _headers(data[start:body])
    first = {}
    params: dict[str, str] = {}
    for name, value in headers:
        if name in ("content-type", "content-disposition", "content-transfer-encoding"):
            first[name], more = parameters(value)
            params |= more
    kind, label = first.get("content-type", ""), params.get("filename", params.get("name"))
    part = Part(headers, kind or "text/plain", params["charset"].lower() if "charset" in params else None, first.get("content-transfer-encoding", ""), first.get("content-disposition"), decode_header(label) if label is not None else None, params, start, end)
    if params.get("boundary") and kind.startswith("multipart/") and depth < 50:
        part.parts = [parse(data, a, b, depth + 1) for a, b in _slices(data, body, end, b"--" + params["boundary"].encode("utf-8"))]
    elif kind.startswith("message/") and depth < 50:
        part.parts = [parse(data, body, end, depth + 1)]
    else:
        part.payload = decode_body(data[body:end], part.encoding)
    return part


def _slices(data: bytes, start: int, end: int, mark: bytes) -> list[tuple[int, int]]:
    """Where the parts between boundaries begin and end."""
    out, at, first, look = [], start, True, start
    while True:
        hit = data.find(mark, look, end)
        stop, after = (end, end) if hit < 0 else (hit, hit + len(mark))
        if hit >= 0:
            if data[stop - 1 : stop] == b"\n":
                stop -= 2 if data[stop - 2 : stop - 1] == b"\r" else 1
            if data[after : after + 2] == b"--":
                after += 2
            if not (after >= end or data[after] <= 32 or data.startswith(b"Content-", after)):
                look = after
                continue
        block = data[at:stop]
        if len(block.strip()) > 2:
            if first and b"Content-Type:" in block:
                at, first = at + block.find(b"Content-"), False
            low = block.lower()
            notice = b"MIME" in block or b"multipart message" in low or b" mime format" in low
            if not first or len(block) >= 300 or not notice:
                out.append((at, stop))
        if hit < 0 or after >= end:
            return out
        while after < end and data[after] <= 32 and data[after] != 10:
            after += 1
        at = look = after + 1 if data[after : after + 1] == b"\n" else after
        first = False


def leaves(part: Part, path: tuple[int, ...] = ()) -> list[tuple[tuple[int, ...], Part]]:
    """The leaves of a tree in the order of the message, with their places."""
    if not part.parts:
        return [(path, part)]
    return [x for k, p in enumerate(part.parts) for x in leaves(p, (*path, k))]


def best_text(part: Part) -> tuple[str | None, str]:
    """Subject (the last one, decoded, without filters' marks) and the text of the part that reads best."""
    subject, text = None, ""
    for name, value in part.headers:
        if name == "subject":
            subject = untag(decode_header(value))
    for _, leaf in leaves(part):
        if not (leaf.kind.startswith("text/") and leaf.disposition != "attachment" or leaf.kind in ("application/ics", "application/rtf", *TNEF_TYPES)):
            continue
        new = payload_text(leaf.payload or b"", leaf.kind, leaf.charset)
        rich = leaf.kind == "text/html"
        if not text or rich and len(new) > 20 or len(new) > len(text) // 2 or text.startswith("Spam detection software,"):
            text = new
        if rich and len(text) > 200:
            break
    return subject, text
