"""Secret scans: assignments of source and configuration texts, with constants propagated and targets scored by name."""

from __future__ import annotations

import math
import re
from array import array
from bisect import bisect_left
from collections import Counter
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A finding's score is its name's weight times its literal's quality; findings from this on are reported.
LEAST_SCORE = 0.3
#: Brackets in brackets of an expression that are looked into; what lies deeper has no constant value.
DEEPEST = 40

_TOKEN = re.compile(
    r"""(?P<space>[ \t\r\f\v]+|\\\r?\n)|(?P<newline>\n)
    |(?P<comment>/\*.*?(?:\*/|\Z)|<!--.*?(?:-->|\Z)|(?<![^\s;])\#[^\n]*|(?<![^\s;{}(),])//[^\n]*)
    |(?P<string>(?<!\w)[rRbBfFuUL@]{0,2}(?:\"\"\"(?:\\.|[^\\])*?\"\"\"|\'\'\'(?:\\.|[^\\])*?\'\'\'|"(?:\\.|[^"\\\n])*"|'(?:\\.|[^'\\\n])*')|`[^`]*`)
    |(?P<name>[A-Za-z_$@][\w$]*(?:(?:[.\-]|::|->)[\w$]+)*)
    |(?P<op>===|!==|==|!=|<=|>=|=>|->|:=|\?\?=?|\|\|=?|&&|\+=|\+\+|=~|::)
    |(?P<other>.)""",
    re.X | re.S,
)
_KINDS = {"newline": 1, "string": 2, "name": 3, "op": 4, "other": 5}
NEWLINE, STRING, NAME = 1, 2, 3
_QUOTES = re.compile(r"""[rRbBfFuUL@]{0,2}(\"\"\"|\'\'\'|"|'|`)""")
_ELEMENT = re.compile(r"<(?P<name>[A-Za-z_][\w.\-]*)>(?P<value>[^<>\n]+)</(?P=name)>")
_BARE = re.compile(r"""[^\s"'`,;(){}\[\]<>]+""")
_INSERT = re.compile(r"\$\{\s*([A-Za-z_][\w.]*)\s*\}|\{\s*([A-Za-z_][\w.]*)\s*\}|\$([A-Za-z_]\w*)|%\(([A-Za-z_]\w*)\)s")
_WORD = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+")
_ASSIGN = {"=", ":", ":=", "=>", "??=", "||="}
_TYPE = re.compile(r"[\w$.<>\[\]|?, \t]*=(?![=~>])")
_NOTHING = {"none", "null", "nil", "undefined", "true", "false", "nan", "void", "new", "await", "not", "lambda", "function", "return"}
_DEFAULTS = {"get", "getenv", "env", "environ", "getproperty", "getordefault", "default", "fetch", "config", "coalesce", "ifnull", "nvl", "pop", "setdefault"}
_SCHEMES = {"bearer", "basic", "token", "apikey", "digest"}
_LEADS = {"export", "set", "env", "declare", "readonly", "local", "setx"}
_BLOCKS = {"if", "for", "while", "switch", "catch", "elif", "with", "foreach", "until", "unless"}
_STOP = {"the", "a", "an", "your", "you", "must", "be", "is", "are", "to", "of", "for", "and", "or", "with", "in", "on", "at", "please", "enter", "not", "this", "that", "has", "have", "it", "as", "by", "from", "we", "our", "can", "cannot", "should", "will"}

_ALONE = {"password": 1.0, "passwd": 1.0, "pwd": 1.0, "passphrase": 1.0, "passcode": 0.9, "pass": 0.8, "secret": 1.0, "secrets": 0.9, "token": 0.9, "apikey": 1.0, "credential": 0.9, "credentials": 0.9, "bearer": 0.9, "jwt": 0.9, "authorization": 0.8, "auth": 0.6, "accesskey": 1.0, "privatekey": 1.0, "authtoken": 1.0, "secretkey": 1.0}
_KEYS = {"api", "access", "private", "secret", "signing", "encryption", "master", "account", "shared", "service", "license", "ssh", "storage", "client", "app", "session", "cipher", "hmac", "webhook"}
_OTHER_USE = {"count", "counts", "length", "len", "size", "hint", "field", "label", "prompt", "url", "uri", "path", "file", "filename", "name", "type", "id", "index", "policy", "min", "max", "limit", "expiry", "expires", "ttl", "placeholder", "regex", "pattern", "format", "help", "message", "error", "public"}
_PLACEHOLDER = re.compile(r"(?i)^[<\[{(%]*(?:(?:(?:my|your|insert|enter|some|a|the|dummy|sample|example|test|fake|default)[-_ ]*)*(?:change[-_ ]?(?:me|it|this)|example|placeholder|dummy|redacted|sample|password|passwd|pass|secret|token|key|api[-_ ]?key|string|value|required|optional|testing|test|none|null|nil|true|false|undefined|todo|tbd|here|goes)(?:[-_ ]*(?:here|goes|value|example|key|secret|token|password|\d{1,3}))*|x{4,}|\*{3,}|\.{3,}|0+|1234(?:5(?:6(?:7(?:8(?:90?)?)?)?)?)?)[>\]})%]*$")


#: Every sensitive name has one of these in it.
_SENSITIVE = "(?i)pass|pwd|secret|token|key|credential|bearer|jwt|auth"


@dataclass(frozen=True)
class Value:
    """A constant's text and the spans of the document's literals that it is made of."""

    text: str
    spans: tuple[tuple[int, int], ...]


def name_weight(name: str) -> float:
    """How sensitive a target's name is, from 0 to 1."""
    parts = [w.lower() for w in _WORD.findall(name)]
    if not parts:
        return 0.0
    weight = max((_ALONE.get(p, 0.0) for p in parts), default=0.0)
    if parts[-1] in ("key", "keys") or "key" in parts:
        weight = max([weight, *(0.9 for p in parts if p in _KEYS), 0.4])
    for a, b in zip(parts, parts[1:]):
        weight = max(weight, _ALONE.get(a + b, 0.0))
    if parts[-1] in _OTHER_USE or parts[0] in ("max", "min", "num", "public"):
        weight *= 0.2
    return weight


def literal_quality(text: str) -> float:
    """How much a literal looks like a secret, from 0 to 1: its entropy in bits over 60; half if it is letters and blanks alone.

    Fewer than 6 characters, placeholders (the whole literal) and sentences have none: more than three words that begin with a capital, end
    with a stop, or have one of the words that sentences are made with.  A passphrase has none of these.
    """
    n = len(text)
    if n < 6 or _PLACEHOLDER.match(text):
        return 0.0
    words = text.split()
    if len(words) > 3 and (text[:1].isupper() or text.rstrip()[-1:] in ".!?:" or any(w.lower().strip(",.;:!?") in _STOP for w in words)):
        return 0.0
    entropy = -sum(c / n * math.log2(c / n) for c in Counter(text).values())
    quality = min(1.0, entropy * n / 60)
    return quality * 0.5 if text.replace(" ", "").isalpha() else quality


class Scanner:
    """The tokens of a text, and a parser of the assignments among them.

    Tokens are strings, names, operators, other characters and line ends; comments are apart.  Constants are known in the scope that they
    are assigned in (a function by its braces or its indentation) and in those within it; a later value that isn't constant clears them.
    """

    def __init__(self, text: str) -> None:
        self.text, self.kind, self.start, self.end = text, bytearray(), array("q"), array("q")
        self.comments: list[tuple[int, int]] = []
        for m in _TOKEN.finditer(text):
            kind = m.lastgroup
            if kind == "comment":
                self.comments.append(m.span())
            elif kind != "space":
                self.kind.append(_KINDS[kind])
                self.start.append(m.start())
                self.end.append(m.end())
        self.scopes: list[tuple[int, dict[str, Value | None]]] = [(-1, {})]
        self.depth = 0
        #: For each bracket its other one; the end for one that isn't closed, and -1 for one that wasn't opened.
        self.other: dict[int, int] = {}
        open_ones: list[int] = []
        for i in range(len(self.kind)):
            if self.kind[i] == 5 and (c := text[self.start[i]]) in "()[]{}":
                if c in "([{":
                    open_ones.append(i)
                    self.other[i] = len(self.kind)
                elif open_ones:
                    self.other[i] = open_ones.pop()
                    self.other[self.other[i]] = i
                else:
                    self.other[i] = -1

    def token(self, i: int) -> str:
        return self.text[self.start[i] : self.end[i]] if i < len(self.kind) else ""

    def is_kind(self, i: int, kind: int) -> bool:
        return i < len(self.kind) and self.kind[i] == kind

    def known(self, name: str) -> Value | None:
        name = name.removeprefix("self.").removeprefix("this.")
        return next((names[name] for _, names in reversed(self.scopes) if name in names), None)

    def inner(self, i: int) -> tuple[int, int]:
        """Where the text of a string token begins and ends."""
        quote = _QUOTES.match(self.text, self.start[i])
        return quote.end(), self.end[i] - len(quote[1])

    def filled(self, a: int, b: int) -> Value | None:
        """A string's value: names in it that are known constants are replaced; another inserted name leaves no value."""
        text, spans, out, at = self.text[a:b], [(a, b)] if b > a else [], [], 0
        for m in _INSERT.finditer(text):
            value = self.known(next(g for g in m.groups() if g))
            if value is None:
                if m.group(1) or m.group(4):
                    return None
                continue
            out += [text[at : m.start()], value.text]
            spans += value.spans
            at = m.end()
        return Value("".join([*out, text[at:]]), tuple(spans))

    def bare(self, i: int, plain: bool) -> tuple[Value | None, int]:
        """The unquoted literal that begins with a token, and the token after it; letters alone are a literal only in plain configuration."""
        m = _BARE.match(self.text, self.start[i])
        if not m:
            return None, i + 1
        raw = m.group().rstrip(".:")
        if raw.lower() in _SCHEMES and (more := re.compile(r"[ \t]+([^\s\"'`,;]+)").match(self.text, m.start() + len(raw))):
            return Value(more[1], (more.span(1),)), bisect_left(self.start, more.end(), i)
        if re.match(r"[A-Za-z_$][\w$.\-]*=[^=]", raw):
            return None, i + 1  # an assignment itself
        after = max(i + 1, bisect_left(self.start, m.start() + len(raw), i))
        if raw.startswith("$"):
            value = self.filled(m.start(), m.start() + len(raw))
            return (value if value and value.text != raw else None), after
        ends = after >= len(self.kind) or self.kind[after] == NEWLINE
        if not raw or re.fullmatch(r"[A-Za-z_$][\w$]*(?:\.[A-Za-z_$][\w$]*)*", raw) and not any(c.isdigit() for c in raw) and not (plain and ends):
            return None, after
        return Value(raw, ((m.start(), m.start() + len(raw)),)), after

    def group_end(self, i: int) -> int:
        """The token after the one that closes the bracket at a token."""
        return min(self.other.get(i, i) + 1, len(self.kind))

    def operand(self, i: int, plain: bool) -> tuple[list[Value], int]:
        """The values that an operand may have (none if it isn't constant), and the token after it."""
        t = self.token(i)
        if self.is_kind(i, STRING):
            value = self.filled(*self.inner(i))
            return ([value] if value else []), i + 1
        if t == "(":
            found = self.expression(i + 1, False, True)[0] if self.depth < DEEPEST else []
            return found, self.group_end(i)
        if self.is_kind(i, NAME):
            value = self.known(t)
            if self.token(i + 1) == "(":
                end, found, j, args = self.group_end(i + 1), [], i + 2, 0
                if re.split(r"\W+", t.lower())[-1] in _DEFAULTS and self.depth < DEEPEST:
                    while j < end - 1:
                        found, j = self.expression(j, False, True)
                        args += 1
                        while j < end - 1 and self.token(j) != ",":
                            j += 1
                        j += 1
                return (found if args > 1 else []), end
            if self.token(i + 1) == "[" and self.start[i + 1] == self.end[i]:
                return [], self.group_end(i + 1)
            if value is not None:
                return [value], i + 1
            if t.lower() in _NOTHING:
                return [], i + 1
        elif t in ("[", "{", ")", "]", "}", ",", ";", ""):
            return [], i
        value, j = self.bare(i, plain)
        return ([value] if value else []), j

    def expression(self, i: int, plain: bool, wrapped: bool) -> tuple[list[Value], int]:
        """The values that an expression may have, and the token after it; wrapped: in brackets, where lines don't end it."""
        self.depth += 1
        try:
            return self._expression(i, plain, wrapped)
        finally:
            self.depth -= 1

    def _expression(self, i: int, plain: bool, wrapped: bool) -> tuple[list[Value], int]:
        found: list[Value] = []
        parts: list[Value] | None = []
        while i < len(self.kind):
            while wrapped and self.is_kind(i, NEWLINE):
                i += 1
            if self.is_kind(i, NEWLINE):
                break
            begun = i
            values, i = self.operand(i, plain and not parts)
            if i == begun:
                parts = None
                break
            # Of several values only one is carried on to what is joined to it; the others stand alone.
            found += values[1:]
            parts = [*parts, values[0]] if parts is not None and values else None
            j = i
            while self.is_kind(j, NEWLINE) and (wrapped or self.token(j + 1) in ("+", "||", "??")):
                j += 1
            t = self.token(j)
            quoted = self.is_kind(begun, STRING)
            if t == "+" or (t == "." and quoted) or (self.is_kind(j, STRING) and quoted):
                i = j + (not self.is_kind(j, STRING))
                while self.is_kind(i, NEWLINE):
                    i += 1
            elif t in ("or", "||", "??"):
                found += self.joined(parts)
                parts, i = [], j + 1
            elif t == "?":
                found, parts, i = [], [], j + 1
            elif t == ":" and self.token(begun - 1) == "?":
                found += self.joined(parts)
                parts, i = [], j + 1
            elif t == "if":
                while j < len(self.kind) and not self.is_kind(j, NEWLINE) and self.token(j) != "else":
                    j += 1
                if self.token(j) != "else":
                    break
                found += self.joined(parts)
                parts, i = [], j + 1
            else:
                break
        return [*found, *self.joined(parts)], i

    @staticmethod
    def joined(parts: list[Value] | None) -> list[Value]:
        return [Value("".join(p.text for p in parts), tuple(s for p in parts for s in p.spans))] if parts else []

    def target(self, i: int) -> tuple[str, int, int] | None:
        """Name, operator's token and the token after it of an assignment whose target begins at a token."""
        name, j = self.token(i), i + 1
        if self.kind[i] == STRING:
            a, b = self.inner(i)
            name = self.text[a:b]
            if not name.strip() or "\n" in name:
                return None
        while self.token(j) == "[" and self.start[j] == self.end[j - 1] and self.is_kind(j + 1, STRING) and self.token(j + 2) == "]":
            a, b = self.inner(j + 1)
            name, j = f"{name}.{self.text[a:b]}", j + 3
        k = j
        while self.is_kind(k, NEWLINE) and self.token(k + 1) in (":", "=>", "="):
            k += 1
        op = self.token(k)
        if op == ":" and self.kind[i] == NAME and (typed := _TYPE.match(self.text, self.end[k])):
            after = bisect_left(self.start, typed.end() - 1, k)
            if self.token(after) == "=":
                return name, after, after + 1
        return (name, k, k + 1) if op in _ASSIGN and not (op == ":" and self.text.startswith("//", self.end[k])) else None

    def pairs(self) -> list[tuple[str, list[Value], int]]:
        """Name, constant values and place of each assignment, in order."""
        out: list[tuple[str, list[Value], int]] = []
        key, i, first, line, braces = "", 0, True, 0, []
        while i < len(self.kind):
            kind, t = self.kind[i], self.token(i)
            if kind == NEWLINE:
                first, line, i = True, self.end[i], i + 1
                continue
            column = self.start[i] - line
            if first:
                while self.scopes[-1][0] >= 0 and column <= self.scopes[-1][0]:
                    self.scopes.pop()
            lead, first = first, False
            if lead and (t.lower() in _LEADS or t == "-"):
                first, i = True, i + 1
                continue
            if lead and t in ("def", "class", "async") and not braces:
                self.scopes.append((column, {}))
            if t == "{" and kind == 5:
                braces.append(self.opens_scope(i))
                if braces[-1]:
                    self.scopes.append((-1, {}))
            elif t == "}" and kind == 5 and braces and braces.pop():
                while len(self.scopes) > 1 and self.scopes.pop()[0] >= 0:
                    pass
            found = self.target(i) if kind in (STRING, NAME) else None
            if not found:
                i += 1
                continue
            name, op, after = found
            close = self.start[op] == self.end[op - 1] and (after >= len(self.kind) or self.start[after] == self.end[op])
            plain = lead and not braces and (self.token(op) == ":" or (close and (column == 0 or t.isupper() or self.token(i - 1).lower() in _LEADS)))
            values, end = self.expression(after, plain, False)
            short = name.removeprefix("self.").removeprefix("this.")
            self.scopes[-1][1][short] = values[-1] if len(values) == 1 else None
            if values:
                if name in ("value", "Value") and key:
                    name, key = key, ""
                elif name in ("key", "name"):
                    key = values[0].text
                out.append((name, values, self.start[i]))
                i = max(after, end)
            else:
                # What follows the operator may be a target itself.
                i = after
        return out

    def opens_scope(self, i: int) -> bool:
        """Whether a brace begins the body of a function."""
        before = self.token(i - 1) if i else ""
        if before == "=>":
            return True
        if before != ")":
            return False
        j = self.other.get(i - 1, -1)
        return not (j > 0 and self.token(j - 1) in _BLOCKS)


def pairs(text: str, shift: int = 0) -> list[tuple[str, Value, int]]:
    """Name, constant value and place of each assignment of a text, in its order; an assignment has a pair for each value that it may have.

    Comments are read as texts of their own, whose names are known in them alone.
    """
    scanner = Scanner(text)
    out = [(name, Value(v.text, tuple((a + shift, b + shift) for a, b in v.spans)), at + shift) for name, values, at in scanner.pairs() for v in values]
    for a, b in scanner.comments:
        inner = re.match(r"/\*|<!--|\#+|//+", text[a:b]).end()
        out += pairs(text[a + inner : b], shift + a + inner)
    for m in _ELEMENT.finditer(text) if not shift else ():
        out.append((m.group("name"), Value(m.group("value"), (m.span("value"),)), m.start()))
    return sorted(out, key=lambda x: x[2])


def findings(text: str) -> list[tuple[str, int, int, int, float]]:
    """Name, line (from 1), start and length in characters, and score of each literal that is assigned to a sensitive name.

    A literal that several names get is reported once, with the best score (then the first name).
    """
    best: dict[tuple[int, int], tuple[float, int, str]] = {}
    for name, value, at in pairs(text):
        score = round(name_weight(name) * literal_quality(value.text), 4)
        if score >= LEAST_SCORE:
            for span in value.spans:
                if span not in best or best[span][0] < score:
                    best[span] = (score, at, name)
    return [(name, text.count("\n", 0, a) + 1, a, b - a, score) for (a, b), (score, _, name) in sorted(best.items())]


def may_assign(text: Column) -> Column:
    """Whether a text has a character without which it has no assignment, and a word without which no name is sensitive; no other text has findings."""
    return (text.contains("=") | text.contains(":") | text.contains("</")) & text.rlike(_SENSITIVE)


def scan(text: Column) -> Column:
    """The findings of a text as an array of structs (name, line, start, length, score); null for a null text."""

    @F.arrow_udf("array<struct<name: string, line: bigint, start: bigint, length: bigint, score: double>>")
    def run(column: pa.Array) -> pa.Array:
        kind = pa.list_(pa.struct([("name", pa.string()), ("line", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("score", pa.float64())]))
        names = ("name", "line", "start", "length", "score")
        return pa.array([None if t is None else [dict(zip(names, f)) for f in findings(t)] for t in column.to_pylist()], kind)

    return run(text)


def redacted(text: Column, mark: str = "[SECRET]") -> Column:
    """The text with each finding's literal replaced; texts without findings (and null) as they are."""

    @F.arrow_udf("string")
    def run(column: pa.Array) -> pa.Array:
        out = []
        for t in column.to_pylist():
            found = findings(t) if t is not None else []
            if not found:
                out.append(None)
                continue
            parts, at = [], 0
            for _, _, start, length, _ in found:
                if start >= at:
                    parts += [t[at:start], mark]
                    at = start + length
            out.append("".join([*parts, t[at:]]))
        return pa.array(out, pa.string())

    return F.coalesce(run(F.when(may_assign(text), text)), text)


def secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each finding of each document: doc_id, name, line, start, length, score and the literal's SHA-256 (not the literal).

    A null or empty text has none; repeated rows give repeated findings; other columns are left out.  Time grows with a text's length.
    """
    some = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).where(may_assign(F.col("text")))
    rows = some.select("doc_id", "text", F.explode(scan(F.col("text"))).alias("f"))
    literal = F.substring(F.col("text"), F.col("f.start").cast("int") + 1, F.col("f.length").cast("int"))
    return rows.select("doc_id", "f.name", "f.line", "f.start", "f.length", "f.score", F.sha2(literal, 256).alias("sha256"))


def redact(docs: DataFrame, text_col: str = "text", size_col: str = "n_chars") -> DataFrame:
    """The documents, all kept, with secrets replaced; the column of lengths, if there is one, follows the text where that changed."""
    after = docs.withColumn("_redacted", redacted(F.col(text_col)))
    if size_col in docs.columns:
        changed = F.col("_redacted") != F.col(text_col)
        after = after.withColumn(size_col, F.when(changed, F.length("_redacted").cast(docs.schema[size_col].dataType)).otherwise(F.col(size_col)))
    return after.withColumn(text_col, F.col("_redacted")).select([f"`{c}`" for c in docs.columns])
