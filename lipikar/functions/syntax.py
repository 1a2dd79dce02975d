"""PDF syntax: tokens and values, as a table function's work on one byte string.

One regular expression recognises a token at a position; values are built over the
token stream by an explicit stack, so nesting depth costs no Python frames.
Values are plain tagged tuples: ``(kind, payload)``.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from typing import NamedTuple


class SyntaxFault(ValueError):
    """What the bytes at a position break."""


class Tok(NamedTuple):
    type: str
    value: object
    start: int
    end: int


# PDF white space and delimiters.
SPACE = rb"\x00\t\n\x0c\r "
DELIMITERS = rb"()<>\[\]{}/%"

_REGULAR = rb"[^" + SPACE + DELIMITERS + rb"]"
_SHAPES = re.compile(
    rb"(?P<space>[" + SPACE + rb"]+)"
    rb"|(?P<comment>%[^\r\n]*)"
    rb"|(?P<dict_open><<)|(?P<dict_close>>>)"
    rb"|(?P<array_open>\[)|(?P<array_close>\])"
    rb"|(?P<hex><(?P<digits>[0-9A-Fa-f" + SPACE + rb"]*)>)"
    rb"|(?P<name>/" + _REGULAR + rb"*)"
    rb"|(?P<literal>\()"
    rb"|(?P<number>[+-]?(?:\d+\.?\d*|\.\d+)(?!" + _REGULAR + rb"))"
    rb"|(?P<word>" + _REGULAR + rb"+)"
)
_ESCAPES = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\x0c"}
_LITERAL_PART = re.compile(rb"\\([0-7]{1,3})|\\(\r\n|\r|\n)|\\(.)|([()])|([^\\()]+)", re.S)


def literal_at(data: bytes, start: int) -> tuple[bytes, int]:
    """The string whose opening parenthesis is at ``start``, and where it ends."""
    out, depth, at = [], 1, start + 1
    while m := _LITERAL_PART.match(data, at):
        at = m.end()
        octal, line, escaped, paren, plain = m.groups()
        if octal:
            out.append(bytes([int(octal, 8) & 255]))
        elif escaped:
            out.append(_ESCAPES.get(escaped, escaped))
        elif paren == b"(":
            depth += 1
            out.append(paren)
        elif paren:
            depth -= 1
            if not depth:
                return b"".join(out), at
            out.append(paren)
        elif plain:
            out.append(plain)
        # an escaped line end adds nothing
    raise SyntaxFault(f"unterminated string at {start}")


def hex_bytes(digits: bytes) -> bytes:
    """Hexadecimal digits with white space anywhere; an odd last digit is followed by 0."""
    if len(digits) % 2 == 0 and digits.isalnum():
        return bytes.fromhex(digits.decode("ascii"))
    clean = re.sub(rb"[" + SPACE + rb"]", b"", digits)
    return bytes.fromhex((clean + b"0" * (len(clean) % 2)).decode("ascii"))


def name_text(raw: bytes) -> bytes:
    """A name without its slash, ``#XX`` decoded."""
    if re.search(rb"#(?![0-9A-Fa-f]{2})", raw):
        raise SyntaxFault(f"bad escape in name {raw!r}")
    return re.sub(rb"#([0-9A-Fa-f]{2})", lambda m: bytes.fromhex(m[1].decode()), raw)


def tokens(data: bytes, at: int = 0, comments: bool = True) -> Iterator[Tok]:
    """All tokens from ``at`` on, then one of type ``eof``."""
    while at < len(data):
        m = _SHAPES.match(data, at)
        if m is None:
            raise SyntaxFault(f"unexpected {data[at : at + 1]!r} at {at}")
        kind, start, at = m.lastgroup, at, m.end()
        if kind == "digits":
            kind = "hex"
        if kind == "space" or (kind == "comment" and not comments):
            continue
        if kind == "literal":
            value, at = literal_at(data, start)
        elif kind == "hex":
            value = hex_bytes(m["digits"])
        elif kind == "name":
            value = name_text(m[0][1:])
        elif kind == "number":
            value = int(m[0]) if re.fullmatch(rb"[+-]?\d+", m[0]) else float(m[0])
        elif kind == "word":
            if m[0][:1] in b"+-.0123456789" and re.match(rb"[+-]?\.?\d", m[0]):
                raise SyntaxFault(f"malformed number {m[0]!r} at {start}")
            kind, value = {b"true": ("boolean", True), b"false": ("boolean", False), b"null": ("null", None)}.get(m[0], ("keyword", m[0]))
        else:
            value = m[0]
        yield Tok(kind, value, start, at)
    yield Tok("eof", None, len(data), len(data))


class Reader:
    """Tokens without comments, with look-ahead."""

    def __init__(self, data: bytes, at: int = 0):
        self.source, self.ahead = tokens(data, at, comments=False), []

    def peek(self, n: int = 0) -> Tok:
        while len(self.ahead) <= n:
            if self.ahead and self.ahead[-1].type == "eof":
                return self.ahead[-1]
            self.ahead.append(next(self.source))
        return self.ahead[n]

    def pop(self) -> Tok:
        t = self.peek()
        if t.type != "eof":
            self.ahead.pop(0)
        return t

    def keyword(self, word: bytes) -> Tok:
        t = self.pop()
        if t.type != "keyword" or t.value != word:
            raise SyntaxFault(f"expected {word.decode()} at {t.start}, found {t.value!r}")
        return t


def _whole(t: Tok) -> bool:
    return t.type == "number" and isinstance(t.value, int) and t.value >= 0


def read_value(r: Reader) -> tuple:
    """The next value: name, string, hex, number, boolean, null, ref, array or dict."""
    stack: list[tuple[str, list]] = []
    while True:
        t = r.pop()
        if t.type in ("array_open", "dict_open"):
            stack.append((t.type[:-5], []))
            continue
        if t.type in ("array_close", "dict_close"):
            if not stack or stack[-1][0] != t.type[:-6]:
                raise SyntaxFault(f"unexpected {t.value!r} at {t.start}")
            kind, items = stack.pop()
            value = ("array", tuple(items)) if kind == "array" else ("dict", _pairs(items, t.start))
        elif _whole(t) and _whole(r.peek()) and r.peek(1).type == "keyword" and r.peek(1).value == b"R":
            value = ("ref", (t.value, r.pop().value))
            r.pop()
        elif t.type in ("name", "hex", "number", "boolean", "null"):
            value = (t.type, t.value)
        elif t.type == "literal":
            value = ("string", t.value)
        elif t.type == "eof":
            raise SyntaxFault(f"unterminated {stack[-1][0]}" if stack else "no value")
        else:
            raise SyntaxFault(f"unexpected {t.value!r} at {t.start}")
        if not stack:
            return value
        stack[-1][1].append(value)


def _pairs(items: list, at: int) -> tuple:
    if len(items) % 2:
        raise SyntaxFault(f"key without value in the dictionary that ends at {at}")
    keys, values = items[::2], items[1::2]
    if any(k[0] != "name" for k in keys):
        raise SyntaxFault(f"key that is no name in the dictionary that ends at {at}")
    names = [k[1] for k in keys]
    if len(set(names)) < len(names):
        raise SyntaxFault(f"repeated key in the dictionary that ends at {at}")
    return tuple(zip(names, values))


def parse_value(data: bytes) -> tuple:
    """The one value in ``data``; anything after it is a fault."""
    r = Reader(data)
    value = read_value(r)
    if (t := r.peek()).type != "eof":
        raise SyntaxFault(f"{t.value!r} at {t.start} after the value")
    return value


def parse_indirect(data: bytes) -> tuple[int, int, tuple]:
    """(number, generation, value) of ``n g obj value endobj``; no streams."""
    r = Reader(data)
    n, g = r.pop(), r.pop()
    if not (_whole(n) and _whole(g)):
        raise SyntaxFault("an indirect object begins with its number and generation")
    r.keyword(b"obj")
    value = read_value(r)
    r.keyword(b"endobj")
    return n.value, g.value, value


def get(value: tuple | None, key: str) -> tuple | None:
    """The value under ``key``, without its slash, of a dictionary; None otherwise."""
    if value is None or value[0] != "dict":
        return None
    return dict(value[1]).get(key.encode("latin-1"))


def as_json(value: tuple) -> str:
    """A value as JSON for ``parse_json``: ``{"t": kind, "v": payload}``, bytes as ISO-8859-1 text."""

    def plain(v):
        kind, x = v
        if kind == "array":
            x = [plain(i) for i in x]
        elif kind == "dict":
            x = {k.decode("latin-1"): plain(i) for k, i in x}
        elif kind == "ref":
            x = list(x)
        elif isinstance(x, bytes):
            x = x.decode("latin-1")
        return {"t": kind, "v": x}

    return json.dumps(plain(value), ensure_ascii=False)


def as_text(value: tuple) -> str:
    """A reference as ``n g R``, a name with its slash."""
    kind, x = value
    return f"{x[0]} {x[1]} R" if kind == "ref" else "/" + x.decode("latin-1") if kind == "name" else str(x)
