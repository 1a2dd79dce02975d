"""Text-show operations of content streams."""

from __future__ import annotations

import re

from .syntax import DELIMITERS, SPACE, SyntaxFault, hex_bytes, literal_at

# The operators that show text.
SHOWS = (b"Tj", b"'", b'"', b"TJ")

_REGULAR = rb"[^" + SPACE + DELIMITERS + rb"]"
_LEX = re.compile(
    rb"[" + SPACE + rb"]+|%[^\r\n]*"
    rb"|(?P<hex><(?!<)[^<>]*>)|(?P<literal>\()"
    rb"|(?P<punct><<|>>|[\[\]{}])"
    rb"|(?P<name>/" + _REGULAR + rb"*)"
    rb"|(?P<word>" + _REGULAR + rb"+)"
)
_INLINE_END = re.compile(rb"(?<=[" + SPACE + rb"])EI(?=[" + SPACE + rb"]|$)")


def lex(data: bytes):
    """(kind, value, start) with kinds name, string, number, punct, operator; comments and inline images are passed over."""
    at = 0
    while at < len(data):
        m = _LEX.match(data, at)
        if m is None:
            raise SyntaxFault(f"unterminated or stray {data[at : at + 1]!r} at {at}")
        start, at, kind = at, m.end(), m.lastgroup
        if kind == "literal":
            value, at = literal_at(data, start)
            yield "string", value, start
        elif kind == "hex":
            if re.search(rb"[^0-9A-Fa-f" + SPACE + rb"]", m[0][1:-1]):
                raise SyntaxFault(f"bad hexadecimal string at {start}")
            yield "string", hex_bytes(m[0][1:-1]), start
        elif kind == "name":
            yield "name", m[0][1:], start
        elif kind == "punct":
            yield "punct", m[0], start
        elif kind == "word":
            if m[0] == b"BI":
                end = _INLINE_END.search(data, at)
                if end is None:
                    raise SyntaxFault(f"unterminated inline image at {start}")
                at = end.end()
                continue
            try:
                yield "number", float(m[0]) if re.search(rb"[.eE]", m[0]) else int(m[0]), start
            except ValueError:
                yield "operator", m[0], start


def text_shows(data: bytes) -> tuple[list[tuple[str, list[tuple[str, bytes | None, float | None]]]], str | None]:
    """([(operator, operands)], error): operands are ``(kind, bytes, number)``.

    A token that breaks the syntax ends the stream; what came before stands. A
    show without a fitting operand is an error of the whole stream.
    """
    out, pending, array = [], [], None
    try:
        for kind, value, start in lex(data):
            if array is not None:
                if kind == "punct" and value == b"]":
                    pending.append(("array", array))
                    array = None
                elif kind == "string":
                    array.append(("string", value, None))
                elif kind == "number":
                    array.append(("number", None, float(value)))
                elif not (kind == "punct" and value == b"["):
                    array = None  # not an array of text
                    if kind == "operator":
                        pending.clear()
            elif kind == "punct" and value == b"[":
                array = []
            elif kind == "operator":
                if value in SHOWS:
                    wanted = "array" if value == b"TJ" else "string"
                    if not pending or pending[-1][0] != wanted:
                        return out, f"{value.decode()} at {start} lacks its operand"
                    last = pending[-1][1]
                    out.append((value.decode(), last if wanted == "array" else [("string", last, None)]))
                pending.clear()
            else:
                pending.append((kind, value))
    except SyntaxFault as fault:
        return out, str(fault)
    return out, None


_SHOW_ONE = re.compile(rb"[" + SPACE + rb"]*(Tj|'|\")(?!" + _REGULAR + rb")")
_SHOW_ARRAY = re.compile(rb"[" + SPACE + rb"]*TJ(?!" + _REGULAR + rb")")
_NUMBER = re.compile(rb"[+-]?(?:\d+\.?\d*|\.\d+)")
_BLANK = re.compile(rb"[" + SPACE + rb"]*")


def _string_at(data: bytes, at: int) -> tuple[bytes, int] | None:
    try:
        if data[at : at + 1] == b"(":
            return literal_at(data, at)
        if (m := re.compile(rb"<([0-9A-Fa-f" + SPACE + rb"]*)>").match(data, at)) is not None:
            return hex_bytes(m[1]), m.end()
    except SyntaxFault:
        pass
    return None


def fallback_shows(data: bytes) -> list[tuple[int, str, list]]:
    """Shows found by looking at every string and every array, in byte order: for streams that no tokenizer gets through."""
    found = []
    for m in re.finditer(rb"[(<]", data):
        if (s := _string_at(data, m.start())) and (op := _SHOW_ONE.match(data, s[1])):
            found.append((m.start(), op[1].decode(), [("string", s[0], None)]))
    for m in re.finditer(rb"\[", data):
        at, items = m.end(), []
        while True:
            at = _BLANK.match(data, at).end()
            if (s := _string_at(data, at)) is not None:
                items.append(("string", s[0], None))
                at = s[1]
            elif (n := _NUMBER.match(data, at)) is not None:
                items.append(("number", None, float(n[0])))
                at = n.end()
            else:
                break
        if data[at : at + 1] == b"]" and _SHOW_ARRAY.match(data, at + 1):
            found.append((m.start(), "TJ", items))
    return sorted(found, key=lambda x: x[0])
