"""Character maps: codes to text."""

from __future__ import annotations

import re

from .syntax import SyntaxFault, hex_bytes

#: What a code without a mapping becomes in the strict reading.
REPLACEMENT = "�"

_SECTION = re.compile(rb"begin(codespacerange|bfchar|bfrange)(.*?)end\1", re.S)
_ITEM = re.compile(rb"<([^>]*)>|(\[)|(\])|(%[^\r\n]*)|([^\s<>\[\]%]+)")


def _number(b: bytes) -> int:
    return int.from_bytes(b, "big")


def _units(b: bytes) -> list[int]:
    return [_number(b[i : i + 2]) for i in range(0, len(b), 2)]


def _strict_hex(digits: bytes) -> bytes:
    clean = re.sub(rb"\s", b"", digits)
    if len(clean) % 2 or not re.fullmatch(rb"[0-9A-Fa-f]*", clean):
        raise SyntaxFault(f"bad hexadecimal string <{digits.decode('latin-1')}>")
    return hex_bytes(clean)


def _items(body: bytes):
    """Byte strings, and lists of them for arrays."""
    inside = None
    for m in _ITEM.finditer(body):
        if m[4]:
            continue
        if m[2]:
            inside = []
        elif m[3]:
            yield inside or []
            inside = None
        elif m[5]:
            continue
        else:
            value = _strict_hex(m[1])
            if inside is None:
                yield value
            else:
                inside.append(value)


def parse_cmap(data: bytes) -> tuple[list[tuple[int, int, int]], dict[int, list[int]]]:
    """(codespaces as (start, end, width), UTF-16 units by code); a map without a codespace is a fault."""
    spaces, codes = [], {}
    for m in _SECTION.finditer(data):
        items, step = list(_items(m[2])), 2 if m[1] != b"bfrange" else 3
        if len(items) % step:
            raise SyntaxFault(f"incomplete {m[1].decode()} section")
        for k in range(0, len(items), step):
            group = items[k : k + step]
            if m[1] == b"codespacerange":
                spaces.append((_number(group[0]), _number(group[1]), len(group[0])))
            elif m[1] == b"bfchar":
                codes[_number(group[0])] = _units(group[1])
            else:
                low, high = _number(group[0]), _number(group[1])
                if low > high:
                    raise SyntaxFault(f"range {low:X} to {high:X}")
                if isinstance(group[2], list):
                    codes |= {low + n: _units(x) for n, x in enumerate(group[2]) if low + n <= high}
                    continue
                first = _units(group[2])
                if first[-1] + high - low > 0xFFFF:
                    raise SyntaxFault(f"range at {low:X} leaves the last unit's 16 bits")
                codes |= {low + n: [*first[:-1], first[-1] + n] for n in range(high - low + 1)}
    if not spaces:
        raise SyntaxFault("no codespace range")
    return spaces, codes


def units_text(units: list[int]) -> str:
    """Each unit as a character of its own: surrogates are not joined."""
    return "".join(map(chr, units))


def lookup(codes: dict[int, list[int]], code: int) -> str:
    return units_text(codes[code]) if code in codes else REPLACEMENT


_LINE_HEX = re.compile(rb"<([0-9A-Fa-f\s]*)>")


def _text(b: bytes) -> str:
    return b.decode("utf-16-be", "ignore")


def parse_tounicode(data: bytes) -> dict[int, str]:
    """The tolerant, line-wise reading: later lines win, lines that make no sense are passed over."""
    out: dict[int, str] = {}
    mode = None
    for line in re.split(rb"\r\n|\r|\n", data):
        if b"begin" in line and (b := re.search(rb"begin(bfchar|bfrange)", line)) is not None:
            mode = b[1]
            line = line[b.end() :]
        rest = line.split(b"end" + mode)[0] if mode else b""
        hexes = [hex_bytes(x) for x in _LINE_HEX.findall(rest)]
        if not hexes:
            pass
        elif mode == b"bfchar" and len(hexes) >= 2:
            out[_number(hexes[0])] = _text(hexes[1])
        elif mode == b"bfrange" and len(hexes) >= 3 and (low := _number(hexes[0])) <= (high := _number(hexes[1])):
            if b"[" in rest:
                out |= {low + n: _text(x) for n, x in enumerate(hexes[2:]) if low + n <= high}
            else:
                first, width = _number(hexes[2]), len(hexes[2])
                for n in range(high - low + 1):
                    if (first + n) >> (8 * width):
                        break
                    out[low + n] = _text((first + n).to_bytes(width, "big"))
        if mode and b"end" + mode in line:
            mode = None
    return out
