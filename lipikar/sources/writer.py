"""Writes small PDFs and a small font, for tests and round trips."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Mapping, Sequence

from ..functions.truetype import assemble, cmap_table


def tounicode(codes: Mapping[int, str]) -> bytes:
    """A ToUnicode map in sections of 100."""
    rows = sorted(codes.items())
    out = [b"/CIDInit /ProcSet findresource begin begincmap\n1 begincodespacerange\n<0000> <FFFF>\nendcodespacerange\n"]
    for i in range(0, len(rows), 100):
        part = rows[i : i + 100]
        lines = "".join(f"<{c:04X}> <{t.encode('utf-16-be').hex().upper()}>\n" for c, t in part)
        out.append(f"{len(part)} beginbfchar\n{lines}endbfchar\n".encode())
    return b"".join([*out, b"endcmap end\n"])


def hex_codes(codes: Sequence[int]) -> str:
    """Codes of 16 bits in four hexadecimal digits each."""
    return struct.pack(f">{len(codes)}H", *codes).hex().upper()


def stream(data: bytes, extra: str = "", deflate: bool = True) -> bytes:
    body = zlib.compress(data) if deflate else data
    return f"<< {extra}{' /Filter /FlateDecode' if deflate else ''} /Length {len(body)} >>\nstream\n".encode("latin-1") + body + b"\nendstream"


def file_of(objects: Mapping[int, bytes], root: int = 1) -> bytes:
    """A file with a traditional cross-reference table."""
    out, offsets = bytearray(b"%PDF-1.4\n"), {}
    for n, body in sorted(objects.items()):
        offsets[n] = len(out)
        out += f"{n} 0 obj\n".encode() + body + b"\nendobj\n"
    top, at = max(objects) + 1, len(out)
    out += f"xref\n0 {top}\n0000000000 65535 f \n".encode()
    for n in range(1, top):
        out += (f"{offsets[n]:010d} 00000 n \n" if n in offsets else "0000000000 00000 f \n").encode()
    return bytes(out + f"trailer\n<< /Size {top} /Root {root} 0 R >>\nstartxref\n{at}\n%%EOF\n".encode())


def build_pdf(pages: Sequence[Sequence[Sequence[int]]], codes: Mapping[int, str], base_font: str = "AAAAAA+Sample", font: bytes | None = None) -> bytes:
    """Pages of lines of codes, each line one hexadecimal show operation; ``codes`` is the font's ToUnicode map."""
    objects = {1: b"<< /Type /Catalog /Pages 2 0 R >>"}
    first = 10
    kids = [first + 2 * i for i in range(len(pages))]
    objects[2] = f"<< /Type /Pages /Count {len(pages)} /Kids [{' '.join(f'{k} 0 R' for k in kids)}] >>".encode()
    objects[3] = f"<< /Type /Font /Subtype /Type0 /BaseFont /{base_font} /Encoding /Identity-H /DescendantFonts [4 0 R] /ToUnicode 6 0 R >>".encode()
    objects[4] = f"<< /Type /Font /Subtype /CIDFontType2 /BaseFont /{base_font} /FontDescriptor 5 0 R >>".encode()
    objects[5] = f"<< /Type /FontDescriptor /FontName /{base_font}{' /FontFile2 7 0 R' if font else ''} >>".encode()
    objects[6] = stream(tounicode(codes))
    if font:
        objects[7] = stream(font)
    for k, lines in zip(kids, pages):
        shows = "".join(f"<{hex_codes(line)}> Tj\n" for line in lines)
        objects[k] = f"<< /Type /Page /Parent 2 0 R /Resources << /Font << /F1 3 0 R >> >> /Contents {k + 1} 0 R >>".encode()
        objects[k + 1] = stream(f"BT /F1 12 Tf\n{shows}ET".encode())
    return file_of(objects)


def build_font(codes: Mapping[int, int], shapes: Sequence[Sequence[Sequence[tuple[int, int]]]], names: Sequence[str] | None = None) -> bytes:
    """A TrueType font of polygons: ``codes`` maps code points to glyphs, ``shapes`` has each glyph's contours."""
    glyf, loca = b"", [0]
    for contours in shapes:
        pts = [p for c in contours for p in c]
        if pts:
            xs, ys = [p[0] for p in pts], [p[1] for p in pts]
            ends, n = [], -1
            for c in contours:
                n += len(c)
                ends.append(n)
            deltas = lambda v: b"".join(struct.pack(">h", b - a) for a, b in zip([0, *v[:-1]], v))
            glyf += struct.pack(">5h", len(contours), min(xs), min(ys), max(xs), max(ys)) + struct.pack(f">{len(ends)}H", *ends) + b"\0\0" + b"\x01" * len(pts) + deltas(xs) + deltas(ys)
            glyf += b"\0" * (-len(glyf) % 4)
        loca.append(len(glyf))
    n = len(shapes)
    names = names or [".notdef", *(f"g{i}" for i in range(1, n))]
    strings = b"".join(bytes([len(x)]) + x.encode() for x in names)
    tables = {
        "head": struct.pack(">LLLLHHQQhhhhHHhhh", 0x10000, 0x10000, 0, 0x5F0F3CF5, 0, 1000, 0, 0, 0, 0, 1000, 1000, 0, 8, 2, 1, 0),
        "hhea": struct.pack(">LhhhHhhhhhhhhhhhH", 0x10000, 800, -200, 0, 600, 0, 0, 0, 1, 0, 0, 0, 0, 0, 0, 0, n),
        "maxp": struct.pack(">LH", 0x10000, n) + b"\0" * 26,
        "hmtx": struct.pack(f">{2 * n}H", *[x for _ in range(n) for x in (600, 0)]),
        "loca": struct.pack(f">{n + 1}L", *loca),
        "glyf": glyf,
        "cmap": cmap_table(dict(codes)),
        "post": struct.pack(">LLhhLLLLL", 0x20000, 0, 0, 0, 0, 0, 0, 0, 0) + struct.pack(f">H{n}H", n, *range(258, 258 + n)) + strings,
    }
    return assemble(tables)
