"""TrueType fonts: which glyph stands for which text, what glyphs look like, and writing a map into a font."""

from __future__ import annotations

import hashlib
import re
import struct
from dataclasses import dataclass, field

from .glyphnames import mac_name, standard_text


class FontFault(ValueError):
    """What makes a font unreadable."""


@dataclass
class Glyph:
    box: tuple[int, int, int, int] | None = None
    contours: list[list[tuple[int, int, bool]]] = field(default_factory=list)
    components: list[tuple[int, int, int, tuple[float, ...]]] = field(default_factory=list)


class Font:
    """Tables ``head maxp loca glyf hmtx hhea cmap post``, read on demand."""

    def __init__(self, data: bytes):
        if len(data) < 12 or data[:4] not in (b"\x00\x01\x00\x00", b"true", b"OTTO"):
            raise FontFault("no TrueType header")
        self.data, self.tables = data, {}
        for i in range(struct.unpack_from(">H", data, 4)[0]):
            tag, _, at, size = struct.unpack_from(">4sLLL", data, 12 + 16 * i)
            self.tables[tag.decode("latin-1")] = data[at : at + size]
        try:
            self.units = struct.unpack_from(">H", self.tables["head"], 18)[0]
            self.long_loca = struct.unpack_from(">h", self.tables["head"], 50)[0]
            self.count = struct.unpack_from(">H", self.tables["maxp"], 4)[0]
        except (KeyError, struct.error) as e:
            raise FontFault(f"broken font: {e}") from e

    def code_points(self) -> dict[int, int]:
        """Code point to glyph of the best Unicode subtable."""
        t = self.tables.get("cmap", b"")
        if len(t) < 4:
            return {}
        ranked = {(3, 10): 0, (0, 6): 1, (0, 4): 2, (3, 1): 3, (0, 3): 4, (0, 2): 5, (0, 1): 6, (0, 0): 7}
        subs = [struct.unpack_from(">HHL", t, 4 + 8 * i) for i in range(struct.unpack_from(">H", t, 2)[0])]
        usable = sorted((ranked[p, e], at) for p, e, at in subs if (p, e) in ranked)
        return self._subtable(t[usable[0][1] :]) if usable else {}

    @staticmethod
    def _subtable(t: bytes) -> dict[int, int]:
        kind = struct.unpack_from(">H", t)[0]
        if kind == 0:
            return {c: g for c, g in enumerate(t[6:262]) if g}
        if kind == 6:
            first, n = struct.unpack_from(">HH", t, 6)
            return {first + i: g for i, g in enumerate(struct.unpack_from(f">{n}H", t, 10)) if g}
        if kind == 12:
            out = {}
            for i in range(struct.unpack_from(">L", t, 12)[0]):
                low, high, g = struct.unpack_from(">LLL", t, 16 + 12 * i)
                out |= {c: g + c - low for c in range(low, high + 1)}
            return out
        if kind != 4:
            return {}
        n = struct.unpack_from(">H", t, 6)[0] // 2
        ends, starts = struct.unpack_from(f">{n}H", t, 14), struct.unpack_from(f">{n}H", t, 16 + 2 * n)
        deltas, offsets = struct.unpack_from(f">{n}H", t, 16 + 4 * n), struct.unpack_from(f">{n}H", t, 16 + 6 * n)
        out = {}
        for i in range(n):
            for c in range(starts[i], min(ends[i], 0xFFFE) + 1):
                if offsets[i]:
                    at = 16 + 6 * n + 2 * i + offsets[i] + 2 * (c - starts[i])
                    g = struct.unpack_from(">H", t, at)[0] if at + 2 <= len(t) else 0
                    g = (g + deltas[i]) & 0xFFFF if g else 0
                else:
                    g = (c + deltas[i]) & 0xFFFF
                if g:
                    out[c] = g
        return out

    def names(self) -> list[str]:
        """Glyph names; ``glyphNNNNN`` where the font has none."""
        t = self.tables.get("post", b"")
        out = [f"glyph{i:05d}" for i in range(self.count)]
        if out:
            out[0] = ".notdef"
        if t[:4] == b"\x00\x01\x00\x00":  # the standard ones, in their order
            return [mac_name(g) if g < 258 else n for g, n in enumerate(out)]
        if len(t) < 34 or t[:4] != b"\x00\x02\x00\x00":
            return out
        n = struct.unpack_from(">H", t, 32)[0]
        index = struct.unpack_from(f">{n}H", t, 34)
        strings, at = [], 34 + 2 * n
        while at < len(t):
            strings.append(t[at + 1 : at + 1 + t[at]].decode("latin-1"))
            at += 1 + t[at]
        for g, k in enumerate(index[: self.count]):
            if k >= 258 and k - 258 < len(strings):
                out[g] = strings[k - 258]
            elif 0 < k < 258:
                out[g] = mac_name(k)
        return out

    def advances(self) -> list[int]:
        t, n = self.tables.get("hmtx", b""), struct.unpack_from(">H", self.tables["hhea"], 34)[0] if "hhea" in self.tables else 0
        known = [struct.unpack_from(">H", t, 4 * i)[0] for i in range(min(n, len(t) // 4))] or [self.units]
        return [known[min(g, len(known) - 1)] for g in range(self.count)]

    def ascent(self) -> int:
        return struct.unpack_from(">h", self.tables["hhea"], 4)[0] if "hhea" in self.tables else self.units

    def glyph(self, gid: int) -> Glyph:
        loca, glyf = self.tables.get("loca", b""), self.tables.get("glyf", b"")
        if not 0 <= gid < self.count:
            raise FontFault(f"no glyph {gid}")
        a, b = struct.unpack_from(">LL", loca, 4 * gid) if self.long_loca else (2 * x for x in struct.unpack_from(">HH", loca, 2 * gid))
        t = glyf[a:b]
        if len(t) < 10:
            return Glyph()
        n, *box = struct.unpack_from(">5h", t)
        return self._simple(t, n, tuple(box)) if n >= 0 else self._composite(t, tuple(box))

    @staticmethod
    def _simple(t: bytes, n: int, box) -> Glyph:
        ends = struct.unpack_from(f">{n}H", t, 10)
        points = ends[-1] + 1 if n else 0
        at = 12 + 2 * n + struct.unpack_from(">H", t, 10 + 2 * n)[0]
        flags: list[int] = []
        while len(flags) < points:
            f, at = t[at], at + 1
            flags.append(f)
            if f & 8:
                flags += [f] * t[at]
                at += 1
        axes = []
        for short, same in ((2, 16), (4, 32)):
            value, axis = 0, []
            for f in flags[:points]:
                if f & short:
                    value += t[at] if f & same else -t[at]
                    at += 1
                elif not f & same:
                    value += struct.unpack_from(">h", t, at)[0]
                    at += 2
                axis.append(value)
            axes.append(axis)
        all_points = [(x, y, bool(f & 1)) for x, y, f in zip(*axes, flags)]
        starts = [0, *(e + 1 for e in ends[:-1])]
        return Glyph(box, [all_points[s : e + 1] for s, e in zip(starts, ends)])

    @staticmethod
    def _composite(t: bytes, box) -> Glyph:
        parts, at, more = [], 10, True
        while more:
            flags, gid = struct.unpack_from(">HH", t, at)
            dx, dy = struct.unpack_from(">hh" if flags & 1 else ">bb", t, at + 4)
            at += 8 if flags & 1 else 6
            size = 1 if flags & 8 else 2 if flags & 64 else 4 if flags & 128 else 0
            scale = tuple(x / 16384 for x in struct.unpack_from(f">{size}h", t, at))
            at += 2 * size
            parts.append((gid, dx if flags & 2 else 0, dy if flags & 2 else 0, scale))
            more = bool(flags & 32)
        return Glyph(box, [], parts)

    def outline(self, gid: int, depth: int = 5) -> list[list[tuple[float, float, bool]]]:
        """Contours with components put in place."""
        g = self.glyph(gid)
        out = [[(float(x), float(y), on) for x, y, on in c] for c in g.contours]
        for part, dx, dy, scale in g.components if depth else ():
            a, b, c, d = {0: (1, 0, 0, 1), 1: (*scale, 0, 0, *scale), 2: (*scale[:1], 0, 0, *scale[1:])}.get(len(scale), scale)
            out += [[(a * x + c * y + dx, b * x + d * y + dy, on) for x, y, on in k] for k in self.outline(part, depth - 1)]
        return out


def name_to_text(name: str) -> str | None:
    """What a standard name says, else ``uniXXXX`` parts, all of them, or ``uXXXX``; None for others."""
    if name == ".notdef":
        return None
    if text := standard_text(name):
        return text
    if parts := re.findall(r"uni([0-9A-F]{4,6})", name):
        return "".join(chr(int(p, 16)) for p in parts if int(p, 16) < 0x110000) or None
    m = re.fullmatch(r"u([0-9A-F]{4,6})", name.split(".")[0])
    return chr(int(m[1], 16)) if m and int(m[1], 16) < 0x110000 else None


def glyph_texts(font: Font) -> dict[int, str]:
    """Glyph to text: the least code point of its map first, its name where the map has none."""
    out: dict[int, str] = {}
    for c, g in sorted(font.code_points().items()):
        out.setdefault(g, chr(c))
    for g, name in enumerate(font.names()):
        if g not in out and (text := name_to_text(name)):
            out[g] = text
    return out


def fingerprint(font: Font, gid: int, names: list[str] | None = None) -> str:
    """``glyph:<sha256>`` of name, box and outline; ``gid:<n>`` where the glyph can't be read."""
    try:
        g = font.glyph(gid)
        names = names or font.names()
        parts = [names[gid], *(str(x) for x in g.box or (0, 0, 0, 0))]
        if g.components:
            parts += [f"{names[c]}:{dx}:{dy}:{scale or None}" for c, dx, dy, scale in g.components]
        else:
            flat = [p for c in g.contours for p in c]
            ends, n = [], -1
            for c in g.contours:
                n += len(c)
                ends.append(n)
            parts += [repr([p[:2] for p in flat]), repr(ends), repr([int(p[2]) for p in flat])]
    except (FontFault, IndexError, struct.error):
        return f"gid:{gid}"
    return "glyph:" + hashlib.sha256("|".join(parts).encode()).hexdigest()


def fingerprints(font: Font) -> dict[int, str]:
    names = font.names()
    return {g: fingerprint(font, g, names) for g in range(font.count)}


def font_key(data: bytes, base_font: str) -> str:
    return f"{base_font}:{hashlib.sha256(data).hexdigest()}"


# --- drawing


def path(contours: list[list[tuple[float, float, bool]]]) -> str:
    """SVG path data of quadratic contours."""
    out = []
    for c in contours:
        if not c:
            continue
        first = next((i for i, p in enumerate(c) if p[2]), None)
        if first is None:
            start = ((c[0][0] + c[-1][0]) / 2, (c[0][1] + c[-1][1]) / 2)
            ring = c
        else:
            start = c[first][:2]
            ring = c[first + 1 :] + c[:first]
        out.append(f"M{start[0]:g} {start[1]:g}")
        held = None
        for x, y, on in [*ring, (*start, True)]:
            if on:
                out.append(f"L{x:g} {y:g}" if held is None else f"Q{held[0]:g} {held[1]:g} {x:g} {y:g}")
                held = None
            else:
                if held is not None:
                    out.append(f"Q{held[0]:g} {held[1]:g} {(held[0] + x) / 2:g} {(held[1] + y) / 2:g}")
                held = (x, y)
        out.append("Z")
    return "".join(out)


# Canvas, margin and colour of glyph pictures.
CANVAS, PAD, INK = 256, 16, "#d11"


def glyph_svg(font: Font, gid: int) -> str:
    """One glyph, scaled to fill the canvas."""
    contours = font.outline(gid)
    points = [p for c in contours for p in c]
    head = f'<svg xmlns="http://www.w3.org/2000/svg" width="{CANVAS}" height="{CANVAS}" viewBox="0 0 {CANVAS} {CANVAS}">'
    if not points:
        return f'{head}<text x="{PAD}" y="{CANVAS // 2}">no outline: gid {gid}</text></svg>'
    xs, ys = [p[0] for p in points], [p[1] for p in points]
    w, h = max(max(xs) - min(xs), 1), max(max(ys) - min(ys), 1)
    s = min((CANVAS - 2 * PAD) / w, (CANVAS - 2 * PAD) / h)
    tx, ty = (CANVAS - w * s) / 2 - min(xs) * s, (CANVAS + h * s) / 2 + min(ys) * s
    return f'{head}<path d="{path(contours)}" fill="{INK}" transform="translate({tx:g},{ty:g}) scale({s:g},{-s:g})"/></svg>'


def line_svg(font: Font, gids: list[int], target: int) -> str:
    """A line of glyphs laid out by advance, the target in colour with a line under it."""
    advance, ascent, x, out = font.advances(), font.ascent(), 0, []
    for g in gids:
        if 0 <= g < font.count:
            fill = INK if g == target else "#222"
            out.append(f'<path d="{path(font.outline(g))}" fill="{fill}" transform="translate({x},{ascent}) scale(1,-1)"/>')
            if g == target:
                out.append(f'<line x1="{x}" x2="{x + advance[g]}" y1="{ascent + 70}" y2="{ascent + 70}" stroke="{INK}" stroke-width="20"/>')
            x += advance[g]
    width = max(x + 0.25 * font.units, font.units)
    return f'<svg xmlns="http://www.w3.org/2000/svg" viewBox="0 0 {width:g} {ascent + 200}">{"".join(out)}</svg>'


# --- writing


def _checksum(b: bytes) -> int:
    b += b"\0" * (-len(b) % 4)
    return sum(struct.unpack(f">{len(b) // 4}L", b)) & 0xFFFFFFFF


def assemble(tables: dict[str, bytes]) -> bytes:
    """A font file of the tables, with checksums."""
    n = len(tables)
    power = 1 << (n.bit_length() - 1)
    head = struct.pack(">LHHHH", 0x00010000, n, power * 16, power.bit_length() - 1, 16 * (n - power))
    at, directory, body = 12 + 16 * n, b"", b""
    for tag in sorted(tables):
        t = tables[tag]
        directory += struct.pack(">4sLLL", tag.encode(), _checksum(t), at + len(body), len(t))
        body += t + b"\0" * (-len(t) % 4)
    return head + directory + body


def cmap_table(codes: dict[int, int]) -> bytes:
    """A format-4 table for code points below U+FFFF and a format-12 table for all."""
    low = sorted((c, g) for c, g in codes.items() if c < 0xFFFF)
    rows = [(c, c, (g - c) & 0xFFFF, 0) for c, g in low] + [(0xFFFF, 0xFFFF, 1, 0)]
    n = len(rows)
    power = 1 << (n.bit_length() - 1)
    col = lambda k: struct.pack(f">{n}H", *(r[k] for r in rows))
    four = struct.pack(">HHHH", 2 * n, 2 * power, power.bit_length() - 1, 2 * (n - power)) + col(1) + b"\0\0" + col(0) + col(2) + col(3)
    four = struct.pack(">HHH", 4, len(four) + 6, 0) + four
    groups = b"".join(struct.pack(">LLL", c, c, g) for c, g in sorted(codes.items()))
    twelve = struct.pack(">HHLLL", 12, 0, len(groups) + 16, 0, len(codes)) + groups
    return struct.pack(">HH", 0, 2) + struct.pack(">HHL", 3, 1, 20) + struct.pack(">HHL", 3, 10, 20 + len(four)) + four + twelve


def ligature_table(rules: dict[tuple[int, ...], int]) -> bytes:
    """A GSUB table whose only feature, ``liga``, turns glyph sequences into one glyph, longest first."""
    by_first: dict[int, list[tuple[tuple[int, ...], int]]] = {}
    for seq, g in rules.items():
        by_first.setdefault(seq[0], []).append((seq[1:], g))
    firsts = sorted(by_first)
    sets = []
    for f in firsts:
        ligs = [struct.pack(f">HH{len(rest)}H", g, len(rest) + 1, *rest) for rest, g in sorted(by_first[f], key=lambda x: (-len(x[0]), x[0]))]
        at, offsets = 2 + 2 * len(ligs), []
        for x in ligs:
            offsets.append(at)
            at += len(x)
        sets.append(struct.pack(f">H{len(ligs)}H", len(ligs), *offsets) + b"".join(ligs))
    at, offsets = 6 + 2 * len(sets), []
    for x in sets:
        offsets.append(at)
        at += len(x)
    coverage = struct.pack(f">HH{len(firsts)}H", 1, len(firsts), *firsts)
    subtable = struct.pack(f">HHH{len(sets)}H", 1, at, len(sets), *offsets) + b"".join(sets) + coverage
    lookups = struct.pack(">HH", 1, 4) + struct.pack(">HHHH", 4, 0, 1, 8) + subtable
    features = struct.pack(">H4sH", 1, b"liga", 8) + struct.pack(">HHH", 0, 1, 0)
    language = struct.pack(">HHHH", 0, 0xFFFF, 1, 0)
    record = lambda tag, at: struct.pack(">4sH", tag, at)
    script = struct.pack(">HH", 4, 0) + language
    scripts = struct.pack(">H", 3) + record(b"DFLT", 20) + record(b"beng", 20) + record(b"bng2", 20) + script
    return struct.pack(">HHHHH", 1, 0, 10, 10 + len(scripts), 10 + len(scripts) + len(features)) + scripts + features + lookups


def name_table(family: str) -> bytes:
    text = {1: family, 2: "Regular", 3: family, 4: family, 6: family.replace(" ", "")}
    body, records = b"", b""
    for k, v in text.items():
        raw = v.encode("utf-16-be")
        records += struct.pack(">HHHHHH", 3, 1, 0x409, k, len(raw), len(body))
        body += raw
    return struct.pack(">HHH", 0, len(text), 6 + len(records)) + records + body


# Tables that a usable font has.
REQUIRED = ("cmap", "head", "hhea", "hmtx", "maxp", "name", "post")


def unicode_font(source: bytes, entries: dict[int, str], family: str) -> tuple[bytes, dict[str, int]]:
    """(font, counts): ``source`` with a map from the single characters in ``entries`` and ligatures from the longer ones."""
    font = Font(source)
    codes: dict[int, int] = {}
    for g, t in sorted(entries.items()):
        if len(t) == 1 and g < font.count:
            codes.setdefault(ord(t), g)
    if not codes:
        raise FontFault("no entry is a single character")
    rules = {tuple(codes[ord(c)] for c in t): g for g, t in sorted(entries.items()) if len(t) > 1 and g < font.count and all(ord(c) in codes for c in t)}
    tables = dict(font.tables) | {"cmap": cmap_table(codes), "name": name_table(family)}
    if rules:
        tables["GSUB"] = ligature_table(rules)
    out = assemble(tables)
    missing = [t for t in REQUIRED if t not in tables]
    if missing or not Font(out).code_points():
        raise FontFault(f"font lacks {missing or 'a usable map'}")
    return out, {"entries": len(entries), "single": sum(len(t) == 1 for t in entries.values()), "ligatures": len(rules)}
