"""Operator 2, secret scans.

Three fixed patterns give the base findings; a sliding window of Shannon entropy
over every candidate string gives further ones. The window's character counts
and its sum of ``c * log2(c)`` are updated by one character in and one out, so a
candidate costs time in proportion to its length whatever the window.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: Order of kinds among findings that start together; ``entropy`` comes last.
KINDS = ("assign", "access", "hex", "entropy")

# The patterns of the base findings.
ASSIGN = re.compile(
    r"(?:[Pp][Aa][Ss][Ss][Ww](?:[Oo][Rr])?[Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])"
    r"[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
HEX_LONG = re.compile(r"[0-9a-f]{24,}")
ACCESS_LEAST, ASSIGN_LEAST = 20, 6


@dataclass(frozen=True)
class EntropyClass:
    """Candidates are maximal runs of ``alphabet``; a window of ``window`` characters counts from ``bits`` on."""

    name: str
    alphabet: str
    window: int
    bits: float


#: Hexadecimal digits reach 4 bits at most, the base-64 alphabet 6.
CLASSES = (
    EntropyClass("hex", "0-9a-fA-F", 20, 3.0),
    EntropyClass("base64", "A-Za-z0-9+/_=-", 24, 4.0),
)

#: Candidates that match one of these as a whole are known not to be secrets, though a random UUID may well be one.
ALLOW = (r"[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}",)  # UUID

#: Segments, between = / _ + and -, that match one of these are known; those at a candidate's ends don't count.
#: What that costs: a key of letters alone is found from 16 letters in a row on, one of lower-case letters and
#: digits from 12, one of digits alone never, and one of up to 20 characters not if a placeholder stands in it.
KNOWN = (
    r"[A-Za-z]{0,15}",  # words
    r"[a-z0-9]{1,11}",  # parts of slugs
    r"[0-9]+",  # numbers, dates
    r"(?=.{1,20}\Z)(?i:.*(?:example|sample|dummy|placeholder|x{6,}|0{8,}|abcdef0?123456|0123456789).*)",
)
SEGMENT = re.compile(r"[^=/_+-]+")
#: Candidates shorter than the window count from this length on, by a bound in proportion to the most bits they can have.
SHORT_LEAST = 16


@dataclass(frozen=True)
class SecretRules:
    classes: tuple[EntropyClass, ...] = CLASSES
    allow: tuple[str, ...] = ALLOW
    known: tuple[str, ...] = KNOWN
    extra_allow: tuple[str, ...] = field(default=())


def hot_windows(run: str, window: int, bits: float) -> list[tuple[int, int]]:
    """Merged [start, end) stretches of ``run`` in which every window has ``bits`` of entropy or more."""
    if len(run) < window:
        return []
    xlog = [0.0] + [c * math.log2(c) for c in range(1, window + 1)]
    counts: dict[str, int] = {}
    total = 0.0
    # entropy of a window = log2(window) - total / window
    most = window * (math.log2(window) - bits) + 1e-9
    out: list[tuple[int, int]] = []
    for end, ch in enumerate(run, 1):
        if end > window:
            old = run[end - window - 1]
            c = counts[old]
            counts[old] = c - 1
            total += xlog[c - 1] - xlog[c]
        c = counts.get(ch, 0)
        counts[ch] = c + 1
        total += xlog[c + 1] - xlog[c]
        if end >= window and total <= most:
            start = end - window
            if out and start <= out[-1][1]:
                out[-1] = (out[-1][0], end)
            else:
                out.append((start, end))
    return out


class Scanner:
    """Finds ``(kind, start, end)`` in whole texts, in code points."""

    def __init__(self, rules: SecretRules = SecretRules()):
        self.classes = [(re.compile(f"[{c.alphabet}]{{{min(c.window, SHORT_LEAST)},}}"), c) for c in rules.classes]
        self.known = re.compile("|".join(f"(?:{a})" for a in rules.known))
        self.allow = re.compile("|".join(f"(?:{a})" for a in (*rules.allow, *rules.extra_allow)))

    @staticmethod
    def base(text: str) -> list[tuple[str, int, int]]:
        found = [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if m.end(1) - m.start(1) >= ASSIGN_LEAST]
        if "AKIA" in text:
            found += [("access", m.start(), m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= ACCESS_LEAST]
        # a run is maximal either way, so the long ones alone are the same matches
        found += [("hex", m.start(), m.end()) for m in HEX_LONG.finditer(text)]
        return sorted(found, key=lambda x: (x[1], KINDS.index(x[0])))

    def entropy(self, text: str) -> list[tuple[int, int]]:
        spans: list[tuple[int, int]] = []
        for pattern, c in self.classes:
            for m in pattern.finditer(text):
                run = m.group()
                if self.allow.fullmatch(run):
                    continue
                unknown = [x.span() for x in SEGMENT.finditer(run) if not self.known.fullmatch(x.group())]
                if not unknown:
                    continue
                first, end = unknown[0][0], unknown[-1][1]
                n = end - first
                if n < SHORT_LEAST:
                    continue
                window = min(n, c.window)
                at = m.start() + first
                spans += [(at + a, at + b) for a, b in hot_windows(run[first:end], window, c.bits * math.log2(window) / math.log2(c.window))]
        out: list[tuple[int, int]] = []
        for a, b in sorted(spans):
            if out and a <= out[-1][1]:
                out[-1] = (out[-1][0], max(out[-1][1], b))
            else:
                out.append((a, b))
        return out

    def scan(self, text: str) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
        base = self.base(text)
        # Both come by start: a span lies in a base finding if one that begins no later reaches its end.
        more, reach, at = [], -1, 0
        for a, b in self.entropy(text):
            while at < len(base) and base[at][1] <= a:
                reach = max(reach, base[at][2])
                at += 1
            if b > reach:
                more.append(("entropy", a, b))
        return base, sorted([*base, *more], key=lambda x: (x[1], KINDS.index(x[0])))


def joined(found: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in found)


def scan_secrets(docs: DataFrame, text: str = "text", rules: SecretRules = SecretRules(), keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` of ``docs`` (all, if None) with ``secret_spans`` and ``secret_base``.

    Both are arrays of ``struct<kind, start, end>`` in code points, end exclusive,
    ordered by start and kind; base findings are among the spans. One row comes
    out for each row in, whatever is null or repeated: a null or empty text has
    two empty arrays, an empty table gives an empty one. Only the kept columns
    and the text reach Python, and no text is cut. No shuffle takes place.
    Other columns keep their names; columns already called ``secret_spans`` or
    ``secret_base`` are replaced.
    """
    kept = [c for c in (docs.columns if keep is None else keep) if c not in ("secret_spans", "secret_base")]
    span = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
    given = docs.select(*[docs[c] for c in kept], docs[text].alias("__text"))
    schema = T.StructType([*given.schema.fields[:-1], T.StructField("secret_base", span), T.StructField("secret_spans", span)])
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(rules)
        for batch in batches:
            bases, spans = [], []
            for s in batch.column(batch.num_columns - 1):
                b, a = scanner.scan(s.as_py() or "")
                bases.append([dict(zip(("kind", "start", "end"), x)) for x in b])
                spans.append([dict(zip(("kind", "start", "end"), x)) for x in a])
            columns = [*batch.columns[:-1], pa.array(bases, kind), pa.array(spans, kind)]
            yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names[:-1], "secret_base", "secret_spans"])

    return given.mapInArrow(work, schema)


def pieces(scanner: Scanner, text: str) -> list[str]:
    """What stands between findings; what one leaves of a run may be a candidate of its own, so pieces are scanned again."""
    out, done, hit = [], 0, False
    for _, a, b in scanner.scan(text)[1]:
        hit = True
        if b <= done:
            continue
        if a >= done:
            out.append(text[done:a])
        done = b
    return [p for x in (*out, text[done:]) for p in pieces(scanner, x)] if hit else [text]


def redact(docs: DataFrame, text: str = "text", mark: str = "[secret]", rules: SecretRules = SecretRules()) -> DataFrame:
    """``docs`` with every finding in ``text`` replaced by ``mark``; overlapping findings give one mark. Columns and rows stay as they are; a null text stays null."""
    schema, at = docs.schema, docs.columns.index(text)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(rules)
        for batch in batches:
            out = []
            for s in batch.column(at):
                if (t := s.as_py()) is None:
                    out.append(None)
                    continue
                out.append(mark.join(pieces(scanner, t)))
            columns = list(batch.columns)
            columns[at] = pa.array(out, batch.schema.field(at).type)
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    return docs.mapInArrow(work, schema)


def digest(found: list[dict]) -> str:
    return hashlib.sha256(joined([(x["kind"], x["start"], x["end"]) for x in found]).encode()).hexdigest()
