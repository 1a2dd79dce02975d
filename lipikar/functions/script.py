"""Bengali script: logical order of visually ordered tokens, and text repairs.

A run of tokens is treated as a list of syllable parts; each step rewrites the
list as a whole. Tokens are never split.
"""

from __future__ import annotations

import importlib.util
import re
import unicodedata
from collections.abc import Iterable, Mapping
from difflib import SequenceMatcher

from pyspark.sql import Column
from pyspark.sql import functions as F

# Letters and signs of the script.
CONSONANTS = "কখগঘঙচছজঝঞটঠডঢণতথদধনপফবভমযরলশষসহ\u09dc\u09dd\u09df"
VOWELS = "অআইঈউঊঋএঐওঔ"
VOWEL_SIGNS = "ািীুূৃৄেৈোৌ"
PREBASE = "িেৈ"
VIRAMA = "্"
REPH = "র্"
OTHER_MARKS = "ঁংঃ্ৗ়"
AA, E_SIGN, AI_SIGN, O_SIGN, AU_SIGN, AU_LENGTH = "া", "ে", "ৈ", "ো", "ৌ", "ৗ"

_BASES = frozenset(CONSONANTS + VOWELS)
_SIGNS = frozenset(VOWEL_SIGNS)
_MARKS = _SIGNS | frozenset(OTHER_MARKS)
_PRE = frozenset(PREBASE)
_BENGALI = re.compile("[\u0980-\u09ff]")

# Corrections that apply unless a file says otherwise.
DEFAULT_CORRECTIONS = {
    "শঁাখারী": "শাখারী",
    "অন্নপূর্না": "অন্নপূর্ণা",
    "সমর্ত": "সমর্থ",
}


def is_base(token: str) -> bool:
    return not _BASES.isdisjoint(token)


def is_separator(token: str) -> bool:
    return _BENGALI.search(token) is None


def join_reph(run: list[str]) -> list[str]:
    out: list[str] = []
    for t in run:
        if t == VIRAMA and out and out[-1] == "র":
            out[-1] = REPH
        else:
            out.append(t)
    return out


def looks_visual(run: list[str]) -> bool:
    """A run that begins with a pre-base sign, or has a reph after a base, is in visual order."""
    bases = [is_base(t) for t in run]
    return bool(run) and (run[0] in _PRE or any(t == REPH and any(bases[:i]) for i, t in enumerate(run)))


def _splits_vowel(run: list[str], i: int) -> bool:
    """Whether ``run[i]`` is the left half of a vowel sign whose right half follows."""
    return run[i] in (E_SIGN, AI_SIGN) and run[i + 1 : i + 2] in ([AA], [AU_LENGTH])


def prebase_after_base(run: list[str]) -> list[str]:
    """Signs that are drawn before a base go behind it."""
    out: list[str] = []
    todo = list(run)
    while todo:
        if todo[0] not in _PRE:
            out.append(todo.pop(0))
            continue
        if _splits_vowel(todo, 0):
            out += todo[:2]
            del todo[:2]
            continue
        n = 1
        while n < len(todo) and todo[n] in _PRE and not _splits_vowel(todo, n):
            n += 1
        signs, todo = todo[:n], todo[n:]
        at = next((i for i, t in enumerate(todo) if is_base(t)), None)
        if at is None:
            out += signs
        else:
            out += todo[: at + 1] + signs
            del todo[: at + 1]
    return out


def reph_before_base(run: list[str]) -> list[str]:
    """A reph goes before the nearest base to its left."""
    out: list[str] = []
    for t in run:
        at = next((i for i in range(len(out) - 1, -1, -1) if is_base(out[i])), None) if t == REPH else None
        out.insert(len(out) if at is None else at, t)
    return out


def _composed(marks: list[str]) -> list[str]:
    for right, whole in ((AA, O_SIGN), (AU_LENGTH, AU_SIGN)):
        if E_SIGN in marks and right in marks:
            left = list(marks)
            left.remove(E_SIGN)
            left.remove(right)
            return [whole, *left]
    return marks


def _marks_after(run: list[str], at: int) -> list[str]:
    """The marks from ``at`` on: one vowel sign among them, or two where the right half of a sign stands directly behind a left half."""
    end, sign = at, False
    while end < len(run) and run[end] in _MARKS:
        if run[end] in _SIGNS:
            if sign and not (run[end] == AA and run[end - 1] in (E_SIGN, AI_SIGN)):
                break
            sign = True
        end += 1
    return run[at:end]


def compose_vowels(run: list[str]) -> list[str]:
    """The two halves of a vowel sign become one sign, first among the marks of their base."""
    out: list[str] = []
    i = 0
    while i < len(run):
        out.append(run[i])
        i += 1
        if is_base(run[i - 1]):
            marks = _marks_after(run, i)
            i += len(marks)
            cut = marks.index(VIRAMA) if VIRAMA in marks else len(marks)
            out += _composed(marks[:cut]) + marks[cut : cut + 1] + _composed(marks[cut + 1 :])
    return out


def reorder_run(run: list[str], visual: bool) -> list[str]:
    run = join_reph(run)
    if visual or looks_visual(run):
        run = prebase_after_base(run)
    if visual or looks_visual(run):
        run = reph_before_base(run)
    return compose_vowels(run)


def logical_tokens(tokens: Iterable[str], visual: bool = False) -> list[str]:
    """Tokens in logical order; runs end at tokens without a Bengali character."""
    out: list[str] = []
    run: list[str] = []
    for t in tokens:
        if is_separator(t):
            out += reorder_run(run, visual) + [t]
            run = []
        else:
            run.append(t)
    return out + reorder_run(run, visual)


def logical_text(text: str) -> str:
    return "".join(logical_tokens(text))


# --- repairs

_CLASS = f"[{CONSONANTS}]"
# Pattern, replacement, and a text without which it matches nothing, of the structural repairs.
REPAIRS = (
    ("র্(?:র্)+", "র্", "র্র্"),
    (f"(?<![\u0980-\u09ff])([{PREBASE}])({_CLASS})", r"\2\1", None),
    (f"({_CLASS})({_CLASS})র্([{VOWEL_SIGNS}])", r"\1র্\2\3", "র্"),
)


def corrections_in_order(own: Mapping[str, str] | None = None) -> dict[str, str]:
    """Defaults first, overridden in place; then what the file adds. An empty key corrects nothing."""
    return DEFAULT_CORRECTIONS | {w: r for w, r in (own or {}).items() if isinstance(w, str) and isinstance(r, str) and w}


def cleanup(text: str, own: Mapping[str, str] | None = None, renormalize: bool = False) -> str:
    for pattern, replacement, _ in REPAIRS:
        text = re.sub(pattern, replacement, text)
    for wrong, right in corrections_in_order(own).items():
        text = text.replace(wrong, right)
    return unicodedata.normalize("NFC", text) if renormalize else text


def cleanup_column(text: Column, own: Mapping[str, str] | None = None) -> Column:
    """``cleanup`` as built-in functions. A repair's pattern is looked for only in texts that have its fixed part."""

    def repaired(pattern: str, replacement: str, part: str | None):
        return lambda t: F.when(t.contains(part), F.regexp_replace(t, pattern, replacement)).otherwise(t)

    for pattern, replacement, part in REPAIRS:
        replacement = re.sub(r"\\(\d)", r"$\1", replacement)
        if part is None:
            text = F.regexp_replace(text, pattern, replacement)
        else:  # the text is worked out once
            text = F.get(F.transform(F.array(text), repaired(pattern, replacement, part)), F.lit(0))
    for wrong, right in corrections_in_order(own).items():
        text = F.replace(text, F.lit(wrong), F.lit(right))
    return text


# --- choice between the order as drawn and the logical one


def sequence_score(a: list[int], b: list[int]) -> float:
    """Likeness of two glyph sequences: 1 if both are empty, 0 if one is."""
    if not a or not b:
        return float(not a and not b)
    return SequenceMatcher(None, a, b, autojunk=False).ratio()


def can_shape() -> bool:
    """Whether HarfBuzz is installed."""
    return importlib.util.find_spec("uharfbuzz") is not None


def shape(font: bytes | None, text: str) -> list[int] | None:
    """Glyph ids of ``text`` in ``font`` by HarfBuzz; None where that isn't installed or fails."""
    try:
        import uharfbuzz as hb
    except ImportError:
        return None
    try:
        buffer = hb.Buffer()
        buffer.add_str(text)
        buffer.direction, buffer.script, buffer.language = "ltr", "beng", "bn"
        hb.shape(hb.Font(hb.Face(font)), buffer)
        return [g.codepoint for g in buffer.glyph_infos]
    except Exception:  # any fault of a font means that it can't be asked
        return None


#: The logical order must fit the drawn glyphs by so much better to be overruled.
MARGIN = 0.02


def choose(font: bytes | None, drawn: list[int], original: str, logical: str) -> tuple[str, float | None]:
    """(text, score): the original only where shaping says that the logical order fits no better."""
    if not font or original == logical:
        return logical, None
    shapes = shape(font, original), shape(font, logical)
    if None in shapes:
        return logical, None
    before, after = (sequence_score(drawn, s) for s in shapes)
    return (logical, after) if after > before + MARGIN else (original, before)
