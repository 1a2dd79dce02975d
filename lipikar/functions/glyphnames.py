"""Standard glyph names: what they stand for, and the names of the standard Macintosh glyphs by number."""

from __future__ import annotations

import re
import unicodedata

# Names of digits, punctuation and symbols.
SYMBOLS = {
    "space": " ", "exclam": "!", "quotedbl": '"', "numbersign": "#", "dollar": "$", "percent": "%", "ampersand": "&", "quotesingle": "'",
    "parenleft": "(", "parenright": ")", "asterisk": "*", "plus": "+", "comma": ",", "hyphen": "-", "period": ".", "slash": "/",
    "zero": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9",
    "colon": ":", "semicolon": ";", "less": "<", "equal": "=", "greater": ">", "question": "?", "at": "@",
    "bracketleft": "[", "backslash": "\\", "bracketright": "]", "asciicircum": "^", "underscore": "_", "grave": "`",
    "braceleft": "{", "bar": "|", "braceright": "}", "asciitilde": "~",
    "exclamdown": "¡", "cent": "¢", "sterling": "£", "currency": "¤", "yen": "¥", "brokenbar": "¦", "section": "§", "dieresis": "¨",
    "copyright": "©", "ordfeminine": "ª", "guillemotleft": "«", "logicalnot": "¬", "registered": "®", "macron": "¯", "degree": "°",
    "plusminus": "±", "twosuperior": "²", "threesuperior": "³", "acute": "´", "mu": "µ", "paragraph": "¶", "periodcentered": "·",
    "cedilla": "¸", "onesuperior": "¹", "ordmasculine": "º", "guillemotright": "»", "onequarter": "¼", "onehalf": "½",
    "threequarters": "¾", "questiondown": "¿", "multiply": "×", "divide": "÷",
    "AE": "Æ", "ae": "æ", "Eth": "Ð", "eth": "ð", "Oslash": "Ø", "oslash": "ø", "Thorn": "Þ", "thorn": "þ", "germandbls": "ß",
    "OE": "Œ", "oe": "œ", "Lslash": "Ł", "lslash": "ł", "dotlessi": "ı", "dcroat": "đ", "Dcroat": "Đ", "florin": "ƒ", "franc": "₣",
    "circumflex": "ˆ", "caron": "ˇ", "breve": "˘", "dotaccent": "˙", "ring": "˚", "ogonek": "˛", "tilde": "˜", "hungarumlaut": "˝",
    "endash": "–", "emdash": "—", "quoteleft": "‘", "quoteright": "’", "quotesinglbase": "‚", "quotedblleft": "“", "quotedblright": "”",
    "quotedblbase": "„", "dagger": "†", "daggerdbl": "‡", "bullet": "•", "ellipsis": "…", "perthousand": "‰", "guilsinglleft": "‹",
    "guilsinglright": "›", "fraction": "⁄", "Euro": "€", "trademark": "™", "partialdiff": "∂", "summation": "∑", "product": "∏",
    "minus": "−", "radical": "√", "infinity": "∞", "integral": "∫", "approxequal": "≈", "notequal": "≠", "lessequal": "≤",
    "greaterequal": "≥", "pi": "π", "lozenge": "◊", "fi": "ﬁ", "fl": "ﬂ", "Omega": "Ω", "Delta": "∆",
}
# Names of accents and their combining marks.
ACCENTS = {
    "grave": "̀", "acute": "́", "circumflex": "̂", "tilde": "̃", "macron": "̄", "breve": "̆", "dotaccent": "̇",
    "dieresis": "̈", "ring": "̊", "hungarumlaut": "̋", "caron": "̌", "cedilla": "̧", "ogonek": "̨", "commaaccent": "̦",
}
# The last of the standard Macintosh glyphs, from number 226 on.
MAC_LAST = "ŁłŠšŽž¦ÐðÝýÞþ−×¹²³½¼¾₣ĞğİŞşĆćČčđ"

_NAME_OF = {t: n for n, t in SYMBOLS.items()}
_ACCENTED = re.compile(f"([A-Za-z])({'|'.join(ACCENTS)})")


def one_name_text(name: str) -> str | None:
    """What a name without suffix stands for: letters stand for themselves, accented ones are built from letter and accent, Greek ones are called by their letters."""
    if len(name) == 1 and name.isascii() and name.isalpha():
        return name
    if name in SYMBOLS:
        return SYMBOLS[name]
    if (m := _ACCENTED.fullmatch(name)) is not None:
        text = unicodedata.normalize("NFC", m[1] + ACCENTS[m[2]])
        return text if len(text) == 1 else None
    if name.isascii() and name.isalpha() and (name.islower() or name.istitle()):
        greek = "LAMDA" if name.upper() == "LAMBDA" else name.upper()
        try:
            return unicodedata.lookup(f"GREEK {'SMALL' if name.islower() else 'CAPITAL'} LETTER {greek}")
        except KeyError:
            return None
    return None


def standard_text(name: str) -> str | None:
    """What a glyph name stands for: what follows a full stop is left out, parts between underscores stand for their own; None if no part is known."""
    texts = [one_name_text(part) for part in name.split(".")[0].split("_")]
    return "".join(t for t in texts if t) or None


def mac_name(number: int) -> str:
    """The name of a standard Macintosh glyph, 0 to 257: ASCII, then the upper half of that system's character set, then a few more."""
    if number < 3:
        return (".notdef", ".null", "nonmarkingreturn")[number]
    if number == 172:
        return "nonbreakingspace"
    if number == 210:
        return "apple"
    text = chr(number + 29) if number < 98 else bytes([number + 30]).decode("mac_roman") if number < 226 else MAC_LAST[number - 226]
    if text == "€":  # at that place when the names were given
        text = "¤"
    if text in _NAME_OF:
        return _NAME_OF[text]
    parts = unicodedata.normalize("NFD", text)
    return text if len(parts) == 1 else parts[0] + next(n for n, c in ACCENTS.items() if c == parts[1])
