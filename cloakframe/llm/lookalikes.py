"""Letters and spaces that look like plain ones, and the words of a text made comparable."""

from __future__ import annotations

import re
import sys
import unicodedata
from functools import lru_cache

# Letters of other scripts that the eye takes for a Latin one, each above its Latin letter.
CYRILLIC = "АВЕЅІЈКМНОРСТУХЁЇаесһіїјкморѕтухёԁԛԝ"
AS_LATIN = "ABESIJKMHOPCTYXËÏaechiïjkmopstyxëdqw"
GREEK = "ΑΒΕΖΗΙΚΜΝΟΡΤΥΧαγικνορτυχάίόύ"
GREEK_AS_LATIN = "ABEZHIKMNOPTYXayikvoptuxáíóú"
OTHER = "ɡօոս"
OTHER_AS_LATIN = "gonu"
LOOKALIKE = dict(zip(CYRILLIC + GREEK + OTHER, AS_LATIN + GREEK_AS_LATIN + OTHER_AS_LATIN, strict=True))

# Characters without width (soft hyphen, joiners, marks of direction, byte-order mark).
INVISIBLE = (
    "\u00ad\u034f\u061c\u180e\u200b\u200c\u200d\u200e\u200f\u202a\u202b\u202c\u202d\u202e"
    "\u2060\u2061\u2062\u2063\u2064\u2066\u2067\u2068\u2069\ufeff"
)


@lru_cache(1)
def compatibility_forms() -> dict[str, str]:
    """Each character that is a variant of a letter, digit or space, with its plain form.

    Derived from the Unicode data: wide, narrow, font and no-break variants,
    the Latin ligatures, and every space of the class Zs.
    """
    out = {}
    for cp in range(0x80, sys.maxunicode + 1):
        c = chr(cp)
        cat = unicodedata.category(c)
        if cat == "Zs":
            out[c] = " "
            continue
        if cat[0] not in "LN":
            continue
        decomposition = unicodedata.decomposition(c)
        kind = decomposition[1:].split(">")[0] if decomposition.startswith("<") else ""
        if kind in ("wide", "narrow", "font") or kind == "compat" and 0xFB00 <= cp <= 0xFB06:
            plain = unicodedata.normalize("NFKC", c)
            if all(unicodedata.category(x)[0] in "LNM" for x in plain):
                out[c] = plain
    return out


_TABLE: dict[int, str | None] = {}


def folding_table() -> dict[int, str | None]:
    if not _TABLE:
        _TABLE.update({ord(a): b for a, b in compatibility_forms().items()})
        _TABLE.update({ord(a): b for a, b in LOOKALIKE.items()})
        _TABLE.update(dict.fromkeys(map(ord, INVISIBLE)))
        _TABLE.update(dict.fromkeys(map(ord, "'’‘ʼ")))
    return _TABLE


_WORD = re.compile(r"[^\W_]+")
_ODD = re.compile("[^\x00-\x7f\xa1-\xac\xae-\u017f\u2013\u2014\u2018-\u201e\u2022\u2026\u20ac]")


def comparable_words(text: str) -> list[str]:
    """Lower-case words; spacing, punctuation, line breaks and look-alikes do not matter."""
    if not text.isascii():
        if _ODD.search(text):
            text = unicodedata.normalize("NFC", text.translate(folding_table()))
        elif "’" in text or "‘" in text:
            text = text.replace("’", "").replace("‘", "")
    if "'" in text:
        text = text.replace("'", "")
    return _WORD.findall(text.lower())
