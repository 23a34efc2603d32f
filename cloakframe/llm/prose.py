"""Sentences of a text's running prose, with their positions."""

from __future__ import annotations

import re
import unicodedata

from cloakframe.llm.lookalikes import _ODD, folding_table

_BULLET = re.compile(r"(?:[•*\-–·>]|\d+[.)])\s+")
_END = re.compile(r"(?<=[.!?…])[\"”’)]*\s+(?=[“\"'(]?[A-ZÀ-ÞĄ-Ž0-9])")
_WORD = re.compile(r"[^\W\d_]+(?:['’\-][^\W\d_]+)*")
_MARKUP = re.compile(r"<[^<>\n]{1,80}>|&[a-z]{2,6};|\*\*|__|^#+\s", re.M)
_SPACES = re.compile(r"\S")


_TOUCHED = re.compile(rf"{_ODD.pattern}|[\u0300-\u036f\u0483-\u0489\u1ab0-\u1aff\u1dc0-\u1dff\u20d0-\u20ff\ufe20-\ufe2f]")
_KEPT = frozenset("'’‘ʼ")


def folded(text: str) -> tuple[str, list[int] | None]:
    """The text with look-alikes made plain; and, where its length changed, each character's old position."""
    if text.isascii() or not _ODD.search(text):
        return text, None
    table = folding_table()
    out: list[str] = []
    where: list[int] = []
    last = 0
    for m in _TOUCHED.finditer(text):
        for at in range(*m.span()):
            c = text[at]
            plain = c if c in _KEPT else table.get(ord(c), c)
            if at > last:
                out.append(text[last:at])
                where += range(last, at)
            last = at + 1
            if not plain:
                continue
            if out and unicodedata.combining(plain[0]):
                joined = unicodedata.normalize("NFC", out[-1][-1] + plain)
                if len(joined) == 1:
                    out[-1] = out[-1][:-1] + joined
                    continue
            out.append(plain)
            where += [at] * len(plain)
    out.append(text[last:])
    where += range(last, len(text) + 1)
    return "".join(out), where


def prose_sentences(text: str) -> list[tuple[int, int, list[str]]]:
    """(start, end, words) of each sentence of running prose, offsets in the given text.

    Headings, contact lines and lists of names are left out. Hard-wrapped lines
    are joined, a bullet starts its own sentence, and a sentence needs five
    words, at least half of them in lower case, or seven where all are upper case.
    """
    text, where = folded(text)
    if "<" in text or "&" in text or "**" in text or "__" in text or "#" in text:
        text = _MARKUP.sub(lambda m: " " * len(m[0]), text)
    units: list[list[int]] = []
    open_line = wrapped = False
    at = 0
    for line in text.split("\n"):
        body = line.strip()
        start = at + len(line) - len(line.lstrip())
        at += len(line) + 1
        if not body:
            open_line = wrapped = False
            continue
        bullet = _BULLET.match(body)
        end = start + len(body)
        if not bullet and units and (open_line or wrapped and body[0].islower()):
            units[-1][1] = end
        else:
            units.append([start + bullet.end() if bullet else start, end])
        wrapped = body[-1] not in ".!?…:"
        open_line = wrapped and len(body) >= 38
    out = []
    for start, end in units:
        unit = text[start:end]
        if "\n" in unit:
            unit = unit.replace("\n", " ")
        cuts = [0]
        for m in _END.finditer(unit):
            cuts += [m.end(), m.end()]
        cuts.append(len(unit))
        for a, b in zip(cuts[::2], cuts[1::2]):
            sentence = unit[a:b]
            if "@" in sentence or "www." in sentence:
                continue
            words = _WORD.findall(sentence)
            n = len(words)
            if n < 5 or sum(map(sentence.count, "0123456789")) * 4 >= len(sentence):
                continue
            if 2 * sum(map(str.islower, words)) < n:
                if n < 7 or not sentence.isupper():
                    continue
                words = [w.lower() for w in words]
            b = a + len(sentence.rstrip())
            out.append((where[start + a] if where else start + a, where[start + b] if where else start + b, words))
    return out
