"""Personal data in free text: e-mail, phone, identity numbers, street addresses and names.

Detection works on a text with look-alikes made plain and returns offsets in
the text as given. Names are found by their place (head of the record and
signature, introductions, supervisors, referees, citations) and then wherever
the record repeats them. Each item becomes a typed placeholder, and each entity
gets a keyed surrogate of its type: parts of a name keep gender, script and
case, numbers keep their format, addresses of a host keep its ending, and
different entities of a record never share a surrogate. An item counts only
with its surrogate: ``all_items`` draws it, checks it and returns it.
"""

from __future__ import annotations

import hashlib
import hmac
import re
import unicodedata
from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache
from itertools import count

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cloakframe.llm.prose import folded

LABELS = ("EMAIL", "PHONE", "ID", "ADDRESS", "NAME")

_UP, _LOW = "A-ZÀ-ÖØ-ÞĀĂĄĆČĎĐĒĖĘĚĞĢĪĮİĶĹĽŁŃŇŐŒŔŘŚŞŠŢŤŪŮŰŹŻŽΑ-ΫЀ-Я", "^\\W\\d_"

# --- e-mail addresses
_LOCAL = r"(?<![\w.+\-])[\w](?:[\w.+\-]*[\w])?"
_HOST = r"[\w\-]+(?:\.[\w\-]+)+|[\w\-]+\.\s{1,3}(?i:example|test|com|org|net|[a-z]{2})\b|[\w\-]+(?:\s{0,3}[\[({]\s?(?i:dot|punkt|punto|point)\s?[\])}]\s{0,3}[\w\-]+)+|[\w\-]+(?:\s{1,3}(?i:dot)\s{1,3}[\w\-]+)+"
EMAIL = re.compile(rf"{_LOCAL}(?:\s{{0,3}}@\s{{0,3}}(?:{_HOST})|\s{{0,3}}[\[({{]\s?(?i:at|ät|arroba)\s?[\])}}]\s{{0,3}}(?:{_HOST})|\s{{1,3}}(?i:at)\s{{1,3}}[\w\-]+(?:\s{{1,3}}(?i:dot)\s{{1,3}}[\w\-]+)+)")

_MAIL_SIGN = re.compile(r"\s{0,3}(?:@|[\[({]\s?(?i:at|ät|arroba)\s?[\])}]|(?<=\s)(?i:at)(?=\s{1,3}[\w\-]+\s{1,3}(?i:dot)\s))")
_MAIL_LETTERS = frozenset(".+-_")


def emails(text: str) -> Iterator[re.Match]:
    """Matches of ``EMAIL``, tried only at the words before its signs."""
    last = 0
    for sign in _MAIL_SIGN.finditer(text):
        a = sign.start()
        while a > last and (text[a - 1].isalnum() or text[a - 1] in _MAIL_LETTERS):
            a -= 1
        if a < sign.start() and (m := EMAIL.match(text, a)):
            last = m.end()
            yield m


# --- phone numbers
_EXT = r"(?:\s{0,3}(?:ext|Ext|EXT|x|Durchwahl|poste|int|wew)\.?\s{0,3}\d{1,5}\b)?"
_GAP = r"(?:[ \t]{1,2}|[.\-/])?"
PHONE = re.compile(rf"(?<![\w#+/.\-])(?:\+\d{{1,3}}|\(0\d{{1,4}}\)|0\d)(?:{_GAP}(?:\(\d{{1,4}}\)|\d{{1,7}})){{1,7}}(?![\w/]|[.\-]\d){_EXT}")

# --- identity numbers, by shape; the last shapes count after a keyword only
_STRONG_ID = r"\d{4}-\d{4}-\d{4}-\d{3}[\dX]|[A-Z]{2}\d{2}(?:[ ]{1,3}[0-9A-Z]{4}){2,7}(?:[ ]{1,3}[0-9A-Z]{1,3})?|#\d{6,9}"
_WEAK_ID = r"\d{2}/\d{3}/\d{5}|\d{6}-\d{3}[A-Z0-9]|[A-Z]{1,2}\d{6,9}[A-Z]?|[A-Z]{2}(?:[ ]{1,3}\d{2}){3}[ ]{1,3}[A-Z]|\d{3}-\d{2}-\d{4}|\d{7,12}"
STRONG_ID = re.compile(rf"(?<![\w\-/])(?:{_STRONG_ID})(?![\w\-/])")
# Stems of the words that announce an identity number.
ID_STEMS = (
    "passport passeport pasaporte passaport paszport paspoort passnr passin insurance sécurité seguridad tax fiscal fiscaal steuer skatte vero "
    "podatk contribuinte staff personal personeel kadrow ewidenc henkilöst anställn matricul matricol interno ficha identi ausweis burgern "
    "medborgar kansalais cidadão codice partita rentenvers licence member account badge"
).split()
KEYED_ID = re.compile(
    rf"(?i:\b(?:{'|'.join(ID_STEMS)})[^\W\d_]*)(?:[ \t]+[^\W\d_]+){{0,3}}[ \t.:#]*?(?:(?i:no|nr|n|nro|number)\.?)?[ \t]*:?[ \t]*((?<![\w\-/])(?:{_STRONG_ID}|{_WEAK_ID})(?![\w\-/]))"
)

_ID_VALUE = re.compile(rf"(?<![\w\-/])(?:{_STRONG_ID}|{_WEAK_ID})(?![\w\-/])")
_KEY_WORDS = 8  # words before a value among which its keyword must begin: itself, three more, a word for number, and signs


def keyed_ids(text: str) -> Iterator[tuple[int, int]]:
    """Values of ``KEYED_ID``, its keyword looked for only before what has the form of a value."""
    last = 0
    for value in _ID_VALUE.finditer(text):
        a = value.start()
        for _ in range(_KEY_WORDS):
            while a > last and text[a - 1].isspace():
                a -= 1
            while a > last and not text[a - 1].isspace():
                a -= 1
        for m in KEYED_ID.finditer(text, a, min(len(text), value.end() + 40)):
            if m.start(1) >= last and m.start(1) <= value.start():
                yield m.span(1)
                last = m.end()


# --- street addresses
_STREET = rf"[{_UP}][{_LOW}]+(?:[-'’ ][{_UP}][{_LOW}]+)?"
_NO = r"\d{1,4}(?:[a-z]\b)?"
_SP = r"[ \t  ]{1,3}"
#: Address shapes by tradition; each with words of which a text must hold one for the shape to be tried.
ADDRESS = tuple(
    (words, re.compile(shape))
    for words, shape in (
        (
            ("road", "lane", "terrace", "mews", "street", "avenue", "close", "drive", "way", "court", "place", "gardens"),
            rf"(?:(?i:Flat|Apt\.?|Unit){_SP}\d{{1,4}}[a-z]?,?{_SP})?\d{{1,4}}[a-z]?{_SP}{_STREET}{_SP}(?i:Road|Lane|Terrace|Mews|Street|Avenue|Close|Drive|Way|Court|Place|Gardens)\b",
        ),
        (
            ("rue", "chemin", "impasse", "allée", "avenue", "boulevard", "quai", "place"),
            rf"\d{{1,4}}(?:{_SP}(?i:bis|ter))?,?{_SP}(?i:rue|chemin|impasse|allée|avenue|boulevard|quai|place)(?:{_SP}(?i:de la|des|du|de|d'))?{_SP}?{_STREET}(?:,{_SP}(?i:bâtiment|appartement|étage){_SP}\w{{1,4}})?",
        ),
        (
            ("calle", "avda.", "avenida", "camino", "plaza", "paseo", "rua", "travessa", "largo", "estrada", "praça", "via", "corso", "vicolo", "piazza", "viale"),
            rf"(?i:Calle|Avda\.|Avenida|Camino|Plaza|Paseo|Rua|Travessa|Largo|Estrada|Praça|Via|Corso|Vicolo|Piazza|Viale)(?:{_SP}(?i:de la|de los|de|del|da|do|dos|das|della|dei))?{_SP}{_STREET},?{_SP}{_NO}(?:,{_SP}(?:(?i:piso|scala|interno|puerta|andar){_SP}\w{{1,4}}|\d{{1,3}}\.?[ºª]?{_SP}(?i:esq|dto|dir|frente)\b\.?))?",
        ),
        (
            ("ul.", "al.", "os.", "pl."),
            rf"(?<!\w)(?i:ul|al|os|pl)\.{_SP}{_STREET}{_SP}{_NO}(?:/\d{{1,4}})?(?:{_SP}(?i:m)\.{_SP}\d{{1,4}})?",
        ),
        (
            ("straße", "strasse", "gasse", "platz", "allee", "weg", "ufer", "ring", "laan", "kade", "steeg", "straat", "plein", "gracht", "katu", "kuja", "polku", "tie", "gatan", "vägen", "gränd", "backen", "stigen"),
            rf"(?:(?i:Östra|Västra|Norra|Södra|Stora|Lilla|Gamla|Nya|Alte|Neue|Große|Kleine|Oude|Nieuwe){_SP})?[{_UP}][{_LOW}]*(?i:straße|strasse|gasse|platz|allee|weg|ufer|ring|laan|kade|steeg|straat|plein|gracht|katu|kuja|polku|tie|gatan|vägen|gränd|backen|stigen){_SP}{_NO}(?:-\d{{1,4}})?(?:{_SP}[A-Z]{_SP}\d{{1,3}})?(?:,{_SP}(?:\d{{1,3}}\.{_SP}(?i:Stock|Etage|OG)\b|(?i:uppg|lgh|vån)\.{_SP}\w{{1,4}}))?",
        ),
        (
            (" tor ", " markt ", " platz ", " hof ", " berg ", " graben ", " ring "),
            rf"(?<!\w)(?i:Am|An der|Im|Zum){_SP}{_STREET}{_SP}(?i:Tor|Markt|Platz|Hof|Berg|Graben|Ring){_SP}{_NO}",
        ),
        (
            ("achter de ", "achter het ", "op de ", "bij de "),
            rf"(?<!\w)(?i:Achter de|Achter het|Op de|Bij de){_SP}{_STREET}{_SP}{_NO}(?:-\d{{1,4}})?",
        ),
    )
)


_COMPOUND = ("straße", "strasse", "gasse", "platz", "allee", "weg", "ufer", "ring", "laan", "kade", "steeg", "straat", "plein", "gracht", "katu", "kuja", "polku", "tie", "gatan", "vägen", "gränd", "backen", "stigen")
_BEFORE_NUMBER = re.compile(rf"(?<=[^\W\d_]){_SP}(?=\d)")


def compound_streets(text: str, shape: re.Pattern) -> Iterator[re.Match]:
    """Matches of a shape whose street names end in one of ``_COMPOUND``, tried only around such a word before a number."""
    last = 0
    for m in _BEFORE_NUMBER.finditer(text):
        a = m.start()
        while a > last and text[a - 1].isalpha():
            a -= 1
        if text[a : m.start()].lower().endswith(_COMPOUND):
            for found in shape.finditer(text, max(last, a - 12), min(len(text), m.end() + 80)):
                if found.end() > m.end() and found.start() < m.start():
                    last = found.end()
                    yield found


def addresses(text: str, low: str) -> list[tuple[int, int]]:
    """Spans of street addresses, leftmost first, without overlap; ``low`` is the text in lower case with single spaces."""
    found = sorted(m.span() for words, shape in ADDRESS if any(w in low for w in words) for m in (compound_streets(text, shape) if words[0] == _COMPOUND[0] else shape.finditer(text)))
    out: list[tuple[int, int]] = []
    for a, b in found:
        if not out or a >= out[-1][1]:
            out.append((a, b))
    return out


# --- names
_TOKEN = rf"[{_UP}][{_LOW}]+(?:[-'’­][{_UP}]?[{_LOW}]+)*"
_INITIAL = rf"[{_UP}]\.(?:-?[{_UP}]\.)*"
_PARTICLE = r"(?i:van|von|de|der|den|dos|das|da|do|del|della|di|la|le|af|zu|zum|ten|ter)"
NAME = rf"(?:{_PARTICLE}[ \t]{{1,3}}){{0,2}}(?:{_TOKEN}|{_INITIAL})(?:[ \t  ]{{1,3}}(?:{_PARTICLE}[ \t]{{1,3}}){{0,2}}(?:{_TOKEN}|{_INITIAL})){{0,3}}"
FULL = rf"(?:{_PARTICLE}[ \t]{{1,3}}){{0,2}}(?:{_TOKEN}|{_INITIAL})(?:[ \t  ]{{1,3}}(?:{_PARTICLE}[ \t]{{1,3}}){{0,2}}(?:{_TOKEN}|{_INITIAL})){{1,3}}"
# Titles and forms of address.
TITLES = "Mr Mrs Ms Miss Dr Prof Dra Don Doña Herr Frau Herrn Mme Mlle Mevr Dhr Mw Eng Sig Sig.ra Sr Sra Dott Dott.ssa Pan Pani tri fru rouva inż mgr".split()
_M = rf"M\.[ \t]{{1,3}}(?=(?:{_TOKEN}|{_INITIAL})[ \t]{{1,3}}{_TOKEN})"  # before a full name only; else it is an initial
_ONE_TITLE = rf"(?:(?i:{'|'.join(re.escape(t) for t in sorted(TITLES, key=len, reverse=True))})\b\.?[ \t  ]{{1,3}}|{_M})"
_TITLE = rf"{_ONE_TITLE}{{0,2}}"
# Phrases after which a person introduces themself (first line needs a full name), or names a superior.
INTRODUCTION = (
    "My name is|Ich heiße|Mein Name lautet|Mein Name ist|Mi nombre es|Me llamo|Mon nom est|Je me présente :|Je m'appelle|Il mio nome è|Mi chiamo|Ik heet|"
    "Mijn naam luidt|Mijn naam is|Chamo-me|O meu nome é|Nazywam się|Mitt namn är|Jag heter|Nimeni on|Minun nimeni on"
)
BEING = "I am|Ich bin|Soy|Je suis|Sono|Ik ben|Sou|Jestem|Jag är|Olen"
SUPERIOR = "reported to|Vorgesetzt war mir|rendais compte à|responsable era|Riferivo a|chef was|respondia a|przełożonym był|przełożoną była|chef var|Esimieheni oli|I worked under"
LOOKED_AFTER = (
    "looked after my|a suivi mon|a suivi ma|begeleidde mijn|hat meine|hat mein|orientou o|orientou a|dirigió mi|ha seguito il|ha seguito la|handledde mitt|handledde min|prowadziła moj|prowadził moj|ohjasi loppu|ohjasi lopp|supervised my"
)
COMPANY = r"Group|Ltd|plc|& Sons|GmbH|AG|KG|SA|SARL|et Fils|S\.?L|S\.?A|S\.?p\.?A|S\.?r\.?l|B\.?V|N\.?V|Lda|Sp\. z o|AB|Oy|Oyj|Inc|LLC"


_LEADING = re.compile(rf"{_ONE_TITLE}+")
_TRAILING = re.compile(r"(?<=[a-zß-ÿ])[ \t]+(?:AND|UND|ET|EN|OCH|JA)$")


def _spaces(pattern: str) -> str:
    return pattern.replace(" ", r"\s{1,3}")


_INTRO_FORMS = tuple((x.lower(), x) for x in INTRODUCTION.split("|"))
_BEING_FORMS = tuple((x.lower(), x) for x in BEING.split("|"))


@lru_cache(4096)
def _introductions(named: tuple[str, ...], being: tuple[str, ...]) -> re.Pattern:
    """The pattern of introductions by the phrases that a text holds."""
    forms = []
    if named:
        forms.append(rf"(?i:{_spaces('|'.join(named))})[ \t  ]{{1,3}}{_TITLE}({NAME}|{FULL})")
    if being:
        forms.append(rf"(?<!\w)(?i:{_spaces('|'.join(being))})[ \t  ]{{1,3}}{_TITLE}({FULL})")
    return re.compile("|".join(forms))


_SUPERIOR = re.compile(rf"(?i:{_spaces(SUPERIOR)})[ \t  ]{{1,3}}{_TITLE}({FULL}|{NAME})")
_AFTER = re.compile(rf"(?:^|(?<=[.!?]\s)|(?<=[•*\-]\s)){_TITLE}({FULL}|{NAME})[ \t  ]{{1,3}}(?i:{_spaces(LOOKED_AFTER)})", re.M)
_SUPERIOR_CUES = tuple(x.lower() for x in SUPERIOR.split("|"))
_AFTER_CUES = tuple(x.lower() for x in LOOKED_AFTER.split("|"))
_REFEREE = re.compile(rf"^[ \t]*(?:[•*\-–][ \t]+)?{_TITLE}({FULL}|{NAME}),[ \t  ]{{1,3}}(?=[^\n]{{0,60}}?(?:(?<!\w)(?i:{COMPANY})(?!\w)))", re.M)
_LETTER = rf"(?:[{_LOW}]|-)"
_SPACED = re.compile(rf"^[ \t]*((?:{_LETTER}[ ]){{2,}}{_LETTER}(?:[ ]{{2,6}}(?:{_LETTER}[ ]){{1,}}[{_LOW}])+)(?=\s*(?:$|[|–\-,]))")
_HEAD = re.compile(rf"^[ \t]*{_TITLE}({FULL})(?=[ \t  ]*(?:$|[|–,·/]|[ ]-[ ]))")
_SURNAME_FIRST = re.compile(rf"^[ \t]*((?:{_PARTICLE}[ \t]{{1,3}}){{0,2}}{_TOKEN},[ \t  ]{{1,3}}(?:{_TOKEN}(?:[ \t]{_TOKEN}|[ \t]{_INITIAL})?|{_INITIAL}))(?=[ \t]*(?:$|[|–,·/]|[ ]-[ ]))")
_CITED = re.compile(r"^[ \t•*\-–]*((?:[^\n()@\d]){4,}?)[ \t  ]{0,3}\((?:19|20)\d\d[a-z]?\)[:.,]", re.M)
_AUTHOR = re.compile(rf"((?:{_PARTICLE}[ \t]{{1,3}}){{0,2}}{_TOKEN},[ \t  ]{{1,3}}{_INITIAL}|{_INITIAL}[ \t  ]{{0,3}}(?:{_PARTICLE}[ \t]{{1,3}}){{0,2}}{_TOKEN}|(?:{_PARTICLE}[ \t]{{1,3}}){{0,2}}{_TOKEN}[ \t  ]{{1,3}}[{_UP}]{{1,2}}\b(?!\.))")
_INSIDE = re.compile(r"[\w.@\-]")
_NOT_AFTER = re.compile(r"[\w@\-]|\.\w|\s(?:&|plc\b|Ltd\b|Group\b|GmbH\b|AG\b)", re.I)
_RULE = re.compile(r"^[ \t]*(?:-{3,}|_{3,}|\*{3,})[ \t]*$")
_ROLE = re.compile(rf"^[^\n]{{0,4}}(?:\d{{2}}/\d{{4}}|\d{{4}}\s{{0,3}}[-–]\s{{0,3}}\d{{4}}),?\s{{1,4}}([^\n,]{{3,40}}),\s", re.M)


def _squeezed(text: str) -> str:
    return " ".join(text.lower().split())


_SPACE_RUN = re.compile(r"\s{1,3}")
_OTHER_SPACE = re.compile(r"\s{2,3}|[^\S ]")


def _single_spaced(text: str) -> tuple[str, list[int], list[int]]:
    """The text with one space for each 1 to 3 white-space characters, the positions behind shortened ones, and what to add from each on."""
    at, shift = [], [0]
    for m in _OTHER_SPACE.finditer(text):
        if m.end() - m.start() > 1:
            at.append(m.start() - shift[-1] + 1)
            shift.append(shift[-1] + m.end() - m.start() - 1)
    return _OTHER_SPACE.sub(" ", text), at, shift


def find_names(text: str, taken: list[tuple[int, int, str]], low: str) -> list[tuple[int, int]]:
    """Spans of names in a text with plain letters; ``taken`` spans hold other items, ``low`` is the squeezed text."""
    roles = {" ".join(m[1].split()).lower() for m in _ROLE.finditer(text)}
    out: list[tuple[int, int]] = []

    def free(a: int, b: int) -> bool:
        return not any(a < y and x < b for x, y, _ in taken) and " ".join(text[a:b].split()).lower() not in roles

    def add(a: int, b: int) -> None:
        title = _LEADING.match(text, a, b)
        if title and title.end() < b:
            a = title.end()
        if tail := _TRAILING.search(text[a:b]):
            b = a + tail.start()
        if b > a and free(a, b) and not any(a < y and x < b for x, y in out):
            out.append((a, b))

    named, being = (tuple(x for c, x in forms if c in low) for forms in (_INTRO_FORMS, _BEING_FORMS))
    tried = [_introductions(named, being)] if named or being else []
    tried += [pattern for cues, pattern in ((_SUPERIOR_CUES, _SUPERIOR), (_AFTER_CUES, _AFTER)) if any(c in low for c in cues)]
    for pattern in tried:
        for m in pattern.finditer(text):
            k = next(k for k in range(1, len(m.groups()) + 1) if m[k])
            add(m.start(k), m.end(k))
    lines, at = [], 0
    for line in text.split("\n"):
        lines.append((at, line))
        at += len(line) + 1
    head = 2
    for start, line in lines:
        if _RULE.match(line):
            head = 1
            continue
        if not line.strip():
            continue
        if head > 0:
            head -= 1
            for pattern in (_SPACED, _SURNAME_FIRST, _HEAD):
                m = pattern.match(line)
                if m and free(start + m.start(1), start + m.end(1)) and not re.search(r"\d|@", m[1]) and not _company_follows(line, m.end(1)):
                    add(start + m.start(1), start + m.end(1))
                    head = 0
                    break
    for m in _CITED.finditer(text):
        authors = [*_AUTHOR.finditer(text, m.start(1), m.end(1))]
        left = text[m.start(1) : m.end(1)]
        for x in authors:
            left = left.replace(x[1], "")
        if authors and not re.search(r"[^\W\d_]{4,}", left):
            for x in authors:
                add(x.start(1), x.end(1))
    for m in _REFEREE.finditer(text):
        add(m.start(1), m.end(1))
    names = {(a, b) for a, b in out if " " in text[a:b].strip()}
    if names:
        lower = text.lower()
        if len(lower) != len(text):
            lower = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
        close, at, shift = _single_spaced(lower)
        for name in {_SPACE_RUN.sub(" ", lower[a:b]) for a, b in names}:
            if all(len(p) == 1 for p in name.split()):
                continue
            k = close.find(name)
            while k >= 0:
                last = k + len(name)
                start, end = k + shift[bisect_right(at, k)], last + shift[bisect_right(at, last - 1)]
                if not (start and _INSIDE.match(text[start - 1])) and not _NOT_AFTER.match(text, end):
                    add(start, end)
                k = close.find(name, last)
    return out


def _company_follows(line: str, end: int) -> bool:
    return re.match(rf"\s{{0,3}}(?:{COMPANY})(?!\w)", line[end:]) is not None


def _overlaps(a: int, b: int, spans: list[tuple[int, int, str]]) -> bool:
    return any(a < y and x < b for x, y, _ in spans)


def _phone_ok(number: str) -> bool:
    digits = sum(map(str.isdigit, re.split(r"(?i)ext|x", number)[0]))
    return (9 if number.startswith("+") else 10) <= digits <= 15 and not re.fullmatch(r"\d{2}/\d{3}/\d{5}|\d{4}-\d{4}-\d{4}-\d{3}[\dX]?|\d{1,2}[./]\d{1,2}[./]\d{4}.*", number)


def detect(text: str | None) -> list[tuple[int, int, str]]:
    """(start, end, label) of every item, in order and without overlap, offsets in the text as given."""
    if not text:
        return []
    plain, where = folded(text)
    spans: list[tuple[int, int, str]] = []
    for m in emails(plain):
        spans.append((*m.span(), "EMAIL"))
    for a, b in keyed_ids(plain):
        if not _overlaps(a, b, spans) and not re.fullmatch(r"0\d{9}", plain[a:b]):
            spans.append((a, b, "ID"))
    for m in STRONG_ID.finditer(plain):
        if not _overlaps(*m.span(), spans):
            spans.append((*m.span(), "ID"))
    low = _squeezed(plain)
    for a, b in addresses(plain, low):
        if not _overlaps(a, b, spans):
            spans.append((a, b, "ADDRESS"))
    for m in PHONE.finditer(plain):
        if _phone_ok(m[0]) and not _overlaps(*m.span(), spans):
            spans.append((*m.span(), "PHONE"))
    spans += [(a, b, "NAME") for a, b in find_names(plain, spans, low)]
    return [_given(text, where, x) for x in sorted(spans)]


def _given(text: str, where: list[int] | None, span: tuple[int, int, str]) -> tuple[int, int, str]:
    a, b, label = span
    if where:
        a, b = where[a], where[b - 1] + 1
        while b < len(text) and unicodedata.combining(text[b]):
            b += 1
    return a, b, label


# Wrappings that a report puts around a leaked item.
_BEFORE = re.compile(r"^\s*(?:(?:seen as|line:|still there:|found:|near)\s+)?[\"“'(\[]?\s*", re.I)
_BEHIND = re.compile(r"[\"”')\],;:\s]*(?:,\s*page\s+\d+|\s+again)?[\"”')\],;:\s]*$", re.I)


def detect_leak(text: str | None, label: str | None, names: set[str]) -> tuple[int, int, str] | None:
    """The item in a short report text: by shape, else as a name if so labelled or known from the record."""
    if not text:
        return None
    plain, where = folded(text)
    a = _BEFORE.match(plain).end()
    b = a + _BEHIND.search(plain[a:]).start()
    core = plain[a:b]
    if not core:
        return None
    streets = addresses(plain, f" {_squeezed(plain)} ")
    for found, kind in ((EMAIL.search(plain), "EMAIL"), (STRONG_ID.search(plain), "ID"), (streets, "ADDRESS"), (PHONE.search(plain), "PHONE")):
        if found and not (kind == "PHONE" and not _phone_ok(found[0])):
            return _given(text, where, (*(found[0] if kind == "ADDRESS" else found.span()), kind))
    if re.fullmatch(_WEAK_ID, core) and label in (None, "OTHER", "ID"):
        return _given(text, where, (a, b, "ID"))
    title = re.match(rf"{_TITLE}", core).end()
    known = " ".join(core[title:].split()).lower() in names
    if label == "NAME" or known:
        return _given(text, where, (a + title, b, "NAME"))
    if label in ("ID", "PHONE", "EMAIL", "ADDRESS") and (label not in ("ID", "PHONE") or sum(map(str.isdigit, core)) >= 5):
        return _given(text, where, (a, b, label))
    return None


def name_key(name: str) -> str:
    """Lower-case letters of a name; letter-spaced names are closed up."""
    parts = folded(name)[0].split()
    return ("".join(parts) if parts and all(len(p) == 1 for p in parts) else " ".join(parts)).lower()


PARTICLES = frozenset("van von de der den dos das da do del della di la le af zu zum ten ter".split())
# Titles and forms of address that tell a gender, and given names of men that end in a.
SHE = re.compile(r"(?i)\b(?:ms|mrs|miss|frau|mme|mlle|sra|dra|doña|dott\.ssa|sig\.ra|pani|mevr|fru|rouva|née)\b\.?\s*$")
HE = re.compile(r"(?i)\b(?:mr|herr|herrn|m|sr|don|sig|pan|dhr)\b\.?\s*$")
MEN_IN_A = frozenset("luca andrea nicola mattia elia enea mika jukka pekka esa ilkka juha sasha kuba barnaba joshua ezra noa costa никита илья фома лука".split())
_SCRIPTS = tuple((chr(lo), chr(hi)) for lo, hi in ((0x41, 0x24F), (0x370, 0x3FF), (0x400, 0x52F), (0x531, 0x586), (0x5D0, 0x5EA), (0x620, 0x64A), (0x904, 0x939), (0x10D0, 0x10F0), (0x3041, 0x3096), (0x30A1, 0x30FA), (0x4E00, 0x9FFF), (0xAC00, 0xD7A3)))


class Surrogates:
    """Keyed replacements within one record: same entity, same replacement; different entities, different ones.

    The key is secret; with ``record`` None the same name gets the same
    surrogate in every record, else records cannot be linked by theirs.
    """

    FEMALE = ("Alma", "Berta", "Cora", "Delia", "Edda", "Flora", "Greta", "Hanna", "Ida", "Jana", "Karla", "Lina", "Marta", "Nora", "Olga", "Paula", "Rosa", "Silvia", "Tilda", "Vera")
    MALE = ("Adam", "Bruno", "Carlo", "David", "Edgar", "Felix", "Georg", "Hugo", "Ivan", "Jakob", "Konrad", "Leo", "Martin", "Nils", "Oskar", "Paul", "Robert", "Simon", "Theo", "Viktor")
    EITHER = ("Alex", "Robin", "Kim", "Charlie", "Sascha", "Dominique", "Noel", "Toni", "Luca", "Mika", "Sam", "Jona", "Chris", "Kai", "Eli", "Nico", "Jules", "Andrea", "Remy", "Pat")
    SYLLABLES = ("bal", "cor", "den", "fal", "gar", "hel", "kol", "lam", "mor", "nal", "pol", "ras", "sel", "tor", "var", "wen")

    def __init__(self, key: bytes, record: str | None):
        self.key, self.record = key, record or ""
        self.made: dict[tuple[str, str], str] = {}
        self.used: set[str] = set()

    def _number(self, kind: str, value: str, draw: int) -> int:
        message = f"{kind}\x1f{value}\x1f{self.record}\x1f{draw}".encode()
        return int.from_bytes(hmac.new(self.key, message, hashlib.sha256).digest()[:16], "big")

    def _draw(self, kind: str, value: str, make, longer: bool = False) -> str:
        """The entity's surrogate, drawn again until no other entity has it; ``longer`` ones gain a syllable after 50 draws."""
        if (kind, value) not in self.made:
            for draw in count():
                n = self._number(kind, value, draw)
                out = make(n)
                if longer and draw >= 50:
                    out += "".join(self.SYLLABLES[n >> 8 * k & 15] for k in range(draw // 50))
                if out.lower() not in self.used and out.lower() != value or draw >= 1_000 and not longer:
                    break
            self.used.add(out.lower())
            self.made[kind, value] = out
        return self.made[kind, value]

    def _cased(self, like: str, word: str) -> str:
        return word.upper() if like.isupper() and len(like) > 1 else word.lower() if like.islower() else word[:1].upper() + word[1:].lower()

    def _lettered(self, like: str, n: int) -> str:
        """Other letters of the same script for a word that is not Latin; its length and signs stay."""
        lo, hi = next(((a, b) for a, b in _SCRIPTS if a <= like[0] <= b), (like[0], like[0]))
        letters = [c for c in map(chr, range(ord(lo), min(ord(hi), ord(lo) + 400) + 1)) if c.isalpha() and c == c.lower()]
        out = []
        for _ in like:
            n, k = divmod(n or self._number("letters", like, len(out)), max(1, len(letters)))
            out.append(letters[k] if letters else like[0])
        return "".join(out)

    def name(self, text: str, before: str) -> str:
        """Token by token, so a surname alone or initials still belong to the full name's surrogate."""
        spaced = all(len(p) == 1 for p in text.split())
        if spaced:
            words = [w.replace(" ", "") for w in re.split(r" {2,}", text)]
            return "  ".join(" ".join(w.upper()) for w in self.name(" ".join(w.title() for w in words), before).split())
        tokens = re.findall(r"[^\W\d_]+", text)
        first = next((t for t in tokens if len(t) > 1), "")

        def one(m: re.Match) -> str:
            t = m[0]
            low = t.lower()
            if len(t) == 1 and t.upper() != low:
                known = next((v for (kind, value), v in self.made.items() if kind == "part" and value[:1] == low), None)
                return (known or self._draw("initial", low, lambda n: "ABCDEFGHIJKLMNOPRSTUVWZ"[n % 23]))[:1].upper()
            if low in PARTICLES:
                return t
            if not ("A" <= t[0] <= "\u024f"):
                return self._cased(t, self._draw("part", low, lambda n: self._lettered(t, n))) if t.upper() != low else self._draw("part", t, lambda n: self._lettered(t, n))
            if t == first and len(tokens) > 1:
                she = SHE.search(before[-12:]) or not HE.search(before[-12:]) and low[-1] == "a" and low not in MEN_IN_A
                he = HE.search(before[-12:]) or low in MEN_IN_A or low[-1] in "or" or low[-2:] in ("us", "as")
                names = self.FEMALE if she else self.MALE if he else self.EITHER
                return self._cased(t, self._draw("part", low, lambda n: names[n % len(names)], True))
            make = lambda n: self.SYLLABLES[n % 16].title() + self.SYLLABLES[n // 16 % 16] + ("" if n % 3 else self.SYLLABLES[n // 256 % 16])
            return self._cased(t, self._draw("part", low, make, True))

        return re.sub(r"[^\W\d_]+", one, text)

    def formatted(self, kind: str, text: str) -> str:
        """Digits for digits and letters for letters; a phone's prefix and all signs stay."""
        keep = len(re.match(r"\+\d{2}|00\d{2}|\(?0", text)[0]) if kind == "PHONE" and re.match(r"\+\d{2}|00\d{2}|\(?0", text) else 0

        def make(n: int) -> str:
            out = []
            for c in text[keep:]:
                n, k = divmod(n, 26) if n else (self._number(kind, text + "".join(out), 1), 7)
                out.append(str(k % 10) if c.isdigit() else chr((65 if c.isupper() else 97) + k) if c.isalpha() and kind == "ID" else c)
            return text[:keep] + "".join(out)

        return self._draw(kind, re.sub(r"\W", "", text).lower(), make)

    def email(self, text: str) -> str:
        """Its words replaced one by one, those of the record's names as there; joints, spelled signs and the host's ending stay."""
        value = canonical("EMAIL", text)
        words = [*re.finditer(r"[^\W_]+", text)]
        spelled = {m.start(1) for m in _SPELLED.finditer(text)}

        def build(initials: bool) -> str:
            out, at = [], 0
            for k, m in enumerate(words):
                word, new = m[0], m[0]
                if k < len(words) - 1 and m.start() not in spelled:
                    begun = next((v for (kind, p), v in self.made.items() if kind == "part" and p[:1] == word.lower()), None) if initials and len(word) == 1 else None
                    new = self.made.get(("part", word.lower())) or (begun or "")[:1]
                    new = new or self._draw("mail", word.lower(), lambda n: self.SYLLABLES[n % 16] + self.SYLLABLES[n // 16 % 16] + ("" if n % 3 else self.SYLLABLES[n // 256 % 16]), True)
                    new = self._cased(word, new)
                out += [text[at : m.start()], new]
                at = m.end()
            return "".join([*out, text[at:]])

        if ("EMAIL", value) not in self.made:
            new = build(True)
            if canonical("EMAIL", new) in self.used:
                new = build(False)
            self.used.add(canonical("EMAIL", new))
            self.made["EMAIL", value] = new
        known = self.made["EMAIL", value]
        return known if [*re.finditer(r"[\W_]+", known)] == [*re.finditer(r"[\W_]+", text)] else build(canonical("EMAIL", build(True)) == canonical("EMAIL", known))

    def address(self, text: str) -> str:
        def make(n: int) -> str:
            street = self.SYLLABLES[n % 16].title() + self.SYLLABLES[n // 16 % 16]
            longest = max(re.findall(rf"[{_UP}][{_LOW}]+", text) or [""], key=len)
            out = text.replace(longest, street + (re.search(r"(?:straße|gasse|weg|laan|kade|steeg|kuja|polku|tie|gatan|vägen|gränd|backen)$", longest) or [""])[0], 1) if longest else text
            return re.sub(r"\d+", lambda m: str(1 + (n >> 9) % (10 ** len(m[0]) - 1)), out)

        return self._draw("ADDRESS", re.sub(r"\W+", " ", text).lower(), make)

    def replace(self, label: str, text: str, before: str) -> str:
        if label == "NAME":
            return self.name(text, before)
        return self.email(text) if label == "EMAIL" else self.address(text) if label == "ADDRESS" else self.formatted(label, text)


_SPELLED = re.compile(r"(?i)[\s\[({]+(at|ät|arroba|dot|punkt|punto|point)(?=[\s\])}])")
_SIGN = re.compile(r"(?i)[\s\[({]+(?:(at|ät|arroba)|dot|punkt|punto|point)[\s\])}]+")


def canonical(label: str, text: str) -> str:
    """What two mentions of one entity have in common: case, spacing, signs and the spelling of addresses aside."""
    if label == "NAME":
        return name_key(text)
    if label == "EMAIL":
        return re.sub(r"\s", "", _SIGN.sub(lambda m: "@" if m[1] else ".", text)).lower()
    return re.sub(r"\W", "", text).lower()


def shape(text: str) -> str:
    """A value's format: 9 for digits, A and a for letters, all other signs as they are."""
    return re.sub(r"[^\W\d_]", lambda m: "A" if m[0].isupper() else "a", re.sub(r"\d", "9", text))


def _name_words(text: str) -> list[str]:
    spaced = all(len(p) == 1 for p in text.split())
    return re.split(r"\s{2,}", text.strip()) if spaced else text.split()


def fits(label: str, text: str, fake: str) -> bool:
    """Whether a surrogate has its entity's type: format of numbers, words and case of names, signs of addresses, and is another value."""
    if label in ("PHONE", "ID"):
        return shape(fake) == shape(text) and (fake != text or not any(map(str.isalnum, text)))
    if label == "NAME":
        return len(_name_words(fake)) == len(_name_words(text)) and fake.isupper() == text.isupper()
    return re.sub(r"[^\W_]+", "w", fake) == re.sub(r"[^\W_]+", "w", text)


def same_person(a: str, b: str) -> bool:
    """Whether one name's words all occur in the other, its initials as first letters of words or initials there."""
    x, y = (sorted(set(re.findall(r"[^\W\d_]+", n))) for n in (a, b))
    if sum(len(w) > 1 for w in x) > sum(len(w) > 1 for w in y):
        x, y = y, x
    long = {w for w in y if len(w) > 1}
    words = [w for w in x if len(w) > 1]
    return bool(words) and all(w in long for w in words) and all(any(v[0] == w for v in y) for w in x if len(w) == 1)


_WIDE = {c: " " for c in (0xA0, 0x2002, 0x2003, 0x2007, 0x2009, 0x202F, 0x3000)}


def replaced(text: str, spans: list[tuple[int, int, str]], made: Surrogates, numbers: dict) -> list[tuple[int, int, str, str, str, str, bool]]:
    """(start, end, label, entity, surrogate, its canonical value, whether it fits) of each span; the entity is its label and number."""
    plain = [folded(text[a:b])[0].translate(_WIDE) for a, b, _ in spans]
    for (a, _, label), surface in zip(spans, plain):  # full names first, so that initials and addresses follow them
        if label == "NAME":
            made.name(surface, text[max(0, a - 12) : a])
    out = []
    for (a, b, label), surface in zip(spans, plain):
        entity = (label, canonical(label, surface))
        if label == "NAME" and entity not in numbers:
            known = next((n for (kind, other), n in numbers.items() if kind == label and same_person(entity[1], other)), None)
            numbers[entity] = known or max((n for (kind, _), n in numbers.items() if kind == label), default=0) + 1
        number = numbers.setdefault(entity, sum(k[0] == label for k in numbers) + 1)
        fake = made.replace(label, surface, text[max(0, a - 12) : a])
        out.append((a, b, label, f"{label}_{number}", fake, canonical(label, fake), fits(label, surface, fake)))
    return out


def masked(text: str, spans: list[tuple[int, int, str]], key: bytes, record: str, made: Surrogates | None = None, numbers: dict | None = None) -> tuple[str, str]:
    """(text with numbered typed placeholders, text with surrogates); same entity, same number.

    ``made`` and ``numbers`` carry a record's replacements and numbers on to its other texts.
    """
    made, numbers = made or Surrogates(key, record), {} if numbers is None else numbers
    plain, fake, at = [], [], 0
    for a, b, _, entity, surrogate, _, _ in replaced(text, spans, made, numbers):
        plain += [text[at:a], f"[{entity}]"]
        fake += [text[at:a], surrogate]
        at = b
    return "".join([*plain, text[at:]]), "".join([*fake, text[at:]])


SPANS = "spans array<struct<start_pos:int,end_pos:int,label:string>>"
_ARROW_SPANS = pa.list_(pa.struct([("start_pos", pa.int32()), ("end_pos", pa.int32()), ("label", pa.string())]))


def find_items(records: DataFrame, key: str = "id", text: str = "text") -> DataFrame:
    """``id, spans`` of each record; null texts and texts without an item have an empty array."""
    rows = records.select(F.col(key).cast("string").alias("id"), F.col(text).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [[{"start_pos": a, "end_pos": b, "label": k} for a, b, k in detect(t)] for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, _ARROW_SPANS)], ["id", "spans"])

    return rows.mapInArrow(run, f"id string, {SPANS}")


def mask_texts(records: DataFrame, secret: str, key: str = "id", text: str = "text") -> DataFrame:
    """``id, masked, surrogate, n_items``: typed placeholders, and keyed surrogates that differ with ``secret``."""
    rows = records.select(F.col(key).cast("string").alias("id"), F.col(text).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[], [], []]
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                spans = detect(t)
                plain, fake = masked(t, spans, secret.encode(), i or "") if t else (t, t)
                for column, value in zip(out, (plain, fake, len(spans))):
                    column.append(value)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out[0], pa.string()), pa.array(out[1], pa.string()), pa.array(out[2], pa.int32())], ["id", "masked", "surrogate", "n_items"])

    return rows.mapInArrow(run, "id string, masked string, surrogate string, n_items int")


def mask_surfaces(surfaces: DataFrame, secret: str) -> DataFrame:
    """``id, item_no, label, masked, surrogate`` of annotated surfaces: ``id, item_no, label, text``.

    A surface whose own shape or label says personal data comes out masked, any
    other as it is; a null text stays null.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            plain, fake, kinds = [], [], []
            for i, label, t in zip(*(batch.column(k).to_pylist() for k in (0, 2, 3))):
                found = detect_leak(t, label, set())
                a, b = masked(t, [found], secret.encode(), i or "") if found else (t, t)
                plain.append(a)
                fake.append(b)
                kinds.append(found[2] if found else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(kinds, pa.string()), pa.array(plain, pa.string()), pa.array(fake, pa.string())], ["id", "item_no", "label", "masked", "surrogate"])

    rows = surfaces.select(F.col("id").cast("string").alias("id"), F.col("item_no").cast("int").alias("item_no"), F.col("label").cast("string").alias("label"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "id string, item_no int, label string, masked string, surrogate string")


def _with_leaks(records: DataFrame, errors: DataFrame) -> DataFrame:
    """``id, text, leaks`` of each record or report, leaks being ``item_no, label, text``."""
    once = records.where("id is not null and text is not null").select("id", "text").dropDuplicates(["id"])
    reports = errors.where("id is not null").select(F.col("id").alias("id"), F.posexplode("fn_leaks").alias("k", "leak"))
    reports = reports.select("id", (F.col("k") + 1).alias("item_no"), F.col("leak.label").alias("label"), F.col("leak.text").alias("text")).where("text is not null").distinct()
    wrapped = reports.groupBy("id").agg(F.collect_list(F.struct("item_no", "label", "text")).alias("leaks"))
    return once.join(wrapped, "id", "full_outer").select("id", "text", "leaks")


def mask_leaks(records: DataFrame, errors: DataFrame, secret: str) -> DataFrame:
    """``id, item_no, label, masked, surrogate`` of each text in the reports' ``fn_leaks``, once.

    Items are those of ``all_items``; an entity has the number and surrogate
    that ``mask_texts`` gives it in its record, other entities get further ones.
    A text without an item comes out as it is, with a null label. Null ids and
    texts are left out.
    """
    both = _with_leaks(records, errors).where("leaks is not null")
    schema = "id string, item_no int, label string, masked string, surrogate string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for i, t, leaks in zip(*(batch.column(k).to_pylist() for k in range(3))):
                spans = detect(t)
                names = {name_key(t[a:b]) for a, b, k in spans if k == "NAME"}
                made, numbers = Surrogates(secret.encode(), i), {}
                masked(t or "", spans, secret.encode(), i, made, numbers)
                for x in sorted(leaks, key=lambda x: (x["item_no"], x["text"], x["label"] or "")):
                    found = detect_leak(x["text"], x["label"], names)
                    plain, fake = masked(x["text"], [found] if found else [], secret.encode(), i, made, numbers)
                    out.append((i, x["item_no"], found[2] if found else None, plain, fake))
            if out:
                kinds = [pa.string(), pa.int32(), pa.string(), pa.string(), pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], [x.split()[0] for x in schema.split(", ")])

    return both.mapInArrow(run, schema)


def all_items(records: DataFrame, errors: DataFrame, secret: str) -> DataFrame:
    """``place, id, item_no, start_pos, end_pos, label, entity, surrogate, value, fits`` of each item in the records and the leak reports, once.

    ``entity`` numbers a record's entities as the placeholders do, ``surrogate``
    is the item's keyed replacement and ``fits`` tells whether it has the item's
    type and format. A report's bare surface counts as a name if it is labelled
    so or if its record holds that name. Null ids are left out, null texts hold
    nothing, redelivered records and repeated reports count once.
    """
    both = _with_leaks(records, errors)
    schema = "place string, id string, item_no int, start_pos int, end_pos int, label string, entity string, surrogate string, value string, fits boolean"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for i, t, leaks in zip(*(batch.column(k).to_pylist() for k in range(3))):
                spans = detect(t)
                made, numbers = Surrogates(secret.encode(), i), {}
                out += [("datasets", i, 0, *x) for x in replaced(t or "", spans, made, numbers)]
                if leaks:
                    names = {name_key(t[a:b]) for a, b, k in spans if k == "NAME"}
                    for x in sorted(leaks, key=lambda x: (x["item_no"], x["text"], x["label"] or "")):
                        if found := detect_leak(x["text"], x["label"], names):
                            out += [("judge", i, x["item_no"], *y) for y in replaced(x["text"], [found], made, numbers)]
            if out:
                kinds = [pa.string(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.string(), pa.bool_()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], [x.split()[0] for x in schema.split(", ")])

    return both.mapInArrow(run, schema)


def surrogate_checks(items: DataFrame) -> DataFrame:
    """``test, n_violations`` over ``all_items``: format and type kept; one surrogate for an entity; none shared by two entities of a record.

    Surrogates are compared in their canonical form. An entity of type NAME has
    as many as its mentions have forms (full name, surname, initials).
    """
    wrong = items.agg(F.count_if(~F.col("fits")).alias("n")).select(F.lit("type and format").alias("test"), "n")
    numbers = items.where("label <> 'NAME'")
    split = numbers.groupBy("id", "label", "entity").agg(F.count_distinct("value").alias("k")).agg(F.count_if(F.col("k") > 1).alias("n")).select(F.lit("one surrogate an entity").alias("test"), "n")
    shared = items.groupBy("id", "label", "value").agg(F.count_distinct("entity").alias("k")).agg(F.count_if(F.col("k") > 1).alias("n")).select(F.lit("distinct entities").alias("test"), "n")
    return wrong.unionByName(split).unionByName(shared).withColumnRenamed("n", "n_violations")
