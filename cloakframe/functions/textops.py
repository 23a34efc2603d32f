"""Column expressions over text: offsets, trims, lexicon tests. All run inside the JVM."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from functools import lru_cache

import pandas as pd
from pyspark.java_gateway import launch_gateway
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType

from cloakframe.functions import fixed

MARK = "\x01"
SPAN = "struct<start_pos:int,end_pos:int,text:string>"


CHUNK = 64


def words_any(words: Iterable[str], whole: str = "b") -> str:
    """An alternation of literal words, longest first; ``whole='b'`` bounds it by word edges. Java, RE2 and Python read it alike (RE2 the unbounded form)."""
    from re import escape

    body = "|".join(escape(w).replace(r"\ ", " ").replace(r"\#", "#").replace(r"\&", "&") for w in sorted(set(words), key=lambda w: (-len(w), w)))
    return rf"(?<![\p{{L}}\p{{N}}_])(?:{body})(?![\p{{L}}\p{{N}}_])" if whole == "b" else f"(?:{body})"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def prefix_ends(lengths: Column) -> Column:
    """Running sums of an array: within chunks of ``CHUNK``, then over the chunks' totals, so that a long array is not copied at every step."""
    empty = F.expr("cast(array() as array<int>)")
    one = lambda xs: F.aggregate(xs, empty, lambda acc, n: F.concat(acc, F.array(F.coalesce(F.get(acc, F.size(acc) - 1), F.lit(0)) + n)))
    chunks = F.transform(F.sequence(F.lit(0), F.floor((F.greatest(F.size(lengths), F.lit(1)) - 1) / CHUNK).cast("int")), lambda k: one(F.slice(lengths, k * CHUNK + 1, F.lit(CHUNK))))
    last = lambda q: F.coalesce(F.get(q, F.size(q) - 1), F.lit(0))
    return let(chunks, lambda p: let(F.concat(F.array(F.lit(0)), one(F.transform(p, last))), lambda b: F.flatten(F.transform(p, lambda q, k: F.transform(q, lambda x: x + F.get(b, k))))))


def unmarked(text: Column) -> Column:
    """The text with its own mark characters, if any, made spaces."""
    return F.when(text.contains(MARK), F.translate(text, MARK, " ")).otherwise(text)


def _laid_out(parts: Column) -> Column:
    """Consecutive parts with their offsets."""
    ends = lambda p: prefix_ends(F.transform(p, lambda x: F.length(x)))
    part = lambda x, e: F.struct((e - F.length(x)).alias("start_pos"), e.alias("end_pos"), x.alias("text"))
    return let(parts, lambda p: F.zip_with(p, ends(p), part))


def matches(text: Column, pattern: str, group: bool = False) -> Column:
    """All matches as ``array<struct<start_pos, end_pos, text>>``, code points.

    With ``group`` the pattern is two groups, what precedes and the target; only
    the target is returned. The text's own mark characters become spaces first.
    """
    marked = F.regexp_replace(unmarked(text), F.lit(pattern), F.lit(f"$1{MARK}$2{MARK}" if group else f"{MARK}$0{MARK}"))
    return F.filter(_laid_out(F.split(marked, MARK, -1)), lambda s, i: (i % 2 == 1) & (s["end_pos"] > s["start_pos"]))


def line_array(text: Column) -> Column:
    """``array<struct<line_no, start_pos, end_pos, line>>``; a trailing newline yields a last empty line."""

    def lines(p: Column) -> Column:
        line = lambda x, i, e: F.struct(i.cast("int").alias("line_no"), (F.get(e, i) - F.length(x) - 1).alias("start_pos"), (F.get(e, i) - 1).alias("end_pos"), x.alias("line"))
        return let(prefix_ends(F.transform(p, lambda x: F.length(x) + 1)), lambda e: F.transform(p, lambda x, i: line(x, i, e)))

    return let(F.split(text, "\n", -1), lines)


def token_array(text: Column) -> Column:
    """Tokens without white space, edges trimmed of ``STRIP``; emptied tokens are dropped."""
    left = lambda t: F.length(t) - F.length(F.ltrim(t, F.lit(fixed.STRIP)))
    body = F.transform(
        matches(text, r"(?U)\S+"),
        lambda m: F.struct((m["start_pos"] + left(m["text"])).cast("int").alias("start_pos"), F.btrim(m["text"], F.lit(fixed.STRIP)).alias("tok")),
    )
    kept = F.filter(body, lambda t: F.length(t["tok"]) > 0)
    return F.transform(kept, lambda t, i: F.struct(i.cast("int").alias("tok_no"), t["start_pos"].alias("start_pos"), (t["start_pos"] + F.length(t["tok"])).cast("int").alias("end_pos"), t["tok"].alias("tok")))


def heading_text(line: Column) -> Column:
    return F.btrim(F.rtrim(F.btrim(F.btrim(line), F.lit("#*_ ")), F.lit(":")))


EVERY_SECTION_WORD = sorted({w for words in fixed.SECTION_WORDS.values() for w in words})


def is_section_title(line: Column) -> Column:
    """A short line that is or begins with a section word and looks like a heading."""
    raw = heading_text(line)
    low = F.lower(raw)
    begins = low.rlike(rf"^{words_any(EVERY_SECTION_WORD, '')}(?: |$)")
    shaped = ((F.upper(raw) == raw) & (F.lower(raw) != raw)) | F.rtrim(line).endswith(":") | F.ltrim(line).startswith("#") | low.isin(EVERY_SECTION_WORD) | (F.size(F.split(low, r"\s+")) <= 4)
    return F.when(F.length(low).between(1, 45), begins & shaped).otherwise(False)


def section_of_heading(line: Column) -> Column:
    """First section, in order, of which a word begins the heading; else other."""
    low = F.lower(F.rtrim(F.btrim(F.btrim(line), F.lit("#*_ ")), F.lit(":")))
    out = F.lit("other")
    for name, words in reversed(fixed.SECTION_WORDS.items()):
        out = F.when(low.rlike(rf"^{words_any(words, '')}"), F.lit(name)).otherwise(out)
    return out


YEAR = r"(?:19|20)\d{2}"
YEAR_SPAN = rf"{YEAR}\s*[-–—]\s*(?:{YEAR}|{words_any(fixed.NOW_WORDS, '')})|\b{YEAR}\b.*\b{YEAR}\b"
EMAIL = r"[\p{L}\p{N}_.+-]+@[\p{L}\p{N}_-]+(?:\.[\p{L}\p{N}_-]+)+"
DOB_KEY = words_any(fixed.KV_KEYS["DOB"], "")
#: A line is a line of contacts if it holds any of these.
CONTACT = (EMAIL, r"\+\d{1,3}[\s\d().-]{6,}", rf"(?:^|[^\p{{L}}\p{{N}}_]){words_any(fixed.PHONE_KEYS, '')}\.?\s*[:.]")
SCHOOL = words_any(fixed.EDU_KEYWORDS, "")
NO_SCHOOL = words_any(fixed.EDU_EXCLUDE, "")
SCHOOL_ACRONYM = rf"(?<![\p{{L}}\p{{N}}_-]){words_any(fixed.EDU_ACRONYMS, '')}(?![\p{{L}}\p{{N}}_-])"


def ends_header(line: Column) -> Column:
    """A dated or long line of content, which closes the header."""
    n = F.size(F.filter(F.split(line, r"(?U)\s+"), lambda w: F.length(w) > 0))
    return line.rlike(rf"(?iuU){YEAR_SPAN}") | (n > 14) | (line.rlike(rf"\b{YEAR}\b") & (n > 4) & ~line.rlike(rf"(?iu){DOB_KEY}"))


def is_contact_line(line: Column) -> Column:
    mail, number, key = CONTACT
    return line.rlike(mail) | line.rlike(number) | line.rlike(rf"(?iuU){key}")


def sectioned_lines(text: Column) -> Column:
    """``array<struct<line_no, start_pos, end_pos, line, section, contact>>``.

    A heading or a rule gives its section to all lines up to the next one; the
    lines before the first are header, from a line of content on other.
    """

    def sections(lines: Column, marks: Column) -> Column:
        n = F.size(lines)
        heads = F.filter(F.sequence(F.lit(1), n), lambda i: F.get(marks, i - 1).isNotNull())

        def spread(h: Column) -> Column:
            head = F.coalesce(F.get(h, F.lit(0)), n + 1) - 1
            first = F.array_position(F.transform(F.slice(lines, F.lit(1), head), lambda x: ends_header(x["line"])), True).cast("int")
            header = F.when(first > 0, first - 1).otherwise(head)
            rest = F.flatten(F.transform(h, lambda i, k: F.array_repeat(F.get(marks, i - 1), F.coalesce(F.get(h, k + 1), n + 1) - i)))
            return let(header, lambda m: F.concat(F.array_repeat(F.lit("header"), m), F.array_repeat(F.lit("other"), head - m), rest))

        return let(heads, spread)

    mark = lambda x: F.when(F.btrim(x["line"]).isin(*fixed.RULES_OFF), F.lit("footer")).when(is_section_title(x["line"]), section_of_heading(x["line"]))
    row = lambda x, s: F.struct(*[x[c].alias(c) for c in ("line_no", "start_pos", "end_pos", "line")], s.alias("section"), is_contact_line(x["line"]).alias("contact"))
    return let(line_array(text), lambda lines: F.zip_with(lines, let(F.transform(lines, mark), lambda marks: sections(lines, marks)), row))


def contact_zone(section: Column, contact: Column) -> Column:
    return section.isin("header", "footer", "personal") | contact


def line_at(lines: Column, pos: Column) -> Column:
    """The first line with start <= pos <= end; null outside the text."""
    return F.get(F.filter(lines, lambda x: (x["start_pos"] <= pos) & (pos <= x["end_pos"])), F.lit(0))


NAMED_LANGUAGES = "en de fr es it nl sv fi pl pt da no ru ar zh ja ko hi ur tr el".split()
NAMING_LANGUAGES = "en de fr es it nl sv fi pl pt da nb".split()


@lru_cache(1)
def language_names() -> tuple[str, ...]:
    """Names of ``NAMED_LANGUAGES`` in each of ``NAMING_LANGUAGES``, from the JVM's locale data, and the words for a native language.

    The JVM is the session's; without a session one is started for this alone.
    """
    session = SparkSession.getActiveSession() or SparkSession._instantiatedSession
    own = None if session else launch_gateway()
    try:
        locale = (own.jvm if own else session.sparkContext._jvm).java.util.Locale
        made = {locale.forLanguageTag(one).getDisplayLanguage(locale.forLanguageTag(tongue)).lower() for one in NAMED_LANGUAGES for tongue in NAMING_LANGUAGES}
    finally:
        if own:
            own.shutdown()
            own.proc.stdin.close()
    return tuple(sorted({w for name in made for w in name.split()} | {*fixed.NATIVE_WORDS}))


def contains_any(text: Column, words: Iterable[str]) -> Column:
    return text.rlike(words_any(words, ""))


def is_edu(text: Column) -> Column:
    """Names a school: a keyword inside or a whole acronym, and nothing that excludes it."""
    low = F.concat(F.lit(" "), F.lower(text), F.lit(" "))
    return ~low.rlike(NO_SCHOOL) & (low.rlike(SCHOOL) | text.rlike(SCHOOL_ACRONYM))


def is_tech(token: Column, terms: Iterable[str] = fixed.TECH) -> Column:
    return F.btrim(F.lower(token), F.lit(".,()")).isin(*terms)


def looks_like_list(line: Column) -> Column:
    count = lambda c: F.length(line) - F.length(F.replace(line, F.lit(c), F.lit("")))
    return (count(",") >= 3) | (count("•") >= 2) | (count("|") >= 3)


def is_location_line(segment: Column, cities: Iterable[str] = ()) -> Column:
    """A country anywhere in it, or a known city as first capitalised word of at most six words."""
    hit = F.lower(segment).rlike(words_any(fixed.COUNTRIES))
    known = sorted(set(cities))
    if not known:
        return hit
    first = F.regexp_extract(segment, r"([\p{Lu}][\p{L}\p{N}_'’-]+)", 1)
    return hit | (first.isin(*known) & (F.size(F.split(F.btrim(segment), r"\s+")) <= 6))


def trimmed(text: Column, start: Column, end: Column) -> tuple[Column, Column]:
    """Offsets shrunk past white space, quotes and emphasis; on the right past ``. , ;`` as well."""
    body = F.substring(text, start + 1, end - start)
    a = start + F.length(body) - F.length(F.ltrim(body, F.lit(" \t*_`\"'")))
    b = F.greatest(a, end - F.length(body) + F.length(F.rtrim(body, F.lit(" .,;\t*_`\"'"))))
    return a.cast("int"), b.cast("int")


def unified_label(label: Column) -> Column:
    """A detector's wording as one of the labels: exact, else by the first word it contains, else OTHER."""
    up = F.upper(F.regexp_replace(F.btrim(label), r"[\s-]+", "_"))
    exact = F.element_at(F.create_map(*[F.lit(x) for p in fixed.LABEL_MAP.items() for x in p]), up)
    by_word = F.lit("OTHER")
    for word, lab in reversed(fixed.LABEL_WORDS):
        by_word = F.when(up.contains(word), F.lit(lab)).otherwise(by_word)
    return F.when(up.isin(*fixed.LABELS), up).otherwise(F.coalesce(exact, by_word))


def split_name(split: Column) -> Column:
    low = F.lower(F.btrim(split))
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for p in fixed.SPLIT_ALIAS.items() for x in p]), low), low)



@pandas_udf(StringType())
def ascii_fold(texts: pd.Series) -> pd.Series:
    """Lower case without accents and spaces: for addresses made from names."""
    import unicodedata

    def fold(t: str | None) -> str | None:
        if t is None:
            return None
        return "".join(c for c in unicodedata.normalize("NFKD", t) if not unicodedata.combining(c)).lower().replace(" ", "")

    return texts.map(fold)
