"""One query for each rule that SQL can express, by the scan that the pipeline uses, over all records and a few authored texts.

The authored texts hold hits and near misses of every rule, so that no rule is
compared on nothing. Patterns of the SQL side are written for RE2, which has
no look-around: what must precede a value is matched and left out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cloakframe.functions import fixed, textops
from cloakframe.operators import rules
from cloakframe.plans import catalogue
from cloakframe.plans import frames as fr
from cloakframe.sources.fixtures import RULE_TEXTS

SPACE = f"[{fr._WHITE}]"
NOT_W = r"(?:^|[^\p{L}\p{N}_])"
CAP = rf"[{rules.UPPER}][\p{{L}}\p{{N}}_'’-]+"
PERSON = rf"{CAP}(?:{SPACE}+(?:(?:{'|'.join(fixed.NAME_LINKS)})[ -])?{CAP}){{1,3}}"
PLACE = rf"{CAP}(?: {CAP})?"


def _any(words: list[str]) -> str:
    return textops.words_any(words, "").replace("'", "''")


def _values() -> str:
    return ", ".join(f"('case-{n:02d}', {fr.q(t)})" for n, t in enumerate(RULE_TEXTS))


_DOCS = f"{fr.SQL_DOCS.replace('docs as (', 'docs0 as (', 1)}, docs as (select doc_id, split, text from docs0 union all select c.i, 'case', c.t from (values {_values()}) as c(i, t))"


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    cases = spark.createDataFrame([(f"case-{n:02d}", "case", t) for n, t in enumerate(RULE_TEXTS)], "doc_id string, split string, text string")
    return fr.docs(spark, sf_dir).unionByName(cases)


def _sql(before: str, target: str, after: str = "", where: str = "true", flags: str = "") -> str:
    """Rows of every match of before, target, after, the target's place and text."""
    pattern = f"{flags}({before})({target})({after})"
    parts = f"string_split(regexp_replace(translate(text, chr(1), ' '), '{pattern}', '\\1' || chr(1) || '\\2' || chr(1) || '\\3', 'g'), chr(1))"
    return f"""with {_DOCS}, m as (select doc_id, cast(list_sum(list_transform(a[1:i-1], lambda z: length(z))) as integer) as start_pos, cast(list_sum(list_transform(a[1:i], lambda z: length(z))) as integer) as end_pos, a[i] as surface
        from (select doc_id, a, unnest(range(2, len(a) + 1, 2)) as i from (select doc_id, {parts} as a from docs)))
    select * from m where {where}"""


_AGE = [k for k in fixed.KV_KEYS["AGE"] if k != "leeftijd"]
_TITLED = f"not regexp_matches(surface, '(?i)(?:^|[^\\p{{L}}\\p{{N}}_]){_any(fixed.TITLE_WORDS)}(?:$|[^\\p{{L}}\\p{{N}}_])')"
_DIGIT = _any(fixed.DIGIT_WORDS)
RULE_SQL = {
    "R01": _sql("", r"[\p{L}\p{N}_.+-]+@[\p{L}\p{N}_-]+(?:\.[\p{L}\p{N}_-]+)+"),
    "R05": _sql(NOT_W, rf"{_DIGIT}(?:[ \t\n,-]+{_DIGIT}){{6,}}", flags="(?i)", where="not regexp_matches(surface, '^[ ]')"),
    "R06": _sql(r"(?:^|[^\p{L}\p{N}_@.])", r"@[A-Za-z0-9_.]{2,}[A-Za-z0-9_]"),
    "R08": _sql(NOT_W, r"[A-Z]{2}\d{2}(?: ?[0-9A-Z]{4}){2,7}(?: ?[0-9A-Z]{1,3})?", r"\b", where=r"length(regexp_replace(surface, '\D', '', 'g')) >= 10 and length(replace(surface, ' ', '')) <= 34"),
    "R09": _sql(NOT_W, r"\d{4}-\d{4}-\d{4}-\d{3}[0-9X]", r"\b"),
    "R10": _sql(r"(?:^|[^\p{L}\p{N}_&])#\s?", r"\d{6,}", r"\b"),
    "R12": _sql(rf"{NOT_W}(?i:{_any(fixed.BIRTH)})\s+(?i:{_any(fixed.BIRTH_PREPOSITIONS)})\s+", PLACE),
    "R15": _sql("", rf"(?i:\bhttps?://|\bwww\.)[^\s,;|)\]>]+|(?i:\b(?:[\w-]+\.)?{_any(fixed.KNOWN_HOSTS)})/[^\s,;|)\]>]+"),
    "R19": _sql(rf"{NOT_W}{_any(_AGE)}\s*[:-]?\s*", r"\d{2}", r"(?:$|[^\p{L}\p{N}_])", flags="(?i)"),
    "R22": _sql(rf"{NOT_W}(?i:{_any(fixed.KV_KEYS['NATIONALITY'])})\s+", r"\p{Ll}+|\p{Lu}\p{Ll}+(?:\s*/\s*\p{Lu}\p{Ll}+)?"),
    "R23": _sql(NOT_W, r"[A-Z][a-z]+(?:\s*/\s*[A-Z][a-z]+)?", rf"\s+(?i:{_any(fixed.CITIZENS)})\b"),
    "R24": _sql("", r"\((?:he|she|they|xe|ze)/(?:him|her|hers|them|they|theirs|xem|zir)\)|\b(?:he|she|they)/(?:him|her|them)\b"),
    "R26": _sql(rf"{NOT_W}(?i:{_any(fixed.LOC_KEYS)})\s*[:|]?\s*", rf"{CAP}(?:[ ,]+[\p{{Lu}}(][\p{{L}}\p{{N}}_'’)-]+){{0,3}}"),
    "R32": _sql(rf"{NOT_W}{_any(rules._INTRODUCTIONS)}{SPACE}", PERSON, where=_TITLED),
}
RULE_SQL = {k: v.replace("'’", "''’") if k in ("R12", "R26", "R32") else v for k, v in RULE_SQL.items()}




def _in_line(before: str, target: str, after: str = "", where: str = "true", flags: str = "", surface: str = "surface") -> str:
    """As ``_sql``, with the text, the characters around and the line's section for ``where``; ``surface`` may shorten the match."""
    base = _sql(before, target, after, flags=flags)
    head, tail = base.rsplit("select * from m where", 1)
    contact = rf"regexp_matches(sec.line, '{catalogue._EMAIL_SQL}') or regexp_matches(sec.line, '\+\d{{1,3}}[\s\d().-]{{6,}}') or regexp_matches(sec.line, '(?i)(?:^|[^\p{{L}}\p{{N}}_]){_any(fixed.PHONE_KEYS)}\.?\s*[:.]')"
    return f"""{head}, {catalogue._SECTIONED},
        x as (select m.doc_id, m.start_pos, m.end_pos, m.surface, d.text, sec.section, sec.line, {contact} as contact, substr(d.text, m.end_pos + 1, 1) as next, substr(d.text, m.end_pos + 1, 40) as after, substr(d.text, greatest(0, m.start_pos - 14) + 1, least(14, m.start_pos)) as before
            from m join docs d on d.doc_id = m.doc_id join sec on sec.doc_id = m.doc_id and m.start_pos between sec.start_pos and sec.start_pos + length(sec.line)),
        y as (select * replace ({surface} as surface) from x where {where})
        select doc_id, start_pos, cast(start_pos + length(surface) as integer) as end_pos, surface from y where surface <> ''"""


_NEXT_FREE = r"not regexp_matches(next, '[\p{L}\p{N}_]')"
_NOT_IN = lambda value, words: f"{value} not in ({', '.join(map(fr.q, words))})"
_BORN = rf"{NOT_W}(?i:{_any(fixed.BIRTH)})\s+(?i:{_any(fixed.BIRTH_PREPOSITIONS)})\s+"
_GAP = rf"(?:\s*\([A-Z]{{2}}\))?[,\s]+(?:(?i:{'|'.join(fixed.DATE_PREPOSITIONS)})\s+)?"
_WORD = r"[\p{L}]+\.?"
_DATE = rf"\d{{1,2}}[./-]\s?\d{{1,2}}[./-]\s?\d{{2,4}}|\d{{4}}-\d{{2}}-\d{{2}}|\d{{1,2}}\.?\s*(?:de\s+)?{_WORD}\s+(?:de\s+)?\d{{4}}|{_WORD}\s+\d{{1,2}},?\s+\d{{4}}|{textops.YEAR}".replace(r"\d", r"\p{Nd}")
_ENDINGS = ", ".join(map(fr.q, fixed.DOMAIN_ENDINGS + fixed.RESERVED_ENDINGS))
RULE_SQL |= {
    "R07": _in_line(r"(?:^|[\n|•·;,]\s*|\s{2,})" + rf"{_any(fixed.HANDLE_KEYS)}(?:\s*(?:id|handle|name))?\s*[:|]\s*", r"[^\s|,;]+", flags="(?i)"),
    "R16": _in_line(
        r"(?:^|[^\p{L}\p{N}_@./-])", r"[\p{L}\p{N}_-]+(?:\.[\p{L}\p{N}_-]+)+(?:/[^\s,;|)\]>]*)?",
        where=f"next <> '@' and lower(string_split(string_split(surface, '/')[1], '.')[-1]) in ({_ENDINGS}) and (contact or section in ('header', 'footer', 'personal', 'links') or regexp_matches(line, '(?i){NOT_W}{_any(fixed.WEB_WORDS)}(?:$|[^\\p{{L}}\\p{{N}}_])'))",
    ),
    "R18": _in_line(rf"{NOT_W}(?i:{_any(fixed.KV_KEYS['DOB'] + fixed.MORE_KEYS['DOB'])})\s*[:,]?\s*(?:(?i:on|le|el|il|den)\s+)?", _DATE),
    "R20": _in_line(
        NOT_W, rf"\d{{2}}\s*{_any(fixed.OLD)}", flags="(?i)",
        where=_NEXT_FREE + f" and {_NOT_IN(chr(114) + 'egexp_extract(lower(after), ' + fr.q('^' + chr(92) + 's+(?:of' + chr(92) + 's+)?([' + chr(92) + 'p{L}' + chr(92) + 'p{N}]+(?:' + chr(39) + '[' + chr(92) + 'p{L}]+)?)') + ', 1)', fixed.NOT_AFTER_OLD)} and not regexp_matches(line, '(?i){_any(fixed.YEARS)}\\s+(?:of\\s+)?{_any(fixed.OF_EXPERIENCE)}')",
    ),
    "R21": _in_line(
        rf"{NOT_W}(?i:{_any(fixed.RESIDENCE)})\s+", rf"[{rules.UPPER}][^\n.;()]{{1,60}}",
        surface=rf"rtrim(regexp_replace(surface, '\s+(?:{'|'.join(fixed.PLACE_ENDS)})\s.*$', ''), ' .,;*_`' || chr(9) || chr(34) || chr(39))",
    ),
    "R25": _in_line(r"(?:^|[^\p{L}\p{N}_-])", _any(fixed.MARITAL_WORDS), flags="(?i)", where=_NEXT_FREE + " and next <> '-' and section in ('header', 'personal', 'footer')"),
    "R27a": _in_line(_BORN, CAP, rf"{_GAP}(?:{_DATE})"),
    "R27b": _in_line(rf"{_BORN}{CAP}{_GAP}", _DATE),
    "R28": _in_line(r"(?:^|[^\p{L}\p{N}_-])", rf"[{rules.UPPER}][{rules.LOWER}]+(?:[ -][{rules.UPPER}][{rules.LOWER}]+)?", r"-based\b", where="section not in ('experience', 'education', 'skills')"),
    "R34": _in_line(
        rf"{NOT_W}(?i:{_any(fixed.SUPERVISION + fixed.MORE_KEYS['SUPERVISION'])})[:\s]+(?:{_any(fixed.HONORIFICS)}\.?{SPACE}+)*", f"{PERSON}|{CAP}",
        where=f"regexp_matches(surface, '{SPACE}') or regexp_matches(before, '{_any(fixed.HONORIFICS)}\\.?{SPACE}+$')",
    ),
}
for _k in ("R27a", "R27b", "R34"):
    RULE_SQL[_k] = RULE_SQL[_k].replace("'’-]", "''’-]")


def _of_lines(before: str, target: str, after: str = "", where: str = "true", flags: str = "") -> str:
    """Rows of the match in each line of before, target, after; ``^`` and ``$`` are the line's ends."""
    pattern = f"{flags}({before})({target})({after})"
    return f"""with {_DOCS}, {catalogue._SECTIONED},
        z as (select sec.*, string_split(regexp_replace(translate(line, chr(1), ' '), '{pattern}', '\\1' || chr(1) || '\\2' || chr(1) || '\\3', 'g'), chr(1)) as a from sec),
        m as (select doc_id, section, line, start_pos as base, start_pos + cast(list_sum(list_transform(a[1:i-1], lambda z: length(z))) as bigint) as s, a[i] as surface from (select *, unnest(range(2, len(a) + 1, 2)) as i from z))
        select doc_id, cast(s as integer) as start_pos, cast(s + length(surface) as integer) as end_pos, surface from m where {where}"""


_AT, _DOTS = _any(fixed.AT_WORDS), _any(fixed.DOT_WORDS)
_BRACKET_DOT = rf"\s*[\[({{]{_DOTS}[\])}}]\s*"
_TECH = f"trim(lower(surface), '.,()') not in ({', '.join(map(fr.q, sorted(set(fixed.TECH))))})"
_LETTER_DATE = rf"(?:(?i:den|le|il|am|im|el|em|d\.)\s+)?(?:\d{{1,2}}[./-]\s?\d{{1,2}}[./-]\s?\d{{2,4}}|\d{{1,2}}\.?\s*(?:de\s+)?{_WORD}\s+(?:de\s+)?\d{{4}}|{_WORD}\s+\d{{4}})(?:$|[^\p{{L}}\p{{N}}_])"
_U = rules.UPPER
RULE_SQL |= {
    "R02": _sql(r"(?:^|[^\p{L}\p{N}_.+-])", rf"[\p{{L}}\p{{N}}_][\p{{L}}\p{{N}}_.+-]*(?:{_BRACKET_DOT}[\p{{L}}\p{{N}}_]+)*{SPACE}*[\[({{]{_AT}[\])}}]{SPACE}*[\p{{L}}\p{{N}}_-]+(?:(?:{_BRACKET_DOT}|\s*\.\s*)[\p{{L}}\p{{N}}_-]+)+", flags="(?i)"),
    "R03": _sql(rf"(?:^|{SPACE})", rf"\p{{L}}[\p{{L}}\p{{N}}_.+-]*(?: {_DOTS} [\p{{L}}\p{{N}}_]+)* {_AT} \p{{L}}[\p{{L}}\p{{N}}_-]* {_DOTS} {_any(fixed.MAIL_ENDINGS + fixed.RESERVED_ENDINGS)}", r"\b", flags="(?i)"),
    "R11": _of_lines(r"^[ \t]*", PLACE, rf",\s*{_LETTER_DATE}", where=f"{_TITLED} and {_TECH}"),
    "R14": _of_lines(r"^[ \t]*", rf"(?:[{_U}] ){{2,}}[{_U}](?:\s{{2,}}(?:[{_U}] )*[{_U}])+", r"[ \t]*$", where="section in ('header', 'personal', 'footer')"),
    "R31": _of_lines(r"(?:^|[,()–—|:])[ \t]*", r"[A-Z][A-Za-z]?[A-Z]{1,5}(?:[- ][A-Z][a-z]+)?", where=f"regexp_matches(substr(line, s - base + length(surface) + 1), '^[ ]*(?:[,)–—|]|$)') and section = 'education' and length(surface) >= 3 and upper(surface) not in ({', '.join(map(fr.q, fixed.NO_SCHOOL_ACRONYMS))}) and {_TECH}"),
    "R33": _of_lines(r"(?:^\s*|^.*\t|^.*   )\(", rf"(?:[A-Z]\.\s?){{0,4}}{CAP}(?:\s+{CAP}){{0,3}}", rf"\){SPACE}*$", where=f"regexp_matches(surface, '[^ ] +[^ ]') and {_TITLED}"),
    "R35": _of_lines(rf"^[ \t•*–-]*(?:{_any(fixed.HONORIFICS)}\.?{SPACE}+)*", PERSON, rf"{SPACE}*(?:[,–—|(-]|$)", where=f"section = 'references' and {_TITLED} and not regexp_matches(lower(trim(line, ' #*_:')), '^{_any(textops.EVERY_SECTION_WORD)}(?: |$)')"),
}
for _k in ("R11", "R33", "R35"):
    RULE_SQL[_k] = RULE_SQL[_k].replace("'’-]", "''’-]")


def _is_edu(value: str) -> str:
    padded = f"' ' || lower({value}) || ' '"
    acronym = rf"(?:^|[^\p{{L}}\p{{N}}_-]){_any(fixed.EDU_ACRONYMS)}(?:$|[^\p{{L}}\p{{N}}_-])"
    return f"(not regexp_matches({padded}, '{_any(fixed.EDU_EXCLUDE)}') and (regexp_matches({padded}, '{_any(fixed.EDU_KEYWORDS)}') or regexp_matches({value}, '{acronym}')))"


_SEGMENTS = _of_lines("", r"[^,;|()—–\t]+").rsplit("select doc_id,", 1)[0]
_EMPHASIS = "'*_`' || chr(9) || chr(34) || chr(39)"
RULE_SQL |= {
    "R29": f"""{_SEGMENTS}, e0 as (select doc_id, s, surface as t from m where {_is_edu('surface')}),
        e1 as (select doc_id, case when contains(t, ':') and not {_is_edu("split_part(t, ':', 1)")} then s + strpos(t, ':') else s end as s, case when contains(t, ':') and not {_is_edu("split_part(t, ':', 1)")} then substr(t, strpos(t, ':') + 1) else t end as t from e0),
        e2 as (select *, case when lower(regexp_replace(regexp_extract(t, '^{SPACE}*([^{fr._WHITE}]+)', 1), '[^\\p{{L}}\\p{{N}}_]', '', 'g')) in ({', '.join(map(fr.q, fixed.LEADING_DEGREES))})
            then length(regexp_extract(t, '^({SPACE}*[^{fr._WHITE}]+{SPACE}+(?:[^\\p{{Lu}}{fr._WHITE}][^{fr._WHITE}]*{SPACE}+)*)\\p{{Lu}}', 1)) else 0 end as d from e1),
        e3 as (select doc_id, case when d > 0 and {_is_edu('substr(t, d + 1)')} then s + d else s end as s, case when d > 0 and {_is_edu('substr(t, d + 1)')} then substr(t, d + 1) else t end as t from e2),
        e4 as (select doc_id, s, regexp_replace(t, '{SPACE}+(?:in )?(?:\\d{{2}}/)?\\d{{4}}{SPACE}*$', '') as t from e3),
        e5 as (select doc_id, s + length(t) - length(ltrim(t, ' ' || {_EMPHASIS})) as s, rtrim(ltrim(t, ' ' || {_EMPHASIS}), ' .,;' || {_EMPHASIS}) as t from e4)
        select doc_id, cast(s as integer) as start_pos, cast(s + length(t) as integer) as end_pos, t as surface from e5 where length(t) > 2""",
    "R30": f"""{_SEGMENTS}, e as (select doc_id, s + length(surface) as s, regexp_extract(substr(line, s - base + length(surface) + 1), '^({SPACE}*\\()([{_U}][\\p{{L}}]{{1,9}})(?:{SPACE}*/[^)]*)?\\)', ['open', 'name']) as f from m where {_is_edu('surface')})
        select doc_id, cast(s + length(f.open) as integer) as start_pos, cast(s + length(f.open) + length(f.name) as integer) as end_pos, f.name as surface from e where f.name <> ''""",
}


_NUMBER = rf"[ -]?(?:{_any([w for w in fixed.NUMBER_WORDS if w.isascii()])}\b|{_any([w for w in fixed.NUMBER_WORDS if not w.isascii()])})\.?"
_GROUP = r"[A-Z0-9]+(?:[./-]+[A-Z0-9]+)*\b"
RULE_SQL["R13"] = _sql(
    rf"(?:^|[^\p{{L}}\p{{N}}_-])(?:(?i:{_any(fixed.ID_WORDS + fixed.MORE_KEYS['ID'])})(?i:{_NUMBER})?|(?i:{_any(fixed.ID_WORDS_NUMBERED)})(?i:{_NUMBER}))\.?{SPACE}*[:#|]?{SPACE}*#?{SPACE}*",
    rf"{_GROUP}(?: {_GROUP})*", where=r"length(regexp_replace(surface, '[^0-9]', '', 'g')) >= 4",
).replace("select * from m where", "select distinct * from m where")


def _register(rule: str, sql: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return rules.scan(_docs(spark, sf_dir)).where(F.col("rule") == rule).select("doc_id", "start_pos", "end_pos", "surface").distinct()

    run.__name__ = f"rule_{rule.lower()}"
    catalogue.query(f"select distinct * from ({sql})")(run)


for _rule, _statement in RULE_SQL.items():
    _register(_rule, _statement)
