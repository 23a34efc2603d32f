"""The policy's decisions over recorded detector spans, by label, each with the same decision in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cloakframe.functions import fixed, textops
from cloakframe.operators import policy, rules
from cloakframe.operators import spans as sp
from cloakframe.plans import catalogue
from cloakframe.plans import frames as fr

EDGE_L, EDGE_R = r"(?:^|[^\p{L}\p{N}_])", r"(?:$|[^\p{L}\p{N}_])"


def _any(words: list[str]) -> str:
    return textops.words_any(words, "").replace("'", "''")


def _in(value: str, words: list[str]) -> str:
    return f"{value} in ({', '.join(map(fr.q, sorted({*words})))})"


def _has(value: str, words: list[str]) -> str:
    return f"regexp_matches({value}, '(?i){EDGE_L}{_any(words)}{EDGE_R}')"


def _like(value: str, pattern: str) -> str:
    return f"regexp_matches({value}, '{pattern}')"


def _each(test: str) -> str:
    return f"len(list_filter(w, lambda x: not ({test}))) = 0"


def _keyed(tail: str, *names: str, of: str = "before") -> str:
    return _like(of, f"(?i){_any([k for n in names for k in fixed.KV_KEYS[n]])}{tail}")


_TECH = _in("trim(lower({0}), '.,()')", fixed.TECH)
_LIST = "(length(line) - length(replace(line, ',', '')) >= 3 or length(line) - length(replace(line, '•', '')) >= 2 or length(line) - length(replace(line, '|', '')) >= 3)"
_ZONE = "(section in ('header', 'footer', 'personal') or contact)"
_EDU = f"(not {_like(chr(39) + ' ' + chr(39) + ' || lower(t) || ' + chr(39) + ' ' + chr(39), _any(fixed.EDU_EXCLUDE))} and ({_like(chr(39) + ' ' + chr(39) + ' || lower(t) || ' + chr(39) + ' ' + chr(39), _any(fixed.EDU_KEYWORDS))} or {_like('t', '(?:^|[^' + chr(92) + 'p{L}' + chr(92) + 'p{N}_-])' + _any(fixed.EDU_ACRONYMS) + '(?:$|[^' + chr(92) + 'p{L}' + chr(92) + 'p{N}_-])')}))"
_SCHOOL = f"(section = 'education' and not {_has('t', fixed.DEGREE_WORDS)} and not {_TECH.format('t')} and not {_has('t', fixed.COMPANY_WORDS)})"
_YEAR_SPAN = textops.YEAR_SPAN
_NAME = f"""not (
    (len(w) > 0 and {_each(_in('lower(x)', fixed.FIELD_LABELS) + ' or ' + _in('lower(x)', textops.EVERY_SECTION_WORD))})
    or (len(w) > 0 and {_each(_TECH.format('x') + ' or ' + _in('lower(x)', fixed.MONTHS))} and (len(w) = 1 or {_LIST} or section in ('skills', 'experience', 'certifications', 'other')))
    or (section = 'skills' and {_LIST})
    or {_like('after', f'(?i)^[{fr._WHITE}]*(?:{_any(fixed.COMPANY_JOINS)}[{fr._WHITE}]|{_any(fixed.COMPANY_TAILS)}|{_any(fixed.COMPANY_TAILS_WHOLE)}{EDGE_R})')}
    or {_like('right(before, 4)', '(?i)(?:&' + chr(92) + 's*|' + chr(92) + 'band' + chr(92) + 's)$')} or {_has('t', fixed.COMPANY_WORDS)} or contains(t, '&') or {_has('t', fixed.EPONYMS)}
    or length(t) < 2 or (len(w) = 1 and upper(w[1]) = w[1] and lower(w[1]) <> w[1] and length(w[1]) <= 5))"""
_CODE = rf"{_any(fixed.CODE_HOSTS)}/([^/\s]+)(/[^/\s]+)?"
_OWN_SITE = "regexp_matches(lower(substr(line, 1, greatest(0, start_pos - line_start))), 'portfolio|web ?site|homepage|personal|my blog') and not contains(lower(substr(line, 1, greatest(0, start_pos - line_start))), 'company')"
_URL = f"case when {_like('lower(t)', _CODE)} then regexp_extract(lower(t), '{_CODE}', 2) = '' or {_ZONE} else {_like('lower(t)', _any(fixed.PERSONAL_HOSTS))} or coalesce(src, '') in ('re-bare', 'prop') or ({_ZONE} and section <> 'other') or ({_OWN_SITE}) end"
_DOB = f"digits > 0 and not ({_like('t', f'^{textops.YEAR}$')} and not {_keyed(chr(92) + 's*[:,]?' + chr(92) + 's*$', 'DOB')}) and (section in ('header', 'personal') or {_keyed(r'\s*[:,]?\s*(?:(?:on|le|el|il)\s+)?$', 'DOB', 'AGE')}) and not {_like('t', '(?i)' + _YEAR_SPAN)}"
_HANDLE = rf"not {_like('t', '[ ' + chr(92) + 'n/]')} and not {_TECH.format('t')} and (starts_with(t, '@') or ({_ZONE} and section <> 'other') or {_like('line', f'(?i)(?:^|[^{chr(92)}p{{L}}{chr(92)}p{{N}}_]){_any(fixed.HANDLE_KEYS)}{chr(92)}s*[:|]')})"
_ID = rf"digits >= 5 and not {_like('t', f'(?i)^{textops.YEAR}{chr(92)}s*[-–]{chr(92)}s*(?:{textops.YEAR}|present)$')} and not {_like('lower(t)', '^[' + chr(92) + 'd.,%$€£]+[kmb]?$')}"
_MODEL = f"""case label when 'NAME' then {_NAME} when 'LOCATION' then {_ZONE} or section = 'references' when 'ADDRESS' then {_ZONE} or section = 'references'
    when 'EDU_ORG' then {_EDU} or ({_SCHOOL} and not {_in('lower(t)', fixed.SCHOOL_EXAMS)})
    when 'NATIONALITY' then section in ('header', 'personal') or {_keyed(chr(92) + 's*:?' + chr(92) + 's*$', 'NATIONALITY')}
    when 'ID' then {_ID} when 'PHONE' then digits >= 7 when 'DOB' then {_DOB} when 'HANDLE' then {_HANDLE}
    when 'MARITAL' then {_in('lower(t)', fixed.MARITAL_WORDS)} or {_keyed(chr(92) + 's*[:|]?' + chr(92) + 's*$', 'MARITAL')} else label in ('GENDER', 'AGE', 'RELIGION', 'EMAIL') end"""
_RULE = "label in ('NAME', 'LOCATION', 'ADDRESS', 'EDU_ORG', 'NATIONALITY', 'ID', 'PHONE', 'DOB', 'HANDLE', 'MARITAL', 'GENDER', 'AGE', 'RELIGION', 'EMAIL')"


LANGUAGE_LIKE = ("NAME", "LOCATION", "NATIONALITY", "ORG")


def _sql(labels: list[str]) -> str:
    named = not {*labels}.isdisjoint(LANGUAGE_LIKE)
    names = _in("lower(x)", list(textops.language_names())) if named else "false"
    lead = rf"length(regexp_extract(surface, '^((?:{_any([h for h in fixed.HONORIFICS if len(h) > 1])}\.?[{fr._WHITE}]+)+)', 1))"
    contact = rf"regexp_matches(line, '{catalogue._EMAIL_SQL}') or regexp_matches(line, '\+\d{{1,3}}[\s\d().-]{{6,}}') or regexp_matches(line, '(?i)(?:^|[^\p{{L}}\p{{N}}_]){_any(fixed.PHONE_KEYS)}\.?\s*[:.]')"
    return f"""with {fr.SQL_DOCS}, {fr.SQL_SPANS}, {catalogue._SECTIONED},
        titles as (select i.doc_id, i.line_no, i.title from i),
        c0 as (select s.span_id, s.doc_id, s.start_pos, s.end_pos, s.label, s.src, s.surface, coalesce(sec.section, 'other') as section, coalesce(sec.line, '') as line, coalesce(sec.start_pos, 0) as line_start,
                coalesce(titles.title, false) as title, substr(d.text, greatest(0, s.start_pos - 30) + 1, least(30, s.start_pos)) as before, substr(d.text, s.end_pos + 1, 20) as after
            from s join docs d on d.doc_id = s.doc_id left join sec on sec.doc_id = s.doc_id and s.start_pos between sec.start_pos and sec.start_pos + length(sec.line)
            left join titles on titles.doc_id = s.doc_id and titles.line_no = sec.line_no where s.label in ({', '.join(map(fr.q, labels))})),
        c1 as (select *, {contact} as contact, case when label = 'NAME' and {lead} < length(surface) then {lead} else 0 end as lead from c0),
        c2 as (select * replace (start_pos + lead as start_pos), trim(substr(surface, lead + 1), ' ') as t, not starts_with(coalesce(src, ''), 're') as model from c1),
        c3 as (select *, regexp_extract_all(t, '[\\p{{L}}\\p{{N}}_''-]+') as w, length(regexp_replace(t, '\\D', '', 'g')) as digits from c2),
        c4 as (select *, case when label = 'ORG' then {_EDU} or {_SCHOOL} when label = 'DATE' then {_keyed(chr(92) + 's*[:,]?' + chr(92) + 's*$', 'DOB', of='right(before, 25)')} when label = 'URL' then {_URL}
                when model then {_MODEL} else {_RULE} end as stays from c3)
        select span_id, cast(start_pos as integer) as start_pos, case label when 'ORG' then 'EDU_ORG' when 'DATE' then 'DOB' else label end as label from c4
        where t <> '' and stays and not (model and (title or (label in ('NAME', 'LOCATION', 'NATIONALITY', 'ORG') and len(w) > 0 and {_each(names)})))"""


GROUPS = {
    "policy_names": ["NAME"], "policy_places": ["LOCATION", "ADDRESS"], "policy_schools": ["ORG", "EDU_ORG"], "policy_dates": ["DATE", "DOB"], "policy_nationalities": ["NATIONALITY"],
    "policy_urls": ["URL"], "policy_numbers": ["ID", "PHONE"], "policy_handles": ["HANDLE"], "policy_personal": ["MARITAL", "GENDER", "AGE", "RELIGION", "EMAIL", "OTHER"],
}


def _register(name: str, labels: list[str]) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        documents = fr.docs(spark, sf_dir)
        placed = sp.with_context(documents, fr.spans(spark, sf_dir, documents).where(F.col("label").isin(labels)).withColumn("src", F.coalesce("src", F.lit(""))))
        rows = placed.join(documents.select("doc_id", "text"), "doc_id").select(*placed.columns, *rules.around(F.col("text"), F.col("start_pos"), F.col("end_pos")))
        return policy.apply(rows).select("span_id", "start_pos", "label")

    run.__name__ = name
    catalogue.query(lambda: _sql(labels))(run)


for _name, _labels in GROUPS.items():
    _register(_name, _labels)
