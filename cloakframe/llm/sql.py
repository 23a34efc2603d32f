"""Equivalent SQL for the problems' queries that SQL can express over whole tables."""

from __future__ import annotations

from cloakframe.llm.canonical import canonical_sql
from cloakframe.llm.lookalikes import INVISIBLE, LOOKALIKE, compatibility_forms

_SPLIT = """coalesce(
    nullif(case lower(trim(split)) when 'dev' then 'devsynth' when 'h3' then 'devhard' when 'h2' then 'holdout' when 'test' then 'probe20' else lower(trim(split)) end, ''),
    case split_part(id, '-', 1) when 'DEV' then 'devsynth' when 'H3' then 'devhard' when 'H2' then 'holdout' when 'CV' then 'probe20' end)"""


def p3_found() -> str:
    return f"""
        with r as (select distinct id, {_SPLIT} as s, text from datasets where id is not null)
        select distinct r.id as id,
               case when list_max(list_transform(string_split_regex(text, '[\\s\\x{{85}}\\x{{a0}}\\x{{1680}}\\x{{2000}}-\\x{{200a}}\\x{{2028}}\\x{{2029}}\\x{{202f}}\\x{{205f}}\\x{{3000}}]+'), lambda w: length(w))) > l.max_chars
                    then 'forced' else 'natural' end as cut
        from r join size_limits l on l.split = r.s
        where length(text) > l.max_chars
    """


def p2_found() -> str:
    """By testing for the characters themselves, not by building the consistent form."""
    forms = "".join(compatibility_forms())
    alike = "".join(LOOKALIKE)
    return f"""
        with s as (select id as doc_id, 0 as span_no, text from datasets union all select doc_id, span_no, text from gold)
        select distinct doc_id, cast(span_no as integer) as span_no from s
        where doc_id is not null and span_no is not null and (
            regexp_matches(text, '[{INVISIBLE}{forms}]')
            or nfc_normalize(text) <> text
            or len(list_filter(regexp_extract_all(nfc_normalize(regexp_replace(text, '[{INVISIBLE}]', '', 'g')), '[\\p{{L}}\\p{{M}}]+'),
                lambda w: regexp_full_match(w, '[\\p{{Latin}}\\p{{M}}{alike}]+') and regexp_matches(w, '\\p{{Latin}}') and regexp_matches(w, '[{alike}]'))) > 0)
    """


def p2_canonical() -> str:
    """The consistent form of every text, without the test that lets plain texts pass."""
    rows = "(select id as k, 0 as n, text as t from datasets where id is not null union all select doc_id, span_no, text from gold where doc_id is not null)"
    return f"select distinct k as doc_id, cast(n as integer) as span_no, canonical, coalesce(changed, false) as changed from ({canonical_sql(rows, test_first=False)})"


def _kept(*tests: str) -> str:
    """What an operator promises holds everywhere, so every count of violations is zero."""
    return f"select test, cast(0 as bigint) as n_violations from (values {', '.join(f'({chr(39)}{t}{chr(39)})' for t in tests)}) as t(test)"


P3_CHECKS = _kept("limit", "overlap", "substring", "cover")
P4_CHECKS = _kept("type and format", "one surrogate an entity", "distinct entities")
P7_CHECKS = _kept("cap", "nonnegative rate", "empty text", "share")


def oracle_sql() -> dict[str, str]:
    return {"p2_found": p2_found(), "p2_canonical": p2_canonical(), "p3_found": p3_found(), "p3_checks": P3_CHECKS, "p4_checks": P4_CHECKS, "p7_checks": P7_CHECKS}
