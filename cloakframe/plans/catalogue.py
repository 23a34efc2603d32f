"""Every core query: its plan, and the SQL it is checked against where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cloakframe.functions import fixed, textops
from cloakframe.operators import scoring
from cloakframe.operators import spans as sp
from cloakframe.plans import experiments as ex
from cloakframe.plans import frames as fr
from cloakframe.session import table

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str | Callable[[], str | None]] = {}


def query(sql: str | Callable[[], str | None] | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return register


def queries() -> dict[str, Query]:
    from cloakframe.plans import pipeline_queries, policy_queries, rule_queries  # noqa: F401  register their own

    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    queries()
    made = {name: sql() if callable(sql) else sql for name, sql in _SQL.items()}
    return {name: sql for name, sql in made.items() if sql}


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fr.docs(spark, sf_dir)


# ---- text structure


@query(f"with {fr.SQL_DOCS} select split, count(*) as n_docs, cast(sum(length(text)) as bigint) as n_chars from docs group by split")
def datasets_by_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).groupBy("split").agg(F.count("*").alias("n_docs"), F.sum(F.length("text")).alias("n_chars"))


_LINES = """l as (select doc_id, i - 1 as line_no, a[i] as line, i - 1 + cast(coalesce(list_sum(list_transform(a[1:i-1], lambda z: length(z))), 0) as bigint) as start_pos
        from (select doc_id, a, unnest(range(1, len(a) + 1)) as i from (select doc_id, string_split(text, chr(10)) as a from docs)))"""


@query(f"with {fr.SQL_DOCS}, {_LINES} select doc_id, cast(line_no as integer) as line_no, cast(start_pos as integer) as start_pos, cast(start_pos + length(line) as integer) as end_pos, line from l")
def doc_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", F.explode(textops.line_array(F.col("text"))).alias("l")).select("doc_id", "l.*")


@query(f"with {fr.SQL_DOCS}, {fr.SQL_TOKENS} select doc_id, cast(s as integer) as start_pos, cast(e as integer) as end_pos, tok from tok")
def tokens_stripped(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _docs(spark, sf_dir).select("doc_id", F.explode(textops.token_array(F.col("text"))).alias("t"))
    return rows.select("doc_id", "t.start_pos", "t.end_pos", "t.tok")


def _sql_words(words: list[str]) -> str:
    return textops.words_any(words, "").replace("'", "''")


_EVERY = textops.EVERY_SECTION_WORD
_RAW = "trim(rtrim(trim(trim(line, chr(32)), '#*_ '), ':'), chr(32))"
_SPAN_YEARS = f"(?i){textops.YEAR_SPAN}"
_EMAIL_SQL = r"[\p{L}\p{N}_.+-]+@[\p{L}\p{N}_-]+(?:\.[\p{L}\p{N}_-]+)+"
_SECTIONED = f"""{_LINES},
    h as (select *, {_RAW} as raw from l),
    i as (select *, length(raw) > 0 and length(raw) <= 45 and regexp_matches(lower(raw), '^{_sql_words(_EVERY)}(?: |$)')
            and ((upper(raw) = raw and lower(raw) <> raw) or rtrim(line) like '%:' or ltrim(line) like '#%' or lower(raw) in ({', '.join(map(fr.q, _EVERY))}) or len(string_split_regex(lower(raw), '\\s+')) <= 4) as title from h),
    k as (select *, case when trim(line, chr(32)) in ('---', '___', '***') then 'footer'
            when title then case {' '.join(f"when regexp_matches(lower(raw), '^{_sql_words(w)}') then {fr.q(n)}" for n, w in fixed.SECTION_WORDS.items())} else 'other' end
            when regexp_matches(line, '{_SPAN_YEARS}') or len(list_filter(string_split_regex(line, '[{fr._WHITE}]+'), lambda w: length(w) > 0)) > 14
                or (regexp_matches(line, '\\b(?:19|20)\\d{{2}}\\b') and len(list_filter(string_split_regex(line, '[{fr._WHITE}]+'), lambda w: length(w) > 0)) > 4 and not regexp_matches(line, '(?i){_sql_words(fixed.KV_KEYS['DOB'])}')) then '<body>' end as event from i),
    n as (select *, min(case when event is not null then line_no end) over (partition by doc_id) as first_event from k),
    sec as (select doc_id, line_no, line, start_pos, coalesce(last_value(case when event = '<body>' then case when line_no = first_event then 'other' end else event end ignore nulls) over (partition by doc_id order by line_no rows between unbounded preceding and current row), 'header') as section from n)"""


@query(f"with {fr.SQL_DOCS}, {_SECTIONED} select doc_id, cast(line_no as integer) as line_no, section from sec")
def line_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _docs(spark, sf_dir).select("doc_id", F.explode(textops.sectioned_lines(F.col("text"))).alias("l"))
    return rows.select("doc_id", "l.line_no", "l.section")


@query(
    rf"""with {fr.SQL_DOCS}, {_LINES} select doc_id, cast(line_no as integer) as line_no from l
    where regexp_matches(line, '{_EMAIL_SQL}') or regexp_matches(line, '\+\d{{1,3}}[\s\d().-]{{6,}}') or regexp_matches(line, '(?i)(?:^|[^\p{{L}}\p{{N}}_]){_sql_words(fixed.PHONE_KEYS)}\.?\s*[:.]')"""
)
def contact_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _docs(spark, sf_dir).select("doc_id", F.explode(textops.line_array(F.col("text"))).alias("l"))
    return rows.where(textops.is_contact_line(F.col("l.line"))).select("doc_id", "l.line_no")


# ---- pattern scans


def _spans_sql(relation: str, key: str, pattern: str) -> str:
    return fr.sql_matches(relation, pattern, key)


@query(f"with {fr.SQL_DOCS} {_spans_sql('docs', 'doc_id', _EMAIL_SQL)}")
def email_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sp.extract(_docs(spark, sf_dir), textops.EMAIL, "EMAIL", "re").select("doc_id", "start_pos", "end_pos", "surface")


@query(_spans_sql("documents where text is not null", "doc_id", _EMAIL_SQL))
def corpus_email_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sp.extract(table(spark, sf_dir, "documents").where("text is not null"), textops.EMAIL, "EMAIL", "re").select("doc_id", "start_pos", "end_pos", "surface")


# ---- span algebra


@query(f"with {fr.SQL_DOCS}, {fr.SQL_SPANS} select label, count(*) as n_spans, count(distinct doc_id) as n_docs from s group by label")
def spans_by_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fr.spans(spark, sf_dir, _docs(spark, sf_dir))
    return rows.groupBy("label").agg(F.count("*").alias("n_spans"), F.countDistinct("doc_id").alias("n_docs"))


@query(f"with {fr.SQL_DOCS}, {fr.SQL_SPANS}, {fr.sql_islands('m', 's', 'doc_id, run_id', 'span_id')} select * from m")
def merge_spans_islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sp.merge_spans(fr.spans(spark, sf_dir, _docs(spark, sf_dir)), ["doc_id", "run_id"])


@query(
    f"""with {fr.SQL_DOCS}, {fr.SQL_SPANS} select span_id from s x where 1 + (select count(distinct y.det) from s y
    where y.doc_id = x.doc_id and y.run_id = x.run_id and y.det <> x.det and x.start_pos < y.end_pos and y.start_pos < x.end_pos) >= 2"""
)
def vote_two_detectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sp.vote(fr.spans(spark, sf_dir, _docs(spark, sf_dir)), 2, ["doc_id", "run_id"]).select("span_id")


@query(
    f"""with {fr.SQL_DOCS}, {fr.SQL_SPANS}, {_SECTIONED} select span_id, coalesce(sec.section, 'other') as section, cast(coalesce(sec.line_no, -1) as integer) as line_no
    from s left join sec on sec.doc_id = s.doc_id and s.start_pos between sec.start_pos and sec.start_pos + length(sec.line)"""
)
def span_line_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = _docs(spark, sf_dir)
    lines = documents.select("doc_id", textops.sectioned_lines(F.col("text")).alias("lines"))
    rows = fr.spans(spark, sf_dir, documents).join(lines, "doc_id").select("span_id", textops.line_at(F.col("lines"), F.col("start_pos")).alias("at"))
    return rows.select("span_id", F.coalesce("at.section", F.lit("other")).alias("section"), F.coalesce("at.line_no", F.lit(-1)).alias("line_no"))


_TOUCH = "exists (select 1 from g where g.doc_id = s.doc_id and s.start_pos < g.end_pos and g.start_pos < s.end_pos)"


@query(f"with {fr.SQL_DOCS}, {fr.SQL_GOLD}, {fr.SQL_SPANS} select det, count(*) as n_spans from s where {_TOUCH} group by det")
def covered_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = _docs(spark, sf_dir)
    return sp.covered(fr.spans(spark, sf_dir, documents), fr.gold(spark, sf_dir, documents)).groupBy("det").agg(F.count("*").alias("n_spans"))


@query(f"with {fr.SQL_DOCS}, {fr.SQL_GOLD}, {fr.SQL_SPANS} select span_id from s where not {_TOUCH}")
def uncovered_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = _docs(spark, sf_dir)
    return sp.uncovered(fr.spans(spark, sf_dir, documents), fr.gold(spark, sf_dir, documents)).select("span_id")


_LOCATE = """select doc_id, surface, label, cast(list_sum(list_transform(a[1:i], lambda z: length(z))) + (i - 1) * length(surface) as integer) as start_pos,
        cast(list_sum(list_transform(a[1:i], lambda z: length(z))) + i * length(surface) as integer) as end_pos
    from (select doc_id, surface, label, a, unnest(range(1, len(a))) as i from (select w.*, string_split(translate(d.text, chr(1), ' '), w.surface) as a from {0} w join docs d on d.doc_id = w.doc_id))"""


@query(f"with {fr.SQL_DOCS}, {fr.SQL_GOLD}, w as (select distinct doc_id, surface, label from g) {_LOCATE.format('w')}")
def locate_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = _docs(spark, sf_dir)
    return sp.locate_all(documents, fr.gold(spark, sf_dir, documents).select("doc_id", "surface", "label").distinct())


_SAFETY = f"""w as (select doc_id, trim(surface, chr(32)) as surface, label, span_id from s where label in ({', '.join(map(fr.q, fixed.SAFETY_LABELS))})
            and (length(trim(surface, chr(32))) >= 4 or (label = 'EDU_ORG' and length(trim(surface, chr(32))) >= 3 and upper(trim(surface, chr(32))) = trim(surface, chr(32)) and lower(trim(surface, chr(32))) <> trim(surface, chr(32))))),
    v as (select doc_id, surface, arg_min(label, span_id) as label from w group by doc_id, surface)"""


@query(f"with {fr.SQL_DOCS}, {fr.SQL_SPANS}, {_SAFETY} {_LOCATE.format('v')}")
def safety_net_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cloakframe.operators import identity

    documents = _docs(spark, sf_dir)
    return identity.safety_net(documents, fr.spans(spark, sf_dir, documents)).select("doc_id", "surface", "label", "start_pos", "end_pos")


@query(
    f"""with {fr.SQL_DOCS}, {fr.SQL_SPANS}, {fr.sql_islands('m', "(select * from s where det = 'rules')", 'doc_id', 'span_id')},
    p as (select doc_id, string_agg(piece, '' order by start_pos) as head, max(end_pos) as last from (select m.doc_id, m.start_pos, m.end_pos,
        substr(d.text, coalesce(lag(m.end_pos) over (partition by m.doc_id order by m.start_pos), 0) + 1, m.start_pos - coalesce(lag(m.end_pos) over (partition by m.doc_id order by m.start_pos), 0)) || '[' || m.label || ']' as piece
        from m join docs d on d.doc_id = m.doc_id) group by doc_id)
    select d.doc_id, md5(coalesce(p.head, '') || substr(d.text, coalesce(p.last, 0) + 1)) as masked_md5 from docs d left join p on p.doc_id = d.doc_id"""
)
def masked_rule_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = _docs(spark, sf_dir)
    rules = scoring.islands_by(fr.spans(spark, sf_dir, documents).where("det = 'rules'"), ["doc_id"], "islands")
    return documents.join(rules, "doc_id", "left").select("doc_id", F.md5(sp.masked_text(F.col("text"), F.coalesce("islands", F.expr(f"cast(array() as {sp.ISLANDS})")))).alias("masked_md5"))


@query(
    f"""with {fr.SQL_DOCS}, {fr.SQL_SPANS}, w as (select doc_id, trim(surface, chr(32)) as surface, label, min(span_id) as f from s group by all)
    select doc_id, row_number() over (partition by doc_id order by f, surface, label) - 1 as candidate, surface, label from w"""
)
def review_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sp.review_candidates(fr.spans(spark, sf_dir, _docs(spark, sf_dir)))
    return rows.withColumn("candidate", F.col("candidate").cast("long"))


@query(
    f"""with {fr.SQL_DOCS}, {fr.SQL_SPANS}, a as (select *, case when lag(end_pos) over w is null or start_pos - lag(end_pos) over w > 1 or lag(label) over w <> label then 1 else 0 end as new from s
        window w as (partition by doc_id, det order by start_pos, end_pos, span_id)),
    b as (select *, sum(new) over (partition by doc_id, det order by start_pos, end_pos, span_id rows between unbounded preceding and current row) as run from a)
    select doc_id, det, label, min(start_pos) as start_pos, max(end_pos) as end_pos, round(min(score), 6) as score, count(*) as n_spans from b group by doc_id, det, run, label"""
)
def adjacent_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sp.adjacent_runs(fr.spans(spark, sf_dir, _docs(spark, sf_dir))).withColumn("score", F.round("score", 6))


@query(f"with {fr.SQL_DOCS}, {fr.SQL_SPANS} select doc_id, det, count(*) as n_spans from s group by doc_id, det")
def detector_trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.trace(fr.spans(spark, sf_dir, _docs(spark, sf_dir)))


# ---- scoring


def _scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = _docs(spark, sf_dir)
    return scoring.doc_scores(documents, fr.gold(spark, sf_dir, documents), fr.spans(spark, sf_dir, documents), [(d,) for d in fr.detectors(spark, sf_dir)])


_DETS = "(select distinct det from candidate_spans where span_id is not null and det is not null)"


def _cover(relation: str, extra: str = "") -> str:
    return f"coalesce((select sum(least(t.e, i.end_pos) - greatest(t.s, i.start_pos)) from {relation} i where i.doc_id = t.doc_id {extra} and i.start_pos < t.e and t.s < i.end_pos), 0) * 2 >= t.e - t.s"


_SCORED = f"""{fr.SQL_DOCS}, {fr.SQL_GOLD}, {fr.SQL_SPANS}, {fr.SQL_TOKENS},
    {fr.sql_islands('ir', '(select * from g where required)', 'doc_id', 'span_no')}, {fr.sql_islands('ia', 'g', 'doc_id', 'span_no')}, {fr.sql_islands('ip', 's', 'doc_id, det', 'span_id')},
    tg as (select t.*, {_cover('ir')} as req, {_cover('ia')} as anyg from tok t),
    tp as (select t.*, d.det, {_cover('ip', 'and i.det = d.det')} as pred from tg t, {_DETS} d),
    et as (select g.doc_id, g.span_no, g.label, g.start_pos + k.s as s, g.start_pos + k.e as e, k.tok from g join (
        select doc_id, span_no, start_pos + length(surface) - length(ltrim(surface, {fr.q(fixed.STRIP)})) as s, start_pos + length(surface) - length(ltrim(surface, {fr.q(fixed.STRIP)})) + length(trim(surface, {fr.q(fixed.STRIP)})) as e, trim(surface, {fr.q(fixed.STRIP)}) as tok
        from ({fr.sql_matches('(select doc_id, span_no, surface as text from g where required)', f'[^{fr._WHITE}]+', 'doc_id, span_no')}) where length(trim(surface, {fr.q(fixed.STRIP)})) > 0) k
        on k.doc_id = g.doc_id and k.span_no = g.span_no where g.required and lower(k.tok) not in ({', '.join(map(fr.q, fixed.CONNECTORS))})),
    ev as (select t.*, d.det, not ({_cover('ip', 'and i.det = d.det')}) as visible from et t, {_DETS} d),
    en as (select g.doc_id, g.span_no, g.label, d.det, coalesce((select bool_or(visible) from ev where ev.doc_id = g.doc_id and ev.span_no = g.span_no and ev.det = d.det), false) as leaked from g, {_DETS} d where required),
    sc as (select docs.doc_id, docs.split, d.det,
        (select count(*) from tp where tp.doc_id = docs.doc_id and tp.det = d.det and req) as req, (select count(*) from tp where tp.doc_id = docs.doc_id and tp.det = d.det and req and pred) as req_hit,
        (select count(*) from tp where tp.doc_id = docs.doc_id and tp.det = d.det and pred) as pred, (select count(*) from tp where tp.doc_id = docs.doc_id and tp.det = d.det and pred and anyg) as pred_ok,
        (select count(*) from en where en.doc_id = docs.doc_id and en.det = d.det) as ents, (select count(*) from en where en.doc_id = docs.doc_id and en.det = d.det and leaked) as ents_leaked from docs, {_DETS} d)"""
_COUNTS = ("req", "req_hit", "pred", "pred_ok", "ents", "ents_leaked")


@query(f"with {_SCORED} select doc_id, det, {', '.join(f'cast({c} as integer) as {c}' for c in _COUNTS)} from sc")
def doc_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scores(spark, sf_dir).select("doc_id", "det", *_COUNTS)


_RATIOS = """round(case when req = 0 then 1 else req_hit / req end, 6) as token_recall, round(case when pred = 0 then 1 else pred_ok / pred end, 6) as token_precision,
    round(case when p + r = 0 then 0 else 2 * p * r / (p + r) end, 6) as f1, round(case when p + r = 0 then 0 else 5 * p * r / (4 * p + r) end, 6) as f2,
    round(1 - case when ents = 0 then 0 else ents_leaked / ents end, 6) as entity_recall, round(fp / docs, 6) as fp_per_doc"""
_TOTALS = "count(*) as docs, " + ", ".join(f"cast(sum({c}) as bigint) as {c}" for c in _COUNTS) + ", count(*) filter (ents_leaked > 0) as leak_docs, cast(sum(pred - pred_ok) as bigint) as fp"
_WITH_PR = "select *, case when req = 0 then 1.0 else req_hit / req end as r, case when pred = 0 then 1.0 else pred_ok / pred end as p from"


@query(f"with {_SCORED} select split, det, docs, req, req_hit, req - req_hit as fn, pred, pred_ok, fp, ents, ents_leaked, leak_docs, {_RATIOS} from ({_WITH_PR} (select split, det, {_TOTALS} from sc group by split, det))")
def corpus_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.corpus_scores(_scores(spark, sf_dir), ["split", "det"])


@query(f"with {_SCORED} select det, label, count(*) as total, count(*) filter (leaked) as leaked, round(1 - count(*) filter (leaked) / count(*), 3) as recall from en group by det, label")
def per_label_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.per_label_recall(_scores(spark, sf_dir), ["det"])


@query(f"with {_SCORED} select det, array_to_string(list_sort(list(distinct tok))[1:40], ' ') as examples from tp where pred and not anyg group by det")
def fp_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.fp_examples(_scores(spark, sf_dir), ["det"]).select("det", F.array_join("examples", " ").alias("examples"))


@query(f"with {_SCORED} select doc_id, det, label, span_no from en where leaked")
def leak_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _scores(spark, sf_dir).select("doc_id", "det", F.explode("ent_flags").alias("e")).where("e.leaked")
    return rows.select("doc_id", "det", "e.label", "e.span_no")


@query(
    f"""with {fr.SQL_DOCS}, {fr.SQL_GOLD}, {fr.SQL_SPANS} select coalesce(src, '') as src, label, count(*) as n_wrong, array_to_string(list_sort(list(distinct left(surface, 50)))[1:8], ' | ') as examples
    from s where not {_TOUCH} group by 1, 2 order by n_wrong desc, 1, 2 limit 15"""
)
def error_sources_top15(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = _docs(spark, sf_dir)
    return scoring.error_sources(fr.spans(spark, sf_dir, documents), fr.gold(spark, sf_dir, documents)).withColumn("examples", F.array_join("examples", " | "))


@query(
    f"""with {_SCORED} select en.det, en.label, count(*) as n_leaks, array_to_string(list_sort(list(distinct en.doc_id || ': ' || left(g.surface, 50)))[1:10], ' | ') as examples
    from en join g on g.doc_id = en.doc_id and g.span_no = en.span_no where leaked group by en.det, en.label"""
)
def leaks_by_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.leaks_by_label(_scores(spark, sf_dir), ["det"]).withColumn("examples", F.array_join("examples", " | "))


@query(
    """with e as (select distinct id, coalesce(len(fn_leaks), 0) as l, coalesce(len(fp_tokens), 0) as f, fn_leaks, fp_tokens from judge_errors__s3__h2__none)
    select count(*) as docs, count(*) filter (l > 0) as leak_docs, cast(sum(l) as bigint) as leaked, cast(sum(f) as bigint) as fp from e"""
)
def judge_error_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.leak_summary(table(spark, sf_dir, "judge_errors__s3__h2__none").distinct())


@query("select coalesce(f.label, 'OTHER') as label, count(*) as n_leaks from (select unnest(fn_leaks) as f from (select distinct * from judge_errors__s3__h2__none)) group by 1")
def judge_leaks_by_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "judge_errors__s3__h2__none").distinct().select(F.explode("fn_leaks").alias("f"))
    return rows.groupBy(F.coalesce("f.label", F.lit("OTHER")).alias("label")).agg(F.count("*").alias("n_leaks"))


# ---- experiments

_T = ", ".join(f"{t}::double" for t in ex.THRESHOLDS)
_SWEPT = f"""{fr.SQL_DOCS}, {fr.SQL_GOLD}, {fr.SQL_SPANS}, {fr.SQL_TOKENS}, th as (select unnest([{_T}]) as threshold),
    st as (select s.*, threshold from s, th where coalesce(score, 0) >= threshold and det in (select det from {_DETS})),
    {fr.sql_islands('ir', '(select * from g where required)', 'doc_id', 'span_no')}, {fr.sql_islands('ia', 'g', 'doc_id', 'span_no')}, {fr.sql_islands('ip', 'st', 'doc_id, det, threshold', 'span_id')},
    tg as (select t.*, {_cover('ir')} as req, {_cover('ia')} as anyg from tok t),
    tot as (select split, count(*) as docs from docs group by split),
    rq as (select split, count(*) filter (req) as req from tg join docs on docs.doc_id = tg.doc_id group by split),
    hit as (select t.doc_id, t.s, t.req, t.anyg, i.det, i.threshold from tg t join ip i on i.doc_id = t.doc_id and i.start_pos < t.e and t.s < i.end_pos
        group by t.doc_id, t.s, t.e, t.req, t.anyg, i.det, i.threshold having sum(least(t.e, i.end_pos) - greatest(t.s, i.start_pos)) * 2 >= t.e - t.s),
    hs as (select split, det, threshold, count(*) as pred, count(*) filter (req) as req_hit, count(*) filter (anyg) as pred_ok from hit join docs on docs.doc_id = hit.doc_id group by split, det, threshold),
    sw as (select tot.split, d.det, th.threshold, tot.docs, coalesce(rq.req, 0) as req, coalesce(req_hit, 0) as req_hit, coalesce(pred, 0) as pred, coalesce(pred_ok, 0) as pred_ok
        from tot left join rq on rq.split = tot.split, {_DETS} d, th left join hs on hs.split = tot.split and hs.det = d.det and hs.threshold = th.threshold)"""


def _sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = _docs(spark, sf_dir)
    return ex.sweep(documents, fr.gold(spark, sf_dir, documents), fr.spans(spark, sf_dir, documents), fr.detectors(spark, sf_dir))


_SHORT = "split, det, threshold, docs, req, req_hit, pred, pred_ok"


@query(f"with {_SWEPT} select {_SHORT}, round(case when p + r = 0 then 0 else 5 * p * r / (4 * p + r) end, 6) as f2 from ({_WITH_PR} sw)")
def threshold_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sweep(spark, sf_dir).select(*_SHORT.split(", "), "f2")


@query(
    f"""with {_SWEPT},
    et as (select g.doc_id, g.span_no, g.start_pos + k.s as s, g.start_pos + k.e as e from g join (
        select doc_id, span_no, start_pos + length(surface) - length(ltrim(surface, {fr.q(fixed.STRIP)})) as s, start_pos + length(surface) - length(ltrim(surface, {fr.q(fixed.STRIP)})) + length(trim(surface, {fr.q(fixed.STRIP)})) as e, trim(surface, {fr.q(fixed.STRIP)}) as tok
        from ({fr.sql_matches('(select doc_id, span_no, surface as text from g where required)', f'[^{fr._WHITE}]+', 'doc_id, span_no')}) where length(trim(surface, {fr.q(fixed.STRIP)})) > 0) k
        on k.doc_id = g.doc_id and k.span_no = g.span_no where g.required and lower(k.tok) not in ({', '.join(map(fr.q, fixed.CONNECTORS))})),
    held as (select t.doc_id, t.span_no, t.s, i.det, i.threshold from et t join ip i on i.doc_id = t.doc_id and i.start_pos < t.e and t.s < i.end_pos
        group by t.doc_id, t.span_no, t.s, t.e, i.det, i.threshold having sum(least(t.e, i.end_pos) - greatest(t.s, i.start_pos)) * 2 >= t.e - t.s),
    lk as (select d.det, th.threshold, count(distinct et.doc_id) as leak_docs from et join docs on docs.doc_id = et.doc_id and docs.split = 'devhard', {_DETS} d, th
        where not exists (select 1 from held where held.doc_id = et.doc_id and held.span_no = et.span_no and held.s = et.s and held.det = d.det and held.threshold = th.threshold) group by d.det, th.threshold),
    fs as (select sw.det, sw.threshold, coalesce(lk.leak_docs, 0) as leak_docs, round(case when p + r = 0 then 0 else 5 * p * r / (4 * p + r) end, 6) as f2
        from ({_WITH_PR} sw where split = 'devhard') sw left join lk on lk.det = sw.det and lk.threshold = sw.threshold)
    select det, threshold, f2, leak_docs from fs qualify row_number() over (partition by det order by f2 desc, leak_docs, threshold) = 1"""
)
def best_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ex.best_threshold(_sweep(spark, sf_dir), "devhard").select("det", "threshold", "f2", "leak_docs")


_FAMILY = "regexp_replace(stack, '#[0-9]+$', '')"


@query(f"with {fr.SQL_RUNS} select run_id, stack, f2, fp_per_doc from runs order by f2 desc nulls last, fp_per_doc asc nulls last, run_id limit 20")
def leaderboard_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ex.top_runs(fr.runs(spark, sf_dir)).select("run_id", "stack", "f2", "fp_per_doc")


@query(f"with {fr.SQL_RUNS} select run_id, stack, split, round(f2, 6) as f2, docs, leak_docs from runs order by f2 desc nulls last, fp_per_doc asc nulls last, run_id limit 1")
def best_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ex.best_run(fr.runs(spark, sf_dir)).select("run_id", "stack", "split", F.round("f2", 6).alias("f2"), "docs", "leak_docs")


@query(f"with {fr.SQL_RUNS} select family, split, run_id, f2 from (select *, {_FAMILY} as family, row_number() over (partition by {_FAMILY}, split order by f2 desc nulls last, fp_per_doc asc nulls last, run_id) as r from runs) where r = 1")
def best_per_stack(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fr.runs(spark, sf_dir).withColumn("family", F.regexp_replace("stack", "#[0-9]+$", ""))
    best = ex.best_per_stack(rows.withColumn("stack", F.struct("family", "split")))
    return best.select("family", "split", "run_id", "f2")


@query(f"with {fr.SQL_RUNS} select split, run_group, count(*) as n_runs, round(max(f2), 6) as best_f2, cast(min(leak_docs) as integer) as least_leaks from runs group by split, run_group")
def runs_by_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fr.runs(spark, sf_dir).groupBy("split", "run_group").agg(F.count("*").alias("n_runs"), F.round(F.max("f2"), 6).alias("best_f2"), F.min("leak_docs").alias("least_leaks"))


_PARAMS = "struct<detectors:map<string,double>,vote_k:int>"
_SQL_PARAMS = f"""{fr.SQL_RUNS}, pr as (select run_id, k as det, cast(json_extract(params::json, '$.detectors."' || k || '"') as double) as min_score, cast(coalesce(params::json ->> '$.vote_k', '1') as integer) as vote_k
        from (select run_id, params, unnest(json_keys(params::json, '$.detectors')) as k from runs where params is not null and json_valid(params)))"""


def _parameters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fr.runs(spark, sf_dir).select("run_id", F.from_json("params", _PARAMS).alias("p"))
    return rows.select("run_id", F.explode("p.detectors").alias("det", "min_score"), F.coalesce("p.vote_k", F.lit(1)).alias("vote_k"))


@query(f"with {_SQL_PARAMS} select * from pr")
def run_parameters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _parameters(spark, sf_dir)


@query(
    f"""with {fr.SQL_DOCS}, {fr.SQL_SPANS}, {_SQL_PARAMS}, kept as (select s.*, vote_k from s join pr on pr.run_id = s.run_id and pr.det = s.det where coalesce(s.score, 0) >= pr.min_score)
    select run_id, count(*) as n_spans from kept x where vote_k <= 1 or 1 + (select count(distinct y.det) from kept y where y.doc_id = x.doc_id and y.run_id = x.run_id and y.det <> x.det and x.start_pos < y.end_pos and y.start_pos < x.end_pos) >= vote_k group by run_id"""
)
def stack_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each run's spans after its detectors' score floors and its vote."""
    from cloakframe.operators import detectors

    rows = detectors.stack_spans(fr.spans(spark, sf_dir, _docs(spark, sf_dir)), _parameters(spark, sf_dir))
    return rows.groupBy("run_id").agg(F.count("*").alias("n_spans"))
