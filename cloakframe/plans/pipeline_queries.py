"""Queries over the whole pipeline and its stages; checked against hand-written cases where SQL has no such pattern."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cloakframe.functions import fixed, textops
from cloakframe.operators import detectors, identity, judge, policy, rules, scoring
from cloakframe.operators import spans as sp
from cloakframe.plans import catalogue, pipeline
from cloakframe.plans import frames as fr
from cloakframe.plans.catalogue import query


def _found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pipeline.run(fr.docs(spark, sf_dir))


@query()
def rule_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.scan(fr.docs(spark, sf_dir)).select("doc_id", "ord", "start_pos", "end_pos", "label", "src", "rule", "surface", "section")


_NOT_W, _W_END = r"(?:^|[^\p{L}\p{N}_])", r"(?:$|[^\p{L}\p{N}_])"
_WORDS = lambda words: textops.words_any(words, "").replace("'", "''")
_HEADER_SQL = rf"""with {fr.SQL_DOCS}, {catalogue._SECTIONED},
    hc as (select doc_id, min(line_no) as c from sec where section in ({", ".join(map(fr.q, fixed.CONTENT_SECTIONS))}) group by doc_id),
    hf as (select sec.*, i.title, trim(trim(sec.line, ' '), '#*_ ') as t, row_number() over (partition by sec.doc_id order by sec.line_no) as seen from sec
        join i on i.doc_id = sec.doc_id and i.line_no = sec.line_no left join hc on hc.doc_id = sec.doc_id
        where length(trim(trim(sec.line, ' '), '#*_ ')) > 0 and sec.line_no < coalesce(hc.c, 2000000000)),
    hn as (select *, trim(regexp_replace(case when regexp_full_match(t, '[^,]+,\s*[^,]+') then t else string_split_regex(t, '\s{{3,}}|\s[–—|·•]\s|,\s')[1] end,
        ',?\s*\b(?:{"|".join(c.replace(".", "[.]") for c in sorted(fixed.CREDENTIALS, key=len, reverse=True))})\b\.?', '', 'g'), ' ,') as name from hf where seen <= 5),
    hv as (select *, list_transform(string_split_regex(name, '\s+'), lambda w: trim(w, '(),')) as w,
        title or regexp_matches(t, '(?i)^(?:europass\s+)?{_WORDS(fixed.DOCUMENT_TITLES)}(?:\s*[-–:]\s*.*)?$') or regexp_matches(t, '[\d@|:]|https?:') as passed from hn),
    hj as (select *, case when passed then 'skip' when not regexp_matches(name, '(?i){_NOT_W}{_WORDS(fixed.TITLE_WORDS)}{_W_END}') and len(w) between 2 and 7
            and len(list_filter(w, lambda x: not (x = '' or regexp_matches(x, '^[\p{{Lu}}\p{{Lo}}]') or lower(x) in ({", ".join(map(fr.q, fixed.NAME_PARTICLES))})))) = 0
            and len(list_filter(w, lambda x: not (lower(x) in ({", ".join(map(fr.q, sorted({*textops.EVERY_SECTION_WORD, *fixed.FIELD_LABELS})))})))) > 0 and strpos(line, name) > 0 then 'name'
            when seen = 1 then 'skip' else 'stop' end as v from hv),
    hk as (select *, row_number() over (partition by doc_id order by seen) as r from hj where v <> 'skip')
    select doc_id, cast(start_pos + strpos(line, name) - 1 as integer) as start_pos, cast(start_pos + strpos(line, name) - 1 + length(name) as integer) as end_pos, 'NAME' as label, 're-headername' as src, name as surface
    from hk where r = 1 and v = 'name'"""


@query(_HEADER_SQL)
def header_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return policy.header_names(fr.docs(spark, sf_dir))


@query()
def policy_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Detector spans and rule spans after the policy."""
    documents = fr.docs(spark, sf_dir)
    return policy.apply(pipeline.candidates(documents, fr.spans(spark, sf_dir, documents))).select("doc_id", "start_pos", "end_pos", "label", "src")


@query()
def propagated_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _found(spark, sf_dir).where("src = 'prop'")


@query()
def pipeline_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _found(spark, sf_dir)


@query()
def masked_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flagship: rules, policy, propagation and safety net over every record, merged and masked."""
    return pipeline.masked(pipeline.found(fr.docs(spark, sf_dir)))


@query()
def rules_only_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = fr.docs(spark, sf_dir)
    return pipeline.evaluate(documents, fr.gold(spark, sf_dir, documents), pipeline.run(documents), "rules only")


_LIMIT, _SHARED = 1200, 2
_BROKEN = """ln as (select doc_id, i, a[i] as line, length(a[i]) as n, len(a) as k, cast(list_sum(list_transform(a[1:i], lambda z: length(z))) as bigint) as up_to
        from (select doc_id, a, unnest(range(1, len(a) + 1)) as i from (select doc_id, regexp_extract_all(text, '[^\\n]*\\n|[^\\n]+') as a from docs)))"""
_CHUNKS = f"""{fr.SQL_DOCS}, {_BROKEN},
    packed as (select doc_id, i, n, 0 as chunk_no, n as filled from ln where i = 1
        union all select ln.doc_id, ln.i, ln.n, case when p.filled + ln.n > {_LIMIT} then p.chunk_no + 1 else p.chunk_no end, case when p.filled + ln.n > {_LIMIT} then ln.n else p.filled + ln.n end
        from packed p join ln on ln.doc_id = p.doc_id and ln.i = p.i + 1),
    ch as (select packed.doc_id, packed.chunk_no, min(ln.up_to - ln.n) as start_pos, max(ln.up_to) as end_pos, string_agg(ln.line, '' order by ln.i) as chunk
        from packed join ln on ln.doc_id = packed.doc_id and ln.i = packed.i group by packed.doc_id, packed.chunk_no)"""


@query(f"with recursive {_CHUNKS} select doc_id, chunk_no, cast(start_pos as integer) as start_pos, cast(end_pos as integer) as end_pos, chunk from ch")
def chunked_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detectors.chunks(fr.docs(spark, sf_dir), _LIMIT)


@query(
    f"""with recursive {fr.SQL_DOCS}, {_BROKEN},
    reach as (select x.doc_id, x.i, x.k, x.up_to - x.n as start_pos, greatest(x.i, max(case when y.up_to - x.up_to + x.n <= {_LIMIT} then y.i else 0 end)) as last
        from ln x join ln y on y.doc_id = x.doc_id and y.i >= x.i group by x.doc_id, x.i, x.k, x.up_to, x.n),
    walk as (select doc_id, 0 as chunk_no, i, last, k from reach where i = 1
        union all select r.doc_id, w.chunk_no + 1, r.i, r.last, r.k from walk w join reach r on r.doc_id = w.doc_id and w.last < w.k and r.i = greatest(w.i + 1, w.last + 1 - {_SHARED}))
    select w.doc_id, w.chunk_no, cast(min(ln.up_to - ln.n) as integer) as start_pos, cast(max(ln.up_to) as integer) as end_pos, string_agg(ln.line, '' order by ln.i) as chunk
    from walk w join ln on ln.doc_id = w.doc_id and ln.i between w.i and w.last group by w.doc_id, w.chunk_no"""
)
def line_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detectors.line_windows(fr.docs(spark, sf_dir), _LIMIT, _SHARED)


@query(
    f"""with recursive {_CHUNKS}, {fr.SQL_GOLD}, x as (select distinct ch.doc_id, ch.chunk_no, g.label, g.surface from ch join g on g.doc_id = ch.doc_id and g.required and g.start_pos >= ch.start_pos and g.end_pos <= ch.end_pos)
    select doc_id, chunk_no, label, string_agg(surface, chr(10) order by surface) as surfaces from x group by all"""
)
def training_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = fr.docs(spark, sf_dir)
    rows = detectors.training_examples(documents, fr.gold(spark, sf_dir, documents), _LIMIT)
    return rows.withColumn("surfaces", F.array_join("surfaces", "\n"))


@query(
    f"""with {fr.SQL_DOCS}, {fr.SQL_SPANS}, {catalogue._SECTIONED},
    o as (select s.doc_id, s.span_id, trim(s.surface, ' ') as surface, s.label, coalesce(sec.line, '') as line from s left join sec on sec.doc_id = s.doc_id and s.start_pos between sec.start_pos and sec.start_pos + length(sec.line)
        where s.det <> 'rules' and s.src not in ({", ".join(map(fr.q, judge.TRUSTED))}) and s.label in ({", ".join(map(fr.q, judge.REVIEWED))})),
    u as (select doc_id, surface, label, min(span_id) as f, arg_min(line, span_id) as line from o group by all),
    r as (select *, row_number() over (partition by doc_id order by f, surface, label) - 1 as c from u)
    select doc_id, string_agg(c || '. [' || label || '] ' || surface || ' | ' || left(trim(line, ' '), 140), chr(10) order by c) as question from r group by doc_id"""
)
def judge_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = fr.docs(spark, sf_dir)
    models = fr.spans(spark, sf_dir, documents).where("det <> 'rules'")
    return judge.questions(sp.with_context(documents, models))


@query(
    f"""with {catalogue._SCORED} select ev.doc_id, ev.det, ev.span_no, ev.label, g.surface as text, string_agg(ev.tok, ' ' order by ev.s) as visible
    from ev join g on g.doc_id = ev.doc_id and g.span_no = ev.span_no where ev.visible group by all"""
)
def recorded_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each recorded detector leaves visible, in the form of the judge's error rows, a row for each leak."""
    documents = fr.docs(spark, sf_dir)
    scores = scoring.doc_scores(documents, fr.gold(spark, sf_dir, documents), fr.spans(spark, sf_dir, documents), [(d,) for d in fr.detectors(spark, sf_dir)])
    leaked = F.filter("ent_flags", lambda e: e["leaked"])
    rows = scores.select("doc_id", "det", F.explode(F.arrays_zip("leaks", leaked.alias("flags"))).alias("x"))
    return rows.select("doc_id", "det", F.col("x.flags.span_no").alias("span_no"), F.col("x.leaks.label").alias("label"), F.col("x.leaks.text").alias("text"), F.array_join("x.leaks.visible", " ").alias("visible"))


@query()
def leaks_by_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per-document errors of the rules-only stack, in the form of the judge's error rows."""
    documents = fr.docs(spark, sf_dir)
    rows = scoring.doc_scores(documents, fr.gold(spark, sf_dir, documents), pipeline.run(documents).withColumn("det", F.lit("rules")), [("rules",)])
    return rows.select("doc_id", "split", F.to_json("leaks").alias("leaks"), F.array_join("fp_tokens", " ").alias("fp_tokens"))


@query(
    f"with {fr.SQL_RUNS} select run_id, coalesce(params::json ->> '$.vote_k', '') as vote_k, case when params is null then 'none' when json_valid(params) then 'json' else 'text' end as kind from runs"
)
def parameter_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("params").isNull(), "none").when(F.try_parse_json("params").isNotNull(), "json").otherwise("text")
    return fr.runs(spark, sf_dir).select("run_id", F.coalesce(F.get_json_object("params", "$.vote_k"), F.lit("")).alias("vote_k"), kind.alias("kind"))


@query(f"select label as raw_label, coalesce({fr.sql_label('label')}, 'OTHER') as label, count(*) as n from candidate_spans group by 1, 2")
def unified_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A null label counts as OTHER."""
    rows = fr.table(spark, sf_dir, "candidate_spans")
    return rows.groupBy(F.col("label").alias("raw_label"), F.coalesce(textops.unified_label(F.col("label")), F.lit("OTHER")).alias("label")).agg(F.count("*").alias("n"))


#: Which kind each recorded detector is of.
KINDS = {"tagger_s": "tagger", "tagger_l": "tagger", "spanner": "spanner", "spanner_ft": "spanner2", "filter_tok": "filter", "hosted_mix": "engine"}


def _sql_map(column: str, known: dict[str, str], otherwise: str) -> str:
    return f"case {column} {' '.join(f'when {fr.q(a)} then {fr.q(b)}' for a, b in known.items())} else {otherwise} end"


_FREE = f"case lower(label) {' '.join(f'when {fr.q(a)} then {fr.q(b)}' for a, b in fixed.FREE_LABELS.items())} else case {' '.join(f'when contains(lower(label), {fr.q(a)}) then {fr.q(b)}' for a, b in fixed.FREE_LABEL_PARTS)} else 'OTHER' end end"
_BY_KIND = " ".join(f"when {fr.q(det)} then {_sql_map('label', detectors.LABEL_MAPS[kind], 'null' if kind in detectors.DROPPING else _FREE if kind == 'filter' else chr(39) + 'OTHER' + chr(39))}" for det, kind in KINDS.items())


@query(f"select * from (select det, label as raw_label, case det {_BY_KIND} end as label, count(*) as n from candidate_spans where det in ({', '.join(map(fr.q, KINDS))}) and label is not null group by 1, 2, 3) where label is not null")
def labels_by_detector(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each detector's labels by the map of its kind; what that map drops is gone."""
    rows = fr.table(spark, sf_dir, "candidate_spans").where("label is not null")
    out = None
    for det, kind in KINDS.items():
        part = rows.where(F.col("det") == det).groupBy("det", F.col("label").alias("raw_label"), detectors.detector_label(kind, F.col("label")).alias("label")).agg(F.count("*").alias("n"))
        out = part if out is None else out.unionByName(part)
    return out.where("label is not null")


_HITS = ", ".join(f"len(list_filter(w, lambda x: x in ({', '.join(map(fr.q, words))}))) as n{i}" for i, words in enumerate(fixed.LANGUAGE_WORDS.values()))
_MOST = f"greatest({', '.join(f'n{i}' for i in range(len(fixed.LANGUAGE_WORDS)))})"


@query(
    f"""with {fr.SQL_DOCS}, h as (select doc_id, {_HITS} from (select doc_id, string_split_regex(lower(text), '[^\\p{{L}}]+') as w from docs))
    select doc_id, case when {_MOST} = 0 then 'ENGLISH' {" ".join(f"when n{i} = {_MOST} then {fr.q(k)}" for i, k in enumerate(fixed.LANGUAGE_WORDS))} end as lang from h"""
)
def document_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fr.docs(spark, sf_dir).select("doc_id", detectors.detect_lang(F.col("text")).alias("lang"))


@query(
    f"""with {fr.SQL_DOCS}, w as (select doc_id, text, unnest(range(0, greatest(0, length(text) - 51) + 1, 200)) as a from docs where length(text) > 0),
    e as (select *, least(length(text), a + 250 + case when regexp_matches(substr(text, a + 250, 1), '[\\p{{L}}\\p{{N}}_]') then length(regexp_extract(substr(text, a + 251, 100), '^[\\p{{L}}\\p{{N}}_]*')) else 0 end) as b from w)
    select doc_id, cast(a as integer) as start_pos, cast(b as integer) as end_pos, md5(substr(text, a + 1, b - a)) as chunk_md5 from e"""
)
def char_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detectors.char_windows(fr.docs(spark, sf_dir), 250, 50).select("doc_id", "start_pos", "end_pos", F.md5("chunk").alias("chunk_md5"))


@query(
    f"""with {fr.SQL_DOCS}, {fr.SQL_SPANS}, o as (select doc_id, start_pos, end_pos, label, coalesce(src, '') as src, max(coalesce(score, 0)) as score from s group by all)
    select doc_id, start_pos, end_pos, label, src, round(score, 6) as score from o x where not exists (select 1 from o y where y.doc_id = x.doc_id and y.label = x.label and y.src = x.src and x.start_pos < y.end_pos and y.start_pos < x.end_pos
        and (x.start_pos <> y.start_pos or x.end_pos <> y.end_pos) and (y.score > x.score or (y.score = x.score and (y.end_pos - y.start_pos > x.end_pos - x.start_pos or (y.end_pos - y.start_pos = x.end_pos - x.start_pos and y.start_pos < x.start_pos)))))"""
)
def merged_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recorded spans as if from overlapping windows: of those that overlap with one label and source the best stay."""
    rows = fr.spans(spark, sf_dir, fr.docs(spark, sf_dir)).withColumns({"src": F.coalesce("src", F.lit("")), "score": F.coalesce("score", F.lit(0.0))})
    return detectors.merged_windows(rows.select("doc_id", "start_pos", "end_pos", "label", "src", "score")).withColumn("score", F.round("score", 6))


def _replies(documents: DataFrame, models: DataFrame, gold: DataFrame) -> DataFrame:
    """Made-up replies of a judge: every odd candidate is to stay visible, and each document's first gold surface was missed."""
    numbered = sp.review_candidates(models.where(~F.col("src").isin(*judge.TRUSTED) & F.col("label").isin(*judge.REVIEWED)))
    verdict = F.map_from_entries(F.collect_list(F.struct(F.col("candidate").cast("string"), F.when(F.col("candidate") % 2 == 1, "keep visible").otherwise("mask"))))
    missed = gold.groupBy("doc_id").agg(F.min_by(F.struct(F.col("surface").alias("text"), "label"), "span_no").alias("m"))
    rows = numbered.groupBy("doc_id").agg(verdict.alias("d")).join(missed, "doc_id", "full_outer")
    none = F.expr("cast(map() as map<string,string>)")
    return rows.select("doc_id", F.concat(F.lit("Here it is: "), F.to_json(F.struct(F.coalesce("d", none).alias("decisions"), F.array_compact(F.array("m")).alias("missed")))).alias("out"))


@query(
    f"""with {fr.SQL_DOCS}, {fr.SQL_SPANS}, {fr.SQL_GOLD}, z as (select * replace (coalesce(src, '') as src) from s where det <> 'rules'),
    o as (select *, trim(surface, ' ') as t from z where src not in ({", ".join(map(fr.q, judge.TRUSTED))}) and label in ({", ".join(map(fr.q, judge.REVIEWED))})),
    u as (select doc_id, t, label, row_number() over (partition by doc_id order by min(span_id), t, label) - 1 as c from o group by doc_id, t, label),
    w as (select doc_id, trim(arg_min(surface, span_no), ' ') as surface, case when upper(trim(arg_min(label, span_no), ' ')) in ({", ".join(map(fr.q, fixed.REPLY_LABELS))}) then upper(trim(arg_min(label, span_no), ' ')) else 'OTHER' end as label from g group by doc_id),
    added as ({catalogue._LOCATE.format("(select * from w where length(surface) >= 2)")})
    select doc_id, span_id, start_pos, end_pos, label, src from z where src in ({", ".join(map(fr.q, judge.TRUSTED))}) or label not in ({", ".join(map(fr.q, judge.REVIEWED))})
    union all select o.doc_id, o.span_id, o.start_pos, o.end_pos, o.label, o.src || '+adj' from o join u on u.doc_id = o.doc_id and u.t = o.t and u.label = o.label where u.c % 2 = 0
    union all select doc_id, null, start_pos, end_pos, label, 're-llm-add' from added"""
)
def judged_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recorded model spans after a judge whose replies are made up by a rule."""
    documents = fr.docs(spark, sf_dir)
    models = fr.spans(spark, sf_dir, documents).where("det <> 'rules'").withColumn("src", F.coalesce("src", F.lit("")))
    replies = _replies(documents, models, fr.gold(spark, sf_dir, documents))
    return judge.adjudicated(documents, models, replies).select("doc_id", "span_id", "start_pos", "end_pos", "label", "src")


@query(
    f"""with {fr.SQL_DOCS}, {fr.SQL_GOLD}, w as (select distinct doc_id, trim(surface, ' ') as surface, case when upper(trim(label, ' ')) in ({", ".join(map(fr.q, fixed.REPLY_LABELS))}) then upper(trim(label, ' ')) else 'OTHER' end as label from g where length(trim(surface, ' ')) >= 2)
    {catalogue._LOCATE.format("w")}"""
)
def extracted_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of recorded extraction replies, here made up from the annotation."""
    documents = fr.docs(spark, sf_dir)
    items = F.collect_list(F.struct(F.col("surface").alias("text"), "label"))
    replies = fr.gold(spark, sf_dir, documents).groupBy("doc_id").agg(F.concat(F.lit("Sure. "), F.to_json(F.struct(items.alias("pii")))).alias("out"))
    return judge.extracted(documents, replies).select("doc_id", "surface", "label", "start_pos", "end_pos")


@query()
def stack_masked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole pipeline over recorded detectors that vote two by two, with a judge's replies, masked."""
    documents = fr.docs(spark, sf_dir)
    recorded = fr.spans(spark, sf_dir, documents).where("det <> 'rules'")
    models = recorded.withColumn("src", F.coalesce("src", F.lit("")))
    replies = _replies(documents, models, fr.gold(spark, sf_dir, documents))
    return pipeline.masked(pipeline.found(documents, recorded, policy.Config(vote_k=2), replies))


_UNSAFE = ", ".join(map(fr.q, identity.UNSAFE))
_KNOWN = f"""n0 as (select distinct doc_id, list_filter(regexp_extract_all(surface, '[\\p{{L}}\\p{{N}}_''’-]+'), lambda x: length(x) > 1) as w from g where label = 'NAME'),
    n1 as (select doc_id, case when len(w) > 2 then list_filter(w, lambda x: not (upper(x) = x and lower(x) <> x and length(x) <= 5)) else w end as w from n0),
    n2 as (select doc_id, array_to_string(w, ' ') as full_name, list_filter(list_concat([w[-1]], case when contains(w[-1], '-') then list_filter(string_split(w[-1], '-'), lambda x: length(x) > 3) else [] end),
        lambda x: trim(lower(x), '.,()') not in ({", ".join(map(fr.q, fixed.TECH))}) and lower(x) not in ({_UNSAFE}) and length(x) > 2) as single from n1 where len(w) >= 2)"""


def _seeded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records with the annotation's names as if rules had found them."""
    documents = fr.docs(spark, sf_dir)
    names = fr.gold(spark, sf_dir, documents).where("label = 'NAME'").groupBy("doc_id")
    packed = names.agg(F.collect_list(F.struct("start_pos", "end_pos", "label", F.lit("re").alias("src"), "surface", F.lit("header").alias("section"))).alias("spans"))
    return documents.join(packed, "doc_id").select("doc_id", "text", "spans", identity.known_names(F.col("spans")).alias("names"))


@query(f"with {fr.SQL_DOCS}, {fr.SQL_GOLD}, {_KNOWN} select distinct doc_id, full_name, array_to_string(single, ' ') as single from n2")
def known_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Full names and the single words that may be looked for again."""
    rows = _seeded(spark, sf_dir).select("doc_id", F.explode("names").alias("n"))
    return rows.select("doc_id", F.col("n.full").alias("full_name"), F.array_join("n.single", " ").alias("single")).distinct()


@query(
    f"""with {fr.SQL_DOCS}, {fr.SQL_GOLD}, {_KNOWN},
    w1 as (select distinct doc_id, unnest([full_name, upper(full_name)]) as surface, 'NAME' as label from n2),
    w2 as (select distinct doc_id, unnest(single) as surface, 'NAME' as label from n2),
    found1 as ({catalogue._LOCATE.format("w1")}), found2 as ({catalogue._LOCATE.format("w2")})
    select distinct doc_id, surface, start_pos, end_pos from (select * from found1 union all select f.* from found2 f join docs d on d.doc_id = f.doc_id
        where not (f.start_pos > 0 and regexp_matches(substr(d.text, f.start_pos, 1), '[\\p{{L}}\\p{{N}}_@.]')) and not regexp_matches(substr(d.text, f.end_pos + 1, 1), '[\\p{{L}}\\p{{N}}_]'))"""
)
def carried_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of the annotation found again: as written, in capitals, and single words."""
    rows = identity.spread(_seeded(spark, sf_dir), True, False).select("doc_id", F.explode("found").alias("f")).where("f.label = 'NAME'")
    return rows.select("doc_id", "f.surface", "f.start_pos", "f.end_pos").distinct()


@query()
def partner_unions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Second pass of a sweep: one tagger's spans with those of each detector that passes a gate, at their best thresholds."""
    from cloakframe.plans import experiments as ex

    documents = fr.docs(spark, sf_dir)
    gold, spans = fr.gold_rows(spark, sf_dir), fr.span_rows(spark, sf_dir)
    gate = "devhard"  # a split's scores come from its own records only
    swept = ex.sweep(documents.where(F.col("split") == gate), gold, spans, fr.detectors(spark, sf_dir))
    return ex.union_sweep(documents, gold, spans, "tagger_l", ex.gated(swept, gate, 0.05))


assert catalogue  # the queries above register themselves there


@query(
    "select cast(epoch(date_trunc('hour', seen_at)) as bigint) as since, label, count(*) as n_spans from candidate_spans where seen_at is not null group by 1, 2"
)
def label_counts_by_hour(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The streaming aggregate run over a table as one batch."""
    from cloakframe.streaming.masking import label_counts

    return label_counts(fr.table(spark, sf_dir, "candidate_spans")).withColumn("since", F.unix_timestamp("since"))


@query(
    """with a as (select doc_id, seen_at, case when lag(seen_at) over w is null or seen_at >= lag(seen_at) over w + interval 30 minutes then 1 else 0 end as new
        from candidate_spans where seen_at is not null and doc_id is not null window w as (partition by doc_id order by seen_at)),
    b as (select *, sum(new) over (partition by doc_id order by seen_at rows between unbounded preceding and current row) as s from a)
    select doc_id, cast(floor(epoch(min(seen_at))) as bigint) as since, cast(floor(epoch(max(seen_at) + interval 30 minutes)) as bigint) as until, count(*) as n_spans from b group by doc_id, s"""
)
def detection_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cloakframe.streaming.masking import sessions

    rows = sessions(fr.table(spark, sf_dir, "candidate_spans").where("doc_id is not null"))
    return rows.withColumns({"since": F.unix_timestamp("since"), "until": F.unix_timestamp("until")})


@query(
    f"with {fr.SQL_DOCS}, x as (select distinct doc_id, span_no, start_pos, end_pos, text as surface from gold) select x.doc_id, x.span_no from x join docs on docs.doc_id = x.doc_id where substr(docs.text, x.start_pos + 1, x.end_pos - x.start_pos) is distinct from x.surface and x.start_pos >= 0 and x.end_pos > x.start_pos"
)
def gold_mismatches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Annotation rows whose text is not the record's substring."""
    rows = fr.table(spark, sf_dir, "gold").select("doc_id", "span_no", "start_pos", "end_pos", F.col("text").alias("surface")).distinct()
    joined = rows.where("start_pos >= 0 and end_pos > start_pos").join(fr.docs(spark, sf_dir), "doc_id")
    own = F.substring(F.col("text"), F.col("start_pos") + 1, F.col("end_pos") - F.col("start_pos"))
    return joined.where(~own.eqNullSafe(F.col("surface"))).select("doc_id", "span_no")


@query()
def ablation_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules alone, and with one switch changed at a time."""
    from cloakframe.operators.detectors import Stack
    from cloakframe.plans import stacks

    documents = fr.docs(spark, sf_dir)
    tried = stacks.ablations(Stack("rules", {}), {"propagate": ["none"], "safety_net": [False], "location_lines": [False]})
    scores = stacks.evaluate_all(documents, fr.gold(spark, sf_dir, documents), fr.spans(spark, sf_dir, documents), tried)
    return stacks.summary(scores)
