"""The cleaned tables that queries share, and the same cleaning as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cloakframe.functions import fixed, textops
from cloakframe.session import collect_bounded, spread, table

MAX_DETECTORS = 200


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each record: redelivered rows repeat everything but their load time."""
    rows = table(spark, sf_dir, "datasets").where("id is not null and text is not null")
    named = rows.select(F.col("id").alias("doc_id"), textops.split_name(F.col("split")).alias("split"), "text")
    return spread(named, "doc_id").dropDuplicates(["doc_id"])


def _clip(rows: DataFrame, documents: DataFrame) -> DataFrame:
    """Swapped offsets put right, overrunning ones cut; spans of unknown documents and empty ones are dropped."""
    sized = rows.join(documents.select("doc_id", "text"), "doc_id")
    a, b = F.greatest(F.lit(0), F.least("start_pos", "end_pos")), F.least(F.length("text"), F.greatest("start_pos", "end_pos"))
    sized = sized.withColumns({"_a": a.cast("int"), "_b": b.cast("int")}).where("start_pos is not null and end_pos is not null and _a < _b")
    return sized.withColumns({"start_pos": F.col("_a"), "end_pos": F.col("_b"), "surface": F.substring(F.col("text"), F.col("_a") + 1, F.col("_b") - F.col("_a"))}).drop("_a", "_b", "text")


def gold_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The annotation, each row once, with offsets as they are."""
    rows = table(spark, sf_dir, "gold").where("doc_id is not null and span_no is not null")
    first = rows.groupBy("doc_id", "span_no").agg(F.min(F.struct("start_pos", "end_pos", "label", "required")).alias("x")).select("doc_id", "span_no", "x.*")
    return first.withColumns({"label": F.coalesce("label", F.lit("OTHER")), "required": F.coalesce("required", F.lit(True))})


def gold(spark: SparkSession, sf_dir: str, documents: DataFrame) -> DataFrame:
    return _clip(gold_rows(spark, sf_dir), documents)


def span_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Detector spans, each once, with offsets as they are."""
    rows = table(spark, sf_dir, "candidate_spans").where("span_id is not null")
    first = rows.groupBy("span_id").agg(F.min(F.struct("seen_at", "doc_id", "run_id", "det", "start_pos", "end_pos", "label", "src", "score")).alias("x")).select("span_id", "x.*")
    return first.withColumn("label", F.coalesce(textops.unified_label(F.col("label")), F.lit("OTHER"))).drop("seen_at")


def spans(spark: SparkSession, sf_dir: str, documents: DataFrame) -> DataFrame:
    return _clip(span_rows(spark, sf_dir), documents)


def detectors(spark: SparkSession, sf_dir: str) -> list[str]:
    """The detectors that have a recorded span: as many as there are models, at most ``MAX_DETECTORS``."""
    rows = table(spark, sf_dir, "candidate_spans").where("span_id is not null and det is not null").select("det").distinct()
    return sorted(r.det for r in collect_bounded(rows, MAX_DETECTORS, "detectors"))


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs once each, with the split's full name; ``log_order`` is the order of the log."""
    rows = table(spark, sf_dir, "leaderboard").where("run_id is not null").dropDuplicates(["run_id"])
    return rows.withColumns({"split": textops.split_name(F.col("split")), "log_order": F.col("run_id")})


# ---- the same in SQL

_WHITE = r"\s\x{0b}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def sql_split(column: str) -> str:
    whens = " ".join(f"when {q(a)} then {q(b)}" for a, b in fixed.SPLIT_ALIAS.items())
    return f"(case lower(trim({column})) {whens} else lower(trim({column})) end)"


def sql_label(column: str) -> str:
    up = f"upper(regexp_replace(trim({column}), '[\\s-]+', '_', 'g'))"
    same = f"when {up} in ({', '.join(map(q, fixed.LABELS))}) then {up}"
    exact = " ".join(f"when {up} = {q(a)} then {q(b)}" for a, b in fixed.LABEL_MAP.items())
    words = " ".join(f"when contains({up}, {q(a)}) then {q(b)}" for a, b in fixed.LABEL_WORDS)
    return f"(case {same} {exact} {words} else 'OTHER' end)"


def _sql_clip(source: str, extra: str) -> str:
    return f"""select x.doc_id, {extra}, cast(greatest(0, least(start_pos, end_pos)) as integer) as start_pos, cast(least(length(d.text), greatest(start_pos, end_pos)) as integer) as end_pos
        from {source} x join docs d on d.doc_id = x.doc_id where start_pos is not null and end_pos is not null"""


SQL_DOCS = f"docs as (select id as doc_id, any_value({sql_split('split')}) as split, any_value(text) as text from datasets where id is not null and text is not null group by id)"
SQL_GOLD = f"""gold0 as (select * from gold where doc_id is not null and span_no is not null
        qualify row_number() over (partition by doc_id, span_no order by start_pos nulls first, end_pos nulls first, label nulls first, required nulls first) = 1),
    gold1 as ({_sql_clip('gold0', "span_no, coalesce(label, 'OTHER') as label, coalesce(required, true) as required")}),
    g as (select gold1.*, substr(d.text, start_pos + 1, end_pos - start_pos) as surface from gold1 join docs d on d.doc_id = gold1.doc_id where start_pos < end_pos)"""
SQL_SPANS = f"""span0 as (select * from candidate_spans where span_id is not null
        qualify row_number() over (partition by span_id order by seen_at nulls first, doc_id nulls first, run_id nulls first, det nulls first, start_pos nulls first, end_pos nulls first, label nulls first, src nulls first, score nulls first) = 1),
    span1 as ({_sql_clip('span0', f"span_id, run_id, det, src, score, coalesce({sql_label('label')}, 'OTHER') as label")}),
    s as (select span1.*, substr(d.text, start_pos + 1, end_pos - start_pos) as surface from span1 join docs d on d.doc_id = span1.doc_id where start_pos < end_pos)"""
SQL_RUNS = f"runs as (select * replace ({sql_split('split')} as split) from leaderboard where run_id is not null qualify row_number() over (partition by run_id order by ts) = 1)"


def sql_parts(pattern: str, text: str = "text") -> str:
    return f"string_split(regexp_replace(translate({text}, chr(1), ' '), '({pattern})', chr(1) || '\\1' || chr(1), 'g'), chr(1))"


def sql_matches(relation: str, pattern: str, keys: str = "doc_id") -> str:
    """Rows of every match: keys, start_pos, end_pos, surface."""
    return f"""select {keys}, cast(list_sum(list_transform(a[1:i-1], lambda z: length(z))) as integer) as start_pos, cast(list_sum(list_transform(a[1:i], lambda z: length(z))) as integer) as end_pos, a[i] as surface
        from (select {keys}, a, unnest(range(2, len(a) + 1, 2)) as i from (select {keys}, {sql_parts(pattern)} as a from {relation}))"""


SQL_TOKENS = f"""tok0 as ({sql_matches('docs', f'[^{_WHITE}]+')}),
    tok as (select doc_id, start_pos + length(surface) - length(ltrim(surface, {q(fixed.STRIP)})) as s, start_pos + length(surface) - length(ltrim(surface, {q(fixed.STRIP)})) + length(trim(surface, {q(fixed.STRIP)})) as e, trim(surface, {q(fixed.STRIP)}) as tok
        from tok0 where length(trim(surface, {q(fixed.STRIP)})) > 0)"""


def sql_islands(name: str, source: str, keys: str, order: str) -> str:
    return f"""{name}0 as (select *, max(end_pos) over (partition by {keys} order by start_pos, end_pos desc, {order} rows between unbounded preceding and 1 preceding) as before from {source}),
    {name}1 as (select *, sum(case when before is null or start_pos > before then 1 else 0 end) over (partition by {keys} order by start_pos, end_pos desc, {order} rows between unbounded preceding and current row) as island from {name}0),
    {name} as (select {keys}, min(start_pos) as start_pos, max(end_pos) as end_pos, arg_min(label, row(start_pos, -end_pos, {order})) as label, count(*) as n_spans from {name}1 group by {keys}, island)"""
