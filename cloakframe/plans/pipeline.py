"""From documents and detector spans to masked text and scores.

A document is one row throughout: its text, its lines and an array of its
spans. Rules, segments and occurrences are found in two Arrow passes, all
decisions between them are column expressions over the arrays. With rules only
nothing is shuffled; detector spans are voted on where they lie, thinned to one
of each kind and place, and joined to their document once. Only a
judge's candidates, which are read several times, are cut by a checkpoint.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import replace

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cloakframe.functions import textops
from cloakframe.operators import identity, judge, policy, rules, scoring
from cloakframe.operators import spans as sp
from cloakframe.operators.policy import Config
from cloakframe.session import cut

CONTEXT = ("ord", "start_pos", "end_pos", "label", "src", "score", "surface", "section", "line", "line_start", "contact", "before", "after")
COLUMNS = ["doc_id", *CONTEXT]
FINAL = ["doc_id", "span_id", "start_pos", "end_pos", "label", "src", "surface"]
STEP = 1 << 40
_KINDS = {"ord": pa.int64(), "start_pos": pa.int32(), "end_pos": pa.int32(), "score": pa.float64(), "line_start": pa.int32(), "contact": pa.bool_()}
_SPAN = pa.struct([(c, _KINDS.get(c, pa.string())) for c in CONTEXT])
_SPAN_SQL = "ord:bigint,start_pos:int,end_pos:int,label:string,src:string,score:double,surface:string,section:string,line:string,line_start:int,contact:boolean,before:string,after:string"
_SEGMENT = pa.struct([("start_pos", pa.int32()), ("end_pos", pa.int32()), ("surface", pa.string()), ("line", pa.string()), ("contact", pa.bool_())])
_SEGMENT_SQL = "array<struct<start_pos:int,end_pos:int,surface:string,line:string,contact:boolean>>"
_GIVEN = "array<struct<ord:bigint,start_pos:int,end_pos:int,label:string,src:string,score:double>>"
_ISLAND = pa.list_(pa.struct([("start_pos", pa.int32()), ("end_pos", pa.int32()), ("label", pa.string())]))


def voted(detected: DataFrame, cfg: Config = Config()) -> DataFrame:  # noqa: B008
    """Detector spans after the vote as ``doc_id, given``: an array in their order, equal ones once."""
    kept = sp.vote(detected, cfg.vote_k)
    once = kept.groupBy("doc_id", "start_pos", "end_pos", "label", F.coalesce("src", F.lit("")).alias("src")).agg(F.min(F.col("span_id").cast("long")).alias("ord"), F.max("score").alias("score"))
    return once.groupBy(F.col("doc_id").cast("string").alias("doc_id")).agg(F.array_sort(F.collect_list(F.struct("ord", "start_pos", "end_pos", "label", "src", F.col("score").cast("double").alias("score")))).alias("given"))


def segments(p: rules.Page, lines: Sequence[rules.Line], outer: str, inner: str) -> Iterator[dict]:
    """Parts of lines between the outer signs and then the inner pattern, without spaces and commas at their ends."""
    cut = re.compile(rf"[{outer}]+|{inner}")
    for x in lines:
        at = 0
        for a, b in [*(m.span() for m in cut.finditer(x.line)), (len(x.line), 0)]:
            part = x.line[at:a]
            body = part.strip(" ,;")
            if body:
                start = x.start + at + part.index(body)
                yield {"start_pos": start, "end_pos": start + len(body), "surface": body, "line": x.line, "contact": x.contact}
            at = b


def prepared(docs: DataFrame, given: DataFrame | None, cfg: Config) -> DataFrame:
    """``doc_id, text, spans, places, parts``: all candidates in context, in order (detectors, rules, header name), and the segments of contact zones and lines."""
    rows = docs if "_lines" in docs.columns else rules.with_lines(docs)
    rows = rows.join(given, "doc_id", "left") if given is not None else rows.withColumn("given", F.expr(f"cast(null as {_GIVEN})"))
    header = policy.header_name(F.col("_lines")) if cfg.regex and cfg.header_name_rule else F.expr("cast(null as struct<start_pos:int,end_pos:int,surface:string>)")
    switches = {"kv_address": cfg.kv_address, "edu_acronyms": cfg.edu_acronyms}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans, places, parts = [], [], []
            givens, heads = batch.column(3).to_pylist(), batch.column(4).to_pylist()
            for row, p in rules.pages(batch):
                found = [(x["ord"], x["start_pos"], x["end_pos"], x["label"], x["src"], x["score"], p.line(x["start_pos"])) for x in givens[row] or ()]
                if cfg.regex:
                    found += [(STEP + n, a, b, label, src, 1.0, x) for n, (a, b, label, src, _, x) in enumerate(rules.scan_page(p, **switches))]
                if h := heads[row]:
                    found.append((2 * STEP, h["start_pos"], h["end_pos"], "NAME", "re-headername", 1.0, p.line(h["start_pos"])))
                spans.append([dict(zip(CONTEXT, (*s[:6], *rules.in_context(p.text, s[1], s[2], s[6])))) for s in found])
                places.append([*segments(p, [x for x in p.lines if x.zone], "|\n\t•·", r"\s+[-–—]\s+|\s+/\s+|\s{3,}")])
                parts.append([*segments(p, [x for x in p.lines if x.contact], "|\n\t", r"\s+[-–—/•·]\s+|\s{3,}")])
            arrays = [pa.array(spans, pa.list_(_SPAN)), pa.array(places, pa.list_(_SEGMENT)), pa.array(parts, pa.list_(_SEGMENT))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *arrays], ["doc_id", "text", "spans", "places", "parts"])

    schema = f"doc_id string, text string, spans array<struct<{_SPAN_SQL}>>, places {_SEGMENT_SQL}, parts {_SEGMENT_SQL}"
    return rows.select("doc_id", "text", "_lines", "given", header.alias("head")).mapInArrow(run, schema)


def candidates(docs: DataFrame, detected: DataFrame | None, cfg: Config = Config()) -> DataFrame:  # noqa: B008
    """Rows of ``prepared``'s spans."""
    rows = prepared(docs, voted(detected, cfg) if detected is not None else None, cfg)
    return rows.select("doc_id", F.explode("spans").alias("s")).select("doc_id", *[F.col(f"s.{c}").alias(c) for c in CONTEXT])


def judged(docs: DataFrame, detected: DataFrame | None, cfg: Config, replies: DataFrame, mode: str, drop_labels: Sequence[str] | None) -> DataFrame:
    """Candidates after a judge's recorded replies, as ``doc_id, given``."""
    rows = cut(candidates(docs, detected, cfg).withColumnRenamed("ord", "span_id"))  # read three times below
    texts = docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text")
    after = judge.adjudicated(texts, rows, replies, mode, drop_labels).withColumn("ord", F.coalesce("span_id", F.lit(3 * STEP) + F.col("start_pos")))
    scored = after.join(rows.select("doc_id", F.col("span_id").alias("ord"), "score"), ["doc_id", "ord"], "left")
    return scored.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("ord", "start_pos", "end_pos", "label", "src", F.coalesce("score", F.lit(1.0)).alias("score")))).alias("given"))


def found(docs: DataFrame, detected: DataFrame | None = None, cfg: Config = Config(), replies: DataFrame | None = None, mode: str = "full", drop_labels: Sequence[str] | None = None) -> DataFrame:  # noqa: B008
    """``doc_id, text, spans``: each document's final spans, in order, as ``array<struct<start_pos,end_pos,label,src,surface>>``.

    Order: detectors and vote, rules, header name, judge, policy, places,
    contact segments, propagation, safety net; each stage reads all before it.
    """
    if replies is not None and not cfg.raw:
        rows = prepared(docs, judged(docs, detected, cfg, replies, mode, drop_labels), replace(cfg, regex=False, vote_k=1))
    else:
        rows = prepared(docs, voted(detected, cfg) if detected is not None else None, cfg)
    short = lambda s, section: F.struct(*[s[c].alias(c) for c in ("start_pos", "end_pos", "label", "src", "surface")], section.alias("section"))
    if cfg.raw:
        return rows.select("doc_id", "text", F.transform("spans", lambda s: _plain(s)).alias("spans"))
    own = policy.kept(F.col("spans"), CONTEXT, cfg) if cfg.policy else F.col("spans")
    rows = rows.withColumn("spans", F.transform(own, lambda s: short(s, s["section"])))
    added = lambda spans: F.transform(spans, lambda s: short(s, F.lit("")))
    if cfg.policy and cfg.location_lines:
        rows = rows.withColumn("spans", textops.let(F.col("spans"), lambda k: F.concat(k, added(policy.places(F.col("places"), k)))))
    if cfg.policy and cfg.contact_line_rule:
        rows = rows.withColumn("spans", textops.let(F.col("spans"), lambda k: F.concat(k, added(policy.contact_segments(F.col("parts"), k)))))
    rows = rows.withColumn("names", identity.known_names(F.col("spans"), cfg.propagate))
    done = identity.spread(rows, cfg.propagate != "none", cfg.safety_net)
    return done.select("doc_id", "text", F.concat(F.transform("spans", lambda s: _plain(s)), "found").alias("spans"))


def _plain(s: Column) -> Column:
    return F.struct(*[s[c].alias(c) for c in ("start_pos", "end_pos", "label", "src", "surface")])


def as_rows(documents: DataFrame) -> DataFrame:
    """Final spans as rows; ``span_id`` is their order in the document."""
    rows = documents.select("doc_id", F.posexplode("spans").alias("n", "s"))
    return rows.select("doc_id", F.col("n").cast("long").alias("span_id"), "s.start_pos", "s.end_pos", "s.label", "s.src", "s.surface")


def run(docs: DataFrame, detected: DataFrame | None = None, cfg: Config = Config()) -> DataFrame:  # noqa: B008
    """Final spans of each document as rows: ``doc_id, span_id, start_pos, end_pos, label, src, surface``."""
    return as_rows(found(docs, detected, cfg))


def islands(documents: DataFrame) -> DataFrame:
    """``doc_id, text, islands``: a document's spans merged where they overlap or touch, by one walk in order."""

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for spans in batch.column(2).to_pylist():
                merged: list[dict] = []
                for s in sorted(spans, key=lambda s: (s["start_pos"], -s["end_pos"])):
                    if merged and s["start_pos"] <= merged[-1]["end_pos"]:
                        merged[-1]["end_pos"] = max(merged[-1]["end_pos"], s["end_pos"])
                    else:
                        merged.append(s)
                out.append(merged)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, _ISLAND)], ["doc_id", "text", "islands"])

    rows = documents.select("doc_id", "text", F.transform("spans", lambda s: F.struct(s["start_pos"].alias("start_pos"), s["end_pos"].alias("end_pos"), s["label"].alias("label"))).alias("s"))
    return rows.mapInArrow(walk, f"doc_id string, text string, islands {sp.ISLANDS}")


def masked(documents: DataFrame, template: str = "[%s]") -> DataFrame:
    """``doc_id, masked, n_masked`` of ``found`` documents, masked or not; nothing is shuffled."""
    return islands(documents).select("doc_id", sp.masked_text(F.col("text"), F.col("islands"), template).alias("masked"), F.size("islands").alias("n_masked"))


def mask(docs: DataFrame, spans: DataFrame, template: str = "[%s]") -> DataFrame:
    """``doc_id, masked, n_masked`` for rows of spans: every document, masked or not."""
    merged = scoring.islands_by(spans, ["doc_id"], "islands")
    none = F.expr(f"cast(array() as {sp.ISLANDS})")
    rows = docs.join(merged, "doc_id", "left").withColumn("islands", F.coalesce("islands", none))
    return rows.select("doc_id", sp.masked_text(F.col("text"), F.col("islands"), template).alias("masked"), F.size("islands").alias("n_masked"))


def evaluate(docs: DataFrame, gold: DataFrame, spans: DataFrame, name: str) -> DataFrame:
    """Corpus scores of one stack on every split."""
    scores = scoring.doc_scores(docs, gold, spans.withColumn("stack", F.lit(name)), [(name,)], ["stack"])
    return scoring.corpus_scores(scores, ["split", "stack"])
