"""Detectors as table functions: registry, plug-ins, score floors, votes, chunks and token decoding."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cloakframe.functions import fixed, textops
from cloakframe.operators import spans as sp

SPAN_SCHEMA = "doc_id string, start_pos int, end_pos int, label string, src string, score double"

Detector = Callable[[DataFrame], DataFrame]
FACTORIES: dict[str, Callable[[], Detector]] = {}
_MADE: dict[str, Detector] = {}


def register(name: str) -> Callable[[Callable[[], Detector]], Callable[[], Detector]]:
    """Registers a factory; the detector is made on first use and kept."""

    def put(factory: Callable[[], Detector]) -> Callable[[], Detector]:
        FACTORIES[name] = factory
        _MADE.pop(name, None)
        return factory

    return put


def detector(name: str) -> Detector:
    if name not in _MADE:
        _MADE[name] = FACTORIES[name]()
    return _MADE[name]


def plug_in(load: Callable[[], Callable[[str], list[tuple[int, int, str, float]]]], src: str) -> Detector:
    """A detector from a model: ``load`` runs once per worker and returns ``text -> [(start, end, label, score)]``."""

    def run(docs: DataFrame) -> DataFrame:
        def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            model = load()
            for batch in batches:
                rows = [(d, int(a), int(b), k, src, float(s)) for d, t in zip(batch["doc_id"], batch["text"]) if t for a, b, k, s in model(t)]
                yield pd.DataFrame(rows, columns=["doc_id", "start_pos", "end_pos", "label", "src", "score"])

        return docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text").mapInPandas(each, SPAN_SCHEMA)

    return run


#: Kind of detector -> its labels' map; labels of the kinds in ``DROPPING`` that the map lacks are dropped, others become OTHER.
LABEL_MAPS = {"tagger": fixed.TAGGER_LABELS, "engine": fixed.ENGINE_LABELS, "spanner": fixed.SPANNER_LABELS, "spanner2": fixed.SPANNER_2_LABELS, "filter": fixed.FILTER_LABELS}
DROPPING = ("tagger",)


def free_label(label: Column) -> Column:
    """A label in free wording: exact, else by the first part it contains, else OTHER."""
    low = F.lower(label)
    by_part = F.lit("OTHER")
    for part, known in reversed(fixed.FREE_LABEL_PARTS):
        by_part = F.when(low.contains(part), F.lit(known)).otherwise(by_part)
    exact = F.create_map(*[F.lit(x) for p in fixed.FREE_LABELS.items() for x in p])
    return F.coalesce(F.element_at(exact, low), by_part)


def detector_label(kind: str, label: Column) -> Column:
    """What a detector's label means: by its kind's map; the filter's other labels by their wording; null for what is dropped."""
    known = F.element_at(F.create_map(*[F.lit(x) for p in LABEL_MAPS[kind].items() for x in p]), label)
    if kind == "filter":
        return F.coalesce(known, free_label(label))
    return known if kind in DROPPING else F.coalesce(known, F.lit("OTHER"))


def adapted(entities: DataFrame, kind: str, src: str, least: float = 0.0, score: float | None = None) -> DataFrame:
    """A model's recorded entities ``doc_id, start_pos, end_pos, label, score`` as spans: floor, label map, source; ``score`` for models that give none."""
    scored = entities.withColumn("score", F.lit(score) if score is not None else F.coalesce("score", F.lit(1.0))).where(F.col("score") >= least)
    named = scored.withColumns({"label": detector_label(kind, F.col("label")), "src": F.lit(src)}).where("label is not null")
    return named.select("doc_id", "start_pos", "end_pos", "label", "src", "score")


def detect_lang(text: Column) -> Column:
    """The language, of those with a tagger, of which a text has most frequent short words; English where none leads."""
    words = F.split(F.lower(text), r"[^\p{L}]+")

    def among(known: Sequence[str]) -> Callable[[Column], Column]:
        return lambda x: x.isin(*known)

    def best(w: Column) -> Column:
        counts = F.array(*[F.struct(F.size(F.filter(w, among(known))).alias("n"), F.lit(-i).alias("rank"), F.lit(k).alias("lang")) for i, (k, known) in enumerate(fixed.LANGUAGE_WORDS.items())])
        return textops.let(F.array_max(counts), lambda x: F.when(x["n"] > 0, x["lang"]).otherwise("ENGLISH"))

    return F.when(text.isNull(), "ENGLISH").otherwise(textops.let(words, best))


@dataclass(frozen=True)
class Stack:
    """A named combination: score floor by detector, and pipeline switches."""

    name: str
    detectors: dict[str, float]
    cfg: dict[str, object] = field(default_factory=dict)
    adjudicator: dict[str, object] | None = None


def floor(spans: DataFrame, floors: dict[str, float]) -> DataFrame:
    """Spans of the listed detectors whose score reaches the detector's floor; a null score counts as 0."""
    known = F.create_map(*[F.lit(x) for p in floors.items() for x in p])
    return spans.where(F.coalesce("score", F.lit(0.0)) >= F.element_at(known, F.col("det")))


def stack_spans(spans: DataFrame, parameters: DataFrame) -> DataFrame:
    """Each run's spans by its own parameter rows ``run_id, det, min_score, vote_k``: floors first, then the vote."""
    kept = spans.join(parameters, ["run_id", "det"]).where(F.coalesce("score", F.lit(0.0)) >= F.col("min_score")).drop("min_score")
    keys = ["run_id", "doc_id"]
    single = kept.where("vote_k <= 1").drop("vote_k")
    voting = kept.where("vote_k > 1")
    other = sp._bucketed(voting.select(*keys, "start_pos", "end_pos", "det")).withColumnsRenamed({"start_pos": "_s", "end_pos": "_e", "det": "_det"})
    pairs = sp._bucketed(voting).join(other, [*keys, "_bucket"]).where((F.col("start_pos") < F.col("_e")) & (F.col("_s") < F.col("end_pos")) & (F.col("det") != F.col("_det")))
    counted = pairs.select(*keys, "span_id", "vote_k", "_det").distinct().groupBy(*keys, "span_id", "vote_k").agg(F.count("*").alias("n")).where("n >= vote_k - 1")
    voted = voting.join(counted.select(*keys, "span_id"), [*keys, "span_id"], "left_semi").drop("vote_k")
    return single.unionByName(voted)


def chunk_array(text: Column, limit: int) -> Column:
    """Whole lines packed greedily up to ``limit`` characters: ``array<struct<start_pos, chunk>>``; a longer line stays whole."""
    empty = F.struct(F.expr("cast(array() as array<struct<start_pos:int,chunk:string>>)").alias("done"), F.lit("").alias("open"), F.lit(0).alias("at"))
    lines = F.regexp_extract_all(text, F.lit(r"(?s)[^\n]*\n|[^\n]+\z"), F.lit(0))

    def step(acc: Column, line: Column) -> Column:
        full = (F.length(acc["open"]) > 0) & (F.length(acc["open"]) + F.length(line) > limit)
        closed = F.concat(acc["done"], F.array(F.struct(acc["at"].alias("start_pos"), acc["open"].alias("chunk"))))
        return F.struct(
            F.when(full, closed).otherwise(acc["done"]).alias("done"),
            F.when(full, line).otherwise(F.concat(acc["open"], line)).alias("open"),
            F.when(full, acc["at"] + F.length(acc["open"])).otherwise(acc["at"]).alias("at"),
        )

    last = lambda acc: F.when(F.length(acc["open"]) > 0, F.concat(acc["done"], F.array(F.struct(acc["at"].alias("start_pos"), acc["open"].alias("chunk"))))).otherwise(acc["done"])
    return F.aggregate(lines, empty, step, last)


def chunks(docs: DataFrame, limit: int) -> DataFrame:
    rows = docs.select("doc_id", F.posexplode(chunk_array(F.col("text"), limit)).alias("chunk_no", "c"))
    return rows.select("doc_id", "chunk_no", F.col("c.start_pos").alias("start_pos"), (F.col("c.start_pos") + F.length("c.chunk")).alias("end_pos"), F.col("c.chunk").alias("chunk"))


def line_windows(docs: DataFrame, limit: int, overlap_lines: int) -> DataFrame:
    """As ``chunks``, consecutive ones sharing up to ``overlap_lines`` lines; each advances by a line at least.

    A window's last line follows from the lines' running lengths by binary search.
    """
    schema = "doc_id string, chunk_no int, start_pos int, end_pos int, chunk string"
    kinds = [pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.string()]

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for d, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                breaks = [m.end() for m in re.finditer("\n", t or "")]
                at = np.unique([0, *breaks, len(t or "")])
                first = no = 0
                while first < len(at) - 1:
                    last = max(first + 1, int(np.searchsorted(at, at[first] + limit, "right")) - 1)
                    out.append((d, no, int(at[first]), int(at[last]), t[at[first] : at[last]]))
                    if last == len(at) - 1:
                        break
                    first, no = max(first + 1, last - overlap_lines), no + 1
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], [x.split()[0] for x in schema.split(", ")])

    return docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text").mapInArrow(each, schema)


def char_windows(docs: DataFrame, size: int, overlap: int) -> DataFrame:
    """Windows of ``size`` characters that share ``overlap``, each drawn out to the end of its last word: ``doc_id, chunk_no, start_pos, end_pos, chunk``."""
    step = max(1, size - overlap)
    text = F.col("text")
    starts = F.sequence(F.lit(0), F.greatest(F.lit(0), F.length(text) - 1 - min(overlap, size - 1)), F.lit(step))
    rows = docs.where("length(text) > 0").select("doc_id", "text", F.posexplode(starts).alias("chunk_no", "start_pos"))
    tail = F.regexp_extract(F.substring(text, F.col("start_pos") + size + 1, F.lit(100)), r"^[\p{L}\p{N}_]*", 0)
    inside = F.substring(text, F.col("start_pos") + size, F.lit(1)).rlike(r"[\p{L}\p{N}_]")
    end = F.least(F.length(text), F.col("start_pos") + size + F.when(inside, F.length(tail)).otherwise(0))
    return rows.select("doc_id", "chunk_no", "start_pos", end.alias("end_pos"), F.substring(text, F.col("start_pos") + 1, end - F.col("start_pos")).alias("chunk"))


def merged_windows(found: DataFrame) -> DataFrame:
    """Spans of overlapping windows: equal places and labels once with the best score; of spans that overlap with one label the better, then the longer, stays."""
    once = found.groupBy("doc_id", "start_pos", "end_pos", "label", "src").agg(F.max("score").alias("score"))
    other = sp._bucketed(once).withColumnsRenamed({"start_pos": "_s", "end_pos": "_e", "score": "_p"}).select("doc_id", "label", "src", "_bucket", "_s", "_e", "_p")
    pairs = sp._bucketed(once).join(other, ["doc_id", "label", "src", "_bucket"]).where("start_pos < _e and _s < end_pos and (start_pos <> _s or end_pos <> _e)")
    better = F.struct("_p", F.col("_e") - F.col("_s"), -F.col("_s")) > F.struct("score", F.col("end_pos") - F.col("start_pos"), -F.col("start_pos"))
    beaten = pairs.where(better).select("doc_id", "start_pos", "end_pos", "label", "src").distinct()
    return once.join(beaten, ["doc_id", "start_pos", "end_pos", "label", "src"], "left_anti")


def by_chunks(run: Detector, limit: int) -> Detector:
    """A detector run on chunks, its offsets shifted back into the document."""

    def whole(docs: DataFrame) -> DataFrame:
        parts = chunks(docs, limit)
        keyed = parts.select(F.concat_ws("\x1f", F.col("doc_id").cast("string"), "chunk_no", "start_pos").alias("doc_id"), F.col("chunk").alias("text"))
        found = run(keyed)
        key = F.split("doc_id", "\x1f")
        shift = F.element_at(key, 3).cast("int")
        return found.withColumns({"start_pos": (F.col("start_pos") + shift).cast("int"), "end_pos": (F.col("end_pos") + shift).cast("int"), "doc_id": F.element_at(key, 1)})

    return whole


def decode_tokens(tokens: DataFrame, least: float) -> DataFrame:
    """Token probabilities to spans: ``doc_id, start_pos, end_pos, probs map<label, p>``, of which ``O`` is none.

    A token counts if 1 - p(O) reaches ``least``; its label is the likeliest other one; neighbours join.
    """
    other = F.map_filter("probs", lambda k, _: k != "O")
    best = F.array_max(F.transform(F.map_entries(other), lambda e: F.struct(e["value"].alias("p"), e["key"].alias("k"))))
    score = 1 - F.coalesce(F.element_at("probs", F.lit("O")), F.lit(0.0))
    hot = tokens.select("doc_id", "start_pos", "end_pos", best["k"].alias("label"), score.alias("score"), F.lit("tokens").alias("det"), F.col("start_pos").cast("long").alias("span_id")).where(F.col("score") >= least)
    return sp.adjacent_runs(hot)


def training_examples(docs: DataFrame, gold: DataFrame, limit: int) -> DataFrame:
    """For each chunk the distinct required surfaces that lie wholly inside it, by label: fine-tuning data."""
    parts = chunks(docs, limit).withColumnsRenamed({"start_pos": "_a", "end_pos": "_b"})
    inside = parts.join(gold.where("required"), "doc_id").where("start_pos >= _a and end_pos <= _b")
    return inside.groupBy("doc_id", "chunk_no", "label").agg(F.array_sort(F.collect_set("surface")).alias("surfaces"))


def allow_list(terms: Sequence[str], more: Sequence[str] = ()) -> list[str]:
    """Terms of two and more characters, as given and capitalised."""
    words = {w for w in (*terms, *more) if len(w) > 1}
    return sorted(words | {w.capitalize() for w in words})


def allowed_out(found: DataFrame, terms: Sequence[str]) -> DataFrame:
    """Spans whose surface is no allowed term."""
    return found.where(~F.btrim("surface").isin(*terms))


def context_words() -> list[str]:
    """Words beside which a weak match is surer: all field labels and one-word keys."""
    return sorted({*fixed.FIELD_LABELS, *(k for keys in fixed.KV_KEYS.values() for k in keys if k.isalpha())})


def in_context(found: DataFrame, words: Sequence[str], boost: float = 0.35, least: float = 0.4) -> DataFrame:
    """Scores raised by ``boost``, to ``least`` at least and 1 at most, where one of the words stands in ``before``."""
    near = F.lower("before").rlike(textops.words_any(words))
    return found.withColumn("score", F.when(near, F.least(F.lit(1.0), F.greatest(F.col("score") + boost, F.lit(least)))).otherwise(F.col("score")))


def by_language(runs: dict[str, Detector], default: str = "en") -> Detector:
    """Routes documents of ``doc_id, text, lang`` to the detector of their language; others go to the default's."""

    def run(docs: DataFrame) -> DataFrame:
        known = F.when(F.col("lang").isin(*runs), F.col("lang")).otherwise(F.lit(default))
        routed = docs.withColumn("_route", known)
        out = None
        for name, one in runs.items():
            part = one(routed.where(F.col("_route") == name).drop("_route"))
            out = part if out is None else out.unionByName(part)
        return out

    return run
