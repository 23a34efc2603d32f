"""Span algebra. Spans are half-open code-point intervals ``start_pos, end_pos`` of one document."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cloakframe.functions import textops

BUCKET = 512  # code points; interval joins meet in buckets, so a hot document's spans never all meet

ISLANDS = "array<struct<start_pos:int,end_pos:int,label:string>>"


def overlap(a: Column, b: Column) -> Column:
    """Strict: touching is not overlap."""
    return (a["start_pos"] < b["end_pos"]) & (b["start_pos"] < a["end_pos"])


# ---- inside one row: arrays of spans


def covered_length(start: Column, end: Column, islands: Column) -> Column:
    """Characters of [start, end) under disjoint islands; 0 where there are none or the array is null."""
    inside = lambda i: F.greatest(F.lit(0), F.least(end, i["end_pos"]) - F.greatest(start, i["start_pos"]))
    return F.coalesce(F.aggregate(islands, F.lit(0), lambda acc, i: acc + inside(i)), F.lit(0))


def masked_text(text: Column, islands: Column, template: str = "[%s]") -> Column:
    """The text with each island replaced by its formatted label; disjoint sorted islands."""
    before = lambda k: F.coalesce(F.get(islands, k - 1)["end_pos"], F.lit(0))
    piece = lambda i, k: F.concat(F.substring(text, before(k) + 1, i["start_pos"] - before(k)), F.format_string(template, i["label"]))
    rest = F.substring(text, before(F.size(islands)) + 1, F.length(text))
    return F.when(F.size(islands) > 0, F.concat(F.array_join(F.transform(islands, piece), ""), rest)).otherwise(text)


# ---- between rows: tables of spans


def extract(docs: DataFrame, pattern: str, label: str, src: str, group: bool = False, keys: Sequence[str] = ("doc_id",)) -> DataFrame:
    """One row for each match of a pattern in ``text``: ``keys, start_pos, end_pos, label, src, surface``."""
    return docs.select(*keys, F.explode(textops.matches(F.col("text"), pattern, group)).alias("m")).select(
        *keys, F.col("m.start_pos").alias("start_pos"), F.col("m.end_pos").alias("end_pos"), F.lit(label).alias("label"), F.lit(src).alias("src"), F.col("m.text").alias("surface")
    )


def occurrences(text: str, surface: str) -> Iterator[int]:
    """Starts of every non-overlapping literal occurrence, from the left; none for an empty surface."""
    at = text.find(surface) if surface else -1
    while at >= 0:
        yield at
        at = text.find(surface, at + len(surface))


def locate_all(docs: DataFrame, surfaces: DataFrame, strict: bool = False) -> DataFrame:
    """Every occurrence of each ``doc_id, surface`` (other columns are kept) in the document's ``text``.

    A document's surfaces come as one array, so its text is shuffled once
    however many there are. With a column ``nth`` only that occurrence (from 0)
    is kept where it is set. ``strict`` raises for a surface that does not occur.
    """
    kept = [c for c in surfaces.columns if c != "doc_id"]
    packed = surfaces.where("surface is not null").groupBy("doc_id").agg(F.collect_list(F.struct("surface", *[c for c in kept if c != "surface"])).alias("_s"))
    rows = docs.select("doc_id", "text").join(packed, "doc_id")
    kind = rows.schema["_s"].dataType.elementType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            wanted = batch.column(2).flatten()
            owner = np.repeat(np.arange(batch.num_rows), pc.list_value_length(batch.column(2)).to_numpy(zero_copy_only=False))
            texts, words = batch.column(1).to_pylist(), wanted.field(0).to_pylist()
            of, nos, starts = [], [], []
            for k, (row, word) in enumerate(zip(owner.tolist(), words)):
                n = 0
                for n, at in enumerate(occurrences(texts[row] or "", word), 1):
                    of.append(k)
                    nos.append(n - 1)
                    starts.append(at)
                if strict and not n:
                    raise ValueError(f"surface not found: {word}")
            at = pa.array(of, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(owner).take(at)), wanted.take(at), pa.array(nos, pa.int32()), pa.array(starts, pa.int32())], ["doc_id", "_s", "_n", "start_pos"])

    found = rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, _s {kind}, _n int, start_pos int")
    if "nth" in kept:
        found = found.where("_s.nth is null or _s.nth = _n")
    out = [c for c in surfaces.columns if c not in ("nth", "doc_id")]
    return found.select("doc_id", *[F.col(f"_s.{c}").alias(c) for c in out], "start_pos", (F.col("start_pos") + F.length("_s.surface")).cast("int").alias("end_pos"))


def merge_spans(spans: DataFrame, keys: Sequence[str] = ("doc_id",), order: str = "span_id") -> DataFrame:
    """Islands of overlapping or touching spans: ``keys, start_pos, end_pos, label, n_spans``; two windows, one shuffle."""
    w = Window.partitionBy(*keys).orderBy("start_pos", F.desc("end_pos"), order)
    before = F.max("end_pos").over(w.rowsBetween(Window.unboundedPreceding, -1))
    marked = spans.withColumn("_new", (before.isNull() | (F.col("start_pos") > before)).cast("int"))
    numbered = marked.withColumn("_island", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    first = F.min_by("label", F.struct("start_pos", -F.col("end_pos"), order))
    return numbered.groupBy(*keys, "_island").agg(F.min("start_pos").alias("start_pos"), F.max("end_pos").alias("end_pos"), first.alias("label"), F.count("*").alias("n_spans")).drop("_island")


def _bucketed(spans: DataFrame) -> DataFrame:
    last = F.floor((F.greatest("end_pos", F.col("start_pos") + 1) - 1) / BUCKET)
    return spans.withColumn("_bucket", F.explode(F.sequence(F.floor(F.col("start_pos") / BUCKET), last)))


def _hits(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    other = _bucketed(right.select(*keys, "start_pos", "end_pos")).withColumnsRenamed({"start_pos": "_s", "end_pos": "_e"})
    pairs = _bucketed(left.select(*keys, "start_pos", "end_pos").distinct()).join(other, [*keys, "_bucket"])
    return pairs.where((F.col("start_pos") < F.col("_e")) & (F.col("_s") < F.col("end_pos"))).select(*keys, "start_pos", "end_pos").distinct()


def covered(left: DataFrame, right: DataFrame, keys: Sequence[str] = ("doc_id",)) -> DataFrame:
    """``left`` rows that overlap some ``right`` span of the same keys."""
    return left.join(_hits(left, right, keys), [*keys, "start_pos", "end_pos"], "left_semi")


def uncovered(left: DataFrame, right: DataFrame, keys: Sequence[str] = ("doc_id",)) -> DataFrame:
    """``left`` rows that overlap no ``right`` span of the same keys."""
    return left.join(_hits(left, right, keys), [*keys, "start_pos", "end_pos"], "left_anti")


def vote(spans: DataFrame, k: int, keys: Sequence[str] = ("doc_id",)) -> DataFrame:
    """Spans that at least ``k`` detectors support: their own and ``k - 1`` others with an overlapping span. Labels do not matter."""
    if k <= 1:
        return spans
    other = _bucketed(spans.select(*keys, "start_pos", "end_pos", "det")).withColumnsRenamed({"start_pos": "_s", "end_pos": "_e", "det": "_det"})
    own = _bucketed(spans.select(*keys, "span_id", "start_pos", "end_pos", "det"))
    pairs = own.join(other, [*keys, "_bucket"]).where((F.col("start_pos") < F.col("_e")) & (F.col("_s") < F.col("end_pos")) & (F.col("det") != F.col("_det")))
    kept = pairs.select(*keys, "span_id", "_det").distinct().groupBy(*keys, "span_id").agg(F.count("*").alias("_n")).where(F.col("_n") >= k - 1)
    return spans.join(kept.drop("_n"), [*keys, "span_id"], "left_semi")


def lines_of(docs: DataFrame) -> Column:
    """The documents' sectioned lines: ``_lines`` where they carry them, else computed from ``text``."""
    return F.col("_lines") if "_lines" in docs.columns else textops.sectioned_lines(F.col("text"))


def with_context(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """Spans with ``section, line, line_start, contact`` of the line that holds their start; other, '' and 0 outside."""
    lines = docs.select("doc_id", lines_of(docs).alias("_lines"))
    joined = spans.join(lines, "doc_id").withColumn("_at", textops.line_at(F.col("_lines"), F.col("start_pos"))).drop("_lines")
    return joined.select(
        *spans.columns,
        F.coalesce("_at.section", F.lit("other")).alias("section"),
        F.coalesce("_at.line", F.lit("")).alias("line"),
        F.coalesce("_at.start_pos", F.lit(0)).alias("line_start"),
        F.coalesce("_at.contact", F.lit(False)).alias("contact"),
    )


def review_candidates(spans: DataFrame, keys: Sequence[str] = ("doc_id",), order: str = "span_id") -> DataFrame:
    """One row for each stripped surface and label, numbered from 0 in first-seen order: ``keys, candidate, surface, label``."""
    first = spans.withColumn("surface", F.btrim("surface")).groupBy(*keys, "surface", "label").agg(F.min(order).alias("_first"))
    w = Window.partitionBy(*keys).orderBy("_first", "surface", "label")
    return first.select(*keys, (F.row_number().over(w) - 1).alias("candidate"), "surface", "label")


def adjacent_runs(spans: DataFrame, keys: Sequence[str] = ("doc_id", "det"), gap: int = 1) -> DataFrame:
    """Neighbouring spans of one label at most ``gap`` apart joined; the run's score is the least: token decoding."""
    w = Window.partitionBy(*keys).orderBy("start_pos", "end_pos", "span_id")
    new = F.lag("end_pos").over(w).isNull() | (F.col("start_pos") - F.lag("end_pos").over(w) > gap) | ~F.lag("label").over(w).eqNullSafe(F.col("label"))
    numbered = spans.withColumn("_run", F.sum(new.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(*keys, "_run", "label").agg(F.min("start_pos").alias("start_pos"), F.max("end_pos").alias("end_pos"), F.min("score").alias("score"), F.count("*").alias("n_spans")).drop("_run")
