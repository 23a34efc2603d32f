"""Reading level of documents: boosted regression trees over features of their running prose.

Pass 1 reads each text once, keeps the sentences of its running prose and
writes, per document, one hash and a few counts for each sentence. Stock
clauses are then found over the whole corpus: a long sentence that stands word
for word in a hundredth of all different texts (and in at least
``STOCK_TEXTS``), amid otherwise different prose, is no document's own prose.
Near copies of one text count as one there. Pass 2 turns the remaining
sentences' counts into distributions (length, vocabulary, syntax, cohesion)
and grades them with trees fitted to the anchors.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cloakframe.llm import langid
from cloakframe.llm.boosting import BoostedTrees
from cloakframe.llm.prose import prose_sentences
from cloakframe.session import collect_bounded, cut

MAX_ANCHORS = 20_000
STOCK_RATE = 0.01
STOCK_TEXTS = 5
STOCK_WORDS = 12
FOLDS = 6
SURELY_ENGLISH, SURELY_NOT = 0.32, 0.13  # shares of function words between which the language profiles decide
BASIC_BELOW, ADVANCED_ABOVE = 1.5, 3.75
COUNTS = 9  # words, letters, words of 7+ letters, words of 10+ letters, rare words, commas, subordinators, function words, words shared with the sentence before

# Frequent English function words, and words that open a dependent clause or join sentences.
FUNCTION = frozenset(
    "a about above after all also an and any are as at be because been before both but by can could do does each even every "
    "for from had has have he her his how i if in into is it its just may me more most must my no not now of on once one "
    "only or other our out over she should since so some somebody than that the their them then there these they this those "
    "to too under until up us was we were what when where which while who whom whose will with without would you your".split()
)
SUBORDINATE = frozenset(
    "after although as because before considering given if insofar irrespective once since so than that though unless "
    "until when where whereas which while who whom whose notwithstanding".split()
)
_JOB = re.compile(r"^\W{0,3}(?:\d{2}/\d{4}\s|\d{4}\s*[-–]\s*(?:\d{4}|\w+)[, ])", re.M)


def sentence_counts(sentences: list[list[str]]) -> list[list[int]]:
    """The ``COUNTS`` counts of each sentence."""
    out = []
    before: set[str] = set()
    for words in sentences:
        low = [w.lower() for w in words]
        sizes = [*map(len, words)]
        content = {w for w in low if w not in FUNCTION}
        function = len([w for w in low if w in FUNCTION])
        out.append(
            [
                len(words),
                sum(sizes),
                len([n for n in sizes if n >= 7]),
                len([n for n in sizes if n >= 10]),
                len([n for n, w in zip(sizes, words) if n >= 8 and w.islower()]),
                0,
                len(SUBORDINATE.intersection(low)),
                function,
                len(content & before),
            ]
        )
        before = content
    return out


def features(counts: np.ndarray) -> np.ndarray:
    """Distributions over one document's sentences: counts has a row for each sentence."""
    c = counts.astype(float)
    n = c[:, 0]
    each = np.stack([n, c[:, 1] / n, c[:, 2] / n, c[:, 3] / n, c[:, 4] / n, c[:, 6]])
    each.sort(1)
    at = np.array((0.25, 0.5, 0.75)) * (len(c) - 1)
    low = at.astype(int)
    q = each[:, low] + (each[:, np.minimum(low + 1, len(c) - 1)] - each[:, low]) * (at - low)
    w = c.sum(0)
    rest = (w[0] / len(c), w[1] / w[0], w[2] / w[0], w[3] / w[0], w[6] / len(c), w[7] / w[0], w[8] / max(1.0, w[0] - w[7]))
    return np.concatenate([q.ravel(), rest])


@dataclass
class Grader:
    """Trees fitted to all anchors, one set for each fold, and the calibration of their raw predictions."""

    whole: BoostedTrees
    folds: list[BoostedTrees]
    raw: np.ndarray
    level: np.ndarray
    error: float

    def grade(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Calibrated grade, and the spread of the folds' grades."""
        of = np.stack([np.interp(m.predict(x), self.raw, self.level) for m in self.folds])
        return np.interp(self.whole.predict(x), self.raw, self.level), of.std(0)


def fit_grader(anchors: list[tuple[int, str]]) -> Grader:
    """Fits on each anchor and on its runs of four sentences; folds and calibration never split an anchor.

    The calibration maps the mean out-of-fold prediction of each level to that
    level, monotonically; ``error`` is the mean absolute out-of-fold error after it.
    """
    x, y, group, weight = [], [], [], []
    for g, (level, text) in enumerate(anchors):
        counts = np.array(sentence_counts([w for _, _, w in prose_sentences(text)]))
        if not len(counts):
            continue
        parts = [counts, *(counts[k : k + 4] for k in range(0, len(counts) - 3, 2))]
        for part in parts:
            x.append(features(part))
            y.append(float(level))
            group.append(g)
            weight.append(1.0 / len(parts) * 4)
    x, y, group, weight = np.array(x), np.array(y), np.array(group), np.array(weight)
    fold = group % FOLDS
    models, out = [], np.zeros(len(y))
    for k in range(FOLDS):
        at = fold == k
        if at.all() or not at.any():
            continue
        models.append(BoostedTrees().fit(x[~at], y[~at], weight[~at]))
        out[at] = models[-1].predict(x[at])
    levels = np.unique(y)
    raw = np.maximum.accumulate([np.average(out[y == v], weights=weight[y == v]) for v in levels])
    raw = raw + np.arange(len(raw)) * 1e-9
    error = float(np.average(np.abs(np.interp(out, raw, levels) - y), weights=weight))
    whole = BoostedTrees().fit(x, y, weight)
    return Grader(whole, models or [whole], raw, levels, error)


@lru_cache(2)
def _profiles(samples: tuple[str, ...]) -> langid.Profiles:
    return langid.fit_profiles([("en", t) for t in samples])


def is_english(sentences: list[list[str]], counts: list[list[int]], samples: tuple[str, ...] = ()) -> bool:
    """Whether most words of the running prose are English; ``samples`` are English texts of every level."""
    words = sum(c[0] for c in counts)
    share = sum(c[7] for c in counts) / max(1, words)
    if share >= SURELY_ENGLISH or share < SURELY_NOT:
        return words > 0 and share >= SURELY_ENGLISH
    dots, _ = _profiles(samples).dots(sentences)
    own = dots.argmax(1) == langid.LANGUAGES.index("en")
    return 2 * sum(c[0] for c, e in zip(counts, own) if e) > words


def sentence_table(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", samples: tuple[str, ...] = ()) -> DataFrame:
    """Pass 1: per document its text's hash, whether it is English and a CV, and hash and counts of each prose sentence."""
    schema = f"doc_id {documents.schema[doc_id].dataType.simpleString()}, source string, text_hash long, english boolean, cv boolean, hashes array<long>, counts array<int>"
    arrow = [("text_hash", pa.int64()), ("english", pa.bool_()), ("cv", pa.bool_()), ("hashes", pa.list_(pa.int64())), ("counts", pa.list_(pa.int32()))]
    docs = documents.select(F.col(doc_id).alias("d"), F.col(source).cast("string").alias("s"), F.col(text).alias("t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashed = xxhash.xxh3_64_intdigest
        top = 1 << 63
        for batch in batches:
            columns: list[list] = [[], [], [], [], []]
            for t in batch.column(2).to_pylist():
                sentences = [w for _, _, w in prose_sentences(t)] if t else []
                counts = sentence_counts(sentences)
                columns[0].append((hashed(t) if t else 0) - top)
                columns[1].append(is_english(sentences, counts, samples))
                columns[2].append(bool(t) and len(_JOB.findall(t)) >= 2)
                columns[3].append([hashed(" ".join(s).lower()) - top for s in sentences])
                columns[4].append([n for c in counts for n in c])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1).cast(pa.string()), *(pa.array(c, kind) for c, (_, kind) in zip(columns, arrow))], ["doc_id", "source", *(n for n, _ in arrow)])

    return docs.mapInArrow(run, schema)


def stock_hashes(sentences: DataFrame) -> list[int]:
    """Hashes of stock clauses: at most (sentences in a text) / STOCK_RATE of them, whatever the corpus.

    A text whose other prose is mostly of sentences that are frequent
    themselves may be one of many near copies. Such texts count once for each
    least of their frequent other sentences, which near copies have in common
    whatever sentences of their own they have; any other text counts by itself.
    """
    texts = sentences.where("size(hashes) > 0").select("text_hash", "hashes", F.transform(F.sequence(F.lit(0), F.size("hashes") - 1), lambda k: F.element_at("counts", k * COUNTS + 1)).alias("n"))
    texts = texts.dropDuplicates(["text_hash"])
    each = texts.select("text_hash", F.explode(F.arrays_zip("hashes", "n")).alias("x")).select("text_hash", F.col("x.hashes").alias("h"), F.col("x.n").alias("n")).distinct()
    least = max(STOCK_TEXTS, STOCK_RATE * texts.count())
    counted = each.groupBy("h").agg(F.count("*").alias("texts"), F.max("n").alias("n"))
    known = counted.where(f"texts >= {least / 2!r}").collect()
    frequent = np.array(sorted(r.h for r in known), np.int64)
    long = np.array(sorted(r.h for r in known if r.n >= STOCK_WORDS and r.texts >= least), np.int64)
    if not len(long):
        return []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            clauses, classes = [], []
            at = batch.column(1).offsets.to_numpy()
            at = at - at[0]
            every, words = batch.column(1).flatten().to_numpy(), batch.column(2).flatten().to_numpy()
            hit, often = np.isin(every, long), np.isin(every, frequent)
            for own, a, b in zip(batch.column(0).to_pylist(), at[:-1].tolist(), at[1:].tolist()):
                for h in np.unique(every[a:b][hit[a:b]]).tolist():
                    other = every[a:b] != h
                    shared = other & often[a:b]
                    copied = 2 * words[a:b][shared].sum() >= words[a:b][other].sum()
                    clauses.append(h)
                    classes.append(int(every[a:b][shared].min(initial=np.iinfo(np.int64).max)) if copied else own)
            yield pa.RecordBatch.from_arrays([pa.array(clauses, pa.int64()), pa.array(classes, pa.int64())], ["h", "class"])

    classes = texts.mapInArrow(run, "h long, class long").distinct().groupBy("h").agg(F.count("*").alias("n"))
    return [r.h for r in classes.where(f"n >= {least!r}").select("h").collect()]


def reading_levels(documents: DataFrame, anchors: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """One row for each document: ``doc_id, source, english, cv, n_words, grade, spread, band``.

    ``grade`` runs from the anchors' lowest to their highest level; ``spread``
    is the standard deviation over the cross-validation folds' trees. ``band``
    is ``basic`` below 1.5, ``advanced`` above 3.75, else ``between``. Null and
    empty texts and texts without running prose have a null grade and band.
    Texts in other languages are graded by the same features, flagged by
    ``english = false``. Repeated documents each get their row; extra columns
    are ignored. The anchors are a labelled table of bounded size
    (``MAX_ANCHORS``, more raises); without anchors every grade is null.
    """
    held = collect_bounded(anchors.select("level", "text", "anchor_id").dropna(subset=["level", "text"]), MAX_ANCHORS, "anchors")
    held.sort(key=lambda r: (r.level, r.anchor_id if r.anchor_id is not None else -1))
    grader = fit_grader([(r.level, r.text) for r in held]) if held else None
    sentences = cut(sentence_table(documents, doc_id, text, source, tuple(r.text for r in held)))
    stock = np.array(sorted(stock_hashes(sentences)), np.int64)
    schema = f"doc_id {sentences.schema['doc_id'].dataType.simpleString()}, source string, english boolean, cv boolean, n_words int, grade double, spread double, band string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, x, words = [], [], []
            at = batch.column(4).offsets.to_numpy()
            at = at - at[0]
            kept = ~np.isin(batch.column(4).flatten().to_numpy(), stock)
            every = batch.column(5).flatten().to_numpy().reshape(-1, COUNTS)
            for k, (a, b) in enumerate(zip(at[:-1].tolist(), at[1:].tolist())):
                own = every[a:b][kept[a:b]]
                words.append(int(own[:, 0].sum()))
                if len(own):
                    rows.append(k)
                    x.append(features(own))
            n = batch.num_rows
            grade, spread = np.full(n, np.nan), np.full(n, np.nan)
            if rows and grader:
                grade[rows], spread[rows] = grader.grade(np.array(x))
            none = np.isnan(grade)
            band = np.where(none, None, np.where(grade < BASIC_BELOW, "basic", np.where(grade > ADVANCED_ABOVE, "advanced", "between")))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), batch.column(2), batch.column(3), pa.array(words, pa.int32()), pa.array(grade, pa.float64(), mask=none), pa.array(spread, pa.float64(), mask=none), pa.array(band.tolist(), pa.string())],
                ["doc_id", "source", "english", "cv", "n_words", "grade", "spread", "band"],
            )

    return sentences.select("doc_id", "source", "english", "cv", "hashes", "counts").mapInArrow(run, schema)


def source_profile(levels: DataFrame) -> DataFrame:
    """By source (spelling of case, spaces and signs aside): documents, grades and the folds' mean spread."""
    named = levels.withColumn("source", F.lower(F.regexp_replace(F.trim("source"), "[-\\s]+", "_")))
    return named.groupBy("source").agg(
        F.count("*").alias("n_documents"),
        F.count("grade").alias("n_graded"),
        F.round(F.avg("grade"), 6).alias("mean_grade"),
        F.round(F.avg("spread"), 6).alias("mean_spread"),
        F.count_if(F.col("band") == "basic").alias("n_basic"),
        F.count_if(F.col("band") == "advanced").alias("n_advanced"),
    )
