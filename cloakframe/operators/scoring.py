"""Token scores, leaked entities and corpus aggregates.

Predictions are merged into islands by a window, then each document meets its
gold and its islands once, in one Arrow pass: how much of a token is covered
follows from the islands' running length by binary search, for all tokens at a
time. There is no character array and no row for each token. A document without
predictions or gold counts as uncovered.
"""

from __future__ import annotations

import re
import sys
from collections.abc import Iterator, Sequence
from functools import cache
from itertools import groupby

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cloakframe.functions import fixed
from cloakframe.operators import spans as sp

FP_EXAMPLES = 40
_TOKEN = re.compile(r"\S+")
_CONNECTORS = frozenset(fixed.CONNECTORS)
_LONGEST = max(map(len, fixed.CONNECTORS))  # no word is longer than its lower case


def islands_by(spans: DataFrame, keys: Sequence[str], name: str) -> DataFrame:
    """One row for each key with its merged islands, labels kept, as an array."""
    merged = sp.merge_spans(spans, keys)
    packed = F.array_sort(F.collect_list(F.struct("start_pos", "end_pos", "label")))
    return merged.groupBy(*keys).agg(packed.alias(name))


def tokens(text: str) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """Starts, ends and words of the tokens, edges trimmed of ``STRIP``."""
    starts, ends, words = [], [], []
    for m in _TOKEN.finditer(text):
        word = m[0].rstrip(fixed.STRIP)
        core = word.lstrip(fixed.STRIP)
        if core:
            start = m.start() + len(word) - len(core)
            starts.append(start)
            ends.append(start + len(core))
            words.append(core)
    return np.array(starts, np.int64), np.array(ends, np.int64), words


def merged(pairs: Sequence[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray]:
    out: list[list[int]] = []
    for a, b in sorted(pairs):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    x = np.array(out, np.int64).reshape(-1, 2)
    return x[:, 0], x[:, 1]


def half_covered(starts: np.ndarray, ends: np.ndarray, islands: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Whether at least half of each [start, end) lies under the disjoint sorted islands."""
    a, b = islands
    if not len(a):
        return np.zeros(len(starts), bool)
    total = np.concatenate([[0], np.cumsum(b - a)])

    def before(x: np.ndarray) -> np.ndarray:
        k = np.searchsorted(a, x, "right")
        last = np.maximum(k - 1, 0)
        return total[last] + np.where(k > 0, np.clip(x - a[last], 0, b[last] - a[last]), 0)

    return (before(ends) - before(starts)) * 2 >= ends - starts


_LEAK = pa.struct([("label", pa.string()), ("text", pa.string()), ("visible", pa.list_(pa.string()))])
_FLAG = pa.struct([("label", pa.string()), ("span_no", pa.int32()), ("leaked", pa.bool_())])


def doc_scores(docs: DataFrame, gold: DataFrame, predicted: DataFrame, grid: Sequence[tuple], keys: Sequence[str] = ("det",), types: Sequence[str] = ("string",)) -> DataFrame:
    """One row for each document and grid point: ``doc_id, split, keys, req, req_hit, pred, pred_ok, ents, ents_leaked, fp_tokens, leaks, ent_flags``.

    ``grid`` lists the values of the keys (detectors, thresholds); every document
    is scored at every point. ``predicted`` holds ``doc_id, keys, start_pos,
    end_pos, label, span_id``; ``gold`` holds ``doc_id, span_no, start_pos,
    end_pos, label, required, surface``.
    """
    islands = sp.merge_spans(predicted.select("doc_id", *keys, "start_pos", "end_pos", "label", "span_id"), ["doc_id", *keys])
    by_doc = islands.groupBy("doc_id").agg(F.collect_list(F.struct(*[F.col(k).cast("string").alias(f"k{i}") for i, k in enumerate(keys)], "start_pos", "end_pos")).alias("p"))
    annotated = gold.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("span_no", "start_pos", "end_pos", "label", "required", "surface"))).alias("g"))
    rows = docs.select("doc_id", "split", "text").join(annotated, "doc_id", "left").join(by_doc, "doc_id", "left")
    points = [tuple(x) for x in grid]
    names = [tuple(_text(v) for v in x) for x in points]
    schema = "doc_id string, split string, " + "".join(f"{k} {t}, " for k, t in zip(keys, types)) + (
        "req int, req_hit int, pred int, pred_ok int, ents int, ents_leaked int, fp_tokens array<string>, "
        "leaks array<struct<label:string,text:string,visible:array<string>>>, ent_flags array<struct<label:string,span_no:int,leaked:boolean>>"
    )
    arrow_keys = [{"string": pa.string(), "double": pa.float64(), "int": pa.int32()}[t] for t in types]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fields = [("doc_id", pa.string()), ("split", pa.string()), *zip(keys, arrow_keys), *((c, pa.int32()) for c in ("req", "req_hit", "pred", "pred_ok", "ents", "ents_leaked"))]
        fields += [("fp_tokens", pa.list_(pa.string())), ("leaks", pa.list_(_LEAK)), ("ent_flags", pa.list_(_FLAG))]
        for batch in batches:
            out = []
            for doc, split, text, g, p in zip(*(batch.column(k).to_pylist() for k in range(5))):
                starts, ends, words = tokens(text)
                g = g or []
                entities = [x for x in g if x["required"]]
                req = half_covered(starts, ends, merged([(x["start_pos"], x["end_pos"]) for x in entities]))
                some = half_covered(starts, ends, merged([(x["start_pos"], x["end_pos"]) for x in g]))
                owner, es, ee, ew = [], [], [], []
                for n, x in enumerate(entities):
                    a, b, w = tokens(text[x["start_pos"] : x["end_pos"]])
                    for i, word in enumerate(w):
                        if word.lower() not in _CONNECTORS:
                            owner.append(n)
                            es.append(int(a[i]) + x["start_pos"])
                            ee.append(int(b[i]) + x["start_pos"])
                            ew.append(word)
                es_, ee_ = np.array(es, np.int64), np.array(ee, np.int64)
                of = lambda x: tuple(x[f"k{i}"] for i in range(len(keys)))
                found = {k: merged([(x["start_pos"], x["end_pos"]) for x in v]) for k, v in groupby(sorted(p or [], key=of), key=of)}
                none = merged([])
                for point, name in zip(points, names):
                    here = found.get(name, none)
                    hit = half_covered(starts, ends, here)
                    seen = ~half_covered(es_, ee_, here)
                    visible: dict[int, list[str]] = {}
                    for i in np.flatnonzero(seen).tolist():
                        visible.setdefault(owner[i], []).append(ew[i])
                    leaks = [{"label": entities[n]["label"], "text": entities[n]["surface"], "visible": v} for n, v in sorted(visible.items())]
                    flags = [{"label": x["label"], "span_no": x["span_no"], "leaked": n in visible} for n, x in enumerate(entities)]
                    wrong = [words[i] for i in np.flatnonzero(hit & ~some).tolist()]
                    counts = (int(req.sum()), int((req & hit).sum()), int(hit.sum()), int((hit & some).sum()), len(entities), len(visible))
                    out.append((doc, split, *point, *counts, wrong, leaks, flags))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*out), fields)], [n for n, _ in fields])

    return rows.select(F.col("doc_id").cast("string").alias("doc_id"), "split", "text", "g", "p").mapInArrow(run, schema)


SLICE = 1 << 19  # characters that are counted at a time
PAIRS = 1 << 21  # pairs of island and token that are held at a time; one point's are never parted
_COUNTS = ("docs", "req", "req_hit", "pred", "pred_ok", "ents", "ents_leaked", "leak_docs", "fp")


@cache
def _kinds() -> np.ndarray:
    """For each code point 2 if it is white space, 1 if it is trimmed from a token's edges, else 0."""
    out = np.zeros(sys.maxunicode + 1, np.uint8)
    out[[ord(c) for c in fixed.STRIP]] = 1
    out[[c for c in range(sys.maxunicode + 1) if chr(c).isspace()]] = 2
    return out


def token_bounds(codes: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends as ``tokens`` finds them, of many texts that lie one behind the other and start at ``cuts``."""
    n = len(codes)
    kind = _kinds()[codes]
    word = kind < 2
    cut = np.zeros(n + 1, bool)
    cut[cuts] = cut[n] = True
    first, last = word & cut[:n], word & cut[1:]
    first[1:] |= word[1:] & ~word[:-1]
    last[:-1] |= word[:-1] & ~word[1:]
    core = np.flatnonzero(kind == 0)
    before = np.concatenate([[0], np.cumsum(kind == 0)])
    lo, hi = before[np.flatnonzero(first)], before[np.flatnonzero(last) + 1]
    some = hi > lo
    return core[lo[some]], core[hi[some] - 1] + 1


def _runs(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For rows repeated ``counts`` times: each copy's row, and its number among that row's copies."""
    of = np.repeat(np.arange(len(counts)), counts)
    return of, np.arange(len(of)) - np.repeat(np.cumsum(counts) - counts, counts)


def _disjoint(points: np.ndarray, starts: np.ndarray, ends: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Point, start and end of each point's disjoint islands, in order; positions are below ``width``."""
    order = np.argsort(points * width + starts)
    points, a = points[order], (points * width + starts)[order]
    reach = np.maximum.accumulate(points * width + ends[order])
    new = np.ones(len(a), bool)
    new[1:] = a[1:] > reach[:-1]
    at = np.flatnonzero(new)
    p = points[at]
    return p, a[at] - p * width, reach[np.append(at[1:], len(a))[: len(at)] - 1] - p * width


def _hits(islands: tuple[np.ndarray, np.ndarray, np.ndarray], starts: np.ndarray, ends: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Points and numbers of the sorted, disjoint tokens that a point's islands cover by at least half, some points at a time."""
    points, a, b = islands
    lo = np.searchsorted(ends, a, "right")
    counts = np.maximum(np.searchsorted(starts, b, "left") - lo, 0)
    before = np.concatenate([[0], np.cumsum(counts)])
    firsts = np.flatnonzero(np.append(True, points[1:] != points[:-1])) if len(points) else np.zeros(0, np.int64)
    part = before[firsts] // PAIRS
    bounds = [*firsts[np.append(True, part[1:] != part[:-1])].tolist(), len(points)] if len(points) else []
    for i, j in zip(bounds, bounds[1:]):
        of, n = _runs(counts[i:j])
        if not len(of):
            continue
        of += i
        token = lo[of] + n
        ids = points[of] * len(starts) + token  # in order, as a point's islands are
        at = np.flatnonzero(np.append(True, ids[1:] != ids[:-1]))
        held = np.add.reduceat(np.minimum(ends[token], b[of]) - np.maximum(starts[token], a[of]), at)
        token = token[at]
        hit = held * 2 >= ends[token] - starts[token]
        yield points[of[at]][hit], token[hit]


def _placed(lists: pa.Array, base: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.StructArray]:
    """Document, start and end of the listed spans, put right and cut as documents need it, and their other fields; empty ones are left out."""
    of = np.repeat(np.arange(len(lists)), pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False))
    flat = lists.flatten()
    s, e = (flat.field(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in (0, 1))
    a, b = np.maximum(np.minimum(s, e), 0), np.minimum(np.maximum(s, e), sizes[of])
    kept = np.flatnonzero(a < b)
    of = of[kept]
    return of, a[kept] + base[of], b[kept] + base[of], flat.take(pa.array(kept))


def _counted(batch: pa.RecordBatch, n_points: int, sums: dict[str | None, np.ndarray]) -> None:
    """Adds the counts of a batch ``split, text, g, p`` to ``sums``: for each split an array of points and ``_COUNTS``."""
    splits, texts = batch.column(0).to_pylist(), [t or "" for t in batch.column(1).to_pylist()]
    names = list(dict.fromkeys(splits))
    split = np.array([names.index(s) for s in splits])
    sizes = np.array([len(t) for t in texts], np.int64)
    base = np.cumsum(sizes) - sizes
    text = "".join(texts)
    codes = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    width = len(codes) + 1
    starts, ends = token_bounds(codes, base)
    by_token = split[np.searchsorted(base, starts, "right") - 1]
    doc, a, b, fields = _placed(batch.column(2), base, sizes)
    needed = fields.field(2).to_numpy(zero_copy_only=False).astype(bool)

    def under(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        out = np.zeros(len(starts), bool)
        for _, token in _hits(_disjoint(np.zeros(len(a), np.int64), a, b, width), starts, ends):
            out[token] = True
        return out

    some, req = under(a, b), under(a[needed], b[needed])
    doc, a, b = doc[needed], a[needed], b[needed]
    at = np.cumsum(b - a) - (b - a)
    of, n = _runs(b - a)
    es, ee = token_bounds(codes[a[of] + n], at)
    owner = np.searchsorted(at, es, "right") - 1
    es, ee = es - at[owner] + a[owner], ee - at[owner] + a[owner]
    own = np.array([y - x > _LONGEST or text[x:y].lower() not in _CONNECTORS for x, y in zip(es.tolist(), ee.tolist())], bool)
    owner, es, ee = owner[own], es[own], ee[own]

    _, start, end, fields = _placed(batch.column(3), base, sizes)
    low, high = (fields.field(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in (2, 3))
    of, n = _runs(np.maximum(np.minimum(high, n_points) - low, 0))
    islands = _disjoint(low[of] + n, start[of], end[of], width)

    found = {c: np.zeros((len(names), n_points), np.int64) for c in _COUNTS}
    found["docs"] += np.bincount(split, minlength=len(names))[:, None]
    found["req"] += np.bincount(by_token[req], minlength=len(names))[:, None]
    found["ents"] += np.bincount(split[doc], minlength=len(names))[:, None]
    for points, token in _hits(islands, starts, ends):
        cell = by_token[token] * n_points + points
        for c, x in (("pred", None), ("pred_ok", some), ("req_hit", req)):
            found[c] += np.bincount(cell if x is None else cell[x[token]], minlength=found[c].size).reshape(found[c].shape)
    found["fp"] += found["pred"] - found["pred_ok"]
    bounds = np.searchsorted(islands[0], np.arange(n_points + 1))
    for k, (i, j) in enumerate(zip(bounds.tolist(), bounds[1:].tolist())):
        leaked = np.unique(owner[~half_covered(es, ee, (islands[1][i:j], islands[2][i:j]))])
        found["ents_leaked"][:, k] += np.bincount(split[doc[leaked]], minlength=len(names))
        found["leak_docs"][:, k] += np.bincount(split[np.unique(doc[leaked])], minlength=len(names))
    for n, name in enumerate(names):
        now = np.stack([found[c][n] for c in _COUNTS], 1)
        sums[name] = sums[name] + now if name in sums else now


def tallies(docs: DataFrame, gold: DataFrame, predicted: DataFrame, grid: Sequence[tuple], keys: Sequence[str] = ("det",), types: Sequence[str] = ("string",)) -> DataFrame:
    """The totals of ``doc_scores`` for each split and grid point: ``split, keys, docs, req, req_hit, pred, pred_ok, ents, ents_leaked, leak_docs, fp``.

    Nothing is written for a document: its texts, spans and grid points are
    counted together by array operations, and a partition returns its sums.
    ``predicted`` holds ``doc_id, start_pos, end_pos, low, high``; a span counts
    at the grid points from ``low`` to before ``high``. ``gold`` holds ``doc_id,
    start_pos, end_pos, required``. Swapped offsets are put right, overrunning
    ones cut; empty spans, null offsets and spans of other documents do not count.
    """
    placed = "start_pos is not null and end_pos is not null and doc_id is not null"
    packed = lambda rows, name, *more: rows.where(placed).groupBy("doc_id").agg(F.collect_list(F.struct("start_pos", "end_pos", *more)).alias(name))
    rows = docs.select("doc_id", "split", "text").join(packed(gold, "g", "required"), "doc_id", "left").join(packed(predicted.where("low < high"), "p", "low", "high"), "doc_id", "left")
    points = [tuple(x) for x in grid]
    arrow_keys = [{"string": pa.string(), "double": pa.float64(), "int": pa.int32()}[t] for t in types]
    fields = [("split", pa.string()), *zip(keys, arrow_keys), *((c, pa.int64()) for c in _COUNTS)]
    schema = "split string, " + "".join(f"{k} {t}, " for k, t in zip(keys, types)) + ", ".join(f"{c} bigint" for c in _COUNTS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str | None, np.ndarray] = {}
        for batch in batches:
            size = pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False)
            part = np.cumsum(size) // SLICE
            bounds = [0, *(np.flatnonzero(part[1:] != part[:-1]) + 1).tolist(), batch.num_rows]
            for i, j in zip(bounds, bounds[1:]):
                if i < j:
                    _counted(batch.slice(i, j - i), len(points), sums)
        out = [(split, *point, *counts) for split, rows in sums.items() for point, counts in zip(points, rows.tolist())]
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*out), fields)], [n for n, _ in fields])

    return rows.select("split", "text", "g", "p").mapInArrow(run, schema).groupBy("split", *keys).agg(*(F.sum(c).alias(c) for c in _COUNTS))


def _text(value: object) -> str:
    """A key's value as Spark writes it."""
    return str(value)


def ratio(part: Column, whole: Column, empty: float) -> Column:
    return F.when(whole == 0, F.lit(empty)).otherwise(part / whole)


def f_beta(p: Column, r: Column, beta: int) -> Column:
    b = beta * beta
    return F.when(p + r == 0, F.lit(0.0)).otherwise((1 + b) * p * r / (b * p + r))


def corpus_scores(scores: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Totals and ratios of each group; recall, precision and entity recall are 1 where nothing was to be found. Empty groups have no row."""
    total = scores.groupBy(*keys).agg(
        F.count("*").alias("docs"), *(F.sum(c).alias(c) for c in ("req", "req_hit", "pred", "pred_ok", "ents", "ents_leaked")),
        F.count_if(F.col("ents_leaked") > 0).alias("leak_docs"), F.sum(F.size("fp_tokens")).alias("fp"),
    )
    return ratios(total, keys)


def ratios(total: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The totals of each group and their ratios."""
    p, r = ratio(F.col("pred_ok"), F.col("pred"), 1.0), ratio(F.col("req_hit"), F.col("req"), 1.0)
    return total.select(
        *keys, "docs", "req", "req_hit", (F.col("req") - F.col("req_hit")).alias("fn"), "pred", "pred_ok", "fp", "ents", "ents_leaked", "leak_docs",
        F.round(r, 6).alias("token_recall"), F.round(p, 6).alias("token_precision"), F.round(f_beta(p, r, 1), 6).alias("f1"), F.round(f_beta(p, r, 2), 6).alias("f2"),
        F.round(1 - ratio(F.col("ents_leaked"), F.col("ents"), 0.0), 6).alias("entity_recall"), F.round(F.col("fp") / F.col("docs"), 6).alias("fp_per_doc"),
    )


def per_label_recall(scores: DataFrame, keys: Sequence[str]) -> DataFrame:
    rows = scores.select(*keys, F.explode("ent_flags").alias("e")).groupBy(*keys, F.col("e.label").alias("label"))
    return rows.agg(F.count("*").alias("total"), F.count_if("e.leaked").alias("leaked")).withColumn("recall", F.round(1 - F.col("leaked") / F.col("total"), 3))


def fp_examples(scores: DataFrame, keys: Sequence[str], n: int = FP_EXAMPLES) -> DataFrame:
    """The first ``n`` false-positive tokens in code-point order, by a top-n that never gathers all of a group's tokens."""
    tokens = scores.select(*keys, F.explode("fp_tokens").alias("tok")).distinct()
    names = ", ".join(keys)
    first = tokens.selectExpr("*", f"row_number() over (partition by {names} order by tok) as _n").where(f"_n <= {n}")
    return first.groupBy(*keys).agg(F.array_sort(F.collect_list("tok")).alias("examples"))


EXAMPLES = 8


def _first_few(rows: DataFrame, keys: Sequence[str], value: str, n: int) -> DataFrame:
    """The first ``n`` different values of each group in code-point order, by a top-n that never gathers a group."""
    ranked = rows.select(*keys, value).distinct().selectExpr("*", f"row_number() over (partition by {', '.join(keys)} order by {value}) as _n").where(f"_n <= {n}")
    return ranked.groupBy(*keys).agg(F.array_sort(F.collect_list(value)).alias("examples"))


def error_sources(predicted: DataFrame, gold: DataFrame, n: int = 15) -> DataFrame:
    """The ``n`` (src, label) with most predictions that touch no gold span, with ``EXAMPLES`` example surfaces of at most 50 characters each."""
    wrong = sp.uncovered(predicted, gold).select(F.coalesce("src", F.lit("")).alias("src"), "label", F.left("surface", F.lit(50)).alias("surface"))
    counted = wrong.groupBy("src", "label").agg(F.count("*").alias("n_wrong")).orderBy(F.desc("n_wrong"), "src", "label").limit(n)
    shown = _first_few(wrong.join(F.broadcast(counted.select("src", "label")), ["src", "label"], "left_semi"), ["src", "label"], "surface", EXAMPLES)
    return counted.join(shown, ["src", "label"])


def leaks_by_label(scores: DataFrame, keys: Sequence[str], n: int = 10) -> DataFrame:
    """Leaked entities by label with ``n`` examples ``document: surface``."""
    rows = scores.select(*keys, "doc_id", F.explode("leaks").alias("l")).select(*keys, F.col("l.label").alias("label"), F.concat_ws(": ", "doc_id", F.left("l.text", F.lit(50))).alias("example"))
    return rows.groupBy(*keys, "label").agg(F.count("*").alias("n_leaks")).join(_first_few(rows, [*keys, "label"], "example", n), [*keys, "label"])


def trace(predicted: DataFrame) -> DataFrame:
    return predicted.groupBy("doc_id", "det").agg(F.count("*").alias("n_spans"))


def leak_summary(errors: DataFrame) -> DataFrame:
    """Totals of per-document error rows: documents, documents with a leak, leaked entities, false-positive tokens."""
    return errors.agg(
        F.count("*").alias("docs"),
        F.count_if(F.size("fn_leaks") > 0).alias("leak_docs"),
        F.sum(F.greatest(F.size("fn_leaks"), F.lit(0))).alias("leaked"),
        F.sum(F.greatest(F.size("fp_tokens"), F.lit(0))).alias("fp"),
    )
