"""Threshold sweeps, leaderboards and run selection."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cloakframe.operators import scoring
from cloakframe.plans.frames import MAX_DETECTORS
from cloakframe.session import collect_bounded

THRESHOLDS = (0.0, 0.3, 0.5, 0.6, 0.7, 0.8, 0.9)


def sweep(docs: DataFrame, gold: DataFrame, spans: DataFrame, detectors: Sequence[str], thresholds: Sequence[float] = THRESHOLDS) -> DataFrame:
    """Corpus scores of every detector and threshold on every split, in one job.

    A span counts at every threshold that its score reaches; a null score
    reaches only the lowest. Those are the first of the sorted thresholds, so
    each span is one row with a range of grid points.
    """
    floors, names = sorted({float(t) for t in thresholds}), list(dict.fromkeys(detectors))
    grid = [(d, t) for d in names for t in floors]
    score = F.coalesce(F.col("score").cast("double"), F.lit(min(floors)))
    reached = sum(((score >= F.lit(t)).cast("int") for t in floors), F.lit(0))
    low = (F.array_position(F.array(*map(F.lit, names)).cast("array<string>"), F.col("det")).cast("int") - 1) * len(floors)
    kept = spans.where(F.col("det").isin(*names)).select("doc_id", "start_pos", "end_pos", low.alias("low"), (low + reached).alias("high"))
    return scoring.ratios(scoring.tallies(docs, gold, kept, grid, ["det", "threshold"], ["string", "double"]), ["split", "det", "threshold"])


def best_threshold(swept: DataFrame, on_split: str) -> DataFrame:
    """For each detector the threshold with the best F2; ties go to fewer leaking documents, then to the lower threshold."""
    ranked = swept.where(F.col("split") == on_split).selectExpr("*", "row_number() over (partition by det order by f2 desc, leak_docs, threshold) as _r")
    return ranked.where("_r = 1").drop("_r")


def best_per_stack(runs: DataFrame) -> DataFrame:
    """Each stack's best run by F2, then fewer false positives, then the earlier log entry."""
    ranked = runs.selectExpr("*", "row_number() over (partition by stack order by f2 desc nulls last, fp_per_doc asc nulls last, log_order) as _r")
    return ranked.where("_r = 1").drop("_r")


def top_runs(runs: DataFrame, n: int = 20) -> DataFrame:
    return runs.orderBy(F.desc_nulls_last("f2"), F.asc_nulls_last("fp_per_doc"), "log_order").limit(n)


def gated(swept: DataFrame, on_split: str, least_f2: float) -> DataFrame:
    """Partner candidates for a union sweep: best thresholds whose F2 passes the gate."""
    return best_threshold(swept, on_split).where(F.col("f2") >= least_f2)


def union_sweep(docs: DataFrame, gold: DataFrame, spans: DataFrame, base: str, partners: DataFrame) -> DataFrame:
    """The second pass: the base detector's spans with each partner's, every detector at its own threshold, scored on every split.

    ``partners`` are rows ``det, threshold`` as ``gated`` returns them, the
    base among them; partners that the gate left out are not tried.
    """
    best = [(r.det, r.threshold) for r in collect_bounded(partners.select("det", "threshold"), MAX_DETECTORS, "partners")]  # one row for each detector
    names = sorted({d for d, _ in best if d != base})
    reached = [(F.col("det") == d) & (F.coalesce(F.col("score").cast("double"), F.lit(0.0)) >= t) for d, t in best if t is not None]
    own = spans.where(F.lit(False) if not reached else reduce(or_, reached)) if names else spans.limit(0)
    place = F.array_position(F.array(*map(F.lit, names)), F.col("det")).cast("int") if names else F.lit(0)
    low, high = F.when(F.col("det") == base, 0).otherwise(place - 1), F.when(F.col("det") == base, len(names)).otherwise(place)
    mixed = own.select("doc_id", "start_pos", "end_pos", low.alias("low"), high.alias("high"))
    return scoring.ratios(scoring.tallies(docs, gold, mixed, [(n,) for n in names], ["pair"]), ["split", "pair"])


def best_run(runs: DataFrame) -> DataFrame:
    """The whole row of the run with the best F2; ties as in ``best_per_stack``."""
    return top_runs(runs, 1)


def unscored(runs: DataFrame, wanted: DataFrame) -> DataFrame:
    """Stack and split pairs that still have no run."""
    return wanted.join(runs.select("stack", "split").distinct(), ["stack", "split"], "left_anti")


def parameter_text(params: str = "params") -> Column:
    """``key=value`` pairs of a JSON object, sorted by key, joined by commas; empty for null or invalid JSON."""
    pairs = F.map_entries(F.from_json(F.col(params), "map<string,string>"))
    return F.coalesce(F.concat_ws(",", F.transform(F.array_sort(pairs), lambda e: F.concat(e["key"], F.lit("="), F.coalesce(e["value"], F.lit("null"))))), F.lit(""))
