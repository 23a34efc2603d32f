"""Stacks, ablations and evaluation loops: configuration is rows, evaluation is one plan for each stack."""

from __future__ import annotations

import json
from collections.abc import Iterable, Sequence
from dataclasses import asdict, dataclass, field, fields, replace
from itertools import product
from pathlib import Path
from time import perf_counter

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cloakframe.operators import detectors
from cloakframe.operators.detectors import Stack
from cloakframe.operators.policy import Config
from cloakframe.plans import pipeline


def load_stacks(path: str) -> list[Stack]:
    """Stacks of a JSON file: name, detectors with score floors, switches, adjudicator."""
    return [Stack(x["name"], {k: float(v) for k, v in x.get("detectors", {}).items()}, x.get("cfg") or {}, x.get("adjudicator")) for x in json.loads(Path(path).read_text())]


def config_of(stack: Stack) -> Config:
    """The pipeline's switches; an unknown one raises."""
    known = {f.name for f in fields(Config)}
    if unknown := set(stack.cfg) - known:
        raise ValueError(f"unknown switches: {sorted(unknown)}")
    return Config(**stack.cfg)


def ablations(base: Stack, switches: dict[str, Sequence]) -> list[Stack]:
    """The base, and for each switch and value the base with only that changed."""
    changed = [replace(base, name=f"{base.name} {k}={v}", cfg={**base.cfg, k: v}) for k, values in switches.items() for v in values]
    return [base, *changed]


def grid(base: Stack, floors: dict[str, Sequence[float]], switches: dict[str, Sequence] | None = None) -> list[Stack]:
    """Every combination of score floors and switch values."""
    axes = [[("f", k, v) for v in values] for k, values in floors.items()] + [[("c", k, v) for v in values] for k, values in (switches or {}).items()]
    out = []
    for point in product(*axes):
        name = base.name + "".join(f" {k}={v}" for _, k, v in point)
        out.append(replace(base, name=name, detectors={**base.detectors, **{k: v for s, k, v in point if s == "f"}}, cfg={**base.cfg, **{k: v for s, k, v in point if s == "c"}}))
    return out


def as_rows(spark: SparkSession, stacks: Iterable[Stack], splits: Sequence[str]) -> DataFrame:
    """Stack and split pairs with their configuration: ``stack, split, detectors, cfg``."""
    rows = [(s.name, split, s.detectors, json.dumps(s.cfg, sort_keys=True)) for s in stacks for split in splits]
    return spark.createDataFrame(rows, "stack string, split string, detectors map<string,double>, cfg string")


def run_stack(docs: DataFrame, gold: DataFrame, spans: DataFrame, stack: Stack, replies: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(corpus scores on every split, masked texts) of one stack over recorded detector spans and, for a judge, its replies ``doc_id, out``."""
    judge = stack.adjudicator or {}
    if stack.adjudicator and replies is None:
        raise ValueError(f"{stack.name} has a judge; give its recorded replies")
    found = pipeline.found(
        docs, detectors.floor(spans, stack.detectors) if stack.detectors else None, config_of(stack),
        replies if stack.adjudicator else None, str(judge.get("mode", "full")), judge.get("drop_labels"),
    )
    return pipeline.evaluate(docs, gold, pipeline.as_rows(found), stack.name), pipeline.masked(found)


def timed_run(docs: DataFrame, gold: DataFrame, spans: DataFrame, stack: Stack, folder: str, replies: DataFrame | None = None) -> DataFrame:
    """Runs a stack, writes its masked texts below ``folder`` and returns its scores with ``sec_per_doc``, the measured time over the documents."""
    began = perf_counter()
    scores, masked = run_stack(docs, gold, spans, stack, replies)
    masked.write.mode("overwrite").parquet(f"{folder}/masked")
    spent = perf_counter() - began
    n = docs.sparkSession.read.parquet(f"{folder}/masked").count()
    return scores.withColumn("sec_per_doc", F.lit(round(spent / max(1, n), 6)))


def evaluate_all(docs: DataFrame, gold: DataFrame, spans: DataFrame, stacks: Iterable[Stack]) -> DataFrame:
    parts = [run_stack(docs, gold, spans, s)[0] for s in stacks]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def without_training_splits(pairs: DataFrame, trained: DataFrame) -> DataFrame:
    """Pairs whose stack was not trained on the split: ``trained`` has ``stack, split``."""
    return pairs.join(trained.select("stack", "split").distinct(), ["stack", "split"], "left_anti")


def with_cached_detectors(pairs: DataFrame, cached: DataFrame) -> DataFrame:
    """Pairs all of whose detectors have a recorded output for the split: ``cached`` has ``det, split``."""
    need = pairs.select("stack", "split", F.explode(F.map_keys("detectors")).alias("det"))
    lacking = need.join(cached.select("det", "split").distinct(), ["det", "split"], "left_anti").select("stack", "split").distinct()
    return pairs.join(lacking, ["stack", "split"], "left_anti")


@dataclass(frozen=True)
class Hosted:
    """A detector hosted in an analysis engine: models, labels, chunking, patterns, phone regions."""

    name: str
    models: tuple[str, ...]
    labels: tuple[str, ...] = ()
    flat: bool = True
    chunker: str = "char"  # "char" or "line"
    size: int = 250
    overlap: int = 50
    patterns: str = "all"  # "all", "cv" or "none"
    dropped: tuple[str, ...] = ()
    regions: tuple[str, ...] = ()
    keep_ner: bool = False
    allowed: tuple[str, ...] = ()
    context: tuple[str, ...] = field(default=())

    def recognizers(self, available: Sequence[str], cv_patterns: Sequence[str]) -> list[str]:
        """What the engine runs: its NER only if kept, its patterns by set, nothing that is dropped, then the models."""
        own = [r for r in available if (self.keep_ner or not r.endswith("NerRecognizer")) and r not in self.dropped]
        if self.patterns == "none":
            own = [r for r in own if r.endswith("NerRecognizer")]
        elif self.patterns == "cv":
            own = [r for r in own if r in cv_patterns or r.endswith("NerRecognizer")]
        return [*own, *self.models]

    def windows(self, docs: DataFrame) -> DataFrame:
        """The pieces that its models read: characters with an overlap of characters, or whole lines with an overlap of lines."""
        return detectors.char_windows(docs, self.size, self.overlap) if self.chunker == "char" else detectors.line_windows(docs, self.size, self.overlap)

    def results(self, found: DataFrame) -> DataFrame:
        """Final spans of what the models and patterns found (with ``surface`` and ``before``): context words, the allow list, then one of each overlap."""
        rows = detectors.in_context(found, self.context) if self.context else found
        rows = detectors.allowed_out(rows, self.allowed) if self.allowed else rows
        return detectors.merged_windows(rows)

    def as_dict(self) -> dict:
        return asdict(self)


def summary(scores: DataFrame) -> DataFrame:
    """One line of text for each score row."""
    return scores.select("*", F.format_string("R %.3f P %.3f F2 %.3f leaks %d/%d FP %.2f", "token_recall", "token_precision", "f2", "leak_docs", "docs", "fp_per_doc").alias("summary"))
