"""Sinks: run logs, per-document errors, stack results and Markdown tables."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TABLE_ROWS = 10_000


def append_run(scores: DataFrame, path: str, stack: dict, split: str, group: str = "", note: str = "") -> None:
    """Appends one JSON line for each score row; detectors, switches and judge are flattened into ``params``."""
    params = {**{f"det:{k}": v for k, v in stack.get("detectors", {}).items()}, **stack.get("cfg", {}), **({"judge": stack["adjudicator"]} if stack.get("adjudicator") else {})}
    stamped = scores.withColumns({
        "ts": F.date_format(F.current_timestamp(), "yyyy-MM-dd HH:mm"), "group": F.lit(group), "stack": F.lit(stack["name"]), "split": F.lit(split),
        "params": F.lit(json.dumps(params, sort_keys=True)), "note": F.lit(note),
    })
    stamped.write.mode("append").json(path)


def stack_digest(stack: dict) -> str:
    return hashlib.md5(json.dumps(stack, sort_keys=True).encode()).hexdigest()[:8]


def stack_result(scores: DataFrame, masked: DataFrame, folder: str, stack: dict, split: str) -> str:
    """Scores and masked texts of one stack below a name with the stack's digest; returns that folder."""
    where = f"{folder}/{stack['name'].replace('/', '_')}__{split}__{stack_digest(stack)}"
    scores.write.mode("overwrite").json(f"{where}/scores")
    masked.write.mode("overwrite").json(f"{where}/outputs")
    return where


def judge_errors(scores: DataFrame, path: str) -> None:
    """One row for each document: ``id, fn_leaks, fp_tokens``."""
    scores.select(F.col("doc_id").alias("id"), F.col("leaks").alias("fn_leaks"), "fp_tokens").write.mode("overwrite").json(path)


def markdown(rows: DataFrame, columns: Sequence[str] | None = None) -> str:
    """A Markdown table of a report; reports are small, more than ``TABLE_ROWS`` rows raise."""
    names = list(columns or rows.columns)
    cells = [F.coalesce(F.format_string("%.3f", c) if dict(rows.dtypes)[c] in ("double", "float") else F.col(c).cast("string"), F.lit("–")).alias(c) for c in names]
    held = rows.select(*cells).limit(TABLE_ROWS + 1).collect()
    if len(held) > TABLE_ROWS:
        raise ValueError(f"a report of more than {TABLE_ROWS} rows is no table")
    lines = [" | ".join(names), " | ".join("---" for _ in names), *(" | ".join(r) for r in held)]
    return "\n".join(f"| {x} |" for x in lines) + "\n"
