"""Language models: requests, a write-through store of replies, parsing, extraction, and a judge's decisions."""

from __future__ import annotations

import hashlib
import json
import logging
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType

from cloakframe.functions import fixed
from cloakframe.operators import spans as sp
from cloakframe.session import cut, path_exists

ITEM = "array<struct<text:string,label:string>>"
EXTRACT = f"struct<pii:{ITEM}>"
VERDICT = f"struct<decisions:map<string,string>,missed:{ITEM}>"
TRUSTED = ("re", "re-kv", "net")
REVIEWED = ("NAME", "LOCATION", "ADDRESS", "EDU_ORG", "ID", "NATIONALITY", "URL", "DOB", "ORG")
MODES = ("full", "drop_only", "add_only", "none")


EXTRACT_SYSTEM = (
    "You read one text and list all personal data in it. Answer with one JSON object "
    '{"pii": [{"text": "...", "label": "..."}]}, every text copied letter by letter. Labels: ' + ", ".join(fixed.REPLY_LABELS) + "."
)
JUDGE_SYSTEM = (
    "You check what is to be masked in one text. For each numbered candidate say mask or keep visible, and add personal data that no candidate covers. "
    'Answer with one JSON object {"decisions": {"0": "mask"}, "missed": [{"text": "...", "label": "..."}]}. Labels: ' + ", ".join(fixed.REPLY_LABELS) + "."
)
MAX_TOKENS = 1500
Client = Callable[[str, str, int], str]


def key_of(model: str, system: str, user: str, max_tokens: int) -> str:
    """A request's key: md5 of the JSON list, escaped as Python writes it, so that recorded replies are found again."""
    return hashlib.md5(json.dumps([model, system, user, int(max_tokens)]).encode()).hexdigest()


@pandas_udf(StringType())
def reply_key(model, system, user, max_tokens):  # type: ignore[no-untyped-def]
    """``key_of`` by row; JSON of the JVM escapes other characters, so this is an Arrow batch in Python."""
    import pandas as pd

    return pd.Series([key_of(*x) for x in zip(model, system, user, max_tokens)])


def extraction_requests(docs: DataFrame) -> DataFrame:
    """``doc_id, system, user`` that ask for the personal data of a text."""
    return docs.where("text is not null").select("doc_id", F.lit(EXTRACT_SYSTEM).alias("system"), F.concat(F.lit("TEXT:\n<<<\n"), "text", F.lit("\n>>>")).alias("user"))


def judge_requests(docs: DataFrame, spans: DataFrame, reviewed: Sequence[str] | None = None) -> DataFrame:
    """``doc_id, system, user`` that show a judge the text and its numbered candidates; documents without candidates are asked too, for what was missed."""
    asked = questions(spans, reviewed or REVIEWED)
    rows = docs.where("text is not null").select("doc_id", "text").join(asked, "doc_id", "left")
    body = F.concat(F.lit("TEXT:\n<<<\n"), "text", F.lit("\n>>>\nCANDIDATES:\n"), F.coalesce("question", F.lit("none")))
    return rows.select("doc_id", F.lit(JUDGE_SYSTEM).alias("system"), body.alias("user"))


def replied(requests: DataFrame, model: str, load: Callable[[], Client], store: str, max_tokens: int = MAX_TOKENS) -> DataFrame:
    """``doc_id, key, out`` of requests, by a write-through store of replies, keyed by ``reply_key``.

    Only requests whose key has no usable reply are sent, equal ones once;
    ``load`` runs once for each task and returns ``(system, user, max_tokens) ->
    reply``. Replies that are no JSON are kept out of the store, so they are
    asked for again next time; a client that raises gives a null reply.
    """
    spark = requests.sparkSession
    keyed = requests.withColumn("key", reply_key(F.lit(model), "system", "user", F.lit(max_tokens)))
    known = spark.read.parquet(store).select("key", "out").dropDuplicates(["key"]) if path_exists(spark, store) else spark.createDataFrame([], "key string, out string")
    todo = keyed.select("key", "system", "user").dropDuplicates(["key"]).join(known.select("key"), "key", "left_anti")

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        client = load()
        for batch in batches:
            out = []
            for system, user in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                try:
                    out.append(client(system, user, max_tokens))
                except Exception as error:  # a refused or broken call is no reply
                    logging.getLogger(__name__).warning("no reply: %s", error)
                    out.append(None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], ["key", "out"])

    new = cut(todo.mapInArrow(ask, "key string, out string"))
    new.where(usable(F.col("out"))).write.mode("append").parquet(store)
    return keyed.select("doc_id", "key").join(known.unionByName(new), "key", "left").select("doc_id", "key", "out")


def usable(out: Column) -> Column:
    """Whether a reply holds a JSON object."""
    inner = F.regexp_extract(out, r"(?s)\{.*\}", 0)
    return F.coalesce((inner != "") & F.try_parse_json(inner).isNotNull(), F.lit(False))


def parsed(out: Column, schema: str) -> Column:
    """A reply as ``schema``: the whole text as JSON, else from its first to its last brace, else null."""
    inner = F.regexp_extract(out, r"(?s)\{.*\}", 0)
    good = lambda c: F.try_parse_json(c).isNotNull()
    return F.when(good(out) & F.btrim(out).startswith("{"), F.from_json(out, schema)).when((inner != "") & good(inner), F.from_json(inner, schema))


def reply_label(label: Column) -> Column:
    up = F.upper(F.btrim(label))
    return F.when(up.isin(*fixed.REPLY_LABELS), up).otherwise(F.lit("OTHER"))


def extracted(docs: DataFrame, replies: DataFrame, score: float = 0.9) -> DataFrame:
    """Spans of every occurrence of the surfaces in ``doc_id, out`` replies; unknown labels become OTHER.

    Replies that are no JSON, entries without text and texts of one character give nothing.
    """
    items = replies.select("doc_id", F.explode(parsed(F.col("out"), EXTRACT)["pii"]).alias("i"))
    wanted = items.select("doc_id", F.btrim("i.text").alias("surface"), reply_label(F.col("i.label")).alias("label")).where("length(surface) >= 2").distinct()
    return sp.locate_all(docs, wanted).withColumns({"src": F.lit("llm"), "score": F.lit(score)})


def questions(spans: DataFrame, reviewed: Sequence[str] = REVIEWED) -> DataFrame:
    """One prompt block for each document: numbered surfaces with label and line, in first-seen order."""
    open_ = spans.where(~F.col("src").isin(*TRUSTED) & F.col("label").isin(*reviewed))
    lines = open_.groupBy("doc_id", F.btrim("surface").alias("surface"), "label").agg(F.min_by("line", "span_id").alias("line"))
    numbered = sp.review_candidates(open_).join(lines, ["doc_id", "surface", "label"])
    row = F.struct("candidate", F.format_string("%d. [%s] %s | %s", "candidate", "label", "surface", F.substring(F.btrim("line"), 1, 140)).alias("q"))
    return numbered.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(row)), lambda x: x["q"]), "\n").alias("question"))


def adjudicated(docs: DataFrame, spans: DataFrame, replies: DataFrame, mode: str = "full", drop_labels: Sequence[str] | None = None, reviewed: Sequence[str] = REVIEWED) -> DataFrame:
    """Spans after a judge: trusted and unreviewed ones pass; others stay unless a verdict says keep visible.

    Only ``full`` and ``drop_only`` drop, only ``full`` and ``add_only`` add what
    was missed. Reviewed spans get ``+adj`` after their source, added ones ``re-llm-add``.
    Columns: ``doc_id, span_id, start_pos, end_pos, label, src, surface``.
    """
    columns = ["doc_id", "span_id", "start_pos", "end_pos", "label", "src", "surface"]
    if mode == "none":
        return spans.select(*columns)
    passes = F.col("src").isin(*TRUSTED) | ~F.col("label").isin(*reviewed)
    verdicts = replies.select("doc_id", parsed(F.col("out"), VERDICT).alias("v"))
    decided = verdicts.select("doc_id", F.explode("v.decisions").alias("candidate", "verdict")).withColumn("candidate", F.col("candidate").cast("int"))
    open_ = spans.where(~passes)
    numbered = sp.review_candidates(open_).join(decided, ["doc_id", "candidate"], "left")
    joined = open_.withColumn("_s", F.btrim("surface")).join(numbered.withColumnRenamed("surface", "_s"), ["doc_id", "_s", "label"], "left")
    may = F.col("label").isin(*drop_labels) if drop_labels is not None else F.lit(True)
    drop = F.coalesce(F.lower("verdict").contains("keep"), F.lit(False)) & may if mode in ("full", "drop_only") else F.lit(False)
    out = spans.where(passes).select(*columns).unionByName(joined.where(~drop).withColumn("src", F.concat("src", F.lit("+adj"))).select(*columns))
    if mode in ("full", "add_only"):
        missed = verdicts.select("doc_id", F.explode("v.missed").alias("i"))
        wanted = missed.select("doc_id", F.btrim("i.text").alias("surface"), reply_label(F.col("i.label")).alias("label")).where("length(surface) >= 2").distinct()
        added = sp.locate_all(docs, wanted).withColumns({"src": F.lit("re-llm-add"), "span_id": F.lit(None).cast("long")})
        out = out.unionByName(added.select(*columns))
    return out
