"""Readers for document dumps, records, detector outputs, replies and run logs."""

from __future__ import annotations

from pathlib import PurePosixPath

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cloakframe.operators import spans as sp
from cloakframe.session import path_exists

GOLD = "array<struct<start:int,end:int,label:string,required:boolean,text:string>>"
RECORD = f"id string, lang string, layout string, title string, text string, gold {GOLD}"
SPEC = "id string, lang string, text string, gold array<array<string>>"
CACHE = "spans map<string,array<struct<start:int,end:int,label:string,src:string,score:double>>>, seconds double, docs int"
RUN = "ts string, `group` string, stack string, split string, params string, note string, token_recall double, token_precision double, f1 double, f2 double, entity_recall double, entities_leaked int, leak_docs int, docs int, fp_tokens int, fp_per_doc double, sec_per_doc double"
JUDGE_ERROR = "id string, fn_leaks array<struct<label:string,text:string,visible:array<string>>>, fp_tokens array<string>"
BANNER_END = "=\nCV-"  # what ends a banner's upper rule and begins its title; the dump is split there


def banner_dump(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id, title, text`` of a dump whose documents stand below banners; each text ends in one newline.

    The dump is read by a separator, so a large one is split over many tasks.
    """
    blocks = spark.read.option("lineSep", BANNER_END).text(path)
    part = lambda n: F.regexp_extract("value", r"(?s)\A(?:=*\nCV-)?(\d+) \| ([^\n]*)\n=+\n(.*)\z", n)
    rows = blocks.where(part(1) != "").select(F.concat(F.lit("CV-"), part(1)).alias("doc_id"), F.btrim(part(2)).alias("title"), part(3).alias("body"))
    own = F.regexp_replace(F.regexp_replace("body", r"(?:^|\n)=+\z", ""), r"\n+\z", "")
    return rows.select("doc_id", "title", F.concat(own, F.lit("\n")).alias("text"))


def records(spark: SparkSession, path: str) -> DataFrame:
    """One JSON object for each line that is not blank, with the schema of a record; ``malformed`` gives the lines that are none."""
    return spark.read.schema(RECORD).json(path).where("id is not null")


def malformed(spark: SparkSession, path: str) -> DataFrame:
    """``line`` of each line of a records file that is neither blank nor a JSON object with an ``id``."""
    lines = spark.read.text(path).withColumnRenamed("value", "line").where("trim(line) <> ''")
    return lines.where(F.get_json_object("line", "$.id").isNull())


def gold_rows(recs: DataFrame) -> DataFrame:
    """The nested annotation as rows: ``doc_id, span_no, start_pos, end_pos, label, required, surface``."""
    each = recs.select(F.col("id").alias("doc_id"), F.posexplode("gold").alias("n", "g"))
    return each.select("doc_id", (F.col("n") + 1).alias("span_no"), F.col("g.start").alias("start_pos"), F.col("g.end").alias("end_pos"), "g.label", F.coalesce("g.required", F.lit(True)).alias("required"), F.col("g.text").alias("surface"))


def spec_records(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(docs, gold) of a JSON array whose gold entries are ``[surface, label, required, nth]``.

    Every surface is located; one that does not occur raises.
    """
    raw = spark.read.schema(SPEC).option("multiLine", True).json(path)
    docs = raw.select(F.col("id").alias("doc_id"), "lang", "text")
    entry = raw.select(F.col("id").alias("doc_id"), F.posexplode("gold").alias("n", "g"))
    rows = entry.select(
        "doc_id", "n", F.get("g", F.lit(0)).alias("surface"), F.get("g", F.lit(1)).alias("label"),
        F.coalesce(F.lower(F.get("g", F.lit(2))) == "true", F.lit(True)).alias("required"), F.get("g", F.lit(3)).cast("int").alias("nth"),
    )
    return docs, sp.locate_all(docs, rows, strict=True)


def from_spec(docs: DataFrame, spec: DataFrame) -> DataFrame:
    """Gold rows from ``doc_id, surface, label, required, nth``; a specified document that is missing raises."""
    missing = spec.select("doc_id").distinct().join(docs.select("doc_id", F.lit(True).alias("_there")), "doc_id", "left")
    checked = missing.select("doc_id", F.when(F.col("_there").isNull(), F.raise_error(F.concat(F.lit("no document "), "doc_id"))).otherwise(F.lit(True)).alias("_ok"))
    return sp.locate_all(docs, spec.join(checked, "doc_id").where("_ok").drop("_ok"), strict=True)


def all_splits(**splits: DataFrame) -> DataFrame:
    """Several splits as one table with a column ``split``."""
    out = None
    for name, df in splits.items():
        part = df.withColumn("split", F.lit(name))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    if out is None:
        raise ValueError("no split given")
    return out


def cache_name(detector: str, split: str) -> str:
    return f"{detector}__{split}".replace("/", "_").replace(":", "_")


def detector_cache(spark: SparkSession, path: str, detector: str, split: str) -> DataFrame:
    """Spans of a recorded detector output: ``doc_id, span_id, start_pos, end_pos, label, src, score, det``."""
    file = str(PurePosixPath(path) / f"{cache_name(detector, split)}.json") if "://" not in path else f"{path}/{cache_name(detector, split)}.json"
    raw = spark.read.schema(CACHE).option("multiLine", True).json(file)
    each = raw.select(F.explode("spans").alias("doc_id", "s")).select("doc_id", F.posexplode("s").alias("span_id", "s"))
    return each.select("doc_id", F.col("span_id").cast("long").alias("span_id"), F.col("s.start").alias("start_pos"), F.col("s.end").alias("end_pos"), "s.label", "s.src", F.coalesce("s.score", F.lit(1.0)).alias("score"), F.lit(detector).alias("det"))


def cached_spans(spark: SparkSession, store: str, detector: str, split: str, docs: DataFrame, run) -> DataFrame:
    """Read-through store of detector spans, a folder for each detector and split, keyed by a hash of each text.

    Only documents whose text is not stored yet are run; their spans go into a
    folder of their own, named by those texts, so a batch that is run again
    overwrites itself. A store that exists but cannot be read raises.
    """
    folder = f"{store}/det={cache_name(detector, split)}"
    hashed = docs.select("doc_id", "text", F.md5("text").alias("text_md5"))
    known = spark.read.option("recursiveFileLookup", "true").parquet(folder) if path_exists(spark, folder) else None
    todo = hashed if known is None else hashed.join(known.select("doc_id", "text_md5").distinct(), ["doc_id", "text_md5"], "left_anti")
    batch = todo.agg(F.count("*").alias("n"), F.coalesce(F.bit_xor(F.xxhash64("doc_id", "text_md5")), F.lit(0)).alias("h")).first()
    if batch.n:
        found = todo.select("doc_id", "text_md5").join(run(todo.select("doc_id", "text")), "doc_id", "left")
        found.write.mode("overwrite").parquet(f"{folder}/batch-{batch.h & ((1 << 64) - 1):016x}")
    stored = spark.read.option("recursiveFileLookup", "true").parquet(folder)
    return stored.join(hashed.select("doc_id", "text_md5"), ["doc_id", "text_md5"], "left_semi").where("start_pos is not null").drop("text_md5").distinct()


def replies(spark: SparkSession, path: str) -> DataFrame:
    """``key, out`` of recorded replies, one JSON file each; the key is the file's name. A file that is no JSON has a null reply."""
    raw = spark.read.text(path, wholetext=True).withColumn("_file", F.input_file_name())
    return raw.select(F.regexp_extract("_file", r"([^/]+)\.json$", 1).alias("key"), F.when(F.try_parse_json("value").isNotNull(), F.get_json_object("value", "$.out")).alias("out"))


def run_log(spark: SparkSession, path: str, split: str | None = None, group: str | None = None) -> DataFrame:
    rows = spark.read.schema(RUN).json(path)
    if split is not None:
        rows = rows.where(F.col("split") == split)
    return rows if group is None else rows.where(F.col("group") == group)


def judge_errors(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(JUDGE_ERROR).json(path)
