import json

import pytest
from pyspark.sql import functions as F

from cloakframe.functions import textops
from cloakframe.operators import detectors
from cloakframe.operators.detectors import Stack
from cloakframe.plans import pipeline, stacks
from cloakframe.sources import fixtures, readers


def test_generated_records_are_consistent(spark):
    one, two = fixtures.records(spark, 30), fixtures.records(spark, 30)
    assert fixtures.mismatches(one).count() == 0 and one.collect() == two.collect()
    assert fixtures.records(spark, 30, seed=8).collect() != one.collect()


def test_pipeline_finds_what_the_generator_planted(spark):
    recs = fixtures.records(spark, 40)
    docs = recs.select(F.col("id").alias("doc_id"), F.lit("s").alias("split"), "text")
    r = pipeline.evaluate(docs, readers.gold_rows(recs), pipeline.run(docs), "rules").first()
    assert r.docs == 40 and r.token_recall == 1.0 and r.leak_docs == 0 and r.token_precision > 0.95


def test_stack_files_and_grids(spark, tmp_path):
    path = tmp_path / "s.json"
    path.write_text(json.dumps([{"name": "S", "detectors": {"a": 0.4}, "cfg": {"vote_k": 2}}]))
    (base,) = stacks.load_stacks(str(path))
    assert stacks.config_of(base).vote_k == 2
    with pytest.raises(ValueError, match="unknown"):
        stacks.config_of(Stack("x", {}, {"nope": 1}))
    assert [s.cfg for s in stacks.ablations(base, {"policy": [False]})] == [{"vote_k": 2}, {"vote_k": 2, "policy": False}]
    assert len(stacks.grid(base, {"a": [0.1, 0.2], "b": [0.3]}, {"vote_k": [1, 2]})) == 4
    pairs = stacks.as_rows(spark, [base, Stack("T", {"b": 0.1})], ["h2", "h3"])
    trained = spark.createDataFrame([("S", "h3")], "stack string, split string")
    cached = spark.createDataFrame([("a", "h2"), ("a", "h3"), ("b", "h2")], "det string, split string")
    left = stacks.with_cached_detectors(stacks.without_training_splits(pairs, trained), cached).collect()
    assert {(r.stack, r.split) for r in left} == {("S", "h2"), ("T", "h2")}


def test_recorded_detectors_with_floors(spark):
    text = "Ada Byrne\n\nExperience\nmet Cy Dunn there\n"
    docs = spark.createDataFrame([("d", "s", text)], "doc_id string, split string, text string")
    at = text.index("Cy")
    spans = spark.createDataFrame([("d", 1, at, at + 7, "NAME", "ner", "ner", 0.4, "Cy Dunn")], "doc_id string, span_id long, start_pos int, end_pos int, label string, det string, src string, score double, surface string")
    gold = spark.createDataFrame([("d", 1, at, at + 7, "NAME", True, "Cy Dunn")], "doc_id string, span_no int, start_pos int, end_pos int, label string, required boolean, surface string")
    got = {r.stack: r.token_recall for r in stacks.evaluate_all(docs, gold, spans, [Stack("low", {"ner": 0.3}), Stack("high", {"ner": 0.5})]).collect()}
    assert got == {"low": 1.0, "high": 0.0}


def test_hosted_recognizers():
    have = ["OwnNerRecognizer", "EmailRecognizer", "CardRecognizer", "PhoneRecognizer"]
    assert stacks.Hosted("a", ("m",)).recognizers(have, []) == ["EmailRecognizer", "CardRecognizer", "PhoneRecognizer", "m"]
    assert stacks.Hosted("b", ("m",), patterns="cv", dropped=("PhoneRecognizer",)).recognizers(have, ["EmailRecognizer", "PhoneRecognizer"]) == ["EmailRecognizer", "m"]
    assert stacks.Hosted("c", ("m",), patterns="none", keep_ner=True).recognizers(have, []) == ["OwnNerRecognizer", "m"]


def test_language_routing_and_folding(spark):
    mark = lambda k: lambda docs: docs.select("doc_id", F.lit(k).alias("src"))
    docs = spark.createDataFrame([("a", "x", "de"), ("b", "x", "en"), ("c", "x", None), ("d", "x", "zz")], "doc_id string, text string, lang string")
    assert {(r.doc_id, r.src) for r in detectors.by_language({"en": mark("E"), "de": mark("D")})(docs).collect()} == {("a", "D"), ("b", "E"), ("c", "E"), ("d", "E")}
    df = spark.createDataFrame([("Chloé Brôwn",), (None,)], "t string")
    assert [r.x for r in df.select(textops.ascii_fold("t").alias("x")).collect()] == ["chloebrown", None]
