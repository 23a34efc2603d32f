import importlib
import json
import sys

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from cloakframe.operators import detectors, judge, scoring
from cloakframe.plans import experiments as ex
from cloakframe.plans import frames as fr
from cloakframe.plans import stacks
from cloakframe.sources import readers, writers
from cloakframe.streaming import masking


def test_banner_dump(spark, tmp_path):
    (tmp_path / "a.txt").write_text("=====\nCV-001 | Data Engineer \n=====\nJane Doe\njane@x.com\n\n\n=====\nCV-002 | Clerk\n=====\nBo\n=== not a banner\n")
    got = readers.banner_dump(spark, str(tmp_path / "a.txt")).orderBy("doc_id").collect()
    assert [(r.doc_id, r.title, r.text) for r in got] == [("CV-001", "Data Engineer", "Jane Doe\njane@x.com\n"), ("CV-002", "Clerk", "Bo\n=== not a banner\n")]


def test_records_and_specs(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text(json.dumps({"id": "d", "text": "Ada x", "gold": [{"start": 0, "end": 3, "label": "NAME", "required": None, "text": "Ada"}]}) + "\n\n")
    rows = readers.gold_rows(readers.records(spark, str(tmp_path / "a.jsonl"))).collect()
    assert [(r.doc_id, r.span_no, r.surface, r.required) for r in rows] == [("d", 1, "Ada", True)]
    (tmp_path / "s.json").write_text(json.dumps([{"id": "d", "lang": "en", "text": "Ada, Bo, Ada", "gold": [["Ada", "NAME", True, None], ["Bo", "NAME", False, 0], ["Ada", "ORG", True, 1]]}]))
    _, gold = readers.spec_records(spark, str(tmp_path / "s.json"))
    assert sorted((r.start_pos, r.label, r.required) for r in gold.collect()) == [(0, "NAME", True), (5, "NAME", False), (9, "NAME", True), (9, "ORG", True)]
    docs = spark.createDataFrame([("d", "Ada")], "doc_id string, text string")
    spec = spark.createDataFrame([("x", "Ada", "NAME", True, None)], "doc_id string, surface string, label string, required boolean, nth int")
    with pytest.raises(PySparkException, match="no document x"):
        readers.from_spec(docs, spec).count()
    both = readers.all_splits(a=docs, b=docs.withColumn("lang", F.lit("en")))
    assert {(r.split, r.lang) for r in both.collect()} == {("a", None), ("b", "en")}


def test_detector_caches(spark, tmp_path):
    assert readers.cache_name("a/b:c", "h2") == "a_b_c__h2"
    (tmp_path / "det__h2.json").write_text(json.dumps({"spans": {"d": [{"start": 0, "end": 3, "label": "NAME", "src": "m", "score": None}], "e": []}, "seconds": 1.0, "docs": 2}))
    assert [(r.doc_id, r.score, r.det) for r in readers.detector_cache(spark, str(tmp_path), "det", "h2").collect()] == [("d", 1.0, "det")]
    calls = []

    def run(docs):
        calls.append(sorted(r.doc_id for r in docs.collect()))
        return docs.select("doc_id", F.lit(0).alias("start_pos"), F.lit(1).alias("end_pos"), F.lit("NAME").alias("label"))

    store = str(tmp_path / "store")
    one = spark.createDataFrame([("d", "Ada")], "doc_id string, text string")
    two = spark.createDataFrame([("d", "Ada"), ("e", "Bo")], "doc_id string, text string")
    changed = spark.createDataFrame([("d", "New")], "doc_id string, text string")
    assert readers.cached_spans(spark, store, "x", "h2", one, run).count() == 1
    assert readers.cached_spans(spark, store, "x", "h2", two, run).count() == 2
    assert readers.cached_spans(spark, store, "x", "h2", changed, run).count() == 1
    assert calls == [["d"], ["e"], ["d"]]


def test_reply_files_and_keys(spark, tmp_path):
    (tmp_path / "abc.json").write_text(json.dumps({"out": '{"pii": []}'}))
    (tmp_path / "bad.json").write_text("no json")
    assert {(r.key, r.out) for r in readers.replies(spark, str(tmp_path)).collect()} == {("abc", '{"pii": []}'), ("bad", None)}
    import hashlib

    df = spark.createDataFrame([("k", "s", "ü", 5)], "key string, system string, user string, n int")
    assert df.select(judge.reply_key("key", "system", "user", "n").alias("x")).first().x == hashlib.md5(json.dumps(["k", "s", "ü", 5]).encode()).hexdigest()


def test_malformed_lines_are_shown(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"id": "d", "text": "x"}\n\n{"id": broken\n{"text": "no id"}\n')
    assert [r.id for r in readers.records(spark, str(tmp_path / "a.jsonl")).collect()] == ["d"]
    assert {r.line for r in readers.malformed(spark, str(tmp_path / "a.jsonl")).collect()} == {'{"id": broken', '{"text": "no id"}'}


def test_store_of_replies_is_written_through(spark, tmp_path):
    log = tmp_path / "log"
    log.mkdir()

    def load():
        def client(system, user, n):
            import uuid

            (log / uuid.uuid4().hex).write_text(user)
            if "Bo" in user:
                return "no json"
            if "Cy" in user:
                raise OSError("down")
            return 'Sure {"pii": [{"text": "Ada", "label": "NAME"}]}'

        return client

    docs = spark.createDataFrame([("a", "Ada"), ("b", "Ada"), ("c", "Bo"), ("d", "Cy"), ("e", None)], "doc_id string, text string")
    ask = lambda: {r.doc_id: r.out for r in judge.replied(judge.extraction_requests(docs), "m", load, str(tmp_path / "store")).collect()}
    first = ask()
    assert first["a"] == first["b"] and first["c"] == "no json" and first["d"] is None and "e" not in first
    sent = sum("Ada" in f.read_text() for f in log.iterdir())
    assert sent == 1 and ask()["a"] == first["a"] and sum("Ada" in f.read_text() for f in log.iterdir()) == 1 and sum("Bo" in f.read_text() for f in log.iterdir()) == 2
    spans = spark.createDataFrame([("a", 1, 0, 3, "NAME", "ner", "Ada", "Ada")], "doc_id string, span_id long, start_pos int, end_pos int, label string, src string, surface string, line string")
    asked = {r.doc_id: r.user for r in judge.judge_requests(docs, spans).collect()}
    assert asked["a"].endswith("CANDIDATES:\n0. [NAME] Ada | Ada") and asked["c"].endswith("CANDIDATES:\nnone") and "<<<\nBo\n>>>" in asked["c"]


def test_languages_of_documents(spark):
    texts = {"ENGLISH": "the plan of the team was made for the office", "GERMAN": "die Leiterin hat mit den Kollegen und der Firma", "FINNISH": "hän on ollut ja se oli myös hyvä", "SWEDISH": "jag har och att det är inte"}
    df = spark.createDataFrame([(k, t) for k, t in texts.items()] + [("none", ""), ("null", None)], "k string, text string")
    assert {r.k: r.l for r in df.select("k", detectors.detect_lang(F.col("text")).alias("l")).collect()} == {**{k: k for k in texts}, "none": "ENGLISH", "null": "ENGLISH"}


def test_adapters_and_hosted_results(spark):
    rows = spark.createDataFrame([("d", 0, 3, "PERSON", 0.9), ("d", 4, 9, "CARDINAL", 0.9), ("d", 4, 9, "GPE", 0.2), ("d", 10, 12, "ORG", None)], "doc_id string, start_pos int, end_pos int, label string, score double")
    assert {(r.start_pos, r.label, r.score) for r in detectors.adapted(rows, "tagger", "t", 0.5).collect()} == {(0, "NAME", 0.9), (10, "ORG", 1.0)}
    assert {r.score for r in detectors.adapted(rows, "tagger", "t", score=0.85).collect()} == {0.85}
    labels = spark.createDataFrame([("private_person",), ("firstname",), ("zipcode",), ("jobtitle",), ("weird",)], "label string")
    assert [r.x for r in labels.select(detectors.detector_label("filter", F.col("label")).alias("x")).collect()] == ["NAME", "NAME", "ADDRESS", "OTHER", "OTHER"]
    assert [r.x for r in labels.select(detectors.detector_label("engine", F.col("label")).alias("x")).collect()] == ["OTHER"] * 5
    found = spark.createDataFrame([("d", 0, 9, "NAME", "m", 0.5, "Ada Byrne", "Name: "), ("d", 0, 3, "NAME", "m", 0.4, "Ada", ""), ("d", 0, 9, "NAME", "m", 0.7, "Ada Byrne", ""), ("d", 20, 26, "NAME", "m", 0.9, "Python", ""), ("d", 5, 9, "URL", "m", 0.1, "Byrn", "")], "doc_id string, start_pos int, end_pos int, label string, src string, score double, surface string, before string")
    host = stacks.Hosted("h", ("m",), allowed=tuple(detectors.allow_list(["python"])), context=tuple(detectors.context_words()))
    assert {(r.start_pos, r.end_pos, r.label, round(r.score, 2)) for r in host.results(found).collect()} == {(0, 9, "NAME", 0.85), (5, 9, "URL", 0.1)}
    docs = spark.createDataFrame([("d", "word " * 30), ("e", "")], "doc_id string, text string")
    pieces = host.windows(docs).collect()
    assert [(r.start_pos, r.end_pos) for r in pieces] == [(0, 150)]
    small = detectors.char_windows(docs, 22, 7).collect()
    assert all(r.chunk.endswith(("word", "word ")) for r in small) and small[-1].end_pos == 150 and [r.start_pos for r in small][:3] == [0, 15, 30]


def test_union_sweep_and_timed_runs(spark, tmp_path):
    docs = spark.createDataFrame([("d", "devhard", "Ada met Bo")], "doc_id string, split string, text string")
    gold = spark.createDataFrame([("d", 1, 0, 3, "NAME", True, "Ada"), ("d", 2, 8, 10, "NAME", True, "Bo")], "doc_id string, span_no int, start_pos int, end_pos int, label string, required boolean, surface string")
    spans = spark.createDataFrame([("d", 1, 0, 3, "NAME", "a", 0.9, "a", "Ada"), ("d", 2, 8, 10, "NAME", "b", 0.8, "b", "Bo"), ("d", 3, 4, 7, "NAME", "c", 0.1, "c", "met")], "doc_id string, span_id long, start_pos int, end_pos int, label string, det string, score double, src string, surface string")
    partners = spark.createDataFrame([("a", 0.5), ("b", 0.5)], "det string, threshold double")
    got = ex.union_sweep(docs, gold, spans, "a", partners).collect()
    assert [(r.pair, r.req_hit, r.ents_leaked) for r in got] == [("b", 2, 0)]
    timed = stacks.timed_run(docs, gold, spans, detectors.Stack("s", {"a": 0.5}), str(tmp_path)).first()
    assert timed.sec_per_doc > 0 and timed.docs == 1
    with pytest.raises(ValueError, match="judge"):
        stacks.run_stack(docs, gold, spans, detectors.Stack("s", {"a": 0.5}, {}, {"mode": "full"}))


def test_union_sweep_runs_the_first_pass_once(spark):
    docs = spark.createDataFrame([("d", "devhard", "Ada met Bo")], "doc_id string, split string, text string")
    gold = spark.createDataFrame([("d", 1, 0, 3, "NAME", True, "Ada")], "doc_id string, span_no int, start_pos int, end_pos int, label string, required boolean, surface string")
    spans = spark.createDataFrame([("d", 1, 0, 3, "NAME", "a", 0.9), ("d", 2, 8, 10, "NAME", "b", None), ("d", 3, 4, 7, "NAME", "c", 0.1)], "doc_id string, span_id long, start_pos int, end_pos int, label string, det string, score double")
    seen = spark.sparkContext.accumulator(0)

    def tell(det):
        seen.add(1)
        return det

    told = F.udf(tell, "string").asNondeterministic()
    partners = spark.createDataFrame([("a", 0.5), ("b", 0.0), ("c", 0.5)], "det string, threshold double").coalesce(1).select(told("det").alias("det"), "threshold")
    got = sorted((r.pair, r.docs, r.pred, r.req_hit, r.fp) for r in ex.union_sweep(docs, gold, spans, "a", partners).collect())
    assert got == [("b", 1, 2, 1, 1), ("c", 1, 1, 1, 0)]
    assert seen.value == 3
    assert ex.union_sweep(docs, gold, spans, "a", partners.where("det = 'a'")).count() == 0


def test_sweep_needs_no_row_for_a_threshold(spark):
    docs = spark.createDataFrame([("d", "x", "Ada met Bo")], "doc_id string, split string, text string")
    gold = spark.createDataFrame([("d", 1, 0, 3, "NAME", True, "Ada")], "doc_id string, span_no int, start_pos int, end_pos int, label string, required boolean, surface string")
    spans = spark.createDataFrame(
        [("d", 1, 0, 3, "NAME", "a", 0.5), ("d", 2, 4, 7, "NAME", "a", None), ("d", 3, 8, 10, "NAME", "a", float("nan")), ("d", 4, 0, 10, "NAME", "b", -1.0), ("d", 5, 0, 10, "NAME", "z", 1.0)],
        "doc_id string, span_id long, start_pos int, end_pos int, label string, det string, score double",
    )
    swept = ex.sweep(docs, gold, spans, ["b", "a"], (0.9, 0.0, 0.5))
    assert sorted((r.det, r.threshold, r.docs, r.req, r.req_hit, r.pred) for r in swept.collect()) == [
        ("a", 0.0, 1, 1, 1, 3), ("a", 0.5, 1, 1, 1, 2), ("a", 0.9, 1, 1, 0, 1), ("b", 0.0, 1, 1, 0, 0), ("b", 0.5, 1, 1, 0, 0), ("b", 0.9, 1, 1, 0, 0),
    ]
    plan = swept._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan and "Window" not in plan


def test_partner_unions_sweeps_only_the_gate(spark, small, monkeypatch):
    from cloakframe.plans import pipeline_queries

    splits = []
    whole = ex.sweep
    monkeypatch.setattr(ex, "sweep", lambda docs, *more: (splits.extend(r.split for r in docs.select("split").distinct().collect()), whole(docs, *more))[1])
    got = pipeline_queries.partner_unions(spark, small)
    assert splits == ["devhard"]
    documents = fr.docs(spark, small)
    gold, spans = fr.gold(spark, small, documents), fr.spans(spark, small, documents)
    best = {r.det: r.threshold for r in ex.gated(whole(documents, gold, spans, fr.detectors(spark, small)), "devhard", 0.05).collect()}
    names = sorted(set(best) - {"tagger_l"})
    assert names
    own = [F.when((F.col("det") == d) & (F.coalesce("score", F.lit(0.0)) >= t), F.array(*map(F.lit, names if d == "tagger_l" else [d]))) for d, t in best.items()]
    mixed = spans.withColumn("pair", F.explode(F.coalesce(*own)))
    want = scoring.corpus_scores(scoring.doc_scores(documents, gold, mixed, [(n,) for n in names], ["pair"]), ["split", "pair"])
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_run_log_and_tables(spark, tmp_path):
    scores = spark.createDataFrame([(0.5, 3)], "f2 double, docs int")
    stack = {"name": "S1", "detectors": {"a": 0.4}, "cfg": {"vote_k": 2}}
    for split in ("h2", "h3"):
        writers.append_run(scores, str(tmp_path / "log"), stack, split, "g")
    rows = readers.run_log(spark, str(tmp_path / "log"), split="h2", group="g").collect()
    assert len(rows) == 1 and json.loads(rows[0].params) == {"det:a": 0.4, "vote_k": 2}
    assert readers.run_log(spark, str(tmp_path / "log"), group="other").count() == 0
    assert writers.markdown(scores) == "| f2 | docs |\n| --- | --- |\n| 0.500 | 3 |\n"
    assert writers.stack_digest(stack) == writers.stack_digest(dict(reversed(stack.items())))
    where = writers.stack_result(scores, scores, str(tmp_path), stack, "h2")
    assert spark.read.json(f"{where}/scores").count() == 1


def test_reply_parsing(spark):
    outs = ['{"pii": [{"text": "Ada", "label": "name"}, {"text": "x", "label": "NAME"}, {"text": "Bo Li", "label": "SKILL"}]}', 'Sure! {"pii": [{"text": "Ada", "label": "NAME"}]} done', "no braces", "", None, '{"pii": [3]}', "{broken"]
    docs = spark.createDataFrame([(str(n), "Ada and Bo Li, Ada") for n in range(len(outs))], "doc_id string, text string")
    found = judge.extracted(docs, spark.createDataFrame([(str(n), o) for n, o in enumerate(outs)], "doc_id string, out string")).collect()
    assert sorted((r.doc_id, r.start_pos, r.label) for r in found) == [("0", 0, "NAME"), ("0", 8, "OTHER"), ("0", 15, "NAME"), ("1", 0, "NAME"), ("1", 15, "NAME")]


def test_judge_modes(spark):
    docs = spark.createDataFrame([("d", "Ada met Bo and Cy")], "doc_id string, text string")
    rows = [("d", 1, 0, 3, "NAME", "ner", "Ada"), ("d", 2, 8, 10, "NAME", "ner", "Bo"), ("d", 3, 0, 3, "NAME", "re", "Ada"), ("d", 4, 0, 3, "PHONE", "ner", "Ada")]
    spans = spark.createDataFrame(rows, "doc_id string, span_id long, start_pos int, end_pos int, label string, src string, surface string")
    reply = spark.createDataFrame([("d", '{"decisions": {"0": "KEEP visible", "1": "mask"}, "missed": [{"text": "Cy", "label": "NAME"}]}')], "doc_id string, out string")

    def run(mode, **more):
        return sorted((r.surface, r.label, r.src) for r in judge.adjudicated(docs, spans, reply, mode, **more).collect())

    same = [("Ada", "NAME", "re"), ("Ada", "PHONE", "ner"), ("Bo", "NAME", "ner+adj")]
    assert run("full") == sorted([*same, ("Cy", "NAME", "re-llm-add")])
    assert run("drop_only") == sorted(same)
    assert run("add_only") == sorted([*same, ("Ada", "NAME", "ner+adj"), ("Cy", "NAME", "re-llm-add")])
    assert run("full", drop_labels=["URL"]) == run("add_only")
    assert len(run("none")) == 4
    lined = spans.withColumn("line", F.lit("Ada met Bo and Cy"))
    assert judge.questions(lined).first().question.split("\n") == ["0. [NAME] Ada | Ada met Bo and Cy", "1. [NAME] Bo | Ada met Bo and Cy"]


def test_ties(spark):
    runs = spark.createDataFrame([(1, "s", 0.9, 2.0, 1), (2, "s", 0.9, 2.0, 0), (3, "s", 0.9, 3.0, -1), (4, "t", None, None, 5)], "run_id long, stack string, f2 double, fp_per_doc double, log_order long")
    assert {(r.stack, r.run_id) for r in ex.best_per_stack(runs).collect()} == {("s", 2), ("t", 4)}
    assert [r.run_id for r in ex.top_runs(runs, 2).collect()] == [2, 1]
    swept = spark.createDataFrame([("h3", "a", 0.5, 0.9, 3), ("h3", "a", 0.3, 0.9, 3), ("h3", "a", 0.7, 0.9, 4), ("h2", "a", 0.9, 0.99, 0)], "split string, det string, threshold double, f2 double, leak_docs int")
    assert [r.threshold for r in ex.best_threshold(swept, "h3").collect()] == [0.3]
    assert ex.gated(swept, "h3", 0.95).count() == 0
    wanted = spark.createDataFrame([("s", "x"), ("s", "y")], "stack string, split string")
    assert [r.split for r in ex.unscored(spark.createDataFrame([("s", "x")], "stack string, split string"), wanted).collect()] == ["y"]
    df = spark.createDataFrame([('{"b": 1, "a": "x"}',), (None,), ("no",)], "params string")
    assert [r.x for r in df.select(ex.parameter_text().alias("x")).collect()] == ["a=x,b=1", "", ""]


def test_stream_masks_each_document_once(spark, tmp_path):
    source = tmp_path / "in"
    spark.createDataFrame([("d", "Ada Byrne\nada@x.example\n"), ("d", "Ada Byrne\nada@x.example\n"), ("e", None)], "doc_id string, text string").coalesce(1).write.parquet(str(source))
    stream = spark.readStream.schema("doc_id string, text string").parquet(str(source))
    query = masking.mask_stream(stream, str(tmp_path / "out"), str(tmp_path / "check"))
    query.awaitTermination(120)
    got = spark.read.parquet(str(tmp_path / "out")).collect()
    assert [(r.doc_id, r.masked) for r in got] == [("d", "[NAME]\n[EMAIL]\n")]


def test_entry_and_catalogue(spark, small):
    import __spark_entry__ as entry

    assert entry.entry(spark).limit(1).count() == 1
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_core_stands_without_the_subpackage(monkeypatch):
    for name in [m for m in sys.modules if m.startswith("cloakframe.llm") or m == "__spark_entry__"]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setitem(sys.modules, "cloakframe.llm", None)
    entry = importlib.import_module("__spark_entry__")
    assert entry.queries() and not any(n.startswith("p1_") for n in entry.queries())


SQL_SAMPLE = ["datasets_by_split", "doc_lines", "tokens_stripped", "line_sections", "email_spans", "merge_spans_islands", "vote_two_detectors", "covered_segments", "locate_all", "safety_net_spans", "masked_rule_spans", "corpus_scores", "stack_spans", "unified_labels"]


@pytest.mark.parametrize("name", SQL_SAMPLE)
def test_query_equals_its_sql(spark, small, name):
    duckdb = pytest.importorskip("duckdb")
    import glob
    import os

    from cloakframe.plans import catalogue

    con = duckdb.connect()
    for path in glob.glob(f"{small}/*.parquet"):
        con.execute(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
    result = con.execute(catalogue.oracle_sql()[name])
    names = [c[0] for c in result.description]
    df = catalogue.queries()[name](spark, small)
    assert sorted(names) == sorted(df.columns)
    clean = lambda rows: sorted(str([round(v, 5) if isinstance(v, float) else v for v in r]) for r in rows)
    assert clean(result.fetchall()) == clean(df.select(*names).collect())
