import random

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from cloakframe.operators import detectors, identity, scoring
from cloakframe.operators import spans as sp
from cloakframe.plans import pipeline

SCHEMA = "doc_id string, span_id long, start_pos int, end_pos int, label string, det string, src string, score double, surface string"


def table(spark, rows):
    return spark.createDataFrame([(d, n, a, b, k, det, "m", 0.5, "x") for n, (d, a, b, k, det) in enumerate(rows)], SCHEMA)


def random_rows(seed, docs=30, size=60):
    rng = random.Random(seed)
    out = []
    for d in range(docs):
        for _ in range(rng.randrange(9)):
            a = rng.randrange(size)
            out.append((f"d{d}", a, a + rng.randrange(1, 12), rng.choice("ABC"), rng.choice(["p", "q", "r"])))
    return out


def brute_merge(rows):
    out = {}
    for n, (d, a, b, k, _) in sorted(enumerate(rows), key=lambda x: (x[1][0], x[1][1], -x[1][2], x[0])):
        have = out.setdefault(d, [])
        if have and a <= have[-1][1]:
            have[-1][1] = max(have[-1][1], b)
        else:
            have.append([a, b, k])
    return {(d, *x) for d, v in out.items() for x in v}


def test_merge_equals_brute_force_both_ways(spark):
    rows = random_rows(1)
    df = table(spark, rows)
    got = {(r.doc_id, r.start_pos, r.end_pos, r.label) for r in sp.merge_spans(df).collect()}
    assert got == brute_merge(rows)
    arrays = df.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("span_id", "start_pos", "end_pos", "label"))).alias("spans")).withColumn("text", F.lit(""))
    inside = {(r.doc_id, i.start_pos, i.end_pos, i.label) for r in pipeline.islands(arrays).collect() for i in r.islands}
    assert inside == brute_merge(rows)


def test_touching_merges_a_gap_does_not(spark):
    got = sp.merge_spans(table(spark, [("d", 0, 3, "A", "p"), ("d", 3, 5, "B", "p"), ("d", 6, 8, "C", "p")])).orderBy("start_pos").collect()
    assert [(r.start_pos, r.end_pos, r.label, r.n_spans) for r in got] == [(0, 5, "A", 2), (6, 8, "C", 1)]


@pytest.mark.parametrize("k", [1, 2, 3])
def test_vote(spark, k):
    rows = random_rows(2, docs=12)
    got = {r.span_id for r in sp.vote(table(spark, rows), k).collect()}
    want = set()
    for n, (d, a, b, _, det) in enumerate(rows):
        others = {y[4] for y in rows if y[0] == d and y[4] != det and a < y[2] and y[1] < b}
        if k <= 1 or 1 + len(others) >= k:
            want.add(n)
    assert got == want


def test_vote_and_cover_across_buckets(spark):
    far = sp.BUCKET * 3
    df = table(spark, [("d", 5, far + 10, "A", "p"), ("d", far, far + 2, "B", "q"), ("d", far + 10, far + 12, "C", "r")])
    assert {r.span_id for r in sp.vote(df, 2).collect()} == {0, 1}
    assert {r.span_id for r in sp.covered(df.where("det = 'p'"), df.where("det = 'q'")).collect()} == {0}
    assert {r.span_id for r in sp.uncovered(df, df.where("det = 'q'")).collect()} == {2}


def test_mask(spark):
    df = spark.createDataFrame([("Ada Byrne, Leeds", [(0, 9, "NAME"), (11, 16, "LOCATION")]), ("plain", []), ("\U0001f600 x", [(0, 1, "ID")])], f"text string, i {sp.ISLANDS}")
    got = [r.m for r in df.select(sp.masked_text(F.col("text"), F.col("i")).alias("m")).collect()]
    assert got == ["[NAME], [LOCATION]", "plain", "[ID] x"]


def test_locate_all_is_literal(spark):
    rng = random.Random(4)
    docs, wanted = [], []
    for d in range(60):
        text = "".join(rng.choice("a.E\\Q\U0001f600") for _ in range(30))
        docs.append((f"d{d}", text))
        at = rng.randrange(28)
        wanted.append((f"d{d}", text[at : at + 2], "X"))
    got = sp.locate_all(spark.createDataFrame(docs, "doc_id string, text string"), spark.createDataFrame(wanted, "doc_id string, surface string, label string"))
    want = []
    for (d, text), (_, s, _) in zip(docs, wanted):
        at = text.find(s)
        while at >= 0:
            want.append((d, s, at, at + len(s)))
            at = text.find(s, at + len(s))
    assert sorted((r.doc_id, r.surface, r.start_pos, r.end_pos) for r in got.collect()) == sorted(want)


def test_nth_and_missing_surfaces(spark):
    docs = spark.createDataFrame([("d", "ab ab ab")], "doc_id string, text string")
    one = spark.createDataFrame([("d", "ab", "X", 1)], "doc_id string, surface string, label string, nth int")
    assert [r.start_pos for r in sp.locate_all(docs, one).collect()] == [3]
    none = spark.createDataFrame([("d", "zz", "X")], "doc_id string, surface string, label string")
    assert sp.locate_all(docs, none).count() == 0
    with pytest.raises(PySparkException, match="surface not found"):
        sp.locate_all(docs, none, strict=True).count()


def test_safety_net(spark):
    docs = spark.createDataFrame([("d", "UCL x UCL, Ada, ada@x.io and ada@x.io; ADA@X.IO Leeds Leeds")], "doc_id string, text string")
    rows = [("d", 0, 0, 3, "EDU_ORG", "p", "re", 1.0, "UCL"), ("d", 1, 11, 14, "NAME", "p", "re", 1.0, "Ada"), ("d", 2, 16, 24, "EMAIL", "p", "re", 1.0, " ada@x.io "), ("d", 3, 16, 24, "URL", "p", "re", 1.0, "ada@x.io"), ("d", 4, 40, 45, "LOCATION", "p", "re", 1.0, "Leeds")]
    got = sorted((r.start_pos, r.label) for r in identity.safety_net(docs, spark.createDataFrame(rows, SCHEMA)).collect())
    assert got == [(0, "EDU_ORG"), (6, "EDU_ORG"), (16, "EMAIL"), (29, "EMAIL")]


def paint(n, spans):
    cells = [0] * n
    for a, b in spans:
        for i in range(max(0, a), min(n, b)):
            cells[i] = 1
    return cells


def test_scores_equal_character_painting(spark):
    rng = random.Random(5)
    docs, gold, pred = [], [], []
    for d in range(60):
        text = " ".join("".join(rng.choice("abc.,") for _ in range(rng.randrange(1, 7))) for _ in range(rng.randrange(0, 15)))
        docs.append((f"d{d}", "s", text))
        for kind in (gold, pred):
            for _ in range(rng.randrange(4) if text else 0):
                a = rng.randrange(len(text))
                b = min(len(text), a + rng.randrange(1, 9))
                kind.append((f"d{d}", len(kind), a, b, "NAME", rng.random() < 0.7, text[a:b]))
    gdf = spark.createDataFrame(gold, "doc_id string, span_no int, start_pos int, end_pos int, label string, required boolean, surface string")
    pdf = spark.createDataFrame([(d, "p", a, b, k, n) for d, n, a, b, k, _, _ in pred], "doc_id string, det string, start_pos int, end_pos int, label string, span_id long")
    ddf = spark.createDataFrame(docs, "doc_id string, split string, text string")
    got = {(r.doc_id, r.det): r for r in scoring.doc_scores(ddf, gdf, pdf, [("p",), ("none",)]).collect()}
    assert len(got) == 120
    for d, _, text in docs:
        g = [x for x in gold if x[0] == d]
        req, some = paint(len(text), [x[2:4] for x in g if x[5]]), paint(len(text), [x[2:4] for x in g])
        for det in ("p", "none"):
            p = paint(len(text), [x[2:4] for x in pred if x[0] == d] if det == "p" else [])
            starts, ends, words = scoring.tokens(text)
            flags = [(sum(req[a:b]) * 2 >= b - a, sum(some[a:b]) * 2 >= b - a, sum(p[a:b]) * 2 >= b - a) for a, b in zip(starts, ends)]
            r = got[d, det]
            assert (r.req, r.req_hit, r.pred, r.pred_ok) == (sum(f[0] for f in flags), sum(f[0] and f[2] for f in flags), sum(f[2] for f in flags), sum(f[2] and f[1] for f in flags))
            assert r.fp_tokens == [w for w, f in zip(words, flags) if f[2] and not f[1]]


_SIGNS = "aB7é€😀İ\u0130·—–|()[]{}.,;:!?'\"<> \t\n\x0b\x1c\x1f\x85\xa0\u1680\u2003\u2028\u3000\u200b\ufeff"


def test_tallies_equal_scores_by_document(spark):
    rng = random.Random(9)
    docs, gold, pred = [], [], []
    words = ["the", "nées", "née", "Née", "–", "Ada", "İd", "(old)", "of,", "..", "x😀y", "7", "|", "\u200b"]
    for d in range(80):
        text = "".join(rng.choice(words) + rng.choice([" ", "  ", "\n", "\u2003", "\x1f", ""]) for _ in range(rng.randrange(14))) if d % 9 else ""
        docs.append((f"d{d}", rng.choice(["s", "t", None]), text))
        for k in range(rng.randrange(6)):
            a = rng.randrange(-4, len(text) + 6)
            gold.append((f"d{d}", k, a, a + rng.randrange(-9, 14), rng.random() < 0.7))
        for _ in range(rng.randrange(9)):
            a = rng.randrange(-4, len(text) + 6)
            pred.append((f"d{d}", len(pred), a, a + rng.randrange(-9, 14), rng.randrange(5), rng.randrange(5)))
    gold.append(("none", 1, 0, 3, True))
    pred += [("none", -1, 0, 3, 0, 4), ("d1", -2, None, 3, 0, 4), ("d1", -3, 0, None, 0, 4), (None, -4, 0, 3, 0, 4)]
    ddf = spark.createDataFrame(docs, "doc_id string, split string, text string")
    gdf = spark.createDataFrame(gold, "doc_id string, span_no int, start_pos int, end_pos int, required boolean")
    pdf = spark.createDataFrame(pred, "doc_id string, span_id long, start_pos int, end_pos int, low int, high int")
    cut = lambda df: df.join(ddf.select("doc_id", F.length("text").alias("n")), "doc_id").selectExpr("*", "greatest(0, least(start_pos, end_pos)) as a", "least(n, greatest(start_pos, end_pos)) as b").where("start_pos is not null and end_pos is not null and a < b").drop("n", "start_pos", "end_pos").withColumnsRenamed({"a": "start_pos", "b": "end_pos"})
    each = cut(pdf).where("low < high").withColumn("det", F.explode(F.expr("cast(sequence(low, high - 1) as array<string>)"))).withColumn("label", F.lit("NAME"))
    grid = [(str(k),) for k in range(5)]
    want = scoring.corpus_scores(scoring.doc_scores(ddf, cut(gdf).withColumns({"label": F.lit("NAME"), "surface": F.lit("x")}), each, grid), ["split", "det"])
    got = scoring.ratios(scoring.tallies(ddf, gdf, pdf, grid), ["split", "det"])
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect())) and got.count() == 15
    assert scoring.tallies(ddf, gdf, pdf, []).count() == 0
    total = scoring.tallies(ddf, gdf.limit(0), pdf.limit(0), grid).where("split = 's'").first()
    assert (total.docs, total.req, total.pred, total.ents, total.leak_docs) == (sum(s == "s" for _, s, _ in docs), 0, 0, 0, 0)


def test_tokens_of_many_texts_at_once():
    rng = random.Random(3)
    texts = ["", "".join(map(chr, range(1, 0xD800))), *("".join(rng.choice(_SIGNS) for _ in range(rng.randrange(30))) for _ in range(400)), ""]
    base = np.cumsum([0, *map(len, texts)])
    starts, ends = scoring.token_bounds(np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32), base[:-1])
    assert [*zip(starts.tolist(), ends.tolist())] == [(a + n, b + n) for t, n in zip(texts, base.tolist()) for a, b, _ in zip(*scoring.tokens(t))]
    none = scoring.token_bounds(np.zeros(0, np.uint32), np.array([0, 0]))
    assert [len(x) for x in none] == [0, 0]


@pytest.mark.parametrize("pairs", [1, 7, 1 << 21])
def test_hits_equal_half_covered(monkeypatch, pairs):
    monkeypatch.setattr(scoring, "PAIRS", pairs)
    rng = np.random.default_rng(4)
    edges = np.sort(rng.choice(500, 160, replace=False))
    starts, ends = edges[::2], edges[1::2]
    points, a = rng.integers(0, 6, 90) * 2, rng.integers(0, 480, 90)
    b = a + rng.integers(1, 20, 90)
    got = {(p, t) for ps, ts in scoring._hits(scoring._disjoint(points, a, b, 501), starts, ends) for p, t in zip(ps.tolist(), ts.tolist())}
    want = {(p, t) for p in range(12) for t in np.flatnonzero(scoring.half_covered(starts, ends, scoring.merged([*zip(a[points == p].tolist(), b[points == p].tolist())]))).tolist()}
    assert got == want and len(want) > 50


def test_worked_score(spark):
    text = "Jane Doe\njane@x.com\nPython\n"
    docs = spark.createDataFrame([("d", "s", text), ("e", "s", "")], "doc_id string, split string, text string")
    gold = spark.createDataFrame([("d", 1, 0, 8, "NAME", True, "Jane Doe"), ("d", 2, 9, 19, "EMAIL", True, "jane@x.com")], "doc_id string, span_no int, start_pos int, end_pos int, label string, required boolean, surface string")
    pred = spark.createDataFrame([("d", "p", 0, 4, "NAME", 1), ("d", "p", 20, 26, "NAME", 2)], "doc_id string, det string, start_pos int, end_pos int, label string, span_id long")
    scores = scoring.doc_scores(docs, gold, pred, [("p",)])
    r = {x.doc_id: x for x in scores.collect()}["d"]
    assert (r.req, r.req_hit, r.pred, r.pred_ok, r.ents, r.ents_leaked) == (3, 1, 2, 1, 2, 2)
    assert [(x.label, x.visible) for x in r.leaks] == [("NAME", ["Doe"]), ("EMAIL", ["jane@x.com"])] and r.fp_tokens == ["Python"]
    total = scoring.corpus_scores(scores, ["split"]).first()
    assert (total.docs, total.leak_docs, total.fp, total.token_recall, total.token_precision) == (2, 1, 1, round(1 / 3, 6), 0.5)


def test_nothing_to_find_scores_one(spark):
    docs = spark.createDataFrame([("d", "s", "plain words")], "doc_id string, split string, text string")
    gold = spark.createDataFrame([], "doc_id string, span_no int, start_pos int, end_pos int, label string, required boolean, surface string")
    pred = spark.createDataFrame([], "doc_id string, det string, start_pos int, end_pos int, label string, span_id long")
    r = scoring.corpus_scores(scoring.doc_scores(docs, gold, pred, [("p",)]), ["split"]).first()
    assert (r.token_recall, r.token_precision, r.entity_recall, r.fp_per_doc, r.f2) == (1.0, 1.0, 1.0, 0.0, 1.0)


def test_chunks_pack_whole_lines(spark):
    text = "aaaa\nbb\ncccccccccc\nd\n\ne"
    docs = spark.createDataFrame([("d", text), ("n", None), ("z", "")], "doc_id string, text string")
    got = [(r.start_pos, r.chunk) for r in detectors.chunks(docs, 8).where("doc_id = 'd'").orderBy("chunk_no").collect()]
    assert [c for _, c in got] == ["aaaa\nbb\n", "cccccccccc\n", "d\n\ne"] and all(text[a : a + len(c)] == c for a, c in got)
    windows = detectors.line_windows(docs.where("doc_id = 'd'"), 8, 1).orderBy("chunk_no").collect()
    assert "".join(w.chunk for w in windows).count("cc") and windows[-1].end_pos == len(text)


def test_plug_in_detector_runs_on_chunks(spark):
    detectors.register("caps")(lambda: detectors.plug_in(lambda: lambda t: [(i, i + 1, "NAME", 0.9) for i, c in enumerate(t) if c.isupper()], "caps"))
    docs = spark.createDataFrame([("d", "aB\ncD\nE"), ("n", None)], "doc_id string, text string")
    found = detectors.by_chunks(detectors.detector("caps"), 3)(docs).collect()
    assert sorted(r.start_pos for r in found) == [1, 4, 6]


def test_token_decoding(spark):
    rows = [("d", 0, 2, {"O": 0.1, "A": 0.6, "B": 0.3}), ("d", 3, 5, {"O": 0.3, "A": 0.7}), ("d", 6, 8, {"O": 0.9, "A": 0.1}), ("d", 9, 10, {"O": 0.2, "B": 0.8})]
    got = detectors.decode_tokens(spark.createDataFrame(rows, "doc_id string, start_pos int, end_pos int, probs map<string,double>"), 0.5).orderBy("start_pos").collect()
    assert [(r.start_pos, r.end_pos, r.label, round(r.score, 6)) for r in got] == [(0, 5, "A", 0.7), (9, 10, "B", 0.8)]
