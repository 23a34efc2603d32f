import random
import re

import pytest
from pyspark.sql import functions as F

from cloakframe.functions import fixed, textops
from cloakframe.operators import rules, scoring

CV = "Ada Byrne | Test Engineer\nada.byrne@mail.example\nLeeds, UK\n\nWORK HISTORY\n2016 - 2019  Clerk, Acme Ltd\nEducation:\nBSc, University of Leeds, 2001\n## Skills\nPython, Java, SQL, Docker\n---\nAda Byrne"
ODD = "a b \U0001f600 x@y.z end\n\n\ttab 　q"


def rows(spark, texts, expression):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")
    return [r.x for r in df.select("i", expression(F.col("text")).alias("x")).orderBy("i").collect()]


@pytest.mark.parametrize("text", [CV, ODD, "", "one", "a\n", "\n\n"])
def test_lines_have_offsets(spark, text):
    found = rows(spark, [text], textops.line_array)[0]
    assert [x.line for x in found] == text.split("\n")
    assert all(text[x.start_pos : x.end_pos] == x.line for x in found)


def test_tokens_are_trimmed(spark):
    texts = ["Jane (Doe), jane@x.com | UK.", "", "...", ODD]
    for text, got in zip(texts, rows(spark, texts, textops.token_array)):
        want = []
        for m in re.finditer(r"\S+", text):
            core = m[0].strip(fixed.STRIP)
            if core:
                want.append((m.start() + m[0].index(core), core))
        assert [(t.start_pos, t.tok) for t in got] == want
        a, _, words = scoring.tokens(text)
        assert list(zip(a.tolist(), words)) == want


def test_null_text_gives_null(spark):
    df = spark.createDataFrame([(1, None)], "i int, text string")
    assert df.select(textops.line_array(F.col("text")).alias("x")).first().x is None


@pytest.mark.parametrize(
    "line,title",
    [("EXPERIENCE", True), ("Work Experience:", True), ("## Skills", True), ("Engineer at Acme Ltd", False), ("skills and " + "x" * 60, False), ("", False), ("Education in the north of a very wide land", False)],
)
def test_headings(spark, line, title):
    assert rows(spark, [line], textops.is_section_title) == [title]


def test_sections_are_carried_forward(spark):
    got = rows(spark, [CV], textops.sectioned_lines)[0]
    names = [x.section for x in got]
    assert names[:4] == ["header"] * 4
    assert names[4:6] == ["experience"] * 2
    assert names[6:8] == ["education"] * 2
    assert names[8:10] == ["skills"] * 2
    assert names[10:] == ["footer"] * 2


def test_long_texts_take_linear_time(spark):
    """A text of a megabyte: offsets and sections as in a walk over its lines."""
    text = "".join(f"line {n} of the text\n" if n % 1000 else "Skills:\n" for n in range(50_000))
    found = rows(spark, [text], textops.sectioned_lines)[0]
    assert len(text) > 1_000_000 and [x.line for x in found] == text.split("\n")
    assert all(text[x.start_pos : x.end_pos] == x.line for x in found[::997]) and {x.section for x in found} == {"skills"}
    assert len(rows(spark, [text], textops.token_array)[0]) == len(text.split())


def test_language_names_come_from_locale_data(spark):
    assert {"english", "deutsch", "englanti", "angielski", "svenska", "muttersprache"} <= {*textops.language_names()} and "leeds" not in textops.language_names()


@pytest.mark.parametrize("text,school", [("University of Leeds", True), ("Acme Ltd", False), ("MIT,", True), ("MITTENS", False), ("University Hospital", False)])
def test_schools(spark, text, school):
    assert rows(spark, [text], textops.is_edu) == [school]
    assert rules.is_edu(text) is school


def test_contact_lines_and_lists(spark):
    assert rows(spark, ["john@x.com | Leeds", "Tel: 0113 496", "Leeds, UK", "+44 20 7946 0000"], textops.is_contact_line) == [True, True, False, True]
    assert rows(spark, ["a, b, c, d", "a | b", "• a • b", "Leeds, UK"], textops.looks_like_list) == [True, False, True, False]


def test_places(spark):
    assert rows(spark, ["Leeds, UK", "Leeds", "Ukulele"], textops.is_location_line) == [True, False, False]
    assert rows(spark, ["Leeds", "Leeds is a very long line of prose"], lambda t: textops.is_location_line(t, ["Leeds"])) == [True, False]


def test_labels_are_unified(spark):
    assert rows(spark, ["person", "email address", "PHONE_NUMBER", "home street", "gpe", "DOB", "weird"], textops.unified_label) == ["NAME", "EMAIL", "PHONE", "ADDRESS", "LOCATION", "DOB", "OTHER"]


def test_match_offsets_are_code_points(spark):
    rng = random.Random(3)
    texts = ["".join(rng.choice("ab1é\U0001f600  \n") for _ in range(rng.randrange(40))) for _ in range(200)]
    for text, got in zip(texts, rows(spark, texts, lambda t: textops.matches(t, "[ab]+1?"))):
        assert [(m.start_pos, m.end_pos, m.text) for m in got] == [(*m.span(), m[0]) for m in re.finditer("[ab]+1?", text)]
    grouped = rows(spark, ["x=12 y=3"], lambda t: textops.matches(t, r"([a-z]=)(\d+)", group=True))[0]
    assert [(m.start_pos, m.text) for m in grouped] == [(2, "12"), (7, "3")]
