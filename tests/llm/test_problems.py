"""Each operator: its result on a clear case, against brute force where there is one, and on odd input."""

import pathlib
import random
import unicodedata

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from cloakframe.llm import canonical, langid, leakage, lookalikes, mixing, overlap, privacy, prose, reading, splitting
from cloakframe.llm.boosting import BoostedTrees

EN = "The engineer led the new warehouse plan and wrote the manual that every branch still prints. "
DE = "Die Leiterin plante den neuen Einkauf und verantwortete die Übergabe der Akten mit den Kolleginnen. "
ES = "Dirigí el traslado del taller con los compañeros y reduje el atraso antes de acabar el año. "


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


# ---- shared text handling


def test_comparable_words():
    assert lookalikes.comparable_words("Ｐrofile wеb-рοst, Tarncliﬀ! B​O day’s DAY'S") == ["profile", "web", "post", "tarncliff", "bo", "days", "days"]
    assert lookalikes.comparable_words("") == []


def test_prose_positions_and_kinds():
    text = "WORK HISTORY\n• Led the small team​ of nine people in Leeds.\nPython, Java, SQL, Docker, Spark\n\nmail ada@x.io or ring me at any hour today\n\nThis is a hard-wrapped sentence that goes on\nover the line end. And here comes another one."
    found = prose.prose_sentences(text)
    assert [" ".join(w) for _, _, w in found] == ["Led the small team of nine people in Leeds", "This is a hard-wrapped sentence that goes on over the line end", "And here comes another one"]
    assert text[found[0][0] : found[0][1]].startswith("Led the") and text[found[2][0] : found[2][1]] == "And here comes another one."
    assert prose.prose_sentences("") == []


# ---- 1: language


@pytest.fixture(scope="module")
def profiles():
    return langid.fit_profiles([("en", EN * 3), ("de", DE * 3), ("es", ES * 3), ("en", DE)])


def test_cosine_table_equals_explicit_vectors(profiles):
    words = EN.split()
    counts = langid.trigram_counts([words])
    vector = langid.bundle(counts, langid.letter_vectors())
    dots, norms = profiles.dots([words])
    assert np.allclose(dots[0], profiles.prototypes @ vector, rtol=1e-2, atol=2.0)
    assert abs(norms[0] / np.linalg.norm(vector) - 1) < 0.1


def test_languages_and_stretches(spark, profiles):
    rows = [("a", EN * 3, "en"), ("b", EN * 3 + "\n" + DE * 3, "eng"), ("c", ES * 3, None), ("d", None, "en"), ("e", "", "en"), ("f", DE * 3, "English"), ("g", "Python, Java", "xx"), ("a", EN * 3, "en"), (None, EN * 3, "de")]
    df = frame(spark, [(*r, 1) for r in rows], "id string, text string, lang string, stretch_no int")
    got = {(r.id, r.lang, r.label) for r in langid.record_languages(df, profiles).collect()}
    assert got == {("a", "en", "en"), ("b", "en", "en"), ("b", "de", "en"), ("c", "es", None), ("f", "de", "en")}
    parts = langid.identify(df.where("id = 'b'"), profiles).orderBy("stretch_no").collect()
    assert [p.lang for p in parts] == ["en", "de"] and parts[0].end_pos <= parts[1].start_pos and all(0.5 < p.confidence <= 1 for p in parts)


def test_three_languages_and_no_prose(spark, profiles):
    rows = [("t", EN * 5 + "\n" + DE * 4 + "\n" + ES * 3), ("n", "Data Engineer\nLeeds"), ("z", "12 / 34"), ("s", EN * 9 + "\nHauptstrasse Berlin Kiel")]
    got = {}
    for r in langid.identify(frame(spark, rows, "id string, text string"), profiles).collect():
        got.setdefault(r.id, []).append((r.lang, r.n_words > 0, r.confidence))
    assert [x[0] for x in got["t"]] == ["en", "de", "es"] and [x[0] for x in got["s"]] == ["en"]
    assert len(got["n"]) == 1 and not got["n"][0][1] and 0 < got["n"][0][2] <= 0.5 and got["z"] == [(None, False, 0.0)]
    df = frame(spark, [(i, t, "en") for i, t in rows], "id string, text string, lang string")
    assert {(r.id, r.lang) for r in langid.record_languages(df, profiles).collect()} == {("t", "en"), ("t", "de"), ("t", "es"), ("s", "en")}


def test_language_of_a_very_long_text_and_of_none(spark, profiles):
    df = frame(spark, [("x", (EN + "\n\n") * 2000)], "id string, text string")
    assert [r.lang for r in langid.identify(df, profiles).collect()] == ["en"]
    assert langid.identify(df.limit(0), profiles).count() == 0


def test_labels_in_many_notations(spark):
    df = frame(spark, [("en",), ("EN-gb",), (" deu ",), ("Dutch",), ("pt_BR",), ("und",), ("",), (None,), ("xx",)], "l string")
    assert [r.x for r in df.select(langid.named_language(F.col("l")).alias("x")).collect()] == ["en", "en", "de", "nl", "pt", None, None, None, None]


def test_held_out_sentences_of_the_seeds():
    known = langid.fit_profiles([])
    texts = {"en": EN, "de": DE, "es": ES, "fr": "Les gens de la ville ont demandé une nouvelle place pour le marché.", "fi": "Hän työskentelee kaupungin varastossa ja johtaa uutta osastoa.", "pl": "Pracuje w magazynie i kieruje nowym działem firmy."}
    dots, _ = known.dots([t.split() for t in texts.values()])
    assert [langid.LANGUAGES[k] for k in dots.argmax(1)] == list(texts)


# ---- 2: one form


CASES = [
    ("plain", "plain", False), ("Ｐｒofile", "Profile", True), ("wеbрοst", "webpost", True), ("Нижній Брід", "Нижній Брід", False), ("a b", "a b", True),
    ("été", "été", True), ("Tarncliﬀ", "Tarncliff", True), ("B​O", "BO", True), ("“q” – • … œuvre", "“q” – • … œuvre", False), (None, None, False),
    ("", "", False), ("Παλιά", "Παλιά", False), ("tab\tx\r\ny  z", "tab\tx\r\ny  z", False), ("𝐓𝐫𝐢", "Tri", True), ("青柳台", "青柳台", False), ("﻿", "", True), ("it's", "it's", False),
]


def test_canonical_form(spark):
    df = frame(spark, [(f"d{n}", n, a, True) for n, (a, _, _) in enumerate(CASES)], "k string, n int, t string, changed boolean")
    got = {r.n: (r.canonical, r.changed) for r in canonical.canonical_text(df, "k", "n", "t").collect()}
    assert got == {n: (b, c) for n, (_, b, c) in enumerate(CASES)}


def test_canonical_form_is_stable(spark):
    rng = random.Random(1)
    letters = "abc éе́οА​Ａ ﬁЖ"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randrange(30))) for _ in range(200)] + ["x" * 300_000 + "е"]
    df = frame(spark, [("d", n, t) for n, t in enumerate(texts)], "k string, n int, t string")
    once = canonical.canonical_text(df, "k", "n", "t")
    rows = once.collect()
    twice = canonical.canonical_text(once, "k", "n", "canonical").where("changed").count()
    assert twice == 0 and all(unicodedata.normalize("NFC", r.canonical) == r.canonical for r in rows)
    assert all((r.canonical != texts[r.n]) == r.changed for r in rows)


def test_changed_surfaces(spark):
    records = frame(spark, [("a", "x y", 0), ("a", "x y", 0), ("b", "xy", 0), (None, "x y", 0)], "id string, text string, span_no int")
    gold = frame(spark, [("a", 1, "е-mail"), ("a", 2, "wеb"), ("a", 2, "wеb"), ("b", None, "wеb")], "doc_id string, span_no int, text string")
    assert {(r.doc_id, r.span_no) for r in canonical.changed_surfaces(records, gold).collect()} == {("a", 0), ("a", 2)}
    assert canonical.changed_surfaces(records.limit(0), gold.limit(0)).count() == 0


def test_canonical_query_covers_both_tables(spark, tmp_path):
    from cloakframe.llm import queries

    frame(spark, [("a", "x\u00a0y"), ("a", "x\u00a0y"), ("b", "xy"), ("c", None), (None, "x")], "id string, text string").write.parquet(f"{tmp_path}/datasets.parquet")
    frame(spark, [("a", 1, "е-mail"), ("a", 2, "wеb"), ("a", 2, "wеb"), (None, 1, "x")], "doc_id string, span_no int, text string").write.parquet(f"{tmp_path}/gold.parquet")
    got = sorted(queries.p2_canonical(spark, str(tmp_path)).collect())
    assert [(*r,) for r in got] == [("a", 0, "x y", True), ("a", 1, "е-mail", False), ("a", 2, "web", True), ("b", 0, "xy", False), ("c", 0, None, False)]


# ---- 3: pieces


def pieces(spark, rows, limits):
    df = frame(spark, [(*r, 7) for r in rows], "id string, split string, text string, max_chars int")
    return splitting.split_texts(df, frame(spark, limits, "split string, max_chars int, overlap_chars int"))


def test_pieces_round_trip(spark):
    rng = random.Random(2)
    rows = []
    for n in range(60):
        words = ["".join(rng.choice("ab\U0001f600é") for _ in range(rng.randrange(1, 40))) for _ in range(rng.randrange(1, 60))]
        rows.append((f"DEV-{n}", rng.choice(["dev", "DEVSYNTH", None]), "".join(w + rng.choice([" ", ". ", "\n", "\n\n", ", "]) for w in words)))
    got = {r.id: r for r in pieces(spark, rows, [("devsynth", 50, 10)]).collect()}
    for key, _, text in rows:
        if len(text) <= 50:
            assert key not in got
            continue
        r = got[key]
        assert r.pieces[0].start_pos == 0 and r.pieces[-1].end_pos == len(text)
        for p, q in zip(r.pieces, r.pieces[1:]):
            assert q.start_pos == p.end_pos - 10
        for p in r.pieces:
            assert p.piece == text[p.start_pos : p.end_pos] and 0 < len(p.piece) <= 50
        assert r.longest_unbroken == max(map(len, text.split()))


def test_strongest_boundary_wins(spark):
    text = "First line here. Second part\n\nNew paragraph begins, and goes on. It ends somewhere far away"
    r = pieces(spark, [("H2-1", "h2", text)], [("holdout", 50, 5)]).first()
    assert text[: r.pieces[0].end_pos].endswith("\n\n")


def test_forced_and_natural(spark):
    rows = [("DEV-1", "dev", "x" * 120), ("DEV-2", "dev", "ab " * 60), ("DEV-3", "dev", "short"), ("DEV-4", "dev", None), ("DEV-5", "nowhere", "x" * 120), ("DEV-1", "dev", "x" * 120), ("DEV-6", "dev", "")]
    limits = [("devsynth", 100, 20), ("devsynth", 100, 20), (None, 5, 1), ("bad", None, None)]
    got = splitting.oversized(pieces(spark, rows, limits)).collect()
    assert sorted((r.id, r.cut) for r in got) == [("DEV-1", "forced"), ("DEV-2", "natural")]
    assert pieces(spark, rows, []).count() == 0
    wide = pieces(spark, [("DEV-1", "dev", "x" * 30)], [("devsynth", 10, 99)]).first()
    assert wide.overlap_chars == 9 and len(wide.pieces) >= 20


# ---- 4: personal data


RECORD = "Corra Ashby | Lab Technician\n+44 82 851 1508 / corra.ashby [at] home [dot] example / Flat 3, 104 Marshaw Road\nStaff number: 83/620/63820\n\nI am Corra Ashby, and I have 3 years behind me.\nPassport no.: #2236634\n2004–2009, Lab Technician, Ashby & Sons\n• Led the Marlin rollout in 05/2009 and 9 313 567 EUR\nAshby, C. (2011): Marlin / Tribaly, 3(2), 61–105.\nReferees\nMr Holdan Wick, Ashby Ltd, holdan@inbox. test\nPlaza Alda 4, piso 2 or ul. Lipowa 5/7 or Hauptstraße 12a"


def test_items_of_a_record():
    got = [(RECORD[a:b], k) for a, b, k in privacy.detect(RECORD)]
    assert got == [
        ("Corra Ashby", "NAME"), ("+44 82 851 1508", "PHONE"), ("corra.ashby [at] home [dot] example", "EMAIL"), ("Flat 3, 104 Marshaw Road", "ADDRESS"), ("83/620/63820", "ID"),
        ("Corra Ashby", "NAME"), ("#2236634", "ID"), ("Ashby, C.", "NAME"), ("Holdan Wick", "NAME"), ("holdan@inbox. test", "EMAIL"),
        ("Plaza Alda 4, piso 2", "ADDRESS"), ("ul. Lipowa 5/7", "ADDRESS"), ("Hauptstraße 12a", "ADDRESS"),
    ]


def test_offsets_are_of_the_given_text():
    text = "Cor​ra Ashby | Clerk\ncorra​@mail.example﻿, x"
    assert [text[a:b] for a, b, _ in privacy.detect(text)] == ["Cor​ra Ashby", "corra​@mail.example"]
    assert privacy.detect(None) == [] and privacy.detect("") == [] and privacy.detect("No data here at all.") == []


def test_repeated_names_with_other_spacing():
    for odd in ("", " \u0130stanbul"):
        text = f"Corra Ashby | Clerk\n\nThe plan of{odd}   Corra\nAshby was kept,  and so\n\n was CORRA  Ashby's and Corra Ashby's desk. Not Corra\u2003   \nAshby."
        assert [text[a:b] for a, b, _ in privacy.detect(text)] == ["Corra Ashby", "Corra\nAshby", "CORRA  Ashby", "Corra Ashby"]


def test_long_author_lists():
    authors = [f"{x}ordan, {x}." for x in "ABCDFGHJKLMNP"]
    text = "\n\nPapers\n\nTexts\n" + ", ".join(authors) + " (2011): Marlin, 3(2), 61–105."
    assert [text[a:b] for a, b, _ in privacy.detect(text)] == authors


def test_placeholders_and_surrogates():
    spans = privacy.detect(RECORD)
    plain, fake = privacy.masked(RECORD, spans, b"key", "r1")
    assert plain.startswith("[NAME_1] | Lab Technician\n[PHONE_1]") and "[NAME_1] (2011)" in plain and "Mr [NAME_2], Ashby Ltd" in plain and "Ashby & Sons" in plain
    again = privacy.masked(RECORD, spans, b"key", "r1")[1]
    other = privacy.masked(RECORD, spans, b"other", "r1")[1]
    assert fake == again and fake != other
    first, last = fake.split(" |")[0].split(" ")
    assert f"I am {first} {last}," in fake and f"{last}, {first[0]}. (2011)" in fake
    assert fake.count("+44 ") == 1 and "/620/" not in fake and "corra" not in fake


def test_surrogates_stay_distinct():
    made = privacy.Surrogates(b"k", "r")
    names = [made.name(f"Nam{chr(97 + i)}a Sur{chr(97 + i)}x", "") for i in range(26)]
    assert len(set(names)) == 26 and len({made.formatted("PHONE", f"+44 20 555 {i:04d}") for i in range(50)}) == 50
    assert made.name("NAMAA SURAX", "") == names[0].upper()


def test_surrogates_keep_script_gender_format_and_coreference():
    made = privacy.Surrogates(b"k", "r")
    cyrillic = made.name("Иван Петров", "")
    assert cyrillic.istitle() and all("А" <= c <= "я" or c in " ёЁѐёђѓєѕіїјљњћќѝўџ" or 0x400 <= ord(c) <= 0x52F for c in cyrillic) and cyrillic != "Иван Петров" and made.name("ПЕТРОВ", "") == cyrillic.split()[1].upper()
    assert made.name("Maria Keller", "Frau ").split()[0] in made.FEMALE and made.name("Luca Rossi", "").split()[0] in made.MALE and made.name("Karin Holt", "Herr ").split()[0] in made.MALE
    given, last = made.name("Maria Keller", "Frau ").lower().split()
    assert made.email("m.keller@keller-family.example") == f"{given[0]}.{last}@{last}-" + made.email("m.keller@keller-family.example").split("-")[1]
    assert "family" not in made.email("m.keller@keller-family.example") and made.email("m.keller@keller-family.example").endswith(".example")
    spelled = made.email("m.keller [at] keller-family [dot] example")
    assert privacy.canonical("EMAIL", spelled) == privacy.canonical("EMAIL", made.email("m.keller@keller-family.example")) and " [at] " in spelled
    assert len({made.email(f"{c}{d}@mail.example") for c in "abcdefgh" for d in "xyz1"}) == 32
    assert len({made.name(f"Ab{chr(97 + k // 26)}{chr(97 + k % 26)} Holt", "") for k in range(600)}) == 600
    assert made.formatted("PHONE", "+44 20 7946 0000").startswith("+44 ") and privacy.shape(made.formatted("ID", "AB 12-3c")) == "AA 99-9a"
    wide = privacy.Surrogates(b"k", None)
    assert wide.name("Ada Byrne", "") == privacy.Surrogates(b"k", None).name("Ada Byrne", "") and wide.name("Ada Byrne", "") != privacy.Surrogates(b"k", "r2").name("Ada Byrne", "")


def test_names_of_other_scripts_are_found():
    text = "\n\nx\n\nMy name is Иван Петров and I write.\n"
    assert [text[a:b] for a, b, _ in privacy.detect(text)] == ["Иван Петров"]


def test_leak_texts():
    names = {"lorley ashhurst"}
    cases = [("still there: 151 bis, impasse Pontgeais)", None, "151 bis, impasse Pontgeais"), ("seen as +49 53 555 0153, page 2", "PHONE", "+49 53 555 0153"), ("(Lorley Ashhurst again", None, "Lorley Ashhurst"), ("line: L. Pennhurst, page 2", "NAME", "L. Pennhurst"), ("Wendwell", "LOCATION", None), ("Somebody Else", None, None), (None, "NAME", None), ("", None, None)]
    for text, label, want in cases:
        found = privacy.detect_leak(text, label, names)
        assert (text[found[0] : found[1]] if found else None) == want


def test_all_items(spark):
    records = frame(spark, [("H2-1", RECORD, 1), ("H2-1", RECORD, 2), ("H2-2", None, 1), (None, RECORD, 1), ("H2-3", "", 1)], "id string, text string, item_no int")
    leak = "array<struct<label:string,text:string,visible:array<string>>>"
    errors = frame(spark, [("H2-1", [(None, "seen as Corra Ashby", None), ("EDU_ORG", "Some College", None)]), ("H2-1", [(None, "seen as Corra Ashby", None), ("EDU_ORG", "Some College", None)]), ("H2-9", [("EMAIL", "a@b.example", None)]), ("H2-3", None), (None, [("EMAIL", "a@b.example", None)])], f"id string, fn_leaks {leak}")
    got = privacy.all_items(records, errors, "k").collect()
    assert all(r.fits for r in got) and {r.n_violations for r in privacy.surrogate_checks(privacy.all_items(records, errors, "k")).collect()} == {0}
    assert len(got) == len(set(got)) == 13 + 2
    assert {(r.id, r.item_no, r.label) for r in got if r.place == "judge"} == {("H2-1", 1, "NAME"), ("H2-9", 1, "EMAIL")}
    assert privacy.all_items(records.limit(0), errors.limit(0), "k").count() == 0
    assert {r.id: r.n_items for r in privacy.mask_texts(records.where("id is not null"), "s").collect()} == {"H2-1": 13, "H2-2": 0, "H2-3": 0}


def test_leaked_texts_are_masked_as_in_their_record(spark):
    from cloakframe.llm import queries

    records = frame(spark, [("H2-1", RECORD), ("H2-1", RECORD), ("H2-2", None)], "id string, text string")
    leaks = [(None, "seen as Corra Ashby", None), ("EDU_ORG", "Some College", None), ("NAME", "line: Nella Storm, page 2", None), (None, "found: holdan@inbox. test", None), (None, None, None)]
    errors = frame(spark, [("H2-1", leaks), ("H2-1", leaks), ("H2-2", [("EMAIL", "a@b.example", None)]), ("H2-3", []), (None, leaks)], "id string, fn_leaks array<struct<label:string,text:string,visible:array<string>>>")
    got = {(r.id, r.item_no): r for r in privacy.mask_leaks(records, errors, "key").collect()}
    assert {k: (r.label, r.masked) for k, r in got.items()} == {
        ("H2-1", 1): ("NAME", "seen as [NAME_1]"), ("H2-1", 2): (None, "Some College"), ("H2-1", 3): ("NAME", "line: [NAME_3], page 2"), ("H2-1", 4): ("EMAIL", "found: [EMAIL_2]"), ("H2-2", 1): ("EMAIL", "[EMAIL_1]"),
    }
    fake = privacy.masked(RECORD, privacy.detect(RECORD), b"key", "H2-1")[1]
    assert got["H2-1", 1].surrogate == "seen as " + fake.split(" |")[0] and got["H2-1", 2].surrogate == "Some College"
    assert "p4_leaks" in queries.queries()


# ---- 5: overlaps


def vocabulary(rng, n=400):
    return ["".join(rng.choice("abcdefgh") for _ in range(rng.randrange(3, 8))) for _ in range(n)]


def test_winnowing_guarantee():
    rng = random.Random(3)
    words = vocabulary(rng)
    for _ in range(50):
        shared = [rng.choice(words) for _ in range(overlap.SHINGLE + overlap.WINDOW - 1)]
        a, b = ([rng.choice(words) for _ in range(60)] + shared + [rng.choice(words) for _ in range(60)] for _ in range(2))
        fa, fb = (set(overlap.fingerprints(overlap.word_hashes(x))[0].tolist()) for x in (a, b))
        assert fa & fb


def test_alignment_equals_dynamic_programming():
    rng = random.Random(4)
    for _ in range(200):
        a, b = ([rng.randrange(5) for _ in range(rng.randrange(25))] for _ in range(2))
        t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
        assert overlap.common_in_order(a, b) == t[-1][-1] >= overlap.chained(a, b, [(i, j) for i in range(len(a)) for j in range(len(b)) if a[i] == b[j]])


def found_pairs(spark, rows):
    df = frame(spark, [(*r, 1) for r in rows], "id string, split string, source string, text string, tid int")
    return {(r.id_a, r.id_b) for r in overlap.record_pairs(*overlap.cross_split_overlaps(df)).collect()}


def test_overlaps_equal_brute_force(spark):
    rng = random.Random(5)
    words = vocabulary(rng)
    rows = []
    for n in range(24):
        text = [rng.choice(words) for _ in range(rng.choice([12, 45, 150]))]
        rows.append((f"DEV-{n}", "dev", "s", " ".join(text)))
        if n % 2:
            copy = list(text)
            for k in rng.sample(range(len(copy)), int(len(copy) * rng.choice([0, 0.05, 0.09, 0.2, 0.4]))):
                copy[k] = rng.choice(words) + "x"
            rows.append((f"H2-{n}", "h2", "s", " ".join(copy).upper()))
            rows.append((f"H3-{n}", "h3", None, "  ".join(copy)))
    want = set()
    for a in rows:
        for b in rows:
            if a[1] != "dev" and b[1] == "dev":
                x, y = a[3].lower().split(), b[3].lower().split()
                if overlap.common_in_order(x, y) >= 0.9 * max(len(x), len(y)) - 1e-9:
                    want.add(tuple(sorted((a[0], b[0]))))
    assert want and found_pairs(spark, rows) == want


def test_boilerplate_only_texts_are_found_by_their_words(spark):
    rng = random.Random(6)
    stock = [" ".join(rng.choice(vocabulary(random.Random(9), 30)) for _ in range(12)) for _ in range(6)]
    rows = [(f"DEV-{n}", "dev", "s", " ".join(rng.sample(stock, 4))) for n in range(overlap.HOT + 20)]
    rows.append(("H2-1", "h2", "s", rows[3][3] + " zz"))
    got = found_pairs(spark, rows)
    assert ("DEV-3", "H2-1") in got


def test_large_families_of_edited_copies_are_whole(spark):
    rng = random.Random(12)
    words = vocabulary(rng)
    text = [rng.choice(words) for _ in range(300)]
    rows = []
    for n in range(2 * overlap.HOT):
        copy = list(text)
        for k in rng.sample(range(len(copy)), 9):
            copy[k] = f"own{n}word{k}"
        rows.append((f"DEV-{n}", "dev", "s", " ".join(copy)) if n % 2 else (f"H2-{n}", "h2", "s", " ".join(copy)))
    evenly = [f"zz{k}" if k % 11 == 5 else w for k, w in enumerate(rng.choice(words) for _ in range(110))]
    rows += [("DEV-e", "dev", "s", " ".join(evenly)), ("CV-e", "test", "s", " ".join(f"yy{k}" if k % 11 == 5 else w for k, w in enumerate(evenly)))]
    got = found_pairs(spark, rows)
    assert len(got) == overlap.HOT**2 + 1 and ("CV-e", "DEV-e") in got


def test_overlaps_of_odd_records(spark):
    rows = [("DEV-1", "dev", "s", "one two three"), ("H2-1", "h2", "s", "ONE  twо three"), ("H2-1", "h2", "s", "ONE  twо three"), ("H2-2", None, "s", "one two three"), ("H2-3", "h2", "s", ""), ("DEV-3", "dev", "s", ""), ("H2-4", "h2", "s", None), (None, "h2", "s", "one two three"), ("DEV-5", "dev", None, "a b c d e f g h i j"), ("CV-5", "test", None, "a b c d X f g h i j")]
    assert found_pairs(spark, rows) == {("DEV-1", "H2-1"), ("DEV-1", "H2-2"), ("CV-5", "DEV-5")}
    assert found_pairs(spark, rows[:1]) == set()
    df = frame(spark, rows, "id string, split string, source string, text string")
    report = {(r.split, r.source): (r.n_records, r.n_overlapping) for r in overlap.overlap_report(*overlap.cross_split_overlaps(df)).collect()}
    assert report["holdout", "s"] == (2, 2) and report["devsynth", "s"] == (1, 1)


def test_signatures_differ_by_what_texts_do_not_share():
    rng = random.Random(21)
    words = vocabulary(rng, 900)
    for n, m in ((30, 28), (512, 470), (540, 505), (1100, 1000), (3000, 2800)):
        x = [rng.choice(words) for _ in range(n)]
        y = x[: m - m // 10] + [rng.choice(words) for _ in range(m // 10)]
        a, b = (overlap.word_tokens(overlap.word_hashes(t)) for t in (x, y))
        one, two = (np.frombuffer(overlap.signature(t), np.uint64)[:, None] for t in (a, b))
        bits = 64 * min(len(one), len(two))
        differ = np.bitwise_count(overlap._folded(one, bits) ^ overlap._folded(two, bits)).sum()
        assert 0 < differ <= len(set(a.tolist()) ^ set(b.tolist()))


def test_near_texts_are_the_same_for_any_batches():
    rng = random.Random(22)
    words = vocabulary(rng, 60)
    rows, want, texts = [], set(), []
    for k in range(150):
        if k % 3 and texts:
            text = list(rng.choice(texts)[3])
            for at in rng.sample(range(len(text)), int(len(text) * rng.choice([0, 0.05, 0.1, 0.3]))):
                text[at] = rng.choice(words)
        else:
            text = [rng.choice(words) for _ in range(rng.choice([12, 60, 500, 530]))]
        texts.append((k, k % 2 == 0, overlap.word_tokens(overlap.word_hashes(text)), text))
    for k, evaluation, tokens, text in texts:
        for rank, token in enumerate(sorted(tokens.tolist())[: len(text) // 10 + 1], 1):
            row = (token - (1 << 63), len(text), rank, evaluation, k, overlap.signature(tokens))
            rows += [row] * rng.choice([1, 1, 2])
    for a in texts:
        for b in texts:
            if a[1] and not b[1] and len(set(a[2].tolist()) & set(b[2].tolist())) >= 0.9 * max(len(a[3]), len(b[3])) - 1e-9:
                want.add((a[0], b[0]))
    rows.sort(key=lambda r: (r[0], r[1], r[4], r[3]))
    kinds = [("token", pa.int64()), ("n_words", pa.int32()), ("rank", pa.int32()), ("evaluation", pa.bool_()), ("tid", pa.int64()), ("signature", pa.binary())]
    whole = pa.RecordBatch.from_arrays([pa.array(c, kind) for c, (_, kind) in zip(zip(*rows), kinds)], [name for name, _ in kinds])
    got = []
    for size in (len(rows), 97, 1):
        batches = (whole.slice(at, size) for at in range(0, len(rows), size))
        got.append({(r["a"], r["b"]) for batch in overlap.near_texts(batches) for r in batch.to_pylist()})
    assert len(want) > 20 and want <= got[0] == got[1] == got[2]


def written_since(spark, before):
    """Files of shuffles and checkpoints that are not in ``before``, and their bytes."""
    sc = spark.sparkContext._jsc.sc()
    dirs = [*sc.env().blockManager().diskBlockManager().localDirsString()]
    known = sc.getCheckpointDir()
    dirs += [known.get().removeprefix("file:")] if known.isDefined() else []
    files = {p: p.stat().st_size for d in dirs for p in pathlib.Path(d).rglob("*") if p.is_file()}
    return files.keys(), sum(n for p, n in files.items() if p not in before)


def test_overlaps_take_little_disk(spark, tmp_path):
    rng = random.Random(23)
    words = vocabulary(rng, 3000)
    texts = [" ".join(rng.choice(words) for _ in range(rng.randrange(150, 300))) for _ in range(3000)]
    rows = [(f"{'DEV' if n % 3 else 'H2'}-{n}", "dev" if n % 3 else "h2", "s", text) for n, text in enumerate(texts)]
    rows += [(f"H2-copy-{n}", "h2", "s", texts[n] + " more") for n in range(1, 300, 3)]
    frame(spark, rows, "id string, split string, source string, text string").repartition(4).write.parquet(str(tmp_path / "t"))
    records = spark.read.parquet(str(tmp_path / "t"))
    overlap.cut(records.limit(1))  # the folder for checkpoints is known from here on
    before, _ = written_since(spark, ())
    got = overlap.record_pairs(*overlap.cross_split_overlaps(records)).collect()
    assert {(r.id_a, r.id_b) for r in got} == {(f"DEV-{n}", f"H2-copy-{n}") for n in range(1, 300, 3)}
    assert written_since(spark, before)[1] < 4 * sum(p.stat().st_size for p in (tmp_path / "t").glob("*.parquet"))


# ---- 6: leaks


def brute_leak(item, text):
    """Longest diagonal or gapped passage by trying every pair of starts on every diagonal (substitutions only)."""
    for d in range(-len(item), len(text)):
        same = [0 <= i + d < len(text) and item[i] == text[i + d] for i in range(len(item))]
        for i in range(len(item)):
            changed = 0
            for j in range(i, len(item)):
                if not 0 <= j + d < len(text):
                    break
                changed += not same[j]
                if j - i + 1 >= 25 and changed * 15 <= j - i + 1:
                    return True
    return False


def test_leaks_equal_brute_force(spark):
    rng = random.Random(7)
    words = vocabulary(rng)
    items = [(n, " ".join(rng.choice(words) for _ in range(60))) for n in range(12)]
    docs, want = [], set()
    for d in range(60):
        parts = [rng.choice(words) for _ in range(30)]
        n, item = rng.choice(items)
        piece = item.split()
        size = rng.choice([20, 24, 25, 30, 45, 60])
        at = rng.randrange(60 - size + 1)
        piece = piece[at : at + size]
        for k in rng.sample(range(size), rng.choice([0, 0, size // 15, size // 5])):
            piece[k] = "zzz"
        docs.append((d, " ".join(parts + piece + parts).title().replace(" ", ",\n")))
    for d, text in docs:
        for n, item in items:
            if brute_leak(item.split(), text.replace(",\n", " ").lower().split()):
                want.add((d, n))
    got = {(r.doc_id, r.item_id) for r in leakage.find_leaks(frame(spark, [(*x, 1) for x in docs], "doc_id long, text string, item_id int"), frame(spark, items, "item_id long, text string")).collect()}
    assert len(want) > 20 and want <= got and len(got - want) <= 1


def test_stock_clauses_do_not_leak(spark):
    rng = random.Random(8)
    words = vocabulary(rng)
    clause = "The applicant agrees that the details given above may be kept on file for the length of the round and will be removed on written request at any time."
    own = [" ".join(rng.choice(words) for _ in range(30)) + ". " for _ in range(3)]
    items = frame(spark, [(n, own[n].capitalize() + clause) for n in range(3)], "item_id long, text string")
    docs = frame(spark, [(1, clause), (2, own[1] + clause), (3, None), (4, ""), (5, own[2] + own[2]), (5, own[2])], "doc_id long, text string")
    assert {(r.doc_id, r.item_id) for r in leakage.find_leaks(docs, items).collect()} == {(2, 1), (5, 2)}
    assert leakage.find_leaks(docs, items.limit(0)).count() == 0 and leakage.find_leaks(docs.limit(0), items).count() == 0
    assert [r.n_documents for r in leakage.leaked_items(leakage.find_leaks(docs, items).where("item_id = 1")).collect()] == [1]


def test_stock_clauses_of_a_single_item(spark):
    rng = random.Random(10)
    words = vocabulary(rng)
    say = lambda n: " ".join(rng.choice(words) for _ in range(n)).capitalize() + ". "
    clause = "The applicant agrees that the details given above may be kept on file for the length of the round and will be removed on written request at any time."
    own = [say(30), say(28), say(32)]
    items = frame(spark, [("x", own[0] + own[1] + clause), ("y", say(40) + own[2])], "item_id string, text string")
    docs = [(f"c{n}", say(40) + clause) for n in range(30)]  # the clause alone, amid other words each time
    docs += [(f"s{n}", say(40) + own[2]) for n in range(7)]  # a whole sentence, too seldom to be stock
    docs += [(f"k{n}", "The very same words come first. " + own[0]) for n in range(30)]  # often, but always in one place
    docs += [("l", say(20) + own[1] + clause), ("m", own[0] + own[1] + clause + say(9))]
    got = {(r.doc_id, r.item_id): r for r in leakage.find_leaks(frame(spark, docs, "doc_id string, text string"), items).collect()}
    assert {*got} == {*((f"s{n}", "y") for n in range(7)), *((f"k{n}", "x") for n in range(30)), ("l", "x"), ("m", "x")}
    assert (got["l", "x"].doc_word, got["l", "x"].item_word, got["l", "x"].n_words) == (20, 30, 28) and got["m", "x"].n_words == 58


def test_one_text_under_two_ids_is_not_stock(spark):
    rng = random.Random(12)
    words = vocabulary(rng)
    text = " ".join(rng.choice(words) for _ in range(30)).capitalize() + ". " + " ".join(rng.choice(words) for _ in range(30)).capitalize() + "."
    items = frame(spark, [(1, text), (2, text + " And more."), (3, text.upper())], "item_id long, text string")
    assert {(r.doc_id, r.item_id) for r in leakage.find_leaks(frame(spark, [(9, text)], "doc_id long, text string"), items).collect()} == {(9, 1), (9, 2), (9, 3)}


def test_items_that_repeat(spark):
    rng = random.Random(9)
    words = vocabulary(rng)
    items = [(n, " ".join(rng.choice(words) for _ in range(40))) for n in range(7)] + [(0, None), (3, "too short")]
    docs = frame(spark, [(n, t) for n, t in items[:7]], "doc_id long, text string")
    got = {(r.doc_id, r.item_id) for r in leakage.find_leaks(docs, frame(spark, items, "item_id long, text string")).collect()}
    assert got == {(n, n) for n in range(7)}


# ---- 7: mixing


def test_tokens_round_trip():
    enc = mixing.tokenizer(mixing.TOKENIZER)
    for text in ("plain words", "Grüße \U0001f600\n\n x", " " * 50, ""):
        assert enc.decode(mixing.token_ids(mixing.TOKENIZER, text).tolist()) == text


def test_shares_and_caps(spark):
    rng = random.Random(10)
    words = {"a": "apple pear plum", "b": "bolt nut screw", "c": "cat dog hen"}
    docs = [(n, " ".join(rng.choice(words[s].split()) for _ in range(rng.randrange(20, 200))), s.upper() if n % 9 == 0 else f" {s} ") for n, s in enumerate(rng.choices("aaaaabbbc", k=900))]
    docs += [(9001, None, "a"), (9002, "", "b"), (9003, "bolt nut screw " * 9, None), (9004, "apple pear " * 9, "unknown"), (9003, "bolt nut screw " * 9, None)]
    df = frame(spark, [(*d, 3) for d in docs], "doc_id long, text string, source string, tokens int")
    targets = frame(spark, [("a", 0.3, 1), ("b", 0.3, 2), ("C", 0.4, 3), ("none", 0.2, 1), ("a", 0.3, 1), (None, 0.1, 1)], "source string, target_share double, max_repeats int")
    chosen, plan = mixing.mix(df, targets)
    rows = chosen.collect()
    cap = {"a": 1, "b": 2, "c": 3}
    assert len(rows) == len(docs) and all(0 <= r.repeats <= cap.get(r.source, 3) and r.rate >= 0 for r in rows)
    assert all(r.repeats == 0 for r in rows if r.doc_id in (9001, 9002))
    got = {r.source: r.reached_share for r in mixing.reached_shares(chosen, plan).collect() if r.source in cap}
    assert abs(got["a"] - 0.3) < 0.01 and abs(got["b"] - 0.3) < 0.01 and abs(got["c"] - 0.4) < 0.01
    posterior = {r.doc_id: r.posterior for r in rows}
    names = plan.names
    assert posterior[9003][names.index("b")] > 0.9 and posterior[9004][names.index("a")] > 0.9


def test_rates_written_every_few_steps_are_the_same(spark, monkeypatch):
    rng = random.Random(11)
    words = {"a": "apple cake cake cake cake cake cake", "b": "bolt cake cake cake cake cake cake"}
    docs = [(f"d{n}", " ".join(rng.choice(words[s].split()) for _ in range(rng.randrange(3, 40))), s if n % 3 else None) for n, s in enumerate(rng.choices("aab", k=400))]
    df = frame(spark, docs, "doc_id string, text string, source string")
    targets = frame(spark, [("a", 0.35, 2), ("b", 0.65, 3)], "source string, target_share double, max_repeats int")
    rates = []
    for every in (2, 100):
        monkeypatch.setattr(mixing, "STEPS_PER_CUT", every)
        chosen, plan = mixing.mix(df, targets)
        assert plan.error <= mixing.TOLERANCE and plan.n_steps > 3 and plan.rounding.max() < 0.02
        rates.append({r.doc_id: (round(r.rate, 6), r.repeats) for r in chosen.collect()})
        report = {r.source: r for r in mixing.reached_shares(chosen, plan).collect()}
        assert report["a"].fit_error <= mixing.TOLERANCE and report["b"].rounding_error < 0.02
    assert rates[0] == rates[1] and len(rates[0]) == 400


def test_trust_follows_the_held_out_labels():
    rng = random.Random(12)
    text = {"a": "apple pear plum", "b": "bolt nut screw"}
    rows = [(s, " ".join(rng.choice(text[s].split()) for _ in range(60))) for s in rng.choices("ab", k=300)]
    wrong = [("ba"["ab".index(s)] if rng.random() < 0.2 else s, t) for s, t in rows]
    good, bad = (mixing.fit_domains(["a", "b"], x, mixing.TOKENIZER) for x in (rows, wrong))
    assert good.trust > 0.99 and 0.6 < bad.trust < 0.95
    q = bad.labelled(np.array([[0.5, 0.5], [1.0, 0.0]]), np.array([1, -1]))
    assert abs(q[0, 1] - bad.trust) < 1e-9 and q[1, 0] > 0.99


def test_mixing_without_targets_or_documents(spark):
    df = frame(spark, [(1, "x", "a")], "doc_id long, text string, source string")
    targets = frame(spark, [("a", 0.5, 1)], "source string, target_share double, max_repeats int")
    assert [r.repeats for r in mixing.mix(df, targets.limit(0))[0].collect()] == [0]
    assert mixing.mix(df.limit(0), targets)[0].count() == 0


# ---- 8: reading level


def test_trees_fit_and_split():
    rng = np.random.default_rng(0)
    x = rng.random((300, 3))
    y = np.where(x[:, 0] > 0.5, 2.0, 0.0) + np.where(x[:, 1] > 0.3, 1.0, 0.0)
    model = BoostedTrees().fit(x[:200], y[:200])
    assert np.abs(model.predict(x[200:]) - y[200:]).mean() < 0.15
    assert np.allclose(BoostedTrees().fit(x[:5], np.ones(5)).predict(x[:9]), 1.0)


def anchors(spark):
    rng = random.Random(11)
    easy = lambda: f"{rng.choice(['My boss', 'The clerk', 'A friend'])} can {rng.choice(['read', 'sign', 'find'])} the {rng.choice(['note', 'form', 'mail'])} at {rng.choice(['home', 'work'])}. "
    hard = lambda: f"Notwithstanding the considerable {rng.choice(['methodological', 'institutional'])} heterogeneity of the {rng.choice(['evaluation', 'optimisation'])} frameworks, the administration will necessitate a comprehensive interdisciplinary {rng.choice(['verification', 'consultation'])} of all organisations. "
    middle = lambda: f"The team rebuilt the {rng.choice(['payroll', 'archive'])} after the {rng.choice(['branch', 'office'])} moved, and later wrote a manual that people still print because it helps. "
    rows = [(n, {0: 1, 1: 2, 2: 4}[n % 3], "".join([easy, middle, hard][n % 3]() for _ in range(8))) for n in range(30)]
    return frame(spark, rows, "anchor_id int, level int, text string"), easy, middle, hard


def test_reading_bands(spark):
    held, easy, middle, hard = anchors(spark)
    text = lambda f: "".join(f() for _ in range(9))
    docs = [(1, text(easy), "a"), (2, text(middle), "a"), (3, text(hard), "b"), (4, None, "b"), (5, "", None), (6, "Python, Java\nada@x.io", "a"), (7, "\n".join("• " + easy().strip(". ") for _ in range(9)), "A "), (1, text(easy), "a"), (8, DE * 6, "b"), (9, text(hard) * 300, "b")]
    got = reading.reading_levels(frame(spark, [(*d, 5) for d in docs], "doc_id long, text string, source string, grade int"), held)
    bands = {r.doc_id: r.band for r in got.collect()}
    assert bands[1] == bands[7] == "basic" and bands[2] == "between" and bands[3] == bands[9] == "advanced" and bands[4] is bands[5] is bands[6] is None
    assert {r.doc_id for r in got.where("english and band is not null").collect()} == {1, 2, 3, 7, 9}
    assert {r.source: r.n_documents for r in reading.source_profile(got).collect()}["a"] == 5
    assert reading.reading_levels(frame(spark, docs, "doc_id long, text string, source string"), held.limit(0)).where("grade is not null").count() == 0
    assert reading.reading_levels(frame(spark, docs, "doc_id long, text string, source string").limit(0), held).count() == 0
    named = frame(spark, [(f"d{i}", t, s) for i, t, s in docs], "doc_id string, text string, source string")
    assert {(r.doc_id, r.band) for r in reading.reading_levels(named, held).collect()} == {(f"d{r.doc_id}", r.band) for r in got.collect()}


def test_stock_clauses_are_set_aside(spark):
    held, easy, _, _ = anchors(spark)
    clause = "The applicant agrees that comprehensive institutional documentation notwithstanding contemporary considerations may permanently necessitate organisational verification. "
    docs = [(n, "".join(easy() for _ in range(4)) + clause, "a") for n in range(40)]
    got = reading.reading_levels(frame(spark, docs, "doc_id long, text string, source string"), held).collect()
    assert all(r.band == "basic" for r in got)


def test_near_copies_are_not_stock(spark):
    held, *_ = anchors(spark)
    rng = random.Random(13)
    sentence = lambda n, k: f"Notwithstanding the considerable methodological heterogeneity of the evaluation frameworks, the administration will necessitate a comprehensive interdisciplinary verific{n}{k}ation of all organisations. ".translate(str.maketrans("0123456789", "abcdefghij"))
    clause = "The applicant agrees that the details given above may be kept on file for the length of the round and will be removed on request. "
    family = [sentence(n, "x") for n in range(9)]
    docs = []
    for n in range(60):
        copy = [sentence(k, f"y{n}") if k in rng.sample(range(9), 2) else s for k, s in enumerate(family)]
        docs.append((n, f"NOTE {n}\n\n" + "".join(copy).replace(" the ", "\nthe " if n % 2 else " the "), "a"))
    docs += [(100 + n, "".join(f"My boss can read the {w} at home. " for w in rng.sample(vocabulary(rng, 90), 6)) + clause, "b") for n in range(60)]
    docs += [(200, clause, "b"), (201, clause.upper(), "b")]
    got = reading.reading_levels(frame(spark, docs, "doc_id long, text string, source string"), held).collect()
    assert {r.band for r in got if r.doc_id < 100} == {"advanced"}
    assert {r.band for r in got if 100 <= r.doc_id < 200} == {"basic"}
    assert {r.band for r in got if r.doc_id >= 200} == {None}


def test_grader_is_calibrated_by_cross_validation(spark):
    held, *_ = anchors(spark)
    grader = reading.fit_grader([(r.level, r.text) for r in held.collect()])
    assert grader.error < 0.2 and list(grader.level) == [1, 2, 4]
