import pytest
from pyspark.sql import functions as F

from cloakframe.operators import identity, policy, rules
from cloakframe.plans import pipeline

DOC = "doc_id string, text string"
SPANS = "doc_id string, ord long, start_pos int, end_pos int, label string, src string, score double, surface string, section string, line string, line_start int, contact boolean, before string, after string"



@pytest.fixture(scope="module")
def hits(spark):
    """(rule, text) -> surfaces, for the texts of all cases in one scan."""
    texts = sorted({t for _, t, *_ in [*POSITIVE, *NEGATIVE]})
    found = rules.scan(spark.createDataFrame([(str(n), t) for n, t in enumerate(texts)], DOC)).collect()
    out = {}
    for r in found:
        text = texts[int(r.doc_id)]
        assert text[r.start_pos : r.end_pos] == r.surface
        out.setdefault((r.rule, text), []).append(r.surface)
    return out


POSITIVE = [
    ("R01", "write ada.byrne@mail.example now", "ada.byrne@mail.example"), ("R02", "ada [at] mail [dot] example", "ada [at] mail [dot] example"), ("R03", "ada at mail dot com", "ada at mail dot com"),
    ("R04", "in 2010 call +44 20 7946 0000", "+44 20 7946 0000"), ("R04", "Tel: 0161 496 0000", "0161 496 0000"), ("R04", "+442079460000", "+442079460000"), ("R04", "(0161) 496 0000 ext 12", "(0161) 496 0000 ext 12"), ("R04", "Mobil: 079 / 123 45 67", "079 / 123 45 67"), ("R05", "zero one two three four five six seven", "zero one two three four five six seven"),
    ("R06", "see @adab", "@adab"), ("R07", "Twitter: adab", "adab"), ("R08", "GB29 NWBK 6016 1331 9268 19", "GB29 NWBK 6016 1331 9268 19"), ("R09", "0000-0002-1825-0097", "0000-0002-1825-0097"), ("R10", "member #1234567", "1234567"),
    ("R11", "Berlin, 12.03.2025", "Berlin"), ("R12", "born in Porto", "Porto"), ("R13", "Passport No: X1234567 Valid", "X1234567"), ("R14", "A D A  B Y R N E", "A D A  B Y R N E"), ("R15", "https://x.example/a, b", "https://x.example/a"), ("R16", "ada.dev", "ada.dev"),
    ("R17", "Nationality: Irish", "Irish"), ("R17", "Address\t4 Elm Road", "4 Elm Road"), ("R18", "Date of birth: 12.03.1990", "12.03.1990"), ("R19", "age: 34", "34"), ("R20", "a man, 34 years old", "34 years old"),
    ("R21", "based in Porto and working", "Porto"), ("R22", "Nationalité française", "française"), ("R23", "Irish citizen", "Irish"), ("R24", "(she/her)", "(she/her)"), ("R25", "Ada, married", "married"), ("R26", "Geburtsort: Graz", "Graz"),
    ("R27a", "born in Porto, 12/03/1990", "Porto"), ("R27b", "born in Porto, 12/03/1990", "12/03/1990"), ("R28", "a Tokyo-based clerk", "Tokyo"), ("R29", "BSc, University of Leeds, 2001", "University of Leeds"), ("R29", "EDUCATION\nMSc Physics University of Leeds, 2015", "Physics University of Leeds"), ("R29", "School: University of Leeds 2015", "University of Leeds"), ("R29", "MBA, INSEAD", "INSEAD"),
    ("R02", "jane (arroba) mail (punto) com", "jane (arroba) mail (punto) com"), ("R03", "jane arroba mail punto com", "jane arroba mail punto com"), ("R13", "Permit No: 44198271", "44198271"), ("R13", "Validation code: 4419-8271", "4419-8271"), ("R13", "Codice fiscale RSSMRA80A01", "RSSMRA80A01"), ("R13", "Member no. 4419 82", "4419 82"),
    ("R17", "Famiglia: due figli", "due figli"), ("R17", "Familie | verheiratet", "verheiratet"), ("R17", "**Name / Nom:** Ada Byrne", "Ada Byrne"), ("R17", "Surname(s): Byrne", "Byrne"), ("R17", "Date of birth:\n12.03.1990", "12.03.1990"), ("R17", "Sex   F   Age   34", "34"), ("R24", "she/her", "she/her"), ("R15", "scholar.google.com/ada", "scholar.google.com/ada"), ("R16", "ada.design", "ada.design"), ("R21", "bor på Lidingö och vidare", "Lidingö"), ("R32", "Jeg heter Ada van Byrne.", "Ada van Byrne"), ("R36", "Publications\nAmes, P., J.-P. Dunn and K. Poe (2001)", "J.-P. Dunn"),
    ("R30", "University College London (UCL)", "UCL"), ("R31", "Education\nBA, INSEAD", "INSEAD"), ("R32", "My name is Ada Byrne and", "Ada Byrne"), ("R33", "yours\n(Ada Byrne)", "Ada Byrne"), ("R34", "supervised by Dr Ada Byrne", "Ada Byrne"),
    ("R35", "References\nMs Ada Byrne, Acme Ltd", "Ada Byrne"), ("R36", "Publications\nJ. Smith (2001)", "J. Smith"), ("R37", "Publications\nSmith, J. (2001)", "Smith, J."), ("R38", "Publications\nSmith JR, Jones K.", "Smith JR"),
]
NEGATIVE = [
    ("R03", "ada at work"), ("R04", "2016 - 2019"), ("R04", "12/03/1990"), ("R04", "\n\nEXPERIENCE\nmoved 123 456 78 boxes"), ("R08", "GB29 NWBK"), ("R10", "#12345"), ("R13", "Passport: none"), ("R16", "Experience\nwe built shop.com for them"),
    ("R17", "Name: 12 of 30"), ("R17", "Address: remote"), ("R20", "10 years of experience"), ("R25", "Experience\nmarried life of a pipe"), ("R29", "General Hospital Trust"), ("R31", "Education\nBSc, MBA"), ("R32", "I am Senior Engineer"), ("R32", "SOY Ada Byrne"), ("R13", "member 44198271"), ("R07", "my twitter is fine"), ("R04", "0000-0002-1825-0097"), ("R23", "irish citizen"), ("R28", "Experience\na Tokyo-based clerk"), ("R33", "yours (Ada Byrne) ever"), ("R01", "a @ b"), ("R15", "github.com"), ("R14", "Experience\nA D A  B Y R N E"), ("R11", "Engineer, 12.03.2025"), ("R24", "he/she"), ("R05", "one two three four five six"), ("R35", "Ms Ada Byrne, Acme Ltd"), ("R36", "met J. Smith there"),
]


@pytest.mark.parametrize("rule,text,want", POSITIVE)
def test_rule_finds(hits, rule, text, want):
    assert want in hits.get((rule, text), [])


@pytest.mark.parametrize("rule,text", NEGATIVE)
def test_rule_does_not_find(hits, rule, text):
    assert (rule, text) not in hits


def test_every_rule_has_a_case():
    assert {*rules.RULES} == {p[0] for p in POSITIVE}


def test_scan_keeps_offsets_of_odd_text(spark):
    text = "\U0001f600 Ada\nmail ada@x.example　z"
    docs = spark.createDataFrame([("d", text), ("n", None), ("e", "")], DOC)
    got = rules.scan(docs).where("rule = 'R01'").collect()
    assert [(r.doc_id, r.surface, text[r.start_pos : r.end_pos]) for r in got] == [("d", "ada@x.example", "ada@x.example")]


def span(surface, label, src="m", section="other", line=None, contact=False, before="", after="", score=0.5):
    line = line if line is not None else surface
    return ("d", 1, 0, len(surface), label, src, score, surface, section, line, 0, contact, before, after)


CASES = [
    (span("Dr. Ada Byrne", "NAME"), ("Ada Byrne", "NAME")), (span("Django", "NAME", section="skills"), None), (span("Ada", "NAME", line="Ada, Bo, Cy, Di", section="skills"), None), (span("Ada", "NAME", after=" & Sons"), None),
    (span("Ada", "NAME", before="Smith & "), None), (span("NHS", "NAME"), None), (span("Acme Ltd", "NAME"), None), (span("English", "NAME"), None), (span("Email", "NAME"), None), (span("NHS", "NAME", src="re"), ("NHS", "NAME")),
    (span("Leeds", "LOCATION"), None), (span("Leeds", "LOCATION", section="header"), ("Leeds", "LOCATION")), (span("Leeds", "LOCATION", contact=True), ("Leeds", "LOCATION")), (span("Leeds", "LOCATION", section="references"), ("Leeds", "LOCATION")),
    (span("University of Leeds", "ORG"), ("University of Leeds", "EDU_ORG")), (span("Acme Ltd", "ORG", section="education"), None), (span("Northgate", "ORG", section="education"), ("Northgate", "EDU_ORG")), (span("Northgate", "ORG"), None),
    (span("Abitur", "EDU_ORG", section="education"), None), (span("12.03.1990", "DATE", before="Date of birth: "), ("12.03.1990", "DOB")), (span("12.03.1990", "DATE"), None), (span("Irish", "NATIONALITY"), None), (span("Irish", "NATIONALITY", section="personal"), ("Irish", "NATIONALITY")),
    (span("github.com/ada", "URL", src="re"), ("github.com/ada", "URL")), (span("github.com/ada/tool", "URL", src="re"), None), (span("shop.example/x", "URL", src="re"), None), (span("linkedin.com/in/ada", "URL"), ("linkedin.com/in/ada", "URL")),
    (span("12345", "ID"), None), (span("AB12345", "ID"), ("AB12345", "ID")), (span("123456", "PHONE"), None), (span("1234567", "PHONE"), ("1234567", "PHONE")), (span("1990", "DOB", section="personal"), None), (span("12.3.1990", "DOB", section="personal"), ("12.3.1990", "DOB")),
    (span("a b", "HANDLE"), None), (span("@adab", "HANDLE"), ("@adab", "HANDLE")), (span("gift", "MARITAL"), ("gift", "MARITAL")), (span("blue", "MARITAL"), None), (span("a@b.c", "EMAIL"), ("a@b.c", "EMAIL")), (span("x", "OTHER", src="re"), None), (span("  ", "EMAIL"), None),
    (span("Skills", "NAME", line="SKILLS:"), None), (span("she", "GENDER"), ("she", "GENDER")),
]


def test_policy_decisions(spark):
    rows = [(f"d{n}", *s[1:]) for n, (s, _) in enumerate(CASES)]
    got = {r.doc_id: (r.surface, r.label) for r in policy.apply(spark.createDataFrame(rows, SPANS)).collect()}
    want = {f"d{n}": w for n, (_, w) in enumerate(CASES) if w}
    assert got == want


def test_policy_switches(spark):
    rows = [span("Django", "NAME", section="skills"), span("Ada", "NAME", after=" & Sons", score=0.2), span("shop.example", "URL")]
    df = spark.createDataFrame([(f"d{n}", *r[1:]) for n, r in enumerate(rows)], SPANS)
    loose = policy.Config(allowlist=False, org_suffix_rule=False, url_policy="all")
    assert policy.apply(df, loose).count() == 3
    assert policy.apply(df, policy.Config(org_suffix_rule=False, name_min_score=0.5)).count() == 0


@pytest.mark.parametrize(
    "text,name",
    [("John Smith\njohn@x.com\n", "John Smith"), ("CURRICULUM VITAE\nSenior Data Engineer\nJohn Smith", None), ("Smith, John\nLeeds", "Smith, John"), ("Data Engineer\nJohn van der Smith, MSc", "John van der Smith"), ("EXPERIENCE\nJohn Smith", None), ("Ada Byrne – Clerk", "Ada Byrne"), ("", None)],
)
def test_header_name(spark, text, name):
    got = policy.header_names(spark.createDataFrame([("d", text)], DOC)).collect()
    assert [r.surface for r in got] == ([name] if name else [])
    assert all(text[r.start_pos : r.end_pos] == r.surface for r in got)


def test_header_name_in_other_titles(spark):
    for title in ("Życiorys", "Hoja de vida", "Europass CV: 2024", "RÉSUMÉ"):
        got = policy.header_names(spark.createDataFrame([("d", f"{title}\nJohn (Jack) Smith\n")], DOC)).collect()
        assert [r.surface for r in got] == ["John (Jack) Smith"]


def test_places_and_contact_segments(spark):
    text = "Jane Doe\n12 Park Road, Leeds LS1 4AB | jane@x.com | Northtown\nLeeds, UK\nAddress: 4 Elm Road\n"
    rows = pipeline.found(spark.createDataFrame([("d", text)], DOC)).first().spans
    assert {(r.surface, r.label, r.src) for r in rows if r.src in ("re-street", "re-locline", "re-contactseg")} == {
        ("12 Park Road, Leeds LS1 4AB", "ADDRESS", "re-street"), ("Leeds, UK", "LOCATION", "re-locline"), ("4 Elm Road", "ADDRESS", "re-street"), ("Northtown", "LOCATION", "re-contactseg")
    }
    assert all(text[r.start_pos : r.end_pos] == r.surface for r in rows)


def test_propagation(spark):
    text = "Ada Byrne-Holt met ADA BYRNE-HOLT and Holt. holt@x.io https://adabyrneholt.dev and May May"
    seed = spark.createDataFrame([("Ada Byrne-Holt", "NAME", "re-intro", "other"), ("Bo May", "NAME", "re", "other"), ("Cy Dunn", "NAME", "m", "experience")], "surface string, label string, src string, section string")
    packed = seed.select(F.collect_list(F.struct("surface", "label", "src", "section")).alias("spans"))

    def names(mode):
        return [n.asDict() for n in packed.select(identity.known_names(F.col("spans"), mode).alias("n")).first().n]

    got = {(text[a:b], a, label) for a, b, label, _ in identity.carried(text, names("surname"))}
    assert got == {("Ada Byrne-Holt", 0, "NAME"), ("ADA BYRNE-HOLT", 19, "NAME"), ("Byrne-Holt", 4, "NAME"), ("Byrne", 4, "NAME"), ("Holt", 10, "NAME"), ("Holt", 38, "NAME"), ("https://adabyrneholt.dev", 54, "URL")}
    assert ("Ada", 0) in {(text[a:b], a) for a, b, *_ in identity.carried(text, names("all"))}


def test_judge_in_the_pipeline(spark):
    text = "Ada Byrne\n\nExperience\nmet Cy Dunn at Northgate there\n"
    docs = spark.createDataFrame([("d", text)], DOC)
    at = text.index("Cy")
    found = spark.createDataFrame([("d", 1, at, at + 7, "NAME", "m", "ner", 0.9, "Cy Dunn")], "doc_id string, span_id long, start_pos int, end_pos int, label string, det string, src string, score double, surface string")
    replies = spark.createDataFrame([("d", '{"decisions": {"0": "pii", "1": "keep visible"}, "missed": [{"text": "Northgate", "label": "EDU_ORG"}]}')], "doc_id string, out string")
    masked = lambda mode: pipeline.masked(pipeline.found(docs, found, replies=replies, mode=mode)).first().masked
    assert "[EDU_ORG] there" in masked("full") and "Northgate there" in masked("drop_only") and "[NAME] at" in masked("none")
    assert masked("full") == "Ada Byrne\n\nExperience\nmet [NAME] at [EDU_ORG] there\n"


def test_pipeline_masks(spark):
    text = "Ada Byrne\nada@mail.example | +44 20 7946 0000\nLeeds, UK\n\nExperience\n2016 - 2019 Clerk, Acme Ltd\nByrne wrote to ada@mail.example\n"
    docs = spark.createDataFrame([("d", text), ("e", "nothing here"), ("z", "")], DOC)
    got = {r.doc_id: r for r in pipeline.masked(pipeline.found(docs)).collect()}
    assert got["d"].masked == "[NAME]\n[EMAIL] | [PHONE]\n[LOCATION]\n\nExperience\n2016 - 2019 Clerk, Acme Ltd\n[NAME] wrote to [EMAIL]\n"
    assert got["e"].masked == "nothing here" and got["z"].masked == "" and got["e"].n_masked == 0
    raw = pipeline.run(docs, None, policy.Config(raw=True))
    assert {r.label for r in raw.collect()} >= {"EMAIL", "PHONE", "NAME"}
    bare = pipeline.run(docs, None, policy.Config(policy=False, safety_net=False, propagate="none"))
    assert bare.count() == raw.count()


def test_pipeline_takes_detectors(spark):
    text = "Ada Byrne\n\nExperience\nmet Cy Dunn there\n"
    docs = spark.createDataFrame([("d", text)], DOC)
    at = text.index("Cy")
    found = spark.createDataFrame([("d", 1, at, at + 7, "NAME", "m", "ner", 0.9, "Cy Dunn")], "doc_id string, span_id long, start_pos int, end_pos int, label string, det string, src string, score double, surface string")
    masked = pipeline.masked(pipeline.found(docs, found)).first().masked
    assert masked == "[NAME]\n\nExperience\nmet [NAME] there\n"
