"""Seeded synthetic records with annotation by construction, for tests and demonstrations."""

from __future__ import annotations

from random import Random

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Invented data of each language: given names, family names, headings (profile, work, education), keys (address, birth, nationality, marital status) and values.
LOCAL = {
    "en": ("Ada Bryn Cora Dale", "Ashdown Birkett Crowe", "Profile|Work history|Education", "Address|Date of birth|Nationality|Marital status", "14 Elm Road|Irish|married"),
    "de": ("Anke Bernd Carla Dirk", "Ahlers Brandt Conrad", "Profil|Werdegang|Ausbildung", "Anschrift|Geburtsdatum|Nationalität|Familienstand", "Lindenstraße 12|irisch|ledig"),
    "fr": ("Aline Bruno Chloé Denis", "Aubert Berger Carlier", "Profil|Parcours professionnel|Formation", "Adresse|Date de naissance|Nationalité|État civil", "8, rue Verville|irlandaise|célibataire"),
    "es": ("Alba Blas Celia Diego", "Alonso Bravo Castro", "Perfil|Experiencia|Formación", "Dirección|Fecha de nacimiento|Nacionalidad|Estado civil", "Calle Alda, 4|irlandesa|casada"),
    "it": ("Agata Bruno Carla Dario", "Alfieri Bruni Costa", "Profilo|Esperienza|Istruzione", "Indirizzo|Data di nascita|Cittadinanza|Stato civile", "Via Larga 9|irlandese|nubile"),
    "nl": ("Anouk Bram Carlijn Daan", "Aker Bos Cuypers", "Profiel|Werkervaring|Opleiding", "Adres|Geboortedatum|Nationaliteit|Burgerlijke staat", "Kerklaan 31|Iers|gehuwd"),
    "pl": ("Alina Bogdan Celina Darek", "Adamski Borek Cieślak", "Profil|Doświadczenie|Wykształcenie", "Adres|Data urodzenia|Obywatelstwo|Stan cywilny", "ul. Lipowa 5|irlandzkie|panna"),
    "pt": ("Alda Bento Catarina Dinis", "Abreu Branco Campos", "Perfil|Experiência|Formação", "Morada|Data de nascimento|Nacionalidade|Estado civil", "Rua Nova, 7|irlandesa|solteira"),
    "sv": ("Alva Bo Cilla Dag", "Alm Berg Dahl", "Profil|Arbetslivserfarenhet|Utbildning", "Adress|Födelsedatum|Medborgarskap|Civilstånd", "Storgatan 3|irländskt|gift"),
    "fi": ("Aino Birgit Eero Daniel", "Aalto Berg Eskola", "Profiili|Työkokemus|Koulutus", "Osoite|Syntymäaika|Kansalaisuus|Siviilisääty", "Mäkikatu 2|irlantilainen|naimaton"),
}
LAYOUTS = ("plain", "keyed", "footer", "table", "one line", "bullets", "markdown")
SCHEMA = "id string, lang string, layout string, text string, gold array<struct<start:int,end:int,label:string,required:boolean,text:string>>"


#: Texts with hits and near misses of the rules, for queries and tests; all data in them are invented.
RULE_TEXTS = (
    "write ada.byrne@mail.example now, or a@b or @ x",
    "call zero one two three four five six seven, or one two three",
    "see @adab and x@y.z and @ab and (@ada_b.c).",
    "IBAN shape GB29 NWBK 6016 1331 9268 19 and GB29 NWBK and DE89370400440532013000.",
    "orcid 0000-0002-1825-0097 and 0000-0002-1825-009X and 1000-0002-1825-00977",
    "member #1234567, #12345, x#7654321 and # 998877",
    "born in Porto, née à Lyon, geboren in Bad Ems. born at home",
    "links https://x.example/a, www.ada.example and linkedin.com/in/ada but not github.com",
    "age: 34, Alter 45, age 345 and ages 12; ikä-51",
    "Nationality: Irish\nNationalité française\nNationality Irish / British today",
    "an Irish citizen, a British/Irish national and an irish citizen",
    "(she/her) he/him (xe/xem) he/she they/them",
    "Geburtsort: Graz\nbirthplace Ames, Iowa\nplace of birth: porto",
    "My name is Ada Byrne and I am Senior Engineer. Ich bin Karl von Holt. Mi chiamo Elena Rossi",
    "Ada\nTwitter: adab | github: ada-b, slack handle: abyrne; my twitter is fine",
    "Ada\nada.dev and shop.example/x\n\nExperience\n2010 - 2012 built shop.com\nPortfolio: ada.design",
    "Date of birth: 12.03.1990; née le 3 mars 1988, born on 1990-02-01",
    "a man, 34 years old, and 45 ans; 10 years of experience\n12 Jahre in Graz",
    "She is based in Porto and works. Wohnhaft in Bad Ems, living in leeds",
    "Ada, married\nsingle-handed, verheiratet\n\nExperience\n2010 - 2012 married life",
    "born in Porto, 12/03/1990 and né à Lyon (FR) le 3 mars 1988",
    "a Tokyo-based clerk and a New York-based one\n\nSkills\na Graz-based tool",
    "supervised by Dr Ada Byrne; reporting to: Mr Holt, tutor Bo Li Chan. supervisor of",
    "write ada [at] mail [dot] example or jane (arroba) post.example or ada at mail dot com, ada at work",
    "Berlin, 12.03.2025\nBad Ems, den 3. Mai 2024\nEngineer, 12.03.2025\nGraz, im Mai 2024",
    "A D A  B Y R N E\n\nExperience\n2010 - 2012 clerk\nA B C  D E F",
    "Education\nBA, INSEAD\nMIT | 2010\nBSc, MBA\nHEC Paris",
    "yours\n(Ada Byrne)\n\ntext   (J. R. Holt)\n(Senior Engineer)\nyours (Ada Byrne) ever",
    "References\nMs Ada Byrne, Acme Ltd\n• Bo van Holt – clerk\nSenior Engineer, Acme\nCy Dunn\n\nEducation\nDi Moss, x",
    "Passport No: X1234567 Valid, Permit No: 44198271, Validation code: 4419-8271; Codice fiscale RSSMRA80A01, member 44198271, member no. 4419 82",
    "EDUCATION\nMSc Physics University of Leeds, 2015\nSchool: University of Ames 2015; MBA, INSEAD\nBSc in law, University College London (UCL / 2010) and *College of Arts* | General Hospital Trust (GHT)",
)


class Builder:
    """Appends text and notes the spans that are put into it."""

    def __init__(self) -> None:
        self.text, self.gold = "", []

    def put(self, text: str, label: str | None = None, required: bool = True) -> Builder:
        if label:
            self.gold.append((len(self.text), len(self.text) + len(text), label, required, text))
        self.text += text
        return self


def record(rng: Random, n: int) -> tuple:
    """One record; draws in a fixed order, so a seed means the same records everywhere."""
    lang = rng.choice(sorted(LOCAL))
    given, family, headings, keys, values = LOCAL[lang]
    profile, work, school = headings.split("|")
    first, last = rng.choice(given.split()), rng.choice(family.split())
    layout = rng.choice(LAYOUTS)
    mail = f"{first}.{last}@mail.example".lower()
    phone = f"+{rng.choice((33, 44, 49))} {rng.randrange(10, 99)} {rng.randrange(100, 999)} {rng.randrange(1000, 9999)}"
    number = f"X{rng.randrange(10**6, 10**7)}"
    born = f"{rng.randrange(10, 29)}.{rng.randrange(10, 13)}.{rng.randrange(1950, 2005)}"
    joint = {"table": " | ", "markdown": ": ", "bullets": ": "}.get(layout, ": ")
    begin = {"bullets": "• ", "markdown": "**"}.get(layout, "")
    close = "**" if layout == "markdown" else ""
    b = Builder().put("# " if layout == "markdown" else "").put(f"{first} {last}", "NAME").put("\n")

    def contact() -> None:
        keyed = layout in ("keyed", "table", "bullets")
        b.put(f"E-mail{joint}" if keyed else "").put(mail, "EMAIL").put(" | " if layout == "one line" else "\n")
        b.put(f"Tel{joint}" if keyed else "").put(phone, "PHONE").put("\n").put(f"www.{first}-{last}.example".lower(), "URL").put("\n")

    if layout != "footer":
        contact()
    address, nation, marital = values.split("|")
    for key, value, label in zip(keys.split("|"), (address, born, nation, marital), ("ADDRESS", "DOB", "NATIONALITY", "MARITAL")):
        b.put(f"{begin}{key}{close}{joint}").put(value, label).put("\n")
    b.put("Passport No: ").put(number, "ID").put(f"\n\n{profile}\n\n{work}\n")
    for _ in range(rng.randrange(1, 4)):
        b.put(f"Led the move of office {rng.randrange(100)} for ").put(f"{rng.choice(family.split())} Ltd", "ORG", False).put(".\n")
    b.put(f"\n{school}\n").put(f"University of {rng.choice(('Northam', 'Eastby', 'Westow'))}", "EDU_ORG").put(f", {rng.randrange(1980, 2020)}\n")
    if layout == "footer":
        b.put("---\n")
        contact()
    return f"GEN-{n:05d}", lang, layout, b.text, b.gold


def records(spark: SparkSession, n: int, seed: int = 7) -> DataFrame:
    """``n`` records from one seeded sequence, drawn on the driver: a small fixture, not a data source."""
    rng = Random(seed)
    return spark.createDataFrame([record(rng, k) for k in range(n)], SCHEMA)


def mismatches(recs: DataFrame) -> DataFrame:
    """Annotations whose text is not the record's substring; empty for generated records."""
    rows = recs.select("id", "text", F.explode("gold").alias("g"))
    return rows.where(~F.substring(F.col("text"), F.col("g.start") + 1, F.col("g.end") - F.col("g.start")).eqNullSafe(F.col("g.text"))).select("id", "g.*")
