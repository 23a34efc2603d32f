"""Language of records and of their stretches, by hyperdimensional profiles.

Each letter has a random vector of ``DIMENSION`` signs. A letter trigram is the
product of its letters' vectors, rotated by two, one and no places; a text is
the sum of its trigrams. A language's prototype is the sum of its labelled
texts, taken from the mean of all prototypes. Sentences are compared with the
prototypes by cosine. Since a text's vector is a sum, its dot product with a
prototype is the sum of its trigrams' dot products, which are tabulated once;
the vector's norm follows from the trigram counts, as trigrams of random
letters are orthogonal but for noise of order ``1 / sqrt(DIMENSION)``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cloakframe.llm.prose import prose_sentences

DIMENSION = 2048
SEED = 20_240_501
MIN_WORDS = 25
ROUNDS = 2
PER_LANGUAGE = 150  # labelled records read for each language's prototype
SHARPNESS = 10.0
MARGIN = 0.12  # cosine by which a sentence must prefer a record's second language
LANGUAGES = ("de", "en", "es", "fi", "fr", "it", "nl", "pl", "pt", "sv")
ALPHABET = " abcdefghijklmnopqrstuvwxyzßàáâãäåæçèéêëìíîïñòóôõöøùúûüąćęłńœśźż"

# Notations of the languages besides their two-letter codes.
NOTATION = {
    "deu": "de", "ger": "de", "german": "de", "eng": "en", "english": "en", "spa": "es", "spanish": "es", "fin": "fi", "finnish": "fi",
    "fra": "fr", "fre": "fr", "french": "fr", "ita": "it", "italian": "it", "nld": "nl", "dut": "nl", "dutch": "nl",
    "pol": "pl", "polish": "pl", "por": "pt", "portuguese": "pt", "swe": "sv", "swedish": "sv",
}

#: A few sentences and function words of each language, so that a language without labelled records still has a prototype.
SEEDS = {
    "de": "Alle Menschen sind frei und gleich an Würde und Rechten geboren und sollen einander im Geist der Brüderlichkeit begegnen. Ich habe die Abteilung in dieser Zeit mit einer neuen Planung für das Lager geleitet, weil es nicht mehr auf dem alten Stand war und wir bei den Kunden noch viel zu tun hatten.",
    "en": "All human beings are born free and equal in dignity and rights and should act towards one another in a spirit of brotherhood. In that time I led the department with a new plan for the warehouse, because it was no longer as it should have been and there was still much to do for those who had asked us.",
    "es": "Todos los seres humanos nacen libres e iguales en dignidad y derechos y deben comportarse fraternalmente los unos con los otros. Durante ese tiempo dirigí el departamento con un nuevo plan para el almacén, porque ya no estaba como debía y quedaba mucho por hacer para las personas que nos lo habían pedido.",
    "fi": "Kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan ja heidän on toimittava toisiaan kohtaan veljeyden hengessä. Johdin tuolloin osastoa uudella suunnitelmalla varastoa varten, koska se ei ollut enää kunnossa ja meillä oli vielä paljon tehtävää niille, jotka olivat sitä pyytäneet.",
    "fr": "Tous les êtres humains naissent libres et égaux en dignité et en droits et doivent agir les uns envers les autres dans un esprit de fraternité. À cette époque j'ai dirigé le service avec un nouveau plan pour le dépôt, parce qu'il n'était plus comme il fallait et qu'il restait beaucoup à faire pour ceux qui nous l'avaient demandé.",
    "it": "Tutti gli esseri umani nascono liberi ed eguali in dignità e diritti e devono agire gli uni verso gli altri in spirito di fratellanza. In quel periodo ho diretto il reparto con un nuovo piano per il magazzino, perché non era più come doveva e restava ancora molto da fare per quelli che ce lo avevano chiesto.",
    "nl": "Alle mensen worden vrij en gelijk in waardigheid en rechten geboren en behoren zich jegens elkaar in een geest van broederschap te gedragen. In die tijd leidde ik de afdeling met een nieuw plan voor het magazijn, omdat het niet meer was zoals het moest en er nog veel te doen viel voor wie ons dat hadden gevraagd.",
    "pl": "Wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw i powinni postępować wobec innych w duchu braterstwa. W tym czasie kierowałem działem według nowego planu dla magazynu, ponieważ nie było już tak, jak powinno, i zostało jeszcze dużo do zrobienia dla tych, którzy nas o to prosili.",
    "pt": "Todos os seres humanos nascem livres e iguais em dignidade e em direitos e devem agir uns para com os outros em espírito de fraternidade. Nesse tempo dirigi o departamento com um novo plano para o armazém, porque já não estava como devia e havia ainda muito que fazer para as pessoas que nos tinham pedido.",
    "sv": "Alla människor är födda fria och lika i värde och rättigheter och bör handla gentemot varandra i en anda av broderskap. Under den tiden ledde jag avdelningen med en ny plan för lagret, eftersom det inte längre var som det skulle och det fortfarande fanns mycket att göra för dem som hade bett oss om det.",
}


def named_language(label: Column) -> Column:
    """The two-letter code that a label names, in whatever notation; null where it names none of the languages."""
    low = F.lower(F.trim(label))
    head = F.split_part(F.translate(low, "_", "-"), F.lit("-"), F.lit(1))
    notation = F.create_map(*[F.lit(x) for pair in NOTATION.items() for x in pair])
    return F.when(head.isin(*LANGUAGES), head).otherwise(F.element_at(notation, low))


_CODES = np.zeros(0x250, np.int32)
for _i, _c in enumerate(ALPHABET):
    _CODES[ord(_c)] = _i


def trigrams(words: list[str]) -> np.ndarray:
    """Trigram codes of a sentence; every character outside the alphabet counts as a space."""
    raw = np.frombuffer((" " + " ".join(words).lower() + " ").encode("utf-32-le"), np.uint32)
    c = _CODES[np.where(raw < len(_CODES), raw, 0)]
    n = len(ALPHABET)
    return (c[:-2] * n + c[1:-1]) * n + c[2:]


def letter_vectors() -> np.ndarray:
    return np.random.default_rng(SEED).choice(np.array([-1, 1], np.int8), (len(ALPHABET), DIMENSION)).astype(np.float32)


def bundle(counts: np.ndarray, letters: np.ndarray) -> np.ndarray:
    """Sum of the bound trigram vectors, each as often as ``counts`` says."""
    n, out = len(ALPHABET), np.zeros(DIMENSION, np.float32)
    c = counts.reshape(n, n, n)
    second, first = np.roll(letters, 1, 1), np.roll(letters, 2, 1)
    for a in range(n):
        if c[a].any():
            out += first[a] * (second * (c[a].astype(np.float32) @ letters)).sum(0)
    return out


class Profiles:
    """Prototypes of the languages and the dot product of every trigram with each of them."""

    def __init__(self, counts: np.ndarray):
        self.counts = counts
        letters = letter_vectors()
        own = np.stack([bundle(c, letters) for c in counts])
        own /= np.maximum(np.linalg.norm(own, axis=1, keepdims=True), 1e-9)
        own -= own.mean(0)
        self.prototypes = own / np.maximum(np.linalg.norm(own, axis=1, keepdims=True), 1e-9)
        n = len(ALPHABET)
        second, first = np.roll(letters, 1, 1), np.roll(letters, 2, 1)
        table = np.empty((n, n, n, len(counts)), np.float32)
        for a in range(n):
            for k, p in enumerate(self.prototypes):
                table[a, :, :, k] = (second * (first[a] * p)) @ letters.T
        self.table = table.reshape(n**3, -1)

    def dots(self, sentences: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        """Dot product of each sentence with each prototype, and the sentences' norms."""
        grams = [trigrams(words) for words in sentences]
        sizes = np.array([len(g) for g in grams])
        flat = np.concatenate(grams)
        starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        key = np.sort(np.repeat(np.arange(len(grams)), sizes).astype(np.int64) * len(self.table) + flat)
        edge = np.concatenate([[True], key[1:] != key[:-1]])
        of = key[edge] // len(self.table)
        times = np.diff(np.append(np.nonzero(edge)[0], len(key)))
        norm = np.sqrt(np.bincount(of, times.astype(float) ** 2, len(grams)) * DIMENSION)
        return np.add.reduceat(self.table[flat], starts, axis=0), norm


def trigram_counts(sentences: list[list[str]]) -> np.ndarray:
    return np.bincount(np.concatenate([trigrams(s) for s in sentences]), minlength=len(ALPHABET) ** 3)


def fit_profiles(rows: list[tuple[str, str]], rounds: int = ROUNDS) -> Profiles:
    """Prototypes from (language, text) rows and the seeds.

    Labels may be wrong and texts mixed: after a first fit, each sentence goes
    to the language it resembles most and the prototypes are bundled again.
    """
    seeds = np.stack([trigram_counts([s.split() for s in SEEDS[k].split(". ")]) for k in LANGUAGES])
    labelled = [(LANGUAGES.index(k), words) for k, t in rows if k in LANGUAGES for _, _, words in prose_sentences(t or "")]
    counts = seeds.copy()
    for k in range(len(LANGUAGES)):
        if own := [w for j, w in labelled if j == k]:
            counts[k] += trigram_counts(own)
    profiles = Profiles(counts)
    for _ in range(rounds if labelled else 0):
        dots, _norm = profiles.dots([w for _, w in labelled])
        best = dots.argmax(1)
        counts = seeds.copy()
        for k in range(len(LANGUAGES)):
            if own := [w for (_, w), j in zip(labelled, best) if j == k]:
                counts[k] += trigram_counts(own)
        profiles = Profiles(counts)
    return profiles


def assign(dots: np.ndarray, norms: np.ndarray, words: np.ndarray) -> np.ndarray:
    """A language for each sentence of one record, of as many languages as it clearly has.

    The main language has the most words among the sentences' own choices; each
    further one explains the sentences that clear a margin over all languages
    found so far best. From the third on they need ``MIN_WORDS`` words together:
    lines of names resemble any language.
    """
    out = np.full(len(dots), np.bincount(dots.argmax(1), words, dots.shape[1]).argmax())
    best = dots[np.arange(len(dots)), out] + MARGIN * norms
    for k in range(dots.shape[1] - 1):
        over = np.maximum(dots - best[:, None], 0)
        if k:
            over[:, (words[:, None] * (over > 0)).sum(0) < MIN_WORDS] = 0
        gain = over.sum(0)
        if not gain.any():
            break
        mine = over[:, gain.argmax()] > 0
        out[mine] = gain.argmax()
        best[mine] = dots[mine, gain.argmax()] + MARGIN * norms[mine]
    return out


def identify(records: DataFrame, profiles: Profiles, key: str = "id", text: str = "text") -> DataFrame:
    """One row for each stretch: ``id, stretch_no, start_pos, end_pos, lang, confidence, n_words``.

    A stretch is a run of sentences of running prose in one language; offsets
    are code points of the text, ends exclusive. ``confidence`` is the softmax
    of the stretch's cosines with the prototypes. A text without running prose
    is one stretch of 0 words, its language that of all its letters and its
    confidence halved; without letters, null and 0. Null and empty texts have
    no stretch; repeated rows each get theirs.
    """
    schema = "id string, stretch_no int, start_pos int, end_pos int, lang string, confidence double, n_words int"
    rows = records.select(F.col(key).cast("string").alias("k"), F.col(text).alias("t")).where("t is not null and t != ''")
    shipped = records.sparkSession.sparkContext.broadcast(profiles.table)  # as many rows as there are trigrams, whatever the corpus

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Profiles.__new__(Profiles)
        known.table = shipped.value
        for batch in batches:
            out: list[tuple] = []
            spans, of, keys, sizes = [], [], batch.column(0).to_pylist(), []
            for r, t in enumerate(batch.column(1).to_pylist()):
                found = prose_sentences(t)
                counted = [len(t[a:b].split()) for a, b, _ in found]
                if not found:
                    words = [w for w in "".join(c if c.isalpha() else " " for c in t).split()]
                    if not words:
                        out.append((keys[r], 0, 0, len(t), None, 0.0, 0))
                        continue
                    found, counted = [(0, len(t), words)], [0]
                spans += found
                of += [r] * len(found)
                sizes += counted
            if spans:
                dots, norms = known.dots([w for _, _, w in spans])
                n_words = np.array(sizes)
                edges = np.flatnonzero(np.diff(of)) + 1
                for lo, hi in zip([0, *edges.tolist()], [*edges.tolist(), len(of)]):
                    lang = assign(dots[lo:hi], norms[lo:hi], np.maximum(n_words[lo:hi], 1))
                    cuts = [0, *(np.flatnonzero(np.diff(lang)) + 1).tolist(), hi - lo]
                    for no, (a, b) in enumerate(zip(cuts[:-1], cuts[1:])):
                        norm = np.sqrt((norms[lo + a : lo + b] ** 2).sum())
                        cosine = dots[lo + a : lo + b].sum(0) / max(norm, 1e-9)
                        p = np.exp(SHARPNESS * (cosine - cosine.max()))
                        k = int(lang[a])
                        total = int(n_words[lo + a : lo + b].sum())
                        out.append((keys[of[lo]], no, spans[lo + a][0], spans[lo + b - 1][1], LANGUAGES[k], float(p[k] / p.sum()) * (1.0 if total else 0.5), total))
            if out:
                columns = [*zip(*out)]
                kinds = [pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.float64(), pa.int32()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], [x.split()[0] for x in schema.split(", ")])

    return rows.mapInArrow(run, schema)


def labelled_sample(records: DataFrame, key: str = "id", text: str = "text", lang: str = "lang", per_language: int = PER_LANGUAGE) -> list[tuple[str, str]]:
    """At most ``per_language`` records for each language that a label names, chosen by a hash of their key."""
    rows = records.select(F.col(key).cast("string").alias("k"), named_language(F.col(lang)).alias("l"), F.col(text).alias("t"))
    rows = rows.where("l is not null and t is not null")
    chosen = rows.select("k", "l", F.xxhash64("k", F.lit(SEED)).alias("h")).distinct()
    chosen = chosen.selectExpr("k", "l", "row_number() over (partition by l order by h, k) as n").where(f"n <= {per_language}").select("k", "l")
    taken = rows.join(F.broadcast(chosen), ["k", "l"]).dropDuplicates(["k", "l"])
    return sorted((r.l, r.t) for r in taken.select("l", "t").collect())


def record_languages(records: DataFrame, profiles: Profiles, key: str = "id", text: str = "text", lang: str = "lang", min_words: int = MIN_WORDS) -> DataFrame:
    """One row for each record and language of at least ``min_words`` words: ``id, lang, n_words, confidence, label``.

    ``label`` is the language that the record's label names, or null. Records
    that repeat a key count once; null keys are left out.
    """
    once = records.select(F.col(key).cast("string").alias("id"), F.col(text).alias("text"), named_language(F.col(lang)).alias("label")).where("id is not null")
    stretches = identify(once.withColumn("id", F.concat_ws("\x1f", "id", F.coalesce("label", F.lit("")))), profiles, "id", "text")
    parts = F.split("id", "\x1f")
    named = stretches.select(F.element_at(parts, 1).alias("id"), F.nullif(F.element_at(parts, 2), F.lit("")).alias("label"), "stretch_no", "start_pos", "lang", "n_words", "confidence").distinct()
    words = named.groupBy("id", "label", "lang").agg(F.sum("n_words").alias("n_words"), F.sum(F.col("confidence") * F.col("n_words")).alias("c"))
    return words.where(f"n_words >= {min_words}").select("id", "lang", "n_words", (F.col("c") / F.col("n_words")).alias("confidence"), "label")
