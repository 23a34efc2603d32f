"""Names carried through a document, and the net under every masked surface.

What to look for follows from a document's array of spans by column
expressions; where it occurs is found in one Arrow pass over the document, for
names, web addresses and the net together.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cloakframe.functions import fixed, textops
from cloakframe.operators import rules
from cloakframe.operators import spans as sp

UNSAFE = sorted({*fixed.MONTHS, *fixed.COMMON_WORDS, *fixed.FIELD_LABELS, *textops.EVERY_SECTION_WORD})
_ARROW_FOUND = pa.list_(pa.struct([("start_pos", pa.int32()), ("end_pos", pa.int32()), ("label", pa.string()), ("src", pa.string()), ("surface", pa.string())]))


def _safe(token: Column) -> Column:
    return ~textops.is_tech(token) & ~F.lower(token).isin(*UNSAFE) & (F.length(token) > 2)


def known_names(spans: Column, mode: str = "surname") -> Column:
    """``array<struct<full, single>>``: full names, and the single words of each that may be looked for again.

    Seeds are names from rules anywhere, and from models in the header, footer,
    personal and references sections. Elements carry ``label, surface, src, section``.
    """
    seed = lambda s: (s["label"] == "NAME") & (s["src"].startswith("re") | s["section"].isin("header", "footer", "personal", "references"))
    credential = lambda w: (F.upper(w) == w) & (F.lower(w) != w) & (F.length(w) <= 5)

    def words(s: Column) -> Column:
        closed = F.when(s["src"] == "re-spaced", F.regexp_replace(s["surface"], r"(?<=\S) (?=\S)", "")).otherwise(s["surface"])
        each = F.filter(F.regexp_extract_all(closed, F.lit(r"([\p{L}\p{N}_'’-]+)"), F.lit(1)), lambda w: F.length(w) > 1)
        return textops.let(each, lambda w: F.when((F.size(w) > 2) & (s["src"] != "re-spaced"), F.filter(w, lambda x: ~credential(x))).otherwise(w))

    def known(w: Column) -> Column:
        last = F.element_at(w, -1)
        parts = F.when(last.contains("-"), F.filter(F.split(last, "-"), lambda x: F.length(x) > 3)).otherwise(F.expr("cast(array() as array<string>)"))
        single = F.concat(F.array(last), parts)
        if mode == "all":
            single = F.concat(single, F.filter(F.slice(w, F.lit(1), F.size(w) - 1), lambda x: ~F.lower(x).isin(*fixed.NAME_LINKS)))
        return F.struct(F.array_join(w, " ").alias("full"), F.filter(single, _safe).alias("single"))

    return F.array_distinct(F.transform(F.filter(F.transform(F.filter(spans, seed), words), lambda w: F.size(w) >= 2), known))


def carried(text: str, names: list[dict]) -> Iterator[tuple[int, int, str, str]]:
    """(start, end, label, src) of further spans: full names as written and in capitals, single words, and web addresses that bear a name."""
    for full in dict.fromkeys(x for n in names for x in (n["full"], n["full"].upper())):
        yield from ((a, a + len(full), "NAME", "prop") for a in sp.occurrences(text, full))
    for word in dict.fromkeys(w for n in names for w in n["single"]):
        for a in sp.occurrences(text, word):
            b = a + len(word)
            if not (a and (text[a - 1].isalnum() or text[a - 1] in "_@.")) and not (b < len(text) and (text[b].isalnum() or text[b] == "_")):
                yield a, b, "NAME", "prop"
    keys = [re.findall(r"\w+", n["full"].lower()) for n in names]
    for a, b in {*rules.links(text), *rules.domains(text)} if keys else ():
        address = text[a:b].lower().translate(_JOINTS)
        if any("".join(k) in address or len(k) > 1 and len(k[-1]) > 3 and k[-1] in address for k in keys if k):
            yield a, b, "URL", "prop"


_JOINTS = {ord(c): None for c in "-._"}


def net(text: str, spans: list[tuple[str, str]]) -> Iterator[tuple[int, int, str, str]]:
    """(start, end, label, "net") of every exact occurrence of every masked (surface, label); the first one's label stands. Case counts.

    Surfaces are stripped; they need four characters, or three in capitals for a school.
    """
    first: dict[str, str] = {}
    for surface, label in spans:
        t = surface.strip(" ")
        if label in fixed.SAFETY_LABELS and (len(t) >= 4 or label == "EDU_ORG" and len(t) == 3 and t.isupper()):
            first.setdefault(t, label)
    for t, label in first.items():
        yield from ((a, a + len(t), label, "net") for a in sp.occurrences(text, t))


def spread(docs: DataFrame, propagate: bool, with_net: bool) -> DataFrame:
    """``doc_id, text, spans, found``: what names and the net add to a document's ``spans``, for ``names`` as in ``known_names``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, spans, names in zip(*(batch.column(k).to_pylist() for k in range(1, 4))):
                more = sorted({*carried(text, names)}) if propagate else []
                if with_net:
                    more += sorted(net(text, [(s["surface"], s["label"]) for s in spans] + [(text[a:b], label) for a, b, label, _ in more]))
                out.append([(a, b, label, src, text[a:b]) for a, b, label, src in more])
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array([[dict(zip(("start_pos", "end_pos", "label", "src", "surface"), x)) for x in row] for row in out], _ARROW_FOUND)], ["doc_id", "text", "spans", "found"])

    found = "array<struct<start_pos:int,end_pos:int,label:string,src:string,surface:string>>"
    rows = docs.select("doc_id", "text", "spans", "names")
    kind = rows.schema["spans"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id string, text string, spans {kind}, found {found}")


def safety_net(docs: DataFrame, spans: DataFrame, order: str = "span_id") -> DataFrame:
    """The net for rows of spans: a document's surfaces meet its text once. The label is that of the least ``order``."""
    text = F.btrim("surface")
    short = (F.col("label") == "EDU_ORG") & (F.length(text) == 3) & (F.upper(text) == text) & (F.lower(text) != text)
    wanted = spans.where(F.col("label").isin(*fixed.SAFETY_LABELS) & ((F.length(text) >= 4) | short))
    first = wanted.groupBy("doc_id", text.alias("surface")).agg(F.min_by("label", order).alias("label"))
    return sp.locate_all(docs, first).withColumn("src", F.lit("net"))
