"""One consistent form for text that looks the same, by embedded SQL inside Arrow partitions.

Each Arrow batch is registered with an in-process SQL engine, which drops
invisible characters, maps compatibility forms and spaces, joins accents to
their letters, and replaces look-alike letters of other scripts inside Latin
words. Words wholly in another script stay.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cloakframe.llm.lookalikes import INVISIBLE, LOOKALIKE, compatibility_forms


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def canonical_sql(relation: str = "batch", test_first: bool = True) -> str:
    """The statement that adds ``canonical`` and ``changed`` to ``k, n, t``; plain texts pass by a single test unless ``test_first`` is off."""
    forms = compatibility_forms()
    single = {a: b for a, b in forms.items() if len(b) == 1}
    several = {a: b for a, b in forms.items() if len(b) > 1}
    plain = f"translate(bare, {quoted(''.join(single))}, {quoted(''.join(single.values()))})"
    for a, b in several.items():
        plain = f"replace({plain}, {quoted(a)}, {quoted(b)})"
    alike = "".join(LOOKALIKE)
    word = f"[\\p{{Latin}}\\p{{M}}{alike}]+"
    mixed = (
        "list_distinct(list_filter(regexp_extract_all(joined, '[\\p{L}\\p{M}]+'), "
        f"lambda w: regexp_full_match(w, '{word}') and regexp_matches(w, '\\p{{Latin}}') and regexp_matches(w, '[{alike}]')))"
    )
    swap = f"list_reduce(list_prepend(joined, list_sort({mixed}, 'DESC')), lambda a, w: replace(a, w, translate(w, {quoted(alike)}, {quoted(''.join(LOOKALIKE.values()))})))"
    return f"""
        with odd as (select k, n, t, t is not null and {"regexp_matches" if test_first else "(true or regexp_matches"}(t, '[^\\x00-\\x7f\\x{{a1}}-\\x{{ac}}\\x{{ae}}-\\x{{17f}}\\x{{2010}}-\\x{{2016}}\\x{{2018}}-\\x{{201f}}\\x{{2022}}\\x{{2026}}\\x{{20ac}}]'){"" if test_first else ")"} as special from {relation}),
        stripped as (select *, case when special then regexp_replace(t, '[{INVISIBLE}]', '', 'g') else t end as bare from odd),
        mapped as (select *, case when special then nfc_normalize({plain}) else t end as joined from stripped),
        swapped as (select *, case when special then nfc_normalize({swap}) else t end as canonical from mapped)
        select k, n, canonical, special and canonical <> t as changed from swapped
    """


def canonical_text(rows: DataFrame, key: str, number: str, text: str) -> DataFrame:
    """``k, n, canonical, changed`` for each row of ``key, number, text``.

    Null texts stay null and unchanged, as do their keys; empty texts stay
    empty; repeated rows each get theirs; extra columns are ignored.
    """
    schema = "k string, n int, canonical string, changed boolean"
    wanted = rows.select(F.col(key).cast("string").alias("k"), F.col(number).cast("int").alias("n"), F.col(text).cast("string").alias("t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import duckdb

        statement = canonical_sql()
        with duckdb.connect(config={"threads": 1, "memory_limit": "400MB"}) as engine:
            for batch in batches:
                table = pa.Table.from_batches([batch])
                engine.register("batch", table)
                out = engine.sql(statement).to_arrow_table()
                engine.unregister("batch")
                columns = [pa.string(), pa.int32(), pa.string(), pa.bool_()]
                out = out.cast(pa.schema(list(zip(["k", "n", "canonical", "changed"], columns))))
                out = out.set_column(3, "changed", out.column(3).fill_null(False))
                yield from out.to_batches()

    return wanted.mapInArrow(run, schema)


def all_surfaces(records: DataFrame, gold: DataFrame) -> DataFrame:
    """``doc_id, span_no, text`` of each record text (0) and annotation surface."""
    return records.select(F.col("id").alias("doc_id"), F.lit(0).alias("span_no"), "text").unionByName(gold.select("doc_id", F.col("span_no").cast("int").alias("span_no"), "text"))


def canonical_surfaces(records: DataFrame, gold: DataFrame) -> DataFrame:
    """``doc_id, span_no, canonical, changed`` of each record text (0) and annotation surface, once; null keys are left out."""
    out = canonical_text(all_surfaces(records, gold), "doc_id", "span_no", "text").where("k is not null")
    return out.select(F.col("k").alias("doc_id"), F.col("n").alias("span_no"), "canonical", "changed").distinct()


def changed_surfaces(records: DataFrame, gold: DataFrame) -> DataFrame:
    """``doc_id, span_no`` of each record text (0) and annotation surface that the consistent form would change, once."""
    found = canonical_text(all_surfaces(records, gold), "doc_id", "span_no", "text").where("changed and k is not null and n is not null")
    return found.select(F.col("k").alias("doc_id"), F.col("n").alias("span_no")).distinct()
