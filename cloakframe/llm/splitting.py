"""Oversized texts cut into overlapping pieces at natural boundaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cloakframe.functions.textops import let, prefix_ends

# Other names of the splits.
SPLIT_ALIAS = {"dev": "devsynth", "h3": "devhard", "h2": "holdout", "test": "probe20"}
ID_PREFIX = {"DEV": "devsynth", "H3": "devhard", "H2": "holdout", "CV": "probe20"}


def split_name(split: Column, key: Column | None = None) -> Column:
    """The split's full name in lower case; where it is null or empty, the one that the id's prefix stands for."""
    low = F.lower(F.trim(split))
    name = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for p in SPLIT_ALIAS.items() for x in p]), low), F.nullif(low, F.lit("")))
    if key is None:
        return name
    prefix = F.element_at(F.create_map(*[F.lit(x) for p in ID_PREFIX.items() for x in p]), F.split_part(key, F.lit("-"), F.lit(1)))
    return F.coalesce(name, prefix)


def step_pattern(step: Column, overlap: Column) -> Column:
    """A pattern whose successive matches are the new parts of successive pieces.

    Alternatives stand in order of the boundary's strength: the rest of the
    text, a paragraph, a line, a sentence, a clause, a word, and characters as
    the last resort. All but the last two take at least half of the step. The
    first piece has at least the overlap's length, so that the second can share it.
    """
    half = F.greatest(F.floor(step / 2), overlap, F.lit(1)).cast("int")
    full = F.format_string("{%d,%d}", F.least(half, step), step)
    any_ = F.format_string("{1,%d}", step)
    first = F.format_string("{%d,%d}", F.least(F.greatest(overlap, F.lit(1)), step), step)
    return F.concat(
        F.lit("(?s)."), any_, F.lit(r"\z"),
        F.lit("|."), full, F.lit(r"(?<=\n[ \t\r]{0,4}\n)"),
        F.lit("|."), full, F.lit(r"(?<=\n)"),
        F.lit("|."), full, F.lit(r"(?<=[.!?…][\"”’)]{0,2}\s)"),
        F.lit("|."), full, F.lit(r"(?<=[,;:]\s)"),
        F.lit(r"|(?:\A."), first, F.lit(r"|(?!\A)."), any_, F.lit(r")(?<=\s)"),
        F.lit("|."), any_,
    )


def split_texts(records: DataFrame, limits: DataFrame, key: str = "id", text: str = "text", split: str = "split") -> DataFrame:
    """One row for each record longer than its split's limit: ``id, split, max_chars, overlap_chars, longest_unbroken, pieces``.

    ``pieces`` is an array of ``piece_no, start_pos, end_pos, piece``: each piece
    has at most ``max_chars`` characters, begins ``overlap_chars`` before the
    former's end, and together they cover the whole text. Lengths and offsets
    are code points, so no character is torn. Null and short texts and splits
    without a limit have no row; an overlap not below the limit is taken as one
    less than the limit; null limits are ignored; of repeated limits the least
    counts. Repeated records each get their row; extra columns are ignored.
    The limits are a table of a few rows (one for each split).
    """
    bounds = (
        limits.select(F.lower(F.trim("split")).alias("split"), "max_chars", "overlap_chars")
        .where("split is not null and max_chars > 0")
        .groupBy("split")
        .agg(F.min(F.struct("max_chars", "overlap_chars")).alias("b"))
        .select("split", F.col("b.max_chars").alias("max_chars"), F.least(F.greatest(F.coalesce("b.overlap_chars", F.lit(0)), F.lit(0)), F.col("b.max_chars") - 1).alias("overlap_chars"))
    )
    rows = records.select(F.col(key).cast("string").alias("id"), split_name(F.col(split), F.col(key).cast("string")).alias("split"), F.col(text).alias("text"))
    long = rows.join(bounds, "split").where(F.length("text") > F.col("max_chars"))
    step = F.col("max_chars") - F.col("overlap_chars")
    fresh = F.regexp_extract_all("text", step_pattern(step, F.col("overlap_chars")), F.lit(0))

    def laid(ends: Column) -> Column:
        start = lambda i: F.when(i == 0, F.lit(0)).otherwise(F.greatest(F.get(ends, i - 1) - F.col("overlap_chars"), F.lit(0)))
        piece = lambda end, i: F.struct((i + 1).cast("int").alias("piece_no"), start(i).cast("int").alias("start_pos"), end.cast("int").alias("end_pos"), F.substring(F.col("text"), start(i) + 1, end - start(i)).alias("piece"))
        return F.transform(ends, piece)

    pieces = let(prefix_ends(F.transform(fresh, lambda x: F.length(x))), laid)
    unbroken = F.array_max(F.transform(F.split("text", r"(?U)\s+"), F.length))
    return long.select("id", "split", "max_chars", "overlap_chars", unbroken.alias("longest_unbroken"), pieces.alias("pieces"))


def oversized(split: DataFrame) -> DataFrame:
    """``id, cut``: forced where an unbroken stretch is itself longer than the limit; each id once."""
    cut = F.when(F.col("longest_unbroken") > F.col("max_chars"), "forced").otherwise("natural")
    return split.where("size(pieces) > 1").select("id", cut.alias("cut")).distinct()


def piece_checks(split: DataFrame) -> DataFrame:
    """``test, n_violations``: no piece above the limit, consecutive ones share the overlap, pieces are the text's own and cover it."""
    rows = split.select("max_chars", "overlap_chars", "pieces", F.posexplode("pieces").alias("k", "p"))
    before = F.get("pieces", F.col("k") - 1)
    too_long = F.col("p.end_pos") - F.col("p.start_pos") > F.col("max_chars")
    apart = (F.col("k") > 0) & (before["end_pos"] - F.col("p.start_pos") != F.col("overlap_chars"))
    other = F.length("p.piece") != F.col("p.end_pos") - F.col("p.start_pos")
    gap = (F.col("k") == 0) & (F.col("p.start_pos") != 0) | (F.col("k") > 0) & ((F.col("p.start_pos") > before["end_pos"]) | (F.col("p.end_pos") <= before["end_pos"]))
    counts = rows.agg(*(F.count_if(c).alias(n) for n, c in (("limit", too_long), ("overlap", apart), ("substring", other), ("cover", gap))))
    return counts.select(F.explode(F.create_map(*[x for n in ("limit", "overlap", "substring", "cover") for x in (F.lit(n), F.col(n))])).alias("test", "n_violations"))
