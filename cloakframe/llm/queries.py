"""The problems' queries: name -> callable(spark, folder of the tables)."""

from __future__ import annotations

import secrets
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cloakframe.llm import canonical, langid, leakage, mixing, overlap, privacy, reading, splitting
from cloakframe.session import table


def _profiles(spark: SparkSession, sf_dir: str) -> langid.Profiles:
    return langid.fit_profiles(langid.labelled_sample(table(spark, sf_dir, "datasets")))


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = table(spark, sf_dir, "datasets")
    found = langid.record_languages(records, _profiles(spark, sf_dir))
    return found.where("label is null or label <> lang").select("id", "lang").distinct()


def p1_stretches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "datasets").dropDuplicates(["id"]), _profiles(spark, sf_dir))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return canonical.changed_surfaces(table(spark, sf_dir, "datasets"), table(spark, sf_dir, "gold"))


def p2_canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return canonical.canonical_surfaces(table(spark, sf_dir, "datasets"), table(spark, sf_dir, "gold"))


def _pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splitting.split_texts(table(spark, sf_dir, "datasets"), table(spark, sf_dir, "size_limits"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splitting.oversized(_pieces(spark, sf_dir))


def p3_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    once = _pieces(spark, sf_dir).dropDuplicates(["id"])
    return once.select("id", "split", F.explode("pieces").alias("p")).select("id", "split", "p.*")


def p3_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Violations of what pieces promise, over all of them."""
    return splitting.piece_checks(_pieces(spark, sf_dir))


def _secret(spark: SparkSession) -> str:
    """The key of the surrogates: the session's ``spark.cloakframe.surrogate.key``, else a new random one for this query."""
    return spark.conf.get("spark.cloakframe.surrogate.key", None) or secrets.token_hex(16)


def _items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return privacy.all_items(table(spark, sf_dir, "datasets"), table(spark, sf_dir, "judge_errors__s3__h2__none"), _secret(spark))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _items(spark, sf_dir).select("place", "id", "item_no", "start_pos", "end_pos", "label")


def p4_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Violations of what a surrogate promises, over all items: format, coreference, distinctness."""
    return privacy.surrogate_checks(_items(spark, sf_dir))


def p4_masked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return privacy.mask_texts(table(spark, sf_dir, "datasets").dropDuplicates(["id"]), _secret(spark))


def p4_surfaces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The annotation's surfaces, each wholly masked by its detected or, failing that, its annotated type."""
    rows = table(spark, sf_dir, "datasets").where("gold is not null").dropDuplicates(["id"]).select("id", F.posexplode("gold").alias("k", "g"))
    return privacy.mask_surfaces(rows.select("id", (F.col("k") + 1).alias("item_no"), F.col("g.label").alias("label"), F.col("g.text").alias("text")), _secret(spark))


def p4_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The judge errors' leaked texts, masked with their record's names, numbers and surrogates."""
    return privacy.mask_leaks(table(spark, sf_dir, "datasets"), table(spark, sf_dir, "judge_errors__s3__h2__none"), _secret(spark))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overlap.record_pairs(*overlap.cross_split_overlaps(table(spark, sf_dir, "datasets"))).select("id_a", "id_b")


def p5_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overlap.overlap_report(*overlap.cross_split_overlaps(table(spark, sf_dir, "datasets")))


def _leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leakage.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "holdout_items"))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _leaks(spark, sf_dir).select("doc_id", "item_id")


def p6_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leakage.leaked_items(_leaks(spark, sf_dir))


def p7_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    chosen, _ = mixing.mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"))
    return chosen


def p7_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.reached_shares(*mixing.mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets")))


def p7_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Violations of what a mix promises."""
    return mixing.mix_checks(*mixing.mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets")))


def _levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reading.reading_levels(table(spark, sf_dir, "documents"), table(spark, sf_dir, "reading_anchors"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _levels(spark, sf_dir).where("english and not cv and band in ('basic', 'advanced')").select("doc_id", "band")


def p8_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _levels(spark, sf_dir)


def p8_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reading.source_profile(_levels(spark, sf_dir))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    named = [
        p1_found, p1_stretches, p2_found, p2_canonical, p3_found, p3_pieces, p3_checks,
        p4_found, p4_masked, p4_surfaces, p4_leaks, p4_checks, p5_found, p5_report,
        p6_found, p6_items, p7_mix, p7_shares, p7_checks, p8_found, p8_levels, p8_profile,
    ]
    return {f.__name__: f for f in named}
