"""Licence detection on any relation with a text column.

Scoring is written as literal expressions over the 31 live phrases, so it stays
in the row: no join, no shuffle.
"""

from __future__ import annotations

from collections import Counter

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codetally.functions import licenses as lic
from codetally.functions import paths
from codetally.functions.matching import AUTOMATON_BYTES, found_numbers
from codetally.sources import dimensions as dims
from codetally.sources.files_table import LICENSE_PARTITION


def license_files(files: DataFrame, root: str | Column = "") -> DataFrame:
    """Files directly in ``root`` whose name, in any case, is a licence name.

    ``root`` is a path or a column (one root per repository); adds ``file``.
    On a table from :func:`write_files_table` only the partition with licence
    names is read.
    """
    if LICENSE_PARTITION in files.columns:
        files = files.where(LICENSE_PARTITION)
    root = F.lit(root) if isinstance(root, str) else root
    prefix = F.when((root == "") | F.endswith(root, F.lit("/")), root).otherwise(
        F.concat(root, F.lit("/"))
    )
    path, name = F.col("path"), paths.basename(F.col("path"))
    return files.where(
        paths.is_license_name(path) & (path == F.concat(prefix, name))
    ).withColumn("file", name)


def _phrases() -> list[tuple[int, str, int, list[str]]]:
    grouped: dict[str, tuple[int, str, int, list[str]]] = {}
    for ordinal, name, total, phrase in dims.fingerprint_rows():
        grouped.setdefault(name, (ordinal, name, total, []))[3].append(phrase)
    return list(grouped.values())


def _scored(texts: DataFrame, text: Column) -> DataFrame:
    """Add ``_scores``, an array with one struct per licence, and ``_empty``.

    The steps are separate projections so that the normalised text and every
    match count are computed once per row and used many times.
    """
    licences = _phrases()
    matches = {
        f"_matches_{ordinal}": lic.match_count("_text", phrases)
        for ordinal, _, _, phrases in licences
    }
    scores = [
        F.struct(
            lic.score(F.col(f"_matches_{ordinal}"), total).alias("score"),
            F.lit(ordinal).alias("ordinal"),
            F.lit(name).alias("license"),
            F.col(f"_matches_{ordinal}").alias("matches"),
            F.lit(total).alias("total"),
        )
        for ordinal, name, total, _ in licences
    ]
    return (
        texts.withColumns({
            "_empty": text.isNull() | (text == ""),
            "_text": lic.folded(text),
        })
        .withColumn("_text", lic.trimmed_candidate(F.col("_text")))
        .withColumns(matches)
        .withColumn("_scores", F.array(*scores))
        .drop("_text", *matches)
    )


def license_scores(texts: DataFrame, text_col: str = "text") -> DataFrame:
    """One row per text and licence: ``license, ordinal, matches, total, score``
    beside the other columns of ``texts``."""
    keep = [name for name in texts.columns if name != text_col]
    # Every text has all licences; the outer form only keeps the optimizer from
    # inferring a "non-empty array" filter that would score each text twice.
    return (
        _scored(texts, F.col(text_col))
        .select(*keep, F.inline_outer("_scores"))
        .select(*keep, "license", "ordinal", "matches", "total", "score")
    )


def license_scores_of(texts: DataFrame, phrases: DataFrame, text_col: str = "text") -> DataFrame:
    """:func:`license_scores` for a table of fingerprints, ``license, ordinal, phrase``.

    Scores are as for the given fingerprints: one and a half times the share of a
    licence's phrases that occur in the normalised text, at most one; phrases count by
    row. Phrases are in normal form, lower case and without the deleted characters, and
    not empty. ``total`` counts all phrases of a licence, or is the largest ``total`` of
    its rows if the table has that column. Only licences with a match have a row. The phrases are collected, which a limit of their size bounds; a text
    is read once, however many phrases there are, and nothing is joined by all pairs.
    """
    keep = [name for name in texts.columns if name != text_col]
    given = F.col("total").cast("int") if "total" in phrases.columns else F.lit(None).cast("int")
    table = phrases.select("license", "ordinal", "phrase", given.alias("total")).where("length(phrase) > 0")
    size = table.agg(F.sum(F.octet_length("phrase"))).first()[0] or 0
    if size > AUTOMATON_BYTES:
        raise ValueError(f"phrases of {size} bytes; at most {AUTOMATON_BYTES} are matched at once")
    rows = sorted(table.collect(), key=lambda r: (r["ordinal"], r["license"], r["phrase"]))
    listed = sorted({(r["ordinal"], r["license"]) for r in rows})
    number = {licence: i for i, licence in enumerate(listed)}
    owner = [number[r["ordinal"], r["license"]] for r in rows]
    totals = Counter(owner)
    for r, i in zip(rows, owner):
        totals[i] = max(totals[i], r["total"] or 0)
    normal = F.trim(lic.folded(F.col(text_col)), F.lit(dims.WHITESPACE))
    found = found_numbers(F.coalesce(normal, F.lit("")), [r["phrase"] for r in rows])
    spark = texts.sparkSession
    names = spark.createDataFrame(pa.table({
        "number_": pa.array(range(len(listed)), pa.int32()),
        "ordinal": pa.array([o for o, _ in listed], pa.int32()),
        "license": pa.array([n for _, n in listed], pa.string()),
        "total": pa.array([totals[i] for i in range(len(listed))], pa.int32()),
    }))
    owners = F.lit(owner) if owner else F.lit(None).cast("array<int>")
    matched = texts.select(*keep, found.alias("found_")).withColumn(
        "found_", F.array_sort(F.transform("found_", lambda n: F.element_at(owners, n + 1)))
    )
    counted = matched.select(*keep, "found_", F.explode(F.array_distinct("found_")).alias("number_")).select(
        *keep, "number_", F.size(F.filter("found_", lambda n: n == F.col("number_"))).alias("matches")
    )
    return counted.join(names, "number_").select(
        *keep, "license", "ordinal", "matches", "total", lic.score_of("matches", "total").alias("score")
    )


def classify_license(texts: DataFrame, text_col: str = "text") -> DataFrame:
    """The best licence per text: ``license, ordinal, confidence, score`` beside
    the other columns of ``texts``.

    The highest score above the threshold wins, the later licence on a tie; the
    reported confidence of a hit is always 1. Without a hit the text is a custom
    licence, or unknown when it is empty.
    """
    keep = [name for name in texts.columns if name != text_col]
    passing = F.filter("_scores", lambda licence: licence["score"] > lic.MIN_SCORE)
    best = F.col("_best")
    fallback, fallback_ordinal = (
        F.when(F.col("_empty"), F.lit(unknown)).otherwise(F.lit(custom))
        for unknown, custom in [
            (dims.UNKNOWN_LICENSE, dims.CUSTOM_LICENSE),
            (dims.UNKNOWN_ORDINAL, dims.CUSTOM_ORDINAL),
        ]
    )
    return (
        _scored(texts, F.col(text_col))
        .withColumn("_best", F.array_max(passing))
        .select(
            *keep,
            F.coalesce(best["license"], fallback).alias("license"),
            F.coalesce(best["ordinal"], fallback_ordinal).alias("ordinal"),
            F.when(best.isNotNull(), 1.0).otherwise(0.0).alias("confidence"),
            F.coalesce(best["score"], F.lit(0.0)).alias("score"),
        )
    )
