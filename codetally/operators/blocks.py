"""Line kinds with block comments followed from line to line.

The statistics of this package look at the start of a line alone. Here the inside of a
block comment counts as comment too. It is a reading of its own, not the default.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from codetally.functions import lines
from codetally.operators.stats import FILE_KEY, SINGLE_MARKERS, _file_lines, _kind
from codetally.sources import dimensions as dims
from codetally.sources.files_table import FIRST_LINE, first_rows

# Blocks nested deeper count as that deep, so that a state is one of a few numbers.
MAX_DEPTH = 15
# Lines of which states are collected in one array.
SCAN_LINES = 128
BLOCKS = pa.schema([
    ("ordinal", pa.int32()), ("opener", pa.string()), ("closer", pa.string()), ("nested", pa.bool_()), ("tokens", pa.string()),
])


def _blocks(spark: SparkSession) -> DataFrame:
    """54 rows: openers, closers and a regular expression for either; NULL without blocks."""
    rows = []
    for ordinal, (_, _, _, opener, closer, nested) in enumerate(dims.LANGUAGES):
        either = "|".join(sorted(map(re.escape, {opener, closer}), key=len, reverse=True)) if opener else None
        rows.append((ordinal, opener or None, closer or None, nested, either))
    return spark.createDataFrame(pa.table([pa.array(c, f.type) for c, f in zip(zip(*rows), BLOCKS)], schema=BLOCKS))


def _step(depth: str, line: str) -> str:
    """SQL for the depth after a line, left-trimmed, that begins at ``depth``."""
    single = " OR ".join(f"coalesce(startswith({line}, {m}), false)" for m in SINGLE_MARKERS)
    token = (
        f"CASE WHEN opener = closer THEN 1 - x WHEN t = opener THEN if(nested, least(x + 1, {MAX_DEPTH}), 1)"
        " ELSE greatest(x - 1, 0) END"
    )
    walked = f"aggregate(regexp_extract_all({line}, tokens, 0), {depth}, (x, t) -> {token})"
    return f"CASE WHEN tokens IS NULL OR ({depth} = 0 AND ({single})) THEN {depth} ELSE {walked} END"


def _depths(start: str) -> str:
    """SQL for the depth at the start of each line, in blocks of lines so that arrays stay short."""
    cut = f"transform(sequence(0, size(trimmed) div {SCAN_LINES}), b -> slice(trimmed, b * {SCAN_LINES} + 1, {SCAN_LINES}))"
    starts = (
        f"aggregate(cut__, struct({start} AS d, cast(array() AS array<int>) AS out), (acc, blk) -> struct("
        f"aggregate(blk, acc.d, (d, l) -> {_step('d', 'l')}) AS d, array_append(acc.out, acc.d) AS out), acc -> acc.out)"
    )
    within = (
        f"aggregate(blk, struct(s AS d, cast(array() AS array<int>) AS out), (acc, l) -> struct("
        f"{_step('acc.d', 'l')} AS d, array_append(acc.out, acc.d) AS out), acc -> acc.out)"
    )
    return f"element_at(transform(array({cut}), cut__ -> flatten(zip_with(cut__, {starts}, (blk, s) -> {within}))), 1)"


def lines_with_blocks(files: DataFrame, **filters) -> DataFrame:
    """:func:`classified_lines` with block comments: ``repo, path, language, is_other, pos, kind``.

    A line that begins inside a block is ``multi`` unless blank; any other has its
    usual kind. Openers and closers are followed wherever they stand in a line, but not
    on a line that begins outside of a block with a single-line marker; strings are not
    looked at. Blocks nest in languages whose do, up to ``MAX_DEPTH`` deep; where opener
    and closer are the same, they take turns. Languages without blocks have their usual
    kinds, but for those with an empty opener, whose lines are code.

    A file in several rows (``first_line``) gives what it gives in one: each row is
    walked once from every depth, rows without text count for nothing, and the walks of
    a file's rows are put together in order, which shuffles a few numbers a row.
    """
    cut = FIRST_LINE in files.columns
    keep = [*FILE_KEY, "ordinal", *([FIRST_LINE] if cut else [])]
    read = _file_lines(files, keep, filters).join(F.broadcast(_blocks(files.sparkSession)), "ordinal", "left")
    trimmed = F.col("pieces")
    for step in lines.LEFT_TRIM_STEPS:
        trimmed = F.transform(trimmed, step)
    read = read.withColumn("trimmed", trimmed).drop("pieces")
    if cut:
        read = read.join(_first_depths(read), [*FILE_KEY[:2], FIRST_LINE], "left")
    start = "coalesce(start_depth, 0)" if cut else "0"
    walked = read.withColumn("depths", F.expr(f"if(trimmed IS NULL, NULL, {_depths(start)})"))
    rows = walked.select(
        *FILE_KEY, *([FIRST_LINE] if cut else []), *SINGLE_MARKERS, F.col("opener").alias("multi_start"),
        F.posexplode(F.arrays_zip("trimmed", "depths")).alias("at", "line"),
    )
    at = F.col("at").cast("long") + (F.coalesce(FIRST_LINE, F.lit(0)) if cut else F.lit(0))
    usual = F.coalesce(_kind(F.col("line.trimmed")), F.lit("code"))
    kind = F.when((F.col("line.depths") > 0) & (F.col("line.trimmed") != ""), "multi").otherwise(usual)
    return rows.select(*FILE_KEY, at.alias("pos"), kind.alias("kind"))


def _first_depths(read: DataFrame) -> DataFrame:
    """``repo, path, first_line, start_depth`` of the rows of cut files."""
    outcome = F.expr(
        f"transform(sequence(0, {MAX_DEPTH}), d0 -> aggregate(trimmed, d0, (d, l) -> {_step('d', 'l')}))"
    )
    parts = read.where(F.col(FIRST_LINE).isNotNull() & F.col("trimmed").isNotNull()).select(
        *FILE_KEY[:2], FIRST_LINE, outcome.alias("outcome")
    )
    before = Window.partitionBy(*FILE_KEY[:2]).orderBy(FIRST_LINE)
    number = F.row_number().over(before) - 1
    listed = parts.withColumn("number", number).groupBy(*FILE_KEY[:2]).agg(
        F.sort_array(F.collect_list(F.struct("number", FIRST_LINE, "outcome"))).alias("rows")
    )
    chained = F.expr(
        "aggregate(rows, struct(0 AS d, cast(array() AS array<struct<first_line: bigint, start_depth: int>>) AS out),"
        " (acc, r) -> struct(element_at(r.outcome, acc.d + 1) AS d,"
        " array_append(acc.out, struct(r.first_line AS first_line, acc.d AS start_depth)) AS out), acc -> acc.out)"
    )
    return listed.select(*FILE_KEY[:2], F.inline(chained))


def stats_with_blocks(files: DataFrame, by=(), **filters) -> DataFrame:
    """Line counts per language, and per ``repo`` or ``path`` in ``by``, with block comments."""
    counted = lines_with_blocks(files, **filters)
    kinds = [F.count_if(F.col("kind") == kind).alias(kind) for kind in ("blank", "code", "single", "multi")]
    return counted.groupBy(*by, "language", "is_other").agg(*kinds)
