"""Rows of a files table with very large contents, cut into rows that fit a task.

The tree scan cuts large files while it reads them. A table from elsewhere may hold
a file of up to 2 GB in one value; splitting that into an array of all its lines
takes many times its size. Here the value is cut at line ends first.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codetally.sources.files_table import FIRST_LINE

ROW_BYTES = 16 << 20


def cut_large_rows(files: DataFrame, row_bytes: int = ROW_BYTES) -> DataFrame:
    """``files`` with contents of more than ``row_bytes`` in several rows, and ``first_line``.

    Text is cut at the first line end after every ``row_bytes``, and ``first_line``
    numbers the first line of each row, as :func:`read_listed_files` does; a longer
    line stays whole. What is not UTF-8 is cut anywhere and has -1 minus the byte
    position. Rows that need no cut, NULL contents included, keep their ``first_line``
    or get NULL. Other columns are repeated.

    All statistics of the result equal those of ``files``. Nothing is shuffled. Of the
    parts only positions are held, and they are taken out of the value one by one as
    rows; the reader and the step that cuts hold the value itself a few times.
    """
    if row_bytes < 1:
        raise ValueError("row_bytes is at least 1")
    has_line = FIRST_LINE in files.columns
    others = [c for c in files.columns if c not in ("content", FIRST_LINE)]
    size = "octet_length(content)"

    def part(start: str, length: str) -> str:
        return f"substring(content, cast({start} AS INT) + 1, cast({length} AS INT))"

    # Bytes before the next line end, from the byte before a multiple of row_bytes on.
    gap = f"octet_length(substring_index(cast({part('s - 1', str(row_bytes))} AS STRING), '\n', 1))"
    begins = (
        f"filter(transform(sequence(0L, {size} - 1L, {row_bytes}L),"
        f" s -> if(s = 0, 0L, if({gap} < least({row_bytes}L, {size} - s + 1), s + {gap}, NULL))),"
        f" s -> s < {size})"
    )
    spans = f"transform(begins, (s, i) -> struct(s AS start, coalesce(get(begins, i + 1), {size}) - s AS length))"
    text = part("p.start", "p.length")
    line_ends = f"octet_length({text}) - octet_length(replace(cast({text} AS STRING), '\n', ''))"
    before = f"cast({FIRST_LINE} AS BIGINT)" if has_line else "cast(NULL AS BIGINT)"
    numbered = (
        f"element_at(transform(array({begins}), begins -> aggregate(transform({spans},"
        f" p -> struct(p.start AS start, p.length AS length, cast({line_ends} AS BIGINT) AS lines)),"
        f" struct(coalesce({before}, 0L) AS line, cast(array() AS array<struct<start: bigint, length: bigint, line: bigint>>) AS out),"
        " (acc, p) -> struct(acc.line + p.lines AS line,"
        " array_append(acc.out, struct(p.start AS start, p.length AS length, acc.line AS line)) AS out),"
        " acc -> acc.out)), 1)"
    )
    fixed = (
        f"transform(sequence(0L, {size} - 1L, {row_bytes}L), s -> struct(s AS start,"
        f" least({row_bytes}L, {size} - s) AS length, coalesce({before}, -1L) - s AS line))"
    )
    whole = f"array(struct(0L AS start, cast({size} AS BIGINT) AS length, {before} AS line))"
    is_text = f"is_valid_utf8(cast(content AS STRING)) AND coalesce({before}, 0L) >= 0"
    # All in the generator itself: a projection before it would copy the value. The outer
    # form keeps the optimizer from computing the parts once more in a filter.
    parts = f"CASE WHEN coalesce({size} <= {row_bytes}, true) THEN {whole} WHEN {is_text} THEN {numbered} ELSE {fixed} END"
    rows = files.select(*others, "content", F.expr(f"inline_outer({parts})"))
    taken = f"if(start = 0 AND length = {size}, content, {part('start', 'length')})"
    return rows.select(*others, F.expr(taken).alias("content"), F.col("line").alias(FIRST_LINE)).select(
        *files.columns, *([] if has_line else [FIRST_LINE])
    )
