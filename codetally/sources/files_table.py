"""The stored form of a files table.

Scanning a source tree is worth doing once: afterwards the rows live in a Parquet
table that splits by bytes and prunes columns. Files with a licence name form a
partition of their own, so that licence reports do not read all source code.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codetally.functions.paths import is_license_name

LICENSE_PARTITION = "license_name"

# Rows are long. Parquet looks at its buffers every hundred rows at the earliest
# unless told otherwise, and row groups of half the usual size leave readers, who
# decompress them, some room. Readers decode up to 4,096 rows of a row group into one
# buffer, and the tree scan makes rows of up to a megabyte: hence the limit of rows.
WRITE_OPTIONS = {
    "parquet.block.size": str(64 << 20),
    "parquet.block.row.count.limit": "256",
    "parquet.block.size.row.check.min": "1",
    "parquet.page.size.row.check.min": "1",
}

# One writer per partition value, so that rows need no sort by it.
CONCURRENT_WRITERS = "spark.sql.maxConcurrentOutputFileWriters"

# Optional column of a files table. A large file may be several rows, cut after
# line ends; this is the number of a row's first line, NULL for a whole file, and
# -1 minus the byte position for a part of a file that is not UTF-8.
FIRST_LINE = "first_line"


def first_rows() -> Column:
    """True for the row that stands for its file."""
    return F.coalesce(FIRST_LINE, F.lit(0)).isin(0, -1)


def is_text_row() -> Column:
    return F.coalesce(FIRST_LINE, F.lit(0)) >= 0


def rows_to_count(files: DataFrame) -> DataFrame:
    """Without the further parts of files that are not UTF-8, which have no lines."""
    return files.where(F.coalesce(FIRST_LINE, F.lit(0)) >= -1)


def write_files_table(files: DataFrame, location: str, mode: str = "errorifexists") -> None:
    """Store a files table; ``mode="append"`` adds more repositories."""
    first_line = F.col(FIRST_LINE) if FIRST_LINE in files.columns else F.lit(None)
    conf = files.sparkSession.conf
    before = conf.get(CONCURRENT_WRITERS)
    rows = files.select(
        "repo",
        "path",
        "content",
        first_line.cast("long").alias(FIRST_LINE),
        is_license_name(F.col("path")).alias(LICENSE_PARTITION),
    )
    conf.set(CONCURRENT_WRITERS, "2")
    try:
        rows.write.options(**WRITE_OPTIONS).partitionBy(LICENSE_PARTITION).mode(mode).parquet(location)
    finally:
        conf.set(CONCURRENT_WRITERS, before)


def read_files_table(spark: SparkSession, location: str) -> DataFrame:
    """The stored rows."""
    schema = (
        f"repo string, path string, content binary, {FIRST_LINE} long, "
        f"{LICENSE_PARTITION} boolean"
    )
    return spark.read.schema(schema).parquet(location)
