"""Files tables derived from the driver's tables.

``documents`` holds prose, so the source corpus gives its lines the shapes the
line rules distinguish (every comment marker of every language, blank and
indented lines, Unicode whitespace, CRLF, a byte-order mark) and its files every
known extension. The same formula is in ``oracle.py``.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codetally.sources.checkpoints import ensure_checkpoint_dir
from codetally.sources.dimensions import (
    LANGUAGES,
    LICENSE_FILENAMES,
    LICENSE_FINGERPRINTS,
    extension_rows,
)

DIRECTORIES = [
    "src", "lib", "dist", "node_modules", ".git", "redistribute", "a/b", "./src", "a/./b", "a//b",
]
EXTENSIONS = [*(ext for ext, *_ in extension_rows()), ".md", ".PY", ".", ""]
PAGE_EXTENSIONS = [".html", ".htm", ".xhtml", ".svg", ".HTML", ".php"]
LICENSE_NAMES = [
    "LICENSE", "license.md", "Copying.TXT", "README.md", "LICENSE-MIT", "LICENSE.html", "COPYING.rst",
    *map(str.capitalize, LICENSE_FILENAMES),
]
LICENSE_DIRECTORIES = ["", "", "sub/", "license/"]
DOCUMENTS_PER_LARGE_FILE = 500
# Setting of the caller's session: partitions for tables stored as few splits.
PARTITIONS = "codetally.workload.partitions"
PHRASES = [phrase for _, phrases in LICENSE_FINGERPRINTS for phrase in phrases]

MARKERS = sorted(
    {marker for _, _, single, opener, *_ in LANGUAGES for marker in [*single, opener] if marker}
)

# What goes before and after line i of document d, by (i + d) modulo the number of shapes.
LINE_SHAPES = [
    ("# ", ""),
    ("// ", ""),
    ("-- ", ""),
    ("/* ", ""),
    ("\n", ""),
    ("  \t{- ", ""),
    ("", ""),
    ('"""', ""),
    ("\u00a0\u3000\n", ""),
    ("\u0085", ""),
    ("\t# ", "\r"),
    ("\ufeff// ", ""),
    *((marker, "") for marker in MARKERS),
]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(scan: DataFrame) -> DataFrame:
    """The scan, or as many partitions as the caller's session asks for: a small
    Parquet file may hold all its rows in one row group, hence in one task."""
    partitions = scan.sparkSession.conf.get(PARTITIONS, None)
    return scan.repartition(int(partitions)) if partitions else scan


def _pick(items, index: Column) -> Column:
    return F.element_at(F.lit(list(items)), (index % len(items) + 1).cast("int"))


def _shaped(line: Column, index: Column) -> Column:
    before, after = zip(*LINE_SHAPES)
    return F.concat(_pick(before, index), line, _pick(after, index))


def _shaped_text() -> Column:
    doc = F.col("doc_id")
    lines = F.transform(F.split("text", "\n", -1), lambda x, i: _shaped(x, i + doc))
    return F.array_join(lines, "\n")


def file_paths(documents: DataFrame) -> DataFrame:
    """``repo, path`` for each document, and for an empty file beside every 97th of
    them (``is_extra``); needs no text."""
    doc = F.col("doc_id")
    extras = F.when(doc % 97 == 0, F.array(F.lit(False), F.lit(True))).otherwise(
        F.array(F.lit(False))
    )
    return documents.withColumn("is_extra", F.explode(extras)).withColumns({
        "repo": F.col("source"),
        "path": F.concat(
            F.lit("r/"), "source", F.lit("/"), _pick(DIRECTORIES, doc),
            F.when(F.col("is_extra"), "/e").otherwise("/f"), doc, _pick(EXTENSIONS, doc),
        ),
    })


def source_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``repo, path, content``: one source file per document, and some empty ones.
    Every 89th is not valid UTF-8."""
    doc = F.col("doc_id")
    body = F.concat(_shaped_text(), F.when(doc % 2 == 0, "\n").otherwise("")).cast("binary")
    surrogate = F.unhex(F.lit("EDA080"))
    content = (
        F.when(F.col("is_extra"), F.lit("").cast("binary"))
        .when(doc % 89 == 88, F.concat(surrogate, body))
        .otherwise(body)
    )
    documents = spread(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    return file_paths(documents).select("repo", "path", content.alias("content"))


def large_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``repo, path, content``: the shaped texts of five hundred documents in a row
    make a file; every second one is not valid UTF-8."""
    number = F.floor(F.col("doc_id") / DOCUMENTS_PER_LARGE_FILE)
    documents = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    texts = documents.select(
        number.alias("number"), F.struct("doc_id", _shaped_text().alias("text")).alias("part")
    )
    parts = F.sort_array(F.collect_list("part"))
    joined = texts.groupBy("number").agg(
        F.concat(F.array_join(parts["text"], "\n"), F.lit("\n")).cast("binary").alias("body")
    )
    broken = F.concat("body", F.unhex(F.lit("EDA080")))
    return joined.select(
        F.lit("large").alias("repo"),
        F.concat(F.lit("r/large/f"), "number", _pick(EXTENSIONS, F.col("number"))).alias("path"),
        F.when(F.col("number") % 2 == 1, broken).otherwise(F.col("body")).alias("content"),
    )


def source_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``repo, path`` of the source files, read without their content."""
    documents = table(spark, sf_dir, "documents").select("doc_id", "source")
    return file_paths(documents).select("repo", "path")


def page_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``repo, path, content``: one file per web page, its host as repository."""
    page = F.col("page_id")
    return spread(table(spark, sf_dir, "pages")).select(
        F.split_part("url", F.lit("/"), F.lit(3)).alias("repo"),
        F.concat(F.lit("w/"), page, _pick(PAGE_EXTENSIONS, page)).alias("path"),
        F.col("html").cast("binary").alias("content"),
    )


def license_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``doc_id, text``: each document followed by up to two fingerprint phrases,
    the first in capitals, so that every licence and many ties occur."""
    doc, pairs = F.col("doc_id"), len(PHRASES) + 1
    phrases = [*PHRASES, ""]
    first, second = _pick(phrases, doc), _pick(phrases, F.floor(doc / pairs))
    text = F.concat("text", F.lit("\n"), F.upper(first), F.lit("\n"), second)
    documents = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return documents.select("doc_id", text.alias("text"))


def license_repos(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``repo, path, content``: a repository per document with one candidate
    licence file, half of them not in its root, and one with an empty file beside
    every 97th."""
    doc = F.col("doc_id")
    kinds = F.when(doc % 97 == 0, F.array(F.lit("p/"), F.lit("p/e"))).otherwise(
        F.array(F.lit("p/"))
    )
    repo = F.concat("kind", doc)
    return license_texts(spark, sf_dir).withColumn("kind", F.explode(kinds)).select(
        repo.alias("repo"),
        F.concat(
            repo, F.lit("/"), _pick(LICENSE_DIRECTORIES, doc), _pick(LICENSE_NAMES, doc)
        ).alias("path"),
        F.when(F.col("kind") == "p/e", F.lit("")).otherwise(F.col("text"))
        .cast("binary").alias("content"),
    )


def new_folder(spark: SparkSession, kind: str) -> str:
    """A path in the shared folder that no run has used."""
    return f"{ensure_checkpoint_dir(spark)}/{kind}-{uuid.uuid4().hex}"


def write_tree(files: DataFrame) -> str:
    """Write a files table as real files below a new folder; returns the folder."""
    root = new_folder(files.sparkSession, "tree")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if "://" in root or root.startswith("file:"):
            system, base = fs.FileSystem.from_uri(root)
        else:
            system, base = fs.LocalFileSystem(), root
        for batch in batches:
            for row in batch.to_pylist():
                target = f"{base}/{row['path']}"
                system.create_dir(target.rpartition("/")[0], recursive=True)
                with system.open_output_stream(target, compression=None) as stream:
                    stream.write(row["content"])
            yield pa.RecordBatch.from_pydict({"files": [batch.num_rows]})

    files.select("path", "content").mapInArrow(write, "files long").agg(F.sum("files")).collect()
    return root
