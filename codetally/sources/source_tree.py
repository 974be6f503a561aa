"""Scan of source trees on a file system into ``(repo, path, content, first_line)`` rows.

The built-in ``binaryFile`` and ``text`` readers skip hidden, underscore and
empty files, all of which have to be counted, so the tree is listed and read by
Python tasks. The listing is a relation of its own, ``(repo, path, size, place)``
without content: it hands back directories until none is left, stays a distributed
table throughout and can be filtered and counted. The reads then fetch the files
that are left, packed into tasks by size; large files are read by byte ranges.
Neither passes through the driver.

Local paths and any file system that ``pyarrow.fs`` opens on all executors will do.
"""

from __future__ import annotations

import codecs
import math
import os
import posixpath
import sys
import urllib.parse
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext, cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from codetally.functions.paths import is_license_name
from codetally.sources.checkpoints import ensure_checkpoint_dir

# Ship the functions below with the tasks; executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

DIRECTORIES_PER_TASK = 1_000  # directories a listing task is given
ENTRIES_PER_WALK = 50_000  # entries a task lists before it hands back subdirectories
ENTRIES_PER_BATCH = 10_000
BYTES_PER_READ = 128 << 20  # content one read task should see
FILES_PER_READ = 10_000
# Reads stream, so that more tasks per core than these only enlarge the shuffle.
LISTINGS_PER_CORE, READS_PER_CORE = 4, 16
BYTES_PER_BATCH = 32 << 20  # content held in one Arrow batch
BYTES_PER_PART = 1 << 20  # larger files become several rows
BYTES_PER_RANGE = 64 << 20  # what one task reads of such a file at a time
MAX_ROW_BYTES = (2 << 30) - (64 << 20)  # what one binary value can hold

ENTRY_FIELDS = pa.schema([
    ("repo", pa.string()),
    ("root", pa.string()),
    ("name", pa.string()),  # relative to root; empty for the root itself
    ("raw", pa.binary()),  # the bytes of a local name, which need not be UTF-8
    ("pending", pa.bool_()),  # a directory still to be listed
    ("size", pa.int64()),
    ("link", pa.string()),  # the directory that a link leads to, where it is still to be listed
])
ENTRY_SCHEMA = (
    "repo string, root string, name string, raw binary, pending boolean, size long, link string"
)

# What reading needs of a listed file.
PLACE = "struct<root:string,name:string,raw:binary>"
RANGE_FIELDS = pa.schema([
    ("repo", pa.string()),
    ("path", pa.string()),
    ("root", pa.string()),
    ("name", pa.string()),
    ("raw", pa.binary()),
    ("size", pa.int64()),
    ("start", pa.int64()),
    ("lines", pa.int64()),  # lines that start in the range
    ("is_text", pa.bool_()),  # NULL where it cannot be read
])
RANGE_SCHEMA = (
    "repo string, path string, root string, name string, raw binary, size long, start long, "
    "lines long, is_text boolean"
)
READ_FIELDS = pa.schema([
    *(field for field in RANGE_FIELDS if field.name not in ("lines", "is_text")),
    ("first_line", pa.int64()),
    ("is_text", pa.bool_()),
    ("split", pa.int32()),  # the task that reads it
])
READ_SCHEMA = (
    "repo string, path string, root string, name string, raw binary, size long, start long, "
    "first_line long, is_text boolean, split int"
)

FILE_FIELDS = pa.schema([
    ("repo", pa.string()),
    ("path", pa.string()),
    ("content", pa.binary()),
    ("first_line", pa.int64()),
])
FILE_SCHEMA = "repo string, path string, content binary, first_line long"


class TooLong(OSError):
    """A line or licence file that does not fit in a row."""


def read_source_tree(
    spark: SparkSession,
    root: str,
    repo: str | None = None,
    prune=(),
    on_error: str = "fail",
) -> DataFrame:
    """The files under one directory, or one single file."""
    row = pa.table({"repo": [repo if repo is not None else root], "root": [root]})
    return read_source_trees(spark.createDataFrame(row), prune, on_error)


def read_source_trees(roots: DataFrame, prune=(), on_error: str = "fail", links: str = "new") -> DataFrame:
    """The files of many checkouts, given as a table ``(repo, root)``.

    :func:`list_source_trees` and :func:`read_listed_files` in one; every file that
    is listed is read. To read only files that are counted, filter in between.
    """
    return read_listed_files(list_source_trees(roots, prune, on_error, links=links), on_error)


def list_source_tree(spark: SparkSession, root: str, repo: str | None = None, **options) -> DataFrame:
    """The files under one directory, or one single file, without their content."""
    row = pa.table({"repo": [repo if repo is not None else root], "root": [root]})
    return list_source_trees(spark.createDataFrame(row), **options)


def list_source_trees(
    roots: DataFrame,
    prune=(),
    on_error: str = "fail",
    max_depth: int | None = None,
    names=None,
    links: str = "new",
) -> DataFrame:
    """The files of many checkouts, ``(repo, root)``, as ``repo, path, size, place``.

    No file is opened. ``prune`` takes the fragments :func:`eligible_files` will
    ignore (see :func:`ignore_fragments`): directories they match are not descended
    into. Files at most ``max_depth`` levels below their root are listed, and
    directories below that are not looked at: one level is one directory a root.
    ``names`` leaves only files of those names, in any case.

    Directories that cannot be listed fail the job unless ``on_error`` is ``"skip"``
    or ``"null"``, which leave them out. Links to files are files. A link to a
    directory that it is below of is never followed. Of the others, ``links="new"``
    follows those to directories that no link on a shorter chain of links has led
    to, ``links="every"`` each on every way, which for directories that link to each
    other are very many, and ``links="none"`` none.

    Bytes of local names that are not UTF-8 appear as ``\\xff`` in ``path``.
    """
    if on_error not in ("fail", "skip", "null"):
        raise ValueError("on_error is one of fail, skip, null")
    if links not in ("new", "every", "none"):
        raise ValueError("links is one of new, every, none")
    ensure_checkpoint_dir(roots.sparkSession)
    rules = ListingRules(
        list(prune), on_error, max_depth, None if names is None else {n.lower() for n in names}, links
    )
    found = _list_trees(roots, rules)
    root, name = F.col("root"), F.col("name")
    joined = F.when((root == "") | F.endswith(root, F.lit("/")), F.concat(root, name)).otherwise(
        F.concat(root, F.lit("/"), name)
    )
    return found.select(
        "repo", F.when(name == "", root).otherwise(joined).alias("path"), "size",
        F.struct("root", "name", "raw").cast(PLACE).alias("place"),
    )


def read_listed_files(listing: DataFrame, on_error: str = "fail") -> DataFrame:
    """``repo, path, content, first_line`` of the files of a listing.

    ``listing`` is what :func:`list_source_trees` gives, with any rows left out;
    ``path`` may have been changed, ``place`` says what is read.

    A file up to ``BYTES_PER_PART`` and any licence file is one row, whose
    ``first_line`` is NULL. A larger file is several rows: text is cut after line
    ends and ``first_line`` numbers the first line of each; what is not UTF-8 is
    cut anywhere, and ``first_line`` is -1 minus the byte position of each.

    What cannot be read, and a licence file or a line that does not fit in a row,
    fails the job. With ``on_error="skip"`` it is left out, and with
    ``on_error="null"`` a file, or the part that the line would be, is a row without
    content (counted as a file without lines).

    Files and ranges are packed into tasks of about equal numbers of bytes.
    """
    if on_error not in ("fail", "skip", "null"):
        raise ValueError("on_error is one of fail, skip, null")
    spark = listing.sparkSession
    ensure_checkpoint_dir(spark)
    found = listing.select("repo", "path", "place.root", "place.name", "place.raw", "size")
    is_large = (F.col("size") > BYTES_PER_PART) & ~is_license_name(F.col("path"))
    reads = found.select(
        *found.columns, *(F.lit(None).cast(kind).alias(name) for name, kind in
                          (("start", "long"), ("first_line", "long"), ("is_text", "boolean")))
    )
    if found.where(is_large).limit(1).count():
        ranges = _measured_ranges(found.where(is_large), on_error)
        reads = reads.where(~is_large).unionByName(ranges)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _read_files(batches, on_error)

    packed, tasks = packed_reads(reads)
    # Kept, too: a task that is lost repeats its reads only.
    return packed.checkpoint().repartitionById(tasks, F.col("split")).mapInArrow(read, FILE_SCHEMA)


def _read_bytes() -> Column:
    """What a row of reads costs: its bytes, and some for opening a file."""
    whole = F.when(F.col("start").isNull(), F.col("size"))
    return F.coalesce(whole, F.least(F.col("size") - F.col("start"), F.lit(BYTES_PER_RANGE))) + F.lit(
        BYTES_PER_READ // FILES_PER_READ
    )


def packed_reads(reads: DataFrame) -> tuple[DataFrame, int]:
    """``reads`` with the task (``split``) of each row, and the number of tasks.

    The bytes before a row, over all rows, decide its task, so that no task has more
    than its share and one row. The sums need no shuffle: the driver sees one number
    for each partition of the listing, which is kept so that both passes see the same.
    """
    cores = reads.sparkSession.sparkContext.defaultParallelism
    reads = reads.coalesce(LISTINGS_PER_CORE * cores).withColumn("bytes", _read_bytes()).checkpoint()
    sums = {
        r["part"]: (r["bytes"], r["files"])
        for r in reads.groupBy(F.spark_partition_id().alias("part"))
        .agg(F.sum("bytes").alias("bytes"), F.count(F.lit(1)).alias("files")).collect()
    }
    total, files = (sum(s[i] for s in sums.values()) for i in (0, 1))
    tasks = max(math.ceil(total / BYTES_PER_READ), min(files, cores), 1)
    tasks = min(tasks, READS_PER_CORE * cores)
    share = max(1, math.ceil(total / tasks))
    before, start = {}, 0
    for part in sorted(sums):
        before[part] = start
        start += sums[part][0]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        position = before.get(TaskContext.get().partitionId(), 0)
        for batch in batches:
            weights = batch.column("bytes").to_numpy()
            starts = position + np.cumsum(weights) - weights
            position += int(weights.sum())
            split = pa.array(np.minimum(starts // share, tasks - 1), pa.int32())
            columns = [split if f.name == "split" else batch.column(f.name) for f in READ_FIELDS]
            yield pa.RecordBatch.from_arrays(columns, schema=READ_FIELDS)

    return reads.mapInArrow(place, READ_SCHEMA), tasks


class ListingRules(NamedTuple):
    """What a listing leaves out."""

    fragments: list[str]
    on_error: str
    max_depth: int | None
    names: set[str] | None
    links: str


def _list_trees(roots: DataFrame, rules: ListingRules) -> DataFrame:
    """All files as ``(repo, root, name, raw, size)``; one job per round of listing.

    A task lists every directory it is given, and their subdirectories up to its
    share of entries; the next round spreads the rest over all tasks again. There
    are thus at most as many rounds as levels, however many directories a level
    has. Every round is checkpointed: a lost executor repeats only its round.

    Links that are not followed on every way wait until no directory is left. Those
    to directories that earlier ones led to, for the same root, are then dropped.
    """
    cores = roots.sparkSession.sparkContext.defaultParallelism

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _walk(batches, rules)

    frontier = roots.select(
        "repo", "root", F.lit("").alias("name"), F.lit("").cast("binary").alias("raw"),
        F.lit(True).alias("pending"), F.lit(0).cast("long").alias("size"),
        F.lit(None).cast("string").alias("link"),
    )
    found = waiting = seen = None
    key = ["repo", "root", "link"]
    while (pending := frontier.count()) or found is None or waiting is not None:
        if not pending and waiting is not None:
            fresh = waiting.join(seen, key, "left_anti") if seen is not None else waiting
            fresh = fresh.select(*ENTRY_FIELDS.names).checkpoint()
            taken = fresh.select(*key).distinct()
            seen = (taken if seen is None else seen.unionByName(taken)).checkpoint()
            frontier, waiting = fresh, None
            continue
        tasks = max(min(pending, cores), math.ceil(pending / DIRECTORIES_PER_TASK), 1)
        listed = frontier.repartition(tasks).mapInArrow(walk, ENTRY_SCHEMA).checkpoint()
        files = listed.where(~F.col("pending"))
        found = files if found is None else found.unionByName(files)
        frontier = listed.where("pending AND link IS NULL")
        new_links = listed.where("pending AND link IS NOT NULL")
        if rules.links == "new" and new_links.limit(1).count():
            waiting = new_links if waiting is None else waiting.unionByName(new_links)
    return found.drop("pending", "link")


def _measured_ranges(large: DataFrame, on_error: str) -> DataFrame:
    """The byte ranges of large files, each with its first line and whether the
    file is text. A first pass counts lines; only counts are shuffled by file."""

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _measure(batches, on_error)

    cores = large.sparkSession.sparkContext.defaultParallelism
    step = F.lit(BYTES_PER_RANGE).cast("long")
    starts = F.sequence(F.lit(0).cast("long"), F.col("size") - 1, step)
    # All ranges but the last of a file are equally long: dealing them out is even.
    measured = (
        large.withColumn("start", F.explode(starts))
        .repartition(READS_PER_CORE * cores)
        .mapInArrow(measure, RANGE_SCHEMA)
    )
    place = ["repo", "path", "root", "name", "raw", "size"]
    file = Window.partitionBy("repo", "path", "root", "name", "raw")
    before = file.orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    return measured.select(
        *place, "start",
        F.coalesce(F.sum("lines").over(before), F.lit(0)).alias("first_line"),
        F.when(F.count("is_text").over(file) == F.count("*").over(file),
               F.bool_and("is_text").over(file)).alias("is_text"),
    ).where(F.col("is_text").isNotNull() | (F.col("start") == 0)).checkpoint()


class Systems:
    """The file systems of the roots a task meets, each opened once."""

    def __init__(self):
        self.opened = {}

    def __call__(self, root: str) -> tuple[fs.FileSystem | None, bytes | str]:
        """A file system, None for the local one, and the place of the root on it."""
        if root not in self.opened:
            if root.startswith("file:"):
                path = urllib.parse.unquote(root.removeprefix("file:").removeprefix("//"))
                self.opened[root] = None, os.fsencode(os.path.abspath(path))
            elif "://" in root:
                quoted = urllib.parse.quote(root, safe="/:?&=%@+,;#~!$'()*[]")
                self.opened[root] = fs.FileSystem.from_uri(quoted)
            else:
                self.opened[root] = None, os.fsencode(os.path.abspath(root))
        return self.opened[root]

    def open(self, entry: dict):
        system, base = self(entry["root"])
        if system is None:
            return open(posixpath.join(base, entry["raw"]) if entry["raw"] else base, "rb")
        return system.open_input_file(_join(base, entry["name"]))


def _join(root: str, name: str) -> str:
    return posixpath.join(root, name) if name else root


def _shown(raw: bytes) -> str:
    return raw.decode("utf-8", "backslashreplace")


def _normalised(path: str) -> str:
    kept = "/".join(part for part in path.split("/") if part not in ("", "."))
    return "/" + kept if path.startswith("/") else kept


def _is_loop(base: bytes, raw: bytes) -> bool:
    """A link to a directory that the way to it, or that one's real way, goes through."""
    target = os.path.realpath(posixpath.join(base, raw)).rstrip(b"/") + b"/"
    parts = raw.split(b"/")[:-1]
    above = (posixpath.join(base, *parts[:depth]) for depth in range(len(parts) + 1))
    return any((os.path.realpath(place) + b"/").startswith(target) for place in above)


def _walk(batches: Iterator[pa.RecordBatch], rules: ListingRules) -> Iterator[pa.RecordBatch]:
    """The files in the given directories and below, and the directories left
    unlisted once the task has seen its share of entries."""
    systems, rows, stack, budget = Systems(), [], [], ENTRIES_PER_WALK

    def listed(directory: tuple) -> Iterator[None]:
        nonlocal budget
        try:
            for entry in _list_directory(systems, *directory, rules):
                budget -= 1
                pending, link = entry[4], entry[6]
                if pending and link is None and budget > 0:
                    stack.append(entry[:4])
                else:
                    rows.append(entry)
                    if len(rows) >= ENTRIES_PER_BATCH:
                        yield
        except OSError:
            if rules.on_error == "fail":
                raise

    def full() -> Iterator[pa.RecordBatch]:
        if rows:
            yield _batch(rows, ENTRY_FIELDS)
            rows.clear()

    for batch in batches:
        for row in batch.to_pylist():
            for _ in listed((row["repo"], row["root"], row["name"], row["raw"])):
                yield from full()
    while stack and budget > 0:
        for _ in listed(stack.pop()):
            yield from full()
    rows.extend((*directory, True, 0, None) for directory in stack)
    yield from full()


def _list_directory(
    systems: Systems, repo: str, root: str, name: str, raw: bytes, rules: ListingRules
) -> Iterator[tuple]:
    """The files in a directory, and its subdirectories that are not ignored, one by
    one; a root that is a file is that file."""

    def wanted(child: str) -> bool:
        return rules.names is None or posixpath.basename(child).lower() in rules.names

    def entered(child: str) -> bool:
        if rules.max_depth is not None and child.count("/") + 1 >= rules.max_depth:
            return False
        logical = _normalised(_join(root, child))
        return not any(fragment in logical for fragment in rules.fragments)

    system, base = systems(root)
    if system is None:
        if not name and not os.path.lexists(base):
            raise FileNotFoundError(f"path does not exist: {root}")
        if not name and os.path.isfile(base):
            if wanted(root):
                yield repo, root, "", b"", False, os.path.getsize(base), None
            return
        with os.scandir(posixpath.join(base, raw) if raw else base) as entries:
            for entry in entries:
                inner = posixpath.join(raw, entry.name) if raw else entry.name
                child = _shown(inner)
                try:
                    if entry.is_file():
                        if wanted(child):
                            yield repo, root, child, inner, False, entry.stat().st_size, None
                    elif entry.is_dir() and entered(child):
                        link = None
                        if entry.is_symlink():
                            if rules.links == "none" or _is_loop(base, inner):
                                continue
                            if rules.links == "new":
                                target = entry.stat()
                                link = f"{target.st_dev}:{target.st_ino}"
                        yield repo, root, child, inner, True, 0, link
                except OSError:
                    if rules.on_error == "fail":
                        raise
        return
    if not name:
        info = system.get_file_info(base)
        if info.type == fs.FileType.NotFound:
            raise FileNotFoundError(f"path does not exist: {root}")
        if info.type == fs.FileType.File:
            if wanted(root):
                yield repo, root, "", None, False, info.size, None
            return
    for info in system.get_file_info(fs.FileSelector(_join(base, name))):
        child = _join(name, info.base_name) if name else info.base_name
        if info.type == fs.FileType.File:
            if wanted(child):
                yield repo, root, child, None, False, info.size, None
        elif info.type == fs.FileType.Directory and entered(child):
            yield repo, root, child, None, True, 0, None


def _batch(rows: list[tuple], fields: pa.Schema) -> pa.RecordBatch:
    columns = [pa.array(values, field.type) for values, field in zip(zip(*rows), fields)]
    return pa.RecordBatch.from_arrays(columns, schema=fields)


def _measure(batches: Iterator[pa.RecordBatch], on_error: str) -> Iterator[pa.RecordBatch]:
    """The lines that start in each range, and whether its bytes are text."""
    systems = Systems()
    for batch in batches:
        rows = []
        for entry in batch.to_pylist():
            try:
                with systems.open(entry) as stream:
                    measured = _line_starts_and_text(stream, entry["start"], entry["size"])
            except OSError:
                if on_error == "fail":
                    raise
                measured = (0, None)
            place = (entry[key] for key in RANGE_FIELDS.names[:7])
            rows.append((*place, *measured))
        if rows:
            yield _batch(rows, RANGE_FIELDS)


def _is_continuation(byte: int) -> bool:
    return byte & 0xC0 == 0x80


def _line_starts_and_text(stream, start: int, size: int) -> tuple[int, bool]:
    """A character across the edge of two ranges belongs to the first, which also
    takes up to three continuation bytes that follow it; the second leaves them out."""
    end = min(start + BYTES_PER_RANGE, size)
    lines, is_text, decoder = int(start == 0), True, codecs.getincrementaldecoder("utf-8")()
    if start:
        stream.seek(start - 1)
        lines += stream.read(1) == b"\n"
    position, lead = start, 3 if start else 0
    while position < end and (block := stream.read(min(BYTES_PER_PART, end - position))):
        position += len(block)
        # A line starts after a line end, unless that is the last byte of the range.
        lines += block.count(b"\n") - (position == end and block.endswith(b"\n"))
        while lead and block and _is_continuation(block[0]):
            block, lead = block[1:], lead - 1
        lead = 0 if block else lead
        if is_text:
            try:
                decoder.decode(block)
            except UnicodeDecodeError:
                is_text = False
    if is_text:
        tail = stream.read(3) if end < size else b""
        kept = 0
        while kept < len(tail) and _is_continuation(tail[kept]):
            kept += 1
        try:
            decoder.decode(tail[:kept], final=True)
        except UnicodeDecodeError:
            is_text = False
    return lines, is_text


def _read_files(batches: Iterator[pa.RecordBatch], on_error: str) -> Iterator[pa.RecordBatch]:
    """The rows of all listed files and ranges, in batches bounded by content size."""
    systems, rows, held = Systems(), [], 0
    for batch in batches:
        for entry in batch.to_pylist():
            path = entry["path"]
            for content, first_line in _pieces(systems, entry, path, on_error):
                length = len(content or b"")
                if rows and held + length > BYTES_PER_BATCH:
                    yield _batch(rows, FILE_FIELDS)
                    rows, held = [], 0
                rows.append((entry["repo"], path, content, first_line))
                held += length
    if rows:
        yield _batch(rows, FILE_FIELDS)


def _pieces(
    systems: Systems, entry: dict, path: str, on_error: str
) -> Iterator[tuple[bytes | None, int | None]]:
    """``(content, first_line)`` of each row of a file or range."""
    start, first_line = entry["start"], entry["first_line"]
    if start is not None and entry["is_text"] is None:  # could not be measured
        if on_error == "null":
            yield None, None
        return
    try:
        with systems.open(entry) as stream:
            if start is None:
                if entry["size"] > MAX_ROW_BYTES:
                    raise TooLong(f"{path}: {entry['size']} bytes do not fit in one row")
                yield stream.read(), None
            elif entry["is_text"]:
                end = min(start + BYTES_PER_RANGE, entry["size"])
                for content, first_line in _line_parts(stream, start, end, first_line):
                    if content is None and on_error == "fail":
                        raise TooLong(f"{path}: a line does not fit in one row")
                    if content is not None or on_error == "null":
                        yield content, first_line
            else:
                first_line = -1 - start
                stream.seek(start)
                end = min(start + BYTES_PER_RANGE, entry["size"])
                while start < end and (block := stream.read(min(BYTES_PER_PART, end - start))):
                    yield block, -1 - start
                    start += len(block)
                    first_line = -1 - start
    except OSError:
        if on_error == "fail":
            raise
        if on_error == "null":
            yield None, first_line


def _line_parts(
    stream, start: int, end: int, first_line: int
) -> Iterator[tuple[bytes | None, int]]:
    """The lines that start in ``[start, end)``, in parts that end with a line, and
    the number of the first line of each; None for a line that is too long."""
    position = max(start - 1, 0)
    stream.seek(position)
    searching, done, too_long = start > 0, False, False
    open_line, held = [], 0
    while not done and (block := stream.read(BYTES_PER_PART)):
        if searching:
            found = block.find(b"\n", 0, max(end - 1 - position, 0))
            if found < 0:
                position += len(block)
                if position >= end - 1:
                    return
                continue
            block, searching = block[found + 1:], False
            position += found + 1
        last = block.find(b"\n", max(end - 1 - position, 0))
        if last >= 0:
            block, done = block[:last + 1], True
        position += len(block)
        if too_long:
            ended = block.find(b"\n") + 1
            if not ended:
                continue
            block, too_long, first_line = block[ended:], False, first_line + 1
        cut = block.rfind(b"\n") + 1
        if cut:
            part = b"".join([*open_line, block[:cut]])
            yield part, first_line
            first_line += part.count(b"\n")
            open_line, held = [], 0
        if cut < len(block):
            open_line.append(block[cut:])
            held += len(block) - cut
        if held > MAX_ROW_BYTES - BYTES_PER_PART:
            yield None, first_line
            open_line, held, too_long = [], 0, True
    if held:
        yield b"".join(open_line), first_line
