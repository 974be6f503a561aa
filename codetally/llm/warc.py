"""WARC archives and their two-level capture index."""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codetally.llm.storage import file_system, new_path, stage

FILE_BYTES = 1 << 30
LINES_PER_BLOCK = 2_000
# Shards of the index; their first keys are what a lookup task gets from the driver.
MAX_SHARDS = 4_096
ROOT_KEY_CHARS = 128
READ_BYTES = 4 << 20
LEVEL = 4
DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

RECORDS = "page_id long, key string, record_type string, digest string, file string, offset long, length long"
SHARDS = "first string, last string, shard string"
READ = (
    "page_id long, record_type string, refers_to long, payload_digest string, payload_bytes long, payload binary"
)


@dataclass
class Archive:
    """A folder of archives: ``captures`` is the list of records, ``root`` the first and last key of each shard."""

    folder: str
    captures: DataFrame
    root: list[tuple[str, str, str]]


def url_key(url: str | None) -> str:
    """A URL with its host reversed, so that the captures of a domain stand together.

    ``https://www.Example.org:80/a?b#c`` gives ``org,example,www:80)/a?b``. White
    space is percent-encoded. Null gives an empty key.
    """
    head, mark, rest = (url or "").partition("://")
    if not mark:
        head, rest = "", head
    parts = re.match(r"([^/?#]*)([^#]*)", rest)
    host, colon, port = parts[1].partition(":")
    turned = ",".join(reversed(host.lower().split(".")))
    key = f"{turned}{colon}{port}){parts[2] or '/'}" if mark else rest
    return re.sub(r"\s", lambda m: "".join(f"%{b:02X}" for b in m[0].encode()), key)


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode("ascii")


def _record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool) -> tuple[bytes, str]:
    """A record as a gzip member, and its payload digest."""
    digest = base32_sha1(payload)
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n"
    block = http.encode("ascii") + (b"" if revisit else payload)
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        f"WARC-Date: {DATE}",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"WARC-Block-Digest: sha1:{base32_sha1(block)}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if url is not None:
        lines.append("WARC-Target-URI: " + re.sub(r"\s", lambda m: "".join(f"%{b:02X}" for b in m[0].encode()), url))
    if revisit:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    head = "\r\n".join(lines).encode("utf-8") + b"\r\n\r\n"
    packer = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return packer.compress(head + block + b"\r\n\r\n") + packer.flush(), digest


def parse_record(data: bytes) -> dict:
    """Headers and block of a record; raises ``ValueError`` if the block's digest is wrong."""
    raw = zlib.decompress(data, 31)
    head, _, rest = raw.partition(b"\r\n\r\n")
    headers = dict(line.split(": ", 1) for line in head.decode("utf-8").split("\r\n")[1:])
    block = rest[: int(headers["Content-Length"])]
    if headers["WARC-Block-Digest"] != f"sha1:{base32_sha1(block)}":
        raise ValueError(f"damaged record {headers['WARC-Record-ID']}")
    return {"headers": headers, "payload": block.partition(b"\r\n\r\n")[2]}


def _page(uri: str | None) -> int | None:
    number = (uri or "").removeprefix("<urn:page:").rstrip(">")
    return int(number) if number else None


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
    fields = [f.split(" ") for f in schema.split(", ")]
    columns = zip(*rows) if rows else [[] for _ in fields]
    return pa.RecordBatch.from_arrays(
        [pa.array(list(c), kinds[kind]) for c, (_, kind) in zip(columns, fields)], names=[n for n, _ in fields]
    )


def with_revisits(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """``page_id, url, html, refers_to, revisit`` for rows with those first three columns.

    Of rows with equal payloads of at least ``min_bytes`` bytes, those with the
    largest ``page_id`` are responses, the others revisit it. A null html is an
    empty payload; rows with a null ``page_id`` revisit if any other has an id.

    Only digests are grouped, with partial sums; those that occur once need no join
    partner, so the join is as small as the number of repeated payloads, and AQE
    splits a payload that very many rows have.
    """
    hashed = pages.select(
        "page_id", "url", "html", F.sha1(F.coalesce("html", F.lit(""))).alias("sha1"),
        F.coalesce(F.octet_length("html"), F.lit(0)).alias("size"),
    )
    repeated = stage(
        hashed.where(F.col("size") >= min_bytes).groupBy("sha1")
        .agg(F.max("page_id").alias("winner"), F.count("*").alias("n"))
        .where("n > 1").select("sha1", "winner"),
        "repeated-payloads",
    )
    revisit = F.coalesce(F.expr("winner IS NOT NULL AND NOT (page_id <=> winner)"), F.lit(False))
    return hashed.join(repeated, "sha1", "left").select(
        "page_id", "url", "html", F.when(revisit, F.col("winner")).alias("refers_to"), revisit.alias("revisit")
    )


def write_archive(pages: DataFrame, min_bytes: int = 0, lines_per_block: int = LINES_PER_BLOCK) -> Archive:
    """Write a record per row of ``pages`` (``page_id, url, html``) and index them.

    Every record is a gzip member of its own in files of about one gigabyte; other
    columns are not read, repeated rows give repeated records, and an empty table
    gives an archive without records. Tasks write files of new names and report
    them in their rows, so what a lost or repeated task wrote is never read.
    """
    spark = pages.sparkSession
    folder = new_path(spark, "warc")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = file_system(folder)
        system.create_dir(base, recursive=True)
        stream, name, at = None, "", 0
        try:
            for batch in batches:
                rows = []
                for page_id, url, html, refers_to, revisit in zip(*(c.to_pylist() for c in batch.columns)):
                    if stream is None or at >= FILE_BYTES:
                        if stream:
                            stream.close()
                        name, at = f"part-{uuid.uuid4().hex}.warc.gz", 0
                        stream = system.open_output_stream(f"{base}/{name}", compression=None)
                    record, digest = _record(page_id, url, (html or "").encode("utf-8"), refers_to, revisit)
                    stream.write(record)
                    kind = "revisit" if revisit else "response"
                    rows.append((page_id, url_key(url), kind, digest, name, at, len(record)))
                    at += len(record)
                yield _batch(rows, RECORDS)
        finally:
            if stream:
                stream.close()

    rows = with_revisits(pages.select("page_id", "url", "html"), min_bytes)
    captures = stage(rows.mapInArrow(write, RECORDS), "captures")
    return Archive(folder, captures, _write_index(captures, folder, lines_per_block))


def _write_index(captures: DataFrame, folder: str, lines_per_block: int) -> list[tuple[str, str, str]]:
    """Sorted compressed blocks of index lines in shards, a directory of blocks beside each.

    Shards are ranges of key and page, so that a URL with very many captures goes
    over several. Returns the first and last key, cut short, and the name of each
    shard, in order.
    """
    spark = captures.sparkSession
    shards = min(MAX_SHARDS, int(spark.conf.get("spark.sql.shuffle.partitions")))
    order = ["key", "page_id", "file", "offset"]

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = file_system(folder)
        name, first = uuid.uuid4().hex, None
        directory, lines, at = [], [], 0
        stream = None

        def end_block() -> None:
            nonlocal at, lines
            packer = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
            data = packer.compress("\n".join(lines).encode("utf-8")) + packer.flush()
            stream.write(data)
            directory.append(f"{lines[0].split(chr(9), 1)[0]}\t{at}\t{len(data)}")
            at, lines = at + len(data), []

        for batch in batches:
            for key, page_id, kind, digest, file, offset, length in zip(*(c.to_pylist() for c in batch.columns)):
                if stream is None:
                    stream, first = system.open_output_stream(f"{base}/index-{name}.gz", compression=None), key
                lines.append(f"{key}\t{'' if page_id is None else page_id}\t{kind}\t{digest}\t{file}\t{offset}\t{length}")
                if len(lines) >= lines_per_block:
                    end_block()
        if stream:
            if lines:
                end_block()
            stream.close()
            with system.open_output_stream(f"{base}/directory-{name}.gz", compression=None) as out:
                packer = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
                out.write(packer.compress("\n".join(directory).encode("utf-8")) + packer.flush())
            yield _batch([(first[:ROOT_KEY_CHARS], key[:ROOT_KEY_CHARS], name)], SHARDS)

    written = (
        captures.select(*order[:2], "record_type", "digest", *order[2:], "length")
        .repartitionByRange(shards, *order)
        .sortWithinPartitions(*order)
        .mapInArrow(write, SHARDS)
    )
    return sorted(tuple(r) for r in stage(written, "shards").collect())


def lookup(spark: SparkSession, archive: Archive, keys: DataFrame) -> DataFrame:
    """The captures (columns of ``RECORDS``) of each key in column ``key`` of ``keys``.

    Repeated and null keys change nothing; unknown keys give no row. A task binary
    searches the first keys of the shards, then the directory of a shard, and names
    the blocks that may hold a key; the blocks are dealt to tasks, each is read by a
    range read once per task and its lines are binary searched. A key with very many
    captures is in many blocks, hence in many tasks.
    """
    folder, root = archive.folder, archive.root
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    starts, ends = [first for first, _, _ in root], [last for _, last, _ in root]

    def find_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = file_system(folder)
        loaded, firsts, blocks = None, [], []
        for batch in batches:
            rows = []
            for key in batch.column(0).to_pylist():
                short = key[:ROOT_KEY_CHARS]
                low, high = bisect_left(ends, short), bisect_right(starts, short)
                for _, _, shard in root[low:high]:
                    if shard != loaded:
                        with system.open_input_file(f"{base}/directory-{shard}.gz") as source:
                            text = zlib.decompress(source.read(), 31).decode("utf-8")
                        blocks = [line.split("\t") for line in text.split("\n")]
                        firsts, loaded = [b[0] for b in blocks], shard
                    start, stop = max(0, bisect_left(firsts, key) - 1), bisect_right(firsts, key)
                    rows += [(key, shard, int(b[1]), int(b[2])) for b in blocks[start:stop]]
            yield _batch(rows, "key string, shard string, offset long, length long")

    def read_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = file_system(folder)
        source, opened, at, lines, line_keys = None, None, None, [], []
        for batch in batches:
            rows = []
            for key, shard, offset, length in zip(*(c.to_pylist() for c in batch.columns)):
                if shard != opened:
                    if source:
                        source.close()
                    source, opened, at = system.open_input_file(f"{base}/index-{shard}.gz"), shard, None
                if offset != at:
                    text = zlib.decompress(source.read_at(length, offset), 31).decode("utf-8")
                    lines, at = text.split("\n"), offset
                    line_keys = [line.split("\t", 1)[0] for line in lines]
                for line in lines[bisect_left(line_keys, key) : bisect_right(line_keys, key)]:
                    k, page_id, kind, digest, file, start, size = line.split("\t")
                    rows.append((int(page_id) if page_id else None, k, kind, digest, file, int(start), int(size)))
            yield _batch(rows, RECORDS)
        if source:
            source.close()

    wanted = keys.select("key").where("key IS NOT NULL").distinct()
    located = wanted.repartitionByRange(tasks, "key").sortWithinPartitions("key").mapInArrow(
        find_blocks, "key string, shard string, offset long, length long"
    )
    dealt = located.repartition(tasks, "shard", "offset").sortWithinPartitions("shard", "offset", "key")
    return dealt.mapInArrow(read_blocks, RECORDS)


def read_records(spark: SparkSession, archive: Archive, captures: DataFrame) -> DataFrame:
    """``READ`` for each of ``captures``, by range reads of the archives.

    Captures are sorted by place, and those that stand together are read at once.
    The payload of a revisit is null and its length unknown; digest and referred
    page are those of its header.
    """
    folder = archive.folder
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = file_system(folder)
        source, opened, start, data = None, None, 0, b""
        for batch in batches:
            rows, held = [], 0
            for file, offset, length in zip(*(c.to_pylist() for c in batch.columns)):
                if file != opened:
                    if source:
                        source.close()
                    source, opened, start, data = system.open_input_file(f"{base}/{file}"), file, 0, b""
                if not start <= offset <= offset + length <= start + len(data):
                    start, data = offset, source.read_at(max(length, READ_BYTES), offset)
                record = parse_record(data[offset - start : offset - start + length])
                headers, payload = record["headers"], record["payload"]
                revisit = headers["WARC-Type"] == "revisit"
                rows.append((
                    _page(headers["WARC-Record-ID"]), headers["WARC-Type"], _page(headers.get("WARC-Refers-To")),
                    headers["WARC-Payload-Digest"].removeprefix("sha1:") if revisit else base32_sha1(payload),
                    None if revisit else len(payload), None if revisit else payload,
                ))
                held += len(payload)
                if held >= READ_BYTES:
                    yield _batch(rows, READ)
                    rows, held = [], 0
            yield _batch(rows, READ)
        if source:
            source.close()

    placed = captures.select("file", "offset", "length")
    return (
        placed.repartitionByRange(tasks, "file", "offset")
        .sortWithinPartitions("file", "offset")
        .mapInArrow(read, READ)
    )


def read_back(spark: SparkSession, archive: Archive, keys: DataFrame) -> DataFrame:
    """``page_id, payload_bytes, payload_digest, record_type, refers_to`` of the captures of ``keys``.

    The length of a revisit's payload is that of the response it refers to, found by
    digest; if ``keys`` do not lead to the response, it is looked up by its digest
    among the captures.
    """
    found = stage(lookup(spark, archive, keys), "found")
    revisited = found.where("record_type = 'revisit'").select("digest").distinct()
    missing = (
        archive.captures.where("record_type = 'response'")
        .join(revisited, "digest", "left_semi")
        .join(found.select("page_id", "digest").distinct(), ["page_id", "digest"], "left_anti")
    )
    records = stage(read_records(spark, archive, found).drop("payload"), "records")
    more = read_records(spark, archive, missing).drop("payload")
    lengths = (
        records.unionByName(more).where("record_type = 'response'")
        .join(revisited.withColumnRenamed("digest", "payload_digest"), "payload_digest", "left_semi")
        .groupBy("payload_digest").agg(F.max("payload_bytes").alias("known"))
    )
    columns = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    responses = records.where("record_type = 'response'").select(*columns)
    revisits = (
        records.where("record_type = 'revisit'").join(lengths, "payload_digest", "left")
        .withColumn("payload_bytes", F.col("known"))
        .select(*columns)
    )
    return responses.unionByName(revisits)


def url_keys(pages: DataFrame, url_col: str = "url") -> DataFrame:
    """``key``: the distinct keys of a column of URLs."""
    key = F.pandas_udf(lambda urls: urls.map(lambda u: url_key(None if u != u else u)), "string")
    return pages.select(F.col(url_col)).distinct().select(key(F.col(url_col)).alias("key")).distinct()
