"""Two tokenizers over one corpus: groups of tokens that cover the same bytes, and how often ids meet."""

from __future__ import annotations

import hashlib
import heapq
import io
import json
import os
import re
import struct
import uuid
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import sentencepiece
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from codetally.llm.storage import file_system, new_path, stage

SIDE_A = "/opt/tokenizers/byte_bpe_50k.json"
SIDE_B = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
# Text that is aligned at once; its records are one run for each radix partition.
RUN_CHARS = 8 << 20
PARTITIONS = 64
# Records of a compressed block, and compressed bytes that a task merges.
BLOCK_RECORDS = 1 << 15
MERGE_BYTES = 64 << 20
# New units, and about so many characters of them, that are encoded at once.
SLICE_UNITS, SLICE_CHARS = 1 << 13, 1 << 17
# Units of text whose alignment a worker remembers; then it starts anew.
MEMO_UNITS, MEMO_CHARS = 1 << 18, 32 << 20
# Places where a text can be cut: a single space between two other characters.
CUT = re.compile(r"(?<=\S)(?= \S)")

INDEX = pa.schema([
    ("file", pa.string()), ("part", pa.int32()), ("start", pa.int64()), ("size", pa.int64()),
])
INDEX_SCHEMA = "file string, part int, start long, size long"


class SideA:
    """The byte-level tokenizer of a JSON file."""

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        vocabulary = self.tokenizer.get_vocab()
        to_byte = {c: b for b, c in byte_letters().items()}
        self.bytes = [b""] * (max(vocabulary.values()) + 1)
        for entry, i in vocabulary.items():
            self.bytes[i] = bytes(to_byte[c] for c in entry) if all(c in to_byte for c in entry) else entry.encode()
        with open(path, encoding="utf-8") as file:
            settings = json.load(file)
        splitter = settings.get("pre_tokenizer") or {}
        self.can_be_cut = (
            not settings.get("normalizer") and splitter.get("type") == "ByteLevel" and splitter.get("use_regex", True)
        )

    def encode(self, units: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(units, add_special_tokens=False)]


class SideB:
    """The SentencePiece tokenizer of a model file, which puts a space before each text."""

    def __init__(self, path: str):
        self.processor = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [self.processor.id_to_piece(i) for i in range(self.processor.get_piece_size())]
        self.bytes = [
            bytes([int(piece[3:5], 16)]) if self.processor.is_byte(i) else piece.replace(SPACE, " ").encode()
            for i, piece in enumerate(pieces)
        ]
        # No piece goes on over the start of a word, and the text stays as it is.
        self.can_be_cut = not any(SPACE in piece.lstrip(SPACE) for piece in pieces) and all(
            self.processor.normalize(text) == SPACE + text.replace(" ", SPACE) for text in ("ﬁ é Å", "a  b ")
        )

    def encode(self, units: list[str]) -> list[list[int]]:
        return self.processor.encode([u[1:] for u in units], num_threads=1)


def byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in a byte-level vocabulary.

    Fixed values: bytes 33 to 126, 161 to 172 and 174 to 255 stand for themselves,
    the others in their order for the characters from 256 on.
    """
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(others)}


class Aligner:
    """Alignments of units of text, each computed once.

    A text is cut where both tokenizers start a new token whatever stands around, so
    that its alignment is that of its units one after the other.
    """

    def __init__(self, path_a: str, path_b: str):
        # Tasks fill the cores; a pool of threads for each worker only holds memory.
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.a, self.b = SideA(path_a), SideB(path_b)
        self.cuts = self.a.can_be_cut and self.b.can_be_cut
        self.size_a, self.size_b = (np.array([len(x) for x in side.bytes], np.int64) for side in (self.a, self.b))
        n = len(self.size_a)
        self.base_b = 2 * n
        self.words = (
            [f"{i}," for i in range(n)] + [f"{i}|" for i in range(n)]
            + [f"{i}," for i in range(len(self.size_b))] + [f"{i};" for i in range(len(self.size_b))]
        )
        self.forget()

    def forget(self) -> None:
        self.chars = 0
        self.index: dict[str, int] = {}
        self.new: list[str] = []
        self.groups: list[str] = []
        # n_a, n_b, n_groups, n_links and whether both sides give back the unit
        self.numbers = np.zeros((0, 5), np.int64)
        # Links of the units: A id times the number of B ids, plus B id.
        self.pairs = np.zeros(0, np.int64)
        self.first_pair = np.zeros(1, np.int64)

    def units(self, text: str) -> np.ndarray:
        """Numbers of the units of a text; call :meth:`settle` before using them."""
        index, new = self.index, self.new
        text = " " + text
        found = []
        for unit in CUT.split(text) if self.cuts else [text]:
            at = index.get(unit)
            if at is None:
                at = index[unit] = len(index)
                new.append(unit)
                self.chars += len(unit)
            found.append(at)
        return np.array(found, np.int64)

    def settle(self) -> None:
        """Encodes and aligns the units that are new, in slices of bounded size."""
        units, self.new = self.new, []
        numbers, pairs, sizes = [self.numbers], [self.pairs], []
        for part in slices(units):
            for of, found in zip((numbers, pairs, sizes), self._aligned(part)):
                of.append(found)
        if sizes:
            self.numbers, self.pairs = np.concatenate(numbers), np.concatenate(pairs)
            last = self.first_pair[-1]
            self.first_pair = np.concatenate([self.first_pair, last + np.cumsum(np.concatenate(sizes))])

    def _aligned(self, units: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Numbers of some units, their pairs one after the other, and how many pairs each has."""
        ids_a, ids_b = self.a.encode(units), self.b.encode(units)
        ok = [
            b"".join(map(self.a.bytes.__getitem__, x)) == u and b"".join(map(self.b.bytes.__getitem__, y)) == u
            for x, y, u in zip(ids_a, ids_b, map(str.encode, units))
        ]
        ids_a = [x if good else [] for x, good in zip(ids_a, ok)]
        ids_b = [y if good else [] for y, good in zip(ids_b, ok)]
        a, b = (np.fromiter(chain.from_iterable(x), np.int64, sum(map(len, x))) for x in (ids_a, ids_b))
        of_a, of_b = (np.repeat(np.arange(len(x)), [len(y) for y in x]) for x in (ids_a, ids_b))
        # Positions run on from unit to unit, which all end where both sides end.
        ends_a, ends_b = np.cumsum(self.size_a[a]), np.cumsum(self.size_b[b])
        ends = np.union1d(ends_a, ends_b)
        cuts = np.intersect1d(ends_a, ends_b, assume_unique=False)
        # Between two neighbouring ends lies one token of each side: one link.
        at_a, at_b = np.searchsorted(ends_a, ends), np.searchsorted(ends_b, ends)
        link_unit = of_a[at_a]
        links = a[at_a] * len(self.size_b) + b[at_b]
        group_unit = of_a[np.searchsorted(ends_a, cuts)]
        n = len(units)
        links_of = np.bincount(link_unit, minlength=n)
        numbers = np.stack([
            np.bincount(of_a, minlength=n), np.bincount(of_b, minlength=n), np.bincount(group_unit, minlength=n),
            links_of, np.array(ok, np.int64),
        ], axis=1)
        self._write_groups(a, b, of_a, of_b, np.searchsorted(cuts, ends_a), np.searchsorted(cuts, ends_b), n)
        return numbers, links, links_of

    def _write_groups(self, a, b, of_a, of_b, group_a, group_b, n: int) -> None:
        last_a = np.r_[group_a[1:] != group_a[:-1], True][: len(a)]
        last_b = np.r_[group_b[1:] != group_b[:-1], True][: len(b)]
        codes = np.concatenate([a + len(self.size_a) * last_a, self.base_b + b + len(self.size_b) * last_b])
        order = np.argsort(np.concatenate([2 * group_a, 2 * group_b + 1]), kind="stable")
        unit = np.concatenate([of_a, of_b])[order]
        words = list(map(self.words.__getitem__, codes[order].tolist()))
        stops = np.cumsum(np.bincount(unit, minlength=n)).tolist()
        start = 0
        for stop in stops:
            self.groups.append("".join(words[start:stop]))
            start = stop

    def pair_records(self, docs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``pair, document, times`` in this order, each pair of a document once."""
        if not docs:
            return (np.zeros(0, np.int64),) * 3
        unit, n, n_b = np.concatenate(docs), len(docs), len(self.size_b)
        size = self.first_pair[unit + 1] - self.first_pair[unit]
        at = np.arange(size.sum())
        at += np.repeat(self.first_pair[unit] - np.cumsum(size) + size, size)
        key = self.pairs[at] * n
        del at
        key += np.repeat(np.repeat(np.arange(n), [len(d) for d in docs]), size)
        key.sort()
        new = np.flatnonzero(np.r_[True, key[1:] != key[:-1]][: len(key)])
        times = np.diff(np.r_[new, len(key)])
        pair, doc = np.divmod(key[new], n)
        return pair // n_b << 32 | pair % n_b, doc, times


def slices(units: list[str]) -> Iterator[list[str]]:
    """The units in slices of at most ``SLICE_UNITS`` and about ``SLICE_CHARS``, each at least one unit."""
    start = chars = 0
    for i, unit in enumerate(units, 1):
        chars += len(unit)
        if chars >= SLICE_CHARS or i - start >= SLICE_UNITS or i == len(units):
            yield units[start:i]
            start, chars = i, 0


_ALIGNERS: dict[tuple[str, str], Aligner] = {}


def aligner(path_a: str, path_b: str) -> Aligner:
    if (path_a, path_b) not in _ALIGNERS:
        _ALIGNERS[path_a, path_b] = Aligner(path_a, path_b)
    return _ALIGNERS[path_a, path_b]


def write_run(out: io.BytesIO, pair: np.ndarray, doc: np.ndarray, times: np.ndarray) -> None:
    """Records in the order of pairs, in compressed blocks: pair steps, documents, times by columns."""
    compressor = zstandard.ZstdCompressor(level=1)
    for start in range(0, len(pair), BLOCK_RECORDS):
        part = slice(start, start + BLOCK_RECORDS)
        columns = (
            np.diff(pair[part], prepend=0).astype(np.uint64), doc[part].astype(np.uint32), times[part].astype(np.uint32)
        )
        planes = b"".join(
            np.ascontiguousarray(c.view(np.uint8).reshape(len(c), c.itemsize).T).tobytes() for c in columns
        )
        block = compressor.compress(planes)
        out.write(struct.pack("<II", len(columns[0]), len(block)))
        out.write(block)


def read_run(data: bytes) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """The blocks of a run, one after the other."""
    decompressor, at = zstandard.ZstdDecompressor(), 0
    while at < len(data):
        n, size = struct.unpack_from("<II", data, at)
        planes = np.frombuffer(decompressor.decompress(data[at + 8 : at + 8 + size]), np.uint8)
        at += 8 + size
        columns = []
        for dtype, start, stop in ((np.uint64, 0, 8), (np.uint32, 8, 12), (np.uint32, 12, 16)):
            plane = planes[start * n : stop * n].reshape(stop - start, n)
            columns.append(np.ascontiguousarray(plane.T).reshape(-1).view(dtype).astype(np.int64))
        yield np.cumsum(columns[0]), columns[1], columns[2]


def merge_runs(runs: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """``pair, run, document, times`` of all runs in the order of pairs, in portions.

    A heap holds the last pair of the current block of each run. The run whose block
    ends first sets how far all runs can be read; then its next block is taken. A pair
    may go on in the next portion.
    """
    readers = [read_run(data) for data in runs]
    blocks: list[tuple[np.ndarray, np.ndarray, np.ndarray] | None] = [next(r, None) for r in readers]
    heap = [(int(block[0][-1]), i) for i, block in enumerate(blocks) if block]
    heapq.heapify(heap)
    while heap:
        limit, _ = heap[0]
        portion = []
        for i, block in enumerate(blocks):
            if block is None or block[0][0] > limit:
                continue
            stop = int(np.searchsorted(block[0], limit, "right"))
            portion.append((block[0][:stop], np.full(stop, i), block[1][:stop], block[2][:stop]))
            blocks[i] = tuple(c[stop:] for c in block) if stop < len(block[0]) else None
        ended = []
        while heap and heap[0][0] == limit:
            ended.append(heapq.heappop(heap)[1])
        for i in ended:
            blocks[i] = next(readers[i], None)
            if blocks[i]:
                heapq.heappush(heap, (int(blocks[i][0][-1]), i))
        columns = [np.concatenate(c) for c in zip(*portion)]
        order = np.argsort(columns[0], kind="stable")
        yield tuple(c[order] for c in columns)


def count_portions(runs: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs and the number of records that have them, in the order of pairs."""
    for pair, *_ in merge_runs(runs):
        new = np.flatnonzero(np.r_[True, pair[1:] != pair[:-1]])
        yield pair[new], np.diff(np.r_[new, len(pair)])


def best_of_side(pair: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Whether each pair, in the order of pairs, has the highest count of its first id."""
    if not len(pair):
        return np.zeros(0, bool)
    side = pair >> 32
    new = np.r_[True, side[1:] != side[:-1]]
    highest = np.maximum.reduceat(count, np.flatnonzero(new))
    return count == highest[np.cumsum(new) - 1]


def _write_file(folder: str, data: bytes) -> str:
    system, base = file_system(folder)
    system.create_dir(base, recursive=True)
    name = f"{uuid.uuid4().hex}.bin"
    with system.open_output_stream(f"{base}/{name}", compression=None) as target:
        target.write(data)
    return f"{folder}/{name}"


def _read_part(path: str, start: int, size: int) -> bytes:
    system, place = file_system(path)
    with system.open_input_file(place) as source:
        source.seek(start)
        return source.read(size)


def spill_records(docs: DataFrame, folder: str, path_a: str, path_b: str, id_col: str, text_col: str) -> DataFrame:
    """``file, part, start, size``: the aligned texts of ``docs`` in files of the shared folder.

    A file has the rows of one portion of text (part -1), and their pair records by
    radix partition of the first id, sorted and compressed.
    """

    def write(aligned: Aligner, id_type: pa.DataType, ids: list, found: list[np.ndarray | None]) -> pa.RecordBatch:
        aligned.settle()
        rows, docs_of_run = [], []
        for units in found:
            numbers = aligned.numbers[units] if units is not None else np.zeros((0, 5), np.int64)
            if not len(numbers) or not numbers[:, 4].all():
                rows.append((0, 0, 0, 0, ""))
                docs_of_run.append(np.zeros(0, np.int64))
                continue
            text = "".join(map(aligned.groups.__getitem__, units.tolist()))[:-1]
            digest = hashlib.sha256(text.encode()).hexdigest()
            rows.append((*numbers[:, :4].sum(axis=0).tolist(), digest))
            docs_of_run.append(units)
        out, index = io.BytesIO(), []
        names = ["id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"]
        columns = [pa.array(ids, id_type), *(pa.array(c) for c in zip(*rows))]
        with pa.ipc.new_stream(out, pa.schema([(n, c.type) for n, c in zip(names, columns)])) as stream:
            stream.write_batch(pa.RecordBatch.from_arrays(columns, names=names))
        index.append((-1, 0, out.tell()))
        pair, doc, times = aligned.pair_records(docs_of_run)
        part_of = (pair >> 32) % PARTITIONS
        for part in np.unique(part_of).tolist():
            start, mine = out.tell(), part_of == part
            write_run(out, pair[mine], doc[mine], times[mine])
            index.append((part, start, out.tell() - start))
        path = _write_file(folder, out.getvalue())
        parts, starts, sizes = zip(*index)
        return pa.RecordBatch.from_arrays(
            [pa.array([path] * len(index)), pa.array(parts, pa.int32()), pa.array(starts), pa.array(sizes)], schema=INDEX
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligned = aligner(path_a, path_b)
        ids, found, chars = [], [], 0
        for batch in batches:
            for row_id, text in zip(batch.column(0), batch.column(1)):
                if not ids and (len(aligned.index) > MEMO_UNITS or aligned.chars > MEMO_CHARS):
                    aligned.forget()
                text = text.as_py()
                ids.append(row_id.as_py())
                found.append(aligned.units(text) if text else None)
                chars += len(text or "")
                if chars >= RUN_CHARS:
                    yield write(aligned, batch.column(0).type, ids, found)
                    ids, found, chars = [], [], 0
        if ids:
            yield write(aligned, batch.column(0).type, ids, found)

    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(run, INDEX_SCHEMA)


def align_tokens(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    path_a: str = SIDE_A,
    path_b: str = SIDE_B,
    merge_bytes: int = MERGE_BYTES,
) -> DataFrame:
    """``id_col, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256`` for every row.

    Side A encodes a space and the text, side B the text, to which it adds the space.
    Tokens link if their bytes overlap; a group is what lies between neighbouring
    byte positions where tokens of both sides end. The count of a pair of ids is the
    number of rows with a link of the two, ``count_sum`` its sum over a row's links,
    ``n_best`` the number of links whose count no other pair of their A id exceeds.

    Rows with a null or empty text, and those whose tokens of either side do not
    give back the bytes, have zeros and an empty ``groups_sha256``. Repeated rows
    count each. Null ids stay. Empty tables give an empty table, other columns are
    not read. A text is held whole, with some 40 bytes for a token.

    Texts are aligned in portions; the pairs of a portion's rows are written to the
    shared folder as sorted, compressed runs by radix partition of the A id. Tasks
    merge runs of at most about ``merge_bytes`` with a heap and count pairs, so that
    an A id in a third of all links has many tasks. Sums by pair, in the order of A
    ids, give the highest counts; a second merge adds up each row's share, and the
    shares go back to the portions. What a task holds of a partition's counts is
    bounded by both vocabularies.
    """
    spark = docs.sparkSession
    folder = new_path(spark, "alignment")
    index = stage(spill_records(docs, folder, path_a, path_b, id_col, text_col), "alignment-index")
    sizes = {r["part"]: r["n"] for r in index.where("part >= 0").groupBy("part").agg(F.sum("size").alias("n")).collect()}
    bundles = F.create_map(*(F.lit(v) for part, n in sizes.items() for v in (part, -(-n // merge_bytes)))) if sizes else F.lit(None)
    work = index.where("part >= 0").withColumn(
        "bundle", F.pmod(F.xxhash64("file"), F.element_at(bundles, F.col("part")).cast("long")) if sizes else F.lit(0).cast("long")
    )

    def read(group: pa.Table) -> tuple[list[str], list[bytes]]:
        rows = sorted(group.select(["file", "start", "size"]).to_pylist(), key=lambda r: r["file"])
        return [r["file"] for r in rows], [_read_part(r["file"], r["start"], r["size"]) for r in rows]

    def count(group: pa.Table) -> pa.Table:
        pairs, counts = zip(*count_portions(read(group)[1]))
        pair, n = np.concatenate(pairs), np.concatenate(counts)
        return pa.table({"part": pa.array([group["part"][0].as_py()] * len(pair), pa.int32()), "pair": pair, "n": n})

    counts = (
        work.groupBy("part", "bundle").applyInArrow(count, "part int, pair long, n long")
        .groupBy("part", "pair").agg(F.sum("n").alias("n"))
    )

    def store_counts(group: pa.Table) -> pa.Table:
        pair, n = group["pair"].to_numpy(), group["n"].to_numpy()
        order = np.argsort(pair)
        pair, n = pair[order], n[order]
        out = io.BytesIO()
        np.savez(out, pair=pair, n=n, best=best_of_side(pair, n))
        return pa.table({"part": group["part"][:1], "file": [_write_file(folder, out.getvalue())]})

    stored = {
        r["part"]: r["file"]
        for r in counts.groupBy("part").applyInArrow(store_counts, "part int, file string").collect()
    }

    def contribute(group: pa.Table) -> pa.Table:
        system, place = file_system(stored[group["part"][0].as_py()])
        with system.open_input_file(place) as source:
            table = np.load(io.BytesIO(source.read()))
        pairs, n, best = table["pair"], table["n"], table["best"]
        files, runs = read(group)
        keys, sums = [], []
        for pair, run, doc, times in merge_runs(runs):
            at = np.searchsorted(pairs, pair)
            keys.append(run << 32 | doc)
            sums.append(np.stack([times * best[at], times * n[at]]))
            if sum(map(len, keys)) > 1 << 20:
                keys, sums = ([x] for x in _add_up(keys, sums))
        key, total = _add_up(keys, sums)
        edges = np.searchsorted(key, np.arange(len(files) + 1) << 32)
        shares = [
            zstandard.compress(np.vstack([key[a:b] & 0xFFFFFFFF, total[:, a:b]]).tobytes(), 1)
            for a, b in zip(edges[:-1].tolist(), edges[1:].tolist())
        ]
        return pa.table({"file": files, "size": pa.nulls(len(files), pa.int64()), "share": pa.array(shares, pa.binary())})

    def finish(group: pa.Table) -> pa.Table:
        head = group.filter(group["size"].is_valid()).to_pylist()[0]
        rows = pa.ipc.open_stream(_read_part(head["file"], 0, head["size"])).read_all()
        total = np.zeros((2, rows.num_rows), np.int64)
        for share in group["share"].drop_null():
            doc, best, sums = np.frombuffer(zstandard.decompress(share.as_py()), np.int64).reshape(3, -1)
            total[0, doc] += best
            total[1, doc] += sums
        return rows.append_column("n_best", pa.array(total[0])).append_column("count_sum", pa.array(total[1]))

    shares = work.groupBy("part", "bundle").applyInArrow(contribute, "file string, size long, share binary")
    heads = index.where("part = -1").select("file", "size", F.lit(None).cast("binary").alias("share"))
    id_type = docs.schema[id_col].dataType.simpleString()
    fields = f"id {id_type}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, n_best long, count_sum long"
    result = heads.unionByName(shares).groupBy("file").applyInArrow(finish, fields)
    return result.select(
        F.col("id").alias(id_col), "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"
    )


def _add_up(keys: list[np.ndarray], sums: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Sums by key, in the order of keys."""
    key, total = np.concatenate(keys), np.concatenate(sums, axis=1)
    order = np.argsort(key, kind="stable")
    key, total = key[order], total[:, order]
    new = np.flatnonzero(np.r_[True, key[1:] != key[:-1]][: len(key)])
    return key[new], np.add.reduceat(total, new, axis=1) if len(new) else total
