"""Passages that an earlier document has already, cut out of the later ones."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WINDOW_WORDS = 13
# Windows that a task sorts at once before it hands them on.
LOT_WINDOWS = 1 << 21
# Text whose windows are compared in one group, and groups at least, so that all cores have some.
BUCKET_BYTES, MIN_BUCKETS = 16 << 20, 64
# Words whose codes a worker remembers; longer ones than LONG_WORD it does not.
MEMO_WORDS, LONG_WORD = 1 << 19, 64
# Odd bases of the two rolling hashes, and a mixer.
BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
MIXER = 0xD6E8FEB86659FD93
SPREAD = 0x9E3779B1

ROUTED = pa.schema([("bucket", pa.int32()), ("id", pa.int64()), ("salt", pa.int32()), ("payload", pa.binary())])
HITS = pa.schema([("id", pa.int64()), ("salt", pa.int32()), ("payload", pa.binary())])


class WordCodes(dict):
    """64-bit codes of words; common ones are remembered."""

    def __missing__(self, word: bytes) -> int:
        code = xxhash.xxh64_intdigest(word)
        if len(word) <= LONG_WORD:
            if len(self) >= MEMO_WORDS:
                self.clear()
            self[word] = code
        return code

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def salt_of(text: bytes) -> int:
    """Tells most texts of one id apart, so that no id makes one large group."""
    return xxhash.xxh32_intdigest(text) & 0xFFFF


def window_hashes(codes: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Rolling hashes of all runs of ``size`` codes: one of 64 bits, one of 24 bits more."""
    n = max(0, len(codes) - size + 1)
    out = []
    for base in BASES:
        h = np.zeros(n, np.uint64)
        for i in range(size):
            h *= np.uint64(base)
            h += codes[i : n + i]
        h ^= h >> np.uint64(32)
        h *= np.uint64(MIXER)
        out.append(h ^ (h >> np.uint64(29)))
    return out[0], (out[1] >> np.uint64(40)).astype(np.uint32)


def _planes(values: np.ndarray) -> bytes:
    """The bytes of numbers, all first ones first, which compress better."""
    return np.ascontiguousarray(values.view(np.uint8).reshape(len(values), values.itemsize).T).tobytes()


def _from_planes(data: memoryview, dtype, n: int) -> np.ndarray:
    size = np.dtype(dtype).itemsize
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(size, n).T).reshape(-1).view(dtype)


def pack_windows(h: np.ndarray, check: np.ndarray, doc: np.ndarray, ids: np.ndarray, salts: np.ndarray) -> bytes:
    """Windows in the order of ``h`` with the documents they stand in."""
    used, index = np.unique(doc, return_inverse=True)
    parts = [
        np.diff(h, prepend=np.uint64(0)), check, index.astype(np.uint32),
        np.diff(ids[used], prepend=0), salts[used].astype(np.int32),
    ]
    head = np.array([len(h), len(used)], np.int64).tobytes()
    return zstandard.ZstdCompressor(level=1).compress(head + b"".join(map(_planes, parts)))


def unpack_windows(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash, check, id and salt of each window that :func:`pack_windows` packed."""
    body = memoryview(zstandard.ZstdDecompressor().decompress(data))
    n, docs = np.frombuffer(body[:16], np.int64).tolist()
    parts, at = [], 16
    for dtype, count in ((np.uint64, n), (np.uint32, n), (np.uint32, n), (np.int64, docs), (np.int32, docs)):
        size = count * np.dtype(dtype).itemsize
        parts.append(_from_planes(body[at : at + size], dtype, count))
        at += size
    step, check, index, id_step, salts = parts
    return np.cumsum(step, dtype=np.uint64), check, np.cumsum(id_step)[index], salts[index]


def split_first(
    h: np.ndarray, check: np.ndarray, ids: np.ndarray
) -> tuple[np.ndarray, np.ndarray]:
    """Positions of windows in the order of their hashes, and which have a smaller id elsewhere."""
    order = np.argsort(h, kind="stable")
    same = h[order[1:]] == h[order[:-1]]
    later = np.zeros(len(h), bool)
    tied = np.flatnonzero(np.r_[same, False] | np.r_[False, same]) if len(h) else np.zeros(0, np.int64)
    if len(tied):
        of = order[tied]
        of = of[np.lexsort((ids[of], check[of], h[of]))]
        order[tied] = of
        new = np.r_[True, (h[of[1:]] != h[of[:-1]]) | (check[of[1:]] != check[of[:-1]])]
        first = np.maximum.accumulate(np.where(new, np.arange(len(of)), 0))
        later[tied] = ids[of] > ids[of][first]
    return order, later


def _hit_rows(h: np.ndarray, ids: np.ndarray, salts: np.ndarray) -> Iterator[tuple[int, int, bytes]]:
    """``id, salt, hashes`` for each document of the given windows."""
    order = np.lexsort((h, salts, ids))
    h, ids, salts = h[order], ids[order], salts[order]
    new = np.flatnonzero(np.r_[True, (ids[1:] != ids[:-1]) | (salts[1:] != salts[:-1])]) if len(h) else []
    for start, stop in zip(new, np.r_[new[1:], len(h)] if len(h) else []):
        yield int(ids[start]), int(salts[start]), h[start:stop].tobytes()


class Lots:
    """Windows of a lot of documents, sorted and routed by their hashes."""

    def __init__(self, buckets: int, size: int):
        self.buckets, self.size, self.memo = buckets, size, WordCodes()
        self.clear()

    def clear(self) -> None:
        self.windows, self.parts, self.ids, self.salts = 0, [], [], []

    def add(self, row_id: int, text: bytes) -> None:
        words = text.split()
        if len(words) < self.size:
            return
        h, check = window_hashes(self.memo.of(words), self.size)
        h, first = np.unique(h, return_index=True)
        self.parts.append((h, check[first]))
        self.ids.append(row_id)
        self.salts.append(salt_of(text))
        self.windows += len(h)

    def rows(self) -> Iterator[pa.RecordBatch]:
        """What is known to be repeated already, and one packed row for each bucket."""
        if not self.parts:
            return
        ids, salts = np.array(self.ids, np.int64), np.array(self.salts, np.int32)
        doc = np.repeat(np.arange(len(ids), dtype=np.uint32), [len(h) for h, _ in self.parts])
        h, check = (np.concatenate(part) for part in zip(*self.parts))
        self.clear()
        order, later = split_first(h, check, ids[doc])
        h, check, doc = h[order], check[order], doc[order]
        rows = [
            ((row_id + salt) * SPREAD % (1 << 32) % self.buckets, row_id, salt, hits)
            for row_id, salt, hits in _hit_rows(h[later], ids[doc[later]], salts[doc[later]])
        ]
        h, check, doc = h[~later], check[~later], doc[~later]
        width = (1 << 64) // self.buckets + 1
        edges = np.searchsorted(h, np.array([b * width for b in range(1, self.buckets)], np.uint64))
        for bucket, (start, stop) in enumerate(zip(np.r_[0, edges], np.r_[edges, len(h)])):
            if start < stop:
                packed = pack_windows(h[start:stop], check[start:stop], doc[start:stop], ids, salts)
                rows.append((bucket, None, None, packed))
        yield from _batches(rows, ROUTED)


def _batches(rows: list[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    for start in range(0, len(rows), 1000):
        columns = zip(*rows[start : start + 1000])
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


def repeated_windows(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = WINDOW_WORDS, lot: int = LOT_WINDOWS
) -> DataFrame:
    """``id, salt, payload``: windows of a row that also start in a row with a smaller id.

    ``salt`` comes from the row's text, ``payload`` packs 64-bit window hashes; a
    row's windows may be spread over several result rows, which hold for all rows of
    their id.

    A task sorts the hashes of ``lot`` windows at a time. Where several of
    them have a window, all but those with the smallest id are settled there, so
    that a window of a third of all rows goes on once from each sorted lot. The
    others go to the bucket of their hash, packed, one row for each lot and bucket,
    and are compared there with windows of all other lots. The settled ones travel
    with them: both must come from the same evaluation of ``docs``.
    """
    total = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    buckets = max(MIN_BUCKETS, -(-total // BUCKET_BYTES))

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lots = Lots(buckets, size)
        for batch in batches:
            for row_id, text in zip(batch.column(0), batch.column(1)):
                lots.add(row_id.as_py(), text.as_py())
                if lots.windows >= lot:
                    yield from lots.rows()
        yield from lots.rows()

    def compare(group: pa.Table) -> pa.Table:
        settled = group.filter(group["id"].is_valid()).select(HITS.names).cast(HITS)
        packed = group.filter(group["id"].is_null())["payload"]
        if not len(packed):
            return settled
        parts = zip(*(unpack_windows(p.as_py()) for p in packed))
        h, check, ids, salts = (np.concatenate(part) for part in parts)
        order, later = split_first(h, check, ids)
        hit = order[later]
        rows = list(_hit_rows(h[hit], ids[hit], salts[hit]))
        return pa.Table.from_batches([*settled.to_batches(), *_batches(rows, HITS)], HITS)

    read = docs.where(F.col(id_col).isNotNull() & F.col(text_col).isNotNull()).select(
        F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("binary").alias("text")
    )
    routed = read.mapInArrow(route, "bucket int, id long, salt int, payload binary")
    return routed.groupBy("bucket").applyInArrow(compare, "id long, salt int, payload binary")


def removal_intervals(words: list[bytes], hits: np.ndarray, size: int, memo: WordCodes) -> np.ndarray:
    """Maximal intervals ``(start, stop)`` of words covered by windows whose hash is in ``hits``."""
    h, _ = window_hashes(memo.of(words), size)
    starts = np.flatnonzero(np.isin(h, hits))
    if not len(starts):
        return np.zeros((0, 2), np.int64)
    gap = np.flatnonzero(np.diff(starts) > size)
    return np.stack([starts[np.r_[0, gap + 1]], starts[np.r_[gap, len(starts) - 1]] + size], axis=1)


def remove_repeats(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = WINDOW_WORDS, lot: int = LOT_WINDOWS
) -> DataFrame:
    """``id_col, n_words, removed, kept``, one row per row of ``docs``.

    Words are separated by ASCII white space and compared as they are. A word goes
    if it is covered by a window of ``size`` words that also starts in a row with a
    smaller id; windows are judged on the input. ``removed`` lists the maximal
    intervals ``start, stop`` of words that go, ``kept`` joins the others by one
    space. Ids are integers. Rows of equal id do not remove each other's words, nor
    do windows within one row; rows with a null id neither remove nor lose words.
    A null text has no words. Empty tables give an empty table, other columns are
    not read.

    Windows are told apart by rolling hashes of 88 bits: among 10^13 different
    windows less than one pair is expected to be taken for equal.
    """
    hits = (
        repeated_windows(docs, id_col, text_col, size, lot)
        .groupBy("id", "salt").agg(F.collect_list("payload").alias("hits"))
    )

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compressor = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            texts = [t.as_py() or b"" for t in batch.column(1)]
            salts = [salt_of(t) for t in texts]
            packed = [compressor.compress(t) for t in texts]
            arrays = [batch.column(0), pa.array(salts, pa.int32()), pa.array(packed, pa.binary())]
            yield pa.RecordBatch.from_arrays(arrays, names=["id", "salt", "packed"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decompressor, memo = zstandard.ZstdDecompressor(), WordCodes()
        for batch in batches:
            rows = []
            for row_id, packed, found in zip(*(batch.column(i) for i in range(3))):
                words = decompressor.decompress(packed.as_py()).split()
                found = found.as_py()
                removed = np.zeros((0, 2), np.int64)
                if found:
                    removed = removal_intervals(words, np.frombuffer(b"".join(found), np.uint64), size, memo)
                edges = [0, *removed.reshape(-1).tolist(), len(words)]
                kept = [w for i in range(0, len(edges), 2) for w in words[edges[i] : edges[i + 1]]]
                spans = [{"start": a, "stop": b} for a, b in removed.tolist()]
                rows.append((row_id.as_py(), len(words), spans, b" ".join(kept)))
            columns = zip(*rows) if rows else [[]] * 4
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, types)], names=["id", "n_words", "removed", "kept"]
            )

    span = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
    types = [pa.int64(), pa.int64(), span, pa.binary()]
    texts = docs.select(
        F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("binary").alias("text")
    ).mapInArrow(pack, "id long, salt int, packed binary")
    joined = texts.join(hits, ["id", "salt"], "left").select("id", "packed", "hits")
    result = joined.mapInArrow(
        cut, "id long, n_words long, removed array<struct<start:long,stop:long>>, kept binary"
    )
    id_type = docs.schema[id_col].dataType
    return result.select(
        F.col("id").cast(id_type).alias(id_col), "n_words", "removed", F.col("kept").cast("string").alias("kept")
    )
