"""SentencePiece encoding and decoding on the tokenizers library."""

from __future__ import annotations

import os
import re
import struct
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import chain
from pathlib import Path
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codetally.llm.storage import release

MODEL_FILE = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
# Words whose ids a worker remembers; then it starts anew.
MEMO_WORDS = 1 << 15
# Longer words, such as whole texts without spaces, are not remembered.
LONG_WORD = 128
# Words that are encoded as one run, and runs that are encoded at once.
RUN_WORDS, RUNS = 256, 64
# A batch is compared with the library in parts of about this many characters.
PART_CHARS = 1 << 18
# Each distinct word is encoded once in portions of about this many bytes of text.
PORTION_BYTES = 1 << 23

# The column ``parity`` stands on one in so many rows if not told otherwise; ``text_parity`` on all.
AUDITED = 20

# Fixed values of the model file format.
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2


@dataclass
class Model:
    """What a model file says."""

    pieces: list[str] = field(default_factory=list)
    scores: list[float] = field(default_factory=list)
    kinds: list[int] = field(default_factory=list)
    algorithm: int = UNIGRAM
    byte_fallback: bool = False
    charsmap: bytes = b""
    dummy_prefix: bool = True
    strip_spaces: bool = True
    escape_spaces: bool = True

    @property
    def unknown(self) -> int:
        return self.kinds.index(UNKNOWN)


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Field numbers and raw values of a protobuf message."""

    def varint(at: int) -> tuple[int, int]:
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            if byte < 128:
                return value, at
            shift += 7

    at = 0
    while at < len(data):
        tag, at = varint(at)
        wire = tag & 7
        if wire == 0:
            value, at = varint(at)
        elif wire == 2:
            size, at = varint(at)
            value, at = data[at : at + size], at + size
        elif wire in (1, 5):
            size = 8 if wire == 1 else 4
            value, at = data[at : at + size], at + size
        else:
            raise ValueError(f"not a model file: wire type {wire}")
        yield tag >> 3, value


def parse_model(data: bytes) -> Model:
    """Reads pieces (field 1), trainer (2) and normaliser (3) settings of a model protobuf."""
    model = Model()
    for number, value in _fields(data):
        if number == 1:
            piece = dict(_fields(value))
            model.pieces.append(piece.get(1, b"").decode("utf-8"))
            model.scores.append(struct.unpack("<f", piece.get(2, b"\0\0\0\0"))[0])
            model.kinds.append(piece.get(3, NORMAL))
        elif number == 2:
            trainer = dict(_fields(value))
            model.algorithm = trainer.get(3, UNIGRAM)
            model.byte_fallback = bool(trainer.get(35, 0))
        elif number == 3:
            normaliser = dict(_fields(value))
            model.charsmap = normaliser.get(2, b"")
            model.dummy_prefix = bool(normaliser.get(3, 1))
            model.strip_spaces = bool(normaliser.get(4, 1))
            model.escape_spaces = bool(normaliser.get(5, 1))
    if model.algorithm not in (UNIGRAM, BPE):
        raise ValueError("only unigram and BPE models are supported")
    if not model.escape_spaces:
        raise ValueError("models that do not mark spaces are not supported")
    if USER_DEFINED in model.kinds:
        raise ValueError("models with user-defined pieces are not supported")
    return model


class Codec:
    """Encodes and decodes like the model's own library.

    The normaliser becomes a chain of normalisers, the word marker a replacement of
    spaces. A unigram model keeps its scores; a BPE model gets every split of a
    piece into two pieces as a merge, in the order of the scores.

    Whole texts are encoded in batches, on several threads (:meth:`encode_whole`). If
    no piece has the marker after another character, no piece spans the start of a
    word, and a text's ids are those of its words one after the other. Words can then
    be compared with the library one by one, and are remembered if they are short
    (:meth:`encode_batch`). Texts that are compared whole are put together from
    the distinct words of a portion of texts (:meth:`encode_portion`).
    """

    def __init__(self, data: bytes, threads: int = 2, verify: bool = True):
        os.environ["RAYON_NUM_THREADS"] = str(threads)
        os.environ["TOKENIZERS_PARALLELISM"] = "true"
        from tokenizers import Regex, Tokenizer, decoders, models, normalizers

        self.threads = threads
        model = self.model = parse_model(data)
        ids = {piece: i for i, piece in enumerate(model.pieces)}
        if model.algorithm == UNIGRAM:
            backend = models.Unigram(
                list(zip(model.pieces, model.scores)), model.unknown, model.byte_fallback
            )
        else:
            backend = models.BPE(
                vocab=ids,
                merges=_merges(model, ids),
                unk_token=model.pieces[model.unknown],
                fuse_unk=True,
                byte_fallback=model.byte_fallback,
            )
        self.tokenizer = Tokenizer(backend)
        self.tokenizer.encode_special_tokens = True
        steps = [normalizers.Precompiled(model.charsmap)] if model.charsmap else []
        if model.strip_spaces:
            steps += [normalizers.Strip(), normalizers.Replace(Regex(" {2,}"), " ")]
        if model.dummy_prefix:
            steps.append(normalizers.Prepend(SPACE))
        steps.append(normalizers.Replace(" ", SPACE))
        self.normalizer = normalizers.Sequence(steps)
        chain_of = [decoders.Replace(SPACE, " "), decoders.ByteFallback(), decoders.Fuse()]
        if model.dummy_prefix:
            chain_of.append(decoders.Strip(" ", 1, 0))
        self.tokenizer.decoder = decoders.Sequence(chain_of)
        self.splits = not any(SPACE in p.lstrip(SPACE) for p in model.pieces)
        # Ids of words seen of late; those in use pass from the old half to the new one.
        self.memo: dict[str, tuple[int, ...]] = {}
        self.old: dict[str, tuple[int, ...]] = {}
        self.unequal: set[str] = set()
        # Scores of unigram models add up with rounding, which a run must not change.
        self.in_runs = self.splits and model.algorithm == BPE
        # Plain texts have a marker for each space and one in front.
        self.by_words = self.in_runs and model.dummy_prefix and not model.charsmap and not model.strip_spaces
        self.by_words &= SPACE in ids and model.kinds[ids.get(SPACE, 0)] == NORMAL
        self.starts = np.array([p.startswith(SPACE) for p in model.pieces])
        self.units = re.compile(f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+").findall
        self.bytes_of = [_piece_bytes(p, k) for p, k in zip(model.pieces, model.kinds)]
        self.library = None
        if verify:
            import sentencepiece

            self.library = sentencepiece.SentencePieceProcessor(model_proto=data)

    def normalise(self, text: str) -> str:
        if not text:
            return ""
        if not self.model.charsmap and not self.model.strip_spaces:
            return SPACE * self.model.dummy_prefix + text.replace(" ", SPACE)
        return self.normalizer.normalize_str(text)

    def encode_whole(self, texts: list[str]) -> tuple[list[list[int]], list[bool]]:
        """The ids of each text, and whether the model's own library gives them for the whole text."""
        normal = [self.normalise(t) for t in texts]
        ids = [e.ids for e in self.tokenizer.encode_batch_fast(normal, add_special_tokens=False)]
        if not self.library:
            return ids, [True] * len(texts)
        return ids, [a == b for a, b in zip(ids, self.library.encode(texts, num_threads=self.threads))]

    def encode_portion(self, texts: pa.Array) -> Iterator[tuple[list[str], list[np.ndarray], list[bool]]]:
        """Parts of the texts, the ids of each text, and whether the model's own library gives them for the whole text.

        In plain texts all words stand between single spaces. Their ids are put together
        from those of the distinct words. Texts that are not plain, and those that the
        library encodes in another way, are encoded whole. Null is empty.
        """
        texts = texts.fill_null("")
        plain = np.zeros(len(texts), bool)
        if self.by_words:
            plain = ~np.asarray(pc.match_substring_regex(texts, f"^$|^ | $|  |{SPACE}"))
        words = pc.split_pattern(texts.filter(pa.array(plain)), " ")
        coded = words.flatten().dictionary_encode()
        values, starts, sizes = self._word_ids(coded.dictionary.to_pylist())
        word = np.asarray(coded.indices)
        stops = np.zeros(len(texts) + 1, np.int64)
        stops[1:][plain] = words.value_lengths()
        stops = np.cumsum(stops)
        at = 0
        for part in _parts(texts):
            here, mine = plain[at : at + len(part)], stops[at : at + len(part) + 1]
            at += len(part)
            used = word[mine[0] : mine[-1]]
            size = sizes[used]
            ends = np.cumsum(size)
            joined = values[np.repeat(starts[used] - ends + size, size) + np.arange(size.sum())]
            ids = np.split(joined, np.r_[0, ends][mine[1:-1] - mine[0]])
            same = [True] * len(part)
            rest = np.flatnonzero(~here).tolist()
            if self.library:
                asked = np.flatnonzero(here).tolist()
                theirs = self.library.encode([part[i] for i in asked], num_threads=self.threads)
                rest += [i for i, others in zip(asked, theirs) if not np.array_equal(ids[i], others)]
            if rest:
                for i, found, agrees in zip(rest, *self.encode_whole([part[i] for i in rest])):
                    ids[i], same[i] = np.array(found, np.int32), agrees
            yield part, ids, same

    def _word_ids(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The ids of words, each with one marker before it, one after the other; where each begins, and how many it has.

        Words go in runs, whose ids are those of the words, each beginning with the one piece that has the marker.
        """
        runs = [SPACE + SPACE.join(words[i : i + RUN_WORDS]) for i in range(0, len(words), RUN_WORDS)]
        found = [np.zeros(0, np.int32)]
        for i in range(0, len(runs), RUNS):
            encoded = self.tokenizer.encode_batch_fast(runs[i : i + RUNS], add_special_tokens=False)
            found += [np.array(e.ids, np.int32) for e in encoded]
        values = np.concatenate(found)
        starts = np.flatnonzero(self.starts[values])
        assert len(starts) == len(words)
        return values, starts, np.diff(np.r_[starts, len(values)])

    def encode_batch(self, texts: list[str]) -> tuple[list[list[int]], list[bool]]:
        """The ids of each text, and whether the model's own library agrees.

        With words, agreement is checked on each distinct word.
        """
        if not self.splits:
            return self.encode_whole(texts)
        words = [self.units(self.normalise(t)) for t in texts]
        if len(self.memo) > MEMO_WORDS:
            self.old, self.memo = self.memo, {}
            self.unequal.intersection_update(self.old)
        missing = set().union(*words).difference(self.memo)
        known = missing.intersection(self.old)
        self.memo.update((w, self.old[w]) for w in known)
        new = list(missing - known)
        self._learn(new)
        of = self.memo.__getitem__
        ids = [list(chain.from_iterable(map(of, text))) for text in words]
        same = [True] * len(texts)
        if self.unequal:
            same = [self.unequal.isdisjoint(text) for text in words]
        for word in new:
            if len(word) > LONG_WORD:
                del self.memo[word]
                self.unequal.discard(word)
        return ids, same

    def _learn(self, new: list[str]) -> None:
        """Put the ids of words into the memo, and note those that the library encodes in another way.

        Words with one marker, at their start, go in runs. No piece spans the start
        of a word, so a run has the ids of its words, and each word begins with the
        one piece of it that has the marker. A run that the library encodes alike has
        no unequal word. All other words go one by one.
        """
        runs, single = [], new
        if self.in_runs:
            plain = [w for w in new if len(w) > 1 and w[0] == SPACE != w[1]]
            single = [w for w in new if len(w) == 1 or w[0] != SPACE or w[1] == SPACE]
            runs = [plain[i : i + RUN_WORDS] for i in range(0, len(plain), RUN_WORDS)]
        joined = list(map("".join, runs))
        encoded = [e.ids for e in self.tokenizer.encode_batch_fast(joined, add_special_tokens=False)]
        theirs = self._library_ids(joined)
        compared: list[str] = []
        for run, ids, others in zip(runs, encoded, theirs):
            at = np.flatnonzero(self.starts[ids]).tolist()
            if len(at) != len(run) or at[0] != 0:
                single = single + run
                continue
            self.memo.update(zip(run, map(tuple, map(ids.__getitem__, map(slice, at, [*at[1:], len(ids)])))))
            if others != ids:
                compared += run
        for word, e in zip(single, self.tokenizer.encode_batch_fast(single, add_special_tokens=False)):
            self.memo[word] = tuple(e.ids)
        compared += single
        for word, others in zip(compared, self._library_ids(compared)):
            if others is not None and self.memo[word] != tuple(others):
                self.unequal.add(word)

    def _library_ids(self, marked: list[str]) -> list[list[int] | None]:
        """The library's ids of marked words or runs; None for those no text normalises to."""
        found: list[list[int] | None] = [None] * len(marked)
        if not self.library:
            return found
        prefix = self.model.dummy_prefix
        plain = [m[prefix:].replace(SPACE, " ") if m.startswith(SPACE) or not prefix else None for m in marked]
        at = [i for i, p in enumerate(plain) if p is not None and self.normalise(p) == marked[i]]
        for i, ids in zip(at, self.library.encode([plain[i] for i in at])):
            found[i] = ids
        return found

    def decode(self, ids: list[int]) -> str:
        """The text of ids: bytes of the pieces, spaces for markers, without the one at the start."""
        try:
            text = b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8")
        except UnicodeDecodeError:
            return self.tokenizer.decode(ids, skip_special_tokens=False)
        return text[1:] if self.model.dummy_prefix and text.startswith(" ") else text


def _merges(model: Model, ids: dict[str, int]) -> list[tuple[str, str]]:
    """Every split of a piece into two pieces, best score of the whole first."""
    found = [
        (-model.scores[i], ids[piece[:cut]], ids[piece[cut:]], piece[:cut], piece[cut:])
        for piece, i in ids.items()
        if model.kinds[i] == NORMAL
        for cut in range(1, len(piece))
        if piece[:cut] in ids and piece[cut:] in ids
    ]
    return [(left, right) for *_, left, right in sorted(found)]


def _piece_bytes(piece: str, kind: int) -> bytes:
    if kind == BYTE:
        return bytes([int(piece[3:5], 16)])
    return b"" if kind == CONTROL else piece.replace(SPACE, " ").encode("utf-8")


_CODECS: dict[tuple, Codec] = {}


def _codec(data: bytes, threads: int, verify: bool) -> Codec:
    """One codec for each model and worker process."""
    key = (hash(data), len(data), threads, verify)
    if key not in _CODECS:
        _CODECS[key] = Codec(data, threads, verify)
    return _CODECS[key]


def _parts(texts: pa.Array) -> Iterator[list[str]]:
    """Texts of a column in parts of about ``PART_CHARS``; null is empty."""
    part, size = [], 0
    for scalar in texts:
        text = scalar.as_py() or ""
        part.append(text)
        size += len(text)
        if size >= PART_CHARS:
            yield part
            part, size = [], 0
    if part:
        yield part


def _portions(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Rows of a batch by about ``PORTION_BYTES`` of its second column."""
    ends = np.cumsum(np.asarray(pc.binary_length(batch.column(1)).fill_null(0)), dtype=np.int64)
    at = 0
    while at < len(ends):
        stop = int(np.searchsorted(ends, (ends[at - 1] if at else 0) + PORTION_BYTES)) + 1
        yield batch.slice(at, stop - at)
        at = stop


def _audited(row_id, every: int = AUDITED) -> bool:
    if every == 1 or row_id is None:
        return every == 1
    return (row_id if isinstance(row_id, int) else crc32(str(row_id).encode())) % every == 0


def encode(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    model_file: str = MODEL_FILE,
    threads: int = 2,
    verify: bool = True,
    parity_every: int = AUDITED,
) -> DataFrame:
    """``id_col, ids, n_tokens, round_trip, parity, word_parity, text_parity`` for each row.

    ``ids`` are those of the whole text without start and end marks; null and empty
    texts have none. ``round_trip`` says whether decoding gives the text again,
    which a text fails that holds the word marker itself, or that a normaliser
    changed. ``text_parity`` says, on every row, whether the model's own library gives
    the same ids for the whole text. ``parity`` repeats it on rows whose id, or a hash
    of an id that is no integer, is divisible by ``parity_every``, and is null on others;
    with 1 it stands on every row, those without an id included.
    ``word_parity`` says whether the library gives the same ids for each word of the
    text that it can be asked for: so it does where whole texts agree, and where they
    do not, words are compared, which tells splitting and normalising from the rest.
    All three are null without ``verify``. Ids of rows may repeat or be null; other
    columns are not read. A text is encoded whole. The model file is read by the
    driver and handed to the tasks, as a bounded vocabulary.
    """
    data = Path(model_file).read_bytes()
    id_type = docs.schema[id_col].dataType.simpleString()
    names = ["id", "ids", "n_tokens", "round_trip", "parity", "word_parity", "text_parity"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(data, threads, verify)
        for portion in chain.from_iterable(map(_portions, batches)):
            at = 0
            for texts, ids, whole in codec.encode_portion(portion.column(1)):
                lists = _id_lists(ids)
                back = [codec.decode(i.tolist()) == t for i, t in zip(ids, texts)]
                mine = portion.column(0).slice(at, len(texts))
                at += len(texts)
                columns = [mine, lists, lists.value_lengths(), pa.array(back, pa.bool_())]
                if verify:
                    words = list(whole)
                    odd = [i for i, same in enumerate(whole) if not same]
                    for i, same in zip(odd, codec.encode_batch([texts[i] for i in odd])[1] if odd else []):
                        words[i] = same
                    audited = [same if _audited(k.as_py(), parity_every) else None for k, same in zip(mine, whole)]
                    columns += [pa.array(c, pa.bool_()) for c in (audited, words, whole)]
                else:
                    columns += [pa.nulls(len(texts), pa.bool_())] * 3
                yield pa.RecordBatch.from_arrays(columns, names=names)
            release()

    return (
        docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
        .mapInArrow(
            run,
            f"id {id_type}, ids array<int>, n_tokens int, round_trip boolean,"
            " parity boolean, word_parity boolean, text_parity boolean",
        )
        .withColumnRenamed("id", id_col)
    )


def _id_lists(ids: list[np.ndarray]) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, ids)]).astype(np.int32)
    return pa.ListArray.from_arrays(ends, np.concatenate([np.zeros(0, np.int32), *ids]))


def decode(
    encoded: DataFrame,
    id_col: str = "doc_id",
    ids_col: str = "ids",
    model_file: str = MODEL_FILE,
) -> DataFrame:
    """``id_col, text``: the text of each row's ids; null ids give null. Ids must be in the vocabulary."""
    data = Path(model_file).read_bytes()
    id_type = encoded.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(data, 1, False)
        for batch in batches:
            texts = (None if i is None else codec.decode(i) for i in batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(texts, pa.string())], names=["id", "text"]
            )

    return (
        encoded.select(F.col(id_col).alias("id"), F.col(ids_col).alias("ids"))
        .mapInArrow(run, f"id {id_type}, text string")
        .withColumnRenamed("id", id_col)
    )
