"""Text quality from weak labels: heuristic labellers, expectation-maximisation, a hashed linear scorer."""

from __future__ import annotations

import string
from array import array
from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import ArrowUDFType

from codetally.llm.storage import drop_staged, release, stage

ABSTAIN, JUNK, GOOD = 0, 1, 2
# Buckets of word shapes, of words and pairs of words, then two for each labeller's statistic.
SHAPE_BUCKETS = 1 << 12
WORD_BUCKETS = 1 << 12
# The scorer is fitted on that many rows at most, those with the smallest hashes;
# everything else covers all rows.
FIT_ROWS = 20_000
# Scores below are rejected.
THRESHOLD = 0.15
EM_ROUNDS = 200
FIT_ROUNDS = 300
# Rows whose products are held at once in a round.
FIT_PART = 1_000
# A labeller calls no larger share of good texts junk; keeps EM from taking a rare
# kind of junk, on which few labellers vote, for good text.
FALSE_ALARMS = 0.03
# Junk has many kinds: the labeller of one finds others as harmless as good texts,
# at least in this share of cases.
UNNOTICED = 0.7
PENALTY = 1e-4
SHORT_WORDS = 8

# Labellers by (statistic, at least this much is junk, at most this much is good).
# Between the two, or where no number is given, a labeller abstains.
LABELLERS = [
    ("symbol_tails", 0.20, 0.02),
    ("capitals", 0.30, 0.10),
    ("exclamations", 0.20, None),
    ("separators", 0.20, 0.02),
    ("repeats", 0.30, 0.05),
    ("few_distinct", 0.75, None),
    ("shouted_or_marked", 0.35, None),
    ("sentence_ends", None, 0.97),
    ("repeated_phrases", 0.50, 0.05),
    ("repeated_lines", 0.60, None),
]
HASH_BUCKETS = SHAPE_BUCKETS + WORD_BUCKETS + 2 * len(LABELLERS)

# A word's code: its kind, flags, and a hash of the punctuation at its end.
KINDS = {"lower": 0, "title": 1, "capitals": 2, "punctuation": 3, "digits": 4, "repeated": 5}
SYMBOL, SHOUT, SENTENCE = 8, 16, 32
TAIL_SHIFT, TAIL_BUCKETS = 6, 1 << 10
# Words whose codes a task remembers between portions of text, and their characters.
MEMO_WORDS, MEMO_CHARS = 1 << 18, 8 << 20
# Repetition is measured in windows of that many words, so that length does not matter.
WINDOW_WORDS = 256
PHRASE_WORDS = 4
# Texts whose features are computed at once: at most that many, and about that many bytes.
PORTION_TEXTS, PORTION_BYTES = 64, 1 << 19

_SYMBOLS = "*$%&#@^~=+"


def word_code(word: str) -> int:
    end = word[len(word.rstrip(string.punctuation)) :]
    if len(end) == len(word) or not any(map(str.isalnum, word)):
        kind = KINDS["punctuation"]
    elif len(word) > 2 and word.isupper():
        kind = KINDS["capitals"]
    elif word[0].isupper():
        kind = KINDS["title"]
    elif any(map(str.isdigit, word)):
        kind = KINDS["digits"]
    else:
        kind = KINDS["lower"]
    code = kind | (crc32(end[-3:].encode()) % TAIL_BUCKETS) << TAIL_SHIFT
    if end:
        code |= SYMBOL * (end[-1] in _SYMBOLS and end.endswith(3 * end[-1]))
        code |= SHOUT * end.endswith("!!") | SENTENCE * (end[-1] in ".,;:?")
    return code


class Vocabulary(dict):
    """Numbers of words in the order they were met, with a code and a hash for each.

    Hashes are those of words in lower case and without punctuation around.
    """

    def __init__(self):
        super().__init__()
        self.chars, self.codes, self.hashes = 0, array("q"), array("q")

    def __missing__(self, word: str) -> int:
        number = self[word] = len(self)
        self.chars += len(word)
        self.codes.append(word_code(word))
        self.hashes.append(crc32((word.lower().strip(string.punctuation) or word).encode("utf-8", "replace")))
        return number

    def make_room(self) -> None:
        """Forget all words if they are many; numbers given before mean nothing then."""
        if len(self) > MEMO_WORDS or self.chars > MEMO_CHARS:
            self.clear()
            self.chars, self.codes, self.hashes = 0, array("q"), array("q")


def _view(numbers: array) -> np.ndarray:
    """The numbers without a copy; the array cannot grow while the view is in use."""
    return np.frombuffer(numbers, np.int64) if len(numbers) else np.zeros(0, np.int64)


class Portion:
    """Some texts, each word coded once, with what votes and features need."""

    def __init__(self, texts: list[str | None], vocabulary: Vocabulary):
        vocabulary.make_room()
        numbers, lines = [], []
        for text in texts:
            words = (text or "").split()
            numbers.append(np.fromiter(map(vocabulary.__getitem__, words), np.int64, len(words)))
            stripped = [x for x in map(str.strip, text.splitlines()) if x] if words else []
            lines.append(np.fromiter((crc32(x.encode("utf-8", "replace")) for x in stripped), np.int64, len(stripped)))
        self.n = np.array([len(x) for x in numbers], np.int64)
        self.doc = np.repeat(np.arange(len(texts)), self.n)
        self.numbers = np.concatenate([*numbers, np.zeros(0, np.int64)])
        self.codes = _view(vocabulary.codes)[self.numbers]
        self.hashes = _view(vocabulary.hashes)[self.numbers]
        # Neighbours in one text.
        self.paired = self.doc[1:] == self.doc[:-1]
        same = np.r_[False, (self.numbers[1:] == self.numbers[:-1]) & self.paired][: len(self.doc)]
        self.codes[same] = self.codes[same] & ~7 | KINDS["repeated"]
        self.statistics = self._statistics(lines)

    def _per_text(self, mask: np.ndarray) -> np.ndarray:
        return np.bincount(self.doc[mask], minlength=len(self.n))

    def _statistics(self, lines: list[np.ndarray]) -> np.ndarray:
        """Shares of words, phrases and lines, between 0 and 1, by text and labeller; 0 without words."""
        n = np.maximum(self.n, 1)
        kinds = self.codes & 7
        symbol, shout, sentence = (self._per_text(self.codes & flag > 0) for flag in (SYMBOL, SHOUT, SENTENCE))
        bars = self._per_text(kinds == KINDS["punctuation"])
        start = np.cumsum(self.n) - self.n
        position = np.arange(len(self.doc)) - start[self.doc]
        phrases = np.zeros(max(0, len(self.hashes) - PHRASE_WORDS + 1), np.int64)
        for i in range(PHRASE_WORDS):
            phrases = (phrases * 1_000_003 + self.hashes[i : i + len(phrases)]) % 1_099_511_627_689
        whole = np.flatnonzero(position[: len(phrases)] + PHRASE_WORDS <= self.n[self.doc[: len(phrases)]])
        line_doc = np.repeat(np.arange(len(lines)), [len(x) for x in lines])
        line_position = np.arange(len(line_doc)) - np.r_[0, np.cumsum([len(x) for x in lines])][line_doc]
        found = {
            "symbol_tails": symbol / n,
            "capitals": self._per_text(kinds == KINDS["capitals"]) / n,
            "exclamations": shout / n,
            "separators": bars / n,
            "repeats": self._per_text(kinds == KINDS["repeated"]) / n,
            "few_distinct": repeated(self.numbers, self.doc, position, len(self.n), 20),
            "shouted_or_marked": (symbol + np.maximum(shout, bars)) / n,
            "sentence_ends": np.where(self.n, 1 - sentence / n, 0),
            "repeated_phrases": repeated(phrases[whole], self.doc[whole], position[whole], len(self.n), 20),
            "repeated_lines": repeated(np.concatenate([*lines, np.zeros(0, np.int64)]), line_doc, line_position, len(self.n), 3),
        }
        return np.stack([found[name] for name, *_ in LABELLERS], axis=1)

    def votes(self) -> list[bytes]:
        """A vote of each labeller; a text that is null or has no words gets none."""
        table = np.full(self.statistics.shape, ABSTAIN, np.uint8)
        for i, (_, junk, good) in enumerate(LABELLERS):
            if good is not None:
                table[self.statistics[:, i] <= good, i] = GOOD
            if junk is not None:
                table[self.statistics[:, i] >= junk, i] = JUNK
        table[self.n == 0] = ABSTAIN
        return [row.tobytes() for row in table]

    def features(self) -> np.ndarray:
        """Square roots of the shares of word shapes, words and pairs of either, by hash bucket; then statistics.

        Each statistic stands twice, the second time as what is above the labeller's
        limit for junk, or above a half. Texts of few words are drawn to zero, since
        their shares say little.
        """
        out = np.zeros((len(self.n), HASH_BUCKETS))
        at = 0
        for of, buckets in ((self.codes, SHAPE_BUCKETS), (self.hashes % (1 << 31), WORD_BUCKETS)):
            single = of * 2_654_435_761 % 4_294_967_291 % buckets + self.doc * buckets
            pairs = (of[:-1] * 1_000_003 + of[1:] * 8_191 + 1) % 2_147_483_647 % buckets + self.doc[:-1] * buckets
            counts = np.bincount(np.concatenate([single, pairs[self.paired]]), minlength=len(self.n) * buckets)
            out[:, at : at + buckets] = np.sqrt(counts.reshape(len(self.n), buckets) / (self.n + SHORT_WORDS)[:, None])
            at += buckets
        limits = np.array([0.5 if junk is None else junk for _, junk, _ in LABELLERS])
        above = np.maximum(0, self.statistics - limits) / (1 - limits)
        out[:, at:] = np.hstack([self.statistics, above]) * (self.n / (self.n + SHORT_WORDS))[:, None]
        return out


def repeated(values: np.ndarray, doc: np.ndarray, position: np.ndarray, docs: int, least: int) -> np.ndarray:
    """By text, the share of values that stand in the same window a second time or more.

    Texts with fewer than ``least`` values have 0. Texts are in order.
    """
    n = np.bincount(doc, minlength=docs)
    windows = -(-n // WINDOW_WORDS)
    window = (np.cumsum(windows) - windows)[doc] + position // WINDOW_WORDS
    key = np.sort(window * (1 << 40) + values % (1 << 40))
    first = key[np.r_[True, key[1:] != key[:-1]][: len(key)]] >> 40
    distinct = np.bincount(np.repeat(np.arange(docs), windows)[first], minlength=docs)
    return np.where(n >= least, 1 - distinct / np.maximum(n, 1), 0.0)


def portions(texts: pa.Array, vocabulary: Vocabulary) -> Iterator[tuple[slice, Portion]]:
    """The texts in portions of bounded size, each at least one text."""
    start = size = 0
    for i, length in enumerate(pc.binary_length(texts).to_pylist()):
        size += length or 0
        if size >= PORTION_BYTES or i + 1 - start >= PORTION_TEXTS or i + 1 == len(texts):
            yield slice(start, i + 1), Portion(texts.slice(start, i + 1 - start).to_pylist(), vocabulary)
            start, size = i + 1, 0


def fit_labellers(
    patterns: np.ndarray, weights: np.ndarray, unnoticed: float = UNNOTICED
) -> tuple[float, np.ndarray, np.ndarray]:
    """Expectation-maximisation over distinct vote patterns.

    Returns the share of good rows, the probability of each vote for each labeller
    and class (labellers x classes x votes), and the posterior probability of good
    for each pattern. It starts from the belief that a row with any junk vote is
    junk, which also fixes which class is which. ``unnoticed`` bounds what a vote
    other than junk can say for a row; 0 is plain EM.
    """
    labellers = patterns.shape[1]
    good = np.where((patterns == JUNK).any(axis=1), 0.05, 0.95)
    hits = np.stack([patterns == v for v in range(3)], axis=2).astype(float)
    for _ in range(EM_ROUNDS):
        mass = np.stack([weights * (1 - good), weights * good])
        prior = (mass[1].sum() + 1) / (mass.sum() + 2)
        table = np.einsum("cp,plv->lcv", mass, hits) + 0.5
        table /= table.sum(axis=2, keepdims=True)
        over = np.maximum(table[:, 1, JUNK] - FALSE_ALARMS, 0)
        table[:, 1, JUNK] -= over
        table[:, 1, ABSTAIN] += over
        for vote in (ABSTAIN, GOOD):
            table[:, 0, vote] = np.maximum(table[:, 0, vote], unnoticed * table[:, 1, vote])
        table[:, 0] /= table[:, 0].sum(axis=1, keepdims=True)
        odds = np.log(prior / (1 - prior)) + np.einsum(
            "plv,lv->p", hits, np.log(table[:, 1]) - np.log(table[:, 0])
        )
        following = 1 / (1 + np.exp(-np.clip(odds, -60, 60)))
        if np.abs(following - good).max() < 1e-9:
            break
        good = following
    assert table.shape == (labellers, 2, 3)
    return float(prior), table, following


@dataclass
class Scorer:
    """A linear scorer over hashed features; ``score`` is the probability of good text."""

    weights: np.ndarray
    bias: float

    def scores(self, texts: pa.Array, vocabulary: Vocabulary) -> np.ndarray:
        z = np.zeros(len(texts))
        for at, portion in portions(texts, vocabulary):
            z[at] = portion.features() @ self.weights + self.bias
        return 1 / (1 + np.exp(-np.clip(z, -60, 60)))

    def score(self, text: str | None) -> float:
        return float(self.scores(pa.array([text], pa.string()), Vocabulary())[0])


def fit_scorer(rows: list[tuple[list[int], list[float], float]]) -> Scorer:
    """Logistic regression on (buckets, values, probability of good), by accelerated gradient steps.

    Both classes weigh the same in sum. Without rows the scorer says good.
    """
    if not rows:
        return Scorer(np.zeros(HASH_BUCKETS), 1.0)
    parts = []
    for start in range(0, len(rows), FIT_PART):
        part = rows[start : start + FIT_PART]
        parts.append((
            slice(start, start + len(part)),
            np.array([len(r[0]) for r in part]),
            np.concatenate([np.asarray(r[0], np.uint16) for r in part]),
            np.concatenate([np.asarray(r[1], np.float32) for r in part]),
        ))
    target = np.array([r[2] for r in rows])
    share = np.array([(1 - target).mean(), target.mean()]) + 1e-3
    weight = ((1 - target) / share[0] + target / share[1]) / (2 * len(rows))
    # The loss bends at most by a quarter of the squared length of the rows.
    squares = np.concatenate([np.bincount(np.repeat(np.arange(len(n)), n), v * v, len(n)) for _, n, _, v in parts])
    rate = 4.0 / max(1.0, float(weight @ (squares + 1)))
    w = np.zeros(HASH_BUCKETS + 1)
    velocity = np.zeros_like(w)
    for step in range(FIT_ROUNDS):
        ahead = w + step / (step + 3) * velocity
        slope = PENALTY * ahead
        slope[-1] = 0
        for at, lengths, column, value in parts:
            row = np.repeat(np.arange(len(lengths)), lengths)
            z = np.bincount(row, value * ahead[column], len(lengths)) + ahead[-1]
            error = weight[at] * (1 / (1 + np.exp(-np.clip(z, -60, 60))) - target[at])
            slope[:-1] += np.bincount(column, value * error[row], HASH_BUCKETS)
            slope[-1] += error.sum()
        velocity = ahead - rate * slope - w
        w = w + velocity
    return Scorer(w[:-1], float(w[-1]))


@dataclass
class QualityModel:
    """Posterior of good by vote pattern, labeller tables and the scorer; all of bounded size."""

    prior: float
    labellers: np.ndarray
    posterior: dict[bytes, float]
    scorer: Scorer


def fit_quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> QualityModel:
    """Labels ``docs`` with the heuristics, weighs those by EM and fits the scorer.

    Votes of all rows count in EM; they reach the driver as counts of distinct vote
    patterns, which the number of labellers bounds. The scorer sees the
    ``FIT_ROWS`` rows with the smallest hash of id and text. Texts that are null or
    empty have no votes. An empty table gives a model that says good.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = Vocabulary()
        for batch in batches:
            cast = [v for _, portion in portions(batch.column(1), vocabulary) for v in portion.votes()]
            cast = pa.array(cast, pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), cast], names=["h", "votes"])
            release()

    hashed = docs.select(F.xxhash64(id_col, text_col).alias("h"), F.col(text_col).alias("text"))
    voted = stage(hashed.mapInArrow(run, "h long, votes binary"), "votes")
    counts = voted.groupBy("votes").count().collect()
    if not counts:
        return QualityModel(0.5, np.zeros((len(LABELLERS), 2, 3)), {}, fit_scorer([]))
    patterns = np.array([list(r[0]) for r in counts])
    prior, table, good = fit_labellers(patterns, np.array([r[1] for r in counts], float))
    posterior = {bytes(r[0]): float(p) for r, p in zip(counts, good)}
    bound = voted.select("h").orderBy("h").limit(FIT_ROWS).agg(F.max("h")).first()[0]
    drop_staged(voted)

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = Vocabulary()
        for batch in batches:
            used, shares, labels = [], [], []
            for _, portion in portions(batch.column(1), vocabulary):
                for vector, vote in zip(portion.features(), portion.votes()):
                    at = np.flatnonzero(vector)
                    used.append(at.astype(np.uint16).tobytes())
                    shares.append(vector[at].astype(np.float32).tobytes())
                    labels.append(posterior[vote])
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(used, pa.binary()),
                    pa.array(shares, pa.binary()),
                    pa.array(labels, pa.float64()),
                ],
                names=["h", "buckets", "shares", "good"],
            )
            release()

    fitted = hashed.where(F.col("h") <= bound).mapInArrow(
        features, "h long, buckets binary, shares binary, good double"
    )
    first = fitted.orderBy("h", "good").limit(FIT_ROWS).collect()
    rows = [(np.frombuffer(r[1], np.uint16), np.frombuffer(r[2], np.float32), r[3]) for r in first]
    return QualityModel(prior, table, posterior, fit_scorer(rows))


def score_quality(
    docs: DataFrame, model: QualityModel, text_col: str = "text", score_col: str = "quality_score"
) -> DataFrame:
    """``docs`` with the scorer's probability that a text is good. Row by row, without a shuffle."""
    scorer = model.scorer

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        vocabulary = Vocabulary()
        for texts in batches:
            yield pa.array(scorer.scores(texts, vocabulary))
            release()

    score = F.arrow_udf(run, "double", ArrowUDFType.SCALAR_ITER)
    return docs.withColumn(score_col, score(F.col(text_col)))


def keep_quality(
    docs: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """The rows of ``docs`` that a model fitted on them does not reject; columns stay.

    Rejected are scores below ``threshold``. Rows with null or empty texts are kept
    or rejected like any other, by their score.
    """
    name = "quality_score"
    while name in docs.columns:
        name += "_"
    model = fit_quality(docs, id_col, text_col)
    return score_quality(docs, model, text_col, name).where(F.col(name) >= threshold).drop(name)
