"""Toxicity by compression distance with zstandard dictionaries.

zstandard trains one dictionary on ordinary text and one on toxic text. A text is cut into windows of whole
words; each window is compressed with either dictionary, and the toxic dictionary's lead in bytes is compared
with a threshold calibrated on labelled rows kept apart from training. The score is a logistic function,
fitted on those rows too, of the strongest lead and of the number and share of windows over the threshold.

Most of a toxic text is ordinary prose, and dictionaries trained on raw windows of either class differ mainly
in which of that prose they happen to hold (the README gives figures). So the trainer is given contrast: of a
toxic text it sees only the words whose document rate leads the ordinary class's, likewise of an ordinary
text; and both dictionaries open with the same ground, the words common to all sampled text. Ordinary prose
then compresses alike under both, and a lead in bytes comes from what tells the classes apart.

The fit uses a bounded sample (SAMPLE_DOCS labelled documents per class, whole texts); scoring reads whole texts.

Edge cases: null and empty texts have no windows and get the base score of such texts (under 0.5); no
toxic labels at all, or no ordinary ones, gives score 0; a document labelled more than once is toxic if any
label says so; null labels and labels of missing documents count nothing; repeated rows are scored alike, and
equal texts with equal labels teach once; columns of the input keep their names; an empty table gives an
empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .langid import in_fold

SAMPLE_DOCS = 3000
WINDOW_WORDS = 6
BASE_BYTES, TRAINED_BYTES = 24_576, 16_384
#: What zstandard's trainer weighs: segments of so many bytes, by parts of so many bytes.
SEGMENT, PART = 24, 6
#: zstandard finds no match that begins in a dictionary's last bytes.
DICT_END = b" " * 8
LEVEL, MIN_MATCH = 6, 6
#: A word tells the classes apart if its document rates differ by so many standard errors, and by this factor.
LEAST_Z, LEAST_RATIO = 6.0, 15.0
#: It is in at least so many sampled texts of its class, and in this share of them; beginnings of words count too.
LEAST_DOCS, LEAST_RATE = 4, 0.03
PREFIXES = range(4, 10)
FOLDS = 3
#: Fixed: the three repeat offsets with which a trained dictionary's header ends.
CONTENT_AFTER = b"\x01\x00\x00\x00\x04\x00\x00\x00\x08\x00\x00\x00"
#: Windows over the threshold that ordinary calibration texts may hold, per window.
WINDOW_ALARM = 0.002
#: Every window ends with this, and both dictionaries hold it: the cost of a first match is paid under both, and
#: zstandard, which seeks no match in a window's last bytes, still seeks one in its last word.
TAIL = b" ~end of the window~ "
CUT = b" .,;:!?\"'()[]{}|*#$%&\t\n\r"
SPLIT = bytes.maketrans(CUT, b" " * len(CUT))


def words_of(text: str | None) -> list[bytes]:
    return (text or "").lower().encode("utf-8").translate(SPLIT).split()


@dataclass
class CompressionModel:
    toxic: bytes
    ordinary: bytes
    threshold: int = 1
    weights: list[float] = field(default_factory=lambda: [-4.0, 0.0, 0.0, 0.0])

    def open(self) -> CompressionModel:
        self._c = [
            zstandard.ZstdCompressor(
                dict_data=zstandard.ZstdCompressionDict(d, dict_type=zstandard.DICT_TYPE_RAWCONTENT),
                compression_params=zstandard.ZstdCompressionParameters.from_level(LEVEL, dict_size=len(d), min_match=MIN_MATCH, write_content_size=False, write_checksum=False, write_dict_id=False),
            )
            for d in (self.ordinary, self.toxic)
        ]
        return self

    def leads(self, text: str | None) -> np.ndarray:
        """Bytes that the toxic dictionary saves over the ordinary one, per window."""
        ws = words_of(text)
        plain, toxic = self._c[0].compress, self._c[1].compress
        out = []
        for i in range(0, len(ws), WINDOW_WORDS):
            w = b" " + b" ".join(ws[i : i + WINDOW_WORDS]) + TAIL
            out.append(len(plain(w)) - len(toxic(w)))
        return np.asarray(out, dtype=np.int64)

    def features(self, d: np.ndarray) -> list[float]:
        """Of a text's leads: one, the strongest, the number and the share over the threshold."""
        if not len(d):
            return [1.0, 0.0, 0.0, 0.0]
        over = int((d >= self.threshold).sum())
        return [1.0, min(max(int(d.max()), 0), 40) / 8, math.log1p(over), over / len(d)]

    def score(self, text: str | None) -> float:
        if not self.toxic:
            return 0.0
        z = sum(a * b for a, b in zip(self.weights, self.features(self.leads(text))))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


class Sample:
    """The distinct words of labelled texts as numbers, and each word's units: itself closed by a space, and its beginnings."""

    def __init__(self, rows: list[tuple[str, int]]):
        rows = list(dict.fromkeys((t or "", y) for t, y in rows))  # copies would pass for evidence
        self.texts = [t for t, _ in rows]
        self.labels = np.array([y for _, y in rows], dtype=np.int64)
        number: dict[bytes, int] = {}
        self.words: list[np.ndarray] = [np.unique(np.array([number.setdefault(w, len(number)) for w in words_of(t)], dtype=np.int32)) for t in self.texts]
        self.vocabulary = list(number)
        del number
        size = np.array([1 + sum(k < len(w) for k in PREFIXES) for w in self.vocabulary], dtype=np.int64)
        self.start = np.concatenate([[0], np.cumsum(size)])
        # units by their digests: there are several for each word
        digests = np.fromiter((xxhash.xxh3_64_intdigest(u) for w in self.vocabulary for u in _units(w)), dtype=np.uint64, count=int(size.sum()))
        _, self.first, flat = np.unique(digests, return_index=True, return_inverse=True)
        self.flat = flat.astype(np.int32)
        self.held = [self._held(w) for w in self.words]

    def _held(self, words: np.ndarray) -> np.ndarray:
        size = self.start[words + 1] - self.start[words]
        at = np.repeat(self.start[words] - (np.cumsum(size) - size), size) + np.arange(size.sum())
        return np.unique(self.flat[at])

    def unit(self, i: int) -> bytes:
        at = int(self.first[i])
        w = int(np.searchsorted(self.start, at, side="right")) - 1
        return _units(self.vocabulary[w])[at - int(self.start[w])]

    def rates(self, held: list[np.ndarray], rows: np.ndarray, n: int) -> np.ndarray:
        """How many of the rows hold each of n things."""
        out = np.zeros(n, dtype=np.int32)
        for i in rows.tolist():
            out[held[i]] += 1
        return out


def _units(word: bytes) -> list[bytes]:
    return [word + b" ", *(word[:k] for k in PREFIXES if k < len(word))]


def _telling(sample: Sample, own: np.ndarray, other: np.ndarray) -> list[bytes]:
    """Words and beginnings whose document rate in the own class leads; the longest of those that always come together."""
    n, m = max(1, len(own)), max(1, len(other))
    a, b = (sample.rates(sample.held, rows, len(sample.first)) for rows in (own, other))
    p, q = a / n, b / m
    with np.errstate(divide="ignore", invalid="ignore"):
        z = (p - q) / np.sqrt((a + b) / (n + m) * (1 / n + 1 / m))
    ok = (a >= LEAST_DOCS) & (p >= LEAST_RATE) & (p > LEAST_RATIO * q) & (z >= LEAST_Z)
    covered: dict[bytes, int] = {}
    out = []
    for u, count in sorted(((sample.unit(i), int(a[i])) for i in np.flatnonzero(ok).tolist()), key=lambda x: (-len(x[0]), x[0])):
        if covered.get(u) != count:
            out.append(u)
            for k in range(1, len(u)):
                covered[u[:k]] = max(covered.get(u[:k], 0), count)
    return out


def _trained(sample: Sample, rows: np.ndarray, telling: list[bytes]) -> bytes:
    """What zstandard trains on the telling parts of the rows; the parts themselves where these are too few to train on."""
    keep = set(telling)
    part: dict[int, bytes] = {}
    for i, w in enumerate(sample.vocabulary):  # of each word the longest telling part
        if found := max((u for u in _units(w) if u in keep), key=len, default=None):
            part[i] = found.rstrip()
    samples = [b" ".join([b"", *(part[i] for i in sample.words[r].tolist() if i in part), b""]) for r in rows.tolist()]
    samples = [s for s in samples if s.strip()]
    if not samples:
        return b""
    try:
        return zstandard.train_dictionary(TRAINED_BYTES, samples, k=SEGMENT, d=PART).as_bytes().partition(CONTENT_AFTER)[2] + b" "
    except zstandard.ZstdError:
        return b" ".join([b"", *sorted(u.rstrip() for u in telling), b""])


def logistic(x: np.ndarray, y: np.ndarray, rounds: int = 60, ridge: float = 0.05) -> np.ndarray:
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(x.shape[1])
        step = np.linalg.solve(h, x.T @ (y - p) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def _dictionaries(sample: Sample, rows: np.ndarray) -> CompressionModel:
    by = [rows[sample.labels[rows] == y] for y in (0, 1)]
    if not len(by[0]) or not len(by[1]):
        return CompressionModel(b"", b"")
    toxic, ordinary = _telling(sample, by[1], by[0]), _telling(sample, by[0], by[1])
    told, base, size = {u.rstrip() for u in toxic}, [], 0
    rate = sample.rates(sample.words, rows, len(sample.vocabulary))
    for i in sorted(np.flatnonzero(rate).tolist(), key=lambda i: (-rate[i], sample.vocabulary[i])):
        w = sample.vocabulary[i]
        if told.isdisjoint({w, *(w[:k] for k in PREFIXES)}):
            base.append(w)
            if (size := size + len(w) + 1) > BASE_BYTES:
                break
    # the telling parts without their heads are common ground, or ordinary words that end alike would seem telling
    tails = sorted({u[3:] for u in (*toxic, *ordinary) if len(u) > 6})
    common = TAIL + b" ".join(reversed(base)) + b" " + b" ".join(tails)[:TRAINED_BYTES]
    return CompressionModel(common + _trained(sample, by[1], toxic) + DICT_END, common + _trained(sample, by[0], ordinary) + DICT_END).open()


def train(rows: list[tuple[str, int]]) -> CompressionModel:
    """rows: text and label, in any fixed order. Threshold and weights are fitted on the leads of folds kept from the dictionaries."""
    sample = Sample(rows)
    every = np.arange(len(sample.texts))
    model = _dictionaries(sample, every)
    if not model.toxic:
        return model
    apart: list[tuple[np.ndarray, int]] = []
    for f in range(FOLDS):
        part = _dictionaries(sample, every[every % FOLDS != f])
        if part.toxic:
            apart += [(part.leads(sample.texts[i]), int(sample.labels[i])) for i in every[every % FOLDS == f].tolist()]
    plain = [d for d, y in apart if not y and len(d)]
    model.threshold = max(2, int(np.quantile(np.concatenate(plain), 1 - WINDOW_ALARM)) + 1) if plain else 2
    x = np.array([model.features(d) for d, _ in apart])
    y = np.array([v for _, v in apart], dtype=float)
    if 0 < y.sum() < len(y):
        model.weights = logistic(x, y).tolist()
    return model


def sample_rows(docs: DataFrame, labels: DataFrame, folds: int = 5, held_out: int = 0, per_class: int = SAMPLE_DOCS) -> list[tuple[str, int]]:
    """About per_class labelled rows of each class outside the held-out fold, in order of their ids."""
    known = labels.filter(F.col("toxic").isNotNull() & ~in_fold(F.col("doc_id"), folds, held_out)).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    n = known.agg(F.sum(F.when(F.col("toxic") == 1, 1).otherwise(0)).alias("t"), F.count("*").alias("a")).first()
    share = F.when(F.col("toxic") == 1, F.lit(min(1.0, per_class / max(1, n["t"] or 0)))).otherwise(F.lit(min(1.0, per_class / max(1, n["a"] - (n["t"] or 0)))))
    draw = F.pmod(F.xxhash64("doc_id"), F.lit(1_000_003)) / F.lit(1_000_003.0)
    chosen = known.filter(draw < share)
    # about 2 * per_class rows by construction, so they can be broadcast
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("doc_id", "text", "toxic")
    found = [(r["doc_id"], r["text"] or "", int(r["toxic"])) for r in rows.toLocalIterator()]
    return [(t, y) for _, t, y in sorted(found)]


def score_toxicity(docs: DataFrame, model: CompressionModel, text_col: str = "text", score_col: str = "toxicity") -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast((model.toxic, model.ordinary, model.threshold, model.weights))  # bounded by BASE_BYTES and TRAINED_BYTES

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        m = CompressionModel(*shared.value)
        if m.toxic:
            m.open()
        for texts in batches:
            yield pd.Series([m.score(t) for t in texts], dtype="float64")

    own = [F.col(f"`{c}`") for c in docs.columns if c != score_col]
    return docs.select(*own, score(F.col(f"`{text_col}`")).alias(score_col))


def fit(docs: DataFrame, labels: DataFrame, folds: int = 5, held_out: int = 0) -> CompressionModel:
    return train(sample_rows(docs, labels, folds, held_out))


def held_out_flag(id_col: Column) -> Column:
    return in_fold(id_col, 5, 0)
