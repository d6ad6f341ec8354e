"""Language identification with language-bitmask n-gram filters.

Every language's character n-grams go into one bit-sliced Bloom filter: slice position -> 64-bit words
with a bit per language. Looking an n-gram up ANDs the words at its hash positions, which returns all
languages that contain it at once. Per-language popcounts over a text's n-grams are corrected for each
slice's false-positive rate; the language with the largest corrected share of hits is predicted.

The filter is fitted on a bounded sample of labelled rows (SAMPLE_DOCS per language, of their whole texts);
the sample's n-grams are counted in Spark. Every text is read whole.

Edge cases: null text or no letter gives `und`, score 0; a text without a full n-gram or without hits
gets the most frequent language (ties: the one that sorts first), score 0; ties go to the language that sorts
first; with nothing to learn from, every row is `und`; repeated rows are judged each alike; columns of the input
keep their names and values, but for those that the result names; an empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free_names

UNKNOWN = "und"
SAMPLE_DOCS = 1500
GRAM = 5
FILTER_BITS = 20
#: An n-gram belongs to a language if this many of its sample texts hold it, and at least this share of the best language's rate.
LEAST_DOCS, LEAST_SHARE = 2, 0.1
MULTIPLIERS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
LETTER = r"\p{L}"
#: Bytes whose n-grams are looked up at a time, and parts that the sample's n-grams are counted in.
STRETCH, COUNT_PARTS = 1 << 22, 16


def letters(text: str) -> bytes:
    """The lower-cased text as UTF-8; runs of other than letters are one space."""
    return regex.sub(r"[^\p{L}]+", " ", text.lower()).encode("utf-8")


def grams(b: bytes) -> np.ndarray:
    """64-bit codes of all n-grams of bytes."""
    a = np.frombuffer(b, dtype=np.uint8)
    n = len(a) - GRAM + 1
    if n <= 0:
        return np.empty(0, dtype=np.uint64)
    out = np.zeros(n, dtype=np.uint64)
    for k in range(GRAM):
        out = (out << np.uint64(8)) | a[k : k + n]
    return out


def stretches(b: bytes, step: int) -> Iterator[np.ndarray]:
    """The codes of long bytes, part by part; parts share GRAM - 1 bytes, so each n-gram comes once."""
    for at in range(0, max(0, len(b) - GRAM + 1), step):
        yield grams(b[at : at + step + GRAM - 1])


def positions(codes: np.ndarray, bits: int = FILTER_BITS) -> list[np.ndarray]:
    with np.errstate(over="ignore"):
        return [((codes * np.uint64(m)) >> np.uint64(64 - bits)).astype(np.int64) for m in MULTIPLIERS]


@dataclass
class BitmaskFilter:
    langs: list[str]
    words: list[np.ndarray]  # for each 64 languages: uint64 per slice position
    rates: np.ndarray  # false-positive rate per language
    common: int  # the most frequent language

    def lookup(self, codes: np.ndarray) -> np.ndarray:
        """Popcount per language over the n-grams."""
        at = positions(codes)
        out = np.zeros(len(self.langs))
        for w, word in enumerate(self.words):
            mask = word[at[0]]
            for p in at[1:]:
                mask &= word[p]
            for i in range(min(64, len(self.langs) - 64 * w)):
                out[64 * w + i] = np.count_nonzero(mask & np.uint64(1 << i))
        return out

    def predict(self, text: str | None, step: int = STRETCH) -> tuple[str, float, float | None]:
        """Language, score, and the best language's corrected share of hits (null without an n-gram)."""
        if not text or not self.langs or not regex.search(LETTER, text):
            return UNKNOWN, 0.0, None
        hits, n = np.zeros(len(self.langs)), 0
        for codes in stretches(letters(text), step):
            hits, n = hits + self.lookup(codes), n + len(codes)
        if not n:
            return self.langs[self.common], 0.0, None
        share = np.clip((hits / n - self.rates) / (1 - self.rates), 0, 1)
        best = int(np.argmax(share))
        if share[best] <= 0:
            return self.langs[self.common], 0.0, 0.0
        return self.langs[best], float(share[best] / share.sum()), float(share[best])


def build(counted: dict[str, tuple[int, np.ndarray, np.ndarray]]) -> BitmaskFilter:
    """The filter from each language's number of texts, n-grams, and numbers of texts that hold them."""
    langs = sorted(counted)
    words = [np.zeros(1 << FILTER_BITS, dtype=np.uint64) for _ in range(-(-max(1, len(langs)) // 64))]
    found, rates_of = [], []
    for lang in langs:
        docs, u, c = counted[lang]
        keep = c >= min(LEAST_DOCS, docs)
        found.append(u[keep])
        rates_of.append(c[keep] / max(1, docs))
    if langs:
        every, inverse = np.unique(np.concatenate(found), return_inverse=True)
        best = np.zeros(len(every))
        np.maximum.at(best, inverse, np.concatenate(rates_of))
        at = 0
        for i, (u, rate) in enumerate(zip(found, rates_of)):
            own = u[rate >= LEAST_SHARE * best[inverse[at : at + len(u)]]]
            at += len(u)
            for p in positions(own):
                words[i // 64][p] |= np.uint64(1 << (i % 64))
    # a foreign n-gram passes if all its positions are set by others
    rates = np.array([np.mean((words[i // 64] >> np.uint64(i % 64)) & np.uint64(1)) ** len(MULTIPLIERS) for i in range(len(langs))])
    return BitmaskFilter(langs, words, np.minimum(rates, 0.99), int(np.argmax([counted[x][0] for x in langs])) if langs else 0)


def held_by(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The n-grams of texts, and how many of the texts hold each."""
    codes = [np.unique(np.concatenate([np.empty(0, np.uint64), *(np.unique(x) for x in stretches(letters(t), STRETCH))])) for t in texts]
    return np.unique(np.concatenate(codes), return_counts=True) if codes else (np.empty(0, np.uint64), np.empty(0, np.int64))


def train(rows: list[tuple[str, str]]) -> BitmaskFilter:
    """rows: text and language."""
    by: dict[str, list[str]] = {}
    for t, lang in rows:
        by.setdefault(lang, []).append(t)
    return build({lang: (len(ts), *held_by(ts)) for lang, ts in by.items()})


def in_fold(id_col: Column, folds: int, fold: int) -> Column:
    return F.crc32(id_col.cast("string").cast("binary")) % folds == fold


def sample_rows(docs: DataFrame, per_lang: int = SAMPLE_DOCS) -> tuple[DataFrame, dict[str, int]]:
    """About per_lang rows of each language of docs (i, t, l), chosen by a hash of the row; and all rows of each language."""
    # a row per language, as the model has a bit for each
    counts = {r["l"]: r["n"] for r in docs.groupBy("l").agg(F.count("*").alias("n")).collect()}
    shares = docs.sparkSession.createDataFrame([(lang, min(1.0, per_lang / n)) for lang, n in counts.items()], "l string, share double")
    draw = F.pmod(F.xxhash64("i", "t", "l"), F.lit(1_000_003)) / F.lit(1_000_003.0)
    return docs.join(F.broadcast(shares), "l").filter(draw < F.col("share")).select("t", "l"), counts


def count_grams(rows: DataFrame) -> dict[str, tuple[int, np.ndarray, np.ndarray]]:
    """Of a bounded sample (t, l): per language its texts, and its n-grams with the texts that hold them.

    Tasks count their own texts; counts are summed per language and part of the codes; n-grams too rare to be learned
    stay there.
    """
    least = LEAST_DOCS

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for lang, texts in b.groupby("l", sort=False)["t"]:
                u, c = held_by(texts.tolist())
                part = (u % np.uint64(COUNT_PARTS)).astype(np.int64)
                for p in range(COUNT_PARTS):
                    on = part == p
                    # every part has the number of texts, of which the first is read
                    out.append((lang, p, len(texts), u[on].astype("<u8").tobytes(), c[on].astype("<i8").tobytes()))
            if out:
                yield pd.DataFrame(out, columns=["l", "part", "docs", "codes", "counts"])

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        codes = np.concatenate([np.frombuffer(x, dtype="<u8") for x in pdf["codes"]])
        counts = np.concatenate([np.frombuffer(x, dtype="<i8") for x in pdf["counts"]])
        u, at = np.unique(codes, return_inverse=True)
        c = np.bincount(at, weights=counts, minlength=len(u)).astype(np.int64)
        docs = int(pdf["docs"].sum())
        keep = c >= min(least, docs)
        return pd.DataFrame({"l": [pdf["l"].iloc[0]], "docs": [docs], "codes": [u[keep].astype("<u8").tobytes()], "counts": [c[keep].astype("<i8").tobytes()]})

    partial = rows.mapInPandas(count, "l string, part int, docs long, codes binary, counts binary")
    out: dict[str, list] = {}
    for r in partial.groupBy("l", "part").applyInPandas(add, "l string, docs long, codes binary, counts binary").collect():
        out.setdefault(r["l"], []).append(r)
    whole = lambda rs, k, t: np.concatenate([np.frombuffer(r[k], dtype=t) for r in rs])
    return {lang: (rs[0]["docs"], whole(rs, "codes", "<u8").astype(np.uint64), whole(rs, "counts", "<i8")) for lang, rs in out.items()}


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", folds: int = 4, held_out: int = 2, per_lang: int = SAMPLE_DOCS) -> BitmaskFilter:
    learn = docs.filter(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & ~F.coalesce(in_fold(F.col(id_col), folds, held_out), F.lit(False)))
    rows, counts = sample_rows(learn.select(F.col(id_col).alias("i"), F.col(text_col).alias("t"), F.col(lang_col).alias("l")), per_lang)
    counted = count_grams(rows)
    model = build(counted)
    if model.langs:  # the most frequent of all learning rows, not of the sample
        model.common = max(range(len(model.langs)), key=lambda i: (counts[model.langs[i]], -i))
    return model


def identify(docs: DataFrame, model: BitmaskFilter, text_col: str = "text", pred_col: str = "lang_pred", score_col: str = "lang_score", hits_col: str | None = None) -> DataFrame:
    """All columns of docs, and the predicted language with its score; with hits_col, the share of hits behind it too."""
    # plain values, as workers have no module to unpickle a class from; the size is fixed by FILTER_BITS
    shared = docs.sparkSession.sparkContext.broadcast((model.langs, model.words, model.rates, model.common))

    @F.pandas_udf("lang string, score double, hits double")
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        m = BitmaskFilter(*shared.value)
        for texts in batches:
            found = pd.DataFrame([m.predict(t) for t in texts], columns=["lang", "score", "hits"])
            found["hits"] = found["hits"].astype("float64")
            yield found

    new = {pred_col: "lang", score_col: "score"} | ({hits_col: "hits"} if hits_col else {})
    own = [F.col(f"`{c}`") for c in docs.columns if c not in new]
    (made,) = free_names([*docs.columns, *new], "_made")
    return docs.select(*own, predict(F.col(f"`{text_col}`")).alias(made)).select(*own, *[F.col(f"{made}.{k}").alias(c) for c, k in new.items()])


def crc_fold(doc_id: int, folds: int) -> int:
    return zlib.crc32(str(doc_id).encode()) % folds
