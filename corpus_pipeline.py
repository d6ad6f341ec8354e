"""A corpus pipeline: toxicity, language, near duplicates, mixture, packing.

STAGES are applied in order to the table documents; each function takes (spark, docs, sf_dir), works on
all that its predecessor kept, and returns a DataFrame that is written as Parquet and read again.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recallgrid.llm import langid, mixing, ngram_join, packing, toxicity
from recallgrid.llm.common import free_names, table, written

#: Rejected from this toxicity on.
TOXIC = 0.5


def own(docs: DataFrame) -> list:
    return [F.col(f"`{c}`") for c in docs.columns]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents under the toxicity threshold; null and empty texts stay."""
    model = toxicity.fit(docs.select("doc_id", "text"), table(spark, sf_dir, "labels"))
    (score,) = free_names(docs.columns, "toxicity")
    scored = toxicity.score_toxicity(docs, model, score_col=score)
    return scored.filter(F.col(score) < TOXIC).select(*own(docs))


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in one of the learned languages.

    Those without a letter go, and those whose n-grams no learned language's filter holds beyond chance (a
    script or language never learned); a text too short for an n-gram stays.
    """
    model = langid.fit(docs)
    lang, score, hits = free_names(docs.columns, "lang_found", "lang_score", "lang_hits")
    named = langid.identify(docs, model, pred_col=lang, score_col=score, hits_col=hits)
    return named.filter((F.col(lang) != langid.UNKNOWN) & (F.col(hits).isNull() | (F.col(hits) > 0))).select(*own(docs))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked at a Jaccard similarity of 0.75 on five-word shingles."""
    return ngram_join.keep_one(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources played to their temperature weights; no document is lost, those of small sources recur."""
    return mixing.mix(docs).select(*own(docs))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their place in a sequence."""
    packed = packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


STAGES = [
    ("toxicity", drop_toxic),
    ("language_id", known_language),
    ("ngram_jaccard_join", drop_near_duplicates),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: Compression distances and tokenizers have no SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
