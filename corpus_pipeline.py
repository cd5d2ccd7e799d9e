"""A corpus pipeline: five stages over the documents, each a table for the next one."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallymap.llm import bpe, mixing, setsketch, suffix_dedup, toxicity
from tallymap.llm.shared import staged, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: No SQL expresses the stages; the tests hold them against plain versions.
ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score stays below the threshold, learnt from the labels of these documents."""
    settings = toxicity.Settings()
    model = toxicity.train(toxicity.labelled_rows(docs, table(spark, sf_dir, "labels")), settings)
    scored = toxicity.score(docs.select(*COLUMNS), model)
    return scored.where(F.col("toxicity") < settings.threshold).select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group with five-word shingles 0.8 alike."""
    return setsketch.keep_one(docs.select(*COLUMNS))


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the byte strings that repeat; bytes of a character cut in two go with it."""
    cut = suffix_dedup.cut_texts(docs.select(*COLUMNS))
    return cut.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents drawn so that sources, languages and topics have their target shares of tokens."""
    return mixing.mix(docs.select(*COLUMNS)).where("mix_kept").select(*COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, with digests of the ids and of the text decoded from them."""
    return bpe.tokenize(docs, public_tokenizers.path("word_bpe_49k.json"), with_text=True).drop("decoded")


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("suffix_repeats", cut_repeats),
    ("mix_sources", mix_sources),
    ("bpe", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet and read again by the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
