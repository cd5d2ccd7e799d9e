"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (
    bpe,
    chat,
    fill_middle,
    fingerprint,
    hard_negatives,
    host_rules,
    lattice_lm,
    mixing,
    nn_descent,
    setsketch,
    suffix_dedup,
    toxicity,
    warc,
)
from .shared import table


def op1_nn_descent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nn_descent.near_vectors(table(spark, sf_dir, "embeddings"))


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.removal_report(table(spark, sf_dir, "documents"))


def op3_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.derivative_report(table(spark, sf_dir, "pages"))


def op4_bpe_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.tokenize(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op5_lattice_likelihood(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lattice_lm.score(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op6_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.fingerprint_report(table(spark, sf_dir, "documents"))


def op7_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixing_report(table(spark, sf_dir, "documents"))


def op8_setsketch_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return setsketch.near_duplicates(table(spark, sf_dir, "documents"), setsketch.Settings(words=3, percent=85))


def op9_chat_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    added = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit(said).alias("text"),
    )
    return chat.chat_report(turns.unionByName(added))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_middle.fill_report(table(spark, sf_dir, "documents"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = hard_negatives.relabelled(table(spark, sf_dir, "embeddings"))
    return hard_negatives.hard_negatives(rows, F.col("vec_id") % 100 == 0)


def op13_host_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return host_rules.rules_report(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_nn_descent,
        op2_suffix_dedup,
        op3_warc_derivatives,
        op4_bpe_automaton,
        op5_lattice_likelihood,
        op6_fingerprints,
        op7_mix_sources,
        op8_setsketch_dedup,
        op9_chat_round_trip,
        op10_toxicity,
        op11_fill_in_middle,
        op12_hard_negatives,
        op13_host_rules,
    )
}
SQL: dict[str, str] = {
    "op11_fill_in_middle": fill_middle.SQL,
    "op12_hard_negatives": hard_negatives.SQL,
    "op13_host_rules": host_rules.SQL,
}
