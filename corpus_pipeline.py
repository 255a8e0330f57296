"""A training-corpus pipeline over `documents`: quality rules, language ID, near-duplicate removal, packing.

Each stage takes (spark, docs, sf_dir) and works on all rows that its predecessor kept. The first three return
the columns of `documents`, whatever their names; the last returns the pieces of the packed sequences.

Defined cases of all stages: an empty table gives an empty result; very long texts are read whole; columns that
no stage reads are carried along.
"""

from __future__ import annotations

from functools import partial

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandbase.llm import common, langid, neardup, packing, quality


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that fail a rule of their own or whose host is rejected.

    Null and empty texts fail; a null source is a host of its own; repeated rows are judged, and stay, one by one; a
    figure that just meets a limit passes.
    """
    return quality.keep_good(docs)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a recognisable language or clearly not in the one they state.

    Null texts and those without a letter go; a null lang contradicts nothing; equal rows share their fate; a tie
    between languages contradicts nothing. If nothing can be learned, no language is recognisable.
    """
    profiles = langid.learn(docs, ~F.coalesce(langid.held_out(), F.lit(False)))
    return langid.keep_known(docs, profiles)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the least id of each class of near copies.

    Null and empty texts are copies of each other; of repeated rows one stays; an id that stands for several texts is
    decided for each text; rows with a null id all stay.
    """
    return neardup.keep_one(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs every remaining document into sequences of at most 1024 tokens.

    A null or empty text is the end id alone; repeated rows and null ids are packed one by one.
    """
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("quality_rules", quality_rules), ("language_id", language_id), ("near_duplicates", near_duplicates), ("packing", pack_sequences)]

#: Language profiles, MinHash classes and BPE can't be written in SQL; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what each returns is written as Parquet and read again, and its own scratch tables go."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = common.settled(partial(stage, spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
