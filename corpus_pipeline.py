"""A corpus pipeline of five stages: language, exact copies, near copies, mixture, packing.

Each stage takes what the one before kept, as a written table, and its decisions take effect: rows that it rejects are
gone. All but the last return the columns of ``documents``.

Defined cases, of every stage: null ids are documents of their own, and of copies that have no other id one stays; a null
text is empty (language identification rejects it); very long texts are read whole; repeated rows are copies, of which
one stays; an empty table gives an empty table; columns other than those of ``documents`` are left out, whatever they are
named, and columns that are missing are null.
"""

from __future__ import annotations

import contextlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayloom.llm import exact_dedup, language_id, mixing, near_dedup, packing
from wayloom.llm.common import drop, scratch, temporary

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def columns(docs: DataFrame) -> DataFrame:
    """The columns of ``documents``; a table that lacks one has nulls there, or the text's code points for ``n_chars``."""
    have = set(docs.columns)
    stand_in = {"n_chars": F.char_length(F.coalesce("text", F.lit(""))).cast("bigint") if "text" in have else F.lit(None).cast("bigint")}
    kinds = {"doc_id": "bigint", "n_chars": "bigint"}
    return docs.select(*[F.col(c) if c in have else stand_in.get(c, F.lit(None)).cast(kinds.get(c, "string")).alias(c) for c in COLUMNS])


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in no learned language go: without letters, or unlike every profile."""
    docs = columns(docs)
    return language_id.identified(docs, language_id.learn(docs.where(~language_id.held_out()).select("doc_id", "text", "lang")))


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts stays, the longest, then the one of the smallest id."""
    return exact_dedup.deduplicated(columns(docs))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays, the one of the smallest id."""
    return near_dedup.deduplicated(columns(docs))


def mix_domains(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents stay at the rates that bring the domains' tokens to the target weights."""
    return mixing.mixed(columns(docs), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What stays, as pieces of full sequences; each document's ids are in exactly one set of pieces."""
    import public_tokenizers

    return packing.pack(docs.select("doc_id", "text"), public_tokenizers.path("word_bpe_49k.json")).drop("ids")


STAGES = [
    ("language_id", identify_language),
    ("exact_dedup", drop_exact_copies),
    ("near_dedup", drop_near_copies),
    ("mixing", mix_domains),
    ("packing", pack_sequences),
]

#: Near copies, trained classifiers and tokenizers have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    with contextlib.ExitStack() as last:  # a stage's table goes once the next one is written, its working tables with it
        for name, stage in STAGES[:-1]:
            with contextlib.ExitStack() as now:
                out = scratch(spark, f"stage-{name}")
                now.enter_context(temporary(spark))
                frame = stage(spark, docs, sf_dir)
                frame.write.parquet(out)
                docs = spark.read.schema(frame.schema).parquet(out)
            last.close()
            if name != STAGES[-2][0]:
                last.callback(drop, spark, out)
    return STAGES[-1][1](spark, docs, sf_dir)
