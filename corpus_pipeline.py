"""A corpus made ready for training: five stages, each on all that the one before has kept."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowledger.llm import langid, minhash, packing, spans, toxicity
from flowledger.llm.scratch import columns, keep

#: Share of a document that its main language must hold.
LEAST = 0.5


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, and those of which no language holds at least LEAST, go. Where no language could be
    learned at all, which no document is to blame for, only those without a letter go."""
    found = langid.identify(docs)
    told = F.when(F.col("languages") > 0, (F.col("lang_pred") != "und") & (F.col("score") >= LEAST)).otherwise(F.coalesce(F.regexp_like("text", F.lit(r"\p{L}")), F.lit(False)))
    return found.where(told).select(*columns(docs.columns))


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are predicted to be toxic go."""
    return toxicity.score(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")).where("predicted = 0").select(*columns(docs.columns))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates, by five-word shingles with a similarity of 0.8 or more, the document with the
    smallest id stays."""
    return minhash.one_of_each(docs)


def repeated_spans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that an earlier document has go; n_chars counts what is left."""
    left = spans.dedup(docs)
    return left.select(*[F.char_length("text").cast("long").alias("n_chars") if c == "n_chars" else columns([c])[0] for c in docs.columns])


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("language_id", language_id), ("toxicity", toxic), ("simhash", near_duplicates), ("substring_dedup", repeated_spans), ("packing", packed)]

#: The stages hash, learn and tokenize; tests/llm hold them against plain versions instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = keep(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
