"""The corpus pipeline: quality classifier, SimHash near-dedup, substring dedup, mixing, byte-level BPE.

Each stage takes (spark, docs, sf_dir) and works on all that the one before it kept. Between stages the
documents are written as Parquet and read again, so a lost executor costs one stage at most.

Every stage takes null and empty texts, null and repeated ids, repeated rows, very long texts (they count whole),
columns beside those of documents (they ride along, whatever their names, up to the last stage) and
empty tables (which stay empty). What each does with them stands at the stage.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanwatch.llm import bpe, chunkdedup, mixing, quality, simhash
from spanwatch.llm.common import cut


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go (score under 0.5). Null and empty texts are scored like others, from
    measures that are all zero; equal rows have equal scores."""
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five-word shingles, similarity of 0.8 and more, counted exactly) the one with the
    smallest doc_id stays, null ids last. Texts without words are one group; of repeated rows one stays."""
    return simhash.keep_one_of_each(docs)


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that occur earlier in the corpus are cut out; n_chars follows the text. All rows stay; a null text stays
    null, one that repeats from end to end becomes empty."""
    out = chunkdedup.dedup_text(docs)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as its source's target weight asks for, three times at most. Null texts have size 0, null
    sources are one source, the last; repeated rows are documents of their own."""
    return mixing.mix(docs)


def encode_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of the texts: doc_id, source, n_tokens, ids. Null texts are empty and have none; all rows stay."""
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    encoded = bpe.encode(docs.select("doc_id", "source", "text"), path, public_tokenizers.PATTERN)
    return encoded.select("doc_id", "source", F.size("ids").cast("long").alias("n_tokens"), "ids")


STAGES = [
    ("quality classifier", keep_quality),
    ("SimHash near-dedup", drop_near_copies),
    ("substring dedup", drop_repeated_passages),
    ("mixing", mix_sources),
    ("byte-level BPE", encode_tokens),
]
ORACLE_SQL = None  # the stages but mixing are beyond SQL; tests compare them with brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), "pipeline")
    return STAGES[-1][1](spark, docs, sf_dir)
