"""A training corpus from ``documents``: five stages, each on all that the stage before has kept.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes it as Parquet to the shared folder and reads it again as the next stage's
docs. All stages but the last return the columns of ``documents``, and whatever further columns docs has.

In every stage a null text counts as empty (and stays null where the row stays), a row with a null id is treated like any other, and an empty table stays empty. Repeated rows are
kept or rejected alike by all stages but near_duplicates, which keeps one of them.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxelweave.llm import bpe, jaccard, quality, secrets, winnow
from voxelweave.llm.common import crc32_of_id, delete_written, table, written, written_so_far

#: Classifier scores from here on are good; a document is contaminated if one in so many of its words is hit.
QUALITY, SHARE = 0.7, 20
VOCABULARY = "byte_bpe_multi_50k.tiktoken"


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go; rows with crc32(doc_id) mod 4 = 2 are not learned from. Without usable labels all stay."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"), crc32_of_id() % 4 != 2, QUALITY)


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays, that of the smallest id; links are a Jaccard similarity of five-word shingles of 0.8 or more, and those of SimHash (op1).
    Texts without words are one group."""
    return jaccard.deduplicated(docs)


def uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents go of which one word in SHARE at least lies in a passage of the benchmark; those without words stay, and an empty benchmark takes none."""
    return winnow.decontaminated(docs, table(spark, sf_dir, "benchmark"), SHARE)


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document stays; secrets in it are masked, and n_chars is that of the text as it is now (null for a null text)."""
    clean = secrets.redacted(docs)
    return clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else clean


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids, ids_sha256, decoded_sha256): token ids as little-endian unsigned 32-bit integers; the digest of the text decoded from them shows that nothing is lost."""
    back = bpe.encode_and_decode(docs, public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN)
    return back.select("doc_id", F.expr("cast(length(ids) / 4 AS long)").alias("n_tokens"), "ids", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [("quality", good), ("near_duplicates", distinct), ("decontamination", uncontaminated), ("secrets", without_secrets), ("encoding", encoded)]

#: SQL can't express the classifier, SimHash over XXH64, or BPE; tests/llm/test_pipeline.py has a plain version of each stage.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage. Each stage's output replaces that of the one before, and the tables that a stage's operator wrote on its way go with it."""
    docs, start = table(spark, sf_dir, "documents"), written_so_far()
    for name, stage in STAGES:
        docs, path = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
        delete_written(spark, start, path)
    return docs
