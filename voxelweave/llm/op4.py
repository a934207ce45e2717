"""Query op4: byte-level BPE of ``documents`` there and back (see bpe.py for the operator)."""

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxelweave.llm import bpe
from voxelweave.llm.common import table

VOCABULARY = "byte_bpe_multi_50k.tiktoken"


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(table(spark, sf_dir, "documents"))


def round_trip(docs: DataFrame) -> DataFrame:
    back = bpe.encode_and_decode(docs, public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN)
    return back.select(
        "doc_id", F.expr("cast(length(ids) / 4 AS long)").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"),
    )


QUERIES = {"op4_byte_bpe": op4_byte_bpe}
ORACLE_SQL: dict[str, str] = {}
