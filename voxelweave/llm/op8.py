"""Query op8: toxicity of ``documents`` (see toxicity.py for the operator)."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxelweave.llm import toxicity
from voxelweave.llm.common import crc32_of_id, table

THRESHOLD = 0.7


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = crc32_of_id() % 3 == 1
    found = toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), learn=~held_out)
    return found.select("doc_id", held_out.alias("held_out"), "score", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).cast("int").alias("predicted"))


QUERIES = {"op8_toxicity": op8_toxicity}
ORACLE_SQL: dict[str, str] = {}
