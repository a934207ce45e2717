"""Query op10: quality of ``documents`` (see quality.py for the operator)."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxelweave.llm import quality
from voxelweave.llm.common import crc32_of_id, table

THRESHOLD = 0.7


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = crc32_of_id() % 4 == 2
    found = quality.quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), learn=~held_out)
    return found.select("doc_id", held_out.alias("held_out"), "score", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).cast("int").alias("predicted"))


QUERIES = {"op10_quality": op10_quality}
ORACLE_SQL: dict[str, str] = {}
