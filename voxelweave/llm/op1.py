"""Query op1: SimHash near-duplicates of ``documents`` (see simhash.py for the operator)."""

from pyspark.sql import DataFrame, SparkSession

from voxelweave.llm import simhash
from voxelweave.llm.common import table


def op1_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"), shingle=4, budget=4)
    return found.select("doc_id", simhash.hex_digits(found["fp"]).alias("fingerprint"), "component_id")


QUERIES = {"op1_simhash_near_dedup": op1_simhash_near_dedup}
ORACLE_SQL: dict[str, str] = {}
