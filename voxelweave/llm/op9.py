"""Query op9: language-model scores of ``documents`` (see brown.py for the operator)."""

from pyspark.sql import DataFrame, SparkSession

from voxelweave.llm import brown
from voxelweave.llm.common import crc32_of_id, table


def op9_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = crc32_of_id() % 7 == 2
    found = brown.text_scores(table(spark, sf_dir, "documents"), learn=~held_out)
    return found.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


QUERIES = {"op9_lm_scores": op9_lm_scores}
ORACLE_SQL: dict[str, str] = {}
