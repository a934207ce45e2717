"""Query op3: fingerprints of ``documents`` and of their edited texts (see syncmer.py for the operator)."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxelweave.llm import syncmer
from voxelweave.llm.common import table


def op3_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = syncmer.edit_trial(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id", "n_chars", F.sha2(F.col("edited_text").cast("binary"), 256).alias("edited_sha256"), "fingerprint", "edited_fingerprint",
        "near_edited", "near_next",
    )


QUERIES = {"op3_document_fingerprints": op3_document_fingerprints}
ORACLE_SQL: dict[str, str] = {}
