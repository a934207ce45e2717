"""Query op7: token-id files of ``documents``, written and read back (see tokenfile.py and pfor.py for the operator)."""

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from voxelweave.llm import tokenfile
from voxelweave.llm.common import fresh_path, table

VOCABULARY, END = "word_bpe_49k.json", 1


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_path(spark, "token-files")
    tokenfile.write_token_files(table(spark, sf_dir, "documents"), path, public_tokenizers.path(VOCABULARY), END)
    found = tokenfile.with_starts(tokenfile.read_token_files(spark, path))
    return found.selectExpr("cast(doc_id AS long) AS doc_id", "start", "n_tokens", "ids_crc32")


QUERIES = {"op7_token_files": op7_token_files}
ORACLE_SQL: dict[str, str] = {}
