"""Query op5: secrets in ``documents`` (see secrets.py for the operator)."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from voxelweave.llm import secrets
from voxelweave.llm.common import table


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.find_secrets(table(spark, sf_dir, "documents"))

    def joined(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    base = F.filter("secrets", lambda s: s["kind"].isin(*secrets.BASE_KINDS))
    kinds = F.transform("secrets", lambda s: s["kind"])
    counts = [F.size(F.array_remove(kinds, k)) for k in secrets.BASE_KINDS]
    counts = [(F.size("secrets") - n).cast("long").alias(f"n_{k}") for k, n in zip(secrets.BASE_KINDS, counts)]
    return found.select("doc_id", *counts, F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"), joined(F.col("secrets")).alias("spans"))


QUERIES = {"op5_secret_scan": op5_secret_scan}
ORACLE_SQL: dict[str, str] = {}
