"""Query op6: verdicts on the urls of ``pages`` (see url_filter.py for the operator)."""

from pyspark.sql import DataFrame, SparkSession

from voxelweave.llm import url_filter
from voxelweave.llm.common import table

# Fixed values: (verdict, host, path).
RULES = (("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/"))


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge_urls(table(spark, sf_dir, "pages"), RULES)


QUERIES = {"op6_url_filter": op6_url_filter}
ORACLE_SQL: dict[str, str] = {}
