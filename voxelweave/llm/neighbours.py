"""Rows in id order over many partitions, each with the row after it, by one shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Characters of the text that deal out rows of one id, so that neither null ids nor one id of very many rows are one task's.
LEAD = 64


def order_key(id_col: str, text_col: str) -> Column:
    """Ids in order, nulls first, then the beginnings of texts: an order that agrees with that of (id, text)."""
    return F.struct(F.col(id_col).alias("id"), F.substring(F.col(text_col), 1, LEAD).alias("lead"))


def range_starts(df: DataFrame, key: Column, parts: int) -> list:
    """The least keys of at most ``parts`` ranges of about as many rows; only the keys are read and shuffled."""
    keys = df.select(key.alias("key")).repartitionByRange(parts, "key")
    starts = keys.groupBy(F.spark_partition_id().alias("p")).agg(F.min("key").alias("key")).select("key").collect()  # ``parts`` rows at most
    return sorted((tuple(r["key"]) for r in starts), key=lambda k: (k[0] is not None, k[0] if k[0] is not None else 0, k[1].encode("utf-8", "surrogatepass")))


def literal_of(start: tuple, id_type: str) -> Column:
    return F.struct(F.lit(start[0]).cast(id_type).alias("id"), F.lit(start[1]).alias("lead"))


def range_of(key: Column, starts: list[Column]) -> Column:
    """The place of the range a key is in. Two steps, so that many ranges stay cheap."""
    if len(starts) < 2:
        return F.lit(0)
    step = max(1, int(len(starts) ** 0.5))
    block = F.greatest(F.size(F.filter(F.array(*starts[::step]), lambda s: s <= key)), F.lit(1)) - 1
    within = F.size(F.filter(F.slice(F.array(*starts), block * step + 1, F.lit(step)), lambda s: s <= key))
    return F.greatest(block * step + within - 1, F.lit(0)).cast("int")


def in_order_with_next(df: DataFrame, id_col: str, text_col: str, parts: int) -> DataFrame:
    """``df`` with columns part and extra, sorted within partitions by (part, extra, ``id_col``, ``text_col``).

    The rows of a part are all on one task, in ascending order of id (nulls first) and text. After them stand, with extra true, copies of the rows that can
    be the first of the next part; the first row of all follows the last part. So the row after a row is the next one of
    its part, and the only copies are those of the rows of the least key of a part.
    """
    key = order_key(id_col, text_col)
    id_type = df.schema[id_col].dataType.simpleString()
    starts = [literal_of(s, id_type) for s in range_starts(df, key, parts)]
    n = max(1, len(starts))
    part = range_of(key, starts)
    leads = key.isin(starts[1:]) if n > 1 else F.lit(False)
    first = key == starts[0] if starts else F.lit(True)
    places = F.when(leads, F.array(part, part - 1 + n)).when(first, F.array(part, F.lit(n - 1 + n))).otherwise(F.array(part))
    dealt = df.withColumn("part", F.explode(places)).withColumn("extra", F.col("part") >= n).withColumn("part", F.col("part") % n)
    return dealt.repartitionById(n, "part").sortWithinPartitions("part", "extra", F.col(id_col).asc_nulls_first(), text_col)
