"""Ranks, order statistics and medians of tables of any size: never all rows, or all distinct values, in one task.

Rows are dealt out by ranges and that table is stored, so the ranges that are counted are the ranges that are ranked, whatever Spark
does when a plan is run again (range bounds come from a sample). The driver gets one number for each range.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from voxelweave.session import cut


def _ranged(df: DataFrame, by: list[str], weight: str | None) -> tuple[DataFrame, DataFrame, int]:
    """(``df`` with ``part`` and the sum ``upto`` of weights up to its row, the rows of the parts before as a table, the sum of all)."""
    ranged = cut(df.repartitionByRange(*by).withColumn("part", F.spark_partition_id()))
    each = F.lit(1) if weight is None else F.col(weight)
    total, before = 0, []
    for r in sorted(ranged.groupBy("part").agg(F.sum(each).alias("n")).collect(), key=lambda r: r["part"]):
        before.append((r["part"], total))
        total += r["n"]
    running = F.sum(each).over(Window.partitionBy("part").orderBy(*by).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return ranged.withColumn("upto", running), df.sparkSession.createDataFrame(before or [(0, 0)], "part int, before long"), total


def ranked(df: DataFrame, by: list[str], name: str = "place") -> DataFrame:
    """``df`` with the place of each row by ``by``, from 0; which of equal rows comes first is open."""
    rows, before, _ = _ranged(df, by, None)
    place = (F.col("before") + F.col("upto") - 1).cast("long").alias(name)
    return rows.join(F.broadcast(before), "part").select(*df.columns, place)


def spans(df: DataFrame, col: str) -> tuple[DataFrame, int]:
    """((value, n, first, last), rows): the distinct values of ``col`` that are not null and the places, from 0, that they take in its order."""
    counts = df.filter(F.col(col).isNotNull()).groupBy(F.col(col).alias("value")).agg(F.count("*").alias("n"))
    rows, before, total = _ranged(counts, ["value"], "n")
    last = F.col("before") + F.col("upto") - 1
    return rows.join(F.broadcast(before), "part").select("value", "n", (last - F.col("n") + 1).alias("first"), last.alias("last")), total


def values_at(found: DataFrame, places: list[int]) -> dict[int, tuple]:
    """place -> (value, first): of ``places`` in the order of ``found`` (as spans); one row each comes to the driver."""
    if not places:
        return {}
    wanted = found.sparkSession.createDataFrame([(int(p),) for p in sorted(set(places))], "place long")
    rows = found.join(F.broadcast(wanted), F.col("place").between(F.col("first"), F.col("last"))).select("place", "value", "first").collect()
    return {r["place"]: (r["value"], r["first"]) for r in rows}


def middle(first: int, n: int) -> tuple[int, int]:
    """The places whose mean is the median of the ``n`` values from place ``first`` on."""
    return first + (n - 1) // 2, first + n // 2


def median(df: DataFrame, col: str) -> float | None:
    """The median of the values that are not null; None without any."""
    found, n = spans(df, col)
    if not n:
        return None
    low, high = middle(0, n)
    at = values_at(found, [low, high])
    return 0.5 * at[low][0] + 0.5 * at[high][0]
