"""The driver's contract: queries against their SQL, and the stream."""

import math

import duckdb
import pytest

import __spark_entry__ as entry
from voxelweave.plans.queries import ORACLE, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def plain(v):
    return "nan" if isinstance(v, float) and math.isnan(v) else repr(v + 0.0) if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", [n for n in QUERIES if n in ORACLE])
def test_query_against_sql(spark, duck, name):
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    rows = sorted(tuple(map(plain, r)) for r in df.select(*columns).collect())
    result = duck.execute(ORACLE[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    assert rows == sorted(tuple(plain(r[names.index(c)]) for c in columns) for r in result.fetchall())


def test_entry_and_names(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_stream_adds_up_to_the_batch(spark, tmp_path):
    from pyspark.sql import functions as F

    from voxelweave.operators.grid import insert
    from voxelweave.plans import fixtures as f
    from voxelweave.streaming.insertion import insert_stream, inserted

    points = f.shot_px(spark, SF).join(f.pixel(spark, SF), "t").select("shot", "k", "qx", "qy", "qz")
    points.repartition(3).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(points.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    q = insert_stream(stream, F.col("k"), f.GRID, f"{tmp_path}/parts", f"{tmp_path}/checkpoint")
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    want = {r.vox: r.w for r in insert(points, F.col("k"), f.GRID).collect()}
    assert {r.vox: r.w for r in inserted(spark, f"{tmp_path}/parts").collect()} == {v: pytest.approx(w) for v, w in want.items()}
