"""Queries whose results were whole on small tables only."""

import random

from pyspark.sql import functions as F

from quern.config import VectorConfig
from quern.operators import knn as K
from quern.operators import store as D
from quern.plans import catalog, store_queries  # noqa: F401


def test_added_vectors_have_ids_of_their_own_however_ranges_are_merged(spark):
    """Wide rows stay in several ranges, while a count of them, which reads few columns, merges those into one."""
    held = {k: spark.conf.get(k, None) for k in ("spark.sql.adaptive.coalescePartitions.minPartitionSize", "spark.sql.adaptive.advisoryPartitionSizeInBytes")}
    r = random.Random(5)
    rows = [(i, [r.random() for _ in range(64)]) for i in range(400)]
    r.shuffle(rows)
    new = spark.createDataFrame(rows, "label long, embedding array<double>").withColumn("place", F.col("label"))
    store = spark.createDataFrame([(9, 1000, [1.0] * 64)], "vec_id long, label long, embedding array<double>")
    try:
        for k in held:
            spark.conf.set(k, "16k")
        got = [(x.vec_id, x.label) for x in K.add(store, new, VectorConfig(dimension=64), "place").select("vec_id", "label").collect()]
    finally:
        for k, v in held.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    assert sorted(got) == [(9, 1000), *((10 + i, i) for i in range(400))]


def rows_and_sql(spark, tmp_path, name, sizes):
    """A query's rows, and those of its SQL, on a table of 18,000 parts that take these sizes in turn."""
    import duckdb

    size = F.element_at(F.array(*map(F.lit, sizes)), (F.col("id") % len(sizes) + 1).cast("int"))
    parts = spark.range(18_000).select(F.col("id").alias("p_partkey"), F.lit("PROMO").alias("p_type"), size.alias("p_size"))
    parts.write.parquet(f"file://{tmp_path}/part.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW part AS SELECT * FROM '{tmp_path}/part.parquet/*.parquet'")
    got = [tuple(r) for r in catalog.QUERIES[name](spark, f"file://{tmp_path}").collect()]
    return got, sorted(con.sql(catalog.ORACLES[name]).fetchall())


def test_greater_than_returns_all_rows(spark, tmp_path):
    got, want = rows_and_sql(spark, tmp_path, "store_greater_than", (45, 46, 50))
    assert len(got) == 12_000 and got == want  # also in the order of the id


def test_less_than_returns_all_rows(spark, tmp_path):
    got, want = rows_and_sql(spark, tmp_path, "store_less_than", (5, 4, 1))
    assert len(got) == 12_000 and got == want


def test_further_operators_return_all_rows(spark, tmp_path):
    got, want = rows_and_sql(spark, tmp_path, "store_further_operators", (9, 10, 20))
    assert len(got) == 12_000 and got == want


def test_no_limit_after_an_offset(spark):
    assert [r.id for r in D.query(spark.range(150), D.Query(limit=None, offset=20)).collect()] == list(range(20, 150))
    assert D.query(spark.range(150), D.Query()).count() == 100
