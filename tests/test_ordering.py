"""Numbers and running sums over many partitions."""

import pytest
from pyspark.sql import functions as F

from graphloom.operators import ordering


@pytest.fixture(params=["true", "false"])
def adaptive(spark, request):
    before = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", request.param)
    yield request.param
    spark.conf.set("spark.sql.adaptive.enabled", before)


def test_all_rows_get_one_number(spark, adaptive):
    rows = spark.range(200_000).select(F.format_string("n%08d", F.pmod(F.xxhash64("id"), F.lit(150_000))).alias("name"), "id", F.repeat(F.lit("wide "), (F.col("id") % 97).cast("int")).alias("text"))
    found = ordering.numbered(rows, ["name", "id"])
    total, distinct, least, most = found.agg(F.count("*"), F.count_distinct("number"), F.min("number"), F.max("number")).first()
    assert (total, distinct, least, most) == (200_000, 200_000, 1, 200_000)
    got = [r[0] for r in found.orderBy("number").select("id").collect()]
    assert got == [r[0] for r in rows.select("id", "name").orderBy("name", "id").select("id").collect()]


def test_numbers_of_odd_tables(spark, adaptive):
    assert ordering.numbered(spark.createDataFrame([], "a long"), ["a"]).count() == 0
    rows = spark.createDataFrame([(None, 7), (None, 7), ("x", 1), ("x", 1)], "a string, number long").repartition(3)
    assert sorted(r["number"] for r in ordering.numbered(rows, ["a"]).collect()) == [1, 2, 3, 4]
    assert sorted(r["number"] for r in ordering.numbered(rows, []).collect()) == [1, 2, 3, 4]


@pytest.mark.parametrize("descending", [False, True])
def test_running_sums_in_blocks(spark, descending):
    rows = spark.range(1000).select((F.col("id") % 3).alias("k"), F.floor(F.col("id") / 3).alias("at"), F.when(F.col("id") % 7 > 0, F.col("id") % 11).alias("v"))
    got = {(r["k"], r["at"]): r["s"] for r in ordering.running_sums(rows, ["k"], "at", {"s": "v"}, descending, block=16).collect()}
    plain = {(r["k"], r["at"]): r["v"] or 0 for r in rows.collect()}
    assert got == {(k, a): sum(v for (j, b), v in plain.items() if j == k and (b >= a if descending else b <= a)) for k, a in plain}
