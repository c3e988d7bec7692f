"""Names with long numbers."""

from pyspark.sql import functions as F

from regionspark.functions import natural_key, safe_name


def test_long_index_is_whole(spark):
    rows = spark.createDataFrame([(7, "a/b"), (1234567, "c:d"), (None, "e")], "i long, name string")
    got = [r.n for r in rows.select("i", safe_name(F.col("i"), F.col("name")).alias("n")).orderBy("i").collect()]
    assert got == [None, "000007__a_b.png", "1234567__c_d.png"]


def test_long_digit_runs_sort_as_numbers(spark):
    names = ["a2", "a10", "a010b", "a" + "1" * 21, "a" + "1" * 20 + "2", "a" + "9" * 20, "a" + "1" * 30, "b1"]
    rows = spark.createDataFrame([(n,) for n in names], "name string")
    got = [r.name for r in rows.orderBy(natural_key(F.col("name"))).collect()]
    assert got == ["a2", "a10", "a010b", "a" + "9" * 20, "a" + "1" * 21, "a" + "1" * 20 + "2", "a" + "1" * 30, "b1"]
