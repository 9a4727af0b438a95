from pyspark.sql import functions as F

from petrilake.functions.numbering import families


def test_numbers_and_names(spark):
    f = families(a_ij=[(0, 1), (3, 6)], b_ijk=[(2, 5), (3, 6), (0, 1)])
    a, b = f["a_ij"], f["b_ijk"]
    assert (a.first, a.end, b.first, b.end) == (1, 4, 4, 13)
    rows = spark.createDataFrame([(i, j) for i in (2, 3, 4) for j in (3, 4, 5)], "i int, j int")
    got = rows.select(b.number(F.col("i"), F.col("j"), F.lit(0)).alias("v")).orderBy("v")
    assert [r.v for r in got.collect()] == list(range(4, 13))
    names = spark.range(1).select(a.label(F.lit(2)), b.label(F.lit(10)))
    assert tuple(names.first()) == ("a_ij [0, 4]", "b_ijk [4, 3, 0]")
