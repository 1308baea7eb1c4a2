import math

from pyspark.sql import functions as F

from portolan.functions import codes, labels, numeric


def one(spark, column, **values):
    names = list(values)
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{n} {t(values[n])}" for n in names))
    return df.select(column.alias("x")).first()["x"]


def t(value):
    return {int: "int", float: "double", str: "string"}[type(value)]


def test_leading_zero_codes(spark):
    k = F.col("k")
    assert one(spark, codes.hs6(k), k=30420) == "030420"
    assert one(spark, codes.hs2(k), k=30420) == 3
    assert one(spark, codes.hs2(k, "raw"), k=30420) == "30"
    assert one(spark, codes.hs4(k), k=30420) == 304
    assert one(spark, codes.hs2(k), k=610910) == 61
    assert one(spark, codes.hs2(k), k=0) == 0


def test_long_codes_are_not_cut(spark):
    assert one(spark, codes.hs6(F.col("k")), k=1234567) == "1234567"
    assert one(spark, codes.hs2(F.col("k")), k=1234567) == 12


def test_unreadable_code_is_zero(spark):
    df = spark.createDataFrame([(None,)], "k int")
    assert df.select(codes.hs2(F.col("k"))).first()[0] == 0


def test_unit_value_needs_a_quantity(spark):
    df = spark.createDataFrame([(5.0, None), (5.0, 0.0), (5.0, 2.0)], "v double, q double")
    assert [r[0] for r in df.select(numeric.unit_value(F.col("v"), F.col("q"))).collect()] == [None, None, 2.5]


def test_smoothed_unit_value_of_zero_quantity(spark):
    assert one(spark, numeric.smoothed_unit_value(F.col("v"), F.col("q")), v=5.0, q=0.0) == 5000.0


def test_clamped_log(spark):
    df = spark.createDataFrame([(-3.0,), (0.0,), (math.e - 1,), (None,)], "x double")
    got = [r[0] for r in df.select(numeric.clamped_log(F.col("x"))).collect()]
    assert got[:2] == [0.0, 0.0] and abs(got[2] - 1) < 1e-12 and got[3] is None


def test_ratios(spark):
    a, b = F.col("a"), F.col("b")
    assert one(spark, numeric.share(a, b), a=1.0, b=0.0) == 0.0
    assert one(spark, numeric.coverage_pct(a, b), a=1.0, b=0.0) is None
    assert one(spark, numeric.coverage_pct(a, b), a=79.0, b=100.0) == 79.0
    assert one(spark, numeric.change_pct(a, b), a=3.0, b=0.0) is None
    assert one(spark, numeric.span(a, b), a=1995, b=2023) == 29


def test_rounding_half_to_even(spark):
    df = spark.createDataFrame([(0.125,), (0.375,), (2.5,)], "x double")
    assert [r[0] for r in df.select(numeric.even_round(F.col("x"))).collect()] == [0.12, 0.38, 2.5]


def test_labels(spark):
    x = F.col("x")
    assert one(spark, labels.shorten(x, 5), x="abcdefg") == "abcde..."
    assert one(spark, labels.shorten(x, 5), x="abcde") == "abcde"
    assert one(spark, labels.chapter_description(F.lit("61"), x, 3), x="T-shirts") == "61: T-s..."
    assert one(spark, labels.partner_label(F.lit(None).cast("string"), x), x=899) == "Country_899"
    assert one(spark, labels.money(x), x=1234567.8) == "$1,234,568"
    assert one(spark, labels.billions(x), x=713.24e9) == "$713.2B"
    assert one(spark, labels.percent(x), x=79.04) == "79.0%"


def test_bands(spark):
    df = spark.createDataFrame([(0.15,), (0.151,), (0.25,), (0.26,)], "h double")
    assert [r[0] for r in df.select(labels.concentration_band(F.col("h"))).collect()] == ["low", "moderate", "moderate", "high"]
    df = spark.createDataFrame([(1.0,), (0.0,), (-1.0,)], "x double")
    assert [r[0] for r in df.select(labels.sign_class(F.col("x"))).collect()] == ["surplus", "even", "deficit"]
    assert [r[0] for r in df.select(labels.bar_colour(F.col("x"))).collect()] == ["green", "red", "red"]


def test_quadrants(spark):
    df = spark.createDataFrame([(9.0, 9.0), (1.0, 9.0), (9.0, 1.0), (1.0, 1.0)], "r double, s double")
    got = df.select(labels.quadrant(F.col("r"), F.col("s"), F.lit(5.0), F.lit(5.0))).collect()
    assert [r[0] for r in got] == ["Stars", "Cash Cows", "Question Marks", "Dogs"]
