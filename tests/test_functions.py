"""Scalar functions on hand-written values."""

import pytest
from pyspark.sql import functions as F

from rubrica.functions import text as tx
from rubrica.functions.scores import score32, score64


def one(spark, col):
    return spark.range(1).select(col.alias("v")).first().v


def values(spark, fn, given):
    df = spark.createDataFrame([(i, g) for i, g in enumerate(given)], "i int, t string")
    return [r.v for r in df.select("i", fn(F.col("t")).alias("v")).orderBy("i").collect()]


SPLITS = [
    (None, None),
    ("  ", None),
    ("a|b", ["a", "b"]),
    ("a|b|", ["a", "b"]),
    ("a, b", ["a", " b"]),
    ("a|", ["a|"]),
    ("a,,b,", ["a", "", "b"]),
    ("x", ["x"]),
]


@pytest.mark.parametrize("given,want", SPLITS)
def test_split_list(given, want):
    assert tx.split_list(given) == want


def test_split_list_col_agrees(spark):
    assert values(spark, tx.split_list_col, [g for g, _ in SPLITS]) == [w for _, w in SPLITS]


def test_parse_int(spark):
    given = ["12", " +5 ", "-7", "1,000", "1.0", "2147483648", "", None, "1d"]
    assert values(spark, tx.parse_int, given) == [12, 5, -7, None, None, None, None, None, None]


def test_parse_float(spark):
    given = ["1.5", "1,234", "1e3", ".5", "1d", "abc", "", None, "-Infinity"]
    got = values(spark, tx.parse_float, given)
    assert got == [1.5, 1234.0, 1000.0, 0.5, None, None, None, None, float("-inf")]
    assert str(values(spark, tx.parse_float, ["NaN"])[0]) == "nan"


def test_parse_datetime(spark):
    given = ["2020-01-02", "2020-01-02T03:04:05Z", "2020-01-02T03:04:05.000+01:00", "1/2/2020", "1/2/2020 3:04:05 PM", "2020-13-01", "20200102030405", "soon", "", None]
    got = [None if v is None else v.strftime("%m-%d %H:%M") for v in values(spark, tx.parse_datetime, given)]
    assert got == ["01-02 00:00", "01-02 03:04", "01-02 02:04", "01-02 00:00", "01-02 15:04", None, None, None, None, None]


def test_is_datetime_accepts_compact_forms(spark):
    given = ["20200102030405", "202001020304", "01.02.2020", "20200102030405-050000", "nope", None]
    assert values(spark, tx.is_datetime, given) == [True, True, True, True, False, False]


def test_parse_boolean(spark):
    assert values(spark, tx.parse_boolean, ["yes", "T", "0", "No", "maybe", None]) == [True, True, False, False, None, None]


def test_similarity(spark):
    assert one(spark, tx.similarity(F.lit("kitten"), F.lit("sitting"))) == 58
    assert one(spark, tx.similarity(F.lit(""), F.lit(None).cast("string"))) == 100


def test_class_display_name(spark):
    assert values(spark, tx.class_display_name, ["healthAssessments", "goals"]) == ["Health Assessments", "Goals"]


def test_truncate(spark):
    assert values(spark, lambda c: tx.truncate_value(c, 3), ["abcd", "abc", None]) == ["abc...", "abc", "N/A"]


def test_scores_differ_between_widths(spark):
    assert one(spark, score32(F.lit(29), F.lit(50))) == 58
    assert one(spark, score64(F.lit(29), F.lit(50))) == 57
    assert one(spark, score32(F.lit(0), F.lit(0))) == 0


def test_score32_matches_numpy(spark):
    import numpy as np

    df = spark.range(1, 200).withColumnRenamed("id", "n").join(spark.range(1, 200).withColumnRenamed("id", "d"), F.col("n") <= F.col("d"))
    for r in df.select("n", "d", score32(F.col("n"), F.col("d")).alias("s")).collect():
        assert r.s == int(np.float32(np.float32(r.n) / np.float32(r.d)) * np.float32(100)), (r.n, r.d)
