import math

import pytest
from pyspark.sql import functions as F

from millrace.functions import strict
from millrace.functions.metadata import get_metadata, set_metadata
from millrace.functions.schema import StreamSchema, compatible


def value(spark, column):
    column = column() if callable(column) else column
    return spark.range(1).select(column.alias("x")).first().x


def L(x):
    return F.lit(x)


@pytest.mark.parametrize(
    ("column", "expected"),
    [
        (lambda: strict.subtract(L(5), L(10), "u32"), 4294967291),
        (lambda: strict.add(L(4294967295), L(2), "u32"), 1),
        (lambda: strict.multiply(L(4294967295), L(4294967295), "u32"), 1),
        (lambda: strict.multiply(L("18446744073709551615").cast("decimal(20,0)"), L("18446744073709551615").cast("decimal(20,0)"), "u64"), 1),
        (lambda: strict.multiply(L("12345678901234567890").cast("decimal(20,0)"), L("9876543210987654321").cast("decimal(20,0)"), "u64"), 12345678901234567890 * 9876543210987654321 % 2**64),
        (lambda: strict.subtract(L(0), L(1), "u64"), 2**64 - 1),
        (lambda: strict.add(L(250), L(10), "u8"), 4),
        (lambda: strict.divide(L(-7), L(2), "i32"), -3),
        (lambda: strict.remainder(L(-7), L(2), "i32"), -1),
        (lambda: strict.truncate_to(L(300), "i8"), 44),
        (lambda: strict.truncate_to(L(200), "i8"), -56),
        (lambda: strict.truncate_to(L(-1), "u32"), 4294967295),
        (lambda: strict.bit_not(L(0), "u32"), 4294967295),
        (lambda: strict.bit_not(L(0), "i32"), -1),
        (lambda: strict.bit_and(L(12), L(10)), 8),
        (lambda: strict.bit_or(L(12), L(10)), 14),
        (lambda: strict.bit_xor(L(12), L(10)), 6),
        (lambda: strict.shift_left(L(3), 31, "u32"), 2147483648),
        (lambda: strict.shift_left(L(1), 31, "i32"), -(2**31)),
        (lambda: strict.shift_right(L(-8), 1, "i32"), -4),
        (lambda: strict.negate(L(5), "i32"), -5),
        (lambda: strict.negate(L(5), "u8"), 251),
        (lambda: strict.divide_float(L(1.0), L(0.0)), math.inf),
        (lambda: strict.divide_float(L(-1.0), L(0.0)), -math.inf),
        (lambda: strict.divide_float(L(1.0), L(-0.0)), -math.inf),
        (lambda: strict.divide_float(L(1.0), L(4.0)), 0.25),
        (lambda: strict.equal_float(L(float("nan")), L(float("nan"))), False),
        (lambda: strict.less_float(L(1.0), L(2.0)), True),
    ],
)
def test_numbers(spark, column, expected):
    assert value(spark, column) == expected


@pytest.mark.parametrize(
    ("number", "kind", "expected"),
    [
        (1.0, "f64", "1"), (-0.0, "f64", "-0"), (0.1, "f64", "0.1"), (0.1, "f32", "0.1"), (12345.678, "f64", "12345.678"), (10000.0, "f64", "10000"), (100000.0, "f64", "1e+05"),
        (123456.0, "f64", "123456"), (0.0001, "f64", "1e-04"), (0.001, "f64", "0.001"), (0.00123, "f64", "0.00123"), (1e300, "f64", "1e+300"), (5e-324, "f64", "5e-324"), (2.0**70, "f64", "1180591620717411303424"),
        (16777216.0, "f32", "16777216"), (math.inf, "f64", "inf"), (-math.inf, "f32", "-inf"), (math.nan, "f64", "nan"), (7, "i8", "7"), (-5, "i64", "-5"), (2**64 - 1, "u64", "18446744073709551615"),
    ],
)
def test_text(spark, number, kind, expected):
    column = L(str(number)).cast(strict.spark_type(kind))
    assert value(spark, strict.text(column, kind)) == expected
    assert value(spark, strict.text(L(None), kind)) is None


def test_zero_by_zero(spark):
    assert math.isnan(value(spark, strict.divide_float(L(0.0), L(0.0))))


@pytest.mark.parametrize(
    "column",
    [
        lambda: strict.add(L(2**31 - 1), L(1), "i32"),
        lambda: strict.add(L(120), L(10), "i8"),
        lambda: strict.multiply(L(2**62), L(4), "i64"),
        lambda: strict.negate(L(-(2**31)), "i32"),
        lambda: strict.divide(L(10), L(0), "i32"),
        lambda: strict.divide(L(-(2**31)), L(-1), "i32"),
        lambda: strict.divide(L(-(2**63)), L(-1), "i64"),
        lambda: strict.remainder(L(10), L(0), "i32"),
    ],
)
def test_strict_failures(spark, column):
    with pytest.raises(Exception):  # noqa: B017
        value(spark, column)


def test_metadata(spark):
    m = set_metadata(set_metadata(L(None).cast("map<string,string>"), "a", "1"), "a", "2")
    row = spark.range(1).select(get_metadata(m, "a").alias("a"), get_metadata(m, "b").alias("b")).first()
    assert (row.a, row.b) == ("2", None)


def test_schema(spark):
    s = StreamSchema().add_field("id", "i64").add_field("name", "string").add_field("score", "f64").add_field("id", "u64")
    assert s.field_index("id") == 0 and s.field_index("x") is None
    assert not s.is_compatible_with(StreamSchema(s.fields[::-1])) and s.is_compatible_with(StreamSchema(list(s.fields)))
    assert [f.dataType.simpleString() for f in s.struct()] == ["bigint", "string", "double", "decimal(20,0)"]
    with pytest.raises(ValueError):
        s.add_field("x", "bool")
    assert compatible(spark.range(1), spark.range(2).withColumn("id", F.when(F.col("id") > 0, F.col("id"))))
    assert not compatible(spark.range(1), spark.range(1).withColumn("id", F.col("id").cast("int")))
