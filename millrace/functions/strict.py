"""Strict numbers as column expressions.

Signed integers (8 to 64 bits) raise on overflow, division by zero and negating the least value, as
Spark does under ANSI; narrower ones are checked by their cast. Unsigned integers wrap. ``truncate_to``
keeps the low bits. Floats divide as IEEE 754 says. u64 values are decimal(20,0), u32 and below long.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

SIGNED = {"i8": "tinyint", "i16": "smallint", "i32": "int", "i64": "bigint"}
UNSIGNED = {"u8": 8, "u16": 16, "u32": 32, "u64": 64}
_D = "decimal(38,0)"


def spark_type(kind: str) -> str:
    """The Spark type of a kind: signed, unsigned, f32, f64 or string."""
    if kind in SIGNED:
        return SIGNED[kind]
    if kind in UNSIGNED:
        return "decimal(20,0)" if kind == "u64" else "bigint"
    return {"f32": "float", "f64": "double", "string": "string"}[kind]


def _exact(value: int) -> Column:
    """A whole number of any size up to 38 digits."""
    return F.lit(str(value)).cast(_D)


def _wrap(value: Column, kind: str) -> Column:
    """``value`` modulo 2**bits; it must be exact in its own type."""
    if kind == "u64":
        return F.pmod(value.cast(_D), _exact(1 << 64)).cast("decimal(20,0)")
    return F.pmod(value, F.lit(1 << UNSIGNED[kind]).cast("bigint"))


def add(a: Column, b: Column, kind: str) -> Column:
    if kind in SIGNED:
        return (a.cast(SIGNED[kind]) + b.cast(SIGNED[kind])).cast(SIGNED[kind])
    return _wrap(a.cast(_D) + b.cast(_D) if kind == "u64" else a + b, kind)


def subtract(a: Column, b: Column, kind: str) -> Column:
    if kind in SIGNED:
        return (a.cast(SIGNED[kind]) - b.cast(SIGNED[kind])).cast(SIGNED[kind])
    return _wrap(a.cast(_D) - b.cast(_D) if kind == "u64" else a - b, kind)


def multiply(a: Column, b: Column, kind: str) -> Column:
    if kind in SIGNED:
        return (a.cast(SIGNED[kind]) * b.cast(SIGNED[kind])).cast(SIGNED[kind])
    if kind != "u64":
        return F.pmod((a.cast("decimal(10,0)") * b.cast("decimal(10,0)")).cast(_D), _exact(1 << UNSIGNED[kind])).cast("bigint")
    half = _exact(1 << 32)  # 64 x 64 bits exceed 38 digits: multiply by halves of b, whose high product only counts modulo 2**32
    a, b = a.cast(_D), b.cast(_D)
    low, high = F.pmod(b, half).cast("decimal(10,0)"), ((b - F.pmod(b, half)) / half).cast("decimal(10,0)")
    upper = F.pmod((F.pmod(a, half).cast("decimal(10,0)") * high).cast(_D), half)
    return _wrap((a.cast("decimal(20,0)") * low).cast(_D) + upper * half, "u64")


def divide(a: Column, b: Column, kind: str) -> Column:
    """Truncating; raises on zero. Floats: IEEE, see ``divide_float``."""
    return _div(a, b).cast(spark_type(kind))


def _div(a: Column, b: Column) -> Column:
    """Integral division; the least long by -1 raises, as it overflows."""
    least = F.lit(-(1 << 63)).cast("bigint")
    overflow = F.raise_error(F.lit("integer overflow")).cast("bigint")
    quotient = (a.cast(_D) - a.cast(_D) % b.cast(_D)) / b.cast(_D)
    return F.when((a == least) & (b == -1), overflow).otherwise(F.round(quotient).cast(_D))


def remainder(a: Column, b: Column, kind: str) -> Column:
    """Sign of the dividend; raises on zero."""
    return (a % b).cast(spark_type(kind))


def negate(a: Column, kind: str) -> Column:
    if kind in SIGNED:
        return (-a.cast(SIGNED[kind])).cast(SIGNED[kind])
    return subtract(F.lit(0), a, kind)


def truncate_to(a: Column, kind: str) -> Column:
    """The low bits of an integer (or the whole part of a float), read as ``kind``; never raises."""
    if kind in UNSIGNED:
        return _wrap(a.cast("bigint") if kind != "u64" else a.cast(_D), kind)
    bits = {"i8": 8, "i16": 16, "i32": 32, "i64": 64}[kind]
    span, half = _exact(1 << bits), _exact(1 << (bits - 1))
    return (F.pmod(a.cast(_D) + half, span) - half).cast(SIGNED[kind])


def bit_and(a: Column, b: Column) -> Column:
    return a.bitwiseAND(b)


def bit_or(a: Column, b: Column) -> Column:
    return a.bitwiseOR(b)


def bit_xor(a: Column, b: Column) -> Column:
    return a.bitwiseXOR(b)


def bit_not(a: Column, kind: str) -> Column:
    return F.bitwise_not(a) if kind in SIGNED else _exact((1 << UNSIGNED[kind]) - 1).cast(spark_type(kind)) - a


def shift_left(a: Column, n: int, kind: str) -> Column:
    """Bits shifted out are lost."""
    if kind in SIGNED:
        return truncate_to(a.cast(_D) * _exact(1 << n), kind) if n < 32 else F.shiftleft(a.cast("bigint"), n)
    return multiply(a, _exact(1 << n).cast(spark_type(kind)), kind)


def shift_right(a: Column, n: int, kind: str) -> Column:
    """Arithmetic for signed kinds, logical for unsigned ones."""
    return F.shiftright(a, n) if kind in SIGNED else _div(a, _exact(1 << n)).cast(spark_type(kind))


def divide_float(a: Column, b: Column, kind: str = "f64") -> Column:
    """IEEE division: by zero gives an infinity with the sign of both operands, or NaN."""
    t = spark_type(kind)
    a, b = a.cast(t), b.cast(t)
    inf, nan = F.lit(float("inf")).cast(t), F.lit(float("nan")).cast(t)
    negative_zero = b.cast("string") == "-0.0"
    signed = F.when((a > 0) != negative_zero, inf).otherwise(-inf)
    return F.when(b != 0, a / F.when(b != 0, b)).otherwise(F.when((a == 0) | F.isnan(a), nan).otherwise(signed)).cast(t)


def equal_float(a: Column, b: Column) -> Column:
    """NaN equals nothing, itself included."""
    return ~F.isnan(a) & ~F.isnan(b) & (a == b)


def less_float(a: Column, b: Column) -> Column:
    return ~F.isnan(a) & ~F.isnan(b) & (a < b)


def text(a: Column, kind: str) -> Column:
    """A number as text. Floats: the shortest digits that read back as the same number, in the shorter of the plain
    and the scientific notation (plain if both are as long), ``inf``, ``-inf`` and ``nan``."""
    if kind not in ("f32", "f64"):
        return a.cast(spark_type(kind)).cast("string")

    @F.pandas_udf("string")
    def shortest(values: pd.Series) -> pd.Series:
        return pd.Series([_float_text(x) for x in values.to_numpy()], dtype=str)  # numpy scalars keep their width

    a = a.cast(spark_type(kind))
    return F.when(a.isNotNull(), F.when(F.isnan(a), "nan").otherwise(shortest(a)))


def _float_text(x: np.floating) -> str:
    if not np.isfinite(x):
        return "nan" if np.isnan(x) else "inf" if x > 0 else "-inf"
    plain = str(int(x)) if abs(x) >= 2**53 else np.format_float_positional(x, unique=True, trim="-")
    scientific = np.format_float_scientific(x, unique=True, trim="-", exp_digits=2)
    return plain if len(plain) <= len(scientific) else scientific
