"""Arithmetic of 24-bit words."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ORDERS = ["ABC", "ACB", "BAC", "BCA", "CAB", "CBA"]


def to_uint24(v: Column) -> Column:
    return v.bitwiseAND(F.lit(16777215).cast("long"))


def to_int24(v: Column) -> Column:
    u = to_uint24(v)
    return F.when(u >= 8388608, u - 16777216).otherwise(u)


def byte(v: Column, name: str) -> Column:
    """Byte A (highest), B or C of the low 24 bits."""
    return F.shiftrightunsigned(to_uint24(v), {"A": 16, "B": 8, "C": 0}[name]).bitwiseAND(F.lit(255).cast("long"))


def permute(v: Column, order: str) -> Column:
    a, b, c = (byte(v, k) for k in order)
    return a * 65536 + b * 256 + c


def transform_word(v: Column, signedness: str, order: str) -> Column:
    p = permute(v, order)
    return to_int24(p) if signedness == "int24" else p


def bit_length(u: Column) -> Column:
    return F.when(u == 0, 0).otherwise(F.length(F.bin(u)))


def trailing_zeros(u: Column) -> Column:
    """24 for zero."""
    return F.when(u == 0, 24).otherwise(F.length(F.bin(u)) - F.length(F.rtrim(F.bin(u), F.lit("0"))))


def leading_zeros(u: Column) -> Column:
    return 24 - bit_length(u)
