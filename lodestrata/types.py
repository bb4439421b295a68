"""Logical types: how each is stored in Spark, and which values it takes."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T


@dataclass(frozen=True)
class Logical:
    name: str
    spark: T.DataType
    low: int | None = None
    high: int | None = None


def _whole(bits: int, signed: bool) -> Logical:
    """An integer type. Spark has no unsigned ones, so these take the next wider type."""
    low, high = (-(1 << bits - 1), (1 << bits - 1) - 1) if signed else (0, (1 << bits) - 1)
    room = [(8, T.ByteType()), (16, T.ShortType()), (32, T.IntegerType()), (64, T.LongType())]
    kind = next((t for b, t in room if bits + (not signed) <= b), T.DecimalType(20, 0))
    return Logical(f"{'' if signed else 'U'}INT{bits}", kind, low, high)


TYPES: dict[str, Logical] = {t.name: t for t in [*(_whole(b, s) for b in (8, 16, 32, 64) for s in (True, False)), Logical("FLOAT", T.FloatType()), Logical("DOUBLE", T.DoubleType()), Logical("BOOLEAN", T.BooleanType()), Logical("TEXT", T.StringType())]}


def logical(name: str) -> Logical:
    """The type of that name; UNKNOWN, BYTE_ARRAY and other names raise."""
    if name not in TYPES:
        raise ValueError(f"no type for values: {name}")
    return TYPES[name]


def checked(value, kind: Logical):
    """value, if the type takes it; numbers for FLOAT and DOUBLE become floats. None is any type's null."""
    if value is None:
        return None
    if kind.low is not None:
        if isinstance(value, bool) or not isinstance(value, int) or not kind.low <= value <= kind.high:
            raise ValueError(f"{value!r} isn't a value of {kind.name}")
        return value
    if kind.name in ("FLOAT", "DOUBLE"):
        if isinstance(value, bool) or not isinstance(value, (int, float)):
            raise ValueError(f"{value!r} isn't a value of {kind.name}")
        return float(value)
    if not isinstance(value, bool if kind.name == "BOOLEAN" else str):
        raise ValueError(f"{value!r} isn't a value of {kind.name}")
    return value
