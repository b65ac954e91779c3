"""Row hashes and additive fingerprints made of built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Widths of the three parts of a 64-bit hash that are summed apart: sums stay exact for 2**41 rows.
LOW_BITS = 21
LOW_MASK = (1 << LOW_BITS) - 1


def _has_map(kind: T.DataType) -> bool:
    if isinstance(kind, T.ArrayType):
        return _has_map(kind.elementType)
    if isinstance(kind, T.StructType):
        return any(_has_map(f.dataType) for f in kind)
    return isinstance(kind, (T.MapType, T.VariantType))


def row_hash(df: DataFrame, columns: list[str], salt: int = 0) -> Column:
    """64-bit hash of the columns in which null, a value's place and its neighbours all count.

    The built-in hash skips nulls, so that (null, 1) and (1, null) would agree; a flag of each null prevents that.
    Maps have no hash; their JSON text is hashed.
    """
    parts: list[Column] = [F.lit(salt)]
    for name in columns:
        c = df[f"`{name}`"]
        parts += [c.isNull(), F.to_json(c) if _has_map(df.schema[name].dataType) else c]
    return F.xxhash64(*parts)


def additive(h: Column, name: str) -> list[Column]:
    """Aggregates of a hash column that add up over partial groups: three exact sums."""
    return [
        F.sum(F.shiftrightunsigned(h, 2 * LOW_BITS)).alias(f"{name}_hi"),
        F.sum(F.shiftrightunsigned(h, LOW_BITS).bitwiseAND(LOW_MASK)).alias(f"{name}_mid"),
        F.sum(h.bitwiseAND(LOW_MASK)).alias(f"{name}_lo"),
    ]


def additive_names(name: str) -> list[str]:
    return [f"{name}_hi", f"{name}_mid", f"{name}_lo"]
