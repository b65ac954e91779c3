"""Number formats and conversions of image data.

Spark has no unsigned types: values are carried in a wider signed type and named by their NumPy type.
"""

from __future__ import annotations

import bisect
import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Integer types by name, with their bits and whether they are signed, and Spark's carrier.
INTEGERS = {"uint8": (8, False, "smallint"), "uint16": (16, False, "int"), "uint32": (32, False, "bigint"), "int8": (8, True, "tinyint"), "int16": (16, True, "smallint"), "int32": (32, True, "int")}
FLOATS = {"float32": "float", "float64": "double"}
ITEM_BYTES = {"uint8": 1, "int8": 1, "bool": 1, "uint16": 2, "int16": 2, "uint32": 4, "int32": 4, "float32": 4, "uint64": 8, "int64": 8, "float64": 8}


def limits(dtype: str) -> tuple[int, int]:
    if dtype == "uint64":
        return 0, (1 << 64) - 1
    bits, signed, _ = INTEGERS[dtype]
    return (-(1 << bits - 1), (1 << bits - 1) - 1) if signed else (0, (1 << bits) - 1)


def wrap(value: Column, dtype: str) -> Column:
    """A whole number modulo the type's range, as an integer cast in C does."""
    bits, signed, carrier = INTEGERS[dtype]
    half = 1 << bits - 1 if signed else 0
    return (F.pmod(value.cast("bigint") + half, F.lit(1 << bits)) - half).cast(carrier)


def stretch_cast(v: Column, least: Column, most: Column, dtype: str) -> Column:
    """Min-max stretch to the width of an integer type, never by less than 1 and without its lower end, wrapping; to 0..1 for floats.

    A flat image counts as a range of 1.
    """
    span = F.when(most == least, F.lit(1.0)).otherwise((most - least).cast("double"))
    if dtype in FLOATS:
        return ((v - least) / span).cast(FLOATS[dtype])
    lo, hi = limits(dtype)
    return wrap(F.floor((v - least) * F.greatest(F.lit(float(hi - lo)) / span, F.lit(1.0))), dtype)


def saturating_cast(v: Column, dtype: str) -> Column:
    """Clip and truncate; a value that is no number or infinite raises."""
    lo, hi = limits(dtype)
    carrier = "decimal(20,0)" if dtype == "uint64" else INTEGERS[dtype][2]
    top = F.lit(str(hi)).cast("decimal(20,0)") if dtype == "uint64" else F.lit(hi)
    whole = F.when(v <= lo, F.lit(lo).cast(carrier)).when(v >= float(hi), top.cast(carrier)).otherwise(F.when(v < 0, F.ceil(v)).otherwise(F.floor(v)).cast(carrier))
    bad = F.isnan(v.cast("double")) | (F.abs(v.cast("double")) == float("inf"))
    return F.when(bad, F.raise_error(F.lit("a value is not finite")).cast(carrier)).otherwise(whole)


def unit_scale_cast(v: Column, low: Column, high: Column, dtype: str) -> Column:
    """Clip to low..high, scale to 0..1 and on to the type's maximum, ties to even; flat bounds give 0."""
    unit = F.coalesce(F.try_divide(F.greatest(F.least(v, high), low) - low, high - low), F.lit(0.0))
    if dtype in FLOATS:
        return unit.cast(FLOATS[dtype])
    return F.bround(unit * float(limits(dtype)[1]), 0).cast(INTEGERS[dtype][2])


def normalized(v: Column, low: Column, high: Column) -> Column:
    """Clip to low..high and scale to 0..1."""
    return (F.least(F.greatest(v, low), high) - low) / (high - low)


def crop_bounds(crop: tuple[float | int, float | int], size: int) -> tuple[int, int]:
    """Half-open bounds: a whole number crops so many voxels, a fraction that part of the size."""
    first, last = crop
    a = first if isinstance(first, int) else int(first * size)
    b = size - last if isinstance(last, int) else int((1 - last) * size)
    if a >= b:
        raise ValueError(f"the crop {crop} leaves nothing of {size}")
    return a, b


def exact_percentiles(df: DataFrame, column: str, percents: list[float], keep: int = 100_000) -> list[float]:
    """Linearly interpolated percentiles of all values, exact at any size.

    Each pass counts the values in bins between the bounds that are known for every open rank, and narrows them to the bins that hold the ranks, until
    few enough values (or a single one) lie there to be read. The driver gets the bins' counts and at most `keep` values for each rank. Nulls and NaN don't count;
    infinite values do, as the first and last ranks.
    """
    values = df.select(F.col(column).cast("double").alias("v")).where("v is not null and not isnan(v)")
    v, infinity = F.col("v"), F.lit(float("inf"))
    finite = F.when(F.abs(v) < infinity, v)
    n, inside, low, least, most = values.agg(F.count("v"), F.count(finite), F.count(F.when(v == -infinity, v)), F.min(finite), F.max(finite)).first()
    if not n:
        raise ValueError("no values")
    ranks = sorted({r for p in percents for x in [p / 100 * (n - 1)] for r in (math.floor(x), math.ceil(x))})
    found = {r: -math.inf if r < low else math.inf for r in ranks if r < low or r >= low + inside}
    bins = 4096
    todo = [(least, most, low, inside, [r for r in ranks if r not in found])]  # values from a to b, so many lie below, so many inside, wanted ranks
    while todo := [x for x in todo if x[4]]:
        for a, _, _, _, wanted in [x for x in todo if x[0] == x[1]]:
            found |= dict.fromkeys(wanted, a)
        todo = [x for x in todo if x[0] != x[1]]
        short, long = [x for x in todo if x[3] <= keep], [x for x in todo if x[3] > keep]
        if short:
            reduced = values.where(reduce(lambda p, q: p | q, [v.between(a, b) for a, b, *_ in short]))
            rows = [r[0] for r in reduced.sort("v").collect()]
            for a, _, below, _, wanted in short:
                first = bisect.bisect_left(rows, a)
                found |= {r: rows[first + r - below] for r in wanted}
        todo = []
        if long:
            place = bin_ = F.lit(None).cast("bigint")
            for k, (a, b, *_) in enumerate(long):
                width = b / bins - a / bins
                own = F.least(F.floor((v - a) / width), F.lit(bins - 1)) if width > 0 else F.when(v == a, 0).otherwise(1)
                place, bin_ = F.when(v.between(a, b), k).otherwise(place), F.when(v.between(a, b), own).otherwise(bin_)
            counts = values.groupBy(place.alias("k"), bin_.alias("b")).agg(F.count("v"), F.min("v"), F.max("v")).where("k is not null").collect()
            for k, (_, _, at, _, wanted) in enumerate(long):
                for _, _, count, lo, hi in sorted(r for r in counts if r[0] == k):
                    todo.append((lo, hi, at, count, [r for r in wanted if at <= r < at + count]))
                    at += count
    out = []
    for p in percents:
        x = p / 100 * (n - 1)
        lo, hi = found[math.floor(x)], found[math.ceil(x)]
        out.append(lo if lo == hi else lo + (hi - lo) * (x - math.floor(x)))
    return out


def even_steps(start: float, stop: float, step: float) -> list[float]:
    """From start to stop, both included, in as many even steps as fit."""
    n = int(abs(stop - start) / abs(step) + 1e-9)
    return [start + (stop - start) * k / n for k in range(n + 1)] if n else [start]
