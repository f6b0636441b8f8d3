"""Running sums and the like over arrays, as column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def running(values: Column, both: Callable[[Column, Column], Column], kind: str = "int") -> Column:
    """An array of `kind`: each value with all before it, `both` being a sum or a maximum.

    An array that grows by one is copied whole, so the fold runs over blocks of the root of their number, and over the
    blocks: n values take n times that root of cheap copies, 100,000 less than a second.
    """
    none = F.array().cast(f"array<{kind}>")
    last = lambda x: F.get(x, F.size(x) - 1)
    fold = lambda x: F.aggregate(x, none, lambda acc, v: F.array_append(acc, F.when(F.size(acc) == 0, v).otherwise(both(last(acc), v))))

    def blocks(own: Column) -> Column:
        n = F.size(own["v"])
        return F.transform(F.sequence(F.lit(0), ((n - 1) / own["b"]).cast("int")), lambda j: fold(F.slice(own["v"], j * own["b"] + 1, own["b"])))

    def lifted(own: Column) -> Column:
        return F.flatten(F.transform(own["parts"], lambda x, j: F.when(j == 0, x).otherwise(F.transform(x, lambda v: both(F.get(own["sums"], j - 1), v)))))

    # arrays of one element bind what is used more than once to a name
    cut = F.transform(F.array(F.struct(values.alias("v"), F.ceil(F.sqrt(F.size(values))).cast("int").alias("b"))), blocks)[0]
    sized = F.transform(F.array(cut), lambda parts: F.struct(parts.alias("parts"), fold(F.transform(parts, last)).alias("sums")))
    return F.when(F.size(values) == 0, none).otherwise(F.transform(sized, lifted)[0])
