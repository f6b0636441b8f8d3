"""Points and the spans that hold them, by equi-joins on blocks and dyadic pieces of blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brindle.staging import staged


def pieces(start: Column, end: Column) -> Column:
    """array<struct<level, piece>>: [start, end) as the fewest whole intervals of 2 ** level places, two of a level at most.

    start and end are from 0 to 2 ** 62; an empty span has no pieces.
    """
    kind = "struct<a:bigint,b:bigint,out:array<struct<level:int,piece:bigint>>>"
    begin = F.struct(start.cast("bigint").alias("a"), end.cast("bigint").alias("b"), F.array().alias("out")).cast(kind)
    piece = lambda k, x: F.array(F.struct(k.cast("int").alias("level"), x.alias("piece")))
    none = F.array().cast("array<struct<level:int,piece:bigint>>")

    def step(acc: Column, k: Column) -> Column:
        a, b = acc["a"], acc["b"]
        open_ = a < b
        odd_a, odd_b = open_ & (a % 2 == 1), open_ & (b % 2 == 1)
        a2, b2 = F.when(odd_a, a + 1).otherwise(a), F.when(odd_b, b - 1).otherwise(b)
        # a span of one odd place is taken at its start; its end is then met already
        out = F.concat(acc["out"], F.when(odd_a, piece(k, a)).otherwise(none), F.when(odd_b & (a2 <= b2), piece(k, b - 1)).otherwise(none))
        return F.struct(F.floor(a2 / 2).cast("bigint").alias("a"), F.floor(b2 / 2).cast("bigint").alias("b"), out.alias("out")).cast(kind)

    levels = F.sequence(F.lit(0), F.greatest(F.floor(F.log2(F.greatest(end, F.lit(1)).cast("double"))).cast("int") + 1, F.lit(0)))
    return F.aggregate(levels, begin, step, lambda acc: acc["out"])


def enclosing(points: DataFrame, spans: DataFrame, by: list[str], at: str, start: str = "start", end: str = "end") -> DataFrame:
    """points with the columns of the innermost of spans, of the same `by` values, that holds `at` (start <= at < end); null
    where none does. points and spans share no column but `by`. Spans may nest or overlap: the innermost is the one
    that starts last, then the one that ends first.

    Places are cut into blocks of a power of two, twice the median length of a span or up to four times that. A span asks in the one or two
    blocks where it begins and ends, and in the dyadic pieces, some 2 log n, of the n blocks between them; a point in its own block, and for
    each size of piece that the longest span can have. Where spans are short that is a row for a point and less than two for
    a span. Both meet in an equi-join: a joined row is a span that holds the point or one that ends in its block, of which, as half of the spans
    are at least a quarter of a block long, there are a few times as many at most. Hot blocks are split by the join. Then a grouped minimum finds the innermost.
    """
    rest = [c for c in spans.columns if c not in by]
    split = staged(spans.where(f"`{start}` < `{end}`"), "spans")
    length = (F.col(end) - F.col(start)).cast("bigint")
    middle, longest = split.agg(F.percentile_approx(length, 0.5), F.max(length)).first()
    if middle is None:
        return points.select(*points.columns, *[F.lit(None).cast(spans.schema[c].dataType).alias(c) for c in rest])
    bits = (2 * middle - 1).bit_length()
    block = lambda c: F.call_function("shiftright", c.cast("bigint"), F.lit(bits))
    top = (longest >> bits).bit_length() - 1  # size of the largest piece of whole blocks, 62 at most; -1 without any
    first, last = block(F.col(start)), block(F.col(end) - 1)
    kind = "array<struct<level:int,piece:bigint>>"
    parts = F.transform(F.array_distinct(F.array(first, last)), lambda b: F.struct(F.lit(-1).alias("level"), b.alias("piece"))).cast(kind)
    if top >= 0:
        parts = F.concat(parts, F.when(last > first + 1, pieces(first + 1, last)).otherwise(F.array().cast(kind)))
    split = split.withColumn("_p", F.explode(parts)).select(*by, *rest, F.col("_p.level").alias("_level"), F.col("_p.piece").alias("_piece"))
    asked = points.select(*by, at).distinct().where(F.col(at).isNotNull())
    # with one level, what meets in the join is grouped where it lies
    asked = asked.withColumn("_level", F.explode(F.sequence(F.lit(-1), F.lit(top)))) if top >= 0 else asked.withColumn("_level", F.lit(-1))
    asked = asked.withColumn("_piece", F.call_function("shiftright", block(F.col(at)), F.greatest("_level", F.lit(0))))
    # sorted and merged: the optimizer counts none of the rows that are exploded here, and would send a small table's to all
    holds = (F.col(at) >= F.col(start)) & (F.col(at) < F.col(end))
    met = asked.hint("merge").join(split, [*by, "_level", "_piece"]).where(holds)
    inner = F.struct((-F.col(start)).alias("s"), F.col(end).alias("e"))
    held = met.groupBy(*by, at, *(["_level", "_piece"] if top < 0 else [])).agg(F.min_by(F.struct(*rest), inner).alias("_b"))
    return points.join(held, [*by, at], "left").select(*points.columns, *[F.col(f"_b.{c}").alias(c) for c in rest])
