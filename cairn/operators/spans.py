"""Which spans hold a place, for spans of any length: an equi-join on blocks whose sizes are powers of two."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.operators.steps import measured_joins

#: Fixed value: joins take only blocks whose sizes are 2 to a multiple of this. A place is asked for once at each size, so few sizes make few rows of places, and more rows of spans.
BITS = 4


def _shift(c: Column, level: Column) -> Column:
    return F.call_function("shiftright", c, level.cast("int"))


def blocks_of(start: Column, past: Column, bits: int = 1) -> Column:
    """The fewest blocks (level, block) that make up the places from start to before past, of sizes that are 2 to a multiple of bits: at most 2^(bits + 1) - 2 of each size, none for an empty span."""
    levels = F.sequence(F.lit(0), F.least(F.ceil(F.log2(F.greatest(past - start, F.lit(1)).cast("double"))).cast("int") + 1, F.lit(63 - bits)), F.lit(bits))

    def at(level: Column) -> Column:
        size = F.call_function("shiftleft", F.lit(1).cast("long"), level.cast("int"))
        first, end = _shift(start + size - 1, level), _shift(past, level)
        # those that make up whole blocks of the next size are left to it
        inner_first, inner_end = _shift(first + (1 << bits) - 1, F.lit(bits)) * (1 << bits), _shift(end, F.lit(bits)) * (1 << bits)
        run = lambda a, b: F.when(a < b, F.sequence(a, b - 1)).otherwise(F.array().cast("array<bigint>"))
        blocks = F.when(inner_first < inner_end, F.concat(run(first, inner_first), run(inner_end, end))).otherwise(run(first, end))
        return F.transform(blocks, lambda c: F.struct(level.cast("int").alias("level"), c.alias("block")))

    return F.when(past > start, F.flatten(F.transform(levels, at))).otherwise(F.array().cast("array<struct<level:int,block:bigint>>"))


def holding_spans(places: DataFrame, spans: DataFrame, place: str, start: str, past: str, by: list[str] | None = None) -> DataFrame:
    """Each place with each span from start to before past that holds it, within equal values of `by`.

    A span becomes a row for each of its blocks, a logarithm of its length;
    a place asks for the one block of each size that holds it, of the sizes
    that any span has, of which there are 16 at most. So a place and a span
    that holds it meet exactly once, and no span is spread over its places.
    Spans that end before they begin, and null ends, hold nothing.
    """
    measured_joins(places.sparkSession)
    by = by or []
    cut = spans.withColumn("_b", F.explode(blocks_of(F.col(start).cast("long"), F.col(past).cast("long"), BITS))).withColumns({"_level": F.col("_b.level"), "_block": F.col("_b.block")}).drop("_b")
    sizes = cut.select("_level").distinct()  # 16 rows at most
    asked = places.where(F.col(place).isNotNull()).crossJoin(F.broadcast(sizes)).withColumn("_block", _shift(F.col(place).cast("long"), F.col("_level")))
    return asked.join(cut, [*by, "_level", "_block"]).drop("_level", "_block")
