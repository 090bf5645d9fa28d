"""Column functions over long arrays and texts whose time grows with the length alone.

Adding to an array inside an aggregate copies it each time, and a substring of UTF-8 counts its
way from the start of the text. These helpers do both in pieces of a fixed size.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F

#: Elements that are added up one by one, and characters of a block, as powers of two.
CHUNK_BITS, BLOCK_BITS = 8, 10
LEVELS = 2


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is made once a row, however often the body names it."""
    return F.transform(F.array(value), body)[0]


def running(values: Column, add: Callable[[Column, Column], Column]) -> Column:
    """For each element of an array of integers, 0 combined with all elements before it.

    ``add`` is associative, and 0 changes nothing (a sum, or a maximum of what isn't negative).
    Chunks of 256 are combined by themselves, then their totals. Null stays null.
    """
    zero, most = F.lit(0), F.lit(1 << CHUNK_BITS)

    def one_by_one(own: Column, base: Column) -> Column:
        return F.aggregate(
            own,
            F.struct(base.alias("at"), F.array().cast("array<int>").alias("out")),
            lambda acc, x: F.struct(add(acc["at"], x).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out")),
            lambda acc: acc["out"],
        )

    def of(level: int) -> Callable[[Column], Column]:
        if level == 0:
            return lambda own: one_by_one(own, zero)

        def chunked(chunks: Column) -> Column:
            totals = F.transform(chunks, lambda own: F.aggregate(own, zero, add))
            return F.flatten(F.zip_with(chunks, let(totals, of(level - 1)), one_by_one))

        def body(own: Column) -> Column:
            at = F.sequence(zero, F.shiftright(F.size(own) - 1, CHUNK_BITS))
            chunks = F.transform(at, lambda c: F.slice(own, F.shiftleft(c, CHUNK_BITS) + 1, most))
            return F.when(F.size(own) <= most, one_by_one(own, zero)).otherwise(let(chunks, chunked))

        return body

    # copied once, so that slices of it don't copy all of it each time
    return let(F.transform(values, lambda x: x), of(LEVELS - 1))


def running_sum(values: Column) -> Column:
    return running(values, lambda a, b: a + b)


def running_max(values: Column) -> Column:
    return running(values, lambda a, b: F.greatest(a, b))


def blocks(text: Column) -> Column:
    """The text as pieces of 1,024 characters, for ``cut``; best bound by ``let``."""
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{1 << BLOCK_BITS}}}"), F.lit(0))


def cut(pieces: Column, start: Column, end: Column) -> Column:
    """Characters ``start`` (from 0) up to ``end`` of a text in ``blocks``; what lies outside is left out."""
    size = 1 << BLOCK_BITS

    def piece(j: Column) -> Column:
        first = F.greatest(start - j * size, F.lit(0))
        return F.substring(F.get(pieces, j), first + 1, F.least(end - j * size, F.lit(size)) - first)

    touched = F.sequence(F.shiftright(start, BLOCK_BITS), F.shiftright(end - 1, BLOCK_BITS))
    return F.when(start < end, F.array_join(F.transform(touched, piece), "")).otherwise(F.lit(""))
