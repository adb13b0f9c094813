"""Places of pattern matches in texts, with DataFrame functions only.

Spark's pattern functions return matched texts, not places. A match is therefore put between marks, the text
is split at the marks, and the lengths of the parts before it give its place. U+0001 is the mark; one that a text
holds already counts as U+0002, which no pattern of this package matches.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

MARK = "\u0001"


def unmarked(text: Column) -> Column:
    return F.translate(F.coalesce(text, F.lit("")), MARK, "\u0002")


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with the value computed once, however often `use` refers to it."""
    return F.get(F.transform(F.array(value), use), 0)


def parts(text: Column, pattern: str) -> Column:
    """Parts of an unmarked text; those at odd places (from 0) are the matches, in order."""
    return F.split(F.regexp_replace(text, f"({pattern})", f"{MARK}$1{MARK}"), MARK, -1)


def located(pieces: Column) -> Column:
    """array<struct<start, end, value>> of the matches among `parts`; code points, end exclusive."""
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int,value:string>>").alias("found"))

    def step(state: Column, k: Column) -> Column:
        gap, hit = F.get(pieces, k), F.get(pieces, k + 1)
        begin = state["at"] + F.length(gap)
        end = begin + F.length(hit)
        one = F.struct(begin.alias("start"), end.alias("end"), hit.alias("value"))
        return F.struct(end.alias("at"), F.concat(state["found"], F.array(one)).alias("found"))

    steps = F.when(F.size(pieces) > 1, F.sequence(F.lit(0), F.size(pieces) - 3, F.lit(2))).otherwise(F.array().cast("array<int>"))
    return F.aggregate(steps, start, step, lambda state: state["found"])
