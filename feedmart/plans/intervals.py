"""Days against ranges of days as an equi-join: ranges are cut into dyadic runs of days, and a day lies in one run of each length."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Runs have 1, 2, 4, ... days up to 2^TOP, about 22 years; longer ranges have several of the longest.
TOP = 13
NODE = "struct<level:int,run:long>"


def _number(day: Column) -> Column:
    return F.datediff(day, F.to_date(F.lit("1970-01-01"))).cast("long")


def _node(level: int, run: Column) -> Column:
    return F.struct(F.lit(level).alias("level"), run.cast("long").alias("run"))


def runs_of_day(day: Column) -> Column:
    """The runs a day lies in, one of each length; no day lies in a run of its own."""
    n = _number(day)
    known = F.array(*[_node(k, F.shiftright(n, k)) for k in range(TOP + 1)])
    return F.when(day.isNull(), F.array(_node(-1, F.lit(0)))).otherwise(known)


def runs_of_range(first: Column, last: Column, earliest: Column, latest: Column) -> Column:
    """The fewest runs that make up the days from ``first`` to ``last``; a missing bound is that of the table, and without both also rows without a day are in it.

    At most two runs of each length, besides the longest: a range meets its
    days by a few dozen keys, however many days it has.
    """
    start, end = F.greatest(_number(F.coalesce(first, earliest)), _number(earliest)), F.least(_number(F.coalesce(last, latest)), _number(latest)) + 1
    parts = []
    for k in range(TOP):
        a, b = -F.shiftright(-start, k), F.shiftright(end, k)  # rounded up, rounded down
        odd = lambda x: x.bitwiseAND(F.lit(1).cast("long")) == 1
        parts.append(F.when((a < b) & odd(a), _node(k, a)))
        parts.append(F.when((a + F.when(odd(a), 1).otherwise(0) < b) & odd(b), _node(k, b - 1)))
    a, b = -F.shiftright(-start, TOP), F.shiftright(end, TOP)
    longest = F.when(a < b, F.transform(F.sequence(a, b - 1), lambda r: _node(TOP, r))).otherwise(F.array().cast(f"array<{NODE}>"))
    undated = F.when(first.isNull() & last.isNull(), F.array(_node(-1, F.lit(0)))).otherwise(F.array().cast(f"array<{NODE}>"))
    found = F.concat(F.array_compact(F.array(*parts)), longest)
    return F.concat(F.when(start.isNull() | end.isNull(), F.array().cast(f"array<{NODE}>")).otherwise(found), undated)
