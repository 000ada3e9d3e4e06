"""Running sums and maxima over arrays, as Column expressions whose work grows in proportion to the array."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Elements that one inner fold runs over; appending inside a fold copies what it has so far.
RUN = 128


def running(values: Column, combine: Callable[[Column, Column], Column], zero: int = 0) -> Column:
    """array<int>: element i is ``combine`` of ``zero`` and all elements up to i; null for null, empty for empty."""

    def fold(run: Column) -> Column:
        last = lambda a: F.get(a, F.size(a) - 1)
        return F.aggregate(run, F.array().cast("array<int>"), lambda a, v: F.concat(a, F.array(F.when(F.size(a) == 0, v).otherwise(combine(last(a), v)))))

    def joined(runs: Column) -> Column:
        last = lambda a: F.get(a, F.size(a) - 1)
        before = F.aggregate(runs, F.array(F.lit(zero)), lambda a, r: F.concat(a, F.array(combine(last(a), last(r)))))
        both = lambda b: F.zip_with(runs, F.slice(b, F.lit(1), F.size(runs)), lambda r, o: F.transform(r, lambda v: combine(o, v)))
        return F.flatten(F.get(F.transform(F.array(before), both), F.lit(0)))

    runs = F.transform(F.sequence(F.lit(0), F.floor((F.size(values) - 1) / RUN).cast("int")), lambda b: fold(F.slice(values, b * RUN + 1, F.lit(RUN))))
    return F.when(F.size(values) > 0, F.get(F.transform(F.array(runs), joined), F.lit(0))).otherwise(F.when(values.isNotNull(), F.array().cast("array<int>")))


def running_sum(values: Column) -> Column:
    return running(values, lambda a, b: a + b)


def running_max(values: Column) -> Column:
    return running(values, F.greatest)
