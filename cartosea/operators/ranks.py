"""Exact quantiles of large columns without a sort of the whole column or all its values in one task.

Approximate percentiles bracket a rank; exact counts below and inside the bracket check it, and only what is inside goes
on, until it is few enough to be sorted.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartosea.operators.stages import discard, staged

#: Distinct values that the driver may sort, and the accuracy of the brackets.
FEW, ACCURACY = 100_000, 10_000


def _from_rank(values: DataFrame, rank: int, n: int) -> tuple[float, float]:
    """The values of a 0-based rank and of the next (the last has itself) among n values v."""
    low, then = 0, min(rank + 1, n - 1)
    while n > FEW:
        p, slack = (rank - low) / n, 3 / ACCURACY
        a, z = values.agg(F.percentile_approx("v", [max(0.0, p - slack), min(1.0, p + slack)], ACCURACY).alias("e")).first()["e"]
        under, upto = values.agg(F.count(F.when(F.col("v") < a, 1)), F.count(F.when(F.col("v") <= z, 1))).first()
        if not under <= rank - low <= then - low < upto:
            a, z, under, upto = *values.agg(F.min("v"), F.max("v")).first(), 0, n
        if a == z:
            return a, a
        values = values.where((F.col("v") >= a) & (F.col("v") <= z))
        low, before, n = low + under, n, upto - under
        if n == before:  # few distinct values, each very often
            break
    found = []
    for v, c in values.groupBy("v").count().orderBy("v").toLocalIterator():
        low += c
        found += [v] * ((not found and rank < low) + (then < low))
        if then < low:
            return found[0], found[-1]
    raise ValueError("no such rank")


def quantiles(cells: DataFrame, column: str, shares: list[float]) -> list[float | None]:
    """The exact quantiles of a column, between two values by their distance; nulls don't count, no values give None. The
    column is written once, so that narrowing ranks doesn't make it anew each time."""
    once = staged(cells.select(F.col(column).cast("double").alias("v")))
    values = once.where("v is not null")
    n, out, known = values.count(), [], {}
    for q in shares:
        place = q * (n - 1)
        if n and int(place) not in known:
            known[int(place)] = _from_rank(values, int(place), n)
        ends = known.get(int(place))
        out.append(ends[0] + (ends[1] - ends[0]) * (place - int(place)) if n else None)
    discard(once)
    return out
