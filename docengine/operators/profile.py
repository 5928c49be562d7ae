"""Numeric column profile: count, mean, std, min, quartiles, max."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from docengine.session import materialise

QUARTILES = {"p25": 0.25, "p50": 0.50, "p75": 0.75}
# A sketch finds an interval around a rank that holds about this share of the values; an
# interval with more values than can be sorted at once is narrowed by another sketch.
WIDTH = 0.004
SORTED_AT_ONCE = 1 << 20


def profile(table: DataFrame, columns: list[str], derived: bool = False) -> DataFrame:
    """One row per numeric column, with exact interpolated quartiles.

    Nulls and NaN are left out, as are columns without any value. Whole numbers are
    summed as decimals; other types are taken as doubles.

    Quartiles are found by selection: a sketch gives an interval of values around each
    rank, the next scan counts what lies below it and inside, and only the inside is
    sorted. What a sketch gives is checked by the counts, so the result does not rest on
    its accuracy. The table is scanned two or three times; a ``derived`` one, which would be
    computed each time, is first reduced to its numbers and written.
    """
    numbers = table.select(*columns)
    if derived:
        numbers = materialise(numbers, "numbers")
    described = [_Column(numbers, name) for name in columns]
    first = numbers.agg(*[each for column in described for each in column.totals()]).first()
    described = [column for column in described if column.take_totals(first)]
    while waiting := [column for column in described if column.is_open()]:
        counted = numbers.agg(*[each for c in waiting for each in c.counts()]).first()
        narrowed = [c for c in waiting if c.take_counts(counted)]
        if narrowed:
            sketches = numbers.agg(*[each for c in narrowed for each in c.sketches()]).first()
            for column in narrowed:
                column.take_sketches(sketches)
    if not described:
        return numbers.sparkSession.createDataFrame(
            [], "column_name string, count long, mean double, std double, min double, "
            + ", ".join(f"{q} double" for q in QUARTILES) + ", max double",
        )
    return reduce(DataFrame.unionByName, [column.row() for column in described])


class _Column:
    """The profile of one column as it becomes known; the driver holds a few numbers."""

    def __init__(self, numbers: DataFrame, name: str):
        self.numbers, self.name = numbers, name
        self.whole = isinstance(numbers.schema[name].dataType, IntegralType)
        value = F.col(f"`{name}`").cast("bigint" if self.whole else "double")
        self.value = value if self.whole else F.when(~F.isnan(value), value)

    def _named(self, column: Column, what: str) -> Column:
        return column.alias(f"{self.name}|{what}")

    def _shares(self) -> Column:
        ends = [min(1.0, max(0.0, q + side * WIDTH / 2)) for q in QUARTILES.values() for side in (-1, 1)]
        return F.array(*[F.lit(end) for end in ends])

    def totals(self) -> list[Column]:
        exact = self.value.cast("decimal(38,0)") if self.whole else self.value
        return [
            self._named(F.count(self.value), "count"),
            self._named(F.sum(exact).cast("double"), "sum"),
            self._named(F.min(self.value), "min"),
            self._named(F.max(self.value), "max"),
            self._named(F.percentile_approx(self.value, self._shares(), 2000), "ends"),
        ]

    def take_totals(self, found) -> bool:
        """Whether the column has any value."""
        self.count, self.sum, self.min, self.max, ends = (
            found[f"{self.name}|{what}"] for what in ("count", "sum", "min", "max", "ends")
        )
        if self.count:
            self.mean = self.sum / self.count
            pairs = zip(ends[::2], ends[1::2])
            # Per quartile: position, interval, then rows below it and inside.
            self.parts = [
                {"at": (self.count - 1) * share, "ends": pair, "below": None} for share, pair in zip(QUARTILES.values(), pairs)
            ]
            self.deviation = None
        return bool(self.count)

    def is_open(self) -> bool:
        return any(part["below"] is None for part in self.parts)

    def _inside(self, part: dict) -> Column:
        low, high = part["ends"]
        return (self.value >= F.lit(low)) & (self.value <= F.lit(high))

    def counts(self) -> list[Column]:
        away = self.value.cast("double") - F.lit(float(self.mean))
        wanted = [self._named(F.sum(away * away), "away")]
        for i, part in enumerate(self.parts):
            wanted.append(self._named(F.count_if(self.value < F.lit(part["ends"][0])), f"below{i}"))
            wanted.append(self._named(F.count_if(self._inside(part)), f"inside{i}"))
            wanted.append(self._named(F.approx_count_distinct(F.when(self._inside(part), self.value)), f"distinct{i}"))
        return wanted

    def take_counts(self, found) -> bool:
        """Settle the intervals that hold both ranks of their quartile; whether others are
        left that need a narrower or a wider one."""
        self.deviation = found[f"{self.name}|away"]
        again = False
        for i, part in enumerate(self.parts):
            below, inside, distinct = (found[f"{self.name}|{what}{i}"] for what in ("below", "inside", "distinct"))
            low, high = int(part["at"]), -int(-part["at"] // 1)
            if low < below or high >= below + inside:
                # The sketch missed: everything on that side is taken in.
                part["ends"] = (self.min if low < below else part["ends"][0], self.max if high >= below + inside else part["ends"][1])
                part["missed"] = True
                again = True
            elif distinct > SORTED_AT_ONCE and not part.get("missed"):
                part["narrow"] = (below, inside)
                again = True
            else:
                part["below"] = below
        return again

    def sketches(self) -> list[Column]:
        """Narrower intervals within those that have too many values."""
        wanted = []
        for i, part in enumerate(self.parts):
            if "narrow" in part:
                below, inside = part["narrow"]
                share = (part["at"] - below) / inside
                ends = [min(1.0, max(0.0, share + side * WIDTH / 2)) for side in (-1, 1)]
                within = F.when(self._inside(part), self.value)
                wanted.append(
                    self._named(F.percentile_approx(within, F.array(*[F.lit(e) for e in ends]), 2000), f"ends{i}")
                )
        return wanted or [self._named(F.lit(None), "none")]

    def take_sketches(self, found) -> None:
        for i, part in enumerate(self.parts):
            if part.pop("narrow", None):
                before, part["ends"] = part["ends"], tuple(found[f"{self.name}|ends{i}"])
                # An interval that a sketch can't narrow is taken as it is.
                part["missed"] = tuple(before) == part["ends"]

    def row(self) -> DataFrame:
        """The finished row: the values inside the intervals, counted and put in order."""
        quartile = F.explode(
            F.filter(
                F.array(*[F.when(self._inside(part), F.lit(i)) for i, part in enumerate(self.parts)]),
                lambda i: i.isNotNull(),
            )
        )
        inside = (
            self.numbers.select(quartile.alias("i"), self.value.alias("value"))
            .groupBy("i", "value")
            .agg(F.count(F.lit(1)).alias("n"))
        )
        before = Window.partitionBy("i").orderBy("value").rowsBetween(Window.unboundedPreceding, -1)
        placed = inside.withColumn("first", F.coalesce(F.sum("n").over(before), F.lit(0)))

        def at(i: int, rank: int) -> Column:
            rank -= self.parts[i]["below"]
            here = (F.col("i") == i) & (F.col("first") <= rank) & (F.col("first") + F.col("n") > rank)
            return F.max(F.when(here, F.col("value").cast("double")))

        made = []
        for i, (name, part) in enumerate(zip(QUARTILES, self.parts)):
            low = int(part["at"])
            fraction = part["at"] - low
            a, b = at(i, low), at(i, low + (fraction > 0))
            made.append(F.when(a == b, a).otherwise(a + (b - a) * fraction).alias(name))
        spread = self.deviation if self.deviation is not None else 0.0
        std = (spread / (self.count - 1)) ** 0.5 if self.count > 1 else None
        return placed.agg(*made).select(
            F.lit(self.name).alias("column_name"),
            F.lit(self.count).cast("long").alias("count"),
            F.lit(float(self.mean)).alias("mean"),
            F.lit(std).cast("double").alias("std"),
            F.lit(float(self.min)).alias("min"),
            *QUARTILES,
            F.lit(float(self.max)).alias("max"),
        )
