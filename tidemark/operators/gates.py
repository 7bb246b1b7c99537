"""Search of acceptance gates: thresholds on several axes at once, the most accepted rows under bounds on their errors."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.sources.tables import staged


@dataclass(frozen=True)
class Axis:
    """A column and its thresholds from the strictest to the loosest; rows pass with at least (or at most) a threshold."""

    column: str
    steps: tuple[float, ...]
    at_least: bool = True

    def level(self) -> Column:
        """Place of the strictest threshold that the row passes; as many as there are thresholds if none (null and NaN pass none)."""
        x = F.col(self.column)
        fails = [(x < s) if self.at_least else (x > s) for s in self.steps]
        failed = reduce(Column.__add__, (f.cast("int") for f in fails))
        return F.when(x.isNull() | F.isnan(x.cast("double")), len(self.steps)).otherwise(failed)


@dataclass(frozen=True)
class Goal:
    """Errors above `limit` are false; at most `most_false` percent of the accepted may be, and none above `never`; at least `least` are accepted.

    Ties in the number of accepted rows go to the smaller largest error (`by_mean`: mean error), then to stricter thresholds, the first axis first. A
    largest error of 0 says that errors weren't measured, and comes last in ties.
    """

    name: str
    limit: float
    most_false: float = 0.0
    least: int = 1
    most_error: float | None = None
    never: float | None = None
    by_mean: bool = False


def gate_cells(rows: DataFrame, axes: list[Axis], error: str, limits: list[float]) -> DataFrame:
    """Counts by level on every axis: l0 …, n, over0 … (errors above each limit), most, total (of errors, to six decimals); null levels: rows that fail on some axis."""
    names = [f"l{k}" for k in range(len(axes))]
    found = rows.select(*(a.level().alias(n) for n, a in zip(names, axes, strict=True)), F.col(error).cast("double").alias("error"))
    passing = reduce(Column.__and__, (F.col(n) < len(a.steps) for n, a in zip(names, axes, strict=True)))
    over = [F.count_if(F.col("error") > x).alias(f"over{i}") for i, x in enumerate(limits)]
    return found.groupBy(*(F.when(passing, F.col(n)).alias(n) for n in names)).agg(F.count("*").alias("n"), *over, F.max("error").alias("most"), F.sum(F.col("error").cast("decimal(18,6)")).alias("total"))


def dominated(cells: DataFrame, axes: list[Axis], n_limits: int) -> DataFrame:
    """The same measures over all cells that are at most as loose on every axis.

    One axis after the other: what a cell holds is added to all looser levels of the axis that rows have, so a grid of k axes takes k partial
    aggregations and no cell is compared with another. Levels that no row has give what the next stricter one gives, and need no cell. The grid is
    bounded by the axes' thresholds, whatever the rows.
    """
    names = [f"l{k}" for k in range(len(axes))]
    had = cells.agg(*(F.array_sort(F.collect_set(n)).alias(n) for n in names)).first()
    sums = ["n", *(f"over{i}" for i in range(n_limits)), "total"]
    for name in sorted(names, key=lambda n: len(had[n])):
        own, levels = F.col(name), F.lit(had[name]) if had[name] else F.array().cast("array<int>")
        looser = F.explode(F.filter(levels, lambda x: x >= own))  # noqa: B023
        spread = cells.select(*(looser.alias(n) if n == name else n for n in names), *sums, "most")
        cells = spread.groupBy(*names).agg(*(F.sum(s).alias(s) for s in sums), F.max("most").alias("most"))
    return cells


def gate_search(rows: DataFrame, axes: list[Axis], goals: list[Goal], error: str) -> DataFrame:
    """The best gate for each goal: goal, accepted, coverage (percent of all rows), n_false, false_rate (percent), max_error, mean_error, and each axis' threshold.

    Without a gate that meets a goal nothing is accepted, at the strictest thresholds.
    """
    limits = sorted({g.limit for g in goals} | {g.never for g in goals if g.never is not None})
    # the rows are read once: all that follows rests on their cells, no more than the grid has
    found = staged(gate_cells(rows, axes, error, limits), "gate-cells")
    n_all = found.agg(F.sum("n")).first()[0] or 0
    cells = dominated(found.where("l0 is not null"), axes, len(limits))
    places = 1
    at = F.lit(0).cast("long")
    for k, a in reversed(list(enumerate(axes))):
        at = at + F.col(f"l{k}") * places
        places *= len(a.steps)
    choices = []
    for i, g in enumerate(goals):
        false = F.col(f"over{limits.index(g.limit)}")
        mean = F.col("total").cast("double") / F.col("n")
        good = (F.col("n") >= g.least) & (100.0 * false / F.col("n") <= g.most_false)
        if g.most_error is not None:
            good &= F.col("most") <= g.most_error
        if g.never is not None:
            good &= F.col(f"over{limits.index(g.never)}") == 0
        tie = mean if g.by_mean else F.when(F.col("most") == 0, float("inf")).otherwise(F.col("most"))
        ends = F.struct((-F.col("n")).alias("n"), F.coalesce(tie, F.lit(float("inf"))).alias("tie"), at.alias("at"), false.alias("false"), F.col("most").alias("most"), mean.alias("mean"), *(f"l{k}" for k in range(len(axes))))
        choices.append(F.min(F.when(good, ends)).alias(f"g{i}"))
    named = F.array(*(F.struct(F.lit(g.name).alias("goal"), F.col(f"g{i}").alias("g")) for i, g in enumerate(goals)))
    one = cells.agg(*choices).select(F.inline(named))
    step = lambda k, a: F.element_at(F.lit([float(s) for s in a.steps]), F.coalesce(F.col(f"g.l{k}"), F.lit(0)) + 1).alias(a.column)
    n = F.coalesce(-F.col("g.n"), F.lit(0))
    return one.select(
        "goal",
        n.alias("accepted"),
        (F.lit(100.0) * n / max(n_all, 1)).alias("coverage"),
        F.coalesce("g.false", F.lit(0)).alias("n_false"),
        (F.lit(100.0) * F.col("g.false") / n).alias("false_rate"),
        F.col("g.most").alias("max_error"),
        F.col("g.mean").alias("mean_error"),
        *(step(k, a) for k, a in enumerate(axes)),
    )
