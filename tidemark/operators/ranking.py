"""Rules with reasons, choice of candidates, trims and ordered unions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.sources.tables import staged


def reasons(*rules: tuple[Column, str]) -> Column:
    """Names of the rules that hold, in the order given."""
    return F.filter(F.array(*(F.when(c, F.lit(name)) for c, name in rules)), lambda x: x.isNotNull())


def first_rule(default: str, *rules: tuple[Column, str]) -> Column:
    """Name of the first rule that holds."""
    out = F.lit(default)
    for c, name in reversed(rules):
        out = F.when(c, F.lit(name)).otherwise(out)
    return out


def categories(text: Column, rules: list[tuple[str, tuple[str, ...]]]) -> Column:
    """Categories, in order, any of whose substrings the text holds."""
    hit = lambda parts: F.greatest(*(F.instr(text, p) for p in parts), F.lit(0)) > 0
    return reasons(*((hit(parts), name) for name, parts in rules))


def near_best_earliest(rows: DataFrame, by: list[str], score: str, t: str, key: str, ratio: float) -> DataFrame:
    """The earliest row of each group whose score is at least `ratio` of the group's best."""
    near = rows.withColumn("_best", F.max(score).over(W.partitionBy(*by))).where(F.col(score) >= F.col("_best") * ratio)
    return near.withColumn("_k", F.row_number().over(W.partitionBy(*by).orderBy(t, key))).where("_k = 1").drop("_k", "_best")


def coverage_trim(rows: DataFrame, by: list[str], score: str, t: str, key: str, most: int) -> DataFrame:
    """At most `most` rows of a group: 65 % by score, the rest spread evenly over the others in time."""
    n_top = int(most * 0.65)
    n_rest = most - n_top
    ranked = rows.withColumn("_k", F.row_number().over(W.partitionBy(*by).orderBy(F.desc(score), key)))
    rest = ranked.where(F.col("_k") > n_top).withColumn("_i", F.row_number().over(W.partitionBy(*by).orderBy(t, key)) - 1).withColumn("_n", F.count(F.lit(1)).over(W.partitionBy(*by)))
    # evenly: where floor(i * n_rest / n) steps up
    place = lambda i: F.floor(i * n_rest / F.col("_n"))
    step = (F.col("_n") <= n_rest) | (place(F.col("_i")) != place(F.col("_i") - 1))
    top = ranked.where(F.col("_k") <= n_top).select(*rows.columns, F.lit("top").alias("part"))
    return top.unionByName(rest.where(step).select(*rows.columns, F.lit("spread").alias("part")))


def first_seen(rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """One row of each key: the first in order."""
    return rows.withColumn("_k", F.row_number().over(W.partitionBy(*key).orderBy(*order))).where("_k = 1").drop("_k")


def relative_pass(rows: DataFrame, by: list[str], absolute: Column, value: str, share: float) -> DataFrame:
    """passed: the absolute rule; in groups without such a row, at least `share` of the group's largest value."""
    part = W.partitionBy(*by)
    marked = rows.withColumn("_a", absolute)
    some = F.max(F.col("_a").cast("int")).over(part) == 1
    return marked.withColumn("passed", F.when(some, F.col("_a")).otherwise(F.col(value) >= share * F.max(value).over(part))).drop("_a")


def wide_array_union(*arrays: Column) -> Column:
    """Distinct items in the order of their first place."""
    out = arrays[0]
    for a in arrays[1:]:
        out = F.array_union(out, a)
    return F.array_distinct(out)


#: Places in a partition are the low bits of monotonically_increasing_id.
PLACE_BITS = 33


def places(rows: DataFrame, order: list[Column], name: str = "place") -> DataFrame:
    """The rows with their place, from 1, in the order, without sorting them in one task.

    The rows are dealt by ranges of the order, whose bounds Spark samples, and sorted within; a place is a row's own in its partition plus the counts of the partitions
    before. Any order will do, and ranges are as even as the order's columns tell rows apart. The ranged rows are written once, so that counts and places are of the same ranges.
    """
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    ranged = staged(ranged, "places")
    part = F.shiftrightunsigned("_at", PLACE_BITS)
    sizes = {r.part: r["count"] for r in ranged.groupBy(part.alias("part")).count().collect()}  # as many as there are partitions
    before, total = [], 0
    for k in range(max(sizes, default=0) + 1):
        before.append(total)
        total += sizes.get(k, 0)
    place = F.element_at(F.lit(before).cast("array<bigint>"), part.cast("int") + 1) + F.col("_at").bitwiseAND(F.lit((1 << PLACE_BITS) - 1)) + 1
    return ranged.select(*rows.columns, place.alias(name))
