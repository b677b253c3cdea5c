"""Exact places and percentiles of a whole column, with no window or buffer over all of it."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelkit.session import written


def numbered(rows: DataFrame, value: str) -> DataFrame:
    """(q, i, n): every value that is there, its place in order from 1, and their number.

    Values are dealt by ranges and numbered within each; equal ones have different numbers, so that they need not be in one range.
    """
    found = written(rows.where(F.col(value).isNotNull()).select(F.col(value).cast("double").alias("q"), F.monotonically_increasing_id().alias("id")))
    dealt = written(found.repartitionByRange("q", "id").withColumn("part", F.spark_partition_id()))
    sizes = dealt.groupBy("part").agg(F.count("*").alias("size"))  # a row for each range
    before = F.coalesce(F.sum("size").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.withColumn("before", before).crossJoin(F.broadcast(sizes.agg(F.sum("size").alias("n")))).select("part", "before", "n")
    ranked = dealt.withColumn("i", F.row_number().over(Window.partitionBy("part").orderBy("q", "id"))).join(F.broadcast(starts), "part")
    return ranked.select("q", (F.col("i") + F.col("before")).alias("i"), "n")


#: A group of at most so many values is buffered whole; of a larger one never more than so many values for each share.
LIMIT = 100_000
#: Steps of the sketch that narrows a bracket: a pass over the rows leaves about 3 of GRID parts of it. The sketch's own error is under a fifth of a step.
GRID, ACCURACY = 200, 1000


def _linear(at: Callable[[Column], Column], n: Column, share: float) -> Column:
    """The percentile between the values at two places, which at() finds by their numbers from 0."""
    place = F.lit(float(share)) * (n - 1)
    low, high = F.floor(place), F.ceil(place)
    return at(low) + (at(high) - at(low)) * (place - low)


def _bracketed(rows: DataFrame, by: Sequence[str], brackets: DataFrame) -> DataFrame:
    return rows.join(brackets, list(by)) if by else rows.crossJoin(F.broadcast(brackets))


def _narrowed(rows: DataFrame, by: Sequence[str], shares: Sequence[float], sizes: DataFrame, limit: int) -> DataFrame:
    """(by..., found) for large groups: brackets around the wanted places are narrowed by counts until few values are inside.

    `low` and `high` are values of the group; places are counted exactly in every pass, so that the sketch decides how quick it goes and never
    what comes out. Equal values at the ends are counted, not kept.
    """
    each = range(len(shares))
    state = sizes.select(*by, "n", *[F.col("least").alias(f"low{i}") for i in each], *[F.col("most").alias(f"high{i}") for i in each])
    while True:
        joined = _bracketed(rows, by, state)
        inside = [F.when((F.col("x") > F.col(f"low{i}")) & (F.col("x") < F.col(f"high{i}")), F.col("x")) for i in each]
        counted = joined.groupBy(*by, "n", *[f"{end}{i}" for end in ("low", "high") for i in each]).agg(
            *[F.count_if(F.col("x") < F.col(f"low{i}")).alias(f"below{i}") for i in each], *[F.count_if(F.col("x") == F.col(f"low{i}")).alias(f"equal{i}") for i in each],
            *[F.count(inside[i]).alias(f"inside{i}") for i in each], *[F.percentile_approx(inside[i], [k / GRID for k in range(GRID + 1)], ACCURACY).alias(f"grid{i}") for i in each],
        )
        counted = written(counted)
        if (counted.agg(F.max(F.greatest(*[F.col(f"inside{i}") for i in each], F.lit(0)))).first()[0] or 0) <= limit:
            break
        ends = {}
        for i, share in enumerate(shares):
            first, last = (f(F.lit(float(share)) * (F.col("n") - 1)) - F.col(f"below{i}") - F.col(f"equal{i}") for f in (F.floor, F.ceil))  # numbers among those inside
            step = F.col(f"inside{i}") / GRID
            grid = lambda k: F.get(F.col(f"grid{i}"), k.cast("int"))  # noqa: B023, E731
            few = F.col(f"inside{i}") <= limit
            ends[f"low{i}"] = F.when(few | (first / step < 2), F.col(f"low{i}")).when(first >= F.col(f"inside{i}"), F.col(f"high{i}")).otherwise(grid(F.floor(first / step) - 1))
            ends[f"high{i}"] = F.when(last < 0, F.col(f"low{i}")).when(few | (last / step > GRID - 2), F.col(f"high{i}")).otherwise(grid(F.ceil(last / step) + 1))
        state = written(counted.select(*by, "n", *[x.alias(c) for c, x in ends.items()]))
    lists = [F.array_sort(F.collect_list(inside[i])).alias(f"list{i}") for i in each]
    held = joined.groupBy(*by, "n", *[f"{end}{i}" for end in ("low", "high") for i in each]).agg(*lists)
    both = held.join(counted.select(*by, *[f"{c}{i}" for c in ("below", "equal") for i in each]), list(by)) if by else held.crossJoin(counted.select(*[f"{c}{i}" for c in ("below", "equal") for i in each]))

    def at(i: int) -> Callable[[Column], Column]:
        def value(place: Column) -> Column:
            own = place - F.col(f"below{i}") - F.col(f"equal{i}")
            return F.when(own < 0, F.col(f"low{i}")).when(own < F.size(f"list{i}"), F.get(F.col(f"list{i}"), own.cast("int"))).otherwise(F.col(f"high{i}"))

        return value

    return both.select(*by, F.array(*[_linear(at(i), F.col("n"), s) for i, s in enumerate(shares)]).alias("found"))


def percentiles(rows: DataFrame, value: str, shares: Sequence[float], name: str = "found", by: Sequence[str] = (), limit: int | None = None) -> DataFrame:
    """(by..., name): an array of the exact percentiles of each group, linear between neighbours; null where a group has no value. One row without `by`.

    Groups are counted first. Those of at most `limit` values (LIMIT) are buffered; a larger one, however large, takes some passes over its rows
    and then no more than `limit` values for each share.
    """
    limit = LIMIT if limit is None else limit
    x = F.col(value).cast("double")
    plain = rows.select(*by, x.alias("x"))
    n = F.count("x")
    buffered = F.percentile("x", [float(s) for s in shares]).alias(name)
    if (plain.groupBy(*by).agg(n.alias("n")).agg(F.max("n")).first()[0] or 0) <= limit:
        return plain.groupBy(*by).agg(buffered)
    sizes = written(plain.groupBy(*by).agg(n.alias("n"), F.min("x").alias("least"), F.max("x").alias("most")))
    large = sizes.where(F.col("n") > limit)
    found = _narrowed(plain.where(F.col("x").isNotNull()), by, shares, large, limit).withColumnRenamed("found", name)
    if not by:
        return found
    small = plain.join(large.select(*by), list(by), "left_anti").groupBy(*by).agg(buffered)
    return small.unionByName(found)
