"""Entity windows where one entity may have very many rows: the rows are dealt by ranges, so that no task has a whole entity.

An entity that lies in more than one range gets what its windows need from the other ranges: halo rows (the last or next few rows)
or summaries (rows so far, the last value before, the next value after). Two entities of each range at most are cut, so that
summaries are a few rows for each range, whatever the input. Results equal those of the plain windows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelkit.operators import audit, features
from panelkit.operators.clean import filled_lines
from panelkit.session import written

PART, HALO = "__part", "__halo"


def _same(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> Column:
    out = F.lit(True)
    for k in keys:
        out = out & a[k].eqNullSafe(b[f"__{k}"])
    return out


def dealt(rows: DataFrame, by: Sequence[str], order: Sequence[str], parts: int | None = None) -> DataFrame:
    """rows with the number of their range, PART; ranges are of the keys and the order together. Equal places are in one range."""
    ranged = rows.repartitionByRange(parts, *by, *order) if parts else rows.repartitionByRange(*by, *order)
    return written(ranged.withColumn(PART, F.spark_partition_id()))


def spans(rows: DataFrame, by: Sequence[str], seen: Column | None = None) -> DataFrame:
    """(__key..., PART, n, start, and with `seen` before, after) of the entities that are in more than one range.

    start counts the entity's rows in earlier ranges; before is the last of `seen` (a struct that begins with the order, or null) in an earlier
    range, after the first in a later one.
    """
    key = F.struct(*by)
    ends = rows.groupBy(PART).agg(F.min(key).alias("low"), F.max(key).alias("high")).select(PART, F.explode(F.array_distinct(F.array("low", "high"))).alias("key"))
    cut = ends.groupBy("key").agg(F.count("*").alias("parts")).where("parts > 1").select(*[F.col(f"key.{k}").alias(f"__{k}") for k in by])
    keys = [f"__{k}" for k in by]
    facts = [F.count("*").alias("n")] + ([F.min(seen).alias("first"), F.max(seen).alias("last")] if seen is not None else [])
    sizes = written(rows.join(F.broadcast(cut), _same(rows, cut, by)).groupBy(*keys, PART).agg(*facts))
    along = Window.partitionBy(*keys).orderBy(PART)
    earlier, later = along.rowsBetween(Window.unboundedPreceding, -1), along.rowsBetween(1, Window.unboundedFollowing)
    more = {"start": F.coalesce(F.sum("n").over(earlier), F.lit(0))}
    if seen is not None:
        more |= {"before": F.last("last", True).over(earlier), "after": F.first("first", True).over(later)}
    return sizes.withColumns(more).drop("first", "last")


def with_halo(rows: DataFrame, by: Sequence[str], order: Sequence[str], before: int = 0, after: int = 0, parts: int | None = None) -> DataFrame:
    """rows and, in each range, copies (HALO is true) of the `before` rows before and `after` rows after it of the entities that the range cuts.

    Windows over (PART, by) then see what windows over `by` see, as far as they reach no further.
    """
    whole = dealt(rows, by, order, parts)
    cut = spans(whole, by)
    own = whole.join(F.broadcast(cut), _same(whole, cut, by) & (whole[PART] == cut[PART])).drop(cut[PART])
    inside = Window.partitionBy(PART, *by).orderBy(*order)
    placed = own.withColumn("__at", F.row_number().over(inside))
    edges = written(placed.where((F.col("__at") <= after) | (F.col("__at") > F.col("n") - before)).withColumn("__at", F.col("start") + F.col("__at")).drop("n", "start", *[f"__{k}" for k in by]))
    to = cut.withColumnRenamed(PART, "__to")
    near = ((F.col("__to") > F.col(PART)) & (F.col("__at") > F.col("start") - before)) | ((F.col("__to") < F.col(PART)) & (F.col("__at") <= F.col("start") + F.col("n") + after))
    halo = edges.join(F.broadcast(to), _same(edges, to, by) & near).withColumn(PART, F.col("__to")).select(*whole.columns)
    return whole.withColumn(HALO, F.lit(False)).unionByName(halo.withColumn(HALO, F.lit(True)))


def _own(rows: DataFrame) -> DataFrame:
    return rows.where(~F.col(HALO)).drop(PART, HALO)


def add_lags(panel: DataFrame, signals: Sequence[str], parts: int | None = None) -> DataFrame:
    """features.add_lags() for long entities."""
    return _own(features.add_lags(with_halo(panel, ["entity"], ["date"], before=1, parts=parts), signals, (PART, "entity")))


def add_rolling(panel: DataFrame, signals: Sequence[str], window: int = 3, least: int = 2, parts: int | None = None) -> DataFrame:
    """features.add_rolling() for long entities."""
    return _own(features.add_rolling(with_halo(panel, ["entity"], ["date"], before=window - 1, parts=parts), signals, window, least, (PART, "entity")))


def audit_gaps(rows: DataFrame, parts: int | None = None) -> DataFrame:
    """audit.audit_gaps() for long entities."""
    return audit.audit_gaps(with_halo(rows, ["entity"], ["date"], before=1, parts=parts), within=(PART, "entity"), halo=HALO)


def interpolate_series(rows: DataFrame, entity: str = "entity", date: str = "date", value: str = "apps", trailing: str = "carry", parts: int | None = None) -> DataFrame:
    """clean.interpolate_series() for long entities: each range knows the last observation before it and the next one after it."""
    whole = dealt(rows.where(F.col(entity).isNotNull()).withColumn("__x", F.col(value).cast("double")), [entity], [date], parts)
    inside = Window.partitionBy(PART, entity).orderBy(date)
    placed = written(whole.withColumn("__at", F.row_number().over(inside)))
    starts = spans(placed, [entity]).select(f"__{entity}", PART, "start")
    moved = placed.join(F.broadcast(starts), _same(placed, starts, [entity]) & (placed[PART] == starts[PART]), "left").drop(starts[PART], f"__{entity}")
    moved = written(moved.withColumn("__at", F.col("__at") + F.coalesce("start", F.lit(0))).drop("start"))
    seen = F.when(F.col("__x").isNotNull(), F.struct("__at", "__x"))
    sides = spans(moved, [entity], seen).select(f"__{entity}", PART, "before", "after")
    joined = moved.join(F.broadcast(sides), _same(moved, sides, [entity]) & (moved[PART] == sides[PART]), "left").drop(sides[PART], f"__{entity}")
    back = inside.rowsBetween(Window.unboundedPreceding, 0)
    ahead = Window.partitionBy(PART, entity).orderBy(F.desc("__at")).rowsBetween(Window.unboundedPreceding, 0)
    sided = joined.withColumn("__before", F.coalesce(F.last(seen, True).over(back), "before")).withColumn("__after", F.coalesce(F.last(seen, True).over(ahead), "after")).drop("before", "after", PART)
    lined, fill = filled_lines(sided, value, trailing)
    lined = written(lined)
    means = lined.groupBy(entity).agg(F.avg("__linear").alias("__mean")).withColumnRenamed(entity, "__key")
    full = lined.join(means, F.col(entity) == F.col("__key")).withColumn(value, F.coalesce("__linear", "__mean")).withColumn("fill", fill)
    return full.drop("__at", "__x", "__before", "__after", "__linear", "__mean", "__key")


def asof_join(rows: DataFrame, facts: DataFrame, values: Sequence[str], by: Sequence[str] = ("entity",), date: str = "date", months: int = 0, parts: int | None = None) -> DataFrame:
    """rows with the last non-null of each of facts[values] that is dated at least `months` months before the row; null where there is none.

    Both tables are laid in one order of time, and values are carried on: no pair of a row and a fact is made. Of facts of one day the highest counts.
    Rows without a date or a key get nulls.
    """
    at = F.add_months(F.col(date).cast("date"), -months)
    asked = rows.select(F.struct(*rows.columns).alias("__row"), *by, at.alias("__day"), F.lit(1).alias("__kind"), *[F.lit(None).cast(facts.schema[v].dataType).alias(f"__{v}") for v in values])
    known = facts.where(F.col(date).isNotNull()).groupBy(*by, F.col(date).cast("date").alias("__day")).agg(*[F.max(v).alias(f"__{v}") for v in values])
    both = asked.unionByName(known.withColumns({"__row": F.lit(None).cast(asked.schema["__row"].dataType), "__kind": F.lit(0)}))
    whole = dealt(both, by, ["__day", "__kind"], parts)
    inside = Window.partitionBy(PART, *by).orderBy("__day", "__kind")
    found = whole
    for v in values:
        place = F.when(F.col(f"__{v}").isNotNull(), F.struct("__day", f"__{v}"))
        sides = spans(whole, by, place).select(*[f"__{k}" for k in by], PART, "before")
        found = found.join(F.broadcast(sides), _same(found, sides, by) & (found[PART] == sides[PART]), "left").drop(sides[PART], *[f"__{k}" for k in by])
        carried = F.coalesce(F.last(f"__{v}", True).over(inside.rangeBetween(Window.unboundedPreceding, Window.currentRow)), F.col("before")[f"__{v}"])
        found = found.withColumn(f"__found_{v}", carried).drop("before")
    clear = F.col("__day").isNotNull()
    for k in by:
        clear = clear & F.col(k).isNotNull()
    return found.where("__kind = 1").select("__row.*", *[F.when(clear, F.col(f"__found_{v}")).alias(v) for v in values])
