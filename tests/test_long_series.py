import random
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from panelkit.operators import audit, clean, features, long_series


def frame(spark, seed=1, days=900):
    """One entity with nearly all rows, small ones beside it, one without a name, and long runs without a value."""
    draw = random.Random(seed)
    rows = [("long", date(2000, 1, 1) + timedelta(days=k * 30 + (k % 50 == 0)), None if 200 < k < 700 or draw.random() < 0.3 or k > 880 else float(draw.randrange(90))) for k in range(days)]
    rows += [(e, date(2001, m, 1), None if draw.random() < 0.3 else float(m)) for e in ("a", "m", "z", None) for m in range(1, 13)] + [("empty", date(2000, m, 1), None) for m in range(1, 9)]
    draw.shuffle(rows)
    return spark.createDataFrame(rows, "entity string, date date, x double")


def same(a, b):
    rows = lambda df: sorted(map(str, df.select(*sorted(df.columns)).collect()))
    assert rows(a) == rows(b)


@pytest.mark.parametrize("parts", [1, 7, 120])
def test_equal_to_plain_windows(spark, parts):
    df = frame(spark)
    same(long_series.add_lags(df, ["x"], parts), features.add_lags(df, ["x"]))
    same(long_series.add_rolling(df, ["x"], 4, 2, parts), features.add_rolling(df, ["x"], 4, 2))
    same(long_series.audit_gaps(df, parts), audit.audit_gaps(df))
    for trailing in ("carry", "mean"):
        a, b = (d.withColumn("x", F.round("x", 8)) for d in (long_series.interpolate_series(df, value="x", trailing=trailing, parts=parts), clean.interpolate_series(df, value="x", trailing=trailing)))
        same(a, b)
    assert long_series.interpolate_series(df.limit(0), value="x").count() == 0 == long_series.add_lags(df.limit(0), ["x"]).count()


def test_no_range_has_the_whole_entity(spark):
    df = frame(spark)
    halo = long_series.with_halo(df, ["entity"], ["date"], before=2, after=1, parts=12)
    sizes = {r[long_series.PART]: r["count"] for r in halo.groupBy(long_series.PART).count().collect()}
    assert len(sizes) >= 10 and max(sizes.values()) < 250
    assert halo.where(long_series.HALO).count() <= 12 * 3 * 2
    assert long_series.spans(long_series.dealt(df, ["entity"], ["date"], 12), ["entity"]).count() <= 2 * 12


@pytest.mark.parametrize("parts", [1, 9])
def test_asof_join_against_loops(spark, parts):
    draw = random.Random(parts)
    day = lambda: date(2000, draw.randrange(1, 13), draw.randrange(1, 28))
    rows = [(draw.choice(["hot"] * 8 + ["b", None, "c"]), draw.choice([day(), day(), day(), None]), k) for k in range(300)]
    facts = [(draw.choice(["hot"] * 8 + ["b", None, "d"]), draw.choice([day(), day(), day(), None]), draw.choice([None, float(k)]), str(k)) for k in range(200)]
    left, right = spark.createDataFrame(rows, "entity string, date date, k long"), spark.createDataFrame(facts, "entity string, date date, v double, w string")
    got = {r.k: (r.entity, r.date, r.v, r.w) for r in long_series.asof_join(left, right, ["v", "w"], months=2, parts=parts).collect()}

    def before(d):
        m = d.year * 12 + d.month - 1 - 2
        return date(m // 12, m % 12 + 1, min(d.day, 27))

    def last(entity, d, at):
        known = [(f[1], f[at]) for f in facts if f[0] == entity and f[1] and f[at] is not None and f[1] <= before(d)]
        return max(known)[1] if known and entity else None

    assert got == {k: (e, d, last(e, d, 2) if d else None, last(e, d, 3) if d else None) for e, d, k in rows}
