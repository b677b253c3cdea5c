import random

import pytest
from pyspark.sql import functions as F

from panelkit.operators import signals
from panelkit.plans import inputs as I
from panelkit.streaming.arrivals import StitchedSeries, stream_chunks

SF = "/root/testdata/sf0.001"


def rows(df):
    return sorted(map(str, df.select(*sorted(df.columns)).collect()))


@pytest.mark.parametrize("seed", [1, 2])
def test_any_order_of_arrival_gives_what_one_batch_gives(spark, tmp_path, seed):
    chunks = spark.createDataFrame(I.chunks(spark, SF).where("keyword <> 'R'").toPandas(), "keyword string, market string, chunk string, date date, value double")
    names = sorted(tuple(r) for r in chunks.select("market", "chunk").distinct().collect())
    random.Random(seed).shuffle(names)
    state = StitchedSeries(spark, str(tmp_path / "state"))
    wrong = chunks.where(F.col("chunk") == "1995").withColumn("value", F.col("value") + 7)  # comes again, corrected
    wrong.write.parquet(str(tmp_path / "in"))
    state.update(stream_chunks(spark, str(tmp_path / "in")))
    for k in range(0, len(names), 12):
        lot = spark.createDataFrame(names[k : k + 12], "market string, chunk string")
        chunks.join(lot, ["market", "chunk"]).select(*chunks.columns).coalesce(2).write.mode("append").parquet(str(tmp_path / "in"))
        state.update(stream_chunks(spark, str(tmp_path / "in"), 1 + k % 3))
    assert rows(state.chunks()) == rows(chunks)
    assert rows(state.series()) == rows(signals.stitch_signals(chunks))
    order = signals.order_chunks(chunks)
    want = signals.chunk_scales(order, signals.overlap_ratios(chunks.join(order, [*signals.SERIES, "chunk"])))
    assert rows(state.scales().drop("chunk").withColumn("scale", F.round("scale", 9))) == rows(want.withColumn("scale", F.round("scale", 9)))


def test_other_series_are_left_alone(spark, tmp_path):
    make = lambda market, chunk, day, value: [("k", market, chunk, f"2000-{day:02d}-{d:02d}", value * d) for d in range(1, 9)]
    frame = lambda data: spark.createDataFrame(data, "keyword string, market string, chunk string, date string, value double").withColumn("date", F.col("date").cast("date"))
    state = StitchedSeries(spark, str(tmp_path / "state"))
    for data in (make("a b", "1", 1, 2.0) + make("c", "1", 1, 3.0), make("c", "2", 1, 5.0)):
        frame(data).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        before = {p: p.stat().st_mtime_ns for p in (tmp_path / "state").rglob("series/**/*.parquet")}
        state.update(stream_chunks(spark, str(tmp_path / "in")))
    after = {p: p.stat().st_mtime_ns for p in (tmp_path / "state").rglob("series/**/*.parquet")}
    assert [p.parent.name for p in after if p in before and before[p] == after[p]] == ["market=a b"]
    assert {r.chunk: r.scale for r in state.scales().where("market = 'c'").collect()} == {"1": pytest.approx(5 / 3), "2": 1.0}
    state.update(stream_chunks(spark, str(tmp_path / "in")))  # nothing new
    assert {p: p.stat().st_mtime_ns for p in (tmp_path / "state").rglob("series/**/*.parquet")} == after
