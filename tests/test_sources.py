"""Sources and sinks on files written for the test."""

import datetime as dt

from pyspark.sql import functions as F

from panelkit.operators import backtest, features
from panelkit.plans import registry
from panelkit.sources import readers, sinks


def write(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text)


def test_chunks_take_the_keyword_from_the_folder(spark, tmp_path):
    write(tmp_path / "Food bank 2017" / "Los Angeles" / "LA_2017-01.csv", '"Time","another name"\n"2017-01-01",51\n"2017-01-08","92"\n"x",1\n"2017-01-15",')
    write(tmp_path / "Other 2017" / "Eureka" / "E.csv", '"Time","x"\n"2017-01-01",1')
    write(tmp_path / "Unmapped" / "Eureka" / "E.csv", '"Time","x"\n"2017-01-01",1')
    got = readers.read_signal_chunks(spark, str(tmp_path), {"Food bank 2017": "FoodBank", "Other 2017": "Other"}).orderBy("keyword", "date").collect()
    assert [tuple(r) for r in got] == [
        ("FoodBank", "Los Angeles", "LA_2017-01", dt.date(2017, 1, 1), 51.0), ("FoodBank", "Los Angeles", "LA_2017-01", dt.date(2017, 1, 8), 92.0), ("Other", "Eureka", "E", dt.date(2017, 1, 1), 1.0),
    ]


def test_exports_with_a_preamble(spark, tmp_path):
    write(tmp_path / "kw" / "Fresno.csv", 'Category: All categories\n\n"Time",x\n2025-01-05,7\n2025-01-12,8\nlabel,9\n')
    write(tmp_path / "kw" / "Chico.csv", "Day,x\n2025-02-01,3\n")
    write(tmp_path / "kw" / "Empty.csv", "no data here\n")
    got = readers.read_prediction_signals(spark, str(tmp_path), {"kw": "K"}).orderBy("market", "date").collect()
    assert [(r.keyword, r.market, str(r.date), r.value) for r in got] == [("K", "Chico", "2025-02-01", 3.0), ("K", "Fresno", "2025-01-05", 7.0), ("K", "Fresno", "2025-01-12", 8.0)]


def test_counts_dimensions_and_rates(spark, tmp_path):
    write(tmp_path / "counts.csv", 'Alpine,Jan 2023,"1,234"\nAlpine,February 2023,*\nAlpine,bad,1\n')
    write(tmp_path / "dim.csv", 'County , Population ,extra\nAlpine,"1,204",x\n')
    write(tmp_path / "rate.csv", "county,date,unemployment_rate\nAlpine,2023-01-15,4.5\n")
    got = readers.read_counts(spark, str(tmp_path / "counts.csv")).orderBy("date").collect()
    assert [tuple(r) for r in got] == [("Alpine", dt.date(2023, 1, 1), dt.date(2022, 12, 1), 1234.0), ("Alpine", dt.date(2023, 2, 1), dt.date(2023, 1, 1), None)]
    assert tuple(readers.read_dimension(spark, str(tmp_path / "dim.csv"), {"County": "entity", "Population": "population"}, ["population"]).first()) == ("Alpine", 1204.0)
    assert tuple(readers.read_monthly_rate(spark, str(tmp_path / "rate.csv")).first()) == ("Alpine", dt.date(2023, 1, 1), 4.5)


def test_missing_sources_are_empty(spark, tmp_path):
    gone = str(tmp_path / "gone")
    assert readers.read_counts(spark, gone).count() == 0 and readers.read_counts(spark, gone).columns == ["entity", "date", "trend_date", "apps"]
    assert readers.read_signal_chunks(spark, gone, {"a": "A"}).count() == 0
    assert readers.read_export_csv(spark, gone).count() == 0
    assert readers.read_dimension(spark, gone, {"County": "entity"}).columns == ["entity"]


def backwards(spark, markets=("m 1", "m 2"), days=40):
    """Rows of a few markets, latest date first, from several tasks."""
    return spark.createDataFrame([(m, k, dt.date(2020, 1, 1) + dt.timedelta(k), float(k)) for k in reversed(range(days)) for m in markets], "market string, at int, date date, value double").repartition(4, "at")


def test_exports_keep_their_head_before_the_data(spark, tmp_path):
    rows = backwards(spark)
    head = rows.select("market").distinct().select("market", F.lit(-1).alias("at"), F.lit("Time").alias("c"), F.lit("y").alias("v"))
    data = rows.select("market", "at", F.date_format("date", "yyyy-MM-dd").alias("c"), F.col("value").cast("string").alias("v"))
    registry._by_market(data.unionByName(head), str(tmp_path / "kw"), "at")
    files = list((tmp_path / "kw").glob("market=*/*.csv"))
    assert len(files) == 2 and all(f.read_text().splitlines() == ["Time,y"] + [f"{dt.date(2020, 1, 1) + dt.timedelta(k)},{k}.0" for k in range(40)] for f in files)
    assert readers.read_export_csv(spark, f"{tmp_path}/kw/*/*.csv").count() == 80
    assert readers.read_prediction_signals(spark, str(tmp_path), {"kw/*": "K"}).where("keyword = 'K'").count() == 80


def test_files_are_in_order(spark, tmp_path):
    rows = backwards(spark)
    sinks.write_series(rows, str(tmp_path / "s"))
    sinks.write_table(rows.withColumnRenamed("market", "entity").select("entity", "date", "value"), str(tmp_path / "t"), kind="csv")
    for f in [*tmp_path.glob("s/market=*/*.csv"), *tmp_path.glob("t/year=*/*.csv")]:
        lines = [x for x in f.read_text().splitlines() if not x.startswith("entity")]
        assert lines and lines == sorted(lines)


def test_round_trips(spark, tmp_path):
    rows = spark.createDataFrame([("a", dt.date(2020, 1, 1), 1.0), ("b", dt.date(2021, 1, 1), 2.0)], "entity string, date date, v double")
    sinks.write_table(rows, str(tmp_path / "t"))
    assert spark.read.parquet(str(tmp_path / "t")).select("entity", "v").exceptAll(rows.select("entity", "v")).count() == 0
    series = spark.createDataFrame([("m 1", dt.date(2020, 1, 1), 1.0)], "market string, date date, value double")
    sinks.write_series(series, str(tmp_path / "s"))
    assert spark.read.csv(str(tmp_path / "s")).count() == 1
    params = spark.createDataFrame([("k", "m", 1.5), ("k", "n", float("inf"))], "keyword string, market string, train_avg double")
    sinks.write_params_json(params, str(tmp_path / "p"))
    assert {tuple(r) for r in sinks.read_params_json(spark, str(tmp_path / "p")).collect()} == {("k", "m", 1.5), ("k", "n", None)}


def test_model_bundle(spark, tmp_path):
    rows = spark.createDataFrame([("e", dt.date(2020, 1, 1), float(k), float(2 * k)) for k in range(40)], "entity string, date date, x double, y double")
    model = backtest.train_regressor(rows, ["x"], "y", trees=2, depth=2)
    sinks.save_model_bundle(model, str(tmp_path / "b"), ["x"], features.feature_ranges(rows, ["x"]), 0.1, {"trees": 2})
    loaded, meta, ranges = sinks.load_model_bundle(spark, str(tmp_path / "b"))
    assert (meta["features"], meta["mae"], meta["params"]) == (["x"], 0.1, {"trees": "2"}) and tuple(ranges.first()) == ("x", 0.0, 39.0)
    assert backtest.predict(loaded, rows, ["x"]).agg(F.sum("predicted")).first()[0] == backtest.predict(model, rows, ["x"]).agg(F.sum("predicted")).first()[0]
