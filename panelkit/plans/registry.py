"""All registered queries over the driver tables, with the SQL that gives the same rows.

Dates come out as DATE, counts as BIGINT, and floating numbers rounded to six digits at the very end.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import replace
from typing import NamedTuple

from pyspark.ml import Pipeline
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import LinearRegression
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType

from panelkit.functions import columns as C
from panelkit.functions import special
from panelkit.operators import alerts, audit, backtest, boosting, clean, features, forecast, long_series, metrics, signals, stattests
from panelkit.operators import panel as panels
from panelkit.plans import inputs as I
from panelkit.session import checkpoint_dir, table, written
from panelkit.sources import readers, sinks
from panelkit.streaming import arrivals

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def tidy(df: DataFrame) -> DataFrame:
    """Whole numbers as BIGINT and floating ones rounded to six digits, without negative zeros."""
    kinds = {f.name: f.dataType for f in df.schema.fields}
    return df.select(*[(F.round(c, 6) + 0.0).alias(c) if isinstance(t, DoubleType) else F.col(c).cast("long").alias(c) if isinstance(t, IntegerType) else F.col(c) for c, t in kinds.items()])


def unsigned_zeros(sql: str) -> str:
    """The SQL with 0.0 added to the numbers that are rounded to six digits, as tidy() does."""
    return sql.replace(", 6) AS ", ", 6) + 0.0 AS ")


def query(sql: str | None = None, name: str | None = None):
    """Register a function of (spark, sf_dir); sql goes on from the common table expressions of the inputs."""

    def register(f: Callable[[SparkSession, str], DataFrame]):
        key = name or f.__name__
        QUERIES[key] = lambda spark, sf: tidy(f(spark, sf))
        if sql:
            start = I.SQL.replace("WITH ", "WITH RECURSIVE ", 1) if special.WAYS_SQL in sql else I.SQL
            ORACLE_SQL[key] = start + unsigned_zeros(sql)
        return f

    return register


# --- flagship -----------------------------------------------------------------------------------------------------


def _signal_panel(spark: SparkSession, sf: str, counts: DataFrame | None = None) -> DataFrame:
    """The assembled panel with lag-shifted monthly signals."""
    return _assembled(I.counts(spark, sf) if counts is None else counts, I.markets(spark, sf), signals.monthly_mean(I.weekly(spark, sf)), I.population(spark, sf))


def _assembled(counts: DataFrame, markets: DataFrame, monthly: DataFrame, dims: DataFrame) -> DataFrame:
    income = dims.select(C.normalize_key(F.col("entity")).alias("key"), "income")
    return panels.assemble_panel(counts, markets, signals.pivot_signals(monthly, I.KEYWORDS), dims.select("entity", "population"), income)


PANEL_SQL = I.SQL.rstrip() + """,
weekly_monthly AS (SELECT keyword, market, date_trunc('month', date)::DATE AS month, avg(value) AS avg_value FROM weekly GROUP BY 1, 2, 3),
wide AS (SELECT market, month, max(avg_value) FILTER (WHERE keyword = 'A') AS "signal_A", max(avg_value) FILTER (WHERE keyword = 'N') AS "signal_N", max(avg_value) FILTER (WHERE keyword = 'R') AS "signal_R" FROM weekly_monthly GROUP BY 1, 2),
assembled AS (
  SELECT c.entity, c.date, m.market, c.apps, p.population, p.income, month(c.date) AS month, c.apps / p.population AS rate, w."signal_A", w."signal_N", w."signal_R"
  FROM counts c JOIN markets m USING (entity) JOIN population p USING (entity) LEFT JOIN wide w ON w.market = m.market AND w.month = c.date - INTERVAL 1 MONTH)
"""


def panel_query(sql: str, name: str | None = None):
    def register(f):
        query(None, name)(f)
        ORACLE_SQL[name or f.__name__] = PANEL_SQL + unsigned_zeros(sql)
        return f

    return register


def _persistence(rows: DataFrame) -> DataFrame:
    from pyspark.sql import Window

    rows = features.add_momentum(features.add_rolling(features.add_lags(rows, ["signal_A"]), ["signal_A"]), ["signal_A"])
    rows = rows.withColumn("predicted", F.lag("rate", 1).over(Window.partitionBy("entity").orderBy("date"))).dropna(subset=["rate", "predicted"])
    error = F.col("rate") - F.col("predicted")
    return rows.groupBy("date").agg(
        F.count("*").alias("n"), F.avg(F.abs(error)).alias("mae"), F.sqrt(F.avg(error * error)).alias("rmse"), F.avg("signal_A_momentum").alias("mean_momentum"), F.avg("signal_A_roll3").alias("mean_roll3")
    )


def _whole_panel(spark: SparkSession, sf: str) -> DataFrame:
    return _signal_panel(spark, sf, I.order_counts(spark, sf).select("entity", "date", F.col("n_orders").cast("double").alias("apps")))


_PERSISTENCE = """
, whole AS (SELECT a.* REPLACE (o.n_orders::DOUBLE AS apps, o.n_orders / a.population AS rate) FROM assembled a JOIN order_counts o USING (entity, date)), featured AS (SELECT *, "signal_A" AS a_lag1, lag("signal_A") OVER w AS a_lag2, lag(rate) OVER w AS predicted,
  CASE WHEN count("signal_A") OVER r >= 2 THEN avg("signal_A") OVER r END AS a_roll3
  FROM whole WINDOW w AS (PARTITION BY entity ORDER BY date), r AS (PARTITION BY entity ORDER BY date ROWS BETWEEN 2 PRECEDING AND CURRENT ROW))
SELECT date, count(*) AS n, round(avg(abs(rate - predicted)), 6) AS mae, round(sqrt(avg((rate - predicted) ** 2)), 6) AS rmse,
  round(avg(a_lag1 - a_lag2), 6) AS mean_momentum, round(avg(a_roll3), 6) AS mean_roll3
FROM featured WHERE rate IS NOT NULL AND predicted IS NOT NULL GROUP BY 1
"""


@panel_query(_PERSISTENCE)
def persistence_backtest(spark, sf):
    return _persistence(_whole_panel(spark, sf))


@panel_query(_PERSISTENCE)
def bucketed_backtest(spark, sf):
    """The panel is written once by entity, and back-tested without being dealt out again; its last year is then replaced alone."""
    panel, name = _whole_panel(spark, sf), f"panel_{uuid.uuid4().hex}"
    sinks.write_bucketed(panel, name, _folder(spark), years=True)
    sinks.replace_years(panel.where(F.year("date") == 2001), name)
    return _persistence(spark.table(name))


# --- parsing ------------------------------------------------------------------------------------------------------


def _raw_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Counts as a report would print them: thousands commas, suppressed ones as '*', two spellings of the month."""
    text = F.when(F.col("n_orders") < I.SUPPRESSED_BELOW, "*").otherwise(F.format_number(F.col("n_orders") * 1234, 0))
    spelled = F.when(F.col("n_orders") % 2 == 0, F.date_format("date", "MMM yyyy")).otherwise(F.date_format("date", "MMMM yyyy"))
    return I.order_counts(spark, sf).select(F.concat(F.lit(" "), F.col("entity"), F.lit(" County")).alias("entity"), spelled.alias("month"), text.alias("count"))


@query("""SELECT concat(entity, ' County') AS entity, date, (date - INTERVAL 1 MONTH)::DATE AS trend_date, CASE WHEN n_orders >= 4 THEN (n_orders * 1234)::DOUBLE END AS apps FROM order_counts""")
def parse_counts(spark, sf):
    return readers.clean_counts(_raw_counts(spark, sf))


@query("""SELECT DISTINCT replace(entity, ' ', '') AS key, entity AS name FROM counts""")
def normalize_keys(spark, sf):
    raw = readers.clean_counts(_raw_counts(spark, sf))
    name = C.strip_suffix(F.col("entity"))
    return raw.select(C.normalize_key(name).alias("key"), name.alias("name")).distinct()


@query("""SELECT keyword, market, date, value FROM weekly WHERE day(date) % 5 <> 0""")
def coerce_signal(spark, sf):
    bad = F.dayofmonth("date") % 5 == 0
    text = I.weekly(spark, sf).select("keyword", "market", F.when(bad & (F.dayofmonth("date") == 5), "n/a").otherwise(F.date_format("date", "yyyy-MM-dd")).alias("date"), F.when(bad, "x").otherwise(F.col("value").cast("string")).alias("value"))
    return readers.coerce_signal(text)


@query("""SELECT entity, date, CASE WHEN n_orders >= 4 THEN n_orders::DOUBLE END AS apps FROM order_counts WHERE year(date) >= 1997
UNION ALL SELECT entity, date, n_orders * 1000.0::DOUBLE FROM order_counts WHERE year(date) < 1997""")
def union_layouts(spark, sf):
    c = I.order_counts(spark, sf)
    text = F.when(F.col("n_orders") < I.SUPPRESSED_BELOW, "*").otherwise(F.col("n_orders").cast("string"))
    new = c.where(F.year("date") >= 1997).select("entity", F.date_format("date", "MMM yyyy").alias("m"), text.alias("v"))
    total = new.groupBy("m").agg(F.lit("Statewide").alias("entity"), F.lit("1").alias("v")).select("entity", "m", "v")
    old = c.where(F.year("date") < 1997).select(F.format_number(F.col("n_orders") * 1000, 0).alias("v"), F.date_format("date", "yyyy-MM-dd").alias("m"), "entity")
    overlap = new.limit(0).unionByName(new.select("entity", "m", F.lit("7").alias("v")))  # the first table wins
    return readers.union_layouts([(new.unionByName(total), readers.Layout(0, 1, 2)), (overlap, readers.Layout(0, 1, 2)), (old, readers.Layout(2, 1, 0, "yyyy-MM-dd"))])


# Files: rows of the driver tables go to a new folder beside the checkpoints and are read back.


def _folder(spark) -> str:
    return f"{checkpoint_dir(spark)}/files/{uuid.uuid4().hex}"


def _by_market(rows: DataFrame, folder: str, order: str = "date") -> None:
    """Files folder/market=<market>/*.csv without header, in order. A write by market sorts anew unless the market leads the order."""
    rows.repartition("market").sortWithinPartitions("market", order).drop(*([order] if order != "date" else [])).write.partitionBy("market").csv(folder)


@query("SELECT keyword, market, date, round(value, 6) AS value FROM weekly WHERE keyword <> 'R'")
def read_signal_chunks(spark, sf):
    root = _folder(spark)
    for k in I.KEYWORDS:
        one = I.weekly(spark, sf).where(F.col("keyword") == k).select("market", F.date_format("date", "yyyy-MM-dd").alias("Time"), F.col("value").cast("string").alias("some header"))
        one.repartition("market").write.option("header", True).partitionBy("market").csv(f"{root}/Signals {k}+ 2017")
    found = readers.read_signal_chunks(spark, root, {f"Signals {k}+ 2017": k for k in I.KEYWORDS if k != "R"})  # a folder that is not mapped is not read
    return found.select("keyword", F.regexp_replace("market", "^market=", "").alias("market"), "date", "value")


def _exports(spark, sf, keyword: str, root: str) -> None:
    """Exports of a keyword: two lines of metadata, a header, data; a file for each market."""
    rows = I.weekly(spark, sf).where(F.col("keyword") == keyword)
    head = rows.select("market").distinct().select("market", F.inline(F.array(*[F.struct(F.lit(k).alias("at"), F.lit(a).alias("c"), F.lit(b).alias("v")) for k, (a, b) in enumerate([("Category: All", ""), ("x", ""), ("Time", "y")])])))
    data = rows.select("market", (F.datediff("date", F.lit("1970-01-01")) + 10).alias("at"), F.date_format("date", "yyyy-MM-dd").alias("c"), F.col("value").cast("string").alias("v"))
    _by_market(head.unionByName(data), f"{root}/{keyword}", "at")


@query("SELECT date, round(value, 6) AS value FROM weekly")
def read_export_csv(spark, sf):
    root = _folder(spark)
    for k in I.KEYWORDS:
        _exports(spark, sf, k, root)
    return readers.read_export_csv(spark, f"{root}/*/*/*.csv").select("date", "value")


@query("SELECT keyword, date, round(value, 6) AS value FROM weekly")
def read_prediction_signals(spark, sf):
    root = _folder(spark)
    for k in I.KEYWORDS:
        _exports(spark, sf, k, root)
    return readers.read_prediction_signals(spark, root, {f"{k}/*": k for k in I.KEYWORDS}).select("keyword", "date", "value")


_PARSED = """SELECT concat(entity, ' County') AS entity, date, (date - INTERVAL 1 MONTH)::DATE AS trend_date, CASE WHEN n_orders >= 4 THEN (n_orders * 1234)::DOUBLE END AS apps FROM order_counts"""


@query(_PARSED)
def read_counts(spark, sf):
    _raw_counts(spark, sf).write.csv(path := _folder(spark))
    return readers.read_counts(spark, path)


@query(_PARSED)
def read_or_empty(spark, sf):
    missing = readers.read_counts(spark, f"{_folder(spark)}/missing")
    return read_counts(spark, sf).unionByName(missing)


@query("SELECT entity, population::DOUBLE AS people, round(floor(income), 6) AS income FROM population")
def read_dimension(spark, sf):
    rows = I.population(spark, sf).select(F.concat(F.lit(" "), F.col("entity")).alias(" County "), F.format_number("population", 0).alias("Population "), F.format_number(F.floor("income"), 0).alias("Median Income"))
    rows.write.option("header", True).csv(path := _folder(spark))
    return readers.read_dimension(spark, path, {"County": "entity", "Population": "people", "Median Income": "income"}, ["people", "income"])


@query("SELECT entity, date, round(rate, 6) AS rate FROM rates")
def read_monthly_rate(spark, sf):
    rows = I.rates(spark, sf).select(F.col("entity").alias("county"), F.date_format(F.date_add("date", 3), "yyyy-MM-dd").alias("date"), F.col("rate").alias("unemployment_rate"))
    rows.write.option("header", True).csv(path := _folder(spark))
    return readers.read_monthly_rate(spark, path)


@query("SELECT entity, date, apps, round(rate, 6) AS rate, year(date) AS year FROM panel")
def write_table(spark, sf):
    sinks.write_table(I.panel(spark, sf).select("entity", "date", "apps", "rate"), path := _folder(spark))
    return spark.read.parquet(path)


@query("SELECT keyword || ' ' || market AS market, date, round(value, 6) AS value FROM weekly")
def write_series(spark, sf):
    sinks.write_series(I.weekly(spark, sf).withColumn("market", F.concat_ws(" ", "keyword", "market")), path := _folder(spark))
    return spark.read.schema("date date, value double, market string").csv(path).select("market", "date", "value")


@query("""SELECT keyword, market, round(train_avg, 6) AS train_avg FROM (SELECT keyword, market, avg(value) AS train_avg FROM weekly GROUP BY 1, 2)""")
def write_params_json(spark, sf):
    params = I.weekly(spark, sf).groupBy("keyword", "market").agg(F.avg("value").alias("train_avg"))
    sinks.write_params_json(params, path := _folder(spark))
    return sinks.read_params_json(spark, path)


@query(""", p AS (SELECT * FROM forecasts WHERE actual IS NOT NULL AND a IS NOT NULL), f AS (SELECT regr_slope(actual, a) AS w, regr_intercept(actual, a) AS c, min(a) AS low, max(a) AS high FROM p)
SELECT entity, date, round(greatest(c + w * a, 0), 4) AS predicted, round(low, 6) AS low, round(high, 6) AS high, 0.25::DOUBLE AS mae FROM p, f""")
def model_bundle(spark, sf):
    rows = I.forecasts(spark, sf).dropna(subset=["actual", "a"])
    model = Pipeline(stages=[VectorAssembler(inputCols=["a"], outputCol="features"), LinearRegression(labelCol="actual", solver="normal")]).fit(rows)
    sinks.save_model_bundle(model, path := _folder(spark), ["a"], features.feature_ranges(rows, ["a"]), 0.25, {"solver": "normal"})
    loaded, meta, ranges = sinks.load_model_bundle(spark, path)
    scored = backtest.predict(loaded, rows, meta["features"]).crossJoin(F.broadcast(ranges.select(F.col("min").alias("low"), F.col("max").alias("high"))))
    return scored.select("entity", "date", F.round("predicted", 4).alias("predicted"), "low", "high", F.lit(meta["mae"]).alias("mae"))


@query("""SELECT entity, date, apps FROM counts WHERE entity NOT IN ('NATION_3', 'NATION_7')""")
def drop_totals(spark, sf):
    return readers.drop_totals(I.counts(spark, sf).unionByName(I.counts(spark, sf).withColumn("entity", F.lit(" "))), "entity", ("NATION_3", "NATION_7"))


# --- signals ------------------------------------------------------------------------------------------------------


@query("SELECT keyword, market, date, round(value, 6) AS value FROM stitched")
def stitch_signals(spark, sf):
    return signals.stitch_signals(I.chunks(spark, sf))


@query("SELECT keyword, market, date, round(value, 6) AS value FROM stitched")
def stitch_arrivals(spark, sf):
    """The chunks arrive in two lots, the later years first."""
    root = _folder(spark)
    state, chunks = arrivals.StitchedSeries(spark, f"{root}/state"), I.chunks(spark, sf)
    for lot in (F.col("chunk") >= "1998", F.col("chunk") < "1998"):
        chunks.where(lot).write.mode("append").parquet(f"{root}/arrived")
        state.update(arrivals.stream_chunks(spark, f"{root}/arrived"))
    return state.series()


@query("SELECT keyword, market, seq, n_shared, round(ratio, 6) AS ratio FROM ratios")
def overlap_ratios(spark, sf):
    c = I.chunks(spark, sf)
    return signals.overlap_ratios(c.join(signals.order_chunks(c), ["keyword", "market", "chunk"]))


@query("SELECT keyword, market, seq, round(scale, 6) AS scale FROM scales")
def chunk_scales(spark, sf):
    c = I.chunks(spark, sf)
    order = signals.order_chunks(c)
    return signals.chunk_scales(order, signals.overlap_ratios(c.join(order, ["keyword", "market", "chunk"])))


@query("SELECT keyword, market, month, round(avg_value, 6) AS avg_value FROM monthly")
def monthly_mean(spark, sf):
    return signals.monthly_mean(signals.stitch_signals(I.chunks(spark, sf)))


def _monthly(spark, sf):
    return signals.monthly_mean(I.weekly(spark, sf))


@query("SELECT keyword, market, round_even(avg(avg_value), 4) AS train_avg FROM (SELECT keyword, market, date_trunc('month', date) AS m, avg(value) AS avg_value FROM weekly GROUP BY 1, 2, 3) GROUP BY 1, 2")
def scaling_params(spark, sf):
    return signals.scaling_params(_monthly(spark, sf))


PRED = """, wm AS (SELECT keyword, market, date_trunc('month', date)::DATE AS month, avg(value) AS v FROM weekly GROUP BY 1, 2, 3),
par AS (SELECT keyword, market, round_even(avg(v), 4) AS train_avg FROM wm WHERE market <> 'ASIA' GROUP BY 1, 2),
win AS (SELECT keyword, market, month, CASE WHEN market = 'EUROPE' THEN 0 ELSE v END AS v FROM wm WHERE month >= (SELECT max(month) FROM wm) - INTERVAL 11 MONTH),
scaled AS (SELECT w.keyword, w.market, w.month, CASE WHEN avg(w.v) OVER p = 0 THEN train_avg ELSE CASE WHEN w.v * train_avg / avg(w.v) OVER p < 0 THEN 0 ELSE w.v * train_avg / avg(w.v) OVER p END END AS scaled
  FROM win w LEFT JOIN par USING (keyword, market) WINDOW p AS (PARTITION BY w.keyword, w.market))
"""


def _window(spark, sf):
    m = _monthly(spark, sf)
    par = signals.scaling_params(m.where("market <> 'ASIA'"))
    last = m.agg(F.max("month").alias("last"))
    win = m.crossJoin(F.broadcast(last)).where(F.col("month") >= F.add_months("last", -11)).drop("last")
    return win.withColumn("avg_value", F.when(F.col("market") == "EUROPE", 0.0).otherwise(F.col("avg_value"))), par


@query(PRED + "SELECT keyword, market, month, round(scaled, 6) AS scaled FROM scaled")
def scale_prediction(spark, sf):
    return signals.scale_prediction(*_window(spark, sf))


@query(PRED + "SELECT keyword, market, round(arg_max(coalesce(scaled, 'nan'::DOUBLE), month), 6) AS scaled FROM scaled WHERE scaled IS NOT NULL GROUP BY 1, 2")
def scale_latest(spark, sf):
    return signals.scale_latest(*_window(spark, sf)).dropna()


@query("""SELECT keyword, market, date, value FROM weekly WHERE NOT (keyword = 'A' AND market = 'ASIA') AND NOT (keyword = 'N' AND market = 'EUROPE')
UNION ALL SELECT 'A', 'ASIA', date, (SELECT train_avg FROM params WHERE keyword = 'A' AND market = 'ASIA') FROM (SELECT DISTINCT date FROM weekly WHERE keyword = 'A' AND market <> 'ASIA')
UNION ALL SELECT 'N', 'EUROPE', date, (SELECT round(avg(train_avg), 6) FROM params WHERE keyword = 'N' AND market <> 'EUROPE') FROM (SELECT DISTINCT date FROM weekly WHERE keyword = 'N' AND market <> 'EUROPE')""")
def fill_missing_series(spark, sf):
    w = I.weekly(spark, sf)
    gone = ((F.col("keyword") == "A") & (F.col("market") == "ASIA")) | ((F.col("keyword") == "N") & (F.col("market") == "EUROPE"))
    par = signals.scaling_params(signals.monthly_mean(signals.stitch_signals(I.chunks(spark, sf)))).where("not (keyword = 'N' and market = 'EUROPE')")
    return signals.fill_missing_series(w.where(~gone), w.select("keyword", "market"), par)


@query("""SELECT k.keyword, m.market, c.chunk FROM (SELECT DISTINCT keyword FROM chunks) k, (SELECT DISTINCT market FROM chunks) m, (SELECT DISTINCT chunk FROM chunks) c
WHERE NOT EXISTS (SELECT 1 FROM chunks x WHERE x.keyword = k.keyword AND x.market = m.market AND x.chunk = c.chunk AND x.value < 100 AND x.date >= DATE '1999-01-01')""")
def missing_chunks(spark, sf):
    c = I.chunks(spark, sf)
    return signals.missing_chunks(c, c, c, c.where("value < 100 and date >= date'1999-01-01'"))


@query("SELECT (date_trunc('month', max(date)) + INTERVAL 1 MONTH)::DATE AS target_month FROM weekly WHERE market = 'ASIA' AND keyword = 'N'")
def target_month(spark, sf):
    return signals.target_month(I.weekly(spark, sf), "ASIA", ["ZZ", "N", "A"])


@query(PRED + """, both_ AS (SELECT keyword, market, month, v AS value, 1 AS r FROM wm UNION ALL SELECT keyword, market, month, scaled, 0 FROM scaled)
SELECT keyword, market, month, round(arg_min(coalesce(value, 'nan'::DOUBLE), r), 6) AS value FROM both_ WHERE month <= DATE '2001-01-01' AND market <> 'ASIA' GROUP BY 1, 2, 3""")
def combine_history(spark, sf):
    win, par = _window(spark, sf)
    scaled = signals.scale_prediction(win, par).withColumnRenamed("scaled", "value")
    return signals.combine_history(_monthly(spark, sf).withColumnRenamed("avg_value", "value"), scaled, "2001-01-01").where("market <> 'ASIA'")


@query("""SELECT keyword, list_transform(list_sort(list(struct_pack(market := market, v := train_avg))), lambda x: x.market || '=' || x.v::DECIMAL(12,4)::VARCHAR).list_aggregate('string_agg', ';') AS params FROM params GROUP BY 1""")
def write_params_json(spark, sf):
    doc = sinks.params_document(signals.scaling_params(signals.monthly_mean(signals.stitch_signals(I.chunks(spark, sf)))))
    cells = F.transform(F.map_entries("params"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("decimal(12,4)").cast("string")))
    return doc.select("keyword", F.array_join(F.array_sort(cells), ";").alias("params"))


# --- cleaning -----------------------------------------------------------------------------------------------------

FILLED = """, placed AS (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY date) AS k FROM counts),
seen AS (SELECT *, last_value(CASE WHEN apps IS NOT NULL THEN k END IGNORE NULLS) OVER b AS k0, last_value(apps IGNORE NULLS) OVER b AS x0,
  first_value(CASE WHEN apps IS NOT NULL THEN k END IGNORE NULLS) OVER a AS k1, first_value(apps IGNORE NULLS) OVER a AS x1
  FROM placed WINDOW b AS (PARTITION BY entity ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), a AS (PARTITION BY entity ORDER BY date ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
linear AS (SELECT *, CASE WHEN apps IS NOT NULL THEN apps WHEN x0 IS NOT NULL AND x1 IS NOT NULL THEN x0 + (x1 - x0) * (k - k0) / (k1 - k0) WHEN x0 IS NOT NULL THEN x0 END AS l FROM seen),
filled AS (SELECT entity, date, coalesce(l, avg(l) OVER (PARTITION BY entity)) AS filled,
  CASE WHEN apps IS NOT NULL THEN 'observed' WHEN x0 IS NOT NULL AND x1 IS NOT NULL THEN 'interpolated' WHEN l IS NOT NULL THEN 'carried' ELSE 'mean' END AS fill FROM linear)
"""


@query(FILLED + "SELECT entity, date, round(filled, 6) AS apps, fill FROM filled")
def interpolate_series(spark, sf):
    return clean.interpolate_series(I.counts(spark, sf))


@query(FILLED + "SELECT entity, date, round(filled, 6) AS apps, fill FROM filled")
def interpolate_long_series(spark, sf):
    """In more ranges than there are entities, so that most of them are cut."""
    return long_series.interpolate_series(I.counts(spark, sf), parts=60)


@query(FILLED + """SELECT entity, count(*) FILTER (WHERE fill <> 'observed') AS n_missing, count(*) FILTER (WHERE fill IN ('interpolated', 'carried')) AS n_interpolated,
count(*) FILTER (WHERE fill = 'mean') AS n_mean, 0::BIGINT AS n_left FROM filled GROUP BY 1""")
def imputation_report(spark, sf):
    return clean.imputation_report(clean.interpolate_series(I.counts(spark, sf)))


@query("SELECT entity, date, apps FROM (SELECT *, median(apps) OVER (PARTITION BY entity) AS m FROM counts) WHERE apps <= 1.5 * m")
def remove_outliers(spark, sf):
    return clean.remove_outliers(I.counts(spark, sf), "apps", factor=1.5)


@query("SELECT c_nationkey::BIGINT AS c_nationkey, c_mktsegment, c_custkey, round(c_acctbal, 6) AS c_acctbal FROM (SELECT *, row_number() OVER (PARTITION BY c_nationkey, c_mktsegment ORDER BY c_acctbal, c_custkey) AS r FROM customer) WHERE r = 1")
def dedupe_first(spark, sf):
    return clean.dedupe_by(table(spark, sf, "customer"), ["c_nationkey", "c_mktsegment"], ["c_acctbal", "c_custkey"]).select("c_nationkey", "c_mktsegment", "c_custkey", "c_acctbal")


@query("SELECT c_nationkey::BIGINT AS c_nationkey, c_mktsegment, c_custkey, round(c_acctbal, 6) AS c_acctbal FROM (SELECT *, row_number() OVER (PARTITION BY c_nationkey, c_mktsegment ORDER BY c_acctbal DESC, c_custkey DESC) AS r FROM customer) WHERE r = 1")
def dedupe_last(spark, sf):
    return clean.dedupe_by(table(spark, sf, "customer"), ["c_nationkey", "c_mktsegment"], ["c_acctbal", "c_custkey"], keep="last").select("c_nationkey", "c_mktsegment", "c_custkey", "c_acctbal")


@query("SELECT entity, date, apps, population, round(rate, 6) AS rate FROM panel")
def add_rate(spark, sf):
    return clean.add_rate(I.counts(spark, sf).join(I.population(spark, sf).select("entity", "population"), "entity"))


@query("SELECT entity, date, round(actual, 6) AS actual, round(a, 6) AS a, round(b, 6) AS b, NULL::DOUBLE AS nowhere FROM forecasts WHERE actual IS NOT NULL AND a IS NOT NULL AND b IS NOT NULL")
def drop_incomplete(spark, sf):
    rows = I.forecasts(spark, sf).select("entity", "date", "actual", "a", "b", F.lit(None).cast("double").alias("nowhere"))
    return clean.drop_incomplete(rows, ["a", "b", "nowhere", "absent"], "actual")


@query("SELECT date, entity, apps, NULL::DOUBLE AS extra FROM counts")
def conform(spark, sf):
    return clean.conform(I.counts(spark, sf), ["date", "entity", "apps", "extra", "absent"], ["extra"])


@query("SELECT entity, date, apps FROM counts WHERE date NOT BETWEEN DATE '1997-03-01' AND DATE '1998-12-01'")
def exclude_period(spark, sf):
    return clean.exclude_period(I.counts(spark, sf), "1997-03-01", "1998-12-01")


# --- panel and features -------------------------------------------------------------------------------------------


@panel_query('SELECT entity, date, market, apps, population, round(income, 6) AS income, month, round(rate, 6) AS rate, round("signal_A", 6) AS "signal_A", round("signal_N", 6) AS "signal_N", round("signal_R", 6) AS "signal_R" FROM assembled')
def assemble_panel(spark, sf):
    return _signal_panel(spark, sf)


@query("""SELECT p.entity, p.date, p.apps, round(r.u, 6) AS unemployment_rate, round(r.u1, 6) AS unemployment_rate_lag1 FROM counts p
LEFT JOIN (SELECT entity, date, lag(rate, 1) OVER w AS u, lag(rate, 2) OVER w AS u1 FROM rates WINDOW w AS (PARTITION BY entity ORDER BY date)) r USING (entity, date)""")
def join_lagged_rate(spark, sf):
    return panels.join_lagged_rate(I.counts(spark, sf), I.rates(spark, sf))


@query("""SELECT coalesce(r.entity, h.entity) AS entity, round(coalesce(r.a1, h.own), 6) AS asof_1, round(coalesce(r.a2, h.own), 6) AS asof_2
FROM (SELECT entity, arg_max(rate, date) FILTER (WHERE date <= DATE '1999-02-01') AS a1, arg_max(rate, date) FILTER (WHERE date <= DATE '1999-01-01') AS a2 FROM rates WHERE entity <> 'NATION_3' GROUP BY 1) r
FULL JOIN (SELECT entity, arg_max(rate, date) AS own FROM panel WHERE rate IS NOT NULL GROUP BY 1) h ON r.entity = h.entity""")
def asof_last(spark, sf):
    return panels.asof_last(I.rates(spark, sf).where("entity <> 'NATION_3'"), I.panel(spark, sf), "1999-03-01")


@query("""SELECT p.entity, p.date, round(a.rate, 6) AS rate, round(b.rate, 6) AS rate_before FROM panel p
ASOF LEFT JOIN (SELECT * FROM rates WHERE rate IS NOT NULL AND month(date) % 3 = 0) a ON p.entity = a.entity AND p.date - INTERVAL 1 MONTH >= a.date
ASOF LEFT JOIN (SELECT * FROM rates WHERE rate IS NOT NULL AND month(date) % 3 = 0) b ON p.entity = b.entity AND p.date - INTERVAL 5 MONTH >= b.date""")
def asof_join(spark, sf):
    """For every row the last quarterly rate that is known 1 and 5 months before it."""
    known = I.rates(spark, sf).where("month(date) % 3 = 0")
    rows = long_series.asof_join(I.panel(spark, sf).select("entity", "date"), known, ["rate"], months=1)
    return long_series.asof_join(rows, known.withColumnRenamed("rate", "rate_before"), ["rate_before"], months=5)


@panel_query('SELECT entity, date, round("signal_A", 6) AS lag1, round(lag("signal_A") OVER w, 6) AS lag2, round("signal_A" - lag("signal_A") OVER w, 6) AS momentum, round(CASE WHEN count("signal_A") OVER r >= 2 THEN avg("signal_A") OVER r END, 6) AS roll3 FROM assembled WINDOW w AS (PARTITION BY entity ORDER BY date), r AS (PARTITION BY entity ORDER BY date ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)')
def signal_lags(spark, sf):
    rows = features.add_momentum(features.add_rolling(features.add_lags(_signal_panel(spark, sf), ["signal_A"]), ["signal_A"]), ["signal_A"])
    return rows.select("entity", "date", *[F.col(f"signal_A_{x}").alias(x) for x in ("lag1", "lag2", "momentum", "roll3")])


@panel_query('SELECT entity, date, round("signal_A", 6) AS lag1, round(lag("signal_A") OVER w, 6) AS lag2, round("signal_A" - lag("signal_A") OVER w, 6) AS momentum, round(CASE WHEN count("signal_A") OVER r >= 2 THEN avg("signal_A") OVER r END, 6) AS roll3 FROM assembled WINDOW w AS (PARTITION BY entity ORDER BY date), r AS (PARTITION BY entity ORDER BY date ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)')
def long_signal_lags(spark, sf):
    rows = features.add_momentum(long_series.add_rolling(long_series.add_lags(_signal_panel(spark, sf), ["signal_A"]), ["signal_A"]), ["signal_A"])
    return rows.select("entity", "date", *[F.col(f"signal_A_{x}").alias(x) for x in ("lag1", "lag2", "momentum", "roll3")])


@query("SELECT DISTINCT date, month(date) AS month, quarter(date) AS quarter, round(sin(2 * pi() * month(date) / 12), 6) AS month_sin, round(cos(2 * pi() * month(date) / 12), 6) AS month_cos FROM counts")
def add_seasonality(spark, sf):
    return features.add_seasonality(I.counts(spark, sf).select("date").distinct())


@query("SELECT entity, round(log10(greatest(population, 1)), 6) AS log_population, round(log10(greatest(income, 1)), 6) AS log_income FROM population")
def add_logs(spark, sf):
    return features.add_logs(I.population(spark, sf), {"population": "log_population", "income": "log_income"}).select("entity", "log_population", "log_income")


@query("SELECT c_custkey, 1 + (c_acctbal > q[1])::BIGINT + (c_acctbal > q[2])::BIGINT + (c_acctbal > q[3])::BIGINT + (c_acctbal > q[4])::BIGINT AS income_quintile FROM customer, (SELECT quantile_cont(c_acctbal, [0.2, 0.4, 0.6, 0.8]) AS q FROM customer)")
def add_quintile(spark, sf):
    return features.add_quintile(table(spark, sf, "customer"), "c_acctbal", "c_custkey").select("c_custkey", "income_quintile")


@query("SELECT 'a' AS feature, round(min(a), 6) AS min, round(max(a), 6) AS max FROM forecasts UNION ALL SELECT 'b', round(min(b), 6), round(max(b), 6) FROM forecasts")
def feature_ranges(spark, sf):
    return features.feature_ranges(I.forecasts(spark, sf), ["a", "b"])


@query("""SELECT 'a' AS name, 'lag' AS grp, count(*) FILTER (WHERE a IS NULL) AS n_null, round_even(100.0 * count(*) FILTER (WHERE a IS NULL) / count(*), 2) AS null_pct, true AS present FROM forecasts
UNION ALL SELECT 'b', 'roll', count(*) FILTER (WHERE b IS NULL), round_even(100.0 * count(*) FILTER (WHERE b IS NULL) / count(*), 2), true FROM forecasts UNION ALL SELECT 'c', 'none', NULL, NULL, false""")
def feature_registry(spark, sf):
    listed = spark.createDataFrame([("a", "lag"), ("b", "roll"), ("c", "none")], "name string, grp string")
    return features.feature_registry(I.forecasts(spark, sf), listed)


# --- metrics and tests --------------------------------------------------------------------------------------------


def _metrics_sql(smape: str, by: str = "") -> str:
    keys, group = (f"{by}, ", f"GROUP BY {by}") if by else ("", "")
    return f"""SELECT {keys}count(*) AS n, round(CASE WHEN var_pop(actual) > 0 THEN 1 - sum((actual - b) ** 2) / (var_pop(actual) * count(*)) END, 6) AS r2, round(sqrt(avg((actual - b) ** 2)), 6) AS rmse,
round(avg(abs(actual - b)), 6) AS mae, round(avg({smape}), 6) AS smape FROM forecasts WHERE actual IS NOT NULL AND b IS NOT NULL {group}"""


_SIZE = "(abs(actual) + abs(b))"
for _mode, _sql in {"zero": f"CASE WHEN {_SIZE} > 0 THEN 200 * abs(actual - b) / {_SIZE} ELSE 0 END", "drop": f"CASE WHEN {_SIZE} > 0 THEN 200 * abs(actual - b) / {_SIZE} END", "eps": f"200 * abs(actual - b) / ({_SIZE} + 1e-9)"}.items():
    query(_metrics_sql(_sql), f"regression_metrics_{_mode}")(lambda spark, sf, m=_mode: metrics.regression_metrics(I.forecasts(spark, sf), (), "actual", "b", m))
    query(_metrics_sql(_sql, "date"), f"regression_metrics_by_month_{_mode}")(lambda spark, sf, m=_mode: metrics.regression_metrics(I.forecasts(spark, sf), ["date"], "actual", "b", m))


@query(""", x AS (SELECT actual AS y, greatest(b - 0.1, 0) AS p FROM forecasts WHERE actual IS NOT NULL AND b IS NOT NULL)
SELECT count(*) AS n, round(1 - sum((y - p) ** 2) / (var_pop(y) * count(*)), 6) AS r2, round(sqrt(avg((y - p) ** 2)), 6) AS rmse, round(avg(abs(y - p)), 6) AS mae, round(avg(CASE WHEN abs(y) + abs(p) > 0 THEN 200 * abs(y - p) / (abs(y) + abs(p)) ELSE 0 END), 6) AS smape FROM x""")
def in_sample_metrics(spark, sf):
    return metrics.regression_metrics(I.forecasts(spark, sf).withColumn("b", F.col("b") - 0.1), (), "actual", "b", "zero", clip=True)


@query("""SELECT round(avg(r2), 6) AS mean_r2, round(stddev_pop(r2), 6) AS std_r2, count(*) AS n_months, sum(n)::BIGINT AS n_predictions FROM (
SELECT date, count(*) AS n, CASE WHEN var_pop(actual) > 0 THEN 1 - sum((actual - b) ** 2) / (var_pop(actual) * count(*)) END AS r2 FROM forecasts WHERE actual IS NOT NULL AND b IS NOT NULL GROUP BY 1)""")
def backtest_summary(spark, sf):
    return metrics.backtest_summary(metrics.regression_metrics(I.forecasts(spark, sf), ["date"], "actual", "b"))


@query("SELECT round(avg(m), 6) AS mae FROM (SELECT avg(abs(actual - b)) AS m FROM forecasts WHERE actual IS NOT NULL AND b IS NOT NULL GROUP BY date)")
def interval_mae(spark, sf):
    return metrics.interval_mae(I.forecasts(spark, sf), predicted="b")


@query("SELECT date, round(sum(apps), 6) AS total_apps, round(avg(rate), 6) AS mean_rate FROM panel GROUP BY 1")
def monthly_rollup(spark, sf):
    return metrics.monthly_rollup(I.panel(spark, sf), ["apps"], ["rate"])


@query("SELECT count(DISTINCT entity) AS n_entities, count(DISTINCT market) AS n_markets, min(date) AS first_date, max(date) AS last_date, count(*) AS n_rows FROM panel")
def panel_profile(spark, sf):
    return metrics.panel_profile(I.panel(spark, sf))


@query("""SELECT bin, coalesce(n, 0) AS n, round(overall_mean, 6) AS overall_mean FROM (SELECT unnest(range(1, 61)) AS bin, (SELECT avg(o_totalprice) FROM orders) AS overall_mean) LEFT JOIN
(SELECT least(60, floor((o_totalprice - lo) / ((hi - lo) / 60)) + 1)::BIGINT AS bin, count(*) AS n FROM orders, (SELECT min(o_totalprice) AS lo, max(o_totalprice) AS hi FROM orders) GROUP BY 1) USING (bin)""")
def residual_histogram(spark, sf):
    return metrics.residual_histogram(table(spark, sf, "orders").select(F.col("o_totalprice").alias("residual")))


_QQ = """, q AS (SELECT actual - b AS q FROM forecasts WHERE actual IS NOT NULL AND b IS NOT NULL), o AS (SELECT row_number() OVER (ORDER BY q) AS i, count(*) OVER () AS n, q FROM q),
m AS (SELECT i, q, CASE WHEN i = n THEN 0.5 ** (1.0::DOUBLE / n) WHEN i = 1 THEN 1 - 0.5 ** (1.0::DOUBLE / n) ELSE (i - 0.3175) / (n + 0.365::DOUBLE) END AS p FROM o), z AS (SELECT i, q, """ + special.quantile_sql("p") + " AS z FROM m)"


@query(_QQ + "SELECT i, round(z, 6) AS z, round(q, 6) AS q FROM z")
def qq_points(spark, sf):
    return metrics.qq_points(I.forecasts(spark, sf).select((F.col("actual") - F.col("b")).alias("residual")).dropna())


@query(_QQ + "SELECT round(regr_slope(q, z), 6) AS slope, round(regr_intercept(q, z), 6) AS intercept, round(corr(q, z), 6) AS r FROM z")
def qq_fit(spark, sf):
    return metrics.qq_fit(I.forecasts(spark, sf).select((F.col("actual") - F.col("b")).alias("residual")).dropna())


@query("""SELECT date, round(mean_rate, 6) AS mean_rate, round(CASE WHEN count(mean_rate) OVER w >= 3 THEN avg(mean_rate) OVER w END, 6) AS smoothed FROM (SELECT date, avg(rate) AS mean_rate FROM panel GROUP BY 1)
WINDOW w AS (ORDER BY date ROWS BETWEEN 3 PRECEDING AND 2 FOLLOWING)""")
def smooth_centered(spark, sf):
    return metrics.smooth_centered(metrics.monthly_rollup(I.panel(spark, sf), [], ["rate"]), "mean_rate")


LOSSES = """, losses AS (SELECT date, count(*) AS n, avg((actual - a) ** 2) AS se_a, avg((actual - b) ** 2) AS se_b, avg(abs(actual - a)) AS ae_a, avg(abs(actual - b)) AS ae_b FROM forecasts
WHERE actual IS NOT NULL AND a IS NOT NULL AND b IS NOT NULL GROUP BY 1)
"""


def _losses(spark, sf):
    return stattests.paired_monthly_losses(I.forecasts(spark, sf), "a", "b")


@query(LOSSES + "SELECT date, n, round(se_a, 6) AS se_a, round(se_b, 6) AS se_b, round(ae_a, 6) AS ae_a, round(ae_b, 6) AS ae_b, round(se_a - se_b, 6) AS squared_diff, round(ae_a - ae_b, 6) AS absolute_diff FROM losses")
def paired_monthly_losses(spark, sf):
    return _losses(spark, sf)


@query(LOSSES + """, c AS (SELECT date, se_a - se_b AS d, (se_a - se_b) - avg(se_a - se_b) OVER () AS c FROM losses), g AS (SELECT *, c * lag(c) OVER (ORDER BY date) AS c1 FROM c),
s AS (SELECT count(*) AS n, avg(d) AS mean_diff, sum(c * c) / count(*) + 2 * (1 - 1 / 2.0) * sum(c1) / count(*) AS lrv FROM g)
SELECT n, round(mean_diff, 6) AS mean_diff, round(mean_diff / sqrt(lrv / n) * sqrt((n - 1.0) / n), 6) AS dm_stat FROM s""")
def diebold_mariano(spark, sf):
    return stattests.diebold_mariano(_losses(spark, sf), p_value=False)


@query(LOSSES + """, d AS (SELECT ae_a - ae_b AS d FROM losses WHERE ae_a <> ae_b), r AS (SELECT d, rank() OVER (ORDER BY abs(d)) + (count(*) OVER (PARTITION BY abs(d)) - 1) / 2.0 AS r FROM d)
SELECT count(*) AS n, round(sum(r) FILTER (WHERE d > 0), 6)::DOUBLE AS w_plus, round(least(sum(r) FILTER (WHERE d > 0), sum(r) FILTER (WHERE d < 0)), 6)::DOUBLE AS stat FROM r""")
def wilcoxon_signed_rank(spark, sf):
    return stattests.wilcoxon_signed_rank(_losses(spark, sf), p_value=False)


@query(LOSSES + """, r AS (SELECT rank() OVER (ORDER BY ae_a) + (count(*) OVER (PARTITION BY ae_a) - 1) / 2.0 AS x, rank() OVER (ORDER BY ae_b) + (count(*) OVER (PARTITION BY ae_b) - 1) / 2.0 AS y FROM losses)
SELECT count(*) AS n, round(corr(x, y), 6) AS rho FROM r""", "spearman")
def _spearman(spark, sf):
    return stattests.spearman(_losses(spark, sf), "ae_a", "ae_b", p_value=False)


def _p_values_sql(groups: str) -> str:
    """p-values beside the statistics (dm_stat, k months, w_plus, w_n differences, ties) of `groups`."""
    t, w = special.t_sql("dm_stat", "(k - 1)"), [special.signed_rank_sql("w_plus", "w_n", "ties", x) for x in ("two-sided", "greater")]
    return f"""SELECT *, round({t}, 6) AS dm_p, round({w[0]}, 6) AS p_two_sided, round({w[1]}, 6) AS p_greater FROM {groups} JOIN ways ON ways.r = least(w_n, {special.EXACT})"""


@query(LOSSES + f""", {special.WAYS_SQL}, c AS (SELECT date, se_a - se_b AS d, (se_a - se_b) - avg(se_a - se_b) OVER () AS c FROM losses), g AS (SELECT *, c * lag(c) OVER (ORDER BY date) AS c1 FROM c),
s AS (SELECT count(*) AS k, avg(d) AS md, sum(c * c) / count(*) + sum(c1) / count(*) AS lrv FROM g), d AS (SELECT ae_a - ae_b AS d FROM losses WHERE ae_a <> ae_b),
r AS (SELECT d, rank() OVER (ORDER BY abs(d)) + (count(*) OVER (PARTITION BY abs(d)) - 1) / 2.0 AS r, count(*) OVER (PARTITION BY abs(d)) AS same FROM d),
w AS (SELECT sum(r) FILTER (WHERE d > 0)::DOUBLE AS w_plus, least(sum(r) FILTER (WHERE d > 0), sum(r) FILTER (WHERE d < 0))::DOUBLE AS w_stat, count(*) AS w_n, sum(same * same - 1) AS ties FROM r),
groups AS (SELECT md / sqrt(lrv / k) * sqrt((k - 1.0) / k) AS dm_stat, k, w.* FROM s, w), tested AS ({_p_values_sql("groups")})
SELECT round(dm_stat, 6) AS dm_stat, dm_p, round(w_stat, 6) AS stat, p_two_sided, p_greater FROM tested""")
def paired_test_p_values(spark, sf):
    dm = stattests.diebold_mariano(_losses(spark, sf)).select("dm_stat", F.col("p_value").alias("dm_p"))
    return dm.crossJoin(stattests.wilcoxon_signed_rank(_losses(spark, sf)).select("stat", "p_two_sided", "p_greater"))


# --- alerts -------------------------------------------------------------------------------------------------------


def _split(spark, sf):
    rows = alerts.add_deviation(I.forecasts(spark, sf).dropna(subset=["actual", "b"]), "actual", "b").select("entity", "date", "deviation")
    return backtest.temporal_split(rows, 0.7)


@query("SELECT entity, date, round(deviation, 6) AS deviation FROM deviations")
def deviation(spark, sf):
    return _split(spark, sf).drop("part")


@query("SELECT date, part, count(*) AS n FROM split GROUP BY 1, 2")
def temporal_split(spark, sf):
    return _split(spark, sf).groupBy("date", "part").agg(F.count("*").alias("n"))


THRESHOLDS = """, thr AS (SELECT entity, p::BIGINT AS percentile, CASE WHEN n >= 5 THEN q ELSE 'inf'::DOUBLE END AS threshold FROM (
  SELECT entity, count(*) FILTER (WHERE deviation > 0) AS n, unnest([50, 55, 60, 65, 70, 75, 80, 85, 90, 95]) AS p,
  unnest(quantile_cont(deviation, [0.5, 0.55, 0.6, 0.65, 0.7, 0.75, 0.8, 0.85, 0.9, 0.95]) FILTER (WHERE deviation > 0)) AS q FROM split WHERE part = 'train' GROUP BY 1)),
cutoff AS (SELECT quantile_cont(deviation, 0.85) AS c FROM split WHERE part = 'test' AND deviation > 0),
test AS (SELECT entity, date, deviation, deviation > c AS true_event FROM split, cutoff WHERE part = 'test'),
conf AS (SELECT percentile, count(*) FILTER (WHERE e AND a) AS tp, count(*) FILTER (WHERE NOT e AND a) AS fp, count(*) FILTER (WHERE e AND NOT a) AS fn, count(*) FILTER (WHERE NOT e AND NOT a) AS tn
  FROM (SELECT p.percentile, t.true_event AS e, coalesce(t.deviation > h.threshold, false) AS a FROM test t CROSS JOIN (SELECT DISTINCT percentile FROM thr) p LEFT JOIN thr h ON h.entity = t.entity AND h.percentile = p.percentile) GROUP BY 1),
shares AS (SELECT *, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) END AS pr, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) END AS re, CASE WHEN tn + fp > 0 THEN tn / (tn + fp) END AS sp FROM conf),
sweep AS (SELECT percentile, tp, fp, fn, tn, round_even(pr, 3) AS "precision", round_even(re, 3) AS recall, round_even(sp, 3) AS specificity, round_even(1 - sp, 3) AS fpr,
  round_even(CASE WHEN pr + re > 0 THEN 2 * pr * re / (pr + re) END, 3) AS f1, round_even(re + sp - 1, 3) AS youden_j, round_even((tp + fn) / (tp + fp + fn + tn), 6) AS prevalence FROM shares),
picked AS (SELECT (SELECT percentile FROM sweep ORDER BY f1 DESC NULLS LAST, percentile LIMIT 1) AS red, (SELECT percentile FROM sweep ORDER BY youden_j DESC NULLS LAST, percentile LIMIT 1) AS best_j),
labels AS (SELECT s.entity, s.date, s.deviation, CASE WHEN s.deviation > r.threshold THEN 'Red' WHEN s.deviation > y.threshold THEN 'Yellow' ELSE 'Green' END AS label
  FROM split s LEFT JOIN thr r ON r.entity = s.entity AND r.percentile = 70 LEFT JOIN thr y ON y.entity = s.entity AND y.percentile = 60)
"""


def _train(spark, sf):
    return _split(spark, sf).where("part = 'train'").drop("part")


def _test(spark, sf):
    return _split(spark, sf).where("part = 'test'").drop("part")


@query(THRESHOLDS + "SELECT entity, percentile, round(threshold, 6) AS threshold FROM thr")
def entity_thresholds(spark, sf):
    return alerts.entity_thresholds(_train(spark, sf))


@query(THRESHOLDS + "SELECT entity, date, round(deviation, 6) AS deviation, true_event FROM test")
def true_events(spark, sf):
    return alerts.true_events(_test(spark, sf))


@query(THRESHOLDS + "SELECT tp, fp, fn, tn, \"precision\", recall, specificity, fpr, f1, youden_j FROM sweep WHERE percentile = 75")
def confusion(spark, sf):
    at = alerts.entity_thresholds(_train(spark, sf), (75,)).select("entity", "threshold")
    rows = alerts.true_events(_test(spark, sf)).join(at, "entity", "left")
    return alerts.confusion(rows.withColumn("alert", F.coalesce(F.col("deviation") > F.col("threshold"), F.lit(False))))


@query(THRESHOLDS + "SELECT * FROM sweep")
def threshold_sweep(spark, sf):
    return alerts.threshold_sweep(_train(spark, sf), _test(spark, sf))


@query(THRESHOLDS + "SELECT red, red - 10 AS yellow, best_j FROM picked")
def pick_thresholds(spark, sf):
    return alerts.pick_thresholds(alerts.threshold_sweep(_train(spark, sf), _test(spark, sf)))


def _labels(spark, sf):
    at = alerts.entity_thresholds(_train(spark, sf), (60, 70))
    return alerts.label_alerts(_split(spark, sf).drop("part"), at.where("percentile = 70"), at.where("percentile = 60"))


@query(THRESHOLDS + "SELECT entity, date, round(deviation, 6) AS deviation, label FROM labels")
def label_alerts(spark, sf):
    return _labels(spark, sf)


@query(THRESHOLDS + "SELECT l AS label, count(x.label) AS n, round_even(100.0 * count(x.label) / (SELECT count(*) FROM labels), 2) AS pct FROM (SELECT unnest(['Green', 'Yellow', 'Red']) AS l) LEFT JOIN labels x ON x.label = l GROUP BY 1")
def label_distribution(spark, sf):
    return alerts.label_distribution(_labels(spark, sf))


@query(THRESHOLDS + "SELECT c.entity, c.date, coalesce(l.label, 'Gray') AS label FROM counts c LEFT JOIN labels l USING (entity, date)")
def lookup_labels(spark, sf):
    return alerts.lookup_labels(I.counts(spark, sf).select("entity", "date"), _labels(spark, sf))


@query("SELECT entity, round(avg(rate), 6) AS baseline FROM (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY date DESC) AS r FROM panel WHERE rate IS NOT NULL) WHERE r <= 12 GROUP BY 1")
def recent_baseline(spark, sf):
    return alerts.recent_baseline(I.panel(spark, sf))


@query(THRESHOLDS + """, base AS (SELECT entity, avg(rate) AS baseline FROM (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY date DESC) AS r FROM panel WHERE rate IS NOT NULL) WHERE r <= 12 AND entity <> 'NATION_3' GROUP BY 1),
pred AS (SELECT entity, arg_max(actual, date) * 1.5 AS predicted FROM forecasts WHERE actual IS NOT NULL GROUP BY 1), dev AS (SELECT p.entity, p.predicted, b.baseline, CASE WHEN b.baseline > 0 THEN (p.predicted - b.baseline) / b.baseline END AS d FROM pred p LEFT JOIN base b USING (entity))
SELECT d.entity, round(d.predicted, 6) AS predicted, round(d.baseline, 6) AS baseline, round(d.d, 6) AS deviation, CASE WHEN d.d IS NULL THEN 'Gray' WHEN d.d > r.threshold THEN 'Red' WHEN d.d > y.threshold THEN 'Yellow' ELSE 'Green' END AS label
FROM dev d LEFT JOIN thr r ON r.entity = d.entity AND r.percentile = 70 LEFT JOIN thr y ON y.entity = d.entity AND y.percentile = 60""")
def label_forecast(spark, sf):
    at = alerts.entity_thresholds(_train(spark, sf), (60, 70))
    predicted = I.forecasts(spark, sf).where("actual is not null").groupBy("entity").agg((F.max_by("actual", "date") * 1.5).alias("predicted"))
    baseline = alerts.recent_baseline(I.panel(spark, sf)).where("entity <> 'NATION_3'")
    return alerts.label_forecast(predicted, baseline, at.where("percentile = 70"), at.where("percentile = 60"))


@query("""SELECT entity, date, round(greatest(b, 0), 6) AS predicted, population, round_even(b * population, 0)::BIGINT AS predicted_apps, round_even(greatest(b - 0.01, 0) * population, 0)::BIGINT AS lower_bound,
round_even((b + 0.01) * population, 0)::BIGINT AS upper_bound FROM forecasts WHERE b IS NOT NULL""")
def with_interval(spark, sf):
    rows = I.forecasts(spark, sf).where("b is not null").select("entity", "date", F.col("b").alias("predicted"), "population")
    return alerts.with_interval(rows, 0.01)


@query(THRESHOLDS + """SELECT l.entity, l.date, coalesce(format('{:,}', c.apps::BIGINT), 'No data') AS shown_count, CASE l.label WHEN 'Red' THEN 'High' WHEN 'Yellow' THEN 'Raised' ELSE l.label END AS shown_label,
concat_ws(' | ', l.entity, strftime(l.date, '%b %Y'), 'count: ' || coalesce(format('{:,}', c.apps::BIGINT), 'No data'), 'population: ' || format('{:,}', p.population::BIGINT), CASE l.label WHEN 'Red' THEN 'High' WHEN 'Yellow' THEN 'Raised' ELSE l.label END) AS hover
FROM labels l JOIN counts c USING (entity, date) JOIN population p USING (entity)""")
def display_columns(spark, sf):
    rows = _labels(spark, sf).join(I.counts(spark, sf), ["entity", "date"])
    return alerts.display_columns(rows, I.population(spark, sf), {"Red": "High", "Yellow": "Raised"}).select("entity", "date", "shown_count", "shown_label", "hover")


# --- audit --------------------------------------------------------------------------------------------------------

IQR = """, q AS (SELECT entity, quantile_cont(apps, 0.25) AS q1, median(apps) AS m, quantile_cont(apps, 0.75) AS q3, count(apps) AS n FROM counts GROUP BY 1),
iqr AS (SELECT c.entity, c.date, c.apps AS value, round_even(q.m, 1) AS median, round_even(c.apps / q.m, 2) AS ratio FROM counts c JOIN q USING (entity) WHERE q.n >= 4 AND (c.apps < q1 - 1.0 * (q3 - q1) OR c.apps > q3 + 1.0 * (q3 - q1)))
"""


@query("""SELECT 'apps' AS "column", count(*) FILTER (WHERE apps IS NULL) AS n_null, round_even(100.0 * count(*) FILTER (WHERE apps IS NULL) / count(*), 2) AS pct, CASE WHEN 100.0 * count(*) FILTER (WHERE apps IS NULL) / count(*) > 20 THEN 'ERROR' WHEN count(*) FILTER (WHERE apps IS NULL) > 0 THEN 'WARNING' ELSE 'OK' END AS severity FROM panel
UNION ALL SELECT 'market', count(*) FILTER (WHERE market IS NULL), round_even(100.0 * count(*) FILTER (WHERE market IS NULL) / count(*), 2), 'OK' FROM panel""")
def audit_missing(spark, sf):
    return audit.audit_missing(I.panel(spark, sf), ["apps", "market"])


@query("SELECT entity, count(*) AS n_rows, count(*) FILTER (WHERE apps IS NULL) + count(*) FILTER (WHERE rate IS NULL) AS n_null, round_even(100.0 * (2 * count(*) FILTER (WHERE apps IS NULL)) / (2 * count(*)), 2) AS pct FROM panel GROUP BY 1 HAVING count(*) FILTER (WHERE apps IS NULL) > 0")
def audit_incomplete(spark, sf):
    return audit.audit_incomplete(I.panel(spark, sf), ["apps", "rate"])


@query("SELECT l_returnflag, l_linestatus, l_quantity, l_discount, count(*) AS n_copies FROM lineitem GROUP BY 1, 2, 3, 4 HAVING count(*) > 1")
def duplicate_rows(spark, sf):
    return audit.duplicate_rows(table(spark, sf, "lineitem").select("l_returnflag", "l_linestatus", "l_quantity", "l_discount"))


@query("SELECT o_orderkey, o_custkey, o_orderdate::DATE AS date, n_rows FROM (SELECT *, count(*) OVER (PARTITION BY o_custkey, o_orderdate::DATE) AS n_rows FROM orders) WHERE n_rows > 1")
def duplicate_keys(spark, sf):
    rows = table(spark, sf, "orders").select("o_orderkey", "o_custkey", F.col("o_orderdate").cast("date").alias("date"))
    return audit.duplicate_keys(rows, ["o_custkey", "date"])


@query("""SELECT entity, min(date) AS first_date, max(date) AS last_date, count(DISTINCT date) AS n_months, e AS expected, e - count(DISTINCT date) AS missing, round_even(100.0 * count(DISTINCT date) / e, 2) AS pct
FROM rates, (SELECT datediff('month', min(date), max(date)) + 1 AS e FROM rates) GROUP BY entity, e""")
def audit_coverage(spark, sf):
    return audit.audit_coverage(I.rates(spark, sf))


@query("SELECT entity, date, previous, date - previous AS days FROM (SELECT entity, date, lag(date) OVER (PARTITION BY entity ORDER BY date) AS previous FROM counts WHERE apps IS NOT NULL) WHERE date - previous NOT BETWEEN 28 AND 32")
def audit_gaps(spark, sf):
    return audit.audit_gaps(I.counts(spark, sf).where("apps is not null"))


@query("SELECT entity, date, previous, date - previous AS days FROM (SELECT entity, date, lag(date) OVER (PARTITION BY entity ORDER BY date) AS previous FROM counts WHERE apps IS NOT NULL) WHERE date - previous NOT BETWEEN 28 AND 32")
def audit_long_gaps(spark, sf):
    return long_series.audit_gaps(I.counts(spark, sf).where("apps is not null"), parts=60)


@query("""SELECT 'unmapped' AS kind, 'NATION_3' AS entity UNION ALL SELECT 'unused', 'NOWHERE' UNION ALL SELECT 'conflict', 'NATION_3' UNION SELECT DISTINCT 'conflict', entity FROM panel WHERE market = 'EUROPE'""")
def audit_mapping(spark, sf):
    mapping = I.markets(spark, sf).where("entity <> 'NATION_3'").withColumn("market", F.when(F.col("market") == "EUROPE", "OTHER").otherwise(F.col("market")))
    extra = mapping.limit(1).select(F.lit("NOWHERE").alias("entity"), "market")
    return audit.audit_mapping(I.panel(spark, sf), mapping.unionByName(extra))


@query(IQR + "SELECT * FROM iqr")
def audit_outliers_iqr(spark, sf):
    return audit.audit_outliers_iqr(I.counts(spark, sf), "apps", factor=1.0)


@query("SELECT entity, date, round(revenue, 6) AS value, round((revenue - m) / s, 6) AS z FROM order_counts, (SELECT avg(revenue) AS m, stddev_samp(revenue) AS s FROM order_counts) WHERE abs((revenue - m) / s) > 2.0")
def audit_outliers_z(spark, sf):
    return audit.audit_outliers_z(I.order_counts(spark, sf), "revenue", 2.0)


@query("""SELECT 'negative' AS kind, c_mktsegment AS entity, count(*) AS n FROM customer WHERE c_acctbal < 0 GROUP BY 2 UNION ALL SELECT 'several_constants', c_mktsegment, count(DISTINCT c_nationkey) FROM customer GROUP BY 2 HAVING count(DISTINCT c_nationkey) > 1
UNION ALL SELECT 'no_constant', c_mktsegment, count(*) FROM customer WHERE c_nationkey <= 0 GROUP BY 2 UNION ALL SELECT 'zero', c_mktsegment, count(*) FROM customer WHERE c_acctbal = 0 GROUP BY 2""")
def audit_values(spark, sf):
    return audit.audit_values(table(spark, sf, "customer").withColumnRenamed("c_mktsegment", "entity"), "c_acctbal", "c_nationkey")


@query("""SELECT concat(' ', entity, ' County') AS entity, n_suppressed, n_rows, round_even(100.0 * n_suppressed / n_rows, 2) AS pct, round_even(100.0 * sum(n_suppressed) OVER () / total, 2) AS overall_pct
FROM (SELECT entity, count(*) FILTER (WHERE apps IS NULL) AS n_suppressed, count(*) AS n_rows FROM counts GROUP BY 1), (SELECT count(*) AS total FROM counts) WHERE n_suppressed > 0""")
def audit_suppressed(spark, sf):
    return audit.audit_suppressed(_raw_counts(spark, sf))


@query("SELECT market, count(DISTINCT entity) AS n_entities FROM markets GROUP BY 1")
def entities_per_market(spark, sf):
    return audit.entities_per_market(I.markets(spark, sf))


@query("SELECT entity, n_null FROM (SELECT entity, count(*) FILTER (WHERE apps IS NULL) AS n_null FROM counts GROUP BY 1) ORDER BY n_null DESC, entity LIMIT 5")
def top_k(spark, sf):
    return audit.top_k(I.counts(spark, sf).groupBy("entity").agg(F.count_if(F.col("apps").isNull()).alias("n_null")), 5, "n_null", "entity")


@query("SELECT entity, date, apps FROM (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY date DESC) AS r FROM counts) WHERE r <= 3")
def latest_n(spark, sf):
    return audit.latest_n(I.counts(spark, sf), 3)


ISSUES = """, q AS (SELECT entity, quantile_cont(apps, 0.25) AS q1, quantile_cont(apps, 0.75) AS q3, count(apps) AS n FROM panel GROUP BY 1), z AS (SELECT avg(rate) AS m, stddev_samp(rate) AS s FROM panel),
e AS (SELECT datediff('month', min(date), max(date)) + 1 AS e FROM panel),
found AS (
  SELECT CASE WHEN round_even(100.0 * n / t, 2) > 20 THEN 'ERROR' ELSE 'WARNING' END AS severity, 'missing' AS category, 'null_share' AS "check", c AS entity, round_even(100.0 * n / t, 2)::VARCHAR || ' % null' AS detail, n::DOUBLE AS value FROM (SELECT unnest(['apps', 'rate']) AS c, count(*) FILTER (WHERE apps IS NULL) AS n, count(*) AS t FROM panel) WHERE n > 0
  UNION ALL SELECT 'WARNING', 'coverage', 'missing_months', entity, (e - count(DISTINCT date))::VARCHAR || ' months missing', (e - count(DISTINCT date))::DOUBLE FROM panel, e GROUP BY entity, e HAVING e > count(DISTINCT date)
  UNION ALL SELECT 'WARNING', 'coverage', 'date_gap', entity, (date - p)::VARCHAR || ' days before ' || strftime(date, '%Y-%m-%d'), (date - p)::DOUBLE FROM (SELECT entity, date, lag(date) OVER (PARTITION BY entity ORDER BY date) AS p FROM panel) WHERE date - p NOT BETWEEN 28 AND 32
  UNION ALL SELECT 'WARNING', 'outliers', 'applications_iqr', entity, strftime(date, '%Y-%m-%d'), apps FROM panel JOIN q USING (entity) WHERE n >= 4 AND (apps < q1 - 3 * (q3 - q1) OR apps > q3 + 3 * (q3 - q1))
  UNION ALL SELECT 'WARNING', 'outliers', 'rate_zscore', entity, strftime(date, '%Y-%m-%d'), round_even(rate, 6) FROM panel, z WHERE abs((rate - m) / s) > 4
  UNION ALL SELECT 'WARNING', 'missing', 'incomplete_entity', entity, round_even(100.0 * n / k, 2)::VARCHAR || ' % of cells null', n::DOUBLE FROM (SELECT entity, count(*) FILTER (WHERE apps IS NULL) + count(*) FILTER (WHERE rate IS NULL) AS n, 2 * count(*) AS k FROM panel GROUP BY 1) WHERE n > 0
  UNION ALL SELECT 'WARNING', 'raw_sources', 'suppressed', ' ' || entity || ' County', n || ' suppressed of ' || k, n::DOUBLE FROM (SELECT entity, count(*) FILTER (WHERE apps IS NULL) AS n, count(*) AS k FROM counts GROUP BY 1) WHERE n > 0
  UNION ALL SELECT 'WARNING', 'raw_sources', 'unparseable', entity, 'about ' || population, NULL FROM population WHERE population % 7 = 0)
"""


@query(ISSUES + "SELECT * FROM found")
def audit_all(spark, sf):
    return audit.audit_all(I.panel(spark, sf), I.markets(spark, sf), raw=_raw_counts(spark, sf), dimension=_raw_dimension(spark, sf))


def _raw_dimension(spark, sf):
    """Dimensions as text, some of which are no numbers."""
    text = F.when(F.col("population") % 7 == 0, F.concat(F.lit("about "), F.col("population"))).otherwise(F.format_number("population", 0))
    return I.population(spark, sf).select("entity", text.alias("income"))


@query("SELECT entity, 'about ' || population AS text FROM population WHERE population % 7 = 0")
def audit_unparseable(spark, sf):
    return audit.audit_unparseable(_raw_dimension(spark, sf), "income")


@query(ISSUES + "SELECT severity, category, count(*) AS n FROM found GROUP BY 1, 2")
def audit_summary(spark, sf):
    return audit.audit_summary(audit_all(spark, sf))


# --- back-tests ---------------------------------------------------------------------------------------------------


def _regression_panel(spark, sf):
    return I.forecasts(spark, sf).dropna(subset=["actual", "a", "b"])


def _ols_sql(gap: int) -> str:
    return f""", p AS (SELECT * FROM forecasts WHERE actual IS NOT NULL AND a IS NOT NULL AND b IS NOT NULL), origins AS (SELECT DISTINCT date AS origin FROM p),
fits_{gap} AS (SELECT o.origin, count(*) AS n, CASE WHEN count(*) * sum(a * a) - sum(a) * sum(a) > 0 THEN (count(*) * sum(a * actual) - sum(a) * sum(actual)) / (count(*) * sum(a * a) - sum(a) * sum(a)) ELSE 0 END AS slope, sum(actual) AS sy, sum(a) AS sx
  FROM origins o JOIN p ON p.date < o.origin - INTERVAL {gap} MONTH GROUP BY 1 HAVING count(DISTINCT p.date) >= 12 AND count(*) >= 10),
preds_{gap} AS (SELECT p.entity, p.date, greatest((f.sy - f.slope * f.sx) / f.n + f.slope * p.a, 0) AS predicted, p.actual FROM p JOIN fits_{gap} f ON p.date = f.origin)
"""


@query(", p AS (SELECT * FROM forecasts WHERE actual IS NOT NULL AND a IS NOT NULL AND b IS NOT NULL) SELECT o.origin, t.n_train, o.n_test FROM (SELECT date AS origin, count(*) AS n_test FROM p GROUP BY 1) o JOIN LATERAL (SELECT count(*) AS n_train, count(DISTINCT date) AS k FROM p WHERE p.date < o.origin - INTERVAL 3 MONTH) t ON t.k >= 12")
def walk_forward_folds(spark, sf):
    return backtest.walk_forward_folds(_regression_panel(spark, sf), gap=3)


@query("SELECT date AS origin, count(*) AS n, round(sum(a), 6) AS sx, round(sum(actual), 6) AS sy, round(sum(a * a), 6) AS sxx, round(sum(a * actual), 6) AS sxy FROM forecasts WHERE actual IS NOT NULL AND a IS NOT NULL GROUP BY 1")
def gram_by_month(spark, sf):
    return backtest.gram_by_month(I.forecasts(spark, sf), "a", "actual")


for _gap in (0, 6):
    query(_ols_sql(_gap) + f"SELECT entity, date, round(predicted, 6) AS predicted, round(actual, 6) AS actual FROM preds_{_gap}", f"walk_forward_ols_gap{_gap}")(lambda spark, sf, g=_gap: backtest.walk_forward_ols(_regression_panel(spark, sf), "a", "actual", g))


@query(_ols_sql(0) + "SELECT entity, date, 0::BIGINT AS gap, round(predicted, 4) AS predicted, round(actual, 6) AS actual FROM preds_0")
def walk_forward(spark, sf):
    return backtest.walk_forward(_regression_panel(spark, sf), ["a"], "actual", penalty=0.0).withColumn("predicted", F.round("predicted", 4))


@query("SELECT entity, date, round(actual, 6) AS actual, round(a, 6) AS predicted_a, round(b, 6) AS predicted_b FROM forecasts WHERE actual IS NOT NULL AND a IS NOT NULL AND b IS NOT NULL")
def align_predictions(spark, sf):
    f = I.forecasts(spark, sf)
    return backtest.align_predictions(f.select("entity", "date", "actual", F.col("a").alias("predicted")), f.select("entity", "date", "actual", F.col("b").alias("predicted")))


COMPARED = LOSSES + """, p AS (SELECT * FROM forecasts WHERE actual IS NOT NULL AND a IS NOT NULL AND b IS NOT NULL),
m AS (SELECT count(*) AS n, 1 - sum((actual - a) ** 2) / (var_pop(actual) * count(*)) AS no_r2, 1 - sum((actual - b) ** 2) / (var_pop(actual) * count(*)) AS with_r2, avg(abs(actual - a)) AS no_mae, avg(abs(actual - b)) AS with_mae,
  avg(200 * abs(actual - a) / nullif(abs(actual) + abs(a), 0)) AS no_smape, avg(200 * abs(actual - b) / nullif(abs(actual) + abs(b), 0)) AS with_smape FROM p),
c AS (SELECT date, (se_a - se_b) - avg(se_a - se_b) OVER () AS c, se_a - se_b AS d FROM losses), g AS (SELECT *, c * lag(c) OVER (ORDER BY date) AS c1 FROM c),
s AS (SELECT count(*) AS k, avg(d) AS md, sum(c * c) / count(*) + sum(c1) / count(*) AS lrv FROM g),
d AS (SELECT ae_a - ae_b AS d FROM losses WHERE ae_a <> ae_b), r AS (SELECT d, rank() OVER (ORDER BY abs(d)) + (count(*) OVER (PARTITION BY abs(d)) - 1) / 2.0 AS r FROM d)
SELECT 0::BIGINT AS gap, n, round(no_r2, 6) AS no_r2, round(no_mae, 6) AS no_mae, round(no_smape, 6) AS no_smape, round(with_r2, 6) AS with_r2, round(with_mae, 6) AS with_mae, round(with_smape, 6) AS with_smape,
  round(with_r2 - no_r2, 6) AS delta_r2, round(with_mae - no_mae, 6) AS delta_mae, round(with_smape - no_smape, 6) AS delta_smape, k AS n_months, round(md / sqrt(lrv / k) * sqrt((k - 1.0) / k), 6) AS dm_stat,
  (SELECT round(sum(r) FILTER (WHERE d > 0), 6)::DOUBLE FROM r) AS w_plus, (SELECT round(least(sum(r) FILTER (WHERE d > 0), sum(r) FILTER (WHERE d < 0)), 6)::DOUBLE FROM r) AS wilcoxon_stat FROM m, s"""


@query(COMPARED)
def gap_comparison(spark, sf):
    f = I.forecasts(spark, sf)
    aligned = backtest.align_predictions(f.select("entity", "date", "actual", F.col("a").alias("predicted")), f.select("entity", "date", "actual", F.col("b").alias("predicted")))
    return backtest.gap_comparison(aligned.withColumn("gap", F.lit(0)), p_value=False)


BASE, WITH = ["a"], ["a", "b"]


def _sweep_sql(gaps, smape: str, where: str = "true") -> str:
    """compared(gap, ...): ridge on a, and on a and b, for every gap, by the closed form of the standardised normal equations."""
    return f""", p AS (SELECT * FROM forecasts WHERE actual IS NOT NULL AND a IS NOT NULL AND b IS NOT NULL), origins AS (SELECT DISTINCT date AS origin FROM p), gaps AS (SELECT unnest({list(gaps)}) AS gap),
sums AS (SELECT gap, o.origin, avg(a) AS ma, avg(b) AS mb, avg(actual) AS my, stddev_pop(a) AS sa, stddev_pop(b) AS sb, covar_pop(a, b) AS cab, covar_pop(a, actual) AS cay, covar_pop(b, actual) AS cby
  FROM gaps, origins o JOIN p ON p.date < o.origin - to_months(gap) GROUP BY 1, 2 HAVING count(DISTINCT p.date) >= 12 AND count(*) >= 10),
k AS (SELECT *, 1 + 1e-6 AS d, cab / sa / sb AS r, cay / sa AS xa, cby / sb AS xb FROM sums),
f AS (SELECT *, xa / d / sa AS w1, (d * xa - r * xb) / (d * d - r * r) / sa AS wa, (d * xb - r * xa) / (d * d - r * r) / sb AS wb FROM k),
aligned AS (SELECT gap, entity, date, actual, greatest(my + w1 * (a - ma), 0) AS pa, greatest(my + wa * (a - ma) + wb * (b - mb), 0) AS pb FROM p JOIN f ON p.date = f.origin WHERE {where}),
m AS (SELECT gap, count(*) AS n, 1 - sum((actual - pa) ** 2) / (var_pop(actual) * count(*)) AS no_r2, 1 - sum((actual - pb) ** 2) / (var_pop(actual) * count(*)) AS with_r2, avg(abs(actual - pa)) AS no_mae, avg(abs(actual - pb)) AS with_mae,
  avg({smape.format("pa")}) AS no_smape, avg({smape.format("pb")}) AS with_smape FROM aligned GROUP BY 1),
paired AS (SELECT gap, date, avg((actual - pa) ** 2) - avg((actual - pb) ** 2) AS d2, avg(abs(actual - pa)) - avg(abs(actual - pb)) AS d1 FROM aligned GROUP BY 1, 2),
c AS (SELECT gap, date, d2, d2 - avg(d2) OVER (PARTITION BY gap) AS c FROM paired), g AS (SELECT *, c * lag(c) OVER (PARTITION BY gap ORDER BY date) AS c1 FROM c),
dm AS (SELECT gap, count(*) AS k, avg(d2) AS md, sum(c * c) / count(*) + sum(c1) / count(*) AS lrv FROM g GROUP BY 1),
r AS (SELECT gap, d1, rank() OVER (PARTITION BY gap ORDER BY abs(d1)) + (count(*) OVER (PARTITION BY gap, abs(d1)) - 1) / 2.0 AS r FROM paired WHERE d1 <> 0),
w AS (SELECT gap, coalesce(sum(r) FILTER (WHERE d1 > 0), 0) AS w_plus, coalesce(sum(r) FILTER (WHERE d1 < 0), 0) AS w_minus FROM r GROUP BY 1),
compared AS (SELECT m.gap::BIGINT AS gap, n, no_r2, no_mae, no_smape, with_r2, with_mae, with_smape, with_r2 - no_r2 AS delta_r2, with_mae - no_mae AS delta_mae, with_smape - no_smape AS delta_smape,
  k AS n_months, md / sqrt(lrv / k) * sqrt((k - 1.0) / k) AS dm_stat, w_plus::DOUBLE AS w_plus, least(w_plus, w_minus)::DOUBLE AS wilcoxon_stat FROM m JOIN dm USING (gap) JOIN w USING (gap))
"""


_SWEPT = "SELECT gap, n, n_months, " + ", ".join(f"round({c}, 6) AS {c}" for c in ("no_r2", "no_mae", "no_smape", "with_r2", "with_mae", "with_smape", "delta_r2", "delta_mae", "delta_smape", "dm_stat", "w_plus", "wilcoxon_stat")) + " FROM compared"
_DROPPED, _DAMPED = "200 * abs(actual - {0}) / nullif(abs(actual) + abs({0}), 0)", "200 * abs(actual - {0}) / (abs(actual) + abs({0}) + 1e-9)"


def _swept(spark, sf):
    return backtest.gap_predictions(_regression_panel(spark, sf), BASE, WITH, "actual")


@query(_sweep_sql(range(13), _DROPPED) + _SWEPT)
def gap_sweep(spark, sf):
    return backtest.gap_comparison(_swept(spark, sf), p_value=False)


@query(_sweep_sql(range(13), _DROPPED) + f""", {special.WAYS_SQL}, same AS (SELECT gap, abs(d1) AS d, count(*) AS n FROM paired WHERE d1 <> 0 GROUP BY 1, 2), tied AS (SELECT gap, sum(n) AS w_n, sum(n * n * n - n) AS ties FROM same GROUP BY 1),
groups AS (SELECT gap, dm_stat, n_months AS k, w_plus, w_n, ties FROM compared JOIN tied USING (gap)) SELECT gap, dm_p, p_two_sided, p_greater FROM ({_p_values_sql("groups")})""")
def gap_sweep_p_values(spark, sf):
    return backtest.gap_comparison(_swept(spark, sf)).select("gap", "dm_p", "p_two_sided", "p_greater")


@query(_sweep_sql(range(13), _DROPPED) + "SELECT count(*) AS n, round(corr(x, y), 6) AS rho, round(avg(delta_r2), 6) AS mean_delta_r2 FROM (SELECT *, rank() OVER (ORDER BY gap) AS x, rank() OVER (ORDER BY delta_r2) AS y FROM compared)")
def gap_trend(spark, sf):
    return backtest.gap_trend(backtest.gap_comparison(_swept(spark, sf), p_value=False), p_value=False)


@query(_sweep_sql([0], _DAMPED, "date NOT BETWEEN DATE '1998-01-01' AND DATE '1998-06-01'") + _SWEPT)
def ablation(spark, sf):
    return backtest.ablation(_regression_panel(spark, sf), BASE, WITH, "actual", ("1998-01-01", "1998-06-01"), p_value=False)


@query(None)
def tune_ridge(spark, sf):
    return backtest.tune(_regression_panel(spark, sf), WITH, "actual")


@query(None)
def tune(spark, sf):
    searched = boosting.SEARCHED | {"trees": (9, 27), "depth": (2, 4)}
    return boosting.tune(_training_rows(spark, sf), FEATURES, "rate", searched=searched, steps=(3, 1, 0.02))


_PENALTIES = (1e-6, 0.01, 0.1, 1.0, 10.0)


@query(f""", p AS (SELECT * FROM forecasts WHERE actual IS NOT NULL AND a IS NOT NULL AND b IS NOT NULL), dates AS (SELECT date, row_number() OVER (ORDER BY date) AS r, count(*) OVER () AS n FROM (SELECT DISTINCT date FROM p)),
parts AS (SELECT p.*, r <= floor(n * 0.78) AS training FROM p JOIN dates USING (date)), t AS (SELECT avg(a) AS ma, avg(actual) AS my, covar_pop(a, actual) / var_pop(a) AS slope FROM parts WHERE training),
c AS (SELECT unnest(range({len(_PENALTIES)})) AS candidate, unnest({list(_PENALTIES)}::DOUBLE[]) AS penalty)
SELECT candidate, round(penalty, 6) AS penalty, round(avg(abs(greatest(my + slope / (1 + penalty) * (a - ma), 0) - actual)), 6) AS mae FROM c, t, parts WHERE NOT training GROUP BY 1, 2 ORDER BY avg(abs(greatest(my + slope / (1 + penalty) * (a - ma), 0) - actual)), 1 LIMIT 1""")
def pick_candidate(spark, sf):
    return backtest.pick_candidate(backtest.score_penalties(_regression_panel(spark, sf), ["a"], "actual", _PENALTIES))


#: The production settings with fewer and shallower trees, and a rate to match, so that the queries end soon.
SETTINGS = replace(boosting.PRODUCTION, trees=20, depth=4, rate=0.2)


@query(None)
def train_and_predict_trees(spark, sf):
    rows = _training_rows(spark, sf)
    model = boosting.train(rows, FEATURES, "rate", SETTINGS)
    return rows.select("entity", "date", F.col("rate").alias("actual"), model.column().alias("predicted"))


@query(None)
def train_and_predict(spark, sf):
    rows = _training_rows(spark, sf)
    model = backtest.train_regressor(rows, FEATURES, "rate")
    return backtest.predict(model, rows, FEATURES).select("entity", "date", F.col("rate").alias("actual"), "predicted")


@query(None)
def feature_importance(spark, sf):
    return backtest.feature_importance(backtest.train_regressor(_training_rows(spark, sf), FEATURES, "rate"), FEATURES, spark)


@query(None)
def feature_importance_trees(spark, sf):
    return spark.createDataFrame(boosting.train(_training_rows(spark, sf), FEATURES, "rate", SETTINGS).importance(), "feature string, importance double")


@query(None)
def walk_forward_trees(spark, sf):
    return boosting.walk_forward(_training_rows(spark, sf), FEATURES, "rate", settings=SETTINGS)


#: One cut of the calendar months for each origin; with all values as bins, SQL finds the same.
STUMP = boosting.Settings(trees=1, depth=1, rate=0.5, subsample=1.0, l1=0.02, l2=1.5, min_weight=4)
_SHRUNK = f"sign({{0}}) * greatest(abs({{0}}) - {STUMP.l1}, 0)"


@query(f""", p AS (SELECT entity, date, month(date) AS x, actual AS y FROM forecasts WHERE actual IS NOT NULL AND a IS NOT NULL AND b IS NOT NULL), gaps AS (SELECT unnest([0, 3]) AS gap),
known AS (SELECT gap, o.date AS origin, p.date, x, y FROM gaps, (SELECT DISTINCT date FROM p) o JOIN p ON p.date < o.date - to_months(gap)),
bases AS (SELECT gap, origin, avg(y) AS base FROM known GROUP BY 1, 2 HAVING count(DISTINCT date) >= 12 AND count(*) >= 10),
bins AS (SELECT gap, origin, base, x, sum(base - y) AS g, count(*) AS h FROM known JOIN bases USING (gap, origin) GROUP BY ALL),
cuts AS (SELECT *, sum(g) OVER w AS gl, sum(h) OVER w AS hl, sum(g) OVER t - sum(g) OVER w AS gr, sum(h) OVER t - sum(h) OVER w AS hr FROM bins
  WINDOW w AS (PARTITION BY gap, origin ORDER BY x), t AS (PARTITION BY gap, origin)),
gains AS (SELECT *, (({_SHRUNK.format("gl")}) ** 2 / (hl + {STUMP.l2}) + ({_SHRUNK.format("gr")}) ** 2 / (hr + {STUMP.l2}) - ({_SHRUNK.format("(gl + gr)")}) ** 2 / (hl + hr + {STUMP.l2})) / 2 AS gain FROM cuts WHERE hl >= {STUMP.min_weight} AND hr >= {STUMP.min_weight}),
best AS (SELECT * FROM gains QUALIFY row_number() OVER (PARTITION BY gap, origin ORDER BY round(gain, 12) DESC, x) = 1)
SELECT entity, date, b.gap::BIGINT AS gap, round(greatest(b.base + CASE WHEN gain > 1e-12 THEN CASE WHEN p.x <= b.x THEN -({_SHRUNK.format("gl")}) / (hl + {STUMP.l2}) ELSE -({_SHRUNK.format("gr")}) / (hr + {STUMP.l2}) END * {STUMP.rate}
  ELSE -({_SHRUNK.format("(gl + gr)")}) / (hl + hr + {STUMP.l2}) * {STUMP.rate} END, 0), 6) AS predicted, round(y, 6) AS actual FROM p JOIN best b ON p.date = b.origin""")
def walk_forward_stump(spark, sf):
    rows = _regression_panel(spark, sf).withColumn("x", F.month("date"))
    return boosting.walk_forward(rows, ["x"], "actual", (0, 3), STUMP)


@query(None)
def gap_sweep_trees(spark, sf):
    """The comparison with and without the signals at gaps of 0, 6 and 12 months, by trees."""
    base = [f for f in FEATURES if f.split("_")[0] not in I.KEYWORDS]
    found = written(boosting.walk_forward(_training_rows(spark, sf), FEATURES, "rate", (0, 6, 12), replace(SETTINGS, trees=5, depth=3, rate=0.3), sets={"a": base, "b": FEATURES}))
    a, b = (found.where(F.col("features") == x) for x in "ab")
    return backtest.gap_comparison(backtest.align_predictions(a, b, ("gap", "entity", "date")))


@query(None)
def tree_bundle(spark, sf):
    """The production model saved, read again, and applied."""
    rows, folder = _training_rows(spark, sf), _folder(spark)
    model = boosting.train(rows, FEATURES, "rate", replace(SETTINGS, trees=8))
    sinks.save_tree_bundle(model, folder, features.feature_ranges(rows, FEATURES), 0.0)
    again, meta, ranges = sinks.load_tree_bundle(spark, folder)
    both = rows.select("entity", "date", model.column().alias("saved"), again.column().alias("loaded"))
    return both.withColumn("features", F.lit(len(meta["features"]))).withColumn("ranges", F.lit(ranges.count()))


# --- forecast -----------------------------------------------------------------------------------------------------


TARGET_MONTH, LAST_MONTH = "2001-07-01", "2001-06-01"
#: All features of forecast_rows().
FEATURES = [
    "population", "income", *[f"{k}_{x}" for k in I.KEYWORDS for x in ("lag1", "lag2", "roll3", "momentum")], "unemployment_rate", "unemployment_rate_lag1",
    "month_sin", "month_cos", "quarter", "month", "log_population", "log_income",
]


class _Facts(NamedTuple):
    """What models and forecasts are made from: a row for each entity or series, and month, whatever the number of rows that they sum up."""

    markets: DataFrame
    counts: DataFrame
    population: DataFrame
    rates: DataFrame
    monthly: DataFrame


def _facts(spark, sf) -> _Facts:
    """Each is summed up once and written, as training and forecast read them up to three times each."""
    return _Facts(*[written(rows) for rows in (I.markets(spark, sf), I.counts(spark, sf), I.population(spark, sf), I.rates(spark, sf), _monthly(spark, sf))])


def _training_rows(spark, sf, facts: _Facts | None = None):
    """The panel before the target month with all features, complete rows only."""
    facts = facts or _facts(spark, sf)
    rows = _assembled(facts.counts, facts.markets, facts.monthly, facts.population).withColumnsRenamed({f"signal_{k}": k for k in I.KEYWORDS})
    rows = features.add_momentum(features.add_rolling(features.add_lags(rows, I.KEYWORDS), I.KEYWORDS), I.KEYWORDS)
    rows = features.add_seasonality(panels.join_lagged_rate(rows, facts.rates))
    rows = features.add_logs(rows, {"population": "log_population", "income": "log_income"})
    return written(rows.where(F.col("date") < F.lit(TARGET_MONTH).cast("date")).dropna(subset=[*FEATURES, "rate"]).select("entity", "date", "rate", *FEATURES))


def _recent_signals(facts: _Facts):
    """History up to the last month, its latest twelve months rescaled to the average of those before."""
    monthly = facts.monthly.where(F.col("month") <= F.lit(LAST_MONTH).cast("date"))
    recent = F.col("month") > F.add_months(F.lit(LAST_MONTH).cast("date"), -12)
    scaled = signals.scale_prediction(monthly.where(recent), signals.scaling_params(monthly.where(~recent))).withColumnRenamed("scaled", "value")
    return signals.combine_history(monthly.withColumnRenamed("avg_value", "value"), scaled, LAST_MONTH)


def _forecast_rows(facts: _Facts, series=None):
    if series is None:
        series = facts.monthly.withColumnRenamed("avg_value", "value").where("month <= date'2001-06-01'")
    dims = facts.markets.join(facts.population, "entity")
    return forecast.forecast_rows(dims, series, facts.rates, I.panel_of(facts.counts, facts.markets, facts.population), "2001-07-01", I.KEYWORDS)


@query(""", wm AS (SELECT keyword, market, date_trunc('month', date)::DATE AS month, avg(value) AS v FROM weekly GROUP BY 1, 2, 3 HAVING month <= DATE '2001-06-01'),
x AS (SELECT keyword, market, v, row_number() OVER (PARTITION BY keyword, market ORDER BY month DESC) AS r FROM wm),
s AS (SELECT market, """ + ", ".join(f"max(v) FILTER (WHERE keyword = '{k}' AND r = 1) AS {k}_1, max(v) FILTER (WHERE keyword = '{k}' AND r = 2) AS {k}_2, avg(v) FILTER (WHERE keyword = '{k}' AND r <= 3) AS {k}_3, count(v) FILTER (WHERE keyword = '{k}' AND r <= 3) AS {k}_n" for k in I.KEYWORDS) + """ FROM x GROUP BY 1),
u AS (SELECT entity, arg_max(rate, date) FILTER (WHERE date <= DATE '2001-06-01') AS u1, arg_max(rate, date) FILTER (WHERE date <= DATE '2001-05-01') AS u2 FROM rates GROUP BY 1)
SELECT m.entity, m.market, """ + ", ".join(f"round({k}_1, 6) AS \"{k}_lag1\", round({k}_2, 6) AS \"{k}_lag2\", round(CASE WHEN {k}_n >= 2 THEN {k}_3 END, 6) AS \"{k}_roll3\", round({k}_1 - {k}_2, 6) AS \"{k}_momentum\"" for k in I.KEYWORDS) + """,
round(u1, 6) AS unemployment_rate, round(u2, 6) AS unemployment_rate_lag1, round(log10(population), 6) AS log_population, round(log10(greatest(income, 1)), 6) AS log_income
FROM markets m JOIN population USING (entity) LEFT JOIN s ON s.market = m.market LEFT JOIN u ON u.entity = m.entity""")
def forecast_rows(spark, sf):
    return _forecast_rows(_facts(spark, sf)).drop("date", "month", "quarter", "month_sin", "month_cos", "population", "income")


@query("""SELECT h.entity, h.date, h.apps, DATE '2001-07-01' AS next_month, f.n AS next_count, CASE WHEN f.n IS NULL THEN 'No data' ELSE format('{:,}', f.n) END AS shown_next FROM counts h
LEFT JOIN (SELECT entity, (1000 * n_orders)::BIGINT AS n FROM order_counts WHERE date = DATE '2001-07-01') f USING (entity)""")
def attach_forecast(spark, sf):
    ahead = I.order_counts(spark, sf).where("date = date'2001-07-01'").select(F.concat("entity", F.lit(" County")).alias("entity"), "date", (F.col("n_orders") * 1000).alias("predicted_applications"))
    shown = alerts.attach_forecast(I.counts(spark, sf), ahead).select("entity", "date", "apps", "next_count", "shown_next")
    return shown.withColumn("next_month", F.lit("2001-07-01").cast("date"))


_FORECAST = replace(SETTINGS, trees=10)


def _band(rows: DataFrame) -> float:
    """The mean error of the walk-forward back-test by trees."""
    return metrics.interval_mae(boosting.walk_forward(rows, FEATURES, "rate", settings=_FORECAST)).first()["mae"]


@query(None)
def forecast_next(spark, sf):
    facts = _facts(spark, sf)
    rows = _training_rows(spark, sf, facts)
    model = backtest.train_regressor(rows, FEATURES, "rate")
    return forecast.forecast_next(model, _forecast_rows(facts, _recent_signals(facts)), FEATURES, _band(rows))


@query(None)
def forecast_next_trees(spark, sf):
    """The band is that of the same trees."""
    facts = _facts(spark, sf)
    rows = _training_rows(spark, sf, facts)
    mae, model = _band(rows), boosting.train(rows, FEATURES, "rate", _FORECAST)
    ahead = _forecast_rows(facts, _recent_signals(facts)).dropna(subset=FEATURES)
    return forecast.scored(ahead.withColumn("predicted", model.column()), mae)
