"""The driver tables in the roles of the panel: counts, markets, dimensions, rates and overlapping signal chunks.

Each table has its SQL counterpart in SQL, a chain of common table expressions that the comparison queries
start with.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from panelkit.functions.columns import month_start
from panelkit.operators.clean import add_rate
from panelkit.session import table

#: Counts below this are suppressed.
SUPPRESSED_BELOW = 4
KEYWORDS = ("A", "N", "R")
#: Days by which a chunk reaches back into the year before.
OVERLAP_DAYS = 35


def markets(spark: SparkSession, sf: str) -> DataFrame:
    """(entity, market)."""
    return table(spark, sf, "nation").join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_name").alias("entity"), F.col("r_name").alias("market"))


def order_counts(spark: SparkSession, sf: str) -> DataFrame:
    """(entity, date, n_orders, revenue) by month."""
    c = table(spark, sf, "customer").join(table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    o = table(spark, sf, "orders").select("o_custkey", "o_orderdate", "o_totalprice")
    rows = o.join(c.select("c_custkey", "n_name"), F.col("o_custkey") == F.col("c_custkey"))
    return rows.groupBy(F.col("n_name").alias("entity"), month_start(F.col("o_orderdate")).alias("date")).agg(F.count("*").alias("n_orders"), F.sum("o_totalprice").alias("revenue"))


def counts(spark: SparkSession, sf: str) -> DataFrame:
    """(entity, date, apps) with small counts suppressed."""
    n = F.col("n_orders")
    return order_counts(spark, sf).select("entity", "date", F.when(n >= SUPPRESSED_BELOW, n.cast("double")).alias("apps"))


def population(spark: SparkSession, sf: str) -> DataFrame:
    """(entity, population, income)."""
    c = table(spark, sf, "customer").join(table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return c.groupBy(F.col("n_name").alias("entity")).agg(F.count("*").alias("population"), F.avg("c_acctbal").alias("income"))


def rates(spark: SparkSession, sf: str) -> DataFrame:
    """(entity, date, rate): a rate by supplier nation and month."""
    s = table(spark, sf, "supplier").join(table(spark, sf, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", F.col("n_name").alias("entity"))
    rows = table(spark, sf, "lineitem").select("l_suppkey", "l_shipdate", "l_discount").join(s, F.col("l_suppkey") == F.col("s_suppkey"))
    return rows.groupBy("entity", month_start(F.col("l_shipdate")).alias("date")).agg((F.avg("l_discount") * 100).alias("rate"))


def weekly(spark: SparkSession, sf: str) -> DataFrame:
    """(keyword, market, date, value): quantity shipped by return flag, supplier region and week."""
    s = table(spark, sf, "supplier").join(table(spark, sf, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    rows = table(spark, sf, "lineitem").select("l_suppkey", "l_shipdate", "l_returnflag", "l_quantity").join(s.select("s_suppkey", "r_name"), F.col("l_suppkey") == F.col("s_suppkey"))
    week = F.trunc("l_shipdate", "WEEK")
    return rows.groupBy(F.col("l_returnflag").alias("keyword"), F.col("r_name").alias("market"), week.alias("date")).agg(F.sum("l_quantity").alias("value"))


def chunks(spark: SparkSession, sf: str) -> DataFrame:
    """(keyword, market, chunk, date, value): a chunk for each year, reaching back OVERLAP_DAYS, scaled to its own highest value 100."""
    w = weekly(spark, sf)
    here = w.select("keyword", "market", F.year("date").cast("string").alias("chunk"), "date", "value")
    after = w.select("keyword", "market", F.year(F.date_add("date", OVERLAP_DAYS)).cast("string").alias("chunk"), "date", "value").where(F.col("chunk") != F.year("date").cast("string"))
    top = F.max("value").over(Window.partitionBy("keyword", "market", "chunk"))
    return here.unionByName(after).withColumn("value", F.round(F.col("value") / top * 100, 0))


def panel_of(counts: DataFrame, markets: DataFrame, population: DataFrame) -> DataFrame:
    """(entity, date, market, apps, population, income, rate): the plain panel, nulls left in."""
    return add_rate(counts.join(markets, "entity").join(population, "entity"))


def panel(spark: SparkSession, sf: str) -> DataFrame:
    """panel_of() the driver tables."""
    return panel_of(counts(spark, sf), markets(spark, sf), population(spark, sf))


def forecasts(spark: SparkSession, sf: str) -> DataFrame:
    """(entity, date, actual, a, b): two forecasts of the rate, the last value and the mean of the last three rows."""
    w = Window.partitionBy("entity").orderBy("date")
    prior = w.rowsBetween(-3, -1)
    rows = panel(spark, sf)
    return rows.select("entity", "date", "market", "population", F.col("rate").alias("actual"), F.lag("rate", 1).over(w).alias("a"), F.when(F.count("rate").over(prior) >= 2, F.avg("rate").over(prior)).alias("b"))


SQL = f"""
WITH markets AS (SELECT n_name AS entity, r_name AS market FROM nation JOIN region ON n_regionkey = r_regionkey),
order_counts AS (
  SELECT n_name AS entity, date_trunc('month', o_orderdate)::DATE AS date, count(*) AS n_orders, sum(o_totalprice) AS revenue
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2),
counts AS (SELECT entity, date, CASE WHEN n_orders >= {SUPPRESSED_BELOW} THEN n_orders::DOUBLE END AS apps FROM order_counts),
population AS (SELECT n_name AS entity, count(*) AS population, avg(c_acctbal) AS income FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1),
rates AS (
  SELECT n_name AS entity, date_trunc('month', l_shipdate)::DATE AS date, avg(l_discount) * 100 AS rate
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey GROUP BY 1, 2),
weekly AS (
  SELECT l_returnflag AS keyword, r_name AS market, date_trunc('week', l_shipdate)::DATE AS date, sum(l_quantity) AS value
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2, 3),
raw_chunks AS (
  SELECT keyword, market, year(date)::VARCHAR AS chunk, date, value FROM weekly
  UNION ALL SELECT keyword, market, year(date + INTERVAL {OVERLAP_DAYS} DAY)::VARCHAR, date, value FROM weekly WHERE year(date + INTERVAL {OVERLAP_DAYS} DAY) <> year(date)),
chunks AS (SELECT keyword, market, chunk, date, round(value / max(value) OVER (PARTITION BY keyword, market, chunk) * 100, 0) AS value FROM raw_chunks),
chunk_order AS (SELECT keyword, market, chunk, row_number() OVER (PARTITION BY keyword, market ORDER BY min(date), chunk) AS seq FROM chunks GROUP BY 1, 2, 3),
sequenced AS (SELECT c.*, o.seq FROM chunks c JOIN chunk_order o USING (keyword, market, chunk)),
ratios AS (
  SELECT a.keyword, a.market, a.seq, count(*) AS n_shared,
         CASE WHEN count(*) < 4 OR avg(a.value) <= 0 THEN 1.0 ELSE avg(b.value) / avg(a.value) END AS ratio
  FROM sequenced a JOIN sequenced b ON a.keyword = b.keyword AND a.market = b.market AND b.seq = a.seq + 1 AND a.date = b.date GROUP BY 1, 2, 3),
scales AS (
  SELECT o.keyword, o.market, o.seq, product(coalesce(r.ratio, 1.0)) OVER (PARTITION BY o.keyword, o.market ORDER BY o.seq DESC ROWS UNBOUNDED PRECEDING) AS scale
  FROM chunk_order o LEFT JOIN ratios r ON o.keyword = r.keyword AND o.market = r.market AND o.seq = r.seq),
newest AS (SELECT s.keyword, s.market, s.date, arg_max(s.value * c.scale, s.seq) AS value FROM sequenced s JOIN scales c USING (keyword, market, seq) GROUP BY 1, 2, 3),
stitched AS (
  SELECT keyword, market, date, CASE WHEN max(value) OVER w > 0 THEN round_even(value / max(value) OVER w * 100, 2) ELSE value END AS value
  FROM newest WINDOW w AS (PARTITION BY keyword, market)),
monthly AS (SELECT keyword, market, date_trunc('month', date)::DATE AS month, avg(value) AS avg_value FROM stitched GROUP BY 1, 2, 3),
params AS (SELECT keyword, market, round_even(avg(avg_value), 4) AS train_avg FROM monthly GROUP BY 1, 2),
panel AS (SELECT c.entity, c.date, m.market, c.apps, p.population, p.income, c.apps / p.population AS rate FROM counts c JOIN markets m USING (entity) JOIN population p USING (entity)),
forecasts AS (
  SELECT entity, date, market, population, rate AS actual, lag(rate) OVER w AS a,
         CASE WHEN count(rate) OVER p >= 2 THEN avg(rate) OVER p END AS b
  FROM panel WINDOW w AS (PARTITION BY entity ORDER BY date), p AS (PARTITION BY entity ORDER BY date ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING)),
deviations AS (SELECT entity, date, (actual - b) / greatest(b, 1e-9) AS deviation FROM forecasts WHERE actual IS NOT NULL AND b IS NOT NULL),
split AS (
  SELECT d.*, CASE WHEN dense_rank() OVER (ORDER BY date) <= floor((SELECT count(DISTINCT date) FROM deviations) * 0.7) THEN 'train' ELSE 'test' END AS part FROM deviations d)
"""
