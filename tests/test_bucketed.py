import uuid

from pyspark.sql import functions as F

from panelkit.plans import registry
from panelkit.sources import sinks

SF = "/root/testdata/sf0.001"


def exchanges(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return [line for line in plan.splitlines() if "Exchange hashpartitioning(entity" in line]


def test_entity_work_over_a_bucketed_panel_needs_no_exchange(spark, tmp_path):
    panel, name, other = registry._whole_panel(spark, SF), f"p_{uuid.uuid4().hex}", f"q_{uuid.uuid4().hex}"
    sinks.write_bucketed(panel, name, str(tmp_path / "a"))
    sinks.write_bucketed(panel.groupBy("entity").agg(F.max("date").alias("date"), F.sum("apps").alias("total")), other, str(tmp_path / "b"))
    assert exchanges(registry._persistence(panel)) and not exchanges(registry._persistence(spark.table(name)))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert not exchanges(spark.table(name).join(spark.table(other).drop("date"), "entity"))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    for t in (name, other):
        spark.sql(f"DROP TABLE {t}")


def test_only_the_given_years_are_replaced(spark, tmp_path):
    rows = spark.createDataFrame([(e, f"{y}-0{m}-01", float(m)) for e in "abc" for y in (1999, 2000) for m in (1, 2)], "entity string, date string, v double").withColumn("date", F.col("date").cast("date"))
    name = f"p_{uuid.uuid4().hex}"
    sinks.write_bucketed(rows, name, str(tmp_path / "t"), buckets=4, years=True)
    kept = {p: p.stat().st_mtime_ns for p in (tmp_path / "t").rglob("year=1999/*.parquet")}
    sinks.replace_years(rows.where("year(date) = 2000 and entity = 'b'").withColumn("v", F.lit(9.0)), name)
    got = sorted((r.entity, str(r.date), r.v) for r in spark.table(name).collect())
    assert got == sorted([(e, f"1999-0{m}-01", float(m)) for e in "abc" for m in (1, 2)] + [("b", f"2000-0{m}-01", 9.0) for m in (1, 2)])
    assert kept and {p: p.stat().st_mtime_ns for p in (tmp_path / "t").rglob("year=1999/*.parquet")} == kept
    spark.sql(f"DROP TABLE {name}")
