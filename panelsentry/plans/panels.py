"""Panels over the test tables: A from line items by quarter, B from events by day, C is A after some feeds stop."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..params import Params

A = Params(baseline=(0, 15), monitor=(16, 26), last_complete=26, c_floor=100.0)
B = Params(baseline=(0, 19), monitor=(20, 29), last_complete=29, c_floor=1.0)
FLOWS_A = ["repayments", "charges"]
FLOWS_B = ["view", "click", "signup"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def whole(c: Column) -> Column:
    """The nearest whole number, halves away from zero, as round has it, but by arithmetic: round makes decimals of texts of every number."""
    near = F.rint(c)
    return F.when(F.abs(c - near) == 0.5, c + F.signum(c) * 0.5).otherwise(near).cast("long")


def _cents(c: Column) -> Column:
    return F.sum(whole(c * 100)).cast("double") / 100


def panel_a(spark: SparkSession, sf_dir: str) -> DataFrame:
    """grp, entity, period, region, gross, repayments, net, charges, n_lines. The region is joined to suppliers after the sum, on far fewer rows."""
    li = table(spark, sf_dir, "lineitem")
    price, rate = F.col("l_extendedprice"), F.col("l_discount")
    period = (F.year("l_shipdate") - 1995) * 4 + F.quarter("l_shipdate") - 1
    cells = li.groupBy(F.col("l_returnflag").alias("grp"), "l_suppkey", period.cast("int").alias("period")).agg(
        _cents(price).alias("gross"), _cents(price * rate).alias("repayments"), F.sum(whole(price * (1 - rate))).cast("double").alias("net"), _cents(price * F.col("l_tax")).alias("charges"), F.count(F.lit(1)).alias("n_lines"),
    )
    place = table(spark, sf_dir, "supplier").join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select("s_suppkey", F.col("r_name").alias("region"))
    return cells.join(place, F.col("l_suppkey") == F.col("s_suppkey"), "left").select("grp", F.concat_ws("-", "grp", F.col("l_suppkey").cast("string")).alias("entity"), "period", "region", "gross", "repayments", "net", "charges", "n_lines")


def series_a(spark: SparkSession, sf_dir: str) -> DataFrame:
    return panel_a(spark, sf_dir).where(F.col("period") <= A.last_complete).select("entity", "period", F.col("gross").alias("value"), *FLOWS_A)


def panel_b(spark: SparkSession, sf_dir: str) -> DataFrame:
    """grp, entity, period and gross = purchases less a tenth of errors; other event types as other flows."""
    of = lambda t: F.sum(F.when(F.col("event_type") == t, whole(F.col("value") * 100)).otherwise(0))
    e = table(spark, sf_dir, "events").groupBy(F.col("user_id").cast("string").alias("entity"), F.datediff(F.to_date("ts"), F.lit("2024-01-01").cast("date")).alias("period"))
    return e.agg(((of("purchase") * 10 - of("error")).cast("double") / 1000).alias("gross"), *((of(t).cast("double") / 100).alias(t) for t in FLOWS_B)).select(F.lit("events").alias("grp"), "entity", "period", "gross", *FLOWS_B)


def series_b(spark: SparkSession, sf_dir: str) -> DataFrame:
    return panel_b(spark, sf_dir).select("entity", "period", F.col("gross").alias("value"), *FLOWS_B)


def series_c(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Series A where a tenth of the entities, chosen by md5, report zero from a period of their own on."""
    h = F.conv(F.substring(F.md5(F.concat(F.lit("stop|"), F.col("entity"))), 1, 6), 16, 10).cast("long")
    at = A.monitor[0] + F.floor(h / 10) % (A.monitor[1] - A.monitor[0])
    return series_a(spark, sf_dir).withColumn("value", F.when((h % 10 == 0) & (F.col("period") >= at), 0.0).otherwise(F.col("value")))


def series_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Series A with holes: by md5 an eleventh each of its cells has no level, is not there, is zero, or is there twice, once without a level."""
    h = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit("hole"), "entity", F.col("period").cast("string"))), 1, 6), 16, 10).cast("long") % 11
    a = series_a(spark, sf_dir).withColumn("h", h).where("h <> 1").withColumn("value", F.when(F.col("h") == 0, F.lit(None)).when(F.col("h") == 2, 0.0).otherwise(F.col("value")))
    return a.unionByName(a.where("h = 3").withColumn("value", F.when(F.col("period") % 2 == 0, F.lit(float("nan"))))).drop("h")


def panel_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Panel A where, by md5, a ninth each of the rows have no entity, no group, or neither."""
    h = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit("key"), "entity", F.col("period").cast("string"))), 1, 6), 16, 10).cast("long") % 9
    return panel_a(spark, sf_dir).withColumn("h", h).withColumns({"entity": F.when(~F.col("h").isin(0, 2), F.col("entity")), "grp": F.when(~F.col("h").isin(1, 2), F.col("grp"))}).drop("h")
