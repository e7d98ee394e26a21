"""The fixed rule layer and coverage, in one pass partitioned by entity.

Rows without an entity or group are no series: rules that compare rows of one (R5, R6) never flag them, and ``null_key_report`` counts them. R4 takes null for a
key like any other."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import NULL_KEY_NOTE, RULE_NOTES
from ..params import Params
from ..sources.io import cut_lineage


def _flag(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def rule_net_identity(p: Params = Params()) -> Column:
    return _flag(F.abs(F.col("net") - (F.col("gross") - F.col("repayments"))) > p.tolerance)


def rule_negative_gross() -> Column:
    return _flag(F.col("gross") < 0)


def rule_negative_repayments() -> Column:
    return _flag(F.col("repayments") < 0)


def rule_duplicate_key(*keys: str) -> Column:
    """Every row of a key that occurs more than once; nulls are equal. A window: for rows that are partitioned by a key already, see ``rows_of_repeated_keys``."""
    return F.count(F.lit(1)).over(Window.partitionBy(*keys)) > 1


BROADCAST_KEYS = 1_000_000


def repeated_keys(df: DataFrame, *keys: str) -> DataFrame:
    """Each key that occurs more than once, and ``n_rows``. Only key columns are shuffled, counted before."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows")).where("n_rows > 1")


def rows_of_repeated_keys(df: DataFrame, *keys: str) -> DataFrame:
    """Whole rows of keys that occur more than once. The keys are counted by a job at once and written to the checkpoint folder; up to ``BROADCAST_KEYS`` of them are sent to
    the rows, which then stay where they are. Beyond that both sides are shuffled by key, and Spark's own Bloom filter of the repeated keys thins the rows out before."""
    again = cut_lineage(repeated_keys(df, *keys)).select(*(F.col(k).alias(f"__{k}") for k in keys))
    few = again.limit(BROADCAST_KEYS + 1).count() <= BROADCAST_KEYS
    same = reduce(lambda x, y: x & y, (df[k].eqNullSafe(again[f"__{k}"]) for k in keys))
    return df.join(F.broadcast(again) if few else again, same, "left_semi")


def rule_attribute_drift(attribute: str, entity: str = "entity") -> Column:
    """The entity is seen under more than one value; nulls don't count, and rows without entity are none."""
    w = Window.partitionBy(entity)
    return _flag((F.min(attribute).over(w) != F.max(attribute).over(w)) & F.col(entity).isNotNull())


def rule_stale_repeat(value: str, *keys: str, period: str = "period") -> Column:
    """A positive value equal to that of the row before, which is one period earlier; rows without one of the keys have no row before."""
    w = Window.partitionBy(*keys).orderBy(period)
    whole = reduce(lambda x, y: x & y, (F.col(k).isNotNull() for k in keys))
    return _flag((F.col(value) > 0) & (F.col(value) == F.lag(value).over(w)) & (F.lag(period).over(w) == F.col(period) - 1) & whole)


def flag_period_complete(p: Params) -> Column:
    return F.col("period") <= p.last_complete


def run_rules(df: DataFrame, p: Params = Params(), stale: str = "gross") -> DataFrame:
    """df with flag_R1 to flag_R6 and is_complete. One exchange by entity serves all three windows: their keys contain it. Rows without entity, however many, are
    spread by group and period, which is all that R4 compares of them."""
    named = F.col("entity").isNotNull()
    key = F.when(named, F.col("entity").cast("string")).otherwise(F.concat_ws("\x1f", F.lit("\0"), F.coalesce(F.col("grp").cast("string"), F.lit("\0")), F.col("period").cast("string")))
    flags = {
        "R1_net_identity": rule_net_identity(p),
        "R2_negative_gross": rule_negative_gross(),
        "R3_negative_repayments": rule_negative_repayments(),
        "R4_duplicate_key": rule_duplicate_key("__e", "grp", "period"),
        "R5_region_reassigned": rule_attribute_drift("region", "__e") & named,
        "R6_stale_gross": rule_stale_repeat(stale, "__e", "grp") & named,
    }
    return df.withColumn("__e", key).repartition("__e").select(*df.columns, *(c.alias(f"flag_{n}") for n, c in flags.items()), flag_period_complete(p).alias("is_complete"))


def null_key_report(df: DataFrame, *keys: str) -> DataFrame:
    """rule, n_rows_flagged, pct_of_rows, note: a row for each key column, in the form of ``rule_report``: how many rows have none and so are in no series."""
    keys = keys or ("grp", "entity", "period")
    sums = df.agg(F.count(F.lit(1)).alias("n"), *(F.count_if(F.col(k).isNull()).alias(f"K_null_{k}") for k in keys))
    long = sums.unpivot("n", [f"K_null_{k}" for k in keys], "rule", "n_rows_flagged")
    return long.select("rule", "n_rows_flagged", F.bround(F.try_divide(F.lit(100.0) * F.col("n_rows_flagged"), F.col("n")), 3).alias("pct_of_rows"), F.lit(NULL_KEY_NOTE).alias("note"))


def rule_report(flagged: DataFrame) -> DataFrame:
    """rule, n_rows_flagged, pct_of_rows, note."""
    names = [c.removeprefix("flag_") for c in flagged.columns if c.startswith("flag_")]
    sums = flagged.agg(F.count(F.lit(1)).alias("n"), *(F.coalesce(F.sum(F.col(f"flag_{n}").cast("long")), F.lit(0)).alias(n) for n in names))
    long = sums.unpivot("n", names, "rule", "n_rows_flagged")
    note = F.create_map(*[F.lit(x) for n in names for x in (n, RULE_NOTES.get(n, ""))])
    return long.select("rule", "n_rows_flagged", F.bround(F.try_divide(F.lit(100.0) * F.col("n_rows_flagged"), F.col("n")), 3).alias("pct_of_rows"), note[F.col("rule")].alias("note"))


def coverage_report(df: DataFrame, p: Params = Params()) -> DataFrame:
    """Complete periods of each series: first, last, rows, and the periods that are missing."""
    done = df.where(flag_period_complete(p) & F.col("entity").isNotNull())
    g = done.groupBy("grp", "entity").agg(F.min("period").alias("first_period"), F.max("period").alias("last_period"), F.count(F.lit(1)).alias("n_periods"), F.collect_set("period").alias("seen"))
    gaps = F.array_sort(F.array_except(F.sequence("first_period", "last_period"), "seen"))
    return g.select("grp", "entity", "first_period", "last_period", "n_periods", F.size(gaps).cast("long").alias("n_gaps"), F.array_join(gaps.cast("array<string>"), ",").alias("gap_periods"))


def gappy_series(coverage: DataFrame, group: str) -> DataFrame:
    return coverage.where((F.col("grp") == group) & (F.col("n_gaps") > 0)).orderBy(F.desc("n_gaps"), "entity")


def drift_detail(flagged: DataFrame) -> DataFrame:
    """For entities under several regions, when each was used."""
    return flagged.where("flag_R5_region_reassigned").groupBy("entity", "region").agg(F.min("period").alias("first_period"), F.max("period").alias("last_period"))


def drift_summary(flagged: DataFrame) -> DataFrame:
    """How many entities are under several regions, over how many rows; one row."""
    some = flagged.where("flag_R5_region_reassigned")
    return some.agg(F.countDistinct("entity").alias("n_entities"), F.count(F.lit(1)).alias("n_rows"))
