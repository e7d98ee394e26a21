"""Alerts in consecutive periods as incidents; zero periods and their lifecycle incidents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.logs import exp_each
from ..params import SEVERITY_RANK, Params
from .runs import consecutive, with_runs

INCIDENT_COLUMNS = ["source", "incident_id", "entity", "first_period", "last_period", "n_alerts", "kind", "max_abs_z", "severity", "summary"]


def attach_incident_id(alerts: DataFrame, stretch: int | None = None, within: tuple[str, ...] = ()) -> DataFrame:
    """Alerts with the id of their island of consecutive periods; no join. ``within``: more columns that tell series apart, as the method does. With ``stretch``, for entities whose alerts are too many for one task, islands are put together
    from stretches of so many periods."""
    if stretch is not None:
        if within:
            raise ValueError("stretches know no keys but the entity")
        end = F.when(F.col("run_last") != F.col("run_first"), F.concat(F.lit("-"), F.col("run_last"))).otherwise("")
        return with_runs(alerts, consecutive, ("period",), stretch).withColumn("incident_id", F.concat(F.col("entity"), F.lit(" FY"), F.col("run_first"), end)).drop("run", "run_size", "run_first", "run_last")
    island = F.col("period") - F.row_number().over(Window.partitionBy(*within, "entity").orderBy("period"))
    both = Window.partitionBy(*within, "entity", "__island")
    a, b = F.min("period").over(both), F.max("period").over(both)
    tail = F.when(b != a, F.concat(F.lit("-"), b)).otherwise("")
    return alerts.withColumn("__island", island).withColumn("incident_id", F.concat(F.col("entity"), F.lit(" FY"), a, tail)).drop("__island")


def group_incidents(alerts: DataFrame, baseline: str | Column, p: Params = Params(), worst: bool = False, stretch: int | None = None, within: tuple[str, ...] = ()) -> DataFrame:
    """One row an island: kind, size, greatest |z|, severity and a summary, which lists its members. ``worst``: severity is the worst member's, which may be low."""
    rank = F.coalesce(F.create_map(*[F.lit(x) for kv in SEVERITY_RANK.items() for x in kv])[F.col("severity")], F.lit(0))
    g = attach_incident_id(alerts, stretch, within).groupBy(*within, "entity", "incident_id").agg(
        F.min("period").alias("first_period"), F.max("period").alias("last_period"), F.count(F.lit(1)).alias("n_alerts"),
        F.bround(F.max(F.abs("robust_z")), 1).alias("max_abs_z"), F.max(rank).alias("r"),
        F.array_sort(F.collect_list(F.struct("period", "robust_z", "value", "explanation"))).alias("m"),
    )
    baseline = F.lit(baseline) if isinstance(baseline, str) else baseline
    first, last, n, e = F.col("first_period"), F.col("last_period"), F.col("n_alerts"), F.col("entity")
    at = lambda k, c: F.col("m")[k][c]
    two = n == 2
    kind = F.when(n >= p.persistent, "persistent").when(two & (F.signum(at(0, "robust_z")) != F.signum(F.try_element_at("m", F.lit(2))["robust_z"])), "spike_and_reversal").when(two, "two_year_move").otherwise("single")
    g = g.withColumn("__moves", F.transform(exp_each(F.transform("m", lambda s: s["value"])), X.pct_of))
    moves, second = F.array_join("__moves", ", "), F.try_element_at("__moves", F.lit(2))
    summary = (
        F.when(F.col("kind") == "persistent", F.format_string(X.PERSISTENT, e, n, first, last, moves, baseline, n))
        .when(F.col("kind") == "spike_and_reversal", F.format_string(X.REVERSAL, e, first, F.col("__moves")[0], last, second, first))
        .when(F.col("kind") == "two_year_move", F.format_string(X.TWO_STEP, e, first, F.col("__moves")[0], last, second))
        .otherwise(at(0, "explanation"))
    )
    severity = F.when(F.col("r") >= 3, "high").when((F.col("r") == 2) | F.lit(not worst), "medium").when(F.col("r") == 1, "low").otherwise("")
    out = g.withColumn("kind", kind).withColumn("severity", severity).withColumn("summary", summary).withColumn("source", F.lit("statistical"))
    return out.select(*within, *INCIDENT_COLUMNS)


def incident_order(incidents: DataFrame) -> DataFrame:
    return incidents.orderBy(F.desc("max_abs_z"), "entity", "first_period")


def multi_period_incidents(incidents: DataFrame) -> DataFrame:
    return incidents.where("kind <> 'single'")


def _zero_periods_by_stretch(df: DataFrame, stretch: int) -> DataFrame:
    """As ``zero_periods``: islands from stretches, facts of an entity by aggregates, and the row after an island by its key."""
    facts = df.groupBy(F.col("entity").alias("__e")).agg(F.min(F.when(~F.col("__zero"), F.col("period"))).alias("f"), F.max("period").alias("l"))
    g = with_runs(df.where("__zero").select("entity", "period", "__still"), consecutive, ("period",), stretch)
    g = g.groupBy("entity", "run").agg(F.min("period").alias("first_period"), F.max("period").alias("last_period"), F.count(F.lit(1)).alias("n_periods"), F.bool_and("__still").alias("other_flows_zero"))
    next_ = df.where(~F.col("__zero")).select(F.col("entity").alias("__n"), (F.col("period") - 1).alias("__at")).distinct()
    g = g.join(next_, F.col("entity").eqNullSafe(F.col("__n")) & (F.col("last_period") == F.col("__at")), "left").join(facts, F.col("entity").eqNullSafe(F.col("__e")))
    return g.select("entity", "first_period", "last_period", "n_periods", F.coalesce(F.col("f") < F.col("first_period"), F.lit(False)).alias("has_prior_activity"), F.when(F.col("__at").isNotNull(), F.col("last_period") + 1).alias("reactivated_period"), (F.col("last_period") == F.col("l")).alias("ongoing"), "other_flows_zero")


def zero_periods(series: DataFrame, flows: list[str], stretch: int | None = None) -> DataFrame:
    """Runs of consecutive periods at or below zero. With ``stretch``, series are cut into stretches of so many periods, for those that are too long for one task."""
    by = Window.partitionBy("entity")
    ordered = by.orderBy("period")
    zero = F.coalesce(F.col("value") <= 0, F.lit(False))
    other = F.lit(0.0)
    for f in flows:
        other = other + F.coalesce(F.abs(F.col(f)), F.lit(0.0))
    if stretch is not None:
        return _zero_periods_by_stretch(series.select("entity", "period", zero.alias("__zero"), (other == 0).alias("__still")), stretch)
    df = series.withColumns({"__zero": zero, "__still": other == 0, "__first": F.min(F.when(~zero, F.col("period"))).over(by), "__last": F.max("period").over(by), "__next": F.lead("period").over(ordered), "__next_zero": F.lead(zero).over(ordered)})
    df = df.where("__zero").withColumn("__island", F.col("period") - F.row_number().over(ordered))
    g = df.groupBy("entity", "__island").agg(
        F.min("period").alias("first_period"), F.max("period").alias("last_period"), F.count(F.lit(1)).alias("n_periods"), F.first("__first").alias("f"), F.first("__last").alias("l"),
        F.max_by("__next", "period").alias("nx"), F.max_by("__next_zero", "period").alias("nz"), F.bool_and("__still").alias("other_flows_zero"),
    )
    back = (F.col("nx") == F.col("last_period") + 1) & ~F.col("nz")
    return g.select("entity", "first_period", "last_period", "n_periods", F.coalesce(F.col("f") < F.col("first_period"), F.lit(False)).alias("has_prior_activity"), F.when(back, F.col("last_period") + 1).alias("reactivated_period"), (F.col("last_period") == F.col("l")).alias("ongoing"), "other_flows_zero")


def lifecycle_incidents(periods: DataFrame, p: Params) -> DataFrame:
    """Long zero periods after activity that reach the monitor window, one incident each."""
    c = F.col
    some = periods.where((c("n_periods") >= p.min_zero) & c("has_prior_activity") & (c("last_period") >= p.monitor[0]))
    state = F.when(c("ongoing"), F.format_string("still zero at FY%d", "last_period")).when(c("reactivated_period").isNotNull(), F.format_string("positive again in FY%d", "reactivated_period")).otherwise(F.format_string("followed by a missing FY%d row", c("last_period") + 1))
    note = F.when(c("other_flows_zero"), X.ALSO_ZERO).otherwise(X.STILL_FLOWING)
    return some.select(
        F.lit("lifecycle").alias("source"), F.format_string("%s FY%d-%d zero", "entity", "first_period", "last_period").alias("incident_id"), "entity", "first_period", "last_period", F.lit(0).cast("long").alias("n_alerts"),
        F.when(c("ongoing"), "zero_period_ongoing").otherwise("zero_period_ended").alias("kind"), F.lit(None).cast("double").alias("max_abs_z"), F.when(c("other_flows_zero"), "medium").otherwise("info").alias("severity"),
        F.format_string(X.LIFECYCLE, "entity", "n_periods", "first_period", "last_period", state, note).alias("summary"),
    )


ROLLING = "The rolling baseline"


def build_incidents(alerts: DataFrame, fixed: bool, periods: DataFrame | None, p: Params) -> DataFrame:
    baseline = f"The FY{p.span} baseline" if fixed else ROLLING
    out = group_incidents(alerts, baseline, p, worst=True)
    return out if periods is None else out.unionByName(lifecycle_incidents(periods, p))


def build_incidents_of_methods(alerts: DataFrame, fixed: list[str], knows: list[str], periods: DataFrame, p: Params) -> DataFrame:
    """``build_incidents`` of alerts with a method column, in one pass. fixed: methods with a fixed baseline; knows: methods that have lifecycle incidents, which are found once."""
    out = group_incidents(alerts, F.when(F.col("method").isin(fixed), f"The FY{p.span} baseline").otherwise(ROLLING), p, worst=True, within=("method",))
    if not knows:
        return out
    return out.unionByName(lifecycle_incidents(periods, p).select(F.explode(F.array(*[F.lit(m) for m in knows])).alias("method"), "*"))
