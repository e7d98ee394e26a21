"""Robust statistics and the frozen-baseline control charts, as window columns over one partitioning by entity."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.logs import ln
from ..functions.text import explain_alert
from ..params import Params
from ..sources.io import cut_lineage
from .rules import BROADCAST_KEYS
from .runs import like, with_runs


def by_entity():
    return Window.partitionBy("entity")


def in_order():
    return by_entity().orderBy("period")


def window_filter(window: tuple[int, int]) -> Column:
    """The period lies in a window, both ends included."""
    return F.col("period").between(*window)


def beyond_limits(value: Column, low: Column, high: Column) -> Column:
    """Strictly outside; false where anything is missing."""
    return F.coalesce((value > high) | (value < low), F.lit(False))


def classify_rule(beyond: Column, shifted: Column) -> Column:
    return F.when(beyond, "beyond_limits").when(shifted, "sustained_shift").otherwise("")


def clip_level(c: Column) -> Column:
    return F.when(c.isNotNull(), F.greatest(c, F.lit(0.0)))


def control_limits(center: Column, sigma: Column, p: Params, floor: bool) -> tuple[Column, Column]:
    low = center - p.sigmas * sigma
    return (F.when(low.isNotNull(), F.greatest(low, F.lit(0.0))) if floor else low), center + p.sigmas * sigma


def robust_z(value: Column, center: Column, sigma: Column) -> Column:
    return F.when(sigma > 0, (value - center) / sigma)


def refusal(n: Column, sigma: Column, p: Params) -> Column:
    """Why a chart isn't fitted; empty if it is."""
    return F.when(n < p.min_points, F.format_string(f"only %d baseline years (<{p.min_points})", n)).when(~F.coalesce(sigma > 0, F.lit(False)), "zero baseline variation (MAD = 0)").otherwise("")


SPREAD = 200_000  # values of a key that one task may hold
GRID, ACCURACY = 256, 4096


def exact_median(df: DataFrame, value: str, keys: list[str], spread: int = SPREAD) -> DataFrame:
    """keys, n, median for keys of any size: the exact middle value (or mean of the two), without a task that holds a key's values.

    Each key has a bracket of values that holds its middle ranks. A mergeable sketch of quantiles proposes a narrower one, exact counts below and inside confirm it, and
    so on until a bracket holds at most ``spread`` values, or narrows no more as ties fill it; its distinct values are then counted and picked by rank. Each round narrows by a
    hundred or so whatever the distribution, by two passes over the rows in brackets. It runs jobs at once. Keys without a value are left out; nulls and NaN don't count."""
    v = F.col(value).cast("double")
    rows = df.where(v.isNotNull() & ~F.isnan(v)).select(*(F.col(k).alias(f"__{k}") for k in keys), v.alias("__v"))
    names = [f"__{k}" for k in keys]
    bracket = rows.groupBy(*names).agg(F.count(F.lit(1)).alias("n"), F.min("__v").alias("lo"), F.max("__v").alias("hi")).withColumns({"below": F.lit(0).cast("long"), "inside": F.col("n"), "done": (F.col("n") <= spread) | (F.col("lo") >= F.col("hi"))})
    bracket = cut_lineage(bracket)

    def within(some: DataFrame) -> DataFrame:
        side = some.select(*(F.col(c).alias(f"_{c}") for c in names), *(c for c in some.columns if c not in names))
        side = F.broadcast(side) if some.limit(BROADCAST_KEYS + 1).count() <= BROADCAST_KEYS else side
        same = reduce(lambda x, y: x & y, (F.col(c).eqNullSafe(F.col(f"_{c}")) for c in names))
        return rows.join(side, same).where(F.col("__v").between(F.col("lo"), F.col("hi"))).drop(*(f"_{c}" for c in names))

    first, second = ((F.col("n") - 1) / 2).cast("long"), (F.col("n") / 2).cast("long")
    accuracy = ACCURACY
    while True:
        wide = cut_lineage(bracket.where(~F.col("done")))
        if wide.isEmpty():
            break
        grid = within(wide.select(*names, "lo", "hi")).groupBy(*names).agg(F.percentile_approx("__v", [k / GRID for k in range(GRID + 1)], accuracy).alias("q"))
        grid = grid.select(*(F.col(c).alias(f"_{c}") for c in names), "q")
        known = wide.join(grid, reduce(lambda x, y: x & y, (F.col(c).eqNullSafe(F.col(f"_{c}")) for c in names)))
        at = lambda r, d: F.floor((r - F.col("below")) * GRID / F.col("inside")) + d
        a = F.when(at(first, -1) >= 0, F.get("q", at(first, -1).cast("int"))).otherwise(F.col("lo"))
        b = F.when(at(second, 2) <= GRID, F.get("q", at(second, 2).cast("int"))).otherwise(F.col("hi"))
        tried = cut_lineage(known.select(*wide.columns, F.greatest("lo", a).alias("a"), F.least("hi", b).alias("b")))
        counted = within(tried).groupBy(*names, "n", "lo", "hi", "below", "inside", "done", "a", "b").agg(F.count_if(F.col("__v") < F.col("a")).alias("under"), F.count_if(F.col("__v").between(F.col("a"), F.col("b"))).alias("held"))
        good = (F.col("below") + F.col("under") <= first) & (second < F.col("below") + F.col("under") + F.col("held"))
        new = {"lo": F.when(good, F.col("a")).otherwise(F.col("lo")), "hi": F.when(good, F.col("b")).otherwise(F.col("hi")), "below": F.when(good, F.col("below") + F.col("under")).otherwise(F.col("below")), "inside": F.when(good, F.col("held")).otherwise(F.col("inside"))}
        stays = (good & (F.col("held") == F.col("inside"))) | F.lit(accuracy >= 1 << 20)  # ties at both ends hold nearly all
        narrow = counted.select(*names, "n", *(c.alias(k) for k, c in new.items()), stays.alias("stays"))
        narrow = narrow.withColumn("done", (F.col("inside") <= spread) | (F.col("lo") >= F.col("hi")) | F.col("stays")).drop("stays")
        bracket = cut_lineage(bracket.where("done").unionByName(narrow))
        accuracy *= 2  # a sketch that missed is followed by a finer one
    counts = within(bracket).groupBy(*names, "n", "below", "__v").agg(F.count(F.lit(1)).alias("k"))
    upto = F.col("below") + F.sum("k").over(Window.partitionBy(*names).orderBy("__v"))
    ranked = counts.withColumn("upto", upto)
    middle = [F.max(F.when((r < F.col("upto")) & (r >= F.col("upto") - F.col("k")), F.col("__v"))) for r in (first, second)]
    return ranked.groupBy(*names, "n").agg((middle[0] * 0.5 + middle[1] * 0.5).alias("median")).select(*(F.col(f"__{k}").alias(k) for k in keys), "n", "median")


def robust_center_sigma(df: DataFrame, value: str, keys: list[str], p: Params = Params(), spread: int = SPREAD) -> DataFrame:
    """keys, n, center, sigma: median and scaled median absolute deviation of each group; nulls and NaN don't count. Keys are counted by a job at once: up to ``spread`` values a key
    the rows are partitioned by key, larger keys go through ``exact_median``, twice."""
    sizes = df.groupBy(*keys).agg(F.count(F.nanvl(F.col(value).cast("double"), F.lit(None))).alias("n"))
    large = cut_lineage(sizes.where(F.col("n") > spread))
    some = large.limit(BROADCAST_KEYS + 1).count()
    value_or_null = df.withColumn(value, F.nanvl(F.col(value).cast("double"), F.lit(None)))

    def plain(rows: DataFrame) -> DataFrame:
        w = Window.partitionBy(*keys)
        return rows.withColumn("__m", F.median(value).over(w)).groupBy(*keys).agg(F.count(value).alias("n"), F.first("__m").alias("center"), (F.median(F.abs(F.col(value) - F.col("__m"))) * p.mad_scale).alias("sigma"))

    if not some:
        return plain(value_or_null)
    side = large.select(*(F.col(k).alias(f"__{k}") for k in keys))
    side = F.broadcast(side) if some <= BROADCAST_KEYS else side
    same = lambda x, y: reduce(lambda p, q: p & q, (x[k].eqNullSafe(y[f"__{k}"]) for k in keys))
    big = value_or_null.join(side, same(value_or_null, side), "left_semi").select(*keys, value)
    center = cut_lineage(exact_median(big, value, keys, spread).select(*(F.col(k).alias(f"__{k}") for k in keys), "n", F.col("median").alias("center")))
    near = F.broadcast(center) if some <= BROADCAST_KEYS else center
    off = big.join(near, same(big, near)).select(*keys, F.abs(F.col(value) - F.col("center")).alias("__off"))
    mad = exact_median(off, "__off", keys, spread).drop("n")
    fits = mad.join(center, same(mad, center)).select(*keys, "n", "center", (F.col("median") * p.mad_scale).alias("sigma"))
    return plain(value_or_null.join(side, same(value_or_null, side), "left_anti")).unionByName(fits)


def with_chart(df: DataFrame, value: str, p: Params, floor: bool) -> DataFrame:
    """df with n_baseline, center, sigma, lcl, ucl and reason of its entity's chart."""
    base = F.when(window_filter(p.baseline), F.col(value))
    df = df.withColumn("n_baseline", F.count(base).over(by_entity())).withColumn("center", F.median(base).over(by_entity()))
    df = df.withColumn("sigma", F.median(F.abs(base - F.col("center"))).over(by_entity()) * p.mad_scale)
    low, high = control_limits(F.col("center"), F.col("sigma"), p, floor)
    return df.withColumns({"lcl": low, "ucl": high, "reason": refusal(F.col("n_baseline"), F.col("sigma"), p)})


def fit_charts(df: DataFrame, value: str, p: Params, floor: bool = True) -> DataFrame:
    """One row an entity: n_baseline, center, sigma, lcl, ucl, reason."""
    columns = ["n_baseline", "center", "sigma", "lcl", "ucl", "reason"]
    return with_chart(df, value, p, floor).groupBy("entity").agg(*(F.first(c).alias(c) for c in columns))


def stabiliser(p: Params) -> Column:
    """5 % of the typical level in the baseline, or of all levels without one; never below the floor."""
    x = clip_level(F.col("value"))
    typical = F.coalesce(F.median(F.when(window_filter(p.baseline), x)).over(by_entity()), F.median(x).over(by_entity()))
    return F.greatest(F.lit(p.c_floor), p.c_fraction * typical)


def yoy_log_growth_v1(df: DataFrame, p: Params) -> DataFrame:
    """df with ``growth`` against the row before, so gaps are bridged; null at the first row."""
    x = clip_level(F.col("value"))
    df = df.withColumn("__c", stabiliser(p)).withColumn("__x", x)
    return df.withColumn("growth", ln((F.col("__x") + F.col("__c")) / (F.lag("__x").over(in_order()) + F.col("__c")))).drop("__c", "__x")


def run_rule_retroactive(df: DataFrame, value: str, p: Params, stretch: int | None = None, keep: Column | None = None) -> DataFrame:
    """df with ``in_run``: the row is part of ``run_length`` or more rows in a row on one side of the centre. Rows without value don't count, and are left out unless they are of an
    entity that ``keep`` marks, whose runs mean nothing. With ``stretch``, series are cut into
    stretches of so many periods, for those that are too long for one task."""
    valued = F.col(value).isNotNull()
    live = df.where(valued if keep is None else valued | keep).withColumn("__side", F.signum(F.col(value) - F.col("center")))
    if stretch is not None:
        runs = with_runs(live, like("__side"), ("__side",), stretch)
        return runs.withColumn("in_run", (F.col("run_size") >= p.run_length) & (F.col("__side") != 0)).drop("__side", "run", "run_size", "run_first", "run_last")
    live = live.withColumn("__new", F.coalesce((F.lag("__side").over(in_order()) != F.col("__side")), F.lit(True)).cast("int"))
    live = live.withColumn("__run", F.sum("__new").over(in_order().rowsBetween(Window.unboundedPreceding, 0)))
    size = F.count(F.lit(1)).over(Window.partitionBy("entity", "__run"))
    return live.withColumn("in_run", (size >= p.run_length) & (F.col("__side") != 0)).drop("__side", "__new", "__run")


def classify_severity(z: Column, rule: Column, p: Params) -> Column:
    return F.when(rule == "", "").when(F.abs(z) >= p.high_z, "high").otherwise("medium")


def build_chart(df: DataFrame, value: str, name: str, p: Params, floor: bool, kind: str, refused: bool = False) -> DataFrame:
    """Judged points of the monitor window of fitted entities. ``refused``: with a status, and with the monitored rows of all other entities (not null), whose status is why they
    have no chart, from the same pass."""
    v, fitted = F.col(value), F.col("reason") == ""
    charted = with_chart(df, value, p, floor)
    if refused:
        judged = run_rule_retroactive(charted.where(fitted | F.col("entity").isNotNull()), value, p, keep=~fitted)
        judged = judged.withColumns({c: F.when(fitted, F.col(c)) for c in (value, "center", "lcl", "ucl", "sigma", "n_baseline", "in_run")})
    else:
        judged = run_rule_retroactive(charted.where(fitted), value, p)
    judged = judged.where(window_filter(p.monitor))
    status = [F.when(fitted, "charted").otherwise(F.col("reason")).alias("status")] if refused else []
    rule = classify_rule(beyond_limits(v, F.col("lcl"), F.col("ucl")), F.col("in_run"))
    out = judged.select(F.lit(name).alias("chart"), "entity", "period", v.alias("value"), "center", "lcl", "ucl", "sigma", robust_z(v, F.col("center"), F.col("sigma")).alias("robust_z"), "n_baseline", rule.alias("rule"), *status)
    return out.withColumn("severity", classify_severity(F.col("robust_z"), F.col("rule"), p)).withColumn("explanation", explain_alert(p, kind))


def not_charted(df: DataFrame, value: str, name: str, p: Params) -> DataFrame:
    return fit_charts(df, value, p).where("reason <> ''").select(F.lit(name).alias("chart"), "entity", "reason")


def build_charts(series: DataFrame, p: Params) -> tuple[DataFrame, DataFrame]:
    """Points and refused entities of the level chart A and the growth chart B."""
    grown = yoy_log_growth_v1(series, p)
    points = build_chart(series, "value", "A_level", p, True, "usd").unionByName(build_chart(grown, "growth", "B_growth", p, False, "growth"))
    refused = not_charted(series, "value", "A_level", p).unionByName(not_charted(grown, "growth", "B_growth", p))
    return points, refused


def select_alerts(points: DataFrame) -> DataFrame:
    return points.where("rule <> ''").withColumn("abs_z", F.abs("robust_z"))


def rank_alerts(alerts: DataFrame) -> DataFrame:
    return alerts.orderBy("chart", F.desc("abs_z"), "entity", "period")


def top_alerts(alerts: DataFrame, n: int) -> DataFrame:
    return alerts.where("chart = 'B_growth'").orderBy(F.desc("abs_z"), "entity", "period").limit(n)


def refusal_counts(refused: DataFrame) -> DataFrame:
    return refused.groupBy("chart", F.split("reason", " ")[0].alias("word")).agg(F.count(F.lit(1)).alias("entities"))


def chart_summary(points: DataFrame) -> DataFrame:
    n, a = F.count(F.lit(1)), F.count_if(F.col("rule") != "")
    return points.groupBy("chart").agg(F.countDistinct("entity").alias("entities"), n.alias("points"), a.alias("alerts"), F.bround(100.0 * a / n, 1).alias("alert_pct"))


def portfolio_totals(series: DataFrame, p: Params) -> DataFrame:
    """Totals by period with one chart over all of them; a row a period."""
    total = series.groupBy("period").agg(F.sum("value").alias("value")).withColumn("entity", F.lit("all"))
    return with_chart(total, "value", p, True).select("period", "value", "center", "lcl", "ucl", (window_filter(p.monitor) & F.coalesce(F.col("value") > F.col("ucl"), F.lit(False))).alias("above"))


def partial_period_totals(df: DataFrame, p: Params) -> DataFrame:
    return df.groupBy("period").agg((F.sum("gross") / 1e9).alias("total_bn")).withColumn("is_complete", F.col("period") <= p.last_complete)
