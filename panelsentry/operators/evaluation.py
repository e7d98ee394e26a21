"""Planted errors, scoring, labels, the ledger and comparisons of methods."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..params import ERROR_KINDS, METHODS, Params
from ..sources.io import cut_lineage, stored
from .adaptive import all_points, method_points
from .charts import in_order
from .incidents import lifecycle_incidents, zero_periods
from .rules import rule_stale_repeat

KEY = ["entity", "period"]
SCENARIO = ["kind", "trial"]


def scenarios(spark: SparkSession, p: Params, kinds=ERROR_KINDS) -> DataFrame:
    """kind, trial; at most kinds x trials rows, so broadcasting it is safe."""
    for k in kinds:
        if k not in ERROR_KINDS:
            raise ValueError(f"no injector for error type {k!r}")
    return spark.range(p.trials).select(F.explode(F.array(*[F.lit(k) for k in kinds])).alias("kind"), F.col("id").cast("int").alias("trial"))


def _draw(seed: int, *more: str) -> Column:
    return F.md5(F.concat_ws("|", F.lit(str(seed)), "kind", F.col("trial").cast("string"), *[F.col(m).cast("string") for m in more]))


def pick_cells(series: DataFrame, table: DataFrame, seed: int, p: Params) -> DataFrame:
    """At most ``planted`` entities a scenario, then one cell of each, both by hash order: kind, trial, entity, period. Entities are drawn from a row an entity, so
    only the cells of drawn ones are hashed by scenario."""
    cells = series.withColumn("prev", F.lag("value").over(in_order())).where(F.col("period").between(*p.monitor) & (F.col("value") > 0))
    cells = cells.select("entity", "period", F.coalesce((F.col("prev") > 0) & (F.col("prev") != F.col("value")), F.lit(False)).alias("moves"))
    fits = (F.col("kind") != "stale_repeat") | F.col("moves")
    pool = cells.groupBy("entity").agg(F.bool_or("moves").alias("moves")).crossJoin(F.broadcast(table)).where(fits)
    order = Window.partitionBy(*SCENARIO).orderBy(_draw(seed, "entity"), "entity")
    drawn = pool.withColumn("__n", F.row_number().over(order)).where(F.col("__n") <= p.planted).select(*SCENARIO, "entity")
    some = cells.join(F.broadcast(drawn), "entity").where(fits)  # at most scenarios x planted rows are drawn
    return some.groupBy(*SCENARIO, "entity").agg(F.min(F.struct(_draw(seed, "entity", "period").alias("h"), "period")).alias("s")).select(*SCENARIO, "entity", "s.period")


def break_series(series: DataFrame, picks: DataFrame, seed: int, p: Params, whole: bool = False) -> DataFrame:
    """Each scenario's panel with its errors: kind, trial and the series' columns. Only picked entities, unless ``whole``: an error changes no other entity's
    verdicts, and what they raise on the clean panel never counts."""
    at = picks.withColumnRenamed("period", "__at")
    clean = series.withColumn("prev", F.lag("value").over(in_order()))
    if whole:
        df = clean.crossJoin(F.broadcast(picks.select(*SCENARIO).distinct())).join(at, [*SCENARIO, "entity"], "left")
    else:
        df = clean.join(at, "entity")
    hit = F.col("period") == F.col("__at")
    sign = F.when(F.substring(_draw(seed, "entity", "period"), 1, 1) < "8", -1.0).otherwise(1.0)
    v, k = F.col("value"), F.col("kind")
    broken = (
        F.when((k == "feed_stops") & F.col("period").between(F.col("__at"), F.lit(p.monitor[1])), 0.0).when(~F.coalesce(hit, F.lit(False)), v)
        .when(k == "spike_x10", v * 10.0).when(k == "units_x1000", v * 1000.0).when(k == "drop_to_zero", 0.0).when(k == "misstate_25pct", v * (1.0 + sign * p.misstatement)).when(k == "stale_repeat", F.col("prev")).otherwise(v)
    )
    return df.withColumn("value", broken).drop("prev", "__at")


_MARK = "\x1f"


def keyed(broken: DataFrame) -> DataFrame:
    """Scenario and entity as one key, so that every job that works by entity works by scenario too."""
    return broken.withColumn("entity", F.concat_ws(_MARK, "kind", F.col("trial").cast("string"), "entity")).drop(*SCENARIO)


def unkeyed(df: DataFrame) -> DataFrame:
    part = F.split("entity", _MARK, 3)
    return df.withColumns({"kind": part[0], "trial": part[1].cast("int"), "entity": part[2]})


def system_found(series: DataFrame, points: DataFrame, p: Params) -> DataFrame:
    """Keys that the system flags: alerts, and stale repeats in the monitor window."""
    stale = series.select("*", rule_stale_repeat("value", "entity").alias("__s")).where(F.col("__s") & F.col("period").between(*p.monitor))
    return points.where("rule <> ''").select(*KEY).union(stale.select(*KEY)).distinct()


CLEAN = ""  # the kind under which the panel without errors travels with the broken ones


def score_methods(series: DataFrame, picks: DataFrame, methods, seed: int, p: Params, flows: list[str], whole: bool = False) -> DataFrame:
    """method, kind, trial: injected, charted, detected, collateral, silent_pct, surfaced_pct. The clean panel is one scenario more, so one pass judges all panels by all
    methods; without ``whole`` only picked entities are in any. Panels and points are written to the checkpoint folder: jobs run at once."""
    methods = {m: METHODS[m] for m in methods}
    keys = ["method", *SCENARIO, *KEY]
    if not whole:  # at most scenarios x planted entities are picked
        series = cut_lineage(series.join(F.broadcast(picks.select("entity").distinct()), "entity", "left_semi"))
    clean = series.withColumns({"kind": F.lit(CLEAN), "trial": F.lit(0)})
    panels = cut_lineage(keyed(break_series(series, picks, seed, p, whole).unionByName(clean)))
    points = cut_lineage(unkeyed(all_points(panels, p, methods)).select(*keys, "status", "rule"))
    each = F.explode(F.array(*[F.lit(m) for m in methods])).alias("method")
    mark = lambda df, **on: df.select(*keys, *(on.get(c, F.lit(False)).alias(c) for c in ("truth", "found", "covered")))
    stale = panels.select("*", rule_stale_repeat("value", "entity").alias("__s")).where(F.col("__s") & F.col("period").between(*p.monitor))
    rows = mark(points.where("status = 'charted' or rule <> ''"), covered=F.col("status") == "charted", found=F.col("rule") != "")
    rows = rows.unionByName(mark(unkeyed(stale).select("*", each), found=F.lit(True))).unionByName(mark(picks.select("*", each), truth=F.lit(True)))
    flags = rows.groupBy(*keys).agg(*(F.bool_or(c).alias(c) for c in ("truth", "found", "covered")))
    cell = Window.partitionBy("method", *KEY)
    flags = flags.withColumn("clean", F.bool_or((F.col("kind") == CLEAN) & F.col("found")).over(cell)).where(F.col("kind") != CLEAN)
    hit = F.col("truth") & F.col("covered")
    out = flags.groupBy("method", *SCENARIO).agg(F.count_if("truth").alias("injected"), F.count_if(hit).alias("charted"), F.count_if(hit & F.col("found")).alias("detected"), F.count_if(F.col("found") & ~hit & ~F.col("clean")).alias("collateral"))
    seen = feed_visibility(series, picks.select("*", each), points, flags.where("found"), lifecycle_incidents(zero_periods(panels, flows), p), p)
    return out.where(F.col("injected") > 0).join(seen, ["method", *SCENARIO], "left")


def score_trials(series: DataFrame, picks: DataFrame, method: str, seed: int, p: Params, flows: list[str], whole: bool = False) -> DataFrame:
    """``score_methods`` of one method."""
    return score_methods(series, picks, (method,), seed, p, flows, whole)


def feed_visibility(series: DataFrame, picks: DataFrame, points: DataFrame, found: DataFrame, lifecycle: DataFrame, p: Params) -> DataFrame:
    """Of stops of two periods or more in entities with a last row: % charted as in control there, % surfaced there, by a flag or (methods that know them) an incident
    of the feed's life that reaches it. picks: by method; lifecycle: incidents of keyed panels."""
    end, on = p.monitor[1], ["method", *SCENARIO, "entity"]
    last = series.where(F.col("period") == end).select("entity").distinct()
    stops = picks.where((F.col("kind") == "feed_stops") & (F.col("period") <= end - 1)).select(*on).join(last, "entity", "left_semi")
    calm = points.where((F.col("status") == "charted") & (F.col("period") == end) & (F.col("rule") == "")).select(*on).withColumn("calm", F.lit(True))
    knows = F.explode(F.array(*[F.lit(n) for n, m in METHODS.items() if m.lifecycle])).alias("method")
    live = unkeyed(lifecycle.where(F.col("last_period") >= end).select("entity")).select("*", knows).select(*on)
    loud = found.where(F.col("period") == end).select(*on).union(live).distinct().withColumn("loud", F.lit(True))
    return stops.join(calm, on, "left").join(loud, on, "left").groupBy("method", *SCENARIO).agg((100.0 * F.count_if("calm") / F.count(F.lit(1))).alias("silent_pct"), (100.0 * F.count_if("loud") / F.count(F.lit(1))).alias("surfaced_pct"))


def recall_report(scores: DataFrame) -> DataFrame:
    """Means over trials by method and kind."""
    recall = 100.0 * F.col("detected") / F.greatest("charted", F.lit(1))
    e2e = 100.0 * F.col("detected") / F.greatest("injected", F.lit(1))
    r1 = lambda c: F.bround(c, 1)
    return scores.groupBy("method", "kind").agg(
        F.count(F.lit(1)).alias("trials"), r1(F.avg("injected")).alias("injected_per_trial"), r1(F.avg("charted")).alias("charted_per_trial"), r1(F.avg("detected")).alias("detected_per_trial"),
        r1(F.avg(recall)).alias("recall_pct_mean"), r1(F.min(recall)).alias("recall_pct_min"), r1(F.max(recall)).alias("recall_pct_max"), r1(F.avg(e2e)).alias("e2e_recall_pct_mean"),
        r1(F.avg("collateral")).alias("collateral_per_trial"), r1(F.avg("silent_pct")).alias("feed_silent_end_pct"), r1(F.avg("surfaced_pct")).alias("feed_surfaced_end_pct"),
    )


def example_misses(series: DataFrame, picks: DataFrame, method: str, seed: int, p: Params, flows: list[str], n: int = 5) -> DataFrame:
    """Up to n charted errors of each kind that went unnoticed, in order of trial, entity and period."""
    broken = keyed(break_series(series, picks, seed, p))
    points = method_points(broken, method, p)
    hit = unkeyed(points.where("status = 'charted'").select(*KEY).join(system_found(broken, points, p), KEY, "left_anti"))
    missed = picks.join(hit, [*SCENARIO, *KEY], "left_semi")
    order = Window.partitionBy("kind").orderBy("trial", "entity", "period")
    top = missed.withColumn("n", F.row_number().over(order)).where(F.col("n") <= n)
    listed = F.array_sort(F.collect_list(F.struct("n", F.format_string("%s FY%d", "entity", "period").alias("s"))))
    return top.groupBy("kind").agg(F.array_join(F.transform(listed, lambda s: s["s"]), "; ").alias("example_misses"))


def evaluate_methods(series: DataFrame, split: str, p: Params, flows: list[str], kinds=ERROR_KINDS, methods=tuple(METHODS)) -> DataFrame:
    """Recall, collateral and visibility of every method on the same broken panels: scenario and method are part of the key, nothing is looped over."""
    series, seed = stored(series), p.seeds[split]
    picks = cut_lineage(pick_cells(series, scenarios(series.sparkSession, p, kinds), seed, p))
    return recall_report(score_methods(series, picks, methods, seed, p, flows))


def evaluation_pivot(report: DataFrame, metric: str, methods=tuple(METHODS)) -> DataFrame:
    return report.groupBy("kind").pivot("method", list(methods)).agg(F.first(metric))


# labels


def attach_labels(alerts: DataFrame, labels: DataFrame) -> DataFrame:
    return alerts.join(labels.select(*KEY, "label", "note"), KEY, "left").na.fill("", ["label", "note"])


def merge_label_sheet(alerts: DataFrame, sheet: DataFrame) -> DataFrame:
    """Current alerts with the labels they had, and old rows that no longer alert."""
    columns = [*KEY, "robust_z", "severity", "change_pct", "rule", "currently_alerting", "explanation", "label", "note"]
    now = alerts.withColumns({"change_pct": X.change_pct(F.col("value")), "robust_z": F.bround("robust_z", 1), "currently_alerting": F.lit(True)})
    gone = sheet.join(now, KEY, "left_anti").withColumn("currently_alerting", F.lit(False))
    return attach_labels(now, sheet).select(*columns).unionByName(gone.select(*columns)).na.fill("", ["label", "note"])


def label_sheet_order(sheet: DataFrame) -> DataFrame:
    return sheet.orderBy(F.desc("currently_alerting"), F.desc(F.abs("robust_z")), *KEY)


def label_progress(sheet: DataFrame) -> DataFrame:
    live, done = F.col("currently_alerting"), F.col("label") != ""
    return sheet.agg(F.count_if(live).alias("live"), F.count_if(live & done).alias("labelled"), F.count_if(live & ~done).alias("to_do"), *(F.count_if(live & (F.col("label") == x)).alias(f"n_{x}") for x in ("investigate", "explained", "noise")), F.count_if(~live).alias("kept"))


def precision_report(labelled: DataFrame, p: Params) -> DataFrame:
    """Strict and lenient precision over labelled alerts; precision at n only if the top n exist and are all labelled."""
    top = labelled.orderBy(F.desc(F.abs("robust_z")), *KEY).limit(p.precision_at)
    done, good, fair = F.col("label") != "", F.col("label") == "investigate", F.col("label").isin("investigate", "explained")
    share = lambda a, b: F.bround(100.0 * F.try_divide(a, b), 1)
    n = F.count_if(done)
    whole = labelled.agg(n.alias("alerts_labelled"), F.count_if(~done).alias("alerts_unlabelled"), share(F.count_if(good), n).alias("precision_strict"), share(F.count_if(fair), n).alias("precision_lenient"))
    first = top.agg(F.when((F.count(F.lit(1)) == p.precision_at) & (n == p.precision_at), share(F.count_if(good), n)).alias(f"precision_at_{p.precision_at}"))
    return whole.crossJoin(first)  # one row each


def alert_load(alerts: DataFrame, incidents: DataFrame, p: Params) -> DataFrame:
    years = p.monitor[1] - p.monitor[0] + 1
    a = alerts.agg(F.count(F.lit(1)).alias("alerts"), F.bround(F.count(F.lit(1)) / F.lit(float(years)), 1).alias("alerts_per_period"), F.count_if(F.col("severity") == "high").alias("alerts_high"))
    return a.crossJoin(incidents.agg(F.count(F.lit(1)).alias("incidents"), F.bround(F.count(F.lit(1)) / F.lit(float(years)), 1).alias("incidents_per_period")))  # one row each


# ledger


def upsert_ledger(ledger: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """New rows replace old ones of the same key; doing it twice changes nothing."""
    return ledger.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new, allowMissingColumns=True)


def ledger_rows(report: DataFrame, summary: DataFrame, version: str, split: str, p: Params, note: str = "", kinds=ERROR_KINDS, methods=METHODS) -> DataFrame:
    """A wide row a method: its configuration, alarms and coverage on the clean panel (``summary``: rows of method_summary), recall_, e2e_ and collateral_ of
    each kind, and how stopped feeds show."""
    means = {"recall": "recall_pct_mean", "e2e": "e2e_recall_pct_mean", "collateral": "collateral_per_trial"}
    wide = report.groupBy("method").agg(
        *(F.max(F.when(F.col("kind") == k, F.col(c))).alias(f"{m}_{k}") for m, c in means.items() for k in kinds),
        *(F.max(F.when(F.col("kind") == "feed_stops", F.col(c))).alias(c) for c in ("feed_silent_end_pct", "feed_surfaced_end_pct")),
    )
    by_method = lambda f: F.create_map(*[F.lit(x) for n, m in methods.items() for x in (n, f(m))])[F.col("method")]
    settings = {
        "seed": F.lit(p.seeds[split]), "baseline": by_method(lambda m: m.baseline), "window_periods": F.when(by_method(lambda m: m.baseline) == "rolling", p.window), "policy": by_method(lambda m: m.policy), "lifecycle": by_method(lambda m: m.lifecycle),
        "sigmas": F.lit(p.sigmas), "min_points": F.lit(p.min_points), "note": F.lit(note),
    }
    return wide.join(summary.drop("excluded_reasons"), "method", "left").select(F.lit(version).alias("version"), F.lit(split).alias("split"), "*", *(v.alias(k) for k, v in settings.items()))


def ledger_matrix(ledger: DataFrame, metric: str, methods=tuple(METHODS), kinds=ERROR_KINDS) -> DataFrame:
    """split and kind by method of one metric."""
    long = ledger.unpivot(["split", "method"], [f"{metric}_{k}" for k in kinds], "kind", "v").withColumn("kind", F.substr("kind", F.lit(len(metric) + 2)))
    return long.groupBy("split", "kind").pivot("method", list(methods)).agg(F.first("v"))


def check_reproduction(report: DataFrame, ledger: DataFrame, version: str, split: str, method: str = "v1.1-reference", tolerance: float = 1e-9) -> DataFrame:
    """kind, now, stored, status: each kind's recall beside that of the stored row. A kind without both numbers, as all are where no row is stored, is
    "not checked"; then what is compared with this method can't be trusted yet."""
    old = ledger.where((F.col("version") == version) & (F.col("split") == split) & (F.col("method") == method))
    columns = [c for c in ledger.columns if c.startswith("recall_")]
    long = old.unpivot([], columns, "kind", "stored").withColumn("kind", F.substr("kind", F.lit(8)))
    now = report.where(F.col("method") == method).select("kind", F.col("recall_pct_mean").alias("now"))
    apart = F.abs(F.col("now") - F.col("stored"))
    return now.join(long, "kind", "full").select("kind", "now", "stored", F.when(apart.isNull(), "not checked").when(apart > tolerance, "differs").otherwise("reproduced").alias("status"))


# comparisons


def fixed_vs_rolling(alerts: DataFrame, a: str = "v2-fixed", b: str = "v2-rolling") -> DataFrame:
    """Alerts that exactly one of two methods raises."""
    columns = [*KEY, "only_in", "rule", "severity", "robust_z", "value", "baseline_span", "explanation"]
    x, y = (alerts.where(F.col("method") == m) for m in (a, b))
    only = lambda p, q, m: p.join(q.select(*KEY), KEY, "left_anti").withColumn("only_in", F.lit(m)).select(*columns)
    return only(x, y, a).unionByName(only(y, x, b))


def classify_difference(diff: DataFrame, points: DataFrame, a: str = "v2-fixed", b: str = "v2-rolling") -> DataFrame:
    charted = points.where((F.col("method") == a) & (F.col("status") == "charted")).select("entity").distinct().withColumn("__c", F.lit(True))
    why = F.when((F.col("only_in") == b) & F.col("__c").isNull(), X.COVERAGE).when(F.col("only_in") == b, X.SENSITIVITY).otherwise(X.ADAPTATION)
    return diff.join(charted, "entity", "left").withColumn("why", why).drop("__c")


def method_coverage(points: DataFrame) -> DataFrame:
    """Entities monitored and excluded, observations and dormant ones by method, and why entities are excluded: each one's most frequent status, ties by name."""
    status = points.groupBy("method", "entity", F.substring_index("status", ":", 1).alias("reason")).agg(F.count(F.lit(1)).alias("k"), F.count_if(F.col("status") == "charted").alias("n"), F.count_if(F.col("status") == "dormant").alias("d"))
    by = status.groupBy("method", "entity").agg(F.sum("n").alias("n"), F.sum("d").alias("d"), F.min(F.struct((-F.col("k")).alias("o"), "reason"))["reason"].alias("reason"))
    monitored = F.col("n") > 0
    kinds = by.groupBy("method", monitored.alias("monitored"), F.when(~monitored, F.col("reason")).alias("reason")).agg(F.count(F.lit(1)).alias("k"), F.sum("n").alias("n"), F.sum("d").alias("d"))
    entities = lambda on: F.coalesce(F.sum(F.when(on, F.col("k"))), F.lit(0))
    of = F.array_sort(F.collect_list(F.when(~F.col("monitored"), F.struct((-F.col("k")).alias("o"), "reason", "k"))))
    text = F.array_join(F.transform(of, lambda s: F.concat_ws(": ", s["reason"], s["k"].cast("string"))), ", ")
    return kinds.groupBy("method").agg(entities(F.col("monitored")).alias("entities_monitored"), F.sum("n").alias("observations_monitored"), entities(~F.col("monitored")).alias("entities_excluded"), F.sum("d").alias("dormant_observations"), text.alias("excluded_reasons"))


def alarm_profile(alerts: DataFrame, incidents: DataFrame) -> DataFrame:
    once = alerts.groupBy("method", "entity", "period").agg(F.count(F.lit(1)).alias("a"), F.count_if(F.col("severity") == "high").alias("h"), F.count_if(F.col("rule") == "sustained_shift").alias("s"))
    by = once.groupBy("method", "entity").agg(F.count("period").alias("k"), *(F.sum(c).alias(c) for c in "ahs"))
    a = by.groupBy("method").agg(F.sum("a").alias("alerts"), F.sum("h").alias("alerts_high"), F.sum("s").alias("shift_alerts"), F.count_if(F.col("k") >= 3).alias("recurring_entities"))
    stat = F.col("source") == "statistical"
    i = incidents.groupBy("method").agg(F.count_if(stat).alias("incidents"), F.count_if(stat & (F.col("kind") == "persistent")).alias("persistent_incidents"), F.count_if(~stat).alias("lifecycle_incidents"))
    return a.join(i, "method", "full").na.fill(0)


def method_summary(alerts: DataFrame, incidents: DataFrame, points: DataFrame) -> DataFrame:
    return method_coverage(points).join(alarm_profile(alerts, incidents), "method", "left").na.fill(0)
