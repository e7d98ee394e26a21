"""The chronological engine: every monitored period is judged by a baseline that ends before it.

Rows without a level (null or NaN) don't count anywhere: they are no baseline years, no neighbours and not judged. Of rows that repeat an entity and period
the one with the greatest level counts. Both hold for all engines, as all start from ``cells``.

Baselines without memory (fixed, or rolling over everything) are window columns over one partitioning by entity. The confirming policy lets a verdict decide the
next baseline, so periods are walked in order, each for a block of series at once and for all methods that are asked; tasks stream their series, so no partition is held whole.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.logs import ln, ln_each, ln_of
from ..functions.text import BASELINE_NOTE, explain_alert
from ..params import METHODS, Method, Params
from ..sources.io import stored
from .charts import build_chart, classify_rule, clip_level, robust_z, select_alerts, yoy_log_growth_v1
from .incidents import attach_incident_id, build_incidents, build_incidents_of_methods, zero_periods

CHARTED, NO_PRIOR, DORMANT, NONE, FEW, FLAT = range(6)
CELLS = 1 << 19  # series times periods that a walk holds at once
RAW = "entity string, period int, level double, code int, value double, center double, sigma double, n_baseline long, n_held_out long, n_lifecycle_skipped long, base_first int, base_last int, rule string, run_z double"
POINT_COLUMNS = ["entity", "period", "level", "status", "value", "center", "lcl", "ucl", "sigma", "robust_z", "n_baseline", "n_held_out", "n_lifecycle_skipped", "baseline_span", "rule", "severity", "explanation"]


def cells(series: DataFrame) -> DataFrame:
    """entity, period, value: one row a period that has a level."""
    w = Window.partitionBy("entity").orderBy("period", "value")
    live = series.where(F.col("value").isNotNull() & ~F.isnan("value")).select("entity", F.col("period").cast("int").alias("period"), F.col("value").cast("double").alias("value"))
    return live.withColumn("__next", F.lead("period").over(w)).where(F.col("__next").isNull() | (F.col("__next") != F.col("period"))).drop("__next")


def gap_aware(series: DataFrame) -> DataFrame:
    """x, x_prev, has_growth and touches_zero of each row with a level; a missing period is never bridged."""
    w = Window.partitionBy("entity").orderBy("period", "value")
    x = clip_level(F.col("value"))
    df = cells(series).select("entity", "period", "value", F.col("value").alias("level"), x.alias("x"), (F.col("value") <= 0).alias("zero"))
    near = F.coalesce(F.lag("period").over(w) == F.col("period") - 1, F.lit(False))
    df = df.withColumns({"has_growth": near, "x_prev": F.when(near, F.lag("x").over(w)), "zero_prev": F.coalesce(near & F.lag("zero").over(w), F.lit(False))})
    return df.withColumn("touches_zero", F.col("has_growth") & (F.col("zero") | F.col("zero_prev"))).drop("value")


def _ratio(c: Column, x: Column, x_prev: Column) -> Column:
    return (x + c) / (x_prev + c)


def _growth(c: Column, x: Column, x_prev: Column) -> Column:
    return ln(_ratio(c, x, x_prev))


def _array_median(a: Column) -> Column:
    """The median of an array of numbers; null if it is empty."""
    a, n = F.sort_array(a), F.size(a)
    half = (n / 2).cast("int")
    return F.when(n > 0, (F.element_at(a, F.greatest(n - half, F.lit(1))) + F.element_at(a, half + 1)) / 2)


def _fit(ratios: pa.Array) -> pa.Array:
    """Of each list of ratios: the median of their logarithms, and that of the distances from it; null if it is empty."""
    size = pc.list_value_length(ratios).fill_null(0).to_numpy(zero_copy_only=False)
    on = np.arange(size.max(initial=0)) < size[:, None]
    growth = np.zeros(on.shape)
    growth[on] = ln_of(ratios.flatten().to_numpy(zero_copy_only=False))
    center = _middle(growth, on)
    return pa.StructArray.from_arrays([pa.array(v, mask=size == 0) for v in (center, _middle(np.abs(growth - center[:, None]), on))], ["center", "off"])


def _fixed_baseline(facts: DataFrame, p: Params) -> DataFrame:
    """One fit an entity, carried to all its rows: nothing of it depends on the judged period."""
    entity = Window.partitionBy("entity")
    ordered = entity.orderBy("period")
    based = facts.withColumn("__in", F.col("usable") & F.col("period").between(*p.baseline))
    needed = F.col("__in") | F.coalesce(F.lead("__in").over(ordered) & (F.lead("period").over(ordered) == F.col("period") + 1), F.lit(False))  # levels at both ends of a change
    fit = based.withColumn("c", F.greatest(F.lit(p.c_floor), p.c_fraction * F.median(F.when(needed, F.col("x"))).over(entity)))
    fit = fit.withColumn("__g", F.when(F.col("__in"), _growth(F.col("c"), F.col("x"), F.col("x_prev"))))
    when = F.when(F.col("__in"), F.col("period"))
    fit = fit.withColumns({"center": F.median("__g").over(entity), "n_baseline": F.count("__g").over(entity), "base_first": F.min(when).over(entity), "base_last": F.max(when).over(entity)})
    return fit.withColumn("sigma", F.median(F.abs(F.col("__g") - F.col("center"))).over(entity) * p.mad_scale).where(F.col("period").between(*p.monitor)).drop("__in", "__g")


def _rolling_baseline(facts: DataFrame, p: Params) -> DataFrame:
    """The last ``window`` usable rows before each judged one. Rows are numbered by the usable ones before them, so that a range of these numbers holds just those,
    however many others lie between; no row meets more than ``window`` of them."""
    before = Window.partitionBy("entity").orderBy("period").rowsBetween(Window.unboundedPreceding, -1)
    last = Window.partitionBy("entity").orderBy("__k").rangeBetween(-p.window, -1)
    linked = F.coalesce(F.lag("usable").over(Window.partitionBy("entity").orderBy("period")), F.lit(False))  # the level before a usable row is that of a usable row too
    some = facts.withColumns({"__k": F.coalesce(F.sum(F.col("usable").cast("long")).over(before), F.lit(0)), "__l": linked})
    some = some.withColumn("__b", F.collect_list(F.when(F.col("usable"), F.struct(F.col("period").alias("y"), "x", "x_prev", F.col("__l").alias("l")))).over(last)).where(F.col("period").between(*p.monitor))
    levels = F.flatten(F.transform("__b", lambda s, i: F.when((i > 0) & s["l"], F.array(s["x"])).otherwise(F.array(s["x"], s["x_prev"]))))  # each level once
    some = some.withColumn("c", F.greatest(F.lit(p.c_floor), p.c_fraction * _array_median(levels)))
    some = some.withColumn("__f", F.arrow_udf(_fit, "center double, off double")(F.transform("__b", lambda s: _ratio(F.col("c"), s["x"], s["x_prev"]))))
    years = F.transform("__b", lambda s: s["y"])
    fit = {"center": F.col("__f")["center"], "sigma": F.col("__f")["off"] * p.mad_scale, "n_baseline": F.size("__b").cast("long"), "base_first": F.array_min(years), "base_last": F.array_max(years)}
    return some.withColumns(fit).drop("__k", "__l", "__b", "__f")


def select_baseline(facts: DataFrame, p: Params, baseline: str) -> DataFrame:
    """The monitored rows of facts (with ``usable``) and the fit of each one's baseline: c, center, sigma, n_baseline, base_first, base_last; for policies without memory."""
    return (_fixed_baseline if baseline == "fixed" else _rolling_baseline)(facts, p)


def _as_it_is(batches):
    yield from batches


def judge_set_based(series: DataFrame, p: Params, baseline: str, lifecycle: bool) -> DataFrame:
    """The raw verdicts (schema ``RAW``) without a memory: what a walk would give for fixed baselines or for include_all. One exchange, by entity."""
    lately = Window.partitionBy("entity").orderBy("period").rangeBetween(1 - p.run_length, 0)
    facts = gap_aware(series).withColumn("usable", F.col("has_growth") & ~(F.col("touches_zero") & F.lit(lifecycle)))
    facts = facts.withColumn("run", F.collect_list(F.when(F.col("usable"), F.struct("x", "x_prev"))).over(lately))
    if lifecycle and baseline == "fixed":
        skipped = F.count_if(F.col("touches_zero") & F.col("period").between(*p.baseline)).over(Window.partitionBy("entity"))
    else:
        skipped = F.lit(0).cast("long")
    j = select_baseline(facts.withColumn("n_lifecycle_skipped", skipped), p, baseline)
    code = (
        F.when(~F.col("has_growth"), NO_PRIOR).when(F.lit(lifecycle) & F.col("zero") & F.col("zero_prev"), DORMANT).when(F.col("n_baseline") == 0, NONE)
        .when(F.col("n_baseline") < p.min_points, FEW).when(~(F.col("sigma") > 0), FLAT).otherwise(CHARTED)
    )
    j = j.withColumn("code", code)
    on, c = F.col("code") == CHARTED, F.col("c")
    j = j.withColumn("value", F.when(on, _growth(c, F.col("x"), F.col("x_prev"))))
    off = F.col("value") - F.col("center")
    beyond = F.coalesce(F.abs(off) > p.sigmas * F.col("sigma"), F.lit(False))
    j = j.withColumn("__run", ln_each(F.transform("run", lambda s: _ratio(c, s["x"], s["x_prev"]))))
    gaps = F.transform("__run", lambda g: g - F.col("center"))
    shift = on & (F.size("run") == p.run_length) & (F.forall(gaps, lambda d: d > 0) | F.forall(gaps, lambda d: d < 0))
    middle = _array_median(F.transform(gaps, lambda d: F.abs(d)))
    rule = classify_rule(on & beyond, shift)
    keep = lambda x: F.when(on, F.col(x))
    raw = j.select(F.col("entity").cast("string").alias("entity"), "period", "level", "code", "value", keep("center").alias("center"), keep("sigma").alias("sigma"), "n_baseline", F.lit(0).cast("long").alias("n_held_out"), "n_lifecycle_skipped", "base_first", "base_last", rule.alias("rule"), F.when(rule == "sustained_shift", middle / F.col("sigma")).alias("run_z"))
    return raw.mapInArrow(_as_it_is, RAW)  # else Spark writes these columns' whole expressions into each argument of the Python functions that come after


def _middle(values: np.ndarray, on: np.ndarray) -> np.ndarray:
    """The median of the marked values of each row; 0 where none is."""
    n = on.sum(1)
    ordered = np.sort(np.where(on, values, np.inf), axis=1)
    row = np.arange(len(n))
    both = (ordered[row, np.maximum(n - 1, 0) // 2] + ordered[row, np.minimum(n // 2, max(values.shape[1] - 1, 0))]) / 2 if values.shape[1] else np.zeros(len(n))
    return np.where(n > 0, both, 0.0)


def _kept_out(sign: np.ndarray, now: int) -> np.ndarray:
    """Cells of signed verdicts (series by period) that the baseline of column ``now`` does without: reversed by a neighbour before it, or the newest."""
    known = sign.copy()
    known[:, now:] = 0
    undone = np.zeros(sign.shape, bool)
    undone[:, 1:] = known[:, 1:] * known[:, :-1] < 0
    undone[:, :-1] |= undone[:, 1:]
    undone[:, now - 1 : now] |= known[:, now - 1 : now] != 0
    return undone & (known != 0)


def _columns(which: np.ndarray, period: np.ndarray, dense: int) -> np.ndarray:
    """The column of each cell against that of period ``dense``, where columns begin that are periods. Before it only those that a series has get a column, and one
    empty column stands for a gap of any length: one far period makes no wide array. Cells are in order of series and period."""
    col = (period - dense).astype(np.int64)
    old = np.flatnonzero(period < dense)
    if len(old):
        last = np.r_[which[old][1:] != which[old][:-1], True]
        step = np.where(np.where(last, dense, np.r_[period[old][1:], dense]) - period[old] == 1, 1, 2)
        whole = np.cumsum(step[::-1])[::-1]  # to the end of all
        ends = np.flatnonzero(last)
        rest = np.r_[whole, 0][ends + 1]
        col[old] = -(whole - rest[np.searchsorted(ends, np.arange(len(old)))])
    return col


def walk_many(which: np.ndarray, period: np.ndarray, level: np.ndarray, p: Params, m: Method) -> dict[str, np.ndarray]:
    """Many series at once, one period after the other: columns of schema ``RAW`` with the number of the series in place of its entity. Cells are in order of series
    and period; of cells that repeat a period the last one counts."""
    near = period <= max(p.monitor[1], p.baseline[1])
    which, period, level = which[near], period[near], level[near]
    once = np.r_[(which[1:] != which[:-1]) | (period[1:] != period[:-1]), True] if len(which) else np.zeros(0, bool)
    which, period, level = which[once], period[once], level[once]
    dense = min(p.monitor[0] - p.run_length, p.monitor[0] - 1)
    at = _columns(which, period, dense)
    ahead = 1 - int(at.min(initial=0))  # the first column stays empty, so that every period has one before it
    n, span = int(which.max(initial=-1)) + 1, max(int(p.monitor[1]), p.baseline[1]) - dense + 1 + ahead
    raw, when = np.full((n, span), np.nan), np.full((n, span), -(2**31), np.int64)
    raw[which, at + ahead], when[which, at + ahead] = level, period
    here = ~np.isnan(raw)
    x = np.where(here, np.maximum(raw, 0.0), 0.0)
    before = np.zeros_like(x)
    before[:, 1:] = x[:, :-1]
    zero = here & (raw <= 0)
    grows, still = here.copy(), zero.copy()
    grows[:, 0] = still[:, 0] = False
    grows[:, 1:] &= here[:, :-1]
    still[:, 1:] &= zero[:, :-1]
    idle = grows.copy()
    idle[:, 1:] &= zero[:, 1:] | zero[:, :-1]
    asleep = idle if m.lifecycle else np.zeros_like(idle)
    sign = np.zeros(raw.shape, np.int8)
    column = np.arange(raw.shape[1])
    in_base = (when >= p.baseline[0]) & (when <= p.baseline[1])
    out: list[dict[str, np.ndarray]] = []
    for t in range(p.monitor[0], p.monitor[1] + 1):
        i = t - dense + ahead
        s = np.flatnonzero(here[:, i])
        if not len(s):
            continue
        pool = grows[s] & (in_base[s] if m.baseline == "fixed" else column < i)
        held = pool & ~asleep[s] & (_kept_out(sign, i)[s] if m.policy != "include_all" else False)
        chosen = pool & ~asleep[s] & ~held
        seen = pool
        if m.baseline != "fixed":  # back in time until the window is full
            found = np.cumsum(chosen[:, ::-1], axis=1)[:, ::-1]
            seen, chosen = pool & (found - chosen < p.window), chosen & (found <= p.window)
        n_base = chosen.sum(1)
        levels = chosen.copy()
        levels[:, :-1] |= chosen[:, 1:]
        c = np.maximum(p.c_floor, p.c_fraction * _middle(x[s], levels))[:, None]
        growth = ln_of((x[s] + c) / (before[s] + c))
        center = _middle(growth, chosen)
        sigma = _middle(np.abs(growth - center[:, None]), chosen) * p.mad_scale
        code = np.select([~grows[s, i], still[s, i] if m.lifecycle else np.zeros(len(s), bool), n_base == 0, n_base < p.min_points, ~(sigma > 0)], [NO_PRIOR, DORMANT, NONE, FEW, FLAT], CHARTED)
        on, value = code == CHARTED, growth[:, i]
        beyond = on & ((value > center + p.sigmas * sigma) | (value < center - p.sigmas * sigma))
        sign[s[beyond], i] = np.where(value > center, 1, -1)[beyond]
        run_z, shifted = np.zeros(len(s)), np.zeros(len(s), bool)
        if i + 1 >= p.run_length:
            run = slice(i - p.run_length + 1, i + 1)
            off = growth[:, run] - center[:, None]
            shifted = on & ~beyond & (grows[s, run] & ~asleep[s, run]).all(1) & ((off > 0).all(1) | (off < 0).all(1))
            run_z = np.median(np.abs(off), axis=1)
        newest = raw.shape[1] - 1 - np.argmax(chosen[:, ::-1], axis=1)
        with np.errstate(divide="ignore", invalid="ignore"):
            run_z = run_z / sigma
        out.append({
            "which": s, "period": np.full(len(s), t), "level": raw[s, i], "code": code, "value": np.where(on, value, np.nan), "center": np.where(on, center, np.nan), "sigma": np.where(on, sigma, np.nan), "n_baseline": n_base,
            "n_held_out": (held & seen).sum(1), "n_lifecycle_skipped": (pool & seen & asleep[s]).sum(1), "base_first": np.where(n_base > 0, when[s, np.argmax(chosen, axis=1)], -(2**31)), "base_last": np.where(n_base > 0, when[s, newest], -(2**31)),
            "rule": np.where(beyond, "beyond_limits", np.where(shifted, "sustained_shift", "")).astype(object), "run_z": np.where(shifted, run_z, np.nan),
        })
    names = ["which", *(c.split()[0] for c in RAW.split(", ")[1:])]
    return {c: np.concatenate([o[c] for o in out]) if out else np.zeros(0) for c in names}


def raw_batch(entity, rows: dict[str, np.ndarray]) -> pa.RecordBatch:
    """What ``walk_many`` found, as Arrow; entity: the names of the series, by number."""
    kinds = {"int": pa.int32(), "double": pa.float64(), "long": pa.int64(), "string": pa.string()}
    out = {"entity": entity.take(pa.array(rows["which"].astype(np.int64)))}
    for name, kind in (c.split() for c in RAW.split(", ")[1:]):
        v = rows[name]
        none = np.isnan(v) if kind == "double" else v == -(2**31) if name.startswith("base_") else None
        out[name] = pa.array(v.tolist() if kind == "string" else v.astype({"int": np.int32, "long": np.int64}.get(kind, np.float64)), kinds[kind], mask=none)
    return pa.record_batch(out)


def judge_walking(series: DataFrame, p: Params, m: Method) -> DataFrame:
    """The raw verdicts of any policy."""
    return walk_methods(series, p, {"": m}).drop("method")


def walk_methods(series: DataFrame, p: Params, methods: dict[str, Method]) -> DataFrame:
    """method and the raw verdicts of each: every task streams its series in order and walks some thousands of cells at a time, by all methods while it holds them."""

    def walk(batches):
        rest = None
        for batch in batches:
            if not len(batch):
                continue
            table = pa.Table.from_batches([batch]) if rest is None else pa.concat_tables([rest, pa.Table.from_batches([batch])])
            entity = table["entity"].combine_chunks()
            entity = entity if isinstance(entity, pa.Array) else pa.concat_arrays(entity.chunks)
            start = _starts(entity)
            rest = table.slice(int(start[-1]))  # the last series may go on
            yield from some(table.slice(0, int(start[-1])))
        if rest is not None:
            yield from some(rest)

    def some(table):
        if table.num_rows:
            entity = pa.concat_arrays(table["entity"].chunks)
            start = _starts(entity)
            period, level = table["period"].to_numpy().astype(np.int64), table["value"].to_numpy()
            which = np.repeat(np.arange(len(start)), np.diff(np.r_[start, table.num_rows]))
            most = int(np.diff(np.r_[start, table.num_rows]).max())
            wide = max(1, CELLS // (2 * most + int(p.monitor[1] - p.monitor[0]) + p.run_length + 2))
            for a in range(0, len(start), wide):
                mine = slice(int(start[a]), int(start[a + wide]) if a + wide < len(start) else table.num_rows)
                names = entity.take(pa.array(start[a : a + wide]))
                for name, m in methods.items():
                    rows = raw_batch(names, walk_many(which[mine] - a, period[mine], level[mine], p, m))
                    yield pa.record_batch([pa.array([name] * len(rows), pa.string()), *rows.columns], ["method", *rows.schema.names])

    live = series.where(F.col("value").isNotNull() & ~F.isnan("value")).select(F.col("entity").cast("string").alias("entity"), F.col("period").cast("int").alias("period"), F.col("value").cast("double").alias("value"))
    parts = int(series.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # by a count: the walk is worth more tasks than its bytes
    return live.repartition(parts, "entity").sortWithinPartitions("entity", "period", "value").mapInArrow(walk, "method string, " + RAW)


def _starts(entity: pa.Array) -> np.ndarray:
    """Where a new series begins in a column of sorted names."""
    same = pc.equal(entity.slice(1), entity.slice(0, max(len(entity) - 1, 0))).fill_null(True).to_numpy(zero_copy_only=False).astype(bool)
    return np.r_[0, np.flatnonzero(~same) + 1]


def point_status(p: Params) -> Column:
    """The status of a raw verdict, from its code."""
    few = F.format_string(f"insufficient_history: only %d baseline years (<{p.min_points})", F.col("n_baseline"))
    is_ = lambda k: F.col("code") == k
    return F.when(is_(NO_PRIOR), "no_prior_year").when(is_(DORMANT), "dormant").when(is_(NONE), "insufficient_history: no eligible baseline years").when(is_(FEW), few).when(is_(FLAT), "zero_mad: zero baseline variation (MAD = 0)").otherwise("charted")


def finish_points(raw: DataFrame, p: Params) -> DataFrame:
    """Statuses, limits, severities and sentences of raw verdicts."""
    n, s = F.col("n_baseline"), F.col("sigma")
    span = F.when(F.col("base_first").isNotNull(), F.concat_ws("-", F.col("base_first").cast("string"), F.col("base_last").cast("string"))).otherwise("")
    df = raw.withColumns({"status": point_status(p), "lcl": F.col("center") - p.sigmas * s, "ucl": F.col("center") + p.sigmas * s, "robust_z": robust_z(F.col("value"), F.col("center"), s), "baseline_span": span})
    severity = F.when(F.col("rule") == "beyond_limits", F.when(F.abs("robust_z") >= p.high_z, "high").otherwise("medium")).when(F.col("rule") == "sustained_shift", F.when(F.col("run_z") >= p.shift_medium_z, "medium").otherwise("low")).otherwise("")
    note = F.when(F.col("n_held_out") + F.col("n_lifecycle_skipped") > 0, F.format_string(BASELINE_NOTE, n, "n_held_out", "n_lifecycle_skipped")).otherwise("")
    text = F.when(F.col("rule") == "", "").otherwise(F.concat(explain_alert(p, "growth", F.col("baseline_span")), note))
    return df.withColumn("severity", severity).withColumn("explanation", text).select(*(c for c in ("method",) if c in raw.columns), *POINT_COLUMNS)


def refused_rows(series: DataFrame, refused: DataFrame, p: Params) -> DataFrame:
    """Monitored rows of entities without a frozen chart, with the reason as status."""
    return series.where(F.col("period").between(*p.monitor)).join(refused.select("entity", "reason"), "entity").select("entity", "period", F.col("reason").alias("status"))


def method_points(series: DataFrame, name: str, p: Params, methods: dict[str, Method] = METHODS) -> DataFrame:
    """Points of one method, with a method column."""
    m = methods[name]
    if m.engine == "frozen":
        points = build_chart(yoy_log_growth_v1(series, p), "growth", "B_growth", p, False, "growth", refused=True).drop("chart")
        extra = {"level": "double", "n_held_out": "long", "n_lifecycle_skipped": "long", "baseline_span": "string"}
        points = points.withColumns({k: F.lit(None).cast(v) for k, v in extra.items()}).select(*POINT_COLUMNS)
    elif (m.baseline == "fixed" and (m.policy == "include_all" or p.baseline[1] < p.monitor[0])) or (m.policy == "include_all" and not m.lifecycle):
        points = finish_points(judge_set_based(series, p, m.baseline, m.lifecycle), p)
    else:
        points = finish_points(judge_walking(series, p, m), p)
    return points.select(F.lit(name).alias("method"), "*")


def all_points(series: DataFrame, p: Params, methods: dict[str, Method] = METHODS) -> DataFrame:
    """Points of several methods, with a method column. Chronological ones, if there are several, are judged by one walk."""
    walked = {n: m for n, m in methods.items() if m.engine != "frozen"}
    walked = walked if len(walked) > 1 else {}
    each = [method_points(series, n, p, methods) for n in methods if n not in walked]
    if walked:
        each.append(finish_points(walk_methods(series, p, walked), p))
    return reduce(DataFrame.unionByName, each)


def run_method(series: DataFrame, name: str, p: Params, flows: list[str], methods: dict[str, Method] = METHODS) -> dict[str, DataFrame]:
    """points, alerts, incidents and zero periods of one method. Points, which the rest is made of, are written to the checkpoint folder: a job runs at once."""
    m, points, periods = methods[name], stored(method_points(series, name, p, methods)), zero_periods(series, flows)
    alerts = attach_incident_id(select_alerts(points))
    incidents = build_incidents(alerts, m.baseline == "fixed", periods if m.lifecycle else None, p).select(F.lit(name).alias("method"), "*")
    return {"points": points, "alerts": alerts, "incidents": incidents, "periods": periods}


def run_methods(series: DataFrame, p: Params, flows: list[str], methods: dict[str, Method] = METHODS) -> dict[str, DataFrame]:
    """points, alerts and incidents of all methods, with a method column, each in one pass for all of them; the series is read once and written to the checkpoint folder, as
    are the points."""
    series = stored(series)
    points = stored(all_points(series, p, methods))
    alerts = attach_incident_id(select_alerts(points), within=("method",))
    fixed, knows = ([n for n, m in methods.items() if ok(m)] for ok in (lambda m: m.baseline == "fixed", lambda m: m.lifecycle))
    return {"points": points, "alerts": alerts, "incidents": build_incidents_of_methods(alerts, fixed, knows, zero_periods(series, flows), p)}


def growth_history(series: DataFrame, p: Params, lifecycle: bool = True) -> DataFrame:
    """Baseline-era growth under the stabiliser of the first monitored period's fixed baseline."""
    facts = gap_aware(series)
    ok = F.col("has_growth") & ~(F.col("touches_zero") & F.lit(lifecycle)) & F.col("period").between(*p.baseline)
    levels = facts.where(ok).select("entity", F.explode(F.array(F.struct("period", "x"), F.struct((F.col("period") - 1).alias("period"), F.col("x_prev").alias("x")))).alias("s")).select("entity", "s.period", "s.x").distinct()
    c = levels.groupBy("entity").agg(F.greatest(F.lit(p.c_floor), p.c_fraction * F.median("x")).alias("c"))
    era = facts.where(F.col("has_growth") & F.col("period").between(p.baseline[0] + 1, p.monitor[0] - 1))
    return era.join(c, "entity").select("entity", "period", _growth(F.col("c"), F.col("x"), F.col("x_prev")).alias("value"))
