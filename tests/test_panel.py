"""The panel jobs on hand-made series."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelsentry.operators import adaptive as D
from panelsentry.operators import charts as C
from panelsentry.operators import evaluation as E
from panelsentry.operators import incidents as I
from panelsentry.operators import rules as R
from panelsentry.params import METHODS, Method, Params
from panelsentry.sources import io

P = Params()
FLOWS = ["repayments", "grants"]


def frame(spark, series, flows=1.0):
    """{entity: {period: level}} as a series; None levels are null."""
    rows = [(e, y, None if v is None else float(v), flows, flows) for e, s in series.items() for y, v in s.items()]
    return spark.createDataFrame(rows, "entity string, period int, value double, repayments double, grants double")


def wavy(last=2026, seed=0, start=2010, scale=1e8):
    rng = np.random.default_rng(seed)
    return {y: scale * math.exp(rng.normal(0, 0.15)) for y in range(start, last + 1)}


def points(spark, series, method="v2-rolling", p=P, flows=1.0):
    return {(r.entity, r.period): r for r in D.method_points(frame(spark, series, flows), method, p).collect()}


def test_gap_is_never_bridged(spark):
    s = {y: 100e6 * 1.1 ** (y - 2010) * (1 + 0.03 * (y % 3)) for y in range(2010, 2027) if y != 2022}
    got = points(spark, {"x": s})
    assert ("x", 2022) not in got and got["x", 2023].status == "no_prior_year" and got["x", 2024].status == "charted"
    v1 = {r.period: r.growth for r in C.yoy_log_growth_v1(frame(spark, {"x": s}), P).collect()}
    assert v1[2023] is not None and v1[2010] is None


def test_no_future_leakage(spark):
    s = wavy()
    a = points(spark, {"x": s})
    b = points(spark, {"x": {y: v * (7 if y >= 2023 else 1) for y, v in s.items()}})
    for y in (2020, 2021, 2022):
        assert a["x", y] == b["x", y]


def test_own_period_leaves_its_limits(spark):
    s = wavy()
    a, b = points(spark, {"x": s}), points(spark, {"x": s | {2024: s[2024] * 3}})
    assert (a["x", 2024].ucl, a["x", 2024].center) == (b["x", 2024].ucl, b["x", 2024].center)
    assert all(int(r.baseline_span.split("-")[1]) < r.period for r in a.values() if r.status == "charted")


def test_hold_out_and_readmission(spark):
    s = wavy(seed=3)
    s = {y: v * (20 if y >= 2020 else 1) for y, v in s.items()}
    got = points(spark, {"x": s})
    assert got["x", 2020].rule == "beyond_limits"
    assert (got["x", 2021].n_held_out, got["x", 2022].n_held_out) == (1, 0)


def test_passing_event_stays_out(spark):
    s = wavy(seed=4)
    s[2020] *= 50
    got = points(spark, {"x": s})
    assert got["x", 2020].rule == got["x", 2021].rule == "beyond_limits"
    assert got["x", 2023].n_held_out == 2 and got["x", 2026].n_held_out >= 0


def test_walking_equals_set_based(spark):
    rng = np.random.default_rng(1)
    series = {f"e{k}": {y: (0.0 if rng.random() < 0.08 else float(rng.normal(1e8, 4e7))) for y in range(2005, 2027) if rng.random() < 0.95} for k in range(40)}
    df = frame(spark, series)
    for m in (METHODS["v2-fixed"], METHODS["v2-rolling-naive"]):
        a = D.judge_set_based(df, P, m.baseline, m.lifecycle).collect()
        b = {(r.entity, r.period): r for r in D.judge_walking(df, P, m).collect()}
        assert len(a) == len(b)
        for r in a:
            o = b[r.entity, r.period]
            for c in r.asDict():
                x, y = r[c], o[c]
                assert (x is None) == (y is None or y != y) and (x is None or x == y or abs(x - y) < 1e-9), (c, r, o)


def test_feed_stop_is_seen_once_then_dormant(spark):
    s = {y: (v if y <= 2021 else 0.0) for y, v in wavy(seed=5).items()}
    got = points(spark, {"x": s})
    assert got["x", 2022].rule == "beyond_limits" and all(got["x", y].status == "dormant" for y in range(2023, 2027))
    assert points(spark, {"x": s}, "v2-rolling-naive")["x", 2026].status == "charted"
    res = D.run_method(frame(spark, {"x": s}), "v2-rolling", P, FLOWS)
    life = [r for r in res["incidents"].collect() if r.source == "lifecycle"]
    assert len(life) == 1 and life[0].kind == "zero_period_ongoing" and (life[0].first_period, life[0].last_period) == (2022, 2026) and life[0].severity == "info"


def test_one_period_zero_is_no_incident(spark):
    s = wavy(seed=6)
    s[2023] = 0.0
    got = points(spark, {"x": s})
    assert got["x", 2023].rule == "beyond_limits" and got["x", 2024].status == got["x", 2025].status == "charted" and got["x", 2025].n_lifecycle_skipped == 2
    assert I.lifecycle_incidents(I.zero_periods(frame(spark, {"x": s}), FLOWS), P).count() == 0


def test_zero_periods(spark):
    s = {2018: 5.0, 2019: -1.0, 2020: 0.0, 2022: 0.0, 2023: 3.0, 2024: 0.0}
    got = {r.first_period: r for r in I.zero_periods(frame(spark, {"x": s, "y": {2020: 0.0, 2021: 0.0}}, 0.0).where("entity = 'x'"), FLOWS).collect()}
    assert (got[2019].last_period, got[2019].n_periods, got[2019].has_prior_activity, got[2019].reactivated_period, got[2019].ongoing, got[2019].other_flows_zero) == (2020, 2, True, None, False, True)
    assert (got[2022].reactivated_period, got[2024].ongoing) == (2023, True)


def test_negative_is_zero_for_lifecycle_only(spark):
    s = wavy(seed=7) | {2019: -5.0} | {y: 0.0 for y in range(2020, 2027)}
    inc = D.run_method(frame(spark, {"x": s}), "v2-rolling", P, FLOWS)["incidents"].collect()
    assert [(r.source, r.first_period, r.last_period) for r in inc] == [("lifecycle", 2019, 2026)]


def test_run_rule_looks_ahead_only_in_the_frozen_chart(spark):
    rng = np.random.default_rng(2)
    level, s = 1e8, {2009: 1e8}
    for y in range(2010, 2027):
        level *= math.exp(rng.normal(0, 0.2) if y < 2019 else 0.12)
        s[y] = level
    v1 = {r.period: r for r in C.build_chart(C.yoy_log_growth_v1(frame(spark, {"x": s}), P), "growth", "B", P, False, "growth").collect()}
    v2 = points(spark, {"x": s}, "v2-fixed")
    assert v1[2020].rule == "sustained_shift" and v2["x", 2020].rule == "" and v2["x", 2026].rule == "sustained_shift"
    assert "8+ consecutive years above" in v2["x", 2026].explanation


def test_run_rule_boundaries(spark):
    side = [1] * 7 + [0] + [1] * 8 + [-1] * 8
    df = frame(spark, {"x": dict(enumerate(side))}).withColumn("center", F.lit(0.0))
    got = [r.in_run for r in C.run_rule_retroactive(df, "value", P).orderBy("period").collect()]
    assert got == [False] * 8 + [True] * 16


def test_fit_chart_refusals(spark):
    few = {y: float(y % 5) for y in range(2010, 2017)}
    flat = {y: 5.0 for y in range(2010, 2020)}
    fine = {y: float(y % 5 + 1) for y in range(2010, 2018)} | {2018: None}
    got = {r.entity: r for r in C.fit_charts(frame(spark, {"few": few, "flat": flat, "fine": fine}), "value", P).collect()}
    assert got["few"].reason == "only 7 baseline years (<8)" and got["flat"].reason == "zero baseline variation (MAD = 0)" and got["fine"].reason == "" and got["fine"].n_baseline == 8 and got["fine"].lcl == 0.0
    v = np.array([fine[y] for y in range(2010, 2018)])
    assert got["fine"].center == np.median(v) and got["fine"].sigma == pytest.approx(np.median(abs(v - np.median(v))) * 1.4826, rel=1e-12)


def test_limits_are_strict_and_severity_is_not(spark):
    base = {y: 10.0 + (1 if y % 2 else -1) for y in range(2010, 2020)}
    s = 1.4826
    df = frame(spark, {"x": base | {2020: 10 + 3 * s, 2021: 10 + 3.01 * s, 2022: 10 + 5 * s + 1e-9, 2023: 10.0}})
    got = {r.period: r for r in C.build_chart(df, "value", "A", P, True, "usd").collect()}
    assert [got[y].rule for y in (2020, 2021, 2022, 2023)] == ["", "beyond_limits", "beyond_limits", ""] and [got[y].severity for y in (2021, 2022)] == ["medium", "high"]
    assert got[2022].explanation == "x FY2022: disbursement of $17 is above the expected range $6 to $14 (learned from FY2010-2019, where a typical year was $10); that is 5.0 robust sigmas from the typical year (limits sit at 3), so 2.0 beyond the $14 limit."


def test_fixed_engine_equals_frozen_chart_without_gaps(spark):
    s = {"a": wavy(seed=8), "b": wavy(seed=9)}
    s["a"][2022] *= 9
    v1, v2 = points(spark, s, "v1.1-reference"), points(spark, s, "v2-fixed")
    for k, r in v2.items():
        assert v1[k].robust_z == pytest.approx(r.robust_z, rel=0.2) and v1[k].n_baseline == r.n_baseline


def test_shift_severity(spark):
    raw = [("x", 2020, 1.0, 0, 0.0, 0.0, 0.2, 10, 0, 0, 2010, 2019, "sustained_shift", z) for z in (0.05, 1.5)]
    got = D.finish_points(spark.createDataFrame(raw, D.RAW), P).collect()
    assert [r.severity for r in got] == ["low", "medium"]


def test_incidents(spark):
    rows = [("X", 2021, 4.0, 0.5, "medium"), ("X", 2022, -3.5, -0.4, "high"), ("Y", 2024, 1.0, 0.1, "low"), ("Z", 2020, 4.0, 1.0, "medium"), ("Z", 2021, 4.0, 1.0, "medium"), ("W", 2020, 4.0, 1.0, "medium"), ("W", 2021, -4.0, 1.0, "medium"), ("W", 2022, 6.04, 1.0, "medium"), ("W", 2024, 4.0, 1.0, "medium")]
    df = spark.createDataFrame(rows, "entity string, period int, robust_z double, value double, severity string").withColumn("explanation", F.lit("why"))
    got = {r.incident_id: r for r in I.group_incidents(df, "The rolling baseline", P, worst=True).collect()}
    assert {k: (r.kind, r.severity, r.n_alerts, r.max_abs_z) for k, r in got.items()} == {
        "X FY2021-2022": ("spike_and_reversal", "high", 2, 4.0), "Y FY2024": ("single", "low", 1, 1.0), "Z FY2020-2021": ("two_year_move", "medium", 2, 4.0), "W FY2020-2022": ("persistent", "medium", 3, 6.0), "W FY2024": ("single", "medium", 1, 4.0)}
    assert got["Y FY2024"].summary == "why" and "The rolling baseline no longer describes" in got["W FY2020-2022"].summary
    assert {r.incident_id for r in I.attach_incident_id(df).collect()} == set(got)
    assert {r.severity for r in I.group_incidents(df, "b", P).collect()} == {"high", "medium"}


def test_rules(spark):
    rows = [("g", "a", 2019, "r", 5e6, 1.0, 5e6 - 2.0), ("g", "a", 2020, "r", 0.0, 1.0, -2.01), ("g", "a", 2021, "r", 0.0, -1.0, 1.0), ("g", "a", 2023, "q", 7e6, 0.0, 7e6), ("g", "a", 2024, None, 7e6, 0.0, None), ("g", "b", 2020, None, -1.0, 0.0, -1.0), ("g", "b", 2020, None, None, 0.0, 0.0), ("g", "b", 2027, "r", 1.0, 0.0, 1.0)]
    got = R.run_rules(spark.createDataFrame(rows, "grp string, entity string, period int, region string, gross double, repayments double, net double"), P)
    by = {(r.entity, r.period, r.gross): r for r in got.collect()}
    a, b = by["a", 2020, 0.0], by["b", 2020, -1.0]
    assert (by["a", 2019, 5e6].flag_R1_net_identity, a.flag_R1_net_identity) == (False, True)
    assert b.flag_R2_negative_gross and by["a", 2021, 0.0].flag_R3_negative_repayments and b.flag_R4_duplicate_key and not a.flag_R4_duplicate_key
    assert a.flag_R5_region_reassigned and not b.flag_R5_region_reassigned
    assert [k for k, r in by.items() if r.flag_R6_stale_gross] == [("a", 2024, 7e6)]
    assert not by["b", 2027, 1.0].is_complete
    report = {r.rule: r for r in R.rule_report(got).collect()}
    assert report["R4_duplicate_key"].n_rows_flagged == 2 and report["R5_region_reassigned"].pct_of_rows == 62.5
    cover = {r.entity: r for r in R.coverage_report(got, P).collect()}
    assert (cover["a"].n_periods, cover["a"].n_gaps, cover["a"].gap_periods) == (5, 1, "2022") and cover["b"].n_periods == 2
    assert R.drift_detail(got).count() == 3


def test_injection_and_scores(spark):
    series = {f"e{k}": wavy(seed=100 + k) for k in range(30)}
    df = frame(spark, series)
    p = Params(trials=2, planted=8)
    picks = E.pick_cells(df, E.scenarios(spark, p), 7, p).cache()
    n = {(r.kind, r.trial): (r.n, r.e) for r in picks.groupBy("kind", "trial").agg(F.count("*").alias("n"), F.countDistinct("entity").alias("e")).collect()}
    assert len(n) == 12 and set(n.values()) == {(8, 8)}
    broken = {(r.kind, r.trial, r.entity, r.period): r.value for r in E.break_series(df, picks, 7, p).collect()}
    for r in picks.collect():
        was, now = series[r.entity][r.period], broken[r.kind, r.trial, r.entity, r.period]
        want = {"spike_x10": was * 10, "units_x1000": was * 1000, "drop_to_zero": 0, "feed_stops": 0, "stale_repeat": series[r.entity].get(r.period - 1)}.get(r.kind)
        assert now == want if want is not None else abs(now / was - 1) == pytest.approx(0.25)
        if r.kind == "feed_stops":
            assert broken[r.kind, r.trial, r.entity, 2026] == 0
    with pytest.raises(ValueError):
        E.scenarios(spark, p, ("typo",))
    for m in ("v1.1-reference", "v2-rolling"):  # only picked entities matter
        short, full = (sorted(E.score_trials(df, picks, m, 7, p, FLOWS, whole).collect(), key=str) for whole in (False, True))
        assert short == full
    report = {r.kind: r for r in E.recall_report(E.score_trials(df, picks, "v2-rolling", 7, p, FLOWS)).collect()}
    assert report["stale_repeat"].recall_pct_mean == 100 and report["units_x1000"].recall_pct_mean > 90 and report["feed_stops"].feed_silent_end_pct in (0.0, None)


def test_labels(spark, tmp_path):
    head = "entity,period,robust_z,severity,change_pct,rule,currently_alerting,explanation,label,note\n"
    (tmp_path / "ok.csv").write_text("﻿" + head + "x,2020,4.0,medium,10,beyond_limits,true,e, Noise ,\ny,2021,4.0,medium,10,beyond_limits,true,e,,hm\n", encoding="utf-8")
    sheet = io.load_labels(spark, str(tmp_path / "ok.csv"))
    assert [(r.entity, r.label, r.note) for r in sheet.orderBy("entity").collect()] == [("x", "noise", ""), ("y", "", "hm")]
    (tmp_path / "bad.csv").write_text(head + "x,2020,4.0,medium,10,r,true,e,maybe,\n")
    with pytest.raises(ValueError, match="maybe"):
        io.load_labels(spark, str(tmp_path / "bad.csv"))
    assert io.load_labels(spark, None).count() == 0
    alerts = spark.createDataFrame([("x", 2020, 0.5, 9.0, "high", "beyond_limits", "e"), ("z", 2020, 0.5, -5.0, "high", "beyond_limits", "e")], "entity string, period int, value double, robust_z double, severity string, rule string, explanation string")
    typed = spark.createDataFrame(sheet.select("entity", "period", F.lit(4.0).alias("robust_z"), "severity", F.lit(1.0).alias("change_pct"), "rule", F.lit(True).alias("currently_alerting"), "explanation", "label", "note").collect(), io.LABEL_SCHEMA)
    merged = E.merge_label_sheet(alerts, typed)
    assert {(r.entity, r.label, r.currently_alerting) for r in merged.collect()} == {("x", "noise", True), ("z", "", True), ("y", "", False)}
    again = E.merge_label_sheet(alerts, spark.createDataFrame(merged.collect(), io.LABEL_SCHEMA))
    assert sorted(again.collect(), key=str) == sorted(merged.collect(), key=str)
    r = E.precision_report(E.attach_labels(alerts, typed), P).first()
    assert (r.alerts_labelled, r.alerts_unlabelled, r.precision_strict, r.precision_at_10) == (1, 1, 0.0, None)


def test_ledger_is_idempotent(spark, tmp_path):
    old = spark.createDataFrame([("v1", "m", "holdout", 1.0)], "version string, method string, split string, recall_a double")
    new = spark.createDataFrame([("v1", "m", "holdout", 2.0), ("v2", "m", "holdout", 3.0)], old.schema)
    keys = ["version", "method", "split"]
    once = E.upsert_ledger(old, new, keys)
    assert sorted(once.collect()) == sorted(E.upsert_ledger(once, new, keys).collect()) == sorted(new.collect())
    path = str(tmp_path / "ledger")
    io.write_ledger(old, path)
    io.write_ledger(E.upsert_ledger(io.read_ledger(spark, path), new, keys), path)
    assert sorted(io.read_ledger(spark, path).collect()) == sorted(new.collect())


def test_bronze(spark, tmp_path):
    row = {k: "1" for k in io.BRONZE} | {"Fiscal Year": "2020", "Gross Disbursement (US$)": "NaN", "Extra": "e"}
    (tmp_path / "b.csv").write_text(",".join(row) + "\n" + ",".join(row.values()) + "\n")
    r = io.load_bronze(spark, str(tmp_path / "b.csv")).first()
    assert (r.fiscal_year, r.gross_disbursement_usd, r.net_disbursement_usd, r.Extra) == (2020, None, 1.0, "e")
    (tmp_path / "c.csv").write_text("Financier,Region\na,b\n")
    with pytest.raises(ValueError, match="SCHEMA DRIFT.*Country"):
        io.load_bronze(spark, str(tmp_path / "c.csv"))
    silver = io.with_roles(io.load_bronze(spark, str(tmp_path / "b.csv")))
    io.write_silver(silver, str(tmp_path / "silver"))
    back = spark.read.parquet(str(tmp_path / "silver")).withColumn("grp", F.col("grp").cast("string"))
    assert io.load_series(back, "1", P).count() == 1
    io.write_outputs({"points": silver}, str(tmp_path / "out"), {"points": "grp"})
    assert spark.read.parquet(str(tmp_path / "out/points")).count() == 1


def test_empty_frames(spark):
    none = frame(spark, {})
    for m in METHODS:
        res = D.run_method(none, m, P, FLOWS)
        assert all(df.count() == 0 for df in res.values())
    assert all(df.count() == 0 for df in C.build_charts(none, P))


def test_partitions_and_row_order_do_not_matter(spark):
    series = {f"e{k}": wavy(seed=k) for k in range(6)}
    a = D.method_points(frame(spark, series), "v2-rolling", P)
    b = D.method_points(frame(spark, dict(reversed(series.items()))).repartition(7), "v2-rolling", P)
    assert sorted(a.collect(), key=str) == sorted(b.collect(), key=str)


def test_differences_between_methods(spark):
    alerts = spark.createDataFrame([("v2-fixed", "a", 2020), ("v2-rolling", "a", 2020), ("v2-fixed", "b", 2021), ("v2-rolling", "c", 2021), ("v2-rolling", "d", 2021)], "method string, entity string, period int").withColumns({"rule": F.lit("r"), "severity": F.lit("s"), "robust_z": F.lit(1.0), "value": F.lit(1.0), "baseline_span": F.lit(""), "explanation": F.lit("")})
    diff = E.fixed_vs_rolling(alerts)
    pts = spark.createDataFrame([("v2-fixed", "c", "charted"), ("v2-fixed", "d", "zero_mad: x")], "method string, entity string, status string")
    got = {r.entity: (r.only_in, r.why.split(":")[0]) for r in E.classify_difference(diff, pts).collect()}
    assert got == {"b": ("v2-fixed", "adaptation"), "c": ("v2-rolling", "sensitivity"), "d": ("v2-rolling", "coverage")}


def test_entry_points():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries()) and "growth_alerts" in e.queries()


def test_custom_method_walks(spark):
    m = {"mine": Method(policy="include_all", lifecycle=True)}
    s = wavy(seed=11)
    s[2021] = 0.0
    got = {r.period: r for r in D.method_points(frame(spark, {"x": s}), "mine", P, m).collect()}
    assert got[2023].n_lifecycle_skipped == 2 and got[2023].n_held_out == 0


def test_stream_equals_batch(spark, tmp_path):
    from panelsentry.streaming.verdicts import replay

    series = frame(spark, {f"e{k}": {y: v for y, v in wavy(seed=k).items() if (y + k) % 9} for k in range(4)})
    m = METHODS["v2-rolling"]
    got = sorted(replay(series, str(tmp_path / "s"), P, m, 6).collect(), key=str)
    assert got == sorted(D.judge_walking(series, P, m).collect(), key=str) and got


def holes(rng, n, first=2005, last=2026):
    """Series with missing rows, null and NaN levels, zeros and repeated rows."""
    rows = []
    for k in range(n):
        for y in range(first, last + 1):
            kind = rng.random()
            level = float(rng.normal(1e8, 4e7))
            if kind < 0.06:
                continue
            level = None if kind < 0.12 else math.nan if kind < 0.16 else 0.0 if kind < 0.24 else level
            rows += [(f"e{k}", y, level, 1.0, 1.0)] + ([(f"e{k}", y, float(rng.normal(1e8, 4e7)), 1.0, 1.0)] if kind > 0.95 else [])
        if k % 5 == 0:
            rows.append((f"e{k}", -(10**9), 1e8, 1.0, 1.0))  # one far period
    return rows


def plain_verdicts(rows, p, m):
    """The chronological engine one series and one period at a time: (entity, period) to (code, n_baseline, n_held_out, n_lifecycle_skipped, value, rule)."""
    series = {}
    for e, y, v, *_ in rows:
        if v is not None and v == v:
            s = series.setdefault(e, {})
            s[y] = max(v, s.get(y, -math.inf))
    out = {}
    for e, raw in series.items():
        x, sign = {y: max(v, 0.0) for y, v in raw.items()}, {}
        grows = lambda y: y in x and y - 1 in x
        idle = lambda y: grows(y) and (raw[y] <= 0 or raw[y - 1] <= 0)
        for t in range(p.monitor[0], p.monitor[1] + 1):
            if t not in x:
                continue
            chosen, held, asleep = [], 0, 0
            pool = range(p.baseline[1], p.baseline[0] - 1, -1) if m.baseline == "fixed" else sorted((y for y in x if y < t), reverse=True)
            for y in pool:
                if not grows(y):
                    continue
                if m.lifecycle and idle(y):
                    asleep += 1
                    continue
                s = sign.get(y)
                if m.policy != "include_all" and s and ((y + 1 < t and sign.get(y + 1) == -s) or sign.get(y - 1) == -s or y == t - 1):
                    held += 1
                    continue
                chosen.append(y)
                if m.baseline != "fixed" and len(chosen) == p.window:
                    break
            code, value, rule, n = D.CHARTED, None, "", len(chosen)
            c = max(p.c_floor, p.c_fraction * float(np.median([x[q] for q in {*chosen, *(y - 1 for y in chosen)}]))) if chosen else p.c_floor
            g = lambda y: math.log((x[y] + c) / (x[y - 1] + c))  # noqa: B023, E731
            base = np.array([g(y) for y in chosen])
            center = float(np.median(base)) if n else 0.0
            sigma = float(np.median(np.abs(base - center))) * p.mad_scale if n else 0.0
            if not grows(t):
                code = D.NO_PRIOR
            elif m.lifecycle and raw[t] <= 0 and raw[t - 1] <= 0:
                code = D.DORMANT
            elif n < p.min_points:
                code = D.FEW if n else D.NONE
            elif not sigma > 0:
                code = D.FLAT
            else:
                value = g(t)
                if abs(value - center) > p.sigmas * sigma:
                    rule, sign[t] = "beyond_limits", 1 if value > center else -1
                else:
                    run = [y for y in range(t - p.run_length + 1, t + 1) if grows(y) and not (m.lifecycle and idle(y))]
                    sides = {np.sign(g(y) - center) for y in run}
                    rule = "sustained_shift" if len(run) == p.run_length and sides in ({1.0}, {-1.0}) else ""
            out[e, t] = (code, n, held, asleep, None if value is None else round(value, 9), rule)
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_engines_agree_on_holes(spark, seed):
    """Null and NaN levels, gaps, zeros, repeated rows and a far period: both engines against a plain one, by all methods."""
    rows = holes(np.random.default_rng(seed), 60)
    df = spark.createDataFrame(rows, "entity string, period int, value double, repayments double, grants double").repartition(3)
    as_rows = lambda df: {(r.entity, r.period): (r.code, r.n_baseline, r.n_held_out, r.n_lifecycle_skipped, None if r.value is None else round(r.value, 9), r.rule) for r in df.collect()}
    methods = {n: m for n, m in METHODS.items() if m.engine != "frozen"} | {"fixed all": Method(baseline="fixed", policy="include_all", lifecycle=False), "rolling awake": Method(policy="include_all")}
    walked = D.walk_methods(df, P, methods)
    for name, m in methods.items():
        want = plain_verdicts(rows, P, m)
        assert want and as_rows(walked.where(F.col("method") == name)) == want
        if m.baseline == "fixed" or (m.policy == "include_all" and not m.lifecycle):
            assert as_rows(D.judge_set_based(df, P, m.baseline, m.lifecycle)) == want


def test_all_methods_at_once(spark):
    series = frame(spark, {f"e{k}": {y: v for y, v in wavy(seed=k).items() if (y + k) % 11} for k in range(12)})
    both = D.run_methods(series, P, FLOWS)
    for n in METHODS:
        one = D.run_method(series, n, P, FLOWS)
        for what in ("points", "alerts", "incidents"):
            drop = lambda df: sorted((tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in df.select(sorted(df.columns)).collect()), key=str)
            assert drop(both[what].where(F.col("method") == n)) == drop(one[what]), (n, what)


@pytest.mark.parametrize("spread", [10, 40])
def test_exact_median_of_large_keys(spark, spread):
    """Keys of many values are narrowed to the middle and picked by rank: exact to the bit, with ties, far values, one value, two values, null keys."""
    rng = np.random.default_rng(spread)
    values = {
        "normal": rng.normal(0, 1, 501), "even": rng.normal(5, 1e-9, 400), "wild": np.exp(rng.normal(0, 60, 700)) * rng.choice([-1, 1], 700), "ties": rng.integers(0, 3, 300).astype(float), "same": np.full(250, 7.5),
        "half": np.r_[np.zeros(100), np.ones(100)], "two": np.array([1.0, 2.0]), "one": np.array([3.0]), None: rng.random(99), "ends": np.r_[-math.inf, np.arange(60.0), math.inf],
    }
    rows = [(k, float(v)) for k, a in values.items() for v in rng.permutation(a)] + [("normal", None), ("normal", math.nan), ("none", None)]
    df = spark.createDataFrame(rows, "k string, v double").repartition(5)
    got = {r.k: (r.n, r.median) for r in C.exact_median(df, "v", ["k"], spread).collect()}
    assert got == {k: (len(a), float(np.median(a))) for k, a in values.items()}
    fits = {r.k: (r.n, r.center, r.sigma) for r in C.robust_center_sigma(df.where("k <> 'ends' or k is null"), "v", ["k"], P, spread).collect()}
    plain = {r.k: (r.n, r.center, r.sigma) for r in C.robust_center_sigma(df.where("k <> 'ends' or k is null"), "v", ["k"], P).collect()}
    assert fits == plain and fits["none"] == (0, None, None) and fits["normal"][0] == 501
    assert C.exact_median(df.limit(0), "v", ["k"], spread).count() == 0


def test_rows_without_keys(spark):
    rows = [(g, e, 2020 + k % 3, r, 5.0, 0.0, 5.0) for e, g, r, k in [(None, "g", "r", 0), (None, "g", "q", 1), (None, "g", "q", 1), ("a", None, "r", 0), ("a", None, "r", 1), ("b", "g", "r", 0), ("b", "g", "r", 1), ("b", "g", None, 2)]]
    df = spark.createDataFrame(rows, "grp string, entity string, period int, region string, gross double, repayments double, net double")
    got = sorted(((str(r.entity), str(r.grp), r.period, r.flag_R4_duplicate_key, r.flag_R5_region_reassigned, r.flag_R6_stale_gross) for r in R.run_rules(df, P).collect()))
    assert got == sorted([("None", "g", 2020, False, False, False), ("None", "g", 2021, True, False, False), ("None", "g", 2021, True, False, False), ("a", "None", 2020, False, False, False), ("a", "None", 2021, False, False, False), ("b", "g", 2020, False, False, False), ("b", "g", 2021, False, False, True), ("b", "g", 2022, False, False, True)])
    assert {r.rule: (r.n_rows_flagged, r.pct_of_rows) for r in R.null_key_report(df).collect()} == {"K_null_grp": (2, 25.0), "K_null_entity": (3, 37.5), "K_null_period": (0, 0.0)}
    alone = df.select("entity", R.rule_attribute_drift("region").alias("x"), R.rule_stale_repeat("gross", "entity").alias("y")).where("entity is null and (x or y)")
    assert alone.count() == 0


def test_rows_of_repeated_keys(spark, monkeypatch):
    rows = [(k % 7 if k % 5 else None, k % 3, k) for k in range(30)] + [(100, 1, 31), (None, None, 32), (None, None, 33)]
    df = spark.createDataFrame(rows, "a int, b int, c int").repartition(4)
    key = lambda r: (r[0], r[1])
    want = sorted((r for r in rows if sum(key(x) == key(r) for x in rows) > 1), key=str)
    for limit in (R.BROADCAST_KEYS, 2):
        monkeypatch.setattr(R, "BROADCAST_KEYS", limit)
        assert sorted(map(tuple, R.rows_of_repeated_keys(df, "a", "b").collect()), key=str) == want


def test_ledger_writers_do_not_lose_each_other(spark, tmp_path):
    """Two writers start from one state: the slower one is told, and by update_ledger builds on the other's rows."""
    path, keys = str(tmp_path / "ledger"), ["version"]
    row = lambda v, x: spark.createDataFrame([(v, x)], "version string, x double")
    with pytest.raises(FileNotFoundError):
        io.read_ledger(spark, path)
    assert io.update_ledger(spark, path, lambda old: row("a", 1.0)) == 1
    before = io.read_ledger(spark, path)
    tries = []

    def slow(old):
        tries.append(1)
        if len(tries) == 1:  # meanwhile another writer commits
            io.update_ledger(spark, path, lambda o: E.upsert_ledger(o, row("b", 2.0), keys))
        return E.upsert_ledger(old, row("c", 3.0), keys)

    assert io.update_ledger(spark, path, slow) == 3 and len(tries) == 2
    assert sorted(map(tuple, io.read_ledger(spark, path).collect())) == [("a", 1.0), ("b", 2.0), ("c", 3.0)]
    assert sorted(map(tuple, before.collect())) == [("a", 1.0)] == sorted(map(tuple, io.read_ledger(spark, path, 1).collect()))
    with pytest.raises(io.LedgerConflict):
        io.write_ledger(row("d", 4.0), path, after=1)
    assert io.ledger_state(spark, path) == 3 and io.write_ledger(row("e", 5.0), path) == 4
    row("f", 6.0).write.parquet(f"{path}/data-half-written")  # files without an entry are no state
    assert [tuple(r) for r in io.read_ledger(spark, path).collect()] == [("e", 5.0)]


def test_ledger_by_many_threads(spark, tmp_path):
    from concurrent.futures import ThreadPoolExecutor

    path = str(tmp_path / "ledger")
    add = lambda k: io.update_ledger(spark, path, lambda old: spark.createDataFrame([(k,)], "k int") if old is None else old.unionByName(spark.createDataFrame([(k,)], "k int")))
    with ThreadPoolExecutor(4) as pool:
        states = sorted(pool.map(add, range(8)))
    assert states == list(range(1, 9)) and sorted(r.k for r in io.read_ledger(spark, path).collect()) == list(range(8))


def test_rescued_values(spark, tmp_path):
    row = {k: "1" for k in io.BRONZE} | {"Fiscal Year": "2020"}
    dirty = row | {"Fiscal Year": "FY20", "Gross Disbursement (US$)": "1,5", "Net Disbursement (US$)": "", "Fees (US$)": "NaN", "Country / Economy": ""}
    (tmp_path / "b.csv").write_text("\n".join(",".join(f'"{x}"' if "," in x else x for x in r) for r in (row, row.values(), dirty.values())) + "\n")
    df = io.load_bronze(spark, str(tmp_path / "b.csv"), rescue=True)
    a, b = df.orderBy(F.col("fiscal_year").isNull()).collect()
    assert a._rescued is None and b._rescued == {"fiscal_year": "FY20", "gross_disbursement_usd": "1,5"} and b.gross_disbursement_usd is None and b.fiscal_year is None
    assert df.drop("_rescued").columns == io.load_bronze(spark, str(tmp_path / "b.csv")).columns
    watched, seen = io.observe_bronze(df)
    assert watched.count() == 2
    got = seen.get
    assert (got["n_rows"], got["null_country"], got["rejected_gross_disbursement_usd"], got["rejected_fiscal_year"], got["rejected_fees_usd"]) == (2, 1, 1, 1, 0)
    assert sorted(map(tuple, io.rejected_values(df).collect())) == [("fiscal_year", "FY20", 1), ("gross_disbursement_usd", "1,5", 1)]


@pytest.mark.parametrize("stretch", [1, 3, 50])
def test_runs_by_stretch(spark, stretch):
    """Runs that end at, cross and skip stretches, by equal values and by consecutive periods, against a plain loop; a null entity too."""
    from panelsentry.operators.runs import consecutive, like, with_runs

    rng = np.random.default_rng(stretch)
    rows = [(e, y, int(rng.random() < 0.8)) for e in ("a", "b", None) for y in range(-20, 60) if rng.random() < 0.9] + [("c", 1000, 1)] + [("d", y, 1) for y in range(40)]
    df = spark.createDataFrame(rows, "entity string, period int, v int").repartition(3)
    for same, columns, plain in ((like("v"), ("v",), lambda a, b: a[2] == b[2]), (consecutive, ("period",), lambda a, b: a[1] == b[1] - 1)):
        want = {}
        for e in ("a", "b", None, "c", "d"):
            own, run, groups = sorted(r for r in rows if r[0] == e), 0, {}
            for k, r in enumerate(own):
                run += not (k and plain(own[k - 1], r))
                groups.setdefault(run, []).append(r[1])
            want |= {(e, y): (g, len(ys), ys[0], ys[-1]) for g, ys in groups.items() for y in ys}
        assert {(r.entity, r.period): (r.run, r.run_size, r.run_first, r.run_last) for r in with_runs(df, same, columns, stretch).collect()} == want
    assert with_runs(df.limit(0), consecutive, ("period",), stretch).count() == 0


def test_one_long_series_is_split(spark):
    """A million periods of one entity: no task gets more than a stretch of it."""
    from panelsentry.operators.runs import like, with_runs

    n, stretch = 1_000_000, 50_000
    long = spark.range(n).select(F.lit("x").alias("entity"), F.col("id").cast("int").alias("period"), (F.floor(F.col("id") / 300_000) % 2).alias("v"))
    out = with_runs(long, like("v"), ("v",), stretch)
    assert sorted(map(tuple, out.groupBy("run", "run_size", "run_first", "run_last").agg(F.count("*")).collect())) == [(1, 300_000, 0, 299_999, 300_000), (2, 300_000, 300_000, 599_999, 300_000), (3, 300_000, 600_000, 899_999, 300_000), (4, 100_000, 900_000, 999_999, 100_000)]
    assert max(r[0] for r in long.withColumn("part", F.floor(F.col("period") / stretch)).repartition("entity", "part").groupBy(F.spark_partition_id(), "part").count().select("count").collect()) <= stretch


def test_numbers_are_printed_as_c_prints_them(spark):
    from panelsentry.functions import text as X

    random = np.random.default_rng(5)
    values = [0.05, 0.25, 0.35, 0.45, 2.5, 5.25, 5.35, 12.15, 14300.5, 1544.5, -0.3, -2.25, *(random.integers(-4000, 4000, 3000) / 80).tolist(), *(random.normal(0, 50, 500)).tolist()]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    rows = df.select("v", F.format_string("%.0f", X.nearest(F.col("v"))).alias("a"), F.format_string("%.1f", X.nearest(F.col("v"), 1)).alias("b")).collect()
    assert [(r.a, r.b) for r in rows] == [(f"{r.v:.0f}", f"{r.v:.1f}") for r in rows]
    ratio = spark.createDataFrame([(144.005,), (16.445,), (38.705,), (167.325,)], "r double").select(((F.exp(F.log("r")) - 1) * 100).alias("x"), X.fmt_pct(F.log("r")).alias("s")).collect()
    assert [r.s for r in ratio] == [f"{r.x:+.0f}%" for r in ratio]


def test_six_places_as_in_sql(spark):
    import duckdb

    from panelsentry.plans.queries import rounded

    values = [74.2343835, 4.1179215, 0.0000005, -1.0000005, 1e305, -1e305, *(np.random.default_rng(6).integers(-(10**9), 10**9, 3000) * 2 + 1).__truediv__(2e6).tolist()]
    got = [r.v for r in rounded(spark.createDataFrame([(v,) for v in values], "v double")).collect()]
    assert got == [duckdb.execute("SELECT round(CAST(? AS DOUBLE), 6)", [v]).fetchone()[0] for v in values]


def test_one_pass_for_all_methods(spark):
    """Each stored table is read once for all methods, and the frozen chart's refused rows come from the pass that judges the others."""
    random = np.random.default_rng(3)
    p = Params(baseline=(0, 11), monitor=(12, 19), last_complete=19, c_floor=1.0)
    rows = [(f"e{e}", t, float(v), 1.0) for e in range(40) for t in range(20) for v in [max(0.0, random.normal(50, 4 + e % 7 * 3)) * (0 if e % 5 == 0 and t > 14 else 8 if random.random() < 0.06 else 1)] if e % 8 or t % 3]
    series = spark.createDataFrame(rows, "entity string, period int, value double, other double")
    res = D.run_methods(series, p, ["other"])
    leaves = lambda df: df._jdf.queryExecution().optimizedPlan().collectLeaves().size()
    assert leaves(res["alerts"]) == 1 and leaves(res["incidents"]) == 2 and leaves(E.method_coverage(res["points"])) == 1 and leaves(E.alarm_profile(res["alerts"], res["incidents"])) == 3
    grown = C.yoy_log_growth_v1(series, p)
    two = D.refused_rows(series, C.not_charted(grown, "growth", "B_growth", p), p).select("entity", "period", "status").union(C.build_chart(grown, "growth", "B_growth", p, False, "growth").select("entity", "period", F.lit("charted")))
    v1 = res["points"].where("method = 'v1.1-reference'").select("entity", "period", "status")
    assert sorted(v1.collect()) == sorted(two.collect()) and v1.where("status <> 'charted'").count() > 0


def test_stored_is_written_once(spark):
    df = io.stored(spark.range(5))
    assert io.stored(df) is df and sorted(r.id for r in df.collect()) == list(range(5))
    assert io.stored(df.where("id > 2")).count() == 2 and df.count() == 5


def test_whole_numbers_as_round_has_them(spark):
    from panelsentry.plans.panels import whole

    values = [0.49999999999999994, 0.5, 1.5, 2.5, -0.5, -2.5, 4503599627370497.5, 1e15 + 0.5, *(np.random.default_rng(7).integers(-(10**7), 10**7, 2000) / 4).tolist()]
    got = spark.createDataFrame([(v,) for v in values], "v double").select(whole(F.col("v")).alias("a"), F.round("v").cast("long").alias("b")).collect()
    assert [r.a for r in got] == [r.b for r in got]


def test_changes_are_printed_as_the_c_library_has_them(spark):
    """Logarithms and exponentials go through the C library: the JVM's differ in the last bit, and a change that is half way between two percents shows it."""
    from panelsentry.functions import logs
    from panelsentry.functions import text as X

    levels = [0.0, 25.355, *(np.arange(0, 4000) / 10 + 0.005).tolist()]
    rows = spark.createDataFrame([(v,) for v in levels], "x double").select("x", D._growth(F.lit(1.0), F.col("x"), F.lit(0.0)).alias("v")).select("x", "v", X.fmt_pct(F.col("v")).alias("s")).collect()
    assert [r.v for r in rows] == [math.log(r.x + 1.0) for r in rows]
    assert [r.s for r in rows] == [f"{(math.exp(math.log(r.x + 1.0)) - 1) * 100:+.0f}%" for r in rows]
    lists = spark.createDataFrame([(1, [1.5, 16.505]), (2, []), (3, None), (4, [2.0])], "i int, a array<double>").orderBy("i").select(logs.exp_each(F.col("a")).alias("a")).collect()
    assert [r.a for r in lists] == [[math.exp(1.5), math.exp(16.505)], [], None, [math.exp(2.0)]]
