"""Registered panel queries, one or more for each job, and their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from ..operators import adaptive as D
from ..operators import charts as C
from ..operators import evaluation as E
from ..operators import incidents as I
from ..operators import rules as R
from ..functions.text import NULL_KEY_NOTE
from ..params import ERROR_KINDS, METHODS
from ..sources.io import BRONZE, LABEL_SCHEMA, clean_labels, cut_lineage, load_bronze, load_labels, load_series, observe_bronze, read_ledger, rejected_values, shared_folder, stored, update_ledger, with_roles, write_ledger, write_outputs, write_silver
from . import oracle as O
from .panels import FLOWS_A, FLOWS_B, A, B, panel_a, panel_b, panel_k, series_a, series_b, series_c, series_n, table

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}

SERIES = {"a": (series_a, A, FLOWS_A), "b": (series_b, B, FLOWS_B), "c": (series_c, A, FLOWS_A)}
SHORT = {"fixed": "v2-fixed", "rolling": "v2-rolling", "naive": "v2-rolling-naive"}
POINTS = "chart entity period ~value ~center ~lcl ~ucl ~sigma ~robust_z n_baseline rule severity"
CHRON = "entity period ~level status ~value ~center ~lcl ~ucl ~sigma ~robust_z n_baseline n_held_out n_lifecycle_skipped baseline_span rule severity explanation"
INCIDENTS = "source incident_id entity first_period last_period n_alerts kind ~max_abs_z severity summary"
ZEROS = "entity first_period last_period n_periods has_prior_activity reactivated_period ongoing other_flows_zero"


def pick(columns: str) -> str:
    """A select list; ~ rounds to six places."""
    return ", ".join(f"round({c[1:]}, 6) AS {c[1:]}" if c[0] == "~" else c for c in columns.split())


def six(c: Column) -> Column:
    """Six places as SQL's round has them: the scaled number to the nearest whole one, halves away from zero. Spark's round goes by the decimals that a number is shown with."""
    return F.when(F.abs(c) < 1e300, F.round(c * 1e6) / 1e6).otherwise(c)


def rounded(df: DataFrame, columns: str | None = None) -> DataFrame:
    names = [c.lstrip("~") for c in columns.split()] if columns else df.columns
    doubles = {f.name for f in df.schema if isinstance(f.dataType, DoubleType)}
    return df.select(*(six(F.col(c)).alias(c) if c in doubles else F.col(c) for c in names))


def query(name: str, make, sql: str | None = None) -> None:
    QUERIES[name] = make
    if sql:
        ORACLE_SQL[name] = sql


# rules and coverage

FLAGS = {
    "R1_net_identity": "abs(net - (gross - repayments)) > 1.0", "R2_negative_gross": "gross < 0", "R3_negative_repayments": "repayments < 0",
    "R4_duplicate_key": "count(*) OVER (PARTITION BY entity, grp, period) > 1", "R5_region_reassigned": "coalesce(min(region) OVER e <> max(region) OVER e, false)",
    "R6_stale_gross": "coalesce(gross > 0 AND gross = lag(gross) OVER o AND lag(period) OVER o = period - 1, false)",
}
O.part("flagged", ["panel_a"], f"SELECT *, {', '.join(f'{v} AS flag_{k}' for k, v in FLAGS.items())}, period <= {A.last_complete} AS is_complete FROM panel_a WINDOW e AS (PARTITION BY entity), o AS (PARTITION BY entity, grp ORDER BY period)")
query("rule_flags", lambda s, d: rounded(R.run_rules(panel_a(s, d), A)), O.sql("SELECT grp, entity, period, region, " + pick("~gross ~repayments ~net ~charges") + ", n_lines, " + ", ".join(f"flag_{k}" for k in FLAGS) + ", is_complete FROM flagged", "flagged"))
query("rule_report", lambda s, d: R.rule_report(R.run_rules(panel_a(s, d), A)), O.sql(" UNION ALL ".join(f"SELECT '{k}' AS rule, count(*) FILTER (flag_{k}) AS n_rows_flagged, round_even(100.0 * count(*) FILTER (flag_{k}) / count(*), 3) AS pct_of_rows, '{O.NOTES[k]}' AS note FROM flagged" for k in FLAGS), "flagged"))
O.part("panel_k", ["panel_a"], """
  SELECT * REPLACE (CASE WHEN h NOT IN (0, 2) THEN entity END AS entity, CASE WHEN h NOT IN (1, 2) THEN grp END AS grp)
  FROM (SELECT *, CAST('0x' || substr(md5('key|' || entity || '|' || period), 1, 6) AS BIGINT) % 9 AS h FROM panel_a)""")
_GUARDED = FLAGS | {"R5_region_reassigned": f"entity IS NOT NULL AND {FLAGS['R5_region_reassigned']}", "R6_stale_gross": f"entity IS NOT NULL AND grp IS NOT NULL AND {FLAGS['R6_stale_gross'].replace('gross', 'n_lines')}"}
O.part("flagged_k", ["panel_k"], f"SELECT *, {', '.join(f'{v} AS flag_{k}' for k, v in _GUARDED.items())}, period <= {A.last_complete} AS is_complete FROM panel_k WINDOW e AS (PARTITION BY entity), o AS (PARTITION BY entity, grp ORDER BY period)")
query("rule_flags_null_keys", lambda s, d: rounded(R.run_rules(panel_k(s, d), A, "n_lines")), O.sql("SELECT grp, entity, period, region, " + pick("~gross ~repayments ~net ~charges") + ", n_lines, " + ", ".join(f"flag_{k}" for k in FLAGS) + ", is_complete FROM flagged_k", "flagged_k"))
query("rule_report_null_keys", lambda s, d: R.rule_report(R.run_rules(panel_k(s, d), A, "n_lines")).unionByName(R.null_key_report(panel_k(s, d))), O.sql(
    " UNION ALL ".join([f"SELECT '{k}' AS rule, count(*) FILTER (flag_{k}) AS n_rows_flagged, round_even(100.0 * count(*) FILTER (flag_{k}) / count(*), 3) AS pct_of_rows, '{O.NOTES[k]}' AS note FROM flagged_k" for k in FLAGS]
                       + [f"SELECT 'K_null_{k}', count(*) FILTER ({k} IS NULL), round_even(100.0 * count(*) FILTER ({k} IS NULL) / count(*), 3), '{NULL_KEY_NOTE}' FROM panel_k" for k in ("grp", "entity", "period")]), "flagged_k"))
query("rule_negative_gross", lambda s, d: panel_b(s, d).where(R.rule_negative_gross()).select("entity", "period", six(F.col("gross")).alias("gross")), O.sql("SELECT entity, period, round(gross, 6) AS gross FROM panel_b WHERE gross < 0", "panel_b"))
query("rule_duplicate_key", lambda s, d: R.rows_of_repeated_keys(table(s, d, "lineitem"), "l_orderkey", "l_linenumber").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"), "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM (SELECT *, count(*) OVER (PARTITION BY l_orderkey, l_linenumber) AS n FROM lineitem) WHERE n > 1")


def _order_regions(s, d):
    place = table(s, d, "supplier").join(table(s, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", F.col("n_regionkey").alias("region"))
    li = table(s, d, "lineitem").select("l_orderkey", "l_suppkey", (F.year("l_shipdate") * 12 + F.month("l_shipdate")).alias("period"))
    return li.join(place, F.col("l_suppkey") == F.col("s_suppkey")).select(F.col("l_orderkey").alias("entity"), "region", "period").withColumn("flag_R5_region_reassigned", R.rule_attribute_drift("region"))


_ORDER_REGIONS = "WITH r AS (SELECT l_orderkey AS entity, n_regionkey AS region, year(l_shipdate) * 12 + month(l_shipdate) AS period FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey), f AS (SELECT *, min(region) OVER (PARTITION BY entity) <> max(region) OVER (PARTITION BY entity) AS flag FROM r) "
query("rule_attribute_drift", lambda s, d: _order_regions(s, d).groupBy("flag_R5_region_reassigned").agg(F.count(F.lit(1)).alias("n_rows"), F.countDistinct("entity").alias("n_entities")), _ORDER_REGIONS + "SELECT flag AS flag_R5_region_reassigned, count(*) AS n_rows, count(DISTINCT entity) AS n_entities FROM f GROUP BY 1")
query("drift_detail", lambda s, d: R.drift_detail(_order_regions(s, d)), _ORDER_REGIONS + "SELECT entity, region, CAST(min(period) AS INTEGER) AS first_period, CAST(max(period) AS INTEGER) AS last_period FROM f WHERE flag GROUP BY 1, 2")
query("rule_stale_repeat", lambda s, d: panel_a(s, d).withColumn("stale", R.rule_stale_repeat("n_lines", "entity")).where("stale").select("entity", "period", "n_lines"), O.sql("SELECT entity, period, n_lines FROM (SELECT *, n_lines > 0 AND n_lines = lag(n_lines) OVER w AND lag(period) OVER w = period - 1 AS stale FROM panel_a WINDOW w AS (PARTITION BY entity ORDER BY period)) WHERE stale", "panel_a"))
_COVERAGE = """SELECT grp, entity, min(period) AS first_period, max(period) AS last_period, count(*) AS n_periods, CAST(len(gaps) AS BIGINT) AS n_gaps, array_to_string(gaps, ',') AS gap_periods FROM (
  SELECT p.*, list_filter(range(a, b + 1), lambda y: NOT list_contains(seen, y)) AS gaps FROM {t} p JOIN (SELECT grp, entity, CAST(min(period) AS BIGINT) AS a, CAST(max(period) AS BIGINT) AS b, list(DISTINCT CAST(period AS BIGINT)) AS seen FROM {t} WHERE period <= {l} GROUP BY ALL) USING (grp, entity) WHERE period <= {l}) GROUP BY grp, entity, gaps"""
query("coverage_a", lambda s, d: R.coverage_report(panel_a(s, d), A), O.sql(_COVERAGE.format(t="panel_a", l=A.last_complete), "panel_a"))
query("coverage_b", lambda s, d: R.coverage_report(panel_b(s, d), B), O.sql(_COVERAGE.format(t="panel_b", l=B.last_complete), "panel_b"))
query("gappy_series", lambda s, d: R.gappy_series(R.coverage_report(panel_b(s, d), B), "events"), O.sql("SELECT * FROM (" + _COVERAGE.format(t="panel_b", l=B.last_complete) + ") WHERE n_gaps > 0", "panel_b"))

# frozen charts

for x, (series, p, flows) in SERIES.items():
    if x == "c":
        continue
    grown = lambda s, d, f=series, p=p: C.yoy_log_growth_v1(f(s, d), p)
    points = lambda s, d, f=series, p=p: C.build_charts(f(s, d), p)[0]
    alerts = lambda s, d, f=points: C.select_alerts(f(s, d))
    growth_alerts = lambda s, d, f=alerts: f(s, d).where("chart = 'B_growth'")
    query(f"growth_v1_{x}", lambda s, d, f=grown: rounded(f(s, d), "entity period ~value ~growth"), O.sql(f"SELECT {pick('entity period ~value ~growth')} FROM growth_{x}", f"growth_{x}"))
    query(f"fit_charts_{x}", lambda s, d, f=grown, p=p: rounded(C.fit_charts(f(s, d), "growth", p, False), "entity n_baseline ~center ~sigma ~lcl ~ucl reason"), O.sql(f"SELECT {pick('entity n_baseline ~center ~sigma ~lcl ~ucl reason')} FROM chart_{x} WHERE chart = 'B_growth'", f"chart_{x}"))
    query(f"chart_points_{x}", lambda s, d, f=points: rounded(f(s, d), POINTS), O.sql(f"SELECT {pick(POINTS)} FROM points_{x}", f"points_{x}"))
    query(f"not_charted_{x}", lambda s, d, f=series, p=p: C.build_charts(f(s, d), p)[1], O.sql(f"SELECT chart, entity, reason FROM chart_{x} WHERE reason <> ''", f"chart_{x}"))
    query(f"refusal_counts_{x}", lambda s, d, f=series, p=p: C.refusal_counts(C.build_charts(f(s, d), p)[1]), O.sql(f"SELECT chart, split_part(reason, ' ', 1) AS word, count(*) AS entities FROM chart_{x} WHERE reason <> '' GROUP BY 1, 2", f"chart_{x}"))
    query(f"chart_summary_{x}", lambda s, d, f=points: C.chart_summary(f(s, d)), O.sql(f"SELECT chart, count(DISTINCT entity) AS entities, count(*) AS points, count(*) FILTER (rule <> '') AS alerts, round_even(100.0 * count(*) FILTER (rule <> '') / count(*), 1) AS alert_pct FROM points_{x} GROUP BY 1", f"points_{x}"))
    query(f"alerts_{x}", lambda s, d, f=alerts: rounded(C.rank_alerts(f(s, d)), POINTS + " ~abs_z explanation"), O.sql(f"SELECT {pick(POINTS + ' ~abs_z explanation')} FROM alerts_{x}", f"alerts_{x}"))
    query(f"top_alerts_{x}", lambda s, d, f=alerts, p=p: rounded(C.top_alerts(f(s, d), p.top_n), POINTS), O.sql(f"SELECT {pick(POINTS)} FROM alerts_{x} WHERE chart = 'B_growth' ORDER BY abs_z DESC, entity, period LIMIT {p.top_n}", f"alerts_{x}"))
    query(f"alert_incident_ids_{x}", lambda s, d, f=growth_alerts: I.attach_incident_id(f(s, d)).select("entity", "period", "incident_id"), O.sql(f"SELECT entity, period, entity || ' FY' || a || CASE WHEN b <> a THEN '-' || b ELSE '' END AS incident_id FROM grouped_{x}", f"grouped_{x}"))
    query(f"incidents_{x}", lambda s, d, f=growth_alerts, p=p: rounded(I.incident_order(I.group_incidents(f(s, d), f"The FY{p.span} baseline", p)), INCIDENTS), O.sql(f"SELECT {pick(INCIDENTS)} FROM incidents_{x}", f"incidents_{x}"))
    query(f"multi_period_incidents_{x}", lambda s, d, f=growth_alerts, p=p: I.multi_period_incidents(I.group_incidents(f(s, d), f"The FY{p.span} baseline", p)).groupBy("kind").agg(F.count(F.lit(1)).alias("n")), O.sql(f"SELECT kind, count(*) AS n FROM incidents_{x} WHERE kind <> 'single' GROUP BY 1", f"incidents_{x}"))
    query(f"alert_load_{x}", lambda s, d, f=growth_alerts, p=p: E.alert_load(f(s, d), I.group_incidents(f(s, d), "", p), p), O.sql(f"SELECT (SELECT count(*) FROM alerts_{x} WHERE chart = 'B_growth') AS alerts, (SELECT round_even(count(*) / {p.monitor[1] - p.monitor[0] + 1}.0, 1) FROM alerts_{x} WHERE chart = 'B_growth') AS alerts_per_period, (SELECT count(*) FROM alerts_{x} WHERE chart = 'B_growth' AND severity = 'high') AS alerts_high, (SELECT count(*) FROM incidents_{x}) AS incidents, (SELECT round_even(count(*) / {p.monitor[1] - p.monitor[0] + 1}.0, 1) FROM incidents_{x}) AS incidents_per_period", f"incidents_{x}"))
# the same runs and islands from stretches of a few periods, as series too long for one task need them
def _charted_a(s, d):
    return C.with_chart(C.yoy_log_growth_v1(series_a(s, d), A), "growth", A, False).where("reason = ''")


query("run_rule_by_stretch_a", lambda s, d: C.run_rule_retroactive(_charted_a(s, d), "growth", A, 5).select("entity", "period", "in_run"), O.sql("SELECT entity, period, in_run FROM runs_a WHERE chart = 'B_growth'", "runs_a"))
query("incidents_by_stretch_b", lambda s, d: rounded(I.group_incidents(C.select_alerts(C.build_charts(series_b(s, d), B)[0]).where("chart = 'B_growth'"), f"The FY{B.span} baseline", B, stretch=4), INCIDENTS), O.sql(f"SELECT {pick(INCIDENTS)} FROM incidents_b", "incidents_b"))
query("zero_periods_by_stretch_b", lambda s, d: I.zero_periods(series_b(s, d), FLOWS_B, 4), O.sql(f"SELECT {pick(ZEROS)} FROM zeros_b", "zeros_b"))
query("zero_periods_by_stretch_c", lambda s, d: I.zero_periods(series_c(s, d), FLOWS_A, 3), O.sql(f"SELECT {pick(ZEROS)} FROM zeros_c", "zeros_c"))
QUERIES["growth_alerts"] = lambda s, d: rounded(C.rank_alerts(C.select_alerts(C.build_chart(C.yoy_log_growth_v1(series_a(s, d), A), "growth", "B_growth", A, False, "growth"))), POINTS + " ~abs_z explanation")
ORACLE_SQL["growth_alerts"] = O.sql(f"SELECT {pick(POINTS + ' ~abs_z explanation')} FROM alerts_a WHERE chart = 'B_growth'", "alerts_a")
query("robust_center_sigma", lambda s, d: rounded(C.robust_center_sigma(table(s, d, "lineitem"), "l_extendedprice", ["l_suppkey"])), "WITH m AS (SELECT l_suppkey, median(l_extendedprice) AS center FROM lineitem GROUP BY 1) SELECT l_suppkey, count(*) AS n, round(any_value(center), 6) AS center, round(median(abs(l_extendedprice - center)) * 1.4826, 6) AS sigma FROM lineitem JOIN m USING (l_suppkey) GROUP BY 1")
query("robust_center_sigma_large_keys", lambda s, d: rounded(C.robust_center_sigma(table(s, d, "lineitem"), "l_extendedprice", ["l_returnflag", "l_linestatus"], spread=500)), "WITH m AS (SELECT l_returnflag, l_linestatus, median(l_extendedprice) AS center FROM lineitem GROUP BY ALL) SELECT l_returnflag, l_linestatus, count(*) AS n, round(any_value(center), 6) AS center, round(median(abs(l_extendedprice - center)) * 1.4826, 6) AS sigma FROM lineitem JOIN m USING (l_returnflag, l_linestatus) GROUP BY ALL")
O.part("total_a", ["series_a"], "SELECT period, CAST(sum(CAST(round(value) AS BIGINT)) AS DOUBLE) AS value FROM series_a GROUP BY 1")
_ERA = f"period BETWEEN {A.baseline[0]} AND {A.baseline[1]}"
O.part("middle_t", ["total_a"], f"SELECT median(value) AS center FROM total_a WHERE {_ERA}")
O.part("spread_t", ["total_a", "middle_t"], f"SELECT median(abs(value - center)) * 1.4826 AS sigma FROM total_a, middle_t WHERE {_ERA}")
query("portfolio_totals", lambda s, d: rounded(C.portfolio_totals(series_a(s, d).withColumn("value", F.round(F.col("value")).cast("long").cast("double")), A)), O.sql(f"SELECT period, round(value, 6) AS value, round(center, 6) AS center, round(greatest(center - 3 * sigma, 0), 6) AS lcl, round(center + 3 * sigma, 6) AS ucl, period BETWEEN {A.monitor[0]} AND {A.monitor[1]} AND value > center + 3 * sigma AS above FROM total_a, middle_t, spread_t", "total_a", "middle_t", "spread_t"))
query("partial_period_totals", lambda s, d: rounded(C.partial_period_totals(panel_a(s, d), A)), O.sql(f"SELECT period, round(sum(gross) / 1e9, 6) AS total_bn, period <= {A.last_complete} AS is_complete FROM panel_a GROUP BY period", "panel_a"))


# chronological engine

for x, (series, p, flows) in SERIES.items():
    for short, method in SHORT.items():
        query(f"points_{short}_{x}", lambda s, d, f=series, p=p, m=method: rounded(D.method_points(f(s, d), m, p), CHRON), O.sql(f"SELECT {pick(CHRON)} FROM pts_{short}_{x}", f"pts_{short}_{x}"))
    if x != "a":
        query(f"zero_periods_{x}", lambda s, d, f=series, w=flows: I.zero_periods(f(s, d), w), O.sql(f"SELECT {pick(ZEROS)} FROM zeros_{x}", f"zeros_{x}"))
        query(f"lifecycle_incidents_{x}", lambda s, d, f=series, w=flows, p=p: rounded(I.lifecycle_incidents(I.zero_periods(f(s, d), w), p), INCIDENTS), O.sql(f"SELECT {pick(INCIDENTS)} FROM lifecycle_{x}", f"lifecycle_{x}"))
for short, method in SHORT.items():  # levels that are missing, and rows that repeat
    query(f"points_{short}_n", lambda s, d, m=method: rounded(D.method_points(series_n(s, d), m, A), CHRON), O.sql(f"SELECT {pick(CHRON)} FROM pts_{short}_n", f"pts_{short}_n"))
    if short != "rolling":  # which is walked anyway
        query(f"walked_{short}_n", lambda s, d, m=method: rounded(D.finish_points(D.judge_walking(series_n(s, d), A, METHODS[m]), A), CHRON), O.sql(f"SELECT {pick(CHRON)} FROM pts_{short}_n", f"pts_{short}_n"))
O.part("era_a", ["facts_a"], f"SELECT * FROM facts_a WHERE has_growth AND NOT idle AND {_ERA}")
O.part("era_c_a", ["era_a"], f"SELECT entity, greatest({A.c_floor}, {A.c_fraction} * median(x)) AS c FROM (SELECT entity, period, x FROM era_a UNION SELECT entity, period - 1, x_prev FROM era_a) GROUP BY 1")
query("growth_history_a", lambda s, d: rounded(D.growth_history(series_a(s, d), A)), O.sql(f"SELECT entity, period, round(ln((x + c) / (x_prev + c)), 6) AS value FROM facts_a JOIN era_c_a USING (entity) WHERE has_growth AND period BETWEEN {A.baseline[0] + 1} AND {A.monitor[0] - 1}", "facts_a", "era_c_a"))
query("chronological_incidents_c", lambda s, d: rounded(D.run_method(series_c(s, d), "v2-rolling", A, FLOWS_A)["incidents"], INCIDENTS), O.sql(f"SELECT {pick(INCIDENTS)} FROM incidents_rolling_c UNION ALL SELECT {pick(INCIDENTS)} FROM lifecycle_c", "incidents_rolling_c", "lifecycle_c"))


O.chart_parts("c", A)
O.part("pts_v1_c", ["points_c", "series_c", "chart_c"], f"""
  SELECT entity, period, CAST(NULL AS DOUBLE) AS level, 'charted' AS status, value, center, lcl, ucl, sigma, robust_z, n_baseline, '' AS baseline_span, rule, severity FROM points_c WHERE chart = 'B_growth'
  UNION ALL SELECT entity, period, NULL, reason, NULL, NULL, NULL, NULL, NULL, NULL, NULL, '', '', '' FROM series_c JOIN (SELECT entity, reason FROM chart_c WHERE chart = 'B_growth' AND reason <> '') USING (entity) WHERE period BETWEEN {A.monitor[0]} AND {A.monitor[1]}""")
ALL = {"v1": "v1.1-reference", **SHORT}
_ALERTS = "method entity period ~robust_z rule severity"
query("method_alerts_c", lambda s, d: rounded(D.run_methods(series_c(s, d), A, FLOWS_A)["alerts"].withColumn("baseline_span", F.coalesce("baseline_span", F.lit(""))), _ALERTS + " baseline_span"), O.sql(" UNION ALL ".join(f"SELECT '{m}' AS method, entity, period, round(robust_z, 6) AS robust_z, rule, severity, baseline_span FROM pts_{k}_c WHERE rule <> ''" for k, m in ALL.items()), *(f"pts_{k}_c" for k in ALL)))
_TWO = {m: METHODS[m] for m in ("v2-fixed", "v2-rolling")}
_DIFF = "SELECT {c} FROM (SELECT *, 'v2-fixed' AS only_in FROM pts_fixed_c WHERE rule <> '' AND (entity, period) NOT IN (SELECT (entity, period) FROM pts_rolling_c WHERE rule <> '') UNION ALL SELECT *, 'v2-rolling' FROM pts_rolling_c WHERE rule <> '' AND (entity, period) NOT IN (SELECT (entity, period) FROM pts_fixed_c WHERE rule <> ''))"
_DIFF_COLUMNS = "entity period only_in rule severity ~robust_z ~value baseline_span"
query("fixed_vs_rolling_c", lambda s, d: rounded(E.fixed_vs_rolling(D.run_methods(series_c(s, d), A, FLOWS_A, _TWO)["alerts"]), _DIFF_COLUMNS), O.sql(_DIFF.format(c=pick(_DIFF_COLUMNS)), "pts_fixed_c", "pts_rolling_c"))


def _differences(s, d):
    res = D.run_methods(series_c(s, d), A, FLOWS_A, _TWO)
    return E.classify_difference(E.fixed_vs_rolling(res["alerts"]), res["points"]).groupBy("only_in", "why").agg(F.count(F.lit(1)).alias("n"))


query("classify_difference_c", _differences, O.sql(f"SELECT only_in, CASE WHEN only_in = 'v2-rolling' AND entity NOT IN (SELECT entity FROM pts_fixed_c WHERE status = 'charted') THEN '{O.WHY[0]}' WHEN only_in = 'v2-rolling' THEN '{O.WHY[1]}' ELSE '{O.WHY[2]}' END AS why, count(*) AS n FROM (" + _DIFF.format(c="entity, only_in") + ") GROUP BY 1, 2", "pts_fixed_c", "pts_rolling_c"))
_STATUS = "SELECT '{m}' AS method, entity, period, status, rule, severity, robust_z FROM {t}"
O.part("allpts_c", [f"pts_{k}_c" for k in ALL], " UNION ALL ".join(_STATUS.format(m=m, t=f"pts_{k}_c") for k, m in ALL.items()))
O.summary_parts("c")
_COVER = "method entities_monitored observations_monitored entities_excluded dormant_observations excluded_reasons"
_ALARMS = "method alerts alerts_high shift_alerts recurring_entities incidents persistent_incidents lifecycle_incidents"
query("method_coverage_c", lambda s, d: E.method_coverage(D.run_methods(series_c(s, d), A, FLOWS_A)["points"]), O.sql(f"SELECT {pick(_COVER)} FROM cover_c", "cover_c"))


def _alarm_profile(s, d):
    res = D.run_methods(series_c(s, d), A, FLOWS_A)
    return E.alarm_profile(res["alerts"], res["incidents"])


def _summary(series):
    res = D.run_methods(series, A, FLOWS_A)
    return E.method_summary(res["alerts"], res["incidents"], res["points"])


query("alarm_profile_c", _alarm_profile, O.sql(f"SELECT {pick(_ALARMS)} FROM alarms_c", "alarms_c"))
query("method_summary_c", lambda s, d: _summary(series_c(s, d)), O.sql("SELECT * FROM cover_c LEFT JOIN alarms_c USING (method)", "cover_c", "alarms_c"))
query("refused_rows_b", lambda s, d: D.refused_rows(series_b(s, d), C.not_charted(C.yoy_log_growth_v1(series_b(s, d), B), "growth", "B_growth", B), B), O.sql(f"SELECT entity, period, reason AS status FROM series_b JOIN (SELECT entity, reason FROM chart_b WHERE chart = 'B_growth' AND reason <> '') USING (entity) WHERE period BETWEEN {B.monitor[0]} AND {B.monitor[1]}", "series_b", "chart_b"))

# planted errors and scores

SEED = A.seeds["holdout"]
_KINDS = ", ".join(f"'{k}'" for k in ERROR_KINDS)


def _md5(*more: str) -> str:
    return f"md5('{SEED}|' || kind || '|' || trial" + "".join(f" || '|' || {m}" for m in more) + ")"


O.part("cells_a", ["series_a"], "SELECT *, lag(value) OVER (PARTITION BY entity ORDER BY period) AS prev FROM series_a")
O.part("picks_a", ["cells_a"], f"""
  SELECT kind, trial, entity, period FROM (SELECT *, row_number() OVER (PARTITION BY kind, trial ORDER BY {_md5('entity')}, entity) AS n FROM (
    SELECT kind, trial, entity, arg_min(period, {_md5('entity', 'period')}) AS period FROM cells_a, (SELECT unnest([{_KINDS}]) AS kind), (SELECT CAST(unnest(range({A.trials})) AS INTEGER) AS trial)
    WHERE period BETWEEN {A.monitor[0]} AND {A.monitor[1]} AND value > 0 AND (kind <> 'stale_repeat' OR (prev > 0 AND prev <> value)) GROUP BY ALL)) WHERE n <= {A.planted}""")
O.part("broken_a", ["cells_a", "picks_a"], f"""
  SELECT kind, trial, c.entity, c.period, CASE WHEN kind = 'feed_stops' AND c.period BETWEEN p.period AND {A.monitor[1]} THEN 0.0 WHEN c.period <> p.period THEN value WHEN kind = 'spike_x10' THEN value * 10 WHEN kind = 'units_x1000' THEN value * 1000
    WHEN kind = 'drop_to_zero' THEN 0.0 WHEN kind = 'misstate_25pct' THEN value * (1 + CASE WHEN substr({_md5('c.entity', 'c.period')}, 1, 1) < '8' THEN -0.25 ELSE 0.25 END) WHEN kind = 'stale_repeat' THEN prev ELSE value END AS value, repayments, charges
  FROM cells_a c JOIN picks_a p USING (entity)""")


def _picks(s, d, kinds=ERROR_KINDS):
    f = cut_lineage(series_a(s, d))
    return f, cut_lineage(E.pick_cells(f, E.scenarios(s, A, kinds), SEED, A))


query("pick_cells", lambda s, d: _picks(s, d)[1], O.sql("SELECT * FROM picks_a", "picks_a"))
for k in ERROR_KINDS:
    query(f"inject_{k}", lambda s, d, k=k: rounded(E.break_series(*_picks(s, d, (k,)), SEED, A), "kind trial entity period ~value"), O.sql(f"SELECT kind, trial, entity, period, round(value, 6) AS value FROM broken_a WHERE kind = '{k}'", "broken_a"))
_SCORES = "kind, trial, injected, charted, detected, collateral"
O.part("series_k", ["broken_a"], "SELECT kind || '|' || trial || '|' || entity AS entity, kind, trial, entity AS e, period, value, repayments, charges FROM broken_a")
O.chart_parts("k", A)
O.engine_parts("k", A, "fixed", "fixed", True, False)
O.engine_parts("k", A, "naive", "rolling", False, False)
O.engine_parts("k", A, "rolling", "rolling", True, True)


O.zero_parts("k", FLOWS_A, A)


def _score_sql(points: str, charted: str, clean: str, lifecycle: bool) -> str:
    """One method's trial scores, and in how many trials' stops of two periods or more the last period looks calm or is seen."""
    stale = "(SELECT entity, period, value > 0 AND value = lag(value) OVER w AND lag(period) OVER w = period - 1 AS s FROM {t} WINDOW w AS (PARTITION BY entity ORDER BY period))"
    mon, end = f"period BETWEEN {A.monitor[0]} AND {A.monitor[1]}", A.monitor[1]
    found = f"SELECT entity, period FROM {points} WHERE rule <> '' UNION SELECT entity, period FROM {stale.format(t='series_k')} WHERE s AND {mon}"
    live = f" UNION SELECT entity FROM lifecycle_k WHERE last_period >= {end}" if lifecycle else ""
    return f"""
  SELECT kind, trial, injected, charted, detected, collateral, silent_pct, surfaced_pct FROM (
  SELECT kind, trial, count(*) FILTER (truth) AS injected, count(*) FILTER (truth AND covered) AS charted, count(*) FILTER (truth AND covered AND found) AS detected, count(*) FILTER (found AND NOT (truth AND covered) AND NOT clean) AS collateral FROM (
    SELECT k.kind, k.trial, k.e, k.period, p.period IS NOT NULL AS truth, f.period IS NOT NULL AS found, c.period IS NOT NULL AS covered, g.period IS NOT NULL AS clean
    FROM series_k k LEFT JOIN picks_a p ON p.kind = k.kind AND p.trial = k.trial AND p.entity = k.e AND p.period = k.period
    LEFT JOIN ({found}) f ON f.entity = k.entity AND f.period = k.period
    LEFT JOIN (SELECT entity, period FROM {points} WHERE {charted}) c ON c.entity = k.entity AND c.period = k.period
    LEFT JOIN (SELECT entity, period FROM {clean} WHERE rule <> '' UNION SELECT entity, period FROM {stale.format(t='series_a')} WHERE s AND {mon}) g ON g.entity = k.e AND g.period = k.period) GROUP BY ALL)
  LEFT JOIN (SELECT kind, trial, 100.0 * count(*) FILTER (e IN (SELECT entity FROM {points} WHERE {charted} AND period = {end} AND rule = '')) / count(*) AS silent_pct,
                    100.0 * count(*) FILTER (e IN (SELECT entity FROM ({found}) WHERE period = {end}{live})) / count(*) AS surfaced_pct
             FROM (SELECT kind, trial, kind || '|' || trial || '|' || entity AS e FROM picks_a WHERE kind = 'feed_stops' AND period <= {end - 1} AND entity IN (SELECT entity FROM series_a WHERE period = {end})) GROUP BY ALL) USING (kind, trial)"""


SCORE_SQL = {
    "v1.1-reference": (_score_sql("(SELECT * FROM points_k WHERE chart = 'B_growth')", "true", "(SELECT * FROM points_a WHERE chart = 'B_growth')", False), ["points_k", "points_a", "picks_a", "series_a"]),
    **{m: (_score_sql(f"pts_{k}_k", "status = 'charted'", f"pts_{k}_a", METHODS[m].lifecycle), [f"pts_{k}_k", f"pts_{k}_a", "picks_a", "series_a", "lifecycle_k"]) for k, m in SHORT.items()},
}
r1 = lambda v: f"round_even({v}, 1)"
_SCORES = "kind trial injected charted detected collateral ~silent_pct ~surfaced_pct"


def _short(m: str) -> str:
    return m.replace("v1.1-", "v1_").replace("v2-", "").replace("-", "_")


for m, (body, needs) in SCORE_SQL.items():
    O.part(f"score_{_short(m)}", needs, body)
    O.part(f"report_{_short(m)}", [f"score_{_short(m)}"], f"""SELECT '{m}' AS method, kind, count(*) AS trials, {r1('avg(injected)')} AS injected_per_trial, {r1('avg(charted)')} AS charted_per_trial, {r1('avg(detected)')} AS detected_per_trial, {r1('avg(100.0 * detected / greatest(charted, 1))')} AS recall_pct_mean,
      {r1('min(100.0 * detected / greatest(charted, 1))')} AS recall_pct_min, {r1('max(100.0 * detected / greatest(charted, 1))')} AS recall_pct_max, {r1('avg(100.0 * detected / greatest(injected, 1))')} AS e2e_recall_pct_mean, {r1('avg(collateral)')} AS collateral_per_trial,
      {r1('avg(silent_pct)')} AS feed_silent_end_pct, {r1('avg(surfaced_pct)')} AS feed_surfaced_end_pct FROM score_{_short(m)} GROUP BY kind""")
    query(f"score_trials_{_short(m)}", lambda s, d, m=m: rounded(E.score_trials(*_picks(s, d), m, SEED, A, FLOWS_A), _SCORES), O.sql(f"SELECT {pick(_SCORES)} FROM score_{_short(m)}", f"score_{_short(m)}"))
    query(f"recall_report_{_short(m)}", lambda s, d, m=m: E.recall_report(E.score_trials(*_picks(s, d), m, SEED, A, FLOWS_A)), O.sql(f"SELECT * FROM report_{_short(m)}", f"report_{_short(m)}"))
O.part("evaluation", [f"report_{_short(m)}" for m in METHODS], " UNION ALL ".join(f"SELECT * FROM report_{_short(m)}" for m in METHODS))
query("feed_visibility_fixed", lambda s, d: rounded(E.score_trials(*_picks(s, d, ("feed_stops",)), "v2-fixed", SEED, A, FLOWS_A), "kind trial ~silent_pct ~surfaced_pct"), O.sql("SELECT kind, trial, round(silent_pct, 6) AS silent_pct, round(surfaced_pct, 6) AS surfaced_pct FROM score_fixed WHERE kind = 'feed_stops'", "score_fixed"))
query("evaluate_methods", lambda s, d: E.evaluate_methods(series_a(s, d), "holdout", A, FLOWS_A), O.sql("SELECT * FROM evaluation", "evaluation"))
query("evaluation_pivot", lambda s, d: E.evaluation_pivot(E.evaluate_methods(series_a(s, d), "holdout", A, FLOWS_A), "recall_pct_mean"), O.sql("SELECT kind, " + ", ".join(f"""max(recall_pct_mean) FILTER (method = '{m}') AS "{m}\"""" for m in METHODS) + " FROM evaluation GROUP BY kind", "evaluation"))
_MISS = """SELECT kind, string_agg(e || ' FY' || period, '; ' ORDER BY trial, e, period) AS example_misses FROM (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY trial, e, period) AS n FROM (
  SELECT p.kind, p.trial, p.entity AS e, p.period FROM picks_a p JOIN (SELECT * FROM points_k WHERE chart = 'B_growth' AND rule = '') q ON q.entity = p.kind || '|' || p.trial || '|' || p.entity AND q.period = p.period
  WHERE (q.entity, q.period) NOT IN (SELECT (entity, period) FROM (SELECT entity, period, value > 0 AND value = lag(value) OVER w AND lag(period) OVER w = period - 1 AS s FROM series_k WINDOW w AS (PARTITION BY entity ORDER BY period)) WHERE s))) WHERE n <= 5 GROUP BY 1"""
query("example_misses", lambda s, d: E.example_misses(*_picks(s, d), "v1.1-reference", SEED, A, FLOWS_A), O.sql(_MISS, "points_k", "picks_a", "series_k"))

# labels, ledger


def _alerts_a(s, d):
    return C.select_alerts(C.build_charts(series_a(s, d), A)[0]).where("chart = 'B_growth'")


def _sheet(alerts, shift: int = 0):
    """A label sheet made from alerts: md5 of each one's key decides its label; ``shift`` moves periods, so some rows no longer alert."""
    h = F.conv(F.substring(F.md5(F.concat_ws("|", "entity", F.col("period").cast("string"))), 1, 4), 16, 10).cast("int") % 5
    label = F.when(h == 0, " Investigate").when(h == 1, "explained").when(h == 2, "NOISE ").when(h == 3, F.lit(None)).otherwise("")
    a = alerts.withColumn("label", label)
    return clean_labels(a.select("entity", (F.col("period") + F.when(h == 4, shift).otherwise(0)).alias("period"), F.bround("robust_z", 1).alias("robust_z"), "severity", F.lit(0.0).alias("change_pct"), "rule", F.lit(True).alias("currently_alerting"), "explanation", "label", F.lit(None).cast("string").alias("note")))


def _labelled(job, s, d, shift: int = 0):
    """job(alerts, sheet); the alerts, which the sheet is made of too, are written once."""
    alerts = cut_lineage(_alerts_a(s, d))
    return job(alerts, _sheet(alerts, shift))


O.part("ga", ["alerts_a"], "SELECT *, CAST('0x' || substr(md5(entity || '|' || period), 1, 4) AS BIGINT) % 5 AS h FROM alerts_a WHERE chart = 'B_growth'")
O.part("sheet_a", ["ga"], "SELECT entity, CAST(period + CASE WHEN h = 4 THEN 100 ELSE 0 END AS INTEGER) AS period, round_even(robust_z, 1) AS robust_z, severity, 0.0 AS change_pct, rule, explanation, CASE h WHEN 0 THEN 'investigate' WHEN 1 THEN 'explained' WHEN 2 THEN 'noise' ELSE '' END AS label FROM ga")
O.part("merged_a", ["ga", "sheet_a"], "SELECT g.entity, g.period, round_even(g.robust_z, 1) AS robust_z, g.severity, round_even((exp(value) - 1) * 100, 0) AS change_pct, g.rule, true AS currently_alerting, g.explanation, coalesce(s.label, '') AS label, '' AS note FROM ga g LEFT JOIN sheet_a s USING (entity, period) UNION ALL SELECT entity, period, robust_z, severity, CAST(change_pct AS DOUBLE), rule, false, explanation, label, '' FROM sheet_a s ANTI JOIN ga g USING (entity, period)")
query("attach_labels", lambda s, d: rounded(_labelled(E.attach_labels, s, d), "entity period ~robust_z label note"), O.sql("SELECT entity, period, round(robust_z, 6) AS robust_z, CASE h WHEN 0 THEN 'investigate' WHEN 1 THEN 'explained' WHEN 2 THEN 'noise' ELSE '' END AS label, '' AS note FROM ga", "ga"))
query("merge_label_sheet", lambda s, d: rounded(E.label_sheet_order(_labelled(E.merge_label_sheet, s, d, 100))), O.sql("SELECT * FROM merged_a", "merged_a"))
query("label_progress", lambda s, d: E.label_progress(_labelled(E.merge_label_sheet, s, d, 100)), O.sql("SELECT count(*) FILTER (currently_alerting) AS live, count(*) FILTER (currently_alerting AND label <> '') AS labelled, count(*) FILTER (currently_alerting AND label = '') AS to_do, " + ", ".join(f"count(*) FILTER (currently_alerting AND label = '{x}') AS n_{x}" for x in ("investigate", "explained", "noise")) + ", count(*) FILTER (NOT currently_alerting) AS kept FROM merged_a", "merged_a"))
query("precision_report", lambda s, d: E.precision_report(_labelled(E.attach_labels, s, d), A), O.sql("""SELECT count(*) FILTER (h < 3) AS alerts_labelled, count(*) FILTER (h >= 3) AS alerts_unlabelled, round_even(100.0 * count(*) FILTER (h = 0) / nullif(count(*) FILTER (h < 3), 0), 1) AS precision_strict, round_even(100.0 * count(*) FILTER (h < 2) / nullif(count(*) FILTER (h < 3), 0), 1) AS precision_lenient,
  (SELECT CASE WHEN count(*) = 10 AND count(*) FILTER (h < 3) = 10 THEN round_even(100.0 * count(*) FILTER (h = 0) / 10, 1) END FROM (SELECT * FROM ga ORDER BY abs(robust_z) DESC, entity, period LIMIT 10)) AS precision_at_10 FROM ga""", "ga"))


O.part("allpts_a", ["points_a", "chart_a", *(f"pts_{k}_a" for k in SHORT)], "SELECT 'v1.1-reference' AS method, entity, period, 'charted' AS status, rule, severity, robust_z FROM points_a WHERE chart = 'B_growth'"
       f" UNION ALL SELECT 'v1.1-reference', entity, period, reason, '', '', NULL FROM series_a JOIN (SELECT entity, reason FROM chart_a WHERE chart = 'B_growth' AND reason <> '') USING (entity) WHERE period BETWEEN {A.monitor[0]} AND {A.monitor[1]} UNION ALL " + " UNION ALL ".join(_STATUS.format(m=m, t=f"pts_{k}_a") for k, m in SHORT.items()))
O.zero_parts("a", FLOWS_A, A)
O.summary_parts("a")
_MEANS = {"recall": "recall_pct_mean", "e2e": "e2e_recall_pct_mean", "collateral": "collateral_per_trial"}
O.part("ledger", ["evaluation", "cover_a", "alarms_a"], f"""
  SELECT 'p1' AS version, 'holdout' AS split, e.*, c.* EXCLUDE (method, excluded_reasons), a.* EXCLUDE (method), {SEED} AS seed, CASE WHEN method IN ('v1.1-reference', 'v2-fixed') THEN 'fixed' ELSE 'rolling' END AS baseline,
    CASE WHEN method IN ('v1.1-reference', 'v2-fixed') THEN NULL ELSE {A.window} END AS window_periods, CASE WHEN method IN ('v1.1-reference', 'v2-rolling-naive') THEN 'include_all' ELSE 'confirm' END AS policy, method IN ('v2-fixed', 'v2-rolling') AS lifecycle,
    CAST({A.sigmas} AS DOUBLE) AS sigmas, {A.min_points} AS min_points, '' AS note
  FROM (SELECT method, {', '.join(f"max({c}) FILTER (kind = '{k}') AS {m}_{k}" for m, c in _MEANS.items() for k in ERROR_KINDS)}, max(feed_silent_end_pct) AS feed_silent_end_pct, max(feed_surfaced_end_pct) AS feed_surfaced_end_pct FROM evaluation GROUP BY method) e
  LEFT JOIN cover_a c USING (method) LEFT JOIN alarms_a a USING (method)""")


def _ledger(s, d):
    """The ledger's rows and the report that they are made of, over one stored series."""
    series = stored(series_a(s, d))
    report = stored(E.evaluate_methods(series, "holdout", A, FLOWS_A))
    return E.ledger_rows(report, _summary(series), "p1", "holdout", A), report


def _kept(df, s, name: str):
    """A ledger as it is read back from its folder."""
    path = f"{shared_folder(s)}/{name}-{uuid.uuid4().hex}"
    write_ledger(df, path)
    return path, read_ledger(s, path)


_LEDGER_KEYS = ["version", "method", "split"]


def _upserted(s, d):
    rows = _ledger(s, d)[0]
    path, stored = _kept(rows, s, "ledger")
    update_ledger(s, path, lambda old: E.upsert_ledger(old.withColumn("recall_spike_x10", F.lit(-1.0)), stored, _LEDGER_KEYS))
    update_ledger(s, path, lambda old: E.upsert_ledger(old, stored.withColumn("version", F.lit("p2")), _LEDGER_KEYS))
    return read_ledger(s, path)


def _reproduced(s, d):
    rows, report = _ledger(s, d)
    stored = _kept(rows, s, "ledger")[1]
    old = stored.withColumns({"recall_spike_x10": F.col("recall_spike_x10") + 1, "recall_feed_stops": F.lit(None).cast("double")})
    return E.check_reproduction(report, old, "p1", "holdout").withColumn("split", F.lit("holdout")).unionByName(E.check_reproduction(report, old, "p1", "tuning").withColumn("split", F.lit("tuning")))


query("ledger_rows", lambda s, d: _ledger(s, d)[0], O.sql("SELECT * FROM ledger", "ledger"))
query("ledger_upsert", _upserted, O.sql("SELECT * FROM ledger UNION ALL SELECT * REPLACE ('p2' AS version) FROM ledger", "ledger"))
query("ledger_matrix", lambda s, d: E.ledger_matrix(_ledger(s, d)[0], "recall"), O.sql("SELECT 'holdout' AS split, kind, " + ", ".join(f"""max(recall_pct_mean) FILTER (method = '{m}') AS "{m}\"""" for m in METHODS) + " FROM evaluation GROUP BY kind", "evaluation"))
query("check_reproduction", _reproduced, O.sql("""SELECT kind, recall_pct_mean AS now, CASE WHEN split = 'holdout' AND kind <> 'feed_stops' THEN recall_pct_mean + CASE WHEN kind = 'spike_x10' THEN 1 ELSE 0 END END AS stored,
  CASE WHEN split = 'tuning' OR kind = 'feed_stops' THEN 'not checked' WHEN kind = 'spike_x10' THEN 'differs' ELSE 'reproduced' END AS status, split FROM evaluation, (SELECT unnest(['holdout', 'tuning']) AS split) WHERE method = 'v1.1-reference'""", "evaluation"))

# files: what is written is read back by the library's readers

_HEADS = {v: k for k, v in BRONZE.items()}


def _silver(s, d):
    """Panel A as a source file with the source's headers, read, renamed and stored as the pipeline does."""
    base = f"{shared_folder(s)}/bronze-{uuid.uuid4().hex}"
    names = {"grp": "financier", "period": "fiscal_year", "region": "region", "entity": "country", "gross": "gross_disbursement_usd", "repayments": "repayments_usd", "net": "net_disbursement_usd", "charges": "interest_usd"}
    panel = panel_a(s, d).select(*(F.col(a).alias(_HEADS[b]) for a, b in names.items()), *(F.lit("NaN").alias(h) for h, n in BRONZE.items() if n not in names.values()))
    panel.write.option("header", True).csv(f"{base}/bronze")
    write_silver(with_roles(load_bronze(s, f"{base}/bronze")), f"{base}/silver")
    return s.read.parquet(f"{base}/silver").withColumn("grp", F.col("grp").cast("string")), base


def _stored_series(s, d):
    silver, base = _silver(s, d)
    write_outputs({"series": load_series(silver, "R", A, flows=["repayments", "fees_usd"])}, f"{base}/out")
    return rounded(s.read.parquet(f"{base}/out/series"), "entity period ~value ~repayments ~fees_usd")


def _stored_labels(s, d):
    path = f"{shared_folder(s)}/labels-{uuid.uuid4().hex}"
    sheet = _sheet(_alerts_a(s, d), 100).withColumn("label", F.concat(F.lit(" "), F.upper("label")))
    sheet.select([c.split()[0] for c in LABEL_SCHEMA.split(", ")]).write.option("header", True).csv(path)
    return load_labels(s, path).select("entity", "period", "rule", "label", "note")


query("load_bronze", lambda s, d: rounded(_silver(s, d)[0].drop("ibrd_commitments_usd", "ida_grant_commitments_usd", "ida_nonconcessional_commitments_usd", "ida_concessional_commitments_usd", "ida_other_commitments_usd"), "grp entity period region ~gross ~repayments ~net ~interest_usd ~fees_usd"), O.sql("SELECT grp, entity, period, region, round(gross, 6) AS gross, round(repayments, 6) AS repayments, round(net, 6) AS net, round(charges, 6) AS interest_usd, CAST(NULL AS DOUBLE) AS fees_usd FROM panel_a", "panel_a"))
_DIRT = "md5(concat('dirt|', coalesce(entity, ''), '|', period))"


def _dirty(s, d):
    """Panel K as a source file in which, by md5, some amounts and periods are no numbers; read with what could not be parsed."""
    base = f"{shared_folder(s)}/dirty-{uuid.uuid4().hex}"
    h = F.conv(F.substring(F.expr(_DIRT), 1, 6), 16, 10).cast("long") % 20
    names = {"grp": "financier", "period": "fiscal_year", "region": "region", "entity": "country", "gross": "gross_disbursement_usd", "repayments": "repayments_usd", "net": "net_disbursement_usd", "charges": "interest_usd"}
    panel = panel_k(s, d).withColumn("h", h).withColumns({"gross": F.when(F.col("h") == 0, "n/a").when(F.col("h") == 1, "1,234.50").otherwise(F.col("gross").cast("string")), "net": F.when(F.col("h") == 2, " ").otherwise(F.col("net").cast("string")), "period": F.when(F.col("h").isin(1, 3), "FY12").otherwise(F.col("period").cast("string"))})
    panel.select(*(F.col(a).alias(_HEADS[b]) for a, b in names.items()), *(F.lit("0").alias(x) for x, n in BRONZE.items() if n not in names.values())).write.option("header", True).csv(base)
    return load_bronze(s, base, rescue=True)


def _observed(s, d):
    """What one scan counts, as rows."""
    bronze, seen = observe_bronze(_dirty(s, d))
    bronze.write.format("noop").mode("overwrite").save()
    return s.createDataFrame(sorted((k, v) for k, v in seen.get.items() if v), "measure string, n long")


O.part("dirty", ["panel_k"], "SELECT *, CAST('0x' || substr(md5('dirt|' || coalesce(entity, '') || '|' || period), 1, 6) AS BIGINT) % 20 AS dirt FROM panel_k")
query("rejected_values", lambda s, d: rejected_values(_dirty(s, d)), O.sql("""SELECT 'gross_disbursement_usd' AS "column", CASE dirt WHEN 0 THEN 'n/a' ELSE '1,234.50' END AS value, count(*) AS n_rows FROM dirty WHERE dirt < 2 GROUP BY ALL UNION ALL SELECT 'fiscal_year', 'FY12', count(*) FROM dirty WHERE dirt IN (1, 3) HAVING count(*) > 0""", "dirty"))
query("bronze_counts", _observed, O.sql("""SELECT * FROM (SELECT 'n_rows' AS measure, count(*) AS n FROM dirty UNION ALL SELECT 'null_financier', count(*) FILTER (grp IS NULL) FROM dirty UNION ALL SELECT 'null_country', count(*) FILTER (entity IS NULL) FROM dirty UNION ALL SELECT 'null_fiscal_year', count(*) FILTER (dirt IN (1, 3)) FROM dirty
  UNION ALL SELECT 'rejected_gross_disbursement_usd', count(*) FILTER (dirt < 2) FROM dirty UNION ALL SELECT 'rejected_fiscal_year', count(*) FILTER (dirt IN (1, 3)) FROM dirty) WHERE n > 0""", "dirty"))
query("load_series", _stored_series, O.sql(f"SELECT entity, period, round(gross, 6) AS value, round(repayments, 6) AS repayments, CAST(NULL AS DOUBLE) AS fees_usd FROM panel_a WHERE grp = 'R' AND period <= {A.last_complete}", "panel_a"))
query("load_labels", _stored_labels, O.sql("SELECT entity, period, rule, label, '' AS note FROM sheet_a", "sheet_a"))
query("drift_summary", lambda s, d: R.drift_summary(_order_regions(s, d)), _ORDER_REGIONS + "SELECT count(DISTINCT entity) AS n_entities, count(*) AS n_rows FROM f WHERE flag")
