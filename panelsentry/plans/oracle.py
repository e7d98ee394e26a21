"""SQL for the registered panel queries, put together from named parts."""

from __future__ import annotations

import re

from ..functions import text as X
from ..params import Params
from .panels import FLOWS_A, FLOWS_B, A, B

PARTS: dict[str, tuple[list[str], str]] = {}


def part(name: str, needs: list[str], body: str) -> None:
    PARTS[name] = needs, body


def sql(body: str, *needs: str) -> str:
    """A query with all parts that it needs, in order."""
    done: list[str] = []

    def add(n):
        if n not in done:
            for k in PARTS[n][0]:
                add(k)
            done.append(n)

    for n in needs:
        add(n)
    return ("WITH " + ",\n".join(f"{n} AS MATERIALIZED ({PARTS[n][1]})" for n in done) + "\n" if done else "") + body


def cents(x: str) -> str:
    return f"CAST(sum(CAST(round(({x}) * 100) AS BIGINT)) AS DOUBLE) / 100"


part("panel_a", [], f"""
  SELECT grp, grp || '-' || l_suppkey AS entity, period, r_name AS region, gross, repayments, net, charges, n_lines FROM (
    SELECT l_returnflag AS grp, l_suppkey, CAST((year(l_shipdate) - 1995) * 4 + quarter(l_shipdate) - 1 AS INTEGER) AS period, {cents('l_extendedprice')} AS gross,
           {cents('l_extendedprice * l_discount')} AS repayments, CAST(sum(CAST(round(l_extendedprice * (1 - l_discount)) AS BIGINT)) AS DOUBLE) AS net, {cents('l_extendedprice * l_tax')} AS charges, count(*) AS n_lines
    FROM lineitem GROUP BY ALL) LEFT JOIN supplier ON l_suppkey = s_suppkey LEFT JOIN nation ON s_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey""")
part("series_a", ["panel_a"], f"SELECT entity, period, gross AS value, repayments, charges FROM panel_a WHERE period <= {A.last_complete}")


def _of(t: str) -> str:
    return f"sum(CASE WHEN event_type = '{t}' THEN CAST(round(value * 100) AS BIGINT) ELSE 0 END)"


part("panel_b", [], f"""
  SELECT 'events' AS grp, CAST(user_id AS VARCHAR) AS entity, CAST(date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS INTEGER) AS period, CAST({_of('purchase')} * 10 - {_of('error')} AS DOUBLE) / 1000 AS gross,
         {', '.join(f"CAST({_of(t)} AS DOUBLE) / 100 AS {t}" for t in FLOWS_B)} FROM events GROUP BY ALL""")
part("series_b", ["panel_b"], f"SELECT entity, period, gross AS value, {', '.join(FLOWS_B)} FROM panel_b")
part("series_c", ["series_a"], f"""
  SELECT entity, period, CASE WHEN h % 10 = 0 AND period >= {A.monitor[0]} + (h // 10) % {A.monitor[1] - A.monitor[0]} THEN 0.0 ELSE value END AS value, repayments, charges
  FROM (SELECT *, CAST('0x' || substr(md5('stop|' || entity), 1, 6) AS BIGINT) AS h FROM series_a)""")


part("series_n", ["series_a"], """
  SELECT entity, period, CASE h WHEN 0 THEN NULL WHEN 2 THEN 0.0 ELSE value END AS value, repayments, charges
  FROM (SELECT *, CAST('0x' || substr(md5('hole|' || entity || '|' || period), 1, 6) AS BIGINT) % 11 AS h FROM series_a) WHERE h <> 1""")  # rows there twice have no level the second time


def pct(v: str) -> str:
    return f"printf('%+.0f%%', (exp({v}) - 1) * 100)"


def usd(v: str) -> str:
    return f"(CASE WHEN {v} < 0 THEN '$-' ELSE '$' END || format('{{:,}}', CAST(abs(round({v})) AS BIGINT)))"


def filled(template: str, *values: str) -> str:
    """A sentence of functions.text as SQL."""
    out, left = [], list(values)
    for t in re.split(r"(%[.,\d]*[sdf])", template):
        if t.startswith("%"):
            v = left.pop(0)
            out.append(f"CAST({v} AS VARCHAR)" if t in ("%s", "%d") else f"printf('{t}', CAST({v} AS DOUBLE))")
        elif t:
            out.append("'" + t.replace("'", "''") + "'")
    return "(" + " || ".join(out) + ")"


def said(kind: str, p: Params, span: str) -> str:
    """The explanation of a flagged row, as functions.text.explain_alert has it."""
    f = usd if kind == "usd" else pct
    above, z = "value > ucl", "abs(robust_z)"
    beyond = filled(X.BEYOND, "entity", "period", f"'{X.NOUN[kind]}'", f("value"), f"CASE WHEN {above} THEN 'above' ELSE 'below' END", f("lcl"), f("ucl"), span, f("center"), z, str(p.sigmas), f"({z} - {p.sigmas})", f"CASE WHEN {above} THEN {f('ucl')} ELSE {f('lcl')} END")
    shift = filled(X.SHIFT, "entity", "period", str(p.run_length), "CASE WHEN value > center THEN 'above' ELSE 'below' END", f"'{X.NOUN[kind]}'", f("center"))
    return f"CASE rule WHEN 'beyond_limits' THEN {beyond} WHEN 'sustained_shift' THEN {shift} ELSE '' END"


def chart_parts(x: str, p: Params) -> None:
    """growth_x, chart_x (limits of both charts), points_x, alerts_x, incidents_x."""
    lo, hi = p.baseline
    ml, mh = p.monitor
    part(f"growth_{x}", [f"series_{x}"], f"""
      SELECT entity, period, value, ln((v + c) / (lag(v) OVER w + c)) AS growth FROM (
        SELECT *, greatest(value, 0) AS v, greatest({p.c_floor}, {p.c_fraction} * coalesce(median(greatest(value, 0)) FILTER (period BETWEEN {lo} AND {hi}) OVER (PARTITION BY entity), median(greatest(value, 0)) OVER (PARTITION BY entity))) AS c
        FROM series_{x}) WINDOW w AS (PARTITION BY entity ORDER BY period)""")
    part(f"both_{x}", [f"growth_{x}"], f"SELECT 'A_level' AS chart, entity, period, value AS v FROM growth_{x} UNION ALL SELECT 'B_growth', entity, period, growth FROM growth_{x}")
    part(f"middle_{x}", [f"both_{x}"], f"SELECT chart, entity, count(v) FILTER (period BETWEEN {lo} AND {hi}) AS n_baseline, median(v) FILTER (period BETWEEN {lo} AND {hi}) AS center FROM both_{x} GROUP BY ALL")
    part(f"fit_{x}", [f"middle_{x}", f"both_{x}"], f"""
      SELECT m.chart, m.entity, m.n_baseline, m.center, median(abs(v - center)) FILTER (period BETWEEN {lo} AND {hi}) * {p.mad_scale} AS sigma
      FROM middle_{x} m JOIN both_{x} b ON m.chart = b.chart AND m.entity = b.entity GROUP BY ALL""")
    part(f"chart_{x}", [f"fit_{x}"], f"""
      SELECT *, CASE WHEN chart = 'A_level' THEN greatest(center - {p.sigmas} * sigma, 0) ELSE center - {p.sigmas} * sigma END AS lcl, center + {p.sigmas} * sigma AS ucl,
        CASE WHEN n_baseline < {p.min_points} THEN 'only ' || n_baseline || ' baseline years (<{p.min_points})' WHEN sigma > 0 THEN '' ELSE 'zero baseline variation (MAD = 0)' END AS reason FROM fit_{x}""")
    part(f"runs_{x}", [f"both_{x}", f"chart_{x}"], f"""
      SELECT *, count(*) OVER (PARTITION BY chart, entity, run) >= {p.run_length} AND side <> 0 AS in_run FROM (
        SELECT *, sum(fresh) OVER (PARTITION BY chart, entity ORDER BY period) AS run FROM (
          SELECT *, CASE WHEN lag(side) OVER (PARTITION BY chart, entity ORDER BY period) = side THEN 0 ELSE 1 END AS fresh FROM (
            SELECT c.*, period, v, sign(v - center) AS side FROM both_{x} b JOIN chart_{x} c USING (chart, entity) WHERE v IS NOT NULL AND reason = '')))""")
    part(f"points_{x}", [f"runs_{x}"], f"""
      SELECT *, CASE WHEN rule = '' THEN '' WHEN abs(robust_z) >= {p.high_z} THEN 'high' ELSE 'medium' END AS severity FROM (
        SELECT chart, entity, period, v AS value, center, lcl, ucl, sigma, (v - center) / sigma AS robust_z, n_baseline,
               CASE WHEN v > ucl OR v < lcl THEN 'beyond_limits' WHEN in_run THEN 'sustained_shift' ELSE '' END AS rule FROM runs_{x} WHERE period BETWEEN {ml} AND {mh})""")

    span = f"'{p.span}'"
    part(f"alerts_{x}", [f"points_{x}"], f"SELECT *, abs(robust_z) AS abs_z, CASE WHEN chart = 'A_level' THEN {said('usd', p, span)} ELSE {said('growth', p, span)} END AS explanation FROM points_{x} WHERE rule <> ''")
    incident_parts(f"{x}", f"(SELECT * FROM alerts_{x} WHERE chart = 'B_growth')", [f"alerts_{x}"], f"The FY{p.span} baseline", p, "CASE WHEN bool_or(severity = 'high') THEN 'high' ELSE 'medium' END")


def incident_parts(x: str, source: str, needs: list[str], baseline: str, p: Params, severity: str) -> None:
    part(f"grouped_{x}", needs, f"SELECT *, min(period) OVER (PARTITION BY entity, island) AS a, max(period) OVER (PARTITION BY entity, island) AS b FROM (SELECT *, period - row_number() OVER (PARTITION BY entity ORDER BY period) AS island FROM {source})")
    part(f"incidents_{x}", [f"grouped_{x}"], f"""
      SELECT 'statistical' AS source, incident_id, entity, a AS first_period, b AS last_period, n_alerts, kind, max_abs_z, severity,
        CASE kind WHEN 'persistent' THEN {filled(X.PERSISTENT, 'entity', 'n_alerts', 'a', 'b', 'moves', f"'{baseline}'", 'n_alerts')}
          WHEN 'spike_and_reversal' THEN {filled(X.REVERSAL, 'entity', 'a', pct('v1'), 'b', pct('v2'), 'a')}
          WHEN 'two_year_move' THEN {filled(X.TWO_STEP, 'entity', 'a', pct('v1'), 'b', pct('v2'))}
          ELSE said END AS summary
      FROM (SELECT *, entity || ' FY' || a || CASE WHEN b <> a THEN '-' || b ELSE '' END AS incident_id,
              CASE WHEN n_alerts >= {p.persistent} THEN 'persistent' WHEN n_alerts = 2 AND sign(z1) <> sign(z2) THEN 'spike_and_reversal' WHEN n_alerts = 2 THEN 'two_year_move' ELSE 'single' END AS kind
            FROM (SELECT entity, a, b, count(*) AS n_alerts, round_even(max(abs(robust_z)), 1) AS max_abs_z, {severity} AS severity, arg_min(robust_z, period) AS z1, arg_max(robust_z, period) AS z2,
                    arg_min(value, period) AS v1, arg_max(value, period) AS v2, arg_min(explanation, period) AS said, string_agg({pct('value')}, ', ' ORDER BY period) AS moves FROM grouped_{x} GROUP BY entity, a, b))""")


chart_parts("a", A)
chart_parts("b", B)


def zero_parts(x: str, flows: list[str], p: Params) -> None:
    still = " + ".join(f"abs({f})" for f in flows)
    part(f"zeros_{x}", [f"series_{x}"], f"""
      SELECT entity, min(period) AS first_period, max(period) AS last_period, count(*) AS n_periods, coalesce(any_value(f) < min(period), false) AS has_prior_activity,
        CASE WHEN arg_max(coalesce(nx, -1), period) = max(period) + 1 AND NOT arg_max(coalesce(nz, false), period) THEN max(period) + 1 END AS reactivated_period, any_value(l) = max(period) AS ongoing, bool_and(still) AS other_flows_zero
      FROM (SELECT *, period - row_number() OVER (PARTITION BY entity ORDER BY period) AS island FROM (
          SELECT *, value <= 0 AS z, {still} = 0 AS still, min(period) FILTER (value > 0) OVER e AS f, max(period) OVER e AS l, lead(period) OVER o AS nx, lead(value <= 0) OVER o AS nz
          FROM series_{x} WINDOW e AS (PARTITION BY entity), o AS (PARTITION BY entity ORDER BY period)) WHERE z) GROUP BY entity, island""")
    state = "CASE WHEN ongoing THEN 'still zero at FY' || last_period WHEN reactivated_period IS NOT NULL THEN 'positive again in FY' || reactivated_period ELSE 'followed by a missing FY' || (last_period + 1) || ' row' END"
    part(f"lifecycle_{x}", [f"zeros_{x}"], f"""
      SELECT 'lifecycle' AS source, entity || ' FY' || first_period || '-' || last_period || ' zero' AS incident_id, entity, first_period, last_period, CAST(0 AS BIGINT) AS n_alerts,
        CASE WHEN ongoing THEN 'zero_period_ongoing' ELSE 'zero_period_ended' END AS kind, CAST(NULL AS DOUBLE) AS max_abs_z, CASE WHEN other_flows_zero THEN 'medium' ELSE 'info' END AS severity,
        {filled(X.LIFECYCLE, 'entity', 'n_periods', 'first_period', 'last_period', state, f"CASE WHEN other_flows_zero THEN '{X.ALSO_ZERO}' ELSE '{X.STILL_FLOWING}' END")} AS summary
      FROM zeros_{x} WHERE n_periods >= {p.min_zero} AND has_prior_activity AND last_period >= {p.monitor[0]}""")


zero_parts("b", FLOWS_B, B)
zero_parts("c", FLOWS_A, A)


def engine_parts(x: str, p: Params, name: str, baseline: str, lifecycle: bool, confirm: bool) -> None:
    """raw_{name}_{x}: the verdicts of one chronological method. A confirming one gets a part for each period, since each verdict decides the next baseline."""
    t0, t1 = p.monitor
    part(f"facts_{x}", [f"series_{x}"], f"""
      SELECT *, has_growth AND (zero OR zero_prev) AS idle FROM (
        SELECT entity, period, value AS level, greatest(value, 0) AS x, value <= 0 AS zero, coalesce(lag(period) OVER w = period - 1, false) AS has_growth,
               CASE WHEN lag(period) OVER w = period - 1 THEN greatest(lag(value) OVER w, 0) END AS x_prev, coalesce(lag(period) OVER w = period - 1 AND lag(value) OVER w <= 0, false) AS zero_prev
        FROM series_{x} WHERE value IS NOT NULL WINDOW w AS (PARTITION BY entity ORDER BY period))""")
    live = "has_growth AND NOT idle" if lifecycle else "has_growth"
    names = []
    for t in range(t0, t1 + 1) if confirm else [None]:
        k = f"{name}_{x}" if t is None else f"{name}_{x}_{t}"
        flags = f"flags_{name}_{x}_{t}"
        needs = [f"facts_{x}"]
        if confirm:
            if t > t0:
                needs.append(f"raw_{name}_{x}_{t - 1}")
            part(flags, needs, f"SELECT entity, period, s FROM flags_{name}_{x}_{t - 1} UNION ALL SELECT entity, period, sign(value - center) FROM raw_{name}_{x}_{t - 1} WHERE rule = 'beyond_limits'" if t > t0 else "SELECT '' AS entity, 0 AS period, 0.0 AS s WHERE false")
            needs = [f"facts_{x}", flags]
            out = f"coalesce((f.s IS NOT NULL) AND ((n.s = -f.s AND h.period + 1 < {t}) OR q.s = -f.s OR h.period = {t} - 1), false)"
            hist = f"""SELECT h.*, {t} AS t, {out} AS held FROM facts_{x} h LEFT JOIN {flags} f ON f.entity = h.entity AND f.period = h.period
              LEFT JOIN {flags} n ON n.entity = h.entity AND n.period = h.period + 1 LEFT JOIN {flags} q ON q.entity = h.entity AND q.period = h.period - 1
              WHERE h.period < {t} AND has_growth"""
        elif baseline == "fixed":
            hist = f"SELECT h.*, j.period AS t, false AS held FROM facts_{x} h JOIN facts_{x} j USING (entity) WHERE h.period BETWEEN {p.baseline[0]} AND {p.baseline[1]} AND h.has_growth AND j.period BETWEEN {t0} AND {t1}"
        else:
            hist = f"SELECT h.*, j.period AS t, false AS held FROM facts_{x} h JOIN facts_{x} j USING (entity) WHERE h.period < j.period AND h.has_growth AND j.period BETWEEN {t0} AND {t1}"
        part(f"hist_{k}", needs, hist)
        part(f"ranked_{k}", [f"hist_{k}"], f"SELECT *, {live} AND NOT held AS ok, sum(CASE WHEN {live} AND NOT held THEN 1 ELSE 0 END) OVER (PARTITION BY entity, t ORDER BY period DESC) AS nth FROM hist_{k}")
        in_window = "true" if baseline == "fixed" else f"(nth < {p.window} OR (nth = {p.window} AND ok))"
        part(f"chosen_{k}", [f"ranked_{k}"], f"SELECT * FROM ranked_{k} WHERE ok" + ("" if baseline == "fixed" else f" AND nth <= {p.window}"))
        part(f"skips_{k}", [f"ranked_{k}"], f"SELECT entity, t, count(*) FILTER ({'idle' if lifecycle else 'false'}) AS n_idle, count(*) FILTER (held{' AND NOT idle' if lifecycle else ''}) AS n_held FROM ranked_{k} WHERE {in_window} GROUP BY ALL")
        part(f"c_{k}", [f"chosen_{k}"], f"SELECT entity, t, greatest({p.c_floor}, {p.c_fraction} * median(x)) AS c FROM (SELECT entity, t, period AS q, x FROM chosen_{k} UNION SELECT entity, t, period - 1, x_prev FROM chosen_{k}) GROUP BY ALL")
        part(f"g_{k}", [f"chosen_{k}", f"c_{k}"], f"SELECT entity, t, c, period, ln((x + c) / (x_prev + c)) AS g FROM chosen_{k} JOIN c_{k} USING (entity, t)")
        part(f"m_{k}", [f"g_{k}"], f"SELECT entity, t, any_value(c) AS c, median(g) AS center, count(*) AS n_baseline, min(period) AS base_first, max(period) AS base_last FROM g_{k} GROUP BY ALL")
        part(f"f_{k}", [f"m_{k}", f"g_{k}"], f"SELECT m.*, s.sigma FROM m_{k} m JOIN (SELECT g.entity, g.t, median(abs(g - center)) * {p.mad_scale} AS sigma FROM g_{k} g JOIN m_{k} USING (entity, t) GROUP BY ALL) s USING (entity, t)")
        part(f"j_{k}", [f"facts_{x}", f"f_{k}", f"skips_{k}"], f"""
          SELECT j.*, c, coalesce(n_baseline, 0) AS n_baseline, base_first, base_last, center AS m, sigma AS s, coalesce(n_idle, 0) AS n_idle, coalesce(n_held, 0) AS n_held,
            CASE WHEN NOT has_growth THEN 1 WHEN {str(lifecycle).lower()} AND zero AND zero_prev THEN 2 WHEN n_baseline IS NULL THEN 3 WHEN n_baseline < {p.min_points} THEN 4 WHEN sigma > 0 THEN 0 ELSE 5 END AS code
          FROM facts_{x} j LEFT JOIN f_{k} f ON f.entity = j.entity AND f.t = j.period LEFT JOIN skips_{k} k ON k.entity = j.entity AND k.t = j.period WHERE j.period BETWEEN {t0 if t is None else t} AND {t1 if t is None else t}""")
        part(f"run_{k}", [f"j_{k}", f"facts_{x}"], f"""
          SELECT j.entity, j.period, count(*) AS n, min(ln((h.x + c) / (h.x_prev + c)) - m) AS low, max(ln((h.x + c) / (h.x_prev + c)) - m) AS high, median(abs(ln((h.x + c) / (h.x_prev + c)) - m)) / any_value(s) AS run_z
          FROM j_{k} j JOIN facts_{x} h ON h.entity = j.entity AND h.period BETWEEN j.period - {p.run_length - 1} AND j.period WHERE code = 0 AND h.{live.replace('NOT idle', 'NOT h.idle')} GROUP BY ALL""")
        part(f"raw_{k}", [f"j_{k}", f"run_{k}"], f"""
          SELECT entity, period, level, code, value, center, sigma, n_baseline, n_held AS n_held_out, n_idle AS n_lifecycle_skipped, base_first, base_last, rule, CASE WHEN rule = 'sustained_shift' THEN run_z END AS run_z FROM (
            SELECT *, CASE WHEN code <> 0 THEN '' WHEN value > center + {p.sigmas} * sigma OR value < center - {p.sigmas} * sigma THEN 'beyond_limits' WHEN n = {p.run_length} AND (low > 0 OR high < 0) THEN 'sustained_shift' ELSE '' END AS rule FROM (
              SELECT j.*, r.n, r.low, r.high, r.run_z, CASE WHEN code = 0 THEN ln((x + c) / (x_prev + c)) END AS value, CASE WHEN code = 0 THEN m END AS center, CASE WHEN code = 0 THEN s END AS sigma FROM j_{k} j LEFT JOIN run_{k} r USING (entity, period)))""")
        names.append(f"raw_{k}")
    if confirm:
        part(f"raw_{name}_{x}", names, " UNION ALL ".join(f"SELECT * FROM {n}" for n in names))
    note = filled(X.BASELINE_NOTE, "n_baseline", "n_held_out", "n_lifecycle_skipped")
    part(f"pts_{name}_{x}", [f"raw_{name}_{x}"], f"""
      SELECT *, CASE WHEN rule = 'beyond_limits' THEN CASE WHEN abs(robust_z) >= {p.high_z} THEN 'high' ELSE 'medium' END WHEN rule = 'sustained_shift' THEN CASE WHEN run_z >= {p.shift_medium_z} THEN 'medium' ELSE 'low' END ELSE '' END AS severity,
        CASE WHEN rule = '' THEN '' ELSE {said('growth', p, 'baseline_span')} || CASE WHEN n_held_out + n_lifecycle_skipped > 0 THEN {note} ELSE '' END END AS explanation FROM (
        SELECT *, (value - center) / sigma AS robust_z, center - {p.sigmas} * sigma AS lcl, center + {p.sigmas} * sigma AS ucl, CASE WHEN base_first IS NULL THEN '' ELSE base_first || '-' || base_last END AS baseline_span,
          CASE code WHEN 0 THEN 'charted' WHEN 1 THEN 'no_prior_year' WHEN 2 THEN 'dormant' WHEN 3 THEN 'insufficient_history: no eligible baseline years' WHEN 4 THEN 'insufficient_history: only ' || n_baseline || ' baseline years (<{p.min_points})' ELSE 'zero_mad: zero baseline variation (MAD = 0)' END AS status
        FROM raw_{name}_{x})""")


def summary_parts(x: str) -> None:
    """cover_x and alarms_x: coverage and alarms of each method over allpts_x."""
    part(f"cover_{x}", [f"allpts_{x}"], f"""
      SELECT method, count(*) FILTER (n > 0) AS entities_monitored, CAST(sum(n) AS BIGINT) AS observations_monitored, count(*) FILTER (n = 0) AS entities_excluded, CAST(sum(d) AS BIGINT) AS dormant_observations, coalesce(any_value(excluded), '') AS excluded_reasons
      FROM (SELECT method, entity, count(*) FILTER (status = 'charted') AS n, count(*) FILTER (status = 'dormant') AS d FROM allpts_{x} GROUP BY ALL)
      LEFT JOIN (SELECT method, string_agg(reason || ': ' || k, ', ' ORDER BY k DESC, reason) AS excluded FROM (SELECT method, reason, count(*) AS k FROM (
          SELECT method, entity, arg_min(reason, (-k, reason)) AS reason FROM (SELECT method, entity, split_part(status, ':', 1) AS reason, count(*) AS k FROM allpts_{x} GROUP BY ALL) GROUP BY ALL HAVING sum(CASE WHEN reason = 'charted' THEN 1 ELSE 0 END) = 0) GROUP BY ALL) GROUP BY ALL) USING (method)
      GROUP BY method""")
    part(f"islands_{x}", [f"allpts_{x}"], f"SELECT method, entity, island, count(*) AS n FROM (SELECT *, period - row_number() OVER (PARTITION BY method, entity ORDER BY period) AS island FROM allpts_{x} WHERE rule <> '') GROUP BY ALL")
    part(f"alarms_{x}", [f"allpts_{x}", f"islands_{x}", f"lifecycle_{x}"], f"""
      SELECT method, coalesce(alerts, 0) AS alerts, coalesce(alerts_high, 0) AS alerts_high, coalesce(shift_alerts, 0) AS shift_alerts, coalesce(recurring, 0) AS recurring_entities, coalesce(incidents, 0) AS incidents, coalesce(persistent, 0) AS persistent_incidents,
        CASE WHEN method IN ('v2-fixed', 'v2-rolling') THEN (SELECT count(*) FROM lifecycle_{x}) ELSE 0 END AS lifecycle_incidents
      FROM (SELECT method, count(*) AS alerts, count(*) FILTER (severity = 'high') AS alerts_high, count(*) FILTER (rule = 'sustained_shift') AS shift_alerts FROM allpts_{x} WHERE rule <> '' GROUP BY 1)
      LEFT JOIN (SELECT method, count(*) AS recurring FROM (SELECT method, entity FROM allpts_{x} WHERE rule <> '' GROUP BY ALL HAVING count(DISTINCT period) >= 3) GROUP BY 1) USING (method)
      LEFT JOIN (SELECT method, count(*) AS incidents, count(*) FILTER (n >= 3) AS persistent FROM islands_{x} GROUP BY 1) USING (method)""")


for _x, _p in (("a", A), ("b", B), ("c", A), ("n", A)):
    engine_parts(_x, _p, "fixed", "fixed", True, False)
    engine_parts(_x, _p, "rolling", "rolling", True, True)
    engine_parts(_x, _p, "naive", "rolling", False, False)
    incident_parts(f"rolling_{_x}", f"(SELECT * FROM pts_rolling_{_x} WHERE rule <> '')", [f"pts_rolling_{_x}"], "The rolling baseline", _p, "CASE max(CASE severity WHEN 'high' THEN 3 WHEN 'medium' THEN 2 ELSE 1 END) WHEN 3 THEN 'high' WHEN 2 THEN 'medium' ELSE 'low' END")

NOTES = X.RULE_NOTES
WHY = (X.COVERAGE, X.SENSITIVITY, X.ADAPTATION)
