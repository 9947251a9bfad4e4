"""Pieces of DuckDB SQL for the checks of the wind jobs."""

from __future__ import annotations

from windrift.functions.values import TICK
from windrift.operators.metrics import GUST_MS, MEAN_MS, SHIFT_MS
from windrift.operators.points import VENUES
from windrift.sources.adapters import VENUES as NAMES


def r(x: str, digits: int = 6) -> str:
    return f"(CASE WHEN isfinite({x}) THEN floor(({x}) * 1e{digits} + 0.5e0) / 1e{digits} END)"


def wrap(x: str) -> str:
    return f"((({x}) % 360e0 + 360e0) % 360e0)"


def turn(a: str, b: str) -> str:
    return f"({wrap(f'({b}) - ({a}) + 180e0')} - 180e0)"


def circ_mean(s: str, c: str) -> str:
    return wrap(f"degrees(atan2({s}, {c}))")


def circ_std(s: str, c: str) -> str:
    m = f"least(sqrt(({s}) * ({s}) + ({c}) * ({c})), 1e0)"
    return f"(CASE WHEN {m} <= 0 THEN 180e0 ELSE degrees(sqrt(-2e0 * ln(CASE WHEN {m} > 0 THEN {m} END))) END)"


def ratio(a: str, b: str) -> str:
    return f"(CASE WHEN ({b}) <> 0 THEN ({a}) / ({b}) END)"


SESSION = f"lpad(CAST(user_id // 3 AS VARCHAR), 4, '0') || '_' || list_extract({list(NAMES)!r}, CAST(user_id % {len(NAMES)} AS INT) + 1) || '_' || user_id || '.txt'"
VENUE = "CASE " + " ".join(f"WHEN contains(upper(session_id), '{a}') THEN '{b}'" for a, b in VENUES) + " ELSE 'Other' END"
POINTS = f"""raw0 AS (SELECT {SESSION} AS session_id, event_id AS id, user_id, epoch_us(ts) AS us, CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) AS k,
  CASE WHEN event_id % 53 <> 0 THEN 2 + (7e-1 + 4e-1 * (user_id % 5)) * sqrt(value) END AS wind_kts, (event_id % 97)::DOUBLE / 97 * 10 AS boat_kts, event_id FROM events),
raw AS (SELECT *, (us - min(us) OVER (PARTITION BY session_id)) // 3600000 AS t_ms,
  CASE WHEN event_id % 41 <> 0 THEN {wrap("200 + list_extract([40e0, 80e0, 95e0, 115e0], CAST((user_id // 5) % 4 AS INT) + 1) * (k - 50) / 50")} END AS wind_dir FROM raw0),
clean AS (SELECT session_id, {VENUE} AS venue, user_id, k, t_ms, row_number() OVER (PARTITION BY session_id ORDER BY t_ms, id) AS seq, wind_kts, wind_dir, boat_kts FROM raw),
delta AS (SELECT *, t_ms - lag(t_ms) OVER (PARTITION BY session_id ORDER BY seq) AS d FROM clean),
med AS (SELECT *, coalesce(quantile_cont(CASE WHEN d > 0 AND d < 30000 THEN d END, 0.5) OVER (PARTITION BY session_id), 2000e0) AS step_ms FROM delta),
points AS (SELECT * EXCLUDE (d), CAST(floor(sum(least(coalesce(d, 0)::DOUBLE, greatest(3 * step_ms, 10000e0))) OVER (PARTITION BY session_id ORDER BY seq) + 0.5e0) AS BIGINT) AS active_ms FROM med),
numbered AS (SELECT *, count(*) OVER (PARTITION BY session_id) AS n_all, row_number() OVER (PARTITION BY session_id ORDER BY seq) - 1 AS i FROM points),
fanned AS (SELECT * EXCLUDE (n_all, i), s AS strategy FROM numbered, (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS s)
  WHERE CASE s WHEN 'A' THEN TRUE WHEN 'B' THEN i >= floor(n_all * 1e-1) AND i < n_all - floor(n_all * 1e-1) WHEN 'C' THEN i >= floor(n_all * 15e-2) AND i < n_all - floor(n_all * 15e-2) WHEN 'D' THEN boat_kts > 3 ELSE wind_kts > 3 END)"""


def features(source: str, by: str = "session_id, strategy", time: str = "t_ms") -> str:
    """CTEs f1 to f4 over ``source``; f4 has the inputs of all measures."""
    p, o = f"PARTITION BY {by}", f"PARTITION BY {by} ORDER BY {time} * {TICK} + seq"
    tr = lambda ms: f"({o} RANGE BETWEEN {ms * TICK + TICK - 1} PRECEDING AND CURRENT ROW)"
    g, m, s = tr(GUST_MS), tr(MEAN_MS), tr(SHIFT_MS)
    prev = f"({o} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    return f"""f0 AS (SELECT *, {time}::DOUBLE AS t, sin(radians(wind_dir)) AS sn, cos(radians(wind_dir)) AS cs, CASE WHEN wind_kts IS NOT NULL THEN {time}::DOUBLE END AS tw, CASE WHEN wind_dir IS NOT NULL THEN {time}::DOUBLE END AS td FROM {source}),
f1 AS (SELECT *, last_value(wind_dir IGNORE NULLS) OVER {prev} AS prev_dir, lag(wind_kts) OVER ({o}) AS last_wind, lag(wind_dir) OVER ({o}) AS last_dir,
  CASE WHEN wind_kts IS NOT NULL AND t - min(tw) OVER {g} >= {GUST_MS // 2} AND count(wind_kts) OVER {g} >= 5 THEN {ratio(f"max(wind_kts) OVER {g} - min(wind_kts) OVER {g}", f"avg(wind_kts) OVER {g}")} END AS gust,
  CASE WHEN wind_kts IS NOT NULL AND count(wind_kts) OVER {m} >= 3 THEN avg(wind_kts) OVER {m} END AS mean30,
  CASE WHEN row_number() OVER ({p} ORDER BY wind_kts NULLS LAST) <= greatest(1, floor(count(wind_kts) OVER ({p}) * 1e-1)) THEN wind_kts END AS low,
  CASE WHEN row_number() OVER ({p} ORDER BY wind_kts DESC NULLS LAST) <= greatest(1, floor(count(wind_kts) OVER ({p}) * 1e-1)) THEN wind_kts END AS high,
  wind_kts - (coalesce(regr_slope(wind_kts, tw) OVER ({p}), 0) * t + coalesce(regr_intercept(wind_kts, tw) OVER ({p}), avg(wind_kts) OVER ({p}))) AS residual,
  {circ_mean(f"avg(sn) OVER ({p})", f"avg(cs) OVER ({p})")} AS centre,
  CASE WHEN wind_dir IS NOT NULL AND count(wind_dir) OVER {s} >= 5 THEN {circ_mean(f"avg(sn) OVER {s}", f"avg(cs) OVER {s}")} END AS rolling,
  first_value(wind_dir IGNORE NULLS) OVER ({o} ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS first_dir, count(wind_dir) OVER ({p}) AS n_dir, count(wind_dir) OVER ({o} ROWS UNBOUNDED PRECEDING) AS at_dir FROM f0),
f2 AS (SELECT *, CASE WHEN wind_dir IS NOT NULL THEN {turn("prev_dir", "wind_dir")} END AS step, abs({turn("centre", "wind_dir")}) AS away,
  CASE WHEN abs({turn("rolling", "wind_dir")}) >= 1e-6 THEN sign({turn("rolling", "wind_dir")}) END AS sg FROM f1),
f3 AS (SELECT *, CASE WHEN wind_dir IS NOT NULL THEN first_dir + coalesce(sum(step) OVER ({o} ROWS UNBOUNDED PRECEDING), 0) END AS unwrapped,
  coalesce(sg <> last_value(sg IGNORE NULLS) OVER {prev}, FALSE) AS flip FROM f2),
f4 AS (SELECT *, unwrapped - (coalesce(regr_slope(unwrapped, td) OVER ({p}), 0) * t + coalesce(regr_intercept(unwrapped, td) OVER ({p}), avg(unwrapped) OVER ({p}))) AS bend FROM f3)"""


_EN = "CASE WHEN count(wind_kts) >= 20 THEN {} END"
_ED = "CASE WHEN count(wind_dir) >= 20 THEN {} END"
_Q = "quantile_cont(wind_kts, {})"
_HALF = lambda c, part: f"avg({c}) FILTER (WHERE wind_dir IS NOT NULL AND {part})"
_E, _L = "at_dir <= floor(n_dir / 4)", "at_dir > n_dir - floor(n_dir / 4)"
_BOTH = "wind_kts IS NOT NULL AND last_wind IS NOT NULL AND wind_dir IS NOT NULL AND last_dir IS NOT NULL"
_CORR = lambda a, b, w: f"coalesce(CASE WHEN isfinite(corr({a}, {b}) FILTER (WHERE {w})) THEN corr({a}, {b}) FILTER (WHERE {w}) END, 0)"
MEASURES = {
    "cv": _EN.format(ratio("stddev_pop(wind_kts)", "avg(wind_kts)")),
    "iqrRatio": _EN.format(ratio(f"{_Q.format(0.75)} - {_Q.format(0.25)}", _Q.format(0.5))),
    "gustFactor": "avg(gust)",
    "lullPeakRatio": _EN.format(ratio("avg(high) - avg(low)", _Q.format(0.5))),
    "shortTermVariance": "CASE WHEN count(mean30) >= 20 THEN stddev_pop(mean30) END",
    "detrendedCv": _EN.format(ratio("stddev_pop(abs(residual))", "avg(wind_kts)")),
    "circularStdDev": _ED.format(circ_std("avg(sn)", "avg(cs)")),
    "medianAbsAngularDeviation": _ED.format("quantile_cont(away, 0.5)"),
    "rollingShiftFrequency": _ED.format(ratio("(count(*) FILTER (WHERE abs(step) > 5))", "((max(td) - min(td)) / 3600000)")),
    "detrendedCircularStdDev": _ED.format(circ_std("avg(sin(radians(bend)))", "avg(cos(radians(bend)))")),
    "oscillationIndex": f"CASE WHEN count(rolling) >= 20 THEN {ratio('(count(*) FILTER (WHERE flip))', '((max(t) FILTER (WHERE rolling IS NOT NULL) - min(t) FILTER (WHERE rolling IS NOT NULL)) / 3600000)')} END",
    "phasePersistence": f"CASE WHEN count(rolling) >= 20 THEN {ratio('(max(t) FILTER (WHERE flip) - min(t) FILTER (WHERE sg IS NOT NULL)) / 60000', '(count(*) FILTER (WHERE flip))')} END",
    "lullAverage": "avg(low)",
    "peakAverage": "avg(high)",
    "meanWindSpeed": "avg(wind_kts)",
    "medianWindSpeed": _Q.format(0.5),
    "windRange": "max(wind_kts) - min(wind_kts)",
    "circularMean": circ_mean("avg(sn)", "avg(cs)"),
    "speedTrendSlope": "coalesce(CASE WHEN count(wind_kts) >= 2 THEN regr_slope(wind_kts, tw / 3600000) END, 0)",
    "directionTrendDeg": f"CASE WHEN count(wind_dir) >= 4 THEN {turn(_HALF('unwrapped', _E), _HALF('unwrapped', _L))} ELSE 0 END",
    "directionTrendCircular": f"CASE WHEN count(wind_dir) >= 4 THEN {turn(circ_mean(_HALF('sn', _E), _HALF('cs', _E)), circ_mean(_HALF('sn', _L), _HALF('cs', _L)))} ELSE 0 END",
    "pressureShiftCorrelation": f"CASE WHEN count(wind_kts) = count(wind_dir) AND count(wind_kts) >= 3 THEN {_CORR('wind_kts', 'away', 'TRUE')} ELSE 0 END",
    "speedDirectionCoherence": f"CASE WHEN count(*) FILTER (WHERE {_BOTH}) >= 3 THEN {_CORR('abs(wind_kts - last_wind)', 'abs(' + turn('last_dir', 'wind_dir') + ')', _BOTH)} ELSE 0 END",
    "unwrappedTurn": "max(unwrapped) - min(unwrapped)",
    "rollingMeans": "count(rolling)::DOUBLE",
}
CALIBRATED = list(MEASURES)[:12]


def measure(names: list[str], strategy: str = "E", time: str = "t_ms", zero_filled: bool = False) -> str:
    """WITH ... of a CTE ``m`` (session_id, venue, measures as rounded numbers) under one strategy."""
    value = lambda n: r(f"(coalesce({MEASURES[n]}, 0))" if zero_filled else f"({MEASURES[n]})")
    return f"""WITH {POINTS}, src AS (SELECT * FROM fanned WHERE strategy = '{strategy}'), {features("src", "session_id", time)},
m AS (SELECT session_id, venue, {", ".join(f'{value(n)} AS "{n}"' for n in names)} FROM f4 GROUP BY session_id, venue)"""


def table() -> str:
    """WITH ... of a CTE ``mt`` (session_id, venue, strategy, metric, value)."""
    rows = " UNION ALL ".join(f"""SELECT session_id, venue, strategy, '{n}' AS metric, "{n}" AS value FROM wide""" for n in CALIBRATED)
    wide = ", ".join(f'({MEASURES[n]}) AS "{n}"' for n in CALIBRATED)
    return f"WITH {POINTS}, {features('fanned')}, wide AS MATERIALIZED (SELECT session_id, venue, strategy, {wide} FROM f4 GROUP BY session_id, venue, strategy), mt AS MATERIALIZED ({rows})"
