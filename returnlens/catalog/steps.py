"""Shared oracle steps: the inputs of the models written once as plain SQL."""

from __future__ import annotations

from returnlens.catalog.panels import CUTOFF
from returnlens.catalog.registry import STEPS

LOOKBACK = 252
AT = f"TIMESTAMP '{CUTOFF}'"

STEPS["bars"] = f"""
SELECT security_id, event_date, close, adjusted_close, volume, currency, source, ingestion_time, timestamp_available
FROM (SELECT *, row_number() OVER (PARTITION BY security_id, event_date
                                   ORDER BY timestamp_available DESC, source) AS rn
      FROM price_raw WHERE timestamp_available <= {AT}) r WHERE rn = 1"""

STEPS["rets"] = """
SELECT security_id, event_date, adjusted_close,
       lag(event_date) OVER (PARTITION BY security_id ORDER BY event_date) AS prev_date,
       (adjusted_close / lag(adjusted_close) OVER (PARTITION BY security_id ORDER BY event_date) - 1) * 10000
         AS return_bps
FROM bars"""

STEPS["all_windows"] = """
SELECT security_id, 'daily' AS cadence, prev_date AS window_start, event_date AS window_end FROM rets
WHERE prev_date IS NOT NULL
UNION ALL
SELECT security_id, 'weekly', min(event_date), max(event_date) FROM bars
GROUP BY security_id, isoyear(event_date), weekofyear(event_date) HAVING count(*) >= 2
UNION ALL
SELECT security_id, 'monthly', min(event_date), max(event_date) FROM bars
GROUP BY security_id, year(event_date), month(event_date) HAVING count(*) >= 2"""

STEPS["observed"] = """
SELECT w.*, (e.adjusted_close / s.adjusted_close - 1) * 10000 AS observed_return_bps
FROM all_windows w JOIN bars s ON s.security_id = w.security_id AND s.event_date = w.window_start
JOIN bars e ON e.security_id = w.security_id AND e.event_date = w.window_end"""

STEPS["coverage"] = """
SELECT security_id, min(event_date) AS first_price_date, max(event_date) AS last_price_date,
       count(*) AS price_bar_count FROM bars GROUP BY security_id"""

STEPS["win"] = f"""
SELECT o.* FROM observed o JOIN coverage c ON o.security_id = c.security_id
WHERE o.window_start >= c.first_price_date + {LOOKBACK}"""

STEPS["fac"] = f"""
SELECT factor_name AS series_key, event_date, return_bps AS value, CAST(NULL AS DATE) AS prev_date
FROM (SELECT *, row_number() OVER (PARTITION BY factor_name, event_date ORDER BY timestamp_available DESC, source) AS rn
      FROM factor_return WHERE timestamp_available <= {AT}) f WHERE rn = 1"""

STEPS["mac"] = f"""
SELECT series_name, event_date, value
FROM (SELECT *, row_number() OVER (PARTITION BY series_name, event_date
                                   ORDER BY timestamp_available DESC, source, vintage NULLS LAST) AS rn
      FROM macro_series WHERE timestamp_available <= {AT}) m WHERE rn = 1"""

STEPS["macro_levels"] = """
SELECT CASE series_name WHEN 'DGS2' THEN 'macro:2y_yield_change' WHEN 'DGS10' THEN 'macro:10y_yield_change'
            WHEN 'BAMLH0A0HYM2' THEN 'macro:hy_spread_change' WHEN 'BAMLC0A0CM' THEN 'macro:ig_spread_change'
            WHEN 'VIXCLS' THEN 'macro:vix_return' ELSE 'macro:inflation_expectation_change' END AS series_key,
       event_date, value FROM mac
UNION ALL
SELECT 'macro:2s10s_curve_change', a.event_date, a.value - b.value
FROM mac a JOIN mac b ON a.event_date = b.event_date AND a.series_name = 'DGS10' AND b.series_name = 'DGS2'"""

STEPS["macro_moves"] = """
SELECT series_key, event_date, value, prev_date FROM (
  SELECT series_key, event_date,
         CASE WHEN series_key = 'macro:vix_return'
              THEN (value / nullif(lag(value) OVER (PARTITION BY series_key ORDER BY event_date), 0) - 1) * 10000
              ELSE (value - lag(value) OVER (PARTITION BY series_key ORDER BY event_date)) * 100 END AS value,
         lag(event_date) OVER (PARTITION BY series_key ORDER BY event_date) AS prev_date
  FROM macro_levels) m WHERE value IS NOT NULL"""

STEPS["classes"] = f"""
SELECT security_id, sector, industry FROM (
  SELECT *, row_number() OVER (PARTITION BY security_id ORDER BY event_date DESC) AS rn FROM classification
  WHERE timestamp_available <= {AT}) c WHERE rn = 1"""

STEPS["seen_members"] = f"""
SELECT b.target_security_id, b.basket_name, b.basket_version, m.peer_security_id, m.weight, m.active_from, m.active_to
FROM (SELECT *, row_number() OVER (PARTITION BY target_security_id ORDER BY event_date DESC, peer_basket_id) AS rn
      FROM peer_basket WHERE timestamp_available <= {AT} AND active_from <= {AT}
                         AND (active_to IS NULL OR active_to > {AT})) b
JOIN peer_member m ON m.peer_basket_id = b.peer_basket_id
WHERE b.rn = 1 AND m.peer_security_id <> b.target_security_id AND m.timestamp_available <= {AT}"""

STEPS["weights"] = f"""
SELECT target_security_id, basket_name, basket_version, peer_security_id,
       weight / sum(weight) OVER (PARTITION BY target_security_id) AS weight,
       count(*) OVER (PARTITION BY target_security_id) AS active_members
FROM seen_members
WHERE target_security_id IN (SELECT target_security_id FROM seen_members GROUP BY 1 HAVING count(*) >= 3)
  AND active_from <= {AT} AND (active_to IS NULL OR active_to > {AT}) AND weight > 0"""

STEPS["peer_moves"] = """
SELECT concat('peer:', w.target_security_id) AS series_key, w.target_security_id, r.event_date,
       sum(w.weight * r.return_bps) AS value, CAST(NULL AS DATE) AS prev_date
FROM weights w JOIN rets r ON r.security_id = w.peer_security_id AND r.return_bps IS NOT NULL
GROUP BY w.target_security_id, r.event_date HAVING count(*) = max(w.active_members)"""

STEPS["gates"] = f"""
SELECT s.security_id, g.series_key,
       CAST(least(1.0, greatest(0.0, coalesce(e.exposure_value, g.otherwise))) AS DOUBLE) AS gate
FROM security s CROSS JOIN (VALUES ('macro:2y_yield_change', 'rates', 1.0), ('macro:10y_yield_change', 'rates', 1.0),
  ('macro:2s10s_curve_change', 'rates', 1.0), ('macro:hy_spread_change', 'credit', 1.0),
  ('macro:ig_spread_change', 'credit', 1.0), ('macro:vix_return', 'none', 1.0),
  ('macro:inflation_expectation_change', 'inflation', 0.5)) g(series_key, exposure_name, otherwise)
LEFT JOIN (SELECT * FROM company_exposure WHERE timestamp_available <= {AT}) e
  ON e.company_id = s.company_id AND e.exposure_name = g.exposure_name"""

STEPS["assigned"] = """
SELECT security_id, concat('sector:', sector) AS series_key, 'sector' AS driver,
       concat('Sector/industry factor (sector:', sector, ')') AS name, 1.0 AS gate, 10 AS floor FROM classes
UNION ALL
SELECT security_id, concat('industry:', industry), 'sector',
       concat('Sector/industry factor (industry:', industry, ')'), 1.0, 10 FROM classes
WHERE industry IS NOT NULL AND industry <> ''
UNION ALL
SELECT DISTINCT target_security_id, concat('peer:', target_security_id), 'peer',
       concat('Peer basket (', basket_name, ')'), 1.0, 10 FROM weights
UNION ALL
SELECT security_id, series_key, 'macro', concat('Macro factor (', series_key, ')'), gate, 20 FROM gates WHERE gate > 0"""

STEPS["assigned_market"] = """
SELECT security_id, 'Mkt-RF' AS series_key, 'market' AS driver, 'Market factor (Mkt-RF)' AS name, 1.0 AS gate, 5 AS floor
FROM security"""

STEPS["all_series"] = """
SELECT series_key, event_date, value, prev_date FROM fac
UNION ALL SELECT series_key, event_date, value, prev_date FROM macro_moves
UNION ALL SELECT series_key, event_date, value, prev_date FROM peer_moves"""


def fitted(assigned: str, driver: str | None = None, windows: str = "win") -> dict[str, str]:
    """Steps giving ``fits_<assigned>``: beta, move and bps for every window and assigned series."""
    only = f"WHERE driver = '{driver}'" if driver else ""
    tag = f"{assigned}_{driver or 'all'}"
    return {
        f"chosen_{tag}": f"SELECT * FROM {assigned} {only}",
        f"pairs_{tag}": f"""
SELECT a.security_id, a.series_key, r.event_date, r.return_bps AS y, s.value AS x,
       least(r.prev_date, coalesce(s.prev_date, r.prev_date)) AS usable_from
FROM chosen_{tag} a JOIN rets r ON r.security_id = a.security_id AND r.return_bps IS NOT NULL
JOIN all_series s ON s.series_key = a.series_key AND s.event_date = r.event_date""",
        f"betas_{tag}": f"""
SELECT w.security_id, p.series_key, w.window_start, count(*) AS observations,
       CASE WHEN isnan(regr_slope(p.y, p.x)) THEN 0.0 ELSE coalesce(regr_slope(p.y, p.x), 0.0) END AS beta
FROM (SELECT DISTINCT security_id, window_start FROM {windows}) w
JOIN pairs_{tag} p ON p.security_id = w.security_id AND p.event_date < w.window_start
  AND p.event_date >= w.window_start - {LOOKBACK} AND p.usable_from >= w.window_start - {LOOKBACK}
GROUP BY w.security_id, p.series_key, w.window_start""",
        f"moves_{tag}": f"""
SELECT w.security_id, w.cadence, w.window_start, w.window_end, a.series_key, coalesce(sum(s.value), 0.0) AS move
FROM {windows} w JOIN chosen_{tag} a ON a.security_id = w.security_id
LEFT JOIN all_series s ON s.series_key = a.series_key AND s.event_date > w.window_start
  AND s.event_date <= w.window_end
GROUP BY ALL""",
        f"fits_{tag}": f"""
SELECT w.security_id, w.cadence, w.window_start, w.window_end, w.observed_return_bps, a.driver, a.name, a.gate,
       b.observations, b.beta, m.move, b.beta * m.move * a.gate AS contribution_bps
FROM {windows} w JOIN betas_{tag} b ON b.security_id = w.security_id AND b.window_start = w.window_start
JOIN chosen_{tag} a ON a.security_id = b.security_id AND a.series_key = b.series_key AND b.observations >= a.floor
JOIN moves_{tag} m ON m.security_id = w.security_id AND m.cadence = w.cadence AND m.window_start = w.window_start
  AND m.window_end = w.window_end AND m.series_key = a.series_key""",
    }


for _assigned, _drivers in (("assigned", ["sector", "peer", "macro"]), ("assigned_market", ["market"])):
    for _driver in _drivers:
        STEPS.update(fitted(_assigned, _driver))


def _solve(n: int) -> list[tuple[str, str]]:
    """Cholesky factorisation and the two substitutions for an n-variable fit, as (column, expression) pairs."""
    out = []
    for j in range(1, n + 1):
        inner = " - ".join([f"s{j}{j}", *[f"l{j}{k} * l{j}{k}" for k in range(1, j)]])
        out.append((f"l{j}{j}", f"sqrt({inner})"))
        for i in range(j + 1, n + 1):
            inner = " - ".join([f"s{j}{i}", *[f"l{i}{k} * l{j}{k}" for k in range(1, j)]])
            out.append((f"l{i}{j}", f"({inner}) / l{j}{j}"))
    for i in range(1, n + 1):
        inner = " - ".join([f"t{i}", *[f"l{i}{k} * z{k}" for k in range(1, i)]])
        out.append((f"z{i}", f"({inner}) / l{i}{i}"))
    for i in range(n, 0, -1):
        inner = " - ".join([f"z{i}", *[f"l{k}{i} * b{k}" for k in range(i + 1, n + 1)]])
        out.append((f"b{i}", f"({inner}) / l{i}{i}"))
    return out


_cov = ", ".join(f"covar_pop(x{i}, x{j}) AS s{i}{j}" for i in range(1, 6) for j in range(i, 6))
_tgt = ", ".join(f"covar_pop(y, x{i}) AS t{i}" for i in range(1, 6))

STEPS["five_wide"] = """
SELECT event_date, max(CASE WHEN series_key = 'Mkt-RF' THEN value END) AS x1,
       max(CASE WHEN series_key = 'SMB' THEN value END) AS x2, max(CASE WHEN series_key = 'HML' THEN value END) AS x3,
       max(CASE WHEN series_key = 'RMW' THEN value END) AS x4, max(CASE WHEN series_key = 'CMA' THEN value END) AS x5
FROM fac GROUP BY event_date HAVING count(*) FILTER (WHERE series_key IN ('Mkt-RF', 'SMB', 'HML', 'RMW', 'CMA')) = 5"""

STEPS["five_cov"] = f"""
SELECT w.security_id, w.window_start, count(*) AS observations, {_cov}, {_tgt}
FROM (SELECT DISTINCT security_id, window_start FROM win) w
JOIN (SELECT r.security_id, r.event_date, r.prev_date, r.return_bps AS y, f.x1, f.x2, f.x3, f.x4, f.x5
      FROM rets r JOIN five_wide f ON f.event_date = r.event_date WHERE r.return_bps IS NOT NULL) p
  ON p.security_id = w.security_id AND p.event_date < w.window_start
 AND p.event_date >= w.window_start - {LOOKBACK} AND p.prev_date >= w.window_start - {LOOKBACK}
GROUP BY w.security_id, w.window_start HAVING count(*) >= 10"""

_inner = "SELECT * FROM five_cov"
for _name, _expr in _solve(5):
    _inner = f"SELECT *, {_expr} AS {_name} FROM ({_inner}) q"
STEPS["five_fit"] = _inner

STEPS["five_moves"] = """
SELECT w.security_id, w.cadence, w.window_start, w.window_end, w.observed_return_bps, f.series_key,
       coalesce(sum(s.value), 0.0) AS move
FROM win w CROSS JOIN (VALUES ('Mkt-RF'), ('SMB'), ('HML'), ('RMW'), ('CMA')) f(series_key)
LEFT JOIN fac s ON s.series_key = f.series_key AND s.event_date > w.window_start AND s.event_date <= w.window_end
GROUP BY ALL"""

STEPS["fits_five"] = """
SELECT m.security_id, m.cadence, m.window_start, m.window_end, m.observed_return_bps,
       CASE WHEN m.series_key = 'Mkt-RF' THEN 'market' ELSE 'style' END AS driver,
       concat('French factor (', m.series_key, ')') AS name, f.observations,
       CASE m.series_key WHEN 'Mkt-RF' THEN b1 WHEN 'SMB' THEN b2 WHEN 'HML' THEN b3 WHEN 'RMW' THEN b4 ELSE b5 END AS beta,
       m.move,
       CASE m.series_key WHEN 'Mkt-RF' THEN b1 WHEN 'SMB' THEN b2 WHEN 'HML' THEN b3 WHEN 'RMW' THEN b4 ELSE b5 END
         * m.move AS contribution_bps
FROM five_moves m JOIN five_fit f ON f.security_id = m.security_id AND f.window_start = m.window_start"""
