"""Inputs for the registered queries, derived from the driver tables by SQL that both engines accept.

Each panel is one SELECT over driver tables (``{lineitem}`` ...) or over earlier panels. ``Panels`` turns a panel into
a DataFrame; ``with_panels`` puts the same text in front of an oracle query. Numbers are rounded where they are first
derived, so both engines start from identical values.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from returnlens.session import settle

CUTOFF = "2001-06-01 00:00:00"
TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "labels"]

PANELS: dict[str, str] = {}

PANELS["shipments"] = """
SELECT CAST(l.l_shipdate AS DATE) AS event_date, l.l_quantity AS quantity, l.l_partkey AS partkey,
       l.l_suppkey AS suppkey, s.s_nationkey AS nationkey
FROM {lineitem} l JOIN {supplier} s ON l.l_suppkey = s.s_suppkey"""

PANELS["first_prints"] = """
SELECT nationkey AS security_id, event_date, 50 + avg(quantity) AS adjusted_close, count(*) AS volume
FROM shipments GROUP BY nationkey, event_date"""

PANELS["price_raw"] = """
SELECT security_id, event_date, adjusted_close AS close, adjusted_close, volume, 'USD' AS currency, 'a' AS source,
       CAST(event_date AS {ts}) + INTERVAL 1 DAY AS ingestion_time,
       CAST(event_date AS {ts}) + INTERVAL 1 DAY AS timestamp_available
FROM first_prints
UNION ALL
SELECT security_id, event_date, adjusted_close * 1.01 AS close, adjusted_close * 1.01 AS adjusted_close, volume,
       'USD' AS currency, 'b' AS source,
       CAST(event_date AS {ts}) + INTERVAL 10 DAY AS ingestion_time,
       CAST(event_date AS {ts}) + INTERVAL 10 DAY AS timestamp_available
FROM first_prints WHERE extract(DAY FROM event_date) % 5 = 0"""

PANELS["supplier_prices"] = """
SELECT suppkey AS security_id, event_date, 50 + avg(quantity) AS close, 50 + avg(quantity) AS adjusted_close,
       count(*) AS volume, 'USD' AS currency, 'a' AS source,
       CAST(event_date AS {ts}) + INTERVAL 1 DAY AS ingestion_time,
       CAST(event_date AS {ts}) + INTERVAL 1 DAY AS timestamp_available
FROM shipments GROUP BY suppkey, event_date"""

PANELS["security"] = """
SELECT n.n_nationkey AS security_id, n.n_nationkey AS company_id, n.n_name AS ticker,
       concat('Company ', n.n_name) AS legal_name,
       lpad(CAST(1000 + n.n_nationkey AS {text}), 10, '0') AS cik,
       CASE WHEN n.n_nationkey % 3 = 0 THEN 'NYSE' ELSE 'NASDAQ' END AS exchange,
       r.r_name AS sector, concat(r.r_name, '/', CAST(n.n_nationkey % 2 AS {text})) AS industry,
       concat(r.r_name, '/', CAST(n.n_nationkey % 3 AS {text})) AS subindustry
FROM {nation} n JOIN {region} r ON n.n_regionkey = r.r_regionkey"""

PANELS["ticker_history"] = """
SELECT s.security_id, s.ticker, CAST(f.first_date AS {ts}) AS active_from, CAST(NULL AS {ts}) AS active_to
FROM security s JOIN (SELECT security_id, min(event_date) AS first_date FROM first_prints GROUP BY security_id) f
  ON s.security_id = f.security_id
UNION ALL
SELECT security_id, concat('OLD_', ticker) AS ticker, CAST('1990-01-01' AS {ts}) AS active_from,
       CAST('1995-01-01' AS {ts}) AS active_to
FROM security WHERE security_id % 2 = 1
UNION ALL
SELECT 100 + security_id AS security_id, ticker, CAST('1992-01-01' AS {ts}) AS active_from, CAST(NULL AS {ts}) AS active_to
FROM security WHERE security_id % 4 = 1"""

PANELS["classification"] = """
SELECT security_id, sector, industry, subindustry, CAST('1995-01-01' AS DATE) AS event_date,
       CAST('1995-01-02' AS {ts}) AS timestamp_available
FROM security
UNION ALL
SELECT security_id, 'RETIRED' AS sector, CAST(NULL AS {text}) AS industry, CAST(NULL AS {text}) AS subindustry,
       CAST('1994-01-01' AS DATE) AS event_date, CAST('1996-01-02' AS {ts}) AS timestamp_available
FROM security WHERE security_id % 5 = 0
UNION ALL
SELECT security_id, 'FUTURE' AS sector, 'FUTURE/0' AS industry, CAST(NULL AS {text}) AS subindustry,
       CAST('1999-01-01' AS DATE) AS event_date, CAST('2009-01-02' AS {ts}) AS timestamp_available
FROM security WHERE security_id % 7 = 0"""

PANELS["market_days"] = """
SELECT event_date, round(avg(move), 6) AS return_bps FROM (
  SELECT event_date, (adjusted_close / lag(adjusted_close) OVER (PARTITION BY security_id ORDER BY event_date) - 1)
         * 10000 AS move FROM first_prints) m
WHERE move IS NOT NULL GROUP BY event_date"""

PANELS["part_halves"] = """
SELECT p_partkey AS partkey,
       CASE WHEN p_size <= 25 THEN 1 ELSE 0 END AS smb,
       CASE WHEN p_retailprice <= (SELECT avg(p_retailprice) FROM {part}) THEN 1 ELSE 0 END AS hml,
       CASE WHEN CAST(split_part(p_brand, '#', 2) AS INT) % 2 = 0 THEN 1 ELSE 0 END AS rmw,
       CASE WHEN p_type IN (SELECT p_type FROM (SELECT DISTINCT p_type FROM {part}) t ORDER BY p_type LIMIT 3)
            THEN 1 ELSE 0 END AS cma
FROM {part}"""

PANELS["half_levels"] = """
SELECT 'SMB' AS factor_name, smb AS half, event_date, 50 + avg(quantity) AS level
FROM shipments s JOIN part_halves h ON s.partkey = h.partkey GROUP BY smb, event_date
UNION ALL
SELECT 'HML' AS factor_name, hml AS half, event_date, 50 + avg(quantity) AS level
FROM shipments s JOIN part_halves h ON s.partkey = h.partkey GROUP BY hml, event_date
UNION ALL
SELECT 'RMW' AS factor_name, rmw AS half, event_date, 50 + avg(quantity) AS level
FROM shipments s JOIN part_halves h ON s.partkey = h.partkey GROUP BY rmw, event_date
UNION ALL
SELECT 'CMA' AS factor_name, cma AS half, event_date, 50 + avg(quantity) AS level
FROM shipments s JOIN part_halves h ON s.partkey = h.partkey GROUP BY cma, event_date"""

PANELS["half_moves"] = """
SELECT factor_name, half, event_date,
       (level / lag(level) OVER (PARTITION BY factor_name, half ORDER BY event_date) - 1) * 10000 AS move
FROM half_levels"""

PANELS["region_levels"] = """
SELECT concat('sector:', c.sector) AS factor_name, s.event_date, 50 + avg(s.quantity) AS level
FROM shipments s JOIN security c ON s.nationkey = c.security_id GROUP BY c.sector, s.event_date
UNION ALL
SELECT concat('industry:', c.industry) AS factor_name, s.event_date, 50 + avg(s.quantity) AS level
FROM shipments s JOIN security c ON s.nationkey = c.security_id GROUP BY c.industry, s.event_date"""

PANELS["factor_return"] = """
SELECT 'Mkt-RF' AS factor_name, 'market' AS factor_family, event_date, return_bps, 'panel' AS source,
       CAST(event_date AS {ts}) + INTERVAL 1 DAY AS timestamp_available
FROM market_days
UNION ALL
SELECT a.factor_name, 'style' AS factor_family, a.event_date, round(a.move - b.move, 6) AS return_bps,
       'panel' AS source, CAST(a.event_date AS {ts}) + INTERVAL 1 DAY AS timestamp_available
FROM half_moves a JOIN half_moves b ON a.factor_name = b.factor_name AND a.event_date = b.event_date
WHERE a.half = 1 AND b.half = 0 AND a.move IS NOT NULL AND b.move IS NOT NULL
UNION ALL
SELECT factor_name, 'sector' AS factor_family, event_date, return_bps, 'panel' AS source,
       CAST(event_date AS {ts}) + INTERVAL 1 DAY AS timestamp_available
FROM (SELECT factor_name, event_date,
        round((level / lag(level) OVER (PARTITION BY factor_name ORDER BY event_date) - 1) * 10000, 6) AS return_bps
      FROM region_levels) r
WHERE return_bps IS NOT NULL"""

PANELS["macro_series"] = """
SELECT CASE o_orderpriority WHEN '1-URGENT' THEN 'DGS2' WHEN '2-HIGH' THEN 'DGS10' WHEN '3-MEDIUM' THEN 'BAMLH0A0HYM2'
            WHEN '4-NOT SPECIFIED' THEN 'BAMLC0A0CM' ELSE 'VIXCLS' END AS series_name,
       CAST(o_orderdate AS DATE) AS event_date, round(avg(o_totalprice) / 100000, 4) AS value,
       CAST(NULL AS {text}) AS vintage, 'panel' AS source,
       CAST(CAST(o_orderdate AS DATE) AS {ts}) + INTERVAL 1 DAY AS timestamp_available
FROM {orders} GROUP BY 1, 2
UNION ALL
SELECT 'T5YIE' AS series_name, CAST(o_orderdate AS DATE) AS event_date, round(avg(o_totalprice) / 100000, 4) AS value,
       CAST(NULL AS {text}) AS vintage, 'panel' AS source,
       CAST(CAST(o_orderdate AS DATE) AS {ts}) + INTERVAL 1 DAY AS timestamp_available
FROM {orders} GROUP BY 2
UNION ALL
SELECT 'DGS2' AS series_name, CAST(o_orderdate AS DATE) AS event_date, round(avg(o_totalprice) / 90000, 4) AS value,
       'late' AS vintage, 'panel' AS source,
       CAST(CAST(o_orderdate AS DATE) AS {ts}) + INTERVAL 30 DAY AS timestamp_available
FROM {orders} WHERE o_orderpriority = '1-URGENT' AND extract(DAY FROM o_orderdate) = 7 GROUP BY 2"""

PANELS["peer_basket"] = """
SELECT security_id AS peer_basket_id, security_id AS target_security_id, 'default_peer_basket' AS basket_name,
       'panel_v0' AS basket_version, CAST('1995-01-01' AS DATE) AS event_date,
       CAST('1995-01-01' AS {ts}) AS active_from, CAST(NULL AS {ts}) AS active_to,
       CAST('1995-01-02' AS {ts}) AS timestamp_available
FROM security"""

PANELS["peer_member"] = """
SELECT a.security_id AS peer_basket_id, b.security_id AS peer_security_id,
       CAST(CASE WHEN b.security_id % 2 = 0 THEN 0.5 ELSE 0.25 END AS DOUBLE) AS weight,
       CAST('1995-01-01' AS {ts}) AS active_from,
       CASE WHEN b.security_id % 11 = 3 THEN CAST('1999-01-01' AS {ts}) ELSE CAST(NULL AS {ts}) END AS active_to,
       CAST('1995-01-02' AS {ts}) AS timestamp_available
FROM security a JOIN security b ON a.sector = b.sector"""

PANELS["company_exposure"] = """
SELECT c_nationkey AS company_id, e.exposure_name,
       round(least(CAST(1.0 AS DOUBLE), greatest(CAST(0.0 AS DOUBLE), avg(c_acctbal) / CAST(e.scale AS DOUBLE))), 4) AS exposure_value, 'panel-v0' AS model_version,
       CAST('1995-01-02' AS {ts}) AS timestamp_available
FROM {customer} CROSS JOIN (SELECT 'rates' AS exposure_name, 6000.0 AS scale UNION ALL SELECT 'credit', 9000.0
                            UNION ALL SELECT 'inflation', 7000.0) e
WHERE NOT (c_nationkey % 6 = 0 AND e.exposure_name = 'inflation')
GROUP BY c_nationkey, e.exposure_name, e.scale"""

PANELS["event"] = """
SELECT event_id, CAST(user_id % 25 AS INT) AS company_id, CAST(user_id % 25 AS INT) AS security_id,
       CASE event_type WHEN 'click' THEN '8-K' WHEN 'view' THEN '10-Q' WHEN 'purchase' THEN '10-K'
            WHEN 'signup' THEN '4' ELSE '13G' END AS event_type,
       CASE WHEN event_id % 3 = 0 THEN 'newswire' ELSE 'sec_edgar' END AS source,
       concat('acc-', CAST(event_id AS {text})) AS source_id,
       ts - INTERVAL 24 YEAR AS event_time,
       ts - INTERVAL 24 YEAR + INTERVAL 1 HOUR AS ingestion_time,
       ts - INTERVAL 24 YEAR + INTERVAL 90 MINUTE AS timestamp_available,
       CASE k % 8 WHEN 0 THEN '{{"item": " 2.02 "}}' WHEN 1 THEN '{{"item_code": "5.02"}}'
            WHEN 2 THEN '{{"eight_k_item": "7.01"}}' WHEN 3 THEN '{{"8k_item": "9.01"}}'
            WHEN 4 THEN '{{"item": "1.01"}}' WHEN 5 THEN '{{"item": null, "item_code": "2.06"}}'
            ELSE '{{}}' END AS structured_payload,
       value
FROM (SELECT *, CAST(split_part(replace(props, '}}', ''), ': ', 2) AS INT) AS k FROM {events}) e"""

PANELS["candidates"] = """
SELECT s.security_id, s.company_id, s.ticker, s.sector, s.industry, s.subindustry, p.first_price_date,
       p.price_bar_count
FROM security s JOIN (SELECT security_id, min(event_date) AS first_price_date, count(*) AS price_bar_count
                      FROM first_prints GROUP BY security_id) p ON s.security_id = p.security_id"""

PANELS["supplier_candidates"] = """
SELECT s.s_suppkey AS security_id, s.s_name AS ticker, n.n_name AS industry, r.r_name AS sector,
       concat(n.n_name, '/', CAST(s.s_suppkey % 2 AS {text})) AS subindustry, c.price_bar_count
FROM {supplier} s JOIN {nation} n ON s.s_nationkey = n.n_nationkey JOIN {region} r ON n.n_regionkey = r.r_regionkey
JOIN (SELECT suppkey, count(DISTINCT event_date) AS price_bar_count FROM shipments GROUP BY suppkey) c
  ON s.s_suppkey = c.suppkey"""

PANELS["asset"] = """
SELECT security_id AS id, lower(ticker) AS ticker, legal_name AS company_name_en,
       CAST(NULL AS {text}) AS company_name_ko, ticker AS ticker_display,
       CASE WHEN security_id % 6 = 5 THEN 'ETF' ELSE 'Stock' END AS asset_type, exchange, 'US' AS market,
       CASE WHEN security_id % 8 = 1 THEN NULL WHEN security_id % 8 = 2 THEN 'krw won' ELSE 'usd' END AS currency,
       security_id % 9 <> 4 AS is_active
FROM security"""

PANELS["price_feed"] = """
SELECT l_orderkey * 10 + l_linenumber AS id, lower(n.n_name) AS ticker, CAST(l_shipdate AS DATE) AS price_date,
       CASE WHEN l_linenumber = 1 AND l_orderkey % 50 = 0 THEN CAST(-1.0 AS DOUBLE)
            WHEN l_linenumber = 2 AND l_orderkey % 60 = 0 THEN CAST('NaN' AS DOUBLE)
            WHEN l_linenumber = 3 AND l_orderkey % 70 = 0 THEN CAST(2e12 AS DOUBLE)
            ELSE l_extendedprice END AS close,
       CAST(l_quantity AS BIGINT) AS volume
FROM {lineitem} l JOIN {supplier} s ON l.l_suppkey = s.s_suppkey JOIN {nation} n ON s.s_nationkey = n.n_nationkey"""

PANELS["filings"] = """
SELECT doc_id, concat('NATION_', CAST(doc_id % 25 AS {text}),
              CASE WHEN doc_id % 10 = 0 THEN '-PA' ELSE '' END) AS file_ticker,
       concat(lpad(CAST(doc_id - doc_id % 3 AS {text}), 10, '0'), '-24-',
              lpad(CAST(doc_id - doc_id % 3 AS {text}), 6, '0')) AS accession,
       source, text, CAST('2000-01-03' AS DATE) AS filing_date
FROM {documents}"""

PANELS["feedback"] = """
SELECT doc_id AS feedback_id, doc_id % 40 AS run_id, CASE WHEN doc_id % 2 = 0 THEN NULL ELSE doc_id % 90 END AS contribution_id,
       CASE WHEN toxic = 1 THEN 'rude' WHEN quality = 1 THEN 'correct' WHEN doc_id % 3 = 0 THEN 'missing_driver'
            ELSE 'wrong' END AS feedback,
       CASE WHEN doc_id % 5 = 0 THEN 'fx' ELSE NULL END AS missing_driver_name
FROM {labels}"""


# The same rows derived in a way that reads a large input once; DuckDB keeps the plain text above.
SPARK_FORMS: dict[str, str] = {}

SPARK_FORMS["half_levels"] = """
SELECT factor_name, half, event_date, 50 + sum(total) / sum(n) AS level
FROM (SELECT inline(array(named_struct('factor_name', 'SMB', 'half', smb), named_struct('factor_name', 'HML', 'half', hml),
                          named_struct('factor_name', 'RMW', 'half', rmw), named_struct('factor_name', 'CMA', 'half', cma))),
             event_date, total, n
      FROM (SELECT h.smb, h.hml, h.rmw, h.cma, s.event_date, sum(s.quantity) AS total, count(s.quantity) AS n
            FROM shipments s JOIN part_halves h ON s.partkey = h.partkey
            GROUP BY h.smb, h.hml, h.rmw, h.cma, s.event_date) c) l
GROUP BY factor_name, half, event_date"""


def _mentioned(text: str, names: list[str]) -> list[str]:
    words = set(re.findall(r"(?:FROM|JOIN|,)\s+(\w+)", text))
    return [n for n in names if n in words]


def _ordered(names: list[str], extra: dict[str, str]) -> list[str]:
    """The named steps and all they build on, each after its inputs."""
    known = [*PANELS, *extra]
    done: dict[str, None] = {}

    def visit(name: str) -> None:
        if name in done:
            return
        text = extra.get(name) or PANELS[name]
        for need in _mentioned(text, known):
            if need != name:
                visit(need)
        done[name] = None

    for n in names:
        visit(n)
    return list(done)


def _spark_names(sf_dir: str) -> dict[str, str]:
    files = {t: f"parquet.`{sf_dir}/{t}.parquet`" for t in TABLES}
    return {**files, "ts": "TIMESTAMP_NTZ", "text": "STRING"}


DUCK_NAMES = {**{t: t for t in TABLES}, "ts": "TIMESTAMP", "text": "VARCHAR"}


_written: dict[tuple[str, str, str], DataFrame] = {}


class Panels:
    """Panels of one data folder as DataFrames, each derived once per application and read back as a table."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        if name not in PANELS:
            raise AttributeError(name)
        key = (self.spark.sparkContext.applicationId, self.sf_dir, name)
        if key not in _written:
            needs = {n: getattr(self, n) for n in _mentioned(PANELS[name], list(PANELS)) if n != name}
            ctes = ", ".join(f"{n} AS (SELECT * FROM {{{n}}})" for n in needs)
            text = SPARK_FORMS.get(name, PANELS[name]).format(**_spark_names(self.sf_dir))
            derived = self.spark.sql(f"WITH {ctes} {text}" if needs else text, **needs)
            _written[key] = settle(derived, name)
        return _written[key]

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")


def with_panels(body: str, steps: dict[str, str]) -> str:
    """Oracle text: every panel and shared step the body uses, then the body."""
    used = _mentioned(body, [*PANELS, *steps])
    ctes = []
    for n in _ordered(used, steps):
        text = steps.get(n) or PANELS[n].format(**DUCK_NAMES)
        ctes.append(f"{n} AS ({text})")
    return f"WITH {', '.join(ctes)}\n{body}" if ctes else body
