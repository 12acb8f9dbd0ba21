"""DuckDB SQL for the integrity checks, the metrics and the loader queries."""

from __future__ import annotations

from candela.plans.oracle import BASE, corr, day, r, text  # noqa: F401
from candela.plans.quality import PERIODS, SPOT_DAYS, STATS

K = "asset_id::INT AS asset_id, symbol, date"
NULLS = ("daily_return_pct", "daily_range_pct", "vol_7d", "vol_30d", "sma_7", "sma_30", "volume_ratio_30d")
VALUES = ("ret", "rng", "vol_7d", "vol_30d", "sma_7", "sma_30", "vr")
WANT = (1, 0, 7, 30, 6, 29, 30)
SHORT = ("null_return", "null_range", "null_vol7", "null_vol30", "null_sma7", "null_sma30", "null_volratio")
PREV = "pp AS (SELECT d.*, close, lag(close) OVER (PARTITION BY p.asset_id ORDER BY p.date) AS prev_close FROM dp p JOIN dm d ON d.asset_id = p.asset_id AND d.date = p.date)"


def bound(f: str, n: int) -> str:
    return f"{f}(close) OVER (PARTITION BY asset_id ORDER BY date ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW) AS {f}_close_{n}"


def off(i: int) -> str:
    return f"(n > {WANT[i]}) = ({VALUES[i]} IS NULL)"


def stats() -> str:
    own = dict(zip(NULLS, VALUES, strict=True))
    return ", ".join(f"min({own[c]}) AS {k}_min, max({own[c]}) AS {k}_max" + ("" if k.startswith("sma") else f", {r(f'avg({own[c]})', 4)} AS {k}_avg") for k, c in STATS.items())


BOTH = "FROM dm WHERE vol_7d IS NOT NULL AND vol_30d IS NOT NULL"

#: Bars as a broken feed gives them, with what each violates.
BROKEN = '''broken AS (
  SELECT a AS asset_id, d AS date, list_filter([
    CASE WHEN n = 4 THEN 'not null (close)' END, CASE WHEN n = 3 THEN 'check (close)' END, CASE WHEN n = 9 THEN 'check (volume)' END, CASE WHEN n = 8 THEN 'domain (volume_usd)' END,
    CASE WHEN n = 6 THEN 'reference (asset_id)' END, CASE WHEN n = 7 THEN 'reference (date)' END, CASE WHEN count(*) OVER (PARTITION BY a, d) > 1 THEN 'key (asset_id, date)' END], lambda x: x IS NOT NULL) AS violations
  FROM (
    SELECT CASE WHEN day(date) = 6 THEN 99 ELSE asset_id END::INT AS a, CASE WHEN day(date) = 7 THEN date + 40000 ELSE date END AS d, day(date) AS n FROM daily_prices
    UNION ALL SELECT asset_id::INT, date, 5 FROM daily_prices WHERE day(date) = 5))'''

QUERIES: dict[str, tuple[str, str]] = {
    "c1_1": ("", "SELECT 'daily_prices' AS table_name, count(*) AS row_count FROM daily_prices UNION ALL SELECT 'daily_metrics', count(*) FROM daily_metrics"),
    "c1_2": ("", "SELECT asset_id::INT AS asset_id, symbol, a.n AS price_rows, b.n AS metric_rows, a.n - b.n AS row_difference FROM (SELECT asset_id, symbol, count(*) AS n FROM dp GROUP BY ALL) a JOIN (SELECT asset_id, count(*) AS n FROM dm GROUP BY ALL) b USING (asset_id)"),
    "c1_3": ("", f"SELECT {K} FROM dp WHERE NOT EXISTS (FROM daily_metrics m WHERE m.asset_id = dp.asset_id AND m.date = dp.date)"),
    "c1_4": ("", f"SELECT {K} FROM dm WHERE NOT EXISTS (FROM daily_prices p WHERE p.asset_id = dm.asset_id AND p.date = dm.date)"),
    "c2_1": ("", "SELECT asset_id::INT AS asset_id, symbol, count(*) AS total_rows, " + ", ".join(f"count(*) - count({v}) AS null_{c}" for c, v in zip(NULLS, VALUES, strict=True)) + " FROM dm GROUP BY asset_id, symbol"),
    "c2_2": ("", "SELECT asset_id::INT AS asset_id, symbol, count(*) AS total_rows, " + ", ".join(f"count(*) - count({v}) AS {c}" for c, v in zip(SHORT, VALUES, strict=True)) + " FROM dm GROUP BY asset_id, symbol HAVING " + " OR ".join(f"count(*) - count({v}) <> {n}" for v, n in zip(VALUES, WANT, strict=True))),
    "c2_3": (
        "o AS (SELECT *, row_number() OVER (PARTITION BY asset_id ORDER BY date) AS n FROM dm)",
        f"SELECT {K}, n AS day_num, " + ", ".join(f"CASE WHEN {v} IS NULL THEN 'NULL' ELSE 'VALUE' END AS {s}_status" for s, v in (("return", "ret"), ("vol7", "vol_7d"), ("vol30", "vol_30d"), ("sma7", "sma_7"), ("sma30", "sma_30"), ("volratio", "vr"))) + " FROM o WHERE " + " OR ".join(off(i) for i in (0, 2, 3, 4, 5, 6)),
    ),
    "c3_1": ("", f"SELECT {K}, ret AS daily_return_pct, CASE WHEN ret <= -100 THEN 'VIOLATION: return <= -100%' ELSE 'VIOLATION: return > +500%' END AS range_check FROM dm WHERE ret <= -100 OR ret > 500"),
    "c3_2": ("", "SELECT d.asset_id::INT AS asset_id, d.symbol, d.date, rng AS daily_range_pct, high, low FROM dm d JOIN dp p ON p.asset_id = d.asset_id AND p.date = d.date WHERE rng < 0"),
    "c3_3": ("", f"SELECT {K}, vol_7d, vol_30d, CASE WHEN vol_7d < 0 THEN 'VIOLATION: vol_7d < 0' ELSE 'VIOLATION: vol_30d < 0' END AS violation_type FROM dm WHERE vol_7d < 0 OR vol_30d < 0"),
    "c3_4": ("", f"SELECT {K}, sma_7, sma_30, CASE WHEN sma_7 <= 0 THEN 'VIOLATION: sma_7 <= 0' ELSE 'VIOLATION: sma_30 <= 0' END AS violation_type FROM dm WHERE sma_7 <= 0 OR sma_30 <= 0"),
    "c3_5": ("", f"SELECT {K}, vr AS volume_ratio_30d FROM dm WHERE vr < 0"),
    "c3_6": ("", f"SELECT symbol, {stats()} FROM dm GROUP BY symbol"),
    "c4_1": ("", f"SELECT asset_id::INT AS asset_id, symbol, {r('stddev_pop(vol_7d)', 6)} AS variability_of_vol_7d, {r('stddev_pop(vol_30d)', 6)} AS variability_of_vol_30d, CASE WHEN stddev_pop(vol_7d) > stddev_pop(vol_30d) THEN 'PASS' ELSE 'FAIL -- vol_7d should be noisier than vol_30d' END AS check_result {BOTH} GROUP BY asset_id, symbol"),
    "c4_2": ("", f"SELECT count(*) AS total_days, count(*) FILTER (WHERE close > sma_7 AND sma_7 > sma_30) AS bullish_aligned_days, {r('count(*) FILTER (WHERE close > sma_7 AND sma_7 > sma_30) / nullif(count(*), 0) * 100', 1)} AS bullish_pct FROM dm d JOIN dp p ON p.asset_id = d.asset_id AND p.date = d.date WHERE d.symbol = 'BTC' AND d.date BETWEEN {day('2024-11-06')} AND {day('2025-09-30')} AND sma_30 IS NOT NULL"),
    "c4_3": ("", f"SELECT symbol, vr AS volume_ratio_30d, CASE WHEN vr > 2 THEN 'PASS -- spike detected' WHEN vr > 1.5 THEN 'MARGINAL -- elevated but < 2x' ELSE 'FAIL -- no spike detected on FTX collapse date' END AS check_result FROM dm WHERE date = {day('2022-11-08')} AND vr IS NOT NULL"),
    "c4_4": ("", f"SELECT symbol, {r('avg(vol_7d)', 4)} AS avg_vol_7d, {r('avg(vol_30d)', 4)} AS avg_vol_30d, {r('avg(vol_7d) / nullif(avg(vol_30d), 0)', 2)} AS ratio_of_means, CASE WHEN avg(vol_7d) / nullif(avg(vol_30d), 0) BETWEEN 0.5 AND 2 THEN 'PASS' ELSE 'FAIL -- means diverge too much' END AS check_result {BOTH} GROUP BY symbol"),
    "c4_5": (
        f"o AS (SELECT asset_id, date, {bound('min', 7)}, {bound('max', 7)}, {bound('min', 30)}, {bound('max', 30)} FROM dp)",
        "SELECT d.asset_id::INT AS asset_id, symbol, d.date, sma_7, min_close_7, max_close_7, sma_30, min_close_30, max_close_30 FROM dm d JOIN o ON o.asset_id = d.asset_id AND o.date = d.date WHERE sma_7 NOT BETWEEN min_close_7 AND max_close_7 OR sma_30 NOT BETWEEN min_close_30 AND max_close_30",
    ),
    "c5_1": ("", "SELECT d.date, ret AS daily_return_pct, close, CASE " + " ".join(f"WHEN d.date = {day(x)} THEN {text(label)}" for x, label in SPOT_DAYS.items()) + f" END AS event_context FROM dm d JOIN dp p ON p.asset_id = d.asset_id AND p.date = d.date WHERE d.symbol = 'BTC' AND d.date IN ({', '.join(map(day, SPOT_DAYS))})"),
    "c5_2": ("", f"SELECT period_label, {r('avg(vol_30d)', 4)} AS avg_vol_30d, {r('min(vol_30d)', 4)} AS min_vol_30d, {r('max(vol_30d)', 4)} AS max_vol_30d FROM (SELECT vol_30d, CASE " + " ".join(f"WHEN date BETWEEN {day(a)} AND {day(b)} THEN {text(n)}" for n, (a, b) in PERIODS.items()) + " END AS period_label FROM dm WHERE symbol = 'BTC' AND vol_30d IS NOT NULL) WHERE period_label IS NOT NULL GROUP BY period_label"),
    "c5_3": ("", f"SELECT symbol, ret AS daily_return_pct, rng AS daily_range_pct, vr AS volume_ratio_30d, CASE WHEN ret < -5 THEN 'PASS -- significant decline' WHEN ret < 0 THEN 'MARGINAL -- small decline' ELSE 'FAIL -- positive return on crash date is suspicious' END AS return_check, CASE WHEN vr > 2 THEN 'PASS -- volume spike' ELSE 'FAIL -- no volume spike' END AS volume_check FROM dm WHERE date = {day('2022-11-08')}"),
    "c5_4": ("", f"SELECT date, rng AS daily_range_pct, ret AS daily_return_pct, vol_7d FROM dm WHERE symbol = 'BTC' AND date BETWEEN {day('2022-11-06')} AND {day('2022-11-14')}"),
    "c5_5": (PREV, "SELECT symbol, date, prev_close, close, ret AS daily_return_pct, 'MISMATCH -- sign does not match price direction' AS sign_check FROM pp WHERE (close > prev_close AND ret <= 0) OR (close < prev_close AND ret >= 0) ORDER BY symbol, date LIMIT 50"),
    "c5_6": (PREV, f"SELECT symbol, date, (close - prev_close) / prev_close * 100 AS expected_return_pct, ret AS daily_return_pct, {r('(close - prev_close) / prev_close * 100 - ret', 6)} AS difference FROM pp WHERE abs((close - prev_close) / prev_close * 100 - ret) > 0.001 ORDER BY abs(difference) DESC, symbol, date LIMIT 20"),
    # metrics
    **{f"m_{n}": ("", f"SELECT asset_id::INT AS asset_id, date, {c}::DOUBLE AS {c} FROM daily_metrics") for n, c in zip(("return", "range", "vol_7d", "vol_30d", "sma_7", "sma_30", "volume_ratio"), NULLS, strict=True)},
    # loaders
    "l_prices": ("", "SELECT asset_id::INT AS asset_id, date, open::DOUBLE AS open, high::DOUBLE AS high, low::DOUBLE AS low, close::DOUBLE AS close, volume_usd::DOUBLE AS volume_usd FROM daily_prices"),
    "l_calendar": ("", "SELECT date_id, year, quarter, month, week, day_of_week, is_weekend FROM date_dim"),
    "l_upsert": ("", "SELECT asset_id::INT AS asset_id, date, (CASE WHEN day(date) = 1 THEN close * 2 ELSE close END)::DOUBLE AS close FROM daily_prices"),
    "l_insert_absent": ("", "SELECT asset_id::INT AS asset_id, date, close::DOUBLE AS close FROM daily_prices UNION ALL SELECT 9, date, close::DOUBLE FROM daily_prices WHERE asset_id = 1"),
    "l_gaps": ("", "SELECT s.asset_id::INT AS asset_id, date_id AS date FROM (SELECT asset_id, min(date) AS a, max(date) AS b FROM daily_prices GROUP BY 1) s JOIN date_dim ON date_id BETWEEN a AND b WHERE NOT EXISTS (FROM daily_prices p WHERE p.asset_id = s.asset_id AND p.date = date_id)"),
    "l_gaps_range": ("", "SELECT s.asset_id::INT AS asset_id, date_id AS date FROM (SELECT asset_id, min(date) AS a, max(date) AS b FROM daily_prices GROUP BY 1) s JOIN date_dim ON date_id BETWEEN a AND b AND date_id BETWEEN DATE '1996-01-01' AND DATE '1999-06-30' WHERE NOT EXISTS (FROM daily_prices p WHERE p.asset_id = s.asset_id AND p.date = date_id)"),
    "l_recompute": ("", "SELECT asset_id::INT AS asset_id, date, " + ", ".join(f"{c}::DOUBLE AS {c}" for c in NULLS) + ", row_number() OVER (ORDER BY asset_id, date) AS metric_id FROM daily_metrics"),
    "l_recompute_tail": ("", "SELECT asset_id::INT AS asset_id, date, " + ", ".join(f"{c}::DOUBLE AS {c}" for c in NULLS) + " FROM daily_metrics"),
    "l_upsert_months": (
        "q AS (SELECT * FROM daily_prices WHERE year(date) = 1995 AND quarter(date) = 1)",
        "SELECT asset_id::INT AS asset_id, date, (CASE WHEN year(date) = 1995 AND quarter(date) = 1 THEN (close * 2)::DECIMAL(20,8) ELSE close END)::DOUBLE AS close FROM daily_prices "
        "UNION ALL SELECT 9, date, close::DOUBLE FROM q WHERE asset_id = 1",
    ),
    "l_refused": (BROKEN, "SELECT violated, count(*) AS n, true AS table_kept FROM (SELECT unnest(violations) AS violated FROM broken) GROUP BY violated"),
    "l_diverted": (
        BROKEN,
        "SELECT row_number() OVER (ORDER BY asset_id, date) AS price_id, asset_id, date, '' AS violations FROM broken WHERE len(violations) = 0 "
        "UNION ALL SELECT NULL, asset_id, date, array_to_string(list_sort(violations), '; ') FROM broken WHERE len(violations) > 0",
    ),
    "l_active": ("", "SELECT asset_id::INT AS asset_id, date, sma_7::DOUBLE AS sma_7 FROM daily_metrics WHERE asset_id % 3 <> 0"),
    "k_enum": ("", "SELECT event_id, event_type FROM events WHERE event_type NOT IN ('view', 'click', 'purchase')"),
    "k_default": ("", "SELECT asset_id::INT AS asset_id, date, (CASE WHEN day(date) > 1 THEN volume_usd ELSE 0 END)::DOUBLE AS volume_usd, true AS created FROM daily_prices"),
    "k_length": ("", "SELECT c_custkey, regexp_replace(c_name, '#0+', '#') AS name FROM customer WHERE length(c_mktsegment) > 9 OR length(regexp_replace(c_name, '#0+', '#')) > 11"),
    "k_numeric": ("", "SELECT asset_id::INT AS asset_id, date, close::DOUBLE AS close FROM daily_prices WHERE round(close, 4) >= 1000"),
    "l_clean": ("", "SELECT l_orderkey, l_linenumber, l_quantity, l_extendedprice, CASE WHEN l_quantity > 40 THEN NULL ELSE l_extendedprice::DECIMAL(20,8)::DOUBLE END AS cleaned FROM lineitem"),
    "l_reject": ("", "SELECT asset_id::INT AS asset_id, date, (close - 1000)::DOUBLE AS close, close > 1000 AS good FROM daily_prices"),
    "l_null_waterfall": ("", "SELECT asset_id::INT AS asset_id, count(*) AS total_rows, " + ", ".join(f"count(*) - count({c}) AS null_{c}" for c in NULLS) + ", CASE WHEN " + " AND ".join(f"count(*) - count({c}) = {n}" for c, n in zip(NULLS, WANT, strict=True)) + " THEN 'PASS' ELSE 'WARN' END AS status FROM daily_metrics GROUP BY asset_id"),
    "l_reload": ("", "SELECT row_number() OVER (ORDER BY c_mktsegment, c_custkey) AS row_id, c_mktsegment, c_custkey FROM customer"),
    "l_upsert_assets": ("", "SELECT c_custkey AS id, c_name AS name, CASE WHEN c_custkey % 3 = 0 THEN lower(c_mktsegment) ELSE c_mktsegment END AS segment FROM customer UNION ALL SELECT (SELECT max(c_custkey) FROM customer) + row_number() OVER (ORDER BY s_name), s_name, 'supply' FROM supplier"),
    # constraints, each on rows that violate it
    "k_unique": ("", "SELECT asset_id::INT AS asset_id, month(date)::INT AS month, count(*) AS n FROM daily_prices GROUP BY 1, 2 HAVING count(*) > 1"),
    "k_not_null": ("", "SELECT asset_id::INT AS asset_id, date FROM daily_metrics WHERE vol_30d IS NULL OR sma_30 IS NULL"),
    "k_foreign_key": ("", "SELECT asset_id::INT AS asset_id, date FROM daily_prices WHERE asset_id > 6"),
    "k_check": ("", "SELECT asset_id::INT AS asset_id, date, vol_30d::DOUBLE AS vol_30d FROM daily_metrics WHERE NOT (vol_30d < 6)"),
}


QUERIES["l_load_report"] = QUERIES["l_null_waterfall"]

#: The tables with the bars of l_recompute_tail: closes doubled on some days, other days gone.
CHANGED = BASE.replace("daily_prices AS (", "old_prices AS (", 1).replace("date_dim AS (", """daily_prices AS (
  SELECT * REPLACE ((CASE WHEN asset_id <= 3 AND date BETWEEN DATE '1996-03-05' AND DATE '1996-03-20' THEN close * 2 ELSE close END)::DECIMAL(20,8) AS close)
  FROM old_prices WHERE NOT (asset_id = 2 AND date BETWEEN DATE '1997-05-02' AND DATE '1997-05-09')),
date_dim AS (""", 1)


def sql(name: str) -> str:
    more, query = QUERIES[name]
    return f"WITH {CHANGED if name == 'l_recompute_tail' else BASE}{', ' + more if more else ''} {query}"
