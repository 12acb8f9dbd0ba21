"""DuckDB SQL with the rows of the market queries, written apart from the DataFrame code to check it."""

from __future__ import annotations

from candela.sources.market import ASSETS, EVENTS, LEVELS, SHIFT_DAYS, shifted


def r(x: str, n: int) -> str:
    return f"round(({x})::DOUBLE + sign(({x})::DOUBLE) * {1e-11 if n > 6 else 1e-9}, {n}) + 0.0::DOUBLE"


def text(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def day(reference: str) -> str:
    return f"DATE '{shifted(reference)}'"


_assets = ", ".join(f"({i}, '{s}', '{n}', '{c}', true)" for i, s, n, c in ASSETS)
_events = ", ".join(f"({i}, {day(d)}, '{k}', {text(t)}, '{a}')" for i, (d, k, t, a) in enumerate(EVENTS, 1))
_levels = ", ".join(map(str, LEVELS))
_key = "(l_orderkey, l_linenumber, l_suppkey, l_partkey, l_extendedprice, l_quantity)"


def full(x: str, agg: str, lo: int, hi: int, n: int) -> str:
    end = "CURRENT ROW" if hi == 0 else f"{-hi} PRECEDING"
    w = f"OVER (PARTITION BY asset_id ORDER BY date ROWS BETWEEN {-lo} PRECEDING AND {end})"
    return f"CASE WHEN count({x}) {w} = {n} THEN {agg}({x}) {w} END"


BASE = f"""
assets(asset_id, symbol, name, category, is_active) AS (VALUES {_assets}),
market_events(event_id, event_date, event_type, title, affected_assets) AS (VALUES {_events}),
px AS (
  SELECT l_suppkey % 8 + 1 AS asset_id, l_shipdate::DATE AS date, {_key.replace('(', 'row(', 1)} AS k, (l_quantity * l_extendedprice)::DECIMAL(30,2) AS v,
    (([{_levels}])[(l_suppkey % 8 + 1)::INT]::DOUBLE * (1000 + abs((date_diff('day', DATE '1995-01-01', l_shipdate::DATE) + 97 * (l_suppkey % 8 + 1)) % 800 - 400)) / 1000.0::DOUBLE + l_extendedprice / 1000.0::DOUBLE)::DECIMAL(20,8) AS p
  FROM lineitem),
daily_prices AS (
  SELECT asset_id, date, arg_min(p, k) AS open, max(p) AS high, min(p) AS low, arg_max(p, k) AS close, arg_max(v, k) AS volume_usd FROM px GROUP BY ALL),
date_dim AS (
  SELECT d::DATE AS date_id, year(d) AS year, quarter(d) AS quarter, month(d) AS month, weekofyear(d) AS week, isodow(d) - 1 AS day_of_week, isodow(d) >= 6 AS is_weekend
  FROM (SELECT unnest(generate_series((SELECT min(date) FROM daily_prices), (SELECT max(date) FROM daily_prices), INTERVAL 1 DAY)) AS d)),
ret AS (
  SELECT asset_id, date, high::DOUBLE AS h, low::DOUBLE AS l, close::DOUBLE AS close, volume_usd::DOUBLE AS volume,
    (close::DOUBLE - lag(close::DOUBLE) OVER (PARTITION BY asset_id ORDER BY date)) / lag(close::DOUBLE) OVER (PARTITION BY asset_id ORDER BY date) * 100 AS ret
  FROM daily_prices),
daily_metrics AS (
  SELECT asset_id, date, {r('ret', 6)}::DECIMAL(10,6) AS daily_return_pct, {r('(h - l) / nullif(l, 0) * 100', 6)}::DECIMAL(10,6) AS daily_range_pct,
    {r(full('ret', 'stddev_pop', -6, 0, 7), 6)}::DECIMAL(10,6) AS vol_7d, {r(full('ret', 'stddev_pop', -29, 0, 30), 6)}::DECIMAL(10,6) AS vol_30d,
    {r(full('close', 'avg', -6, 0, 7), 8)}::DECIMAL(20,8) AS sma_7, {r(full('close', 'avg', -29, 0, 30), 8)}::DECIMAL(20,8) AS sma_30,
    {r('volume / nullif(' + full('volume', 'avg', -30, -1, 30) + ', 0)', 4)}::DECIMAL(10,4) AS volume_ratio_30d
  FROM ret),
dm AS (
  SELECT m.asset_id, symbol, date, daily_return_pct::DOUBLE AS ret, daily_range_pct::DOUBLE AS rng, vol_7d::DOUBLE AS vol_7d, vol_30d::DOUBLE AS vol_30d,
    sma_7::DOUBLE AS sma_7, sma_30::DOUBLE AS sma_30, volume_ratio_30d::DOUBLE AS vr
  FROM daily_metrics m JOIN assets USING (asset_id)),
dp AS (SELECT p.asset_id, symbol, date, open::DOUBLE AS open, high::DOUBLE AS high, low::DOUBLE AS low, close::DOUBLE AS close, volume_usd::DOUBLE AS volume_usd FROM daily_prices p JOIN assets USING (asset_id))
"""

REGIME = "CASE WHEN vol_30d < 2 THEN 'LOW' WHEN vol_30d < 4 THEN 'MEDIUM' WHEN vol_30d < 6 THEN 'HIGH' ELSE 'EXTREME' END"
MATCH = "(e.affected_assets LIKE '%ALL%' OR e.affected_assets LIKE '%' || d.symbol || '%')"


def corr(x: str, y: str) -> str:
    return f"(covar_pop({x}, {y}) / CASE WHEN stddev_pop(CASE WHEN {y} IS NOT NULL THEN {x} END) * stddev_pop(CASE WHEN {x} IS NOT NULL THEN {y} END) > 1e-12 THEN stddev_pop(CASE WHEN {y} IS NOT NULL THEN {x} END) * stddev_pop(CASE WHEN {x} IS NOT NULL THEN {y} END) END)"


STREAKS = f"""
days AS (SELECT d.* FROM dm d JOIN daily_prices p ON p.asset_id = d.asset_id AND p.date = d.date WHERE ret IS NOT NULL),
runs AS (SELECT *, sum(CASE WHEN ret > 0 THEN 0 ELSE 1 END) OVER (PARTITION BY asset_id ORDER BY date ROWS UNBOUNDED PRECEDING) AS g FROM days),
streaks AS (
  SELECT symbol, count(*) AS streak_length, min(date) AS streak_start, max(date) AS streak_end, {r('sum(ret)', 2)} AS cumulative_return_pct, {r('min(ret)', 2)} AS min_daily_return, {r('max(ret)', 2)} AS max_daily_return
  FROM runs WHERE ret > 0 GROUP BY asset_id, symbol, g)"""
DRAWDOWN = "dd AS (SELECT *, max(close) OVER w AS peak, (close - max(close) OVER w) / max(close) OVER w * 100 AS down FROM dp WINDOW w AS (PARTITION BY asset_id ORDER BY date ROWS UNBOUNDED PRECEDING))"


def weekly(by: str = "") -> str:
    return f"""wk AS (
  SELECT asset_id, symbol, year, week AS iso_week{', ' + by if by else ''}, min(date) AS week_start, max(date) AS week_end, {r('sum(ret)', 6)} AS wr
  FROM dm JOIN date_dim ON date_id = date WHERE ret IS NOT NULL GROUP BY asset_id, symbol, year, week{', ' + by if by else ''} HAVING count(*) >= 3)"""


def rolled(n: int) -> str:
    w = f"OVER (PARTITION BY asset_id ORDER BY date ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
    return f"(close - max(close) {w}) / max(close) {w} * 100"


def span(lo: int, hi: int) -> str:
    return f"d.date BETWEEN e.event_date + {lo} AND e.event_date + {hi}"


def mean(x: str, p: str, n: int) -> str:
    return r(f"avg(d.{x}) FILTER (WHERE {p})", n)


def ahead(k: int) -> str:
    return f"sum(ret) OVER (PARTITION BY asset_id ORDER BY date ROWS BETWEEN 1 FOLLOWING AND {k} FOLLOWING)"


def btc(alone: bool) -> str:
    source = "(SELECT * FROM wk WHERE symbol = 'BTC')" if alone else "wk"
    return f"""{weekly('month')},
k AS (SELECT *, rank() OVER (PARTITION BY year, iso_week{'' if alone else ', month'} ORDER BY wr DESC) AS k FROM {source})
SELECT year, month, count(*) AS total_weeks, count(*) FILTER (WHERE k = 1) AS btc_rank_1_weeks, count(*) FILTER (WHERE k <= 3) AS btc_top_3_weeks, count(*) FILTER (WHERE k >= 5) AS btc_bottom_half_weeks,
  CASE WHEN count(*) FILTER (WHERE k <= 2) / count(*) > 0.5 THEN 'BTC_DOMINANCE' WHEN count(*) FILTER (WHERE k >= 5) / count(*) > 0.5 THEN 'ALT_SEASON' ELSE 'MIXED' END AS regime
FROM k WHERE symbol = 'BTC' GROUP BY year, month"""


#: name -> (common table expressions or nothing, the query)
QUERIES: dict[str, tuple[str, str]] = {
    "q1a": (STREAKS, "SELECT rank() OVER (ORDER BY streak_length DESC, cumulative_return_pct DESC) AS rank, * FROM streaks ORDER BY streak_length DESC, cumulative_return_pct DESC, symbol, streak_start LIMIT 20"),
    "q1b": (STREAKS, "SELECT symbol, asset_rank, streak_length, streak_start, streak_end, cumulative_return_pct FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY streak_length DESC, cumulative_return_pct DESC, streak_start) AS asset_rank FROM streaks) WHERE asset_rank <= 5"),
    "q1c": (STREAKS, f"SELECT month, count(*) AS streak_count, {r('avg(streak_length)', 1)} AS avg_streak_length, max(streak_length) AS max_streak_length FROM streaks JOIN date_dim ON date_id = streak_start WHERE streak_length >= 3 GROUP BY month"),
    "q2a": ("", f"SELECT asset_id::INT AS asset_id, symbol, date, {r('vol_30d', 4)} AS vol_30d, {r('vol_30d * sqrt(365)', 2)} AS vol_30d_annualized, {REGIME} AS vol_regime FROM dm WHERE vol_30d IS NOT NULL"),
    "q2b": (
        f"""g AS (SELECT *, {REGIME} AS vol_regime FROM dm WHERE vol_30d IS NOT NULL),
b AS (SELECT *, CASE WHEN vol_regime = lag(vol_regime) OVER (PARTITION BY asset_id ORDER BY date) THEN 0 ELSE 1 END AS b FROM g),
i AS (SELECT *, sum(b) OVER (PARTITION BY asset_id ORDER BY date ROWS UNBOUNDED PRECEDING) AS i FROM b)""",
        f"SELECT symbol, vol_regime, min(date) AS regime_start, max(date) AS regime_end, max(date) - min(date) + 1 AS duration_days, {r('avg(vol_30d)', 4)} AS avg_vol_30d, {r('avg(vol_30d) * sqrt(365)', 2)} AS avg_vol_annualized, {r('min(vol_30d)', 4)} AS min_vol_30d, {r('max(vol_30d)', 4)} AS max_vol_30d FROM i GROUP BY symbol, vol_regime, i",
    ),
    "q2c": ("", f"SELECT symbol, vol_regime, count(*) AS days_in_regime, {r('count(*) / sum(count(*)) OVER (PARTITION BY symbol) * 100', 1)} AS pct_of_total FROM (SELECT symbol, {REGIME} AS vol_regime FROM dm WHERE vol_30d IS NOT NULL) GROUP BY symbol, vol_regime"),
    "q2d": ("", f"SELECT event_date, title, event_type, date AS observation_date, date - event_date AS days_from_event, {r('vol_30d', 4)} AS vol_30d, {REGIME} AS vol_regime FROM market_events e JOIN dm d ON {span(-7, 7)} WHERE symbol = 'BTC' AND vol_30d IS NOT NULL"),
    "q3a": ("", f"SELECT a.symbol AS asset_1, b.symbol AS asset_2, count(*) AS overlapping_days, {r(corr('a.ret', 'b.ret'), 4)} AS correlation FROM dm a JOIN dm b ON a.date = b.date AND a.asset_id < b.asset_id WHERE a.ret IS NOT NULL AND b.ret IS NOT NULL GROUP BY ALL"),
    "q3b": ("", f"SELECT x.date, {r(corr('y.ret', 'z.ret'), 8)} AS rolling_corr_30d FROM dm x JOIN dm y ON y.symbol = 'BTC' AND y.date BETWEEN x.date - 29 AND x.date AND y.ret IS NOT NULL JOIN dm z ON z.symbol = 'ETH' AND z.date = y.date AND z.ret IS NOT NULL WHERE x.symbol = 'BTC' AND x.ret IS NOT NULL GROUP BY x.date HAVING count(*) >= 20"),
    "q3c": ("", f"SELECT year, quarter, b.symbol AS asset, count(*) AS days, {r(corr('a.ret', 'b.ret'), 4)} AS corr_with_btc FROM dm a JOIN dm b ON a.date = b.date AND b.symbol <> 'BTC' JOIN date_dim ON date_id = a.date WHERE a.symbol = 'BTC' AND a.ret IS NOT NULL AND b.ret IS NOT NULL GROUP BY year, quarter, b.symbol HAVING count(*) >= 30"),
    "q3d": ("", f"SELECT CASE WHEN a.vol_30d >= 4.0 THEN 'STRESS' ELSE 'CALM' END AS market_regime, b.symbol AS asset, count(*) AS days, {r(corr('a.ret', 'b.ret'), 4)} AS corr_with_btc FROM dm a JOIN dm b ON a.date = b.date AND b.symbol <> 'BTC' WHERE a.symbol = 'BTC' AND a.vol_30d IS NOT NULL AND a.ret IS NOT NULL AND b.ret IS NOT NULL GROUP BY 1, 2 HAVING count(*) >= 20"),
    "q4a": (DRAWDOWN, f"SELECT symbol, date, close, peak AS peak_close, {r('down', 2)} AS drawdown_pct FROM dd"),
    "q4b": (DRAWDOWN, f"SELECT symbol, x AS max_drawdown_pct, peak AS peak_price, close AS trough_price, date AS trough_date FROM (SELECT *, {r('down', 2)} AS x FROM dd) QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY x, date) = 1"),
    "q4c": (f"o AS (SELECT symbol, {rolled(30)} AS a, {rolled(90)} AS b, {rolled(365)} AS c FROM dp)", f"SELECT symbol, {r('min(a)', 2)} AS max_dd_30d, {r('min(b)', 2)} AS max_dd_90d, {r('min(c)', 2)} AS max_dd_1y FROM o GROUP BY symbol"),
    "q4d": (
        DRAWDOWN + ", u AS (SELECT *, sum(CASE WHEN close >= peak THEN 1 ELSE 0 END) OVER (PARTITION BY asset_id ORDER BY date ROWS UNBOUNDED PRECEDING) AS g FROM dd)",
        f"SELECT symbol, g::BIGINT AS ath_group, min(date) AS period_start, max(date) AS period_end, max(date) - min(date) AS days_underwater, {r('min(down)', 2)} AS max_dd_in_period FROM u WHERE close < peak GROUP BY symbol, g HAVING max(date) - min(date) >= 7",
    ),
    "q5a": ("", f"SELECT d.symbol, d.date, {r('vr', 2)} AS vol_ratio, p.volume_usd, {r('ret', 2)} AS return_pct, {r('rng', 2)} AS range_pct, e.title AS nearby_event, e.event_type, d.date - e.event_date AS days_from_event FROM dm d JOIN dp p ON p.asset_id = d.asset_id AND p.date = d.date LEFT JOIN market_events e ON {span(-2, 2)} AND {MATCH} WHERE vr > 2"),
    "q5b": ("", f"SELECT symbol, count(*) FILTER (WHERE vr > 3) AS extreme_spikes_3x, count(*) FILTER (WHERE vr > 2) AS strong_spikes_2x, count(*) FILTER (WHERE vr > 1.5) AS moderate_spikes_1_5x, count(vr) AS total_days, {r('count(*) FILTER (WHERE vr > 2) / count(vr) * 100', 1)} AS pct_days_above_2x FROM dm GROUP BY symbol"),
    "q5c": ("", f"SELECT symbol, CASE WHEN ret > 2 THEN 'STRONG_BREAKOUT' WHEN ret > 0 THEN 'MILD_BREAKOUT' WHEN ret < -2 THEN 'STRONG_BREAKDOWN' WHEN ret < 0 THEN 'MILD_BREAKDOWN' ELSE 'NEUTRAL' END AS spike_type, count(*) AS occurrences, {r('avg(vr)', 2)} AS avg_vol_ratio, {r('avg(ret)', 2)} AS avg_return_pct FROM dm WHERE vr > 2 AND ret IS NOT NULL GROUP BY 1, 2"),
    "q5d": ("", f"SELECT year, month, count(*) FILTER (WHERE vr > 2) AS spikes_2x, count(*) FILTER (WHERE vr > 3) AS spikes_3x, {r('avg(vr) FILTER (WHERE vr > 2)', 2)} AS avg_spike_ratio FROM dm JOIN date_dim ON date_id = date GROUP BY year, month HAVING count(*) FILTER (WHERE vr > 2) > 0"),
    "q5e": (f"f AS (SELECT ret, vr, {ahead(1)} AS f1, {ahead(3)} AS f3, {ahead(5)} AS f5 FROM dm WHERE ret IS NOT NULL)", f"SELECT CASE WHEN ret > 0 THEN 'UP_SPIKE' ELSE 'DOWN_SPIKE' END AS spike_direction, count(*) AS events, {r('avg(f1)', 2)} AS avg_1d_fwd, {r('avg(f3)', 2)} AS avg_3d_fwd, {r('avg(f5)', 2)} AS avg_5d_fwd FROM f WHERE vr > 2 GROUP BY 1"),
    "q6a": (
        weekly() + f", w2 AS (SELECT *, {r('wr', 2)} AS weekly_return_pct FROM wk)",
        "SELECT year, iso_week, week_start, week_end, symbol, weekly_return_pct, rank() OVER w AS rank_by_return, dense_rank() OVER w AS dense_rank_by_return, ntile(4) OVER t AS performance_quartile, row_number() OVER t AS row_num FROM w2 WINDOW w AS (PARTITION BY year, iso_week ORDER BY weekly_return_pct DESC), t AS (PARTITION BY year, iso_week ORDER BY weekly_return_pct DESC, symbol)",
    ),
    "q6b": (
        weekly() + ", q AS (SELECT *, ntile(4) OVER (PARTITION BY year, iso_week ORDER BY wr DESC, symbol) AS q FROM wk)",
        f"SELECT symbol, count(*) FILTER (WHERE q = 1) AS weeks_in_q1, count(*) FILTER (WHERE q = 2) AS weeks_in_q2, count(*) FILTER (WHERE q = 3) AS weeks_in_q3, count(*) FILTER (WHERE q = 4) AS weeks_in_q4, count(*) AS total_weeks, {r('count(*) FILTER (WHERE q = 1) / count(*) * 100', 1)} AS pct_top_quartile, {r('count(*) FILTER (WHERE q = 4) / count(*) * 100', 1)} AS pct_bottom_quartile FROM q GROUP BY symbol",
    ),
    "q6c": (
        weekly() + ", k AS (SELECT *, rank() OVER (PARTITION BY year, iso_week ORDER BY wr DESC) AS k FROM wk)",
        f"SELECT coalesce(symbol, 'ALL ASSETS') AS symbol, coalesce(year::VARCHAR, 'ALL YEARS') AS year, count(*) AS weeks, {r('avg(k)', 2)} AS avg_rank, {r('avg(wr)', 2)} AS avg_weekly_return, min(k) AS best_rank, max(k) AS worst_rank FROM k GROUP BY ROLLUP (symbol, year)",
    ),
    "q6d_btc_regime": ("", btc(True)),
    "q6d_btc_regime_ranked": ("", btc(False)),
    "q7a": (
        "",
        f"SELECT e.event_id::INT AS event_id, e.event_date, e.event_type, e.title, d.symbol, {mean('ret', span(-30, -1), 4)} AS avg_return_pre_30d, {mean('vol_30d', span(-30, -1), 4)} AS avg_vol_pre_30d, {mean('vr', span(-30, -1), 4)} AS avg_volratio_pre_30d, "
        f"{r('x.ret', 2)} AS event_day_return, {r('x.vol_30d', 4)} AS event_day_vol, {r('x.vr', 2)} AS event_day_volratio, {mean('ret', span(1, 30), 4)} AS avg_return_post_30d, {mean('vol_30d', span(1, 30), 4)} AS avg_vol_post_30d, {mean('vr', span(1, 30), 4)} AS avg_volratio_post_30d "
        f"FROM market_events e JOIN dm d ON {span(-30, 30)} LEFT JOIN dm x ON x.asset_id = d.asset_id AND x.date = e.event_date WHERE {MATCH} GROUP BY e.event_id, e.event_date, e.event_type, e.title, d.symbol, x.ret, x.vol_30d, x.vr",
    ),
    "q7b": ("", "SELECT event_date, e.title AS event_title, d.symbol, " + ", ".join(f"{r(f'sum(d.ret) FILTER (WHERE {span(0, n)})', 2)} AS cum_return_{n}d" for n in (7, 14, 30)) + f", {r(f'min(d.ret) FILTER (WHERE {span(0, 7)})', 2)} AS worst_day_7d, {r(f'max(d.vr) FILTER (WHERE {span(0, 2)})', 2)} AS peak_vol_ratio_3d FROM market_events e JOIN dm d ON {span(0, 30)} WHERE event_type = 'crash' GROUP BY event_id, event_date, e.title, d.symbol"),
    "q7c": (
        "h AS (SELECT * FROM market_events WHERE event_type = 'halving' ORDER BY event_date, event_id LIMIT 1), periods(period, lo, hi) AS (VALUES ('90d_before', -90, -1), ('90d_after', 1, 90), ('180d_after', 91, 180))",
        f"SELECT period, count(*) AS trading_days, {r('sum(ret)', 2)} AS cum_return, {r('avg(ret)', 4)} AS avg_daily_return, {r('avg(vol_30d)', 4)} AS avg_vol_30d, {r('avg(vr)', 2)} AS avg_vol_ratio FROM h JOIN periods ON true JOIN dm d ON d.date BETWEEN h.event_date + lo AND h.event_date + hi WHERE d.symbol = 'BTC' GROUP BY period",
    ),
    "q7d": ("", "SELECT e.title AS upgrade, event_date, " + ", ".join(f"{mean(c, f'd.date {op} e.event_date', n)} AS avg_{k}_{side}" for side, op in (("before", "<"), ("after", ">")) for k, c, n in (("return", "ret", 4), ("vol", "vol_30d", 4), ("volratio", "vr", 2))) + f", {r('max(d.ret) FILTER (WHERE d.date = e.event_date)', 2)} AS event_day_return FROM market_events e JOIN dm d ON {span(-30, 30)} WHERE event_type = 'protocol_upgrade' AND d.symbol = 'ETH' GROUP BY event_id, e.title, event_date"),
    "q7e": ("", f"SELECT event_type, count(DISTINCT event_id) AS num_events, {r('avg(d.ret)', 2)} AS avg_event_day_return, {mean('vr', span(0, 2), 2)} AS avg_vol_ratio_3d, {r(f'avg(d.vol_30d) FILTER (WHERE {span(1, 14)}) - avg(d.vol_30d) FILTER (WHERE {span(-14, -1)})', 4)} AS vol_change_post_minus_pre FROM market_events e JOIN dm d ON {span(-14, 14)} WHERE {MATCH} GROUP BY event_type"),
    "q7f": (
        f"""c AS (SELECT event_id, event_date, e.title, o.symbol AS alt_symbol, CASE WHEN d.date < e.event_date THEN d.ret END AS x1, CASE WHEN d.date < e.event_date THEN o.ret END AS y1, CASE WHEN d.date >= e.event_date THEN d.ret END AS x2, CASE WHEN d.date >= e.event_date THEN o.ret END AS y2
  FROM market_events e JOIN dm d ON {span(-30, 30)} JOIN dm o ON o.date = d.date AND o.symbol <> 'BTC' WHERE event_type = 'crash' AND d.symbol = 'BTC')""",
        f"SELECT event_date, title, alt_symbol, {r(corr('x1', 'y1'), 3)} AS corr_before_crash, {r(corr('x2', 'y2'), 3)} AS corr_during_crash, {r(corr('x2', 'y2') + ' - ' + corr('x1', 'y1'), 3)} AS corr_change FROM c GROUP BY event_id, event_date, title, alt_symbol",
    ),
}


def sql(name: str, queries: dict[str, tuple[str, str]] = QUERIES) -> str:
    more, query = queries[name]
    more = f", {more}" if more else ""
    # a query that starts with its own expressions goes on with the list of them
    joint = ", " if query.lstrip().startswith("wk AS") else " "
    return f"WITH {BASE}{more}{joint}{query}"


assert SHIFT_DAYS % 7 == 0
