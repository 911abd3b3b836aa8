"""DuckDB text of the longer rules: indicators, the score, messages and the alert pass."""

from __future__ import annotations

from ..params import Scoring
from . import fixtures as X

P = Scoring()
#: The newest 250 bars of every symbol as a list.
LISTS = "".join(
    f""", {name} AS (SELECT symbol, list(struct_pack(open_time, open, high, low, close, volume) ORDER BY open_time) AS b FROM
  (SELECT * FROM {bars} QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY open_time DESC) <= 250) GROUP BY symbol)"""
    for name, bars in (("l1", "o1h"), ("l4", "o4h"), ("ld", "o1d"))
)


def tier(value: str, tiers, op: str) -> str:
    cases = "".join(f" WHEN {value} {op} {level} THEN {points}" for level, points in reversed(list(zip(*tiers, strict=True))))
    return f"CASE{cases} ELSE 0 END"


def rsi(name: str, source: str) -> str:
    """CTEs that end in ``name`` (symbol, k, n, v): RSI of the list c of every row (symbol, k, c) of ``source``."""
    half = lambda x: (
        f"list_reduce(list_transform(d[15:], lambda x: greatest({x}, 0.0)), lambda a, x: (a * 13 + x) / 14, list_sum(list_transform(d[:14], lambda x: greatest({x}, 0.0))) / 14)"
    )
    return f"""{name}_d AS (SELECT symbol, k, len(c) AS n, list_transform(range(2, len(c) + 1), lambda i: c[i] - c[i - 1]) AS d FROM ({source})),
{name}_g AS (SELECT symbol, k, n, {half('x')} AS g, {half('-x')} AS l FROM {name}_d),
{name} AS (SELECT symbol, k, n, CASE WHEN n < 15 THEN NULL WHEN g = 0 AND l = 0 THEN 50.0 WHEN l = 0 THEN 100.0 WHEN g = 0 THEN 0.0 ELSE 100 - 100 / (1 + g / l) END AS v FROM {name}_g)"""


def ema(c: str, n: int) -> str:
    return f"CASE WHEN len({c}) >= {n} THEN list_reduce({c}[{n + 1}:], lambda a, x: (x - a) * (2.0 / {n + 1}) + a, list_sum({c}[:{n}]) / {n}) END"


def trend(name: str, c: str) -> str:
    return f"""{name} AS (SELECT symbol, CASE WHEN len(c) < 50 THEN 'sideways' WHEN (e20 - e50) / e50 * 100 > 1 THEN 'uptrend' WHEN (e20 - e50) / e50 * 100 < -1 THEN 'downtrend' ELSE 'sideways' END AS v
  FROM (SELECT symbol, {c} AS c, {ema(c, 20)} AS e20, {ema(c, 50)} AS e50 FROM c))"""


#: True range of the bars in the list b.
TRUE_RANGE = """list_transform(range(1, len(b) + 1), lambda i: CASE WHEN i = 1 THEN b[i].high - b[i].low ELSE greatest(b[i].high - b[i].low, abs(b[i].high - b[i - 1].close), abs(b[i].low - b[i - 1].close)) END)"""
ATR = "list_reduce(tr[15:], lambda a, x: (a * 13 + x) / 14, list_sum(tr[:14]) / 14)"

REGIME = (
    LISTS
    + f""", g0 AS (SELECT list_transform(b, lambda x: x.close) AS c, {TRUE_RANGE} AS tr, len(b) AS n FROM ld WHERE symbol = '1-URGENT' AND len(b) >= 50),
g1 AS (SELECT *, {ema('c', 20)} AS ema_short, {ema('c', 50)} AS ema_long, {ATR} AS atr,
  list_transform(range(greatest(14, n - 89), n + 1), lambda j: list_reduce(tr[15:j], lambda a, x: (a * 13 + x) / 14, list_sum(tr[:14]) / 14)) AS w FROM g0),
g2 AS (SELECT *, CASE WHEN len(w) < 2 THEN 50.0 ELSE len(list_filter(w, lambda x: x <= w[len(w)])) * 100.0 / len(w) END AS atr_percentile FROM g1),
regime AS (SELECT CASE WHEN ema_short > ema_long AND atr_percentile <= 70 THEN 'risk_on' WHEN ema_short < ema_long AND atr_percentile > 70 THEN 'risk_off' ELSE 'neutral' END AS label,
  ema_short, ema_long, atr, atr_percentile FROM g2)"""
)

_HORIZONS = ("1h", "24h", "7d", "30d", "180d")


def _drop(reference: str) -> str:
    return f"CASE WHEN {reference} IS NOT NULL THEN CASE WHEN {reference} > 0 THEN greatest(({reference} - price) / {reference} * 100, 0.0) ELSE 0.0 END END"


def _points() -> str:
    return ", ".join(f"{tier(f'(CASE WHEN unit > 0 THEN drop_{h}_pct / unit ELSE drop_{h}_pct END)', P.drops[h], '>=')} AS p_{h}" for h in _HORIZONS)


_BEST = f"greatest({', '.join(f'p_{h}' for h in _HORIZONS)})"

#: CTEs that end in ``scored``: the candidates of all symbols.
SCORED = (
    REGIME
    + f""", c AS (SELECT l1.symbol, l1.b AS b, l1.b[len(l1.b)] AS last, l1.b[len(l1.b) - 1] AS prev, len(l1.b) AS n, l1.b[len(l1.b)].close AS price, list_transform(l1.b, lambda x: x.close) AS c1,
  coalesce(list_transform(l4.b, lambda x: x.close), []) AS c4, coalesce(list_transform(ld.b, lambda x: x.close), []) AS cd, ld.b AS d, {TRUE_RANGE.replace('b[', 'l1.b[').replace('len(b)', 'len(l1.b)')} AS tr
  FROM l1 LEFT JOIN l4 ON l4.symbol = l1.symbol LEFT JOIN ld ON ld.symbol = l1.symbol),
{rsi('r1', 'SELECT symbol, k, c1[:len(c1) - k] AS c FROM c, (SELECT unnest(range(5)) AS k)')},
{rsi('r4', 'SELECT symbol, 0 AS k, c4 AS c FROM c')},
{trend('t4', 'c4')}, {trend('td', 'cd')},
low AS (SELECT symbol, low, min(low) OVER w1 AS a, count(*) OVER w1 AS na, min(low) OVER w2 AS z, count(*) OVER w2 AS nz FROM (SELECT * FROM o1d QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY open_time DESC) <= 90)
  WINDOW w1 AS (PARTITION BY symbol ORDER BY open_time ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING), w2 AS (PARTITION BY symbol ORDER BY open_time ROWS BETWEEN 1 FOLLOWING AND 3 FOLLOWING)),
sup AS (SELECT symbol, max(low) AS s FROM low JOIN c USING (symbol) WHERE na = 3 AND nz = 3 AND low < a AND low < z AND low <= price GROUP BY symbol),
f AS (SELECT c.*, (SELECT v FROM r1 WHERE r1.symbol = c.symbol AND k = 0) AS rsi_1h, (SELECT v FROM r4 WHERE r4.symbol = c.symbol) AS rsi_4h,
  n >= 19 AND coalesce((SELECT bool_or(k = 0 AND v > 30) AND bool_or(k > 0 AND v <= 30) FROM r1 WHERE r1.symbol = c.symbol), false) AS recovery,
  (SELECT v FROM t4 WHERE t4.symbol = c.symbol) AS trend_4h, (SELECT v FROM td WHERE td.symbol = c.symbol) AS trend_1d,
  CASE WHEN n > 20 AND list_sum(list_transform(b[n - 20:n - 1], lambda x: x.volume)) > 0 THEN last.volume / (list_sum(list_transform(b[n - 20:n - 1], lambda x: x.volume)) / 20) END AS rel_volume,
  CASE WHEN n >= 14 THEN {ATR} END AS atr_1h, (SELECT nullif(s, 0) FROM sup WHERE sup.symbol = c.symbol) AS support,
  CASE WHEN abs(last.close - last.open) > 0 AND last.high > last.low AND least(last.open, last.close) - last.low >= 2 * abs(last.close - last.open)
      AND last.high - greatest(last.open, last.close) <= 0.25 * (last.high - last.low) THEN 'hammer'
    WHEN prev.close < prev.open AND last.close > last.open AND last.open <= prev.close AND last.close >= prev.open THEN 'bullish_engulfing'
    WHEN last.high > last.low AND abs(last.close - last.open) / (last.high - last.low) <= 0.10 THEN 'doji' END AS pattern,
  n > 10 AND last.close > list_max(list_transform(b[n - 10:n - 1], lambda x: x.high)) AS reclaim,
  list_max(list_transform(d[greatest(len(d) - 29, 1):], lambda x: x.high)) AS high_30d, list_max(list_transform(d[greatest(len(d) - 179, 1):], lambda x: x.high)) AS high_180d,
  CASE WHEN n >= 25 THEN c1[n - 24] END AS c_24h, CASE WHEN len(cd) >= 8 THEN cd[len(cd) - 7] END AS c_7d, CASE WHEN len(cd) >= 31 THEN cd[len(cd) - 30] END AS c_30d, CASE WHEN len(cd) >= 181 THEN cd[len(cd) - 180] END AS c_180d FROM c),
g AS (SELECT *, {_drop('last.open')} AS drop_1h_pct, {', '.join(f"{_drop(f'c_{h}')} AS drop_{h}_pct" for h in _HORIZONS[1:])}, {_drop('high_30d')} AS d30, {_drop('high_180d')} AS d180,
  (price - support) / support * 100 AS dist, CASE WHEN atr_1h > 0 AND price > 0 THEN atr_1h / price * 100 END AS unit FROM f),
h AS (SELECT *, {_points()} FROM g),
i AS (SELECT *, CASE WHEN {_BEST} > 0 THEN CASE {_BEST} {' '.join(f"WHEN p_{h} THEN '{h}'" for h in _HORIZONS)} END END AS horizon, least({_BEST}, {P.weights.drop}) AS p_drop,
  least({tier('rsi_1h', P.rsi_1h, '<=')} + {tier('rsi_4h', P.rsi_4h, '<=')}, {P.weights.rsi}) AS p_rsi, least({tier('rel_volume', P.rel_volume, '>=')}, {P.weights.volume}) AS p_volume,
  CASE WHEN dist IS NULL OR dist < 0 THEN 0 {' '.join(f'WHEN dist <= {a} THEN {b}' for a, b in zip(*P.support, strict=True))} ELSE 0 END AS p_support,
  least({tier('d30', P.discount_30d, '>=')} + {tier('d180', P.discount_180d, '>=')}, {P.weights.discount}) AS p_discount,
  least(CASE WHEN pattern IS NOT NULL THEN 5 ELSE 0 END + CASE WHEN recovery THEN 3 ELSE 0 END + CASE WHEN reclaim THEN 2 ELSE 0 END, {P.weights.reversal}) AS p_reversal,
  CASE trend_1d WHEN 'uptrend' THEN 5 WHEN 'sideways' THEN 3 ELSE 0 END AS p_trend FROM h),
j AS (SELECT *, p_drop + p_rsi + p_volume + p_support + p_discount + p_reversal + p_trend AS score, CASE horizon {' '.join(f"WHEN '{h}' THEN drop_{h}_pct" for h in _HORIZONS)} END AS drop_trigger_pct, (SELECT label FROM regime) AS regime_at_signal FROM i),
k AS (SELECT *, concat_ws(' | ', CASE WHEN drop_trigger_pct > 0 THEN 'drop_' || horizon || '=-' || printf('%.1f', drop_trigger_pct) || '%' END, CASE WHEN rsi_1h <= 30 THEN 'rsi_1h=' || printf('%.0f', rsi_1h) END,
  CASE WHEN rel_volume >= 1.5 THEN 'rel_vol=' || printf('%.1f', rel_volume) || 'x' END, 'pattern=' || pattern) AS reason FROM j),
scored AS (SELECT symbol, last.open_time AS candle_hour, TIMESTAMP '2024-03-01' AS detected_at, price AS price_at_signal, score,
  CASE WHEN score >= 50 + CASE regime_at_signal WHEN 'risk_on' THEN -5 WHEN 'risk_off' THEN 5 ELSE 0 END THEN CASE WHEN score >= 80 THEN 'very_strong' WHEN score >= 65 THEN 'strong' WHEN score >= 50 THEN 'normal' END END AS severity,
  CASE WHEN reason = '' THEN 'low-score evaluation' ELSE reason END AS trigger_reason, horizon AS dominant_trigger_timeframe, {', '.join(f'drop_{h}_pct' for h in _HORIZONS)}, drop_trigger_pct,
  high_30d AS recent_30d_high, high_180d AS recent_180d_high, d30 AS distance_from_30d_high_pct, d180 AS distance_from_180d_high_pct, rsi_1h, rsi_4h, rel_volume, atr_1h, dist AS dist_support_pct, support AS support_level_price,
  pattern IS NOT NULL AS reversal_signal, pattern AS reversal_pattern, trend_4h AS trend_context_4h, trend_1d AS trend_context_1d, regime_at_signal,
  p_drop, p_rsi, p_volume, p_support, p_discount, p_reversal, p_trend, coalesce(unit > 0, false) AS atr_normalized, unit AS atr_pct FROM k)"""
)
SCORED_DOUBLES = (
    [f"drop_{h}_pct" for h in _HORIZONS]
    + "price_at_signal drop_trigger_pct recent_30d_high recent_180d_high distance_from_30d_high_pct distance_from_180d_high_pct rsi_1h rsi_4h rel_volume atr_1h dist_support_pct support_level_price atr_pct".split()
)

# --- messages ----------------------------------------------------------------

NAME = "CASE WHEN ends_with(symbol, 'USDT') AND length(symbol) > 4 THEN left(symbol, length(symbol) - 4) ELSE symbol END"
_FRAME = "CASE nullif(dominant_trigger_timeframe, '') WHEN '1h' THEN '1 hora' WHEN '24h' THEN '24 horas' WHEN '7d' THEN '7 dias' WHEN '30d' THEN '30 dias' WHEN '180d' THEN '6 meses' ELSE nullif(dominant_trigger_timeframe, '') END"
_PATTERN = (
    "CASE nullif(reversal_pattern, '') WHEN 'hammer' THEN 'martelo' WHEN 'bullish_engulfing' THEN 'engolfo de alta' WHEN 'piercing_line' THEN 'linha de perfuração' "
    "WHEN 'morning_star' THEN 'estrela da manhã' WHEN 'dragonfly_doji' THEN 'doji libélula' ELSE nullif(reversal_pattern, '') END"
)
REASONS = f"""list_filter([
  CASE WHEN drop_trigger_pct > 0 THEN 'Queda de ' || printf('%.1f', drop_trigger_pct) || '% em ' || {_FRAME} END,
  CASE WHEN rsi_1h <= 30 THEN CASE WHEN rsi_1h <= 20 THEN 'RSI em sobrevenda extrema (' ELSE 'RSI em sobrevenda (' END || printf('%.0f', rsi_1h) || ')' END,
  CASE WHEN rel_volume >= 1.5 THEN 'Volume ' || printf('%.1f', rel_volume) || 'x acima do normal' END,
  'Padrão de reversão: ' || {_PATTERN},
  CASE WHEN dist_support_pct < 5 THEN 'Próximo do suporte em $' || format('{{:g}}', support_level_price) END,
  CASE WHEN distance_from_180d_high_pct > 20 THEN printf('%.0f', distance_from_180d_high_pct) || '% abaixo da máxima de 6 meses'
    WHEN distance_from_30d_high_pct > 20 THEN printf('%.0f', distance_from_30d_high_pct) || '% abaixo da máxima de 30 dias' END], lambda x: x IS NOT NULL)[:3]"""
REGIME_LINE = "CASE regime_at_signal WHEN 'risk_on' THEN 'Mercado favorável (risk-on)' WHEN 'risk_off' THEN 'Mercado adverso (risk-off)' END"
TITLE = f"""CASE severity WHEN 'very_strong' THEN '🟢 Bom momento de compra' WHEN 'strong' THEN '🟡 Vale observar' WHEN 'normal' THEN '🟠 Melhor esperar' ELSE '🔴 Evitar entrada agora' END || ' — ' || {NAME}"""


def lines(*parts: str) -> str:
    """The parts that are not null, a line each."""
    return f"array_to_string(list_filter([{', '.join(parts)}], lambda x: x IS NOT NULL), chr(10))"


BODY = lines(
    f"{NAME} || ' @ $' || format('{{:g}}', price_at_signal)",
    "CASE WHEN drop_24h_pct > 0 THEN 'Variação 24h: -' || printf('%.1f', drop_24h_pct) || '%' WHEN drop_24h_pct IS NOT NULL THEN 'Variação 24h: estável' END",
    f"nullif(array_to_string(list_transform({REASONS}, lambda x: '• ' || x), chr(10)), '')",
    REGIME_LINE,
    "''",
    "CASE severity WHEN 'very_strong' THEN 'Vários indicadores apontam oportunidade clara.' WHEN 'strong' THEN 'Sinais moderados — acompanhe antes de agir.' WHEN 'normal' THEN 'Sinal fraco — observe com cautela.' ELSE 'Condições desfavoráveis.' END",
)
SELL_TITLE = f"""CASE rule_triggered WHEN 'stop_loss' THEN '🔴 Stop-loss acionado' WHEN 'trailing_stop' THEN '🟠 Trailing stop acionado' WHEN 'take_profit' THEN '🟢 Take-profit atingido'
  WHEN 'context_deterioration' THEN '🟡 Contexto deteriorando' ELSE '⚠️ Sinal de venda' END || ' — ' || {NAME}"""
SELL_BODY = lines(
    f"{NAME} || ' @ $' || format('{{:g}}', price_at_signal)",
    "'Resultado: ' || CASE WHEN pnl_pct >= 0 THEN '+' ELSE '' END || printf('%.2f', pnl_pct) || '%'",
    "'• ' || nullif(reason, '')",
    REGIME_LINE,
    "''",
    "CASE rule_triggered WHEN 'stop_loss' THEN 'Decisão sugerida: proteger capital — considere sair.' WHEN 'trailing_stop' THEN 'Decisão sugerida: travar lucro após recuo do topo.' WHEN 'take_profit' "
    "THEN 'Decisão sugerida: realizar lucro parcial ou total.' WHEN 'context_deterioration' THEN 'Decisão sugerida: reavaliar — contexto adverso.' ELSE 'Decisão sugerida: reavaliar a posição.' END",
)

# --- the alert pass ----------------------------------------------------------

_HOUR = "hour(detected_at - INTERVAL 3 HOUR)"
#: CTEs that end in ``passed``: all signals in order, each with the last send before it; a send fails where id % 7 = 0.
PASSED = (
    X.with_sql("signals").replace("WITH ", "WITH RECURSIVE ", 1)
    + f""", q AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY detected_at, id) AS n, {_HOUR} >= 22 OR {_HOUR} < 8 AS quiet, severity = 'very_strong' AS loud, id % 7 <> 0 AS ok FROM signals WHERE severity IS NOT NULL),
walk AS (
  SELECT DISTINCT symbol, 0::BIGINT AS n, 0::BIGINT AS id, NULL::TIMESTAMP AS prior_at, NULL::INTEGER AS prior_score, NULL::TIMESTAMP AS last_at, NULL::INTEGER AS last_score FROM q
  UNION ALL
  SELECT q.symbol, q.n, q.id, w.last_at, w.last_score,
    CASE WHEN {{sent}} THEN q.detected_at ELSE w.last_at END, CASE WHEN {{sent}} THEN q.score ELSE w.last_score END
  FROM walk w JOIN q ON q.symbol = w.symbol AND q.n = w.n + 1
),
e AS (SELECT q.*, abs(epoch(q.detected_at) - epoch(w.prior_at)) / 60 AS el, q.score - w.prior_score AS up FROM q JOIN walk w ON w.symbol = q.symbol AND w.n = q.n),
u AS (SELECT *, coalesce(el < 120, false) AS cooling, coalesce(up >= 10, false) AS jump FROM e),
passed AS (SELECT symbol, id, detected_at AS now, CASE WHEN cooling AND NOT jump THEN 'skip_cooldown' WHEN quiet AND NOT loud THEN 'queue' ELSE 'send_now' END AS action,
  CASE WHEN cooling AND NOT jump THEN 'cooldown:' || CAST(floor(el) AS BIGINT) || 'm<120m' WHEN quiet AND loud THEN 'very_strong_bypass_quiet' WHEN quiet THEN 'quiet_hours' WHEN cooling THEN 'escalation_override' ELSE 'fresh' END AS reason,
  cooling AND jump AS override_cooldown, quiet AND loud AND NOT (cooling AND NOT jump) AS bypass_quiet, ok FROM u)"""
).replace(
    "{sent}",
    "q.ok AND NOT (q.quiet AND NOT q.loud) AND (coalesce(q.score - w.last_score >= 10, false) OR NOT coalesce(abs(epoch(q.detected_at) - epoch(w.last_at)) / 60 < 120, false))",
)
