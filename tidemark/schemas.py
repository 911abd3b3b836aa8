"""Schemas of the domain tables, as DDL; times are NTZ in UTC, prices doubles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES: dict[str, str] = {
    "symbols": "symbol string, base string, quote string, active boolean, added_at timestamp_ntz",
    "candles": "symbol string, interval string, open_time timestamp_ntz, open double, high double, low double, close double, volume double, close_time timestamp_ntz",
    "signals": "id bigint, symbol string, detected_at timestamp_ntz, candle_hour timestamp_ntz, price_at_signal double, score int, severity string, trigger_reason string, "
    "dominant_trigger_timeframe string, drop_1h_pct double, drop_24h_pct double, drop_7d_pct double, drop_30d_pct double, drop_180d_pct double, "
    "distance_from_30d_high_pct double, distance_from_180d_high_pct double, recent_30d_high double, recent_180d_high double, drop_trigger_pct double, "
    "rsi_1h double, rsi_4h double, rel_volume double, dist_support_pct double, support_level_price double, reversal_signal boolean, trend_context_4h string, "
    "trend_context_1d string, score_breakdown string, alerted boolean, alert_skipped_reason string, regime_at_signal string, watchlist_id bigint",
    "notifications": "id bigint, created_at timestamp_ntz, sent_at timestamp_ntz, symbol string, signal_id bigint, title string, body string, priority string, tags string, "
    "queued boolean, bypass_quiet boolean, delivered boolean, delivery_attempts int, last_error string",
    "buys": "id bigint, symbol string, bought_at timestamp_ntz, price double, amount_invested double, quote_currency string, quantity double, signal_id bigint, note string, "
    "created_at timestamp_ntz, sold_at timestamp_ntz, sold_price double, sold_note string",
    "buy_evaluations": "buy_id bigint, evaluated_at timestamp_ntz, day_open double, day_low_hourly double, day_low_hourly_time timestamp_ntz, "
    "pct_from_day_open_to_low_hourly double, pct_from_buy_to_low_hourly double, buy_vs_day_low_hourly_pct double, price_7d_later double, return_7d_pct double, "
    "price_30d_later double, return_30d_pct double, verdict string, resolution_note string, max_gain_pct double, max_loss_pct double, "
    "time_to_mfe_hours double, time_to_mae_hours double",
    "signal_evaluations": "signal_id bigint, evaluated_at timestamp_ntz, price_at_signal double, price_24h_later double, price_7d_later double, price_30d_later double, "
    "return_24h_pct double, return_7d_pct double, return_30d_pct double, max_gain_7d_pct double, max_loss_7d_pct double, verdict string, "
    "time_to_mfe_hours double, time_to_mae_hours double",
    "weekly_summaries": "id bigint, week_start timestamp_ntz, week_end timestamp_ntz, generated_at timestamp_ntz, body string, signal_count bigint, buy_count bigint, "
    "top_drop_symbol string, top_drop_pct double, sent boolean",
    "regime_snapshots": "id bigint, label string, btc_ema_short double, btc_ema_long double, btc_atr_14d double, atr_percentile double, determined_at timestamp_ntz",
    "sell_tracking": "symbol string, buy_id bigint, high_watermark double, updated_at timestamp_ntz",
    "sell_signals": "id bigint, symbol string, buy_id bigint, detected_at timestamp_ntz, price_at_signal double, rule_triggered string, severity string, reason string, "
    "pnl_pct double, regime_at_signal string, alerted boolean",
    "watchlist": "id bigint, symbol string, status string, first_seen_at timestamp_ntz, last_seen_at timestamp_ntz, last_score int, expires_at timestamp_ntz, "
    "promoted_signal_id bigint, resolved_at timestamp_ntz, resolution_reason string",
    "processing_state": "symbol string, interval string, last_open_time timestamp_ntz",
}


def empty(spark: SparkSession, name: str) -> DataFrame:
    return spark.createDataFrame([], TABLES[name])
