"""Staging, intermediate and mart models as functions from DataFrames to DataFrames.

Windows share their partitioning (symbol, source), so returns, volatility and the
daily mart run on one exchange. Nothing reads the clock: where a model needs the
present it takes ``as_of``.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import arg_max_nn, frequency_name, lower_key, md5_key, minutes_between, safe_ratio, trim_key, upper_key
from ..operators.asof import asof_join
from ..operators.latest import keep_latest

SURPRISE_EPSILON = 1e-9


def series():
    """The one window specification of returns, volatility and volume, so that they share an exchange and a sort."""
    return Window.partitionBy("symbol", "source").orderBy("trade_date")


def trailing_20():
    return series().rowsBetween(-19, 0)


def _ts(name: str):
    return F.col(name).cast("timestamp").alias(name)


def stg_prices(raw: DataFrame) -> DataFrame:
    rows = raw.select(
        upper_key("symbol").alias("symbol"), F.col("date").cast("date").alias("trade_date"), *[F.col(c).cast("double").alias(c) for c in ("open", "high", "low", "close")],
        F.col("volume").cast("bigint").alias("volume"), lower_key("source").alias("source"), trim_key("source_record_id").alias("source_record_id"), _ts("ingested_at"),
    ).where("symbol is not null and trade_date is not null and open > 0 and high > 0 and low > 0 and close > 0 and volume >= 0 and high >= greatest(low, open, close) and low <= least(open, close)")
    best = keep_latest(rows, ["symbol", "trade_date", "source"], ["ingested_at", "source_record_id"])
    return best.select(md5_key("source", "symbol", "trade_date").alias("price_bar_key"), "symbol", "trade_date", "open", "high", "low", "close", "volume", "source", "source_record_id", "ingested_at")


def stg_fundamentals(raw: DataFrame) -> DataFrame:
    rows = raw.select(
        upper_key("symbol").alias("symbol"), lower_key("metric_name").alias("metric_name"), F.col("period_start").cast("date").alias("period_start"), F.col("period_end").cast("date").alias("period_end"),
        upper_key("period_type").alias("period_type"), _ts("filed_at"), F.col("value").cast("double").alias("value"), upper_key("unit").alias("unit"), upper_key("currency").alias("currency"),
        lower_key("source").alias("source"), trim_key("source_record_id").alias("source_record_id"), _ts("ingested_at"),
    ).where("symbol is not null and metric_name is not null and period_end is not null and (period_start is null or period_end >= period_start) and (filed_at is null or filed_at <= ingested_at)")
    best = keep_latest(rows, ["source", "source_record_id"], ["ingested_at"])
    return best.select(md5_key("source", "source_record_id").alias("fundamental_observation_key"), *[c for c in rows.columns])


def stg_earnings(raw: DataFrame) -> DataFrame:
    status = upper_key("event_status")
    rows = raw.select(
        upper_key("symbol").alias("symbol"), _ts("event_timestamp"), F.col("fiscal_period_end").cast("date").alias("fiscal_period_end"),
        F.when(status == "ESTIMATE", "SCHEDULED").otherwise(status).alias("event_status"), F.col("eps_estimate").cast("double").alias("eps_estimate"), F.col("eps_actual").cast("double").alias("eps_actual"),
        lower_key("source").alias("source"), trim_key("source_record_id").alias("source_record_id"), _ts("ingested_at"),
    ).where("symbol is not null and event_timestamp is not null and event_status is not null")
    best = keep_latest(rows, ["source", "source_record_id"], ["ingested_at"])
    return best.select(md5_key("source", "source_record_id").alias("earnings_event_key"), *rows.columns)


def stg_macro(raw: DataFrame) -> DataFrame:
    rows = raw.select(
        upper_key("series_id").alias("series_id"), F.col("observation_date").cast("date").alias("observation_date"), _ts("released_at"), F.col("value").cast("double").alias("value"),
        upper_key("unit").alias("unit"), frequency_name("frequency").alias("frequency"), lower_key("source").alias("source"), trim_key("source_record_id").alias("source_record_id"), _ts("ingested_at"),
    ).where("series_id is not null and observation_date is not null and (released_at is null or released_at <= ingested_at)")
    best = keep_latest(rows, ["source", "source_record_id"], ["ingested_at"])
    return best.select(md5_key("source", "source_record_id").alias("macro_observation_key"), *rows.columns)


def stg_news(raw: DataFrame) -> DataFrame:
    rows = raw.select(
        _ts("event_timestamp"), trim_key("headline").alias("headline"), trim_key("url").alias("url"), trim_key("publisher").alias("publisher"),
        lower_key("source").alias("source"), trim_key("source_record_id").alias("source_record_id"), _ts("ingested_at"),
    ).where("event_timestamp is not null and length(headline) > 0 and (url is null or startswith(url, 'http://') or startswith(url, 'https://'))")
    best = keep_latest(rows, ["source", "source_record_id"], ["ingested_at"])
    return best.select(md5_key("source", "source_record_id").alias("news_event_key"), *rows.columns)


def int_daily_returns(stg: DataFrame) -> DataFrame:
    prior = F.col("previous_close")
    return stg.select("price_bar_key", "symbol", "trade_date", "close", "volume", "source", F.lag("close").over(series()).alias("previous_close")).withColumn("daily_return", F.when(prior > 0, F.col("close") / prior - 1.0))


def int_rolling_volatility(returns: DataFrame) -> DataFrame:
    spread = F.stddev_samp("daily_return").over(trailing_20())
    return returns.select(
        "price_bar_key", "symbol", "trade_date", "close", "volume", "source", "daily_return",
        F.count("daily_return").over(trailing_20()).alias("return_observations_20d"), spread.alias("rolling_20d_volatility"), (spread * math.sqrt(252.0)).alias("annualized_20d_volatility"),
        (safe_ratio("close", F.lag("close", 20).over(series())) - 1.0).alias("rolling_20d_return"),
    )


def int_security_fundamentals(stg: DataFrame) -> DataFrame:
    w = Window.partitionBy("symbol", "metric_name", "period_end", "source").orderBy("effective_from", F.col("ingested_at").asc_nulls_last(), F.col("source_record_id").asc_nulls_last())
    return stg.withColumn("effective_from", F.coalesce("filed_at", F.col("period_end").cast("timestamp"))).withColumn("effective_to", F.lead("effective_from").over(w))


def int_earnings_surprises(stg: DataFrame) -> DataFrame:
    gap = F.col("eps_actual") - F.col("eps_estimate")
    return stg.select(
        "earnings_event_key", "symbol", "event_timestamp", "fiscal_period_end", "event_status", "eps_estimate", "eps_actual", gap.alias("eps_surprise"),
        F.when(F.abs("eps_estimate") > SURPRISE_EPSILON, gap / F.abs("eps_estimate")).alias("eps_surprise_percent"), "source", "source_record_id", "ingested_at",
    )


def int_macro_aligned(stg: DataFrame, dates: DataFrame) -> DataFrame:
    """One row per trade_date of ``dates`` and series; the last reading available by that day.

    Several readings of one available_date: the latest observation, then the last
    ingested, then the key. The product of calendar and series is the model's result,
    with the calendar (small by its type) as the broadcast side.
    """
    each = stg.select("series_id", "source").distinct()
    grid = each.crossJoin(F.broadcast(dates.select("trade_date").distinct()))
    available = stg.select(
        "series_id", "source", "macro_observation_key", "observation_date", "released_at", F.greatest("observation_date", F.to_date(F.coalesce("released_at", F.col("observation_date").cast("timestamp")))).alias("available_date"), "value", "unit", "frequency", "ingested_at",
    )
    out = asof_join(grid, available, ["series_id", "source"], "trade_date", "available_date", tie_break=["observation_date", "ingested_at", "macro_observation_key"], distinct=True)
    return out.select("trade_date", "series_id", "source", "macro_observation_key", "observation_date", "released_at", "available_date", "value", "unit", "frequency")


def mart_security_daily(volatility: DataFrame) -> DataFrame:
    mean = F.avg("volume").over(trailing_20())
    return volatility.select(
        "price_bar_key", md5_key("source", "symbol").alias("source_security_key"), "trade_date", "symbol", "source", "close", "daily_return", "rolling_20d_return", "rolling_20d_volatility", "annualized_20d_volatility", "volume",
        mean.alias("average_volume_20d"), safe_ratio("volume", mean).alias("relative_volume"), "return_observations_20d",
    )


def mart_market_daily(returns: DataFrame) -> DataFrame:
    r = F.col("daily_return")
    up, down = F.count_if(r > 0), F.count_if(r < 0)
    return returns.groupBy("trade_date").agg(
        F.avg(r).alias("mean_return"), F.median(r).alias("median_return"), F.stddev_samp(r).alias("cross_sectional_volatility"), up.alias("advancers"), down.alias("decliners"), F.count_if(r == 0).alias("unchanged"),
        ((up - down).cast("double") / F.nullif(F.count(r), F.lit(0))).alias("market_breadth"), F.count(r).alias("securities_with_returns"),
    )


def mart_sector_daily(returns: DataFrame, sectors: DataFrame) -> DataFrame:
    """Unmapped symbols are dropped. The sector dimension joins by size: AQE broadcasts it while it is small."""
    return returns.join(sectors.select("symbol", "sector"), "symbol").groupBy("trade_date", "sector").agg(F.avg("daily_return").alias("sector_average_return"), F.count("daily_return").alias("securities_with_returns"))


def mart_company_snapshot(prices: DataFrame, fundamentals: DataFrame, surprises: DataFrame, as_of) -> DataFrame:
    keys = ["symbol", "source"]
    price = keep_latest(prices, keys, ["trade_date"], [*keys, "trade_date", "close"])
    summary = fundamentals.groupBy(*keys).agg(F.max("period_end").alias("latest_fundamental_period_end"), F.max("filed_at").alias("latest_fundamental_filed_at"), F.count_distinct("metric_name").alias("available_fundamental_metrics"))
    earnings = keep_latest(surprises, keys, ["event_timestamp", "source_record_id"], [*keys, "event_timestamp", "eps_actual", "eps_surprise"])
    return price.join(summary, keys, "left").join(earnings, keys, "left").select(
        md5_key("source", "symbol").alias("source_security_key"), *keys, F.col("trade_date").alias("latest_price_date"), F.col("close").alias("latest_price"),
        "latest_fundamental_period_end", "latest_fundamental_filed_at", "available_fundamental_metrics", F.col("event_timestamp").alias("latest_earnings_timestamp"), F.col("eps_actual").alias("latest_eps_actual"),
        F.col("eps_surprise").alias("latest_eps_surprise"), minutes_between("trade_date", as_of).alias("price_freshness_minutes"),
    )


# Per dataset the event-time column, the key and the columns whose nulls count.
HEALTH = {
    "prices": ("trade_date", "price_bar_key", ("symbol", "close")),
    "fundamentals": ("period_end", "fundamental_observation_key", ("symbol", "metric_name", "value")),
    "earnings": ("event_timestamp", "earnings_event_key", ("symbol", "event_timestamp")),
    "macro": ("observation_date", "macro_observation_key", ("series_id", "value")),
    "news": ("event_timestamp", "news_event_key", ("headline", "event_timestamp")),
}


def mart_pipeline_dataset_health(staged: dict[str, DataFrame], runs: DataFrame, as_of) -> DataFrame:
    metrics = None
    for name, (time, key, needed) in HEALTH.items():
        missing = F.lit(False)
        for c in needed:
            missing = missing | F.col(c).isNull()
        one = staged[name].agg(
            F.lit(name).alias("dataset"), F.max(time).cast("timestamp").alias("latest_event_time"), F.count("*").alias("row_count"),
            F.avg(F.when(missing, 1.0).otherwise(0.0)).alias("null_rate"), (F.count("*") - F.count_distinct(key)).alias("duplicate_count"),
        )
        metrics = one if metrics is None else metrics.unionByName(one)
    held = runs.select("dataset", "run_id", "status", "quarantined_rows", F.col("completed_at").cast("timestamp").alias("completed_at"))
    latest = keep_latest(held, ["dataset"], ["completed_at", "run_id"], ["dataset", "quarantined_rows"])
    good = keep_latest(held.where("status = 'success'"), ["dataset"], ["completed_at", "run_id"], ["dataset", "run_id", "completed_at"])
    bad = F.coalesce("quarantined_rows", F.lit(0))
    return metrics.join(latest, "dataset", "left").join(good, "dataset", "left").select(
        "dataset", F.col("run_id").alias("last_successful_run"), F.col("completed_at").alias("last_successful_run_at"), "latest_event_time", minutes_between("latest_event_time", as_of).alias("freshness_minutes"),
        "row_count", "null_rate", "duplicate_count", bad.alias("quarantine_count"),
        F.when(F.col("row_count") == 0, "empty").when((F.col("duplicate_count") > 0) | (F.col("null_rate") > 0) | (bad > 0), "degraded").when(F.col("run_id").isNull(), "unknown").otherwise("healthy").alias("status"),
    )


def trailing_context(daily: DataFrame) -> DataFrame:
    """Per symbol and bar the context an event on a later day sees: the last five bars of the symbol, all sources."""
    w = Window.partitionBy("symbol").orderBy("trade_date", "source")
    five = w.rowsBetween(-4, 0)
    def kept(c: str):
        return F.last(c, ignorenulls=True).over(five)

    return daily.select(
        "symbol", "trade_date", "source", kept("close").alias("prior_daily_close"), kept("daily_return").alias("prior_daily_return"), kept("rolling_20d_volatility").alias("prior_20d_volatility"), kept("relative_volume").alias("prior_relative_volume"),
        (safe_ratio(kept("close"), F.first("close", ignorenulls=True).over(five)) - 1.0).alias("recent_5d_return"),
    )


def market_context(market: DataFrame) -> DataFrame:
    """trade_date, recent_5d_market_return: the compounded mean return of the last five market days (one row per day)."""
    w = Window.orderBy("trade_date").rowsBetween(-4, 0)
    return market.select("trade_date", (F.product(1.0 + F.col("mean_return")).over(w) - 1.0).alias("recent_5d_market_return"))


def mart_stream_anomalies(events: DataFrame, daily: DataFrame, market: DataFrame, surprises: DataFrame) -> DataFrame:
    """Events with the context known before them: bars of earlier days, market days before, earlier earnings."""
    e = events.select(
        "event_id", F.upper("symbol").alias("symbol"), _ts("event_timestamp"), "event_type", F.col("price").cast("double").alias("event_price"), F.col("anomaly_score").cast("double").alias("anomaly_score"), "details_json", _ts("detected_at"),
        "source_topic", "kafka_partition", "kafka_offset", _ts("ingested_at"),
    ).withColumn("_day", F.to_date("event_timestamp"))
    context = trailing_context(daily).withColumnRenamed("trade_date", "context_trade_date").withColumnRenamed("source", "_context_source")
    with_bars = asof_join(e, context, ["symbol"], "_day", "context_trade_date", strict=True, tie_break=["_context_source"])
    # market days are few (a calendar): the as-of is one small join by the event's day
    days = asof_join(with_bars.select("_day").distinct().withColumn("_k", F.lit(1)), market_context(market).withColumn("_k", F.lit(1)), ["_k"], "_day", "trade_date", strict=True, distinct=True).select("_day", "recent_5d_market_return")
    with_market = with_bars.join(days, "_day", "left")
    known = surprises.select("symbol", F.col("event_timestamp").alias("latest_earnings_timestamp"), F.col("event_status").alias("latest_earnings_status"), F.col("eps_surprise").alias("latest_eps_surprise"), F.col("eps_surprise_percent").alias("latest_eps_surprise_percent"), F.col("source_record_id").alias("_record"))
    out = asof_join(with_market, known, ["symbol"], "event_timestamp", "latest_earnings_timestamp", strict=True, tie_break=["_record"])
    return out.withColumn("recent_factor_excess_return", F.col("recent_5d_return") - F.col("recent_5d_market_return")).drop("_day", "_context_source", "_record")


def sector_latest(sector_daily: DataFrame) -> DataFrame:
    return sector_daily.groupBy("sector").agg(F.max("trade_date").alias("latest_date"), arg_max_nn("sector_average_return", "trade_date").alias("latest_return"), arg_max_nn("securities_with_returns", "trade_date").alias("latest_securities"))
