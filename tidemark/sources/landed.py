"""Readers for landed provider responses: newline-delimited JSON, one response per line.

Schemas are declared, so files are read once and in parallel; unreadable rows are dropped
or nulled exactly where the rule of each reader says so.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.calendar import exchange_date
from tidemark.functions.text import cashtags
from tidemark.operators.quality import normalize_symbol

# Fixed values ------------------------------------------------------------------------
QUOTE_SCHEMA = """
  received_at timestamp, date_header string, rate_limit_remaining int, rate_limit_reset int,
  quotes array<struct<symbol:string, symbolId:bigint, bidPrice:double, bidSize:bigint,
    askPrice:double, askSize:bigint, lastTradePrice:double, volume:bigint, openPrice:double,
    highPrice:double, lowPrice:double, delay:int, isHalted:boolean, lastTradeTime:timestamp>>
"""
DETAIL_SCHEMA = """
  symbols array<struct<symbol:string, symbolId:bigint, prevDayClosePrice:double,
    averageVol20Days:double, listingExchange:string, currency:string, securityType:string,
    isTradable:boolean, isQuotable:boolean, industrySector:string>>
"""
SEARCH_SCHEMA = """
  prefix string, symbols array<struct<symbol:string, symbolId:bigint, isTradable:boolean,
    isQuotable:boolean>>
"""
MARKET_SCHEMA = """
  markets array<struct<name:string, currency:string, extendedStartTime:timestamp,
    startTime:timestamp, endTime:timestamp, extendedEndTime:timestamp>>
"""
CANDLE_SCHEMA = """
  symbol string, bars array<struct<t:timestamp, o:double, h:double, l:double, c:double, v:bigint>>
"""
TRADE_SCHEMA = """
  symbol string, trades array<struct<t:timestamp, c:array<string>, z:string, s:double, p:double>>
"""
ASSET_SCHEMA = """
  id string, symbol string, name string, exchange string, status string, tradable boolean,
  attributes array<string>
"""
DAILY_SCHEMA = """
  bars map<string, array<struct<t:string, h:string, l:string, c:string, v:string>>>
"""
ARTICLE_SCHEMA = """
  received_at timestamp, symbols array<string>,
  articles array<struct<title:string, url:string, seendate:string, domain:string, language:string>>
"""
MACRO_SCHEMA = """
  received_at timestamp, series_id string,
  observations array<struct<date:string, value:string, realtime_start:string, realtime_end:string>>
"""
FILING_SCHEMA = """
  received_at timestamp, cik bigint, tickers array<string>,
  filings struct<recent:struct<accessionNumber:array<string>, form:array<string>,
    filingDate:array<string>, reportDate:array<string>, acceptanceDateTime:array<string>,
    primaryDocument:array<string>>>
"""
SOCIAL_SCHEMA = """
  received_at timestamp, subreddit string,
  data struct<children:array<struct<data:struct<id:string, title:string, permalink:string,
    removed_by_category:string, created_utc:double, score:bigint, num_comments:bigint,
    upvote_ratio:double>>>>
"""
CATALOG_SCHEMA = """
  symbol string, security_id string, exchange string, asset_type string, sector string,
  price double, median_dollar_volume double, spread_pct double, volatility double,
  coverage_ratio double, provider_resolvable boolean, active boolean,
  corporate_action_ok boolean, is_ipo boolean, listing_sessions int
"""
EARNINGS_FORMS = ("10-Q", "10-K")
SEEN_FORMATS = ("yyyyMMdd'T'HHmmss'Z'", "yyyyMMddHHmmss")
ENGAGEMENT_CAP = 10_000
FILING_URL = "https://www.sec.gov/Archives/edgar/data/"
POST_URL = "https://www.reddit.com"
SECOND_MICROS = 1_000_000
# -------------------------------------------------------------------------------------


def _json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def _http_date(text: Column) -> Column:
    """`Mon, 24 Aug 2026 13:30:00 GMT` as an instant; null when unreadable."""
    clock = F.regexp_extract(text, r"(\d{1,2} \w{3} \d{4} \d{2}:\d{2}:\d{2})", 1)
    return F.try_to_timestamp(clock, F.lit("d MMM yyyy HH:mm:ss"))


def quotes(spark: SparkSession, path: str, provider: str = "live") -> DataFrame:
    """Level-1 quotes with response meta: source time, its origin, latency."""
    response = _json(spark, path, QUOTE_SCHEMA).withColumn("__date", _http_date(F.col("date_header")))
    source = F.coalesce("__date", "received_at")
    lag = (F.unix_micros("received_at") - F.unix_micros(source)) / F.lit(1000)
    q = "q."
    return response.select(
        "received_at",
        source.alias("source_at"),
        F.when(F.col("__date").isNotNull(), "http_date")
        .otherwise("received_proxy")
        .alias("source_time_origin"),
        F.greatest(F.lit(0), F.floor(lag)).cast("long").alias("latency_ms"),
        "rate_limit_remaining",
        "rate_limit_reset",
        F.explode("quotes").alias("q"),
    ).select(
        F.upper(q + "symbol").alias("symbol"),
        F.col(q + "symbolId").alias("symbol_id"),
        *[
            F.col(q + old).alias(new)
            for old, new in (
                ("bidPrice", "bid_price"), ("bidSize", "bid_size"), ("askPrice", "ask_price"),
                ("askSize", "ask_size"), ("lastTradePrice", "last_trade_price"),
                ("volume", "volume"), ("openPrice", "open_price"), ("highPrice", "high_price"),
                ("lowPrice", "low_price"), ("delay", "delay_seconds"), ("isHalted", "is_halted"),
                ("lastTradeTime", "last_trade_time"),
            )
        ],
        "source_at", "received_at", "source_time_origin", "latency_ms", "rate_limit_remaining",
        "rate_limit_reset", F.lit(provider).alias("provider"),
    )


def symbol_details(spark: SparkSession, path: str) -> DataFrame:
    rows = _json(spark, path, DETAIL_SCHEMA).select(F.inline("symbols"))
    return rows.select(
        F.upper("symbol").alias("symbol"),
        F.col("symbolId").alias("symbol_id"),
        F.col("prevDayClosePrice").alias("previous_close"),
        F.col("averageVol20Days").alias("average_daily_volume"),
        F.col("listingExchange").alias("listing_exchange"),
        "currency",
        F.col("securityType").alias("security_type"),
        F.col("isTradable").alias("is_tradable"),
        F.col("isQuotable").alias("is_quotable"),
        F.col("industrySector").alias("industry_sector"),
    )


def search_hits(spark: SparkSession, path: str) -> DataFrame:
    """Symbol search hits with their position, for `quality.resolve_symbols`."""
    rows = _json(spark, path, SEARCH_SCHEMA).select(F.posexplode("symbols").alias("position", "hit"))
    return rows.select(
        "position",
        "hit.symbol",
        F.col("hit.symbolId").alias("symbol_id"),
        F.col("hit.isTradable").alias("is_tradable"),
        F.col("hit.isQuotable").alias("is_quotable"),
    )


def market_schedules(spark: SparkSession, path: str) -> DataFrame:
    """Session bounds per exchange date from USD markets.

    All four bounds must exist and share one exchange date. `agreed` is false when markets
    give different bounds for a date; such a date has no usable schedule.
    """
    rows = _json(spark, path, MARKET_SCHEMA).select(F.inline("markets"))
    names = ("extendedStartTime", "startTime", "endTime", "extendedEndTime")
    complete = F.lit(True)
    for name in names:
        complete = complete & F.col(name).isNotNull() & (
            exchange_date(F.col(name)) == exchange_date(F.col("startTime"))
        )
    bounds = F.struct(
        *[
            F.col(old).alias(new)
            for old, new in zip(
                names, ("extended_open", "regular_open", "regular_close", "extended_close")
            )
        ]
    )
    return (
        rows.filter((F.upper("currency") == "USD") & complete)
        .groupBy(exchange_date(F.col("startTime")).alias("session"))
        .agg(F.min(bounds).alias("a"), F.max(bounds).alias("b"))
        .select("session", "a.*", (F.col("a") == F.col("b")).alias("agreed"))
    )


def candles(
    spark: SparkSession, path: str, *, minutes: int = 1, provider: str = "history", feed: str = "sip"
) -> DataFrame:
    """Bars [start, start + minutes)."""
    rows = _json(spark, path, CANDLE_SCHEMA).select("symbol", F.inline("bars"))
    return rows.select(
        F.upper("symbol").alias("symbol"),
        F.col("t").alias("start"),
        (F.col("t") + F.expr(f"INTERVAL {int(minutes)} MINUTES")).alias("end"),
        F.col("o").alias("open"),
        F.col("h").alias("high"),
        F.col("l").alias("low"),
        F.col("c").alias("close"),
        F.col("v").alias("volume"),
        exchange_date(F.col("t")).alias("session_date"),
        F.lit(provider).alias("provider"),
        F.lit(feed).alias("feed"),
    )


def trades(spark: SparkSession, path: str) -> DataFrame:
    rows = _json(spark, path, TRADE_SCHEMA).select("symbol", F.inline("trades"))
    return rows.select(
        F.upper("symbol").alias("symbol"),
        F.col("t").alias("traded_at"),
        F.col("c").alias("conditions"),
        F.col("z").alias("tape"),
        F.col("s").alias("size"),
        F.col("p").alias("price"),
    )


def assets(spark: SparkSession, path: str) -> DataFrame:
    """Asset catalog; rows without id or symbol are skipped."""
    text = lambda name: F.trim(F.coalesce(F.col(name), F.lit("")))
    return (
        _json(spark, path, ASSET_SCHEMA)
        .filter(F.col("id").isNotNull() & F.col("symbol").isNotNull())
        .select(
            F.col("id").alias("asset_id"),
            normalize_symbol(F.col("symbol")).alias("symbol"),
            text("name").alias("name"),
            F.upper(text("exchange")).alias("exchange"),
            F.lower(text("status")).alias("status"),
            F.coalesce("tradable", F.lit(False)).alias("tradable"),
            F.coalesce("attributes", F.array().cast("array<string>")).alias("attributes"),
        )
    )


def daily_bars(spark: SparkSession, path: str, symbols: DataFrame | None = None) -> DataFrame:
    """Daily bars from symbol-keyed pages; malformed rows are dropped."""
    rows = (
        _json(spark, path, DAILY_SCHEMA)
        .select(F.explode("bars").alias("symbol", "rows"))
        .select(F.upper("symbol").alias("symbol"), F.inline("rows"))
    )
    typed = rows.select(
        "symbol",
        F.to_date(F.col("t").try_cast("timestamp")).alias("session_date"),
        F.col("h").try_cast("double").alias("high"),
        F.col("l").try_cast("double").alias("low"),
        F.col("c").try_cast("double").alias("close"),
        F.col("v").try_cast("double").alias("volume"),
    ).dropna()
    return typed if symbols is None else typed.join(symbols.select("symbol"), "symbol", "left_semi")


_RECORD = [
    "kind", "provider", "external_id", "title", "source_at", "received_at", "symbols", "url",
    "payload",
]


def news(spark: SparkSession, path: str, provider: str = "gdelt") -> DataFrame:
    """Articles as context records; blank titles dropped, id is the url or the title's hash."""
    rows = _json(spark, path, ARTICLE_SCHEMA).select(
        "received_at", "symbols", F.explode("articles").alias("a")
    )
    title = F.trim("a.title")
    url = F.nullif(F.trim("a.url"), F.lit(""))
    seen = F.coalesce(
        *[F.try_to_timestamp("a.seendate", F.lit(pattern)) for pattern in SEEN_FORMATS],
        F.col("received_at"),
    )
    return rows.filter(F.coalesce(title, F.lit("")) != "").select(
        F.lit("news").alias("kind"),
        F.lit(provider).alias("provider"),
        F.coalesce(url, F.sha2(title, 256)).alias("external_id"),
        title.alias("title"),
        seen.alias("source_at"),
        "received_at",
        "symbols",
        url.alias("url"),
        F.to_json("a").alias("payload"),
    )


def macro(spark: SparkSession, path: str, provider: str = "fred") -> DataFrame:
    """Observations as context records; the vintage start is the publication time."""
    rows = _json(spark, path, MACRO_SCHEMA).select(
        "received_at", "series_id", F.explode("observations").alias("o")
    )
    start = F.coalesce("o.realtime_start", F.lit(""))
    return rows.select(
        F.lit("macro").alias("kind"),
        F.lit(provider).alias("provider"),
        F.concat_ws(":", "series_id", F.coalesce("o.date", F.lit("")), start).alias("external_id"),
        F.col("series_id").alias("title"),
        F.coalesce(F.try_to_timestamp(start, F.lit("yyyy-MM-dd")), F.col("received_at")).alias(
            "source_at"
        ),
        "received_at",
        F.array().cast("array<string>").alias("symbols"),
        F.lit(None).cast("string").alias("url"),
        F.to_json(
            F.struct(
                F.col("o.date").alias("observation_date"),
                F.col("o.realtime_end").alias("realtime_end"),
                F.col("o.realtime_start").alias("realtime_start"),
                "series_id",
                F.col("o.value").alias("value"),
            )
        ).alias("payload"),
    )


def filings(
    spark: SparkSession, path: str, forms: Sequence[str] = (), provider: str = "sec"
) -> DataFrame:
    """Filings from parallel arrays; a short array reads as the empty string."""
    recent = "filings.recent."
    names = ("form", "filingDate", "reportDate", "acceptanceDateTime", "primaryDocument")

    def at(name: str) -> Column:
        return F.coalesce(F.get(F.col(recent + name), F.col("i")), F.lit("")).alias(name)

    rows = (
        _json(spark, path, FILING_SCHEMA)
        .select("*", F.posexplode(recent + "accessionNumber").alias("i", "__accession"))
        .select(
            "received_at", "cik", "tickers", F.trim("__accession").alias("accession"),
            *[at(name) for name in names],
        )
        .filter(F.coalesce("accession", F.lit("")) != "")
    )
    if forms:
        rows = rows.filter(F.col("form").isin(*forms))
    earnings = F.col("form").isin(*EARNINGS_FORMS)
    document = F.nullif("primaryDocument", F.lit(""))
    return rows.select(
        F.lit("filing").alias("kind"),
        F.lit(provider).alias("provider"),
        F.col("accession").alias("external_id"),
        F.concat(F.coalesce(F.nullif("form", F.lit("")), F.lit("SEC")), F.lit(" filing")).alias(
            "title"
        ),
        F.coalesce(
            F.col("acceptanceDateTime").try_cast("timestamp"),
            F.col("filingDate").try_cast("timestamp"),
            F.col("received_at"),
        ).alias("source_at"),
        "received_at",
        F.coalesce("tickers", F.array().cast("array<string>")).alias("symbols"),
        F.concat_ws("/", F.col("cik").cast("string"), F.replace("accession", F.lit("-"), F.lit("")), document)
        .alias("__path"),
        document.alias("__document"),
        F.to_json(
            F.struct(
                F.col("accession").alias("accession_number"),
                F.when(earnings, "EARNINGS").otherwise("FILING").alias("catalyst_family"),
                F.col("filingDate").alias("filing_date"),
                "form",
                F.lit(True).alias("material_filing"),
                F.col("primaryDocument").alias("primary_document"),
                F.col("reportDate").alias("report_date"),
                F.when(earnings, F.array(F.lit("EARNINGS_PROXIMITY")))
                .otherwise(F.array().cast("array<string>"))
                .alias("risk_flags"),
            )
        ).alias("payload"),
    ).withColumn("url", F.when(F.col("__document").isNotNull(), F.concat(F.lit(FILING_URL), F.col("__path")))).select(*_RECORD)


def social(
    spark: SparkSession,
    path: str,
    allowed: Sequence[str],
    *,
    engagement_cap: int = ENGAGEMENT_CAP,
    provider: str = "reddit",
) -> DataFrame:
    """Posts that mention an allowed cashtag; removed and future posts are dropped."""
    rows = _json(spark, path, SOCIAL_SCHEMA).select(
        "received_at", "subreddit", F.inline("data.children")
    ).select("received_at", "subreddit", "data.*")
    created = F.timestamp_micros(
        (F.coalesce("created_utc", F.lit(0.0)) * SECOND_MICROS).cast("long")
    )

    def capped(name: str) -> Column:
        value = F.coalesce(F.col(name), F.lit(0))
        return F.least(F.greatest(value, F.lit(0)), F.lit(engagement_cap)).alias(name)

    return (
        rows.withColumns(
            {
                "title": F.trim("title"),
                "external_id": F.trim("id"),
                "symbols": cashtags(F.col("title"), allowed),
                "source_at": created,
            }
        )
        .filter(
            (F.coalesce("title", F.lit("")) != "")
            & (F.coalesce("external_id", F.lit("")) != "")
            & (F.coalesce("removed_by_category", F.lit("")) == "")
            & (F.size("symbols") > 0)
            & (F.col("source_at") <= F.col("received_at"))
        )
        .select(
            F.lit("social").alias("kind"),
            F.lit(provider).alias("provider"),
            "external_id",
            "title",
            "source_at",
            "received_at",
            "symbols",
            F.concat(F.lit(POST_URL), F.coalesce("permalink", F.lit(""))).alias("url"),
            F.to_json(
                F.struct(capped("num_comments"), capped("score"), "subreddit", "upvote_ratio")
            ).alias("payload"),
        )
    )


def symbol_list(spark: SparkSession, path: str) -> DataFrame:
    """Symbols of a text file; blank lines and # comments are skipped."""
    line = F.trim("value")
    return (
        spark.read.text(path)
        .filter((line != "") & ~line.startswith("#"))
        .select(F.upper(line).alias("symbol"))
    )


def candidate_catalog(spark: SparkSession, path: str) -> DataFrame:
    """Universe candidates: one object per line, or lines holding a `candidates` list."""
    schema = f"{CATALOG_SCHEMA.strip()}, candidates array<struct<{_as_fields(CATALOG_SCHEMA)}>>"
    rows = spark.read.schema(schema).json(path)
    flat = rows.filter(F.col("candidates").isNull()).drop("candidates")
    nested = rows.filter(F.col("candidates").isNotNull()).select(F.inline("candidates"))
    return flat.filter(F.col("symbol").isNotNull()).unionByName(nested)


def _as_fields(schema: str) -> str:
    parts = [part.split() for part in schema.replace("\n", " ").split(",")]
    return ", ".join(f"{name}:{kind}" for name, kind in parts)
