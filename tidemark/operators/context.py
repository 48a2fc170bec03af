"""Dated evidence: merge rules, point-in-time view, scores per symbol.

A context record has kind, provider, external_id, title, source_at, received_at, symbols
(array, empty = applies to all), url and payload (JSON text with sorted keys).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.numbers import clip, clip_known, finite
from tidemark.functions.text import (
    NEGATIVE_WORDS,
    POSITIVE_WORDS,
    dedupe_key,
    headline_direction,
    normalized_symbols,
)
from tidemark.operators.scaling import settle

# Fixed values ------------------------------------------------------------------------
CONTEXT_FEATURE_VERSION = "context-v1"
CATALYST_SCHEMA_VERSION = "catalyst-v1"
FUNDAMENTAL_RISK_SCHEMA_VERSION = "fundamental-risk-v1"
KINDS = ("news", "filing", "macro", "social")
GLOBAL = "*"
HALF_LIFE_HOURS = 6.0
SOCIAL_MAX_AGE_HOURS = 24
EVENT_CAP, SOCIAL_CAP = 5, 20
HEADLINE_PROVIDER = "gdelt"
EARNINGS_FAMILIES = ("EARNINGS", "EARNINGS_EVENT")
ENGAGEMENT_SCALE = 1_000
# -------------------------------------------------------------------------------------

CONTENT_KEY = ["kind", "dedupe_key"]
_BODY = ["provider", "external_id", "title", "source_at", "received_at", "url", "payload"]


def prepare_records(records: DataFrame) -> DataFrame:
    """Normalise symbols, drop records without identity, add the dedupe key."""
    named = records
    for name in ("provider", "external_id", "title"):
        named = named.filter(F.trim(name) != "")
    frame = named.withColumns(
        {
            "symbols": normalized_symbols(F.coalesce("symbols", F.array().cast("array<string>"))),
            "payload": F.coalesce("payload", F.lit("{}")),
        }
    )
    return settle(frame.withColumn("dedupe_key", dedupe_key()), "dedupe_key")


def merge_content(prepared: DataFrame) -> DataFrame:
    """One body per (kind, dedupe_key).

    News keeps the body that became available first, with a full tie-break; other kinds
    keep the first arrival. `min` of a struct combines on the map side, so any number of
    copies of one item costs one row per task.
    """
    available = F.greatest("source_at", "received_at")
    news_first = F.when(F.col("kind") == "news", available).otherwise(F.col("received_at"))
    order = F.struct(
        news_first.alias("a"),
        F.col("received_at").alias("b"),
        F.col("source_at").alias("c"),
        F.col("provider").alias("d"),
        F.col("external_id").alias("e"),
        F.col("title").alias("f"),
        F.coalesce("url", F.lit("")).alias("g"),
        F.col("payload").alias("h"),
    )
    body = F.struct(*_BODY, "symbols")
    return (
        prepared.groupBy(*CONTENT_KEY)
        .agg(F.min_by(body, order).alias("__body"))
        .select(*CONTENT_KEY, "__body.*")
    )


def merge_associations(prepared: DataFrame) -> DataFrame:
    """Earliest availability of each news item for each symbol (`*` = everyone)."""
    target = F.when(F.size("symbols") == 0, F.array(F.lit(GLOBAL))).otherwise(F.col("symbols"))
    key = F.struct(
        F.greatest("source_at", "received_at").alias("available_at"),
        F.col("received_at").alias("received_at"),
        F.col("source_at").alias("source_at"),
    )
    return (
        prepared.filter(F.col("kind") == "news")
        .select(*CONTENT_KEY, F.explode(target).alias("symbol"), key.alias("__k"))
        .groupBy(*CONTENT_KEY, "symbol")
        .agg(F.min("__k").alias("__k"))
        .select(*CONTENT_KEY, "symbol", "__k.source_at", "__k.received_at")
    )


def decode_association(raw: Column, symbol: Column, source_at: Column, received_at: Column) -> Column:
    """Association times from stored JSON text: an object with both times, a plain receipt
    time (older rows), or the row's own times when the symbol is absent."""
    times = F.from_json(raw, "map<string,string>")
    value = F.element_at(times, symbol)
    both = F.from_json(value, "source_at timestamp, received_at timestamp")
    legacy = value.try_cast("timestamp")
    return F.struct(
        F.coalesce(both["source_at"], legacy, source_at).alias("source_at"),
        F.coalesce(both["received_at"], legacy, received_at).alias("received_at"),
    )


def known_records(
    content: DataFrame,
    associations: DataFrame,
    cutoff: Column,
    kinds: Sequence[str] = (),
) -> DataFrame:
    """Records published and received by the cutoff, one row per symbol they concern.

    `symbol` is null for records that apply to everyone. News known globally by the cutoff
    gives only its global row; otherwise one row per symbol known by then.
    """
    body = content.filter((F.col("received_at") <= cutoff) & (F.col("source_at") <= cutoff))
    if kinds:
        body = body.filter(F.col("kind").isin(*kinds))
    other = body.filter(F.col("kind") != "news").select(
        *CONTENT_KEY, F.explode_outer("symbols").alias("symbol"), *_BODY
    )
    # One item has at most one row per symbol, so its window is bounded by the symbols.
    item = Window.partitionBy(*CONTENT_KEY)
    links = (
        associations.filter((F.col("received_at") <= cutoff) & (F.col("source_at") <= cutoff))
        .withColumn("__global", F.max((F.col("symbol") == GLOBAL).cast("int")).over(item))
        .filter((F.col("__global") == 0) | (F.col("symbol") == GLOBAL))
        .withColumn("symbol", F.nullif("symbol", F.lit(GLOBAL)))
        .drop("__global")
    )
    news = (
        body.filter(F.col("kind") == "news")
        .drop("source_at", "received_at", "symbols")
        .join(links, CONTENT_KEY)
        .select(*CONTENT_KEY, "symbol", *_BODY)
    )
    return other.unionByName(news)


def newest_by_key(records: DataFrame, key: str = "dedupe_key") -> DataFrame:
    """Newest record per key under a total order (one struct maximum per key)."""
    order = F.struct(
        "received_at", "source_at", "provider", "external_id", "title",
        F.coalesce("url", F.lit("")).alias("url"), "payload",
    )
    rest = [name for name in records.columns if name != key]
    return records.groupBy(key).agg(F.max_by(F.struct(*rest), order).alias("__r")).select(
        key, "__r.*"
    )


def merge_batch_news(records: DataFrame) -> DataFrame:
    """Group one batch's news by key: union of symbols, newest body."""
    order = F.struct("received_at", "source_at", "provider", "external_id")
    bodies = records.groupBy("dedupe_key").agg(
        F.max_by(F.struct(*_BODY), order).alias("__r")
    )
    symbols = (
        records.select("dedupe_key", F.explode("symbols").alias("__s"))
        .groupBy("dedupe_key")
        .agg(F.array_sort(F.collect_set("__s")).alias("symbols"))
    )
    return bodies.join(symbols, "dedupe_key", "left").select(
        "dedupe_key",
        "__r.*",
        F.coalesce("symbols", F.array().cast("array<string>")).alias("symbols"),
    )


# ---- payload readers ----------------------------------------------------------------


def field(name: str) -> Column:
    return F.get_json_object("payload", f"$.{name}")


def _typed(name: str, kind: str) -> Column:
    """A top-level member of the payload read as a type; null where it is not of that type."""
    return F.expr(f"try_variant_get(try_parse_json(payload), '$.{name}', '{kind}')")


def number_of(name: str) -> Column:
    """A finite number from a JSON number, boolean or numeric text, null for anything else."""
    return finite(_typed(name, "double"))


def unit_of(name: str, default: float) -> Column:
    return F.coalesce(clip(number_of(name)), F.lit(default))


def direction_of(name: str) -> Column:
    """Word or clipped number as a direction; JSON null and junk are 0, an absent field null."""
    value = _typed(name, "variant")
    word = F.lower(F.trim(_typed(name, "string")))
    spoken = F.when(word == "positive", 1.0).when(word == "negative", -1.0).otherwise(0.0)
    number = F.coalesce(clip(number_of(name), -1.0, 1.0), F.lit(0.0))
    is_text = F.schema_of_variant(value) == "STRING"
    return F.when(value.isNotNull(), F.when(is_text, spoken).otherwise(number))


def event_score(
    cutoff: Column,
    positive: Sequence[str] = POSITIVE_WORDS,
    negative: Sequence[str] = NEGATIVE_WORDS,
) -> Column:
    """Score of a news, filing or macro record with a six-hour half-life; null if the
    record says nothing about direction."""
    age = F.greatest(
        F.lit(0.0), (F.unix_micros(cutoff) - F.unix_micros("source_at")) / F.lit(3_600_000_000.0)
    )
    recency = F.pow(F.lit(0.5), age / F.lit(HALF_LIFE_HOURS))
    given = clip(number_of("normalized_score"))
    from_headline = F.when(
        (F.col("kind") == "news") & (F.col("provider") == HEADLINE_PROVIDER),
        headline_direction(F.col("title"), positive, negative),
    )
    direction = F.coalesce(direction_of("direction"), from_headline)
    strength = (
        unit_of("impact", 0.5)
        * unit_of("confidence", 0.5)
        * unit_of("relevance", 0.5)
        * recency
    )
    return F.when(given.isNotNull(), clip_known(0.5 + (given - 0.5) * recency)).when(
        direction.isNotNull(), clip_known(0.5 + 0.5 * direction * strength)
    )


def social_score(
    positive: Sequence[str] = POSITIVE_WORDS, negative: Sequence[str] = NEGATIVE_WORDS
) -> Column:
    """Score of a social post from given score, engagement, or attention parts."""
    given = clip(number_of("normalized_score"))
    direction = F.coalesce(
        direction_of("sentiment"),
        direction_of("direction"),
        headline_direction(F.col("title"), positive, negative),
    )
    ratio = clip(number_of("upvote_ratio"))

    def count(name: str) -> Column:
        """Absent, null and empty count as 0; what is no number gives null."""
        value, number = _typed(name, "variant"), number_of(name)
        nothing = value.isNull() | F.is_variant_null(value) | (_typed(name, "string") == "")
        return F.when(F.coalesce(nothing, F.lit(False)), 0.0).when(
            number.isNotNull(), F.greatest(F.lit(0.0), number)
        )

    attention = F.log1p(count("score") + count("num_comments"))
    engagement = F.when(
        attention.isNotNull(), clip_known(attention / F.log1p(F.lit(float(ENGAGEMENT_SCALE))))
    )
    confidence = 0.5 + F.abs(ratio - 0.5)
    strength = (
        unit_of("attention", 0.5)
        * unit_of("engagement", 0.5)
        * unit_of("uniqueness", 0.5)
        * (1 - unit_of("spam_confidence", 0.0))
    )
    return (
        F.when(given.isNotNull(), given)
        .when(direction.isNull(), F.lit(0.5))
        .when(
            _typed("upvote_ratio", "variant").isNotNull(),
            F.coalesce(
                F.when(
                    ratio.isNotNull() & engagement.isNotNull(),
                    clip_known(0.5 + 0.5 * direction * engagement * confidence),
                ),
                F.lit(0.5),
            ),
        )
        .otherwise(clip_known(0.5 + 0.25 * direction * strength))
    )


def risk_flags() -> Column:
    """Upper-cased, sorted flags from a JSON array or a single string."""
    text = field("risk_flags")
    listed = F.coalesce(F.from_json(text, "array<string>"), F.array().cast("array<string>"))
    is_text = F.schema_of_variant(_typed("risk_flags", "variant")) == "STRING"
    flags = F.when(is_text, F.array(text)).otherwise(listed)
    cleaned = F.filter(F.transform(flags, lambda f: F.upper(F.trim(f))), lambda f: f != "")
    return F.array_sort(cleaned)


def catalyst_evidence() -> dict[str, Column]:
    """One schema for news, filing and macro evidence."""
    family = F.coalesce(
        F.nullif(field("catalyst_family"), F.lit("")),
        F.nullif(field("event_type"), F.lit("")),
        F.upper("kind"),
    )
    freshness = F.coalesce(number_of("freshness_hours"), F.lit(0.0))
    return {
        "schema_version": F.lit(CATALYST_SCHEMA_VERSION),
        "family": F.upper(F.trim(family)),
        "direction": F.coalesce(direction_of("direction"), direction_of("sentiment"), F.lit(0.0)),
        "magnitude": F.coalesce(
            clip(number_of("magnitude")), clip(number_of("impact")), F.lit(0.5)
        ),
        "relevance": unit_of("relevance", 0.5),
        "confidence": unit_of("confidence", 0.5),
        "freshness_hours": F.greatest(F.lit(0.0), freshness),
        "risk_flags": risk_flags(),
    }


def fundamental_risk() -> dict[str, Column]:
    """Filing fields as risk context; missing values stay missing."""
    names = (
        "cash", "debt", "operating_cash_flow", "profitability_trend", "market_cap",
        "float_shares", "dilution_risk", "earnings_proximity_days",
    )
    return {
        "schema_version": F.lit(FUNDAMENTAL_RISK_SCHEMA_VERSION),
        **{name: field(name) for name in names},
        "material_filing": F.coalesce(
            field("material_filing").try_cast("boolean"), F.col("kind") == "filing"
        ),
        "risk_flags": risk_flags(),
    }


# ---- scores per symbol --------------------------------------------------------------


def context_scores(
    records: DataFrame,
    symbols: DataFrame,
    cutoff: Column,
    *,
    positive: Sequence[str] = POSITIVE_WORDS,
    negative: Sequence[str] = NEGATIVE_WORDS,
) -> DataFrame:
    """News, social, fundamentals and macro scores and evidence counts per symbol.

    `records` is the output of `known_records` (one row per item and symbol). A record for
    everyone is never multiplied by the symbols: the newest few global records per kind (at
    most 20) and the newest few per symbol are enough to find the newest few of both.
    """
    social = F.col("kind") == "social"
    young = F.unix_micros(cutoff) - F.unix_micros("source_at") <= (
        SOCIAL_MAX_AGE_HOURS * 3_600_000_000
    )
    usable = records.filter(~social | young)
    score = F.when(social, social_score(positive, negative)).otherwise(
        event_score(cutoff, positive, negative)
    )
    scored = settle(
        usable.withColumns(
            {"__score": score, "__family": catalyst_evidence()["family"]}
        ),
        "__score",
        "__family",
    )
    first = F.when(social, F.col("received_at")).otherwise(F.col("source_at"))
    second = F.when(social, F.col("source_at")).otherwise(F.col("received_at"))
    item = F.struct(
        first.alias("a"), second.alias("b"), F.col("provider").alias("c"),
        F.col("external_id").alias("d"), F.col("__score").alias("score"),
    )
    cap = F.when(F.col("kind") == "social", SOCIAL_CAP).otherwise(EVENT_CAP)
    lean = scored.select("kind", "symbol", "__score", "__family", item.alias("__item"))

    def newest(frame: DataFrame, group: list[str], name: str) -> DataFrame:
        w = Window.partitionBy(*group).orderBy(F.col("__item").desc())
        # The numeric limit is what lets Spark cut inside each task; the cap per kind follows.
        return (
            frame.filter(F.col("__score").isNotNull())
            .withColumn("__rn", F.row_number().over(w))
            .filter(F.col("__rn") <= SOCIAL_CAP)
            .filter(F.col("__rn") <= cap)
            .groupBy(*group)
            .agg(F.collect_list("__item").alias(name))
        )

    def counts(frame: DataFrame, group: list[str], prefix: str) -> DataFrame:
        return frame.groupBy(*group).agg(
            F.count("*").alias(f"{prefix}n"),
            F.count_if(F.col("__family").isin(*EARNINGS_FAMILIES)).alias(f"{prefix}e"),
        )

    # Records without a symbol are a group of their own per kind; both are found in one go.
    best_of = newest(lean, ["symbol", "kind"], "__best_of")
    number_of_items = counts(lean, ["symbol", "kind"], "__")
    cells_of = number_of_items.join(
        best_of.select(F.col("symbol").alias("__symbol"), F.col("kind").alias("__kind"), "__best_of"),
        (F.col("kind") == F.col("__kind")) & F.col("symbol").eqNullSafe(F.col("__symbol")),
        "left",
    ).drop("__symbol", "__kind")
    everyone = symbols.select("symbol").distinct()
    nobody = everyone.sparkSession.range(1).select(F.lit(None).cast("string").alias("symbol"))
    grid = everyone.unionByName(nobody).select(
        "symbol", F.explode(F.array(*[F.lit(kind) for kind in KINDS])).alias("kind")
    )
    own = cells_of.select(F.col("symbol").alias("__symbol"), F.col("kind").alias("__kind"), F.col("__n").alias("__on"), F.col("__e").alias("__oe"), F.col("__best_of").alias("__own"))
    met = grid.join(own, (F.col("kind") == F.col("__kind")) & F.col("symbol").eqNullSafe(F.col("__symbol")), "left")
    # A kind has one row per symbol here.
    of_kind = Window.partitionBy("kind")
    unnamed = F.col("symbol").isNull()
    joined = met.select(
        "symbol", "kind", "__own", "__on", "__oe",
        F.max(F.when(unnamed, F.col("__own"))).over(of_kind).alias("__shared"),
        F.max(F.when(unnamed, F.col("__on"))).over(of_kind).alias("__sn"),
        F.max(F.when(unnamed, F.col("__oe"))).over(of_kind).alias("__se"),
    ).filter(F.col("symbol").isNotNull())
    pool = F.concat(
        F.coalesce("__own", F.array().cast(_item_type())),
        F.coalesce("__shared", F.array().cast(_item_type())),
    )
    best = F.slice(F.sort_array(pool, asc=False), F.lit(1), cap)
    mean = F.when(
        F.size("__best") > 0,
        F.aggregate("__best", F.lit(0.0), lambda total, i: total + i["score"]) / F.size("__best"),
    )
    zero = F.lit(0)
    cells = joined.withColumn("__best", best).select(
        "symbol",
        "kind",
        mean.alias("score"),
        (F.coalesce("__on", zero) + F.coalesce("__sn", zero)).alias("n"),
        (F.coalesce("__oe", zero) + F.coalesce("__se", zero)).alias("earnings"),
    )

    def of(kind: str, value: str) -> Column:
        return F.max(F.when(F.col("kind") == kind, F.col(value)))

    return cells.groupBy("symbol").agg(
        of("news", "score").alias("news_score"),
        of("social", "score").alias("social_score"),
        of("filing", "score").alias("fundamental_score"),
        of("macro", "score").alias("macro_score"),
        of("news", "n").alias("news_count"),
        of("social", "n").alias("social_count"),
        of("filing", "n").alias("filing_count"),
        of("macro", "n").alias("macro_count"),
        F.sum("earnings").alias("earnings_count"),
    )


def _item_type() -> str:
    return "array<struct<a:timestamp,b:timestamp,c:string,d:string,score:double>>"


def latest_filings(records: DataFrame, symbols: DataFrame) -> DataFrame:
    """Newest filing per symbol, own or for everyone, with its risk fields."""
    filings = records.filter(F.col("kind") == "filing")
    order = F.struct("source_at", "received_at", "provider", "external_id")
    body = F.struct("kind", *_BODY)
    own = (
        filings.filter(F.col("symbol").isNotNull())
        .groupBy("symbol")
        .agg(F.max(F.struct(order.alias("o"), body.alias("r"))).alias("__own"))
    )
    shared = (
        filings.filter(F.col("symbol").isNull())
        .groupBy("kind")
        .agg(F.max(F.struct(order.alias("o"), body.alias("r"))).alias("__shared"))
    )
    # `shared` is a single row, matched on the constant kind.
    newest = (
        symbols.select("symbol").distinct().withColumn("kind", F.lit("filing"))
        .join(own, "symbol", "left")
        .join(shared, "kind", "left")
        .withColumn("__best", F.greatest("__own", "__shared"))
        .filter(F.col("__best").isNotNull())
        .select("symbol", "__best.r.*")
    )
    return newest.select("symbol", "source_at", "external_id", *[
        expr.alias(name) for name, expr in fundamental_risk().items()
    ])


def with_context(candidates: DataFrame, scores: DataFrame) -> DataFrame:
    """Attach context scores to candidates; symbols without evidence get nulls."""
    names = ["news_score", "social_score", "fundamental_score"]
    return candidates.drop(*names).join(scores.select("symbol", *names), "symbol", "left")
