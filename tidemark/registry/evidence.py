"""Context-evidence queries over documents and labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import text
from tidemark.operators import context
from tidemark.registry.core import query, sql_view, table
from tidemark.registry.views import us
from tidemark.shared import shared_folder
from tidemark.sources import tables

POSITIVE = ("the", "is", "le", "el", "die")
NEGATIVE = ("and", "of", "la", "los", "der")

sql_view(
    "records",
    """
    SELECT d.doc_id, ['news', 'filing', 'macro', 'social'][1 + CAST(d.doc_id % 4 AS INTEGER)] AS kind,
           CASE WHEN d.doc_id % 5 = 0 THEN 'gdelt' ELSE d.source END AS provider,
           'doc:' || (d.doc_id - d.doc_id % 12) AS external_id, d.text AS title,
           epoch_us(TIMESTAMP '2024-01-01') + d.doc_id * 60000000 AS source_us,
           epoch_us(TIMESTAMP '2024-01-01') + (d.doc_id + d.doc_id % 30) * 60000000 AS received_us,
           CASE WHEN d.doc_id % 7 = 0 THEN []::VARCHAR[]
                WHEN d.doc_id % 15 = (d.doc_id * 7 + 3) % 15 THEN ['S' || d.doc_id % 15]
                ELSE ['S' || d.doc_id % 15, 'S' || (d.doc_id * 7 + 3) % 15] END AS symbols,
           CASE WHEN l.quality = 1 THEN 1.0 WHEN l.quality = 0 THEN -1.0 END AS direction,
           CASE WHEN l.toxic = 1 THEN 1.0 ELSE (d.doc_id % 10) / 10.0 END::DOUBLE AS impact,
           CASE WHEN d.doc_id % 8 = 1 THEN 'EARNINGS' END AS family,
           '{' || CASE WHEN d.doc_id % 8 = 1 THEN '"catalyst_family":"earnings",' ELSE '' END
             || CASE WHEN l.quality = 1 THEN '"direction":"positive",' WHEN l.quality = 0 THEN '"direction":-3,' ELSE '' END
             || '"impact":' || CASE WHEN l.toxic = 1 THEN '7' ELSE '0.' || d.doc_id % 10 END
             || CASE WHEN d.doc_id % 9 = 0 THEN ',"score":' || d.doc_id % 200 || ',"upvote_ratio":0.8' ELSE '' END
             || '}' AS payload
    FROM documents d LEFT JOIN labels l USING (doc_id)
    """,
)


def records(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text", "source")
    labels = table(spark, folder, "labels")
    df = docs.join(labels, "doc_id", "left")
    key = F.col("doc_id")
    base = F.lit("2024-01-01").cast("timestamp")
    quality, toxic = F.col("quality"), F.col("toxic")

    def minutes(value):
        return F.timestamp_micros(F.unix_micros(base) + value * 60_000_000)

    a = F.concat(F.lit("S"), (key % 15).cast("string"))
    b = F.concat(F.lit("S"), ((key * 7 + 3) % 15).cast("string"))
    payload = F.concat(
        F.lit("{"),
        F.when(key % 8 == 1, '"catalyst_family":"earnings",').otherwise(""),
        F.when(quality == 1, '"direction":"positive",')
        .when(quality == 0, '"direction":-3,')
        .otherwise(""),
        F.lit('"impact":'),
        F.when(toxic == 1, "7").otherwise(F.concat(F.lit("0."), (key % 10).cast("string"))),
        F.when(
            key % 9 == 0,
            F.concat(F.lit(',"score":'), (key % 200).cast("string"), F.lit(',"upvote_ratio":0.8')),
        ).otherwise(""),
        F.lit("}"),
    )
    return df.select(
        "doc_id",
        F.get(F.array(*[F.lit(k) for k in ("news", "filing", "macro", "social")]), (key % 4).cast("int")).alias("kind"),
        F.when(key % 5 == 0, "gdelt").otherwise(F.col("source")).alias("provider"),
        F.concat(F.lit("doc:"), (key - key % 12).cast("string")).alias("external_id"),
        F.col("text").alias("title"),
        minutes(key).alias("source_at"),
        minutes(key + key % 30).alias("received_at"),
        F.when(key % 7 == 0, F.array().cast("array<string>"))
        .otherwise(F.array(F.lower(a), a, b))
        .alias("symbols"),
        F.lit(None).cast("string").alias("url"),
        payload.alias("payload"),
    )


sql_view(
    "keyed",
    r"""
    SELECT *, CASE WHEN kind = 'news' THEN sha256(strftime(make_timestamp(source_us), '%Y-%m-%d') || ':' ||
               coalesce(nullif(trim(regexp_replace(replace(lower(title), 'ß', 'ss'), '[^\p{L}\p{N}]+', ' ', 'g')), ''), external_id))
             ELSE sha256(provider || ':' || external_id) END AS dedupe_key
    FROM records WHERE trim(provider) <> '' AND trim(title) <> ''
    """,
    "records",
)
sql_view(
    "content",
    """
    SELECT * FROM keyed QUALIFY row_number() OVER (PARTITION BY kind, dedupe_key ORDER BY
      CASE WHEN kind = 'news' THEN greatest(source_us, received_us) ELSE received_us END, received_us, source_us,
      provider, external_id, title, payload) = 1
    """,
    "keyed",
)
sql_view(
    "assoc",
    """
    SELECT kind, dedupe_key, symbol, source_us, received_us FROM (
      SELECT kind, dedupe_key, source_us, received_us,
             unnest(CASE WHEN len(symbols) = 0 THEN ['*'] ELSE symbols END) AS symbol FROM keyed WHERE kind = 'news')
    QUALIFY row_number() OVER (PARTITION BY kind, dedupe_key, symbol
      ORDER BY greatest(source_us, received_us), received_us, source_us) = 1
    """,
    "keyed",
)
#: Seven tenths of the time from the first record received to the last one.
CUTOFF_SQL = """(SELECT min(received_us) + (max(received_us) - min(received_us)) // 600000000 * 7 * 60000000 FROM records)"""
sql_view(
    "known",
    f"""
    WITH body AS (SELECT * FROM content WHERE received_us <= {CUTOFF_SQL} AND source_us <= {CUTOFF_SQL}),
    seen AS (SELECT * FROM assoc WHERE received_us <= {CUTOFF_SQL} AND source_us <= {CUTOFF_SQL}),
    everyone AS (SELECT * FROM seen WHERE symbol = '*'),
    links AS (SELECT kind, dedupe_key, NULL AS symbol, source_us, received_us FROM everyone
              UNION ALL SELECT s.* FROM seen s ANTI JOIN everyone e USING (kind, dedupe_key) WHERE s.symbol <> '*')
    SELECT kind, dedupe_key, s.symbol, source_us, received_us, provider, external_id, title, payload, direction, impact, family, doc_id
    FROM body, LATERAL (SELECT unnest(CASE WHEN len(symbols) = 0 THEN [NULL] ELSE symbols END) AS symbol) s
    WHERE kind <> 'news'
    UNION ALL
    SELECT b.kind, b.dedupe_key, l.symbol, l.source_us, l.received_us, provider, external_id, title, payload, direction, impact, family, doc_id
    FROM body b JOIN links l USING (kind, dedupe_key) WHERE b.kind = 'news'
    """,
    "content",
    "assoc",
)


def cutoff(spark: SparkSession, folder: str) -> Column:
    """Seven tenths of the time from the first record received to the last one."""
    minute = F.col("doc_id") + F.col("doc_id") % 30
    first, last = F.min(minute), F.max(minute)
    at = F.expr("unix_micros(TIMESTAMP'2024-01-01')") + (first + F.floor((last - first) / 10) * 7) * 60_000_000
    return table(spark, folder, "documents").agg(F.timestamp_micros(at)).scalar()


def _prepared(spark: SparkSession, folder: str) -> DataFrame:
    return context.prepare_records(records(spark, folder))


def _known(spark: SparkSession, folder: str) -> DataFrame:
    prepared = _prepared(spark, folder)
    return context.known_records(
        context.merge_content(prepared), context.merge_associations(prepared), cutoff(spark, folder)
    )


@query(
    "context_dedupe",
    "SELECT kind, dedupe_key, provider, external_id, source_us, received_us, payload FROM content",
    "content",
)
def context_dedupe(spark: SparkSession, folder: str) -> DataFrame:
    return context.merge_content(_prepared(spark, folder)).select(
        "kind", "dedupe_key", "provider", "external_id", us("source_at").alias("source_us"),
        us("received_at").alias("received_us"), "payload",
    )


@query("context_associations", "SELECT * FROM assoc", "assoc")
def context_associations(spark: SparkSession, folder: str) -> DataFrame:
    return context.merge_associations(_prepared(spark, folder)).select(
        "kind", "dedupe_key", "symbol", us("source_at").alias("source_us"),
        us("received_at").alias("received_us"),
    )


def _upserted(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """The records stored in two batches that share keys, then read back."""
    prepared = _prepared(spark, folder)
    root = shared_folder(spark)
    first = F.pmod(F.xxhash64("external_id", "received_at"), F.lit(2)) == 0
    for batch in (prepared.filter(first), prepared.filter(~first)):
        tables.upsert_context(batch, root)
    schemas = context.merge_content(prepared).schema, context.merge_associations(prepared).schema
    return tables.read_context(spark, root, *schemas)


@query(
    "context_upsert",
    "SELECT kind, dedupe_key, provider, external_id, source_us, received_us, payload FROM content",
    "content",
)
def context_upsert(spark: SparkSession, folder: str) -> DataFrame:
    """Two batches upserted by bucket give the content of all records."""
    return _upserted(spark, folder)[0].select(
        "kind", "dedupe_key", "provider", "external_id", us("source_at").alias("source_us"),
        us("received_at").alias("received_us"), "payload",
    )


@query("context_upsert_links", "SELECT * FROM assoc", "assoc")
def context_upsert_links(spark: SparkSession, folder: str) -> DataFrame:
    """The same for the symbols of news."""
    return _upserted(spark, folder)[1].select(
        "kind", "dedupe_key", "symbol", us("source_at").alias("source_us"),
        us("received_at").alias("received_us"),
    )


@query(
    "context_asof",
    "SELECT kind, dedupe_key, symbol, source_us, received_us, external_id FROM known",
    "known",
)
def context_asof(spark: SparkSession, folder: str) -> DataFrame:
    return _known(spark, folder).select(
        "kind", "dedupe_key", "symbol", us("source_at").alias("source_us"),
        us("received_at").alias("received_us"), "external_id",
    )


@query(
    "news_batch_merge",
    """
WITH n AS (SELECT * FROM keyed WHERE kind = 'news'),
b AS (SELECT * FROM n QUALIFY row_number() OVER (PARTITION BY dedupe_key
        ORDER BY received_us DESC, source_us DESC, provider DESC, external_id DESC) = 1),
s AS (SELECT dedupe_key, array_to_string(list_sort(list(DISTINCT s)), ',') AS symbols
      FROM (SELECT dedupe_key, unnest(symbols) AS s FROM n) GROUP BY 1)
SELECT dedupe_key, external_id, received_us, coalesce(s.symbols, '') AS symbols FROM b LEFT JOIN s USING (dedupe_key)
""",
    "keyed",
)
def news_batch_merge(spark: SparkSession, folder: str) -> DataFrame:
    news = _prepared(spark, folder).filter(F.col("kind") == "news")
    return context.merge_batch_news(news).select(
        "dedupe_key", "external_id", us("received_at").alias("received_us"),
        F.concat_ws(",", "symbols").alias("symbols"),
    )


def _list(words: tuple[str, ...]) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


DIRECTION_SQL = rf"""sign(len(list_intersect(list_distinct(list_transform(regexp_split_to_array(trim(replace(lower(title), 'ß', 'ss')), '\s+'),
   lambda w: regexp_replace(w, '[^\p{{L}}\p{{N}}]', '', 'g'))), {_list(POSITIVE)}))
   - len(list_intersect(list_distinct(list_transform(regexp_split_to_array(trim(replace(lower(title), 'ß', 'ss')), '\s+'),
   lambda w: regexp_replace(w, '[^\p{{L}}\p{{N}}]', '', 'g'))), {_list(NEGATIVE)})))"""


@query(
    "headline_polarity",
    f"""SELECT doc_id, CAST(nullif({DIRECTION_SQL}, 0) AS DOUBLE) AS direction
        FROM (SELECT doc_id, text AS title FROM documents)""",
)
def headline_polarity(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return docs.select(
        "doc_id", text.headline_direction(F.col("text"), POSITIVE, NEGATIVE).alias("direction")
    )


@query(
    "title_keys",
    r"""SELECT doc_id, trim(regexp_replace(replace(lower(text), 'ß', 'ss'), '[^\p{L}\p{N}]+', ' ', 'g')) AS title,
               sha256(text) AS content_hash FROM documents""",
)
def title_keys(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").select(
        "doc_id", text.normalized_title(F.col("text")).alias("title"),
        F.sha2("text", 256).alias("content_hash"),
    )


sql_view(
    "scored_records",
    f"""
    WITH r AS (SELECT *, pow(0.5, greatest(0, {CUTOFF_SQL} - source_us) / 3600000000.0 / 6.0) AS recency,
                      {DIRECTION_SQL} AS hd FROM known
               WHERE kind <> 'social' OR {CUTOFF_SQL} - source_us <= 24 * 3600000000),
    d AS (SELECT *, CASE WHEN direction IS NOT NULL THEN direction::DOUBLE
                         WHEN kind = 'social' OR (kind = 'news' AND provider = 'gdelt') THEN nullif(hd, 0) END AS dir FROM r)
    SELECT *, CASE WHEN kind = 'social' THEN
        CASE WHEN dir IS NULL THEN 0.5
             WHEN doc_id % 9 = 0 THEN least(1, greatest(0, 0.5 + 0.5 * dir * least(1, ln(1 + doc_id % 200) / ln(1001)) * 0.8))
             ELSE least(1, greatest(0, 0.5 + 0.25 * dir * 0.125)) END
      WHEN dir IS NOT NULL THEN least(1, greatest(0, 0.5 + 0.5 * dir * least(1, impact) * 0.25 * recency)) END AS score
    FROM d
    """,
    "known",
)


@query(
    "context_scores",
    """
WITH syms AS (SELECT DISTINCT symbol FROM known WHERE symbol IS NOT NULL),
j AS (SELECT s.symbol AS sym, r.* EXCLUDE (symbol) FROM syms s JOIN scored_records r
      ON r.symbol IS NULL OR r.symbol = s.symbol),
n AS (SELECT *, row_number() OVER (PARTITION BY sym, kind ORDER BY
        CASE WHEN kind = 'social' THEN received_us ELSE source_us END DESC,
        CASE WHEN kind = 'social' THEN source_us ELSE received_us END DESC, provider DESC, external_id DESC) AS rn
      FROM j WHERE score IS NOT NULL),
t AS (SELECT * FROM n WHERE rn <= CASE WHEN kind = 'social' THEN 20 ELSE 5 END),
a AS (SELECT sym, avg(score) FILTER (kind = 'news') AS news, avg(score) FILTER (kind = 'social') AS social,
             avg(score) FILTER (kind = 'filing') AS filing, avg(score) FILTER (kind = 'macro') AS macro FROM t GROUP BY sym),
c AS (SELECT sym, count_if(kind = 'news') AS nn, count_if(kind = 'social') AS ns, count_if(kind = 'filing') AS nf,
             count_if(kind = 'macro') AS nm, count_if(family = 'EARNINGS') AS ne FROM j GROUP BY sym)
SELECT c.sym AS symbol, round(news, 8) AS news_score, round(social, 8) AS social_score,
       round(filing, 8) AS fundamental_score, round(macro, 8) AS macro_score,
       CAST(nn AS BIGINT) AS news_count, CAST(ns AS BIGINT) AS social_count, CAST(nf AS BIGINT) AS filing_count,
       CAST(nm AS BIGINT) AS macro_count, CAST(ne AS BIGINT) AS earnings_count
FROM c LEFT JOIN a USING (sym)
""",
    "scored_records",
)
def context_scores(spark: SparkSession, folder: str) -> DataFrame:
    known = _known(spark, folder)
    symbols = known.filter(F.col("symbol").isNotNull()).select("symbol").distinct()
    out = context.context_scores(
        known, symbols, cutoff(spark, folder), positive=POSITIVE, negative=NEGATIVE
    )
    names = ("news_score", "social_score", "fundamental_score", "macro_score")
    return out.select(
        "symbol", *[F.round(c, 8).alias(c) for c in names], "news_count", "social_count",
        "filing_count", "macro_count", "earnings_count",
    )


@query(
    "catalyst_normalise",
    """SELECT doc_id, coalesce(family, upper(kind)) AS family, coalesce(direction, 0)::DOUBLE AS direction,
              round(least(1, impact), 8) AS magnitude, 0.5::DOUBLE AS confidence FROM keyed""",
    "keyed",
)
def catalyst_normalise(spark: SparkSession, folder: str) -> DataFrame:
    parts = context.catalyst_evidence()
    return _prepared(spark, folder).select(
        "doc_id", parts["family"].alias("family"), parts["direction"].alias("direction"),
        F.round(parts["magnitude"], 8).alias("magnitude"), parts["confidence"].alias("confidence"),
    )


@query(
    "latest_filings",
    """
WITH f AS (SELECT * FROM known WHERE kind = 'filing'),
syms AS (SELECT DISTINCT symbol FROM known WHERE symbol IS NOT NULL)
SELECT s.symbol, f.external_id, f.source_us, TRUE AS material_filing
FROM syms s JOIN f ON f.symbol IS NULL OR f.symbol = s.symbol
QUALIFY row_number() OVER (PARTITION BY s.symbol ORDER BY source_us DESC, received_us DESC, provider DESC, external_id DESC) = 1
""",
    "known",
)
def latest_filings(spark: SparkSession, folder: str) -> DataFrame:
    known = _known(spark, folder)
    return context.latest_filings(known, known.filter("symbol IS NOT NULL")).select(
        "symbol", "external_id", us("source_at").alias("source_us"), "material_filing"
    )
