"""URL filters: host rules, and pattern rules indexed by their rarest literal token.

A pattern rule is text with `*` for anything, `^` for a separator or the end, `||` before a host
or one of its parent domains, `|` for the start or end of the url; `@@` in front allows what
other patterns block. A run of letters and digits in a rule that is bounded on both sides must
be a whole token of every url the rule fits. Each rule is filed under that of its tokens that
is in the fewest urls; a url fetches rules by its tokens, and only these run their regular
expression. Rules without such a token are filed under the empty token, which every url has.

Host rules are fetched in the same way, by the host and its parent domains.

The rules are a parameter of the job, so their index is small by construction; urls are not
bounded and are shuffled only where a rule was met. Edge cases: null urls and urls without
`://` have an empty host and path, no host rule fits them, patterns still may; repeated rows each
give a row; an empty table gives an empty table; other columns are not read.
"""

from __future__ import annotations

import json
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.shared import materialise

# Host rules, longest fitting one wins.
HOST_RULES = [
    ("block", "net", "/"),
    ("allow", "example.net", "/en/"),
    ("block", "example.com", "/de/"),
    ("allow", "org", "/fr/"),
]

# Pattern rules of the default list: hosts and parameters of advertising and spam.
PATTERN_RULES = [
    "||casino-win.",
    "||cheap-pills.",
    "||free-bets.",
    "||ads-track.",
    "-casino.",
    "/adclick/",
    "||doubleclick.",
    "^popunder^",
    "*.exe|",
    "@@||example.org^fr/",
]

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_RULE = "array<struct<rule:string,allows:boolean,regex:string,tokens:array<string>>>"
_HOST = "array<struct<key:string,verdict:string,path:string,rule:string>>"


def literal_tokens(rule: str) -> list[str]:
    """Runs of letters and digits that are whole tokens of every url the rule fits."""
    body = rule.removeprefix("@@")
    out = set()
    for found in re.finditer("[a-z0-9]+", body):
        before, after = body[: found.start()], body[found.end() :]
        if before and before[-1] != "*" and after and after[0] != "*":
            out.add(found[0])
    return sorted(out)


def pattern_regex(rule: str) -> str:
    """The rule as a regular expression that Java and RE2 read alike."""
    body = rule.removeprefix("@@")
    head = tail = ""
    if body.startswith("||"):
        head, body = r"^[a-z][a-z0-9+.-]*://([^/?#]*\.)?", body[2:]
    elif body.startswith("|"):
        head, body = "^", body[1:]
    if body.endswith("|"):
        body, tail = body[:-1], r"\z"
    spelt = {"*": ".*", "^": r"([^a-z0-9_.%-]|\z)"}
    return "(?s)" + head + "".join(spelt.get(char) or (char if char.isalnum() else f"[{char}]" if char not in r"\^[]" else "\\" + char) for char in body) + tail


def _low(text: Column) -> Column:
    return F.translate(text, _UPPER, _UPPER.lower())


def parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty without `://`."""
    shape = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    return (
        _low(F.coalesce(F.regexp_extract(url, shape, 1), F.lit(""))),
        F.coalesce(F.regexp_extract(url, shape, 2), F.lit("")),
    )


def _inline(spark, rows: list[dict], schema: str) -> DataFrame:
    return spark.range(1).select(F.inline(F.from_json(F.lit(json.dumps(rows)), schema)))


def filtered(
    pages: DataFrame,
    host_rules: list[tuple[str, str, str]] = HOST_RULES,
    pattern_rules: list[str] = PATTERN_RULES,
    default: str = "allow",
) -> DataFrame:
    """page_id, host, path, rule, verdict and pattern (the pattern rule that decided) per row."""
    spark = pages.sparkSession
    host, path = parts(F.col("url"))
    urls = pages.select("page_id", "url").select("page_id", "url", host.alias("host"), path.alias("path"))
    # Distinct urls carry the search; a url on many rows is searched once.
    searched = urls.select("url", "host", "path").where("url IS NOT NULL").distinct()
    domains = F.expr(
        """CASE WHEN host = '' THEN array() ELSE
           transform(sequence(1, size(split(host, '[.]'))),
                     i -> concat('/', array_join(slice(split(host, '[.]'), i, size(split(host, '[.]'))), '.'))) END"""
    )
    tokens = F.array_distinct(F.split(_low(F.col("url")), "[^a-z0-9]+"))
    keyed = searched.select(
        "url",
        "path",
        F.explode(F.concat(domains, F.array_union(F.array_remove(tokens, ""), F.array(F.lit(""))))).alias("key"),
    )

    patterns = [
        {"rule": rule, "allows": rule.startswith("@@"), "regex": pattern_regex(rule), "tokens": literal_tokens(rule)}
        for rule in pattern_rules
    ]
    rules = _inline(spark, patterns, _RULE)
    rule_tokens = rules.select("rule", "allows", "regex", F.explode(F.concat("tokens", F.array(F.lit("")))).alias("key"))
    counts = keyed.join(F.broadcast(rule_tokens.select("key").distinct()), "key").groupBy("key").count()
    # The empty token comes last: it serves rules that have no other.
    order = F.struct((F.col("key") == "").alias("last"), F.coalesce("count", F.lit(0)).alias("n"), "key")
    index = (
        rule_tokens.join(counts, "key", "left")
        .groupBy("rule", "allows", "regex")
        .agg(F.min(order).alias("best"))
        .select(F.col("best.key").alias("key"), "rule", F.when(F.col("allows"), "allow").otherwise("block").alias("verdict"), "regex", F.lit(None).cast("string").alias("starts"))
    )
    hosts = _inline(
        spark,
        [{"key": f"/{host}", "verdict": verdict, "path": path, "rule": host + path} for verdict, host, path in host_rules],
        _HOST,
    ).select("key", "rule", "verdict", F.lit(None).cast("string").alias("regex"), F.col("path").alias("starts"))
    candidates = keyed.join(F.broadcast(index.unionByName(hosts)), "key").where(
        F.when(F.col("regex").isNotNull(), F.regexp_like(_low(F.col("url")), F.col("regex"))).otherwise(
            F.startswith(F.col("path"), F.col("starts"))
        )
    )
    is_host = F.col("regex").isNull()
    # Longest host rule, then by its text; patterns that allow go before those that block.
    longest = F.struct(F.length("rule").alias("size"), "rule", "verdict")
    first = F.struct((F.col("verdict") == "block").alias("blocks"), "rule", "verdict")
    decided = candidates.groupBy("url").agg(
        F.max(F.when(is_host, longest)).alias("by_host"), F.min(F.when(~is_host, first)).alias("by_pattern")
    )
    # Written, so that both sides of the join are plain shuffles and Spark can split a hot url.
    return urls.join(materialise(decided), "url", "left").select(
        "page_id",
        "host",
        "path",
        F.col("by_host.rule").alias("rule"),
        F.coalesce(F.col("by_host.verdict"), F.col("by_pattern.verdict"), F.lit(default)).alias("verdict"),
        F.when(F.col("by_host").isNull(), F.col("by_pattern.rule")).alias("pattern"),
    )


def result(pages: DataFrame) -> DataFrame:
    return filtered(pages)


def _sql() -> str:
    """The same verdicts for DuckDB, every url against every rule."""
    quoted = lambda text: "'" + text.replace("'", "''") + "'"
    hosts = ", ".join(f"('{verdict}', '{host}', '{path}')" for verdict, host, path in HOST_RULES)
    patterns = ", ".join(
        f"({quoted(rule)}, '{'allow' if rule.startswith('@@') else 'block'}', {quoted(pattern_regex(rule))})" for rule in PATTERN_RULES
    )
    shape = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    return rf"""
WITH u AS (SELECT row_number() OVER () AS r, page_id, url, translate(url, '{_UPPER}', '{_UPPER.lower()}') AS low,
    coalesce(translate(regexp_extract(url, '{shape}', 1), '{_UPPER}', '{_UPPER.lower()}'), '') AS host,
    coalesce(regexp_extract(url, '{shape}', 2), '') AS path FROM pages),
hr(verdict, h, p) AS (VALUES {hosts}),
pr(rule, verdict, regex) AS (VALUES {patterns}),
byhost AS (SELECT r, arg_max(struct_pack(rule := h || p, verdict := verdict), struct_pack(n := length(h || p), rule := h || p)) AS x
  FROM u, hr WHERE (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY r),
bypattern AS (SELECT r, arg_min(struct_pack(rule := rule, verdict := verdict), struct_pack(blocks := verdict = 'block', rule := rule)) AS x
  FROM u, pr WHERE regexp_matches(low, regex) GROUP BY r)
SELECT page_id, host, path, byhost.x.rule AS rule,
  coalesce(byhost.x.verdict, bypattern.x.verdict, 'allow') AS verdict,
  CASE WHEN byhost.x IS NULL THEN bypattern.x.rule END AS pattern
FROM u LEFT JOIN byhost USING (r) LEFT JOIN bypattern USING (r)"""


ORACLE_SQL = _sql()
