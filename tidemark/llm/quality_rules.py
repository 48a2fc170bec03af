"""Quality rules in DataFrame functions: shape of a text and divergence from language references.

The base rules reject texts of too few words or with too many words in repeated 5-word windows.
The method compares two histograms of a text with references per language, by Jensen-Shannon
distance (root of the divergence in bits, 0 to 1), and takes the nearest language:

* character classes, for texts of at least `min_words_classes` words;
* common words, for texts of at least `min_words_common` words.

Shorter texts have too few counts to be judged by distribution and pass. So do, for common words,
texts in which less than `min_listed` of all words are listed ones of any one language: they are in
a language without a reference, which says nothing about their quality. Everything is computed
within the row, so there is no shuffle and a text of any length is one row's work.

Edge cases: null text counts as empty (no words, so it fails the base rule); repeated rows each
give a row; an empty table gives an empty table; other columns are kept aside and never clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The most common words of each language, most common first.
COMMON_WORDS = {
    "en": "the of and to a in is that it for was on with as by be this are at from",
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als",
    "fr": "de la le et les des en un du une que pour est dans qui par sur pas au avec",
    "es": "de la que el en y los se las del un por con no una su para al es lo",
}
#: Share of the k-th common word among all words: FIRST_SHARE / k ^ DECAY.
FIRST_SHARE, DECAY = 0.0625, 0.8
#: Shares of characters in running text: upper case, digits, sentence marks, symbols, white
#: space; the rest is lower case and letters without case.
CLASS_SHARES = {
    "en": (0.015, 0.002, 0.024, 0.001, 0.166),
    "de": (0.015, 0.002, 0.022, 0.001, 0.155),
    "fr": (0.015, 0.002, 0.024, 0.001, 0.166),
    "es": (0.015, 0.002, 0.024, 0.001, 0.162),
}

BLANK = r"[ \t-\r]"
SYMBOLS = r"[#*$%&|<>]"
MARKS = r"[.,;:!?'\"()-]"
COUNTED = r"[^\p{Lu}0-9.,;:!?'\"()\-#*$%&|<>]+"
WINDOW = 5


def word_shares(language: str) -> dict[str, float]:
    return {word: FIRST_SHARE / (k + 1) ** DECAY for k, word in enumerate(COMMON_WORDS[language].split())}


def removed(text: Column, pattern: str) -> Column:
    """How many characters of a text match a class."""
    return F.length(text) - F.length(F.regexp_replace(text, pattern, ""))


def distance(shares: Column, reference: list[float]) -> Column:
    """Jensen-Shannon distance in bits between an array of shares and a reference."""

    def half(part: Column, whole: Column) -> Column:
        return F.when(part > 0, part * F.log2(2 * part / whole)).otherwise(0.0)

    terms = F.zip_with(
        shares,
        F.array(*[F.lit(float(value)) for value in reference]),
        # A share of zero leaves the reference's own term, b * log2(2), which is b.
        lambda a, b: F.when(a > 0, half(a, a + b) + half(b, a + b)).otherwise(b),
    )
    total = F.aggregate(terms, F.lit(0.0), lambda sum_, term: sum_ + term)
    return F.sqrt(F.greatest(total / 2, F.lit(0.0)))


def measured(df: DataFrame, text: str = "text") -> DataFrame:
    """Adds the base counts and both distances to every row, under a struct column `row`."""
    base = df.select(F.struct(*df.columns).alias("row"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    parts = base.select(
        "row",
        "t",
        F.array_remove(F.split("t", BLANK + "+"), "").alias("w"),
        F.filter(F.split("t", "\n"), lambda line: line.rlike(r"[^ \t-\r]")).alias("lines"),
        F.split(F.lower("t"), r"[^\p{L}]+").alias("plain"),
        # Characters of no counted class go in one pass; the classes are counted in what is left.
        F.regexp_replace("t", COUNTED, "").alias("few"),
    )
    common = sorted({word for words in COMMON_WORDS.values() for word in words.split()})
    counted = parts.select(
        "row",
        "t",
        "w",
        F.size("w").alias("n"),
        F.length(F.array_join("w", "")).alias("word_chars"),
        F.col("few"),
        removed(F.col("few"), SYMBOLS).alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).alias("n_dup_lines"),
        F.filter("plain", lambda word: word.isin(common)).alias("hits"),
        F.transform("w", lambda word: F.xxhash64(word)).alias("h"),
    ).withColumn(
        "hashes",
        F.expr(
            f"""CASE WHEN size(h) >= {WINDOW} THEN transform(sequence(0, size(h) - {WINDOW}),
                i -> xxhash64(h[i], h[i + 1], h[i + 2], h[i + 3], h[i + 4]))
                ELSE CAST(array() AS array<bigint>) END"""
        ),
    )
    # Equal windows have equal hashes; only texts with equal hashes compare the words.
    keyed = counted.withColumn(
        "keyed",
        F.expr(
            f"""CASE WHEN size(array_distinct(hashes)) < size(hashes) THEN array_sort(transform(
                sequence(0, size(w) - {WINDOW}),
                i -> struct(concat_ws(' ', w[i], w[i + 1], w[i + 2], w[i + 3], w[i + 4]) AS words, i AS at)))
                END"""
        ),
    ).drop("h", "hashes")
    starts = keyed.withColumn(
        "starts",
        F.expr(
            """array_sort(transform(filter(sequence(0, size(keyed) - 1), j ->
                (j > 0 AND keyed[j].words = keyed[greatest(j - 1, 0)].words)
                OR (j < size(keyed) - 1 AND keyed[j].words = keyed[least(j + 1, size(keyed) - 1)].words)),
                j -> keyed[j].at))"""
        ),
    ).drop("keyed")
    repeated = F.expr(
        f"""CASE WHEN size(starts) > 0 THEN aggregate(sequence(0, size(starts) - 1), 0, (total, j) ->
            total + IF(j = size(starts) - 1, {WINDOW}, least({WINDOW}, starts[least(j + 1, size(starts) - 1)] - starts[j])))
            ELSE 0 END"""
    )
    chars = F.greatest(F.length("t"), F.lit(1))
    classes = [removed(F.col("few"), r"\p{Lu}"), removed(F.col("few"), "[0-9]"), removed(F.col("few"), MARKS), F.col("n_symbols"), F.length("t") - F.col("word_chars")]
    # How often the listed words that occur do so; one expression in place of one for each word.
    each = F.array_distinct("hits")
    line = F.concat(F.lit(" "), F.array_join("hits", "  "), F.lit(" "))
    shared = (
        starts.withColumn("classes", F.array(*[(value / chars).cast("double") for value in classes]))
        .withColumn("line", line)
        .withColumn("each", each)
        .withColumn("counts", F.map_from_arrays("each", F.transform("each", _times)))
    )
    # Common words as shares by language, the last share being all other words.
    words = F.greatest(F.col("n"), F.lit(1))
    for language in COMMON_WORDS:
        listed = F.array(*[F.lit(word) for word in COMMON_WORDS[language].split()])
        share = lambda word: F.coalesce(F.try_element_at("counts", word), F.lit(0.0)) / words
        shared = shared.withColumn(f"words_{language}", F.transform(listed, share))
    return shared.select(
        "row",
        F.col("n").cast("long").alias("n_words"),
        F.col("word_chars").cast("long").alias("word_chars"),
        F.col("n_symbols").cast("long").alias("n_symbols"),
        F.col("n_dup_lines").cast("long").alias("n_dup_lines"),
        repeated.cast("long").alias("n_repeat_words"),
        F.least(*[distance(_with_rest("classes"), [*CLASS_SHARES[x], 1 - sum(CLASS_SHARES[x])]) for x in CLASS_SHARES]).alias("class_distance"),
        F.greatest(*[_listed(f"words_{x}") for x in COMMON_WORDS]).alias("listed"),
        F.least(*[distance(_with_rest(f"words_{x}"), [*word_shares(x).values(), 1 - sum(word_shares(x).values())]) for x in COMMON_WORDS]).alias("word_distance"),
    )


def _times(word: Column) -> Column:
    """How often a word stands in `line`, where every word has a space on both sides."""
    spaced = F.concat(F.lit(" "), word, F.lit(" "))
    return (F.length("line") - F.length(F.replace(F.col("line"), spaced, F.lit("")))) / F.length(spaced)


def _listed(name: str) -> Column:
    """The share of all words that a language's listed words make."""
    return F.aggregate(name, F.lit(0.0), lambda total, share: total + share)


def _with_rest(name: str) -> Column:
    rest = F.lit(1.0) - _listed(name)
    return F.concat(F.col(name), F.array(F.greatest(rest, F.lit(0.0))))


def judged(
    df: DataFrame,
    min_words: int = 10,
    max_repeat_percent: int = 20,
    min_words_classes: int = 50,
    max_class_distance: float = 0.25,
    min_words_common: int = 100,
    max_word_distance: float = 0.30,
    min_listed: float = 0.10,
) -> DataFrame:
    """`measured` with the verdicts base_failed and kept."""
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words"))
    odd = ((F.col("n_words") >= min_words_classes) & (F.col("class_distance") > max_class_distance)) | (
        (F.col("n_words") >= min_words_common) & (F.col("listed") >= min_listed) & (F.col("word_distance") > max_word_distance)
    )
    return measured(df).withColumn("base_failed", failed).withColumn("kept", ~failed & ~odd)


def result(df: DataFrame) -> DataFrame:
    """The counts and verdicts per document."""
    return judged(df.select("doc_id", "text")).select(
        F.col("row.doc_id").alias("doc_id"),
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        "base_failed",
        "kept",
    )


def kept(df: DataFrame) -> DataFrame:
    """The rows of `df` that the rules keep."""
    # A filter right above would be pushed down to the scan with all its expressions spelt out;
    # passing the verdict through a one-row `inline` keeps it above the finished values.
    verdicts = judged(df).select("row", F.inline(F.array(F.struct("kept"))))
    return verdicts.where("kept").select("row.*")


def _sql() -> str:
    """The same rules for DuckDB, window by window."""
    common = sorted({word for words in COMMON_WORDS.values() for word in words.split()})

    def js(pairs: list[tuple[str, float]]) -> str:
        terms = " + ".join(
            f"(CASE WHEN {p} > 0 THEN {p} * log2(2 * {p} / ({p} + {q!r})) ELSE 0 END + {q!r} * log2(2 * {q!r} / ({p} + {q!r})))" for p, q in pairs
        )
        return f"sqrt(greatest(0, ({terms}) / 2))"

    names = ["upper", "digit", "mark", "symbol", "white"]
    classes = [
        js([*((f"c_{name}", share) for name, share in zip(names, shares)), ("c_rest", 1 - sum(shares))]) for shares in CLASS_SHARES.values()
    ]
    words, listed = [], []
    for language in COMMON_WORDS:
        shares = word_shares(language)
        listed.append(f"({' + '.join(f'w_{common.index(word)}' for word in shares)})")
        rest = f"greatest(0.0, 1.0 - {listed[-1]})"
        words.append(js([*((f"w_{common.index(word)}", share) for word, share in shares.items()), (rest, 1 - sum(shares.values()))]))
    removed_ = lambda pattern: f"(length(t) - length(regexp_replace(t, '{pattern}', '', 'g')))"
    marks = MARKS.replace("'", "''").replace(r"\"", '"')
    return rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w FROM d),
win AS (SELECT r, i, array_to_string(w[i:i+4], ' ') AS k FROM (SELECT r, w, unnest(range(1, len(w) - 3)) AS i FROM w WHERE len(w) >= 5)),
dup AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, k) AS c FROM win) WHERE c > 1),
cover AS (SELECT r, sum(least(5, coalesce(nxt - i, 5)))::BIGINT AS n_repeat_words
          FROM (SELECT r, i, lead(i) OVER (PARTITION BY r ORDER BY i) AS nxt FROM dup) GROUP BY r),
m AS (
  SELECT w.r, doc_id, len(w)::BIGINT AS n_words,
    length(array_to_string(w, ''))::BIGINT AS word_chars,
    {removed_(SYMBOLS)}::BIGINT AS n_symbols,
    (len(list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')))
      - len(list_distinct(list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')))))::BIGINT AS n_dup_lines,
    coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words,
    {removed_(r'\p{Lu}')} / greatest(length(t), 1) AS c_upper,
    {removed_('[0-9]')} / greatest(length(t), 1) AS c_digit,
    {removed_(marks)} / greatest(length(t), 1) AS c_mark,
    {removed_(SYMBOLS)} / greatest(length(t), 1) AS c_symbol,
    (length(t) - length(array_to_string(w, ''))) / greatest(length(t), 1) AS c_white,
    regexp_split_to_array(lower(t), '[^\p{{L}}]+') AS plain
  FROM w LEFT JOIN cover USING (r)),
n AS (SELECT *, greatest(0.0, 1.0 - c_upper - c_digit - c_mark - c_symbol - c_white) AS c_rest,
    {", ".join(f"len(list_filter(plain, lambda x: x = '{word}')) / greatest(n_words, 1) AS w_{k}" for k, word in enumerate(common))}
  FROM m),
s AS (SELECT *, least({", ".join(classes)}) AS class_distance, least({", ".join(words)}) AS word_distance,
    greatest({", ".join(listed)}) AS listed,
    (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AS base_failed FROM n)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND NOT (n_words >= 50 AND class_distance > 0.25) AND NOT (n_words >= 100 AND listed >= 0.10 AND word_distance > 0.30) AS kept
FROM s"""


ORACLE_SQL = _sql()
