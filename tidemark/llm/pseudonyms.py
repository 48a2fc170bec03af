"""Format-preserving pseudonyms of personal values, by a keyed Feistel network.

Values are found by pattern, validated (check digit, calendar, octets), and their digits or
letters are permuted within the same format: a card number becomes another number of the same
length with a right check digit, a date another date. The permutation depends on the key, the
kind and the value alone, so equal values stay linked in all documents, however they are
separated in the text, and different ones stay apart.

A value is an array of symbols with an alphabet size each (10 for a digit, 16 or 26 for a
letter, 256 for an octet). The network splits it into two halves; each round adds keyed hashes
of one half to the other, modulo the alphabet sizes. A round can be undone, so the whole is a
permutation of the format. Where a format has numbers that are never issued (ssn), the network is
applied again until the number is one that is; this walk along a cycle of the permutation leads from
each valid number to another one and back. All work is within the row, in DataFrame functions.

Where a value begins and ends is told by its form alone, never by its check digits, so that a pseudonym
is found again where its value was. A card is a run of 13 to 19 digits, or four groups of four, or any
other grouping; a number beside the first two is no part of them. Dates with slashes have the month
first unless that is over 12; those with the day first are a format of their own (`day`), as no other
reading may arise. Country codes of phones and IBANs and domains of e-mails stay.

Edge cases: null stays null; values that fail their validation stay as they are; a text without
values comes back unchanged; repeated rows, empty tables and further columns are passed through.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The key where the session names none; it is public, so set `spark.tidemark.pseudonymKey`.
KEY = "tidemark-demo-key"
KEY_CONF = "spark.tidemark.pseudonymKey"
ROUNDS = 8
#: Steps of a walk; one in nine numbers, two in five days are not valid, so 40 in a row do not happen.
WALK = 40

#: Lengths of account numbers (IBAN) by country.
_IBAN = {
    15: "NO", 16: "BE", 18: "DK FI FO GL NL", 19: "MK SI", 20: "AT BA EE KZ LT LU XK", 21: "CH HR LI LV", 22: "BG DE GB GE IE ME RS",
    23: "AE GI IL", 24: "AD CZ ES MD PK RO SA SE SK TN", 25: "PT", 26: "IS TR", 27: "FR GR IT MC SM", 28: "AL CY HU LB PL", 29: "BR",
    30: "KW", 31: "MT",
}


def _iban(length: int) -> str:
    """An account number of a length, in one or in groups of four."""
    fours, rest = divmod(length - 4, 4)
    last = f" ?[A-Z0-9]{{{rest}}}" if rest else ""
    return f"(?:{_IBAN[length].replace(' ', '|')})[0-9]{{2}}(?: ?[A-Z0-9]{{4}}){{{fours}}}{last}"


_HEXES = "|".join(f"[0-9{letters}]{{{size}}}" for letters in ("a-f", "A-F") for size in (32, 40, 64))
_GROUP = "[0-9A-Fa-f]{1,4}"
#: Country codes of phones; the others have three digits.
_COUNTRY = "1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|[2-9][0-9]{2}"
_FOURS = "(?:[0-9]{4}[ -]){3}[0-9]{4}"

# One pattern per kind; the first kind whose pattern is found at a place wins.
KINDS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+",
    "hex": rf"(?<![0-9A-Za-z])(?:{_HEXES})(?![0-9A-Za-z])",
    "iban": rf"(?<![0-9A-Za-z])(?:{'|'.join(map(_iban, _IBAN))})(?![0-9A-Za-z])",
    "ipv6": rf"(?<![0-9A-Za-z:.])(?:(?:{_GROUP}:){{7}}{_GROUP}|(?:{_GROUP}:){{1,6}}(?::{_GROUP}){{1,6}})(?![0-9A-Za-z:]|\.[0-9]{{1,3}}\.)",
    "phone": r"(?<![0-9A-Za-z+.-])(?:\+1[ .-]?)?(?:\([0-9]{3}\)|[0-9]{3})[ .-]?[0-9]{3}[ .-][0-9]{4}(?![0-9-]|\.[0-9])",
    "tel": r"(?<![0-9A-Za-z+.-])\+[1-9](?:[ .()-]{0,2}[0-9]){7,14}(?![0-9A-Za-z-])",
    "ip": r"(?<![0-9.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?![0-9]|\.[0-9])",
    "date": r"(?<![0-9-])[0-9]{4}-[0-9]{2}-[0-9]{2}(?![0-9-])",
    "day": r"(?<![0-9/.-])(?:[0-9]{4}/[0-9]{2}/[0-9]{2}|[0-9]{4}\.[0-9]{2}\.[0-9]{2}|[0-9]{2}/[0-9]{2}/[0-9]{4}|[0-9]{2}\.[0-9]{2}\.[0-9]{4}|[0-9]{2}-[0-9]{2}-[0-9]{4})(?![0-9/-]|\.[0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "card": rf"(?<![0-9A-Za-z])(?:[0-9]{{13,19}}|{_FOURS}(?![ -][0-9]{{3}}(?![0-9A-Za-z]))|(?![0-9]{{13}})[0-9](?:(?:[ -](?!{_FOURS}(?![0-9])))?(?![0-9]{{13}})[0-9]){{12,18}})(?![0-9A-Za-z])",
}
ANY = "|".join(f"(?:{pattern})" for pattern in KINDS.values())
#: A cheap look that every text with a value passes. A hex key need not have three digits in a row.
HINT = r"@[A-Za-z0-9-]|[0-9][ -]?[0-9][ -]?[0-9]|[0-9]\.[0-9]|[0-9a-f]{32}|[0-9A-F]{32}|[A-Z]{2}[0-9]{2} ?[A-Z0-9]{4}|:[0-9A-Fa-f]{0,4}:|\+[1-9]"
#: Days of the 400-year cycle of the calendar, from 1800-01-01; 146097 = 189 * 773.
FIRST_DAY, CYCLE = "1800-01-01", (189, 773)


def feistel(symbols: str, sizes: str, kind: str, key: str = KEY, undo: bool = False) -> str:
    """SQL for the permuted array of `symbols`, each below its entry of `sizes`.

    The first half of the array is shifted in odd rounds, the second in even ones; `undo` runs
    the rounds backwards with the shifts taken away.
    """
    quoted = key.replace("\\", "\\\\").replace("'", "\\'")
    half = f"CAST(size({symbols}) DIV 2 AS INT)"
    sign = "-" if undo else "+"

    def moved(part: str, other: str, first: str) -> str:
        text = f"concat_ws(':', '{quoted}', {kind}, CAST(round AS STRING), array_join(transform(x.{other}, s -> CAST(s AS STRING)), ','))"
        size = f"{sizes}[i + {first}]"
        return f"transform(x.{part}, (v, i) -> CAST(pmod(v {sign} pmod(xxhash64(sha2({text}, 256), i), {size}), {size}) AS INT))"

    rounds = f"sequence({ROUNDS}, 1)" if undo else f"sequence(1, {ROUNDS})"
    return f"""aggregate({rounds},
        named_struct('l', slice({symbols}, 1, {half}), 'r', slice({symbols}, {half} + 1, size({symbols}))),
        (x, round) -> IF(round % 2 = 1,
            named_struct('l', {moved("l", "r", "0")}, 'r', x.r),
            named_struct('l', x.l, 'r', {moved("r", "l", half)})),
        x -> concat(x.l, x.r))"""


#: SQL that tells whether the symbols `y` make a valid ssn, and a date that only the day can begin.
ISSUED = """NOT (y[0] = 9 OR (y[0] = 0 AND y[1] = 0 AND y[2] = 0) OR (y[0] = 6 AND y[1] = 6 AND y[2] = 6)
        OR (y[3] = 0 AND y[4] = 0) OR (y[5] = 0 AND y[6] = 0 AND y[7] = 0 AND y[8] = 0))"""
LATE = f"dayofmonth(date_add(DATE'{FIRST_DAY}', y[0] * {CYCLE[1]} + y[1])) > 12"


def walked(symbols: str, sizes: str, kind: str, key: str, undo: bool, issued: str = ISSUED) -> str:
    """SQL for the permuted array of symbols, moved on until they are a valid value."""
    return f"""aggregate(sequence(1, {WALK}), {feistel(symbols, sizes, kind, key, undo)},
        (y, step) -> IF({issued}, y, {feistel("y", sizes, kind, key, undo)}))"""


def luhn(digits: str) -> str:
    """SQL for the check sum of a digit array; it is a multiple of ten for valid numbers."""
    doubled = f"transform(reverse({digits}), (d, i) -> IF(i % 2 = 0, d, IF(d > 4, 2 * d - 9, 2 * d)))"
    return f"aggregate({doubled}, 0, (a, b) -> a + b)"


def _refilled(value: str, symbols: str) -> str:
    """SQL for `value` with its letters and digits replaced in turn by `symbols`."""
    step = lambda char: f"named_struct('out', concat(x.out, {char}), 'i', x.i + 1)"
    return f"""aggregate(regexp_extract_all({value}, '(?s).', 0), named_struct('out', '', 'i', 0),
        (x, c) -> CASE
            WHEN c RLIKE '[0-9]' THEN {step(f"CAST({symbols}[x.i] AS STRING)")}
            WHEN c RLIKE '[a-z]' THEN {step(f"chr(97 + {symbols}[x.i])")}
            WHEN c RLIKE '[A-Z]' THEN {step(f"chr(65 + {symbols}[x.i])")}
            ELSE named_struct('out', concat(x.out, c), 'i', x.i) END,
        x -> x.out)"""


_DIGITS = "transform(regexp_extract_all(m.v, '[0-9]', 0), c -> CAST(c AS INT))"
_TENS = "array_repeat(10, {})"
_LOCAL = "regexp_extract_all(substring_index(m.v, '@', 1), '[A-Za-z0-9]', 0)"
_ISO = """CASE WHEN m.v RLIKE '^[0-9]{4}' THEN regexp_replace(m.v, '[/.]', '-')
    WHEN m.kind = 'date' AND substr(m.v, 3, 1) = '/' THEN concat(substr(m.v, 7, 4), '-', substr(m.v, 1, 2), '-', substr(m.v, 4, 2))
    ELSE concat(substr(m.v, 7, 4), '-', substr(m.v, 4, 2), '-', substr(m.v, 1, 2)) END"""
_DAY = f"datediff(try_cast({_ISO} AS DATE), DATE'{FIRST_DAY}')"
_NUMBER = "regexp_replace(m.v, '[^0-9]', '')"
_CODE = f"regexp_extract({_NUMBER}, '^({_COUNTRY})', 1)"
_CHARS = "regexp_extract_all(m.v, '[0-9A-Za-z]', 0)"
_SPELT = f"transform({_CHARS}, c -> IF(c RLIKE '[0-9]', CAST(c AS INT), ascii(lower(c)) - 97))"


def mod97(values: str) -> str:
    """SQL for the remainder by 97 of the number that 0 to 9, and 10 to 35 for letters, spell."""
    return f"aggregate({values}, 0, (a, b) -> (a * IF(b > 9, 100, 10) + b) % 97)"


_LETTERS = f"transform({_CHARS}, c -> IF(c RLIKE '[0-9]', CAST(c AS INT), ascii(c) - 55))"
_HEX = "0123456789abcdef"

#: Per kind: SQL for its symbols, their alphabet sizes and whether the value `m.v` is valid.
_SYMBOLS = {
    "email": (
        f"transform({_LOCAL}, c -> CASE WHEN c RLIKE '[0-9]' THEN CAST(c AS INT) ELSE ascii(lower(c)) - 97 END)",
        f"transform({_LOCAL}, c -> IF(c RLIKE '[0-9]', 10, 26))",
        f"size({_LOCAL}) > 0",
    ),
    "hex": (
        f"transform(regexp_extract_all(lower(m.v), '.', 0), c -> instr('{_HEX}', c) - 1)",
        "array_repeat(16, length(m.v))",
        "true",
    ),
    # The check digits follow from the others.
    "iban": (
        f"slice({_SPELT}, 5, size({_CHARS}) - 4)",
        f"transform(slice({_CHARS}, 5, size({_CHARS}) - 4), c -> IF(c RLIKE '[0-9]', 10, 26))",
        f"{mod97(f'concat(slice({_LETTERS}, 5, size({_CHARS}) - 4), slice({_LETTERS}, 1, 4))')} = 1 AND CAST(substr(m.v, 3, 2) AS INT) BETWEEN 2 AND 98",
    ),
    "ipv6": (_SPELT, f"transform({_CHARS}, c -> IF(c RLIKE '[0-9]', 10, 6))", "size(split(m.v, ':')) <= 8"),
    "tel": (f"slice({_DIGITS}, length({_CODE}) + 1, size({_DIGITS}))", _TENS.format(f"(size({_DIGITS}) - length({_CODE}))"), "true"),
    "phone": (f"slice({_DIGITS}, -10, 10)", _TENS.format(10), "true"),
    "ip": (
        "transform(split(m.v, '[.]'), c -> CAST(c AS INT))",
        "array_repeat(256, 4)",
        "forall(split(m.v, '[.]'), c -> CAST(c AS INT) < 256)",
    ),
    "date": (
        f"array(CAST({_DAY} DIV {CYCLE[1]} AS INT), CAST({_DAY} % {CYCLE[1]} AS INT))",
        f"array({CYCLE[0]}, {CYCLE[1]})",
        f"coalesce({_DAY} BETWEEN 0 AND {CYCLE[0] * CYCLE[1] - 1}, false)",
    ),
    "day": (
        f"array(CAST({_DAY} DIV {CYCLE[1]} AS INT), CAST({_DAY} % {CYCLE[1]} AS INT))",
        f"array({CYCLE[0]}, {CYCLE[1]})",
        f"coalesce({_DAY} BETWEEN 0 AND {CYCLE[0] * CYCLE[1] - 1}, false)",
    ),
    "ssn": (_DIGITS, _TENS.format(9), "NOT m.v RLIKE '^(000|666|9)|-00-|-0000$'"),
    # The check digit follows from the others.
    "card": (f"slice({_DIGITS}, 1, size({_DIGITS}) - 1)", _TENS.format(f"(size({_DIGITS}) - 1)"), f"{luhn(_DIGITS)} % 10 = 0"),
}
_NEW_DAY = f"CAST(date_add(DATE'{FIRST_DAY}', m.new[0] * {CYCLE[1]} + m.new[1]) AS STRING)"
_NEW_LETTERS = f"transform(m.new, (s, i) -> IF({_CHARS}[i + 4] RLIKE '[0-9]', s, s + 10))"
_NEW_CHECK = f"(98 - {mod97(f'concat({_NEW_LETTERS}, slice({_LETTERS}, 1, 2), array(0, 0))')})"
_OUT = {
    "email": f"concat({_refilled("substring_index(m.v, '@', 1)", 'm.new')}, substr(m.v, instr(m.v, '@')))",
    "hex": f"IF(m.v RLIKE '[A-F]', upper({{hex}}), {{hex}})".format(
        hex=f"array_join(transform(m.new, s -> substr('{_HEX}', s + 1, 1)), '')"
    ),
    "iban": _refilled("m.v", f"concat(slice({_SPELT}, 1, 2), array(CAST({_NEW_CHECK} DIV 10 AS INT), {_NEW_CHECK} % 10), m.new)"),
    "ipv6": _refilled("m.v", "m.new"),
    "tel": _refilled("m.v", f"concat(slice({_DIGITS}, 1, length({_CODE})), m.new)"),
    "phone": _refilled("m.v", "IF(m.v LIKE '+%', concat(array(1), m.new), m.new)"),
    "ip": "array_join(transform(m.new, s -> CAST(s AS STRING)), '.')",
    "date": f"""CASE WHEN m.v RLIKE '^[0-9]{{4}}' THEN replace({_NEW_DAY}, '-', substr(m.v, 5, 1))
        WHEN substr(m.v, 3, 1) = '/' THEN concat_ws('/', substr({_NEW_DAY}, 6, 2), substr({_NEW_DAY}, 9, 2), substr({_NEW_DAY}, 1, 4))
        ELSE concat_ws(substr(m.v, 3, 1), substr({_NEW_DAY}, 9, 2), substr({_NEW_DAY}, 6, 2), substr({_NEW_DAY}, 1, 4)) END""",
    "day": f"concat_ws('/', substr({_NEW_DAY}, 9, 2), substr({_NEW_DAY}, 6, 2), substr({_NEW_DAY}, 1, 4))",
    "ssn": _refilled("m.v", "m.new"),
    "card": _refilled("m.v", f"concat(m.new, array(pmod(-{luhn('concat(m.new, array(0))')}, 10)))"),
}


def _case(choices: dict[str, str]) -> str:
    return "CASE m.kind " + " ".join(f"WHEN '{kind}' THEN {sql}" for kind, sql in choices.items()) + " END"


def _kind() -> str:
    return """CASE WHEN contains(m, '@') THEN 'email'
        WHEN m RLIKE '^[0-9A-Fa-f]{32,}$' THEN 'hex'
        WHEN contains(m, ':') THEN 'ipv6'
        WHEN m RLIKE '^[A-Z]' THEN 'iban'
        WHEN m RLIKE '^([+]1[ .-]?)?([(][0-9]{3}[)]|[0-9]{3})[ .-]?[0-9]{3}[ .-][0-9]{4}$' THEN 'phone'
        WHEN regexp_replace(m, '[ .()-]', '') RLIKE '^[+]1[0-9]{10}$' THEN 'phone'
        WHEN m LIKE '+%' THEN 'tel'
        WHEN m RLIKE '^([0-9]{4}[-/.][0-9]{2}[-/.][0-9]{2}|[0-9]{2}[-.][0-9]{2}[-.][0-9]{4}|(0[0-9]|1[0-2])/[0-9]{2}/[0-9]{4})$' THEN 'date'
        WHEN m RLIKE '^[0-9]{2}/[0-9]{2}/[0-9]{4}$' THEN 'day'
        WHEN contains(m, '.') THEN 'ip'
        WHEN m RLIKE '^[0-9]{3}-[0-9]{2}-[0-9]{4}$' THEN 'ssn'
        ELSE 'card' END"""


def replaced(df: DataFrame, text: str = "text", key: str | None = None, undo: bool = False) -> DataFrame:
    """Every row as `row` (all columns of `df`), its `new_text` and `found`, the values by kind.

    `found` has the kinds of the replaced values in their order. `undo` turns pseudonyms back. The
    key is the session's (KEY_CONF) unless one is given.
    """
    key = key or df.sparkSession.conf.get(KEY_CONF, None) or KEY
    pattern = F.lit(ANY)
    rows = df.select(F.struct(*df.columns).alias("row"), F.col(text).alias("t"))
    values = rows.withColumn(
        "values",
        F.when(F.col("t").rlike(HINT), F.regexp_extract_all("t", pattern, F.lit(0))).otherwise(F.array().cast("array<string>")),
    )
    named = values.withColumn("m1", F.expr(f"transform(values, m -> named_struct('v', m, 'kind', {_kind()}))"))
    valid = named.withColumn(
        "m2",
        F.expr(f"transform(m1, m -> named_struct('v', m.v, 'kind', m.kind, 'ok', {_case({k: x[2] for k, x in _SYMBOLS.items()})}))"),
    )
    parts = valid.withColumn(
        "m3",
        F.expr(
            f"""transform(m2, m -> named_struct('v', m.v, 'kind', m.kind, 'ok', m.ok,
                'symbols', IF(m.ok, {_case({k: x[0] for k, x in _SYMBOLS.items()})}, NULL),
                'sizes', IF(m.ok, {_case({k: x[1] for k, x in _SYMBOLS.items()})}, NULL)))"""
        ),
    )
    moved = parts.withColumn(
        "m4",
        F.expr(
            f"""transform(m3, m -> named_struct('v', m.v, 'kind', m.kind, 'ok', m.ok,
                'new', IF(m.ok, CASE m.kind WHEN 'ssn' THEN {walked("m.symbols", "m.sizes", "m.kind", key, undo)}
                    WHEN 'day' THEN {walked("m.symbols", "m.sizes", "m.kind", key, undo, LATE)}
                    ELSE {feistel("m.symbols", "m.sizes", "m.kind", key, undo)} END, NULL)))"""
        ),
    )
    spelt = moved.withColumn("m5", F.expr(f"transform(m4, m -> IF(m.ok, {_case(_OUT)}, m.v))"))
    between = F.split("t", ANY, -1)
    whole = F.array_join(F.zip_with(between, "m5", lambda part, value: F.concat(part, F.coalesce(value, F.lit("")))), "")
    return spelt.select(
        "row",
        F.when(F.size("values") > 0, whole).otherwise(F.col("t")).alias("new_text"),
        F.expr("transform(filter(m4, m -> m.ok), m -> m.kind)").alias("found"),
    )


def result(df: DataFrame) -> DataFrame:
    """doc_id, the text with pseudonyms, and how many values were replaced."""
    return replaced(df.select("doc_id", "text")).select(
        F.col("row.doc_id").alias("doc_id"),
        F.col("new_text").alias("text"),
        F.size("found").cast("long").alias("n_values"),
        F.array_join(F.array_sort(F.array_distinct("found")), ",").alias("kinds"),
    )


def pseudonymised(df: DataFrame, key: str | None = None) -> DataFrame:
    """The rows of `df` with the new text, and n_chars to match where `df` has it."""
    columns = [
        F.col("new_text").alias("text")
        if name == "text"
        else F.when(F.size("found") > 0, F.length("new_text").cast(df.schema[name].dataType)).otherwise(F.col(f"row.{name}")).alias(name)
        if name == "n_chars"
        else F.col(f"row.`{name}`").alias(name)
        for name in df.columns
    ]
    return replaced(df, key=key).select(*columns)
