"""Odd documents that every text operator must take, and plain re-implementations."""

import zlib

SCHEMA = (
    "doc_id long, text string, lang string, source string, n_chars long, row int, t string, "
    "w string, fp long, word string, key string, count long, text_key string"
)
LONG = " ".join(f"word{i % 977} of the {i}" for i in range(40_000))
TEXTS = [
    (1, "The cat and the dog are on the mat. It is raining.\nThe cat and the dog are on the mat."),
    (2, "The cat and the dog are on the mat. It is raining.\nThe cat and the dog are on the mat."),
    (2, "The cat and the dog are on the mat. It is raining.\nThe cat and the dog are on the mat."),
    (3, None),
    (4, ""),
    (5, " \n\t\r\x0b "),
    (6, "one"),
    (7, "ONE two"),
    (8, "naïve café ÜBER straße 漢字 😀 K İ \u00a0nbsp"),
    (9, LONG),
    (None, "no id at all here"),
    (10, "a a a a a a a a a a a a a a a a"),
    (11, "### $$$ %%% &&& ||| <<< >>> *** ### $$$ %%% &&&"),
    (11, "another text under the same id"),
]


def documents(spark, rows=TEXTS):
    """A table with clashing extra columns."""
    full = [(i, text, "en", None, len(text or ""), 1, "x", "y", 7, "w", "k", 3, "z") for i, text in rows]
    return spark.createDataFrame(full, SCHEMA)


def low(text: str | None) -> str:
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def remainder(doc_id, modulus: int) -> int:
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % modulus
