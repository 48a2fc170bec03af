"""License scans, URL filters and pseudonyms."""

import re

import duckdb
import pytest
import xxhash
from cases import TEXTS, documents
from hypothesis import given
from hypothesis import strategies as st

from tidemark.llm import licenses, pseudonyms, url_filters


def by_sql(sql, **tables):
    con = duckdb.connect()
    for name, frame in tables.items():
        con.register(name, frame.toPandas().astype(object).where(lambda x: x.notna(), None))
        con.execute(f"CREATE TABLE t_{name} AS SELECT * FROM {name}")
        con.unregister(name)
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM t_{name}")
    cursor = con.execute(sql)
    names = [x[0] for x in cursor.description]
    return names, cursor.fetchall()


LINES = [
    (20, "Intro.\nReleased under the MIT License.\nCC BY cc by CC-BY, all Rights reserved. General public license"),
    (21, "This work is licensed under the GNU General Public License, version 3."),
    (22, "licensed under apache license version 2.0"),
    (23, "the released license under MIT and so on and on"),
    (24, "cc by cc by cc\nby"),
    (25, "All K rights reserved İ"),
]


def test_license_scan_equals_sql(spark):
    docs = documents(spark, TEXTS + LINES)
    got = licenses.result(docs)
    # A pandas round trip would make ids floats; they are compared as numbers.
    names, want = by_sql(licenses.ORACLE_SQL, documents=docs.select("text", "doc_id").withColumn("doc_id", docs.doc_id.cast("string")))
    rows = [tuple(row) for row in got.select(*names).collect()]
    assert sorted(((None if r[0] is None else str(r[0]), *r[1:]) for r in rows), key=repr) == sorted(want, key=repr)
    by_id = {row.doc_id: row for row in got.collect()}
    assert by_id[20].labels == "cc-by,gpl,mit,reserved" and by_id[20].n_base == 5 and by_id[20].score == 1.0
    assert by_id[22].labels == "apache-2.0" and by_id[24].n_base == 3
    assert licenses.result(documents(spark, [])).count() == 0


@pytest.mark.parametrize("threshold", [0.4, 0.7, 1.0])
def test_filters_lose_no_match(spark, threshold):
    templates = [("a", "alpha beta gamma delta"), ("b", "beta gamma"), ("c", "omega"), ("d", "alpha omega one two three four five")]
    lines = ["alpha beta", "beta gamma omega", "omega omega", "one two three four omega x y", "alpha delta gamma beta", ""]
    rows = licenses.scanned(documents(spark, list(enumerate(lines))), templates, threshold).collect()
    for row in rows:
        words = set(re.findall("[a-z]+", lines[row.doc_id]))
        want = sorted(label for label, text in templates if len(words & set(text.split())) / len(text.split()) >= threshold - 1e-9)
        assert row.labels == ",".join(want)


URLS = [
    (1, "https://example.net/en/1"),
    (2, "https://EXAMPLE.net/de/1"),
    (3, "http://a.b.example.com/de/x?y=/en/"),
    (4, "http://notexample.net"),
    (5, "http://example.org/fr/"),
    (6, None),
    (7, ""),
    (8, "no scheme/here"),
    (9, "://net/"),
    (10, "http://m.casino-win.example.com/en/1"),
    (11, "http://x.org/adclick/1"),
    (12, "http://x.org/ADCLICK/1"),
    (13, "http://x.org/xadclick/1"),
    (14, "http://best-casino.x.org/"),
    (15, "http://x.org/file.exe"),
    (16, "http://a://net/b#c"),
    (16, "http://a://net/b#c"),
    (None, "http://casino-win.example.org/fr/1\n"),
    (17, "http://net:80/"),
    (18, "http://x.org/popunder?x"),
]


def test_url_filters_equal_sql(spark):
    pages = spark.createDataFrame([(i, url, "h", "k", 1) for i, url in URLS], "page_id long, url string, html string, key string, count int")
    names, want = by_sql(url_filters.ORACLE_SQL, pages=pages.select(pages.page_id.cast("string").alias("page_id"), "url"))
    rows = [tuple(row) for row in url_filters.result(pages).select(*names).collect()]
    assert sorted(((None if r[0] is None else str(r[0]), *r[1:]) for r in rows), key=repr) == sorted(want, key=repr)
    found = {row.page_id: (row.verdict, row.rule, row.pattern) for row in url_filters.result(pages).collect()}
    assert found[1] == ("allow", "example.net/en/", None) and found[2] == ("block", "net/", None)
    assert found[10] == ("block", None, "||casino-win.") and found[13] == ("allow", None, None)
    assert url_filters.result(pages.limit(0)).count() == 0


def test_tokens_must_be_whole():
    assert url_filters.literal_tokens("||casino-win.") == ["casino", "win"]
    assert url_filters.literal_tokens("*ads*") == [] and url_filters.literal_tokens("ads") == []
    assert url_filters.literal_tokens("@@/click*x/y/") == ["y"]


VALUES = (
    "mail the.72@mail3.example.com, card 4111 1111 1111 1111 or 4111111111111112, +1 (136) 555-7479, (212) 555-0199, "
    "169.122.221.182 and 999.1.1.1 on 2024-02-29 not 2023-02-29, 123-45-6789, 9233A8ECF7C5B09FE5949719B6B82BC439E9329B"
)


def test_pseudonyms_keep_format_and_can_be_undone(spark):
    docs = documents(spark, [*TEXTS, (50, VALUES), (51, "again 4111111111111111")])
    made = pseudonyms.replaced(docs)
    rows = {(row.row.doc_id, row.row.text): row for row in made.collect()}
    new = rows[(50, VALUES)]
    assert list(new.found) == ["email", "card", "phone", "phone", "ip", "date", "ssn", "hex"]
    shape = lambda text: re.sub("[A-Z]", "A", re.sub("[a-z]", "a", re.sub("[0-9]+", "9", text)))
    assert shape(new.new_text.split("9233")[0].rsplit(" ", 1)[0]).count("9") == shape(VALUES.rsplit(" ", 1)[0]).count("9")
    for gone in ("the.72@", "4111 1111", "555-7479", "169.122", "2024-02-29", "123-45-6789", "9233A8"):
        assert gone not in new.new_text
    for left in ("4111111111111112", "999.1.1.1", "2023-02-29", "@mail3.example.com"):
        assert left in new.new_text
    card = re.search(r"card ([0-9 ]+) or", new.new_text)[1].replace(" ", "")
    assert card in rows[(51, "again 4111111111111111")].new_text  # equal values stay linked
    digits = [int(d) for d in reversed(card)]
    assert sum(d if i % 2 == 0 else sum(divmod(2 * d, 10)) for i, d in enumerate(digits)) % 10 == 0
    for doc_id, text in TEXTS:
        if text is None or not re.search(pseudonyms.HINT, text):
            assert rows[(doc_id, text)].new_text == text
    back = pseudonyms.replaced(made.selectExpr("row.doc_id AS doc_id", "new_text AS text"), undo=True).collect()
    assert {(row.row.doc_id, row.new_text) for row in back} == set(rows)
    kept = pseudonyms.pseudonymised(docs)
    assert kept.columns == docs.columns
    assert all(row.n_chars == len(row.text) for row in kept.collect() if row.doc_id == 50)
    assert pseudonyms.result(documents(spark, [])).count() == 0


def network(symbols, sizes, kind, key=pseudonyms.KEY):
    """The same permutation, step by step."""
    import hashlib

    half = len(symbols) // 2
    parts, radix = [list(symbols[:half]), list(symbols[half:])], [sizes[:half], sizes[half:]]
    for round_ in range(1, pseudonyms.ROUNDS + 1):
        side = (round_ + 1) % 2
        text = f"{key}:{kind}:{round_}:{','.join(map(str, parts[1 - side]))}"
        digest = hashlib.sha256(text.encode()).hexdigest().encode()
        for i, size in enumerate(radix[side]):
            value = xxhash.xxh64_intdigest(i.to_bytes(4, "little"), xxhash.xxh64_intdigest(digest, 42))
            value = value - 2**64 if value >= 2**63 else value
            parts[side][i] = (parts[side][i] + value % size) % size
    return parts[0] + parts[1]


def test_addresses_against_a_plain_network(spark):
    found = pseudonyms.replaced(documents(spark, [(1, "10.20.30.40"), (2, "x 255.255.255.255")])).collect()
    got = sorted(row.new_text for row in found)
    want = sorted([".".join(map(str, network([10, 20, 30, 40], [256] * 4, "ip"))), "x " + ".".join(map(str, network([255] * 4, [256] * 4, "ip")))])
    assert got == want


@given(st.lists(st.integers(0, 9), min_size=2, max_size=12))
def test_network_is_a_permutation_on_small_formats(symbols):
    sizes = [10] * len(symbols)
    out = network(symbols, sizes, "x")
    assert len(out) == len(symbols) and all(0 <= v < 10 for v in out)
