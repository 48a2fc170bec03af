"""Clean texts in languages without a reference stay; numbers that pseudonyms must reach."""

import random
import re

import corpus_pipeline
import pytest
from cases import documents

from tidemark.llm import pseudonyms, quality_rules

ITALIAN = (
    "Il treno per la costa parte ogni mattina dalla stazione vecchia e attraversa colline coperte di ulivi. "
    "Mia nonna raccontava che durante la guerra i ferrovieri portavano lettere nascoste sotto il carbone. "
    "Oggi i vagoni sono nuovi, ma il paesaggio resta quello di allora: muri a secco, cipressi, qualche cane che abbaia. "
    "Quando arriviamo al mare, il capostazione saluta con la mano e i bambini corrono verso la spiaggia. "
    "Nel pomeriggio il vento cambia direzione, le barche rientrano piano e il mercato del pesce riapre le porte. "
    "La sera mangiamo pane, pomodori e acciughe davanti alla finestra aperta, poi ascoltiamo la radio fino a tardi. "
    "Nessuno di noi parla molto, perché il rumore delle onde basta a riempire tutta la casa."
)
POLISH = (
    "Pociąg nad morze odjeżdża każdego ranka ze starego dworca i mija wzgórza porośnięte sosnami. "
    "Moja babcia opowiadała, że podczas wojny kolejarze przewozili listy ukryte pod węglem. "
    "Dzisiaj wagony są nowe, lecz krajobraz pozostał taki sam: kamienne mury, topole, czasem szczekający pies. "
    "Kiedy dojeżdżamy nad zatokę, zawiadowca macha ręką, a dzieci biegną prosto na plażę. "
    "Po południu wiatr zmienia kierunek, łodzie powoli wracają i targ rybny znowu otwiera bramy. "
    "Wieczorem jemy chleb, pomidory oraz śledzie przy otwartym oknie, potem słuchamy radia do późna. "
    "Nikt z nas nie mówi wiele, ponieważ szum fal wystarcza, żeby wypełnić cały dom. "
    "Rano zbieramy muszle, suszymy sieci, naprawiamy płot i czekamy na listonosza, który zawsze przynosi dobre wiadomości. "
    "Tak mija lato, spokojne i długie, zanim nadejdą pierwsze jesienne burze."
)


def test_other_languages_are_not_judged_by_words(spark):
    rows = [(1, ITALIAN), (2, POLISH), (3, " ".join(["the of and to"] + [f"word{i} the" for i in range(120)]))]
    got = {row.doc_id: row for row in quality_rules.result(documents(spark, rows)).collect()}
    assert got[1].n_words >= 100 and got[2].n_words >= 100
    assert got[1].kept and got[2].kept
    assert not got[3].kept  # listed words, but not in a language's shares


def numbers(count, seed=1):
    pick = random.Random(seed)
    while count:
        value = f"{pick.randrange(1000):03d}-{pick.randrange(100):02d}-{pick.randrange(10_000):04d}"
        if not re.search("^(000|666|9)|-00-|-0000$", value):
            count -= 1
            yield value


def test_numbers_stay_valid_and_can_be_undone(spark):
    given = sorted(set(numbers(4000)))
    texts = documents(spark, [(i, f"no. {value};") for i, value in enumerate(given)])
    moved = pseudonyms.replaced(texts.select("doc_id", "text"))
    out = {row.row.doc_id: row.new_text for row in moved.collect()}
    found = [re.fullmatch(r"no\. (\d{3}-\d{2}-\d{4});", out[i]).group(1) for i in range(len(given))]
    assert not any(re.search("^(000|666|9)|-00-|-0000$", value) for value in found)
    assert len(set(found)) == len(given) and sum(a == b for a, b in zip(given, found)) < 5
    back = pseudonyms.replaced(spark.createDataFrame(list(out.items()), "doc_id long, text string"), undo=True)
    assert {row.row.doc_id: row.new_text for row in back.collect()} == {i: f"no. {value};" for i, value in enumerate(given)}


@pytest.mark.parametrize("value", ["41 11 11 11 11 11 11 11", "4-1-1-1-1-1-1-1-1-1-1-1-1-1-1-1", "4111 1111 1111 1111"])
def test_every_value_passes_the_hint(spark, value):
    assert re.search(pseudonyms.KINDS["card"], value) and re.search(pseudonyms.HINT, value)
    row = pseudonyms.result(documents(spark, [(1, f"card {value} .")])).first()
    assert row.n_values == 1 and value not in row.text


def test_the_session_may_name_the_key(spark):
    texts = documents(spark, [(1, "no. 219-09-9999;")])
    public = pseudonyms.result(texts).first().text
    spark.conf.set(pseudonyms.KEY_CONF, "another")
    try:
        own = pseudonyms.result(texts).first().text
    finally:
        spark.conf.unset(pseudonyms.KEY_CONF)
    assert public != own == pseudonyms.replaced(texts.select("doc_id", "text"), key="another").first().new_text


def test_values_without_three_digits_in_a_row_are_replaced(spark, sf_dir):
    values = ["8b50e17f8c1a31a2bd8daf39a7dd37ee24dcdc03", "ABCDEFABCD" * 4, "a1b2c3d4e5" * 4, "bob@-x.example.com"]
    docs = documents(spark, [(i, f"see {value} here") for i, value in enumerate(values)])
    assert all(re.search(pseudonyms.HINT, value) for value in values)
    assert all(row.n_values == 1 for row in pseudonyms.result(docs).collect())
    texts = {row.doc_id: row.text for row in corpus_pipeline.pseudonymise(spark, docs, sf_dir).collect()}
    assert not [value for i, value in enumerate(values) if value.split("@")[0] in texts[i]]
