from itertools import product

import __spark_entry__ as driver
from logloom.llm.leaks import Passages, words
from logloom.runtime import table

ITEM = "One two three four five six seven eight nine ten eleven twelve thirteen fourteen."


def holds(text):
    return bool(Passages([(1, ITEM)]).search(text))


def test_words():
    assert words("Fo\u00adllow-\n up A-b m\u00b2 \uff21\u0441e_x r\u0435s\u00e9") == ["followup", "a", "b", "m", "ace", "x", "res\u00e9"]


def test_passages():
    assert holds("x y z " + ITEM) and holds(ITEM.upper().replace(" ", ",\n - "))
    assert holds("two three four five six seven eight nine ten eleven twelve thirteen")
    assert not holds("two three four five six seven eight nine ten eleven twelve 13")
    assert holds("two three four five sev six " + "two three four five six sev-\nen eight nine t\u0435n eleven twelve thirteen and")


def test_p7_agrees_with_trying_every_pair(spark, small):
    grams = lambda own: {tuple(own[i : i + 12]) for i in range(len(own) - 11)}
    docs = {r.doc_id: grams(words(r.text)) for r in table(spark, small, "documents").collect() if r.text}
    items = {r.item_id: grams(words(r.text)) for r in table(spark, small, "eval_items").collect() if r.text}
    want = {(d, i) for d, i in product(docs, items) if docs[d] & items[i]}
    got = driver.queries()["p7_found"](spark, small)
    assert got.dtypes == [("doc_id", "bigint"), ("item_id", "bigint")]
    rows = [tuple(r) for r in got.collect()]
    assert want and len(rows) == len(want) and set(rows) == want


def test_nulls_repeats_clashing_names_blocks_and_nothing(spark):
    from logloom.llm.leaks import leaks

    other = ITEM.replace("two", "zwei")
    items = spark.createDataFrame([(1, ITEM), (1, ITEM), (2, other), (None, ITEM), (3, None), (4, ""), (5, "too short")], "item_id bigint, text string")
    long = "filler words " * 100_000
    docs = [(1, long + ITEM + long, 7), (1, long + ITEM + long, 7), (None, ITEM, 7), (2, None, 7), (3, "", None), (4, ITEM + " and " + other, 7), (5, "nothing of it", 7)]
    documents = spark.createDataFrame(docs, "doc_id bigint, text string, item_id bigint")
    want = [(1, 1), (1, 2), (4, 1), (4, 2)]
    for most in (1, 1 << 24):
        assert sorted(map(tuple, leaks(documents, items, most_chars=most).collect())) == want
    assert leaks(documents.where("false"), items).count() == 0
    assert leaks(documents, items.where("false")).count() == 0
