import re
from collections import Counter

import __spark_entry__ as driver
from logloom.llm.frequent import frequent_messages
from logloom.runtime import table


def template(message):
    return re.sub("[0-9]+", "#", re.sub(r"\b[0-9a-fA-F]{8,}\b", "#", message.strip(), flags=re.A))


def test_p1_gives_frequent_messages_and_templates(spark, small):
    base = [r.message for r in table(spark, small, "entries").collect() if r.message and r.message.strip()]
    want = {("message", v) for v, n in Counter(base).items() if n * 1000 >= 5 * len(base)}
    want |= {("template", v) for v, n in Counter(map(template, base)).items() if n * 1000 >= 5 * len(base)}
    got = driver.queries()["p1_found"](spark, small)
    assert got.columns == ["kind", "value"]
    rows = [tuple(r) for r in got.collect()]
    assert len(rows) == len(set(rows)) and set(rows) == want
    assert {k for k, _ in want} == {"message", "template"}


def test_blank_and_null_messages_are_not_in_the_base(spark):
    """1 of 200 rows that say something; counting the blank ones too would lose it."""
    rows = [("rare 1",)] + [("often",)] * 199 + [(" \u3000\t",), ("",), (None,)] * 30
    got = frequent_messages(spark.createDataFrame(rows, "message string"))
    assert {tuple(r) for r in got.collect()} == {("message", "rare 1", 1), ("message", "often", 199), ("template", "rare #", 1), ("template", "often", 199)}
