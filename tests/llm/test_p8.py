import random

import pytest

import __spark_entry__ as driver
from logloom.llm.looks import Classes, Rewriter, looks, rewrites
from logloom.llm.lookalikes import look_alikes


@pytest.mark.parametrize(
    ("a", "b"),
    [("caf\u00e9", "cafe\u0301"), ("file 12", "\ufb01le\u00a0\uff11\uff12"), ("no\u200bw\ufeff", "now"), ("a\tb", "a\u2009b"), ("paper", "\u0440\u0430\u0440\u0435r"), ("NO", "\u039d\u039f"), ("\u0451", "e\u0308"), ("1-2/3", "1\u22122\u22153"), ("\u00b5m", "\u03bcm"), ("\u30ac", "\uff76\uff9e"), ("K\u00c5", "\u212a\u212b")],
)
def test_same_look(a, b):
    assert looks(a) == looks(b)


@pytest.mark.parametrize(("a", "b"), [("m2", "m\u00b2"), ("x1", "x\u2081"), ("resume", "r\u00e9sum\u00e9"), ("a", "A"), ("a b", "ab"), ("a.", "a;"), ("a b", "a  b"), ("O", "0"), ("l", "1"), ("a b", "a\nb")])
def test_other_look(a, b):
    assert looks(a) != looks(b)


def test_pairs(spark):
    rows = [(1, "a b"), (2, "a\u00a0b"), (3, "a b"), (4, "ab"), (5, ""), (6, None), (7, "\u0430 b")]
    got = look_alikes(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert sorted(map(tuple, got)) == [(1, 2), (1, 7), (2, 3), (2, 7), (3, 7)]


def test_p8_gives_pairs_once(spark):
    got = driver.queries()["p8_found"](spark, "/root/testdata/sf0.01")
    assert got.dtypes == [("doc_id_a", "bigint"), ("doc_id_b", "bigint")]
    rows = [tuple(r) for r in got.collect()]
    assert rows and len(rows) == len(set(rows)) and all(a < b for a, b in rows)


def test_classes_are_transitive():
    found = Classes([("a", "b"), ("c", "d"), ("b", "d"), ("x", "yz")]).members()
    assert sorted(map(sorted, found)) == [["a", "b", "c", "d"], ["x", "yz"]]


def test_frequent_members_stand_for_their_class():
    changes = rewrites({ord("\u0430"): 5, ord("a"): 2})
    assert changes["a"] == "\u0430" and "\u0430" not in changes and changes["\uff41"] == "\u0430"
    # strings are spelt out by the representatives of their characters
    assert rewrites({ord("\u0456"): 9})["\ufb01"] == "f\u0456"


def test_any_counts_give_the_same_classes():
    rng, letters = random.Random(8), "ab\r\n\t\uff46\ufb01\u0435e\u0301\u00e9 \u00a0\u200b\uff9e\uff76\u30abi\u0456f"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(1, 6))) for _ in range(4000)]
    other = Rewriter(rewrites({ord(c): rng.randint(0, 99) for c in letters}))
    pairs = {(looks(t), other(t)) for t in texts}
    assert len(pairs) == len({a for a, _ in pairs}) == len({b for _, b in pairs})


def test_nulls_repeats_clashing_names_and_nothing(spark):
    long = "long text " * 20000
    rows = [(None, "a b", 1), (1, "a\u00a0b", 2), (1, "a\u00a0b", 2), (2, "a b", None), (3, long, 3), (4, long.replace("o", "\u043e"), 4), (5, None, 5), (6, "", 6), (7, "\u200b", 7), (8, "\u200b\u200b", 8)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, form int").withColumnRenamed("x", "stored")
    assert sorted(map(tuple, look_alikes(df).collect())) == [(1, 2), (3, 4), (7, 8)]
    assert look_alikes(df.where("false")).count() == 0
