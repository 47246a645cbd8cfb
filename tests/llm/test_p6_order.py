import random

import pytest

from logloom.llm.encode import default_ranks, encode_texts, encoder


def whole(text):
    return encoder(default_ranks()).whole.encode_ordinary(text or "")


def test_long_texts_keep_their_keys_whatever_the_order(spark):
    def any_order(batches):
        """Rows in another order each time, as behind a shuffle."""
        import pyarrow as pa

        rows = [r for b in batches for r in b.to_pylist()]
        random.SystemRandom().shuffle(rows)
        yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([("doc_id", pa.int64()), ("text", pa.string())]))

    texts = {k: f"number {k} is a long text of its own, {k * 7919} words" for k in range(60)}
    rows = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string").coalesce(1).mapInArrow(any_order, "doc_id bigint, text string")
    for given in (rows, rows.repartition(3)):
        got = {r.doc_id: r.ids for r in encode_texts(given, long_chars=8).collect()}
        assert got == {k: whole(t) for k, t in texts.items()}


@pytest.mark.parametrize("most", [1, 4, 8, 16, 64])
def test_joined_pieces_give_the_ids_of_the_whole(most):
    enc, rng = encoder(default_ranks()), random.Random(most)
    alphabets = ["ths a'", "'' slave ", "abc'rellvem d 12", "日本 ่ก́é'x", "͸\U000e0100ab '", "!?'s -- ", "\n\r \t a"]
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 90))) for letters in alphabets for _ in range(150)]
    # Once a hang and once wrong ids.
    texts += [" 'thsath", "\"''sssaal''thsth \"", "", "a" * 3000, "'" * 500, " " * 500, "ab" * 900]
    for text in texts:
        assert enc.together([enc.part(t, s) for t, s in enc.halves(text, most)]) == whole(text), text


def test_nulls_repeats_and_clashing_names(spark):
    rows = [(1, None, "x"), (2, "", "x"), (None, "some words of a text", "x"), (None, "some words of a text", "x"), (3, "other words " * 9, None), (3, "other words " * 9, None)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, _key string").withColumn("ids", df_lit("ids")).withColumn("_pos", df_lit("p"))
    for most in (8, 8192):
        got = encode_texts(df, long_chars=most)
        assert got.dtypes == [("doc_id", "bigint"), ("ids", "array<int>")]
        assert sorted((str(r.doc_id), r.ids) for r in got.collect()) == sorted((str(k), whole(t)) for k, t, _ in rows)
    assert encode_texts(df.where("false"), long_chars=8).count() == 0


def df_lit(value):
    from pyspark.sql import functions as F

    return F.lit(value)
