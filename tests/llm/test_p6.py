import base64

import public_tokenizers
import tiktoken

import __spark_entry__ as driver
from logloom.runtime import table


def test_p6_gives_the_ids_of_every_document(spark, small):
    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
    plain = tiktoken.Encoding("plain", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    got = driver.queries()["p6_ids"](spark, small)
    assert got.dtypes == [("doc_id", "bigint"), ("ids", "array<int>")]
    texts = {r.doc_id: r.text for r in table(spark, small, "documents").collect()}
    rows = got.collect()
    assert len(rows) == len(texts)
    assert {r.doc_id: r.ids for r in rows} == {k: plain.encode_ordinary(v or "") for k, v in texts.items()}
