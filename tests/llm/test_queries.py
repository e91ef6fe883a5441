"""Registered queries run as registered, not only through their operators."""

import hashlib
import os

from whorl.llm import queries, tokens

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def test_registered_byte_bpe_equals_the_library(spark):
    own = tokens.load(**queries.ranks())
    sha = lambda raw: hashlib.sha256(raw).hexdigest()
    want = []
    for r in spark.read.parquet(f"{SF}/documents.parquet").collect():
        ids = own.encode_ordinary(r["text"] or "")
        want.append((r["doc_id"], len(ids), sha(",".join(map(str, ids)).encode()), sha((r["text"] or "").encode())))
    got = [(r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in queries.QUERIES["op5_byte_bpe"](spark, SF).collect()]
    assert sorted(got) == sorted(want)
