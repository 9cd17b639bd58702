import base64
import hashlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from streamscore.llm import bpe
from streamscore.llm.queries import QUERIES

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def reference():
    with open(PATH, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding(
        "test", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}
    )


def test_encodes_like_the_library(make_docs, odd_rows, reference):
    texts = [t for _, t, _, _ in odd_rows]
    texts += ["don't we'll 'S", "a" * 3000, " " * 2000, "\x85  x  ", "１２ ¼ ßẞ", "\r\n\t x "]
    docs = make_docs([(k, t, "en", "s") for k, t in enumerate(texts)])
    encoded = bpe.encode(docs, PATH, public_tokenizers.PATTERN)
    rows = bpe.decode(encoded, PATH).collect()
    assert len(rows) == len(texts)
    for row in rows:
        text = texts[row.doc_id] or ""
        assert np.frombuffer(bytes(row.tokens), "<u4").tolist() == reference.encode_ordinary(text)
        assert bytes(row.decoded) == text.encode()
        assert row.n_tokens == len(row.tokens) // 4 and row.text == texts[row.doc_id]


def test_empty_table(make_docs):
    encoded = bpe.encode(make_docs([]), PATH, public_tokenizers.PATTERN)
    assert bpe.decode(encoded, PATH).count() == 0


def test_query_against_the_library(spark, sf_dir, reference):
    rows = {r.doc_id: r for r in QUERIES["op3_byte_bpe"](spark, sf_dir).collect()}
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.coalesce("text", F.lit("")))
    for doc_id, text in docs.collect():
        ids = np.array(reference.encode_ordinary(text), "<u4").tobytes()
        row = rows.pop(doc_id)
        assert (row.n_tokens, row.ids_sha256) == (len(ids) // 4, hashlib.sha256(ids).hexdigest())
        assert row.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()
    assert not rows
