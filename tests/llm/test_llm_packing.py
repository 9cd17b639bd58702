import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from streamscore.llm import packing
from streamscore.llm.arrow import cut
from streamscore.llm.queries import QUERIES

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def expected(library, text):
    return [*library.encode(text or "", add_special_tokens=False).ids, 0]


def ids_of(words, texts):
    return [[*np.frombuffer(x, "<u4").tolist(), 0] for x in words.encode([t.encode() for t in texts])]


def test_ids_are_those_of_the_library(library):
    words = packing.WordIds(open(PATH, encoding="utf-8").read())
    texts = [
        "Don't WE'LL  x\t\n12 ab12", "é ́x \ńy", "ΑΣ Σ ΣΑΣ İ ẞ", "\x1c\x85　 a b",
        "<|endoftext|>a <|startoftext|> <|end <|ENDOFTEXT|>, <|a|>x, <|endoftext|>a.", "日本語" * 700, "", " \t",
        "\x00 \U0001f600 \x01 a\x01b \x01, x\x01", "a" * 5000, "It's, it's. 's, x', end... end.. (a), a.b. é, naïve,",
        "J\u030c H\u0331! T\u0308, I\u0307. E\u0301; Straße: STRASSE?", ". , a, A, A. 1, x1. a,\u0301", "K K.",
    ]
    for _ in range(2):
        for text, got in zip(texts, ids_of(words, texts), strict=True):
            assert got == expected(library, text), text


def test_long_texts_and_forgetting(library, monkeypatch):
    rng = random.Random(1)
    parts = ["ab", "é", " ", "\n", "12,", "'s ", "Xy. ", "<|", "\u0301"]
    texts = ["".join(rng.choices(parts, k=rng.randint(0, 4000))) for _ in range(40)]
    monkeypatch.setattr(packing, "REMEMBERED", 9000)  # forgets again and again
    monkeypatch.setattr(packing, "BLOCK_BYTES", 700)
    monkeypatch.setattr(packing, "cut", lambda data: cut(data, 50))
    words = packing.WordIds(open(PATH, encoding="utf-8").read())
    for text, got in zip(texts, ids_of(words, texts), strict=True):
        assert got == expected(library, text)
        assert b"".join(cut(text.encode(), 50)) == text.encode()


def check_packing(rows, capacity):
    bins = defaultdict(list)
    for row in rows:
        bins[row.sequence_id].append((row.offset, row.length))
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(bins)


def test_pieces_and_sequences(make_docs, odd_rows, library):
    docs = make_docs([(d, t, lang, s) for d, t, lang, s in odd_rows])
    pieces = packing.pieces(docs, PATH, 100)
    packed = packing.pack(pieces, capacity=100).cache()
    rows = packed.collect()
    check_packing(rows, 100)
    texts = defaultdict(list)
    for d, t, *_ in odd_rows:
        texts[d].append(expected(library, t))
    got = defaultdict(list)
    for row in rows:
        ids = np.frombuffer(bytes(row.ids), "<u4").tolist()
        assert row.length == len(ids) and row.start == 100 * row.piece
        got[row.doc_id, row.piece].append(ids)
    for doc_id, all_ids in texts.items():
        for number in range(-(-max(map(len, all_ids)) // 100)):
            want = [x for ids in all_ids if (x := ids[100 * number : 100 * number + 100])]
            assert sorted(got.pop((doc_id, number))) == sorted(want)
    assert not got
    whole = {r.sequence_id: bytes(r.ids) for r in packing.sequences(packed).collect()}
    for row in rows:
        assert whole[row.sequence_id][4 * row.offset :][: 4 * row.length] == bytes(row.ids)
    assert sum(map(len, whole.values())) == 4 * sum(r.length for r in rows)


def test_best_fit_against_a_plain_list():
    rng = random.Random(3)
    for limit in (1, 3, 50):
        bins, plain, made = packing.BestFit(64, limit), {}, 0
        for _ in range(3000):
            n = rng.choice([rng.randint(1, 64), rng.randint(1, 9)])
            number, offset = bins.place(n)
            fits = {f for f in plain.values() if f >= n}
            if fits:
                assert 64 - offset == plain[number] == min(fits)
            else:
                if len(plain) == limit:  # one of the fullest has closed
                    least = min(plain.values())
                    closed = [k for k in plain if plain[k] == least]
                    still = {k for b in bins.bins for k in b} | {number}
                    gone = [k for k in closed if k not in still]
                    assert len(gone) == 1
                    del plain[gone[0]]
                assert number == made and offset == 0
                made += 1
            plain[number] = 64 - offset - n
            if not plain[number]:
                del plain[number]
            assert len(plain) == bins.open <= limit


def test_groups_clashes_and_empty_tables(spark):
    items = spark.range(3000).selectExpr(
        "if(id < 1000, null, id) as doc_id", "1 + id % 37 as length", "'x' as offset", "'y' as _group"
    )
    packed = packing.pack(items, capacity=64, group=700)
    rows = packed.collect()
    assert len(rows) == 3000 and packed.columns == ["doc_id", "length", "_group", "sequence_id", "offset"]
    assert len({r.sequence_id >> 40 for r in rows}) == 5
    bins = check_packing(rows, 64)
    assert bins <= 1.03 * sum(r.length for r in rows) / 64
    assert sorted(rows, key=str) == sorted(packing.pack(items, capacity=64, group=700).collect(), key=str)
    assert packing.pack(items.limit(0), capacity=64).count() == 0
    with pytest.raises(Exception, match="between 1 and 8"):
        packing.pack(items, capacity=8).collect()


def test_query(spark, sf_dir, library):
    rows = QUERIES["op12_best_fit_packing"](spark, sf_dir).collect()
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.coalesce("text", F.lit("")))
    want = set()
    for doc_id, text in docs.collect():
        ids = expected(library, text)
        for piece, start in enumerate(range(0, len(ids), 2048)):
            part = ids[start : start + 2048]
            want.add((doc_id, piece, start, len(part), zlib.crc32(np.array(part, "<u4").tobytes())))
    assert {(r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows} == want
    assert len(rows) == len(want)
    bins = check_packing(rows, 2048)
    assert bins <= 1.05 * sum(r.length for r in rows) / 2048 + 1
