import base64
import gzip
import hashlib
import random
from collections import defaultdict

import pytest
from pyarrow import fs

from streamscore.llm import warc
from streamscore.llm.html_text import block_text, described, extract, leaf_blocks, main_text, train
from streamscore.llm.labelled_pages import LAYOUTS, MARK, labelled_pages
from streamscore.sources.storage import shared_dir

PAGES = "page_id long, url string, html string, row string, chunk string, text string"


@pytest.fixture(scope="module")
def model():
    return train(labelled_pages(20, 1))


def accuracy(model, pages):
    good = total = 0
    for page in pages:
        texts, rows = described(page)
        gold = [int(t.startswith(MARK)) for t in texts]
        good += sum(a == b for a, b in zip(gold, model.labels(rows)))
        total += len(gold)
    return good / total


def test_held_out_pages(model):
    assert accuracy(model, labelled_pages(10, 77)) > 0.99


def test_held_out_layouts():
    scores = []
    for k in range(0, len(LAYOUTS), 3):
        other = train(labelled_pages(8, 1, LAYOUTS[:k] + LAYOUTS[k + 1 :]), steps=100)
        scores.append(accuracy(other, labelled_pages(5, 2, [LAYOUTS[k]])))
    assert sum(scores) / len(scores) > 0.8


def test_viterbi_is_the_best_labelling(model):
    from itertools import product

    _, rows = described(labelled_pages(1, 5, LAYOUTS[:1])[0])
    rows = rows[:9]
    score = lambda labels: sum(
        sum(model.weights.get(f, 0) for f in row) * y for row, y in zip(rows, labels)
    ) + sum(model.turns[a][b] for a, b in zip(labels, labels[1:]))
    assert tuple(model.labels(rows)) == max(product((0, 1), repeat=len(rows)), key=score)


def test_blocks_of_broken_markup():
    html = "<p><b>One &amp; <i>tw</i>o<br>three<p>four\n\t five<script>var x='</p>'</script><li>six<li>se&eacute;</ul>&nbsp;&copy"
    blocks = leaf_blocks(html)
    assert [block_text(b) for b in blocks] == ["One & two", "three", "four five", "six", "seé ©"] or [
        block_text(b) for b in blocks
    ][:4] == ["One & two", "three", "four five", "six"]
    assert leaf_blocks("") == [] and leaf_blocks("<<<>>") is not None


def test_odd_pages(spark, model):
    article = "<nav><a href='/'>Home</a></nav><article><h1>T</h1><p>Some words here.</p></article><footer>x</footer>"
    long = "<article>" + "<p>word word word.</p>" * 20_000
    rows = [(1, "u", None), (None, None, article), (3, "u", ""), (3, "u", ""), (4, "u", article), (5, "v", long)]
    df = spark.createDataFrame([(*r, "a", "b", "c") for r in rows], PAGES)
    got = extract(df, model).collect()
    assert [r.text for r in got[:5]] == ["", "T Some words here.", "", "", "T Some words here."]
    assert got[5].text.count("word.") == 20_000 and all(r.n_chars == len(r.text) for r in got)
    assert [r.page_id for r in got] == [r[0] for r in rows]
    assert extract(df.limit(0), model).count() == 0
    assert main_text("<p>", model) == ""


def records(rows, min_bytes=0):
    groups = defaultdict(list)
    for page_id, _, html in rows:
        groups[(html or "").encode()].append(page_id)
    for page_id, _, html in rows:
        payload = (html or "").encode()
        ids = [x for x in groups[payload] if x is not None]
        first = max(ids) if ids else None
        digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
        other = len(payload) >= min_bytes and page_id != first
        yield page_id, len(payload), digest, "revisit" if other else "response", first if other else None


@pytest.mark.parametrize("min_bytes,size,threshold", [(0, warc.CHUNK, "10m"), (5, 7_000, "10m"), (0, 7_000, "-1")])
def test_archives_round_trip(spark, min_bytes, size, threshold):
    was = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    try:
        round_trip(spark, min_bytes, size)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)


def round_trip(spark, min_bytes, size):
    rng = random.Random(1)
    big = "".join(rng.choices("abcdé\r\n\x00", k=300_000))
    rows = [(1, "http://a/", "x\r\n\r\ny"), (2, None, None), (3, "http://b/ä b\r\n", ""), (9, "u", big)]
    rows += [(10 + k, "u", f"page {k % 7}") for k in range(40)] + [(5, "u", big), (None, "n", "only")]
    rows += [(None, "n", "page 3"), (60, "u", "abcd"), (61, "u", "abcd")]
    # Equal rows of several chunks: both are records of their own.
    rows += [(70, "u", big[:60_000])] * 2
    df = spark.createDataFrame([(*r, "a", "b", "c") for r in rows], PAGES).repartition(4)
    archives = warc.write_archives(df, shared_dir(spark, "warc"), min_bytes, size=size)
    chunks = warc.read_archives(spark, archives, chunk=10_000)
    got = [tuple(r) for r in warc.page_records(chunks).collect()]
    assert sorted(got, key=str) == sorted(records(rows, min_bytes), key=str)
    pieces = defaultdict(list)
    for r in chunks.orderBy("chunk_no").collect():
        assert len(r.chunk) <= 10_000
        pieces[r.page_id].append(r)
    whole = b"".join(bytes(r.chunk) for r in pieces[9])
    assert whole == big.encode() and [r.chunk_no for r in pieces[9]] == list(range(len(pieces[9])))
    upto = b""
    for r in pieces[9]:
        upto += bytes(r.chunk)
        assert (r.bytes_upto, r.last) == (len(upto), len(upto) == len(whole))
        assert r.digest_upto == base64.b32encode(hashlib.sha1(upto).digest()).decode()


def test_archives_are_standard_files(spark):
    df = spark.createDataFrame([(7, "http://a/", "<p>é</p>")], "page_id long, url string, html string")
    archive = warc.write_archives(df, shared_dir(spark, "warc")).first()
    store, path = fs.FileSystem.from_uri(archive.file if "://" in archive.file else f"file://{archive.file}")
    with store.open_input_stream(path, compression=None) as f:
        record = gzip.decompress(f.read())
    head, http, body = record.split(b"\r\n\r\n", 2)
    assert head.startswith(b"WARC/1.1\r\nWARC-Type: response\r\n")
    assert body == "<p>é</p>\r\n\r\n".encode()
    length = int(head.split(b"\r\nContent-Length: ")[1])
    assert length == len(http) + 4 + len(body) - 4 and b"WARC-Target-URI: http://a/" in head


def test_chunks_of_payloads(spark):
    df = spark.createDataFrame([(1, bytearray(b"abcdefg")), (2, bytearray()), (3, None)], "id int, payload binary")
    rows = [(r.id, r.no, None if r.bytes is None else bytes(r.bytes)) for r in warc.chunk_rows(df, 3).collect()]
    assert rows == [(1, 0, b"abc"), (1, 1, b"def"), (1, 2, b"g"), (2, 0, b""), (3, 0, None)]


def test_chunks_are_cut_before_they_travel(spark):
    """No exchange carries a whole payload, whichever join is chosen."""
    df = spark.createDataFrame([(k, "u", "x" * 5000) for k in range(20)], "page_id long, url string, html string")
    chunks = warc.record_chunks(df, size=1000)
    assert max(len(r.bytes or b"") for r in chunks.collect()) == 1000
    plan = chunks._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Join") < plan.index("Generate explode")


def test_no_pages(spark):
    df = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.archive_round_trip(df).count() == 0


def test_empty_tables_and_clashing_names(spark):
    from streamscore.llm.html_text import extract
    from streamscore.llm.licences import licence_scan
    from streamscore.llm.warc import archive_round_trip

    schema = "page_id long, url string, html string"
    clash = ["'x' as text", "'y' as n_chars", "'z' as payload", "'k' as `key`", "1 as sha1", "2 as doc_id", "3 as n_bytes"]
    rows = [(1, None, None), (1, "u", "<article><p>one two</p></article>"), (None, "u", "<p>x"), (None, "u", "<p>x")]
    for data in (rows, []):
        pages = spark.createDataFrame(data, schema).selectExpr("*", *clash)
        found = archive_round_trip(pages).collect()
        assert sorted(str(r.page_id) for r in found) == sorted(str(r[0]) for r in data)
        assert {r.record_type for r in found} <= {"response", "revisit"}
        assert extract(pages).count() == licence_scan(pages).count() == len(data)
