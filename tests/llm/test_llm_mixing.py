from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from streamscore.llm.mixing import mix, mixed_documents, source_targets
from streamscore.llm.queries import QUERIES


def filled(sizes, weights=(5, 2, 1), cap=3):
    """Targets by sharing the excess again and again."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[k % len(weights)] for k, s in enumerate(order)}
    total, full = sum(sizes.values()), set()
    while True:
        left = total - sum(cap * sizes[s] for s in full)
        rest = [s for s in order if s not in full]
        level = left / sum(weight[s] for s in rest) if rest else 0
        over = {s for s in rest if level * weight[s] > cap * sizes[s]}
        if not over:
            return {s: cap * sizes[s] if s in full else level * weight[s] for s in order}
        full |= over


@pytest.mark.parametrize("sizes", [
    {"a": 10, "b": 1000, "c": 5, None: 7, "é": 90, "Z": 0},
    {"a": 1}, {"a": 0, None: 0}, {f"s{k}": k**3 for k in range(23)},
])
def test_targets(spark, sizes):
    df = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    got = {r.source: r.target for r in source_targets(df).collect()}
    assert got == pytest.approx(filled(sizes))


def test_draws_in_the_order_of_keys(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = mix(docs).collect()
    texts = {r.doc_id: r.text for r in docs.collect()}
    by_source = defaultdict(list)
    for r in rows:
        assert r.size == len(texts[r.doc_id].encode().split()) and r.taken <= 3 * r.size
        by_source[r.source].append(r)
    targets = filled({s: sum(r.size for r in some) for s, some in by_source.items()})
    u = (F.shiftrightunsigned(F.xxhash64(F.lit(20240131), "doc_id", "text"), 11).cast("double") + 0.5) / float(1 << 53)
    symbols = F.length("text") - F.length(F.translate("text", "#*$%&|<>", ""))
    weight = F.greatest(1 - symbols / F.length("text"), F.lit(0.05))
    keys = {r.doc_id: r.key for r in docs.select("doc_id", (-F.log(u) / weight).alias("key")).collect()}
    for source, some in by_source.items():
        assert some[0].target == pytest.approx(targets[source])
        assert abs(sum(r.taken for r in some) - targets[source]) <= 1
        left = round(targets[source] - some[0].epochs * some[0].source_size)
        for r in sorted(some, key=lambda r: keys[r.doc_id]):
            assert r.part == min(r.size, left), "whole documents first, then the rest of the budget"
            left -= r.part


def test_reruns_agree(spark, sf_dir):
    once, again = (QUERIES["op1_mixing"](spark, sf_dir) for _ in range(2))
    assert once.exceptAll(again).count() == 0 and once.count() == 200


def test_odd_rows(make_docs, odd_rows):
    rows = mix(make_docs(odd_rows)).collect()
    assert Counter(r.doc_id for r in rows) == Counter(d for d, *_ in odd_rows)
    by_source = defaultdict(list)
    for r in rows:
        by_source[r.source].append(r)
    for some in by_source.values():
        assert abs(sum(r.taken for r in some) - some[0].target) <= 1
    assert mix(make_docs([])).count() == 0 and mixed_documents(make_docs([])).count() == 0
    assert mix(make_docs([(1, None, None, None)])).first().taken == 0


def test_documents_of_the_mix(make_docs, odd_rows):
    rows = odd_rows + [(20 + k, f"word{k} " * (k + 1), "en", f"s{k % 4}") for k in range(30)]
    docs = make_docs(rows)
    taken = Counter()
    for r in mix(docs).collect():
        taken[r.doc_id, r.source] += r.taken
    got = Counter()
    for r in mixed_documents(docs).collect():
        got[r.doc_id, r.source] += len((r.text or "").encode().split())
        assert r.n_chars == (None if r.text is None else len(r.text))
    assert +got == +taken
    assert mixed_documents(docs).columns == docs.columns
