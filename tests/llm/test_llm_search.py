import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from streamscore.llm import search
from streamscore.llm.queries import QUERIES

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
LOWER = str.maketrans({c: chr(ord(c) + 32) for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})


def terms(text):
    return TERM.findall((text or "").translate(LOWER))


def plain(docs, items, k=20):
    """The contract over (doc_id, text) and (item_id, text), all documents scored."""
    found = [(d, Counter(t), len(t)) for d, x in docs if (t := terms(x))]
    n_docs, n_terms = len(found), sum(n for *_, n in found)
    df = Counter(t for _, counts, _ in found for t in counts)
    out = []
    for item, text in set(items):
        wanted = Counter(terms(text))
        scores = []
        for d, counts, n in found:
            m = 100 - 25 + (25 * n * n_docs) // n_terms
            score = 0
            for t, times in wanted.items():
                if tf := counts[t]:
                    w = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                    score += times * w * ((1000000000 * tf) // (1000 * tf + 12 * m))
            if score > 0:
                scores.append((-score, d is None, d or 0))
        for rank, (s, null, d) in enumerate(sorted(scores)[:k], 1):
            out.append((str(item), rank, None if null else d, -s))
    return sorted(out, key=str)


def rows_of(df):
    rows = df.select("item_id", "rank", "doc_id", "score").collect()
    return sorted(((str(a), b, c, d) for a, b, c, d in rows), key=str)


@pytest.fixture
def make_items(spark):
    def make(rows):
        data = [(i, t, "x", 1, 2) for i, t in rows]
        return spark.createDataFrame(data, "item_id long, text string, query string, score long, terms long")

    return make


def test_odd_rows(make_docs, make_items, odd_rows):
    rng = random.Random(2)
    words = [f"w{k}" for k in range(40)] + ["é", "Straße", "ß"]
    rows = [*odd_rows, *((100 + k, ", ".join(rng.choices(words, k=rng.randint(1, 30))), "en", "a") for k in range(300))]
    rows += [(500 + k, "common W1 w2\nw3", "en", "hot") for k in range(200)]  # all tied
    rows += [(None, "common w1", None, None)] * 3
    items = [(1, "w1 w2 w1 common"), (1, "w1 w2 w1 common"), (1, "É é straßE"), (2, None), (3, ""), (4, "none such")]
    items += [(None, "single ha"), (5, " ".join(words)), (6, "common")]
    docs = make_docs(rows)
    got = rows_of(search.ranked_search(docs.repartition(6), make_items(items)))
    assert got == plain([r[:2] for r in rows], items)


def test_blocks_of_queries_and_small_shards(make_docs, make_items, monkeypatch):
    monkeypatch.setattr(search, "SHARD_POSTINGS", 300)
    rng = random.Random(8)
    words = [f"t{int(rng.paretovariate(0.7))}" for _ in range(500)]
    rows = [(k, " ".join(rng.choices(words, k=rng.randint(1, 60))), "en", "a") for k in range(400)]
    items = [(k, " ".join(rng.choices(words, k=rng.randint(1, 12)))) for k in range(30)]
    docs, queries = make_docs(rows), make_items(items)
    want = plain([r[:2] for r in rows], items, 5)
    assert rows_of(search.ranked_search(docs, queries, 5, block_terms=60)) == want
    few = search.ranked_search(docs, queries.filter("item_id < 3"), 5, block_terms=1)
    assert rows_of(few) == plain([r[:2] for r in rows], items[:3], 5)


def test_reading_stops_early_and_exactly():
    rng = np.random.default_rng(4)
    n, t = 20_000, 3
    terms_, docs = np.tile(np.arange(t), n), np.repeat(np.arange(n), t)
    impacts = (rng.pareto(1.0, n * t) * 1000).astype(np.int64) + 1
    shard = search.Shard(docs, terms_, impacts, n, t)
    met = []
    best = search.Best(10).shard(np.arange(n), np.zeros(n, bool))
    offer = best.offer
    best.offer = lambda new, scores: (met.append(len(new)), offer(new, scores))
    shard.search(np.arange(t), np.array([1, 2, 1]), best)
    scores = impacts.reshape(n, t) @ np.array([1, 2, 1])
    order = np.lexsort((np.arange(n), -scores))[:10]
    assert (best.ids == order).all() and (best.scores == scores[order]).all()
    assert sum(met) < n / 10


def test_empty_tables(make_docs, make_items):
    assert search.ranked_search(make_docs([]), make_items([(1, "a")])).count() == 0
    assert search.ranked_search(make_docs([(1, "a", None, None)]), make_items([])).count() == 0
    assert search.ranked_search(make_docs([(1, None, None, None)]), make_items([(1, "a")])).count() == 0


def test_query(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text").collect()
    got = rows_of(QUERIES["op11_ranked_search"](spark, sf_dir))
    assert got == plain([tuple(r) for r in docs], [tuple(r) for r in items])
