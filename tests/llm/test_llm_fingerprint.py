import hashlib
import random
from collections import Counter

import pytest

from streamscore.llm.fingerprint import fingerprints, successors
from streamscore.llm.queries import QUERIES


@pytest.mark.parametrize("keys", [range(3000), [0], [], [5, 1 << 59, (1 << 60) + 4, 1024, 1023, 7 << 30]])
def test_successors(spark, keys):
    df = spark.createDataFrame([(k,) for k in keys], "key long")
    order = sorted(keys)
    want = {k: order[(i + 1) % len(order)] for i, k in enumerate(order)}
    assert {r.key: r.next for r in successors(df).collect()} == want


def brute(rows):
    """(n_chars, digest of the edited text, likenesses) per document in order of id and text."""
    order = sorted(((d, t or "") for d, t in rows), key=lambda r: (r[0] is None, r[0] or 0, r[1].encode()))
    bag = lambda t: Counter(t.encode().split())
    alike = lambda a, b: sum((a & b).values()) / max(1, sum((a | b).values()))
    for k, (d, text) in enumerate(order):
        after = order[(k + 1) % len(order)][1]
        cut = len(text) // 4
        edited = text[: len(text) - cut] + after[:cut]
        near = [1.0 if not bag(text) and not bag(x) else alike(bag(text), bag(x)) for x in (edited, after)]
        yield d, len(text), hashlib.sha256(edited.encode()).hexdigest(), *near


def test_query_against_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    got = {r.doc_id: r for r in QUERIES["op10_fingerprints"](spark, sf_dir).collect()}
    assert len(got) == len(docs)
    errors = []
    for d, n, digest, edited, after in brute(docs):
        row = got[d]
        assert (row.n_chars, row.edited_sha256) == (n, digest)
        errors += [row.near_edited - edited, row.near_next - after]
    assert abs(sum(errors) / len(errors)) < 0.01  # collisions are as likely as the texts are alike
    assert max(map(abs, errors)) < 0.5
    prints = {}
    for d, text in docs:
        assert prints.setdefault(text, got[d].fingerprint) == got[d].fingerprint


def test_collision_rate_is_the_weighted_similarity(make_docs):
    rng = random.Random(3)
    a = [f"t{k}" for k in range(40) for _ in range(rng.randint(1, 9))]
    b = [f"t{k}" for k in range(20, 60) for _ in range(rng.randint(1, 9))]
    rows = [(0, " ".join(a), "en", "s"), (1, " ".join(b), "en", "s")]
    got = fingerprints(make_docs(rows), samples=3000).filter("doc_id = 0").first()
    x, y = Counter(a), Counter(b)
    assert got.near_next == pytest.approx(sum((x & y).values()) / sum((x | y).values()), abs=0.04)


def test_odd_rows(make_docs, odd_rows):
    rows = fingerprints(make_docs(odd_rows)).collect()
    found = sorted((str(r.doc_id), r.n_chars, r.edited_sha256) for r in rows)
    want = sorted((str(d), n, digest) for d, n, digest, *_ in brute([r[:2] for r in odd_rows]))
    assert found == want
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in rows)
    assert {r.fingerprint for r in rows if r.doc_id in (0, 1, 2)} == {""}
    assert fingerprints(make_docs([])).count() == 0
    alone = fingerprints(make_docs([(4, "a b c", "en", "s")])).first()
    assert alone.near_next == 1.0
