import random
from collections import defaultdict

import pytest

from streamscore.llm.components import components, joined_components
from streamscore.llm.minhash import distinct_documents, near_duplicates, shingle_sets


def roots(nodes, links):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in links:
        parent[find(a)] = find(b)
    return {n: find(n) for n in nodes}


def partition(labels):
    groups = defaultdict(set)
    for node, label in labels.items():
        groups[label].add(node)
    return sorted(map(sorted, groups.values()))


@pytest.mark.parametrize("kind", ["path", "star", "random", "none"])
def test_components(spark, kind):
    rng = random.Random(1)
    edges = {
        "path": [(k, k + 1) for k in range(200)],
        "star": [(7, k) for k in range(100, 300)] + [(5, 5)],
        "random": [(rng.randrange(400), rng.randrange(400)) for _ in range(220)],
        "none": [],
    }[kind]
    df = spark.createDataFrame(edges + edges[:3], "a long, b long")
    got = {r.node: r.label for r in components(df).collect()}
    nodes = {x for a, b in edges if a != b for x in (a, b)}
    assert got.keys() == nodes
    assert partition(got) == partition(roots(nodes, [e for e in edges if e[0] != e[1]]))


def test_components_joined_along_more_edges(spark):
    rng = random.Random(5)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(140)]
    more = [(rng.randrange(300), rng.randrange(320)) for _ in range(40)]
    frame = lambda rows: spark.createDataFrame(rows, "a long, b long")
    got = joined_components(components(frame(edges)), frame(more)).collect()
    nodes = {x for e in edges if e[0] != e[1] for x in e} | {x for e in more for x in e}
    assert len(got) == len(nodes)
    assert partition({r.node: r.label for r in got}) == partition(roots(nodes, [e for e in edges + more if e[0] != e[1]]))


def brute(rows, words):
    """(n_shingles, component_id) per row, by all pairs."""
    sets = []
    for _, text in rows:
        w = (text or "").encode().lower().split()
        n = min(words, len(w))
        sets.append({tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if n else set())
    links = []
    for i, s in enumerate(sets):
        for j in range(i):
            t = sets[j]
            if s and t and 100 * len(s & t) >= 80 * len(s | t):
                links.append((i, j))
            if rows[i][0] is not None and rows[i][0] == rows[j][0] and s and t:
                links.append((i, j))
    label = roots(range(len(rows)), links)
    first = defaultdict(lambda: None)
    for i, (d, _) in enumerate(rows):
        if d is not None:
            old = first[label[i]]
            first[label[i]] = d if old is None else min(old, d)
    return [(len(s), first[label[i]] if s else rows[i][0]) for i, s in enumerate(sets)]


def near_copies(seed):
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(300)]
    rows = []
    for _ in range(12):
        base = rng.choices(words, k=rng.randint(20, 120))
        for _ in range(rng.randint(1, 14)):
            copy = list(base)
            for _ in range(rng.randint(0, 9)):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            base = copy if rng.random() < 0.4 else base  # chains of copies of copies
            rows.append(" ".join(copy).upper() if rng.random() < 0.2 else " ".join(copy))
    rng.shuffle(rows)
    return [(10 * k, t) for k, t in enumerate(rows)]


@pytest.mark.parametrize("words", [2, 5])
def test_near_duplicates_against_all_pairs(make_docs, words):
    rows = near_copies(words)
    docs = make_docs([(d, t, "en", "s") for d, t in rows]).repartition(4)
    got = {r.doc_id: r for r in near_duplicates(docs, words).collect()}
    for (d, _), (n, component) in zip(rows, brute(rows, words)):
        assert (got[d].n_shingles, got[d].component_id, got[d].kept) == (n, component, d == component)
    kept = distinct_documents(docs, words)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(d for d in got if got[d].kept)


def test_near_duplicates_of_odd_rows(make_docs, odd_rows):
    rows = [r[:2] for r in odd_rows]
    got = near_duplicates(make_docs(odd_rows)).collect()
    found = sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in got)
    want = [(str(d), n, str(c)) for (d, _), (n, c) in zip(rows, brute(rows, 2))]
    assert found == sorted(want)
    kept = [r.doc_id for r in distinct_documents(make_docs(odd_rows), 2).collect()]
    assert kept.count(13) == 1 and kept.count(11) == 1 and 12 not in kept and 0 in kept
    assert near_duplicates(make_docs([])).count() == 0
    assert distinct_documents(make_docs([])).count() == 0


def test_shingles():
    assert [len(s) for s in shingle_sets(["", "A", "a b", "A B a b A", "\x0b"], 2)] == [0, 1, 1, 2, 0]
    a, b = shingle_sets(["One Two", "one two"], 2)
    assert (a == b).all()


def test_near_copies_among_rows_that_share_an_id(make_docs):
    rng = random.Random(6)
    text = lambda n=60: " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))
    one, clean, other, third, twin = text(), text(), text(), text(), text()
    copy = lambda t: t + " more"
    rows = [
        (1, one), (None, copy(one)), (None, clean), (None, twin), (None, copy(twin)), (None, clean),
        (5, one + " again"), (5, other), (5, copy(other)), (5, ""), (6, third), (6, copy(other)),
        (7, ""), (7, text(9)), (8, "b"), (8, "a"), (8, "b"), (9, None), (None, ""), (None, None),
    ]
    kept = distinct_documents(make_docs([(*r, "en", "s") for r in rows]).repartition(3)).collect()
    gone = {(None, copy(one)), (5, one + " again"), (5, copy(other)), (6, copy(other))}
    want = {(d, t or "") for d, t in rows} - gone
    found = [(r.doc_id, r.text or "") for r in kept]
    assert len(found) == len(set(found)) and set(found) == want
