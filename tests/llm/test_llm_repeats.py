import hashlib
import random
import tracemalloc
from collections import Counter

import numpy as np
import pytest

from streamscore.llm import substring_dedup as substring_dedup_module
from streamscore.llm.queries import QUERIES
from streamscore.llm.substring_dedup import substring_dedup
from streamscore.llm.suffix_dedup import (
    anchored_starts,
    repeated_starts,
    suffix_array,
    suffix_dedup,
    without_repeats,
)
from streamscore.llm.winnow import Rolling
from streamscore.sources.storage import stored


def union(starts, window):
    """Places covered by windows, and how many runs they make."""
    covered = {j for i in starts for j in range(i, i + window)}
    return covered, sum(j - 1 not in covered for j in covered)


def brute_bytes(texts, window):
    raw = [(t or "").encode() for t in texts]
    digest = lambda x, i: hashlib.blake2b(x[i : i + window], digest_size=16).digest()
    count = Counter(digest(x, i) for x in raw for i in range(len(x) - window + 1))
    out = []
    for x in raw:
        covered, runs = union([i for i in range(len(x) - window + 1) if count[digest(x, i)] > 1], window)
        out.append((len(x), len(covered), runs, bytes(b for j, b in enumerate(x) if j not in covered)))
    return out


def brute_passages(texts, window, words):
    """Texts without runs of repeated windows that touch so many words, in whole characters."""
    raw = [(t or "").encode() for t in texts]
    digest = lambda x, i: hashlib.blake2b(x[i : i + window], digest_size=16).digest()
    count = Counter(digest(x, i) for x in raw for i in range(len(x) - window + 1))
    out = []
    for x in raw:
        starts = [i for i in range(len(x) - window + 1) if count[digest(x, i)] > 1]
        rest, at = [], 0
        while starts:
            a = b = starts[0]
            while starts and starts[0] <= b:
                b = starts.pop(0) + window
            if len(x[a:b].split()) >= words:
                inside = lambda i: i < len(x) and x[i] & 0xC0 == 0x80
                while inside(a):
                    a += 1
                while inside(b):
                    b -= 1
                rest.append(x[at:a])
                at = max(a, b)
        out.append(b"".join([*rest, x[at:]]).decode())
    return out


def brute_words(rows, window):
    first = {}
    split = [(d, (t or "").encode().split()) for d, t in rows]
    order = lambda d: float("inf") if d is None else d
    for d, words in split:
        for i in range(len(words) - window + 1):
            key = tuple(words[i : i + window])
            first[key] = min(order(d), first.get(key, float("inf")))
    out = []
    for d, words in split:
        starts = [i for i in range(len(words) - window + 1) if first[tuple(words[i : i + window])] < order(d)]
        covered, _ = union(starts, window)
        out.append((len(words), len(covered), b" ".join(w for j, w in enumerate(words) if j not in covered)))
    return out


@pytest.mark.parametrize("seed", range(20))
def test_suffix_arrays(seed):
    rng = random.Random(seed)
    alphabet = b"ab" if seed % 2 else b"a\x00cd"
    pieces = [bytes(rng.choices(alphabet, k=rng.randint(1, 60))) for _ in range(rng.randint(1, 8))]
    pieces += [b"a" * 30, b"ab" * 20]
    text = b"\0".join(bytes(c + 1 for c in x) for x in pieces) + b"\0"
    import numpy as np

    order = suffix_array(np.frombuffer(text, np.uint8), 9).tolist()
    prefixes = [text[i : i + 9] for i in order]
    assert sorted(order) == list(range(len(text))) and prefixes == sorted(prefixes)
    counts = [max(0, len(x) - 8) for x in pieces]
    found = Counter(x[i : i + 9] for x, n in zip(pieces, counts) for i in range(n))
    want = [[i for i in range(n) if found[x[i : i + 9]] > 1] for x, n in zip(pieces, counts)]
    assert [x.tolist() for x in repeated_starts(pieces, counts, 9)] == want


@pytest.mark.parametrize("seed", range(6))
def test_orders_induced_from_anchors_find_what_full_suffix_arrays_find(seed, monkeypatch):
    """Only one suffix of a piece is sorted; all bytes of it were, which took most of the time."""
    import numpy as np

    from streamscore.llm import suffix_dedup

    rng = random.Random(seed)
    text = lambda low, high: bytes(rng.choices(b"ab" if seed % 2 else b"a\x00cd", k=rng.randint(low, high)))
    depth, rows = 12, []
    for group in range(7):
        anchor = b"<%d>" % group  # nowhere else, so equal windows have it at the same place
        tails, heads = [text(9, 20) for _ in range(3)], [text(0, 9) for _ in range(3)]
        for _ in range(rng.choice([1, 2, 2, 9, 40])):
            head, tail = rng.choice([*heads, text(0, 9)]), rng.choice([*tails, text(9, 14)])
            rows.append((group, len(head), head + anchor + tail))
    groups, leads, pieces = zip(*rows)
    counts = [min(len(x) - depth + 1, lead + 1) for x, lead in zip(pieces, leads)]  # windows with the anchor
    pieces = [x[: n + depth - 1] for x, n in zip(pieces, counts)]
    want = [x.tolist() for x in repeated_starts(pieces, counts, depth)]
    monkeypatch.setattr(suffix_dedup, "suffix_array", None)
    got = anchored_starts(pieces, np.array(groups), np.array(leads), depth)
    assert [x.tolist() for x in got] == want and any(want)
    alone = anchored_starts([pieces[0]], np.array([0]), np.array([leads[0]]), depth)
    assert [x.tolist() for x in alone] == [[]]


def similar_rows(seed, n=60):
    """Documents with common passages, copies, periodic text and few different words."""
    rng = random.Random(seed)
    words = ["ab", "b", "äé", "a", "bb", "c", "\x00"]
    text = lambda k: " ".join(rng.choices(words, k=k))
    passages = [text(rng.randint(5, 60)) for _ in range(4)]
    rows = []
    for d in range(n):
        parts = [text(rng.randint(0, 30)), rng.choice(passages), text(rng.randint(0, 9)), rng.choice(passages)]
        rows.append((d, " ".join(parts), "en", "s"))
    rows += [(n, "a " * 100, "en", "s"), (n + 1, "a b " * 40, None, None)]
    rows += [(n + 2 + k, rows[k][1], "en", "s") for k in range(9)]
    return rows


@pytest.mark.parametrize("group", [3, 1000])
def test_suffix_dedup_against_brute_force(make_docs, group):
    rows = similar_rows(1)
    docs = make_docs(rows).repartition(5)
    got = {r.doc_id: r for r in suffix_dedup(docs, window=25, group=group).collect()}
    assert len(got) == len(rows)
    for (d, *_), want in zip(rows, brute_bytes([t for _, t, _, _ in rows], 25)):
        row = got[d]
        assert (row.n_units, row.n_removed, row.n_spans, bytes(row.kept)) == want
        assert row.key == "x" and row.span == "x"


def test_suffix_dedup_of_odd_rows(make_docs, odd_rows):
    want = brute_bytes([t for _, t, _, _ in odd_rows], 400)
    rows = suffix_dedup(make_docs(odd_rows)).collect()
    got = Counter((r.doc_id, r.n_units, r.n_removed, r.n_spans, bytes(r.kept)) for r in rows)
    assert got == Counter((d, *w) for (d, *_), w in zip(odd_rows, want))
    assert suffix_dedup(make_docs([])).count() == 0


def test_text_without_repeats_is_valid(make_docs):
    rows = [(0, "x é" * 300 + "q", "fr", "s"), (1, "yé" + " é" * 400, "fr", "s"), (2, None, None, None)]
    rows += [(3, "é" * 1000, "fr", "s")]  # repeated, but no passage
    out = {r.doc_id: r for r in without_repeats(make_docs(rows)).collect()}
    assert out[2].text == "" and all(r.n_chars == len(r.text) for r in out.values())
    assert out[0].text.endswith("q") and set(out[1].text) <= {"y", "é", " "} and out[3].text == "é" * 1000
    assert [out[k].text for k in range(4)] == brute_passages([t for _, t, _, _ in rows], 200, 50)
    assert list(out[0].asDict()) == make_docs(rows).columns


@pytest.mark.parametrize("longest", [4, 7, 12])
def test_every_shared_passage_of_over_50_words_goes(make_docs, longest):
    rng = random.Random(longest)
    word = lambda low=1: "".join(rng.choices("abcdeéß", k=rng.randint(low, longest)))
    prose = lambda n, low=1: " ".join(word(low) for _ in range(n))
    passages = [prose(rng.randint(52, 70), 3) for _ in range(30)]
    short = [prose(20, 3) for _ in range(30)]  # shared, but not long enough to go
    rows, clean = [], []
    for k in range(90):
        head, tail = prose(rng.randint(0, 200)), prose(rng.randint(0, 200))
        rows.append((k, f"{head} . {passages[k % 30]} ; {tail}\n{short[k % 30]}", "en", "s"))
    for k in range(90, 120):
        clean.append((k, f"{prose(150)}\n{short[k % 30]}", "en", "s"))
    out = {r.doc_id: r.text for r in without_repeats(make_docs(rows + clean).repartition(4)).collect()}
    assert [out[k] for k in range(120)] == brute_passages([r[1] for r in rows + clean], 200, 50)
    for k, text, *_ in rows:
        inner = passages[k % 30].split()
        assert not any(" ".join(inner[i : i + 30]) in out[k] for i in range(len(inner) - 29))
    assert all(out[k] == text for k, text, *_ in clean)


def test_substring_dedup_against_brute_force(make_docs):
    rows = similar_rows(2)
    got = {r.doc_id: r for r in substring_dedup(make_docs(rows).repartition(5), window=8).collect()}
    assert len(got) == len(rows)
    for (d, *_), want in zip(rows, brute_words([r[:2] for r in rows], 8)):
        assert (got[d].n_units, got[d].n_removed, bytes(got[d].kept)) == want


def test_substring_dedup_holds_no_list_of_all_words_of_a_long_text():
    rng = np.random.default_rng(1)
    names = np.array([f"w{k}" for k in range(5000)])
    words = names[rng.integers(0, 5000, 700_000)].tolist()  # several times what is cut at once
    text = " ".join(words[:9]) + "\n\t" + "  ".join(words[9:])
    starts = np.array([0, 5, 200_000, 699_990])
    ends = np.array([3, 7, 500_000, 700_000])
    tracemalloc.start()
    try:
        before = tracemalloc.get_traced_memory()[0]
        n, gone, rest = substring_dedup_module._remove_words(text, starts, ends)
        assert tracemalloc.get_traced_memory()[1] - before < 6 * len(text)
    finally:
        tracemalloc.stop()
    places = np.ones(len(words), bool)
    for a, b in zip(starts, ends):
        places[a:b] = False
    assert (n, gone) == (700_000, 300_015)
    assert rest == " ".join(w for w, stays in zip(words, places) if stays).encode()
    flat, sizes = substring_dedup_module._symbols([text, "", "a b"])
    assert sizes.tolist() == [700_000, 0, 2]
    whole = substring_dedup_module.word_hashes([w.encode() for w in words])
    assert (flat[:700_000] == whole).all()
    # The hash of a window does not depend on the blocks that windows are hashed in.
    some, two = np.array([3, 65_500]), np.array([63, 65_600])
    windows = Rolling(whole).windows(50)
    for found, a, b in zip(substring_dedup_module._cut(text, some, two, 50), some, two):
        assert (found == windows[a : b - 49]).all()


def test_substring_dedup_takes_one_python_worker_a_task_and_writes_six_tables(make_docs, monkeypatch):
    plans = []

    def noted(df, purpose):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return stored(df, purpose)

    monkeypatch.setattr(substring_dedup_module, "stored", noted)
    out = substring_dedup(make_docs(similar_rows(2)), window=8)
    plans.append(out._jdf.queryExecution().executedPlan().toString())
    assert len(plans) == 7
    for plan in plans:
        # Operators between two shuffles run in one task.
        for stage in plan.partition("== Initial Plan ==")[0].split("Exchange"):
            assert stage.count("MapInArrow") <= 1


def test_substring_dedup_of_odd_rows(make_docs, odd_rows):
    want = brute_words([r[:2] for r in odd_rows], 50)
    rows = substring_dedup(make_docs(odd_rows)).collect()
    got = Counter((r.doc_id, r.n_units, r.n_removed, bytes(r.kept)) for r in rows)
    assert got == Counter((d, *w) for (d, *_), w in zip(odd_rows, want))
    assert substring_dedup(make_docs([])).count() == 0


def test_suffix_query_against_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    rows = {r.doc_id: r for r in QUERIES["op4_suffix_dedup"](spark, sf_dir).collect()}
    for (d, _), (n, gone, runs, kept) in zip(docs, brute_bytes([t for _, t in docs], 400)):
        row = rows[d]
        assert (row.n_bytes, row.n_removed, row.n_spans) == (n, gone, runs)
        assert row.kept_sha256 == hashlib.sha256(kept).hexdigest()


def test_substring_dedup_of_a_passage_repeated_within_its_first_document(make_docs):
    rng = random.Random(3)
    text = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    passage = text(55)
    join = lambda *parts: " ".join(w for part in parts for w in part)
    rows = [
        (1, join(text(20), passage[:52], text(30))),  # shares three windows, in another segment
        (2, join(text(20), *[passage] * 13, text(20))),
        (3, join(text(9), passage[2:], text(9), passage, text(9), passage)),
        (None, join(passage, text(5), passage)),
        (None, join(text(7), passage, text(60))),
    ]
    got = substring_dedup(make_docs([(*r, "en", "s") for r in rows]).repartition(3)).collect()
    found = Counter((r.doc_id, r.n_units, r.n_removed, bytes(r.kept)) for r in got)
    assert found == Counter((d, *w) for (d, _), w in zip(rows, brute_words(rows, 50)))


def test_unlike_texts_that_share_an_id_are_told_apart(spark, make_docs):
    rng = random.Random(9)
    text = lambda n: " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))
    long = [text(200) for _ in range(4)]
    # Short texts whose hashes agree in the low 13 bits with those of texts to be cut.
    hashed = lambda texts: {
        r.t: r.h for r in spark.createDataFrame([(t,) for t in texts], "t string").selectExpr("t", "xxhash64(t) & 8191 as h").collect()
    }
    low = set(hashed(long).values())
    short = [t for t, h in hashed([text(60) for _ in range(20_000)]).items() if h in low]
    assert len(short) >= 2
    rows = [(None, t) for t in long + short] + [(k, t) for k, t in enumerate(long)]
    docs = make_docs([(*r, "en", "s") for r in rows]).repartition(3)
    found = Counter((r.doc_id, r.n_units, r.n_removed, bytes(r.kept)) for r in substring_dedup(docs).collect())
    assert found == Counter((d, *w) for (d, _), w in zip(rows, brute_words(rows, 50)))
    found = Counter((r.doc_id, r.n_units, r.n_removed, r.n_spans, bytes(r.kept)) for r in suffix_dedup(docs).collect())
    assert found == Counter((d, *w) for (d, _), w in zip(rows, brute_bytes([t for _, t in rows], 400)))
