import math
import random
import re
import struct
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash

from streamscore.llm import quality
from streamscore.llm.queries import QUERIES

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def counts(text):
    text = text or ""
    words, seen, copies = WORD.findall(text), set(), 0
    windows = Counter(zip(words, words[1:], words[2:]))
    covered = {j for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    for line in lines:
        copies += line in seen
        seen.add(line)
    symbols = sum(c in quality.SYMBOLS for c in text)
    lone = sum(len(w) == 1 and w in quality.SYMBOLS for w in words)
    return len(words), sum(map(len, words)), symbols, copies, len(covered), len(lines), lone


def vector(n, chars, symbols, copies, repeats, lines, lone):
    half_up = lambda x: math.floor(x * 256 + 0.5)
    share = lambda a, b: min(a / max(b, 1), 1.0)
    return [
        half_up(math.log(max(chars / max(n, 1), 0.5))),
        half_up(math.log1p(20 * (symbols - lone) / max(chars, 1))),
        half_up(math.asin(math.sqrt(share(copies, lines)))),
        half_up(math.asin(math.sqrt(share(repeats, n)))),
    ]


def spark_hash(*longs):
    value = 42
    for x in longs:
        value = xxhash.xxh64_intdigest(struct.pack("<q", x), value)
    return value - (1 << 64) if value >> 63 else value


def far(points, estimate):
    centre, cov = estimate
    return ((points - centre).T * np.linalg.solve(cov, (points - centre).T)).sum(axis=0)


def moments(rows, factor):
    centre = rows.mean(axis=0)
    cov = factor * ((rows.T @ rows) / len(rows) - np.outer(centre, centre))
    return centre, cov + np.diag(np.array(list(quality.FLOORS.values())) ** 2)


def step(rows, estimate):
    near = np.floor(32 * np.log1p(far(rows, estimate)))
    limit = np.sort(near)[math.ceil(quality.SUPPORT * len(rows)) - 1]
    return moments(rows[near <= limit], quality.CONSISTENCY)


def log_det(estimate):
    return np.linalg.slogdet(estimate[1])[1]


def begin(rows, starts):
    """Medians with quartile scales, then moments of drawn vectors."""
    at = lambda q: np.sort(rows, axis=0)[math.ceil(q * len(rows) - 1e-9) - 1]
    floors = np.array(list(quality.FLOORS.values()))
    yield at(0.5), np.diag(((at(0.75) - at(0.25)) / 1.349) ** 2 + floors**2)
    different = {tuple(v) for v in (rows * 256).round().astype(int).tolist()}
    for k in range(starts):
        draws = range(k * quality.DRAWN, (k + 1) * quality.DRAWN)
        yield moments(np.array([min(different, key=lambda v: spark_hash(d, *v)) for d in draws]) / 256, 1)


def smallest_determinant(rows, starts=quality.STARTS):
    trials = {}
    for estimate in begin(rows, starts):
        for _ in range(quality.TRIAL_STEPS):
            estimate = step(rows, estimate)
        trials.setdefault(round(log_det(estimate), 9), estimate)
    seen = [trials[key] for key in sorted(trials)[: quality.FINALISTS]]
    for estimate in list(seen):
        while True:
            was, estimate = log_det(estimate), step(rows, estimate)
            seen.append(estimate)
            if log_det(estimate) >= was - quality.FALL:
                break
    return min(seen, key=log_det)


def distances(vectors, fit):
    """Squared distances of all vectors by the estimates from those marked in `fit`."""
    x = np.array(vectors) / 256
    rows = x[fit]
    inner = rows[far(rows, smallest_determinant(rows)) <= quality.INNER]
    return far(x, moments(inner, quality.INNER_CONSISTENCY))


def judged(rows):
    """(counts, base_failed, kept) per row, all rows of a language and source together."""
    out = [None] * len(rows)
    groups = defaultdict(list)
    for k, (_, text, lang, source) in enumerate(rows):
        groups[lang, source].append((k, counts(text)))
    for members in groups.values():
        failed = [n < 50 or 100 * r > 50 * n for _, (n, _, _, _, r, *_) in members]
        fit = ~np.array(failed)
        d = distances([vector(*c) for _, c in members], fit) if fit.any() else [0.0] * len(members)
        for (k, c), bad, far in zip(members, failed, d):
            out[k] = (c[:5], bad, not bad and far <= quality.CUTOFF)
    return out


def check(rows, got):
    columns = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    found = sorted((str(r.doc_id), *(r[c] for c in columns), r.base_failed, r.kept) for r in got)
    want = sorted((str(row[0]), *c, bad, kept) for row, (c, bad, kept) in zip(rows, judged(rows)))
    assert found == want


def test_query_against_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = [(r.doc_id, r.text, r.lang, r.source) for r in docs.collect()]
    check(rows, QUERIES["op6_quality_rules"](spark, sf_dir).collect())


def test_odd_rows(make_docs, odd_rows):
    got = quality.quality_rules(make_docs(odd_rows)).collect()
    check(odd_rows, got)
    assert quality.quality_rules(make_docs([])).count() == 0
    docs = make_docs(odd_rows)
    kept = quality.passing_documents(docs)
    assert kept.columns == docs.columns
    assert sorted(map(str, (r.doc_id for r in kept.collect()))) == sorted(str(r.doc_id) for r in got if r.kept)


def test_outliers_go_and_clean_documents_stay(make_docs):
    rng = random.Random(2)
    words = ["lorem", "ipsum", "dolor", "sit", "amet", "con", "sectetur", "adip", "elit", "sed"]
    clean = [(k, " ".join(f"{rng.choice(words)}{rng.randrange(99)}" for _ in range(rng.randint(60, 900))), "en", "a") for k in range(120)]
    junk = [(1000 + k, " ".join(f"{rng.choice(words)}{rng.randrange(99)}%%%$$" for _ in range(200)), "en", "a") for k in range(40)]
    rows = quality.quality_rules(make_docs(clean + junk)).collect()
    assert {r.doc_id for r in rows if r.kept} == {d for d, *_ in clean}


def test_tables_and_lists_stay(make_docs):
    """Symbols that stand alone are layout; those inside words are noise."""
    rng = random.Random(6)
    prose = lambda n: [f"{rng.choice(['lorem', 'ipsum', 'dolor', 'amet'])}{rng.randrange(99)}" for _ in range(n)]
    clean = [(k, " ".join(prose(rng.randint(60, 400))), "en", "a") for k in range(100)]
    cells = lambda n: [" ".join(prose(3)) for _ in range(n)]
    tables = [(200 + k, "\n".join(" | ".join(cells(5)) for _ in range(30)), "en", "a") for k in range(6)]
    lists = [(300 + k, "\n".join(f"* {' '.join(prose(3))}" for _ in range(40)), "en", "a") for k in range(6)]
    noise = [(400 + k, " ".join(f"{w}***" for w in prose(120)), "en", "a") for k in range(6)]
    bars = [(500 + k, " | # " * 60 + " ".join(prose(60)), "en", "a") for k in range(6)]
    rows = [*clean, *tables, *lists, *noise, *bars]
    got = quality.quality_rules(make_docs(rows)).collect()
    check(rows, got)
    assert {r.doc_id for r in got if not r.kept} == {d for d, *_ in noise + bars}
    assert all(r.n_symbols == 120 for r in got if 200 <= r.doc_id < 300)


def cells_of(spark, rows, grp="g"):
    data = [(grp, *map(int, v), n) for v, n in Counter(map(tuple, rows.tolist())).items()]
    return spark.createDataFrame(data, f"grp string, {', '.join(f'{s} long' for s in quality.STATS)}, n long")


def test_more_starts_reach_a_smaller_determinant(spark):
    """Two thirds on a thin slanted sheet, a third in a cluster that pulls medians and quartiles away."""
    rng = np.random.default_rng(5)
    sheet = rng.normal(0, 500, (600, 1)) @ np.array([[1, -1, 1, -1]]) + rng.normal(0, 20, (600, 4))
    cluster = rng.normal(0, 60, (190, 4)) + np.array([900, 900, 900, 900])
    rows = np.concatenate([sheet, cluster]).round().astype(int)
    cells = cells_of(spark, rows)
    got = {}
    for starts in (0, quality.STARTS):
        row = quality.minimum_determinants(cells, starts).collect()
        assert len(row) == 1
        want = smallest_determinant(rows / 256, starts)
        assert row[0].log_det == pytest.approx(log_det(want), abs=1e-9)
        assert [row[0][f"m_{s}"] for s in quality.STATS] == pytest.approx(list(want[0]), abs=1e-9)
        got[starts] = row[0].log_det
    assert got[quality.STARTS] <= got[0]
    # No further step lowers it.
    best = smallest_determinant(rows / 256)
    assert log_det(step(rows / 256, best)) >= log_det(best) - quality.FALL


def test_groups_of_one_vector_and_none(spark):
    one = quality.minimum_determinants(cells_of(spark, np.array([[256, 0, 0, 512]] * 3))).collect()
    assert [one[0][f"m_{s}"] for s in quality.STATS] == [1.0, 0.0, 0.0, 2.0]
    assert one[0].log_det == pytest.approx(2 * sum(map(math.log, quality.FLOORS.values())))
    assert quality.minimum_determinants(cells_of(spark, np.array([[1, 2, 3, 4]])).limit(0)).count() == 0


@pytest.mark.parametrize("text,want", [("a b c a b c", 6), ("a b c d", 0), ("a a a a", 4), ("", 0), ("x a b c y a b c z", 6)])
def test_repeated_words(make_docs, text, want):
    row = quality.base_statistics(make_docs([(1, text, "en", "s")], extra=False)).first()
    assert row.n_repeat_words == want
