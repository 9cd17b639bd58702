import pytest

from streamscore.llm.licences import examples, licence_scan, scan_texts, train
from streamscore.llm.queries import QUERIES

NOTICES = {
    "Licensed under CC BY-NC 4.0.": "cc-by-nc",
    "Released under the MIT License.": "mit",
    "Licensed under the Apache License, Version 2.0.": "apache",
    "This work is licensed under the GNU General Public License, version 3.": "gpl",
}


@pytest.fixture(scope="module")
def model():
    return train(examples(3000, 1))


def test_held_out_paragraphs(model):
    rows = examples(1500, 99)
    _, found = scan_texts([t for t, _ in rows], model)
    right = sum([r["family"] for r in some] == [family] for some, (_, family) in zip(found, rows) if family != "unknown")
    wrong = sum(any(r["family"] != family for r in some) for some, (_, family) in zip(found, rows))
    licences = sum(family != "unknown" for _, family in rows)
    assert right / licences > 0.85 and wrong / len(rows) < 0.02


def test_probabilities_are_calibrated(model):
    _, found = scan_texts([t for t, _ in examples(1500, 98)], model)
    rows = [r for some in found for r in some]
    assert all(0.5 <= r["probability"] <= 1 and r["similarity"] >= 0.6 for r in rows)


def test_query_finds_every_notice(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    got = {r.doc_id: r for r in QUERIES["op8_licence_scan"](spark, sf_dir).collect()}
    assert len(got) == len(docs)
    for d, text in docs:
        lines = [x for x in (text or "").split("\n") if x.encode().strip()]
        families = [NOTICES[x] for x in lines if x in NOTICES]
        assert got[d].n_paragraphs == len(lines)
        assert (got[d].n_licences, got[d].families) == (len(families), ",".join(sorted(set(families))))


def test_odd_rows(make_docs, odd_rows, model):
    rows = [*odd_rows, (50, "x\n\n" + "\nwords here\n".join(NOTICES), "en", "s"), (51, "Mit.\nThe MIT campus\nBSD", "de", "s")]
    got = licence_scan(make_docs(rows), model).collect()
    assert [r.doc_id for r in got] == [r[0] for r in rows]
    by_id = {r.doc_id: r for r in got}
    assert [x.family for x in by_id[50].licences] == list(NOTICES.values())
    assert not by_id[51].licences and by_id[0].n_paragraphs == 0 and by_id[2].n_paragraphs == 0
    assert licence_scan(make_docs([]), model).count() == 0
