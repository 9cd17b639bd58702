import base64
import hashlib
from collections import Counter

import numpy as np
import public_tokenizers
import tiktoken

import corpus_pipeline
from streamscore.llm.mixing import mix
from streamscore.sources.storage import stored
from .test_llm_groups import brute as near_groups
from .test_llm_quality import judged
from .test_llm_repeats import brute_passages


def test_stages_against_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns = docs.columns
    before = [tuple(r) for r in docs.select("doc_id", "text", "lang", "source").collect()]
    for number, (_, stage) in enumerate(corpus_pipeline.STAGES):
        result = stored(stage(spark, docs, sf_dir), "test-stage")
        if number < 4:
            assert result.columns == columns
            after = [tuple(r) for r in result.select("doc_id", "text", "lang", "source").collect()]
        if number == 0:
            assert sorted(after) == sorted(r for r, (_, _, kept) in zip(before, judged(before)) if kept)
        elif number == 1:
            groups = near_groups([r[:2] for r in before], 5)
            assert sorted(after) == sorted(r for r, (_, first) in zip(before, groups) if r[0] == first)
        elif number == 2:
            want = brute_passages([r[1] for r in before], 200, 50)
            assert sorted(r[:2] for r in after) == sorted((r[0], w) for r, w in zip(before, want))
        elif number == 3:
            taken = Counter({r.doc_id: r.taken for r in mix(docs).collect()})
            words = Counter()
            for doc_id, text, *_ in after:
                words[doc_id] += len(text.encode().split())
            assert words == +taken
        else:
            with open(public_tokenizers.path(corpus_pipeline.VOCABULARY), "rb") as f:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            encoding = tiktoken.Encoding(
                "test", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}
            )
            digest = lambda b: hashlib.sha256(b).hexdigest()
            pack = lambda t: np.array(encoding.encode_ordinary(t), "<u4").tobytes()
            want = Counter((d, digest(pack(t)), digest(t.encode())) for d, t, *_ in before)
            rows = result.select("doc_id", "ids_sha256", "decoded_sha256").collect()
            assert Counter(map(tuple, rows)) == want
            return
        docs, before = result, after


def test_odd_rows_pass_every_stage(spark, sf_dir, make_docs, odd_rows):
    for rows in (odd_rows, []):
        docs = make_docs(rows)
        for number, (_, stage) in enumerate(corpus_pipeline.STAGES):
            out = stored(stage(spark, docs, sf_dir), "test-odd")
            if number < 4:
                assert out.columns == docs.columns
            else:
                assert out.filter("n_tokens * 4 <> length(tokens)").count() == 0
            docs = out if number else docs  # later stages see the odd rows, too
