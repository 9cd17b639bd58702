"""Ranked lexical search by the Best Position Algorithm over lists ordered by impact.

Documents are read once per block of queries: a task keeps the terms that occur in the
block's queries, with their counts, and the length of every document. Sums over those
give the statistics of the whole table. Then each task turns its documents into shards: a
list per term, ordered by impact, and the position of every document in every list.

A query reads its lists from the top. Each document it meets is scored in full by direct
accesses, which also mark its positions in the other lists as seen. The best position of
a list ends its contiguous run of seen positions; no unseen document can score more than
the sum of the impacts there. Reading stops once that sum is strictly below the k-th
best score, so that equal scores are never missed. A task carries the best documents from
shard to shard, and best lists of tasks are merged in two steps.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from streamscore.llm.arrow import cut, slices
from streamscore.sources.storage import stored

TOP = 20
#: Distinct terms of queries, summed over queries, that one pass over the documents serves.
BLOCK_TERMS = 1 << 18
#: Postings after which a task searches what it has gathered.
SHARD_POSTINGS = 1 << 20
FIRST_DEPTH = 32
FOUND = "query long, item_id long, doc_id long, score long"

# A-Z become a-z; ASCII characters other than letters and digits separate terms.
_LETTERS = bytes(c if chr(c).isalnum() else 32 for c in range(128)).lower()
TERM_BYTES = _LETTERS + bytes(range(128, 256))


def terms_of(text: bytes) -> Iterator[list[bytes]]:
    """The terms of a text, a part of it at a time."""
    for part in cut(text.translate(TERM_BYTES)):
        yield part.split()


def _query_terms(batches) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column("text").cast(pa.large_binary()).to_pylist()
        counts = [Counter(t for part in terms_of(text or b"") for t in part) for text in texts]
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("item_id"),
                batch.column("query"),
                pa.array([list(c) for c in counts], pa.list_(pa.binary())),
                pa.array([list(c.values()) for c in counts], pa.list_(pa.int64())),
            ],
            names=["item_id", "query", "terms", "counts"],
        )


def _postings(batches, numbers: dict[bytes, int]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, "text"):
            ids, lengths, terms, counts = [], [], [], []
            texts = part.column("text").cast(pa.large_binary()).to_pylist()
            for doc_id, text in zip(part.column("doc_id").to_pylist(), texts, strict=True):
                n, found = 0, Counter()
                for words in terms_of(text or b""):
                    n += len(words)
                    found.update(filter(numbers.__contains__, words))
                if n:
                    pairs = sorted((numbers[t], tf) for t, tf in found.items())
                    table = np.array(pairs, np.int64).reshape(-1, 2)
                    ids.append(doc_id)
                    lengths.append(n)
                    terms.append(table[:, 0].astype(np.int32).tobytes())
                    counts.append(table[:, 1].tobytes())
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(ids, pa.int64()),
                    pa.array(lengths, pa.int64()),
                    pa.array(terms, pa.binary()),
                    pa.array(counts, pa.binary()),
                ],
                names=["doc_id", "n", "terms", "counts"],
            )


def _joined(column: pa.Array, dtype) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype)


def _document_counts(batches, size: int) -> Iterator[pa.RecordBatch]:
    df = np.zeros(size, np.int64)
    for batch in batches:
        df += np.bincount(_joined(batch.column("terms"), np.int32), minlength=size)
    there = np.flatnonzero(df)
    yield pa.RecordBatch.from_arrays([pa.array(there), pa.array(df[there])], names=["term", "df"])


class Shard:
    """Impact lists of some documents and the positions of documents in them."""

    def __init__(self, docs: np.ndarray, terms: np.ndarray, impacts: np.ndarray, n_docs: int, n_terms: int):
        self.n_docs, self.n_terms = n_docs, n_terms
        self.keys = docs * n_terms + terms  # ascending, for direct access
        self.impacts = impacts
        order = np.lexsort((docs, -impacts, terms))
        self.starts = np.searchsorted(terms[order], np.arange(n_terms + 1))
        self.list_docs, self.list_impacts = docs[order], impacts[order]
        self.positions = np.empty(len(order), np.int64)
        self.positions[order] = np.arange(len(order))  # in all lists laid end to end

    def search(self, terms: np.ndarray, times: np.ndarray, best: Best) -> None:
        """Offer the documents that may be among the best for a query to `best`."""
        lows, highs = self.starts[terms], self.starts[terms + 1]
        full = lows < highs
        terms, times, lows, highs = terms[full], times[full], lows[full], highs[full]
        if not len(terms):
            return
        bases = lows - np.concatenate([[0], np.cumsum(highs - lows)])[:-1]
        seen = np.zeros((highs - lows).sum(), bool)  # positions of this query's lists
        met = np.zeros(self.n_docs, bool)
        at, depth, step, longest = lows.copy(), 0, FIRST_DEPTH, (highs - lows).max()
        while depth < longest:
            read = [self.list_docs[a + depth : min(a + depth + step, b)] for a, b in zip(lows, highs, strict=True)]
            new = np.unique(np.concatenate(read))
            new = new[~met[new]]
            met[new] = True
            wanted = (new[:, None] * self.n_terms + terms).ravel()
            found = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
            hit = self.keys[found] == wanted
            places = (self.positions[found] - np.tile(bases, len(new)))[hit]
            seen[places] = True
            parts = np.where(hit, self.impacts[found], 0).reshape(len(new), -1)
            best.offer(new, parts @ times)
            depth += step
            step *= 2
            bound = 0
            for i in range(len(terms)):
                ahead = seen[at[i] - bases[i] : highs[i] - bases[i]]
                run = int(ahead.argmin()) if len(ahead) else 0
                at[i] = highs[i] if len(ahead) == 0 or ahead[run] else at[i] + run
                if at[i] < highs[i]:
                    bound += int(times[i]) * int(self.list_impacts[at[i] - 1])
            if bound < best.least or not bound:
                return


class Best:
    """The k best of the documents offered, equal scores by id, null ids last."""

    def __init__(self, k: int):
        self.k = k
        self.scores = self.ids = np.zeros(0, np.int64)
        self.nulls = np.zeros(0, bool)
        self.least = 0

    def shard(self, ids: np.ndarray, nulls: np.ndarray) -> Best:
        self.shard_ids, self.shard_nulls = ids, nulls
        return self

    def offer(self, docs: np.ndarray, scores: np.ndarray) -> None:
        good = (scores > 0) & (scores >= self.least)
        docs = docs[good]
        scores = np.concatenate([self.scores, scores[good]])
        ids = np.concatenate([self.ids, self.shard_ids[docs]])
        nulls = np.concatenate([self.nulls, self.shard_nulls[docs]])
        order = np.lexsort((ids, nulls, -scores))[: self.k]
        self.scores, self.ids, self.nulls = scores[order], ids[order], nulls[order]
        self.least = int(self.scores[-1]) if len(order) == self.k else 0


def _search(batches, queries, weights: np.ndarray, n_docs: int, n_terms: int, k: int):
    best = [Best(k) for _ in queries]
    gathered, size = [], 0

    def run() -> None:
        rows = pa.Table.from_batches(gathered).combine_chunks()
        ids = rows.column("doc_id")
        nulls = np.asarray(ids.is_null())
        ids = ids.fill_null(0).to_numpy()
        m = np.array([75 + 25 * n * n_docs // n_terms for n in rows.column("n").to_pylist()], np.int64)
        sizes = np.array([len(t) // 4 for t in rows.column("terms").to_pylist()])
        terms = _joined(rows.column("terms"), np.int32).astype(np.int64)
        tf = _joined(rows.column("counts"), np.int64)
        docs = np.repeat(np.arange(len(ids)), sizes)
        impacts = weights[terms] * (1_000_000_000 * tf // (1000 * tf + 12 * m[docs]))
        some = impacts > 0
        if some.any():
            shard = Shard(docs[some], terms[some], impacts[some], len(ids), len(weights))
            for query, (_, _, q_terms, q_counts) in enumerate(queries):
                shard.search(q_terms, q_counts, best[query].shard(ids, nulls))

    for batch in batches:
        gathered.append(batch)
        size += batch.column("terms").nbytes // 4
        if size >= SHARD_POSTINGS:
            run()
            gathered, size = [], 0
    if gathered:
        run()
    for (item_id, query, _, _), found in zip(queries, best, strict=True):
        n = len(found.ids)
        if n:
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([query] * n, pa.int64()),
                    pa.array([item_id] * n, pa.int64()),
                    pa.array(found.ids, mask=found.nulls),
                    pa.array(found.scores),
                ],
                names=["query", "item_id", "doc_id", "score"],
            )


def _in_blocks(queries: DataFrame, limit: int) -> tuple[DataFrame, int]:
    """Query terms with a block number; a block has `limit` terms at most, or one query."""
    texts = queries.select(F.col("item_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    texts = texts.distinct().withColumn("query", F.xxhash64("text"))
    schema = "item_id long, query long, terms array<binary>, counts array<long>"
    terms = stored(texts.mapInArrow(_query_terms, schema).filter(F.size("terms") > 0), "queries")
    size = F.size("terms")
    total = terms.agg(F.coalesce(F.sum(size), F.lit(0)).alias("n")).first().n
    blocks = max(1, -(-total // limit))
    while True:
        numbered = terms.withColumn("block", F.pmod(F.xxhash64("item_id", "query"), F.lit(blocks)))
        sizes = numbered.groupBy("block").agg(F.sum(size).alias("n"), F.count("*").alias("queries"))
        if not sizes.filter((F.col("n") > limit) & (F.col("queries") > 1)).count():
            return numbered, blocks
        blocks *= 2


def _block(docs: DataFrame, rows: list, k: int) -> DataFrame:
    """The best documents of each task for the queries of one block."""
    vocabulary = sorted({bytes(t) for row in rows for t in row.terms})
    numbers = {t: i for i, t in enumerate(vocabulary)}
    queries = [
        (row.item_id, row.query, np.array([numbers[bytes(t)] for t in row.terms]), np.array(row.counts))
        for row in rows
    ]
    postings = stored(
        docs.mapInArrow(
            partial(_postings, numbers=numbers), "doc_id long, n long, terms binary, counts binary"
        ),
        "postings",
    )
    whole = postings.agg(F.count("*").alias("docs"), F.sum("n").alias("terms")).first()
    counts = postings.select("terms").mapInArrow(
        partial(_document_counts, size=len(vocabulary)), "term long, df long"
    )
    weights = np.zeros(len(vocabulary), np.int64)
    for row in counts.groupBy("term").agg(F.sum("df").alias("df")).collect():  # a row per query term
        weights[row.term] = math.floor(1000 * math.log((2 * whole.docs + 2) / (2 * row.df + 1)))
    search = partial(
        _search, queries=queries, weights=weights, n_docs=whole.docs, n_terms=whole.terms or 1, k=k
    )
    return postings.mapInArrow(search, FOUND)


def ranked_search(docs: DataFrame, queries: DataFrame, k: int = TOP, block_terms: int = BLOCK_TERMS) -> DataFrame:
    """item_id, rank, doc_id and score of the `k` best documents for each query.

    A row of `queries` (item_id, text) is a query; equal rows are one query, and rows that share an
    id only are ranked each, told apart by the column `query`. Rows of `docs` (doc_id, text) are
    documents of their own, whatever their ids; equal scores rank by id, null ids last. Null and
    empty texts have no terms: such documents are never found or counted, such queries find
    nothing, as does an empty table. Other columns are ignored.
    """
    docs = docs.select(F.col("doc_id").cast("long"), "text")
    numbered, blocks = _in_blocks(queries, block_terms)
    found = None
    for block in range(blocks):  # each block's queries meet all documents
        rows = numbered.filter(F.col("block") == block).orderBy("item_id", "query").collect()
        part = _block(docs, rows, k)
        found = part if found is None else found.unionByName(part)
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
    salted = Window.partitionBy("item_id", "query", "part").orderBy(*order)
    whole = Window.partitionBy("item_id", "query").orderBy(*order)
    return (
        found.withColumn("part", F.pmod(F.spark_partition_id(), F.lit(64)))
        .withColumn("rank", F.row_number().over(salted))
        .filter(F.col("rank") <= k)
        .withColumn("rank", F.row_number().over(whole))
        .filter(F.col("rank") <= k)
        .select("item_id", "rank", "doc_id", "score", "query")
    )
