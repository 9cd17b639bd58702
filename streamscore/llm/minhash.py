"""MinHash near-dedup by a multi-index Hamming join.

A document's set of word shingles is reduced to a signature of CHUNKS * SYMBOLS
minima of `BITS` bits. Signatures that differ in at most `THRESHOLD` symbols have, by
the pigeonhole principle, a chunk with at most `ERRORS` differing symbols; a document
is listed once for every chunk and every choice of symbols that may differ in it, so
all such pairs share a key. At a similarity of 0.8 a pair exceeds the threshold in
all chunks with a probability below one in a million.

Pairs within a key are not written out. Every document of a key is first compared to
one of them; documents found alike form components. Documents of different components
that share a key are compared after that, block by block, and only links are written.
Every link is confirmed on the full sets.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from streamscore.llm.arrow import slices, spread
from streamscore.llm.components import components, joined_components
from streamscore.llm.substring_dedup import word_hashes
from streamscore.llm.winnow import mixed
from streamscore.llm.words import text_of
from streamscore.sources.storage import stored

CHUNKS = 6
SYMBOLS = 6
ERRORS = 2
BITS = 16
THRESHOLD = CHUNKS * (ERRORS + 1) - 1
SIMILARITY = 80  # per cent
BLOCK = 256
SEED = 7
STEP = np.uint64(0x9E3779B97F4A7C15)


def shingle_sets(texts: list[str], words: int) -> list[np.ndarray]:
    """Sorted distinct hashes of all shingles of `words` words of each text.

    A-Z are lower-cased. A text with fewer words is one shingle, one without is empty.
    """
    parts = [x.encode().lower().split() for x in texts]  # changes and splits ASCII only
    flat = word_hashes([w for part in parts for w in part])
    out, at = [], 0
    for part in parts:
        own = flat[at : at + len(part)]
        at += len(part)
        n = min(words, len(part))
        hashes = np.zeros(len(part) - n + 1 if n else 0, np.uint64)
        for k in range(n):
            hashes = hashes * STEP + own[k : k + len(hashes)]
        out.append(np.unique(mixed(hashes + np.uint64(n))))
    return out


def signature(shingles: np.ndarray) -> np.ndarray:
    """Smallest value of each of CHUNKS * SYMBOLS hash functions, cut to BITS bits."""
    draw = np.random.default_rng(SEED).integers(0, 1 << 63, CHUNKS * SYMBOLS, np.uint64)
    factors = draw << np.uint64(1) | np.uint64(1)
    smallest = np.empty(len(factors), np.uint64)
    for k, factor in enumerate(factors):
        smallest[k] = (shingles * factor).min()
    return (mixed(smallest) & np.uint64((1 << BITS) - 1)).astype(np.int32)


def _signed(docs: DataFrame, words: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", 1 << 20):
                sizes, low, high, signatures = [], [], [], []
                for own in shingle_sets(part.column("text").to_pylist(), words):
                    digest = xxhash.xxh3_128_intdigest(own.tobytes())
                    sizes.append(len(own))
                    low.append((digest & (1 << 64) - 1) - (1 << 63))
                    high.append((digest >> 64) - (1 << 63))
                    signatures.append(signature(own).tolist() if len(own) else [])
                columns = [part.column("doc_id"), part.column("own"), pa.array(sizes, pa.int64())]
                columns += [pa.array(low, pa.int64()), pa.array(high, pa.int64())]
                columns.append(pa.array(signatures, pa.list_(pa.int32())))
                yield pa.RecordBatch.from_arrays(
                    columns, ["doc_id", "own", "n", "set_low", "set_high", "signature"]
                )

    schema = "doc_id long, own long, n long, set_low long, set_high long, signature array<int>"
    return docs.mapInArrow(run, schema)


def _keys(signed: DataFrame) -> DataFrame:
    """(key, node, n): one row per chunk and choice of symbols that must agree."""
    kept = list(combinations(range(SYMBOLS), SYMBOLS - ERRORS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 2000):
                part = batch.slice(start, 2000)
                flat = part.column("signature").flatten().to_numpy().astype(np.uint64)
                grid = flat.reshape(part.num_rows, CHUNKS, SYMBOLS)
                keys = []
                for chunk in range(CHUNKS):
                    for number, places in enumerate(kept):
                        packed = np.zeros(part.num_rows, np.uint64)
                        for place in places:
                            packed = packed << np.uint64(BITS) | grid[:, chunk, place]
                        salt = mixed(np.array([chunk * len(kept) + number + 1], np.uint64))
                        keys.append(mixed(packed ^ salt))
                repeat = pa.array(np.tile(np.arange(part.num_rows), len(keys)))
                columns = [pa.array(np.concatenate(keys).view(np.int64))]
                columns += [part.column(c).take(repeat) for c in ("node", "n")]
                yield pa.RecordBatch.from_arrays(columns, ["key", "node", "n"])

    return signed.mapInArrow(run, "key long, node long, n long")


def _near(pairs: DataFrame, signed: DataFrame) -> DataFrame:
    """Pairs (a, b) whose signatures differ in at most THRESHOLD symbols."""
    side = lambda c: signed.select(F.col("node").alias(c), F.col("signature").alias(f"s{c}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    differ = F.zip_with("sa", "sb", lambda x, y: F.when(x != y, 1).otherwise(0))
    count = F.aggregate(differ, F.lit(0), lambda total, x: total + x)
    return both.filter(count <= THRESHOLD).select("a", "b")


def _confirmed(pairs: DataFrame, texts: DataFrame, words: int, similarity: int) -> DataFrame:
    """Pairs whose full sets have the similarity."""
    side = lambda c: texts.select(F.col("own").alias(c), F.col("text").alias(f"t{c}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "ta", 1 << 20):
                left, right = part.column("ta").to_pylist(), part.column("tb").to_pylist()
                distinct = list(dict.fromkeys(left + right))
                sets = dict(zip(distinct, shingle_sets(distinct, words)))
                good = []
                for x, y in zip(left, right):
                    s, t = sets[x], sets[y]
                    common = len(s) + len(t) - len(np.union1d(s, t))
                    good.append(100 * common >= similarity * (len(s) + len(t) - common))
                yield part.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    return both.mapInArrow(run, "a long, b long")


def _pairs(rows: DataFrame, similarity: int) -> DataFrame:
    """Distinct pairs (a, b) out of rows a, na, b, nb whose sizes allow the similarity."""
    small, large = F.least("na", "nb"), F.greatest("na", "nb")
    fits = 100 * small >= similarity * large
    return rows.filter(fits).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _first_links(rows: list[tuple], words: int, similarity: int) -> list[tuple[int, int]]:
    """Links of a block: for every query one to each other component that it reaches."""
    sets = shingle_sets([row[5].decode() for row in rows], words)
    sizes = np.fromiter(map(len, sets), np.int64, len(sets))
    labels = np.array([row[4] for row in rows])
    queries = [k for k, row in enumerate(rows) if row[3]]
    held = np.array([k for k, row in enumerate(rows) if not row[3]], np.int64)
    if not queries or not len(held):
        return []
    # Which of the held sets have a shingle: ranges of a list sorted by shingle.
    flat = np.concatenate([sets[k] for k in held])
    owner = np.repeat(np.arange(len(held)), sizes[held])
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    out = []
    for k in queries:
        first, last = np.searchsorted(flat, sets[k]), np.searchsorted(flat, sets[k], "right")
        common = np.bincount(owner[spread(first, last - first)], minlength=len(held))
        linked = 100 * common >= similarity * (sizes[k] + sizes[held] - common)
        linked &= labels[held] != labels[k]
        hits = np.flatnonzero(linked)
        _, one = np.unique(labels[held[hits]], return_index=True)
        out += [(rows[k][6], rows[held[h]][6]) for h in hits[one]]
    return out


def _between(
    members: DataFrame, labels: DataFrame, texts: DataFrame, words: int, similarity: int
) -> DataFrame:
    """Links between different components that share a key.

    Each key with several components is given to the largest of them. Its documents
    of other components are the queries of that component; they are compared with
    all its documents and with each other, in blocks of about `BLOCK` by `BLOCK`
    documents that spread over all tasks. No pair is written out unless it is a link.
    """
    nodes = members.select("node").distinct().join(labels, "node", "left")
    nodes = stored(nodes.withColumn("label", F.coalesce("label", "node")), "minhash-labelled")
    sizes = stored(nodes.groupBy("label").agg(F.count("*").alias("size")), "minhash-sizes")
    placed = members.select("key", "node").join(nodes, "node").join(sizes, "label")
    per_key = placed.groupBy("key").agg(
        F.max(F.struct("size", "label"))["label"].alias("main"),
        F.min("label").alias("lo"),
        F.max("label").alias("hi"),
    )
    per_key = stored(per_key.filter("lo < hi").select("key", "main"), "minhash-mixed")
    queries = placed.join(per_key, "key").filter("label <> main").select("main", "node", "label")
    queries = stored(queries.distinct(), "minhash-queries")
    mains = queries.select("main").distinct()
    held = nodes.join(mains, F.col("label") == F.col("main")).select("main", "node", "label")
    held = held.unionByName(queries)
    blocks = lambda rows, name: rows.groupBy("main").agg(
        F.ceil(F.count("*") / BLOCK).cast("int").alias(name)
    )
    counts = stored(blocks(queries, "rows").join(blocks(held, "columns"), "main"), "minhash-blocks")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    own = lambda n: F.pmod(F.xxhash64("node"), F.col(n)).cast("int")
    asked = queries.join(counts, "main").select(
        "main", own("rows").alias("i"), every("columns").alias("j"), F.lit(True).alias("asks"), "label", "node"
    )
    given = held.join(counts, "main").select(
        "main", every("rows").alias("i"), own("columns").alias("j"), F.lit(False).alias("asks"), "label", "node"
    )
    rows = asked.unionByName(given).join(
        texts.select(F.col("own").alias("node"), F.col("text").cast("binary").alias("text")), "node"
    )
    block = ["main", "i", "j"]
    names = [*block, "asks", "label", "text", "node"]
    rows = rows.select(names).repartition(*block).sortWithinPartitions(*block)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, now = [], None
        for batch in batches:
            for row in zip(*(batch.column(n).to_pylist() for n in names)):
                if row[:3] != now and group:
                    yield _linked(_first_links(group, words, similarity))
                    group = []
                now = row[:3]
                group.append(row)
        if group:
            yield _linked(_first_links(group, words, similarity))

    return rows.mapInArrow(run, "a long, b long").distinct()


def _linked(links: list[tuple[int, int]]) -> pa.RecordBatch:
    a, b = zip(*links) if links else ((), ())
    return pa.RecordBatch.from_pydict({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})


def _own() -> Column:
    """The id, or for a null id a negative number made from the text."""
    return F.coalesce("doc_id", -1 - F.xxhash64(text_of()).bitwiseAND((1 << 63) - 1))


def _grouped(docs: DataFrame, words: int, similarity: int) -> tuple[DataFrame, DataFrame]:
    """Rows of doc_id, own, text as doc_id, own, n, label, and those without shingles as doc_id, own, n.

    Rows of a label can be reached from each other over links; rows that share `own`
    count as linked.
    """
    signed = stored(_signed(docs, words), "minhash-signed")
    full = signed.filter("n > 0")
    # What is aggregated is written before it is joined: a join of two plain shuffles
    # can split a key with very many rows.
    classes = full.groupBy("set_low", "set_high").agg(F.min("own").alias("node"))
    classes = stored(classes, "minhash-classes")
    placed = stored(full.join(classes, ["set_low", "set_high"]), "minhash-placed")
    nodes = placed.filter("own = node").dropDuplicates(["node", "set_low", "set_high"])
    nodes = stored(nodes.select("node", "n", "signature"), "minhash-nodes")

    keys = _keys(nodes)
    shared = keys.groupBy("key").agg(F.min("node").alias("lo"), F.max("node").alias("hi"))
    shared = stored(shared.filter("lo < hi").drop("hi"), "minhash-shared")
    members = stored(keys.join(shared, "key"), "minhash-members")
    needed = members.select(F.col("node").alias("own")).distinct()
    texts = stored(
        docs.select("own", "text").join(needed, "own", "left_semi").distinct(), "minhash-texts"
    )

    # Every member of a key against the first one.
    stars = members.filter("node <> lo").select(F.col("node").alias("a"), F.col("lo").alias("b")).distinct()
    sizes = lambda c: nodes.select(F.col("node").alias(c), F.col("n").alias(f"n{c}"))
    stars = _pairs(stars.join(sizes("a"), "a").join(sizes("b"), "b"), similarity)
    links = stored(_confirmed(_near(stars, nodes), texts, words, similarity), "minhash-links")
    labels = components(links)

    more = stored(_between(members, labels, texts, words, similarity), "minhash-more")
    labels = joined_components(labels, more)

    grouped = placed.select("doc_id", "own", "n", "node").join(labels, "node", "left")
    grouped = grouped.withColumn("label", F.coalesce("label", "node")).drop("node")
    return grouped, signed.filter("n = 0").select("doc_id", "own", "n")


def near_duplicates(docs: DataFrame, words: int = 2, similarity: int = SIMILARITY) -> DataFrame:
    """One row per row of `docs`: doc_id, n_shingles, component_id, kept.

    Documents are linked if 100 * |common shingles| >= similarity * |all shingles|.
    component_id is the smallest doc_id that can be reached over links, kept tells
    whether it is the document's own. Null texts and texts without words have no
    shingles and are linked with nothing. A null id is no smallest one: a group has a
    null component_id only if all its ids are null, and keeps all of them then. Rows
    that share an id count as linked. An empty table gives an empty result. Only
    doc_id and text are read.
    """
    docs = docs.select("doc_id", _own().alias("own"), text_of().alias("text"))
    grouped, empty = _grouped(docs, words, similarity)
    firsts = stored(grouped.groupBy("label").agg(F.min("doc_id").alias("component_id")), "minhash-firsts")
    found = grouped.join(firsts, "label").select("doc_id", "n", "component_id")
    empty = empty.select("doc_id", "n", F.col("doc_id").alias("component_id"))
    return found.unionByName(empty).select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        "component_id",
        F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"),
    )


def distinct_documents(docs: DataFrame, words: int = 5, similarity: int = SIMILARITY) -> DataFrame:
    """The rows of `docs` that stay when one document of each group of near copies stays.

    That is the one with the smallest id, and of rows that share it in this group the
    one with the smallest text. Rows are judged by their texts: unlike texts that share
    an id, null too, are documents of their own. Rows without an id stay if no row of
    their group has one, one of each text. Texts without words stay, one of each id
    and text. Columns stay as they are.
    """
    text_hash = F.xxhash64(text_of())
    shared = docs.filter("doc_id is not null").groupBy("doc_id")
    shared = shared.agg(F.min(text_hash).alias("lo"), F.max(text_hash).alias("hi"))
    shared = stored(shared.filter("lo <> hi").select(F.col("doc_id").alias("clash")), "minhash-shared-ids")
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    of_text = -1 - F.xxhash64("row.doc_id", text_of("row.text")).bitwiseAND((1 << 63) - 1)
    rows = docs.select(row).join(shared, F.col("row.doc_id") == F.col("clash"), "left")
    own = F.when(F.col("clash").isNotNull(), of_text).otherwise(F.coalesce("row.doc_id", of_text))
    rows = rows.select("row", own.alias("own"))
    grouped, _ = _grouped(
        rows.select(F.col("row.doc_id").alias("doc_id"), "own", text_of("row.text").alias("text")), words, similarity
    )
    firsts = stored(grouped.groupBy("label").agg(F.min("doc_id").alias("component_id")), "minhash-firsts")
    judged = stored(grouped.join(firsts, "label").select("doc_id", "own", "label", "component_id"), "minhash-judged")
    kept = F.col("doc_id").eqNullSafe(F.col("component_id"))
    gone = stored(judged.filter(~kept).select("own").distinct(), "minhash-gone")
    # Texts that share the smallest id of their group take turns.
    again = judged.filter(kept & (F.col("doc_id") != F.col("own"))).select("own", "label").distinct()
    again = stored(again, "minhash-again")
    left = rows.join(gone, "own", "left_anti").join(again, "own", "left")
    order = Window.partitionBy(F.coalesce("label", "own")).orderBy("row.text")
    one = left.withColumn("turn", F.row_number().over(order)).filter("turn = 1")
    return one.select("row.*")
