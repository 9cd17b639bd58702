"""Repeated stretches of documents: finding segments, fetching them, removing spans.

Shared by the dedup of bytes and of words. A document is known by doc_id and `th`, a
64-bit hash of its text. A span is one number, start << 24 | length.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from streamscore.llm import winnow
from streamscore.llm.arrow import slices
from streamscore.llm.words import text_of

SEGMENTS = "anchor long, segment long, doc_id long, th long, pack long"
SPANS = "doc_id long, th long, span long"
RESULTS = ["n_units", "n_removed", "n_spans", "kept"]


def identified(docs: DataFrame) -> DataFrame:
    """doc_id, text (empty for null), th, and the other columns in `row`."""
    others = [F.col(f"`{c}`") for c in docs.columns if c not in ("text", *RESULTS)]
    th = F.xxhash64(text_of())
    return docs.select("doc_id", text_of().alias("text"), th.alias("th"), F.struct(*others).alias("row"))


def first_window(pack: str) -> Column:
    return F.shiftright(pack, 18)


def whole(pack: str, window: int) -> Column:
    """The span of all windows of a segment."""
    count = F.shiftright(pack, 9).bitwiseAND(511)
    return F.shiftleft(first_window(pack), 24).bitwiseOR(count + window)


def segments(docs: DataFrame, symbols: Callable, window: int, gram: int) -> DataFrame:
    """One row per segment (see winnow) of every text of `identified` documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                flat, lengths = symbols(part.column("text").to_pylist())
                owner, anchor, segment, first, count, lead = winnow.segments(flat, lengths, window, gram)
                take = pa.array(owner)
                columns = [
                    pa.array(anchor.view(np.int64)),
                    pa.array(segment.view(np.int64)),
                    part.column("doc_id").take(take),
                    part.column("th").take(take),
                    pa.array(winnow.pack(first, count, lead)),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["anchor", "segment", "doc_id", "th", "pack"])

    return docs.select("doc_id", "text", "th").mapInArrow(run, SEGMENTS)


def fetch(
    docs: DataFrame, wanted: DataFrame, cut: Callable, window: int, made: Callable | None = None, schema: str = ""
) -> DataFrame:
    """`wanted` segments (anchor, segment, doc_id, th, pack and more) with their `content`.

    Each text is shuffled once and meets the list of the segments wanted from it,
    which is no longer than the text has segments. cut(text, starts, ends) gives the
    content of each span. A document that is repeated gives its segments each time.
    With `made`, rows of `schema` come instead: those of the batches made(columns, contents),
    by the same Python worker, where an operator behind this one would take a second.
    """
    fields = [c for c in wanted.columns if c not in ("doc_id", "th")]
    lists = wanted.groupBy("doc_id", "th").agg(F.collect_list(F.struct(*fields)).alias("wanted"))
    joined = match(docs.select("doc_id", "th", "text"), lists, "inner")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", 1 << 20):
                lists = part.column("wanted")
                flat = lists.flatten()
                owner = np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy())
                columns = {c: flat.field(c) for c in fields}
                start, more = winnow.unpacked(columns["pack"].to_numpy())
                end = start + more + window
                content, cuts = [], np.searchsorted(owner, np.arange(len(lists) + 1))
                for k, text in enumerate(part.column("text").to_pylist()):
                    some = slice(cuts[k], cuts[k + 1])
                    content += cut(text, start[some], end[some])
                columns |= {c: part.column(c).take(pa.array(owner)) for c in ("doc_id", "th")}
                if made is None:
                    columns["content"] = pa.array(content, pa.binary())
                    yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))
                else:
                    yield from made(columns, content)

    plain = wanted.select(*fields, "doc_id", "th").withColumn("content", F.lit(None).cast("binary")).schema
    return joined.mapInArrow(run, schema if made else plain)


def match(docs: DataFrame, rows: DataFrame, how: str) -> DataFrame:
    """Joins documents to rows of the same doc_id (null matches null) and th."""
    d, r = docs.alias("d"), rows.alias("r")
    same = F.col("d.doc_id").eqNullSafe(F.col("r.doc_id")) & (F.col("d.th") == F.col("r.th"))
    extra = [f"r.{c}" for c in rows.columns if c not in ("doc_id", "th")]
    return d.join(r, same, how).select("d.*", *extra)


def merged(spans: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the union of spans."""
    if not len(spans):
        return spans, spans
    spans = np.sort(spans)
    starts = spans >> 24
    ends = np.maximum.accumulate(starts + (spans & ((1 << 24) - 1)))
    new = np.concatenate([[True], starts[1:] > ends[:-1]])
    last = np.concatenate([np.flatnonzero(new)[1:] - 1, [len(spans) - 1]])
    return starts[new], ends[last]


def remove(docs: DataFrame, spans: DataFrame, cut: Callable) -> DataFrame:
    """Other columns of `identified` documents, text, n_units, n_removed, n_spans and kept.

    cut(text, starts, ends) returns the units of the text, how many of them the spans
    cover, and the bytes that remain.
    """
    lists = spans.groupBy("doc_id", "th").agg(F.collect_list("span").alias("spans"))
    joined = match(docs, lists, "left").select("text", "spans", "row")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                units, removed, n_spans, kept = [], [], [], []
                lists = part.column("spans")
                for k, text in enumerate(part.column("text").to_pylist()):
                    found = lists[k].values
                    own = found.to_numpy() if found is not None else np.zeros(0, np.int64)
                    starts, ends = merged(own)
                    n, gone, rest = cut(text, starts, ends)
                    units.append(n)
                    removed.append(gone)
                    n_spans.append(len(starts))
                    kept.append(rest)
                columns = [part.column("row"), part.column("text")]
                columns += [pa.array(c, pa.int64()) for c in (units, removed, n_spans)]
                columns.append(pa.array(kept, pa.binary()))
                yield pa.RecordBatch.from_arrays(columns, ["row", "text", *RESULTS])

    schema = joined.select(
        "row", "text", *[F.lit(0).cast("long").alias(c) for c in RESULTS[:3]], F.lit(None).cast("binary").alias("kept")
    ).schema
    return joined.mapInArrow(run, schema).select("row.*", "text", *RESULTS)
