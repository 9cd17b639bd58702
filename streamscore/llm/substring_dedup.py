"""Substring dedup: words covered by long windows that start in an earlier document.

Levels double in length. At the first level, windows of half the final length are
looked at, one per final window: the one with the smallest hash in it, so that equal
final windows always look at the same place. Only those found in several documents
are extended to twice the length; segments (see winnow) that occur as a whole in
an earlier document are settled at once, and the final windows of the others are
compared one by one. Nothing is left to extend after that.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from streamscore.llm import spans
from streamscore.llm.arrow import cut
from streamscore.llm.winnow import BLOCK, Rolling
from streamscore.sources.storage import stored

WINDOW = 50
NO_ID = (1 << 63) - 1


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def text_hashes(text: str) -> np.ndarray:
    """Hashes of the words of a text; the words of long texts are never a list as a whole."""
    # split() splits at 0x20 and 0x09 to 0x0D, as cut() does.
    return np.concatenate([word_hashes(part.split()) for part in cut(text.encode())])


def _symbols(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts one after the other, and how many each has."""
    parts = [text_hashes(x) for x in texts]
    flat = np.concatenate([np.zeros(0, np.uint64), *parts])
    return flat, np.fromiter(map(len, parts), np.int64, len(parts))


def _cut(text: str, starts: np.ndarray, ends: np.ndarray, window: int) -> list[np.ndarray]:
    """Hashes of the windows of each span."""
    flat = text_hashes(text)
    blocks = range(0, len(flat) - window + 1, BLOCK)
    hashes = np.concatenate([Rolling(flat[k : k + BLOCK + window - 1]).windows(window) for k in blocks])
    return [hashes[a : b - window + 1] for a, b in zip(starts, ends)]


def _extended(columns: dict[str, pa.Array], contents: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
    """One row per window of twice the length, with its hash and its offset in the segment."""
    sizes = np.fromiter(map(len, contents), np.int64, len(contents))
    breaks = np.flatnonzero(np.diff(np.cumsum(sizes) >> 18)) + 1
    for some in np.split(np.arange(len(sizes)), breaks):
        counts = sizes[some]
        hashes = np.concatenate([contents[k] for k in some])
        offset = np.arange(len(hashes)) - np.repeat(np.cumsum(counts) - counts, counts)
        take = pa.array(np.repeat(some, counts))
        fixed = [columns[c].take(take) for c in ("anchor", "segment", "first")]
        fixed += [pa.array(hashes.view(np.int64)), pa.array(offset)]
        yield pa.RecordBatch.from_arrays(fixed, ["anchor", "segment", "first", "hash", "offset"])


def repeated_spans(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """Rows doc_id, th, span of windows that also start in a document with a smaller id."""
    order = F.coalesce("doc_id", F.lit(NO_ID))
    rows = spans.segments(docs, _symbols, window, window // 2)
    several = rows.groupBy("anchor").agg(
        F.min(order).alias("lo"), F.max(order).alias("hi"), (F.min("segment") < F.max("segment")).alias("mixed")
    )
    # Written first: a join of two plain shuffles can split an anchor with very many rows.
    several = stored(several.filter("lo < hi").select("anchor", "mixed"), "substring-several")
    found = stored(rows.join(several, "anchor"), "substring-found")
    variants = found.groupBy("anchor", "segment", "mixed").agg(
        F.min(F.struct(order.alias("first"), "doc_id", "th", "pack")).alias("one")
    )
    variants = stored(variants.select("anchor", "segment", "mixed", "one.*"), "substring-segments")
    # The windows of all others, of which the earliest document stands for each segment.
    different = variants.filter("mixed").drop("mixed")
    schema = "anchor long, segment long, first long, hash long, offset long"
    extended = spans.fetch(docs, different, partial(_cut, window=window), window, _extended, schema)
    windows = stored(extended, "substring-windows")
    again = windows.groupBy("anchor", "hash").agg(
        F.min("first").alias("earliest"), F.max("first").alias("latest")
    )
    again = stored(again.filter("earliest < latest").drop("latest"), "substring-again")
    late = windows.join(again, ["anchor", "hash"]).filter(F.col("first") > F.col("earliest"))
    late = late.groupBy("anchor", "segment").agg(F.collect_set("offset").alias("late"))
    # What an earlier document has as a whole goes as a whole. Of a segment's earliest
    # document, the late windows go in every place of the segment.
    firsts = variants.select("anchor", "segment", "first").join(late, ["anchor", "segment"], "left")
    firsts = stored(firsts, "substring-firsts")
    places = found.join(firsts, ["anchor", "segment"]).filter((order > F.col("first")) | F.col("late").isNotNull())
    gone = F.when(order > F.col("first"), F.array(spans.whole("pack", window))).otherwise(
        F.transform("late", lambda x: F.shiftleft(spans.first_window("pack") + x, 24).bitwiseOR(F.lit(window)))
    )
    return places.select("doc_id", "th", F.explode(gone).alias("span"))


def substring_dedup(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """`docs` with n_units (words), n_removed, n_spans and `kept`, the words that remain.

    A word is removed if it lies in a window of `window` words whose sequence also
    starts in a document with a smaller doc_id. Windows are judged on the input. Null
    and empty texts have no words. A null doc_id counts as larger than any other;
    rows that share an id, null too, remove nothing from each other. Other columns
    pass through, except those named like a result. An empty table gives an empty
    result.
    """
    own = spans.identified(docs)
    return spans.remove(own, repeated_spans(own, window), _remove_words)


def _remove_words(text: str, starts: np.ndarray, ends: np.ndarray) -> tuple[int, int, bytes]:
    n, rest = 0, []
    for part in cut(text.encode()):
        words, at, out = part.split(), 0, []
        some = slice(np.searchsorted(ends, n, "right"), np.searchsorted(starts, n + len(words)))
        for a, b in zip(starts[some], ends[some]):
            out += words[at : max(a - n, 0)]
            at = b - n
        out += words[at:]
        if out:
            rest.append(b" ".join(out))
        n += len(words)
    return n, int((ends - starts).sum()), b" ".join(rest)
