"""Suffix-array dedup: bytes covered by long strings that start anywhere else too.

1. Every text is cut into segments of windows that share a content-chosen anchor
   (see winnow). Equal windows have equal anchors, so the windows of an anchor that
   occurs once are unique.
2. Equal segments found twice are repeated as a whole and need no sorting, however
   often they occur.
3. Different segments with the same anchor meet in one task, which sorts their
   suffixes in two stages: those that start at the anchor are sorted directly, and
   those that start a byte earlier are induced from them, byte by byte. Equal windows
   have their anchor at the same place, so suffixes are sorted per distance from the
   anchor. Common prefixes of neighbours in the suffix array, carried along, that reach
   the window length mark repeated windows.
4. Anchors with more than `GROUP` different segments are too large for one task.
   Their windows are compared by hash instead, spread over all tasks.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from streamscore.llm import spans
from streamscore.llm.arrow import slices, spread
from streamscore.llm.winnow import Rolling, unpacked
from streamscore.sources.storage import stored

WINDOW = 400
# Passages of over 50 words: their words have three bytes on average at least.
PASSAGE_WINDOW = 200
PASSAGE_WORDS = 50
GRAM = 128
GROUP = 4000
CHUNK_BYTES = 1 << 21


def suffix_array(text: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes of `text` in the order of their first `depth` bytes at least.

    `text` is uint8 and ends with 0, its smallest value; 0 separates sequences.
    """
    n = len(text)
    nxt = np.concatenate([text[1:], [np.uint8(255)]])
    # A run of equal bytes is smaller than its successors if the byte after it is larger.
    differs = np.flatnonzero(text != nxt)
    smaller = (text < nxt)[differs[np.searchsorted(differs, np.arange(n))]]
    raw = text.tobytes()
    direct = np.flatnonzero(smaller).tolist()
    direct.sort(key=lambda i: raw[i : i + depth])
    direct = np.array(direct, np.int64)
    first = text[direct]
    bounds = np.searchsorted(first, np.arange(257))
    induced: list[list[np.ndarray]] = [[] for _ in range(256)]

    def induce(suffixes: np.ndarray, into: list[list[np.ndarray]]) -> None:
        before = suffixes[suffixes > 0] - 1
        before = before[~smaller[before]]
        if not len(before):
            return
        heads = text[before]
        order = np.argsort(heads, kind="stable")
        before, heads = before[order], heads[order]
        cuts = np.flatnonzero(heads[1:] != heads[:-1]) + 1
        for part, head in zip(np.split(before, cuts), heads[np.concatenate([[0], cuts])]):
            into[head].append(part)

    out = []
    for head in range(256):
        done = 0
        while done < len(induced[head]):  # a bucket may go on growing while it is scanned
            induce(induced[head][done], induced)
            done += 1
        out += induced[head]
        own = direct[bounds[head] : bounds[head + 1]]
        induce(own, induced)
        out.append(own)
    return np.concatenate(out)


def common_prefixes(text: np.ndarray, left: np.ndarray, right: np.ndarray, depth: int) -> np.ndarray:
    """Length of the common prefix of each pair of suffixes, counted up to `depth`."""
    padded = np.concatenate([text, np.zeros(depth + 8, np.uint8)])
    words = np.ndarray((len(padded) - 7,), "<u8", padded, strides=(1,))
    length = np.zeros(len(left), np.int64)
    going = np.arange(len(left))
    for done in range(0, depth - 7, 8):
        going = going[words[left[going] + done] == words[right[going] + done]]
        if not len(going):
            break
        length[going] += 8
    open_ = np.flatnonzero(length < depth)
    for _ in range(8):
        if not len(open_):
            break
        a, b = left[open_] + length[open_], right[open_] + length[open_]
        open_ = open_[padded[a] == padded[b]]
        length[open_] += 1
        open_ = open_[length[open_] < depth]
    return length


def repeated_starts(pieces: list[bytes], counts: list[int], depth: int) -> list[np.ndarray]:
    """Of the first `counts` suffixes of each piece, those whose `depth` bytes start elsewhere too."""
    sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
    text = np.zeros(int(sizes.sum()) + len(pieces), np.uint8)
    begins = np.cumsum(sizes + 1) - sizes - 1
    text[spread(begins, sizes)] = np.frombuffer(b"".join(pieces), np.uint8) + 1
    owner = np.full(len(text), -1, np.int32)
    counts = np.asarray(counts)
    owner[spread(begins, counts)] = np.repeat(np.arange(len(pieces)), counts)
    order = suffix_array(text, depth)
    order = order[owner[order] >= 0]
    same = common_prefixes(text, order[:-1], order[1:], depth) >= depth
    hit = np.sort(order[np.concatenate([same, [False]]) | np.concatenate([[False], same])])
    cuts = np.searchsorted(owner[hit], np.arange(1, len(pieces)))
    return [part - begin for part, begin in zip(np.split(hit, cuts), begins)]


def anchored_starts(
    pieces: list[bytes], groups: np.ndarray, leads: np.ndarray, depth: int
) -> list[np.ndarray]:
    """As `repeated_starts` of all suffixes of `depth` bytes, for pieces with anchors.

    `groups` are ascending numbers of equal anchors, `leads` the places of the anchors in
    the pieces; only starts at the same distance from equal anchors are compared.
    """
    sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
    text = np.frombuffer(b"".join(pieces), np.uint8)
    begins = np.cumsum(sizes) - sizes
    order = sorted(zip(groups.tolist(), (x[a : a + depth] for x, a in zip(pieces, leads.tolist())), range(len(pieces))))
    order = np.array([k for _, _, k in order], np.int64)
    left, right = order[:-1], order[1:]
    # Entry k is the common prefix of places k - 1 and k; across groups there is none.
    common = np.zeros(len(order), np.int64)
    ahead = np.minimum(sizes[left] - leads[left], sizes[right] - leads[right])
    shared = common_prefixes(text, begins[left] + leads[left], begins[right] + leads[right], depth)
    common[1:] = np.where(groups[left] == groups[right], np.minimum(shared, ahead), 0)
    at, anchors = 0, begins + leads
    places, owners = [], []
    while True:
        same = common >= depth
        hit = same | np.append(same[1:], False)
        owners.append(order[hit])
        places.append(leads[order[hit]] - at)
        at += 1
        going = np.flatnonzero(leads[order] >= at)
        if len(going) < 2:
            break
        # Stable: suffixes of one group with the same byte before them keep their order.
        heads = groups[order[going]] << 8 | text[anchors[order[going]] - at]
        sort = np.argsort(heads, kind="stable")
        was, heads = going[sort], heads[sort]
        alike = np.flatnonzero(heads[1:] == heads[:-1]) + 1
        order, before = order[was], common
        common = np.zeros(len(order), np.int64)
        if len(alike):
            # The smallest entry of those between the two places, the second included.
            bounds = np.stack([was[alike - 1] + 1, was[alike] + 1], axis=1).ravel()
            common[alike] = 1 + np.minimum.reduceat(np.append(before, 0), bounds)[::2]
    owners, places = np.concatenate(owners), np.concatenate(places)
    ranked = np.lexsort((places, owners))
    return np.split(places[ranked], np.searchsorted(owners[ranked], np.arange(1, len(pieces))))


def _symbols(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts one after the other, and the length of each."""
    raw = [x.encode() for x in texts]
    return np.frombuffer(b"".join(raw), np.uint8), np.fromiter(map(len, raw), np.int64, len(raw))


def _cut(text: str, starts: np.ndarray, ends: np.ndarray) -> list[bytes]:
    raw = text.encode()
    return [raw[a:b] for a, b in zip(starts, ends)]


def _sorted_groups(window: int):
    """Repeated windows of segments that arrive ordered by their anchor."""

    def resolve(rows: list[tuple]) -> pa.RecordBatch:
        pieces = [row[5] for row in rows]
        _, groups = np.unique([row[0] for row in rows], return_inverse=True)
        leads = np.array([row[3] & 511 for row in rows])
        out = []
        for row, hits in zip(rows, anchored_starts(pieces, groups, leads, window)):
            _, doc_id, th, pack, copies, _ = row
            if copies > 1 or not len(hits):  # segments found twice are removed as a whole
                continue
            cuts = np.flatnonzero(np.diff(hits) > 1) + 1
            start, _ = unpacked(pack)
            first = hits[np.concatenate([[0], cuts])] + start
            last = hits[np.concatenate([cuts - 1, [len(hits) - 1]])] + start
            out += [(doc_id, th, int(x) << 24 | int(y - x + window)) for x, y in zip(first, last)]
        columns = list(zip(*out)) or [[], [], []]
        return pa.RecordBatch.from_arrays(
            [pa.array(c, pa.int64()) for c in columns], ["doc_id", "th", "span"]
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, held, anchor = [], 0, None
        names = ("anchor", "doc_id", "th", "pack", "copies", "content")
        for batch in batches:
            for row in zip(*(batch.column(n).to_pylist() for n in names)):
                if row[0] != anchor and held > CHUNK_BYTES:
                    yield resolve(rows)
                    rows, held = [], 0
                anchor = row[0]
                rows.append(row)
                held += len(row[5])
        if rows:
            yield resolve(rows)

    return run


def _window_rows(window: int):
    """One row per window of a segment, with its hash and place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "content", 1 << 18):
                for k in range(part.num_rows):
                    content = np.frombuffer(part.column("content")[k].as_buffer(), np.uint8)
                    hashes = Rolling(content).windows(window).view(np.int64)
                    n = len(hashes)
                    start, _ = unpacked(part.column("pack")[k].as_py())
                    fixed = {c: part.column(c)[k].as_py() for c in ("anchor", "doc_id", "th", "copies")}
                    columns = [pa.array([v] * n, pa.int64()) for v in fixed.values()]
                    columns += [
                        pa.array(hashes),
                        pa.array((start + np.arange(n)) << 24 | window),
                    ]
                    yield pa.RecordBatch.from_arrays(columns, [*fixed, "hash", "span"])

    return run


def repeated_spans(docs: DataFrame, window: int = WINDOW, group: int = GROUP) -> DataFrame:
    """Rows doc_id, th, span of all repeated windows, joined into runs where that is cheap.

    `docs` is as `spans.identified` makes it.
    """
    gram = max(1, GRAM * window // WINDOW)
    rows = spans.segments(docs, _symbols, window, gram)
    # Written first: a join of two plain shuffles can split an anchor with very many rows.
    twice = stored(rows.groupBy("anchor").count().filter("count > 1").select("anchor"), "suffix-twice")
    found = stored(rows.join(twice, "anchor", "left_semi"), "suffix-found")
    variants = found.groupBy("anchor", "segment").agg(
        F.count("*").alias("copies"), F.min(F.struct("doc_id", "th", "pack")).alias("one")
    )
    variants = stored(variants.select("anchor", "segment", "copies", "one.*"), "suffix-segments")
    per_anchor = variants.groupBy("anchor").agg(F.count("*").alias("variants"))
    per_anchor = stored(per_anchor.filter("variants > 1"), "suffix-variants")
    whole = found.join(
        variants.filter("copies > 1").select("anchor", "segment"), ["anchor", "segment"], "left_semi"
    ).select("doc_id", "th", spans.whole("pack", window).alias("span"))

    different = variants.join(per_anchor, "anchor")
    contents = spans.fetch(docs, different, _cut, window)
    contents = stored(contents, "suffix-contents")
    small = contents.filter(F.col("variants") <= group).drop("variants", "segment")
    small = small.repartition("anchor").sortWithinPartitions("anchor")
    sorted_ = small.mapInArrow(_sorted_groups(window), spans.SPANS)
    large = contents.filter(F.col("variants") > group).mapInArrow(
        _window_rows(window),
        "anchor long, doc_id long, th long, copies long, hash long, span long",
    )
    again = large.groupBy("anchor", "hash").agg(F.sum("copies").alias("n")).filter("n > 1")
    again = stored(again.drop("n"), "suffix-again")
    hashed = large.join(again, ["anchor", "hash"], "left_semi").select("doc_id", "th", "span")
    return whole.unionByName(sorted_).unionByName(hashed)


def suffix_dedup(docs: DataFrame, window: int = WINDOW, group: int = GROUP) -> DataFrame:
    """`docs` with n_units (bytes), n_removed, n_spans and `kept`, the remaining bytes of its texts.

    A byte is removed if it lies in a string of `window` bytes that also starts
    anywhere else, in the same document or another; nothing crosses documents.
    Judged on the input: all copies go, the first one too. Null and empty texts have
    no bytes. Rows that repeat a document are documents of their own, so repeated
    rows remove each other; rows that share an id are told apart by a 64-bit hash of
    their texts. Other columns pass through, except those named like a result. An empty
    table gives an empty result.
    """
    own = spans.identified(docs)
    return spans.remove(own, repeated_spans(own, window, group), _remove_bytes)


def without_repeats(docs: DataFrame, window: int = PASSAGE_WINDOW, words: int = PASSAGE_WORDS) -> DataFrame:
    """`docs` whose text has lost all repeated passages, and n_chars, if there is one, to match.

    A passage is a maximal run of strings of `window` bytes that also start anywhere else, if it
    touches `words` words or more (words are runs of other than ASCII white space); shorter runs
    stay. All copies go. Passages shrink to whole characters, so that the text stays valid; other
    columns stay as they are, a null text becomes empty, and a document that loses all of its text
    stays with an empty one. Rows are told apart as in `suffix_dedup`.
    """
    own = spans.identified(docs.drop(*spans.RESULTS))
    rest = spans.remove(own, repeated_spans(own, window), partial(_remove_passages, words=words))
    text = F.col("kept").cast("string")
    rest = rest.withColumns({"text": text} | ({"n_chars": F.char_length(text).cast("long")} if "n_chars" in docs.columns else {}))
    return rest.select(*[F.col(f"`{c}`") for c in docs.columns])


def _remove_passages(
    text: str, starts: np.ndarray, ends: np.ndarray, words: int
) -> tuple[int, int, bytes]:
    if len(starts):
        raw = text.encode()
        long = np.array([len(raw[a:b].split()) >= words for a, b in zip(starts, ends)])
        starts, ends = starts[long], ends[long]
    return _remove_characters(text, starts, ends)


def _remove_characters(text: str, starts: np.ndarray, ends: np.ndarray) -> tuple[int, int, bytes]:
    if not len(starts):
        return _remove_bytes(text, starts, ends)
    raw = np.frombuffer(text.encode(), np.uint8)
    begins = np.append(np.flatnonzero((raw & 0xC0) != 0x80), len(raw))  # of characters
    starts = begins[np.searchsorted(begins, starts)]
    ends = begins[np.searchsorted(begins, ends, "right") - 1]
    return _remove_bytes(text, starts, np.maximum(starts, ends))


def _remove_bytes(text: str, starts: np.ndarray, ends: np.ndarray) -> tuple[int, int, bytes]:
    raw = text.encode()
    if not len(starts):
        return len(raw), 0, raw
    view, at, out = memoryview(raw), 0, []
    for a, b in zip(starts, ends):
        out.append(view[at:a])
        at = b
    out.append(view[at:])
    return len(raw), int((ends - starts).sum()), b"".join(out)
