"""Byte-level BPE encoding and decoding in Arrow batches.

Distinct pieces of a block of texts are laid out as rows of matrices, one matrix per
length class, padded on the right. In every round each row merges its leftmost pair
of minimum rank; the merged column falls away, so all rows shrink together, and rows
without a mergeable pair leave the matrix. Ranks of pairs come from an open-addressing
hash table. Pieces of more than `LONG` bytes, for which a round per merge would take
quadratic time, merge the same pairs in the same order through a heap.

Spark partitions the documents; a task holds one Arrow batch and one block.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from streamscore.llm.arrow import slices, spread

LONG = 256
BLOCK_PIECES = 400_000
NONE = np.int32(2**31 - 1)
# White space as in Unicode's White_Space, which is what the pattern's \s stands for.
SPACES = r"\x09-\x0D\x20\x85\xA0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000"


def compiled(pattern: str):
    """`pattern` with \\s and \\S spelled out, so that it does not depend on the library."""
    spelled = pattern.replace(r"[^\s", f"[^{SPACES}")
    spelled = spelled.replace(r"\S", f"[^{SPACES}]").replace(r"\s", f"[{SPACES}]")
    return regex.compile(spelled)


class Vocabulary:
    """Tokens by rank and the hash table of the pairs that make them."""

    def __init__(self, content: bytes):
        rows = (line.split() for line in content.splitlines() if line.strip())
        self.ranks = {base64.b64decode(token): int(rank) for token, rank in rows}
        top = max(self.ranks.values()) + 1
        tokens = [b""] * top
        for token, rank in self.ranks.items():
            tokens[rank] = token
        self.lengths = np.fromiter(map(len, tokens), np.int64, top)
        self.starts = np.concatenate([[0], np.cumsum(self.lengths)])[:-1]
        self.bytes = np.frombuffer(b"".join(tokens), np.uint8)
        self.single = np.full(257, -1, np.int32)
        for value in range(256):
            self.single[value] = self.ranks[bytes([value])]
        pairs = {}
        for token, rank in self.ranks.items():
            for cut in range(1, len(token)):
                left, right = self.ranks.get(token[:cut]), self.ranks.get(token[cut:])
                if left is not None and right is not None:
                    pairs[left << 32 | right] = rank
        self._build(np.fromiter(pairs, np.int64, len(pairs)), np.fromiter(pairs.values(), np.int32))
        self.pairs = pairs

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        mixed = keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return (mixed >> np.uint64(64 - self.bits)).astype(np.int64)

    def _build(self, keys: np.ndarray, ranks: np.ndarray) -> None:
        self.bits = max(4, int(np.ceil(np.log2(4 * max(1, len(keys))))))
        self.keys = np.full((1 << self.bits) + 1, -1, np.int64)
        self.values = np.full(len(self.keys), NONE, np.int32)
        slots, mask = self._slots(keys), (1 << self.bits) - 1
        while len(keys):
            free = self.keys[slots] == -1
            self.keys[slots[free]] = keys[free]
            placed = self.keys[slots] == keys
            self.values[slots[placed]] = ranks[placed]
            keys, ranks, slots = keys[~placed], ranks[~placed], (slots[~placed] + 1) & mask

    def pair_ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of pairs, NONE where a pair is no token or one side is padding."""
        shape = left.shape
        keys = (left.astype(np.int64) << 32 | right.astype(np.int64)).ravel()
        keys[(left < 0).ravel() | (right < 0).ravel()] = -2
        slots, mask = self._slots(keys), (1 << self.bits) - 1
        found = self.keys[slots]
        out = np.where(found == keys, self.values[slots], NONE)
        open_ = np.flatnonzero((found != keys) & (found != -1))
        while len(open_):
            slots[open_] = (slots[open_] + 1) & mask
            found = self.keys[slots[open_]]
            hit = found == keys[open_]
            out[open_[hit]] = self.values[slots[open_[hit]]]
            open_ = open_[~hit & (found != -1)]
        return out.reshape(shape)

    def merge_rows(self, rows: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Yields (row numbers, token matrix padded with -1) as rows are finished."""
        numbers = np.arange(len(rows))
        ranks = self.pair_ranks(rows[:, :-1], rows[:, 1:])
        while len(rows):
            if ranks.shape[1] == 0:
                yield numbers, rows
                return
            at = ranks.argmin(axis=1)
            best = ranks[np.arange(len(rows)), at]
            going = best != NONE
            if not going.all():
                yield numbers[~going], rows[~going]
                numbers, rows, ranks, at, best = (
                    x[going] for x in (numbers, rows, ranks, at, best)
                )
                if not len(rows):
                    return
            line, (n, width) = np.arange(len(rows)), rows.shape
            rows[line, at] = best
            kept = np.ones((n, width), bool)
            kept[line, at + 1] = False
            rows = rows[kept].reshape(n, width - 1)
            kept = np.ones((n, width - 1), bool)
            kept[line, at] = False
            ranks = ranks[kept].reshape(n, width - 2)
            before = np.flatnonzero(at > 0)
            ranks[before, at[before] - 1] = self.pair_ranks(
                rows[before, at[before] - 1], rows[before, at[before]]
            )
            after = np.flatnonzero(at < width - 2)
            ranks[after, at[after]] = self.pair_ranks(
                rows[after, at[after]], rows[after, at[after] + 1]
            )

    def merge_long(self, piece: bytes) -> list[int]:
        """The same merges for one long piece, with the pairs in a heap."""
        ids = [int(self.single[b]) for b in piece]
        n = len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        rank = lambda i, j: self.pairs.get(ids[i] << 32 | ids[j])
        heap = [(r, i, i + 1) for i in range(n - 1) if (r := rank(i, i + 1)) is not None]
        heapq.heapify(heap)
        while heap:
            r, i, j = heapq.heappop(heap)
            if ids[i] < 0 or after[i] != j or j >= n or ids[j] < 0 or rank(i, j) != r:
                continue
            ids[i], ids[j], after[i] = r, -1, after[j]
            if after[i] < n:
                before[after[i]] = i
                if (x := rank(i, after[i])) is not None:
                    heapq.heappush(heap, (x, i, after[i]))
            if before[i] >= 0 and (x := rank(before[i], i)) is not None:
                heapq.heappush(heap, (x, before[i], i))
        return [x for x in ids if x >= 0]

    def encode_pieces(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Token counts of the pieces, and all their tokens one after the other."""
        done: list[tuple[np.ndarray, np.ndarray]] = []  # (piece numbers, padded tokens)
        whole = np.fromiter((self.ranks.get(p, -1) for p in pieces), np.int32, len(pieces))
        known = np.flatnonzero(whole >= 0)
        done.append((known, whole[known].reshape(-1, 1)))
        lengths = np.fromiter(map(len, pieces), np.int64, len(pieces))
        rest = np.flatnonzero(whole < 0)
        for k in rest[lengths[rest] > LONG]:
            done.append((np.array([k]), np.array([self.merge_long(pieces[k])], np.int32)))
        rest = rest[lengths[rest] <= LONG]
        width = 1
        while len(rest):
            width = width + 2 if width < 24 else 2 * width
            some = rest[lengths[rest] <= width]
            rest = rest[lengths[rest] > width]
            if not len(some):
                continue
            size = lengths[some]
            flat = np.frombuffer(b"".join(pieces[k] for k in some), np.uint8)
            rows = np.full((len(some), width), 256, np.int64)
            rows[np.arange(width) < size[:, None]] = flat
            for numbers, tokens in self.merge_rows(self.single[rows]):
                done.append((some[numbers], tokens))
        counts = np.zeros(len(pieces), np.int64)
        for numbers, tokens in done:
            counts[numbers] = (tokens >= 0).sum(axis=1)
        starts = np.cumsum(counts) - counts
        out = np.empty(int(counts.sum()), np.uint32)
        for numbers, tokens in done:
            valid = tokens >= 0
            out[(starts[numbers][:, None] + np.arange(tokens.shape[1]))[valid]] = tokens[valid]
        return counts, out

    def decode(self, ids: np.ndarray) -> bytes:
        return self.bytes[spread(self.starts[ids], self.lengths[ids])].tobytes()


_LOADED: dict[int, Vocabulary] = {}


def vocabulary(content: bytes) -> Vocabulary:
    """The tables of a rank file, built once per Python worker."""
    key = hash(content)
    if key not in _LOADED:
        _LOADED.clear()
        _LOADED[key] = Vocabulary(content)
    return _LOADED[key]


def _encode_texts(words: Vocabulary, split, texts: list[str]) -> list[bytes]:
    """Packed ids of each text; at most BLOCK_PIECES pieces are in work at a time."""
    out = [bytearray() for _ in texts]
    numbers: dict[str, int] = {}
    line: list[int] = []
    owners: list[tuple[int, int]] = []  # (text, pieces in this block)

    def flush() -> None:
        if not line:
            return
        counts, ids = words.encode_pieces([p.encode() for p in numbers])
        at = np.array(line)
        starts = np.cumsum(counts) - counts
        tokens = ids[spread(starts[at], counts[at])].astype("<u4")
        ends = np.concatenate([[0], np.cumsum(counts[at])])
        done = 0
        for k, n in owners:
            out[k] += tokens[ends[done] : ends[done + n]].tobytes()
            done += n
        numbers.clear()
        line.clear()
        owners.clear()

    for k, text in enumerate(texts):
        pieces = (m.group() for m in split.finditer(text)) if len(text) > 1 << 20 else None
        if pieces is None:
            found = split.findall(text)
            line += [numbers.setdefault(p, len(numbers)) for p in found]
            owners.append((k, len(found)))
            if len(line) > BLOCK_PIECES:
                flush()
            continue
        while found := list(islice(pieces, BLOCK_PIECES)):
            line += [numbers.setdefault(p, len(numbers)) for p in found]
            owners.append((k, len(found)))
            flush()
    flush()
    return [bytes(x) for x in out]


def encode(docs: DataFrame, ranks_path: str, pattern: str, text: str = "text") -> DataFrame:
    """`docs` with `tokens` (packed little-endian unsigned 32-bit ids) and `n_tokens`.

    Every match of `pattern` is encoded on its own and without special tokens. Null
    and empty texts have no tokens; all other columns and repeated rows pass through, except
    columns named tokens or n_tokens, which are replaced. An empty table gives no rows.
    The rank file is read by the driver and sent to the executors; its size is that
    of a vocabulary, not of the data.
    """
    with open(ranks_path, "rb") as f:
        ranks = docs.sparkSession.sparkContext.broadcast(f.read())
    named = docs.withColumns({"tokens": F.lit(None).cast("binary"), "n_tokens": F.lit(0).cast("long")})
    names = named.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, split = vocabulary(ranks.value), compiled(pattern)
        for batch in batches:
            for part in slices(batch, text):
                texts = [x or "" for x in part.column(text).to_pylist()]
                packed = _encode_texts(words, split, texts)
                columns = {n: part.column(n) for n in names if n not in ("tokens", "n_tokens")}
                columns["tokens"] = pa.array(packed, pa.binary())
                columns["n_tokens"] = pa.array([len(x) // 4 for x in packed], pa.int64())
                yield pa.RecordBatch.from_arrays([columns[n] for n in names], names)

    return docs.mapInArrow(run, named.schema)


def decode(encoded: DataFrame, ranks_path: str, tokens: str = "tokens") -> DataFrame:
    """`encoded` with `decoded`, the bytes of its packed token ids (null: empty).

    Other columns and repeated rows pass through; a column named decoded is replaced. An empty
    table gives no rows.
    """
    with open(ranks_path, "rb") as f:
        ranks = encoded.sparkSession.sparkContext.broadcast(f.read())
    named = encoded.withColumn("decoded", F.lit(None).cast("binary"))
    names = named.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = vocabulary(ranks.value)
        for batch in batches:
            for part in slices(batch, tokens):
                ids = (np.frombuffer(x or b"", "<u4") for x in part.column(tokens).to_pylist())
                columns = {n: part.column(n) for n in names if n != "decoded"}
                columns["decoded"] = pa.array([words.decode(x) for x in ids], pa.binary())
                yield pa.RecordBatch.from_arrays([columns[n] for n in names], names)

    return encoded.mapInArrow(run, named.schema)
