"""Packing of token ids into sequences of fixed capacity by bounded-space best fit.

A document's ids end with one end id. Only documents longer than the capacity are cut,
into pieces of the capacity of which the last may be shorter. Pieces arrive one by one;
each goes to the open bin that it fills best, and a new bin opens only where none has
room. Open bins are found in a bitset with a bit per free space: the lowest bit at or
above a piece's length is the best fit, the lowest bit of all the fullest bin, which
closes first once `OPEN_BINS` are open.

Spark deals the pieces evenly to groups of about `GROUP` pieces, whatever their ids, and
a task packs one group. Pieces arrive in waves of about `WAVE`, dealt by a hash, the
longest of a wave first: it opens no more bins than may be open, and its short pieces
fill what the long ones of this wave and the bins of earlier waves have left. A group
ends with at most one bin that is less than half full.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructType
from tokenizers import Tokenizer

from streamscore.llm.arrow import cut, slices

CAPACITY = 2048
OPEN_BINS = 1024
GROUP = 1 << 17
WAVE = 2 * OPEN_BINS
#: Bytes of words and ids that a worker remembers before it starts anew.
REMEMBERED = 128 << 20
#: Bytes of text whose words are looked up at a time.
BLOCK_BYTES = 4 << 20
PIECE = "doc_id long, piece int, start long, length long, ids binary"


class WordIds:
    """Token ids of texts, as little-endian unsigned 32-bit integers.

    No token of the vocabulary spans ASCII white space, and nothing is composed across it,
    so a text's ids are those of its words in a row, and a word is encoded once while it is
    remembered. A mark after an ASCII letter that ends a word is a word of its own, and ASCII
    words are told apart in lower case, as the vocabulary has it.
    """

    MARKS = b".,;:!?"
    BETWEEN = "\x01"

    def __init__(self, content: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_str(content)
        self.new: dict[bytes, bytes] = {}  # words met since `old` was full
        self.old: dict[bytes, bytes] = {}
        self.size = 0
        between = self._encoded([self.BETWEEN])[0]
        if len(between) != 1:
            raise ValueError("the vocabulary must have a token for a control character")
        self.between = between[0]

    def _encoded(self, texts: list[str]) -> list[np.ndarray]:
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(x.ids, "<u4") for x in found]

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """The packed ids of each text; some megabytes of words are in work at a time."""
        out = [bytearray() for _ in texts]
        lists, held = [], 0
        for k, text in enumerate(texts):
            for part in cut(text):
                lists.append((k, part.split()))
                held += len(part)
                if held > BLOCK_BYTES:
                    self._block(lists, out)
                    lists, held = [], 0
        self._block(lists, out)
        return out

    def _block(self, lists: list[tuple[int, list[bytes]]], out: list[bytearray]) -> None:
        if self.size > REMEMBERED:
            self.new, self.old, self.size = {}, self.new, 0
        self._learn(set().union(*(words for _, words in lists)).difference(self.new))
        known = self.new
        for k, words in lists:
            out[k] += b"".join([known[w] for w in words])

    def _learn(self, words: set[bytes]) -> None:
        new, old, parts, missing = self.new, self.old, [], set()
        for word in words:
            if found := old.get(word):
                self._keep(word, found)
                continue
            core, mark = word, b""
            if word.isascii() and b"<|" not in word:
                core = word.lower()
            if core[-1] in self.MARKS and core[-2:-1].isalpha():
                core, mark = core[:-1], core[-1:]
                if mark not in new:
                    missing.add(mark)
            if core not in new:
                missing.add(core)
            if core is not word:
                parts.append((word, core, mark))
        known = [w for w in missing if w in old]
        for word in known:
            self._keep(word, old[word])
        self._encode_words(missing.difference(known))
        for word, core, mark in parts:
            self._keep(word, new[core] + new[mark] if mark else new[core])

    def _encode_words(self, words: set[bytes]) -> None:
        between = self.BETWEEN.encode()
        odd = [w for w in words if between in w or b"<|" in w]
        plain = list(words.difference(odd))
        for word, ids in zip(odd, self._encoded([w.decode() for w in odd]), strict=True):
            self._keep(word, ids.tobytes())
        for start in range(0, len(plain), 4096):
            some = plain[start : start + 4096]
            ids = self._encoded([(b" " + between + b" ").join(some).decode()])[0]
            raw, at = ids.tobytes(), 0
            ends = np.append(np.flatnonzero(ids == self.between), len(ids)) * 4
            for word, end in zip(some, ends.tolist(), strict=True):
                self._keep(word, raw[at:end])
                at = end + 4

    def _keep(self, word: bytes, ids: bytes) -> None:
        if word not in self.new:
            self.new[word] = ids
            self.size += 170 + len(word) + len(ids)


_LOADED: dict[str, WordIds] = {}  # by a worker, for one vocabulary at a time


def word_ids(content: str) -> WordIds:
    if content not in _LOADED:
        _LOADED.clear()
        _LOADED[content] = WordIds(content)
    return _LOADED[content]


def _pieces(batches, vocabulary, capacity: int, end: int) -> Iterator[pa.RecordBatch]:
    words, last, width = word_ids(vocabulary.value), end.to_bytes(4, "little"), 4 * capacity
    for batch in batches:
        for part in slices(batch, "text"):
            rows = []
            texts = part.column("text").cast(pa.large_binary()).to_pylist()
            encoded = words.encode([x or b"" for x in texts])
            for doc_id, ids in zip(part.column("doc_id").to_pylist(), encoded, strict=True):
                ids = bytes(ids) + last
                rows += [
                    (doc_id, number, start // 4, min(width, len(ids) - start) // 4, ids[start : start + width])
                    for number, start in enumerate(range(0, len(ids), width))
                ]
            columns = zip(*rows, strict=True)
            types = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary())
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, types, strict=True)],
                names=["doc_id", "piece", "start", "length", "ids"],
            )


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, end: int = 0) -> DataFrame:
    """doc_id, piece, start, length and ids of every piece of every document.

    `path` names a vocabulary of the tokenizers library, which the driver reads and sends to the
    executors. A null text is empty, so its only id is `end`; null and repeated doc_ids give their
    own pieces per row; other columns are ignored. An empty table gives none.
    """
    with open(path, encoding="utf-8") as f:
        vocabulary = docs.sparkSession.sparkContext.broadcast(f.read())
    run = partial(_pieces, vocabulary=vocabulary, capacity=capacity, end=end)
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, PIECE)


class BestFit:
    """Open bins by free space; `place` gives a bin's number and the place in it."""

    def __init__(self, capacity: int, limit: int):
        self.capacity, self.limit = capacity, limit
        self.spaces = 0  # bit f is set while a bin with f free is open
        self.bins: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.open = self.made = 0

    def _take(self, free: int) -> int:
        bins = self.bins[free]
        number = bins.pop()
        if not bins:
            self.spaces ^= 1 << free
        return number

    def place(self, length: int) -> tuple[int, int]:
        enough = self.spaces >> length
        if enough:
            free = length + (enough & -enough).bit_length() - 1
            number = self._take(free)
        else:
            if self.open == self.limit:
                self._take((self.spaces & -self.spaces).bit_length() - 1)
                self.open -= 1
            number, free = self.made, self.capacity
            self.made += 1
            self.open += 1
        left = free - length
        if left:
            self.bins[left].append(number)
            self.spaces |= 1 << left
        else:
            self.open -= 1
        return number, self.capacity - free


def _packed(batches, capacity: int, limit: int, length: str, group: str) -> Iterator[pa.RecordBatch]:
    bins = BestFit(capacity, limit)
    for batch in batches:
        lengths = batch.column(length).to_numpy(zero_copy_only=False)
        if len(lengths) and not 0 < lengths.min() <= lengths.max() <= capacity:
            raise ValueError(f"lengths must be between 1 and {capacity}")
        placed = np.array([bins.place(n) for n in lengths.tolist()], np.int64).reshape(-1, 2)
        at = batch.schema.get_field_index(group)
        base = batch.column(at).to_numpy(zero_copy_only=False).astype(np.int64) << 40
        rest = [k for k in range(batch.num_columns) if k != at]
        yield pa.RecordBatch.from_arrays(
            [*(batch.column(k) for k in rest), pa.array(base + placed[:, 0]), pa.array(placed[:, 1])],
            names=[*(batch.schema.names[k] for k in rest), "sequence_id", "offset"],
        )


def pack(
    items: DataFrame, length: str = "length", capacity: int = CAPACITY, open_bins: int = OPEN_BINS, group: int = GROUP
) -> DataFrame:
    """`items` with sequence_id and offset, so that the lengths in a sequence fit its capacity.

    Offsets in a sequence are gapless from 0. Sequence numbers are unique, not dense. Reruns over
    the same rows agree. Lengths must be between 1 and `capacity`, else an error is raised; null
    and repeated values elsewhere do not matter, and equal rows are packed each. Columns named
    sequence_id or offset are replaced. `items` is read twice, so store what is dear to compute.
    """
    items = items.drop("sequence_id", "offset")
    count = items.count()
    groups = max(1, -(-count // group))
    waves = max(1, -(-count // (groups * WAVE)))
    names = [F.col(f"`{c}`") for c in items.columns]
    mark = "_group" + "_" * max(map(len, items.columns))
    dealt = items.repartition(groups).withColumn(mark, F.spark_partition_id())
    wave = F.pmod(F.xxhash64(*names), F.lit(waves))
    arranged = dealt.sortWithinPartitions(wave, F.col(length).desc(), *names)
    schema = StructType(list(items.schema.fields)).add("sequence_id", LongType()).add("offset", LongType())
    run = partial(_packed, capacity=capacity, limit=open_bins, length=length, group=mark)
    return arranged.mapInArrow(run, schema)


def sequences(packed: DataFrame) -> DataFrame:
    """sequence_id, ids and n_pieces of each sequence: the ids of its pieces by offset."""
    joined = F.transform(F.array_sort(F.collect_list(F.struct("offset", "ids"))), lambda x: x["ids"])
    return (
        packed.groupBy("sequence_id")
        .agg(joined.alias("parts"), F.count("*").alias("n_pieces"))
        .select("sequence_id", F.aggregate("parts", F.lit(b""), lambda ids, part: F.concat(ids, part)).alias("ids"), "n_pieces")
    )
