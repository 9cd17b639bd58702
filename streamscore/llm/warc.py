"""WARC archives of pages, written and read as rows of chunks.

Payloads travel as (record, chunk number) rows of at most `CHUNK` bytes, cut in the task
that reads the page; digests and ids alone decide which records are revisits. The writer
streams them into gzip members, one per record, and checks the digest it announced
in the header against the one it carried along. The reader streams the archives and
yields chunk rows again, each with the bytes and the SHA-1 up to and including it,
so that neither ever holds a whole payload in Python.

Of records with equal payloads the one with the largest page_id is written as a
response and the others as revisits that refer to it.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from streamscore.llm.words import text_of
from streamscore.sources.storage import shared_dir, stored

CHUNK = 1 << 20
DATE = "2024-01-01T00:00:00Z"
LEVEL = 3
MANIFEST = "file string, n_records long, n_bytes long"
CHUNKS = (
    "page_id long, record_type string, refers_to long, url string, header_digest string, "
    "chunk_no long, chunk binary, bytes_upto long, digest_upto string, last boolean"
)
IDENTICAL = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _payloads(pages: DataFrame) -> DataFrame:
    payload = text_of("html").cast("binary")
    rows = pages.select("page_id", "url", payload.alias("payload"))
    return rows.withColumn("key", F.sha2("payload", 256))


def record_heads(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """One row per different page_id and payload: page_id, key, sha1, n_bytes, refers_to.

    Payloads under `min_bytes` are all responses. Null html is an empty payload.
    Pages that share the largest page_id of their group are all responses; pages
    without an id refer to that page, and are responses if their group has no id.
    Equal payloads are found by SHA-256 and length, aggregated before the shuffle;
    payloads themselves go no further than the task that reads them.
    """
    small = _payloads(pages).select(
        "page_id", "key", F.sha1("payload").alias("sha1"), F.length("payload").cast("long").alias("n_bytes")
    )
    small = stored(small.distinct(), "warc-digests")
    groups = stored(small.groupBy("key").agg(F.max("page_id").alias("first")), "warc-groups")
    other = (F.col("n_bytes") >= min_bytes) & ~F.col("page_id").eqNullSafe(F.col("first"))
    return small.join(groups, "key").select(
        "page_id", "key", "sha1", "n_bytes", F.when(other, F.col("first")).alias("refers_to")
    )


def chunk_rows(rows: DataFrame, size: int = CHUNK) -> DataFrame:
    """Records as rows of at most `size` payload bytes, at least one per record, in order.

    Only the numbers of the chunks are made at once; each row cuts its own bytes. Null and
    empty payloads give one row with null or no bytes.
    """
    n = F.coalesce(F.length("payload"), F.lit(0))
    last = F.floor(F.greatest(n - 1, F.lit(0)) / size).cast("int")
    numbered = rows.select("*", F.explode(F.sequence(F.lit(0), last)).alias("no"))
    piece = F.substring("payload", F.col("no") * size + 1, F.lit(size))
    return numbered.withColumn("bytes", piece).drop("payload")


def record_chunks(pages: DataFrame, min_bytes: int = 0, size: int = CHUNK) -> DataFrame:
    """Chunk rows with the heads of their records; those of a record follow each other in a task.

    Pages are cut into chunks where they are read, so what is shuffled and sorted has at
    most `size` bytes a row. Revisits keep one row without bytes. A record's chunks come
    from one task and share a key, so they meet in one task again however a join is split.
    """
    heads = stored(record_heads(pages, min_bytes), "warc-heads")
    chunks = chunk_rows(_payloads(pages).withColumn("record", F.monotonically_increasing_id()), size)
    same = (F.col("c.key") == F.col("h.key")) & F.col("c.page_id").eqNullSafe(F.col("h.page_id"))
    both = chunks.alias("c").join(heads.alias("h"), same)
    whole = F.col("refers_to").isNull()
    both = both.filter(whole | (F.col("no") == 0))
    return both.sortWithinPartitions("c.key", "c.page_id", "record", "no").select(
        "c.page_id", "url", "sha1", "n_bytes", "refers_to", "no", F.when(whole, F.col("bytes")).alias("bytes")
    )


def _filesystem(folder: str) -> tuple[fs.FileSystem, str]:
    if folder.startswith("file:"):
        folder = "file:///" + folder[5:].lstrip("/")
    return fs.FileSystem.from_uri(folder)


def _base32(sha1_hex: str) -> str:
    return base64.b32encode(bytes.fromhex(sha1_hex)).decode()


def _record_id(page_id: int | None) -> str:
    return f"<urn:x-page:{'none' if page_id is None else page_id}>"


def _page_id(record_id: str) -> int | None:
    number = record_id.rpartition(":")[2].rstrip(">")
    return None if number == "none" else int(number)


def _head(page_id, url, sha1, n_bytes, refers_to) -> tuple[bytes, bytes]:
    """WARC header and HTTP header of a record."""
    http = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
    fields = [("WARC-Type", "response" if refers_to is None else "revisit")]
    fields += [("WARC-Record-ID", _record_id(page_id)), ("WARC-Date", DATE)]
    if url is not None:
        fields.append(("WARC-Target-URI", quote(url, safe="%/:=&?~#+!$,;'@()*[]")))
    fields.append(("WARC-Payload-Digest", f"sha1:{_base32(sha1)}"))
    fields.append(("Content-Type", "application/http; msgtype=response"))
    if refers_to is None:
        http += f"Content-Length: {n_bytes}\r\n"
    else:
        fields += [("WARC-Refers-To", _record_id(refers_to)), ("WARC-Profile", IDENTICAL)]
        n_bytes = 0
    http += "\r\n"
    fields.append(("Content-Length", str(len(http) + n_bytes)))
    lines = "".join(f"{name}: {value}\r\n" for name, value in fields)
    return f"WARC/1.1\r\n{lines}\r\n".encode(), http.encode()


def write_archives(pages: DataFrame, folder: str, min_bytes: int = 0, size: int = CHUNK) -> DataFrame:
    """Write gzip archives to `folder`, one per task, and return the stored list of them.

    `folder` must be one that all executors reach. Every attempt of a task writes a
    file of its own; only those of attempts that succeeded are on the list.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = _filesystem(folder)
        name, out, n_records = "", None, 0
        member, digest, got = None, None, 0
        for batch in batches:
            columns = [batch.column(n) for n in ("page_id", "url", "sha1", "n_bytes", "refers_to", "no", "bytes")]
            for k in range(batch.num_rows):
                page_id, url, sha1, n_bytes, refers_to, no = (c[k].as_py() for c in columns[:6])
                piece = columns[6][k].as_buffer() or b""
                if out is None:
                    store.create_dir(root, recursive=True)
                    name = f"{uuid.uuid4().hex}.warc.gz"
                    out = store.open_output_stream(f"{root}/{name}", compression=None)
                if no == 0:
                    member, digest, got = zlib.compressobj(LEVEL, zlib.DEFLATED, 31), hashlib.sha1(), 0
                    for part in _head(page_id, url, sha1, n_bytes, refers_to):
                        out.write(member.compress(part))
                    n_records += 1
                digest.update(piece)
                got += len(piece)
                out.write(member.compress(piece))
                if refers_to is not None or got == n_bytes:
                    if refers_to is None and digest.hexdigest() != sha1:
                        raise ValueError(f"page {page_id}: chunks do not add up to the payload")
                    out.write(member.compress(b"\r\n\r\n") + member.flush())
        if out is not None:
            size = out.tell()
            out.close()
            row = {"file": [f"{folder}/{name}"], "n_records": [n_records], "n_bytes": [size]}
            yield pa.RecordBatch.from_pydict(row)

    written = record_chunks(pages, min_bytes, size).mapInArrow(run, MANIFEST)
    return stored(written, "warc-list")


class _Stream:
    """Bytes of a gzip archive, decompressed a block at a time."""

    def __init__(self, source, block: int):
        self.source, self.block = source, block
        self.inflate = zlib.decompressobj(31)
        self.raw, self.ready = b"", b""

    def more(self) -> bool:
        """Makes at most `block` more bytes ready; False at the end."""
        while True:
            if self.inflate.eof:
                self.raw = self.inflate.unused_data or self.raw
                self.inflate = zlib.decompressobj(31)
            if not self.raw:
                self.raw = self.source.read(self.block)
                if not self.raw:
                    return False
            got = self.inflate.decompress(self.raw, self.block)
            self.raw = b"" if self.inflate.eof else self.inflate.unconsumed_tail
            if got:
                self.ready += got
                return True
            if self.inflate.eof and not self.inflate.unused_data:
                self.raw = b""

    def head(self) -> bytes | None:
        """All up to the next empty line, or None at the end."""
        while (end := self.ready.find(b"\r\n\r\n")) < 0:
            if not self.more():
                return None
        got, self.ready = self.ready[:end], self.ready[end + 4 :]
        return got

    def body(self, n: int) -> Iterator[bytes]:
        """The next `n` bytes in blocks of `block` bytes, the last one shorter."""
        while n > 0:
            want = min(n, self.block)
            while len(self.ready) < want and self.more():
                pass
            got, self.ready = self.ready[:want], self.ready[want:]
            if not got:
                raise ValueError("archive ends within a record")
            n -= len(got)
            yield got


def _fields(head: bytes) -> dict[str, str]:
    lines = head.decode().lstrip("\r\n").split("\r\n")[1:]
    return {k.lower(): v.strip() for k, _, v in (line.partition(":") for line in lines)}


def _chunks(stream: _Stream) -> Iterator[tuple]:
    """Rows of `CHUNKS` of one archive."""
    while (head := stream.head()) is not None:
        fields = _fields(head)
        http = stream.head()
        n = int(fields["content-length"]) - len(http) - 4
        refers_to = fields.get("warc-refers-to")
        same = (
            _page_id(fields["warc-record-id"]),
            fields["warc-type"],
            _page_id(refers_to) if refers_to else None,
            fields.get("warc-target-uri"),
            fields["warc-payload-digest"].removeprefix("sha1:"),
        )
        digest, upto = hashlib.sha1(), 0
        for no, chunk in enumerate(stream.body(n) if n else [b""]):
            digest.update(chunk)
            upto += len(chunk)
            yield *same, no, chunk, upto, base64.b32encode(digest.digest()).decode(), upto == n
        for end in stream.body(4):
            if end.strip():
                raise ValueError("record is longer than its header says")


def read_archives(spark: SparkSession, archives: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """Chunk rows of all records of the listed archives, in the columns of `CHUNKS`.

    Chunks of a record are numbered from 0; an empty payload has one empty chunk.
    """
    names = [c.split()[0] for c in CHUNKS.split(", ")]
    types = spark.createDataFrame([], CHUNKS).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        schema, rows, held = to_arrow_schema(types), [], 0
        for batch in batches:
            for path in batch.column("file").to_pylist():
                store, name = _filesystem(path)
                with store.open_input_stream(name, compression=None) as source:
                    for row in _chunks(_Stream(source, chunk)):
                        rows.append(row)
                        held += len(row[6])
                        if held > 4 * chunk or len(rows) > 5000:
                            yield _batch(rows, names, schema)
                            rows, held = [], 0
        if rows:
            yield _batch(rows, names, schema)

    parts = max(1, archives.count())
    return archives.repartition(parts).mapInArrow(run, CHUNKS)


def _batch(rows: list[tuple], names: list[str], schema: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows)
    return pa.RecordBatch.from_arrays(
        [pa.array(c, schema.field(n).type) for n, c in zip(names, columns)], names
    )


def page_records(chunks: DataFrame) -> DataFrame:
    """One row per record: page_id, payload_bytes, payload_digest, record_type, refers_to.

    Bytes and digest of a revisit are those of the response it refers to. A payload
    that does not have the digest of its header raises an error.
    """
    ends = chunks.filter("last").drop("chunk", "last", "chunk_no", "url")
    wrong = (F.col("record_type") == "response") & (F.col("digest_upto") != F.col("header_digest"))
    digest = F.when(wrong, F.raise_error(F.lit("payload differs from its digest")).cast("string"))
    ends = ends.withColumn("payload_digest", digest.otherwise(F.col("header_digest")))
    responses = ends.filter(F.col("record_type") == "response").select(
        F.col("page_id").alias("refers_to"), F.col("bytes_upto").alias("full_bytes"), "payload_digest"
    ).distinct()
    return ends.join(responses, ["refers_to", "payload_digest"], "left").select(
        "page_id",
        F.coalesce("full_bytes", "bytes_upto").alias("payload_bytes"),
        "payload_digest",
        "record_type",
        "refers_to",
    )


def archive_round_trip(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Write archives of `pages` to the shared folder and return the records read back.

    One row per row of `pages`: page_id, payload_bytes, payload_digest, record_type and
    refers_to. Null html is an empty payload; null and repeated ids, and rows that are equal,
    are records of their own (see `record_heads` for which of them refer to which). Columns other
    than page_id, url and html are ignored, whatever their names; an empty table gives no rows.
    """
    spark = pages.sparkSession
    archives = write_archives(pages, shared_dir(spark, "warc"), min_bytes)
    ends = read_archives(spark, archives)
    return page_records(ends)
