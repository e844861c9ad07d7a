"""WARC archives as a chunked record table.

Writing: equal payloads are found by digest and length beforehand; the record with the smallest id is a
response, others are revisits that refer to it. Payloads become rows (record, chunk number, bytes), a record's
rows one after another in a task, and the task streams them into its archive while a running SHA-1 goes along;
beside the row that was read, no task holds more than a chunk of a payload at once. Only payloads that several
rows share are moved.

Reading: an index row per record gives archive and offset. Archives are read in segments of whole
records, by seek, as rows (record, chunk number, bytes); the last chunk of a record carries the
digest that went along with the reading.

Each record is a gzip member of its own, written and read as a stream, so that a record can be reached
by seek in a compressed archive.

Archives have names of their own for each attempt of a task, and the index lists those of the
attempts that succeeded: what a lost executor left is never read.

Defined results: a null payload is empty; a null id is written as the record ``null``; rows that
repeat an id and payload are records of their own, of which one is the response; equal ids with
different payloads are different records; every record has a name of its own; line breaks in URLs are percent-encoded; an empty table
gives an empty index; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery.functions.prune import marked
from orrery.session import cut, map_arrow, scratch_path, store

CHUNK, SEGMENT = 1 << 20, 16 << 20
#: gzip's fastest level; tasks that read segments at once, at most.
LEVEL, TASKS = 1, 10_000
#: Fixed values of the format.
VERSION, END = b"WARC/1.1", b"\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2026-01-01T00:00:00Z"


def base32(hex_digest: Column) -> Column:
    """RFC 4648 base32 of a hex SHA-1, 20 bits at a time."""
    parts = [F.lpad(F.conv(F.substring(hex_digest, 1 + 5 * i, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.concat(*parts), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def decide(pages: DataFrame, id_col: str, text_col: str, least: int = 0) -> DataFrame:
    """(id, digest, n, first, copies) of the distinct (id, payload) whose payload, of ``least`` bytes or more, several rows have; stored.

    ``first`` is the id of the response. Digests, not payloads, are grouped, and only digests that several
    rows share are handed back.
    """
    data = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    rows = cut(pages.select(F.col(id_col).alias("id"), base32(F.sha1(data)).alias("digest"), F.octet_length(data).cast("long").alias("n")), "digests").where(F.col("n") >= least)
    first = rows.groupBy("digest", "n").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("k")).where("k > 1").drop("k")
    first = cut(first, "shared-digests")
    return cut(rows.groupBy("id", "digest", "n").agg(F.count(F.lit(1)).alias("copies")).join(first, ["digest", "n"]).select("id", "digest", "n", "first", "copies"), "decided")


def _record(ident: Column, digest: Column) -> Column:
    """A record's name: two records of one id have different payloads or are copies, which are numbered."""
    return F.concat(F.lit("<urn:orrery:record:"), F.coalesce(ident.cast("string"), F.lit("null")), F.lit(":"), digest, F.lit(">"))


def chunk_rows(pages: DataFrame, decided: DataFrame, id_col: str, text_col: str, url_col: str, chunk: int = CHUNK, least: int = 0) -> DataFrame:
    """(record, url, digest, n, refers_to, chunk_no, payload): the chunk table, a record's rows together and in order; revisits have one row without payload.

    Payloads that no other row has are cut where they are read. A filter of 131,072 rows at most, joined by
    broadcast, picks those that may be shared; only these are moved, to the decision on their record type.
    """
    data = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.octet_length(data).cast("long").alias("n"), base32(F.sha1(data)).alias("digest"), data.alias("data"))
    rows, shared = marked(rows, decided, "digest", name="shared"), F.col("shared")
    named = _record(F.col("id"), F.col("digest"))
    # Copies that nothing refers to are told apart by a number.
    copy = F.concat(F.regexp_replace(named, ">$", ":"), F.monotonically_increasing_id().cast("string"), F.lit(">"))
    named_plain = F.when(F.col("n") < least, copy).otherwise(named) if least else named
    plain = rows.where(~shared).select(named_plain.alias("record"), "url", "digest", "n", F.lit(None).cast("string").alias("refers_to"), "data")
    p, d = rows.where(shared).alias("p"), decided.alias("d")
    held = p.join(d, F.col("p.id").eqNullSafe(F.col("d.id")) & (F.col("p.digest") == F.col("d.digest")) & (F.col("p.n") == F.col("d.n")), "left")
    # A payload that the filter let through by chance has no decision: it is a response.
    responds = F.col("copies").isNull() | F.col("p.id").eqNullSafe(F.col("first"))
    held = held.select("p.id", "url", "p.digest", "p.n", "first", "copies", responds.alias("responds"), F.when(responds, F.col("data")).alias("data"))
    first = F.when(~F.col("responds"), _record(F.col("first"), F.col("digest")))
    once = held.where(~(F.col("responds") & (F.coalesce("copies", F.lit(1)) > 1)))
    out = plain.unionByName(once.select(F.when((F.col("copies") > 1) | (F.col("n") < least), copy).otherwise(named).alias("record"), "url", "digest", "n", first.alias("refers_to"), "data"))
    if not decided.where("copies > 1 AND id <=> first").isEmpty():
        # Rows that repeat the response's id and payload: the one with the smallest number stays the response. The number is fixed by being written.
        again = cut(held.where(F.col("responds") & (F.col("copies") > 1)).withColumn("uid", F.monotonically_increasing_id()), "copies")
        lead = again.groupBy("id", "digest", "n").agg(F.min("uid").alias("uid")).select("uid", F.lit(True).alias("leads"))
        again = again.join(lead, "uid", "left").withColumn("leads", F.coalesce("leads", F.lit(False)))
        number = F.concat(F.regexp_replace(named, ">$", ":r"), F.col("uid").cast("string"), F.lit(">"))
        out = out.unionByName(
            again.select(F.when(F.col("leads"), named).otherwise(number).alias("record"), "url", "digest", "n", F.when(~F.col("leads"), named).alias("refers_to"), F.when(F.col("leads"), F.col("data")).alias("data"))
        )
    last = F.when(F.col("refers_to").isNotNull(), 0).otherwise(F.greatest(F.ceil(F.col("n") / chunk) - 1, F.lit(0))).cast("int")
    # The chunk's number is exploded, not its bytes: a row holds one chunk.
    out = out.select("record", "url", "digest", "n", "refers_to", "data", F.explode(F.sequence(F.lit(0), last)).alias("chunk_no"))
    return out.select("record", "url", "digest", "n", "refers_to", "chunk_no", F.when(F.col("refers_to").isNull(), F.substring("data", F.col("chunk_no") * chunk + 1, F.lit(chunk))).alias("payload"))


def _header(kind: str, record: str, url: str | None, digest: str, n: int, refers: str | None) -> bytes:
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {n}\r\n\r\n".encode()
    lines = [f"WARC-Type: {kind}", f"WARC-Record-ID: {record}", f"WARC-Date: {DATE}"]
    if url is not None:
        lines.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url))
    lines.append(f"WARC-Payload-Digest: sha1:{digest}")
    if refers is not None:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {refers}"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(http) + (n if refers is None else 0)}"]
    return VERSION + END + "\r\n".join(lines).encode() + END * 2 + http


def write_archives(rows: DataFrame, folder: str) -> DataFrame:
    """Write the chunk table as archives into a shared folder; returns the index (archive, start, size, record), stored."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, path = store(folder)
        place.create_dir(path, recursive=True)
        part = TaskContext.get().partitionId()
        name = f"{path}/part-{part:05d}-{uuid.uuid4().hex}.warc.gz"
        out, at, begun, now = None, 0, 0, None
        digest, packed = hashlib.sha1(), zlib.compressobj(LEVEL, wbits=31)

        def put(data: bytes, end: bool = False) -> None:
            nonlocal at
            for piece in (packed.compress(data), packed.flush() if end else b""):
                out.write(piece)
                at += len(piece)

        index: list[tuple[int, int, str]] = []

        def close() -> None:
            if now is not None:
                if now[2] is None and base64.b32encode(digest.digest()).decode() != now[1]:
                    raise ValueError(f"{now[0]}: the payload's digest changed while it was written")
                put(END * 2, end=True)
                index.append((begun, at - begun, now[0]))

        for b in batches:
            for r in zip(*(c.to_pylist() if i < 6 else c for i, c in enumerate(b.columns)), strict=True):
                record, url, sha, n, refers, chunk_no, payload = r
                if out is None:
                    out = place.open_output_stream(name, compression=None)
                if chunk_no == 0:
                    close()
                    begun, now, digest, packed = at, (record, sha, refers), hashlib.sha1(), zlib.compressobj(LEVEL, wbits=31)
                    put(_header("response" if refers is None else "revisit", record, url, sha, n, refers))
                if refers is None and (data := payload.as_buffer()) is not None:
                    digest.update(data)
                    put(data)
            if index:
                yield _index(name, folder, index)
                index = []
        if out is not None:
            close()
            out.close()
            yield _index(name, folder, index)

    def _index(name: str, uri: str, index: list) -> pa.RecordBatch:
        file = f"{uri.rstrip('/')}/{name.rsplit('/', 1)[1]}"
        return pa.RecordBatch.from_arrays([pa.array([file] * len(index)), pa.array([x[0] for x in index], pa.int64()), pa.array([x[1] for x in index], pa.int64()), pa.array([x[2] for x in index], pa.string())], names=["archive", "start", "size", "record"])

    return cut(map_arrow(rows, run, "archive string, start bigint, size bigint, record string"), "warc-index")


def _chunks_of(f: _Members, chunk: int) -> Iterator[tuple[dict, int, int, bytes, str, bool]]:
    """(headers, payload bytes, chunk number, bytes, running digest, last) for each chunk of the record at the file's place."""

    line = f.line
    f.next()
    if line() != VERSION:
        raise ValueError("no WARC record here")
    head: dict[str, str] = {}
    while text := line():
        key, _, value = text.decode("utf-8").partition(":")
        head[key.strip().lower()] = value.strip()
    before, length = f.given, 0
    line()
    while text := line():
        key, _, value = text.decode("utf-8").partition(":")
        if key.strip().lower() == "content-length":
            length = int(value)
    left = int(head["content-length"]) - (f.given - before)
    digest, at = hashlib.sha1(), 0
    while True:
        data = f.read(min(chunk, left)) if left else b""
        if left and not data:
            raise ValueError("a record ends in its payload")
        left -= len(data)
        digest.update(data)
        yield head, length, at, data, base64.b32encode(digest.digest()).decode(), not left
        at += 1
        if not left:
            break
    if f.read(5) != END * 2:
        raise ValueError("a record's end is missing")


def read_chunks(index: DataFrame, with_payload: bool = True, chunk: int = CHUNK, segment: int = SEGMENT) -> DataFrame:
    """(record, record_type, url, refers_to, payload_bytes, payload_digest, chunk_no, running_digest, last, payload) of every indexed record.

    payload_bytes and payload_digest are those of the full payload: of a response as it was read, of
    a revisit as its headers say. running_digest is that of the payload up to and with the chunk.
    """
    seg = F.floor(F.col("start") / segment)
    parts = index.groupBy("archive", seg.alias("seg")).agg(F.min("start").alias("a"), F.max(F.col("start") + F.col("size")).alias("z"))
    # Segments are few rows: adaptive execution would put them all into one task if it chose their number.
    # The hash is not what they are grouped by, so that this shuffle is not taken for the one before.
    parts = parts.repartition(max(1, min(parts.count(), TASKS)), F.xxhash64("archive", "seg"))
    schema = "record string, record_type string, url string, refers_to string, payload_bytes bigint, payload_digest string, chunk_no int, running_digest string, last boolean" + ", payload binary" * with_payload

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for archive, a, z in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                place, path = store(archive)
                rows: list[tuple] = []
                held = 0
                with place.open_input_file(path) as raw:
                    raw.seek(a)
                    f = _Members(raw)
                    while f.place() < z:
                        n = 0
                        for head, length, at, data, digest, last in _chunks_of(f, chunk):
                            n += len(data)
                            kind = head["warc-type"]
                            full = head["warc-payload-digest"].removeprefix("sha1:")
                            if last and kind == "response" and (digest != full or n != length):
                                raise ValueError(f"{head['warc-record-id']}: the payload is not what its headers say")
                            rows.append((head["warc-record-id"], kind, head.get("warc-target-uri"), head.get("warc-refers-to"), length, full, at, digest, last) + (data,) * with_payload)
                            held += len(data) * with_payload + 500
                            if held > 16 << 20:
                                yield _rows(rows)
                                rows, held = [], 0
                if rows:
                    yield _rows(rows)

    kinds = [pa.string()] * 4 + [pa.int64(), pa.string(), pa.int32(), pa.string(), pa.bool_()] + [pa.binary()] * with_payload
    names = [x.split()[0] for x in schema.split(", ")]

    def _rows(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    return map_arrow(parts, run, schema)


class _Members:
    """Reads of the gzip members of an open file, one after another, a block at a time."""

    def __init__(self, raw: pa.NativeFile, block: int = 1 << 16) -> None:
        self.raw, self.block, self.packed, self.at = raw, block, b"", raw.tell()
        self.unpack, self.data, self.given = zlib.decompressobj(31), b"", 0

    def place(self) -> int:
        """Where in the file the next member begins, once this one is read."""
        return self.at - len(self.packed)

    def next(self) -> None:
        """Begin a member; ``given`` counts the bytes it has given."""
        self.unpack, self.data, self.given = zlib.decompressobj(31), b"", 0

    def _more(self) -> bool:
        if self.unpack.eof:
            return False
        if not self.packed:
            self.packed = self.raw.read(self.block)
            self.at += len(self.packed)
            if not self.packed:
                raise ValueError("an archive ends in a record")
        self.data += self.unpack.decompress(self.packed, self.block)
        self.packed = self.unpack.unused_data if self.unpack.eof else self.unpack.unconsumed_tail
        return True

    def read(self, n: int) -> bytes:
        while len(self.data) < n and self._more():
            pass
        out, self.data = self.data[:n], self.data[n:]
        self.given += len(out)
        return out

    def line(self) -> bytes:
        """A line without its end."""
        while (i := self.data.find(b"\n")) < 0 and self._more():
            pass
        if i < 0:
            raise ValueError("a record ends in its header")
        return self.read(i + 1).rstrip(b"\r\n")


def record_id(record: Column) -> Column:
    """The page id inside a record's name; null for the record ``null``."""
    return F.regexp_extract(record, r"record:(.*?):[A-Z2-7]{32}(?::r?\d+)?>$", 1).try_cast("long")


def round_trip(spark: SparkSession, pages: DataFrame, id_col: str = "page_id", text_col: str = "html", url_col: str = "url", least: int = 0, chunk: int = CHUNK) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to: written as archives in the shared folder, and read back."""
    rows = chunk_rows(pages, decide(pages, id_col, text_col, least), id_col, text_col, url_col, chunk, least)
    index = write_archives(rows, scratch_path(spark, "warc"))
    return read_chunks(index, with_payload=False, chunk=chunk).where("last").select(
        record_id(F.col("record")).alias("page_id"), "payload_bytes", "payload_digest", "record_type", record_id(F.col("refers_to")).alias("refers_to")
    )
