"""Vector, scalar, slab and npy files as Spark data sources, for reading and writing.

    register(spark)
    spark.read.format("xvec").option("element", "f32").load(folder_or_file)
    df.write.format("xvec").option("element", "f32").mode("append").save(folder)

Files are found and opened through Arrow's file systems, so that any URI it knows will do. A read has
a partition per byte range, and a range is decoded a block at a time; ordinals count through the files
in order of their names. A write makes a file per task, under a name that only a committed task
gets: what a failed attempt leaves keeps its temporary name and is never read.

Formats: ``xvec`` has [dim i32][elements] per record, of one dimension; ``vvec`` the same with a dimension
per record; ``scalar`` has packed elements; ``slab`` has pages of records with a trailing index; ``npy`` is
numpy's array format, one or two dimensions, rows as vectors.
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from orrery.functions.vec import ELEMENTS
from orrery.session import ship
from orrery.session import store as store_of

DTYPES = {"f16": "<f2", "f32": "<f4", "f64": "<f8", "u8": "u1", "u16": "<u2", "u32": "<u4", "u64": "<u8", "i8": "i1", "i16": "<i2", "i32": "<i4", "i64": "<i8"}
#: File name endings of vector and scalar files, with their element types.
SUFFIXES = {"fvec": "f32", "fvecs": "f32", "dvec": "f64", "dvecs": "f64", "mvec": "f16", "mvecs": "f16", "bvec": "u8", "bvecs": "u8", "ivec": "i32", "ivecs": "i32", "svec": "i16", "svecs": "i16"} | {f"{e}{s}": e for e in DTYPES for s in ("", "vec", "vecs", "vvec", "vvecs")} | {"ivvec": "i32", "ivvecs": "i32", "fvvec": "f32", "fvvecs": "f32"}
ARROW = {"float": pa.float32(), "double": pa.float64(), "smallint": pa.int16(), "tinyint": pa.int8(), "int": pa.int32(), "bigint": pa.int64()}
RANGE, ROWS = 32 << 20, 4096
#: Fixed values of the slab format: magic, the sizes of a page's head and footer, and its page types.
MAGIC, HEAD, FOOTER = b"SLAB", 8, 16
PAGES_PAGE, DATA_PAGE, NAMESPACES_PAGE = 1, 2, 3
PAGE = 1 << 16


@dataclass
class Range(InputPartition):
    """Bytes of a file, or for slabs a page, with the ordinal of the first record."""

    path: str
    start: int
    end: int
    first: int
    skip: int = 0


def listing(uri: str) -> list[tuple[str, int]]:
    """(path, size) of a file, or of a folder's files in order of names; hidden and unfinished ones are left out."""
    store, path = store_of(uri)
    info = store.get_file_info(path)
    if info.type == fs.FileType.File:
        return [(uri, info.size)]
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(uri)
    found = [f for f in store.get_file_info(fs.FileSelector(path)) if f.is_file and not f.base_name.startswith(("_", "."))]
    return [(f"{uri.rstrip('/')}/{f.base_name}", f.size) for f in sorted(found, key=lambda f: f.base_name)]


def _open(uri: str) -> pa.NativeFile:
    store, path = store_of(uri)
    return store.open_input_file(path)


def element_of(options: dict, uri: str) -> str:
    """The element type: as asked for, or as the file name ends."""
    if e := options.get("element"):
        if e not in DTYPES:
            raise ValueError(f"unknown element type {e!r}")
        return e
    names = [p for p, _ in listing(uri)] or [uri]
    ending = names[0].rsplit(".", 1)[-1].lower()
    if ending not in SUFFIXES:
        raise ValueError(f"{names[0]}: name the element type in the option element")
    return SUFFIXES[ending]


def _arrow(element: str) -> pa.DataType:
    kind = ELEMENTS[element]
    return ARROW.get(kind, pa.decimal128(20, 0))


def _column(flat: np.ndarray, element: str) -> pa.Array:
    kind = _arrow(element)
    if pa.types.is_decimal(kind):
        return pa.array([int(x) for x in flat], kind)
    return pa.array(flat.astype(kind.to_pandas_dtype()), kind)


class _Reader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.options, self.uri = options, options["path"]
        self.range = int(options.get("range", RANGE))


class XvecReader(_Reader):
    """Records of one dimension: ranges are whole records, so that none has to be looked for."""

    def partitions(self) -> list[Range]:
        self.element = element_of(self.options, self.uri)
        width, first, out = np.dtype(DTYPES[self.element]).itemsize, 0, []
        for path, size in listing(self.uri):
            if not size:
                continue
            with _open(path) as f:
                dim = struct.unpack("<i", f.read(4))[0]
            record = 4 + dim * width
            if dim <= 0 or size % record:
                raise ValueError(f"{path}: {size} bytes are no whole number of vectors of dimension {dim}")
            step = max(1, self.range // record) * record
            out += [Range(path, a, min(size, a + step), first + a // record, record) for a in range(0, size, step)]
            first += size // record
        return out

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        element = element_of(self.options, partition.path if "element" not in self.options else self.uri)
        dtype, record = np.dtype(DTYPES[element]), partition.skip
        dim = (record - 4) // dtype.itemsize
        with _open(partition.path) as f:
            f.seek(partition.start)
            at, ordinal = partition.start, partition.first
            while at < partition.end:
                raw = f.read(min(ROWS * record, partition.end - at))
                rows = np.frombuffer(raw, np.uint8).reshape(-1, record)
                if (rows[:, :4].copy().view("<i4") != dim).any():
                    raise ValueError(f"{partition.path}: vectors of several dimensions; read it as vvec")
                flat = rows[:, 4:].copy().view(dtype).reshape(-1)
                n = len(rows)
                vecs = pa.ListArray.from_arrays(pa.array(np.arange(0, (n + 1) * dim, dim), pa.int32()), _column(flat, element))
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(ordinal, ordinal + n)), vecs], names=["ordinal", "vec"])
                at, ordinal = at + len(raw), ordinal + n


class VvecReader(_Reader):
    """Records of any dimension. Without an index of offsets a file is one walk over its headers, on the driver for ranges, by seek."""

    def partitions(self) -> list[Range]:
        element = element_of(self.options, self.uri)
        width, first, out = np.dtype(DTYPES[element]).itemsize, 0, []
        for path, size in listing(self.uri):
            with _open(path) as f:
                at = start = 0
                begin = first
                while at < size:
                    f.seek(at)
                    at += 4 + struct.unpack("<i", f.read(4))[0] * width
                    first += 1
                    if at > size:
                        raise ValueError(f"{path}: the last vector is cut off")
                    if at - start >= self.range or at == size:
                        out.append(Range(path, start, at, begin))
                        start, begin = at, first
        return out

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        element = element_of(self.options, partition.path if "element" not in self.options else self.uri)
        dtype = np.dtype(DTYPES[element])
        with _open(partition.path) as f:
            f.seek(partition.start)
            ordinal, dims, parts = partition.first, [], []
            while f.tell() < partition.end:
                dim = struct.unpack("<i", f.read(4))[0]
                parts.append(np.frombuffer(f.read(dim * dtype.itemsize), dtype))
                dims.append(dim)
                if len(dims) == ROWS or f.tell() >= partition.end:
                    ends = np.concatenate(([0], np.cumsum(dims)))
                    vecs = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), _column(np.concatenate(parts), element))
                    yield pa.RecordBatch.from_arrays([pa.array(np.arange(ordinal, ordinal + len(dims))), vecs], names=["ordinal", "vec"])
                    ordinal, dims, parts = ordinal + len(dims), [], []


class ScalarReader(_Reader):
    def partitions(self) -> list[Range]:
        width, first, out = np.dtype(DTYPES[element_of(self.options, self.uri)]).itemsize, 0, []
        for path, size in listing(self.uri):
            if size % width:
                raise ValueError(f"{path}: {size} bytes are no whole number of elements")
            step = max(1, self.range // width) * width
            out += [Range(path, a, min(size, a + step), first + a // width) for a in range(0, size, step)]
            first += size // width
        return out

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        element = element_of(self.options, partition.path if "element" not in self.options else self.uri)
        dtype = np.dtype(DTYPES[element])
        with _open(partition.path) as f:
            f.seek(partition.start)
            at, ordinal = partition.start, partition.first
            while at < partition.end:
                raw = f.read(min(1 << 20, partition.end - at) // dtype.itemsize * dtype.itemsize)
                flat = np.frombuffer(raw, dtype)
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(ordinal, ordinal + len(flat))), _column(flat, element)], names=["ordinal", "value"])
                at, ordinal = at + len(raw), ordinal + len(flat)


class NpyReader(_Reader):
    def partitions(self) -> list[Range]:
        out, first = [], 0
        for path, _ in listing(self.uri):
            rows, dim, dtype, start = npy_header(path)
            record = dim * dtype.itemsize
            step = max(1, self.range // max(record, 1))
            out += [Range(path, start + a * record, start + min(rows, a + step) * record, first + a) for a in range(0, rows, step)]
            first += rows
        return out

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        _, dim, dtype, _ = npy_header(partition.path)
        element = next(e for e, d in DTYPES.items() if np.dtype(d) == dtype)
        with _open(partition.path) as f:
            f.seek(partition.start)
            at, ordinal = partition.start, partition.first
            while at < partition.end:
                raw = f.read(min(ROWS * dim * dtype.itemsize, partition.end - at))
                flat = np.frombuffer(raw, dtype)
                n = len(flat) // dim
                vecs = pa.ListArray.from_arrays(pa.array(np.arange(0, (n + 1) * dim, dim), pa.int32()), _column(flat, element))
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(ordinal, ordinal + n)), vecs], names=["ordinal", "vec"])
                at, ordinal = at + len(raw), ordinal + n


def npy_header(uri: str) -> tuple[int, int, np.dtype, int]:
    """(rows, dim, dtype, where the data start) of an array in C order; a flat array has dimension 1."""
    with _open(uri) as f:
        version = np.lib.format.read_magic(f)
        shape, fortran, dtype = (np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0)(f)
        if fortran and len(shape) > 1:
            raise ValueError(f"{uri}: columns first; only rows first can be read in ranges")
        return shape[0] if shape else 1, int(np.prod(shape[1:])) if len(shape) > 1 else 1, dtype, f.tell()


# Slabs: pages of [magic][page size][records][offsets (n + 1) * 4][footer]; the last page indexes the others.


def slab_page(records: list[bytes], first: int, kind: int = DATA_PAGE, namespace: int = 1) -> bytes:
    """One page. The footer holds the first ordinal (5 bytes), the record count (3), the page size (4), type, namespace, and its own length (2)."""
    ends = np.concatenate(([0], np.cumsum([len(r) for r in records]))).astype("<u4") + HEAD
    size = HEAD + sum(map(len, records)) + 4 * (len(records) + 1) + FOOTER
    footer = first.to_bytes(5, "little", signed=True) + len(records).to_bytes(3, "little") + struct.pack("<IBBH", size, kind, namespace, FOOTER)
    return MAGIC + struct.pack("<I", size) + b"".join(records) + ends.tobytes() + footer


def slab_footer(data: bytes) -> tuple[int, int, int, int, int]:
    """(first ordinal, records, page size, type, namespace) from a page's last bytes."""
    size, kind, namespace, length = struct.unpack("<IBBH", data[8:16])
    if length != FOOTER:
        raise ValueError("this is no slab footer")
    return int.from_bytes(data[:5], "little", signed=True), int.from_bytes(data[5:8], "little"), size, kind, namespace


def slab_records(page: bytes) -> list[tuple[int, bytes]]:
    """(ordinal, bytes) of a page's records, after a check of its frame."""
    first, n, size, _, _ = slab_footer(page[-FOOTER:])
    if page[:4] != MAGIC or size != len(page) or struct.unpack("<I", page[4:8])[0] != size:
        raise ValueError("a slab page is damaged")
    ends = np.frombuffer(page[-FOOTER - 4 * (n + 1) : -FOOTER], "<u4")
    return [(first + i, page[ends[i] : ends[i + 1]]) for i in range(n)]


def slab_index(uri: str) -> list[tuple[int, int, int, int]]:
    """(first ordinal, offset, size, namespace) of a file's live data pages, from its last page."""
    with _open(uri) as f:
        end = f.size()
        f.seek(end - FOOTER)
        _, _, size, kind, _ = slab_footer(f.read(FOOTER))
        if kind == NAMESPACES_PAGE:
            raise ValueError(f"{uri}: it has several namespaces; export the one that is wanted first")
        if kind != PAGES_PAGE:
            raise ValueError(f"{uri}: the index page is missing")
        f.seek(end - size)
        out = []
        for _, r in slab_records(f.read(size)):
            first, offset = struct.unpack("<qq", r)
            f.seek(offset + 4)
            page = struct.unpack("<I", f.read(4))[0]
            f.seek(offset + page - FOOTER)
            out.append((first, offset, page, slab_footer(f.read(FOOTER))[4]))
        return out


class SlabReader(_Reader):
    """A partition per group of pages. The options first and last prune pages by the ordinals they hold."""

    def partitions(self) -> list[Range]:
        low, high = int(self.options.get("first", -(2**62))), int(self.options.get("last", 2**62))
        out: list[Range] = []
        for path, _ in listing(self.uri):
            pages = slab_index(path)
            for i, (first, offset, size, _) in enumerate(pages):
                after = pages[i + 1][0] if i + 1 < len(pages) else 2**62
                if after <= low or first > high:
                    continue
                if out and out[-1].path == path and out[-1].end == offset and offset + size - out[-1].start <= self.range:
                    out[-1].end = offset + size
                else:
                    out.append(Range(path, offset, offset + size, first))
        return out

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        low, high = int(self.options.get("first", -(2**62))), int(self.options.get("last", 2**62))
        with _open(partition.path) as f:
            at = partition.start
            while at < partition.end:
                f.seek(at + 4)
                size = struct.unpack("<I", f.read(4))[0]
                f.seek(at)
                page = f.read(size)
                namespace = slab_footer(page[-FOOTER:])[4]
                rows = [(i, r) for i, r in slab_records(page) if low <= i <= high]
                yield pa.RecordBatch.from_arrays([pa.array([namespace] * len(rows), pa.int32()), pa.array([i for i, _ in rows], pa.int64()), pa.array([r for _, r in rows], pa.binary())], names=["namespace", "ordinal", "payload"])
                at += size


@dataclass
class Written(WriterCommitMessage):
    temporary: str
    final: str


class _Writer(DataSourceWriter):
    """A file per task; rows are written in order of their ordinals as the task gets them."""

    def __init__(self, options: dict, overwrite: bool, ending: str) -> None:
        self.options, self.uri, self.overwrite, self.ending = options, options["path"], overwrite, ending

    def write(self, iterator) -> WriterCommitMessage:
        from pyspark import TaskContext

        store, path = store_of(self.uri)
        store.create_dir(path, recursive=True)
        name = f"part-{TaskContext.get().partitionId():05d}-{uuid.uuid4().hex[:8]}.{self.ending}"
        with store.open_output_stream(f"{path}/_{name}", compression=None) as out:
            self.encode(iterator, out)
        return Written(f"{path}/_{name}", f"{path}/{name}")

    def encode(self, iterator, out: pa.NativeFile) -> None:
        raise NotImplementedError

    def commit(self, messages: list) -> None:
        store, path = store_of(self.uri)
        if self.overwrite:
            for f in store.get_file_info(fs.FileSelector(path)):
                if f.is_file and not f.base_name.startswith(("_", ".")):
                    store.delete_file(f.path)
        for m in messages:
            if m is not None:
                store.move(m.temporary, m.final)

    def abort(self, messages: list) -> None:
        store, _ = store_of(self.uri)
        for m in messages:
            if m is not None:
                store.delete_file(m.temporary)


class VectorWriter(_Writer):
    def encode(self, iterator, out: pa.NativeFile) -> None:
        dtype = np.dtype(DTYPES[self.options.get("element", "f32")])
        dim = None
        for row in iterator:
            v = np.array([x for x in row["vec"]], dtype)
            if self.ending.endswith("vvecs") is False and dim not in (None, len(v)):
                raise ValueError("vectors of several dimensions; write them as vvec")
            dim = len(v)
            out.write(struct.pack("<i", dim) + v.tobytes())


class ScalarWriter(_Writer):
    def encode(self, iterator, out: pa.NativeFile) -> None:
        dtype = np.dtype(DTYPES[self.options.get("element", "i32")])
        held: list = []
        for row in iterator:
            held.append(row["value"])
            if len(held) == 1 << 16:
                out.write(np.array(held, dtype).tobytes())
                held = []
        out.write(np.array(held, dtype).tobytes())


class SlabWriter(_Writer):
    """Pages of about the option page_size; a gap in the ordinals starts a new page."""

    def encode(self, iterator, out: pa.NativeFile) -> None:
        most, at, index = int(self.options.get("page_size", PAGE)), 0, []
        held: list[bytes] = []
        first = size = 0

        def flush() -> None:
            nonlocal at, held, size
            if held:
                page = slab_page(held, first)
                out.write(page)
                index.append((first, at))
                at += len(page)
            held, size = [], 0

        for row in iterator:
            r, o = bytes(row["payload"]), row["ordinal"]
            if held and (o != first + len(held) or size + len(r) + 4 > most - HEAD - FOOTER - 4):
                if o < first + len(held):
                    raise ValueError("ordinals must rise within a task; sort within partitions first")
                flush()
            if not held:
                first = o
            held.append(r)
            size += len(r) + 4
        flush()
        out.write(slab_page([struct.pack("<qq", *x) for x in index], 0, PAGES_PAGE))


class _Source(DataSource):
    kind: str
    reads: type[_Reader]

    @classmethod
    def name(cls) -> str:
        return cls.kind

    def schema(self) -> str:
        return f"ordinal bigint, vec array<{ELEMENTS[element_of(self.options, self.options['path'])]}>"

    def reader(self, schema: StructType) -> DataSourceReader:
        return self.reads(dict(self.options))

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        raise NotImplementedError(f"{self.kind} cannot be written")


class Xvec(_Source):
    kind, reads = "xvec", XvecReader

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return VectorWriter(dict(self.options), overwrite, f"{self.options.get('element', 'f32')}vecs")


class Vvec(_Source):
    kind, reads = "vvec", VvecReader

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return VectorWriter(dict(self.options), overwrite, f"{self.options.get('element', 'f32')}vvecs")


class Scalar(_Source):
    kind, reads = "scalar", ScalarReader

    def schema(self) -> str:
        return f"ordinal bigint, value {ELEMENTS[element_of(self.options, self.options['path'])]}"

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return ScalarWriter(dict(self.options), overwrite, self.options.get("element", "i32"))


class Npy(_Source):
    kind, reads = "npy", NpyReader

    def schema(self) -> str:
        _, _, dtype, _ = npy_header(listing(self.options["path"])[0][0])
        element = next(e for e, d in DTYPES.items() if np.dtype(d) == dtype)
        return f"ordinal bigint, vec array<{ELEMENTS[element]}>"


class Slab(_Source):
    kind, reads = "slab", SlabReader

    def schema(self) -> str:
        return "namespace int, ordinal bigint, payload binary"

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return SlabWriter(dict(self.options), overwrite, "slab")


SOURCES = (Xvec, Vvec, Scalar, Slab, Npy)


def register(spark: SparkSession) -> None:
    """Make the formats known to a session."""
    ship(spark)
    for s in SOURCES:
        spark.dataSource.register(s)


def probe(uri: str) -> str:
    """The format that a file's name or first bytes say."""
    path = listing(uri)[0][0]
    ending = path.rsplit(".", 1)[-1].lower()
    if ending in ("parquet", "npy", "slab", "jsonl", "json", "csv"):
        return ending
    if ending in SUFFIXES:
        return "vvec" if ending.rstrip("s").endswith("vvec") else "xvec" if ending.rstrip("s").endswith("vec") else "scalar"
    with _open(path) as f:
        head = f.read(8)
    return "slab" if head[:4] == MAGIC else "npy" if head[:6] == b"\x93NUMPY" else "parquet" if head[:4] == b"PAR1" else "unknown"
