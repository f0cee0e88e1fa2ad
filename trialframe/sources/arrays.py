"""Cubes in array files as a data source: tasks are byte ranges of the files, not whole files.

The driver lists the files only. A task reads its file's header, or its table of contents, and then the
values of its own range in pieces, so neither files nor arrays have to fit in memory. Filters on session
and cond are pushed: other sessions' files are not opened, other conditions' values not read.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition, IsNotNull
from pyspark.sql.types import StructType

CUBE = "session string, cond int, trial int, frame int, pixel int, value float"
#: File names of each format: condition and session, or the session alone.
NAMES = {"npy": r"conds[A-Za-z]*(?P<cond>\d+)_(?P<session>.+)\.npy", "mat": r"conds_(?P<session>.+)\.mat"}
#: Bytes of a file that one task reads, and cells that are turned into rows at a time.
TASK_BYTES, CHUNK = 64 << 20, 200_000
#: Fixed values of the MAT level 5 format: element types that hold numbers, and those used here by name.
MAT_NUMBERS = {1: "i1", 2: "u1", 3: "i2", 4: "u2", 5: "i4", 6: "u4", 7: "f4", 9: "f8", 12: "i8", 13: "u8"}
MAT_MATRIX, MAT_COMPRESSED, MAT_HEADER = 14, 15, 128


@dataclass
class ByteRange(InputPartition):
    """Bytes [first, last) of a file."""

    path: str
    size: int
    first: int
    last: int
    session: str
    cond: int | None


def _cells(values: np.ndarray, at: int, shape: tuple, order: str, session: str, cond: int) -> pa.RecordBatch:
    """Rows of the values whose places in the stored (pixels, frames, trials) array start at `at`."""
    pixel, frame, trial = (x.astype(np.int32) for x in np.unravel_index(np.arange(at, at + len(values)), shape, order=order))
    n = len(values)
    columns = [pa.repeat(pa.scalar(session), n), pa.repeat(pa.scalar(cond, pa.int32()), n), pa.array(trial), pa.array(frame), pa.array(pixel), pa.array(values.astype(np.float32))]
    return pa.RecordBatch.from_arrays(columns, ["session", "cond", "trial", "frame", "pixel", "value"])


def _require_cube(shape: tuple, session: str, cond: int) -> None:
    if len(shape) != 3:
        raise ValueError(f"session {session}, condition {cond}: a cube has 3 axes, not {len(shape)}")


def _npy_rows(file, part: ByteRange) -> Iterator[pa.RecordBatch]:
    """Cells whose first byte lies in the range."""
    version = np.lib.format.read_magic(file)
    header = {(1, 0): np.lib.format.read_array_header_1_0, (2, 0): np.lib.format.read_array_header_2_0}.get(version)
    if header is None:
        raise ValueError(f"{part.path}: version {version} is not read")
    shape, by_column, dtype = header(file)
    _require_cube(shape, part.session, part.cond)
    if dtype.kind not in "biuf":
        raise ValueError(f"{part.path}: {dtype} is no real number")
    start, n, item = file.tell(), int(np.prod(shape, dtype=np.int64)), dtype.itemsize
    if start + n * item > part.size:
        raise ValueError(f"{part.path}: the file ends before its array")
    first, last = (min(n, max(0, -(-(b - start) // item))) for b in (part.first, part.last))
    file.seek(start + first * item)
    for i in range(first, last, CHUNK):
        values = np.frombuffer(file.read(min(CHUNK, last - i) * item), dtype)
        yield _cells(values, i, shape, "F" if by_column else "C", part.session, part.cond)


class _Inflated:
    """read(n) of a compressed element, piece by piece."""

    def __init__(self, file, size: int):
        self.file, self.left, self.inflate = file, size, zlib.decompressobj()

    def read(self, n: int) -> bytes:
        pieces = []
        while n:
            data = self.inflate.unconsumed_tail
            if not data:
                data = self.file.read(min(self.left, 1 << 20))
                self.left -= len(data)
            piece = self.inflate.decompress(data, n)
            if not piece and not data:
                break
            pieces.append(piece)
            n -= len(piece)
        return b"".join(pieces)


def _exactly(stream, n: int) -> bytes:
    data = stream.read(n)
    if len(data) < n:
        raise ValueError("an array file ends before its array")
    return data


def _tag(stream, order: str) -> tuple[int, int, bytes | None]:
    """Kind and size of a data element; small elements keep their size in the upper half of the kind and their body in the tag."""
    tag = _exactly(stream, 8)
    kind, size = struct.unpack(order + "II", tag)
    return (kind & 0xFFFF, kind >> 16, tag[4 : 4 + (kind >> 16)]) if kind >> 16 else (kind, size, None)


def _body(stream, order: str) -> bytes:
    _, size, body = _tag(stream, order)
    return _exactly(stream, size + -size % 8)[:size] if body is None else body


def _mat_variable(stream, order: str, session: str, wanted: set | None) -> Iterator[pa.RecordBatch]:
    """Cells of one matrix if it is a condition's cube that is wanted. The stream stands behind the matrix's tag."""
    _body(stream, order)  # flags
    shape = tuple(np.frombuffer(_body(stream, order), order + "i4").tolist())
    name = re.fullmatch(r"cond(\d+)", _body(stream, order).decode())
    if not name or (wanted is not None and int(name[1]) not in wanted):
        return
    kind, size, body = _tag(stream, order)
    if kind not in MAT_NUMBERS:
        return
    cond, dtype, n = int(name[1]), np.dtype(order + MAT_NUMBERS[kind]), int(np.prod(shape, dtype=np.int64))
    _require_cube(shape, session, cond)
    if n * dtype.itemsize != size:
        raise ValueError(f"session {session}, condition {cond}: {size} bytes are no array of {shape}")
    for i in range(0, n, CHUNK):
        want = min(CHUNK, n - i) * dtype.itemsize
        yield _cells(np.frombuffer(body or _exactly(stream, want), dtype), i, shape, "F", session, cond)


def _mat_rows(file, part: ByteRange, wanted: set | None) -> Iterator[pa.RecordBatch]:
    """Cells of the variables whose tag lies in the range; a variable is read by one task, as a stream."""
    file.seek(126)
    order = "<" if file.read(2) == b"IM" else ">"
    at = MAT_HEADER
    while at + 8 <= part.size and at < part.last:
        file.seek(at)
        kind, size, body = _tag(file, order)
        after = at + 8 + (0 if body is not None else size + (-size % 8 if kind != MAT_COMPRESSED else 0))
        if at >= part.first and body is None:
            stream = file
            if kind == MAT_COMPRESSED:
                stream = _Inflated(file, size)
                kind = _tag(stream, order)[0]
            if kind == MAT_MATRIX:
                yield from _mat_variable(stream, order, part.session, wanted)
        at = after


class ArrayReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.kind = options["path"], options.get("kind", "npy")
        self.task_bytes = int(options.get("taskBytes", TASK_BYTES))
        if self.kind not in NAMES or self.task_bytes < 1:
            raise ValueError("kind is npy or mat, taskBytes is positive")
        self.wanted: dict[str, set | None] = {"session": None, "cond": None}

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            column = ".".join(getattr(f, "attribute", ()))
            if column in self.wanted and isinstance(f, (EqualTo, In)):
                values = set(f.value) if isinstance(f, In) else {f.value}
                self.wanted[column] = values if self.wanted[column] is None else self.wanted[column] & values
            elif not (column in self.wanted and isinstance(f, IsNotNull)):  # these two are never null
                yield f

    def _wants(self, column: str, value) -> bool:
        return self.wanted[column] is None or value is None or value in self.wanted[column]

    def partitions(self) -> list[ByteRange]:
        system, path = _file_system(self.path)
        found = system.get_file_info(path)
        files = [found] if found.is_file else system.get_file_info(fs.FileSelector(path, recursive=True))
        out = []
        for f in sorted((f for f in files if f.is_file), key=lambda f: f.path):
            name = re.fullmatch(NAMES[self.kind], f.base_name)
            if not name:
                continue
            session, cond = name["session"], int(name["cond"]) if self.kind == "npy" else None
            if self._wants("session", session) and self._wants("cond", cond):
                out += [ByteRange(f.path, f.size, a, min(f.size, a + self.task_bytes), session, cond) for a in range(0, f.size, self.task_bytes)]
        return out

    def read(self, partition: ByteRange | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # no file
            return
        system, _ = _file_system(self.path)
        with system.open_input_file(partition.path) as file:
            yield from _npy_rows(file, partition) if self.kind == "npy" else _mat_rows(file, partition, self.wanted["cond"])


def _file_system(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or address, and the path in it."""
    if not re.match(r"[a-z][a-z0-9+.-]*:", path):
        path = fs.LocalFileSystem().normalize_path(path)
        return fs.LocalFileSystem(), path
    if path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(re.sub(r"^s3[an]:", "s3:", path))


class ArrayCubes(DataSource):
    """Format "arraycubes"; options path (a folder or file), kind (npy or mat) and taskBytes."""

    @classmethod
    def name(cls) -> str:
        return "arraycubes"

    def schema(self) -> str:
        return CUBE

    def reader(self, schema: StructType) -> ArrayReader:
        return ArrayReader(self.options)
