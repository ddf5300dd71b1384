"""NPY and NPZ files as Spark tables: `spark.read.format("npy")` and `.format("npz")`, and the same to write.

A table's rows are the first dimension of its arrays. Row ranges come from the files' headers, so that a file of any length is read in
parts; a schema that names fewer columns reads fewer arrays. `register` makes both formats known to a session.
"""

from __future__ import annotations

import io
import uuid
import zipfile
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from numpy.lib import format as npy
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.pandas.types import to_arrow_schema

#: Rows of a partition when a file is read, and of a file when a table is written.
ROWS = 65_536
_KINDS = {
    "b1": T.BooleanType(), "i1": T.ByteType(), "i2": T.ShortType(), "i4": T.IntegerType(), "i8": T.LongType(),
    "u1": T.ShortType(), "u2": T.IntegerType(), "u4": T.LongType(), "f4": T.FloatType(), "f8": T.DoubleType(),
}


@dataclass
class Header:
    """What an array's header says: shape, type, and at which byte of the file (or of the archive's member) its numbers begin."""

    shape: tuple[int, ...]
    dtype: np.dtype
    start: int

    @property
    def width(self) -> int:
        return self.dtype.itemsize * (self.shape[1] if len(self.shape) > 1 else 1)

    def spark(self) -> T.DataType:
        one = T.StringType() if self.dtype.kind in "SU" else _KINDS[f"{self.dtype.kind}{self.dtype.itemsize}"]
        return T.ArrayType(one) if len(self.shape) > 1 else one


def header(file, name: str) -> Header:
    """The header at the beginning of `file`; arrays that are no table's column are refused."""
    try:
        version = npy.read_magic(file)
        shape, fortran, dtype = npy.read_array_header_1_0(file) if version == (1, 0) else npy.read_array_header_2_0(file)
    except ValueError as e:
        raise ValueError(f"{name} has no array header: {e}") from None
    if fortran and len(shape) > 1 or not 1 <= len(shape) <= 2:
        raise ValueError(f"{name} has to have one or two dimensions in row order, not {shape}{' in column order' if fortran else ''}")
    if dtype.kind not in "SU" and f"{dtype.kind}{dtype.itemsize}" not in _KINDS:
        raise ValueError(f"{name} has numbers of type {dtype}, which no column can hold")
    return Header(shape, dtype, file.tell())


def _at(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path.removeprefix("file:"))


def _files(path: str, ending: str) -> list[str]:
    """The file, or a folder's files of that ending, by name; the names that Spark and writers hide are left out."""
    system, root = _at(path)
    info = system.get_file_info(root)
    if info.type == fs.FileType.Directory:
        return sorted(i.path for i in system.get_file_info(fs.FileSelector(root)) if i.base_name.endswith(ending) and not i.base_name.startswith(("_", ".")))
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    return [root]


def _members(path: str, file: str, ending: str) -> dict[str, Header]:
    """The arrays of a file by column; a truncated one is an error here, before any task runs."""
    system, _ = _at(path)
    with system.open_input_file(file) as f:
        if ending == ".npy":
            h = header(f, file)
            if (size := f.size()) < h.start + h.shape[0] * h.width:
                raise ValueError(f"{file} is truncated: {size} bytes of {h.start + h.shape[0] * h.width}")
            return {"value": h}
        try:
            archive = zipfile.ZipFile(f)
        except zipfile.BadZipFile as e:
            raise ValueError(f"{file} is truncated or no archive: {e}") from None
        found = {}
        for info in archive.infolist():
            with archive.open(info) as member:
                name = info.filename.removesuffix(".npy")
                found[name] = h = header(member, f"{file}:{name}")
                if info.file_size < h.start + h.shape[0] * h.width:
                    raise ValueError(f"{file}:{name} is truncated: {info.file_size} bytes of {h.start + h.shape[0] * h.width}")
        return found


@dataclass
class Rows(InputPartition):
    """Rows `lo` to `hi` of a file, whose first row is row `first` of the table."""

    file: str
    lo: int
    hi: int
    first: int


class _Reader(DataSourceReader):
    def __init__(self, path: str, ending: str, schema: T.StructType, rows: int):
        self.path, self.ending, self.schema, self.rows = path, ending, schema, rows

    def _wanted(self, members: dict[str, Header], file: str) -> dict[str, Header]:
        wanted = {}
        for field in self.schema.fields:
            if field.name == "row":
                continue
            if field.name not in members:
                raise ValueError(f"{file} has no array {field.name}, but {sorted(members)}")
            if (kind := members[field.name].spark()) != field.dataType:
                raise ValueError(f"{file}:{field.name} is {kind.simpleString()}, not {field.dataType.simpleString()}")
            wanted[field.name] = members[field.name]
        return wanted

    def partitions(self) -> list[Rows]:
        found, first = [], 0
        for file in _files(self.path, self.ending):
            members = _members(self.path, file, self.ending)
            lengths = {h.shape[0] for h in members.values()}
            if len(lengths) > 1:
                raise ValueError(f"{file} has arrays of {sorted(lengths)} rows")
            self._wanted(members, file)
            n = lengths.pop() if lengths else 0
            found += [Rows(file, lo, min(lo + self.rows, n), first) for lo in range(0, n, self.rows)]
            first += n
        return found or [Rows("", 0, 0, 0)]

    def read(self, partition: Rows) -> Iterator[pa.RecordBatch]:
        if not partition.file:
            return
        schema, system = to_arrow_schema(self.schema), _at(self.path)[0]
        members = self._wanted(_members(self.path, partition.file, self.ending), partition.file)
        step = max(1, min(8192, (32 << 20) // max(1, sum(h.width for h in members.values()))))
        with system.open_input_file(partition.file) as f:
            reads = {name: _reads(f, name, self.ending, h.start + partition.lo * h.width) for name, h in members.items()}
            for lo in range(partition.lo, partition.hi, step):
                n = min(step, partition.hi - lo)
                columns = []
                for field, kind in zip(self.schema.fields, schema):
                    if field.name == "row":
                        columns.append(pa.array(np.arange(lo, lo + n) + partition.first))
                    else:
                        h = members[field.name]
                        columns.append(_column(np.frombuffer(reads[field.name](n * h.width), h.dtype), h, kind.type))
                yield pa.RecordBatch.from_arrays(columns, schema=schema)


def _reads(f, name: str, ending: str, start: int) -> Callable[[int], bytes]:
    """Reads on from byte `start` of an array; a compressed one has to be read up to there."""
    if ending == ".npz":
        archive = zipfile.ZipFile(f)
        info = archive.getinfo(f"{name}.npy")
        if info.compress_type != zipfile.ZIP_STORED:
            member = archive.open(info)
            while start > 0:
                start -= len(member.read(min(start, 1 << 20)))
            return member.read
        f.seek(info.header_offset + 26)  # the member's own header: 30 bytes, the last of which say how long its name and extras are
        start += info.header_offset + 30 + sum(int.from_bytes(f.read(2), "little") for _ in range(2))
    at = start

    def read(n: int) -> bytes:
        nonlocal at
        f.seek(at)
        at += n
        return f.read(n)

    return read


def _column(flat: np.ndarray, h: Header, kind: pa.DataType) -> pa.Array:
    if h.dtype.kind == "S":
        flat = np.char.decode(flat, "utf-8")
    inner = kind.value_type if pa.types.is_list(kind) else kind
    values = pa.array(flat.astype(flat.dtype.newbyteorder("=")), inner)
    if len(h.shape) == 1:
        return values
    wide = h.shape[1]
    return pa.ListArray.from_arrays(pa.array(np.arange(0, len(values) + 1, wide) if wide else np.zeros(1), pa.int32()), values)


@dataclass
class Written(WriterCommitMessage):
    files: list[tuple[str, str]]


class _Writer(DataSourceArrowWriter):
    """Tasks write to names that readers don't see; the commit renames them, and takes the old files away where overwriting is asked for."""

    def __init__(self, path: str, ending: str, schema: T.StructType, overwrite: bool, rows: int):
        self.path, self.ending, self.schema, self.overwrite, self.rows = path, ending, schema, overwrite, rows
        self.names = [f.name for f in schema.fields]
        if ending == ".npy" and len(self.names) != 1:
            raise ValueError(f"an npy file holds one column, not {self.names}")

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        from pyspark import TaskContext

        task, system, root = TaskContext.get().partitionId(), *_at(self.path)
        system.create_dir(root)
        held, n, files, attempt = [], 0, [], uuid.uuid4().hex

        def flush() -> None:
            nonlocal held, n
            whole = pa.Table.from_batches(held)
            arrays = {c: _array(whole.column(c).combine_chunks(), c) for c in self.names}
            name = f"part-{task:05d}-{len(files):05d}{self.ending}"
            with system.open_output_stream(f"{root}/_{attempt}-{name}") as f:
                if self.ending == ".npy":
                    npy.write_array(f, arrays[self.names[0]], allow_pickle=False)
                else:
                    np.savez(buffer := io.BytesIO(), **arrays)
                    f.write(buffer.getvalue())
            files.append((f"_{attempt}-{name}", name))
            held, n = [], 0

        for batch in iterator:
            while batch.num_rows:
                part = batch.slice(0, self.rows - n)
                held.append(part)
                n += part.num_rows
                batch = batch.slice(part.num_rows)
                if n == self.rows:
                    flush()
        if n:
            flush()
        return Written(files)

    def commit(self, messages: list[Written | None]) -> None:
        system, root = _at(self.path)
        system.create_dir(root)
        if self.overwrite:
            for file in _files(self.path, self.ending):
                system.delete_file(file)
        write = uuid.uuid4().hex[:8]  # files of an earlier write keep their names beside these
        for m in messages:
            for old, new in m.files if m else ():
                system.move(f"{root}/{old}", f"{root}/{new if self.overwrite else new.replace('part-', f'part-{write}-')}")
        with system.open_output_stream(f"{root}/_SUCCESS"):
            pass

    def abort(self, messages: list[Written | None]) -> None:
        system, root = _at(self.path)
        for m in messages:
            for old, _ in m.files if m else ():
                system.delete_file(f"{root}/{old}")


def _array(column: pa.Array, name: str) -> np.ndarray:
    """A column as an array; nulls and lists of several lengths are refused."""
    if column.null_count:
        raise ValueError(f"{name} has nulls, which an array cannot hold")
    if not pa.types.is_list(column.type):
        if pa.types.is_string(column.type):
            return np.array([x.encode() for x in column.to_pylist()])
        return column.to_numpy(zero_copy_only=False)
    sizes = column.value_lengths().unique()
    flat = column.flatten()
    if len(sizes) > 1 or flat.null_count:
        raise ValueError(f"{name} has lists of {sorted(sizes.to_pylist())} numbers or nulls in them, which an array cannot hold")
    return flat.to_numpy(zero_copy_only=False).reshape(len(column), -1)


class _Arrays(DataSource):
    ending = ""

    def _rows(self) -> int:
        return int(self.options.get("rows", ROWS))

    def schema(self) -> T.StructType:
        """row (a row's number over all files, in the order of their names), then the first file's arrays."""
        path = self.options["path"]
        files = _files(path, self.ending)
        if not files:
            raise ValueError(f"no {self.ending} file in {path}: give a schema")
        members = _members(path, files[0], self.ending)
        return T.StructType([T.StructField("row", T.LongType()), *(T.StructField(n, h.spark()) for n, h in members.items())])

    def reader(self, schema: T.StructType) -> _Reader:
        return _Reader(self.options["path"], self.ending, schema, self._rows())

    def writer(self, schema: T.StructType, overwrite: bool) -> _Writer:
        return _Writer(self.options["path"], self.ending, schema, overwrite, self._rows())


class NpyFiles(_Arrays):
    """One array a file, as the column `value`."""

    ending = ".npy"

    @classmethod
    def name(cls) -> str:
        return "npy"


class NpzFiles(_Arrays):
    """Several arrays of equal length a file, each a column of its name."""

    ending = ".npz"

    @classmethod
    def name(cls) -> str:
        return "npz"


def register(spark: SparkSession) -> None:
    """Makes the formats known. Paths are what pyarrow opens: local ones on a shared mount, or URIs such as hdfs:// and s3://."""
    for source in (NpyFiles, NpzFiles):
        spark.dataSource.register(source)
