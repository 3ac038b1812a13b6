"""A Spark data source for delimited text files, each with a header of its own, read in one pass.

``spark.read.format("month_files")`` lists the folders and files of ``paths`` and packs byte ranges of the files into
partitions of even size. Without a schema it has one row a file, (path, line), with the first line that isn't blank: a few bytes
are read of each file, in tasks. With a schema it has the files' rows, aligned to it by the names of their own headers: a task
reads its byte ranges and the head of each of their files. Columns are text; a column that a file lacks is null, and so is an
empty field without quotes. Two columns that the schema may ask for beside those of the files:

- ``filename``: the file's URI;
- ``_rejected``: true for a line of another width than its header, whose other fields are null.

Fields follow RFC 4180: quotes are doubled inside quotes. Line breaks inside quotes need ``multi_line``, which reads a file as
one range. A file that doesn't exist when it is read, or that isn't parsed, fails the read.

Files are opened with Arrow's file systems: local ones, ``hdfs``, ``s3`` (also named ``s3a``), ``gs`` and ``abfs``.
"""

from __future__ import annotations

import csv
import json
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.csv as pacsv
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import BooleanType, StringType, StructField, StructType

BYTE_ORDER_MARK = "﻿"
RANGE_BYTES = 64 << 20
HEAD_BYTES = 1 << 16
FILE_OPEN_COST = 1 << 20
HEADS = "path string, line string"
REJECTED, FILENAME = "_rejected", "filename"
_ALIAS = {"s3a": "s3", "s3n": "s3"}


def header_names(line: str, sep: str = ",") -> list[str]:
    """Column names of a header line; empty and repeated names are numbered."""
    names: list[str] = []
    for place, name in enumerate(next(csv.reader([line.removeprefix(BYTE_ORDER_MARK)], delimiter=sep))):
        name = name.strip() or f"column{place}"
        names.append(name if name.lower() not in {n.lower() for n in names} else f"{name}_{place}")
    return names


def open_path(uri: str) -> tuple[pafs.FileSystem, str, str]:
    """File system, path in it, and what stands before the path in a URI."""
    if "://" not in uri:
        uri = f"file://{uri.removeprefix('file:')}"
    scheme, rest = uri.split("://", 1)
    filesystem, path = pafs.FileSystem.from_uri(f"{_ALIAS.get(scheme, scheme)}://{rest}")
    return filesystem, path, uri[: len(uri) - len(path)] if uri.endswith(path) else f"{scheme}://"


@dataclass
class Ranges(InputPartition):
    """(URI, start, end) of each byte range; a line belongs to the range that holds its first byte."""

    parts: list[tuple[str, int, int]]


class MonthFilesReader(DataSourceReader):
    def __init__(self, options: dict[str, str], schema: StructType, heads: bool):
        self.paths = json.loads(options["paths"])
        self.suffixes = tuple("." + s for s in options.get("suffixes", "csv,txt").split(","))
        self.sep = options.get("sep", ",")
        self.multi_line = options.get("multi_line", "false") == "true"
        self.range_bytes = int(options.get("range_bytes", RANGE_BYTES))
        self.schema, self.heads = schema, heads

    def _files(self) -> Iterator[tuple[str, int]]:
        for uri in self.paths:
            filesystem, path, prefix = open_path(uri)
            info = filesystem.get_file_info(path.rstrip("/") or "/")
            found = [info] if info.type == pafs.FileType.File else filesystem.get_file_info(
                pafs.FileSelector(info.path, allow_not_found=True, recursive=True))
            for file in found:
                hidden = any(part[:1] in "._" for part in file.path[len(info.path) :].split("/") if part)
                if file.type == pafs.FileType.File and not hidden and file.path.lower().endswith(self.suffixes):
                    yield prefix + file.path, file.size

    def partitions(self) -> Sequence[InputPartition]:
        packed, weight = [Ranges([])], 0
        for uri, size in sorted(self._files()):
            step = size if self.heads or self.multi_line else self.range_bytes
            for start in range(0, max(size, 1), max(step, 1)):
                end = min(start + step, size)
                cost = FILE_OPEN_COST + (HEAD_BYTES if self.heads else end - start)
                if packed[-1].parts and weight + cost > self.range_bytes:
                    packed.append(Ranges([]))
                    weight = 0
                packed[-1].parts.append((uri, start, end))
                weight += cost
        return packed

    def read(self, partition: Ranges) -> Iterator[pa.RecordBatch]:
        for uri, start, end in partition.parts:
            filesystem, path, _ = open_path(uri)
            with filesystem.open_input_file(path) as file:
                line, body = self._head(file)
                if self.heads:
                    if line is not None:
                        yield pa.RecordBatch.from_pydict({"path": [uri], "line": [line.removeprefix(BYTE_ORDER_MARK)]})
                elif line is not None:
                    yield from self._rows(file, uri, header_names(line, self.sep), max(start, body), end, start <= body)

    def _head(self, file: pa.NativeFile) -> tuple[str | None, int]:
        """The first line that isn't blank, and where the one after it begins."""
        file.seek(0)
        held, at = b"", 0
        while True:
            more = file.read(HEAD_BYTES)
            held += more
            while (cut := held.find(b"\n")) >= 0:
                line, held, at = held[:cut], held[cut + 1 :], at + cut + 1
                if line.strip():
                    return line.decode(errors="replace").rstrip("\r"), at
            if not more:
                return (held.decode(errors="replace").rstrip("\r"), at + len(held)) if held.strip() else (None, 0)

    def _rows(self, file: pa.NativeFile, uri: str, names: list[str], start: int, end: int, first: bool) -> Iterator[pa.RecordBatch]:
        data = self._whole_lines(file, start, end, first)
        if not data.strip():
            return
        rejected = 0

        def count(_row) -> str:
            nonlocal rejected
            rejected += 1
            return "skip"

        table = pacsv.read_csv(
            pa.BufferReader(data),
            read_options=pacsv.ReadOptions(column_names=names, use_threads=False),
            parse_options=pacsv.ParseOptions(delimiter=self.sep, newlines_in_values=self.multi_line, invalid_row_handler=count),
            convert_options=pacsv.ConvertOptions(column_types={n: pa.string() for n in names}, check_utf8=False, null_values=[""],
                                                 strings_can_be_null=True, quoted_strings_can_be_null=False),
        )
        own = {n.lower(): n for n in names}
        fields = self.schema.names

        def column(name: str, batch: pa.RecordBatch | None, n: int) -> pa.Array:
            if name == REJECTED:
                return pa.array([batch is None] * n)
            if name == FILENAME:
                return pa.array([uri] * n)
            if batch is None or name.lower() not in own:
                return pa.nulls(n, pa.string())
            return batch.column(own[name.lower()])

        for batch in table.to_batches(max_chunksize=1 << 16):
            yield pa.RecordBatch.from_arrays([column(f, batch, len(batch)) for f in fields], fields)
        if rejected and REJECTED in fields:
            yield pa.RecordBatch.from_arrays([column(f, None, rejected) for f in fields], fields)

    @staticmethod
    def _whole_lines(file: pa.NativeFile, start: int, end: int, first: bool) -> bytes:
        """Lines that begin in [start, end); one that begins before ``start`` is the range's before."""
        at = start if first else start - 1
        file.seek(at)
        data = file.read(max(end - at, 0))
        if not first:
            cut = data.find(b"\n")
            if cut < 0:
                return b""
            data = data[cut + 1 :]
        if data and not data.endswith(b"\n"):
            parts = [data]
            while more := file.read(HEAD_BYTES):
                cut = more.find(b"\n")
                parts.append(more[: cut + 1] if cut >= 0 else more)
                if cut >= 0:
                    break
            data = b"".join(parts)
        return data


class MonthFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return "month_files"

    def schema(self) -> str:
        return HEADS

    def reader(self, schema: StructType) -> DataSourceReader:
        return MonthFilesReader(dict(self.options), schema, schema.names == ["path", "line"])


def _reader(spark: SparkSession, paths: Sequence[str], **options: str):
    spark.dataSource.register(MonthFiles)
    return spark.read.format("month_files").options(paths=json.dumps(list(paths)), **options)


def heads(spark: SparkSession, paths: Sequence[str], suffixes: str) -> DataFrame:
    """(path, line): the first line that isn't blank of each file."""
    return _reader(spark, paths, suffixes=suffixes).load()


def rows(spark: SparkSession, paths: Sequence[str], suffixes: str, sep: str = ",", multi_line: bool = False) -> DataFrame:
    """All files' rows, with the columns of all headers, ``filename`` and ``_rejected``. Only distinct headers reach the driver."""
    names: dict[str, str] = {}
    for head in heads(spark, paths, suffixes).select("line").distinct().orderBy("line").collect():
        for name in header_names(head["line"], sep):
            names.setdefault(name.lower(), name)
    fields = [StructField(n, StringType()) for k, n in names.items() if k not in (FILENAME, REJECTED)]
    schema = StructType([*fields, StructField(FILENAME, StringType()), StructField(REJECTED, BooleanType())])
    return _reader(spark, paths, suffixes=suffixes, sep=sep, multi_line=str(multi_line).lower()).schema(schema).load()
