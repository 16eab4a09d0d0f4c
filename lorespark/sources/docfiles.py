"""Document files as a data source: ``spark.read.format("documentfiles")`` and ``df.write.format("documentfiles")``.

The rows are id and content, one for each file ``<id>.doc`` of a folder; files.parse_documents
and files.document_files lead from them to documents and back.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from lorespark.sources import files

NAME, EXTENSION, STAGED = "documentfiles", ".doc", "_staged"
SCHEMA = "id string, content string, path string"
ROWS_PER_BATCH, BYTES_PER_BATCH = 1000, 8 << 20
MOVERS = 16


def file_system(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI, and the path in it."""
    if path.startswith("file:"):
        path = re.sub("^file:/*", "/", path)
    system, inner = fs.FileSystem.from_uri(path)
    return system, inner.rstrip("/")


def file_name(key: str) -> str:
    """A file's name for an id: what no name may hold is written as % and its code."""
    if not key:
        raise ValueError("a document file needs an id")
    return re.sub(r"[/%\0]|^[._]", lambda m: f"%{ord(m[0]):02X}", key) + EXTENSION


def key_of(name: str) -> str:
    return re.sub("%(2F|25|00|2E|5F)", lambda m: chr(int(m[1], 16)), name.removesuffix(EXTENSION))


def document_paths(system: fs.FileSystem, folder: str) -> Iterator[fs.FileInfo]:
    for info in system.get_file_info(fs.FileSelector(folder, allow_not_found=True)):
        if info.type == fs.FileType.File and info.base_name.endswith(EXTENSION) and not info.base_name.startswith((".", "_")):
            yield info


def each_of(movers: ThreadPoolExecutor, act: Callable[[fs.FileInfo], None], infos: list[fs.FileInfo]) -> None:
    """Does something to every file, a share of the files in each thread: handing them over one by one takes longer than moving them."""

    def share(k: int) -> None:
        for info in infos[k::MOVERS]:
            act(info)

    list(movers.map(share, range(MOVERS)))


@dataclass
class Files(InputPartition):
    paths: list[str]


@dataclass
class Staged(WriterCommitMessage):
    """A task's folder of finished files: one short text, whatever their number."""

    folder: str
    n: int


class DocumentReader(DataSourceReader):
    """Parts hold at most ``partitionBytes`` (64 MB) or ``partitionFiles`` (10,000) files; the driver lists names and sizes, as for any file source."""

    def __init__(self, options: dict[str, str]) -> None:
        self.path = options["path"]
        self.most_bytes, self.most_files = int(options.get("partitionbytes", 64 << 20)), int(options.get("partitionfiles", 10_000))

    def partitions(self) -> list[InputPartition]:
        system, folder = file_system(self.path)
        parts: list[InputPartition] = []
        paths, size = [], 0
        for info in sorted(document_paths(system, folder), key=lambda i: i.path):
            if paths and (size + info.size > self.most_bytes or len(paths) >= self.most_files):
                parts.append(Files(paths))
                paths, size = [], 0
            paths.append(info.path)
            size += info.size
        return [*parts, Files(paths)]

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        """A file that is no UTF-8 has a null content, so that one bad file doesn't hide the others."""
        system, _ = file_system(self.path)
        rows: list[tuple[str, str | None, str]] = []
        size = 0
        for path in partition.paths:
            with system.open_input_stream(path) as file:
                held = file.read()
            try:
                content = held.decode("utf-8")
            except UnicodeDecodeError:
                content = None
            rows.append((key_of(path.rsplit("/", 1)[-1]), content, path))
            size += len(held)
            if len(rows) >= ROWS_PER_BATCH or size >= BYTES_PER_BATCH:
                yield batch_of(rows)
                rows, size = [], 0
        yield batch_of(rows)


def batch_of(rows: list[tuple[str, str | None, str]]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [(), (), ()]
    return pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in columns], ["id", "content", "path"])


class DocumentWriter(DataSourceArrowWriter):
    """Tasks write into folders of their own; the files take their places only when all tasks have ended well.

    Of a failed attempt nothing is left, and of an attempt that was lost with its executor only
    a folder that no reader looks into and the end of the write removes. Files of other ids stay, unless the mode is "overwrite".
    """

    def __init__(self, options: dict[str, str], overwrite: bool) -> None:
        self.path, self.replace = options["path"], overwrite
        self.mark = uuid.uuid4().hex

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Staged:
        system, folder = file_system(self.path)
        own = f"{folder}/{STAGED}/{self.mark}/{uuid.uuid4().hex}"
        system.create_dir(own)
        n = 0
        try:
            for batch in iterator:
                for key, content in zip(batch.column("id"), batch.column("content"), strict=True):
                    if not key.is_valid or not content.is_valid:
                        raise ValueError("a document file needs an id and a content")
                    with system.open_output_stream(f"{own}/{file_name(key.as_py())}") as file:
                        file.write(content.as_buffer())
                    n += 1
        except BaseException:
            system.delete_dir(own)
            raise
        return Staged(own, n)

    def commit(self, messages: list[Staged | None]) -> None:
        system, folder = file_system(self.path)
        with ThreadPoolExecutor(MOVERS) as movers:
            if self.replace:
                each_of(movers, lambda i: system.delete_file(i.path), list(document_paths(system, folder)))
            for m in messages:
                if m is not None:  # one task's folder at a time
                    made = system.get_file_info(fs.FileSelector(m.folder))
                    each_of(movers, lambda i: system.move(i.path, f"{folder}/{i.base_name}"), made)
        self.clear()

    def abort(self, messages: list[Staged | None]) -> None:
        self.clear()

    def clear(self) -> None:
        system, folder = file_system(self.path)
        if system.get_file_info(f"{folder}/{STAGED}/{self.mark}").type == fs.FileType.Directory:
            system.delete_dir(f"{folder}/{STAGED}/{self.mark}")
        staged = f"{folder}/{STAGED}"
        if system.get_file_info(staged).type == fs.FileType.Directory and not system.get_file_info(fs.FileSelector(staged)):
            system.delete_dir(staged)


class DocumentFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> DocumentReader:
        return DocumentReader(self.options)

    def writer(self, schema: StructType, overwrite: bool) -> DocumentWriter:
        return DocumentWriter(self.options, overwrite)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(DocumentFiles)


def load(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Documents of a folder, and the paths of files that are no UTF-8; see files.parse_documents."""
    register(spark)
    raw = spark.read.format(NAME).load(folder)
    return files.parse_documents(raw.where("content is not null")), raw.where("content is null").select("path")


def save(docs: DataFrame, folder: str, mode: str = "append") -> None:
    """Writes each document as a file of its id, in place of what the id had; of rows with one id any one stays."""
    register(docs.sparkSession)
    files.document_files(docs).write.format(NAME).mode(mode).save(folder)


def delete(ids: DataFrame, folder: str) -> None:
    """Removes the files of the ids (id); ids without a file are passed over."""

    def remove(rows: Iterator) -> None:
        system, inner = file_system(folder)
        for row in rows:
            path = f"{inner}/{file_name(row['id'])}" if row["id"] else ""
            if path and system.get_file_info(path).type == fs.FileType.File:
                system.delete_file(path)

    ids.select("id").distinct().foreachPartition(remove)
