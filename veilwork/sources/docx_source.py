"""A .docx corpus as a data source: spark.read.format("docx_units").load(folder).

The files are listed with their sizes, those that are no .docx or too large are left out before any is opened (S3), and the others are packed into partitions by size.
A task opens one file at a time and seeks in it, so that neither the bytes of a file nor its pictures pass through Spark as rows; its memory is that of the largest XML part.
The files must be on a file system that pyarrow opens (local or mounted folders, hdfs, s3, gs); units.units_from_docx reads those that only Spark's readers reach.

Options: path; maxBytes (50 MB), the most a file may have; partitionBytes (32 MB), from which a partition is full; errors ("true": rows doc_id, error of the unreadable files instead).
An empty folder gives no rows; a missing one is an error."""

from __future__ import annotations

import io
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .files import ERRORS, MOST_BYTES, UNITS, units_of_file

SMALL = 1 << 16  # bytes of a file that is read at once


def file_system(path: str) -> tuple[fs.FileSystem, str]:
    """File system and the path in it; file:/a is taken like file:///a."""
    if path.startswith("file:"):
        path = "/" + path[5:].lstrip("/")
    return fs.FileSystem.from_uri(path)


@dataclass
class Files(InputPartition):
    paths: list[str]


class DocxReader(DataSourceReader):
    def __init__(self, path: str, most_bytes: int, partition_bytes: int, errors: bool):
        self.path, self.most_bytes, self.partition_bytes, self.errors = path, most_bytes, partition_bytes, errors

    def partitions(self) -> list[Files]:
        store, root = file_system(self.path)
        info = store.get_file_info(root)
        if info.type == fs.FileType.NotFound:
            raise FileNotFoundError(self.path)
        found = [info] if info.type == fs.FileType.File else store.get_file_info(fs.FileSelector(root, recursive=True))
        kept = sorted((f.path, f.size) for f in found if f.type == fs.FileType.File and f.path.lower().endswith(".docx") and f.size <= self.most_bytes)
        out, room = [], 0
        for path, size in kept:
            if size > room:
                out.append(Files([]))
                room = self.partition_bytes
            out[-1].paths.append(path)
            room -= size
        return out or [Files([])]

    def read(self, partition: Files) -> Iterator[tuple]:
        store, _ = file_system(self.path)
        for path in partition.paths:
            with store.open_input_file(path) as file:
                units, error = units_of_file(io.BytesIO(file.read()) if file.size() < SMALL else file)
            if self.errors:
                yield from [(path, error)] if error else []
            else:
                for i, unit_id, text, runs in units:
                    yield path, i, unit_id, text, [(r["run_index"], r["run_start"], r["run_end"], r["text"]) for r in runs]


class DocxSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "docx_units"

    def _errors(self) -> bool:
        return str(self.options.get("errors", "false")).lower() == "true"

    def schema(self) -> str:
        return ERRORS if self._errors() else UNITS

    def reader(self, schema) -> DocxReader:
        return DocxReader(self.options["path"], int(self.options.get("maxBytes", MOST_BYTES)), int(self.options.get("partitionBytes", 32 << 20)), self._errors())


def register(spark: SparkSession) -> None:
    """Make the format known to a session."""
    spark.dataSource.register(DocxSource)
