"""A sink of named files: df.write.format("cadenza_captions").mode("append").save(folder) writes one file a document.

Rows are (name, document). A task writes its files into a folder of its own below a staging folder; when all tasks have
ended the driver renames these folders, one a task, to where readers look; when one fails none is, and all are removed.
So a reader sees a job's files or none, the driver handles tasks rather than documents, and a task that ran twice counts
once. What a task that was still running wrote behind an abort stays in its staging folder until clear_staging()."""

from __future__ import annotations

import re
import time
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from .files import opened

NAME = "cadenza_captions"
STAGING = "_staging"


@dataclass
class Written(WriterCommitMessage):
    """A task's folder, by its number, and how many files it holds."""

    partition: int
    folder: str
    files: int


def safe_name(name: str) -> str:
    """A file name: letters, digits, dots, signs of joining; whatever else as %XX, so that two names never meet."""
    return re.sub(r"[^A-Za-z0-9._-]|^\.", lambda m: "".join(f"%{b:02X}" for b in m[0].encode()), name) or "%"


class CaptionWriter(DataSourceArrowWriter):
    def __init__(self, options: dict, overwrite: bool):
        self.path, self.suffix, self.overwrite = options["path"].rstrip("/"), options.get("suffix", ".ass"), overwrite
        self.run = uuid.uuid4().hex
        self.staging = f"{self.path}/{STAGING}-{self.run}"

    def write(self, iterator: Iterator) -> WriterCommitMessage:
        number = TaskContext.get().partitionId()
        folder = f"{self.staging}/{number:05d}-{uuid.uuid4().hex}"
        system, inner = opened(folder)
        files = 0
        try:
            for batch in iterator:
                for name, document in zip(batch.column("name").to_pylist(), batch.column("document").to_pylist(), strict=True):
                    if not files:
                        system.create_dir(inner, recursive=True)
                    with system.open_output_stream(f"{inner}/{safe_name(str(name))}{self.suffix}") as out:
                        out.write((document or "").encode())
                    files += 1
        except BaseException:
            _removed(system, inner)
            raise
        return Written(number, folder, files)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        system, inner = opened(self.path)
        system.create_dir(inner, recursive=True)
        old = [f.path for f in system.get_file_info(fs.FileSelector(inner)) if f.base_name.startswith("part-")] if self.overwrite else []
        for m in messages:
            if m is not None and m.files:
                system.move(opened(m.folder)[1], f"{inner}/part-{m.partition:05d}-{self.run}")
        for path in old:
            system.delete_dir(path)
        self._clear()

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        self._clear()

    def _clear(self) -> None:
        _removed(*opened(self.staging))


def _removed(system: fs.FileSystem, folder: str, tries: int = 5) -> None:
    """Removes a folder in which tasks may still write; what they put there behind the last try stays."""
    for _ in range(tries):
        try:
            if system.get_file_info(folder).type == fs.FileType.NotFound:
                return
            system.delete_dir(folder)
        except OSError:
            time.sleep(0.2)


def clear_staging(folder: str) -> None:
    """Removes what ended jobs have left in staging folders. No job may be writing."""
    system, inner = opened(folder)
    if system.get_file_info(inner).type == fs.FileType.Directory:
        for f in system.get_file_info(fs.FileSelector(inner)):
            if f.base_name.startswith(STAGING):
                _removed(system, f.path)


class CaptionSink(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return "name string, document string"

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return CaptionWriter(dict(self.options), overwrite)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(CaptionSink)


def write_documents(documents: DataFrame, folder: str, mode: str = "append") -> None:
    """A file for each document (clip_id, document): <folder>/part-*/<clip_id>.ass."""
    register(documents.sparkSession)
    documents.selectExpr("cast(clip_id as string) AS name", "document").write.format(NAME).mode(mode).save(folder)


def read_documents(spark: SparkSession, folder: str) -> DataFrame:
    """(name, document) of the files that committed jobs have written."""
    files = spark.read.option("pathGlobFilter", "*.ass").text(f"{folder}/part-*", wholetext=True)
    return files.selectExpr("regexp_extract(_metadata.file_name, '^(.*)[.]ass$', 1) AS name", "value AS document")
