"""Article files as Spark data sources: a reader, in batch and as a stream, that also sees empty files, and a writer with one
file a record.

Paths are URIs of any file system that ``pyarrow`` opens on driver and executors (a shared mount, an object store).
"""

from __future__ import annotations

import posixpath
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, DataSourceWriter, InputPartition, WriterCommitMessage

from artisieve.sources.articles import parse_article

SCHEMA = "file string, raw string, size long, changed_us long"
FORMAT = "article_files"


def opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path if ":" in path.split("/", 1)[0] else "file://" + path)


def listed(path: str) -> list[fs.FileInfo]:
    """The files below a folder by (time of change, path), without hidden ones and folders in progress."""
    system, root = opened(path)
    found = system.get_file_info(fs.FileSelector(root, recursive=True, allow_not_found=True))
    shown = lambda f: not any(part.startswith(("_", ".")) for part in posixpath.relpath(f.path, root).split("/"))
    return sorted((f for f in found if f.type == fs.FileType.File and shown(f)), key=lambda f: (f.mtime_ns, f.path))


@dataclass
class Files(InputPartition):
    names: list[tuple[str, int, int]]


def shares(files: list[fs.FileInfo], most: int) -> list[Files]:
    """Partitions of about ``most`` bytes; a file counts as 4 KB at least, so that empty files do not pile up in one."""
    out: list[Files] = []
    room = 0
    for f in files:
        cost = max(f.size, 4096)
        if not out or room < cost:
            out.append(Files([]))
            room = most
        room -= cost
        out[-1].names.append((f.path, f.size, f.mtime_ns // 1000))
    return out


def contents(path: str, partition: Files) -> Iterator[tuple]:
    system, _ = opened(path)
    for name, size, changed in partition.names:
        with system.open_input_stream(name) as f:
            yield name, f.read().decode("utf-8", "replace"), size, changed


class FileReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.most = options["path"], int(options.get("maxpartitionbytes", 64 << 20))

    def partitions(self) -> list[Files]:
        return shares(listed(self.path), self.most) or [Files([])]

    def read(self, partition: Files) -> Iterator[tuple]:
        return contents(self.path, partition)


class FileStream(DataSourceStreamReader):
    """Offsets are (time of change, path) of the last file read: files are to be moved in whole, in the order of their times."""

    def __init__(self, options: dict):
        self.path, self.most = options["path"], int(options.get("maxpartitionbytes", 64 << 20))

    def initialOffset(self) -> dict:
        return {"ns": -1, "path": ""}

    def latestOffset(self) -> dict:
        files = listed(self.path)
        return {"ns": files[-1].mtime_ns, "path": files[-1].path} if files else self.initialOffset()

    def partitions(self, start: dict, end: dict) -> list[Files]:
        low, high = (start["ns"], start["path"]), (end["ns"], end["path"])
        return shares([f for f in listed(self.path) if low < (f.mtime_ns, f.path) <= high], self.most)

    def read(self, partition: Files) -> Iterator[tuple]:
        return contents(self.path, partition)


@dataclass
class Written(WriterCommitMessage):
    rows: int


class FileWriter(DataSourceWriter):
    """Tasks write into a hidden folder of the run, under names from the rows, so that an attempt made again writes the same files.
    The commit renames that folder, at once; an abort moves it away, so that tasks still running have no folder to write to, and
    deletes it (where opening a file makes its folder, such a task may leave hidden files)."""

    def __init__(self, options: dict, overwrite: bool):
        if overwrite:
            raise ValueError("article files are only added to")
        self.path, self.run = options["path"], uuid.uuid4().hex
        system, root = opened(self.path)
        system.create_dir(posixpath.join(root, f"_{self.run}"), recursive=True)

    def write(self, rows: Iterator) -> Written:
        system, root = opened(self.path)
        into, n = posixpath.join(root, f"_{self.run}"), 0
        for row in rows:
            name = row["file_name"]
            if not name or "/" in name or name.startswith(("_", ".")):
                raise ValueError(f"not a file's name: {name!r}")
            with system.open_output_stream(posixpath.join(into, name)) as f:
                f.write((row["content"] or "").encode())
            n += 1
        return Written(n)

    def commit(self, messages: list[Written | None]) -> None:
        system, root = opened(self.path)
        into = posixpath.join(root, f"_{self.run}")
        if any(m is not None and m.rows for m in messages):
            system.move(into, posixpath.join(root, f"run-{self.run}"))
        else:
            system.delete_dir(into)

    def abort(self, messages: list[Written | None]) -> None:
        system, root = opened(self.path)
        if system.get_file_info(into := posixpath.join(root, f"_{self.run}")).type == fs.FileType.Directory:
            system.move(into, gone := f"{into}-aborted")
            system.delete_dir(gone)


class ArticleFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: object) -> FileReader:
        return FileReader(self.options)

    def streamReader(self, schema: object) -> FileStream:
        return FileStream(self.options)

    def writer(self, schema: object, overwrite: bool) -> FileWriter:
        return FileWriter(self.options, overwrite)


def parsed(raw: DataFrame) -> DataFrame:
    return raw.select("file", parse_article(raw["raw"]).alias("a"), "size", "changed_us").select("file", "a.*", "size", "changed_us")


def read_message_files(spark: SparkSession, path: str) -> DataFrame:
    """(file, headers, body, size, changed_us) of all article files below a folder; an empty file is an article without headers."""
    spark.dataSource.register(ArticleFiles)
    return parsed(spark.read.format(FORMAT).load(path))


def stream_message_files(spark: SparkSession, path: str) -> DataFrame:
    """The same as a stream: each file once, as it is moved in."""
    spark.dataSource.register(ArticleFiles)
    return parsed(spark.readStream.format(FORMAT).load(path))


def write_message_files(records: DataFrame, path: str) -> None:
    """Adds one file for each row of ``records`` (file_name, content; see ``articles.file_records``), all of them or none. Of rows with
    one name, one is kept."""
    records.sparkSession.dataSource.register(ArticleFiles)
    records.select("file_name", "content").write.format(FORMAT).mode("append").save(path)
