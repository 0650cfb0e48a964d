"""Python data sources: exports and database tables that are read in planned parts, objects that are written whole or not at all.

    spark.dataSource.register(JsonArrays)
    spark.read.format("json_arrays").schema("id long, text string").load("s3://…/export/*.json")

Folders are reached by ``pyarrow.fs``, so by path or by URI (file, s3, gs, hdfs), from executors as from the driver; the database file must be where all of them see it.
"""

from __future__ import annotations

import fnmatch
import json
import posixpath
import sqlite3
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

#: Bytes that are read at once.
CHUNK = 1 << 20


def opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def listed(path: str) -> list[tuple[str, int]]:
    """Files of a folder, or of a folder's name with a pattern after it, in order, with their sizes; hidden ones are not there."""
    base, pattern = path.rsplit("/", 1) if any(c in path.rsplit("/", 1)[-1] for c in "*?[") else (path, "*")
    system, own = opened(base)
    info = system.get_file_info(own)
    found = [info] if info.type == fs.FileType.File else system.get_file_info(fs.FileSelector(own, allow_not_found=True))
    return sorted((f.path, f.size) for f in found if f.type == fs.FileType.File and not f.base_name.startswith((".", "_")) and fnmatch.fnmatchcase(f.base_name, pattern))


@dataclass
class Part(InputPartition):
    """A file, or a range of keys."""

    name: str
    start: int = 0
    stop: int = 0


# -- exports ----------------------------------------------------------------------------------------------------


def array_items(stream, chunk: int = CHUNK) -> Iterator[dict]:
    """Items of a file that is one JSON array, one after the other; only the text of an item and a chunk are held."""
    decoder, text, at, begun = json.JSONDecoder(), "", 0, False
    pending = b""
    while True:
        data = stream.read(chunk)
        pending += data
        # A character that is cut by the chunk's end waits for its rest.
        try:
            new, pending = pending.decode(), b""
        except UnicodeDecodeError as e:
            if not data or len(pending) - e.start > 3:
                raise
            new, pending = pending[: e.start].decode(), pending[e.start :]
        text, at = text[at:] + new, 0
        while True:
            while at < len(text) and text[at] in " \t\r\n,":
                at += 1
            if at < len(text) and not begun:
                if text[at] != "[":
                    raise ValueError("the file is not a JSON array")
                begun, at = True, at + 1
                continue
            if at >= len(text):
                break
            if text[at] == "]":
                return
            try:
                item, end = decoder.raw_decode(text, at)
            except json.JSONDecodeError:
                if not data:
                    raise
                break
            if end == len(text) and data and not isinstance(item, (dict, list)):
                break
            yield item
            at = end
        if not data:
            if begun:
                raise ValueError("the array is cut off")
            return


class JsonArrays(DataSource):
    """Files that hold one JSON array of objects each: a partition a file, an object a row; what an object lacks is null, and nested values come as their JSON."""

    @classmethod
    def name(cls) -> str:
        return "json_arrays"

    def reader(self, schema: StructType) -> DataSourceReader:
        return _ArrayReader(self.options["path"], schema)


class _ArrayReader(DataSourceReader):
    def __init__(self, path: str, schema: StructType):
        self.path, self.fields = path, [(f.name, f.dataType.typeName()) for f in schema.fields]

    def partitions(self) -> list[InputPartition]:
        return [Part(name) for name, _ in listed(self.path)]

    def read(self, partition: Part) -> Iterator[tuple]:
        system = opened(self.path)[0]
        with system.open_input_stream(partition.name) as stream:
            for item in array_items(stream):
                yield tuple(_fitted(item.get(name), kind) for name, kind in self.fields)


def _fitted(x, kind: str):
    if x is None or kind == "string" and isinstance(x, str):
        return x
    if kind == "string":
        return json.dumps(x, ensure_ascii=False)
    return float(x) if kind in ("double", "float") else x


# -- tables of a database file ----------------------------------------------------------------------------------


class SqliteTable(DataSource):
    """A table of an SQLite file by ranges of its row ids, ``rows`` to a partition (100 000); each is read page by page after the last row id seen, never by offset.

    Options: path, table, rows, page (300).  The schema names the columns that are read.
    """

    @classmethod
    def name(cls) -> str:
        return "sqlite_table"

    def reader(self, schema: StructType) -> DataSourceReader:
        return _TableReader(self.options, schema)


def _name(x: str) -> str:
    return '"' + x.replace('"', '""') + '"'


class _TableReader(DataSourceReader):
    def __init__(self, options: dict, schema: StructType):
        self.path, self.table = options["path"].removeprefix("file://"), options["table"]
        self.rows, self.page = int(options.get("rows", 100_000)), int(options.get("page", 300))
        self.columns = ", ".join(_name(f.name) for f in schema.fields)

    def _open(self) -> sqlite3.Connection:
        return sqlite3.connect(f"file:{self.path}?mode=ro", uri=True)

    def partitions(self) -> list[InputPartition]:
        db = self._open()
        low, high = db.execute(f"SELECT min(rowid), max(rowid) FROM {_name(self.table)}").fetchone()
        db.close()
        return [] if low is None else [Part(self.table, a, min(a + self.rows, high + 1)) for a in range(low, high + 1, self.rows)]

    def read(self, partition: Part) -> Iterator[tuple]:
        db, last = self._open(), partition.start - 1
        try:
            while page := db.execute(f"SELECT rowid, {self.columns} FROM {_name(self.table)} WHERE rowid > ? AND rowid < ? ORDER BY rowid LIMIT ?", (last, partition.stop, self.page)).fetchall():
                yield from (row[1:] for row in page)
                last = page[-1][0]
        finally:
            db.close()


# -- objects ----------------------------------------------------------------------------------------------------


@dataclass
class Written(WriterCommitMessage):
    keys: list[str]
    stage: str


SIDECAR = ".meta.json"


def safe_key(key: str) -> str:
    """A key as a path below the root; refused if it is empty, absolute or leads out of it."""
    path = posixpath.normpath(key or "")
    if not key or path.startswith(("/", "..")) or path == "." or any(c in key for c in "\\\0\n") or key.endswith(SIDECAR):
        raise ValueError(f"key {key!r} is refused")
    return path


class Objects(DataSource):
    """Objects (key string, content binary, meta string, null for none) in a folder, the metadata in a file beside each.

    Writing puts a task's objects in a folder of its own first; they get their places when all tasks are done, and an aborted job leaves nothing.  Reading plans a
    partition for each ``files`` objects (1000).
    """

    @classmethod
    def name(cls) -> str:
        return "objects"

    def schema(self) -> str:
        return "key string, content binary, meta string"

    def reader(self, schema: StructType) -> DataSourceReader:
        return _ObjectReader(self.options["path"], int(self.options.get("files", 1000)))

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return _ObjectWriter(self.options["path"])


class _ObjectReader(DataSourceReader):
    def __init__(self, path: str, files: int):
        self.path, self.files = path, files

    def _keys(self) -> list[str]:
        system, root = opened(self.path)
        found = system.get_file_info(fs.FileSelector(root, recursive=True, allow_not_found=True))
        names = (f.path[len(root.rstrip("/")) + 1 :] for f in found if f.type == fs.FileType.File)
        return sorted(n for n in names if not n.endswith(SIDECAR) and not n.startswith(".stage-"))

    def partitions(self) -> list[InputPartition]:
        keys = self._keys()
        return [Part("\n".join(keys[i : i + self.files])) for i in range(0, len(keys), self.files)]

    def read(self, partition: Part) -> Iterator[tuple]:
        system, root = opened(self.path)
        for key in partition.name.split("\n"):
            with system.open_input_stream(f"{root}/{key}") as stream:
                content = stream.read()
            meta = None
            if system.get_file_info(f"{root}/{key}{SIDECAR}").type == fs.FileType.File:
                with system.open_input_stream(f"{root}/{key}{SIDECAR}") as stream:
                    meta = stream.read().decode()
            yield key, content, meta


class _ObjectWriter(DataSourceWriter):
    def __init__(self, path: str):
        self.path, self.job = path, f".stage-{uuid.uuid4().hex}"

    def write(self, rows: Iterator) -> WriterCommitMessage:
        system, root = opened(self.path)
        stage, keys = f"{root}/{self.job}/{uuid.uuid4().hex}", []
        for key, content, meta in rows:
            path = safe_key(key)
            for name, data in ((path, bytes(content or b"")), (path + SIDECAR, None if meta is None else meta.encode())):
                if data is not None:
                    system.create_dir(posixpath.dirname(f"{stage}/{name}"), recursive=True)
                    with system.open_output_stream(f"{stage}/{name}") as out:
                        out.write(data)
                    keys.append(name)
        return Written(keys, stage)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        """Give objects their places: names only, and only those of tasks that count, so a task that ran twice is there once."""
        system, root = opened(self.path)
        for m in messages:
            for name in m.keys if m is not None else []:
                system.create_dir(posixpath.dirname(f"{root}/{name}"), recursive=True)
                if not name.endswith(SIDECAR) and system.get_file_info(f"{root}/{name}{SIDECAR}").type == fs.FileType.File:
                    system.delete_file(f"{root}/{name}{SIDECAR}")
                system.move(f"{m.stage}/{name}", f"{root}/{name}")
        self._clear()

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        self._clear()

    def _clear(self) -> None:
        system, root = opened(self.path)
        if system.get_file_info(f"{root}/{self.job}").type == fs.FileType.Directory:
            system.delete_dir(f"{root}/{self.job}")
