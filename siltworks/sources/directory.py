"""Rows as named files in a folder: a text file and a metadata file each, and an index.

Tasks stage their files in folders of their own under the target; the driver renames them into place when every task is done, or removes them when one
failed, so a job leaves all its files or none. It is meant for folders that people and other programs read; large tables belong into Parquet. The
folder must be on a store that pyarrow.fs opens and all executors see.
"""

from __future__ import annotations

import json
import posixpath
import uuid
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from datetime import date, datetime
from decimal import Decimal

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

#: Files that the driver renames at a time.
MOVERS = 16


def open_store(folder: str) -> tuple[fs.FileSystem, str]:
    """The store of a folder and the path in it; a path without a scheme is local."""
    if "://" not in folder:
        return fs.LocalFileSystem(), folder.removeprefix("file:").rstrip("/")
    store, path = fs.FileSystem.from_uri(folder)
    return store, path.rstrip("/")


def _plain(value: object) -> object:
    if isinstance(value, datetime | date):
        return value.isoformat()
    if isinstance(value, Decimal):
        return str(value)
    if isinstance(value, bytes):
        return value.hex()
    raise TypeError(f"no JSON for {type(value).__name__}")


@dataclass
class _Staged(WriterCommitMessage):
    folder: str
    files: int


class DirectorySink(DataSource):
    """Format siltworks_directory, for writing. Options: path; name and text, the columns of the file name without its suffix and of the text (name,
    text); text_suffix (.txt); metadata_suffix (.json; empty writes no metadata); index, the name of a JSONL file in the folder with a line per file.

    All other columns are the metadata, with text_bytes and text_path. A name must be a plain file name; two rows of one name fail the job. A null
    text is an empty file. Mode append keeps what is there and replaces files of equal name; overwrite removes what the folder holds first.
    """

    @classmethod
    def name(cls) -> str:
        return "siltworks_directory"

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:  # noqa: ANN001
        return _DirectoryWriter(dict(self.options), schema.fieldNames(), overwrite)


class _DirectoryWriter(DataSourceArrowWriter):
    def __init__(self, options: dict, columns: list[str], overwrite: bool):
        self.folder, self.overwrite = options["path"], overwrite
        self.name_column, self.text_column = options.get("name", "name"), options.get("text", "text")
        missing = {self.name_column, self.text_column} - set(columns)
        if missing:
            raise ValueError(f"no column {', '.join(sorted(missing))}")
        self.text_suffix, self.metadata_suffix, self.index = options.get("text_suffix", ".txt"), options.get("metadata_suffix", ".json"), options.get("index")
        self.staging = f".staging-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        store, root = open_store(self.folder)
        mine = f"{self.staging}/{TaskContext.get().partitionId()}-{uuid.uuid4().hex}"
        here = posixpath.join(root, mine)
        store.create_dir(posixpath.join(here, "files"), recursive=True)
        files, lines = 0, []
        with store.open_output_stream(posixpath.join(here, "index")) as index:
            for batch in iterator:
                for at in range(0, batch.num_rows, 100):
                    for row in batch.slice(at, 100).to_pylist():
                        lines.append(self._put(store, here, root, row))
                        files += 1
                    index.write("".join(lines).encode())
                    lines = []
        return _Staged(mine, files)

    def _put(self, store: fs.FileSystem, here: str, root: str, row: dict) -> str:
        name, text = row.pop(self.name_column), (row.pop(self.text_column) or "").encode()
        if not name or "/" in name or "\\" in name or name.startswith("."):
            raise ValueError(f"{name!r} is no plain file name")
        with store.open_output_stream(posixpath.join(here, "files", name + self.text_suffix)) as out:
            out.write(text)
        told = row | {"text_bytes": len(text), "text_path": posixpath.join(root, name + self.text_suffix)}
        if self.metadata_suffix:
            with store.open_output_stream(posixpath.join(here, "files", name + self.metadata_suffix)) as out:
                out.write(json.dumps(told, indent=2, sort_keys=True, default=_plain).encode())
        return json.dumps(told, sort_keys=True, default=_plain) + "\n"

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        store, root = open_store(self.folder)
        staged = [m for m in messages if m is not None]
        moves: dict[str, str] = {}
        for message in staged:
            for file in store.get_file_info(fs.FileSelector(posixpath.join(root, message.folder, "files"))):
                if file.base_name in moves:
                    self.abort(messages)
                    raise ValueError(f"two rows are named {file.base_name}")
                moves[file.base_name] = file.path
        if self.overwrite:
            for old in store.get_file_info(fs.FileSelector(root)):
                if old.base_name != self.staging:
                    (store.delete_dir if old.type == fs.FileType.Directory else store.delete_file)(old.path)
        with ThreadPoolExecutor(MOVERS) as movers:
            list(movers.map(lambda m: store.move(m[1], posixpath.join(root, m[0])), moves.items()))
        if self.index:
            self._extend_index(store, root, staged)
        store.delete_dir(posixpath.join(root, self.staging))

    def _extend_index(self, store: fs.FileSystem, root: str, staged: list[_Staged]) -> None:
        """The index is written anew beside the old one and renamed over it."""
        path, fresh = posixpath.join(root, self.index), posixpath.join(root, self.staging, "index")
        parts = [posixpath.join(root, m.folder, "index") for m in staged]
        if store.get_file_info(path).type == fs.FileType.File:
            parts.insert(0, path)
        with store.open_output_stream(fresh) as out:
            for part in parts:
                with store.open_input_stream(part) as old:
                    while data := old.read(1 << 20):
                        out.write(data)
        store.move(fresh, path)

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        store, root = open_store(self.folder)
        path = posixpath.join(root, self.staging)
        if store.get_file_info(path).type == fs.FileType.Directory:
            store.delete_dir(path)


def write_directory(rows: DataFrame, path: str, mode: str = "append", **options: str) -> None:
    """Write rows by DirectorySink."""
    rows.sparkSession.dataSource.register(DirectorySink)
    rows.write.format("siltworks_directory").mode(mode).options(path=path, **options).save()


def write_html_pairs(pairs: DataFrame, path: str, mode: str = "append") -> None:
    """pairs (key, before, after) as key_before.html and key_after.html."""
    one = lambda end: F.struct(F.concat("key", F.lit(f"_{end}")).alias("name"), F.col(end).alias("text"))
    files = pairs.select(F.explode(F.array(one("before"), one("after"))).alias("f")).select("f.*")
    write_directory(files, path, mode, text_suffix=".html", metadata_suffix="")
