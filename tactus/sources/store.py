"""Song folders as a Spark data source: chart files read as text, and texts written as files.

Both sides run in tasks. Reading lists only the packs beforehand; each task lists its share of a pack's songs and
decodes every file once, where its bytes are read. Writing stages each attempt's files apart and
moves those of the attempts that Spark accepts into place when all of them are done.
"""

from __future__ import annotations

import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from tactus.functions import constants as k

NAME = "song_folders"
SCHEMA = (
    "path string, directory string, pack string, song string, file string, suffix string, length bigint,"
    " text string, encoding string, error string"
)
#: Bytes of text of a batch, about, and tasks that share a pack.
BATCH_BYTES = 4 << 20
SLICES = 8
ENCODINGS = ("utf-8", "cp932", "latin-1")
STAGED = "_staged-"


def opened(path: str) -> tuple[fs.FileSystem, str]:
    """File system and plain path of a path with or without a scheme."""
    local = re.sub(r"^file:/+", "/", path)
    system, plain = fs.FileSystem.from_uri(local)
    return system, plain.rstrip("/")


def decoded(raw: bytes) -> tuple[str, str]:
    """Text and the first encoding that fits; the last one fits all bytes."""
    for encoding in ENCODINGS:
        try:
            return raw.decode(encoding), encoding
        except UnicodeDecodeError:
            continue
    raise AssertionError(ENCODINGS)


@dataclass
class Share(InputPartition):
    """Songs of a pack whose name falls on ``slice``."""

    pack: str
    slice: int
    slices: int


def _listed(system: fs.FileSystem, folder: str) -> list[fs.FileInfo]:
    return sorted(system.get_file_info(fs.FileSelector(folder)), key=lambda x: x.path)


class FolderReader(DataSourceReader):
    def __init__(self, options: dict):
        self.root = options["path"]
        self.slices = int(options.get("slices", SLICES))
        excluded = options.get("excluded")
        self.excluded = set(k.EXCLUDED_PACKS if excluded is None else filter(None, excluded.split("/")))
        self.names = options.get("names") == "true"

    def partitions(self) -> list[Share]:
        system, root = opened(self.root)
        packs = [x.base_name for x in _listed(system, root) if x.type == fs.FileType.Directory]
        return [Share(p, i, self.slices) for p in packs if p not in self.excluded and not p.startswith(STAGED) for i in range(self.slices)]

    def read(self, share: Share) -> Iterator[pa.RecordBatch]:
        system, root = opened(self.root)
        rows: list[dict] = []
        held = 0
        for row in self._files(system, root, share):
            rows.append(row)
            held += len(row["text"] or "") + 200
            if held >= BATCH_BYTES:
                yield self._batch(rows)
                rows, held = [], 0
        if rows:
            yield self._batch(rows)

    def _files(self, system: fs.FileSystem, root: str, share: Share) -> Iterator[dict]:
        pack = f"{root}/{share.pack}"
        try:
            songs = _listed(system, pack)
        except OSError as fault:
            if share.slice == 0:
                yield self._row(pack, error=_reason(fault))
            return
        for song in songs:
            if song.type != fs.FileType.Directory or zlib.crc32(song.base_name.encode()) % share.slices != share.slice:
                continue
            try:
                files = _listed(system, song.path)
            except OSError as fault:
                yield self._row(song.path, error=_reason(fault))
                continue
            if self.names:
                # As Spark's own listing has them: without empty and hidden files.
                if not any(_hidden(x) for x in (share.pack, song.base_name)):
                    seen = (x for x in files if x.type == fs.FileType.File and x.size and not _hidden(x.base_name))
                    yield from (self._row(x.path, length=x.size) for x in seen)
                continue
            for file in files:
                if file.type == fs.FileType.Directory or file.extension.lower() not in k.SIMFILE_SUFFIXES:
                    continue
                try:
                    with system.open_input_stream(file.path) as stream:
                        raw = stream.read()
                except OSError as fault:
                    yield self._row(file.path, error=_reason(fault))
                    continue
                text, encoding = decoded(raw)
                yield self._row(file.path, text=text, encoding=encoding, length=len(raw))

    @staticmethod
    def _row(path: str, text: str | None = None, encoding: str | None = None, length: int | None = None, error: str | None = None) -> dict:
        parts = path.split("/")
        name = parts[-1]
        return {
            "path": path, "directory": path.rsplit("/", 1)[0], "pack": parts[-3], "song": parts[-2], "file": name,
            "suffix": name.rsplit(".", 1)[-1].lower() if "." in name[1:] else "", "length": length, "text": text,
            "encoding": encoding, "error": error,
        }

    @staticmethod
    def _batch(rows: list[dict]) -> pa.RecordBatch:
        kinds = [(c.split()[0], pa.int64() if c.split()[1] == "bigint" else pa.string()) for c in SCHEMA.split(", ")]
        return pa.RecordBatch.from_pylist(rows, pa.schema(kinds))


def _hidden(name: str) -> bool:
    return name.startswith(".") or name.startswith("_") and "=" not in name or name.endswith("._COPYING_")


def _reason(fault: OSError) -> str:
    return f"{type(fault).__name__}: {fault.strerror or fault}"[:200]


@dataclass
class Staged(WriterCommitMessage):
    """The folder that an attempt has filled."""

    folder: str


class FolderWriter(DataSourceWriter):
    """Writes rows of (path, text) and perhaps ``encoding``; paths are pack/song/file below the target."""

    def __init__(self, options: dict, overwrite: bool):
        self.target = options["path"]
        self.overwrite = overwrite
        self.job = f"{STAGED}{uuid.uuid4().hex}"

    def write(self, rows: Iterator) -> Staged:
        system, target = opened(self.target)
        context = TaskContext.get()
        folder = f"{target}/{self.job}/{context.partitionId()}-{context.taskAttemptId()}"
        system.create_dir(folder, recursive=True)
        made: set[str] = set()
        for row in rows:
            parts = row["path"].split("/")
            if len(parts) != 3 or any(p in ("", ".", "..") or p.startswith(STAGED) for p in parts):
                raise ValueError(f"not a path of pack, song and file: {row['path']!r}")
            if row["path"] in made:
                raise ValueError(f"{row['path']} is written twice")
            made.add(row["path"])
            system.create_dir(f"{folder}/{parts[0]}/{parts[1]}", recursive=True)
            encoding = row["encoding"] if "encoding" in row and row["encoding"] else "utf-8"
            with system.open_output_stream(f"{folder}/{row['path']}") as stream:
                stream.write((row["text"] or "").encode(encoding))
        return Staged(folder)

    def commit(self, messages: list[Staged | None]) -> None:
        system, target = opened(self.target)
        moves: dict[str, str] = {}
        for message in filter(None, messages):
            for found in system.get_file_info(fs.FileSelector(message.folder, recursive=True)):
                if found.type == fs.FileType.File:
                    inside = found.path[len(message.folder) + 1 :]
                    if inside in moves:
                        self.abort(messages)
                        raise ValueError(f"{inside} is written twice")
                    moves[inside] = found.path
        if not self.overwrite:
            there = [x.path for x in system.get_file_info([f"{target}/{p}" for p in moves]) if x.type != fs.FileType.NotFound]
            if there:
                self.abort(messages)
                raise FileExistsError(f"{len(there)} files are there already, such as {there[0]}")
        for inside, staged in sorted(moves.items()):
            system.create_dir(f"{target}/{inside.rsplit('/', 1)[0]}", recursive=True)
            system.move(staged, f"{target}/{inside}")
        self.abort(messages)

    def abort(self, messages: list[Staged | None]) -> None:
        system, target = opened(self.target)
        if system.get_file_info(f"{target}/{self.job}").type == fs.FileType.Directory:
            system.delete_dir(f"{target}/{self.job}")


class SongFolders(DataSource):
    """``spark.read.format("song_folders").load(root)`` and ``df.write.format("song_folders").save(root)``.

    Options for reading: ``excluded``, pack names with slashes between them, ``slices``, tasks for each pack,
    and ``names``: with ``true`` every file is a row, whatever its suffix, and none is opened.
    """

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> FolderReader:
        return FolderReader(self.options)

    def writer(self, schema, overwrite: bool) -> FolderWriter:
        return FolderWriter(self.options, overwrite)
